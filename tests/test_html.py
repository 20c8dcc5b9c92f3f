"""Tables and sections of pages by their trees."""

from __future__ import annotations

from pyspark.sql import functions as F
from tessera.functions import html as H
from tessera.sources import tables


def of(text):
    return [(t["header"], t["rows"]) for t in H.tables(H.parse(text))]


def test_headers():
    assert of("<table><tr><th>Vade<th>Oran<tr><td>12<td>1,89</table>") == [(["Vade", "Oran"], [["12", "1,89"]])]
    assert of("<table><tr><td>Vade</td><td>Oran</td></tr><tr><td>12</td><td>1,89</td></tr></table>") == [(["Vade", "Oran"], [["12", "1,89"]])]
    assert of("<table><thead><tr><td>A<td>B</thead><tbody><tr><td>1<td>2</table>") == [(["A", "B"], [["1", "2"]])]
    assert of("<table><tr><th>0<th>1<tr><td>A<td>B<tr><td>x<td>y</table>") == [(["A", "B"], [["x", "y"]])]  # digits are no header
    assert of("<table><tr><th colspan=2>Konut<tr><th>Vade<th>Oran<tr><td>12<td>2</table>") == [(["Konut Vade", "Konut Oran"], [["12", "2"]])]
    assert of("<p>no table</p>") == [] == of(None) and of("<table></table>") == [([], [])]


def test_spans_and_empty_rows():
    text = "<table><tr><td>a<td>b<td>c<tr><td rowspan=2>x<td colspan=2>y<tr><td>1<td>2<tr><td><td> <td>&nbsp;<tr><td rowspan=0>z<td>3<tr><td>4</table>"
    assert of(text) == [(["a", "b", "c"], [["x", "y", "y"], ["x", "1", "2"], ["z", "3", ""], ["z", "4", ""]])]
    wide = of("<table><tr><td colspan=999999999>a<td rowspan=99999999>b<tr><td>c</table>")
    assert len(wide[0][0]) == 1001 and wide[0][1][0][1000] == "b"
    assert of("<table><tr><td>a<td>b<td rowspan=2>c<tr><td>x</table>") == [(["a", "b", "c"], [["x", "", "c"]])]


def test_tables_in_tables():
    text = "<table><tr><th>A<th>B<tr><td>1<table><tr><td>in</td><td>side</td></tr><tr><td>p<td>q</table>after<td>2<tr><td>3<td>4</table>"
    assert of(text) == [(["A", "B"], [["1 after", "2"], ["3", "4"]]), (["in", "side"], [["p", "q"]])]


def test_sections():
    text = "<body>before<h1>One <b>t</b></h1><div><p>a<script>x</script></p><h3>Two</h3></div><p>b<br>c<h2></h2>d"
    assert H.sections(H.parse(text)) == [{"title": "One t", "body": "a"}, {"title": "Two", "body": "b c"}, {"title": "", "body": "d"}]
    assert H.sections(H.parse(None)) == [] == H.sections(H.parse("<p>x"))


def test_over_rows(spark):
    rate = "<table><tr><th>​Vade</th><th>Kâr Oranı</th></tr><tr><td>12</td><td>1,89</td></tr></table>"
    rows = spark.createDataFrame([(1, rate, 1.5), (2, "<table><tr><td>x</table>", 2.0), (3, None, 2.5)], "i long, h string, rate double")
    got = rows.withColumn("t", tables.rate_tables(tables.html_tables(F.col("h"))))
    assert {r.i: r.t and r.t[0]["header"] for r in got.collect()} == {1: ["Vade", "Kâr Oranı"], 2: None, 3: None}
    assert {r.i: r.rate for r in tables.blank_where_tabled(got, "t", ["rate"]).collect()} == {1: None, 2: 2.0, 3: 2.5}


def test_a_reference_that_a_title_cuts_off_stays_as_written(spark):
    html = "<h1>A &amp; B&amp;&amp</h1><p>&copy; &amp;copy; &copy &#65;&#x42;&#67 &notit; &nothing;</p>"
    row = tables.sections(spark.createDataFrame([(1, "u", html)], "k int, url string, html string"), "k", "url", "html").first()
    assert (row.title, row.body) == ("A & B&&amp", "© &copy; &copy AB&#67 &notit; &nothing;")
    assert H.parse("<p>a&amp</p>").text() == "a&"  # elsewhere as browsers read it


def test_equal_pages_of_a_batch_are_read_once():
    import pyarrow as pa

    read = []
    seen = lambda x: read.append(x) or H.sections(H.parse(x))
    pages = pa.array(["<h1>a</h1>b", None, "<h1>c</h1>", "<h1>a</h1>b", None])
    assert tables._each_once(pages, seen, tables._SECTIONS).to_pylist() == [H.sections(H.parse(x.as_py())) for x in pages] and len(read) == 3
