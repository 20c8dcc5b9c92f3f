"""The training-data operators against brute force, exact round trips and held-out accuracy on small tables."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import resource
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import common, components, langid, lattice, minhash, mixing, packing, quality_cnn, quality_rules, toxicity, url_trust, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string"


def documents(spark, texts, lang="en", source="s"):
    rows = [(i, t, lang, source, len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, start=0):
    return " ".join(f"w{rng.randrange(start, start + 400)}" for _ in range(n))


def test_word_hash_sets_equal_brute_force():
    rng = random.Random(1)
    for text in [None, "", " \n", "One", "a b c d", "a b c d e", "A b  C d e\nf\tg", prose(rng, 300), "é ü　x y z ß"]:
        words = [w for w in re.split("[\x20\x09-\x0D]+", (text or "").encode().lower().decode()) if w]
        sets = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
        assert len(minhash.shingle_set(text)) == len(sets)


def test_long_texts_hash_alike_in_blocks(monkeypatch):
    text = prose(random.Random(2), 3000)
    whole = minhash.shingle_set(text)
    monkeypatch.setattr(minhash, "BLOCK", 1 << 10)
    assert (minhash.shingle_set(text) == whole).all()


def brute_components(n, links):
    root = list(range(n))
    for _ in range(n):
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    return root


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(3)
    base = prose(rng, 120).split()
    texts = [" ".join(base)]
    for _ in range(40):  # a group whose members are near the first, and only sometimes near each other
        words = list(base)
        for k in rng.sample(range(120), 3):
            words[k] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [texts[5], texts[5].upper(), None, "", "just four words here", "Just four words HERE", prose(rng, 80), prose(rng, 90)]
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    n = len(texts)
    links = [(u, v) for u in range(n) for v in range(u) if sets[u] and 100 * len(sets[u] & sets[v]) >= 75 * len(sets[u] | sets[v])]
    root = brute_components(n, links)
    got = {r.doc_id: r for r in minhash.near_copies(documents(spark, texts)).collect()}
    assert [got[i].component_id for i in range(n)] == root
    assert [got[i].n_shingles for i in range(n)] == [len(s) for s in sets]
    assert all(got[i].kept == (root[i] == i) for i in range(n))
    left = minhash.drop_copies(documents(spark, texts))
    assert left.columns == documents(spark, texts).columns
    assert sorted(r.doc_id for r in left.collect()) == [i for i in range(n) if root[i] == i]


def test_blocks_find_what_hubs_leave_open(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "CHUNK", 8)
    rng = random.Random(4)
    words = prose(rng, 200).split()
    texts = []
    for k in range(30):  # a chain: each is near its neighbours only
        for j in range(4):
            words[(7 * k + 50 * j) % 200] = f"c{k}-{j}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts]
    links = [(u, v) for u in range(30) for v in range(u) if 100 * len(sets[u] & sets[v]) >= 75 * len(sets[u] | sets[v])]
    got = {r.doc_id: r.component_id for r in minhash.near_copies(documents(spark, texts)).collect()}
    assert [got[i] for i in range(30)] == brute_components(30, links)


def test_rows_that_share_an_id_are_dropped_alike_in_any_order(spark):
    rows = [(1, "a b c d e f", "x"), (1, "g h i j k l", "y"), (1, "g h i j k l", "y"), (2, "m n o p q r", None), (None, "z", "q"), (None, "z", "q"), (3, "A b c d E f", "w")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, other = (sorted(map(tuple, minhash.drop_copies(f).collect()), key=str) for f in (frame, frame.orderBy(F.desc("source"))))
    assert one == other and [r[0] for r in one] == [1, 2, None, None]


def test_empty_and_null_rows_in_near_copies(spark):
    none = spark.createDataFrame([], DOCS)
    assert minhash.near_copies(none).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_copies(rows).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 2, True), (None, None, True)]


@pytest.mark.parametrize("few", [500_000, 0])
def test_components_of_a_long_path_and_a_star(spark, monkeypatch, few):
    monkeypatch.setattr(components, "BROADCAST_EDGES", few)  # by broadcast, and by joins with the star's hub apart
    monkeypatch.setattr(components, "HOT", 8)
    edges = [(i, i + 1) for i in range(40 if few else 12)] + [(100, 100 + i) for i in range(1, 30)]
    if not few:
        edges += [(i, i + 1) for i in range(12, 40)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(500, 8)) * 2
    p = lattice.nearest_e8(y)
    assert np.isin(np.mod(p, 1), (0, 0.5)).all() and (np.mod(p.sum(1), 2) == 0).all()
    around = ((y - p)[:, None, :] - lattice.roots()[None]) ** 2
    assert (((y - p) ** 2).sum(1) <= around.sum(2).min(1) + 1e-9).all()
    assert len(lattice.roots()) == 240


@pytest.mark.parametrize("large", [64, 4])
def test_vectors_equal_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(lattice, "LARGE", large)
    monkeypatch.setattr(lattice, "CHUNK", 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 32))
    x[40:100] = x[3] + 0.12 * rng.normal(size=(60, 32))
    x[110] = x[111]
    x[50:56] = x[49]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (200, None), (201, []), (202, [0.0] * 32), (203, [float("nan")] * 32), (204, [None, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= lattice.COSINE
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in lattice.near_copies(frame).collect()}
    found = sum(got[i].n_links for i in range(120))
    assert all(got[i].n_links <= near[i].sum() for i in range(120)) and found >= 0.98 * near.sum()
    root = brute_components(120, np.argwhere(near).tolist())
    assert sum(got[i].component_id == root[i] for i in range(120)) >= 118
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(200, 205))
    if large == 4:
        assert lattice.near_copies(frame.limit(0)).count() == 0
        twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 2.0]), (4, [-1.0, 0.0])], "vec_id long, embedding array<double>")
        told = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.near_copies(twice).collect()}
        assert told == {(1, 2, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)}


def test_largest_scale_finds_as_many_near_vectors(spark):
    rng = np.random.default_rng(6)
    n, length = 1000, 64
    a, b = rng.normal(size=(2, n, length))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.951 * a + np.sqrt(1 - 0.951**2) * b
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([a, near]))], "vec_id long, embedding array<double>")
    for scale in (1.2, 1.4, 1.6):
        got = {r.vec_id: r for r in lattice.near_copies(frame, scale=scale).collect()}
        found = np.mean([got[i].n_links == 1 and got[n + i].component_id == i and not got[n + i].kept for i in range(n)])
        assert found >= 0.99, (scale, found)


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    texts = [prose(rng, rng.choice([1, 5, 60, 400, 900])) for _ in range(150)] + [None, "", " a  b\n", "x<|endoftext|>y"]
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    pieces = packing.pack(documents(spark, texts).repartition(5), windows=8, group=2).collect()
    covered = {i: [] for i in ids}
    sequences: dict[int, list] = {}
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length > 0 and crc32(np.array(part, "<u4").tobytes()) == p.ids_crc32
        assert p.doc_tokens == len(ids[p.doc_id])
        covered[p.doc_id] += range(p.start, p.start + p.length)
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert all(sorted(got) == list(range(len(ids[i]))) for i, got in covered.items())
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= packing.SIZE
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_long_texts_tokenise_alike_in_pieces(monkeypatch):
    encoder = packing.Ids(packing.vocabulary())
    texts = ["it's  1234 'll  don't\n x  ", prose(random.Random(7), 500), "a \n b", "é ü ß　x " * 40]
    whole = [encoder.of(t) for t in texts]
    monkeypatch.setattr(packing, "PIECE", 20)
    assert [encoder.of(t) for t in texts] == whole


def test_poisson_copies_follow_their_mean(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source")
    )
    for limit in (10, 0):  # by broadcast and by salted join
        got = mixing.mix(docs, {"a": 2.0, "b": 0.0, None: 1.0}, copy_column="copy", broadcast_sources=limit)
        n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
        assert n.keys() == {"a", None} and abs(n["a"] - 4000) < 250 and abs(n[None] - 2000) < 180
        assert got.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("m")).where("n != m").count() == 0
    rates = mixing.repetition_rates(docs, {"a": 2.0, "b": 0.0, None: 1.0})
    assert all(abs(r.cdf[-1] - 1) < 1e-9 for r in rates.collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_words_longer_than_a_block(monkeypatch):
    texts = ["x y z w " + "a" * 50, "a" * 100, "b " * 40 + "c" * 33 + " d e f g", "q" * 17 + " " + "r" * 16 + "  s" * 20, " " * 50 + "t", "u" * 16 + "\t" + "v" * 16]
    whole = [minhash.shingle_set(x).tolist() for x in texts]
    minhash._powers.cache_clear()
    monkeypatch.setattr(minhash, "BLOCK", 16)
    assert [minhash.shingle_set(x).tolist() for x in texts] == whole and len(whole[0]) == len(whole[1]) == 1
    minhash._powers.cache_clear()


def test_hot_hubs_and_buckets(spark, monkeypatch):
    """Joins of hot keys by salts give what plain ones do."""
    rng = random.Random(8)
    base = [prose(rng, 60) for _ in range(3)]
    texts = [b for b in base for _ in range(2)] + [" ".join([*base[i % 3].split(" ")[: 59 - i % 5], f"n{i}"]) for i in range(60)]
    docs = documents(spark, texts)
    want = sorted(map(tuple, minhash.near_copies(docs).select("doc_id", "n_shingles", "component_id").collect()))
    monkeypatch.setattr(minhash, "hot_keys", lambda counts, n, rows: common.hot_keys(counts, n, rows, least=2))
    monkeypatch.setattr(common, "HOT", 1000)
    monkeypatch.setattr(common, "PARTS", 3)
    assert sorted(map(tuple, minhash.near_copies(docs).select("doc_id", "n_shingles", "component_id").collect())) == want


def test_a_rare_source_of_very_many_copies(spark, monkeypatch):
    docs = spark.range(40_001).select(F.when(F.col("id") < 40_000, F.col("id")).alias("doc_id"), F.lit("").alias("text"), F.when(F.col("id") == 40_000, "rare").otherwise("plain").alias("source"))
    monkeypatch.setattr(mixing, "PIECE", 1000)
    got = mixing.mix(docs, {"rare": 1.0, "plain": 1.0}, copy_column="copy")
    n = {r.source: (r.n, r.m, r.k) for r in got.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("m"), F.max("copy").alias("k")).collect()}
    assert abs(n["rare"][0] - 20_000) < 1000 and len(set(n["rare"])) == 1 and abs(n["plain"][0] - 20_000) < 800
    # against the distribution summed up in logarithms, also for rates of 10 ** 9
    for rate in (401.0, 5000.0, 3e5, 1e9):
        units = [1e-6, 0.01, 0.3, 0.5, 0.77, 0.999, 1 - 1e-6]
        frame = spark.createDataFrame([(u, rate) for u in units], "u double, r double")
        told = [r.n for r in frame.select("u", mixing._walked(F.col("u"), F.col("r")).alias("n")).orderBy("u").collect()]
        low, high = math.floor(rate - 11 * math.sqrt(rate)), math.ceil(rate + 11 * math.sqrt(rate))
        k = np.arange(low, high)
        z = (k - rate) / rate
        p = np.exp(-rate * ((1 + z) * np.log1p(z) - z)) / np.sqrt(k)
        want = low + np.searchsorted(np.cumsum(p / p.sum()), units, "right")
        assert all(abs(a - b) <= 1 + 1e-4 * math.sqrt(rate) for a, b in zip(told, want, strict=True)), (rate, told, want)


def test_mixing_of_odd_rows(spark):
    rows = [(None, None, "a"), (None, "", "a"), (1, "x", None), (1, "x", None), (2, None, "b")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, copy int")
    got = mixing.mix(docs, epochs=50.0, copy_column="copy").collect()
    n = Counter((r.doc_id, r.text, r.source) for r in got)
    assert n[(None, None, "a")] == n[(None, "", "a")] and n[(1, "x", None)] % 2 == 0 and set(n) == set(rows)
    assert {r.copy for r in got if r.doc_id == 2} == set(range(1, n[(2, None, "b")] + 1))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, epochs=50.0, copy_column="copy").collect()))


def test_many_languages_in_bounded_memory():
    langs = [f"l{i:03}" for i in range(1000)]
    rng = np.random.default_rng(4)
    table = np.log(rng.random((langid.BUCKETS, 1000), np.float32) + 0.01)
    model = langid.LanguageModel(langs, table, np.zeros(1000))
    texts = ["".join(rng.choice(list("abcdefghij klmnop"), 400_000)), "short one", "", None, "12 34", "é" * 30]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got, scores = model.score(texts)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # kilobytes
    assert got[2:5] == ["und"] * 3 and scores[2:5].tolist() == [0.0] * 3
    for text, lang in zip(texts, got, strict=True):
        if lang != "und":
            sums = sum(np.bincount(langid.ngram_cells(b, k == 0), minlength=langid.BUCKETS) @ table.astype(float) for k, b in enumerate(langid.code_points(text)))
            assert langs[int(sums.argmax())] == lang


def test_rules_and_propagated_verdicts(spark):
    link = '<a href="http://{}/x">'
    rows = [
        (1, "http://a.net/x", link.format("b.com")), (2, "http://b.com/y", link.format("c.com")), (3, "http://c.com/", link.format("a.net")),
        (4, "https://A.Example.net/en/1?q", link.format("good.com")), (5, "http://x.org/fr/1", link.format("good.com")),
        (6, "http://good.com/1", ""), (7, None, None), (8, "nothing", ""), (9, "http://notnet/x", ""), (10, "http://z.net", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_trust.judge(pages, damping=0.5).collect()}
    assert [got[i].verdict for i in (1, 4, 5)] == ["block", "allow", "allow"]
    assert got[1].rule == "net/" and got[4].rule == "example.net/en/" and got[5].rule == "org/fr/"
    assert got[4].host == "a.example.net" and got[4].path == "/en/1"
    assert got[3].verdict == "block" and got[2].verdict == "block" and got[6].verdict == "allow"
    assert (got[7].host, got[7].path, got[7].rule, got[8].host) == ("", "", None, "")
    assert got[9].rule is None and got[10].rule is None
    assert {r.page_id: r for r in url_trust.judge(pages, damping=0.5, broadcast_hosts=0).collect()} == got
    assert url_trust.judge(pages.limit(0)).count() == 0


def test_verdicts_do_not_turn_with_the_number_of_hosts(spark):
    link = '<a href="http://{}/x">'
    many = [(i, f"http://bad{i % 6000}.net/x" if i < 6000 else f"http://h{i}.com/", link.format(f"bad{i - 6000}.net") if i >= 6000 else "") for i in range(12000)]
    got = {r.page_id: r.verdict for r in url_trust.judge(spark.createDataFrame(many, "page_id long, url string, html string"), damping=0.5).collect()}
    assert all(got[i] == "block" for i in range(12000))
    chain = [(0, "http://c0.net/x", "")] + [(i, f"http://c{i}.com/", link.format(f"c{i - 1}.com" if i > 1 else "c0.net")) for i in range(1, 15)]
    chain += [(20, "http://fine.org/fr/1", link.format("good.com")), (21, "http://good.com/", link.format("c0.net"))]
    got = {r.page_id: r.verdict for r in url_trust.judge(spark.createDataFrame(chain, "page_id long, url string, html string"), damping=0.7).collect()}
    assert all(got[i] == "block" for i in range(15)) and got[20] == got[21] == "allow"


def test_scores_equal_power_iteration_and_verdicts_the_sql(spark, monkeypatch):
    import duckdb

    monkeypatch.setattr(url_trust, "hot_keys", lambda counts, n, rows: common.hot_keys(counts, n, rows, least=5))
    monkeypatch.setattr(common, "HOT", 16)  # hub hosts go by broadcast
    rng = random.Random(31)
    hosts = [f"h{i}.com" for i in range(40)] + [f"b{i}.net" for i in range(5)] + [f"g{i}.org" for i in range(5)]
    pages = []
    for i, host in enumerate(hosts):
        to = [] if i % 7 == 3 else rng.sample(hosts, 3) + ([*hosts] if i == 0 else []) + [hosts[0]]  # dangling hosts, a hub, cycles
        html = "".join(f'<a href="http://{t.upper()}/x">' for t in to) + '<a href="/own">'
        pages.append((i, f"http://{host}/{'fr' if host.endswith('org') else 'de'}/{i}", html))
    pages += [(100, None, None), (101, "", ""), (102, "http://h1.com", None), (102, "http://h1.com", None)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    parsed = url_trust.with_host_and_path(frame)
    seeds = spark.createDataFrame([(h, int(h.endswith("org")), int(h.endswith("net"))) for h in hosts], "host string, allowed int, blocked int")
    scores, _ = url_trust.host_scores(url_trust.host_links(parsed), seeds, 0.5)
    got = {r.host: (r.trust, r.distrust) for r in scores.collect()}
    at, count = {h: k for k, h in enumerate(hosts)}, np.zeros((50, 50))
    for i, _, html in pages[:50]:
        for t in re.findall("//([^/]*)/", html):
            if (k := at[t.lower()]) != i:
                count[i, k] += 1
    for kind, (m, end) in enumerate(((count, "org"), (count.T, "net"))):
        walk = m / np.maximum(m.sum(1, keepdims=True), 1)
        seed = np.array([float(h.endswith(end)) for h in hosts])
        seed /= seed.sum()
        x = seed.copy()
        for _ in range(300):
            x = 0.5 * seed + 0.5 * x @ walk
        assert np.allclose([got.get(h, (0.0, 0.0))[kind] for h in hosts], x / x.sum(), atol=2e-5)
    judged = sorted(url_trust.judge(frame, damping=0.5).collect(), key=str)
    con = duckdb.connect()
    con.register("pages", frame.toPandas())
    said = sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({url_trust.oracle_sql(damping=0.5)})").fetchall(), key=str)
    assert sorted(map(str, map(tuple, judged))) == sorted(map(str, said))
    assert {r.verdict for r in judged if r.rule is None} == {"allow", "block"}


def test_archive_is_an_exact_round_trip(spark, tmp_path):
    big, other = "x" * 1500, "é" * 800
    rows = [(1, "u1", big), (2, None, big), (3, "u\r\n3", big), (4, "u4", other), (5, "u5", None), (6, "u6", ""), (7, "u7", "small"), (8, "u8", "small"), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = str(tmp_path / "archive")
    warc.write(pages, folder)
    got = {r.page_id: r for r in warc.summary(spark, folder).collect()}
    assert [got[i].record_type for i in (1, 2, 3, 4, 5, 6, 7, 8, None)] == ["revisit", "revisit", *["response"] * 6, "revisit"]
    assert got[1].refers_to == 3 and got[3].refers_to is None and got[4].payload_bytes == 1600
    assert spark.read.parquet(f"{folder}/payloads").count() == 4
    for r in warc.reconstruct(spark, folder).collect():
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        payload = (dict((k, v) for k, _, v in rows)[r.page_id] or "").encode()
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and bytes(r.payload) == payload
        assert body == (payload if r.record_type == "response" else b"") + b"\r\n\r\n"
        assert f"Content-Length: {len(body) - 4}".encode() in head
    assert warc.archive(pages.limit(0), str(tmp_path / "none")).count() == 0


def test_archive_of_one_payload_on_most_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "hot_keys", lambda counts, n, rows: common.hot_keys(counts, n, rows, least=3))
    monkeypatch.setattr(common, "HOT", 8)
    same = "boiler plate " * 100
    rows = [(i, f"u{i}", same if i % 3 else f"{i} " * 400) for i in range(90)] + [(200 + i, None, None) for i in range(40)] + [(5, "u5", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n", F.lit("clash"))
    folder = str(tmp_path / "hot")
    got = warc.archive(pages, folder).collect()
    owner = max(i for i, _, h in rows if h == same)
    assert len(got) == len(rows)
    for r in got:
        html = dict((i, h) for i, _, h in rows)[r.page_id] or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha1(html.encode()).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", owner) if html == same and r.page_id != owner else ("response", None))
    assert spark.read.parquet(f"{folder}/payloads").count() == 32
    rebuilt = warc.reconstruct(spark, folder).collect()
    assert len(rebuilt) == len(rows) and all(bytes(r.payload).decode() == (dict((i, h) for i, _, h in rows)[r.page_id] or "") for r in rebuilt)
    damaged = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.encode(F.lit("other"), "UTF-8"))
    damaged.write.parquet(f"{folder}2/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{folder}2/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.summary(spark, f"{folder}2").collect()


def repeat_words(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)})


def test_base_statistics_equal_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", " \n\t", "a b", prose(rng, 30), "x y z u v " * 4, "# a|b\n\n# a|b\nc d e\nc d e", "é　ü # $%&", prose(rng, 40) + "\n" + "q r s t u v w q r s t u v w"]
    got = {r.doc_id: r for r in quality_rules.judge(documents(spark, texts)).collect()}
    for i, t in enumerate(t or "" for t in texts):
        words = [w for w in re.split("[\x20\x09-\x0D]+", t) if w]
        lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(words), sum(map(len, words)), repeat_words(words))
        assert got[i].n_symbols == sum(c in "#*$%&|<>" for c in t) and got[i].n_dup_lines == len(lines) - len(set(lines))
        assert got[i].base_failed == (len(words) < 10 or 100 * got[i].n_repeat_words > 20 * len(words))
    assert quality_rules.judge(spark.createDataFrame([], DOCS)).count() == 0


def numpy_bins(d):
    return np.floor(np.log1p(d) * quality_rules.BINS_PER_UNIT)


def numpy_step(x, d, keep=quality_rules.KEEP):
    """The nearest rows, by bins of distances; their mean and covariance with floors; the new distances and log-determinant."""
    bins = numpy_bins(d)
    upto = np.array([(bins <= b).sum() for b in bins])
    near = bins <= bins[upto >= keep * len(x)].min()
    mean = x[near].mean(0)
    cov = np.cov(x[near].T, bias=True) + np.diag(np.array(quality_rules.FLOORS) ** 2)
    return near, mean, cov, np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean), np.linalg.slogdet(cov)[1]


def numpy_mcd(x, hashes):
    """By the operator's starts (hashes: one row for each subset's start) with plain loops."""
    low, mid, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    floors = np.array(quality_rules.FLOORS)
    starts = [(((x - mid) / np.maximum((high - low) / 1.349, floors)) ** 2).sum(1)]
    for h in hashes:
        part = x[h * len(x) < quality_rules.SUBSET]
        if len(part):
            cov = np.atleast_2d(np.cov(part.T, bias=True)) + np.diag(floors**2)
            starts.append(np.einsum("ij,jk,ik->i", x - part.mean(0), np.linalg.inv(cov), x - part.mean(0)))
    tried = []
    for d in starts:
        for _ in range(quality_rules.FIRST_STEPS):
            found = numpy_step(x, d)
            d = found[3]
        tried.append(found)
    best = min(tried, key=lambda f: f[4])
    while (new := numpy_step(x, best[3]))[4] < best[4] - quality_rules.LEAST_FALL:
        best = new
    return best


def test_estimates_of_every_cell_equal_numpy(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows, sizes = [], {"a": 400, "b": 60, "c": 7, "d": 1, "e": 2}
    for cell, n in sizes.items():
        x = rng.normal(size=(n, 4)) * [0.3, 0.2, 0.5, 0.4] + rng.normal(size=(n, 1)) * 0.2 + rng.normal(size=4)
        x[: n // 7] += 4
        rows += [(len(rows) + i, cell, *map(float, v)) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "id long, cell string, x0 double, x1 double, x2 double, x3 double")
    hashes = {r.id: [r[1 + k] for k in range(quality_rules.SUBSETS)] for r in frame.select("id", *[common.unit_hash(*quality_rules.X, F.lit(k)) for k in range(1, quality_rules.SUBSETS + 1)]).collect()}
    estimates = {r.cell: r for r in quality_rules.mcd_factors(frame.select("cell", *quality_rules.X)).collect()}
    monkeypatch.setattr(quality_rules, "mcd_factors", lambda *_: spark.createDataFrame([tuple(r) for r in estimates.values()], ", ".join(f"{c} {'string' if c == 'cell' else 'int' if c == 'start' else 'double'}" for c in quality_rules.FACTORS)))
    monkeypatch.setattr(quality_rules, "BROADCAST_CELLS", 0)  # distances by salted join
    got = {r.id: r.d2 for r in quality_rules.mcd_distances(frame).collect()}
    assert estimates.keys() == sizes.keys() and got.keys() == {r[0] for r in rows}
    for cell in sizes:
        ids = [r[0] for r in rows if r[1] == cell]
        x = np.array([r[2:] for r in rows if r[1] == cell])
        _, mean, _, d, log_det = numpy_mcd(x, np.array([hashes[i] for i in ids]).T)
        assert np.allclose([estimates[cell][f"m{i}"] for i in range(4)], mean, atol=1e-9) and abs(estimates[cell].log_det - log_det) < 1e-9
        bins = numpy_bins(d)
        upto = np.array([(bins <= b).sum() for b in bins])
        wider = max(1.0, np.expm1((bins[upto >= quality_rules.KEEP * len(x)].min() + 1) / quality_rules.BINS_PER_UNIT) / quality_rules.CHI_KEEP)
        assert np.allclose([got[i] for i in ids], d / wider, rtol=1e-7)
        if len(ids) > 10:
            assert all((got[i] > quality_rules.CUT) == (k < len(ids) // 7) for k, i in enumerate(ids))
            many = min((numpy_step(x, numpy_step(x, numpy_step(x, ((x - c) ** 2).sum(1))[3])[3])[4] for c in x[:50]))
            assert log_det <= many + 0.3


def test_planted_outliers_of_small_and_large_cells_go(spark):
    rng = random.Random(21)
    clean = lambda n: "\n".join(prose(rng, 12) for _ in range(n))
    rows = []
    for lang, n in (("en", 120), ("de", 60), ("tr", 8)):
        for k in range(n):
            text = clean(6)
            if k == 0:
                text += " #$%&*|<> " * 12  # symbols
            if k == 1:
                text = "\n".join([prose(rng, 12) for _ in range(4)] + ["same line"] * 9 + [prose(rng, 30)])  # repeated short lines
            rows.append((len(rows), text, lang, "s", k < 2))
    rows.append((len(rows), "w " + "longword" * 4000 + " " + clean(1), None, None, False))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, planted boolean").withColumn("cell", F.lit("clash"))
    got = {r.doc_id: r for r in quality_rules.judge(frame).collect()}
    assert all(got[i].kept != planted for i, _, _, _, planted in rows)


def test_toxic_sentences_are_found():
    rng = random.Random(10)
    texts, labels = [], []
    for i in range(400):
        sentences = [prose(rng, 8) + "." for _ in range(6)]
        if i % 4 == 0:
            sentences[rng.randrange(6)] = f"you {rng.choice(['nastyx', 'vilex', 'foulx'])} thing {prose(rng, 4)}."
        texts.append(" ".join(sentences))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts[:300], labels[:300])
    assert np.mean([(model.score(t) >= 0.7) == y for t, y in zip(texts[300:], labels[300:], strict=True)]) > 0.97
    text = "w1 w2 w3. You vilex thing w4 w5 w6. w7 w8 w9."
    (start, end, p), = model.offending(text)
    assert text[start:end] == "You vilex thing w4 w5 w6." and p > 0.5
    noisy = 1 - np.prod(1 - model.sentence_scores(text))
    assert abs(noisy - model.score(text)) < 1e-9
    assert model.score(None) == model.score("") == 0.0
    assert toxicity.fit([], []).score("x") == 0.0 and toxicity.fit(["a"], [1]).score("x") == 1.0


def plain_sentences(text):
    """Sentences as lists of lower-cased tokens, by a loop."""
    out, now = [], []
    for token in text.lower().replace("\n", " . ").split():
        now.append(token)
        if any(c in token for c in ".!?"):
            out.append(now)
            now = []
    return [*out, now] if now else out


def test_noisy_or_gradient_and_offsets_equal_plain_loops():
    rng = random.Random(32)
    texts = ["see www.bad.com now. Fine\n\nnext nasty line\nend", "İstanbul NASTY. x!y z?\t tail", ". \n .", "nasty", " "] + [
        prose(rng, 20).replace("w7", "nasty.") for _ in range(8)
    ]
    labels = [1, 1, 0, 1, 0] + [i % 2 for i in range(8)]
    seen = {}
    bags = [toxicity.sentence_cells(t, seen) for t in texts]
    w = np.zeros(toxicity.FEATURES)
    cells = np.unique(np.concatenate([c for c, _ in bags]))
    w[cells] = np.random.default_rng(2).uniform(0, 1, len(cells))
    y, share = np.array(labels), np.random.default_rng(3).uniform(0.1, 1, len(labels))
    value, grad, up = toxicity.noisy_or_gradient(bags, y, share, w, -1.5)

    def plain(weights, bias):
        total = 0.0
        for t, k, s in zip(texts, labels, share, strict=True):
            miss = 1.0
            for sentence in plain_sentences(t):
                found = {toxicity.cell_of(x) for token in sentence for x in toxicity.feature_names(token)}
                if (z := sum(weights[c] for c in found)) > 0:
                    miss *= 1 - 1 / (1 + np.exp(-z - bias))
            total += s * np.log(max(1 - miss if k else miss, 1e-300))
        return total

    assert abs(value - plain(w, -1.5)) < 1e-9
    for c in cells[:: max(1, len(cells) // 12)]:
        more, less = w.copy(), w.copy()
        more[c] += 1e-5
        less[c] -= 1e-5
        assert abs((plain(more, -1.5) - plain(less, -1.5)) / 2e-5 - grad[c]) < 1e-5
    assert abs((plain(w, -1.5 + 1e-5) - plain(w, -1.5 - 1e-5)) / 2e-5 - up) < 1e-5
    model = toxicity.ToxicityModel({x: float(w[toxicity.cell_of(x)]) for t in texts for token in toxicity.tokens(t) for x in toxicity.feature_names(token)}, -1.5)
    for t in texts:
        scores = model.sentence_scores(t)
        spans = list(toxicity.sentence_spans(t))
        assert len(spans) == len(scores) - 1 == len(plain_sentences(t))
        for (start, end), sentence in zip(spans, plain_sentences(t), strict=True):
            assert t[start:end].lower().split() == [x for x in sentence if x != "."] or t[start:end].lower().split() == sentence
        assert [p for _, _, p in model.offending(t, 0.0)] == [p for p in scores[:-1] if p > 0]
    assert [texts[0][a:b] for a, b, _ in model.offending(texts[0], 0.0)][0] == "see www.bad.com"


def test_long_texts_are_located_across_pieces(monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 40)
    model = toxicity.ToxicityModel({(0, "nasty"): 9.0}, -3.0)
    text = " ".join(["fine words here."] * 30 + ["so nasty thing."] + ["fine words here."] * 30)
    spans = model.offending(text)
    assert len(spans) == 1 and "nasty" in text[spans[0][0] : spans[0][1]]


def test_held_out_documents_are_told_apart(spark):
    """Through the queries' own operators, over whole tables of the driver's smallest data."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    truth = {r.doc_id: r for r in labels.collect()}

    def auc(rows, label):
        pairs = [(r.score, truth[r.doc_id][label]) for r in rows if r.held_out and r.doc_id in truth]
        up, down = [s for s, k in pairs if k == 1], [s for s, k in pairs if k == 0]
        return np.mean([(a > b) + (a == b) / 2 for a in up for b in down])

    assert auc(toxicity.score_documents(docs, labels).collect(), "toxic") > 0.85
    assert auc(quality_cnn.score_documents(docs, labels).collect(), "quality") > 0.95
    named = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    assert named.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def test_network_gradients_equal_finite_differences_and_scores_plain_loops():
    rng = np.random.default_rng(33)
    net = quality_cnn.ByteNet(rng.normal(0, 0.3, (quality_cnn.WIDTH, 256, quality_cnn.FILTERS)), rng.normal(0, 0.1, quality_cnn.FILTERS), rng.normal(0, 0.5, 2 * quality_cnn.FILTERS), 0.1)
    texts = ["", "abc", prose(random.Random(1), 300), "é" * 700, "the end. " * 90]
    y, share = np.array([1, 0, 1, 0, 1]), rng.uniform(0.1, 1, 5)
    docs = [quality_cnn.chunked(t.encode()) for t in texts]

    def plain(t):
        data = t.encode()
        tops = []
        for rows in [quality_cnn.chunked(data)]:
            for row in rows:
                z = [max(sum(net.tables[j][row[i + j]][f] for j in range(quality_cnn.WIDTH)) for i in range(quality_cnn.STEP)) for f in range(3)]
                tops.append([max(0.0, v + net.offset[f]) for f, v in enumerate(z)])
        return np.array(tops)

    for t, d in zip(texts[:3], docs, strict=False):
        assert np.allclose(net.pooled(d)[:, :3], plain(t))
    whole = [np.concatenate([net.pooled(d).mean(0), net.pooled(d).max(0)]) @ net.out + net.bias for d in docs]
    assert np.allclose(net.score(texts), 1 / (1 + np.exp(-np.array(whole))))

    def loss():
        return quality_cnn.loss_gradient(net, np.concatenate(docs), np.array([len(d) for d in docs]), y, share)

    _, tables, offset, out, bias = loss()
    for values, grads in ((net.tables, tables), (net.offset, offset), (net.out, out)):
        flat, found = values.reshape(-1), grads.reshape(-1)
        for k in np.argsort(-np.abs(found))[:6].tolist() + [0]:
            flat[k] += 1e-6
            high = loss()[0]
            flat[k] -= 2e-6
            low = loss()[0]
            flat[k] += 1e-6
            assert abs((high - low) / 2e-6 - found[k]) < 1e-4 * max(1, abs(found[k]))
    net.bias += 1e-6
    high = loss()[0]
    net.bias -= 2e-6
    assert abs((high - loss()[0]) / 2e-6 - bias) < 1e-5
    # chunks cover every window of bytes
    data = texts[2].encode()
    held = b"|".join(r.tobytes() for r in quality_cnn.chunked(data))
    assert all(data[i : i + quality_cnn.WIDTH] in held for i in range(len(data) - quality_cnn.WIDTH + 1))


def test_byte_network_learns_and_scores_batches_alike():
    rng = random.Random(11)
    texts = [prose(rng, 60) for _ in range(160)]
    labels = [1] * 80 + [0] * 80
    texts[80:] = [t.upper().replace(" ", "!! ") for t in texts[80:]]
    order = rng.sample(range(160), 160)
    net = quality_cnn.fit([texts[i] for i in order[:120]], [labels[i] for i in order[:120]], rounds=20)
    got = net.score([texts[i] for i in order[120:]])
    assert np.mean((got >= 0.5) == [labels[i] for i in order[120:]]) > 0.95
    long = " ".join(texts[:40])
    one_by_one = np.concatenate([net.score([t]) for t in [long, "", None, "x"]])
    assert np.allclose(one_by_one, net.score([long, "", None, "x"]))


def plain_cells(text, buckets=langid.BUCKETS):
    """Cells of all n-grams by loops over characters."""
    out, points = [], [ord(c) for c in text.lower()]
    for n in langid.ORDERS:
        for i in range(len(points) - n + 1):
            h = 0
            for x in points[i : i + n]:
                h = ((h ^ x) * 0x01000193) & 0xFFFFFFFF
                h ^= h >> 15
            out.append((((h + n) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - (buckets.bit_length() - 1)))
    return out


def test_languages_equal_a_dense_model(spark):
    rng = random.Random(12)
    letters = {"aa": "abcde", "bb": "fghij", "ru": "абвгдеж", "uk": "абвгдеїє", "zh": "的一是不了人我", "ja": "のにはをたがで的人"}
    word = lambda x: "".join(rng.choice(letters[x]) for _ in range(6))
    rows = [(i, " ".join(word(k) for _ in range(20)), k) for i, k in enumerate(list(letters) * 40)]
    rows += [(900, None, "aa"), (901, "12 34 !", "aa"), (902, "", None), (903, "abcde abcde", None), (904, "Ї" * 30, None), (905, "的", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify(frame).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:240]) and got[903].lang_pred == "aa" and got[904].lang_pred == "uk"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert all(got[i].held_out == (crc32(str(i).encode()) % 5 == 0) for i in got)
    learnt = [(t, k) for i, t, k in rows if t is not None and k is not None and crc32(str(i).encode()) % 5 != 0]
    order = sorted(letters)
    table = np.full((langid.BUCKETS, len(order)), 0.5)
    for t, k in learnt:
        np.add.at(table[:, order.index(k)], plain_cells(t), 1)
    logs = np.log(table / table.sum(0))
    model = langid.train(frame, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    assert model.langs == order and np.allclose(model.log_prob, logs, atol=1e-4)
    prior = np.log([sum(k == x for _, k in learnt) + (x == "aa" and crc32(b"900") % 5 != 0) * 0 for x in order])
    for i, t, _ in rows:
        if got[i].lang_pred != "und":
            cells = plain_cells(t)
            z = (logs[cells].sum(0) + prior) * min(1.0, langid.EVIDENCE / len(cells))
            z = np.exp(z - z.max())
            assert order[int(z.argmax())] == got[i].lang_pred and abs(z.max() / z.sum() - got[i].score) < 1e-3
    assert langid.identify(frame.limit(0)).count() == 0
    with pytest.raises(ValueError, match="over 3 values of lang"):
        langid.train(frame, F.lit(True), most_langs=3)


def test_language_blocks_cover_every_ngram_once(monkeypatch):
    model = langid.LanguageModel(["x", "y"], np.random.default_rng(1).normal(size=(langid.BUCKETS, 2)).astype(np.float32), np.zeros(2))
    texts = [prose(random.Random(13), 800), "a b", "é", "x" * 301]
    whole = model.score(texts)
    for size in (100, 7):
        monkeypatch.setattr(langid, "BLOCK", size)
        again = model.score(texts)
        assert whole[0] == again[0] and np.allclose(whole[1], again[1])
        for t in texts:
            cells = np.concatenate([langid.ngram_cells(b, k == 0) for k, b in enumerate(langid.code_points(t))])
            assert sorted(cells.tolist()) == sorted(plain_cells(t))


def test_learned_stages_keep_columns_and_take_extremes(spark):
    rng = random.Random(14)
    texts = [prose(rng, 30) for _ in range(60)] + [None, "", "9 9", "w1 " * 200_000]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and 58 <= kept.count() <= 61
    clean = toxicity.drop_toxic(docs, labels.where("doc_id < 0"))
    assert clean.columns == docs.columns and clean.count() == 64
    scored = toxicity.score_documents(docs, labels).collect()
    assert len(scored) == 64 and all(0 <= r.score <= 1 for r in scored)
    rated = quality_cnn.score_documents(docs, labels).collect()
    assert len(rated) == 64 and all(r.predicted == int(r.score >= 0.5) for r in rated)
    toxicity.offending_sentences(docs, labels).collect()


def test_long_texts_and_missing_documents_leave_the_sample_whole(spark):
    rng = random.Random(15)
    texts = [prose(rng, 20) + f". you {'nastyx thing. ' if i % 2 else 'fine thing. '}" + prose(rng, 6000) for i in range(60)]
    assert min(map(len, texts)) > 20_000
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(i, i % 2, i % 2) for i in range(1000, 6000)], "doc_id long, quality int, toxic int")
    learn = F.lit(True)
    model = toxicity.train(docs, labels, learn, 20)
    assert model.constant is None and model.score("you nastyx thing.") >= 0.5 > model.score("you fine thing.")
    assert quality_cnn.train(docs, labels, learn, 20).constant is None
    for n in (20, 100):
        rows, _ = common.labelled_sample(docs, labels, "toxic", n, 20_000, learn)
        assert sorted(r.label for r in rows.collect()) == [0] * min(n, 30) + [1] * min(n, 30)
    assert common.longest_fit([3, 50, 9], 100) == 50 and common.longest_fit([3, 50, 90], 60) == 28 and common.longest_fit([], 5) == 0
    assert common.whole_sentences("a b. c d", 7) == "a b." and common.whole_sentences("ab cd", 4) == "ab" and common.whole_sentences("abcd", 2) == "ab"
