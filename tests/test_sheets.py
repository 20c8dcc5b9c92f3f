"""Spreadsheets put together by hand from their parts."""

from __future__ import annotations

import datetime
import zipfile

import pytest
from tessera.sources import sheets

MAIN, REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write(path, lines, sheet="Altın"):
    shared: list[str] = []

    def cell(row, column, value):
        at = f"{'ABCDEFGH'[column]}{row}"
        if isinstance(value, datetime.date):
            return f'<c r="{at}" s="1"><v>{(value - datetime.date(1899, 12, 30)).days}</v></c>'
        if isinstance(value, str) and value.startswith("="):
            return f'<c r="{at}" t="inlineStr"><is><t>{value[1:]}</t></is></c>'
        if isinstance(value, str):
            shared.append(value)
            return f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>'
        return f'<c r="{at}"><v>{value}</v></c>'

    body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(values) if v is not None) + "</row>" for r, values in lines.items())
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>" for s in shared) + "</sst>")


def test_sheets_become_typed_records(spark, tmp_path):
    head = ["id", "oran", "bitis", "kitle", None, "not"]
    write(tmp_path / "a.xlsx", {
        1: head, 2: ["açıklama"], 3: ["K-1", 1.89, datetime.date(2026, 8, 31), "herkes", "başlıksız", None], 4: ["K-2", "%2", "31.08.2026", None, None, "=metin"], 5: [None, 3],
        6: ["  "], 7: [], 8: ["K-1", "2.5", "2026-01-02", " ", None, None],
    })
    write(tmp_path / "b.xlsx", {1: head, 3: ["K-3"]})
    cells = sheets.rows(spark, str(tmp_path), "Altın")
    got = sheets.records(cells, "id", ["oran"], ["bitis"], ["oran", "kitle"], ["kitle", "not"]).collect()
    day = datetime.date
    assert sorted(((r.id, r.oran, r.bitis, r.kitle, r["not"], r.missing, r.wrong, r.repeated) for r in got), key=str) == sorted([
        ("K-1", 1.89, day(2026, 8, 31), "herkes", None, [], [], True), ("K-1", 2.5, day(2026, 1, 2), None, None, ["kitle"], [], True),
        ("K-2", None, None, None, "metin", ["kitle"], ["oran", "bitis"], False), ("K-3", None, None, None, None, ["oran", "kitle"], [], False),
    ], key=str)
    with pytest.raises(Exception, match="no sheet"):
        sheets.rows(spark, str(tmp_path), "Yok").collect()
    (tmp_path / "empty").mkdir()
    write(tmp_path / "empty" / "c.xlsx", {1: head})
    assert sheets.rows(spark, str(tmp_path / "empty"), "Altın").count() == 0
