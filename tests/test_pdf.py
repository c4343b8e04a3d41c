"""The PDF reader on files made here."""

import zlib

import pytest
from pyspark.sql import functions as F

from foliospark.functions.text import signature
from foliospark.operators import geometry, tables
from foliospark.sources import pdf


def make(pages, fonts="/F1 5 0 R", extra=()):
    """A file with one content stream per page."""
    parts = [b"%PDF-1.4\n"]
    kids = " ".join(f"{20 + 2 * i} 0 R" for i in range(len(pages)))
    objects = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /MediaBox [0 0 600 800] /Resources << /Font << {fonts} >> >> >>", 5: "<< /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+TimesNewRomanPS-BoldMT /FirstChar 32 /Widths [250] >>"}
    for number, body in objects.items():
        parts.append(f"{number} 0 obj\n{body}\nendobj\n".encode())
    for i, content in enumerate(pages):
        data = zlib.compress(content.encode("latin-1"))
        parts.append(f"{20 + 2 * i} 0 obj << /Type /Page /Parent 2 0 R /Contents {21 + 2 * i} 0 R >> endobj\n".encode())
        parts.append(f"{21 + 2 * i} 0 obj << /Filter /FlateDecode /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream endobj\n")
    return b"".join([*parts, *extra, b"%%EOF"])


def text(at, words, size=10):
    return f"BT /F1 {size} Tf {at[0]} {at[1]} Td ({words}) Tj ET\n"


def test_lines():
    content = text((50, 700), "second line") + text((50, 750), "first") + text((80, 750), "line") + text((200, 750), "tabbed") + text((50, 650), r"a \(b\) \101")
    content += "q 1 0 0 1 10 0 cm BT /F1 10 Tf 1 0 0 1 50 600 Tm 12 TL [(kern) -20 (ed) -900 (apart)] TJ T* (next) Tj ET Q"
    got = pdf.read_bytes(make([content]))
    assert got["error"] is None
    page = got["pages"][0]
    assert [x["text"] for x in page["lines"]] == ["first line\ttabbed", "second line", "a (b) A", "kerned apart", "next"]
    assert page["lines"][0]["y"] == 50 and page["lines"][3]["x0"] == 60 and (page["lines"][0]["font"], page["lines"][0]["bold"]) == ("Times New Roman", True)


def test_unicode_maps_and_object_streams():
    cmap = b"1 beginbfchar <0001> <00E9> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange"
    assert pdf.unicode_map(cmap) == {1: "é", 2: "a", 3: "b", 4: "c"}
    packed = zlib.compress(b"5 0 << /Type /Font /Subtype /Type0 /BaseFont /Arial /ToUnicode 9 0 R /DescendantFonts [8 0 R] >>")
    raw = make(["BT /F1 10 Tf 50 700 Td <000100020003> Tj ET"], extra=(
        b"7 0 obj << /Type /ObjStm /N 1 /First 4 /Filter /FlateDecode /Length %d >>\nstream\n" % len(packed) + packed + b"\nendstream endobj\n",
        b"8 0 obj << /DW 500 /W [1 [250 300] 3 9 400] >> endobj\n", b"9 0 obj << /Length %d >>\nstream\n" % len(cmap) + cmap + b"\nendstream endobj\n",
    )).replace(b"5 0 obj\n<< /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+TimesNewRomanPS-BoldMT /FirstChar 32 /Widths [250] >>\nendobj\n", b"")
    line = pdf.read_bytes(raw)["pages"][0]["lines"][0]
    assert line["text"] == "éab" and line["x1"] - line["x0"] == pytest.approx(9.5)


def test_refusals():
    assert pdf.read_bytes(b"plain")["error"] == "not a PDF"
    assert "password" in pdf.read_bytes(make([""]) + b"trailer << /Encrypt 3 0 R >>")["error"]
    assert pdf.read_bytes(b"%PDF-1.4 nothing")["error"] == "ValueError: no catalog"


@pytest.mark.parametrize(("name", "font"), [("ABCDEF+TimesNewRomanPS-BoldItalicMT", ("Times New Roman", True, True)), ("SegoeUI", ("Segoe UI", False, False)), ("Calibri,Bold", ("Calibri", True, False)), ("", ("Unknown", False, False)), ("Courier_New2Oblique", ("Courier New 2", False, True)), ("Bold", ("Bold", False, False)), ("Foo-SemiBoldCond", ("Foo Semi Cond", True, False)), ("Univers-LTStd", ("Univers LT Std", False, False))])
def test_font_names(name, font):
    assert pdf.split_font(name) == font


def test_predictors():
    rows = [[10, 20, 30], [12, 25, 28], [200, 3, 90], [7, 7, 7], [250, 1, 128]]
    raw, last = b"", [0, 0, 0]
    for kind, row in enumerate(rows):
        corner = lambda k: last[k - 1] if k else 0
        left = lambda k: row[k - 1] if k else 0
        near = lambda k: min((left(k), last[k], corner(k)), key=lambda x: abs(left(k) + last[k] - corner(k) - x))
        guess = [lambda k: 0, left, lambda k: last[k], lambda k: (left(k) + last[k]) // 2, near][kind]
        raw += bytes([kind, *((row[k] - guess(k)) % 256 for k in range(3))])
        last = row
    assert pdf._unpredicted(raw, 3) == bytes(sum(rows, []))


def test_furniture(spark, tmp_path):
    pages = [text((50, 780), "Contract of sale") + text((50, 400), f"body {chr(97 + i)} text") + text((300, 15), f"Page {i + 1} of 4") + text((50, 750), f"opening {chr(97 + i)} words") for i in range(4)]
    (tmp_path / "x.pdf").write_bytes(make(pages))
    lines = pdf.page_lines(pdf.read(spark, str(tmp_path)))
    found = pdf.furniture(lines, signature(F.col("text"))).join(lines, ["path", "page", "line"])
    assert sorted({r.text for r in found.collect()}) == ["Contract of sale", "Page 1 of 4", "Page 2 of 4", "Page 3 of 4", "Page 4 of 4"]


def test_titles_are_not_furniture(spark, tmp_path):
    """Numbered titles that start pages of their own, and a line repeated where other pages begin their text."""
    words = ["one", "two", "three", "four", "five", "six", "seven"]
    pages = [text((50, 780), f"SCHEDULE {i // 2}.{9 - i}") + text((50, 730), "Signature page" if i < 3 else f"opening {words[i]}") + text((50, 400), f"body {words[i]}") + text((300, 15), f"Part 2, sheet {i + 1}") for i in range(7)]
    (tmp_path / "x.pdf").write_bytes(make(pages))
    lines = pdf.page_lines(pdf.read(spark, str(tmp_path)))
    found = pdf.furniture(lines, signature(F.col("text"))).join(lines, ["path", "page", "line"])
    assert sorted(r.text for r in found.collect()) == [f"Part 2, sheet {i + 1}" for i in range(7)]


def line(y, words, x0=50.0, x1=500.0, page=1, size=10.0):
    return {"page": page, "y": float(y), "x0": x0, "x1": x1, "size": size, "text": words}


def test_paragraphs():
    found = [
        line(100, "first line of a", x1=499), line(112, "paragraph that is con-"), line(124, "tinued here", x1=200), line(136, "another one", x1=480),
        line(160, "after a gap", x1=495), line(100, "and over the page", page=2, x1=300), line(112, "• a point", page=2, x1=498), line(124, "big", page=2, size=14.0),
    ]
    assert [(p["page"], p["text"]) for p in pdf.paragraphs(found)] == [(1, "first line of a paragraph that is continued here"), (1, "another one"), (1, "after a gap and over the page"), (2, "• a point"), (2, "big")]
    assert pdf.paragraphs([]) == []


def test_units_of_files(spark, tmp_path):
    pages = [text((50, 780), "Running head") + "".join(text((50, 600 - 12 * k), f"page {i} line {k} " + "x" * 60) for k in range(3)) for i in range(3)]
    (tmp_path / "x.pdf").write_bytes(make(pages))
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4")
    got = {r.path.rpartition("/")[2]: r.units for r in pdf.unit_lists(pdf.read(spark, str(tmp_path)), signature(F.col("text"))).collect()}
    assert got["bad.pdf"] == [] and len(got["x.pdf"]) == 1 and "Running" not in got["x.pdf"][0] and got["x.pdf"][0].count("line 2") == 3


def tabbed(y, *pieces, size=10.0, page=1):
    return {"page": page, "y": float(y), "x0": pieces[0][0], "x1": pieces[-1][0] + 40.0, "size": size, "text": "\t".join(t for _, t in pieces), "cols": [{"x0": x, "x1": x + 40.0} for x, _ in pieces]}


def plain(y, x, text, page=1):
    return {"page": page, "y": float(y), "x0": x, "x1": x + 200.0, "size": 10.0, "text": text, "cols": []}


ROWS = [tabbed(100, (50.0, "Name"), (150.0, "Amount")), tabbed(115, (50.0, "Rent"), (151.0, "100")), plain(127, 150.0, "per month"), tabbed(142, (49.0, "Fee"), (150.0, "20"))]


def test_tables_without_rules():
    lines = [plain(80, 50.0, "before"), *ROWS, plain(160, 50.0, "after")]
    (table,) = tables.find(lines)
    assert [[[x["text"] for x in cell] for cell in row] for row in table.cells()] == [[["Name"], ["Amount"]], [["Rent"], ["100", "per month"]], [["Fee"], ["20"]]]
    xs, ys = table.edges()
    assert xs == pytest.approx([149 / 3 - 5.4, 451 / 3 - 5.4, 355.4]) and ys == pytest.approx([90.0, 104.0, 131.0, 145.0])
    assert len(tables.find([tabbed(100 + 12 * i, (50.0, "A thing"), (180.0, str(i))) for i in range(3)])) == 1
    assert [p["text"] for p in pdf.paragraphs(tables.with_cells(lines))] == ["before", "Name", "Amount", "Rent", "100 per month", "Fee", "20", "after"]


@pytest.mark.parametrize(
    "lines",
    [
        ROWS[:3],
        [tabbed(100 + 12 * i, (50.0, f"{i}."), (80.0, "item")) for i in range(4)],
        [tabbed(100 + 12 * i, (50.0, "B"), (80.0, "item")) for i in range(4)],
        [tabbed(100 + 12 * i, (50.0, "Part ....."), (180.0, str(i))) for i in range(4)],
        [tabbed(100 + 30 * i, (50.0, "far"), (180.0, "apart")) for i in range(4)],
        [tabbed(100 + 12 * i, (50.0, "not"), (180.0 + 9 * i, "aligned")) for i in range(4)],
        [],
    ],
)
def test_no_tables(lines):
    assert tables.find(lines) == [] and tables.with_cells(lines) == lines


def test_table_cells_of_files(spark, tmp_path):
    rows = "".join(text((50, 600 - 14 * k), f"left{k}") + text((250, 600 - 14 * k), f"right{k}") for k in range(3))
    (tmp_path / "x.pdf").write_bytes(make([text((50, 700), "A heading of the page") + rows]))
    files = pdf.read(spark, str(tmp_path))
    found = tables.table_cells(pdf.page_lines(files), ["path", "page"]).orderBy("row", "col").collect()
    assert [(r.table, r.row, r.col, r.text) for r in found] == [(0, k, c, f"{side}{k}") for k in range(3) for c, side in enumerate(("left", "right"))]
    assert pdf.unit_lists(files, signature(F.col("text"))).first().units == ["A heading of the page", "left0", "right0", "left1", "right1", "left2", "right2"]


def test_ruled_tables(spark, tmp_path):
    """Two rows of two columns; the first row's fields are one cell, and one border is a thin filled box."""
    edges = "50 700 200 0.5 re f 50 680 m 250 680 l S 50 660 m 250 660 l S 50 660 m 50 700 l 250 700 m 250 660 l S 150 660 m 150 680 l S 10 10 m 90 90 l S "
    words = text((60, 686), "both columns") + text((60, 666), "left") + text((160, 666), "right") + text((50, 740), "above") + text((50, 600), "below")
    (tmp_path / "x.pdf").write_bytes(make([edges + words]))
    got = pdf.read_bytes((tmp_path / "x.pdf").read_bytes())["pages"][0]
    assert len(got["rules"]) == 6 and {(r["y0"], r["y1"]) for r in got["rules"] if r["y0"] == r["y1"]} == {(99.75, 99.75), (120.0, 120.0), (140.0, 140.0)}
    assert [(x["text"], x["grid"], x["grid_cell"]) for x in got["lines"]] == [("above", None, None), ("both columns", 0, 0), ("left", 0, 1), ("right", 0, 2), ("below", None, None)]
    (grid,) = geometry.grids(got["rules"])
    assert [(c["row"], c["col"], c["rows"], c["cols"]) for c in geometry.cells(grid, got["rules"])] == [(0, 0, 1, 2), (1, 0, 1, 1), (1, 1, 1, 1)]
    files = pdf.read(spark, str(tmp_path))
    assert pdf.unit_lists(files, signature(F.col("text"))).first().units == ["above", "both columns", "left", "right", "below"]


def test_forms_are_drawn_in_place():
    inner = (text((0, 0), "in a form") + "0 0 m 100 0 l S").encode()
    form = f"60 0 obj << /Type /XObject /Subtype /Form /Matrix [1 0 0 1 40 500] /Length {len(inner)} >>\nstream\n".encode() + inner + b"\nendstream endobj\n"
    page = make(["q 1 0 0 1 10 0 cm /X1 Do Q " + text((50, 400), "after")], fonts="/F1 5 0 R >> /XObject << /X1 60 0 R", extra=[form])
    got = pdf.read_bytes(page)["pages"][0]
    assert [(x["text"], x["x0"], x["y"]) for x in got["lines"]] == [("in a form", 50.0, 300.0), ("after", 50.0, 400.0)]
    assert got["rules"] == [{"x0": 50.0, "y0": 300.0, "x1": 150.0, "y1": 300.0}]
