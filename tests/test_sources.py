"""Word documents, the DataFrame comparison over them, and the streaming extension."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from foliospark.operators import compare as C
from foliospark.operators import ranges, report, similarity, threads
from foliospark.sources import docx, files
from foliospark.streaming import versions
from test_pdf import make as pdf_file, text as drawn

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" xmlns:w15="http://schemas.microsoft.com/office/word/2012/wordml" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def p(text, ppr="", extra=""):
    return f"<w:p><w:pPr>{ppr}</w:pPr><w:r><w:t>{text}</w:t></w:r>{extra}</w:p>"


def package(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        for name, text in parts.items():
            folder = "docProps" if name == "core" else "word/_rels" if name == "rels" else "word"
            z.writestr(f"{folder}/{'document.xml.rels' if name == 'rels' else name + '.xml'}", text)
    return out.getvalue()


LISTS = f"""<w:numbering {NS}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl>
<w:lvl w:ilvl="1"><w:numFmt w:val="lowerRoman"/><w:lvlText w:val="%1.%2"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>"""


def item(text, level=0):
    return p(text, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="1"/></w:numPr>')


def test_units_markers_tables_and_notes():
    body = item("one") + item("sub", 1) + item("sub too", 1) + item("two") + item("again", 1) + p("", "")
    body += "<w:tbl>" + "".join(f"<w:tr>{''.join(f'<w:tc>{p(f'c{r}{c}')}</w:tc>' for c in range(2))}</w:tr>" for r in range(2)) + "</w:tbl>"
    body += p("noted", "", '<w:r><w:footnoteReference w:id="2"/></w:r>') + p("noted again", "", '<w:r><w:footnoteReference w:id="2"/></w:r>')
    body += "<w:p><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:rPr><w:b/></w:rPr><w:t>kept </w:t></w:r><w:r><w:t>  text</w:t></w:r></w:ins></w:p>"
    notes = f'<w:footnotes {NS}><w:footnote w:id="0" w:type="separator">{p("-")}</w:footnote><w:footnote w:id="2">{p("the note")}</w:footnote></w:footnotes>'
    got = docx.read_bytes(package(body, numbering=LISTS, footnotes=notes))
    assert got["error"] is None and got["n_revisions"] == 2
    units = got["units"]
    assert [(u["text"], u["marker"]) for u in units[:5]] == [("one", "1."), ("sub", "1.i"), ("sub too", "1.ii"), ("two", "2."), ("again", "2.i")]
    assert [(u["text"], u.get("ti"), u.get("ri"), u.get("ci")) for u in units[5:9]] == [("c00", 0, 0, 0), ("c01", 0, 0, 1), ("c10", 0, 1, 0), ("c11", 0, 1, 1)]
    assert [(u["text"], u["stream"]) for u in units[9:]] == [("noted", "body"), ("the note", "footnote"), ("noted again", "body"), ("kept text", "body")]
    assert units[-1]["bold"] == [{"s": 0, "e": 5}]


def test_headers_styles_comments_and_facts():
    rels = '<Relationships xmlns="x"><Relationship Id="r1" Target="header1.xml"/><Relationship Id="r2" Target="footer1.xml"/></Relationships>'
    section = '<w:sectPr><w:headerReference w:type="default" r:id="r1"/><w:footerReference w:type="default" r:id="r2"/></w:sectPr>'
    styles = f'<w:styles {NS}><w:style w:styleId="Base" w:type="paragraph"><w:pPr><w:jc w:val="both"/></w:pPr></w:style><w:style w:styleId="Sub" w:type="paragraph"><w:basedOn w:val="Base"/></w:style></w:styles>'
    comments = f'<w:comments {NS}><w:comment w:id="0" w:author="A" w:date="d"><w:p w14:paraId="P0"><w:r><w:t>why?</w:t></w:r></w:p></w:comment><w:comment w:id="1" w:author="B"><w:p w14:paraId="P1"><w:r><w:t>so</w:t></w:r></w:p></w:comment></w:comments>'
    extended = f'<w15:commentsEx {NS}><w15:commentEx w15:paraId="P1" w15:paraIdParent="P0" w15:done="1"/></w15:commentsEx>'
    core = '<c xmlns:dcterms="http://purl.org/dc/terms/"><dcterms:modified>2024-05-01T10:00:00Z</dcterms:modified></c>'
    body = p("first", '<w:pStyle w:val="Sub"/>') + '<w:p><w:commentRangeStart w:id="0"/><w:r><w:t>second</w:t></w:r></w:p>' + section
    got = docx.read_bytes(package(body, rels=rels, styles=styles, comments=comments, commentsExtended=extended, core=core, header1=f"<w:hdr {NS}>{p('top')}</w:hdr>", footer1=f"<w:ftr {NS}>{p(' ')}</w:ftr>"))
    assert [(u["text"], u["stream"], u["align"]) for u in got["units"]] == [("first", "body", "justify"), ("second", "body", "left"), ("top", "header", "left")]
    assert [(c["id"], c["text"], c["parent"], c["done"], c["row"]) for c in got["comments"]] == [("0", "why?", None, False, 1), ("1", "so", "0", True, None)]
    assert got["saved"] == dt.datetime(2024, 5, 1, 10, tzinfo=dt.timezone.utc)


def run(text, rpr=""):
    return f"<w:r><w:rPr>{rpr}</w:rPr><w:t>{text}</w:t></w:r>"


def test_formats_and_properties():
    styles = f'''<w:styles {NS}><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Calibri"/><w:sz w:val="24"/></w:rPr></w:rPrDefault><w:pPrDefault><w:pPr><w:spacing w:after="160" w:line="259" w:lineRule="auto"/></w:pPr></w:pPrDefault></w:docDefaults>
    <w:style w:styleId="Heading2" w:type="paragraph"><w:name w:val="heading 2"/><w:pPr><w:spacing w:before="240" w:line="300" w:lineRule="exact"/><w:keepNext/></w:pPr><w:rPr><w:i/></w:rPr></w:style></w:styles>'''
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading2"/><w:ind w:left="720"/></w:pPr>{run("plain ")}{run(" bold", "<w:b/>")}{run(" red", "<w:color w:val=&quot;FF0000&quot;/>".replace("&quot;", chr(34)))}</w:p>'
    body += '<w:p><w:r><w:br w:type="page"/></w:r></w:p>' + p("after") + f'<w:p>{run("end")}<w:r><w:br w:type="page"/></w:r></w:p>' + p("next")
    units = docx.read_bytes(package(body, styles=styles))["units"]
    first = units[0]
    assert (first["text"], first["heading"], first["bold"]) == ("plain bold red", 2, [{"s": 5, "e": 10}])
    assert [(f["s"], f["e"], f["b"], f["i"], f["f"], f["z"], f["clr"]) for f in first["formats"]] == [(0, 5, False, True, "Calibri", 12.0, None), (5, 10, True, True, "Calibri", 12.0, None), (10, 14, False, True, "Calibri", 12.0, "ff0000")]
    got = first["props"]
    assert (got["ind_left"], got["space_before"], got["space_after"], got["line_spacing"], got["line_exact"], got["keep_next"]) == (36.0, 12.0, 8.0, None, 15.0, True)
    assert [u["props"]["page_break"] for u in units] == [False, True, False, True]


def test_flat_records_and_format_rows(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(package(f"<w:p>{run('same words')}</w:p>"))
    (tmp_path / "b.docx").write_bytes(package(f"<w:p>{run('same ')}{run('words', '<w:b/>')}</w:p>"))
    files = docx.read(spark, str(tmp_path))
    flat = docx.flat_records(files).orderBy("path").first()
    assert len(flat) == 23 and flat.text == "same words" and flat.lineSpacing is None and '"isNumbered":false' in flat.json
    side = lambda s: files.filter(F.col("path").endswith(f"{s}.docx")).select(F.lit(1).alias("k"), F.col("path").alias(s), F.col("units").alias(f"units_{s}"))
    row = C.compare(side("a").join(side("b"), "k")).first()
    assert row.type == "equal" and [tuple(f) for f in row.fmt] == [(5, 10, "bold added")] and [(s.t, s.b) for s in row.segments] == [("same ", False), ("words", True)]


def test_damaged_files(spark, tmp_path):
    (tmp_path / "good.docx").write_bytes(package(p("fine")))
    (tmp_path / "bad.docx").write_bytes(b"PK\x03\x04 rest is missing")
    (tmp_path / "odd.txt").write_bytes(b"plain")
    (tmp_path / "paper.pdf").write_bytes(b"junk%PDF-1.4")
    rows = {r.path.rpartition("/")[2]: r for r in docx.read(spark, str(tmp_path)).collect()}
    assert [len(rows[n].units) for n in ("good.docx", "bad.docx", "odd.txt", "paper.pdf")] == [1, 0, 0, 0]
    assert rows["bad.docx"].error.startswith("BadZipFile") and rows["good.docx"].error is None
    kinds = spark.read.format("binaryFile").load(str(tmp_path)).select("path", docx.kind_of(F.col("content")).alias("kind")).collect()
    assert {r.path.rpartition("/")[2]: r.kind for r in kinds} == {"good.docx": "docx", "bad.docx": "docx", "odd.txt": None, "paper.pdf": "pdf"}


@pytest.mark.parametrize(("n", "fmt", "text"), [(4, "lowerRoman", "iv"), (1994, "upperRoman", "MCMXCIV"), (28, "lowerLetter", "ab"), (3, "decimalZero", "03"), (0, "lowerRoman", "0")])
def test_marker_text(n, fmt, text):
    assert docx.marker_text(n, fmt) == text


def test_compare_files_end_to_end(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(package(item("x stays") + item("y stays") + p("a red car"), numbering=LISTS))
    (tmp_path / "b.docx").write_bytes(package(item("wholly new words") + item("x stays") + item("y stays") + p("a blue car"), numbering=LISTS))
    files = docx.read(spark, str(tmp_path))
    units = files.select("path", F.transform("units", lambda u: F.struct(u["text"].alias("text"), u["marker"].alias("marker"), u["stream"].alias("stream"))).alias("u"))
    side = lambda s: units.filter(F.col("path").endswith(f"{s}.docx")).select(F.lit(1).alias("k"), F.col("path").alias(s), F.col("u").alias(f"units_{s}"))
    rows = C.compare(side("a").join(side("b"), "k")).cache()
    assert [(r.type, r.num_changed, r.old_marker) for r in rows.orderBy("row_idx").collect()] == [("inserted", False, None), ("equal", True, "1."), ("equal", True, "2."), ("changed", False, None)]
    s = C.summary(rows).first()
    assert (s.insertions, s.deletions, s.numbering_changes, s.total, s.content, s.numbering) == (2, 1, 2, 5, 2, 2)
    assert C.summary(rows, count_numbering=False).first().total == 3
    assert [(x.cid, x.category) for x in C.passages(rows).orderBy("cid").collect()] == [(1, "insertion"), (2, "numbering"), (3, "numbering"), (4, "deletion"), (5, "insertion")]
    assert "Changes: 5 (insertions 2, deletions 1, numbering 2); formatting 0 (not counted)" in report.report_lines(C.summary(rows)).first().report
    assert report.changed_pages(report.paged(rows, lines_a_page=2)).first().pages == "1-2"
    assert rows.filter(report.visible(show_equal=False)).count() == 4 and report.side(rows, "a").count() == 3
    html = {r.row_idx: r.html for r in rows.select("row_idx", C.row_html().alias("html")).collect()}
    assert html[3] == "a <del>red</del><ins>blue</ins> car"


def brute_passages(segments):
    import re

    out, live = [], {}
    for k, (m, t) in enumerate(segments):
        if m == "eq":
            after = t + (segments[k + 1][1][:1] if k + 1 < len(segments) else " ")
            if re.search(r"[^\W_]", t) or re.search(r"[.!?][\"'’”)\]]*\s", after):
                live = {}
        elif m not in live:
            live[m] = True
            out.append((m, k))
    return out


def test_passages_against_brute_force(spark):
    import random

    rng = random.Random(2)
    cases = []
    for _ in range(120):
        segments = []
        for _ in range(rng.randrange(1, 9)):
            m = rng.choice(["eq", "del", "ins"])
            segments.append((m, rng.choice([" ", ", ", ".", ". ", "word", ".)", "é"])))
        cases.append(segments)
    rows = [(i, i, 0, False, [(m, t, False) for m, t in c]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "a long, b long, row_idx int, num_changed boolean, segments array<struct<m:string,t:string,b:boolean>>")
    got = {}
    for r in C.passages(df).orderBy("a", "cid").collect():
        got.setdefault(r.a, []).append(({"insertion": "ins", "deletion": "del"}[r.category], r.seg_idx))
    assert [got.get(i, []) for i in range(len(cases))] == [brute_passages(c) for c in cases]
    counts = {r.a: (r.n["ins"], r.n["del"]) for r in df.select("a", C.passage_counts().alias("n")).collect()}
    assert counts == {i: tuple(sum(m == side for m, _ in brute_passages(c)) for side in ("ins", "del")) for i, c in enumerate(cases)}


def test_merged_order(spark):
    rows = [(1, 1, 0, "deleted", 0, None), (1, 1, 1, "equal", 1, 0), (1, 1, 2, "changed", 2, 2), (1, 1, 3, "inserted", None, 1), (1, 1, 4, "deleted", 3, None)]
    df = spark.createDataFrame(rows, "a long, b long, row_idx int, type string, oi int, ni int")
    assert [r.row_idx for r in C.merged_order(df).orderBy("pos").collect()] == [0, 1, 3, 2, 4]


def test_kept_inside_the_jvm(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], ["b", "x", "d"]), ([], ["a"]), (["a"], []), (["a", "b"], ["b", "a"])], "x array<string>, y array<string>")
    rows = df.select(similarity.kept_small(F.col("x"), F.col("y")).alias("jvm"), similarity.kept(F.col("x"), F.col("y")).alias("kernel")).collect()
    assert [r.jvm for r in rows] == [r.kernel for r in rows] == [2, 0, 0, 1]


def test_comments():
    old = [{"id": 10, "author": "A", "text": "fix the date"}, {"id": 11, "author": "A", "text": "fix the date please"}, {"id": 12, "author": "B", "text": "why"}]
    new = [{"id": 20, "author": "A", "text": "fix the date"}, {"id": 21, "author": "A", "text": "fix the dates please"}, {"id": 22, "author": "C", "text": "new"}]
    got = threads.changes(old, new)
    assert [(c["state"], c["old_id"], c["new_id"], c["cid"]) for c in got] == [("unchanged", 10, 20, None), ("edited", 11, 21, 1), ("added", None, 22, 2), ("removed", 12, None, 3)]
    tied = threads.match([{"id": 1, "author": "A", "text": "x y", "row": 5}, {"id": 2, "author": "A", "text": "x y", "row": 6}], [{"id": 3, "author": "A", "text": "x z", "row": 6}])
    assert tied == {0: 1}


def test_fills_and_runs(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, "a", None, "b", "b", None])], "k int, i int, v string")
    assert [r.f for r in ranges.fill_both(df, ["k"], ["i"], "v", "f").orderBy("i").collect()] == ["a", "a", "a", "b", "b", "b"]
    assert [(r.v, r.n) for r in ranges.runs(df, ["k"], "i", "v").orderBy("run").collect()] == [(None, 1), ("a", 1), (None, 1), ("b", 2), (None, 1)]


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([(1, 2, ["same", "a red car"], ["same", "a blue car"])], versions.PAIRS).write.parquet(src)
    versions.summaries(versions.pairs(spark, src), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
    got = spark.read.parquet(f"{tmp_path}/out").first()
    assert (got.a, got.b, got.total) == (1, 2, 2)
    q = versions.rows(versions.pairs(spark, src)).select("a", "type").writeStream.format("memory").queryName("seen_rows").option("checkpointLocation", f"{tmp_path}/s2").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen_rows").count() == 2


def test_files_of_either_kind(spark, tmp_path):
    for name, words in (("a", "One old line."), ("b", "One new line.")):
        (tmp_path / f"{name}.docx").write_bytes(package(p(words)))
        (tmp_path / f"{name}.pdf").write_bytes(pdf_file([drawn((50, 600), words)]))
    (tmp_path / "x.txt").write_bytes(b"plain")
    (tmp_path / "y.pdf").write_bytes(b"%PDF-1.4 broken")
    found = files.read(spark, str(tmp_path)).cache()
    got = {r.path.rpartition("/")[2]: r for r in found.collect()}
    assert {n: (r.kind, r.error is None) for n, r in got.items()} == {"a.docx": ("docx", True), "b.docx": ("docx", True), "a.pdf": ("pdf", True), "b.pdf": ("pdf", True), "x.txt": (None, False), "y.pdf": ("pdf", False)}
    assert got["a.docx"].units[0].text == got["a.pdf"].units[0].text == "One old line."
    path = {n: r.path for n, r in got.items()}
    pairs = spark.createDataFrame([(path[x], path[y]) for x, y in (("a.docx", "b.docx"), ("a.pdf", "b.pdf"), ("a.docx", "b.pdf"), ("a.pdf", "x.txt"))] + [(path["a.pdf"], "gone.pdf")], "a string, b string")
    both = files.paired(pairs, found)
    assert sorted(str(r.error) for r in both.collect()) == sorted(["None", "None", files.MIXED, files.UNKNOWN, "no such file"])
    counted = C.summary(C.compare(both.filter("error IS NULL").drop("error"))).collect()
    assert [(r.insertions, r.deletions, r.total) for r in counted] == [(1, 1, 2)] * 2
