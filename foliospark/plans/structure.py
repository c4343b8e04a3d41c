"""Registered queries of the operators in ``operators.flow``, on stand-ins made of the tables, and their SQL.

The stand-ins give lines of documents and units of web pages sections, notes, spaces and places by rule, so that
SQL can make the same ones; the operators see them as they would see those of parsed files.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import compare as C
from foliospark.operators import draw, flow, report, units
from foliospark.plans.catalog import ORACLE_SQL, PAIRS, UNITS, WALK, _ops, _paired, _rows, load, query
from foliospark.tables import spread, written

_HTML = f"h AS ({ORACLE_SQL['html_units']})"


def _html(spark, sf_dir):
    return units.html_units(spread(load(spark, sf_dir, "pages")))


_SECTIONED = f"""WITH {_HTML}, items AS (
  SELECT page_id, idx, CAST(sum(CASE WHEN tag LIKE 'h%' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY idx) AS BIGINT) AS section FROM h
), sections AS (
  SELECT page_id, section, CASE WHEN count(*) % 2 = 0 THEN 'continuous' ELSE 'nextPage' END AS kind FROM items WHERE section <= 2 GROUP BY ALL
)"""


@query(
    "section_groups",
    f"""{_SECTIONED}, told AS (
      SELECT i.page_id, i.idx, i.section,
             coalesce((SELECT kind FROM sections s WHERE s.page_id = i.page_id AND s.section = i.section - 1),
                      (SELECT max_by(kind, section) FROM sections s WHERE s.page_id = i.page_id)) AS kind,
             lag(i.section) OVER (PARTITION BY i.page_id ORDER BY i.idx) AS before
      FROM items i)
    SELECT page_id, idx, section, CAST(sum(CASE WHEN before IS NULL OR (section <> before AND NOT (section > 0 AND coalesce(kind = 'continuous', false))) THEN 1 ELSE 0 END)
           OVER (PARTITION BY page_id ORDER BY idx) - 1 AS BIGINT) AS "group" FROM told""",
)
def section_groups(spark, sf_dir):
    begun = F.sum(F.col("tag").startswith("h").cast("long")).over(Window.partitionBy("page_id").orderBy("idx"))
    items = _html(spark, sf_dir).select("page_id", "idx", begun.alias("section"))
    kind = F.when(F.count(F.lit(1)) % 2 == 0, "continuous").otherwise("nextPage")
    sections = items.filter("section <= 2").groupBy("page_id", "section").agg(kind.alias("kind"))
    return flow.section_groups(items, sections, ["page_id"], ["idx"])


@query(
    "note_groups",
    f"""WITH {_HTML}, items AS (
      SELECT page_id, idx, CASE idx // 4 % 3 WHEN 1 THEN 'footnotes' WHEN 2 THEN 'endnotes' ELSE 'body' END AS stream, idx // 3 AS note,
             CASE WHEN length(text) % 2 = 0 THEN idx END AS row_idx FROM h
    ), islands AS (
      SELECT *, idx - row_number() OVER (PARTITION BY page_id, stream, note ORDER BY idx) AS island FROM items WHERE stream <> 'body'
    )
    SELECT page_id, stream, CAST(note AS BIGINT) AS note, 'b' AS side, min(row_idx) AS row_idx, count(*) AS n
    FROM islands GROUP BY page_id, stream, note, island HAVING min(row_idx) IS NOT NULL""",
)
def note_groups(spark, sf_dir):
    stream = F.expr("CASE idx div 4 % 3 WHEN 1 THEN 'footnotes' WHEN 2 THEN 'endnotes' ELSE 'body' END")
    items = _html(spark, sf_dir).select("page_id", "idx", stream.alias("stream"), F.expr("idx div 3").alias("note"), F.lit("b").alias("side"), F.when(F.length("text") % 2 == 0, F.col("idx")).alias("row_idx"))
    return flow.note_groups(items, ["page_id"], ["idx"])


@query(
    "note_index",
    f"""{WALK}, begun AS (
      SELECT a, b, 'b' AS side, j // 5 AS note, CASE WHEN tag = 'insert' THEN 'ins' ELSE 'eq' END AS mode, seq FROM ops WHERE tag <> 'delete' AND j % 5 = 0 AND (j // 5) % 2 = 1
      UNION ALL
      SELECT a, b, 'a', i // 5, CASE WHEN tag = 'delete' THEN 'del' ELSE 'eq' END, seq FROM ops WHERE tag <> 'insert' AND i % 5 = 0 AND (i // 5) % 2 = 1)
    SELECT a, b, side, CAST(note AS BIGINT) AS note, mode, CAST(seq AS INT) AS row_idx FROM begun""",
)
def note_index(spark, sf_dir):
    kind = F.when(F.col("tag") == "equal", "equal").when(F.col("tag") == "delete", "deleted").otherwise("inserted")
    place = lambda at, other: F.when(F.col("tag") != other, F.col(at))
    rows = _ops(spark, sf_dir).select("a", "b", F.col("seq").alias("row_idx"), kind.alias("type"), place("i", "insert").alias("oi"), place("j", "delete").alias("ni"))
    paired = _paired(spark, sf_dir)
    each = lambda s: paired.select("a", "b", F.lit(s).alias("side"), F.posexplode(f"units_{s}").alias("idx", "text")).drop("text")
    noted = each("a").unionByName(each("b")).withColumn("note", F.expr("CASE WHEN (idx div 5) % 2 = 1 THEN idx div 5 END"))
    return flow.note_index(rows, noted, ["a", "b"])


@query(
    "referenced_notes",
    "SELECT n.conv_id, n.turn AS note, EXISTS (SELECT 1 FROM conversations r WHERE r.conv_id = n.conv_id AND r.role = 'assistant' AND r.turn - 1 = n.turn) AS referenced FROM conversations n",
)
def referenced_notes(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations")
    references = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("note"))
    return flow.noted(turns.select("conv_id", F.col("turn").alias("note")), references, ["conv_id"])


@query(
    "collapsed_spacing",
    f"""WITH {_HTML}, blocks AS (SELECT page_id, idx, CASE WHEN tag LIKE 'h%' THEN 12.0::DOUBLE ELSE 6.0::DOUBLE END AS sb, CAST(length(text) % 13 AS DOUBLE) AS sa FROM h)
    SELECT page_id, idx, CASE WHEN idx = 0 THEN sb ELSE greatest(0.0::DOUBLE, sb - lag(sa) OVER (PARTITION BY page_id ORDER BY idx)) END AS space_before, sa AS space_after FROM blocks""",
)
def collapsed_spacing(spark, sf_dir):
    before = F.when(F.col("tag").startswith("h"), 12.0).otherwise(6.0)
    blocks = _html(spark, sf_dir).select("page_id", "idx", before.alias("space_before"), (F.length("text") % 13).cast("double").alias("space_after"))
    return flow.collapse_spacing(blocks, ["page_id"], ["idx"])


@query(
    "running_lines",
    f"""WITH {UNITS}, placed AS (
      SELECT doc_id, idx, idx // 20 AS page, text, lower(regexp_replace(text, '{T.DIGITS}', '#', 'g')) AS sig,
             list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: TRY_CAST(x AS DECIMAL(38, 0))) AS numbers FROM units
    )
    SELECT x.doc_id, x.sig, x.idx FROM placed x WHERE EXISTS (
      SELECT 1 FROM placed y WHERE y.doc_id = x.doc_id AND y.sig = x.sig AND y.idx <> x.idx AND (y.text = x.text OR (
        len(y.numbers) = len(x.numbers)
        AND list_filter(list_transform(list_zip(x.numbers, y.numbers), lambda z: z[2] - z[1]), lambda d: d <> 0) = [y.page - x.page])))""",
)
def running_lines(spark, sf_dir):
    lines = units.units(spread(load(spark, sf_dir, "documents")))
    placed = lines.select("doc_id", "idx", "text", F.expr("idx div 20").alias("page"), F.lower(F.regexp_replace("text", T.DIGITS, "#")).alias("sig"))
    return flow.running_lines(placed, ["doc_id", "sig"], ["idx"])


_LINES = f"""WITH {PAIRS}, sided AS (
  SELECT a, b, 'a' AS side, CAST(generate_subscripts(la, 1) - 1 AS INT) AS idx, unnest(la) AS text FROM paired
  UNION ALL SELECT a, b, 'b', CAST(generate_subscripts(lb, 1) - 1 AS INT), unnest(lb) FROM paired
), line_ends AS (
  SELECT a, b, idx // 30 = lead(idx // 30) OVER w AND length(text) * 5 >= 390 AS is_full,
         NOT regexp_matches(text, '{flow.SENTENCE_END.replace("'", "''")}') AND regexp_matches(lead(text) OVER w, '^\\p{{Ll}}') AS goes_on
  FROM sided WINDOW w AS (PARTITION BY a, b, side ORDER BY idx)
)"""


@query(
    "wrapping_pairs",
    f"""{_LINES}, pooled AS (SELECT a, b, count(*) FILTER (is_full AND goes_on) AS w, count(*) FILTER (is_full) AS f, count(*) AS t FROM line_ends GROUP BY a, b)
    SELECT a, b, CASE WHEN f < greatest(3, floor(t * 0.05::DOUBLE)) THEN true ELSE w / f < 0.5::DOUBLE END AS no_wrap FROM pooled""",
)
def wrapping_pairs(spark, sf_dir):
    """Whether nothing wraps, decided for both sides of a pair together."""
    paired = _paired(spark, sf_dir)
    each = lambda s: paired.select("a", "b", F.lit(s).alias("side"), F.posexplode(f"units_{s}").alias("idx", "text"))
    placed = each("a").unionByName(each("b")).withColumns(
        {"page": F.expr("idx div 30"), "cell": F.lit(None).cast("int"), "y": F.expr("idx % 30 * 12"), "x1": F.length("text") * 5, "size": F.lit(10.0), "right": F.lit(400)}
    )
    return flow.nothing_wraps(flow.wrap_votes(placed, ["a", "b", "side"], ["idx"]), ["a", "b"])


@query(
    "justified_sources",
    f"""WITH {UNITS}, told AS (SELECT source, length(u.text) // 80 AS n, CASE WHEN length(u.text) % 2 = 0 THEN 'justify' ELSE 'left' END AS align FROM units u JOIN documents d USING (doc_id))
    SELECT source, count(*) FILTER (n >= 3 AND align = 'justify') > count(*) FILTER (n >= 3 AND align = 'left') AS justified FROM told GROUP BY source""",
)
def justified_sources(spark, sf_dir):
    docs = spread(load(spark, sf_dir, "documents"))
    lines = docs.select("source", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("text")).select("source", T.norm(F.col("text")).alias("text")).filter("text <> ''")
    align = F.when(F.length("text") % 2 == 0, "justify").otherwise("left")
    return flow.justified(lines.select("source", align.alias("align"), F.expr("length(text) div 80").alias("n_lines")), ["source"])


# Expressions over one unit.
@query(
    "text_pieces",
    f"""WITH {_HTML}, sized AS (SELECT *, CAST(length(text) AS INT) AS n FROM h), cut AS (
      SELECT *, list_sort(list_distinct(list_filter([0, n // 5, n // 4, n // 4 + 1, n // 3, n // 2, 2 * n // 3, n], lambda x: x <= n))) AS cuts FROM sized
    ), each AS (
      SELECT page_id, idx, text, n, unnest(cuts[:-2]) AS s, unnest(cuts[2:]) AS e FROM cut WHERE len(cuts) > 1
      UNION ALL SELECT page_id, idx, text, n, n, n FROM sized
    )
    SELECT page_id, idx, CAST(s AS INT) AS s, CAST(e AS INT) AS e, substr(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)) AS text,
           CASE WHEN s = e THEN NULL WHEN s < n // 2 THEN 'x' ELSE 'y' END AS fmt, s < e AND s >= n // 3 AND s < 2 * n // 3 AS changed,
           CASE WHEN s < e AND s = n // 4 THEN 2 ELSE 0 END AS tab,
           CASE WHEN s = n THEN '8' WHEN s = n // 5 THEN '7' ELSE '' END AS marks FROM each""",
)
def text_pieces(spark, sf_dir):
    at = lambda e: F.expr(f"cast({e} as int)")
    n = at("length(text)")
    span = lambda s, e, f: F.struct(at(s).alias("s"), at(e).alias("e"), F.lit(f).alias("fmt"))
    made = flow.pieces(
        F.lit(0), n, F.col("text"),
        F.array(span("0", "length(text) div 2", "x"), span("length(text) div 2", "length(text)", "y")),
        F.array(F.struct(at("length(text) div 3").alias("s"), at("2 * length(text) div 3").alias("e"))),
        F.array(F.struct(at("length(text) div 4").alias("at"), F.lit(2).alias("n"))),
        F.array(F.struct(at("length(text) div 5").alias("at"), F.lit(7).alias("ref")), F.struct(n.alias("at"), F.lit(8).alias("ref"))),
    )
    cut = _html(spark, sf_dir).select("page_id", "idx", F.inline(made))
    return cut.withColumn("marks", F.array_join(F.transform("marks", lambda m: m.cast("string")), ","))


_RAW = "translate(coalesce(text, ''), ',', chr(9))"
_BODY = f"regexp_replace(regexp_replace({_RAW}, '^{T.RUN}|{T.RUN}$', '', 'g'), '{flow._SPACES}', ' ', 'g')"


@query(
    "tab_marks",
    f"""WITH told AS (SELECT conv_id, turn, {_RAW} AS raw, {_BODY} AS body FROM conversations), cut AS (
      SELECT conv_id, turn, raw, string_split_regex(body, ' ?\\t[ \\t]*') AS parts, regexp_extract_all(body, ' ?\\t[ \\t]*') AS gaps FROM told)
    SELECT conv_id, turn, CAST(length(regexp_replace(regexp_extract(raw, '^{T.RUN}'), '[^\\t]', '', 'g')) AS INT) AS lead,
           coalesce(array_to_string(list_transform(range(1, len(gaps) + 1), lambda i:
             (length(array_to_string(parts[1:i], '')) + i - 1) || ':' || length(regexp_replace(gaps[i], '[^\\t]', '', 'g'))), ','), '') AS marks FROM cut""",
)
def tab_marks(spark, sf_dir):
    """Where tabs went, with commas in the place of tabs."""
    turns = load(spark, sf_dir, "conversations").withColumn("_m", flow.tab_marks(F.translate(F.coalesce("text", F.lit("")), ",", "\t")))
    shown = F.transform("_m.marks", lambda m: F.concat_ws(":", m["at"].cast("string"), m["n"].cast("string")))
    return turns.select("conv_id", "turn", "_m.lead", F.array_join(shown, ",").alias("marks"))


@query(
    "note_marks",
    f"""WITH told AS (SELECT conv_id, turn, string_split(coalesce(text, ''), 'e') AS parts FROM conversations), places AS (
      SELECT conv_id, turn, parts, unnest(list_filter(range(1, len(parts) + 1), lambda i: i % 7 = 0)) AS i FROM told
    ), texts AS (
      SELECT conv_id, turn, i, array_to_string(list_transform(list_filter(range(1, i), lambda k: k % 7 <> 0), lambda k: parts[k]), '') AS before,
             array_to_string(list_transform(list_filter(range(1, len(parts) + 1), lambda k: k % 7 <> 0), lambda k: parts[k]), '') AS whole FROM places)
    SELECT conv_id, turn, CAST(least(length(regexp_replace(regexp_replace(coalesce(before, ''), '^{T.RUN}', ''), '{T.RUN}', ' ', 'g')),
           length(regexp_replace(regexp_replace(coalesce(whole, ''), '^{T.RUN}|{T.RUN}$', '', 'g'), '{T.RUN}', ' ', 'g'))) AS INT) AS "at", CAST(i AS INT) AS note FROM texts""",
)
def note_marks(spark, sf_dir):
    """Places of notes, where every seventh piece between the letters e is a reference."""
    runs = F.transform(F.split(F.coalesce("text", F.lit("")), "e", -1), lambda x, i: F.struct(x.alias("text"), F.when((i + 1) % 7 == 0, i + 1).alias("note")))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.inline(flow.note_marks(runs)))


@query("note_sentinels", "SELECT conv_id, turn, chr(57344) || role || ':' || turn || chr(57345) AS sentinel FROM conversations")
def note_sentinels(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.sentinel(F.col("role"), F.col("turn")).alias("sentinel"))


@query(
    "note_numbers",
    """WITH d AS (SELECT p_partkey, p_size || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN CAST(p_size + 1 AS VARCHAR) ELSE (p_size + 1) || '' || (p_size + 2) END AS digits FROM part),
    lists AS (SELECT a, CAST(range(a, b + 1) AS BIGINT[]) AS ns FROM range(3, 48) x(a), range(3, 48) y(b) WHERE b BETWEEN a AND a + 5),
    spelt AS (SELECT a, ns, array_to_string(ns, '') AS digits FROM lists)
    SELECT p_partkey, d.digits, coalesce(array_to_string(min_by(s.ns, (len(s.ns) > 1, len(CAST(s.a AS VARCHAR)))), ','), '') AS notes
    FROM d LEFT JOIN spelt s USING (digits) GROUP BY ALL""",
)
def note_numbers(spark, sf_dir):
    digits = F.expr("concat(p_size, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN string(p_size + 1) ELSE concat(p_size + 1, p_size + 2) END)")
    parts = load(spark, sf_dir, "part").select("p_partkey", digits.alias("digits"))
    found = flow.note_numbers(F.col("digits"), F.sequence(F.lit(3).cast("long"), F.lit(47).cast("long")))
    return parts.select("p_partkey", "digits", F.array_join(found, ",").alias("notes"))


_EFFECTS = ("underline", "dotted-underline", "double-underline", "strikethrough", "double-strikethrough")


@query(
    "decorations",
    """WITH rules(bit, y, t, dotted) AS (VALUES (1, 0.11::DOUBLE, 0.06::DOUBLE, false), (2, 0.11::DOUBLE, 0.06::DOUBLE, true), (4, 0.08::DOUBLE, 0.045::DOUBLE, false), (4, 0.20::DOUBLE, 0.045::DOUBLE, false),
      (8, -0.26::DOUBLE, 0.06::DOUBLE, false), (16, -0.31::DOUBLE, 0.045::DOUBLE, false), (16, -0.21::DOUBLE, 0.045::DOUBLE, false)),
    styled AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_size & 4 = 0 THEN (p_size & 61) | 1 ELSE p_size END AS bits FROM part)
    SELECT p_partkey, round(100 + y * 11, 6) AS y, round(t * 11, 6) AS thickness, dotted FROM styled JOIN rules ON bits & bit <> 0 WHERE NOT (dotted AND bits & 1 <> 0)""",
)
def decorations(spark, sf_dir):
    chosen = F.array_compact(F.array(*[F.when(F.col("p_size").bitwiseAND(1 << i) != 0, F.lit(name)) for i, name in enumerate(_EFFECTS)]))
    effects = flow.run_effects(chosen, F.col("p_partkey") % 2 == 0)
    drawn = flow.decorations(effects, F.lit(0.0), F.lit(50.0), F.lit(100.0), F.lit(11.0))
    return load(spark, sf_dir, "part").select("p_partkey", F.inline(drawn)).select("p_partkey", F.round("y", 6).alias("y"), F.round("thickness", 6).alias("thickness"), "dotted")


@query("content_bottoms", "SELECT o_custkey, greatest(72.0::DOUBLE, max(o_totalprice + o_orderkey % 7)) AS bottom FROM orders GROUP BY o_custkey")
def content_bottoms(spark, sf_dir):
    boxes = F.collect_list(F.struct(F.col("o_totalprice").alias("top"), (F.col("o_orderkey") % 7).cast("double").alias("height")))
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(boxes.alias("lines")).select("o_custkey", flow.content_bottom(F.lit(72.0), F.col("lines")).alias("bottom"))


@query("layout_json")
def layout_json(spark, sf_dir):
    return draw.to_json(draw.layout(_rows(spark, sf_dir)))


# Rows made of the edit scripts, one segment each, so that SQL can follow what is made from rows.
_MADE = f"""{WALK}, made AS (
  SELECT a, b, seq AS row_idx, CASE tag WHEN 'equal' THEN 'equal' WHEN 'delete' THEN 'deleted' ELSE 'inserted' END AS type,
         CASE WHEN tag <> 'insert' THEN i END AS oi, CASE WHEN tag <> 'delete' THEN j END AS ni, tag = 'equal' AND seq % 7 = 3 AS num_changed, seq % 5 = 0 AS formatted,
         CASE WHEN tag = 'insert' THEN lb[j + 1] ELSE la[i + 1] END AS text
  FROM ops JOIN paired USING (a, b)
), paged AS (
  SELECT *, type <> 'equal' OR num_changed OR formatted AS changed, CAST(coalesce(sum(n) OVER (PARTITION BY a, b ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 40 + 1 AS INT) AS page
  FROM (SELECT *, CAST(greatest(1, ceil(length(text) / 80)) AS BIGINT) AS n FROM made)
)"""


def _made(spark, sf_dir):
    op = C.edit_scripts(_paired(spark, sf_dir)).select("a", "b", "units_a", "units_b", F.posexplode("ops").alias("row_idx", "op"))
    is_a, is_b = F.col("op.tag") != "insert", F.col("op.tag") != "delete"
    kind = F.when(F.col("op.tag") == "equal", "equal").when(F.col("op.tag") == "delete", "deleted").otherwise("inserted")
    mode = F.when(F.col("op.tag") == "equal", "eq").when(F.col("op.tag") == "delete", "del").otherwise("ins")
    text = F.when(is_a, F.get("units_a", F.col("op.i"))).otherwise(F.get("units_b", F.col("op.j")))
    fmt = F.array(F.struct(F.lit(0).alias("s"), F.lit(1).alias("e"), F.lit("bold").alias("desc")))
    return op.select(
        "a", "b", "row_idx", kind.alias("type"), F.when(is_a, F.col("op.i")).alias("oi"), F.when(is_b, F.col("op.j")).alias("ni"), F.lit(None).cast("string").alias("cat"),
        ((F.col("op.tag") == "equal") & (F.col("row_idx") % 7 == 3)).alias("num_changed"), F.slice(fmt, F.lit(1), (F.col("row_idx") % 5 == 0).cast("int")).alias("fmt"),
        F.array(F.struct(mode.alias("m"), text.alias("t"), F.lit(False).alias("b"))).alias("segments"),
    )


@query(
    "script_summary",
    f"""{_MADE}, counted AS (
      SELECT a, b, count(*) FILTER (type <> 'equal') AS content, CAST(0 AS BIGINT) AS punctuation, count(*) FILTER (num_changed) AS numbering, count(*) FILTER (type = 'equal' AND formatted) AS formatting,
             count(*) FILTER (type = 'inserted') AS insertions, count(*) FILTER (type = 'deleted') AS deletions FROM made GROUP BY a, b)
    SELECT *, numbering AS numbering_changes, insertions + deletions + numbering AS total, CAST(0 AS BIGINT) AS moves, CAST(0 AS BIGINT) AS splits, CAST(0 AS BIGINT) AS merges FROM counted""",
)
def script_summary(spark, sf_dir):
    return C.summary(_made(spark, sf_dir))


@query(
    "script_order",
    f"""{_MADE}, anchored AS (
      SELECT *, coalesce((SELECT min(x.ni) FROM made x WHERE x.a = m.a AND x.b = m.b AND x.row_idx >= m.row_idx AND x.ni IS NOT NULL), 2147483647) AS anchor FROM made m)
    SELECT a, b, CAST(row_number() OVER (PARTITION BY a, b ORDER BY anchor, ni IS NOT NULL, row_idx) - 1 AS INT) AS pos, row_idx, type, oi, ni FROM anchored""",
)
def script_order(spark, sf_dir):
    return C.merged_order(_made(spark, sf_dir))


@query(
    "script_changes",
    f"""{_MADE}, found AS (
      SELECT a, b, row_idx, type, oi, ni, 0 AS seg_idx, CASE type WHEN 'inserted' THEN 'insertion' ELSE 'deletion' END AS category FROM made WHERE type <> 'equal'
      UNION ALL SELECT a, b, row_idx, type, oi, ni, -1, 'numbering' FROM made WHERE num_changed)
    SELECT a, b, CAST(row_number() OVER (PARTITION BY a, b ORDER BY row_idx, seg_idx) AS INT) AS cid, category, row_idx, seg_idx, type, oi, ni FROM found""",
)
def script_changes(spark, sf_dir):
    rows = written(_made(spark, sf_dir), "rows")
    return report.change_list(C.passages(rows), rows)


@query(
    "script_visible",
    f"{_MADE} SELECT a, b, row_idx, CASE type WHEN 'inserted' THEN true WHEN 'deleted' THEN false ELSE num_changed OR formatted END AS visible FROM made",
)
def script_visible(spark, sf_dir):
    return _made(spark, sf_dir).select("a", "b", "row_idx", report.visible(show_equal=False, show_deletions=False).alias("visible"))


@query(
    "script_changed_pages",
    f"""{_MADE}, d AS (SELECT DISTINCT a, b, page FROM paged WHERE changed),
    g AS (SELECT *, page - row_number() OVER (PARTITION BY a, b ORDER BY page) AS g FROM d),
    r AS (SELECT a, b, min(page) AS f, max(page) AS l FROM g GROUP BY a, b, g),
    listed AS (SELECT a, b, string_agg(CASE WHEN f = l THEN CAST(f AS VARCHAR) ELSE f || '-' || l END, ', ' ORDER BY f) AS pages FROM r GROUP BY a, b)
    SELECT a, b, n_pages, coalesce(pages, '') AS pages FROM (SELECT a, b, max(page) AS n_pages FROM paged GROUP BY a, b) LEFT JOIN listed USING (a, b)""",
)
def script_changed_pages(spark, sf_dir):
    return report.changed_pages(report.paged(written(_made(spark, sf_dir), "rows")))


@query(
    "script_changed_only",
    f"""{_MADE} SELECT a, b, page, row_idx FROM paged p WHERE page = 1 OR EXISTS (SELECT 1 FROM paged x WHERE x.a = p.a AND x.b = p.b AND x.page = p.page AND x.changed)""",
)
def script_changed_only(spark, sf_dir):
    return report.changed_only(report.paged(written(_made(spark, sf_dir), "rows"))).select("a", "b", "page", "row_idx")


@query(
    "script_body_rows",
    f"{_MADE} SELECT a, b, row_idx, type, oi - oi // 4 AS oi, ni - ni // 4 AS ni FROM made WHERE coalesce(ni, oi) % 4 <> 3",
)
def script_body_rows(spark, sf_dir):
    """Rows of body units, where every fourth unit of a side is a note's."""
    paired = _paired(spark, sf_dir)
    streamed = lambda s: F.transform(f"units_{s}", lambda t, i: F.struct(t.alias("text"), F.when(i % 4 == 3, "footnotes").otherwise("body").alias("stream"))).alias(f"units_{s}")
    return report.body_rows(_made(spark, sf_dir), paired.select("a", "b", streamed("a"), streamed("b"))).select("a", "b", "row_idx", "type", "oi", "ni")


@query(
    "script_comment_counts",
    f"""{_MADE} SELECT a, b, count(*) FILTER (type = 'inserted') AS added, count(*) FILTER (type = 'deleted') AS removed, count(*) FILTER (type = 'equal' AND num_changed) AS edited
    FROM made WHERE type <> 'equal' OR num_changed GROUP BY a, b""",
)
def script_comment_counts(spark, sf_dir):
    state = F.when(F.col("type") == "inserted", "added").when(F.col("type") == "deleted", "removed").when(F.col("num_changed"), "edited").otherwise("unchanged")
    return report.comment_counts(_made(spark, sf_dir).withColumn("state", state))


def _streamed(spark, sf_dir):
    """Pairs whose every fourth unit of a side is a footnote's, every third other one a table's, with markers."""
    unit = lambda t, i: F.struct(t.alias("text"), F.concat(i.cast("string"), F.lit(".")).alias("marker"), F.when(i % 4 == 3, "footnote").otherwise("body").alias("stream"), F.when(i % 3 == 1, i).alias("ti"))
    return _paired(spark, sf_dir).select("a", "b", *[F.transform(f"units_{s}", unit).alias(f"units_{s}") for s in "ab"])


@query(
    "script_table_changes",
    f"""{_MADE}, found AS (
      SELECT a, b, row_idx, type, oi, ni, 0 AS seg_idx, CASE type WHEN 'inserted' THEN 'insertion' ELSE 'deletion' END AS category FROM made WHERE type <> 'equal'
      UNION ALL SELECT a, b, row_idx, type, oi, ni, -1, 'numbering' FROM made WHERE num_changed),
    numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY a, b ORDER BY row_idx, seg_idx) AS INT) AS cid FROM found)
    SELECT a, b, cid, category, row_idx, seg_idx, type, oi, ni FROM numbered WHERE coalesce(ni, oi) % 4 <> 3 AND coalesce(ni, oi) % 3 = 1""",
)
def script_table_changes(spark, sf_dir):
    """The changes in tables, by the numbers that they have among all."""
    rows = written(_made(spark, sf_dir), "rows")
    return report.change_list(C.passages(rows), report.located(rows, _streamed(spark, sf_dir)), location="table")


@query(
    "script_marked_text",
    f"{_MADE} SELECT a, b, string_agg(CASE WHEN num_changed THEN 'old' ELSE coalesce(ni, oi) || '.' END || ' ' || text, chr(10) ORDER BY row_idx) AS text FROM made WHERE oi IS NOT NULL GROUP BY a, b",
)
def script_marked_text(spark, sf_dir):
    rows = _made(spark, sf_dir).withColumn("old_marker", F.when(F.col("num_changed"), F.lit("old")))
    return report.marked_text(report.located(rows, _streamed(spark, sf_dir)), "a")


@query(
    "merged_items",
    f"""{_MADE}, revised AS (
      SELECT a, b, 3 * j + k AS "at", CASE WHEN k = 1 THEN j END AS ni, (3 * j + k) % 7 = 5 AS ends
      FROM (SELECT a, b, unnest(range(0, len(lb))) AS j FROM paired), (VALUES (0), (1), (2)) AS s(k) WHERE k = 1 OR j % 2 = 0
    ), gone AS (
      SELECT a, b, row_idx, (SELECT min(x.ni) FROM made x WHERE x.a = m.a AND x.b = m.b AND x.row_idx > m.row_idx) AS n FROM made m WHERE ni IS NULL
    ), bounded AS (
      SELECT g.*, coalesce(3 * n + 1, 2147483647) AS until, coalesce(3 * coalesce(n, (SELECT max(ni) + 1 FROM revised r WHERE r.a = g.a AND r.b = g.b), 0) - 2, -1) AS since FROM gone g
    ), placed AS (
      SELECT a, b, row_idx, CAST(NULL AS BIGINT) AS "at", 0 AS e, coalesce(2 * (SELECT min(r."at") FROM revised r WHERE r.a = g.a AND r.b = g.b AND r.ends AND r."at" >= g.since AND r."at" < g.until) + 0.5, 2 * until - 0.5) AS place FROM bounded g
      UNION ALL SELECT r.a, r.b, m.row_idx, r."at", CAST(r.ends AS INT), 2 * r."at" FROM revised r LEFT JOIN made m ON m.a = r.a AND m.b = r.b AND m.ni = r.ni
    )
    SELECT a, b, CAST(row_number() OVER (PARTITION BY a, b ORDER BY place, row_idx) - 1 AS INT) AS pos, row_idx, CAST("at" AS INT) AS "at",
           CAST((SELECT count(*) FROM revised r WHERE r.a = p.a AND r.b = p.b AND r.ends AND 2 * r."at" < p.place - 0.5) AS BIGINT) AS section FROM placed p""",
)
def merged_items(spark, sf_dir):
    """The merged documents, with an empty paragraph on both sides of every second line and sections that end by rule."""
    lines = _paired(spark, sf_dir).select("a", "b", F.posexplode("units_b").alias("j", "text")).select("a", "b", "j", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).filter("k = 1 OR j % 2 = 0")
    revised = lines.select("a", "b", (3 * F.col("j") + F.col("k")).alias("at"), F.when(F.col("k") == 1, F.col("j")).alias("ni")).withColumn("ends", F.col("at") % 7 == 5)
    return flow.merged_items(_made(spark, sf_dir), revised, ["a", "b"])
