"""Registered queries of the document-comparison operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import compare as C
from foliospark.operators import ranges as R
from foliospark.operators import similarity as S
from foliospark.operators import draw, geometry, pages, report, threads, units
from foliospark.tables import spread, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "summary"
JOINER = chr(31)


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL where SQL can express it."""

    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL fragments.
def _norm(x: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({x}, ''), '{T.RUN}', ' ', 'g'), '{T.TRIM}', '', 'g')"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '{T.TOKEN}')"


UNITS = f"""
unit_lists AS (
  SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_norm('x')}), lambda x: x <> '') AS units FROM documents
), units AS (
  SELECT doc_id, CAST(generate_subscripts(units, 1) - 1 AS INT) AS idx, unnest(units) AS text FROM unit_lists
)"""
PAIRS = f"""{UNITS}, lines AS (
  SELECT DISTINCT doc_id, text AS line FROM units WHERE length(text) >= 20
), firsts AS (
  SELECT line, min(doc_id) AS a FROM lines GROUP BY line
), votes AS (
  SELECT l.doc_id AS b, f.a, count(*) AS votes FROM lines l JOIN firsts f USING (line) WHERE f.a < l.doc_id GROUP BY ALL
), best AS (
  SELECT b, a FROM votes QUALIFY row_number() OVER (PARTITION BY b ORDER BY votes DESC, a) = 1
), sizes AS (
  SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id
), shared AS (
  SELECT p.a, p.b, count(*) AS n_shared FROM best p JOIN lines x ON x.doc_id = p.a JOIN lines y ON y.doc_id = p.b AND x.line = y.line GROUP BY ALL
), pairs AS (
  SELECT a, b, n_shared, dice FROM (
    SELECT s.a, s.b, s.n_shared, round(2.0::DOUBLE * s.n_shared / (x.n + y.n), 6) AS dice
    FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b) WHERE dice >= 0.5
), paired AS (
  SELECT p.a, p.b, x.units AS la, y.units AS lb FROM pairs p JOIN unit_lists x ON x.doc_id = p.a JOIN unit_lists y ON y.doc_id = p.b
)"""
# Row i of the table is the suffix of la from its element n - i + 1 on, by the running-maximum form of the recurrence.
TABLE = f"""{PAIRS}, tables AS (
  SELECT a, b, la, lb, list_reduce(
    list_prepend(list_value(list_transform(range(0, len(lb) + 1), lambda _: 0)),
      list_transform(list_reverse(la), lambda x: list_value(list_transform(lb, lambda y: CASE WHEN x = y THEN 1 ELSE 0 END)))),
    lambda acc, e: list_append(acc, list_transform(range(1, len(lb) + 2), lambda j: coalesce(list_max(list_transform(range(j, len(lb) + 2),
      lambda k: CASE WHEN k <= len(lb) AND e[1][k] = 1 THEN acc[len(acc)][k + 1] + 1 ELSE acc[len(acc)][k] END)), 0)))) AS dp
  FROM paired
)"""
WALK = f"""WITH RECURSIVE {TABLE}, walk AS (
  SELECT a, b, la, lb, dp, 0 AS seq, 0 AS i, 0 AS j, CAST(NULL AS VARCHAR) AS tag, 0 AS at_i, 0 AS at_j FROM tables
  UNION ALL
  SELECT a, b, la, lb, dp, seq + 1,
         i + CASE WHEN tag2 IN ('equal', 'delete') THEN 1 ELSE 0 END, j + CASE WHEN tag2 IN ('equal', 'insert') THEN 1 ELSE 0 END, tag2, i, j
  FROM (SELECT *, CASE
          WHEN i < len(la) AND j < len(lb) AND la[i + 1] = lb[j + 1] THEN 'equal'
          WHEN i < len(la) AND (j >= len(lb) OR dp[len(la) - i][j + 1] >= dp[len(la) - i + 1][j + 2]) THEN 'delete'
          ELSE 'insert' END AS tag2
        FROM walk WHERE i < len(la) OR j < len(lb))
), ops AS (
  SELECT a, b, CAST(seq - 1 AS INT) AS seq, tag, CAST(at_i AS INT) AS i, CAST(at_j AS INT) AS j FROM walk WHERE seq > 0
)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.near_copy_pairs(load(spark, sf_dir, "documents"))


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.near_copies(C.listed(load(spark, sf_dir, "documents"))).drop("n_shared", "dice")


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.edit_scripts(_paired(spark, sf_dir)).select("a", "b", F.posexplode("ops").alias("seq", "op")).select("a", "b", "seq", "op.*")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compare(_paired(spark, sf_dir))


def _kept_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows, written once for a plan that reads them several times."""
    return written(_rows(spark, sf_dir), "rows")


# Text functions.
@query("normalize_text", f"SELECT doc_id, {_norm('text')} AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    return spread(load(spark, sf_dir, "documents")).select("doc_id", T.norm(F.col("text")).alias("normalized"))


def _listed(tokens):
    return F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, JOINER).cast("binary")).alias("tokens_md5")


def _listed_sql(tokens: str) -> str:
    return f"SELECT doc_id, CAST(len({tokens}) AS BIGINT) AS n_tokens, md5(coalesce(array_to_string({tokens}, chr(31)), '')) AS tokens_md5 FROM documents"


@query("tokenize", _listed_sql(_tokens("text")))
def tokenize(spark, sf_dir):
    return spread(load(spark, sf_dir, "documents")).select("doc_id", *_listed(T.tokenize(F.col("text"))))


@query("words_only", _listed_sql(f"regexp_extract_all(lower(coalesce(text, '')), '{T.WORD}')"))
def words_only(spark, sf_dir):
    return spread(load(spark, sf_dir, "documents")).select("doc_id", *_listed(T.words_only(F.col("text"))))


@query("content_tokens", _listed_sql(f"list_filter({_tokens('text')}, lambda t: NOT regexp_matches(t, '{T.BLANK}'))"))
def content_tokens(spark, sf_dir):
    return spread(load(spark, sf_dir, "documents")).select("doc_id", *_listed(T.content_tokens(F.col("text"))))


@query("escape_html", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def escape_html(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


_ROMAN = "''"
_rest = "n"
for _value, _letters in T.ROMAN:
    _ROMAN += f" || repeat('{_letters}', CAST(floor({_rest} / {_value}) AS INT))"
    _rest = f"({_rest} % {_value})"


@query(
    "list_markers",
    f"""SELECT n, {_ROMAN} AS roman,
    CASE WHEN n <= 26 THEN chr(CAST(96 + n AS INT)) ELSE chr(CAST(96 + ((n - 1) // 26) AS INT)) || chr(CAST(97 + (n - 1) % 26 AS INT)) END AS letters,
    repeat(chr(CAST(97 + (n - 1) % 26 AS INT)), CAST((n - 1) // 26 + 1 AS INT)) AS page_letters, lpad(CAST(n AS VARCHAR), CAST(greatest(2, len(CAST(n AS VARCHAR))) AS INT), '0') AS decimal_zero
    FROM (SELECT DISTINCT CAST(p_size AS BIGINT) * 10 + 1 AS n FROM part)""",
)
def list_markers(spark, sf_dir):
    n = load(spark, sf_dir, "part").select((F.col("p_size").cast("long") * 10 + 1).alias("n")).distinct()
    digits = F.col("n").cast("string")
    zero = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    return n.select("n", T.roman(F.col("n")).alias("roman"), T.letters(F.col("n")).alias("letters"), T.page_letters(F.col("n")).alias("page_letters"), zero.alias("decimal_zero"))


@query("half_points", "SELECT o_orderkey, round_even(o_totalprice * 2, 0) / 2 AS halves FROM orders")
def half_points(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    return orders.select("o_orderkey", T.half(F.col("o_totalprice")).alias("halves"))


@query(
    "line_signatures",
    f"""WITH {UNITS}, signed AS (
      SELECT doc_id, CASE WHEN regexp_matches(s, '{T.PAGE_SHAPE}') THEN '#' ELSE s END AS signature
      FROM (SELECT doc_id, lower(regexp_replace(text, '{T.DIGITS}', '#', 'g')) AS s FROM units))
    SELECT signature, count(DISTINCT doc_id) AS n_documents, count(*) AS n_lines FROM signed GROUP BY signature HAVING count(DISTINCT doc_id) >= 3""",
)
def line_signatures(spark, sf_dir):
    lines = units.units(spread(load(spark, sf_dir, "documents"))).select("doc_id", T.signature(F.col("text"), normalized=True).alias("signature"))
    per_doc = lines.groupBy("signature", "doc_id").agg(F.count(F.lit(1)).alias("n"))  # a hot line counts per document first
    return per_doc.groupBy("signature").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_lines")).filter("n_documents >= 3")


# Units and pairs.
@query("units", f"WITH {UNITS} SELECT * FROM units")
def unit_stream(spark, sf_dir):
    return units.units(spread(load(spark, sf_dir, "documents")))


_MARKER_SQL = units.MARKER.replace("'", "''")


@query("unit_markers", f"WITH {UNITS} SELECT doc_id, idx, regexp_extract(text, '{_MARKER_SQL}', 1) AS marker FROM units")
def unit_markers(spark, sf_dir):
    return units.units(spread(load(spark, sf_dir, "documents"))).select("doc_id", "idx", units.marker(F.col("text")).alias("marker"))


@query(
    "html_units",
    f"""WITH cells AS (
      SELECT page_id, unnest(regexp_extract_all(html, '{units.HTML_TAGGED}', 1)) AS tag, unnest(regexp_extract_all(html, '{units.HTML_TAGGED}', 2)) AS body,
             generate_subscripts(regexp_extract_all(html, '{units.HTML_TAGGED}', 1), 1) AS place
      FROM pages)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS INT) AS idx, lower(tag) AS tag, {_norm('body')} AS text
    FROM cells WHERE {_norm('body')} <> ''""",
)
def html_units(spark, sf_dir):
    return units.html_units(load(spark, sf_dir, "pages"))


@query("near_copy_pairs", f"WITH {PAIRS} SELECT * FROM pairs")
def near_copy_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


_WHOLE = f"""WITH {PAIRS}, tokens AS (
  SELECT doc_id, list_filter({_tokens('text')}, lambda t: NOT regexp_matches(t, '{T.BLANK}')) AS tokens FROM documents
), texts AS (SELECT p.a, p.b, x.tokens AS ta, y.tokens AS tb FROM pairs p JOIN tokens x ON x.doc_id = p.a JOIN tokens y ON y.doc_id = p.b)"""


@query(
    "similarity_bound",
    f"""{_WHOLE}, na AS (SELECT a, b, token, count(*) AS n FROM (SELECT a, b, unnest(ta) AS token FROM texts) GROUP BY ALL),
    nb AS (SELECT a, b, token, count(*) AS n FROM (SELECT a, b, unnest(tb) AS token FROM texts) GROUP BY ALL),
    matched AS (SELECT a, b, CAST(sum(least(na.n, nb.n)) AS BIGINT) AS n_both FROM na JOIN nb USING (a, b, token) GROUP BY ALL)
    SELECT a, b, CAST(len(ta) AS INT) AS n_a, CAST(len(tb) AS INT) AS n_b, coalesce(n_both, 0) AS n_both,
           round(CASE WHEN len(ta) + len(tb) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * least(len(ta), len(tb), coalesce(n_both, 0)) / (len(ta) + len(tb)) END, 6) AS bound
    FROM texts LEFT JOIN matched USING (a, b)""",
)
def similarity_bound(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    tokens = lambda s: docs.select(F.col("doc_id").alias(s), T.content_tokens(F.col("text")).alias(f"t{s}"))
    both = C.near_copy_pairs(docs).select("a", "b").join(tokens("a"), "a").join(tokens("b"), "b")
    return S.upper_bound(both, ["a", "b"], F.col("ta"), F.col("tb"))


@query("similarity_lines", f"WITH {TABLE} SELECT a, b, CAST(dp[len(dp)][1] AS INT) AS kept, round(2.0::DOUBLE * dp[len(dp)][1] / (len(la) + len(lb)), 6) AS similarity FROM tables")
def similarity_lines(spark, sf_dir):
    kept = _paired(spark, sf_dir).withColumn("kept", S.kept(F.col("units_a"), F.col("units_b")))
    return kept.select("a", "b", "kept", F.round(2 * F.col("kept") / (F.size("units_a") + F.size("units_b")), 6).alias("similarity"))


@query("edit_scripts", f"{WALK} SELECT a, b, seq, tag, i, j FROM ops")
def edit_scripts(spark, sf_dir):
    return _ops(spark, sf_dir)


_RUNS = """, turned AS (
  SELECT *, CASE WHEN lag(tag) OVER (PARTITION BY a, b ORDER BY seq) = tag THEN 0 ELSE 1 END AS turn FROM ops
), op_runs AS (
  SELECT a, b, run, tag, min(seq) AS first, max(seq) AS last, count(*) AS n
  FROM (SELECT *, CAST(sum(turn) OVER (PARTITION BY a, b ORDER BY seq) AS BIGINT) AS run FROM turned) GROUP BY a, b, run, tag
)"""


@query("op_runs", f"{WALK}{_RUNS} SELECT * FROM op_runs")
def op_runs(spark, sf_dir):
    return R.runs(_ops(spark, sf_dir), ["a", "b"], "seq", "tag")


@query(
    "gap_blocks",
    f"""{WALK}{_RUNS}, stretches AS (
      SELECT *, run - row_number() OVER (PARTITION BY a, b ORDER BY run) AS stretch FROM op_runs WHERE tag <> 'equal'
    ), numbered AS (
      SELECT *, (row_number() OVER (PARTITION BY a, b, stretch ORDER BY run) - 1) // 2 AS half FROM stretches
    )
    SELECT a, b, min(first) AS first, CAST(coalesce(sum(n) FILTER (tag = 'delete'), 0) AS BIGINT) AS n_deleted, CAST(coalesce(sum(n) FILTER (tag = 'insert'), 0) AS BIGINT) AS n_inserted
    FROM numbered GROUP BY a, b, stretch, half""",
)
def gap_blocks(spark, sf_dir):
    gaps = R.runs(_ops(spark, sf_dir), ["a", "b"], "seq", "tag").filter("tag <> 'equal'")
    pair = Window.partitionBy("a", "b").orderBy("run")
    stretched = gaps.withColumn("stretch", F.col("run") - F.row_number().over(pair))
    half = F.expr("(row_number() OVER (PARTITION BY a, b, stretch ORDER BY run) - 1) div 2")
    count = lambda tag: F.coalesce(F.sum(F.when(F.col("tag") == tag, F.col("n"))), F.lit(0))
    return stretched.withColumn("half", half).groupBy("a", "b", "stretch", "half").agg(F.min("first").alias("first"), count("delete").alias("n_deleted"), count("insert").alias("n_inserted")).drop("stretch", "half")


_SIDES = f"""WITH {PAIRS}, side_a AS (SELECT a, b, unnest(la) AS text FROM paired), side_b AS (SELECT a, b, unnest(lb) AS text FROM paired)"""


def _sides(spark, sf_dir):
    paired = _paired(spark, sf_dir)
    return tuple(paired.select("a", "b", F.explode(f"units_{s}").alias("text")) for s in "ab")


@query("units_in_both", f"{_SIDES} SELECT * FROM side_a INTERSECT ALL SELECT * FROM side_b")
def units_in_both(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return a.intersectAll(b)


@query("units_removed", f"{_SIDES} SELECT * FROM side_a EXCEPT ALL SELECT * FROM side_b")
def units_removed(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return a.exceptAll(b)


@query("units_of_both_sides", f"{_SIDES} SELECT *, 'a' AS side FROM side_a UNION ALL SELECT *, 'b' AS side FROM side_b")
def units_of_both_sides(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))


@query("units_unmatched", f"{_SIDES} SELECT DISTINCT a, b, text FROM side_a x WHERE NOT EXISTS (SELECT 1 FROM side_b y WHERE (x.a, x.b, x.text) = (y.a, y.b, y.text))")
def units_unmatched(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return a.join(b, ["a", "b", "text"], "left_anti").distinct()


_PLACES = f"""WITH {PAIRS}, placed AS (
  SELECT p.a, p.b, x.idx, x.text AS old, y.text AS new FROM pairs p JOIN units x ON x.doc_id = p.a JOIN units y ON y.doc_id = p.b AND x.idx = y.idx)"""
_WORDS = "array_to_string(regexp_extract_all(lower({0}), '" + T.WORD + "'), ' ')"


@query("categorize", f"{_PLACES} SELECT a, b, idx, CASE WHEN old <> new AND {_WORDS.format('old')} = {_WORDS.format('new')} THEN 'punctuation' ELSE 'content' END AS category FROM placed")
def categorize(spark, sf_dir):
    both = _paired(spark, sf_dir).select("a", "b", F.posexplode(F.arrays_zip("units_a", "units_b")).alias("idx", "u")).filter("u.units_a IS NOT NULL AND u.units_b IS NOT NULL")
    return both.select("a", "b", "idx", T.categorize(F.col("u.units_a"), F.col("u.units_b")).alias("category"))


# Comparison: kernels, then numbering and counts.
@query("compare_rows")
def compare_rows(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rows.select("a", "b", "row_idx", "type", "oi", "ni", "cat", F.size("segments").alias("n_segments"), C.row_html().alias("html"))


@query("passages")
def passages(spark, sf_dir):
    return C.passages(_rows(spark, sf_dir))


@query("summary")
def summary(spark, sf_dir):
    return C.summary(_rows(spark, sf_dir))


@query("summary_ignore_case")
def summary_ignore_case(spark, sf_dir):
    return C.summary(C.compare(_paired(spark, sf_dir), ignore_case=True))


@query("merged_order")
def merged_order(spark, sf_dir):
    return C.merged_order(_rows(spark, sf_dir))


@query("change_snippets")
def change_snippets(spark, sf_dir):
    return C.snippets(_rows(spark, sf_dir))


@query("page_plan")
def page_plan(spark, sf_dir):
    return pages.paginate(_rows(spark, sf_dir))


@query("changed_pages")
def changed_pages(spark, sf_dir):
    rows = _kept_rows(spark, sf_dir)
    return report.changed_pages(rows.join(pages.paginate(rows).drop("n_lines"), ["a", "b", "row_idx"]))


@query("report_lines")
def report_lines(spark, sf_dir):
    return report.report_lines(C.summary(_rows(spark, sf_dir)), when=F.lit("2024-01-01 00:00:00").cast("timestamp"))


@query("changed_only_pages")
def changed_only_pages(spark, sf_dir):
    rows = _kept_rows(spark, sf_dir)
    return report.changed_only(rows.join(pages.paginate(rows).drop("n_lines"), ["a", "b", "row_idx"])).select("a", "b", "page", "row_idx", "type")


@query("comment_counts")
def comment_counts(spark, sf_dir):
    return report.comment_counts(comment_changes(spark, sf_dir))


@query("change_list")
def change_list(spark, sf_dir):
    rows = _kept_rows(spark, sf_dir)
    return report.change_list(C.passages(rows), rows)


@query("visible_rows")
def visible_rows(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rows.select("a", "b", "row_idx", "type", report.visible(show_equal=False, show_deletions=False).alias("visible"))


@query("comparison_json")
def comparison_json(spark, sf_dir):
    return C.to_json(_kept_rows(spark, sf_dir))


@query("original_text", f"WITH {PAIRS} SELECT a, b, array_to_string(la, chr(10)) AS text FROM paired WHERE len(la) > 0")
def original_text(spark, sf_dir):
    return C.side_text(_rows(spark, sf_dir), "a")


@query("revised_text", f"WITH {PAIRS} SELECT a, b, array_to_string(lb, chr(10)) AS text FROM paired WHERE len(lb) > 0")
def revised_text(spark, sf_dir):
    return C.side_text(_rows(spark, sf_dir), "b")


# Segments made of each document's lines, in turn equal, deleted and inserted: passages that SQL can count.
_SEGMENTS = f"""WITH {UNITS}, segs AS (
  SELECT doc_id, idx, text, CASE idx % 4 WHEN 1 THEN 'del' WHEN 3 THEN 'ins' ELSE 'eq' END AS m,
         coalesce(left(lead(text) OVER (PARTITION BY doc_id ORDER BY idx), 1), ' ') AS following FROM units
), stretched AS (
  SELECT *, sum(CASE WHEN m = 'eq' AND (regexp_matches(text, '[\\p{{L}}\\p{{N}}]') OR regexp_matches(text || following, '[.!?]["''’”)\\]]*[\\s]')) THEN 1 ELSE 0 END)
            OVER (PARTITION BY doc_id ORDER BY idx) AS stretch FROM segs
), starts AS (
  SELECT doc_id, m, min(idx) AS seg_idx FROM stretched WHERE m <> 'eq' GROUP BY doc_id, m, stretch
)"""


def _made_rows(spark, sf_dir):
    mode = lambda i: F.when(i % 4 == 1, F.lit("del")).when(i % 4 == 3, F.lit("ins")).otherwise(F.lit("eq"))
    segments = F.transform("units", lambda t, i: F.struct(mode(i).alias("m"), t.alias("t"), F.lit(False).alias("b")))
    lists = units.unit_lists(spread(load(spark, sf_dir, "documents")))
    return lists.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"), F.lit(0).alias("row_idx"), F.lit(False).alias("num_changed"), segments.alias("segments"))


@query(
    "passage_numbering",
    f"""{_SEGMENTS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seg_idx) AS INT) AS cid,
        CASE m WHEN 'ins' THEN 'insertion' ELSE 'deletion' END AS category, seg_idx FROM starts""",
)
def passage_numbering(spark, sf_dir):
    return C.passages(_made_rows(spark, sf_dir)).select(F.col("a").alias("doc_id"), "cid", "category", "seg_idx")


@query(
    "segment_snippets",
    f"""WITH {UNITS}, segs AS (
      SELECT doc_id, idx, text, CASE idx % 4 WHEN 1 THEN 'del' WHEN 3 THEN 'ins' ELSE 'eq' END AS m,
             lag(text) OVER w AS before, lead(text) OVER w AS after FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
    SELECT doc_id, idx AS seg_idx, m, right(coalesce(before, ''), 24) || left(text, 200) || left(coalesce(after, ''), 40) AS snippet FROM segs WHERE m <> 'eq'""",
)
def segment_snippets(spark, sf_dir):
    return C.snippets(_made_rows(spark, sf_dir)).select(F.col("a").alias("doc_id"), "seg_idx", "m", "snippet")


@query(
    "segment_html",
    f"""WITH {UNITS}, wrapped AS (
      SELECT doc_id, idx, CASE idx % 4 WHEN 1 THEN '<del>' || t || '</del>' WHEN 3 THEN '<ins>' || t || '</ins>' ELSE t END AS t
      FROM (SELECT doc_id, idx, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM units))
    SELECT doc_id, string_agg(t, '' ORDER BY idx) AS html FROM wrapped GROUP BY doc_id""",
)
def segment_html(spark, sf_dir):
    return _made_rows(spark, sf_dir).filter(F.size("segments") > 0).select(F.col("a").alias("doc_id"), C.row_html().alias("html"))


# Spans, islands, fills and modes.
_SPANS = """WITH a AS (
  SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) OVER w - l_quantity AS BIGINT) AS s, CAST(sum(l_quantity) OVER w AS BIGINT) AS e, l_returnflag AS fmt
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)
), b AS (
  SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) OVER w - l_quantity AS BIGINT) AS s, CAST(sum(l_quantity) OVER w AS BIGINT) AS e, l_returnflag AS fmt
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber DESC)
), joined AS (
  SELECT a.l_orderkey, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e, a.fmt AS fmt_a, b.fmt AS fmt_b
  FROM a JOIN b ON a.l_orderkey = b.l_orderkey AND a.s < b.e AND b.s < a.e
)"""


def _spans(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem")

    def side(order):
        total = F.sum("l_quantity").over(Window.partitionBy("l_orderkey").orderBy(order))
        return items.select("l_orderkey", (total - F.col("l_quantity")).cast("long").alias("s"), total.cast("long").alias("e"), F.col("l_returnflag").alias("fmt"))

    return side(F.col("l_linenumber")), side(F.col("l_linenumber").desc())


@query("span_overlaps", f"{_SPANS} SELECT * FROM joined")
def span_overlaps(spark, sf_dir):
    return R.overlaps(*_spans(spark, sf_dir), ["l_orderkey"])


@query(
    "span_differences",
    f"""{_SPANS}, named AS (SELECT l_orderkey, s, e, fmt_a || ' → ' || fmt_b AS change FROM joined WHERE fmt_a <> fmt_b),
    cut AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY l_orderkey, change ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS c FROM named),
    islands AS (SELECT *, sum(c) OVER (PARTITION BY l_orderkey, change ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM cut)
    SELECT l_orderkey, change, min(s) AS s, max(e) AS e FROM islands GROUP BY l_orderkey, change, g""",
)
def span_differences(spark, sf_dir):
    return R.span_differences(*_spans(spark, sf_dir), ["l_orderkey"])


_BARS = """WITH bars AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(abs(value)) AS BIGINT) * 60000000 AS e FROM events),
cut AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 30000000 THEN 1 ELSE 0 END AS c FROM bars),
islands AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM cut),
merged AS (SELECT user_id, min(s) AS s, max(e) AS e FROM islands GROUP BY user_id, g)"""


def _bars(spark, sf_dir):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return load(spark, sf_dir, "events").select("user_id", micros.alias("s"), (micros + F.floor(F.abs("value")) * 60_000_000).alias("e"))


@query("merged_intervals", f"{_BARS} SELECT * FROM merged")
def merged_intervals(spark, sf_dir):
    return R.merge_touching(_bars(spark, sf_dir), ["user_id"], gap=30_000_000)


@query(
    "interval_coverage",
    """WITH bars AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(abs(value)) AS BIGINT) * 60000000 AS e FROM events),
    cut AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS c FROM bars),
    islands AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM cut),
    merged AS (SELECT user_id, min(s) AS s, max(e) AS e FROM islands GROUP BY user_id, g),
    whole AS (SELECT user_id, min(s) AS s, max(s) AS e FROM bars GROUP BY user_id)
    SELECT w.user_id, w.s, w.e, CAST(sum(greatest(0, least(w.e, m.e) - greatest(w.s, m.s))) AS BIGINT) AS covered FROM whole w JOIN merged m USING (user_id) GROUP BY w.user_id, w.s, w.e""",
)
def interval_coverage(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    return R.coverage(bars, bars.groupBy("user_id").agg(F.min("s").alias("s"), F.max("s").alias("e")), ["user_id"])


@query(
    "number_ranges",
    """WITH d AS (SELECT DISTINCT o_custkey, day(o_orderdate) AS n FROM orders),
    g AS (SELECT *, n - row_number() OVER (PARTITION BY o_custkey ORDER BY n) AS g FROM d),
    r AS (SELECT o_custkey, min(n) AS a, max(n) AS b FROM g GROUP BY o_custkey, g)
    SELECT o_custkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY o_custkey""",
)
def number_ranges(spark, sf_dir):
    return R.compress(load(spark, sf_dir, "orders").select("o_custkey", F.dayofmonth("o_orderdate").alias("n")), ["o_custkey"], "n")


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query(
    "asof_event",
    """WITH ranked AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM events WHERE event_type IN ('click', 'purchase')) SELECT event_id, user_id, before FROM ranked WHERE event_type = 'purchase'""",
)
def asof_event(spark, sf_dir):
    kind = F.col("event_type")
    return R.latest_before(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], kind == "purchase", kind == "click", "event_id", "before").select("event_id", "user_id", "before")


@query(
    "forward_fill",
    """SELECT event_id, last_value(CASE WHEN value > 50 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events""",
)
def forward_fill(spark, sf_dir):
    sparse = _events(spark, sf_dir).withColumn("value", F.when(F.col("value") > 50, F.col("value")))
    return R.forward_fill(sparse, ["user_id"], ["ts", "event_id"], "value", "filled").select("event_id", "filled")


@query(
    "fill_both_ways",
    """SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
      first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled
      FROM (SELECT *, CASE WHEN value > 50 THEN value END AS v FROM events)""",
)
def fill_both_ways(spark, sf_dir):
    sparse = _events(spark, sf_dir).withColumn("value", F.when(F.col("value") > 50, F.col("value")))
    return R.fill_both(sparse, ["user_id"], ["ts", "event_id"], "value", "filled").select("event_id", "filled")


@query(
    "carried_breaks",
    """WITH g AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM events)
    SELECT event_id, event_type = 'purchase' AND max(event_type = 'signup') OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS breaks FROM g""",
)
def carried_breaks(spark, sf_dir):
    flagged = _events(spark, sf_dir).withColumns({"pending": F.col("event_type") == "signup", "receives": F.col("event_type") == "purchase"})
    return R.carry(flagged, ["user_id"], ["ts", "event_id"], "pending", "receives", "breaks").select("event_id", "breaks")


@query(
    "first_references",
    """SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first) AS INT) AS rank
    FROM (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events WHERE event_type IS NOT NULL GROUP BY ALL)""",
)
def first_references(spark, sf_dir):
    return R.first_seen(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type")


@query(
    "mode_least",
    "SELECT o_custkey, m AS mode FROM (SELECT o_custkey, o_orderpriority AS m, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, m) = 1",
)
def mode_least(spark, sf_dir):
    return R.mode_least(load(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority")


@query(
    "mode_first_seen",
    "SELECT user_id, m AS mode FROM (SELECT user_id, event_type AS m, count(*) AS n, min((ts, event_id)) AS began FROM events WHERE event_type IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, began) = 1",
)
def mode_first_seen(spark, sf_dir):
    return R.mode_first(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type")


@query(
    "weighted_mode",
    "SELECT l_suppkey, m AS mode FROM (SELECT l_suppkey, l_returnflag AS m, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, m DESC) = 1",
)
def weighted_mode(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", F.col("l_quantity").cast("long").alias("w"))
    return R.weighted_mode(items, ["l_suppkey"], "l_returnflag", "w")


@query(
    "column_edges",
    """WITH sizes AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL),
    lefts AS (SELECT l_suppkey, min(l_quantity) AS l FROM (SELECT l_suppkey, l_quantity, count(*) AS c FROM lineitem GROUP BY ALL) JOIN sizes USING (l_suppkey) WHERE c >= greatest(2.0, n / 50.0) GROUP BY ALL),
    rights AS (SELECT l_suppkey, l_extendedprice AS r FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS k FROM lineitem) JOIN sizes USING (l_suppkey) WHERE k = n // 200 + 1)
    SELECT s.l_suppkey, l AS "left", r AS "right" FROM sizes s LEFT JOIN lefts USING (l_suppkey) LEFT JOIN rights USING (l_suppkey)""",
)
def column_edges(spark, sf_dir):
    return R.edges(load(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")


# Threads and comments.
@query(
    "reply_threads",
    """WITH RECURSIVE thread AS (
      SELECT conv_id, turn, role, 0 AS depth FROM conversations WHERE turn = 0
      UNION ALL SELECT c.conv_id, c.turn, c.role, t.depth + 1 FROM conversations c JOIN thread t ON c.conv_id = t.conv_id AND c.turn = t.turn + 1)
    SELECT conv_id, turn, role, CAST(depth AS INT) AS depth FROM thread""",
)
def reply_threads(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.struct("conv_id", "turn").alias("id"), F.when(F.col("turn") > 0, F.struct("conv_id", (F.col("turn") - 1).alias("turn"))).alias("parent"))
    return threads.depths(turns).select("conv_id", "turn", "role", "depth")


@query("comment_changes")
def comment_changes(spark, sf_dir):
    """Each conversation's turns as the comments on it, against those of the next one."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), F.col("role").alias("author"), F.coalesce("text", F.lit("")).alias("text"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("id", "author", "text"))).alias("comments"))
    pairs = listed.select(F.col("conv_id").alias("a"), (F.col("conv_id") + 1).alias("b"), F.col("comments").alias("comments_a")).join(listed.select(F.col("conv_id").alias("b"), F.col("comments").alias("comments_b")), "b")
    return threads.compare_comments(pairs)


# Geometry and sources.
@query("tab_stops", "SELECT l_orderkey, l_linenumber, (floor(l_extendedprice / 36.0::DOUBLE + 1e-9::DOUBLE) + 1) * 36.0::DOUBLE AS stop FROM lineitem")
def tab_stops(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.next_tab(F.col("l_extendedprice")).alias("stop"))


@query(
    "packed_boxes",
    """WITH boxes AS (SELECT user_id, event_id, ts, epoch_us(ts) // 1000000 AS want, CAST(1 + floor(abs(value)) AS BIGINT) * 60 AS h FROM events),
    summed AS (SELECT *, coalesce(sum(h + 30) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM boxes)
    SELECT event_id, CAST(above + max(want - above) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS top FROM summed""",
)
def packed_boxes(spark, sf_dir):
    seconds = F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    boxes = _events(spark, sf_dir).select("user_id", "event_id", "ts", seconds.alias("want"), ((1 + F.floor(F.abs("value"))) * 60).alias("h"))
    return geometry.pack(boxes, ["user_id"], "want", "h", 30, ["ts", "event_id"]).select("event_id", F.col("top").cast("long").alias("top"))


@query("tints", "SELECT p_partkey, string_agg(printf('%02x', CAST(round(255 + (CAST(('0x' || substr(c, i, 2)) AS INT) - 255) * 0.15::DOUBLE) AS INT)), '' ORDER BY i) AS tint FROM (SELECT p_partkey, substr(md5(p_name), 1, 6) AS c, unnest([1, 3, 5]) AS i FROM part) GROUP BY p_partkey")
def tints(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", geometry.tint(F.substring(F.md5(F.col("p_name").cast("binary")), 1, 6)).alias("tint"))


@query("distinct_contents", "SELECT sha256(text) AS content, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def distinct_contents(spark, sf_dir):
    """Equal contents once, before any parsing."""
    docs = load(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("content")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


@query("first_paired_rows", f"{_PLACES} SELECT old AS original, min_by(new, (a, b, idx)) AS revised FROM placed GROUP BY old")
def first_paired_rows(spark, sf_dir):
    """For each original line the revised line that it first stands beside."""
    both = _paired(spark, sf_dir).select("a", "b", F.posexplode(F.arrays_zip("units_a", "units_b")).alias("idx", "u")).filter("u.units_a IS NOT NULL AND u.units_b IS NOT NULL")
    return both.groupBy(F.col("u.units_a").alias("original")).agg(F.min_by(F.col("u.units_b"), F.struct("a", "b", "idx")).alias("revised"))


@query("change_marks")
def change_marks(spark, sf_dir):
    """The page on which each numbered change begins."""
    rows = _kept_rows(spark, sf_dir)
    return C.passages(rows).join(pages.paginate(rows), ["a", "b", "row_idx"]).select("a", "b", "cid", "category", "page")


@query("svg_pages")
def svg_pages(spark, sf_dir):
    return draw.svg_pages(draw.layout(_rows(spark, sf_dir)))


@query("change_bars")
def change_bars(spark, sf_dir):
    return draw.change_bars(draw.layout(_rows(spark, sf_dir)))
