"""Quality rules as a bitmask ledger.

Every rule is evaluated once. The ledger keeps the measurements and one failure bit a rule; a policy
is a named set of bits, so that another policy, or the effect of leaving out one rule, is bitwise
arithmetic on the ledger and reads no text again.

DataFrame functions only. Defined cases: a null text is an empty text; an empty text has no words and
fails ``few_words``; repeated rows are judged alike, each by itself; an empty table gives an empty
ledger; input columns with the name of a ledger column are replaced and no other is touched, whatever its
name; a very long text is measured as a whole, in memory in proportion to its words. Three-word windows are
compared by a 64-bit hash within one text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import column, packed, unpacked, words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

#: Rule -> SQL predicate over the measurements that is true where the rule fails. The place is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "duplicate_lines": "n_dup_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "shouting": "2 * n_upper > word_chars",
}
#: Policies by version: the rules whose failure rejects a document.
POLICIES: dict[str, Sequence[str]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def rule_mask(names: Sequence[str], rules: Mapping[str, str] = RULES) -> int:
    order = list(rules)
    return sum(1 << order.index(name) for name in names)


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measured(words: str, lines: str, text: str) -> dict[str, Column]:
    """The measurements that need no window, over columns of words, lines with a word, and the text."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": _without(F.col(text), BLANKS).cast("long"),
        "n_symbols": (F.length(text) - _without(F.col(text), SYMBOLS)).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_upper": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long"),
    }


def ledger(df: DataFrame, text_col: str = "text", rules: Mapping[str, str] = RULES) -> DataFrame:
    """df with the measurements (long) and ``fail_bits`` (long, bit i set where rule i fails)."""
    text = F.coalesce(column(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    out = packed(df, text=text, words=words(column(text_col)), lines=lines)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 3, F.lit(0)))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    out = out.withColumn("windows", F.when(F.size("words") >= 3, hashes))
    # Only texts with some repeated window pay for the sort.
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    out = out.withColumn("sorted", F.when(some, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: (F.get("sorted", i - 1)["h"].eqNullSafe(x["h"])) | (F.get("sorted", i + 1)["h"].eqNullSafe(x["h"]))
    out = out.withColumn("at", F.sort_array(F.transform(F.filter("sorted", same), lambda x: x["i"])))
    reach = F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3))))
    repeated = F.coalesce(F.aggregate(reach, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")
    out = out.select("row", *[c.alias(n) for n, c in (measured("words", "lines", "text") | {"n_repeat_words": repeated}).items()])
    bits = sum((F.when(F.expr(sql), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, sql in enumerate(rules.values())), F.lit(0).cast("long"))
    return unpacked(out, df.columns, **{m: F.col(m) for m in MEASURES}, fail_bits=bits)


def apply_policy(judged: DataFrame, policy: str = "v1", rules: Mapping[str, str] = RULES, policies: Mapping[str, Sequence[str]] = POLICIES, out: str = "kept") -> DataFrame:
    """The ledger with the verdict of one policy."""
    return judged.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(rule_mask(policies[policy], rules))) == 0)


def ablations(judged: DataFrame, policy: str = "v1", by: Sequence[str] = (), rules: Mapping[str, str] = RULES, policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """For each rule of a policy (and each value of ``by``): n_failed, n_failed_alone (that the policy would keep without it), n_kept_without.

    One aggregation over the ledger's bits, combined in the tasks: a document that the rest of the policy
    passes has no bit but the rule's own; ``together`` gathers the bits that ever fail beside the rule's.
    """
    names = list(policies[policy])
    hit = F.col("fail_bits").bitwiseAND(F.lit(rule_mask(names, rules)))
    cells = []
    for name in names:
        bit = F.lit(rule_mask([name], rules))
        own, rest = hit.bitwiseAND(bit), hit.bitwiseAND(F.bitwise_not(bit))
        cells.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.count_if(own != 0).alias("n_failed"),
                F.count_if((own != 0) & (rest == 0)).alias("n_failed_alone"),
                F.count_if(rest == 0).alias("n_kept_without"),
                F.coalesce(F.bit_or(F.when(own != 0, rest)), F.lit(0)).cast("long").alias("together"),
            )
        )
    return judged.groupBy(*by).agg(F.array(*cells).alias("cells")).select(*by, F.inline("cells"))


def filter_documents(df: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of df that a policy keeps, with df's columns."""
    judged = apply_policy(ledger(packed(df, text=column(text_col))), policy)
    # Without a column that depends on the place of a row, the optimizer would push the filter below the
    # measurements and spell each of them out as often as the rules mention it.
    judged = judged.withColumn("place", F.monotonically_increasing_id())
    return unpacked(judged.filter("kept AND place >= 0"), df.columns)
