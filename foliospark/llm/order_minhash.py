"""Near-duplicates by Order MinHash, verified by banded alignment.

A document is a sequence of words. Its k-mers (five words) carry the number of their occurrence in it,
so that repeats count. For each of ``SKETCHES`` random orders the ``PICKS`` smallest labelled k-mers
are kept in the order of the text; their hash is one sketch. Two texts share a sketch the likelier the
more of both their content and its order they share.

Equal texts are one node. Nodes that share a sketch form a bucket; each meets the least node of its
bucket, and, as a bucket may hold many unlike texts (a passage that many documents quote), also the
least node of the finer buckets that two and three sketches in a row make. That links most copies with at
most 3n pairs of a bucket of n nodes. What is left are buckets whose nodes are in several classes by then.
There every two classes meet that hold a rare word in common, or many rare word pairs where they are long, as all texts
that are alike do (see ``drawn``): first two of their nodes, then, where the classes are still apart, all nodes of both (see ``between``). So no pair of a bucket
is lost. Only this last step grows with the square of a group: of the unlike classes that hold a rare word. A pair is a link where the edit distance over words, aligned in the
band that the threshold leaves, is at most (1 - similarity) of the longer text. The classes are the
connected components of the links; a class is named by its least id.

Each node is verified first with the leader that it shares most buckets with, and then with those of the
others that are not in its class by then. Pairs are verified beside the leader's text in portions of ``PORTION``
members, so a leader with very many near copies is many tasks' work. Hot buckets are dealt to many tasks by a salt.

Alignment is exact, on the words themselves: a bit vector holds the band of one column of the table of edit
distances, and a word of the other text moves it on, in a few operations on whole numbers as wide as the band.
Its time grows with the product of a text's words and the band's width over a machine word: two texts of
20,000 words take about 0.1 s, of 200,000 words about 10 s, in one task.

Defined cases: a null text is an empty text; texts without words are equal to each other only if they
are the same text; a text under five words has one k-mer, all of it; rows that share an id are one
document, with the links of all their texts; null ids are kept, without links; ties of sketches, leaders and
rare words go to the lesser hash or id; an empty table gives an empty table; the output columns replace input
columns of the same name, and no other column is touched, whatever its name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import COLD, column, dropped, hot_join, packed, unpacked, written
from foliospark.llm.wordhash import U, _numbers, mix, slices, windows

K = 5
SKETCHES = 48
PICKS = 2
SIMILARITY = 0.8
PORTION = 32
#: Numbers that a sketch makes at once.
CELLS = 1 << 20
#: Words of a portion of a class of strangers.
WORDS = 1 << 16
#: Slots that count how often words stand in the texts that are left: 4 MB that each task gets.
SLOTS = 1 << 20
#: Numbers of 64 bits in a signature.
SIGNS = 16
#: Words from which a signature is too full to tell texts apart, so that word pairs are counted instead.
LONG = 512
#: Of so many words of a long text one rare word pair at least is in all that is alike to it.
SHARED = 10
#: Similarity from which texts that are alike have that many word pairs in common.
COUNTED = 0.6


def _occurrences(kmers: np.ndarray) -> np.ndarray:
    """How often each k-mer stood before in the text."""
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    new = np.ones(len(kmers), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(kmers), U)
    at = np.arange(len(kmers))
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def sketch(kmers: np.ndarray, sketches: int = SKETCHES, picks: int = PICKS) -> np.ndarray:
    """The sketches (64-bit hashes) of a text's k-mer hashes."""
    labelled = mix(kmers + _occurrences(kmers) * U(0x9E3779B97F4A7C15))
    factors = _numbers(77, sketches) | U(1)
    out = np.empty(sketches, U)
    step = max(1, CELLS // len(kmers))
    for i in range(0, sketches, step):
        ranks = factors[i : i + step, None] * labelled[None, :]
        at = []
        for _ in range(min(picks, len(kmers))):
            least = ranks.argmin(axis=1)
            at.append(least)
            ranks[np.arange(len(ranks)), least] = U(2**64 - 1)
        h = np.zeros(len(ranks), U)
        for place in np.sort(np.stack(at, axis=1), axis=1).T:
            h = mix(h * U(31) + labelled[place])
        out[i : i + step] = h
    return out


class Sequence:
    """A text's words, and how often it has each."""

    def __init__(self, raw: bytes) -> None:
        self.words = raw.split()  # at the bytes that break words
        self.counts = Counter(self.words)


def shared_words(a: Sequence, b: Sequence) -> int:
    """Words in common, repeats counted: no alignment matches more."""
    few, many = sorted((a.counts, b.counts), key=len)
    return sum(min(n, many[w]) for w, n in few.items() if w in many)


def aligned(a: list, b: list, limit: int) -> int | None:
    """The edit distance of two lists if it is at most limit, else None.

    Bit t of a column's vectors is row column - limit + t of the table, so the band moves down a row with each
    column. ``up`` and ``down`` are the rows where the distance is one more, or one less, than in the row above.
    """
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[head:], b[head:]
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > limit:
        return None
    limit = min(limit, n)
    asked, rows = set(b), {}  # word -> its rows
    for i, x in enumerate(a):
        if x in asked:
            rows.setdefault(x, []).append(i)
    # Words that are often in a are kept as bits of all rows: few enough to take some hundred bytes a word of a.
    masks = {x: _bits(at, n) for x, at in rows.items() if len(at) > max(16, n // 1000)}
    width = 2 * limit + 1
    band, top = (1 << width) - 1, 1 << (width - 1)
    up, down, distance = band & ~((1 << limit) - 1), 0, limit
    for column in range(1, m + 1):
        word, low = b[column - 1], column - limit - 1
        if word in masks:
            here = (masks[word] >> low if low >= 0 else masks[word] << -low) & band
        else:
            at = rows.get(word, ())
            here = 0
            for i in at[bisect_left(at, low) : bisect_left(at, low + width)] if at else ():
                here |= 1 << (i - low)
        same = (((here & up) + up) ^ up) | here | down  # as far as the cell diagonally above
        same &= band
        right = down | (band & ~(same | up))  # one more than the cell to the left
        left = same & up
        if column <= n - limit:
            distance += not same & top  # along the band's lower edge, down to the last row
            if distance - (m - (n - limit)) > limit:
                return None
        else:
            last = 1 << (n - column + limit)
            distance += bool(right & last) - bool(left & last)
        same >>= 1
        up, down = left | (band & ~(same | right)), same & right
    return distance if distance <= limit else None


def _bits(at: list[int], n: int) -> int:
    """The number with these bits, all below n."""
    flags = np.zeros(n, np.uint8)
    flags[at] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def alike(a: Sequence, b: Sequence, similarity: float) -> bool:
    """Whether at most 1 - similarity of the longer text's words are edited."""
    longer = max(len(a.words), len(b.words))
    limit = int((1 - similarity) * longer + 1e-9)
    if abs(len(a.words) - len(b.words)) > limit or shared_words(a, b) < longer - limit:
        return False
    return aligned(a.words, b.words, limit) is not None


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text of the rows that have an id."""
    return df.select(column(id_col).cast("long").alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text")).filter("id IS NOT NULL")


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, n: int = SKETCHES, picks: int = PICKS) -> DataFrame:
    """id, text_key, n_words and sketches of each row."""

    @F.arrow_udf("struct<n_words:int,sketches:array<long>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            counts, made, ends = [], [np.empty(0, U)], [0]
            for first, end, words in slices(texts):
                hashes = words.hashes()
                kmers = windows(hashes, k)
                for a, b in zip(words.first[: end - first], words.first[1:], strict=True):
                    counts.append(b - a)
                    if b > a:
                        made.append(sketch(kmers[a : b - k + 1] if b - a >= k else windows(hashes[a:b], b - a), n, picks))
                    ends.append(ends[-1] + (n if b > a else 0))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(made).view(np.int64)))
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int32()), lists], names=["n_words", "sketches"])

    return texts_of(df, id_col, text_col).select("id", F.md5(F.col("text").cast("binary")).alias("text_key"), run("text").alias("s")).select("id", "text_key", "s.n_words", "s.sketches")


def candidates(nodes: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Pairs id, leader that share a sketch and whose lengths allow a link, with the number of buckets they share; and k0, id, n_words of the members of all buckets."""
    each = nodes.select("id", "n_words", "sketches", F.posexplode("sketches").alias("at", "_s"))
    after = lambda i: F.get("sketches", F.pmod(F.col("at") + i, F.size("sketches")))
    keys = [F.xxhash64("at", "_s"), F.xxhash64("at", "_s", after(1)), F.xxhash64("at", "_s", after(1), after(2))]
    each = each.select("id", "n_words", *[key.alias(f"k{i}") for i, key in enumerate(keys)])
    pairs, made = None, []
    for i in range(len(keys)):
        least = F.min(F.struct("id", "n_words")).alias("leader")
        buckets = written(each.groupBy(f"k{i}").agg(least, F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
        made.append(buckets)
        each = hot_join(each, buckets, f"k{i}", "size", F.col("id"), buckets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
        if not i:
            each = members = written(each, "bucket-members")
        found = each.filter("id <> leader.id").select("id", "n_words", "leader")
        pairs = found if pairs is None else pairs.unionByName(found)
        each = each.filter("size > 2").drop("leader", "size")
    near = F.least("n_words", "leader.n_words") >= similarity * F.greatest("n_words", "leader.n_words") - 1e-6
    found = written(pairs.filter(near).groupBy("id", F.col("leader.id").alias("leader")).agg(F.count(F.lit(1)).alias("shared")), "pairs")
    dropped(*made)
    return found, members


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Hashes of words with the number of their occurrence in the text, so that repeats count."""
    return mix(hashes + _occurrences(hashes) * U(0x9E3779B97F4A7C15))


def signatures(texts: DataFrame) -> DataFrame:
    """class, ones and zeros: the bits that are set in the signature of each of its texts, and those that are in none.

    A bit of a signature says whether the words (repeats count) that fall to it are odd in number, so two texts
    differ in at most as many bits as they have words that are not in the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = np.asarray(batch.column("class"))
            for first, end, words in slices(batch.column("text")):
                hashes = words.hashes()
                odd = np.zeros((end - first, 64 * SIGNS), np.uint8)
                for i in range(end - first):
                    at = labelled(hashes[words.first[i] : words.first[i + 1]]) % U(64 * SIGNS)
                    odd[i] = np.bincount(at.astype(np.int64), minlength=64 * SIGNS) & 1
                signs = np.packbits(odd, axis=1).view(np.int64)
                names = ["class", *[f"s{i}" for i in range(SIGNS)]]
                yield pa.RecordBatch.from_arrays([pa.array(classes[first:end]), *[pa.array(signs[:, i].copy()) for i in range(SIGNS)]], names=names)

    each = texts.select("class", "text").mapInArrow(run, "class long, " + ", ".join(f"s{i} long" for i in range(SIGNS)))
    ones = F.struct(*[F.bit_and(f"s{i}").alias(f"s{i}") for i in range(SIGNS)]).alias("ones")
    zeros = F.struct(*[F.bitwise_not(F.bit_or(f"s{i}")).alias(f"s{i}") for i in range(SIGNS)]).alias("zeros")
    return each.groupBy("class").agg(ones, zeros)


def drawn(hashes: np.ndarray, similarity: float) -> Iterator[tuple[bool, np.ndarray, int]]:
    """What a text may meet others by: whether as a long one, its words or word pairs (hashes; repeats count), and how many of the rarest are enough.

    Of two texts that are alike the longer keeps n - limit of its n words: in any one order of all words the first
    limit + 1 of both have one in common; a shorter text's own limit is enough, as it is shorter. An edit takes two
    word pairs at most (a mark before the first word makes them as many as words), so n - 2 * limit of these are kept and
    the first 2 * limit + k have k in common; the limits of texts that differ by a word may take one more. Texts are
    short where they may be alike to one under ``LONG`` words, and long from there, so some are both.
    """
    n = len(hashes)
    limit = int((1 - similarity) * n + 1e-9)
    if similarity < COUNTED or n * similarity < LONG:
        yield False, labelled(hashes), limit + 1
    if similarity >= COUNTED and n >= LONG:
        yield True, labelled(windows(np.concatenate([np.zeros(1, U), hashes]), 2)), 2 * limit + n // SHARED + 1


def rare(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """id, n_words, long, word, before: the rarest words, or word pairs, of each text that those alike to it share (see ``drawn``), and the word before each in this order.

    How rare a word is, is read from counts in ``SLOTS`` slots, a table of fixed size; words that share a slot only cost
    selectivity. A passage that many texts quote is frequent, so it counts only in texts that hold little else.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for first, end, words in slices(batch.column("text")):
                hashes = words.hashes()
                for i in range(end - first):
                    for _, mine, _ in drawn(hashes[words.first[i] : words.first[i + 1]], similarity):
                        np.add.at(total, (mine % U(SLOTS)).astype(np.int64), 1)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    found = texts.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(SLOTS, np.float32)
    often[found.column("slot").to_numpy()] = found.column("n").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            for first, end, words in slices(batch.column("text")):
                hashes = words.hashes()
                own, sizes, kinds, out, before, heads = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, bool)], [np.empty(0, U)], [np.empty(0, U)], [np.empty(0, bool)]
                for i in range(end - first):
                    n = int(words.first[i + 1] - words.first[i])
                    for long, mine, enough in drawn(hashes[words.first[i] : words.first[i + 1]], similarity):
                        order = np.lexsort((mine, often[(mine % U(SLOTS)).astype(np.int64)]))
                        out.append(mine[order[:enough]])
                        k = len(out[-1])
                        before.append(np.roll(out[-1], 1))
                        heads.append(np.arange(k) == 0)
                        own.append(np.full(k, ids[first + i], np.int64))
                        sizes.append(np.full(k, n, np.int32))
                        kinds.append(np.full(k, long))
                columns = [np.concatenate(own), np.concatenate(sizes), np.concatenate(kinds), np.concatenate(out).view(np.int64)]
                last = pa.array(np.concatenate(before).view(np.int64), mask=np.concatenate(heads))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), last], names=["id", "n_words", "long", "word", "before"])

    return texts.select("id", "text").mapInArrow(run, "id long, n_words int, long boolean, word long, before long")


def strangers(df: DataFrame, members: DataFrame, known: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """id, n_words and class of the nodes of buckets with several classes; and all pairs a, b of these classes whose nodes may be alike, with two nodes id, leader that may be (null if the two that were looked at may not).

    A class is one row of a word, however many of its nodes hold it, so the rows grow with the square of the
    classes that hold a rare word, not of its holders; words that many classes hold are dealt to many tasks. Two
    nodes that share a word and also the word before it meet by that one already. Classes of which no two texts can be
    alike by their signatures do not meet: what is alike differs in at most twice the words that may be edited.
    Signatures of long texts tell nothing; their classes meet by the number of rare word pairs in common (see ``drawn``).
    """
    # By merge at every size, as in verified.
    classed = members.select("k0", "id", "n_words").join(known.hint("merge"), "id", "left").select("k0", "id", "n_words", F.coalesce("class", "id").alias("class"))
    several = classed.groupBy("k0").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("k0")
    left = classed.join(several.hint("merge"), "k0").select("id", "n_words", "class").distinct()
    nodes = written(left.groupBy("id", "class").agg(F.sum("n_words").alias("n_words")), "strangers")  # an id may have several texts
    of = nodes.select("id", "class")
    texts = written(texts_of(df, id_col, text_col).join(of.hint("merge"), "id"), "strangers-texts")
    last = F.when((F.count("before") == F.count(F.lit(1))) & (F.min("before") == F.max("before")), F.min("before")).alias("before")
    held = of.join(rare(texts, similarity).hint("merge"), "id").groupBy("long", "word", "class")
    held = written(held.agg(F.min("n_words").alias("low"), F.max("n_words").alias("high"), last, F.min(F.struct("id", "n_words")).alias("of")), "rare-words")
    words = held.groupBy("long", "word").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1").select("long", "word", F.ceil(F.col("holders") / COLD).cast("int").alias("parts"))
    signs = written(signatures(texts), "signatures")
    near = lambda least, most: least >= similarity * most - 1e-6
    two = F.when(near(F.least("of.n_words", "of_a.n_words"), F.greatest("of.n_words", "of_a.n_words")), F.struct(F.col("of.id").alias("id"), F.col("of_a.id").alias("leader")))

    def meeting(each: DataFrame, *more: str) -> DataFrame:
        """Every two classes of a word that may be alike by their lengths."""
        names = ["class", "low", "high", "of", *more]
        mine = each.select("word", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("part"), *names)
        theirs = each.select("word", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"{c}_a") for c in names])
        both = mine.join(theirs.hint("merge"), ["word", "part"])
        return both.filter((F.col("class_a") < F.col("class")) & near(F.least("high", "high_a"), F.greatest("low", "low_a")))

    each = written(held.filter("NOT long").join(words.filter("NOT long").drop("long").hint("merge"), "word").join(signs.hint("merge"), "class"), "holders")
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"ones.s{i}").bitwiseAND(F.col(f"zeros_a.s{i}")).bitwiseOR(F.col(f"zeros.s{i}").bitwiseAND(F.col(f"ones_a.s{i}")))) for i in range(SIGNS)])
    short = meeting(each, "before", "ones", "zeros").filter(
        ~F.coalesce(F.col("before") == F.col("before_a"), F.lit(False)) & (differ <= 2 * (1 - similarity) * F.greatest("high", "high_a") + 1e-6)
    )
    short = short.groupBy(F.col("class_a").alias("a"), F.col("class").alias("b")).agg(F.min(two).alias("two"))
    paired = written(held.filter("long").join(words.filter("long").drop("long").hint("merge"), "word").select("word", "parts", "class", "low", "high", "of"), "pair-holders")
    long = meeting(paired).groupBy(F.col("class_a").alias("a"), F.col("class").alias("b"))
    long = long.agg(F.min(two).alias("two"), F.count(F.lit(1)).alias("n"), F.min(F.least("low", "low_a")).alias("low")).filter(F.col("n") >= F.floor(F.col("low") / SHARED))
    pairs = short.unionByName(long.select("a", "b", "two")).groupBy("a", "b").agg(F.min("two").alias("two")).select("a", "b", "two.*")
    pairs = written(pairs, "pairs-classes")
    dropped(texts, held, signs, each, paired)
    return nodes, pairs


def verified(df: DataFrame, pairs: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs that are links."""
    heads = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / PORTION).cast("int").alias("portions"))
    members = pairs.join(heads, "leader").select("id", "leader", F.pmod(F.xxhash64("id"), F.col("portions")).cast("int").alias("portion"), F.lit(1).alias("role"))
    leaders = heads.select(F.col("leader").alias("id"), "leader", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), F.lit(0).alias("role"))
    asked = members.unionByName(leaders)
    texts = texts_of(df, id_col, text_col)
    # By merge at every size, so that what large tables cost shows on small ones.
    together = texts.join(asked.hint("merge"), "id").repartition("leader", "portion").sortWithinPartitions("leader", "portion", "role", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, heads = None, []
        for batch in batches:
            ids, out = [], []
            texts = batch.column("text").cast(pa.binary())
            for i, (leader, portion, role, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("leader", "portion", "role", "id")), strict=True)):
                if place != (leader, portion):
                    place, heads = (leader, portion), []
                sequence = Sequence(texts[i].as_py())
                if not role:
                    heads.append(sequence)  # more than one only where rows share the leader's id
                elif any(alike(sequence, head, similarity) for head in heads):
                    ids.append(own)
                    out.append(leader)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.int64())], names=["id", "leader"])

    return together.select("leader", "portion", "role", "id", "text").mapInArrow(run, "id long, leader long").distinct()


def between(df: DataFrame, nodes: DataFrame, pairs: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """Links between the classes a, b of each pair: one at least if any two of their nodes are alike.

    The larger class of a pair is cut into portions by nodes and by words, and each meets all nodes of the other
    class; so a text is sent once for ``PORTION`` others, and a class that is linked is not looked at again there.
    """
    sizes = written(nodes.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("n_words")), "class-sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cuts = F.greatest(F.ceil(F.col("n") / PORTION), F.ceil(F.col("n_words") / WORDS)).cast("int")
    size = lambda c: sizes.select(F.col("class").alias(c), F.struct(F.col("n"), F.col("class").alias("class"), cuts.alias("cuts")).alias(f"of_{c}"))
    both = pairs.select("a", "b").join(size("a").hint("merge"), "a").join(size("b").hint("merge"), "b")
    asked = both.select(F.greatest("of_a", "of_b").alias("h"), F.least("of_a", "of_b").alias("o")).select(F.col("h.class").alias("head"), F.col("h.cuts").alias("cuts"), F.col("h.n").alias("n_head"), F.col("o.class").alias("other"), F.col("o.n").alias("n_other"))
    asked = written(asked, "classes-apart")
    heads = asked.groupBy("head").agg(F.max("n_head").alias("n"), F.max("cuts").alias("cuts"), F.ceil(F.sum("n_other") / PORTION).cast("int").alias("portions"))
    heads = written(heads, "heads")
    others = asked.join(heads.select("head", "portions").hint("merge"), "head").groupBy(F.col("other").alias("class")).agg(F.max("n_other").alias("n"), F.collect_list(F.struct("head", "cuts", "portions")).alias("heads"))
    others = written(others, "others")
    of = nodes.select("id", "class")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    led = hot_join(of, heads.withColumnRenamed("head", "class"), "class", "n", F.col("id"), total)
    led = led.select("id", F.col("class").alias("head"), place("cuts").alias("cut"), upto("portions").alias("portion"), F.lit(0).alias("role"), F.col("class").alias("other"))
    met = hot_join(of, others, "class", "n", F.col("id"), total).select("id", "class", F.explode("heads").alias("h")).select("id", "class", "h.*")
    met = met.select("id", "head", upto("cuts").alias("cut"), place("portions").alias("portion"), F.lit(1).alias("role"), F.col("class").alias("other"))
    places = written(led.unionByName(met), "places")
    dropped(sizes, asked, heads, others)
    key = ["head", "cut", "portion"]
    together = texts_of(df, id_col, text_col).join(places.hint("merge"), "id").repartition(*key).sortWithinPartitions(*key, "role", "other", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads, linked = None, [], None
        for batch in batches:
            ids, out = [], []
            texts = batch.column("text").cast(pa.binary())
            for i, (*here, role, other, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*key, "role", "other", "id")), strict=True)):
                if at != here:
                    at, heads, linked = here, [], None
                if not role:
                    heads.append((own, Sequence(texts[i].as_py())))
                elif other != linked:
                    sequence = Sequence(texts[i].as_py())
                    if (found := next((head for head, words in heads if alike(sequence, words, similarity)), None)) is not None:
                        ids.append(own)
                        out.append(found)
                        linked = other
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.int64())], names=["id", "leader"])

    out = written(together.select(*key, "role", "other", "id", "text").mapInArrow(run, "id long, leader long").distinct(), "verified")
    dropped(places)
    return out


def components(links: DataFrame, a: str = "id", b: str = "leader") -> DataFrame:
    """id, class of every end of a link: the least id that links lead to.

    Each round gives every node the least label next to it, then the label of its label. A round is
    written to the shared folder; rounds go on until no label changes.
    """
    edges = written(links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "links")
    labels = written(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).select(F.col("x").alias("id"), "label"), "labels")
    while True:
        offered = edges.join(labels.select(F.col("id").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("offer"))
        near = labels.join(offered.withColumnRenamed("x", "id"), "id").select("id", "label", F.least("label", "offer").alias("new"))
        above = labels.select(F.col("id").alias("new"), F.col("label").alias("top"))
        jumped = near.join(above, "new", "left").select("id", F.least("new", F.coalesce("top", "new")).alias("to"), "label")
        moved = written(jumped, "labels")
        dropped(labels)
        if not moved.filter("to < label").head(1):
            dropped(edges)
            return moved.select("id", F.col("to").alias("class"))
        labels = moved.select("id", F.col("to").alias("label"))


def waves(df: DataFrame, pairs: DataFrame, before: list[DataFrame], id_col: str, text_col: str, similarity: float = SIMILARITY) -> list[DataFrame]:
    """Links that, with those before, hold the classes of all pairs together.

    Each id first meets the leader that it shares most with. Of the other pairs only those are left to
    verify whose ends the links have not brought into one class yet.
    """
    chosen = pairs.groupBy("id").agg(F.max(F.struct("shared", (-F.col("leader")).alias("minus"))).alias("best")).select("id", (-F.col("best.minus")).alias("leader"))
    first = written(verified(df, chosen, id_col, text_col, similarity), "verified")
    known = components(reduce(DataFrame.unionByName, before, first))
    of = lambda c: known.select(F.col("id").alias(c), F.col("class").alias(f"class_{c}"))
    apart = pairs.select("id", "leader").join(of("id"), "id", "left").join(of("leader"), "leader", "left")
    apart = apart.filter(F.coalesce("class_id", "id") != F.coalesce("class_leader", "leader")).select("id", "leader").join(chosen, ["id", "leader"], "left_anti")
    apart = written(apart, "pairs-apart")
    second = written(verified(df, apart, id_col, text_col, similarity), "verified")
    dropped(known, apart)
    return [first, second]


def linked(df: DataFrame, pairs: DataFrame, members: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """Links that hold the classes of all nodes that share a sketch together: of the pairs with leaders, then of the classes of strangers that these leave, first by two nodes of each pair of classes, then by all."""
    links = waves(df, pairs, [], id_col, text_col, similarity)
    known = components(reduce(DataFrame.unionByName, links))
    nodes, met = strangers(df, members, known, id_col, text_col, similarity)
    links.append(written(verified(df, met.filter("id IS NOT NULL").select("id", "leader"), id_col, text_col, similarity), "verified"))
    joined = components(reduce(DataFrame.unionByName, links))
    of = lambda c: joined.select(F.col("id").alias(c), F.col("class").alias(f"class_{c}"))
    size = lambda c: nodes.groupBy(F.col("class").alias(c)).agg(F.count(F.lit(1)).alias(f"n_{c}"))
    apart = met.select("a", "b").join(size("a").hint("merge"), "a").join(size("b").hint("merge"), "b").filter("n_a > 1 OR n_b > 1")
    apart = apart.join(of("a").hint("merge"), "a", "left").join(of("b").hint("merge"), "b", "left").filter(F.coalesce("class_a", "a") != F.coalesce("class_b", "b"))
    apart = written(apart.select("a", "b"), "pairs-apart")
    links.append(between(df, nodes, apart, id_col, text_col, similarity))
    out = written(reduce(DataFrame.unionByName, links), "links")
    dropped(*links, known, nodes, met, joined, apart)
    return out


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """id_col, class_id, n_joined and is_kept (the least id of its class), one row per row of df.

    n_joined counts the verified links that hold the class together, not all partners: pairs whose ends
    are in one class already are not verified.
    """
    table = written(sketches(df, id_col, text_col), "sketches")
    nodes = table.groupBy("text_key").agg(F.min(F.struct("id", "n_words", "sketches")).alias("least")).select("text_key", "least.*")
    nodes = written(nodes, "nodes")
    pairs, members = candidates(nodes, similarity)
    links = linked(df, pairs, members, id_col, text_col, similarity)
    dropped(pairs, members)
    # Texts of one id are one document.
    same_id = table.join(nodes.select("text_key", F.col("id").alias("leader")), "text_key").filter("id <> leader").select("id", "leader", "text_key")
    shared = same_id.join(table.groupBy("id").agg(F.min("text_key").alias("t0"), F.max("text_key").alias("t1")).filter("t0 <> t1").select("id"), "id", "left_semi").select("id", "leader")
    found = components(links.unionByName(shared))
    degree = links.select("id").unionByName(links.select(F.col("leader").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n_joined"))
    of_text = nodes.select("text_key", "id").join(found, "id", "left").join(degree, "id", "left").select("text_key", F.coalesce("class", "id").alias("class_id"), F.coalesce("n_joined", F.lit(0)).alias("n_joined"))
    rows = table.select("id", "text_key").join(of_text, "text_key")
    known = rows.select(F.col("id").alias(id_col), "class_id", "n_joined", (F.col("id") == F.col("class_id")).alias("is_kept"))
    lost = df.select(column(id_col).cast("long").alias(id_col)).filter(column(id_col).isNull()).select(column(id_col), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_joined"), F.lit(True).alias("is_kept"))
    out = written(known.unionByName(lost), "classes")
    dropped(table, nodes, links, found)
    return out


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of df for each class: the one with its least id (of rows that repeat that id, the least)."""
    ids = classes(df, id_col, text_col, similarity).filter(F.col("is_kept") & column(id_col).isNotNull()).select(column(id_col).alias("id")).distinct()
    rows = packed(df, id=column(id_col).cast("long"), text=column(text_col))
    first = Window.partitionBy("id").orderBy("text")  # the join has dealt the rows by id already
    single = rows.filter("id IS NOT NULL").join(ids, "id", "left_semi").withColumn("place", F.row_number().over(first)).filter("place = 1")
    return unpacked(single.select("row").unionByName(rows.filter("id IS NULL").select("row")), df.columns)
