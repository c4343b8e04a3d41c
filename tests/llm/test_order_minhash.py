import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import order_minhash as O
from foliospark.llm.wordhash import mix


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


WORDS = st.lists(st.integers(0, 4), max_size=14)


@settings(max_examples=500, deadline=None)
@given(a=WORDS, b=WORDS, limit=st.integers(0, 14))
def test_banded_alignment(a, b, limit):
    x, y = (O.Sequence(b" \t".join(b"%d" % w for w in v)) for v in (a, b))
    d = distance(a, b)
    assert O.aligned(x.words, y.words, limit) == (d if d <= limit else None)
    assert O.shared_words(x, y) >= max(len(a), len(b)) - d
    assert O.alike(x, y, 0.7) == (d <= 0.3 * max(len(a), len(b)) + 1e-9)


def test_long_texts_align():
    rng = random.Random(5)
    a = [rng.randrange(4000) for _ in range(30_000)]
    b = list(a)
    for i in rng.sample(range(30_000), 200):
        b[i] = 5000 + i
    assert O.aligned(a, b, 6000) == 200 and O.aligned(a, b, 199) is None
    assert O.aligned(a, a[7:], 6000) == 7 and O.aligned(a, b[::-1], 6000) is None


def test_order_and_repeats_count():
    a = mix(np.arange(40, dtype=np.uint64))
    assert (O.sketch(a) == O.sketch(a)).all() and not (O.sketch(a) == O.sketch(a[::-1].copy())).any()
    twice = np.concatenate([a, a])
    assert (O.sketch(twice) != O.sketch(a)).any()
    assert len(O.sketch(a[:1])) == O.SKETCHES


def brute(texts):
    words = [(t or "").split() for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            n = max(len(words[i]), len(words[j]))
            if (n and distance(words[i], words[j]) <= 0.2 * n + 1e-9) or (texts[i] or "") == (texts[j] or ""):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_classes_against_brute_force(spark, docs):
    rng = random.Random(3)
    texts = [None, "", "  ", "one two", "one two", "one  two", "x"]
    passage = " ".join(f"p{rng.randrange(900)}" for _ in range(25))
    for g in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([30, 80, 200]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4, 15])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
        texts.append(passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(20)))
    rng.shuffle(texts)
    df = docs(texts).withColumnRenamed("lang", "class_id").selectExpr("*", "1 AS _kept_id", "2 AS _place", "3 AS id", "4 AS row", "5 AS place")
    got = {r.doc_id: r for r in O.classes(df).collect()}
    want = brute(texts)
    blank = {i for i, t in enumerate(texts) if t is not None and not t.split() and t != ""}
    for i, w in enumerate(want):
        assert got[i].class_id == (i if i in blank and texts.index(texts[i]) == i else w), (i, texts[i])
        assert got[i].is_kept == (got[i].class_id == i)
    kept = O.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({r.class_id for r in got.values()})


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "g h i j k l"), (3, "g h i j k l"), (None, "g h i j k l"), (4, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.class_id) for r in O.classes(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (1, 1), (2, 1), (2, 1), (3, 1), (None, None), (4, 4)], key=str)
    assert sorted((r.doc_id or 0, r.text) for r in O.keep_one(df).collect()) == [(0, "g h i j k l"), (1, "a b c d e f"), (4, "m")]
    assert O.classes(df.limit(0)).count() == 0


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "id long, leader long")
    assert {r.id: r["class"] for r in O.components(links).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_copies_around_a_template_of_older_texts(spark, docs):
    rng = random.Random(11)
    texts, pairs = [], []
    edited = lambda words, n: [f"n{rng.randrange(10**9)}" if i in at else w for at in [set(rng.sample(range(len(words)), n))] for i, w in enumerate(words)]
    for g in range(24):
        template = [f"t{g}x{i}" for i in range(150)]
        own = lambda: template + [f"u{rng.randrange(10**9)}" for _ in range(50)]
        texts += [" ".join(own()) for _ in range(20)]
        b = own()
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(b), " ".join(edited(b, 30))]
    df = docs(texts)
    sketches = {r.id: set(enumerate(r.sketches)) for r in O.sketches(df).collect()}
    got = {r.doc_id: r.class_id for r in O.classes(df).collect()}
    sharing = [(b, c) for b, c in pairs if sketches[b] & sketches[c]]
    assert len(sharing) >= 20
    assert [(b, c) for b, c in sharing if got[b] != got[c]] == []


def test_copies_whose_rare_word_pairs_unlike_texts_lead(spark, docs):
    """Texts are put together from few long runs of words, so all word pairs of two copies have many unlike holders."""
    rng = random.Random(12)
    runs = [[f"r{k}x{i}" for i in range(40)] for k in range(14)]
    made = lambda: [w for run in rng.sample(runs, 5) for w in run]
    texts, pairs = [" ".join(made()) for _ in range(90)], []
    for _ in range(30):
        b = made()
        at = set(rng.sample(range(200), 36))
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(b), " ".join(f"n{rng.randrange(10**9)}" if i in at else w for i, w in enumerate(b))]
    texts += [" ".join(made()) for _ in range(90)]
    df = docs(texts)
    sketches = {r.id: set(enumerate(r.sketches)) for r in O.sketches(df).collect()}
    got = {r.doc_id: r.class_id for r in O.classes(df).collect()}
    sharing = [(b, c) for b, c in pairs if sketches[b] & sketches[c]]
    assert len(sharing) >= 20
    assert [(b, c) for b, c in sharing if got[b] != got[c]] == []


def test_unlike_texts_meet_classes_not_their_members(spark, docs, monkeypatch):
    """Copies of a template and texts that are nearly alike to them: pairs do not grow with the members of a class, and no link between classes is lost."""
    rng = random.Random(13)
    template = [f"t{i}" for i in range(200)]
    edited = lambda n: [f"n{rng.randrange(10**9)}" if i in at else w for at in [set(rng.sample(range(200), n))] for i, w in enumerate(template)]
    words = [edited(12) for _ in range(100)] + [edited(n) for n in (30, 34, 36) for _ in range(12)]
    rng.shuffle(words)
    made, write = {}, O.written

    def counted(df, name):
        out = write(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(O, "written", counted)
    got = {r.doc_id: r.class_id for r in O.classes(docs([" ".join(w) for w in words])).collect()}
    label = list(range(len(words)))
    for i in range(len(words)):
        for j in range(i):
            if label[i] != label[j] and O.aligned(words[i], words[j], 40) is not None:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert len(set(label)) > 20
    assert [got[i] for i in range(len(words))] == label
    after_leaders = {name: n for name, n in made.items() if name.startswith(("pairs-", "places")) and name != "pairs-apart"}
    assert max(after_leaders.values()) <= 1000, after_leaders


def test_strangers_that_share_rare_words_meet_only_where_signatures_allow(spark, docs):
    """Pairs of classes do not grow with the square of the holders of a rare word, and every alike pair is among them."""
    rng = random.Random(15)
    words = [[f"r{k}" for k in rng.sample(range(40), 12)] + [f"o{rng.randrange(10**4)}" for _ in range(108)] for _ in range(160)]
    near = [(i, i + 160) for i in range(0, 160, 4)]
    for i, _ in near:
        at = set(rng.sample(range(120), 24))
        words.append([f"n{rng.randrange(10**6)}" if k in at else w for k, w in enumerate(words[i])])
    near = [(i, 160 + k) for k, (i, _) in enumerate(near)]
    df = docs([" ".join(w) for w in words])
    members = spark.createDataFrame([(0, i, 120) for i in range(len(words))], "k0 long, id long, n_words int")
    known = spark.createDataFrame([], "id long, class long")
    met = {(r.a, r.b) for r in O.strangers(df, members, known, "doc_id", "text")[1].collect()}
    assert all(O.aligned(words[a], words[b], 24) is not None for a, b in near) and set(near) <= met
    assert len(met) <= 2 * len(near), len(met)
    one = spark.createDataFrame([(i, 0) for i, _ in near], "id long, class long")  # a class of many texts is alike by any of them
    met = {(r.a, r.b) for r in O.strangers(df, members, one, "doc_id", "text")[1].collect()}
    assert {(0, b) for _, b in near} <= met


def test_long_strangers_that_share_rare_words_meet_only_by_many_word_pairs(spark, docs):
    """Signatures of long texts rule nothing out: pairs of their classes do not grow with the square of the holders of a rare word either."""
    rng = random.Random(16)
    fresh = lambda n: [f"o{rng.randrange(3000)}" for _ in range(n)]
    words = [[f"r{k}" for k in rng.sample(range(60), 20)] + fresh(1480) for _ in range(40)]
    words += [fresh(n) for n in (500, 512, 513, 600, 639, 640, 641, 700)]  # about the bound between short and long
    near = []
    for i in [*range(0, 40, 4), *range(40, 48)]:
        n, copy = len(words[i]), list(words[i])
        limit = n // 5
        at = rng.sample(range(n), limit)
        if i % 3 == 0:  # the copy is shorter by all that may be edited
            copy = [w for k, w in enumerate(copy) if k not in set(at)]
        else:
            for k in at:
                copy[k] = f"n{rng.randrange(10**6)}"
        near.append((i, len(words)))
        words.append(copy)
    df = docs([" ".join(w) for w in words])
    members = spark.createDataFrame([(0, i, len(w)) for i, w in enumerate(words)], "k0 long, id long, n_words int")
    met = lambda known: {(r.a, r.b) for r in O.strangers(df, members, spark.createDataFrame(known, "id long, class long"), "doc_id", "text")[1].collect()}
    assert all(O.aligned(words[a], words[b], len(words[a]) // 5) is not None for a, b in near)
    found = met([])
    assert set(near) <= found and len(found) <= 2 * len(near), len(found)
    found = met([(i, 0) for i, _ in near])  # a class of many texts is alike by any of them
    assert {(0, b) for _, b in near} <= found


def test_linked_members_of_classes_whose_first_nodes_are_unlike(spark, docs):
    """``between`` finds a link of two classes by any of their nodes, in each of many portions."""
    rng = random.Random(14)
    words = [[f"c{g}x{i}" for i in range(100)] for g in (0, 1) for _ in range(45)]
    for i, w in enumerate(words):
        w[i % 45] = f"n{rng.randrange(10**9)}"
    words[70] = words[30][:90] + words[70][90:]  # of the second class, and alike to the first alone
    df = docs([" ".join(w) for w in words])
    nodes = spark.createDataFrame([(i, 0 if i < 45 else 45, 100) for i in range(90)], "id long, class long, n_words int")
    pairs = spark.createDataFrame([(0, 45)], "a long, b long")
    links = {(r.id, r.leader) for r in O.between(df, nodes, pairs, "doc_id", "text").collect()}
    assert links and all(70 in link and min(link) < 45 for link in links)
    assert O.between(df, nodes, pairs.limit(0), "doc_id", "text").count() == 0


def test_recall(spark, docs):
    """Of all pairs of at least 0.8 edit similarity, found by brute force, at least 0.9 end in one class."""
    rng = random.Random(21)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 120))]
        texts.append(base)
        for part in (0.05, 0.12, 0.18):
            copy = list(base)
            for _ in range(int(part * len(base))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [f"n{rng.randrange(10**6)}"]
            texts.append(copy)
    near = [(i, j) for i in range(len(texts)) for j in range(i) if i // 4 == j // 4 and O.aligned(texts[i], texts[j], int(0.2 * max(len(texts[i]), len(texts[j])) + 1e-9)) is not None]
    got = {r.doc_id: r.class_id for r in O.classes(docs([" ".join(t) for t in texts])).collect()}
    hard = [(i, j) for i, j in near if 0 not in (i % 4, j % 4)]  # neither is the base of the other
    assert len(near) > 150 and len(hard) > 30
    assert sum(got[i] == got[j] for i, j in near) >= 0.9 * len(near)
    assert sum(got[i] == got[j] for i, j in hard) >= 0.9 * len(hard)


def test_query(spark, tmp_path, docs):
    from foliospark.llm.queries import QUERIES

    text = " ".join(f"w{i}" for i in range(40))
    docs([text, "other words here", text + " x", None]).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["op6_order_minhash"](spark, str(tmp_path)).collect())
    assert got == [(0, 0, 1, True), (1, 1, 0, True), (2, 0, 1, False), (3, 3, 0, True)]
