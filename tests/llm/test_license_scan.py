import random
from collections import Counter

import pytest

from foliospark.llm import license_scan as L

CASES = [
    ("Licensed under the Apache License, Version 2.0.", "apache"),
    ("This project is released under the MIT License", "mit"),
    ("permission is hereby granted, free of charge, to any person obtaining a copy of this software to deal in the software without restriction", "mit"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Licensed under CC BY 4.0.", "cc-by"),
    ("Our texts are under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("He renewed his driving licence in the public office on Monday.", "none"),
    ("The general public had no permission to enter.", "none"),
    ("Nothing of the kind is said here.", "none"),
    ("Distributed under the gpl", "gpl"),
    ("released under gplv3", "gpl"),
    ("Text under cc by-sa 4.0", "cc-by-sa"),
    ("bsd-3-clause", "bsd"),
    ("Licensed under LGPLv3.", "lgpl"),
    ("under the LGPLv2.1", "lgpl"),
    ("released under the mit license", "mit"),
    ("SPDX-License-Identifier: Apache-2.0", "apache"),
    ("Das Haus mit dem Garten liegt mit dem Fluss im Tal.", "none"),
]


@pytest.fixture(scope="module")
def found(spark):
    texts = [t for t, _ in CASES] + [None, "", "x\n\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.\n ", "Licensed under the Frobnicate Community Covenant, version 7."]
    rows = [(i, t, "mine") for i, t in enumerate(texts)] + [(90, "first line"), (90, "Released under the MIT License."), (None, "Released under the MIT License.")]
    df = spark.createDataFrame([(*r, "mine")[:3] for r in rows], "doc_id long, text string, family string")
    return {r.doc_id: r for r in L.scan(df).collect()}


def test_families(found):
    assert [(t, found[i].family) for i, (t, _) in enumerate(CASES)] == CASES


def test_defined_cases(found):
    n = len(CASES)
    assert [(found[i].n_paragraphs, found[i].n_cued, found[i].family) for i in (n, n + 1)] == [(0, 0, "none")] * 2
    assert (found[n + 2].n_paragraphs, found[n + 2].n_cued, found[n + 2].families) == (3, 2, ["cc-by-nc", "mit"])
    assert (found[n + 3].family, found[n + 3].n_unknown) == ("unknown", 1)
    assert (found[90].n_paragraphs, found[90].families) == (2, ["mit"]) and found[None].family == "mit"


def test_wrapped_lines_are_one_paragraph(spark):
    wrapped = "An opening line.\nPermission is hereby granted, free of charge, to any person\n  obtaining a copy of this software and associated\ndocumentation files, to deal in the Software\n\nThe end"
    got = L.scan(spark.createDataFrame([(1, wrapped)], "doc_id long, text string")).collect()[0]
    assert (got.n_paragraphs, got.n_cued, got.family) == (3, 1, "mit")


def test_scan_agrees_with_python(spark):
    """Every statement and negative of the templates, cut and joined at random, judged by Spark and one by one."""
    rng = random.Random(6)
    texts = [t for _, _, t in L._samples()]
    lines = rng.sample(texts, 250) + [f"{rng.choice(texts)} {rng.choice(texts)}" for _ in range(60)] + [" ".join(rng.sample(rng.choice(texts).split(), k=1)) for _ in range(20)]
    model = L.trained()
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    seen = Counter()
    for i, line in enumerate(lines):
        if not any(map(L._is_cue, L._words(line))):
            assert got[i].family == "none"
            continue
        family, sure, close = L.judge(line, model)
        seen[family] += 1
        assert got[i].family == family, line
        if family not in ("none", "unknown"):
            assert (got[i].confidence, got[i].similarity) == (pytest.approx(sure, abs=2e-6), pytest.approx(close, abs=2e-6))
    assert len(seen) > 10


def test_calibration():
    """At the calibrated bound most statements of families that a model has not seen are unknown."""
    model = L.trained()
    assert 0.4 <= model.least <= 0.8 and model.passed < 0.35


def test_hot_line_and_long_text(spark, tmp_path):
    from foliospark.llm.queries import QUERIES

    rows = [(i, "Released under the MIT License.") for i in range(900)] + [(1000, "word " * 200_000 + "\nLicensed under CC BY 4.0.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op1_license_scan"](spark, str(tmp_path)).groupBy("family").count().collect()
    assert sorted(map(tuple, got)) == [("cc-by", 1), ("mit", 900)]


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
