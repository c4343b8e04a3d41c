import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm.wordhash import slices, windows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab é\n\t\x1c "), max_size=30)), max_size=8), size=st.integers(1, 40))
def test_words_and_hashes(texts, size):
    names, grams, n = {}, {}, 0
    for first, end, got in slices(pa.array(texts, pa.string()), size):
        assert first == n
        hashes = got.hashes()
        two = windows(hashes, 2)
        for k in range(first, end):
            a, b = got.first[k - first], got.first[k - first + 1]
            found = [bytes(got.raw[s:e]).decode() for s, e in zip(got.start[a:b], got.end[a:b], strict=True)]
            assert found == WORDS.findall(texts[k] or "")
            for w, h in zip(found, hashes[a:b].tolist(), strict=True):
                assert names.setdefault(w, h) == h
            for i in range(len(found) - 1):
                assert grams.setdefault((found[i], found[i + 1]), int(two[a + i])) == int(two[a + i])
        n = end
    assert n == len(texts) and len(set(names.values())) == len(names) and len(set(grams.values())) == len(grams)
