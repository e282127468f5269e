import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brook.llm import packing as K

PATH, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SLOW = Tokenizer.from_file(PATH)


def check(rows, got, capacity):
    """Every document's ids are there once, in sequences that are gapless and not too long."""
    want = []
    for i, t in rows:
        ids = np.array([*SLOW.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        lengths = [len(ids)] if len(ids) <= capacity else [len(ids) % capacity] * (len(ids) % capacity > 0) + [capacity] * (len(ids) // capacity)
        starts = np.cumsum([0, *lengths])
        want += [(i, k, int(starts[k]), n, zlib.crc32(ids[starts[k] : starts[k] + n].tobytes())) for k, n in enumerate(lengths)]
    assert sorted(want, key=str) == sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "hello <|endoftext|> world"), (4, "x y z " * 3000), (None, "été  x 日本"), (1, "a b"), (1, "a b")] + [(10 + i, "w " * (i * 7 % 90)) for i in range(120)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length long").repartition(5)
    for capacity, items in ((64, 1 << 18), (64, 20), (1024, 1 << 18)):
        got = K.pack(df, PATH, RANKS, capacity, plan_items=items).collect()
        n = check(rows, got, capacity)
        assert n <= -(-sum(r.length for r in got) // capacity) + (1 if items > 1000 else 4)
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert K.pack(df.limit(0), PATH, RANKS, keep_ids=False).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=80) | st.text(alphabet="aé 's\n\t1!$", max_size=60))
def test_same_ids(text):
    assert list(K.encoder(PATH, RANKS)([text])[0]) == SLOW.encode(text, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 300), max_size=20), st.sampled_from([8, 100, 10_000]))
def test_plan(histogram, items):
    p = K.plan(histogram, 32, items)
    used: dict = {}
    for s, n in histogram.items():
        mine = np.flatnonzero(p["length"] == s)
        first = [*p["first"][mine], n]
        assert first[0] == 0 and first == sorted(first)
        for j, k in enumerate(mine):
            for r in range(first[j + 1] - first[j]):
                used.setdefault(int(p["sequence"][k]) + r, []).append((int(p["offset"][k]), s))
    for places in used.values():
        at = 0
        for offset, s in sorted(places):
            assert offset == at
            at += s
        assert at <= 32
    assert len(used) >= -(-sum(s * n for s, n in histogram.items()) // 32)


@pytest.mark.parametrize("times", [1, 50, 5000])
def test_bins_of_large_histograms(times):
    """Placing many at once costs few bins: levels share their open bins."""
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(np.minimum(1023, rng.lognormal(5, 1, 3000).astype(int) + 1), return_counts=True)
    histogram = dict(zip(lengths.tolist(), (counts * times + rng.integers(0, 7, len(counts))).tolist(), strict=True))
    p = K.plan(histogram, 1024, 1 << 12)
    first = {s: np.append(p["first"][p["length"] == s], n) for s, n in histogram.items()}
    runs = np.concatenate([np.diff(first[s]) for s in sorted(first)])  # plan rows are in order of length and rank
    bins = int((p["sequence"] + runs).max())
    least = -(-sum(s * n for s, n in histogram.items()) // 1024)
    assert least <= bins <= 1.01 * least + 1 and len(p["first"]) <= (1 << 12) + 2 * 64 * len(histogram)


@pytest.mark.parametrize("n,want", [(1, [(0, 1)]), (10, [(0, 10)]), (20, [(0, 10), (10, 10)]), (23, [(0, 3), (3, 10), (13, 10)])])
def test_cuts(n, want):
    assert K.cuts(n, 10) == want
