import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brook.llm import decontamination as D

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def least_edits(item, text):
    """Least edit distance between item and any stretch of text, plainly."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edit(item, n, rng):
    out = list(item)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at : at + rng.choice([0, 1])] = rng.choice([[], [f"new{rng.randrange(10**6)}"]])
    return out


def leaks(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id long")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return D.find_leaks(d, b, **options).collect()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=7), st.lists(st.integers(1, 3), max_size=15))
def test_distances(item, text):
    lengths, width = np.array([len(item)]), max(1, len(text))
    items = np.array([item], dtype=np.uint64)
    texts = np.array([text + [0] * (width - len(text))], dtype=np.uint64)
    edits, end = D.distances(items, lengths, texts)
    assert edits[0] == least_edits(item, text)
    h = np.array([*text, 0], dtype=np.uint64)
    plan = D.Plan([(1, np.array(item, dtype=np.uint64))], [], np.zeros(1), 1.0)
    got, first, last = D.verify(h, np.array([0]), np.array([len(text)]), np.array([0]), plan)
    assert got[0] == least_edits(item, text) and 0 <= first[0] <= last[0] <= width
    assert least_edits(item, text[first[0] : last[0]]) == got[0]


def test_recall_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randrange(10, 60))]) for i in range(40)]
    filler = lambda n: [rng.choice(vocabulary) if rng.random() < 0.5 else f"f{rng.randrange(10**6)}" for _ in range(n)]
    docs, planted = [], 0
    for k in range(300):
        i, item = items[k % len(items)]
        body = edit(item, rng.randrange(0, int(0.2 * len(item)) + 1), rng) if k % 3 else []
        docs.append((k, " ".join(filler(rng.randrange(0, 80)) + body + filler(rng.randrange(0, 80)))))
    got = leaks(spark, docs, [(i, " ".join(w)) for i, w in items])
    found = {(r.doc_id, r.item_id): r for r in got}
    truth = {(k, i): e for k, t in docs for i, item in items if (e := least_edits(item, words(t))) <= int(0.2 * len(item))}
    assert set(found) <= set(truth) and all(found[p].edits >= truth[p] for p in found)
    assert len(found) >= 0.95 * len(truth) and len(truth) > 150
    for p, r in found.items():
        assert least_edits(dict(items)[p[1]], words(docs[p[0]][1])[r.start_word : r.end_word]) == r.edits
    assert all(p in found for p, e in truth.items() if e == 0)


def test_edges(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, None), (2, ""), (3, item), (3, item), (None, "x, " + item.upper().replace(" ", "-") + "!"), (4, "one two three"), (5, ("filler " * 60_000) + item), (6, item + " " + item)]
    items = [(7, item), (8, None), (9, ""), (10, "one two"), (11, item), (None, item + " tail end")]
    got = sorted(((r.doc_id, r.item_id, r.start_word, r.edits) for r in leaks(spark, docs, items)), key=str)
    exact = [(d, i, s, 0) for d, s in ((3, 0), (3, 0), (None, 1), (5, 60_000), (6, 0)) for i in (7, 11)]
    assert [x for x in got if x[1] is not None] == sorted(exact, key=str)
    assert {x[0] for x in got if x[1] is None} == {3, None, 5, 6}  # two words short, as many as its twelve words allow
    assert leaks(spark, [], items) == [] and leaks(spark, docs, []) == [] and leaks(spark, docs, [(1, None)]) == []


def test_clean_rows(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, item, "a"), (2, None, "b"), (2, "", None), (None, "free of it", "c"), (3, "x " + item.title(), "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    for words in (1 << 20, 3):
        kept = D.drop_leaking(docs, bench, block_words=words)
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(rows[1:4], key=str)
    assert D.drop_leaking(docs, bench.limit(0)).count() == 5


def test_blocks(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"b{rng.randrange(900)}" for _ in range(20))) for i in range(12)]
    docs = [(i, "start " + t + " end") for i, t in items]
    got = {(r.doc_id, r.item_id) for r in leaks(spark, docs, items, block_words=60)}
    assert got == {(i, i) for i, _ in items}


def test_long_items(spark):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(4000)]
    items = [(n, [rng.choice(vocabulary) for _ in range(n)]) for n in (61, 120, 250, 500)]
    filler = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs, planted = [], []
    for k in range(60):
        i, item = items[k % len(items)]
        docs.append((k, " ".join(filler(rng.randrange(0, 80)) + edit(item, int(0.2 * i), rng) + filler(rng.randrange(0, 80)))))
        planted.append((k, i))
    docs += [(100, " ".join(items[3][1][:60])), (101, " ".join(filler(200) + items[2][1][:125] + filler(125)))]  # a part alone is no copy
    got = leaks(spark, docs, [(i, " ".join(w)) for i, w in items])
    found = {(r.doc_id, r.item_id): r for r in got}
    assert set(found) <= set(planted) and len(found) == len(got) and len(found) >= 0.97 * len(planted)
    for p, r in found.items():
        text = words(docs[p[0]][1])
        assert r.edits == least_edits(dict(items)[p[1]], text) == least_edits(dict(items)[p[1]], text[r.start_word : r.end_word])


def test_recall_out_of_reach():
    with pytest.raises(ValueError, match="walks find"):
        D.make_plan([(1, " ".join(f"w{i}" for i in range(20)))], 0.8, 16, 0.98, 8)
