import random
import zlib

import numpy as np

from brook.llm import _text as T
from brook.llm import toxicity as X

import pyarrow as pa


def machine(spark, rows, labels, **options):
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, y string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    m = X.train(docs, marks, **options)
    return m, {(r.doc_id, r.held_out): r for r in X.score(docs, m).collect()}, docs


def corpus(n=900):
    """Toxic: an insult near a group's name.  Either alone is clean, so that only the pair tells."""
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 60))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words[3:3] = [rng.choice(["moronish", "stupidly"])] * insult
        words[9:9] = [rng.choice(["groupalpha", "groupbeta"])] * group
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult and group)))
    return rows, labels


def test_pairs_are_learned(spark):
    rows, labels = corpus()
    _, got, _ = machine(spark, rows, labels, epochs=30)
    truth = dict(labels)
    held = [r for (i, h), r in got.items() if h]
    assert {i for (i, h) in got if h} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    right = np.mean([r.predicted == truth[r.doc_id] for r in held])
    assert len(held) > 200 and right > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_edges(spark):
    rows, labels = corpus(300)
    rows += [(1000, None), (1001, ""), (None, rows[0][1]), (0, rows[0][1]), (1002, "moronish groupalpha " + "clean " * 40_000)]
    m, got, docs = machine(spark, rows, labels)
    assert docs.count() == 305 and X.score(docs, m).count() == 305
    assert got[None, False].score == got[rows[0][0], zlib.crc32(b"0") % 3 == 1].score
    empty = [r for (i, _), r in got.items() if i in (1000, 1001)]
    assert len(empty) == 2 and abs(empty[0].score - X.sigmoid(np.array([m.bias]))[0]) < 1e-12
    assert X.score(docs.limit(0), m).collect() == []
    for marks in ([], [(1, 0), (2, 0)], [(3, None)]):
        _, nothing, _ = machine(spark, rows, marks)
        assert max(r.score for r in nothing.values()) < 1e-9


def test_scores_are_those_of_the_formula():
    rng = np.random.default_rng(0)
    m = X.Machine(np.zeros(1), 0.3, rng.normal(size=9), rng.normal(size=(9, 3)))
    docs = [[], [4], [0, 2, 5, 8]]
    rows = X.Rows(np.array(sum(docs, []), dtype=int), np.cumsum([0, *map(len, docs)]))
    want = [m.bias + sum(m.w[i] for i in d) + sum(m.v[i] @ m.v[j] for k, i in enumerate(d) for j in d[:k]) for d in docs]
    assert np.allclose(X.raw_scores(m, rows), want)


def test_terms_do_not_depend_on_the_batch():
    texts = ["Größe idiotX ab", "", "idiotx " * 3, "idioty"]
    alone = [set(X.run_terms(next(T.runs(pa.array([t]))))[1]) for t in texts]
    doc, bucket = X.run_terms(next(T.runs(pa.array(texts))))
    assert [set(bucket[doc == i]) for i in range(4)] == alone
    assert alone[2] < alone[0] and alone[2] & alone[3]
