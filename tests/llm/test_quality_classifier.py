import random
import zlib

import numpy as np
import pyarrow as pa

from brook.llm import _text as T
from brook.llm import quality_classifier as Q


def corpus(n=700):
    """Bad texts shout or are full of symbols; source s9 is mostly bad."""
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [f"word{rng.randrange(500)}" for _ in range(rng.randrange(30, 90))]
        text = " ".join(w.upper() + "!!" if i % 2 else w + "###" for w in words) if bad else ". ".join(words)
        rows.append((i, text, rng.choice(["en", None]), "s9" if bad and rng.random() < 0.8 else f"s{rng.randrange(8)}", len(text)))
        labels.append((i, int(not bad)))
    return rows, labels


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, t string"


def frames(spark, rows, labels):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_views(spark):
    rows, labels = corpus()
    docs, marks = frames(spark, rows, [x for x in labels if x[0] % 3])
    model = Q.train(docs, marks)
    got = Q.score(docs, model).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.kept == (truth[r.doc_id] == 1) for r in held]) > 0.97
    assert np.mean([(r.p_metadata >= 0.5) == (truth[r.doc_id] == 1) for r in held]) > 0.8
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_edges(spark):
    rows, labels = corpus(300)
    rows += [(1000, None, None, None, None), (1001, "", "en", "s1", 0), (None, rows[0][1], *rows[0][2:]), (0, *rows[0][1:]), (1002, "long " * 60_000, "en", "s1", 300_000)]
    docs, marks = frames(spark, rows, labels)
    model = Q.train(docs, marks)
    got = Q.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (0, None)}) == 1
    assert Q.score(docs.limit(0), model).collect() == [] and Q.keep_good(docs.limit(0), model).collect() == []
    for few in ([], [(1, 1), (2, 1)], [(3, None)]):
        nothing = Q.train(docs, frames(spark, rows, few)[1])
        assert {r.score for r in Q.score(docs, nothing).collect()} == {1.0}
    bare = docs.select("doc_id", "text")
    assert Q.score(bare, Q.train(bare, marks)).count() == len(rows)
    assert Q.score(docs.limit(0), Q.train(docs.limit(0), marks)).collect() == []


def test_co_training_teaches_the_other_view():
    """Content is told by the labels; metadata agrees with it, but its labelled rows are too few to learn all sources."""
    rng = np.random.default_rng(0)
    n = 3000
    truth = rng.integers(0, 2, n)
    content = rng.random((n, len(Q.CONTENT))) + truth[:, None] * (np.arange(len(Q.CONTENT)) == 2) * 1.5
    metadata = np.stack([np.zeros(n), 1 + 2 * rng.integers(0, 30, n) + truth, np.full(n, 5.0)], axis=1)
    y = np.where(np.arange(n) < 60, truth, -1)
    alone = Q.co_train(content, metadata, y, np.arange(n), 0, 0.8, 400)
    taught = Q.co_train(content, metadata, y, np.arange(n), 5, 0.8, 400)
    right = [np.mean((Q.predict(m, content, metadata)[:, 2] > 0.5) == truth) for m in (alone, taught)]
    assert right[1] > 0.95 and right[1] > right[0] + 0.05


def test_content_does_not_depend_on_the_batch():
    texts = ["A b! c#\nA b! c#\nx", "", "é É 12 | 3", "\n\n", "one"]
    together = Q.run_content(next(T.runs(pa.array(texts))))
    for i, t in enumerate(texts):
        assert np.allclose(together[i], Q.run_content(next(T.runs(pa.array([t]))))[0])
    assert list(together[0][:2]) == [7, 11 / 7] and together[0][9] == 2 / 3


def test_all_unlabelled_rows_take_part(spark):
    """A source that only one row in a thousand has, and none with a label: its weight is learnt, however many rows there are."""
    rng = random.Random(4)
    rows, labels = corpus(300)
    rows += [(i, *corpus_row(i, rng)) for i in range(1000, 11000)]
    docs, marks = frames(spark, rows, labels)
    model = Q.train(docs, marks)
    assert abs(model.metadata[Q.HASHED + Q.hashed("rare", 1)]) > 1e-6
    assert model.edges[-1][-1] > max(r[4] for r in rows[:300])  # bins reach the unlabelled rows' lengths
    whole = Q.told([np.ones((3, 1)), np.ones((3, 1))], [[np.array([4.0]), np.array([-4.0])]], [np.zeros(1), np.zeros(1)], 0.97)
    assert [[n for n, _, _ in view] for view in whole] == [[3, 0], [0, 3]]


def corpus_row(i, rng):
    text = ". ".join(f"word{rng.randrange(500)}" for _ in range(rng.randrange(30, 90)))
    return text, "en", "rare" if i % 1000 == 7 else f"s{rng.randrange(8)}", len(text) + (i - 1000) * (i % 2)
