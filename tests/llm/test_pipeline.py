import random

import corpus_pipeline as C
import pytest
from test_jaccard_join import brute as groups
from test_packing import check
from test_pii import brute as personal

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    items = [(i, " ".join(words(20))) for i in range(5)]
    texts, labels = [], []
    for i in range(260):
        text = words(rng.randrange(40, 120))
        bad = i % 4 == 3
        labels.append((i, int(not bad), 0))
        texts.append(" ".join(w.upper() + "###" for w in text) if bad else ". ".join(text))
    for i in range(30):
        texts.append(texts[4 * i] + (" tail" if i % 2 else ""))  # near copies of good ones
    for i in range(10):
        texts.append(". ".join(words(30)) + " " + items[i % 5][1] + " " + ". ".join(words(30)))
    for i in range(10):
        texts.append(". ".join(words(30)) + f" mail ann{i}@mail.example.com or 10.0.{i}.7 " + ". ".join(words(30)))
    texts += ["", None]
    return [(i, t, "en", f"s{i % 5}", None if t is None else len(t)) for i, t in enumerate(texts)], labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels, items = fixture()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    rows, labels, items = fixture()
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in C.STAGES[:-1]:
        before = {tuple(r) for r in docs.collect()}
        docs = C.kept(stage(spark, docs, folder), name)
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        seen[name] = before, {tuple(r) for r in docs.collect()}
    before, after = seen["quality"]
    assert after <= before and before == set(rows)
    gone = {r[0] for r in before - after}
    poor = {i for i, good, _ in labels if not good}
    assert len(gone & poor) >= 0.97 * len(poor) and not {r[0] for r in rows[260:310]} & gone and len(gone - poor) <= 2
    before, after = seen["near_duplicates"]
    want = {d for d, n, c in groups([(r[0], r[1]) for r in before]) if n == 0 or d == c}
    assert after <= before and {r[0] for r in after} == want
    before, after = seen["benchmark"]
    assert before - after == {r for r in before if any(t in (r[1] or "") for _, t in items)} and len(before - after) == 10
    before, after = seen["personal_data"]
    clean = {r for r in before if not personal(r[1])[0]}
    assert clean <= after and len(after) == len(before) and len(before - clean) == 10
    assert all(not personal(r[1])[0] and "<EMAIL>" in r[1] and "<IP>" in r[1] for r in after - clean)
    got = C.STAGES[-1][1](spark, docs, folder).collect()
    check([(r[0], r[1]) for r in after], got, 1024)


def test_run(spark, folder):
    assert C.run(spark, folder).where("sequence_id is not null").count() > 150


def test_empty(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []


def test_clashing_columns(spark, folder):
    """Each stage but the last leaves further columns as they are, also ones called as its helpers are."""
    helpers = "_h _i _z _a _b _all _gone _ka _kb _t _in i z h t id inputs row bucket marked p e a b y k".split()
    rows = [r for r in fixture()[0] if r[0] % 6 == 0 or r[0] >= 290]
    docs = spark.createDataFrame([(*r, *(100 * (r[0] or 0) + j for j in range(len(helpers)))) for r in rows], COLUMNS + ", " + ", ".join(f"{x} long" for x in helpers))
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(tuple(r)[5:] == tuple(100 * r.doc_id + j for j in range(len(helpers))) for r in got)
