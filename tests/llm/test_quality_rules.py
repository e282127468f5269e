import re

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from brook.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    twice = {g for g in grams if grams.count(g) > 1}
    covered = {i + j for i, g in enumerate(grams) if g in twice for j in range(3)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def counts(spark, texts):
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words long, w string")
    return [tuple(r)[1:6] for r in sorted(Q.statistics(df).collect())]


EDGES = [None, "", " \n\t ", "a", "a b", "a a a", "a a a a", "é b c é b c", "x\ny\nx\n\n \n \nx ", "#*$% &|<> ! 12", " lead and trail ", "a\x0bb\x0cc\rd e", "ab c a bc ab c", "😀 x 😀"]


def test_edges(spark):
    texts = [*EDGES, " ".join(f"w{i % 700}" for i in range(20_000))]
    got = counts(spark, texts)
    assert got[:-1] == [brute(t) for t in EDGES]
    assert got[-1] == (20_000, sum(len(f"w{i % 700}") for i in range(20_000)), 0, 0, 20_000)
    assert counts(spark, []) == []


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab é\n#", max_size=60), min_size=1, max_size=20))
def test_random(spark, texts):
    assert counts(spark, texts) == [brute(t) for t in texts]


def test_learning(spark):
    rng = np.random.default_rng(0)
    x = rng.random((900, len(Q.FEATURES)))
    s, u = Q.FEATURES.index("symbol_share"), Q.FEATURES.index("upper_share")
    bad = (x[:, s] > 0.8) | (x[:, u] > 0.7) & (x[:, 0] < 0.4)
    found = Q.learn(x, bad)
    assert (Q.decide(found, x) == ~bad).mean() > 0.97 and 2 <= len(found.rules) <= 8
    assert Q.learn(x, np.zeros(900)) == Q.DecisionList([]) == Q.learn(x[:0], bad[:0])


def test_order_matters():
    """Good rows inside a bad region: a list of both classes, wrong if its rules are taken in another order."""
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(Q.FEATURES)))
    s, u = Q.FEATURES.index("symbol_share"), Q.FEATURES.index("upper_share")
    bad = (x[:, s] > 0.6) & ~((x[:, s] > 0.75) & (x[:, u] > 0.5))
    found = Q.learn(x, bad)
    assert {r.good for r in found.rules} == {True, False}
    right = (Q.decide(found, x) == ~bad).mean()
    turned = (Q.decide(Q.DecisionList(found.rules[::-1], found.otherwise), x) == ~bad).mean()
    assert right > 0.97 and turned < right - 0.05


def test_apply(spark):
    fine = " ".join(f"word{i}" for i in range(60))
    junk = " ".join(f"word{i}###" for i in range(60))
    loud = " ".join(f"WORD{i}###" for i in range(60))
    rows = [(1, fine), (2, junk), (3, "short"), (4, fine + " " + fine), (None, fine), (1, fine), (5, loud)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = Q.DecisionList([Q.Rule([Q.Condition("upper_share", True, 0.3)], True), Q.Rule([Q.Condition("symbol_share", True, 1.0)], False)])
    got = sorted(((r.doc_id, r.base_failed, r.kept, r.rule) for r in Q.apply_rules(df, found).collect()), key=str)
    assert got == sorted([(1, False, True, 0), (2, False, False, 2), (3, True, False, 0), (4, True, False, 0), (None, False, True, 0), (1, False, True, 0), (5, False, True, 1)], key=str)
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert Q.learn_from(df, labels) == Q.DecisionList([]) == Q.learn_from(df, labels.limit(0))


def test_learn_from(spark):
    """The emitted conditional decides as the plain one does; held-out labels are not learned; no exchange of texts."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{rng.integers(900)}" + "#" * (2 * (i % 3 == 0)) for _ in range(60)) for i in range(240)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "x")] * 30, "doc_id long, text string, k string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 1.0) for i in range(240)], "doc_id long, quality int, y double")
    found = Q.learn_from(df, labels)
    got = Q.apply_rules(df, found)
    table = got.select("doc_id", "kept", *Q.FEATURES).toPandas()
    assert (table["kept"] == Q.decide(found, table[Q.FEATURES].to_numpy(float))).all()
    assert (table["kept"] == (table["doc_id"] % 3 != 0)).mean() > 0.95
    turned = labels.withColumn("quality", Q.F.when(Q.held_out(Q.F.col("doc_id")), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    assert Q.learn_from(df, turned) == found
