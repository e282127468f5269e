import random
import re
import time

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from brook.llm import jaccard_join as J

SCHEMA = "doc_id long, text string, n long, comp string"


def shingles(text, k=5):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute(rows, similarity=75):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= similarity * len(a | b):
                group[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return sorted(out, key=str)


def result(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(df, **options).collect()), key=str)


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return " ".join(words)


def test_edges(spark):
    long = [f"w{i % 997}x{i // 100}" for i in range(20_000)]
    base = [f"b{i}" for i in range(80)]
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, " ".join(long)), (8, " ".join(long[:19_000])), (9, " ".join(base)), (10, " ".join(base)), (None, " ".join(base)), (None, "q r s t u v"), (None, "z " * 9), (10, " ".join(base)), (11, " ".join(base[:70])), (12, "a b c d e"), (13, "a b c d")]
    rows += [(100 + i, edited(base, i % 4, rng)) for i in range(30)]
    rows += [(200 + i, " ".join(base[:20]) + f" own{i} " + " ".join(f"o{i}w{j}" for j in range(30))) for i in range(20)]
    assert result(spark, rows) == brute(rows)


def test_keep_one(spark):
    base = " ".join(f"b{i}" for i in range(40))
    rows = [(5, base, "x"), (3, base.upper(), "y"), (4, base + " more", None), (None, base, "n"), (7, None, "e"), (8, "", "e"), (9, "a b", "s"), (2, "c d", "s"), (9, "a b", "s"), (None, "only here", "n"), (3, "other text of the same id", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    want = [(7, None, "e"), (8, "", "e"), (9, "a b", "s"), (2, "c d", "s"), (None, "only here", "n")]
    got = list(map(tuple, kept.collect()))
    three = [r for r in got if r[0] == 3]  # its two texts count as one document
    assert len(three) == 1 and three[0] in rows
    assert sorted((r for r in got if r[0] != 3), key=str) == sorted(want, key=str)
    assert J.keep_one(df.limit(0)).collect() == []


def test_empty(spark):
    assert result(spark, []) == []
    for rows in ([(1, None)], [(1, ""), (2, " "), (None, None)]):
        assert result(spark, rows) == brute(rows)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=12), st.randoms(use_true_random=False))
def test_random(spark, docs, rng):
    texts = [" ".join(d) for d in docs]
    base = [f"v{rng.randrange(60)}" for _ in range(60)]
    texts += [edited(base, rng.randrange(5), rng) for _ in range(10)]
    rows = list(enumerate(texts))
    assert result(spark, rows) == brute(rows)


def test_prefixes_never_miss():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        common = rng.integers(0, 1 << 62, n).astype(np.uint64)
        a = np.unique(np.concatenate([common, rng.integers(0, 1 << 62, int(rng.integers(0, n // 3 + 1))).astype(np.uint64)]))
        b = np.unique(common[: max(1, n - int(rng.integers(0, n // 4 + 1)))])
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        tokens, docs = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        level = 1 + (tokens % np.uint64(3)).astype(np.uint8)
        for k in range(J.ORDERS):
            doc, token = J.prefixes(docs, tokens, level, np.array([len(a), len(b)]), 75, k)
            assert np.intersect1d(token[doc == 0], token[doc == 1]).size


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    got = dict(tuple(r) for r in J.components(edges).collect())
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def joined_rows(spark, m):
    """Rows that the pivots and the last join make for m near copies and three texts that share shingles but don't link."""
    rng = random.Random(m)
    base = [f"b{i}" for i in range(300)]
    rows = [(i, edited(base, 1 + i % 3, rng)) for i in range(m)]
    rows += [(10_000 + i, " ".join(base[30 * i : 30 * i + 200] + [f"own{i}w{j}" for j in range(100)])) for i in range(3)]
    counts, linked = [], []

    class Counted(J.Join):
        def with_pivots(self, k):
            df = super().with_pivots(k)
            counts.append(df.count())
            return df

        def members_apart(self, *args):
            df = super().members_apart(*args)
            counts.append(df.count())
            return df

        def link(self, pairs):
            linked.append(pairs.count())
            return super().link(pairs)

    was, J.Join = J.Join, Counted
    try:
        assert result(spark, rows) == brute(rows)
    finally:
        J.Join = was
    return sum(counts), sum(linked)


def test_rows_grow_with_the_group(spark):
    one, two = joined_rows(spark, 150), joined_rows(spark, 300)
    assert two[0] <= 2.6 * one[0] and two[1] <= 2.6 * one[1] and two[1] <= 12 * 300


def test_regions_finer_than_bytes():
    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2))
    n = rng.integers(1, 20_000, len(hashes))
    for region_bits in (6, 12, 20):
        maps = [np.zeros((1 << bits) // 8, dtype=np.uint8) for _, bits in J.LEVELS]
        region = hashes >> np.uint64(64 - region_bits)
        for r in np.unique(region):
            mine = region == r
            key = (hashes[mine] >> np.uint64(32 - region_bits)).astype("<u4")
            for level, low, bits in J.level_bits(int(r), region_bits, key, n[mine]):
                maps[level][low : low + len(bits)] |= bits
        assert (J.levels_of(hashes, maps) >= np.sum([n >= least for least, _ in J.LEVELS], axis=0)).all()
        assert (J.levels_of(np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64)), maps) > 0).mean() < 0.01


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 4, 5, 6)], "doc_id long, text string, i long, z long, H long")
    assert [tuple(r) for r in J.keep_one(df).collect()] == [(1, "a b c d e f", 1, 2, 3)]


def test_shuffle_files_go_with_their_step(spark, monkeypatch):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in files.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before, kept = spark.conf.get(name, None), shuffled(), J.kept

    def step(df, name):
        for _ in range(50):  # they are deleted in the background
            if not shuffled() - before:
                return kept(df, name)
            time.sleep(0.1)
        raise AssertionError(f"shuffle files of earlier steps at {name}")

    monkeypatch.setattr(J, "kept", step)
    base = [f"b{i}" for i in range(60)]
    df = spark.createDataFrame([(i, " ".join(base[: 60 - i % 3]), 3, "x") for i in range(40)], SCHEMA)
    assert J.near_duplicates(df).count() == 40
    assert spark.conf.get(name, None) == was


def test_links_move_members_only(spark):
    """What is joined with the pairs is their own sets, those of the 5,000 other candidates stay."""
    rows = spark.range(5000).selectExpr("id", "8L AS n", "0L AS u", "array_repeat(0, 64) AS c", "CAST(repeat('x', 64) AS binary) AS s", *(f"array(id) AS p{k}" for k in range(J.ORDERS)))
    join = J.Join(rows, 75)
    for side in join.members(spark.createDataFrame([(7, 9), (7, 4000)], "a long, b long"), ["s"]):
        assert {7, 9, 4000} <= {r[0] for r in side.collect()} and side.count() < 60
