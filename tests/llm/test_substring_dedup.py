import hashlib
import re
import zlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from brook.llm.substring_dedup import remove_repeated_windows

SCHEMA = "doc_id long, text string, n_words long"


def brute(rows, length):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = {}
    for d, ws in enumerate(docs):
        for i in range(len(ws) - length + 1):
            seen.setdefault(tuple(ws[i : i + length]), []).append((d, i))
    gone = {(d, i + j) for places in seen.values() if len(places) > 1 for d, i in places for j in range(length)}
    out = []
    for d, ws in enumerate(docs):
        kept = " ".join(w for i, w in enumerate(ws) if (d, i) not in gone)
        out.append((rows[d][0], len(ws), len(ws) - len([i for i in range(len(ws)) if (d, i) not in gone]), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def result(spark, rows, length):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in remove_repeated_windows(df, length=length).collect()), key=str)


def test_edges(spark):
    long = " ".join(f"w{i % 97}é{i // 50}" for i in range(5000))
    rows = [(1, "a b c d e f"), (2, "x a b c d y"), (3, None), (4, ""), (5, "a b"), (1, "a b c d e f"), (None, "q a b c\td\nz"), (6, "r r r r r r r"), (7, long), (8, "only here at all it is"), (9, " \n ")]
    for length in (2, 4, 35):
        assert result(spark, rows, length) == brute(rows, length)


def crc_pairs(n):
    """Pairs of different texts of one word and equal crc32, by search."""
    seen, out = {}, []
    for i in range(1_000_000):
        t = f"w{i * 2654435761 % (1 << 32):x}"
        c = zlib.crc32(t.encode())
        if c in seen:
            out.append((seen[c], t))
        seen[c] = t
        if len(out) == n:
            return out
    return out


def test_null_ids_of_equal_crc(spark):
    """Texts that a short hash can't tell apart, all without an id; one of each pair is repeated elsewhere."""
    pairs = crc_pairs(20)
    assert len(pairs) >= 10
    tail = lambda k: " ".join(f"k{k}v{j}" for j in range(9))
    # equal tails keep the crc32 of the whole texts equal
    rows = [(None, f"{w} {tail(k)}") for k, pair in enumerate(pairs) for w in pair]
    assert all(zlib.crc32(rows[2 * k][1].encode()) == zlib.crc32(rows[2 * k + 1][1].encode()) for k in range(len(pairs)))
    rows += [(k, f"{tail(k)} {a}") for k, (a, _) in enumerate(pairs) if k % 2] + [(None, None), (None, ""), (-(2**63), rows[0][1])]
    assert result(spark, rows, 9) == brute(rows, 9)
    assert result(spark, rows, 10) == brute(rows, 10)


def test_hot_rows(spark):
    rows = [(None, "a b c d e f g h")] * 40 + [(i, "a b c d e f g h " + " ".join(f"x{i}y{j}" for j in range(12))) for i in range(20)] + [(5, "q " * 30)] * 20
    assert result(spark, rows, 6) == brute(rows, 6)


def test_empty(spark):
    assert result(spark, [], 35) == []


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=8))
def test_random(spark, docs):
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    assert result(spark, rows, 5) == brute(rows, 5)
