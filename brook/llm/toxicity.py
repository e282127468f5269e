"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its words (digits, letters and everything beyond ASCII; A-Z lower-cased) and the
first 4 to 7 bytes of longer words, hashed into ``2**BUCKET_BITS`` buckets, present or absent.  The
machine's score is ``sigmoid(b + sum w_i + sum <v_i, v_j>)``: pairs of terms that stand together have
a say of their own, which a linear weight can't give them.

Training sees at most ``sample`` labelled rows outside the held-out third (those of least hashed id);
chi-square keeps ``terms`` buckets of them, three of four for terms that speak for toxicity, so that
long clean passages can't outvote a short toxic one.  Scores are shifted so that the threshold of best
F1 on a validation part becomes 0.7.  Scoring is one map over all whole texts, without a shuffle.

Null or empty text: no terms, so the score of the bias alone.  Null ids: never labelled, not held out.
Repeated rows score alike.  Without labels of both kinds every score is 0.  Labels, lang, source and
id are no inputs of a score; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brook.llm import _text as T

BUCKET_BITS = 20
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.7


class Machine(NamedTuple):
    index: np.ndarray  # of each bucket; -1: not a term
    bias: float
    w: np.ndarray
    v: np.ndarray


def held_out(id_col: str = "doc_id") -> Column:
    """The third of the rows whose labels are never learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


# ---------------------------------------------------------------- terms


def run_terms(run: T.Run) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a run and buckets, with repeats."""
    data = T.FOLD[run.data]
    w = T.words(data, run.offsets, T.ALNUM)
    docs, hashes = [w.doc], [T.word_hashes(data, w)]
    for n in PREFIXES:
        longer = np.flatnonzero(w.end - w.begin > n)
        begin = w.begin[longer]
        docs.append(w.doc[longer])
        hashes.append(T.mix(T.word_hashes(data, T.Words(begin, begin + n, w.doc[longer], w.first)) ^ np.uint64(n)))
    return np.concatenate(docs), (np.concatenate(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def distinct(doc: np.ndarray, term: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc * terms + term)
    return both // terms, both % terms


@T.lean
def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for run in T.runs(b.column("t")):
            doc, term = distinct(*run_terms(run), 1 << BUCKET_BITS)
            ends = np.searchsorted(doc, np.arange(run.high - run.low + 1))
            term = term.astype("<i4")
            lists = pa.array([term[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            n = run.high - run.low
            yield pa.RecordBatch.from_arrays([b.column("id").slice(run.low, n), b.column("y").slice(run.low, n), lists], ["id", "y", "terms"])


# ---------------------------------------------------------------- training


def choose(doc: np.ndarray, bucket: np.ndarray, y: np.ndarray, terms: int) -> np.ndarray:
    """Buckets of largest chi-square, three quarters of them for toxicity; each in three documents at least."""
    size = 1 << BUCKET_BITS
    a = np.bincount(bucket[y[doc] == 1], minlength=size).astype(float)
    n = np.bincount(bucket, minlength=size).astype(float)
    pos, total = float(y.sum()), float(len(y))
    expected = n * pos / total
    chi = (a - expected) ** 2 / np.maximum(expected * (1 - n / total) * (1 - pos / total), 1e-9)
    chi[(n < 3) | (chi < 6.6)] = 0.0  # one in a hundred by chance
    chosen = []
    for part, most in ((a > expected, terms * 3 // 4), (a <= expected, terms // 4)):
        value = np.where(part, chi, 0.0)
        best = np.argsort(-value, kind="stable")[:most]
        chosen.append(best[value[best] > 0])
    return np.concatenate(chosen)


class Rows(NamedTuple):
    """Documents' terms one after another, and where each document's begin."""

    term: np.ndarray
    first: np.ndarray


def _sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def raw_scores(m: Machine, rows: Rows) -> np.ndarray:
    v = m.v[rows.term]
    s = _sum(v, rows.first)
    pairs = 0.5 * (s * s - _sum(v * v, rows.first)).sum(axis=1)
    return m.bias + _sum(m.w[rows.term], rows.first) + pairs


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: Rows, y: np.ndarray, n_terms: int, factors: int, epochs: int, rate: float, decay: float, seed: int = 0) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam on the logistic loss in small batches."""
    rng = np.random.default_rng(seed)
    p = [np.array([np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))]), np.zeros(n_terms), rng.normal(0, 0.01, (n_terms, factors))]
    first, second, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    counts = np.diff(rows.first)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for low in range(0, len(order), 256):
            some = order[low : low + 256]
            n = counts[some]
            starts = np.concatenate([[0], np.cumsum(n)])
            term = rows.term[np.repeat(rows.first[some] - starts[:-1], n) + np.arange(starts[-1])]
            v = p[2][term]
            s = _sum(v, starts)
            z = p[0][0] + _sum(p[1][term], starts) + 0.5 * (s * s - _sum(v * v, starts)).sum(axis=1)
            g = (sigmoid(z) - y[some]) / len(some)
            each = np.repeat(g, n)
            gw = np.bincount(term, weights=each, minlength=n_terms) + decay * p[1]
            slope = each[:, None] * (np.repeat(s, n, axis=0) - v)
            gv = np.stack([np.bincount(term, weights=slope[:, f], minlength=n_terms) for f in range(factors)], axis=1) + decay * p[2]
            step += 1
            for i, grad in enumerate((np.array([g.sum()]), gw, gv)):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                p[i] = p[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return float(p[0][0]), p[1], p[2]


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The raw score of best F1, halfway to the next one below."""
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(len(y)) + 1 + y.sum())
    k = int(f1.argmax())
    below = score[order[k + 1]] if k + 1 < len(order) else score[order[k]] - 2.0
    return float((score[order[k]] + below) / 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000, terms: int = 4096, factors: int = 4, epochs: int = 12, rate: float = 0.02, decay: float = 1e-5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """A machine from at most ``sample`` labelled rows that aren't held out, those of least hashed id.

    Their ids are bounded by ``sample`` and broadcast.  Where an id stands in many rows, at most ``sample`` rows in all count."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    got = texts.join(F.broadcast(chosen), "id").mapInArrow(_term_rows, "id long, y int, terms binary")
    got = got.orderBy(F.xxhash64("id"), "id", F.xxhash64("terms")).limit(sample).toPandas()
    size = 1 << BUCKET_BITS
    none = Machine(np.full(size, -1, dtype=np.int32), -40.0, np.zeros(1), np.zeros((1, factors)))
    if got.empty or got["y"].nunique() < 2:
        return none
    got = got.iloc[np.lexsort((got["terms"], got["id"]))]
    y = got["y"].to_numpy()
    lists = [np.frombuffer(x, dtype="<i4") for x in got["terms"]]
    doc, bucket = np.repeat(np.arange(len(y)), [len(x) for x in lists]), np.concatenate(lists)
    known = choose(doc, bucket, y, terms)
    if not len(known):
        return none
    index = np.full(size, -1, dtype=np.int32)
    index[known] = np.arange(len(known))
    keep = index[bucket] >= 0
    doc, term = doc[keep], index[bucket[keep]]
    rows = Rows(term, np.searchsorted(doc, np.arange(len(y) + 1)))
    # the same third by copies: equal term lists stay together in the part that sets the threshold
    part = np.array([hash_of(x) % 5 == 0 for x in got["terms"]])

    def subset(mask: np.ndarray) -> Rows:
        kept = mask[doc]
        return Rows(term[kept], np.searchsorted(np.cumsum(mask)[doc[kept]] - 1, np.arange(mask.sum() + 1)))

    shift = 0.0
    if 0 < y[part].sum() < part.sum() and 0 < y[~part].sum() < (~part).sum():
        m = Machine(index, *fit(subset(~part), y[~part], len(known), factors, epochs, rate, decay))
        shift = best_threshold(raw_scores(m, subset(part)), y[part])
    bias, w, v = fit(rows, y, len(known), factors, epochs, rate, decay)
    return Machine(index, bias - shift + float(np.log(THRESHOLD / (1 - THRESHOLD))), w, v)


def hash_of(terms: bytes) -> int:
    import zlib

    return zlib.crc32(terms)


# ---------------------------------------------------------------- scoring


def _score_rows(shared) -> Callable:
    @T.lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Machine = shared.value
        for b in batches:
            for run in T.runs(b.column("t")):
                doc, bucket = run_terms(run)
                term = m.index[bucket]
                doc, term = distinct(doc[term >= 0], term[term >= 0].astype(np.int64), len(m.w))
                n = run.high - run.low
                z = raw_scores(m, Rows(term, np.searchsorted(doc, np.arange(n + 1))))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(run.low, n), b.column("h").slice(run.low, n), pa.array(sigmoid(z))], ["doc_id", "held_out", "score"])

    return rows


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1) and predicted (1 from THRESHOLD on)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("h"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return texts.mapInArrow(_score_rows(shared), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
