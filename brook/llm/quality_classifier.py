"""Quality classifier by co-training: one view sees a text's content, the other its metadata.

Content: shares of letter cases, digits, symbols and marks, lengths and repetition, each cut into
quantile bins.  Metadata: language, source and stated length, hashed or cut into bins.  Both views are
logistic regressions.  Over ``rounds`` rounds each labels all unlabelled rows of which it is sure for the
*other* view's training set, where those of a label count as at most ``each_round`` rows a round: all have
the same weight.  The views' scores are then calibrated on labelled rows that no
view has seen, and combined by a third regression.

Fitting collects at most ``sample`` labelled rows outside the held-out third.  All rows without a label
outside it take part: their features are written once, and each step of the regressions sums gradient and
Hessian over them in Spark.  Bins are cut at quantiles of all rows' values of ``DIGITS`` digits.  Scoring
is one map over all whole texts, without a shuffle.

Null or empty text and null metadata have bins of their own, so every row gets a score.  Repeated rows
score alike; null ids are allowed.  Where labels of both kinds are missing every row scores 1 and is
kept.  Other columns are not looked at; missing metadata columns count as null.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brook.llm import _text as T
from brook.llm._shared import kept, unused
from brook.llm.toxicity import held_out

CONTENT = ("words", "word_length", "upper", "digits", "symbols", "bangs", "pipes", "marks", "distinct_words", "distinct_lines", "words_a_line")
BINS = 16
DIGITS = 4
STEPS = 4  # of Newton's method in a round; each begins where the one before ended
HASHED = 64  # buckets of a metadata string
SYMBOLS = b"#*$%&<>@^~=+_\\/{}[]"


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, dtype=bool)
    m[list(chars)] = True
    return m


MASKS = [_mask(bytes(range(65, 91))), _mask(bytes(range(97, 123)) + bytes(range(128, 256))), _mask(b"0123456789"), _mask(SYMBOLS), _mask(b"!?"), _mask(b"|"), _mask(b".,;:")]
LINE = np.arange(256) != 10


def _share_distinct(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return np.bincount(d[new], minlength=n) / np.maximum(np.bincount(d, minlength=n), 1)


def run_content(run: T.Run) -> np.ndarray:
    """One row of CONTENT for each document of a run."""
    n, data, offsets = run.high - run.low, run.data, run.offsets
    w, lines = T.words(data, offsets), T.words(data, offsets, LINE)
    counts = []
    for m in MASKS:
        total = np.concatenate([[0], np.cumsum(m[data], dtype=np.int64)])
        counts.append(total[offsets[1:]] - total[offsets[:-1]])
    upper, lower, digits, symbols, bangs, pipes, marks = counts
    words, n_lines = np.diff(w.first), np.diff(lines.first)
    at_least = np.maximum(words, 1)
    length = np.bincount(w.doc, weights=w.end - w.begin, minlength=n) / at_least
    columns = [words, length, upper / np.maximum(upper + lower, 1), digits / np.maximum(upper + lower + digits, 1), symbols / at_least, bangs / at_least, pipes / at_least, marks / at_least]
    columns += [_share_distinct(T.word_hashes(data, w), w.doc, n), _share_distinct(T.word_hashes(data, lines), lines.doc, n), words / np.maximum(n_lines, 1)]
    return np.stack(columns, axis=1).astype(float)


def hashed(value: str | None, seed: int) -> int:
    return 0 if value is None else 1 + zlib.crc32(value.encode("utf-8", "replace"), seed) % (HASHED - 1)


def batch_metadata(b: pa.RecordBatch) -> np.ndarray:
    """Hash buckets of lang and source, and the stated length (-1: none)."""
    lang, source = ([hashed(v, k) for v in b.column(c).to_pylist()] for k, c in enumerate(("lang", "source")))
    return np.stack([np.array(lang, dtype=float), np.array(source, dtype=float), b.column("n_chars").fill_null(-1).to_numpy().astype(float)], axis=1)


# ---------------------------------------------------------------- the two views


class Model(NamedTuple):
    edges: list[np.ndarray]  # of each content column, and of the stated length
    content: np.ndarray
    metadata: np.ndarray
    mix: np.ndarray  # bias and weights of the calibrated views; empty: no model
    scale: np.ndarray  # bias and slope of each view's calibration


def _one_hot(columns: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    x = np.zeros((len(columns[0]), sum(sizes) + 1))
    x[:, -1] = 1.0
    at = 0
    for c, size in zip(columns, sizes, strict=True):
        x[np.arange(len(c)), at + c] = 1.0
        at += size
    return x


def content_view(content: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return _one_hot([np.searchsorted(e, content[:, k], side="right") for k, e in enumerate(edges[: len(CONTENT)])], [BINS] * len(CONTENT))


def metadata_view(metadata: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return _one_hot([metadata[:, 0].astype(int), metadata[:, 1].astype(int), np.searchsorted(edges[-1], metadata[:, 2], side="right")], [HASHED, HASHED, BINS])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Newton's method; the ridge holds for all weights, so separable classes do no harm."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _affine(z: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(z), 1)), np.clip(z.reshape(len(z), -1), -30, 30)], axis=1)


QUANTILES = np.linspace(0, 1, BINS + 1)[1:-1]
Weights = list[np.ndarray]  # of both views
#: For each view and label: how many rows the other view has labelled so, and their gradient and Hessian.
Totals = list[list[tuple[float, np.ndarray, np.ndarray]]]


def told(views: list[np.ndarray], history: list[Weights], weights: Weights, sure: float) -> Totals:
    """Of rows without a label.  A row has the label of the first round in which the other view was sure of it."""
    limit, out = np.log(sure / (1 - sure)), []
    for k in (0, 1):
        label = np.full(len(views[k]), -1)
        for past in history:
            z = views[1 - k] @ past[1 - k]
            label = np.where((label < 0) & (np.abs(z) >= limit), z > 0, label)
        out.append([(float((label == y).sum()), *_slopes(views[k][label == y], np.full((label == y).sum(), y), weights[k])) for y in (0, 1)])
    return out


def _slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x


def fit_views(edges: list[np.ndarray], content: np.ndarray, metadata: np.ndarray, y: np.ndarray, key: np.ndarray, totals: Callable[[list[Weights], Weights], Totals] | None, rounds: int, each_round: int, ridge: float = 1.0) -> Model:
    """From rows with labels, and the totals over rows without (None: there are no such rows)."""
    calibrates = key % 5 == 0
    if any(len(np.unique(y[part])) < 2 for part in (calibrates, ~calibrates)):
        return Model(edges, np.zeros(0), np.zeros(0), np.zeros(0), np.zeros((2, 2)))
    views = [content_view(content, edges), metadata_view(metadata, edges)]
    own = y[~calibrates]
    weights, history = [logistic(x[~calibrates], own) for x in views], []
    for n in range(1, rounds + 1 if totals else 1):
        history.append(weights)
        for _ in range(STEPS):
            moved, all_told = [], totals(history, weights)
            for x, w, by_label in zip(views, weights, all_told, strict=True):
                g, h = _slopes(x[~calibrates], own, w)
                for count, more_g, more_h in by_label:
                    share = min(1.0, n * each_round / max(count, 1.0))
                    g, h = g + share * more_g, h + share * more_h
                moved.append(np.linalg.solve(h + ridge * np.eye(len(w)), g + ridge * w))
            weights = [w - m for w, m in zip(weights, moved, strict=True)]
            if max(np.abs(m).max() for m in moved) < 1e-2:
                break
    z = [x[calibrates] @ w for x, w in zip(views, weights, strict=True)]
    scale = np.stack([logistic(_affine(v), y[calibrates], ridge=0.1) for v in z])
    both = np.stack([_affine(v) @ s for v, s in zip(z, scale, strict=True)], axis=1)
    return Model(edges, *weights, logistic(_affine(both), y[calibrates], ridge=0.1), scale)


def co_train(content: np.ndarray, metadata: np.ndarray, y: np.ndarray, key: np.ndarray, rounds: int, sure: float, each_round: int) -> Model:
    """Of rows at hand.  y: 0, 1 or -1 without a label.  key: chooses the fifth of the labelled rows that calibrates."""
    edges = [np.quantile(np.unique(c), QUANTILES) for c in (*content.T, metadata[:, 2])]  # of values, not rows: most shares are 0
    free, known = y < 0, y >= 0
    views = [content_view(content[free], edges), metadata_view(metadata[free], edges)]
    totals = (lambda history, weights: told(views, history, weights, sure)) if free.any() else None
    return fit_views(edges, content[known], metadata[known], y[known], key[known], totals, rounds, each_round)


def predict(m: Model, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
    """Columns: combined score, calibrated content view, calibrated metadata view."""
    if not len(m.mix):
        return np.ones((len(content), 3))
    z = [content_view(content, m.edges) @ m.content, metadata_view(metadata, m.edges) @ m.metadata]
    both = np.stack([_affine(v) @ s for v, s in zip(z, m.scale, strict=True)], axis=1)
    all_z = np.concatenate([(_affine(both) @ m.mix)[:, None], both], axis=1)
    return 1 / (1 + np.exp(-np.clip(all_z, -40, 40)))


# ---------------------------------------------------------------- Spark


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    has = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")
    return [F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("h"), text, has("lang", "string"), has("source", "string"), has("n_chars", "double")]


@T.lean
def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        metadata = batch_metadata(b)
        for run in T.runs(b.column("t")):
            both = np.concatenate([run_content(run), metadata[run.low : run.high]], axis=1)
            n = run.high - run.low
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * both.shape[1]), pa.array(both.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id").slice(run.low, n), b.column("h").slice(run.low, n), lists], ["id", "h", "x"])


def _score_rows(shared) -> Callable:
    @T.lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            metadata = batch_metadata(b)
            for run in T.runs(b.column("t")):
                p = predict(shared.value, run_content(run), metadata[run.low : run.high])
                n = run.high - run.low
                yield pa.RecordBatch.from_arrays([b.column("id").slice(run.low, n), b.column("h").slice(run.low, n), *(pa.array(p[:, k]) for k in range(3))], ["doc_id", "held_out", "score", "p_content", "p_metadata"])

    return rows


WIDTH = len(CONTENT) + 3


def _features(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


def rounded(v: np.ndarray) -> np.ndarray:
    """To DIGITS significant digits, so that there are only so many values."""
    unit = 10.0 ** (DIGITS - 1 - np.floor(np.log10(np.maximum(np.abs(v), 1e-9))))
    return np.round(v * unit) / unit


def _value_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = _features(b.column("x"))
        for k, c in enumerate((*range(len(CONTENT)), WIDTH - 1)):
            v = np.unique(rounded(x[:, c]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, dtype=np.int32)), pa.array(v)], ["k", "v"])


def _told_rows(shared) -> Callable:
    """One row a partition: the totals, Hessians without what is symmetric."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, history, weights, sure = shared.value
        total = 0.0
        for b in batches:
            x = _features(b.column("x"))
            for low in range(0, len(x), 4096):
                part = x[low : low + 4096]
                views = [content_view(part[:, : len(CONTENT)], edges), metadata_view(part[:, len(CONTENT) :], edges)]
                total = total + np.concatenate([np.concatenate([[n], g, h[np.triu_indices(len(g))]]) for by_label in told(views, history, weights, sure) for n, g, h in by_label])
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    return T.lean(rows)


def _spark_totals(unknown: DataFrame, edges: list[np.ndarray], sure: float) -> Callable[[list[Weights], Weights], Totals]:
    def totals(history: list[Weights], weights: Weights) -> Totals:
        shared = unknown.sparkSession.sparkContext.broadcast((edges, history, weights, sure))
        flat, at, out = 0.0, 0, []
        for r in unknown.mapInArrow(_told_rows(shared), "total binary").toLocalIterator():
            flat = flat + np.frombuffer(r.total)
        shared.destroy()
        for w in weights:
            by_label, n = [], len(w)
            for _ in (0, 1):
                g, upper = flat[at + 1 : at + 1 + n], np.zeros((n, n))
                upper[np.triu_indices(n)] = flat[at + 1 + n : at + 1 + n + n * (n + 1) // 2]
                by_label.append((flat[at], g, upper + np.triu(upper, 1).T))
                at += 1 + n + n * (n + 1) // 2
            out.append(by_label)
        return out

    return totals


def train(docs: DataFrame, labels: DataFrame, sample: int = 8_000, rounds: int = 5, sure: float = 0.97, each_round: int = 400, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    known = marks.where(~held_out("id")).orderBy(F.xxhash64("id"), "id").limit(sample)
    features = kept(docs.select(*_inputs(docs, id_col, text_col)).mapInArrow(_feature_rows, "id long, h boolean, x array<double>"), "features")
    # as many rows as ids at most, also where an id stands in many rows
    got = features.join(F.broadcast(known), "id").select("id", "y", "x").orderBy(F.xxhash64("id"), "id", F.xxhash64("x")).limit(sample).toPandas()
    if not len(got):
        return Model([], np.zeros(0), np.zeros(0), np.zeros(0), np.zeros((2, 2)))
    x = np.stack(got["x"].to_list())
    order = np.lexsort((*x.T, got["id"].to_numpy()))
    got, x = got.iloc[order], x[order]
    values = features.select("x").mapInArrow(_value_rows, "k int, v double").distinct()
    cuts = values.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, QUANTILES.tolist()))).alias("q")).collect()
    edges = [np.array(r.q) for r in sorted(cuts, key=lambda r: r.k)]
    key = np.array([zlib.crc32(row.tobytes()) for row in x])  # copies stay together
    unknown = kept(features.where(F.col("id").isNotNull() & ~F.col("h")).join(marks, "id", "left_anti").select("x"), "unknown")
    totals = None if unknown.isEmpty() else _spark_totals(unknown, edges, sure)
    model = fit_views(edges, x[:, : len(CONTENT)], x[:, len(CONTENT) :], got["y"].to_numpy(), key, totals, rounds, each_round)
    T.release()
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (that the text is good), both views' scores, and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(*_inputs(docs, id_col, text_col)).mapInArrow(_score_rows(shared), "doc_id long, held_out boolean, score double, p_content double, p_metadata double")
    return out.withColumn("kept", F.col("score") >= threshold)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that are kept, with all their columns as they are.  One map; rows are not matched by id."""
    shared, names, (inputs,) = docs.sparkSession.sparkContext.broadcast(model), docs.columns, unused(docs.columns, "inputs")
    side = ["id", "h", "t", "lang", "source", "n_chars"]

    @T.lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            inside = b.column(b.num_columns - 1)
            view = pa.RecordBatch.from_arrays(inside.flatten(), side)
            metadata, keep = batch_metadata(view), []
            for run in T.runs(view.column("t")):
                keep.append(predict(shared.value, run_content(run), metadata[run.low : run.high])[:, 0] >= threshold)
            mask = pa.array(np.concatenate([*keep, np.zeros(0, dtype=bool)]))
            yield pa.RecordBatch.from_arrays([b.column(k).filter(mask) for k in range(len(names))], names)

    return docs.select("*", F.struct(*_inputs(docs, id_col, text_col)).alias(inputs)).mapInArrow(rows, docs.schema)
