"""Substring deduplication by Rabin-Karp hashes of fixed-length word windows.

A window of ``length`` words is repeated when its word sequence starts at two places or more
(the same document included).  Every word that a repeated window covers is removed.

Plan, all counts in Spark and exact for every window:

1. Each window has one *anchor*: the leftmost least hash among the short grams it holds.  Equal
   windows have equal anchors, so a window whose anchor stands at one place only cannot repeat.
   About two anchors per ``length - gram + 2`` words are counted, instead of every window.
2. Windows whose anchor repeats are hashed (two independent Rabin-Karp values) and counted.
3. A key counted once carries its own place (``bit_xor`` of one value is that value), so only the
   places of *single* keys travel back to their documents and no key's group is ever gathered.
   Frequent keys shrink in each task before the shuffle.

A row's identity is 96 bits of two hashes over its id (null or not) and its whole text; a window's key is
96 bits too, so that a chance collision among 10^13 windows has a probability below one in a thousand.  Identical rows are copies of each other: each of their windows is repeated.
Null text: no words.  Null ids are allowed.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brook.llm import _text as T

#: Windows share at least this share of consecutive words with their anchor gram.
GRAM_SHARE = 0.45


def _combined(keys: list[np.ndarray], *carried: np.ndarray) -> list[np.ndarray]:
    """One row for each distinct key of the batch: keys, count, and the xor of each carried column (row identities, places)."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    if not len(order):
        return [*keys, np.zeros(0, np.int64), *carried]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(order)))
    return [*(k[at] for k in keys), count, *(np.bitwise_xor.reduceat(c[order], at) for c in carried)]


def _anchors(grams: np.ndarray, doc: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window: whether it lies in one document, and its anchor's position."""
    at = T.sliding_argmin(grams, length - gram + 1)
    return doc[: len(at)] == doc[length - 1 :], at


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of a column of lists; null is an empty list."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(np.asarray(column.offsets))
    if column.null_count:
        sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    return np.repeat(np.arange(len(column)), sizes), values


def _marked(run: T.Run, w: T.Words, lists: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A flag for each word of the run, set where the lists name it."""
    rows, values = lists
    lo, hi = np.searchsorted(rows, [run.low, run.high])
    flag = np.zeros(len(w.begin), dtype=bool)
    flag[w.first[rows[lo:hi] - run.low] + values[lo:hi]] = True
    return flag


def _anchor_rows(length: int, gram: int) -> Callable:
    @T.lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = b.column("k").to_numpy(), b.column("c").to_numpy()
            for run in T.runs(b.column("t")):
                w = T.words(run.data, run.offsets)
                grams = T.window_hashes(T.word_hashes(run.data, w), gram)
                ok, at = _anchors(grams, w.doc, length, gram)
                at = np.unique(at[ok])
                doc = w.doc[at]
                out = _combined([grams[at].view(np.int64)], one[run.low + doc], two[run.low + doc], (at - w.first[doc]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["a", "n", "k", "c", "p"])

    return rows


def _window_rows(length: int, gram: int) -> Callable:
    @T.lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two, singles = b.column("k").to_numpy(), b.column("c").to_numpy(), _lists(b.column("single"))
            for run in T.runs(b.column("t")):
                w = T.words(run.data, run.offsets)
                h = T.word_hashes(run.data, w)
                ok, at = _anchors(T.window_hashes(h, gram), w.doc, length, gram)
                at = np.flatnonzero(ok & ~_marked(run, w, singles)[at])
                doc = w.doc[at]
                keys = [T.window_hashes(h, length)[at].view(np.int64), (T.window_hashes(h, length, T.OTHER_BASE)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)]
                out = _combined(keys, one[run.low + doc], two[run.low + doc], (at - w.first[doc]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["a", "b", "n", "k", "c", "p"])

    return rows


def _removal_rows(length: int, gram: int, keep_text: bool) -> Callable:
    @T.lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            singles, alone = _lists(b.column("single")), _lists(b.column("alone"))
            counts, removed, digests, texts = [], [], [], []
            for run in T.runs(b.column("t")):
                w = T.words(run.data, run.offsets)
                ok, at = _anchors(T.window_hashes(T.word_hashes(run.data, w), gram), w.doc, length, gram)
                repeated = ok & ~_marked(run, w, singles)[at] & ~_marked(run, w, alone)[: len(at)]
                steps = np.zeros(len(w.begin) + 1, dtype=np.int64)
                steps[: len(at)] += repeated
                steps[length : length + len(at)] -= repeated
                gone = np.cumsum(steps[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                here = total[w.first[1:]] - total[w.first[:-1]]
                counts.append(np.diff(w.first))
                removed.append(here)
                whole = run.data.tobytes()
                for d in range(run.high - run.low):
                    kept = whole[run.offsets[d] : run.offsets[d + 1]].split()
                    if here[d]:
                        kept = list(compress(kept, ~gone[w.first[d] : w.first[d + 1]]))
                    text = b" ".join(kept)
                    digests.append(hashlib.sha256(text).hexdigest())
                    if keep_text:
                        texts.append(text.decode("utf-8", "replace"))
            out = {"doc_id": b.column("id"), "n_words": pa.array(np.concatenate([*counts, np.zeros(0, np.int64)])), "n_removed": pa.array(np.concatenate([*removed, np.zeros(0, np.int64)])), "kept_sha256": pa.array(digests, pa.string())}
            if keep_text:
                out["kept_text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return rows


def remove_repeated_windows(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, if asked, kept_text (kept words joined by one space).

    Texts with fewer than ``length`` words keep everything.  All of a text may go: kept_text is then empty.
    """
    gram = max(1, round(length * GRAM_SHARE))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"))
    # hashes of a null are those of nothing, so its being null is hashed too
    whole = [F.col("id").isNull(), F.col("id"), F.col("t")]
    base = base.select("id", F.xxhash64(*whole).alias("k"), F.hash(*whole).alias("c"), "t")

    def places(counted: DataFrame, keys: list[str], name: str) -> DataFrame:
        once = counted.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.bit_xor(x).alias(x) for x in ("k", "c", "p"))).where("n = 1")
        return once.groupBy("k", "c").agg(F.collect_list("p").alias(name))

    single = places(base.select("k", "c", "t").mapInArrow(_anchor_rows(length, gram), "a long, n long, k long, c int, p int"), ["a"], "single")
    known = base.join(single, ["k", "c"], "left")  # both readers take the same columns, so texts are shuffled once
    alone = places(known.select("id", "k", "c", "t", "single").mapInArrow(_window_rows(length, gram), "a long, b int, n long, k long, c int, p int"), ["a", "b"], "alone")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return known.join(alone, ["k", "c"], "left").select("id", "t", "single", "alone").mapInArrow(_removal_rows(length, gram, keep_text), schema)
