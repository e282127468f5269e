"""Best-fit packing of token sequences by the sum-of-squares rule.

1. Each text becomes token ids plus an end id; more than ``capacity`` ids are cut into full pieces, of
   which the first may be shorter.  One map over the rows; every piece also gets its rank among the
   pieces of its length in its task.  The pieces are written to the shared folder.
2. The histogram of lengths (at most ``capacity`` numbers) is all that the driver sees.  It places
   lengths, longest first, each into the open bin for which the squared counts of open bins per
   residual gap become smallest (ties: the smaller gap); a new bin is opened only where no open one
   has room.  Beyond ``plan_items`` pieces one step places a length into ``unit`` bins at once; what is
   left over is planned with a smaller unit, down to 1, into the same open bins.  So the plan is bounded, and
   no piece is left.
3. A piece's rank among all pieces of its length (task offsets plus local rank) finds its place in the
   plan, which is broadcast: at most ``plan_items`` rows for each unit.

Null or empty text: the end id alone.  Repeated rows are packed as often as they stand there; null ids
are kept; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brook.llm import _text as T
from brook.llm._shared import kept

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
#: Texts of these characters only are split alike by both tokenizer libraries.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ſ]*")
SPECIAL = "<|endoftext|>"


# ---------------------------------------------------------------- tokens


@lru_cache(maxsize=2)
def encoder(tokenizer_path: str, ranks_path: str | None) -> Callable[[list[str]], list]:
    """Ids as the tokenizer file gives them.  Plain texts may take the same vocabulary's ranks, which is faster."""
    import base64

    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_path)
    if ranks_path is None:
        return lambda texts: [slow.encode(t, add_special_tokens=False).ids for t in texts]
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list:
        return [fast.encode_ordinary(t) if PLAIN.fullmatch(t) and SPECIAL not in t else slow.encode(t, add_special_tokens=False).ids for t in texts]

    return encode


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of n ids."""
    first = n % capacity if n > capacity else 0
    starts = [0] * bool(first) + list(range(first, n, capacity))
    return [(s, (first if s == 0 and first else min(capacity, n - s))) for s in starts]


def _piece_rows(tokenizer_path: str, ranks_path: str | None, capacity: int, end_id: int, keep_ids: bool) -> Callable:
    @T.lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), Counter()
        encode = encoder(tokenizer_path, ranks_path)
        for b in batches:
            ids, texts = b.column("id").to_pylist(), b.column("t")
            for low in range(0, b.num_rows, 256):
                out: list[list] = [[] for _ in range(7 + keep_ids)]
                for k, tokens in zip(ids[low : low + 256], encode(texts[low : low + 256].to_pylist()), strict=True):
                    tokens = np.asarray([*tokens, end_id], dtype="<u4")
                    for piece, (start, length) in enumerate(cuts(len(tokens), capacity)):
                        part = tokens[start : start + length]
                        row = [k, piece, start, length, zlib.crc32(part.tobytes()), task, seen[length]]
                        seen[length] += 1
                        for column, value in zip(out, [*row, part.astype("i4")] if keep_ids else row, strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names[: len(out)])

    return rows


# ---------------------------------------------------------------- the plan


def place(sizes: np.ndarray, capacity: int, opened: list[list[list[int]]] | None = None, start: int = 0, step: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """Sum of squares over sizes in falling order, all below capacity: bin and offset of each, and how many bins are new.

    ``opened``: by residual gap, runs [bin, how many] of bins that lie ``step`` apart; it is kept up to date.
    New bins are numbered from ``start``, ``step`` apart."""
    opened = [[] for _ in range(capacity + 1)] if opened is None else opened
    counts = np.array([sum(many for _, many in runs) for runs in opened], dtype=np.int64)
    bins, offsets, n = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    far = np.int64(1) << 60
    for k, s in enumerate(sizes.tolist()):
        had = counts[s:capacity]
        change = 2 * (counts[: capacity - s] - had) + 2  # of the sum of squares, if gap s + i becomes i
        change[0] = 1 - 2 * had[0]  # a full bin isn't open any more
        change[had == 0] = far
        i = int(change.argmin()) if len(change) else 0
        if len(change) and change[i] < far:
            gap = s + i
            run = opened[gap][-1]
            run[1] -= 1
            b = run[0] + run[1] * step
            if not run[1]:
                opened[gap].pop()
            counts[gap] -= 1
        else:
            gap, b, n = capacity, start + n * step, n + 1
        bins[k], offsets[k] = b, capacity - gap
        if gap > s:
            counts[gap - s] += 1
            opened[gap - s].append([b, 1])
    return bins, offsets, n


def plan(histogram: dict[int, int], capacity: int, plan_items: int) -> dict[str, np.ndarray]:
    """Runs of places: from rank ``first`` on, ``unit`` pieces of ``length`` lie at ``offset`` of the sequences from ``sequence`` on."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    runs: dict[str, list] = {k: [] for k in ("length", "first", "sequence", "offset")}
    done, total = np.zeros(capacity + 1, dtype=np.int64), 0

    def add(length, first, sequence, offset):
        for k, v in zip(runs, (length, first, sequence, offset), strict=True):
            runs[k].append(np.asarray(v, dtype=np.int64))

    if left[capacity]:  # full pieces have a sequence each
        add([capacity], [0], [0], [0])
        total, left[capacity] = int(left[capacity]), 0
    unit = 1
    while left.sum() // unit > plan_items:
        unit *= 2
    opened: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    while left.any():
        each = left // unit
        sizes = np.repeat(np.arange(capacity, -1, -1), each[::-1])
        bins, offsets, n = place(sizes, capacity, opened, total, unit)
        nth = np.arange(len(sizes)) - np.searchsorted(-sizes, -sizes)
        add(sizes, done[sizes] + nth * unit, bins, offsets)
        total += n * unit
        done += each * unit
        left -= each * unit
        finer = max(1, unit // 64)
        opened = [[[b, many * (unit // finer)] for b, many in runs] for runs in opened]
        unit = finer
    out = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in runs.items()}
    order = np.lexsort((out["first"], out["length"]))
    return {k: v[order] for k, v in out.items()}


def _placed_rows(runs, columns: list[str]) -> Callable:
    @T.lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = runs.value
        key = (p["length"] << np.int64(48)) | p["first"]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(key, (length << np.int64(48)) | rank, side="right") - 1
            where = [pa.array(p["sequence"][at] + rank - p["first"][at]), pa.array(p["offset"][at])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *where], [*columns, "sequence_id", "offset"])

    return rows


# ---------------------------------------------------------------- the operator


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = 1024, end_id: int = 2, plan_items: int = 1 << 18, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids), sequence_id and offset."""
    spark = docs.sparkSession
    schema = SCHEMA + ", ids array<int>" * keep_ids
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    pieces = kept(texts.mapInArrow(_piece_rows(tokenizer_path, ranks_path, capacity, end_id, keep_ids), schema), "pieces")
    counts = pieces.groupBy("task", "length").agg((F.max("rank") + 1).alias("n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(offsets, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    runs = spark.sparkContext.broadcast(plan(totals, capacity, plan_items))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(_placed_rows(runs, columns), out)
