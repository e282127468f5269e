"""Benchmark decontamination: texts that hold a benchmark item, up to a share of edited words.

Items and texts are sequences of words (digits, letters and everything beyond ASCII; A-Z lower-cased).

1. Items are grouped by length.  For each group, windows of an item's size start at every word of every
   text; those with more words foreign to the group's items than edits allow are passed over (they
   can't match).
2. CGK embedding: a random walk over the window copies a word a step and moves on by a random bit of
   (word, step), so that few edits change few places of the copy.  Bit-sampling LSH takes ``samples``
   places of it as a key; windows whose key equals an item's are candidates.  Walks are repeated until
   simulated copies with as many edits as allowed, inside other text, are found with the probability
   ``recall``; where MOST_WALKS don't reach it, an error says so.  Items of more than ``PART_WORDS`` words
   are sought by their parts: in any copy one part holds no more than its share of the edits.
3. Candidates are verified exactly: the least edit distance (in words) between the item and any stretch
   of the text there must be at most ``edit_share`` of the item's words.

Items go to the tasks in blocks of at most ``block_words`` words, one pass over the texts a block; the
texts are mapped where they lie, without a shuffle.

Texts or items that are null or empty match nothing, nor do items of fewer than ``least_words`` words.
Repeated rows give repeated results; items that are equal are all reported.  Null ids are allowed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brook.llm import _text as T
from brook.llm._shared import unused

GROWTH = 1.2  # of lengths within a group
MOST_WALKS = 4096  # beyond this the parameters don't allow the recall
PART_WORDS = 60
VERIFIED = 1 << 20  # words of texts compared at once
TABLE_BITS = 20
FILTER_BITS = 18
STEP_SALT, KEY_BASE = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95)


class Walk(NamedTuple):
    """Steps' multipliers (their products' top bits move the walk on), sampled steps, and the items' sorted keys."""

    moves: np.ndarray
    sampled: np.ndarray
    keys: np.ndarray
    owners: np.ndarray
    filter: np.ndarray


class Group(NamedTuple):
    least: int
    edits: int  # allowed for the group's longest item
    walks: list[Walk]
    recall: float  # of simulated copies


class Seed(NamedTuple):
    """What is sought by its keys: an item or a part of one."""

    item: int
    words: np.ndarray
    offset: int  # in the item


class Plan(NamedTuple):
    items: list[tuple[int, np.ndarray]]
    groups: list[Group]
    table: np.ndarray  # for each hash of a word, the groups that have it
    edit_share: float
    seeds: list[Seed] = []  # the walks' owners


def item_words(text: str) -> np.ndarray:
    run = next(T.runs(pa.array([text])))
    data = T.FOLD[run.data]
    return T.word_hashes(data, T.words(data, run.offsets, T.ALNUM))


def allowed(length: int, edit_share: float) -> int:
    return int(length * edit_share)


# ---------------------------------------------------------------- embedding and keys


def walk_keys(words: np.ndarray, starts: np.ndarray, moves: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """Keys of the walks that begin at ``starts``; words needs len(moves) entries behind the last start."""
    at, key = starts.copy(), np.zeros(len(starts), dtype=np.uint64)
    taken = set(sampled.tolist())
    for j in range(int(sampled[-1]) + 1):
        here = words[at]
        if j in taken:
            key = (key ^ here) * KEY_BASE
        at += ((here * moves[j]) >> np.uint64(63)).view(np.int64)
    return T.mix(key)


def make_walks(least: int, samples: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(least)
    steps = max(samples, int(1.6 * least))
    for _ in range(n):
        yield T.mix(rng.integers(1, 1 << 63, steps).astype(np.uint64)) | np.uint64(1), np.sort(rng.choice(steps, samples, replace=False))


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    out = words.tolist()
    for _ in range(edits):
        at, kind = int(rng.integers(0, max(1, len(out)))), int(rng.integers(0, 3))
        new = int(rng.integers(1, 1 << 63))
        out[at : at + (kind != 1)] = [] if kind == 2 else [new]
    return np.array(out, dtype=np.uint64)


def _padded(words: np.ndarray, steps: int) -> np.ndarray:
    return np.concatenate([words, np.zeros(steps, dtype=np.uint64)])


def _in_a_row(some: list[np.ndarray], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Padded words one after the other, and where each begins."""
    rows = [_padded(w, steps) for w in some]
    return np.concatenate(rows), np.cumsum([0, *map(len, rows[:-1])])


def plan_group(members: list[int], seeds: list[Seed], least: int, edit_share: float, samples: int, recall: float, trials: int) -> Group:
    """As many walks as simulated copies with all edits allowed need to be found with the given probability."""
    steps, rng = max(samples, int(1.6 * least)), np.random.default_rng(7)
    found = np.zeros(trials, dtype=bool)
    chosen = np.arange(trials) % len(members)
    own = _in_a_row([seeds[m].words for m in members], steps)
    copies = [edited(seeds[members[c]].words, allowed(len(seeds[members[c]].words), edit_share), rng) for c in chosen]
    # a copy is followed by other words, an item by none
    copied = _in_a_row([np.concatenate([c, rng.integers(1, 1 << 63, steps).astype(np.uint64)]) for c in copies], steps)
    out, reached = [], 0.0
    for moves, sampled in make_walks(least, samples, MOST_WALKS):
        keys = walk_keys(*own, moves, sampled)
        order = np.argsort(keys, kind="stable")
        mask = np.zeros(1 << FILTER_BITS, dtype=bool)
        mask[keys >> np.uint64(64 - FILTER_BITS)] = True
        out.append(Walk(moves, sampled, keys[order], np.array(members)[order], mask))
        found |= keys[chosen] == walk_keys(*copied, moves, sampled)
        reached = float(found.mean())
        if reached >= recall:
            return Group(least, max(allowed(len(seeds[m].words), edit_share) for m in members), out, reached)
    raise ValueError(f"items of {least} words: {MOST_WALKS} walks find {reached:.3f} of copies, not {recall}; fewer samples or a smaller edit_share are needed")


def make_seeds(items: list[tuple[int, np.ndarray]]) -> list[Seed]:
    """Items, longer ones in parts of even lengths; shortest first."""
    seeds = []
    for k, (_, w) in enumerate(items):
        parts = -(-len(w) // PART_WORDS)
        cuts = [len(w) * p // parts for p in range(parts + 1)]
        seeds += [Seed(k, w[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return sorted(seeds, key=lambda x: len(x.words))


def make_plan(items: list[tuple[int, str]], edit_share: float, samples: int, recall: float, least_words: int, trials: int = 200) -> Plan:
    known = [(i, w) for i, t in items if t and len(w := item_words(t)) >= least_words]
    known.sort(key=lambda x: len(x[1]))
    seeds = make_seeds(known)
    table = np.zeros(1 << TABLE_BITS, dtype=np.uint64)
    groups: list[Group] = []
    at = 0
    while at < len(seeds):
        least = len(seeds[at].words)
        end = at
        while end < len(seeds) and len(seeds[end].words) <= max(least, GROWTH * least):
            end += 1
        members = list(range(at, end))
        words = np.concatenate([seeds[m].words for m in members])
        table[words >> np.uint64(64 - TABLE_BITS)] |= np.uint64(1) << np.uint64(min(len(groups), 63))
        groups.append(plan_group(members, seeds, least, edit_share, samples, recall, trials))
        at = end
    return Plan(known, groups, table, edit_share, seeds)


# ---------------------------------------------------------------- verification


def distances(items: np.ndarray, lengths: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: the least edit distance between the item and any stretch of the text, and where the first such stretch ends."""
    n, width = texts.shape
    along = np.arange(width + 1)
    row = np.zeros((n, width + 1), dtype=np.int64)
    last = row.copy()
    for i in range(items.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (items[:, i : i + 1] != texts), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - along, axis=1) + along
        done = lengths == i + 1
        last[done] = row[done]
    end = last.argmin(axis=1)
    return last[np.arange(n), end], end


def verify(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, owners: np.ndarray, plan: Plan, of_seeds: bool = False) -> tuple[np.ndarray, ...]:
    """Exact distances of candidate stretches: edits, start and end word (positions in the run).  owners: items or seeds."""
    edits, first, last = (np.zeros(len(starts), dtype=np.int64) for _ in range(3))
    known = plan.seeds if of_seeds else plan.items
    at_once = max(1, min(512, VERIFIED // int((ends - starts).max(initial=1))))
    for low in range(0, len(starts), at_once):
        some = slice(low, low + at_once)
        lo, hi, own = starts[some], ends[some], [known[o][1] for o in owners[some]]
        lengths = np.array([len(w) for w in own])
        items = np.zeros((len(own), lengths.max()), dtype=np.uint64)
        for i, w in enumerate(own):
            items[i, : len(w)] = w
        place = lo[:, None] + np.arange((hi - lo).max())
        texts = np.where(place < hi[:, None], h[np.minimum(place, len(h) - 1)], np.uint64(0))
        edits[some], end = distances(items, lengths, texts)
        # the same from the end backwards gives the start
        back = np.zeros_like(items)
        for i, w in enumerate(own):
            back[i, : len(w)] = w[::-1]
        from_end = (lo + end)[:, None] - 1 - np.arange(texts.shape[1])
        turned = np.where(from_end >= lo[:, None], h[np.maximum(from_end, 0)], np.uint64(0))
        first[some], last[some] = lo + end - _anchored(back, lengths, turned, edits[some]), lo + end
    return edits, first, last


def _anchored(items: np.ndarray, lengths: np.ndarray, texts: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Length of the shortest stretch from the texts' beginning at the given distance."""
    n, width = texts.shape
    along = np.arange(width + 1)
    row = np.repeat(along[None, :], n, axis=0)
    last = row.copy()
    for i in range(items.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (items[:, i : i + 1] != texts), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - along, axis=1) + along
        done = lengths == i + 1
        last[done] = row[done]
    return (last == edits[:, None]).argmax(axis=1)


# ---------------------------------------------------------------- the operator


def candidates(h: np.ndarray, end_of: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows and seeds with equal keys.  end_of: where each word's document ends."""
    known = plan.table[h >> np.uint64(64 - TABLE_BITS)]
    all_starts, all_owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for g, group in enumerate(plan.groups):
        mine = (known >> np.uint64(min(g, 63))) & np.uint64(1)
        span = max(1, group.least - group.edits)
        total = np.concatenate([[0], np.cumsum(mine, dtype=np.int64)])
        at = np.arange(len(h) - span + 1)
        starts = np.flatnonzero((total[span:] - total[:-span] >= span - group.edits) & (at + span <= end_of[at]))
        if not len(starts):
            continue
        words = _padded(h, len(group.walks[0].moves))
        for walk in group.walks:
            key = walk_keys(words, starts, walk.moves, walk.sampled)
            maybe = np.flatnonzero(walk.filter[key >> np.uint64(64 - FILTER_BITS)])
            low, high = (np.searchsorted(walk.keys, key[maybe], side=s) for s in ("left", "right"))
            n = high - low
            if n.any():
                all_starts.append(np.repeat(starts[maybe], n))
                all_owners.append(walk.owners[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
    return np.concatenate(all_starts), np.concatenate(all_owners)


SCHEMA = "doc_id long, item_id long, start_word long, end_word long, edits int, item_words int"


class Leaks(NamedTuple):
    """Of a run: documents and items, the best place of each pair (words of the document, end exclusive) and its edits."""

    doc: np.ndarray
    item: np.ndarray
    first: np.ndarray
    last: np.ndarray
    edits: np.ndarray


def run_leaks(run: T.Run, plan: Plan) -> Leaks:
    none = np.zeros(0, dtype=np.int64)
    data = T.FOLD[run.data]
    w = T.words(data, run.offsets, T.ALNUM)
    h = T.word_hashes(data, w)
    if not len(h):
        return Leaks(none, none, none, none, none)
    start, seed = candidates(h, w.first[1:][w.doc], plan)
    if not len(start):
        return Leaks(none, none, none, none, none)
    lengths, item_of, offset = np.array([(len(x.words), x.item, x.offset) for x in plan.seeds]).T
    sizes = np.array([len(x) for _, x in plan.items])
    # windows of a seed that start close by are verified as one stretch
    doc, seed, block = np.unique(np.stack([w.doc[start], seed, start // np.maximum(4, lengths[seed] // 4)]), axis=1)
    step, most = np.maximum(4, lengths[seed] // 4), (lengths[seed] * plan.edit_share).astype(np.int64)
    lo = np.maximum(block * step - most, w.first[doc])
    hi = np.minimum((block + 1) * step + lengths[seed] + most, w.first[doc + 1])
    edits, first, last = verify(h, lo, hi, seed, plan, of_seeds=True)
    near, own = edits <= most, item_of[seed]
    # of an item in parts, the whole is verified where a part is found
    part = near & (lengths[seed] < sizes[own])
    if part.any():
        wide = np.maximum(4, sizes[own] // 4)
        d, o, around = np.unique(np.stack([doc[part], own[part], (block * step - offset[seed])[part] // wide[part]]), axis=1)
        wide, more = np.maximum(4, sizes[o] // 4), (sizes[o] * plan.edit_share).astype(np.int64)
        lo = np.maximum(around * wide - more, w.first[d])
        hi = np.minimum((around + 1) * wide + PART_WORDS // 4 + sizes[o] + more, w.first[d + 1])
        whole = verify(h, lo, hi, o, plan)
        alone = near & ~part
        doc, own, most = np.concatenate([doc[alone], d]), np.concatenate([own[alone], o]), np.concatenate([most[alone], more])
        edits, first, last = (np.concatenate([a[alone], b]) for a, b in zip((edits, first, last), whole, strict=True))
    good = np.flatnonzero(edits <= most)
    good = good[np.lexsort((first[good], edits[good], own[good], doc[good]))]
    new = np.ones(len(good), dtype=bool)
    new[1:] = (doc[good][1:] != doc[good][:-1]) | (own[good][1:] != own[good][:-1])
    best = good[new]
    base = w.first[doc[best]]
    return Leaks(doc[best], own[best], first[best] - base, last[best] - base, edits[best])


def _rows(shared) -> Callable:
    @T.lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value.items
        for b in batches:
            for run in T.runs(b.column("t")):
                x = run_leaks(run, shared.value)
                names, sizes = [items[o][0] for o in x.item], [len(items[o][1]) for o in x.item]
                columns = [b.column("id").take(pa.array(run.low + x.doc)), pa.array(names, pa.int64()), pa.array(x.first), pa.array(x.last), pa.array(x.edits.astype(np.int32)), pa.array(sizes, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return rows


def _clean_rows(shared, names: list[str]) -> Callable:
    @T.lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, dtype=bool)
            for run in T.runs(b.column(len(names))):
                keep[run.low + run_leaks(run, shared.value).doc] = False
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(k).filter(mask) for k in range(len(names))], names)

    return rows


def plans(benchmark: DataFrame, edit_share: float, samples: int, recall: float, least_words: int, block_words: int, item_col: str, item_text_col: str) -> Iterator[Plan]:
    """A plan for each block of items."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("t is not null")
    size = items.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    blocks = -(-size // block_words)
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block)
        plan = make_plan(sorted((tuple(r) for r in mine.collect()), key=str), edit_share, samples, recall, least_words)
        if plan.items:
            yield plan


def find_leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = 0.2, samples: int = 4, recall: float = 0.98, least_words: int = 8, block_words: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per text row and item that it holds: the best place (words from 0, end exclusive) and its edits."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    found = spark.createDataFrame([], SCHEMA)
    for plan in plans(benchmark, edit_share, samples, recall, least_words, block_words, item_col, item_text_col):
        found = found.union(texts.mapInArrow(_rows(spark.sparkContext.broadcast(plan)), SCHEMA))
    return found


def drop_leaking(docs: DataFrame, benchmark: DataFrame, edit_share: float = 0.2, samples: int = 4, recall: float = 0.98, least_words: int = 8, block_words: int = 1 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The input rows that hold no item, with all their columns as they are."""
    out, names, (t,) = docs, docs.columns, unused(docs.columns, "t")
    for plan in plans(benchmark, edit_share, samples, recall, least_words, block_words, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(plan)
        out = out.select("*", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(t)).mapInArrow(_clean_rows(shared, names), docs.schema)
    return out
