"""N-gram Jaccard self-join under several global token orders, and the groups that its links form.

A document is the set of its ``shingle``-word shingles (64-bit hashes).  Two documents link when
100 * intersection >= ``similarity`` * union.  Copies (equal sets) are one class, so links are sought
between classes only; all of them count, none is sampled or capped:

1. One pass makes each set's size and two 64-bit signatures; classes are groups of equal signatures.
   Only one row of each class is a candidate.
2. One pass counts in how many documents each shingle stands, in Spark by ranges of its hash.  The
   counts leave as bitmaps of fixed size ("in two documents or more", "in 16 or more", ..), which are
   broadcast: a full bitmap makes the orders below less sharp, never wrong.  Ranges are as many as the
   shingles ask for, about ``REGION`` of them in each.
3. A global order sorts shingles by count level, then by a hash; each order has a hash of its own.
   Linked sets share a shingle among the first ``n - ceil(similarity * n) + 1`` of *each* order
   (prefix filter).  Documents whose prefix holds nothing that others have leave here.
4. Candidates share a prefix shingle under one order, early enough for the intersection they need, and
   must share one under every other order too; counts by ranges of the hash bound the intersection
   once more.  Only then are their sets compared exactly.
   Only classes of different components so far are compared.  First, an order a round, each class meets
   the pivots of every prefix shingle: of those that have the shingle the ones of least hashed id, so that
   a group of near copies shares few pivots.  Then components that share a prefix shingle under every
   order are paired: one pair of members for each two of them, then all members of those that are still apart.

The number of links is not counted: that would need all pairs of a group.

Null text, or no words: an empty set, linked with nothing.  Fewer words than a shingle: the sequence
is the only one.  Null ids: the row takes part, and its group's id is the least id that is not null,
or null.  Rows that repeat an id with other texts
count as one document: their groups are one.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brook.llm import _text as T
from brook.llm._shared import forget, kept, shuffles_removed, unused

ORDERS = 3
#: Ranges of the hash for which a set says how many of its shingles others may have.
RANGES = 64
#: A shingle's level is the number of these counts that it reaches; one bitmap of 2**bits for each.
LEVELS = ((2, 27), (16, 24), (128, 22), (1024, 20), (8192, 18))
#: Shingles whose counts a task adds up before it sends them on, and shingles of one range of the hash.
MERGED = 1 << 20
REGION = 1 << 22
#: Rows that the bitmaps come to the driver in, for each level.
SLICES = 64
#: Of each shingle in a round.
PIVOTS = 3
#: Hashes of ids that a filter of candidates tells apart; no more rows are broadcast for it.
FILTER = 1 << 20
SHORT = np.uint64(0x2545F4914F6CDD1D)


# ---------------------------------------------------------------- sets


def run_sets(run: T.Run, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a run of documents: document indices and hashes, sorted by both."""
    w = T.words(run.data, run.offsets)
    h = T.word_hashes(run.data, w, T.FOLD)
    grams = T.window_hashes(h, shingle)
    whole = w.doc[: len(grams)] == w.doc[len(w.doc) - len(grams) :]
    docs, tokens = [w.doc[: len(grams)][whole]], [grams[whole]]
    sizes = np.diff(w.first)
    for m in range(1, shingle):
        few = np.flatnonzero(sizes == m)
        docs.append(few)
        tokens.append(T.mix(T.window_hashes(h, m)[w.first[few]] ^ (SHORT * np.uint64(m))))
    doc, token = np.concatenate(docs), np.concatenate(tokens)
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    return doc[new], token[new]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def signatures(token: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    return [_sums(T.mix(token ^ s), first).view(np.int64) for s in (np.uint64(1), SHORT)]


#: Stands for null ids inside; beyond every real id, so that it is never the least id of a group that has one.
NO_ID = 1 << 62


def surrogates(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    return NO_ID + (signatures(token, first)[0] & (NO_ID - 1))


def _signature_rows(shingle: int) -> Callable:
    @T.lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id")
            for run in T.runs(b.column("t")):
                doc, token = run_sets(run, shingle)
                first = np.searchsorted(doc, np.arange(run.high - run.low + 1))
                one, two = signatures(token, first)
                n = run.high - run.low
                yield pa.RecordBatch.from_arrays([ids.slice(run.low, n), b.column("h").slice(run.low, n), pa.array(np.diff(first)), pa.array(one), pa.array(two)], ["id", "h", "n", "s1", "s2"])

    return rows


# ---------------------------------------------------------------- counts


def _region_rows(shingle: int, region_bits: int) -> Callable:
    """For about MERGED shingles and each region of the hash range: shingles (their next 32 bits) and in how many documents."""

    def counted(token: np.ndarray) -> pa.RecordBatch:
        key, count = np.unique(token >> np.uint64(32 - region_bits), return_counts=True)
        region = key >> np.uint64(32)
        at = np.flatnonzero(np.diff(region, prepend=np.uint64(1 << 40)))
        ends = [*at[1:], len(key)][: len(at)]
        low, count = key.astype("<u4"), np.minimum(count, 65535).astype("<u2")
        keys, counts = (pa.array([x[i:j].tobytes() for i, j in zip(at, ends, strict=True)], pa.binary()) for x in (low, count))
        return pa.RecordBatch.from_arrays([pa.array(region[at].astype(np.int32)), keys, counts], ["region", "keys", "counts"])

    @T.lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for run in T.runs(b.column("t")):
                held.append(run_sets(run, shingle)[1])
                size += len(held[-1])
                if size >= MERGED:
                    yield counted(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield counted(np.concatenate(held))

    return rows


def level_bits(region: int, region_bits: int, key: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Level, offset and bytes of what a region sets in each bitmap; more than one region may share a byte."""
    hashes = (np.uint64(region) << np.uint64(64 - region_bits)) | (key.astype(np.uint64) << np.uint64(32 - region_bits))
    for level, (least, bits) in enumerate(LEVELS):
        at = hashes[n >= least] >> np.uint64(64 - bits)
        if len(at):
            low = int(at.min() >> np.uint64(3))
            flag = np.zeros(8 * (int(at.max() >> np.uint64(3)) - low + 1), dtype=bool)
            flag[at - np.uint64(8 * low)] = True
            yield level, low, np.packbits(flag, bitorder="little")


def _level_rows(region_bits: int) -> Callable:
    @T.lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(region: int, keys: list, counts: list) -> pa.RecordBatch:
            key = np.frombuffer(b"".join(keys), dtype="<u4")
            order = np.argsort(key, kind="stable")
            key = key[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.add.reduceat(np.frombuffer(b"".join(counts), dtype="<u2")[order].astype(np.int64), at)
            out = list(level_bits(region, region_bits, key[at], n))
            part = [(8 * low * SLICES) >> LEVELS[level][1] for level, low, _ in out]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array(part, pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2].tobytes() for x in out], pa.binary())], ["level", "slice", "low", "bits"])

        now, keys, counts = None, [], []
        for b in batches:  # sorted by region
            for region, k, c in zip(b.column("region").to_pylist(), b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
                if region != now and keys:
                    yield done(now, keys, counts)
                    keys, counts = [], []
                now = region
                keys.append(k)
                counts.append(c)
        if keys:
            yield done(now, keys, counts)

    return rows


def _slice_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What regions set, put together: one row for each slice of a level's bitmap."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for level, part, low, bits in zip(*(b.column(c).to_pylist() for c in ("level", "slice", "low", "bits")), strict=True):
            size = (1 << LEVELS[level][1]) // 8 // SLICES
            into = held.setdefault((level, part), np.zeros(size, dtype=np.uint8))
            into[low - part * size : low - part * size + len(bits)] |= np.frombuffer(bits, dtype=np.uint8)
    for (level, part), bits in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([part], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["level", "slice", "bits"])


def count_levels(texts: DataFrame, shingle: int, total: int) -> list[np.ndarray]:
    """A bitmap for each of LEVELS over the leading bits of a shingle's hash; their size does not depend on the data."""
    region_bits = min(31, max(6, (total // REGION).bit_length()))
    counted = texts.select("t").mapInArrow(_region_rows(shingle, region_bits), "region int, keys binary, counts binary")
    levels = counted.repartition("region").sortWithinPartitions("region").mapInArrow(_level_rows(region_bits), "level int, slice int, low long, bits binary")
    slices = levels.repartition("level", "slice").mapInArrow(T.lean(_slice_rows), "level int, slice int, bits binary")
    maps = [np.zeros((1 << bits) // 8, dtype=np.uint8) for _, bits in LEVELS]
    for r in slices.collect():  # as large as the bitmaps
        part = np.frombuffer(r["bits"], dtype=np.uint8)
        maps[r["level"]][r["slice"] * len(part) : (r["slice"] + 1) * len(part)] = part
    return maps


def levels_of(token: np.ndarray, maps: list[np.ndarray]) -> np.ndarray:
    level, still = np.zeros(len(token), dtype=np.uint8), np.ones(len(token), dtype=bool)
    for (_, bits), bitmap in zip(LEVELS, maps, strict=True):
        at = token >> np.uint64(64 - bits)
        still = still & ((bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        level += still
    return level


# ---------------------------------------------------------------- prefixes


def prefix_length(n: np.ndarray, similarity: int) -> np.ndarray:
    return np.where(n > 0, n - -(-similarity * n // 100) + 1, 0)


def prefixes(doc: np.ndarray, token: np.ndarray, level: np.ndarray, n: np.ndarray, similarity: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and shingles of the prefixes under order k, without shingles that no other document has."""
    rank = level.astype(np.uint64) << np.uint64(61) | T.mix(token ^ (SHORT * np.uint64(k + 2))) >> np.uint64(3)
    order = np.lexsort((rank, doc))
    first = np.cumsum(n) - n
    place = np.arange(len(doc)) - first[doc]
    inside = (place < prefix_length(n, similarity)[doc]) & (level[order] > 0)
    return doc[inside], token[order[inside]]


def _candidate_rows(shingle: int, similarity: int, maps) -> Callable:
    @T.lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column("id")
            ids, absent = given.fill_null(0).to_numpy(), given.is_null().to_numpy(zero_copy_only=False)
            for run in T.runs(b.column("t")):
                doc, token = run_sets(run, shingle)
                n = np.bincount(doc, minlength=run.high - run.low)
                level = levels_of(token, maps.value)
                own_only = np.bincount(doc[level == 0], minlength=len(n))
                spread = np.bincount(doc[level > 0] * RANGES + (token[level > 0] >> np.uint64(58)).astype(np.int64), minlength=len(n) * RANGES).reshape(-1, RANGES)
                # a linked set has at least this share of its shingles in common with another
                n = np.where(100 * (n - own_only) >= similarity * n, n, 0)
                keep = n[doc] > 0
                doc, token, level = doc[keep], token[keep], level[keep]
                found = [prefixes(doc, token, level, n, similarity, k) for k in range(ORDERS)]
                some = np.flatnonzero(np.all([np.bincount(d, minlength=len(n)) > 0 for d, _ in found], axis=0))
                first = np.concatenate([[0], np.cumsum(n)])
                lists = []
                for d, t in found:
                    at = np.searchsorted(d, [some, some + 1])
                    keep = np.isin(d, some)
                    lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(at[1] - at[0])]).astype(np.int32)), pa.array(t[keep].view(np.int64))))
                sets = pa.array([token[first[i] : first[i + 1]].tobytes() for i in some], pa.binary())
                counts = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * RANGES), pa.array(spread[some].astype(np.int32).ravel()))
                own = np.where(absent[run.low + some], surrogates(token, first)[some], ids[run.low + some])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(signatures(token, first)[0][some]), pa.array(n[some]), pa.array(own_only[some]), counts, sets, *lists], ["id", "s1", "n", "u", "c", "s", *(f"p{k}" for k in range(ORDERS))])

    return rows


# ---------------------------------------------------------------- links


def _link_rows(similarity: int) -> Callable:
    @T.lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column("sa"), b.column("sb")
            linked = np.zeros(b.num_rows, dtype=bool)
            for i in range(b.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), dtype=np.uint64), np.frombuffer(right[i].as_buffer(), dtype=np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked[i] = 100 * common >= similarity * (len(x) + len(y) - common)
            at = pa.array(np.flatnonzero(linked))
            yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at)], ["a", "b"])

    return rows


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(id, comp) for every node of (a, b): the least node that it reaches.  Least labels of neighbours, with pointer jumping."""
    both = kept(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = kept(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), name)
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        near = labels.join(near, "id").select("id", F.least("comp", "m").alias("comp"), F.col("comp").alias("was"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        new = kept(near.join(jump, "comp", "left").select("id", F.least("comp", F.coalesce("next", "comp")).alias("comp"), "was"), name)
        if new.where("comp < was").isEmpty():
            return new.select("id", "comp")
        labels = new.select("id", "comp")


class Join:
    """Candidate classes and their components so far: comps has those that are not their own component."""

    def __init__(self, candidates: DataFrame, similarity: int):
        self.candidates, self.similarity = candidates, similarity
        self.comps = candidates.limit(0).select("id", F.col("id").alias("comp"))
        self.prefixes = [kept(self.shared(k), "prefixes") for k in range(ORDERS)]

    def shared(self, k: int) -> DataFrame:
        """id, n, token, rest of the prefix shingles of an order that more than one candidate has."""
        rows = self.candidates.select("id", "n", "u", F.posexplode(f"p{k}").alias("pos", "token")).select("id", "n", "token", (F.col("n") - F.col("u") - F.col("pos")).alias("rest"))
        several = rows.groupBy("token").agg(F.count(F.lit(1)).alias("several")).where("several > 1").select("token")
        return rows.join(several, "token", "left_semi").select("id", "n", "token", "rest")

    def postings(self, k: int, comps: DataFrame | None = None) -> DataFrame:
        return self.with_component(self.prefixes[k], "id", "comp", comps).select("id", "n", "comp", "token", "rest")

    def with_component(self, rows: DataFrame, name: str, comp: str, comps: DataFrame | None = None) -> DataFrame:
        """Rows with the component, so far or as comps has it, of the candidate in a column; few have merged, and the others join with nothing."""
        merged = (self.comps if comps is None else comps).select(F.col("id").alias(name), F.col("comp").alias(comp))
        return rows.join(merged, name, "left").withColumn(comp, F.coalesce(comp, name))

    def members(self, pairs: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
        """Columns of the candidates a and b of pairs, and of a few others by chance: no other candidates are moved when they are joined."""
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER))
        those = F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("x")).select(bucket("x").alias("bucket")).distinct())
        rows = self.candidates.join(those, bucket("id") == F.col("bucket"), "left_semi")
        a, b = (rows.select(F.col("id").alias(x), *(F.col(c).alias(c + x) for c in columns)) for x in "ab")
        return a, b

    def apart(self) -> Column:
        """Whether two sets (or components, whose least size and most ``rest`` these are) of different components can still link.

        ``rest`` is how many shingles of a set stand at this place of the order or behind it: the
        intersection of two sets whose first common shingle this is has no more."""
        most = F.least("rest", "other_rest")
        return (F.col("comp") != F.col("other_comp")) & ((100 + self.similarity) * most >= self.similarity * (F.col("n") + F.col("other_n")))

    @staticmethod
    def pairs(rows: DataFrame) -> DataFrame:
        return rows.select(F.least("id", "other_id").alias("a"), F.greatest("id", "other_id").alias("b")).distinct()

    def with_pivots(self, k: int) -> DataFrame:
        """Each posting of a round's order with its shingle's pivots, where these are apart."""
        rows = self.postings(k % ORDERS)
        side = F.struct(*(F.col(c).alias("other_" + c) for c in ("id", "n", "comp", "rest")))
        least = [F.min(F.struct(F.xxhash64("id", F.lit(k * PIVOTS + i)), side.alias("v"))).alias(f"v{i}") for i in range(PIVOTS)]
        by = rows.groupBy("token").agg(*least, F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        by = by.select("token", F.explode(F.array_distinct(F.array(*(f"v{i}.v" for i in range(PIVOTS))))).alias("v")).select("token", "v.*")
        # written first: a join of two exchanges, in which a frequent shingle can be split
        return rows.join(kept(by, "pivots"), "token").where(self.apart())

    def met(self, k: int) -> DataFrame:
        """Components that share a prefix shingle of an order and can still link there; id, other_id: a member of each."""
        one = F.min(F.struct(F.xxhash64("id", F.lit(k)), "id"))["id"].alias("id")
        here = kept(self.postings(k).groupBy("token", "comp").agg(F.min("n").alias("n"), F.max("rest").alias("rest"), one), "here")
        other = here.select("token", *(F.col(c).alias("other_" + c) for c in ("id", "n", "comp", "rest")))
        return here.join(other, "token").where(self.apart() & (F.col("comp") < F.col("other_comp")))

    def met_everywhere(self) -> DataFrame:
        """What met under order 0, of components that met under every order."""
        first = kept(self.met(0), "met")
        for k in range(1, ORDERS):
            first = first.join(self.met(k).select("comp", "other_comp").distinct(), ["comp", "other_comp"], "left_semi")
        return kept(first, "met")

    @staticmethod
    def one_pair(met: DataFrame) -> DataFrame:
        """One pair of members of each two components that met."""
        return met.groupBy("comp", "other_comp").agg(F.min(F.struct(F.xxhash64("token"), "id", "other_id")).alias("v")).select("v.id", "v.other_id")

    def members_apart(self, met: DataFrame, comps: DataFrame) -> DataFrame:
        """Postings of order 0 with all others of the same shingle whose components met (comps: those of then) and aren't one now.

        Rows grow with the members of components that can link, not with the square of one component."""
        met = self.with_component(self.with_component(met, "id", "x"), "other_id", "y").where("x <> y")
        met = kept(met.select("token", "comp", "other_comp", "other_n", "other_rest"), "met")
        rows = self.postings(0, comps)
        left = rows.join(met, ["token", "comp"]).where(self.apart()).drop("other_n", "other_rest")
        right = rows.select("token", *(F.col(c).alias("other_" + c) for c in ("id", "n", "comp", "rest")))
        return left.join(right, ["token", "other_comp"]).where(self.apart())

    def run(self) -> DataFrame:
        """id and comp of each candidate that is not its own component, when all links are found."""
        self.rounds(self.with_pivots, ORDERS, 128)
        comps, met = self.comps, self.met_everywhere()
        self.link(self.pairs(self.one_pair(met)))
        self.link(self.pairs(self.members_apart(met, comps)))
        for table in (self.candidates, *self.prefixes, met):
            forget(table)
        return self.comps

    def rounds(self, rows: Callable[[int], DataFrame], least: int, most: int) -> None:
        """At least so many rounds, until one merges less than one of ``most`` components."""
        k, left = 0, self.candidates.select("id").distinct().count()
        while left > 1:
            merged = self.link(self.pairs(rows(k)))
            k, left = k + 1, left - merged
            if k >= least and most * merged < left:
                break

    def link(self, pairs: DataFrame) -> int:
        """Keep pairs that share a prefix shingle under every order, compare their sets, and merge components: how many are gone.

        No intersection is larger than the sum over hash ranges of what either set has there that others may have."""
        names = [f"p{k}" for k in range(ORDERS)]
        pairs = kept(pairs, "pairs")
        a, b = self.members(pairs, ["n", "c", *names])
        near = pairs.join(a, "a").join(b, "b")
        most = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
        near = near.where((100 + self.similarity) * most >= self.similarity * (F.col("na") + F.col("nb")))
        for p in names:
            near = near.where(F.arrays_overlap(p + "a", p + "b"))
        near = kept(near.select("a", "b"), "near")
        a, b = self.members(near, ["s"])
        links = kept(near.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(_link_rows(self.similarity), "a long, b long"), "links")
        if links.isEmpty():
            return 0
        edges = self.with_component(self.with_component(links, "a", "ca"), "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a != b").distinct()
        merged = components(edges).where("id != comp").select(F.col("id").alias("comp"), F.col("comp").alias("to"))
        before = self.comps.join(merged, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
        self.comps = kept(before.union(merged.select("comp", "to")), "comps")
        return merged.count()


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, class_id (least id with an equal set), text_hash."""
    out = _grouped(docs, shingle, similarity, id_col, text_col)
    real = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    alone = F.col("class").isNull()
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(real("comp")).alias("component_id"), F.when(alone, F.col("id")).otherwise(real("class")).alias("class_id"), F.col("h").alias("text_hash"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows, all columns as they are, but one document for each group: that of least id, then of least text hash.

    Texts without words are in no group and stay; rows with equal id and text are one document."""
    out = _grouped(docs, shingle, similarity, id_col, text_col)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("v")
    winners = out.where("n > 0").groupBy("comp").agg(first).select("v.id", "v.h")
    winners = winners.union(out.where("n = 0").select("id", "h").distinct())
    i, z, h = unused(docs.columns, "i", "z", "h")
    key = lambda c: (F.coalesce(c, F.lit(0)).alias(i), c.isNull().alias(z))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # repeated rows shrink in each task; their removal and the join share one partitioning, so texts are shuffled once
    rows = docs.select("*", *key(F.col(id_col).cast("long")), F.xxhash64(text).alias(h)).dropDuplicates([i, z, h])
    return rows.join(winners.select(*key(F.col("id")), F.col("h").alias(h)), [i, z, h], "left_semi").select(*docs.columns)


def _grouped(docs: DataFrame, shingle: int, similarity: int, id_col: str, text_col: str) -> DataFrame:
    """id, h, n of each row, and the numbers of its class and component (NO_ID and more: no row has an id)."""
    with shuffles_removed(docs.sparkSession):
        return _grouped_rows(docs, shingle, similarity, id_col, text_col)


def _grouped_rows(docs: DataFrame, shingle: int, similarity: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    signed = kept(texts.select("id", "t", F.xxhash64("t").alias("h")).mapInArrow(_signature_rows(shingle), "id long, h long, n long, s1 long, s2 long"), "signatures")
    surrogate = F.lit(NO_ID) + F.col("s1").bitwiseAND(NO_ID - 1)
    classes = kept(signed.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.coalesce("id", surrogate)).alias("class")), "classes")
    total = signed.agg(F.sum("n")).first()[0] or 0
    maps = spark.sparkContext.broadcast(count_levels(texts, shingle, total))
    T.release()
    lists = ", ".join(f"p{k} array<bigint>" for k in range(ORDERS))
    found = texts.mapInArrow(_candidate_rows(shingle, similarity, maps), f"id long, s1 long, n long, u long, c array<int>, s binary, {lists}")
    # one row of each class; rows that are equal shrink in each task before the shuffle
    found = found.dropDuplicates(["id", "s1"]).join(classes.select(F.col("class").alias("id"), "s1"), ["id", "s1"], "left_semi")
    join = Join(kept(found, "candidates"), similarity)
    merged = join.run().select(F.col("id").alias("class"), "comp")
    known = classes.join(merged, "class", "left").select("s1", "s2", "n", "class", F.coalesce("comp", "class").alias("comp"))
    return signed.join(known, ["s1", "s2", "n"], "left").select("id", "h", "n", "class", "comp")
