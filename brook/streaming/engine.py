"""Streams, their indexes and their administration, on Structured Streaming and Parquet folders.

Each micro-batch is written to a folder of its own number, by date, so that a repeated batch replaces
itself; ``compact`` gathers batches in one folder, which the catalog names.  Queries are batch reads.  An index is a second copy of the records by key or cell; it is built
from all records so far, later batches are read beside it until ``refresh_index``, and so it never
changes an answer.
"""

from __future__ import annotations

import json
import logging
import re
import threading
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.streaming import StreamingQuery

from brook.functions import geo, periods, values
from brook.functions.periods import DEFAULT_SPAN, Period
from brook.operators import select as S
from brook.sources.formats import Csv, Json, spark_type
from brook.sources.pull import PullSource, files

# Words that can't name an attribute.
RESERVED = "activate and count create csv deactivate desc drop format from grid hash index on options or pause restart resume select show spatial stream time topk unshow where within".split()
BUCKETS = 64
ID = "decimal(38,0)"  # a batch's number and the place in it, side by side
log = logging.getLogger("brook.streaming")
NAME = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Pull:
    """A server of the pull protocol; ``connections`` tasks ask it at once, each on a connection of its own."""

    host: str
    port: int
    connections: int = 1


@dataclass(frozen=True)
class Lines:
    """Text files of a folder, one record a line; all that is there is read, then the stream waits for more."""

    path: str


@dataclass
class EngineConfig:
    answer_size: int = S.DEFAULT_K
    span: timedelta = DEFAULT_SPAN
    trigger: str = "1 second"
    timeout: float = 30.0  # seconds that a statement may take

    @classmethod
    def of(cls, spark: SparkSession) -> EngineConfig:
        """From the session's ``spark.brook.answerSize``, ``.spanMinutes``, ``.trigger`` and ``.timeoutSeconds``."""
        said, d = lambda name, default: spark.conf.get(f"spark.brook.{name}", str(default)), cls()
        return cls(int(said("answerSize", d.answer_size)), timedelta(minutes=float(said("spanMinutes", d.span / timedelta(minutes=1)))), said("trigger", d.trigger), float(said("timeoutSeconds", d.timeout)))


class Engine:
    """Streams under one root folder; a new session finds those of the last."""

    def __init__(self, spark: SparkSession, root: str, config: EngineConfig | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or EngineConfig.of(spark)
        self.queries: dict[str, StreamingQuery] = {}
        self.shown: set[str] = set()
        self.entries: dict[str, dict] = self._load()

    # ------------------------------------------------------------ catalog

    def _load(self) -> dict:
        fs, root = files(self.root)
        info = fs.get_file_info(f"{root}/catalog.json")
        if info.type == pafs.FileType.NotFound:
            return {}
        with fs.open_input_file(info.path) as f:
            return json.loads(f.read())

    def _save(self) -> None:
        fs, root = files(self.root)
        fs.create_dir(root, recursive=True)
        temporary = f"{root}/catalog-{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary) as f:
            f.write(json.dumps(self.entries, indent=1).encode())
        fs.move(temporary, f"{root}/catalog.json")

    def _entry(self, stream: str) -> dict:
        if stream.lower() not in self.entries:
            raise ValueError(f"no stream {stream!r}")
        return self.entries[stream.lower()]

    def _index(self, stream: str, index: str) -> dict:
        found = [x for x in self._entry(stream)["indexes"] if x["name"] == index.lower()]
        if not found:
            raise ValueError(f"no index {index!r} on {stream!r}")
        return found[0]

    @staticmethod
    def _new_name(name: str, taken) -> str:
        name = name.lower()
        if not NAME.fullmatch(name) or name in RESERVED:
            raise ValueError(f"not a name: {name!r}")
        if name in taken:
            raise ValueError(f"{name!r} is there already")
        return name

    # ------------------------------------------------------------ streams

    def create_stream(self, name: str, attributes: dict[str, str], source: Pull | Lines, fields: tuple[int, ...] | None = None, form: str = "csv", timestamp_by: str | None = None, start: bool = True) -> None:
        """Declare a stream and start to take it in.  Record time is ``timestamp_by``, an attribute called ``timestamp``, or the time of arrival."""
        name = self._new_name(name, self.entries)
        if form == "json":
            attributes = Json.attributes
        elif form != "csv":
            raise ValueError(f"no format {form!r}; there are csv and json")
        attributes = {a.lower(): k.lower() for a, k in attributes.items()}
        if bad := [a for a in attributes if not re.fullmatch(r"\w+", a) or a in RESERVED or a in S.SYSTEM]:
            raise ValueError(f"not names of attributes: {bad}")
        if form == "csv":
            Csv(attributes, fields)
        timed = timestamp_by.lower() if timestamp_by else "timestamp" if attributes.get("timestamp") == "timestamp" else None
        if timed and attributes.get(timed) != "timestamp":
            raise ValueError(f"{timed!r} is not an attribute of the type timestamp")
        kind = {"pull": [source.host, source.port, source.connections]} if isinstance(source, Pull) else {"lines": source.path}
        self.entries[name] = {"attributes": attributes, "fields": list(fields) if fields else None, "form": form, "source": kind, "timed": timed, "indexes": []}
        self._save()
        log.info("stream %s is there, from %s", name, kind)
        if start:
            self.resume(name)

    def _folder(self, stream: str, part: str) -> str:
        return f"{self.root}/streams/{stream.lower()}/{part}"

    def schema(self, stream: str) -> ST.StructType:
        kinds = ", ".join(f"`{a}` {spark_type(k)}" for a, k in self._entry(stream)["attributes"].items())
        return ST.StructType.fromDDL(f"_id {ID}, _ts timestamp, {kinds}, _batch bigint, _date date")

    def decoder(self, stream: str) -> Csv | Json:
        e = self._entry(stream)
        return Json() if e["form"] == "json" else Csv(e["attributes"], tuple(e["fields"]) if e["fields"] else None)

    def _lines(self, stream: str) -> DataFrame:
        source = self._entry(stream)["source"]
        if "pull" in source:
            self.spark.dataSource.register(PullSource)
            host, port, connections = source["pull"]
            return self.spark.readStream.format("pull").options(host=host, port=port, connections=connections, spool=self._folder(stream, "spool")).load()
        return self.spark.readStream.text(source["lines"]).select(F.lit(None).cast("long").alias("_id"), "value")

    def _write(self, stream: str, batch: DataFrame, number: int) -> None:
        """Lines without an id of their own get one from the batch and their place in it.  A pull that gave nothing leaves no folder."""
        e = self._entry(stream)
        if "pull" in e["source"] and batch.isEmpty():
            return
        rows = self.decoder(stream).decode(batch.withColumn("_id", F.coalesce(F.col("_id").cast(ID), own_ids(number))))
        ts = F.coalesce(F.col(e["timed"]), F.current_timestamp()) if e["timed"] else F.current_timestamp()
        rows = rows.select("_id", ts.alias("_ts"), *e["attributes"]).withColumn("_date", F.to_date("_ts"))
        rows.write.mode("overwrite").partitionBy("_date").parquet(f"{self._folder(stream, 'records')}/_batch={number}")
        if stream in self.shown:
            log.info("%s: batch %s, %s records", stream, number, batch.count())
        else:
            log.debug("%s: batch %s", stream, number)

    def records(self, stream: str) -> DataFrame:
        """All records so far, in no order: what is compacted and the batches behind it."""
        batches, made = self._read(self._folder(stream, "records"), self.schema(stream)), self._entry(stream).get("compacted")
        if made is None:
            return batches
        return self._read(self._folder(stream, made["folder"]), self.schema(stream)).unionByName(batches.where(F.col("_batch") > made["upto"]))

    def _read(self, path: str, schema: ST.StructType) -> DataFrame:
        fs, root = files(path)
        if fs.get_file_info(root).type == pafs.FileType.NotFound:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def resume(self, stream: str, available_now: bool = False) -> StreamingQuery:
        """Take the stream in from where it stopped; a new session does the same (restart)."""
        stream = stream.lower()
        self._entry(stream)
        if (q := self.queries.get(stream)) and q.isActive:
            return q
        writer = self._lines(stream).writeStream.queryName(f"{stream}-{uuid.uuid4().hex[:6]}").foreachBatch(lambda b, n: self._write(stream, b, n)).option("checkpointLocation", self._folder(stream, "checkpoint"))
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=self.config.trigger)
        self.queries[stream] = writer.start()
        log.info("stream %s is taken in", stream)
        return self.queries[stream]

    restart = resume

    def pause(self, stream: str) -> None:
        self._entry(stream)
        if q := self.queries.get(stream.lower()):
            q.stop()

    def status(self, stream: str) -> str:
        self._entry(stream)
        q = self.queries.get(stream.lower())
        if q and not q.isActive and q.exception():
            log.error("stream %s has failed: %s", stream, q.exception())
        return "paused" if q is None else "running" if q.isActive else "failed" if q.exception() else "paused"

    def progress(self, stream: str) -> dict:
        """Rows of the last batch, of all batches, and of each index."""
        e, q = self._entry(stream), self.queries.get(stream.lower())
        last = q.lastProgress if q else None
        schema = self._index_schema(stream)
        sizes = {x["name"]: self._read(self._index_folder(stream, x), schema).count() for x in e["indexes"]}
        return {"last_batch": last["numInputRows"] if last else 0, "total": self.records(stream).count(), "indexes": sizes}

    def show(self, stream: str, on: bool = True) -> None:
        """Log at level INFO what each batch takes in, or stop to."""
        self._entry(stream)
        (self.shown.add if on else self.shown.discard)(stream.lower())

    def drop_stream(self, stream: str) -> None:
        self.pause(stream)
        fs, root = files(f"{self.root}/streams/{stream.lower()}")
        if fs.get_file_info(root).type != pafs.FileType.NotFound:
            fs.delete_dir(root)
        del self.entries[stream.lower()]
        self.queries.pop(stream.lower(), None)
        self._save()
        log.info("stream %s is gone", stream)

    def desc(self, stream: str | None = None) -> DataFrame:
        """One row for each stream and index."""
        rows = []
        for name, e in self.entries.items():
            if stream is None or name == stream.lower():
                rows.append((name, None, "stream", ", ".join(f"{a}:{k}" for a, k in e["attributes"].items()), self.status(name)))
                rows += [(name, x["name"], x["kind"], x["attribute"], "active" if x["active"] else "inactive") for x in e["indexes"]]
        if stream is not None:
            self._entry(stream)
        return self.spark.createDataFrame(rows, "stream string, index string, kind string, says string, status string")

    # ------------------------------------------------------------ indexes

    def create_index(self, kind: str, index: str, stream: str, attribute: str, grid: geo.Grid | None = None, buckets: int = BUCKETS) -> None:
        """``hash`` by the keys of an attribute (in so many buckets), or ``grid`` by the cells of a location; all records so far are in it."""
        e, attribute = self._entry(stream), attribute.lower()
        index = self._new_name(index, [x["name"] for x in e["indexes"]])
        if attribute not in e["attributes"]:
            raise ValueError(f"no attribute {attribute!r}")
        if kind not in ("hash", "grid"):
            raise ValueError(f"no kind of index {kind!r}; there are hash and grid")
        if kind == "grid" and e["attributes"][attribute] != "geolocation":
            raise ValueError(f"{attribute!r} is not a location")
        g = grid or geo.Grid()
        g.box.check()
        e["indexes"].append({"name": index, "kind": kind, "attribute": attribute, "grid": [list(g.box), g.rows, g.cols], "buckets": buckets, "active": True, "upto": -1})
        self._save()
        log.info("%s index %s on %s of %s", kind, index, attribute, stream)
        self.refresh_index(stream, index)

    def refresh_index(self, stream: str, index: str) -> None:
        """Copy the batches that the index doesn't have yet."""
        x = self._index(stream, index)
        last = self.records(stream).agg(F.max("_batch")).first()[0]
        if last is None or last <= x["upto"]:
            return
        new = self.records(stream).where((F.col("_batch") > x["upto"]) & (F.col("_batch") <= last))
        a = F.col(x["attribute"])
        if x["kind"] == "hash":
            where = F.explode(F.array_distinct(F.transform(values.keys(a, self._entry(stream)["attributes"][x["attribute"]].startswith("list<")), lambda key: _bucket(key, x["buckets"])))).alias("_place")
        else:
            where = F.explode(F.array_distinct(F.transform(F.coalesce(self._grid(x).cells(a), F.array(F.lit(-1))), lambda c: _row(c, self._grid(x))))).alias("_place")
        # a place that many records have is written by many tasks, small places share one
        new.select("*", where).hint("rebalance", "_place").write.mode("append").partitionBy("_place").parquet(self._index_folder(stream, x))
        x["upto"] = last
        self._save()

    def _grid(self, x: dict) -> geo.Grid:
        box, rows, cols = x["grid"]
        return geo.Grid(geo.Box(*box), rows, cols)

    def _index_schema(self, stream: str) -> ST.StructType:
        return ST.StructType([*self.schema(stream), ST.StructField("_place", ST.IntegerType())])

    def _index_folder(self, stream: str, x: dict) -> str:
        return self._folder(stream, f"index/{x['name']}")

    def drop_index(self, stream: str, index: str) -> None:
        x = self._index(stream, index)
        fs, root = files(self._index_folder(stream, x))
        if fs.get_file_info(root).type != pafs.FileType.NotFound:
            fs.delete_dir(root)
        self._entry(stream)["indexes"].remove(x)
        self._save()

    def activate(self, stream: str, index: str, on: bool = True) -> None:
        self._index(stream, index)["active"] = on
        self._save()

    def _via_index(self, stream: str, where: S.Condition | None) -> DataFrame | None:
        """Records from the places of an active index that can match, and from batches that it doesn't have.  Hash before grid."""
        needed = list(where.required()) if where else []
        usable = [x for x in self._entry(stream)["indexes"] if x["active"] and x["upto"] >= 0]
        schema = self._index_schema(stream)
        for x in sorted(usable, key=lambda x: x["kind"] != "hash"):
            for p in needed:
                if p.attribute.lower() != x["attribute"]:
                    continue
                if x["kind"] == "hash" and isinstance(p, S.Equals) and not isinstance(p.value, tuple):
                    kind = spark_type(self._entry(stream)["attributes"][x["attribute"]]).removeprefix("array<").removesuffix(">")
                    value = periods.moment(p.value, kind) if isinstance(p.value, datetime) else F.lit(p.value.lower() if isinstance(p.value, str) else p.value)
                    place = F.col("_place") == _bucket(value.cast(kind).cast("string"), x["buckets"])
                elif x["kind"] == "grid" and isinstance(p, S.Within):
                    grid = self._grid(x)
                    rows = sorted({-1 if low < 0 else low // grid.cols for low, _ in grid.ranges(p.box.check())})
                    place = F.col("_place").isin(rows)
                else:
                    continue
                found = self._read(self._index_folder(stream, x), schema).where(place).drop("_place").dropDuplicates(["_id"])
                return found.unionByName(self.records(stream).where(F.col("_batch") > x["upto"]))
        return None

    # ------------------------------------------------------------ queries

    def select(self, stream: str, attributes: list[str] | None = None, where: S.Condition | None = None, time: Period | None = None, k: int | None = None, now: datetime | None = None) -> DataFrame:
        """The newest matching records of a stream, newest first."""
        time = time if time is not None else Period.until(now or datetime.now(timezone.utc), self.config.span)
        rows = self._via_index(stream, where)
        rows = rows if rows is not None else self.records(stream)
        names = attributes if attributes is not None else list(self._entry(stream)["attributes"])
        return S.select(rows, names, where, time, self.config.answer_size if k is None else k)

    def answer(self, rows: DataFrame, seconds: float | None = None) -> list:
        """Rows of a statement's DataFrame, within the configured time; its jobs are cancelled when that is over."""
        limit, sc, tag, late, done = self.config.timeout if seconds is None else seconds, self.spark.sparkContext, f"statement-{uuid.uuid4().hex}", threading.Event(), threading.Event()

        def stop() -> None:
            late.set()
            sc.cancelJobsWithTag(tag)
            while not done.wait(0.2):  # a job may not have begun when the time is over
                sc.cancelJobsWithTag(tag)

        timer = threading.Timer(limit, stop)
        sc.addJobTag(tag)
        timer.start()
        try:
            return rows.collect()
        except Exception as e:
            if late.is_set():
                log.warning("a statement took more than %s s", limit)
                raise TimeoutError(f"a statement took more than {limit} s") from e
            log.exception("a statement failed")
            raise
        finally:
            done.set()
            timer.cancel()
            sc.removeJobTag(tag)

    def by_id(self, stream: str, _id: int | Decimal) -> DataFrame:
        return S.project(self.records(stream).where(F.col("_id") == F.lit(Decimal(_id)).cast(ID)))

    def compact(self, stream: str) -> None:
        """Many small batch folders into one; readers of the old ones should be done.

        The new folder counts from the moment that the catalog names it, the old ones go last: stopped anywhere, no record
        is lost or there twice."""
        e, rows = self._entry(stream), self.records(stream)
        last = rows.agg(F.max("_batch")).first()[0]
        if last is None:
            return
        folder = f"compacted-{uuid.uuid4().hex}"
        # dates with many records are written by many tasks
        rows.where(F.col("_batch") <= last).hint("rebalance", "_date").write.partitionBy("_date").parquet(self._folder(stream, folder))
        e["compacted"] = {"folder": folder, "upto": last}
        self._save()
        log.info("stream %s is compacted up to batch %s", stream, last)
        self._drop_compacted(stream)

    def _drop_compacted(self, stream: str) -> None:
        """Batches and older folders whose records are in the folder that the catalog names."""
        made = self._entry(stream)["compacted"]
        fs, root = files(self._folder(stream, "records"))
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            name = info.base_name
            if name.startswith("_batch=") and int(name.removeprefix("_batch=")) <= made["upto"]:
                fs.delete_dir(info.path)
        for info in fs.get_file_info(pafs.FileSelector(root.rpartition("/")[0], allow_not_found=True)):
            if info.base_name.startswith("compacted-") and info.base_name != made["folder"]:
                fs.delete_dir(info.path)


def own_ids(number: int) -> Column:
    """Of a batch's records: its number times 2**63 and the place in it; no two batches meet, and the numbers don't run out."""
    return (F.lit(Decimal(number)).cast("decimal(19,0)") * F.lit(Decimal(1 << 63)).cast("decimal(19,0)") + F.monotonically_increasing_id().cast("decimal(19,0)")).cast(ID)


def _bucket(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _row(cell, grid: geo.Grid):
    """The grid's row of a cell: few folders, each a run of cells from west to east."""
    return F.when(cell < 0, -1).otherwise(F.floor(cell / grid.cols)).cast("int")
