"""WARC archives as a Spark data source.

Writing: every task writes one ``.warc.gz`` file, one gzip member a record, and the job's commit puts
the names of the files that count into a manifest of its own, ``_manifest-<uuid>.json`` (files of lost or
repeated tasks are ignored).  So appending adds to what is there; overwriting removes the manifests that
it found, once its own is written.  Each member carries its compressed length in the "sl" extra field of
the WARC annex.

Reading: the manifests' files (or the folder's ``*.warc`` and ``*.warc.gz``) are planned into partitions of
``splitBytes`` each.  A record's headers are decoded first; filters on the record type and on headers
(columns, or ``headers['name']`` by the option ``header.name`` = value) are tested there, and the rest of a
record that is not wanted is skipped, not decoded.  With the option ``payload`` = ``false`` no payload is decoded.

Paths: whatever ``pyarrow.fs.FileSystem.from_uri`` opens; a folder that all executors share.

Null payloads are empty; a null id gives a record without a number, read back as null; an empty table
gives no records.  Other columns than the named ones are not written.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from brook.llm._shared import kept

READ_SCHEMA = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
FIELDS = [x.split()[0] for x in READ_SCHEMA.split(", ")]
ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
PREFIX = "<urn:brook:page:"
DATE = "2000-01-01T00:00:00Z"  # records carry no crawl time of their own
HEAD = 4096
BATCH_BYTES = 8 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else pafs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


# ---------------------------------------------------------------- records


def _number(said: str | None) -> int | None:
    digits = (said or "").removeprefix(PREFIX).removesuffix(">")
    return int(digits) if digits else None


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url, payload: bytes, size: int, sha1_hex: str, kind: str, refers_to) -> bytes:
    """A response with its payload, or a revisit with the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {PREFIX}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1_hex)).decode()}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {PREFIX}{'' if refers_to is None else refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member whose extra field "sl" says its own length and that of its content."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(data) + packer.flush()
    n = lambda x: (x & 0xFFFFFFFF).to_bytes(4, "little")
    total = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + (12).to_bytes(2, "little") + b"sl" + (8).to_bytes(2, "little") + n(total) + n(len(data)) + body + n(zlib.crc32(data)) + n(len(data))


def headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


# ---------------------------------------------------------------- reading


class _Plain:
    """Records of an uncompressed file: the head is read, the rest of the record can be passed over."""

    def __init__(self, file, start: int, end: int):
        self.file, self.at, self.end = file, start, end

    def next_head(self) -> bytes | None:
        while self.at < self.end:
            self.file.seek(self.at)
            head = self.file.read(HEAD)
            blank = len(head) - len(head.lstrip(b"\r\n"))
            self.at += blank
            if blank < len(head):
                self.file.seek(self.at)
                head = b""
                while b"\r\n\r\n" not in head:
                    more = self.file.read(HEAD)
                    if not more:
                        raise ValueError("a record ends inside its headers")
                    head += more
                self.head = head
                return head
        return None

    def body(self, n: int) -> bytes:
        """At least n bytes of the record, from its start."""
        if n > len(self.head):
            self.file.seek(self.at + len(self.head))
            self.head += self.file.read(n - len(self.head))
        return self.head

    def pass_over(self, size: int) -> None:
        self.at += size


class _Zipped:
    """Records of a file with one gzip member each."""

    def __init__(self, file, start: int, end: int):
        self.file, self.at, self.end = file, start, end

    def next_head(self) -> bytes | None:
        if self.at >= self.end:
            return None
        self.file.seek(self.at)
        self.start, first = self.at, self.file.read(HEAD)
        self.length = int.from_bytes(first[16:20], "little") if first[3:4] == b"\x04" and first[12:14] == b"sl" else None
        self.unzip, self.read, self.head = zlib.decompressobj(zlib.MAX_WBITS | 16), len(first), b""
        self.rest = first
        while b"\r\n\r\n" not in self.head and self._more(HEAD):
            pass
        return self.head

    def _more(self, n: int) -> bool:
        if self.unzip.eof:
            return False
        if not self.rest:
            self.rest = self.file.read(1 << 16)
            self.read += len(self.rest)
            if not self.rest:
                raise ValueError("a gzip member is cut off")
        self.head += self.unzip.decompress(self.rest, n)
        self.rest = self.unzip.unconsumed_tail
        return True

    def body(self, n: int) -> bytes:
        if n > len(self.head):
            parts, have = [self.head], len(self.head)
            while have < n:
                self.head = b""
                if not self._more(n - have):
                    break
                parts.append(self.head)
                have += len(self.head)
            self.head = b"".join(parts)
        return self.head

    def pass_over(self, size: int) -> None:
        if self.length is None:
            while self._more(1 << 20):
                self.head = b""
            self.length = self.read - len(self.unzip.unused_data)
        self.at = self.start + self.length


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.split_bytes = int(options.get("splitbytes", 64 << 20))
        self.wanted: dict[str, set] = {}
        self.wanted_headers = {k.removeprefix("header."): v for k, v in options.items() if k.startswith("header.")}

    def partitions(self) -> list[Split]:
        fs, root = filesystem(self.path)
        said = manifests(fs, root)
        if said:
            listed = []
            for path in said:
                with fs.open_input_file(path) as f:
                    listed += json.loads(f.read())
        else:
            found = [root] if fs.get_file_info(root).is_file else [x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.path.endswith((".warc", ".warc.gz"))]
            listed = [{"name": p.rpartition("/")[2], "marks": [0, fs.get_file_info(p).size]} for p in sorted(found)]
            root = root.rpartition("/")[0] if found == [root] else root
        out = []
        for f in listed:
            start = f["marks"][0]
            for i, mark in enumerate(f["marks"][1:], 2):
                if mark - start >= self.split_bytes or i == len(f["marks"]):
                    out.append(Split(f["name"], start, mark))
                    start = mark
        self.root = root
        return [Split(f"{root}/{s.path}", s.start, s.end) for s in out if s.end > s.start]

    def read(self, split: Split | None) -> Iterator[pa.RecordBatch]:
        if split is None:  # nothing was planned
            return
        fs, _ = filesystem(self.path)
        rows, size = [], 0
        with fs.open_input_file(split.path) as file:
            records = (_Zipped if split.path.endswith(".gz") else _Plain)(file, split.start, split.end)
            while (head := records.next_head()) is not None:
                cut = head.index(b"\r\n\r\n") + 4
                h = headers(head[:cut])
                length = int(h["content-length"])
                row = {"page_id": _number(h.get("warc-record-id")) if h.get("warc-record-id", "").startswith(PREFIX) else None, "url": h.get("warc-target-uri"), "record_type": h.get("warc-type"), "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": _number(h.get("warc-refers-to"))}
                if all(row[k] in v for k, v in self.wanted.items() if k in row) and all(h.get(k) == v for k, v in self.wanted_headers.items()):
                    http, at = {}, cut
                    if h.get("content-type", "").startswith("application/http"):
                        block = records.body(min(cut + length, cut + HEAD))
                        at = block.index(b"\r\n\r\n", cut) + 4
                        http = headers(block[cut:at])
                    row["payload_bytes"] = int(http.get("content-length", cut + length - at))
                    row["payload"] = records.body(cut + length)[at : cut + length] if self.payload and h.get("warc-type") != "revisit" else None
                    if row["payload_bytes"] in self.wanted.get("payload_bytes", {row["payload_bytes"]}):
                        rows.append(row)
                        size += 200 + len(row["payload"] or b"")
                records.pass_over(cut + length)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


# ---------------------------------------------------------------- writing


class PushingReader(WarcReader):
    """Spark hands its filters over only where the session has ``spark.sql.python.filterPushdown.enabled``, and refuses them elsewhere."""

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name in FIELDS and name != "payload":
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f


def manifests(fs: pafs.FileSystem, root: str) -> list[str]:
    info = fs.get_file_info(root)
    if info.type != pafs.FileType.Directory:
        return []
    return sorted(x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.base_name.startswith("_manifest-") and x.base_name.endswith(".json"))


@dataclass
class Written(WriterCommitMessage):
    name: str
    marks: list


class WarcWriter(DataSourceArrowWriter):
    """Expects the columns page_id, url, payload, payload_bytes, sha1, record_type and refers_to."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.level, self.overwrite = options["path"], int(options.get("level", 1)), overwrite
        self.mark_bytes = int(options.get("markbytes", 8 << 20))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        name, at, marks = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
        file = None
        for b in batches:
            columns = [b.column(c) for c in ("page_id", "url", "payload", "payload_bytes", "sha1", "record_type", "refers_to")]
            for i in range(b.num_rows):
                file = file or fs.open_output_stream(f"{root}/{name}", compression=None)
                at += file.write(data) if (data := member(record(*(c[i].as_py() for c in columns)), self.level)) else 0
                if at - marks[-1] >= self.mark_bytes:
                    marks.append(at)
        if file:
            file.close()
        return Written(name, marks if marks[-1] == at else [*marks, at])

    def commit(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        before = manifests(fs, root)
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([{"name": m.name, "marks": m.marks} for m in messages if m and m.marks[-1]]).encode())
        for path in before if self.overwrite else []:
            with fs.open_input_file(path) as f:
                gone = json.loads(f.read())
            fs.delete_file(path)  # first: files without a manifest do no harm
            for x in gone:
                fs.delete_file(f"{root}/{x['name']}")

    def abort(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            if m and m.marks[-1]:
                fs.delete_file(f"{root}/{m.name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return (PushingReader if self.options.get("pushdown", "false") == "true" else WarcReader)(self.options)

    def writer(self, schema, overwrite) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


# ---------------------------------------------------------------- operators


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """One record per row.  Of equal payloads of at least ``least_bytes`` the largest id is the response, the others revisit it
    (rows that repeat the largest id are all responses; where all ids are null too); smaller payloads are all responses.

    Equal payloads are found by their digests and sizes; groups of one, which most payloads are, don't take part in the join."""
    payload = F.encode(F.coalesce(F.col(body_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"))
    first = rows.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("sha1").alias("same"), F.col("payload_bytes").alias("size")).agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    first = kept(first.where("n > 1 and keeper is not null").drop("n"), "keepers")
    joined = rows.join(first, (F.col("sha1") == F.col("same")) & (F.col("payload_bytes") == F.col("size")), "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keeper")).alias("refers_to"))


def write_archives(records: DataFrame, path: str, mode: str = "append") -> None:
    records.sparkSession.dataSource.register(WarcDataSource)
    records.write.format("warc").mode(mode).option("path", path).save()


def read_archives(spark: SparkSession, path: str, payload: bool = True, wanted_headers: dict[str, str] | None = None) -> DataFrame:
    """Records of the archives whose headers have the wanted values.  The filters of a query are pushed down too where the
    session has ``spark.sql.python.filterPushdown.enabled``; no setting is changed here."""
    spark.dataSource.register(WarcDataSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).option("pushdown", pushdown)
    for name, value in (wanted_headers or {}).items():
        reader = reader.option(f"header.{name.lower()}", value)
    return reader.load()


def verified(records: DataFrame) -> DataFrame:
    """Sizes and digests made anew from the payloads that were read; those of other records are their headers'."""
    read = F.col("payload").isNotNull()
    five = lambda i: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(F.substring("bits", 5 * i + 1, 5), 2, 10).cast("int") + 1, F.lit(1))
    nibbles = F.transform(F.split(F.sha1("payload"), "(?<=.)(?=.)"), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0"))
    rows = records.select("*", F.when(read, F.array_join(nibbles, "")).alias("bits"))
    digest = F.concat(*(five(i) for i in range(32)))
    return rows.select("page_id", F.when(read, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(read, digest).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
