"""The pull protocol as a streaming source: send ``data``, read a count, read as many lines.

Tasks fetch: a micro-batch has one partition for each connection, and the driver sees numbers of batches
only.  A server keeps no place to go back to, so a task spools what it fetched to a shared folder, line by line,
before it gives any of it on; a repeated batch is read from there.  A file's name holds its batch, the number
of its first line, and how many lines it has.

Every micro-batch asks once, so a source that has nothing makes empty ones.  What a task fetched but hadn't
spooled when its executor was lost can't be asked for again, and two attempts of one task must not run at
once (leave speculation off): the protocol has no offsets.
"""

from __future__ import annotations

import io
import ipaddress
import socket
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else pafs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


def spooled(fs: pafs.FileSystem, folder: str) -> dict[int, tuple[int, int, str]]:
    """First line, number of lines, and path of each batch of a connection."""
    found = {}
    for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        parts = info.base_name.removesuffix(".lines").split("-")
        if info.base_name.endswith(".lines") and len(parts) == 3:
            found[int(parts[0])] = (int(parts[1]), int(parts[2]), info.path)
    return found


class Fetch(InputPartition):
    def __init__(self, connection: int, batch: int):
        super().__init__((connection, batch))


class PullReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.host, self.port = options["host"], int(options["port"])
        ipaddress.IPv4Address(self.host)
        if not 0 < self.port < 65536:
            raise ValueError(f"no port: {self.port}")
        self.connections = int(options.get("connections", 1))
        if self.connections < 1:
            raise ValueError(f"no number of connections: {self.connections}")
        self.spool, self.timeout = options["spool"], float(options.get("timeout", 30))

    def _folder(self, connection: int) -> tuple[pafs.FileSystem, str]:
        fs, root = files(self.spool)
        return fs, f"{root}/{connection}"

    # ------------------------------------------------------------ on the driver: numbers of batches

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        """One batch behind what is spooled; the same until a task has fetched it."""
        known = [b for c in range(self.connections) for b in spooled(*self._folder(c))]
        return {"next": max(known, default=-1) + 2}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # batches of one connection are numbered one after another, so only its last one may still have to be fetched
        return [Fetch(c, b) for c in range(self.connections) for b in range(start["next"], end["next"])]

    def commit(self, end: dict) -> None:
        """The last batch's file stays: its name says how lines go on."""
        for c in range(self.connections):
            fs, folder = self._folder(c)
            for batch, (_, _, path) in spooled(fs, folder).items():
                if batch < end["next"] - 1:
                    fs.delete_file(path)

    # ------------------------------------------------------------ in tasks: lines

    def _fetch(self, fs: pafs.FileSystem, folder: str, batch: int, first: int) -> tuple[int, int, str]:
        """Ask once and spool the answer; at no time is more than a line of it held."""
        with socket.create_connection((self.host, self.port), timeout=self.timeout) as link, link.makefile("rwb") as stream:
            stream.write(b"data\n")
            stream.flush()
            count = stream.readline()
            if not count.strip():
                raise ConnectionError("the source has closed the connection")
            path = f"{folder}/{batch}-{first}-{int(count)}.lines"
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(path + ".tmp") as out:
                for _ in range(int(count)):
                    line = stream.readline()
                    if not line.endswith(b"\n"):
                        raise ConnectionError("the source has closed the connection inside a batch")
                    out.write(line)
        fs.move(path + ".tmp", path)
        return first, int(count), path

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        connection, batch = partition.value
        fs, folder = self._folder(connection)
        known = spooled(fs, folder)
        if batch not in known:
            if any(b > batch for b in known):
                raise ValueError(f"batch {batch} of {folder} is not in the spool any more")
            before = known[max(known)] if known else (0, 0, "")
            known[batch] = self._fetch(fs, folder, batch, before[0] + before[1])
        first, count, path = known[batch]
        with io.BufferedReader(fs.open_input_file(path)) as lines:
            for i in range(count):
                yield (first + i) * self.connections + connection, lines.readline().rstrip(b"\r\n").decode(errors="replace")


class PullSource(DataSource):
    """Options: host (IPv4), port, spool (a folder that driver and executors share), connections, timeout in seconds."""

    @classmethod
    def name(cls) -> str:
        return "pull"

    def schema(self) -> str:
        return "_id long, value string"

    def streamReader(self, schema) -> PullReader:
        return PullReader(self.options)
