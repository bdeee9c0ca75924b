"""A streaming source of lines that are appended to growing *.jsonl files.

Spark's file source takes a file once; this one keeps a byte offset and a fingerprint of the head of each file. A file
that shrank or was rewritten is read from its start. Only whole lines are taken, and an offset only moves when
a micro-batch commits, so a restart resumes where the last commit ended.
"""

from __future__ import annotations

import hashlib

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

HEAD_BYTES = 4096
#: Bytes of one file that one micro-batch takes at most; the rest waits for the next.
BATCH_BYTES = 16 << 20
SCHEMA = "file string, block long, seq long, value string"


def head_of(path: str, size: int) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read(min(HEAD_BYTES, size))).hexdigest()


def discover(root: str) -> list[str]:
    """All *.jsonl files below root in order; folders that can't be read are left out."""
    return sorted(os.path.join(d, f) for d, _, files in os.walk(root) for f in files if f.endswith(".jsonl"))


def whole_lines_end(path: str, start: int, limit: int) -> int:
    """The end of the last whole line from start within limit bytes; beyond it if the first line is longer."""
    with open(path, "rb") as f:
        f.seek(start)
        data = f.read(limit)
        at = data.rfind(b"\n")
        if at >= 0:
            return start + at + 1
        if len(data) < limit:
            return start
        while chunk := f.read(limit):
            at = chunk.find(b"\n")
            if at >= 0:
                return start + len(data) + at + 1
            data += chunk
        return start


class Slice(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class TailReader(DataSourceStreamReader):
    def __init__(self, root: str, batch_bytes: int):
        self.root, self.batch_bytes = root, batch_bytes
        self.last: dict = {}

    def initialOffset(self) -> dict:
        return {}

    def _next(self, before: dict) -> dict:
        after = {p: o for p, o in before.items() if not os.path.exists(p)}  # a missing file may come back
        for path in discover(self.root):
            try:
                size = os.path.getsize(path)
                was = before.get(path)
                at, head, head_size = (was["at"], was["head"], was["size"]) if was else (0, "", 0)
                if was and (size < at or head_of(path, head_size) != head):
                    at = 0
                end = whole_lines_end(path, at, self.batch_bytes)
                known = min(HEAD_BYTES, end)
                after[path] = {"from": at, "at": end, "head": head_of(path, known), "size": known}
            except OSError:
                if path in before:
                    after[path] = before[path]
        return after

    def latestOffset(self) -> dict:
        self.last = self._next(self.last)
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self.last = end
        out = []
        for path, o in end.items():
            was = start.get(path)
            begin = o["from"] if was is None or o["from"] == 0 or o["from"] == was["at"] else was["at"]
            if was is not None and o == was:
                continue
            if o["at"] > begin:
                out.append(Slice(path, begin, o["at"]))
        return out

    def read(self, partition: Slice) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            left, at = partition.end - partition.start, partition.start
            for line in f:
                if left <= 0:
                    break
                left -= len(line)
                yield partition.path, 0, at, line.decode("utf-8", "replace").rstrip("\r\n")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """spark.readStream.format("jsonl_tail").option("path", folder): (file, block, seq, value); seq is the line's byte offset."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("batch_bytes", BATCH_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)



