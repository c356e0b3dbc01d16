"""Python data sources that read files as streams: header lines, CSV members of ZIP archives, and
digests. A task opens a file, reads what it needs and stops; no file is held whole.

``punctua_headers``, ``punctua_members``, ``punctua_zip`` and ``punctua_digests`` take the files as
the option ``paths``, a JSON list. Files of local and shared folders are opened directly, those of
other stores by the file systems of Arrow; a store that neither knows is an error that names it.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import re
import sys
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_ROWS = 10_000
CHUNK = 1 << 20
MAX_PARTS = 10_000  # partitions of one scan; beyond, a partition has several files


def opened(path: str):
    """A seekable binary file."""
    scheme = re.match(r"([a-z][a-z0-9+.-]*):", path)
    if scheme is None or scheme[1] == "file":
        return open(re.sub(r"^file:/*", "/", path), "rb")
    from pyarrow import fs

    try:
        system, inside = fs.FileSystem.from_uri(quote(path, safe=":/"))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError) as error:
        raise ValueError(f"Files of {scheme[1]}: cannot be opened as a stream.") from error
    return system.open_input_file(inside)


def lines_of(raw) -> Iterator[str]:
    return iter(io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace", newline=None))


def first_line(raw) -> str | None:
    """The first line that is not blank, without its end; no more is read than a buffer holds."""
    for line in lines_of(raw):
        if line.strip():
            return line.rstrip("\n")
    return None


def members_of(archive: zipfile.ZipFile, path: str) -> list[str]:
    """CSV members from the central directory, sorted."""
    names = sorted(n for n in archive.namelist() if n.lower().endswith(".csv"))
    if not names:
        raise ValueError(f"{path} contains no CSV member.")
    return names


@dataclass
class Part(InputPartition):
    files: list


class FileReader(DataSourceReader):
    """Batches of each file; a subclass says how."""

    def __init__(self, files: list, names: list[str]):
        self.files, self.names = files, names

    def partitions(self) -> list[Part]:
        each = max(1, -(-len(self.files) // MAX_PARTS))
        return [Part(self.files[i:i + each]) for i in range(0, len(self.files), each)]

    def rows(self, file) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, partition: Part) -> Iterator[tuple]:
        for file in partition.files:
            yield from self.rows(file)


class Files(DataSource):
    reads: type[FileReader]

    def reader(self, schema) -> FileReader:
        return self.reads(json.loads(self.options["paths"]), schema.names)


class HeaderReader(FileReader):
    def rows(self, file):
        with opened(file) as raw:
            yield file, first_line(raw)


class Headers(Files):
    """(path, header) of every file; the header of an empty file is null."""

    reads = HeaderReader

    @classmethod
    def name(cls) -> str:
        return "punctua_headers"

    def schema(self) -> str:
        return "path string, header string"


class DigestReader(FileReader):
    def rows(self, file):
        size, digest = 0, hashlib.sha256()
        with opened(file) as raw:
            while chunk := raw.read(CHUNK):
                size += len(chunk)
                digest.update(chunk)
        yield os.path.basename(file), size, digest.hexdigest()


class Digests(Files):
    """(file, bytes, sha256) of every file, read in chunks."""

    reads = DigestReader

    @classmethod
    def name(cls) -> str:
        return "punctua_digests"

    def schema(self) -> str:
        return "file string, bytes bigint, sha256 string"


class MemberReader(FileReader):
    def rows(self, file):
        with opened(file) as raw, zipfile.ZipFile(raw) as archive:
            for member in members_of(archive, file):
                with archive.open(member) as inside:
                    line = first_line(inside)
                yield file, member, None if line is None else json.dumps(next(csv.reader([line])))


class Members(Files):
    """(path, member, header) of the CSV members of archives; the header is a JSON list of names."""

    reads = MemberReader

    @classmethod
    def name(cls) -> str:
        return "punctua_members"

    def schema(self) -> str:
        return "path string, member string, header string"


class ZipReader(FileReader):
    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in self.names])
        for path, member, columns in partition.files:
            at = [columns.index(n) if n in columns else None for n in self.names]
            with opened(path) as raw, zipfile.ZipFile(raw) as archive, archive.open(member) as inside:
                rows = csv.reader(io.TextIOWrapper(inside, encoding="utf-8-sig", newline=""))
                batch, header = [], False
                for values in rows:
                    if not any(v.strip() for v in values) and not header:
                        continue
                    if not header:
                        header = True
                        continue
                    if values:
                        batch.append(values)
                    if len(batch) == BATCH_ROWS:
                        yield self.batch(batch, at, schema)
                        batch = []
                if batch:
                    yield self.batch(batch, at, schema)

    @staticmethod
    def batch(rows: list[list[str]], at: list[int | None], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(
            [(r[i] or None) if i is not None and i < len(r) else None for r in rows], pa.string())
            for i in at], schema=schema)


class Zip(Files):
    """Rows of archive members as text, one partition per member, streamed batch by batch.

    ``paths`` lists (archive, member, its column names); the schema names the columns to read.
    """

    reads = ZipReader

    @classmethod
    def name(cls) -> str:
        return "punctua_zip"


def scan(spark: SparkSession, source: type[Files], files: list, schema=None) -> DataFrame:
    """A scan of ``files`` by one of the sources above."""
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("paths", json.dumps(files))
    return (reader.schema(schema) if schema is not None else reader).load()
