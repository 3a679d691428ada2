"""Pickled shards as a Spark data source, to read and to write: format "pickled_shards".

A shard file holds one pickle, or several in a row. Each is a dict of columns or a list of dicts, and is the unit that
a task holds at a time; the writer makes pickles of at most `rows` rows, so files may be of any size. A large file is
read by several tasks: they take turns by ranges of `rows` rows. Only the columns of the schema that the reader is
given are turned into rows.

Options: pattern (of file names, *.pkl), rows (1000), bytes (of a file for each task that reads it, 64 MB), names (JSON:
the key of a column in the pickle, or a list of keys to be tried, where it is another one), trusted. Unless it is
trusted, a pickle may hold plain containers, numbers, texts and numpy arrays alone: no other class is loaded, so none of
its code runs. Paths are those that pyarrow's file systems open; `readers.pickled_shards` reads any that Spark opens.
"""

from __future__ import annotations

import io
import json
import pickle
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAME = "pickled_shards"
#: What a pickle of plain values and numpy arrays is made of.
SAFE = {
    ("numpy", "ndarray"), ("numpy", "dtype"), ("_codecs", "encode"), ("collections", "OrderedDict"),
    *((f"numpy.{core}.multiarray", name) for core in ("core", "_core") for name in ("_reconstruct", "scalar")),
    *((f"numpy.{core}.numeric", "_frombuffer") for core in ("core", "_core")),
}
#: Keys of well-known columns, in the order in which they are tried behind the column's own name.
KEYS = {"study_id": ["study_id", "study_ids"], "caption": ["caption", "captions", "caption_seq", "tokens"], "image": ["image", "images", "frontal_img"]}


class PlainUnpickler(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if (module, name) not in SAFE:
            raise pickle.UnpicklingError(f"{module}.{name} is no plain value: pass trusted=true for files of your own")
        return super().find_class(module, name)


def rows_of(x, names: dict[str, list[str]], columns: list[str]) -> tuple[int, dict]:
    """(rows, column -> function of the row number) of one pickle.

    A dict has as many rows as `images`, or its longest list; a value that is no list, or a shorter one, goes to every
    row. A column that is nowhere is null.
    """
    keys = {c: [c, *names.get(c, KEYS.get(c, []))] for c in columns}
    if isinstance(x, dict):
        lists = {k: v for k, v in x.items() if isinstance(v, (list, tuple, np.ndarray))}
        n = len(x["images"]) if "images" in lists else max(map(len, lists.values()), default=0)

        def column(c: str):
            k = next((k for k in keys[c] if k in x), None)
            if k is None:
                return lambda i: None
            return (lambda i: lists[k][i] if i < len(lists[k]) else x[k]) if k in lists else (lambda i: x[k])

        return n, {c: column(c) for c in columns}
    rows = list(x)
    return len(rows), {c: (lambda i, c=c: next((rows[i][k] for k in keys[c] if k in rows[i]), None)) for c in columns}


def plain(x, kind: pa.DataType):
    """A value as Arrow takes it for a column of that type."""
    if x is None:
        return None
    x = x.tolist() if isinstance(x, np.ndarray) else x.item() if isinstance(x, np.generic) else x
    return str(x) if pa.types.is_string(kind) and not isinstance(x, str) else x


def pickles(file: io.IOBase, trusted: bool) -> Iterator:
    """The objects of a file, one after the other."""
    load = pickle.Unpickler if trusted else PlainUnpickler
    file = io.BufferedReader(file) if not hasattr(file, "peek") else file
    while file.peek(1):
        yield load(file).load()


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


@dataclass
class Part(InputPartition):
    path: str
    part: int
    parts: int


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.schema, self.path = schema, options["path"]
        self.rows, self.bytes = int(options.get("rows", 1000)), int(options.get("bytes", 64 << 20))
        self.pattern, self.trusted = options.get("pattern", "*.pkl"), str(options.get("trusted", "false")).lower() == "true"
        self.names = {k: [v] if isinstance(v, str) else v for k, v in json.loads(options.get("names", "{}")).items()}

    def partitions(self) -> list[Part]:
        store, path = _store(self.path)
        info = store.get_file_info(path)
        found = [info] if info.is_file else store.get_file_info(pa.fs.FileSelector(path, recursive=True))
        out = []
        for x in sorted(found, key=lambda x: x.path):
            if x.is_file and (info.is_file or fnmatch(posixpath.basename(x.path), self.pattern)):
                parts = max(1, -(-x.size // self.bytes))
                out += [Part(x.path, k, parts) for k in range(parts)]
        return out or [Part("", 0, 1)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        schema = to_arrow_schema(self.schema)
        store, _ = _store(self.path)
        first = 0  # number of the pickle's first row in the file
        with store.open_input_file(partition.path) as file:
            for x in pickles(file, self.trusted):
                n, columns = rows_of(x, self.names, schema.names)
                for a in range(-(first % self.rows), n, self.rows):
                    if (first + a) // self.rows % partition.parts == partition.part:
                        at = range(max(a, 0), min(a + self.rows, n))
                        yield pa.RecordBatch.from_arrays([pa.array([plain(columns[f.name](i), f.type) for i in at], f.type) for f in schema], schema=schema)
                first += n


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class Writer(DataSourceArrowWriter):
    """A file for each task that has rows; overwriting removes the files that were there before, once all are written."""

    def __init__(self, options, overwrite: bool):
        self.path, self.rows, self.overwrite = options["path"], int(options.get("rows", 1000)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = _store(self.path)
        name, n, file = f"{path}/part-{uuid.uuid4().hex}.pkl", 0, None
        try:
            for batch in iterator:
                for a in range(0, batch.num_rows, self.rows):
                    if file is None:
                        store.create_dir(path)
                        file = store.open_output_stream(name)
                    part = batch.slice(a, self.rows)
                    file.write(pickle.dumps({k: c.to_pylist() for k, c in zip(part.schema.names, part.columns)}))
                    n += part.num_rows
        finally:
            if file is not None:
                file.close()
        return Written(name if n else "", n)

    def commit(self, messages: list[Written | None]) -> None:
        new = {posixpath.basename(m.path) for m in messages if m and m.path}
        if self.overwrite:
            store, path = _store(self.path)
            for x in store.get_file_info(pa.fs.FileSelector(path, recursive=True, allow_not_found=True)):
                if x.is_file and fnmatch(posixpath.basename(x.path), "part-*.pkl") and posixpath.basename(x.path) not in new:
                    store.delete_file(x.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m and m.path:
                store.delete_file(m.path)


class PickledShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "study_id string, caption array<int>"

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(PickledShards)
