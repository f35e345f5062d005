"""Token files: Arrow IPC files whose one column is a fixed-size list of ids, with a mask beside it.

Each task writes one file; its rows are equally long, so that row k of a file is at a known place of its
memory map. The mask is a fixed-size list as well: a bit for each id, set where it is real; only a file's last row is
padded. Documents are in ascending doc_id order over the files' names, nulls first. A table beside the files holds where
each document starts.

A null text is empty; an empty table writes no files. Rows with the same doc_id follow one another in any order. A text of
any length goes to the file in parts. Further columns are ignored, whatever their names. A task that is run again writes a
file of another name; the index names the finished one, and `shared.clear` deletes them all.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytebpe import encoder
from .shared import buckets, by_bytes, new_path, written

#: Ids in a row of a file, and rows in a record batch: one batch is what a writer holds.
WIDTH, ROWS = 2048, 256
#: Bytes of text encoded at once.
TEXT = 8 << 20
INDEX = "part int, file string, doc_id long, file_start long, n_tokens long"


class Writer:
    """Ids in, rows of WIDTH ids out. A file has a name of its own for each attempt of a task; only files that
    the index names were finished."""

    def __init__(self, folder: str, name: str, dtype: np.dtype):
        self.system, path = fs.FileSystem.from_uri(folder)
        self.system.create_dir(path)
        self.path, self.dtype = f"{path}/{name}", dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, WIDTH)), ("mask", pa.list_(pa.bool_(), WIDTH))])
        self.sink = self.system.open_output_stream(self.path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.waiting = self.written = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.waiting += len(ids)
        if self.waiting >= WIDTH * ROWS:
            flat = np.concatenate(self.held)
            n = len(flat) // (WIDTH * ROWS) * WIDTH * ROWS
            for i in range(0, n, WIDTH * ROWS):
                self._put(flat[i : i + WIDTH * ROWS])
            self.held, self.waiting = [flat[n:]], len(flat) - n

    def _put(self, flat: np.ndarray) -> None:
        rows = -(-len(flat) // WIDTH)
        real = np.arange(rows * WIDTH) < len(flat)
        flat = np.pad(flat, (0, rows * WIDTH - len(flat)))
        self.file.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(flat), WIDTH), pa.FixedSizeListArray.from_arrays(pa.array(real), WIDTH)], schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            self._put(np.concatenate(self.held))
        self.file.close()
        self.sink.close()


class Reader:
    """ids[start:start+n] of a file, from the batches that hold them; a local file is memory-mapped."""

    def __init__(self, folder: str, name: str):
        system, path = fs.FileSystem.from_uri(folder)
        local = isinstance(system, fs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(f"{path}/{name}") if local else system.open_input_file(f"{path}/{name}"))
        self.at, self.flat = -1, np.zeros(0)

    def read(self, start: int, n: int) -> np.ndarray:
        out, size = [], WIDTH * ROWS
        while n > 0:
            k, i = divmod(start, size)
            if k != self.at:
                self.at, self.flat = k, self.file.get_batch(k).column(0).flatten().to_numpy()
            out.append(self.flat[i : i + n])
            start, n = start + len(out[-1]), n - len(out[-1])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0) -> DataFrame:
    """Writes the files; returns their index: part, file, doc_id, file_start, n_tokens."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name, out, at = f"{part:08d}-{uuid.uuid4().hex}.arrow", None, 0
        for batch in by_bytes(batches, TEXT):
            machine = encoder(vocabulary)
            out = out or Writer(folder, name, np.dtype("u2" if machine.merges.size <= 1 << 16 else "u4"))
            ids, upto = machine.encode([t or "" for t in batch["text"].to_pylist()])
            ends = np.insert(ids, upto[1:], end_id)
            sizes = np.diff(upto) + 1
            out.add(ends)
            starts = at + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            at += len(ends)
            n = len(batch)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array([name] * n), batch["doc_id"], pa.array(starts), pa.array(sizes)], ["part", "file", "doc_id", "file_start", "n_tokens"])
        if out:
            out.close()

    rows = docs.select("doc_id", "text").repartitionByRange(buckets(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    return written(rows.mapInArrow(write, INDEX), "index")


def read_files(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            crc = []
            for file, start, n in zip(batch["file"].to_pylist(), batch["file_start"].to_pylist(), batch["n_tokens"].to_pylist(), strict=True):
                if file != name:
                    name, reader = file, Reader(folder, file)
                crc.append(zlib.crc32(reader.read(start, n).astype("<u4")))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base"))
    rows = index.join(base, "part").select("file", "doc_id", (F.col("file_start") + F.col("base")).alias("start"), "file_start", "n_tokens")
    # the ids of a file are read by one task, whatever the size of the index
    rows = rows.repartition(buckets(index.sparkSession), "file").sortWithinPartitions("file", "file_start")
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    return new_path(spark, "tokens")
