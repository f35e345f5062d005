"""What the operators share: the shared folder, cut lineage, hashes of spans of bytes and words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that part words: space, tab, newline, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, the other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
PRIME = _U(2**31 - 1)
_BASES = (1_103_515_245, 1_816_238_993)
_TABLES = {s: np.random.default_rng(s).integers(1, 2**64, 256, dtype=np.uint64) for s in (7, 11)}
_POWERS: dict[int, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a single machine, where none is set, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark.sparkContext, "_own_shared_dir", None) or tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext._own_shared_dir = found
        found = f"file://{found}"
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which clear deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    held = spark.sparkContext.__dict__.setdefault("_written_paths", [])
    held.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and safe from lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes what the operators of this session wrote to the shared folder; to be called when their results, which
    read it, have been used or saved. Returns how many places there were."""
    held = spark.sparkContext.__dict__.pop("_written_paths", [])
    for path in held:
        system, at = fs.FileSystem.from_uri(path)
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)
    return len(held)


#: A key with more than 1 of so many rows is hot; there are no more hot ones than that.
HOT = 1000


def joined_by_key(rows: DataFrame, table: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """rows with the columns values of the row of table that has the same key; others go. table holds each key once, with
    the number of its rows as size, and is read several times.

    The at most HOT hot keys are broadcast, so no task gets all rows of one.
    """
    total = table.agg(F.sum("size")).first()[0] or 0
    is_hot = F.col("size") > total / HOT
    side = lambda where, mark: table.where(where).select(F.lit(True).alias(mark), *[F.col(c).alias(f"{mark}_{c}") for c in (*by, *values)])
    found = rows.join(F.broadcast(side(is_hot, "table_hot")), [F.col(c) == F.col(f"table_hot_{c}") for c in by], "left")
    # rows that are settled go anywhere: each has a key of its own, which no other meets
    spread = F.when(F.col("table_hot").isNull(), F.xxhash64(*by)).otherwise(F.xxhash64(*rows.columns))
    rest = side(~is_hot, "table_cold").withColumn("table_hash", F.xxhash64(*[f"table_cold_{c}" for c in by]))
    found = found.withColumn("table_spread", spread).join(rest, (F.col("table_spread") == F.col("table_hash")) & F.col("table_hot").isNull() & reduce(and_, [F.col(c) == F.col(f"table_cold_{c}") for c in by]), "left")
    return found.where("table_hot or table_cold").select(*rows.columns, *[F.coalesce(f"table_hot_{c}", f"table_cold_{c}").alias(c) for c in values])


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns of an operator's own that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """The name of a column as an expression reads it."""
    return "`" + name.replace("`", "``") + "`"


def column(df: DataFrame, name: str) -> Column:
    return df[quoted(name)]


def by_bytes(batches: Iterator[pa.RecordBatch], size: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about size bytes of text each; a longer row stands alone."""
    for batch in batches:
        texts = batch[name]
        if not len(batch):
            continue
        if texts.nbytes <= size or len(batch) == 1:
            yield batch
            continue
        lengths = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in chunks(np.concatenate([[0], np.cumsum(lengths)]), size):
            yield batch.slice(i, j - i)


def buckets(spark: SparkSession) -> int:
    """Into how many parts the operators deal their work: as many as the session shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2^62."""
    x = (x & PRIME) + (x >> _U(31))
    x = (x & PRIME) + (x >> _U(31))
    x[x == PRIME] = 0
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo PRIME; the table is kept and grows by doubling."""
    have = _POWERS.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, folded(have * _U(pow(base, len(have), int(PRIME))))])
    _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the last steps of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def dealt(source: int, n: int) -> int:
    """Which of n groups takes what only passes through from a source."""
    return int(mix(np.array([source], np.uint64))[0] % _U(n))


def prefix_hash(values: np.ndarray, seed: int = 7) -> np.ndarray:
    """Prefix sums, for each of two bases, from which span_hash gives the hash of any span of bytes (or of 64-bit values).

    Polynomials modulo a prime: modulo a power of two, strings built by doubling would have one hash whatever the base.
    """
    n = len(values)
    wide = _TABLES[seed][values] if values.dtype == np.uint8 else mix(values ^ _U(seed))
    out = np.zeros((2, n + 1), np.uint64)
    for k, base in enumerate(_BASES):
        np.cumsum(folded((wide >> _U(33 * k) & PRIME) * powers(base, n)), out=out[k, 1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """62-bit hashes, spread over 64 bits, of spans [start, end); equal contents give equal hashes wherever they stand."""
    both = []
    for k, base in enumerate(_BASES):
        inverse = powers(pow(base, -1, int(PRIME)), prefix.shape[1])
        both.append(folded(folded(prefix[k][end] - prefix[k][start]) * inverse[start]))
    return mix((both[0] | both[1] << _U(31)) + (end - start).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Returns freed memory to the machine, so that a worker that has had a large group doesn't hold it in the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """f for groups; what it frees is given back after each."""

    def run(group: pa.Table) -> pa.Table:
        try:
            return f(group)
        finally:
            give_back()

    return run


def chunks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of about size bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the n+1 offsets of each row's words. space: which bytes part words."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~space[data]
    change = inside.copy()
    change[1:] = inside[1:] & ~inside[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    change[firsts] = inside[firsts]
    start = np.flatnonzero(change)
    stop = ~inside
    stop[firsts] = True
    stops = np.flatnonzero(stop)
    end = stops[np.searchsorted(stops, start, "right")] if len(start) else start
    return start, end, np.searchsorted(start, offsets)


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, size: int = 1 << 19) -> np.ndarray:
    """Hashes of words in lower case, by parts of about size bytes that bound the memory; spans are sorted."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + size)))
        prefix = prefix_hash(LOWER[data[start[i] : end[j - 1]]])
        out[i:j] = span_hash(prefix, start[i:j] - start[i], end[i:j] - start[i])
        i = j
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0]..starts[0]+lengths[0]-1, starts[1].. and so on, in one array."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
