"""Approximate nearest neighbours by multi-index hashing.

Rotations are learned on a bounded sample so that the signs of rotated vectors keep angles; the signs are a code. A code
is split into substrings, each with an index of its own. Of two codes within radius r, one of m substrings differs in at
most (r + 1) // m - 1 or so bits (`thresholds`: the sum over the substrings is r - m + 1), so probing the values that near
in each index finds every code within the radius, and these alone are ranked by their vectors. The radius is
learned on the sample too: it holds NEIGHBOURS of the sampled vectors' true neighbours.

The index is a table in the shared folder with a row for each block of at most BLOCK different vectors: their codes,
their vectors, and of each substring the rows by value. It is built once and can be searched again (`build`, `search`).
Equal vectors are one entry with the k + 1 smallest ids, which is all that a list of k can hold of them. Queries are a
table as well: the task of a block reads them part by part from the shared folder, so neither passes the driver. Queries
that find fewer than k rows within the radius (of an index that holds more) are searched again with a wider one.

Vectors that are null, zero, of another length than the most frequent or with null or non-finite components take no part,
nor do rows with a null vec_id. Of query rows with the same vec_id the least vector is used; repeated rows of the searched
table with one vec_id and vector count once. Ties go to the smaller vec_id. Without vectors there are no rows. Further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import buckets, new_path, ragged, written

#: Vectors for learning; bits of a code and of a substring; vectors in a block of the index, and queries read at once.
SAMPLE, BITS, PART, BLOCK, QUERIES = 10_000, 256, 16, 8192, 2048
#: The share of the sampled vectors' neighbours that the radius holds.
NEIGHBOURS = 0.95
BLOCKS = "ids binary, upto binary, vectors binary, codes binary, orders binary, values binary, starts binary, sizes binary"
FOUND = "head long, vec_id long, score double"
RANKED = "query_id long, rank int, vec_id long, score double"
#: How many bits are set in each 16-bit value.
_ONES = np.bitwise_count(np.arange(1 << PART, dtype=np.uint32)).astype(np.int8)


@dataclass
class Code:
    mean: np.ndarray
    turn: np.ndarray
    radius: int

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of substrings of PART bits."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.packbits((unit - self.mean) @ self.turn >= 0, axis=1).view(np.uint16)


def fit(x: np.ndarray, k: int, steps: int = 30, tried: int = 500) -> Code:
    """Principal directions of unit vectors, rotated step by step towards the corners of the cube; as many rotations, each
    from a start of its own, as fill the code."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = unit.mean(0)
    axes = np.linalg.eigh((unit - mean).T @ (unit - mean))[1].T[::-1][:BITS].T
    v, random, turns = (unit - mean) @ axes, np.random.default_rng(0), []
    for _ in range(-(-BITS // axes.shape[1])):
        turn = np.linalg.qr(random.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(steps):
            left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (left @ right).T
        turns.append(axes @ turn)
    code = Code(mean, np.hstack(turns)[:, :BITS], BITS)
    some = np.arange(0, len(x), max(1, len(x) // tried))[:tried]
    near = unit[some] @ unit.T
    near[np.arange(len(some)), some] = -2
    k = min(k, len(x) - 1)
    if k > 0:
        codes, best = code.of(x), np.argpartition(-near, k - 1, axis=1)[:, :k]
        code.radius = int(np.quantile(np.bitwise_count(codes[some][:, None] ^ codes[best]).sum(2), NEIGHBOURS))
    return code


def thresholds(radius: int, parts: int) -> list[int]:
    """How many bits each substring may differ in: together radius - parts + 1, so a code within the radius is within the
    threshold of one substring at least. A threshold of -1 needs no probe."""
    each, more = divmod(radius + 1, parts)
    return [each - (j >= more) for j in range(parts)]


class Block:
    """A block of the index: codes, and for each substring its rows by value."""

    def __init__(self, codes: np.ndarray, orders: np.ndarray, values: list[np.ndarray], starts: list[np.ndarray]):
        self.codes, self.orders, self.values, self.starts = codes, orders, values, starts
        self.words = codes.view(np.uint64)

    @classmethod
    def of(cls, codes: np.ndarray) -> "Block":
        orders, values, starts = [], [], []
        for column in codes.T:
            order = np.argsort(column, kind="stable")
            value, start = np.unique(column[order], return_index=True)
            orders.append(order.astype(np.uint32))
            values.append(value)
            starts.append(np.append(start, len(column)).astype(np.uint32))
        return cls(codes, np.array(orders), values, starts)

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, int]:
        """All rows whose code is within radius of code, and how many the probes reached."""
        hit = np.zeros(len(self.codes), bool)
        for j, (value, most) in enumerate(zip(code, thresholds(radius, len(code)), strict=True)):
            if most >= 0:
                probe = np.flatnonzero(_ONES[self.values[j] ^ value] <= most)
                start = self.starts[j][probe].astype(np.int64)
                hit[self.orders[j][ragged(start, self.starts[j][probe + 1] - start)]] = True
        rows = np.flatnonzero(hit)
        apart = np.bitwise_count(self.words[rows] ^ code.view(np.uint64)).sum(1)
        return rows[apart <= radius], len(rows)


def usable(rows: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select("vec_id", v.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good)


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


@dataclass
class Index:
    blocks: DataFrame
    code: Code
    dimensions: int
    k: int
    entries: int


def build(rows: DataFrame, k: int = 5) -> Index | None:
    """The index of all usable rows; None without any."""
    spark, base = rows.sparkSession, usable(rows)
    sizes = base.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return None
    # of equal vectors the k + 1 smallest ids; Spark keeps no more of each before it shuffles
    place = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = base.where(F.size("embedding") == sizes[0]["n"]).withColumn("place", place).where(F.col("place") <= k + 1).select("embedding", "vec_id")
    entries = written(few.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "entries")
    sample = entries.orderBy(F.xxhash64("embedding"), F.get("ids", 0)).limit(SAMPLE).select("embedding").toArrow()
    code, count = fit(matrix(sample["embedding"].combine_chunks()), k), entries.count()

    def block(group: pa.Table) -> pa.Table:
        ids, x = group["ids"].combine_chunks(), matrix(group["embedding"].combine_chunks())
        own = Block.of(code.of(x))
        flat = lambda arrays: np.concatenate(arrays).tobytes()
        narrow = x.astype(np.float32) if (x.astype(np.float32) == x).all() else x
        cells = [np.asarray(ids.flatten(), np.int64).tobytes(), np.cumsum([0, *(len(i) for i in ids)]).tobytes(), narrow.tobytes(), own.codes.tobytes(), own.orders.tobytes(), flat(own.values), flat(own.starts), np.array([len(v) for v in own.values]).tobytes()]
        return pa.table([pa.array([c], pa.binary()) for c in cells], names=[f.split()[0] for f in BLOCKS.split(", ")])

    dealt = entries.withColumn("block", F.pmod(F.xxhash64("embedding", F.lit("block")), F.lit(max(1, -(-3 * count // (2 * BLOCK))))))
    blocks = written(dealt.groupBy("block").applyInArrow(block, BLOCKS), "blocks")
    return Index(blocks, code, sizes[0]["n"], k, count)


def parts_of(path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """heads and vectors of the queries, some at a time."""
    system, at = fs.FileSystem.from_uri(path)
    for info in sorted(system.get_file_info(fs.FileSelector(at)), key=lambda f: f.path):
        if info.base_name.endswith(".parquet"):
            with system.open_input_file(info.path) as file:
                for batch in pyarrow.parquet.ParquetFile(file).iter_batches(QUERIES, columns=["head", "embedding"]):
                    if len(batch):
                        yield batch["head"].to_numpy(), matrix(batch["embedding"])


def search(index: Index, queries: DataFrame, radius: int) -> DataFrame:
    """head, vec_id and score of the k + 1 nearest rows of each block among those within radius. queries: head, embedding."""
    code, k, dimensions = index.code, index.k, index.dimensions
    path = new_path(queries.sparkSession, "asked")
    queries.write.parquet(path)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                read = lambda name, kind: np.frombuffer(r[name], kind)  # noqa: B023, E731
                ids, upto, codes = read("ids", np.int64), read("upto", np.int64), read("codes", np.uint16).reshape(-1, BITS // PART)
                cut = np.cumsum(read("sizes", np.int64))
                y = read("vectors", np.float32 if len(r["vectors"]) == 4 * dimensions * len(codes) else np.float64).reshape(len(codes), -1).astype(np.float64)
                own = Block(codes, read("orders", np.uint32).reshape(-1, len(codes)), np.split(read("values", np.uint16), cut[:-1]), np.split(read("starts", np.uint32), (cut + np.arange(1, len(cut) + 1))[:-1]))
                norms = np.linalg.norm(y, axis=1)
                for heads, x in parts_of(path):
                    out, lengths = [], np.linalg.norm(x, axis=1)
                    for i, asked in enumerate(code.of(x)):
                        rows, _ = own.within(asked, radius)
                        score = (y[rows] @ x[i]) / (norms[rows] * lengths[i])
                        if len(rows) > k + 1:  # entries with the k + 1 largest scores, and those that tie with the last
                            keep = np.flatnonzero(score >= np.partition(score, -(k + 1))[-(k + 1)])
                            rows, score = rows[keep], score[keep]
                        counts = upto[rows + 1] - upto[rows]
                        every, score = ids[ragged(upto[rows], counts)], np.repeat(score, counts)
                        best = np.lexsort((every, -score))[: k + 1]
                        out.append((np.full(len(best), heads[i]), every[best], score[best]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["head", "vec_id", "score"])

    return index.blocks.mapInArrow(ranked, FOUND)


def neighbours(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest by cosine."""
    spark, index = rows.sparkSession, build(rows, k)
    if index is None:
        return spark.createDataFrame([], RANKED)
    asked = usable(queries).where(F.size("embedding") == index.dimensions).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = written(asked, "queries")
    heads = written(asked.groupBy("embedding").agg(F.min("vec_id").alias("head")), "heads")
    by_head = Window.partitionBy("head").orderBy(F.desc("score"), "vec_id")
    left, radius, found = heads, index.code.radius, None
    while True:
        own = search(index, left.select("head", "embedding").repartition(buckets(spark), "head"), radius)
        own = written(own.withColumn("rank", F.row_number().over(by_head)).where(F.col("rank") <= k + 1).drop("rank"), "nearest")
        found = own if found is None else found.union(own)
        if radius >= BITS:
            break
        # an index of that few entries can't hold more, however wide the radius
        done = own.groupBy("head").count().where(F.col("count") >= min(k + 1, index.entries)).select("head")
        left, radius = written(left.join(done, "head", "left_anti"), "left"), min(BITS, radius + BITS // 8)
        found = found.join(left.select("head"), "head", "left_anti")
        if not left.limit(1).count():
            break
    each = asked.join(heads, "embedding").select(F.col("vec_id").alias("query_id"), "head")
    pairs = each.join(found, "head").where("vec_id != query_id").select("query_id", "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
