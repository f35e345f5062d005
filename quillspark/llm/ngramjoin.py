"""N-gram Jaccard join: links between documents whose shingle sets are alike, and their components.

The incidence of documents and shingles is a sparse matrix, dealt into blocks by shingle. In each block a
shingle that one document has alone is known to add to no overlap; a document that keeps too few shingles for the
least overlap that its size asks for can't link with any and drops out. What is left is small. Equal sets become
one class. Overlaps of classes are then accumulated exactly: the product of the rows of candidate pairs, where a
pair is a candidate if it shares a shingle among each one's first few (so few that more than the rest must
overlap) and its sizes are near enough.

Pairs of a shingle's first class with the others come first. Classes that these links join need no more pairs
with each other to know their component; pairs that are still apart follow, round by round with the first class of
each component and, at last, each pair whose components still differ. So a large group of near copies costs as
many pairs as it has members, and no link is lost.

Null texts and texts without words have no shingles and link with nothing. Rows with the same doc_id are one document
with the shingles of all of them; rows with a null doc_id take no part and get 0 and null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngramlm import grouped
from .shared import buckets, frugal, give_back, hash_words, joined_by_key, mix, ragged, spans, written

_U = np.uint64
BLOCKS = "bucket int, docs binary, row binary, sizes binary, shingles binary"
ROWS = "part int, docs binary, seen binary, shared binary, shingles binary"
SETS = "doc_id long, n_shingles long, shingles binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's different shingles of k words; a row of fewer words is one shingle."""
    start, end, upto = spans(data, offsets)
    hashes = hash_words(data, start, end)
    n = np.diff(upto)
    row = np.repeat(np.arange(len(n)), np.where(n >= k, n - k + 1, (n > 0).astype(int)))
    first = ragged(upto[:-1], np.where(n >= k, n - k + 1, (n > 0).astype(int)))
    width = np.minimum(n, k)[row]
    code = width.astype(np.uint64)
    for i in range(k):
        here = i < width
        code[here] = mix(code[here] * _U(0x9E3779B97F4A7C15) + hashes[first[here] + i])
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[new], code[new]


def incidence(docs: DataFrame, k: int, n: int) -> DataFrame:
    """Blocks of the matrix: of each group of documents, the shingles of each bucket."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in grouped(batches):
            numbers = np.array(ids.to_pylist(), np.int64)
            row, code = shingle_sets(data, offsets, k)
            bucket = (code % _U(n)).astype(np.int64)
            order = np.lexsort((row, bucket))
            row, code = row[order].astype(np.uint16), code[order]
            at = np.searchsorted(bucket[order], np.arange(n + 1))
            out = []
            for b in range(n):
                r, c = row[at[b] : at[b + 1]], code[at[b] : at[b + 1]]
                if len(r):
                    own, size = np.unique(r, return_counts=True)
                    # 48 bits and the bucket tell shingles apart
                    out.append((b, numbers[own].tobytes(), b"", size.astype(np.uint32).tobytes(), np.ascontiguousarray((c >> _U(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, [pa.int32()] + [pa.binary()] * 4, strict=True)], ["bucket", "docs", "row", "sizes", "shingles"])
            del ids, data, offsets, numbers, row, code, bucket, order, out
            give_back()

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(cut, BLOCKS)


def shared_sets(blocks: DataFrame, least: float, n: int) -> DataFrame:
    """doc_id, n_shingles, and the shingles that others have too, or null where they are too few to link."""

    def meet(group: pa.Table) -> pa.Table:
        docs = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in group["docs"]])
        sizes = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group["sizes"]]).astype(np.int64)
        raw = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in group["shingles"]]).reshape(-1, 6)
        code = np.zeros((len(raw), 8), np.uint8)
        code[:, :6] = raw
        code = code.view(np.uint64).ravel()
        docs, which = np.unique(docs, return_inverse=True)
        node = np.repeat(which, sizes)
        order = np.lexsort((node, code))
        code, node = code[order], node[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (node[1:] != node[:-1])
        code, node = code[new], node[new]
        same = np.zeros(len(code) + 1, bool)
        same[1:-1] = code[1:] == code[:-1]
        common = same[1:] | same[:-1]
        sizes = np.bincount(node, minlength=len(docs))
        # the number of a shingle begins with that of its documents, so that rare ones come first in order
        head = np.flatnonzero(~same[:-1])
        count = np.repeat(np.diff(np.append(head, len(code))), np.diff(np.append(head, len(code))))
        rank = np.minimum(255, 8 * np.log2(np.maximum(count, 1))).astype(np.uint64)
        order = np.argsort(node[common], kind="stable")
        held = mix(code[common][order] * _U(1 << 16) + _U(group["bucket"][0].as_py())) >> _U(8) | rank[common][order] << _U(56)
        shared = np.bincount(node[common], minlength=len(docs))
        part = (mix(docs.astype(np.uint64)) % _U(n)).astype(np.int64)
        turn = np.argsort(part, kind="stable")
        at = np.searchsorted(part[turn], np.arange(n + 1))
        first = np.concatenate([[0], np.cumsum(shared)])[:-1]
        out = []
        for p in range(n):
            if at[p + 1] > at[p]:
                d = turn[at[p] : at[p + 1]]
                out.append((p, docs[d].tobytes(), sizes[d].astype(np.uint32).tobytes(), shared[d].astype(np.uint32).tobytes(), held[ragged(first[d], shared[d])].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32()] + [pa.binary()] * 4, strict=True)], names=["part", "docs", "seen", "shared", "shingles"])

    def gather(group: pa.Table) -> pa.Table:
        read = lambda c, t: np.concatenate([np.frombuffer(x.as_py(), t) for x in group[c]])
        docs, seen, shared = read("docs", np.int64), read("seen", np.uint32).astype(np.int64), read("shared", np.uint32).astype(np.int64)
        code = read("shingles", np.uint64)
        ids, which = np.unique(docs, return_inverse=True)
        total = np.bincount(which, seen).astype(np.int64)
        owner = np.repeat(which, shared)
        order = np.lexsort((code, owner))
        owner, code = owner[order], code[order]
        new = np.ones(len(code), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
        owner, code = owner[new], code[new]
        at = np.searchsorted(owner, np.arange(len(ids) + 1))
        sets = [code[i:j].tobytes() if j - i and j - i >= least * t - 1e-9 else None for i, j, t in zip(at[:-1].tolist(), at[1:].tolist(), total.tolist(), strict=True)]
        return pa.table([pa.array(ids), pa.array(total), pa.array(sets, pa.binary())], names=["doc_id", "n_shingles", "shingles"])

    rows = blocks.groupBy("bucket").applyInArrow(frugal(meet), ROWS)
    return rows.groupBy("part").applyInArrow(frugal(gather), SETS)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node and component, its smallest reachable node: links (a, b) are turned to stars by large-star and
    small-star steps, whose number grows with the logarithm of the longest chain."""
    edges = written(links.select("a", "b").where("a != b").distinct(), "links")
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        new = written(small, "stars")
        # finished when each node has one smaller neighbour, which has none itself
        if not new.groupBy("a").count().where("count > 1").limit(1).count() and not new.join(new.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            break
        edges = new
    return nodes.join(new.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def firsts(classes: DataFrame, percent: int) -> DataFrame:
    """shingle, node, size and place of each class's first shingles, rare ones first: those that it has alone, then by number.
    Two classes that link share one among these."""

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, nodes, sizes, places = [], [], [], []
            for node, size, raw in zip(batch["node"].to_pylist(), batch["size"].to_pylist(), batch["shingles"].to_pylist(), strict=True):
                own = np.frombuffer(raw, np.uint64)
                alone = size - len(own)
                own = np.sort(own)[: max(0, size - -(-percent * size // 100) + 1 - alone)].view(np.int64)
                codes.append(own)
                nodes.append(np.full(len(own), node))
                sizes.append(np.full(len(own), size))
                places.append(alone + np.arange(len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c or [np.zeros(0, np.int64)]).astype(np.int64)) for c in (codes, nodes, sizes, places)], ["shingle", "node", "size", "place"])
            del codes, nodes, sizes, places
            give_back()

    return classes.select("node", "size", "shingles").mapInArrow(head, "shingle long, node long, size long, place long")


def linked(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap enough."""

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y, m, n in zip(batch["sa"].to_pylist(), batch["sb"].to_pylist(), batch["na"].to_pylist(), batch["nb"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (m + n - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(good, pa.bool_()))
            give_back()

    one = classes.select(F.col("node").alias("a"), F.col("size").alias("na"), F.col("shingles").alias("sa"))
    two = classes.select(F.col("node").alias("b"), F.col("size").alias("nb"), F.col("shingles").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(overlap, "a long, b long")


def similar_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, one row for each row of docs."""
    n = 2 * buckets(docs.sparkSession)
    sets = written(shared_sets(incidence(docs, k, n), percent / 100, n), "sets")
    # only a set that others share whole can equal another; one with shingles of its own is a class of its own
    whole = F.length("shingles") == 8 * F.col("n_shingles")
    able = sets.where("shingles is not null").withColumn("key", F.when(whole, F.unhex(F.sha2("shingles", 256))).otherwise(F.concat(F.lit("own "), F.col("doc_id").cast("string")).cast("binary")))
    heads = written(able.groupBy("key", "n_shingles").agg(F.min("doc_id").alias("node"), F.count("*").alias("size")), "heads")
    member = written(joined_by_key(able.select("doc_id", "key", "n_shingles"), heads, ["key", "n_shingles"], ["node"]).select("doc_id", "node"), "members")
    nodes = written(member.select("node").distinct(), "nodes")
    # sets stay where they are: rows of nodes alone are picked from what is small
    classes = able.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("size"), "shingles")

    def near(a: str, b: str) -> Column:
        """Whether two classes can overlap enough if this shingle is the first that they share: by their sizes, and by
        what each has from here on."""
        m, n = F.col(a.format("size")), F.col(b.format("size"))
        rest = F.least(m - F.col(a.format("place")), n - F.col(b.format("place")))
        return (100 * F.least(m, n) >= percent * F.greatest(m, n)) & ((100 + percent) * rest >= percent * (m + n))

    places = written(firsts(classes, percent).join(nodes, "node", "left_semi"), "firsts")
    places = written(places.join(places.groupBy("shingle").count().where("count > 1").select("shingle"), "shingle"), "shared")

    links = None
    state = nodes.select("node", F.col("node").alias("component"))
    last = None
    while True:
        now = places.join(state, "node")
        # of each shingle and component, the member with the smallest number; and of these the first
        ends = now.groupBy("shingle", "component").agg(F.min(F.struct("node", "size", "place")).alias("e"))
        head = ends.groupBy("shingle").agg(F.min("e").alias("h"), F.count("*").alias("c")).where("c > 1")
        pairs = ends.join(head, "shingle").where(F.col("e.node") != F.col("h.node")).where(near("e.{}", "h.{}"))
        pairs = pairs.select(F.col("h.node").alias("a"), F.col("e.node").alias("b")).distinct()
        if last is not None:
            pairs = pairs.join(last, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        found = written(linked(pairs, classes, percent), "found")
        if not found.limit(1).count():
            break
        last = pairs if last is None else last.union(pairs)
        links = found if links is None else links.union(found)
        state = written(components(nodes, links), "state")
    # the product of the first shingles' rows: overlaps of classes that are still apart, summed up
    now = places.join(state, "node")
    one, two = (now.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "size", "place", "component")]) for x in "ab")
    rest = one.join(two, "shingle").where("node_a < node_b and component_a != component_b").where(near("{}_a", "{}_b"))
    rest = rest.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "size_a", "size_b").agg(F.count("*").alias("overlap"), *[F.max(f"place_{x}").alias(f"end_{x}") for x in "ab"])
    # those that near keeps are the first that two share, so behind the last of them there can be no more than there is
    most = F.col("overlap") + F.least(*[F.col(f"size_{x}") - F.col(f"end_{x}") - 1 for x in "ab"])
    rest = rest.where((100 + percent) * most >= percent * (F.col("size_a") + F.col("size_b"))).select("a", "b")
    rest = written(rest, "rest")
    found = written(linked(rest, classes, percent), "found")
    if found.limit(1).count():
        links = found if links is None else links.union(found)
        state = written(components(nodes, links), "state")
    joined = member.join(state, "node").select("doc_id", "component")
    # a class of one component is known by its smallest document
    result = sets.select("doc_id", "n_shingles").join(joined, "doc_id", "left")
    known = result.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return docs.select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
