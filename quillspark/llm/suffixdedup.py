"""Removes bytes covered by long strings that start anywhere else too, with a logarithmic family of suffix arrays.

Suffixes are sampled where content says so: of all SEED-byte strings in a window of min_bytes bytes, those with
the least hash are its anchors. Equal windows have equal anchors, so each repeated window has one at the same
offset, and only anchors' suffixes need an index. It is dealt by the hash of their first SEED bytes; equal suffixes
stand side by side in the order of these hashes. Inside each part, every batch of documents gives a sorted array,
is scanned against the levels there are, and joins them; levels of equal size merge, so that n batches keep
log n levels and cost n log n.

A match at an anchor is settled by a hash of all bytes that windows with the anchor may hold. Where that differs
but the first bytes agree, a match ends nearby: there the windows of that anchor are compared themselves. Of strings
that occur often in a batch one is sent on, with a mark that it repeats, so frequent ones don't pile up.

Null texts are empty. Rows equal in doc_id and text are documents of their own, so what they hold repeats. A null
doc_id is an id like others. A text of any length is one row of its batch. An empty table gives no rows. Further columns
are kept; n_bytes, n_removed, n_spans and kept_sha256 of docs are replaced by those of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import buckets, chunks, column, dealt, free_names, frugal, give_back, mix, prefix_hash, span_hash, text_bytes, written

_U = np.uint64
#: Bytes of text that a task gathers before it sends its keys on, and documents among them at most.
GROUP, DOCS = 32 << 20, 65_000
KEYS = "deal int, source long, one binary, two binary, row binary, pos binary, many binary"
MARKS = "deal int, source long, row binary, pos binary, mark binary"
SPANS = "doc_id long, row long, spans binary, near binary"
#: Marks of a place: its string occurs elsewhere; only its first bytes do.
SAME, NEAR = 1, 2


def sliding(x: np.ndarray, width: int, f: np.ufunc, fill: int) -> np.ndarray:
    """f over x[i:i+width] for each i; what lies beyond the end counts as fill."""
    n = len(x)
    whole = np.full((-(-(n + width) // width) + 1) * width, fill, x.dtype)
    whole[:n] = x
    blocks = whole.reshape(-1, width)
    ahead = f.accumulate(blocks, axis=1).ravel()
    behind = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[:n], ahead[width - 1 : width - 1 + n])


def sampled(data: np.ndarray, offsets: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, ...]:
    """Prefix sums, hashes of all seed-byte strings, their order, and of each window the least order in it; 0 where
    a window reaches over the end of its row."""
    prefix = prefix_hash(data)
    start = np.arange(len(data) - seed + 1)
    code = span_hash(prefix, start, start + seed)
    order = (code >> _U(32)).astype(np.uint32) | np.uint32(1)
    least = sliding(order, size - seed + 1, np.minimum, 2**32 - 1)
    row_end = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    least[start + size > row_end] = 0
    return prefix, code, order, least


def anchors(data: np.ndarray, offsets: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, ...]:
    """Row, place in the row, hash of the seed bytes there, and hash of all bytes of windows that hold them."""
    if len(data) < size:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    prefix, code, order, least = sampled(data, offsets, size, seed)
    most = sliding(least[::-1], size - seed + 1, np.maximum, 0)[::-1]
    at = np.flatnonzero(most == order)
    row = np.searchsorted(offsets, at, "right") - 1
    low, high = np.maximum(offsets[row], at - (size - seed)), np.minimum(offsets[row + 1], at + size)
    context = mix(span_hash(prefix, low, high) ^ mix((at - low).astype(np.uint64) << _U(32) | (high - at).astype(np.uint64)))
    return row, at - offsets[row], code[at], context


def windows(data: np.ndarray, offsets: np.ndarray, near: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, ...]:
    """Row, place, hash and 0 of the windows whose least string is at one of the places near.

    Only equal windows are to meet, so they are dealt by their own hash: the different windows of a string that many
    documents hold don't gather in one part.
    """
    if len(data) < size or not len(near):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    prefix, _, order, least = sampled(data, offsets, size, seed)
    asked = np.full(len(order), 2**32 - 1, np.uint32)
    asked[near] = order[near]
    at = np.flatnonzero(sliding(asked, size - seed + 1, np.minimum, 2**32 - 1) == least)
    row = np.searchsorted(offsets, at, "right") - 1
    return row, at - offsets[row], span_hash(prefix, at, at + size), np.zeros(len(at), np.uint64)


class Levels:
    """The family of sorted arrays of one part of the index: each entry's first and second key and its number.

    A batch is sorted and scanned against each level, which costs its own length times the logarithm of the level's; levels
    of equal size merge by their order, so an entry moves once for each doubling. `work` counts the entries touched.
    """

    def __init__(self, n: int):
        self.same, self.near = np.zeros(n, bool), np.zeros(n, bool)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.work = 0

    @staticmethod
    def _places(level: tuple, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many entries of a level have the first key, the first of them, and where each pair is or would be."""
        low, high = np.searchsorted(level[0], one, "left"), np.searchsorted(level[0], one, "right")
        place, active = low.copy(), np.flatnonzero(low < high)
        left, right, key = low[active], high[active], two[active]
        while (open_ := left < right).any():  # within these the second keys are in order
            mid = (left + right) // 2
            less = open_ & (level[1][np.minimum(mid, len(level[1]) - 1)] < key)
            left, right = np.where(less, mid + 1, left), np.where(open_ & ~less, mid, right)
        place[active] = left
        return high - low, low, place

    def add(self, one: np.ndarray, two: np.ndarray, number: np.ndarray) -> None:
        """A batch, whose pairs of keys are all different."""
        order = np.lexsort((two, one))
        run = one[order], two[order], number[order]
        alike = run[0][1:] == run[0][:-1]
        self.near[run[2][1:][alike]] = True
        self.near[run[2][:-1][alike]] = True
        known = np.zeros(len(one), bool)
        for level in self.levels:
            many, first, at = self._places(level, run[0], run[1])
            equal = (at < first + many) & (level[1][np.minimum(at, len(level[1]) - 1)] == run[1])
            self.same[run[2][equal]] = self.same[level[2][at[equal]]] = True
            others = many > equal
            self.near[run[2][others]] = True
            # several entries of one first key have met each other, so they are marked already
            self.near[level[2][first[others & (many == 1)]]] = True
            known |= equal
            self.work += len(run[0])
        run = tuple(x[~known] for x in run)
        while self.levels and len(self.levels[-1][0]) <= len(run[0]):
            old = self.levels.pop()
            at = self._places(old, run[0], run[1])[2]
            run = tuple(np.insert(x, at, y) for x, y in zip(old, run, strict=True))
            self.work += len(run[0])
        if len(run[0]):
            self.levels.append(run)


def batch_rows(source: int, n: int, row: np.ndarray, pos: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """The different pairs of keys of a batch, by bucket, and which places repeat another of the batch.

    In a bucket they go by place, and a place is told by its distance from the one before, so that first keys and
    places of neighbours compress to little.
    """
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(a)))
    repeated = np.zeros(len(a), bool)
    repeated[order] = np.repeat(count > 1, count)
    send = order[head]
    bucket = (one[send] % _U(n)).astype(np.int64)
    turn = np.lexsort((pos[send], row[send], bucket))
    at = np.searchsorted(bucket[turn], np.arange(n + 1))
    out = []
    for k in range(n):
        i = turn[at[k] : at[k + 1]]
        if len(i):
            s = send[i]
            out.append((k, source, one[s].tobytes(), two[s].tobytes(), row[s].astype(np.uint16).tobytes(), np.diff(pos[s], prepend=0).astype(np.uint32).tobytes(), (count[i] > 1).tobytes()))
    return out, repeated


def record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), fields, strict=True)], [n for n, _ in fields])


def meet(group: pa.Table, ends: bool) -> pa.Table:
    """Marks of the places of one bucket; ends: also of those whose first key alone is found. Rows that only belong
    to their source go through."""
    deal = group["deal"].to_pylist()
    cells = [group[c].to_pylist() for c in ("source", "one", "two", "row", "pos", "many")]
    if deal[0] < 0:
        return pa.Table.from_batches([record([(d, s, x, y, z) for d, s, x, y, z in zip(deal, cells[0], cells[1], cells[2], cells[3], strict=True)], MARKS)])
    order = np.argsort(cells[0], kind="stable").tolist()
    sizes = [len(cells[1][i]) // 8 for i in order]
    index, at = Levels(sum(sizes)), 0
    for i, size in zip(order, sizes, strict=True):
        number = np.arange(at, at := at + size)
        index.same[number] |= np.frombuffer(cells[5][i], bool)
        index.add(np.frombuffer(cells[1][i], np.uint64), np.frombuffer(cells[2][i], np.uint64), number)
    out, at = [], 0
    for i, size in zip(order, sizes, strict=True):
        mark = index.same[at : at + size] * SAME + (index.near[at : at + size] * NEAR if ends else 0)
        at += size
        good = mark > 0
        if good.any():
            out.append((0, cells[0][i], np.frombuffer(cells[3][i], np.uint16)[good].tobytes(), np.cumsum(np.frombuffer(cells[4][i], np.uint32), dtype=np.uint32)[good].tobytes(), mark[good].astype(np.uint8).tobytes()))
    return pa.Table.from_batches([record(out, MARKS)])


def runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals [start, end), as disjoint ones that don't touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return start[new], reach[last]


def by_row(row: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> list[bytes | None]:
    """For each row the union of its intervals as pairs of longs."""
    return [np.column_stack(runs(start[i], end[i])).astype(np.int64).tobytes() if len(i) else None for i in of_rows(row, n)]


def of_rows(row: np.ndarray, n: int) -> list[np.ndarray]:
    """For each of n rows where it stands in row."""
    order = np.argsort(row, kind="stable")
    return np.split(order, np.searchsorted(row[order], np.arange(1, n)))


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size, rows = [], 0, 0
    for batch in batches:
        for i in range(0, len(batch), 2000):
            held.append(batch[i : i + 2000])
            size, rows = size + held[-1]["text"].nbytes, rows + len(held[-1])
            if size >= GROUP or rows >= DOCS - 2000:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def settled(docs: DataFrame, size: int, keys, seed: int, n: int) -> DataFrame:
    """doc_id, row, spans and near: for each document the windows (starts from, to) that occur elsewhere, and where a
    match ends. keys(table, data, offsets) gives row, pos and two keys of each place; seed is its length."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        source = TaskContext.get().partitionId() << 24
        for t in groups(batches):
            data, offsets = text_bytes(t["text"])
            row, pos, one, two = keys(t, data, offsets)
            out, repeated = batch_rows(source, n, row, pos, one, two)
            lengths = np.diff(offsets)
            about = pa.ipc
            sink = pa.BufferOutputStream()
            with about.new_stream(sink, pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("length", pa.int64())])) as w:
                w.write_batch(pa.record_batch([t["doc_id"].combine_chunks(), t["row"].combine_chunks(), pa.array(lengths)], ["doc_id", "row", "length"]))
            low, high = np.maximum(pos - (size - seed), 0), np.minimum(pos, lengths[row] - size)
            r = row[repeated]
            spans = by_row(r, low[repeated], high[repeated] + 1, len(t))
            held = pa.BufferOutputStream()
            with about.new_stream(held, pa.schema([("spans", pa.binary())])) as w:
                w.write_batch(pa.record_batch([pa.array(spans, pa.binary())], ["spans"]))
            out.append((-1 - dealt(source, n), source, sink.getvalue().to_pybytes(), held.getvalue().to_pybytes(), b"", b"", b""))
            yield record(out, KEYS)
            source += 1
            del t, data, offsets, row, pos, one, two, out, repeated, lengths, sink, low, high, r, spans, held
            give_back()

    def back(group: pa.Table) -> pa.Table:
        row, pos, mark = [], [], []
        for deal, x, y, z in zip(*(group[c].to_pylist() for c in ("deal", "row", "pos", "mark")), strict=True):
            if deal < 0:
                about, own = pa.ipc.open_stream(x).read_all(), pa.ipc.open_stream(y).read_all()["spans"].to_pylist()
            else:
                row.append(np.frombuffer(x, np.uint16).astype(np.int64))
                pos.append(np.frombuffer(y, np.uint32).astype(np.int64))
                mark.append(np.frombuffer(z, np.uint8))
        row, pos, mark = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row, pos, mark))
        lengths = about["length"].to_numpy()
        low, high = np.maximum(pos - (size - seed), 0), np.minimum(pos, lengths[row] - size) + 1
        before = [np.frombuffer(b or b"", np.int64).reshape(-1, 2) for b in own]
        same, near = mark & SAME > 0, mark & NEAR > 0
        kept = np.concatenate([np.zeros((0, 2), np.int64), *before])
        owner = np.repeat(np.arange(len(before)), [len(b) for b in before])
        spans = by_row(np.concatenate([owner, row[same]]), np.concatenate([kept[:, 0], low[same]]), np.concatenate([kept[:, 1], high[same]]), len(before))
        places = pos[near]
        ends = [np.sort(places[i]).tobytes() if len(i) else None for i in of_rows(row[near], len(before))]
        found = pa.table([about["doc_id"], about["row"], pa.array(spans, pa.binary()), pa.array(ends, pa.binary())], names=["doc_id", "row", "spans", "near"])
        return found.filter(pa.compute.or_(pa.compute.is_valid(found["spans"]), pa.compute.is_valid(found["near"])))

    rows = docs.mapInArrow(send, KEYS).groupBy("deal").applyInArrow(frugal(lambda t: meet(t, seed < size)), MARKS)
    return rows.groupBy("source").applyInArrow(frugal(back), SPANS)


def cut(docs: DataFrame, spans: DataFrame, size: int) -> DataFrame:
    """docs with text as what is left, and n_bytes, n_removed, n_spans and kept_sha256.

    A character of which some bytes stay and some go is replaced in text; kept_sha256 is of the bytes.
    """
    added = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType())]
    fields = [f for f in docs.schema if f.name not in dict(added)]
    names = [f.name for f in fields]
    own_row, other, other_row, held_spans = free_names(docs, "own_row", "other", "other_row", "held_spans")
    held = spans.where("spans is not null").groupBy(F.col("doc_id").alias(other), F.col("row").alias(other_row)).agg(F.collect_list("spans").alias(held_spans))
    rows = docs.withColumn(own_row, row_key())
    rows = rows.join(held, rows["doc_id"].eqNullSafe(held[other]) & (rows[own_row] == held[other_row]), "left").select(*[column(docs, c) for c in names], held_spans)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = [], []
            for text, own in zip(batch["text"].to_pylist(), batch[held_spans].to_pylist(), strict=True):
                data = (text or "").encode()
                if not own:
                    texts.append(text)
                    out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                    continue
                at = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 2) for b in own])
                low, high = runs(at[:, 0], at[:, 1] + size - 1)
                left = b"".join(data[i:j] for i, j in zip([0, *high.tolist()], [*low.tolist(), len(data)], strict=True))
                texts.append(left.decode(errors="replace"))
                out.append((len(data), len(data) - len(left), len(low), hashlib.sha256(left).hexdigest()))
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(i) for i, c in enumerate(names)]
            more = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, [pa.int64()] * 3 + [pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays(columns + more, [*names, *dict(added)])
            del texts, out, columns, more
            give_back()

    return rows.mapInArrow(remove, T.StructType(fields + [T.StructField(n, k) for n, k in added]))


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def each(offsets: np.ndarray, f) -> tuple[np.ndarray, ...]:
    """f(i, j) over runs of rows [i, j) of some hundred KB; its first result counts rows from i."""
    out = [f(i, j) for i, j in chunks(offsets, 1 << 18)]
    rows = [o[0] + i for o, (i, _) in zip(out, chunks(offsets, 1 << 18), strict=True)]
    return np.concatenate(rows), *(np.concatenate(c) for c in list(zip(*out, strict=True))[1:])


def near_places(first: DataFrame) -> DataFrame:
    """_id, _row and near: all lists of places of a document. Rows equal in doc_id and text have one each, and these
    differ, as a place is marked for the copy alone that stands in the index."""
    return first.where("near is not null").groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set("near").alias("near"))


def dedup_bytes(docs: DataFrame, size: int = 200) -> DataFrame:
    """docs with text as what is left after removing each byte that a repeated string of size bytes covers."""
    n, seed = 2 * buckets(docs.sparkSession), size // 2
    rows = docs.select("doc_id", row_key().alias("row"), "text")

    def first_keys(_: pa.Table, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        return each(offsets, lambda i, j: anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size, seed))

    def second_keys(t: pa.Table, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        near = [np.unique(np.frombuffer(b"".join(x), np.int64)) for x in t["near"].to_pylist()]

        def own(i: int, j: int) -> tuple[np.ndarray, ...]:
            bounds = offsets[i : j + 1] - offsets[i]
            return windows(data[offsets[i] : offsets[j]], bounds, np.concatenate([x + b for x, b in zip(near[i:j], bounds, strict=False)]), size, seed)

        return each(offsets, own)

    first = written(settled(rows, size, first_keys, seed, n), "matches")
    asked = near_places(first)
    again = rows.join(asked, rows["doc_id"].eqNullSafe(asked["_id"]) & (rows["row"] == asked["_row"])).select("doc_id", "row", "text", "near")
    second = settled(again, size, second_keys, size, n)
    return cut(docs, first.select("doc_id", "row", "spans").union(second.select("doc_id", "row", "spans")), size)
