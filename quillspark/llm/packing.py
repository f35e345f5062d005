"""Packing of token pieces into sequences by minimum bin slack.

Null and empty texts hold the end token alone; a null doc_id is kept. A text of any length is cut into as many pieces as
it fills. Repeated rows are packed as often as they occur; of equal lengths the piece that comes first goes first. An
empty table gives no rows. Further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import encoder
from .shared import buckets, by_bytes, give_back, written

#: Pieces that one search for full bins chooses from; bounds its memory however many a task gets.
WINDOW = 1 << 15
#: Pieces that a task has at least, as the last sequence of each may stay short of its end.
LEAST = 1 << 12
#: Bytes of text encoded at once.
TEXT = 4 << 20


def fill(left: np.ndarray, capacity: int, first: int) -> list[tuple[int, int]]:
    """The multiset of remaining lengths that, with one piece of length first, comes closest to capacity.

    left: how many pieces remain of each length, first's piece excluded. Bit b of the set says that b tokens
    can be reached; each length adds its pieces by doubling counts, and the sets before each step are kept
    to walk the best total back to (length, count) pairs.
    """
    room = capacity - first
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in np.flatnonzero(left[: room + 1])[::-1].tolist():
        have, many = min(int(left[length]), room // length), 1
        while have > 0:
            many = min(many, have)
            have -= many
            steps.append((reach, length, many))
            reach |= (reach << (length * many)) & full
            many *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for before, length, many in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + many
            at -= length * many
    return [*chosen.items()]


def bins(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each piece its bin and its offset there, and the number of bins. The longest remaining piece opens
    a bin; ties go to the piece that comes first."""
    n = len(lengths)
    which, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    order = np.argsort(lengths, kind="stable")
    left = np.bincount(lengths, minlength=capacity + 1)
    nxt = np.concatenate([[0], np.cumsum(left)])[:-1]  # of each length, the first piece not yet packed
    count, top = 0, capacity
    while True:
        while top > 0 and not left[top]:
            top -= 1
        if top == 0:
            return which, offset, count
        left[top] -= 1
        used = 0
        for length, many in [(top, 1), *fill(left, capacity, top)]:
            if used:
                left[length] -= many
            own = order[nxt[length] : nxt[length] + many]
            nxt[length] += many
            which[own], offset[own] = count, used + length * np.arange(many)
            used += length * many
        count += 1


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int) -> DataFrame:
    """Each document's ids and end_id, cut into pieces of at most size tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, TEXT):
            ids, at = encoder(vocabulary).encode([t or "" for t in batch["text"].to_pylist()])
            rows: list[tuple] = []
            for doc, i, j in zip(batch["doc_id"].to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = np.append(ids[i:j], end_id).astype("<u4")
                rows += [(doc, s, min(size, len(own) - s), zlib.crc32(own[s : s + size]), len(own)) for s in range(0, len(own), size)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            del ids, rows
            give_back()

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack(cut: DataFrame, size: int) -> DataFrame:
    """Puts rows with a length into sequences of at most size tokens: sequence_id and offset are added.

    Rows are dealt by all their columns' hash, so that copies of a document spread, and each task packs its
    own by windows; a task leaves little padding in its last sequences alone.
    """
    cut = written(cut, "pieces")
    n = min(buckets(cut.sparkSession), max(1, cut.count() // LEAST))
    schema = f"{PIECES}, sequence_id long, offset long"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, held, rows = TaskContext.get().partitionId() << 40, [], 0

        def done() -> pa.RecordBatch:
            nonlocal made
            t = pa.Table.from_batches(held).combine_chunks()
            which, offset, count = bins(t["length"].to_numpy(), size)
            t = t.append_column("sequence_id", pa.array(which + made)).append_column("offset", pa.array(offset))
            made += count
            return t.to_batches()[0]

        for batch in batches:
            for i in range(0, len(batch), WINDOW):
                held.append(batch[i : i + WINDOW])
                rows += len(held[-1])
                if rows >= WINDOW:
                    yield done()
                    held, rows = [], 0
                    give_back()
        if rows:
            yield done()
        held = []
        give_back()

    return cut.repartition(n, F.xxhash64("doc_id", "start", "ids_crc32")).mapInArrow(packed, schema)


def packed_documents(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    return pack(pieces(docs, vocabulary, size, end_id), size)
