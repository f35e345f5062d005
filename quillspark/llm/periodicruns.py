"""Runs of words that repeat with a period, by a dictionary of basic factors.

A factor is a stretch of 2^k words; the names of factors of one length tell which are equal, and those of twice the length
come from pairs of names. Only factors that occur again in their text get a name, so ordinary prose is soon done.

A run of period q holds, for 2^k <= q < 2^(k+1), two equal factors q words apart. Occurrences of a factor no further apart
than half its length follow each other at the factor's own period, as arithmetic progressions; those of different
progressions are further apart, so at most three later ones begin within twice the length. Where a run begins, the factor
there is the first of its progression, or else the equal one a period later is the first of its own (it would extend the
run otherwise). So the first of each progression with all members of the three before and after proposes every period.
Proposals extend both ways by comparing names from the longest factor down; equal stretches are one run, with the least
period.

Null and empty texts have no words and no runs. Each row stands for itself; repeated rows get the same result, and a null
doc_id is kept. A text of any length is worked on as a whole, with about 50 bytes a word. An empty table gives no rows.
Further columns are kept, but n_words, runs and collapsed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import by_bytes, quoted, ragged, spans, text_bytes

#: Bytes of text worked on at once; a longer text stands alone.
TEXT = 4 << 20
#: Later progressions that can begin within twice the length of a factor.
NEAR = 3
RUNS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names from 1 for keys that occur more than once, 0 for others, and the places of those with names by (name, place)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    begins = np.ones(len(keys), bool)
    begins[1:] = ordered[1:] != ordered[:-1]
    alone = begins & np.append(begins[1:], True)
    names = np.zeros(len(keys), np.int32)
    held = order[~alone]
    names[held] = np.cumsum(begins & ~alone)[~alone]
    return names, held


class Factors:
    """Names of the factors of a sequence of texts. words: numbers of words; first: where the text of each word begins."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        self.size, self.levels, self.placed = len(words), [], []
        names, held = named(first << 32 | words)
        while len(held):
            self.levels.append(names)
            self.placed.append(held)
            step = 1 << len(self.levels) - 1
            both = np.sort(held)
            both = both[both + step < self.size]
            both = both[names[both + step] > 0]
            # a name at both halves is of one text, as names differ between texts
            both = both[first[both] == first[both + step]]
            found, order = named(names[both].astype(np.int64) << 32 | names[both + step])
            names = np.zeros(self.size, np.int32)
            names[both] = found
            held = both[order]

    def proposed(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and periods."""
        places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (names, held) in enumerate(zip(self.levels, self.placed, strict=True)):
            size = 1 << k
            name = names[held]
            begins = np.ones(len(held), bool)
            begins[1:] = (name[1:] != name[:-1]) | (np.diff(held) > size // 2)
            heads, group = held[begins], np.cumsum(begins) - 1
            kind = name[begins]
            for t in range(1, NEAR + 1):
                for other, after in ((group + t, True), (group - t, False)):
                    fits = (other >= 0) & (other < len(heads))
                    at, other = held[fits], other[fits]
                    same = kind[other] == name[fits]
                    at, head = at[same], heads[other[same]]
                    period = head - at if after else at - head
                    near = (period >= size) & (period < 2 * size)
                    places.append((at if after else head)[near])
                    periods.append(period[near])
        return np.concatenate(places), np.concatenate(periods)

    def extended(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the longest stretches around at where words a period apart are equal."""
        end, start = at + period, at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            names, size = self.levels[k], 1 << k
            x = np.minimum(end, self.size - 1)
            end = end + size * ((end < self.size) & (names[x] > 0) & (names[x] == names[x - period]))
        for k in range(len(self.levels) - 1, -1, -1):
            names, size = self.levels[k], 1 << k
            x = np.maximum(start - size, 0)
            start = start - size * ((start >= size) & (names[x] > 0) & (names[x] == names[x + period]))
        return start, end


def runs_of(words: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs of least words and two periods or more, by start and period."""
    factors = Factors(words, first)
    at, period = factors.proposed()
    start, end = factors.extended(at, period)
    kept = end - start >= np.maximum(least, 2 * period)
    start, end, period = start[kept], end[kept], period[kept]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def found_in(texts: pa.Array, least: int) -> list[pa.Array]:
    """The columns of RUNS for some texts."""
    data, offsets = text_bytes(texts)
    start, end, at = spans(data, offsets)
    size = end - start
    letters = data[ragged(start, size)]
    upto = np.concatenate([[0], np.cumsum(size)])
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(upto), pa.py_buffer(letters)]).dictionary_encode().indices.to_numpy()
    count = np.diff(at)
    run, stop, period = runs_of(words.astype(np.int64), np.repeat(at[:-1], count), least)
    # words that a run repeats
    covered = np.zeros(len(size) + 1, np.int64)
    np.add.at(covered, run + period, 1)
    np.add.at(covered, stop, -1)
    kept = np.cumsum(covered[:-1]) == 0
    # the words that stay, each with a space behind it, but for the last of a text
    long = size[kept]
    ends = np.cumsum(long + 1)
    joined = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    joined[ragged(ends - long - 1, long)] = letters[np.repeat(kept, size)]
    left = np.concatenate([[0], np.cumsum(kept)])[at]
    stays = np.ones(len(joined), bool)
    stays[ends[left[1:][np.diff(left) > 0] - 1] - 1] = False
    whole = np.concatenate([[0], np.cumsum(stays)])[np.concatenate([[0], ends])[left]]
    collapsed = pa.Array.from_buffers(pa.large_utf8(), len(count), [None, pa.py_buffer(whole), pa.py_buffer(joined[stays])])
    cut = np.searchsorted(run, at)
    text = np.repeat(np.arange(len(count)), np.diff(cut))
    fields = [pa.array(x) for x in (run - at[:-1][text], stop - run, period)]
    runs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return [pa.array(count), runs, collapsed.cast(pa.utf8())]


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """docs with n_words, runs (start and length in words, period; by start, then period) and collapsed: the words that no
    run repeats after its first period, joined by spaces. Runs have least words and two periods at least."""
    mine = [f.split()[0] for f in ("n_words", "runs", "collapsed")]
    others = [c for c in docs.columns if c.lower() not in mine]
    rows = docs.select(*[quoted(c) for c in others])
    names = [*others, *mine]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, TEXT):
            yield pa.RecordBatch.from_arrays([*batch.columns, *found_in(batch["text"], least)], names)

    return rows.mapInArrow(run, StructType([*rows.schema, *StructType.fromDDL(RUNS)]))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs, where each text whose crc32(doc_id) ends in 0 has a period: with g the crc32 without its last digit and n words,
    words from a = g % n on repeat the first 1 + (n - a) / (3 + g % 8) of them. A null doc_id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words: Column = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    held = docs.withColumns({"planted_words": F.when(h % 10 == 0, words), "planted_g": g})
    n, g = F.size("planted_words"), F.col("planted_g")
    a = F.expr("cast(planted_g % size(planted_words) as int)")
    p = F.expr("cast(1 + (size(planted_words) - planted_g % size(planted_words)) div (3 + planted_g % 8) as int)")
    held = held.withColumns({"planted_a": F.when(n > 0, a), "planted_p": F.when(n > 0, p)})
    source = lambda i: F.when(i >= F.col("planted_a"), F.col("planted_a") + (i - F.col("planted_a")) % F.col("planted_p")).otherwise(i)
    text = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("planted_words", source(i))), " ")).otherwise(F.col("text"))
    return held.withColumn("text", text).select(*[quoted(c) for c in docs.columns])
