"""Collocations: phrases whose words keep together more often than their parts would.

Words are counted, and the frequent ones get numbers by which texts become streams of numbers, 0 where nothing goes on. Then
each level of length draws up its candidates: phrases are summed by hash in a table of fixed size, and only those go on to
the next level whose two parts of one word less reach the least count there. A bucket holds the sum of all its phrases, so
it never tells too little, and no frequent phrase is lost. The phrases of full buckets are the candidates.

Candidates are counted by double-array tries of at most PHRASES each. A trie is broadcast, numpy advances the states of all
places of a stream at once, word by word, the accepted states are counted with bincount, and the sums of all tasks are added
up. All counts of phrases come from the tries.

Null texts are empty, a null lang is `und`. Rows count as often as they are there, and a null doc_id as any other. Texts of
any length are cut at words alone. An empty table gives no rows. Further columns are ignored, whatever their names. Ties
are settled by the phrase.

What is broadcast: a trie with at most 5 * PHRASES states, and a table of at most 2^bits bits. The vocabulary is read in
blocks of VOCABULARY words. Beyond some 10^10 words, more bits or a higher least count keep the candidates few.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, by_bytes, give_back, mix, new_path, ragged, spans, text_bytes, written
from .sharding import with_prefix

LONGEST = 5
#: Bytes of text made into one stream.
TEXT = 4 << 20
#: Words of a block of the vocabulary, and phrases of a trie.
VOCABULARY, PHRASES = 1 << 20, 1 << 18
#: Bytes that end a piece of text, and those between words.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
#: Sums go through the shuffle in ranges of 2^RANGE keys, once a task holds KEYS of them.
RANGE, KEYS = 15, 1 << 22
PACKED = "part long, at binary, n binary"
PLACES = [f"w{k}" for k in range(1, LONGEST + 1)]

_BLOCK: dict[str, dict[str, tuple[pa.Array, np.ndarray]]] = {}


def words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """Of each word the code of its language and of itself, with what the codes stand for, and whether a piece begins."""
    data, offsets = text_bytes(batch["text"])
    start, end, at = spans(data, offsets, GAP)
    size = end - start
    upto = np.concatenate([[0], np.cumsum(size)])
    letters = LOWER[data[ragged(start, size)]]
    words = pa.Array.from_buffers(pa.large_utf8(), len(size), [None, pa.py_buffer(upto), pa.py_buffer(letters)]).dictionary_encode()
    count = np.diff(at)
    piece = np.cumsum(BREAK[data])[start] if len(start) else start
    text = np.repeat(np.arange(len(count)), count)
    begins = np.ones(len(size), bool)
    begins[1:] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
    langs = batch["lang"].dictionary_encode()
    return langs.indices.to_numpy()[text], langs.dictionary, words.indices.to_numpy(), words.dictionary, begins


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, TEXT):
            lang, langs, word, words, _ = words_of(batch)
            keys, n = np.unique(lang.astype(np.int64) * len(words) + word, return_counts=True)
            if len(keys):
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(keys // len(words))), words.take(pa.array(keys % len(words))).cast(pa.utf8()), pa.array(n)], ["lang", "word", "f"])
            give_back()

    return docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def block_of(path: str, k: int) -> dict[str, tuple[pa.Array, np.ndarray]]:
    """Words and numbers by language, of a block of the vocabulary; a process keeps one."""
    name = f"{path}/block={k}"
    if name not in _BLOCK:
        _BLOCK.clear()
        system, at = fs.FileSystem.from_uri(name)
        table = pq.read_table(at, filesystem=system, partitioning=None).combine_chunks()
        langs = table["lang"].combine_chunks()
        each = {x: table.filter(pc.equal(langs, x)) for x in pc.unique(langs).to_pylist()}
        _BLOCK[name] = {x: (t["word"].combine_chunks().cast(pa.large_utf8()), t["id"].to_numpy().astype(np.int32)) for x, t in each.items()}
    return _BLOCK[name]


def streams(docs: DataFrame, path: str, blocks: int) -> DataFrame:
    """ids: 32-bit numbers of words in the order of the texts, 0 between pieces and in place of rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, TEXT):
            lang, langs, word, words, begins = words_of(batch)
            ids = np.zeros(len(word), np.int32)
            for code, name in enumerate(langs.to_pylist()):
                mine, known = lang == code, np.zeros(len(words), np.int32)
                for k in range(blocks):
                    if held := block_of(path, k).get(name):
                        at = pc.index_in(words, value_set=held[0]).fill_null(-1).to_numpy()
                        known[at >= 0] = held[1][at[at >= 0]]
                ids[mine] = known[word[mine]]
            out = np.zeros(len(ids) + int(begins.sum()) + 1, np.int32)
            out[np.arange(len(ids)) + np.cumsum(begins)] = ids
            # a number between zeros is in no phrase
            before, after = np.append(0, out[:-1]), np.append(out[1:], 0)
            out[(before == 0) & (after == 0)] = 0
            out = out[(out > 0) | (np.append(0, out[:-1]) > 0)]
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["ids"])
            give_back()

    return docs.mapInArrow(run, "ids binary")


def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for row in batch["ids"]:
            yield np.frombuffer(row.as_buffer(), np.int32)
            give_back()


def hashes(ids: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the phrases of 1, 2, .. words at each place."""
    word = mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    found = word
    yield found
    for m in range(1, LONGEST):
        found = mix(found[:-1] * np.uint64(0xD1342543DE82EF95) + word[m:])
        yield found


def full(bucket: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    return (bitmap[bucket >> np.uint64(3)] >> (bucket & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def alive(ids: np.ndarray, bitmaps: list[np.ndarray], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 2, 3, .. words, the places of phrases whose parts are in full buckets of bitmaps, and the buckets; one level more
    than there are bitmaps."""
    shift, at = np.uint64(64 - bits), np.flatnonzero(ids)
    for m, found in enumerate(hashes(ids), 1):
        if m == 1:
            continue
        if m > 2:
            at = at[full(bucket, bitmaps[m - 3])]  # noqa: F821  of the level before
        held = np.zeros(len(ids) + 1, bool)
        held[at] = True
        at = at[held[at + 1]]
        at = at[at < len(found)]
        bucket = found[at] >> shift
        yield at, found[at]
        if m == len(bitmaps) + 2:
            return


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and the sums of their counts."""
    keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def packed(counts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Keys and counts, summed up by about KEYS, as a row for each RANGE keys: places in it (16 bits) and counts (32 bits)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def rows() -> Iterator[pa.RecordBatch]:
        keys, n = held[0]
        part = keys >> RANGE
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)]
        at, n = (keys & (1 << RANGE) - 1).astype(np.uint16), n.astype(np.int32)
        pieces = list(zip(cut[:-1], cut[1:], strict=True)) if len(keys) else []
        yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]] if pieces else part), pa.array([at[i:j].tobytes() for i, j in pieces], pa.binary()), pa.array([n[i:j].tobytes() for i, j in pieces], pa.binary())], ["part", "at", "n"])

    for x in counts:
        held.append(x)
        if sum(len(k) for k, _ in held) > KEYS:
            held = [merged(held)]
            if len(held[0][0]) > KEYS // 2:
                yield from rows()
                held = []
    if held:
        held = [merged(held)]
        yield from rows()


def summed(rows: DataFrame, take, schema: str) -> DataFrame:
    """take(part, sums of its keys) of all rows of packed; a task holds the rows of a few parts at a time."""

    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << RANGE, np.int64)
        for at, n in zip(table["at"], table["n"], strict=True):
            total[np.frombuffer(at.as_buffer(), np.uint16)] += np.frombuffer(n.as_buffer(), np.int32)
        return take(table["part"][0].as_py(), total)

    return rows.groupBy("part").applyInArrow(run, schema)


def full_buckets(rows: DataFrame, bitmaps: list[np.ndarray], bits: int, least: int) -> np.ndarray:
    """The bits of buckets of phrases, one word longer than the last of bitmaps, with a sum of least or more."""
    sent = rows.sparkSession.sparkContext.broadcast(bitmaps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for ids in ids_of(batches):
                *_, (_, found) = alive(ids, sent.value, bits)
                keys, n = np.unique(found >> np.uint64(64 - bits), return_counts=True)
                yield keys.astype(np.int64), n

        return packed(counts())

    def take(part: int, total: np.ndarray) -> pa.Table:
        return pa.table({"part": [part], "bits": pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())})

    size = 1 << RANGE - 3
    out = np.zeros(max(1 << bits - 3, size), np.uint8)
    for part, held in summed(rows.mapInArrow(run, PACKED), take, "part long, bits binary").collect():  # 2^bits bits in all
        out[part * size : (part + 1) * size] = np.frombuffer(held, np.uint8)
    sent.unpersist()
    return out


def different(rows: np.ndarray) -> np.ndarray:
    """The different ones of rows of 32-bit numbers."""
    rows = np.ascontiguousarray(rows)
    return np.unique(rows.view(f"V{rows.strides[0]}").ravel()).view(np.int32).reshape(-1, rows.shape[1])


def candidates(rows: DataFrame, bitmaps: list[np.ndarray], bits: int) -> DataFrame:
    """The phrases in full buckets, each once: w1 to w5, 0 behind the last word. A task sends what it has found in a row for
    each range of buckets."""
    sent = rows.sparkSession.sparkContext.broadcast(bitmaps)

    def found_in(ids: np.ndarray) -> Iterator[np.ndarray]:
        for m, (at, found) in enumerate(alive(ids, sent.value[:-1], bits), 2):
            kept = full(found >> np.uint64(64 - bits), sent.value[m - 2])
            at, found = at[kept], found[kept]
            found, first, which = np.unique(found, return_index=True, return_inverse=True)
            # of phrases with one hash and other words, all places are taken
            other = np.zeros(len(at), bool)
            for k in range(m):
                other |= ids[at + k] != ids[at[first[which]] + k]
            part = (np.concatenate([found, found[which[other]]]) >> np.uint64(64 - bits + RANGE)).astype(np.int32)
            at = np.concatenate([at[first], at[other]])
            yield np.stack([part, *[ids[at + k] if k < m else np.zeros(len(at), np.int32) for k in range(LONGEST)]], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((0, 1 + LONGEST), np.int32)]
        for ids in ids_of(batches):
            held += found_in(ids)
            if sum(map(len, held)) > KEYS // 4:
                held = [different(np.concatenate(held))]
        held = different(np.concatenate(held))
        if len(held):
            cut = [0, *(np.flatnonzero(np.diff(held[:, 0])) + 1).tolist(), len(held)]
            yield pa.RecordBatch.from_arrays([pa.array(held[cut[:-1], 0].astype(np.int64)), pa.array([held[i:j, 1:].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["part", "phrases"])

    def gather(table: pa.Table) -> pa.Table:
        every = different(np.concatenate([np.frombuffer(x.as_buffer(), np.int32).reshape(-1, LONGEST) for x in table["phrases"]]))
        return pa.table({w: every[:, k] for k, w in enumerate(PLACES)})

    return rows.mapInArrow(run, "part long, phrases binary").groupBy("part").applyInArrow(gather, ", ".join(f"{w} int" for w in PLACES))


class Trie:
    """A double array: from state s by word w to base[s] + w, if check there is s. phrases: sorted rows of numbers, 0 behind
    the last word. accepts: of each state the row that ends there, or -1."""

    def __init__(self, phrases: np.ndarray):
        self.words = np.unique(phrases[phrases > 0])
        rows = np.where(phrases > 0, np.searchsorted(self.words, phrases) + 1, 0)
        parents, symbols, ends = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.full(1, -1)]
        node, count = np.zeros(len(rows), np.int64), 1
        for k in range(rows.shape[1]):
            at = np.flatnonzero(rows[:, k])
            parent, symbol = node[at], rows[at, k]
            new = np.ones(len(at), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (symbol[1:] != symbol[:-1])
            node[at] = count + np.cumsum(new) - 1
            ended = np.full(int(new.sum()), -1)
            last = at[rows[at, k + 1] == 0] if k + 1 < rows.shape[1] else at
            ended[node[last] - count] = last
            parents.append(parent[new])
            symbols.append(symbol[new])
            ends.append(ended)
            count += len(ended)
        self._place(*map(np.concatenate, (parents, symbols, ends)))

    def _place(self, parent: np.ndarray, symbol: np.ndarray, ended: np.ndarray) -> None:
        count = len(parent)
        order = np.argsort(parent[1:], kind="stable") + 1
        begins = np.flatnonzero(np.diff(parent[order], prepend=-1))
        sizes = np.diff(np.append(begins, count - 1))
        base, slot = np.zeros(count, np.int64), np.zeros(count, np.int64)
        room = len(self.words) + 1
        used = np.zeros(2 * (count + room), bool)
        used[0] = True
        top, free, seen = 1, np.zeros(0, np.int64), 0
        # the root stands first, then those with many children
        for g in sorted(np.flatnonzero((sizes > 1) | (parent[order[begins]] == 0)).tolist(), key=lambda g: (parent[order[begins[g]]] > 0, -sizes[g])):
            children = order[begins[g] : begins[g] + sizes[g]]
            own = symbol[children]
            if parent[children[0]] == 0:
                at = 0
            else:
                if seen % 256 == 0:
                    free = np.flatnonzero(~used[:top])
                seen += 1
                # spots from all over the array, as the first free ones are mostly single holes
                step = max(1, len(free) * len(own) >> 12)
                spots = free[seen % step :: step] - own[0]
                fits = ~used[spots[:, None] + own].any(1) if len(spots) else np.zeros(0, bool)
                at = spots[np.argmax(fits)] if fits.any() else top - own[0]
            slot[children] = at + own
            base[parent[children[0]]] = at
            used[slot[children]] = True
            top = max(top, int(slot[children].max()) + 1)
            if top + room > len(used):
                used = np.append(used, np.zeros(len(used), bool))
        single = order[begins[(sizes == 1) & (parent[order[begins]] > 0)]]
        spots = np.flatnonzero(~used[: top + len(single)])[: len(single)]
        slot[single] = spots
        base[parent[single]] = spots - symbol[single]
        size = int(slot.max()) + 1
        self.base, self.check, self.accepts = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.base[slot] = base
        self.check[slot[1:]] = slot[parent[1:]]
        self.accepts[slot] = ended

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        """The trie's own numbers of words, 0 for those that it doesn't have."""
        at = np.minimum(np.searchsorted(self.words, ids), len(self.words) - 1)
        return np.where(self.words[at] == ids, at + 1, 0)

    def count(self, ids: np.ndarray) -> np.ndarray:
        """How often each state is reached, over all places of ids."""
        words = np.append(self.symbols(ids), np.zeros(LONGEST, np.int32)).astype(np.int32)
        at, total = np.flatnonzero(words).astype(np.int32), np.zeros(len(self.base), np.int64)
        state = np.zeros(len(at), np.int32)
        for k in range(LONGEST):
            word = words[at + k]
            to = self.base[state] + word
            goes = (word > 0) & (to >= 0) & (to < len(self.check))
            at, state, to = at[goes], state[goes], to[goes]
            goes = self.check[to] == state
            at, state = at[goes], to[goes]
            total += np.bincount(state, minlength=len(total))
        return total


def counted(rows: DataFrame, phrases: np.ndarray, first: int, least: int) -> DataFrame:
    """ordinal (from first) and f of sorted phrases that occur least times or more."""
    sent = rows.sparkSession.sparkContext.broadcast(Trie(phrases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, total = sent.value, 0
        for ids in ids_of(batches):
            total = total + trie.count(ids)
        if isinstance(total, np.ndarray):
            at = np.flatnonzero((trie.accepts >= 0) & (total > 0))
            yield from packed(iter([(trie.accepts[at].astype(np.int64), total[at])]))

    def take(part: int, total: np.ndarray) -> pa.Table:
        at = np.flatnonzero(total >= least)
        return pa.table({"ordinal": at + (part << RANGE) + first, "f": total[at]})

    return summed(rows.mapInArrow(run, PACKED), take, "ordinal long, f long")


def phrase_counts(rows: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """words (an array of numbers) and f of the candidates of found that occur least times or more."""
    found = written(with_prefix(found.withColumn("one", F.lit(1).cast("long")), PLACES, {"ordinal": "one"}).drop("one"), "candidates")
    size, total, sums = PHRASES, found.count(), []
    for first in range(0, total, size):
        block = found.where((F.col("ordinal") >= first) & (F.col("ordinal") < first + size)).orderBy("ordinal").toArrow()
        sums.append(written(counted(rows, np.stack([block[w].to_numpy() for w in PLACES], axis=1), first, least), "counts"))
    if not sums:
        return found.select(F.array(*PLACES).alias("words"), F.lit(0).cast("long").alias("f")).limit(0)
    held = found.join(reduce(DataFrame.union, sums), "ordinal")
    return held.select(F.filter(F.array(*PLACES), lambda w: w > 0).alias("words"), "f")


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """phrases (words, f) of two words or more with lang, a, n and the cut of the least score: l, r, score. words: id, lang, f, n."""
    known = phrases.union(words.select(F.array("id").alias("words"), "f"))
    m = F.size("words")
    cuts = phrases.select("words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("slice(words, 1, k)"), "right": F.expr("slice(words, k + 1, size(words) - k)")})
    side = lambda name, count: known.select(F.col("words").alias(name), F.col("f").alias(count))
    cuts = cuts.join(side("left", "l"), "left").join(side("right", "r"), "right")
    cuts = cuts.withColumn("id", F.get("words", F.lit(0))).join(words.select("id", "lang", "n"), "id")
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products of three fit in 38 digits
    cuts = cuts.withColumns({"up": wide("a") * wide("n") * F.lit(1000).cast("decimal(19,0)"), "down": wide("l") * wide("r")})
    best = F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("words", "a", "lang", "n").agg(best).select("words", "lang", "a", "best.l", "best.r", "n", "best.score")


def whole(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """found without phrases that stand in a longer one of phrases as often as by themselves."""
    inner = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))")
    longer = phrases.where(F.size("words") > 2).select(F.explode(inner).alias("words"), F.col("f").alias("outer"))
    longer = longer.groupBy("words").agg(F.max("outer").alias("outer"))
    return found.join(longer, "words", "left").where("outer is null or outer < a").drop("outer")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, bits: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language by score."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    every = written(word_counts(docs), "words")
    sums = every.groupBy("lang").agg(F.sum("f").alias("n"))
    common = every.where(F.col("f") >= least).withColumn("one", F.lit(1).cast("long"))
    common = with_prefix(common, ["lang", "word"], {"before": "one"})
    common = written(common.join(sums, "lang").select("lang", "word", "f", "n", (F.col("before") + 1).cast("int").alias("id")), "common")
    known, heard = common.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    path, block = new_path(docs.sparkSession, "vocabulary"), F.expr(f"cast((id - 1) div {VOCABULARY} as int)")
    common.select("lang", "word", "id", block.alias("block")).repartition("block").write.partitionBy("block").parquet(path)
    rows = written(streams(docs, path, -(-known // VOCABULARY)), "streams")
    bits = bits or min(28, max(16, (heard // 4).bit_length()))
    bitmaps: list[np.ndarray] = []
    for _ in range(2, LONGEST + 1):
        bitmaps.append(full_buckets(rows, bitmaps, bits, least))
    phrases = written(phrase_counts(rows, candidates(rows, bitmaps, bits), least), "phrases")
    found = written(whole(scored(phrases, common), phrases), "scored")
    each = found.select("words", F.posexplode("words").alias("place", "id")).join(common.select("id", "word"), "id")
    spelt = each.groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.join(spelt, "words").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
