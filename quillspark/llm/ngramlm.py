"""Language-model scores from log-frequency Bloom filters of word n-grams.

Tokens are words and one end per text. The probability of a token after two others leans on that after one, and that on the
unigram's, which mixes the token's share of the corpus (0.7) with its spelling: bytes in lower case after one another, the
end of a text being the empty word.

Counts of word bigrams and trigrams are held by log-frequency Bloom filters: an n-gram is entered once for each level up
to that of its count, levels beginning at the half powers of two, rounded up, and probed level by level. A filter that grows with the corpus can't
be broadcast whole, so there is one for each part of the n-grams' hashes. The number of parts grows with the corpus, so
each stays bounded, and levels are as fine for any size. Each group of texts sends its different n-grams to their parts
with how often it trains them, and gets back the levels that the part's filter holds; unigrams get exact counts the same
way, as the base asks for them. Of a level the least count stands for the n-gram and the greatest for a context, so the
probabilities of all tokens after a context add up to 1 at most: what quantising takes is lost, never more given out
than there is (but for false hits of a filter, 1 in 100 or less). Only the counts of pairs of bytes, 2^16 numbers, go
to all tasks.

Null and empty texts have the end token alone. A null doc_id counts as held out, as its text is empty.
Repeated rows are scored each, and count as often as they occur. A text of any length is one row of its group. An empty
table gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, SPACE, buckets, dealt, give_back, hash_words, mix, ragged, spans, text_bytes

_U = np.uint64
#: Bytes of text that a task gathers into one group of postings, and documents in it at most.
GROUP, DOCS = 6 << 20, 65_000
#: Stands for both ends of a word; no word holds it.
WORD_END = 0x20
#: Bytes of words in lower case, and their end.
SYMBOLS = 256 - int(SPACE.sum()) - 26 + 1


def spelling(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of bytes of each word between its ends, as (b1 << 8 | b2), and where each word's begin."""
    at = np.concatenate([[0], np.cumsum(end - start + 1)])
    b = np.full(int(at[-1]) + 1, WORD_END, np.int64)
    inside = np.ones(len(b), bool)
    inside[at] = False
    b[inside] = LOWER[data[ragged(start, end - start)]]
    return b[:-1] << 8 | b[1:], at


def log_spelling(pairs: np.ndarray) -> np.ndarray:
    """log10 of the probability of each byte after another, from the counts of pairs; each counts once more."""
    table = pairs.reshape(256, 256)
    return np.log10((table + 1.0) / (table.sum(1, keepdims=True) + SYMBOLS)).ravel()


#: The least and the greatest count of each level: 1, 2, 3, 4, 6, 8, 12, 16 .. and what is below the next; 0 for level 0.
LEAST = np.concatenate([[0.0], np.unique(np.ceil(2 ** (np.arange(125) / 2) - 1e-9))])
GREATEST = np.append(LEAST[1:] - 1, np.inf)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEAST, counts, "right") - 1


class CountFilter:
    """n-grams with the levels of their counts, each entered once for every level up to its own."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, per_entry: int = 10, hashes: int = 6):
        levels = levels_of(counts)
        self.hashes, self.top = hashes, int(levels.max(initial=0))
        self.mask = _U((1 << max(6, (int(levels.sum()) * per_entry - 1).bit_length())) - 1)
        bits = np.zeros(int(self.mask) + 1, bool)
        for level in range(1, self.top + 1):
            keys, levels = keys[levels >= level], levels[levels >= level]
            for at in self._bits(keys, level):
                bits[at] = True
        self.data = np.packbits(bits, bitorder="little")

    def _bits(self, keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
        at, step = self._start(keys, level)
        for _ in range(self.hashes):
            yield at & self.mask
            at = at + step

    @staticmethod
    def _start(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        one = mix(keys.astype(np.uint64) * _U(128) + _U(level))
        return one, one >> _U(32) | _U(1)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level for which all probes hit, from the first on; 0 if that misses."""
        level = np.zeros(len(keys), np.int64)
        here = np.arange(len(keys))
        for j in range(1, self.top + 1):
            at, step = self._start(keys[here], j)
            for _ in range(self.hashes):  # what misses is probed no further
                bit = at & self.mask
                hit = (self.data[bit >> _U(3)] >> (bit & _U(7)).astype(np.uint8) & 1).astype(bool)
                if not hit.all():
                    here, at, step = here[hit], at[hit], step[hit]
                at = at + step
            level[here] = j
            if not len(here):
                break
        return level


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """doc_ids, bytes and offsets of groups of rows of about GROUP bytes."""
    held, size, rows = [], 0, 0

    def flush() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        return t["doc_id"], *text_bytes(t["text"])

    for batch in batches:
        for i in range(0, len(batch), 2000):
            part = batch[i : i + 2000]
            held.append(part)
            rows += len(part)
            size += part["text"].nbytes
            if size >= GROUP or rows >= DOCS - 2000:
                yield flush()
                held, size, rows = [], 0, 0
    if held:
        yield flush()


def in_training(doc_ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0 for i in doc_ids.to_pylist()], bool)


def packed(bucket: np.ndarray, n: int, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each bucket, by their order in columns."""
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(n + 1))
    for b, (i, j) in enumerate(pairwise(at.tolist())):
        if j > i:
            yield b, [c[order[i:j]] for c in columns]


def blob(x: np.ndarray) -> bytes:
    return x.tobytes()


def small(data: bytes) -> bytes:
    """Compressed, after its size."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True) if data else b""


def large(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True) if data else b""


def corpus_counts(docs: DataFrame) -> dict:
    """Of the training rows: tokens, different tokens, texts, and the counts of pairs of bytes."""
    n = 2 * buckets(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, tokens, texts = np.zeros(1 << 16, np.int64), 0, 0
        for ids, data, offsets in grouped(batches):
            use = in_training(ids)
            start, end, upto = spans(data, offsets)
            mine = np.repeat(use, np.diff(upto))
            start, end = start[mine], end[mine]
            hashes, which, times = np.unique(hash_words(data, start, end), return_inverse=True, return_counts=True)
            one = np.zeros(len(hashes), np.int64)
            one[which] = np.arange(len(which))
            found, at = spelling(data, start[one], end[one])
            pairs += np.bincount(found, np.repeat(times, np.diff(at)), 1 << 16).astype(np.int64)
            tokens, texts = tokens + len(start) + int(use.sum()), texts + int(use.sum())
            yield table([(b, blob(h), 0, 0) for b, (h,) in packed((hashes % _U(n)).astype(np.int64), n, [hashes])], MERGED)
        yield table([(-1, small(blob(pairs)), tokens, texts)], MERGED)

    def merge(group: pa.Table) -> pa.Table:
        bucket, keys = group["bucket"][0].as_py(), group["keys"].to_pylist()
        tokens, texts = (int(sum(group[c].to_pylist())) for c in ("tokens", "texts"))
        if bucket >= 0:
            seen = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in keys]))
            return pa.Table.from_batches([table([(bucket, b"", len(seen), 0)], MERGED)])
        return pa.Table.from_batches([table([(bucket, blob(sum(np.frombuffer(large(x), np.int64) for x in keys)), tokens, texts)], MERGED)])

    rows = docs.select("doc_id", "text").mapInArrow(count, MERGED).groupBy("bucket").applyInArrow(merge, MERGED).collect()
    whole = next((r for r in rows if r["bucket"] < 0), None)
    if whole is None:
        return {"tokens": 0, "texts": 0, "types": 0, "pairs": np.zeros(1 << 16, np.int64)}
    pairs = np.frombuffer(whole["keys"], np.int64).copy()
    pairs[WORD_END << 8 | WORD_END] += whole["texts"]
    return {"tokens": whole["tokens"], "texts": whole["texts"], "types": sum(r["tokens"] for r in rows if r["bucket"] >= 0) + (whole["texts"] > 0), "pairs": pairs}


MERGED = "bucket int, keys binary, tokens long, texts long"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}


def table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


ASKED = "deal int, source long, kind int, keys binary, trained binary"
ANSWERS = "source long, bucket int, kind int, counts binary"
SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Tokens of the corpus for each part of the filters, so that parts stay small and their number grows.
PART = 1_500_000
#: Stand for the begin and the end of a text among the hashes of words; kinds of n-grams.
BEGIN, END = _U(0x6C62272E07BB0142), _U(0x62B821756295C58D)
WORD, PAIR, TRIPLE = 1, 2, 3


class Tokens:
    """The words of a group of texts, each text between BEGIN and END, and hashes of the n-grams that end at each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.start, self.end, upto = spans(data, offsets)
        sizes = np.diff(upto) + 2
        at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.first, self.last = at[:-1], at[1:] - 1
        self.is_word = np.ones(len(self.row), bool)
        self.is_word[self.first] = self.is_word[self.last] = False
        own = np.empty(len(self.row), np.uint64)
        own[self.is_word] = hash_words(data, self.start, self.end)
        own[self.first], own[self.last] = BEGIN, END
        self.has_pair = np.ones(len(self.row), bool)
        self.has_pair[self.first] = False
        self.has_triple = self.has_pair.copy()
        self.has_triple[self.first + 1] = False
        spread, pair, triple = mix(own), np.zeros_like(own), np.zeros_like(own)
        pair[1:] = mix(own[:-1] * _U(0x9E3779B97F4A7C15) + spread[1:])
        triple[1:] = mix(pair[:-1] * _U(0xD6E8FEB86659FD93) + spread[1:])
        self.grams = [(WORD, self.is_word, own), (PAIR, self.has_pair, pair), (TRIPLE, self.has_triple, triple)]

    def keys(self, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each kind where n-grams end, the different ones, their parts, and which is which.

        Words have 64 bits. Of the others a part tells 32 bits: as parts are bounded by PART, fewer strange n-grams
        agree with one in the filter by these than by its probes.
        """
        for kind, here, hashes in self.grams:
            own = hashes[here]
            keys, which = np.unique(own if kind == WORD else own % _U(n) << _U(32) | own >> _U(32), return_inverse=True)
            yield kind, here, keys, (keys % _U(n) if kind == WORD else keys >> _U(32)).astype(np.int64), which


def gaps(keys: np.ndarray) -> bytes:
    """The low 32 bits of sorted keys as gaps, the bytes of equal weight side by side, which compress to less."""
    return np.diff(keys.astype(np.uint32), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def from_gaps(data: bytes) -> np.ndarray:
    planes = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T)
    return np.cumsum(planes.view(np.uint32).ravel(), dtype=np.uint32)


def after(count: np.ndarray, context: np.ndarray, less: np.ndarray, weight: float) -> np.ndarray:
    """The probability after a context, leaning on that of the shorter context with weight."""
    return (np.minimum(count, context) + weight * less) / (context + weight)


def scores(docs: DataFrame, share: float = 0.7, weight: float = 4.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. share: that of the corpus in the
    unigrams; weight: how much the probability after two words leans on that after one, and that on the unigram's."""
    spark = docs.sparkSession
    found = corpus_counts(docs)
    spelled = log_spelling(found["pairs"])
    tokens, texts = found["tokens"], found["texts"]
    whole = tokens + 0.1 * (found["types"] + 1)
    n = max(buckets(spark), tokens // PART)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        source = TaskContext.get().partitionId() << 24
        for ids, data, offsets in grouped(batches):
            t, use = Tokens(data, offsets), in_training(ids)
            out = [(-1 - dealt(source, n), source, 0, small(blob(data)), small(blob(offsets))), (-1 - dealt(source, n), source, -1, blob(np.array(ids.fill_null(0).to_pylist(), np.int64)), blob(np.array(ids.is_null())))]
            for kind, here, keys, part, which in t.keys(n):
                trained = np.bincount(which, use[t.row[here]], len(keys)).astype(np.uint32)
                out += [(b, source, kind, small(blob(k) if kind == WORD else gaps(k)), small(blob(c))) for b, (k, c) in packed(part, n, [keys, trained])]
            yield table(out, ASKED)
            source += 1
            del t, out
            give_back()

    def meet(group: pa.Table) -> pa.Table:
        deal, source, kind, keys, trained = (group[c].to_pylist() for c in ("deal", "source", "kind", "keys", "trained"))
        if deal[0] < 0:
            rows = [(s, b, k, x) for s, k, *both in zip(source, kind, keys, trained, strict=True) for b, x in zip((-2, -1), both, strict=True)]
            return pa.Table.from_batches([table(rows, ANSWERS)])
        out = []
        for own in sorted({*kind}):
            mine = [i for i, k in enumerate(kind) if k == own]
            asked = [np.frombuffer(large(keys[i]), np.uint64) if own == WORD else from_gaps(large(keys[i])) for i in mine]
            different, which = np.unique(np.concatenate(asked), return_inverse=True)
            counts = np.bincount(which, np.concatenate([np.frombuffer(large(trained[i]), np.uint32) for i in mine]), len(different)).astype(np.int64)
            if own != WORD:
                seen = counts > 0
                counts = CountFilter(different[seen], counts[seen]).levels(different).astype(np.uint8)
            answers = np.split(counts[which], np.cumsum([len(a) for a in asked])[:-1])
            out += [(source[i], deal[i], own, small(blob(a))) for i, a in zip(mine, answers, strict=True)]
            del asked, different, which, counts, answers
            give_back()
        return pa.Table.from_batches([table(out, ANSWERS)])

    end_base = np.log10(texts + 0.1)
    end_unigram = float(share * texts / max(tokens, 1) + (1 - share) * 10 ** spelled[WORD_END << 8 | WORD_END])

    def finish(group: pa.Table) -> pa.Table:
        cells = {(k, b): x for b, k, x in zip(*(group[c].to_pylist() for c in ("bucket", "kind", "counts")), strict=True)}
        data, offsets = np.frombuffer(large(cells[0, -2]), np.uint8), np.frombuffer(large(cells[0, -1]), np.int64)
        ids, nulls = np.frombuffer(cells[-1, -2], np.int64), np.frombuffer(cells[-1, -1], bool)
        t, held = Tokens(data, offsets), {}
        for kind, here, keys, part, which in t.keys(n):
            order = np.argsort(part, kind="stable")
            answers = [np.frombuffer(large(cells[kind, b]), np.int64 if kind == WORD else np.uint8) for b in range(n) if (kind, b) in cells]
            of_keys = np.empty(len(keys), np.int64 if kind == WORD else np.uint8)
            of_keys[order] = np.concatenate([of_keys[:0], *answers])
            held[kind] = np.zeros(len(t.row), of_keys.dtype)
            held[kind][here] = of_keys[which]
            if kind == WORD:
                one = np.zeros(len(keys), np.int64)
                one[which] = np.arange(len(which))
                pairs, at = spelling(data, t.start[one], t.end[one])
                spelt = np.add.reduceat(spelled[pairs], at[:-1])[which] if len(keys) else np.zeros(0)
        rows, mine, known = len(ids), t.row[t.is_word], held[WORD][t.is_word]
        count = np.bincount(mine, minlength=rows) + 1
        base = np.bincount(mine, np.log10(known + 0.1), rows) + end_base - count * np.log10(whole)
        p = np.full(len(t.row), end_unigram)
        p[t.is_word] = share * known / max(tokens, 1) + (1 - share) * 10**spelt
        context = held[WORD]
        context[t.first] = context[t.last] = texts
        p[1:] = np.where(t.has_pair[1:], after(LEAST[held[PAIR][1:]], context[:-1], p[1:], weight), p[1:])
        p[1:] = np.where(t.has_triple[1:], after(LEAST[held[TRIPLE][1:]], GREATEST[held[PAIR][:-1]], p[1:], weight), p[1:])
        score = np.bincount(t.row[t.has_pair], np.log10(p[t.has_pair]), rows)
        seen = np.bincount(mine, known > 0, rows) + (texts > 0)
        return pa.table([pa.array(ids, mask=nulls), pa.array(count.astype(np.int64)), pa.array(seen.astype(np.int64)), pa.array(np.full(rows, tokens, np.int64)), pa.array(base), pa.array(score)], names=[f.split()[0] for f in SCORES.split(", ")])

    answers = docs.select("doc_id", "text").mapInArrow(ask, ASKED).groupBy("deal").applyInArrow(meet, ANSWERS)
    found_scores = answers.groupBy("source").applyInArrow(finish, SCORES)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return found_scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
