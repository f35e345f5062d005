"""Byte-level BPE over whole batches of texts, as a bounded-lookahead transducer.

Texts are split into pieces by the pattern of the vocabulary, on arrays of code points. The merges' sufficient
lookahead is computed from their list. A token is emitted as soon as that many bytes after its end have been seen, or
its piece has ended. Transducers of the pieces that fit the lookahead run side by side over arrays (`Merges.merged`);
longer ones have one of their own that holds a window (`Transducer`). A corpus repeats its pieces, so what came out
for a piece is kept by its hash for as long as the process lives.

A text that is longer than a block is read as a stream: a block ends where the split into pieces can't change
whatever follows. Memory is bounded by the block, not by the text.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .shared import prefix_hash, ragged, span_hash

LETTER, NUMBER, OTHER, WHITE = range(4)
BLOCK = 1 << 19
_U = np.uint64
_APOSTROPHE = 39


@lru_cache(1)
def classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its class in the pattern, and a random 64-bit value."""
    import regex

    kind = np.full(0x110000, OTHER, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, points))
    for mark, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for m in regex.finditer(pattern, text):
            kind[points[m.start()] : points[m.end() - 1] + 1] = mark
    kind[0xD800:0xE000] = OTHER
    return kind, np.random.default_rng(3).integers(1, 2**64, 0x110000, dtype=np.uint64)


def piece_starts(points: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where pieces start. texts: sorted positions at which a text starts (the first is 0).

    A run of letters, numbers or other marks is a piece, with a space before it. Of a run of white space that
    something follows, the last character stands alone, or goes with what follows if it is a space. An
    apostrophe that starts a piece takes s, t, m, d, re, ve or ll with it.
    """
    n = len(points)
    kind = classes()[0][points]
    first = np.zeros(n + 1, bool)
    first[texts[texts < n]] = True
    first[n] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(start[1:n] & ~first[1:n] & (kind[1:] != WHITE) & (kind[:-1] == WHITE)) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    quote = np.flatnonzero(points == _APOSTROPHE)
    if len(quote):
        at = lambda i: np.where(i < n, points[np.minimum(i, n - 1)], 0)
        quote = quote[start[quote] & ~first[quote + 1]]
        one, two = at(quote + 1), at(quote + 2)
        whole = ~first[np.minimum(quote + 2, n)]
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = whole & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")])
        for which, size in ((short, 1), (long & ~short, 2)):
            q = quote[which]
            start[q + 1] = False
            nxt = q + 1 + size
            nxt = nxt[nxt < n]
            start[nxt[kind[nxt] == LETTER]] = True
    return np.flatnonzero(start[:n])


class Merges:
    """The vocabulary and the merges of a byte-level BPE file, and what they make of pieces."""

    def __init__(self, path: str):
        with open(path) as f:
            read = json.load(f)
        vocabulary, added = read["model"]["vocab"], read["added_tokens"]
        self.special = {t["content"]: t["id"] for t in added}
        back = byte_of_symbol()
        self.size = max([*vocabulary.values(), *self.special.values()]) + 1
        names = [""] * self.size
        for name, i in vocabulary.items():
            names[i] = name
        raw = [bytes(back[c] for c in n) if n not in self.special else n.encode() for n in names]
        for name, i in self.special.items():
            raw[i] = name.encode()
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.lengths = np.diff(self.offsets)
        self.of_byte = np.zeros(256, np.int64)
        for symbol, byte in back.items():
            self.of_byte[byte] = vocabulary[symbol]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in read["model"]["merges"]]
        self.lookahead = sufficient_lookahead(pairs)
        left, right, made = (np.array([vocabulary[x] for x in column], np.int64) for column in (*zip(*pairs, strict=True), [u + v for u, v in pairs]))
        rank = np.arange(len(pairs))
        born = np.full(self.size, -1)
        born[made] = rank
        # a list as it is learned: each token has one merge, which follows those of its halves
        self.ordered = len(np.unique(made)) == len(made) and bool((np.maximum(born[left], born[right]) < rank).all())
        key = left * self.size + right
        order = np.argsort(key)
        self.keys, self.ranks, self.made = key[order], rank[order], made

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place in the list of the merge of each pair; the list's length where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.made))

    def merged(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of pieces that stand one after the other, and how many each has.

        All pieces go in step: in each one the earliest merge of the list that it allows is made, from the left,
        until no piece allows any.
        """
        none = len(self.made)
        counts = np.zeros(len(sizes), np.int64)
        symbols, owner = self.of_byte[data], np.repeat(np.arange(len(sizes)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), none)
            rank[:-1] = np.where(owner[1:] == owner[:-1], self.rank(symbols[:-1], symbols[1:]), none)
            heads = np.flatnonzero(np.diff(owner, prepend=-1))
            spans = np.diff(np.append(heads, len(owner)))
            best = np.repeat(np.minimum.reduceat(rank, heads), spans)
            over = best == none
            if over.any():
                done.append((owner[over], symbols[over]))
                symbols, owner, rank, best = symbols[~over], owner[~over], rank[~over], best[~over]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == best)
            first = np.ones(len(hit), bool)
            if self.ordered:  # of equal symbols in a row, every other pair
                first[1:] = hit[1:] != hit[:-1] + 1
                start = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            else:
                first[1:] = owner[hit[1:]] != owner[hit[:-1]]
                hit = hit[first]
            symbols[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done:
            return np.zeros(0, np.uint32), counts
        owners = np.concatenate([o for o, _ in done])
        order = np.argsort(owners, kind="stable")
        counts = np.bincount(owners, minlength=len(sizes))
        return np.concatenate([s for _, s in done])[order].astype(np.uint32), counts


class Transducer:
    """Bytes of one piece in, tokens out as soon as no further byte can change them.

    It holds no more than a window of four lookaheads: a token is stable once the sufficient lookahead has been
    seen after its end. The consecutive tokens of an encoding encode to themselves, so what is held starts where
    the last stable token ended.
    """

    def __init__(self, merges: Merges, window: int = 0):
        self.merges, self.window, self.held = merges, max(window, 4 * merges.lookahead), np.zeros(0, np.uint8)

    def feed(self, data: np.ndarray) -> Iterator[np.ndarray]:
        while len(data):
            room = max(1, self.window - len(self.held))
            self.held, data = np.concatenate([self.held, data[:room]]), data[room:]
            if len(self.held) >= self.window:
                ids, _ = self.merges.merged(self.held, np.array([len(self.held)]))
                ends = np.cumsum(self.merges.lengths[ids])
                stable = int(np.searchsorted(ends, len(self.held) - self.merges.lookahead, "right"))
                yield ids[:stable]
                self.held = self.held[ends[stable - 1] if stable else 0 :]

    def finish(self) -> np.ndarray:
        ids, _ = self.merges.merged(self.held, np.array([len(self.held)]))
        self.held = self.held[:0]
        return ids


@lru_cache(4)
def encoder(path: str) -> "Encoder":
    """The encoder of this process: a worker reads the vocabulary once, and its tasks share the pieces it knows."""
    return Encoder(path)


class Encoder:
    """ids of texts, and their bytes back."""

    def __init__(self, path: str, block: int = BLOCK, keep: int = 1 << 21):
        self.merges = Merges(path)
        self.special, self.lengths = self.merges.special, self.merges.lengths
        self.block, self.keep = block, keep
        self._clear()

    def _clear(self) -> None:
        """Pieces that are known, as sorted hashes with their ids: most of them, and those met of late."""
        self.known = [Pieces.none(), Pieces.none()]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the n+1 offsets."""
        parts, counts = [], np.zeros(len(texts), np.int64)
        group, size = [], 0

        def flush() -> None:
            nonlocal group, size
            if group:
                ids, offsets = self._block([texts[i] for i in group])
                parts.append(ids)
                counts[group] = np.diff(offsets)
                group, size = [], 0

        for i, text in enumerate(texts):
            if len(text) > self.block or any(s in text for s in self.special):
                flush()
                found = [*self.stream(text)]
                counts[i] = sum(map(len, found))
                parts += found
            else:
                group.append(i)
                size += len(text)
                if size >= self.block:
                    flush()
        flush()
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(counts)])

    def stream(self, text: str) -> Iterator[np.ndarray]:
        """The ids of one text, emitted as they become stable."""
        at = 0
        while at < len(text):
            end, special = min(((f, s) for s in self.special if (f := text.find(s, at)) >= 0), default=(len(text), ""))
            yield from self._plain(text, at, end)
            if special:
                yield np.array([self.special[special]], np.uint32)
            at = end + len(special)

    def _plain(self, text: str, at: int, end: int) -> Iterator[np.ndarray]:
        while end - at > self.block:
            block = text[at : at + self.block]
            if cut := stable_cut(block):
                yield self._block([block[:cut]])[0]
                at += cut
            else:
                stop = piece_end(text, at, end)
                machine = Transducer(self.merges)
                for i in range(at, stop, self.block):
                    yield from machine.feed(np.frombuffer(text[i : min(stop, i + self.block)].encode(), np.uint8))
                yield machine.finish()
                at = stop
        if at < end:
            yield self._block([text[at:end]])[0]

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = "".join(texts)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        start = piece_starts(points, bounds[:-1])
        end = np.append(start[1:], n)
        hashes = span_hash(prefix_hash(classes()[1][points]), start, end)
        different, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        found = self._pieces(different, whole, points, start[one], end[one])
        starts, sizes = found.at[:-1], np.diff(found.at)
        ids = found.ids[ragged(starts[which], sizes[which])]
        upto = np.concatenate([[0], np.cumsum(sizes[which])])
        return ids, upto[np.searchsorted(start, bounds)]

    def _pieces(self, hashes: np.ndarray, whole: str, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> "Pieces":
        """The ids of the pieces with these sorted hashes; those met for the first time are merged now."""
        if sum(len(k.hashes) for k in self.known) > self.keep:
            self._clear()
        sources = [*self.known]
        source = np.full(len(hashes), -1)
        slot = np.zeros(len(hashes), np.int64)
        for k, have in enumerate(sources):
            if len(have.hashes):
                at = np.minimum(np.searchsorted(have.hashes, hashes), len(have.hashes) - 1)
                hit = have.hashes[at] == hashes
                source[hit], slot[hit] = k, at[hit]
        new = np.flatnonzero(source < 0)
        if len(new):
            fresh = Pieces(hashes[new], *self._merge(whole, points, start[new], end[new]))
            source[new], slot[new] = len(sources), np.arange(len(new))
            sources.append(fresh)
            late = fresh.joined(self.known[1])
            if 4 * len(late.hashes) > len(self.known[0].hashes):
                self.known = [late.joined(self.known[0]), Pieces.none()]
            else:
                self.known = [self.known[0], late]
        sizes = np.zeros(len(hashes), np.int64)
        for k, have in enumerate(sources):
            mine = source == k
            sizes[mine] = have.at[slot[mine] + 1] - have.at[slot[mine]]
        at = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.empty(int(at[-1]), np.uint32)
        for k, have in enumerate(sources):
            mine = np.flatnonzero(source == k)
            ids[ragged(at[mine], sizes[mine])] = have.ids[ragged(have.at[slot[mine]], sizes[mine])]
        return Pieces(hashes, ids, at)

    def _merge(self, whole: str, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces and the n+1 offsets; a piece that is longer than the lookahead goes through a transducer
        of its own, the others end before any of their tokens needs one."""
        data = np.frombuffer("".join([whole[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)]).encode(), np.uint8)
        code = points[ragged(start, end - start)]
        wide = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        sizes = np.add.reduceat(wide, np.concatenate([[0], np.cumsum(end - start)[:-1]]))
        at = np.concatenate([[0], np.cumsum(sizes)])
        long = sizes > self.merges.lookahead
        short = np.flatnonzero(~long)
        ids, counts = self.merges.merged(data[ragged(at[:-1][short], sizes[short])], sizes[short])
        found, numbers = [ids], np.zeros(len(sizes), np.int64)
        numbers[short] = counts
        for k in np.flatnonzero(long).tolist():
            machine = Transducer(self.merges)
            own = np.concatenate([*machine.feed(data[at[k] : at[k + 1]]), machine.finish()])
            found.append(own)
            numbers[k] = len(own)
        order = np.concatenate([short, np.flatnonzero(long)])
        place = np.empty(len(sizes), np.int64)
        place[order] = np.concatenate([[0], np.cumsum(numbers[order])[:-1]])
        return np.concatenate(found)[ragged(place, numbers)], np.concatenate([[0], np.cumsum(numbers)])

    def decode(self, ids: np.ndarray, step: int = 1 << 20) -> Iterator[str]:
        """The text of ids in parts."""
        machine = Decoder(self.merges)
        for i in range(0, len(ids), step):
            yield machine.feed(ids[i : i + step])
        yield machine.finish()


class Decoder:
    """ids in, text out: their bytes go through a UTF-8 state machine, which holds back the bytes of a character
    that isn't complete."""

    def __init__(self, merges: Merges):
        self.merges, self.machine = merges, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        at = ids.astype(np.int64)
        return self.machine.decode(self.merges.bytes[ragged(self.merges.offsets[at], self.merges.lengths[at])].tobytes())

    def finish(self) -> str:
        return self.machine.decode(b"", True)


class Pieces:
    """Sorted hashes of pieces, and their ids with the n+1 offsets."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, at: np.ndarray):
        self.hashes, self.ids, self.at = hashes, ids, at

    @staticmethod
    def none() -> "Pieces":
        return Pieces(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def joined(self, other: "Pieces") -> "Pieces":
        if not len(other.hashes):
            return self
        hashes = np.concatenate([self.hashes, other.hashes])
        order = np.argsort(hashes, kind="stable")
        sizes = np.concatenate([np.diff(self.at), np.diff(other.at)])
        old = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        ids = np.concatenate([self.ids, other.ids])[ragged(old[order], sizes[order])]
        return Pieces(hashes[order], ids, np.concatenate([[0], np.cumsum(sizes[order])]))


def stable_cut(block: str) -> int:
    """The last place in block where a piece ends and another starts whatever follows the block; 0 if none."""
    points = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[0][points]
    # white space after something else; or a change between other kinds away from apostrophes and spaces
    good = (kind[1:] == WHITE) & (kind[:-1] != WHITE)
    if not good.any():
        good = (kind[1:] != kind[:-1]) & (kind[:-1] != WHITE) & (points[:-1] != _APOSTROPHE) & (points[1:] != _APOSTROPHE)
    found = np.flatnonzero(good)
    return int(found[-1]) + 1 if len(found) else 0


def piece_end(text: str, at: int, end: int) -> int:
    """Where the piece at text[at:], which is longer than a block, ends."""
    import regex

    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    return pattern.match(text, at, end).end()


@lru_cache(1)
def byte_of_symbol() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """So many bytes after a token's end settle that token, whatever follows them.

    A merge of u and v is prevented from the right only by an earlier merge of x and y where x is v or a
    last part of v, and that one only by a still earlier merge inside or after y. So in the order of the
    list: reach of (u, v) = the largest len(y) + reach of (x, y) over the earlier merges.
    """
    ends: dict[str, list[str]] = {}  # a symbol and its last parts
    best: dict[str, int] = {}
    most = longest = 0
    for u, v in merges:
        tail = ends.setdefault(v, [v])
        reach = max((best.get(x, 0) for x in tail), default=0)
        ends.setdefault(u + v, [u + v, *tail])
        best[u] = max(best.get(u, 0), len(v) + reach)
        most, longest = max(most, reach), max(longest, len(u + v))
    return most + longest
