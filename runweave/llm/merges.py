"""Merges of many pieces of text at once, and what texts are parted by, in columns of numbers.

Used inside tasks by the two BPE operators: the UTF-8 of a slice of texts is one array of bytes, pieces are places in it,
each distinct piece is merged once, and a round of merges is a few array operations over all pieces of one length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Kinds of characters as the patterns tell them apart; the last is what stands before a text.
LETTER, NUMBER, OTHER, SPACE, NOTHING = range(5)
#: Pieces of more bytes are left to the library, whose queue suits long ones; rounds suit many short ones.
LONG = 64
#: Odd multiplier of the slots of pairs.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of a string column as one array, and the place where each text starts, and the end; null counts as empty."""
    texts = texts.cast(pa.string()).fill_null("")
    _, places, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    bounds = np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


class Kinds:
    """The kind of each character, as the tokenizers library's regular expressions have it; asked once for each character."""

    def __init__(self):
        from tokenizers import Regex, pre_tokenizers

        self.asked = [(kind, pre_tokenizers.Split(Regex(p), "removed")) for kind, p in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s"))]
        self.known = np.full(0x110000, NOTHING, np.uint8)
        self._ask(np.arange(128))
        self.ascii = np.concatenate([self.known[:128], np.full(128, OTHER, np.uint8)])

    def _ask(self, codes: np.ndarray) -> None:
        for code in codes.tolist():
            self.known[code] = next((kind for kind, split in self.asked if not split.pre_tokenize_str(chr(code))), OTHER)

    def of(self, raw: np.ndarray) -> np.ndarray:
        """The kind of each byte's character."""
        kinds = self.ascii[raw]
        lead = np.flatnonzero(raw >= 0xC0)
        if len(lead):
            first = raw[lead]
            for size, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
                at = lead[(first >= low) & (first < high)]
                code = (raw[at] & (0x7F >> size)).astype(np.int64)
                for i in range(1, size):
                    code = code << 6 | (raw[at + i] & 0x3F)
                found = self.known[code]
                if (found == NOTHING).any():
                    self._ask(np.unique(code[found == NOTHING]))
                    found = self.known[code]
                for i in range(size):
                    kinds[at + i] = found
        return kinds


def before(values: np.ndarray, bounds: np.ndarray, nothing: int) -> np.ndarray:
    """The value one place before each, `nothing` at the start of a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    starts = bounds[:-1]
    out[starts[starts < len(out)]] = nothing
    return out


def contractions(raw: np.ndarray, bounds: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where `'s|'t|'re|'ve|'m|'ll|'d` stands at a place that is `free` for it, and how many letters it has."""
    at = np.flatnonzero(raw == ord("'"))
    at = at[free[at]]
    left = bounds[np.searchsorted(bounds, at, side="right")] - at - 1  # bytes of the text after the mark
    padded = np.concatenate([raw, np.zeros(2, np.uint8)])
    one, two = padded[at + 1], padded[at + 2]
    single = (left >= 1) & np.isin(one, list(b"stmd"))
    double = (left >= 2) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    some = single | double
    return at[some], np.where(double, 2, 1)[some]


def as_pieces(raw: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes from each start to the next one, the last to the end, without a copy."""
    places = np.append(starts, len(raw)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(raw)])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges one after the other, and the bounds of the ranges among them."""
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
    return np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1]), bounds


class Merges:
    """Pairs of tokens that merge, in an order of ranks; made[rank] is the token that comes of it."""

    def __init__(self, left: np.ndarray, right: np.ndarray, ranks: np.ndarray, made: np.ndarray):
        self.made, self.none = made.astype(np.int32), len(made)
        self.wide = int(max(left.max(initial=0), right.max(initial=0), made.max(initial=0))) + 1
        keys = left.astype(np.int64) * self.wide + right
        bits = max(4 * len(keys), 2).bit_length()
        self.shift = np.uint64(64 - bits)
        slots = self._slots(keys)
        _, first = np.unique(slots, return_index=True)
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.none, np.int32)
        self.keys[slots[first]], self.ranks[slots[first]] = keys[first], ranks[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)  # their slot was taken
        rest = rest[np.argsort(keys[rest])]
        self.crowded = np.zeros(1 << bits, bool)
        self.crowded[slots[rest]] = True
        self.rest_keys, self.rest_ranks = np.append(keys[rest], np.iinfo(np.int64).max), np.append(ranks[rest], self.none)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * SPREAD) >> self.shift).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, `none` if it does not merge."""
        keys = left.astype(np.int64) * self.wide + right
        slots = self._slots(keys)
        hit = self.keys[slots] == keys
        out = np.where(hit, self.ranks[slots], np.int32(self.none))
        look = np.nonzero(self.crowded[slots] & ~hit)
        if len(look[0]):
            at = np.searchsorted(self.rest_keys, keys[look])
            out[look] = np.where(self.rest_keys[at] == keys[look], self.rest_ranks[at], self.none)
        return out

    def rounds(self, tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """(rows, their tokens as a matrix) until all pieces are merged; each round merges a piece's first pair of least rank.

        Rounds go down from the longest pieces: what merges has one token less and joins the pieces of that length.
        """
        order = np.argsort(sizes, kind="stable")
        ends = np.searchsorted(sizes[order], np.arange(int(sizes.max(initial=0)) + 2))
        rows, s, r = np.zeros(0, np.int64), np.zeros((0, len(ends) - 2), np.int32), np.zeros((0, max(len(ends) - 3, 0)), np.int32)
        for n in range(len(ends) - 2, 0, -1):
            own = order[ends[n] : ends[n + 1]]
            more = tokens[starts[own][:, None] + np.arange(n)]
            rows, s = np.concatenate([rows, own]), np.concatenate([s, more])
            if n == 1:
                yield rows, s
                return
            r = np.concatenate([r, self.find(more[:, :-1], more[:, 1:])])
            at = r.argmin(axis=1)
            least = r[np.arange(len(r)), at]
            on = least < self.none
            yield rows[~on], s[~on]
            rows, s, r, at, least = rows[on], s[on], r[on], at[on], least[on]
            i = np.arange(len(rows))
            s[i, at] = self.made[least]
            s = s[np.arange(n) != at[:, None] + 1].reshape(len(rows), n - 1)
            r = r[np.arange(n - 1) != at[:, None]].reshape(len(rows), n - 2)
            k = i[at > 0]
            r[k, at[k] - 1] = self.find(s[k, at[k] - 1], s[k, at[k]])
            k = i[at < n - 2]
            r[k, at[k]] = self.find(s[k, at[k]], s[k, at[k] + 1])


class Memory:
    """The tokens of pieces; each distinct one is merged once, and remembered while all of them take at most `size` bytes.

    first[b] is the token of a byte, last[b] of the last one of a piece. `whole` are pieces with tokens of their own.
    `long(piece)` gives the tokens of a piece of over LONG bytes.
    """

    def __init__(self, merges: Merges, first: np.ndarray, last: np.ndarray, long: Callable[[bytes], list[int]], size: int, whole: dict[bytes, int] | None = None):
        self.merges, self.first, self.last, self.long, self.size = merges, first, last, long, size
        self.whole = pa.array(list(whole or {}), pa.binary())
        self.whole_tokens = np.fromiter((whole or {}).values(), np.int32, len(self.whole))
        self._forget()

    def _forget(self) -> None:
        self.pieces, self.tokens, self.bounds = self.whole, self.whole_tokens, np.arange(len(self.whole) + 1, dtype=np.int64)

    def _merge(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        places = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        raw = np.frombuffer(pieces.buffers()[2], np.uint8)[places[0] : places[-1]]
        places -= places[0]
        tokens, sizes = self.first[raw], np.diff(places)
        tokens[places[1:] - 1] = self.last[raw[places[1:] - 1]]
        short = np.flatnonzero(sizes <= LONG)
        done = [(short[rows], found) for rows, found in self.merges.rounds(tokens, places[short], sizes[short])]
        done += [(np.array([i]), np.array([self.long(pieces[i].as_py())], np.int32)) for i in np.flatnonzero(sizes > LONG).tolist()]
        for rows, found in done:
            sizes[rows] = found.shape[1]
        bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        out = np.empty(bounds[-1], np.int32)
        for rows, found in done:
            out[bounds[rows][:, None] + np.arange(found.shape[1])] = found
        return out, bounds

    def look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, and where those of each piece start and how many there are. No piece is empty."""
        if self.pieces.nbytes + self.tokens.nbytes + self.bounds.nbytes > self.size:
            self._forget()
        old = len(self.pieces)
        both = pa.concat_arrays([self.pieces, pieces]).dictionary_encode()
        if len(both.dictionary) > old:
            tokens, bounds = self._merge(both.dictionary.slice(old))
            self.bounds = np.concatenate([self.bounds, bounds[1:] + len(self.tokens)])
            self.tokens, self.pieces = np.concatenate([self.tokens, tokens]), both.dictionary
        at = both.indices.to_numpy()[old:]
        return self.tokens, self.bounds[at], (self.bounds[at + 1] - self.bounds[at])
