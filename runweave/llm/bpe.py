"""Byte-level BPE by a rank file: encoding over Arrow batches, and decoding.

A rank file merges any two neighbours whose joint string has a rank, the least rank first and the leftmost of equal ones;
whole pieces that are tokens are taken as they are. The pattern's pieces are found for a whole slice of texts by the kinds
of its characters, each distinct piece is merged once, and pieces of all lengths go through rounds of merges together
(merges.py). The tokenizers library encodes long pieces, and splits by other patterns than the public one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_slices, record, text_columns
from .merges import NOTHING, OTHER, SPACE, Kinds, Memory, Merges, as_pieces, before, contractions, ranges, text_bytes

#: Bytes of the remembered pieces of a worker; bytes and rows of the texts that are encoded together.
MEMORY, TOGETHER, ROWS = 8 << 20, 1 << 20, 8192
#: The pattern whose matches are found by the kinds of characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that stand for themselves as characters; the others follow from U+0100 in order. Fixed values of the format.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_characters() -> list[str]:
    """The character of each byte."""
    out = {b: chr(b) for b in PRINTABLE}
    rest = [b for b in range(256) if b not in out]
    return [(out | {b: chr(0x100 + i) for i, b in enumerate(rest)})[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder of one rank file and pattern; made once in each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.sizes = np.zeros(max(self.bytes_of, default=0) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self.sizes[i] = len(b)
        # the bytes of all tokens by their ids, and where those of each one start
        self.joined = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(self.sizes))), np.uint8)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.kinds = Kinds()
        single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = np.array([(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks], np.int64).reshape(-1, 3)
        merges = Merges(*pairs.T, np.arange(len(self.sizes)))
        self.memory = Memory(merges, single, single, self._long, MEMORY, ranks)

    @cached_property
    def model(self):
        """The library's model, for long pieces; it has every split of every token as a merge, in the order of ranks."""
        from tokenizers import models

        shown = byte_characters()
        as_text = lambda b: "".join(map(shown.__getitem__, b))
        ranks = self.ranks
        merges = [(as_text(t[:i]), as_text(t[i:])) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        return models.BPE(vocab={as_text(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True)

    def _long(self, piece: bytes) -> list[int]:
        shown = byte_characters()
        return [t.id for t in self.model.tokenize("".join(map(shown.__getitem__, piece)))]

    @cached_property
    def split(self):
        """The library's own splitting, for other patterns."""
        from tokenizers import Regex, pre_tokenizers

        return pre_tokenizers.Split(Regex(self.pattern), "isolated")

    def starts(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the matches of the pattern start in texts that lie one after the other."""
        new = np.zeros(len(raw), bool)
        if self.pattern != PATTERN:
            for a, b in pairwise(bounds.tolist()):
                sizes = [len(p.encode()) for p, _ in self.split.pre_tokenize_str(raw[a:b].tobytes().decode())]
                new[a + np.cumsum([0, *sizes[:-1]])[: len(sizes)]] = True
            return np.flatnonzero(new)
        kinds = self.kinds.of(raw)
        previous = before(kinds, bounds, NOTHING)
        new = kinds != previous
        blank = before(raw == ord(" "), bounds, False)  # a single blank goes with what follows
        free = (previous != OTHER) & ~blank
        # of white space before something, the last character stands alone, or goes with what follows if it is a blank
        after = np.flatnonzero(new & (previous == SPACE))
        last = after - 1
        for _ in range(3):
            last -= (raw[last] & 0xC0) == 0x80
        new[last] = True
        new[after[blank[after]]] = False
        at, letters = contractions(raw, bounds, free)
        new[at + 1] = False
        end = at + 1 + letters
        inside = np.append(previous, NOTHING)[end] != NOTHING
        new[end[inside]] = True
        return np.flatnonzero(new)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the bounds of each text among them."""
        raw, bounds = text_bytes(texts)
        if not len(raw):
            return np.zeros(0, "<u4"), np.zeros(len(bounds), np.int64)
        starts = self.starts(raw, bounds)
        tokens, first, count = self.memory.look_up(as_pieces(raw, starts))
        at, ends = ranges(first, count)
        return tokens[at].astype("<u4", copy=False), ends[np.searchsorted(starts, bounds)]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        ids, bounds = self.encode_column(pa.array(texts, pa.string()))
        yield from (ids[a:b] for a, b in pairwise(bounds.tolist()))

    def offsets(self, text: str | None, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of each token of a text; the tokens of a split character all cover it.

        Token lengths give bytes; counting the bytes that begin a character maps them to characters.
        """
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        end = np.cumsum(self.sizes[ids.astype(np.int64)])
        return character[end - self.sizes[ids.astype(np.int64)]].astype(np.int32), (character[end - 1] + 1).astype(np.int32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; an id that the vocabulary lacks raises KeyError."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode_column(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts, given as encode_column() gives them, and the bounds of each text among them."""
        at, ends = ranges(self.places[ids], self.sizes[ids])
        return self.joined[at], ends[bounds]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids. Tokens may hold parts of a character: bytes are joined first, what stays broken is U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
_TEXT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("raw", pa.binary())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _codec(held: dict, pattern: str) -> Codec:
    """The worker's codec. It stays beside the ranks in the broadcast value, which a worker keeps from task to task."""
    if pattern not in held:
        held[pattern] = Codec(held["ranks"], pattern)
    return held[pattern]


def _over(df: DataFrame, rank_path: str, pattern: str, rows, schema: pa.Schema, ddl: str) -> DataFrame:
    """rows(codec, column) makes the columns of a slice. The ranks (a bounded vocabulary) go out as a broadcast."""
    shared = df.sparkSession.sparkContext.broadcast({"ranks": read_ranks(rank_path)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for b in byte_slices(batches, 1, TOGETHER, ROWS):
            yield record(schema, b.column(0), *rows(codec, b.column(1)))

    return arrow_map(df, run, ddl)


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends): token ids and the characters each covers (end exclusive), a row for each row.

    Null and empty texts have no ids. Special tokens are never made. Repeated rows and null keys keep their rows; other
    columns are ignored; no rows in, no rows out. A text of any length is encoded whole.
    """

    def rows(codec: Codec, texts: pa.Array):
        ids, bounds = codec.encode_column(texts)
        spans = [codec.offsets(t.as_py(), ids[a:b]) for t, (a, b) in zip(texts, pairwise(bounds.tolist()))]
        lists = lambda x: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x))
        return [lists(x) for x in (ids.astype(np.int32), *(np.concatenate([np.zeros(0, np.int32), *(x[i] for x in spans)]) for i in range(2)))]

    return _over(text_columns(docs, id_col, text_col), rank_path, pattern, rows, _IDS, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text, raw): text and bytes of the ids. Null ids count as none; ids cut inside a character give U+FFFD there."""

    def rows(codec: Codec, lists):
        raw = [codec.decode_bytes(np.array(x.as_py() or [], np.int64)) for x in lists]
        return [r.decode("utf-8", "replace") for r in raw], raw

    some = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return _over(some, rank_path, pattern, rows, _TEXT, "doc_id long, text string, raw binary")


def digests(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode the ids again, and digest both.

    Ids are digested as little-endian unsigned 32-bit integers. Edge cases as in encode().
    """

    def rows(codec: Codec, texts: pa.Array):
        ids, bounds = codec.encode_column(texts)
        sha = lambda x, at: [hashlib.sha256(x[a:b]).hexdigest() for a, b in pairwise(at.tolist())]
        return np.diff(bounds), sha(ids, bounds), sha(*codec.decode_column(ids, bounds))

    return _over(text_columns(docs, id_col, text_col), rank_path, pattern, rows, _DIGEST, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_ranks(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern of an installed public rank file."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN
