"""BPE with word ends: encoding by forced boundaries, and decoding.

Every merge joins two bytes that then lie side by side inside a token of the vocabulary. Where two neighbouring bytes of a
word lie side by side in no token, no merge can ever cross: there the word is cut, the fragments are encoded on their own
and their ids put one after the other. Words and cuts are found for a whole slice of texts at once, each distinct fragment
is merged once, and fragments go through rounds of merges together (merges.py); the tokenizers library encodes long ones,
and normalizes texts beyond a known repertoire.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import byte_characters
from .common import arrow_map, byte_slices, named, record, text_columns
from .merges import NOTHING, NUMBER, OTHER, SPACE, Kinds, Memory, Merges, as_pieces, before, contractions, ranges, text_bytes

#: Bytes of the remembered fragments of a worker, for those that end words and for the others each.
FRAGMENT_MEMORY = 4 << 20
#: Bytes, or characters, and rows of the texts that are encoded together.
MEMORY, ROWS = 1 << 20, 8192
#: The pattern whose matches are found by the kinds of characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that Python puts in lower case as the library does, and that the library's normal form leaves alone.
PLAIN = "".join(map(chr, [*range(0x180), *range(0x2010, 0x2028)]))
#: All others.
BEYOND = re.compile("[^\x00-\u017f\u2010-\u2027]")
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_TEXT = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def inner_pairs(tokens: list[str], end: str) -> set[str]:
    """All pairs of neighbouring characters inside the tokens, word ends left out."""
    return {a + b for t in tokens for a, b in pairwise(t.removesuffix(end))}


class Codec:
    """Encoder and decoder of one tokenizer file; made once in each Python worker."""

    def __init__(self, content: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores
        from tokenizers import Tokenizer

        spec = json.loads(content)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        self._check(spec)
        whole = Tokenizer.from_str(content)
        self.normal, self.words = whole.normalizer, whole.pre_tokenizer
        self.vocab = model["vocab"]
        self.merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        own = model["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max(own.values(), default=-1) + 1)
        for t, i in own.items():
            self.tokens[i] = t
        # the bytes of all tokens, each with a blank after it, and where those of each one start
        encoded = [f"{t} ".encode() for t in self.tokens]
        self.joined, self.sizes = np.frombuffer(b"".join(encoded), np.uint8), np.array([len(x) for x in encoded], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.marks = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.mark = re.compile("|".join(map(re.escape, sorted(self.marks, key=len, reverse=True))) or r"(?!)")
        self.shown = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(self.shown)}
        # where a cut is certain: between a byte and the next one, if no token holds both side by side
        self.certain = np.ones((256, 256), bool)
        for x, y in inner_pairs(list(self.vocab), self.end):
            self.certain[self.byte_of[x], self.byte_of[y]] = False
        self.usual = self._usual(spec)
        self.kinds = Kinds()
        v = self.vocab
        merges = Merges(*(np.array([v[m[i]] for m in self.merges], np.int64) for i in range(2)), np.arange(len(self.merges)), np.array([v[x + y] for x, y in self.merges], np.int64))
        inner, last = (np.array([v[c + end] for c in self.shown], np.int32) for end in ("", self.end))
        # some fragments end words, on others a later one follows
        self.ending = Memory(merges, inner, last, lambda x: self._long(x, self.last), FRAGMENT_MEMORY)
        self.followed = Memory(merges, inner, inner, lambda x: self._long(x, self.inner), FRAGMENT_MEMORY)

    @cached_property
    def last(self):
        """The library's model that ends words, for long fragments."""
        from tokenizers import models

        return models.BPE(vocab=self.vocab, merges=self.merges, end_of_word_suffix=self.end)

    @cached_property
    def inner(self):
        """The library's model that doesn't."""
        from tokenizers import models

        return models.BPE(vocab=self.vocab, merges=self.merges)

    def _long(self, fragment: bytes, model) -> list[int]:
        return [t.id for t in model.tokenize("".join(map(self.shown.__getitem__, fragment)))]

    @staticmethod
    def _check(spec: dict) -> None:
        """The method holds for plain merges over bytes; other files are refused."""
        model = spec["model"]
        plain = model["type"] == "BPE" and model["end_of_word_suffix"] and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        raw = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
        if not plain or not raw or spec["post_processor"] or spec["decoder"] or {c + e for c in byte_characters() for e in ("", model["end_of_word_suffix"])} - set(model["vocab"]):
            raise ValueError("no tokenizer of plain byte merges with word ends")

    def _usual(self, spec: dict) -> bool:
        """Whether all that the file does to plain texts is lower case and the usual pattern."""
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        alone = len(steps) == 2 and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and steps[0].get("pattern") == {"Regex": PATTERN}
        bytewise = steps[-1].get("type") == "ByteLevel" and not steps[-1].get("add_prefix_space") and not steps[-1].get("use_regex")
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        blanks = [(n["pattern"], n["content"]) for n in steps if n["type"] == "Replace"] == [({"Regex": r"\s+"}, " ")]
        solid = "".join(PLAIN.split())
        return bool(alone and bytewise and blanks and [n["type"] for n in steps] == ["NFC", "Replace", "Lowercase"] and self.normal.normalize_str(solid) == solid.lower())

    def _segments(self, texts: list[str | None]) -> tuple[list[str], list[int], np.ndarray]:
        """Normalized stretches between special tokens, the special token after each (or -1), and how many stretches each text has."""
        out, marks, counts = [], [], np.ones(len(texts), np.int64)
        for i, text in enumerate(texts):
            at, text = 0, text or ""
            for m in self.mark.finditer(text):
                out.append(self._normalized(text[at : m.start()]))
                marks.append(self.marks[m.group()])
                counts[i] += 1
                at = m.end()
            out.append(self._normalized(text[at:] if at else text))
            marks.append(-1)
        return out, marks, counts

    def _normalized(self, text: str) -> str:
        if not self.usual:
            return text  # _parted() has the file's words
        return text.lower() if text.isascii() or not BEYOND.search(text) else self.normal.normalize_str(text)

    def _library_words(self, text: str) -> list[str]:
        return [w for w, _ in self.words.pre_tokenize_str(self.normal.normalize_str(text))]

    def _word_starts(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes start a word or white space, and which are white space."""
        kinds = self.kinds.of(raw)
        previous = before(kinds, bounds, NOTHING)
        new = (kinds != previous) | (kinds == NUMBER) & ((raw & 0xC0) != 0x80)
        at, letters = contractions(raw, bounds, previous != OTHER)
        new[at + 1] = False
        end = at + 1 + letters
        new[end[np.append(previous, NOTHING)[end] != NOTHING]] = True
        return new, kinds == SPACE

    def _fragment_starts(self, raw: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Where fragments start: at the words' starts and wherever a cut is certain."""
        cut = new.copy()
        cut[1:] |= self.certain[raw[:-1], raw[1:]]
        return np.flatnonzero(cut)

    def cut(self, words: list[str]) -> list[list[str]]:
        """The fragments of each word, given by the characters of its bytes; the last one of a word carries its end."""
        raw = np.frombuffer(bytes(map(self.byte_of.__getitem__, "".join(words))), np.uint8)
        new = np.zeros(len(raw), bool)
        new[np.cumsum([0, *map(len, words)])[:-1]] = True
        out: list[list[str]] = []
        for a, b in pairwise([*self._fragment_starts(raw, new).tolist(), len(raw)]):
            if new[a]:
                out.append([])
            out[-1].append("".join(map(self.shown.__getitem__, raw[a:b])) + (self.end if b == len(raw) or new[b] else ""))
        return out

    def _parted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For stretches of text: their bytes, bounds, which bytes start words or white space, which are white space."""
        if self.usual:
            raw, bounds = text_bytes(pa.array(texts, pa.string()))
            return raw, bounds, *self._word_starts(raw, bounds)
        words = [self._library_words(t) for t in texts]
        raw = np.frombuffer(bytes(map(self.byte_of.__getitem__, "".join(w for of in words for w in of))), np.uint8)
        new = np.zeros(len(raw), bool)
        new[np.cumsum([0, *(len(w) for of in words for w in of)])[:-1]] = True
        return raw, np.cumsum([0, *(sum(map(len, of)) for of in words)]), new, np.zeros(len(raw), bool)

    def encode_column(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the bounds of each text among them."""
        stretches, marks, counts = self._segments(texts)
        raw, bounds, new, white = self._parted(stretches)
        first = size = starts = np.zeros(0, np.int64)
        tokens = np.zeros(0, np.int32)
        if len(raw):
            starts = self._fragment_starts(raw, new)
            pieces, solid = as_pieces(raw, starts), ~white[starts]
            ends = np.append(new[starts[1:]], True)
            first, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
            for memory, some in ((self.ending, solid & ends), (self.followed, solid & ~ends)):
                found, at, n = memory.look_up(pieces.filter(pa.array(some)))
                first[some], size[some] = at + len(tokens), n
                tokens = np.concatenate([tokens, found])
        # special tokens stand at the ends of their stretches
        marks = np.array(marks, np.int64)
        after = np.flatnonzero(marks >= 0)
        spots = np.searchsorted(starts, bounds)
        if len(after):
            at = spots[after + 1]
            first, size = np.insert(first, at, len(tokens) + np.arange(len(after))), np.insert(size, at, 1)
            tokens = np.concatenate([tokens, marks[after].astype(np.int32)])
            spots = spots + np.concatenate([np.zeros(1, np.int64), np.cumsum(marks >= 0)])
        at, ends = ranges(first, size)
        return tokens[at].astype("<u4", copy=False), ends[spots[np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])]]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; texts of some MEMORY characters at a time are encoded together."""
        held, size = [], 0
        for i, text in enumerate(texts):
            held.append(text)
            size += len(text or "")
            if size >= MEMORY or i + 1 == len(texts):
                ids, bounds = self.encode_column(held)
                yield from (ids[a:b] for a, b in pairwise(bounds.tolist()))
                held, size = [], 0

    def decode_column(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The decoded UTF-8 of all texts, a blank after each token; start and end of each text leave out its last blank."""
        at, ends = ranges(self.places[ids], self.sizes[ids])
        spans = np.stack([ends[bounds[:-1]], ends[bounds[1:]]], axis=1)
        spans[:, 1] -= spans[:, 1] > spans[:, 0]
        return self.joined[at], spans

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of the ids with a blank between each two, as the file names no decoder; an unknown id is an error."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def _over(df: DataFrame, path: str, rows, schema: pa.Schema, ddl: str) -> DataFrame:
    """rows(codec, column) makes the columns of a slice. The file (a bounded vocabulary) goes out as a broadcast."""
    with open(path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast({"content": f.read()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value  # a worker keeps it from task to task, and the codec in it
        if "codec" not in held:
            held["codec"] = Codec(held["content"])
        for b in byte_slices(batches, 1, MEMORY, ROWS):
            yield record(schema, b.column(0), *rows(held["codec"], b.column(1).to_pylist()))

    return arrow_map(df, run, ddl)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each row, as the tokenizers library gives them without special tokens of its own.

    Special tokens that a text holds as such become their ids, as in the library. Null and empty texts have no ids.
    Repeated rows and null keys keep their rows; other columns are ignored; no rows in, no rows out. Texts are read whole.
    """
    return _over(text_columns(docs, id_col, text_col), path, lambda codec, texts: [[ids.astype(np.int32) for ids in codec.encode(texts)]], _IDS, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the tokens' strings, one blank between each two. Null ids count as none."""
    some = encoded.select(named(id_col).cast("long").alias("doc_id"), named(ids_col).cast("array<int>").alias("ids"))
    return _over(some, path, lambda codec, lists: [[codec.decode(np.array(x or [], np.int64)) for x in lists]], _TEXT, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode the ids again, and digest both.

    Ids are digested as little-endian unsigned 32-bit integers, the text in UTF-8. Edge cases as in encode().
    """

    def rows(codec: Codec, texts: list[str | None]):
        ids, bounds = codec.encode_column(texts)
        raw, spans = codec.decode_column(ids, bounds)
        sha = lambda x, at: [hashlib.sha256(x[a:b]).hexdigest() for a, b in at]
        return np.diff(bounds), sha(ids, pairwise(bounds.tolist())), sha(raw, spans.tolist())

    return _over(text_columns(docs, id_col, text_col), path, rows, _DIGEST, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_file(name: str = "word_bpe_49k.json") -> str:
    """Path of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)
