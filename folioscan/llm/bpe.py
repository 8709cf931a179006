"""Byte-pair encoding and decoding with the vocabulary of a public byte-level tokenizer."""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed value: the published pre-tokenization pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space on both sides of a blank, or up to the end: there a text must not be cut before the blank.
UNSAFE_BLANK = regex.compile(r"\s (?!\S)")
NONE = 1 << 30
SHORT = 128
# Words merged side by side, and texts whose words are looked for together.
ROWS = 4096
TEXTS = 500
KNOWN_WORDS = 150_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if it prints, else the next free one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Tables of a tokenizer file: byte -> id, (left, right) -> rank, rank -> id, id -> bytes, added texts -> id."""

    bytes_: list[int]
    ranks: dict[int, int]
    merged: list[int]
    tokens: list[bytes]
    added: dict[str, int]


def load_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizer file on the driver. Only plain byte-level BPE without a normalizer is taken."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec["pre_tokenizer"]
    plain = model["type"] == "BPE" and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
    odd = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if not plain or spec["normalizer"] or odd:
        raise ValueError("not a plain byte-level BPE tokenizer")
    letters, ids = byte_letters(), model["vocab"]
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [b""] * (max([*ids.values(), *added.values()]) + 1)
    for token, i in ids.items():
        tokens[i] = bytes(letters[c] for c in token)
    for token, i in added.items():
        tokens[i] = token.encode()
    bytes_ = [0] * 256
    for letter, b in letters.items():
        bytes_[b] = ids[letter]
    ranks, merged = {}, []
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        ranks[ids[left] << 32 | ids[right]] = rank
        merged.append(ids[left + right])
    return Vocabulary(bytes_, ranks, merged, tokens, added)


def id_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


class Known(dict):
    """What was met lately -> bytes of its ids. Two generations of at most ``KNOWN_WORDS`` entries; what is met again stays."""

    def __init__(self) -> None:
        self.older: dict[str, bytes] = {}

    def keep(self, key: str, ids: bytes) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.older = dict(self)
            self.clear()
        self[key] = ids
        return ids


class Encoder(Known):
    """Word -> bytes of its ids; words are merged when first met."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.pairs = {bytes([a, b]): rank for a, x in enumerate(vocabulary.bytes_) for b, y in enumerate(vocabulary.bytes_) if (rank := vocabulary.ranks.get(x << 32 | y)) is not None}
        ranks = sorted(vocabulary.ranks.items())
        self.keys, self.key_ranks = (np.array(x, np.int64) for x in (zip(*ranks, strict=True) if ranks else ([-1], [NONE])))
        self.merged = np.array(vocabulary.merged, np.int64)
        self.words = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(vocabulary.added, key=len, reverse=True))) if vocabulary.added else None
        self.pieces = Pieces(self)

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            data = word.encode("utf-8", "surrogatepass")
            if len(data) > SHORT:
                return id_bytes(self.merge_long(data))
            ids = id_bytes(self.merge(data))
        return self.keep(word, ids)

    def merge(self, word: bytes) -> list[int]:
        """The parts of a short word and the ranks between them, in two arrays; the least rank is merged until none is left."""
        v = self.vocabulary
        rank_of, merged = v.ranks.get, v.merged
        parts = [v.bytes_[b] for b in word]
        first_rank = self.pairs.get
        ranks = [first_rank(word[i : i + 2], NONE) for i in range(len(word) - 1)]
        while ranks and (least := min(ranks)) != NONE:
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 32 | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] << 32 | parts[i + 1], NONE)
        return parts

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """``merge`` for many short words side by side: one row of parts and one of ranks for each, and one merge a row at a step."""
        out = [b""] * len(words)
        order = sorted((i for i, w in enumerate(words) if w), key=lambda i: len(words[i]))
        for at in range(0, len(order), ROWS):
            rows = order[at : at + ROWS]
            self._merge_rows([words[i] for i in rows], rows, out)
        return out

    def _merge_rows(self, words: list[bytes], rows: list[int], out: list[bytes]) -> None:
        width = len(words[-1])
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        sizes, at = np.array([len(w) for w in words]), np.array(rows)
        parts = np.asarray(self.vocabulary.bytes_, np.int64)[data]
        columns = np.arange(width)
        ranks = np.where(columns[1:] < sizes[:, None], self.ranks_of(parts[:, :-1], parts[:, 1:]), NONE)
        while True:
            here = np.arange(len(parts))
            i = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(parts), int)
            least = ranks[here, i] if ranks.shape[1] else np.full(len(parts), NONE)
            done = least == NONE
            if done.any():
                for row, n, ids in zip(at[done].tolist(), sizes[done].tolist(), parts[done].astype("<i4"), strict=True):
                    out[row] = ids[:n].tobytes()
                go = ~done
                if not go.any():
                    return
                parts, ranks, sizes, at, i, least = parts[go], ranks[go], sizes[go], at[go], i[go], least[go]
                here = np.arange(len(parts))
            # The boundary after place i goes: what stands behind it moves up by one.
            parts[here, i] = self.merged[least]
            behind = columns[1:-1] > i[:, None]
            parts[:, 1:-1] = np.where(behind, parts[:, 2:], parts[:, 1:-1])
            moved = columns[: ranks.shape[1] - 1] >= i[:, None]
            ranks[:, :-1] = np.where(moved, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            sizes -= 1
            left = np.flatnonzero(i > 0)
            ranks[left, i[left] - 1] = self.ranks_of(parts[left, i[left] - 1], parts[left, i[left]])
            right = np.flatnonzero(i + 1 < sizes)
            ranks[right, i[right]] = self.ranks_of(parts[right, i[right]], parts[right, i[right] + 1])

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        places = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[places] == keys, self.key_ranks[places], NONE)

    def learn(self, texts: list[str]) -> None:
        """Find the pieces of some texts that are not known yet, and merge their words side by side."""
        pieces = set()
        for text in texts:
            pieces.update(text.split(" "))
        known, older = self.pieces, self.pieces.older
        parts = {p: self.words(" " + p) for p in pieces if p not in known and p not in older and len(p) <= SHORT}
        words = [w for w in {w for found in parts.values() for w in found} if w not in self and w not in self.older]
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        short = [i for i, d in enumerate(data) if len(d) <= SHORT]
        for i, ids in zip(short, self.merge_many([data[i] for i in short]), strict=True):
            self.keep(words[i], ids)
        for piece, found in parts.items():
            known.keep(piece, self[found[0]] if len(found) == 1 else b"".join([self[w] for w in found]))

    def merge_long(self, word: bytes) -> list[int]:
        """The same for a long word, where repeated scans would take time by the square of its length: the ranks wait in a heap."""
        v = self.vocabulary
        rank_of, merged = v.ranks.get, v.merged
        parts = [v.bytes_[b] for b in word]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank_of(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := rank_of(parts[i] << 32 | parts[j])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = merged[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i], i)
            push(i, after[i])
        return [p for p in parts if p >= 0]

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens.

        Blanks open words, so a text may be cut before each of them and pieces met before be looked up whole. Only a
        blank between white space, or between white space and the end, belongs to a run: such a text is cut by the pattern.
        """
        if UNSAFE_BLANK.search(text):
            return b"".join(map(self.__getitem__, self.words(text)))
        first, *rest = text.split(" ")
        return b"".join(map(self.__getitem__, self.words(first))) + b"".join(map(self.pieces.__getitem__, rest))

    def encode(self, text: str) -> np.ndarray:
        if self.special is None or not self.special.search(text):
            return np.frombuffer(self.plain(text), "<i4")
        out, at = [], 0
        for found in self.special.finditer(text):
            out += [self.plain(text[at : found.start()]), id_bytes([self.vocabulary.added[found[0]]])]
            at = found.end()
        out.append(self.plain(text[at:]))
        return np.frombuffer(b"".join(out), "<i4")


class Pieces(Known):
    """What stands between two blanks -> bytes of the ids of it and the blank before it."""

    def __init__(self, words: Encoder) -> None:
        super().__init__()
        self.words = words

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = b"".join(map(self.words.__getitem__, self.words.words(" " + piece)))
            if len(piece) > SHORT:
                return ids
        return self.keep(piece, ids)


# The encoder that tasks of one Python worker share; the one of the last query is kept.
_encoders: dict[str, Encoder] = {}


def worker_encoder(key: str, shared: Broadcast) -> Encoder:
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(**shared.value))
    return _encoders[key]


def slices(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Batches in slices of ``TEXTS`` rows, so that a worker holds the ids of one slice only and hands it on."""
    for batch in batches:
        for at in range(0, len(batch), TEXTS):
            yield batch.slice(at, TEXTS)


def encode(spark: SparkSession, vocabulary: Vocabulary, text: Column) -> Column:
    """Token ids (array<int>) of whole texts. Null and empty texts have none. Special tokens' strings become their ids."""
    shared, key = spark.sparkContext.broadcast(vars(vocabulary)), uuid.uuid4().hex

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = worker_encoder(key, shared)
        for some in slices(batches):
            known = [t or "" for t in some.to_pylist()]
            encoder.learn(known)
            found = [*map(encoder.encode, known)]
            ends = np.cumsum([0, *map(len, found)])
            if ends[-1] < 1 << 31:
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *found])))
            else:
                yield pa.array(found, pa.list_(pa.int32()))

    return ids(text)


def decode(spark: SparkSession, vocabulary: Vocabulary, ids: Column) -> Column:
    """Texts of token ids, special ones included. Bytes that are no UTF-8 become replacement characters.

    A null array is a null text; null and unknown ids add nothing.
    """
    shared = spark.sparkContext.broadcast(vocabulary.tokens)

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        n = len(shared.value)
        # One more token, without bytes, stands for null and unknown ids.
        tokens = pa.array([*shared.value, b""], pa.binary())
        for lists in slices(batches):
            places = pc.fill_null(lists.flatten(), n).to_numpy(zero_copy_only=False)
            places = np.where((places >= 0) & (places < n), places, n)
            ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()])
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens.take(pa.array(places))), b"")
            try:
                found = joined.cast(pa.string())
            except pa.ArrowInvalid:  # some text is no UTF-8
                found = pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())
            yield pc.if_else(lists.is_valid(), found, pa.scalar(None, pa.string()))

    return texts(ids)
