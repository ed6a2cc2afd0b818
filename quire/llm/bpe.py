"""Byte-pair encoding and decoding of whole texts by a public word-level vocabulary.

The merge loop is a segment tree over the ranks of adjacent pairs. Each leaf holds the rank
of the pair that starts there, with the position as tie-breaker; each inner node holds the
smaller of its children. The root is therefore the leftmost pair of lowest rank. One merge
changes three leaves (the pair itself, its left neighbour and the swallowed position), so it
costs three updates of logarithmic depth, and the loop ends when the root has no rank left.
A word of n bytes takes O(n log n) time and O(n) memory, however long it is.

Words repeat, so each worker keeps the ids of the words it has met in a table of bounded
size. The new words of a batch of texts go through the same tree together: the trees of words
of like length are the rows of one array, whose root column gives every word's next merge and
whose point updates climb all rows at once. Longer words get a tree of their own.
Ids are held as little-endian unsigned 32-bit integers, the form that the digests use.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import KEPT, per_batch, slices

#: Words that one worker remembers; the table is emptied when full.
MOST_WORDS = 1 << 19
#: Longer words are encoded afresh each time.
LONGEST_KEPT = 64
#: Leaves of the trees that are merged together; a longer word is merged alone.
WIDTHS = (8, 16, 32, 64)
#: Trees merged at once.
MOST_TREES = 1 << 15

# The split pattern that the vocabulary file names.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same over texts with no character above U+00FF, for the faster standard engine.
_L, _N = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
SPLIT_LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\t-\r \x85\xa0{_L}{_N}]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable and not a space
    or soft hyphen in Latin-1, otherwise the next free letter from U+0100 on."""
    letters, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letters.append(chr(b))
        else:
            letters.append(chr(free))
            free += 1
    return letters


class PairTree:
    """Segment tree over the ranks of adjacent pairs; ``root`` is the leftmost lowest."""

    NONE = 1 << 62

    def __init__(self, ranks: list[int]):
        self.size = 1 << max(0, len(ranks) - 1).bit_length()
        self.shift = self.size.bit_length()
        none = self.NONE
        nodes = [none] * self.size
        nodes += [none if r < 0 else r << self.shift | i for i, r in enumerate(ranks)]
        nodes += [none] * (2 * self.size - len(nodes))
        for i in range(self.size - 1, 0, -1):
            a, b = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = a if a < b else b
        self.nodes = nodes

    def put(self, at: int, rank: int) -> None:
        nodes, i = self.nodes, at + self.size
        nodes[i] = self.NONE if rank < 0 else rank << self.shift | at
        while i > 1:
            a, b = nodes[i], nodes[i ^ 1]
            i >>= 1
            low = a if a < b else b
            if nodes[i] == low:
                break
            nodes[i] = low

    def leftmost_lowest(self) -> int:
        """Position of the pair to merge, or -1."""
        root = self.nodes[1]
        return -1 if root == self.NONE else root & (1 << self.shift) - 1


class PairTrees:
    """One segment tree for each row, ``width`` leaves each, updated together."""

    NONE = np.int32(2**31 - 1)
    SHIFT = 6  # positions are below 64

    def __init__(self, ranks: np.ndarray):
        rows, self.width = ranks.shape
        nodes = np.full((rows, 2 * self.width), self.NONE, dtype=np.int32)
        nodes[:, self.width :] = np.where(ranks < 0, self.NONE, ranks << self.SHIFT | np.arange(self.width, dtype=np.int32))
        for i in range(self.width - 1, 0, -1):
            np.minimum(nodes[:, 2 * i], nodes[:, 2 * i + 1], out=nodes[:, i])
        self.nodes = nodes

    def put(self, rows: np.ndarray, at: tuple[np.ndarray, ...], ranks: tuple[np.ndarray, ...]) -> None:
        """Sets one leaf in each of ``rows`` for each of ``at``, then climbs to the roots."""
        nodes, paths = self.nodes, [a + self.width for a in at]
        for i, a, r in zip(paths, at, ranks, strict=True):
            nodes[rows, i] = np.where(r < 0, self.NONE, r << self.SHIFT | a)
        level = self.width
        while level > 1:
            level >>= 1
            for p in range(len(paths)):
                i = paths[p] = paths[p] >> 1
                nodes[rows, i] = np.minimum(nodes[rows, 2 * i], nodes[rows, 2 * i + 1])


class WordBpe(dict):
    """Maps a normalised word to its ids as bytes; computes and keeps them when missing."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << 20 | vocab[b]] = rank, vocab[a + b]
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.last = [vocab[x + self.suffix] for x in letters]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token.encode()
        keys = sorted(self.merges)
        self.pair_keys = np.array(keys, dtype=np.int64)
        self.pair_ranks = np.array([self.merges[k][0] for k in keys], dtype=np.int32)
        self.made = np.zeros(len(keys), dtype=np.int32)
        for rank, i in self.merges.values():
            self.made[rank] = i
        self.inner_ids, self.last_ids = np.array(self.inner, dtype=np.int32), np.array(self.last, dtype=np.int32)
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(SPLIT).findall
        self.words_latin = re.compile(SPLIT_LATIN).findall

    def merged(self, word: str) -> list[int]:
        """Ids of one word by the segment tree."""
        raw = word.encode()
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        n, merges = len(ids), self.merges
        if n == 1:
            return ids
        none = (-1, -1)
        tree = PairTree([merges.get(ids[i] << 20 | ids[i + 1], none)[0] for i in range(n - 1)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (i := tree.leftmost_lowest()) >= 0:
            j = after[i]
            ids[i] = merges[ids[i] << 20 | ids[j]][1]
            k = after[i] = after[j]
            ids[j] = -1
            if j < n - 1:
                tree.put(j, -1)
            if k < n:
                before[k] = i
                tree.put(i, merges.get(ids[i] << 20 | ids[k], none)[0])
            else:
                tree.put(i, -1)
            if (h := before[i]) >= 0:
                tree.put(h, merges.get(ids[h] << 20 | ids[i], none)[0])
        return [x for x in ids if x >= 0]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or -1."""
        keys = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int32(-1))

    def merged_together(self, raw: list[bytes], width: int) -> list[bytes]:
        """Ids, as bytes, of words of at most ``width`` bytes each, by one array of segment trees."""
        n = np.fromiter(map(len, raw), dtype=np.int32, count=len(raw))
        rows = np.arange(len(raw))
        letters = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), dtype=np.uint8).reshape(-1, width)
        ids = self.inner_ids[letters]
        ids[rows, n - 1] = self.last_ids[letters[rows, n - 1]]
        ids[np.arange(width) >= n[:, None]] = -1
        first = np.full(ids.shape, -1, dtype=np.int32)
        first[:, :-1] = self.ranks(ids[:, :-1], ids[:, 1:])
        first[:, :-1][ids[:, 1:] < 0] = -1
        trees = PairTrees(first)
        after = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), ids.shape).copy()
        before = np.broadcast_to(np.arange(-1, width, dtype=np.int32), (len(raw), width + 1)).copy()
        while len(rows := rows[trees.nodes[rows, 1] != trees.NONE]):
            root = trees.nodes[rows, 1]
            i = root & (1 << trees.SHIFT) - 1
            j = after[rows, i]
            k = after[rows, j]
            made = self.made[root >> trees.SHIFT]
            ids[rows, i], ids[rows, j], after[rows, i], before[rows, k] = made, -1, k, i
            next_id = np.where(k < n[rows], ids[rows, np.minimum(k, width - 1)], -1)
            h = before[rows, i]
            last_id = np.where(h < 0, -1, ids[rows, h])
            here = np.where(next_id < 0, -1, self.ranks(made, next_id)).astype(np.int32)
            left = np.where(last_id < 0, -1, self.ranks(last_id, made)).astype(np.int32)
            # a word's first letter has no left neighbour: its own leaf is written again instead
            left_at, left = np.where(h < 0, i, h), np.where(h < 0, here, left)
            trees.put(rows, (i, left_at, j), (here, left, np.full(len(rows), -1, dtype=np.int32)))
        flat, ends = ids[ids >= 0].astype("<u4").tobytes(), np.cumsum((ids >= 0).sum(axis=1)).tolist()
        return [flat[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, words: set[str]) -> None:
        """Keeps the ids of those words that are new and short enough."""
        new = [w for w in words if w not in self and len(w) <= LONGEST_KEPT]
        if len(self) + len(new) > MOST_WORDS:
            self.clear()
            new = [w for w in words if len(w) <= LONGEST_KEPT]
        raw = [w.encode() for w in new]
        for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            own = [i for i, r in enumerate(raw) if low < len(r) <= width]
            for at in range(0, len(own), MOST_TREES):
                some = own[at : at + MOST_TREES]
                for i, x in zip(some, self.merged_together([raw[i] for i in some], width), strict=True):
                    self[new[i]] = x

    def __missing__(self, word: str) -> bytes:
        return np.array(self.merged(word), dtype="<u4").tobytes()

    def pieces(self, text: str) -> Iterator[tuple[str, int]]:
        """The normalised stretches of a text, and -1, or the special strings in it, and their id."""
        if self.at_special is None or "<|" not in text:
            yield normal(text), -1
            return
        for i, x in enumerate(self.at_special.split(text)):
            if i % 2:
                yield x, self.special[x]
            elif x:
                yield normal(x), -1

    def split(self, text: str) -> list[str]:
        """The words of a normalised text."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.words(text)
        return self.words_latin(text)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, 4 bytes each; a null text counts as empty."""
        parts = [[(self.split(x), i) if i < 0 else ((), i) for x, i in self.pieces(t or "")] for t in texts]
        self.learn(set().union(*(words for p in parts for words, _ in p)))
        return [
            b"".join(b"".join(map(self.__getitem__, words)) if i < 0 else i.to_bytes(4, "little") for words, i in p)
            for p in parts
        ]

    def encode(self, text: str | None) -> bytes:
        """Ids of one whole text."""
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, in UTF-8: this vocabulary names no decoder, so tokens are joined by spaces."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def normal(text: str) -> str:
    """NFC, then lower case letter by letter. White space only separates words, so it may stay."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if "Σ" in text:  # lower() picks a final form by context; the library doesn't
        text = text.replace("Σ", "σ")
    return text.lower()


@lru_cache(maxsize=4)
def loaded(path: str) -> WordBpe:
    """One coder for each file and worker."""
    return WordBpe(path)


KEPT.append(loaded.cache_clear)


def encoded(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the token ids of every whole text; a null or empty text has none."""

    def run(batches):
        coder = loaded(path)
        for b in slices(batches, "text"):
            out = [np.frombuffer(x, dtype="<u4").astype("i4") for x in coder.encode_batch(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.int32()))], ["id", "ids"])

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return per_batch(source, run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def round_trips(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, decodes its ids again and returns counts and digests.

    Row by row, with no shuffle: rows may repeat, ids may be null or equal, other columns are
    not read. A null text counts as empty; an empty text has no ids and decodes to an empty
    text. An empty table gives an empty result.

    Returns (id, n_tokens long, ids_sha256, decoded_sha256).
    """

    def run(batches):
        coder = loaded(path)
        for b in slices(batches, "text"):
            n, ids_sha, text_sha = [], [], []
            for ids in coder.encode_batch(b.column("text").to_pylist()):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return per_batch(source, run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def crc(ids: bytes) -> int:
    """Unsigned CRC-32 of ids."""
    return zlib.crc32(ids)
