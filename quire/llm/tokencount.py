"""Token counts by a tokenizer compiled to a deterministic transducer.

Words of the split pattern are read letter by letter. A state stands for what has been read of
a word; it is numbered, and known to the compiler by the last token of that beginning. Byte-pair
merges have the property that taking the last token off an encoded beginning leaves the encoding
of a shorter beginning, so a new state's last token is the one token that ends there
and does not merge across its border with the last token of the state before it. A transition is
annotated with the tokens that it emits: the tokens of the longer beginning less those
of the shorter one (which may be less than none, when a letter joins tokens). The last letter of a
word is a symbol of its own, as in the vocabulary, and leads back to the start. Transitions
are compiled from the merges when they are first taken, up to a bound, beyond which the machine
is compiled afresh; letters beyond the 64th of a word take transitions that are not kept.

A text is cut into chunks of fixed size, wherever the cuts fall. White space leads every state
back to the start. So each chunk is summarised, on its own, by what it does to any state it may be
entered in: the letters that it adds to the stretch under way (its head, up to the first white
space), the tokens it emits after that, and the stretch it leaves under way (its tail). A
chunk without white space only prolongs the stretch under way. These maps form a monoid, so they
compose in any grouping: a prefix scan by doubling joins neighbours until one map stands for the
text, with the same count however the text was cut.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe import WordBpe, byte_letters, loaded
from quire.llm.common import per_batch, slices

#: Letters of a chunk.
CHUNK = 1 << 14
#: Transitions kept before the machine is compiled afresh.
MOST_TRANSITIONS = 1 << 20
#: Letters of a word whose transitions are kept.
DEEPEST_KEPT = 64

SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]")
class Machine:
    """The transducer of one vocabulary."""

    def __init__(self, coder: WordBpe):
        self.coder = coder
        #: Whether a token stays whole and a pair of tokens apart.
        self.apart: dict[int, bool] = {}
        inner, suffix = coder.inner, coder.suffix
        # tokens by their bytes, apart for those that end a word, and the symbols that each is made of
        self.ending: tuple[dict[bytes, int], dict[bytes, int]] = {}, {}
        self.symbols: dict[int, list[int]] = {i: [i] for i in (*inner, *coder.last)}
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        for _, i in sorted(coder.merges.values()):
            token = coder.tokens[i].decode()
            ends = token.endswith(suffix)
            raw = bytes(byte_of[x] for x in (token.removesuffix(suffix) if ends else token))
            self.ending[ends][raw] = i
            self.symbols[i] = [inner[x] for x in raw[:-1]] + [(coder.last if ends else inner)[raw[-1]]]
        self.longest = max((len(x) for d in self.ending for x in d), default=1)
        self.restart()

    def restart(self) -> None:
        #: From state << 9 | symbol to state; of each state its last token and the tokens so far.
        self.to: dict[int, int] = {}
        self.last, self.count = [-1], [0]

    def together(self, key: int, ids: list[int], expected: list[int]) -> bool:
        """Whether symbols merge into the expected tokens; answers are kept by key."""
        if (known := self.apart.get(key)) is None:
            merges, none = self.coder.merges, (1 << 62, -1)
            while len(ids) > 1:
                rank, at = min((merges.get(x << 20 | y, none)[0], i) for i, (x, y) in enumerate(zip(ids, ids[1:])))
                if rank == none[0]:
                    break
                ids[at : at + 2] = [merges[ids[at] << 20 | ids[at + 1]][1]]
            if len(self.apart) >= MOST_TRANSITIONS:
                self.apart.clear()
            known = self.apart[key] = ids == expected
        return known

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether two tokens, one after the other, stay as they are."""
        return self.together(a << 20 | b, self.symbols[a] + self.symbols[b], [a, b])

    def stay_whole(self, t: int) -> bool:
        """Whether a token's symbols merge into it."""
        return self.together(-1 - t, list(self.symbols[t]), [t])

    def next_token(self, raw: bytes, end: int, last: list[int], ends: bool) -> int:
        """The last token of the beginning raw[:end]; ``last`` has those of the shorter ones."""
        tokens = self.ending[ends]
        for n in range(min(end, self.longest), 1, -1):
            if (t := tokens.get(raw[end - n : end])) is not None and self.stay_whole(t) and (n == end or self.stay_apart(last[end - n], t)):
                return t
        return (self.coder.last if ends else self.coder.inner)[raw[end - 1]]

    def emitted(self, word: str) -> int:
        """Tokens that the transitions of one word emit together, from the start back to the start."""
        raw, state = word.encode(), 0
        try:
            for b in raw[:-1]:
                state = self.to[state << 9 | b]
            return self.count[self.to[state << 9 | 256 | raw[-1]]]
        except KeyError:
            return self.compiled_to(raw)

    def compiled_to(self, raw: bytes) -> int:
        """The same, making the transitions that are missing."""
        if len(self.to) >= MOST_TRANSITIONS:
            self.restart()
        state, last, count = 0, [-1], [0]
        for i, b in enumerate(raw, 1):
            ends = i == len(raw)
            key = state << 9 | ends << 8 | b
            if i <= DEEPEST_KEPT and (known := self.to.get(key)) is not None:
                state = known
                last.append(self.last[state])
                count.append(self.count[state])
                continue
            t = self.next_token(raw, i, last, ends)
            last.append(t)
            count.append(count[i - len(self.symbols[t])] + 1)
            if i <= DEEPEST_KEPT:
                state = self.to[key] = len(self.last)
                self.last.append(t)
                self.count.append(count[i])
        return count[-1]


class Batch(dict):
    """Tokens of the distinct words of a batch of texts: each is run through the machine once."""

    def __init__(self, machine: Machine):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        n = self[word] = self.machine.emitted(word)
        return n

    def of(self, stretch: str) -> int:
        """Tokens of a piece of text that starts and ends where words do."""
        return sum(map(self.__getitem__, self.machine.coder.split(stretch)))


class ChunkMap(NamedTuple):
    """What a chunk does to any state it is entered in. ``tail`` None: no white space in it."""

    head: str
    tokens: int
    tail: str | None


def chunk_map(batch: Batch, chunk: str) -> ChunkMap:
    first = SPACE.search(chunk)
    if first is None:
        return ChunkMap(chunk, 0, None)
    last = max(chunk.rfind(" "), chunk.rfind("\n"), first.start())
    return ChunkMap(chunk[: first.start()], batch.of(chunk[first.start() : last + 1]), chunk[last + 1 :])


def after(batch: Batch, a: ChunkMap, b: ChunkMap) -> ChunkMap:
    """The map of two chunks, one after the other; associative."""
    if a.tail is None:
        return ChunkMap(a.head + b.head, b.tokens, b.tail)
    if b.tail is None:
        return ChunkMap(a.head, a.tokens, a.tail + b.head)
    return ChunkMap(a.head, a.tokens + b.tokens + batch.of(a.tail + b.head), b.tail)


def scanned(batch: Batch, maps: Sequence[ChunkMap]) -> ChunkMap:
    """All maps composed, pairwise by doubling."""
    maps = list(maps)
    while len(maps) > 1:
        maps = [after(batch, *maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def count_tokens(batch: Batch, text: str | None, chunk: int = CHUNK) -> int:
    """Tokens of a whole text; special strings in it count as one each."""
    total = 0
    for piece, special in batch.machine.coder.pieces(text or ""):
        if special >= 0:
            total += 1
        elif piece:
            whole = scanned(batch, [chunk_map(batch, piece[i : i + chunk]) for i in range(0, len(piece), chunk)])
            total += batch.of(whole.head) + whole.tokens + batch.of(whole.tail or "")
    return total


@lru_cache(maxsize=4)
def compiled(path: str) -> Machine:
    """One machine for each file and worker."""
    return Machine(loaded(path))


def token_counts(df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Bytes and tokens of every whole text, and whether the tokens exceed ``limit``.

    Row by row, with no shuffle: rows may repeat, ids may be null or equal, other columns are
    not read. A null text counts as empty: 0 bytes, 0 tokens. An empty table gives an empty
    result. A text of any length is read to its end, chunk by chunk.

    Returns (id, n_bytes long, n_tokens long, over_limit boolean).
    """

    def run(batches):
        machine = compiled(path)
        for b in slices(batches, "text"):
            batch = Batch(machine)
            n = pa.array([count_tokens(batch, t, chunk) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), n], ["id", "n_bytes", "n_tokens"])

    text = F.col(text_col).cast("string")
    source = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    counted = per_batch(source, run, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
