"""Exact n-gram Jaccard join by token-combination prefixes, and its components.

A document is the set of hashes of its word n-grams. Let a set of n tokens lack at most t of
them in any partner (t follows from the similarity). Tokens have one order for all documents:
by the number of documents that hold them, the rarest first.

* Rare tokens are counted exactly, in parts by hash, as packed arrays. A document whose first
  t + 1 tokens are rare indexes these, one signature each: the first token that it shares with
  a partner is among them, and also in the partner's prefix. Tokens that a single document
  holds take their place in the prefix, but are nowhere to be met, so they are not emitted.
* Otherwise it indexes all its rare tokens, r of them, and, since a partner that shares none of
  these differs in at most t - r frequent ones, 2-token combinations of its first t - r + g + 1
  frequent tokens. These hold the first g + 1 shared ones; tokens are dealt by hash into g
  groups, so two of them meet in a group, and only pairs within a group are indexed. g depends
  on the band of the set's size; partners lie in the same or the next band, so each document
  indexes its own band's pairs and the next one's. Very small sets use single tokens.

Frequent are the tokens that many documents of the same batches hold; how they are chosen
changes the amount of work, never the result. Documents meet in the buckets of equal
signatures. A bucket first links its members to its hub, which settles groups of near copies
without their pairs; pairs are then made only between members that are not yet connected, and
each candidate is verified on the whole sets.

A large bucket is not enumerated while rounds are left. It is extended by one more token, out
of the tokens in which a member differs from the hub: members that are not connected are not
both similar to the hub, and if similar sets differ from a third one by more than they may
differ from each other, part of these differences is the same. So (hub, token) is a signature
again, over prefixes that the sizes of the differences allow, with buckets that hold only what
deviates from the hub in the same place; these are treated like any others, in the next round.

Documents with equal sets are one node all along. Nothing of the size of the corpus is ever
collected: links, components and sets stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import KEPT, bounded, per_batch, removed, slices, stored
from quire.llm.components import connected


@dataclass(frozen=True)
class Settings:
    """Parameters. Only ``words`` and ``percent`` change results."""

    words: int = 5
    percent: int = 75
    #: A token is frequent if the batches of documents in which at least ``in_batch`` hold it
    #: have so many holders together.
    in_batch: int = 8
    least_frequent: int = 64
    #: Frequent tokens that are broadcast at most (the most frequent are taken first).
    most_frequent: int = 200_000
    #: Members beyond which a bucket of tokens or of their pairs is split, and beyond which one
    #: that comes out of a split is split again.
    large_bucket: int = 12
    large_split: int = 256
    #: A round of signatures, then splits; the last round enumerates what is left.
    rounds: int = 5
    #: Parts that rare tokens are counted in: so many at least, of about so many tokens at most.
    least_parts: int = 256
    part_tokens: int = 6_000_000
    #: Smallest set that pairs of tokens are made for.
    least_paired: int = 16
    #: Rows up to which a table of nodes is broadcast; beyond, it is joined by a shuffle.
    most_sent: int = 500_000
    #: Bytes of hubs' sets up to which they are broadcast.
    most_sent_bytes: int = 16 << 20


_MULTIPLIERS = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 | 1 for i in range(1, 64)], dtype=np.uint64)
MOST_WORDS = 1 << 17


class WordHashes(dict):
    """64-bit hash of each word, as 8 bytes; bounded."""

    def __missing__(self, word: bytes) -> bytes:
        h = xxhash.xxh3_64_digest(word)
        if len(word) <= 64:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = h
        return h


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


KEPT.append(word_hashes.cache_clear)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """The set of hashes of a text's n-word shingles, ascending. Only A-Z are lowered; words end
    at the six ASCII white spaces. Fewer than n words make one shingle of their own length."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.frombuffer(b"".join(map(word_hashes().__getitem__, words)), dtype="<u8")
    width = min(n, len(words))
    total = np.full(len(h) - width + 1, np.uint64(width), dtype=np.uint64)
    for i in range(width):
        total += h[i : len(h) - width + 1 + i] * _MULTIPLIERS[i]
    return np.unique(mixed(total))


def node_of(tokens: np.ndarray, seed: int) -> tuple[int, bytes]:
    """A set's 64-bit name, and a 128-bit digest that tells whether two sets share the name."""
    raw = tokens.tobytes()
    return int.from_bytes(xxhash.xxh3_64_digest(raw, seed=seed), "little", signed=True), xxhash.xxh3_128_digest(raw, seed=seed)


def lacking(n: int, percent: int) -> int:
    """Tokens of a set of n that a partner may lack."""
    return n - (percent * n + 99) // 100


@lru_cache(maxsize=4)
def bands(percent: int) -> list[int]:
    """Least sizes of the bands: partners' sizes are at most one band apart."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(low[-1] * 100 // percent + 1)
    return low


def groups_of(band: int, s: Settings) -> int:
    """Groups that a band's frequent tokens are dealt into; 0: they are indexed singly.

    Fewer than the tokens that similar sets share at least, so that two of these meet in a group.
    """
    low = bands(s.percent)[band]
    return 0 if low < s.least_paired else min(max(1, lacking(low, s.percent)), low - lacking(low, s.percent) - 1)


def level_end(tokens: np.ndarray, count: int) -> int:
    """How many of the ascending ``tokens`` lie on the levels of the first ``count`` of them.

    A prefix ends with a level of the hashes, of which there are 64, so most documents that
    share a passage index the same tokens of it.
    """
    if not 0 < count < len(tokens):
        return min(max(count, 0), len(tokens))
    return int(np.searchsorted(tokens, tokens[count - 1] | np.uint64((1 << 58) - 1), side="right"))


@dataclass(frozen=True)
class Frequent:
    """Frequent tokens, ascending, and the number of holders that each was seen with."""

    tokens: np.ndarray
    times: np.ndarray


def parted(tokens: np.ndarray, frequent: Frequent, s: Settings) -> tuple[np.ndarray, int, np.ndarray]:
    """The rare tokens of a set, how many of them it need not index (the last ones in the order
    of tokens), and its signatures made of frequent tokens."""
    n = len(tokens)
    lack, rare, late = lacking(n, s.percent), tokens, tokens[:0]
    if len(frequent.tokens):
        at = np.minimum(np.searchsorted(frequent.tokens, tokens), len(frequent.tokens) - 1)
        held = frequent.tokens[at] == tokens
        rare, late = tokens[~held], tokens[held]
        late = late[np.argsort(frequent.times[at[held]], kind="stable")]
    if len(rare) > lack:
        return rare, len(rare) - lack - 1, tokens[:0]
    found, left = [], lack - len(rare)
    own = int(np.searchsorted(bands(s.percent), n, side="right")) - 1
    for band in (own, own + 1):
        g = groups_of(band, s)
        if not g:
            found.append(late[: left + 1])
            continue
        some = late[: left + g + 1]
        group = mixed(some + np.uint64(band)) % np.uint64(g)
        order = np.lexsort((some, group))  # partners may hold other tokens in between
        some, group = some[order], group[order]
        step = 1
        while step < len(some) and (same := group[step:] == group[:-step]).any():
            a, b = some[:-step][same], some[step:][same]
            found.append(mixed(a * _MULTIPLIERS[7] + b * _MULTIPLIERS[11] + np.uint64(band + 1)))
            step += 1
    return rare, 0, np.unique(np.concatenate(found)) if found else tokens[:0]


def sets_of(batches, column: str, s: Settings) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in slices(batches, column, 2 << 20):
        yield b, [shingles(t, s.words) for t in b.column(column).to_pylist()]


def surveyed(source: DataFrame, s: Settings, seed: int) -> DataFrame:
    """Of every row (id, node, digest, n), node and digest null for an empty set; and, in rows of
    their own with n null, (token, times) of the tokens that several of a batch's distinct sets hold."""

    def run(batches):
        for b, sets in sets_of(batches, "text", s):
            names = [node_of(x, seed) if len(x) else (None, None) for x in sets]
            distinct = list({d: x for (_, d), x in zip(names, sets, strict=True) if d is not None}.values())
            often, times = np.empty(0, dtype=np.uint64), np.empty(0, dtype="i8")
            if distinct:
                tokens, count = np.unique(np.concatenate(distinct), return_counts=True)
                held = count >= s.in_batch
                often, times = tokens[held], count[held]
            none, more = [None] * len(often), [None] * len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(b.column("id").to_pylist() + none, pa.int64()),
                    pa.array([n for n, _ in names] + none, pa.int64()),
                    pa.array([d for _, d in names] + none, pa.binary()),
                    pa.array(list(map(len, sets)) + none, pa.int64()),
                    pa.array(more + often.view("i8").tolist(), pa.int64()),
                    pa.array(more + times.tolist(), pa.int64()),
                ],
                ["id", "node", "digest", "n", "token", "times"],
            )

    return per_batch(source, run, "id long, node long, digest binary, n long, token long, times long")


def indexed(source: DataFrame, frequent: Frequent, parts: int, s: Settings, seed: int) -> DataFrame:
    """(signature, node) of what sets index, but for the rare tokens that one set alone holds.

    A batch deals its tokens into ``parts`` by hash and sends each part as packed arrays: 32
    bits a token, and the node once for its tokens of that part. Within a part tokens with
    these bits in common count as one, which makes them look less rare and may add a candidate;
    a prefix that would end between two of them holds both. What many documents of a batch hold is
    frequent and not sent, so no part depends on a single token. Signatures made of frequent
    tokens travel with one of the batch's parts, as they are.
    """
    often = source.sparkSession.sparkContext.broadcast(frequent)
    as_made = 2**31 - 1  # holders of a signature that is kept in any case, after all tokens

    def dealt(batches):
        seen: set[int] = set()
        for _, sets in sets_of(batches, "text", s):
            nodes, spares, rares, made = [], [], [], []
            for x in sets:
                if len(x) and (node := node_of(x, seed)[0]) not in seen:
                    seen.add(node)
                    rare, spare, found = parted(x, often.value, s)
                    nodes.append(node)
                    spares.append(spare)
                    rares.append(rare)
                    made.append(found)
            if not nodes:
                continue
            tokens, each = np.concatenate(rares), np.array(nodes, dtype="<i8")
            made, makers = np.concatenate(made).astype("<u8"), np.repeat(each, list(map(len, made)))
            if len(made):
                columns = [pa.array([int(made[0] % np.uint64(parts))], pa.int32()), *(pa.array([x], pa.binary()) for x in (b"", b"", b"", b"", made.tobytes(), makers.tobytes()))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "tokens", "runs", "nodes", "spares", "made", "makers"])
            if not len(tokens):
                continue
            part = ((tokens >> np.uint64(32)) % np.uint64(parts)).astype("i4")
            order = np.argsort(part, kind="stable")
            part, low = part[order], tokens[order].astype("<u4")
            holder = np.repeat(np.arange(len(nodes)), list(map(len, rares)))[order]
            starts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (holder[1:] != holder[:-1])])
            runs, whose = np.diff(np.r_[starts, len(low)]).astype("<u4"), holder[starts]
            node, spare = each[whose], np.array(spares, dtype="<u4")[whose]
            firsts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            at = np.searchsorted(starts, firsts)
            cut = lambda a, bounds: pa.array([a[i:j].tobytes() for i, j in zip(bounds, [*bounds[1:], len(a)], strict=True)], pa.binary())
            columns = [pa.array(part[firsts]), cut(low, firsts), cut(runs, at), cut(node, at), cut(spare, at), *(pa.array([b""] * len(firsts), pa.binary()),) * 2]
            yield pa.RecordBatch.from_arrays(columns, ["part", "tokens", "runs", "nodes", "spares", "made", "makers"])

    def counted(table: pa.Table) -> pa.Table:
        flat = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=kind)
        tokens, runs = flat("tokens", "<u4"), flat("runs", "<u4")
        order = np.argsort(tokens, kind="stable")
        ascending = tokens[order]
        starts = np.flatnonzero(np.r_[len(tokens) > 0, ascending[1:] != ascending[:-1]])
        holders = np.diff(np.r_[starts, len(tokens)])
        several = np.repeat(holders > 1, holders)
        at = order[several]
        whose = np.searchsorted(np.cumsum(runs), at, side="right")
        signature = (np.int64(table.column("part")[0].as_py()) << 32) | ascending[several].astype("i8")
        made = flat("made", "<i8")
        columns = [
            (signature, made),
            (flat("nodes", "<i8")[whose], flat("makers", "<i8")),
            (flat("spares", "<u4")[whose].astype("i4"), np.zeros(len(made), dtype="i4")),
            (np.repeat(holders, holders)[several].astype("i4"), np.full(len(made), as_made, dtype="i4")),
        ]
        return pa.table([pa.array(np.concatenate(c)) for c in columns], ["signature", "node", "spare", "holders"])

    each = per_batch(source.select("text"), dealt, "part int, tokens binary, runs binary, nodes binary, spares binary, made binary, makers binary")
    held = each.groupBy("part").applyInArrow(counted, "signature long, node long, spare int, holders int")
    own = Window.partitionBy("node")
    placed = held.withColumns({"all": F.count(F.when(F.col("holders") < as_made, 1)).over(own), "place": F.rank().over(own.orderBy("holders", "signature"))})
    return placed.where((F.col("holders") == as_made) | (F.col("place") <= F.col("all") - F.col("spare"))).select("signature", "node")


def without_copies(source: DataFrame, rows: DataFrame, sizes: DataFrame, s: Settings) -> DataFrame:
    """``source`` without rows whose set an earlier id holds, if their ids are few enough to be
    broadcast; otherwise copies count as holders, which only makes their tokens look less rare."""
    firsts = sizes.select(F.col("first").alias("id"))
    later = stored(rows.join(sizes.select("node", "first"), "node").where("id <> first").select("id").distinct().join(firsts, "id", "left_anti"), "copies")
    return source.join(F.broadcast(later), "id", "left_anti") if later.count() <= s.most_sent else source


def holding(source: DataFrame, nodes: DataFrame, sizes: DataFrame, s: Settings) -> DataFrame:
    """The rows of ``source`` among which is one of every node asked for (and rows of equal id)."""
    first = stored(nodes.join(sizes.select("node", "first"), "node").select(F.col("first").alias("id")).distinct(), "first")
    found = source.join(bounded(first.where("id IS NOT NULL"), s.most_sent), "id", "left_semi")
    if first.where("id IS NULL").limit(1).count():
        found = found.unionByName(source.where("id IS NULL"))
    return found


def token_sets(source: DataFrame, s: Settings, seed: int) -> DataFrame:
    """(node, tokens): the whole set of every node that occurs, once."""

    def run(batches):
        seen: set[int] = set()
        for _, sets in sets_of(batches, "text", s):
            nodes, raw = [], []
            for x in sets:
                if len(x) and (node := node_of(x, seed)[0]) not in seen:
                    seen.add(node)
                    nodes.append(node)
                    raw.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(raw, pa.binary())], ["node", "tokens"])

    return per_batch(source.select("text"), run, "node long, tokens binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sizes: DataFrame, source: DataFrame, s: Settings, seed: int) -> DataFrame:
    """The distinct pairs (a, b) of nodes whose whole sets are as similar as asked, stored."""
    likely = stored(pairs.distinct(), "candidates")
    nodes = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    sets = stored(token_sets(holding(source, nodes, sizes, s), s, seed), "sets")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("tokens").alias(f"t_{x}"))

    def run(batches):
        for batch in batches:
            for b in slices(slices([batch], "t_a", 8 << 20), "t_b", 8 << 20):
                keep = []
                for x, y in zip(b.column("t_a").to_pylist(), b.column("t_b").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                    if len(x) > len(y):
                        x, y = y, x
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    keep.append(100 * both >= s.percent * (len(x) + len(y) - both))
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    links = stored(per_batch(likely.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b"), run, "a long, b long"), "links")
    removed(likely)
    removed(sets)
    return links


def labelled(df: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``df`` with the label of its ``node``; a node without one is its own."""
    if labels is None:
        return df.withColumn("label", F.col("node"))
    return df.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def prefixes_apart(x: int, n: int, n_hub: int, minor: bool, s: Settings) -> tuple[int, int]:
    """Of a set of n tokens that differs from its hub in x: how many of these it indexes, and how
    many of them (the first ones) meet minor sets too; the others meet only major ones.

    Sets A and B are similar if they differ in at most c / d of n_a + n_b tokens, with
    c = 100 - percent and d = 100 + percent. With X the difference to the hub, A and B differ
    in X_a + X_b - 2 |X_a & X_b|, so X_a and X_b must share a number of tokens, which
    is at least 1 if A is minor, that is not similar to the hub: X_a > c / d (n_a + n_hub).
    """
    c, d = 100 - s.percent, 100 + s.percent
    meets_minor = x - (d * x + c * (n_hub - n)) // (2 * d)
    if not minor:
        return max(0, meets_minor), max(0, meets_minor)
    meets_any = x - -(-(d * x - c * (n + n_hub)) // (2 * d)) + 1
    return max(0, meets_minor, meets_any), max(0, meets_minor)


def end_of(parts: list[np.ndarray], count: int) -> int:
    """How many tokens of consecutive ``parts`` to index, that the first ``count`` are among them."""
    before = 0
    for p in parts:
        if count <= before + len(p):
            return before + level_end(p, count - before)
        before += len(p)
    return before


def set_apart(large: DataFrame, source: DataFrame, sizes: DataFrame, frequent: Frequent, s: Settings, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Splits buckets, given as (node, n, label, hub, n_hub, hub_label): the bucket rows of
    combinations of a hub and one token in which a member differs from it, and two tables
    that these rows are made from.

    Two members that are not connected are not both similar to the hub, so, if they are similar
    to each other, they share such tokens. What the hub lacks comes first in the order of these
    tokens, rare before frequent, since few members share it.
    """
    pairs = stored(large.where(F.col("node") != F.col("hub")).select("hub", "n_hub", "node", "n", (F.col("label") != F.col("hub_label")).alias("minor")).distinct(), "apart")
    # where all members are minor, there is nobody to meet beyond the first part of a prefix
    majors = pairs.groupBy("hub").agg(F.bool_or(~F.col("minor")).alias("majors"))
    sets = stored(token_sets(holding(source, pairs.select("node").union(pairs.select("hub")).distinct(), sizes, s), s, seed), "sets")
    often = source.sparkSession.sparkContext.broadcast(frequent.tokens)
    side = lambda x, y: sets.select(F.col("node").alias(x), F.col("tokens").alias(y))

    def run(batches):
        for batch in batches:
            for b in slices(slices([batch], "own", 4 << 20), "base", 4 << 20):
                keys, nodes, sizes_, xs, early, major = [], [], [], [], [], []
                columns = (b.column(c).to_pylist() for c in ("hub", "n_hub", "node", "n", "minor", "majors", "own", "base"))
                for hub, n_hub, node, n, minor, majors, own, base in zip(*columns, strict=True):
                    own, base = np.frombuffer(own, dtype=np.uint64), np.frombuffer(base, dtype=np.uint64)
                    x = np.setxor1d(own, base, assume_unique=True)
                    lacks, known = np.isin(x, base, assume_unique=True), np.isin(x, often.value, assume_unique=True)
                    parts = [x[~lacks & ~known], x[~lacks & known], x[lacks]]
                    all_, first = (end_of(parts, p) for p in prefixes_apart(len(x), n, n_hub, minor, s))
                    x = np.concatenate(parts)[: all_ if majors else first]
                    if len(x):
                        keys.append(mixed(x * _MULTIPLIERS[13] + np.uint64(hub % 2**64)))
                        each = len(x)
                        nodes.append(np.full(each, node))
                        sizes_.append(np.full(each, n))
                        xs.append(np.full(each, len(lacks)))
                        early.append(np.arange(each) < first)
                        major.append(np.full(each, not minor))
                if keys:
                    flat = lambda a, kind: pa.array(np.concatenate(a).astype(kind))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view("i8")), flat(nodes, "i8"), flat(sizes_, "i4"), flat(xs, "i4"), flat(early, bool), flat(major, bool)],
                        ["signature", "node", "n", "x", "early", "major"],
                    )

    full = pairs.join(majors, "hub").join(side("node", "own"), "node").join(bounded_sets(side("hub", "base"), pairs.select("hub").distinct(), s), "hub")
    rows = per_batch(full.select("hub", "n_hub", "node", "n", "minor", "majors", "own", "base"), run, "signature long, node long, n int, x int, early boolean, major boolean")
    return rows, pairs, sets


def bounded_sets(sets: DataFrame, hubs: DataFrame, s: Settings) -> DataFrame:
    """The sets of the hubs, marked for broadcast if they are small."""
    wanted = sets.join(hubs, "hub", "left_semi")
    n, tokens = wanted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("base")), F.lit(0))).first()
    return F.broadcast(wanted) if n <= s.most_sent and tokens <= s.most_sent_bytes else wanted


def linked_nodes(source: DataFrame, rows: DataFrame, sizes: DataFrame, frequent: Frequent, s: Settings, seed: int) -> DataFrame:
    """(node, label) of all nodes that have a link."""
    links, labels, spent = None, None, []
    by = Window.partitionBy("signature")
    parts = max(s.least_parts, (sizes.agg(F.sum("n")).first()[0] or 0) // s.part_tokens + 1)
    met = indexed(without_copies(source, rows, sizes, s), frequent, parts, s, seed)
    sized = (100 * F.col("n_a") >= s.percent * F.col("n_b")) & (100 * F.col("n_b") >= s.percent * F.col("n_a"))
    ends = ("node", "n")
    for turn in range(1, s.rounds + 1):
        several = met.withColumns({"low": F.min("node").over(by), "high": F.max("node").over(by)}).where("low <> high").drop("low", "high").distinct()
        if turn == 1:
            several = stored(several, "met")
            spent = [several]
            several = several.join(bounded(sizes.select("node", F.col("n").cast("int").alias("n")), s.most_sent), "node")
            several = several.withColumns({"x": F.lit(0), "early": F.lit(True), "major": F.lit(False)})
        rows = stored(labelled(several, labels), "rows")
        for done in spent:
            removed(done)
        # signatures with the same members are one bucket that weighs as many
        print_of = [F.bit_xor(F.xxhash64(F.lit(k), "node", "x", "early", "major")).alias(f"print{k}") for k in (1, 2)]
        each = rows.groupBy("signature").agg(F.count("*").alias("members"), F.min("label").alias("low"), F.max("label").alias("high"), *print_of).where("low <> high")
        classes = each.groupBy("members", "print1", "print2").agg(F.min("signature").alias("signature"), F.count("*").alias("weight"))
        buckets = stored(rows.join(classes.select("signature", "members", "weight"), "signature"), "buckets")
        removed(rows)
        # groups of near copies: every member against the bucket's hub, the member that shares most
        # in all its buckets, which in a group of copies of one text is the one nearest to that text
        shares = buckets.groupBy("node").agg(F.sum(F.col("members") * F.col("weight")).alias("shared"))
        tops = buckets.join(shares, "node").groupBy("signature").agg(F.max(F.struct("shared", *ends, "label")).alias("hub"))
        tops = stored(tops.select("signature", *(F.col(f"hub.{c}").alias(f"{c}_hub") for c in (*ends, "label"))), "hubs")
        star = buckets.join(tops, "signature").where("label <> label_hub").select(F.col("node_hub").alias("a"), F.col("node").alias("b"), F.col("n_hub").alias("n_a"), F.col("n").alias("n_b"))
        links = joined_links(links, verified(star.where(sized).select("a", "b"), sizes, source, s, seed))
        labels = connected(links)
        # what is left of a bucket: members of different components
        known = bounded(labels, s.most_sent)
        now = labelled(buckets.drop("label"), known).join(tops.select("signature", F.col("node_hub").alias("hub"), F.col("n_hub")), "signature")
        left = now.groupBy("signature").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.when(F.col("node") == F.col("hub"), F.col("label"))).alias("hub_label")).where("low <> high")
        apart = stored(now.join(left.drop("low", "high"), "signature"), "apart")
        for done in (buckets, tops):
            removed(done)
        last, bound = turn == s.rounds, s.large_bucket if turn == 1 else s.large_split
        small = apart if last else apart.where(F.col("members") <= bound)
        side = lambda df, x, *also: df.select("signature", *also, *(F.col(c).alias(f"{c}_{x}") for c in (*ends, "label", "x", "early", "major")))
        minor = side(small.where("label <> hub_label"), "a", "hub_label")
        # two minor members meet twice, from either side: once is enough
        once = (F.col("label_a") != F.col("label_b")) & ((F.col("label_b") == F.col("hub_label")) | (F.col("node_a") < F.col("node_b")))
        # at the end of a prefix of differences, only major sets are to be met
        due = (F.col("early_a") & F.col("early_b")) | (F.col("early_a") & F.col("major_a")) | (F.col("early_b") & F.col("major_b"))
        near = (100 + s.percent) * F.abs(F.col("x_a") - F.col("x_b")) <= (100 - s.percent) * (F.col("n_a") + F.col("n_b"))
        pairs = minor.join(side(small, "b"), "signature").where(sized & once & due & near)
        links = joined_links(links, verified(pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")), sizes, source, s, seed))
        large = apart.where(F.col("members") > bound)
        if last or not large.limit(1).count():
            break
        met, *spent = set_apart(large, source, sizes, frequent, s, seed)
        spent.append(apart)
    return connected(links)


def joined_links(links: DataFrame | None, fresh: DataFrame) -> DataFrame:
    return fresh if links is None else links.union(fresh)


def joined(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, n, label) of every row: rows of one label are connected by links, and a row
    without a set has a null node and label. ``node`` names the set: equal for equal sets."""
    s = settings or Settings()
    text = F.col(text_col).cast("string").cast("binary")
    source = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    for seed in range(100):
        found = stored(surveyed(source, s, seed), "survey")
        rows = found.where("n IS NOT NULL").select("id", "node", "digest", "n")
        distinct = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("digest").alias("x"), F.max("digest").alias("y"), F.max("n").alias("n"), F.min("id").alias("first"))
        sizes = stored(distinct, "sizes")
        if not sizes.where("x <> y").limit(1).count():  # else two sets share a name: name them anew
            break
    held = found.where("n IS NULL").groupBy("token").agg(F.sum("times").alias("times"))
    top = held.where(F.col("times") >= s.least_frequent).orderBy(F.desc("times"), "token").limit(s.most_frequent).select("token", "times").toPandas()
    tokens, times = top["token"].to_numpy(dtype="i8").view(np.uint64), top["times"].to_numpy(dtype="i8")
    order = np.argsort(tokens)
    labels = linked_nodes(source, rows, sizes, Frequent(tokens[order], times[order]), s, seed)
    named = rows.join(bounded(labels, s.most_sent), "node", "left")
    return named.select("id", "node", "n", F.coalesce("label", "node").alias("label"))


def components(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The component of every document under n-gram Jaccard similarity.

    Exact: two documents are linked when 100 * intersection >= percent * union of their sets
    of ``words``-word shingles. Equal sets are linked whatever their number. A null, empty or
    blank text has an empty set and is linked with nothing, so it is its own component, as is
    a document without links. Rows and ids may repeat and ids be null (the least id of a
    component ignores nulls); texts may be of any length; other columns are not read; an
    empty table gives an empty result.

    Returns (id, n_shingles long, component_id long).
    """
    rows = stored(joined(docs, settings, id_col, text_col), "labelled")
    least = rows.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("first"))
    out = rows.join(least, "label", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("first", "id").alias("component_id"))


def one_of_each(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their component, with all their columns.

    First is the least id. Rows without an id or without words stay, and rows that repeat an id
    go or stay together. The ids that go are looked up, which are few next to those that stay:
    texts move only if there are too many of them to broadcast.
    """
    s = settings or Settings()
    found = components(docs, s, id_col, text_col)
    stays = F.bool_or(F.col(id_col) == F.col("component_id"))
    gone = stored(found.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("gone id")).agg(stays.alias("stays")).where("NOT stays").select("gone id"), "gone")
    return docs.join(bounded(gone, s.most_sent), F.col(id_col).cast("long") == F.col("gone id"), "left_anti")
