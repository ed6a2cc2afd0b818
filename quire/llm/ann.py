"""Approximate nearest neighbours by cosine: inverted lists scanned a few dimensions at a time.

Vectors are normalised and rotated by one random orthogonal matrix, after which any block of
coordinates is a fair sample of a distance. Within each probed list, a query adds up squared
differences block of columns by block of columns; after each block, a hypothesis test at the
dimensions seen so far asks whether the full distance can still be among the nearest, and
candidates that fail it are abandoned. Survivors are scored exactly, on their original
components in double precision.

The index, centroids and rotation, is fitted on a bounded sample, and so is the number of lists
to probe, from the recall that it needs on that sample; every row is indexed. Equal vectors
are indexed once, with the least ids that could be asked for, so a vector that a third of all
rows share is one entry. Lists are cut into blocks and the queries into parts of bounded
size; a task meets one of each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import per_batch, stored


@dataclass(frozen=True)
class Settings:
    """Parameters; the bounds don't depend on the data."""

    #: Vectors that the index is fitted on, at most.
    most_sample: int = 20_000
    #: Sample vectors whose distances bound each query's search from the start.
    anchors: int = 2_000
    most_lists: int = 1_024
    #: Vectors of a block of a list, queries of a part.
    block: int = 20_000
    part: int = 20_000
    #: Recall that probing must reach on the sample.
    recall: float = 0.985
    #: Columns after which the test is made.
    columns: int = 16
    #: The test's strictness: larger abandons later.
    epsilon: float = 2.1
    seed: int = 7


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to between 1/2 and 1:
    changes no cosine, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row and a vector, on original components up to powers of two."""
    x, q = scaled(x), scaled(q)
    return np.einsum("ij,j->i", x, q) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("i,i->", q, q)))


@dataclass(frozen=True)
class Index:
    """What is fitted on the sample."""

    rotation: np.ndarray
    centroids: np.ndarray
    anchors: np.ndarray
    probes: int

    def lists(self, x: np.ndarray, most: int) -> np.ndarray:
        """The nearest lists of normalised vectors, nearest first."""
        near = -(x @ self.centroids.T)
        if most == 1:
            return near.argmin(axis=1)[:, None]
        return np.argsort(near, axis=1, kind="stable")[:, :most]


def fitted(sample: np.ndarray, rows: int, k: int, s: Settings) -> Index:
    """Centroids by spherical k-means, a random rotation, and the lists to probe for the wanted recall."""
    rng = np.random.default_rng(s.seed)
    x = unit(sample)
    n, dim = x.shape
    lists = int(min(s.most_lists, max(1, n // 20), max(1, round(rows**0.5))))
    centroids = x[rng.permutation(n)[:lists]]
    for _ in range(8):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    index = Index(rotation, centroids, x[: s.anchors], lists)
    asked = x[rng.permutation(n)[:500]]
    near = asked @ x.T
    nearest = np.argsort(-near, axis=1)[:, 1 : k + 1]  # the first is the query itself
    if not nearest.size:
        return index
    own, order = index.lists(x, 1)[:, 0], index.lists(asked, lists)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None, :].repeat(len(asked), 0), axis=1)
    needed = np.take_along_axis(place, own[nearest], axis=1).ravel()
    probes = int(np.quantile(needed, s.recall, method="higher")) + 1
    return Index(rotation, centroids, index.anchors, min(lists, probes))


def scan(queries: np.ndarray, bounds: np.ndarray, rows: np.ndarray, k: int, s: Settings) -> list[np.ndarray]:
    """For each query, the rows that survive: both are normalised and rotated, ``bounds`` are
    squared distances that the k nearest cannot exceed. Exact distances tighten the bound on the way."""
    dim = rows.shape[1]
    cuts = list(range(s.columns, dim, s.columns))
    first = np.ascontiguousarray(rows[:, : s.columns])
    found = []
    for q, bound in zip(queries, bounds, strict=True):
        d = first - q[: s.columns]
        left, partial, at = np.arange(len(rows)), np.einsum("ij,ij->i", d, d), s.columns
        for to in [*cuts[1:], dim] if cuts else []:
            # the partial distance at `at` columns, scaled up, against the bound widened by the test's error
            keep = partial * (dim / at) <= bound * (1 + s.epsilon / at**0.5) ** 2
            left, partial = left[keep], partial[keep]
            if not len(left):
                break
            d = rows[left, at:to] - q[at:to]
            partial = partial + np.einsum("ij,ij->i", d, d)
            at = to
        if len(left) > k:
            nearest = np.partition(partial, k - 1)[k - 1]
            left = left[partial <= min(bound, nearest) + 1e-9]
        found.append(left)
    return found


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, settings: Settings | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of each query, by cosine, among all rows but the query's own.

    Queries are the rows whose id is divisible by ``every``. Vectors that are null, zero, or
    hold a null or non-finite component take no part, nor do rows without an id or with
    another number of components than most; components may be as large or small as doubles are. Rows that share an id are each other's own.
    Ties go to the smaller id; fewer candidates than ``k`` are all returned; an empty table
    gives an empty result; other columns are not read.

    Returns (query_id long, rank int, vec_id long, score double).
    """
    s = settings or Settings()
    spark = vectors.sparkSession
    x = F.col(vector_col).cast("array<double>")
    sound = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & sound)
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.sql("SELECT 0L AS query_id, 0 AS rank, 0L AS vec_id, 0.0D AS score WHERE false")
    dim, total = sizes[0]["d"], sizes[0]["count"]

    def keyed(batches):
        # equal vectors of a batch become one row with the k + 1 least ids, and the queries among them
        for b in batches:
            ids = b.column("id").to_numpy()
            flat = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            keys, frame = [r.tobytes() for r in flat], {}
            for key, i in zip(keys, ids.tolist(), strict=True):
                frame.setdefault(key, []).append(i)
            least = [sorted(set(v))[: k + 1] for v in frame.values()]
            asked = [[i for i in v if i % every == 0] for v in frame.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(frame), pa.binary()), pa.array(least, pa.list_(pa.int64())), pa.array(asked, pa.list_(pa.int64()))], ["v", "ids", "asked"])

    met = per_batch(rows.where(F.size("x") == dim), keyed, "v binary, ids array<long>, asked array<long>")
    met = stored(met.withColumn("key", F.xxhash64("v")), "vectors")
    least = lambda lists: F.slice(F.sort_array(F.array_distinct(F.flatten(lists))), 1, k + 1)
    distinct = met.groupBy("key", "v").agg(least(F.collect_list("ids")).alias("ids"))

    sampled = distinct.orderBy("key", "v").limit(s.most_sample).collect()
    index = fitted(np.array([np.frombuffer(r["v"], dtype="f8") for r in sampled]), total, k, s)
    shared = spark.sparkContext.broadcast(index)
    # the anchors are rows too: each query starts with the nearest of them, so none ends with too few
    known = spark.sparkContext.broadcast([(np.frombuffer(r["v"], dtype="f8"), r["ids"]) for r in sampled[: s.anchors]])

    def placed(batches):
        for b in batches:
            flat = unit(np.array([np.frombuffer(v, dtype="f8") for v in b.column("v").to_pylist()]))
            own = pa.array(shared.value.lists(flat, 1)[:, 0].astype("i4")) if len(flat) else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, own], [*b.schema.names, "list"])

    indexed = stored(per_batch(distinct.select("key", "v", "ids"), placed, "key long, v binary, ids array<long>, list int"), "lists")
    lengths = {r["list"]: r["count"] for r in indexed.groupBy("list").count().collect()}  # one row for each list
    blocks = {i: -(-n // s.block) for i, n in lengths.items()}
    asked = met.where(F.size("asked") > 0).groupBy("key", "v").agg(F.min(F.array_min("asked")).alias("q"))
    asked = stored(asked, "queries")
    parts = max(1, -(-asked.count() // s.part))
    block_of = F.create_map(*(F.lit(v) for item in blocks.items() for v in item))
    pieces = indexed.withColumn("block", F.pmod("key", F.try_element_at(block_of, F.col("list"))).cast("int"))
    pieces = pieces.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def probing(batches):
        ix = shared.value
        turned_anchors = ix.anchors @ ix.rotation
        for b in batches:
            if not b.num_rows:
                continue
            flat = unit(np.array([np.frombuffer(v, dtype="f8") for v in b.column("v").to_pylist()]))
            far = 2 - 2 * (flat @ ix.rotation) @ turned_anchors.T
            k1 = min(k + 1, far.shape[1])
            bound = np.partition(far, k1 - 1, axis=1)[:, k1 - 1] if far.shape[1] > k else np.full(len(flat), 4.0)
            to = [[(int(i), c) for i in near if i in blocks for c in range(blocks[i])] for near in ix.lists(flat, ix.probes)]
            at = np.repeat(np.arange(len(flat)), [len(t) for t in to])
            goal = [x for t in to for x in t]
            for cut in range(0, len(goal), 20_000):
                rows_at = pa.array(at[cut : cut + 20_000])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("q").take(rows_at),
                        b.column("v").take(rows_at),
                        pa.array(bound[at[cut : cut + 20_000]] + 1e-9),
                        pa.array([x[0] for x in goal[cut : cut + 20_000]], pa.int32()),
                        pa.array([x[1] for x in goal[cut : cut + 20_000]], pa.int32()),
                        b.column("part").take(rows_at),
                    ],
                    ["q", "v", "bound", "list", "block", "part"],
                )

    dealt = asked.select("q", "v", F.pmod("key", F.lit(parts)).cast("int").alias("part"))
    probes = per_batch(dealt, probing, "q long, v binary, bound double, list int, block int, part int")

    def seeded(batches):
        x = np.array([v for v, _ in known.value])
        for b in batches:
            q, score, ids = [], [], []
            for i, raw in zip(b.column("q").to_pylist(), b.column("v").to_pylist(), strict=True):
                found = cosines(x, np.frombuffer(raw, dtype="f8"))
                near = np.argsort(-found, kind="stable")[: k + 1]
                q += [i] * len(near)
                score += found[near].tolist()
                ids += [known.value[j][1] for j in near]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(score, pa.float64()), pa.array(ids, pa.list_(pa.int64()))], ["q", "score", "ids"])

    seeds = per_batch(asked.select("q", "v"), seeded, "q long, score double, ids array<long>")

    def searched(key, queries: pd.DataFrame, rows_: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"q": pd.Series(dtype="i8"), "score": pd.Series(dtype="f8"), "ids": pd.Series(dtype=object)})
        if queries.empty or rows_.empty:
            return empty
        ix = shared.value
        x = np.array([np.frombuffer(v, dtype="f8") for v in rows_["v"]])
        qs = np.array([np.frombuffer(v, dtype="f8") for v in queries["v"]])
        out_q, out_score, out_ids = [], [], []
        survivors = scan(unit(qs) @ ix.rotation, queries["bound"].to_numpy(), unit(x) @ ix.rotation, k + 1, s)
        for q, v, left in zip(queries["q"].tolist(), qs, survivors, strict=True):
            if len(left):
                out_q += [q] * len(left)
                out_score += cosines(x[left], v).tolist()
                out_ids += rows_["ids"].iloc[left].tolist()
        return pd.DataFrame({"q": out_q, "score": out_score, "ids": out_ids}) if out_q else empty

    on = ["list", "block", "part"]
    hits = probes.groupBy(*on).cogroup(pieces.select("v", "ids", *on).groupBy(*on)).applyInPandas(searched, "q long, score double, ids array<long>")
    order = [F.desc("score"), F.asc("id")]
    each = hits.unionByName(seeds).select("q", "score", F.explode("ids").alias("id")).groupBy("q", "id").agg(F.max("score").alias("score"))
    best = each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("r") <= k + 1)
    lists = best.groupBy("q").agg(F.collect_list(F.struct("score", "id")).alias("near"))  # k + 1 at most
    members = met.where(F.size("asked") > 0).select("key", "v", F.explode("asked").alias("query_id")).distinct()
    mine = members.join(asked, ["key", "v"]).select("query_id", "q").join(lists, "q")
    others = F.filter("near", lambda n: n["id"] != F.col("query_id"))
    ranked = F.slice(F.array_sort(others, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["id"] < b["id"], -1).otherwise(1)), 1, k)
    return mine.select("query_id", F.posexplode(ranked).alias("rank", "n")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("vec_id"), F.col("n.score").alias("score")
    )
