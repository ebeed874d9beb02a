"""Approximate nearest neighbours by cosine, in a hierarchical k-means tree.

The tree is fitted on the driver, on a sample of at most ``most_sample`` vectors
(those with the smallest hash): spherical k-means with ``branching`` centres is
run again inside each cluster until leaves hold few enough sample vectors. Every
vector of the table is then indexed: it descends to a leaf on its executor. A
query walks the tree best bin first: a priority queue holds nodes by the cosine
of their centre, the best is opened, and leaves come out in order of promise.

How many leaves to visit is calibrated: for at most ``most_probes`` probe vectors,
which the tree was not fitted on,
the true neighbours are found by brute force over all vectors, and visits widen
one by one until the share of true neighbours in visited leaves reaches
``recall``. Each query's visits also go on until enough vectors are in them.

Only tree, leaf sizes and probes are on the driver and in broadcasts; all are
bounded by parameters. Vectors meet queries in shards of
neighbouring leaves of about ``leaf_part`` vectors, a larger leaf in parts; a shard
tells only its best for each query. Equal vectors are one entry with their
smallest ids (more than the neighbours asked for can't be in an answer), and
equal queries are asked once, so a hot vector costs no more than another.

Defined cases: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part, nor do null ids; rows with the id of
a query are its own; ties go to the smaller id; with fewer candidates than
neighbours asked for, all are given; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm.kernels import map_rows
from thicket.storage import written


def matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest component so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Tree:
    """Nodes in one array of centres; children[node] are the numbers of its nodes, leaf[node] its leaf or -1."""

    centres: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return max(self.leaf, default=-1) + 1

    @classmethod
    def fit(cls, x: np.ndarray, leaf_rows: int, branching: int = 8, turns: int = 12, seed: int = 5) -> Tree:
        rng = np.random.default_rng(seed)
        centres, children, leaf, leaves = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [[]], [-1], 0
        work = [(0, np.arange(len(x)))]
        while work:
            node, own = work.pop()
            split = cls._clusters(x[own], branching, turns, rng) if len(own) > leaf_rows else None
            if split is None:
                leaf[node], leaves = leaves, leaves + 1
                continue
            found, at = split
            for k in range(len(found)):
                children[node].append(len(centres))
                work.append((len(centres), own[at == k]))
                centres.append(found[k])
                children.append([])
                leaf.append(-1)
        return cls(np.array(centres), children, leaf)

    @staticmethod
    def _clusters(x: np.ndarray, k: int, turns: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
        start = np.unique(x, axis=0)
        if len(start) < 2:
            return None
        centres = start[rng.choice(len(start), min(k, len(start)), replace=False)]
        for _ in range(turns):
            at = (x @ centres.T).argmax(axis=1)
            used = np.unique(at)
            centres = np.array([x[at == c].sum(axis=0) for c in used])
            norms = np.linalg.norm(centres, axis=1, keepdims=True)
            centres = centres / np.where(norms > 0, norms, 1)
        at = (x @ centres.T).argmax(axis=1)
        used, at = np.unique(at, return_inverse=True)
        return (centres[used], at) if len(used) > 1 else None

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector of length 1."""
        out, work = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while work:
            node, own = work.pop()
            if self.leaf[node] >= 0:
                out[own] = self.leaf[node]
                continue
            kids = self.children[node]
            at = (x[own] @ self.centres[kids].T).argmax(axis=1)
            work += [(kid, own[at == k]) for k, kid in enumerate(kids) if (at == k).any()]
        return out

    def walk(self, near: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order; near has the cosines of all centres with the query."""
        queue = [(-near[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
            for kid in self.children[node]:
                heapq.heappush(queue, (-near[kid], kid))

    def visits(self, x: np.ndarray, most: int, sizes: np.ndarray, least: int) -> list[list[int]]:
        """The first ``most`` leaves for each vector, and more until they hold ``least`` entries."""
        out = []
        for near in x @ self.centres.T:
            own, held = [], 0
            for leaf in self.walk(near):
                if len(own) >= most and held >= least:
                    break
                own.append(leaf)
                held += int(sizes[leaf])
            out.append(own)
        return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array of doubles) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.where(fine)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == length.n) if length else rows


def nearest_in(queries: np.ndarray, entries: np.ndarray, low: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, entry and cosine of the k best entries of each query, of those that allowed (queries x entries) lets it see; entries are in order of low, their smallest id."""
    q, e = unit(queries), unit(entries)
    out = []
    for a in range(0, len(q), 256):
        near = q[a : a + 256] @ e.T
        if allowed is not None:
            near[~allowed[a : a + 256]] = -np.inf
        most = min(len(e), k + 8)
        best = np.argpartition(-near, most - 1, axis=1)[:, :most]
        # All that tie with the last of these come along, so that equal scores are told apart by id.
        bar = np.take_along_axis(near, best, axis=1).min(axis=1) - 1e-12
        rows, cols = np.nonzero((near >= bar[:, None]) & (near > -np.inf))
        out.append((rows + a, cols))
    rows, cols = (np.concatenate(x) for x in zip(*out))
    score = np.einsum("ij,ij->i", q[rows], e[cols])
    order = np.lexsort((low[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[rank < k], cols[rank < k], score[rank < k]


def truth(entries: DataFrame, probes: np.ndarray, k: int) -> list[list[tuple[float, int, int]]]:
    """(score, id, leaf) of the k nearest entries of each probe, by brute force: each batch tells its best, and their best are gathered."""
    held = entries.sparkSession.sparkContext.broadcast(probes)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        low = batch.column(1).to_numpy(zero_copy_only=False)
        order = np.argsort(low, kind="stable")
        q, e, score = nearest_in(held.value, matrix(batch.column(0))[order], low[order], k)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(low[order][e]), pa.array(batch.column(2).to_numpy(zero_copy_only=False)[order][e]), pa.array(score)], ["q", "low", "leaf", "score"])

    rows = map_rows(entries.select("v", "low", "leaf"), work, "q long, low long, leaf long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "low")
    found: list[list] = [[] for _ in probes]
    for r in rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).collect():
        found[r.q].append((r.score, r.low, r.leaf))
    return found


def calibrated(tree: Tree, probes: np.ndarray, found: list[list[tuple[float, int, int]]], recall: float) -> tuple[int, float]:
    """The least number of visits that reaches the recall on the probes, widened leaf by leaf, and that recall. A probe's own vector doesn't count."""
    ranks = []
    for near, own in zip(unit(probes) @ tree.centres.T if len(probes) else [], found):
        place = {leaf: i for i, leaf in enumerate(tree.walk(near))}
        ranks += [place[leaf] for _, _, leaf in sorted(own, key=lambda x: (-x[0], x[1]))[1:]]
    if not ranks:
        return 1, 1.0
    upto = np.cumsum(np.bincount(ranks, minlength=tree.leaves)) / len(ranks)  # the recall of 1, 2, ... visits
    visits = int(np.argmax(upto >= min(recall, upto[-1]))) + 1
    return visits, float(upto[visits - 1])


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, recall: float = 0.98, leaf_rows: int = 256, most_leaves: int = 2048, most_sample: int = 20_000, most_probes: int = 128, leaf_part: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each vector whose id is divisible by ``every``, among all others; and visits, leaves, recall: how many leaves of how many each query saw, and which recall that had on the probes."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col).distinct()
    # Of equal vectors, k + 1 ids are enough for any answer; WindowGroupLimit cuts before the shuffle.
    by_id = Window.partitionBy("v").orderBy("id")
    ids = rows.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    entries = written(ids.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("low", F.col("ids")[0]), "entries")
    total = entries.count()
    # A cut of the hashes takes nine tenths of most_sample rows, give or take a few; the driver gets these alone.
    share = 0.9 * min(1.0, most_sample / max(total, 1))
    hashed = F.pmod(F.xxhash64("v"), F.lit(1 << 40))
    sample = entries.where(hashed < int(share * (1 << 40))).select("v", "low").orderBy("low").toArrow().column("v").combine_chunks()
    x = unit(matrix(sample)) if len(sample) else np.zeros((0, 1))
    leaves = min(most_leaves, -(-total // leaf_rows))
    tree = Tree.fit(x, max(8, len(x) // max(leaves, 1)))
    held = spark.sparkContext.broadcast(tree)

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.place(unit(matrix(batch.column(0)))))], [*batch.schema.names, "leaf"])

    indexed = written(map_rows(entries, place, "v array<double>, ids array<long>, low long, leaf long"), "indexed")
    sizes = np.zeros(max(tree.leaves, 1), np.int64)
    for r in indexed.groupBy("leaf").agg(F.sum(F.size("ids")).alias("n")).collect():  # a row a leaf
        sizes[r.leaf] = r.n
    # Probes are vectors that the tree was not fitted on, the next ones by hash.
    after = min(1.0, share + 2 * most_probes / max(total, 1))
    others = entries.where((hashed >= int(share * (1 << 40))) & (hashed < int(after * (1 << 40)))).orderBy(hashed, "low").limit(most_probes).select("v").toArrow().column("v").combine_chunks()
    probes = matrix(others) if len(others) else matrix(sample)[:most_probes] if len(sample) else np.zeros((0, 1))
    visits, reached = calibrated(tree, probes, truth(indexed, probes, k + 1) if len(probes) else [], recall)
    plan = spark.sparkContext.broadcast((tree, visits, sizes))

    # Neighbouring leaves share a shard of about leaf_part entries; a leaf above that is a shard dealt into parts.
    shard_of = np.cumsum(sizes) // leaf_part
    plan = spark.sparkContext.broadcast((tree, visits, sizes, shard_of))

    def walk(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, most, held_in, shards = plan.value
        at, to, seen = [], [], []
        for i, found in enumerate(own.visits(unit(matrix(batch.column(1))), most, held_in, k + 1)):
            by = shards[found]
            for shard in np.unique(by):
                at.append(i)
                to.append(int(shard))
                seen.append([leaf for leaf, s in zip(found, by) if s == shard])
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(to, pa.int64()), pa.array(seen, pa.list_(pa.int64()))], ["q", "v", "shard", "leaves"])

    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    # Equal queries are asked once, by the smallest of their ids.
    queries = asked.groupBy("v").agg(F.min("id").alias("q"))
    visited = map_rows(queries.select("q", "v"), walk, "q long, v array<double>, shard long, leaves array<long>")
    shard_sizes = np.bincount(shard_of, weights=sizes)
    parts = F.element_at(F.lit(np.maximum(1, np.ceil(shard_sizes / (2 * leaf_part))).astype(np.int64)), F.col("shard").cast("int") + 1)
    members = indexed.withColumn("shard", F.element_at(F.lit(shard_of.astype(np.int64)), F.col("leaf").cast("int") + 1)).withColumn("part", F.pmod(F.xxhash64("low"), parts))
    visited = visited.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "ids": pd.Series(dtype=object), "low": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        right = right.sort_values("low", kind="stable")
        leaves, at = np.unique(right["leaf"].to_numpy(), return_inverse=True)
        sees = np.array([np.isin(leaves, own) for own in left["leaves"]])
        found = []
        for a in range(0, len(left), 256):  # the mask of a few queries at a time
            v = np.stack(left["v"].to_numpy()[a : a + 256])
            q, e, score = nearest_in(v, np.stack(right["v"].to_numpy()), right["low"].to_numpy(), k + 1, sees[a : a + 256][:, at])
            found.append((q + a, e, score))
        q, e, score = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"q": left["q"].to_numpy()[q], "ids": right["ids"].to_numpy()[e], "low": right["low"].to_numpy()[e], "score": score})

    met = visited.groupBy("shard", "part").cogroup(members.groupBy("shard", "part")).applyInPandas(meet, "q long, ids array<long>, low long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "low")
    met = met.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    answers = met.groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("found"))  # at most k + 1 entries
    named = asked.join(queries, "v").select("id", "q").distinct().join(answers, "q")
    flat = F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct((-f["score"]).alias("far"), i.alias("vec_id")))))
    others = F.slice(F.array_sort(F.filter(flat, lambda c: c["vec_id"] != F.col("id"))), 1, k)
    out = named.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "c"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("c.vec_id").alias("vec_id"), (-F.col("c.far")).alias("score"), F.lit(visits).alias("visits"), F.lit(tree.leaves).alias("leaves"), F.lit(reached).alias("recall"))
