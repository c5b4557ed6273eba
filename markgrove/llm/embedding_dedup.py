"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Vectors are told apart by label (and length), equal ones collapse to one node with a multiplicity and a number of its own (numbers
ascend with the least identifier of a node), and the nodes are dealt into shards of bounded size by a hash of that number. Each shard becomes a graph; every block of vectors is searched in every
shard of its label. Links found are verified by cosine in double precision and united; within a united group all cosines are
taken, so a group larger than the beam is counted whole. The beam of the searches is widened until an audit of the counts
against brute force reaches AUDIT_RECALL. A unit of work hands on the number of links of each vector and the edges of a local
spanning forest, never all pairs of a group; components are then united over all units.

Defined results: a null label or identifier, and vectors that are null, empty, zero or hold null or non-finite components, link
with nothing; equal vectors link (each counts); rows that repeat an identifier are vectors of their own, each with its own
links and component, whether their labels and contents are equal or not; vectors of different lengths do not link; an empty
table stays empty; other columns, whatever their names, are not carried.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, tune

THRESHOLD = 0.98

#: Least vectors of a shard (expected) and most bytes of its vectors; neighbours kept per node and layer (twice at the bottom), beam while building.
SHARD, SHARD_BYTES, NEIGHBOURS, BUILD_BEAM = 8192, 64 << 20, 12, 40

#: Most partitions of the building and searching stages.
MAX_PARTITIONS = 20_000

#: First beam of a search, vectors audited per unit and the recall to reach.
BEAM, AUDIT, AUDIT_RECALL = 16, 128, 0.999


class Graph:
    """A navigable small-world graph over the rows of unit vectors (float32)."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray] | None = None):
        self.v, self.levels, n = vectors, levels, len(vectors)
        #: links[l][i]: neighbours of i in layer l, padded with -1
        self.links = links or [np.full((n, NEIGHBOURS * (2 if lv == 0 else 1)), -1, dtype=np.int32) for lv in range(int(levels.max()) + 1)]
        self.seen, self.stamp = np.zeros(n, dtype=np.int64), 0
        self.entry = int(np.argmax(levels))

    def search(self, q: np.ndarray, start: list[int], beam: int, layer: int) -> list[tuple[float, int]]:
        """The best `beam` rows found from start, best last."""
        self.stamp += 1
        seen, links, v = self.seen, self.links[layer], self.v
        best = [(float(s), i) for s, i in zip((v[start] @ q).tolist(), start, strict=True)]
        seen[start] = self.stamp
        todo = [(-s, i) for s, i in best]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) >= beam and -s < best[0][0]:
                break
            near = links[i]
            near = near[near >= 0]
            near = near[seen[near] != self.stamp]
            if not len(near):
                continue
            seen[near] = self.stamp
            for sim, j in zip((v[near] @ q).tolist(), near.tolist(), strict=True):
                if len(best) < beam:
                    heapq.heappush(best, (sim, j))
                elif sim > best[0][0]:
                    heapq.heapreplace(best, (sim, j))
                else:
                    continue
                heapq.heappush(todo, (-sim, j))
        return sorted(best)

    def chosen(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of candidates by similarity, those that are nearer to the new node than to any taken before; the rest fills up."""
        ids = np.array([i for _, i in reversed(found)])
        sims = np.array([s for s, _ in reversed(found)])
        if len(ids) <= most:
            return ids.tolist()
        between = self.v[ids] @ self.v[ids].T
        taken, closest = [], np.full(len(ids), -2.0)
        for k in range(len(ids)):
            if sims[k] > closest[k]:
                taken.append(k)
                if len(taken) == most:
                    break
                np.maximum(closest, between[k], out=closest)
        spare = set(taken)
        taken += [k for k in range(len(ids)) if k not in spare][: most - len(taken)]
        return ids[taken].tolist()

    def connect(self, i: int, others: list[int], layer: int) -> None:
        links = self.links[layer]
        links[i, : len(others)] = others
        for j in others:
            row = links[j]
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = i
            else:
                ids = [*row.tolist(), i]
                near = sorted(zip((self.v[ids] @ self.v[j]).tolist(), ids, strict=True))
                row[:] = self.chosen(near, len(row))

    def build(self) -> Graph:
        self.entry, height = 0, int(self.levels[0])
        for i in range(1, len(self.v)):
            q, level, start = self.v[i], int(self.levels[i]), [self.entry]
            for layer in range(height, level, -1):
                start = [self.search(q, start, 1, layer)[-1][1]]
            for layer in range(min(level, height), -1, -1):
                found = self.search(q, start, BUILD_BEAM, layer)
                self.connect(i, self.chosen(found, NEIGHBOURS), layer)
                start = [j for _, j in found[-8:]]
            if level > height:
                self.entry, height = i, level
        return self

    def near(self, q: np.ndarray, beam: int, floor: float) -> list[int]:
        """Rows found whose similarity is at least floor."""
        start = [self.entry]
        for layer in range(int(self.levels[self.entry]), 0, -1):
            start = [self.search(q, start, 1, layer)[-1][1]]
        return [i for s, i in self.search(q, start, beam, 0) if s >= floor]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _levels(ids: np.ndarray) -> np.ndarray:
    """A layer for each id, geometric, from a hash of the id."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return np.floor(-np.log(u) / math.log(NEIGHBOURS)).astype(np.int32)


class Forest:
    """Union-find over any hashable nodes; the least node of a tree is its root."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def top(self, x: int) -> int:
        root = self.root
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = root[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.top(x), self.top(y)
        if a != b:
            self.root[max(a, b)] = min(a, b)


def planted(exact: np.ndarray, rows: np.ndarray, threshold: float) -> np.ndarray:
    """Perturbed copies of rows (unit, double), each by a fixed random direction to a cosine between threshold and 1 with its row."""
    rng = np.random.default_rng(len(exact))
    v, aside = exact[rows], rng.normal(size=(len(rows), exact.shape[1]))
    aside -= (aside * v).sum(axis=1, keepdims=True) * v
    size = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
    cosine = 1 - (1 - threshold) * rng.uniform(0.05, 0.95, size=(len(rows), 1))
    return np.where(size > 1e-9, cosine * v + np.sqrt(1 - cosine * cosine) * aside / np.maximum(size, 1e-9), v)


def search_unit(graph: Graph, ids: np.ndarray, times: np.ndarray, exact: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, threshold: float, beam: int = BEAM) -> tuple[np.ndarray, Forest, int]:
    """For each query (unit rows, double) its number of links with the shard (by times, itself left out), the forest of what is linked, and the beam.

    The graph finds neighbours; what they link is united; within a united group all cosines are then taken, so that a group
    larger than the beam is counted whole. The audit holds AUDIT queries and AUDIT perturbed copies of shard rows, each of
    which has a link at least, against brute force, each by its own recall, so that a large group does not outweigh a pair
    and no beam passes on queries without links. The beam doubles until the mean recall is reached, and a beam as large as
    the shard is brute force.
    """
    n, single = len(ids), queries.astype(np.float32)
    mixed = [np.argsort(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")[:AUDIT] for x in (query_ids, ids)]
    copies = planted(exact, mixed[1], threshold)
    single_copies = copies.astype(np.float32)
    linked = (queries[mixed[0]] @ exact.T >= threshold) & (query_ids[mixed[0]][:, None] != ids[None, :])
    truth = linked @ times
    copied = copies @ exact.T >= threshold
    copied_truth = copied @ times
    row_of, query_of = ({i: k for k, i in enumerate(x.tolist())} for x in (ids, query_ids))
    while True:
        forest = Forest()
        if beam >= n:
            for at in range(0, len(queries), 512):
                for k, j in zip(*np.nonzero(queries[at : at + 512] @ exact.T >= threshold), strict=True):
                    forest.join(int(query_ids[at + k]), int(ids[j]))
        else:
            for k, q in enumerate(query_ids.tolist()):
                near = np.array(graph.near(single[k], beam, threshold - 1e-4), dtype=np.int64)
                for j in ids[near[exact[near] @ queries[k] >= threshold]].tolist() if len(near) else ():
                    forest.join(q, j)
        groups: dict[int, list[int]] = {}
        for x in list(forest.root):
            groups.setdefault(forest.top(x), []).append(x)
        counts = np.zeros(len(query_ids), dtype=np.int64)
        for members in groups.values():
            if len(members) > 1:
                rows = np.array([row_of[x] for x in members if x in row_of], dtype=np.int64)
                asks = np.array([query_of[x] for x in members if x in query_of], dtype=np.int64)
                for part in (asks[i : i + 512] for i in range(0, len(asks), 512)):
                    hit = (queries[part] @ exact[rows].T >= threshold) & (query_ids[part][:, None] != ids[rows][None, :])
                    counts[part] = hit @ times[rows]
        if beam >= n:
            return counts, forest, beam
        some = truth > 0
        recalls = (counts[mixed[0]][some] / truth[some]).tolist()
        for k, q in enumerate(single_copies):
            near = [j for j in graph.near(q, beam, threshold - 1e-4) if copied[k, j]]
            reached = {row_of[x] for top in {forest.top(i) for i in ids[near].tolist() if i in forest.root} for x in groups[top] if x in row_of}
            got = np.array(sorted(reached.union(near)), dtype=np.int64)
            recalls.append(float(times[got[copied[k, got]]].sum() / copied_truth[k]) if copied_truth[k] else 1.0)
        if sum(recalls) >= AUDIT_RECALL * len(recalls):
            return counts, forest, beam
        beam *= 2


def _graph_row(table: pa.Table) -> pa.Table:
    ids = table.column("node").to_numpy()
    order = np.argsort(ids.astype(np.uint64) * np.uint64(0xA0761D6478BD642F), kind="stable")
    ids, times = ids[order], table.column("times").to_numpy()[order]
    flat = np.stack(table.column("embedding").to_pylist()).astype(np.float64)[order]
    exact = unit(flat)
    graph = Graph(exact.astype(np.float32), _levels(ids)).build()
    first = {k: table.column(k)[0] for k in ("label", "dim", "shard")}
    blobs = {"ids": ids.tobytes(), "times": times.tobytes(), "vectors": exact.tobytes(), "levels": graph.levels.tobytes(), "links": b"".join(x.tobytes() for x in graph.links)}
    return pa.table({**{k: pa.array([x.as_py()], type=x.type) for k, x in first.items()}, **{k: pa.array([b], type=pa.binary()) for k, b in blobs.items()}})


def _search_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, times, levels = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["times"], dtype=np.int64), np.frombuffer(row["levels"], dtype=np.int32)
            exact = np.frombuffer(row["vectors"], dtype=np.float64).reshape(len(ids), -1)
            flat, at, links = np.frombuffer(row["links"], dtype=np.int32), 0, []
            for layer in range(int(levels.max()) + 1):
                width = NEIGHBOURS * (2 if layer == 0 else 1)
                links.append(flat[at : at + width * len(ids)].reshape(len(ids), width))
                at += width * len(ids)
            query_ids = np.frombuffer(row["query_ids"], dtype=np.int64)
            queries = np.frombuffer(row["queries"], dtype=np.float64).reshape(len(query_ids), -1)
            graph = Graph(exact.astype(np.float32), levels, links)
            counts, forest, _ = search_unit(graph, ids, times, exact, queries, query_ids, THRESHOLD)
            edges = [(x, y) for x in list(forest.root) if (y := forest.top(x)) != x]
            some = np.flatnonzero(counts)
            rows_a = query_ids[some].tolist() + [x for x, _ in edges]
            rows_n = counts[some].tolist() + [0] * len(edges)
            rows_b = [None] * len(some) + [y for _, y in edges]
            yield pa.RecordBatch.from_arrays([pa.array(rows_a, type=pa.int64()), pa.array(rows_n, type=pa.int64()), pa.array(rows_b, type=pa.int64())], names=["a", "n", "b"])


def classes(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of embeddings."""
    spark = tune(embeddings.sparkSession)
    scratch = Scratch(spark, "hnsw")
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
            & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    valid = scratch.table(vectors.where(F.coalesce(good, F.lit(False))).withColumn("same", F.md5(F.to_json("embedding"))), "valid")
    nodes = valid.groupBy("label", "same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.any_value("embedding").alias("embedding"))
    nodes = scratch.table(nodes.withColumn("dim", F.size("embedding")), "nodes")
    # in the order of identifiers, so that the least node of a component has its least identifier
    nodes = scratch.table(nodes.orderBy("rep", "label", "same").withColumn("node", F.monotonically_increasing_id()), "numbered")
    # shards grow with the square root of their label, as all blocks meet all shards, up to what a task may hold
    size = F.least(F.greatest(F.lit(SHARD), 64 * F.sqrt("n")), F.greatest(F.lit(SHARD), SHARD_BYTES / (8 * F.col("dim"))))
    counts = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", F.ceil(F.col("n") / size).cast("int").alias("shards"))
    counts = scratch.table(counts, "counts")
    dealt = nodes.join(counts, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    schema = "label string, dim int, shard int, ids binary, times binary, vectors binary, levels binary, links binary"
    # building and searching take long for their bytes, so partitions are numbered by shards and units, not merged by size
    shards, units_n = counts.agg(F.sum("shards"), F.sum(F.col("shards") * F.col("shards"))).first()
    dealt = dealt.select("label", "dim", "shard", "node", "times", "embedding").repartition(min(2 * int(shards or 1), MAX_PARTITIONS), "label", "dim", "shard")
    graphs = scratch.table(dealt.groupBy("label", "dim", "shard").applyInArrow(_graph_row, schema), "graphs")
    blocks = graphs.select("label", "dim", F.col("shard").alias("block"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    spread = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    units = counts.select("label", "dim", "shards", spread.alias("shard")).select("label", "dim", "shard", spread.alias("block"))
    work = units.join(graphs, ["label", "dim", "shard"]).join(blocks, ["label", "dim", "block"])
    work = work.repartition(min(2 * int(units_n or 1), MAX_PARTITIONS), "label", "dim", "shard", "block").select("ids", "times", "vectors", "levels", "links", "query_ids", "queries")
    found = scratch.table(work.mapInArrow(_search_units, "a long, n long, b long"), "found")
    of = components(found.where("b is not null").select("a", "b"), scratch)
    links = found.groupBy("a").agg(F.sum("n").alias("far"))
    least = nodes.select(F.col("node").alias("component_id"), F.col("rep").alias("least"))
    of = of.join(least, "component_id").select(F.col("id").alias("node"), "least")
    known = nodes.select("label", "same", "node", "rep", "times").join(of, "node", "left").join(links.withColumnRenamed("a", "node"), "node", "left")
    known = known.select("label", "same", (F.col("times") - 1 + F.coalesce("far", F.lit(0))).alias("n"), F.coalesce("least", "rep").alias("component"))
    known = valid.select("vec_id", "label", "same").join(known, ["label", "same"]).select("vec_id", "n", "component")
    rest = vectors.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component"))
    out = known.unionByName(rest)
    return out.select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.col("component").eqNullSafe(F.col("vec_id")).alias("kept"))


#: classes() in DuckDB: all pairs of a label, and the rows that each row reaches. For small tables.
SQL = f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), reach(a, b) AS (
  SELECT r, r FROM v UNION SELECT reach.a, l.b FROM reach JOIN links l ON reach.b = l.a
), c AS (
  SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a
), n AS (
  SELECT a AS r, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, coalesce(vec_id = component_id, vec_id IS NULL AND component_id IS NULL) AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)
"""
