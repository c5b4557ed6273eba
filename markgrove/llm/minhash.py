"""Near-duplicate documents by BagMinHash over weighted word shingles.

A document is the multiset of its five-word shingles. Signatures follow BagMinHash: each shingle owns Poisson processes
over its discretised weight, in a hierarchy of dyadic weight intervals [0,1), [1,2), [2,4), [4,8) ...; a point has a time,
a register and a position in the interval, and counts if its position lies below the shingle's weight. Each register keeps
its earliest point, so two documents agree in a register with the probability of their weighted Jaccard similarity. A
shingle stops producing points once its time is later than all registers of the document, which is what makes it quick.

Bands of registers give candidate buckets. A bucket is not expanded into pairs: it falls into parts by a hash of its members, as
many as the root of the corpus, the members of a part are verified against its hub (exact weighted Jaccard of the whole texts)
and the hubs of the parts against one of them; so no step gathers a large bucket in one task. In a bucket whose parts have one
member each, that hub has met all and is done with; buckets whose members are one component are done too, and the rest choose
other hubs. What is left after HUB_ROUNDS goes through blocks: each bucket is cut into
blocks of bounded bytes and every pair of blocks goes through a kernel, which rules out by whole signatures, verifies the rest
exactly and hands on a spanning forest of the links only. So no bucket is capped. What remains quadratic is a bucket of many
documents that are not near copies of each other and of no hub: each of its B rows meets all blocks of its bucket.

A pair of similarity 0.8 is missed if it shares no band (3.3e-5) or, in a block only, if its estimate falls short by 4.5 standard
deviations (1.4e-5 for that pair); a link that is missed matters only where no other path joins its two documents.

Defined results: documents are told apart by doc_id (in classes() rows of one id are one document, which matches if any of its
texts does; keep_one() tells different texts of one id apart); texts of fewer than five words are one shingle; a text without
words, a null text and a null id match nothing (class: the id itself, kept); equal texts are one class whatever their number;
texts of any length are read whole, in one task each; an empty table stays empty; other columns, whatever their names, pass
through keep_one() and are not carried by classes().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.parse import spread
from .common import HASHES, Scratch, components, mix64, tune

SHINGLE, THRESHOLD = 5, 0.8

#: At similarity 0.8 a pair shares no band with probability (1 - 0.8**ROWS)**BANDS = 3.3e-5.
BANDS, ROWS = 26, 5

#: Hub rounds before the rest goes through blocks; members of a hub that are verified together (expected); bytes of signatures and
#: hashes of one block (expected); by how much an estimate may fall short there (4.5 standard deviations of 130 registers at 0.8).
HUB_ROUNDS, HUB_PART, BLOCK_BYTES, SLACK = 2, 512, 8 << 20, 0.16

MASK40 = np.uint64((1 << 40) - 1)
U = np.uint64


#: Odd multipliers of the words of a shingle, by position.
FACTORS = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle, in text order."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    total, starts = int(sizes.sum()), np.cumsum(sizes) - sizes
    words = np.fromiter((h for t in texts for h in map(HASHES.__getitem__, t)), dtype=np.uint64, count=total)
    padded = np.concatenate([words, np.zeros(SHINGLE, dtype=np.uint64)])
    h = sum(padded[k : k + total] * FACTORS[k] for k in range(SHINGLE)) if total else words
    doc = np.repeat(np.arange(len(texts)), sizes)
    start = np.arange(total) + SHINGLE <= np.repeat(starts + sizes, sizes)
    for i in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)).tolist():  # a short text is one shingle of all its words
        at, n = int(starts[i]), int(sizes[i])
        start[at] = True
        h[at] = (words[at : at + n] * np.array(FACTORS[:n])).sum() + U(n)
    return doc[start], mix64(h[start])


def weighted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features (document, 40-bit hash) and how often each occurs."""
    key = np.sort((doc.astype(np.uint64) << U(40)) | (h >> U(24)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
    return (key[new] >> U(40)).astype(np.int64), key[new] & MASK40, np.diff(np.append(new, len(key)))


def signatures(doc: np.ndarray, feature: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """BagMinHash signatures, uint32[n_docs, m]. Documents without features keep the highest value everywhere."""
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    at = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    rate = np.where(level == 0, 1.0, np.exp2(level - 1))  # the length of its interval
    low = np.where(level == 0, 0.0, rate)
    part = np.minimum(1.0, (weight[at] - low) / rate)  # of the interval below the weight
    d, seed, t = doc[at], mix64(feature[at] * U(0x9E3779B97F4A7C15) + level.astype(np.uint64)), np.zeros(len(at))
    best = np.full(n_docs * m, np.iinfo(np.uint64).max, dtype=np.uint64)
    latest, step = np.zeros(n_docs, dtype=np.uint64), 0
    while len(d):
        step += 1
        x = mix64(seed + U(step * 0xD1342543DE82EF95 & (1 << 64) - 1))
        y = mix64(x)
        t = t - np.log(((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        time = t.astype(np.float32).view(np.uint32).astype(np.uint64) << U(32)
        register = (((y >> U(40)) * U(m)) >> U(24)).astype(np.int64)
        hit = np.ones(len(d), dtype=bool)
        cut = np.flatnonzero(part < 1)  # elsewhere the whole interval lies below the weight
        hit[cut] = ((mix64(y[cut] ^ U(0x9E3779B97F4A7C15)) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53 < part[cut]
        np.minimum.at(best, (d * m + register)[hit], (time | (y & U(0xFFFFFFFF)))[hit])
        alive = d[np.concatenate([[True], d[1:] != d[:-1]])]  # d is in order
        latest[alive] = best.reshape(n_docs, m)[alive].max(axis=1)
        go = time <= latest[d]
        d, seed, t, rate, part = d[go], seed[go], t[go], rate[go], part[go]
    return (best & U(0xFFFFFFFF)).astype(np.uint32).reshape(n_docs, m)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, int64[n, BANDS]."""
    rows = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(ROWS):
        h = mix64(h * U(0x9E3779B97F4A7C15) + rows[:, :, k])
    return h.view(np.int64)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of hashes with repeats: the sum of the lesser over the sum of the greater counts."""
    (x, p), (y, q) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(p[i], q[j]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def blocks(texts: list[str | None], most: int = 150_000) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Runs of documents of at most so many words (or one longer document), as (first row, word lists)."""
    start, size, run = 0, 0, []
    for i, text in enumerate(texts):
        words = split(text)
        if run and size + len(words) > most:
            yield start, run
            start, size, run = i, 0, []
        run.append(words)
        size += len(words)
    if run:
        yield start, run


def sketch(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Number of shingles and signature of each text."""
    sizes, parts = [np.zeros(0, dtype=np.int64)], [np.zeros((0, BANDS * ROWS), dtype=np.uint32)]
    for _, run in blocks(texts):
        doc, h = shingles(run)
        parts.append(signatures(*weighted(doc, h), len(run), BANDS * ROWS))
        sizes.append(np.bincount(doc, minlength=len(run)))
    return np.concatenate(sizes), np.concatenate(parts)


def _sketches(docs: DataFrame) -> DataFrame:
    """id, content (null without words), size, bands of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, signature = sketch(batch.column("text").to_pylist())
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(signature).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("content"), pa.array(size), keys], names=["id", "content", "size", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.md5("text").alias("content"), "text").where("id is not null and text is not null")
    return spread(rows).mapInArrow(run, "id long, content string, size long, bands array<long>").where("size > 0")


def _verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) of the pairs (id, hub, n: members of the hub's bucket) whose texts reach the threshold.

    A hub's text moves once for each part of its members, so a hub of very many members is not one task's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray] = (None, np.zeros(0, dtype=np.uint64))
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                if last[0] != y:
                    last = (y, shingles([split(y)])[1])
                good.append(weighted_jaccard(shingles([split(x)])[1], last[1]) >= THRESHOLD)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hub")], names=["a", "b"]).filter(pa.array(good))

    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / HUB_PART)).cast("int").alias("part")
    pairs = scratch.table(pairs.groupBy("id", "hub").agg(F.max("n").alias("n")).select("id", "hub", part), "pairs")
    members = pairs.join(texts.select("id", F.col("text").alias("x")), "id")
    hubs = pairs.select("hub", "part").distinct().join(texts.select(F.col("id").alias("hub"), F.col("text").alias("y")), "hub")
    both = members.join(hubs.hint("merge"), ["hub", "part"])
    return scratch.table(both.select("id", "hub", "x", "y").mapInArrow(run, "a long, b long"), "links")


def multiset_overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum of the lesser counts of two multisets, each as sorted distinct hashes and counts."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0]
    return int(np.minimum(a[1][at[same]], b[1][same]).sum())


def block_links(band: int, ids: np.ndarray, of: np.ndarray, size: np.ndarray, signature: np.ndarray, hashes: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links between rows `left` and rows `right` that join different components: a spanning forest of them, no more.

    A pair whose registers agree in an earlier band is left to that band. Estimates rule out what is far below the
    threshold; the rest is verified by the exact weighted Jaccard, likeliest first, unless it has been joined meanwhile.
    """
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = root[x]
        return x

    rows, cols, estimates = [], [], []
    for i in left.tolist():
        agree = signature[right] == signature[i]
        share = agree.mean(axis=1)
        near = (share >= THRESHOLD - SLACK) & (of[right] != of[i]) & (np.minimum(size[right], size[i]) >= THRESHOLD * np.maximum(size[right], size[i]))
        if near.any():
            at = np.flatnonzero(near)
            first = agree[at].reshape(len(at), BANDS, ROWS).all(axis=2).argmax(axis=1)
            at = at[first == band]
            rows.append(np.full(len(at), i))
            cols.append(right[at])
            estimates.append(share[at])
    if not rows:
        return []
    i_s, j_s, estimate = np.concatenate(rows), np.concatenate(cols), np.concatenate(estimates)
    sets = {int(k): np.unique(hashes[k], return_counts=True) for k in np.unique(np.concatenate([i_s, j_s]))}
    out = []
    for k in np.argsort(-estimate, kind="stable").tolist():
        i, j = int(i_s[k]), int(j_s[k])
        a, b = top(int(of[i])), top(int(of[j]))
        if a != b:
            both = multiset_overlap(sets[i], sets[j])
            if both >= THRESHOLD * (len(hashes[i]) + len(hashes[j]) - both):
                root[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[j])))
    return out


def _rest_links(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between different components that share a bucket, block by block. rest: key, band, id, size, of."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("text").to_pylist()
            _, signature = sketch(words)
            hashes = [shingles([split(t)])[1].tobytes() for t in words]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in signature], type=pa.binary()), pa.array(hashes, type=pa.binary())], names=["id", "signature", "hashes"])

    own = texts.join(rest.select("id").distinct(), "id").mapInArrow(sketched, "id long, signature binary, hashes binary")
    n = rest.groupBy("key").agg(F.ceil(F.sum(8 * F.col("size") + 4 * BANDS * ROWS) / BLOCK_BYTES).cast("int").alias("n"))
    each = rest.join(n, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).join(own, "id")
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    units = each.select("key", "band", "id", "size", "of", "signature", "hashes", "block", other).select("*", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q")).drop("other")

    def compare(table: pa.Table) -> pa.Table:
        band, block, of, size, ids = (table.column(c).to_numpy() for c in ("band", "block", "of", "size", "id"))
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint32).reshape(len(ids), -1)
        hashes = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("hashes")]
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        links = block_links(int(band[0]), ids, of, size, signature, hashes, left, right)
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, type=pa.int64()), "b": pa.array(b, type=pa.int64())})

    return units.groupBy("key", "p", "q").applyInArrow(compare, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least id of the class), n_shingles, kept: one row per row of docs."""
    spark = tune(docs.sparkSession)
    scratch = Scratch(spark, "minhash")
    sketches = scratch.table(_sketches(docs), "sketches")
    # a part at a time, so that a text of very many copies is not one task's
    part = F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(max(1, math.isqrt(sketches.count())))).cast("int").alias("part")
    slim = sketches.select("id", "content", "size", part)
    least = slim.groupBy("content", "part").agg(F.min("id").alias("least"))
    first = least.join(least.groupBy("content").agg(F.min("least").alias("rep")), "content").select("content", "part", "rep")
    copies = scratch.table(slim.join(first, ["content", "part"]).select("id", "rep", "content", "size"), "copies")
    # one document of each text stands for its copies
    reps = copies.where("id = rep").select("id", "content").distinct()
    banded = sketches.join(reps, ["id", "content"], "left_semi").select("id", "size", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    # shared keys and their documents grow with the corpus, so these two joins are by shuffle at every size
    buckets = scratch.table(banded.join(shared.hint("merge"), "key"), "buckets")
    # the texts of all documents that share a bucket, fetched once
    texts = scratch.table(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(buckets.select("id").distinct().hint("merge"), "id"), "texts")
    links = copies.where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found: DataFrame | None = None
    rest, of = buckets.select("key", "band", part, "id", "size", F.col("id").alias("of")), None
    for turn in range(HUB_ROUNDS + 1):
        if rest.isEmpty():
            break
        if turn == HUB_ROUNDS:
            new = scratch.table(_rest_links(rest, texts), "links")
            found = new if found is None else found.union(new)
            break
        hub = F.min(F.struct(F.xxhash64(F.lit(turn), "id").alias("order"), "id", "size", "of")).alias("hub")
        parts = rest.groupBy("key", "part").agg(hub, F.count("*").alias("n"))
        tops = parts.groupBy("key").agg(F.min("hub").alias("top"), F.count("*").alias("n_parts"), F.max("n").alias("most"))
        hubs = scratch.table(parts.join(tops, "key"), "hubs")
        of_part = rest.join(hubs, ["key", "part"]).select(F.struct("id", "size", "of").alias("x"), F.col("hub").alias("y"), "n")
        of_hubs = hubs.select(F.struct("hub.id", "hub.size", "hub.of").alias("x"), F.col("top").alias("y"), F.col("n_parts").alias("n"))
        pairs = of_part.union(of_hubs).where(f"x.id != y.id and x.of != y.of and least(x.size, y.size) >= {THRESHOLD} * greatest(x.size, y.size)")
        new = _verified(pairs.select("x.id", F.col("y.id").alias("hub"), "n"), texts, scratch)
        of = scratch.table(components(new if found is None else found.union(new), scratch), "components")
        found = of.where("id != component_id").select(F.col("id").alias("a"), F.col("component_id").alias("b"))  # a star of each component stands for its links
        left = rest.drop("of").join(hubs.select("key", "part", F.when(F.col("most") == 1, F.col("top.id")).alias("done")), ["key", "part"]).where("done is null or id != done")
        left = scratch.table(left.join(of, "id", "left").select("key", "band", "part", "id", "size", F.coalesce("component_id", "id").alias("of")), "left")
        many = left.groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low < high").select("key")
        rest = scratch.table(left.join(hubs.select("key", "part").join(many, "key"), ["key", "part"]).select("key", "band", "part", "id", "size", "of"), "rest")
    if found is not None:
        links = links.union(found)
    of = components(links, scratch).withColumnRenamed("component_id", "class_id")
    sizes = copies.groupBy("id").agg(F.max("size").alias("n_shingles"))
    of = scratch.table(sizes.join(of, "id", "left").select("id", "n_shingles", F.coalesce("class_id", "id").alias("class_id")), "classes")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = own.join(of, own["doc_id"] == of["id"], "left")
    class_id = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), class_id.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, that of the least id, with docs' columns; rows of a null id all stay.

    Where ids repeat, each different text of an id is a document of its own (the least digest first), and of rows of equal id and
    text the one of the least JSON stays.
    """
    scratch, names = Scratch(docs.sparkSession, "keep"), docs.columns
    row = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    again = row.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        gone = classes(row.select(F.col("id").alias("doc_id"), "text")).where("not kept").select(F.col("doc_id").alias("id"))
        return row.join(gone, "id", "left_anti").select("row.*")
    row = row.withColumn("digest", F.coalesce(F.md5("text"), F.lit("")))
    numbered = row.where("id is not null").select("id", "digest").distinct().orderBy("id", "digest").withColumn("key", F.monotonically_increasing_id())
    keyed = scratch.table(row.join(scratch.table(numbered, "numbered"), ["id", "digest"]).select("key", "row", "text"), "keyed")
    gone = classes(keyed.select(F.col("key").alias("doc_id"), "text")).where("not kept").select(F.col("doc_id").alias("key")).distinct()
    left = keyed.join(gone, "key", "left_anti").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return left.select("row.*").unionByName(row.where("id is null").select("row.*"))


#: classes() in DuckDB: all pairs of texts that share a shingle, and the texts that each text reaches. For small tables without repeated ids.
SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, md5(text) AS content FROM documents
), texts AS (
  SELECT content, any_value(ws) AS ws, min(doc_id) AS rep FROM w WHERE doc_id IS NOT NULL AND len(ws) > 0 GROUP BY content
), grams AS (
  SELECT rep, CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i + 4] END AS gram FROM (SELECT rep, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM texts)
), counted AS (
  SELECT rep, gram, count(*) AS n FROM grams GROUP BY rep, gram
), sizes AS (
  SELECT rep, sum(n)::BIGINT AS size FROM counted GROUP BY rep
), near AS (
  SELECT a.rep AS a, b.rep AS b, sum(least(a.n, b.n)) AS both_ FROM counted a JOIN counted b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY a.rep, b.rep
), links AS (
  SELECT a, b FROM near JOIN sizes x ON x.rep = a JOIN sizes y ON y.rep = b WHERE both_ >= {THRESHOLD} * (x.size + y.size - both_)
), reach(a, b) AS (
  SELECT rep, rep FROM texts UNION SELECT reach.a, l.b FROM reach JOIN links l ON reach.b = l.a
), c AS (
  SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(s.size, 0) AS n_shingles, coalesce(coalesce(c.class_id, d.doc_id) = d.doc_id, true) AS kept
FROM w d LEFT JOIN texts t ON t.content = d.content AND d.doc_id IS NOT NULL LEFT JOIN c ON c.rep = t.rep LEFT JOIN sizes s ON s.rep = t.rep
"""
