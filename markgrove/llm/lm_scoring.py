"""Language-model scores of documents by stupid backoff, against the counts of all other documents.

The score of a word is c(context word) / c(context) if that n-gram is seen, else ALPHA times its score under a shorter
context, down to c(word) / N (a word seen nowhere else counts once). All counts are those of the corpus less the document's
own, so a document does not vouch for itself; N is the number of words of the corpus.

The counts are relations partitioned by hash. A plain relation of exploded n-grams would move several times the input, so
rows are packed: the documents of an input partition are dealt, in their order, into blocks of bounded bytes; a block hands
each hash bucket one row that holds its distinct n-grams there (sorted 64-bit hashes, as differences) and their counts; a
bucket's table adds up the rows of all blocks and answers each with the totals, in the row's own order; the answers are joined
to the block's documents, whose n-grams are exploded and looked up in the kernel, and summed per document. A row holds one
n-gram at least, so packing never makes more rows than the plain relation, and hot n-grams are added up per block before they
move. Blocks do not depend on what documents hold, so copies and repeated identifiers are spread like any others.

Defined results: a null text has no words and a null mean; repeated rows count each in the corpus and are scored alike; texts
of any length are read whole (one that exceeds a block is a block of its own); an empty table stays empty; scores are whole
millionths of nats, so sums do not depend on any order; columns other than doc_id and text, whatever their names, are not
carried. Rows must come in the same order if a task is repeated, as those of files do; a block that does not is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASHES, Scratch, mix64, tune

#: Production order, backoff factor, and text bytes of a block (a bucket has half of its n-grams, about).
ORDER, ALPHA, BLOCK_BYTES = 3, 0.4, 8 << 20

#: Blocks are numbered from this multiple of their input partition.
BLOCK_STEP = 1 << 32

MICRO = 1_000_000

#: Level of compression of the texts of a block.
TEXT_LEVEL = 6

SQUEEZER, EXPANDER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

U = np.uint64
FACTORS = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def ngrams(texts: list[str | None], order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text; for each n the positions (among all words) where an n-gram ends, and its hash."""
    words = [(t or "").encode("utf-8", "replace").split() for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    h = np.fromiter((x for w in words for x in map(HASHES.__getitem__, w)), dtype=np.uint64, count=int(sizes.sum()))
    rank = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # place in its text
    out = []
    for n in range(1, order + 1):
        end = np.flatnonzero(rank >= n - 1)
        key = np.full(len(end), U(n))
        for k in range(n):
            key += h[end - (n - 1 - k)] * FACTORS[k]
        out.append((end, mix64(key)))
    return sizes, out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash; it does not decrease as hashes increase."""
    return (((keys >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)


def _squeezed(data: bytes) -> bytes:
    """The length of the compressed bytes, then these."""
    out = SQUEEZER.compress(data)
    return len(out).to_bytes(8, "little") + out


def _expanded(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """The bytes that _squeezed() put at a place, and the place after them."""
    end = at + 8 + int.from_bytes(data[at : at + 8], "little")
    return np.frombuffer(EXPANDER.decompress(data[at + 8 : end]), dtype=np.uint8), end


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences of as few bytes as the largest needs; their two upper bytes, which are small as a rule, compressed."""
    diffs = np.diff(keys)
    width = max(1, (int(diffs.max()).bit_length() + 7) // 8) if len(diffs) else 1
    planes = diffs[:, None].view(np.uint8).reshape(-1, 8)[:, :width]
    low = max(0, width - 2)
    return bytes([width]) + int(keys[0]).to_bytes(8, "little") + b"".join(_squeezed(planes[:, k].tobytes()) for k in range(low, width)) + planes[:, :low].tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    width, at, upper = data[0], 9, []
    low = max(0, width - 2)
    for _ in range(low, width):
        plane, at = _expanded(data, at)
        upper.append(plane)
    full = np.zeros((len(upper[0]) + 1, 8), dtype=np.uint8)
    full[0] = np.frombuffer(data, dtype=np.uint8, count=8, offset=1)
    if low:
        full[1:, :low] = np.frombuffer(data, dtype=np.uint8, offset=at).reshape(-1, low)
    for k, plane in enumerate(upper, low):
        full[1:, k] = plane
    return np.cumsum(full.view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts of a byte each, compressed; those of 255 and more are repeated at the end."""
    return _squeezed(np.minimum(counts, 255).astype(np.uint8).tobytes()) + counts[counts >= 255].astype(np.int64).tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    low, at = _expanded(data, 0)
    out = low.astype(np.int64)
    out[out == 255] = np.frombuffer(data, dtype=np.uint8, offset=at).view(np.int64)
    return out


def count_block(texts: list[str | None], order: int, buckets: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(n, bucket, packed hashes, packed counts) of a block."""
    for n, (_, keys) in enumerate(ngrams(texts, order)[1], 1):
        distinct, counts = np.unique(keys, return_counts=True)
        if not len(distinct):
            continue
        bucket = bucket_of(distinct, buckets)
        cut = np.flatnonzero(np.diff(bucket)) + 1
        for k, c in zip(np.split(distinct, cut), np.split(counts, cut), strict=True):
            yield n, int(bucket_of(k[:1], buckets)[0]), pack_sorted(k), pack_counts(c)


def total_bucket(rows: list[tuple[bytes, bytes]]) -> list[bytes]:
    """The corpus counts of each row's n-grams, packed in the row's order."""
    keys = [unpack_sorted(k) for k, _ in rows]
    _, where = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(where, np.concatenate([unpack_counts(c) for _, c in rows])).astype(np.int64)
    return [pack_counts(totals[w]) for w in np.split(where, np.cumsum([len(k) for k in keys])[:-1])]


def score_block(texts: list[str | None], order: int, totals: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, backed-off words, words that ended at the unigram, and the sum of scores without 1/N, of each text. totals: by n, in order of hashes."""
    sizes, grams = ngrams(texts, order)
    doc, total = np.repeat(np.arange(len(texts)), sizes), int(sizes.sum())
    others = []  # by n: the count elsewhere of the n-gram that ends at each word; -1 where there is none
    for n, (end, keys) in enumerate(grams, 1):
        distinct, where = np.unique(keys, return_inverse=True)
        counts = totals.get(n, np.zeros(0, dtype=np.int64))
        if len(counts) != len(distinct):
            raise ValueError("the counts are not those of this block's n-grams")
        _, own, n_own = np.unique(doc[end] * max(1, len(distinct)) + where, return_inverse=True, return_counts=True)
        all_of = np.full(total, -1, dtype=np.int64)
        all_of[end] = counts[where] - n_own[own]
        others.append(all_of)
    score, open_, low = np.zeros(total, dtype=np.int64), np.ones(total, dtype=bool), np.zeros(total, dtype=bool)
    steps = np.zeros(total, dtype=np.int64)
    for n in range(order, 0, -1):
        has = others[n - 1]
        if n > 1:
            hit = np.flatnonzero(open_ & (has > 0))
            score[hit] = np.rint(MICRO * (np.log(ALPHA) * steps[hit] + np.log(has[hit] / others[n - 2][hit - 1]))).astype(np.int64)
            open_[hit] = False
            steps[open_ & (has == 0)] += 1
        else:
            hit = np.flatnonzero(open_)
            score[hit] = np.rint(MICRO * (np.log(ALPHA) * steps[hit] + np.log(np.maximum(has[hit], 1)))).astype(np.int64)
            low[hit] = True
    size = len(texts)
    sums = np.zeros(size, dtype=np.int64)
    np.add.at(sums, doc, score)
    return sizes, np.bincount(doc[steps > 0], minlength=size), np.bincount(doc[low], minlength=size), sums


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", TEXT_LEVEL))) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _blocks(docs: DataFrame) -> DataFrame:
    """block, rows: the documents of each block as one compressed row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() * BLOCK_STEP, [], 0
        for batch in batches:
            ends = np.cumsum(np.nan_to_num(pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)))
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(ends, before + BLOCK_BYTES - size, side="right")))
                held.append(batch.slice(at, end - at))
                size += ends[end - 1] - before
                at = end
                if size >= BLOCK_BYTES or at < batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([block], type=pa.int64()), pa.array([_packed(pa.Table.from_batches(held))], type=pa.binary())], names=["block", "rows"])
                    block, held, size = block + 1, [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([block], type=pa.int64()), pa.array([_packed(pa.Table.from_batches(held))], type=pa.binary())], names=["block", "rows"])

    return docs.select("doc_id", "text").mapInArrow(run, "block long, rows binary")


def _unpacked(table: pa.Table) -> pa.Table:
    if table.num_rows != 1:
        raise ValueError("a block is one row")
    return pa.ipc.open_stream(table.column("rows")[0].as_py()).read_all()


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_backed_off, score_micronats, mean_score (nats a word) of every row."""
    if not 1 <= order <= len(FACTORS):
        raise ValueError(f"order must be from 1 to {len(FACTORS)}")
    spark = tune(docs.sparkSession)
    scratch = Scratch(spark, "lm")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 2 * (size // BLOCK_BYTES) + 1
    packed = _blocks(docs)

    def count(table: pa.Table) -> pa.Table:
        rows = list(count_block(_unpacked(table).column("text").to_pylist(), order, buckets))
        n, bucket, keys, counts = zip(*rows, strict=True) if rows else ((), (), (), ())
        block = pa.array([table.column("block")[0].as_py()] * len(rows), type=pa.int64())
        return pa.table({"block": block, "n": pa.array(n, type=pa.int32()), "bucket": pa.array(bucket, type=pa.int32()), "keys": pa.array(keys, type=pa.binary()), "counts": pa.array(counts, type=pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        found = total_bucket(list(zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True)))
        return pa.table({"block": table.column("block"), "n": table.column("n"), "bucket": table.column("bucket"), "totals": pa.array(found, type=pa.binary())})

    def look_up(own: pa.Table, answers: pa.Table) -> pa.Table:
        by: dict[int, list[tuple[int, bytes]]] = {}
        for n, bucket, totals in zip(*(answers.column(c).to_pylist() for c in ("n", "bucket", "totals")), strict=True):
            by.setdefault(n, []).append((bucket, totals))
        totals = {n: np.concatenate([unpack_counts(t) for _, t in sorted(rows)]) for n, rows in by.items()}
        rows = _unpacked(own)
        words, off, low, sums = score_block(rows.column("text").to_pylist(), order, totals)
        return pa.table({"doc_id": rows.column("doc_id"), **{k: pa.array(v, type=pa.int64()) for k, v in (("n_words", words), ("n_backed_off", off), ("n_low", low), ("sums", sums))}})

    counted = packed.groupBy("block").applyInArrow(count, "block long, n int, bucket int, keys binary, counts binary")
    answers = counted.groupBy("n", "bucket").applyInArrow(total, "block long, n int, bucket int, totals binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(look_up, f"doc_id {kind}, n_words long, n_backed_off long, n_low long, sums long")
    scored = scratch.table(scored, "scored")
    words = scored.agg(F.sum("n_words")).first()[0] or 1
    value = F.col("sums") - F.col("n_low") * F.lit(int(np.rint(MICRO * np.log(words))))
    return scored.select("doc_id", "n_words", "n_backed_off", value.alias("score_micronats"), F.when(F.col("n_words") > 0, value / F.lit(float(MICRO)) / F.col("n_words")).alias("mean_score"))


#: score() of order 3 in DuckDB.
SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), t AS (
  SELECT d, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w
), b AS (
  SELECT d, i, word, lag(word) OVER p AS before, lag(word, 2) OVER p AS first FROM t WINDOW p AS (PARTITION BY d ORDER BY i)
), own1 AS (SELECT d, word, count(*) AS n FROM t GROUP BY d, word),
all1 AS (SELECT word, sum(n) AS n FROM own1 GROUP BY word),
own2 AS (SELECT d, before, word, count(*) AS n FROM b WHERE before IS NOT NULL GROUP BY d, before, word),
all2 AS (SELECT before, word, sum(n) AS n FROM own2 GROUP BY before, word),
own3 AS (SELECT d, first, before, word, count(*) AS n FROM b WHERE first IS NOT NULL GROUP BY d, first, before, word),
all3 AS (SELECT first, before, word, sum(n) AS n FROM own3 GROUP BY first, before, word),
total AS (SELECT greatest(count(*), 1) AS n FROM t),
else1 AS (SELECT d, word, a.n - o.n AS n FROM own1 o JOIN all1 a USING (word)),
else2 AS (SELECT d, before, word, a.n - o.n AS n FROM own2 o JOIN all2 a USING (before, word)),
else3 AS (SELECT d, first, before, word, a.n - o.n AS n FROM own3 o JOIN all3 a USING (first, before, word)),
counts AS (
  SELECT b.d, b.before, b.first, e1.n AS c1, e2.n AS c2, e3.n AS c3, x1.n AS context1, x2.n AS context2
  FROM b JOIN else1 e1 ON b.d = e1.d AND b.word = e1.word
  LEFT JOIN else2 e2 ON b.d = e2.d AND b.before = e2.before AND b.word = e2.word
  LEFT JOIN else3 e3 ON b.d = e3.d AND b.first = e3.first AND b.before = e3.before AND b.word = e3.word
  LEFT JOIN else1 x1 ON b.d = x1.d AND b.before = x1.word
  LEFT JOIN else2 x2 ON b.d = x2.d AND b.first = x2.before AND b.before = x2.word
), steps AS (
  SELECT *, coalesce(c3 = 0, false)::INT AS off3, (coalesce(c3 = 0, false)::INT + coalesce(c2 = 0, false)::INT) AS off2 FROM counts
), scored AS (
  SELECT d, CASE WHEN c3 > 0 THEN round_even({MICRO} * ln(c3::DOUBLE / context2::DOUBLE), 0)
                 WHEN c2 > 0 THEN round_even({MICRO} * (ln({ALPHA}::DOUBLE) * off3 + ln(c2::DOUBLE / context1::DOUBLE)), 0)
                 ELSE round_even({MICRO} * (ln({ALPHA}::DOUBLE) * off2 + ln(greatest(c1, 1)::DOUBLE)), 0)
                      - (SELECT round_even({MICRO} * ln(n::DOUBLE), 0) FROM total) END::BIGINT AS s,
         CASE WHEN off2 > 0 THEN 1 ELSE 0 END AS off
  FROM steps
), sums AS (SELECT d, sum(s)::BIGINT AS s, sum(off)::BIGINT AS off FROM scored GROUP BY d)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(off, 0)::BIGINT AS n_backed_off, coalesce(s, 0)::BIGINT AS score_micronats,
       CASE WHEN len(ws) > 0 THEN s / {float(MICRO)}::DOUBLE / len(ws) END AS mean_score
FROM w LEFT JOIN sums USING (d)
"""
