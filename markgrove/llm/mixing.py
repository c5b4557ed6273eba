"""Mixing sources to target weights by Poisson replication.

A source of weight w gets the rate epochs * (w / sum of weights) * (all characters / its characters). Each document's
number of copies is a Poisson quantile of that rate at a uniform number hashed from the seed and the document's id, so
any executor that recomputes a row gets the same copies. A rate above BLOCK_RATE is cut into equal blocks, each with a
number of its own (a sum of Poisson numbers is Poisson): no table of probabilities grows with the rate, and a document of
very many copies is dealt out by blocks before its copies are made. Copies are dealt evenly over all partitions, by which
each partition is sorted by a hashed key: partitions in order, rows in order, are one global shuffle.

Defined results: rows of a null source are one source; a null id is hashed as its text, rows with the same id get the same
copies (ties of shuffle_key, in any order); a source without characters keeps the rate epochs; a weight of 0 drops a source;
texts of any length, empty and null ones are copied whole and unread; an empty table stays empty; other columns, whatever
their names, pass through: where one is called copy_no or shuffle_key, the result's own gets underscores at its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SEED = "mix-1"

#: Largest rate of one block of copies.
BLOCK_RATE = 32.0

#: Numbers of copies that a block may take up; more than the largest quantile of BLOCK_RATE.
BLOCK_STEP = 1000

#: Per-source tables of up to so many rows (of at most 1 KB, as a block's rate is bounded) are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 10_000


def hashed(*parts: Column) -> Column:
    return F.md5(F.concat_ws("/", *parts))


def uniform(digest: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of a hexadecimal digest."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2 ... up to a tail that no uniform number reaches; rates are at most BLOCK_RATE."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.lit(0.0).alias("log_p"), F.exp(-rate).alias("cdf"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.ln(rate) - F.ln(k.cast("double"))
        cdf = acc["cdf"] + F.exp(log_p - rate)
        return F.struct(log_p.alias("log_p"), cdf.alias("cdf"), F.concat(acc["all"], F.array(cdf)).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, scratch: Scratch, weights: dict[str, float] | None = None, default_weight: float = 1.0, epochs: float = 1.0) -> DataFrame:
    """One row per source: source, chars, rate, the number of blocks and the cumulative probabilities of one."""
    chars = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("chars"))
    weight = F.lit(float(default_weight))
    for source, w in (weights or {}).items():
        weight = F.when(F.col("source") == source, F.lit(float(w))).otherwise(weight)
    table = scratch.table(chars.withColumn("weight", weight), "sources")
    total, weighed = table.agg(F.sum("chars"), F.sum(F.when(F.col("chars") > 0, F.col("weight")))).first()
    share = F.col("weight") / F.lit(float(weighed or 1.0)) * F.lit(float(total or 0.0)) / F.col("chars")
    rate = F.lit(float(epochs)) * F.when(F.col("chars") > 0, share).otherwise(F.signum("weight"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("rate") / BLOCK_RATE)).cast("long")
    return table.withColumn("rate", rate).withColumn("blocks", blocks).withColumn("cdf", poisson_cdf(F.col("rate") / F.col("blocks")))


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in (c.lower() for c in taken):
        name += "_"
    return name


def mix(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """Every copy of every document: docs' columns, copy_no (BLOCK_STEP times its block, plus its place there from 1) and shuffle_key, globally shuffled."""
    names, parts = docs.columns, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copy_name, key_name = _free("copy_no", names), _free("shuffle_key", names)
    scratch = Scratch(docs.sparkSession, "mixing")
    own = F.struct(*names).alias("row")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.col("text")), F.lit("null"))
    each = docs.select(own, F.col("source").alias("of"), key.alias("key"))
    table = scratch.table(rates(docs.select("source", "text"), scratch, weights, default_weight, epochs).select(F.col("source").alias("source_of"), "blocks", "cdf"), "rates")
    n, most = table.agg(F.count("*"), F.max("blocks")).first()
    each = each.join(F.broadcast(table) if n <= BROADCAST_SOURCES else table, F.col("of").eqNullSafe(F.col("source_of")))
    dealt = each.where("blocks = 1").withColumn("block", F.lit(0).cast("long"))
    if (most or 1) > 1:  # documents of many blocks go to all executors, a block at a time, before copies are made
        many = each.where("blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        dealt = dealt.unionByName(many.repartition(parts))
    dealt = dealt.withColumn("u", uniform(hashed(F.lit(seed), F.col("key"), F.concat(F.lit("b"), F.col("block").cast("string")))))
    copies = F.size(F.filter("cdf", lambda c: c < F.col("u"))).alias("copies")
    dealt = dealt.select("row", "key", "block", copies).where("copies > 0")
    dealt = dealt.select("row", "key", "block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("place"))
    copy_no = F.col("block") * BLOCK_STEP + F.col("place")
    dealt = dealt.select(*[F.col("row")[c].alias(c) for c in names], copy_no.alias(copy_name), hashed(F.lit(seed), F.col("key"), copy_no.cast("string")).alias(key_name))
    # round robin over rows in the order of their hashes: equal rows and keys are dealt out too, and a recomputed task deals alike
    return dealt.repartition(parts).sortWithinPartitions(key_name)


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """mix() with docs' columns only."""
    out = mix(docs, **options)
    return out.select(*out.columns[: len(docs.columns)])


#: The same for equal weights, one epoch, in DuckDB: documents copied by the quantile of each source's rate.
SQL = f"""
WITH RECURSIVE src AS (
  SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS chars FROM documents GROUP BY source
), tot AS (
  SELECT sum(chars) AS total, sum(CASE WHEN chars > 0 THEN 1.0::DOUBLE END) AS weighed FROM src
), rates AS (
  SELECT source, CASE WHEN chars > 0 THEN 1.0::DOUBLE / coalesce(weighed, 1) * total / chars ELSE 1.0::DOUBLE END AS whole FROM src, tot
), rate AS (
  SELECT source, greatest(1, ceil(whole / {BLOCK_RATE}))::BIGINT AS blocks, whole / greatest(1, ceil(whole / {BLOCK_RATE}))::BIGINT AS rate FROM rates
), cdf(source, rate, k, log_p, cdf) AS (
  SELECT source, rate, 0, 0.0::DOUBLE, exp(-rate) FROM rate
  UNION ALL
  SELECT source, rate, k + 1, log_p + ln(rate) - ln((k + 1)::DOUBLE), cdf + exp(log_p + ln(rate) - ln((k + 1)::DOUBLE) - rate)
  FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
), tables AS (
  SELECT source, list(cdf) AS cdfs FROM cdf GROUP BY source
), keyed AS (
  SELECT d.*, coalesce(doc_id::VARCHAR, 'text:' || text, 'null') AS key FROM documents d
), drawn AS (
  SELECT k.*, b, (('0x' || substr(md5('{SEED}/' || key || '/b' || b), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM (SELECT keyed.*, unnest(range(r.blocks)) AS b FROM keyed JOIN rate r ON keyed.source IS NOT DISTINCT FROM r.source) k
), counted AS (
  SELECT d.*, len(list_filter(t.cdfs, lambda c: c < d.u)) AS copies FROM drawn d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, text, lang, source, n_chars, c AS copy_no, md5('{SEED}/' || key || '/' || c) AS shuffle_key
FROM (SELECT *, b * {BLOCK_STEP} + unnest(range(1, copies + 1)) AS c FROM counted)
"""
