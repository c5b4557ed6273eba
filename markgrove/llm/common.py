"""What the corpus operators share: the shared scratch folder, Arrow kernels' batch bounds, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch that goes to a Python kernel; a longer single row makes a batch of its own.
ARROW_BATCH_BYTES = 8 << 20

#: What separates words everywhere in this subpackage: the six ASCII white-space characters (as bytes.split does).
WORD_RE = r"[^\x20\x09-\x0D]+"

def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


HASHES = WordHashes()


_local_scratch: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of the Python kernels, unless the session has a smaller bound already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only local sessions without one (tests) get a temporary folder."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_scratch.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="scratch-"))
    return f"{root.rstrip('/')}/{sc.applicationId}"


class Scratch:
    """Tables written to the shared scratch folder, so that lineage ends there and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        if (made := _made.get()) is not None:
            made.append(self)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that no plan still to be run reads."""
        for t in tables:
            if t is not None and getattr(t, "_scratch_path", None):
                self.remove(t._scratch_path)


_made: ContextVar[list[Scratch] | None] = ContextVar("made", default=None)


@contextmanager
def passing_scratch() -> Iterator[None]:
    """Deletes, at its end, the scratch folders that were made within: for results that have been written elsewhere by then."""
    made: list[Scratch] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for s in made:
            s.remove(s.root)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of the undirected edges (a, b: long): rows (id, component_id), the least id of the component.

    Alternates large-star and small-star steps until the edge set no longer changes. Each step is a partial minimum and
    an equi-join, so a node of very many edges is split by adaptive execution; nothing is gathered on the driver but
    two numbers a round. Self loops and nulls are ignored; an empty input gives an empty result.
    """
    state = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    seen = None
    while True:
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen or now[0] == 0:
            break
        seen = now
        both = state.union(state.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).where("a > b").distinct()
        new = scratch.table(small, "edges")
        scratch.drop(state)
        state = new
    hubs = state.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return state.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(hubs)
