"""Readers of markup files and sinks of results, by Spark's own sources and writers, so any file system that Spark knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import chars
from ..operators import parse

#: File names taken for markup, and those of a folder that is not searched below (fixed values).
GLOB, FLAT_GLOB = "*.{xml,xhtml,svg}", "*.xml"


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(doc_id, path, content) of the markup files at path; doc_id is the path's hash. Of a folder that is not searched below, .xml files alone."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    raw = reader.option("pathGlobFilter", GLOB if recursive or _status(spark, path) == "file" else FLAT_GLOB).load(path)
    return raw.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def _status(spark: SparkSession, path: str) -> str:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return "missing" if not fs.exists(hadoop) else "file" if fs.getFileStatus(hadoop).isFile() else "folder"


def try_read_files(spark: SparkSession, path: str, recursive: bool = True) -> tuple[DataFrame | None, str | None]:
    """The same, or None and what is wrong with the path: a missing path is an answer here, not an exception."""
    from pyspark.errors import AnalysisException

    if _status(spark, path) == "missing":
        return None, f"File not found: {path}"
    try:
        return read_files(spark, path, recursive), None
    except AnalysisException as e:
        return None, str(e).splitlines()[0]


#: Empty columns of a single file's frame.
ONE = "doc_id long, path string, content string, text_confidence double, fault string"


def read_one(spark: SparkSession, path: str, encoding: str | None = None, config: Config = Config()) -> DataFrame:
    """(doc_id, path, content, text_confidence, fault) of one file of any name, decoded; if it cannot be read, content is null and fault says why."""
    status = _status(spark, path)
    if status != "file":
        fault = f"File not found: {path}" if status == "missing" else f"Not a file: {path}"
        return spark.createDataFrame([(0, path, None, 0.0, fault)], ONE)
    raw = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), "path", "content")
    return decoded(raw, encoding, config).select("doc_id", "path", F.col("text").alias("content"), "text_confidence", F.lit(None).cast("string").alias("fault"))


def parse_one(spark: SparkSession, path: str, encoding: str | None = None, config: Config = Config(), **options) -> DataFrame:
    """parse() of one file. Its diagnostics end with an INFO that names the file; a file that cannot be read gives success=false, confidence 0 and a CRITICAL diagnostic."""
    want = options.pop("want", ("elements", "documents"))
    parsed = parse.parse(read_one(spark, path, encoding, config), mode=config.tree.mode, want=tuple({*want, "diagnostics"}), carry=("path", "fault"), **options)
    n = F.size("diagnostics")
    told = F.when(F.col("fault").isNull(), F.struct(n.alias("seq"), F.lit("INFO").alias("severity"), F.concat(F.lit("Parsed file: "), "path").alias("message"), F.lit("file_parser").alias("component"), F.lit(None).cast("int").alias("offset")))
    told = told.otherwise(F.struct(F.lit(0).alias("seq"), F.lit("CRITICAL").alias("severity"), F.col("fault").alias("message"), F.lit("file_parser").alias("component"), F.lit(None).cast("int").alias("offset")))
    good = F.col("fault").isNull()
    out = parsed.withColumn("diagnostics", F.when(good, F.concat("diagnostics", F.array(told))).otherwise(F.array(told)))
    if "documents" in want:
        changed = {"success": good & F.col("success"), "confidence": F.when(good, F.col("confidence")).otherwise(0.0), "diagnostic_count": F.size("diagnostics"), "error_count": F.when(good, F.col("error_count")).otherwise(1)}
        out = out.withColumns(changed)
    return out.drop("fault")


def decoded(files: DataFrame, encoding: str | None = None, config: Config = Config()) -> DataFrame:
    """files with `text`: decoded by the encoding given or detected, invalid characters treated, and the stage's confidence."""
    transform = chars.TransformConfig.preset(config.character.transformation)
    if encoding is None:
        return chars.stream(files, "content", transform)
    text = chars.decode(F.col("content"), F.lit(encoding))
    return files.withColumn("text", chars.transform(text, transform)).withColumn("text_confidence", F.lit(1.0))


def parse_files(spark: SparkSession, path: str, encoding: str | None = None, config: Config = Config(), recursive: bool = True) -> DataFrame:
    """One summary row per file: path, success, confidence, elements, repairs, errors, encoding, bytes, and its diagnostics."""
    docs = decoded(read_files(spark, path, recursive), encoding, config)
    found = F.lit(encoding).alias("detected") if encoding else F.col("encoding.encoding").alias("detected")
    rows = docs.select("doc_id", "path", found, "text_confidence", F.octet_length("content").alias("input_bytes"), "text")
    parsed = parse.parse(rows, "doc_id", "text", config.tree.mode, ("documents", "diagnostics"), carry=("path", "detected", "text_confidence", "input_bytes"))
    return parsed.withColumn("encoding", F.col("detected")).drop("detected")


def write(df: DataFrame, path: str, style: str = "parquet", mode: str = "error") -> None:
    """Write flat results as parquet, json, csv (with a header) or text (columns joined by tabs)."""
    if style == "text":
        df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])).write.mode(mode).text(path)
    elif style == "csv":
        df.write.mode(mode).option("header", "true").csv(path)
    elif style in ("json", "parquet"):
        df.write.mode(mode).format(style).save(path)
    else:
        raise ValueError(f"unknown format: {style}")
