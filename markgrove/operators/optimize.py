"""Rewrites of parsed documents that shrink them; passes change element rows, with_actions() says what they did, inside the document's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import normalize_whitespace
from .parse import rows

#: Depth from which a document is reported as deep; bytes taken for an element and for a source token (fixed values).
DEEP, ELEMENT_BYTES, TOKEN_BYTES = 50, 200, 100

#: The passes in their order, and what is said of the number of elements or attributes that they touched.
PASSES = ("text_node_consolidation", "redundant_element_removal", "attribute_optimization", "memory_cleanup", "structure_balancing")
SAID = ("Consolidated text in {} elements", "Removed {} redundant elements", "Optimized attributes in {} elements", "Cleaned memory references in {} elements", "Analyzed tree structure (depth: {})")


def clean_text(text: Column) -> Column:
    return F.when(text.isNotNull(), normalize_whitespace(text))


def redundant(e) -> Column:
    """Whether an element (a struct, or F.col for a row's columns) is a leaf without text, attributes and repairs that is no root."""
    return (e("n_children") == 0) & e("parent_id").isNotNull() & (F.coalesce(clean_text(e("text")), F.lit("")) == "") & (F.size(e("attrs")) == 0) & (F.size(e("repairs")) == 0)


def whitespace(frame: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return rows(frame, id_col).withColumn("text", clean_text(F.col("text")))


def drop_redundant(frame: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Element rows without redundant leaves, one pass, so what becomes a leaf stays; parents lose their number of children.

    A leaf that goes sends its parent's row a mark, and rows and marks of a node are added up: one aggregation, one kernel pass.
    """
    own = rows(frame, id_col)
    rest = [c for c in own.columns if c not in (id_col, "node_id")]
    leaf = redundant(F.col)
    sent = F.struct(F.when(leaf, F.col("parent_id")).otherwise(F.col("node_id")).alias("node_id"), F.when(~leaf, F.struct(*rest)).alias("row"))
    each = own.select(id_col, sent.alias("s")).select(id_col, "s.*")
    kept = each.groupBy(id_col, "node_id").agg(F.first("row", ignorenulls=True).alias("row"), F.count_if(F.col("row").isNull()).cast("int").alias("lost")).where("row is not null")
    return kept.select(id_col, "node_id", "row.*", "lost").withColumn("n_children", F.col("n_children") - F.col("lost")).drop("lost").select(own.columns)


def drop_empty_attributes(frame: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return rows(frame, id_col).withColumn("attrs", F.filter("attrs", lambda a: F.coalesce(a["value"], F.lit("")) != ""))


def element_bytes(e) -> Column:
    attrs = F.aggregate(e("attrs"), F.lit(0), lambda n, a: n + F.length(a["name"]) + F.length(F.coalesce(a["value"], F.lit(""))))
    return 2 * F.length(e("tag")) + F.length(F.coalesce(e("text"), F.lit(""))) + attrs + ELEMENT_BYTES


def memory(frame: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Estimated bytes of each document's elements."""
    return rows(frame, id_col).groupBy(id_col).agg(F.sum(element_bytes(F.col)).alias("estimated_bytes"))


def optimize(frame: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """White space, then redundant leaves, then empty attributes."""
    return drop_empty_attributes(drop_redundant(whitespace(frame, id_col), id_col), id_col)


def _sum(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda n, e: n + value(e).cast("long"))


def with_actions(parsed: DataFrame) -> DataFrame:
    """parsed (with elements) and `actions`: array<struct<type, description, elements_affected, memory_saved_bytes>> of the passes that would change something.

    An element's source tokens are its tag's: two ends and a name, a name and a value for each attribute, and the same of its close tag.
    """
    e = F.col("elements")
    left = F.filter(e, lambda x: ~redundant(lambda c: x[c]))
    changed = F.filter(e, lambda x: x["text"].isNotNull() & (clean_text(x["text"]) != x["text"]))
    gone = F.filter(e, lambda x: redundant(lambda c: x[c]))
    empty = F.flatten(F.transform(left, lambda x: F.filter(x["attrs"], lambda a: F.coalesce(a["value"], F.lit("")) == "")))
    deep = F.coalesce(F.array_max("elements.depth"), F.lit(0))
    touched = (F.size(changed), F.size(gone), F.size(empty), F.size(left), deep)
    saved = (
        _sum(changed, lambda x: F.length(x["text"]) - F.length(clean_text(x["text"]))),
        _sum(gone, lambda x: element_bytes(lambda c: x[c]) - F.length(F.coalesce(x["text"], F.lit("")))),
        _sum(empty, lambda a: F.length(a["name"])),
        _sum(left, lambda x: TOKEN_BYTES * (3 + 2 * F.size(x["attrs"]))),
        F.lit(0).cast("long"),
    )
    made = []
    for k, (name, said) in enumerate(zip(PASSES, SAID, strict=True)):
        before, after = said.split("{}")
        holds = touched[k] > (DEEP if name == "structure_balancing" else 0)
        n = F.lit(0) if name == "structure_balancing" else touched[k]
        text = F.concat(F.lit(before), touched[k].cast("string"), F.lit(after))
        made.append(F.when(holds, F.struct(F.lit(name).alias("type"), text.alias("description"), n.cast("long").alias("elements_affected"), saved[k].alias("memory_saved_bytes"))))
    return parsed.withColumn("actions", F.when(F.size(e) > 0, F.array_compact(F.array(*made))).otherwise(F.array().cast("array<struct<type:string,description:string,elements_affected:bigint,memory_saved_bytes:bigint>>")))


def optimization_summary(parsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: success (false without a root, then confidence 0), total_optimizations, elements_affected, memory_saved_bytes, elements_processed."""
    there = F.size("elements") > 0
    return with_actions(parsed).select(
        id_col, there.alias("success"), F.when(there, 1.0).otherwise(0.0).alias("confidence"), F.size("actions").alias("total_optimizations"),
        _sum(F.col("actions"), lambda a: a["elements_affected"]).alias("elements_affected"), _sum(F.col("actions"), lambda a: a["memory_saved_bytes"]).alias("memory_saved_bytes"), F.size("elements").alias("elements_processed"),
    )


def actions(frame: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document how many elements or attributes each pass touches, and what is left: one scan, one aggregation."""
    clean, leaf = clean_text(F.col("text")), redundant(F.col)
    empty = F.size(F.filter("attrs", lambda a: F.coalesce(a["value"], F.lit("")) == ""))
    return rows(frame, id_col).groupBy(id_col).agg(
        F.count_if(clean != F.col("text")).alias("texts_normalized"),
        F.count_if(leaf).alias("elements_removed"),
        F.sum(F.when(~leaf, empty).otherwise(0)).alias("attributes_removed"),
        F.count_if(~leaf).alias("elements_left"),
        F.sum(F.when(~leaf, F.size("attrs") - empty).otherwise(0)).alias("attributes_left"),
        (F.max("depth") > DEEP).alias("deep"),
    )
