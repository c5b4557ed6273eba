"""Documents to elements, tokens, diagnostics and summaries: one Arrow kernel pass, then DataFrame projections.

parse() gives one row per document with nested arrays, of which only those in `want` are built: Catalyst cannot push a
projection into the kernel, so the caller does. The views explode them. Filters on other columns belong before parse().
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import kernel

#: Bytes of one Arrow batch for the kernel.
ARROW_BATCH_BYTES = 16 << 20

#: Inputs of fewer bytes for each core are dealt to all cores first; larger ones have scan partitions enough.
SPREAD_BYTES = 64 << 20

REPAIR = pa.struct([("repair_type", pa.string()), ("description", pa.string()), ("confidence_impact", pa.float64()), ("severity", pa.string())])
ATTRIBUTE = pa.struct([("name", pa.string()), ("value", pa.string())])
ELEMENT = [
    ("node_id", pa.int32()), ("parent_id", pa.int32()), ("post", pa.int32()), ("depth", pa.int32()), ("child_idx", pa.int32()), ("n_children", pa.int32()),
    ("tag", pa.string()), ("parent_tag", pa.string()), ("attrs", pa.list_(ATTRIBUTE)), ("text", pa.string()), ("path", pa.string()), ("flat_path", pa.string()),
    ("confidence", pa.float64()), ("repairs", pa.list_(REPAIR)), ("comments", pa.list_(pa.string())), ("pis", pa.list_(pa.string())),
    ("preserve_structure", pa.bool_()), ("offset", pa.int32()),
]
TOKEN = [
    ("seq", pa.int32()), ("type", pa.string()), ("value", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("offset", pa.int32()),
    ("confidence", pa.float64()), ("repairs", pa.list_(REPAIR)), ("raw_content", pa.string()),
]
DIAGNOSTIC = [("seq", pa.int32()), ("severity", pa.string()), ("message", pa.string()), ("component", pa.string()), ("offset", pa.int32())]
SUMMARY = [
    ("success", pa.bool_()), ("confidence", pa.float64()), ("encoding", pa.string()), ("version", pa.string()), ("standalone", pa.string()), ("root_tag", pa.string()),
    ("total_elements", pa.int32()), ("total_attributes", pa.int32()), ("max_depth", pa.int32()), ("repairs_applied", pa.int32()), ("repair_count", pa.int32()),
    ("document_repairs", pa.int32()), ("repair_impact", pa.float64()), ("diagnostic_count", pa.int32()), ("error_count", pa.int32()), ("warning_count", pa.int32()),
]
NESTED = {"elements": ELEMENT, "tokens": TOKEN, "diagnostics": DIAGNOSTIC}


def _array(values: Iterable, kind: pa.DataType) -> pa.Array:
    return pa.array(list(values), type=kind)


def _lists(sizes: Iterable[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes], dtype=np.int32)), values)


def _struct(fields: list[tuple[str, pa.DataType]], columns: dict[str, pa.Array | Iterable]) -> pa.StructArray:
    made = [c if isinstance(c, pa.Array) else _array(c, kind) for c, kind in ((columns[n], kind) for n, kind in fields)]
    return pa.StructArray.from_arrays(made, names=[n for n, _ in fields])


def _repairs(each: list[list[tuple]]) -> pa.ListArray:
    """Repairs of each row as (type, description, impact, severity)."""
    flat = [r for rs in each for r in rs]
    return _lists(map(len, each), _struct([(f.name, f.type) for f in REPAIR], {f.name: [r[i] for r in flat] for i, f in enumerate(REPAIR)}))


def element_column(docs: list[kernel.Document], tags: frozenset[str] | None) -> pa.ListArray:
    each = [[(i, e) for i, e in enumerate(d.elements) if tags is None or e.tag in tags] for d in docs]
    all_of = [(d, i, e) for d, rows in zip(docs, each, strict=True) for i, e in rows]
    own = [e for _, _, e in all_of]
    attrs = pa.StructArray.from_arrays([_array((k for e in own for k in e.attrs), pa.string()), _array((v for e in own for v in e.attrs.values()), pa.string())], names=["name", "value"])
    return _lists(map(len, each), _struct(ELEMENT, {
        "node_id": (i for _, i, _ in all_of), "parent_id": (e.parent if e.parent >= 0 else None for e in own), "post": (e.post for e in own), "depth": (e.depth for e in own),
        "child_idx": (e.child_idx for e in own), "n_children": (e.n_children for e in own), "tag": (e.tag for e in own),
        "parent_tag": (d.elements[e.parent].tag if e.parent >= 0 else None for d, _, e in all_of), "attrs": _lists((len(e.attrs) for e in own), attrs),
        "text": ("".join(e.text) or None for e in own), "path": (e.path for e in own), "flat_path": (e.flat_path for e in own), "confidence": (1.0 for _ in own),
        "repairs": _repairs([e.repairs for e in own]), "comments": _lists((len(e.comments) for e in own), _array((c for e in own for c in e.comments), pa.string())),
        "pis": _lists((len(e.pis) for e in own), _array((c for e in own for c in e.pis), pa.string())), "preserve_structure": (e.preserve for e in own), "offset": (e.offset for e in own),
    }))


def token_column(docs: list[kernel.Document], texts: list[str | None]) -> pa.ListArray:
    all_of = [t for d in docs for t in d.tokens]
    places = [p for d, t in zip(docs, texts, strict=True) for p in kernel.positions(d.tokens, (t or "").removeprefix("﻿"))]
    return _lists((len(d.tokens) for d in docs), _struct(TOKEN, {
        "seq": (i for d in docs for i in range(len(d.tokens))), "type": (t.type for t in all_of), "value": (t.value for t in all_of), "line": (p[0] for p in places), "col": (p[1] for p in places),
        "offset": (t.offset for t in all_of), "confidence": (t.confidence for t in all_of), "repairs": _repairs([[(*t.repair, "minor")] if t.repair else [] for t in all_of]),
        "raw_content": (t.raw or t.value for t in all_of),
    }))


def diagnostic_column(docs: list[kernel.Document]) -> pa.ListArray:
    all_of = [x for d in docs for x in d.diagnostics]
    names = kernel.Diagnostic._fields
    return _lists((len(d.diagnostics) for d in docs), _struct(DIAGNOSTIC, {"seq": (i for d in docs for i in range(len(d.diagnostics))), **{n: [getattr(x, n) for x in all_of] for n in names}}))


def summary(doc: kernel.Document) -> dict:
    severe = [d.severity for d in doc.diagnostics]
    repairs = [*doc.repairs, *(r for e in doc.elements for r in e.repairs)]
    return {
        "success": doc.success, "confidence": doc.confidence, "encoding": doc.encoding, "version": doc.version, "standalone": doc.standalone,
        "root_tag": doc.elements[0].tag if doc.elements else None, "total_elements": len(doc.elements), "total_attributes": sum(len(e.attrs) for e in doc.elements),
        "max_depth": max((e.depth for e in doc.elements), default=0), "repairs_applied": doc.repairs_applied, "repair_count": len(repairs),
        "document_repairs": len(doc.repairs), "repair_impact": sum(r.confidence_impact for r in repairs), "diagnostic_count": len(severe),
        "error_count": sum(s in ("ERROR", "CRITICAL") for s in severe), "warning_count": severe.count("WARNING"),
    }


def spark_type(kind: pa.DataType) -> T.DataType:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it comes from fewer files than there are cores, and Catalyst's estimate of its bytes is too small for
    scan partitions enough; no larger input is shuffled."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size > cores * SPREAD_BYTES or len(df.inputFiles()) >= cores else df.repartition(cores)


def parse(df: DataFrame, id_col: str = "doc_id", content_col: str = "content", mode: str = "contract", want: tuple[str, ...] = ("elements", "documents"), tags: list[str] | None = None, carry: tuple[str, ...] = (), path_depth: int | None = kernel.PATH_DEPTH) -> DataFrame:
    """One row per row of df: id_col, the columns of carry, and of want: elements, tokens, diagnostics (arrays) and the summary's columns.

    tags: build only these elements' rows. path_depth: depth down to which elements carry their paths (None: all). A null
    content is an empty document.
    """
    if unknown := set(want) - {*NESTED, "documents"}:
        raise ValueError(f"unknown: {sorted(unknown)}")
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(limit).rstrip("b")) > ARROW_BATCH_BYTES:
        conf.set(limit, str(ARROW_BATCH_BYTES))
    keep, wanted = [id_col, *carry], frozenset(tags) if tags is not None else None
    fields = list(df.select(*keep).schema.fields)
    arrays = [w for w in NESTED if w in want]
    fields += [T.StructField(w, spark_type(pa.list_(pa.struct(NESTED[w])))) for w in arrays]
    if "documents" in want:
        fields += [T.StructField(n, spark_type(t)) for n, t in SUMMARY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(content_col).to_pylist()
            docs = [kernel.parse(t, mode, path_depth) for t in texts]
            columns, names = [batch.column(c) for c in keep], list(keep)
            for w in arrays:
                columns.append(element_column(docs, wanted) if w == "elements" else token_column(docs, texts) if w == "tokens" else diagnostic_column(docs))
                names.append(w)
            if "documents" in want:
                sums = [summary(d) for d in docs]
                columns += [pa.array([s[n] for s in sums], type=t) for n, t in SUMMARY]
                names += [n for n, _ in SUMMARY]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    content = F.col(content_col).cast("string").alias(content_col)
    return spread(df.select(*[c for c in keep if c != content_col], content)).mapInArrow(run, T.StructType(fields))


def _view(parsed: DataFrame, name: str, id_cols: tuple[str, ...]) -> DataFrame:
    return parsed.select(*id_cols, F.inline(name))


def elements(df: DataFrame, id_col: str = "doc_id", content_col: str = "content", mode: str = "contract", tags: list[str] | None = None, carry: tuple[str, ...] = (), path_depth: int | None = kernel.PATH_DEPTH) -> DataFrame:
    """One row per element, in pre-order: node_id is the pre-order number, post the last descendant's."""
    return _view(parse(df, id_col, content_col, mode, ("elements",), tags, carry, path_depth), "elements", (id_col, *carry))


def tokens(df: DataFrame, id_col: str = "doc_id", content_col: str = "content", mode: str = "contract", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per token."""
    return _view(parse(df, id_col, content_col, mode, ("tokens",), None, carry), "tokens", (id_col, *carry))


def diagnostics(df: DataFrame, id_col: str = "doc_id", content_col: str = "content", mode: str = "contract", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per diagnostic."""
    return _view(parse(df, id_col, content_col, mode, ("diagnostics",), None, carry), "diagnostics", (id_col, *carry))


def documents(df: DataFrame, id_col: str = "doc_id", content_col: str = "content", mode: str = "contract", carry: tuple[str, ...] = ()) -> DataFrame:
    """One summary row per document."""
    return parse(df, id_col, content_col, mode, ("documents",), None, carry)


def nested(frame: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document with its `elements` array in pre-order: parse()'s own rows as they are, element rows grouped again."""
    if "elements" in frame.columns:
        return frame
    rest = [c for c in frame.columns if c not in (id_col, "node_id")]
    return frame.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("node_id", *rest))).alias("elements"))


def rows(frame: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per element of either form."""
    return frame.select(id_col, F.inline("elements")) if "elements" in frame.columns else frame


def repairs(elements_df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per repair of an element."""
    return elements_df.select(id_col, "node_id", "tag", F.inline("repairs"))


def attributes(elements_df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per attribute: position, name, value."""
    return elements_df.select(id_col, "node_id", "tag", F.posexplode("attrs").alias("position", "a")).select(id_col, "node_id", "tag", "position", "a.name", "a.value")


def attribute_in(attrs: Column, name: str) -> Column:
    """The value of an attribute of an attrs array, or null. Names are unique in an element."""
    return F.get(F.transform(F.filter(attrs, lambda a: a["name"] == name), lambda a: a["value"]), 0)


def attribute(name: str) -> Column:
    """The value of an attribute of an element row, or null."""
    return attribute_in(F.col("attrs"), name)


def confidence_breakdown(base: Column, document: Column, **stages: Column) -> Column:
    """struct of the stages' confidences (null: not run) and overall_confidence, the least of those above 0 (0 if there is none)."""
    known = F.filter(F.array(base, document, *stages.values()), lambda c: c > 0)
    return F.struct(base.alias("base_confidence"), document.alias("document_confidence"), *[c.alias(f"{n}_confidence") for n, c in stages.items()], F.coalesce(F.array_min(known), F.lit(0.0)).alias("overall_confidence"))


def result_summary(parsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, of parse()'s rows with elements, diagnostics and summary: parsing statistics, diagnostics by severity and component, repairs by type.

    One row in, one row out: maps are counted inside the row.
    """

    def counted(values: Column) -> Column:
        names = F.array_sort(F.array_distinct(values))
        return F.map_from_arrays(names, F.transform(names, lambda n: F.size(F.filter(values, lambda v: v == n))))

    kinds = F.flatten(F.transform("elements", lambda e: F.transform(e["repairs"], lambda r: r["repair_type"])))
    of_document = F.transform(F.sequence(F.lit(1), F.greatest("document_repairs", F.lit(1))), lambda _: F.lit("unclosed_elements"))  # the one repair a document can have
    kinds = F.concat(kinds, F.when(F.col("document_repairs") > 0, of_document).otherwise(F.array().cast("array<string>")))
    return parsed.select(
        id_col, "success", "confidence", F.col("total_elements").alias("element_count"), F.col("total_attributes").alias("attribute_count"), "max_depth", "repair_count", (F.col("repair_count") > 0).alias("has_repairs"),
        F.col("diagnostic_count").alias("total_diagnostics"), (F.col("error_count") > 0).alias("has_errors"), counted(F.col("diagnostics.severity")).alias("diagnostics_by_severity"), counted(F.col("diagnostics.component")).alias("diagnostics_by_component"),
        "document_repairs", (F.col("repair_count") - F.col("document_repairs")).alias("element_repairs"), counted(kinds).alias("repair_types"), F.col("repair_impact").alias("repair_impact_on_confidence"),
        confidence_breakdown(F.col("confidence"), F.when(F.col("success"), F.lit(1.0)).otherwise(F.lit(0.0))).alias("confidence_breakdown"),
    )
