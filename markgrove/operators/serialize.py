"""Element tables back to XML, dictionaries and JSON: one group per document, bounded by the document."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.markup import escape_text, sanitize_name

#: Entities that mark a text as escaped already, and those without their semicolon (fixed values).
ENTITY = re.compile(r"&(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);")
OPEN_ENTITY = re.compile(r"&(amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+)(?![;a-zA-Z0-9])")

FORMATS = ("xml", "xml_pretty", "xml_minified", "dict", "dict_detailed", "json", "json_pretty", "json_compact")


@dataclass(frozen=True)
class Output:
    """Options of the output."""

    declaration: bool = True
    encoding: str = "utf-8"
    version: str = "1.0"
    indent: str = "  "
    attributes: bool = True
    comments: bool = True
    instructions: bool = True
    empty_attributes: bool = True
    empty_elements: bool = True
    attribute_prefix: str = "@"
    text_key: str = "#text"
    metadata: bool = False
    repairs: bool = False
    json_indent: int | None = 2
    ensure_ascii: bool = False
    sort_keys: bool = False

    def override(self, **changes: object) -> Output:
        return replace(self, **changes)


def escape(text: str) -> str:
    fixed = OPEN_ENTITY.sub(r"&\1;", text)
    return fixed if ENTITY.search(fixed) else fixed.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_value(value: str) -> str:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = value.replace(old, new)
    return value


def kids(rows: list[dict]) -> dict[int | None, list[dict]]:
    out: dict[int | None, list[dict]] = {}
    for r in rows:
        out.setdefault(r["parent_id"], []).append(r)
    return out


def to_xml(rows: list[dict], o: Output = Output(), style: str = "xml") -> str:
    """XML of a document's rows, which are in pre-order. Built from the last row to the first, so depth costs no recursion."""
    pretty, done = style == "xml_pretty", {}
    for r in reversed(rows):
        inner = [done.pop(c) for c in r.get("_kids", ()) if c in done]
        pad = o.indent * r["depth"] if pretty else ""
        attrs = [f'{a["name"]}="{escape_value(a["value"] or "")}"' for a in (r["attrs"] or []) if o.attributes and (a["value"] or o.empty_attributes)]
        head = " ".join([r["tag"], *attrs])
        text = escape(r["text"]) if r["text"] else ""
        if not (r["text"] or inner) and not o.empty_elements:
            continue
        if not (r["text"] or inner or r.get("preserve_structure")):
            done[r["node_id"]] = f"{pad}<{head}/>"
            continue
        parts = [*(r.get("comments") or [] if o.comments else []), *(r.get("pis") or [] if o.instructions else []), *([text.strip() if style == "xml_minified" else text] if text else [])]
        if pretty and inner:
            body = "\n".join([*(p for p in parts if p.strip()), *inner])
            done[r["node_id"]] = f"{pad}<{head}>\n{body}\n{pad}</{r['tag']}>"
        else:
            done[r["node_id"]] = f"{pad}<{head}>{''.join([*parts, *inner])}</{r['tag']}>"
    body = "".join(done.get(r["node_id"], "") for r in rows[:1])
    if not o.declaration:
        return body
    return f'<?xml version="{o.version}" encoding="{o.encoding}"?>' + ("" if style == "xml_minified" else "\n") + body


def to_dict(rows: list[dict], o: Output = Output(), detailed: bool = False) -> dict:
    """Nested dictionaries; children of one tag become a list. Detailed adds facts about the root."""
    built: dict[int, dict] = {}
    for r in reversed(rows):
        d: dict = {}
        if o.attributes:
            d |= {o.attribute_prefix + a["name"]: a["value"] for a in (r["attrs"] or []) if a["value"] or o.empty_attributes}
        if r["text"]:
            d[o.text_key] = r["text"]
        for c, tag in zip(r.get("_kids", ()), r.get("_kid_tags", ()), strict=True):
            child = built.pop(c)
            if not child and not o.empty_elements:
                continue
            if tag not in d:
                d[tag] = child
            elif isinstance(d[tag], list):
                d[tag].append(child)
            else:
                d[tag] = [d[tag], child]
        built[r["node_id"]] = d
    if not rows:
        return {}
    root, d = rows[0], built[rows[0]["node_id"]]
    if detailed and o.metadata:
        d["_element_metadata"] = {"tag": root["tag"], "confidence": 1.0, "has_repairs": bool(root["repairs"]), "child_count": len(root.get("_kids", ())), "attribute_count": len(root["attrs"] or []), "depth": 0, "path": root["path"]}
    if detailed and o.repairs and root["repairs"]:
        d["_repairs"] = [dict(r) for r in root["repairs"]]
    return {root["tag"]: d}


def render(rows: list[dict], style: str, o: Output = Output()) -> str:
    """A document's rows, in any order, in one of FORMATS (dictionaries as compact JSON)."""
    rows = sorted(rows, key=lambda r: r["node_id"])
    by = kids(rows)
    for r in rows:
        own = by.get(r["node_id"], [])
        r["_kids"], r["_kid_tags"] = [c["node_id"] for c in own], [c["tag"] for c in own]
    if style.startswith("xml"):
        return to_xml(rows, o, style)
    if style in ("dict", "dict_detailed"):
        return json.dumps(to_dict(rows, o, style == "dict_detailed"), ensure_ascii=False, separators=(",", ":"))
    d = to_dict(rows, o, style != "json")
    if style == "json_compact":
        return json.dumps(d, ensure_ascii=o.ensure_ascii, separators=(",", ":"))
    return json.dumps(d, ensure_ascii=o.ensure_ascii, indent=o.json_indent or (2 if style == "json_pretty" else None), sort_keys=o.sort_keys)


NEEDED = ("node_id", "parent_id", "depth", "tag", "attrs", "text", "path", "repairs", "comments", "pis", "preserve_structure")


def serialize(elements: DataFrame, style: str = "xml", options: Output = Output(), id_col: str = "doc_id") -> DataFrame:
    """(id, content) of each document of an element table."""
    if style not in FORMATS:
        raise ValueError(f"unknown format: {style}")
    kind = elements.schema[id_col].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        return pa.table({id_col: table.column(id_col)[:1], "content": pa.array([render(table.drop_columns([id_col]).to_pylist(), style, options)])})

    return elements.select(id_col, *NEEDED).groupBy(id_col).applyInArrow(run, f"{id_col} {kind}, content string")


def serialize_all(parsed: DataFrame, styles: dict[str, str], options: Output = Output(), id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carry, a column of text for each of styles: name -> format) of parse()'s nested rows: no shuffle, as a document is one row already."""
    if unknown := set(styles.values()) - set(FORMATS):
        raise ValueError(f"unknown format: {sorted(unknown)}")
    keep = [id_col, *carry]
    needed = F.transform("elements", lambda e: F.struct(*[e[c].alias(c) for c in NEEDED])).alias("elements")
    schema = T.StructType([*parsed.select(*keep).schema.fields, *(T.StructField(n, T.StringType()) for n in styles)])

    def run(batches):
        for batch in batches:
            docs = batch.column("elements").to_pylist()
            made = [pa.array([render(rows or [], style, options) for rows in docs], type=pa.string()) for style in styles.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, *styles])

    return parsed.select(*keep, needed).mapInArrow(run, schema)


def serialize_parsed(parsed: DataFrame, style: str = "xml", options: Output = Output(), id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carry, content) of parse()'s nested rows in one format."""
    return serialize_all(parsed, {"content": style}, options, id_col, carry)


def flat_to_xml(flat: DataFrame, id_col: str = "doc_id", order_col: str = "node_id") -> DataFrame:
    """(id, content) of a flat table: <data> with one <item> per row, which has a child per column that is not null.

    Names of columns are made tag names; values are escaped. A document's rows are gathered in one string, bounded by the document.
    """
    cols = [c for c in flat.columns if c not in (id_col, order_col)]
    tags = flat.sparkSession.createDataFrame([tuple(cols)], [f"c{i}" for i in range(len(cols))]).select(*[sanitize_name(F.col(f"c{i}")) for i in range(len(cols))]).first()
    body = F.concat_ws("", *[F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"<{t}>"), escape_text(F.col(f"`{c}`").cast("string")), F.lit(f"</{t}>"))) for c, t in zip(cols, tags, strict=True)])
    item = F.concat(F.lit("<item>"), body, F.lit("</item>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order_col, item.alias("x")))), lambda s: s["x"]), "")
    return flat.groupBy(id_col).agg(F.concat(F.lit("<data>"), rows, F.lit("</data>")).alias("content"))
