"""Navigation over parsed documents.

What lies within one document is read from its own row: the elements below a node are the slice of the pre-order array from it
to its last descendant, so no relation between elements is a join. All functions take parse()'s nested rows (one kernel pass,
no shuffle) or element rows, which are grouped by document first where a function needs them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .parse import attribute, nested, rows

ID = "doc_id"


def find_all(frame: DataFrame, tag: str, id_col: str = ID) -> DataFrame:
    """All elements of a tag."""
    return rows(frame, id_col).where(F.col("tag") == tag)


def first(frame: DataFrame, tag: str, id_col: str = ID) -> DataFrame:
    """The first element of a tag in each document that has one, in document order."""
    found = F.get(F.filter("elements", lambda e: e["tag"] == tag), 0).alias("e")
    return nested(frame, id_col).select(id_col, found).where("e is not null").select(id_col, "e.*")


def below(node: Column, with_self: bool = False) -> Column:
    """The elements below a node of the row's `elements`: a slice where the array is whole, else a filter."""
    size, start = F.size("elements"), 1 if with_self else 2
    whole = F.get("elements", size - 1)["node_id"] == size - 1
    part = F.slice("elements", node["node_id"] + start, node["post"] - node["node_id"] + (2 - start))
    low = node["node_id"] + (0 if with_self else 1)
    return F.when(whole, part).otherwise(F.filter("elements", lambda e: e["node_id"].between(low, node["post"])))


def _slim(frame: DataFrame, id_col: str) -> DataFrame:
    return nested(frame, id_col).select(id_col, F.transform("elements", lambda e: F.struct(*[e[c].alias(c) for c in ("node_id", "parent_id", "post", "tag", "text")])).alias("elements"))


def children(frame: DataFrame, parent_tag: str | None = None, child_tag: str | None = None, id_col: str = ID) -> DataFrame:
    """(id, parent_node, parent_tag, tag, text, child_idx, attrs ...) of direct children: a filter, as elements carry their parent's tag."""
    found = rows(frame, id_col).where("parent_id is not null")
    if parent_tag is not None:
        found = found.where(F.col("parent_tag") == parent_tag)
    if child_tag is not None:
        found = found.where(F.col("tag") == child_tag)
    return found.select(id_col, F.col("parent_id").alias("parent_node"), "parent_tag", "node_id", "tag", "text", "child_idx", "attrs")


def first_child(frame: DataFrame, parent_tag: str, child_tag: str, id_col: str = ID) -> DataFrame:
    """The first child of a tag under each parent."""
    found = children(frame, parent_tag, child_tag, id_col)
    return found.groupBy(id_col, "parent_node").agg(F.min_by(F.struct("node_id", "text"), "child_idx").alias("c")).select(id_col, "parent_node", "c.node_id", "c.text")


def descendants(frame: DataFrame, ancestor_tag: str, tag: str | None = None, include_self: bool = False, id_col: str = ID) -> DataFrame:
    """(id, ancestor, node_id, tag, text) of the elements below each element of ancestor_tag; as much work as there are rows in the result."""

    def of(node: Column) -> Column:
        found = below(node, include_self)
        return found if tag is None else F.filter(found, lambda e: e["tag"] == tag)

    each = F.transform(F.filter("elements", lambda e: e["tag"] == ancestor_tag), lambda a: F.struct(a["node_id"].alias("ancestor"), of(a).alias("found")))
    found = _slim(frame, id_col).select(id_col, F.inline(each))
    return found.select(id_col, "ancestor", F.inline("found")).select(id_col, "ancestor", "node_id", "tag", "text")


def find(frame: DataFrame, ancestor_tag: str, tag: str, id_col: str = ID) -> DataFrame:
    """For each ancestor the first match, direct children before deeper ones, deeper ones by the order of the children above them.

    The order is that of a search which looks at an element's children first and then into each of them in turn: of the matches
    under one parent only the first can win, and between parents the one met first in pre-order wins.
    """

    def of(node: Column) -> Column:
        found = F.filter(below(node), lambda e: e["tag"] == tag)
        return F.array_min(F.transform(found, lambda e: F.struct(e["parent_id"], e["node_id"], e["text"])))

    each = F.transform(F.filter("elements", lambda e: e["tag"] == ancestor_tag), lambda a: F.struct(a["node_id"].alias("ancestor"), of(a).alias("m")))
    return _slim(frame, id_col).select(id_col, F.inline(each)).where("m is not null").select(id_col, "ancestor", "m.node_id", "m.text")


def find_by_attribute(frame: DataFrame, name: str, value: str | None = None, id_col: str = ID) -> DataFrame:
    """Elements that have an attribute (of a value)."""
    return rows(frame, id_col).where(F.exists("attrs", lambda a: (a["name"] == name) & (F.lit(True) if value is None else a["value"] == value)))


def element_by_id(frame: DataFrame, value: str, id_col: str = ID) -> DataFrame:
    """The first element with id=value in each document that has one."""
    found = F.get(F.filter("elements", lambda e: F.exists(e["attrs"], lambda a: (a["name"] == "id") & (a["value"] == value))), 0).alias("e")
    return nested(frame, id_col).select(id_col, found).where("e is not null").select(id_col, "e.*")


def full_text(frame: DataFrame, tag: str, id_col: str = ID) -> DataFrame:
    """Own text and that of all descendants in document order, joined by spaces, of each element of a tag."""

    def of(node: Column) -> Column:
        texts = F.transform(F.filter(below(node, True), lambda e: e["text"].isNotNull()), lambda e: F.trim(e["text"]))
        return F.trim(F.array_join(texts, " "))

    each = F.transform(F.filter("elements", lambda e: e["tag"] == tag), lambda a: F.struct(a["node_id"].alias("node_id"), of(a).alias("full_text")))
    return _slim(frame, id_col).select(id_col, F.inline(each))


def flat(frame: DataFrame, attribute_names: tuple[str, ...] = (), id_col: str = ID) -> DataFrame:
    """tag, text ('' for none), path and one attr_<name> column for each named attribute, one row per element."""
    return rows(frame, id_col).select(id_col, "node_id", "tag", F.coalesce("text", F.lit("")).alias("text"), F.col("flat_path").alias("path"), *[attribute(n).alias(f"attr_{n}") for n in attribute_names])


def attribute_names(frame: DataFrame, id_col: str = ID) -> list[str]:
    """All attribute names of the table, sorted; for flat() when they are not known. The list is as long as the vocabulary of names."""
    return [r[0] for r in rows(frame, id_col).select(F.explode("attrs.name").alias("n")).distinct().orderBy("n").toLocalIterator()]


def records(frame: DataFrame, record_tag: str, fields: tuple[str, ...], attributes: tuple[str, ...] = (), id_col: str = ID) -> DataFrame:
    """One row per element of record_tag: its attributes and the text of its first child of each field, as columns. One aggregation, no pivot scan."""
    own = F.when(F.col("tag") == record_tag, F.struct(F.col("node_id").alias("record"), F.lit(True).alias("own")))
    field = F.when((F.col("parent_tag") == record_tag) & F.col("tag").isin(*fields), F.struct(F.col("parent_id").alias("record"), F.lit(False).alias("own")))
    each = rows(frame, id_col).select(id_col, "tag", "text", "child_idx", "attrs", F.inline(F.array_compact(F.array(own, field))))
    is_field = ~F.col("own")

    def text(name: str) -> Column:
        mine = is_field & (F.col("tag") == name)
        return F.min_by(F.when(mine, F.col("text")), F.when(mine, F.col("child_idx"))).alias(name)

    values = [F.max(F.when(F.col("own"), attribute(a))).alias(a) for a in attributes]
    return each.groupBy(id_col, F.col("record").alias("parent_node")).agg(*values, *map(text, fields))


def number(text: Column) -> Column:
    """A text as a number, without a currency sign and thousands' commas; null if it is none."""
    return F.regexp_replace(F.trim(text), r"^[$]|,", "").try_cast("double")


def stats(frame: DataFrame, id_col: str = ID) -> DataFrame:
    """Elements, attributes and greatest depth of each document."""
    attrs = F.aggregate("elements", F.lit(0), lambda n, e: n + F.size(e["attrs"]))
    return nested(frame, id_col).select(id_col, F.size("elements").alias("total_elements"), attrs.alias("total_attributes"), F.array_max("elements.depth").alias("max_depth"))


def top_parent_paths(frame: DataFrame, n: int = 5, id_col: str = ID) -> DataFrame:
    """The n parent paths (indexes left out) with most elements over all documents: parent_path, n."""
    parent = F.regexp_replace(F.regexp_replace("path", r"/[^/]*$", ""), r"\[[0-9]+\]", "")
    counted = rows(frame, id_col).where("parent_id is not null and path is not null").groupBy(parent.alias("parent_path")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "parent_path").limit(n)


def sibling_index(frame: DataFrame, id_col: str = ID) -> DataFrame:
    """Element rows with the place among the siblings of the same tag, from 1."""
    return rows(frame, id_col).withColumn("same_tag_idx", F.row_number().over(W.partitionBy(id_col, "parent_id", "tag").orderBy("node_id")))


def with_attribute(frame: DataFrame, name: str, value: Column, id_col: str = ID) -> DataFrame:
    """Element rows with an attribute set."""
    new = F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    others = F.filter("attrs", lambda a: a["name"] != name)
    replaced = F.transform("attrs", lambda a: F.when(a["name"] == name, new).otherwise(a))
    return rows(frame, id_col).withColumn("attrs", F.when(F.size(others) == F.size("attrs"), F.concat("attrs", F.array(new))).otherwise(replaced))


def without(frame: DataFrame, gone: DataFrame, id_col: str = ID) -> DataFrame:
    """Element rows without the subtrees whose roots are in gone (id, node_id)."""
    roots = gone.groupBy(F.col(id_col).alias("g_id")).agg(F.collect_set("node_id").alias("g_nodes"))
    both = nested(frame, id_col).join(roots, F.col(id_col) == F.col("g_id"), "left")
    spans = F.filter("elements", lambda e: F.array_contains("g_nodes", e["node_id"]))
    left = F.filter("elements", lambda e: ~F.exists("spans", lambda s: e["node_id"].between(s["node_id"], s["post"])))
    return both.withColumn("spans", spans).select(id_col, F.when(F.col("g_nodes").isNull(), F.col("elements")).otherwise(left).alias("elements")).select(id_col, F.inline("elements"))


def with_child(frame: DataFrame, parent_node: Column, tag: str, text: Column, at: Column | None = None, id_col: str = ID) -> DataFrame:
    """Nested rows in which the element parent_node (of a column; null: none) has a new leaf, as its last child or as child number `at`.

    Elements after it are numbered anew; paths of the row are null, as they may change; an `at` beyond the children is an error.
    """
    own = nested(frame, id_col).withColumn("_at", parent_node.cast("int"))
    parent = F.get(F.filter("elements", lambda e: e["node_id"] == F.col("_at")), 0)
    own = own.withColumn("_parent", parent)
    place = F.coalesce(at.cast("int") if at is not None else F.lit(None).cast("int"), F.col("_parent.n_children"))
    own = own.withColumn("_place", F.when((place >= 0) & (place <= F.col("_parent.n_children")), place).otherwise(F.when(F.col("_parent").isNotNull(), F.raise_error(F.lit("no such place among the children")).cast("int"))))
    after = F.get(F.filter("elements", lambda e: (e["parent_id"] == F.col("_at")) & (e["child_idx"] == F.col("_place"))), 0)["node_id"]
    own = own.withColumn("_new", F.coalesce(after, F.col("_parent.post") + 1))

    def moved(e: Column) -> Column:
        inside = (e["node_id"] <= F.col("_at")) & (e["post"] >= F.col("_at"))
        late, sibling = e["node_id"] >= F.col("_new"), (e["parent_id"] == F.col("_at")) & (e["child_idx"] >= F.col("_place"))
        changed = {
            "node_id": e["node_id"] + late.cast("int"), "parent_id": e["parent_id"] + (e["parent_id"] >= F.col("_new")).cast("int"), "post": e["post"] + (late | inside).cast("int"),
            "child_idx": e["child_idx"] + F.coalesce(sibling, F.lit(False)).cast("int"), "n_children": e["n_children"] + (e["node_id"] == F.col("_at")).cast("int"),
            "path": F.lit(None).cast("string"), "flat_path": F.lit(None).cast("string"),
        }
        return F.struct(*[changed.get(c, e[c]).alias(c) for c in names])

    names = [f.name for f in nested(frame, id_col).schema["elements"].dataType.elementType.fields]
    kinds = {f.name: f.dataType for f in nested(frame, id_col).schema["elements"].dataType.elementType.fields}
    values = {
        "node_id": F.col("_new"), "parent_id": F.col("_at"), "post": F.col("_new"), "depth": F.col("_parent.depth") + 1, "child_idx": F.col("_place"), "n_children": F.lit(0),
        "tag": F.lit(tag), "parent_tag": F.col("_parent.tag"), "text": text, "confidence": F.lit(1.0), "preserve_structure": F.lit(False),
    }
    empty = {"attrs", "repairs", "comments", "pis"}
    leaf = F.struct(*[(F.array().cast(kinds[c]) if c in empty else values.get(c, F.lit(None)).cast(kinds[c])).alias(c) for c in names])
    made = F.array_sort(F.concat(F.transform("elements", moved), F.array(leaf)), lambda a, b: a["node_id"] - b["node_id"])
    return own.select(id_col, F.when(F.col("_parent").isNull(), F.col("elements")).otherwise(made).alias("elements"))
