"""Validation of parsed documents, row by row: every rule is an expression over the document's own `elements` array.

So all rules together read one kernel pass and shuffle nothing. Issues are nested in the document's row until they are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("minimal", "standard", "strict", "pedantic")

#: Issue types, messages, suggested fixes, and the encodings and the version that pedantic validation takes without a warning.
STRUCTURE, WELL_FORMEDNESS, ATTRIBUTE, NAMESPACE, ENCODING = "structural", "well_formed", "attribute", "namespace", "encoding"
RULES = {
    "no_root": (STRUCTURE, "ERROR", "Document has no root element", "Ensure document contains at least one XML element"),
    "circular": (STRUCTURE, "CRITICAL", "Circular reference detected in element tree", "Remove circular references from tree structure"),
    "parent": (STRUCTURE, "ERROR", "Child element parent reference inconsistency", "Ensure parent-child relationships are bidirectional"),
    "empty_tag": (WELL_FORMEDNESS, "ERROR", "Element has empty tag name", "Provide valid tag name for element"),
    "bad_tag": (WELL_FORMEDNESS, "ERROR", "Tag name contains invalid characters: ", "Remove invalid characters from tag name"),
    "reserved_tag": (WELL_FORMEDNESS, "WARNING", "Tag name uses XML reserved prefix: ", "Avoid using 'xml' prefix in tag names"),
    "empty_name": (ATTRIBUTE, "ERROR", "Attribute has empty name", "Provide valid name for attribute"),
    "bad_name": (ATTRIBUTE, "ERROR", "Attribute name contains invalid characters: ", "Remove invalid characters from attribute name"),
    "bad_value": (ATTRIBUTE, "ERROR", "Attribute value contains invalid characters: ", "Properly escape or remove invalid characters from attribute value"),
    "duplicate": (ATTRIBUTE, "ERROR", "Duplicate attribute name: ", "Remove or rename duplicate attribute"),
    "namespace": (NAMESPACE, "ERROR", "Undeclared namespace prefix: ", None),
    "version": (ENCODING, "WARNING", "Non-standard XML version: ", "Use XML version 1.0 for maximum compatibility"),
    "encoding": (ENCODING, "WARNING", "Non-standard encoding: ", "Use UTF-8 encoding for maximum compatibility"),
}
PLAIN_ENCODINGS, PLAIN_VERSION = ("utf-8", "utf-16", "ascii"), "1.0"

#: The rules that each level adds to those of the level before it.
ADDED = {"minimal": ("no_root", "circular", "parent", "empty_tag", "bad_tag", "reserved_tag", "empty_name", "bad_name", "bad_value"), "standard": ("duplicate",), "strict": ("namespace",), "pedantic": ("version", "encoding")}

COLUMNS = ("node_id", "issue_type", "severity", "message", "element_path", "suggested_fix")


def _issue(rule: str, detail: Column | None = None, node: Column | None = None, fix: Column | None = None) -> Column:
    kind, severity, message, suggested = RULES[rule]
    null = F.lit(None)
    said = F.concat(F.lit(message), detail) if detail is not None else F.lit(message)
    values = (node["node_id"] if node is not None else null.cast("int"), F.lit(kind), F.lit(severity), said, node["path"] if node is not None else null.cast("string"), fix if fix is not None else F.lit(suggested).cast("string"))
    return F.struct(*[v.alias(n) for v, n in zip(values, COLUMNS, strict=True)])


def _none() -> Column:
    return F.array().cast("array<struct<node_id:int,issue_type:string,severity:string,message:string,element_path:string,suggested_fix:string>>")


def _if(condition: Column, issue: Column) -> Column:
    return F.when(condition, F.array(issue)).otherwise(_none())


def _each(condition, issue) -> Column:
    """Issues of the elements that meet a condition."""
    return F.transform(F.filter("elements", condition), issue)


def _attributes(condition, issue) -> Column:
    """Issues of the attributes (element, attribute) that meet a condition."""
    return F.flatten(F.transform("elements", lambda e: F.transform(F.filter(e["attrs"], lambda a: condition(a)), lambda a: issue(e, a))))


def duplicates(e: Column) -> Column:
    """Names of an element's second and later attributes with equal names but for case."""
    low = F.transform(e["attrs"], lambda a: F.lower(a["name"]))
    again = F.filter(e["attrs"], lambda a, i: F.array_position(low, F.lower(a["name"])) < i + 1)
    return F.when(F.size(F.array_distinct(low)) < F.size(low), F.transform(again, lambda a: a["name"])).otherwise(F.array().cast("array<string>"))


def prefix(tag: Column) -> Column:
    return F.substring_index(tag, ":", 1)


def undeclared(scoped: bool = False) -> Column:
    """Elements whose prefix is not declared: anywhere before them in the document or, scoped, on themselves or an ancestor."""
    declared = F.flatten(F.transform("elements", lambda e: F.transform(F.filter(e["attrs"], lambda a: a["name"].startswith("xmlns:")), lambda a: F.struct(F.substring(a["name"], 7, 1 << 30).alias("prefix"), e["node_id"].alias("node"), e["post"].alias("post")))))
    used = F.filter("elements", lambda e: e["tag"].contains(":") & ~F.lower(prefix(e["tag"])).isin("xml", "xmlns", ""))

    def known(e: Column) -> Column:
        return F.exists(declared, lambda d: (d["prefix"] == prefix(e["tag"])) & (d["node"] <= e["node_id"]) & (e["node_id"] <= d["post"] if scoped else F.lit(True)))

    return F.filter(used, lambda e: ~known(e))


def rule(name: str, scoped: bool = False) -> Column:
    """The array of issues that one rule finds in a document."""
    if name == "no_root":
        return _if(F.size("elements") == 0, _issue(name))
    if name == "circular":
        return _each(lambda e: e["parent_id"] >= e["node_id"], lambda e: _issue(name, node=e))
    if name == "parent":
        ids = F.transform("elements", lambda e: e["node_id"])
        lost = F.array_except(F.filter(F.transform("elements", lambda e: e["parent_id"]), lambda p: p.isNotNull()), ids)
        return F.when(F.size(lost) > 0, _each(lambda e: F.array_contains(lost, e["parent_id"]), lambda e: _issue(name, node=e))).otherwise(_none())
    if name == "empty_tag":
        return _each(lambda e: e["tag"] == "", lambda e: _issue(name, node=e))
    if name == "bad_tag":
        return _each(lambda e: e["tag"].rlike("[<>&\"']"), lambda e: _issue(name, e["tag"], e))
    if name == "reserved_tag":
        return _each(lambda e: F.lower(e["tag"]).startswith("xml"), lambda e: _issue(name, e["tag"], e))
    if name == "empty_name":
        return _attributes(lambda a: a["name"] == "", lambda e, a: _issue(name, node=e))
    if name == "bad_name":
        return _attributes(lambda a: a["name"].rlike("[<>&\"'\\s]"), lambda e, a: _issue(name, a["name"], e))
    if name == "bad_value":
        return _attributes(lambda a: a["value"].rlike("[<>&\"]"), lambda e, a: _issue(name, F.concat(a["name"], F.lit("="), a["value"]), e))
    if name == "duplicate":
        return F.flatten(F.transform("elements", lambda e: F.transform(duplicates(e), lambda n: _issue(name, n, e))))
    if name == "namespace":
        return F.transform(undeclared(scoped), lambda e: _issue(name, prefix(e["tag"]), e, F.concat(F.lit("Declare namespace prefix with xmlns:"), prefix(e["tag"]), F.lit(" attribute"))))
    if name == "version":
        return _if(F.col("version") != PLAIN_VERSION, _issue(name, F.col("version")))
    if name == "encoding":
        return _if(~F.lower("encoding").isin(*PLAIN_ENCODINGS), _issue(name, F.col("encoding")))
    raise ValueError(f"unknown rule: {name}")


def rules_of(level: str) -> tuple[str, ...]:
    if level not in LEVELS:
        raise ValueError(f"unknown level: {level}")
    return tuple(r for k in LEVELS[: LEVELS.index(level) + 1] for r in ADDED[k])


def with_issues(parsed: DataFrame, level: str = "standard", scoped_namespaces: bool = False) -> DataFrame:
    """parsed (with elements and, for pedantic, the summary) and `issues`, the array of a document's issues."""
    return parsed.withColumn("issues", F.concat(*[rule(r, scoped_namespaces) for r in rules_of(level)]))


def validate(parsed: DataFrame, level: str = "standard", id_col: str = "doc_id", scoped_namespaces: bool = False) -> DataFrame:
    """All issues at a level, one row each."""
    return with_issues(parsed, level, scoped_namespaces).select(id_col, F.inline("issues"))


def with_verdict(checked: DataFrame, level: str = "standard") -> DataFrame:
    """with_issues()'s rows and `verdict`: struct<success, error_count, warning_count, confidence, elements_validated, attributes_validated, level, rules_checked>."""
    n_errors = F.size(F.filter("issues", lambda i: i["severity"].isin("ERROR", "CRITICAL")))
    n_warnings = F.size(F.filter("issues", lambda i: i["severity"] == "WARNING"))
    confidence = F.when(n_errors > 0, 1 - F.least(F.lit(0.9), 0.1 * n_errors)).when(n_warnings > 0, 1 - F.least(F.lit(0.5), 0.05 * n_warnings)).otherwise(F.lit(1.0))
    attrs = F.aggregate("elements", F.lit(0), lambda n, e: n + F.size(e["attrs"]))
    return checked.withColumn("verdict", F.struct(
        (n_errors == 0).alias("success"), n_errors.alias("error_count"), n_warnings.alias("warning_count"), confidence.alias("confidence"),
        F.size("elements").alias("elements_validated"), attrs.alias("attributes_validated"), F.lit(level).alias("level"), F.lit(len(rules_of(level))).alias("rules_checked"),
    ))


def verdicts(parsed: DataFrame, level: str = "standard", id_col: str = "doc_id", scoped_namespaces: bool = False) -> DataFrame:
    """Per document: valid, error_count, warning_count, confidence."""
    judged = with_verdict(with_issues(parsed, level, scoped_namespaces), level)
    return judged.select(id_col, F.col("verdict.success").alias("valid"), "verdict.error_count", "verdict.warning_count", "verdict.confidence")
