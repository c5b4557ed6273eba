"""Adapters between element tables and other representations, by name; the engine's plug-in surface.

An adapter turns an element table into its target and back. Adapters are registered by the caller or by an installed
package's entry points in the group "markgrove.adapters"; no source text is evaluated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from importlib.util import find_spec
from typing import Any
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from .operators import nav, parse, serialize


@dataclass(frozen=True)
class Adapter:
    """to_target(elements) and from_target(spark, target) -> elements. needs: modules without which it is not available."""

    name: str
    kind: str
    to_target: Callable[[DataFrame], Any]
    from_target: Callable[[SparkSession, Any], DataFrame] | None = None
    needs: tuple[str, ...] = ()
    metadata: dict[str, str] = field(default_factory=dict)

    def available(self) -> bool:
        return all(find_spec(m) is not None for m in self.needs)


_REGISTRY: dict[str, Adapter] = {}


def register(adapter: Adapter) -> None:
    _REGISTRY[adapter.name] = adapter


def unregister(name: str) -> bool:
    return _REGISTRY.pop(name, None) is not None


def get(name: str) -> Adapter:
    if name not in _REGISTRY or not _REGISTRY[name].available():
        raise KeyError(f"no adapter {name} is available")
    return _REGISTRY[name]


def names(kind: str | None = None, available: bool = True) -> list[str]:
    return sorted(a.name for a in _REGISTRY.values() if (kind is None or a.kind == kind) and (a.available() or not available))


def discover() -> list[str]:
    """Register the adapters of installed packages; their names."""
    found = [p.load() for p in entry_points(group="markgrove.adapters")]
    for adapter in found:
        register(adapter)
    return [a.name for a in found]


def loss(adapter: Adapter, elements: DataFrame) -> int:
    """Elements by which a round trip differs from the table."""
    if adapter.from_target is None:
        raise ValueError(f"{adapter.name} has no way back")
    back = adapter.from_target(elements.sparkSession, adapter.to_target(elements))
    a, b = (df.select("doc_id", "node_id", "tag", "text", "attrs") for df in (elements, back))
    return a.exceptAll(b).count() + b.exceptAll(a).count()


#: Most element rows that an adapter takes to the driver.
DRIVER_ROWS = 1_000_000


def _bounded(elements: DataFrame) -> DataFrame:
    if elements.limit(DRIVER_ROWS + 1).count() > DRIVER_ROWS:
        raise ValueError(f"more than {DRIVER_ROWS} elements: adapters are for the driver")
    return elements


def _to_pandas(elements: DataFrame) -> Any:
    return nav.flat(_bounded(elements), tuple(nav.attribute_names(elements))).orderBy("doc_id", "node_id").toPandas()


def _trees(elements: DataFrame) -> dict[Any, ElementTree.Element]:
    """One ElementTree per document, on the driver."""
    elements = _bounded(elements)
    out: dict[Any, dict[int, ElementTree.Element]] = {}
    for r in elements.select("doc_id", "node_id", "parent_id", "tag", "attrs", "text").orderBy("doc_id", "node_id").toLocalIterator():
        made = out.setdefault(r["doc_id"], {})
        attrs = {a["name"]: a["value"] for a in r["attrs"]}
        node = ElementTree.Element(r["tag"], attrs) if r["parent_id"] is None else ElementTree.SubElement(made[r["parent_id"]], r["tag"], attrs)
        node.text = r["text"]
        made[r["node_id"]] = node
    return {k: v[0] for k, v in out.items()}


def _from_trees(spark: SparkSession, trees: dict[Any, ElementTree.Element]) -> DataFrame:
    rows = [(k, ElementTree.tostring(t, encoding="unicode")) for k, t in trees.items()]
    return parse.elements(spark.createDataFrame(rows, "doc_id long, content string"))


def _from_xml(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return parse.elements(docs)


register(Adapter("pandas", "dataframe", _to_pandas, needs=("pandas",), metadata={"shape": "flat"}))
register(Adapter("elementtree", "tree", _trees, _from_trees, metadata={"place": "driver"}))
register(Adapter("xml", "text", lambda e: serialize.serialize(e, "xml"), _from_xml))
register(Adapter("json", "text", lambda e: serialize.serialize(e, "json_compact")))
