"""One object that holds a session and a configuration: documents in, tables out; and SQL functions for the same."""

from __future__ import annotations

import logging
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import security
from .operators import nav, optimize, parse, report, serialize, tokens, validate
from .plans import kernel


class Engine:
    """parse() of any kind of input; never raises on content."""

    def __init__(self, spark: SparkSession, config: Config = Config(), handlers: tuple[Callable[[dict], None], ...] = ()):
        self.spark, self.config, self.handlers = spark, config, list(handlers)

    def reconfigured(self, config: Config | None = None, **override: Any) -> Engine:
        """An engine of another configuration with the same handlers, which are told if the security level changes."""
        new = Engine(self.spark, (config or self.config).override(**override), tuple(self.handlers))
        if new.config.global_.security_level != self.config.global_.security_level:
            new.tell("policy_updated", {"old_level": self.config.global_.security_level, "new_level": new.config.global_.security_level})
        return new

    def tell(self, event: str, data: dict) -> None:
        """Hand an event to all handlers; one that fails does not keep it from the others."""
        for handler in self.handlers:
            try:
                handler({"type": event, "data": data, "security_level": self.config.global_.security_level})
            except Exception as e:  # a handler's fault is not the engine's
                logging.getLogger(__name__).error("security handler failed: %s", e)

    def docs(self, content: str | bytes | Any) -> DataFrame:
        """A DataFrame of one document from a path, a string, bytes, an open file or anything else's text; None is empty."""
        if isinstance(content, Path):
            from .sources.files import read_one

            return read_one(self.spark, str(content), config=self.config)
        if hasattr(content, "read"):
            content = content.read()
        if isinstance(content, bytes):
            raw = self.spark.createDataFrame([(0, bytearray(content))], "doc_id long, content binary")
            from .sources.files import decoded

            return decoded(raw, None, self.config).select("doc_id", F.col("text").alias("content"))
        return self.spark.createDataFrame([(0, "" if content is None else str(content))], "doc_id long, content string")

    def parse(self, docs: DataFrame | Any, correlation_id: str | None = None, **options: Any) -> DataFrame:
        """parse() of a frame of documents or of one input; a path that cannot be read gives the row of a failure. correlation_id: a column of that name."""
        if isinstance(docs, Path):
            from .sources.files import parse_one

            found = parse_one(self.spark, str(docs), config=self.config, **options)
        else:
            found = parse.parse(docs if isinstance(docs, DataFrame) else self.docs(docs), mode=self.config.tree.mode, **options)
        return found if correlation_id is None else found.withColumn("correlation_id", F.lit(correlation_id))

    def elements(self, docs: DataFrame | Any, **options: Any) -> DataFrame:
        frame = docs if isinstance(docs, DataFrame) else self.docs(docs)
        return parse.elements(frame, mode=self.config.tree.mode, **options)

    def tokens(self, docs: DataFrame | Any) -> DataFrame:
        frame = docs if isinstance(docs, DataFrame) else self.docs(docs)
        f = self.config.tokenization.filtering
        chosen = tokens.TokenFilter(f.mode, f.token_types, f.confidence_threshold or None, pattern=f.content_pattern, case_sensitive=f.case_sensitive, max_results=f.max_results)
        return chosen.apply(parse.tokens(frame, mode=self.config.tree.mode))

    def statistics(self, summaries: DataFrame) -> DataFrame:
        """Documents, failures, mean confidence and repairs over summary rows."""
        return summaries.agg(F.count("*").alias("n_documents"), F.count_if(~F.col("success")).alias("failures"), F.avg("confidence").alias("mean_confidence"), F.sum("repair_count").alias("repairs"))

    def report(self, docs: DataFrame, level: str = "standard") -> DataFrame:
        parsed = self.parse(docs, want=("elements", "diagnostics", "documents"))
        return report.comprehensive(optimize.with_actions(validate.with_verdict(validate.with_issues(parsed, level), level)))

    def secure(self, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """Decision per document under the configured security level."""
        return security.decisions(docs, id_col, self.config.global_.security_level)

    def audit(self, docs: DataFrame, id_col: str = "doc_id") -> dict:
        """Statistics of a scan of docs, one row, handed to the handlers too."""
        row = security.statistics(self.secure(docs, id_col), security.scan(docs, id_col)).first().asDict()
        self.tell("scan_finished", row)
        return row

    def repair(self, docs: DataFrame, style: str = "xml", carry: tuple[str, ...] = ()) -> DataFrame:
        """Repaired documents as text."""
        return serialize.serialize_parsed(self.parse(docs, want=("elements",), carry=carry), style, carry=carry)


def register_sql(spark: SparkSession) -> None:
    """SQL table functions markup_elements(content) and markup_tokens(content), for LATERAL joins.

    Rows travel as Arrow batches; functions that take whole Arrow columns cannot stand in a LATERAL join.
    """

    @F.udtf(returnType="node_id int, parent_id int, depth int, tag string, text string, path string, attrs map<string,string>", useArrow=True)
    class MarkupElements:
        def eval(self, content: str):
            for i, e in enumerate(kernel.parse(content).elements):
                yield i, e.parent if e.parent >= 0 else None, e.depth, e.tag, "".join(e.text) or None, e.path, e.attrs

    @F.udtf(returnType="seq int, type string, value string, start int, confidence double", useArrow=True)
    class MarkupTokens:
        def eval(self, content: str):
            for i, t in enumerate(kernel.lex(content or "")):
                yield i, t.type, t.value, t.offset, t.confidence

    spark.udtf.register("markup_elements", MarkupElements)
    spark.udtf.register("markup_tokens", MarkupTokens)


#: Most element rows that to_flat_pandas() brings to the driver.
PANDAS_ROWS = 1_000_000


def to_flat_pandas(elements: DataFrame, most: int = PANDAS_ROWS):
    """The flat table of an element table with a column for each attribute name, for notebooks; larger tables are refused."""
    flat = nav.flat(elements, tuple(nav.attribute_names(elements)))
    if flat.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} elements: use nav.flat()")
    return flat.orderBy("doc_id", "node_id").toPandas()
