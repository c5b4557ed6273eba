"""Token tables: the native lexer (all in the JVM), filters, statistics, and assembly repairs as window operations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import markup

#: Weights of token types in the mean confidence of a document (fixed values); others weigh 1.
WEIGHTS = {"TEXT": 2.0, "TAG_NAME": 2.0, "ATTR_VALUE": 2.0, "ERROR": 0.5, "MALFORMED_TAG": 0.5}


def native(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, seq, token, class, offset): coarse tokens without Python; seq and offset (0-based) in document order."""
    each = df.select(id_col, F.posexplode(markup.lex(F.col(content_col))).alias("seq", "token"))
    before = F.sum(F.length("token")).over(W.partitionBy(id_col).orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return each.withColumn("class", markup.token_class(F.col("token"))).withColumn("offset", F.coalesce(before, F.lit(0)))


def native_classes(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """The same without offsets, so without a window."""
    each = df.select(id_col, F.posexplode(markup.lex(F.col(content_col))).alias("seq", "token"))
    return each.withColumn("class", markup.token_class(F.col("token")))


@dataclass(frozen=True)
class TokenFilter:
    """A filter of token rows; parts that are None do not filter. mode "include" keeps the types, "exclude" drops them."""

    mode: str = "include"
    types: tuple[str, ...] | None = None
    min_confidence: float | None = None
    start: int | None = None
    end: int | None = None
    pattern: str | None = None
    case_sensitive: bool = True
    max_results: int | None = None

    def __post_init__(self) -> None:
        if self.mode not in ("include", "exclude", "transform"):
            raise ValueError("mode must be include, exclude or transform")
        if self.min_confidence is not None and not 0 <= self.min_confidence <= 1:
            raise ValueError("min_confidence must be between 0 and 1")
        if self.max_results is not None and self.max_results < 0:
            raise ValueError("max_results must be >= 0")

    def condition(self) -> Column:
        """Whether a token row passes, but for max_results."""
        parts = [F.lit(True)]
        if self.types is not None:
            hit = F.col("type").isin(*self.types)
            parts.append(hit if self.mode == "include" else ~hit)
        if self.min_confidence is not None:
            parts.append(F.col("confidence") >= self.min_confidence)
        if self.start is not None:
            parts.append(F.col("offset") >= self.start)
        if self.end is not None:
            parts.append(F.col("offset") < self.end)
        if self.pattern is not None:
            parts.append(F.col("value").rlike(self.pattern if self.case_sensitive else f"(?i){self.pattern}"))
        return reduce(Column.__and__, parts)

    def apply(self, tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
        out = tokens.where(self.condition())
        return out if self.max_results is None else first_n(out, self.max_results, id_col)


def with_rank(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """tokens with _rank, the place of each in its document from 1."""
    return tokens.withColumn("_rank", F.row_number().over(W.partitionBy(id_col).orderBy("seq")))


def first_n(tokens: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """The first n rows of each document; Spark limits each group before the shuffle."""
    return with_rank(tokens, id_col).where(F.col("_rank") <= n).drop("_rank")


def well_formed() -> Column:
    return (F.size("repairs") == 0) & (F.col("confidence") >= 0.9)


#: Types that count as errors, as recovered and as synthetic (fixed values).
ERRORS, RECOVERED, SYNTHETIC = ("ERROR",), ("RECOVERED_CONTENT", "SYNTHETIC_CLOSE"), ("SYNTHETIC_CLOSE", "BALANCED_STRUCTURE")


def statistics(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: numbers of tokens, of errors, of tokens with repairs, recovered and synthetic ones, and their rates; least and weighted mean confidence, share of well-formed tokens."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("type")], F.lit(1.0))
    n = F.count("*")
    numbers = {"error": F.count_if(F.col("type").isin(*ERRORS)), "repair": F.count_if(F.size("repairs") > 0), "recovery": F.count_if(F.col("type").isin(*RECOVERED)), "synthetic": F.count_if(F.col("type").isin(*SYNTHETIC))}
    names = {"error": "n_errors", "repair": "n_repaired", "recovery": "n_recovered", "synthetic": "n_synthetic"}
    return tokens.groupBy(id_col).agg(
        n.alias("n_tokens"),
        *[c.alias(names[k]) for k, c in numbers.items()],
        *[(c / n).alias(f"{k}_rate") for k, c in numbers.items()],
        F.min("confidence").alias("min_confidence"),
        (F.sum(F.col("confidence") * weight) / F.sum(weight)).alias("confidence"),
        (F.count_if(well_formed()) / n).alias("well_formed_share"),
    )


def damped(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """tokens, those at the place of a repair with a tenth of its impact added to their confidence (changes of 0.01 and less are left out)."""
    impact = F.aggregate("repairs", F.lit(0.0), lambda n, r: n + r["confidence_impact"])
    change = 0.1 * F.sum(impact).over(W.partitionBy(id_col, "offset"))
    new = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") + F.col("_change")))
    return tokens.withColumn("_change", change).withColumn("confidence", F.when(F.abs("_change") > 0.01, new).otherwise(F.col("confidence"))).drop("_change")


#: The quick lexer's pattern for quoted attributes (fixed value).
QUICK_ATTRIBUTE = r"""(\w+)=(["'])([^"']*)\2"""


def quick(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, seq, type, value): tokens of texts that markup.is_fast_path() takes, all in the JVM; other texts give none.

    Texts of white space are dropped; a declaration is a tag; a tag's name is what comes before its first space, so that <br/> is named br/.
    """
    raw = F.regexp_extract_all(F.col(content_col), F.lit(r"<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<[^>]*>|[^<]+"), 0)

    def token(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), value.alias("value"))

    def of(t: Column) -> Column:
        inner = F.trim(F.substring(t, F.lit(2), F.length(t) - 2))
        words = F.split(inner, r"\s+")
        attrs = F.array_join(F.slice(words, 2, F.greatest(F.lit(1), F.size(words))), " ")
        names, values = F.regexp_extract_all(attrs, F.lit(QUICK_ATTRIBUTE), 1), F.regexp_extract_all(attrs, F.lit(QUICK_ATTRIBUTE), 3)
        pairs = F.flatten(F.zip_with(names, values, lambda n, v: F.array(token("ATTR_NAME", n), token("ATTR_VALUE", v))))
        end = F.array(token("TAG_END", F.lit(">")))
        return (
            F.when(t.startswith("<!--"), F.array(token("COMMENT", F.substring(t, F.lit(5), F.length(t) - 7))))
            .when(t.startswith("<![CDATA["), F.array(token("CDATA", F.substring(t, F.lit(10), F.length(t) - 12))))
            .when(t.startswith("<?"), F.array(token("PROCESSING_INSTRUCTION", F.substring(t, F.lit(3), F.length(t) - 4))))
            .when(t.startswith("<") & inner.startswith("/"), F.concat(F.array(token("TAG_START", F.lit("</")), token("TAG_NAME", F.trim(F.substring(inner, 2, 1 << 30)))), end))
            .when(t.startswith("<"), F.concat(F.array(token("TAG_START", F.lit("<")), token("TAG_NAME", F.get(words, 0))), pairs, end))
            .when(F.trim(F.regexp_replace(t, r"\s", "")) != "", F.array(token("TEXT", t)))
            .otherwise(F.array().cast("array<struct<type:string,value:string>>"))
        )

    found = F.flatten(F.transform(raw, of))
    return df.where(markup.is_fast_path(F.col(content_col))).select(id_col, F.posexplode(found).alias("seq", "t")).select(id_col, "seq", "t.type", "t.value")


def type_distribution(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return tokens.groupBy(id_col, "type").count()


#: Longest run of text tokens that is merged.
MERGE_LIMIT = 50


def merge_text(tokens: DataFrame, id_col: str = "doc_id", limit: int = MERGE_LIMIT) -> DataFrame:
    """Runs of adjacent TEXT tokens (at most `limit`) become one, stripped and with white space collapsed if two or more met."""
    w = W.partitionBy(id_col).orderBy("seq")
    is_text = F.col("type") == "TEXT"
    starts = F.when(is_text & (F.lag("type").over(w) == "TEXT"), 0).otherwise(1)
    runs = tokens.withColumn("_run", F.sum(starts).over(w))
    runs = runs.withColumn("_part", F.floor((F.row_number().over(W.partitionBy(id_col, "_run").orderBy("seq")) - 1) / limit))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), "")
    out = runs.groupBy(id_col, "_run", "_part").agg(F.min("seq").alias("seq"), F.first("type").alias("type"), joined.alias("value"), F.count("*").alias("n_merged"), F.min("offset").alias("offset"), F.min("confidence").alias("confidence"))
    clean = F.trim(F.regexp_replace("value", r"\s+", " "))
    return out.select(id_col, "seq", "type", F.when(F.col("n_merged") > 1, clean).otherwise(F.col("value")).alias("value"), "offset", F.when(F.col("n_merged") > 1, F.least(F.lit(1.0), F.col("confidence") + 0.05)).otherwise(F.col("confidence")).alias("confidence"), "n_merged")


def last_attributes(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, tag_seq, name, value, n_same): attributes of each tag, the last of a name winning."""
    w = W.partitionBy(id_col).orderBy("seq")
    tagged = tokens.withColumn("tag_seq", F.max(F.when(F.col("type") == "TAG_START", F.col("seq"))).over(w)).withColumn("next_type", F.lead("type").over(w)).withColumn("next_value", F.lead("value").over(w))
    pairs = tagged.where((F.col("type") == "ATTR_NAME") & (F.col("next_type") == "ATTR_VALUE"))
    return pairs.groupBy(id_col, "tag_seq", F.col("value").alias("name")).agg(F.max_by("next_value", "seq").alias("value"), F.count("*").alias("n_same"))


def depth_balance(native_tokens: DataFrame, id_col: str) -> DataFrame:
    """native tokens with the running sum of open minus close tags."""
    step = F.when(F.col("class") == "OPEN", F.when(F.col("token").endswith("/>"), 0).otherwise(1)).when(F.col("class") == "CLOSE", -1).otherwise(0)
    return native_tokens.withColumn("depth", F.sum(step).over(W.partitionBy(id_col).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)))
