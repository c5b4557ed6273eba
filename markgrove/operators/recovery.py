"""Recovery strategies as pure functions, and their history as a table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

STRATEGIES = ("skip_until_valid", "insert_missing_structure", "treat_as_text", "balanced_repair", "character_escape", "context_inference")


class Recovered(NamedTuple):
    """What a strategy makes of an offending character: tokens as (type, value, confidence), and its own confidence."""

    strategy: str
    tokens: tuple[tuple[str, str, float], ...]
    confidence: float


def skip_until_valid(char: str, **_: object) -> Recovered:
    return Recovered("skip_until_valid", (("INVALID_CHARS", char, 0.1),), 0.1)


def final_fallback(char: str, **_: object) -> Recovered:
    return Recovered("treat_as_text", (("TEXT", char, 0.1),), 0.1)


def treat_as_text(char: str, **_: object) -> Recovered:
    return Recovered("treat_as_text", (("TEXT", char, 0.9),), 0.9)


def insert_missing_structure(char: str, state: str = "", **_: object) -> Recovered:
    if state == "TAG_OPENING" and char == ">":
        made: tuple[tuple[str, str, float], ...] = (("TAG_NAME", "unknown", 0.3), ("SYNTHETIC_CLOSE", ">", 0.8))
    elif state == "ATTR_VALUE_START":
        made = (("ATTR_VALUE", "", 0.3),)
    else:
        made = (("RECOVERED_CONTENT", char, 0.5),)
    return Recovered("insert_missing_structure", made, 0.6)


def balanced_repair(char: str, error_type: str = "", recent: tuple[tuple[str, str], ...] = (), **_: object) -> Recovered:
    """Closes the last tag named in the last ten tokens of an unmatched tag; else text."""
    names = [value for kind, value in recent[-10:] if kind == "TAG_NAME" and value]
    if names and error_type == "unmatched_tag":
        return Recovered("balanced_repair", (("BALANCED_STRUCTURE", f"</{names[-1]}>", 0.4),), 0.4)
    return treat_as_text(char)


def character_escape(char: str, **_: object) -> Recovered:
    return Recovered("character_escape", (("TEXT", {"<": "&lt;", ">": "&gt;", "&": "&amp;"}.get(char, char), 0.8),), 0.8)


def context_inference(char: str, state: str = "", around: str = "", recent: tuple[tuple[str, str], ...] = (), **_: object) -> Recovered:
    guesses = (
        (state == "ATTR_VALUE_START" and char in "\"'" and "=" in around, ("ATTR_VALUE", "", 0.6)),
        (char == "<" and bool(around) and not around[-1].isalpha(), ("TEXT", "&lt;", 0.7)),
        (state == "TEXT_CONTENT" and char == ">" and all(kind != "TAG_START" for kind, _ in recent[-3:]), ("TEXT", "&gt;", 0.7)),
        (state == "TEXT_CONTENT" and "]]>" in around, ("RECOVERED_CONTENT", char, 0.5)),
    )
    for holds, token in guesses:
        if holds:
            return Recovered("context_inference", (token,), token[2])
    return treat_as_text(char)


FUNCTIONS = {f.__name__: f for f in (skip_until_valid, insert_missing_structure, treat_as_text, balanced_repair, character_escape, context_inference)}


def choose(effectiveness: dict[str, float]) -> str:
    """The most effective strategy; of equals the first."""
    return max(STRATEGIES, key=lambda s: effectiveness.get(s, 0.5))


def learned(effectiveness: float, success: bool, rate: float = 0.1) -> float:
    """A strategy's effectiveness after another attempt."""
    return min(1.0, effectiveness + rate) if success else max(0.0, effectiveness - rate)


def history(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, seq, error_type, strategy, success, confidence, offset): one row per token repaired."""
    each = tokens.where(F.size("repairs") > 0).select(id_col, "seq", "type", "confidence", "offset", F.explode("repairs").alias("r"))
    strategy = F.when(F.col("type") == "INVALID_CHARS", "skip_until_valid").when(F.col("type") == "SYNTHETIC_CLOSE", "insert_missing_structure").otherwise("treat_as_text")
    return each.select(id_col, "seq", F.col("r.repair_type").alias("error_type"), strategy.alias("strategy"), (F.col("confidence") > 0.1).alias("success"), "confidence", "offset")


def success_rates(entries: DataFrame) -> DataFrame:
    return entries.groupBy("strategy").agg(F.count("*").alias("n"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("confidence").alias("mean_confidence"))


def usual_strategy(entries: DataFrame, id_col: str = "doc_id", last: int = 100) -> DataFrame:
    """Per document and error type the most frequent strategy of the last attempts (of equals the least name)."""
    rank = F.row_number().over(W.partitionBy(id_col, "error_type").orderBy(F.desc("seq")))
    n = entries.withColumn("rank", rank).where(F.col("rank") <= last).groupBy(id_col, "error_type", "strategy").agg(F.count("*").alias("n"))
    return n.groupBy(id_col, "error_type").agg(F.min_by("strategy", F.struct(-F.col("n"), "strategy")).alias("strategy"))


def recent(entries: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    rank = F.row_number().over(W.partitionBy(id_col).orderBy(F.desc("seq")))
    return entries.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def severity(reason: str, around: str = "", errors: int = 0) -> float:
    """How bad a malformation looks, in [0, 1]."""
    score = 0.3
    for words, more in ((("name",), 0.2), (("attribute",), 0.3), (("structure", "tag"), 0.2)):
        score += more if any(w in reason.lower() for w in words) else 0
    score += 0.2 if "<>" in around else 0.1 if any(not c.isalnum() and not c.isspace() for c in around) else 0
    return min(1.0, score + (0.2 if errors > 5 else 0))


def pattern_key(error_type: str, state: str, around: str) -> str:
    """What a successful strategy is remembered by: the error, the lexer's state and the first twenty characters around."""
    return f"{error_type}:{state}:{around[:20]}"


def detailed_report(entries: DataFrame) -> DataFrame:
    """One row over a history: entries, rates, and maps of counts and success rates by strategy, kind of error and confidence bin.

    The history is counted once by all three, which leaves as few rows as there are combinations; the maps come from these.
    """
    bins = F.least(F.lit(4), F.floor(F.col("confidence") * 5)).cast("int").alias("bin")
    counted = entries.groupBy("strategy", "error_type", bins).agg(F.count("*").alias("n"), F.count_if("success").alias("good"), F.sum("confidence").alias("confidence"))
    row = counted.agg(F.array_sort(F.collect_list(F.struct("strategy", "error_type", "bin", "n", "good", "confidence"))).alias("c"))

    def total(rows: Column, field: str) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda a, x: a + x[field])

    def by(field: str, value) -> Column:
        names = F.array_sort(F.array_distinct(F.transform("c", lambda x: x[field])))
        return F.map_from_arrays(names, F.transform(names, lambda k: value(F.filter("c", lambda x: x[field] == k))))

    def n_of(rows: Column) -> Column:
        return total(rows, "n").cast("long")

    n = total(F.col("c"), "n")
    return row.select(
        n.cast("long").alias("total_entries"), F.try_divide(total(F.col("c"), "good"), n).alias("overall_success_rate"), F.try_divide(total(F.col("c"), "confidence"), n).alias("average_confidence"),
        by("strategy", n_of).alias("strategy_counts"), by("strategy", lambda rows: total(rows, "good") / total(rows, "n")).alias("strategy_success_rates"),
        by("error_type", n_of).alias("error_types"), by("bin", n_of).alias("confidence_distribution"),
    )
