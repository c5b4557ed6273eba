"""Threat patterns and input policy as Column expressions: one counting column per pattern, no joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attack patterns (fixed values), by attack type. Group repetitions are written possessively, as Java's engine recurses otherwise.
PATTERNS = {
    "xxe": (
        r"""<!ENTITY\s+\w+\s+SYSTEM\s+["'][^"']+["']""",
        r"""<!ENTITY\s+\w+\s+PUBLIC\s+["'][^"']*["']\s+["'][^"']+["']""",
        r"&\w+;.*SYSTEM",
        r"file://",
        r"gopher://",
        r"ftp://",
        r"<!ENTITY.*%",
    ),
    "billion_laughs": (
        r"""<!ENTITY\s+\w+\s+"[^"]*&\w+[^"]*\"""",
        r"&\w+;.*&\w+;.*&\w+;",
        r"""<!ENTITY\s+\w+\s+"(?:(?:[^"&]|&(?!\w++;))*+&\w++;){3,}+[^"]*+\"""",
    ),
    "zip_bomb": (
        r"<\w+[^>]*>\s*[A-Za-z0-9+/]{1000,}={0,2}\s*</\w+>",
        r"""encoding\s*=\s*["'](?:gzip|deflate|compress)["']""",
        r"content-encoding:\s*(?:gzip|deflate)",
    ),
    "quadratic_blowup": (
        r"<(\w+)[^>]*>(?:[^<]*+<\1[^>]*+>[^<]*+</\1>){10,}+[^<]*</\1>",
        r"""<\w+[^>]*?(?:\s++\w++\s*+=\s*+["'][^"']*+["']){20,}+""",
    ),
    "resource_exhaustion": (
        r"<\w+>[^<]{10000,}</\w+>",
        r"(?:<\w++[^>]*+>\s*+){200,}+",
        r"""<\w+(?:\s++\w++="[^"]*+"){200,}+""",
    ),
    "injection": (
        r"(?s)<script[^>]*>.*?</script>",
        r"javascript:",
        r"vbscript:",
        r"on\w+\s*=",
        r"<\?php",
        r"<%.*%>",
    ),
    "namespace_confusion": (
        r"""xmlns:\w*=\s*["'](?:javascript:|data:|vbscript:)""",
        r"""<\w+:\w+.*xmlns:\w+\s*=\s*["'][^"']{200,}["']""",
        r"""xmlns\s*=\s*["']["']""",
    ),
    "schema_poisoning": (
        r"""<!DOCTYPE[^>]+SYSTEM\s+["']https?://[^"']+\.dtd["']""",
        r"""xsi:schemaLocation\s*=\s*["'].*https?://[^"']+\.xsd""",
        r"""<!ATTLIST.*CDATA\s+"[^"]*javascript:""",
    ),
}

#: Threat level, description and mitigation of each attack type (fixed values).
LEVELS = {
    "xxe": "critical", "billion_laughs": "critical", "zip_bomb": "critical", "resource_exhaustion": "high", "injection": "high",
    "quadratic_blowup": "medium", "schema_poisoning": "medium", "namespace_confusion": "low",
}
DESCRIPTIONS = {
    "xxe": "XML External Entity (XXE) attack detected - external entity processing",
    "billion_laughs": "Billion Laughs attack detected - exponential entity expansion",
    "zip_bomb": "ZIP Bomb attack detected - compressed content expansion",
    "quadratic_blowup": "Quadratic Blowup attack detected - polynomial content expansion",
    "resource_exhaustion": "Resource Exhaustion attack detected - excessive resource consumption",
    "injection": "XML Injection attack detected - malicious script injection",
    "namespace_confusion": "Namespace Confusion attack detected - namespace manipulation",
    "schema_poisoning": "Schema Poisoning attack detected - malicious schema definition",
}
MITIGATIONS = {
    "xxe": "Disable external entity processing and use secure XML parser configuration",
    "billion_laughs": "Limit entity expansion depth and disable entity processing",
    "zip_bomb": "Implement content size limits and validate compressed content",
    "quadratic_blowup": "Limit element depth and attribute count",
    "resource_exhaustion": "Implement input size limits and processing timeouts",
    "injection": "Validate and sanitize all XML content before processing",
    "namespace_confusion": "Validate namespace declarations and URIs",
    "schema_poisoning": "Use trusted schemas and disable external schema loading",
}

#: Literals without which a pattern cannot match (attack type, pattern number): its search, quadratic on long lines, is then left out.
NEEDS = {("xxe", 3): "system", ("xxe", 7): "<!entity", ("billion_laughs", 3): "<!entity", ("schema_poisoning", 2): ".xsd", ("schema_poisoning", 3): "<!attlist", ("namespace_confusion", 2): "xmlns:", ("injection", 6): "%>"}

#: Which levels block a document at each security level (fixed values).
BLOCKS = {"paranoid": ("critical", "high", "medium", "low"), "strict": ("critical", "high"), "permissive": ("critical",)}

FLAGS = "(?idU)"


def java(pattern: str) -> str:
    """A pattern for Java's engine: case is ignored, line ends and classes are those of Python's."""
    return FLAGS + pattern


def threats(content_col: str = "content", types: tuple[str, ...] | None = None, custom: dict[str, tuple[str, ...]] | None = None, with_matches: bool = False) -> Column:
    """The array of a document's threats, one for each pattern (of the attack types) that matches: attack_type, pattern_no, threat_level, n_matches (and matches)."""
    found, low = [], F.lower(content_col)
    for attack in types or PATTERNS:
        patterns = PATTERNS[attack]
        for k, p in enumerate((*patterns, *(custom or {}).get(attack, ())), 1):
            n = F.regexp_count(content_col, F.lit(java(p)))
            if (attack, k) in NEEDS:
                n = F.when(low.contains(NEEDS[attack, k]), n).otherwise(0)
            fields = [F.lit(attack).alias("attack_type"), F.lit(k).alias("pattern_no"), F.lit(LEVELS[attack]).alias("threat_level"), n.alias("n_matches")]
            if with_matches:
                fields.append(F.regexp_extract_all(content_col, F.lit(java(p)), 0).alias("matches"))
            found.append(F.struct(*fields))
    return F.filter(F.array(*found), lambda t: t["n_matches"] > 0)


def scan(df: DataFrame, id_col: str, content_col: str = "content", types: tuple[str, ...] | None = None, custom: dict[str, tuple[str, ...]] | None = None, with_matches: bool = False) -> DataFrame:
    """One row per document and threat."""
    return df.select(id_col, F.inline(threats(content_col, types, custom, with_matches)))


def decisions(df: DataFrame, id_col: str, level: str = "strict", content_col: str = "content", types: tuple[str, ...] | None = None) -> DataFrame:
    """Each document's decision, made in its own row: id, n_threats, blocked."""
    found = df.select(id_col, threats(content_col, types).alias("t"))
    return found.select(id_col, F.size("t").alias("n_threats"), F.exists("t", lambda t: t["threat_level"].isin(*BLOCKS[level])).alias("blocked"))


def described(found: DataFrame) -> DataFrame:
    """Threat rows with the description and the mitigation of their attack type."""
    out = found
    for name, texts in (("description", DESCRIPTIONS), ("mitigation", MITIGATIONS)):
        out = out.withColumn(name, F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])[F.col("attack_type")])
    return out


def statistics(decided: DataFrame, found: DataFrame) -> DataFrame:
    """One row over decisions and threat rows: total_requests, blocked_requests, block_rate, threats_detected, threat_types (a map of at most eight types)."""
    requests = decided.agg(F.count("*").alias("total_requests"), F.count_if("blocked").alias("blocked_requests"))
    by_type = found.groupBy("attack_type").agg(F.count("*").alias("n"))
    types = by_type.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("threats_detected"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("attack_type", "n")))).alias("threat_types"))
    both = requests.unionByName(types, allowMissingColumns=True).agg(*[F.any_value(c, ignoreNulls=True).alias(c) for c in ("total_requests", "blocked_requests", "threats_detected", "threat_types")])
    rate = F.col("blocked_requests") / F.greatest(F.lit(1), F.col("total_requests"))
    return both.select("total_requests", "blocked_requests", rate.alias("block_rate"), "threats_detected", "threat_types")


@dataclass(frozen=True)
class Policy:
    """Input limits. mode "observed" counts every open bracket as depth; "contract" takes the nesting of tags."""

    max_input_size: int = 10 << 20
    max_attribute_count: int = 1000
    max_element_depth: int = 100
    max_entity_references: int = 50
    forbidden_elements: tuple[str, ...] = ()
    forbidden_attributes: tuple[str, ...] = ()
    allowed_protocols: tuple[str, ...] = ("http", "https")
    mode: str = "contract"


DANGEROUS_PROTOCOLS = ("javascript", "vbscript", "data", "file")


def nesting_depth(text: Column) -> Column:
    """Deepest nesting of open tags, by a running sum over the text's tags that never falls under 0."""
    steps = F.transform(F.regexp_extract_all(text, F.lit(r"</?[A-Za-z_:][^>]*>"), 0), lambda t: F.when(t.startswith("</"), -1).when(t.endswith("/>"), 0).otherwise(1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, d: Column) -> Column:
        now = F.greatest(F.lit(0), acc["now"] + d)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(steps, start, step, lambda acc: acc["most"])


def rejection(text: Column, policy: Policy = Policy()) -> Column:
    """The first reason for which the policy rejects a text, or null."""
    low = F.lower(text)
    longest = F.array_max(F.transform(F.split(text, "\n"), lambda x: F.length(x)))
    attributes = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"<\w+([^>]*)>"), 1), lambda x: F.regexp_count(x, F.lit(r"""\w+\s*=\s*["'][^"']*["']"""))))
    depth = nesting_depth(text) if policy.mode == "contract" else F.regexp_count(text, F.lit("<"))
    out = F.when(text.isNull(), "invalid_type").when(text.rlike(r"\x00"), "null_bytes").when(text.rlike(r"[\x01-\x08\x0B\x0C\x0E-\x1F]"), "control_characters")
    out = out.when(F.length(text) > policy.max_input_size, "size_limit_exceeded").when(longest > min(policy.max_input_size // 10, 100_000), "line_too_long")
    for e in policy.forbidden_elements:
        out = out.when(low.contains(f"<{e}"), f"forbidden_element_{e}")
    for a in policy.forbidden_attributes:
        out = out.when(low.contains(f" {a}="), f"forbidden_attribute_{a}")
    for p in DANGEROUS_PROTOCOLS:
        if p not in policy.allowed_protocols:
            out = out.when(low.contains(f"{p}:"), f"dangerous_protocol_{p}")
    out = out.when(depth > policy.max_element_depth, "depth_limit_exceeded").when(attributes > policy.max_attribute_count, "attribute_count_exceeded")
    return out.when(F.regexp_count(text, F.lit(r"&\w+;")) > policy.max_entity_references, "entity_reference_limit")


def audit(found: DataFrame) -> DataFrame:
    """Threat rows by attack type and level: documents and matches."""
    return found.groupBy("attack_type", "threat_level").agg(F.count("*").alias("n_threats"), F.sum("n_matches").alias("n_matches"))
