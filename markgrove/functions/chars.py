"""The character layer as Column expressions: encoding detection, decoding, transformation of invalid characters."""

from __future__ import annotations

import encodings.aliases
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that XML 1.0 does not allow, as the inside of a regex class of Java and RE2 alike: control characters, and the
#: last two of each plane but for U+10FFFF, which stays valid (fixed values).
INVALID = r"\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}" + "".join(rf"\x{{{p:X}FFFE}}\x{{{p:X}FFFF}}" for p in range(16)).replace("{0FFF", "{FFF") + r"\x{10FFFE}"
INVALID_CLASS = f"[{INVALID}]"

#: Byte order marks, longest first (fixed values).
BOMS = (("FFFE0000", "utf-32-le"), ("0000FEFF", "utf-32-be"), ("EFBBBF", "utf-8"), ("FFFE", "utf-16-le"), ("FEFF", "utf-16-be"))

#: Names of encodings that are spelled otherwise (fixed values).
ALIASES = {"utf8": "utf-8", "utf16": "utf-16", "utf32": "utf-32", "iso-8859-1": "latin-1", "windows-1252": "cp1252"}

#: Bytes looked at for a declaration, and for statistics.
DECLARATION_BYTES, SAMPLE_BYTES = 1024, 8192

#: Most issues told of one content.
MAX_UTF8_ISSUES = 100

#: Encodings that make_valid_utf8 handles in the JVM; others go through Python's codecs.
NATIVE = ("utf-8", "ascii", "us-ascii")


def known_encodings() -> list[str]:
    names = {*encodings.aliases.aliases, *encodings.aliases.aliases.values(), *ALIASES.values(), "utf-8", "utf-16", "utf-32", "latin-1", "ascii"}
    return sorted({n.replace("_", "-") for n in names})


def bom(content: Column) -> Column:
    """Encoding named by a byte order mark, or null."""
    out = None
    for mark, name in BOMS:
        hit = F.hex(F.substring(content, 1, len(mark) // 2)) == mark
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def declared(content: Column) -> Column:
    """Normalised encoding of an XML declaration, or null."""
    head = F.decode(F.substring(content, 1, DECLARATION_BYTES), "ISO-8859-1")
    name = F.lower(F.trim(F.regexp_extract(head, r"(?i)<\?xml[^\n]*?encoding\s*=\s*[\"']([^\"']+)[\"']", 1)))
    name = F.when(name != "", name)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[name], name)


def ascii_ratio(content: Column) -> Column:
    """Share of bytes under 0x80 in the sample; null without bytes."""
    head = F.decode(F.substring(content, 1, SAMPLE_BYTES), "ISO-8859-1")
    return F.when(F.length(head) > 0, F.regexp_count(head, F.lit(r"[\x00-\x7F]")) / F.length(head))


def utf8_score(content: Column) -> Column:
    """Characters against half the bytes of the sample, at most 1; 0 unless the sample is UTF-8."""
    head = F.substring(content, 1, SAMPLE_BYTES)
    score = F.least(F.lit(1.0), F.length(F.make_valid_utf8(head.cast("string"))) / (F.octet_length(head) * 0.5))
    return F.when(F.is_valid_utf8(head.cast("string")), score).otherwise(0.0)


def detect(content: Column) -> Column:
    """struct<encoding, confidence, method, issues>: byte order mark, then declaration, statistics of UTF-8, UTF-8 validity, statistics of Latin-1, fallback.

    Whole content that is valid UTF-8 is never taken for Latin-1, though the end of the sample may cut a character.
    """

    def found(name: Column, confidence: Column, method: str, *issues: str) -> Column:
        return F.struct(name.alias("encoding"), confidence.cast("double").alias("confidence"), F.lit(method).alias("method"), F.array(*map(F.lit, issues)).cast("array<string>").alias("issues"))

    mark, name, ratio, score = bom(content), declared(content), ascii_ratio(content), utf8_score(content)
    latin = F.when(ratio > 0.9, 0.7).when(ratio > 0.7, 0.6).otherwise(0.3)
    return (
        F.when(content.isNull() | (F.octet_length(content) == 0), found(F.lit("utf-8"), F.lit(1.0), "fallback"))
        .when(mark.isNotNull(), found(mark, F.lit(1.0), "bom"))
        .when(name.isin(known_encodings()), found(name, F.lit(0.9), "xml_declaration"))
        .when(score > 0.8, found(F.lit("utf-8"), score, "statistical"))
        .when(F.is_valid_utf8(content.cast("string")), found(F.lit("utf-8"), F.lit(1.0), "utf8_validation"))
        .when(latin >= 0.7, found(F.lit("latin-1"), latin, "statistical"))
        .otherwise(found(F.lit("utf-8"), F.lit(0.5), "fallback", "no method was sure of an encoding"))
    )


def detect_fast(content: Column, trusted: Column | None = None) -> Column:
    """detect(), but content whose first bytes are all ASCII is taken for UTF-8 at once; only where `trusted` holds, if given."""
    head = F.decode(F.substring(content, 1, DECLARATION_BYTES), "ISO-8859-1")
    sure = F.struct(F.lit("utf-8").alias("encoding"), F.lit(1.0).alias("confidence"), F.lit("utf8_validation").alias("method"), F.array().cast("array<string>").alias("issues"))
    plain = (F.octet_length(content) > 0) & head.rlike(r"\A[\x00-\x7F]*\z")
    return F.when(plain if trusted is None else plain & trusted, sure).otherwise(detect(content))


@F.pandas_udf(T.StringType())
def _decode_other(content: pd.Series, encoding: pd.Series) -> pd.Series:
    out = []
    for c, e in zip(content, encoding, strict=True):
        try:
            out.append(None if c is None or e is None else bytes(c).decode(e, "replace"))
        except (LookupError, UnicodeError):
            out.append(bytes(c).decode("utf-8", "replace"))
    return pd.Series(out, dtype=object)


def decode(content: Column, encoding: Column, keep_bom: bool = False) -> Column:
    """Text of content; malformed bytes become U+FFFD. UTF-8 and ASCII stay in the JVM, other codecs take an Arrow batch through Python."""
    native = F.coalesce(encoding, F.lit("utf-8")).isin(*NATIVE)
    text = F.when(native, F.make_valid_utf8(content.cast("string"))).otherwise(_decode_other(F.when(~native, content), F.when(~native, encoding)))
    return text if keep_bom else F.regexp_replace(text, "^\\x{FEFF}", "")


#: Entities of the escape strategy (fixed values).
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


@dataclass(frozen=True)
class TransformConfig:
    """How invalid characters are treated: removal, replacement, escape, mapping or preservation; contexts may override."""

    default_strategy: str = "replacement"
    replacement: str = "�"
    contexts: dict[str, str] = field(default_factory=dict)
    mappings: dict[str, str] = field(default_factory=dict)

    @classmethod
    def preset(cls, name: str) -> TransformConfig:
        presets = {"strict": cls("removal"), "lenient": cls("replacement"), "data_recovery": cls("preservation")}
        if name not in presets:
            raise ValueError(f"unknown preset: {name}")
        return presets[name]

    def override(self, **changes: object) -> TransformConfig:
        return replace(self, **changes)

    def strategy(self, context: str) -> str:
        return self.contexts.get(context, self.default_strategy)


def invalid_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(INVALID_CLASS))


def transform(text: Column, config: TransformConfig = TransformConfig(), context: str = "text_content") -> Column:
    """The text with its invalid characters treated; custom mappings come first and also reach valid characters."""
    strategy = config.strategy(context)
    for old, new in config.mappings.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    if strategy in ("preservation", "mapping"):
        return text
    if strategy == "removal":
        return F.regexp_replace(text, INVALID_CLASS, "")
    if strategy == "replacement":
        return F.regexp_replace(text, INVALID_CLASS, config.replacement)
    if strategy == "escape":
        each = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(INVALID_CLASS), F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))).otherwise(c))
        return F.when(text.rlike(INVALID_CLASS), F.array_join(each, "")).otherwise(text)
    raise ValueError(f"unknown strategy: {strategy}")


def issue(code: Column) -> Column:
    """What is wrong with a code point, or null."""
    digits = F.hex(code)
    at = F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))
    kind = (
        F.when(code.between(0xD800, 0xDFFF), "Surrogate character: ")
        .when(code.isin(0x9, 0xA, 0xD), None)
        .when(code < 0x20, "Control character: ")
        .when((code % 0x10000).isin(0xFFFE, 0xFFFF) & (code != 0x10FFFF), "Non-character: ")
        .when(code > 0x10FFFF, "Invalid XML character: ")
    )
    return F.concat(kind, at)


def changes(text: Column, config: TransformConfig = TransformConfig(), context: str = "text_content") -> Column:
    """array<struct<position, original, transformed, strategy, reason>> of the invalid characters; costly, asked for only."""
    each = F.transform(F.split(text, ""), lambda c, i: F.struct(i.alias("position"), c.alias("original"), transform(c, config, context).alias("transformed"), F.lit(config.strategy(context)).alias("strategy"), issue(F.ascii(c)).alias("reason")))
    return F.filter(each, lambda x: x["original"].rlike(INVALID_CLASS))


def confidence(text: Column, n_changes: Column) -> Column:
    """1 without changes; ASCII texts lose by the share of changes, down to 0.8; others by share and number, down to 0.1."""
    share = n_changes / F.greatest(F.length(text), F.lit(1))
    full = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.lit(1.0) - share * 0.3 - F.least(F.lit(0.5), n_changes * 0.1)))
    return F.when(n_changes == 0, F.lit(1.0)).when(text.rlike(r"\A[\x00-\x7F]*\z"), F.greatest(F.lit(0.8), F.lit(1.0) - share)).otherwise(full)


def stream(df: DataFrame, content_col: str = "content", config: TransformConfig = TransformConfig()) -> DataFrame:
    """df with text, encoding (struct), text_confidence, invalid_chars: the whole character stage for bytes."""
    found = df.withColumn("encoding", detect(F.col(content_col)))
    decoded = found.withColumn("_decoded", decode(F.col(content_col), F.col("encoding.encoding")))
    n = invalid_count(F.col("_decoded"))
    both = (F.col("encoding.confidence") + confidence(F.col("_decoded"), n)) / 2
    return decoded.withColumn("invalid_chars", n).withColumn("text_confidence", both).withColumn("text", transform(F.col("_decoded"), config)).drop("_decoded")


def chunks(df: DataFrame, id_col: str, text_col: str = "text", size: int = 8192) -> DataFrame:
    """(id, chunk_no, text): texts in pieces of `size` characters; no code point is split, and an empty text has one empty chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text_col) / size)).cast("int")
    each = df.where(F.col(text_col).isNotNull()).select(id_col, text_col, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return each.select(id_col, "chunk_no", F.substring(F.col(text_col), F.col("chunk_no") * size + 1, F.lit(size)).alias("text"))


def utf8_validity(content: Column) -> Column:
    """struct<valid, confidence, issues>: strict UTF-8 gives 1.0, anything else 0.0 and the places (0-based bytes) of what is wrong; null content is valid and empty."""
    valid = F.coalesce(F.is_valid_utf8(content.cast("string")), F.lit(True))
    issues = F.when(valid, F.array().cast("array<string>")).otherwise(_utf8_issues(F.when(~valid, content)))
    return F.struct(valid.alias("valid"), F.when(valid, 1.0).otherwise(0.0).alias("confidence"), issues.alias("issues"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _utf8_issues(content: pd.Series) -> pd.Series:
    def of(raw: bytes | None) -> list[str]:
        out, at, raw = [], 0, bytes(raw or b"")
        while at < len(raw):
            try:
                raw[at:].decode("utf-8")
                break
            except UnicodeDecodeError as e:
                out.append(f"{e.reason} at byte {at + e.start}")
                if len(out) == MAX_UTF8_ISSUES:
                    break
                at += e.end
        return out

    return content.map(of)


def is_valid_char(code: Column) -> Column:
    """Whether a code point may stand in XML 1.0."""
    inside = code.isin(0x9, 0xA, 0xD) | code.between(0x20, 0xD7FF) | code.between(0xE000, 0xFFFD) | code.between(0x10000, 0x10FFFF)
    return inside & (((code % 0x10000) < 0xFFFE) | (code == 0x10FFFF))
