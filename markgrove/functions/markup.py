"""Markup helpers as Column expressions: native lexing, escapes, entity repair, white space, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The native lexer's master pattern: one alternative per token class. It is plain enough to run alike in Java and RE2.
LEX = r"<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<\?[\s\S]*?\?>|<![^>]*>|</[A-Za-z_:][^>]*>|<[A-Za-z_:][^>]*>|[^<]+|<"

NAME_START, NAME = "[A-Za-z_:]", "[A-Za-z0-9_:.-]"
ATTRIBUTE = r"""([A-Za-z_:][A-Za-z0-9_:.-]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""

#: Entities that mark a text as escaped already (fixed values).
ENTITY = r"&(amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);"
OPEN_ENTITY = r"&(amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+)(?![;a-zA-Z0-9])"


def lex(text: Column) -> Column:
    """array<string> of a text's coarse tokens."""
    return F.regexp_extract_all(text, F.lit(LEX), 0)


def token_class(token: Column) -> Column:
    """COMMENT, CDATA, PI, DOCTYPE, CLOSE, OPEN, TEXT or STRAY."""
    return (
        F.when(token.startswith("<!--"), "COMMENT")
        .when(token.startswith("<![CDATA["), "CDATA")
        .when(token.startswith("<?"), "PI")
        .when(token.startswith("<!"), "DOCTYPE")
        .when(token.startswith("</"), "CLOSE")
        .when(token == "<", "STRAY")
        .when(token.startswith("<"), "OPEN")
        .otherwise("TEXT")
    )


def tag_name(token: Column) -> Column:
    """The lower-case name of an open or close tag token; '' for others."""
    return F.lower(F.regexp_extract(token, rf"^</?({NAME_START}{NAME}*)", 1))


def repair_entities(text: Column) -> Column:
    """Known entities without their semicolon get it."""
    return F.regexp_replace(text, OPEN_ENTITY, "&$1;")


def escape_text(text: Column) -> Column:
    """Element text for output: entities repaired; a text that holds any entity counts as escaped."""
    repaired = repair_entities(text)
    plain = F.replace(F.replace(F.replace(repaired, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.when(repaired.rlike(ENTITY), repaired).otherwise(plain)


def escape_attribute(value: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def decode_entities(text: Column) -> Column:
    """The five named entities as characters."""
    for new, old in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("'", "&#39;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def normalize_whitespace(text: Column) -> Column:
    """Tabs and line ends become spaces, runs one space, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\t\n\r]", " "), r" {2,}", " "))


def text_gt(text: Column) -> Column:
    return F.replace(text, F.lit(">"), F.lit("&gt;"))


def comment_hyphens(body: Column) -> Column:
    """Runs of hyphens inside a comment become one."""
    return F.regexp_replace(body, "--+", "-")


def sanitize_name(name: Column, strict: bool = False) -> Column:
    """A usable tag name of any text (the rules of kernel.sanitize_name)."""
    out = F.regexp_replace(F.regexp_replace(name, "[<>&\"']", ""), r"(?U)\s+", "")
    out = F.when(out.rlike("^[0-9]"), F.concat(F.lit("_" if strict else ""), F.substring(out, 2, 1 << 30))).otherwise(out)
    out = F.substring(F.regexp_replace(out, r"(?U)[^\w\-.:]", "_"), 1, 1000)
    out = F.when(out.rlike("^[a-zA-Z_:][-a-zA-Z0-9_:.]*$"), out).otherwise("repaired_tag")
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(out)


def local_name(tag: Column) -> Column:
    return F.when(tag.contains(":"), F.regexp_replace(tag, "^[^:]*:", "")).otherwise(tag)


def namespace_prefix(tag: Column) -> Column:
    return F.when(tag.contains(":"), F.substring_index(tag, ":", 1))


#: What keeps a text off the quick path (fixed values).
ODD_BRACKETS, BARE_VALUE = r"<<|>>|<>|><|< /", r"=\s*[a-zA-Z_][a-zA-Z0-9_]*(?=\s|>)"


def is_fast_path(text: Column) -> Column:
    """Whether a text looks well-formed enough for a quick lexer: no doubled or crossed brackets, no bare attributes, balanced."""
    odd = text.rlike(ODD_BRACKETS) | text.rlike(BARE_VALUE)
    balanced = F.regexp_count(text, F.lit("<")) == F.regexp_count(text, F.lit(">"))
    quotes = (F.regexp_count(text, F.lit('"')) % 2 == 0) & (F.regexp_count(text, F.lit("'")) % 2 == 0)
    return ~odd & balanced & quotes & text.rlike(r"\A\s*<[\s\S]*>\s*\z")
