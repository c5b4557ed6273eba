"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs, plus signs, digits, URL schemes and identifier cues
(IBAN, SSN, token, password ...). At each anchor a deterministic local parser expands to the boundaries of an address or
account and validates it. Every parser is linear: a run of characters is walked once, whether it holds a match or not.

Defined results: spans are [start, end) in code points, leftmost and non-overlapping within a kind, by kind and then start;
a null text is empty; a failing match is dropped without another try inside it (an IBAN is tried at each end of a word); cues
are found in any case; texts of any length are scanned whole, in one task each; repeated rows get the same spans; an empty
table stays empty; other columns, whatever their names, are not carried by find() and digest() unless asked for, and pass
through redact() untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.parse import spread
from .common import tune

#: The kinds in their order (the first four are the base kinds) and the cues of accounts and secrets.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "account", "secret", "url_login")
BASE_KINDS = KINDS[:4]
CUES = {
    "iban": ("iban",),
    "ssn": ("ssn", "social security"),
    "account": ("account", "acct"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key"),
    "url_login": ("://",),
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
PARSERS = {
    "iban": re.compile(r"[ :#.-]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})"),
    "ssn": re.compile(r"(?: (?:number|no\.?))?[ :#=]{0,3}([0-9]{3}[- ][0-9]{2}[- ][0-9]{4})(?![0-9])"),
    "account": re.compile(r"(?: (?:number|no\.?))?[ :#=]{1,3}([0-9]{6,17})(?![0-9A-Za-z])"),
    "secret": re.compile(r"(?: is)?\s{0,2}[:=]\s{0,2}[\"']?(?=[A-Za-z0-9_+/=.~-])"),
    "url_login": re.compile(r"[^\s:/@?#]++:[^\s/@?#]++@"),
}
SECRET = re.compile(r"[A-Za-z0-9_+/=.~-]++")

#: Characters of an IBAN by country.
IBAN_SIZES = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 "
    "GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 "
    "NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "@+0123456789":
        found.add_word(c, ("digit" if c.isdigit() else c, 1))
    for kind, cues in CUES.items():
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


ANCHORS = automaton()

#: Lower case of the ASCII letters alone.
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lowered(text: str) -> str:
    """The text in lower case, character by character."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(ASCII_LOWER)


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(twice)) % 10 == 0


def iban(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int | None:
    """Where the IBAN at start ends, of the ends of words up to end: at its country's size, or else the last that validates."""
    ends = [k for k in range(start + 15, end + 1) if text[k - 1] != " " and (k == len(text) or not (text[k].isascii() and text[k].isalnum()))]
    size = IBAN_SIZES.get(text[start : start + 2])
    ends.sort(key=lambda k: (k - start - text.count(" ", start, k) == size, k), reverse=True)
    return next((k for k in ends if iban(text[start:k])), None)


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text, by kind and start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email = ip = card = phone = 0  # where the next match of each base kind may start
    secret = 0  # the end of the last run tried as a secret; a run that starts before is a part of it
    for last, (anchor, size) in ANCHORS.iter(lowered(text)):
        start = last + 1 - size
        if anchor == "digit":
            if start >= card:
                m = CARD.match(text, start)
                card = m.end() if m else start + 1
                if m and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                    found["card"].append(m.span())
            if start >= ip:
                m = DOTTED.match(text, start)
                ip = m.end()
                if "." in (run := m[0]):
                    parts, at = run.split("."), start
                    for k in range(0, len(parts) - 3, 4):
                        four = parts[k : k + 4]
                        end = at + sum(map(len, four)) + 3
                        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                            found["ip"].append((at, end))
                        at = end + 1
        elif anchor == "@":
            at = start
            while at > email and text[at - 1] in LOCAL:
                at -= 1
            if at < start and (m := DOMAIN.match(text, start + 1)):
                email = m.end()
                found["email"].append((at, email))
            else:
                email = max(email, start + 1)  # a later local part cannot reach back over this at-sign
        elif anchor == "+":
            if start >= phone and (m := PHONE.match(text, start)):
                phone = m.end()
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif anchor == "url_login":
            if (m := PARSERS[anchor].match(text, last + 1)) and start and text[start - 1].isalpha():
                found[anchor].append(m.span())
        elif (not start or not text[start - 1].isalnum()) and (m := PARSERS[anchor].match(text, last + 1)):
            if anchor == "secret":
                if (a := m.end()) >= secret:
                    run = SECRET.match(text, a)[0]
                    secret = a + len(run)
                    if len(run) >= 16 and any(c.isdigit() for c in run):
                        found[anchor].append((a, secret))
                continue
            a, b = m.span(1)
            if anchor == "iban":
                b = iban_end(text, a, b)
            if b and (not found[anchor] or a >= found[anchor][-1][1]):
                found[anchor].append((a, b))
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans, united, the first names the kind."""
    out, at, until = [], 0, -1
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= until:
            out += [text[at:a], f"[{kind.upper()}]"]
        until = at = max(b, until)
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(df: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns of carry and `spans`, array<struct<kind, start, end>>, of each row's whole text."""
    tune(df.sparkSession)
    schema = T.StructType([*df.select(*carry).schema.fields, T.StructField("spans", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [spans_of(t) if t else [] for t in batch.column(text_col).to_pylist()]
            flat = [s for x in each for s in x]
            at = [0]
            for x in each:
                at.append(at[-1] + len(x))
            kind, start, end = (pa.array([s[i] for s in flat], type=t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64())))
            rows = pa.StructArray.from_arrays([kind, start, end], names=["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.ListArray.from_arrays(pa.array(at, type=pa.int32()), rows)], names=[*carry, "spans"])

    return spread(df.select(*carry, *([text_col] if text_col not in carry else []))).mapInArrow(run, schema)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with every span of text_col masked; n_chars, if there, follows the new text. Other columns are untouched."""
    tune(df.sparkSession)
    names, at = df.columns, df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t and masked(t, spans_of(t)) for t in batch.column(text_col).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, type=pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = df.mapInArrow(run, df.schema)
    return out.withColumn("n_chars", F.length(text_col).cast(df.schema["n_chars"].dataType)) if "n_chars" in names else out


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, base_sha256 and all spans as text."""
    found = find(docs, ["doc_id"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def n_of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [n_of(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
