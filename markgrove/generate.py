"""Seeded malformed documents for tests: each generator takes its own random state, so a suite is reproducible."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE = '<root><item id="1">alpha</item><item id="2">beta</item></root>'


def unclosed_tag(r: random.Random) -> str:
    return BASE.replace("</item>", "", r.randint(1, 2))


def mismatched_tag(r: random.Random) -> str:
    return BASE.replace("</item>", f"</{r.choice(['other', 'itme', 'ITEM'])}>", 1)


def invalid_character(r: random.Random) -> str:
    at = r.randrange(6, len(BASE) - 7)
    return BASE[:at] + chr(r.choice([0, 1, 2, 11, 12, 31])) + BASE[at:]


def broken_attribute(r: random.Random) -> str:
    return BASE.replace('id="1"', r.choice(["id=1", 'id="1', "id=", "=1", 'id="1" id="2"']))


def nested_overflow(r: random.Random) -> str:
    n = r.randint(200, 2000)
    return "<n>" * n + "x" + "</n>" * r.randint(0, n)


def entity_overflow(r: random.Random) -> str:
    return "<root>" + "&e;" * r.randint(60, 400) + "</root>"


def cdata_corruption(r: random.Random) -> str:
    return f"<root>{r.choice(['<![CDATA[open', '<![CDATA text]]>', ']]> lone', '<![CDATA[a]]b]>'])}</root>"


def namespace_error(r: random.Random) -> str:
    return r.choice(["<a:root><b:x/></a:root>", '<root xmlns:a=""><a:x/></root>', "<:root></:root>"])


def missing_declaration(r: random.Random) -> str:
    return r.choice(["<?xml?>", "<?xml version=1.0?>", "<?xml version='1.0'>", "<?xml"]) + BASE


def invalid_encoding(r: random.Random) -> str:
    return f'<?xml version="1.0" encoding="{r.choice(["no-such", "", "utf-99"])}"?>' + BASE


GENERATORS: dict[str, Callable[[random.Random], str]] = {f.__name__: f for f in (unclosed_tag, mismatched_tag, invalid_character, broken_attribute, nested_overflow, entity_overflow, cdata_corruption, namespace_error, missing_declaration, invalid_encoding)}

EDGE_CASES = {
    "empty": "",
    "white_space": " \t\r\n ",
    "single_character": "<",
    "huge_attribute": f'<a b="{"x" * 50_000}"/>',
    "many_attributes": "<a " + " ".join(f'a{i}="{i}"' for i in range(2000)) + "/>",
    "unicode_extremes": "<é>\U0010ffff\u0000퟿</é>",
    "instructions": "<?a?><?b ?><r><?c d?></r><?e",
}


def suite(n: int, seed: int = 0) -> list[tuple[int, str, str]]:
    """n cases (id, kind, content): six in ten malformed, three edge cases, one mutated well-formed text."""
    r, out = random.Random(seed), []
    for i in range(n):
        if i % 10 < 6:
            kind = sorted(GENERATORS)[i // 10 % len(GENERATORS)] if i % 2 else r.choice(sorted(GENERATORS))
            out.append((i, kind, GENERATORS[kind](r)))
        elif i % 10 < 9:
            kind = r.choice(sorted(EDGE_CASES))
            out.append((i, kind, EDGE_CASES[kind]))
        else:
            at = r.randrange(len(BASE))
            out.append((i, "mutated", BASE[:at] + r.choice("<>&\"'/= ") + BASE[at + r.randint(0, 3) :]))
    return out


def coverage(cases: list[tuple[int, str, str]]) -> Counter[str]:
    return Counter(kind for _, kind, _ in cases)


def frame(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    return spark.createDataFrame(suite(n, seed), "doc_id long, kind string, content string")


def patterns(elements: DataFrame) -> DataFrame:
    """What a corpus is made of: (parent_tag, tag, n), by which variations can be drawn."""
    from pyspark.sql import functions as F

    return elements.groupBy("parent_tag", "tag").agg(F.count("*").alias("n"))


def variation(rows: list[tuple[str | None, str, int]], seed: int, size: int = 20) -> str:
    """A well-formed text drawn from patterns() rows: each tag gets children in proportion to their counts."""
    r = random.Random(seed)
    by: dict[str | None, list[tuple[str, int]]] = {}
    for parent, tag, n in sorted(rows, key=repr):
        by.setdefault(parent, []).append((tag, n))

    def pick(parent: str | None) -> str | None:
        kids = by.get(parent)
        return r.choices([t for t, _ in kids], [n for _, n in kids])[0] if kids else None

    out, stack = [], [pick(None) or "root"]
    out.append(f"<{stack[0]}>")
    for _ in range(size):
        tag = pick(stack[-1])
        if tag is None or (len(stack) > 1 and r.random() < 0.4):
            if len(stack) > 1:
                out.append(f"</{stack.pop()}>")
            continue
        out.append(f"<{tag}>")
        stack.append(tag)
    return "".join([*out, *(f"</{t}>" for t in reversed(stack))])
