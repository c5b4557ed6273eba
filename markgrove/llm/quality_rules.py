"""Quality rules on repetition inside a document, from a suffix array of its words.

Suffix arrays of all documents of a block are built together by prefix doubling (a suffix ends with its document), the
longest common prefixes of neighbours follow from the ranks of all doublings. The deepest LCP interval of a suffix is
the longest repeat that starts there; the spans of repeats of min_words and more are united. A document fails if its
united spans cover more than max_covered of its words or if a repeat is longer than max_longest words.

Defined results: a null text counts as empty (no words, so base_failed); lines without a word are no duplicates;
repeated rows are judged alike, each for itself; texts of any length are judged whole; an empty table stays empty; extra columns,
whatever their names, are not carried by measure() and pass through kept(). A document is held whole by one task: about 100 bytes a word of the longest one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.parse import spread
from .common import tune

#: Fixed values of the base rules.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
MIN_WORDS, BASE_WINDOW = 50, 3

#: Shortest repeat that counts as covering, the covered share that is still allowed, and the longest allowed repeat.
REPEAT_WORDS, MAX_COVERED, MAX_LONGEST = 8, 0.4, 100

#: Words of one block of suffix arrays; a longer document is a block of its own.
BLOCK_WORDS = 120_000


def suffix_array(words: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order (by document, then words) and the ranks after each doubling. end: for each word the end of its document."""
    n = len(words)
    at = np.arange(n, dtype=np.int64)
    key = (end.astype(np.int64) << 32) | words
    order = np.argsort(key, kind="stable")
    rank, slots, k, levels = np.empty(n, dtype=np.int64), at, 1, []
    key = key[order]
    while True:
        new = np.ones(len(slots), dtype=bool)  # which of the slots begins a group
        np.not_equal(key[1:], key[:-1], out=new[1:])
        starts = slots[new]
        sizes = np.diff(np.append(np.flatnonzero(new), len(slots)))
        rank[order[slots]] = np.repeat(starts, sizes)
        levels.append(rank.copy())
        slots = slots[np.repeat(sizes > 1, sizes)]
        if not len(slots):
            return order, levels
        own = order[slots]
        ahead = own + k
        inside = ahead < end[own]
        then = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        key = rank[own] * (n + 1) + then
        by = np.argsort(key, kind="stable")
        order[slots], key, k = own[by], key[by], 2 * k


def longest_repeats(words: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest repeat in its document that starts there (0: none)."""
    n = len(words)
    found = np.zeros(n, dtype=np.int64)
    if n < 2:
        return found
    order, levels = suffix_array(words, end)
    pairs = np.flatnonzero(levels[0][order[:-1]] == levels[0][order[1:]])
    a, b = order[pairs], order[pairs + 1]
    lcp = np.zeros(len(pairs), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        inside = (x < end[a]) & (y < end[b])
        same = inside & (levels[level][np.where(inside, x, 0)] == levels[level][np.where(inside, y, 0)])
        lcp[same] += 1 << level
    np.maximum.at(found, a, lcp)
    np.maximum.at(found, b, lcp)
    return found


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0


def block_counts(texts: list[list[bytes]], min_words: int) -> list[tuple[int, int, int]]:
    """(words in repeated 3-word windows, words covered by repeats of min_words and more, longest repeat) of each word list."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ids: dict[bytes, int] = defaultdict(count().__next__)
    words = np.fromiter((i for t in texts for i in map(ids.__getitem__, t)), dtype=np.int64, count=int(sizes.sum()))
    ends = np.cumsum(sizes)
    end, n = np.repeat(ends, sizes), len(words)
    longest = longest_repeats(words, end)
    doc = np.repeat(np.arange(len(texts)), sizes)
    near, far = np.flatnonzero(longest >= BASE_WINDOW), np.flatnonzero(longest >= min_words)
    windows = np.bincount(doc, covered(near, np.full(len(near), BASE_WINDOW), n), len(texts))
    spans = np.bincount(doc, covered(far, longest[far], n), len(texts))
    most = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(most, doc, longest)
    return list(zip(windows.astype(int).tolist(), spans.astype(int).tolist(), most.tolist(), strict=True))


def text_counts(text: str, n_words: int) -> tuple[int, int, int]:
    """word_chars, n_symbols, n_dup_lines."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


def counts_of(texts: list[str | None], min_words: int) -> list[list[int]]:
    """COUNTS by column for a batch of texts."""
    out, block, size = [], [], 0

    def close() -> None:
        nonlocal block, size
        for (text, words), more in zip(block, block_counts([w for _, w in block], min_words), strict=True):
            out.append((len(words), *text_counts(text, len(words)), *more))
        block, size = [], 0

    for text in texts:
        words = (text or "").encode("utf-8", "replace").split()
        if block and size + len(words) > BLOCK_WORDS:
            close()
        block.append((text or "", words))
        size += len(words)
    if block:
        close()
    return [list(c) for c in zip(*out, strict=True)] or [[] for _ in COUNTS]


def measure(docs: DataFrame, carry: list[str], min_words: int = REPEAT_WORDS) -> DataFrame:
    """The columns of carry and COUNTS of each row's text."""
    tune(docs.sparkSession)
    plain = docs.select(*carry, *(["text"] if "text" not in carry else []))
    schema = docs.select(*carry).schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = counts_of(batch.column("text").to_pylist(), min_words)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *(pa.array(c, type=pa.int64()) for c in found)], names=[*carry, *COUNTS])

    return spread(plain).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> Column:
    """Whether the document passes the repetition limits."""
    return (F.col("n_covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept for every row."""
    return measure(docs, ["doc_id"]).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict())


def kept(docs: DataFrame) -> DataFrame:
    """The rows that pass, with their own columns (a column that has the name of a count is kept as it is)."""
    own = docs.columns
    safe = docs.select(F.struct(*own).alias("row"), "text")
    return measure(safe, ["row"]).where(~base_failed() & verdict()).select("row.*")


def _windows(n: int, name: str) -> str:
    """Distinct positions of words in n-word windows that a document holds twice or more, counted by document."""
    return f"""{name} AS (
  SELECT doc_row, count(DISTINCT p) AS n FROM (
    SELECT doc_row, unnest(range(i, i + {n})) AS p FROM (
      SELECT doc_row, i, count(*) OVER (PARTITION BY doc_row, gram) AS c
      FROM (SELECT doc_row, i, ws[i:i + {n - 1}] AS gram FROM (SELECT doc_row, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w WHERE len(ws) >= {n}))
    ) WHERE c > 1
  ) GROUP BY doc_row)"""


#: judge() in DuckDB, without longest_repeat: repeats of n words and more cover what repeated n-word windows cover.
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc_row, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), l AS (
  SELECT doc_row, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_row, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_row
), {_windows(BASE_WINDOW, "g")}, {_windows(REPEAT_WORDS, "c")}, {_windows(MAX_LONGEST + 1, "t")},
counted AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines,
         coalesce(g.n, 0)::BIGINT AS n_repeat_words, coalesce(c.n, 0)::BIGINT AS n_covered_words, t.n IS NOT NULL AS too_long
  FROM w LEFT JOIN l USING (doc_row) LEFT JOIN g USING (doc_row) LEFT JOIN c USING (doc_row) LEFT JOIN t USING (doc_row)
), judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT * EXCLUDE (too_long), NOT base_failed AND n_covered_words <= {MAX_COVERED} * n_words AND NOT too_long AS kept FROM judged
"""
