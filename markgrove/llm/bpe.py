"""Byte-level BPE encoding and decoding.

A piece of text is encoded with a priority queue of (merge rank, position) over a doubly linked list of symbols; queue
entries whose symbols have since been merged are stale and skipped, so a piece of n bytes takes O(n log n). Decoding
concatenates the byte strings of the vocabulary.

Defined results: a null text is the empty text (no ids); other columns pass through untouched; null ids and ids that are
not in the vocabulary are an error; null or empty arrays of ids are the empty text; texts of any length are encoded whole, in
one task each; equal rows get equal ids; an empty table stays empty; bytes that are no UTF-8 decode to U+FFFD as the tokenizers library does.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.parse import spread
from .common import tune

#: The pre-tokenizer's pattern, a fixed value of the byte-level tokenizers. White space is spelled out, as regex counts U+001C-1F in.
SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Pieces whose ids a kernel remembers, in each of two generations.
CACHE_PIECES = 225_000


def byte_names() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself if printable, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    names, spare = [], 0x100
    for b in range(256):
        names.append(chr(b if b in printable else spare))
        spare += b not in printable
    return names


#: Below this character, the standard library's faster engine splits the text, with the classes written out.
LATIN_END = "\u0250"


def latin_pieces() -> re.Pattern[str]:
    """PIECES for texts of characters under LATIN_END."""
    of = {p: "".join(re.escape(c) for c in map(chr, range(ord(LATIN_END))) if regex.match(rf"\p{{{p}}}", c)) for p in "LN"}
    space = r"\t-\r \x85\xa0"
    return re.compile(rf" ?[{of['L']}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{of['N']}]+| ?[^{space}{of['L']}{of['N']}]+|[{space}]+(?![^{space}])|[{space}]+")


class Codec:
    """Encoder and decoder of one vocabulary file (the text of a byte-level BPE tokenizer.json)."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError("not a plain byte-level BPE file")
        names = byte_names()
        back = {c: b for b, c in enumerate(names)}
        vocab = model["vocab"]
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        added = spec.get("added_tokens") or []
        self.special = {t["content"]: t["id"] for t in added}
        self.bytes_of |= {t["id"]: t["content"].encode() for t in added}
        self.size = max(self.bytes_of) + 1
        self.first = [vocab[names[b]] for b in range(256)]
        self.rank_of: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank_of[(vocab[a] << 32) | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.any_pieces, self.latin_pieces = regex.compile(PIECES, regex.V1), latin_pieces()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.table = [self.bytes_of.get(i) for i in range(self.size)]

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece. A queue entry is rank and position as one number; it is stale if the pair now there has another rank."""
        ids, n = [self.first[b] for b in raw], len(raw)
        rank_of, made, push, pop = self.rank_of.get, self.made, heapq.heappush, heapq.heappop
        queue, a = [], ids[0]
        for i in range(1, n):
            b = ids[i]
            if (rank := rank_of(a << 32 | b)) is not None:
                queue.append(rank << 32 | i - 1)
            a = b
        if not queue:
            return ids
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = pop(queue)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if j >= n or (a := ids[i]) < 0 or rank_of(a << 32 | ids[j]) != rank:
                continue
            new = ids[i] = made[rank]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of(new << 32 | ids[k])) is not None:
                    push(queue, rank << 32 | i)
            if (h := before[i]) >= 0 and (rank := rank_of(ids[h] << 32 | new)) is not None:
                push(queue, rank << 32 | h)
        return [i for i in ids if i >= 0]

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text as little-endian int32."""
        cache, out = self.cache, []
        pieces = (self.latin_pieces if text.isascii() or max(text) < LATIN_END else self.any_pieces).findall
        parts = self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                out.append(np.int32(self.special[part]).tobytes())
                continue
            for piece in pieces(part):
                ids = cache.get(piece)
                if ids is None:
                    ids = self.older.pop(piece, None)
                    if ids is None:
                        ids = array("i", self.merge(piece.encode("utf-8", "replace"))).tobytes()
                    if len(piece) < 100:
                        if len(cache) >= CACHE_PIECES:  # what has not been met since the last change goes
                            self.older, self.cache = cache, {}
                            cache = self.cache
                        cache[piece] = ids
                out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text or ""), dtype="<i4").tolist()

    def decode(self, ids: list[int] | None) -> str:
        table = self.table
        if ids and not 0 <= min(ids) <= max(ids) < len(table):
            raise ValueError(f"ids outside the vocabulary: {min(ids)} to {max(ids)}")
        return b"".join([table[i] for i in ids or ()]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _codec(spec: str) -> Codec:
    codec = Codec(spec)
    gc.freeze()  # the tables stay as long as the worker: the collector need not walk them
    return codec


class _Shared:
    """The vocabulary (bounded: one file) as a broadcast value; each Python worker parses it once."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as f:
            spec = f.read()
        Codec(spec)  # a bad file fails here, not in a task
        self.value = spark.sparkContext.broadcast(spec)

    def codec(self) -> Codec:
        return _codec(self.value.value)


def coded(df: DataFrame, path: str, source_col: str, outputs: dict[str, str]) -> DataFrame:
    """df with columns made by one kernel, outputs: name -> "ids" or "decoded" (own columns of these names are replaced).

    source_col is the text to encode; if only "decoded" is asked for, it may be the ids. Decoding always starts from the ids.
    """
    spark = tune(df.sparkSession)
    shared, kept = _Shared(spark, path), [c for c in df.columns if c not in outputs]
    from_text = isinstance(df.schema[source_col].dataType, T.StringType)
    kinds = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}
    schema = T.StructType([f for f in df.schema.fields if f.name in kept] + [T.StructField(n, kinds[k]) for n, k in outputs.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.codec()
        for batch in batches:
            if from_text:
                each = [codec.encode_bytes(t) if t else b"" for t in batch.column(source_col).to_pylist()]
                at = np.zeros(len(each) + 1, dtype=np.int32)
                np.cumsum([len(x) // 4 for x in each], out=at[1:])
                ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(each), dtype="<i4")))
            else:
                ids = batch.column(source_col)
            made = {"ids": ids}
            if "decoded" in outputs.values():
                if ids.values.null_count:
                    raise ValueError("a null among the ids")
                flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_pylist()
                made["decoded"] = pa.array([codec.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)], type=pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(made[k] for k in outputs.values())], names=[*kept, *outputs])

    return spread(df).mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with ids_col: array<int>, the ids of text_col under the vocabulary file at path."""
    return coded(df, path, text_col, {ids_col: "ids"})


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with text_col: string, the text of ids_col; special tokens are written out."""
    return coded(df, path, ids_col, {text_col: "decoded"})


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: encoded, then decoded from its ids."""
    both = coded(docs.select("doc_id", "text"), path, "text", {"ids": "ids", "decoded": "decoded"})
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every document, after its ids have been decoded and held against its text (a difference is an error)."""
    rows = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    both = coded(rows, path, "text", {"ids": "ids", "decoded": "decoded"})
    checked = F.when(F.col("decoded") == F.col("text"), F.col("ids")).otherwise(F.raise_error(F.lit("a text differs from its decoded ids")))
    return both.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), checked.alias("ids"))
