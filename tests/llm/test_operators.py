import collections
import hashlib
import json
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from markgrove.llm import bpe, chat, classifier, common, embedding_dedup, lm_scoring, minhash, mixing, pii, quality_rules, warc
from markgrove.llm.queries import QUERIES, SQL, tokenizer_path

BPE = tokenizer_path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = [f"w{i}" for i in range(400)]


def text(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(t, seed, n=1):
    r, w = random.Random(seed), t.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"x{r.random()}"
    return " ".join(w)


#: Columns with the names of results and of internals.
CLASHES = [f"{k} AS {n}" for k, n in enumerate("kept copy_no shuffle_key row id key size part block rows of cdf blocks u spans n_words place grade ids decoded class_id content digest".split())]


def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows."""
    a = text(1)
    rows = [
        (1, a, "en", "s", 1), (1, a, "en", "s", 1), (2, a, "en", "s", 1), (3, edited(a, 5), None, None, None), (4, None, "en", "s", 0), (5, "", "en", "s", 0),
        (None, a, "en", "s", 1), (None, None, None, None, None), (6, "one two", "en", "t", 7), (7, "one two", "en", "t", 7), (8, text(2, 20_000), "en", "t", None),
        (9, " \n\t ", "en", "u", 3), (10, "word " * 300, "en", "u", 1500), (11, "a" * 50_000, "en", "u", 50_000),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, duck, name):
    same_rows(QUERIES[name](spark, sf), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op2_hnsw_dedup", "op6_warc_segments", "op10_tool_calls"}))
def test_odd_and_empty_documents(spark, tmp_path, sf, name):
    d = str(tmp_path)
    odd_docs(spark).selectExpr("*", *CLASHES).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rows = QUERIES[name](spark, d).collect()
    if name != "op1_poisson_mix":
        assert len(rows) == 14
    else:
        assert {"copy_no", "copy_no_", "shuffle_key", "shuffle_key_"} <= set(rows[0].asDict())
    empty = f"{d}/none"
    spark.createDataFrame([], DOCS).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert QUERIES[name](spark, empty).collect() == []


# ---- 1


def test_poisson_counts_follow_rates(spark, sf):
    docs = common.read(spark, sf, "documents")
    chars = {r[0]: r[1] for r in docs.selectExpr("source", "length(text) n").groupBy("source").sum("n").collect()}
    mixed = mixing.mix(docs, {"src0": 3.0}, epochs=4.0)
    out = collections.Counter()
    for r in mixed.selectExpr("source", "length(text) n").collect():
        out[r[0]] += r[1]
    total = sum(chars.values())
    assert abs(sum(out.values()) / (4 * total) - 1) < 0.25
    weights = {s: 3.0 if s == "src0" else 1.0 for s in chars}
    for s in ("src0", "src1"):
        assert abs(out[s] / (4 * total * weights[s] / sum(weights.values())) - 1) < 0.6
    again = sorted((r["doc_id"], r["copy_no"]) for r in mixing.mix(docs, {"src0": 3.0}, epochs=4.0).collect())
    assert again == sorted((r["doc_id"], r["copy_no"]) for r in mixed.collect())


def test_poisson_cdf(spark):
    from math import exp, factorial

    from pyspark.sql import functions as F

    for rate in (0.3, 2.5, 800.0):
        cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(rate))).first()[0]
        if rate < 10:
            p = [exp(-rate) * rate**k / factorial(k) for k in range(20)]
            assert np.allclose(cdf[:20], np.cumsum(p))
        assert abs(cdf[-1] - 1) < 1e-9
    assert spark.range(1).select(mixing.poisson_cdf(F.lit(0.0))).first()[0] == [1.0]


def test_large_rates_are_dealt_in_blocks(spark):
    # one small source beside a large one: its document is copied about a million times, in blocks of a bounded rate
    docs = spark.createDataFrame([(1, "a", "s"), (2, "b" * 2_000_000, "t"), (3, None, "u")], "doc_id long, text string, source string")
    mixed = mixing.mix(docs)
    n = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert abs(n[1] / 1_000_000 - 1) < 0.01 and mixed.where("doc_id = 1").select("copy_no").distinct().count() == n[1]
    sizes = [r[0] for r in mixed.selectExpr("spark_partition_id() AS p").groupBy("p").count().select("count").collect()]
    assert max(sizes) < 1.2 * sum(sizes) / len(sizes)


def test_equal_rows_are_dealt_evenly(spark):
    docs = spark.createDataFrame([(None, None, "s")] * 900 + [(7, "x", "s")] * 900, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, epochs=20.0)
    sizes = [r[0] for r in mixed.selectExpr("spark_partition_id() AS p").groupBy("p").count().select("count").collect()]
    assert len(sizes) == 2 and max(sizes) < 1.1 * sum(sizes) / 2
    assert len({r["count"] for r in mixed.groupBy("doc_id").count().collect()}) <= 2


# ---- 2


def brute_links(rows):
    """(vec_id, links, least vec_id reachable) of every row that has an id, each row a vector of its own."""
    ids = [r[0] for r in rows]
    n, comp = [0] * len(rows), list(range(len(rows)))

    def ok(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i], rows[j]
            if ok(a) and ok(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], dtype=np.float64), np.array(b[1], dtype=np.float64)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    n[i] += 1
                    n[j] += 1
                    comp[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i in range(len(rows)):
        least[top(i)] = min(least.get(top(i), ids[i]), ids[i]) if ids[i] is not None else ids[i]
    return sorted((ids[i], n[i], least[top(i)]) for i in range(len(rows)) if ids[i] is not None)


def some_vectors():
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for label in range(3):
        for _ in range(60):
            center = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 5))):
                v = center + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.25])
                rows.append((k, [float(np.float32(x)) for x in v], label))
                k += 1
    return rows, k


def test_hnsw_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 100)
    monkeypatch.setattr(embedding_dedup, "SHARD_BYTES", 1)
    rows, k = some_vectors()
    rows += [(k + i, rows[0][1], 0) for i in range(3)] + [(k + 3, [0.0] * 16, 0), (k + 4, None, 0), (k + 5, [None] + [1.0] * 15, 0), (k + 6, [float("nan")] * 16, 1), (k + 7, rows[0][1], None), (k + 8, [], 2), (None, rows[0][1], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS rep", "2 AS node", "3 AS same", "4 AS n_links", "5 AS times", "6 AS dim", "7 AS kept")
    out = embedding_dedup.classes(frame).collect()
    assert len(out) == len(rows)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out if r["vec_id"] is not None) == brute_links(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    assert embedding_dedup.classes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


@pytest.mark.parametrize("shard", [40, 8192])
def test_hnsw_with_repeated_ids(spark, monkeypatch, shard):
    # ids repeat with different and equal vectors, within and across labels
    monkeypatch.setattr(embedding_dedup, "SHARD", shard)
    monkeypatch.setattr(embedding_dedup, "SHARD_BYTES", 1)
    rows, k = some_vectors()
    rows = [(i % 97, v, label) for i, v, label in rows] + [(i % 31, v, label) for i, v, label in rows[:50]] + [rows[5]] * 3 + [(5, rows[0][1], 1), (5, rows[0][1], 2), (6, rows[0][1], 1), (7, rows[0][1], 2)]
    out = embedding_dedup.classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == brute_links(rows)


def test_hnsw_recall_of_each_unit():
    rng = np.random.default_rng(11)
    for n, groups in ((300, 0), (1500, 40), (2500, 3)):
        v = rng.normal(size=(n, 24))
        for g in range(groups):
            at = rng.choice(n, size=int(rng.integers(2, 60)), replace=False)
            v[at] = v[at[0]] + 0.03 * rng.normal(size=(len(at), 24))
        v, ids = embedding_dedup.unit(v), np.arange(n) * 3
        graph = embedding_dedup.Graph(v.astype(np.float32), embedding_dedup._levels(ids)).build()
        counts, _, _ = embedding_dedup.search_unit(graph, ids, np.ones(n, dtype=np.int64), v, v, ids, 0.98)
        truth = ((v @ v.T) >= 0.98).sum(axis=1) - 1
        assert (counts <= truth).all() and counts.sum() >= 0.99 * truth.sum() and np.mean(counts[truth > 0] / truth[truth > 0]) > 0.99 if groups else not truth.any()


def test_hnsw_recall_of_a_large_group():
    # 600 vectors around one center, 900 others
    rng = np.random.default_rng(5)
    v = embedding_dedup.unit(np.concatenate([rng.normal(size=(1, 32)) + 0.02 * rng.normal(size=(600, 32)), rng.normal(size=(900, 32))]))
    ids = np.arange(1500)
    g = embedding_dedup.Graph(v.astype(np.float32), embedding_dedup._levels(ids)).build()
    counts, forest, beam = embedding_dedup.search_unit(g, ids, np.ones(1500, dtype=np.int64), v, v, ids, 0.98)
    truth = ((v @ v.T) >= 0.98).sum(axis=1) - 1
    assert (counts <= truth).all() and counts.sum() >= 0.99 * truth.sum() and beam < 1500
    assert len({forest.top(i) for i in range(600)}) == 1


class PoorGraph(embedding_dedup.Graph):
    """Finds large groups with any beam, pairs only with a beam of 64."""

    def near(self, q, beam, floor):
        found = np.flatnonzero(self.v @ q >= floor).tolist()
        return found if beam >= 64 or len(found) > 9 else []


@pytest.mark.parametrize("hot", [0, 700])
def test_hnsw_audit_sees_pairs(hot):
    # pairs beside a hot group; and pairs of which no audited query is one
    rng = np.random.default_rng(9)
    ids = np.arange(2000)
    audited = np.argsort(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")[: embedding_dedup.AUDIT]
    v = rng.normal(size=(2000, 32))
    v[:hot] = v[0] + 0.02 * rng.normal(size=(hot, 32))
    free = np.setdiff1d(ids[hot:], audited)[:200] if not hot else ids[hot : hot + 200]
    v[free[1::2]] = v[free[::2]] + 0.02 * rng.normal(size=(100, 32))
    v = embedding_dedup.unit(v)
    g = PoorGraph(v.astype(np.float32), embedding_dedup._levels(ids))
    counts, _, beam = embedding_dedup.search_unit(g, ids, np.ones(2000, dtype=np.int64), v, v, ids, 0.98)
    assert (counts == ((v @ v.T) >= 0.98).sum(axis=1) - 1).all() and 64 <= beam < 2000


# ---- 3


def brute_repeats(words):
    n = len(words)
    return [max((next((k for k in range(n + 1) if i + k >= n or j + k >= n or words[i + k] != words[j + k])) for j in range(n) if j != i), default=0) for i in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), min_size=1, max_size=5))
def test_longest_repeats(docs):
    sizes = np.array([len(d) for d in docs])
    words = np.array([ord(c) for d in docs for c in d], dtype=np.int64)
    found = quality_rules.longest_repeats(words, np.repeat(np.cumsum(sizes), sizes))
    assert found.tolist() == [x for d in docs for x in brute_repeats(d)]


def test_repetitive_text_goes_and_clean_text_stays(spark):
    rows = [(1, text(1), "en", "s", 0), (2, (text(2, 60) + "\n") * 3, "en", "s", 0), (3, text(3, 300) + " " + text(4, 130) + " q " + text(4, 130), "en", "s", 0), (4, "short", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect()} == {1: True, 2: False, 3: False, 4: False}
    clash = docs.withColumnRenamed("lang", "n_words").withColumnRenamed("source", "row")
    assert [r["doc_id"] for r in quality_rules.kept(clash).collect()] == [1] and quality_rules.kept(clash).columns == clash.columns


# ---- 4

ALPHABET = st.text(alphabet="a1 2.@+-(é😀0939,\n", max_size=40)
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            good = True
            if kind == "ip":
                good = all(int(x) <= 255 for x in m[0].split("."))
            elif kind == "phone":
                good = 8 <= len(digits) <= 15
            elif kind == "card":
                s = sum(d if k % 2 == 0 else (2 * d - 9 if 2 * d > 9 else 2 * d) for k, d in enumerate(reversed(digits)))
                good = 16 <= len(digits) <= 19 and s % 10 == 0
            if good:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.one_of(ALPHABET, st.lists(st.sampled_from(["a@b.c", "@", "1.2.3.4", "255.", "4111 1111 1111 1111", "4111111111111111", "+1 (212) 555-0123", "x", " ", ".", "9", "-"]), max_size=8).map("".join)))
def test_base_spans(t):
    assert [s for s in pii.spans_of(t) if s[0] in BASE] == brute_spans(t)


def test_added_spans_and_masking(spark):
    t = 'pay IBAN: DE89 3704 0044 0532 0130 00 now, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962", SSN 078-05-1120, https://me:pw@host/x'
    kinds = [k for k, _, _ in pii.spans_of(t)]
    assert kinds == ["iban", "ssn", "secret", "url_login"]
    docs = spark.createDataFrame([(1, t, "en", "s", len(t)), (2, None, None, None, None), (3, "clean text", "en", "s", 10)], DOCS)
    out = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert "[IBAN]" in out[1]["text"] and "078-05" not in out[1]["text"] and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] is None and out[3]["text"] == "clean text"
    found = {r["doc_id"]: r for r in pii.digest(docs).collect()}
    assert found[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and found[3]["spans"] == ""


CUES = {"iban": "iban", "ssn": "ssn|social security", "account": "account|acct", "secret": "token|secret|password|passwd|api_key|apikey|api-key"}


def brute_added(t):
    """The added kinds by plain search: every cue in turn, every end of an account tried."""
    out = []
    for kind, cues in CUES.items():
        until = 0
        for m in re.finditer(f"(?=({cues}))", t, re.I | re.A):
            a = m.start()
            if a and t[a - 1].isalnum():
                continue
            # cues that begin at one place end one after another
            for cue in sorted((c for c in cues.split("|") if t[a : a + len(c)].lower() == c), key=len):
                rest, at = t[a + len(cue) :], a + len(cue)
                if kind == "secret":
                    if (x := re.match(r"(?: is)?\s{0,2}[:=]\s{0,2}[\"']?([A-Za-z0-9_+/=.~-]+)", rest)) and at + x.start(1) >= until:
                        until = at + x.end(1)
                        if len(x[1]) >= 16 and any(c in "0123456789" for c in x[1]):
                            out.append((kind, at + x.start(1), until))
                    continue
                span = None
                if kind == "ssn":
                    x = re.match(r"(?: (?:number|no\.?))?[ :#=]{0,3}(\d{3}[- ]\d{2}[- ]\d{4})(?!\d)", rest, re.A)
                    span = x and (at + x.start(1), at + x.end(1))
                elif kind == "account":
                    x = re.match(r"(?: (?:number|no\.?))?[ :#=]{1,3}(\d{6,17})(?![0-9A-Za-z])", rest, re.A)
                    span = x and (at + x.start(1), at + x.end(1))
                elif x := re.match(r"[ :#.-]{0,3}([A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30})", rest, re.A):
                    b = at + x.start(1)
                    ends = [e for e in range(b + 15, at + x.end(1) + 1) if t[e - 1] != " " and not (e < len(t) and t[e].isascii() and t[e].isalnum())]
                    good = [e for e in ends if 15 <= len(c := t[b:e].replace(" ", "")) <= 34 and int("".join(str("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(y)) for y in c[4:] + c[:4])) % 97 == 1]
                    own = [e for e in good if len(t[b:e].replace(" ", "")) == pii.IBAN_SIZES.get(t[b : b + 2])]
                    span = (b, (own or good)[-1]) if good else None
                if span and span[0] >= until:
                    until = span[1]
                    out.append((kind, *span))
    for m in re.finditer("://", t):
        if m.start() and t[m.start() - 1].isalpha() and (x := re.match(r"[^\s:/@?#]+:[^\s/@?#]+@", t[m.end() :])):
            out.append(("url_login", m.end(), m.end() + x.end()))
    return out


PARTS = ["IBAN ", "iban:", "Iban", "SSN ", "social security no. ", "Account number: ", "acct#", "token=", "ApiKey: ", "PASSWORD is ", "api_key='", "https://", "a", " ", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "BIC", "078-05-1120", "078 05 11201", "123456", "12345678901234567890", "abcdef0123456789XY", "user:pw@host", "x:y", "@", "é", ".", "\n"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=7).map("".join))
def test_added_spans_against_brute_force(t):
    assert [s for s in pii.spans_of(t) if s[0] not in BASE] == brute_added(t)


def test_cues_in_any_case_and_length_changing_letters():
    for cue in ("ApiKey", "apiKEY", "API_key", "PassWord"):
        assert [s[0] for s in pii.spans_of(f"İİ {cue}=abcdef0123456789abcdef")] == ["secret"]
    t = "İ token=abcdef0123456789abcdef"
    assert pii.masked(t, pii.spans_of(t)) == "İ token=[SECRET]"


def test_long_secrets_and_logins_whole():
    for n in (16, 512, 513, 5000):
        t = "token: " + "a1" * (n // 2) + "b" * (n % 2) + " end"
        assert pii.spans_of(t) == [("secret", 7, 7 + n)] and pii.masked(t, pii.spans_of(t)) == "token: [SECRET] end"
        u = "https://" + "u" * n + ":" + "p" * n + "@host/x"
        assert pii.spans_of(u) == [("url_login", 8, 10 + 2 * n)]
    t = "token=" + "x" * 20 + ".password: " + "c3" * 9
    assert pii.spans_of(t) == [("secret", len(t) - 18, len(t))]
    for t in ("token=" * 100_000, "a://" * 100_000, "a://" + "b:" * 200_000, "password:token=x1" * 50_000):
        pii.spans_of(t)


def test_iban_before_other_words():
    for code in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "MT84MALT011000012345MTLCAST001S"):
        for rest in ("", " BIC: COBADEFFXXX", " BIC COBADEFFXXX", " 24 hours", " now", ", 12", " A B C D E F G H 1 2 3 4 5 6 7 8"):
            assert [s for s in pii.spans_of("IBAN " + code + rest) if s[0] == "iban"] == [("iban", 5, 5 + len(code))], code + rest
    assert not [s for s in pii.spans_of("IBAN DE89370400440532013001 BIC") if s[0] == "iban"]
    assert not [s for s in pii.spans_of("IBAN DE89370400440532013000x") if s[0] == "iban"]


def test_long_runs_are_linear():
    for t in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" * 100_000, "a@" * 100_000, "1 " * 200_000):
        pii.spans_of(t)


# ---- 5


def brute_scores(texts, order, alpha=0.4):
    docs = [(t or "").split() for t in texts]

    def count(ws):
        return collections.Counter(tuple(ws[i : i + n]) for n in range(1, order + 1) for i in range(len(ws) - n + 1))

    all_of, total = sum((count(w) for w in docs), collections.Counter()), sum(map(len, docs)) or 1
    out = []
    for ws in docs:
        own, score, off = count(ws), 0, 0
        for i in range(len(ws)):
            k = 0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(ws[i - n + 1 : i + 1])
                c = all_of[g] - own[g]
                if n == 1:
                    score += round(1e6 * (np.log(alpha) * k + np.log(max(c, 1)))) - round(1e6 * np.log(total))
                elif c > 0:
                    score += round(1e6 * (np.log(alpha) * k + np.log(c / (all_of[g[:-1]] - own[g[:-1]]))))
                    break
                else:
                    k += 1
            off += k > 0
        out.append((len(ws), off, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_against_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 600)
    texts = [text(i, 40) if i % 3 else "a b a c a b " * (i + 1) for i in range(12)] + ["", None, "solo", text(1, 40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r["doc_id"]: (r["n_words"], r["n_backed_off"], r["score_micronats"]) for r in lm_scoring.score(docs, order).collect()}
    for i, (n, off, s) in enumerate(brute_scores(texts, order)):
        assert out[i][:2] == (n, off) and abs(out[i][2] - s) <= n


def test_registered_trigrams(spark, tmp_path):
    import __spark_entry__

    texts = ["a b c d", "x a b c", "b c d a b c", None]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: (r["n_words"], r["n_backed_off"], r["score_micronats"]) for r in __spark_entry__.queries()["op5_stupid_backoff"](spark, str(tmp_path)).collect()}
    for i, (n, off, s) in enumerate(brute_scores(texts, 3)):
        assert out[i][:2] == (n, off) and abs(out[i][2] - s) <= n


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2))
    assert (lm_scoring.unpack_sorted(lm_scoring.pack_sorted(keys)) == keys).all()
    assert lm_scoring.unpack_sorted(lm_scoring.pack_sorted(keys[:1])).tolist() == keys[:1].tolist()
    counts = np.array([1, 254, 255, 256, 10**9, 0])
    assert (lm_scoring.unpack_counts(lm_scoring.pack_counts(counts)) == counts).all()
    for width in (1, 7, 9, 20, 40, 63):
        keys = np.unique(rng.integers(0, 1 << width, 300, dtype=np.uint64))
        assert (lm_scoring.unpack_sorted(lm_scoring.pack_sorted(keys)) == keys).all()


def test_blocks_are_bounded_whatever_documents_hold(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 1000)
    docs = spark.createDataFrame([(None, "same head " * 9)] * 200 + [(1, "y " * 4000), (2, None), (3, "")], "doc_id long, text string")
    rows = [lm_scoring._unpacked(pa.table({"rows": [r["rows"]]})).column("text").to_pylist() for r in lm_scoring._blocks(docs).collect()]
    assert sum(map(len, rows)) == 203 and all(len(b) == 1 or sum(len(t or "") for t in b) <= 1000 + 90 for b in rows) and len(rows) >= 19
    texts = [t for b in rows for t in b]
    out = lm_scoring.score(docs).collect()
    assert sorted((r["n_words"], r["n_backed_off"]) for r in out) == sorted((n, off) for n, off, _ in brute_scores(texts, 3))


# ---- 6


def test_warc_round_trip(spark):
    long_ = "\r\n0\r\n\r\nWARC/1.1\r\n" + "x€" * 40_000
    rows = [(1, "http://a/1", "short"), (2, "http://a/2", "short"), (3, "u", long_), (4, "u\r\nX: y", long_), (5, None, None), (6, "", ""), (None, "n", long_), (3, "u", long_), (7, "b", "y" * 100), (8, "b", "y" * 100), (9, "c", "é" * 20_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS digest", "3 AS record_type", "4 AS refers_to", "5 AS record_id", "6 AS kind")
    out = warc.round_trip(frame).collect()
    assert len(out) == len(rows) and all(r["problem"] is None for r in out)
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out)
    want = collections.Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        first = min(j for j, _, x in rows if (x or "") == (h or "") and j is not None)
        again = len(p) >= 100 and i is not None and i > first
        want[i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert got == want
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 50), st.integers(40, 200))
def test_warc_bytes(body, chunk, segment):
    assert warc.unchunked(warc.chunked(body, chunk)) == body
    parts = warc.records_of(5, "u", body, hashlib.sha256(body).hexdigest(), None, segment)
    records = list(warc.parse(b"".join(p + b"\r\n" for p in parts)))
    whole = b"".join(b for _, b in records)
    assert warc.payload_of(whole) == body
    if len(records) > 1:
        assert int(records[-1][0]["warc-segment-total-length"]) == len(whole) and [int(f["warc-segment-number"]) for f, _ in records] == list(range(1, len(records) + 1))


def test_warc_reports_broken_segments(spark, tmp_path):
    body = b"z" * 5000
    parts = warc.records_of(5, "u", body, hashlib.sha256(body).hexdigest(), None, 1000)
    (tmp_path / "a.warc").write_bytes(b"".join(p + b"\r\n" for k, p in enumerate(parts) if k != 1))
    assert warc.read(spark, str(tmp_path)).first()["problem"] == "segments missing"


# ---- 7


def test_classifier_on_held_out_rows(spark):
    docs = common.read(spark, "/root/testdata/sf0.1", "documents")
    labels = common.read(spark, "/root/testdata/sf0.1", "labels")
    out = classifier.select(docs, labels.where("pmod(xxhash64(doc_id), 4) != 0"))
    held = out.join(labels.where("pmod(xxhash64(doc_id), 4) = 0"), "doc_id").collect()
    good = [r["kept"] for r in held if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["kept"] for r in held if r["quality"] == 0 or r["toxic"] == 1]
    assert len(held) > 500 and np.mean(good) > 0.97 and np.mean(bad) < 0.12
    assert all(abs(r["expected_grade"] - 1) <= 1 and 0 <= r["tail_probability"] <= 1 for r in held)


def brute_loss(rows, grades, weights, thresholds):
    """The penalised negative log-likelihood of the cumulative-link model, one row at a time."""
    total = 0.0
    for r, g in zip(rows, grades, strict=True):
        s = sum(weights[i] for i in r)
        below = [0.0, *(1 / (1 + math.exp(s - t)) for t in thresholds), 1.0]
        total -= math.log(max(below[g + 1] - below[g], 1e-9))
    return total / len(rows) + classifier.LASSO * sum(abs(w) for w in weights)


def test_fit_against_the_likelihood(monkeypatch):
    # no small step in any weight or threshold lowers the penalised loss: the optimum, as the loss is convex
    monkeypatch.setattr(classifier, "FEATURES", 12)
    monkeypatch.setattr(classifier, "ROUNDS", 20_000)
    monkeypatch.setattr(classifier, "SETTLED", 1e-12)
    rng = np.random.default_rng(5)
    rows = [np.flatnonzero(rng.random(12) < 0.4).astype(np.int32) for _ in range(150)]
    true = rng.normal(size=12)
    grades = np.array([int(np.digitize(true[r].sum() + rng.logistic(), [-0.5, 1.0])) for r in rows])
    weights, thresholds = classifier.fit(rows, grades)
    least = brute_loss(rows, grades, weights, thresholds)
    for k in range(12):
        for step in (-0.02, 0.02):
            moved = weights.copy()
            moved[k] += step
            assert brute_loss(rows, grades, moved, thresholds) > least - 1e-6
    for k in range(2):
        for step in (-0.02, 0.02):
            moved = thresholds.copy()
            moved[k] += step
            assert brute_loss(rows, grades, weights, moved) > least - 1e-6
    assert thresholds[0] < thresholds[1]


def test_scores_against_brute_force(spark, sf):
    docs, labels = common.read(spark, sf, "documents"), common.read(spark, sf, "labels")
    rated = labels.select("doc_id", classifier.grade(labels["quality"], labels["toxic"]).alias("grade"))
    weights, thresholds = classifier.train(docs, rated)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in QUERIES["op7_ordinal_quality"](spark, sf).collect():
        s = sum(float(np.float32(weights[i])) for i in classifier.features(texts[r["doc_id"]]))
        above = [1 / (1 + math.exp(t - s)) for t in thresholds]
        assert abs(r["score"] - s) < 1e-6 and abs(r["expected_grade"] - sum(above)) < 1e-6 and abs(r["tail_probability"] - above[1]) < 1e-6
        assert r["kept"] == (r["tail_probability"] >= classifier.SELECT)


def test_whole_words_make_shapes():
    assert classifier.shape(b"a1" * 20 + b"X") == "a0" * 20 + "A" and classifier.shape(b"a1" * 20) != classifier.shape(b"a1" * 21)


def test_labels_of_other_documents_and_string_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", text(i) if i % 2 else "bad " * 30) for i in range(40)] + [("d1", text(1))] * 50 + [("d1", text(99))], "doc_id string, text string")
    labels = [(f"d{i}", i % 2, 0) for i in range(40)]
    absent = [(f"gone{i}", 1, 1) for i in range(500)]
    some = spark.createDataFrame(labels + labels + [(None, 1, 1), ("d3", None, 0)], "doc_id string, quality int, toxic int")
    more = some.union(spark.createDataFrame(absent, some.schema))
    a, b = (classifier.select(docs, x).orderBy("doc_id", "score").collect() for x in (some, more))
    assert a == b and {r["kept"] for r in a if r["doc_id"] == "d2"} == {False} and {r["kept"] for r in a if r["doc_id"] == "d3"} == {True}
    rated = more.select("doc_id", classifier.grade(more["quality"], more["toxic"]).alias("grade"))
    few = classifier.train(docs, rated, max_labelled=10)
    assert np.abs(few[0]).sum() > 0  # absent documents take no part of a small sample


# ---- 8


def brute_classes(rows):
    def shingles(t):
        w = (t or "").split()
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None

    sets, of = [(i, shingles(t)) for i, t in rows if i is not None], {}

    def top(i):
        while of.setdefault(i, i) != i:
            i = of[i]
        return i

    for k, (i, a) in enumerate(sets):
        top(i)
        for j, b in sets[:k]:
            if a and b and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                of[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i, _ in sets}


@pytest.mark.parametrize("rounds", [3, 0])
def test_minhash_against_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(minhash, "HUB_ROUNDS", rounds)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 12_000)
    monkeypatch.setattr(minhash, "HUB_PART", 4)
    rows = [(i, text(i // 6, 150)) for i in range(60)]
    rows = [(i, edited(t, i, i % 6)) if i % 6 else (i, t) for i, t in rows]
    base = text(77, 160)
    rows += [(100 + i, edited(base, 500 + i, 1)) for i in range(40)]  # a large group of near copies
    shared = text(99, 60)
    rows += [(200 + i, shared + " " + text(300 + i, 40)) for i in range(30)]  # a passage that many share, under the threshold
    rows += [(300, "a b"), (301, "a b"), (302, ""), (303, None), (304, ""), (None, base), (305, "w " * 200), (306, "w " * 230), (307, "w " * 300), (100, edited(base, 500, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.classes(docs).collect()
    assert len(out) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in out if r["doc_id"] is not None} == brute_classes(rows)
    kept = minhash.keep_one(docs.selectExpr("*", "1 as class_id", "2 as id"))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == ["doc_id", "text", "class_id", "id"] and sorted(i for i in ids if i is not None) == sorted({*brute_classes(rows).values()}) and ids.count(None) == 1


def test_near_copies_move_in_proportion(spark, monkeypatch):
    # all copies are of one class: the pairs that are verified, and the rows of blocks, grow with the copies, not with their square
    moved = []
    table = common.Scratch.table

    def counting(self, df, name):
        out = table(self, df, name)
        if name in ("pairs", "rest"):
            moved.append(out.count())
        return out

    monkeypatch.setattr(common.Scratch, "table", counting)
    base, n = text(77, 300), {}
    for copies in (300, 1200):
        moved.clear()
        docs = spark.createDataFrame([(i, edited(base, i, 1)) for i in range(copies)], "doc_id long, text string")
        out = minhash.classes(docs).collect()
        assert {r["class_id"] for r in out} == {0}
        n[copies] = sum(moved)
    assert n[1200] < 6 * n[300]


def test_repeated_ids_keep_their_different_texts(spark):
    a, b = text(1, 150), text(2, 150)
    rows = [(7, a, "x"), (7, b, "y"), (7, a, "w"), (3, edited(a, 9, 1), "v"), (8, b, "u"), (None, a, "n"), (None, a, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS id", "2 AS key", "map('a', 1) AS row", "3 AS digest")
    kept = sorted((r["doc_id"] or -1, r["lang"]) for r in minhash.keep_one(docs).collect())
    assert kept == [(-1, "n"), (-1, "n"), (3, "v"), (7, "y")] and minhash.keep_one(docs).columns == docs.columns


def test_signatures_of_heavy_weights_are_unbiased():
    f = minhash.mix64(np.arange(3, dtype=np.uint64) + np.uint64(7)) & minhash.MASK40
    x, y = np.array([9000, 20_000, 5]), np.array([8999 // 2, 30_000, 5])
    a, b = (minhash.signatures(np.zeros(3, dtype=np.int64), f, w, 1, 8192)[0] for w in (x, y))
    true = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((a == b).mean() - true) < 4 * np.sqrt(true * (1 - true) / 8192)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 9, 80), rng.integers(0, 9, 80)
    f = minhash.mix64(np.arange(80, dtype=np.uint64) + np.uint64(7)) & minhash.MASK40
    a, b = (minhash.signatures(np.zeros((w > 0).sum(), dtype=np.int64), f[w > 0], w[w > 0], 1, 8192)[0] for w in (x, y))
    true = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((a == b).mean() - true) < 4 * np.sqrt(true * (1 - true) / 8192)


# ---- 9


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "don't", "I'LL", "héllo", "😀", "  ", "12", "\x1c", "　"]), max_size=9).map("".join)))
def test_bpe_as_the_library(t):
    lib = library()
    ids = lib.encode(t, add_special_tokens=False).ids
    codec = CODEC
    assert codec.encode(t) == ids and codec.decode(ids) == lib.decode(ids, skip_special_tokens=False)


CODEC = bpe.Codec(open(BPE, encoding="utf-8").read())
_LIB = []


def library():
    from tokenizers import Tokenizer

    if not _LIB:
        _LIB.append(Tokenizer.from_file(BPE))
    return _LIB[0]


def test_bpe_decodes_any_ids():
    r = random.Random(4)
    for _ in range(200):
        ids = [r.randrange(50257) for _ in range(12)]
        assert CODEC.decode(ids) == library().decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("ids", [[-1], [0, 10**6], [5, None]])
def test_bpe_refuses_other_ids(spark, ids):
    if None not in ids:
        with pytest.raises(ValueError):
            CODEC.decode(ids)
    with pytest.raises(Exception, match="ids|null"):
        bpe.decode(spark.createDataFrame([(ids,)], "ids array<int>"), BPE).collect()


def test_bpe_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in common.read(spark, sf, "documents").collect()}
    for r in QUERIES["op9_bpe"](spark, sf).collect():
        ids = library().encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library().decode(ids, skip_special_tokens=False).encode()).hexdigest()


# ---- 10


def test_tool_calls(spark):
    calls = [("a", None, 1, 0, "f", '{"x":1}'), ("b", "a", 1, 2, "f", '{"x":"no"}'), ("c", "b", 1, 4, "f", "{}"), ("d", "zz", 2, 0, "g", "{}"), ("x", "y", 3, 0, "f", None), ("y", "x", 3, 1, "f", '{"x":2,"q":0}'), (None, None, 4, 0, "f", "{}"), ("c", "b", 1, 5, "f", "{}")]
    results = [("a", 1, 1, 'say "hi"\n\x01'), ("a", 1, 3, "z"), ("q", 9, 9, "lone"), (None, 5, 5, "loose")]
    c = spark.createDataFrame(calls, "call_id string, parent_id string, conv_id long, turn long, name string, arguments string")
    r = spark.createDataFrame(results, "call_id string, conv_id long, turn long, text string")
    out = {x["call_id"] or x["status"] + str(x["conv_id"]): x for x in chat.link(c, r, {"f": {"properties": {"x": {"type": "integer", "minimum": 0}}, "required": ["x"], "additionalProperties": False}}).collect()}
    assert [out[k]["topo_order"] for k in "abcd"] == [0, 1, 2, 0] and out["x"]["topo_order"] is None and out["y"]["topo_order"] is None
    assert out["a"]["valid"] and out["a"]["n_results"] == 2 and out["a"]["json"] == '{"arguments":{"x":1},"id":"a","name":"f","result":"say \\"hi\\"\\n\\u0001"}'
    assert (out["b"]["violations"], out["c"]["violations"], out["d"]["violations"], out["x"]["violations"], out["y"]["violations"]) == ("x: not integer", "x: missing", "no schema", "no JSON object", "q: unknown")
    assert out["c"]["n_calls"] == 2 and out["q"]["status"] == "orphan" and out["unlinked4"]["name"] == "f" and out["unlinked5"]["valid"] is None


def test_canonical_arguments(spark):
    texts = ['{ "b": 1,  "a":{"z":[1, {"y":2,"x":null}],"c":"q\\u0001\\u000b \\\\u000B é😀"} }', "not json", None, '"s"', "[3, 2]", '{"a":1,"a":2}', "", '{"n":123456789012345678901234567890}']
    out = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(chat.canonical(F.col("t"))).collect()]
    assert out == ['{"a":{"c":"q\\u0001\\u000b \\\\u000B é😀","z":[1,{"x":null,"y":2}]},"b":1}', '"not json"', "null", '"s"', "[3,2]", '"{\\"a\\":1,\\"a\\":2}"', '""', '{"n":123456789012345678901234567890}']
    assert all(json.loads(x) is not ... for x in out)


def test_nested_schemas(spark):
    inner = {"type": "object", "properties": {"k": {"type": "integer", "maximum": 5}}, "required": ["k"], "additionalProperties": False}
    schema = {"type": "object", "properties": {"o": inner, "l": {"type": "array", "items": {"properties": {"z": {"enum": [1, "a", None]}}, "required": ["z"]}}, "n": {"type": "integer"}, "x'y": {"type": "boolean"}}}
    cases = {
        '{"o":{"k":7,"q":1}}': "o.k: too large;o: q: unknown",
        '{"o":{}}': "o.k: missing",
        '{"l":[{"z":1},{"z":2},{},{"z":null}]}': "l[].z: not allowed;l[].z: missing",
        '{"n":12345678901234567890123}': "",
        '{"n":1.0}': "",
        '{"n":1.5,"l":{}}': "l: not array;n: not integer",
        '{"x\'y":1}': "x'y: not boolean",
        "[1]": "arguments: not object",
        "nope": "no JSON object",
    }
    out = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", chat.violations(F.col("t"), schema)).collect()}
    assert out == cases


def test_odd_conversations_match_sql(spark, duck, tmp_path):
    rows = [(1, 0, "user", "p"), (1, 0, "user", "p"), (1, 1, "assistant", "r"), (1, 2, "user", "p1"), (1, 2, "user", "p2"), (1, 3, "assistant", "r1"), (1, 3, "assistant", "r2"), (1, 4, "user", "q\x1f\x0b\\u001F")]
    rows += [(2, 0, "user", "t1"), (2, 0, "system", "t2"), (2, 1, "assistant", "u"), (2, 2, "user", "z"), (None, 1, "user", "x"), (5, None, "user", None), (5, None, "assistant", "k"), (6, 3, None, "k"), (6, 4, "tool", "k" * 3000), (7, -1, "user", "y"), (8, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS call_id", "2 AS name", "3 AS arguments", "4 AS side", "5 AS conflict").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duck.cursor()
    con.execute(f"CREATE SCHEMA odd; SET schema = 'odd'; CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    same_rows(QUERIES["op10_tool_calls"](spark, str(tmp_path)), con, SQL["op10_tool_calls"])


def test_long_chains_and_odd_conversations(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(300)] + [(2, None, "user", None), (None, 0, None, ""), (3, 0, "system", None), (3, 1, "user", ""), (3, 1, "user", "b"), (3, 9, "assistant", None)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert max(r["topo_order"] for r in out if r["topo_order"] is not None) == 149 and len(out) == 150 + 5
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_repeated_turns_all_stay(spark, tmp_path):
    rows = [(1, 0, "user", "p"), (1, 0, "user", "p"), (1, 1, "assistant", "r"), (1, 2, "user", "p1"), (1, 2, "user", "p2"), (1, 3, "assistant", "r1"), (1, 3, "assistant", "r2"), (1, 3, "assistant", "r2")]
    rows += [(1, 4, "user", "q"), (1, 5, "assistant", "s1"), (1, 5, "assistant", "s2"), (2, 0, "user", "t1"), (2, 0, "system", "t2"), (2, 1, "assistant", "u"), (3, 1, "user", ""), (3, 1, "user", "b"), (4, 1, "assistant", "v"), (4, 1, "assistant", "w")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = QUERIES["op10_tool_calls"](spark, str(tmp_path)).collect()
    got = [(r["call_id"], *(json.loads(r["json"])[k] for k in ("arguments", "result")), r["status"], r["n_calls"], r["n_results"], r["topo_order"]) for r in out]
    got = sorted((i, (a or {}).get("prompt") or "", t or "", *more) for i, a, t, *more in got)
    c = "conflict"
    assert got == [
        ("1:0", "p", "r", "linked", 2, 1, 0), ("1:2", "", "r1", c, 0, 1, None), ("1:2", "", "r2", c, 0, 2, None), ("1:2", "p1", "", c, 1, 0, 1), ("1:2", "p2", "", c, 1, 0, 1),
        ("1:4", "q", "s1", c, 1, 1, 2), ("1:4", "q", "s2", c, 1, 1, 2), ("2:0", "t1", "u", c, 1, 1, 0), ("2:0", "t2", "u", c, 1, 1, 0),
        ("3:1", "", "", c, 1, 0, 0), ("3:1", "b", "", c, 1, 0, 0), ("4:0", "", "v", c, 0, 1, None), ("4:0", "", "w", c, 0, 1, None),
    ]


# ---- shared and pipeline


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, pairs):
    of = {}

    def top(i):
        while of.setdefault(i, i) != i:
            i = of[i]
        return i

    for a, b in pairs:
        if a != b:
            of[max(top(a), top(b))] = min(top(a), top(b))
    out = common.components(spark.createDataFrame(pairs, "a long, b long"), common.Scratch(spark, "test"))
    assert {r[0]: r[1] for r in out.collect()} == {i: top(i) for i in of}


def test_pipeline_against_brute_force(spark, sf):
    docs = {r["doc_id"]: r for r in common.read(spark, sf, "documents").collect()}

    def covered(w, n):
        """Places in windows of n words that the text holds twice or more."""
        seen = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return {p for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for p in range(i, i + n)}

    def passes(t):
        w = t.split()
        near, far, long_ = (covered(w, n) for n in (3, quality_rules.REPEAT_WORDS, quality_rules.MAX_LONGEST + 1))
        return len(w) >= 50 and 100 * len(near) <= 50 * len(w) and len(far) <= quality_rules.MAX_COVERED * len(w) and not long_

    def masked(t):
        out, at, until = [], 0, -1
        for a, b, kind in sorted((a, b, k) for k, a, b in brute_spans(t) + brute_added(t)):
            if a >= until:
                out += [t[at:a], f"[{kind.upper()}]"]
            until = at = max(b, until)
        return "".join([*out, t[at:]])

    good = [(i, r["text"]) for i, r in sorted(docs.items()) if passes(r["text"])]
    of = brute_classes(good)
    left = {i: t for i, t in good if of[i] == i}
    texts = {i: masked(t) for i, t in left.items()}
    chars = collections.Counter()
    for i, t in texts.items():
        chars[docs[i]["source"]] += len(t)
    copies = collections.Counter()
    for i in texts:
        s = docs[i]["source"]
        rate = sum(chars.values()) / len(chars) / chars[s]
        blocks = max(1, math.ceil(rate / mixing.BLOCK_RATE))
        for b in range(blocks):
            u, k = (int(hashlib.md5(f"{mixing.SEED}/{i}/b{b}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52, 0
            p = cdf = np.exp(-rate / blocks)
            while cdf < u:
                k += 1
                p *= rate / blocks / k
                cdf += p
            copies[i] += k
    out = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter(r["doc_id"] for r in out) == +copies
    for r in out:
        assert r["ids"] == library().encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_pipeline_takes_odd_input(spark, tmp_path):
    d = str(tmp_path)
    long_ = text(50, 30_000)
    rows = [(i, text(i, 80), "en", f"s{i % 3}", 1) for i in range(20)]
    rows += [(1, text(1, 80), "en", "s1", 1), (1, text(60, 80), "en", "s1", 1), (None, text(61, 80), None, None, None), (None, text(61, 80), None, None, None), (30, None, "en", "s", 0), (31, "", "en", "s", 0), (32, long_, "en", "s0", None), (33, edited(long_, 3), "en", "s0", None)]
    spark.createDataFrame(rows, DOCS).selectExpr("*", *CLASHES).write.parquet(f"{d}/documents.parquet")
    out = corpus_pipeline.run(spark, d).collect()
    ids = {r["doc_id"] for r in out}
    assert out and not ids & {30, 31, 33} and {r["source"] for r in out} <= {"s0", "s1", "s2", None}
    docs = common.read(spark, d, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, d)
        assert docs.columns == columns, name
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{d}/none").collect() == []


def test_pipeline_leaves_its_result_alone_in_scratch(spark, sf, monkeypatch):
    roots = []
    init = common.Scratch.__init__

    def noting(self, spark, name):
        init(self, spark, name)
        roots.append(self.root)

    monkeypatch.setattr(common.Scratch, "__init__", noting)
    assert corpus_pipeline.run(spark, sf).count() > 0
    left = [r for r in roots if os.path.isdir(r) and os.listdir(r)]
    assert len(roots) > 3 and [os.path.basename(r).split("-")[0] for r in left] == ["pipeline"] and len(os.listdir(left[0])) == 1


def test_stages_keep_the_columns_of_documents(spark, sf):
    docs = common.read(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_rows_without_sql_are_covered():
    assert set(QUERIES) - set(SQL) == {"op4_pii_anchors", "op7_ordinal_quality", "op9_bpe"}
    assert [q for q in QUERIES if q.split("_")[0] in {f"op{n}" for n in range(1, 11)}] == list(QUERIES) and len(QUERIES) == 10
