import json

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from markgrove import cli, engine, generate
from markgrove.config import Config, ConfigError, stream_warnings
from markgrove.functions import chars, markup, security
from markgrove.operators import nav, optimize, parse, recovery, report, serialize, tokens, validate
from markgrove.queries import QUERIES, SQL
from markgrove.sources import files
from markgrove.streaming import stream


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    if name in SQL:
        same_rows(QUERIES[name](spark, sf), duck, SQL[name])
    else:
        QUERIES[name](spark, sf).collect()


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, content string")


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "content,encoding,method",
    [
        (b"", "utf-8", "fallback"),
        (b"\xef\xbb\xbf<a/>", "utf-8", "bom"),
        (b"\xff\xfe<\x00a\x00", "utf-16-le", "bom"),
        (b"\xff\xfe\x00\x00", "utf-32-le", "bom"),
        (b"\x00\x00\xfe\xff", "utf-32-be", "bom"),
        (b"<?xml version='1.0' encoding='ISO-8859-1'?>", "latin-1", "xml_declaration"),
        (b"<?XML ENCODING=\"windows-1252\"?>", "cp1252", "xml_declaration"),
        (b"<r>plain ascii text</r>", "utf-8", "statistical"),
        ("<r>".encode() + b"caf\xe9" + b" plain text" * 20, "latin-1", "statistical"),
    ],
)
def test_detect(spark, content, encoding, method):
    found = value(spark, chars.detect(F.lit(content)))
    assert (found["encoding"], found["method"]) == (encoding, method)


def detected_documents(spark, duck, folder, name, texts):
    """A detection query held against its SQL on documents of its own; its rows by doc_id."""
    path = f"{folder}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    found = QUERIES[name](spark, str(folder))
    same_rows(found, con, SQL[name])
    return {r["doc_id"]: r for r in found.collect()}


def test_detect_cut_character(spark, duck, tmp_path):
    """The sample ends within a character of a text that is nearly all ASCII: UTF-8 if the whole content is, else Latin-1."""
    cut = ["a" * 8191 + "é z", "a" * 8190 + "€ z", "a" * 8189 + "😀" + "z" * 9000]
    found = detected_documents(spark, duck, tmp_path, "encoding_detect", ["plain", *cut[:2], cut[0], cut[2], "a" * 8190 + "é z"])
    assert {i: (found[i]["encoding"], found[i]["method"], found[i]["n_chars"]) for i in (1, 2, 4)} == {
        i: ("utf-8", "utf8_validation", len(text)) for i, text in zip((1, 2, 4), cut, strict=True)
    }
    assert (found[3]["encoding"], found[5]["method"]) == ("latin-1", "statistical")
    late = value(spark, chars.detect(F.lit(cut[0].encode() + b"\xff")))
    assert (late["encoding"], late["method"]) == ("latin-1", "statistical")


def test_detect_fast_cut_character(spark, duck, tmp_path):
    """No beginning of ASCII, and the sample ends within a character: the whole content is still UTF-8."""
    texts = ["é plain", "é" + "a" * 8189 + "é z", "a" * 8191 + "é z", "é" + "a" * 8189 + "é z", "é" + "a" * 8188 + "😀 z"]
    found = detected_documents(spark, duck, tmp_path, "encoding_fast", texts)
    assert {i: found[i]["method"] for i in (1, 2, 3, 4)} == {1: "utf8_validation", 2: "utf8_validation", 3: "statistical", 4: "utf8_validation"}


def test_detect_fast_characters_not_of_latin_1(spark, duck, tmp_path):
    """Characters that Latin-1 lacks are ? there: they stop neither the query, nor do they make a beginning one of ASCII."""
    texts = ["€ sign", "€ sign", "a" * 1024 + "€", "a" * 1023 + "€ é " + "a" * 9000, "é € x", "é € x", "😀" * 1023 + "é", "日" * 1024 + "é" * 1024, "日" * 1024, "a" * 1025 + "é😀" * 2000]
    found = detected_documents(spark, duck, tmp_path, "encoding_fast", [t for text in texts for t in (text, "plain", text)])
    assert {i: found[3 * i]["method"] for i in range(10) if 3 * i in found} == {
        **dict.fromkeys((0, 1, 3, 6, 8), "statistical"), **dict.fromkeys((2, 9), "utf8_validation")
    }


def test_decode_as_python(spark):
    raw = [b"a\xffb", b"\xe2\x82", "é".encode(), b"\xc3\x28", "x€".encode("utf-16-le"), "é".encode("cp1252")]
    codecs = ["utf-8", "utf-8", "utf-8", "utf-8", "utf-16-le", "cp1252"]
    df = spark.createDataFrame(list(zip(map(bytearray, raw), codecs, strict=True)), "c binary, e string")
    assert [r[0] for r in df.select(chars.decode(F.col("c"), F.col("e"))).collect()] == [c.decode(e, "replace") for c, e in zip(raw, codecs, strict=True)]


def test_transform_strategies(spark):
    t = F.lit("a\x01b￾c")
    assert value(spark, chars.transform(t)) == "a�b�c"
    assert value(spark, chars.transform(t, chars.TransformConfig("removal"))) == "abc"
    assert value(spark, chars.transform(t, chars.TransformConfig("escape"))) == "a&#1;b&#65534;c"
    assert value(spark, chars.transform(t, chars.TransformConfig("preservation", mappings={"a": "z"}))) == "z\x01b￾c"
    assert value(spark, chars.transform(t, chars.TransformConfig(contexts={"tag_name": "removal"}), "tag_name")) == "abc"
    assert [c["reason"] for c in value(spark, chars.changes(t))] == ["Control character: U+0001", "Non-character: U+FFFE"]
    with pytest.raises(ValueError):
        chars.TransformConfig.preset("nope")


def test_escapes(spark):
    assert value(spark, markup.escape_text(F.lit("a & b < c"))) == "a &amp; b &lt; c" == serialize.escape("a & b < c")
    assert value(spark, markup.escape_text(F.lit("a &amp b <"))) == "a &amp; b <" == serialize.escape("a &amp b <")
    assert value(spark, markup.decode_entities(F.lit("&lt;&amp;lt;"))) == "<&lt;"
    assert [value(spark, markup.is_fast_path(F.lit(x))) for x in ('<a b="c">', "<a b=c>", "<a><b>")] == [True, False, False]
    assert (value(spark, markup.local_name(F.lit("a:b:c"))), value(spark, markup.namespace_prefix(F.lit("a:b")))) == ("b:c", "a")


def test_navigation(spark):
    e = parse.elements(one(spark, '<r><a><t id="x">1</t></a><t>2</t><b><t>3</t><u><t>4</t></u></b></r>'))
    assert nav.find(e, "r", "t").first()["text"] == "2" and nav.first(e, "t").first()["text"] == "1"
    assert nav.find(e, "b", "t").first()["text"] == "3" and nav.descendants(e, "b", "t").count() == 2
    assert nav.element_by_id(e, "x").first()["text"] == "1" and nav.first_child(e, "r", "t").first()["text"] == "2"
    assert nav.full_text(e, "b").first()["full_text"] == "3 4"
    assert [r["same_tag_idx"] for r in nav.sibling_index(e).where("tag = 'u'").collect()] == [1]
    assert sorted(r["tag"] for r in nav.without(e, e.where("tag = 'b'").select("doc_id", "node_id")).collect()) == ["a", "r", "t", "t"]
    changed = nav.with_attribute(nav.with_attribute(e, "id", F.lit("y")), "k", F.lit("v")).where("text = '1'").first()
    assert [tuple(a) for a in changed["attrs"]] == [("id", "y"), ("k", "v")]
    assert nav.attribute_names(e) == ["id"] and list(engine.to_flat_pandas(e)["attr_id"])[2] == "x"


def test_parsing_does_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id AS doc_id", "html AS content")
    one_, many = (sorted(map(str, parse.elements(docs.repartition(n)).collect())) for n in (1, 7))
    assert one_ == many


def test_validation_levels(spark):
    parsed = parse.parse(one(spark, '<r a="1" A="2"><x:y/><xmlz q="a&amp;b"/></r>')).cache()
    n = [validate.validate(parsed, level).count() for level in validate.LEVELS]
    assert n == [2, 3, 4, 4]
    v = validate.verdicts(parsed, "strict").first()
    assert (v["valid"], v["error_count"], v["warning_count"], round(v["confidence"], 6)) == (False, 3, 1, 0.7)
    assert validate.validate(parse.parse(one(spark, "")), "minimal").first()["message"] == "Document has no root element"
    odd = parse.parse(one(spark, "<?xml version='1.1' encoding='koi8-r'?><r xmlns:p='u'><p:a/></r>"))
    assert [r["message"] for r in validate.validate(odd, "pedantic").collect()] == ["Non-standard XML version: 1.1", "Non-standard encoding: koi8-r"]
    broken = parsed.withColumn("elements", F.filter("elements", lambda e: e["node_id"] > 0))
    assert validate.validate(broken, "minimal").where("message like '%inconsistency'").count() == 2


def test_optimizer(spark):
    e = parse.elements(one(spark, '<r><p> a \n  b </p><q/><s t=""/></r>'))
    out = {r["tag"]: r for r in optimize.optimize(e).collect()}
    assert out["p"]["text"] == "a b" and "q" not in out and out["s"]["attrs"] == [] and out["r"]["n_children"] == 2


def test_serialisation(spark):
    parsed = parse.parse(one(spark, '<r a="x&quot;"><!--c--><i>1</i><i>2</i><e/></r>'), want=("elements",))
    o = serialize.Output(declaration=False)
    assert serialize.serialize_parsed(parsed, "xml", o).first()["content"] == '<r a="x&amp;quot;"><!--c--><i>1</i><i>2</i><e/></r>'
    assert serialize.serialize_parsed(parsed, "xml_pretty", o).first()["content"].splitlines()[2] == "  <i>1</i>"
    assert json.loads(serialize.serialize_parsed(parsed, "json").first()["content"])["r"]["i"] == [{"#text": "1"}, {"#text": "2"}]
    assert serialize.serialize_parsed(parsed, "xml_minified").first()["content"].startswith('<?xml version="1.0" encoding="utf-8"?><r')
    detailed = json.loads(serialize.serialize_parsed(parsed, "dict_detailed", serialize.Output(metadata=True)).first()["content"])
    assert detailed["r"]["_element_metadata"]["child_count"] == 3
    assert json.loads(serialize.serialize(parse.elements(one(spark, "<r/>")), "dict", serialize.Output()).first()["content"]) == {"r": {}}


def test_token_filters_and_assembly(spark):
    t = parse.tokens(one(spark, "<a x='1' x='2'>one <!-- c -- d --> two</a>")).cache()
    assert tokens.TokenFilter(types=("TEXT",)).apply(t).count() == 2 and tokens.TokenFilter("exclude", ("TEXT",)).apply(t).where("type = 'TEXT'").count() == 0
    assert tokens.TokenFilter(min_confidence=0.95).apply(t).where("type = 'COMMENT'").count() == 0
    assert tokens.TokenFilter(pattern="ONE", case_sensitive=False, max_results=1).apply(t).first()["value"] == "one "
    assert tokens.last_attributes(t).first()["value"] == "2" and tokens.statistics(t).first()["n_repaired"] == 2
    assert tokens.type_distribution(t).where("type = 'TEXT'").first()["count"] == 2
    raw = spark.createDataFrame([(1, i, "TEXT", x, i, 0.5) for i, x in enumerate(["Hello ", " world", "!"])], "doc_id long, seq int, type string, value string, offset int, confidence double")
    merged = tokens.merge_text(raw).first()
    assert merged["value"] == "Hello world!" and round(merged["confidence"], 6) == 0.55 and tokens.merge_text(raw, limit=2).count() == 2
    with pytest.raises(ValueError):
        tokens.TokenFilter(min_confidence=2)


def test_recovery_strategies():
    r = recovery
    assert r.insert_missing_structure(">", state="TAG_OPENING").tokens[0] == ("TAG_NAME", "unknown", 0.3)
    assert r.balanced_repair("x", error_type="unmatched_tag", recent=(("TAG_NAME", "a"),)).tokens == (("BALANCED_STRUCTURE", "</a>", 0.4),)
    assert r.character_escape("<").tokens[0][1] == "&lt;" and r.context_inference("<", around="1 ").confidence == 0.7
    assert r.context_inference("x").strategy == "treat_as_text" and r.choose({}) == "skip_until_valid" and r.learned(0.95, True) == 1.0
    assert r.skip_until_valid("?").confidence == 0.1 == r.final_fallback("?").confidence and 0 <= r.severity("tag name", "<>", 9) <= 1


def test_recovery_history(spark):
    h = recovery.history(parse.tokens(one(spark, "<a>< 1 < 2</a")))
    assert h.count() == 3 and recovery.usual_strategy(h).count() >= 1 and recovery.recent(h, 1).count() == 1


@pytest.mark.parametrize(
    "text,attack",
    [
        ('<!DOCTYPE r [<!ENTITY x SYSTEM "file:///etc/passwd">]>', "xxe"),
        ('<!ENTITY b "&a;&a;&a;">', "billion_laughs"),
        ("<d>" + "QUJD" * 400 + "</d>", "zip_bomb"),
        ("<a>" + "<b>x</b>" * 12 + "</a>", None),
        ("<n>" * 300, "resource_exhaustion"),
        ("<script>x</script>", "injection"),
        ("<a xmlns=''/>", "namespace_confusion"),
        ('<!DOCTYPE r SYSTEM "http://x/y.dtd">', "schema_poisoning"),
    ],
)
def test_threats(spark, text, attack):
    found = {r["attack_type"] for r in security.scan(one(spark, text), "doc_id").collect()}
    assert attack in found if attack else not found & {"resource_exhaustion"}


def test_long_documents_do_not_break_the_scanner(spark):
    assert security.scan(one(spark, "<a b='c'>" * 20_000), "doc_id").count() >= 1


@pytest.mark.parametrize("text,reason", [("a\x00", "null_bytes"), ("\x02", "control_characters"), ("x" * 100_001, "line_too_long"), ("<iframe>", "forbidden_element_iframe"), ("javascript:", "dangerous_protocol_javascript"), ("<a>" * 101, "depth_limit_exceeded"), ("&a;" * 51, "entity_reference_limit"), ("<a></a>" * 200, None), (None, "invalid_type")])
def test_policy(spark, text, reason):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(security.rejection(F.col("t"), security.Policy(forbidden_elements=("iframe",)))).first()[0] == reason


def test_reports(spark):
    parsed = parse.parse(one(spark, "<a><b>x</a></c>"), want=("elements", "diagnostics", "documents"))
    r = report.comprehensive(validate.with_verdict(validate.with_issues(parsed)))
    for style, start in (("json", "{"), ("text", "health:"), ("xml", "<report>"), ("html", "<table>")):
        assert report.export(r, style).first()["content"].startswith(start)
    assert value(spark, report.health(F.lit(0), F.lit(6), F.lit(0))) == "POOR" and value(spark, report.repair_impact(F.lit(7))).startswith("Moderate repairs")
    assert round(value(spark, report.overall_confidence(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.5))), 6) == round((0.5 + 0.15) / 0.8, 6)
    base, now = (spark.createDataFrame([("q", v)], "k string, mean double") for v in (10.0, 12.0))
    assert report.regressions(now, base, ["k"]).first()["verdict"] == "regression"


def test_config():
    c = Config().override(tree__mode="observed", tokenization__recovery__max_recovery_attempts=3)
    assert Config.from_json(c.to_json()) == c and c.tree.mode == "observed" and Config().tree.mode == "contract"
    for bad in ({"tree__mode": "x"}, {"tree__nope": 1}, {"tree__cache_size_limit": 10**6}, {"tokenization__filtering__confidence_threshold": 2}):
        with pytest.raises(ConfigError):
            Config().override(**bad)
    assert Config.preset("data_recovery").tree.max_repair_depth == 200 and stream_warnings(10, 5) and not stream_warnings(8192)


def test_engine_takes_any_input(spark):
    e = engine.Engine(spark)
    assert [e.parse(x).first()["success"] for x in (None, b"\xff\xfe\x00\x00", "<a/>", 1.5, ["x"])] == [True] * 5
    assert e.parse("<?xml version='1.0'?><a>café</a>".encode()).first()["root_tag"] == "a"
    assert e.reconfigured(tokenization__filtering__max_results=2).tokens("<a>b</a>").count() == 2
    assert e.repair(e.docs("<a><b>")).first()["content"].endswith("<a><b/></a>") and e.statistics(e.parse("<a/>")).first()["n_documents"] == 1
    assert e.report(e.docs("<a/>")).first()["health"] == "EXCELLENT" and e.secure(e.docs("<?php")).first()["blocked"]


def test_sql_functions(spark):
    engine.register_sql(spark)
    one(spark, "<a><b c='1'>t</b></a>").createOrReplaceTempView("markup_docs")
    assert spark.sql("SELECT tag, attrs['c'] AS c FROM markup_docs, LATERAL markup_elements(content) WHERE depth = 1").first()["c"] == "1"
    assert spark.sql("SELECT count(*) FROM markup_docs, LATERAL markup_tokens(content)").first()[0] > 5


def test_files_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text("<a><b>1</b></a>")
    (tmp_path / "in" / "b.svg").write_bytes("<a>café<b></a>".encode("latin-1"))
    (tmp_path / "in" / "c.txt").write_text("no")
    path = str(tmp_path / "in")
    assert files.read_files(spark, path).count() == 2 and files.parse_files(spark, path).where("success").count() == 2
    assert cli.main(["parse", path], spark) == 0 and cli.main(["validate", path], spark) == 1
    assert cli.main(["repair", path, "--output", str(tmp_path / "out"), "--format", "json"], spark) == 0
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert cli.main(["parse", str(tmp_path / "none")], spark) == 1 and "not found" in capsys.readouterr().err
    assert files.parse_files(spark, path, "latin-1").count() == 2
    files.write(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "t"), "text")
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "1\tx"


def test_stream(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id", "html", "timestamp_seconds(1700000000 + page_id * 60) AS ts")
    src.write.parquet(str(tmp_path / "in"))
    live = stream.read_stream(spark, str(tmp_path / "in"), "page_id long, html string, ts timestamp")
    summary = stream.summaries(live, "page_id", "html", "ts")
    stream.write_stream(summary, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == src.count()
    still = stream.summaries(src, "page_id", "html", "ts")
    windows = stream.quality_by_window(still, "ts").collect()
    assert sum(w["n_documents"] for w in windows) == src.count() and all(w["failures"] == 0 for w in windows)
    query = stream.write_stream(stream.quality_by_window(summary, "ts", late="1 minute"), str(tmp_path / "w"), str(tmp_path / "cpw"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "w")).count() > 0


def test_generated_cases_parse(spark):
    docs = generate.frame(spark, 60, 3)
    assert parse.documents(docs).where("success").count() == 60


def test_adapters(spark):
    from markgrove import adapters

    e = parse.elements(one(spark, '<r a="1"><b>x</b><c/></r>'))
    assert adapters.loss(adapters.get("elementtree"), e) == 0 and adapters.loss(adapters.get("xml"), e) == 0
    assert list(adapters.get("pandas").to_target(e)["tag"]) == ["r", "b", "c"] and adapters.names("text") == ["json", "xml"]
    adapters.register(adapters.Adapter("none", "text", str, needs=("no_such_module",)))
    assert "none" not in adapters.names() and "none" in adapters.names(available=False) and adapters.unregister("none")
    with pytest.raises(KeyError):
        adapters.get("none")
    assert adapters.discover() == []


def test_flat_back_to_xml_and_variations(spark):
    e = parse.elements(one(spark, "<r><b>x &amp; y</b></r>"))
    back = serialize.flat_to_xml(nav.flat(e)).first()["content"]
    assert back.startswith("<data><item><tag>r</tag>") and parse.documents(one(spark, back)).first()["total_elements"] == 9
    rows = [tuple(r) for r in generate.patterns(e).collect()]
    assert sorted(rows, key=repr) == [("r", "b", 1), (None, "r", 1)] and generate.variation(rows, 1).startswith("<r>")


def test_char_validity(spark):
    codes = spark.createDataFrame([(c,) for c in (0, 9, 0x1F, 0x20, 0xD800, 0xFFFE, 0x1FFFE, 0x10FFFF)], "c int")
    assert [r[0] for r in codes.select(chars.is_valid_char(F.col("c"))).collect()] == [False, True, False, True, False, False, False, True]
    assert value(spark, chars.utf8_validity(F.lit(b"\xff")))["confidence"] == 0.0


#: Queries that parse documents, and the Python passes of each: one kernel, or a chain of them without a join.
PASSES = {"serialize_pages": 3, "serialize_roundtrip": 2, "json_compact": 2, "json_pretty": 2, "malformed_xml": 2, "child_inserted": 2, "subtree_removed": 2}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_documents_are_parsed_once(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    passes = plan.count("MapInArrow") + plan.count("FlatMapGroupsInArrow")
    assert passes <= PASSES.get(name, 1)
    if passes:
        own_joins = {"parse_orders_nested", "pivot_records", "nav_children", "nav_by_attribute", "nav_find_all", "nav_paths", "nav_first_child", "ancestors_range_join", "tree_stats", "top_parent_paths", "nav_full_text_deep", "nav_sibling_places"}
        assert plan.count("Join") == (1 if name in own_joins | {"subtree_removed"} else 0), name  # orders are joined to customers before they are parsed


def test_sql_parser_against_the_kernel(spark, duck):
    """Random tag soup in the language of the SQL parser: the two parsers share no code."""
    import random

    from markgrove import oracle
    from markgrove.plans import kernel

    r = random.Random(8)
    parts = ["<a>", "</a>", "<b x=\"1\">", "</b>", "<p>", "</p>", "<ul>", "<li>", "</li>", "</ul>", "t ", " u", "<i/>", "<!-- c -->", "<div>", "</div>"]
    docs = [(i, "".join(r.choice(parts) for _ in range(r.randrange(25)))) for i in range(400)]
    con = duck.cursor()
    con.execute("CREATE SCHEMA soup; SET schema = 'soup'; CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", docs)
    theirs = con.execute(f"WITH RECURSIVE {oracle.TREE} SELECT page_id, node, parent, depth, tag, n_attrs FROM elements ORDER BY 1, 2").fetchall()
    repairs = con.execute(f"WITH RECURSIVE {oracle.TREE} SELECT page_id, node, tag, repair_type, round(impact::DOUBLE, 6) FROM element_repairs ORDER BY ALL").fetchall()
    notes = con.execute(f"WITH RECURSIVE {oracle.TREE} SELECT page_id, message, severity FROM notes ORDER BY ALL").fetchall()
    xml = dict(con.execute(f"WITH RECURSIVE {oracle.XML} SELECT page_id, xml FROM written").fetchall())
    parsed = {i: kernel.parse(t) for i, t in docs}
    assert theirs == [(i, k, e.parent if e.parent >= 0 else None, e.depth, e.tag, len(e.attrs)) for i, d in parsed.items() for k, e in enumerate(d.elements)]
    assert repairs == sorted((i, k, e.tag, x.repair_type, round(x.confidence_impact, 6)) for i, d in parsed.items() for k, e in enumerate(d.elements) for x in e.repairs)
    assert notes == sorted((i, x.message, x.severity) for i, d in parsed.items() for x in d.diagnostics if "No tokens" not in x.message)
    frame = spark.createDataFrame(docs, "doc_id long, content string")
    mine = {row["doc_id"]: row["content"] for row in serialize.serialize_parsed(parse.parse(frame, want=("elements",)), "xml", serialize.Output(declaration=False)).collect()}
    assert {i: x for i, x in mine.items() if x} == xml


def test_inputs_that_cannot_be_read(spark, tmp_path):
    e = engine.Engine(spark)
    (tmp_path / "a.dat").write_text("<a><b/></a>")
    good = e.parse(tmp_path / "a.dat", want=("documents", "diagnostics")).first()
    assert good["success"] and good["total_elements"] == 2 and [d["severity"] for d in good["diagnostics"]] == ["INFO"]
    for path, message in ((tmp_path / "none.xml", "File not found"), (tmp_path, "Not a file")):
        bad = e.parse(path, want=("elements", "documents")).first()
        assert (bad["success"], bad["confidence"], bad["error_count"]) == (False, 0.0, 1) and bad["diagnostics"][0]["severity"] == "CRITICAL" and message in bad["diagnostics"][0]["message"]
    assert e.parse("<a/>", correlation_id="x-1").first()["correlation_id"] == "x-1"


def test_files_of_a_flat_folder(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name in ("a.xml", "b.svg", "deep/c.xml"):
        (tmp_path / "in" / name).write_text("<a/>")
    assert files.read_files(spark, str(tmp_path / "in")).count() == 3 and files.read_files(spark, str(tmp_path / "in"), recursive=False).count() == 1
    row = files.parse_files(spark, str(tmp_path / "in")).first()
    assert row["diagnostics"] == [] and row["input_bytes"] == 4


def test_security_events(spark):
    told = []

    def failing(event):
        raise RuntimeError("a handler's own fault")

    e = engine.Engine(spark, handlers=(failing, told.append))
    row = e.audit(e.docs("<?php javascript:"))
    assert (row["total_requests"], row["blocked_requests"], row["threat_types"]) == (1, 1, {"injection": 2}) and told[0]["type"] == "scan_finished"
    e.reconfigured(global__security_level="paranoid")
    assert [t["type"] for t in told] == ["scan_finished", "policy_updated"]
    found = security.described(security.scan(one(spark, "<?php"), "doc_id")).first()
    assert found["description"].startswith("XML Injection") and found["mitigation"].startswith("Validate and sanitize")


def test_children_are_inserted_in_order(spark):
    e = parse.parse(one(spark, "<r><a><x/></a><b/></r>"), want=("elements",))

    def xml(frame):
        return serialize.serialize_parsed(frame, "xml", serialize.Output(declaration=False)).first()["content"]

    assert [xml(nav.with_child(e, F.lit(0), "n", F.lit("t"), F.lit(k))) for k in (0, 1, 2)] == ["<r><n>t</n><a><x/></a><b/></r>", "<r><a><x/></a><n>t</n><b/></r>", "<r><a><x/></a><b/><n>t</n></r>"]
    assert xml(nav.with_child(e, F.lit(2), "n", F.lit(None).cast("string"))) == "<r><a><x><n/></x></a><b/></r>" and xml(nav.with_child(e, F.lit(None), "n", F.lit("t"))) == "<r><a><x/></a><b/></r>"
    twice = nav.with_child(nav.with_child(e, F.lit(0), "n", F.lit("1"), F.lit(0)), F.lit(0), "n", F.lit("2"), F.lit(0))
    assert xml(twice) == "<r><n>2</n><n>1</n><a><x/></a><b/></r>" and nav.descendants(twice, "a").count() == 1
    with pytest.raises(Exception, match="no such place"):
        nav.with_child(e, F.lit(0), "n", F.lit("t"), F.lit(3)).collect()


def test_element_rows_do_as_nested_ones(spark):
    frame = parse.parse(one(spark, "<r><a><t id='k'>1</t></a><t>2</t></r>"), want=("elements",))
    flat = parse.rows(frame)
    for f in (lambda e: nav.descendants(e, "r", "t"), lambda e: nav.full_text(e, "r"), lambda e: nav.find(e, "r", "t"), lambda e: nav.element_by_id(e, "k").select("node_id"), lambda e: nav.stats(e)):
        assert sorted(map(str, f(frame).collect())) == sorted(map(str, f(flat).collect()))
    part = flat.where("node_id != 1")
    assert nav.descendants(part, "r").count() == 2


def test_damped_confidence_and_profile(spark):
    t = tokens.damped(parse.tokens(one(spark, "<a <b>x"))).where("type = 'SYNTHETIC_CLOSE'").first()
    assert round(t["confidence"], 6) == 0.79
    cut = tokens.damped(parse.tokens(one(spark, "<r><![CDATA[x"))).where("type = 'CDATA'").first()
    assert round(cut["confidence"], 6) == 0.67
    layers = spark.createDataFrame([("s", "lex", 900.0, 1 << 20, 10), ("s", "build", 600.0, 1 << 20, 9 << 20)], "session_id string, layer_name string, duration_ms double, input_size long, memory_delta long")
    p = report.profile(layers).first()
    assert (p["total_duration_ms"], p["slowest_layer"], p["slowest_share"]) == (1500.0, "lex", 0.6) and p["advice"] == ["slow", "low throughput", "most time in lex", "much memory for its input"]


def test_other_queries_work_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['markgrove.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'parse_pages_elements' in q and 'pipeline' not in q and not [n for n in q if n[:2] == 'op' and n[2].isdigit()] and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_stream_settings():
    assert stream_warnings(8192, 1 << 20) == [] and stream_warnings(8192, strict=True) == []
    told = [stream_warnings(0), stream_warnings(4096, 1024), stream_warnings(1 << 21, 0), stream_warnings(8192, strict=True, streaming=False)]
    assert [[t.split()[0] for t in x] for x in told] == [["Buffer", "Very"], ["Buffer"], ["Buffer", "Maximum", "Very"], ["Strict"]]
