import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from markgrove import generate
from markgrove.plans import kernel


def tree(text, mode="contract"):
    return kernel.parse(text, mode)


def rows(text, mode="contract"):
    return [(e.tag, "".join(e.text)) for e in tree(text, mode).elements]


def test_basic():
    d = tree('<shelf><book no="7">Atlas</book></shelf>')
    assert d.success and d.confidence == 1.0 and [e.path for e in d.elements] == ["/shelf", "/shelf/book"] and d.elements[1].attrs == {"no": "7"}


def test_unclosed_is_repaired():
    d = tree("<shelf><book>Atlas<map>north</shelf>")
    assert [(e.tag, e.parent) for e in d.elements] == [("shelf", -1), ("book", 0), ("map", 0)] and d.confidence == 0.9


def test_prolog():
    d = tree("<?xml version='1.1' standalone='no' encoding='koi8-r'?>\n<shelf>\n<book>Atlas</book>\n</shelf>")
    assert (d.version, d.encoding, d.standalone) == ("1.1", "koi8-r", "no") and ["".join(e.text) for e in d.elements] == ["", "Atlas"]


@pytest.mark.parametrize("text", [None, "", "plain words", "<<<", "><", "<>x</>", "<", "</", "</ ", "<b", "<b c", "<b c=", "<b c='", "<!", "<![", "<!DOCTYPE [", "<!--", "<!-->", "<![CDATA[", "<?", "<?>", "&", "&#;", "]]>", "\x00"])
def test_never_fails(text):
    assert tree(text).success


def test_mixed_content():
    d = tree("<line>to <place>Oslo</place> by <way>sea</way></line>")
    assert [(e.tag, e.parent, "".join(e.text)) for e in d.elements] == [("line", -1, "toby"), ("place", 0, "Oslo"), ("way", 0, "sea")] and d.confidence == 1.0


def test_sibling_closes_unclosed_text():
    d = tree("<log><day>Monday <hour at=9>rain</hour><hour at=10>wind << 5 >></hour></log>")
    assert [(e.tag, e.depth) for e in d.elements] == [("log", 0), ("day", 1), ("hour", 1), ("hour", 1)] and d.elements[2].attrs == {"at": "9"}


def test_self_closing_and_trailing_content():
    d = tree('<log><dot/><bar w="1" h=2 z/></log><end/>')
    assert [(e.tag, e.parent) for e in d.elements] == [("log", -1), ("dot", 0), ("bar", 0), ("end", 0)] and d.elements[3].repairs[0].repair_type == "trailing_content"


def test_attributes():
    a = tree("""<a b="1" b='2' c="x > y" d=u/v/>""").elements[0].attrs
    assert a == {"b": "2", "c": "x > y", "d": "u/v"}


def test_comments_cdata_instructions():
    d = tree("<a><!-- x -- y --><![CDATA[1 < 2]]><?p q?></a>")
    assert d.elements[0].comments == ["<!-- x - y -->"] and d.elements[0].text == ["1 < 2"] and d.elements[0].pis == ["<?p q?>"]


def test_paths_of_siblings():
    assert [e.path for e in tree("<r><a/><b/><a><c/></a></r>").elements] == ["/r", "/r/a[1]", "/r/b", "/r/a[2]", "/r/a[2]/c"]
    assert [e.flat_path for e in tree("<r><a/><b><c/></b></r>").elements] == ["/", "/a[0]", "/b[1]", "/b[1]c[0]"]


def test_mismatch_over_ten_levels():
    d = tree("<r>" + "<x>" * 15 + "</r>")
    assert d.success and max(r.confidence_impact for e in d.elements for r in e.repairs) == 1.0


def test_orphan_close_is_noted():
    assert [x.message for x in tree("<a></b></a>").diagnostics] == ["Orphaned closing tag </b> ignored"]


def test_observed_mode():
    assert rows("<?xml version='1.0'?><r/>", "observed")[0][1].startswith("<?xml") and rows("<r><![CDATA[x]]></r>", "observed") == [("r", "")]
    assert tree("<a href=x/y>t</a>", "observed").elements[0].attrs == {"href": "x"}


@pytest.mark.parametrize("name,clean", [("", "unknown"), ("4x", "x"), ("a b\tc", "abc"), ("a?b/c", "a_b_c"), ("<k>&", "k"), ("ü", "repaired_tag"), ("-x", "repaired_tag"), ("9", "repaired_tag"), ("k" * 1200, "k" * 1000)])
def test_sanitize(name, clean):
    assert kernel.sanitize_name(name) == clean


def test_strict_sanitize_keeps_the_place_of_a_digit():
    assert kernel.sanitize_name("1ab", True) == "_ab"


def test_positions_count_lines_and_tab_stops():
    t = kernel.lex("ab\n\t<x>")
    assert kernel.positions(t, "ab\n\t<x>")[1] == (2, 9)


def check_invariants(d):
    for i, e in enumerate(d.elements):
        assert e.parent < i and (e.parent >= 0) == (i > 0) and i <= e.post < len(d.elements)
        if e.parent >= 0:
            p = d.elements[e.parent]
            assert e.depth == p.depth + 1 and e.post <= p.post
    assert sum(e.n_children for e in d.elements) == max(0, len(d.elements) - 1)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="<>/ab=\"' !-?[]&x", max_size=60), st.lists(st.sampled_from(["<a>", "</a>", "<b c='1'>", "</b>", "t", "<i/>", "<!--", "-->", "<?", "?>", "<![CDATA[", "]]>", "<", ">"]), max_size=25).map("".join)))
def test_any_text_gives_a_proper_tree(text):
    d = tree(text)
    assert d.success
    check_invariants(d)
    assert tree(text, "observed").success


def test_generated_suite():
    cases = generate.suite(200, 7)
    assert cases == generate.suite(200, 7) and len(generate.coverage(cases)) > 12
    for _, kind, text in cases:
        d = tree(text)
        assert d.success, kind
        check_invariants(d)


def test_linear_time():
    tree("<a>" * 100_000 + "</a>" * 100_000)
    tree("<a " * 50_000)
    tree("<" * 200_000)
    tree("<a b='" * 5_000)
    r = random.Random(1)
    tree("".join(r.choice(["<a>", "</a>", "<b>", "</b>", "t"]) for _ in range(100_000)))


def test_long_things_stay_whole():
    # a declaration of many items, a long name, a long value and paths of deep elements
    subset = "<!ENTITY e '>]'>" * 100_000
    t = kernel.lex(f"<!DOCTYPE r [{subset}] ><r/>")
    assert [x.type for x in t] == ["DOCTYPE", "TAG_START", "TAG_NAME", "TAG_END"] and t[0].raw == f"<!DOCTYPE r [{subset}] >"
    d = tree(f"<{'n' * 3000} v='{'w' * 20_000}'/>")
    assert len(d.elements[0].tag) == 3000 and len(d.elements[0].attrs["v"]) == 20_000
    o = tree(f"<{'n' * 3000} v='{'w' * 20_000}'/>", "observed")
    assert len(o.elements[0].tag) == 1000 and len(o.elements[0].attrs["v"]) == 10_000
    deep = kernel.parse("<a>" * 5000, path_depth=None)
    assert deep.elements[-1].path == "/a" * 5000 and kernel.parse("<a>" * 5000).elements[-1].path is None


def test_declarations_take_linear_time():
    for t in ("<![" * 200_000, "<![" * 200_000 + "]", "<!['" * 100_000, "<![\"'" * 100_000, "<![" + "''" * 200_000 + "<![" * 1000, "<![\"" * 50_000 + "<![']" * 50_000):
        tree(t)


def test_observed_faults():
    deep = "<r>" + "<x>" * 12 + "</r>"
    assert [x.severity for x in tree(deep, "observed").diagnostics][:1] == ["ERROR"] and len(tree("<a></a><b><c/></b>", "observed").elements) == 1
    assert [e.tag for e in tree("<a></a><b>t</b></b><c/>", "observed").elements] == ["a"]


def test_repeated_attributes_are_told():
    names = [t for t in kernel.lex("<a x='1' y='2' x='3'>") if t.type == "ATTR_NAME"]
    assert [(t.confidence, t.repair and t.repair[0]) for t in names] == [(1.0, None), (1.0, None), (0.95, "duplicate_attribute")]


def slow_positions(text, offsets):
    out = []
    for o in offsets:
        line, col = 1, 1
        for c in text[:o]:
            line, col = (line + 1, 1) if c == "\n" else (line, (col - 1) // 8 * 8 + 9) if c == "\t" else (line, col + 1)
        out.append((line, col))
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\t\n<>/", max_size=60))
def test_positions(text):
    tokens = kernel.lex(text)
    assert kernel.positions(tokens, text) == slow_positions(text, [t.offset for t in tokens])


def test_observed_declarations_and_self_closing_tags():
    assert rows("<!DOCTYPE html><r/>", "observed")[0] == ("r", "html&gt;") and rows("<!DOCTYPE html><r/>") == [("r", "")]
    assert [(e.tag, e.parent) for e in tree("<r><br/><i x='1'/></r>", "observed").elements] == [("r", -1), ("br", 0), ("_", 1), ("i", 2)]
