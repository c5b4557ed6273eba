"""Malformed documents with known answers: templates filled from a relational table, and what must come of each, written by hand.

{n} is a name and {k} a key of the table's rows. ELEMENTS has one row per element: (case, node, tag, parent, depth, text, attributes, comments,
instructions, repairs), with lists as texts. DOCUMENTS has the facts of the whole document, NOTES its diagnostics, XML its repaired form.
"""

from __future__ import annotations

#: The documents, by case.
TEMPLATES = (
    "<r><a><![CDATA[{n} < {k}]]></a></r>",
    '<?xml version="1.1" encoding="latin-1" standalone="yes"?><r><a>{n}</a></r>',
    "<.r><.a>{n}</.a></.r>",
    "<r>{n} < {k} <a>x</a></r>",
    '<r><a x="1" x="{k}" y=3 z>{n}</a></r>',
    "<r><a>{n}<b>t</r>",
    "<r><br/><a/>{n}</r><t>late</t>",
    "<r><!-- {n} -- x --><a>y</a></r>",
    "<r><?p {n}?><a>y</a></r>",
    '<!DOCTYPE r [<!ENTITY e "]>">]><r>{n}</r>',
    '<r><a href="{n}">x<a>y</r>',
    "<r><p>{n}<em>q</em> tail</p></r>",
    "<r a='x > {n}' b=\"&lt;\">z</r>",
    "<r>{n}<x",
    "<r><a <b>{n}</b></r>",
    "{n}<r/>",
    "",
    "<r><![CDATA[{n}",
    "<r><!-- {n}",
    "<r><?p {n}>x</r>",
    "<r><a><b><c>{n}</r>",
    "<r></q>{n}</r></r>",
    "<r><a/ ><b c='1'/></r>",
    "<t:r xmlns:t='u'><t:a>{n}</t:a><v:b/></t:r>",
)

ELEMENTS = (
    (0, 0, "r", None, 0, None, "", "", "", ""),
    (0, 1, "a", 0, 1, "{n} < {k}", "", "", "", ""),
    (1, 0, "r", None, 0, None, "", "", "", ""),
    (1, 1, "a", 0, 1, "{n}", "", "", "", ""),
    (2, 0, "r", None, 0, None, "", "", "", ""),
    (2, 1, "a", 0, 1, "{n}", "", "", "", ""),
    (3, 0, "r", None, 0, "{n}&lt;{k}", "", "", "", ""),
    (3, 1, "a", 0, 1, "x", "", "", "", ""),
    (4, 0, "r", None, 0, None, "", "", "", ""),
    (4, 1, "a", 0, 1, "{n}", "x={k};y=3", "", "", ""),
    (5, 0, "r", None, 0, None, "", "", "", "mismatched_tags:0.2"),
    (5, 1, "a", 0, 1, "{n}", "", "", "", "unclosed_elements:0.1"),
    (5, 2, "b", 0, 1, "t", "", "", "", "mismatched_tags:0.2"),
    (6, 0, "r", None, 0, "{n}", "", "", "", ""),
    (6, 1, "br", 0, 1, None, "", "", "", ""),
    (6, 2, "a", 0, 1, None, "", "", "", ""),
    (6, 3, "t", 0, 1, "late", "", "", "", "trailing_content:0.1"),
    (7, 0, "r", None, 0, None, "", "<!-- {n} - x -->", "", ""),
    (7, 1, "a", 0, 1, "y", "", "", "", ""),
    (8, 0, "r", None, 0, None, "", "", "<?p {n}?>", ""),
    (8, 1, "a", 0, 1, "y", "", "", "", ""),
    (9, 0, "r", None, 0, "{n}", "", "", "", ""),
    (10, 0, "r", None, 0, None, "", "", "", "mismatched_tags:0.3"),
    (10, 1, "a", 0, 1, "x", "href={n}", "", "", "mismatched_tags:0.3"),
    (10, 2, "a", 1, 2, "y", "", "", "", "mismatched_tags:0.3"),
    (11, 0, "r", None, 0, None, "", "", "", ""),
    (11, 1, "p", 0, 1, "{n}tail", "", "", "", ""),
    (11, 2, "em", 1, 2, "q", "", "", "", ""),
    (12, 0, "r", None, 0, "z", "a=x > {n};b=&lt;", "", "", ""),
    (13, 0, "r", None, 0, "{n}&lt;x", "", "", "", "unclosed_elements:0.05"),
    (14, 0, "r", None, 0, None, "", "", "", "mismatched_tags:0.2"),
    (14, 1, "a", 0, 1, None, "", "", "", "mismatched_tags:0.2"),
    (14, 2, "b", 1, 2, "{n}", "", "", "", ""),
    (15, 0, "r", None, 0, "{n}", "", "", "", ""),
    (17, 0, "r", None, 0, "{n}", "", "", "", "unclosed_elements:0.05"),
    (18, 0, "r", None, 0, None, "", "<!-- {n}-->", "", "unclosed_elements:0.05"),
    (19, 0, "r", None, 0, "&lt;?p {n}&gt;x", "", "", "", ""),
    (20, 0, "r", None, 0, None, "", "", "", "mismatched_tags:0.4"),
    (20, 1, "a", 0, 1, None, "", "", "", "mismatched_tags:0.4"),
    (20, 2, "b", 1, 2, None, "", "", "", "mismatched_tags:0.4"),
    (20, 3, "c", 2, 3, "{n}", "", "", "", "mismatched_tags:0.4"),
    (21, 0, "r", None, 0, "{n}", "", "", "", ""),
    (22, 0, "r", None, 0, None, "", "", "", "mismatched_tags:0.2"),
    (22, 1, "a", 0, 1, None, "", "", "", "mismatched_tags:0.2"),
    (22, 2, "b", 1, 2, None, "c=1", "", "", ""),
    (23, 0, "t:r", None, 0, None, "xmlns:t=u", "", "", ""),
    (23, 1, "t:a", 0, 1, "{n}", "", "", "", ""),
    (23, 2, "v:b", 0, 1, None, "", "", "", ""),
)

#: (case, confidence, version, encoding, standalone, repairs_applied, repair_count, warnings) of documents that are not plain.
PLAIN = (1.0, "1.0", "utf-8", None, 0, 0, 0)
DOCUMENTS = {
    1: (1.0, "1.1", "latin-1", "yes", 0, 0, 0),
    5: (0.9, "1.0", "utf-8", None, 2, 3, 0),
    6: (0.95, "1.0", "utf-8", None, 1, 1, 0),
    10: (0.95, "1.0", "utf-8", None, 1, 3, 0),
    13: (0.95, "1.0", "utf-8", None, 1, 2, 0),
    14: (0.95, "1.0", "utf-8", None, 1, 2, 0),
    17: (0.95, "1.0", "utf-8", None, 1, 2, 0),
    18: (0.95, "1.0", "utf-8", None, 1, 2, 0),
    20: (0.95, "1.0", "utf-8", None, 1, 4, 0),
    21: (1.0, "1.0", "utf-8", None, 0, 0, 2),
    22: (0.95, "1.0", "utf-8", None, 1, 2, 0),
}

NOTES = (
    (5, "INFO", "Applied tag mismatch repair for </r>"),
    (10, "INFO", "Applied tag mismatch repair for </r>"),
    (13, "INFO", "Auto-closed 1 unclosed elements"),
    (14, "INFO", "Applied tag mismatch repair for </r>"),
    (16, "INFO", "No tokens provided - empty document created"),
    (17, "INFO", "Auto-closed 1 unclosed elements"),
    (18, "INFO", "Auto-closed 1 unclosed elements"),
    (20, "INFO", "Applied tag mismatch repair for </r>"),
    (21, "WARNING", "Orphaned closing tag </q> ignored"),
    (21, "WARNING", "Closing tag without matching opening tag"),
    (22, "INFO", "Applied tag mismatch repair for </r>"),
)

#: Repaired documents, plain and pretty (lines divided by ¶, indents by two spaces), without declaration, of the first cases.
XML = (
    (3, "<r>{n}&lt;{k}<a>x</a></r>", "<r>¶{n}&lt;{k}¶  <a>x</a>¶</r>"),
    (4, '<r><a x="{k}" y="3">{n}</a></r>', '<r>¶  <a x="{k}" y="3">{n}</a>¶</r>'),
    (5, "<r><a>{n}</a><b>t</b></r>", "<r>¶  <a>{n}</a>¶  <b>t</b>¶</r>"),
    (6, "<r>{n}<br/><a/><t>late</t></r>", "<r>¶{n}¶  <br/>¶  <a/>¶  <t>late</t>¶</r>"),
    (7, "<r><!-- {n} - x --><a>y</a></r>", "<r>¶<!-- {n} - x -->¶  <a>y</a>¶</r>"),
    (8, "<r><?p {n}?><a>y</a></r>", "<r>¶<?p {n}?>¶  <a>y</a>¶</r>"),
    (10, '<r><a href="{n}">x<a>y</a></a></r>', '<r>¶  <a href="{n}">¶x¶    <a>y</a>¶  </a>¶</r>'),
    (12, '<r a="x &gt; {n}" b="&amp;lt;">z</r>', '<r a="x &gt; {n}" b="&amp;lt;">z</r>'),
    (16, "", ""),
)

#: Tokens of some documents as type=value, divided by |, and how many of them have repairs.
TOKENS = (
    (3, "TAG_START=<|TAG_NAME=r|TAG_END=>|TEXT={n} |INVALID_CHARS=&lt;|TEXT= {k} |TAG_START=<|TAG_NAME=a|TAG_END=>|TEXT=x|TAG_START=</|TAG_NAME=a|TAG_END=>|TAG_START=</|TAG_NAME=r|TAG_END=>", 1),
    (4, "TAG_START=<|TAG_NAME=r|TAG_END=>|TAG_START=<|TAG_NAME=a|ATTR_NAME=x|ATTR_VALUE=1|ATTR_NAME=x|ATTR_VALUE={k}|ATTR_NAME=y|ATTR_VALUE=3|ATTR_NAME=z|TAG_END=>|TEXT={n}|TAG_START=</|TAG_NAME=a|TAG_END=>|TAG_START=</|TAG_NAME=r|TAG_END=>", 1),
    (8, "TAG_START=<|TAG_NAME=r|TAG_END=>|PROCESSING_INSTRUCTION=p {n}|TAG_START=<|TAG_NAME=a|TAG_END=>|TEXT=y|TAG_START=</|TAG_NAME=a|TAG_END=>|TAG_START=</|TAG_NAME=r|TAG_END=>", 0),
    (9, 'DOCTYPE=DOCTYPE r [<!ENTITY e "]>">]|TAG_START=<|TAG_NAME=r|TAG_END=>|TEXT={n}|TAG_START=</|TAG_NAME=r|TAG_END=>', 0),
    (13, "TAG_START=<|TAG_NAME=r|TAG_END=>|TEXT={n}|TEXT=&lt;x", 1),
    (14, "TAG_START=<|TAG_NAME=r|TAG_END=>|TAG_START=<|TAG_NAME=a|SYNTHETIC_CLOSE=>|TAG_START=<|TAG_NAME=b|TAG_END=>|TEXT={n}|TAG_START=</|TAG_NAME=b|TAG_END=>|TAG_START=</|TAG_NAME=r|TAG_END=>", 1),
    (17, "TAG_START=<|TAG_NAME=r|TAG_END=>|CDATA={n}", 1),
    (18, "TAG_START=<|TAG_NAME=r|TAG_END=>|COMMENT= {n}", 1),
    (19, "TAG_START=<|TAG_NAME=r|TAG_END=>|TEXT=&lt;?p {n}&gt;|TEXT=x|TAG_START=</|TAG_NAME=r|TAG_END=>", 1),
)

#: Issues of the strictest validation: (case, type, severity, message).
ISSUES = (
    (0, None, None, None),
    (1, "encoding", "WARNING", "Non-standard XML version: 1.1"),
    (1, "encoding", "WARNING", "Non-standard encoding: latin-1"),
    (12, "attribute", "ERROR", "Attribute value contains invalid characters: a=x > {n}"),
    (12, "attribute", "ERROR", "Attribute value contains invalid characters: b=&lt;"),
    (16, "structural", "ERROR", "Document has no root element"),
    (23, "namespace", "ERROR", "Undeclared namespace prefix: v"),
)


def literal(v: object) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def values(rows, names: str) -> str:
    """A VALUES table of SQL."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS v({names})"


def filled(text: str) -> str:
    """SQL that fills a template from nation."""
    return f"replace(replace({text}, '{{n}}', n_name), '{{k}}', n_nationkey::VARCHAR)"


DOC = "kind * 100 + n_nationkey AS doc_id"

ELEMENTS_SQL = f"""SELECT {DOC}, node AS node_id, tag, parent AS parent_id, depth, {filled("text")} AS text, {filled("attrs")} AS attrs, {filled("comments")} AS comments, {filled("pis")} AS pis, repairs
FROM nation, {values(ELEMENTS, "kind, node, tag, parent, depth, text, attrs, comments, pis, repairs")}"""

_DOCUMENTS = [(k, *DOCUMENTS.get(k, PLAIN)) for k in range(len(TEMPLATES))]
DOCUMENTS_SQL = f"""SELECT {DOC}, confidence::DOUBLE AS confidence, version, encoding, standalone, repairs_applied, repair_count, warnings AS warning_count
FROM nation, {values(_DOCUMENTS, "kind, confidence, version, encoding, standalone, repairs_applied, repair_count, warnings")}"""

NOTES_SQL = f"SELECT {DOC}, severity, message FROM nation, {values(NOTES, 'kind, severity, message')}"
XML_SQL = f"SELECT {DOC}, {filled('plain')} AS plain, replace({filled('pretty')}, '¶', chr(10)) AS pretty FROM nation, {values(XML, 'kind, plain, pretty')}"
TOKENS_SQL = f"SELECT {DOC}, {filled('tokens')} AS tokens, n_repaired FROM nation, {values(TOKENS, 'kind, tokens, n_repaired')}"
ISSUES_SQL = f"SELECT {DOC}, issue_type, severity, {filled('message')} AS message FROM nation, {values([r for r in ISSUES if r[1]], 'kind, issue_type, severity, message')}"
