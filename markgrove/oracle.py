"""A second parser of pages, in SQL alone: coarse tokens, matching of tags and building with repairs as recursive queries.

It shares no code with the kernel but the names of its fixed tables. Its language is what the pages hold: tags with quoted attributes, comments,
declarations and text; instructions, CDATA and stray brackets are not in it.
"""

from __future__ import annotations

from .functions import markup
from .plans.kernel import HTML_CHILDREN

LEXED = f"""
lexed AS (
  SELECT page_id, unnest(range(len(ts))) AS seq, unnest(ts) AS token FROM (SELECT page_id, regexp_extract_all(html, '{markup.LEX}') AS ts FROM pages)
), toks AS (
  SELECT *, CASE WHEN starts_with(token, '<!--') THEN 'COMMENT' WHEN starts_with(token, '<![CDATA[') THEN 'CDATA' WHEN starts_with(token, '<?') THEN 'PI'
                 WHEN starts_with(token, '<!') THEN 'DOCTYPE' WHEN starts_with(token, '</') THEN 'CLOSE' WHEN token = '<' THEN 'STRAY'
                 WHEN starts_with(token, '<') THEN 'OPEN' ELSE 'TEXT' END AS class FROM lexed
)"""

_ATTRIBUTE = """[^\\s=<>/"'']+\\s*=\\s*("[^"]*"|''[^'']*'')"""
_CHILDREN = ", ".join(f"('{p}', '{c}')" for p, cs in HTML_CHILDREN.items() for c in sorted(cs))
_STACK = "STRUCT(node BIGINT, tag VARCHAR, has_text BOOLEAN, has_close BOOLEAN, depth BIGINT)[]"
_REPAIRS = "STRUCT(node BIGINT, tag VARCHAR, repair_type VARCHAR, impact DOUBLE)[]"

#: steps: one row per page and token that matters (k = 0 before the first); elements, repairs and notes (diagnostics) of each page.
TREE = f"""{LEXED}, named AS (
  SELECT page_id, seq, class, token, regexp_extract(token, '^</?([A-Za-z_:][A-Za-z0-9_:.-]*)', 1) AS tag, ends_with(token, '/>') AS alone,
         CASE WHEN class = 'OPEN' THEN len(regexp_extract_all(token, '{_ATTRIBUTE}')) ELSE 0 END AS n_attrs
  FROM toks
), t AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS k FROM named WHERE class IN ('OPEN', 'CLOSE') OR class = 'TEXT' AND regexp_matches(token, '\\S')
), matched(page_id, k, stack, hit) AS (
  SELECT page_id, 0::BIGINT, []::STRUCT(tag VARCHAR, k BIGINT)[], NULL::BIGINT FROM pages
  UNION ALL
  SELECT page_id, k, CASE WHEN class = 'OPEN' AND NOT alone THEN list_append(stack, {{'tag': tag, 'k': k}}) WHEN place > 0 THEN stack[1:place - 1] ELSE stack END, CASE WHEN place > 0 THEN stack[place].k END
  FROM (
    SELECT m.page_id, t.k, t.class, t.alone, t.tag, m.stack,
           CASE WHEN t.class = 'CLOSE' AND list_contains(list_transform(m.stack, lambda x: x.tag), t.tag)
                THEN len(m.stack) + 1 - list_position(list_reverse(list_transform(m.stack, lambda x: x.tag)), t.tag) ELSE 0 END AS place
    FROM matched m JOIN t ON t.page_id = m.page_id AND t.k = m.k + 1
  )
), marked AS (
  SELECT t.*, c.hit IS NOT NULL AS has_close FROM t LEFT JOIN matched c ON c.page_id = t.page_id AND c.hit = t.k
), steps(page_id, k, stack, n, early, made, parent, depth, repairs, note) AS (
  SELECT page_id, 0::BIGINT, []::{_STACK}, 0::BIGINT, false, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, []::{_REPAIRS}, NULL::VARCHAR FROM pages
  UNION ALL
  SELECT page_id, k,
         CASE WHEN class = 'TEXT' AND top IS NOT NULL THEN list_append(stack[1:len(stack) - 1], {{'node': top.node, 'tag': top.tag, 'has_text': true, 'has_close': top.has_close, 'depth': top.depth}})
              WHEN class = 'OPEN' AND alone THEN rest
              WHEN class = 'OPEN' THEN list_append(rest, {{'node': n, 'tag': tag, 'has_text': n = 0 AND early, 'has_close': has_close, 'depth': depth}})
              WHEN class = 'CLOSE' AND place > 0 THEN stack[1:place - 1] ELSE stack END::{_STACK},
         n + CASE WHEN class = 'OPEN' THEN 1 ELSE 0 END, early OR class = 'TEXT' AND n = 0,
         CASE WHEN class = 'OPEN' THEN n END, CASE WHEN class = 'OPEN' THEN parent END, CASE WHEN class = 'OPEN' THEN depth END,
         CASE WHEN class = 'OPEN' THEN list_concat(CASE WHEN auto THEN [{{'node': top.node, 'tag': top.tag, 'repair_type': 'unclosed_elements', 'impact': 0.1::DOUBLE}}] ELSE [] END,
                                                   CASE WHEN late THEN [{{'node': n, 'tag': tag, 'repair_type': 'trailing_content', 'impact': 0.1::DOUBLE}}] ELSE [] END)
              WHEN class = 'CLOSE' AND place > 0 AND place < len(stack)
              THEN list_transform(stack[place:], lambda x: {{'node': x.node, 'tag': x.tag, 'repair_type': 'mismatched_tags', 'impact': least(1.0, 0.1 * (len(stack) - place + 1))::DOUBLE}})
              ELSE [] END::{_REPAIRS},
         CASE WHEN class <> 'CLOSE' THEN NULL WHEN top IS NULL THEN 'Closing tag without matching opening tag' WHEN place = 0 THEN 'Orphaned closing tag </' || tag || '> ignored'
              WHEN place < len(stack) THEN 'Applied tag mismatch repair for </' || tag || '>' END
  FROM (
    SELECT *, CASE WHEN late THEN 0 WHEN len(rest) > 0 THEN rest[-1].node END AS parent, CASE WHEN late THEN 1 WHEN len(rest) > 0 THEN rest[-1].depth + 1 ELSE 0 END AS depth
    FROM (
      SELECT *, len(rest) = 0 AND n > 0 AS late
      FROM (
        SELECT *, CASE WHEN auto THEN stack[1:len(stack) - 1] ELSE stack END AS rest
        FROM (
          SELECT s.page_id, t.k, t.class, t.tag, t.alone, t.has_close, s.stack, s.n, s.early, s.stack[-1] AS top,
                 t.class = 'OPEN' AND len(s.stack) > 1 AND s.stack[-1].has_text AND s.stack[-1].tag <> t.tag AND NOT s.stack[-1].has_close
                   AND (lower(s.stack[-1].tag), lower(t.tag)) NOT IN ({_CHILDREN}) AS auto,
                 CASE WHEN t.class = 'CLOSE' AND list_contains(list_transform(s.stack, lambda x: x.tag), t.tag)
                      THEN len(s.stack) + 1 - list_position(list_reverse(list_transform(s.stack, lambda x: x.tag)), t.tag) ELSE 0 END AS place
          FROM steps s JOIN marked t ON t.page_id = s.page_id AND t.k = s.k + 1
        )
      )
    )
  )
), ends AS (
  SELECT page_id, len(arg_max(stack, k)) AS left_open, arg_max(stack, k) AS stack, max(n) AS n FROM steps GROUP BY page_id
), element_repairs AS (
  SELECT page_id, r.node, r.tag, r.repair_type, r.impact, false AS of_document FROM (SELECT page_id, unnest(repairs) AS r FROM steps)
  UNION ALL
  SELECT page_id, x.node, x.tag, 'unclosed_elements', least(1.0, 0.05 * left_open), false FROM (SELECT page_id, left_open, unnest(stack) AS x FROM ends)
), document_repairs AS (
  SELECT page_id, 'unclosed_elements' AS repair_type, least(1.0, 0.05 * left_open) AS impact FROM ends WHERE left_open > 0
), elements AS (
  SELECT s.page_id, s.made AS node, s.parent, s.depth, m.tag, m.n_attrs FROM steps s JOIN marked m USING (page_id, k) WHERE s.made IS NOT NULL
), notes AS (
  SELECT page_id, note AS message, CASE WHEN starts_with(note, 'Applied') THEN 'INFO' ELSE 'WARNING' END AS severity, 'structure_repair' AS component FROM steps WHERE note IS NOT NULL
  UNION ALL
  SELECT page_id, 'Auto-closed ' || left_open || ' unclosed elements', 'INFO', 'structure_repair' FROM ends WHERE left_open > 0
), applied AS (
  SELECT page_id, sum(c) AS n FROM (
    SELECT page_id, count(*) FILTER (class = 'OPEN') + sum(CASE WHEN class = 'CLOSE' THEN 1 ELSE 0 END) AS c
    FROM (SELECT s.page_id, m.class, unnest(CASE WHEN m.class = 'OPEN' THEN s.repairs ELSE s.repairs[1:1] END) FROM steps s JOIN marked m USING (page_id, k)) GROUP BY page_id
    UNION ALL SELECT page_id, 1 FROM document_repairs
  ) GROUP BY page_id
)"""


#: Own text, comments and attributes of each element, and its XML without a declaration.
XML = f"""{TREE}, pieces AS (
  SELECT s.page_id, s.k, coalesce(s.stack[-1].node, 0) AS node, regexp_replace(replace(m.token, '>', '&gt;'), '^\\s+|\\s+$', '', 'g') AS piece
  FROM steps s JOIN marked m USING (page_id, k) WHERE m.class = 'TEXT'
), texts AS (
  SELECT page_id, node, string_agg(piece, '' ORDER BY k) AS text FROM pieces GROUP BY page_id, node
), said AS (
  SELECT c.page_id, c.seq, c.token, max(m.k) AS k FROM named c JOIN marked m ON m.page_id = c.page_id AND m.seq < c.seq WHERE c.class = 'COMMENT' GROUP BY ALL
), comments AS (
  SELECT c.page_id, s.stack[-1].node AS node, string_agg('<!--' || regexp_replace(c.token[5:-4], '--+', '-', 'g') || '-->', '' ORDER BY c.seq) AS text
  FROM said c JOIN steps s USING (page_id, k) WHERE len(s.stack) > 0 GROUP BY ALL
), attributes AS (
  SELECT s.page_id, s.made AS node, unnest(range(m.n_attrs)) AS place, unnest(regexp_extract_all(m.token, '([^\\s=<>/"'']+)\\s*=\\s*(?:"[^"]*"|''[^'']*'')', 1)) AS name,
         unnest(list_transform(regexp_extract_all(m.token, '[^\\s=<>/"'']+\\s*=\\s*("[^"]*"|''[^'']*'')', 1), lambda v: v[2:-2])) AS value
  FROM steps s JOIN marked m USING (page_id, k) WHERE s.made IS NOT NULL AND m.n_attrs > 0
), heads AS (
  SELECT page_id, node, string_agg(' ' || name || '="' || replace(replace(replace(replace(replace(value, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') || '"', '' ORDER BY place) AS attrs
  FROM attributes GROUP BY page_id, node
), posts AS (
  SELECT e.page_id, e.node, coalesce(min(f.node) - 1, any_value(x.n) - 1) AS post
  FROM elements e JOIN ends x USING (page_id) LEFT JOIN elements f ON f.page_id = e.page_id AND f.node > e.node AND f.depth <= e.depth GROUP BY e.page_id, e.node
), repaired AS (
  SELECT page_id, node, regexp_replace(regexp_replace(text, '&(amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+)([^;a-zA-Z0-9]|$)', '&\\1;\\2', 'g'), '&(amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+)([^;a-zA-Z0-9]|$)', '&\\1;\\2', 'g') AS text FROM texts
), escaped AS (
  SELECT page_id, node, CASE WHEN regexp_matches(text, '&(amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);') THEN text ELSE replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END AS text FROM repaired
), inside AS (
  SELECT e.page_id, e.node, p.post, e.tag, coalesce(h.attrs, '') AS attrs, coalesce(c.text, '') || coalesce(t.text, '') AS body, p.post > e.node OR coalesce(t.text, '') <> '' AS filled
  FROM elements e JOIN posts p USING (page_id, node) LEFT JOIN heads h USING (page_id, node) LEFT JOIN comments c USING (page_id, node) LEFT JOIN escaped t USING (page_id, node)
), events AS (
  SELECT page_id, node AS place, 1 AS kind, node, CASE WHEN filled THEN '<' || tag || attrs || '>' || body ELSE '<' || tag || attrs || '/>' END AS part FROM inside p
  UNION ALL
  SELECT page_id, post, 2, node, '</' || tag || '>' FROM inside WHERE filled
), written AS (
  SELECT page_id, string_agg(part, '' ORDER BY place, kind, -node) AS xml FROM events GROUP BY page_id
)"""

_CATEGORY = " ".join(f"WHEN regexp_matches(lower(message), '{words}') THEN '{name}'" for name, words in (
    ("structure", "structure|hierarchy|parent|child"), ("namespaces", "namespace|xmlns|prefix"), ("attributes", "attribute|attr"), ("content", "content|text|data"),
    ("encoding", "encoding|character|utf"), ("security", "security|xxe|injection"), ("optimization", "optimize|performance|memory"),
))
CATEGORY = f"CASE {_CATEGORY} ELSE 'compliance' END"

ELEMENTS_BY_TAG = f"""WITH RECURSIVE {TREE}
SELECT tag, count(*) AS n, round(avg(depth), 6) AS mean_depth, round(avg(CASE WHEN r.node IS NULL THEN 0.0 ELSE 1.0 END), 6) AS repaired_share
FROM elements e LEFT JOIN (SELECT DISTINCT page_id, node FROM element_repairs) r USING (page_id, node) GROUP BY tag"""

REPAIRS_BY_TYPE = f"""WITH RECURSIVE {TREE}
SELECT repair_type, tag, count(*) AS n, round(sum(impact::DOUBLE), 6) AS impact FROM element_repairs GROUP BY 1, 2"""

SUMMARIES = f"""WITH RECURSIVE {TREE}, e AS (
  SELECT page_id, count(*) AS total_elements, sum(n_attrs) AS total_attributes, max(depth) AS max_depth, arg_min(tag, node) AS root_tag FROM elements GROUP BY page_id
), r AS (
  SELECT page_id, count(*) AS n, sum(impact::DOUBLE) AS impact FROM element_repairs GROUP BY page_id
), d AS (
  SELECT page_id, count(*) AS n, sum(impact::DOUBLE) AS impact FROM document_repairs GROUP BY page_id
), g AS (
  SELECT page_id, count(*) AS n, count(*) FILTER (severity = 'WARNING') AS warnings FROM notes GROUP BY page_id
)
SELECT p.page_id AS doc_id, true AS success, round(greatest(0.0::DOUBLE, 1.0 - 0.05::DOUBLE * coalesce(a.n, 0)), 6) AS confidence, 'utf-8' AS encoding, '1.0' AS version, NULL::VARCHAR AS standalone, e.root_tag,
       e.total_elements, e.total_attributes, e.max_depth, coalesce(a.n, 0) AS repairs_applied, coalesce(r.n, 0) + coalesce(d.n, 0) AS repair_count, coalesce(d.n, 0) AS document_repairs,
       round(coalesce(r.impact, 0) + coalesce(d.impact, 0), 6) AS repair_impact, coalesce(g.n, 0) AS diagnostic_count, 0 AS error_count, coalesce(g.warnings, 0) AS warning_count
FROM pages p LEFT JOIN e USING (page_id) LEFT JOIN applied a USING (page_id) LEFT JOIN r USING (page_id) LEFT JOIN d USING (page_id) LEFT JOIN g USING (page_id)"""

RESULTS = f"""WITH RECURSIVE {TREE}, e AS (
  SELECT page_id, count(*) AS n, sum(n_attrs) AS attrs, max(depth) AS deep FROM elements GROUP BY page_id
), r AS (
  SELECT page_id, repair_type, impact::DOUBLE AS impact, 0 AS own FROM element_repairs UNION ALL SELECT page_id, repair_type, impact::DOUBLE, 1 FROM document_repairs
), h AS (
  SELECT page_id, count(*) AS n, sum(own) AS own, sum(impact) AS impact FROM r GROUP BY page_id
), k AS (
  SELECT page_id, string_agg('"' || repair_type || '":' || n, ',' ORDER BY repair_type) AS j FROM (SELECT page_id, repair_type, count(*) AS n FROM r GROUP BY ALL) GROUP BY page_id
), g AS (
  SELECT page_id, sum(n) AS n, string_agg('"' || severity || '":' || n, ',' ORDER BY severity) AS j FROM (SELECT page_id, severity, count(*) AS n FROM notes GROUP BY ALL) GROUP BY page_id
), c AS (
  SELECT page_id, greatest(0.0::DOUBLE, 1.0 - 0.05::DOUBLE * coalesce(a.n, 0)) AS confidence FROM pages LEFT JOIN applied a USING (page_id)
)
SELECT c.page_id AS doc_id, true AS success, round(confidence, 6) AS confidence, e.n AS element_count, e.attrs AS attribute_count, e.deep AS max_depth, coalesce(h.n, 0) AS repair_count, coalesce(h.n, 0) > 0 AS has_repairs,
       coalesce(g.n, 0) AS total_diagnostics, false AS has_errors, '{{' || coalesce(g.j, '') || '}}' AS diagnostics_by_severity, CASE WHEN g.n > 0 THEN '{{"structure_repair":' || g.n || '}}' ELSE '{{}}' END AS diagnostics_by_component,
       coalesce(h.own, 0) AS document_repairs, coalesce(h.n - h.own, 0) AS element_repairs, '{{' || coalesce(k.j, '') || '}}' AS repair_types, round(coalesce(h.impact, 0), 6) AS repair_impact_on_confidence,
       round(CASE WHEN confidence > 0 THEN confidence ELSE 1.0 END, 6) AS overall_confidence
FROM c LEFT JOIN e USING (page_id) LEFT JOIN h USING (page_id) LEFT JOIN k USING (page_id) LEFT JOIN g USING (page_id)"""

WINDOWS = f"""WITH s AS ({SUMMARIES})
SELECT (1700000000 + 37 * doc_id) // 600 * 600 AS window_start, count(*) AS n_documents, round(avg(confidence), 6) AS mean_confidence, sum(repair_count) AS repairs, 0 AS failures FROM s GROUP BY 1"""

CATEGORIZED = f"""WITH RECURSIVE {TREE} SELECT {CATEGORY} AS category, severity, count(*) AS n FROM notes GROUP BY 1, 2"""

ROUND_TRIP = f"""WITH RECURSIVE {XML}
SELECT w.page_id AS doc_id, x.n AS total_elements, x.n AS elements_again, md5(w.xml) AS digest FROM written w JOIN ends x USING (page_id)"""

#: White space as the optimiser leaves it.
_CLEAN = "regexp_replace(regexp_replace(regexp_replace({}, '[\\t\\n\\r]', ' ', 'g'), ' {{2,}}', ' ', 'g'), '^ +| +$', '', 'g')"

REPORTS = f"""WITH RECURSIVE {XML}, worn AS (
  SELECT e.page_id, e.node, e.parent, e.depth, e.tag, e.n_attrs, t.text, {_CLEAN.format("t.text")} AS clean, p.post = e.node AS leaf, r.node IS NOT NULL AS has_repairs
  FROM elements e JOIN posts p USING (page_id, node) LEFT JOIN texts t USING (page_id, node) LEFT JOIN (SELECT DISTINCT page_id, node FROM element_repairs) r USING (page_id, node)
), gone AS (
  SELECT page_id, node FROM worn WHERE leaf AND parent IS NOT NULL AND coalesce(clean, '') = '' AND n_attrs = 0 AND NOT has_repairs
), passes AS (
  SELECT page_id, 'Consolidated text in ' || count(*) || ' elements' AS message, count(*) AS affected, sum(length(text) - length(clean)) AS saved FROM worn WHERE clean <> text GROUP BY page_id
  UNION ALL SELECT page_id, 'Removed ' || count(*) || ' redundant elements', count(*), sum(2 * length(tag) + 200) FROM worn JOIN gone USING (page_id, node) GROUP BY page_id
  UNION ALL SELECT page_id, 'Optimized attributes in ' || count(*) || ' elements', count(*), sum(length(name)) FROM attributes WHERE value = '' GROUP BY page_id
  UNION ALL SELECT page_id, 'Cleaned memory references in ' || count(*) || ' elements', count(*), sum(100 * (3 + 2 * n_attrs)) FROM worn ANTI JOIN gone USING (page_id, node) GROUP BY page_id
  UNION ALL SELECT page_id, 'Analyzed tree structure (depth: ' || max(depth) || ')', 0, 0 FROM worn GROUP BY page_id HAVING max(depth) > 50
), faults AS (
  SELECT page_id, 'Attribute value contains invalid characters: ' || name || '=' || value AS message, 'ERROR' AS severity FROM attributes WHERE regexp_matches(value, '[<>&"]')
  UNION ALL SELECT page_id, 'Tag name uses XML reserved prefix: ' || tag, 'WARNING' FROM elements WHERE starts_with(lower(tag), 'xml')
), told AS (
  SELECT page_id, message, severity FROM notes UNION ALL SELECT page_id, message, severity FROM faults UNION ALL SELECT page_id, message, 'STEP' FROM passes
), labelled AS (
  SELECT *, {CATEGORY} AS category, CASE WHEN regexp_matches(lower(message), 'structure|hierarchy') THEN 'structural' WHEN contains(lower(message), 'namespace') THEN 'namespace'
                                    WHEN contains(lower(message), 'attribute') THEN 'attribute' WHEN regexp_matches(lower(message), 'content|text') THEN 'content' ELSE 'other' END AS kind FROM told
), counted AS (
  SELECT page_id, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings,
         count(*) FILTER (category = 'structure') AS structure, count(*) FILTER (category = 'namespaces') AS namespaces, count(*) FILTER (category = 'security') AS security FROM labelled GROUP BY page_id
), categories AS (
  SELECT page_id, '{{' || string_agg('"' || category || '":' || n, ',' ORDER BY category) || '}}' AS j FROM (SELECT page_id, category, count(*) AS n FROM labelled GROUP BY ALL) GROUP BY page_id
), kinds AS (
  SELECT page_id, '{{' || string_agg('"' || kind || '":' || n, ',' ORDER BY kind) || '}}' AS j FROM (SELECT page_id, kind, count(*) AS n FROM labelled WHERE severity = 'ERROR' GROUP BY ALL) GROUP BY page_id
), steps_done AS (
  SELECT page_id, count(*) AS n, sum(affected) AS affected, sum(saved) AS saved FROM passes GROUP BY page_id
), n_repairs AS (
  SELECT page_id, count(*) AS n FROM (SELECT page_id FROM element_repairs UNION ALL SELECT page_id FROM document_repairs) GROUP BY page_id
), joined AS (
  SELECT x.page_id, x.n AS n_elements, coalesce(c.errors, 0) AS errors, coalesce(c.warnings, 0) AS warnings, c.structure, c.namespaces, c.security, coalesce(g.j, '{{}}') AS categories, coalesce(k.j, '{{}}') AS kinds,
         coalesce(s.n, 0) AS n_steps, coalesce(s.affected, 0) AS affected, coalesce(s.saved, 0) AS saved, coalesce(r.n, 0) AS n_repairs, greatest(0.0::DOUBLE, 1.0 - 0.05::DOUBLE * coalesce(a.n, 0)) AS confidence,
         (SELECT count(*) FROM faults f WHERE f.page_id = x.page_id AND severity = 'ERROR') AS v_errors, (SELECT count(*) FROM faults f WHERE f.page_id = x.page_id AND severity = 'WARNING') AS v_warnings
  FROM ends x LEFT JOIN counted c USING (page_id) LEFT JOIN categories g USING (page_id) LEFT JOIN kinds k USING (page_id) LEFT JOIN steps_done s USING (page_id) LEFT JOIN n_repairs r USING (page_id) LEFT JOIN applied a USING (page_id)
), judged AS (
  SELECT *, CASE WHEN v_errors > 0 THEN 1 - least(0.9::DOUBLE, 0.1::DOUBLE * v_errors) WHEN v_warnings > 0 THEN 1 - least(0.5::DOUBLE, 0.05::DOUBLE * v_warnings) ELSE 1.0::DOUBLE END AS verdict, errors / greatest(1, n_elements) AS rate FROM joined
)
SELECT page_id AS doc_id, CASE WHEN errors > 5 THEN 'POOR' WHEN errors > 0 THEN 'FAIR' WHEN warnings > 10 THEN 'FAIR' WHEN warnings > 0 THEN 'GOOD' ELSE 'EXCELLENT' END AS health,
       round(0.5 * confidence + 0.3 * verdict + 0.2, 6) AS overall_confidence, categories, errors AS total_errors, 0 AS critical_errors, errors AS recoverable_errors, warnings, kinds AS error_categories,
       CASE WHEN contains(kinds, 'namespace') THEN 'Namespace declaration issues' ELSE '' END AS root_causes, least(errors, n_elements) AS affected_elements, round(rate, 6) AS error_rate,
       n_repairs + n_steps AS total_repairs, '{{"parsing_repairs":' || n_repairs || ',"optimizations":' || n_steps || '}}' AS repair_types, round((confidence + 1) / 2, 6) AS repair_confidence, n_repairs + affected AS elements_repaired,
       CASE WHEN n_repairs + n_steps = 0 THEN 'No repairs needed - document was already in good condition' WHEN n_repairs + n_steps < 5 THEN 'Minor repairs applied - document quality improved'
            WHEN n_repairs + n_steps < 20 THEN 'Moderate repairs applied - significant quality improvement' ELSE 'Extensive repairs applied - document substantially improved' END AS repair_impact,
       concat_ws('; ', CASE WHEN rate > 0.1 THEN '📈 High error rate detected - consider document validation tools' END, CASE WHEN structure > 0 THEN '🏗️ Review document structure and element hierarchy' END,
                 CASE WHEN namespaces > 0 THEN '📋 Check XML namespace declarations and prefixes' END, CASE WHEN security > 0 THEN '🛡️ SECURITY: Review document for potential security issues' END,
                 CASE WHEN saved > 1000 THEN '⚡ Document optimized successfully - consider regular optimization' END, CASE WHEN v_errors > 0 THEN '📝 Address validation issues for better document quality' END,
                 CASE WHEN confidence < 0.8 THEN '📊 Low confidence score - review document quality and structure' END) AS recommendations
FROM judged"""

#: Pages with a stray bracket before each heading, a list's close tag cut short, and an open comment at the end.
BROKEN = """replace(replace(html, '<h1>', '< <h1>'), '</ul></nav>', '</ul</nav>') || '<!-- open'"""
_CASES = "(length(html) - length(replace(html, '<h1>', ''))) // 4 AS strays, (length(html) - length(replace(html, '</ul></nav>', ''))) // 11 AS cut"

#: Of each broken page: its tokens and what is wrong with them, from the coarse tokens of the page itself.
_BROKEN_COUNTS = f"""{LEXED}, c AS (
  SELECT page_id, sum(CASE class WHEN 'OPEN' THEN 3 + 2 * len(regexp_extract_all(token, '{_ATTRIBUTE}')) WHEN 'CLOSE' THEN 3 ELSE 1 END) AS n,
         sum(CASE class WHEN 'OPEN' THEN 4 + 3 * len(regexp_extract_all(token, '{_ATTRIBUTE}')) WHEN 'CLOSE' THEN 4 WHEN 'TEXT' THEN 2 ELSE 1 END) AS weight FROM toks GROUP BY page_id
), q AS (SELECT page_id, {_CASES} FROM pages), b AS (
  SELECT page_id, n + 2 * strays + 1 AS n_tokens, strays, cut, strays + cut + 1 AS bad, weight + 3 * strays + 1 AS weight, weight + 2.1::DOUBLE * strays - 0.2::DOUBLE * cut + 0.8::DOUBLE AS good FROM c JOIN q USING (page_id)
)"""

TOKEN_STATISTICS = f"""WITH {_BROKEN_COUNTS}
SELECT page_id AS doc_id, n_tokens, 0 AS n_errors, bad AS n_repaired, cut AS n_recovered, cut AS n_synthetic, 0.0::DOUBLE AS error_rate, round(bad / n_tokens, 6) AS repair_rate, round(cut / n_tokens, 6) AS recovery_rate,
       round(cut / n_tokens, 6) AS synthetic_rate, CASE WHEN strays > 0 THEN 0.1::DOUBLE ELSE 0.8::DOUBLE END AS min_confidence, round(good / weight, 6) AS confidence, round((n_tokens - bad) / n_tokens, 6) AS well_formed_share FROM b"""

RECOVERIES = f"""WITH {_BROKEN_COUNTS}
SELECT * FROM (SELECT 'skip_until_valid' AS strategy, sum(strays) AS n, 0.0::DOUBLE AS success_rate, 0.1::DOUBLE AS mean_confidence FROM b UNION ALL SELECT 'insert_missing_structure', sum(cut), 1.0::DOUBLE, 0.8::DOUBLE FROM b
  UNION ALL SELECT 'treat_as_text', count(*), 1.0::DOUBLE, 0.8::DOUBLE FROM b) WHERE n > 0"""

MERGED = f"""WITH {LEXED}, r AS (SELECT *, lag(class) OVER (PARTITION BY page_id ORDER BY seq) AS before FROM toks), c AS (
  SELECT page_id, sum(CASE class WHEN 'OPEN' THEN 3 + 2 * len(regexp_extract_all(token, '{_ATTRIBUTE}')) WHEN 'CLOSE' THEN 3 ELSE 1 END) AS n, count(*) FILTER (token = '<p>') AS doubled, count(*) FILTER (token = '<p>' AND before = 'TEXT') AS joined FROM r GROUP BY page_id
)
SELECT page_id AS doc_id, n + doubled - joined AS n_tokens, n + 2 * doubled AS n_before FROM c"""

#: Deepest nesting of open tags, by a running sum that never falls under 0.
REJECTIONS = f"""WITH {LEXED}, s AS (
  SELECT page_id, seq, CASE WHEN class = 'CLOSE' THEN -1 WHEN ends_with(token, '/>') THEN 0 ELSE 1 END AS step FROM toks WHERE class IN ('OPEN', 'CLOSE')
), r AS (
  SELECT page_id, seq, sum(step) OVER (PARTITION BY page_id ORDER BY seq) AS run FROM s
), f AS (
  SELECT page_id, run - least(0, min(run) OVER (PARTITION BY page_id ORDER BY seq)) AS depth FROM r
), d AS (
  SELECT page_id, max(depth) AS depth FROM f GROUP BY page_id
), p AS (
  SELECT page_id, CASE WHEN regexp_matches(html, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]') THEN 'control_characters' WHEN list_max(list_transform(string_split(html, chr(10)), lambda l: length(l))) > 100000 THEN 'line_too_long'
         WHEN contains(lower(html), 'javascript:') THEN 'dangerous_protocol_javascript' WHEN contains(lower(html), 'vbscript:') THEN 'dangerous_protocol_vbscript' WHEN contains(lower(html), 'data:') THEN 'dangerous_protocol_data'
         WHEN contains(lower(html), 'file:') THEN 'dangerous_protocol_file' WHEN coalesce(depth, 0) > {{depth}} THEN 'depth_limit_exceeded' WHEN len(regexp_extract_all(html, '&\\w+;')) > 50 THEN 'entity_reference_limit' END AS reason
  FROM pages LEFT JOIN d USING (page_id)
)
SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM p GROUP BY 1"""


RECOVERY_REPORT = f"""WITH {_BROKEN_COUNTS}, x AS (SELECT sum(strays) AS strays, sum(cut) AS cut, count(*) AS open FROM b)
SELECT strays + cut + open AS total_entries, round((cut + open) / (strays + cut + open), 6) AS overall_success_rate, round((0.1::DOUBLE * strays + 0.8::DOUBLE * (cut + open)) / (strays + cut + open), 6) AS average_confidence,
       '{{"insert_missing_structure":' || cut || ',"skip_until_valid":' || strays || ',"treat_as_text":' || open || '}}' AS strategy_counts,
       '{{"insert_missing_structure":1.0,"skip_until_valid":0.0,"treat_as_text":1.0}}' AS strategy_success_rates,
       '{{"error_recovery":' || (strays + cut) || ',"unclosed_comment":' || open || '}}' AS error_types, '{{"0":' || strays || ',"4":' || (cut + open) || '}}' AS confidence_distribution FROM x"""

TYPES = f"""WITH {LEXED}, q AS (SELECT sum(strays) AS strays, sum(cut) AS cut, count(*) AS pages FROM (SELECT {_CASES} FROM pages)), a AS (
  SELECT sum(CASE WHEN class = 'OPEN' THEN len(regexp_extract_all(token, '{_ATTRIBUTE}')) ELSE 0 END) AS attrs, count(*) FILTER (class IN ('OPEN', 'CLOSE')) AS tags, count(*) FILTER (class = 'TEXT') AS texts,
         count(*) FILTER (class = 'COMMENT') AS comments, count(*) FILTER (class = 'DOCTYPE') AS doctypes FROM toks
)
SELECT unnest(['TAG_START', 'TAG_NAME', 'TAG_END', 'SYNTHETIC_CLOSE', 'ATTR_NAME', 'ATTR_VALUE', 'TEXT', 'COMMENT', 'DOCTYPE', 'INVALID_CHARS']) AS type, unnest([tags, tags, tags - cut, cut, attrs, attrs, texts + strays, comments + pages, doctypes, strays]) AS n FROM a, q"""

FILTERED = f"""WITH {_BROKEN_COUNTS}, k AS (
  SELECT page_id, count(*) FILTER (class = 'COMMENT') + 1 AS comments, count(*) FILTER (class = 'TEXT') AS texts, count(*) FILTER (class IN ('OPEN', 'CLOSE') AND regexp_matches(token, '^</?h1[ >]')) AS headings FROM toks GROUP BY page_id
), e AS (
  SELECT page_id, count(*) FILTER (class IN ('OPEN', 'CLOSE') AND start < 100) AS early FROM (
    SELECT *, coalesce(sum(length(token)) OVER (PARTITION BY page_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM toks) GROUP BY page_id
)
SELECT page_id AS doc_id, comments, n_tokens - texts - 2 * strays AS no_texts, n_tokens - bad AS unsure, early, headings, least(7, n_tokens) AS first FROM b JOIN k USING (page_id) JOIN e USING (page_id)"""

POSITIONS = f"""WITH {LEXED}, o AS (
  SELECT page_id, class, coalesce(sum(length(token)) OVER (PARTITION BY page_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM toks
), p AS (
  SELECT o.page_id, start, html[1:start] AS before FROM o JOIN pages USING (page_id) WHERE class IN ('OPEN', 'CLOSE')
), q AS (
  SELECT page_id, start, 1 + length(before) - length(replace(before, chr(10), '')) AS line, 1 + length(string_split(before, chr(10))[-1]) AS col FROM p
)
SELECT page_id AS doc_id, count(*) AS n, sum(start) AS offsets, sum(line) AS lines, sum(col) AS cols, max(line) AS last_line FROM q GROUP BY 1"""

USUAL = f"""WITH {_BROKEN_COUNTS}
SELECT page_id AS doc_id, 'unclosed_comment' AS error_type, 'treat_as_text' AS strategy FROM b
UNION ALL SELECT page_id, 'error_recovery', CASE WHEN cut >= strays THEN 'insert_missing_structure' ELSE 'skip_until_valid' END FROM b WHERE strays + cut > 0"""


def whole(sql: str, *columns: str) -> str:
    """The SQL with these columns, sums of whole numbers, as 64-bit integers."""
    return f"SELECT * REPLACE ({', '.join(f'{c}::BIGINT AS {c}' for c in columns)}) FROM ({sql})"


SUMMARIES = whole(SUMMARIES, "total_attributes", "repairs_applied")
REPORTS = whole(REPORTS, "elements_repaired")
TOKEN_STATISTICS = whole(TOKEN_STATISTICS, "n_tokens")
RECOVERIES = whole(RECOVERIES, "n")
MERGED = whole(MERGED, "n_tokens", "n_before")
RESULTS = whole(RESULTS, "attribute_count", "total_diagnostics", "document_repairs", "element_repairs")
WINDOWS = whole(WINDOWS, "repairs")
RECOVERY_REPORT = whole(RECOVERY_REPORT, "total_entries")
TYPES = whole(TYPES, "n")
FILTERED = whole(FILTERED, "no_texts", "unsure", "first")
POSITIONS = whole(POSITIONS, "offsets", "lines", "cols")
