"""The per-document kernel: markup text to tokens and to a repaired element tree, in linear time and without recursion.

This is the one step that no DataFrame operation can express (matching tags needs a stack). It has no Spark imports, never
raises on any text, and keeps no state between documents. parse() runs four passes: lexing by anchored patterns, matching
of open and close tags, building with repairs, and numbering in pre-order.

mode="contract" follows the documented behaviour; mode="observed" reproduces the known deviations listed in QUIRKS.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

NAME = r"[A-Za-z_:\u0080-\U0010ffff][A-Za-z0-9_:.\-\u0080-\U0010ffff]*"
OPEN = re.compile(rf"<\.?({NAME})")
CLOSE = re.compile(rf"</\.?\s*({NAME})[^<>]*(>?)")
ATTRIBUTE = re.compile(
    r"""\s*(?:
      (?P<end>/?>)
    | (?P<name>[^\s=<>/"']+)(?:\s*=\s*(?:"(?P<double>[^"]*)"|'(?P<single>[^']*)'|(?P<bare>(?:[^\s<>"'/]|/(?!>))+)?))?
    | (?P<stray>[^<])
    )""",
    re.X,
)
INSTRUCTION = re.compile(r"<\?([^>?]*(?:\?(?![><])[^>?]*)*)(\?>|\?(?=<)|>|\Z|\?\Z)")
DECLARATION = re.compile(r"<![^<>\[]*+")
SUBSET_MARK, SUBSET_END = re.compile(r"[\]\"']"), re.compile(r"\]\s*+>")
REST = re.compile(r"\s*\Z")
PROLOG_FIELD = re.compile(r"""(version|encoding|standalone)\s*=\s*["']([^"']*)["']""")
VALID_NAME = re.compile(r"[a-zA-Z_:][-a-zA-Z0-9_:.]*")

#: Tags that may nest in a tag which already has text, by lower-case parent.
HTML_CHILDREN = {
    "html": {"head", "body"},
    "head": {"title", "meta", "link", "script", "style"},
    "body": {"div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "span", "a"},
    "div": {"p", "span", "a", "img", "br"},
    "table": {"thead", "tbody", "tr"},
    "tr": {"td", "th"},
    "ul": {"li"},
    "ol": {"li"},
}

#: Lexical errors that are kept as invalid characters; later ones become text.
MAX_RECOVERIES = 50

#: By default, elements below this depth have no paths (their text would grow with the square of the depth); parse() takes any bound, or none.
PATH_DEPTH = 1000

#: Observed mode alone cuts names and values to so many characters.
NAME_LIMIT, VALUE_LIMIT = 1000, 10_000

QUIRKS = {
    "prolog_is_text": "an instruction before the root becomes the root's text",
    "always_auto_close": "an element with text is closed by any other tag, even if its close tag follows",
    "drop_cdata": "CDATA is dropped with a warning",
    "slash_ends_bare": "a bare attribute value ends at a slash",
    "strip_all_quotes": "quotes are stripped from both ends of attribute values without limit",
    "fixed_prolog": "version, encoding and standalone of the document keep their defaults",
    "cut_long": "tag names are cut to NAME_LIMIT and attribute values to VALUE_LIMIT characters",
    "failing_mismatch": "a close tag that would close more than ten elements is an error and closes none",
    "doctype_is_text": "of a declaration the first nine characters are lost, the tenth is invalid and the rest is text",
    "open_self_closed": "a tag that ends with /> stays open, and one without attributes gets a child named _",
    "lost_trailing": "elements after the root's end hang on nothing and are lost",
}


class Token(NamedTuple):
    type: str
    value: str
    offset: int
    confidence: float = 1.0
    repair: tuple[str, str, float] | None = None  # type, description, impact
    raw: str | None = None


class Diagnostic(NamedTuple):
    severity: str
    message: str
    component: str
    offset: int | None = None


class Repair(NamedTuple):
    repair_type: str
    description: str
    confidence_impact: float
    severity: str = "minor"


@dataclass(slots=True)
class Element:
    tag: str
    attrs: dict[str, str]
    parent: int
    depth: int
    child_idx: int
    offset: int
    text: list[str] = field(default_factory=list)
    repairs: list[Repair] = field(default_factory=list)
    comments: list[str] = field(default_factory=list)
    pis: list[str] = field(default_factory=list)
    preserve: bool = False
    post: int = 0
    n_children: int = 0
    path: str | None = None
    flat_path: str | None = None


@dataclass
class Document:
    elements: list[Element] = field(default_factory=list)
    tokens: list[Token] = field(default_factory=list)
    diagnostics: list[Diagnostic] = field(default_factory=list)
    repairs: list[Repair] = field(default_factory=list)
    repairs_applied: int = 0
    success: bool = True
    version: str = "1.0"
    encoding: str = "utf-8"
    standalone: str | None = None

    @property
    def confidence(self) -> float:
        return max(0.0, 1.0 - 0.05 * self.repairs_applied) if self.success else 0.0


def sanitize_name(name: str, strict: bool = False) -> str:
    """A usable tag name of any text."""
    if not name:
        return "unknown"
    name = re.sub(r"\s+", "", re.sub(r"[<>&\"']", "", name))
    if name[:1].isdigit():
        name = "_" + name[1:] if strict else name[1:]
    name = re.sub(r"[^\w\-.:]", "_", name)[:1000]
    return name if VALID_NAME.fullmatch(name) else "repaired_tag"


def clean_name(name: str, quirks: frozenset[str] = frozenset()) -> str:
    """Names with letters outside ASCII, and names of any length, are kept by the contract; other odd names are sanitised."""
    return name if re.fullmatch(NAME, name) and not ("cut_long" in quirks and len(name) > NAME_LIMIT) else sanitize_name(name)


def declaration_end(text: str, at: int, known: dict[int, int]) -> int:
    """Where the declaration <!...> at `at` ends, or -1. An internal subset ends at the first ] outside its literals.

    known holds the end for each mark met in a subset, so that all declarations of a text together take linear time.
    """
    at = DECLARATION.match(text, at).end()
    if text.startswith(">", at):
        return at + 1
    if not text.startswith("[", at):
        return -1
    met, end, at = [], -1, at + 1
    nearest = known.get(-1, -1)  # the last first mark found: it is the first one from any place before it, too
    mark = nearest if nearest >= at else m.start() if (m := SUBSET_MARK.search(text, at)) else len(text)
    known[-1] = mark
    while mark < len(text):
        if mark in known:
            end = known[mark]
            break
        met.append(mark)
        if text[mark] == "]":
            m = SUBSET_END.match(text, mark)
            end = m.end() if m else -1
            break
        close = text.find(text[mark], mark + 1)
        m = SUBSET_MARK.search(text, close + 1) if close >= 0 else None
        mark = m.start() if m else len(text)
    known.update(dict.fromkeys(met, end))
    return end


def lex(text: str, quirks: frozenset[str] = frozenset()) -> list[Token]:
    """Tokens of a text; every character is in some token's raw text or value."""
    out: list[Token] = []
    add, at, n, errors = out.append, 0, len(text), 0
    subsets: dict[int, int] = {}
    while at < n:
        lt = text.find("<", at)
        stop = n if lt < 0 else lt
        if stop > at:
            raw = text[at:stop]
            add(Token("TEXT", raw.replace(">", "&gt;"), at, raw=raw))
            at = stop
            if lt < 0:
                break
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            body = text[at + 4 : n if end < 0 else end]
            if end < 0:
                add(Token("COMMENT", body, at, 0.8, ("unclosed_comment", "comment without its end", -0.2), text[at:]))
                break
            clean = re.sub("--+", "-", body)
            if clean != body:
                add(Token("COMMENT", clean, at, 0.9, ("malformed_comment", "double hyphen in a comment", -0.1), text[at : end + 3]))
            else:
                add(Token("COMMENT", body, at, raw=text[at : end + 3]))
            at = end + 3
        elif text.startswith("<![CDATA[", at):
            end = text.find("]]>", at + 9)
            if end < 0:
                add(Token("CDATA", text[at + 9 :], at, 0.7, ("incomplete_token", "CDATA without its end", -0.3), text[at:]))
                break
            add(Token("CDATA", text[at + 9 : end], at, raw=text[at : end + 3]))
            at = end + 3
        elif text.startswith("<?", at):
            m = INSTRUCTION.match(text, at)
            body, close = m[1], m[2]
            fault = ("malformed_processing_instruction", "instruction without ?>", -0.3 if close != "?" else -0.1)
            if close == "?>":
                add(Token("PROCESSING_INSTRUCTION", body, at, raw=m[0]))
            elif close == "?":
                add(Token("PROCESSING_INSTRUCTION", body, at, 0.9, fault, m[0]))
            else:
                add(Token("TEXT", m[0].replace("<", "&lt;").replace(">", "&gt;"), at, 0.7, fault, m[0]))
            at = m.end()
        elif "doctype_is_text" in quirks and text.startswith("<!", at) and at + 10 <= n:
            errors += 1
            add(Token("INVALID_CHARS", text[at + 9], at + 9, 0.1, ("error_recovery", "declaration", -0.1), text[at : at + 10]))
            at += 10
        elif text.startswith("<!", at) and (end := declaration_end(text, at, subsets)) >= 0:
            add(Token("DOCTYPE", text[at + 2 : end - 1].strip(), at, raw=text[at:end]))
            at = end
        elif m := CLOSE.match(text, at):
            add(Token("TAG_START", "</", at))
            add(Token("TAG_NAME", m[1], m.start(1)))
            if m[2]:
                add(Token("TAG_END", ">", m.end() - 1))
            else:
                add(Token("SYNTHETIC_CLOSE", ">", m.end(), 0.8, ("error_recovery", "close tag without its end", -0.1)))
            at = m.end()
        elif m := OPEN.match(text, at):
            at = lex_tag(text, at, m, out, quirks)
        else:
            kind = "TEXT" if errors >= MAX_RECOVERIES or text.startswith("<<", at) else "INVALID_CHARS"
            errors += 1
            add(Token(kind, "&lt;", at, 0.1, ("error_recovery", "stray tag start", -0.1), "<"))
            at += 1
    return out


def lex_tag(text: str, at: int, m: re.Match[str], out: list[Token], quirks: frozenset[str]) -> int:
    """Tokens of an open tag that starts at `at`; where it ends."""
    start, first, n, names = at, len(out), len(text), set()
    out.append(Token("TAG_START", "<", at))
    out.append(Token("TAG_NAME", m[1], m.start(1)))
    at = m.end()
    while True:
        a = ATTRIBUTE.match(text, at)
        if a is None:
            if REST.match(text, at):  # the text ends within the tag
                del out[first:]
                out.append(Token("TEXT", text[start:].replace("<", "&lt;").replace(">", "&gt;"), start, 0.7, ("incomplete_token", "tag without its end", -0.3), text[start:]))
                return n
            at = text.index("<", at)  # another tag begins
            out.append(Token("SYNTHETIC_CLOSE", ">", at, 0.8, ("error_recovery", "tag without its end", -0.1)))
            return at
        at = a.end()
        if a["end"]:
            out.append(Token("TAG_END", a["end"], a.start("end")))
            return at
        if a["name"]:
            if a["name"] in names:
                out.append(Token("ATTR_NAME", a["name"], a.start("name"), 0.95, ("duplicate_attribute", "attribute of a name met before", -0.05)))
            else:
                out.append(Token("ATTR_NAME", a["name"], a.start("name")))
            names.add(a["name"])
            for kind in ("double", "single", "bare"):
                value = a[kind]
                if value is None:
                    continue
                if kind == "bare" and "slash_ends_bare" in quirks:
                    value = value.split("/")[0]
                if "strip_all_quotes" in quirks:
                    value = value.strip("\"'")
                out.append(Token("ATTR_VALUE", value, a.start(kind)))


def match_tags(tokens: list[Token]) -> dict[int, int]:
    """For the index of each open tag's TAG_START the index of its close tag's; open tags without one are left out."""
    stack: list[tuple[str, int]] = []
    open_: dict[str, int] = {}
    found: dict[int, int] = {}
    for i, t in enumerate(tokens):
        if t.type != "TAG_START":
            continue
        name = tokens[i + 1].value
        if t.value == "<":
            k = i + 2
            while tokens[k].type not in ("TAG_END", "SYNTHETIC_CLOSE"):
                k += 1
            if tokens[k].value != "/>":
                stack.append((name, i))
                open_[name] = open_.get(name, 0) + 1
        elif open_.get(name):
            while True:
                top, at = stack.pop()
                open_[top] -= 1
                if top == name:
                    found[at] = i
                    break
    return found


class Builder:
    """Builds the tree of one document from its tokens."""

    def __init__(self, tokens: list[Token], quirks: frozenset[str] = frozenset()):
        self.doc, self.quirks, self.closes = Document(tokens=tokens), quirks, match_tags(tokens)
        self.stack: list[int] = []
        self.by_name: dict[str, int] = {}
        self.starts: list[int] = []  # of each element, the index of its TAG_START
        self.early: list[str] = []
        self.lost: list[str] = []  # open elements of a lost subtree

    def note(self, severity: str, message: str, component: str, offset: int | None = None) -> None:
        self.doc.diagnostics.append(Diagnostic(severity, message, component, offset))

    def add_text(self, value: str) -> None:
        if self.lost:
            return
        where = self.stack[-1] if self.stack else (0 if self.doc.elements else -1)
        if where < 0:
            self.early.append(value)
        elif part := value.strip():
            self.doc.elements[where].text.append(part)

    def open(self, i: int, tag: str, attrs: dict[str, str], closed: bool) -> None:
        elements, stack = self.doc.elements, self.stack
        if self.lost:
            if not closed:
                self.lost.append(tag)
            return
        if stack:
            top = elements[stack[-1]]
            has_close = self.starts[stack[-1]] in self.closes and "always_auto_close" not in self.quirks
            if top.text and top.tag != tag and not has_close and tag.lower() not in HTML_CHILDREN.get(top.tag.lower(), ()) and len(stack) > 1:
                top.repairs.append(Repair("unclosed_elements", f"Auto-closed <{top.tag}> before <{tag}>", 0.1))
                self.doc.repairs_applied += 1
                self.pop()
        if not stack and elements:  # the root has been closed: what follows hangs on it
            if "lost_trailing" in self.quirks:
                if not closed:
                    self.lost.append(tag)
                return
            parent = 0
            repair = Repair("trailing_content", f"<{tag}> after the root was attached to it", 0.1)
            self.doc.repairs_applied += 1
        else:
            parent, repair = (stack[-1] if stack else -1), None
        depth = elements[parent].depth + 1 if parent >= 0 else 0
        order = elements[parent].n_children if parent >= 0 else 0
        element = Element(tag, attrs, parent, depth, order, self.doc.tokens[i].offset)
        if repair:
            element.repairs.append(repair)
        if parent >= 0:
            elements[parent].n_children += 1
        elements.append(element)
        self.starts.append(i)
        if parent < 0 and self.early:
            if "prolog_is_text" in self.quirks and (early := "".join(self.early).strip()):
                element.text.append(early)
            elif early := "".join(x.strip() for x in self.early):
                element.text.append(early)
            self.early.clear()
        if not closed:
            stack.append(len(elements) - 1)
            self.by_name[tag] = self.by_name.get(tag, 0) + 1

    def pop(self) -> Element:
        element = self.doc.elements[self.stack.pop()]
        self.by_name[element.tag] -= 1
        return element

    def close(self, tag: str, offset: int) -> None:
        stack, elements = self.stack, self.doc.elements
        if tag in self.lost:
            while self.lost.pop() != tag:
                pass
        elif not stack:
            self.note("WARNING", "Closing tag without matching opening tag", "structure_repair", offset)
        elif elements[stack[-1]].tag == tag:
            self.pop()
        elif self.by_name.get(tag):
            if "failing_mismatch" in self.quirks and tag not in {elements[i].tag for i in stack[-10:]}:
                self.note("ERROR", "Confidence impact must be between 0.0 and 1.0", "xml_tree_builder", offset)
                return
            closed = []
            while not closed or closed[-1].tag != tag:
                closed.append(self.pop())
            repair = Repair("mismatched_tags", f"Auto-closed {len(closed)} unclosed elements", min(1.0, 0.1 * len(closed)))
            for element in closed:
                element.repairs.append(repair)
            self.doc.repairs_applied += 1
            self.note("INFO", f"Applied tag mismatch repair for </{tag}>", "structure_repair", offset)
        else:
            self.note("WARNING", f"Orphaned closing tag </{tag}> ignored", "structure_repair", offset)

    def instruction(self, value: str) -> None:
        if not self.doc.elements and value[:3].lower() == "xml" and "prolog_is_text" not in self.quirks:
            if "fixed_prolog" not in self.quirks:
                for name, v in PROLOG_FIELD.findall(value):
                    setattr(self.doc, name, v)
        elif self.stack:
            element = self.doc.elements[self.stack[-1]]
            if value.strip():
                element.pis.append(f"<?{value}?>")
            else:
                element.preserve = True
        elif "prolog_is_text" in self.quirks:
            self.add_text(f"<?{value}?>")

    def comment(self, value: str) -> None:
        if self.stack:
            element = self.doc.elements[self.stack[-1]]
            if value.strip():
                element.comments.append(f"<!--{value}-->")
            else:
                element.preserve = True

    def build(self) -> Document:
        tokens, i, n = self.doc.tokens, 0, len(self.doc.tokens)
        if not n:
            self.note("INFO", "No tokens provided - empty document created", "tree_builder")
        while i < n:
            t = tokens[i]
            if t.type == "TAG_START":
                tag, k, attrs, name = clean_name(tokens[i + 1].value, self.quirks), i + 2, {}, None
                while (kind := tokens[k].type) not in ("TAG_END", "SYNTHETIC_CLOSE"):
                    if kind == "ATTR_NAME":
                        name = tokens[k].value
                    elif name is not None:
                        attrs.pop(name, None)  # the last of a name wins, at its own place
                        attrs[name], name = tokens[k].value[: VALUE_LIMIT if "cut_long" in self.quirks else None], None
                    k += 1
                if t.value == "<":
                    alone, kept_open = tokens[k].value == "/>", "open_self_closed" in self.quirks
                    self.open(i, tag, attrs, alone and not kept_open)
                    if alone and kept_open and k == i + 2:
                        self.open(i, "_", {}, False)
                else:
                    self.close(tag, t.offset)
                i = k
            elif t.type in ("TEXT", "INVALID_CHARS", "RECOVERED_CONTENT"):
                self.add_text(t.value)
            elif t.type == "CDATA":
                if "drop_cdata" in self.quirks:
                    self.note("WARNING", "Unhandled token type: CDATA", "token_processor", t.offset)
                elif self.stack and t.value:
                    self.doc.elements[self.stack[-1]].text.append(t.value)
            elif t.type == "COMMENT":
                self.comment(t.value)
            elif t.type == "PROCESSING_INSTRUCTION":
                self.instruction(t.value)
            i += 1
        if left := len(self.stack):
            repair = Repair("unclosed_elements", f"Auto-closed {left} unclosed elements", min(1.0, 0.05 * left))
            for at in self.stack:
                self.doc.elements[at].repairs.append(repair)
            self.doc.repairs.append(repair)
            self.doc.repairs_applied += 1
            self.note("INFO", f"Auto-closed {left} unclosed elements", "structure_repair")
        return self.doc


def number(doc: Document, path_depth: int | None = PATH_DEPTH) -> None:
    """Pre-order is the order of the list, but for what was attached to the root late, which comes last anyway. Fill post and the paths."""
    elements = doc.elements
    for i in range(len(elements) - 1, -1, -1):
        e = elements[i]
        e.post = max(e.post, i)
        if e.parent >= 0:
            elements[e.parent].post = max(elements[e.parent].post, e.post)
    same: dict[tuple[int, str], int] = {}
    for e in elements:
        same[e.parent, e.tag] = same.get((e.parent, e.tag), 0) + 1
    seen: dict[tuple[int, str], int] = {}
    for e in elements:
        k = seen[e.parent, e.tag] = seen.get((e.parent, e.tag), 0) + 1
        if e.parent < 0:
            e.path, e.flat_path = f"/{e.tag}", "/"
            continue
        if path_depth is not None and e.depth > path_depth:
            continue
        above = elements[e.parent]
        e.path = f"{above.path}/{e.tag}" + (f"[{k}]" if same[e.parent, e.tag] > 1 else "")
        e.flat_path = f"/{e.tag}[{e.child_idx}]" if above.flat_path == "/" else f"{above.flat_path}{e.tag}[{e.child_idx}]"


def parse(text: str | None, mode: str = "contract", path_depth: int | None = PATH_DEPTH) -> Document:
    """The document of a text; paths down to path_depth (None: all). Never raises: a failure gives success=False and a CRITICAL diagnostic."""
    quirks = frozenset(QUIRKS) if mode == "observed" else frozenset()
    try:
        content = text or ""
        if mode != "observed" and content[:1] == "﻿":
            content = content[1:]
        doc = Builder(lex(content, quirks), quirks).build()
        number(doc, path_depth)
        return doc
    except Exception as e:  # the contract: one bad document must not fail a job
        return Document(success=False, diagnostics=[Diagnostic("CRITICAL", f"Tree building failed: {e}", "xml_tree_builder")])


def positions(tokens: list[Token], text: str) -> list[tuple[int, int]]:
    """1-based line and column (tab stops of 8) of each token; offsets ascend."""
    out, at, line, col = [], 0, 1, 1
    for t in tokens:
        part = text[at : t.offset]
        if "\n" in part:
            line, col, part = line + part.count("\n"), 1, part[part.rfind("\n") + 1 :]
        for k, piece in enumerate(part.split("\t")):
            if k:
                col = (col - 1) // 8 * 8 + 9
            col += len(piece)
        at = max(at, t.offset)
        out.append((line, col))
    return out
