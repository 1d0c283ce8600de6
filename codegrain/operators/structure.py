"""Structure of C and C++ sources by a scanner of our own.

It knows comments, strings, directives with continued lines, and brackets, and
tells items apart by their first words and their bodies. What it finds is an
exact partition of the file, kinds and names, not a compiler's view: names are
candidates. Conditionals, namespaces and linkage blocks are transparent: what
they hold are the units, and their own text goes to the unit that follows, or to
the last one. Items above the cap are split by their parts, then by line windows.
Where brackets don't close, only the units that hold the fault fall back to line
windows. Another scanner may be passed wherever ``scan`` is taken.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from codegrain.functions.text import byte_prefix, decode, windows_of
from codegrain.operators.scope import KINDS, PROTECTED

CAP = 3000
_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//(?:\\\n|[^\n])*|/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<word>[A-Za-z_]\w*)|(?P<number>\.?\d[\w.]*)"
    r"|(?P<punct>::|->|\+\+|--|<<=|>>=|[-+*/%&|^=!<>]=|&&|\|\||<<|>>|.)",
    re.S,
)
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(\w*)((?:\\\r?\n|/\*.*?\*/|[^\n])*)", re.S)
_KEYWORDS = set("if for while switch return sizeof do else case goto break continue catch throw new delete alignof defined static_assert typeof __attribute__ __declspec".split())
_TAGS = {"struct": "struct_specifier", "union": "union_specifier", "enum": "enum_specifier", "class": "class_specifier"}
_CPP_ONLY = {"class", "namespace", "template", "typename", "public", "private", "protected", "virtual", "operator", "using", "constexpr", "nullptr"}
_TYPE_WORDS = set("int char void short long float double unsigned signed bool size_t const struct union enum auto".split())
#: Item types whose own text belongs to the units inside them.
TRANSPARENT = ("preproc_if", "preproc_ifdef", "preproc_elif", "preproc_else", "preproc_endif", "namespace_definition", "linkage_specification")
_LEAD = {"static", "const", "extern", "inline", "volatile", "register", "constexpr", "virtual", "friend"}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass
class Item:
    node_type: str
    start: int
    end: int
    tokens: list[Token]
    body: int = -1  # index of the token that opens the body
    scope: tuple[str, ...] = ()
    depth: int = 0  # of #if
    dirty: bool = False  # holds a fault

    @property
    def kind(self) -> str:
        return KINDS.get(self.node_type, "PREPROCESSOR" if self.node_type.startswith("preproc_") else "AST_BLOCK")


@dataclass
class Parsed:
    items: list[Item] = field(default_factory=list)
    errors: int = 0  # stretches that can't be read
    missing: int = 0  # brackets that aren't there
    error_spans: list[tuple[int, int]] = field(default_factory=list)


def lex(text: str) -> list[Token]:
    """Tokens without white space and comments; a directive is one token."""
    out, at, fresh = [], 0, True
    while at < len(text):
        if fresh and (m := _DIRECTIVE.match(text, at)):
            out.append(Token("directive", m[0], m.start() + len(m[0]) - len(m[0].lstrip(" \t")), m.end()))
        else:
            m = _TOKEN.match(text, at)
            if m.lastgroup not in ("space", "comment"):
                out.append(Token(m.lastgroup, m[0], *m.span()))
        fresh = "\n" in m[0][-1:] or (m.lastgroup == "space" and "\n" in m[0]) or (fresh and m.lastgroup == "comment")
        at = m.end()
    return out


def _matching(tokens: list[Token]) -> dict[int, int] | None:
    """Closing token of every opening one; None when they don't nest."""
    pairs, stack = {}, []
    close = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(tokens):
        if t.kind != "punct":
            continue
        if t.text in "([{":
            stack.append(i)
        elif t.text in close:
            if not stack or tokens[stack[-1]].text != close[t.text]:
                return None
            pairs[stack.pop()] = i
    return None if stack else pairs


def _directive(t: Token) -> str:
    name = _DIRECTIVE.match(t.text)[1]
    if name == "define":
        return "preproc_function_def" if re.match(r"[ \t]*#[ \t]*define[ \t]+\w+\(", t.text) else "preproc_def"
    return {"include": "preproc_include", "if": "preproc_if", "ifdef": "preproc_ifdef", "ifndef": "preproc_ifdef", "elif": "preproc_elif", "else": "preproc_else", "endif": "preproc_endif"}.get(name, "preproc_call")


def _regions(text: str) -> list[tuple[int, int]]:
    """Stretches that are read on their own where a file's brackets don't nest: each begins in column 0 after a blank line, a directive or a closing brace."""
    cuts, at, open_ = [0], 0, True
    for line in text.splitlines(keepends=True):
        if open_ and line[:1].strip() and line[0] not in "{}" and at:
            cuts.append(at)
        open_ = not line.strip() or line.startswith(("}", "#")) and not line.rstrip().endswith("\\")
        at += len(line)
    return [(a, b) for a, b in zip(cuts, [*cuts[1:], len(text)]) if a < b]


def scan(text: str, language: str = "cpp") -> Parsed:
    """The items of a source, those in namespaces and linkage blocks included; heads of transparent ones are items of their own.

    As ``c``, words that only C++ has are errors where they stand.
    """
    tokens = lex(text)
    pairs = _matching(tokens)
    out = Parsed()
    if pairs is not None:
        _walk(tokens, pairs, 0, len(tokens), (), out, 0)
    else:
        for a, b in _regions(text):
            own = [Token(t.kind, t.text, t.start + a, t.end + a) for t in lex(text[a:b])]
            if not own:
                continue
            pairs = _matching(own)
            if pairs is not None:
                _walk(own, pairs, 0, len(own), (), out, 0)
            else:
                out.items.append(Item(_item_type(own, -1, False), own[0].start, own[-1].end, own, dirty=True))
                out.missing += 1
                out.error_spans.append((own[0].start, own[-1].end))
    if language == "c":
        for item in out.items:
            bad = [t for t in item.tokens if t.kind == "word" and t.text in _CPP_ONLY or t.text == "::"]
            if bad:
                item.dirty = True
                out.error_spans += [(t.start, t.end) for t in bad]
    out.errors = len(out.error_spans)
    return out


def _walk(tokens: list[Token], pairs: dict[int, int], i: int, end: int, scope: tuple[str, ...], out: Parsed, depth: int) -> int:
    """Adds the items of tokens i to end; gives the depth of #if behind them."""
    while i < end:
        t = tokens[i]
        if t.kind == "directive":
            kind = _directive(t)
            if kind in ("preproc_if", "preproc_ifdef"):
                depth += 1
            out.items.append(Item(kind, t.start, t.end, [t], scope=scope, depth=depth))
            if kind == "preproc_endif":
                depth = max(0, depth - 1)
            i += 1
            continue
        if t.text in ("public", "private", "protected") and i + 1 < end and tokens[i + 1].text == ":":
            i += 2
            continue
        words = [x.text for x in tokens[i : i + 4]]
        block = None
        if words[:1] == ["namespace"] or words[:1] == ["extern"] and len(words) > 2 and tokens[i + 1].kind == "string" and words[2] == "{":
            block = next((j for j in range(i, min(end, i + 12)) if tokens[j].text == "{"), None)
        if block is not None:
            name = "".join(x.text for x in tokens[i + 1 : block] if x.kind == "word" or x.text == "::") if words[0] == "namespace" else ""
            out.items.append(Item("namespace_definition" if words[0] == "namespace" else "linkage_specification", t.start, tokens[block].end, tokens[i : block + 1], scope=scope, depth=depth))
            depth = _walk(tokens, pairs, block + 1, pairs[block], scope + ((name,) if name else ()), out, depth)
            i = pairs[block] + 1
            if i < end and tokens[i].text == ";":
                i += 1
            continue
        j, body, assigned = i, -1, False
        while j < end:
            x = tokens[j]
            if x.kind == "directive" and body < 0 and j > i:
                break
            if x.kind == "punct" and x.text in "([":
                j = pairs[j]
            elif x.text == "=" and x.kind == "punct":
                assigned = True
            elif x.text == "{" and x.kind == "punct":
                body = j if body < 0 else body
                j = pairs[j]
                if not assigned and _is_function(tokens, i, body):
                    break
            elif x.text == ";" and x.kind == "punct":
                break
            j += 1
        stop = min(j, end - 1)
        if tokens[stop].kind == "directive" and stop > i:
            stop -= 1
        own = tokens[i : stop + 1]
        out.items.append(Item(_item_type(own, body - i if body >= 0 else -1, assigned), t.start, tokens[stop].end, own, body - i if body >= 0 else -1, scope, depth))
        i = stop + 1
    return depth


def members(item: Item, scope: tuple[str, ...]) -> list[Item]:
    """The items in the body of a class or struct."""
    if item.body < 0:
        return []
    pairs = _matching(item.tokens)
    out = Parsed()
    if pairs is not None:
        _walk(item.tokens, pairs, item.body + 1, pairs[item.body], scope, out, item.depth)
    return out.items


def parts(tokens: list[Token], pairs: dict[int, int], i: int, end: int) -> list[tuple[int, int]]:
    """What a stretch of tokens falls into (first and last token): the statements or entries of a block, else its blocks and what is between."""
    if i < end and tokens[i].text == "{" and pairs.get(i) == end - 1:
        inside = range(i + 1, end - 1)
        marks = {t.text for t in _shallow(tokens, pairs, inside)}
        stop = ";" if ";" in marks or "{" in marks else ","
        out, at, j = [], i + 1, i + 1
        while j < end - 1:
            t = tokens[j]
            if t.kind == "directive":
                if at < j:
                    out.append((at, j - 1))
                out.append((j, j))
                at = j + 1
            elif t.kind == "punct" and t.text in "([{":
                j = pairs[j]
                goes = j + 1 < end - 1 and tokens[j + 1].text in ("else", "while", ";", ",", ")", "=")
                if t.text == "{" and not goes and stop == ";":
                    out.append((at, j))
                    at = j + 1
            elif t.text == stop:
                out.append((at, j))
                at = j + 1
            j += 1
        if at < end - 1:
            out.append((at, end - 2))
        return out
    out, at, j = [], i, i
    while j < end:
        if tokens[j].text == "{" and tokens[j].kind == "punct":
            if at < j:
                out.append((at, j - 1))
            out.append((j, pairs[j]))
            j = pairs[j]
            at = j + 1
        elif tokens[j].kind == "punct" and tokens[j].text in "([":
            j = pairs[j]
        j += 1
    if at < end and out:
        out.append((at, end - 1))
    return out


def _shallow(tokens: list[Token], pairs: dict[int, int], inside: range) -> Iterator[Token]:
    j = inside.start
    while j < inside.stop:
        yield tokens[j]
        j = pairs.get(j, j) + 1


def _is_function(tokens: list[Token], i: int, body: int) -> bool:
    head = [x.text for x in tokens[i:body]]
    lead = [w for w in head if w not in _LEAD]
    if lead and lead[0] in ("template", "typedef"):
        return "(" in head and not any(w in _TAGS for w in _after_template(head)[:2])
    return ")" in head and not (lead and lead[0] in _TAGS and "(" not in head)


def _after_template(head: list[str]) -> list[str]:
    depth = 0
    for k, w in enumerate(head[1:], 1):
        depth += (w == "<") - (w == ">") - 2 * (w == ">>")
        if depth <= 0 and k > 1:
            return head[k + 1 :]
    return head


def _item_type(own: list[Token], body: int, assigned: bool) -> str:
    words = [x.text for x in own if x.text not in _LEAD]
    if not words:
        return "declaration"
    if words[0] == "template":
        return "template_declaration"
    if words[0] == "typedef":
        return "type_definition"
    head = [x.text for x in own[:body]] if body >= 0 else []
    if body >= 0 and not assigned and ")" in head and own[-1].text == "}":
        return "function_definition"
    if words[0] in _TAGS and ("{" in words or len(words) <= 3):
        return _TAGS[words[0]]
    return "declaration" if own[-1].text == ";" else "expression_statement"


def grammar(text: str, extension: str, scan=scan) -> tuple[str, Parsed, list[dict]]:
    """(language, what it reads, attempts): C++ for .cpp, C for .c, and for .h the one with the least score, C of equals.

    A score is (bytes that can't be read, brackets missing, errors, order of trial).
    """
    tried = []
    for order, language in enumerate({".cpp": ["cpp"], ".h": ["c", "cpp"]}.get(extension, ["c"])):
        parsed = scan(text, language)
        covered, behind = 0, -1
        for a, b in sorted(parsed.error_spans):
            covered += max(0, len(text[max(a, behind) : b].encode()))
            behind = max(behind, b)
        tried.append(([covered, parsed.missing, parsed.errors, order], language, parsed))
    score, language, parsed = min(tried, key=lambda x: x[0])
    return language, parsed, [{"grammar": lang, "status": "OK", "score": s} for s, lang, _ in tried]


def _windows(text: str, byte: int, cap: int, kind: str, item: Item, mode: str, unit: tuple[int, int]) -> list[dict]:
    return [
        {"start": byte + a, "end": byte + b, "kind": kind, "parent": item.kind, "node_type": item.node_type, "kinds": list(dict.fromkeys((item.kind, kind))), "split_mode": mode, "unit": unit, "unit_kind": item.kind}
        for a, b, _, _ in windows_of(text, cap)
    ]


def _split(text: str, at: int, end: int, byte: int, item: Item, pairs: dict[int, int], first: int, last: int, cap: int, unit: tuple[int, int], whole: bool) -> list[dict]:
    """Spans of the characters at to end, which tokens first to last of an item stand in."""
    part = text[at:end]
    size = len(part.encode())
    if size <= cap:
        kind = item.kind if whole else "AST_BLOCK"
        mode = "STRUCTURAL" if whole else "AST_CHILD"
        return [{"start": byte, "end": byte + size, "kind": kind, "parent": item.kind, "node_type": item.node_type, "kinds": list(dict.fromkeys((item.kind, kind))), "split_mode": mode, "unit": unit, "unit_kind": item.kind}]
    found = parts(item.tokens, pairs, first, last + 1)
    if len(found) < 2:
        return _windows(part, byte, cap, "AST_BLOCK", item, "HARD_WINDOW", unit)
    out = []
    for n, (a, b) in enumerate(found):
        stop = end if n == len(found) - 1 else item.tokens[b].end
        out += _split(text, at, stop, byte, item, pairs, a, b, cap, unit, False)
        byte += len(text[at:stop].encode())
        at = stop
    return out


def parse(text: str, extension: str = ".cpp", cap: int = CAP, scan=scan) -> dict:
    """outcome, language, fallback_reason, attempts and spans of a source: an exact partition of its bytes."""
    if not text:
        return {"outcome": "FALLBACK_SUCCESS", "language": "cpp" if extension == ".cpp" else "c", "fallback_reason": "empty_blob", "attempts": [], "spans": []}
    language, parsed, attempts = grammar(text, extension, scan)
    faulty = bool(parsed.errors or parsed.missing)
    units = [x for x in parsed.items if x.node_type not in TRANSPARENT] or parsed.items[:1]
    if not units:
        found = [{"start": a, "end": b, "kind": "LINE_WINDOW", "parent": "LINE_WINDOW", "node_type": "line_window", "kinds": ["LINE_WINDOW"], "split_mode": "FALLBACK", "unit": (a, b), "unit_kind": "LINE_WINDOW"} for a, b, _, _ in windows_of(text, cap)]
        return {"outcome": "FALLBACK_SUCCESS", "language": language, "fallback_reason": "no_structural_nodes", "attempts": attempts, "spans": found}
    out: list[dict] = []
    at, byte = 0, 0
    for n, item in enumerate(units):
        end = len(text) if n == len(units) - 1 else item.end
        size = len(text[at:end].encode())
        unit = (byte, byte + size)
        if item.dirty:
            out += _windows(text[at:end], byte, cap, "LINE_WINDOW", item, "DIAGNOSTIC_FALLBACK", unit)
        else:
            out += _split(text, at, end, byte, item, _matching(item.tokens) or {}, 0, len(item.tokens) - 1, cap, unit, True)
        at, byte = end, byte + size
    return {"outcome": "FALLBACK_SUCCESS" if faulty else "PARSE_SUCCESS", "language": language, "fallback_reason": "syntax_error_or_missing_node" if faulty else None, "attempts": attempts, "spans": merged(out, cap)}


def merged(spans: list[dict], cap: int) -> list[dict]:
    """Neighbours joined while they fit: spans of one unit with each other, others if none of them is of a protected kind."""
    out: list[dict] = []
    for s in spans:
        last = out[-1] if out else None
        if last and last["end"] == s["start"] and s["end"] - last["start"] <= cap:
            same = (last["unit"], last["unit_kind"]) == (s["unit"], s["unit_kind"])
            if same or not (set(last["kinds"]) | set(s["kinds"])) & set(PROTECTED):
                joined = {"end": s["end"], "kinds": list(dict.fromkeys(last["kinds"] + s["kinds"]))}
                if same:
                    joined |= {"kind": "AST_BLOCK", "node_type": "structural_unit_fragment_group", "parent": last["unit_kind"], "split_mode": "COALESCED_WITHIN_UNIT"}
                else:
                    joined |= {"kind": "STRUCTURAL_GROUP", "node_type": "translation_unit_group", "parent": "STRUCTURAL_GROUP", "split_mode": "COALESCED_UNPROTECTED", "unit": (last["unit"][0], s["unit"][1]), "unit_kind": "STRUCTURAL_GROUP"}
                out[-1] = last | joined
                continue
        out.append(s)
    return out


def spans(text: str, cap: int = CAP, scan=scan) -> tuple[str, list[dict]]:
    """(outcome, spans) of a source read as C++."""
    found = parse(text, ".cpp", cap, scan)
    return found["outcome"], found["spans"]


# ---------------------------------------------------------------- names


def _collapsed(text: str, cap: int) -> tuple[str, bool]:
    full = " ".join(text.split())
    cut = byte_prefix(full, cap)
    return cut, cut != full


def _declared(tokens: list[Token]) -> list[tuple[str, str, int]]:
    """Names of a declaration: (name, kind, token index), one for each declarator."""
    out, depth, fresh = [], 0, None
    for k, t in enumerate(tokens):
        if t.kind == "punct" and t.text in "([{":
            if depth == 0 and t.text == "(" and fresh is not None:
                pointer = k + 1 < len(tokens) and tokens[k + 1].text == "*"
                if pointer:
                    name = next((x for x in tokens[k + 2 : k + 5] if x.kind == "word"), None)
                    if name:
                        out.append((name.text, "GLOBAL_VARIABLE", k))
                else:
                    out.append((tokens[fresh].text, "FUNCTION", fresh))
                fresh = None
                depth += 1
                # the rest up to the comma or the end belongs to this declarator
                continue
            depth += 1
        elif t.kind == "punct" and t.text in ")]}":
            depth -= 1
        elif depth == 0 and t.kind == "word" and t.text not in _LEAD:
            fresh = k
        elif depth == 0 and t.text in (",", ";", "="):
            if fresh is not None and fresh > 0:
                out.append((tokens[fresh].text, "GLOBAL_VARIABLE", fresh))
            fresh = None
            if t.text == "=":
                depth = -10_000  # what follows is a value, up to the end
        if depth < -5000 and t.text == ",":
            depth = 0
    return out


def _function_name(tokens: list[Token], body: int) -> tuple[str, str, int]:
    """(plain name, qualified as written, index of the parameter list)."""
    for k in range(body):
        if tokens[k].text == "operator":
            stop = next((j for j in range(k + 2, body) if tokens[j].text == "(" and not (j == k + 2 and tokens[k + 1].text == "(")), -1)
            j = k
            while j >= 2 and tokens[j - 1].text == "::" and tokens[j - 2].kind == "word":
                j -= 2
            name = "".join(x.text for x in tokens[k:stop])
            return name, "".join(x.text for x in tokens[j:k]) + name, stop
        if tokens[k].text == "(" and k and tokens[k - 1].kind == "word" and tokens[k - 1].text not in ("__attribute__", "__declspec"):
            j = k - 1
            while j >= 2 and tokens[j - 1].text == "::" and tokens[j - 2].kind == "word":
                j -= 2
            return tokens[k - 1].text, "".join(x.text for x in tokens[j:k]), k
    return "", "", -1


_FACT_WORDS = {"for": "loops", "while": "loops", "do": "loops", "if": "conditions", "switch": "conditions", "return": "returns", "goto": "gotos", "sizeof": "sizeof_expressions"}
_FACT_MARKS = {"?": "conditions", "[": "array_accesses", ".": "field_accesses", "->": "field_accesses", "++": "updates", "--": "updates"}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="}
FACTS = ("array_accesses", "assignments", "calls", "casts", "conditions", "field_accesses", "gotos", "loops", "pointer_operations", "returns", "sizeof_expressions", "updates")


def _cast(tokens: list[Token], k: int) -> bool:
    """Whether the parenthesis at k begins a cast: a type alone in it, and an operand behind."""
    before = tokens[k - 1] if k else None
    if before and (before.kind in ("word", "number") and before.text not in ("return", "case", "else", "do") or before.text in (")", "]")):
        return False
    j = k + 1
    while j < len(tokens) and (tokens[j].kind == "word" or tokens[j].text in ("*", "::", "&")):
        j += 1
    inside = tokens[k + 1 : j]
    if j + 1 >= len(tokens) or tokens[j].text != ")" or not inside or inside[0].kind != "word":
        return False
    after = tokens[j + 1]
    typed = any(t.text in _TYPE_WORDS or t.text.endswith("_t") for t in inside) or inside[-1].text == "*"
    return after.kind in ("word", "number", "string") or typed and after.text in ("(", "*", "&", "-", "~", "!", "+")


def body_facts(tokens: list[Token]) -> tuple[list[dict], list[tuple[int, str]]]:
    """Calls in a function's body, and (place, counter) of everything that is counted."""
    calls, facts = [], []
    for k, t in enumerate(tokens):
        before, after = tokens[k - 1] if k else None, tokens[k + 1] if k + 1 < len(tokens) else None
        if t.kind == "word":
            if t.text == "while" and before and before.text == "}" and _closes_do(tokens, k):
                continue
            if t.text in _FACT_WORDS:
                facts.append((t.start, _FACT_WORDS[t.text]))
            elif after and after.text == "(" and t.text not in _KEYWORDS:
                j = k
                while j >= 2 and tokens[j - 1].text in ("::", ".", "->") and tokens[j - 2].kind == "word":
                    j -= 2
                kind = "DIRECT_IDENTIFIER" if j == k and not (before and before.text in (".", "->", "::")) else "QUALIFIED" if before.text == "::" else "MEMBER"
                # "type name(" in a body declares; a word before the name that isn't a keyword tells it.
                if not (before and before.kind == "word" and before.text not in _KEYWORDS):
                    calls.append({"name": t.text, "expression": byte_prefix("".join(x.text for x in tokens[j : k + 1]), 256), "kind": kind, "start": tokens[j].start, "end": t.end})
                    facts.append((tokens[j].start, "calls"))
        elif t.kind == "punct":
            if t.text in _FACT_MARKS:
                facts.append((t.start, _FACT_MARKS[t.text]))
            elif t.text in _ASSIGN:
                facts.append((t.start, "assignments"))
            elif t.text in "*&" and (before is None or before.kind == "punct" and before.text not in (")", "]") or before.text in _KEYWORDS):
                facts.append((t.start, "pointer_operations"))
            elif t.text == "(":
                if before and before.text == ")":
                    open_ = next((j for j in range(k - 1, -1, -1) if tokens[j].text == "("), None)
                    if open_ is not None and open_ + 1 < k and tokens[open_ + 1].text == "*":
                        calls.append({"name": None, "expression": byte_prefix("".join(x.text for x in tokens[open_:k]), 256), "kind": "INDIRECT", "start": tokens[open_].start, "end": tokens[k - 1].end})
                        facts.append((tokens[open_].start, "calls"))
                elif _cast(tokens, k):
                    facts.append((t.start, "casts"))
    return calls, facts


def _closes_do(tokens: list[Token], k: int) -> bool:
    """Whether the word at k, after a closing brace, ends a do loop."""
    depth = 0
    for j in range(k - 1, -1, -1):
        depth += (tokens[j].text == "}") - (tokens[j].text == "{") if tokens[j].kind == "punct" else 0
        if depth == 0:
            return j > 0 and tokens[j - 1].text == "do"
    return False


def _types(item: Item) -> Iterator[tuple[str, str, str, int, int]]:
    """(kind, name, role, start, end) of the tagged types that an item names, wherever they stand; an anonymous one has its last name."""
    toks, pairs = item.tokens, _matching(item.tokens) or {}
    angle = 0  # of template parameters, where class isn't a type
    for k, t in enumerate(toks):
        if t.text == "template" and k + 1 < len(toks) and toks[k + 1].text == "<":
            angle = k + 1
            depth = 0
            for j in range(k + 1, len(toks)):
                depth += (toks[j].text == "<") - (toks[j].text == ">") - 2 * (toks[j].text == ">>")
                if depth <= 0:
                    angle = j
                    break
        if t.kind != "word" or t.text not in _TAGS or k < angle or k and toks[k - 1].text == "enum":
            continue
        at = k + 1 + (toks[k + 1].text == "class" if t.text == "enum" and k + 1 < len(toks) else 0)
        named = at < len(toks) and toks[at].kind == "word"
        j = at + named
        if named and j < len(toks) and toks[j].text == "::":
            while j + 1 < len(toks) and toks[j].text == "::":
                at, j = j + 1, j + 2
        if j < len(toks) and toks[j].text in (":", "final"):
            j = next((x for x in range(j, len(toks)) if toks[x].text in ("{", ";", ")")), j)
        body = j if j < len(toks) and toks[j].text == "{" and toks[j].kind == "punct" else -1
        if named or body >= 0:
            last = pairs.get(body, body) if body >= 0 else j - 1
            name = toks[at].text if named else next((x.text for x in reversed(toks[k:last]) if x.kind == "word"), "")
            if name:
                yield _TAGS[t.text].split("_")[0].upper(), name, "DEFINITION" if body >= 0 else "DECLARATION", t.start, toks[min(last, len(toks) - 1)].end


def extract(text: str, scan=scan) -> dict[str, list[dict]]:
    """symbols, calls, includes and facts of a source, with character places; nothing from what can't be read."""
    symbols, calls, includes, facts = [], [], [], []

    def add(item, name, qualified, kind, role, start, end, **more):
        signature, cut = _collapsed(more.pop("signature", text[start:end]), 256)
        symbols.append({"name": name, "qualified_name": "::".join([*item.scope, qualified]), "symbol_kind": kind, "role": role, "signature": signature, "signature_truncated": cut, "conditional_depth": item.depth, "start": start, "end": end, **more})

    def visit(item: Item) -> None:
        toks = item.tokens
        words = [t.text for t in toks]
        linkage = "INTERNAL" if "static" in words[:4] else "EXTERNAL"
        if item.dirty:
            return
        if item.node_type == "preproc_include":
            spelling = re.sub(r"/\*.*?\*/|//.*", "", re.sub(r"^\s*#\s*include", "", toks[0].text), flags=re.S).strip()
            includes.append({"spelling": spelling, "target": spelling.strip('<>"'), "conditional_depth": item.depth, "start": item.start, "end": item.end})
            return
        if item.node_type in ("preproc_def", "preproc_function_def"):
            m = re.match(r"#[ \t]*define[ \t]+(\w+)(\(([^)]*)\))?", toks[0].text)
            if m:
                params = [p.strip() for p in m[3].split(",")] if m[3] else []
                add(item, m[1], m[1], "MACRO", "DEFINITION", item.start, item.end, parameters=[byte_prefix(p, 192) for p in params if p], linkage="EXTERNAL")
            return
        if item.node_type == "namespace_definition":
            name = "".join(t.text for t in toks[1:] if t.kind == "word" or t.text == "::")
            add(item, name, name, "NAMESPACE", "DEFINITION", item.start, item.end, linkage="EXTERNAL", parameters=[])
            return
        typed = list(_types(item))
        for kind, name, role, start, end in typed:
            add(item, name, name, kind, role, start, end, linkage="EXTERNAL", parameters=[])
        if item.node_type == "function_definition" or item.node_type == "template_declaration" and item.body >= 0 and ")" in words[: item.body] and not any(w in _TAGS for w in _after_template(words)[:1]):
            name, qualified, at = _function_name(toks, item.body)
            if not name:
                return
            depth, params, current = 0, [], []
            for t in toks[at + 1 : item.body]:
                if t.text == ")" and depth == 0:
                    break
                depth += (t.text in "([{") - (t.text in ")]}") if t.kind == "punct" else 0
                if t.text == "," and depth == 0:
                    params.append(" ".join(current))
                    current = []
                else:
                    current.append(t.text)
            params = [byte_prefix(p, 192) for p in [*params, " ".join(current)] if p and p != "void"]
            if len(qualified.encode()) > 256:
                qualified = name
            add(item, name, qualified, "FUNCTION", "DEFINITION", item.start, item.end, signature=text[item.start : toks[item.body].start], parameters=params, linkage=linkage)
            found, counted = body_facts(toks[item.body + 1 : -1])
            symbols[-1]["facts"] = dict.fromkeys(FACTS, 0) | Counter(name for _, name in counted)
            calls.extend({**c, "caller": symbols[-1]["qualified_name"], "caller_start": item.start, "conditional_depth": item.depth} for c in found)
            facts.extend({"fact": name, "start": at} for at, name in counted)
        elif item.body >= 0 and any(w in ("class", "struct", "union") for w in words[: item.body]):
            outer = next((n for k, n, r, _, _ in typed if r == "DEFINITION"), "")
            own = item.scope + ((outer,) if "class" in words[: item.body] and outer else ())
            done = {(s["start"], s["symbol_kind"]) for s in symbols}
            for x in members(item, own):
                if x.node_type in ("function_definition", "template_declaration") or x.body >= 0:
                    before = len(symbols)
                    visit(x)
                    # Types inside were named above already; here they get the scope.
                    symbols[before:] = [s for s in symbols[before:] if (s["start"], s["symbol_kind"]) not in done]
        if item.node_type == "type_definition":
            last = [t for t in toks if t.kind == "word"]
            pointer = re.search(r"\(\s*\*\s*(\w+)\s*\)", text[item.start : item.end])
            name = pointer[1] if pointer else last[-1].text if last else ""
            add(item, name, name, "TYPEDEF", "DEFINITION", item.start, item.end, linkage="EXTERNAL", parameters=[])
        elif item.node_type == "declaration":
            seen = set()
            for name, kind, at in _declared(toks):
                if (name, toks[at].start) not in seen:
                    seen.add((name, toks[at].start))
                    add(item, name, name, kind, "DECLARATION", item.start, item.end, linkage=linkage, parameters=[])

    for item in scan(text).items:
        visit(item)
    return {"symbols": symbols, "calls": calls, "includes": includes, "facts": facts}


def chunk_files(files: DataFrame, path: str = "path", raw: str = "raw", cap: int = CAP) -> DataFrame:
    """A row for each span of each file (path, bytes), and one with a null ordinal for files without any: how it was read, place, kinds, and its lines.

    Lines count from 1 and columns in bytes from 0, as the bytes have them;
    end_line is that of the last byte, end_point_line that of the place behind it.
    """
    columns = [f.split()[0] for f in _CHUNKS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, data in zip(pdf[path], pdf[raw]):
                data = None if data is None else bytes(data)
                text, encoding, error = decode(data)
                extension = re.search(r"(\.[^./]*)?$", p)[0]
                if error:
                    rows.append((p, "TERMINAL_ERROR", error, None, encoding, None, None, *[None] * 19))
                    continue
                if encoding == "utf-8":
                    got = parse(text, extension, cap)
                else:  # windows of the text as decoded, at places of the bytes
                    found = []
                    for a, b, c, d in windows_of(text, cap):
                        found.append({"start": c, "end": d, "kind": "LINE_WINDOW", "parent": "LINE_WINDOW", "node_type": "line_window", "kinds": ["LINE_WINDOW"], "split_mode": "FALLBACK", "unit": (c, d), "unit_kind": "LINE_WINDOW"})
                    got = {"outcome": "FALLBACK_SUCCESS", "language": "cpp" if extension == ".cpp" else "c", "fallback_reason": "non_utf8_source", "attempts": [], "spans": found}
                head = (p, got["outcome"], got["fallback_reason"], got["language"], encoding, json.dumps(got["attempts"]), len(data))
                if not got["spans"]:
                    rows.append((*head, *[None] * 19))
                breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
                point = lambda at: (int(np.searchsorted(breaks, at)) + 1, int(at - (breaks[i - 1] + 1 if (i := np.searchsorted(breaks, at)) else 0)))
                for i, s in enumerate(got["spans"]):
                    start, end = point(s["start"]), point(s["end"])
                    content = data[s["start"] : s["end"]]
                    rendered = content.decode(encoding)
                    rows.append((*head, i, s["start"], s["end"], s["kind"], s["parent"], s["node_type"], s["kinds"], s["split_mode"], *s["unit"], s["unit_kind"], *start, point(s["end"] - 1)[0], *end, hashlib.sha256(content).hexdigest(), rendered, len(rendered.encode())))
            yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in columns if f"{c} long" in _CHUNKS})

    return files.select(path, raw).mapInPandas(run, _CHUNKS)


_CHUNKS = (
    "path string, outcome string, fallback_reason string, language string, encoding string, attempts string, file_bytes long, ordinal long, start_byte long, end_byte long, kind string, parent_kind string, "
    "node_type string, kinds array<string>, split_mode string, unit_start_byte long, unit_end_byte long, unit_kind string, start_line long, start_column long, end_line long, end_point_line long, end_column long, "
    "raw_sha256 string, content string, content_bytes long"
)
_EXTRACTED = (
    "path string, tag string, name string, qualified_name string, kind string, role string, linkage string, caller string, caller_start_byte long, expression string, parameters array<string>, "
    "conditional_depth long, start_byte long, end_byte long, facts string"
)


def extract_files(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One tagged stream of symbols, calls, includes and facts, with places in bytes; ``facts`` of a function's body as JSON. Files without a text give nothing."""
    columns = [f.split()[0] for f in _EXTRACTED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, t in zip(pdf[path], pdf[text]):
                t = t or ""
                got = extract(t)
                codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
                width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
                byte = np.concatenate([[0], np.cumsum(width)])
                at = lambda x: (int(byte[x["start"]]), int(byte[x["end"]]) if "end" in x else None)
                rows += [(p, "symbol", s["name"], s["qualified_name"], s["symbol_kind"], s["role"], s["linkage"], None, None, s["signature"], s["parameters"], s["conditional_depth"], *at(s), json.dumps(s["facts"]) if "facts" in s else None) for s in got["symbols"]]
                rows += [(p, "call", c["name"], None, c["kind"], None, None, c["caller"], int(byte[c["caller_start"]]), c["expression"], None, c["conditional_depth"], *at(c), None) for c in got["calls"]]
                rows += [(p, "include", i["target"], None, None, None, None, None, None, i["spelling"], None, i["conditional_depth"], *at(i), None) for i in got["includes"]]
                rows += [(p, "fact", f["fact"], None, None, None, None, None, None, None, None, None, *at(f), None) for f in got["facts"]]
            yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in columns if f"{c} long" in _EXTRACTED})

    return files.select(path, text).mapInPandas(run, _EXTRACTED)
