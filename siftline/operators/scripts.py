"""Declarations, members, imports and re-exports of script files by one linear scan.

Not a parser: comments, strings, templates and regular expressions are blanked, brackets
are paired, and statements are recognised by the words they begin with at the top level of
a file or of a class, interface or enum. Bodies are not looked into.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

BLANKED = re.compile(
    r"//[^\n\r]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|(?<=[(=,:!&|?;{}])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/", re.S
)
NAME = r"[A-Za-z_$][\w$]*"
DECLARATION = re.compile(rf"^[ \t]*(?P<export>export\s+(?:default\s+)?)?(?:declare\s+)?(?:async\s+|abstract\s+)?(?:const\s+(?=enum\b))?(?P<kind>function|class|interface|type|enum|const|let|var)\b\s*\*?\s*(?P<name>{NAME})", re.M)
MEMBER = re.compile(rf"(?:^|(?<=[;{{}}]))\s*(?:(?:public|private|protected|static|async|readonly|override|abstract|declare|get|set)\s+)*\*?\s*(?P<name>#?{NAME})\s*[?!]?\s*(?P<next>[(<:=;]|$)", re.M)
IMPORT = re.compile(r"^[ \t]*(?P<word>import|export)\b(?P<what>[^;'\"()]*?)(?:\bfrom\s*)?(?P<quote>['\"])(?P<inside>[^'\"]*)['\"]", re.M)
MEMBERED = ("class", "interface")
#: What may end a statement; white space with a line end counts once, however long it is.
STATEMENT_END = re.compile(r"[;}]|(?<!\s)\s*?(?P<line>\n)\s*|\Z")


def blanked(content: str) -> str:
    """content with the inside of comments, strings and regular expressions as blanks; quotes and line ends stay."""

    def blank(m: re.Match) -> str:
        empty = re.sub(r"[^\r\n]", " ", m[0])
        return m[0][0] + empty[1:-1] + m[0][-1] if m[0][0] in "'\"" else empty

    return BLANKED.sub(blank, content)


class Brackets:
    """Pairs of brackets and the depth of every place."""

    def __init__(self, code: str) -> None:
        self.code = code
        self.closing: dict[int, int] = {}
        self.at, self.depths, held = [-1], [0], []
        for m in re.finditer(r"[(){}\[\]]", code):
            if m[0] in "({[":
                held.append(m.start())
            elif held:
                self.closing[held.pop()] = m.start()
            self.at.append(m.start())
            self.depths.append(len(held))

    def generic_call(self, place: int) -> bool:
        """Whether what begins at a place, up to the next round bracket, ends with ">" and that bracket opens."""
        for k in range(bisect.bisect_left(self.at, place), len(self.at)):
            at = self.at[k]
            if self.code[at] in "()":
                return self.code[at] == "(" and _last(self.code, at) == ">"
        return False

    def depth(self, place: int) -> int:
        """How many brackets are open before a place."""
        return self.depths[bisect.bisect_left(self.at, place) - 1] if place > 0 else 0


def _last(code: str, end: int) -> str:
    """The last character before a place that is no white space, or nothing."""
    while end and code[end - 1].isspace():
        end -= 1
    return code[end - 1 : end]


def _body(code: str, pairs: Brackets, at: int, depth: int) -> tuple[int | None, int]:
    """(place of the opening brace, end) of what begins before at: its body, or up to the statement's end."""
    for m in re.compile(r"[{;]").finditer(code, at):
        if pairs.depth(m.start()) != depth:
            if pairs.depth(m.start()) < depth:
                return None, m.start()
            continue
        if m[0] == ";":
            return None, m.start() + 1
        if _last(code, m.start()) not in (":", "|", "&"):  # else the brace of a type
            return m.start(), pairs.closing.get(m.start(), len(code) - 1) + 1
    return None, len(code)


def _statement(code: str, pairs: Brackets, at: int, depth: int) -> int:
    """End of a statement without a body: a semicolon, or a line end where neither side goes on."""
    for m in STATEMENT_END.finditer(code, at):
        if pairs.depth(m.start()) > depth:
            continue
        if m[0] == ";":
            return m.start() + 1
        if m[0] in ("", "}"):
            if m[0] == "" or pairs.depth(m.start() + 1) < depth:
                return m.start()
        elif m.start() > at and code[m.start() - 1] not in "=,|&+-?:<(" and code[m.end() : m.end() + 1] not in ("|", "&", ".", "?", ":", "="):
            return m.start("line")
    return len(code)


def declarations(content: str) -> Iterator[tuple[str, str, str, int, int, bool]]:
    """kind, name, qualified name, start, end (character places), exported."""
    code = blanked(content)
    pairs = Brackets(code)
    for m in DECLARATION.finditer(code):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        if pairs.depth(start):
            continue
        kind = {"const": "variable", "let": "variable", "var": "variable"}.get(m["kind"], m["kind"])
        opened, end = (None, _statement(code, pairs, m.end(), 0)) if kind in ("variable", "type") else _body(code, pairs, m.end(), 0)
        yield kind, m["name"], m["name"], start, end, bool(m["export"])
        if opened is None or kind not in MEMBERED:
            continue
        at = opened + 1
        while at < end - 1 and (n := MEMBER.search(code, at, end - 1)):
            first = n.start() + len(n[0]) - len(n[0].lstrip())
            if pairs.depth(n.start("name")) != 1:
                at = n.end()
                continue
            called = n["next"] == "(" or (n["next"] == "<" and pairs.generic_call(n.start("next")))
            stop = _body(code, pairs, n.start("next"), 1)[1] if called and kind == "class" else _statement(code, pairs, n.end("name"), 1)
            stop = min(stop, end - 1)
            yield "method" if called else "property", n["name"], f"{m['name']}.{n['name']}", first, stop, False
            at = max(stop, n.end("name"))


def imports(content: str) -> Iterator[tuple[str, str, str | None, str | None, int]]:
    """kind (imports or exports), specifier, local name, imported name ("*" for all) and place; names are null where nothing is bound."""
    code = blanked(content)
    pairs = Brackets(code)
    for m in IMPORT.finditer(code):
        if pairs.depth(m.start("word")):
            continue
        kind, what = m["word"] + "s", re.sub(r"^\s*type\b(?!\s*(?:,|from\b|$))", "", m["what"]).strip()
        specifier = content[m.start("inside") : m.end("inside")]
        if kind == "exports" and not re.match(r"[*{]", what):
            continue  # export const x = '...'
        whole, _, listed = what.partition("{")
        found = [(b, "*") for b in re.findall(rf"\*\s*as\s+({NAME})", whole)]
        found += [(None, "*")] if re.match(r"\*\s*$", whole) else []
        found += [(x, "default") for x in re.findall(rf"^({NAME})\s*(?:,|$)", whole.strip())]
        for item in listed.rstrip("} \n\r\t").split(","):
            words = re.sub(r"^\s*type\s+(?!as\b|$)", "", item).split()
            if words:
                found.append((words[-1], words[0]))
        for local, imported in found or [(None, None)]:
            yield kind, specifier, local, imported, m.start("word")
