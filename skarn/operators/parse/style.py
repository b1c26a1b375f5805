"""Rules of CSS and SCSS: class and id selectors and custom properties, each occurrence a row."""

from __future__ import annotations

import re
from bisect import bisect_left

from .lexer import ParseError

_SKIP = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|url\([^)]*\)", re.S)
_SELECTOR = re.compile(r"([.#])(-?[A-Za-z_\u0080-\U0010ffff][A-Za-z0-9_\u0080-\U0010ffff-]*)")
_VARIABLE = re.compile(r"\s*(--[A-Za-z0-9_-]+)\s*:\s*([^;{}]*)")


def parse_style(text: str, scss: bool) -> list[dict]:
    """Selectors come from the text before a ``{``; declarations end with ``;`` or ``}``."""
    if text.count("/*") > len(re.findall(r"/\*.*?\*/", text, re.S)):
        raise ParseError("unterminated comment")

    def blank(m: re.Match) -> str:
        part = m.group()
        if part.startswith("//") and not scss:
            return part
        return re.sub(r"[^\n]", " ", part) if part.startswith("/") else part

    code = _SKIP.sub(blank, text)
    breaks = [m.start() for m in re.finditer("\n", code)]

    def line_of(place: int) -> int:
        return bisect_left(breaks, place) + 1

    rules: list[dict] = []
    start = depth = 0
    for m in re.finditer(r"[{};]", code):
        piece, at = code[start : m.start()], start
        if m.group() == "{":
            depth += 1
            if not piece.lstrip().startswith("@") or piece.lstrip().startswith(("@at-root", "@extend")):
                for s in _SELECTOR.finditer(re.sub(r"#\{[^}]*\}|\[[^\]]*\]", lambda x: " " * len(x.group()), piece)):
                    kind = "class" if s.group(1) == "." else "id"
                    rules.append({"selector": s.group(), "rule_type": kind, "line": line_of(at + s.start(2)), "property_name": "", "value": ""})
        else:
            if v := _VARIABLE.match(piece):
                line = line_of(at + v.start(1))
                rules.append({"selector": v.group(1), "rule_type": "variable", "line": line, "property_name": v.group(1), "value": v.group(2).strip()})
            if m.group() == "}":
                depth -= 1
                if depth < 0:
                    raise ParseError(f"line {line_of(m.start())}: unexpected }}")
        start = m.end()
    if depth:
        raise ParseError("unclosed block")
    kinds = {"class": 0, "id": 1, "variable": 2}
    return sorted(rules, key=lambda r: kinds[r["rule_type"]])
