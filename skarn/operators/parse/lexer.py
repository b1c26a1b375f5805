"""Tokens of TypeScript and JavaScript, JSX included.

Only what the structural scanner needs: names, punctuation with matched brackets,
strings, templates (their expressions between a pair of round brackets), regular
expressions, and one token for each JSX element.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class ParseError(ValueError):
    """Text that cannot be split into tokens or whose brackets don't match."""


@dataclass(slots=True)
class Token:
    kind: str  # name, number, string, punct, regex, jsx
    text: str
    line: int
    start: int
    end: int
    value: str = ""
    props: list[str] = field(default_factory=list)
    last: int = -1  # of a jsx token: the last token of the element


_NAME = re.compile(r"[A-Za-z_$\u0080-\U0010ffff#@][A-Za-z0-9_$\u0080-\U0010ffff]*")
_NUMBER = re.compile(r"(?:0[xXbBoO][0-9a-fA-F_]+|[0-9][0-9_]*(?:\.[0-9_]*)?(?:[eE][+-]?[0-9]+)?)n?|\.[0-9]+")
_PUNCT = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")
_JSX_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.:-]*")
#: Fixed list: names after which an operand follows.
_BEFORE_OPERAND = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "instanceof", "yield", "await", "default", "extends"}


class Lexer:
    def __init__(self, text: str, jsx: bool):
        self.text, self.jsx = text, jsx
        self.tokens: list[Token] = []
        self.line, self.at = 1, 0

    def run(self) -> list[Token]:
        if self.text.startswith("#!"):
            self._skip_to("\n")
        self._code(0)
        if self.at < len(self.text):
            raise ParseError(f"line {self.line}: unexpected closing bracket")
        return self.tokens

    def _fail(self, what: str, line: int):
        raise ParseError(f"line {line}: {what}")

    def _move(self, end: int) -> None:
        self.line += self.text.count("\n", self.at, end)
        self.at = end

    def _skip_to(self, mark: str) -> None:
        end = self.text.find(mark, self.at)
        self._move(len(self.text) if end < 0 else end)

    def _add(self, kind: str, end: int, value: str = "") -> Token:
        token = Token(kind, self.text[self.at : end], self.line, self.at, end, value)
        self.tokens.append(token)
        self._move(end)
        return token

    def _operand_next(self) -> bool:
        """Whether an operand, not an operator, comes next: tells a regex from a division and JSX from less-than."""
        if not self.tokens:
            return True
        last = self.tokens[-1]
        if last.kind == "name":
            return last.text in _BEFORE_OPERAND
        return last.kind == "punct" and last.text not in (")", "]", "++", "--")

    def _code(self, depth: int) -> None:
        """Tokens up to the end, or up to the bracket that closes what the caller opened."""
        text = self.text
        open_: list[tuple[str, int]] = []
        while self.at < len(text):
            c = text[self.at]
            if c in " \t\r\n﻿ ":
                self._move(self.at + 1)
            elif text.startswith("//", self.at):
                self._skip_to("\n")
            elif text.startswith("/*", self.at):
                end = text.find("*/", self.at + 2)
                if end < 0:
                    self._fail("unterminated comment", self.line)
                self._move(end + 2)
            elif c in "\"'":
                self._string(c)
            elif c == "`":
                self._template()
            elif (c.isdigit() or (c == "." and text[self.at + 1 : self.at + 2].isdigit())) and (m := _NUMBER.match(text, self.at)):
                self._add("number", m.end())
            elif c != "@" and (m := _NAME.match(text, self.at)):
                self._add("name", m.end())
            elif c == "/" and self._operand_next() and self._regex():
                pass
            elif c == "<" and self.jsx and self._operand_next() and re.match(r"<(?:[A-Za-z_$]|>)", text[self.at : self.at + 2]) and not re.match(r"<[A-Za-z_$][\w$]*\s*(?:,|extends\b)", text[self.at : self.at + 80]):
                self._element()
            elif m := _PUNCT.match(text, self.at):
                mark = m.group()
                if mark in "([{":
                    open_.append((")]}"["([{".index(mark)], self.line))
                elif mark in ")]}":
                    if not open_:
                        if depth:
                            return
                        self._fail(f"unexpected {mark}", self.line)
                    want, line = open_.pop()
                    if mark != want:
                        self._fail(f"{mark} closes a bracket of line {line}", self.line)
                self._add("punct", m.end())
            else:
                self._fail(f"unexpected character {c!r}", self.line)
        if open_:
            self._fail("unclosed bracket", open_[-1][1])
        if depth:
            self._fail("unclosed expression", self.line)

    def _string(self, quote: str) -> None:
        i, text = self.at + 1, self.text
        while i < len(text) and text[i] != quote:
            if text[i] == "\n":
                self._fail("unterminated string", self.line)
            i += 2 if text[i] == "\\" else 1
        if i >= len(text):
            self._fail("unterminated string", self.line)
        self._add("string", i + 1, text[self.at + 1 : i])

    def _template(self) -> None:
        i, text, line = self.at + 1, self.text, self.line
        while True:
            if i >= len(text):
                self._fail("unterminated template", line)
            if text[i] == "\\":
                i += 2
            elif text[i] == "`":
                self._add("string", i + 1)
                return
            elif text.startswith("${", i):
                self._add("string", i)
                self._bracketed(i + 2)
                i = self.at
            else:
                i += 1

    def _bracketed(self, start: int) -> None:
        """The expression from ``start`` to its closing brace, between round brackets."""
        self.tokens.append(Token("punct", "(", self.line, self.at, start))
        self._move(start)
        self._code(1)
        if self.text[self.at] != "}":
            self._fail("unexpected closing bracket", self.line)
        self.tokens.append(Token("punct", ")", self.line, self.at, self.at + 1))
        self._move(self.at + 1)

    def _regex(self) -> bool:
        i, text, inside = self.at + 1, self.text, False
        while i < len(text) and text[i] != "\n":
            if text[i] == "\\":
                i += 1
            elif text[i] == "[":
                inside = True
            elif text[i] == "]":
                inside = False
            elif text[i] == "/" and not inside:
                i += 1
                while i < len(text) and text[i].isalpha():
                    i += 1
                self._add("regex", i)
                return True
            i += 1
        return False

    def _blank(self) -> None:
        while self.at < len(self.text):
            if self.text[self.at].isspace():
                self._move(self.at + 1)
            elif self.text.startswith("/*", self.at):
                self._skip_to("*/")
                self._move(min(len(self.text), self.at + 2))
            else:
                return

    def _element(self) -> None:
        """One JSX element or fragment and all within it."""
        text, line = self.text, self.line
        m = _JSX_NAME.match(text, self.at + 1)
        end = m.end() if m else self.at + 1
        token = self._add("jsx", end, m.group() if m else "")
        while True:
            self._blank()
            if self.at >= len(text):
                self._fail("unterminated element", line)
            if text.startswith("/>", self.at):
                self._move(self.at + 2)
                break
            if text[self.at] == ">":
                self._move(self.at + 1)
                self._children(line)
                break
            if text[self.at] == "{":
                self._bracketed(self.at + 1)
            elif text[self.at] == "<":  # type arguments of the element
                self._skip_to(">")
                self._move(self.at + 1)
            elif name := _JSX_NAME.match(text, self.at):
                token.props.append(name.group())
                self._move(name.end())
                self._blank()
                if text[self.at : self.at + 1] == "=":
                    self._move(self.at + 1)
                    self._blank()
                    self._attribute(line)
            else:
                self._fail("unexpected character in an element", self.line)
        token.end, token.last = self.at, len(self.tokens) - 1

    def _attribute(self, line: int) -> None:
        c = self.text[self.at : self.at + 1]
        if c in ("'", '"'):
            end = self.text.find(c, self.at + 1)
            if end < 0:
                self._fail("unterminated attribute", line)
            self._move(end + 1)
        elif c == "{":
            self._bracketed(self.at + 1)
        elif c == "<":
            self._element()
        else:
            self._fail("unexpected attribute value", line)

    def _children(self, line: int) -> None:
        text = self.text
        while True:
            at = min((i for i in (text.find("<", self.at), text.find("{", self.at)) if i >= 0), default=-1)
            if at < 0:
                self._fail("unclosed element", line)
            self._move(at)
            if text.startswith("</", at):
                self._skip_to(">")
                if self.at >= len(text):
                    self._fail("unclosed element", line)
                self._move(self.at + 1)
                return
            if text[at] == "{":
                self._bracketed(at + 1)
            else:
                self._element()


def matches(tokens: list[Token]) -> list[int]:
    """For every bracket token the index of its partner; -1 elsewhere."""
    out, open_ = [-1] * len(tokens), []
    for i, t in enumerate(tokens):
        if t.kind == "punct" and t.text in "([{":
            open_.append(i)
        elif t.kind == "punct" and t.text in ")]}":
            if not open_:
                raise ParseError(f"line {t.line}: unexpected {t.text}")
            j = open_.pop()
            out[i], out[j] = j, i
    return out
