"""Structure of TypeScript and JavaScript token streams.

One scan collects declarations (functions, methods, arrow and function expressions
bound to names, classes, interfaces, type aliases, variables, imports) with their token
spans; calls, type usages and elements are then placed by the innermost named span
around them.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from .lexer import Lexer, Token, matches

#: Fixed word lists of the language.
CALL_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "typeof", "function", "super", "import", "new", "await", "yield", "in", "of", "instanceof", "void", "delete", "throw", "case", "do", "else", "with", "async", "constructor"}
BUILT_IN_TYPES = {"string", "number", "boolean", "void", "any", "unknown", "never", "object", "null", "undefined", "symbol", "bigint", "this", "true", "false"}
MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async", "get", "set", "accessor"}
TYPE_OPERATORS = {"keyof", "typeof", "infer", "readonly", "unique", "is", "asserts", "extends", "in", "new", "as", "import"}


@dataclass
class Span:
    kind: str  # function, class, interface, type
    name: str
    first: int
    last: int


class Script:
    def __init__(self, text: str, typed: bool, jsx: bool):
        self.text, self.typed = text, typed
        self.tokens: list[Token] = Lexer(text, jsx).run()
        self.match = matches(self.tokens)
        self.n = len(self.tokens)
        self.spans: list[Span] = []
        self._nested: dict[tuple[str, ...], tuple] = {}
        self.declared: set[int] = set()  # name tokens of definitions: not calls
        self.functions: list[tuple[int, int, dict]] = []  # (pass, position, record)
        self.out: dict[str, list[dict]] = {k: [] for k in ("imports", "variables", "types", "interfaces", "classes", "constants", "jsx_elements", "function_calls", "type_usages", "extends", "implements", "references")}
        self.annotations: list[tuple[int, int, str]] = []  # (first token, end, context)

    # Small helpers -------------------------------------------------------------------

    def _is(self, i: int, *texts: str) -> bool:
        return 0 <= i < self.n and self.tokens[i].kind in ("punct", "name") and self.tokens[i].text in texts

    def _named(self, i: int) -> bool:
        return 0 <= i < self.n and self.tokens[i].kind == "name"

    def _slice(self, first: int, last: int) -> str:
        return self.text[self.tokens[first].start : self.tokens[last].end]

    def _generics(self, i: int) -> int:
        """The index after type arguments or parameters that start at ``i``; ``i`` itself if none do."""
        if not self._is(i, "<"):
            return i
        depth, j = 0, i
        while j < self.n:
            t = self.tokens[j]
            if t.kind == "punct" and t.text in "([{":
                j = self.match[j]
            elif self._is(j, "<"):
                depth += 1
            elif t.kind == "punct" and t.text in (">", ">>", ">>>"):
                depth -= len(t.text)
                if depth <= 0:
                    return j + 1
            elif t.kind == "punct" and t.text in (";", ")", "]", "}", "&&", "||", "==", "===", "+", "-"):
                return i
            j += 1
        return i

    def _type_end(self, i: int, stops: tuple[str, ...]) -> int:
        """The index of the first token after a type that starts at ``i``."""
        j, start = i, i
        while j < self.n:
            t = self.tokens[j]
            if t.kind == "punct":
                if j > start and t.text == "{" and "{" in stops and not self._is(j - 1, "|", "&", "=>", ":", ",", "(", "<", "?", "extends"):
                    return j
                if t.text in "([{":
                    j = self.match[j] + 1
                    continue
                if t.text == "<":
                    after = self._generics(j)
                    if after > j:
                        j = after
                        continue
                if t.text == "=>" and "=>" in stops and not self._is(j - 1, ")"):
                    return j
                if t.text == "=>" and "=>" in stops and j > start and self.match[j - 1] != start:
                    return j
                if t.text in stops and t.text not in ("{", "=>") or t.text in (")", "]", "}"):
                    return j
            if j > start and t.line > self.tokens[j - 1].line and self._ends_line(j):
                return j
            j += 1
        return j

    def _ends_line(self, j: int) -> bool:
        """Whether a statement can end between tokens j - 1 and j, which are on different lines."""
        before, after = self.tokens[j - 1], self.tokens[j]
        if before.kind == "punct" and before.text not in (")", "]", "}", ">", "++", "--", "?"):
            return False
        if before.kind == "name" and before.text in TYPE_OPERATORS | {"return", "extends", "implements", "new", "await", "typeof"}:
            return False
        return not (after.kind == "punct" and after.text not in ("{", "[", "@", "++", "--", "(", "<") or after.kind == "name" and after.text in ("extends", "implements", "instanceof", "in", "as", "of"))

    def _expression_end(self, i: int) -> int:
        """The index of the first token after an expression that starts at ``i``."""
        j = i
        while j < self.n:
            t = self.tokens[j]
            if t.kind == "punct":
                if t.text in "([{":
                    j = self.match[j] + 1
                    if j < self.n and self.tokens[j].line > self.tokens[j - 1].line and self._ends_line(j):
                        return j
                    continue
                if t.text in (",", ";", ")", "]", "}"):
                    return j
            if t.kind == "jsx":
                j = t.last
            if j + 1 < self.n and self.tokens[j + 1].line > self.tokens[j].line and self._ends_line(j + 1):
                return j + 1
            j += 1
        return j

    def _modifiers(self, i: int) -> set[str]:
        """The words right before a declaration at ``i``."""
        found, j = set(), i - 1
        while j >= 0 and self.tokens[j].kind == "name" and self.tokens[j].text in MODIFIERS | {"export", "default", "const"}:
            found.add(self.tokens[j].text)
            j -= 1
        return found

    def _line(self, i: int) -> int:
        """The line on which a token ends."""
        t = self.tokens[i]
        return t.line + self.text.count("\n", t.start, t.end)

    # Declarations --------------------------------------------------------------------

    def run(self) -> dict[str, list[dict]]:
        i = 0
        while i < self.n:
            t = self.tokens[i]
            before = self._is(i - 1, ".", "?.")
            if t.kind == "name" and not before:
                if t.text == "function":
                    self._function(i)
                elif t.text == "class" and self._named(i + 1) and not self._is(i + 1, "extends"):
                    self._class(i)
                elif t.text in ("const", "let", "var") and not self._is(i + 1, "enum"):
                    self._variables(i)
                elif t.text == "import" and not self._is(i + 1, "(", "."):
                    self._import(i)
                elif self.typed and t.text == "interface" and self._named(i + 1) and self._starts(i):
                    self._interface(i)
                elif self.typed and t.text == "type" and self._named(i + 1) and self._starts(i):
                    self._type(i)
            i += 1
        self._calls()
        self._elements()
        if self.typed:
            self._usages()
        self.out["functions"] = [r for _, _, r in sorted(self.functions, key=lambda x: x[:2])]
        return self.out

    def _starts(self, i: int) -> bool:
        return i == 0 or self._is(i - 1, ";", "{", "}", "export", "declare", "default", ")") or self.tokens[i].line > self.tokens[i - 1].line

    def _add_function(self, order: int, name: str, first: int, last: int, body_first: int, body_last: int, signature: str, modifiers: set[str]) -> None:
        self.functions.append((order, first, {"name": name, "start_line": self.tokens[first].line, "end_line": self._line(last), "signature": signature, "is_async": "async" in modifiers, "is_export": "export" in modifiers}))
        self.spans.append(Span("function", name, body_first, body_last))

    def _parameters(self, i: int) -> int:
        """Records the annotations of a parameter list at ``i``; the index after it."""
        close = self.match[i]
        j, fresh = i + 1, True
        while j < close:
            t = self.tokens[j]
            if t.kind == "punct" and t.text in "([{":
                j = self.match[j] + 1
                continue
            if self._is(j, ":") and fresh:
                end = self._type_end(j + 1, (",", "=", ")"))
                self.annotations.append((j + 1, min(end, close), "parameter"))
                j, fresh = min(end, close), False
                continue
            if self._is(j, ","):
                fresh = True
            j += 1
        return close + 1

    def _returns(self, i: int, stops: tuple[str, ...]) -> int:
        """Records a return annotation at ``i`` (a colon); the index after it."""
        if not self._is(i, ":"):
            return i
        end = self._type_end(i + 1, stops)
        self.annotations.append((i + 1, end, "return_type"))
        return end

    def _function(self, i: int) -> None:
        j = i + 1 + self._is(i + 1, "*")
        name = self.tokens[j].text if self._named(j) else ""
        if name:
            self.declared.add(j)
            j += 1
        generic = self._generics(j)
        self._parameters_of_types(j, generic)
        if not self._is(generic, "("):
            return
        signature = self._slice(generic, self.match[generic])
        body = self._returns(self._parameters(generic), ("{", ";"))
        last = self.match[body] if self._is(body, "{") else max(generic, body - 1)
        modifiers = self._modifiers(i)
        first = i - ("async" in modifiers and self._is(i - 1, "async"))
        if name and (self._starts(first) or self._is(first - 1, "export", "default")):
            self._add_function(1, name, first, last, i, last, signature, modifiers)
        elif name:
            self.spans.append(Span("function", name, i, last))

    def _variables(self, i: int) -> None:
        kind, modifiers = self.tokens[i].text, self._modifiers(i)
        j = i + 1
        while j < self.n:
            if self.tokens[j].kind == "punct" and self.tokens[j].text in "{[":
                end, name = self.match[j] + 1, ""
            elif self._named(j):
                end, name = j + 1, self.tokens[j].text
            else:
                return
            at = j
            if self._is(end, "!"):
                end += 1
            if self._is(end, ":"):
                stop = self._type_end(end + 1, ("=", ",", ";"))
                self.annotations.append((end + 1, stop, "annotation"))
                end = stop
            if self._is(end, "of", "in"):
                return
            value = end + 1 if self._is(end, "=") else -1
            stop = self._expression_end(value) if value >= 0 else end
            if name:
                self._variable(name, kind, at, value, stop, modifiers)
            if not self._is(stop, ","):
                return
            j = stop + 1

    def _variable(self, name: str, kind: str, at: int, value: int, stop: int, modifiers: set[str]) -> None:
        shape, asynchronous = self._function_value(value) if value >= 0 else ("", False)
        if shape:
            marks = modifiers | ({"async"} if asynchronous else set())
            self._add_function(4 if shape == "arrow" else 5, name, at, stop - 1, value, stop - 1, "", marks)
            return
        self.out["variables"].append({"name": name, "var_type": "variable", "is_const": kind == "const", "is_let": kind == "let", "start_line": self.tokens[at].line})
        literal = self.tokens[value] if value >= 0 else None
        if kind == "const" and literal and stop == value + 1 and (literal.kind in ("string", "number") or literal.text in ("true", "false", "null")):
            self.out["constants"].append({"name": name, "value": literal.text})

    def _function_value(self, i: int) -> tuple[str, bool]:
        """('arrow' or 'function', async) if the expression at ``i`` is one; annotations of its head are recorded."""
        asynchronous = self._is(i, "async")
        i += asynchronous
        if self._is(i, "function"):
            return "function", asynchronous
        if self._named(i) and self._is(i + 1, "=>"):
            return "arrow", asynchronous
        j = self._generics(i)
        if self._is(j, "("):
            after = self.match[j] + 1
            if self._is(after, ":"):
                after = self._type_end(after + 1, ("=>", ";", ","))
            if self._is(after, "=>"):
                return "arrow", asynchronous
        return "", False

    def _arrows(self) -> None:
        """Annotations of every arrow function's head."""
        for i in range(self.n):
            if self._is(i, "=>"):
                j = i - 1
                if self._is(j, ")"):
                    self._parameters(self.match[j])
                    continue
                k = j
                while k > 0 and not self._is(k, ")", "{", "(", ";", "=", "=>"):
                    k = self.match[k] - 1 if self.tokens[k].kind == "punct" and self.tokens[k].text in "]}" else k - 1
                if self._is(k, ")") and self._is(k + 1, ":") and not self._in_type(self.match[k]):
                    self._parameters(self.match[k])
                    self.annotations.append((k + 2, i, "return_type"))

    def _in_type(self, i: int) -> bool:
        return any(a <= i < b for a, b, _ in self.annotations)

    def _heritage(self, i: int) -> tuple[list[str], int]:
        """Names of a comma-separated list of types at ``i``; every user type in it counts."""
        names, j = [], i
        while j < self.n and not self._is(j, "{", "implements"):
            if self._named(j) and not self._is(j - 1, ".") and self.tokens[j].text not in BUILT_IN_TYPES:
                names.append(self.tokens[j].text)
            if self._is(j, "("):
                j = self.match[j]
            j += 1
        return names, j

    def _class(self, i: int) -> None:
        name, modifiers = self.tokens[i + 1].text, self._modifiers(i)
        j = self._generics(i + 2)
        self._parameters_of_types(i + 2, j)
        parents, interfaces = [], []
        if self._is(j, "extends"):
            at = j + 1
            if self._named(at):
                while self._is(at + 1, ".") and self._named(at + 2):
                    at += 2
                parents = [self.tokens[at].text]
            after = self._generics(at + 1)
            self._arguments(at + 1, after)
            j = after
            while j < self.n and not self._is(j, "{", "implements"):
                j = self.match[j] + 1 if self._is(j, "(") else j + 1
        if self._is(j, "implements"):
            interfaces, j = self._heritage(j + 1)
        if not self._is(j, "{"):
            return
        last = self.match[j]
        methods = self._members(j, last)
        self.spans.append(Span("class", name, i, last))
        first = i
        while first > 0 and self._is(first - 1, "abstract", "declare"):
            first -= 1
        self.out["classes"].append({"name": name, "start_line": self.tokens[first].line, "end_line": self._line(last), "is_export": "export" in modifiers, "is_abstract": "abstract" in modifiers, "methods": methods})
        self.out["extends"] += [{"child_name": name, "parent_name": p} for p in parents]
        self.out["implements"] += [{"class_name": name, "interface_name": x} for x in interfaces]

    def _members(self, open_: int, close: int) -> list[str]:
        """The methods of a class body; each becomes a function."""
        methods, j = [], open_ + 1
        while j < close:
            first, words = j, set()
            while j < close and (self._is(j, "@") or self._named(j) and self.tokens[j].text in MODIFIERS and not self._is(j + 1, "(", "=", ":", ";", "?", "!", "<")):
                if self._is(j, "@"):
                    j += 2
                    j = self.match[j] + 1 if self._is(j, "(") else j
                    first = j
                else:
                    words.add(self.tokens[j].text)
                    j += 1
            j += self._is(j, "*")
            named = j < close and (self.tokens[j].kind in ("name", "string", "number") or self._is(j, "["))
            if not named:
                j = (self.match[j] + 1) if j < close and self.tokens[j].kind == "punct" and self.tokens[j].text in "([{" else j + 1
                continue
            name = self.tokens[j].text
            at, j = j, (self.match[j] if self._is(j, "[") else j) + 1
            j += self._is(j, "?", "!")
            generic = self._generics(j)
            if self._is(generic, "("):
                self._parameters_of_types(j, generic)
                self.declared.add(at)
                signature = self._slice(generic, self.match[generic])
                body = self._returns(self._parameters(generic), ("{", ";"))
                last = self.match[body] if self._is(body, "{") else body - 1
                self._add_function(2, name, first, last, at, last, signature, words)
                methods.append(name)
                j = last + 1
                continue
            if self._is(j, ":"):
                stop = self._type_end(j + 1, ("=", ";"))
                self.annotations.append((j + 1, stop, "annotation"))
                j = stop
            if self._is(j, "="):
                j = self._expression_end(j + 1)
        return methods

    def _interface(self, i: int) -> None:
        name, modifiers = self.tokens[i + 1].text, self._modifiers(i)
        j = self._generics(i + 2)
        self._parameters_of_types(i + 2, j)
        parents: list[str] = []
        if self._is(j, "extends"):
            parents, j = self._heritage(j + 1)
        if not self._is(j, "{"):
            return
        last, properties, k = self.match[j], [], j + 1
        while k < last:
            first = k
            while self._is(k, "readonly", "get", "set") and not self._is(k + 1, ":", "?", "("):
                k += 1
            if self.tokens[k].kind in ("name", "string", "number") and self._is(k + 1, ":", "?", "(", "<", ";", ",") or self._named(k) and k + 1 == last:
                key, at = self.tokens[k].value or self.tokens[k].text, k
                k += 1 + self._is(k + 1, "?")
                generic = self._generics(k)
                if self._is(generic, "("):
                    self.declared.add(at)
                    signature = self._slice(generic, self.match[generic])
                    end = self._returns(self._parameters(generic), (";", ","))
                    self._add_function(3, key, first, end - 1, at, end - 1, signature, set())
                    k = end
                else:
                    properties.append(key)
                    if self._is(k, ":"):
                        stop = min(self._type_end(k + 1, (";", ",")), last)
                        self.annotations.append((k + 1, stop, "property"))
                        k = stop
            elif self.tokens[k].kind == "punct" and self.tokens[k].text in "([{":
                k = self.match[k] + 1
                k = self._returns(self._generics(k), (";", ",")) if self._is(k, ":") else k
            k += self._is(k, ";", ",") or k == first
        self.spans.append(Span("interface", name, i, last))
        self.out["interfaces"].append({"name": name, "is_export": "export" in modifiers, "properties": properties})
        self.out["extends"] += [{"child_name": name, "parent_name": p} for p in parents]

    def _type(self, i: int) -> None:
        name = self.tokens[i + 1].text
        j = self._generics(i + 2)
        if not self._is(j, "="):
            return
        self._parameters_of_types(i + 2, j)
        stop = self._type_end(j + 1, (";",))
        self.annotations.append((j + 1, stop, "type_alias"))
        self.spans.append(Span("type", name, i, stop - 1))
        definition = self._slice(j + 1, stop - 1) if stop > j + 1 else ""
        self.out["types"].append({"name": name, "kind": "type_alias", "definition": definition, "is_export": "export" in self._modifiers(i)})

    def _import(self, i: int) -> None:
        names, default, namespace, j = [], False, False, i + 1
        while j < self.n and self.tokens[j].kind != "string":
            t = self.tokens[j]
            if self._is(j, ";", "=", "(") or t.kind not in ("name", "punct"):
                return
            if t.kind == "name" and t.text not in ("from", "as") and not (t.text == "type" and not self._is(j + 1, "from", ",")):
                names.append(t.text)
                default = default or j == i + 1 or self._is(j - 1, "type") and j == i + 2
            namespace = namespace or self._is(j, "*")
            j += 1
        if j < self.n:
            self.out["imports"].append({"module": self.tokens[j].value, "imported_names": names, "is_default": default, "is_namespace": namespace, "_at": i})

    # Uses ----------------------------------------------------------------------------

    def _inside(self, at: int, kinds: tuple[str, ...]) -> Span | None:
        """The innermost span of those kinds around a token: the last to begin before it, or one that holds that."""
        if self._nested.get(kinds, (None,))[0] != len(self.spans):
            spans = sorted((s for s in reversed(self.spans) if s.kind in kinds), key=lambda s: (s.first, -s.last))
            outer, open_ = [], []
            for i, s in enumerate(spans):
                while open_ and spans[open_[-1]].last < s.first:
                    open_.pop()
                outer.append(open_[-1] if open_ else -1)
                open_.append(i)
            self._nested[kinds] = (len(self.spans), spans, [s.first for s in spans], outer)
        _, spans, firsts, outer = self._nested[kinds]
        i = bisect_right(firsts, at) - 1
        while i >= 0 and spans[i].last < at:
            i = outer[i]
        return spans[i] if i >= 0 else None

    def _caller(self, at: int) -> str:
        # A span's own head counts as inside; a declaration's name itself never calls.
        span = self._inside(at, ("function",))
        return span.name if span else ""

    def _calls(self) -> None:
        direct, members = [], []
        for i in range(self.n):
            t = self.tokens[i]
            if t.kind != "name" or i in self.declared:
                continue
            k = i + 1 + self._is(i + 1, "?.")
            after = self._generics(k) if self.typed else k
            if not self._is(after, "("):
                continue
            if after > k:
                self._arguments(k, after)
            if self._is(i - 1, ".", "?."):
                owner = self.tokens[i - 2] if i >= 2 else None
                plain = owner is not None and owner.kind == "name" and not self._is(i - 3, ".", "?.") and owner.text != "super"
                if self._constructed(i):
                    continue
                context = owner.text if plain else ""
                members.append({"caller_func": self._caller(i), "called_func": f"{context}.{t.text}" if context else t.text, "call_location": t.line, "call_context": context})
            elif t.text not in CALL_KEYWORDS and not self._is(i - 1, "new", "function", "@"):
                direct.append({"caller_func": self._caller(i), "called_func": t.text, "call_location": t.line, "call_context": ""})
                if t.text == "require" and self.tokens[after + 1].kind == "string" and after + 2 == self.match[after]:
                    self.out["imports"].append({"module": self.tokens[after + 1].value, "imported_names": [], "is_default": False, "is_namespace": False, "_at": self.n + i})
            elif self._is(i - 1, "new"):
                self._reference(i, t)
        self.out["function_calls"] = direct + members
        self.out["imports"].sort(key=lambda r: r.pop("_at"))

    def _constructed(self, i: int) -> bool:
        """Whether the member chain that ends at ``i`` follows ``new``."""
        j = i
        while self._is(j - 1, ".", "?.") and self._named(j - 2):
            j -= 2
        return self._is(j - 1, "new")

    def _reference(self, i: int, t: Token) -> None:
        span = self._inside(i, ("function", "class"))
        self.out["references"].append({"source_entity": f"{span.kind}:{span.name}" if span else "", "target_entity": t.text, "ref_type": "instantiates", "line": t.line})

    def _elements(self) -> None:
        paired, closed = [], []
        for i, t in enumerate(self.tokens):
            if t.kind == "jsx" and t.value:
                row = {"tag_name": t.value, "containing_component": self._caller(i), "props": t.props, "line": t.line, "is_custom_component": t.value[0].upper() == t.value[0]}
                (closed if self.text[t.end - 2 : t.end] == "/>" and not self.text[t.start : t.end].rstrip().endswith(f"</{t.value}>") else paired).append(row)
        self.out["jsx_elements"] = paired + closed

    def _parameters_of_types(self, first: int, end: int) -> None:
        if end > first:
            self.annotations.append((first, end, "type_parameter"))

    def _arguments(self, first: int, end: int) -> None:
        if end > first:
            self.annotations.append((first, end, "type_argument"))

    def _usages(self) -> None:
        """One row for each use of a user type: its context is the annotation's, or type_argument inside ``<>``."""
        self._arrows()
        found = {}
        for first, end, context in self.annotations:
            depth, j = 0, first
            while j < min(end, self.n):
                t = self.tokens[j]
                if t.kind == "punct":
                    depth += t.text == "<"
                    depth -= len(t.text) if t.text in (">", ">>", ">>>") else 0
                    # Names of members and parameters inside a type are followed by a colon.
                elif t.kind == "name" and t.text not in BUILT_IN_TYPES | TYPE_OPERATORS and not self._is(j - 1, ".", "typeof", "infer"):
                    key = self._is(j + 1, ":") or self._is(j + 1, "?") and self._is(j + 2, ":")
                    if context == "type_parameter":
                        use = "type_parameter" if self._is(j - 1, "extends", "=", "|", "&") else ""
                    else:
                        use = "" if key or self._is(j + 1, "(") and not self._is(j - 1, ":", "=>") else "type_argument" if depth > 0 or context == "type_argument" else context
                        use = "" if use == "type_alias" else use  # only the arguments within an alias are uses
                    if use:
                        found.setdefault(j, use)
                j += 1
        for j in sorted(found):
            span = self._inside(j, ("function", "class", "interface", "type"))
            self.out["type_usages"].append({"using_entity": f"{span.kind}:{span.name}" if span else "", "used_type": self.tokens[j].text, "usage_context": found[j], "usage_location": self.tokens[j].line})
