"""From a path and its text to records by kind."""

from __future__ import annotations

from .lexer import ParseError
from .script import Script
from .style import parse_style

KINDS = ("functions", "imports", "variables", "types", "interfaces", "classes", "constants", "jsx_elements", "css_rules", "function_calls", "type_usages", "extends", "implements", "references")
FILE_FIELD = {"function_calls": "caller_file", "type_usages": "using_file", "references": "source_file"}


def resolve(records: dict[str, list[dict]], path: str) -> None:
    """Fills resolved_target and target_file of calls from the file's own functions and classes."""
    last = {f["name"]: f for f in records["functions"]}
    first: dict[str, dict] = {}
    for f in records["functions"]:
        first.setdefault(f["name"], f)
    classes = {c["name"] for c in records["classes"]}
    for call in records["function_calls"]:
        target = last.get(call["called_func"])
        parts = call["called_func"].split(".")
        if call["call_context"] in classes and len(parts) == 2 and parts[1] in first:
            target = first[parts[1]]
        call["resolved_target"] = target["name"] if target else ""
        call["target_file"] = path if target else ""


def parse_source(path: str, text: str) -> tuple[dict[str, list[dict]], str | None]:
    """(records by kind, error): an error leaves all kinds empty."""
    language = path.rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else ""
    records: dict[str, list[dict]] = {k: [] for k in KINDS}
    try:
        if language in ("css", "scss"):
            records["css_rules"] = parse_style(text, language == "scss")
        elif language in ("ts", "tsx", "js", "jsx"):
            found = Script(text, language in ("ts", "tsx"), language in ("tsx", "jsx")).run()
            if language in ("ts", "js"):
                found["jsx_elements"] = []
            records |= found
            resolve(records, path)
        else:
            return records, f"unsupported file type: {language}"
    except (ParseError, RecursionError, IndexError) as e:
        return {k: [] for k in KINDS}, f"{type(e).__name__}: {e}"
    for kind, rows in records.items():
        for seq, row in enumerate(rows):
            row[FILE_FIELD.get(kind, "file")] = path
            row["seq"] = seq
    return records, None
