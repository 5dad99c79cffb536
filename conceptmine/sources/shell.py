"""Notebook cells with interactive-shell syntax as code that Python can parse."""

from __future__ import annotations

import ast
import re

_PROMPT = re.compile(r"^(>>>|\.\.\.)( |$)")
_NUMBERED_PROMPT = re.compile(r"^(In \[\d+\]: |\s*\.{3,}: ?)")
_CELL_MAGIC = re.compile(r"^%%(\w+)[ \t]*(.*)$")
_MAGIC = re.compile(r"^(\s*)%([A-Za-z_]\w*)[ \t]*(.*)$", re.S)
_SHELL = re.compile(r"^(\s*)(!!?)(.*)$", re.S)
_ASSIGNED = re.compile(r"^(\s*[\w., \[\]]+=\s*)(?:%([A-Za-z_]\w*)[ \t]*(.*)|!(.*))$", re.S)
_HELP = re.compile(r"^(\s*)(?:(\?{1,2})\s*(%{0,2}[\w.*]+)|(%{0,2}[\w.*]+)(\?{1,2}))\s*$")
#: Cells without any of these are left alone without a look at their syntax.
MARKS = r"[%!?]|>>>|^In \[|^\s"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


class _State:
    """Whether the next line begins inside brackets, a string or a continued line."""

    def __init__(self) -> None:
        self.depth, self.quote, self.continued = 0, "", False

    def inside(self) -> bool:
        return bool(self.depth or self.quote or self.continued)

    def read(self, line: str) -> None:
        i = 0
        while i < len(line):
            if self.quote:
                if line[i] == "\\":
                    i += 2
                    continue
                if line.startswith(self.quote, i):
                    i += len(self.quote)
                    self.quote = ""
                    continue
            elif line[i] == "#":
                self.continued = False
                return
            elif line[i] in "'\"":
                self.quote = line[i] * 3 if line.startswith(line[i] * 3, i) else line[i]
                i += len(self.quote)
                continue
            elif line[i] in "([{":
                self.depth += 1
            elif line[i] in ")]}":
                self.depth = max(0, self.depth - 1)
            i += 1
        self.continued = line.endswith("\\")
        if len(self.quote) == 1 and not self.continued:
            self.quote = ""  # ends with its line


def _statement(line: str) -> str | None:
    """One shell statement as a call, None for other code."""
    if m := _HELP.match(line):
        name, marks = (m[3], m[2]) if m[2] else (m[4], m[5])
        kind = "psearch" if "*" in name else "pinfo2" if marks == "??" else "pinfo"
        return f"{m[1]}get_ipython().run_line_magic({_quoted(kind)}, {_quoted(name)})"
    if m := _MAGIC.match(line):
        return f"{m[1]}get_ipython().run_line_magic({_quoted(m[2])}, {_quoted(m[3])})"
    if m := _SHELL.match(line):
        return f"{m[1]}get_ipython().{'getoutput' if m[2] == '!!' else 'system'}({_quoted(m[3])})"
    if m := _ASSIGNED.match(line):
        if m[2]:
            return f"{m[1]}get_ipython().run_line_magic({_quoted(m[2])}, {_quoted(m[3])})"
        return f"{m[1]}get_ipython().getoutput({_quoted(m[4])})"
    return None


def _parses(source: str) -> bool:
    try:
        ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def plain_code(source: str) -> str:
    """The cell as it is if it parses; else without prompts and indent, with shell statements as calls."""
    if not source.startswith("In [") and _parses(source):  # "In [1]: f()" parses, as an annotation
        return source
    lines = source.split("\n")
    while lines and not lines[0].strip():
        lines.pop(0)
    if not lines:
        return source
    if m := _CELL_MAGIC.match(lines[0]):
        body = "\n".join(lines[1:]) + "\n"
        return f"get_ipython().run_cell_magic({_quoted(m[1])}, {_quoted(m[2])}, {_quoted(body)})"
    indent = re.match(r"[ \t]*", lines[0])[0]
    if indent:
        lines = [x.removeprefix(indent) for x in lines]
    for prompt in (_PROMPT, _NUMBERED_PROMPT):
        if prompt.match(lines[0]):
            lines = [prompt.sub("", x) for x in lines]
    out, state, i = [], _State(), 0
    while i < len(lines):
        line = lines[i]
        i += 1
        if not state.inside():
            whole, last = line, i
            if _statement(line) is not None:
                parts = [line]
                while parts[-1].endswith("\\") and last < len(lines):
                    parts.append(lines[last])
                    last += 1
                whole = " ".join([p.rstrip()[:-1] for p in parts[:-1]] + [parts[-1]])
            call = _statement(whole)
            if call is not None:
                out.append(call)
                i = last
                continue
        out.append(line)
        state.read(line)
    return "\n".join(out)
