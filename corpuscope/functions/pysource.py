"""Line scan of Python sources, run in Arrow batches.

Blocks are found by indent, which takes a stack over the lines of a text. A fold over arrays
inside the JVM can do it, but is slower and copies its arrays at every step, so this one
function is an Arrow UDF; everything else about symbols is column expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, functions as F

SYMBOL = (
    "struct<start_line:int,end_line:int,kind:string,name:string,parent:string,listed:boolean,"
    "line_before:int,decorators:array<string>,signature:string>"
)
SCAN = f"symbols array<{SYMBOL}>, imports array<string>, leading int"

_ARROW_SCAN = pa.struct([
    ("symbols", pa.list_(pa.struct([
        ("start_line", pa.int32()), ("end_line", pa.int32()), ("kind", pa.string()), ("name", pa.string()),
        ("parent", pa.string()), ("listed", pa.bool_()), ("line_before", pa.int32()),
        ("decorators", pa.list_(pa.string())), ("signature", pa.string())]))),
    ("imports", pa.list_(pa.string())),
    ("leading", pa.int32()),
])

_STRINGS_AND_COMMENTS = re.compile(
    r'"""[\s\S]*?"""|' r"'''[\s\S]*?'''|"
    r'"(?:[^"\\\n]|\\[\s\S])*"|' r"'(?:[^'\\\n]|\\[\s\S])*'|"
    r"#[^\n]*")
_DEFINITION = re.compile(r"(class|def)\s+(\w+)")
_BRACKETS = re.compile(r"[()\[\]{}]")


def _cover(token: re.Match) -> str:
    """Strings become brackets around their line feeds, comments vanish."""
    text = token[0]
    return "" if text[0] == "#" else "(" + "\n" * text.count("\n") + ")"


def _balance(code: str) -> int:
    return sum(1 if b in "([{" else -1 for b in _BRACKETS.findall(code))


def scan(text: str) -> tuple[list[dict], list[str], int]:
    """(symbols, import statements, leading blank lines).

    A symbol is ``listed`` when it is a class or function at the top, or a function directly in
    a listed symbol. Lines joined by open brackets or a backslash are one statement."""
    raw, codes = text.split("\n"), _STRINGS_AND_COMMENTS.sub(_cover, text).split("\n")
    symbols, imports, open_blocks, decorators = [], [], [], []
    last_code = last_text = at = 0
    leading = next((i for i, line in enumerate(raw) if line.strip()), len(raw))
    while at < len(codes):
        code = codes[at].strip()
        if not code:
            last_text = at + 1 if raw[at].strip() else last_text
            at += 1
            continue
        first, indent = at, len(codes[at]) - len(codes[at].lstrip())
        depth = _balance(code)
        while (depth > 0 or code.endswith("\\")) and at + 1 < len(codes):
            at += 1
            more = codes[at].strip()
            depth = max(depth + _balance(more), 0)
            code = f"{code.rstrip(chr(92))} {more}"
        while open_blocks and open_blocks[-1][0] >= indent:
            block = open_blocks.pop()[1]
            if block is not None:
                block["end_line"] = last_code
        definition = _DEFINITION.match(code)
        if definition:
            kind, name = definition.groups()
            outer = open_blocks[-1][1] if open_blocks else None
            top = not open_blocks
            symbol = {
                "start_line": first + 1, "end_line": at + 1,
                "kind": "class" if kind == "class" else "function" if top else "nested",
                "name": name, "parent": outer["name"] if outer else None,
                "listed": top or (kind == "def" and outer is not None and outer["listed"]),
                "line_before": last_text, "decorators": decorators,
                "signature": " ".join(line.strip() for line in raw[first:at + 1]),
            }
            symbols.append(symbol)
            open_blocks.append((indent, symbol))
        elif code.endswith(":"):
            open_blocks.append((indent, None))
        elif code.startswith(("import ", "from ")):
            imports.append(code)
        joined = " ".join(line.strip() for line in raw[first:at + 1])
        decorators = [*decorators, joined] if code[0] == "@" else []
        at += 1
        last_code = last_text = at
    for _, block in open_blocks:
        if block is not None:
            block["end_line"] = last_code
    return symbols, imports, leading


def scanned(content: Column) -> Column:
    """struct(symbols, imports, leading) of a Python text; a null text has none of them."""

    @F.arrow_udf(SCAN)
    def scan_batch(texts: pa.Array) -> pa.Array:
        names = ("symbols", "imports", "leading")
        rows = [scan(t.as_py() or "") for t in texts]
        return pa.array([dict(zip(names, row)) for row in rows], type=_ARROW_SCAN)

    return scan_batch(content)
