"""Rich text to plain pages. Groups nest without a bound, so this one reader is a small Python helper behind an Arrow function."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Destinations that hold no text, and control words that stand for a character.
DESTINATIONS = {
    "fonttbl", "colortbl", "stylesheet", "info", "pict", "*", "generator", "author", "company", "title", "subject", "keywords",
}
CHARACTERS = {
    "par": "\n", "line": "\n", "tab": " ", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“",
    "rdblquote": "”", "bullet": "•",
}
BREAKS = {"page", "sect", "pagebb"}
TOKEN = re.compile(
    r"(?P<open>\{(?:(?=\\(?P<dest>[A-Za-z*]+))|))|(?P<close>\})|\\'(?P<hex>[0-9a-fA-F]{2})?|\\(?P<char>[\\{}])"
    r"|\\(?P<u>[uU])(?P<code>-?[0-9]+) ?\??|\\(?P<word>[A-Za-z]*)-?[0-9]* ?|(?P<text>[^\\{}\r]+)|\r"
)


def _character(code: int) -> str:
    code += 65536 if code < 0 else 0
    return chr(code if 0 <= code <= 0x10FFFF else code % 65536)


def pages_of(source: str) -> list[str]:
    """Texts of the pages; a source without the header of the format is one page as it stands."""
    if "{\\rtf" not in source:
        return [source.strip()]
    pages: list[list[str]] = [[]]
    depth, hidden = 0, 0  # hidden: depth of the outermost group without text, 0 outside
    for m in TOKEN.finditer(source):
        if m["open"]:
            depth += 1
            if not hidden and (m["dest"] or "").lower() in DESTINATIONS:
                hidden = depth
        elif m["close"]:
            hidden = 0 if hidden == depth else hidden
            depth -= 1
        elif hidden and depth >= hidden:
            continue
        elif m["u"]:
            pages[-1].append(_character(int(m["code"])))
        elif m["word"] and m["word"].lower() in BREAKS:
            pages.append([])
        else:
            word = CHARACTERS.get((m["word"] or "").lower(), "")
            pages[-1].append(m["text"] or m["char"] or (chr(int(m["hex"], 16)) if m["hex"] else word))
    # halves of a pair come as two numbers
    whole = ["".join(p).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace").strip() for p in pages]
    return [p for p in whole if p] or [""]


def _read(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else pages_of(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def rtf_pages(text: Column) -> Column:
    """Pages of each text; null where the text is null."""
    return F.arrow_udf(_read, ArrayType(StringType()))(text)
