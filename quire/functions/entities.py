"""Character references of HTML text: one pass, the longest known name wins, as a browser reads them."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import let, replace_matches

REFERENCE = r"&(?:#(?:[xX][0-9A-Fa-f]+|[0-9]+);?|[A-Za-z][A-Za-z0-9]*;?)"
#: names that also count without a semicolon, even with letters right behind them
LEGACY = {name: text for name, text in html5.items() if not name.endswith(";")}
_LENGTHS = sorted({len(name) for name in LEGACY}, reverse=True)
#: numbers of the C1 range stand for the characters of the Windows code page
_C1 = {n: bytes([n]).decode("cp1252", "ignore") for n in range(0x80, 0xA0)}


def _table(values: dict, kind: str) -> Column:
    # one folded literal instead of thousands of expressions
    return F.from_json(F.lit(json.dumps({str(k): v for k, v in values.items()})), f"map<{kind},string>")


def _numeric(m: Column) -> Column:
    digits = F.regexp_extract(m, r"(?i)\A&#x?0*([0-9a-f]*);?\z", 1)
    base16 = F.contains(F.lower(m), F.lit("x"))
    number = F.when(
        F.length(digits) <= 8, F.when(base16, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
    )

    def character(n: Column) -> Column:
        # what is no code point becomes the replacement character
        known = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        code = F.lpad(F.hex(F.when(known, n).otherwise(F.lit(0xFFFD))), 8, "0")
        plain = F.decode(F.unhex(code), "UTF-32")
        c1 = F.element_at(_table({n: t for n, t in _C1.items() if t}, "string"), n.cast("string"))
        return F.when(n.between(0x80, 0x9F), F.coalesce(c1, plain)).otherwise(plain)

    return let(number, character)


def _named(m: Column) -> Column:
    name = F.substr(m, F.lit(2))
    legacy = _table(LEGACY, "string")
    shorter = [
        F.when(F.length(name) > n, F.concat(F.element_at(legacy, F.substr(name, F.lit(1), F.lit(n))), F.substr(name, F.lit(n + 1))))
        for n in _LENGTHS
    ]
    return F.coalesce(F.element_at(_table(html5, "string"), name), *shorter, m)


def decoded(text: Column) -> Column:
    """``text`` with its character references resolved; what they stand for is not looked at again."""
    return replace_matches(text, REFERENCE, lambda m: F.when(F.startswith(m, F.lit("&#")), _numeric(m)).otherwise(_named(m)))
