"""Typed attribute probes on the flat attribute document.

Query values arrive as text; a stored value matches when it is the same
string, or a number equal to the text read as a number, or the boolean the
text spells. The text is read as a number once, on the driver, with the
rules of JavaScript ``Number(text)``; rows never run Python.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ATTR_MAP_TYPE = "map<string,variant>"
NUMERIC_VARIANT_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")

# Whitespace and line terminators that JavaScript trims before reading a number.
_JS_SPACE = (
    "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_DECIMAL = re.compile(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$")
_RADIX = re.compile(r"^0(?:[xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)$")


def js_number(text: str) -> float | None:
    """``Number(text)`` of JavaScript; None when NaN or not finite."""
    s = text.strip(_JS_SPACE)
    if s == "":
        return 0.0
    if _DECIMAL.match(s):
        v = float(s)
    elif _RADIX.match(s):
        v = float(int(s[2:], {"x": 16, "o": 8, "b": 2}[s[1].lower()]))
    else:
        return None
    return v if math.isfinite(v) else None


def parse_attributes(col: Column | str) -> Column:
    """JSON object text → ``map<string, variant>`` (value types preserved)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.from_json(c, ATTR_MAP_TYPE)


def _is_numeric(kind: Column) -> Column:
    return kind.isin(*NUMERIC_VARIANT_TYPES) | kind.startswith("DECIMAL")


def _probe(x: Column, value: str) -> Column:
    kind = F.schema_of_variant(x)
    probes = [(kind == "STRING") & (F.try_variant_get(x, "$", "string") == F.lit(value))]
    num = js_number(value) if value != "" else None
    if num is not None:
        probes.append(_is_numeric(kind) & (F.try_variant_get(x, "$", "double") == F.lit(float(num))))
    if value in ("true", "false"):
        probes.append((kind == "BOOLEAN") & (F.try_variant_get(x, "$", "boolean") == F.lit(value == "true")))
    match = probes[0]
    for p in probes[1:]:
        match = match | p
    return match


_PLAIN_KEY = re.compile(r"[^'\\]*")


def attr_value(attrs: Column | str, key: str, is_variant: bool = False) -> Column:
    """The stored value under ``key`` as a variant (NULL when absent).

    On a VARIANT attribute column this is a direct path lookup (no parsing);
    on JSON text the object is parsed into ``map<string, variant>``.
    """
    col = F.col(attrs) if isinstance(attrs, str) else attrs
    if is_variant and _PLAIN_KEY.fullmatch(key):
        return F.try_variant_get(col, f"$['{key}']", "variant")
    text = F.to_json(col) if is_variant else col
    return F.try_element_at(parse_attributes(text), F.lit(key))


def attr_equals(attrs: Column | str, key: str, value: str, is_variant: bool = False) -> Column:
    """Typed equality probe for one ``attr.<key>=<value>`` pair.

    The looked-up value is bound once to a lambda variable (``exists`` over a
    one-element array) and every typed probe reads that variable.
    """
    col = F.col(attrs) if isinstance(attrs, str) else attrs
    x = attr_value(col, key, is_variant)
    match = F.coalesce(F.exists(F.array(x), lambda v: _probe(v, value)), F.lit(False))
    if not is_variant and re.fullmatch(r"[A-Za-z0-9_.:@-]+", key):
        # Cheap text guard before the parse: the serialised key must occur.
        match = col.contains(f'"{key}"') & match
    return match


def promoted_columns(key: str) -> dict[str, str]:
    """Names of the stored columns of a promoted key: its text, number and boolean value, and the mark that a file has them.

    Column names ignore case, so all but lower-case letters and digits is spelled by code point.
    """
    enc = re.sub(r"[^a-z0-9]", lambda m: f"_{ord(m[0]):x}_", key)
    return {kind: f"attr_{kind}_{enc}" for kind in ("text", "number", "bool", "kept")}


def promoted_values(attrs: Column | str, key: str) -> list[Column]:
    """The typed columns of a promoted key, from a VARIANT attribute column. At most one of the values is set."""
    names = promoted_columns(key)
    x = attr_value(attrs, key, is_variant=True)
    kind = F.schema_of_variant(x)
    # Adding zero makes a stored -0.0 findable as 0.0 in Parquet's dictionaries and Bloom filters.
    number = F.when(_is_numeric(kind), F.try_variant_get(x, "$", "double") + F.lit(0.0))
    return [
        F.when(kind == "STRING", F.try_variant_get(x, "$", "string")).alias(names["text"]),
        number.alias(names["number"]),
        F.when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean")).alias(names["bool"]),
        F.lit(True).alias(names["kept"]),
    ]


def promoted_equals(attrs: Column | str, key: str, value: str) -> Column:
    """``attr_equals`` on a table whose files may hold the key's typed columns.

    The first clause has plain comparisons only, so it is pushed into the scan; rows of files written before the key was
    promoted (no mark) are let through by it and probed in the second.
    """
    names = promoted_columns(key)
    direct = F.col(names["text"]) == F.lit(value)
    num = js_number(value) if value != "" else None
    if num is not None:
        direct = direct | (F.col(names["number"]) == F.lit(float(num) + 0.0))
    if value in ("true", "false"):
        direct = direct | (F.col(names["bool"]) == F.lit(value == "true"))
    older = F.col(names["kept"]).isNull()
    return (direct | older) & (F.coalesce(direct, F.lit(False)) | (older & attr_equals(attrs, key, value, is_variant=True)))


def attributes_as_text(attrs_text: Column | str) -> Column:
    """Every attribute value coerced to its string form (numbers and booleans
    spelled as text), as JSON object text."""
    text = F.col(attrs_text) if isinstance(attrs_text, str) else attrs_text
    return F.to_json(F.transform_values(parse_attributes(text), lambda k, v: v.cast("string")))
