"""Per-entry validation: one CASE column, first failing rule wins.

Rule order: the entry is an object; required fields (timestamp, level,
service, message); then per field in schema order its type and its own
rule; attributes must be a flat object of scalars; finally the timestamp may
be at most five minutes ahead of ``as_of``. ``reason`` is NULL for an
accepted entry.

The rules are a ``transform`` over the entries of a document, in steps: fields, their types and texts,
the time, the verdict. Each step reads what the one before it has made, so nothing is pulled out of
a VARIANT or parsed twice, and a document's outcome needs no explode and no shuffle.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog import schema as S

SCALAR_TYPES = ("STRING", "BOOLEAN", "BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")
# What is known of an entry after validation; ``raw`` is the JSON text of a rejected one.
CHECKED = ["reason", "ts", "level", "service", "message", "attributes_v", "raw"]


def _kind(x: Column) -> Column:
    return F.schema_of_variant(x)


def _fmt(template: str, **parts: Column) -> Column:
    """Fill one ``{name}`` slot of a reason template with a Column."""
    (name, col), = parts.items()
    before, after = template.split("{" + name + "}")
    return F.concat(F.lit(before), col, F.lit(after))


def parse_timestamp(text: Column) -> Column:
    """RFC 3339 text → timestamp at millisecond precision; NULL when invalid.

    The shape check comes first (the bare parser also takes 'yesterday' or a
    date alone); the parser then rejects impossible dates and leap seconds.
    """
    # Offsets go to 23:59, further than the parser takes them, so they are subtracted.
    pattern = r"([+-])(\d{2}):?(\d{2})?$"
    zone = F.regexp_extract(text, pattern, 0)
    part = lambda i: F.coalesce(F.regexp_extract(text, pattern, i).try_cast("bigint"), F.lit(0))
    minutes = F.when(zone.startswith("-"), -1).otherwise(1) * (part(2) * 60 + part(3))
    local = F.try_to_timestamp(F.upper(F.concat(F.substr(text, F.lit(1), F.length(text) - F.length(zone)), F.lit("Z"))))
    zulu = F.substr(text, F.lit(-1), F.lit(1)).isin("Z", "z")
    parsed = F.when(zulu, F.try_to_timestamp(F.upper(text))).otherwise(F.timestamp_micros(F.unix_micros(local) - minutes * 60_000_000))
    # greatest of itself and the earliest time, nothing where the two differ: the parse stands here once.
    early = F.lit(S.EARLIEST).cast("timestamp")
    found = F.transform(F.array(F.date_trunc("millisecond", parsed)), lambda t: F.when(t >= early, t))
    return F.when(text.rlike(S.RFC3339_PATTERN), F.get(found, F.lit(0)))


def _pointer(key: Column) -> Column:
    """JSON-pointer escaping of a key as it appears in the reason."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _with(e: Column, names: list[str], **more: Column) -> Column:
    return F.struct(*[e[n].alias(n) for n in names], *[c.alias(n) for n, c in more.items()])


def first_in_text(attributes: Column, bad: Column) -> Column:
    """Which of the keys ``bad`` comes first in an object's text: whole numbers in ascending order, then the others
    in the order they first stand in."""
    keys = F.array_distinct(F.json_object_keys(attributes))
    number = lambda k: k.rlike("^(0|[1-9][0-9]{0,9})$") & (k.try_cast("bigint") < 4294967295)
    numbers = F.transform(F.array_sort(F.transform(F.filter(keys, number), lambda k: k.cast("bigint"))), lambda k: k.cast("string"))
    ordered = F.concat(numbers, F.filter(keys, lambda k: ~number(k)))
    return F.get(F.filter(ordered, lambda k: F.array_contains(bad, k)), F.lit(0))


def check_entries(logs: Column, as_of: datetime | Column | None = None, body: Column | None = None) -> Column:
    """``array<variant>`` of entries → array of structs of the columns CHECKED, in the same order.

    ``body``, the text of the document, gives the order of an entry's attributes, which a VARIANT does not keep; without
    it the first bad attribute is the first in the order of the keys.
    """
    now = F.current_timestamp() if as_of is None else (as_of if isinstance(as_of, Column) else F.lit(as_of))
    limit = now + F.expr(f"INTERVAL {S.MAX_FUTURE_SKEW_SECONDS} SECONDS")
    required, fields = list(S.REQUIRED_FIELDS), [*S.REQUIRED_FIELDS, "attributes"]

    pulled = F.transform(logs, lambda v: F.struct(v.alias("v"), *[F.try_variant_get(v, f"$.{f}", "variant").alias(f) for f in fields]))
    typed = F.transform(pulled, lambda e: _with(
        e, ["v", "attributes"],
        # NULL where the field is missing, false where it is no text.
        **{f"is_{f}": _kind(e[f]) == "STRING" for f in required},
        **{f: F.try_variant_get(e[f], "$", "string") for f in required},
        map=F.try_variant_get(e["attributes"], "$", "map<string,variant>")))
    names = ["v", "attributes", *[f"is_{f}" for f in required], *required]
    scalar = lambda v: v.isin(*SCALAR_TYPES) | v.startswith("DECIMAL")
    timed = F.transform(typed, lambda e: _with(
        e, names, ts=F.when(e["is_timestamp"], parse_timestamp(e["timestamp"])),
        flat=e["map"].isNotNull(),
        bad=F.transform(F.filter(F.map_entries(e["map"]), lambda a: ~scalar(_kind(a["value"]))), lambda a: a["key"])))

    def bad_key(e: Column, i: Column) -> Column:
        least = F.array_min(e["bad"])
        if body is None:
            return least
        entry = F.get(F.from_json(body, "struct<logs:array<string>>")["logs"], i)
        text = F.from_json(entry, "struct<attributes:string>")["attributes"]
        return F.when(F.size(e["bad"]) == 1, least).otherwise(F.coalesce(first_in_text(text, e["bad"]), least))

    def reason(e: Column, i: Column) -> Column:
        missing = F.when(~_kind(e["v"]).startswith("OBJECT"), F.lit(S.REASON_NOT_OBJECT))
        absent = F.lit(False)
        for f in required:
            missing = missing.when(e[f"is_{f}"].isNull(), F.lit(S.REASON_MISSING.format(field=f)))
            absent = absent | e[f"is_{f}"].isNull()
        # An entry that has all fields is an object.
        chain = F.when(absent, missing)
        text = lambda f: F.lit(S.REASON_NOT_STRING.format(field=f))
        chain = (chain.when(~e["is_timestamp"], text("timestamp"))
                 .when(e["ts"].isNull(), _fmt(S.REASON_BAD_TIMESTAMP, value=e["timestamp"]))
                 .when(~e["is_level"], text("level"))
                 .when(~e["level"].isin(*S.LEVELS), _fmt(S.REASON_BAD_LEVEL, value=e["level"])))
        for f in ("service", "message"):
            chain = chain.when(~e[f"is_{f}"], text(f)).when(e[f] == "", F.lit(S.REASON_EMPTY.format(field=f)))
        return (chain.when(e["attributes"].isNotNull() & ~e["flat"], F.lit(S.REASON_ATTRS_NOT_OBJECT))
                .when(F.size(e["bad"]) > 0, _fmt(S.REASON_BAD_ATTR, key=_pointer(bad_key(e, i))))
                .when(e["ts"] > limit, F.lit(S.REASON_FUTURE)))

    kept = ["v", "ts", "level", "service", "message", "attributes"]
    judged = F.transform(timed, lambda e, i: _with(e, kept, reason=reason(e, i)))
    ok = lambda e, x: F.when(e["reason"].isNull(), x)
    return F.transform(judged, lambda e: F.struct(
        e["reason"].alias("reason"), e["ts"].alias("ts"), e["level"].alias("level"), e["service"].alias("service"), e["message"].alias("message"),
        # The attributes of accepted entries, as the VARIANT the store keeps.
        ok(e, F.coalesce(e["attributes"], F.parse_json(F.lit("{}")))).alias("attributes_v"),
        F.when(e["reason"].isNotNull(), F.to_json(e["v"])).alias("raw")))


def validate_entries(entries: DataFrame, as_of: datetime | Column | None = None, entry_col: str = "v") -> DataFrame:
    """Add ``reason`` and the typed columns ts, level, service, message, attributes (JSON text and VARIANT) to one row for each entry."""
    found = entries.withColumn("_checked", F.get(check_entries(F.array(F.col(entry_col)), as_of), F.lit(0)))
    return found.select(*[F.col(f"`{c}`") for c in entries.columns], *[F.col(f"_checked.{c}").alias(c) for c in CHECKED if c not in ("attributes_v", "raw")],
                        F.to_json("_checked.attributes_v").alias("attributes"), F.col("_checked.attributes_v").alias("attributes_v"))
