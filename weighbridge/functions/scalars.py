"""Scalar functions composed of built-in expressions: identifiers, digests, spans, windows, timestamps, rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = "\x1f"


def stable_id(prefix: str, *parts: Column) -> Column:
    """A prefix and the first 24 hex digits of the digest of the parts; null parts are an error of the caller."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(UNIT, *(p.cast("string") for p in parts)), 256), 1, 24))


def namespaced_id(namespace: str, value: Column, dataset: str) -> Column:
    return F.sha2(F.concat_ws(chr(0), F.lit(namespace), F.lit(dataset), value.cast("string")), 256)


def keyed_hash(salt: bytes, namespace: str, *values: Column) -> Column:
    """HMAC-SHA256 of the values in hex. The two pads depend on the salt alone, so they are made once, here."""
    if len(salt) < 16:
        raise ValueError("a salt has 16 bytes at least")
    key = salt if len(salt) <= 64 else __import__("hashlib").sha256(salt).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    message = F.concat_ws(UNIT, F.lit(namespace), *(v.cast("string") for v in values)).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def ordered_digest(order: Column, line: Column) -> Column:
    """An aggregate: the digest of the lines in order, a line feed after each. A group is gathered: of many rows, digest parts of
    a bounded size and then, in order, these digests."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l"))))
    return F.sha2(F.concat(F.array_join(F.transform(rows, lambda r: r["l"]), "\n"), F.lit("\n")), 256)


def span_holds(text: Column, start: Column, end: Column, mention: Column) -> Column:
    """Whether 0 <= start < end <= length and the slice is the mention, in code points."""
    fits = (start >= 0) & (start < end) & (end <= F.length(text))
    return F.coalesce(fits & (F.substring(text, (start + 1).cast("int"), (end - start).cast("int")) == mention), F.lit(False))


def window_bounds(length: Column, start: Column, end: Column, most: int) -> Column:
    """(lower, upper) of a window of at most `most` code points around a span, moved in at the edges of the text. A span that is
    longer than the window is an error, unless the window holds the whole text."""
    spare = F.when((length > most) & (end - start > most), F.raise_error(F.lit("a span is longer than the window")).cast("long")).otherwise(F.lit(most) - (end - start))
    lower = F.greatest(F.lit(0).cast("long"), start - F.floor(spare / 2))
    upper = F.least(length, end + spare - (start - lower))
    lower = F.when(upper - lower < most, F.greatest(F.lit(0).cast("long"), upper - most)).otherwise(lower)
    whole = length <= most
    return F.struct(F.when(whole, F.lit(0).cast("long")).otherwise(lower).alias("lower"), F.when(whole, length).otherwise(upper).alias("upper"))


def tagged_slice(text: Column, start: Column, end: Column, lower: Column, upper: Column, tags: Sequence[str]) -> Column:
    """The window with the span between tags."""
    cut = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    return F.concat(cut(lower, start), F.lit(tags[0]), cut(start, end), F.lit(tags[1]), cut(end, upper))


def zoned_timestamp(value: Column) -> Column:
    """ISO date and time with a zone (Z or an offset); null without one, or if it is no time."""
    return F.when(value.rlike(r"\A\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d:\d\d)\z"), F.try_to_timestamp(F.regexp_replace(value, "T", " ")))


def compared(operator: Column, a: Column, b: Column) -> Column:
    """a operator b, the operator a string of the row; null for one that is not known."""
    return F.when(operator == "<", a < b).when(operator == "<=", a <= b).when(operator == ">", a > b).when(operator == ">=", a >= b).when(operator == "==", a == b).when(operator == "!=", a != b)


def is_digest(value: Column) -> Column:
    return value.rlike(r"\A[0-9a-f]{64}\z")


def slug(value: Column) -> Column:
    """Letters whose capitals are several count as these: ß as ss, a ligature as its letters."""
    folded = F.lower(F.upper(F.translate(value, "\u0131", "_")))  # a dotless i has a plain I as its capital
    return F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "_"), r"^_+|_+\z", "")


def rendered(value: Column) -> Column:
    """Text of a value; false and 0 are values, only null is missing."""
    return F.coalesce(value.cast("string"), F.lit("missing"))


def canonical(value: Column, kind: T.DataType) -> Column:
    """A value whose structs have their fields by name and whose maps have their entries by key, at every level."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*(canonical(value[f.name], f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value)) if isinstance(kind.valueType, T.AtomicType) else F.transform(F.array_sort(F.map_keys(value)), lambda k: F.struct(k.alias("key"), F.element_at(value, k).alias("value")))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], kind.valueType).alias("value"))))
    return value


def canonical_digest(kinds: dict[str, T.DataType] | None = None, **fields: Column) -> Column:
    """The digest of a JSON object with its keys in order and nothing between its parts; null fields are written as null. kinds
    are the types of fields that have keys of their own, which are ordered at every level then."""
    whole = F.struct(*(canonical(fields[k], (kinds or {}).get(k, T.NullType())).alias(k) for k in sorted(fields)))
    return F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256)


def percent(value: Column, digits: int = 1) -> Column:
    return F.coalesce(F.when(value.isNotNull(), F.format_string(f"%.{digits}f%%", 100 * value)), F.lit("-"))


def interval(low: Column, high: Column, digits: int = 3) -> Column:
    shown = lambda v: F.format_string(f"%.{digits}f", v)
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("["), shown(low), F.lit(", "), shown(high), F.lit("]"))).otherwise(F.lit("-"))
