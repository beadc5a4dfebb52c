"""Schemas as text, and the value rules of the table model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {
    "int": T.LongType(),
    "float": T.DoubleType(),
    "str": T.StringType(),
    "bool": T.BooleanType(),
    "bytes": T.BinaryType(),
    "timestamp": T.TimestampNTZType(),
}


def parse_schema(text: str) -> T.StructType:
    """``name:type, ...`` as a schema; an unknown type or an empty name is an error, never a guess."""
    fields = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, mark, kind = (x.strip() for x in part.partition(":"))
        if not name or not mark or kind not in TYPES:
            raise ValueError(f"bad column {part!r}; types are {sorted(TYPES)}")
        fields.append(T.StructField(name, TYPES[kind]))
    return T.StructType(fields)


def schema_text(schema: T.StructType) -> str:
    """The text form of a schema of flat types; narrower numbers take the name of the type that holds them."""
    names = {type(v): k for k, v in TYPES.items()} | {T.IntegerType: "int", T.ShortType: "int", T.ByteType: "int", T.FloatType: "float", T.TimestampType: "timestamp"}
    out = []
    for f in schema:
        if type(f.dataType) not in names:
            raise ValueError(f"{f.name}: {f.dataType.simpleString()} has no text form")
        out.append(f"{f.name}:{names[type(f.dataType)]}")
    return ",".join(out)


def as_int(c: Column) -> Column:
    """Whole part of a number (towards zero), booleans as 0 or 1; null stays null."""
    return c.cast("bigint")


def as_float(c: Column) -> Column:
    return c.cast("double")


def as_bool(c: Column) -> Column:
    """True for whole numbers other than 0 and for ``true`` in any case; null stays null, anything else is false."""
    text = F.lower(c.cast("string"))
    return F.when(text.isNotNull(), (text == "true") | F.coalesce(text.try_cast("bigint") != 0, F.lit(False)))


def is_numeric(c: Column) -> Column:
    """Whether a text looks like a number: digits and dots after at most one leading minus; the marker ``NULL`` counts too."""
    return (c == "NULL") | c.rlike(r"^-?[0-9.]*$")


def display(c: Column, kind: T.DataType) -> Column:
    """A cell as text: ``null``, floats with at most 8 decimals and no trailing zeros, bytes as their number, and nested values in
    ``{k:v}``, ``[a, b]`` and ``{k=>v}`` form."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        shown = F.regexp_replace(F.format_string("%.8f", c.cast("double")), r"\.?0+$", "")
    elif isinstance(kind, T.BinaryType):
        shown = F.concat(F.lit("<"), F.length(c).cast("string"), F.lit(" bytes>"))
    elif isinstance(kind, T.ArrayType):
        shown = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: display(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.StructType):
        shown = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f"{f.name}:"), display(c[f.name], f.dataType)) for f in kind]), F.lit("}"))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(c), lambda e: F.concat(display(e["key"], kind.keyType), F.lit("=>"), display(e["value"], kind.valueType)))
        shown = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    else:
        shown = c.cast("string")
    return F.coalesce(shown, F.lit("null"))
