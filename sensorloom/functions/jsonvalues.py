"""Typed access to free-form JSON payloads through the VARIANT type.

A payload is parsed once into a variant; from then on a number, a numeric
string and a boolean stay distinguishable, which plain `map<string,string>`
parsing would lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .deep import deep_leaves

OBJECT = "map<string,variant>"
# Levels of objects that expressions unroll; payloads with more are walked by
# `deep`.
UNROLLED = 4


def as_object(value: Column) -> Column:
    """The members of a JSON object, null for any other JSON value."""
    return F.try_variant_get(value, "$", OBJECT)


def type_name(value: Column) -> Column:
    return F.schema_of_variant(value)


# How the type names of JSON numbers begin (BIGINT, DECIMAL,
# DOUBLE, FLOAT).
_NUMERIC = ("BIG", "DEC", "DOU", "FLO")


def numeric_kind(kind: Column) -> Column:
    """True for JSON numbers; booleans and numeric strings are not numbers."""
    return F.substring(kind, 1, 3).isin(*_NUMERIC)


def object_kind(kind: Column) -> Column:
    return kind.startswith("OBJECT")


def is_number(value: Column) -> Column:
    return numeric_kind(type_name(value))


def is_object(value: Column) -> Column:
    return object_kind(type_name(value))


def as_double(value: Column) -> Column:
    """For values known to be numbers."""
    return F.try_variant_get(value, "$", "double")


def number(value: Column) -> Column:
    """Value of a JSON number as double, null for every other type."""
    return F.when(is_number(value), as_double(value))


# Spellings of a number that a text field may use. A trailing
# type letter, which the cast alone would accept, is not among them.
_DIGITS = r"[0-9]+(_[0-9]+)*"
_NUMBER_TEXT = (
    rf"^[+-]?(({_DIGITS}\.?({_DIGITS})?)|(\.{_DIGITS}))([eE][+-]?{_DIGITS})?$"
    r"|^[+-]?(?i:nan|inf|infinity)$"
)


def text_to_double(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    plain = F.regexp_replace(trimmed, "_", "")
    return F.when(trimmed.rlike(_NUMBER_TEXT), plain.try_cast("double"))


def coerced_double(value: Column, kind: Column | None = None) -> Column:
    """Number, boolean (as 0 or 1) or numeric text as double; else null."""
    kind = type_name(value) if kind is None else kind
    return (
        F.when(numeric_kind(kind), as_double(value))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
        .when(kind == "STRING", text_to_double(F.try_variant_get(value, "$", "string")))
    )


def members(value: Column) -> Column:
    """array<struct<key, value, kind>> of an object, empty for other values.

    `kind` is the type name, looked up once here and not at each use.
    """
    return F.transform(
        F.coalesce(
            F.map_entries(as_object(value)),
            F.array().cast("array<struct<key:string,value:variant>>"),
        ),
        lambda m: F.struct(m["key"].alias("key"), m["value"].alias("value"), type_name(m["value"]).alias("kind")),
    )


def objects(value: Column) -> Column:
    """array<struct<key, inner>> of the members that are objects themselves."""
    entries = F.coalesce(
        F.map_entries(as_object(value)), F.array().cast("array<struct<key:string,value:variant>>")
    )
    opened = F.transform(
        entries, lambda m: F.struct(m["key"].alias("key"), as_object(m["value"]).alias("inner"))
    )
    return F.filter(opened, lambda m: m["inner"].isNotNull())


def entries_with_kind(inner: Column) -> Column:
    return F.transform(
        F.map_entries(inner),
        lambda m: F.struct(m["key"].alias("key"), m["value"].alias("value"), type_name(m["value"]).alias("kind")),
    )


def explode_numbers(
    rows: DataFrame, value: str = "_payload", into: str = "_leaf", text: str = "payload", depth: int = UNROLLED
) -> DataFrame:
    """One row per number anywhere inside an object, as struct `into`:
    (top, key, value double). `top` is the key of the outermost member the
    number sits in, null for a member of the object itself; `key` is the
    number's own name.

    The levels are columns of the same row, each made from the objects of the
    one before, so there is neither a self-union nor a pass per level. A payload
    with more levels than `depth` is read whole from its `text` instead.
    """
    levels = []
    for i in range(depth):
        if i == 0:
            level = F.transform(
                members(F.col(value)),
                lambda m: F.struct(
                    F.lit(None).cast("string").alias("top"), m["key"].alias("key"), m["value"].alias("value"), m["kind"].alias("kind")
                ),
            )
        else:
            level = F.flatten(
                F.transform(
                    F.filter(F.col(f"_level{i - 1}"), lambda m: object_kind(m["kind"])),
                    lambda m: F.transform(
                        members(m["value"]),
                        lambda inner: F.struct(
                            F.coalesce(m["top"], m["key"]).alias("top"),
                            inner["key"].alias("key"),
                            inner["value"].alias("value"),
                            inner["kind"].alias("kind"),
                        ),
                    ),
                )
            )
        rows = rows.withColumn(f"_level{i}", level)
        levels.append(f"_level{i}")
    found = F.transform(
        F.filter(F.concat(*levels), lambda m: numeric_kind(m["kind"])),
        lambda m: F.struct(m["top"].alias("top"), m["key"].alias("key"), as_double(m["value"]).alias("value")),
    )
    too_deep = F.exists(F.col(levels[-1]), lambda m: object_kind(m["kind"]))
    rows = rows.withColumn("_deep", deep_leaves(F.when(too_deep, F.col(text))))
    checked = F.coalesce("_deep", found)
    # An inner explode would make the optimizer evaluate the array once more in
    # a filter for emptiness.
    return rows.withColumn(into, F.explode_outer(checked)).where(F.col(into).isNotNull()).drop("_deep", *levels)
