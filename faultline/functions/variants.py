"""Reading loosely typed JSON fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.regex import unicode_regex
from faultline.functions.text import strip

_INTEGER = unicode_regex(r"^[+-]?\d+(?:_\d+)*$")
_WHOLE = unicode_regex(r"^[+-]?\d+(?:_\d+)*(?:\.0+)?$")
_DECIMAL = unicode_regex(
    r"^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?$"
)


def parse_document(text: Column) -> Column:
    """The single JSON value in ``text``; null if it is not exactly one value.

    The JSON parser stops after the first value, so the text is wrapped in an
    array: anything after the value then is an error or a second element.
    """
    values = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).cast("array<variant>")
    return F.when(F.size(values) == 1, values[0])


def child(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "variant")


def kind(value: Column) -> Column:
    """STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, ARRAY, OBJECT or VOID; null if absent."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def is_kind(value: Column, *kinds: str) -> Column:
    return F.coalesce(kind(value).isin(*kinds), F.lit(False))


def items(value: Column) -> Column:
    """Elements of a JSON list; null for anything else."""
    return F.when(is_kind(value, "ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def as_text(value: Column) -> Column:
    """Text of a scalar, spelled as the producers of these documents spell it."""
    text = string(value)
    whole_float = F.schema_of_variant(value).rlike(r"^DECIMAL\((?:\d|1[0-8]),0\)$")
    return (
        F.when(is_kind(value, "BOOLEAN"), F.initcap(text))
        .when(is_kind(value, "VOID"), "None")
        .when(whole_float, F.concat(text, F.lit(".0")))
        .otherwise(text)
    )


def is_truthy(value: Column) -> Column:
    """Present and neither null, false, zero, nor an empty string, list or object."""
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce(
        F.when(is_kind(value, "VOID"), False)
        .when(is_kind(value, "STRING"), string(value) != "")
        .when(is_kind(value, "BOOLEAN"), F.try_variant_get(value, "$", "boolean"))
        .when(is_kind(value, "ARRAY", "OBJECT"), ~string(value).isin("[]", "{}"))
        .otherwise(number != 0),
        F.lit(False),
    )


def _digits(value: Column) -> Column:
    return F.replace(strip(string(value)), F.lit("_"), F.lit(""))


def truncated_int(value: Column) -> Column:
    """Integer of a number (fraction cut), boolean or digit string; null if it is none."""
    return (
        F.when(
            is_kind(value, "STRING"),
            F.when(strip(string(value)).rlike(_INTEGER), _digits(value).try_cast("bigint")),
        )
        .when(is_kind(value, "BOOLEAN"), F.try_variant_get(value, "$", "boolean").cast("bigint"))
        .otherwise(F.try_variant_get(value, "$", "decimal(38,9)").try_cast("bigint"))
    )


def is_whole_number(value: Column) -> Column:
    """Accepted as an integer: also ``14.0``, ``"14"`` and booleans, but not ``14.5``."""
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce(
        F.when(is_kind(value, "STRING"), strip(string(value)).rlike(_WHOLE))
        .when(is_kind(value, "BIGINT", "BOOLEAN"), True)
        .when(is_kind(value, "DECIMAL", "DOUBLE"), number == F.floor(number)),
        F.lit(False),
    )


def whole_number(value: Column) -> Column:
    cut = F.regexp_replace(_digits(value), r"\.0+$", "")
    return F.when(is_kind(value, "STRING"), cut.try_cast("bigint")).otherwise(
        truncated_int(value)
    )


def real_number(value: Column) -> Column:
    """Accepted as a float: numbers, booleans and numeric strings; else null."""
    return F.when(
        is_kind(value, "STRING"),
        F.when(strip(string(value)).rlike(_DECIMAL), _digits(value).try_cast("double")),
    ).when(
        is_kind(value, "BOOLEAN"), F.try_variant_get(value, "$", "boolean").cast("int").cast("double")
    ).otherwise(F.try_variant_get(value, "$", "double"))
