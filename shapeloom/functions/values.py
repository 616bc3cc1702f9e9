"""Tree values as column expressions: canonical JSON, total order, numbers."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from shapeloom.functions.terms import DECIMAL_PATTERN, XSD

#: Spark types of numbers by XSD datatype; all others are decimal(38,18).
NUMBER_TYPES = {
    XSD + "byte": "tinyint",
    XSD + "short": "smallint",
    XSD + "int": "int",
    XSD + "long": "bigint",
    XSD + "unsignedByte": "smallint",
    XSD + "unsignedShort": "int",
    XSD + "unsignedInt": "bigint",
    XSD + "unsignedLong": "decimal(20,0)",
    **{XSD + x: "decimal(38,0)" for x in ("integer", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger")},
}
DECIMAL = "decimal(38,18)"
#: The order of kinds of values: literals, then variants, records, lists, anything.
UNIT, BOOLEAN, NUMBER, BYTES, TEXT, ID, VARIANT, RECORD, LIST, ANY = "abcdefghij"
#: Ends a text in a sort key; lower than any character of an escaped text.
END = "\x01"


def is_number(text: Column) -> Column:
    return text.rlike(DECIMAL_PATTERN)


def canonical_number(text: Column) -> Column:
    """A decimal numeral without sign +, leading or trailing zeros; "0" for zero."""
    whole = F.regexp_replace(F.regexp_extract(text, r"^[+-]?0*([0-9]*)", 1), "^$", "0")
    part = F.regexp_replace(F.regexp_extract(text, r"[.]([0-9]*)$", 1), "0+$", "")
    size = F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    changed = F.when(F.startswith(text, F.lit("-")) & (size != "0"), F.concat(F.lit("-"), size)).otherwise(size)
    return F.when(text.rlike(r"^(0|-?[1-9][0-9]*+|-?(0|[1-9][0-9]*+)[.][0-9]*[1-9])$"), text).otherwise(changed)


def decimal_text(value: Column) -> Column:
    """The canonical numeral of a decimal with digits after the point."""
    shown = F.rtrim(F.rtrim(value.cast("string"), F.lit("0")), F.lit("."))
    return F.when(value == 0, F.lit("0")).otherwise(shown)


def number_key(canonical: Column) -> Column:
    """Sorts canonical numerals of any length as their values."""
    size = F.ltrim(canonical, F.lit("-"))
    whole = F.substring_index(size, ".", 1)
    shown = F.concat(F.lpad(F.length(whole).cast("string"), 8, "0"), size)
    negative = F.startswith(canonical, F.lit("-"))
    return F.when(negative, F.concat(F.lit("N"), F.translate(shown, "0123456789", "9876543210"), F.lit("~"))).otherwise(F.concat(F.lit("P"), shown, F.lit(END)))


def text_key(text: Column) -> Column:
    for c in "\x02\x01\x00":
        text = F.replace(text, F.lit(c), F.lit("\x02" + c))
    return F.concat(text, F.lit(END))


def json_text(text: Column) -> Column:
    """A text as a JSON string."""
    shown = F.to_json(F.array(text))
    return F.substring(shown, F.lit(2), F.length(shown) - 2)


def json_const(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def json_object(fields: list[tuple[str, Column]]) -> Column:
    """A JSON object of the fields whose value is not null."""
    shown = [F.when(value.isNotNull(), F.concat(F.lit(json_const(name) + ":"), value)) for name, value in fields]
    return F.concat(F.lit("{"), F.concat_ws(",", *shown) if shown else F.lit(""), F.lit("}"))


def first_status(*statuses: Column) -> Column:
    """The first that isn't null; null stands for success."""
    return F.coalesce(*statuses, F.lit(None).cast("string"))


#: Between a status and the steps from where it came up to the root, the innermost first.
STEP = "\x1f"


def within(status: Column, step: str | Column) -> Column:
    """The status of a part, as one of the whole: null stays null."""
    return F.concat(status, F.lit(STEP), F.lit(step) if isinstance(step, str) else F.coalesce(step.cast("string"), F.lit("")))


def status_code(status: Column) -> Column:
    return F.substring_index(status, STEP, 1)


def status_place(status: Column) -> Column:
    """The steps from the root to the value that failed, each after a slash: names of fields and
    variants, places in tuples and lists that are written, nodes and items that are read."""
    steps = F.reverse(F.slice(F.split(status, STEP), F.lit(2), F.length(status)))
    return F.array_join(F.transform(steps, lambda x: F.concat(F.lit("/"), x)), "")


#: Numerals that a decimal column of each type can't hold: of too many digits before the point,
#: or with one behind its scale that isn't 0. Other types are tried by a cast.
TOO_LONG = {DECIMAL: "^[+-]?0*[1-9][0-9]{20}|[.][0-9]{18}[0-9]*[1-9]", "decimal(38,0)": "^[+-]?0*[1-9][0-9]{38}|[.][0-9]*[1-9]", "decimal(20,0)": "^[+-]?0*[1-9][0-9]{20}|[.][0-9]*[1-9]"}


def out_of_range(text: Column, value: Column, kind: str) -> Column:
    """Whether a numeral isn't held exactly by ``value``, its cast to a column's type."""
    return text.rlike(TOO_LONG[kind]) if kind in TOO_LONG else value.isNull()


def decimal_digits(numerator: int, denominator: int) -> str | None:
    """The decimal numeral of a fraction, or None if it has no finite one."""
    sign, numerator = ("-" if (numerator < 0) != (denominator < 0) and numerator else ""), abs(numerator)
    whole, rest = divmod(numerator, abs(denominator))
    digits, seen = [], set()
    while rest:
        if rest in seen:
            return None
        seen.add(rest)
        digit, rest = divmod(rest * 10, abs(denominator))
        digits.append(str(digit))
    return f"{sign}{whole}" + ("." + "".join(digits) if digits else "")
