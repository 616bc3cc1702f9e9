"""Tables as quads: record layouts derived from a table's schema."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from shapeloom.functions.terms import XSD
from shapeloom.operators.dehydrate import dehydrate
from shapeloom.plans.layouts import Layouts

BASE = "https://example.org/"
#: XSD datatypes of Spark types.
DATATYPES = (
    (S.BooleanType, "boolean"),
    (S.ByteType, "byte"),
    (S.ShortType, "short"),
    (S.IntegerType, "int"),
    (S.LongType, "long"),
    (S.FloatType | S.DoubleType | S.DecimalType, "decimal"),
    (S.TimestampType | S.TimestampNTZType, "dateTime"),
    (S.DateType, "date"),
    (S.BinaryType, "hexBinary"),
)


def value_layout(kind: S.DataType) -> dict[str, Any]:
    name = next((n for k, n in DATATYPES if isinstance(kind, k)), "string")
    if isinstance(kind, S.ArrayType):
        return {"type": "list", "node": value_layout(kind.elementType)}
    how = "boolean" if name == "boolean" else "bytes" if name == "hexBinary" else "string" if name in ("string", "date", "dateTime") else "number"
    return {"type": how, "datatype": XSD + name}


def table_layout(schema: S.StructType, columns: list[str], base: str = BASE, required: bool = False, id_field: str | None = "id") -> dict[str, Any]:
    """A record of columns as properties ``base`` + name, with an id field."""
    fields: dict[str, Any] = {c: {"value": value_layout(schema[c].dataType), "property": base + c} | ({"required": True} if required else {}) for c in columns}
    if id_field:
        fields[id_field] = {"intro": [], "value": {"layout": {"type": "id"}, "input": "_:self"}}
    return {"type": "record", "fields": fields}


def subject(name: str, *keys: str, base: str = BASE) -> Column:
    """The IRI of a row, made from its key."""
    return F.concat(F.lit(f"{base}{name}/"), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)))


def lift(table: DataFrame, name: str, keys: list[str], columns: list[str], base: str = BASE) -> DataFrame:
    """The quads of a table: one subject a row, one property a column that isn't null. The
    key must be unique; then no quad repeats and nothing is shuffled."""
    rows = table.select(subject(name, *keys, base=base).alias("id"), *columns)
    layouts = Layouts()
    ref = layouts.add(table_layout(rows.schema, columns, base))
    return dehydrate(layouts, ref, rows, ["id"], distinct=False).quads


def link(table: DataFrame, name: str, keys: list[str], predicate: str, target: str, target_keys: list[str], base: str = BASE) -> DataFrame:
    """Quads from each row's subject to that of another table's row."""
    to = subject(target, *target_keys, base=base)
    iri = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    return table.select(iri(subject(name, *keys, base=base)).alias("s"), F.lit(f"<{base}{predicate}>").alias("p"), iri(to).alias("o"), F.lit(None).cast("string").alias("g")).where("o IS NOT NULL")
