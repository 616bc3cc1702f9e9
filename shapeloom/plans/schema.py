"""From layouts to types: Spark schema, DDL, JSON Schema."""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as S

from shapeloom.functions.values import DECIMAL, NUMBER_TYPES
from shapeloom.plans.layouts import Always, Call, Data, Id, Layouts, Never, Ordered, Product, Sized, Sum, Unit, Unordered

_SPARK = {"tinyint": S.ByteType(), "smallint": S.ShortType(), "int": S.IntegerType(), "bigint": S.LongType()}


def _number(datatype: str) -> S.DataType:
    name = NUMBER_TYPES.get(datatype, DECIMAL)
    return _SPARK[name] if name in _SPARK else S.DecimalType(*map(int, name[8:-1].split(",")))


def to_spark_type(layouts: Layouts, ref: str, seen: frozenset[str] = frozenset()) -> S.DataType:
    """The type of hydrated values. A layout that contains itself is JSON text."""
    layout = layouts[ref]
    if ref in seen or layouts.recursive(ref):
        return S.StringType()
    seen = seen | {ref}
    of = lambda call: to_spark_type(layouts, call.ref, seen)
    if isinstance(layout, Data):
        return {"boolean": S.BooleanType(), "bytes": S.BinaryType(), "string": S.StringType()}.get(layout.kind) or _number(layout.datatype)
    if isinstance(layout, Product):
        return S.StructType([S.StructField(f.name, of(f.value), not f.required) for f in layout.fields])
    if isinstance(layout, Sum):
        return S.StructType([S.StructField("tag", S.IntegerType()), *(S.StructField(v.name, of(v.value)) for v in layout.variants)])
    if isinstance(layout, Sized):
        return S.StructType([S.StructField(f"_{i}", of(x.value)) for i, x in enumerate(layout.items)])
    if isinstance(layout, Unordered | Ordered):
        return S.ArrayType(of((layout.item if isinstance(layout, Unordered) else layout.node).value))
    if isinstance(layout, Unit):
        return S.BooleanType() if layout.const is None or isinstance(layout.const, bool) else S.StringType()
    return S.StringType()  # ids; nothing and anything have no type of their own


def to_spark_schema(layouts: Layouts, ref: str) -> S.StructType:
    found = to_spark_type(layouts, ref)
    return found if isinstance(found, S.StructType) else S.StructType([S.StructField("value", found)])


def to_ddl(layouts: Layouts, ref: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}" for f in to_spark_schema(layouts, ref))


def type_name(words: str) -> str:
    """PascalCase: ``my-layout name`` is MyLayoutName."""
    out, up = [], True
    for c in words:
        if c.isalnum():
            out.append(c.upper() if up else c)
            up = False
        else:
            up = True
    name = "".join(out)
    return "_" + name if name[:1].isdigit() else name


def to_json_schema(layouts: Layouts, ref: str) -> dict[str, Any]:
    """A JSON Schema of the hydrated JSON; shared and recursive layouts are definitions."""
    defs: dict[str, Any] = {}
    names: dict[str, str] = {}

    def name_of(r: str) -> str:
        if r not in names:
            base = type_name(r.strip("<>").replace("_:", "").rstrip("/#").rpartition("#")[2].rpartition("/")[2]) or "Layout"
            names[r] = base if base not in names.values() else f"{base}{len(names)}"
        return names[r]

    def of(call: Call) -> dict[str, Any]:
        if not call.ref.startswith("<") and not layouts.recursive(call.ref):
            return one(call.ref)
        name = name_of(call.ref)
        if name not in defs:
            defs[name] = {}
            defs[name] = one(call.ref)
        return {"$ref": f"#/$defs/{name}"}

    def one(r: str) -> dict[str, Any]:
        layout = layouts[r]
        if isinstance(layout, Never):
            return {"not": {}}
        if isinstance(layout, Always):
            return {}
        if isinstance(layout, Unit):
            return {"const": layout.const}
        if isinstance(layout, Id):
            return {"type": "string", "format": "iri"}
        if isinstance(layout, Data):
            whole = layout.kind == "number" and NUMBER_TYPES.get(layout.datatype, DECIMAL) != DECIMAL
            return {"type": "integer" if whole else layout.kind if layout.kind in ("boolean", "number") else "string"}
        if isinstance(layout, Product):
            out: dict[str, Any] = {"type": "object", "properties": {f.name: of(f.value) for f in layout.fields}, "additionalProperties": False}
            required = [f.name for f in layout.fields if f.required]
            return out | ({"required": required} if required else {})
        if isinstance(layout, Sum):
            return {"oneOf": [of(v.value) for v in layout.variants]}
        if isinstance(layout, Sized):
            return {"type": "array", "prefixItems": [of(x.value) for x in layout.items], "minItems": len(layout.items), "maxItems": len(layout.items)}
        return {"type": "array", "items": of((layout.item if isinstance(layout, Unordered) else layout.node).value)}

    out = {"$schema": "https://json-schema.org/draft/2020-12/schema"} | of(Call(ref, (0,)))
    return out | ({"$defs": defs} if defs else {})
