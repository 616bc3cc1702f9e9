"""Layouts from annotated classes.

    @layout(prefixes={"ex": "https://example.org/"}, id="ex:Person")
    class Person:
        name: str = prop("ex:name")
        age: Optional[U8] = prop("ex:age")
        friends: set[Id] = prop("ex:friend")

Fields that aren't Optional are required. ``Layouts().add(Person.layout)`` compiles it.

A class may also be a set, a list, a unit or a literal of its own:

    @layout("list", head="_:self", tail="https://example.org/end")
    class Steps:
        step: str = prop(head="here", rest="there", intro="x", input="_:x", dataset=[...])

    @layout("string", pattern="[A-Z]+")
    class Code: ...
"""

from __future__ import annotations

import typing
from dataclasses import dataclass
from decimal import Decimal
from typing import Any, ForwardRef

from shapeloom.functions.terms import XSD
from shapeloom.plans.layouts import LayoutError


class Id:
    """An IRI."""


def _alias(name: str, datatype: str) -> type:
    return type(name, (), {"datatype": XSD + datatype})


U8, U16, U32, U64 = (_alias(n, d) for n, d in (("U8", "unsignedByte"), ("U16", "unsignedShort"), ("U32", "unsignedInt"), ("U64", "unsignedLong")))
I8, I16, I32, I64 = (_alias(n, d) for n, d in (("I8", "byte"), ("I16", "short"), ("I32", "int"), ("I64", "long")))
_PLAIN = {str: {"type": "string"}, bool: {"type": "boolean"}, Id: {"type": "id"}, int: {"type": "number", "datatype": XSD + "integer"}, Decimal: {"type": "number", "datatype": XSD + "decimal"}}


@dataclass(frozen=True)
class Prop:
    property: str | None
    options: tuple[tuple[str, Any], ...]


def prop(property: str | None = None, **options: Any) -> Any:
    """How a field, item or variant is found: its property, or ``dataset`` and ``intro``;
    ``input``, ``graph``, ``datatype`` and ``layout`` concern its value."""
    return Prop(property, tuple(options.items()))


def _value(kind: Any, options: dict[str, Any]) -> Any:
    """The layout of an annotation."""
    if "layout" in options:
        return options["layout"]
    if isinstance(kind, str | ForwardRef):
        raise LayoutError(f"name the layout of {kind!r} with layout=...")
    if hasattr(kind, "layout"):
        return kind.layout["id"] if "id" in kind.layout and options.get("by_id") else kind.layout
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    inner = {k: v for k, v in options.items() if k in ("datatype", "item")}
    if origin in (set, frozenset):
        return {"type": "set", "item": {"property": inner.pop("item"), "value": _value(args[0], inner)} if "item" in inner else {"intro": [], "value": {"layout": _value(args[0], inner), "input": "_:self"}}}
    if origin is list:
        return {"type": "list", "node": _value(args[0], inner)}
    if kind in _PLAIN:
        out = dict(_PLAIN[kind])
    elif hasattr(kind, "datatype"):
        out = {"type": "number", "datatype": kind.datatype}
    else:
        raise LayoutError(f"no layout for {kind!r}")
    return out | ({"datatype": options["datatype"]} if "datatype" in options else {})


def _part(kind: Any, found: Prop) -> dict[str, Any]:
    options = dict(found.options)
    value: Any
    if typing.get_origin(kind) in (set, frozenset) and found.property is not None and "item" not in options:
        # A set over a property: the field stays with the subject, each item has the property.
        item = {"property": found.property, "value": _value(typing.get_args(kind)[0], options)}
        return {"intro": [], "value": {"layout": {"type": "set", "item": item}, "input": "_:self"}}
    value = _value(kind, options)
    if "input" in options or "graph" in options:
        value = {"layout": value} | {k: options[k] for k in ("input", "graph") if k in options}
    out: dict[str, Any] = {"value": value} | ({"property": found.property} if found.property is not None else {})
    return out | {k: options[k] for k in ("intro", "dataset", "head", "rest") if k in options}


#: Kinds of classes without annotations; what they hold is said by keywords (const, datatype,
#: pattern, resource).
LEAVES = ("unit", "boolean", "number", "bytes", "string", "id")


def layout(kind: str = "record", **header: Any):
    """Class decorator: sets ``layout``, a JSON document. ``kind``: record, sum, tuple, set or
    list (of one annotation), or one of ``LEAVES``; keywords are the keys of the header (base,
    prefixes, id, input, intro, dataset, extra) and of the kind (head, tail, const, datatype ...)."""

    def decorate(cls: type) -> type:
        if kind in LEAVES:
            cls.layout = {"type": kind} | header
            return cls
        hints = typing.get_type_hints(cls)
        parts: dict[str, dict[str, Any]] = {}
        for name, hint in hints.items():
            found = getattr(cls, name, None)
            found = found if isinstance(found, Prop) else Prop(None, ())
            args = typing.get_args(hint)
            optional = type(None) in args
            inner = next(a for a in args if a is not type(None)) if optional else hint
            parts[name] = _part(inner, found)
            if kind == "record" and not optional and not parts[name].get("intro") == []:
                parts[name]["required"] = True
        if kind in ("set", "list"):
            if len(parts) != 1:
                raise LayoutError(f"a {kind} has one annotation, not {len(parts)}")
            (only,) = parts.values()
            body = {"item": only} if kind == "set" else {"node": only if len(only) > 1 else only["value"]}
        else:
            body = {"record": {"fields": parts}, "sum": {"variants": parts}, "tuple": {"items": list(parts.values())}}[kind]
        cls.layout = {"type": kind} | header | body
        return cls

    return decorate
