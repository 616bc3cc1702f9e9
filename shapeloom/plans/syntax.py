"""The JSON syntax of layouts: strict parsing and compilation to ``layouts``.

Errors name the place in the document (a path of keys) and what was expected there.
"""

from __future__ import annotations

import json
import re
from typing import Any

from shapeloom.functions.regexp import parse as parse_regexp
from shapeloom.functions.terms import RDF_FIRST, RDF_NIL, RDF_REST, XSD_BOOLEAN, XSD_STRING, iri, literal, resolve
from shapeloom.plans.layouts import KEEP, Always, Call, Data, Id, Layout, LayoutError, Layouts, Never, Ordered, Part, Pattern, Product, Quad, Sized, Sum, Unit, Unordered

TYPES = ("unit", "boolean", "number", "bytes", "string", "id", "record", "sum", "set", "list", "tuple", "union", "intersection")
HEADER = ("type", "base", "prefixes", "id", "input", "intro", "dataset", "extra")
KEYS = {
    "unit": ("const",),
    "boolean": ("resource", "datatype"),
    "number": ("resource", "datatype"),
    "bytes": ("resource", "datatype"),
    "string": ("resource", "datatype", "pattern"),
    "id": ("resource", "pattern"),
    "record": ("fields",),
    "sum": ("variants",),
    "set": ("item",),
    "list": ("node", "head", "tail"),
    "tuple": ("items",),
}
#: Letters, digits and underscore, not led by a digit.
VARIABLE = re.compile(r"[^\W\d]\w*\Z")


class SyntaxError_(LayoutError):
    def __init__(self, at: str, what: str):
        super().__init__(f"{at or '$'}: {what}")
        self.at, self.what = at, what


def _pairs(pairs: list[tuple[str, Any]]) -> dict:
    out: dict = {}
    for k, v in pairs:
        if k in out:
            raise SyntaxError_("", f"duplicate key {k!r}")
        out[k] = v
    return out


def _object(x: Any, at: str, keys: tuple[str, ...] | None = None) -> dict:
    if not isinstance(x, dict):
        raise SyntaxError_(at, f"expected an object, found {_kind(x)}")
    if keys is not None and (unknown := sorted(set(x) - set(keys))):
        raise SyntaxError_(f"{at}.{unknown[0]}", f"unexpected key, expected one of {', '.join(keys)}")
    return x


def _kind(x: Any) -> str:
    return "null" if x is None else "a boolean" if isinstance(x, bool) else "a number" if isinstance(x, int | float) else "a string" if isinstance(x, str) else "an array" if isinstance(x, list) else "an object"


def _string(x: Any, at: str) -> str:
    if not isinstance(x, str):
        raise SyntaxError_(at, f"expected a string, found {_kind(x)}")
    return x


def _many(x: Any, at: str) -> list:
    return x if isinstance(x, list) else [x]


class Scope:
    """Variables by name, and prefixes and base; nested layouts inherit only the latter two."""

    def __init__(self, base: str | None = None, prefixes: dict[str, str] | None = None):
        self.base, self.prefixes = base, dict(prefixes or {})
        self.names: dict[str, int] = {}
        self.size = 0

    def inner(self) -> Scope:
        out = Scope(self.base, self.prefixes)
        out.names, out.size = dict(self.names), self.size
        return out

    def without_variables(self) -> Scope:
        return Scope(self.base, self.prefixes)

    def bind(self, names: list[str], at: str) -> int:
        for name in names:
            if not VARIABLE.match(_string(name, at)):
                raise SyntaxError_(at, f"invalid variable name {name!r}")
            self.names[name] = self.size  # a name may hide an earlier one
            self.size += 1
        return len(names)

    def iri(self, x: Any, at: str) -> str:
        try:
            return resolve(_string(x, at), self.base, self.prefixes)
        except LayoutError:
            raise
        except ValueError as e:
            raise SyntaxError_(at, str(e)) from None

    def ref(self, x: Any, at: str) -> str:
        return x if _string(x, at).startswith("_:") else iri(self.iri(x, at))

    def pattern(self, x: Any, at: str) -> Pattern:
        if isinstance(x, dict):
            _object(x, at, ("value", "type", "language"))
            if "value" not in x or ("type" in x) == ("language" in x):
                raise SyntaxError_(at, "a literal has a value and either a type or a language")
            value = _string(x["value"], f"{at}.value")
            return literal(value, lang=_string(x["language"], at)) if "language" in x else literal(value, self.iri(x["type"], f"{at}.type"))
        if _string(x, at).startswith("_:"):
            name = x[2:]
            if name not in self.names:
                raise SyntaxError_(at, f"undeclared variable {name!r}")
            return self.names[name]
        return iri(self.iri(x, at))

    def dataset(self, x: Any, at: str) -> tuple[Quad, ...]:
        if x is None:
            return ()
        if not isinstance(x, list):
            raise SyntaxError_(at, f"expected an array, found {_kind(x)}")
        out = []
        for i, q in enumerate(x):
            if not isinstance(q, list) or len(q) not in (3, 4):
                raise SyntaxError_(f"{at}[{i}]", "expected an array of 3 or 4 patterns")
            parts = [self.pattern(t, f"{at}[{i}][{k}]") for k, t in enumerate(q)]
            out.append((*parts[:3], parts[3] if len(parts) == 4 else None))
        return tuple(dict.fromkeys(out))


class _Compiler:
    def __init__(self, layouts: Layouts):
        self.layouts = layouts

    def layout(self, x: Any, outer: Scope, at: str = "") -> str:
        if isinstance(x, bool):
            ref = "_:always" if x else "_:never"
            if ref not in self.layouts:
                self.layouts.insert((Always if x else Never)(ref))
            return ref
        kind = _object(x, at).get("type")
        if kind is None:
            raise SyntaxError_(at, "missing key 'type'")
        if kind not in TYPES:
            raise SyntaxError_(f"{at}.type", f"unknown layout type {kind!r}, expected one of {', '.join(TYPES)}")
        if kind in ("union", "intersection"):
            raise SyntaxError_(f"{at}.type", f"{kind} layouts have no evaluation")
        _object(x, at, HEADER + KEYS[kind])
        scope = outer.without_variables()
        for name, value in _object(x.get("prefixes", {}), f"{at}.prefixes").items():
            scope.prefixes[name] = outer.iri(value, f"{at}.prefixes.{name}")
        if "base" in x:
            scope.base = outer.iri(x["base"], f"{at}.base")
        ref = scope.ref(x["id"], f"{at}.id") if "id" in x else self.layouts.new_id()
        inputs = scope.bind(_many(x.get("input", "self"), at), f"{at}.input")
        intro = scope.bind(_many(x.get("intro", []), at), f"{at}.intro")
        extra = tuple((scope.iri(k, f"{at}.extra"), self.extra(v, scope, f"{at}.extra.{k}")) for k, v in _object(x.get("extra", {}), f"{at}.extra").items())
        head = {"id": ref, "inputs": inputs, "intro": intro, "dataset": scope.dataset(x.get("dataset"), f"{at}.dataset"), "extra": extra}
        made = getattr(self, f"_{kind}")(x, scope, at, head)
        self.layouts.insert(made)
        return ref

    def extra(self, v: Any, scope: Scope, at: str) -> Any:
        if isinstance(v, dict):
            _object(v, at, ("value", "type"))
            return (_string(v.get("value"), at), scope.iri(v.get("type"), at))
        if isinstance(v, bool | int | str):
            return v
        raise SyntaxError_(at, f"expected a boolean, integer, string or literal, found {_kind(v)}")

    def call(self, x: Any, scope: Scope, at: str, default: str = "_:value") -> Call:
        graph, given = KEEP, default
        if isinstance(x, dict) and "type" not in x:
            _object(x, at, ("layout", "input", "graph"))
            if "layout" not in x:
                raise SyntaxError_(at, "missing key 'layout'")
            given, target = x.get("input", default), x["layout"]
            if x.get("graph") is not None:
                graph = scope.pattern(x["graph"], f"{at}.graph")
            at = f"{at}.layout"
        else:
            target = x
        ref = scope.ref(target, at) if isinstance(target, str) else self.layout(target, scope, at)
        return Call(ref, tuple(scope.pattern(p, f"{at}.input") for p in _many(given, at)), graph)

    def resource(self, x: dict, scope: Scope, at: str, head: dict) -> Pattern:
        if "resource" in x:
            return scope.pattern(x["resource"], f"{at}.resource")
        if not head["inputs"]:
            raise SyntaxError_(at, "a literal layout without input needs a resource")
        return 0

    def _unit(self, x, scope, at, head) -> Layout:
        return Unit(**head, const=x.get("const"))

    def _data(self, kind, default, x, scope, at, head) -> Layout:
        if "datatype" not in x and default is None:
            raise SyntaxError_(at, "missing key 'datatype'")
        datatype = scope.iri(x["datatype"], f"{at}.datatype") if "datatype" in x else default
        if "pattern" in x:
            parse_regexp(_string(x["pattern"], f"{at}.pattern"))
        return Data(**head, kind=kind, datatype=datatype, resource=self.resource(x, scope, at, head), pattern=x.get("pattern"))

    def _boolean(self, *a) -> Layout:
        return self._data("boolean", XSD_BOOLEAN, *a)

    def _number(self, *a) -> Layout:
        return self._data("number", None, *a)

    def _bytes(self, *a) -> Layout:
        return self._data("bytes", None, *a)

    def _string(self, *a) -> Layout:
        return self._data("string", XSD_STRING, *a)

    def _id(self, x, scope, at, head) -> Layout:
        if "pattern" in x:
            parse_regexp(_string(x["pattern"], f"{at}.pattern"))
        return Id(**head, resource=self.resource(x, scope, at, head), pattern=x.get("pattern"))

    def part(self, name: str, x: Any, scope: Scope, at: str, head: dict, keys: tuple[str, ...], intro: Any = "value", default: str = "_:value") -> Part:
        _object(x, at, keys)
        if "value" not in x:
            raise SyntaxError_(at, "missing key 'value'")
        inner = scope.inner()
        n = inner.bind(_many(x.get("intro", intro), at), f"{at}.intro")
        dataset = inner.dataset(x.get("dataset"), f"{at}.dataset")
        if "property" in x:
            if not head["inputs"]:
                raise SyntaxError_(at, "a property needs an input as its subject")
            if not n:
                raise SyntaxError_(at, "a property needs an introduced variable as its object")
            dataset = tuple(dict.fromkeys([*dataset, (0, inner.pattern(x["property"], f"{at}.property"), scope.size, None)]))
        required = x.get("required", False)
        if not isinstance(required, bool):
            raise SyntaxError_(f"{at}.required", f"expected a boolean, found {_kind(required)}")
        return Part(name, n, dataset, self.call(x["value"], inner, f"{at}.value", default), required)

    def _record(self, x, scope, at, head) -> Layout:
        fields = _object(x.get("fields", {}), f"{at}.fields")
        keys = ("intro", "value", "dataset", "property", "required")
        return Product(**head, fields=tuple(self.part(k, fields[k], scope, f"{at}.fields.{k}", head, keys) for k in sorted(fields)))

    def _sum(self, x, scope, at, head) -> Layout:
        variants = _object(x.get("variants", {}), f"{at}.variants")
        return Sum(**head, variants=tuple(self.part(k, variants[k], scope, f"{at}.variants.{k}", head, ("intro", "value", "dataset"), [], "_:self") for k in sorted(variants)))

    def _set(self, x, scope, at, head) -> Layout:
        if "item" not in x:
            raise SyntaxError_(at, "missing key 'item'")
        return Unordered(**head, item=self.part("item", x["item"], scope, f"{at}.item", head, ("intro", "value", "dataset", "property")))

    def _tuple(self, x, scope, at, head) -> Layout:
        items = x.get("items", [])
        if not isinstance(items, list):
            raise SyntaxError_(f"{at}.items", f"expected an array, found {_kind(items)}")
        return Sized(**head, items=tuple(self.part(f"_{i}", v, scope, f"{at}.items[{i}]", head, ("intro", "value", "dataset", "property")) for i, v in enumerate(items)))

    def _list(self, x, scope, at, head) -> Layout:
        if "node" not in x:
            raise SyntaxError_(at, "missing key 'node'")
        node, where = x["node"], f"{at}.node"
        bare = not isinstance(node, dict) or "type" in node
        if bare:
            node = {"value": node}
        _object(node, where, ("head", "rest", "intro", "value", "dataset", "property"))
        inner = scope.inner()
        inner.bind([node.get("head", "head"), node.get("rest", "rest")], where)
        intro = _many(node.get("intro", "value"), where)
        n = inner.bind(intro, f"{where}.intro")
        value = self.call(node["value"], inner, f"{where}.value")
        first, rest = scope.size, scope.size + 1
        if "dataset" in node:
            dataset = inner.dataset(node["dataset"], f"{where}.dataset")
        elif n == 1:
            dataset = ((first, iri(RDF_FIRST), first + 2, None), (first, iri(RDF_REST), rest, None))
        else:
            dataset = ()
        return Ordered(**head, node=Part("node", n, dataset, value), head=scope.pattern(x.get("head", "_:self"), f"{at}.head"), tail=scope.pattern(x.get("tail", RDF_NIL), f"{at}.tail"))


def build(source: Any, layouts: Layouts) -> str:
    """Compiles a layout document into the registry; returns its reference."""
    if isinstance(source, str):
        try:
            source = json.loads(source, object_pairs_hook=_pairs)
        except json.JSONDecodeError as e:
            raise SyntaxError_("", f"no JSON: {e}") from None
    return _Compiler(layouts).layout(source, Scope())
