"""Compiled layouts, their registry and the prelude.

A layout describes one shape in both directions. Variables are numbered: a layout's inputs
come first, then what it introduces, then what a field, variant, item or node introduces.
A pattern is a variable's number or a term in canonical form.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

from shapeloom.functions.terms import XSD

Pattern = int | str
Quad = tuple[Pattern, Pattern, Pattern, Pattern | None]

#: The graph of a nested call: the current one, or None for the default graph, or a pattern.
KEEP = object()


@dataclass(frozen=True)
class Call:
    """A nested value: which layout, on which resources, in which graph."""

    ref: str
    inputs: tuple[Pattern, ...]
    graph: Any = KEEP


@dataclass(frozen=True)
class Layout:
    id: str
    inputs: int = 1
    intro: int = 0
    dataset: tuple[Quad, ...] = ()
    extra: tuple[tuple[str, Any], ...] = ()

    def calls(self) -> list[Call]:
        return []


@dataclass(frozen=True)
class Never(Layout):
    pass


@dataclass(frozen=True)
class Always(Layout):
    pass


@dataclass(frozen=True)
class Unit(Layout):
    #: A JSON value.
    const: Any = None


@dataclass(frozen=True)
class Data(Layout):
    """``kind``: boolean, number, bytes or string."""

    kind: str = "string"
    datatype: str = XSD + "string"
    resource: Pattern = 0
    pattern: str | None = None


@dataclass(frozen=True)
class Id(Layout):
    resource: Pattern = 0
    pattern: str | None = None


@dataclass(frozen=True)
class Part:
    """A field, variant or item: what it introduces, its quads, its value."""

    name: str
    intro: int
    dataset: tuple[Quad, ...]
    value: Call
    required: bool = False


@dataclass(frozen=True)
class Product(Layout):
    fields: tuple[Part, ...] = ()

    def calls(self) -> list[Call]:
        return [f.value for f in self.fields]


@dataclass(frozen=True)
class Sum(Layout):
    """Variants in the order of their names."""

    variants: tuple[Part, ...] = ()

    def calls(self) -> list[Call]:
        return [v.value for v in self.variants]


@dataclass(frozen=True)
class Unordered(Layout):
    item: Part | None = None

    def calls(self) -> list[Call]:
        return [self.item.value]


@dataclass(frozen=True)
class Sized(Layout):
    items: tuple[Part, ...] = ()

    def calls(self) -> list[Call]:
        return [x.value for x in self.items]


@dataclass(frozen=True)
class Ordered(Layout):
    """The node's head and rest are the first two variables after the layout's own."""

    node: Part | None = None
    head: Pattern = 0
    tail: Pattern = ""

    def calls(self) -> list[Call]:
        return [self.node.value]


class LayoutError(ValueError):
    """A layout can't be built or found."""


ANONYMOUS = "_:layout"


def _renamed(x: Any, names: dict[str, str]) -> Any:
    """A layout, or a piece of one, with other names of layouts."""
    if isinstance(x, tuple):
        return tuple(_renamed(y, names) for y in x)
    if isinstance(x, Call):
        return replace(x, ref=names.get(x.ref, x.ref))
    if not is_dataclass(x):
        return x
    own = {f.name: _renamed(getattr(x, f.name), names) for f in fields(x)}
    return replace(x, **own | ({"id": names.get(x.id, x.id)} if isinstance(x, Layout) else {}))


@dataclass
class Layouts:
    """A registry; ``chain`` puts another one behind it, whose definitions come second."""

    table: dict[str, Layout] = field(default_factory=dict)
    behind: Layouts | None = None
    fresh: int = 0

    def add(self, source: Any) -> str:
        """Builds a layout (JSON text, or what it parses to) and returns its reference."""
        from shapeloom.plans.syntax import build

        return build(source, self)

    def new_id(self) -> str:
        self.fresh += 1
        return f"{ANONYMOUS}{self.fresh}"

    def insert(self, layout: Layout) -> None:
        if layout.id in self.table:
            raise LayoutError(f"layout {layout.id} is defined twice")
        self.table[layout.id] = layout

    def chain(self, other: Layouts) -> Layouts:
        """Anonymous layouts of ``other`` whose names this registry has too get new ones."""
        taken = [i for i in other.table if i.startswith(ANONYMOUS) and i in self]
        fresh = max(self.fresh, other.fresh)
        if taken:
            names = {i: f"{ANONYMOUS}{fresh + k}" for k, i in enumerate(taken, 1)}
            table = {names.get(i, i): _renamed(x, names) for i, x in other.table.items()}
            fresh += len(taken)
            other = Layouts(table, other.behind, fresh)
        return Layouts(self.table, other if self.behind is None else self.behind.chain(other), fresh)

    def __contains__(self, ref: str) -> bool:
        return ref in self.table or self.behind is not None and ref in self.behind

    def __getitem__(self, ref: str) -> Layout:
        if ref in self.table:
            return self.table[ref]
        if self.behind is not None:
            return self.behind[ref]
        raise LayoutError(f"LAYOUT_NOT_FOUND: {ref}")

    def __iter__(self):
        return iter(self.table)

    def call(self, call: Call) -> Layout:
        """The called layout, its number of inputs checked."""
        layout = self[call.ref]
        if not isinstance(layout, Never | Always) and layout.inputs != len(call.inputs):
            raise LayoutError(f"INVALID_INPUT_COUNT: {call.ref} takes {layout.inputs}, not {len(call.inputs)}")
        return layout

    def dependencies(self, ref: str) -> list[str]:
        return sorted({c.ref for c in self[ref].calls()})

    def reachable(self, ref: str) -> set[str]:
        """All layouts that evaluating ``ref`` may call (itself only if it's recursive)."""
        seen: set[str] = set()
        todo = [ref]
        while todo:
            for d in self.dependencies(todo.pop()):
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        return seen

    def recursive(self, ref: str) -> bool:
        return ref in self.reachable(ref)


#: The presets: name, kind, XSD datatype.
PRESETS = (
    ("id", "id", ""),
    ("unit", "unit", ""),
    ("boolean", "boolean", "boolean"),
    ("u8", "number", "unsignedByte"),
    ("u16", "number", "unsignedShort"),
    ("u32", "number", "unsignedInt"),
    ("u64", "number", "unsignedLong"),
    ("i8", "number", "byte"),
    ("i16", "number", "short"),
    ("i32", "number", "int"),
    ("i64", "number", "long"),
    ("string", "string", "string"),
)
_PRESET = re.compile(r"<[a-z]+://[^#>]+/prelude#(\w+)>")


class Prelude(Layouts):
    """The presets, under any namespace that ends in ``/prelude#``."""

    def _kind(self, ref: str) -> tuple[str, str, str] | None:
        m = _PRESET.fullmatch(ref)
        return next((p for p in PRESETS if m and p[0] == m[1]), None)

    def __contains__(self, ref: str) -> bool:
        return self._kind(ref) is not None

    def __getitem__(self, ref: str) -> Layout:
        found = self._kind(ref)
        if found is None:
            return super().__getitem__(ref)
        _, kind, datatype = found
        return Id(ref) if kind == "id" else Unit(ref) if kind == "unit" else Data(ref, kind=kind, datatype=XSD + datatype)


def prelude() -> Layouts:
    return Prelude()


def load_layouts(*paths: str, with_prelude: bool = True) -> tuple[Layouts, list[str]]:
    """The layouts of JSON files, and their references in the order of the files."""
    out = Layouts()
    refs = []
    for path in paths:
        with open(path, encoding="utf-8") as f:
            refs.append(out.add(f.read()))
    return (out.chain(prelude()) if with_prelude else out), refs
