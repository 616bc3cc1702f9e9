"""Trees to quads: one projection and one explode.

A layout is walked on the driver with column expressions for its variables' terms. A
variable gets its term from the literal or id layout that holds it, wherever in its scope
that is; else it is a blank node whose name is a hash of the row's key and the place in the
tree, so it's the same on every retry. All quads of a row are one array, made by higher-order
functions over its lists, exploded once. Rows that don't fit keep a status and emit nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from shapeloom.functions import terms as T
from shapeloom.functions import values as V
from shapeloom.functions.regexp import to_java
from shapeloom.plans.layouts import KEEP, Always, Call, Data, Id, Layout, LayoutError, Layouts, Never, Ordered, Part, Pattern, Product, Sized, Sum, Unit, Unordered

QUAD = "struct<s:string,p:string,o:string,g:string>"
QUADS = f"array<{QUAD}>"


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


class Tree:
    """A value in a row. Null columns say that the value isn't of the kind asked for."""

    col: Column

    def absent(self) -> Column:
        return self.col.isNull()


@dataclass
class Typed(Tree):
    """A column of a Spark type."""

    col: Column
    kind: S.DataType

    def is_null(self) -> Column:
        return self.col.isNull()

    def has(self, kind: str) -> Column:
        """Whether there is a value of this kind of literal."""
        fits = {"boolean": S.BooleanType, "number": S.NumericType, "bytes": S.BinaryType, "string": S.StringType | S.DateType | S.TimestampType | S.TimestampNTZType}[kind]
        return self.col.isNotNull() if isinstance(self.kind, fits) else F.lit(False)

    def boolean(self) -> Column:
        return self.col if isinstance(self.kind, S.BooleanType) else _none("boolean")

    def number(self) -> Column:
        if isinstance(self.kind, S.FloatType | S.DoubleType):
            return V.decimal_text(self.col.cast("decimal(38,18)"))
        if isinstance(self.kind, S.IntegralType) or isinstance(self.kind, S.DecimalType) and self.kind.scale == 0:
            return self.col.cast("string")
        return V.decimal_text(self.col) if isinstance(self.kind, S.DecimalType) else _none()

    def text(self) -> Column:
        if isinstance(self.kind, S.TimestampType | S.TimestampNTZType):
            return F.date_format(self.col, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        if isinstance(self.kind, S.DateType):
            return self.col.cast("string")
        return self.col if isinstance(self.kind, S.StringType) else _none()

    def binary(self) -> Column:
        return self.col if isinstance(self.kind, S.BinaryType) else _none("binary")

    def equals(self, const: Any) -> Column:
        if const is None:
            return F.lit(True)
        if isinstance(const, str) and isinstance(self.kind, S.StringType):
            return self.col == const
        shown = F.to_json(F.array(self.col))
        return F.substring(shown, F.lit(2), F.length(shown) - 2) == V.json_const(const)

    def field(self, name: str) -> Tree | None:
        if isinstance(self.kind, S.StructType) and name in self.kind.names:
            return Typed(self.col[name], self.kind[name].dataType)
        if isinstance(self.kind, S.MapType):
            return Typed(self.col[name], self.kind.valueType)
        return None

    def is_record(self) -> Column:
        return F.lit(isinstance(self.kind, S.StructType | S.MapType)) & self.col.isNotNull()

    def other_keys(self, names: list[str]) -> Column:
        if isinstance(self.kind, S.MapType):
            return F.exists(F.map_keys(self.col), lambda k: ~k.isin(names) if names else F.lit(True))
        extra = [n for n in getattr(self.kind, "names", []) if n not in names]
        return reduce(lambda a, b: a | b, (self.col[n].isNotNull() for n in extra), F.lit(False))

    def items(self) -> tuple[Column, Callable[[Column], Tree]]:
        if isinstance(self.kind, S.ArrayType):
            return self.col, lambda x: Typed(x, self.kind.elementType)
        if isinstance(self.kind, S.StructType) and all(n == f"_{i}" for i, n in enumerate(self.kind.names)):
            one = self.kind[0].dataType if len(self.kind) else S.StringType()
            if all(f.dataType == one for f in self.kind):
                return F.array(*(self.col[n] for n in self.kind.names)), lambda x: Typed(x, one)
        return _none("array<string>"), lambda x: Typed(x, S.StringType())

    def item(self, i: int) -> Tree:
        if isinstance(self.kind, S.StructType) and i < len(self.kind):
            return Typed(self.col[self.kind.names[i]], self.kind[i].dataType)
        return Typed(F.get(self.col, F.lit(i)), self.kind.elementType) if isinstance(self.kind, S.ArrayType) else Typed(_none(), S.StringType())

    def size(self) -> Column:
        return F.lit(len(self.kind)) if isinstance(self.kind, S.StructType) else F.size(self.col) if isinstance(self.kind, S.ArrayType) else _none("int")

    def variant(self, i: int, name: str) -> tuple[Column, Tree]:
        """Whether variant i can be meant, and its value."""
        if isinstance(self.kind, S.StructType) and "tag" in self.kind.names and name in self.kind.names:
            return self.col["tag"] == i, Typed(self.col[name], self.kind[name].dataType)
        return F.lit(True), self


@dataclass
class Json(Tree):
    """A VARIANT column, as ``parse_json`` makes it."""

    col: Column

    def kind(self) -> Column:
        return F.schema_of_variant(self.col)

    def is_null(self) -> Column:
        return F.is_variant_null(self.col)

    def has(self, kind: str) -> Column:
        if kind == "bytes":
            return self.binary().isNotNull()
        return F.coalesce(self.kind().rlike({"boolean": "^BOOLEAN", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "string": "^STRING"}[kind]), F.lit(False))

    def boolean(self) -> Column:
        return F.when(self.kind() == "BOOLEAN", F.try_variant_get(self.col, "$", "boolean"))

    def number(self) -> Column:
        text = F.try_variant_get(self.col, "$", "string")
        exact = F.when(text.rlike(T.DECIMAL_PATTERN), text).otherwise(text.try_cast("decimal(38,18)").cast("string"))
        return F.when(self.kind().rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), V.canonical_number(exact))

    def text(self) -> Column:
        return F.when(self.kind() == "STRING", F.try_variant_get(self.col, "$", "string"))

    def binary(self) -> Column:
        return F.try_to_binary(self.text(), F.lit("hex"))

    def equals(self, const: Any) -> Column:
        return F.to_json(self.col) == V.json_const(const)

    def field(self, name: str) -> Tree:
        quoted = name.replace("\\", "\\\\").replace("'", "\\'")
        return Json(F.try_variant_get(self.col, f"$['{quoted}']", "variant"))

    def is_record(self) -> Column:
        return F.startswith(self.kind(), F.lit("OBJECT"))

    def other_keys(self, names: list[str]) -> Column:
        keys = F.map_keys(F.try_variant_get(self.col, "$", "map<string,variant>"))
        return F.coalesce(F.exists(keys, lambda k: ~k.isin(names) if names else F.lit(True)), F.lit(False))

    def items(self) -> tuple[Column, Callable[[Column], Tree]]:
        return F.when(F.startswith(self.kind(), F.lit("ARRAY")), F.try_variant_get(self.col, "$", "array<variant>")), Json

    def item(self, i: int) -> Tree:
        return Json(F.try_variant_get(self.col, f"$[{i}]", "variant"))

    def size(self) -> Column:
        return F.size(self.items()[0])

    def variant(self, i: int, name: str) -> tuple[Column, Tree]:
        return F.lit(True), self


@dataclass
class Result:
    quads: list[Column]
    status: Column
    #: By variable of the scope: (term or null, whether several terms were given).
    terms: dict[int, tuple[Column, Column]]


def _union(many: list[dict[int, tuple[Column, Column]]]) -> dict[int, tuple[Column, Column]]:
    out: dict[int, tuple[Column, Column]] = {}
    for terms in many:
        for i, (term, several) in terms.items():
            if i in out:
                old, conflict = out[i]
                out[i] = F.coalesce(old, term), conflict | several | F.coalesce(old != term, F.lit(False))
            else:
                out[i] = term, several
    return out


class Dehydration:
    def __init__(self, layouts: Layouts, graph_on_write: bool = False, enforce_patterns: bool = False, empty_list_as_nil: bool = False, max_depth: int = 8):
        self.layouts, self.graph_on_write, self.enforce_patterns, self.empty_list_as_nil, self.max_depth = layouts, graph_on_write, enforce_patterns, empty_list_as_nil, max_depth

    # Terms that a value gives to the inputs of its layout.

    def literal(self, layout: Data, v: Tree) -> tuple[Column, Column]:
        """(term, status)."""
        if layout.kind == "boolean":
            term = T.plain_literal_col(v.boolean().cast("string"), layout.datatype)
        elif layout.kind == "number":
            term = T.plain_literal_col(v.number(), layout.datatype)
        elif layout.kind == "string":
            term = T.literal_col(v.text(), layout.datatype)
        else:
            how = {T.XSD + "hexBinary": F.hex, T.XSD + "base64Binary": F.base64}.get(layout.datatype)
            term = T.plain_literal_col(how(v.binary()), layout.datatype) if how else _none()
        known = layout.kind != "bytes" or layout.datatype in (T.XSD + "hexBinary", T.XSD + "base64Binary")
        status = F.when(~v.has(layout.kind) if known else F.lit(True), "INCOMPATIBLE_LAYOUT")
        if layout.pattern is not None and self.enforce_patterns and layout.kind == "string":
            status = V.first_status(status, F.when(~v.text().rlike(to_java(layout.pattern)), "PATTERN_MISMATCH"))
        return term, status

    def too_deep(self, layout: Layout, depth: int) -> bool:
        """Where a recursive layout ends: it has no terms there and writes RECURSION_LIMIT."""
        return depth > 2 * self.max_depth and self.layouts.recursive(layout.id)

    def terms(self, call: Call, v: Tree, depth: int) -> dict[int, tuple[Column, Column]]:
        """The terms that a call gives to variables of the caller."""
        layout = self.layouts.call(call)
        own = {} if self.too_deep(layout, depth) else self.scope_terms(layout, v, depth)
        return _union([{x: own[i]} for i, x in enumerate(call.inputs) if isinstance(x, int) and i in own])

    def scope_terms(self, layout: Layout, v: Tree, depth: int) -> dict[int, tuple[Column, Column]]:
        """Terms by variable of the layout's own scope."""
        no = F.lit(False)
        if isinstance(layout, Data | Id):
            term = self.literal(layout, v)[0] if isinstance(layout, Data) else T.iri_col(v.text())
            return {layout.resource: (term, no)} if isinstance(layout.resource, int) else {}
        size = layout.inputs + layout.intro
        if isinstance(layout, Product):
            got = [(p, v.field(p.name)) for p in layout.fields]
            return self._outer(size, [(p, f) for p, f in got if f is not None], depth)
        if isinstance(layout, Sized):
            return self._outer(size, [(p, v.item(i)) for i, p in enumerate(layout.items)], depth)
        if isinstance(layout, Sum):
            out = []
            for i, p in enumerate(layout.variants):
                ok, value = self.fits(layout, i, v, depth)
                out.append({k: (F.when(ok, t), ok & s) for k, (t, s) in self._outer(size, [(p, value)], depth).items()})
            return _union(out)
        if isinstance(layout, Unordered | Ordered):
            part = layout.item if isinstance(layout, Unordered) else layout.node
            xs, tree = v.items()
            shift = 2 if isinstance(layout, Ordered) else 0
            names = self._outer(size, [(part, Typed(_none(), S.StringType()))], depth, shift)
            out = {}
            for k in names:
                each = F.array_distinct(F.filter(F.transform(xs, lambda x, k=k: self._outer(size, [(part, tree(x))], depth, shift)[k][0]), lambda t: t.isNotNull()))
                out[k] = F.get(each, F.lit(0)), F.coalesce(F.size(each) > 1, F.lit(False))
            return out
        return {}

    def _outer(self, size: int, parts: list[tuple[Part, Tree]], depth: int, shift: int = 0) -> dict[int, tuple[Column, Column]]:
        """Terms that parts give to the ``size`` variables outside of them."""
        outside = [(p, v) for p, v in parts if any(isinstance(x, int) and x < size for x in p.value.inputs)]  # others give none
        return _union([{k: t for k, t in self.terms(p.value, v, depth + 1).items() if k < size} for p, v in outside])

    def fits(self, layout: Sum, i: int, v: Tree, depth: int) -> tuple[Column, Tree]:
        """Whether variant i takes the value."""
        p = layout.variants[i]
        meant, value = v.variant(i, p.name)
        env = [F.lit("_:x")] * (layout.inputs + layout.intro)
        return F.coalesce(meant & self.part(p, value, env, F.lit(None).cast("string"), F.lit(""), depth).status.isNull(), F.lit(False)), value

    # Quads.

    def blank(self, path: Column) -> Column:
        return F.concat(F.lit("_:b"), F.substring(F.sha2(path, 256), 1, 32))

    def instance(self, dataset: tuple, env: list[Column], graph: Column) -> list[Column]:
        put = lambda x: F.lit(x) if isinstance(x, str) else env[x]
        out = []
        for s, p, o, g in dataset:
            own = put(g) if g is not None else graph if self.graph_on_write else _none()
            out.append(F.struct(put(s).alias("s"), put(p).alias("p"), put(o).alias("o"), own.alias("g")))
        return [F.array(*out).cast(QUADS)] if out else []

    def part(self, p: Part, v: Tree, env: list[Column], graph: Column, path: Column, depth: int, more: tuple[Column, ...] = ()) -> Result:
        """A field, variant, item or node with its value; ``more``: variables of the node."""
        given = self.terms(p.value, v, depth + 1)
        size = len(env) + len(more)
        env = [*env, *more]
        clash = [s for k, (_, s) in given.items() if k >= size]
        sure = isinstance(self.layouts.call(p.value), Data | Id)  # a value without a term fails
        for k in range(size, size + p.intro):
            blank = self.blank(F.concat(path, F.lit(f"#{k}")))
            env.append(blank if k not in given else given[k][0] if sure else F.coalesce(given[k][0], blank))
        own = self.instance(p.dataset, env, graph)
        inner = self.value(p.value, v, env, graph, path, depth + 1)
        several = reduce(lambda a, b: a | b, clash, F.lit(False))
        return Result(own + inner.quads, V.first_status(inner.status, F.when(several, "TERM_AMBIGUITY")), {})

    def value(self, call: Call, v: Tree, env: list[Column], graph: Column, path: Column, depth: int) -> Result:
        layout = self.layouts.call(call)
        if self.too_deep(layout, depth):
            return Result([], F.when(~v.absent(), "RECURSION_LIMIT"), {})
        put = lambda x: F.lit(x) if isinstance(x, str) else env[x]
        graph = graph if call.graph is KEEP else _none() if call.graph is None else put(call.graph)
        return self.layout(layout, v, [put(x) for x in call.inputs], graph, path, depth)

    def layout(self, layout: Layout, v: Tree, env: list[Column], graph: Column, path: Column, depth: int) -> Result:
        if isinstance(layout, Never):
            return Result([], F.lit("INCOMPATIBLE_LAYOUT"), {})
        if isinstance(layout, Always):
            return Result([], _none(), {})
        given = self.scope_terms(layout, v, depth) if layout.intro else {}
        for k in range(layout.inputs, layout.inputs + layout.intro):
            blank = self.blank(F.concat(path, F.lit(f"!{k}")))
            env = [*env, F.coalesce(given[k][0], blank) if k in given else blank]
        own = self.instance(layout.dataset, env, graph)
        if isinstance(layout, Unit):
            ok = v.is_null() if layout.const is None and isinstance(v, Json) else v.equals(layout.const)
            return Result(own, F.when(~F.coalesce(ok, F.lit(False)), "INCOMPATIBLE_LAYOUT"), {})
        if isinstance(layout, Data):
            return Result(own, self.literal(layout, v)[1], {})
        if isinstance(layout, Id):
            text = v.text()
            status = F.when(~F.coalesce(text.rlike(T.IRI_PATTERN), F.lit(False)), "INVALID_IRI")
            if layout.pattern is not None and self.enforce_patterns:
                status = V.first_status(status, F.when(~text.rlike(to_java(layout.pattern)), "PATTERN_MISMATCH"))
            return Result(own, status, {})
        if isinstance(layout, Product):
            return self.record(layout, v, env, graph, path, depth, own)
        if isinstance(layout, Sized):
            wrong = F.when(~F.coalesce(v.size() == len(layout.items), F.lit(False)), "INCOMPATIBLE_LAYOUT")
            got = [self.part(p, v.item(i), env, graph, F.concat(path, F.lit(f"/{i}")), depth) for i, p in enumerate(layout.items)]
            return Result(own + [q for r in got for q in r.quads], V.first_status(wrong, *(V.within(r.status, str(i)) for i, r in enumerate(got))), {})
        if isinstance(layout, Sum):
            return self.sum(layout, v, env, graph, path, depth, own)
        if isinstance(layout, Unordered | Ordered):
            return self.list(layout, v, env, graph, path, depth, own)
        raise LayoutError(f"no way to write {layout}")

    def record(self, layout: Product, v: Tree, env, graph, path, depth, own) -> Result:
        statuses = [F.when(~F.coalesce(v.is_record(), F.lit(False)), "INCOMPATIBLE_LAYOUT"), F.when(v.other_keys([p.name for p in layout.fields]), "UNKNOWN_KEY")]
        quads = list(own)
        for p in layout.fields:
            f = v.field(p.name)
            if f is None:
                statuses.append(V.within(F.lit("MISSING_REQUIRED") if p.required else _none(), p.name))
                continue
            r = self.part(p, f, env, graph, F.concat(path, F.lit(f"/{p.name}")), depth)
            there = ~f.absent()
            statuses.append(V.within(F.when(there, r.status).otherwise(F.lit("MISSING_REQUIRED") if p.required else _none()), p.name))
            if r.quads:
                quads.append(F.when(there, F.concat(*r.quads)).otherwise(F.array().cast(QUADS)))
        return Result(quads, V.first_status(*statuses), {})

    def sum(self, layout: Sum, v: Tree, env, graph, path, depth, own) -> Result:
        fits, quads = [], list(own)
        for i, p in enumerate(layout.variants):
            ok, value = self.fits(layout, i, v, depth)
            fits.append(ok)
            r = self.part(p, value, env, graph, F.concat(path, F.lit(f"/{p.name}")), depth)
            if r.quads:
                quads.append(F.when(ok, F.concat(*r.quads)).otherwise(F.array().cast(QUADS)))
        count = sum((f.cast("int") for f in fits), F.lit(0))
        return Result(quads, F.when(count == 0, "NO_VARIANT").when(count > 1, "AMBIGUOUS_VARIANT"), {})

    def list(self, layout: Unordered | Ordered, v: Tree, env, graph, path, depth, own) -> Result:
        xs, tree = v.items()
        put = lambda x: F.lit(x) if isinstance(x, str) else env[x]
        node = lambda i: F.when(i == 0, put(layout.head)).otherwise(self.blank(F.concat(path, F.lit("/node/"), i.cast("string"))))

        def one(x: Column, i: Column) -> Result:
            here = F.concat(path, F.lit("/"), i.cast("string"))
            if isinstance(layout, Unordered):
                return self.part(layout.item, tree(x), env, graph, here, depth)
            rest = F.when(i + 1 == F.size(xs), put(layout.tail)).otherwise(node(i + 1))
            return self.part(layout.node, tree(x), env, graph, here, depth, (node(i), rest))

        def of(x: Column, i: Column) -> Column:
            r = one(x, i)
            return F.struct(V.within(r.status, i).alias("st"), (F.concat(*r.quads) if r.quads else F.array().cast(QUADS)).alias("q"))

        each = F.transform(xs, of)
        bad = F.get(F.filter(F.transform(each, lambda e: e["st"]), lambda s: s.isNotNull()), F.lit(0))
        return Result([*own, F.coalesce(F.flatten(F.transform(each, lambda e: e["q"])), F.array().cast(QUADS))], V.first_status(F.when(xs.isNull(), "INCOMPATIBLE_LAYOUT"), bad), {})


@dataclass
class Dehydrated:
    """``quads`` (s, p, o, g), a set; ``inputs``: the key and the term of each input, and the
    status (null: success) with its place in the tree; ``errors``: the inputs' rows that failed."""

    quads: DataFrame
    inputs: DataFrame
    errors: DataFrame


def dehydrate_rows(
    layouts: Layouts,
    ref: str,
    rows: DataFrame,
    key: list[str],
    value: str | None = None,
    inputs: dict[int, str] | None = None,
    graph: str | None = None,
    graph_on_write: bool = False,
    enforce_patterns: bool = False,
    empty_list_as_nil: bool = False,
    skolem_prefix: str = "",
    max_depth: int = 8,
) -> DataFrame:
    """``key`` columns, ``status``, ``in0``.., ``quads`` (an array) and ``status_place`` for each row.

    The tree is the column ``value`` (any Spark type, or VARIANT for JSON), or all columns but
    those of ``key`` and ``inputs`` as a record (then a key column may also be a field if it is
    named in the layout). ``inputs``: columns with the terms of inputs.
    """
    layout, given = layouts[ref], inputs or {}
    if value is None:
        fields = {p.name for p in layout.fields} if isinstance(layout, Product) else set()
        names = [c for c in rows.columns if c not in given.values() and (c not in key or c in fields)]
        kind = S.StructType([rows.schema[c] for c in names])
        tree: Tree = Typed(F.struct(*names), kind)
    else:
        kind = rows.schema[value].dataType
        tree = Json(F.col(value)) if isinstance(kind, S.VariantType) else Typed(F.col(value), kind)
    work = Dehydration(layouts, graph_on_write, enforce_patterns, empty_list_as_nil, max_depth)
    root = F.concat_ws("/", F.lit(skolem_prefix + ref), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key))
    n = getattr(layout, "inputs", 1)
    own = work.scope_terms(layout, tree, 0)
    env, clash = [], F.lit(False)
    for i in range(n):
        term = work.blank(F.concat(root, F.lit(f"@{i}")))
        if i in own:
            term, clash = F.coalesce(own[i][0], term), clash | own[i][1]
        if i in given:
            term = F.col(given[i])
            if i in own:
                clash = clash | F.coalesce(own[i][0] != term, F.lit(False))
        if empty_list_as_nil and isinstance(layout, Ordered) and layout.head == i and isinstance(layout.tail, str):
            term = F.when(F.size(tree.items()[0]) == 0, F.lit(layout.tail)).otherwise(term)
        env.append(term)
    # Terms first, as columns of their own, so that quads don't repeat their expressions.
    named = rows.withColumns({f"_in{i}": t for i, t in enumerate(env)} | {"_root": root, "_clash": clash})
    result = work.layout(layout, tree, [F.col(f"_in{i}") for i in range(n)], F.lit(graph).cast("string"), F.col("_root"), 0)
    status = V.first_status(result.status, F.when(F.col("_clash"), "TERM_AMBIGUITY"))
    quads = F.concat(*result.quads) if result.quads else F.array().cast(QUADS)
    own = F.when(status.isNull(), quads).otherwise(F.array().cast(QUADS)).alias("quads")
    return named.select(*key, V.status_code(status).alias("status"), *(F.col(f"_in{i}").alias(f"in{i}") for i in range(n)), own, V.status_place(status).alias("status_place"))


def dehydrate(layouts: Layouts, ref: str, rows: DataFrame, key: list[str], mode: str = "permissive", distinct: bool = True, **options) -> Dehydrated:
    """The quads of all rows; see ``dehydrate_rows``. ``distinct=False`` is for callers whose
    keys are unique and whose quads hold them, as then none can repeat."""
    if mode not in ("permissive", "dropmalformed", "failfast"):
        raise ValueError(f"unknown mode {mode!r}")
    got = dehydrate_rows(layouts, ref, rows, key, **options)
    if mode == "failfast":
        got = got.withColumn("status", F.when(F.col("status").isNotNull(), F.raise_error(F.concat(F.lit("dehydration failed: "), F.col("status"), F.lit(" at "), F.col("status_place")))))
        got = got.where(F.coalesce(F.col("status"), F.lit("")) == "")
    # The outer form, as the other one makes Spark repeat the whole expression in a filter.
    quads = got.select(F.inline_outer("quads")).where("s IS NOT NULL")
    quads = quads.dropDuplicates(["s", "p", "o", "g"]) if distinct else quads
    heads = got.drop("quads")
    return Dehydrated(quads, heads if mode == "permissive" else heads.where("status IS NULL"), heads.where("status IS NOT NULL"))
