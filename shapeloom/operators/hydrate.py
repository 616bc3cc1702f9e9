"""Quads to trees: set-oriented evaluation of layouts.

A call of a layout for many inputs is one frame table. Its own pattern is joined and its
matches counted, each nested call gets the distinct inputs it is called with as its frames,
and results are joined back. Layouts that look at no quads (literals, ids, sums of them)
are column expressions and cost no join; the properties of a record that share a subject
cost one aggregate together. What fails is a status in the row, not an exception.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeloom.functions import terms as T
from shapeloom.functions import values as V
from shapeloom.functions.regexp import to_java
from shapeloom.operators.match import GRAPH, interpret, match, match_counted, quad_set, star, var, variables
from shapeloom.plans.layouts import KEEP, Always, Call, Data, Id, Layout, LayoutError, Layouts, Never, Ordered, Part, Product, Sized, Sum, Unit, Unordered
from shapeloom.shared import stored

#: Status, typed value, JSON text and sort key of a call's result.
OUT = ("st", "va", "js", "sk")


@dataclass
class Value:
    status: Column
    value: Column
    json: Column
    key: Column

    def columns(self) -> list[Column]:
        return [c.alias(n) for c, n in zip((self.status, self.value, self.json, self.key), OUT, strict=True)]


def null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


class Hydration:
    def __init__(self, layouts: Layouts, quads: DataFrame, assume_unique: bool = False, enforce_patterns: bool = False, max_depth: int = 32, json: bool = True, numbers: str = "decimal"):
        self.numbers = numbers
        self.with_json, self.layouts, self.quads = json, layouts, quad_set(quads)
        self.assume_unique, self.enforce_patterns, self.max_depth = assume_unique, enforce_patterns, max_depth

    # Layouts that need no quads.

    def inline(self, call: Call, inputs: list[Column], seen: frozenset[str] = frozenset()) -> Value | None:
        """The result as expressions over the inputs; None if the layout looks at quads."""
        layout = self.layouts.call(call)
        if isinstance(layout, Never):
            return Value(F.lit("INCOMPATIBLE_LAYOUT"), null(), null(), null())
        if isinstance(layout, Always):
            return Value(null(), null(), F.lit("null"), F.lit(V.ANY))
        if layout.dataset or layout.intro or call.ref in seen:
            return None
        seen = seen | {call.ref}
        nested = lambda p: None if p.dataset or p.intro else self.inline(p.value, [inputs[x] if isinstance(x, int) else F.lit(x) for x in p.value.inputs], seen)
        if isinstance(layout, Unit):
            return self.unit(layout)
        if isinstance(layout, Data | Id):
            term = inputs[layout.resource] if isinstance(layout.resource, int) else F.lit(layout.resource)
            return self.data(layout, term) if isinstance(layout, Data) else self.id(layout, term)
        if isinstance(layout, Product | Sized):
            parts = layout.fields if isinstance(layout, Product) else layout.items
            got = [nested(p) for p in parts]
            if None in got:
                return None
            ones = [F.lit(1)] * len(parts)
            return self.record(layout, ones, got) if isinstance(layout, Product) else self.tuple(ones, got)
        if isinstance(layout, Sum):
            got = [nested(p) for p in layout.variants]
            return None if None in got else self.choose(layout, [F.lit(1)] * len(got), got)
        return None

    def unit(self, layout: Unit) -> Value:
        shown = V.json_const(layout.const)
        typed = null("boolean") if layout.const is None else F.lit(layout.const) if isinstance(layout.const, str | bool) else F.lit(shown)
        return Value(null(), typed, F.lit(shown), F.lit(V.UNIT + shown + V.END))

    def pattern_status(self, layout: Data | Id, text: Column) -> Column:
        if layout.pattern is None or not self.enforce_patterns:
            return null()
        return F.when(~text.rlike(to_java(layout.pattern)), "PATTERN_MISMATCH")

    def data(self, layout: Data, term: Column) -> Value:
        right, text = T.has_datatype(term, layout.datatype), T.text_of(term, layout.datatype)
        wrong = F.when(~F.coalesce(right, F.lit(False)), "NO_MATCHING_LITERAL")
        if layout.kind == "string":
            plain = T.unescape_col(text)
            return Value(V.first_status(wrong, self.pattern_status(layout, plain)), F.when(right, plain), V.json_text(plain), F.concat(F.lit(V.TEXT), V.text_key(plain)))
        if layout.kind == "boolean":
            value = F.when(right & text.isin("true", "1"), True).when(right & text.isin("false", "0"), False)
            shown = value.cast("string")
        elif layout.kind == "number":
            shown = V.canonical_number(text)
            kind, ok = V.NUMBER_TYPES.get(layout.datatype, V.DECIMAL), V.is_number(text)
            # Most numerals are canonical: only others are rewritten before they are cast.
            value = F.when(right & ok, F.coalesce(text.try_cast(kind), shown.try_cast(kind)))
            bad = F.when(right & ~ok, "INVALID_LITERAL")
            if self.numbers == "text":
                value = F.when(right & ok, shown)
            else:
                bad = V.first_status(bad, F.when(right & V.out_of_range(text, value, kind), "NUMBER_RANGE"))
            return Value(V.first_status(wrong, bad), value, shown, F.concat(F.lit(V.NUMBER), V.number_key(shown)))
        else:
            how = {T.XSD + "hexBinary": "hex", T.XSD + "base64Binary": "base64"}.get(layout.datatype)
            if how is None:
                return Value(F.lit("UNKNOWN_DATATYPE"), null("binary"), null(), null())
            value = F.when(right, F.try_to_binary(text, F.lit(how)))
            shown = V.json_text(text)
            key = F.concat(F.lit(V.BYTES), F.hex(value), F.lit(V.END))
            return Value(V.first_status(wrong, F.when(value.isNull(), "INVALID_LITERAL")), value, shown, key)
        return Value(V.first_status(wrong, F.when(value.isNull(), "INVALID_LITERAL")), value, shown, F.concat(F.lit(V.BOOLEAN), shown))

    def id(self, layout: Id, term: Column) -> Value:
        right, text = T.is_iri_col(term), T.iri_text(term)
        wrong = F.when(~F.coalesce(right, F.lit(False)), "NO_IRI")
        return Value(V.first_status(wrong, self.pattern_status(layout, text)), F.when(right, text), V.json_text(text), F.concat(F.lit(V.ID), V.text_key(text)))

    # Putting results together. ``n``: how many matches a part has, 2 for several.

    def record(self, layout: Product, n: list[Column], got: list[Value]) -> Value:
        statuses, typed, shown, keys = [], [], [], []
        for part, k, v in zip(layout.fields, n, got, strict=True):
            one = k == 1
            absent = F.lit("MISSING_REQUIRED") if part.required else null()
            statuses.append(V.within(F.when(k > 1, "DATA_AMBIGUITY").when(k == 0, absent).otherwise(v.status), part.name))
            typed.append(F.when(one, v.value).alias(part.name))
            shown.append((part.name, F.when(one, v.json)))
            keys.append(F.when(one, F.concat(F.lit("\x03" + part.name + V.END), v.key)).otherwise(""))
        value = F.struct(*typed) if typed else null()
        return Value(V.first_status(*statuses), value, V.json_object(shown), F.concat(F.lit(V.RECORD), *keys, F.lit(V.END)))

    def tuple(self, n: list[Column], got: list[Value]) -> Value:
        statuses = [V.within(F.when(k > 1, "DATA_AMBIGUITY").when(k == 0, "MISSING_DATA").otherwise(v.status), str(i)) for i, (k, v) in enumerate(zip(n, got, strict=True))]
        value = F.struct(*(v.value.alias(f"_{i}") for i, v in enumerate(got))) if got else null()
        shown = F.concat(F.lit("["), F.concat_ws(",", *(v.json for v in got)) if got else F.lit(""), F.lit("]"))
        return Value(V.first_status(*statuses), value, shown, F.concat(F.lit(V.LIST), *(F.concat(F.lit("\x03"), v.key) for v in got), F.lit(V.END)))

    def choose(self, layout: Sum, n: list[Column], got: list[Value]) -> Value:
        hard = [V.within(F.when(k > 1, "DATA_AMBIGUITY"), p.name) for p, k in zip(layout.variants, n, strict=True)]
        fits = [(k == 1) & v.status.isNull() for k, v in zip(n, got, strict=True)]
        count = sum((f.cast("int") for f in fits), F.lit(0))
        pick = lambda xs: F.coalesce(*(F.when(f, x) for f, x in zip(fits, xs, strict=True))) if xs else null()
        tag = pick([F.lit(i) for i in range(len(got))])
        value = F.struct(tag.cast("int").alias("tag"), *(F.when(f, v.value).alias(p.name) for p, f, v in zip(layout.variants, fits, got, strict=True)))
        key = pick([F.concat(F.lit(V.VARIANT), v.key, F.lit(layout.id + V.END + f"{i:06d}")) for i, v in enumerate(got)])
        status = V.first_status(*hard, F.when(count == 0, "NO_VARIANT").when(count > 1, "AMBIGUOUS_VARIANT"))
        return Value(status, value, pick([v.json for v in got]), key)

    # Layouts that look at quads.

    def call(self, call: Call, frames: DataFrame, depth: int = 0) -> DataFrame:
        """``frames`` (the graph and inputs, distinct) with the results as columns ``OUT``."""
        layout = self.layouts.call(call)
        got = self.inline(call, [F.col(var(i)) for i in range(len(call.inputs))])
        if got is not None:
            return frames.select("*", *got.columns())
        again = self.layouts.recursive(layout.id)
        keys = frames.columns
        if again:
            frames = stored(frames, "frames")
            if depth > self.max_depth or frames.isEmpty():
                return frames.select("*", F.lit("RECURSION_LIMIT").alias("st"), *(null().alias(c) for c in OUT[1:]))
        own, bound = null(), layout.inputs
        if layout.dataset or layout.intro:
            frames = match_counted(self.quads, frames, layout.dataset, bound, layout.intro, "n_own")
            own = F.when(F.col("n_own") == 0, "MISSING_DATA").when(F.col("n_own") > 1, "DATA_AMBIGUITY")
            bound += layout.intro
        if isinstance(layout, Product):
            frames, n, got = self.parts(frames, layout.fields, bound, depth)
            result = self.record(layout, n, got)
        elif isinstance(layout, Sized):
            frames, n, got = self.parts(frames, layout.items, bound, depth)
            result = self.tuple(n, got)
        elif isinstance(layout, Sum):
            frames, n, got = self.parts(frames, layout.variants, bound, depth)
            result = self.choose(layout, n, got)
        elif isinstance(layout, Unordered):
            frames, result = self.unordered(frames, layout, bound, depth)
        elif isinstance(layout, Ordered):
            frames, result = self.ordered(frames, layout, bound, depth)
        elif isinstance(layout, Unit):
            result = self.unit(layout)
        else:
            term = F.col(var(layout.resource)) if isinstance(layout.resource, int) else F.lit(layout.resource)
            result = self.data(layout, term) if isinstance(layout, Data) else self.id(layout, term)
        if again:  # a type can't contain itself
            result.value = result.json
        result.status = V.first_status(own, result.status)
        return frames.select(*keys, *result.columns())

    def nested(self, rows: DataFrame, call: Call, pre: str, depth: int, where: Column | None = None, rename: dict[int, str] | None = None) -> tuple[DataFrame, Value]:
        """A nested call for each row. Its frames are the distinct graphs and inputs."""
        name = lambda i: (rename or {}).get(i, var(i))
        inputs = [F.col(name(x)) if isinstance(x, int) else F.lit(x) for x in call.inputs]
        got = self.inline(call, inputs)
        if got is not None:
            return rows, got
        graph = F.col(GRAPH) if call.graph is KEEP else F.lit("") if call.graph is None else F.col(name(call.graph)) if isinstance(call.graph, int) else F.lit(call.graph)
        keys = [graph.alias(GRAPH), *(x.alias(var(i)) for i, x in enumerate(inputs))]
        frames = (rows if where is None else rows.where(where)).select(*keys).distinct()
        result = self.call(call, frames, depth + 1)
        cols = [GRAPH, *(var(i) for i in range(len(inputs)))]
        mine = {c: f"{pre}k{i}" for i, c in enumerate(cols)}
        result = result.select(*(F.col(c).alias(mine[c]) for c in cols), *(F.col(c).alias(pre + c) for c in OUT))
        rows = rows.withColumns({mine[c] + "x": k for c, k in zip(cols, [graph, *inputs], strict=True)})
        rows = rows.join(result, [rows[mine[c] + "x"] == result[mine[c]] for c in cols], "left").drop(*mine.values(), *(m + "x" for m in mine.values()))
        return rows, Value(*(F.col(pre + c) for c in OUT))

    def parts(self, frames: DataFrame, parts: tuple[Part, ...], bound: int, depth: int) -> tuple[DataFrame, list[Column], list[Value]]:
        """Matches and nested results of each part; the introduced variables of part i are
        kept as columns of their own."""
        n: list[Column] = [F.lit(1)] * len(parts)
        names: list[dict[int, str]] = [{} for _ in parts]
        stars: dict[int, list[int]] = {}
        for i, p in enumerate(parts):
            if not p.dataset:
                if p.intro:
                    raise LayoutError(f"{p.name}: a variable is introduced but in no pattern")
                continue
            n[i] = F.col(f"p{i}_n")
            names[i] = {bound + j: f"p{i}_v{j}" for j in range(p.intro)}
            s, pred, o, g = p.dataset[0]
            if len(p.dataset) == 1 and p.intro == 1 and isinstance(s, int) and s < bound and isinstance(pred, str) and o == bound and g is None:
                stars.setdefault(s, []).append(i)
            else:
                frames = match_counted(self.quads, frames, p.dataset, bound, p.intro, f"p{i}_n")
                for k, v in names[i].items():
                    frames = frames.withColumnRenamed(var(k), v)
        for s, group in stars.items():
            frames = star(self.quads, frames, var(s), [(parts[i].dataset[0][1], f"p{i}_v0", f"p{i}_n") for i in group], self.assume_unique)
        got = []
        for i, p in enumerate(parts):
            frames, value = self.nested(frames, p.value, f"p{i}_", depth, n[i] == 1, names[i])
            got.append(value)
        return frames, n, got

    def unordered(self, frames: DataFrame, layout: Unordered, bound: int, depth: int) -> tuple[DataFrame, Value]:
        item = layout.item
        used = [GRAPH, *(var(i) for i in range(bound) if i in variables(item.dataset) or i in item.value.inputs or i == item.value.graph)]
        rows = frames.select(*used)
        rows = match(self.quads, rows if set(used) == set(frames.columns) else rows.distinct(), item.dataset)
        rows, v = self.nested(rows, item.value, "i_", depth)
        named = next((F.col(var(x)) for x in item.value.inputs if isinstance(x, int)), F.lit(""))
        rows = rows.select(*used, V.within(v.status, named).alias("st"), F.struct(v.key.alias("k"), v.value.alias("v"), self.shown(v).alias("j")).alias("x"))
        lists = rows.groupBy(*used).agg(F.min("st").alias("l_st"), F.sort_array(F.collect_list("x")).alias("l_x"))
        return frames.join(lists, used, "left"), self.list_value("l_x", F.col("l_st"))

    def shown(self, v: Value) -> Column:
        """The JSON of a list's item, if it's wanted: what is collected isn't pruned later."""
        return v.json if self.with_json else null()

    def list_value(self, items: str, status: Column) -> Value:
        """Of a column of (k, v, j) items."""
        xs = F.col(items)
        none = xs.isNull()
        value = F.when(none, F.transform(F.slice(F.array(xs[0]), 1, 0), lambda x: x["v"])).otherwise(F.transform(xs, lambda x: x["v"]))
        shown = F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(xs, lambda x: x["j"]), ","), F.lit("")), F.lit("]"))
        key = F.concat(F.lit(V.LIST), F.coalesce(F.array_join(F.transform(xs, lambda x: F.concat(F.lit("\x03"), x["k"])), ""), F.lit("")), F.lit(V.END))
        return Value(status, value, shown, key)

    def ordered(self, frames: DataFrame, layout: Ordered, bound: int, depth: int) -> tuple[DataFrame, Value]:
        """All nodes are matched once. The nodes of a list are then found by doubling: after
        round k each list knows its first 2^k nodes and each node the one 2^k further on. A
        list that came to a node again is cyclic and grows no further; the others go on."""
        node, first, rest = layout.node, bound, bound + 1
        col = lambda x: F.col(var(x)) if isinstance(x, int) else F.lit(x)
        outer = [GRAPH, *(var(i) for i in range(bound) if i in variables(node.dataset) or i in node.value.inputs or i == node.value.graph or i == layout.tail)]
        lists = frames.select(*outer, col(layout.head).alias("head"), col(layout.tail).alias("tail")).distinct()
        keys = match(self.quads, lists.select(*outer).distinct(), node.dataset)
        intros = [var(i) for i in range(bound + 2, bound + 2 + node.intro)]
        here = [*outer, var(first)]
        nodes = keys.groupBy(*here).agg(F.count(F.lit(1)).alias("n"), F.min(var(rest)).alias("next"), *(F.min(c).alias(c) for c in intros))
        nodes = stored(nodes, "list-nodes")
        jump = nodes.where("n = 1").select(*outer, F.col(var(first)).alias("node"), F.col("next").alias("to"))
        seen = stored(lists.where("head <> tail").select(*outer, "head", "tail", F.col("head").alias("node"), F.lit(0).cast("long").alias("pos")), "list-seen")
        total, step = seen.count(), 1
        going = seen
        while True:
            more = going.join(jump, [*outer, "node"]).select(*outer, "head", "tail", F.col("to").alias("node"), (F.col("pos") + step).alias("pos")).where("node <> tail")
            grown = stored(seen.unionByName(more), "list-seen")
            now = grown.count()
            seen = grown
            if now == total:
                break
            going = self._acyclic(seen, outer)
            total, step = now, step * 2
            jump = stored(jump.join(jump.select(*outer, F.col("node").alias("to"), F.col("to").alias("far")), [*outer, "to"]).select(*outer, "node", F.col("far").alias("to")), "list-jumps")
        walked = seen.join(nodes.withColumnRenamed(var(first), "node"), [*outer, "node"], "left")
        walked, v = self.nested(walked.withColumn(var(first), F.col("node")).withColumn(var(rest), F.col("next")), node.value, "i_", depth, F.col("n") == 1)
        status = F.when(F.col("n").isNull(), "MISSING_DATA").when(F.col("n") > 1, "DATA_AMBIGUITY").otherwise(v.status)
        rows = walked.select(*outer, "head", "tail", "pos", "node", V.within(status, F.col("node")).alias("st"), v.value.alias("v"), v.key.alias("k"), self.shown(v).alias("j"))
        found = rows.groupBy(*outer, "head", "tail").agg(
            F.min("st").alias("l_st"), F.sort_array(F.collect_list(F.struct("pos", "k", "v", "j"))).alias("l_x"), F.count(F.lit(1)).alias("l_n"), F.count_distinct("node").alias("l_d")
        )
        cyclic = F.when(F.col("l_n") > F.col("l_d"), "CYCLIC_LIST")
        frames = frames.withColumns({"head": col(layout.head), "tail": col(layout.tail)}).join(found, [*outer, "head", "tail"], "left")
        return frames, self.list_value("l_x", V.first_status(cyclic, F.col("l_st")))

    @staticmethod
    def _acyclic(seen: DataFrame, outer: list[str]) -> DataFrame:
        """The rows of the lists that haven't come to a node again."""
        lists = [*outer, "head", "tail"]
        once = seen.groupBy(*lists).agg(F.count(F.lit(1)).alias("a"), F.count_distinct("node").alias("b")).where("a = b").select(*lists)
        return seen.join(once, lists)


def hydrate(
    layouts: Layouts,
    ref: str,
    quads: DataFrame,
    roots: DataFrame,
    graph: str | None = None,
    same_as: DataFrame | None = None,
    mode: str = "permissive",
    assume_unique: bool = False,
    enforce_patterns: bool = False,
    max_depth: int = 32,
    json: bool = True,
    numbers: str = "decimal",
) -> DataFrame:
    """The tree of each row of ``roots`` (in0, in1, ...: terms): those columns with status
    (null: success), value (typed), json and status_place (where in the tree it failed).

    ``graph``: the current graph, else the default one. ``same_as``: see ``interpret``.
    ``mode``: permissive keeps failed rows with their status, dropmalformed leaves them out,
    failfast raises. ``assume_unique``: the caller vouches that properties have one value and
    that roots don't repeat. ``json=False`` leaves that column null and saves making it.
    ``numbers``: decimal gives numbers as columns of their datatype's Spark type, and those that
    it can't hold exactly the status NUMBER_RANGE; text gives canonical numerals of any size.
    """
    if numbers not in ("decimal", "text"):
        raise ValueError(f"unknown form of numbers {numbers!r}")
    if mode not in ("permissive", "dropmalformed", "failfast"):
        raise ValueError(f"unknown mode {mode!r}")
    if same_as is not None:
        quads = interpret(quads, same_as)
    layout = layouts[ref]
    if not isinstance(layout, Never | Always) and len(roots.columns) != layout.inputs:
        raise LayoutError(f"INVALID_INPUT_COUNT: {ref} takes {layout.inputs}, not {len(roots.columns)}")
    call = Call(ref, tuple(range(len(roots.columns))))
    frames = roots.select(F.lit(graph or "").alias(GRAPH), *(F.col(c).alias(var(i)) for i, c in enumerate(roots.columns)))
    frames = frames if assume_unique else frames.distinct()
    json = json or any(layouts.recursive(r) for r in {ref} | layouts.reachable(ref))
    out = Hydration(layouts, quads, assume_unique, enforce_patterns, max_depth, json, numbers).call(call, frames)
    status = F.col("st")
    out = out.select(*(F.col(var(i)).alias(c) for i, c in enumerate(roots.columns)), V.status_code(status).alias("status"), F.when(status.isNull(), F.col("va")).alias("value"), F.when(status.isNull() & F.lit(json), F.col("js")).alias("json"), V.status_place(status).alias("status_place"))
    if mode == "dropmalformed":
        return out.where("status IS NULL")
    if mode == "failfast":
        return out.withColumn("status", F.when(F.col("status").isNotNull(), F.raise_error(F.concat(F.lit("hydration failed: "), F.col("status"), F.lit(" at "), F.col("status_place")))))
    return out
