"""Graph patterns over a quad table: equi-joins, cardinality as data.

Quads are (s, p, o, g) in canonical form, ``g`` being '' for the default graph. A frame
table has the current graph in ``_g`` and bound variables in ``_0``, ``_1``, ...
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeloom.plans.layouts import LayoutError, Quad

GRAPH = "_g"


def var(i: int) -> str:
    return f"_{i}"


def quad_set(quads: DataFrame) -> DataFrame:
    """A quad table with null graphs as ''; a dataset is a set."""
    g = F.coalesce("g", F.lit("")) if "g" in quads.columns else F.lit("")
    return quads.select("s", "p", "o", g.alias("g"))


def variables(patterns: tuple[Quad, ...]) -> list[int]:
    return sorted({x for q in patterns for x in q if isinstance(x, int)})


def _ordered(patterns: tuple[Quad, ...], bound: set[int]) -> list[Quad]:
    """Patterns that share a variable with earlier ones first, then those of more constants."""
    left, out, known = list(patterns), [], set(bound)
    while left:
        best = max(left, key=lambda q: (any(isinstance(x, int) and x in known for x in q), sum(isinstance(x, str) for x in q), -left.index(q)))
        left.remove(best)
        out.append(best)
        known |= {x for x in best if isinstance(x, int)}
    return out


def scan(quads: DataFrame, pattern: Quad) -> DataFrame:
    """The bindings of one pattern: constants filter, a repeated variable is an equality."""
    at: dict[int, str] = {}
    conditions: list[Column] = []
    for name, x in zip("spog", pattern, strict=True):
        if isinstance(x, str):
            conditions.append(F.col(name) == x)
        elif isinstance(x, int):
            if x in at:
                conditions.append(F.col(name) == F.col(at[x]))
            else:
                at[x] = name
                if name == "g":
                    conditions.append(F.col("g") != "")  # a variable binds named graphs only
    out = quads.where(reduce(lambda a, b: a & b, conditions)) if conditions else quads
    keep = [F.col(name).alias(var(x)) for x, name in at.items()]
    return out.select(*keep, *([F.col("g").alias(GRAPH)] if pattern[3] is None else []))


#: Words of 64 bits that a filter has at most.
WORDS = 1 << 20


def _bits(columns: list[str]) -> tuple[Column, Column]:
    """The word of a filter that values are looked up in, and the two bits that they set in it."""
    h = F.xxhash64(*columns)
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(h, at).bitwiseAND(F.lit(63)).cast("int"))
    return h.bitwiseAND(F.lit(WORDS - 1)), bit(32).bitwiseOR(bit(40))


def likely(out: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``out`` without most of the rows whose ``columns`` are in none of ``rows``; a join must
    follow. The filter is of bounded size: with more rows than it has room for it lets more
    through, never less than all that fit."""
    word, bits = _bits(columns)
    words = rows.groupBy(word.alias("_word")).agg(F.bit_or(bits).alias("_bits"))
    at, mine = (out.withColumn("_at", word), F.col("_bits").bitwiseAND(bits) == bits)
    return at.join(F.broadcast(words), F.col("_at") == F.col("_word")).where(mine).select(*out.columns)


def match(quads: DataFrame, frames: DataFrame, patterns: tuple[Quad, ...]) -> DataFrame:
    """All matches: the frames' columns and the variables that the patterns bind.

    A pattern that closes a cycle of others binds nothing new and mostly leaves few matches:
    the rest go by a filter before they are shuffled once more."""
    out = frames
    for i, pattern in enumerate(_ordered(patterns, {int(c[1:]) for c in frames.columns if c[1:].isdigit()})):
        rows = scan(quads, pattern)
        shared = [c for c in rows.columns if c in out.columns]
        if i > 1 and len(variables((pattern,))) > 1 and set(rows.columns) <= set(out.columns):
            out = likely(out, rows, shared)
        out = out.join(rows, shared) if shared else out.crossJoin(rows)
    return out


def match_counted(quads: DataFrame, frames: DataFrame, patterns: tuple[Quad, ...], bound: int, intro: int, n: str) -> DataFrame:
    """The frames, with the number of matches (0, 1 or 2 for more) in ``n`` and, of one match,
    the introduced variables. ``bound``: how many variables the frames have."""
    new = [var(i) for i in range(bound, bound + intro)]
    if missing := [i for i in range(bound, bound + intro) if i not in variables(patterns)]:
        raise LayoutError(f"variable {missing[0]} is introduced but in no pattern")
    used = [GRAPH, *(var(i) for i in variables(patterns) if i < bound)]
    keys = frames.select(*used)
    keys = keys if set(used) == set(frames.columns) else keys.distinct()
    found = match(quads, keys, patterns).groupBy(*used)
    found = found.agg(F.least(F.count(F.lit(1)), F.lit(2)).alias(n), *(F.min(c).alias(c) for c in new))
    out = frames.join(found, used, "left").withColumn(n, F.coalesce(n, F.lit(0)))
    return out.withColumns({c: F.when(F.col(n) == 1, F.col(c)) for c in new}) if new else out


def match_unique(quads: DataFrame, frames: DataFrame, patterns: tuple[Quad, ...], bound: int, intro: int, required: bool = True) -> DataFrame:
    """``match_counted`` with a column ``status``: MISSING_DATA, DATA_AMBIGUITY or null."""
    out = match_counted(quads, frames, patterns, bound, intro, "n")
    none = F.lit("MISSING_DATA") if required else F.lit(None).cast("string")
    return out.withColumn("status", F.when(F.col("n") == 0, none).when(F.col("n") > 1, "DATA_AMBIGUITY"))


def star(quads: DataFrame, frames: DataFrame, subject: str, parts: list[tuple[str, str, str]], assume_unique: bool = False) -> DataFrame:
    """Several properties of one subject in one aggregate instead of a join each.

    ``parts``: (predicate, column for the object, column for the number of matches). Quads
    are grouped by subject and graph; the scan is filtered to the predicates. The least text
    is found by sorting, so rows are dealt out before they are aggregated: a task then sorts
    its partition, not all the quads that a split of a small file is lifted to. They are dealt
    by subject alone, which serves the join as well where the graph is a constant.
    """
    predicates = sorted({p for p, _, _ in parts})
    which = F.coalesce(*(F.when(F.col("p") == p, i) for i, p in enumerate(predicates)))
    rows = quads.where(F.col("p").isin(predicates)).select(F.col("s").alias(subject), which.alias("p"), "o", F.col("g").alias(GRAPH))
    rows = rows.repartition(subject)
    aggs = []
    for predicate, o, n in parts:
        hit = F.col("p") == predicates.index(predicate)
        aggs.append(F.min(F.when(hit, F.col("o"))).alias(o))
        if not assume_unique:
            aggs.append(F.count(F.when(hit, 1)).alias(n))
    found = rows.groupBy(GRAPH, subject).agg(*aggs)
    out = frames.join(found, [GRAPH, subject], "left")
    for _, o, n in parts:
        out = out.withColumn(n, F.col(o).isNotNull().cast("int") if assume_unique else F.least(F.coalesce(n, F.lit(0)), F.lit(2)))
        out = out.withColumn(o, F.when(F.col(n) == 1, F.col(o)))
    return out


def interpret(quads: DataFrame, same_as: DataFrame) -> DataFrame:
    """Quads over resources instead of terms: ``same_as`` (term, resource) names the
    resource of each term that has one; all terms of a resource become its name."""
    out = quads
    for c in ("s", "p", "o", "g"):
        names = same_as.select(F.col("term").alias(c), F.col("resource").alias("_r"))
        out = out.join(names, c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
    return out.select("s", "p", "o", "g").dropDuplicates()
