"""Secret scans: an incremental ledger of content-addressed blobs, in DataFrame functions only.

Every version of a text is a blob, named by the SHA-256 of its bytes. A pass computes the
names, joins them with the ledger, scans each blob once, however many rows hold it, by those
rules that the ledger has no (blob, rule version) pair of, appends what it found as a new run
of the ledger, and joins findings back to every row (its id, and the path and version that a
table of historical versions may have). A rule is named by its kind and a digest of its
definition, so a changed rule makes only its own pairs unseen. The ledger is a folder whose
manifest lists the committed runs (``runs``), so a ledger opened again knows all earlier passes.

Spans are in code points, end exclusive. Rules are searched leftmost, without overlaps, and
matches that fail the rule's length are dropped after the search, so they still consume
their text.

Defined cases: a null text is an empty blob, which has no findings; rows with equal texts
share findings; null or repeated ids stay rows of the result; other columns are ignored; an
empty table gives an empty result and an empty run of the ledger.
"""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.llm.runs import RunStore, halves
from shapeloom.shared import shared_path, tidy


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters or more. ``hint`` is a cheap
    pattern that every passing text matches."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str

    @property
    def version(self) -> str:
        return f"{self.kind}-{hashlib.sha256(repr(astuple(self)).encode()).hexdigest()[:16]}"


#: In the order in which kinds are listed at equal starts.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, r"AKIA[A-Z0-9]{14}"),
    Rule("hex", r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16}"),
)
FINDINGS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def running_sums(xs: Column) -> Column:
    """The sums of an array of integers up to each place. In round k each place adds what
    the place 2^k before it has, so n values take log n rounds."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(xs), F.lit(2)))).cast("int") - 1)
    step = lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= F.call_function("shiftleft", F.lit(1), k), x + F.get(acc, i - F.call_function("shiftleft", F.lit(1), k))).otherwise(x))
    return F.aggregate(rounds, xs, step)


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, end, kind>> of a rule's matches, by start.

    The text between matches (``split``) and the matches themselves give all positions.
    """
    pattern = F.lit(rule.pattern)
    if rule.group == 0:  # a run passes or fails as a whole: short runs need not be listed
        pattern = F.lit(rule.hint + rule.hint[rule.hint.index("[") : rule.hint.index("]") + 1] + "*")
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    sized = F.transform(
        F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("b"), whole.alias("w"), part.alias("p")),
        lambda x: F.struct((F.length(x["b"]) + F.length(x["w"])).alias("step"), F.length(x["w"]).alias("len"), (F.length(x["p"]) >= rule.least).alias("ok")),
    )
    ends = running_sums(F.transform(sized, lambda x: x["step"]))
    placed = F.zip_with(sized, ends, lambda x, e: F.struct((e - x["len"]).alias("start"), F.lit(rank).alias("rank"), e.alias("end"), F.lit(rule.kind).alias("kind"), x["ok"].alias("ok")))
    found = F.transform(F.filter(placed, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.when(text.rlike(rule.hint), found.cast(FINDINGS)).otherwise(F.array().cast(FINDINGS))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, seen) -> (blob, rules, findings): the versions of the rules that were not seen,
    and their findings, by start, then rule."""
    todo = lambda r: ~F.array_contains("seen", r.version)
    none = F.array().cast(FINDINGS)
    each = [F.when(todo(rule), spans(F.col("text"), rule, i)).otherwise(none) for i, rule in enumerate(rules)]
    any_hint = F.col("text").rlike("|".join(f"(?:{r.hint})" for r in rules))
    versions = F.filter(F.array(*(F.when(todo(r), F.lit(r.version)) for r in rules)), lambda x: x.isNotNull())
    return blobs.select("blob", versions.alias("rules"), F.when(any_hint, F.array_sort(F.concat(*each))).otherwise(none).alias("findings"))


class BlobLedger:
    """Runs of (blob, rules: the versions by which it was scanned then, findings), bucketed and
    sorted by blob, in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.store = RunStore(spark, path, f"blob string, rules array<string>, findings {FINDINGS}", "blob", buckets)

    def update(self, rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scans the (blob, text) rows for the (blob, rule version) pairs that the ledger lacks."""
        wanted = F.array(*(F.lit(r.version) for r in rules))
        # The partial step of the aggregate leaves one row a blob and task before the shuffle,
        # and the runs are met in the partitions that it deals.
        blobs = rows.groupBy("blob").agg(F.first("text").alias("text")).withColumn("seen", F.array().cast("array<string>"))
        for run in self.store.runs:
            old = self.store.table(run).groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("more"))  # a merged run has several rows of a blob
            blobs = blobs.join(old.hint("merge"), "blob", "left").withColumn("seen", F.when(F.col("more").isNull(), F.col("seen")).otherwise(F.concat("seen", "more"))).drop("more")
        self.store.append(scan(blobs.where(F.size(F.array_except(wanted, "seen")) > 0), rules))
        self.store.settle()

    def findings(self, names: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """``names`` with the findings of their blobs by these rules, by start, then rule."""
        known = self.store.read(bucketed=False).where(F.size("findings") > 0).select("blob", self._of(rules).alias("f"))
        known = known.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("f"))).alias("findings"))
        out = names.join(known.hint("merge"), "blob", "left")
        return out.withColumn("findings", F.coalesce("findings", F.array().cast(FINDINGS)))

    @staticmethod
    def _of(rules: tuple[Rule, ...]) -> Column:
        """Of the findings of a run's row those by ``rules``."""

        def wanted(x: Column) -> Column:
            out = F.lit(False)
            for r in rules:
                out = out | ((x["kind"] == r.kind) & F.array_contains("rules", r.version))
            return out

        return F.filter("findings", wanted)


@tidy
def secret_scan(docs: DataFrame, ledger: BlobLedger, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, paths: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: its id, its columns ``paths`` (where and in which version
    the blob lies), blob, and array of findings (start, rank, end, kind)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("id"), F.struct(*(F.col(p) for p in paths) if paths else [F.lit(None).alias("none")]).alias("p"), F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))
    ledger.update(named.select("blob", "text"), rules)
    found = ledger.findings(named.select("id", "p", "blob"), rules)
    return found.select(F.col("id").alias(id_col), *(F.col("p")[p].alias(p) for p in paths), "blob", "findings")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, in two batches by ascending id, the second against the ledger of
    the first, opened again from its folder; no spans beyond the base ones."""
    path, out = shared_path(spark, "secret-ledger"), None
    for batch in halves(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")):
        found = secret_scan(batch, BlobLedger(spark, path))
        out = found if out is None else out.unionByName(found)
    BlobLedger(spark, path).store.drop()
    joined = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *(count(r.kind) for r in RULES), F.sha2(joined.cast("binary"), 256).alias("base_sha256"), joined.alias("spans"))


def _sql_spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, rid, '{kind}' AS kind, {rank} AS rank,
           list_sum(list_transform(b[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(w[1:i-1], lambda s: length(s))), 0) AS s,
           length(w[i]) AS n
    FROM (SELECT doc_id, rid, b, w, p, unnest(range(1, len(w) + 1)) AS i
          FROM (SELECT doc_id, rid, string_split_regex(t, '{p}') AS b, regexp_extract_all(t, '{p}', 0) AS w,
                       regexp_extract_all(t, '{p}', {group}) AS p FROM d))
    WHERE length(p[i]) >= {least}"""


OP1_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_sql_spans(r.kind, i, r.pattern, r.group, r.least) for i, r in enumerate(RULES))}),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + n AS BIGINT) AS VARCHAR), ',' ORDER BY s, rank) AS spans
      FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""
