"""N-Quads text files: one quad a line."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("application/n-quads", "n-quads", "nquads", "nq")
# Possessive repetitions: the JVM goes through them without a stack frame a character.
_IRI, _BLANK = r"<[^\x00-\x20<>\"{}|^`]*+>", r"_:[^\s<>\"]*[^\s<>\".]"
_LITERAL = r"\"[^\"\\\n\r]*+(?:\\.[^\"\\\n\r]*+)*+\"(?:\^\^<[^>]*+>|@[A-Za-z]+(?:-[A-Za-z0-9]+)*+)?"
LINE = rf"^\s*+({_IRI}|{_BLANK})\s*+({_IRI})\s*+({_IRI}|{_BLANK}|{_LITERAL})\s*+({_IRI}|{_BLANK})?\s*+\.\s*+(?:#.*+)?$"
XSD_STRING_SUFFIX = "^^<http://www.w3.org/2001/XMLSchema#string>"


def canonical(term: Column) -> Column:
    """A term as it is read in the one form that equal terms share."""
    # Doubled backslashes are set aside meanwhile.
    plain = F.replace(term, F.lit("\\\\"), F.lit("\x00"))
    for shown, raw in (("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f"), ("\\'", "'")):
        plain = F.replace(plain, F.lit(shown), F.lit(raw))
    plain = F.replace(plain, F.lit("\x00"), F.lit("\\\\"))
    out = F.when(F.contains(term, F.lit("\\")), plain).otherwise(term)
    out = F.when(F.endswith(out, F.lit(XSD_STRING_SUFFIX)), F.substring(out, F.lit(1), F.length(out) - len(XSD_STRING_SUFFIX))).otherwise(out)
    tag = F.regexp_extract(out, r'"@([A-Za-z0-9-]+)$', 1)
    return F.when(F.startswith(out, F.lit('"')) & (tag != ""), F.concat(F.substring(out, F.lit(1), F.length(out) - F.length(tag)), F.lower(tag))).otherwise(out)


def numeric_escapes(lines: DataFrame) -> DataFrame:
    r"""\uXXXX and \UXXXXXXXX in a column ``value``, by Arrow batches; only lines that have
    one go through Python."""
    has = F.col("value").rlike(r"(?<!\\)(?:\\\\)*\\[uU]")

    def decode(batches):
        import pyarrow as pa

        def one(m: re.Match) -> str:
            if m[1] is None:
                return m[0]
            c = chr(int(m[1][1:], 16))
            return {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r"}.get(c, c)

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"value": [re.sub(r"\\(?:(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})|.)", one, x) for x in batch.column(0).to_pylist()]})

    return lines.where(~has).unionByName(lines.where(has).mapInArrow(decode, "value string"))


def parse_lines(lines: DataFrame, mode: str = "failfast") -> DataFrame:
    """Quads (s, p, o, g; null for the default graph) of a column ``value``. Blank lines and
    comments are skipped; others that are no quads fail, or are dropped (dropmalformed)."""
    blank, ok = F.col("value").rlike(r"^\s*(#.*)?$"), F.col("value").rlike(LINE)
    rows = numeric_escapes(lines.select("value").where(~blank))
    if mode == "dropmalformed":
        rows = rows.where(ok)
    else:  # the optimiser may evaluate this before the filter above
        rows = rows.select(F.when(ok | blank, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no quad: "), F.col("value")))).alias("value"))
    parts = rows.select(F.split(F.regexp_replace("value", LINE, "$1\n$2\n$3\n$4"), "\n").alias("t"))  # a line has no line feed
    t = F.col("t")
    return parts.select(t[0].alias("s"), t[1].alias("p"), canonical(t[2]).alias("o"), F.nullif(t[3], F.lit("")).alias("g"))


def read_nquads(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame:
    """The dataset of a file or folder: a set of quads."""
    return parse_lines(spark.read.text(path), mode).dropDuplicates(["s", "p", "o", "g"])


def quad_lines(quads: DataFrame) -> DataFrame:
    """One line a quad, in a column ``value``."""
    return quads.select(F.concat(F.concat_ws(" ", "s", "p", "o", F.nullif(F.col("g"), F.lit(""))), F.lit(" .")).alias("value"))


def write_nquads(quads: DataFrame, path: str, mode: str = "errorifexists", ordered: bool = False) -> None:
    """Writes text files; ``ordered``: as one sorted sequence of files."""
    out = quads.orderBy("s", "p", "o", "g") if ordered else quads
    quad_lines(out).write.mode(mode).text(path)
