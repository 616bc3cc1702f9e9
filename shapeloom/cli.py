"""Command line: ``python -m shapeloom.cli [LAYOUT...] hydrate|dehydrate|convert ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.functions.terms import parse_term
from shapeloom.operators.dehydrate import dehydrate
from shapeloom.operators.hydrate import hydrate
from shapeloom.plans.layouts import Layouts, load_layouts
from shapeloom.shared import delete, file_system, shared_path
from shapeloom.sources import cbor, nquads, trees


COMMANDS = ("hydrate", "dehydrate", "convert")


def parse(argv: list[str]) -> argparse.Namespace:
    """Layout files and general options stand before the command, its own options after it."""
    at = next((i for i, x in enumerate(argv) if x in COMMANDS), len(argv))
    p = argparse.ArgumentParser(prog="shapeloom", usage="shapeloom [LAYOUT...] [--include FILE] [--no-prelude] [-v] {hydrate,dehydrate,convert tree,convert rdf} ...")
    p.add_argument("layouts", nargs="*", help="layout files; a single one is the default layout")
    p.add_argument("--include", action="append", default=[], metavar="FILE", help="a layout file that others refer to")
    p.add_argument("--no-prelude", action="store_true", help="leave the presets out")
    p.add_argument("--verbose", "-v", action="count", default=0)
    general = p.parse_args(argv[:at])
    if at == len(argv):
        p.error(f"name a command: {', '.join(COMMANDS)}")
    command, rest = argv[at], argv[at + 1 :]
    what = ""
    if command == "convert":
        if rest[:1] not in (["tree"], ["rdf"]):
            p.error("convert what: tree or rdf")
        what, rest = rest[0], rest[1:]
    source = "n-quads" if command == "hydrate" or what == "rdf" else "json"
    target = "n-quads" if command == "dehydrate" or what == "rdf" else "json"
    c = argparse.ArgumentParser(prog=f"shapeloom {command} {what}".strip())
    c.add_argument("-i", "--input", dest="input_format", default=source)
    c.add_argument("-o", "--output", dest="output_format", default=target)
    c.add_argument("--from", dest="path", help="a file or folder instead of standard input")
    c.add_argument("--to", help="a folder instead of standard output")
    if command != "convert":
        c.add_argument("-l", "--layout", help="the IRI of the layout")
    if command == "hydrate" or what == "tree":
        c.add_argument("-p", "--pretty", action="store_true")
    if command == "hydrate":
        c.add_argument("subjects", nargs="*", help="input resources")
    own = c.parse_args(rest)
    return argparse.Namespace(**vars(general) | vars(own) | {"command": command, "what": what})


def _form(name: str) -> str:
    for form, names in (("nq", nquads.FORMATS), ("json", trees.FORMATS), ("cbor", cbor.FORMATS)):
        if name in names:
            return form
    raise SystemExit(f"unknown format {name!r}")


def _stdin(spark: SparkSession) -> str:
    """Standard input as a file that executors can read."""
    path = shared_path(spark, "stdin")
    fs, file = file_system(spark, path)
    stream = fs.create(file, False)
    while block := sys.stdin.buffer.read(1 << 20):
        stream.write(bytearray(block))
    stream.close()
    return path


def _read_tree(spark: SparkSession, form: str, path: str) -> DataFrame:
    return cbor.read_cbor(spark, path) if _form(form) == "cbor" else trees.read_json(spark, path, whole_files=True)


def _write_text(rows: DataFrame, to: str | None) -> None:
    if to:
        rows.write.text(to)
    else:
        for r in rows.toLocalIterator():
            print(r[0])


def _write_cbor(rows: DataFrame, to: str | None) -> None:
    """One file a tree below ``to``, a folder that executors share; they write the files."""
    if not to:
        for r in rows.toLocalIterator():
            sys.stdout.buffer.write(r.cbor)
        return

    def write(part) -> None:
        from pyarrow import fs
        from pyspark import TaskContext

        files, folder = (fs.LocalFileSystem(), to) if "://" not in to else fs.FileSystem.from_uri(to)
        files.create_dir(folder, recursive=True)
        for i, r in enumerate(part):
            with files.open_output_stream(f"{folder}/{TaskContext.get().partitionId():05d}-{i:06d}.cbor") as out:
                out.write(r.cbor)

    rows.where("cbor IS NOT NULL").foreachPartition(write)


def _layouts(a: argparse.Namespace) -> tuple[Layouts, str]:
    layouts, refs = load_layouts(*a.layouts, *a.include, with_prelude=not a.no_prelude)
    if a.layout:
        return layouts, parse_term(a.layout)
    if len(a.layouts) != 1:
        raise SystemExit("name the layout with --layout, or give just one layout file")
    return layouts, refs[0]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parse(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("shapeloom").getOrCreate()
    if a.path:
        return run(a, spark)
    a.path = _stdin(spark)
    try:
        return run(a, spark)
    finally:
        delete(spark, a.path)


def run(a: argparse.Namespace, spark: SparkSession) -> int:
    if a.command == "convert":
        source, target = _form(a.input_format), _form(a.output_format)
        if a.what == "rdf":
            quads = nquads.read_nquads(spark, a.path)
            _write_text(nquads.quad_lines(quads.orderBy("s", "p", "o", "g")), a.to)
            return 0
        rows = _read_tree(spark, a.input_format, a.path).select(F.to_json("value").alias("json"))
        if target == "cbor":
            _write_cbor(cbor.json_to_cbor(rows), a.to)
        else:
            _write_text(trees.pretty(rows) if a.pretty else rows, a.to)
        return 0 if source and target else 1
    layouts, ref = _layouts(a)
    if a.command == "dehydrate":
        rows = _read_tree(spark, a.input_format, a.path)
        got = dehydrate(layouts, ref, rows, ["key"], value="value")
        failed = 0
        for e in got.errors.toLocalIterator():
            failed = 1
            print(f"error: {e.status} at {e.status_place or '/'}", file=sys.stderr)
        _write_text(nquads.quad_lines(got.quads.orderBy("s", "p", "o", "g")), a.to)
        return failed
    quads = nquads.read_nquads(spark, a.path)
    subjects = [parse_term(s) for s in a.subjects]
    roots = spark.createDataFrame([tuple(subjects)], ", ".join(f"in{i} string" for i in range(len(subjects))))
    binary = _form(a.output_format) == "cbor"
    tree = hydrate(layouts, ref, quads, roots, numbers="decimal" if binary else "text")
    row = tree.first()  # the one tree that was asked for
    if row.status is not None:
        print(f"error: {row.status} at {row.status_place or '/'}", file=sys.stderr)
        return 1
    out = spark.createDataFrame([row], tree.schema)
    if binary:
        _write_cbor(cbor.to_cbor(out, layouts, ref), a.to)
    else:
        _write_text(trees.pretty(out) if a.pretty else out.select("json"), a.to)
    return 0


if __name__ == "__main__":
    sys.exit(main())
