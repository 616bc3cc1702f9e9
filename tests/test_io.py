import json

import pytest
from pyspark.sql import functions as F

from shapeloom import cli
from shapeloom.plans.layouts import Layouts
from shapeloom.sources import nquads, trees
from shapeloom.streaming.quads import hydrate_stream

LAYOUT = {"id": "http://ex.test/L", "type": "record", "fields": {"id": {"intro": [], "value": {"layout": {"type": "id"}, "input": "_:self"}}, "name": {"value": {"type": "string"}, "property": "http://ex.test/name"}}}


def lines(spark, *texts):
    return spark.createDataFrame([(x,) for x in texts], "value string")


def test_nquads_forms(spark):
    got = nquads.parse_lines(
        lines(
            spark,
            "# comment",
            "",
            "  <http://a.b/s>\t<http://a.b/p> <http://a.b/o> . # more",
            '<http://a.b/s> <http://a.b/p> "x"^^<http://www.w3.org/2001/XMLSchema#string> <http://a.b/g> .',
            '_:b.1 <http://a.b/p> "\\u00e9\\t\\"\\\\u0041\\U0001F600\\u000a"@EN-gb.',
        )
    ).collect()
    assert [tuple(r) for r in got[:2]] == [("<http://a.b/s>", "<http://a.b/p>", "<http://a.b/o>", None), ("<http://a.b/s>", "<http://a.b/p>", '"x"', "<http://a.b/g>")]
    assert got[2].s == "_:b.1" and got[2].o == '"é\t\\"\\\\u0041😀\\n"@en-gb'


def test_bad_lines(spark):
    bad = lines(spark, "<http://a.b/s> <http://a.b/p> .", '<http://a.b/s> "p" <http://a.b/o> .', "<http://a.b/s> <http://a.b/p> <http://a.b/o> .")
    assert nquads.parse_lines(bad, "dropmalformed").count() == 1
    with pytest.raises(Exception, match="no quad"):
        nquads.parse_lines(bad).collect()


def test_long_literal(spark):
    text = "a\\nb\\\\ " * 50_000
    row = nquads.parse_lines(lines(spark, f'_:s <http://a.b/p> "{text}" .')).first()
    assert row.o == f'"{text}"'


def test_write_is_sorted(spark, tmp_path):
    quads = spark.createDataFrame([("_:b", "<http://a.b/p>", '"1"', None), ("_:a", "<http://a.b/p>", '"2"', "<http://a.b/g>")], "s string, p string, o string, g string")
    nquads.write_nquads(quads, str(tmp_path / "out"), ordered=True)
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['_:a <http://a.b/p> "2" <http://a.b/g> .', '_:b <http://a.b/p> "1" .']


def test_json_files(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"a": 1}\n\n{"a": 1}\n[2]\n')
    rows = trees.read_json(spark, str(tmp_path / "in.json"))
    assert sorted(r[0] for r in rows.select(F.to_json("value")).collect()) == ["[2]", '{"a":1}', '{"a":1}']
    trees.write_json(spark.createDataFrame([('{"a":[1]}',), (None,)], "json string"), str(tmp_path / "out"), indented=True)
    assert json.loads("\n".join(r[0] for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect())) == {"a": [1]}


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "l.json").write_text(json.dumps(LAYOUT))
    (tmp_path / "t.json").write_text('{"id": "http://ex.test/a", "name": "Ann"}')
    assert cli.main([str(tmp_path / "l.json"), "dehydrate", "--from", str(tmp_path / "t.json")], spark) == 0
    quads = capsys.readouterr().out
    assert quads == '<http://ex.test/a> <http://ex.test/name> "Ann" .\n'
    (tmp_path / "q.nq").write_text(quads * 2)
    assert cli.main([str(tmp_path / "l.json"), "hydrate", "--from", str(tmp_path / "q.nq"), "http://ex.test/a"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"id": "http://ex.test/a", "name": "Ann"}
    assert cli.main([str(tmp_path / "l.json"), "hydrate", "-l", "http://ex.test/L", "--from", str(tmp_path / "q.nq"), "_:x"], spark) == 1
    assert "NO_IRI" in capsys.readouterr().err
    assert cli.main(["convert", "rdf", "--from", str(tmp_path / "q.nq")], spark) == 0
    assert capsys.readouterr().out == quads
    assert cli.main(["convert", "tree", "--from", str(tmp_path / "t.json"), "-p"], spark) == 0
    assert json.loads(capsys.readouterr().out)["name"] == "Ann"
    with pytest.raises(SystemExit):
        cli.main(["hydrate", "--from", str(tmp_path / "q.nq"), "_:x"], spark)


def test_hydrate_stream(spark, tmp_path):
    layouts = Layouts()
    ref = layouts.add(LAYOUT)
    schema = "s string, p string, o string, g string"
    spark.createDataFrame([("<http://ex.test/a>", "<http://ex.test/name>", '"Ann"', None)], schema).write.parquet(str(tmp_path / "in"))
    seen = []
    query = hydrate_stream(layouts, ref, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "quads"), lambda df, n: seen.extend(r.json for r in df.collect()), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert [json.loads(x) for x in seen] == [{"id": "http://ex.test/a", "name": "Ann"}]


def test_hydrate_stream_makes_parents_again(spark, tmp_path):
    layouts = Layouts()
    name = {"value": {"type": "string"}, "property": "http://ex.test/name"}
    leaf = {"type": "record", "fields": {"name": name}}
    ref = layouts.add({"type": "record", "fields": {"name": name, "part": {"value": {"type": "record", "fields": {"part": {"value": leaf, "property": "http://ex.test/part"}}}, "property": "http://ex.test/part"}}})
    schema = "s string, p string, o string, g string"
    batches = [
        [("_:a", "<http://ex.test/name>", '"A"', None), ("_:a", "<http://ex.test/part>", "_:b", None), ("_:b", "<http://ex.test/part>", "_:c", None), ("_:c", "<http://ex.test/part>", "_:a", None)],
        [("_:c", "<http://ex.test/name>", '"C"', None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = {}
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = hydrate_stream(layouts, ref, source, str(tmp_path / "quads"), lambda df, n: seen.update({n: {r.in0: r.json for r in df.collect()}}), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert json.loads(seen[1]["_:a"]) == {"name": "A", "part": {"part": {"name": "C"}}}
    assert set(seen[1]) == {"_:a", "_:b", "_:c"}  # all that lead to the changed node, round a cycle too


def test_cli_writes_cbor_files(spark, tmp_path, monkeypatch):
    import io

    from shapeloom.sources import cbor

    (tmp_path / "t.json").write_text('{"a": [1, "x"]}')
    assert cli.main(["convert", "tree", "-o", "cbor", "--from", str(tmp_path / "t.json"), "--to", str(tmp_path / "out")], spark) == 0
    (file,) = (tmp_path / "out").glob("*.cbor")
    assert cbor.decode(file.read_bytes()) == {"a": [1, "x"]}
    monkeypatch.setattr("sys.stdin", type("In", (), {"buffer": io.BytesIO(b'<http://ex.test/a> <http://ex.test/name> "Ann" .\n')}))
    (tmp_path / "l.json").write_text(json.dumps(LAYOUT))
    assert cli.main([str(tmp_path / "l.json"), "hydrate", "http://ex.test/a"], spark) == 0
