import itertools
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from shapeloom.functions import regexp
from shapeloom.functions.terms import escape, resolve
from shapeloom.functions.values import decimal_digits
from shapeloom.plans.builder import Id, layout, prop
from shapeloom.plans.layouts import Call, LayoutError, Layouts, load_layouts, prelude
from shapeloom.plans.schema import to_ddl, to_json_schema, to_spark_type, type_name
from shapeloom.sources import cbor


@pytest.mark.parametrize(
    ("source", "what"),
    [
        ("{", "no JSON"),
        ('{"type": "unit", "type": "unit"}', "duplicate key"),
        ({"type": "nothing"}, "unknown layout type"),
        ({}, "missing key 'type'"),
        ({"type": "unit", "x": 1}, "unexpected key"),
        ({"type": "number"}, "missing key 'datatype'"),
        ({"type": "bytes"}, "missing key 'datatype'"),
        ({"type": "string", "input": []}, "needs a resource"),
        ({"type": "string", "resource": "_:x"}, "undeclared variable"),
        ({"type": "string", "input": "1x"}, "invalid variable name"),
        ({"type": "union"}, "no evaluation"),
        ({"type": "intersection"}, "no evaluation"),
        ({"type": "unit", "dataset": [["_:self", "http://a.b/"]]}, "3 or 4 patterns"),
        ({"type": "unit", "dataset": [["_:self", "relative", "_:self"]]}, "no base IRI"),
        ({"type": "record", "input": [], "fields": {"a": {"value": {"type": "string"}, "property": "http://a.b/"}}}, "needs an input"),
        ({"type": "set", "item": {"intro": [], "value": {"type": "string"}, "property": "http://a.b/"}}, "introduced variable"),
        ({"type": "string", "pattern": "(a"}, "unclosed group"),
        ({"type": "record", "fields": {"a": {"value": {"type": "string"}, "required": 1}}}, "expected a boolean"),
    ],
)
def test_errors(source, what):
    with pytest.raises(ValueError, match=what.replace("(", "\\(")):
        Layouts().add(source)


def test_scope_of_names():
    base = {"base": "http://a.b/c/", "prefixes": {"ex": "http://ex.test/"}, "type": "record", "fields": {"x": {"value": {"type": "record", "fields": {"y": {"value": {"type": "string"}, "property": "ex:y"}}}, "property": "x"}}}
    layouts = Layouts()
    ref = layouts.add(base)
    assert layouts[ref].fields[0].dataset[0][1] == "<http://a.b/c/x>"
    inner = layouts[layouts[ref].fields[0].value.ref]
    assert inner.fields[0].dataset[0][1] == "<http://ex.test/y>"
    with pytest.raises(ValueError, match="undeclared"):  # variables aren't inherited
        Layouts().add({"type": "record", "input": "me", "fields": {"x": {"value": {"layout": {"type": "string", "input": "v", "resource": "_:me"}, "input": "_:me"}}}})


def test_registry():
    layouts = Layouts()
    ref = layouts.add({"id": "http://ex.test/L", "type": "unit"})
    with pytest.raises(LayoutError, match="defined twice"):
        layouts.add({"id": "http://ex.test/L", "type": "unit"})
    both = layouts.chain(prelude())
    assert ref in both and "<http://ns.test/prelude#u8>" in both
    with pytest.raises(LayoutError, match="LAYOUT_NOT_FOUND"):
        both["<http://ex.test/other>"]
    with pytest.raises(LayoutError, match="INVALID_INPUT_COUNT"):
        both.call(Call(ref, (0, 1)))


def test_load_layouts(tmp_path):
    (tmp_path / "a.json").write_text('{"id": "http://ex.test/A", "type": "set", "item": {"value": "http://ex.test/B", "property": "http://ex.test/p"}}')
    (tmp_path / "b.json").write_text('{"id": "http://ex.test/B", "type": "string"}')
    layouts, refs = load_layouts(str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    assert refs == ["<http://ex.test/A>", "<http://ex.test/B>"]
    assert layouts.dependencies(refs[0]) == [refs[1]] and not layouts.recursive(refs[0])


@pytest.mark.parametrize(
    ("source", "yes", "no"),
    [
        ("abc", ["abc"], ["ab", "abcc"]),
        ("ab*", ["", "ab", "abab"], ["a", "abb"]),
        ("a|bc?", ["a", "bc", ""], ["b", "abc"]),
        ("x(ab)+", ["xab", "xabxab"], ["xabab", "x"]),
        ("[a-c]", ["a", "b"], ["d", "ab"]),
        ("[^a-c]", ["d", "."], ["a"]),
        (r"\n\.", ["\n."], ["n."]),
        (".{2}", [".{2}"], ["ab", ".."]),
        (r"\d", ["d"], ["1"]),
    ],
)
def test_regexp(spark, source, yes, no):
    p = regexp.to_python(source)
    assert all(p.fullmatch(x) for x in yes) and not any(p.fullmatch(x) for x in no)
    rows = spark.createDataFrame([(x,) for x in yes + no], "x string")
    assert [r[0] for r in rows.select(rows.x.rlike(regexp.to_java(source))).collect()] == [True] * len(yes) + [False] * len(no)


def test_singletons():
    assert [regexp.singleton(regexp.parse(x)) for x in ("abc", "a|a", "[a]b", "a|b", "a?", "")] == ["abc", "a", "ab", None, None, ""]


@pytest.mark.parametrize(
    ("source", "shown"),
    [
        (r"\n\t\e", r"\n\t\e"),  # control characters by their letters
        (r"\{\.", "{."),  # characters without a meaning need no escape
        (r"\(\)\\", r"\(\)\\"),
        ("p+q*", "((p+)q)*"),  # a repetition takes all before it
        ("(hi)(jk)", "hijk"),
        ("g|(h|i)|g", "g|h|i"),
        ("w(|v)", "w(|v)"),  # an empty alternative
        ("[r-tq]", "[q-t]"),
        ("[86-97]", "[6-9]"),
        ("[^54]", "[^45]"),
        (r"[\-\]z]", r"[\-\]z]"),
        ("[y]", "y"),
        ("[^]", "[^]"),  # any character
    ],
)
def test_regexps_in_their_own_words(source, shown):
    assert regexp.show(regexp.parse(source)) == shown
    assert regexp.show(regexp.parse(shown)) == shown


def test_large_sets_are_shown_by_their_complement():
    tree = ("class", False, (("\0", "/"), (":", "\U0010ffff")))
    assert regexp.show(tree) == "[^0-9]"
    assert regexp.simplified(regexp.parse(regexp.show(tree))) == ("class", True, (("0", "9"),))


@given(st.text(alphabet="ab|()*+?[]^-\\", max_size=12))
def test_shown_regexps_mean_the_same(source):
    try:
        tree = regexp.parse(source)
    except ValueError:
        return
    again = regexp.parse(regexp.show(tree))
    a, b = regexp.to_python(source), re.compile(regexp.to_python(regexp.show(tree)).pattern)
    assert again is not None
    for n in range(4):
        for text in map("".join, itertools.product("ab-", repeat=n)):
            assert bool(a.fullmatch(text)) == bool(b.fullmatch(text))


def test_decimal_digits():
    assert [decimal_digits(7, n) for n in (16, 25, 30, 7, 14, -50)] == ["0.4375", "0.28", None, "1", "0.5", "-0.14"]
    assert (decimal_digits(-3, 2), decimal_digits(0, 5), decimal_digits(7, -1)) == ("-1.5", "0", "-7")


def test_resolve():
    assert resolve("ex:a", None, {"ex": "http://ex.test/"}) == "http://ex.test/a"
    assert resolve("urn:a", "http://b.c/", {}) == "urn:a"
    assert resolve("../x", "http://b.c/d/e", {}) == "http://b.c/x"


trees = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**80), 2**80) | st.floats(allow_nan=False) | st.text() | st.binary(),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4) | st.builds(cbor.Tagged, st.integers(4, 2**40), x),
    max_leaves=20,
)


@given(trees)
def test_cbor_round_trip(tree):
    assert cbor.decode(cbor.encode(tree)) == tree


def test_cbor_vectors():
    for text, value in (("00", 0), ("1864", 100), ("20", -1), ("3903e7", -1000), ("c249010000000000000000", 2**64), ("c349010000000000000000", -(2**64) - 1), ("f90000", 0.0), ("f93c00", 1.0), ("fa47c35000", 100000.0), ("9f0102ff", [1, 2]), ("bf6161 01ff".replace(" ", ""), {"a": 1}), ("7f61616162ff", "ab")):
        assert cbor.decode(bytes.fromhex(text)) == value
    for bad in ("", "18", "61", "1c", "0000"):
        with pytest.raises(ValueError):
            cbor.decode(bytes.fromhex(bad))


def test_tagged_cbor():
    layouts = Layouts()
    ref = layouts.add({"prefixes": {"c": "https://ns.test/cbor#"}, "type": "record", "fields": {"name": {"value": {"type": "string", "extra": {"c:tag": 42}}, "property": "http://ex.test/name"}}})
    assert cbor.decode(cbor.encode(cbor.typed_tree(layouts, ref, {"name": "Ann"}, cbor.tags(layouts, ref)))) == {"name": cbor.Tagged(42, "Ann")}
    bad = Layouts()
    ref = bad.add({"type": "string", "extra": {"https://ns.test/cbor#tag": "x"}})
    with pytest.raises(LayoutError, match="INVALID_TAG"):
        cbor.tags(bad, ref)


@layout(prefixes={"ex": "http://ex.test/"}, id="ex:Address")
class Address:
    street: str = prop("ex:street")


@layout(prefixes={"ex": "http://ex.test/"}, id="ex:Person")
class Person:
    name: str = prop("ex:name")
    address: Address | None = prop("ex:address")
    friends: set[Id] = prop("ex:friend")


def test_schema():
    layouts = Layouts()
    ref = layouts.add(Person.layout)
    assert to_spark_type(layouts, ref).simpleString() == "struct<address:struct<street:string>,friends:array<string>,name:string>"
    assert to_ddl(layouts, ref) == "`address` STRUCT<STREET:STRING>, `friends` ARRAY<STRING>, `name` STRING NOT NULL"
    schema = to_json_schema(layouts, ref)
    person = schema["$defs"]["Person"]
    assert person["required"] == ["name"] and person["properties"]["address"] == {"$ref": "#/$defs/Address"}
    assert person["properties"]["friends"] == {"type": "array", "items": {"type": "string", "format": "iri"}}


def test_classes_of_their_own_kind():
    @layout("list", prefixes={"ex": "http://ex.test/"}, head="_:self", tail="ex:end")
    class Steps:
        step: str = prop(head="here", rest="there", intro="x", input="_:x", dataset=[["_:here", "ex:does", "_:x"], ["_:here", "ex:then", "_:there"]])

    @layout("string", prefixes={"ex": "http://ex.test/"}, datatype="ex:Code", pattern="[A-Z]", resource="_:self")
    class Code: ...

    layouts = Layouts()
    steps, code = layouts[layouts.add(Steps.layout)], layouts[layouts.add(Code.layout)]
    assert steps.tail == "<http://ex.test/end>" and [q[1] for q in steps.node.dataset] == ["<http://ex.test/does>", "<http://ex.test/then>"]
    assert code.datatype == "http://ex.test/Code" and code.pattern == "[A-Z]"
    with pytest.raises(LayoutError, match="one annotation"):

        @layout("set")
        class Two:
            a: str = prop("http://ex.test/a")
            b: str = prop("http://ex.test/b")


def test_type_names():
    assert [type_name(x) for x in ("my-layout name", "a", "2x")] == ["MyLayoutName", "A", "_2x"]


def test_escapes():
    assert escape('a"b\\c\nd\re') == 'a\\"b\\\\c\\nd\\re'
