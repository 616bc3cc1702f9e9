"""CBOR trees (RFC 8949): a small codec, applied by Arrow batches."""

from __future__ import annotations

import json
import math
import re
import struct
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.plans.layouts import Data, Layout, LayoutError, Layouts, Ordered, Product, Sized, Sum, Unit, Unordered

FORMATS = ("application/cbor", "cbor")
#: A layout property whose integer value is the tag of the layout's values.
TAG_PROPERTY = re.compile(r"[a-z]+://[^#]+/cbor#tag")


def _head(major: int, n: int) -> bytes:
    for limit, code, form in ((24, n, ""), (1 << 8, 24, ">B"), (1 << 16, 25, ">H"), (1 << 32, 26, ">I"), (1 << 64, 27, ">Q")):
        if n < limit:
            return bytes([major << 5 | code]) + (struct.pack(form, n) if form else b"")
    raise OverflowError(n)


class Tagged:
    def __init__(self, tag: int, value: Any):
        self.tag, self.value = tag, value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Tagged) and (self.tag, self.value) == (other.tag, other.value)

    def __repr__(self) -> str:
        return f"Tagged({self.tag}, {self.value!r})"


def encode(x: Any) -> bytes:
    if x is None:
        return b"\xf6"
    if isinstance(x, bool):
        return b"\xf5" if x else b"\xf4"
    if isinstance(x, Decimal):
        x = int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, int):
        n = x if x >= 0 else -1 - x
        if n < 1 << 64:
            return _head(0 if x >= 0 else 1, n)
        raw = n.to_bytes(-(-n.bit_length() // 8), "big")
        return _head(6, 2 if x >= 0 else 3) + _head(2, len(raw)) + raw
    if isinstance(x, float):
        return b"\xfb" + struct.pack(">d", x)
    if isinstance(x, bytes | bytearray):
        return _head(2, len(x)) + bytes(x)
    if isinstance(x, str):
        raw = x.encode()
        return _head(3, len(raw)) + raw
    if isinstance(x, Tagged):
        return _head(6, x.tag) + encode(x.value)
    if isinstance(x, list | tuple):
        return _head(4, len(x)) + b"".join(map(encode, x))
    if isinstance(x, dict):
        return _head(5, len(x)) + b"".join(encode(k) + encode(v) for k, v in x.items())
    raise TypeError(f"no CBOR for {type(x).__name__}")


def _half(n: int) -> float:
    exponent, mantissa = n >> 10 & 31, n & 1023
    size = mantissa * 2.0**-24 if exponent == 0 else (mantissa + 1024) * 2.0 ** (exponent - 25) if exponent < 31 else math.nan if mantissa else math.inf
    return -size if n >> 15 else size


def decode(data: bytes) -> Any:
    value, at = _decode(data, 0)
    if at != len(data):
        raise ValueError("bytes after the value")
    return value


_BREAK = object()


def _decode(data: bytes, at: int) -> tuple[Any, int]:
    if at >= len(data):
        raise ValueError("unexpected end of CBOR")
    major, info = data[at] >> 5, data[at] & 31
    at += 1
    n = info
    if 24 <= info <= 27:
        size = 1 << (info - 24)
        if at + size > len(data):
            raise ValueError("unexpected end of CBOR")
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    elif 28 <= info <= 30 or info == 31 and major in (0, 1, 6):
        raise ValueError("reserved CBOR length")
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        if info == 31:
            parts = []
            while True:
                part, at = _decode(data, at)
                if part is _BREAK:
                    return (b"" if major == 2 else "").join(parts), at
                parts.append(part)
        if at + n > len(data):
            raise ValueError("unexpected end of CBOR")
        raw = data[at : at + n]
        return (raw if major == 2 else raw.decode()), at + n
    if major == 4:
        items = []
        while info == 31 or len(items) < n:
            item, at = _decode(data, at)
            if item is _BREAK:
                break
            items.append(item)
        return items, at
    if major == 5:
        out: dict = {}
        k = 0
        while info == 31 or k < n:
            key, at = _decode(data, at)
            if key is _BREAK:
                break
            value, at = _decode(data, at)
            out[key if isinstance(key, str | int | bool | bytes | float | None) else json.dumps(key)] = value
            k += 1
        return out, at
    if major == 6:
        value, at = _decode(data, at)
        if n in (2, 3) and isinstance(value, bytes):
            number = int.from_bytes(value, "big")
            return (number if n == 2 else -1 - number), at
        return Tagged(n, value), at
    if info == 31:
        return _BREAK, at
    if info in (20, 21):
        return info == 21, at
    if info in (22, 23):
        return None, at
    if info == 25:
        return _half(n), at
    if info in (26, 27):
        return struct.unpack(">f" if info == 26 else ">d", data[at - (4 if info == 26 else 8) : at])[0], at
    raise ValueError(f"CBOR simple value {n}")


def plain(x: Any) -> Any:
    """A decoded value as JSON: tags are dropped, bytes are hexadecimal, keys are texts."""
    if isinstance(x, Tagged):
        return plain(x.value)
    if isinstance(x, bytes):
        return x.hex()
    if isinstance(x, list):
        return [plain(v) for v in x]
    if isinstance(x, dict):
        return {k if isinstance(k, str) else json.dumps(plain(k)): plain(v) for k, v in x.items()}
    return x


def tags(layouts: Layouts, ref: str) -> dict[str, int]:
    """The tags of a layout and all those it calls."""
    out = {}
    for r in {ref} | layouts.reachable(ref):
        for name, value in getattr(layouts[r], "extra", ()):
            if TAG_PROPERTY.fullmatch(name):
                if isinstance(value, tuple):
                    value = int(value[0]) if value[1].endswith("#unsignedLong") and value[0].isdigit() else None
                if isinstance(value, bool) or not isinstance(value, int) or value < 0:
                    raise LayoutError(f"INVALID_TAG: {r}")
                out[r] = value
    return out


def typed_tree(layouts: Layouts, ref: str, value: Any, tagged: dict[str, int]) -> Any:
    """A hydrated typed value as the tree to encode."""
    layout: Layout = layouts[ref]
    of = lambda call, v: typed_tree(layouts, call.ref, v, tagged)
    if layouts.recursive(ref):
        out = json.loads(value)
    elif isinstance(layout, Product):
        out = {f.name: of(f.value, value[f.name]) for f in layout.fields if value[f.name] is not None}
    elif isinstance(layout, Sum):
        chosen = layout.variants[value["tag"]]
        out = of(chosen.value, value[chosen.name])
    elif isinstance(layout, Unordered | Ordered):
        part = layout.item if isinstance(layout, Unordered) else layout.node
        out = [of(part.value, v) for v in value]
    elif isinstance(layout, Sized):
        out = [of(x.value, value[f"_{i}"]) for i, x in enumerate(layout.items)]
    elif isinstance(layout, Unit):
        out = layout.const
    elif isinstance(layout, Data) and layout.kind == "number":
        out = Decimal(value)
    else:
        out = value
    return Tagged(tagged[ref], out) if ref in tagged else out


def to_cbor(trees: DataFrame, layouts: Layouts, ref: str, column: str = "value", key: str = "in0") -> DataFrame:
    """(key, cbor) of hydrated trees, tagged where their layout says so."""
    tagged = tags(layouts, ref)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            shown = [None if v is None else encode(typed_tree(layouts, ref, v, tagged)) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown, pa.binary())], ["key", "cbor"])

    return trees.select(F.col(key).alias("key"), F.col(column).alias("value")).mapInArrow(run, "key string, cbor binary")


def json_to_cbor(lines: DataFrame, column: str = "json") -> DataFrame:
    """The column as untagged CBOR, in a column ``cbor``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            shown = [None if x is None else encode(json.loads(x, parse_float=Decimal)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shown, pa.binary())], ["cbor"])

    return lines.select(column).mapInArrow(run, "cbor binary")


def from_cbor(rows: DataFrame, column: str = "content", key: str = "path") -> DataFrame:
    """(key, value: VARIANT) of a column of CBOR documents."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            shown = [None if x is None else json.dumps(plain(decode(x))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown, pa.string())], ["key", "json"])

    texts = rows.select(F.col(key).cast("string").alias("key"), F.col(column).alias("content")).mapInArrow(run, "key string, json string")
    return texts.select("key", F.parse_json("json").alias("value"))


def read_cbor(spark: SparkSession, path: str) -> DataFrame:
    """One document a file."""
    return from_cbor(spark.read.format("binaryFile").load(path))
