"""Terms as strings in canonical N-Quads form, in Python and as column expressions.

An IRI is ``<...>``, a blank node ``_:...``, a literal ``"..."`` with ``^^<datatype>`` or
``@lang``; plain literals are xsd:string. Inside a literal only ``\\``, ``"``, line feed and
carriage return are escaped, so equal terms are equal strings.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD_STRING, XSD_BOOLEAN = XSD + "string", XSD + "boolean"
RDF_FIRST, RDF_REST, RDF_NIL = RDF + "first", RDF + "rest", RDF + "nil"

#: Characters that an IRI must not have, and its leading scheme.
IRI_PATTERN = r'^[A-Za-z][A-Za-z0-9+.-]*:[^\x00-\x20<>"{}|^`\\]*$'
DECIMAL_PATTERN = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$"
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"))


def escape(text: str) -> str:
    for raw, shown in _ESCAPES:
        text = text.replace(raw, shown)
    return text


def iri(value: str) -> str:
    return f"<{value}>"


def literal(value: str, datatype: str = XSD_STRING, lang: str | None = None) -> str:
    shown = f'"{escape(value)}"'
    return f"{shown}@{lang.lower()}" if lang else shown if datatype == XSD_STRING else f"{shown}^^<{datatype}>"


def is_iri(value: str) -> bool:
    return re.match(IRI_PATTERN, value) is not None


def parse_term(text: str) -> str:
    """A term as a user writes it: a blank node, an IRI, or a term in canonical form."""
    if text.startswith(("_:", "<", '"')):
        return text
    if is_iri(text):
        return iri(text)
    raise ValueError(f"neither a blank node nor an IRI: {text!r}")


def suffix(datatype: str) -> str:
    """What follows the text of a literal of this datatype."""
    return '"' if datatype == XSD_STRING else f'"^^<{datatype}>'


def escape_col(text: Column) -> Column:
    for raw, shown in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def unescape_col(text: Column) -> Column:
    plain = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    for raw, shown in _ESCAPES[1:]:
        plain = F.replace(plain, F.lit(shown), F.lit(raw))
    return F.when(F.contains(text, F.lit("\\")), F.replace(plain, F.lit("\x00"), F.lit("\\"))).otherwise(text)


def literal_col(value: Column, datatype: str = XSD_STRING) -> Column:
    return F.concat(F.lit('"'), escape_col(value), F.lit(suffix(datatype)))


def plain_literal_col(value: Column, datatype: str) -> Column:
    """The same for values without characters to escape (numbers, booleans, dates)."""
    return F.concat(F.lit('"'), value, F.lit(suffix(datatype)))


def lang_literal_col(value: Column, lang: Column) -> Column:
    return F.concat(F.lit('"'), escape_col(value), F.lit('"@'), F.lower(lang))


def iri_col(value: Column) -> Column:
    return F.concat(F.lit("<"), value, F.lit(">"))


def is_iri_col(term: Column) -> Column:
    return F.startswith(term, F.lit("<"))


def is_literal_col(term: Column) -> Column:
    return F.startswith(term, F.lit('"'))


def has_datatype(term: Column, datatype: str) -> Column:
    """Whether a term is a literal of exactly this datatype."""
    return is_literal_col(term) & F.endswith(term, F.lit(suffix(datatype))) & (F.length(term) > len(suffix(datatype)))


def text_of(term: Column, datatype: str) -> Column:
    """The text of a literal of this datatype, without unescaping."""
    return F.substring(term, F.lit(2), F.length(term) - len(suffix(datatype)) - 1)


def iri_text(term: Column) -> Column:
    return F.substring(term, F.lit(2), F.length(term) - 2)


def resolve(reference: str, base: str | None, prefixes: dict[str, str]) -> str:
    """A compact, absolute or relative IRI made absolute."""
    scheme, colon, rest = reference.partition(":")
    if colon and scheme in prefixes:
        return prefixes[scheme] + rest
    if is_iri(reference):
        return reference
    if base is None:
        raise ValueError(f"no base IRI for {reference!r}")
    from urllib.parse import urljoin

    return urljoin(base, reference)
