"""RDF terms as strings, and the columns that build and take them apart.

``<iri>``, ``_:label``, ``"lexical"``, ``"lexical"@tag`` and ``"lexical"^^<datatype>``; nothing is escaped. A literal is cut
at its last quote, since neither tags nor datatypes hold one. Term identity is string equality, so joins,
anti joins and duplicate removal work on plain string columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
SH = "http://www.w3.org/ns/shacl#"
TYPE, FIRST, REST, NIL = (f"<{RDF}{n}>" for n in ("type", "first", "rest", "nil"))
SUBCLASS = f"<{RDFS}subClassOf>"
NUMERIC = tuple(XSD + n for n in ("integer", "decimal", "double", "float"))
#: Leading number of a lexical form, as a lenient float reader takes it.
LEADING_NUMBER = r"^\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"


def iri(text: Column | str) -> Column:
    return F.concat(F.lit("<"), F.lit(text) if isinstance(text, str) else text, F.lit(">"))


def literal(lexical: Column, datatype: str | None = None, lang: Column | str | None = None) -> Column:
    """A literal; xsd:string is left off, tags are in lower case."""
    if lang is not None:
        return F.concat(F.lit('"'), lexical, F.lit('"@'), F.lower(F.lit(lang) if isinstance(lang, str) else lang))
    tail = f'"^^<{datatype}>' if datatype and datatype != XSD + "string" else '"'
    return F.concat(F.lit('"'), lexical, F.lit(tail))


def is_iri(term: Column) -> Column:
    return term.startswith("<")


def is_blank(term: Column) -> Column:
    return term.startswith("_:")


def is_literal(term: Column) -> Column:
    return term.startswith('"')


def lex(term: Column) -> Column:
    """Lexical form of a literal, text of an IRI, label of a blank node."""
    quoted = F.regexp_extract(term, r'(?s)^"(.*)"', 1)
    return F.when(is_literal(term), quoted).when(is_iri(term), F.substring(term, 2, F.length(term) - 2)).otherwise(F.substring(term, 3, F.length(term)))


def lang(term: Column) -> Column:
    """Tag of a literal, else ''."""
    return F.when(is_literal(term), F.regexp_extract(term, r'(?s)^".*"@([A-Za-z0-9-]+)$', 1)).otherwise("")


def datatype(term: Column) -> Column:
    """Datatype of a literal as plain text; null for other terms."""
    typed = F.regexp_extract(term, r'(?s)^".*"\^\^<([^"]*)>$', 1)
    return F.when(
        is_literal(term), F.when(term.endswith('"'), F.lit(XSD + "string")).when(term.endswith(">"), typed).otherwise(F.lit(RDF + "langString"))
    )


def leading_number(text: Column) -> Column:
    return F.regexp_extract(text, LEADING_NUMBER, 1).try_cast("double")


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` in the plan once, however often ``use`` needs it: keeps the generated code small."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _number_text(x: Column) -> Column:
    a = F.abs(x)
    plain = lambda kind: F.regexp_replace(x.cast(kind).cast("string"), r"\.?0+$", "")
    power = F.regexp_replace(F.regexp_replace(x.cast("string"), r"\.0E", "E"), r"E(\d)", "e+$1")
    return (
        F.when((a < 1e15) & (x == F.floor(x)), F.floor(x).cast("bigint").cast("string"))
        .when((a >= 1e-3) & (a < 1e7), x.cast("string"))
        .when((a >= 1e7) & (a < 1e21), F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(plain("decimal(38,16)")))
        .when((a >= 1e-6) & (a < 1e-3), plain("decimal(38,30)"))
        .otherwise(F.regexp_replace(power, "E-", "e-"))
    )


def number_text(x: Column) -> Column:
    """A double as JavaScript prints it: no trailing .0, plain digits from 1e-6 to 1e21."""
    return once(x, _number_text)


def number_term(x: Column) -> Column:
    """xsd:integer where integral, else xsd:decimal."""
    kind = lambda y: F.when(y == F.floor(y), f'"^^<{XSD}integer>').otherwise(f'"^^<{XSD}decimal>')
    return once(x, lambda y: F.concat(F.lit('"'), _number_text(y), kind(y)))


def id_of(term: Column) -> Column:
    """The number that ends an IRI such as <http://ex.org/orders/7>."""
    return F.regexp_extract(term, r"(\d+)>$", 1).try_cast("bigint")
