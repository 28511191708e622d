"""Graphs over tables whose terms stay native columns until they are printed.

A ``TableMap`` says how a table's rows are triples. A ``Graph`` is a set of such maps beside plain tables of triples (s, p, o), each with the
predicates that it may hold. Wherever a plain triple table is asked for, a graph stands for its printed triples.

A ``Kind`` tells how native columns make a term: an IRI by a table's key, a literal by a column. Constants are compared with
the columns themselves, so such filters reach the files; equal kinds are joined on the columns, numbers as numbers.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafthorn.functions import terms as t

BASE = "http://ex.org/"
_KINDS = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "double": "double", "float": "float", "boolean": "boolean", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "date": "date", "string": "string"}
_DATATYPES = {"integer": "integer", "double": "double", "float": "float", "boolean": "boolean", "timestamp": "dateTime", "date": "date", "string": "string"}


@dataclass(frozen=True)
class Kind:
    """A kind of term: ``term`` (printed), ``iri`` of a table by the kinds of its key, ``tagged`` (text and language), or a column's type."""

    name: str
    table: str = ""
    key: tuple[str, ...] = ()

    @property
    def width(self) -> int:
        return len(self.key) if self.name == "iri" else 2 if self.name == "tagged" else 1

    @property
    def joins(self) -> bool:
        """Are terms equal exactly where the columns are? Doubles and times are printed first, as 0.0 and -0.0, or parts of a second, tell."""
        return self.name in ("term", "integer", "string", "boolean", "date") or self.name == "iri" and (len(self.key) == 1 or set(self.key) == {"integer"})

    def lexical(self, cols: Sequence[Column]) -> Column:
        """The text between a literal's quotes or an IRI's brackets."""
        if self.name == "iri":
            return F.concat_ws("/", F.lit(f"{BASE}{self.table}"), *(c.cast("string") for c in cols))
        return F.date_format(cols[0], "yyyy-MM-dd'T'HH:mm:ss'Z'") if self.name == "timestamp" else cols[0].cast("string")

    def printed(self, cols: Sequence[Column]) -> Column:
        if self.name == "term":
            return cols[0]
        if self.name == "iri":
            return t.iri(self.lexical(cols))
        return t.literal(self.lexical(cols), lang=cols[1]) if self.name == "tagged" else t.literal(self.lexical(cols), t.XSD + _DATATYPES[self.name])

    def equals(self, cols: Sequence[Column], term: str) -> Column | None:
        """Where the columns make this constant term; None if they never do."""
        if self.name == "iri":
            start = f"<{BASE}{self.table}/"
            if not (term.startswith(start) and term.endswith(">")):
                return None
            parts = term[len(start) : -1].split("/") if len(self.key) > 1 else [term[len(start) : -1]]
            if self.joins and len(parts) == len(self.key):
                return _all([_is(k, c, x) for k, c, x in zip(self.key, cols, parts, strict=True)])
            return None if self.joins else self.printed(cols) == term
        found = re.fullmatch(r'(?s)"(.*)"(?:\^\^<([^"]*)>|(@[A-Za-z0-9-]+))?', term)
        if self.name == "term" or self.name == "tagged" and found and found[3]:
            return self.printed(cols) == term
        if not found or self.name == "tagged" or found[3] or (found[2] or t.XSD + "string") != t.XSD + _DATATYPES[self.name]:
            return None
        if self.name in ("integer", "string"):
            return _is(self.name, cols[0], found[1]) if found[2] != t.XSD + "string" else None
        near = F.lit(True)
        if self.name == "double" and re.fullmatch(r"-?\d+\.\d+(E-?\d+)?", found[1]):
            # Not by =, which would let the printed column become the constant's own text, also for -0.0.
            near = cols[0].between(float(found[1]), float(found[1]))
        return near & (self.printed(cols) == term)


TERM = Kind("term")


def _is(kind: str, c: Column, text: str) -> Column | None:
    """A key or column is what this text prints."""
    if kind == "string":
        return c == F.lit(text)
    return c == F.lit(int(text)) if re.fullmatch(r"0|-?[1-9]\d{0,17}", text) else None


def _all(tests: Sequence[Column | None]) -> Column | None:
    return None if any(x is None for x in tests) else reduce(lambda a, b: a & b, tests)


def never_equal(a: Kind, b: Kind) -> bool:
    """Kinds of which no two terms are the same."""
    if TERM in (a, b):
        return False
    if a.name == b.name == "iri":
        plain = all("/" not in k.table and set(k.key) == {"integer"} for k in (a, b))
        return plain and (a.table != b.table or len(a.key) != len(b.key))
    return a.name != b.name


@dataclass(frozen=True)
class TableMap:
    """A table's rows as triples: a type, a literal for each column, an IRI for each reference. ``unique``: rows with the same key have the same values."""

    df: DataFrame
    table: str
    key: tuple[str, ...]
    columns: tuple[str, ...] = ()
    refs: tuple[tuple[str, str], ...] = ()
    langs: tuple[tuple[str, str], ...] = ()
    typed: bool = True
    unique: bool = False

    def kind_of(self, column: str) -> str:
        return _KINDS.get(self.df.schema[column].dataType.simpleString(), "")

    @property
    def subject(self) -> Kind:
        return Kind("iri", self.table, tuple(self.kind_of(k) or "string" for k in self.key))

    def subject_columns(self) -> list[Column]:
        """The key; columns of other types are strings."""
        return [F.col(k) if self.kind_of(k) in ("integer", "string") else F.col(k).cast("string") for k in self.key]

    def predicates(self) -> list[str]:
        return [*([t.TYPE] if self.typed else []), *(f"<{BASE}{c}>" for c in (*self.columns, *(c for c, _ in self.refs)))]

    def objects(self, predicate: str) -> list[tuple[Kind, list[Column], Column]]:
        """(kind, columns, where there is one) of the objects of a predicate; a column and a reference may share one."""
        out = []
        if self.typed and predicate == t.TYPE:
            out.append((TERM, [F.lit(f"<{BASE}{self.table}>")], F.lit(True)))
        langs = dict(self.langs)
        for c in self.columns:
            if predicate == f"<{BASE}{c}>":
                name, some = self.kind_of(c), F.col(c).isNotNull()
                if c in langs:
                    out.append((Kind("tagged"), [F.col(c).cast("string"), F.col(langs[c])], some & F.col(langs[c]).isNotNull()))
                else:
                    out.append((Kind(name or "string"), [F.col(c) if name else F.col(c).cast("string")], some))
        for c, target in self.refs:
            if predicate == f"<{BASE}{c}>":
                name = self.kind_of(c)
                out.append((Kind("iri", target, (name if name in ("integer", "string") else "string",)), [F.col(c) if name in ("integer", "string") else F.col(c).cast("string")], F.col(c).isNotNull()))
        return out

    def triples(self, wanted: Sequence[str] | None = None) -> list[DataFrame]:
        """Printed triples, a table for each of the wanted predicates: a pattern with a constant one leaves the others out of its plan."""
        s = self.subject.printed(self.subject_columns()).alias("s")
        has = F.lit(True)
        for k in self.key:
            has = has & F.col(k).isNotNull()
        return [self.df.where(has & some).select(s, F.lit(p).alias("p"), kind.printed(cols).alias("o")) for p in self.predicates() if wanted is None or p in wanted for kind, cols, some in self.objects(p)]


class Graph:
    """Table maps, and plain triple tables with the predicates that they may hold (None: any)."""

    def __init__(self, maps: Sequence[TableMap] = (), plain: Sequence[tuple[DataFrame, frozenset[str] | None]] = ()):
        self.maps, self.plain = tuple(maps), tuple(plain)
        self._printed: DataFrame | None = None
        #: Tables that were made from all triples once, by name.
        self.kept: dict[str, DataFrame] = {}

    def __getattr__(self, name: str):
        """Whatever else is asked of a graph is asked of its printed triples."""
        if name.startswith("__"):
            raise AttributeError(name)
        return getattr(self.triples(), name)

    def triples(self) -> DataFrame:
        if self._printed is None:
            self._printed = self.of_predicates(None)
        return self._printed

    def of_predicates(self, wanted: Sequence[str] | None) -> DataFrame | None:
        """Printed triples with these predicates (None: all), from those tables alone that may hold them; None if there are no such tables."""
        parts = [x for m in self.maps for x in m.triples(wanted)]
        for df, holds in self.plain:
            if wanted is None or holds is None or holds & set(wanted):
                parts.append(df.select("s", "p", "o") if wanted is None else df.select("s", "p", "o").where(F.col("p").isin(*wanted)))
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else None

    def with_triples(self, df: DataFrame, predicates: Sequence[str] | None = None) -> Graph:
        return Graph(self.maps, (*self.plain, (df, None if predicates is None else frozenset(predicates))))

    @property
    def sparkSession(self):  # noqa: N802 - as a DataFrame has it
        return (self.maps[0].df if self.maps else self.plain[0][0]).sparkSession


def as_graph(triples: DataFrame | Graph) -> Graph:
    return triples if isinstance(triples, Graph) else Graph((), [(triples, None)])


def plain_triples(triples: DataFrame | Graph) -> DataFrame:
    return triples.triples() if isinstance(triples, Graph) else triples
