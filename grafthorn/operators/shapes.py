"""Shapes: targets and conformance of nodes, as DataFrame operations.

A ``Property`` has a path and constraints on its distinct values, a ``Shape`` has targets, constraints on the node
itself, and properties. ``focus_nodes`` gives the nodes that a shape targets, ``conforming`` those of them (or of
a given table of nodes) that meet every constraint.

Constraints of a property become flags per value, joined where they need the graph, and one aggregate per focus
node; an empty value set passes all but ``min_count``, ``has_value`` and ``some_value``.

Where the focus nodes are the rows of a table with a unique key, and all that a shape reads of them are its own columns, the shape is
a filter of that table (``row_test``): one scan, no join, and constants that reach the files. Where it also asks about rows of another table
that refer to them, those are tested as rows too and summed by their reference (``_referring``): the joins are on native keys.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafthorn.functions import terms as t
from grafthorn.functions.values import time_test
from grafthorn.operators.bindings import Bindings, holders, kept
from grafthorn.operators.bindings import names as names_of
from grafthorn.operators.patterns import Path, bindings, column, solutions
from grafthorn.sources.graph import BASE, TERM, Graph, Kind, TableMap, as_graph
from grafthorn.sources.shared import written
from grafthorn.sources.triples import list_members, union

MAX_DEPTH = 50
NODE_KINDS = ("IRI", "BlankNode", "Literal", "BlankNodeOrIRI", "BlankNodeOrLiteral", "IRIOrLiteral")
#: Links up to which a hierarchy is closed whole, once for all classes.
CLOSED = 1000
#: Datatypes that order as numbers and as times.
_NUMBERS = tuple(t.XSD + n for n in ("integer", "decimal", "double", "float", "int", "long"))
_TIMES = tuple(t.XSD + n for n in ("date", "dateTime", "dateTimeStamp"))


class UnsupportedShape(ValueError):
    """The shape has a part that isn't known."""


@dataclass(frozen=True)
class Property:
    path: str | Path | None
    constraints: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Shape:
    name: str
    targets: tuple = ()
    constraints: dict = field(default_factory=dict)
    properties: tuple[Property, ...] = ()


def nodes(triples: DataFrame) -> DataFrame:
    """All subjects and objects."""
    return triples.select(F.col("s").alias("node")).union(triples.select("o")).distinct()


def class_links(graph: Graph, doubled: int = 0) -> DataFrame | None:
    """(sub, super): classes and those that are 2 ** ``doubled`` links above them; None if there are no links. A graph keeps the tables."""
    name = f"links {doubled}"
    if graph.kept.get(name) is None:
        if doubled:
            half = class_links(graph, doubled - 1)
            ahead = half.select(F.col("sub").alias("super"), F.col("super").alias("above"))
            found = half.join(ahead, "super").select("sub", F.col("above").alias("super"))
        else:
            edges = graph.of_predicates([t.SUBCLASS])
            if edges is None:
                return None
            found = edges.select(F.col("s").alias("sub"), F.col("o").alias("super"))
        graph.kept[name] = written(found.distinct())
    return graph.kept[name]


def class_ancestors(triples: DataFrame | Graph) -> DataFrame | None:
    """(sub, super): every class with all classes above it, by links that double in length each pass; None if there are no links.

    A class of a cycle is also above itself. A graph keeps the table for all shapes that are asked of it.
    """
    graph = as_graph(triples)
    if graph.kept.get("ancestors") is None:
        found = class_links(graph)
        if found is None:
            return None
        number = found.count()
        while number:
            ahead = found.select(F.col("sub").alias("super"), F.col("super").alias("above"))
            further = found.join(ahead, "super").select("sub", F.col("above").alias("super"))
            found = written(found.union(further).distinct())
            before, number = number, found.count()
            if number == before:
                break
        graph.kept["ancestors"] = found
    return graph.kept["ancestors"]


def subclasses(triples: DataFrame | Graph, top: str) -> DataFrame:
    """(node): a class and all its transitive subclasses.

    A hierarchy of few links is closed whole. Of a larger one only the classes below ``top`` are found: after pass k those fewer than
    2 ** k links below it, by the links of that length, so no pass has more rows than classes where each has one above it. A pass that
    finds none is the last, since then no class is as far from ``top``.
    """
    graph = as_graph(triples)
    below = triples.sparkSession.createDataFrame([(top,)], "node string")
    links = class_links(graph)
    if links is None:
        return below
    if links.limit(CLOSED + 1).count() <= CLOSED:
        return below.union(class_ancestors(graph).where(F.col("super") == top).select("sub")).distinct()
    number, doubled = 1, 0
    while True:
        reached = class_links(graph, doubled).join(below.withColumnRenamed("node", "super"), "super", "left_semi").select(F.col("sub").alias("node"))
        below = written(below.union(reached).distinct())
        before, number = number, below.count()
        if number == before:
            return below
        doubled += 1


def instances_of(triples: DataFrame, top: str) -> DataFrame:
    """(node): instances of a class or of its subclasses."""
    classes = subclasses(triples, top).withColumnRenamed("node", "class")
    typed = triples.where(F.col("p") == t.TYPE).select(F.col("s").alias("node"), F.col("o").alias("class"))
    return typed.join(classes, "class", "left_semi").select("node").distinct()


def focus_nodes(triples: DataFrame, shape: Shape) -> DataFrame:
    """(node): the union of a shape's targets.

    Targets: ("class", iri), ("node", term), ("subjects_of", iri), ("objects_of", iri), ("where", shape). Nodes that point at
    the shape by sh:shape are always targets.
    """
    spark = triples.sparkSession
    parts = [triples.where((F.col("p") == f"<{t.SH}shape>") & (F.col("o") == shape.name)).select(F.col("s").alias("node"))]
    for kind, x in shape.targets:
        if kind == "class":
            parts.append(instances_of(triples, x))
        elif kind == "node":
            parts.append(spark.createDataFrame([(x,)], "node string"))
        elif kind == "subjects_of":
            parts.append(triples.where(F.col("p") == x).select(F.col("s").alias("node")))
        elif kind == "objects_of":
            parts.append(triples.where(F.col("p") == x).select(F.col("o").alias("node")))
        elif kind == "where":
            parts.append(conforming(triples, x, nodes(triples)))
        else:
            raise UnsupportedShape(f"target {kind}")
    return union(*parts).distinct()


def path_values(triples: DataFrame, path: str | Path | None, focus: DataFrame) -> DataFrame:
    """(node, value): distinct values at the end of a path from each focus node."""
    if path is None:
        return focus.select("node", F.col("node").alias("value")).where(F.lit(False))
    found = solutions(triples, [("?node", path, "?value")], focus.select(F.col("node").alias(column("node"))))
    return found.select(F.col(column("node")).alias("node"), F.col(column("value")).alias("value")).distinct()


def _kind_test(v: Column, kind: str) -> Column:
    if kind not in NODE_KINDS:
        raise UnsupportedShape(f"node kind {kind}")
    tests = {"IRI": t.is_iri(v), "BlankNode": t.is_blank(v), "Literal": t.is_literal(v)}
    return reduce(lambda a, b: a | b, (test for name, test in tests.items() if name in kind.split("Or")))


def _ordered(v: Column, bound: str, how: Callable[[Column, Column], Column]) -> Column:
    """Numbers with numbers, times with times; anything else fails."""
    b, kind = F.lit(bound), t.datatype(v)
    number = F.when(t.datatype(b).isin(*_NUMBERS) & kind.isin(*_NUMBERS), how(t.lex(v).try_cast("double"), t.lex(b).try_cast("double")))
    time = F.when(t.datatype(b).isin(*_TIMES) & kind.isin(*_TIMES), how(F.try_to_timestamp(t.lex(v)), F.try_to_timestamp(t.lex(b))))
    return F.coalesce(number, time, F.lit(False))


_RANGES = {"min_inclusive": lambda a, b: a >= b, "max_inclusive": lambda a, b: a <= b, "min_exclusive": lambda a, b: a > b, "max_exclusive": lambda a, b: a < b}
#: Constraints that each value meets or not by itself.
_PER_VALUE = ("datatype", "node_kind", "in", *_RANGES, "min_length", "max_length", "pattern", "language_in")
_BY_GRAPH = ("class", "root_class", "node", "not", "and", "or", "xone", "member_shape", "min_list_length", "max_list_length", "unique_members")
_BY_SET = ("min_count", "max_count", "has_value", "some_value", "unique_lang", "subset_of")
_IGNORED = ("flags", "reifier_shape", "reification_required")
_ON_NODES = ("class", "datatype", "node_kind", "has_value", "in", "node", "not", "and", "or", "xone", "root_class", "some_value", "subset_of")
_OPS = {"min_inclusive": "ge", "max_inclusive": "le", "min_exclusive": "gt", "max_exclusive": "lt"}


def bound_of(term: str) -> float | datetime | None:
    """What a bound orders by: a number, or a time of UTC; None if it can't be ordered."""
    found = re.fullmatch(r'(?s)"(.*)"\^\^<([^"]*)>', term)
    try:
        if found and found[2] in _NUMBERS:
            return float(found[1])
        if found and found[2] in _TIMES:
            at = datetime.fromisoformat(found[1].replace("Z", "+00:00"))
            return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at
    except ValueError:
        pass
    return None


def _unordered(constraints: dict) -> bool:
    """A bound that can't be ordered fails every node, even one without values."""
    return any(bound_of(x) is None for k, x in constraints.items() if k in _RANGES)


def _value_test(v: Column, kind: str, x, constraints: dict) -> Column:
    if kind == "datatype":
        return F.coalesce(t.datatype(v) == x.strip("<>"), F.lit(False))
    if kind == "node_kind":
        return _kind_test(v, x)
    if kind == "in":
        return v.isin(*x)
    if kind in _RANGES:
        return _ordered(v, x, _RANGES[kind])
    if kind == "min_length":
        return ~t.is_blank(v) & (F.length(t.lex(v)) >= x)
    if kind == "max_length":
        return ~t.is_blank(v) & (F.length(t.lex(v)) <= x)
    if kind == "pattern":
        flags = "".join(f for f in "ism" if f in constraints.get("flags", ""))
        return ~t.is_blank(v) & t.lex(v).rlike(f"(?{flags}){x}" if flags else x)
    tag = F.lower(t.lang(v))
    return t.is_literal(v) & reduce(lambda a, b: a | b, ((tag == c.lower()) | tag.startswith(c.lower() + "-") for c in x))


def _members_of(triples: DataFrame, values: DataFrame) -> DataFrame:
    return list_members(triples, values.select(F.col("value").alias("head")).distinct())


def _graph_test(triples: DataFrame, values: DataFrame, kind: str, x, depth: int) -> DataFrame:
    """(value) of those distinct values that meet a constraint that needs the graph."""
    distinct = values.select("value").distinct()
    as_nodes = distinct.select(F.col("value").alias("node"))
    renamed = lambda df: df.withColumnRenamed("node", "value")
    if kind == "class":
        return distinct.join(renamed(instances_of(triples, x)), "value", "left_semi")
    if kind == "root_class":
        return distinct.join(renamed(subclasses(triples, x)), "value", "left_semi")
    if kind == "node":
        return renamed(conforming(triples, x, as_nodes, depth + 1))
    if kind == "not":
        return distinct.join(renamed(conforming(triples, x, as_nodes, depth + 1)), "value", "left_anti")
    if kind in ("and", "or", "xone"):
        met = union(*(renamed(conforming(triples, s, as_nodes, depth + 1)) for s in x)).groupBy("value").agg(F.count("*").alias("n"))
        most = {"and": F.col("n") == len(x), "or": F.col("n") >= 1, "xone": F.col("n") == 1}[kind]
        return met.where(most).select("value")
    members = written(_members_of(triples, values))
    if kind == "member_shape":
        good = conforming(triples, x, members.select(F.col("member").alias("node")).distinct(), depth + 1)
        bad = members.join(good.withColumnRenamed("node", "member"), "member", "left_anti").select(F.col("head").alias("value"))
        return distinct.join(bad, "value", "left_anti")
    sizes = members.groupBy(F.col("head").alias("value")).agg(F.count("*").alias("n"), F.countDistinct("member").alias("d"))
    counted = distinct.join(sizes, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("d", F.lit(0)).alias("d"))
    test = {"min_list_length": lambda: F.col("n") >= x, "max_list_length": lambda: F.col("n") <= x, "unique_members": lambda: (F.col("n") == F.col("d")) | F.lit(not x)}[kind]()
    return counted.where(test).select("value")


def _met(triples: DataFrame, focus: DataFrame, values: DataFrame, constraints: dict, depth: int) -> DataFrame:
    """(node) of the focus nodes whose values (node, value) meet all constraints."""
    _known(constraints)
    v = F.col("value")
    tests = [_value_test(v, k, x, constraints) for k, x in constraints.items() if k in _PER_VALUE]
    flagged = values.select("node", "value", reduce(lambda a, b: a & b, tests, F.lit(True)).alias("_ok"))
    graph = [(k, x) for k, x in constraints.items() if k in _BY_GRAPH] + ([("some_value", constraints["some_value"])] if "some_value" in constraints else [])
    for n, (k, x) in enumerate(graph):
        passed = _graph_test(triples, values, "node" if k == "some_value" else k, x, depth).withColumn(f"_g{n}", F.lit(True))
        flagged = flagged.join(passed, "value", "left")
    every = reduce(lambda a, b: a & b, (F.coalesce(F.col(f"_g{n}"), F.lit(False)) for n, (k, _) in enumerate(graph) if k != "some_value"), F.coalesce("_ok", F.lit(False)))
    some = next((F.coalesce(F.col(f"_g{n}"), F.lit(False)) for n, (k, _) in enumerate(graph) if k == "some_value"), F.lit(True))
    tags = F.when(t.lang(v) != "", t.lang(v))
    wanted = [F.count("value").alias("n"), F.bool_and(every).alias("every"), F.bool_or(some).alias("some"), F.bool_or(v == constraints.get("has_value", "")).alias("has")]
    if constraints.get("unique_lang"):
        wanted += [F.count(tags).alias("tagged"), F.countDistinct(tags).alias("tags")]
    summed = focus.join(flagged.groupBy("node").agg(*wanted), "node", "left")
    n = F.coalesce("n", F.lit(0))
    keep = F.coalesce("every", F.lit(True)) & (n >= constraints.get("min_count", 0)) & F.lit(not _unordered(constraints))
    if "max_count" in constraints:
        keep = keep & (n <= constraints["max_count"])
    if "has_value" in constraints:
        keep = keep & F.coalesce("has", F.lit(False))
    if "some_value" in constraints:
        keep = keep & F.coalesce("some", F.lit(False)) & (n > 0)
    if constraints.get("unique_lang"):
        keep = keep & (F.coalesce("tagged", F.lit(0)) == F.coalesce("tags", F.lit(0)))
    out = summed.where(keep).select("node")
    if "subset_of" in constraints:
        other = path_values(triples, constraints["subset_of"], focus)
        out = out.join(values.join(other, ["node", "value"], "left_anti").select("node"), "node", "left_anti")
    return out


def _native_test(kind: Kind, cols: Sequence[Column], name: str, x, constraints: dict) -> Column | None:
    """Whether a value that isn't null meets a constraint, by its columns; None if that takes more than them."""
    data = {"integer": "integer", "double": "double", "float": "float", "boolean": "boolean", "timestamp": "dateTime", "date": "date", "string": "string"}
    if kind == TERM:
        return _value_test(cols[0], name, x, constraints)
    if name == "datatype":
        own = t.RDF + "langString" if kind.name == "tagged" else t.XSD + data[kind.name] if kind.name in data else ""
        return F.lit(own == x.strip("<>"))
    if name == "node_kind":
        if x not in NODE_KINDS:
            raise UnsupportedShape(f"node kind {x}")
        return F.lit(("IRI" if kind.name == "iri" else "Literal") in x.split("Or"))
    if name == "in":
        tests = [e for e in (kind.equals(cols, term) for term in x) if e is not None]
        return reduce(lambda a, b: a | b, tests, F.lit(False))
    if name in _RANGES:
        bound = bound_of(x)
        if isinstance(bound, float):
            return _RANGES[name](cols[0], F.lit(bound)) if kind.name in ("integer", "double", "float") else F.lit(False)
        if isinstance(bound, datetime) and kind.name == "timestamp":
            return time_test(cols[0], bound, _OPS[name])
        return _ordered(kind.printed(cols), x, _RANGES[name]) if isinstance(bound, datetime) and kind.name == "date" else F.lit(False)
    if name == "language_in":
        tag = F.lower(cols[1]) if kind.name == "tagged" else F.lit("")
        return reduce(lambda a, b: a | b, ((tag == c.lower()) | tag.startswith(c.lower() + "-") for c in x))
    lexical = kind.lexical(cols)
    if name == "pattern":
        flags = "".join(f for f in "ism" if f in constraints.get("flags", ""))
        return lexical.rlike(f"(?{flags}){x}" if flags else x)
    return F.length(lexical) >= x if name == "min_length" else F.length(lexical) <= x


def _row_values(graph: Graph, source: TableMap, path) -> tuple[Kind, list[Column], Column] | str | None:
    """The one value that a row has on a path; "none" if no triple can have its predicate, None if others than the row say."""
    if path is None:
        return "none"
    if isinstance(path, Path):
        if len(path.steps) != 1 or not path.steps[0][1]:
            return None
        path = path.steps[0][0]
    maps, plain = holders(graph, path)
    if not maps and not plain:
        return "none"
    found = source.objects(path)
    return found[0] if maps == [source] and not plain and len(found) == 1 else None


def row_test(graph: Graph, source: TableMap, shape: Shape, depth: int = 0) -> Column | None:
    """Whether a row of the table, as a node, conforms: never null. None if that takes more than the row."""
    if depth > MAX_DEPTH:
        raise RecursionError(f"shapes refer to each other more than {MAX_DEPTH} deep at {shape.name}")
    _checked(shape)
    tests = [_row_part(graph, source, (source.subject, source.subject_columns(), F.lit(True)), shape.constraints, depth, True)]
    for p in shape.properties:
        value = _row_values(graph, source, p.path)
        tests.append(None if value is None else _row_part(graph, source, value, p.constraints, depth))
    return None if any(x is None for x in tests) else reduce(lambda a, b: a & b, tests)


def _row_part(graph: Graph, source: TableMap, value, constraints: dict, depth: int, on_row: bool = False) -> Column | None:
    """The constraints of a property on the one value of a row, or on the row's own node."""
    _known(constraints)
    kind, cols, some = value if value != "none" else (TERM, [F.lit("")], F.lit(False))
    tests = [F.lit(not _unordered(constraints))]
    for name, x in constraints.items():
        test: Column | None = F.lit(True)
        if name in _PER_VALUE:
            own = _native_test(kind, cols, name, x, constraints)
            test = ~some | own
        elif name == "min_count":
            test = F.lit(True) if x <= 0 else some if x == 1 else F.lit(False)
        elif name == "max_count":
            test = F.lit(True) if x >= 1 else ~some
        elif name == "has_value":
            same = kind.equals(cols, x)
            test = some & same if same is not None else F.lit(False)
        elif name in ("and", "or", "xone", "not", "node", "some_value") and on_row:
            # On the row's own node the other shapes are tests of the same row.
            inner = [row_test(graph, source, s, depth + 1) for s in (x if isinstance(x, tuple | list) else (x,))]
            if any(i is None for i in inner):
                return None
            number = reduce(lambda a, b: a + b, (i.cast("int") for i in inner))
            test = {"and": number == len(inner), "or": number >= 1, "xone": number == 1, "not": number == 0, "node": number == 1, "some_value": number == 1}[name]
        elif name not in ("unique_lang", *_IGNORED):
            return None
        tests.append(test)
    return reduce(lambda a, b: a & b, tests)


def _known(constraints: dict) -> None:
    unknown = set(constraints) - {*_PER_VALUE, *_BY_GRAPH, *_BY_SET, *_IGNORED}
    if unknown:
        raise UnsupportedShape(", ".join(sorted(unknown)))


def _checked(shape: Shape) -> None:
    """Raises where a node shape has constraints that only properties can have."""
    on_node = set(shape.constraints) - set(_ON_NODES)
    if on_node:
        raise UnsupportedShape("on a node shape: " + ", ".join(sorted(on_node)))


def _target_rows(graph: Graph, shape: Shape) -> tuple[TableMap, Column] | None:
    """The table, and which of its rows are a shape's targets, where they are of one table with a unique key."""
    maps, plain = holders(graph, f"<{t.SH}shape>")
    if maps or plain or len(shape.targets) != 1:
        return None
    kind, x = shape.targets[0]
    if kind == "class":
        maps, plain = holders(graph, t.SUBCLASS)
        typed, others = holders(graph, t.TYPE)
        own = [m for m in typed if m.objects(t.TYPE) and x == f"<{BASE}{m.table}>"]
        if maps or plain or others or len(own) != 1 or not own[0].unique:
            return None
        return own[0], F.lit(True)
    if kind == "subjects_of":
        maps, plain = holders(graph, x)
        if plain or len(maps) != 1 or not maps[0].unique or len(found := maps[0].objects(x)) != 1:
            return None
        return maps[0], found[0][2]
    return None


def _referring(graph: Graph, source: TableMap, p: Property, depth: int) -> tuple[DataFrame, Column] | None:
    """A row for each key of the table that rows of another table refer to, and which keys meet the property, joined to that; None if it takes more.

    Rows that repeat change no flag. Numbers of values above one would have to tell them apart, and aren't decided here.
    """
    c = p.constraints
    if not isinstance(p.path, Path) or len(p.path.steps) != 1 or p.path.steps[0][1]:
        return None
    maps, plain = holders(graph, p.path.steps[0][0])
    found = maps[0].objects(p.path.steps[0][0]) if len(maps) == 1 and not plain and maps[0].unique else []
    if len(found) != 1 or found[0][0] != source.subject or not source.subject.joins or set(c) - {*_PER_VALUE, *_IGNORED, "node", "some_value", "has_value", "min_count"} or c.get("min_count", 0) > 1:
        return None
    other, (_, refs, has) = maps[0], found[0]
    inner = {k: row_test(graph, other, c[k], depth + 1) for k in ("node", "some_value") if k in c}
    if any(x is None for x in inner.values()):
        return None
    cols = other.subject_columns()
    tests = [F.coalesce(_native_test(other.subject, cols, k, x, c), F.lit(False)) for k, x in c.items() if k in _PER_VALUE]
    same = other.subject.equals(cols, c["has_value"]) if "has_value" in c else None
    flags = {"every": F.bool_and(reduce(lambda a, b: a & b, tests, inner.get("node", F.lit(True)))), "some": F.bool_or(inner.get("some_value", F.lit(True))), "has": F.bool_or(same if same is not None else F.lit(False))}
    rows = other.df.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in other.key), has))
    summed = rows.groupBy(*(r.alias(f"k{n}") for n, r in enumerate(refs))).agg(*(x.alias(f"_{n}") for n, x in flags.items()))
    keep = F.coalesce("_every", F.lit(True)) & F.lit(not _unordered(c))
    wanted = [n for n, k in (("_some", "some_value"), ("_has", "has_value")) if k in c] + (["_some"] if c.get("min_count", 0) == 1 and "some_value" not in c else [])
    return summed, reduce(lambda a, b: a & b, (F.coalesce(n, F.lit(False)) for n in wanted), keep)


def _conforming_rows(graph: Graph, shape: Shape, source: TableMap, wanted: Column, depth: int) -> DataFrame | None:
    """(node) of a table's rows that conform, by native keys; None if that takes more than rows and those that refer to them."""
    own = {k: x for k, x in shape.constraints.items() if k != "subset_of"}
    tests, summed = [_row_part(graph, source, (source.subject, source.subject_columns(), F.lit(True)), own, depth, True)], []
    for p in shape.properties:
        value = _row_values(graph, source, p.path)
        test = _row_part(graph, source, value, p.constraints, depth) if value is not None else None
        if test is not None:
            tests.append(test)
        elif (part := _referring(graph, source, p, depth)) is not None:
            summed.append(part)
        else:
            return None
    if any(x is None for x in tests):
        return None
    has = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in source.key))
    keys = source.df.where(has & wanted).where(reduce(lambda a, b: a & b, tests)).select(*(c.alias(f"k{n}") for n, c in enumerate(source.subject_columns()))).distinct()
    names = keys.columns
    for part, keep in summed:
        keys = keys.join(part, names, "left").where(keep).select(*names)
    if "subset_of" in shape.constraints:
        # The one value is the node itself: the path has to lead back to it.
        path = shape.constraints["subset_of"]
        back = bindings(graph, [("?node", path, "?node")]) if path is not None else None
        outer = Bindings(keys.toDF(*names_of("node", source.subject)), {"node": source.subject})
        met = kept(outer, back, "left_semi") if back is not None else outer.nothing()
        return met.terms().select(F.col(column("node")).alias("node")).distinct()
    return keys.select(source.subject.printed([F.col(c) for c in names]).alias("node"))


def conforming(triples: DataFrame | Graph, shape: Shape, focus: DataFrame | None = None, depth: int = 0) -> DataFrame:
    """(node): the focus nodes, else the shape's targets, that conform. Nesting beyond ``MAX_DEPTH`` raises."""
    if depth > MAX_DEPTH:
        raise RecursionError(f"shapes refer to each other more than {MAX_DEPTH} deep at {shape.name}")
    _checked(shape)
    if focus is None and isinstance(triples, Graph) and (rows := _target_rows(triples, shape)):
        source, wanted = rows
        found = _conforming_rows(triples, shape, source, wanted, depth)
        if found is not None:
            return found
    left = (focus if focus is not None else focus_nodes(triples, shape)).select("node").distinct()
    if shape.constraints:
        left = _met(triples, left, left.select("node", F.col("node").alias("value")), shape.constraints, depth)
    for p in shape.properties:
        left = _met(triples, left, path_values(triples, p.path, left), p.constraints, depth)
    return left


def read_predicates(shape: Shape, seen: Sequence[str] = ()) -> set[str]:
    """Predicates that a shape's targets, paths and nested shapes read; a rule that makes one must come first."""
    if shape.name in seen:
        return set()
    inside = (*seen, shape.name)
    found: set[str] = {f"<{t.SH}shape>"}

    def of_path(path: str | Path | None) -> set[str]:
        return {p for p, _ in path.steps} if isinstance(path, Path) else {path} if path else set()

    def of(constraints: dict) -> set[str]:
        out: set[str] = set()
        for k, x in constraints.items():
            if k == "class":
                out |= {t.TYPE, t.SUBCLASS}
            elif k == "root_class":
                out.add(t.SUBCLASS)
            elif k == "subset_of":
                out |= of_path(x)
            elif isinstance(x, Shape):
                out |= read_predicates(x, inside)
            elif isinstance(x, tuple | list):
                for s in x:
                    if isinstance(s, Shape):
                        out |= read_predicates(s, inside)
        return out

    for kind, x in shape.targets:
        if kind == "class":
            found |= {t.TYPE, t.SUBCLASS}
        elif kind in ("subjects_of", "objects_of"):
            found.add(x)
        elif kind == "where":
            found |= read_predicates(x, inside)
    found |= of(shape.constraints)
    for p in shape.properties:
        found |= of_path(p.path) | of(p.constraints)
    return found


def targeted(head: Sequence[tuple], body: Sequence, variable: str, shape: Shape, name: str | None = None):
    """A rule limited to the nodes that conform to a shape; they are found again only where what the shape reads is made."""
    from grafthorn.operators.rules import Rule

    return Rule(head, body, name, (variable, lambda triples: conforming(triples, shape)), frozenset(read_predicates(shape)))


def shape_gates(rules: Sequence, shapes: dict[int, Shape]) -> dict[tuple[int, int], bool]:
    """Closed dependencies of targeted rules (number -> shape) on the rules that make what their shapes read."""
    gates: dict[tuple[int, int], bool] = {}
    for i, shape in shapes.items():
        reads = read_predicates(shape)
        for j, rule in enumerate(rules):
            if any(str(h[1]).startswith("?") or h[1] in reads for h in rule.head):
                gates[i, j] = True
    return gates
