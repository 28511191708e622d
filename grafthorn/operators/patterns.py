"""Graph patterns over a triple table (s, p, o), as joins.

A pattern is (subject, predicate, object) of terms and variables such as ``?x``; a predicate may be a path built
from ``seq`` and ``inv``, which is rewritten to plain patterns with hidden variables. Solutions are rows
with a column ``v_x`` for each variable. Bodies also hold ``Filter``, ``Set`` and ``Not`` elements, read in order.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafthorn.functions.values import Value, native_columns
from grafthorn.operators.bindings import Bindings, joined, kept, name_of, names, of_terms, pattern_bindings, units
from grafthorn.sources.graph import TERM, Graph, as_graph
from grafthorn.sources.numbers import constant

Pattern = tuple


@dataclass(frozen=True)
class Path:
    """A sequence of steps; a step is (predicate, forward)."""

    steps: tuple[tuple[str, bool], ...]


@dataclass(frozen=True)
class Filter:
    """Keeps solutions where the value is true."""

    test: Callable[[], Value]
    reads: tuple[str, ...] = ()


@dataclass(frozen=True)
class Set:
    """Binds a variable to a value; a solution whose value is null is dropped."""

    name: str
    value: Callable[[], Value]
    reads: tuple[str, ...] = ()


@dataclass(frozen=True)
class Not:
    """Keeps solutions for which the inner elements have none."""

    body: tuple

    def __init__(self, *body):
        object.__setattr__(self, "body", tuple(body))


def _path(x: str | Path) -> Path:
    return x if isinstance(x, Path) else Path(((x, True),))


def seq(*parts: str | Path) -> Path:
    """One step after the other."""
    return Path(tuple(s for part in parts for s in _path(part).steps))


def inv(part: str | Path) -> Path:
    """The path walked backwards: steps in reverse order, each turned round."""
    return Path(tuple((p, not forward) for p, forward in reversed(_path(part).steps)))


def is_variable(x) -> bool:
    return isinstance(x, str) and x.startswith("?")


def column(name: str) -> str:
    return f"v_{name.lstrip('?')}"


def variables(body: Iterable) -> list[str]:
    """Variables that a body's patterns and SETs bind, in order."""
    found = [x for e in body for x in ((e.name,) if isinstance(e, Set) else e if isinstance(e, tuple) else ()) if is_variable(x)]
    return list(dict.fromkeys(found))


def expanded(pattern: Pattern) -> list[Pattern]:
    """A pattern with its path as plain patterns."""
    s, p, o = pattern
    if not isinstance(p, Path):
        return [pattern]
    # The same in every process, and different for different patterns.
    key = hashlib.sha256(repr((s, p.steps, o)).encode()).hexdigest()[:32]
    ends = [s, *(f"?_h{key}_{n}" for n in range(len(p.steps) - 1)), o]
    return [(a, q, b) if forward else (b, q, a) for (q, forward), a, b in zip(p.steps, ends, ends[1:], strict=False)]


def scan(triples: DataFrame | Graph, pattern: Pattern) -> DataFrame:
    """Solutions of one plain pattern; a variable that occurs twice must have equal terms."""
    return pattern_bindings(as_graph(triples), pattern).terms()


def ordered(parts: Sequence[tuple[Sequence[Pattern], Bindings]], bound: set[str]) -> list[Bindings]:
    """Solutions of patterns with those that have most constants first, each connected to what is bound where possible."""
    left, out, bound = list(parts), [], set(bound)
    while left:
        linked = [p for p in left if not bound or bound & set(p[1].kinds)] or left
        best = max(linked, key=lambda p: (max(sum(not is_variable(x) for x in q) for q in p[0]), len(p[0]), -left.index(p)))
        left.remove(best)
        out.append(best[1])
        bound |= set(best[1].kinds)
    return out


def solutions(triples: DataFrame | Graph, body: Sequence, seed: DataFrame | None = None, sources: dict[int, DataFrame] | None = None, wanted: Sequence[str] | None = None) -> DataFrame:
    """Solutions of a body, a bag of rows.

    ``seed`` gives solutions to start from. ``sources`` replaces the triples of the n-th
    pattern (after path expansion), as the delta passes of a fixpoint do. With ``wanted``, variables such as a
    head's, parts of the body that share no variable with those that bind them only have to have a solution.
    """
    return bindings(as_graph(triples), body, of_terms(seed) if seed is not None else None, sources, wanted).terms()


def distinct_bindings(triples: DataFrame | Graph, body: Sequence[Pattern]) -> Bindings:
    """The different solutions of patterns. Where keys are known, equal rows are combined before the joins, and what is joined then has none."""
    graph, seen = as_graph(triples), variables(body)
    found = units(graph, [p for e in body for p in expanded(e)])
    if any(b.key is None for _, b in found):
        return bindings(graph, body).distinct()
    out = None
    for part in ordered([(p, b.distinct()) for p, b in found], set()):
        out = joined(out, part)
    shown = out.only([name_of(x) for x in seen])
    return shown if shown.key is not None else shown.distinct()


def _unit(graph: Graph) -> Bindings:
    """One solution that binds nothing."""
    return Bindings(graph.sparkSession.range(1).select(F.lit(1).alias("_hit")), {})


def components(body: Sequence, together: Sequence[str] = ()) -> list[tuple[list[int], set[str]]]:
    """Places of the elements that hang together by their variables, with those; ``together`` counts as one element."""
    out: list[tuple[list[int], set[str]]] = [([], set(together))] if together else []
    for k, e in enumerate(body):
        own = set(reads([e]))
        near = [c for c in out if c[1] & own]
        out = [c for c in out if not c[1] & own] + [(sorted([k, *(x for c in near for x in c[0])]), own.union(*(c[1] for c in near)))]
    return out


def bindings(graph: Graph, body: Sequence, seed: Bindings | None = None, sources: dict[int, DataFrame] | None = None, wanted: Sequence[str] | None = None) -> Bindings:
    """``solutions`` with native columns: terms are printed where a SET or a join of different kinds needs them."""
    number = itertools.count()
    parts = [[(p, (sources or {}).get(next(number))) for p in expanded(e)] if isinstance(e, tuple) else e for e in body]
    if wanted is None:
        return _evaluated(graph, parts, seed)
    out, tests = None, []
    for places, found in components(body, [f"?{x}" for x in seed.kinds] if seed is not None else ()):
        own = _evaluated(graph, [parts[k] for k in places], seed if seed is not None and found & {f"?{x}" for x in seed.kinds} else None)
        if found & set(wanted):
            out = joined(out, own)
        else:
            tests.append(own)
    for test in tests:
        out = joined(out if out is not None else _unit(graph), Bindings(test.df, {}))
    return out if out is not None else _unit(graph)


def _evaluated(graph: Graph, parts: Sequence, out: Bindings | None) -> Bindings:
    """Solutions of elements in order; patterns come with the triples to read in place of the graph's."""
    pending: list[tuple[Pattern, DataFrame | None]] = []
    waiting: list[Filter] = []

    def flush() -> None:
        nonlocal out
        found = units(graph, [p for p, own in pending if own is None])
        found += [([p], pattern_bindings(as_graph(own), p)) for p, own in pending if own is not None]
        for part in ordered(found, set(out.kinds) if out is not None else set()):
            out = joined(out, part)
        pending.clear()
        out = _unit(graph) if out is None else out
        for test in waiting:
            with native_columns(out.native()):
                out = Bindings(out.df.where(test.test().truth()), out.kinds, out.key)
        waiting.clear()

    for e in parts:
        if isinstance(e, list):
            pending += e
            continue
        if isinstance(e, Filter):
            # A filter of what is bound already may wait for the patterns after it, which then are read with those before it.
            bound = {x for p, _ in pending for x in p if is_variable(x)} | {f"?{x}" for x in (out.kinds if out is not None else ())}
            waiting.append(e)
            if not e.reads or not set(e.reads) <= bound:
                flush()
            continue
        flush()
        if isinstance(e, Set):
            x = name_of(e.name)
            with native_columns(out.native()):
                value = e.value().term()
            rest = [n for y, k in out.kinds.items() if y != x for n in names(y, k)]
            made = out.df.withColumn(column(e.name), value).where(F.col(column(e.name)).isNotNull())
            out = Bindings(made.select(*rest, column(e.name)), {y: k for y, k in out.kinds.items() if y != x} | {x: TERM})
        else:
            out = negated(graph, out, e)
    flush()
    return out.only([x for x in out.kinds if not x.startswith("_h")]) if out.kinds else out


def reads(body: Sequence) -> list[str]:
    """Variables that the elements of a body mention."""
    found = [x for e in body for x in (reads(e.body) if isinstance(e, Not) else [y for p in expanded(e) for y in p if is_variable(y)] if isinstance(e, tuple) else [*e.reads, *([e.name] if isinstance(e, Set) else [])])]
    return list(dict.fromkeys(found))


def negated(graph: Graph, outer: Bindings, negation: Not) -> Bindings:
    """Anti join with the inner solutions on the outer variables that occur inside, filters included."""
    inner = negation.body
    if not inner:
        return outer.nothing()
    shared = [x for x in outer.kinds if f"?{x}" in reads(inner)]
    extreme = _by_extreme(graph, outer, inner, shared)
    if extreme is not None:
        return extreme
    if all(isinstance(e, tuple) for e in inner) or not shared:
        found = bindings(graph, inner)
    else:
        seed = outer.only(shared)
        found = bindings(graph, inner, Bindings(seed.df.distinct(), seed.kinds))
    return kept(outer, found.only([x for x in shared if x in found.kinds]) if shared else Bindings(found.df, {}), "left_anti")


def _by_extreme(graph: Graph, outer: Bindings, inner: Sequence, shared: Sequence[str]) -> Bindings | None:
    """A NOT of patterns and one comparison of an inner number with an outer one: the largest or smallest number of each key decides.

    Then no outer solution meets all inner ones of its key. None where the body isn't of that form.
    """
    patterns, tests = [e for e in inner if isinstance(e, tuple)], [e for e in inner if not isinstance(e, tuple)]
    if not patterns or len(tests) != 1 or not isinstance(tests[0], Filter) or inner[-1] is not tests[0]:
        return None
    found = bindings(graph, patterns)
    with native_columns(outer.native() | found.native()):
        compared = tests[0].test().compared
    if not compared:
        return None
    op, x, y = compared
    flip = {"gt": "lt", "lt": "gt", "ge": "le", "le": "ge"}
    if x not in found.kinds and y in found.kinds:
        op, x, y = flip[op], y, x
    keys = [k for k in shared if k in found.kinds]
    if x not in found.kinds or x in outer.kinds or y in found.kinds or y not in outer.kinds or any(outer.kinds[k] != found.kinds[k] or not outer.kinds[k].joins for k in keys):
        return None
    most = (F.max if op in ("gt", "ge") else F.min)(found.columns(x)[0]).alias("_extreme")
    on = [n for k in keys for n in names(k, found.kinds[k])]
    extremes = found.df.groupBy(*on).agg(most)
    both = outer.df.join(extremes, on, "left") if on else outer.df.crossJoin(extremes)
    a, b = F.col("_extreme"), outer.columns(y)[0]
    hit = {"gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b}[op]
    return Bindings(both.where(a.isNull() | ~hit), outer.kinds).only(list(outer.kinds))


def without(triples: DataFrame | Graph, outer: DataFrame, negation: Not) -> DataFrame:
    """The outer solutions for which the inner elements have none."""
    return negated(as_graph(triples), of_terms(outer), negation).terms()


def has_match(triples: DataFrame | Graph, body: Sequence, seed: DataFrame) -> DataFrame:
    """The seed's rows for which the body has a solution."""
    found = bindings(as_graph(triples), body)
    return kept(of_terms(seed), found, "left_semi").terms()


def instances(found: DataFrame, head: Sequence[Pattern], numbered: bool = False) -> DataFrame:
    """A triple for each solution and head pattern, in one pass; those with an unbound variable are left out.

    ``numbered`` solutions make numbered triples.
    """

    def part(x: str) -> Column:
        if not is_variable(x):
            return constant(x) if numbered else F.lit(x)
        return F.col(column(x)) if column(x) in found.columns else F.lit(None).cast("long" if numbered else "string")

    rows = [F.struct(part(s).alias("s"), part(p).alias("p"), part(o).alias("o")) for s, p, o in head if not isinstance(p, Path)]
    if len(rows) == 1:
        triples = found.select(rows[0].alias("t"))
    else:
        triples = found.select(F.explode(F.array(*rows)).alias("t"))
    return triples.select("t.s", "t.p", "t.o").where("s is not null and p is not null and o is not null")
