"""Solutions with native columns: scans of table maps, stars in one scan, joins on the columns.

``Bindings`` hold, for each variable, the kind of its terms and the columns that make them. Patterns on one subject over one table whose key is
unique are one scan. Two sides are joined on columns where their kinds agree, give nothing where no term can be of both, and are printed first otherwise.
Where a row of either side may meet many of the other, the rows of one value are dealt over a grid of tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafthorn.functions import terms as t
from grafthorn.functions.values import Native
from grafthorn.sources.graph import BASE, TERM, Graph, Kind, TableMap, never_equal
from grafthorn.sources.numbers import constant, is_numbered


#: Rows and columns of the grid that a value's rows are dealt over in a join of many with many; each side is copied as often.
SPREAD = 8
#: Rows of one side that meet a row of the other one after the other.
_BLOCK = 128


def name_of(variable: str) -> str:
    return variable.lstrip("?")


def names(variable: str, kind: Kind) -> list[str]:
    return [f"v_{variable}"] if kind == TERM else [f"n{k}_{variable}" for k in range(kind.width)]


@dataclass(frozen=True)
class Bindings:
    """A table of solutions; ``kinds`` by variable, in order. Without variables the table has the column ``_hit``.

    ``key``, where known, are variables that determine the others; rows may repeat all the same.
    """

    df: DataFrame
    kinds: dict[str, Kind]
    key: frozenset[str] | None = None

    def columns(self, variable: str) -> list[Column]:
        return [F.col(n) for n in names(variable, self.kinds[variable])]

    def native(self) -> dict[str, Native]:
        return {x: Native(k, self.columns(x)) for x, k in self.kinds.items() if k != TERM}

    def printed(self, *variables: str) -> Bindings:
        """With these variables as printed terms."""
        if all(self.kinds[x] == TERM for x in variables):
            return self
        kinds = {x: TERM if x in variables else k for x, k in self.kinds.items()}
        made = [self.kinds[x].printed(self.columns(x)).alias(f"v_{x}") if x in variables else c for x in self.kinds for c in ([None] if x in variables else self.columns(x))]
        return Bindings(self.df.select(*made), kinds, self.key)

    def id(self, variable: str) -> Column:
        """The number that ends a variable's IRI, from its key where that is one whole number."""
        kind, cols = self.kinds[variable], self.columns(variable)
        return cols[0].cast("bigint") if kind.name == "iri" and kind.key == ("integer",) else t.id_of(kind.printed(cols))

    def distinct(self) -> Bindings:
        if any(not k.joins for k in self.kinds.values()):
            return Bindings(self.terms().distinct(), dict.fromkeys(self.kinds, TERM), self.key)
        return Bindings(self.df.distinct(), self.kinds, self.key)

    def terms(self) -> DataFrame:
        return self.printed(*self.kinds).df

    def only(self, variables: Sequence[str]) -> Bindings:
        kinds = {x: k for x, k in self.kinds.items() if x in variables}
        key = self.key if self.key is not None and self.key <= set(kinds) else None
        return Bindings(self.df.select(*(n for x, k in kinds.items() for n in names(x, k))), kinds, key)

    def nothing(self) -> Bindings:
        return Bindings(self.df.where(F.lit(False)), self.kinds)


def of_terms(df: DataFrame) -> Bindings:
    """Solutions whose columns v_x are printed terms."""
    return Bindings(df, {c[2:]: TERM for c in df.columns if c.startswith("v_")})


def aligned(a: Bindings, b: Bindings) -> tuple[Bindings, Bindings, list[str]] | None:
    """Both with the same columns for what they share, and those; None if nothing can be the same."""
    shared = [x for x in a.kinds if x in b.kinds]
    if any(never_equal(a.kinds[x], b.kinds[x]) for x in shared):
        return None
    differ = [x for x in shared if a.kinds[x] != b.kinds[x] or not a.kinds[x].joins]
    a, b = a.printed(*differ), b.printed(*differ)
    return a, b, [n for x in shared for n in names(x, a.kinds[x])]


def _spread(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """A join in which rows of one value meet in ``SPREAD`` x ``SPREAD`` tasks: a row takes its place on one side of the grid by hash, and all places on the other.

    The left side's rows are joined in blocks, so the result has a right row beside each of a block, and then the next beside the same: runs and short
    repeats, which files hold in little space.
    """
    number = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = F.explode(F.array(*(F.lit(k) for k in range(SPREAD))))
    own = lambda df: F.pmod(F.xxhash64(*df.columns), F.lit(SPREAD)).cast("int")
    keys, rest = [*on, "_row", "_place"], [c for c in left.columns if c not in on]
    a = left.select("*", own(left).alias("_row"), every.alias("_place")).repartition(number, *keys)
    b = right.select("*", own(right).alias("_place"), every.alias("_row")).repartition(number, *keys)
    same = Window.partitionBy(*keys)
    place, n = F.row_number().over(same.orderBy(*rest)) - 1, F.count("*").over(same)
    # Blocks of a multiple of eight rows: what repeats in a file then begins at a whole byte. Fewer than eight rows are left over.
    block = F.when(place < n - n % 8, F.floor(place / _BLOCK)).otherwise(-1)
    blocks = a.withColumn("_block", block).groupBy(*keys, "_block").agg(F.collect_list(F.struct(*rest)).alias("_rows")).hint("merge")
    met = blocks.join(b, keys).select(*on, F.explode("_rows").alias("_left"), *(c for c in right.columns if c not in on))
    return met.select(*on, *(F.col("_left")[c].alias(c) for c in rest), *(c for c in right.columns if c not in on))


def joined(left: Bindings | None, right: Bindings) -> Bindings:
    """Natural join on shared variables; without any, every combination."""
    if left is None:
        return right
    if not right.kinds or not left.kinds:
        kept, test = (left, right) if left.kinds or not right.kinds else (right, left)
        return Bindings(kept.df.join(test.df.select(F.lit(1).alias("_any")).limit(1), F.lit(True), "left_semi"), kept.kinds)
    both = aligned(left, right)
    kinds = left.kinds | {x: k for x, k in right.kinds.items() if x not in left.kinds}
    if both is None:
        return Bindings(left.df.crossJoin(right.only([x for x in right.kinds if x not in left.kinds]).df).where(F.lit(False)), kinds)
    a, b, on = both
    shared, key, many = {x for x in a.kinds if x in b.kinds}, None, False
    if a.key is not None and b.key is not None:
        many = not a.key <= shared and not b.key <= shared
        key = a.key if b.key <= shared else b.key if a.key <= shared else a.key | b.key
    df = a.df.crossJoin(b.df) if not on else _spread(a.df, b.df, on) if many else a.df.join(b.df, on)
    return Bindings(df, a.kinds | {x: k for x, k in b.kinds.items() if x not in a.kinds}, key)


def kept(outer: Bindings, inner: Bindings, how: str) -> Bindings:
    """``left_semi`` or ``left_anti`` join on all that they share."""
    both = aligned(outer, inner)
    if both is None:
        return outer.nothing() if how == "left_semi" else outer
    a, b, on = both
    if not on:
        return Bindings(a.df.join(b.df.select(F.lit(1).alias("_any")).limit(1), F.lit(True), how), a.kinds)
    return Bindings(a.df.join(b.df.select(*on), on, how), a.kinds)


def united(parts: Sequence[Bindings]) -> Bindings:
    """All rows; a variable whose kinds differ is printed."""
    if len(parts) == 1:
        return parts[0]
    differ = [x for x in parts[0].kinds if len({p.kinds[x] for p in parts}) > 1]
    parts = [p.printed(*differ) for p in parts]
    df = parts[0].df
    for p in parts[1:]:
        df = df.unionByName(p.df)
    return Bindings(df, parts[0].kinds)


def _select(df: DataFrame, tests: list[Column | None], places: list[tuple[str, Kind, list[Column]]]) -> Bindings:
    """The rows that meet the tests, with a variable for each place; a variable with two places must have equal terms."""
    kinds: dict[str, tuple[Kind, list[Column]]] = {}
    for x, kind, cols in places:
        if x not in kinds:
            kinds[x] = kind, cols
            continue
        first, own = kinds[x]
        if never_equal(first, kind):
            tests.append(None)
        elif first == kind and kind.joins:
            tests += [a == b for a, b in zip(own, cols, strict=True)]
        else:
            tests.append(first.printed(own) == kind.printed(cols))
    for test in tests:
        df = df.where(F.lit(False) if test is None else test)
    if not kinds:
        return Bindings(df.select(F.lit(1).alias("_hit")).limit(1), {})
    return Bindings(df.select(*(c.alias(n) for x, (kind, cols) in kinds.items() for n, c in zip(names(x, kind), cols, strict=True))), {x: k for x, (k, _) in kinds.items()})


def star(source: TableMap, subject: str, arms: Sequence[tuple[str, str]]) -> list[Bindings]:
    """Solutions of patterns (subject, predicate, object) over one row of a table at a time."""
    key = source.subject_columns()
    has = [F.col(k).isNotNull() for k in source.key]
    out: list[tuple[list, list]] = [([*has], [])]
    if subject.startswith("?"):
        out[0][1].append((name_of(subject), source.subject, key))
    else:
        out[0][0].append(source.subject.equals(key, subject))
    for p, o in arms:
        grown = []
        for tests, places in out:
            for kind, cols, some in source.objects(p):
                more, also = [*tests, some], list(places)
                if o.startswith("?"):
                    also.append((name_of(o), kind, cols))
                elif kind == TERM and p.endswith("#type>"):
                    more.append(F.lit(True) if o == f"<{BASE}{source.table}>" else None)
                else:
                    more.append(kind.equals(cols, o))
                grown.append((more, also))
        out = grown
    made = [_select(source.df, tests, places) for tests, places in out]
    # An object that isn't one column's own is one of several for its subject.
    keyed = source.unique and subject.startswith("?") and len(made) == 1
    return [replace(b, key=frozenset([name_of(subject)])) for b in made] if keyed else made


def plain_scan(df: DataFrame, pattern: tuple) -> Bindings:
    """Solutions of a pattern over printed or numbered triples."""
    term = constant if is_numbered(df) else F.lit
    tests = [F.col(place) == term(x) for place, x in zip("spo", pattern, strict=True) if not x.startswith("?")]
    return _select(df, tests, [(name_of(x), TERM, [F.col(place)]) for place, x in zip("spo", pattern, strict=True) if x.startswith("?")])


def holders(graph: Graph, predicate: str) -> tuple[list[TableMap], list[DataFrame]]:
    """The table maps and the plain tables that may have triples with a predicate."""
    maps = [m for m in graph.maps if predicate in m.predicates()]
    return maps, [df for df, holds in graph.plain if holds is None or predicate in holds]


def pattern_bindings(graph: Graph, pattern: tuple) -> Bindings:
    """Solutions of one pattern."""
    s, p, o = pattern
    if p.startswith("?"):
        return plain_scan(graph.triples(), pattern)
    maps, plain = holders(graph, p)
    parts = [b for m in maps for b in star(m, s, [(p, o)])] + [plain_scan(df, pattern) for df in plain]
    if not parts:
        empty = graph.sparkSession.createDataFrame([], "s string, p string, o string")
        parts = [plain_scan(empty, pattern)]
    out = united(parts)
    return out if out.kinds or len(parts) == 1 else Bindings(out.df.limit(1), {})


def units(graph: Graph, patterns: Sequence[tuple]) -> list[tuple[list[tuple], Bindings]]:
    """Patterns with their solutions; those on one subject over one table with a unique key, and over no other, are one scan."""
    out: list[tuple[list[tuple], Bindings]] = []
    stars: dict[tuple[str, int], list[tuple]] = {}
    for pattern in patterns:
        s, p, o = pattern
        maps, plain = ([], [1]) if p.startswith("?") else holders(graph, p)
        if len(maps) == 1 and not plain and maps[0].unique:
            stars.setdefault((s, graph.maps.index(maps[0])), []).append(pattern)
        else:
            out.append(([pattern], pattern_bindings(graph, pattern)))
    for (s, k), own in stars.items():
        parts = star(graph.maps[k], s, [(p, o) for _, p, o in own])
        out.append((own, united(parts)))
    return out
