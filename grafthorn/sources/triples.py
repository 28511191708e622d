"""Triple tables from relational tables and N-Triples text, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafthorn.functions import terms as t
from grafthorn.sources.graph import BASE, Graph, TableMap, as_graph

def node(table: str, *keys: Column | str) -> Column:
    """<http://ex.org/table/key/...>"""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return t.iri(F.concat_ws("/", F.lit(f"{BASE}{table}"), *(c.cast("string") for c in cols)))


def predicate(name: str) -> str:
    return f"<{BASE}{name}>"


def table_triples(df: DataFrame, table: str, key: Sequence[str], columns: Sequence[str] = (), refs: dict[str, str] | None = None, langs: dict[str, str] | None = None, typed: bool = True, unique: bool = False) -> Graph:
    """A table's rows as a graph of triples: rdf:type, a literal per column, an IRI per reference (column -> table).

    A null value, or a null in the key, has no triple. ``unique`` says that rows with the same key have the same values, which isn't
    checked: then patterns on one subject are read in one scan.
    """
    return Graph([TableMap(df, table, tuple(key), tuple(columns), tuple((refs or {}).items()), tuple((langs or {}).items()), typed, unique)])


def union(*graphs: DataFrame | Graph) -> DataFrame | Graph:
    """All triples of graphs, or of plain tables."""
    if any(isinstance(g, Graph) for g in graphs):
        parts = [as_graph(g) for g in graphs]
        return Graph([m for g in parts for m in g.maps], [x for g in parts for x in g.plain])
    out = graphs[0]
    for more in graphs[1:]:
        out = out.unionByName(more)
    return out


_LINE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+?|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'
_ESCAPES = (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'), ("\\\\", "\\"))


def _unescaped(text: Column) -> Column:
    """With characters for \\uXXXX and \\UXXXXXXXX."""
    code = r"^\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8}))"

    def char(piece: Column) -> Column:
        short, long = F.regexp_extract(piece, code, 1), F.regexp_extract(piece, code, 2)
        full = F.when(short != "", F.concat(F.lit("0000"), short)).otherwise(long)
        size = F.when(short != "", 6).otherwise(10)
        return F.when(full == "", piece).otherwise(F.concat(F.decode(F.unhex(full), "UTF-32"), piece.substr(size + 1, F.length(piece))))

    return F.when(text.rlike(r"\\[uU]"), F.array_join(F.transform(F.split(text, r"(?=\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}))"), char), "")).otherwise(text)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples files as a triple table; blank and comment lines are skipped, a malformed line fails the read."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    s, p, o = (F.regexp_extract("value", _LINE, n) for n in (1, 2, 3))
    plain = F.regexp_replace(o, f'\\^\\^<{t.XSD}string>$', "")
    # A doubled backslash is set aside first, so that what follows it isn't read as an escape.
    aside = F.replace(plain, F.lit("\\\\"), F.lit("\u0000"))
    for escape, char in _ESCAPES[:-1]:
        aside = F.replace(aside, F.lit(escape), F.lit(char))
    value = F.when(o.startswith('"'), F.replace(_unescaped(aside), F.lit("\u0000"), F.lit("\\"))).otherwise(_unescaped(o))
    bad = F.raise_error(F.concat(F.lit("not an N-Triples line: "), F.substring("value", 1, 200)))
    return lines.select(F.when(s == "", bad.cast("string")).otherwise(_unescaped(s)).alias("s"), _unescaped(p).alias("p"), value.alias("o"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    """One line a triple; triples with a literal subject or predicate can't be written and are left out."""

    def escaped(term: Column) -> Column:
        body = F.regexp_extract(term, r'(?s)^"(.*)"', 1)
        tail = F.substring(term, F.length(body) + 3, F.length(term))
        for escape, char in reversed(_ESCAPES):
            body = F.replace(body, F.lit(char), F.lit(escape))
        return F.when(term.startswith('"'), F.concat(F.lit('"'), body, F.lit('"'), tail)).otherwise(term)

    fit = triples.where(~F.col("s").startswith('"') & F.col("p").startswith("<"))
    fit.select(F.concat_ws(" ", "s", "p", escaped(F.col("o")), F.lit(".")).alias("value")).write.text(path)


def list_members(triples: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, position, member) of the RDF lists that begin at ``heads`` (head), by links that double in length each pass.

    A list that turns back on itself ends there; a broken one gives its first part, to its last cell with a member. A list
    of n members takes about log2(n) passes. Of a cell that is met on several ways the nearest counts.
    """
    from grafthorn.sources.shared import written

    firsts = triples.where(F.col("p") == t.FIRST).select(F.col("s").alias("cell"), F.col("o").alias("member"))
    cells = firsts.select("cell").distinct()
    rests = triples.where((F.col("p") == t.REST) & (F.col("o") != t.NIL)).select(F.col("s").alias("cell"), F.col("o").alias("next"))
    links = written(rests.join(cells, "cell", "left_semi").join(cells.withColumnRenamed("cell", "next"), "next", "left_semi").select("cell", "next").distinct())
    reached = written(heads.select("head", F.col("head").alias("cell")).distinct().join(cells, "cell", "left_semi").select("head", "cell", F.lit(0).cast("long").alias("position")))
    number, step = reached.count(), 1
    while number:
        further = reached.join(links, "cell").select("head", F.col("next").alias("cell"), (F.col("position") + step).alias("position"))
        reached = written(reached.unionByName(further).groupBy("head", "cell").agg(F.min("position").alias("position")))
        before, number = number, reached.count()
        if number == before:
            break
        ahead = links.select(F.col("cell").alias("next"), F.col("next").alias("after"))
        links, step = written(links.join(ahead, "next").select("cell", F.col("after").alias("next")).distinct()), 2 * step
    return reached.join(firsts, "cell").select("head", F.col("position").cast("int").alias("position"), "member")


def display(term: Column, prefixes: dict[str, str]) -> Column:
    """Prefixed names for IRIs (the first matching namespace), bare numbers and booleans, other terms as they are."""
    bare = F.when(t.is_literal(term) & t.datatype(term).isin(*(t.XSD + n for n in ("integer", "decimal", "double", "boolean"))), t.lex(term))
    for prefix, space in prefixes.items():
        rest = term.substr(F.lit(len(space) + 2), F.length(term) - len(space) - 2)
        bare = bare.when(term.startswith(f"<{space}"), F.concat(F.lit(f"{prefix}:"), rest))
    return bare.otherwise(term)


def search(inferred: DataFrame, text: str) -> DataFrame:
    """Rows with the text in a term or the rule's name, whatever the case."""
    hit = F.lit(False)
    for c in ("s", "p", "o", "rule_name"):
        hit = hit | F.contains(F.lower(c), F.lit(text.lower()))
    return inferred.where(hit)
