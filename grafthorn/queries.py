"""Registered queries of the triple engine and the SQL that checks each of them.

Each maps the tables that it needs to triples, applies one or a few operators, and decodes the result to native columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafthorn.functions import terms as t
from grafthorn.functions import values as v
from grafthorn.functions.values import Value, const, var
from grafthorn.operators import shapes as sh
from grafthorn.operators.patterns import Filter, Not, Set, bindings, distinct_bindings, has_match, instances, inv, scan, seq, solutions, without
from grafthorn.operators.rules import Rule, data, infer, inverse, output_graph, run, symmetric, transitive
from grafthorn.operators.shapes import Property, Shape
from grafthorn.plans.demand import infer_wanted
from grafthorn.sources.graph import Graph
from grafthorn.sources.triples import BASE, display, list_members, node, predicate, search, table_triples, union

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
P = predicate
#: Instant that NOW() stands for in the registered queries.
INSTANT = "2026-01-01T00:00:00.000Z"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _customers(spark: SparkSession, d: str, typed: bool = True) -> DataFrame:
    return table_triples(_read(spark, d, "customer"), "customer", ["c_custkey"], ["c_name", "c_acctbal", "c_mktsegment"], {"c_nationkey": "nation"}, typed=typed, unique=True)


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table_triples(_read(spark, d, "supplier"), "supplier", ["s_suppkey"], ["s_name", "s_acctbal"], {"s_nationkey": "nation"}, unique=True)


def _places(spark: SparkSession, d: str) -> DataFrame:
    return union(
        table_triples(_read(spark, d, "nation"), "nation", ["n_nationkey"], ["n_name"], {"n_regionkey": "region"}, unique=True),
        table_triples(_read(spark, d, "region"), "region", ["r_regionkey"], ["r_name"], unique=True),
    )


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table_triples(_read(spark, d, "orders"), "orders", ["o_orderkey"], ["o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], {"o_custkey": "customer"}, unique=True)


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table_triples(_read(spark, d, "part"), "part", ["p_partkey"], ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"], unique=True)


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """next edges between the turns of each conversation, and each turn's role."""
    turns = _read(spark, d, "conversations")
    subject = node("turn", "conv_id", "turn")
    following = turns.select(F.col("conv_id").alias("c2"), (F.col("turn") - 1).alias("t2"))
    edges = turns.join(following, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2")))
    return union(
        edges.select(subject.alias("s"), F.lit(P("next")).alias("p"), node("turn", "conv_id", F.col("turn") + 1).alias("o")),
        turns.select(subject.alias("s"), F.lit(P("role")).alias("p"), t.literal(F.col("role")).alias("o")),
    )


def _documents(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").withColumn("line", F.col("text"))
    return table_triples(docs, "documents", ["doc_id"], ["line", "source", "n_chars"], langs={"line": "lang"}, unique=True)


def _id(c: str | Column) -> Column:
    return t.id_of(F.col(c) if isinstance(c, str) else c)


def _text(c: str) -> Column:
    return t.lex(F.col(c))


def _num(c: str) -> Column:
    return t.lex(F.col(c)).try_cast("double")


# Scans, patterns, heads


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def scan_by_pattern(spark, d):
    return scan(_customers(spark, d), ("?c", P("c_mktsegment"), '"BUILDING"')).select(_id("v_c").alias("c_custkey"))


@query("SELECT n_nationkey AS id, 'nation' AS kind FROM nation UNION ALL SELECT r_regionkey, 'region' FROM region")
def scan_nodes(spark, d):
    found = sh.nodes(_places(spark, d)).where(t.is_iri(F.col("node")) & F.col("node").rlike(r"/\d+>$"))
    return found.select(_id("node").cast("int").alias("id"), F.regexp_extract("node", r"org/(\w+)/", 1).alias("kind"))


@query("SELECT 'c_' || column_name AS predicate, n FROM (SELECT count(c_name) AS name, count(c_acctbal) AS acctbal, count(c_mktsegment) AS mktsegment, count(c_nationkey) AS nationkey FROM customer) UNPIVOT (n FOR column_name IN (name, acctbal, mktsegment, nationkey))")
def scan_variable_predicate(spark, d):
    found = scan(_customers(spark, d, typed=False), ("?s", "?p", "?o"))
    return found.groupBy(F.regexp_extract("v_p", r"org/(\w+)>", 1).alias("predicate")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_linenumber AS n FROM lineitem WHERE l_linenumber = CAST(l_quantity AS INT)")
def repeated_variable(spark, d):
    lines = _read(spark, d, "lineitem").select(node("n", "l_linenumber").alias("s"), F.lit(P("linked")).alias("p"), node("n", F.col("l_quantity").cast("int")).alias("o"))
    return scan(lines, ("?x", P("linked"), "?x")).distinct().select(_id("v_x").cast("int").alias("n"))


@query("SELECT c_custkey, n_regionkey AS r_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def bgp_two_hop(spark, d):
    graph = union(_customers(spark, d), _places(spark, d))
    made = infer(graph, [Rule([("?c", P("in_region"), "?r")], [("?c", P("c_nationkey"), "?n"), ("?n", P("n_regionkey"), "?r")])])
    return made.select(_id("s").alias("c_custkey"), _id("o").cast("int").alias("r_regionkey"))


@query("SELECT o_orderkey, c_custkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def bgp_star_chain(spark, d):
    graph = union(_orders(spark, d), _customers(spark, d), _places(spark, d))
    found = solutions(graph, [("?o", P("o_custkey"), "?c"), ("?c", P("c_nationkey"), "?n"), ("?n", P("n_name"), "?name"), ("?n", P("n_regionkey"), "?r"), ("?r", P("r_name"), "?region")])
    return found.select(_id("v_o").alias("o_orderkey"), _id("v_c").alias("c_custkey"), _text("v_name").alias("n_name"), _text("v_region").alias("r_name"))


@query("SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation")
def unconnected_patterns(spark, d):
    found = solutions(_places(spark, d), [("?r", P("r_name"), "?a"), ("?n", P("n_name"), "?b")])
    return found.select(_id("v_r").cast("int").alias("r_regionkey"), _id("v_n").cast("int").alias("n_nationkey"))


@query("SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_acctbal < b.s_acctbal")
def theta_join(spark, d):
    body = [("?x", P("s_nationkey"), "?n"), ("?y", P("s_nationkey"), "?n"), ("?x", P("s_acctbal"), "?a"), ("?y", P("s_acctbal"), "?b"), Filter(lambda: v.lt(var("a"), var("b")), ("?a", "?b"))]
    found = bindings(_suppliers(spark, d), body)
    return found.df.select(found.id("x").alias("x"), found.id("y").alias("y"))


@query("SELECT c_custkey AS id, 'customer' AS kind, c_nationkey AS nation FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_nationkey FROM supplier")
def head_instances(spark, d):
    graph = union(_customers(spark, d), _suppliers(spark, d))
    a = instances(solutions(graph, [("?x", P("c_nationkey"), "?n")]), [("?x", P("located"), "?n"), ("?x", P("unbound"), "?none")])
    b = instances(solutions(graph, [("?x", P("s_nationkey"), "?n")]), [("?x", P("located"), "?n")])
    return union(a, b).select(_id("s").alias("id"), F.regexp_extract("s", r"org/(\w+)/", 1).alias("kind"), _id("o").cast("int").alias("nation"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def has_match_semi_join(spark, d):
    graph = union(_customers(spark, d), _orders(spark, d))
    seed = scan(graph, ("?c", P("c_mktsegment"), "?m")).select("v_c")
    return has_match(graph, [("?o", P("o_custkey"), "?c")], seed).select(_id("v_c").alias("c_custkey"))


# Filters and assignments


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 5000 AND c_acctbal < 7500.5")
def filter_numeric(spark, d):
    test = lambda: v.and_(v.ge(var("b"), 5000), v.lt(var("b"), 7500.5))
    return solutions(_customers(spark, d), [("?c", P("c_acctbal"), "?b"), Filter(test, ("?b",))]).select(_id("v_c").alias("c_custkey"), _num("v_b").alias("c_acctbal"))


@query("SELECT p_partkey FROM part WHERE contains(p_name, 'a') AND NOT starts_with(p_brand, 'Brand#1') OR ends_with(p_type, 'X')")
def filter_string(spark, d):
    test = lambda: v.or_(v.and_(v.contains(var("n"), "a"), v.not_(v.strstarts(var("b"), "Brand#1"))), v.strends(var("k"), "X"))
    body = [("?p", P("p_name"), "?n"), ("?p", P("p_brand"), "?b"), ("?p", P("p_type"), "?k"), Filter(test, ("?n", "?b", "?k"))]
    return solutions(_parts(spark, d), body).select(_id("v_p").alias("p_partkey"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9) AND p_brand <> 'Brand#11'")
def filter_in_list(spark, d):
    body = [("?p", P("p_size"), "?s"), ("?p", P("p_brand"), "?b"), Filter(lambda: v.and_(v.in_(var("s"), 1, 5, 9), v.not_in(var("b"), '"Brand#11"')), ("?s", "?b"))]
    return solutions(_parts(spark, d), body).select(_id("v_p").alias("p_partkey"), _num("v_s").cast("int").alias("p_size"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def filter_dates(spark, d):
    at = lambda x: f'"{x}T00:00:00Z"^^<{t.XSD}dateTime>'
    test = lambda: v.and_(v.ge(var("w"), at("1996-06-01")), v.lt(var("w"), at("1997-01-01")))
    return solutions(_orders(spark, d), [("?o", P("o_orderdate"), "?w"), Filter(test, ("?w",))]).select(_id("v_o").alias("o_orderkey"))


@query("SELECT n_nationkey, true AS literal_is_true, n_nationkey <> 0 AS sum_is_true, n_name <> '' AS text_is_true, false AS null_is_true, true AS iri_is_true FROM nation")
def effective_truth(spark, d):
    n = solutions(_places(spark, d), [("?n", P("n_name"), "?x")])
    key = _id("v_n").cast("double")
    zero = const(f'"0"^^<{t.XSD}integer>')
    missing = Value(v.TERM, F.lit(None).cast("string"))
    return n.select(_id("v_n").cast("int").alias("n_nationkey"), zero.truth().alias("literal_is_true"), Value(v.NUM, key).truth().alias("sum_is_true"), var("x").truth().alias("text_is_true"), missing.truth().alias("null_is_true"), var("n").truth().alias("iri_is_true"))


@query("SELECT p_partkey, p_size * 2 + 1 - p_size / 4.0 AS amount, -p_retailprice AS minus FROM part WHERE p_size <> 3")
def set_arithmetic(spark, d):
    amount = lambda: v.sub(v.add(v.mul(var("s"), 2), 1), v.div(var("s"), 4))
    body = [("?p", P("p_size"), "?s"), ("?p", P("p_retailprice"), "?r"), Set("?a", amount, ("?s",)), Set("?m", lambda: v.minus(var("r")), ("?r",)), Set("?gone", lambda: v.div(1, v.sub(var("s"), 3)), ("?s",))]
    return solutions(_parts(spark, d), body).select(_id("v_p").alias("p_partkey"), _num("v_a").alias("amount"), _num("v_m").alias("minus"))


@query("SELECT p_partkey, p_brand || ' / ' || p_type AS label FROM part")
def set_concat(spark, d):
    rule = Rule([("?p", P("label"), "?l")], [("?p", P("p_brand"), "?b"), ("?p", P("p_type"), "?k"), Set("?l", lambda: v.concat(var("b"), " / ", var("k")), ("?b", "?k"))])
    return infer(_parts(spark, d), [rule]).select(_id("s").alias("p_partkey"), _text("o").alias("label"))


# Negation


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def not_exists(spark, d):
    graph = union(_customers(spark, d), _orders(spark, d))
    return solutions(graph, [("?c", P("c_mktsegment"), "?m"), Not(("?o", P("o_custkey"), "?c"), ("?o", P("o_orderstatus"), '"F"'))]).select(_id("v_c").alias("c_custkey"))


@query("SELECT s_suppkey FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND b.s_acctbal > a.s_acctbal)")
def not_with_filter(spark, d):
    inner = Not(("?y", P("s_nationkey"), "?n"), ("?y", P("s_acctbal"), "?b"), Filter(lambda: v.gt(var("b"), var("a")), ("?a", "?b")))
    return solutions(_suppliers(spark, d), [("?x", P("s_nationkey"), "?n"), ("?x", P("s_acctbal"), "?a"), inner]).select(_id("v_x").alias("s_suppkey"))


@query("SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_name = 'ATLANTIS')")
def not_uncorrelated(spark, d):
    return solutions(_places(spark, d), [("?n", P("n_name"), "?x"), Not(("?r", P("r_name"), '"ATLANTIS"'))]).select(_id("v_n").cast("int").alias("n_nationkey"))


@query("SELECT n_nationkey FROM nation WHERE false")
def not_empty_body(spark, d):
    graph = _places(spark, d)
    return without(graph, solutions(graph, [("?n", P("n_name"), "?x")]), Not()).select(_id("v_n").cast("int").alias("n_nationkey"))


# Paths


@query("SELECT o_orderkey, n_regionkey AS r_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def path_sequence(spark, d):
    graph = union(_orders(spark, d), _customers(spark, d), _places(spark, d))
    return solutions(graph, [("?o", seq(P("o_custkey"), P("c_nationkey"), P("n_regionkey")), "?r")]).select(_id("v_o").alias("o_orderkey"), _id("v_r").cast("int").alias("r_regionkey"))


@query("SELECT n_nationkey, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey")
def path_inverse(spark, d):
    return solutions(union(_customers(spark, d), _places(spark, d)), [("?n", inv(P("c_nationkey")), "?c")]).select(_id("v_n").cast("int").alias("n_nationkey"), _id("v_c").alias("c_custkey"))


@query("SELECT DISTINCT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def path_mixed(spark, d):
    graph = union(_customers(spark, d), _suppliers(spark, d))
    found = distinct_bindings(graph, [("?s", seq(P("s_nationkey"), inv(P("c_nationkey"))), "?c")])
    return found.df.select(found.id("s").alias("s_suppkey"), found.id("c").alias("c_custkey"))


# Declarations, strata, fixed points


@query("SELECT a.conv_id, a.turn AS x, b.turn AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn + 1")
def transitive_closure(spark, d):
    made = infer(_turns(spark, d), transitive(P("next")))
    part = lambda c, n: F.regexp_extract(c, r"turn/(\d+)/(\d+)>", n).cast("bigint")
    return made.select(part("s", 1).alias("conv_id"), part("s", 2).alias("x"), part("o", 2).alias("y"))


@query("SELECT DISTINCT n_regionkey AS a, n_nationkey AS b FROM nation")
def symmetric_property(spark, d):
    made = infer(_places(spark, d), symmetric(P("n_regionkey")))
    return made.select(_id("s").cast("int").alias("a"), _id("o").cast("int").alias("b"))


@query("SELECT c_custkey AS customer, o_orderkey AS placed FROM orders JOIN customer ON o_custkey = c_custkey")
def inverse_property(spark, d):
    made = infer(_orders(spark, d), inverse(P("o_custkey"), P("placed"))).where(F.col("p") == P("placed"))
    return made.select(_id("s").alias("customer"), _id("o").alias("placed"))


@query("SELECT 'r9' AS s, 'NOWHERE' AS o, 'DATA block' AS rule_name, 0 AS iteration")
def data_block(spark, d):
    graph = _places(spark, d)
    facts = data(spark, [(f"<{BASE}r9>", P("r_name"), '"NOWHERE"'), (f"<{BASE}region/0>", t.TYPE, f"<{BASE}region>")])
    made = infer(graph, [], facts)
    return made.select(F.regexp_extract("s", r"org/(\w+)>", 1).alias("s"), _text("o").alias("o"), "rule_name", "iteration")


def flagship(spark, d):
    """Customers with a large order, then customers without one, by region: two strata over four tables."""
    graph = union(_orders(spark, d), _customers(spark, d), _places(spark, d))
    rules = [
        Rule([("?c", P("big_in"), "?r")], [("?o", P("o_totalprice"), "?t"), Filter(lambda: v.gt(var("t"), 200000), ("?t",)), ("?o", P("o_custkey"), "?c"), ("?c", seq(P("c_nationkey"), P("n_regionkey")), "?r")], "big"),
        Rule([("?c", P("small_in"), "?r")], [("?c", seq(P("c_nationkey"), P("n_regionkey")), "?r"), Not(("?c", P("big_in"), "?r"))], "small"),
    ]
    made = infer(graph, rules)
    return made.groupBy(_id("o").cast("int").alias("r_regionkey"), "rule_name").agg(F.count("*").alias("customers"))


QUERIES["two_strata"] = flagship
ORACLES["two_strata"] = """
WITH big AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_totalprice > 200000),
     located AS (SELECT c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT n_regionkey AS r_regionkey, CASE WHEN c IS NULL THEN 'small' ELSE 'big' END AS rule_name, count(*) AS customers
FROM located LEFT JOIN big ON c = c_custkey GROUP BY 1, 2"""


@query("SELECT r_regionkey, upper(r_name) || '!' AS shout, 1 AS iteration FROM region")
def run_once_rule(spark, d):
    rule = Rule([("?r", P("shout"), "?x")], [("?r", P("r_name"), "?n"), Set("?x", lambda: v.concat(v.ucase(var("n")), "!"), ("?n",))])
    return infer(_places(spark, d), [rule]).select(_id("s").cast("int").alias("r_regionkey"), _text("o").alias("shout"), "iteration")


@query("SELECT p_partkey, c AS class FROM part, (VALUES ('Thing'), ('Good')) v(c) UNION ALL SELECT p_partkey, p_type FROM part")
def rdfs_types(spark, d):
    """Types by a class hierarchy: p_type < Good < Thing, by the two recursive schema rules."""
    parts = _read(spark, d, "part")
    cls = lambda c: t.iri(F.concat(F.lit(f"{BASE}class/"), c))
    good, thing = f"<{BASE}class/Good>", f"<{BASE}class/Thing>"
    graph = union(
        parts.select(node("part", "p_partkey").alias("s"), F.lit(P("kind")).alias("p"), cls(F.col("p_type")).alias("o")),
        parts.select(cls(F.col("p_type")).alias("s"), F.lit(t.SUBCLASS).alias("p"), F.lit(good).alias("o")).distinct(),
        data(spark, [(good, t.SUBCLASS, thing)]),
    )
    rules = [
        Rule([("?x", t.TYPE, "?c")], [("?x", P("kind"), "?c")]),
        Rule([("?x", t.TYPE, "?c")], [("?x", t.TYPE, "?b"), ("?b", t.SUBCLASS, "?c")]),
        Rule([("?a", t.SUBCLASS, "?c")], [("?a", t.SUBCLASS, "?b"), ("?b", t.SUBCLASS, "?c")]),
    ]
    made = infer(graph, rules).where(F.col("p") == t.TYPE)
    return made.select(_id("s").alias("p_partkey"), F.regexp_extract("o", r"class/(.*)>", 1).alias("class"))


@query("SELECT 'a' AS rule_name, 2 AS iteration, count(*) AS n FROM nation UNION ALL SELECT 'b', 3, count(*) FROM (SELECT DISTINCT n_regionkey FROM nation)")
def provenance_counts(spark, d):
    rules = [Rule([("?n", P("within"), "?r")], [("?n", P("n_regionkey"), "?r")], "a"), Rule([("?r", P("used"), '"yes"')], [("?n", P("within"), "?r")], "b")]
    return infer(_places(spark, d), rules).groupBy("rule_name", "iteration").agg(F.count("*").alias("n"))


@query("SELECT (SELECT 3 * count(*) FROM nation) + (SELECT 2 * count(*) FROM region) + (SELECT count(*) FROM nation) AS total, (SELECT count(*) FROM nation) AS inferred")
def full_output_graph(spark, d):
    graph = _places(spark, d)
    made = infer(graph, inverse(P("n_regionkey"), P("has_nation")))
    return output_graph(graph, made).agg(F.count("*").alias("total")).crossJoin(made.agg(F.count("*").alias("inferred")))


@query("SELECT n_nationkey FROM nation WHERE contains(lower(n_name), 'on_1')")
def search_box(spark, d):
    made = infer(_places(spark, d), [Rule([("?n", P("called"), "?x")], [("?n", P("n_name"), "?x")], "names")])
    return search(made, "On_1").select(_id("s").cast("int").alias("n_nationkey"))


@query("SELECT 'ex:part/' || p_partkey AS s, CAST(p_size AS VARCHAR) AS size, '\"' || p_brand || '\"' AS brand FROM part")
def prefixed_display(spark, d):
    found = solutions(_parts(spark, d), [("?p", P("p_size"), "?s"), ("?p", P("p_brand"), "?b")])
    shown = lambda c: display(F.col(c), {"ex": BASE})
    return found.select(shown("v_p").alias("s"), shown("v_s").alias("size"), shown("v_b").alias("brand"))


# Functions


def _function_query(name: str, graph: Callable[[SparkSession, str], DataFrame], key: str, binds: dict[str, str], outs: dict[str, Callable[[], Value]], sql: str) -> None:
    """Register a query of raw function results over one pattern per variable; booleans, numbers and strings stay native."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = solutions(graph(spark, d), [("?k", P(p), f"?{x}") for x, p in binds.items()])
        return found.select(_id("v_k").alias(key), *(f().col.alias(n) for n, f in outs.items()))

    QUERIES[name], ORACLES[name] = run, sql


_function_query("fn_str_strlen", _parts, "p_partkey", {"n": "p_name", "z": "p_size"}, {"name": lambda: v.str_(var("n")), "size": lambda: v.str_(var("z")), "len": lambda: v.strlen(var("n")), "iri": lambda: v.str_(var("k"))}, "SELECT p_partkey, p_name AS name, CAST(p_size AS VARCHAR) AS size, CAST(length(p_name) AS DOUBLE) AS len, 'http://ex.org/part/' || p_partkey AS iri FROM part")
_function_query("fn_case", _parts, "p_partkey", {"n": "p_name"}, {"up": lambda: v.ucase(var("n")), "low": lambda: v.lcase(var("n"))}, "SELECT p_partkey, upper(p_name) AS up, lower(p_name) AS low FROM part")
_function_query("fn_substr", _parts, "p_partkey", {"n": "p_name"}, {"a": lambda: v.substr(var("n"), 2), "b": lambda: v.substr(var("n"), 2, 3), "c": lambda: v.substr(var("n"), -1, 4), "d": lambda: v.substr(var("n"), 4, -2)}, "SELECT p_partkey, substr(p_name, 2) AS a, substr(p_name, 2, 3) AS b, substr(p_name, 1, 2) AS c, substr(p_name, 2, 2) AS d FROM part")
_function_query("fn_contains_starts_ends", _parts, "p_partkey", {"n": "p_name"}, {"a": lambda: v.contains(var("n"), "e"), "b": lambda: v.strstarts(var("n"), "p"), "c": lambda: v.strends(var("n"), "1")}, "SELECT p_partkey, contains(p_name, 'e') AS a, starts_with(p_name, 'p') AS b, ends_with(p_name, '1') AS c FROM part")
_function_query("fn_before_after", _parts, "p_partkey", {"b": "p_brand"}, {"before": lambda: v.strbefore(var("b"), "#"), "after": lambda: v.strafter(var("b"), "#"), "miss": lambda: v.strafter(var("b"), "@@")}, "SELECT p_partkey, CASE WHEN contains(p_brand, '#') THEN split_part(p_brand, '#', 1) ELSE '' END AS before, CASE WHEN contains(p_brand, '#') THEN substr(p_brand, strpos(p_brand, '#') + 1) ELSE '' END AS after, '' AS miss FROM part")
_function_query("fn_regex_replace", _parts, "p_partkey", {"n": "p_name"}, {"r": lambda: v.regex(var("n"), "^P.*[0-4]$", "i"), "s": lambda: v.replace(var("n"), "[0-9]+", "<$&>")}, "SELECT p_partkey, regexp_matches(p_name, '^P.*[0-4]$', 'i') AS r, regexp_replace(p_name, '([0-9]+)', '<\\1>', 'g') AS s FROM part")
_function_query("fn_encode_for_uri", _parts, "p_partkey", {"b": "p_brand"}, {"u": lambda: v.encode_for_uri(v.concat(var("b"), " é(~)!*"))}, "SELECT p_partkey, replace(replace(p_brand, '#', '%23'), ' ', '%20') || '%20%C3%A9(~)!*' AS u FROM part")
_function_query("fn_lang", _documents, "doc_id", {"x": "line"}, {"tag": lambda: v.lang(var("x")), "en": lambda: v.langmatches(v.lang(var("x")), "EN"), "some": lambda: v.langmatches(v.lang(var("x")), "*"), "iri": lambda: v.lang(var("k"))}, "SELECT doc_id, lang AS tag, lang = 'en' AS en, lang <> '' AS some, '' AS iri FROM documents")
_function_query("fn_lang_text", _documents, "doc_id", {"x": "line"}, {"len": lambda: v.strlen(var("x"))}, "SELECT doc_id, CAST(length(text) AS DOUBLE) AS len FROM documents")
_function_query("fn_datatype", _parts, "p_partkey", {"z": "p_size", "n": "p_name", "r": "p_retailprice"}, {"a": lambda: v.datatype(var("z")), "b": lambda: v.datatype(var("n")), "c": lambda: v.datatype(var("r")), "e": lambda: v.datatype(var("k"))}, "SELECT p_partkey, '<http://www.w3.org/2001/XMLSchema#integer>' AS a, '<http://www.w3.org/2001/XMLSchema#string>' AS b, '<http://www.w3.org/2001/XMLSchema#double>' AS c, CAST(NULL AS VARCHAR) AS e FROM part")
_function_query("fn_build_terms", _parts, "p_partkey", {"z": "p_size", "n": "p_brand"}, {"a": lambda: v.strdt(v.str_(var("z")), f"<{t.XSD}decimal>"), "b": lambda: v.strlang(var("n"), "EN-us"), "c": lambda: v.iri(v.concat("urn:x:", var("z"))), "e": lambda: v.bnode(v.concat("b", var("z")))}, "SELECT p_partkey, '\"' || p_size || '\"^^<http://www.w3.org/2001/XMLSchema#decimal>' AS a, '\"' || p_brand || '\"@en-us' AS b, '<urn:x:' || p_size || '>' AS c, '_:b' || p_size AS e FROM part")
_function_query("fn_term_tests", _parts, "p_partkey", {"z": "p_size", "n": "p_brand"}, {"a": lambda: v.isiri(var("k")), "b": lambda: v.isliteral(var("z")), "c": lambda: v.isblank(v.bnode("q")), "e": lambda: v.isnumeric(var("z")), "f": lambda: v.isnumeric(var("n")), "g": lambda: v.isliteral(v.str_(var("n"))), "h": lambda: v.sameterm(var("n"), '"Brand#11"')}, "SELECT p_partkey, true AS a, true AS b, true AS c, true AS e, false AS f, false AS g, p_brand = 'Brand#11' AS h FROM part")
_function_query("fn_numbers", _customers, "c_custkey", {"b": "c_acctbal"}, {"a": lambda: v.abs_(var("b")), "c": lambda: v.ceil(var("b")), "f": lambda: v.floor(var("b")), "r": lambda: v.round_(var("b")), "p": lambda: v.plus(var("b"))}, "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, floor(c_acctbal + 0.5) AS r, c_acctbal AS p FROM customer")
_function_query("fn_if", _customers, "c_custkey", {"b": "c_acctbal", "m": "c_mktsegment"}, {"x": lambda: v.if_(v.gt(var("b"), 0), v.str_(var("m")), "debt")}, "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'debt' END AS x FROM customer")
_function_query("fn_date_parts", _orders, "o_orderkey", {"w": "o_orderdate"}, {"y": lambda: v.year(var("w")), "m": lambda: v.month(var("w")), "dd": lambda: v.day(var("w")), "h": lambda: v.hours(var("w")), "mi": lambda: v.minutes(var("w")), "s": lambda: v.seconds(var("w"))}, "SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS y, CAST(month(o_orderdate) AS DOUBLE) AS m, CAST(day(o_orderdate) AS DOUBLE) AS dd, CAST(hour(o_orderdate) AS DOUBLE) AS h, CAST(minute(o_orderdate) AS DOUBLE) AS mi, CAST(second(o_orderdate) AS DOUBLE) AS s FROM orders")
_function_query("fn_zones", _orders, "o_orderkey", {"w": "o_orderdate"}, {"z": lambda: v.tz(var("w")), "o": lambda: v.tz("2020-01-01T10:00:00-05:30"), "tz": lambda: v.timezone(var("w")), "tzo": lambda: v.timezone("2020-01-01T10:00:00-05:30"), "n": lambda: v.str_(v.now(INSTANT))}, "SELECT o_orderkey, 'Z' AS z, '-05:30' AS o, '\"PT0S\"^^<http://www.w3.org/2001/XMLSchema#dayTimeDuration>' AS tz, '\"-PT5H30M\"^^<http://www.w3.org/2001/XMLSchema#dayTimeDuration>' AS tzo, '2026-01-01T00:00:00.000Z' AS n FROM orders")
_function_query("fn_equality", _parts, "p_partkey", {"z": "p_size", "n": "p_brand"}, {"a": lambda: v.eq(var("z"), f'"5.0"^^<{t.XSD}decimal>'), "b": lambda: v.ne(var("n"), '"Brand#11"'), "c": lambda: v.eq(v.str_(var("n")), "Brand#11"), "e": lambda: v.eq(v.add(var("z"), 1), 6), "f": lambda: v.eq(v.isnumeric(var("z")), True)}, "SELECT p_partkey, p_size = 5 AS a, p_brand <> 'Brand#11' AS b, p_brand = 'Brand#11' AS c, p_size = 5 AS e, true AS f FROM part")


@query("SELECT count(*) AS n, count(*) AS ids, count(*) AS iris FROM part")
def fn_uuid(spark, d):
    found = scan(_parts(spark, d), ("?p", P("p_size"), "?z")).select(v.struuid().col.alias("u"), v.uuid().col.alias("i"))
    return found.agg(F.count("*").alias("n"), F.countDistinct("u").alias("ids"), F.countDistinct(F.when(F.col("i").startswith("<urn:uuid:"), F.col("i"))).alias("iris"))


# Shapes


def _conform(graph: DataFrame, shape: Shape, name: str) -> DataFrame:
    return sh.conforming(graph, shape).select(_id("node").alias(name))


def _prop(p, **constraints) -> Property:
    return Property(p, constraints)


_CUSTOMER, _ORDER, _PART, _DOC = (("class", f"<{BASE}{x}>") for x in ("customer", "orders", "part", "documents"))
_N = lambda x: f'"{x}"^^<{t.XSD}double>'


@query("SELECT c_custkey AS node, 'class' AS target FROM customer UNION ALL SELECT o_custkey, 'objects' FROM (SELECT DISTINCT o_custkey FROM orders) UNION ALL SELECT o_orderkey, 'subjects' FROM orders UNION ALL SELECT 7, 'node' UNION ALL SELECT c_custkey, 'where' FROM customer WHERE c_acctbal >= 9000")
def shape_targets(spark, d):
    graph = union(_customers(spark, d), _orders(spark, d))
    rich = Shape(f"<{BASE}rich>", (), {}, (_prop(P("c_acctbal"), min_count=1, min_inclusive=_N(9000)),))
    targets = {"class": _CUSTOMER, "objects": ("objects_of", P("o_custkey")), "subjects": ("subjects_of", P("o_totalprice")), "node": ("node", f"<{BASE}customer/7>"), "where": ("where", rich)}
    return union(*(sh.focus_nodes(graph, Shape(f"<{BASE}s>", (x,))).select(_id("node").alias("node"), F.lit(k).alias("target")) for k, x in targets.items()))


@query("SELECT c_custkey FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE n BETWEEN 2 AND 12")
def shape_counts(spark, d):
    graph = union(_customers(spark, d), _orders(spark, d))
    return _conform(graph, Shape(f"<{BASE}s>", (_CUSTOMER,), {}, (_prop(inv(P("o_custkey")), min_count=2, max_count=12),)), "c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 150000.5 AND o_orderdate > TIMESTAMP '1995-01-01'")
def shape_ranges(spark, d):
    when = f'"1995-01-01T00:00:00Z"^^<{t.XSD}dateTime>'
    return _conform(_orders(spark, d), Shape(f"<{BASE}s>", (_ORDER,), {}, (_prop(P("o_totalprice"), min_inclusive=_N(1000), max_exclusive=_N(150000.5)), _prop(P("o_orderdate"), min_exclusive=when))), "o_orderkey")


@query("SELECT p_partkey FROM part WHERE length(p_name) BETWEEN 6 AND 60 AND regexp_matches(p_brand, '#[12]', 'i') AND p_size IN (1,2,3,4,5,6,7,8,9,10)")
def shape_lengths_pattern_in(spark, d):
    sizes = tuple(f'"{n}"^^<{t.XSD}integer>' for n in range(1, 11))
    return _conform(_parts(spark, d), Shape(f"<{BASE}s>", (_PART,), {}, (_prop(P("p_name"), min_length=6, max_length=60), _prop(P("p_brand"), pattern="#[12]", flags="i"), _prop(P("p_size"), **{"in": sizes, "datatype": f"<{t.XSD}integer>", "node_kind": "Literal"}))), "p_partkey")


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'fr')")
def shape_languages(spark, d):
    return _conform(_documents(spark, d), Shape(f"<{BASE}s>", (_DOC,), {}, (_prop(P("line"), language_in=("EN", "fr"), unique_lang=True, min_count=1),)), "doc_id")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (SELECT n_nationkey FROM nation)")
def shape_value_class(spark, d):
    graph = union(_customers(spark, d), _places(spark, d))
    return _conform(graph, Shape(f"<{BASE}s>", (_CUSTOMER,), {"node_kind": "IRI"}, (_prop(P("c_mktsegment"), has_value='"BUILDING"'), _prop(P("c_nationkey"), **{"class": f"<{BASE}nation>", "min_count": 1}))), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE (c_acctbal >= 5000) <> (c_mktsegment = 'BUILDING') AND NOT c_acctbal < 0 AND (c_acctbal >= 5000 OR c_nationkey = 3)")
def shape_logic(spark, d):
    rich = Shape(f"<{BASE}rich>", (), {}, (_prop(P("c_acctbal"), min_inclusive=_N(5000)),))
    builder = Shape(f"<{BASE}builder>", (), {}, (_prop(P("c_mktsegment"), has_value='"BUILDING"'),))
    poor = Shape(f"<{BASE}poor>", (), {}, (_prop(P("c_acctbal"), max_exclusive=_N(0)),))
    third = Shape(f"<{BASE}third>", (), {}, (_prop(P("c_nationkey"), has_value=f"<{BASE}nation/3>"),))
    return _conform(_customers(spark, d), Shape(f"<{BASE}s>", (_CUSTOMER,), {"xone": (rich, builder), "not": poor, "or": (rich, third)}), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice >= 100000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < 2000)")
def shape_node_some_value(spark, d):
    graph = union(_customers(spark, d), _orders(spark, d))
    big = Shape(f"<{BASE}big>", (), {}, (_prop(P("o_totalprice"), min_inclusive=_N(100000)),))
    fair = Shape(f"<{BASE}fair>", (), {}, (_prop(P("o_totalprice"), min_inclusive=_N(2000)),))
    return _conform(graph, Shape(f"<{BASE}s>", (_CUSTOMER,), {}, (_prop(inv(P("o_custkey")), some_value=big, node=fair),)), "c_custkey")


@query("SELECT p_partkey FROM part WHERE p_type IN (SELECT min(p_type) FROM part)")
def shape_root_class_subset(spark, d):
    parts = _read(spark, d, "part")
    least = parts.agg(F.min("p_type").alias("m"))
    cls = lambda c: t.iri(F.concat(F.lit(f"{BASE}class/"), F.regexp_replace(c, "[^A-Za-z0-9]", "_")))
    graph = union(
        parts.select(node("part", "p_partkey").alias("s"), F.lit(P("kind")).alias("p"), cls(F.col("p_type")).alias("o")),
        parts.select(node("part", "p_partkey").alias("s"), F.lit(P("listed")).alias("p"), cls(F.col("p_type")).alias("o")),
        least.select(cls(F.col("m")).alias("s"), F.lit(t.SUBCLASS).alias("p"), F.lit(f"<{BASE}class/First>").alias("o")),
    )
    shape = Shape(f"<{BASE}s>", (("subjects_of", P("kind")),), {}, (_prop(P("kind"), root_class=f"<{BASE}class/First>", subset_of=P("listed")),))
    return _conform(graph, shape, "p_partkey")


@query("SELECT conv_id, count(*) AS members FROM conversations GROUP BY conv_id")
def rdf_lists(spark, d):
    return list_members(_conversation_lists(spark, d), _list_heads(spark, d)).groupBy(_id("head").alias("conv_id")).agg(F.count("*").alias("members"))


def _list_heads(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "conversations").where("turn = 0").select(node("list/0", "conv_id").alias("head"))


def _conversation_lists(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's roles as an RDF list, and a node that points at it."""
    turns = _read(spark, d, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    cells = turns.join(last, "conv_id")
    cell = lambda n: t.iri(F.concat_ws("/", F.lit(f"{BASE}list"), n.cast("string"), F.col("conv_id").cast("string")))
    return union(
        cells.select(cell(F.col("turn")).alias("s"), F.lit(t.FIRST).alias("p"), t.literal(F.col("role")).alias("o")),
        cells.select(cell(F.col("turn")).alias("s"), F.lit(t.REST).alias("p"), F.when(F.col("turn") == F.col("last"), F.lit(t.NIL)).otherwise(cell(F.col("turn") + 1)).alias("o")),
        last.select(node("conversation", "conv_id").alias("s"), F.lit(P("roles")).alias("p"), cell(F.lit(0)).alias("o")),
    )


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) BETWEEN 2 AND 4 AND count(*) FILTER (role NOT IN ('user', 'assistant')) = 0")
def shape_lists(spark, d):
    spoken = Shape(f"<{BASE}spoken>", (), {"in": ('"user"', '"assistant"')})
    shape = Shape(f"<{BASE}s>", (("subjects_of", P("roles")),), {}, (_prop(P("roles"), min_list_length=2, max_list_length=4, member_shape=spoken),))
    return _conform(_conversation_lists(spark, d), shape, "conv_id")


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) = count(DISTINCT role)")
def shape_unique_members(spark, d):
    shape = Shape(f"<{BASE}s>", (("subjects_of", P("roles")),), {}, (_prop(P("roles"), unique_members=True),))
    return _conform(_conversation_lists(spark, d), shape, "conv_id")


@query("SELECT c_custkey, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal >= 5000 GROUP BY 1")
def targeted_rule(spark, d):
    """A rule limited to conforming nodes, behind the rule that makes what the shape reads."""
    graph = union(_customers(spark, d), _orders(spark, d))
    rich = Shape(f"<{BASE}s>", (("subjects_of", P("rich")),), {}, (_prop(P("rich"), min_count=1),))
    rules = [
        Rule([("?c", P("rich"), '"yes"')], [("?c", P("c_acctbal"), "?b"), Filter(lambda: v.ge(var("b"), 5000), ("?b",))], "rich"),
        Rule([("?c", P("served"), "?o")], [("?o", P("o_custkey"), "?c")], "served", ("?c", lambda g: sh.conforming(g, rich))),
    ]
    made = infer(graph, rules, gates=sh.shape_gates(rules, {1: rich})).where(F.col("p") == P("served"))
    return made.groupBy(_id("s").alias("c_custkey")).agg(F.count("*").alias("orders"))


@query("SELECT o_orderkey FROM orders UNION SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal >= 9000")
def shape_united_targets(spark, d):
    """Nodes of three targets at once, numbered by the key that ends their name."""
    graph = union(_customers(spark, d), _orders(spark, d))
    rich = Shape(f"<{BASE}rich>", (), {}, (_prop(P("c_acctbal"), min_count=1, min_inclusive=_N(9000)),))
    shape = Shape(f"<{BASE}s>", (("subjects_of", P("o_totalprice")), ("objects_of", P("o_custkey")), ("where", rich)))
    return sh.focus_nodes(graph, shape).select(_id("node").alias("o_orderkey")).distinct()


@query("SELECT CAST(doc_id // 4 AS BIGINT) AS bundle FROM documents GROUP BY 1 HAVING count(*) = count(DISTINCT lang)")
def shape_unique_lang(spark, d):
    """Bundles of four documents, of which no two are in one language."""
    docs = _read(spark, d, "documents").withColumn("bundle", F.floor(F.col("doc_id") / 4))
    graph = docs.select(node("bundle", "bundle").alias("s"), F.lit(P("holds")).alias("p"), t.literal(F.col("doc_id").cast("string"), lang=F.col("lang")).alias("o"))
    return _conform(graph, Shape(f"<{BASE}s>", (("subjects_of", P("holds")),), {}, (_prop(P("holds"), unique_lang=True),)), "bundle")


@query("SELECT p_size FROM part GROUP BY p_size HAVING count(*) FILTER (p_retailprice >= 990 AND p_brand NOT IN (SELECT b.p_brand FROM part b WHERE b.p_size = part.p_size AND b.p_retailprice < 940)) = 0 AND count(*) FILTER (p_retailprice >= 990) > 0")
def shape_subset(spark, d):
    """Sizes whose brands of dear parts are all among those of their cheap parts."""
    parts = _read(spark, d, "part")
    edge = lambda name, test: parts.where(test).select(node("size", "p_size").alias("s"), F.lit(P(name)).alias("p"), t.literal(F.col("p_brand")).alias("o"))
    graph = union(edge("dear", "p_retailprice >= 990"), edge("cheap", "p_retailprice < 940"))
    return _conform(graph, Shape(f"<{BASE}s>", (("subjects_of", P("dear")),), {}, (_prop(P("dear"), subset_of=P("cheap")),)), "p_size").select(F.col("p_size").cast("int"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= 5000 AND c_mktsegment = 'BUILDING'")
def shape_and(spark, d):
    """Both of two shapes; parts of a shape that say nothing of conformance, and a property without a path, change nothing."""
    rich = Shape(f"<{BASE}rich>", (), {}, (_prop(P("c_acctbal"), min_inclusive=_N(5000)),))
    builder = Shape(f"<{BASE}builder>", (), {}, (_prop(P("c_mktsegment"), has_value='"BUILDING"', reifier_shape=rich, reification_required=True), _prop(None, max_count=0)))
    return _conform(_customers(spark, d), Shape(f"<{BASE}s>", (_CUSTOMER,), {"and": (rich, builder)}), "c_custkey")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey = 2 UNION SELECT 3")
def shape_pointed_at(spark, d):
    """Nodes that point at a shape are its targets, beside those that it names."""
    nations = _read(spark, d, "nation").where("n_regionkey = 2")
    graph = union(_places(spark, d), nations.select(node("nation", "n_nationkey").alias("s"), F.lit(f"<{t.SH}shape>").alias("p"), F.lit(f"<{BASE}s>").alias("o")))
    shape = Shape(f"<{BASE}s>", (("node", f"<{BASE}nation/3>"),), {}, (_prop(P("n_name"), min_count=1),))
    return _conform(graph, shape, "n_nationkey").select(F.col("n_nationkey").cast("int"))


# Runs and checks


@query("SELECT n_regionkey AS region, count(DISTINCT n_nationkey) AS nations, 1 AS nodes FROM nation GROUP BY 1")
def head_blank_nodes(spark, d):
    """A blank node in a head stands for one node, which every solution shares; its rule runs once."""
    rule = Rule([("?r", P("holder"), "_:all"), ("_:all", P("member"), "?n")], [("?n", P("n_regionkey"), "?r")])
    made = infer(_places(spark, d), [rule])
    held = made.where(F.col("p") == P("holder")).select(F.col("s").alias("r"), F.col("o").alias("b"))
    members = made.where(F.col("p") == P("member")).select(F.col("s").alias("b"), F.col("o").alias("n"))
    own = _read(spark, d, "nation").select(node("nation", "n_nationkey").alias("n"), F.col("n_regionkey").alias("region"), node("region", "n_regionkey").alias("r"))
    both = held.join(members, "b").join(own, ["n", "r"])
    return both.groupBy("region").agg(F.countDistinct("n").alias("nations"), F.countDistinct("b").cast("int").alias("nodes"))


@query("""
SELECT 'triples' AS what, 'good' AS name, count(*) AS n FROM nation UNION ALL SELECT 'triples', 'DATA block', 1
UNION ALL SELECT 'triples', 'Targeted rule 1 (FOR ?n)', count(*) FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'iterations', '', 3 UNION ALL SELECT 'error', 'Error evaluating rule "bad": no such test', 1 UNION ALL SELECT 'error', 'Error evaluating rule "worse": [USER_RAISED_EXCEPTION] no value', 1
UNION ALL SELECT 'rule', 'good', 0 UNION ALL SELECT 'rule', 'bad', 1 UNION ALL SELECT 'rule', 'worse', 2 UNION ALL SELECT 'rule', 'Targeted rule 1 (FOR ?n)', 3""")
def run_summary(spark, d):
    """A run in which one rule can't be planned and one fails in its job: triples by rule, passes, errors and rules."""

    def no_test():
        raise ValueError("no such test")

    in_one = Shape(f"<{BASE}s>", (("subjects_of", P("n_regionkey")),), {}, (_prop(P("n_regionkey"), has_value=f"<{BASE}region/1>"),))
    rules = [
        Rule([("?n", P("within"), "?r")], [("?n", P("n_regionkey"), "?r")], "good"),
        Rule([("?n", P("x"), "?r")], [("?n", P("n_regionkey"), "?r"), Filter(no_test, ("?r",))], "bad"),
        Rule([("?n", P("y"), "?r")], [("?n", P("n_regionkey"), "?r"), Filter(lambda: Value("bool", F.raise_error(F.lit("no value")).cast("boolean")), ("?r",))], "worse"),
        Rule([("?n", P("first"), '"yes"')], [("?n", P("n_name"), "?x")], None, ("?n", lambda g: sh.conforming(g, in_one))),
    ]
    facts = data(spark, [(f"<{BASE}nation/99>", P("n_name"), '"NOWHERE"')])
    done = run(_places(spark, d), rules, facts, gates=sh.shape_gates(rules, {3: in_one}))
    counts = done.triples.groupBy(F.col("rule_name").alias("name")).agg(F.count("*").alias("n")).select(F.lit("triples").alias("what"), "name", "n")
    told = [("iterations", "", done.iterations), *(("error", e, 1) for e in done.errors), *(("rule", r, n) for n, r in enumerate(done.rules))]
    return counts.unionByName(spark.createDataFrame(told, "what string, name string, n long"))


# Set operations, sources and limits


@query("SELECT c_nationkey AS nation, c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, s_suppkey, 'supplier' FROM supplier")
def union_of_rules(spark, d):
    rules = [Rule([("?n", P("trades_with"), "?x")], [("?x", P("c_nationkey"), "?n")]), Rule([("?n", P("trades_with"), "?x")], [("?x", P("s_nationkey"), "?n")])]
    made = infer(union(_customers(spark, d), _suppliers(spark, d)), rules)
    return made.select(_id("s").cast("int").alias("nation"), _id("o").alias("id"), F.regexp_extract("o", r"org/(\w+)/", 1).alias("kind"))


@query("SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def set_difference(spark, d):
    """A rule emits only triples that aren't known, each once."""
    graph = union(_customers(spark, d), _suppliers(spark, d))
    known = solutions(graph, [("?s", P("s_acctbal"), "?b"), Filter(lambda: v.gt(var("b"), 5000), ("?b",)), ("?s", P("s_nationkey"), "?n")]).select(F.col("v_n").alias("s"), F.lit(P("served")).alias("p"), F.lit('"yes"').alias("o"))
    made = infer(union(graph, known.distinct()), [Rule([("?n", P("served"), '"yes"')], [("?c", P("c_nationkey"), "?n")])])
    return made.select(_id("s").cast("int").alias("nation"))


@query("SELECT c_nationkey AS nation, count(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY 1")
def distinct_value_nodes(spark, d):
    graph = _customers(spark, d)
    focus = graph.where(F.col("p") == P("c_nationkey")).select(F.col("o").alias("node")).distinct()
    return sh.path_values(graph, seq(inv(P("c_nationkey")), P("c_mktsegment")), focus).groupBy(_id("node").cast("int").alias("nation")).agg(F.count("*").alias("segments"))


@query("SELECT n_nationkey, n_name, n_regionkey AS r_regionkey FROM nation")
def ntriples_round_trip(spark, d):
    from grafthorn.sources.shared import shared_dir
    from grafthorn.sources.triples import read_ntriples, write_ntriples

    path = shared_dir(spark)
    write_ntriples(_places(spark, d), path)
    found = solutions(read_ntriples(spark, path), [("?n", P("n_name"), "?x"), ("?n", P("n_regionkey"), "?r")])
    return found.select(_id("v_n").cast("int").alias("n_nationkey"), _text("v_x").alias("n_name"), _id("v_r").cast("int").alias("r_regionkey"))


@query("SELECT a.conv_id, a.turn AS x, b.turn AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn + 2 AND a.turn + 4")
def capped_passes(spark, d):
    """Two passes of the closure reach steps of up to four."""
    made = infer(_turns(spark, d), transitive(P("next")), max_passes=2)
    part = lambda c, n: F.regexp_extract(c, r"turn/(\d+)/(\d+)>", n).try_cast("bigint")
    return made.select(part("s", 1).alias("conv_id"), part("s", 2).alias("x"), part("o", 2).alias("y"))


@query("SELECT a.conv_id, a.turn, b.role AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2 WHERE a.role = b.role")
def path_chain_same_role(spark, d):
    body = [("?a", seq(P("next"), P("next")), "?b"), ("?a", P("role"), "?r"), ("?b", P("role"), "?r")]
    part = lambda c, n: F.regexp_extract(c, r"turn/(\d+)/(\d+)>", n).try_cast("bigint")
    return solutions(_turns(spark, d), body).select(part("v_a", 1).alias("conv_id"), part("v_a", 2).alias("turn"), _text("v_r").alias("answer"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS big FROM events GROUP BY 1")
def events_as_triples(spark, d):
    graph = table_triples(_read(spark, d, "events"), "event", ["event_id"], ["event_type", "value"], {"user_id": "user"}, unique=True)
    found = solutions(graph, [("?e", P("event_type"), "?k"), ("?e", P("value"), "?v")])
    return found.groupBy(_text("v_k").alias("event_type")).agg(F.count("*").alias("n"), F.sum(v.gt(var("v"), 50).col.cast("int")).alias("big"))


@query("SELECT DISTINCT o_custkey AS c_custkey, p_brand FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 45")
def lineitem_star(spark, d):
    """A join over the largest table: its rows get a subject of their own, since their keys repeat."""
    lines = _read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity").alias("row"))
    graph = union(table_triples(lines, "lineitem", ["row"], ["l_quantity"], {"l_orderkey": "orders", "l_partkey": "part"}, unique=True), _orders(spark, d), _parts(spark, d))
    body = [("?l", P("l_quantity"), "?q"), Filter(lambda: v.ge(var("q"), 45), ("?q",)), ("?l", P("l_orderkey"), "?o"), ("?l", P("l_partkey"), "?p"), ("?o", P("o_custkey"), "?c"), ("?p", P("p_brand"), "?b")]
    return solutions(graph, body).select(_id("v_c").alias("c_custkey"), _text("v_b").alias("p_brand")).distinct()


# Demands, targeted recursion, class hierarchies, existence tests


@query("SELECT a.conv_id, a.turn AS x, b.turn AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn + 1 WHERE a.turn = 1 AND a.conv_id IN (1, 2, 3)")
def demanded_closure(spark, d):
    """The closure from three nodes alone: what they reach is asked for, and nothing else is made."""
    made = infer_wanted(_turns(spark, d), transitive(P("next")), [(f"<{BASE}turn/{k}/1>", P("next"), "?y") for k in (1, 2, 3)])
    part = lambda c, n: F.regexp_extract(c, r"turn/(\d+)/(\d+)>", n).try_cast("bigint")
    return made.select(part("s", 1).alias("conv_id"), part("s", 2).alias("x"), part("o", 2).alias("y"))


@query("SELECT a.conv_id, a.turn AS x, b.turn AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn WHERE a.role = 'user'")
def recursive_targeted_rule(spark, d):
    """Nodes that a user's turn reaches: a rule with a focus that reads its own triples."""
    speaks = Shape(f"<{BASE}s>", (("subjects_of", P("role")),), {}, (_prop(P("role"), has_value='"user"'),))
    rules = [
        sh.targeted([("?a", P("leads"), "?b")], [("?a", P("next"), "?b")], "?a", speaks, "begin"),
        sh.targeted([("?a", P("leads"), "?c")], [("?a", P("leads"), "?b"), ("?b", P("next"), "?c")], "?a", speaks, "go on"),
    ]
    made = infer(_turns(spark, d), rules, gates=sh.shape_gates(rules, {0: speaks, 1: speaks}))
    part = lambda c, n: F.regexp_extract(c, r"turn/(\d+)/(\d+)>", n).try_cast("bigint")
    return made.select(part("s", 1).alias("conv_id"), part("s", 2).alias("x"), part("o", 2).alias("y"))


@query("SELECT p_partkey FROM part WHERE p_partkey BETWEEN 64 AND 127 AND p_size >= 10")
def deep_class_hierarchy(spark, d):
    """Instances of a class whose subclasses go down 63 levels: each part's class is below that of the part before it, but for every 64th."""
    parts = _read(spark, d, "part")
    cls = lambda c: t.iri(F.concat(F.lit(f"{BASE}class/"), c.cast("string")))
    links = parts.where("p_partkey % 64 <> 0").select(cls(F.col("p_partkey")).alias("s"), F.lit(t.SUBCLASS).alias("p"), cls(F.col("p_partkey") - 1).alias("o"))
    typed = parts.select(node("part", "p_partkey").alias("s"), F.lit(t.TYPE).alias("p"), cls(F.col("p_partkey")).alias("o"))
    graph = union(table_triples(parts, "part", ["p_partkey"], ["p_size"], typed=False, unique=True), Graph((), [(links, frozenset([t.SUBCLASS])), (typed, frozenset([t.TYPE]))]))
    shape = Shape(f"<{BASE}s>", (("class", f"<{BASE}class/64>"),), {}, (_prop(P("p_size"), min_inclusive=f'"10"^^<{t.XSD}integer>'),))
    return _conform(graph, shape, "p_partkey")


@query("SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM part WHERE p_size > 49)")
def existence_part(spark, d):
    """A part of the body that shares no variable with the head's is a test, not a product."""
    body = [("?n", P("n_name"), "?x"), ("?p", P("p_size"), "?z"), Filter(lambda: v.gt(var("z"), 49), ("?z",))]
    made = infer(union(_places(spark, d), _parts(spark, d)), [Rule([("?n", P("served"), '"yes"')], body)])
    return made.select(_id("s").cast("int").alias("n_nationkey"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 7 AND c_custkey IN (SELECT o_custkey FROM orders)")
def node_some_value(spark, d):
    """``some_value`` and ``subset_of`` on a node shape are about the node itself."""
    graph = union(_customers(spark, d), _orders(spark, d))
    seventh = Shape(f"<{BASE}seventh>", (), {}, (_prop(P("c_nationkey"), has_value=f"<{BASE}nation/7>"),))
    return _conform(graph, Shape(f"<{BASE}s>", (_CUSTOMER,), {"some_value": seventh, "subset_of": seq(inv(P("o_custkey")), P("o_custkey"))}), "c_custkey")


@query("SELECT n_nationkey FROM nation")
def shape_unordered_bound(spark, d):
    """A bound that has no order fails every node, also those without a value: here the nodes that fail are wanted."""
    much = Shape(f"<{BASE}much>", (), {}, (_prop(P("absent"), min_inclusive='"much"'),))
    return _conform(_places(spark, d), Shape(f"<{BASE}s>", (("class", f"<{BASE}nation>"),), {"not": much}), "n_nationkey").select(F.col("n_nationkey").cast("int"))


@query("SELECT n_nationkey, 'É' || n_name AS n_name FROM nation")
def ntriples_escapes(spark, d):
    """Names written with \\u and \\U escapes in files of N-Triples."""
    from grafthorn.sources.shared import shared_dir
    from grafthorn.sources.triples import read_ntriples

    path = shared_dir(spark)
    name = F.regexp_replace("n_name", "N", F.lit("\\\\u004E"))
    line = F.concat(node("nation", "n_nationkey"), F.lit(f' {P("n_name")} "\\U000000C9'), name, F.lit('" .'))
    _read(spark, d, "nation").select(line.alias("value")).write.text(path)
    return solutions(read_ntriples(spark, path), [("?n", P("n_name"), "?x")]).select(_id("v_n").cast("int").alias("n_nationkey"), _text("v_x").alias("n_name"))
