"""Queries whose joins or memory once grew faster than their tables."""

from pyspark.sql import functions as F

from grafthorn import queries as core
from grafthorn.functions import terms as t
from grafthorn.operators import shapes as sh
from grafthorn.operators.patterns import bindings, distinct_bindings, inv, seq
from grafthorn.operators.shapes import Property, Shape
from grafthorn.sources.graph import Graph
from grafthorn.sources.triples import predicate as P
from grafthorn.sources.triples import table_triples, union


def _sides(spark):
    """Suppliers and customers of two nations, some rows twice."""
    s = spark.range(60).select(F.col("id").alias("s_suppkey"), (F.col("id") % 2).alias("s_nationkey")).union(spark.range(5).selectExpr("id", "id % 2")).coalesce(1)
    c = spark.range(80).select(F.col("id").alias("c_custkey"), (F.col("id") % 2).alias("c_nationkey")).union(spark.range(7).selectExpr("id", "id % 2")).coalesce(1)
    return union(table_triples(s, "supplier", ["s_suppkey"], [], {"s_nationkey": "nation"}, unique=True), table_triples(c, "customer", ["c_custkey"], [], {"c_nationkey": "nation"}, unique=True))


def test_few_values_are_joined_in_many_tasks(spark):
    found = bindings(_sides(spark), [("?s", P("s_nationkey"), "?n"), ("?c", P("c_nationkey"), "?n")])
    assert found.df.count() == 65 * 87 // 2 + 1
    assert found.df.groupBy(F.spark_partition_id()).count().count() > 2


def test_distinct_solutions_need_no_exchange_after_the_join(spark):
    found = distinct_bindings(_sides(spark), [("?s", seq(P("s_nationkey"), inv(P("c_nationkey"))), "?c")])
    plan = found.df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("HashAggregate")
    rows = [tuple(r) for r in found.df.select(found.id("s"), found.id("c")).collect()]
    assert sorted(rows) == [(s, c) for s in range(60) for c in range(80) if s % 2 == c % 2]


def test_theta_join_reads_ids_from_keys(spark):
    plan = core.theta_join(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and "concat_ws" not in plan


def test_large_hierarchies_make_no_table_larger_than_their_links(spark):
    links = spark.range(1300).where("id % 64 <> 0").selectExpr("concat('<c', id, '>') as s", f"'{t.SUBCLASS}' as p", "concat('<c', id - 1, '>') as o")
    loop = spark.createDataFrame([("<c1>", t.SUBCLASS, "<c63>")], "s string, p string, o string")
    graph = Graph((), [(links.union(loop), frozenset([t.SUBCLASS]))])
    below = lambda top: {r.node for r in sh.subclasses(graph, top).collect()}
    assert below("<c64>") == {f"<c{i}>" for i in range(64, 128)} and below("<c70>") == {f"<c{i}>" for i in range(70, 128)}
    # Those of the loop are also above themselves, and c0 is above it.
    assert below("<c5>") == {f"<c{i}>" for i in range(1, 64)} and below("<c0>") == {f"<c{i}>" for i in range(64)} and below("<none>") == {"<none>"}
    size = links.count() + 1
    # c1 has two classes above it, c0 once for each class of the loop.
    assert max(table.count() for table in graph.kept.values()) <= size + 63


def test_shapes_on_rows_that_refer_to_a_table_join_keys(spark):
    for name in ("shape_node_some_value", "node_some_value"):
        plan = core.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "concat_ws" not in plan[plan.index("Join") :]


def test_shapes_on_rows_that_refer_to_a_table(spark):
    """The same as over printed triples, also where rows repeat, refer to none or have no value."""
    people = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (4, None), (5, "e")], "id long, name string")
    bills = spark.createDataFrame([(1, 1, 5.0), (1, 1, 5.0), (2, 1, 50.0), (3, 2, 7.0), (4, 3, None), (5, 4, 80.0), (6, None, 90.0), (7, 9, 90.0), (None, 5, 90.0)], "bill long, person long, amount double")
    graph = union(table_triples(people, "person", ["id"], ["name"], unique=True), table_triples(bills, "bill", ["bill"], ["amount"], {"person": "person"}, unique=True))
    high = Shape("<high>", (), {}, (Property(P("amount"), {"min_inclusive": '"10"^^<http://www.w3.org/2001/XMLSchema#double>', "min_count": 1}),))
    path, one = inv(P("person")), "<http://ex.org/bill/2>"
    first = Shape("<first>", (), {"in": (one,)})
    named = {"some_value": Shape("<n>", (), {}, (Property(P("name"), {"min_count": 1}),))}
    for own, c in (({}, {"some_value": high}), (named, {"node": high}), ({}, {"has_value": one, "min_count": 1}), ({}, {"in": (one, "<http://ex.org/bill/1>")}), ({"subset_of": seq(path, P("person"))}, {"node": first})):
        shape = Shape("<s>", (("class", "<http://ex.org/person>"),), own, (Property(path, c),))
        assert sorted(r.node for r in sh.conforming(graph, shape).collect()) == sorted(r.node for r in sh.conforming(graph.triples(), shape).collect()), (c, own)


def test_pairs_of_many_with_many_take_little_space(spark, tmp_path):
    """Rows of such a join stand in blocks, so a file of it holds runs and short repeats."""
    s = spark.range(4000).select(F.col("id").alias("s_suppkey"), (F.col("id") % 2).alias("s_nationkey"))
    c = spark.range(4000).select((F.col("id") * 7).alias("c_custkey"), (F.col("id") % 2).alias("c_nationkey"))
    graph = union(table_triples(s, "supplier", ["s_suppkey"], [], {"s_nationkey": "nation"}, unique=True), table_triples(c, "customer", ["c_custkey"], [], {"c_nationkey": "nation"}, unique=True))
    found = distinct_bindings(graph, [("?s", seq(P("s_nationkey"), inv(P("c_nationkey"))), "?c")])
    found.df.select(found.id("s").alias("s"), found.id("c").alias("c")).write.parquet(f"{tmp_path}/pairs")
    made = spark.read.parquet(f"{tmp_path}/pairs")
    assert made.count() == made.distinct().count() == made.where("s % 2 = c div 7 % 2").count() == 8_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 8_000_000 * 0.3
