"""Graphs of tables against their printed triples, and the plans that native columns give."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from grafthorn import queries as core
from grafthorn.functions import terms as t
from grafthorn.functions import values as v
from grafthorn.functions.values import const, var
from grafthorn.operators import shapes as sh
from grafthorn.operators.patterns import Filter, Not, Set, components, inv, seq, solutions
from grafthorn.operators.rules import Rule, data, infer, transitive
from grafthorn.operators.shapes import Property, Shape
from grafthorn.plans.demand import demanded, infer_wanted
from grafthorn.plans.strata import is_stratifiable
from grafthorn.sources.graph import BASE, Graph
from grafthorn.sources.triples import predicate as P
from grafthorn.sources.triples import read_ntriples, table_triples, union

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.fixture(scope="module")
def tables(spark):
    """Two tables with nulls, odd numbers, texts with quotes and tags, and a key that repeats in one of them."""
    at = datetime.datetime
    people = [
        (1, "Ann", 5.0, 3, at(2020, 1, 1), "en", 1), (2, 'B"o"b', -0.0, None, at(2020, 1, 1, 0, 0, 0, 500000), "de", 2), (3, "", float("nan"), 7, None, None, None),
        (4, "Ann", float("inf"), 3, at(2019, 12, 31, 23, 59, 59), "EN", 9), (5, None, float("-inf"), 0, at(2021, 5, 5), "fr", 1), (6, "7", 1e10, 7, at(2020, 1, 2), "en", 3),
        (None, "gone", 1.0, 1, at(2020, 1, 1), "en", 1),
    ]
    a = spark.createDataFrame(people, "id long, name string, score double, size int, born timestamp, tag string, home int")
    b = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "x", 9), (3, "z", None)], "home long, code string, person long")
    return a, b


@pytest.fixture(scope="module")
def graphs(tables):
    a, b = tables
    native = union(
        table_triples(a, "person", ["id"], ["name", "score", "size", "born"], {"home": "home"}, unique=True),
        table_triples(a.select("id", F.col("name").alias("label"), "tag"), "person", ["id"], ["label"], langs={"label": "tag"}, typed=False, unique=True),
        table_triples(b, "home", ["home"], ["code"], {"person": "person"}),
    )
    return native, native.triples()


TIME = '"2020-01-01T00:00:00{}Z"^^<' + t.XSD + "dateTime>"
TESTS = [
    *(lambda op=op, c=c: op(var("s"), c) for op in (v.lt, v.le, v.gt, v.ge, v.eq, v.ne) for c in (5, 0, -1, f'"5.0"^^<{t.XSD}double>', '"abc"', "abc", f'"NaN"^^<{t.XSD}double>')),
    *(lambda op=op, c=c: op(var("z"), c) for op in (v.lt, v.ge, v.eq) for c in (3, 2.5, f'"3"^^<{t.XSD}integer>', f'"3.0"^^<{t.XSD}decimal>', f'"03"^^<{t.XSD}string>', "<urn:x>")),
    *(lambda op=op, c=c: op(var("n"), c) for op in (v.lt, v.gt, v.eq, v.ne) for c in ('"Ann"', "Ann", '"Ann"@en', 7, f'"7"^^<{t.XSD}integer>')),
    *(lambda op=op, c=c: op(var("w"), c) for op in (v.lt, v.le, v.gt, v.ge, v.eq) for c in (TIME.format(""), TIME.format(".25"), f'"2020-01-01"^^<{t.XSD}date>')),
    lambda: v.eq(var("x"), f"<{BASE}person/1>"), lambda: v.ne(var("x"), f"<{BASE}person/01>"), lambda: v.in_(var("z"), 3, 7), lambda: v.not_in(var("n"), '"Ann"', "7"),
    lambda: v.contains(var("n"), "n"), lambda: v.strstarts(var("n"), "A"), lambda: v.strends(var("n"), "b"), lambda: v.not_(v.strends(var("n"), "b")),
    lambda: v.gt(var("s"), var("z")), lambda: v.eq(var("s"), var("z")), lambda: v.or_(v.gt(var("s"), 4), v.eq(var("n"), "")), lambda: v.gt(v.strlen(var("n")), 2), lambda: v.isnumeric(var("z")),
    lambda: v.eq(v.datatype(var("z")), f"<{t.XSD}integer>"), lambda: v.regex(var("n"), "^a", "i"), lambda: v.gt(v.year(var("w")), 2019), lambda: v.eq(v.lang(var("l")), "en"), lambda: const(True), lambda: v.gt(v.add(var("z"), var("s")), 8),
]


def both(graphs, body):
    found = [solutions(g, body).distinct() for g in graphs]
    return tuple(sorted(map(repr, df.select(*sorted(df.columns)).collect())) for df in found)


def test_filters_agree(graphs):
    """All tests at once, as columns of true and false, over each set of variables."""
    body = {"s": "score", "z": "size", "n": "name", "w": "born"}
    for names in (("s", "z", "n"), ("w", "n", "s", "z")):
        patterns = [("?x", P(body[x]), f"?{x}") for x in names] + [("?x", P("label"), "?l")]
        fit = [k for k, test in enumerate(TESTS) if _works(test, {"x", "l", *names})]
        flags = [[*patterns, *(Set(f"?f{k}", TESTS[k], ("?x",)) for k in part)] for part in itertools.batched(fit, 20)]
        for own in flags:
            native, printed = both(graphs, own)
            assert native == printed and native


def _works(test, names):
    return {c for c in test.__code__.co_consts if isinstance(c, str) and len(c) == 1 and c in "sznwxl"} <= names


BODIES = [
    [("?x", t.TYPE, "?k")], [("?x", "?p", "?o")], [("?x", P("home"), "?h"), ("?h", P("code"), "?c")], [("?h", P("person"), "?x"), ("?x", P("name"), "?n")],
    [("?x", P("name"), "?n"), ("?y", P("name"), "?n")], [("?x", P("score"), "?s"), ("?y", P("score"), "?s")], [("?x", P("name"), '"Ann"')], [("?x", P("size"), f'"3"^^<{t.XSD}integer>')],
    [("?x", P("score"), f'"-0.0"^^<{t.XSD}double>')], [("?x", P("score"), f'"0.0"^^<{t.XSD}double>')], [(f"<{BASE}person/1>", P("name"), "?n"), (f"<{BASE}person/1>", P("size"), "?z")],
    [("?x", P("label"), '"Ann"@en')], [("?x", P("label"), "?a"), ("?x", P("name"), "?a")], [("?x", P("home"), "?x")], [("?x", t.TYPE, f"<{BASE}person>"), ("?x", P("size"), "?z")],
    [("?x", seq(P("home"), inv(P("home"))), "?y")], [("?x", P("name"), "?n"), Not(("?x", P("home"), "?h"), ("?h", P("code"), '"y"'))],
    [("?x", P("size"), "?z"), Not(("?y", P("size"), "?w"), Filter(lambda: v.gt(var("w"), var("z")), ("?w", "?z")))],
    [("?x", P("home"), "?h"), ("?x", P("score"), "?s"), Not(("?y", P("home"), "?h"), ("?y", P("score"), "?q"), Filter(lambda: v.lt(var("q"), var("s")), ("?q", "?s")))],
    [("?x", P("name"), "?n"), Filter(lambda: v.ne(var("n"), '"7"'), ("?n",)), ("?x", P("size"), "?z"), Set("?t", lambda: v.add(var("z"), 1), ("?z",)), ("?y", P("size"), "?z")],
]


@pytest.mark.parametrize("k", range(len(BODIES)))
def test_bodies_agree(graphs, k):
    native, printed = both(graphs, BODIES[k])
    assert native == printed


def test_shapes_agree(graphs):
    n, d = (lambda x: f'"{x}"^^<{t.XSD}integer>'), (lambda x: f'"{x}"^^<{t.XSD}double>')
    cases = [
        Property(P("size"), {"min_count": 1, "max_count": 1}), Property(P("size"), {"max_count": 0}), Property(P("size"), {"min_inclusive": n(3), "max_exclusive": n(7)}), Property(P("score"), {"min_exclusive": d("0.0")}),
        Property(P("score"), {"max_inclusive": d("NaN")}), Property(P("size"), {"min_inclusive": '"x"'}), Property(P("born"), {"min_exclusive": TIME.format("")}), Property(P("born"), {"max_inclusive": TIME.format("")}),
        Property(P("name"), {"min_length": 1, "max_length": 3}), Property(P("name"), {"pattern": "^a", "flags": "i"}), Property(P("name"), {"in": ('"Ann"', '"7"')}), Property(P("name"), {"datatype": f"<{t.XSD}string>", "node_kind": "Literal"}),
        Property(P("home"), {"node_kind": "IRI", "has_value": f"<{BASE}home/1>"}), Property(P("label"), {"language_in": ("en",), "unique_lang": True}), Property(P("absent"), {"in": ("<x>",)}), Property(None, {"min_count": 1}),
        Property(P("size"), {"has_value": n(3)}), Property(P("label"), {"datatype": f"<{t.RDF}langString>"}),
    ]
    native, printed = graphs
    small, ann = Shape("<small>", (), {}, (cases[2],)), Shape("<ann>", (), {}, (cases[10],))
    whole = [Shape("<s>", (("class", f"<{BASE}person>"),), {}, (c,)) for c in cases]
    whole += [Shape("<s>", (("subjects_of", P("size")),), {k: x}, (cases[0],)) for k, x in (("and", (small, ann)), ("or", (small, ann)), ("xone", (small, ann)), ("not", small), ("node", ann), ("in", (f"<{BASE}person/1>",)))]
    for shape in whole:
        assert sh._target_rows(native, shape) and sh.row_test(native, native.maps[0], shape) is not None or shape.properties[0].path == P("label")
        assert {r.node for r in sh.conforming(native, shape).collect()} == {r.node for r in sh.conforming(printed, shape).collect()}, shape


def test_constants_reach_the_files(spark):
    for name, pushed in (("filter_numeric", "GreaterThanOrEqual(c_acctbal,5000.0)"), ("filter_dates", "GreaterThanOrEqual(o_orderdate,1996-06-01T00:00)"), ("shape_ranges", "LessThan(o_totalprice,150000.5)"), ("scan_by_pattern", "EqualTo(c_mktsegment,BUILDING)"), ("filter_string", "StringContains(p_name,a)")):
        spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
        assert pushed in plan(core.QUERIES[name](spark, SF)).split("PushedFilters")[1], name


def test_stars_are_one_scan(spark):
    for name, number in (("filter_string", 1), ("events_as_triples", 1), ("bgp_star_chain", 4), ("lineitem_star", 3), ("shape_ranges", 1), ("shape_lengths_pattern_in", 1), ("not_with_filter", 2)):
        df = core.QUERIES[name](spark, SF)
        assert scans(df) == number, name
        assert "v_" not in "".join(x for x in plan(df).split("\n") if "Join" in x), name


def test_a_key_that_repeats_is_joined(graphs):
    native, printed = both(graphs, [("?h", P("code"), "?c"), ("?h", P("person"), "?x")])
    assert native == printed and len(native) == 5


def test_what_is_known_is_not_dealt_out_again(spark):
    from grafthorn.operators.rules import unseen
    from grafthorn.sources.shared import bucketed

    edges = spark.range(2000).selectExpr("concat('<', id, '>') s", "'<p>' p", "concat('<', id + 1, '>') o")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        known = [bucketed(edges, "s", "o"), bucketed(edges.where("s > '<5'"), "s", "o")]
        one = edges.limit(1500).groupBy("s", "p", "o").agg(F.lit(0).alias("rule_index"))
        several = edges.union(edges.withColumn("p", F.lit("<q>"))).groupBy("s", "p", "o").agg(F.lit(0).alias("rule_index"))
        for made, left in ((one, 0), (several, 2000)):
            text = plan(unseen(made, known))
            assert unseen(made, known).count() == left
            # What was made is dealt out, the known tables aren't.
            assert text.count("Bucketed: true") == 2 and text.count("Exchange hashpartitioning") <= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_demand_reaches_what_is_asked_for_alone(spark):
    chain = data(spark, [(f"<{k}_{i}>", "<p>", f"<{k}_{i + 1}>") for k in "ab" for i in range(12)])
    want = {(r.s, r.p, r.o) for r in infer(chain, transitive("<p>")).where("s = '<a_8>'").collect()}
    assert {(r.s, r.p, r.o) for r in infer_wanted(chain, transitive("<p>"), [("<a_8>", "<p>", "?y")]).collect()} == want and len(want) == 3
    rules, first = demanded(transitive("<p>"), [("<a_8>", "<p>", "?y")])
    made = infer(chain, rules, data(spark, first))
    assert made.where("p = '<p>'").count() <= 6 and not made.where("s like '<b%'").count()
    back = infer_wanted(chain, transitive("<p>"), [("?x", "<p>", "<a_3>"), ("<b_0>", "<p>", "<b_9>")])
    assert {(r.s, r.o) for r in back.collect()} == {("<a_0>", "<a_3>"), ("<a_1>", "<a_3>"), ("<b_0>", "<b_9>")}


@pytest.mark.parametrize("seed", range(3))
def test_demand_agrees_on_random_rules(spark, seed):
    rng = random.Random(seed)
    names = [f"<{x}>" for x in "abcde"]
    graph = data(spark, list({(rng.choice(names), f"<{rng.choice('pq')}>", rng.choice(names)) for _ in range(14)}))
    rules = []
    for _ in range(3):
        body = [(rng.choice(["?x", "?y"]), f"<{rng.choice('pqst')}>", rng.choice(["?y", "?z", "<a>"])) for _ in range(2)]
        bound = sorted({x for e in body for x in e if x[0] == "?"})
        rules.append(Rule([(rng.choice(bound), f"<{rng.choice('st')}>", rng.choice(bound))], body + ([Not((bound[0], "<q>", bound[-1]))] if seed else [])))
    wanted = [(rng.choice(names), "<s>", "?y"), ("?x", "<t>", rng.choice(names))]
    whole = infer(graph, rules)
    want = {(r.s, r.p, r.o) for r in whole.collect() if any(all(y[0] == "?" or x == y for x, y in zip((r.s, r.p, r.o), w, strict=True)) for w in wanted)}
    assert {(r.s, r.p, r.o) for r in infer_wanted(graph, rules, wanted).collect()} == want


def test_targeted_rules_that_change_their_own_nodes(spark):
    """Without gates a rule's nodes may grow in its own stratum: the new ones read all triples, the old ones what is new."""
    chain = data(spark, [(f"<{i}>", "<next>", f"<{i + 1}>") for i in range(6)] + [("<0>", "<on>", '"yes"')])
    lit = Shape("<lit>", (("subjects_of", "<on>"),), {}, (Property("<on>", {"min_count": 1}),))
    rule = sh.targeted([("?y", "<on>", '"yes"')], [("?x", "<next>", "?y")], "?x", lit)
    assert {r.s for r in infer(chain, [rule]).collect()} == {f"<{i}>" for i in range(1, 7)}


def test_parts_without_wanted_variables_are_tests(spark):
    assert [sorted(x) for _, x in components([("?a", "<p>", "?b"), ("?c", "<q>", "?d"), ("?b", "<r>", "?e")])] == [["?c", "?d"], ["?a", "?b", "?e"]]
    graph = core._places(spark, SF)
    df = solutions(graph, [("?n", P("n_name"), "?x"), ("?r", P("r_name"), "?y")], wanted=["?n"])
    assert df.columns == ["v_n", "v_x"] and df.count() == 25 and "Cartesian" not in plan(df)
    assert solutions(graph, [("?n", P("n_name"), "?x"), ("?r", P("absent"), "?y")], wanted=["?n"]).count() == 0


def test_class_hierarchy_by_doubling(spark):
    graph = Graph((), [(data(spark, [(f"<c{i + 1}>", t.SUBCLASS, f"<c{i}>") for i in range(40)] + [("<c0>", t.SUBCLASS, "<c40>")]).triples(), frozenset([t.SUBCLASS]))])
    assert sh.subclasses(graph, "<c7>").count() == 41 and graph.kept["ancestors"].count() == 41 * 41


def test_gates_count_for_stratification(spark):
    grown = Shape("<grown>", (("subjects_of", "<adult>"),), {}, (Property("<adult>", {"min_count": 1}),))
    loop = [Rule([("?x", "<adult>", "?y")], [("?x", "<knows>", "?y")], "loop", ("?x", lambda g: sh.conforming(g, grown)))]
    assert is_stratifiable(loop)[0] and not is_stratifiable(loop, sh.shape_gates(loop, {0: grown}))[0]


def test_escapes_in_ntriples(spark, tmp_path):
    (tmp_path / "x.nt").write_text('<urn:\\u00e9> <p> "a\\u0041\\U0001F600b\\\\u0041\\n" .\n')
    assert [tuple(r) for r in read_ntriples(spark, str(tmp_path / "x.nt")).collect()] == [("<urn:é>", "<p>", 'aA\U0001f600b\\u0041\n'.join('""'))]
