"""Patterns, rules, strata and sources; random rule sets against a naive interpreter."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grafthorn.functions import terms as t
from grafthorn.functions import values as v
from grafthorn.functions.values import var
from grafthorn.operators.patterns import Filter, Not, Set, inv, is_variable, seq, solutions
from grafthorn.operators import shapes as sh
from grafthorn.operators.rules import Rule, data, infer, inverse, problems, run, symmetric, transitive
from grafthorn.operators.shapes import Property, Shape
from grafthorn.plans.strata import NotStratifiable, is_stratifiable, may_match, strata
from grafthorn.sources.triples import BASE, display, list_members, read_ntriples, write_ntriples


def graph(spark, *triples):
    return data(spark, [tuple(f"<{x}>" if x[0] not in '<"_' else x for x in tr) for tr in triples])


def made(df):
    return {(r.s, r.p, r.o) for r in df.collect()}


def q(*parts):
    return tuple(x if x[0] in '?<"_' else f"<{x}>" for x in parts)


def test_two_hop(spark):
    g = graph(spark, ("s", "p", "z"), ("z", "q", "o"))
    assert made(infer(g, [Rule([q("?x", "q", "?o")], [q("s", "p", "?z"), q("?z", "q", "?o"), q("?x", "p", "?z")])])) == {q("s", "q", "o")}


def test_cycle_closes(spark):
    g = graph(spark, *((str(i), "p", str((i + 1) % 6)) for i in range(6)))
    out = infer(g, transitive("<p>"))
    assert out.count() == 36 - 6 and out.agg(F.max("iteration")).first()[0] <= 4


def test_declarations(spark):
    g = graph(spark, ("a", "p", "b"))
    assert made(infer(g, symmetric("<p>"))) == {q("b", "p", "a")}
    assert made(infer(g, inverse("<p>", "<q>"))) == {q("b", "q", "a")}


def test_paths(spark):
    g = graph(spark, ("a", "p", "b"), ("b", "q", "c"), ("d", "q", "c"))
    found = solutions(g, [("?x", seq("<p>", seq("<q>", inv("<q>"))), "?y")])
    assert {(r.v_x, r.v_y) for r in found.collect()} == {("<a>", "<b>"), ("<a>", "<d>")}
    back = solutions(g, [("?x", inv(seq("<p>", "<q>")), "?y")])
    assert [(r.v_x, r.v_y) for r in back.collect()] == [("<c>", "<a>")]


def test_negation_kinds(spark):
    g = graph(spark, ("a", "p", "1"), ("b", "p", "2"), ("b", "no", "x"))
    assert {r.v_x for r in solutions(g, [q("?x", "p", "?y"), Not(q("?x", "no", "?z"))]).collect()} == {"<a>"}
    assert solutions(g, [q("?x", "p", "?y"), Not(q("?k", "no", "?z"))]).count() == 0
    inner = Not(q("?x", "p", "?w"), Filter(lambda: v.eq(var("w"), var("y")), ("?w", "?y")))
    assert solutions(g, [q("?x", "p", "?y"), inner]).count() == 0


def test_set_and_provenance(spark):
    g = graph(spark, ("a", "n", f'"3"^^<{t.XSD}integer>'), ("b", "n", '"x"'))
    rule = Rule([q("?x", "m", "?y")], [q("?x", "n", "?v"), Set("?y", lambda: v.mul(var("v"), 2), ("?v",))])
    rows = infer(g, [rule], data(spark, [q("f", "m", "f")])).collect()
    assert {(r.s, r.o, r.rule_name, r.iteration) for r in rows} == {("<a>", f'"6"^^<{t.XSD}integer>', "Rule 1: m", 1), ("<f>", "<f>", "DATA block", 0)}


def test_first_rule_owns_a_triple(spark):
    g = graph(spark, ("a", "p", "b"))
    rules = [Rule([q("?x", "r", "?y")], [q("?x", "p", "?y")], "one"), Rule([q("?x", "r", "?y")], [q("?x", "p", "?y")], "two")]
    assert [r.rule_name for r in infer(g, rules).collect()] == ["one"]


def test_strata():
    p, r = Rule([q("?x", "b", "?y")], [q("?x", "a", "?y")]), Rule([q("?x", "c", "?y")], [q("?x", "a", "?y"), Not(q("?x", "b", "?y"))])
    assert strata([r, p]) == [[1], [0]]
    bad = Rule([q("?x", "b", "?y")], [q("?x", "a", "?y"), Not(q("?x", "b", "?y"))])
    assert not is_stratifiable([bad])[0]
    with pytest.raises(NotStratifiable):
        strata([Rule([q("?x", "n", "?z")], [q("?x", "n", "?y"), Set("?z", lambda: v.add(var("y"), 1), ("?y",))])])


def test_repeated_head_variables_limit_dependencies():
    loop = Rule([q("?x", "p", "?x")], [q("?x", "a", "?y")])
    reads = Rule([q("?z", "b", "?z")], [q("k", "p", "m"), q("?z", "a", "?w"), Not(q("k", "p", "m"))])
    assert strata([loop, reads]) == [[0, 1]]


def test_problems():
    assert problems(Rule([q("?x", "p", "?y")], [q("?x", "p", "?z")])) == ["?y in the head is not bound by the body"]
    assert problems(Rule([q("?x", "p", "?x")], [Filter(lambda: var("x"), ("?x",)), q("?x", "p", "?z")])) == ["?x is read before it is bound"]
    assert problems(Rule([q("?x", "p", "?z")], [q("?x", "p", "?z"), Set("?z", lambda: var("x"), ("?x",))])) == ["?z is assigned but already bound"]
    assert problems(Rule([q("?x", "p", "?z")], [Not(q("?z", "p", "?z")), q("?x", "p", "?y")])) == ["?z in the head is not bound by the body"]


def test_ground_data(spark):
    with pytest.raises(ValueError):
        data(spark, [("?x", "<p>", "<o>")])


def naive(triples, rules):
    """All derived triples by brute force; bodies of plain patterns, then negated ones."""
    known = set(triples)

    def solve(patterns, bound):
        if not patterns:
            yield bound
            return
        for tr in list(known):
            now, ok = dict(bound), True
            for x, y in zip(patterns[0], tr, strict=True):
                if is_variable(x):
                    ok = ok and now.setdefault(x, y) == y
                else:
                    ok = ok and x == y
            if ok:
                yield from solve(patterns[1:], now)

    for layer in strata(rules):
        while True:
            new = set()
            for n in layer:
                rule = rules[n]
                plain = [e for e in rule.body if isinstance(e, tuple)]
                for b in list(solve(plain, {})):
                    if all(not any(True for _ in solve(list(e.body), b)) for e in rule.body if isinstance(e, Not)):
                        new |= {tuple(b.get(x, x) for x in h) for h in rule.head}
            if new <= known:
                break
            known |= new
    return known - set(triples)


@pytest.mark.parametrize("seed", range(4))
def test_random_rules(spark, seed):
    rng = random.Random(seed)
    names = "abcdef"
    triples = list({q(rng.choice(names), rng.choice("pqr"), rng.choice(names)) for _ in range(25)})
    rules = []
    for _ in range(4):
        body = [q(rng.choice(["?x", "?y", "a"]), rng.choice("pqrst"), rng.choice(["?x", "?y", "?z"])) for _ in range(rng.choice([1, 2]))]
        bound = sorted({x for e in body for x in e if is_variable(x)})
        if rng.random() < 0.4:
            body.append(Not(q(rng.choice(bound), rng.choice("pqr"), rng.choice([*bound, "b"]))))
        rules.append(Rule([q(rng.choice(bound), rng.choice("st"), rng.choice(bound))], body))
    assert made(infer(data(spark, triples), rules)) == naive(triples, rules)


def test_ntriples_round_trip(spark, tmp_path):
    rows = [("<urn:s>", "<urn:p>", '"a \\"q\\" \\\\ b"@en'.replace("\\\\", "\\").replace('\\"', '"')), ("_:b1", "<urn:p>", '"line\nend\ttab"'), ("<urn:s>", "<urn:p>", f'"1"^^<{t.XSD}integer>'), ("<urn:s>", "<urn:p>", "<urn:o>")]
    df = data(spark, rows)
    write_ntriples(df.union(data(spark, [('"lit"', "<urn:p>", "<urn:o>")])), str(tmp_path / "out"))
    assert made(read_ntriples(spark, str(tmp_path / "out"))) == set(rows)


def test_malformed_line_fails(spark, tmp_path):
    (tmp_path / "x.nt").write_text("# comment\n\n<a> <b> .\n")
    with pytest.raises(Exception, match="not an N-Triples line"):
        read_ntriples(spark, str(tmp_path / "x.nt")).collect()


def test_lists(spark):
    cells = [("<l0>", t.FIRST, '"x"'), ("<l0>", t.REST, "<l1>"), ("<l1>", t.FIRST, '"y"'), ("<l1>", t.REST, t.NIL), ("<c0>", t.FIRST, '"z"'), ("<c0>", t.REST, "<c0>")]
    heads = spark.createDataFrame([("<l0>",), ("<c0>",), ("<none>",)], "head string")
    assert sorted(map(tuple, list_members(data(spark, cells), heads).collect())) == [("<c0>", 0, '"z"'), ("<l0>", 0, '"x"'), ("<l0>", 1, '"y"')]


def test_display(spark):
    terms = ["<http://ex.org/a>", f'"5"^^<{t.XSD}integer>', '"five"@en', "<urn:z>"]
    df = spark.createDataFrame([(x,) for x in terms], "x string")
    assert [r[0] for r in df.select(display(F.col("x"), {"ex": "http://ex.org/"})).collect()] == ["ex:a", "5", '"five"@en', "<urn:z>"]


def test_empty_graph(spark):
    empty = spark.createDataFrame([], "s string, p string, o string")
    assert infer(empty, transitive("<p>")).count() == 0
    assert made(infer(empty, [Rule([q("a", "b", "c")], [Not(q("?x", "p", "?y"))])])) == {q("a", "b", "c")}
    assert list(itertools.islice(infer(empty, []).columns, 3)) == ["s", "p", "o"]


def test_what_is_refused_and_why(spark):
    """What is refused, and for what reason: rules that negate themselves, rules and data that aren't well-formed, unknown and endless shapes."""
    P = lambda x: f"<{BASE}{x}>"  # noqa: E731, N806
    graph = data(spark, [("<n>", P("n_name"), '"N"')])
    n, x, y = P("n_name"), P("x"), P("y")
    odd = [Rule([("?a", x, "?b")], [("?a", n, "?b"), Not(("?a", y, "?b"))]), Rule([("?a", y, "?b")], [("?a", x, "?b")])]
    done = run(graph, odd, data(spark, [(f"<{BASE}a>", x, '"1"')]))
    told = [(e.split(":")[0], 1) for e in done.errors] + [(r["rule_name"], 1) for r in done.triples.select("rule_name").collect()]
    told += [("stratifiable" if is_stratifiable(r)[0] else "not stratifiable", 1) for r in (odd, odd[1:])]
    told.append(("may match", sum(may_match(("?a", x, f"<{BASE}b>"), h) for h in (("?a", x, "?b"), ("?a", y, "?b"), (f"<{BASE}c>", x, f"<{BASE}b>")))))
    wrong = [
        Rule([("?x", x, "?x")], [("?x", n, "?w"), Filter(lambda: var("y"), ("?y",)), ("?y", n, "?w")]),
        Rule([("?x", x, "?x")], [("?x", n, "?w"), Set("?x", lambda: var("w"), ("?w",))]),
        Rule([("?x", x, "?z")], [("?x", n, "?w")]),
        Rule([("?x", x, "?x")], [("?x", n, "?w"), Not(("?x", y, "?v"), Filter(lambda: var("q"), ("?q",)))]),
    ]
    told += [(message, 1) for r in wrong for message in problems(r)]

    def loop(depth: int) -> Shape:
        return Shape(f"<{BASE}loop>", (), {"node": loop(depth - 1)} if depth else {})

    tries = (
        lambda: data(spark, [("?a", x, "?b")]),
        lambda: sh.focus_nodes(graph, Shape(f"<{BASE}s>", (("nowhere", x),))),
        lambda: sh.conforming(graph, Shape(f"<{BASE}s>", (("subjects_of", n),), {}, (Property(n, {"min_size": 1}),))),
        lambda: sh.conforming(graph, loop(60), graph.select(F.col("s").alias("node"))),
    )
    for attempt in tries:
        try:
            attempt()
        except (ValueError, RecursionError) as e:
            told.append((str(e).split(" more than")[0], 1))
    assert Counter(told) == Counter({
        ('Stratification failed', 1): 1,
        ('DATA block', 1): 1,
        ('not stratifiable', 1): 1,
        ('stratifiable', 1): 1,
        ('may match', 2): 1,
        ('?y is read before it is bound', 1): 1,
        ('?x is assigned but already bound', 1): 1,
        ('?z in the head is not bound by the body', 1): 1,
        ('?q is read before it is bound', 1): 1,
        ('data triples must be ground', 1): 1,
        ('target nowhere', 1): 1,
        ('min_size', 1): 1,
        ('shapes refer to each other', 1): 1,
    })
