"""Targets, constraints, gates and targeted rules."""

import pytest

from grafthorn.functions import terms as t
from grafthorn.functions import values as v
from grafthorn.functions.values import var
from grafthorn.operators import shapes as sh
from grafthorn.operators.patterns import Filter, Not, Set, inv, seq
from grafthorn.operators.rules import Rule, data, infer
from grafthorn.operators.shapes import Property, Shape, UnsupportedShape, conforming, focus_nodes
from grafthorn.plans.strata import NotStratifiable

NUM = f"<{t.XSD}integer>"


def n(x):
    return f'"{x}"^^{NUM}'


@pytest.fixture(scope="module")
def people(spark):
    rows = [("<ann>", t.TYPE, "<Person>"), ("<bob>", t.TYPE, "<Person>"), ("<cy>", t.TYPE, "<Student>"), ("<Student>", t.SUBCLASS, "<Person>")]
    rows += [("<ann>", "<age>", n(30)), ("<bob>", "<age>", n(9)), ("<cy>", "<age>", n(20)), ("<cy>", "<age>", n(21))]
    rows += [("<ann>", "<name>", '"Ann"@en'), ("<ann>", "<name>", '"Anne"@en-US'), ("<bob>", "<name>", '"Bob"@en'), ("<bob>", "<name>", '"Robert"@en'), ("<cy>", "<name>", '"Cy"@fr')]
    rows += [("<ann>", "<knows>", "<bob>"), ("<bob>", "<knows>", "<cy>"), ("<ann>", "<friend>", "<bob>"), ("<bob>", "<friend>", "<ann>"), ("_:x", "<shown>", '"s"')]
    rows += [("<ann>", f"<{t.SH}shape>", "<s>")]
    return data(spark, rows).cache()


def named(df):
    return {r.node for r in df.collect()}


def passing(people, **constraints):
    path = constraints.pop("path", "<age>")
    return named(conforming(people, Shape("<none>", (("class", "<Person>"),), {}, (Property(path, constraints),))))


def test_targets(people):
    assert named(focus_nodes(people, Shape("<none>", (("class", "<Person>"),)))) == {"<ann>", "<bob>", "<cy>"}
    assert named(focus_nodes(people, Shape("<none>", (("node", "<gone>"),)))) == {"<gone>"}
    assert named(focus_nodes(people, Shape("<none>", (("subjects_of", "<knows>"), ("objects_of", "<knows>"))))) == {"<ann>", "<bob>", "<cy>"}
    assert named(focus_nodes(people, Shape("<s>"))) == {"<ann>"}
    adult = Shape("<adult>", (), {}, (Property("<age>", {"min_count": 1, "min_inclusive": n(18)}),))
    assert named(focus_nodes(people, Shape("<none>", (("where", adult),)))) == {"<ann>", "<cy>"}
    with pytest.raises(UnsupportedShape):
        focus_nodes(people, Shape("<none>", (("sparql", "x"),)))


EVERYONE = {"<ann>", "<bob>", "<cy>"}
CASES = [
    ({"min_count": 1, "max_count": 1}, {"<ann>", "<bob>"}),
    ({"min_inclusive": n(20)}, {"<ann>", "<cy>"}),
    ({"max_exclusive": n(21)}, {"<bob>"}),
    ({"min_inclusive": '"x"'}, set()),
    ({"has_value": n(21)}, {"<cy>"}),
    ({"in": (n(9), n(30))}, {"<ann>", "<bob>"}),
    ({"datatype": NUM, "node_kind": "Literal"}, EVERYONE),
    ({"datatype": f"<{t.XSD}string>"}, set()),
    ({"min_length": 2}, {"<ann>", "<cy>"}),
    ({"pattern": "^3"}, {"<ann>"}),
    ({"path": "<name>", "pattern": "^AN", "flags": "i"}, {"<ann>"}),
    ({"path": "<name>", "language_in": ("EN",)}, {"<ann>", "<bob>"}),
    ({"path": "<name>", "unique_lang": True}, {"<ann>", "<cy>"}),
    ({"path": "<knows>", "class": "<Student>", "min_count": 1}, {"<bob>"}),
    ({"path": "<knows>", "root_class": "<bob>", "min_count": 1}, {"<ann>"}),
    ({"path": "<friend>", "subset_of": "<knows>"}, {"<ann>", "<cy>"}),
    ({"path": inv("<knows>"), "min_count": 1}, {"<bob>", "<cy>"}),
    ({"path": seq("<knows>", "<knows>"), "has_value": "<cy>"}, {"<ann>"}),
    ({"path": None, "min_count": 1}, set()),
    ({"path": None}, EVERYONE),
    ({"path": "<absent>", "in": ("<x>",)}, EVERYONE),
]


@pytest.mark.parametrize("constraints,want", CASES, ids=[str(i) for i in range(len(CASES))])
def test_constraints(people, constraints, want):
    assert passing(people, **constraints) == want


def test_nested(people):
    adult = Shape("<adult>", (), {}, (Property("<age>", {"min_inclusive": n(18)}),))
    child = Shape("<child>", (), {}, (Property("<age>", {"max_exclusive": n(18)}),))
    assert passing(people, path="<knows>", node=adult, min_count=1) == {"<bob>"}
    assert passing(people, path="<knows>", some_value=child) == {"<ann>"}
    top = lambda **c: named(conforming(people, Shape("<none>", (("class", "<Person>"),), c)))
    assert top(**{"not": adult}) == {"<bob>"}
    assert top(**{"or": (adult, child)}) == EVERYONE
    assert top(**{"and": (adult, child)}) == set()
    assert top(xone=(adult, Shape("<any>"))) == {"<bob>"}
    with pytest.raises(UnsupportedShape):
        top(min_count=1)
    with pytest.raises(UnsupportedShape):
        passing(people, closed=True)


def test_targeted_rule_waits_for_its_shape(people):
    grown = Shape("<grown>", (("subjects_of", "<adult>"),), {}, (Property("<adult>", {"min_count": 1}),))
    rules = [
        Rule([("?x", "<greets>", "?y")], [("?x", "<knows>", "?y")], "greet", ("?x", lambda g: conforming(g, grown))),
        Rule([("?x", "<adult>", '"yes"')], [("?x", "<age>", "?a"), Filter(lambda: v.ge(var("a"), 18), ("?a",))], "adult"),
    ]
    gates = sh.shape_gates(rules, {0: grown})
    out = {(r.s, r.p, r.o) for r in infer(people, rules, gates=gates).collect() if r.p == "<greets>"}
    assert out == {("<ann>", "<greets>", "<bob>")}
    loop = [Rule([("?x", "<adult>", "?y")], [("?x", "<knows>", "?y")], "loop", ("?x", lambda g: conforming(g, grown)))]
    with pytest.raises(NotStratifiable):
        infer(people, loop, gates=sh.shape_gates(loop, {0: grown}))


def test_depth_guard(people):
    deep = Shape("<end>")
    for k in range(60):
        deep = Shape(f"<d{k}>", (), {"node": deep})
    with pytest.raises(RecursionError):
        conforming(people, deep, focus_nodes(people, Shape("<s>")))


def test_body_elements_are_plain_values():
    assert Not(("?a", "<p>", "?b")).body == (("?a", "<p>", "?b"),)
    assert Set("?x", lambda: var("y"), ("?y",)).name == "?x"
