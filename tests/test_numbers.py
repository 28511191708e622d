"""Recursive strata on numbers of terms."""

import pytest
from pyspark.sql import functions as F

from grafthorn.functions.values import const, ne, var
from grafthorn.operators import rules as r
from grafthorn.operators.patterns import Filter, Not, seq
from grafthorn.operators.rules import Rule, data, infer, transitive
from grafthorn.sources import numbers

CHAIN = [(f"<{i}>", "<next>", f"<{i + 1}>") for i in range(6)]
#: A closure, a rule with constants in its head, then a stratum that negates both.
RULES = [
    *transitive("<next>"),
    Rule([("?x", "<far>", '"yes"@en'), ("<all>", "<has>", "?x")], [("?x", seq("<next>", "<next>"), "?y"), ("?y", "<next>", "<6>")]),
    Rule([("?x", "<near>", "?y")], [("?x", "<next>", "?y"), Not(("?x", "<far>", "?any"))]),
    Rule([("?y", "<near>", "?x")], [("?x", "<near>", "?y"), Not(("<all>", "<has>", "?y"))]),
]


def rows(df):
    return sorted(map(tuple, df.select("s", "p", "o", "rule_index", "iteration").collect()))


@pytest.fixture
def laid_out(monkeypatch):
    """Types of the subjects of all tables that a run lays out."""
    kinds, before = [], r.bucketed
    monkeypatch.setattr(r, "bucketed", lambda df, *keys: kinds.append(df.schema["s"].dataType.typeName()) or before(df, *keys))
    return kinds


def test_numbers_and_terms_make_the_same(spark, laid_out, monkeypatch):
    graph = data(spark, CHAIN)
    by_number = rows(infer(graph, RULES))
    assert "long" in laid_out
    # The same number for several terms is seen, and printed terms are used.
    laid_out.clear()
    monkeypatch.setattr(numbers, "number", lambda term: F.when(term.isNotNull(), F.length(term).cast("long")))
    assert rows(infer(graph, RULES)) == by_number
    assert set(laid_out) == {"string"}
    assert ("<0>", "<next>", "<6>") in {x[:3] for x in by_number} and ("<3>", "<far>", '"yes"@en') in {x[:3] for x in by_number}


def test_passes_join_no_texts(spark, monkeypatch):
    plans, before = [], r.bucketed
    monkeypatch.setattr(r, "bucketed", lambda df, *keys: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or before(df, *keys))
    found = infer(data(spark, CHAIN), transitive("<next>"))
    assert found.count() == 15
    # The first plan lays the base out; the passes join, and no text is in their plans.
    assert len(plans) > 2 and all("Join" in plan and "<next>" not in plan for plan in plans[1:])


def test_a_comparison_of_values_keeps_terms(spark, laid_out):
    rule = Rule([("?x", "<next>", "?z")], [("?x", "<next>", "?y"), ("?y", "<next>", "?z"), Filter(lambda: ne(var("z"), const('"q"')), ("?z",))])
    assert infer(data(spark, CHAIN), [rule]).count() == 15
    assert set(laid_out) == {"string"}


def test_nulls_and_repeats(spark):
    graph = spark.createDataFrame([*CHAIN, *CHAIN, (None, "<next>", "<0>"), ("<6>", "<next>", None), ("<x>", None, "<y>")], "s string, p string, o string")
    assert {x[:3] for x in rows(infer(graph, transitive("<next>")))} == {(f"<{i}>", "<next>", f"<{k}>") for i in range(7) for k in range(i + 2, 7)}
    empty = graph.where("false")
    assert not rows(infer(empty, transitive("<next>")))
