"""Expression functions: tables of input and expected output."""

import pytest
from pyspark.sql import functions as F

from grafthorn.functions import terms as t
from grafthorn.functions import values as v
from grafthorn.functions.values import Value, const

INT, DEC, DBL = (f"<{t.XSD}{n}>" for n in ("integer", "decimal", "double"))


def typed(x, kind):
    return f'"{x}"^^{kind}'


def null():
    return Value(v.TERM, F.lit(None).cast("string"))


def cases():
    return [
        (v.substr("hello", 2), "ello"),
        (v.substr("hello", 2, 3), "ell"),
        (v.substr("hello", -1, 4), "he"),
        (v.substr("hello", 4, -2), "el"),
        (v.substr("hello", 9), ""),
        (v.strbefore("a#b#c", "#"), "a"),
        (v.strafter("a#b#c", "#"), "b#c"),
        (v.strbefore("abc", "#"), ""),
        (v.strafter("abc", "#"), ""),
        (v.encode_for_uri("a b/é~(!)"), "a%20b%2F%C3%A9~(!)"),
        (v.replace("a1b22", "[0-9]+", "<$&>"), "a<1>b<22>"),
        (v.regex("Hello", "^hel", "i"), True),
        (v.regex("Hello", "^hel"), False),
        (v.lang('"x"@en-gb'), "en-gb"),
        (v.lang("<http://x>"), ""),
        (v.langmatches("en-GB", "en"), True),
        (v.langmatches("english", "en"), False),
        (v.langmatches("", "*"), False),
        (v.datatype(typed(1, INT)), INT),
        (v.datatype('"x"'), f"<{t.XSD}string>"),
        (v.datatype(v.str_("x")), None),
        (v.strdt("1", DEC), typed(1, DEC)),
        (v.strlang("x", "EN"), '"x"@en'),
        (v.iri("urn:x"), "<urn:x>"),
        (v.bnode("b"), "_:b"),
        (v.isliteral(v.str_("x")), False),
        (v.isliteral('"x"'), True),
        (v.isblank("_:b"), True),
        (v.isiri("<http://x>"), True),
        (v.isnumeric(typed("2.5", DBL)), True),
        (v.isnumeric(const(2)), True),
        (v.isnumeric('"2"'), False),
        (v.sameterm(typed(1, INT), typed("1.0", DEC)), False),
        (v.eq(typed(1, INT), typed("1.0", DEC)), True),
        (v.eq('"a"', '"a"@en'), False),
        (v.eq(null(), null()), False),
        (v.ne(null(), '"a"'), True),
        (v.not_(null()), True),
        (v.eq(v.add(typed(2, INT), 1), typed("3.0", DEC)), True),
        (v.lt(typed(9, INT), typed(10, INT)), True),
        (v.lt('"b"', '"a"'), False),
        (v.lt(f'"2020-05-01"^^<{t.XSD}date>', f'"2020-12-01"^^<{t.XSD}date>'), True),
        (v.add('"3 apples"', 1), 4.0),
        (v.add('"none"', 1), None),
        (v.div(1, 0), None),
        (v.round_(-2.5), -2.0),
        (v.round_(2.5), 3.0),
        (v.ceil(1.2), 2.0),
        (v.floor(-1.2), -2.0),
        (v.abs_(typed(-3, INT)), 3.0),
        (v.if_(True, "a", "b"), "a"),
        (v.in_(typed(5, INT), 1, 5), True),
        (v.not_in('"x"', '"y"'), True),
        (v.year("2021-03-04T05:06:07.250Z"), 2021.0),
        (v.hours("2021-03-04T05:06:07+02:00"), 3.0),
        (v.seconds("2021-03-04T05:06:07.250Z"), 7.25),
        (v.year("soon"), None),
        (v.tz("2021-03-04T05:06:07-05:00"), "-05:00"),
        (v.tz("2021-03-04"), ""),
        (v.timezone("2021-03-04T05:06:07-05:00"), f'"-PT5H0M"^^<{t.XSD}dayTimeDuration>'),
        (v.timezone("2021-03-04"), None),
        (v.strlen("añb"), 3.0),
        (v.concat('"a"@en', typed(1, INT), "<http://x>"), "a1http://x"),
    ]


def test_functions(spark):
    table = cases()
    row = spark.range(1).select(*(value.col.alias(f"c{i}") for i, (value, _) in enumerate(table))).first()
    wrong = [(i, got, want) for i, (got, (_, want)) in enumerate(zip(row, table, strict=True)) if got != want]
    assert not wrong


@pytest.mark.parametrize("x,text", [(12.0, "12"), (16.0934, "16.0934"), (1.5e7, "15000000"), (12345678.25, "12345678.25"), (5e-4, "0.0005"), (1e21, "1e+21"), (1.5e-7, "1.5e-7"), (-3.5, "-3.5")])
def test_number_text(spark, x, text):
    assert spark.range(1).select(t.number_text(F.lit(x))).first()[0] == text


def test_computed_numbers_become_integer_or_decimal(spark):
    a, b = spark.range(1).select(v.add(1.5, 1.5).term(), v.add(1.25, 1).term()).first()
    assert (a, b) == (typed(3, INT), typed("2.25", DEC))


@pytest.mark.parametrize(
    "term,lex,lang,kind",
    [('"a"', "a", "", t.XSD + "string"), ('"a"@en', "a", "en", t.RDF + "langString"), ('"a"^^<urn:d>', "a", "", "urn:d"), ('"q"^^<x>"', 'q"^^<x>', "", t.XSD + "string"), ('"two\nlines"@de', "two\nlines", "de", t.RDF + "langString"), ("<urn:i>", "urn:i", "", None), ("_:b", "b", "", None)],
)
def test_term_parts(spark, term, lex, lang, kind):
    c = F.lit(term)
    assert tuple(spark.range(1).select(t.lex(c), t.lang(c), t.datatype(c)).first()) == (lex, lang, kind)


def test_truth(spark):
    zero = const(typed(0, INT))
    cases = [(zero, True), (const(0), False), (const(""), False), (const('""'), False), (const(f'"true"^^<{t.XSD}boolean>'), True), (const(f'"1"^^<{t.XSD}boolean>'), False), (null(), False), (const("<x>"), True)]
    row = spark.range(1).select(*(x.truth().alias(f"c{i}") for i, (x, _) in enumerate(cases))).first()
    assert list(row) == [want for _, want in cases]
