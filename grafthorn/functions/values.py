"""The expression functions of rules, as values of a kind that is known when the plan is built.

A ``Value`` is a column with its kind: TERM (an RDF term), STR, NUM or BOOL (raw results).
Functions choose their form by kind, so everything stays built-in Spark expressions. Missing
and failed values are null; ``text`` reads null as ''.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from datetime import datetime, timedelta
from datetime import timezone as zone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from grafthorn.functions import terms as t

TERM, STR, NUM, BOOL = "term", "str", "num", "bool"


@dataclass(frozen=True)
class Native:
    """The columns of a table that make a term, and their kind (``grafthorn.sources.graph.Kind``); they are never null."""

    kind: object
    cols: Sequence[Column]

    @property
    def name(self) -> str:
        return self.kind.name

    @property
    def is_number(self) -> bool:
        return self.name in ("integer", "double", "float")


_NATIVE: ContextVar[dict[str, Native]] = ContextVar("native", default={})  # noqa: B039 - never changed in place


@contextmanager
def native_columns(columns: dict[str, Native]) -> Iterator[None]:
    """Within it ``var`` knows these variables' columns, so that tests of them can be made on the columns."""
    token = _NATIVE.set(columns)
    try:
        yield
    finally:
        _NATIVE.reset(token)


@dataclass(frozen=True)
class Value:
    """``native`` are the columns of a variable, ``given`` is a constant's value. A ``sure`` boolean is never null.

    ``compared`` tells of a boolean that it compares two variables by number: the operator and their names.
    """

    kind: str
    col: Column
    native: Native | None = None
    given: str | float | bool | None = None
    sure: bool = False
    name: str | None = None
    compared: tuple[str, str, str] | None = None

    def text(self) -> Column:
        """The value as a string; null is ''."""
        if self.native:
            return self.native.kind.lexical(self.native.cols)
        if isinstance(self.given, str) and self.kind == STR:
            return self.col
        if self.kind == TERM:
            out = t.lex(self.col)
        elif self.kind == NUM:
            out = t.number_text(self.col)
        else:
            out = self.col.cast("string")
        return F.coalesce(out, F.lit(""))

    def number(self) -> Column:
        """The value as a double, from the leading number of a literal or string; null if there is none."""
        if self.kind == NUM:
            return self.col
        if self.native and self.native.is_number:
            x = self.native.cols[0].cast("double")
            return x if self.native.name == "integer" else F.when(~F.isnan(x), x)
        if self.kind == TERM:
            return F.when(t.is_literal(self.col), t.leading_number(t.lex(self.col)))
        return t.leading_number(self.col) if self.kind == STR else self.col.cast("double")

    def truth(self) -> Column:
        """Effective boolean value, never null: numeric literals are true whatever their number, computed 0 is false."""
        if self.kind == BOOL:
            if self.sure:
                return self.col
            out = self.col
        elif self.kind == NUM:
            out = self.col != 0
        elif self.kind == STR:
            out = self.col != ""
        else:
            is_bool = self.col.endswith(f'"^^<{t.XSD}boolean>')
            out = F.when(~t.is_literal(self.col), True).when(is_bool, t.lex(self.col) == "true").otherwise(t.lex(self.col) != "")
        return F.coalesce(out, F.lit(False))

    def term(self) -> Column:
        """The value as an RDF term."""
        if self.kind == TERM:
            return self.col
        if self.kind == NUM:
            return t.number_term(self.col)
        return t.literal(self.col.cast("string"), t.XSD + "boolean" if self.kind == BOOL else None)


def _is_numeric(term: Column) -> Column:
    out = F.lit(False)
    for d in t.NUMERIC:
        out = out | term.endswith(f'"^^<{d}>')
    return F.coalesce(out, F.lit(False))


def var(name: str) -> Value:
    """The binding of a rule variable."""
    native = _NATIVE.get().get(name.lstrip("?"))
    if native:
        return Value(TERM, native.kind.printed(native.cols), native, name=name.lstrip("?"))
    return Value(TERM, F.col(f"v_{name.lstrip('?')}"))


def const(x: str | float | bool) -> Value:
    """A constant: a term where the string is written as one, else a raw value."""
    if isinstance(x, bool):
        return Value(BOOL, F.lit(x), given=x, sure=True)
    if isinstance(x, str):
        return Value(TERM if x[:1] in ("<", '"') or x[:2] == "_:" else STR, F.lit(x), given=x)
    return Value(NUM, F.lit(float(x)), given=float(x))


def _v(x) -> Value:
    return x if isinstance(x, Value) else const(x)


def _bool(c: Column, sure: bool = False) -> Value:
    return Value(BOOL, c if sure else F.coalesce(c, F.lit(False)), sure=sure)


def _sure(*values: Value) -> bool:
    """Truths that are never null."""
    return all(v.kind == BOOL and v.sure for v in values)


def _plain(*values: Value) -> bool:
    """Texts that are never null."""
    return all(v.native or isinstance(v.given, str) and v.kind == STR for v in values)


def _given_number(v: Value) -> float | None:
    """The number of a constant, from the leading number of a literal or string."""
    if v.kind == NUM and v.given is not None:
        return float(v.given)
    if isinstance(v.given, str) and v.given[:1] != "<" and v.given[:2] != "_:":
        text = re.sub(r'(?s)^"(.*)".*$', r"\1", v.given) if v.kind == TERM else v.given
        found = re.match(t.LEADING_NUMBER, text)
        return float(found[1]) if found else None
    return None


def _given_time(v: Value) -> datetime | None:
    """The time of a constant date or date-time, without its zone; zones count from UTC."""
    found = re.fullmatch(rf'"(\d{{4}}-\d\d-\d\d(?:T\d\d:\d\d(?::\d\d(?:\.\d{{1,6}})?)?(?:Z|[+-]\d\d:\d\d)?)?)"\^\^<{re.escape(t.XSD)}(?:date|dateTime|dateTimeStamp)>', v.given or "") if isinstance(v.given, str) and v.kind == TERM else None
    if not found:
        return None
    at = datetime.fromisoformat(found[1].replace("Z", "+00:00"))
    return at.astimezone(zone.utc).replace(tzinfo=None) if at.tzinfo else at


def _natively_compared(a: Value, b: Value, how: Callable[[Column, Column], Column], op: str) -> Column | None:
    """The comparison on native columns, where both sides are numbers, or one a time and the other a constant one."""
    sides = []
    for v in (a, b):
        number = _given_number(v)
        # NaN is above all numbers, as its text is.
        sides.append(v.native.cols[0] if v.native and v.native.is_number else F.lit(number) if number is not None else None)
    if (a.native or b.native) and all(x is not None for x in sides):
        return how(*sides)
    if a.native and a.native.name == "timestamp" and (at := _given_time(b)) is not None:
        return time_test(a.native.cols[0], at, op)
    return None


def time_test(c: Column, at: datetime, op: str) -> Column:
    """A time compared with a constant one, as its printed whole seconds would be."""
    whole = at.replace(microsecond=0)
    if op in ("gt", "le") or at != whole:
        whole += timedelta(seconds=1)
    bound = F.lit(whole.isoformat(" ")).cast("timestamp_ntz")
    return c >= bound if op in ("ge", "gt") else c < bound


# Operators


def or_(a, b) -> Value:
    a, b = _v(a), _v(b)
    return _bool(a.truth() | b.truth(), _sure(a, b))


def and_(a, b) -> Value:
    a, b = _v(a), _v(b)
    return _bool(a.truth() & b.truth(), _sure(a, b))


def not_(a) -> Value:
    a = _v(a)
    return _bool(~a.truth(), _sure(a))


def eq(a, b) -> Value:
    """Null equals nothing; truth against booleans; numbers by value; terms by identity; mixed kinds as text."""
    a, b = _v(a), _v(b)
    if b.native and not a.native:
        a, b = b, a
    if a.native and b.given is not None:
        number = _given_number(b) if b.kind == NUM or b.kind == TERM and re.search(rf'"\^\^<(?:{"|".join(map(re.escape, t.NUMERIC))})>$', str(b.given)) else None
        if a.native.is_number and number is not None:
            return _bool(a.native.cols[0] == F.lit(number), True)
        if b.kind == TERM and not (a.native.is_number and number is not None):
            same = a.native.kind.equals(a.native.cols, b.given)
            return _bool(F.lit(False) if same is None else same, True)
        if b.kind == STR:
            return _bool(a.text() == b.col, True)
    some = a.col.isNotNull() & b.col.isNotNull()
    if BOOL in (a.kind, b.kind):
        return _bool(some & (a.truth() == b.truth()))
    if a.kind == b.kind == TERM:
        both = _is_numeric(a.col) & _is_numeric(b.col)
        return _bool(some & F.when(a.col == b.col, True).when(both, a.number() == b.number()).otherwise(False))
    if a.kind == b.kind:
        return _bool(a.col == b.col)
    if {a.kind, b.kind} == {NUM, TERM}:
        other = a if a.kind == TERM else b
        return _bool(some & F.when(_is_numeric(other.col), a.number() == b.number()).otherwise(a.text() == b.text()))
    return _bool(some & (a.text() == b.text()))


def ne(a, b) -> Value:
    return not_(eq(a, b))


def _time(v: Value) -> Column:
    stamp = F.regexp_extract(v.text(), r"^(\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})?)?)$", 1)
    dated = v.col.endswith(f'"^^<{t.XSD}date>') | v.col.endswith(f'"^^<{t.XSD}dateTime>') | v.col.endswith(f'"^^<{t.XSD}dateTimeStamp>')
    return F.when(dated, F.try_to_timestamp(F.nullif(stamp, F.lit(""))))


def _compared(a, b, how: Callable[[Column, Column], Column], op: str) -> Value:
    """Dates by time, numbers by value, anything else as text."""
    a, b = _v(a), _v(b)
    native = _natively_compared(a, b, how, op)
    if native is not None:
        both = a.name and b.name and a.native.is_number and b.native.is_number
        return Value(BOOL, native, sure=True, compared=(op, a.name, b.name) if both else None)
    x, y = a.number(), b.number()
    out = F.when(x.isNotNull() & y.isNotNull(), how(x, y)).otherwise(how(a.text(), b.text()))
    if a.kind == b.kind == TERM:
        p, q = _time(a), _time(b)
        out = F.when(p.isNotNull() & q.isNotNull(), how(p, q)).otherwise(out)
    return _bool(out)


def lt(a, b) -> Value:
    return _compared(a, b, lambda x, y: x < y, "lt")


def gt(a, b) -> Value:
    return _compared(a, b, lambda x, y: x > y, "gt")


def le(a, b) -> Value:
    return _compared(a, b, lambda x, y: x <= y, "le")


def ge(a, b) -> Value:
    return _compared(a, b, lambda x, y: x >= y, "ge")


def add(a, b) -> Value:
    return Value(NUM, _v(a).number() + _v(b).number())


def sub(a, b) -> Value:
    return Value(NUM, _v(a).number() - _v(b).number())


def mul(a, b) -> Value:
    return Value(NUM, _v(a).number() * _v(b).number())


def div(a, b) -> Value:
    """Null where the divisor is 0."""
    return Value(NUM, F.try_divide(_v(a).number(), _v(b).number()))


def minus(a) -> Value:
    return Value(NUM, -_v(a).number())


def plus(a) -> Value:
    return Value(NUM, _v(a).number())


def in_(x, *choices) -> Value:
    found = [eq(x, c) for c in choices]
    return _bool(reduce(lambda a, b: a | b, (f.col for f in found), F.lit(False)), _sure(*found))


def not_in(x, *choices) -> Value:
    return not_(in_(x, *choices))


# Strings


def str_(x) -> Value:
    return Value(STR, _v(x).text())


def strlen(x) -> Value:
    """Code points."""
    return Value(NUM, F.length(_v(x).text()).cast("double"))


def concat(*xs) -> Value:
    return Value(STR, F.concat(*(_v(x).text() for x in xs)))


def substr(x, start, length=None) -> Value:
    """From a 1-based start; bounds before the text are cut off, swapped bounds are swapped back."""
    s, first = _v(x).text(), _v(start).number()
    whole = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))
    size = F.length(s)
    low = F.least(F.greatest(whole(first - 1), F.lit(0)), size)
    high = size if length is None else F.least(F.greatest(whole(first - 1 + _v(length).number()), F.lit(0)), size)
    a, b = F.least(low, high), F.greatest(low, high)
    return Value(STR, F.when(first.isNotNull(), F.substring(s, (a + 1).cast("int"), (b - a).cast("int"))))


def ucase(x) -> Value:
    return Value(STR, F.upper(_v(x).text()))


def lcase(x) -> Value:
    return Value(STR, F.lower(_v(x).text()))


def contains(x, part) -> Value:
    x, part = _v(x), _v(part)
    return _bool(F.contains(x.text(), part.text()), _plain(x, part))


def strstarts(x, part) -> Value:
    x, part = _v(x), _v(part)
    return _bool(F.startswith(x.text(), part.text()), _plain(x, part))


def strends(x, part) -> Value:
    x, part = _v(x), _v(part)
    return _bool(F.endswith(x.text(), part.text()), _plain(x, part))


def strbefore(x, part) -> Value:
    s, p = _v(x).text(), _v(part).text()
    return Value(STR, F.when(F.contains(s, p), F.substring(s, F.lit(1), F.position(p, s) - 1)).otherwise(""))


def strafter(x, part) -> Value:
    s, p = _v(x).text(), _v(part).text()
    return Value(STR, F.when(F.contains(s, p), F.substring(s, F.position(p, s) + F.length(p), F.length(s))).otherwise(""))


def replace(x, pattern: str, by: str) -> Value:
    """Every match of a regular expression; ``$&`` stands for the match."""
    return Value(STR, F.regexp_replace(_v(x).text(), pattern, by.replace("\\", "\\\\").replace("$&", "$0")))


def regex(x, pattern: str, flags: str = "") -> Value:
    """Does the expression match anywhere? Flags i, s and m."""
    kept = "".join(f for f in "ism" if f in flags)
    return _bool(_v(x).text().rlike(f"(?{kept}){pattern}" if kept else pattern))


def encode_for_uri(x) -> Value:
    c = F.url_encode(_v(x).text())
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return Value(STR, c)


# Terms


def lang(x) -> Value:
    x = _v(x)
    return Value(STR, F.coalesce(t.lang(x.col), F.lit("")) if x.kind == TERM else F.lit(""))


def langmatches(tag, choice) -> Value:
    have, want = F.lower(_v(tag).text()), F.lower(_v(choice).text())
    return _bool(F.when(want == "*", have != "").otherwise((have == want) | F.startswith(have, F.concat(want, F.lit("-")))))


def datatype(x) -> Value:
    x = _v(x)
    return Value(TERM, t.iri(t.datatype(x.col)) if x.kind == TERM else F.lit(None).cast("string"))


def iri(x) -> Value:
    return Value(TERM, t.iri(_v(x).text()))


def bnode(x=None) -> Value:
    return Value(TERM, F.concat(F.lit("_:"), F.uuid() if x is None else _v(x).text()))


def strdt(x, kind) -> Value:
    d = _v(kind).text()
    plain = F.concat(F.lit('"'), _v(x).text(), F.lit('"'))
    return Value(TERM, F.when(d == t.XSD + "string", plain).otherwise(F.concat(plain, F.lit("^^<"), d, F.lit(">"))))


def strlang(x, tag) -> Value:
    return Value(TERM, t.literal(_v(x).text(), lang=_v(tag).text()))


def _class_test(x, test: Callable[[Column], Column]) -> Value:
    x = _v(x)
    return _bool(test(x.col) if x.kind == TERM else F.lit(False))


def isiri(x) -> Value:
    return _class_test(x, t.is_iri)


def isblank(x) -> Value:
    return _class_test(x, t.is_blank)


def isliteral(x) -> Value:
    return _class_test(x, t.is_literal)


def isnumeric(x) -> Value:
    x = _v(x)
    return _bool(x.col.isNotNull()) if x.kind == NUM else _class_test(x, _is_numeric)


def sameterm(a, b) -> Value:
    a, b = _v(a), _v(b)
    return _bool(a.col == b.col if a.kind == b.kind == TERM else F.lit(False))


# Numbers


def abs_(x) -> Value:
    return Value(NUM, F.abs(_v(x).number()))


def ceil(x) -> Value:
    return Value(NUM, F.ceil(_v(x).number()).cast("double"))


def floor(x) -> Value:
    return Value(NUM, F.floor(_v(x).number()).cast("double"))


def round_(x) -> Value:
    """Half goes up."""
    return Value(NUM, F.floor(_v(x).number() + 0.5).cast("double"))


def if_(test, yes, no) -> Value:
    yes, no = _v(yes), _v(no)
    if yes.kind == no.kind:
        return Value(yes.kind, F.when(_v(test).truth(), yes.col).otherwise(no.col))
    return Value(TERM, F.when(_v(test).truth(), yes.term()).otherwise(no.term()))


# Time; the session's zone must be UTC


def now(instant: str) -> Value:
    """The run's one instant, an ISO text chosen by the caller."""
    return const(f'"{instant}"^^<{t.XSD}dateTime>')


def _stamp(x) -> Column:
    s = F.regexp_extract(_v(x).text(), r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})?)?)$", 1)
    return F.try_to_timestamp(F.nullif(s, F.lit("")))


def year(x) -> Value:
    return Value(NUM, F.year(_stamp(x)).cast("double"))


def month(x) -> Value:
    return Value(NUM, F.month(_stamp(x)).cast("double"))


def day(x) -> Value:
    return Value(NUM, F.day(_stamp(x)).cast("double"))


def hours(x) -> Value:
    return Value(NUM, F.hour(_stamp(x)).cast("double"))


def minutes(x) -> Value:
    return Value(NUM, F.minute(_stamp(x)).cast("double"))


def seconds(x) -> Value:
    """With milliseconds."""
    return Value(NUM, F.floor(F.unix_micros(_stamp(x)) % 60_000_000 / 1000) / 1000)


def tz(x) -> Value:
    """The zone that ends a date-time, or ''."""
    return Value(STR, F.regexp_extract(_v(x).text(), r"(Z|[+-]\d{2}:\d{2})$", 1))


def timezone(x) -> Value:
    """The zone as an xsd:dayTimeDuration; null without one."""
    z = tz(x).col
    h, m = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    parts = F.concat(F.when(z.startswith("-"), "-").otherwise(""), F.lit("PT"), h, F.lit("H"), m, F.lit("M"))
    text = F.when(z == "", None).when(z == "Z", "PT0S").otherwise(parts)
    return Value(TERM, t.literal(text, t.XSD + "dayTimeDuration"))


def uuid() -> Value:
    return Value(TERM, t.iri(F.concat(F.lit("urn:uuid:"), F.uuid())))


def struuid() -> Value:
    return Value(STR, F.uuid())
