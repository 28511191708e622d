r"""Personal data: proposed by regular expressions, confirmed by checksums, scored by context.

Everything is a DataFrame expression. A kind's matches are leftmost and don't
overlap. Their places come from ``split``: the gaps between matches and the matches
themselves, summed in order, give each start in code points. Sums and running states are taken over blocks of matches, and
nothing is cut from the front of a whole text for each match, so the time is nearly in proportion to the text.

Base kinds (email, ip, card, phone) count whatever their score; the added kinds
(iban with mod-97, national id ``ddd-dd-dddd`` with a known-invalid area check) need a score of at least
``MIN_SCORE``. Possessive quantifiers and look-behinds only stop the expression engine from
backtracking or recursing over long runs; they match the same spans as the plain forms.

Null and empty texts have no spans. Repeated rows give repeated results; only
``doc_id`` and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind -> pattern, in the order that breaks ties between equal starts.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:(?:\x20(?![A-Z]{2}[0-9]{2}))?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "nid": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
BASE = ("email", "ip", "card", "phone")
#: A text without this can't hold a match, which spares most texts the expression.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "nid": r"[0-9]-[0-9]"}
#: Words near a span that make its kind likelier, and the reach in code points before it.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mailto|contact|reply)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|payment|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|tel[eé]fono)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)\b",
    "nid": r"(?i)\b(?:ssn|social|security|id|passport)\b",
}
REACH = 48
_BLOCK = 64
#: Code points of the pieces that a text is cut into before its parts are taken.
_PIECE = 4096
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "nid": 0.3}
BONUS = 0.25
MIN_SCORE = 0.5


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does the check digit of a digit string hold?"""
    order = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(order, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int"))),
        F.lit(0),
        lambda a, b: a + F.coalesce(b, F.lit(0)),
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Is the account number, with its first four characters moved last, 1 modulo 97?"""
    bare = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(bare, 5, 100), F.substring(bare, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = F.length(_digits(s))
        return F.when((n >= 14) & (n <= 19), luhn(_digits(s))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(s)).between(10, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(s, " ", "")).between(15, 34), mod97(s)).otherwise(False)
    if kind == "nid":
        return ~s.rlike("^(000|666|9)") & ~s.rlike("-00-|-0000$")
    return F.lit(True)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: within a lambda function an expression is computed anew for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scanned(items: Column, state: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Array of the outputs (of type ``out``) that ``step(state, item)`` gives beside each new state.

    An array that grows by one is copied each time, so the outputs of ``_BLOCK`` items make an array of their own.
    """
    none, nothing = F.expr(f"cast(array() as array<{out}>)"), F.expr(f"cast(array() as array<array<{out}>>)")

    def one(acc: Column, x: Column) -> Column:
        new, made = step(acc["state"], x)
        return F.struct(new.alias("state"), F.array_append(acc["out"], made).alias("out"))

    def block(acc: Column, own: Column) -> Column:
        inner = F.aggregate(own, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return _let(inner, lambda x: F.struct(x["state"].alias("state"), F.array_append(acc["out"], x["out"]).alias("out")))

    def scan(every: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / _BLOCK).cast("int")), lambda i: F.slice(every, i * _BLOCK + 1, _BLOCK))
        return F.aggregate(blocks, F.struct(state.alias("state"), nothing.alias("out")), block, lambda acc: F.flatten(acc["out"]))

    return _let(items, lambda every: F.when(F.size(every) > 0, scan(every)).otherwise(none))


def _found(kind: str, text: Column) -> Column:
    """Array of (start, rank, end, kind, score) of a kind's confirmed spans."""
    pattern, rank = F.lit(PATTERNS[kind]), list(PATTERNS).index(kind)
    matches, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, PATTERNS[kind], -1)
    # The text after the last match has no match of its own.
    both = F.filter(F.arrays_zip(matches.alias("m"), gaps.alias("g")), lambda x: x["m"].isNotNull())

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        start, near = state["at"] + F.length(x["g"]), F.right(F.concat(state["near"], F.right(x["g"], F.lit(REACH))), F.lit(REACH))
        after = F.struct((start + F.length(x["m"])).alias("at"), F.concat(near, x["m"]).alias("near"))
        return after, F.struct(start.alias("start"), x["m"].alias("m"), near.alias("near"))

    placed = _scanned(both, F.struct(F.lit(0).alias("at"), F.lit("").alias("near")), "struct<start:int,m:string,near:string>", step)

    def span(x: Column) -> Column:
        score = F.lit(PRIOR[kind]) + F.when(x["near"].rlike(CONTEXT[kind]), BONUS).otherwise(0.0)
        return F.struct(x["start"].cast("long").alias("start"), F.lit(rank).alias("rank"), (x["start"] + F.length(x["m"])).cast("long").alias("stop"), F.lit(kind).alias("kind"), F.least(score, F.lit(1.0)).alias("score"))

    spans = F.transform(F.filter(placed, lambda x: _valid(kind, x["m"])), span)
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= MIN_SCORE)
    return F.when(text.rlike(NEEDS[kind]), spans).otherwise(F.expr("cast(array() as array<struct<start:bigint,rank:int,stop:bigint,kind:string,score:double>>)"))


def with_spans(docs: DataFrame, text: str = "text", to: str = "pii") -> DataFrame:
    """Add ``to``: all confirmed spans, ordered by start and then kind."""
    clean = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kinds = [_found(kind, clean) for kind in PATTERNS]
    return docs.withColumn(to, F.array_sort(F.concat(*kinds)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def pii_spans(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the digest of the base spans, all spans and their scores."""
    found = with_spans(docs.select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["rank"] < len(BASE))
    counts = [F.size(F.filter("pii", _is(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


def redacted(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The same rows and columns with every span replaced by its kind, as ``<EMAIL>``.

    Where spans overlap, the earlier one is replaced and the rest of the later one too.
    A null text stays null; ``n_chars`` follows the text where that column exists.
    """
    mark, cut = "_grafthorn_pii", "_grafthorn_pieces"
    t = F.col(f"`{text}`")
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length(t) / _PIECE).cast("int")), lambda i: F.substring(t, i * _PIECE + 1, F.lit(_PIECE)))

    def part(start: Column, stop: Column) -> Column:
        """The text between two places, from the pieces that hold it."""
        p, q = F.floor(start / _PIECE).cast("int"), F.floor(stop / _PIECE).cast("int")
        at, to = (start - p * _PIECE).cast("int"), (stop - q * _PIECE).cast("int")
        first, last = F.get(F.col(cut), p), F.get(F.col(cut), q)
        between = F.when(q > p + 1, F.array_join(F.slice(F.col(cut), p + 2, q - p - 1), "")).otherwise("")
        return F.when(p == q, F.substring(first, at + 1, to - at)).otherwise(F.concat(F.substring(first, at + 1, F.lit(_PIECE)), between, F.substring(last, F.lit(1), to)))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        return F.greatest(at, s["stop"]), F.struct(at.alias("at"), s["start"].alias("start"), s["kind"].alias("kind"))

    placed = _scanned(F.col(mark), F.lit(0).cast("long"), "struct<at:bigint,start:bigint,kind:string>", step)
    outside = F.filter(placed, lambda x: x["start"] >= x["at"])
    body = F.array_join(F.transform(outside, lambda x: F.concat(part(x["at"], x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))), "")
    whole = F.concat(body, part(F.array_max(F.transform(F.col(mark), lambda s: s["stop"])), F.length(t).cast("long")))
    out = with_spans(docs, text, mark).withColumn(cut, F.when(F.size(mark) > 0, pieces))
    out = out.withColumn(text, F.when(F.size(mark) == 0, t).otherwise(whole)).drop(mark, cut)
    return out.withColumn(n_chars, F.length(t).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else out
