"""Terms as 64-bit numbers, for passes that only compare terms.

A term's number is a hash of it, so a table is numbered without a join. A dictionary, made by one aggregation over the terms and kept for the
passes, gives the terms back. Two terms with one number show when the dictionary is made; then there is none, and the passes keep printed terms.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafthorn.sources.shared import written


def number(term: Column) -> Column:
    """A term's number; null stays null."""
    return F.when(term.isNotNull(), F.xxhash64(term))


def constant(term: str) -> Column:
    """The number of a constant term, which the optimizer folds to a literal."""
    return number(F.lit(term))


def numbered(triples: DataFrame) -> DataFrame:
    return triples.select(*(number(F.col(c)).alias(c) for c in "spo"))


def is_numbered(triples: DataFrame) -> bool:
    return triples.schema["s"].dataType.typeName() == "long"


def dictionary(triples: DataFrame, constants: Iterable[str]) -> DataFrame | None:
    """(id, term) of all subjects, objects and constants, written to the shared folder; None where two terms have one number."""
    terms = triples.select(F.explode(F.array("s", "o")).alias("term"))
    fixed = sorted(set(constants))
    if fixed:
        terms = terms.union(triples.sparkSession.createDataFrame([(x,) for x in fixed], "term string"))
    least, most = F.min("term"), F.max("term")
    book = written(terms.where("term is not null").groupBy(number(F.col("term")).alias("id")).agg(least.alias("term"), (least != most).alias("clash")))
    return book.drop("clash") if book.where("clash").isEmpty() else None


def printed(rows: DataFrame, book: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """Numbered triples, with their other columns, as printed ones; ``predicates`` are all that may occur."""
    name = F.create_map(*(x for p in predicates for x in (F.xxhash64(F.lit(p)), F.lit(p))))
    subjects, objects = (book.select(F.col("id").alias(c), F.col("term").alias(f"{c}_term")) for c in "so")
    rest = [c for c in rows.columns if c not in ("s", "p", "o")]
    return rows.join(subjects, "s").join(objects, "o").select(F.col("s_term").alias("s"), name[F.col("p")].alias("p"), F.col("o_term").alias("o"), *rest)
