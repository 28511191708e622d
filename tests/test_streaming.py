"""A stream of triples gives the closure of all that arrived."""

import pytest

from grafthorn.operators.patterns import Not
from grafthorn.operators.rules import Rule, data, infer, transitive
from grafthorn.streaming.incremental import infer_stream


def test_stream_equals_batch(spark, tmp_path):
    chain = [(f"<n{i}>", "<p>", f"<n{i + 1}>") for i in (0, 4, 2, 1, 3)]
    source, graph = str(tmp_path / "in"), str(tmp_path / "graph")
    stream = spark.readStream.schema("s string, p string, o string").option("maxFilesPerTrigger", 1)
    for n, part in enumerate((chain[:2], chain[2:4], chain[4:])):
        data(spark, part).coalesce(1).write.mode("append").parquet(source)
        query = infer_stream(stream.parquet(source), transitive("<p>"), graph).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert n >= 0
    rows = spark.read.parquet(graph).collect()
    want = {(r.s, r.p, r.o) for r in infer(data(spark, chain), transitive("<p>")).collect()}
    assert {(r.s, r.p, r.o) for r in rows if r.inferred} == want
    assert len(rows) == len(want) + len(chain)


def test_negation_is_refused(spark):
    with pytest.raises(ValueError):
        infer_stream(spark.readStream.format("rate").load(), [Rule([("?x", "<q>", "?y")], [("?x", "<p>", "?y"), Not(("?x", "<r>", "?y"))])], "x")
