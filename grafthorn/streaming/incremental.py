"""Inference over a stream of triples: each micro-batch is the delta of a fixed point that goes on.

Only rules without NOT, SET and blank nodes in heads qualify: what they derived stays derived as triples arrive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from grafthorn.operators.patterns import Not
from grafthorn.operators.rules import MAX_PASSES, Rule, fired
from grafthorn.plans.strata import runs_once
from grafthorn.sources.shared import written

SCHEMA = "s string, p string, o string, inferred boolean, batch long"


def infer_stream(stream: DataFrame, rules: Sequence[Rule], path: str, max_passes: int = MAX_PASSES) -> DataStreamWriter:
    """A writer that keeps the growing graph at ``path``: (s, p, o, inferred) in a folder per batch.

    A batch that is run again after a failure overwrites its own folder, so results are exactly once.
    """
    if any(isinstance(e, Not) for r in rules for e in r.body) or any(runs_once(r) for r in rules):
        raise ValueError("only rules without NOT, SET and blank nodes in the head can follow a stream")
    numbered = list(enumerate(rules))

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = spark.read.schema(SCHEMA).option("basePath", path)
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        exists = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)
        known = earlier.parquet(path).where(F.col("batch") < number).select("s", "p", "o") if exists else batch.select("s", "p", "o").where(F.lit(False))
        delta = written(batch.select("s", "p", "o").distinct().join(known, ["s", "p", "o"], "left_anti"))
        out = [delta.withColumn("inferred", F.lit(False))]
        for _ in range(max_passes):
            if delta.isEmpty():
                break
            known = known.unionByName(delta)
            made = fired(numbered, known, delta, None)
            delta = written(made.select("s", "p", "o").join(known, ["s", "p", "o"], "left_anti"))
            out.append(delta.withColumn("inferred", F.lit(True)))
        every = out[0]
        for more in out[1:]:
            every = every.unionByName(more)
        every.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(step)
