"""Dimensions of the judge that are looked up, against those that are worked out."""

import itertools

from pyspark.sql import functions as F

from tessella.operators import ablation


def test_tables_hold_what_the_expressions_give(spark):
    for specs in ablation.JUDGE.values():
        values, steps = ablation._table(specs)
        rows = list(itertools.product(*(range(cap + 1) for _, _, cap in specs)))
        names = [f for f, _, _ in specs]
        d = spark.createDataFrame([tuple(map(float, r)) for r in rows], names).select(*names, ablation.dimension(specs, F.col).alias("x"))
        for r in d.collect():
            at = sum(int(r[f]) * steps[0][ablation.FIELDS.index(f)] for f in names)
            assert values[at] / 100.0 == r["x"]


def test_spines_are_worked_out_by_batches(spark):
    p = spark.range(3).select(F.col("id").alias("persona_id"), *(F.array(F.lit("a"), F.lit(" ")).alias(f) for f in ablation.FIELDS))
    s = ablation.spine(p)
    assert "MapInArrow" in s._jdf.queryExecution().executedPlan().toString()
    assert [r["steps"] for r in s.collect()][0] == len(s.first()["removal_order"])
