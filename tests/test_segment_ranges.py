"""A segment that holds a wanted rank is not ordered in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelwatch.operators import ordering


@pytest.mark.parametrize("by", [[], ["g"]])
def test_one_large_segment(spark, monkeypatch, by):
    n, seen = 40_000, []
    # Ranges this small would be read by one task.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    totals = ordering.running_totals
    monkeypatch.setattr(ordering, "running_totals", lambda blocks, *a, **k: seen.append(blocks) or totals(blocks, *a, **k))
    df = spark.range(n).select(F.lit(None).cast("string").alias("g"), ((F.col("id") * 7919) % n + 0.5).alias("x"))
    try:
        got = ordering.exact_percentiles(df, "x", {"a": 0.1, "b": 0.5, "c": 0.99}, by, kind="linear", segments=2).collect()
        largest = [b.groupBy(ordering.BLOCK).count().agg(F.max("count")).first()[0] for b in seen]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = np.quantile(np.arange(n) + 0.5, [0.1, 0.5, 0.99])
    assert len(got) == 1 and got[0].n == n and [got[0].a, got[0].b, got[0].c] == pytest.approx(list(want))
    assert largest and max(largest) < n / 3
