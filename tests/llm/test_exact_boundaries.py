from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sonolith.llm import packing


def test_more_lengths_than_cells_are_searched_exactly(spark):
    """66,000 lengths, the short ones with most rows, and one text of 20 million words."""
    tail = spark.range(301, 66_001).select(F.col("id").alias("length"))
    short = spark.range(300 * 400).select((F.col("id") % 300 + 1).alias("length"))
    df = tail.unionByName(short).unionByName(spark.createDataFrame([(20_000_000,)], "length long"))
    lengths = np.concatenate([np.arange(1, 66_001), [20_000_000]])
    counts = np.concatenate([np.full(300, 400), np.ones(65_701, dtype=np.int64)])
    assert packing.length_buckets(df, 4) == packing.optimal_boundaries(lengths, counts, 4)[0]
