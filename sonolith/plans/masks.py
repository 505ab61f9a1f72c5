"""Queries for masks and boxes over spectrograms, and for examples along a spiral."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith import adapters as A
from sonolith.functions import masks as M
from sonolith.functions import numeric as N
from sonolith.operators import kernels as K
from sonolith.plans.registry import query


def _waves(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "embeddings").where("size(embedding) >= 64").select("vec_id", "embedding")


@query("SELECT vec_id, CAST(8 * greatest(1, ceil(16 * least((vec_id % 20) / 15.0, 1))) AS BIGINT) AS n_on FROM embeddings")
def time_window_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of the window mask of each event, as expressions."""
    n = F.greatest(F.ceil(F.lit(16) * F.least((F.col("vec_id") % 20) / F.lit(15.0), F.lit(1.0))), F.lit(1))
    return A.table(spark, sf, "embeddings").select("vec_id", (n * 8).cast("long").alias("n_on"))


@query()
def detected_boxes(spark: SparkSession, sf: str) -> DataFrame:
    def run(batches):
        for p in batches:
            rows = []
            for i, w in zip(p["vec_id"], p["embedding"], strict=True):
                rows += [(i, *b) for b in M.boxes(N.spectrum(np.asarray(w, float), 16, 2), 0.7, 1.5, 3)]
            yield pd.DataFrame(rows, columns=["vec_id", "t0", "t1", "f0", "f1"])

    return _waves(spark, sf).mapInPandas(run, "vec_id long, t0 int, t1 int, f0 int, f1 int")


@query()
def masked_features(spark: SparkSession, sf: str) -> DataFrame:
    """Spectral moments inside the union of an event's merged masks, and the share of energy its masked wave keeps."""

    def run(batches):
        freqs = np.fft.rfftfreq(16, 1 / 250000)
        for p in batches:
            rows = []
            for i, w in zip(p["vec_id"], p["embedding"], strict=True):
                w = np.asarray(w, float)
                s = N.spectrum(w, 16, 2)
                window = M.time_window(0.8, 1.0, *s.shape)
                parts = [s > np.percentile(s, q) for q in (80, 90)]
                mask = M.union(M.merge_instances(parts, 0.4, 0.8), window)
                kept = M.masked_waveform(w, mask, 16, 2)
                m = N.spectral_moments(s, freqs, mask)
                rows.append((i, int(mask.sum()), m["mean_freq"], m["bandwidth"], float((kept**2).sum() / max((w**2).sum(), 1e-12))))
            yield pd.DataFrame(rows, columns=["vec_id", "n_cells", "mean_freq", "bandwidth", "kept"])

    return _waves(spark, sf).mapInPandas(run, "vec_id long, n_cells int, mean_freq double, bandwidth double, kept double")


_STEP = "(x - cx - far * sqrt((s.k + 1.5) / 9) * cos(6 * pi() * sqrt((s.k + 1.5) / 9))) ** 2 + (y - cy - far * sqrt((s.k + 1.5) / 9) * sin(6 * pi() * sqrt((s.k + 1.5) / 9))) ** 2"


@query(A.with_sql("points").replace("WITH ", "WITH RECURSIVE ", 1) + f""", m AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM points GROUP BY label),
    c AS (SELECT label, any_value(cx) AS cx, any_value(cy) AS cy, max(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS far FROM points JOIN m USING (label) GROUP BY label),
    s AS (SELECT label, -1 AS k, NULL::BIGINT AS vec_id, []::BIGINT[] AS used FROM c UNION ALL
          SELECT s.label, s.k + 1, arg_min(p.vec_id, ({_STEP}, p.vec_id)), list_append(any_value(s.used), arg_min(p.vec_id, ({_STEP}, p.vec_id)))
          FROM s JOIN c ON c.label = s.label JOIN points p ON p.label = s.label WHERE s.k < 8 AND NOT list_contains(s.used, p.vec_id) GROUP BY s.label, s.k)
    SELECT label, CAST(k AS INTEGER) AS place, vec_id FROM s WHERE k >= 0""")
def spiral_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Nine examples of each category along a spiral from its centre."""

    def work(p):
        p = p.sort_values("vec_id")
        xy = p[["x", "y"]].to_numpy(float)
        return [(k, int(p["vec_id"].iloc[i])) for k, i in enumerate(M.spiral_order(xy, xy.mean(axis=0), 3.0, 9))]

    return K.per_group(A.points(spark, sf), ["label"], work, "place int, vec_id long")
