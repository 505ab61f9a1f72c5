"""The session dimension, emitters and their roles, columns that models take, and inputs built of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Features whose derivatives mean nothing; angles and marks of a directed pair.
NO_DERIVATIVES, OTHER_ANGLES, TAIL = ("speed", "acceleration"), ("allo_yaw", "allo_pitch"), "TTI"


def identities(tracks: DataFrame, session: str, order: str, name: str, strict: bool = False) -> DataFrame:
    """(session, male, female, n_tracks): the first and the second track of each session.

    A session with one track has no female; if ``strict`` reading it fails.
    """
    names = F.transform(F.sort_array(F.collect_list(F.struct(order, name))), lambda t: t[name])
    out = tracks.groupBy(session).agg(names.alias("names")).select(session, F.get("names", F.lit(0)).alias("male"), F.get("names", F.lit(1)).alias("female"), F.size("names").cast("long").alias("n_tracks"))
    if strict:
        out = out.withColumn("female", F.when(F.col("n_tracks") < 2, F.raise_error(F.concat(F.lit("one track only: "), F.col(session).cast("string")))).otherwise(F.col("female")))
    return out


def scan_listed(listed: DataFrame, found: DataFrame, session: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``found`` whose session is listed, and the listed sessions without any."""
    return found.join(listed.select(session), session, "left_semi"), listed.join(found.select(session).distinct(), session, "left_anti")


def roles(male: Column, female: Column, predictor: Column) -> tuple[Column, Column]:
    """Names of the target and the predictor; ``predictor`` is 0 for the male, 1 for the female."""
    names = F.array(male, female)
    return F.get(names, F.abs(predictor - 1)), F.get(names, predictor)


def kinematic_columns(columns: list[str], target: str, predictor: str, predictor_idx: int, egocentric: list[str], pose: list[str], engagement: list[str], symmetric: bool, first: bool, second: bool) -> list[str]:
    """Columns of a session that a model takes, in order of name.

    Own features of both animals; features of the pair by suffix, one of two mirrored halves unless
    ``symmetric``: the predictor's angles to the other go, its distance from the tail stays;
    engagement only of the target with the predictor. Derivatives go along where they exist.
    """
    have, kept = set(columns), set()

    def keep(column: str, feature: str) -> None:
        kept.add(column)
        for wanted, suffix in ((first, "_1st_der"), (second, "_2nd_der")):
            if wanted and feature not in NO_DERIVATIVES and column + suffix in have:
                kept.add(column + suffix)

    def mirrored(feature: str) -> bool:
        parts = feature.split("-")
        if symmetric or len(parts) != 2:
            return False
        own, other = parts if predictor_idx == 0 else parts[::-1]
        return own in OTHER_ANGLES or other == TAIL

    for feature in egocentric:
        for animal in (target, predictor):
            if f"{animal}.{feature}" in have:
                keep(f"{animal}.{feature}", feature)
    for c in columns:
        owner, feature = c.split(".")[0], c.split(".")[-1]
        if feature in pose and not mirrored(feature):
            keep(c, feature)
        if feature in engagement and owner == f"{target}-{predictor}":
            keep(c, feature)
    return sorted(kept)


def vocal_columns(traces: DataFrame, target: str, predictor: str, partner_only: bool, own_excluded: tuple[str, ...] = ("usv_rate", "usv_event")) -> DataFrame:
    """Rows of ``traces`` (emitter, signal, ...) that a model takes, with the column's name: the partner's, and the target's without its own rate."""
    own = F.lit(not partner_only) & (F.col("emitter") == target) & ~F.col("signal").isin(*own_excluded)
    return traces.where((F.col("emitter") == predictor) | own).withColumn("column", F.concat_ws(".", "emitter", "signal"))


def categories_by_emitter(calls: DataFrame, keys: tuple[str, ...], noise: tuple[str, ...], history: float, target: str) -> DataFrame:
    """For each emitter its starts in order: of the target category, of all others, and by category as a map.

    Noise goes, and what starts within ``history`` of the session's beginning. Emitters without calls have no row.
    """
    own = calls.where(~F.col("category").isin(*noise) & (F.col("start") > history))
    starts = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("start"))))
    by = own.groupBy(*keys, "category").agg(F.sort_array(F.collect_list("start")).alias("starts"), starts(F.col("category") == target).alias("t"), starts(F.col("category") != target).alias("o"))
    return by.groupBy(*keys).agg(
        F.sort_array(F.flatten(F.collect_list("t"))).alias("target_events"), F.sort_array(F.flatten(F.collect_list("o"))).alias("other_events"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "starts")))).alias("by_category"),
    )


def bounded_share(share: float, n: Column, least: int = 1) -> Column:
    """``share``, or more where it would leave fewer than ``least`` of n."""
    return F.when(n > 0, F.greatest(F.lit(share), F.lit(float(least)) / n)).otherwise(F.lit(share))


def feature_label(key: Column, labels: dict[str, str], own: str | None, other: str | None) -> Column:
    """The display label of a feature key; the key itself where there is none.

    ``self.`` and ``other.`` put the animal's word in front, ``{self}`` and ``{other}`` inside a label are filled in, derivatives are named behind.
    """
    own, other = own or "self", other or "other"
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    bare = F.regexp_replace(key, "_(1st|2nd)_der$", "")
    behind = F.when(key.endswith("_1st_der"), " (1st derivative)").when(key.endswith("_2nd_der"), " (2nd derivative)").otherwise("")
    front = F.when(bare.startswith("self."), own + " ").when(bare.startswith("other."), other + " ").otherwise("")
    label = F.get(F.array(F.element_at(table, F.regexp_replace(bare, r"^(self|other)\.", ""))), F.lit(0))
    filled = F.replace(F.replace(label, F.lit("{self}"), F.lit(own)), F.lit("{other}"), F.lit(other))
    return F.coalesce(F.concat(front, filled, behind), key)


def assigned(events: DataFrame, assignments: DataFrame, row: str, names: dict[int, str]) -> DataFrame:
    """Events with the emitter that the assignment in their row tells; null where it tells none."""
    emitter = F.lit(None).cast("string")
    for value, name in names.items():
        emitter = F.when(F.col("assignment") == value, name).otherwise(emitter)
    return events.join(assignments, row, "left").withColumn("emitter", emitter).drop("assignment")


def history_inputs(traces: DataFrame, anchors: DataFrame, keys: tuple[str, ...], steps: int) -> DataFrame:
    """(anchor's columns, feature, history): of each feature the ``steps`` values before an anchor's frame, of anchors whose history is whole.

    ``traces``: keys, frame, feature, value, one row a frame; ``anchors``: keys, frame and any more.
    """
    w = Window.partitionBy(*keys, "feature").orderBy("frame").rowsBetween(-steps, -1)
    h = traces.select(*keys, "frame", "feature", F.collect_list("value").over(w).alias("history")).where(F.size("history") == steps)
    return anchors.join(h, [*keys, "frame"])


def pooled_scores(traces: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Values of each feature over all sessions as z-scores (deviation of the whole); constant features become 0."""
    m = traces.groupBy(feature).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return traces.join(F.broadcast(m), feature).withColumn(value, F.when(F.col("__s") > 0, (F.col(value) - F.col("__m")) / F.col("__s")).otherwise(0.0)).drop("__m", "__s")  # a row a feature


def balanced(rows: DataFrame, label: str, order: list, by: tuple[str, ...] = ()) -> DataFrame:
    """As many rows of each label as the rarest has, those first in ``order``."""
    n = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("__n")).groupBy(*by).agg(F.min("__n").alias("__least")) if by else rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).agg(F.min("__n").alias("__least"))
    placed = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*by, label).orderBy(*order)))
    joined = placed.join(n, list(by)) if by else placed.join(F.broadcast(n))  # one row
    return joined.where(F.col("__nth") <= F.col("__least")).drop("__nth", "__least")


def grid_draws(points: DataFrame, row: str, x: str, y: str, grid: int, base: int, alpha: float, seed: int) -> DataFrame:
    """(row, draw): rows drawn with replacement, so many of each cell of a grid: ceil(base * (n / base)^alpha), one at least.

    A cell's draws are places in its rows, told by a seeded hash of cell and draw.
    """
    ends = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    cell = lambda v, low, high: F.least(F.floor((v - low) / ((high - low) / (grid - 1))) + 1, F.lit(grid))
    placed = points.join(F.broadcast(ends)).withColumns({"cx": cell(F.col(x), F.col("x0"), F.col("x1")), "cy": cell(F.col(y), F.col("y0"), F.col("y1"))})  # one row
    nth = placed.withColumn("nth", F.row_number().over(Window.partitionBy("cx", "cy").orderBy(row)) - 1).select(row, "cx", "cy", "nth")
    n = nth.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    draws = F.greatest(F.lit(1), F.ceil(F.lit(float(base)) * F.pow(F.col("n") / F.lit(float(base)), F.lit(alpha)) - 1e-9)).cast("long")
    drawn = n.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), draws - 1)))
    at = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "cx", "cy", "draw")), 1, 8), 16, 10).cast("long") % F.col("n")
    return drawn.withColumn("nth", at).join(nth, ["cx", "cy", "nth"]).select(row, "draw")


def masked(values: Column, key: Column, seed: int, share: float, length: int, size: int) -> Column:
    """An array with a stretch of zeros, or as it is: which, and where it begins, a seeded hash of the key tells."""
    word = lambda part: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}"), F.lit(part), key.cast("string"))), 1, 8), 16, 10).cast("long")
    begin = word("begin") % max(1, size - length)
    return F.when(word("mask") / F.lit(float(1 << 32)) < share, F.transform(values, lambda v, i: F.when((i >= begin) & (i < begin + length), F.lit(0.0)).otherwise(v))).otherwise(values)


def warped(values: Column, factor: Column, size: int) -> Column:
    """An array stretched in time about its middle, by linear interpolation; beyond the ends the end values."""
    middle = (size - 1) / 2

    def at(i: Column) -> Column:
        q = F.greatest(F.lit(0.0), F.least(F.lit(size - 1.0), F.lit(middle) + (i - F.lit(middle)) * factor))
        low = F.floor(q)
        part = q - low
        return F.get(values, low.cast("int")) * (1 - part) + F.get(values, F.least(low + 1, F.lit(size - 1)).cast("int")) * part

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)


def strata_by_centres(points: DataFrame, row: str, x: str, y: str, k: int, rounds: int) -> DataFrame:
    """(row, stratum): Lloyd's method from the k rows with the least keys, ties to the lesser stratum.

    Each round is one aggregation over all rows against k centres.
    """
    centres = points.orderBy(row).limit(k).select((F.row_number().over(Window.orderBy(row)) - 1).alias("stratum"), F.col(x).alias("cx"), F.col(y).alias("cy"))
    for step in range(rounds + 1):
        packed = centres.agg(F.sort_array(F.collect_list(F.struct("stratum", "cx", "cy"))).alias("cs"))  # k centres
        far = F.transform("cs", lambda c: F.struct(F.round((F.col(x) - c["cx"]) ** 2 + (F.col(y) - c["cy"]) ** 2, 9).alias("d"), c["stratum"].alias("stratum")))
        placed = points.join(F.broadcast(packed)).withColumn("stratum", F.array_min(far)["stratum"]).drop("cs")
        if step < rounds:
            centres = placed.groupBy("stratum").agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"))
    return placed.select(row, "stratum")
