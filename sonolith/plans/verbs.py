"""Queries for the table verbs, readers' filters and scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonolith import adapters as A
from sonolith.functions import scalars as S
from sonolith.functions import strings as T
from sonolith.operators import normalise as N
from sonolith.operators import relational as R
from sonolith.plans.registry import query

EV, CALLS, FRAMES, UNITS, POINTS, TURNS = (A.with_sql(x) for x in ("events_m", "calls", "frames", "units", "points", "turns"))


def r6(x, n: int = 6):
    return F.round(F.col(x) if isinstance(x, str) else x, n)


_CAT = "CASE WHEN event_id % 9 = 0 THEN NULL ELSE category END"


@query(EV + f" SELECT event_id, session_id, CAST(floor(start * 150) AS BIGINT) AS frame_index, {_CAT} AS category FROM events_m WHERE coalesce(NOT ({_CAT} IN ('error')), true)")
def load_and_filter_events(spark: SparkSession, sf: str) -> DataFrame:
    """Without noise; events without a label stay."""
    e = A.events(spark, sf).withColumn("category", F.when(F.col("event_id") % 9 != 0, F.col("category")))
    return e.where(S.keep_unless(F.col("category").isin(*A.NOISE))).select("event_id", "session_id", F.floor(F.col("start") * A.FPS).cast("long").alias("frame_index"), "category")


@query(EV + f" SELECT event_id, session_id FROM events_m WHERE NOT ({_CAT} IN ('error'))")
def filter_drops_unlabelled(spark: SparkSession, sf: str) -> DataFrame:
    """Without noise; events without a label go as well."""
    e = A.events(spark, sf).withColumn("category", F.when(F.col("event_id") % 9 != 0, F.col("category")))
    return e.where(~F.col("category").isin(*A.NOISE)).select("event_id", "session_id")


@query(CALLS + """, n AS (SELECT session_id, count(*) FILTER (category = 'error') AS n_noise, count(*) AS n_all FROM events_m GROUP BY ALL)
    SELECT n.session_id, strftime(n.session_id, '%Y%m%d') AS day_label, n.n_noise, n.n_all, count(c.event_id) FILTER (c.sex = 'male') AS male, count(c.event_id) FILTER (c.sex = 'female') AS female,
           count(c.event_id) FILTER (c.sex = 'unassigned') AS unassigned FROM n LEFT JOIN calls c USING (session_id) GROUP BY ALL""")
def session_assignment_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = A.events(spark, sf)
    ok = ~F.col("category").isin(*A.NOISE)
    return e.groupBy("session_id").agg(
        F.count_if(~ok).alias("n_noise"), F.count(F.lit(1)).alias("n_all"), *[F.count_if(ok & (F.col("sex") == s)).alias(s) for s in ("male", "female", "unassigned")]
    ).withColumn("day_label", F.date_format("session_id", "yyyyMMdd"))


@query("WITH c AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type = 'signup' AND hour(ts) < 1 GROUP BY ALL), s AS (SELECT DISTINCT CAST(ts AS DATE) AS session_id FROM events) SELECT session_id, coalesce(n, 0) AS n FROM s LEFT JOIN c ON d = session_id")
def counts_of_listed_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of the list without events count 0."""
    ev = A.table(spark, sf, "events").withColumn("session_id", F.to_date("ts"))
    n = ev.where((F.col("event_type") == "signup") & (F.hour("ts") < 1)).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return ev.select("session_id").distinct().join(n, "session_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


_BEH = "f AS (SELECT session_id AS s, frame_index, distance, yaw, CAST(speed AS DOUBLE) AS speed FROM frames)"


def _merge_sql(kind: str) -> str:
    return CALLS + "," + A.SQL["frames"] + f", {_BEH}, e AS (SELECT event_id, CAST(day(session_id) - 1 AS BIGINT) AS s, CAST(floor(start / 40) AS BIGINT) AS frame_index, category FROM calls) SELECT event_id, e.s, e.frame_index, category, round(distance, 6) AS distance, round(yaw, 6) AS yaw FROM e {kind} JOIN f ON e.s = f.s AND e.frame_index = f.frame_index"


def _merge(spark: SparkSession, sf: str, how: str) -> DataFrame:
    e = A.calls(spark, sf).select("event_id", (F.dayofmonth("session_id") - 1).cast("long").alias("s"), F.floor(F.col("start") / 40).cast("long").alias("frame_index"), "category")
    f = A.frames(spark, sf).select(F.col("session_id").alias("s"), "frame_index", "distance", "yaw")
    return e.join(f, ["s", "frame_index"], how).withColumns({"distance": r6("distance"), "yaw": r6("yaw")})


@query(_merge_sql("INNER"))
def merge_events_and_features(spark: SparkSession, sf: str) -> DataFrame:
    return _merge(spark, sf, "inner")


@query(_merge_sql("LEFT"))
def merge_features_into_events(spark: SparkSession, sf: str) -> DataFrame:
    return _merge(spark, sf, "left")


@query("SELECT c.c_custkey, c.c_mktsegment FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def semi_join_active(spark: SparkSession, sf: str) -> DataFrame:
    o = A.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return A.table(spark, sf, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT c.c_custkey, c.c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def anti_join_empty(spark: SparkSession, sf: str) -> DataFrame:
    o = A.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return A.table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT l_partkey AS unit_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def units_in_all_sessions(spark: SparkSession, sf: str) -> DataFrame:
    li = A.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("unit_id"), "l_returnflag")
    n = li.select(F.count_distinct("l_returnflag").alias("n"))
    return li.groupBy("unit_id").agg(F.count_distinct("l_returnflag").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("unit_id")  # one row


@query("SELECT 'supplier' AS source, s_suppkey AS id, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT 'customer', c_custkey, c_acctbal, c_mktsegment FROM customer")
def diagonal_concat(spark: SparkSession, sf: str) -> DataFrame:
    s = A.table(spark, sf, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    c = A.table(spark, sf, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return R.stack(s, c)


@query("SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region")
def union_of_sets(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).union(A.table(spark, sf, "region").select("r_regionkey")).distinct()


@query("""SELECT p_partkey, p_brand, p_size, 'old' AS version FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2') UNION ALL SELECT p_partkey, p_brand, p_size + 100, 'new' FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')""")
def catalog_replace_slice(spark: SparkSession, sf: str) -> DataFrame:
    p = A.table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", F.lit("old").alias("version"))
    new = p.where(F.col("p_brand").isin("Brand#1", "Brand#2")).withColumns({"p_size": F.col("p_size") + 100, "version": F.lit("new")})
    return R.replace_slice(R.replace_slice(p, new, ["p_brand"]), new, ["p_brand"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def last_duplicate_wins(spark: SparkSession, sf: str) -> DataFrame:
    return R.last_of(A.table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""WITH l AS (SELECT CAST(o_orderkey % 3 AS BIGINT) AS list_no, o_orderkey AS line_no, 'S' || (o_custkey % 200) AS session FROM orders)
    SELECT session, list_no AS source_list FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY list_no, line_no) AS r FROM l) WHERE r = 1""")
def first_list_of_session(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions named in several lists belong to the first."""
    o = A.table(spark, sf, "orders").select((F.col("o_orderkey") % 3).alias("list_no"), F.col("o_orderkey").alias("line_no"), F.concat(F.lit("S"), (F.col("o_custkey") % 200).cast("string")).alias("session"))
    return o.groupBy("session").agg(F.min(F.struct("list_no", "line_no")).alias("f")).select("session", F.col("f.list_no").alias("source_list"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(min(l_quantity), 6) AS lo, round(sum(l_quantity), 4) AS total, round(median(l_extendedprice), 6) AS mid,
    count(*) FILTER (l_discount > 0.05) AS n_high FROM lineitem GROUP BY ALL""")
def group_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), r6(F.min("l_quantity")).alias("lo"), F.round(F.sum("l_quantity"), 4).alias("total"), r6(F.median("l_extendedprice")).alias("mid"), F.count_if(F.col("l_discount") > 0.05).alias("n_high")
    )


@query("SELECT l_linenumber > 3 AS a, l_discount > 0.05 AS b, l_tax > 0.04 AS c, count(*) AS n FROM lineitem GROUP BY ALL")
def three_set_tally(spark: SparkSession, sf: str) -> DataFrame:
    from sonolith.operators.triage import set_overlap

    li = A.table(spark, sf, "lineitem").select((F.col("l_linenumber") > 3).alias("a"), (F.col("l_discount") > 0.05).alias("b"), (F.col("l_tax") > 0.04).alias("c"))
    return set_overlap(li, ["a", "b", "c"])


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS total, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


@query(CALLS + " SELECT session_id, count(*) FILTER (category = 'click') AS click, count(*) FILTER (category = 'view') AS \"view\", count(*) FILTER (category = 'purchase') AS purchase, count(*) FILTER (category = 'signup') AS signup FROM calls GROUP BY session_id")
def pivot_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.calls(spark, sf).groupBy("session_id").pivot("category", ["click", "view", "purchase", "signup"]).agg(F.count(F.lit(1))).na.fill(0)


@query(CALLS + """, c AS (SELECT session_id, count(*) FILTER (sex = 'male') AS male, count(*) FILTER (sex = 'female') AS female FROM calls GROUP BY session_id)
    SELECT session_id, 'male' AS category, male AS n FROM c UNION ALL SELECT session_id, 'female', female FROM c""")
def unpivot_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = A.calls(spark, sf).groupBy("session_id").agg(*[F.count_if(F.col("sex") == s).alias(s) for s in ("male", "female")])
    return c.unpivot(["session_id"], ["male", "female"], "category", "n")


_BIN = CALLS + ", b AS (SELECT session_id, sex, least(CAST(floor(start / 3600) AS BIGINT), 11) AS bin FROM calls WHERE sex <> 'unassigned'), c AS (SELECT session_id, sex, bin, count(*) AS n FROM b GROUP BY ALL)"


@query(_BIN + """, g AS (SELECT * FROM (SELECT DISTINCT session_id FROM b), (SELECT DISTINCT sex FROM b), (SELECT CAST(range AS BIGINT) AS bin FROM range(12))),
    p AS (SELECT sex, bin, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (session_id, sex, bin))
    SELECT sex, bin, round(avg(n), 6) AS mean_n, round(stddev_samp(n) / sqrt(count(*)), 6) AS sem FROM p GROUP BY ALL""")
def dense_grid_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and error of counts by bin, with 0 where a session has none."""
    b = A.calls(spark, sf).where("sex <> 'unassigned'").select("session_id", "sex", F.least(F.floor(F.col("start") / 3600), F.lit(11)).alias("bin"))
    c = b.groupBy("session_id", "sex", "bin").agg(F.count(F.lit(1)).alias("n"))
    g = R.dense_grid(c, [b.select("session_id"), b.select("sex"), spark.range(12).withColumnRenamed("id", "bin")], "n")
    return R.mean_sem(g, ["sex", "bin"], "n").select("sex", "bin", r6("mean").alias("mean_n"), r6("sem").alias("sem"))


@query(_BIN + " SELECT sex, bin, round(avg(n), 6) AS mean_n FROM c GROUP BY ALL")
def present_rows_trend(spark: SparkSession, sf: str) -> DataFrame:
    """The same means over the sessions that have any."""
    b = A.calls(spark, sf).where("sex <> 'unassigned'").select("session_id", "sex", F.least(F.floor(F.col("start") / 3600), F.lit(11)).alias("bin"))
    return b.groupBy("session_id", "sex", "bin").agg(F.count(F.lit(1)).alias("n")).groupBy("sex", "bin").agg(r6(F.avg("n")).alias("mean_n"))


@query("SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 8) AS share FROM events GROUP BY ALL")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.join(F.broadcast(e.agg(F.sum("n").alias("t")))).select("event_type", "n", F.round(F.col("n") / F.col("t"), 8).alias("share"))  # one row


@query(EV + " SELECT session_id, round(quantile_cont(duration, 0.06), 6) AS p06, round(quantile_cont(duration, 0.5), 6) AS p50, round(quantile_cont(duration, 0.94), 6) AS p94 FROM events_m GROUP BY session_id")
def linear_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    p = F.percentile("duration", F.array(F.lit(0.06), F.lit(0.5), F.lit(0.94)))
    return A.events(spark, sf).groupBy("session_id").agg(p.alias("p")).select("session_id", *[r6(F.col("p")[i]).alias(n) for i, n in enumerate(("p06", "p50", "p94"))])


@query(EV + """ SELECT event_id, round(sum(duration) OVER w, 4) AS running, round(duration - lag(duration) OVER (PARTITION BY session_id ORDER BY row_idx), 6) AS step, round(max(stop) OVER w, 6) AS latest
    FROM events_m WINDOW w AS (PARTITION BY session_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING)""")
def ordered_scans(spark: SparkSession, sf: str) -> DataFrame:
    o = Window.partitionBy("session_id").orderBy("row_idx")
    w = o.rowsBetween(Window.unboundedPreceding, 0)
    return A.events(spark, sf).select("event_id", F.round(F.sum("duration").over(w), 4).alias("running"), r6(F.col("duration") - F.lag("duration").over(o)).alias("step"), r6(F.max("stop").over(w)).alias("latest"))


@query("SELECT o_custkey, max(o_totalprice) AS top_price, arg_max(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey)) AS top_order FROM orders GROUP BY o_custkey")
def top_one(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top_price"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("top_order"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, props LIKE '%7%' AS has_seven, strftime(ts, '%Y%m%d_%H%M%S') AS session_name, CAST(hour(ts) // 2 AS BIGINT) AS two_hours, split_part(strftime(ts, '%Y%m%d_%H%M%S'), '_', 1) AS day_part FROM events")
def session_name_parts(spark: SparkSession, sf: str) -> DataFrame:
    name = F.date_format("ts", "yyyyMMdd_HHmmss")
    two = F.floor(F.substring(F.split(name, "_")[1], 1, 2).cast("int") / 2)
    return A.table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("props").contains("7").alias("has_seven"), name.alias("session_name"), two.alias("two_hours"), F.split(name, "_")[0].alias("day_part")
    )


@query("SELECT conv_id, array_to_string(list(role ORDER BY turn), ',') AS roles, count(*) AS n, max(turn) AS last_turn, array_to_string(list_sort(list(DISTINCT role)), '|') AS kinds FROM conversations GROUP BY conv_id")
def array_rollup(spark: SparkSession, sf: str) -> DataFrame:
    t = A.turns(spark, sf).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x"), F.count(F.lit(1)).alias("n"), F.max("turn").alias("last_turn"))
    roles = F.transform("x", lambda v: v["role"])
    return t.select("conv_id", F.array_join(roles, ",").alias("roles"), "n", "last_turn", F.array_join(F.array_sort(F.array_distinct(roles)), "|").alias("kinds"))


# expressions


@query(r"SELECT doc_id, regexp_replace(chr(9) || ' ' || lang || ' ', '^\s+|\s+$', '', 'g') AS emitter FROM documents")
def normalised_emitters(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.lit("\x00\x00\t "), F.col("lang"), F.lit(" \x00"))
    return A.table(spark, sf, "documents").select("doc_id", S.normalise_emitter(padded).alias("emitter"))


@query(UNITS + r""" SELECT unit_id, CAST(regexp_extract(unit_name, '^imec(\d+)_cl(\d+)_ch(\d+)_(.+)$', 1) AS INTEGER) AS probe, CAST(regexp_extract(unit_name, '^imec(\d+)_cl(\d+)_ch(\d+)_(.+)$', 2) AS INTEGER) AS cluster,
    CAST(regexp_extract(unit_name, '^imec(\d+)_cl(\d+)_ch(\d+)_(.+)$', 3) AS INTEGER) AS channel, regexp_extract(unit_name, '^imec(\d+)_cl(\d+)_ch(\d+)_(.+)$', 4) AS label FROM units""")
def parse_unit_ids(spark: SparkSession, sf: str) -> DataFrame:
    u = T.parse_unit_id(F.col("unit_name"))
    return A.units(spark, sf).select("unit_id", *[u[k].alias(k) for k in ("probe", "cluster", "channel", "label")])


@query(UNITS + r""" SELECT unit_id, length(regexp_replace(note, '[^r]', '', 'g')) AS n_r, regexp_extract(unit_name, '\d+', 0) AS first_digits, CAST(regexp_extract(unit_name, '\d+', 0) AS INTEGER) AS number FROM units""")
def decode_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = T.decode_label(F.col("unit_name"))
    return A.units(spark, sf).select("unit_id", F.size(F.regexp_extract_all("note", F.lit("(r)"), 1)).alias("n_r"), F.regexp_extract("unit_name", r"\d+", 0).alias("first_digits"), d["number"].alias("number"))


@query(UNITS + " SELECT unit_id, CASE WHEN unit_name LIKE '%\\_mua' ESCAPE '\\' THEN 'multi-unit' WHEN amplitude > 1000 THEN 'somatic' ELSE 'non-somatic' END AS cell_type, CASE WHEN area IN ('ECONOMY', 'PROMO') THEN 'pooled' ELSE area END AS region FROM units WHERE mouse_id NOT IN ('Brand#3')")
def catalog_cell_types(spark: SparkSession, sf: str) -> DataFrame:
    u = A.units(spark, sf).where(~F.col("mouse_id").isin("Brand#3"))
    return u.select("unit_id", F.when(F.col("unit_name").endswith("_mua"), "multi-unit").when(F.col("amplitude") > 1000, "somatic").otherwise("non-somatic").alias("cell_type"), F.when(F.col("area").isin("ECONOMY", "PROMO"), "pooled").otherwise(F.col("area")).alias("region"))


@query("WITH d AS (SELECT embedding[1]::DOUBLE * 40 AS x, vec_id FROM embeddings) SELECT vec_id, round(ln(1 + exp(-abs(x))) + greatest(x, 0), 9) AS softplus, round(least(greatest(x, -1), 1), 9) AS clipped, round(x - 6 * round_even(x / 6, 0), 9) AS wrapped FROM d")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("embedding")[0].cast("double") * 40
    return A.table(spark, sf, "embeddings").select("vec_id", F.round(S.softplus(x), 9).alias("softplus"), F.round(S.clip(x, -1.0, 1.0), 9).alias("clipped"), F.round(S.torus_difference(x, F.lit(0.0), 6.0), 9).alias("wrapped"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END, 6) AS per_discount, TRY_CAST(l_returnflag AS INTEGER) AS flag_number, CAST(l_quantity AS BIGINT) % 7 AS m FROM lineitem")
def lenient_casts_and_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r6(S.ratio(F.col("l_extendedprice"), F.col("l_discount"))).alias("per_discount"), F.col("l_returnflag").try_cast("int").alias("flag_number"), F.pmod(F.col("l_quantity").cast("long"), F.lit(7)).alias("m")
    )


@query(r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '/(\d+)', 1) AS number, len(regexp_extract_all(html, '<a href')) AS n_links FROM pages")
def regex_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"/(\d+)", 1).alias("number"), F.regexp_count("html", F.lit("<a href")).alias("n_links")
    )


@query(r"""WITH m AS (SELECT p_partkey, '(' || p_size || ',' || (p_partkey % 50) || ',' || (p_partkey % 4) || ')(' || (p_size + 1) || ',' || (p_partkey % 51) || ',0)' AS geom FROM part),
    t AS (SELECT p_partkey, unnest(regexp_extract_all(geom, '\(([^)]*)\)', 1)) AS tuple, generate_subscripts(regexp_extract_all(geom, '\(([^)]*)\)', 1), 1) - 1 AS i FROM m)
    SELECT p_partkey, CAST(i AS INTEGER) AS channel, CAST(split_part(tuple, ',', 1) AS INTEGER) AS x, CAST(split_part(tuple, ',', 2) AS INTEGER) AS y, CAST(split_part(tuple, ',', 3) AS INTEGER) AS shank FROM t""")
def parse_geometry(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    text = F.concat(F.lit("("), s.cast("string"), F.lit(","), (k % 50).cast("string"), F.lit(","), (k % 4).cast("string"), F.lit(")("), (s + 1).cast("string"), F.lit(","), (k % 51).cast("string"), F.lit(",0)"))
    return T.geometry(A.table(spark, sf, "part").select("p_partkey", text.alias("geom")), "geom", ["p_partkey"], ["x", "y", "shank"]).withColumnRenamed("place", "channel")


@query("SELECT n_nationkey, 'fileTimeSecs' AS key, CAST(n_regionkey * 10 AS VARCHAR) AS value FROM nation UNION ALL SELECT n_nationkey, 'name', n_name FROM nation")
def parse_key_values(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("fileTimeSecs="), (F.col("n_regionkey") * 10).cast("string"), F.lit("\nname="), F.col("n_name"), F.lit("\n"))
    return A.table(spark, sf, "nation").select("n_nationkey", F.explode(T.key_values(text)))


@query(FRAMES + """, s AS (SELECT avg(speed) AS m1, stddev_samp(speed) AS s1, avg(distance) AS m2, stddev_samp(distance) AS s2 FROM frames)
    SELECT session_id, frame_index, round((speed - m1) / s1, 6) AS speed, round((distance - m2) / s2, 6) AS distance FROM frames, s""")
def pooled_zscore(spark: SparkSession, sf: str) -> DataFrame:
    f = N.pooled_zscore(A.frames(spark, sf), ["speed", "distance"])
    return f.select("session_id", "frame_index", r6("speed").alias("speed"), r6("distance").alias("distance"))


@query(FRAMES + """, b AS (SELECT session_id, frame_index, CASE WHEN sqrt(yaw * yaw + 4) BETWEEN 0 AND 150 THEN sqrt(yaw * yaw + 4) END AS v FROM frames)
    SELECT session_id, count(v) AS n, count(*) - count(v) AS n_out, round(avg(v), 6) AS mean_v FROM b GROUP BY session_id""")
def bounded_features(spark: SparkSession, sf: str) -> DataFrame:
    v = N.bounded(F.col("yaw"), 0, 150, smooth=2.0)
    return A.frames(spark, sf).select("session_id", v.alias("v")).groupBy("session_id").agg(F.count("v").alias("n"), (F.count(F.lit(1)) - F.count("v")).alias("n_out"), r6(F.avg("v")).alias("mean_v"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS r FROM labels), m AS (SELECT min(n) AS least FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic))
    SELECT doc_id, toxic FROM l, m WHERE r <= least""")
def balanced_classes(spark: SparkSession, sf: str) -> DataFrame:
    return N.balanced(A.table(spark, sf, "labels"), "toxic", F.col("doc_id")).select("doc_id", "toxic")


@query(EV + """, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS r FROM events_m WHERE duration > 0 AND duration < 100)
    SELECT session_id, event_id FROM o WHERE r <= floor(600 / (SELECT count(DISTINCT session_id) FROM o))""")
def capped_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a range of durations, as many of each session."""
    e = A.events(spark, sf).where("duration > 0 and duration < 100")
    return N.capped(e, "session_id", 600, F.col("event_id")).select("session_id", "event_id")


@query("SELECT vec_id, CAST(t - 1 AS INTEGER) AS time, round(CAST(embedding[t] AS DOUBLE), 6) AS value FROM embeddings, range(1, 9) r(t) WHERE len(embedding) >= 8")
def unrolled_history(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "embeddings").where("size(embedding) >= 8").select("vec_id", F.slice("embedding", 1, 8).alias("x"))
    return N.unrolled(e, "x", ["vec_id"]).withColumn("value", r6(F.col("value").cast("double")))


@query(UNITS + """, n AS (SELECT area, count(*) AS n FROM units WHERE area <> 'PROMO' GROUP BY area), w AS (SELECT unit_id, CASE WHEN area <> 'PROMO' THEN 1.0::DOUBLE / n END AS w FROM units LEFT JOIN n USING (area))
    SELECT unit_id, round(coalesce(w, (SELECT median(w) FROM w)), 9) AS weight FROM w""")
def inverse_frequency_weights(spark: SparkSession, sf: str) -> DataFrame:
    """1 / size of a unit's area; units without one get the median."""
    u = A.units(spark, sf).select("unit_id", F.when(F.col("area") != "PROMO", F.col("area")).alias("area"))
    n = u.where("area is not null").groupBy("area").agg(F.count(F.lit(1)).alias("n"))
    w = u.join(n, "area", "left").withColumn("w", F.lit(1.0) / F.col("n"))
    return w.join(F.broadcast(w.agg(F.median("w").alias("mid")))).select("unit_id", F.round(F.coalesce("w", "mid"), 9).alias("weight"))  # one row


@query("SELECT doc_id, crc32_ok FROM (SELECT doc_id, doc_id % 10 <> 0 AS crc32_ok FROM documents) WHERE crc32_ok")
def development_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows outside the held-out sessions."""
    d = A.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 10 != 0).alias("crc32_ok"))
    held = d.where("not crc32_ok").select("doc_id")
    return d.join(held, "doc_id", "left_anti")


@query("SELECT CAST(nullif(n_regionkey % 2, 1) AS INTEGER) AS bucket, count(*) AS n FROM nation GROUP BY ALL")
def nulls_make_a_group(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "nation").select(F.nullif(F.col("n_regionkey") % 2, F.lit(1)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))), 6) AS norm, CAST(list_position(embedding, list_max(embedding)) AS BIGINT) AS peak, round(CAST(list_sum(list_transform(embedding[1:8], lambda v: CAST(v AS DOUBLE))) AS DOUBLE), 6) AS first_sum FROM embeddings")
def array_functions(spark: SparkSession, sf: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return A.table(spark, sf, "embeddings").select(
        "vec_id", "label", r6(F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))).alias("norm"), F.array_position("embedding", F.array_max("embedding")).alias("peak"), r6(F.aggregate(F.slice(x, 1, 8), F.lit(0.0), lambda a, v: a + v)).alias("first_sum")
    )


@query("SELECT r_name, array_to_string(list(n_name ORDER BY n_name), ';') AS nations, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def checked_foreign_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Nations by region; a nation without a region would raise."""
    n, r = A.table(spark, sf, "nation"), A.table(spark, sf, "region")
    ok = R.require_all(n.withColumnRenamed("n_regionkey", "r_regionkey"), r, ["r_regionkey"], "region")
    return ok.join(r, "r_regionkey").groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ";").alias("nations"), F.count(F.lit(1)).alias("n"))
