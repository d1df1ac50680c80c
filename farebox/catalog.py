"""Registry of every operator as a runnable query over the driver's tables,
each paired with its DuckDB oracle text.

profile, lookups and the example-question corpus, the SQL guard, change sets
and pipeline status, scalar functions and filters, CSV sources and the
medallion run, vectors, streams, physical layout. Each query builds its input
from the given tables (the ride fixture is derived from ``events``), so its
work grows with them; the oracle texts are written independently in SQL.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox import oracles as O
from farebox.functions import columns as C
from farebox.functions import filters as FL
from farebox.functions import labels as LB
from farebox.operators import adhoc as Q
from farebox.operators import changes as CH
from farebox.operators import corpus as K
from farebox.operators import dashboard as D
from farebox.operators import key_filters as KF
from farebox.operators import lookup as L
from farebox.operators import medallion as M
from farebox.operators import pages as PG
from farebox.operators import pipeline as PL
from farebox.operators import profile as P
from farebox.operators import report as R
from farebox.operators import sketches as SK
from farebox.operators import snapshots as SN
from farebox.operators import summaries as SU
from farebox.operators import cells as CL
from farebox.operators import vectors as V
from farebox.plans import layout as LO
from farebox.session import work_path
from farebox.sources import compaction as CO
from farebox.sources import csv as CSV
from farebox.sources import fixtures as X
from farebox.sources import layers as LY
from farebox.streaming import streams as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# Double sums and averages differ in their last bits with the summation order,
# so registered outputs are rounded (never the inputs), alike on both sides.
SUM_PLACES, AVG_PLACES = 4, 9


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """``df`` with the named output columns rounded."""
    return df.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(c)
                       for c in df.columns])


def _sum(x: str) -> str:
    return f"round(sum({x}), {SUM_PLACES})"


def _avg(x: str) -> str:
    return f"round(avg({x}), {AVG_PLACES})"


def _avg2(x: str) -> str:
    """Average to two places, half away from zero."""
    return f"CAST(round(CAST(avg({x}) AS DECIMAL(38,10)), 2) AS DOUBLE)"


def gold(spark: SparkSession, sf: str) -> DataFrame:
    return X.ride_gold(spark, sf)


# --- medallion ----------------------------------------------------------

@register("to_silver", O.with_layers("SELECT * FROM silver"))
def q_to_silver(spark, sf):
    return M.to_silver(X.ride_bronze(spark, sf))


@register("to_gold", O.with_layers("SELECT * FROM gold"))
def q_to_gold(spark, sf):
    return gold(spark, sf)


# --- report and dashboard -------------------------------------------------

_SEGMENT_BODY = f"""
SELECT vehicle_type, payment_method, count(*) AS total_rides, {_avg('booking_value')} AS avg_value,
       {_sum('ride_distance')} AS total_distance
FROM gold
WHERE booking_status = 'Completed' AND vehicle_type IN ('Uber XL', 'Premier Sedan', 'Go Sedan')
  AND booking_value > 300 AND ride_distance BETWEEN 5 AND 50
GROUP BY vehicle_type, payment_method ORDER BY total_distance DESC NULLS FIRST"""


@register("segment_report", O.with_layers(_SEGMENT_BODY))
def q_segment_report(spark, sf):
    return rounded(R.segment_report(gold(spark, sf)), avg_value=AVG_PLACES, total_distance=SUM_PLACES)


@register("kpi_summary", O.with_layers(f"""
SELECT count(*) AS total_bookings, count(*) FILTER (WHERE booking_status = 'Completed') AS successful_bookings,
       coalesce({_sum('booking_value')}, 0) AS total_revenue,
       {O.half_up_pct("count(*) FILTER (WHERE booking_status = 'Completed')", "count(*)")} AS success_rate
FROM gold"""))
def q_kpi_summary(spark, sf):
    return rounded(D.kpi_summary(gold(spark, sf)), total_revenue=SUM_PLACES)


@register("cancellation_counts", O.with_layers("""
SELECT unified_cancellation_reason AS reason, count(*) AS count FROM gold
WHERE unified_cancellation_reason <> 'Not Cancelled' GROUP BY unified_cancellation_reason"""))
def q_cancellation_counts(spark, sf):
    return D.cancellation_counts(gold(spark, sf))


_LABELS = {"lab": f"SELECT * FROM (VALUES {LB.labels_sql_values()}) t(kind, status, code, label)"}


@register("reason_short_label", O.with_layers("""
SELECT c.reason AS reason, c.count AS count, coalesce(l.label, c.reason) AS reason_label
FROM (SELECT unified_cancellation_reason AS reason, count(*) AS count FROM gold
      WHERE unified_cancellation_reason <> 'Not Cancelled' GROUP BY 1) c
LEFT JOIN lab l ON l.kind = 'reason_short' AND l.code = c.reason""", extra=_LABELS))
def q_reason_short_label(spark, sf):
    """A2's chart with the short labels of P17."""
    return LB.short_reasons(D.cancellation_counts(gold(spark, sf)))


@register("vehicle_performance", O.with_layers(f"""
SELECT vehicle_type, count(*) AS total_rides, {_avg2('customer_rating')} AS avg_rating
FROM gold GROUP BY vehicle_type"""))
def q_vehicle_performance(spark, sf):
    return D.vehicle_performance(gold(spark, sf))


@register("hourly_traffic", O.with_layers("""
SELECT CAST(hour(ride_timestamp) AS INTEGER) AS hour, count(*) AS ride_count
FROM gold GROUP BY 1 ORDER BY 1 NULLS LAST"""))
def q_hourly_traffic(spark, sf):
    return D.hourly_traffic(gold(spark, sf))


@register("dashboard_summary", O.with_layers(f"""
SELECT 'kpi' AS part, CAST(NULL AS VARCHAR) AS key, count(*) AS total,
       count(*) FILTER (WHERE booking_status = 'Completed') AS completed,
       coalesce({_sum('booking_value')}, 0) AS revenue,
       {O.half_up_pct("count(*) FILTER (WHERE booking_status = 'Completed')", "count(*)")} AS success_rate,
       CAST(NULL AS DOUBLE) AS avg_rating FROM gold
UNION ALL
SELECT 'reason', unified_cancellation_reason, count(*), count(*) FILTER (WHERE booking_status = 'Completed'),
       NULL, NULL, NULL FROM gold WHERE unified_cancellation_reason <> 'Not Cancelled' GROUP BY 2
UNION ALL
SELECT 'vehicle', vehicle_type, count(*), count(*) FILTER (WHERE booking_status = 'Completed'),
       NULL, NULL, {_avg2('customer_rating')} FROM gold GROUP BY 2
UNION ALL
SELECT 'hour', CAST(hour(ride_timestamp) AS VARCHAR), count(*), count(*) FILTER (WHERE booking_status = 'Completed'),
       NULL, NULL, NULL FROM gold GROUP BY 2"""))
def q_dashboard_summary(spark, sf):
    return rounded(D.dashboard_summary(gold(spark, sf)), revenue=SUM_PLACES)


_REASON_COUNTS = """(SELECT unified_cancellation_reason AS reason, count(*) AS count FROM gold
WHERE unified_cancellation_reason <> 'Not Cancelled' GROUP BY 1)"""


@register("share_of_total", O.with_layers(f"""
SELECT reason, count, {O.half_up_pct("count", "sum(count) OVER ()", 1)} AS pct FROM {_REASON_COUNTS} c"""))
def q_share_of_total(spark, sf):
    return D.share_of_total(D.cancellation_counts(gold(spark, sf)))


@register("share_of_max", O.with_layers(f"""
SELECT reason, count, CAST(count AS DOUBLE) * 100.0 / max(count) OVER () AS pct_of_max FROM {_REASON_COUNTS} c"""))
def q_share_of_max(spark, sf):
    return D.share_of_max(D.cancellation_counts(gold(spark, sf)))


@register("traffic_stats", O.with_layers("""
SELECT (SELECT max(ride_count) FROM h) AS peak_count,
       (SELECT min(hour) FROM h WHERE ride_count = (SELECT max(ride_count) FROM h)) AS peak_hour,
       (SELECT min(ride_count) FROM h) AS min_count,
       (SELECT min(hour) FROM h WHERE ride_count = (SELECT min(ride_count) FROM h)) AS min_hour,
       (SELECT CAST(floor(avg(ride_count) + 0.5) AS BIGINT) FROM h) AS mean_count""",
    extra={"h": "SELECT CAST(hour(ride_timestamp) AS INTEGER) AS hour, count(*) AS ride_count FROM gold GROUP BY 1"}))
def q_traffic_stats(spark, sf):
    return D.traffic_stats(D.hourly_traffic(gold(spark, sf)))


@register("filtered_count", O.with_layers("""
SELECT count(*) AS total_count FROM gold WHERE booking_status = 'Completed' AND vehicle_type = 'Bike'"""))
def q_filtered_count(spark, sf):
    return R.filtered_count(FL.ride_filter(gold(spark, sf), status="Completed", vehicle="Bike"))


# --- exploratory profile ----------------------------------------------------


_BRONZE_COLS = ["_id", "_batch_id", "ride_date", "ride_time", "booking_id", "booking_status",
                "customer_id", "vehicle_type", "cancelled_by_customer", "reason_customer",
                "cancelled_by_driver", "driver_reason", "incomplete_rides", "incomplete_reason",
                "booking_value", "ride_distance", "driver_ratings", "customer_rating",
                "payment_method"]
_BRONZE_TYPES = {"_id": "bigint", "ride_date": "date", "cancelled_by_customer": "boolean",
                 "cancelled_by_driver": "boolean", "incomplete_rides": "boolean",
                 "booking_value": "double", "ride_distance": "double",
                 "driver_ratings": "double", "customer_rating": "double"}
_NA_LIST = ", ".join("'" + t.replace("'", "''") + "'" for t in P.PANDAS_NA_TEXTS)
_EDA = "SELECT " + ", ".join(
    c if c in _BRONZE_TYPES else f"CASE WHEN {c} IN ({_NA_LIST}) THEN NULL ELSE {c} END AS {c}"
    for c in _BRONZE_COLS) + " FROM bronze"


def eda(spark, sf):
    return P.eda_view(X.ride_bronze(spark, sf))


def _eda_sql(body: str, **extra) -> str:
    return O.with_layers(body, extra={"eda": _EDA, **extra})


@register("eda_view", _eda_sql("SELECT * FROM eda"))
def q_eda_view(spark, sf):
    return eda(spark, sf)


@register("null_counts", _eda_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM eda"
    for c in _BRONZE_COLS)))
def q_null_counts(spark, sf):
    return P.null_counts(eda(spark, sf))


@register("column_profile", _eda_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{_BRONZE_TYPES.get(c, 'string')}' AS dtype, count({c}) AS non_null,"
    f" count(*) AS rows FROM eda" for c in _BRONZE_COLS)))
def q_column_profile(spark, sf):
    return P.column_profile(eda(spark, sf))


@register("distinct_count", _eda_sql("SELECT count(DISTINCT booking_id) AS distinct_count FROM eda"))
def q_distinct_count(spark, sf):
    return P.distinct_count(eda(spark, sf))


@register("distinct_sketch", _eda_sql("""
SELECT coalesce(_batch_id, 'all') AS scope, count(DISTINCT booking_id) AS exact_count, true AS within_error
FROM eda GROUP BY GROUPING SETS ((_batch_id), ())"""))
def q_distinct_sketch(spark, sf):
    """A13 from sketches stored per batch and over their union, held against
    the exact counts; batch-1 is stored twice, as a rerun does."""
    df = eda(spark, sf)
    path = work_path(spark, "key-sketches")
    SK.batch_sketches(df, "booking_id").write.partitionBy("_batch_id").parquet(path)
    SK.store_sketch(df, path, "batch-1", "booking_id")
    stored = spark.read.parquet(path)
    est = stored.select(F.col("_batch_id").alias("scope"), F.hll_sketch_estimate("sketch").alias("estimate")) \
        .unionByName(SK.distinct_estimate(stored).select(F.lit("all").alias("scope"),
                                                         F.col("distinct_count").alias("estimate")))
    exact = df.groupBy("_batch_id").agg(F.count_distinct("booking_id").alias("exact_count")) \
        .select(F.col("_batch_id").alias("scope"), "exact_count") \
        .unionByName(P.distinct_count(df).select(F.lit("all").alias("scope"), F.col("distinct_count").alias("exact_count")))
    bound = 3 * SK.relative_error()
    return exact.join(est, "scope").select(
        "scope", "exact_count", (F.abs(F.col("estimate") - F.col("exact_count"))
                                 <= F.col("exact_count") * bound + 1).alias("within_error"))


def _long_union(cols, src="eda", cast="VARCHAR"):
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS {cast}) AS value FROM {src}"
                              for c in cols)


@register("value_distribution", _eda_sql(f"""
SELECT column_name, value, count, {O.half_up_pct("count", "sum(count) OVER (PARTITION BY column_name)", 2)} AS pct
FROM (SELECT column_name, value, count(*) AS count FROM lv GROUP BY column_name, value) c""",
    lv=_long_union(P.KEY_COLUMNS)))
def q_value_distribution(spark, sf):
    return P.value_distribution(eda(spark, sf))


@register("reason_counts", _eda_sql("""
SELECT column_name, value, count(*) AS count FROM lv WHERE value IS NOT NULL GROUP BY column_name, value""",
    lv=_long_union(P.REASON_COLUMNS)))
def q_reason_counts(spark, sf):
    return P.reason_counts(eda(spark, sf))


@register("ordered_counts", _eda_sql(f"""
SELECT value, count, {O.half_up_pct("count", "sum(count) OVER ()", 1)} AS pct,
       row_number() OVER (ORDER BY count DESC, value) AS rank
FROM (SELECT vehicle_type AS value, count(*) AS count FROM eda WHERE vehicle_type IS NOT NULL GROUP BY 1) c"""))
def q_ordered_counts(spark, sf):
    return P.ordered_counts(eda(spark, sf), "vehicle_type")


@register("numeric_describe", _eda_sql(f"""
SELECT column_name, count(value) AS count, {_avg('value')} AS mean, stddev_samp(value) AS std, min(value) AS min,
       quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
       quantile_cont(value, 0.75) AS p75, max(value) AS max
FROM lv WHERE value IS NOT NULL GROUP BY column_name""", lv=_long_union(P.NUMERIC_COLUMNS, cast="DOUBLE")))
def q_numeric_describe(spark, sf):
    return rounded(P.numeric_describe(eda(spark, sf)), mean=AVG_PLACES)


@register("describe_stored", _eda_sql(f"""
SELECT column_name, count(value) AS count, {_avg('value')} AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
       quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
       quantile_cont(value, 0.75) AS p75, max(value) AS max
FROM lv WHERE value IS NOT NULL GROUP BY column_name""", lv=_long_union(P.NUMERIC_COLUMNS, cast="DOUBLE")))
def q_describe_stored(spark, sf):
    """A15 from summaries stored per batch and one pass over the rows."""
    df = eda(spark, sf)
    path = work_path(spark, "summaries")
    SU.batch_summaries(df).write.partitionBy("_batch_id").parquet(path)
    return rounded(SU.stored_describe(df, spark.read.parquet(path)), mean=AVG_PLACES, std=6)


_HISTOGRAM = """
SELECT b.bin AS bin, mm.lo + b.bin * ((mm.hi - mm.lo) / 40.0) AS lower,
       CASE WHEN b.bin = 39 THEN mm.hi ELSE mm.lo + (b.bin + 1) * ((mm.hi - mm.lo) / 40.0) END AS upper,
       coalesce(c.count, 0) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(40)) b CROSS JOIN mm
LEFT JOIN (SELECT CAST(least(floor((booking_value - (SELECT lo FROM mm)) * 40.0 / ((SELECT hi FROM mm) - (SELECT lo FROM mm))), 39) AS INTEGER) AS bin,
                  count(*) AS count FROM eda WHERE booking_value IS NOT NULL GROUP BY 1) c ON c.bin = b.bin"""
_ENDS = "SELECT min(booking_value) AS lo, max(booking_value) AS hi FROM eda WHERE booking_value IS NOT NULL"


@register("histogram", _eda_sql(_HISTOGRAM, mm=_ENDS))
def q_histogram(spark, sf):
    return P.histogram(eda(spark, sf), "booking_value", 40)


@register("histogram_stored", _eda_sql(_HISTOGRAM, mm=_ENDS))
def q_histogram_stored(spark, sf):
    """A17 with bounds from summaries stored per batch."""
    df = eda(spark, sf)
    path = work_path(spark, "summaries")
    SU.batch_summaries(df, ["booking_value"]).write.partitionBy("_batch_id").parquet(path)
    return SU.stored_histogram(df, spark.read.parquet(path), "booking_value", 40)


@register("kde_curve", _eda_sql("""
SELECT CAST(g.range AS INTEGER) AS point, st.mn + g.range * ((st.mx - st.mn) / 199.0) AS x,
       avg(exp(-pow(st.mn + g.range * ((st.mx - st.mn) / 199.0) - e.booking_value, 2) / (2 * pow(st.bw, 2)))
           / sqrt(2 * pi() * pow(st.bw, 2))) AS density,
       sum(exp(-pow(st.mn + g.range * ((st.mx - st.mn) / 199.0) - e.booking_value, 2) / (2 * pow(st.bw, 2)))
           / sqrt(2 * pi() * pow(st.bw, 2))) * (st.mx - st.mn) / 40 AS count
FROM range(200) g CROSS JOIN st CROSS JOIN (SELECT booking_value FROM eda WHERE booking_value IS NOT NULL) e
GROUP BY g.range, st.mn, st.mx, st.bw""",
    st="SELECT stddev_samp(booking_value) * pow(count(booking_value), -0.2) AS bw,"
       " min(booking_value) AS mn, max(booking_value) AS mx FROM eda WHERE booking_value IS NOT NULL"))
def q_kde_curve(spark, sf):
    return P.kde_curve(eda(spark, sf), "booking_value")


@register("head", _eda_sql("SELECT * FROM eda ORDER BY _id LIMIT 3"))
def q_head(spark, sf):
    return P.head(eda(spark, sf), 3)


# --- lookups, top-n and paging ------------------------------------------------


_GOLD_API = ", ".join(f"{k} AS {v}" for k, v in C.GOLD_API_NAMES.items())
_NEWEST = "ride_timestamp DESC NULLS FIRST, booking_id ASC NULLS LAST"


@register("rides_page", O.with_layers(f"""
SELECT {", ".join(C.GOLD_API_NAMES)}, (SELECT count(*) FROM gold WHERE booking_status = 'Completed') AS total_count
FROM gold WHERE booking_status = 'Completed' ORDER BY {_NEWEST} LIMIT 20 OFFSET 20"""))
def q_rides_page(spark, sf):
    return L.rides_page(gold(spark, sf), status="Completed", page=2, size=20)


@register("rides_page_deep", O.with_layers(f"""
SELECT {", ".join(C.GOLD_API_NAMES)}, (SELECT count(*) FROM gold WHERE booking_status = 'Completed') AS total_count
FROM (SELECT *, row_number() OVER (ORDER BY {_NEWEST}) AS rn FROM gold WHERE booking_status = 'Completed')
WHERE rn > 20 * (SELECT count(*) // 40 FROM gold WHERE booking_status = 'Completed')
  AND rn <= 20 * (SELECT count(*) // 40 + 1 FROM gold WHERE booking_status = 'Completed')"""))
def q_rides_page_deep(spark, sf):
    """O1 from the stored order: the page in the middle of all completed rides."""
    path = PG.write_paged(gold(spark, sf), work_path(spark, "gold-paged"))
    _, _, total = PG.page_ranges(spark, path, status="Completed")
    return PG.deep_page(spark, path, status="Completed", page=total // 40 + 1, size=20)


@register("project_rename", O.with_layers(f"SELECT {_GOLD_API} FROM gold"))
def q_project_rename(spark, sf):
    return gold(spark, sf).select(*C.project_rename(C.GOLD_API_NAMES))


@register("top_n", O.with_layers("""
SELECT * FROM gold ORDER BY customer_rating DESC NULLS FIRST, booking_id LIMIT 7"""))
def q_top_n(spark, sf):
    return L.top_n(gold(spark, sf), "customer_rating", 7)


@register("page_count", O.with_layers("""
SELECT vehicle_type, count(*) AS total_count, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages
FROM gold GROUP BY vehicle_type"""))
def q_page_count(spark, sf):
    counts = gold(spark, sf).groupBy("vehicle_type").agg(F.count(F.lit(1)).alias("total_count"))
    return counts.withColumn("pages", L.page_count(F.col("total_count"), 20))


# The keys that the change set deletes (``_CS`` below holds the same kinds).
_NUM = "CAST(regexp_extract(booking_id, '([0-9]+)', 1) AS BIGINT)"
_CHANGE_DELETES = (f"{_NUM} % 101 = 0 OR ({_NUM} % 97 <> 0 AND {_NUM} % 89 <> 0 AND ({_NUM} % 83 = 0 "
                   f"OR ({_NUM} % 79 <> 0 AND {_NUM} % 73 = 0)))")


@register("id_semi_join", O.with_layers(f"SELECT * FROM gold WHERE {_CHANGE_DELETES}"))
def q_id_semi_join(spark, sf):
    ids = X.change_set(spark, sf).where(F.col("op") == "delete").select("booking_id")
    return L.id_semi_join(gold(spark, sf), ids)


# --- example questions (DataFrame API) -----------------------------------------

_CORPUS_SQL = {
    "q_latest": f"SELECT * FROM gold ORDER BY {_NEWEST} LIMIT 5",
    "q_total_revenue": f"SELECT {_sum('booking_value')} AS total_revenue FROM gold",
    "q_completed": "SELECT count(*) AS count FROM gold WHERE booking_status = 'Completed'",
    "q_rating_by_vehicle": f"SELECT vehicle_type, {_avg('customer_rating')} AS avg_rating FROM gold GROUP BY vehicle_type",
    "q_top_reasons": ("SELECT unified_cancellation_reason, count(*) AS count FROM gold "
                      "WHERE unified_cancellation_reason <> 'Not Cancelled' GROUP BY 1 "
                      "ORDER BY count DESC, unified_cancellation_reason LIMIT 3"),
    "q_revenue_by_payment": (f"SELECT payment_method, {_sum('booking_value')} AS revenue FROM gold "
                             "WHERE payment_method <> 'Not Specified' GROUP BY payment_method"),
    "q_long_recent": (f"SELECT * FROM gold WHERE ride_distance > 10 AND ride_timestamp >= "
                      f"(SELECT max(ride_timestamp) FROM gold) - INTERVAL 1 MONTH ORDER BY {_NEWEST} LIMIT 10"),
    "q_distance_by_vehicle": (f"SELECT vehicle_type, {_avg('ride_distance')} AS avg_distance FROM gold "
                              "GROUP BY vehicle_type ORDER BY avg_distance DESC NULLS FIRST, vehicle_type LIMIT 10"),
    "q_most_expensive": ("SELECT booking_id, booking_value, vehicle_type, ride_timestamp FROM gold "
                         "ORDER BY booking_value DESC NULLS FIRST, booking_id LIMIT 5"),
    "q_bike_cancelled": (f"SELECT * FROM gold WHERE vehicle_type = 'Bike' AND booking_status = "
                         f"'Cancelled by Customer' ORDER BY {_NEWEST} LIMIT 10"),
    "q_by_hour": ("SELECT CAST(hour(ride_timestamp) AS INTEGER) AS hour, count(*) AS ride_count FROM gold "
                  "GROUP BY 1 ORDER BY 1 NULLS LAST LIMIT 24"),
    "q_upi_completed": (f"SELECT {_sum('booking_value')} AS sum FROM gold WHERE booking_status = 'Completed' "
                        "AND payment_method = 'UPI'"),
    "q_top_rated": ("SELECT booking_id, driver_ratings, vehicle_type FROM gold WHERE driver_ratings IS NOT NULL "
                    "ORDER BY driver_ratings DESC NULLS FIRST, booking_id LIMIT 5"),
    "q_ui_latest_completed": f"SELECT * FROM gold WHERE booking_status = 'Completed' ORDER BY {_NEWEST} LIMIT 10",
    "q_ui_total_revenue": f"SELECT {_sum('booking_value')} AS total_revenue FROM gold",
    "q_ui_avg_rating_go_mini": f"SELECT {_avg('customer_rating')} AS avg_rating FROM gold WHERE vehicle_type = 'Go Mini'",
    "q_ui_top_customer_reasons": ("SELECT unified_cancellation_reason, count(*) AS count FROM gold "
                                  "WHERE booking_status = 'Cancelled by Customer' AND "
                                  "unified_cancellation_reason <> 'Not Cancelled' GROUP BY 1 "
                                  "ORDER BY count DESC, unified_cancellation_reason LIMIT 5"),
    "q_ui_upi_count": "SELECT count(*) AS count FROM gold WHERE payment_method = 'UPI'",
}
_CORPUS_FN = {
    "q_latest": K.latest, "q_total_revenue": K.total_revenue, "q_completed": K.completed_count,
    "q_rating_by_vehicle": K.rating_by_vehicle, "q_top_reasons": K.top_reasons,
    "q_revenue_by_payment": K.revenue_by_payment, "q_long_recent": K.long_recent,
    "q_distance_by_vehicle": K.distance_by_vehicle, "q_most_expensive": K.most_expensive,
    "q_bike_cancelled": K.bike_cancelled, "q_by_hour": K.by_hour,
    "q_upi_completed": K.upi_completed, "q_top_rated": K.top_rated,
    "q_ui_latest_completed": K.latest_completed, "q_ui_total_revenue": K.total_revenue,
    "q_ui_avg_rating_go_mini": K.avg_rating_of,
    "q_ui_top_customer_reasons": lambda g: K.top_reasons(g, 5, "Cancelled by Customer"),
    "q_ui_upi_count": K.count_by_payment,
}


_CORPUS_PLACES = {"total_revenue": SUM_PLACES, "revenue": SUM_PLACES, "sum": SUM_PLACES,
                  "avg_rating": AVG_PLACES, "avg_distance": AVG_PLACES}


def _corpus_query(fn):
    return lambda spark, sf: rounded(fn(gold(spark, sf)), **_CORPUS_PLACES)


for _name, _fn in _CORPUS_FN.items():
    register(_name, O.with_layers(_CORPUS_SQL[_name]))(_corpus_query(_fn))


# --- guarded ad-hoc SQL ---------------------------------------------------------

def _duck_word(col: str, word: str) -> str:
    return f"regexp_matches({col}, '(?i)\\b{word}\\b')"


def _guard_oracle() -> str:
    clean = r"regexp_replace(replace(replace(sql, '```sql', ''), '```', ''), '^\s+|\s+$', '', 'g')"
    reason = "CASE WHEN c IS NULL OR upper(substring(c, 1, 6)) <> 'SELECT' THEN 'not_select' "
    for w in Q.FORBIDDEN_WORDS:
        reason += f"WHEN {_duck_word('c', w)} THEN 'forbidden:{w}' "
    reason += "END"
    limited = (f"CASE WHEN {_duck_word('c', 'LIMIT')} THEN c "
               f"ELSE concat(regexp_replace(c, ';+$', ''), ' LIMIT {Q.DEFAULT_LIMIT};') END")
    log = X.STATEMENT_LOG_SQL.replace("{conversations}", "conversations").replace("{gold}", "gold") \
        .replace("AS STRING", "AS VARCHAR")
    return O.with_layers(f"""
SELECT stmt_id, sql, reason IS NULL AS is_valid, reason,
       CASE WHEN reason IS NULL THEN {limited} ELSE '' END AS sanitized_sql
FROM (SELECT stmt_id, sql, c, {reason} AS reason FROM (SELECT stmt_id, sql, {clean} AS c FROM log) a) b""",
                         extra={"log": log})


@register("guard_sql", _guard_oracle())
def q_guard_sql(spark, sf):
    return Q.guard_sql(X.statement_log(spark, sf))


@register("q_refused", f"""SELECT stmt_id, reason,
  CASE WHEN reason = 'not_select' THEN '{Q.NOT_SELECT_TEXT}'
       ELSE '{Q.FORBIDDEN_TEXT}' || substr(reason, length('forbidden:') + 1) END AS message
FROM ({_guard_oracle()}) g WHERE NOT is_valid""")
def q_q_refused(spark, sf):
    """Q3 refusals: every statement of the log the guard refuses (writes,
    WITH, forbidden words, non-SQL text), with the message of its cause."""
    return Q.refusals(Q.guard_sql(X.statement_log(spark, sf)))


@register("run_guarded_sql", O.with_layers(_CORPUS_SQL["q_top_reasons"]))
def q_run_guarded_sql(spark, sf):
    return Q.run_guarded_sql(spark, K.STATEMENTS["q_top_reasons"].replace(
        "ORDER BY count DESC", "ORDER BY count DESC, unified_cancellation_reason"), gold(spark, sf))


@register("query_result_sink", O.with_layers(
    "SELECT CAST(to_json({'vehicle_type': vehicle_type, 'total_rides': count(*)}) AS VARCHAR) AS record "
    "FROM gold GROUP BY vehicle_type"))
def q_query_result_sink(spark, sf):
    g = gold(spark, sf).groupBy("vehicle_type").agg(F.count(F.lit(1)).alias("total_rides"))
    return Q.query_records(g)


# --- change sets, pipeline status -------------------------------------------------


_EVENTS = """SELECT o_orderkey AS seq, CAST(o_custkey AS VARCHAR) AS batch_id,
 CASE WHEN o_orderstatus = 'P' THEN 'Bronze' WHEN o_orderstatus = 'O' THEN 'Silver' ELSE 'Gold' END AS step,
 CASE WHEN substring(o_orderpriority, 1, 1) IN ('1', '2') THEN 'Failed'
      WHEN substring(o_orderpriority, 1, 1) = '3' THEN 'Processing' ELSE 'Success' END AS status,
 o_orderdate AS event_time, CAST(round(o_totalprice) AS BIGINT) AS rows,
 CASE WHEN substring(o_orderpriority, 1, 1) IN ('1', '2')
      THEN concat('error in order ', CAST(o_orderkey AS VARCHAR)) END AS error
FROM orders"""
_STATUS = """SELECT l.batch_id AS batch_id, l.step AS step, l.status AS status, s.start_time AS start_time,
 d.event_time AS end_time, d.rows AS rows_imported, l.error AS error_message
FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY event_time DESC, seq DESC) AS rn FROM ev) l
JOIN (SELECT batch_id, min(event_time) AS start_time FROM ev GROUP BY batch_id) s ON s.batch_id = l.batch_id
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY event_time DESC, seq DESC) AS rn
           FROM ev WHERE status IN ('Success', 'Failed')) WHERE rn = 1) d ON d.batch_id = l.batch_id
WHERE l.rn = 1"""


def _status_sql(body: str) -> str:
    return f"WITH ev AS ({_EVENTS}), sv AS ({_STATUS})\n{body}"


def status_view(spark, sf):
    return CH.step_status(X.step_events(spark, sf))


@register("step_status", _status_sql("SELECT * FROM sv"))
def q_step_status(spark, sf):
    return status_view(spark, sf)


@register("step_status_compacted", _status_sql("SELECT * FROM sv"))
def q_step_status_compacted(spark, sf):
    """M5 over step events that arrived in many small files and were compacted."""
    path = work_path(spark, "step-events")
    X.step_events(spark, sf).repartition(48).write.parquet(path)
    CO.compact(spark, path, M.sch.STEP_EVENT_SCHEMA, max_files=8)
    return CH.step_status(spark.read.schema(M.sch.STEP_EVENT_SCHEMA).parquet(path))


@register("run_status_label", _status_sql("""
SELECT sv.*, coalesce(l.label, sv.status) AS status_label FROM sv
LEFT JOIN (SELECT * FROM (VALUES """ + LB.labels_sql_values() + """) t(kind, st, code, label)) l
  ON l.kind = 'run_status' AND l.code = sv.status"""))
def q_run_status_label(spark, sf):
    return LB.label_runs(status_view(spark, sf))


@register("latest_status", _status_sql("SELECT batch_id, step, status FROM sv"))
def q_latest_status(spark, sf):
    return CH.latest_status(X.step_events(spark, sf))


@register("resumable_runs", _status_sql(
    "SELECT batch_id, step AS resume_step FROM sv WHERE status = 'Failed' AND step IN ('Silver', 'Gold')"))
def q_resumable_runs(spark, sf):
    return CH.resumable_runs(status_view(spark, sf))


@register("runs_page", _status_sql(
    "SELECT *, (SELECT count(*) FROM sv) AS total_count FROM sv "
    "ORDER BY start_time DESC NULLS FIRST, batch_id LIMIT 20 OFFSET 40"))
def q_runs_page(spark, sf):
    return L.runs_page(status_view(spark, sf), page=3, size=20)


def _duck_digits(x: str) -> str:
    return f"translate(CAST({x} AS VARCHAR), '0123456789', '{C.DISPLAY_DIGITS}')"


def _duck_secs(ms: str) -> str:
    cs = f"(({ms} + 5) // 10)"
    return f"concat({_duck_digits(f'{cs} // 100')}, ',', {_duck_digits(f'lpad(CAST({cs} % 100 AS VARCHAR), 2, chr(48))')})"


_DIFF = ("greatest(epoch_ms(coalesce(end_time, (SELECT max(event_time) FROM ev))) - epoch_ms(start_time), 0)")


@register("duration_text", _status_sql(f"""
SELECT *, CASE WHEN d < 1000 THEN concat({_duck_digits('d')}, ',', '{C.DISPLAY_DIGITS[0] * 2}', '{C.UNIT_MS}')
               WHEN d < 60000 THEN concat({_duck_secs('d')}, '{C.UNIT_S}')
               ELSE concat({_duck_digits('d // 60000')}, '{C.UNIT_MIN}', {_duck_secs('d % 60000')}, '{C.UNIT_MIN_S}') END AS duration,
       status = 'Failed' AND step IN ('Silver', 'Gold') AS can_resume
FROM (SELECT *, {_DIFF} AS d FROM sv) t""".replace("SELECT *, CASE", "SELECT * EXCLUDE (d), CASE")))
def q_duration_text(spark, sf):
    ev = X.step_events(spark, sf)
    now = ev.select(F.max("event_time")).scalar()
    return CH.with_run_flags(CH.step_status(ev), now)


_DIGITS = "CAST(regexp_extract(booking_id, '([0-9]+)', 1) AS BIGINT)"
_CS = {
    "kinds": (f"SELECT *, CASE WHEN {_DIGITS} % 101 = 0 THEN 'delete' WHEN {_DIGITS} % 97 = 0 THEN 'update' "
              f"WHEN {_DIGITS} % 89 = 0 THEN 'insert' WHEN {_DIGITS} % 83 = 0 THEN 'delete insert' "
              f"WHEN {_DIGITS} % 79 = 0 THEN 'insert update' WHEN {_DIGITS} % 73 = 0 THEN 'update delete' END AS kind "
              f"FROM gold"),
    # Rows that any delete / update names, and the rows that end up new.
    "dels": "SELECT booking_id FROM kinds WHERE kind IN ('delete', 'delete insert', 'update delete')",
    "upds": "SELECT booking_id FROM kinds WHERE kind IN ('update', 'update delete')",
    "ins": ("SELECT * REPLACE (CASE WHEN kind = 'delete insert' THEN booking_id ELSE 'NEW-' || booking_id END AS booking_id, "
            "CASE WHEN kind = 'delete insert' THEN booking_value + 1 ELSE booking_value END AS booking_value) "
            "FROM kinds WHERE kind IN ('insert', 'delete insert', 'insert update')"),
}
_NEW_ROWS = """SELECT {key} AS booking_id, CAST(NULL AS VARCHAR) AS _batch_id, ride_timestamp,
 {status} AS booking_status, customer_id, vehicle_type, {reason} AS unified_cancellation_reason,
 booking_value, ride_distance, CASE WHEN ride_distance > 0 THEN booking_value / ride_distance ELSE CAST(0 AS DOUBLE) END AS revenue_per_km,
 driver_ratings, customer_rating, payment_method FROM ins"""
_UPDATED = """SELECT g.booking_id, g._batch_id, g.ride_timestamp,
 CASE WHEN u.booking_id IS NOT NULL THEN 'Cancelled by Driver' ELSE g.booking_status END AS booking_status,
 g.customer_id, g.vehicle_type,
 CASE WHEN u.booking_id IS NOT NULL THEN 'Other Issue' ELSE g.unified_cancellation_reason END AS unified_cancellation_reason,
 g.booking_value, g.ride_distance, g.revenue_per_km, g.driver_ratings, g.customer_rating, g.payment_method
FROM gold g LEFT JOIN upds u ON u.booking_id = g.booking_id"""


def _cs_sql(body: str) -> str:
    return O.with_layers(body, extra=_CS)


def _cs(spark, sf):
    return X.change_set(spark, sf)


@register("add_rides", _cs_sql(_NEW_ROWS.format(
    key="concat('BOK-', upper(substring(md5(booking_id), 1, 10)))",
    status="'Completed'", reason="'Not Cancelled'")))
def q_add_rides(spark, sf):
    ins = _cs(spark, sf).where(F.col("op") == "insert")
    return CH.add_rides(ins, key_seed="booking_id")


@register("update_status", _cs_sql(_UPDATED))
def q_update_status(spark, sf):
    upd = _cs(spark, sf).where(F.col("op") == "update")
    return CH.update_status(gold(spark, sf), upd)


@register("delete_rides", _cs_sql("SELECT * FROM gold WHERE booking_id NOT IN (SELECT booking_id FROM dels)"))
def q_delete_rides(spark, sf):
    dels = _cs(spark, sf).where(F.col("op") == "delete")
    return CH.delete_rides(gold(spark, sf), dels)


@register("matched_keys", _cs_sql("""
SELECT booking_id, true AS matched FROM dels UNION SELECT booking_id, true FROM upds
UNION ALL SELECT 'NEW-' || booking_id, false FROM kinds WHERE kind = 'insert update'"""))
def q_matched_keys(spark, sf):
    """Whether each update or delete finds its ride in gold."""
    keys = _cs(spark, sf).where(F.col("op") != "insert")
    return CH.matched_keys(gold(spark, sf), keys)


_APPLIED = (f"SELECT * FROM ({_UPDATED}) x WHERE booking_id NOT IN (SELECT booking_id FROM dels) "
            "UNION ALL " + _NEW_ROWS.format(
                key="booking_id",
                status="CASE WHEN kind = 'insert update' THEN 'Cancelled by Driver' ELSE 'Completed' END",
                reason="CASE WHEN kind = 'insert update' THEN 'Other Issue' ELSE 'Not Cancelled' END"))


@register("apply_changes", _cs_sql(_APPLIED))
def q_apply_changes(spark, sf):
    return CH.apply_changes(gold(spark, sf), _cs(spark, sf))


_DIFF = """
SELECT booking_id, 'deleted' AS change FROM kinds WHERE kind IN ('delete', 'update delete')
UNION ALL SELECT booking_id, 'changed' FROM kinds WHERE kind IN ('update', 'delete insert')
UNION ALL SELECT 'NEW-' || booking_id, 'inserted' FROM kinds WHERE kind IN ('insert', 'insert update')"""


@register("snapshot_diff", O.with_layers(_DIFF, extra=_CS))
def q_snapshot_diff(spark, sf):
    g = gold(spark, sf)
    return CH.snapshot_diff(g, CH.apply_changes(g, _cs(spark, sf)), "booking_id")


@register("snapshot_diff_buckets", O.with_layers(_DIFF, extra=_CS))
def q_snapshot_diff_buckets(spark, sf):
    """T4 of two stored snapshots, by the buckets that differ."""
    g = X.stored_gold(spark, sf)
    before = SN.write_snapshot(g, work_path(spark, "snapshot-before"), "booking_id", 32)
    after = SN.write_snapshot(CH.apply_changes(g, X.change_set(spark, sf, g)), work_path(spark, "snapshot-after"), "booking_id", 32)
    return SN.diff_snapshots(spark, before, after, "booking_id")


# --- scalar functions (P) over the layers ------------------------------------------


def raw(spark, sf):
    return X.ride_raw_text(spark, sf)


def _raw_sql(body: str) -> str:
    return O.with_layers(body.replace("AS STRING", "AS VARCHAR"), raw=True)


_DUCK_NULLISH = "({c} IS NULL OR regexp_matches({c}, '^\\s*(?i:null)?\\s*$'))"


def _dn(c: str) -> str:
    return _DUCK_NULLISH.format(c=c)


@register("parse_flag", _raw_sql(", ".join(
    ["SELECT _id"] + [f"CASE WHEN {_dn(c)} THEN NULL ELSE {c} = '1' END AS {c}"
                      for c in ("cancelled_by_customer", "cancelled_by_driver", "incomplete_rides")])
    + " FROM raw"))
def q_parse_flag(spark, sf):
    return raw(spark, sf).select("_id", *[C.parse_flag(c).alias(c) for c in
                                          ("cancelled_by_customer", "cancelled_by_driver", "incomplete_rides")])


_NUM_BAD = ("(regexp_matches(trim({c}), '[dDfF]$') OR regexp_matches(trim({c}), '\\..*,') "
            "OR regexp_matches(trim({c}), '^[+-]?,') OR regexp_matches(trim({c}), '(?i)^[+-]?(inf|nan)'))")


def _duck_number(c: str) -> str:
    return (f"CASE WHEN {_dn(c)} OR {_NUM_BAD.format(c=c)} THEN NULL "
            f"ELSE TRY_CAST(replace(trim({c}), ',', '') AS DOUBLE) END")


@register("parse_number", _raw_sql(
    "SELECT _id, " + ", ".join(f"{_duck_number(c)} AS {c}" for c in
                               ("booking_value", "ride_distance", "driver_ratings", "customer_rating"))
    + " FROM raw"))
def q_parse_number(spark, sf):
    return raw(spark, sf).select("_id", *[C.parse_number(c).alias(c) for c in
                                          ("booking_value", "ride_distance", "driver_ratings", "customer_rating")])


@register("parse_date", _raw_sql("""
SELECT _id, CASE WHEN {n} THEN NULL ELSE CAST(coalesce(try_strptime(trim(ride_date), '%Y-%m-%d'),
  try_strptime(trim(ride_date), '%m/%d/%Y'), try_strptime(trim(ride_date), '%Y/%m/%d'),
  try_strptime(trim(ride_date), '%d %b %Y')) AS DATE) END AS ride_date FROM raw""".replace("{n}", _dn("ride_date"))))
def q_parse_date(spark, sf):
    return raw(spark, sf).select("_id", C.parse_date("ride_date").alias("ride_date"))


@register("null_literal", _raw_sql(
    "SELECT _id, " + ", ".join(f"{_dn(c)} AS {c}" for c in ("ride_date", "cancelled_by_customer",
                                                             "booking_value", "payment_method"))
    + " FROM raw"))
def q_null_literal(spark, sf):
    return raw(spark, sf).select("_id", *[C.is_nullish(c).alias(c) for c in
                                          ("ride_date", "cancelled_by_customer", "booking_value", "payment_method")])


@register("combine_timestamp", O.with_layers(
    "SELECT _id, CAST(concat(CAST(ride_date AS VARCHAR), ' ', trim(ride_time)) AS TIMESTAMP) AS ride_timestamp FROM bronze"))
def q_combine_timestamp(spark, sf):
    return X.ride_bronze(spark, sf).select("_id", C.combine_timestamp("ride_date", "ride_time").alias("ride_timestamp"))


_TRIMMED = ("booking_id", "booking_status", "customer_id", "vehicle_type")


@register("trim_columns", O.with_layers(
    "SELECT _id, " + ", ".join(f"trim({c}) AS {c}" for c in _TRIMMED) + " FROM bronze"))
def q_trim_columns(spark, sf):
    return X.ride_bronze(spark, sf).select("_id", *[C.trim_spaces(c).alias(c) for c in _TRIMMED])


@register("unify_reason", O.with_layers("""
SELECT _id, CASE WHEN booking_status = 'Cancelled by Customer' THEN reason_customer
 WHEN booking_status = 'Cancelled by Driver' THEN driver_reason
 WHEN booking_status = 'Incomplete' THEN incomplete_reason ELSE 'Not Cancelled' END AS unified_cancellation_reason
FROM bronze"""))
def q_unify_reason(spark, sf):
    return X.ride_bronze(spark, sf).select("_id", C.unify_reason(
        "booking_status", "reason_customer", "driver_reason", "incomplete_reason")
        .alias("unified_cancellation_reason"))


@register("fill_measures", O.with_layers(
    "SELECT _id, coalesce(booking_value, 0) AS booking_value, coalesce(ride_distance, 0) AS ride_distance FROM bronze"))
def q_fill_measures(spark, sf):
    return X.ride_bronze(spark, sf).select("_id", C.fill_zero("booking_value").alias("booking_value"),
                                           C.fill_zero("ride_distance").alias("ride_distance"))


@register("default_payment", O.with_layers("""
SELECT _id, CASE WHEN payment_method IS NULL OR lower(trim(payment_method)) = 'null' THEN 'Not Specified'
 ELSE trim(payment_method) END AS payment_method FROM bronze"""))
def q_default_payment(spark, sf):
    return X.ride_bronze(spark, sf).select("_id", C.default_payment("payment_method").alias("payment_method"))


_QUOTED = ("booking_id", "booking_status", "customer_id", "vehicle_type", "payment_method")


@register("strip_quotes", O.with_layers(
    "SELECT _id, " + ", ".join(f"trim(trim({c}), '\"') AS {c}" for c in _QUOTED) + " FROM silver"))
def q_strip_quotes(spark, sf):
    return X.ride_silver(spark, sf).select("_id", *[C.strip_quotes(c).alias(c) for c in _QUOTED])


@register("safe_ratio", O.with_layers(
    "SELECT _id, CASE WHEN ride_distance > 0 THEN booking_value / ride_distance ELSE CAST(0 AS DOUBLE) END "
    "AS revenue_per_km FROM silver"))
def q_safe_ratio(spark, sf):
    return X.ride_silver(spark, sf).select("_id", C.safe_ratio("booking_value", "ride_distance")
                                           .alias("revenue_per_km"))


@register("hash_uuid", O.with_layers(
    "SELECT booking_id, regexp_replace(md5(booking_id), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', "
    "'\\1-\\2-\\3-\\4-\\5') AS point_id FROM gold"))
def q_hash_uuid(spark, sf):
    return gold(spark, sf).select("booking_id", C.hash_uuid("booking_id").alias("point_id"))


@register("generate_key", O.with_layers(
    "SELECT booking_id, concat('BOK-', upper(substring(md5(booking_id), 1, 10))) AS new_key FROM gold"))
def q_generate_key(spark, sf):
    return gold(spark, sf).select("booking_id", C.generate_key("booking_id").alias("new_key"))


@register("hour_of_day", O.with_layers(
    "SELECT booking_id, CAST(hour(ride_timestamp) AS INTEGER) AS hour FROM gold"))
def q_hour_of_day(spark, sf):
    return gold(spark, sf).select("booking_id", C.hour_of_day("ride_timestamp").alias("hour"))


@register("round2", O.with_layers(
    "SELECT booking_id, CAST(round(CAST(revenue_per_km AS DECIMAL(38,10)), 2) AS DOUBLE) AS revenue_per_km FROM gold"))
def q_round2(spark, sf):
    return gold(spark, sf).select("booking_id", C.round_half_up("revenue_per_km", 2).alias("revenue_per_km"))


_TS_TEXT = ("CASE {d} % 3 WHEN 0 THEN strftime(ride_timestamp, '%Y-%m-%dT%H:%M:%S') "
            "WHEN 1 THEN concat(strftime(ride_timestamp, '%Y-%m-%dT%H:%M:%S'), 'Z') "
            "ELSE concat(strftime(ride_timestamp, '%Y-%m-%dT%H:%M:%S'), '+03:30') END")


@register("as_utc", O.with_layers(
    "SELECT booking_id, epoch_ms(CAST(CASE WHEN regexp_matches(t, '[Zz]') OR regexp_matches(t, '[+-]\\d{2}:?\\d{2}$') "
    "THEN t ELSE concat(t, 'Z') END AS TIMESTAMPTZ)) AS utc_ms FROM (SELECT booking_id, "
    + _TS_TEXT.format(d=_DIGITS) + " AS t FROM gold) x"))
def q_as_utc(spark, sf):
    g = gold(spark, sf)
    base = F.date_format("ride_timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    d = X.key_digits() % 3
    text = F.when(d == 0, base).when(d == 1, F.concat(base, F.lit("Z"))) \
        .otherwise(F.concat(base, F.lit("+03:30")))
    return g.select("booking_id", F.unix_millis(C.as_utc(text)).alias("utc_ms"))


@register("code_label", O.with_layers(f"""
SELECT g.*, coalesce(s.label, g.booking_status) AS status_label, coalesce(v.label, g.vehicle_type) AS vehicle_label,
 coalesce(p.label, coalesce(g.payment_method, '')) AS payment_label,
 CASE WHEN g.unified_cancellation_reason IS NULL OR g.unified_cancellation_reason = '' THEN ''
      ELSE coalesce(r.label, g.unified_cancellation_reason) END AS reason_label
FROM gold g
LEFT JOIN lab s ON s.kind = 'status' AND s.code = g.booking_status
LEFT JOIN lab v ON v.kind = 'vehicle' AND v.code = g.vehicle_type
LEFT JOIN lab p ON p.kind = 'payment' AND p.code = coalesce(g.payment_method, '')
LEFT JOIN lab r ON r.kind = 'reason' AND r.code = g.unified_cancellation_reason AND r.status = g.booking_status""",
    extra=_LABELS))
def q_code_label(spark, sf):
    return LB.label_rides(gold(spark, sf))


@register("format_number_text", O.with_layers(
    f"SELECT booking_id, coalesce(translate(printf('%.2f', booking_value), '0123456789.', "
    f"'{C.DISPLAY_DIGITS},'), '{C.DISPLAY_DIGITS[0]}') AS value_text FROM gold"))
def q_format_number_text(spark, sf):
    return gold(spark, sf).select("booking_id", C.format_number_text("booking_value", 2).alias("value_text"))


@register("calc_flags", _status_sql(
    "SELECT batch_id, status = 'Failed' AND step IN ('Silver', 'Gold') AS can_resume FROM sv"))
def q_calc_flags(spark, sf):
    return status_view(spark, sf).select("batch_id", C.can_resume("status", "step").alias("can_resume"))


# --- filters (F) -----------------------------------------------------------------


_F1_START, _F1_END = _dt.datetime(2024, 1, 10), _dt.datetime(2024, 1, 20, 12, 0)


@register("dashboard_filter", O.with_layers(
    "SELECT * FROM gold WHERE vehicle_type = 'Go Mini' AND ride_timestamp >= TIMESTAMP '2024-01-10 00:00:00' "
    "AND ride_timestamp <= TIMESTAMP '2024-01-20 12:00:00'"))
def q_dashboard_filter(spark, sf):
    return FL.dashboard_filter(gold(spark, sf), "Go Mini", _F1_START, _F1_END)


@register("ride_filter", O.with_layers(
    "SELECT * FROM gold WHERE booking_status = 'Cancelled by Driver' AND vehicle_type = 'Auto'"))
def q_ride_filter(spark, sf):
    return FL.ride_filter(gold(spark, sf), status="Cancelled by Driver", vehicle="Auto")


@register("valid_key", O.with_layers("SELECT * FROM bronze WHERE booking_id IS NOT NULL AND booking_id <> 'null'"))
def q_valid_key(spark, sf):
    return X.ride_bronze(spark, sf).where(FL.valid_key("booking_id"))


@register("exclude_value", O.with_layers("SELECT * FROM gold WHERE unified_cancellation_reason <> 'Not Cancelled'"))
def q_exclude_value(spark, sf):
    return gold(spark, sf).where(FL.exclude_value())


@register("in_list", O.with_layers("SELECT * FROM gold WHERE vehicle_type IN ('Uber XL', 'Premier Sedan', 'Go Sedan')"))
def q_in_list(spark, sf):
    return gold(spark, sf).where(FL.in_list("vehicle_type", R.SEGMENT_VEHICLES))


@register("range_predicates", O.with_layers(
    "SELECT * FROM gold WHERE booking_value > 300 AND ride_distance BETWEEN 5 AND 50"))
def q_range_predicates(spark, sf):
    return gold(spark, sf).where((F.col("booking_value") > 300) & FL.between("ride_distance", 5, 50))


@register("not_null", O.with_layers("SELECT * FROM gold WHERE driver_ratings IS NOT NULL"))
def q_not_null(spark, sf):
    return gold(spark, sf).where(FL.not_null("driver_ratings"))


@register("recent_interval", O.with_layers(
    "SELECT * FROM gold WHERE ride_timestamp >= TIMESTAMP '2024-02-10 00:00:00' - INTERVAL 1 MONTH"))
def q_recent_interval(spark, sf):
    return gold(spark, sf).where(FL.recent_interval("ride_timestamp", _dt.datetime(2024, 2, 10)))


@register("rating_check", O.with_layers("""
SELECT count(*) AS rows_checked,
 count(*) FILTER (WHERE NOT (driver_ratings IS NULL OR (driver_ratings >= 0 AND driver_ratings <= 5 AND NOT isnan(driver_ratings)))) AS bad_driver_ratings,
 count(*) FILTER (WHERE NOT (customer_rating IS NULL OR (customer_rating >= 0 AND customer_rating <= 5 AND NOT isnan(customer_rating)))) AS bad_customer_rating
FROM gold"""))
def q_rating_check(spark, sf):
    return M.quality_report(gold(spark, sf))


# --- CSV sources, layer tables and the medallion run -------------------------------


_CSV_TEXT = ", ".join(f"coalesce({c}, '') AS {c}" for c in (
    "ride_date", "ride_time", "booking_id", "booking_status", "customer_id", "vehicle_type",
    "cancelled_by_customer", "reason_customer", "cancelled_by_driver", "driver_reason",
    "incomplete_rides", "incomplete_reason", "booking_value", "ride_distance", "driver_ratings",
    "customer_rating", "payment_method"))


def _duck_date(c: str) -> str:
    return (f"CASE WHEN {_dn(c)} THEN NULL ELSE CAST(coalesce(try_strptime(trim({c}), '%Y-%m-%d'), "
            f"try_strptime(trim({c}), '%m/%d/%Y'), try_strptime(trim({c}), '%Y/%m/%d'), "
            f"try_strptime(trim({c}), '%d %b %Y')) AS DATE) END")


def _duck_flag(c: str) -> str:
    return f"CASE WHEN {_dn(c)} THEN NULL ELSE {c} = '1' END"


_PARSED = ("SELECT _id, _batch_id, " + _duck_date("ride_date") + " AS ride_date, ride_time, booking_id, "
           "booking_status, customer_id, vehicle_type, "
           + ", ".join(f"{_duck_flag(c)} AS {c}" if c.startswith(("cancelled", "incomplete_rides"))
                       else c for c in ("cancelled_by_customer", "reason_customer", "cancelled_by_driver",
                                        "driver_reason", "incomplete_rides", "incomplete_reason"))
           + ", " + ", ".join(f"{_duck_number(c)} AS {c}" for c in
                              ("booking_value", "ride_distance", "driver_ratings", "customer_rating"))
           + ", payment_method FROM csvt")
_P_SILVER = O.SILVER.replace("FROM bronze", "FROM pb").replace(
    "CAST(concat(CAST(ride_date AS VARCHAR),' ',ride_time) AS TIMESTAMP)",
    "CASE WHEN ride_date IS NULL THEN NULL ELSE CAST(concat(CAST(ride_date AS VARCHAR),' ',trim(ride_time)) AS TIMESTAMP) END")
_P_GOLD = O.GOLD.replace("FROM silver", "FROM ps")
_PIPE = {"csvt": f"SELECT _id, _batch_id, {_CSV_TEXT} FROM raw", "pb": _PARSED, "ps": _P_SILVER,
         "pg": _P_GOLD}


def _pipe_sql(body: str) -> str:
    return O.with_layers(body.replace("AS STRING", "AS VARCHAR"), raw=True, extra=_PIPE)


def _folder(spark, sf):
    return X.ride_csv_folder(spark, sf)


@register("csv_scan", _pipe_sql(f"SELECT {_CSV_TEXT} FROM raw"))
def q_csv_scan(spark, sf):
    base, _ = _folder(spark, sf)
    return CSV.csv_scan(spark, f"{base}/*")


_BROKEN = """CASE WHEN _id % 3 = 0 THEN concat('said "', coalesce(driver_reason, ''), '",', chr(10), chr(10), ' then', chr(13), chr(10), 'left')
 WHEN _id % 3 = 1 THEN concat(chr(10), customer_id, chr(13), 'x') ELSE driver_reason END"""


@register("csv_line_breaks", _pipe_sql(
    "SELECT " + ", ".join(f"coalesce({_BROKEN}, '') AS driver_reason" if c == "driver_reason" else f"coalesce({c}, '') AS {c}"
                          for c in M.sch.CSV_COLUMNS) + " FROM raw"))
def q_csv_line_breaks(spark, sf):
    """S1 on a folder whose quoted fields hold line breaks of all kinds."""
    path = work_path(spark, "csv-breaks")
    raw = X.ride_raw_text(spark, sf).withColumn("driver_reason", F.expr(_BROKEN))
    CSV.write_csv(raw.select(*M.sch.CSV_COLUMNS), path)
    return CSV.csv_scan(spark, path)


@register("csv_source_filter", _pipe_sql("SELECT _batch_id AS batch_folder, count(*) AS rows FROM raw GROUP BY 1"))
def q_csv_source_filter(spark, sf):
    base, _ = _folder(spark, sf)
    df = CSV.csv_scan(spark, f"{base}/*", with_file=True)
    return df.groupBy(F.regexp_extract("_file", r"/(batch-[0-9]+)/[^/]*$", 1).alias("batch_folder")) \
        .agg(F.count(F.lit(1)).alias("rows"))


_BRONZE_OUT = ["_batch_id", "ride_date", "ride_time", "booking_id", "booking_status", "customer_id",
               "vehicle_type", "cancelled_by_customer", "reason_customer", "cancelled_by_driver",
               "driver_reason", "incomplete_rides", "incomplete_reason", "booking_value", "ride_distance",
               "driver_ratings", "customer_rating", "payment_method"]


@register("to_bronze", _pipe_sql(f"SELECT {', '.join(_BRONZE_OUT)} FROM pb"))
def q_to_bronze(spark, sf):
    base, batches = _folder(spark, sf)
    parts = [M.to_bronze(CSV.csv_scan(spark, f"{base}/{b}"), b) for b in batches]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*_BRONZE_OUT)


def _pipeline(spark, sf, steps=("Bronze", "Silver", "Gold")) -> PL.Pipeline:
    base, batches = _folder(spark, sf)
    pipe = PL.Pipeline(spark, work_path(spark, "layers"))
    for b in batches:
        ok = pipe.to_bronze(b, f"{base}/{b}") >= 0
        if ok and "Silver" in steps:
            pipe.to_silver(b)
        if ok and "Gold" in steps:
            pipe.to_gold(b)
    return pipe


@register("bronze_load", _pipe_sql(f"SELECT {', '.join(_BRONZE_OUT)} FROM pb"))
def q_bronze_load(spark, sf):
    pipe = _pipeline(spark, sf, ("Bronze",))
    return LY.layer_scan(spark, pipe.bronze_path).select(*_BRONZE_OUT)


_SILVER_OUT = [
    "_batch_id", "ride_timestamp", "booking_id", "booking_status", "customer_id", "vehicle_type",
    "unified_cancellation_reason", "booking_value", "ride_distance", "driver_ratings",
    "customer_rating", "payment_method"]


@register("layer_scan", _pipe_sql(f"SELECT {', '.join(_SILVER_OUT)} FROM ps WHERE _batch_id = 'batch-1'"))
def q_layer_scan(spark, sf):
    pipe = _pipeline(spark, sf, ("Bronze", "Silver"))
    return LY.layer_scan(spark, pipe.silver_path, "batch-1").select(*_SILVER_OUT)


@register("batch_replace_sink", _pipe_sql(f"SELECT {', '.join(_SILVER_OUT)} FROM ps"))
def q_batch_replace_sink(spark, sf):
    pipe = _pipeline(spark, sf, ("Bronze", "Silver"))
    pipe.to_silver("batch-1")  # a rerun replaces the batch, it does not add to it
    return LY.layer_scan(spark, pipe.silver_path).select(*_SILVER_OUT)


@register("run_pipeline", _pipe_sql("SELECT * FROM pg"))
def q_run_pipeline(spark, sf):
    base, batches = _folder(spark, sf)
    pipe = PL.Pipeline(spark, work_path(spark, "layers"))
    for b, ok in pipe.run_folder(base, batches).items():
        if not ok:
            raise RuntimeError(pipe.status().where(F.col("batch_id") == b).first()["error_message"])
    return pipe.gold().select(*M.sch.GOLD_COLUMNS)


# --- vectors: embed, sync, search -------------------------------------------------


def _duck_embedding_sql(src: str, col: str, dims: int = V.DEFAULT_DIMS) -> str:
    """DuckDB text of the token-hash embedder over ``src``: adds ``embedding``."""
    toks = f"list_filter(string_split_regex(lower({col}), '[^a-z0-9]+'), lambda x: length(x) > 0)"
    marks = (f"list_transform({toks}, lambda t: {{'b': CAST(CAST('0x' || substring(md5(t), 1, 8) AS BIGINT) % {dims} AS INTEGER), "
             f"'s': CASE WHEN CAST('0x' || substring(md5(t), 9, 1) AS INTEGER) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END}})")
    raw_v = (f"list_transform(range({dims}), lambda i: coalesce(list_sum(list_transform(mk, "
             f"lambda m: CASE WHEN m.b = i THEN m.s ELSE 0.0::DOUBLE END)), 0.0::DOUBLE))")
    return (f"SELECT * EXCLUDE (mk, rv, nv), list_transform(rv, lambda x: CAST(CASE WHEN nv > 0 THEN x / nv ELSE 0.0 END AS FLOAT)) AS embedding "
            f"FROM (SELECT *, sqrt(list_sum(list_transform(rv, lambda y: y * y))) AS nv FROM "
            f"(SELECT *, {raw_v} AS rv FROM (SELECT *, {marks} AS mk FROM {src}) a) b) c")


_UUID = "regexp_replace(md5(booking_id), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"
_VEC = {
    "g2": f"SELECT *, {_DIGITS} AS _d FROM gold",
    "src": f"SELECT {_UUID} AS id, booking_id, unified_cancellation_reason AS reason FROM gold "
           f"WHERE unified_cancellation_reason <> 'Not Cancelled'",
    "idx": (f"SELECT {_UUID} AS id, unified_cancellation_reason AS reason, booking_id FROM g2 "
            f"WHERE unified_cancellation_reason <> 'Not Cancelled' AND _d % 5 <> 0 "
            f"UNION ALL SELECT {_UUID}, unified_cancellation_reason, booking_id FROM g2 "
            f"WHERE unified_cancellation_reason = 'Not Cancelled' AND _d % 97 = 0 "
            f"UNION ALL SELECT 'legacy-' || booking_id, unified_cancellation_reason, booking_id FROM g2 "
            f"WHERE unified_cancellation_reason <> 'Not Cancelled' AND _d % 53 = 0"),
    "ids": f"SELECT id FROM idx WHERE regexp_matches(id, '{V.UUID_PATTERN}')",
    "orph": "SELECT id FROM ids WHERE id NOT IN (SELECT id FROM src)",
    "miss": "SELECT * FROM src WHERE id NOT IN (SELECT id FROM ids)",
}


def _vec_sql(body: str) -> str:
    return O.with_layers(body, extra=_VEC)


def _sync(spark, sf):
    return X.vector_sync_fixture(spark, sf)


@register("embed_text", O.with_layers(
    "SELECT reason, embedding FROM emb", extra={
        "rs": "SELECT DISTINCT unified_cancellation_reason AS reason FROM gold "
              "WHERE unified_cancellation_reason <> 'Not Cancelled'",
        "emb": _duck_embedding_sql("rs", "reason")}))
def q_embed_text(spark, sf):
    r = gold(spark, sf).where(FL.exclude_value()).select(
        F.col("unified_cancellation_reason").alias("reason")).distinct()
    return r.select("reason", V.hashed_embedding("reason").alias("embedding"))


@register("vector_ids_scan", _vec_sql("SELECT id FROM ids"))
def q_vector_ids_scan(spark, sf):
    return V.index_ids(_sync(spark, sf)[1])


@register("orphan_ids", _vec_sql("SELECT id FROM orph"))
def q_orphan_ids(spark, sf):
    src, idx = _sync(spark, sf)
    return V.orphan_ids(idx, src)


@register("missing_ids", _vec_sql("SELECT id, booking_id, reason FROM miss"))
def q_missing_ids(spark, sf):
    src, idx = _sync(spark, sf)
    return V.missing_ids(src, idx)


@register("sync_plan", _vec_sql(
    "SELECT id, CAST(NULL AS VARCHAR) AS booking_id, CAST(NULL AS VARCHAR) AS reason, 'delete' AS action FROM orph "
    "UNION ALL SELECT id, booking_id, reason, 'insert' FROM miss"))
def q_sync_plan(spark, sf):
    src, idx = _sync(spark, sf)
    return V.sync_plan(src, idx)


@register("delete_guard", _vec_sql("""
SELECT i.n AS index_count, d.n AS delete_count, s.n AS source_count,
       d.n > 0 AND NOT (d.n = i.n AND s.n > 0) AS apply_deletes
FROM (SELECT count(*) AS n FROM ids) i, (SELECT count(*) AS n FROM orph) d, (SELECT count(*) AS n FROM src) s"""))
def q_delete_guard(spark, sf):
    src, idx = _sync(spark, sf)
    return V.delete_guard(src, idx)


@register("apply_sync", _vec_sql("""
SELECT id, reason, booking_id, true AS has_vector FROM idx WHERE id NOT IN (SELECT id FROM orph)
UNION ALL SELECT id, reason, booking_id, true FROM miss"""))
def q_apply_sync(spark, sf):
    src, idx = _sync(spark, sf)
    out = V.apply_sync(src, idx)
    return out.select("id", "reason", "booking_id", F.col("embedding").isNotNull().alias("has_vector"))


@register("vector_table_sink", _vec_sql("""
SELECT id, upper(reason) AS reason, booking_id FROM src
UNION ALL SELECT id, reason, booking_id FROM idx WHERE id NOT IN (SELECT id FROM src)"""))
def q_vector_table_sink(spark, sf):
    src, idx = _sync(spark, sf)
    pts = V.embed_distinct(src.withColumn("reason", F.upper("reason")), "reason")
    return V.upsert(idx, pts).select("id", "reason", "booking_id")


@register("cosine_topk", """
WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0),
 ix AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 s AS (SELECT q.query_id, ix.id,
         list_inner_product(q.qv, ix.v) / (sqrt(list_inner_product(q.qv, q.qv)) * sqrt(list_inner_product(ix.v, ix.v))) AS score
       FROM q CROSS JOIN ix)
SELECT query_id, id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) t WHERE rank <= 5""")
def q_cosine_topk(spark, sf):
    idx = X.embedding_index(spark, sf)
    out = V.cosine_topk(idx, X.embedding_queries(spark, sf), 5)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@register("cosine_topk_cells", """
SELECT count(*) AS queries, count(*) * least(5, (SELECT count(*) FROM embeddings)) AS neighbours, true AS recall_reached
FROM embeddings WHERE vec_id % 50 = 0""")
def q_cosine_topk_cells(spark, sf):
    """V5 over the index in cells, held against the exact search: 0.9 of the
    neighbours at least."""
    idx = X.embedding_index(spark, sf)
    cells = CL.build(idx, work_path(spark, "vector-cells"))
    return CL.recall_report(cells, idx, X.embedding_queries(spark, sf))


_SEARCH_TEXT = "driver asked me to cancel the ride"


def _dcos(a: str, b: str) -> str:
    a, b = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    return (f"list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * "
            f"sqrt(list_inner_product({b}, {b})))")


@register("semantic_rides", O.with_layers(f"""
SELECT {", ".join(C.GOLD_API_NAMES)}, (SELECT count(*) FROM hit) AS total_count
FROM hit ORDER BY {_NEWEST} LIMIT 20""", extra={
    **_VEC,
    "ix": ("SELECT id, reason, booking_id FROM idx WHERE id NOT IN (SELECT id FROM orph) "
           "UNION ALL SELECT id, reason, booking_id FROM miss"),
    "rs": "SELECT DISTINCT reason FROM ix",
    "emb": _duck_embedding_sql("rs", "reason"),
    "qt": f"SELECT '{_SEARCH_TEXT}' AS reason",
    "qe": _duck_embedding_sql("qt", "reason"),
    "sc": (f"SELECT ix.id, ix.booking_id, {_dcos('e.embedding', 'q.embedding')} AS score "
           f"FROM ix JOIN emb e ON e.reason = ix.reason CROSS JOIN qe q"),
    "top": "SELECT booking_id FROM sc ORDER BY score DESC, id LIMIT 5",
    "hit": "SELECT * FROM gold WHERE booking_id IN (SELECT booking_id FROM top)"}))
def q_semantic_rides(spark, sf):
    g = X.stored_gold(spark, sf)
    index = V.apply_sync(*X.vector_sync_fixture(spark, sf, g))
    return V.semantic_rides(g, index, _SEARCH_TEXT)


# --- streams --------------------------------------------------------------------


@register("stream_ingest", _pipe_sql("SELECT * FROM pg"))
def q_stream_ingest(spark, sf):
    base, _ = _folder(spark, sf)
    pipe = PL.Pipeline(spark, work_path(spark, "layers"))
    ST.stream_ingest(spark, f"{base}/*", pipe, available_now=True).awaitTermination()
    # A file is a batch; the oracle names the folder it came from.
    folder = F.regexp_extract("_batch_id", "^(batch-[0-9]+)-", 1).alias("_batch_id")
    return pipe.gold().select(*[folder if c == "_batch_id" else c for c in M.sch.GOLD_COLUMNS])


@register("stream_vector_sync", _vec_sql("""
SELECT id, reason, booking_id, true AS has_vector FROM idx WHERE id NOT IN (SELECT id FROM orph)
UNION ALL SELECT id, reason, booking_id, true FROM miss"""))
def q_stream_vector_sync(spark, sf):
    gold_path = work_path(spark, "gold")
    gold(spark, sf).write.parquet(gold_path)
    _, idx = X.vector_sync_fixture(spark, sf, spark.read.parquet(gold_path))
    index = ST.VectorIndex(spark, work_path(spark, "index"))
    index.write(idx)
    ST.stream_vector_sync(spark, gold_path, index, available_now=True).awaitTermination()
    return index.current().select("id", "reason", "booking_id",
                                  F.col("embedding").isNotNull().alias("has_vector"))


@register("stream_dashboard", O.with_layers(f"""
SELECT CAST(epoch(date_trunc('hour', ride_timestamp)) AS BIGINT) AS window_start, vehicle_type,
       count(*) AS total, count(*) FILTER (WHERE booking_status = 'Completed') AS completed,
       {_sum('booking_value')} AS revenue
FROM gold GROUP BY 1, 2"""))
def q_stream_dashboard(spark, sf):
    """After a first load with one batch twice as many rides, and its rerun."""
    gold_path, shares = work_path(spark, "gold"), work_path(spark, "dashboard")
    g = gold(spark, sf)
    twice = g.unionByName(g.where(F.col("_batch_id") == "batch-1"))
    for rows in (twice, g):
        rows.write.mode("overwrite").partitionBy("_batch_id").parquet(gold_path)
        ST.stream_dashboard(spark, gold_path, shares, available_now=True).awaitTermination()
    return ST.dashboard_table(spark, shares).select(F.unix_seconds("window_start").alias("window_start"), "vehicle_type",
                                  "total", "completed",
                                  F.round("revenue", SUM_PLACES).alias("revenue"))


# --- physical layout ---------------------------------------------------------------


_SEGMENT_SQL = ORACLES["segment_report"]


@register("clustered_gold", _SEGMENT_SQL)
def q_clustered_gold(spark, sf):
    path = LO.write_clustered(gold(spark, sf), work_path(spark, "gold-clustered"))
    return rounded(R.segment_report(LO.read_clustered(spark, path)),
                   avg_value=AVG_PLACES, total_distance=SUM_PLACES)


@register("plan_report", O.with_layers(f"""
SELECT layout, (SELECT count(*) FROM gold) AS rows_total, CAST(sum(total_rides) AS BIGINT) AS rows_aggregated, count(*) AS groups_out
FROM (VALUES ('plain'), ('clustered')) l(layout), ({_SEGMENT_BODY}) r GROUP BY layout"""))
def q_plan_report(spark, sf):
    plain = work_path(spark, "gold-plain")
    gold(spark, sf).write.parquet(plain)
    g = spark.read.parquet(plain)
    path = LO.write_clustered(g, work_path(spark, "gold-clustered"))
    return LO.plan_report({"plain": g, "clustered": LO.read_clustered(spark, path)})


# --- S8 CSV with inferred types; J2 / W2 first-row-wins -------------------------------

_RAW17 = ("ride_date", "ride_time", "booking_id", "booking_status", "customer_id", "vehicle_type",
          "cancelled_by_customer", "reason_customer", "cancelled_by_driver", "driver_reason",
          "incomplete_rides", "incomplete_reason", "booking_value", "ride_distance", "driver_ratings",
          "customer_rating", "payment_method")


def _eda_csv_col(c: str) -> str:
    if c == "incomplete_rides":      # the one column every value of which is an integer
        return f"CAST({c} AS INTEGER) AS {c}"
    return f"CASE WHEN coalesce({c}, '') IN ({_NA_LIST}) THEN NULL ELSE {c} END AS {c}"


@register("eda_csv_scan", _pipe_sql("SELECT " + ", ".join(_eda_csv_col(c) for c in _RAW17) + " FROM raw"))
def q_eda_csv_scan(spark, sf):
    base, _ = _folder(spark, sf)
    return CSV.eda_csv_scan(spark, f"{base}/*")


_G01 = O.GOLD.replace("FROM silver", "FROM s01")
_B2 = O.GOLD.replace("FROM silver", "FROM s2")
_FIRST = {"s01": "SELECT * FROM silver WHERE _batch_id IN ('batch-0', 'batch-1')",
          "s2": "SELECT * FROM silver WHERE _batch_id = 'batch-2'",
          "g01": _G01, "b2": _B2}


_ABSENT = O.with_layers(
    "SELECT * FROM b2 WHERE booking_id NOT IN (SELECT booking_id FROM g01)", extra=_FIRST)


@register("insert_if_absent", _ABSENT)
def q_insert_if_absent(spark, sf):
    silver = X.ride_silver(spark, sf)
    g01 = M.gold_from_silver(silver.where(F.col("_batch_id").isin("batch-0", "batch-1")))
    return M.to_gold(silver.where(F.col("_batch_id") == "batch-2"), g01, "batch-2")


@register("insert_if_absent_filtered", _ABSENT)
def q_insert_if_absent_filtered(spark, sf):
    """J2 into stored gold, reading the keys of the batches that their key
    filters do not exclude."""
    silver = X.ride_silver(spark, sf)
    path, filters = work_path(spark, "filtered-gold"), work_path(spark, "key-filters")
    M.gold_from_silver(silver.where(F.col("_batch_id").isin("batch-0", "batch-1"))) \
        .write.partitionBy("_batch_id").parquet(path)
    KF.key_filters(spark.read.parquet(path)).write.partitionBy("_batch_id").parquet(filters)
    return KF.to_gold(silver.where(F.col("_batch_id") == "batch-2"), spark.read.parquet(path),
                      LY.batch_names(spark, path), KF.read_filters(spark, filters), "batch-2")


@register("first_wins_dedup", O.with_layers("SELECT * FROM gold"))
def q_first_wins_dedup(spark, sf):
    """W2 over all batches: the first loaded row of every key."""
    return M.gold_from_silver(X.ride_silver(spark, sf))


@register("stream_changes", _cs_sql(_APPLIED))
def q_stream_changes(spark, sf):
    """M4 as a stream: the change set arrives as files, gold by batch."""
    cs = _cs(spark, sf)
    path = work_path(spark, "change-files")
    cs.write.parquet(path)
    gold_path = work_path(spark, "gold-batches")
    gold(spark, sf).write.partitionBy("_batch_id").parquet(gold_path)
    ST.stream_changes(spark, path, gold_path, cs.schema, available_now=True).awaitTermination()
    return spark.read.parquet(gold_path).select(*M.sch.GOLD_COLUMNS)
