"""Test inputs derived by Spark from the driver's tables.

Every fixture reads a given table (``events``, ``orders``, ``embeddings``) so
its size grows with the data; nothing here is made up or fixed-size, except
the literal label and parse-case tables that are dimension data by nature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The ride fixture's bronze layer as one SQL text, shared with the DuckDB
# oracle: padded and quoted keys, duplicates within and across batches,
# ``null`` and NULL keys, ``null`` texts, zero distances, padded status.
BRONZE_FROM_EVENTS_SQL = """
SELECT x.event_id AS _id, concat('batch-', CAST(x.event_id % 3 AS STRING)) AS _batch_id, CAST(x.ts AS DATE) AS ride_date,
 concat(lpad(CAST(hour(x.ts) AS STRING),2,'0'),':',lpad(CAST(minute(x.ts) AS STRING),2,'0'),':',lpad(CAST(second(x.ts) AS STRING),2,'0')) AS ride_time,
 CASE WHEN x.event_id % 211 = 0 THEN 'null' WHEN x.event_id % 223 = 0 THEN NULL
      ELSE concat(x.pad, '"CNR', lpad(CAST(x.n AS STRING),9,'0'), '"', x.pad) END AS booking_id,
 concat(x.pad, x.st) AS booking_status, concat('"CID', lpad(CAST(x.user_id AS STRING),7,'0'), '"') AS customer_id,
 CASE x.user_id % 7 WHEN 0 THEN 'Auto' WHEN 1 THEN 'Go Mini' WHEN 2 THEN 'Go Sedan' WHEN 3 THEN 'Bike' WHEN 4 THEN 'Premier Sedan' WHEN 5 THEN 'eBike' ELSE 'Uber XL' END AS vehicle_type,
 x.st = 'Cancelled by Customer' AS cancelled_by_customer,
 CASE WHEN x.st <> 'Cancelled by Customer' THEN 'null' WHEN x.event_id % 5 = 0 THEN 'Wrong Address' WHEN x.event_id % 5 = 1 THEN 'Change of plans' WHEN x.event_id % 5 = 2 THEN 'Driver is not moving towards pickup location' WHEN x.event_id % 5 = 3 THEN 'Driver asked to cancel' ELSE 'AC is not working' END AS reason_customer,
 x.st = 'Cancelled by Driver' AS cancelled_by_driver,
 CASE WHEN x.st <> 'Cancelled by Driver' THEN 'null' WHEN x.event_id % 4 = 0 THEN 'Customer related issue' WHEN x.event_id % 4 = 1 THEN 'The customer was coughing/sick' WHEN x.event_id % 4 = 2 THEN 'Personal & Car related issues' ELSE 'More than permitted people in there' END AS driver_reason,
 x.st = 'Incomplete' AS incomplete_rides,
 CASE WHEN x.st <> 'Incomplete' THEN 'null' WHEN x.event_id % 3 = 0 THEN 'Customer Demand' WHEN x.event_id % 3 = 1 THEN 'Vehicle Breakdown' ELSE 'Other Issue' END AS incomplete_reason,
 CASE WHEN x.st IN ('Completed','Incomplete') THEN x.value * CAST(10 AS DOUBLE) END AS booking_value,
 CASE WHEN x.st IN ('Completed','Incomplete') THEN CAST(x.k AS DOUBLE) / CAST(2 AS DOUBLE) END AS ride_distance,
 CASE WHEN x.st = 'Completed' THEN CAST(30 + x.event_id % 21 AS DOUBLE) / CAST(10 AS DOUBLE) END AS driver_ratings,
 CASE WHEN x.st = 'Completed' THEN CAST(50 - x.event_id % 19 AS DOUBLE) / CAST(10 AS DOUBLE) END AS customer_rating,
 CASE WHEN x.st NOT IN ('Completed','Incomplete') THEN 'null' WHEN x.event_id % 5 = 0 THEN ' UPI ' WHEN x.event_id % 5 = 1 THEN 'Cash' WHEN x.event_id % 5 = 2 THEN 'Uber Wallet' WHEN x.event_id % 5 = 3 THEN 'Credit Card' ELSE 'Debit Card' END AS payment_method
FROM (SELECT e.*, CAST(regexp_extract(e.props,'([0-9]+)',1) AS INT) AS k,
  CASE WHEN e.event_id % 50 = 49 THEN e.event_id - 1 WHEN e.event_id % 60 = 33 THEN e.event_id - 3 ELSE e.event_id END AS n,
  CASE WHEN e.event_id % 17 = 0 THEN '  ' ELSE '' END AS pad,
  CASE e.event_type WHEN 'purchase' THEN 'Completed' WHEN 'view' THEN 'Completed' WHEN 'click' THEN 'Cancelled by Customer' WHEN 'error' THEN 'Cancelled by Driver' ELSE CASE WHEN e.event_id % 2 = 0 THEN 'Incomplete' ELSE 'No Driver Found' END END AS st
  FROM {events} e) x
"""


def ride_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze ride rows derived from ``events`` (three batches)."""
    events = table(spark, sf_dir, "events")
    return spark.sql(BRONZE_FROM_EVENTS_SQL, events=events)


def ride_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    from farebox.operators import medallion
    return medallion.to_silver(ride_bronze(spark, sf_dir))


def ride_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold ride rows: all batches loaded in name order, first row wins."""
    from farebox.operators import medallion
    return medallion.gold_from_silver(ride_silver(spark, sf_dir))


def stored_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ride_gold`` written once and read from there, for what reads it more
    than once: each read would derive it from the events anew."""
    from farebox.session import work_path
    path = work_path(spark, "ride-gold")
    ride_gold(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


# Raw CSV text of the ride fixture, with the quirks of hand-made files:
# flags as 1 / 0 / 1.0 / ' 1' / '' / NULL, numbers with blanks, thousands
# commas, exponents, junk and Java float suffixes, dates in two layouts and
# invalid ones. One SQL text for Spark and the DuckDB oracle.
RAW_TEXT_FROM_BRONZE_SQL = """
SELECT b._id AS _id, b._batch_id AS _batch_id,
 CASE WHEN b._id % 13 = 0 THEN NULL WHEN b._id % 11 = 0 THEN 'null'
      WHEN b._id % 7 = 0 THEN concat(lpad(CAST(month(b.ride_date) AS STRING),2,'0'),'/',lpad(CAST(day(b.ride_date) AS STRING),2,'0'),'/',CAST(year(b.ride_date) AS STRING))
      WHEN b._id % 29 = 0 THEN '2024-13-01'
      ELSE CAST(b.ride_date AS STRING) END AS ride_date,
 b.ride_time AS ride_time, b.booking_id AS booking_id, b.booking_status AS booking_status,
 b.customer_id AS customer_id, b.vehicle_type AS vehicle_type,
 CASE WHEN b._id % 19 = 0 THEN ' null ' WHEN b._id % 23 = 0 THEN '' WHEN b._id % 31 = 0 THEN '1.0'
      WHEN b._id % 37 = 0 THEN ' 1' WHEN b.cancelled_by_customer THEN '1' ELSE '0' END AS cancelled_by_customer,
 b.reason_customer AS reason_customer,
 CASE WHEN b._id % 41 = 0 THEN 'NULL' WHEN b.cancelled_by_driver THEN '1' ELSE '0' END AS cancelled_by_driver,
 b.driver_reason AS driver_reason,
 CASE WHEN b.incomplete_rides THEN '1' ELSE '0' END AS incomplete_rides,
 b.incomplete_reason AS incomplete_reason,
 CASE WHEN b.booking_value IS NULL THEN 'null' WHEN b._id % 43 = 0 THEN 'abc' WHEN b._id % 47 = 0 THEN '1.0d'
      WHEN b._id % 53 = 0 THEN '1,234.5' WHEN b._id % 59 = 0 THEN '1e3' WHEN b._id % 61 = 0 THEN ''
      WHEN b._id % 67 = 0 THEN concat(' ', CAST(b.booking_value AS STRING), ' ')
      ELSE CAST(b.booking_value AS STRING) END AS booking_value,
 CASE WHEN b.ride_distance IS NULL THEN 'null' ELSE CAST(b.ride_distance AS STRING) END AS ride_distance,
 CASE WHEN b.driver_ratings IS NULL THEN 'null' ELSE CAST(b.driver_ratings AS STRING) END AS driver_ratings,
 CASE WHEN b.customer_rating IS NULL THEN 'null' ELSE CAST(b.customer_rating AS STRING) END AS customer_rating,
 b.payment_method AS payment_method
FROM {bronze} b
"""


def ride_raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ride fixture as the text an uploaded CSV would carry."""
    return spark.sql(RAW_TEXT_FROM_BRONZE_SQL, bronze=ride_bronze(spark, sf_dir))


def step_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipeline step events derived from ``orders``.

    batch_id = customer key, seq = order key, event_time = order date,
    step from the order status (P Bronze, O Silver, F Gold), status from the
    priority digit (1-2 Failed, 3 Processing, otherwise Success).
    """
    o = table(spark, sf_dir, "orders")
    digit = F.substring(F.col("o_orderpriority"), 1, 1)
    return o.select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").cast("string").alias("batch_id"),
        F.when(F.col("o_orderstatus") == "P", "Bronze")
         .when(F.col("o_orderstatus") == "O", "Silver").otherwise("Gold").alias("step"),
        F.when(digit.isin("1", "2"), "Failed").when(digit == "3", "Processing")
         .otherwise("Success").alias("status"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("event_time"),
        F.round(F.col("o_totalprice")).cast("long").alias("rows"),
        F.when(digit.isin("1", "2"), F.concat(F.lit("error in order "), F.col("o_orderkey").cast("string")))
         .alias("error"),
    )


def embedding_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector points from ``embeddings``: id, embedding, label as reason."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"), "embedding",
                    F.col("label").cast("string").alias("reason"),
                    F.col("vec_id").cast("string").alias("booking_id"))


#: Every vector whose id this divides is a query.
QUERY_VECTOR_STEP = 50


def embedding_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors: the points whose vec_id is divisible by 50."""
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") % QUERY_VECTOR_STEP == 0).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def key_digits(c: str = "booking_id"):
    return F.regexp_extract(F.col(c), r"(\d+)", 1).cast("long")


def change_set(spark: SparkSession, sf_dir: str, gold: DataFrame | None = None) -> DataFrame:
    """Change set over gold (``gold``, where already stored), by the key's digits
    (the first that divides them):

    * 101: delete; 97: update (to Cancelled by Driver / 'Other Issue');
    * 89: insert of a copy under the key 'NEW-' + key;
    * 83: delete, then insert under the same key with 1 more value;
    * 79: insert under 'NEW-' + key, then update of it;
    * 73: update, then delete.

    seq = 3 x digits, plus 1 for the second operation of a key.
    """
    g = (gold if gold is not None else ride_gold(spark, sf_dir)).withColumn("_d", key_digits())
    kind = F.lit(None).cast("string")
    for mod, name in ((73, "update delete"), (79, "insert update"), (83, "delete insert"),
                      (89, "insert"), (97, "update"), (101, "delete")):
        kind = F.when(F.col("_d") % mod == 0, F.lit(name)).otherwise(kind)
    ops = g.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        "*", F.posexplode(F.split("kind", " ")).alias("_n", "op"))
    is_insert, is_update = F.col("op") == "insert", F.col("op") == "update"
    renamed = F.col("kind").isin("insert", "insert update")
    value = F.when(F.col("kind") == "delete insert", F.col("booking_value") + 1) \
        .otherwise(F.col("booking_value"))
    inserted = ["ride_timestamp", "customer_id", "vehicle_type", "ride_distance",
                "driver_ratings", "customer_rating", "payment_method"]
    return ops.select(
        (F.col("_d") * 3 + F.col("_n")).alias("seq"), "op",
        F.when(renamed, F.concat(F.lit("NEW-"), "booking_id")).otherwise(F.col("booking_id"))
         .alias("booking_id"),
        F.when(is_update, F.lit("Cancelled by Driver")).alias("booking_status"),
        F.when(is_update, F.lit("Other Issue")).alias("unified_cancellation_reason"),
        F.when(is_insert, value).alias("booking_value"),
        *[F.when(is_insert, F.col(c)).alias(c) for c in inserted])


# A statement log for the SQL guard: every conversation turn as it stands,
# plus one lookup statement per gold ride in one of eight shapes (fenced,
# WITH, a forbidden word inside a literal, pg_sleep, LIMIT in a subquery,
# DELETE, padded with a trailing semicolon). One SQL text for both engines.
STATEMENT_LOG_SQL = """
SELECT concat('conv-', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS stmt_id, text AS sql FROM {conversations}
UNION ALL
SELECT concat('ride-', booking_id) AS stmt_id,
 CASE CAST(regexp_extract(booking_id, '([0-9]+)', 1) AS BIGINT) % 8
  WHEN 0 THEN concat('SELECT * FROM gold.dataset WHERE booking_id = ''', booking_id, '''')
  WHEN 1 THEN concat('```sql', chr(10), 'SELECT booking_value FROM gold.dataset WHERE booking_id = ''', booking_id, ''';', chr(10), '```')
  WHEN 2 THEN concat('WITH x AS (SELECT * FROM gold.dataset) SELECT * FROM x WHERE booking_id = ''', booking_id, '''')
  WHEN 3 THEN concat('SELECT * FROM gold.dataset WHERE unified_cancellation_reason = ''drop'' AND booking_id = ''', booking_id, '''')
  WHEN 4 THEN concat('select pg_sleep(1), booking_id from gold.dataset where booking_id = ''', booking_id, ''';;')
  WHEN 5 THEN concat('SELECT * FROM (SELECT * FROM gold.dataset LIMIT 5) t WHERE booking_id = ''', booking_id, '''')
  WHEN 6 THEN concat('DELETE FROM gold.dataset WHERE booking_id = ''', booking_id, '''')
  ELSE concat('  SELECT count(*) FROM gold.dataset WHERE customer_id = ''', customer_id, ''' ; ')
 END AS sql
FROM {gold}
"""


def statement_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STATEMENT_LOG_SQL, conversations=table(spark, sf_dir, "conversations"),
                     gold=ride_gold(spark, sf_dir))


def _put_file(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(p, True)
    if text:
        out.write(bytearray(text.encode("utf-8")))
    out.close()


# Rows of one CSV file of the drop folder, about.
CSV_ROWS_PER_FILE = 1_000_000


def ride_csv_folder(spark: SparkSession, sf_dir: str, base: str | None = None) -> tuple[str, list[str]]:
    """Write the raw ride text as a drop folder: several CSV files per batch,
    rows in load order over their names, plus an empty ``.CSV`` and a ``.txt`` file that the source must
    skip. Returns (folder, batch ids in name order)."""
    from farebox.session import work_path
    from farebox.sources.csv import write_csv
    base = base or work_path(spark, "ride-csv")
    raw = ride_raw_text(spark, sf_dir)
    # The batches and their sizes: three by construction of the fixture.
    sizes = raw.groupBy("_batch_id").agg(F.count(F.lit(1)).alias("n")).orderBy("_batch_id").collect()
    batches = [r["_batch_id"] for r in sizes]
    jvm = spark.sparkContext._jvm
    for i, (b, n) in enumerate(sizes):
        rows = (raw.where(F.col("_batch_id") == b)
                .repartitionByRange(2 + n // CSV_ROWS_PER_FILE, "_id").sortWithinPartitions("_id")
                .drop("_id", "_batch_id"))
        write_csv(rows, f"{base}/{b}")
        _put_file(spark, f"{base}/{b}/empty.CSV", "")
        _put_file(spark, f"{base}/{b}/notes.txt", "not,a,ride\n1,2,3\n")
        # Arrival order = batch order (a file stream takes files by time).
        folder = jvm.org.apache.hadoop.fs.Path(f"{base}/{b}")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        paths = sorted((st.getPath() for st in fs.listStatus(folder)), key=lambda p: p.getName())
        for k, path in enumerate(paths):
            fs.setTimes(path, 1_700_000_000_000 + i * 60_000_000 + k * 1_000, -1)
    return base, batches


def vector_sync_fixture(spark: SparkSession, sf_dir: str, gold: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(source, index) for the vector sync, both derived from gold (``gold``,
    where already stored).

    source = cancelled rides; index = cancelled rides whose key digits mod 5
    are not 0 (the rest are missing), rides that are not cancelled and whose
    digits mod 97 are 0 (orphans), and non-UUID legacy ids for digits mod 53
    = 0 (skipped by the id scan).
    """
    from farebox.functions import columns as C
    from farebox.operators import vectors as V
    g = (gold if gold is not None else ride_gold(spark, sf_dir)).withColumn("_d", key_digits())
    source = V.sync_source(g)
    reason = F.col("unified_cancellation_reason")
    point = [F.col("id"), F.col("embedding"), reason.alias("reason"), F.col("booking_id")]
    g = V.embed_distinct(g, "unified_cancellation_reason")
    cancelled = g.where(reason != "Not Cancelled")
    kept = cancelled.where(F.col("_d") % 5 != 0).withColumn("id", C.hash_uuid("booking_id"))
    orphans = g.where((reason == "Not Cancelled") & (F.col("_d") % 97 == 0)) \
        .withColumn("id", C.hash_uuid("booking_id"))
    legacy = cancelled.where(F.col("_d") % 53 == 0).withColumn(
        "id", F.concat(F.lit("legacy-"), F.col("booking_id")))
    index = kept.select(*point).unionByName(orphans.select(*point)).unionByName(legacy.select(*point))
    return source, index
