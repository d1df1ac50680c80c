"""DuckDB oracle texts for the correctness gate.

The driver registers the parquet tables as views; the ride layers are inlined
as CTEs built once here as text. These texts are independent of the Spark
operators (written from the semantics, in plain SQL).
"""

from __future__ import annotations

from farebox.sources.fixtures import BRONZE_FROM_EVENTS_SQL, RAW_TEXT_FROM_BRONZE_SQL


def _tq(c: str) -> str:
    return f"trim(trim({c}), '\"')"


BRONZE = BRONZE_FROM_EVENTS_SQL.replace("{events}", "events")

SILVER = """
SELECT _id, _batch_id, CAST(concat(CAST(ride_date AS VARCHAR),' ',ride_time) AS TIMESTAMP) AS ride_timestamp,
 trim(booking_id) AS booking_id, trim(booking_status) AS booking_status, trim(customer_id) AS customer_id, trim(vehicle_type) AS vehicle_type,
 CASE WHEN booking_status='Cancelled by Customer' THEN reason_customer WHEN booking_status='Cancelled by Driver' THEN driver_reason WHEN booking_status='Incomplete' THEN incomplete_reason ELSE 'Not Cancelled' END AS unified_cancellation_reason,
 coalesce(booking_value,0) AS booking_value, coalesce(ride_distance,0) AS ride_distance, driver_ratings, customer_rating,
 CASE WHEN payment_method IS NULL OR lower(trim(payment_method))='null' THEN 'Not Specified' ELSE trim(payment_method) END AS payment_method
FROM bronze WHERE booking_id IS NOT NULL AND booking_id <> 'null'
"""

GOLD = f"""
SELECT booking_id, _batch_id, ride_timestamp, booking_status, customer_id, vehicle_type, unified_cancellation_reason, booking_value, ride_distance, revenue_per_km, driver_ratings, customer_rating, payment_method FROM (
 SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY _batch_id, _id) AS rn FROM (
  SELECT _id, _batch_id, ride_timestamp, {_tq('booking_id')} AS booking_id, {_tq('booking_status')} AS booking_status,
   {_tq('customer_id')} AS customer_id, {_tq('vehicle_type')} AS vehicle_type,
   unified_cancellation_reason, booking_value, ride_distance,
   CASE WHEN ride_distance > 0 THEN booking_value / ride_distance ELSE CAST(0 AS DOUBLE) END AS revenue_per_km,
   driver_ratings, customer_rating, {_tq('payment_method')} AS payment_method
  FROM silver)) WHERE rn = 1
"""

RAW = RAW_TEXT_FROM_BRONZE_SQL.replace("{bronze}", "bronze")


def with_layers(body: str, raw: bool = False, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the bronze/silver/gold CTEs (and raw text), then
    any ``extra`` named CTEs in order."""
    ctes = [f"bronze AS ({BRONZE})", f"silver AS ({SILVER})", f"gold AS ({GOLD})"]
    if raw:
        ctes.append(f"raw AS ({RAW})")
    for name, text in (extra or {}).items():
        ctes.append(f"{name} AS ({text})")
    return "WITH " + ",\n".join(ctes) + "\n" + body


def half_up_pct(num: str, den: str, places: int = 2) -> str:
    """num / den * 100 rounded half up to ``places``, exact in integers."""
    scale = 10 ** places
    return (f"CASE WHEN {den} > 0 THEN CAST(((2 * {num} * 100 * {scale}) + {den}) // (2 * {den}) AS DOUBLE)"
            f" / {scale} ELSE CAST(0 AS DOUBLE) END")
