"""Table schemas of the ride data model and its closed value sets."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
D = T.DoubleType()
B = T.BooleanType()
L = T.LongType()
NTZ = T.TimestampNTZType()

# Uploaded CSV: 17 text columns, read by position (header names ignored).
CSV_COLUMNS = [
    "ride_date", "ride_time", "booking_id", "booking_status", "customer_id",
    "vehicle_type", "cancelled_by_customer", "reason_customer",
    "cancelled_by_driver", "driver_reason", "incomplete_rides",
    "incomplete_reason", "booking_value", "ride_distance", "driver_ratings",
    "customer_rating", "payment_method",
]
CSV_SCHEMA = T.StructType([T.StructField(c, S, True) for c in CSV_COLUMNS])
CORRUPT_COLUMN = "_corrupt_record"
CSV_SCHEMA_WITH_CORRUPT = T.StructType(
    CSV_SCHEMA.fields + [T.StructField(CORRUPT_COLUMN, S, True)])

FLAG_COLUMNS = ["cancelled_by_customer", "cancelled_by_driver", "incomplete_rides"]
NUMBER_COLUMNS = ["booking_value", "ride_distance", "driver_ratings", "customer_rating"]
TEXT_COLUMNS = [c for c in CSV_COLUMNS if c not in FLAG_COLUMNS + NUMBER_COLUMNS + ["ride_date"]]

BRONZE_SCHEMA = T.StructType([
    T.StructField("_id", L, True),
    T.StructField("_batch_id", S, True),
    T.StructField("_ingested_at", NTZ, True),
    T.StructField("ride_date", T.DateType(), True),
    T.StructField("ride_time", S, True),
    T.StructField("booking_id", S, True),
    T.StructField("booking_status", S, True),
    T.StructField("customer_id", S, True),
    T.StructField("vehicle_type", S, True),
    T.StructField("cancelled_by_customer", B, True),
    T.StructField("reason_customer", S, True),
    T.StructField("cancelled_by_driver", B, True),
    T.StructField("driver_reason", S, True),
    T.StructField("incomplete_rides", B, True),
    T.StructField("incomplete_reason", S, True),
    T.StructField("booking_value", D, True),
    T.StructField("ride_distance", D, True),
    T.StructField("driver_ratings", D, True),
    T.StructField("customer_rating", D, True),
    T.StructField("payment_method", S, True),
])

SILVER_COLUMNS = [
    "_id", "_batch_id", "ride_timestamp", "booking_id", "booking_status",
    "customer_id", "vehicle_type", "unified_cancellation_reason",
    "booking_value", "ride_distance", "driver_ratings", "customer_rating",
    "payment_method",
]

GOLD_COLUMNS = [
    "booking_id", "_batch_id", "ride_timestamp", "booking_status",
    "customer_id", "vehicle_type", "unified_cancellation_reason",
    "booking_value", "ride_distance", "revenue_per_km", "driver_ratings",
    "customer_rating", "payment_method",
]

GOLD_SCHEMA = T.StructType([
    T.StructField("booking_id", S, True),
    T.StructField("_batch_id", S, True),
    T.StructField("ride_timestamp", NTZ, True),
    T.StructField("booking_status", S, True),
    T.StructField("customer_id", S, True),
    T.StructField("vehicle_type", S, True),
    T.StructField("unified_cancellation_reason", S, True),
    T.StructField("booking_value", D, True),
    T.StructField("ride_distance", D, True),
    T.StructField("revenue_per_km", D, True),
    T.StructField("driver_ratings", D, True),
    T.StructField("customer_rating", D, True),
    T.StructField("payment_method", S, True),
])

STEP_EVENT_SCHEMA = T.StructType([
    T.StructField("seq", L, True),
    T.StructField("batch_id", S, True),
    T.StructField("step", S, True),
    T.StructField("status", S, True),
    T.StructField("event_time", NTZ, True),
    T.StructField("rows", L, True),
    T.StructField("error", S, True),
])

VECTOR_SCHEMA = T.StructType([
    T.StructField("id", S, False),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
    T.StructField("reason", S, True),
    T.StructField("booking_id", S, True),
])

# --- Fixed values: these must equal the source application's values. ---
# Booking statuses, vehicle types and payment methods of the ride data.
STATUSES = ["Completed", "Cancelled by Driver", "No Driver Found",
            "Cancelled by Customer", "Incomplete"]
VEHICLES = ["Auto", "Go Mini", "Go Sedan", "Bike", "Premier Sedan", "eBike", "Uber XL"]
PAYMENTS = ["UPI", "Cash", "Uber Wallet", "Credit Card", "Debit Card", "Not Specified"]
# Cancellation reasons, by the status that carries them.
CUSTOMER_REASONS = ["Wrong Address", "Change of plans",
                    "Driver is not moving towards pickup location",
                    "Driver asked to cancel", "AC is not working"]
DRIVER_REASONS = ["Customer related issue", "The customer was coughing/sick",
                  "Personal & Car related issues", "More than permitted people in there"]
INCOMPLETE_REASONS = ["Customer Demand", "Vehicle Breakdown", "Other Issue"]
NOT_CANCELLED = "Not Cancelled"
NOT_SPECIFIED = "Not Specified"
STATUS_CUSTOMER_CANCEL = "Cancelled by Customer"
STATUS_DRIVER_CANCEL = "Cancelled by Driver"
STATUS_INCOMPLETE = "Incomplete"
STATUS_COMPLETED = "Completed"
# Pipeline steps and step states.
STEPS = ["Bronze", "Silver", "Gold"]
STEP_STATES = ["Processing", "Success", "Failed"]
# --- end of fixed values ---
