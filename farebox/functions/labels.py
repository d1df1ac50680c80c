"""Display labels for codes (P17): a small dimension joined by broadcast.

The table is fixed by construction (a few dozen rows), so broadcasting it is
always within bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: display labels of the ride front end, by kind. ---
STATUS_LABELS = {
    "Completed": "تکمیل شده",
    "Cancelled by Driver": "لغو شده توسط راننده",
    "No Driver Found": "راننده یافت نشد",
    "Cancelled by Customer": "لغو شده توسط مشتری",
    "Incomplete": "ناقص",
    "InProgress": "در حال انجام",
    "Pending": "در انتظار",
    "Cancelled": "لغو شده",
}
VEHICLE_LABELS = {
    "Auto": "اتو",
    "Go Mini": "گو مینی",
    "Go Sedan": "گو سدان",
    "Bike": "موتور",
    "Premier Sedan": "سدان پریمیر",
    "eBike": "موتور برقی",
    "Uber XL": "اوبر ایکس‌ال",
    "Economy": "اکونومی",
    "Premium": "پریمیوم",
    "SUV": "شاسی بلند",
    "Luxury": "لوکس",
}
PAYMENT_LABELS = {
    "UPI": "UPI",
    "Cash": "نقدی",
    "Uber Wallet": "کیف پول اوبر",
    "Credit Card": "کارت اعتباری",
    "Debit Card": "کارت بانکی",
    "Card": "کارت",
    "Wallet": "کیف پول",
}
PAYMENT_UNKNOWN_LABEL = "نامشخص"
PAYMENT_UNKNOWN_CODES = ["", "NaN", "Not Specified"]
REASON_LABELS_BY_STATUS = {
    "Cancelled by Customer": {
        "Wrong Address": "آدرس اشتباه",
        "Change of plans": "تغییر برنامه",
        "Driver is not moving towards pickup location": "راننده به سمت مبدا حرکت نمی‌کند",
        "Driver asked to cancel": "راننده درخواست لغو کرد",
        "AC is not working": "کولر کار نمی‌کند",
    },
    "Cancelled by Driver": {
        "Customer related issue": "مشکل مربوط به مشتری",
        "The customer was coughing/sick": "مشتری سرفه می‌کرد/بیمار بود",
        "Personal & Car related issues": "مشکلات شخصی و مربوط به خودرو",
        "More than permitted people in there": "تعداد مسافر بیش از حد مجاز",
    },
    "Incomplete": {
        "Customer Demand": "درخواست مشتری",
        "Vehicle Breakdown": "خرابی خودرو",
        "Other Issue": "مشکل دیگر",
    },
}
REASON_SHORT_LABELS = {
    "Wrong Address": "آدرس اشتباه",
    "Change of plans": "تغییر برنامه",
    "Driver is not moving towards pickup location": "راننده حرکت نمی‌کند",
    "Driver asked to cancel": "درخواست راننده",
    "AC is not working": "کولر خراب",
    "Customer related issue": "مشکل مشتری",
    "The customer was coughing/sick": "مشتری بیمار",
    "Personal & Car related issues": "مشکلات شخصی",
    "More than permitted people in there": "مسافر اضافی",
    "Customer Demand": "درخواست مشتری",
    "Vehicle Breakdown": "خرابی خودرو",
    "Other Issue": "مشکل دیگر",
}
RUN_STATUS_LABELS = {"Success": "موفق", "Failed": "ناموفق", "Processing": "درحال پردازش"}
# --- end of fixed values ---


def label_rows() -> list[tuple[str, str | None, str, str]]:
    """(kind, status, code, label) rows of every label map."""
    rows = [("status", None, k, v) for k, v in STATUS_LABELS.items()]
    rows += [("vehicle", None, k, v) for k, v in VEHICLE_LABELS.items()]
    rows += [("payment", None, k, v) for k, v in PAYMENT_LABELS.items()]
    rows += [("payment", None, k, PAYMENT_UNKNOWN_LABEL) for k in PAYMENT_UNKNOWN_CODES]
    rows += [("reason", s, k, v) for s, m in REASON_LABELS_BY_STATUS.items() for k, v in m.items()]
    rows += [("reason_short", None, k, v) for k, v in REASON_SHORT_LABELS.items()]
    rows += [("run_status", None, k, v) for k, v in RUN_STATUS_LABELS.items()]
    return rows


def label_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(label_rows(), "kind string, status string, code string, label string")


def with_label(df: DataFrame, labels: DataFrame, kind: str, code_col: str,
               out_col: str, status_col: str | None = None) -> DataFrame:
    """Left join one label kind (broadcast: a fixed, tiny table); an unknown
    code keeps its own text. With ``status_col`` the label also depends on
    the status (reasons)."""
    lab = labels.where(F.col("kind") == kind)
    keys = ["code"] + (["status"] if status_col else [])
    lab = lab.select(*[F.col(k).alias(f"_lab_{k}") for k in keys], F.col("label").alias(out_col))
    cond = F.col(code_col).eqNullSafe(F.col("_lab_code"))
    if status_col:
        cond = cond & (F.col(status_col) == F.col("_lab_status"))
    j = df.join(F.broadcast(lab), cond, "left")
    return j.select(*df.columns, F.coalesce(F.col(out_col), F.col(code_col)).alias(out_col))


def label_rides(gold: DataFrame) -> DataFrame:
    """P17 over gold: status, vehicle, payment and status-dependent reason
    labels. Payment NULL counts as unknown; a missing reason gives ''."""
    spark = gold.sparkSession
    labels = label_table(spark)
    out = with_label(gold, labels, "status", "booking_status", "status_label")
    out = with_label(out, labels, "vehicle", "vehicle_type", "vehicle_label")
    pay = F.coalesce(F.col("payment_method"), F.lit(""))
    out = with_label(out.withColumn("_pay", pay), labels, "payment", "_pay", "payment_label").drop("_pay")
    out = with_label(out, labels, "reason", "unified_cancellation_reason", "reason_label",
                     status_col="booking_status")
    reason = F.col("unified_cancellation_reason")
    return out.withColumn("reason_label", F.when(reason.isNull() | (reason == ""), F.lit(""))
                          .otherwise(F.col("reason_label")))


def short_reasons(counts: DataFrame, reason: str = "reason") -> DataFrame:
    """P17 for charts of reasons: the short label of each as ``reason_label``;
    an unknown reason keeps its own text."""
    return with_label(counts, label_table(counts.sparkSession), "reason_short", reason, "reason_label")


def label_runs(status_view: DataFrame) -> DataFrame:
    """P17 over pipeline runs: the label of a run's status as ``status_label``."""
    return with_label(status_view, label_table(status_view.sparkSession), "run_status", "status", "status_label")


def labels_sql_values() -> str:
    """The label rows as a SQL VALUES list (for oracles)."""
    def q(x):
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({q(k)}, {q(s)}, {q(c)}, {q(v)})" for k, s, c, v in label_rows())


def label_expr(kind: str, code: Column) -> Column:
    """A label as an inline map lookup (no join) for one status-free kind."""
    rows = [(c, v) for k, s, c, v in label_rows() if k == kind]
    m = F.create_map(*[x for c, v in rows for x in (F.lit(c), F.lit(v))])
    return F.coalesce(F.try_element_at(m, code), code)
