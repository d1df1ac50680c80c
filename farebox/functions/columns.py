"""Scalar column expressions: parsing, cleaning and derived values.

Every function takes and returns a ``Column`` built from built-in Spark
expressions, so it stays inside whole-stage codegen and costs nothing extra
when Catalyst folds it into the surrounding projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from farebox import schemas as sch

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Blank (any whitespace) or the text ``null`` in any case, with blanks around.
NULLISH_PATTERN = r"^\s*(?i:null)?\s*$"


def is_nullish(c: ColumnOrName) -> Column:
    """NULL, blank, or the word ``null`` (trimmed, any case)."""
    c = _c(c)
    return c.isNull() | c.rlike(NULLISH_PATTERN)


def parse_flag(c: ColumnOrName) -> Column:
    """Nullish -> NULL; otherwise true only for exactly ``1``."""
    c = _c(c)
    return F.when(is_nullish(c), F.lit(None).cast("boolean")).otherwise(c == F.lit("1"))


def parse_number(c: ColumnOrName) -> Column:
    """Nullish or unparseable -> NULL; blanks, exponent and thousands
    commas (in the integer part) allowed; never fails."""
    c = _c(c)
    body = F.trim(c)
    bad = (
        body.rlike(r"[dDfF]$")            # Java-style float suffixes are not numbers
        | body.rlike(r"\..*,")            # a comma after the decimal point
        | body.rlike(r"^[+-]?,")          # a leading group separator
        | body.rlike(r"(?i)[+-]?(inf|infinity|nan)")   # words, not numbers
    )
    cleaned = F.regexp_replace(body, ",", "")
    return (F.when(is_nullish(c) | bad, F.lit(None).cast("double"))
            .otherwise(cleaned.try_cast("double")))


DEFAULT_DATE_LAYOUTS = ("yyyy-MM-dd", "M/d/yyyy", "yyyy/M/d", "d MMM yyyy")


def parse_date(c: ColumnOrName, layouts: Sequence[str] = DEFAULT_DATE_LAYOUTS) -> Column:
    """Nullish or unparseable -> NULL; first layout that parses wins."""
    c = _c(c)
    body = F.trim(c)
    tries = [F.try_to_timestamp(body, F.lit(fmt)).cast("date") for fmt in layouts]
    return F.when(is_nullish(c), F.lit(None).cast("date")).otherwise(F.coalesce(*tries))


TIME_PATTERN = r"^\s*\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?\s*$"

# Hours 1 to 12 with AM or PM: (hour, rest of the clock, half of the day).
HALF_DAY_PATTERN = r"^\s*(0?[1-9]|1[0-2])(:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)\s*([AaPp][Mm])\s*$"


def combine_timestamp(date: ColumnOrName, time: ColumnOrName) -> Column:
    """P5: date + text time (24 hours, or 12 with AM / PM) -> zone-less timestamp.

    NULL time or NULL date gives NULL; a time text that is not a clock time
    (including the empty text) fails the whole job, as the source's cast does.
    """
    date, time = _c(date), _c(time)
    half = F.upper(F.regexp_extract(time, HALF_DAY_PATTERN, 3))
    hour = F.regexp_extract(time, HALF_DAY_PATTERN, 1).try_cast("int")
    clock = F.when(half != "", F.concat(
        F.lpad((hour % 12 + F.when(half == "PM", 12).otherwise(0)).cast("string"), 2, "0"),
        F.regexp_extract(time, HALF_DAY_PATTERN, 2))).otherwise(F.trim(time))
    ts = F.concat(date.cast("string"), F.lit(" "), clock).cast("timestamp_ntz")
    return (F.when(time.isNull(), F.lit(None).cast("timestamp_ntz"))
            .when(~(time.rlike(TIME_PATTERN) | time.rlike(HALF_DAY_PATTERN)),
                  F.raise_error(F.concat(F.lit("invalid input syntax for type time: "),
                                         time)).cast("timestamp_ntz"))
            .when(date.isNull(), F.lit(None).cast("timestamp_ntz"))
            .otherwise(ts))


def trim_spaces(c: ColumnOrName) -> Column:
    """Strip spaces (spaces only, tabs kept)."""
    return F.trim(_c(c))


def unify_reason(status: ColumnOrName, reason_customer: ColumnOrName,
                 driver_reason: ColumnOrName, incomplete_reason: ColumnOrName) -> Column:
    """One reason column chosen by the (untrimmed) status."""
    status = _c(status)
    return (F.when(status == sch.STATUS_CUSTOMER_CANCEL, _c(reason_customer))
            .when(status == sch.STATUS_DRIVER_CANCEL, _c(driver_reason))
            .when(status == sch.STATUS_INCOMPLETE, _c(incomplete_reason))
            .otherwise(F.lit(sch.NOT_CANCELLED)))


def fill_zero(c: ColumnOrName) -> Column:
    """NULL measure -> 0."""
    return F.coalesce(_c(c), F.lit(0.0))


def default_payment(c: ColumnOrName) -> Column:
    """NULL or ``null`` text -> 'Not Specified', otherwise trimmed."""
    c = _c(c)
    return (F.when(c.isNull() | (F.lower(F.trim(c)) == "null"), F.lit(sch.NOT_SPECIFIED))
            .otherwise(F.trim(c)))


def strip_quotes(c: ColumnOrName) -> Column:
    """P10: trim spaces, then every double quote at both ends."""
    return F.btrim(F.trim(_c(c)), F.lit('"'))


def safe_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Num / den when den > 0, otherwise 0 (no ANSI division error)."""
    num, den = _c(num), _c(den)
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def hash_uuid(c: ColumnOrName) -> Column:
    """MD5 hex of the UTF-8 text, laid out as a UUID (8-4-4-4-12)."""
    return F.regexp_replace(F.md5(_c(c).cast("string")),
                            r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def generate_key(seed: ColumnOrName | None = None, prefix: str = "BOK-") -> Column:
    """Prefix + 10 upper-case hex digits.

    With ``seed`` the key is a hash of it (repeatable); without, random.
    """
    src = F.md5(_c(seed).cast("string")) if seed is not None else F.regexp_replace(
        F.uuid(), "-", "")
    return F.concat(F.lit(prefix), F.upper(F.substring(src, 1, 10)))


def hour_of_day(c: ColumnOrName) -> Column:
    """Hour 0-23."""
    return F.hour(_c(c))


def round_half_up(c: ColumnOrName, places: int = 2) -> Column:
    """Decimal rounding, half away from zero; returned as double."""
    return F.round(_c(c).cast("decimal(38,10)"), places).cast("double")


def pct_half_up(num: ColumnOrName, den: ColumnOrName, places: int = 2) -> Column:
    """num / den * 100 in exact decimal arithmetic, rounded half up; double."""
    num, den = _c(num), _c(den)
    q = num.cast("decimal(20,0)") * F.lit(100) / den.cast("decimal(20,0)")
    return F.round(q, places).cast("double")


def as_utc(c: ColumnOrName) -> Column:
    """Timestamp text; no zone given means UTC, a Z or offset is kept."""
    c = _c(c)
    zoned = c.rlike(r"[Zz]") | c.rlike(r"[+-]\d{2}:?\d{2}$")
    # A lowercase UTC designator is accepted like 'Z' (Spark's parser wants 'Z').
    text = F.when(zoned, F.regexp_replace(c, "z$", "Z")).otherwise(F.concat(c, F.lit("Z")))
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("timestamp")).otherwise(
        F.try_to_timestamp(text))


# --- Fixed values: display formats of the ride front end. ---
# Digits zero to nine of the display script; the decimal point shows as ','.
DISPLAY_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
# Duration units: milliseconds, seconds, minutes, and seconds after minutes.
UNIT_MS = " م.ث"
UNIT_S = " ث"
UNIT_MIN = "د "
UNIT_MIN_S = "ث"
# --- end of fixed values ---


def format_number_text(c: ColumnOrName, places: int | None = None,
                       digits: str = DISPLAY_DIGITS, null_as_zero: bool = True,
                       grouping: bool = False) -> Column:
    """Number -> display text: fixed places (or as is), digits swapped
    for ``digits``, decimal point as comma; NULL -> the zero digit."""
    c = _c(c)
    if places is None:
        # As the page prints a number: an integral value without '.0'.
        integral = (c == F.floor(c)) & (F.abs(c) < F.lit(1e15))
        text = F.when(integral, c.cast("long").cast("string")).otherwise(c.cast("string"))
    elif grouping:
        text = F.format_number(c, places)
    else:
        # format_string renders NULL as the text "null": format non-NULL only.
        text = F.when(c.isNotNull(), F.format_string(f"%.{places}f", c))
    out = F.translate(text, "0123456789.", digits + ",")
    if null_as_zero:
        out = F.coalesce(out, F.lit(digits[0]))
    return out


def duration_text(start: ColumnOrName, end: ColumnOrName, now: Column | None = None,
                  digits: str = DISPLAY_DIGITS, ms_unit: str = UNIT_MS,
                  s_unit: str = UNIT_S, min_unit: str = UNIT_MIN,
                  min_s_unit: str = UNIT_MIN_S) -> Column:
    """Run duration text. Open runs (NULL end) measure up to ``now``;
    negative spans count as 0; under 1 s in ms, under 60 s in s, otherwise
    whole minutes + seconds, both with two decimals."""
    start, end = _c(start), _c(end)
    now = now if now is not None else F.localtimestamp()
    # Whole milliseconds (as a browser clock has them) between zone-less
    # times: no session zone, so no daylight-saving shift.
    span = F.timestamp_diff("MILLISECOND", start.cast("timestamp_ntz"),
                            F.coalesce(end, now).cast("timestamp_ntz"))
    diff = F.greatest(span, F.lit(0))

    def digits_of(x: Column) -> Column:
        return F.translate(x.cast("string"), "0123456789", digits)

    def ms_as_seconds(ms: Column) -> Column:
        # ms / 1000 with two decimals, half up, in integers: "s,cc".
        cs = F.floor((ms + 5) / 10).cast("long")
        return F.concat(digits_of(F.floor(cs / 100).cast("long")), F.lit(","),
                        digits_of(F.lpad((cs % 100).cast("string"), 2, "0")))

    minutes = F.floor(diff / 60000).cast("long")
    return (F.when(diff < 1000, F.concat(digits_of(diff), F.lit(","), F.lit(digits[0] * 2),
                                         F.lit(ms_unit)))
            .when(diff < 60000, F.concat(ms_as_seconds(diff), F.lit(s_unit)))
            .otherwise(F.concat(digits_of(minutes), F.lit(min_unit),
                                ms_as_seconds(diff % 60000), F.lit(min_s_unit))))


RESUMABLE_STEPS = ("Silver", "Gold")


def can_resume(status: ColumnOrName, step: ColumnOrName) -> Column:
    """P20: a run can resume when it Failed at the Silver or Gold step."""
    return (_c(status) == "Failed") & _c(step).isin(*RESUMABLE_STEPS)


# API names of the gold columns, as the lookup endpoint returns them.
GOLD_API_NAMES = {
    "booking_id": "BookingId", "ride_timestamp": "RideTimestamp",
    "booking_status": "BookingStatus", "customer_id": "CustomerId",
    "vehicle_type": "VehicleType",
    "unified_cancellation_reason": "UnifiedCancellationReason",
    "booking_value": "BookingValue", "ride_distance": "RideDistance",
    "revenue_per_km": "RevenuePerKm", "driver_ratings": "DriverRatings",
    "customer_rating": "CustomerRating", "payment_method": "PaymentMethod",
}


def project_rename(mapping: dict[str, str]) -> list[Column]:
    """A column list under new names, in mapping order."""
    return [F.col(src).alias(dst) for src, dst in mapping.items()]
