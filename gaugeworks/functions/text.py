"""Identifiers, timestamps and the sentences shown to operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks.schema import null_if_nan

# The texts shown to users.
IDLE_SUGGESTION = "Consider powering down or reallocating - sustained low utilization detected"
NO_REASON = "best available option among current candidates"


def device_id(number: Column) -> Column:
    return F.format_string("gpu-%03d", number)


def host_id(number: Column) -> Column:
    return F.format_string("node-%02d", number)


def as_double(value: Column) -> Column:
    """Text to double; texts that spell NaN become NULL."""
    return null_if_nan(value.cast("double"))


def epoch_to_timestamp(seconds: Column) -> Column:
    """Epoch seconds, fraction included, to a zone-free UTC timestamp."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def timestamp_text(ts: Column) -> Column:
    """`2024-01-31 10:20:30`, followed by six fraction digits when there is a fraction."""
    whole = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    exact = F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(exact)


def two_digits(value: Column) -> Column:
    """A share in [0, 1] with two digits, rounding the exact binary value (half-even when it is a tie).

    format_string rounds the shortest decimal text instead, so 0.285, stored slightly below, would
    print as 0.29. Only values that print as x.xx5 need the exact comparison.
    """
    thousandths = value.cast("decimal(20,10)") * F.lit(1000).cast("decimal(4,0)")
    is_tie = thousandths % 10 == 5
    stored = (value * float(2**62)).cast("bigint").cast("decimal(20,0)") * F.lit(1000).cast("decimal(4,0)")
    tie = thousandths.cast("decimal(4,0)") * F.lit(2**62).cast("decimal(20,0)")
    settled = (
        F.when(is_tie & (stored < tie), value - 0.001)
        .when(is_tie & (stored > tie), value + 0.001)
        .when(is_tie, F.bround(value, 2))
        .otherwise(value)
    )
    return F.format_string("%.2f", settled)


def explanation(risk: Column, driver: Column, share: Column) -> Column:
    return F.format_string(
        "Failure risk of %s is primarily driven by '%s' (contributes %s of the total score).",
        two_digits(risk), driver, two_digits(share),
    )


def alert_message(gpu: Column, tier: Column, risk: Column, eta: Column) -> Column:
    high = F.format_string(
        "%s has high failure risk (%s); estimated %.0f steps to failure.",
        gpu, two_digits(risk), F.bround(eta, 0),
    )
    medium = F.format_string(
        "%s shows elevated failure risk (%s); monitor closely.", gpu, two_digits(risk)
    )
    return F.when(tier == "high", high).when(tier == "medium", medium)


def placement_reason(health: Column, risk: Column, util: Column) -> Column:
    found = F.concat_ws(
        ", ",
        F.when(health >= 80, "high health score"),
        F.when(risk < 0.2, "low failure risk"),
        F.when(util < 30, "currently underutilized"),
    )
    return F.when(found == "", NO_REASON).otherwise(found)


def id_list(text: Column) -> Column:
    """Semicolon-separated ids to an array; an empty or absent list is an empty array."""
    ids = F.split(F.coalesce(text, F.lit("")), ";")
    return F.filter(F.transform(ids, lambda i: F.trim(i)), lambda i: i != "")
