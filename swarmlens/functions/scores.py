"""Scalar scores, tiers and comparisons as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def steps(value: Column, limits: list[tuple[float, str]], last: str) -> Column:
    """The name of the first limit that the value is below."""
    out = None
    for limit, name in limits:
        out = F.when(value < limit, name) if out is None else out.when(value < limit, name)
    return out.otherwise(last)


def bot_score() -> Column:
    """Sum of an account's warning signs, at most 1.2."""
    c, part = F.col, lambda when, value: F.when(when, F.lit(value)).otherwise(F.lit(0.0))
    ratio = F.try_divide(c("followers_count").cast("double"), c("following_count").cast("double"))
    signs = [
        F.when(c("account_age_days") < 30, F.lit(0.3)).when(c("account_age_days") < 90, F.lit(0.1)).otherwise(F.lit(0.0)),
        F.when(c("following_count") == 0, F.lit(0.0)).when(ratio < 0.1, F.lit(0.2)).when(ratio > 10, F.lit(0.1)).otherwise(F.lit(0.0)),
        F.when(c("tweets_per_day") > 50, F.lit(0.3)).when(c("tweets_per_day") > 20, F.lit(0.1)).otherwise(F.lit(0.0)),
        part(F.coalesce("bio", F.lit("")) == "", 0.1), part(F.coalesce("location", F.lit("")) == "", 0.05), part(F.coalesce("profile_image_url", F.lit("")) == "", 0.1),
        part((F.octet_length("username") > 15) & c("username").rlike("[0-9]"), 0.15),
    ]
    return F.round(reduce(lambda x, y: x + y, signs), 9)


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution by a polynomial in 1 / (1 + p|x|) (fixed, truncated coefficients)."""
    t = 1.0 / (1.0 + 0.2316419 * F.abs(x))
    tail = 0.3989423 * F.exp(-x * x / 2.0) * t * (0.3193815 + t * (-0.3565638 + t * (1.781478 + t * (-1.821256 + t * 1.330274))))
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def p_value(z: Column) -> Column:
    return 2.0 * (1.0 - normal_cdf(F.abs(z)))


def severity(confidence: Column, count: Column) -> Column:
    value = confidence * count / 100.0
    return F.when(value > 0.8, "critical").when(value > 0.6, "high").when(value > 0.4, "medium").otherwise("low")


def decayed(score: Column, days: Column, rate: float = 0.1, initial: float = 0.5, low: float = 0.0, high: float = 1.0) -> Column:
    """A score on its way back to the initial one."""
    kept = F.exp(-rate * days)
    return F.greatest(F.lit(low), F.least(F.lit(high), score * kept + initial * (1 - kept)))


def compare(value: Column, operator: Column, threshold: Column) -> Column:
    """One of six operators by name; a missing value or unknown operator is false."""
    out = F.when(operator == "gt", value > threshold).when(operator == "gte", value >= threshold).when(operator == "lt", value < threshold).when(operator == "lte", value <= threshold).when(operator == "eq", value == threshold).when(operator == "ne", value != threshold)
    return F.coalesce(out, F.lit(False))


def shortened(text: Column, most: int = 100) -> Column:
    """Text of more than ``most`` bytes cut to three characters less and dots."""
    return F.when(F.octet_length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


TIERS = {
    "engagement": ([(1, "none"), (10, "low"), (100, "medium"), (1000, "high")], "viral"),
    "account_age": ([(30, "new"), (365, "recent"), (1095, "established")], "veteran"),
    "followers": ([(1, "none"), (100, "small"), (1000, "medium"), (10000, "large")], "massive"),
    "bot": ([(0.2, "human"), (0.5, "uncertain"), (0.8, "likely_bot")], "definite_bot"),
    "spam": ([(0.3, "clean"), (0.6, "suspicious"), (0.8, "likely_spam")], "definite_spam"),
}


def tier(kind: str, value: Column) -> Column:
    """The generalised name of a number."""
    if kind == "activity":
        return F.when(value == 0, "inactive").otherwise(steps(value, [(1, "low"), (10, "moderate"), (50, "high")], "extreme"))
    return steps(value, *TIERS[kind])


#: Names of channels, patterns and severities as they are shown.
NAMES = {
    "channel": {"email": "Email", "slack": "Slack", "webhook": "Webhook", "sms": "SMS", "pagerduty": "PagerDuty"},
    "pattern": {"burst": "Burst", "periodic": "Periodic", "coordinated": "Coordinated", "gradual_ramp": "Gradual Ramp", "flash_mob": "Flash Mob"},
    "severity": {"critical": "CRITICAL", "high": "HIGH", "medium": "MEDIUM", "low": "LOW"},
}


def shown(kind: str, value: Column) -> Column:
    """The name that is shown for a value, Unknown for others."""
    names = F.create_map(*[F.lit(x) for pair in NAMES[kind].items() for x in pair])
    return F.coalesce(F.try_element_at(names, value), F.lit("Unknown"))


def account_age(created_at: Column, as_of: str) -> Column:
    """Whole days since an RFC 3339 time; null where it cannot be read."""
    made = F.try_to_timestamp(created_at)
    return F.floor((F.unix_micros(F.to_timestamp(F.lit(as_of))) - F.unix_micros(made)) / (24 * 3.6e9)).cast("int")


def number(value: Column) -> Column:
    """A double of whatever can be read as one, else null."""
    return value.try_cast("double")
