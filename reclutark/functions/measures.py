"""Row measures: days of coverage (three distinct rules), ratios, flags, capacity bands."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from reclutark import catalogs
from reclutark.functions.coerce import int_or_zero, lenient_int
from reclutark.session import TIME_ZONE


def not_authorised_date() -> Column:
    return F.lit(catalogs.NOT_AUTHORISED).cast("date")


def as_of_date(as_of: dt.date | None) -> Column:
    """The given day, or the current day of the session."""
    return F.current_date() if as_of is None else F.lit(as_of)


def elapsed_days(start: Column, end: Column, time_zone: str | None = None) -> Column:
    """Calendar days between two dates.

    With a time zone, whole 24-hour days between the two local midnights: one less than the calendar
    difference when the clock moved forward in between.
    """
    if time_zone is None:
        return F.datediff(end, start)

    def midnight(c: Column) -> Column:
        zero = F.lit(0)
        stamp = F.make_timestamp(F.year(c), F.month(c), F.day(c), zero, zero, zero, F.lit(time_zone))
        return F.unix_timestamp(stamp)

    return F.floor((midnight(end) - midnight(start)) / 86400).cast("int")


def coverage_days(
    authorised: Column,
    requested_on: Column,
    filled_on: Column,
    hired: Column,
    openings: Column,
    as_of: dt.date | None = None,
    tz_exact: bool = False,
) -> Column:
    """Dashboard rule.  A not-authorised marker date counts 1 day whatever the rest says.

    Start is the authorisation, else the request.  End is the fill date of a hired row, else today while
    openings remain; otherwise there is no value.
    """
    start = F.coalesce(authorised, requested_on)
    end = F.when((lenient_int(hired) > 0) & filled_on.isNotNull(), filled_on).when(
        int_or_zero(openings) > 0, as_of_date(as_of)
    )
    days = elapsed_days(start, end, TIME_ZONE if tz_exact else None)
    return F.when(authorised == not_authorised_date(), F.lit(1)).otherwise(days)


def listing_days(
    authorised: Column, requested_on: Column, filled_on: Column, as_of: dt.date | None = None,
    tz_exact: bool = False,
) -> Column:
    """Listing rule: fill date or today, minus authorisation or request; no marker and no count tests."""
    start = F.coalesce(authorised, requested_on)
    end = F.coalesce(filled_on, as_of_date(as_of))
    return elapsed_days(start, end, TIME_ZONE if tz_exact else None)


def closed_days(authorised: Column, filled_on: Column) -> Column:
    """Closed-vacancy rule: authorisation to fill date, only when not negative."""
    days = F.datediff(filled_on, authorised)
    return F.when(days >= 0, days)


def change_pct(current: Column, previous: Column) -> Column:
    """Percentage change; no value without a positive previous one."""
    return F.when(previous > 0, (current - previous) / previous * 100)


def share_pct(part: Column, total: Column) -> Column:
    """Share in percent, 0 when the total is 0."""
    return F.when(total > 0, part / total * 100).otherwise(F.lit(0.0))


def ratio_pct(part: Column, total: Column, digits: int = 2) -> Column:
    """Rounded share in percent (ties to even), 0 when the total is 0."""
    return F.bround(share_pct(part, total), digits)


def goal_pct(mean_days: Column, goal: float) -> Column:
    """Goal over mean, in percent; no value without a positive mean.  100 or more is good."""
    return F.when(mean_days > 0, F.lit(goal) / mean_days * 100)


def long_fill(days: Column, limit: int = catalogs.LONG_FILL_DAYS) -> Column:
    return days > limit


def efficiency_band(
    pct: Column,
    bands: Sequence[tuple[float, str]] = catalogs.EFFICIENCY_BANDS,
    lowest: str = catalogs.SPARE_CAPACITY,
) -> Column:
    """Label of an efficiency: spare below 80, stable up to 100, overload above 100, saturation above 150."""
    (top, top_label), (high, high_label), (stable, stable_label) = bands
    return (
        F.when(pct > top, F.lit(top_label))
        .when(pct > high, F.lit(high_label))
        .when(pct >= stable, F.lit(stable_label))
        .when(pct.isNotNull(), F.lit(lowest))
    )


def fill_date_if_hired(stage: Column, followed_up_on: Column) -> Column:
    """The follow-up date counts as fill date only at the hired stage."""
    return F.when(stage == catalogs.HIRED_STAGE, followed_up_on)


def remaining_openings(requested: Column, hired: Column, floor: bool = True) -> Column:
    """Requested minus hired once somebody was hired.  The import never goes below 0; the form may."""
    left = F.when(hired > 0, F.coalesce(requested - hired, F.lit(0))).otherwise(F.coalesce(requested, F.lit(0)))
    return F.greatest(left, F.lit(0)) if floor else left
