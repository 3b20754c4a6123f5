"""The metric kernel as column expressions. Missing evidence is NULL, never 0; published rates round half away from zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from punctua.constants import BANDS, GHOST_SECONDS, ON_TIME_FROM, ON_TIME_UNTIL, SCORE_CAP, SEVERE_SECONDS, SHIFTS, WILSON_Z


def half_away(x: Column, digits: int) -> Column:
    """x rounded half away from zero, by way of a decimal."""
    return F.round(x.cast("decimal(24,8)"), digits).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; NULL when b is 0 or NULL."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def known(delay: Column) -> Column:
    return delay.isNotNull()


def in_clamp(delay: Column) -> Column:
    return F.abs(delay) <= GHOST_SECONDS


def on_time(delay: Column) -> Column:
    return (delay >= ON_TIME_FROM) & (delay < ON_TIME_UNTIL)


def severe(delay: Column) -> Column:
    return (delay > SEVERE_SECONDS) & in_clamp(delay)


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def bins(x: Column, edges: Sequence[float], n: int, where: Column) -> list[Column]:
    """Counts of x in [edge, next edge) for n bins; the last is open above when there are as many edges as bins."""
    found = []
    for i in range(n):
        inside = (x >= edges[i]) & (x < edges[i + 1]) if i + 1 < len(edges) else x >= edges[i]
        if i == 0:
            inside = x < edges[1]
        if i == n - 1:
            inside = x >= edges[i]
        found.append(count_if(where & inside))
    return found


def shift(hour: Column) -> Column:
    expr = None
    for name, (first, last) in SHIFTS.items():
        expr = (F.when if expr is None else expr.when)(hour.between(first, last), name)
    return expr.otherwise("night")


def iso_day(date: Column) -> Column:
    return F.weekday(date) + 1


def day_type(date: Column) -> Column:
    return F.when(iso_day(date) <= 5, "weekday").otherwise("weekend")


def bucket_5m(ts: Column) -> Column:
    """Start of the five-minute bin, counted from 2000-01-01."""
    origin = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    minutes = F.floor(F.timestamp_diff("SECOND", origin, ts) / 300) * 5
    return F.timestamp_add("MINUTE", minutes.cast("int"), origin)


def band(status: Column) -> Column:
    expr = None
    for name, codes in BANDS.items():
        expr = (F.when if expr is None else expr.when)(status.isin(*codes), name)
    return expr


def delay_band(seconds: Column) -> Column:
    """The live status of an average delay."""
    return F.when(seconds.isNull(), "unknown").when(seconds < -60, "early").when(seconds < 60, "on_time").when(seconds < 300, "late").otherwise("severe")


def otp_pct(good: Column, of: Column) -> Column:
    return half_away(ratio(100.0 * good.cast("double"), of), 0)


def severe_pct(of: Column, bad: Column) -> Column:
    return half_away(ratio(100.0 * F.coalesce(bad, F.lit(0)).cast("double"), of), 1)


def proxy_otp_pct(of: Column, bad: Column) -> Column:
    """Share of observations that are not severe."""
    return half_away(ratio(100.0 * (of.cast("double") - F.coalesce(bad, F.lit(0)).cast("double")), of), 0)


def minutes(seconds: Column) -> Column:
    return half_away(seconds / 60.0, 1)


def wilson(good: Column, of: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """Lower and upper Wilson bound in percent, one decimal."""
    n = F.nullif(of.cast("double"), F.lit(0.0))
    p = F.least(F.greatest(good.cast("double"), F.lit(0.0)), n) / n
    known_both = good.isNotNull() & n.isNotNull()
    p = F.when(known_both, p)
    whole = 1.0 + z * z / n
    middle = (p + z * z / (2.0 * n)) / whole
    margin = z * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n)) / whole
    low = F.when(known_both, F.greatest(F.lit(0.0), (middle - margin) * 100.0))
    high = F.when(known_both, F.least(F.lit(100.0), (middle + margin) * 100.0))
    return half_away(low, 1), half_away(high, 1)


def total(hist: Column) -> Column:
    return F.aggregate(hist, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def histogram_percentile(hist: Column, q: float, edges: Sequence[float]) -> Column:
    """The q-quantile of a histogram by linear interpolation in its bin, in the edges' unit; a bin without an upper edge gives its lower edge."""
    e = F.array(*(F.lit(float(x)) for x in edges))
    goal = F.lit(float(q)) * total(hist)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))

    def step(s: Column, i: Column) -> Column:
        n = F.get(hist, i).cast("double")
        low, high = F.get(e, i), F.get(e, i + 1)
        value = F.when(high.isNull(), low).otherwise(low + (high - low) * ((goal - s["sum"]) / n))
        here = s["at"].isNull() & (n > 0) & (s["sum"] + n >= goal)
        return F.struct((s["sum"] + n).alias("sum"), F.when(here, value).otherwise(s["at"]).alias("at"))

    walked = F.aggregate(F.sequence(F.lit(0), F.size(hist) - 1), start, step, lambda s: s["at"])
    return F.when((F.size(hist) > 0) & (total(hist) > 0), walked)


def delay_percentile_minutes(hist: Column, q: float, edges: Sequence[float]) -> Column:
    return minutes(histogram_percentile(hist, q, edges))


def bunched_pct(hist: Column, edges: Sequence[float], median: Column) -> Column:
    """Percent of a gap histogram below half the median; the bin that holds the bound counts in proportion."""
    lows, highs = (F.array(*(F.lit(float(x)) for x in part)) for part in (edges[:-1], edges[1:]))
    bound = 0.5 * median
    below = F.aggregate(
        F.arrays_zip(hist.alias("n"), lows.alias("lo"), highs.alias("hi")),
        F.lit(0.0),
        lambda a, b: a + b["n"].cast("double") * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (bound - b["lo"]) / (b["hi"] - b["lo"]))),
    )
    return F.when(median.isNotNull() & (total(hist) > 0), 100.0 * below / total(hist))


def excess_wait(sum_gap: Column, sum_gap_sq: Column, scheduled: Column) -> Column:
    """Expected wait beyond half the scheduled headway, at least 0, one decimal."""
    wait = sum_gap_sq.cast("double") / (2.0 * sum_gap.cast("double"))
    return F.when((sum_gap > 0) & scheduled.isNotNull(), half_away(F.greatest(F.lit(0.0), wait - scheduled / 2.0), 1))


def pooled_cov(n: Column, sum_gap: Column, sum_gap_sq: Column) -> Column:
    """Sample deviation over mean from summed moments, four decimals; needs two gaps."""
    n, s, q = (c.cast("double") for c in (n, sum_gap, sum_gap_sq))
    spread = F.sqrt(F.greatest((q - s * s / n) / (n - 1.0), F.lit(0.0)))
    return F.when((n >= 2) & (s > 0), half_away(spread / (s / n), 4))


def problem_score(severe_count: Column, pooled_average: Column) -> Column:
    """Ten points a severe delay and one a minute of positive average delay, capped."""
    late = F.greatest(F.coalesce(pooled_average, F.lit(0.0)), F.lit(0.0))
    return F.least(half_away(severe_count.cast("double") * 10.0 + late / 60.0, 4), F.lit(SCORE_CAP))


def two_proportion_z(good_a: Column, n_a: Column, good_b: Column, n_b: Column, floor: int) -> Column:
    """z of the difference of two rates with the pooled share; NULL below the floor or without spread."""
    a, na, b, nb = (c.cast("double") for c in (good_a, n_a, good_b, n_b))
    p = (a + b) / (na + nb)
    spread = F.sqrt(p * (1.0 - p) * (1.0 / na + 1.0 / nb))
    return F.when((na >= floor) & (nb >= floor) & (spread > 0), (a / na - b / nb) / spread)
