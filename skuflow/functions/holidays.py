"""Holiday dimension: movable and fixed holidays as date features and as an event table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Civil dates of the movable holidays, one per year.
FIRST_YEAR, LAST_YEAR = 2023, 2028
MOVABLE = {
    "ramadan": ["2023-03-23", "2024-03-11", "2025-03-01", "2026-02-18", "2027-02-08", "2028-01-28"],
    "eid_al_fitr": ["2023-04-21", "2024-04-10", "2025-03-30", "2026-03-20", "2027-03-10", "2028-02-27"],
    "eid_al_adha": ["2023-06-28", "2024-06-16", "2025-06-06", "2026-05-27", "2027-05-16", "2028-05-04"],
    "mawlid": ["2023-09-27", "2024-09-16", "2025-09-05", "2026-08-26", "2027-08-15", "2028-08-03"],
    "islamic_new_year": ["2023-07-19", "2024-07-08", "2025-06-27", "2026-06-17", "2027-06-06", "2028-05-25"],
    "ashura": ["2023-07-28", "2024-07-17", "2025-07-06", "2026-06-26", "2027-06-15", "2028-06-03"],
}
# National days (month, day, name).
NATIONAL_DAYS = [
    (1, 1, "new_year"),
    (1, 12, "yennayer"),
    (5, 1, "labour_day"),
    (7, 5, "independence_day"),
    (11, 1, "revolution_day"),
]
# Event periods around a movable date, as (event, holiday, first offset, last offset).
PERIODS = [
    ("ramadan", "ramadan", 0, 29),
    ("pre_ramadan", "ramadan", -7, -1),
    ("eid_al_fitr", "eid_al_fitr", 0, 2),
    ("pre_eid_fitr", "eid_al_fitr", -5, -1),
    ("eid_al_adha", "eid_al_adha", 0, 2),
    ("pre_eid_adha", "eid_al_adha", -5, -1),
    ("mawlid", "mawlid", 0, 0),
    ("islamic_new_year", "islamic_new_year", 0, 0),
    ("ashura", "ashura", 0, 1),
]
RAMADAN_DAYS = 30

HOLIDAY_FEATURES = [
    "is_ramadan", "ramadan_day", "ramadan_progress", "days_to_ramadan", "days_since_ramadan",
    "ramadan_prep", "ramadan_last_week", "is_eid_fitr", "days_to_eid_fitr", "eid_fitr_prep",
    "is_eid_adha", "days_to_eid_adha", "eid_adha_prep", "is_mawlid", "is_islamic_new_year",
    "is_ashura", "is_national_holiday", "days_to_national_holiday", "is_any_holiday", "pre_holiday_3d",
]


def _dates(holiday: str) -> Column:
    return F.array(*[F.lit(date.fromisoformat(d)) for d in MOVABLE[holiday]])


def _of_year(holiday: str, year: Column) -> Column:
    """The holiday's date in a year; null outside the known years."""
    return F.get(_dates(holiday), year - FIRST_YEAR)


def _nearest(holiday: str, day: Column) -> Column:
    """Closest known date, the earlier one on a tie."""
    ranked = F.transform(_dates(holiday), lambda d: F.struct(F.abs(F.datediff(d, day)).alias("gap"), d.alias("d")))
    return F.array_min(ranked)["d"]


def _national(day: Column, year: Column) -> Column:
    return F.array(*[F.make_date(year, F.lit(m), F.lit(d)) for m, d, _ in NATIONAL_DAYS])


def _one(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("double")


def holiday_features(days: DataFrame, day: str = "day") -> DataFrame:
    """Twenty features per distinct date. Dates outside the known years get nulls."""
    d = F.col(day)
    year = F.year(d)
    base = days.select(day).distinct().withColumns(
        {
            "_r": _of_year("ramadan", year),
            "_r_prev": _of_year("ramadan", year - 1),
            "_r_next": _of_year("ramadan", year + 1),
            "_fitr": _nearest("eid_al_fitr", d),
            "_adha": _nearest("eid_al_adha", d),
            "_mawlid": _nearest("mawlid", d),
            "_year1": _nearest("islamic_new_year", d),
            "_ashura": _nearest("ashura", d),
            "_gaps": F.transform(
                F.concat(_national(d, year), _national(d, year + 1)), lambda h: F.datediff(h, d)
            ),
        }
    )
    day_in = F.datediff(d, F.col("_r")) + 1
    inside = day_in.between(1, RAMADAN_DAYS)
    ahead = F.when(F.col("_r") > d, F.datediff("_r", d))
    behind = F.when(day_in > RAMADAN_DAYS, day_in - RAMADAN_DAYS)
    next_ahead = F.when(F.col("_r_next") > d, F.datediff("_r_next", d))
    prev_behind = F.when(F.datediff(d, "_r_prev") >= RAMADAN_DAYS, F.datediff(d, "_r_prev") - (RAMADAN_DAYS - 1))
    base = base.withColumns(
        {
            "_in": F.coalesce(F.when(inside, day_in), F.lit(0)).cast("double"),
            "_to_r": F.coalesce(ahead, next_ahead, F.lit(999)).cast("double"),
            "_since_r": F.coalesce(behind, prev_behind, F.lit(999)).cast("double"),
            "_to_f": F.greatest(F.datediff("_fitr", d), F.lit(0)).cast("double"),
            "_to_a": F.greatest(F.datediff("_adha", d), F.lit(0)).cast("double"),
            "_to_n": F.coalesce(F.array_min(F.filter("_gaps", lambda g: g > 0)), F.lit(999)).cast("double"),
            "is_national_holiday": F.array_contains("_gaps", 0).cast("double"),
        }
    )
    base = base.withColumns(
        {
            "is_ramadan": _one(F.col("_in") > 0),
            "ramadan_day": F.col("_in"),
            "ramadan_progress": F.col("_in") / 30.0,
            "days_to_ramadan": F.least(F.col("_to_r"), F.lit(60.0)),
            "days_since_ramadan": F.least(F.col("_since_r"), F.lit(60.0)),
            "ramadan_prep": _one(F.col("_to_r").between(1, 14)),
            "ramadan_last_week": _one(F.col("_in") > 23),
            "is_eid_fitr": _one(F.datediff(d, "_fitr").between(0, 2)),
            "days_to_eid_fitr": F.least(F.col("_to_f"), F.lit(30.0)),
            "eid_fitr_prep": _one(F.col("_to_f").between(1, 7)),
            "is_eid_adha": _one(F.datediff(d, "_adha").between(0, 2)),
            "days_to_eid_adha": F.least(F.col("_to_a"), F.lit(30.0)),
            "eid_adha_prep": _one(F.col("_to_a").between(1, 10)),
            "is_mawlid": _one(d == F.col("_mawlid")),
            "is_islamic_new_year": _one(d == F.col("_year1")),
            "is_ashura": _one(F.datediff(d, "_ashura").between(0, 1)),
            "days_to_national_holiday": F.least(F.col("_to_n"), F.lit(30.0)),
            "pre_holiday_3d": _one(
                F.col("_to_f").between(1, 3) | F.col("_to_a").between(1, 3) | F.col("_to_n").between(1, 3)
            ),
        }
    ).withColumn(
        "is_any_holiday",
        F.greatest("is_national_holiday", "is_eid_fitr", "is_eid_adha", "is_mawlid", "is_islamic_new_year"),
    )
    known = year.between(FIRST_YEAR, LAST_YEAR)
    return base.select(day, *[F.when(known, F.col(f)).alias(f) for f in HOLIDAY_FEATURES])


def with_holidays(df: DataFrame, days: DataFrame, day: str = "day") -> DataFrame:
    """Map the features onto a table; ``days`` lists its dates.

    The dimension has one row per calendar date (366 a year), which bounds the broadcast.
    """
    return df.join(F.broadcast(holiday_features(days, day)), day, "left")


def holiday_events(spark: SparkSession) -> DataFrame:
    """(holiday, ds, lower_window, upper_window): every event day of the known years."""
    periods = F.array(
        *[
            F.struct(F.lit(event).alias("holiday"), F.lit(holiday).alias("anchor"), F.lit(a).alias("a"), F.lit(b).alias("b"))
            for event, holiday, a, b in PERIODS
        ]
    )
    anchors = F.create_map(*[x for h in MOVABLE for x in (F.lit(h), _dates(h))])
    years = F.sequence(F.lit(FIRST_YEAR), F.lit(LAST_YEAR))
    one = spark.range(1)
    movable = (
        one.select(F.explode(periods).alias("p"))
        .select("p.*", F.explode(F.element_at(anchors, F.col("p.anchor"))).alias("start"))
        .select("holiday", F.explode(F.sequence(F.date_add("start", F.col("a")), F.date_add("start", F.col("b")))).alias("ds"))
    )
    fixed_days = F.array(
        *[F.struct(F.lit(n).alias("holiday"), F.lit(m).alias("m"), F.lit(d).alias("d")) for m, d, n in NATIONAL_DAYS]
    )
    fixed = one.select(F.explode(years).alias("y"), fixed_days.alias("f")).select("y", F.explode("f").alias("f")).select(
        "f.holiday", F.make_date("y", F.col("f.m"), F.col("f.d")).alias("ds")
    )
    zero = F.lit(0)
    return movable.unionByName(fixed).select("holiday", "ds", zero.alias("lower_window"), zero.alias("upper_window"))
