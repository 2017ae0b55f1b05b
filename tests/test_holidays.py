from datetime import date

from skuflow.functions import holidays as H


def features(spark, *days):
    df = spark.createDataFrame([(d,) for d in days], "day date")
    return {r.day: r for r in H.holiday_features(df).collect()}


def test_period_edges(spark):
    d = date
    f = features(spark, d(2026, 2, 17), d(2026, 2, 18), d(2026, 3, 19), d(2026, 3, 20), d(2026, 3, 22), d(2026, 3, 23),
                 d(2026, 5, 17), d(2025, 12, 31), d(2026, 1, 1), d(2029, 1, 1))
    assert (f[d(2026, 2, 17)].is_ramadan, f[d(2026, 2, 17)].days_to_ramadan, f[d(2026, 2, 17)].ramadan_prep) == (0, 1, 1)
    assert (f[d(2026, 2, 18)].ramadan_day, f[d(2026, 2, 18)].ramadan_last_week) == (1, 0)
    last = f[d(2026, 3, 19)]
    assert (last.is_ramadan, last.ramadan_day, last.ramadan_last_week, last.days_to_eid_fitr, last.pre_holiday_3d) == (1, 30, 1, 1, 1)
    assert (f[d(2026, 3, 20)].is_eid_fitr, f[d(2026, 3, 20)].days_since_ramadan, f[d(2026, 3, 20)].is_any_holiday) == (1, 1, 1)
    assert f[d(2026, 3, 22)].is_eid_fitr == 1 and f[d(2026, 3, 23)].is_eid_fitr == 0
    assert (f[d(2026, 5, 17)].eid_adha_prep, f[d(2026, 5, 17)].days_to_eid_adha) == (1, 10)
    assert (f[d(2025, 12, 31)].days_to_national_holiday, f[d(2025, 12, 31)].is_national_holiday) == (1, 0)
    assert (f[d(2026, 1, 1)].is_national_holiday, f[d(2026, 1, 1)].days_to_national_holiday) == (1, 11)
    assert f[d(2029, 1, 1)].is_ramadan is None


def test_event_table(spark):
    counts = {r.holiday: r["count"] for r in H.holiday_events(spark).groupBy("holiday").count().collect()}
    years = H.LAST_YEAR - H.FIRST_YEAR + 1
    assert counts["ramadan"] == 30 * years and counts["pre_ramadan"] == 7 * years and counts["ashura"] == 2 * years
    assert len(counts) == 14
