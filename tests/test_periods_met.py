"""Only the periods that an episode meets are made."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidegrain.plans import patterns

D = datetime.date


@pytest.fixture
def cohort(spark):
    episodes = spark.createDataFrame([("p", 1, D(2015, 6, 1), D(2016, 3, 1)), ("p", 2, D(2016, 1, 1), D(2016, 12, 31)), ("q", 3, D(2018, 1, 1), D(2018, 1, 10))], "pid string, episode_id long, start_date date, end_date date")
    weights = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (2, "a", 2.0)], "episode_id long, unit string, weight double")
    values = spark.createDataFrame([(u, y, float(y - 2000) * k) for u, k in (("a", 1), ("b", 2)) for y in range(2010, 2020)], "unit string, year int, v double")
    return episodes, weights, values


def test_years_outside_an_episode_are_not_made(cohort):
    episodes, weights, values = cohort
    # fails if it is worked out for any other year than 2015 and 2016
    rule = F.when(F.col("v").isin(15.0, 30.0, 16.0, 32.0), F.col("v") * 10).when(F.col("v").isNotNull(), F.raise_error(F.lit("a year that nobody needs")).cast("double"))
    got = {r.pid: r.w for r in patterns.yearly_areal(episodes, weights, values, {"w": rule}).collect()}
    first, second = (15 + 3 * 30) / 4 * 10, (16 + 3 * 32) / 4 * 10
    days = [214, 61, 366]
    assert got == {"p": pytest.approx((first * days[0] + second * days[1] + 160.0 * days[2]) / sum(days)), "q": None}
    assert {r.pid for r in patterns.yearly_areal(episodes, weights, values, ["v"]).collect()} == {"p", "q"}


def test_equal_episode_ids_of_two_participants(spark, cohort):
    episodes, weights, values = cohort
    more = episodes.union(spark.createDataFrame([("r", 1, D(2012, 1, 1), D(2012, 1, 31))], episodes.schema))
    got = {(r.pid, r.episode_id): r.v for r in patterns.yearly_areal(more, weights, values, ["v"], "episode").collect()}
    assert got["r", 1] == pytest.approx((12 + 3 * 24) / 4) and got["p", 2] == pytest.approx(16.0) and got["q", 3] is None


def test_periods_that_an_episode_does_not_meet_go_before_they_are_counted(spark, cohort):
    episodes, weights, _ = cohort
    dates = spark.createDataFrame([(u, D(2016, m, 1)) for u in "ab" for m in range(1, 13)], "unit string, date date")
    met = patterns.met_periods(episodes, weights, dates).select("episode_id", "date").distinct()
    assert {r.episode_id: r.n for r in met.groupBy("episode_id").agg(F.count("*").alias("n")).collect()} == {1: 3, 2: 12}
