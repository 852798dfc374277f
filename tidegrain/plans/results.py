"""What is done with the sources' results: order, match rates, the reason for a poor linkage, weights kept for the next run."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.recode import state_of
from ..operators.engine import keys as level_keys
from ..operators.engine import temporal_aggregate
from ..shared import written_at

PATTERNS: dict[str, Callable[..., DataFrame]] = {}
#: Percentage of units with a value under which a linkage is explained.  Fixed value.
POOR = 50.0


def register_pattern(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in PATTERNS:
            raise ValueError(f"a pattern {name!r} is registered already")
        PATTERNS[name] = f
        return f

    return keep


def get_pattern(name: str) -> Callable[..., DataFrame]:
    if name not in PATTERNS:
        raise ValueError(f"no pattern {name!r}; registered: {', '.join(sorted(PATTERNS))}")
    return PATTERNS[name]


def first_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key by an explicit order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def participants(episodes: DataFrame) -> DataFrame:
    """(pid, place): participants in the order in which they first appear; a blank pid is none."""
    known = episodes.filter("trim(pid) <> ''")
    return known.groupBy("pid").agg(F.min("episode_id").alias("place"))


def final_table(cohort: DataFrame, merged: DataFrame, columns: list[str], level: str = "participant") -> DataFrame:
    """Every episode, or participant, in input order, keys first and the columns as asked for."""
    on = level_keys(level)
    if level == "episode":
        return cohort.select(*on).join(merged, on, "left").orderBy("episode_id").select(*on, *columns)
    return participants(cohort).join(merged, on, "left").orderBy("place").select(*on, *columns)


def partial(frames: list[DataFrame], level: str = "participant") -> DataFrame:
    """The variables of one source: all their rows; of a repeated column the first variable's."""
    out, on = frames[0], level_keys(level)
    for f in frames[1:]:
        out = out.join(f.select(*on, *[c for c in f.columns if c not in out.columns]), on, "full")
    return out


def match_rate(keys: DataFrame, merged: DataFrame, columns: list[str], level: str = "participant") -> DataFrame:
    """(cohort_n, matched_n, match_pct): units with a value in any column."""
    on = level_keys(level)
    some = F.coalesce(*[F.col(c).isNotNull() for c in columns]) if len(columns) == 1 else F.greatest(*[F.col(c).isNotNull() for c in columns])
    rows = keys.select(*on).distinct().join(merged, on, "left")
    out = rows.agg(F.count("*").alias("cohort_n"), F.count_if(some).alias("matched_n"))
    return out.withColumn("match_pct", F.bround(100.0 * F.col("matched_n") / F.greatest(F.col("cohort_n"), F.lit(1)), 2))


def fallback_by_participant(primary: DataFrame, secondary: DataFrame, test: str, columns: list[str]) -> DataFrame:
    """The rule for a primary source that is known by participant only: a participant without the test column in any row takes the
    secondary's episodes whole."""
    known = primary.select("pid", F.col(test).isNotNull().alias("has")).groupBy("pid").agg(F.max("has").alias("has"))
    lost = known.filter("not has").select("pid")
    other = temporal_aggregate(secondary.join(lost, "pid", "left_semi"), ["pid"], columns)
    return primary.join(lost, "pid", "left_anti").select("pid", *columns).unionByName(other)


def states(codes: DataFrame, top: int = 6) -> DataFrame:
    """(state, n): the states with most of the codes."""
    return codes.select("unit").distinct().groupBy(state_of(F.col("unit")).alias("state")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "state").limit(top)


def diagnosis(name: str, weights: DataFrame, values: DataFrame, pct: float) -> str | None:
    """Why a linkage is poor: the codes that the buffers touch against those that the values cover.  None if it is not poor."""
    if pct >= POOR:
        return None
    touched, covered = weights.select("unit").distinct(), values.select("unit").distinct()
    common = touched.intersect(covered).count()
    listed = lambda codes: ", ".join(f"{r.state} ({r.n})" for r in states(codes).collect())  # noqa: E731  six rows
    reason = "the values do not cover where this cohort lives" if not common else "episodes outside the values' units get none"
    return f"{name}: the buffers touch {touched.count()} units in {listed(touched)}; the values cover {covered.count()} in {listed(covered)}; {common} in common: {reason}"


def fingerprint(points: DataFrame) -> str:
    """A digest of a cohort's places that does not depend on the order of rows."""
    h = F.xxhash64("episode_id", F.col("lon").cast("double"), F.col("lat").cast("double"))
    row = points.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return hashlib.sha256(repr(tuple(row)).encode()).hexdigest()


def kept_weights(spark: SparkSession, folder: str, points: DataFrame, settings: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """Weights from `folder` if a run with the same places and settings has written them there, else made and written.

    All sources of one geography, buffer and resolution read one table, so weights are made once for a plan."""
    key = hashlib.sha256(json.dumps([fingerprint(points), settings], sort_keys=True).encode()).hexdigest()[:32]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/weights-{key}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if fs.exists(done):
        return spark.read.parquet(path.toString())
    fs.delete(path, True)  # what a run that failed has left
    return written_at(make(), path.toString())


def summary(times: DataFrame, *by: str) -> DataFrame:
    """(*by, runs, median, least, most) of measured seconds."""
    return times.groupBy(*by).agg(F.count("*").alias("runs"), F.median("seconds").alias("median"), F.min("seconds").alias("least"), F.max("seconds").alias("most"))
