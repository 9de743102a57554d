"""Evaluation queries: retrieval quality, paired comparisons, test outcomes, timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recall_precision(wanted: DataFrame, returned: DataFrame, keys: list[str], task: str = "task") -> DataFrame:
    """``task, n_wanted, n_returned, hits, recall, precision`` for every task with wanted or returned rows.

    Both sides are distinct (task, *keys). Nothing wanted: no recall. Nothing
    returned: precision zero.
    """
    w, r = wanted.select(task, *keys).distinct(), returned.select(task, *keys).distinct()
    both = w.withColumn("_w", F.lit(1)).join(r.withColumn("_r", F.lit(1)), [task, *keys], "full_outer")
    g = both.groupBy(task).agg(F.count("_w").alias("n_wanted"), F.count("_r").alias("n_returned"), F.count_if(F.col("_w").isNotNull() & F.col("_r").isNotNull()).alias("hits"))
    return g.withColumn("recall", F.when(F.col("n_wanted") > 0, F.col("hits") / F.col("n_wanted"))).withColumn("precision", F.when(F.col("n_returned") > 0, F.col("hits") / F.col("n_returned")).otherwise(0.0))


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, n_scored, mean, median, min, zeros and perfect of a score that may be null."""
    v = F.col(value)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(v).alias("n_scored"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("low"),
        F.count_if(v == 0).alias("zeros"), F.count_if(v == 1).alias("perfect"),
    )


def with_all(rows: DataFrame, group: str, everyone: DataFrame) -> DataFrame:
    """Rows of groups that every member of ``everyone`` (one column) has a row in."""
    (member,) = everyone.columns
    full = rows.select(group, member).distinct().groupBy(group).agg(F.count("*").alias("_n"))
    wanted = everyone.distinct().agg(F.count("*").alias("_all"))
    return rows.join(full.join(F.broadcast(wanted), full["_n"] == wanted["_all"]).select(group), group, "left_semi")


def resolved(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """``resolved`` for each run: at least one wanted test, all wanted ones pass, none that passed before is broken. Rows: kind f2p or p2p, passed."""
    want, keep = F.col("kind") == "f2p", F.col("kind") == "p2p"
    return outcomes.groupBy(*by).agg(((F.count_if(want) > 0) & (F.count_if(want & ~F.col("passed")) == 0) & (F.count_if(keep & ~F.col("passed")) == 0)).alias("resolved"))


def classify_tests(before: DataFrame, after: DataFrame, test: str = "test") -> DataFrame:
    """``test, outcome``: fail_to_pass, pass_to_pass, pass_to_fail or still_failing; a test on one side only counts as failing on the other."""
    j = before.select(test, F.col("passed").alias("b")).join(after.select(test, F.col("passed").alias("a")), test, "full_outer")
    b, a = F.coalesce("b", F.lit(False)), F.coalesce("a", F.lit(False))
    return j.select(test, F.when(~b & a, "fail_to_pass").when(b & a, "pass_to_pass").when(b, "pass_to_fail").otherwise("still_failing").alias("outcome"))


def speedup(timings: DataFrame, label: str = "label", seconds: str = "seconds", baseline: str = "") -> DataFrame:
    """``label, best, middle, ratio`` against the baseline's best run."""
    t = timings.groupBy(label).agg(F.min(seconds).alias("best"), F.median(seconds).alias("middle"))
    base = t.where(F.col(label) == baseline).select(F.col("best").alias("base"))
    return t.join(F.broadcast(base), how="left").select(label, "best", "middle", (F.col("base") / F.col("best")).alias("ratio"))


def funnel(rows: DataFrame, reasons: list[tuple[str, Column]], kept: str = "kept", limit: int | None = None, order: str | None = None) -> DataFrame:
    """``reason, n``: each row counts under the first reason that drops it, or as kept.

    With ``limit``, rows are taken in ``order`` (a unique column) until so many
    are kept; later ones are not counted.
    """
    reason = F.lit(kept)
    for name, drops in reversed(reasons):
        reason = F.when(drops, F.lit(name)).otherwise(reason)
    told = rows.withColumn("reason", reason)
    if limit is not None:
        first = told.where(F.col("reason") == kept).select(F.col(order).alias("_o")).orderBy("_o").limit(limit)
        last = first.agg(F.when(F.count("*") == limit, F.max("_o")).alias("_last"))
        told = told.join(F.broadcast(last), F.col("_last").isNull() | (F.col(order) <= F.col("_last")))
    return told.groupBy("reason").agg(F.count("*").alias("n"))


def most_common(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """``key, n, rank``: the commonest first, of equal counts the one seen first."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(pos).alias("_first"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "_first"))).drop("_first")


def sums(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``tasks`` and the sum of each column: what packs disclose as unresolved, unmodelled or omitted."""
    return rows.groupBy(*by).agg(F.count("*").alias("tasks"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def reading_cost(rows: DataFrame, by: list[str]) -> DataFrame:
    """Distinct ``files`` to open, and total, mean and greatest ``tokens``."""
    return rows.groupBy(*by).agg(F.countDistinct("file").alias("files"), F.sum("tokens").alias("tokens"), F.avg("tokens").alias("mean_tokens"), F.max("tokens").alias("most_tokens"))


def resolve_rates(runs: DataFrame, arm: str = "arm", rep: str = "rep") -> DataFrame:
    """Runs, resolved, rate, turns, cost and runs without an edit, of each arm (rep null) and of each of its repetitions."""
    counts = [
        F.count("*").alias("runs"), F.count_if("resolved").alias("resolved"), F.avg(F.col("resolved").cast("int")).alias("rate"), F.avg("turns").alias("mean_turns"),
        F.avg("cost").alias("mean_cost"), F.sum("cost").alias("total_cost"), F.count_if(F.coalesce(F.size("edited"), F.lit(0)) == 0).alias("no_edit"),
    ]
    each = runs.groupBy(arm, rep).agg(*counts)
    return each.unionByName(runs.groupBy(arm).agg(*counts).withColumn(rep, F.lit(None).cast(runs.schema[rep].dataType)).select(each.columns))


def carry_forward(rows: DataFrame, by: list[str], order: list, value: Column, name: str) -> DataFrame:
    """``rows`` with the last non-null ``value`` up to each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def flow_pairs(elements: DataFrame, flow: str, pos: str, at: str) -> DataFrame:
    """``flow, pos, at, next``: consecutive elements of each flow."""
    w = Window.partitionBy(flow).orderBy(pos)
    return elements.withColumn("next", F.lead(at).over(w)).where("next is not null").select(flow, pos, at, "next")


def eta_minutes(done: Column, total: Column, mean_seconds: Column, streams: Column) -> Column:
    """Minutes left at the mean pace over parallel streams."""
    return F.greatest(total - done, F.lit(0)) * mean_seconds / F.greatest(streams, F.lit(1)) / 60
