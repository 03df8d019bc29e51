"""Training-log analytics.

Log lines are rows (run, block, line_no, line); `line_no` is unique and ascending within a
run and `block` is non-decreasing with it (see `ordered`). Lines may be spread over any
number of blocks, so one run may be arbitrarily large.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import logline
from ..functions.constants import METRIC_FIELDS, PATIENCE_LIMIT
from . import ordered

PLACE = ("block", "line_no")


def metric_rows(lines: DataFrame) -> DataFrame:
    """The metrics lines with their parsed values; a line that fails to parse keeps its row."""
    return (
        lines.filter(logline.is_metrics(F.col("line")))
        .withColumn("_m", logline.parse_metrics(F.col("line")))
        .select("run", *PLACE, *[F.col(f"_m.{k}").alias(k) for k in METRIC_FIELDS])
    )


def counters(lines: DataFrame) -> DataFrame:
    """Steps seen and announced total per run; unparsable metrics lines count as steps."""
    total = logline.total_steps(F.col("line"))
    return lines.groupBy("run").agg(
        F.count_if(logline.is_metrics(F.col("line"))).alias("steps"),
        F.max_by(total, F.when(total.isNotNull(), F.struct(*PLACE))).alias("total_steps"),
    )


def latest_metrics(lines: DataFrame) -> DataFrame:
    """The newest non-empty metrics of each run; a run without any gives no row."""
    rows = metric_rows(lines)
    some = F.coalesce(*METRIC_FIELDS).isNotNull()
    values = F.struct(*[F.col(k) for k in METRIC_FIELDS])
    newest = F.max_by(values, F.when(some, F.struct(*PLACE))).alias("m")
    return rows.groupBy("run").agg(newest).filter(F.col("m").isNotNull()).select("run", "m.*")


def running_steps(lines: DataFrame) -> DataFrame:
    """Each line with the number of metrics lines up to it."""
    slim = lines.select("run", *PLACE, logline.is_metrics(F.col("line")).alias("is_metrics"))
    return ordered.running(
        slim, ["run"], ["line_no"], "block", sums={"step": F.col("is_metrics").cast("bigint")}
    )


def running_latest(lines: DataFrame) -> DataFrame:
    """Each metrics line with the newest non-empty metrics up to it."""
    rows = metric_rows(lines)
    state = F.when(
        F.coalesce(*METRIC_FIELDS).isNotNull(),
        F.struct(F.col("line_no").alias("at"), *[F.col(k) for k in METRIC_FIELDS]),
    )
    out = ordered.running(rows, ["run"], ["line_no"], "block", maxes={"latest": state})
    return out.select("run", *PLACE, *[F.col(f"latest.{k}").alias(k) for k in METRIC_FIELDS])


def monitor(lines: DataFrame, target, limit: int = PATIENCE_LIMIT) -> DataFrame:
    """Every metrics line with a loss, judged against the target.

    Adds step, hit, target_hit (sticky), patience (misses since the last hit, 0 before the
    first) and stop (patience over the limit). `target` is a number or a column of `lines`.

    Patience is the running number of judged lines minus that number at the last hit. Both
    are running values, so blocks carry (lines so far, number at the last hit).
    """
    goal = F.lit(float(target)) if isinstance(target, (int, float)) else F.col(target)
    loss = logline.parse_metrics(F.col("line"))["loss"]
    # the explicit shuffle holds only what both uses of `local` read, so they share it
    slim = (
        lines.filter(logline.is_metrics(F.col("line")))
        .filter(F.col("run").isNotNull() & F.col("block").isNotNull())
        .select("run", *PLACE, loss.alias("loss"), goal.alias("target"))
        .repartition("run", "block")
    )
    slim = slim.withColumn("judged", F.col("loss").isNotNull().cast("bigint")).withColumn(
        "hit", logline.within_target(F.col("loss"), F.col("target"))
    )
    inside = ordered._inside(["run"], ["line_no"], "block")
    local = slim.withColumn("_step", F.count(F.lit(1)).over(inside)).withColumn(
        "_judged", F.sum("judged").over(inside)
    )
    local = local.withColumn("_hit_at", F.max(F.when(F.col("hit"), F.col("_judged"))).over(inside))

    totals = local.groupBy("run", "block").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("judged").alias("judged"),
        F.max("_hit_at").alias("hit_at"),
    )
    before = ordered._earlier_blocks(["run"], "block")
    carry = totals.select(
        "run",
        "block",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("c_step"),
        F.coalesce(F.sum("judged").over(before), F.lit(0)).alias("c_judged"),
        "hit_at",
    ).select(
        "run",
        "block",
        "c_step",
        "c_judged",
        F.max(F.col("c_judged") + F.col("hit_at")).over(before).alias("c_hit_at"),
    )
    last_hit = F.coalesce(F.col("c_judged") + F.col("_hit_at"), F.col("c_hit_at"))
    return (
        local.join(carry, ["run", "block"])
        .withColumn("_last_hit", last_hit)
        .filter(F.col("judged") == 1)
        .select(
            "run",
            *PLACE,
            (F.col("c_step") + F.col("_step")).alias("step"),
            "loss",
            "hit",
            F.col("_last_hit").isNotNull().alias("target_hit"),
            F.coalesce(
                F.col("c_judged") + F.col("_judged") - F.col("_last_hit"), F.lit(0)
            ).alias("patience"),
        )
        .withColumn("stop", F.col("target_hit") & (F.col("patience") > limit))
    )


def stop_points(judged: DataFrame) -> DataFrame:
    """First step of each run at which patience ran out, if any."""
    return judged.groupBy("run").agg(F.min(F.when(F.col("stop"), F.col("step"))).alias("stop_step"))


def outcomes(judged: DataFrame) -> DataFrame:
    """Best loss, its first step and the stop step per run; rows after the stop do not count.

    Blocks are reduced first, so a run is never gathered in one task.
    """
    earlier = Window.partitionBy("run", "block").orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, -1
    )
    marked = judged.withColumn(
        "_over", F.coalesce(F.max("stop").over(earlier), F.lit(False))
    )
    live = ~F.col("_over")
    counts_hit = live & F.col("hit")
    blocks = marked.groupBy("run", "block").agg(
        F.min(F.when(counts_hit, F.struct("loss", "step"))).alias("best"),
        F.min(F.when(F.col("stop"), F.col("step"))).alias("stop_step"),
        F.max(F.when(live, F.col("step"))).alias("last_step"),
        F.min(F.when(live, F.struct("step", "loss"))).alias("head"),
        F.max(F.when(live, F.struct("step", "loss"))).alias("tail"),
    )
    before = Window.partitionBy("run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    kept = blocks.withColumn("_stopped", F.min("stop_step").over(before)).filter(
        F.col("_stopped").isNull()
    )
    return kept.groupBy("run").agg(
        F.min("best").alias("best"),
        F.min("stop_step").alias("stop_step"),
        F.max("last_step").alias("last_step"),
        F.min("head").alias("head"),
        F.max("tail").alias("tail"),
    ).select(
        "run",
        F.col("head.loss").alias("first_loss"),
        F.col("tail.loss").alias("last_loss"),
        F.col("best.loss").alias("best_loss"),
        F.col("best.step").alias("best_step"),
        F.col("best").isNotNull().alias("target_hit"),
        F.col("stop_step").isNotNull().alias("early_stopped"),
        "stop_step",
        "last_step",
    )


def run_results(outcome: DataFrame, exits: DataFrame) -> DataFrame:
    """Success per run: exit code 0, or the target was hit and the run stopped early.

    `exits` holds (run, exit_code); a run without judged lines never hit its target.
    """
    hit = F.coalesce("target_hit", F.lit(False))
    early = F.coalesce("early_stopped", F.lit(False))
    return exits.join(outcome, "run", "left").select(
        "run",
        "exit_code",
        "best_loss",
        "best_step",
        hit.alias("target_hit"),
        early.alias("early_stopped"),
        (F.coalesce(F.col("exit_code") == 0, F.lit(False)) | (hit & early)).alias("success"),
        (~hit).alias("target_not_reached"),
    )


def checkpoints(paths: DataFrame) -> DataFrame:
    """(run, step, path) of the paths that name a checkpoint."""
    step = logline.checkpoint_step(F.col("path"))
    return paths.select("run", step.alias("step"), "path").filter(F.col("step").isNotNull())


def best_checkpoints(best: DataFrame, saved: DataFrame) -> DataFrame:
    """Greatest checkpoint step not after the best step, else the smallest one.

    Checkpoints are reduced per run together with the best step carried by the join; runs
    without checkpoints give no row.
    """
    at = F.col("step")
    ok = at <= F.col("best_step")
    return (
        saved.join(best.select("run", "best_step").filter("best_step is not null"), "run")
        .groupBy("run", "best_step")
        .agg(F.coalesce(F.max(F.when(ok, at)), F.min(at)).alias("checkpoint_step"))
    )


def tail(lines: DataFrame, n: int = 50) -> DataFrame:
    """The last n lines of each run, in order.

    Blocks before the last n lines are left out by their counts, so no task holds a whole run.
    """
    last = ordered.first_n(lines, ["run"], ["line_no"], "block", n, last=True)
    return last.orderBy("run", *PLACE)
