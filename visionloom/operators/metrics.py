"""Training-metric series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visionloom.functions.scalar import parse_number

#: Headline names of result columns.
HEADLINE = {"metrics/precision(B)": "precision", "metrics/recall(B)": "recall", "metrics/mAP50(B)": "mAP50", "metrics/mAP50-95(B)": "mAP50-95", "metrics/accuracy_top1": "top1", "metrics/accuracy_top5": "top5"}


def parse_results(lines: DataFrame, header: list[str], since_epoch: int | None = None) -> DataFrame:
    """(run_id, epoch, metric, value) of CSV lines (run_id, arrival, line): short rows and cells that are no numbers are
    left out; of a repeated epoch the last row counts."""
    names = [h.strip().lstrip("﻿") for h in header]
    cells = F.split("line", ",")
    rows = lines.where(F.size(cells) >= len(names)).select("run_id", "arrival", *[parse_number(F.get(cells, F.lit(i))).alias(f"c{i}") for i in range(len(names))])
    rows = rows.withColumn("epoch", F.col(f"c{names.index('epoch')}").cast("int")).where("epoch is not null")
    last = rows.groupBy("run_id", "epoch").agg(F.max_by(F.struct(*[f"c{i}" for i in range(len(names))]), "arrival").alias("r"))
    last = last.where(F.col("epoch") > since_epoch) if since_epoch is not None else last
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"r.c{i}").alias("value")) for i, n in enumerate(names) if n != "epoch"])
    return last.select("run_id", "epoch", F.inline(pairs)).where("value is not null")


def keep_last(rows: DataFrame) -> DataFrame:
    """Long rows (run_id, epoch, metric, value, arrival): of a rewritten cell the last arrival."""
    return rows.groupBy("run_id", "epoch", "metric").agg(F.max_by("value", "arrival").alias("value"))


def best(rows: DataFrame, metric: str, mode: str = "max") -> DataFrame:
    """The best epoch of each run, the earliest at a tie."""
    v = F.col("value") if mode == "max" else -F.col("value")
    return rows.where(F.col("metric") == metric).groupBy("run_id").agg(F.max_by(F.struct("epoch", "value"), F.struct(v, -F.col("epoch"))).alias("b")).select("run_id", "b.epoch", "b.value")


def best_headline(rows: DataFrame, first: str = "metrics/mAP50-95(B)", second: str = "metrics/mAP50(B)") -> DataFrame:
    """(run_id, metric, epoch, value): the best epoch by the first metric, by the second in runs that lack the first."""
    a, b = (best(rows, m).withColumn("metric", F.lit(m)) for m in (first, second))
    return a.unionByName(b.join(a, "run_id", "left_anti").select(*a.columns)).select("run_id", "metric", "epoch", "value")


def latest(rows: DataFrame) -> DataFrame:
    """(run_id, epochs, last_epoch, metrics, total): how many epochs, and of the last one how many metrics and their sum."""
    per = rows.groupBy("run_id", "epoch").agg(F.count("value").alias("metrics"), F.round(F.sum("value"), 6).alias("total"))
    return per.groupBy("run_id").agg(F.count(F.lit(1)).alias("epochs"), F.max_by(F.struct("epoch", "metrics", "total"), "epoch").alias("l")).select("run_id", "epochs", F.col("l.epoch").alias("last_epoch"), "l.metrics", "l.total")


def tail_epochs(rows: DataFrame, most: int = 0, since: int | None = None) -> DataFrame:
    """The epochs above `since`, and of these the last `most` of each run (0: all)."""
    kept = rows if since is None else rows.where(F.col("epoch") > since)
    if most <= 0:
        return kept
    last = kept.select("run_id", "epoch").distinct().withColumn("k", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("epoch"))))
    return kept.join(last.where(F.col("k") <= most).select("run_id", "epoch"), ["run_id", "epoch"], "left_semi")


def progress(rows: DataFrame, total: int) -> DataFrame:
    done = rows.groupBy("run_id").agg(F.count_distinct("epoch").alias("done"), F.max("epoch").alias("epoch"))
    return done.withColumn("percent", F.round(F.least(F.lit(1.0), F.col("done") / max(1, total)), 4))


def headline(rows: DataFrame) -> DataFrame:
    """One row per epoch with the known names; train_loss is train/loss or the sum of its parts."""
    wide = rows.groupBy("run_id", "epoch").agg(
        *[F.max(F.when(F.col("metric") == k, F.col("value"))).alias(v) for k, v in HEADLINE.items()],
        F.round(F.coalesce(F.max(F.when(F.col("metric") == "train/loss", F.col("value"))), F.sum(F.when(F.col("metric").isin("train/box_loss", "train/cls_loss", "train/dfl_loss"), F.col("value")))), 6).alias("train_loss"),
    )
    return wide


def rolling_fps(frames: DataFrame, key: str, order: str, ms: str, width: int = 10) -> DataFrame:
    """Frames a second over the last `width` frames of a session; null below two frames."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - width, 0)
    return frames.withColumn("fps", F.when(F.count(ms).over(w) >= 2, F.try_divide(F.lit(1000.0), F.avg(ms).over(w))))
