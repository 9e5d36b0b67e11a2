"""Jobs as data: end states, state changes as a stream, log lines, run pictures, weight lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: States of a job and the events that lead from one to another.
CHANGES = {
    ("pending", "start"): "running",
    ("running", "stop"): "stopping",
    ("pending", "stop"): "stopped",
    ("stopping", "exit"): "stopped",
    ("running", "done"): "finished",
    ("running", "fail"): "failed",
    ("running", "lost"): "interrupted",
    ("stopping", "lost"): "interrupted",
    ("stopped", "resume"): "running",
    ("failed", "resume"): "running",
    ("interrupted", "resume"): "running",
}
#: Groups of run pictures in the order they are shown.
PICTURE_GROUPS = ["val_pred", "val_labels", "train_batch", "labels", "curve", "matrix", "other"]


def end_status(kind: str, stopped: Column, code: Column, ok: Column) -> Column:
    """End state of a train, eval or deploy job from the stop flag, exit code (null: unknown) and result (null: none)."""
    lost = code.isNull()
    rules = {
        "train": [(code == 0, "finished"), (lost, "interrupted")],
        "eval": [(code == 0, "finished"), (lost & ok, "finished"), (lost & ok.isNull(), "interrupted")],
        "deploy": [(ok, "finished"), (ok.isNotNull(), "failed"), (code == 0, "finished"), (lost, "interrupted")],
    }[kind]
    return reduce(lambda c, r: c.when(r[0], r[1]), rules, F.when(stopped, "stopped")).otherwise("failed")


def follow_states(events: DataFrame) -> DataFrame:
    """Stream (job_id, seq, status) of the changes that events (job_id, seq, event) cause; events that a state does not know
    and those not above the last sequence number change nothing. The state is a status and a number a job."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, last = state.get if state.exists else ("pending", -1)
        rows = pd.concat(list(parts)).sort_values("seq")
        out = []
        for seq, event in zip(rows["seq"], rows["event"]):
            if seq > last:
                last, then = int(seq), CHANGES.get((status, event))
                if then:
                    status = then
                    out.append((key[0], last, status))
        state.update((status, last))
        yield pd.DataFrame(out, columns=["job_id", "seq", "status"])

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id long, seq long, status string", "status string, last long", "append", GroupStateTimeout.NoTimeout)


def log_lines(chunks: DataFrame) -> DataFrame:
    """(run_id, arrival, pos, line) of log chunks (run_id, arrival, chunk): cut at CR or LF, blank lines left out."""
    cut = chunks.select("run_id", "arrival", F.posexplode(F.split("chunk", r"\r\n|\r|\n")).alias("pos", "line"))
    return cut.where(F.trim("line") != "")


def number_lines(lines: DataFrame) -> DataFrame:
    """lines with seq, gapless from 0 in each run. A run's chunks are numbered by a window over chunk counts, not lines."""
    per = lines.groupBy("run_id", "arrival").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("base", F.sum("n").over(Window.partitionBy("run_id").orderBy("arrival")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("run_id", "arrival").orderBy("pos")) - 1
    return lines.withColumn("own", own).join(before, ["run_id", "arrival"]).select("run_id", (F.col("base") + F.col("own")).alias("seq"), "line")


def log_page(numbered: DataFrame, offset: int = 0, limit: int = 500) -> DataFrame:
    """Lines from seq `offset` on, 1 to 5000 of each run; the next page starts after the largest seq."""
    limit = min(5000, max(1, limit))
    return numbered.where((F.col("seq") >= offset) & (F.col("seq") < offset + limit))


def last_lines(lines: DataFrame, most_lines: int = 1000, most_bytes: int = 1 << 20) -> DataFrame:
    """(run_id, seq, line) of lines(run_id, seq, line): the last ones of each run, most_lines and most_bytes at most, always
    the very last: what streaming.live.bounded_tail holds. Of a run only most_lines rows leave a task."""
    back = Window.partitionBy("run_id").orderBy(F.desc("seq"))
    last = lines.withColumn("__k", F.row_number().over(back)).where(F.col("__k") <= most_lines)
    size = F.sum(F.octet_length("line")).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return last.withColumn("__size", size).where((F.col("__k") == 1) | (F.col("__size") <= most_bytes)).select("run_id", "seq", "line")


def tail_log(lines: DataFrame) -> DataFrame:
    """Stream (run_id, seq, line) of lines (run_id, arrival, pos, line); the state is the next number of each run."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values(["arrival", "pos"])
        state.update((at + len(rows),))
        yield pd.DataFrame({"run_id": rows["run_id"], "seq": range(at, at + len(rows)), "line": rows["line"]})

    return lines.groupBy("run_id").applyInPandasWithState(step, "run_id long, seq long, line string", "next long", "append", GroupStateTimeout.NoTimeout)


def picture_group(name: Column) -> Column:
    low = F.lower(name)  # the names below are fixed values: those that a run gives its pictures
    batch = low.startswith("val_batch")
    named = F.when(batch & low.contains("_pred"), "val_pred").when(batch & low.contains("_labels"), "val_labels")
    named = named.when(low.startswith("train_batch"), "train_batch").when(low.startswith("labels"), "labels")
    return named.when(low.contains("confusion_matrix"), "matrix").when(low.contains("curve") | low.startswith("results"), "curve").otherwise("other")


def picture_groups(files: DataFrame, name: str = "name") -> DataFrame:
    """(grp, rank, pictures): groups that have pictures, in the order they are shown."""
    rank = F.array_position(F.array(*map(F.lit, PICTURE_GROUPS)), F.col("grp")) - 1
    return files.groupBy(picture_group(F.col(name)).alias("grp")).agg(F.count(F.lit(1)).alias("pictures")).select("grp", rank.cast("int").alias("rank"), "pictures")


def preview(files: DataFrame, name: str = "name", groups: tuple[str, ...] = ("val_pred", "val_labels", "train_batch"), each: int = 2) -> DataFrame:
    """The first `each` pictures by name of the named groups."""
    rows = files.select(picture_group(F.col(name)).alias("grp"), F.col(name).alias("name")).where(F.col("grp").isin(*groups))
    parts = [rows.where(F.col("grp") == g).orderBy("name").limit(each) for g in groups]
    return reduce(DataFrame.unionByName, parts)


def weights(sources: list[DataFrame]) -> DataFrame:
    """Union of weight lists (path, label), a path once whatever its case: the first source that has it counts."""
    rows = reduce(DataFrame.unionByName, [s.select("path", "label", F.lit(i).alias("rank")) for i, s in enumerate(sources)])
    first = rows.groupBy(F.lower("path").alias("key")).agg(F.min_by(F.struct("path", "label", "rank"), F.struct("rank", "label", "path")).alias("w"))
    return first.select("w.*")


def weights_format(path: Column) -> Column:
    """Format of a weight file by its ending; null where unknown."""
    #: Endings of weight formats.
    endings = {".pt": "pt", ".onnx": "onnx", ".torchscript": "torchscript", ".engine": "engine", "_openvino_model": "openvino", ".mlpackage": "coreml", ".tflite": "tflite"}
    low = F.regexp_replace(F.lower(path), "/+$", "")
    return F.coalesce(*[F.when(low.endswith(e), F.lit(f)) for e, f in endings.items()])
