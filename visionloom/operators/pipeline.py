"""The whole way of a dataset: load and merge, map classes, clean, split, export; with what each step did."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visionloom.operators import clean, export, review, split, taxonomy

#: Columns that travel beside the model's.
_KEEP = StorageLevel.MEMORY_AND_DISK


@dataclass
class Prepared:
    images: DataFrame
    annotations: DataFrame
    findings: DataFrame | None = None

    def release(self) -> None:
        self.images.unpersist(), self.annotations.unpersist()


def prepare(images: DataFrame, annotations: DataFrame, mapping: DataFrame | None = None, keep: list[str] | None = None, drop: tuple[str, ...] = (), kind: str | None = None, cleaned: bool = True, disabled: tuple[str, ...] = (), ratios: tuple[float, float, float] | None = (0.8, 0.1, 0.1), seed: int = 42, respect_existing: bool = True, unreadable: DataFrame | None = None) -> Prepared:
    """Mapping of classes, then cleaning, then the split, in this order; a step whose settings are empty is left out.

    Images and annotations are kept in memory and on disk from the cleaning on, as every later step reads them again; lost
    parts are made anew from their sources."""
    if mapping is not None or keep is not None or drop or kind:
        images, annotations = taxonomy.apply_mapping(images, annotations, mapping, kind, keep, list(drop))
    found = None
    if cleaned:
        found = clean.findings(images, annotations, disabled)
        images, annotations = clean.apply(images, annotations, disabled, unreadable)
    images, annotations = images.persist(_KEEP), annotations.persist(_KEEP)
    if ratios is not None:
        images = split.assign(images, annotations, ratios, seed, respect_existing).persist(_KEEP)
    return Prepared(images, annotations, found)


def export_dataset(images: DataFrame, annotations: DataFrame, out: str, lineage: dict | None = None, order: list[str] | None = None, several: str = "first", style: str = "auto", files: str | None = None, how: str = "copy", overwrite: bool = False, **steps) -> dict:
    """prepare() and the export; the card also says how many findings each rule had and what the splits came to."""
    done = prepare(images, annotations, **steps)
    try:
        card = export.export_yolo(done.images, done.annotations, out, order, several, style, overwrite=overwrite, files=files, lineage=lineage, how=how)
        card["splits"] = {r["split"]: r["share"] for r in split.report(done.images).collect()}
        if done.findings is not None:
            card["findings"] = {r["rule"]: r["findings"] for r in clean.summarize(done.findings).collect()}
        return card
    finally:
        done.release()


def prelabel_dataset(images: DataFrame, score: Callable, names: list[str], weights: str, out: str, least: float = 0.0, edits: DataFrame | None = None, statuses: DataFrame | None = None, ratios: tuple[float, float, float] | None = (0.8, 0.1, 0.1), **options) -> dict:
    """Scores images(uid, ..., path), takes in the review, exports, and gives the card with where its labels come from.

    score is what review.annotate takes; its result is kept on disk, so each image is scored once. edits(box_id, seq, op,
    ...) and statuses(uid, seq, status) are the review's logs, if there was one; its counters go into the card beside the
    scorer's. Images that failed are exported neither as empty nor as labelled. options are those of export.export_yolo."""
    frames = images.select("uid", "rel_path", *(["path"] if "path" in images.columns else [])).mapInPandas(score, review.FRAMES).persist(StorageLevel.DISK_ONLY)
    kept = []
    try:
        counters = review.prelabel_report(frames).first().asDict()
        boxes, reviewed = review.frame_annotations(frames, names, least), None
        good = images.join(frames.where("ok").select("uid"), "uid", "left_semi")
        if edits is not None or statuses is not None:
            done = boxes if edits is None else review.apply_edits(boxes, edits)
            log = statuses if statuses is not None else images.sparkSession.createDataFrame([], "uid string, seq long, status string")
            removed = edits.select("op") if edits is not None else 0
            reviewed = review.review_summary(done if edits is not None else done.withColumns({"source": F.lit("model"), "review": F.lit("pending")}), review.image_statuses(good, log), removed).first().asDict()
            boxes = done
        boxes = boxes.withColumn("score", F.lit(None).cast("double")) if "score" not in boxes.columns else boxes
        boxes = boxes.withColumn("kind", F.lit("bbox")) if "kind" not in boxes.columns else boxes
        kept = [boxes.persist(_KEEP)]
        if ratios is not None:
            kept.append(split.assign(good, boxes, ratios).persist(_KEEP))
        lineage = attach_lineage({}, weights, counters, reviewed)
        return export.export_yolo(kept[-1] if ratios is not None else good, boxes, out, lineage=lineage, **options)
    finally:
        for df in [frames, *kept]:
            df.unpersist()


def attach_lineage(card: dict, weights: str, report: dict, reviewed: dict | None = None) -> dict:
    """The card with where its labels come from: the weights, the counters of the scoring, and of the review if there was one."""
    return card | {"prelabel": {"id": uuid.uuid4().hex[:12], "weights": weights, "report": report, "review": reviewed}}
