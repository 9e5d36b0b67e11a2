"""Command line: python -m visionloom COMMAND ROOT... Results are JSON on standard output."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def _named(pairs: list[str]) -> list[tuple[str, str]]:
    """Pairs of old=new."""
    bad = [p for p in pairs if "=" not in p]
    if bad:
        raise SystemExit(f"not old=new: {bad[0]}")
    return [tuple(x.strip() for x in p.split("=", 1)) for p in pairs]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="visionloom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("adapters", help="formats that can be read")
    for name, text in (("detect", "the format of a folder"), ("scan", "counts of a dataset"), ("clean", "findings of the rules"), ("taxonomy", "class names that differ in spelling only"), ("split", "shares of a new split"), ("report", "an HTML report"), ("export-ir", "the dataset as tables"), ("sql", "a query over images, annotations, objects and classes"), ("commit", "a new version of a snapshot"), ("export", "the dataset as YOLO folders")):
        c = sub.add_parser(name, help=text)
        c.add_argument("roots", nargs="+" if name != "detect" else 1)
        c.add_argument("--format", default=None)
        c.add_argument("--master", default=None)
        if name == "sql":
            c.add_argument("--query", required=True)
            c.add_argument("--limit", type=int, default=1000, help="rows that are shown")
        if name == "commit":
            c.add_argument("--note", default="")
        if name in ("report", "export-ir", "export", "commit"):
            c.add_argument("--out", required=True)
        if name in ("split", "export"):
            c.add_argument("--ratios", default="0.8,0.1,0.1")
            c.add_argument("--seed", type=int, default=42)
        if name in ("clean", "export"):
            c.add_argument("--disable", action="append", default=[])
        if name == "export":
            c.add_argument("--map", action="append", default=[], metavar="OLD=NEW")
            c.add_argument("--keep", action="append")
            c.add_argument("--drop", action="append", default=[])
            c.add_argument("--kind", choices=["bbox", "image"])
            c.add_argument("--clean", action="store_true")
            c.add_argument("--place", choices=["copy", "hard", "symbolic"])
            c.add_argument("--overwrite", action="store_true")
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> object:
    from visionloom.operators import analytics, clean, pipeline, records, report, split, taxonomy, versions, views
    from visionloom.sources import datasets

    if a.command == "detect":
        return {"format": datasets.detect_format(spark, a.roots[0])}
    d = datasets.load_and_merge(spark, [{"root": r, "fmt": a.format, **({"source_id": f"src{i}"} if len(a.roots) > 1 else {})} for i, r in enumerate(a.roots)])
    if a.command == "scan":
        return analytics.stats(d.images, d.annotations).first().asDict() | {"sources": d.sources}
    if a.command == "clean":
        return {r["rule"]: r["findings"] for r in clean.summarize(clean.findings(d.images, d.annotations, tuple(a.disable))).collect()}
    if a.command == "taxonomy":
        return [r.asDict() for r in taxonomy.suggest_merges(d.annotations).collect()]
    if a.command == "report":
        report.write_report(report.dataset_report(d.images, d.annotations), a.out)
        return {"out": a.out}
    if a.command == "export-ir":
        records.save_snapshot(d.images, d.annotations, a.out)
        return {"out": a.out}
    if a.command == "commit":
        return {"out": a.out, "version": versions.commit(d.images, d.annotations, a.out, a.note)}
    if a.command == "sql":
        views.register_views(d.images, d.annotations)
        return [r.asDict() for r in spark.sql(a.query).limit(a.limit).collect()]
    ratios = tuple(float(x) for x in a.ratios.split(","))
    if a.command == "split":
        return {r["split"]: r["share"] for r in split.report(split.assign(d.images, d.annotations, ratios, a.seed)).collect()}
    mapping = spark.createDataFrame(_named(a.map), "source string, target string") if a.map else None
    images = d.images
    if a.place:
        paths = [datasets.list_files(spark, r).selectExpr("rel rel_path", "path") for r in a.roots[:1]]
        if len(a.roots) > 1:
            raise SystemExit("--place takes one folder")
        images = images.join(paths[0], "rel_path")
    return pipeline.export_dataset(images, d.annotations, a.out, files="path" if a.place else None, how=a.place or "copy", overwrite=a.overwrite, mapping=mapping, keep=a.keep, drop=tuple(a.drop), kind=a.kind, cleaned=a.clean, disabled=tuple(a.disable), ratios=ratios, seed=a.seed)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "adapters":
        from visionloom.sources import datasets

        print(json.dumps(datasets.available_adapters()))
        return 0
    builder = SparkSession.builder.appName("visionloom")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    print(json.dumps(run(spark, a), ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
