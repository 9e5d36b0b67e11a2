"""HTML report of a dataset or of an evaluation: small results of the other operators, drawn as inline SVG."""

from __future__ import annotations

import base64
import re
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visionloom.operators import analytics
from visionloom.operators.samples import nested
from visionloom.sources.images import decoded
from visionloom.sources.listing import exists, qualified
from visionloom.sources.thumbs import thumbnails

BAR, GAP, LEFT, WIDE = 18, 6, 160, 640


def bars(rows: list[tuple[str, float]]) -> str:
    """Horizontal bars, the longest the whole width; nothing for no rows."""
    most = max((v for _, v in rows), default=0) or 1
    out = []
    for i, (name, v) in enumerate(rows):
        y, w = i * (BAR + GAP), (WIDE - LEFT - 60) * v / most
        out.append(f'<text x="{LEFT - 6}" y="{y + 13}" text-anchor="end">{escape(str(name))}</text><rect x="{LEFT}" y="{y}" width="{w:.1f}" height="{BAR}" fill="#4a78b5"/><text x="{LEFT + w + 4:.1f}" y="{y + 13}">{v:g}</text>')
    return f'<svg width="{WIDE}" height="{len(rows) * (BAR + GAP)}" font-size="12">{"".join(out)}</svg>' if rows else ""


def columns(rows: list[tuple[str, float]], high: int = 160) -> str:
    """Vertical bars for buckets with short names, with five lines of scale."""
    if not rows:
        return ""
    most = max(v for _, v in rows) or 1
    slot = (WIDE - 60) / len(rows)
    lines = "".join(f'<line x1="50" x2="{WIDE}" y1="{10 + high * i / 4:.1f}" y2="{10 + high * i / 4:.1f}" stroke="#eee"/><text x="44" y="{14 + high * i / 4:.1f}" text-anchor="end">{most * (4 - i) / 4:g}</text>' for i in range(5))
    out = []
    for i, (name, v) in enumerate(rows):
        h, x = high * v / most, 55 + slot * i
        out.append(f'<rect x="{x:.1f}" y="{10 + high - h:.1f}" width="{slot * 0.7:.1f}" height="{h:.1f}" fill="#4a78b5"/><text x="{x + slot * 0.35:.1f}" y="{high + 26}" text-anchor="middle">{escape(str(name))}</text>')
    return f'<svg width="{WIDE}" height="{high + 34}" font-size="11">{lines}{"".join(out)}</svg>'


def heat(v: float, most: float) -> str:
    """Style of a cell by its share of the largest: bands from 0.6, 0.3 and 0.1 on; zero stands out."""
    if most <= 0:
        return "color:#bbb"
    if v == 0:
        return "background:#fdeceb;color:#b3261e"
    share = v / most
    return f"background:rgba(74,120,181,{0.4 if share > 0.6 else 0.28 if share > 0.3 else 0.16 if share > 0.1 else 0.07})"


def matrix(corner: str, names: list[str], rows: list[tuple[str, list[float]]]) -> str:
    """A table of numbers with heat cells."""
    most = max((v for _, r in rows for v in r), default=0)
    head = "".join(f"<th>{escape(str(n))}</th>" for n in names)
    body = "".join(f"<tr><th>{escape(str(n))}</th>" + "".join(f'<td style="{heat(v, most)}">{v:g}</td>' for v in r) + "</tr>" for n, r in rows)
    return f"<table><tr><th>{escape(corner)}</th>{head}</tr>{body}</table>" if rows else ""


def imbalance_note(annotations: DataFrame) -> str:
    """A sentence on the largest and smallest class, and the share of the largest fifth of the classes."""
    one, share = analytics.imbalance(annotations).first(), analytics.concentration(annotations).first()
    if one is None or one["max_class"] is None:
        return ""
    parts = [f"{one['max_class']} ({one['max_count']}) has {one['ratio']:g} times as many as {one['min_class']} ({one['min_count']})"]
    parts += [f"the largest {share['top']} of {share['classes']} classes hold {share['top_share']:.0%}"] if share else []
    parts += [f"{one['underrepresented']} classes have few instances"] if one["underrepresented"] else []
    return f"<p>{escape('; '.join(parts))}</p>"


def pictures(images: DataFrame, annotations: DataFrame, path: str, limit: int = 24, edge: int = 200, most_bytes: int = 30_000) -> str:
    """Sample images of every class in turn with their boxes drawn over, however large their files: tasks decode and shrink
    them, and `limit` small pictures of at most most_bytes each reach the driver. One that can't be read or decoded leaves
    an empty frame."""
    spark = images.sparkSession
    sample = analytics.round_robin(images, annotations, limit).select("uid")
    rows = nested(images.join(F.broadcast(sample), "uid", "left_semi"), annotations).where("width > 0 and height > 0").select("uid", path, "width", "height", "objects").collect()
    there = [p for p in {r[path]: qualified(spark, r[path]) for r in rows if r[path]}.items() if exists(spark, p[1])]
    data = {_plain(r["path"]): base64.b64encode(r["png"]).decode() for r in thumbnails(decoded(spark, [p for _, p in there]), edge, most_bytes).collect()} if there else {}
    data = {own: data.get(_plain(p)) for own, p in there}
    out = []
    for r in rows:
        held = data.get(r[path])
        src = f'<image width="{r["width"]}" height="{r["height"]}" href="data:image/png;base64,{held}"/>' if held else ""
        boxes = "".join(f'<rect x="{o["x1"]:g}" y="{o["y1"]:g}" width="{o["x2"] - o["x1"]:g}" height="{o["y2"] - o["y1"]:g}" fill="none" stroke="#d33" stroke-width="{max(1, r["width"] // 200)}"/>' for o in r["objects"] if o["x1"] is not None)
        names = ", ".join(dict.fromkeys(str(o["category"]) for o in r["objects"]))
        out.append(f'<figure><svg width="200" viewBox="0 0 {r["width"]} {r["height"]}"><rect width="100%" height="100%" fill="#f4f4f4"/>{src}{boxes}</svg><figcaption>{escape(names)}</figcaption></figure>')
    return "".join(out)


def _plain(path: str) -> str:
    return re.sub("^file:/+", "file:/", path)


def write_report(html: str, out: str) -> None:
    from visionloom.operators.export import _filesystem

    files, at = _filesystem(out)
    files.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(at) as f:
        f.write(html.encode())


def table(columns: list[str], rows: list[tuple]) -> str:
    cell = lambda v: "" if v is None else escape(f"{v:.4g}" if isinstance(v, float) else str(v))
    head = "".join(f"<th>{escape(c)}</th>" for c in columns)
    return f"<table><tr>{head}</tr>{''.join('<tr>' + ''.join(f'<td>{cell(v)}</td>' for v in r) + '</tr>' for r in rows)}</table>"


def page(title: str, blocks: list[tuple[str, str]]) -> str:
    body = "".join(f"<h2>{escape(name)}</h2>{html}" for name, html in blocks if html)
    return f'<!doctype html><meta charset="utf-8"><title>{escape(title)}</title><style>body{{font-family:sans-serif;margin:2em}}td,th{{padding:2px 8px;text-align:left}}</style><h1>{escape(title)}</h1>{body}'


def _top(df: DataFrame, most: int) -> tuple[list[str], list[tuple]]:
    """For display only."""
    return df.columns, [tuple(r) for r in df.limit(most).collect()]


def dataset_report(images: DataFrame, annotations: DataFrame, title: str = "Dataset", most: int = 200, path: str | None = None) -> str:
    """A page of the summary, findings, splits, classes, sizes and counts. Each block shows at most `most` rows. path names
    the column of images with the files to show samples of."""
    classes = analytics.class_distribution(annotations).orderBy("count", "category", ascending=[False, True])
    _, top = _top(classes, most)
    splits = [(r["category"], [r[s] for s in ("train", "val", "test", "unassigned")]) for r in analytics.class_by_split(images, annotations).orderBy("category").limit(most).collect()]
    buckets = lambda df, edges: [(f"{edges[r[0]]:g}+", r[1]) for r in sorted(df.collect())]
    blocks = [("Summary", table(*_top(analytics.stats(images, annotations), 1))), ("Findings", table(*_top(analytics.findings(images, annotations), most)))]
    blocks += [("Splits", table(*_top(analytics.split_summary(images, annotations).orderBy("split"), most))), ("Classes", bars([(r[0], r[1]) for r in top]) + imbalance_note(annotations)), ("Classes by split", matrix("class", ["train", "val", "test", "unassigned"], splits))]
    blocks += [("Objects an image", columns(buckets(analytics.objects_per_image(images, annotations), analytics.OBJECT_EDGES))), ("Box area of the image", columns(buckets(analytics.area_ratios(images, annotations), analytics.AREA_EDGES)))]
    blocks += [("Box sizes", bars(_top(analytics.size_categories(annotations), 3)[1])), ("Image sizes", table(*_top(analytics.image_sizes(images), most)))]
    return page(title, blocks + ([("Samples", pictures(images, annotations, path))] if path else []))


def evaluation_report(overall: DataFrame, per_class: DataFrame, confusion: DataFrame, title: str = "Evaluation", most: int = 200) -> str:
    """A page of overall metrics, classes and the confusion table (predicted, true, n): rows predicted, columns true; of more
    than `most` cells only those that are not zero are listed."""
    parts = [(name, table(*_top(df, most))) for name, df in (("Overall", overall.orderBy("metric")), ("Classes", per_class.orderBy("name")))]
    cells = confusion.orderBy("predicted", "true").limit(most * most + 1).collect()
    names = sorted({r["true"] for r in cells})
    if len(names) ** 2 == len(cells):
        n = {(r["predicted"], r["true"]): r["n"] for r in cells}
        grid = matrix("predicted \\ true", names, [(p, [n[p, t] for t in names]) for p in names])
    else:
        grid = table(*_top(confusion.where("n > 0").orderBy("predicted", "true"), most))
    return page(title, [*parts, ("Confusion", grid)])
