"""Annotation formats as DataFrames: YOLO text, COCO, Pascal VOC, LabelMe, OpenLABEL frame intervals; YOLO export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visionloom.functions.scalar import make_uid, yolo_to_xyxy
from visionloom.sources.listing import list_files

IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "bmp", "gif", "tif", "tiff", "webp"]
STEM = r"([^/]+?)(\.[^./]+)?$"


def list_images(spark: SparkSession, root: str, source_id: str = "src") -> DataFrame:
    """(uid, rel_path, path, size) of the image files below root, empty ones included; contents are not read."""
    files = list_files(spark, root).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(IMAGE_SUFFIXES))
    return files.select(make_uid(F.lit(source_id), F.lit(root), F.col("rel")).alias("uid"), F.col("rel").alias("rel_path"), "path", "size")


def yolo_labels(spark: SparkSession, labels_dir: str, names: list[str]) -> DataFrame:
    """(stem, line, category, xc, yc, w, h): blank, short and unreadable lines and unknown classes are left out."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(labels_dir, wholetext=True)
    lines = text.select(F.regexp_extract(F.input_file_name(), STEM, 1).alias("stem"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "s"))
    p = F.split(F.trim("s"), r"\s+")
    num = [F.get(p, F.lit(i)).try_cast("double") for i in range(5)]
    rows = lines.where(F.size(p) >= 5).select("stem", "line", num[0].cast("int").alias("k"), *[n.alias(a) for n, a in zip(num[1:], ("xc", "yc", "w", "h"))]).na.drop()
    return rows.withColumn("category", F.try_element_at(F.array(*map(F.lit, names)), F.when(F.col("k") >= 0, F.col("k") + 1))).where("category is not null")


def yolo_annotations(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Pixel boxes: images(uid, rel_path, width, height) joined by file stem."""
    rows = labels.join(images.withColumn("stem", F.regexp_extract("rel_path", STEM, 1)), "stem")
    box = yolo_to_xyxy(*[F.col(c) for c in ("xc", "yc", "w", "h", "width", "height")])
    return rows.select(F.col("uid").alias("image_uid"), "category", F.lit("bbox").alias("kind"), box.alias("b")).select("image_uid", "category", "kind", "b.*")


def coco(spark: SparkSession, path: str, source_id: str = "coco") -> tuple[DataFrame, DataFrame]:
    """Images and annotations of a COCO file; annotations of unknown images or categories or with bad boxes are left out."""
    images, boxes = coco_files(spark, [path], source_id)
    return images.drop("file"), boxes


def coco_files(spark: SparkSession, paths: list[str], source_id: str = "coco") -> tuple[DataFrame, DataFrame]:
    """Images, with their file, and annotations of COCO files, each with its own ids, in one read."""
    schema = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,iscrowd:int>>, categories array<struct<id:bigint,name:string>>"
    doc = spark.read.schema(schema).option("multiLine", "true").json(paths).withColumn("file", F.input_file_name())
    raw = doc.select("file", F.inline("images"))
    images = raw.select(make_uid(F.lit(source_id), F.col("file_name")).alias("uid"), F.col("file_name").alias("rel_path"), "width", "height", F.nullif(F.regexp_extract("file_name", r"^(.*)/[^/]+$", 1), F.lit("")).alias("grp"), F.col("id").alias("__id"), "file")
    cats = doc.select("file", F.inline("categories")).select("file", F.col("id").alias("category_id"), F.trim("name").alias("category"))
    rows = doc.select("file", F.inline("annotations")).where(F.size("bbox") == 4).join(images.select("file", F.col("__id").alias("image_id"), "uid"), ["file", "image_id"]).join(cats, ["file", "category_id"])
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    boxes = rows.select(F.col("uid").alias("image_uid"), "category", F.lit("bbox").alias("kind"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"), F.when(F.col("iscrowd") == 1, "iscrowd").alias("grp"))
    return images.drop("__id"), boxes


def voc(spark: SparkSession, path: str | list[str], one_based: bool = False) -> DataFrame:
    """(file, file_name, width, height, category, x1..y2, difficult, truncated) of Pascal VOC XML files; a file without a
    name is that of the XML as jpg."""
    schema = "folder string, filename string, size struct<width:string,height:string>, object array<struct<name:string,truncated:string,difficult:string,bndbox:struct<xmin:string,ymin:string,xmax:string,ymax:string>>>"
    doc = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(path)
    file = F.col("_metadata.file_path")
    named = F.coalesce(F.nullif(F.trim("filename"), F.lit("")), F.concat(F.regexp_extract(file, STEM, 1), F.lit(".jpg")))
    rows = doc.select(file.alias("file"), named.alias("filename"), "size", F.explode_outer("object").alias("o"))
    less = 1.0 if one_based else 0.0
    num = lambda c: F.col(f"o.bndbox.{c}").try_cast("double")
    return rows.select("file", F.col("filename").alias("file_name"), F.col("size.width").try_cast("int").alias("width"), F.col("size.height").try_cast("int").alias("height"), F.trim("o.name").alias("category"), (num("xmin") - less).alias("x1"), (num("ymin") - less).alias("y1"), num("xmax").alias("x2"), num("ymax").alias("y2"), (F.col("o.difficult") == "1").alias("difficult"), (F.col("o.truncated") == "1").alias("truncated"))


def labelme(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, file_name, category, x1..y2): rectangles, polygons of three points or more, circles; other shapes are left out."""
    schema = "imagePath string, imageWidth int, imageHeight int, shapes array<struct<label:string,shape_type:string,points:array<array<double>>>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.col("_metadata.file_path").alias("file"), F.replace(F.trim(F.coalesce("imagePath", F.lit(""))), F.lit("\\"), F.lit("/")).alias("file_name"), F.explode("shapes").alias("s")).where(F.size("s.points") >= 2)
    xs, ys = F.expr("transform(s.points, p -> p[0])"), F.expr("transform(s.points, p -> p[1])")
    r = F.hypot(F.get(xs, F.lit(1)) - F.get(xs, F.lit(0)), F.get(ys, F.lit(1)) - F.get(ys, F.lit(0)))
    round_ = F.col("s.shape_type") == "circle"
    ok = (F.col("s.shape_type") == "rectangle") | ((F.col("s.shape_type") == "polygon") & (F.size("s.points") >= 3)) | round_
    side = lambda v, low: F.when(round_, F.get(v, F.lit(0)) + (-r if low else r)).otherwise(F.array_min(v) if low else F.array_max(v))
    return rows.where(ok).select("file", "file_name", F.trim("s.label").alias("category"), side(xs, True).alias("x1"), side(ys, True).alias("y1"), side(xs, False).alias("x2"), side(ys, False).alias("y2"))


_OPENLABEL = "openlabel struct<metadata:struct<name:string>,actions:map<string,struct<type:string,frame_intervals:array<struct<frame_start:string,frame_end:string>>>>,objects:map<string,struct<type:string,frame_intervals:array<struct<frame_start:string,frame_end:string>>>>,streams:map<string,struct<stream_properties:struct<total_frames:string>>>>"


def _openlabel(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(_OPENLABEL).option("multiLine", "true").json(path).select(F.input_file_name().alias("file"), "openlabel")


def openlabel_intervals(spark: SparkSession, path: str | list[str], level: str | None = None, include_objects: bool = False) -> DataFrame:
    """(file, label, start, end) of the action intervals of OpenLABEL files, ends included, and of the objects' if asked for.

    Actions are those of the level, without its name, or all with it; an object's type is its label. Intervals without two
    whole numbers are left out, as are actions without a label."""
    doc = _openlabel(spark, path)

    def spans(kind: str) -> DataFrame:
        rows = doc.select("file", F.explode(F.map_values(f"openlabel.{kind}")).alias("a")).select("file", F.col("a.type").alias("label"), F.inline("a.frame_intervals"))
        number = lambda c: F.col(c).try_cast("bigint")
        return rows.select("file", "label", number("frame_start").alias("start"), number("frame_end").alias("end")).where("start is not null and `end` is not null")

    rows = spans("actions")
    if level:
        rows = rows.where(F.col("label").startswith(f"{level}/")).withColumn("label", F.expr(f"substring(label, {len(level) + 2})"))
    rows = rows.where(~F.col("label").isin("NAN", "--", ""))
    return rows.unionByName(spans("objects").where("coalesce(label, '') <> ''")) if include_objects else rows


def openlabel_videos(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, video, total_frames): the name, else that of the file, and the most frames that a stream declares (null: none)."""
    total = F.array_max(F.transform(F.map_values("openlabel.streams"), lambda s: s["stream_properties"]["total_frames"].try_cast("bigint")))
    name = F.coalesce(F.nullif(F.col("openlabel.metadata.name"), F.lit("")), F.regexp_extract("file", STEM, 1))
    return _openlabel(spark, path).where("openlabel is not null").select("file", name.alias("video"), total.alias("total_frames"))


def frame_labels(frames: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """frames(key, frame, ...) with every label of intervals(key, label, start, end) whose interval, ends included, holds the frame.

    An interval is cut at the edges of bins as wide as the largest power of 16 that it holds, so it makes 17 rows at most,
    however long it is; frames look it up in their bin of each width that occurs (16 at most: a broadcast of few numbers). A
    frame and an interval meet in one bin only, and at least a third of the meetings are results where frames are dense."""
    own = intervals.where("end >= start").select(key, "label", "start", "end", ((F.length(F.hex(F.col("end") - F.col("start") + 1)) - 1) * 4).alias("__shift"))
    at = lambda c: F.call_function("shiftright", F.col(c).cast("bigint"), F.col("__shift"))
    cut = own.select(key, "label", "start", "end", "__shift", F.explode(F.sequence(at("start"), at("end"))).alias("__bin"))
    asked = frames.crossJoin(F.broadcast(own.select("__shift").distinct())).withColumn("__bin", at("frame"))
    return asked.join(cut, [key, "__shift", "__bin"]).where("frame between start and end").select(*frames.columns, "label")


def frame_label_totals(frames: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """(key, label, n, total): the number of rows that frame_labels has for each label, and the sum of their frames, without
    making those rows, which grow with frames times intervals where intervals are long.

    An interval holds the frames up to its end less those before its start, so running counts of the frames in order are
    read at both. Frames and ends are dealt out by ranges; in each range the counts run from its beginning, and what earlier
    ranges hold is added per label at the end. A range makes a row per label, and only those rows meet by key. Sums are
    exact decimals inside; a total beyond 64 bits is an error, as it is for a sum of the rows."""
    wide = lambda c: c.cast("decimal(20,0)")
    own = intervals.where("end >= start").where(F.col(key).isNotNull())
    edges = F.array(*[F.struct(F.col(c).cast("bigint").alias("__at"), F.lit(kind).alias("__kind"), F.lit(sign).alias("w")) for c, kind, sign in (("start", 0, -1), ("end", 2, 1))])
    ends = own.select(key, "label", F.inline(edges)).groupBy(key, "label", "__at", "__kind").agg(F.sum("w").alias("__w"))
    held = frames.where(F.col(key).isNotNull() & F.col("frame").isNotNull()).groupBy(key, F.col("frame").cast("bigint").alias("__at")).agg(F.count(F.lit(1)).alias("__w"))
    label = F.lit(None).cast(intervals.schema["label"].dataType).alias("label")
    rows = held.select(key, label, "__at", F.lit(1).alias("__kind"), "__w").unionByName(ends)
    rows = rows.repartitionByRange(key, "__at", "__kind").withColumn("__part", F.spark_partition_id())
    is_frame = F.col("__kind") == 1
    rows = rows.withColumns({"__f": F.when(is_frame, F.col("__w")).otherwise(0), "__s": F.when(is_frame, wide(F.col("__w")) * wide(F.col("__at"))).otherwise(0)})
    running = Window.partitionBy("__part", key).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"__n": F.sum("__f").over(running), "__t": F.sum("__s").over(running)})
    parts = rows.groupBy("__part", key, "label", is_frame.alias("__frames")).agg(F.sum("__f").alias("f"), F.sum("__s").alias("s"), F.sum("__w").alias("w"), F.sum(F.col("__w") * F.col("__n")).alias("n"), F.sum(wide(F.col("__w")) * F.col("__t")).alias("t"))
    before = Window.partitionBy(key).orderBy("__part").rangeBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"f": F.coalesce(F.sum("f").over(before), F.lit(0)), "s": F.coalesce(F.sum("s").over(before), F.lit(0))}).where("not __frames")
    out = parts.groupBy(key, "label").agg(F.sum(F.col("n") + F.col("w") * F.col("f")).alias("n"), F.sum(F.col("t") + wide(F.col("w")) * F.col("s")).alias("total"))
    return out.where("n > 0").select(key, "label", "n", F.col("total").cast("bigint").alias("total"))


def yolo_lines(images: DataFrame, annotations: DataFrame, classes: DataFrame) -> DataFrame:
    """(uid, split, lines, n): normalised label lines of every image, clamped to it, boxes without area left out;
    unassigned images are train, images without boxes have empty lines."""
    rows = annotations.where("kind = 'bbox' and x1 is not null").join(F.broadcast(classes), "category").join(images.where("width > 0 and height > 0").select("uid", "width", "height"), F.expr("image_uid = uid"))
    clip = lambda c, s: F.greatest(F.lit(0.0), F.least(F.col(c), F.col(s).cast("double")))
    rows = rows.select("uid", "index", "width", "height", clip("x1", "width").alias("x1"), clip("y1", "height").alias("y1"), clip("x2", "width").alias("x2"), clip("y2", "height").alias("y2")).where("x2 > x1 and y2 > y1")
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "index", F.expr("(x1 + x2) / 2 / width"), F.expr("(y1 + y2) / 2 / height"), F.expr("(x2 - x1) / width"), F.expr("(y2 - y1) / height"))
    lines = rows.select("uid", line.alias("l")).groupBy("uid").agg(F.array_join(F.array_sort(F.collect_list("l")), "\n").alias("lines"), F.count(F.lit(1)).alias("n"))
    return images.join(lines, "uid", "left").select("uid", F.coalesce("split", F.lit("train")).alias("split"), F.coalesce("lines", F.lit("")).alias("lines"), F.coalesce("n", F.lit(0)).alias("n"))
