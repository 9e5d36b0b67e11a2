"""Union of datasets with conflicting image ids resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visionloom.functions.scalar import make_uid


def merge(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, warnings): a right image with a left uid goes, with its annotations, if its path is the same,
    and gets a new uid if not."""
    (li, la), (ri, ra) = left, right
    clash = ri.select("uid", "rel_path").join(li.select("uid", F.col("rel_path").alias("__path")), "uid")
    same = clash.where("rel_path <=> __path").select("uid")
    renamed = clash.where("not (rel_path <=> __path)").select("uid", make_uid(F.lit("dedup"), F.col("rel_path"), F.col("uid")).alias("__new"))
    move = lambda df, key: df.join(same, df[key] == same["uid"], "left_anti").join(renamed.withColumnRenamed("uid", "__old"), F.col(key) == F.col("__old"), "left").withColumn(key, F.coalesce("__new", key)).select(*df.columns)
    warnings = same.select("uid", F.lit("same path in both sources: the second is left out").alias("text"))
    return li.unionByName(move(ri, "uid")), la.unionByName(move(ra, "image_uid")), warnings
