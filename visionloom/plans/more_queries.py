"""Registered queries of findings, splits, exports, jobs and reviews over the benchmark tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visionloom.operators import analytics, evals, export, jobs, review, split
from visionloom.plans import ir
from visionloom.plans.ir import annotations, images, load

Query = Callable[[SparkSession, str], DataFrame]


def _units(s: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 1000 == 7, "val").otherwise("train")
    return load(s, d, "customer").select(F.col("c_name").alias("unit"), name.alias("split"))


def _minimums(s: SparkSession, d: str) -> DataFrame:
    return split.ensure_minimums(_units(s, d), 25, 15).where("split <> 'train'")


def _named(s: SparkSession, d: str) -> DataFrame:
    """Images of which many share a file name."""
    return images(s, d).withColumn("rel_path", F.concat(F.lit("d/"), (F.col("ord") % 997).cast("string"), F.lit(".jpg")))


def _classes(s: SparkSession, d: str) -> DataFrame:
    return export.resolve_classes(annotations(s, d))


def _label_counts(s: SparkSession, d: str) -> DataFrame:
    known = _classes(s, d).where("category <> 'PROMO'")
    return export.detection_labels(images(s, d), annotations(s, d), known).select("uid", "boxes", "clamped", "dropped", "reason")


def _placed(policy: str) -> Query:
    return lambda s, d: export.classification_targets(images(s, d), annotations(s, d), _classes(s, d), policy)


def _ended(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "events").selectExpr("event_id", "event_id % 11 = 0 AS stopped", "CASE WHEN event_id % 5 < 3 THEN CAST(event_id % 5 AS INT) END AS code", "CASE WHEN event_id % 3 < 2 THEN event_id % 3 = 0 END AS ok")
    return e.select("event_id", *[jobs.end_status(k, F.col("stopped"), F.col("code"), F.col("ok")).alias(k) for k in ("train", "eval", "deploy")])


def _logged(s: SparkSession, d: str) -> DataFrame:
    chunks = load(s, d, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("arrival"), F.regexp_replace("text", "[.] ", "\n").alias("chunk"))
    return jobs.log_page(jobs.number_lines(jobs.log_lines(chunks)), 2, 4)


def _pictures(s: SparkSession, d: str) -> DataFrame:
    names = ["val_batch0_Pred.jpg", "val_batch1_labels.jpg", "train_batch2.jpg", "labels.jpg", "PR_curve.png", "confusion_matrix.png", "results.png", "x.png"]
    return jobs.picture_groups(load(s, d, "part").select(F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 8 + 1).cast("int")).alias("name")))


def _weights(s: SparkSession, d: str) -> DataFrame:
    a = load(s, d, "supplier").select(F.concat(F.lit("W/"), (F.col("s_suppkey") % 40).cast("string"), F.lit(".pt")).alias("path"), F.col("s_name").alias("label"))
    b = load(s, d, "customer").select(F.concat(F.lit("w/"), (F.col("c_custkey") % 60).cast("string"), F.lit(".PT")).alias("path"), F.col("c_name").alias("label"))
    return jobs.weights([a, b]).withColumn("format", jobs.weights_format(F.col("path")))


def _hits(s: SparkSession, d: str) -> DataFrame:
    return review.top_hits(load(s, d, "embeddings"), "embedding").select("vec_id", F.posexplode("hits").alias("place", "h")).select("vec_id", "place", "h.class_index")


def _validated(s: SparkSession, d: str) -> DataFrame:
    rows = annotations(s, d).where("kind = 'bbox'").join(images(s, d).select("uid", "width", "height"), F.expr("image_uid = uid"))
    return review.validate_box(rows).groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.sum("x2").alias("sum_x2"))


def _reviewed(s: SparkSession, d: str) -> DataFrame:
    return review.filter_images(images(s, d), annotations(s, d), "empty").select("uid")


def _overall(s: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("event_type") == "click", "metrics/mAP50(B)").when(F.col("event_type") == "view", "fitness").otherwise("else")
    rows = load(s, d, "events").groupBy(F.col("user_id").alias("eval_id"), key.alias("key")).agg(F.max("value").alias("value"))
    f1 = load(s, d, "events").select(F.col("user_id").alias("eval_id"), F.expr("event_id % 16 / 16.0D").alias("f1"))
    return evals.overall(rows, f1)


def queries() -> dict[str, Query]:
    both = lambda f: lambda s, d: f(images(s, d), annotations(s, d))
    return {
        "ds_findings": both(analytics.findings),
        "ds_concentration": lambda s, d: analytics.concentration(annotations(s, d)),
        "split_minimums": _minimums,
        "split_ratio_deviation": lambda s, d: split.ratio_deviation(images(s, d)),
        "export_file_names": lambda s, d: export.target_stems(_named(s, d)),
        "export_label_counts": _label_counts,
        "export_class_folders": _placed("duplicate"),
        "export_class_skipped": _placed("skip"),
        "job_end_states": _ended,
        "job_log_page": _logged,
        "job_picture_groups": _pictures,
        "weights_list": _weights,
        "infer_top_hits": _hits,
        "review_validate": _validated,
        "review_empty": _reviewed,
        "eval_overall": _overall,
    }


_W = "WITH " + ir.SQL.strip()
_BOX = "greatest(0.0, x2 - x1) * greatest(0.0, y2 - y1)"
_STATE = """CASE WHEN stopped THEN 'stopped' {} ELSE 'failed' END"""


def _placed_sql(skip: bool) -> str:
    rows = "SELECT uid, CAST(NULL AS VARCHAR) AS category, 'several labels' AS reason FROM g WHERE n > 1 UNION ALL SELECT uid, cats[1], NULL FROM g WHERE n = 1" if skip else "SELECT uid, unnest(cats) AS category, CAST(NULL AS VARCHAR) AS reason FROM g WHERE n > 0"
    return _W + f", g AS (SELECT uid, count(DISTINCT category) AS n, list_distinct(list(category)) AS cats FROM im LEFT JOIN an ON image_uid = uid AND kind = 'image' GROUP BY uid) {rows} UNION ALL SELECT uid, NULL, 'no label' FROM g WHERE n = 0"


def oracle_sql() -> dict[str, str]:
    return {
        "ds_findings": _W
        + f""", c AS (SELECT category, count(*) AS c FROM an GROUP BY 1), j AS (SELECT split, category FROM an JOIN im ON image_uid = uid),
  b AS (SELECT count(*) FILTER (kind = 'bbox') AS boxes, count(*) FILTER (kind = 'image') AS labels, count(*) FILTER (kind = 'bbox' AND {_BOX} < 1024) AS small, count(*) FILTER (kind = 'bbox' AND {_BOX} > 9216) AS large FROM an),
  sz AS (SELECT count(*) AS n FROM im GROUP BY width, height), loose AS (SELECT count(*) AS n FROM im WHERE split IS NULL),
  cs AS (SELECT category, count(*) FILTER (split = 'val') AS v, count(*) FILTER (split = 'test') AS t FROM j GROUP BY 1),
  tv AS (SELECT split, count(*) AS t FROM j WHERE split IN ('val', 'test') GROUP BY split), al AS (SELECT category, count(*) / (SELECT count(*) FROM j) AS q FROM j GROUP BY category),
  sh AS (SELECT al.category, q, (SELECT count(*) FROM j WHERE j.split = tv.split AND j.category = al.category) / t AS p FROM al, tv),
  f AS (
  SELECT 'few_instances' AS code, 'warning' AS level, count(*)::DOUBLE AS value, count(*) > 0 AS y FROM c WHERE c < 20
  UNION ALL SELECT 'imbalanced', 'advice', max(c) / min(c), max(c) / min(c) >= 10 FROM c
  UNION ALL SELECT 'mostly_small', 'advice', small / boxes, small / boxes > 0.5 FROM b
  UNION ALL SELECT 'mostly_large', 'advice', large / boxes, large / boxes > 0.8 FROM b
  UNION ALL SELECT 'unlabeled', CASE WHEN labels > 0 AND boxes = 0 THEN 'error' ELSE 'info' END, n, n > 0 FROM b, (SELECT count(*) AS n FROM im WHERE uid NOT IN (SELECT image_uid FROM an))
  UNION ALL SELECT 'unassigned', 'info', n, n > 0 FROM loose
  UNION ALL SELECT 'missing_in_val', 'warning', m, m > 0 AND n = 0 FROM loose, (SELECT count(*) AS m FROM cs WHERE v = 0)
  UNION ALL SELECT 'missing_in_test', 'warning', m, m > 0 AND n = 0 FROM loose, (SELECT count(*) AS m FROM cs WHERE t = 0)
  UNION ALL SELECT 'shifted', 'warning', count(*), count(*) > 0 FROM sh WHERE abs(round(p - q, 6)) >= 0.1
  UNION ALL SELECT 'mixed_sizes', 'info', max(n) / sum(n), count(*) > 1 AND max(n) / sum(n) < 0.8 FROM sz
  UNION ALL SELECT 'one_size', 'info', max(n) / sum(n), count(*) = 1 FROM sz)
SELECT code, level, round(value, 4) AS value FROM f WHERE y UNION ALL SELECT 'healthy', 'info', NULL WHERE NOT EXISTS (SELECT 1 FROM f WHERE y AND code <> 'one_size')""",
        "ds_concentration": _W + ", c AS (SELECT count(*) AS c FROM an GROUP BY category), r AS (SELECT c, row_number() OVER (ORDER BY c DESC) AS k, count(*) OVER () AS n FROM c) SELECT max(n) AS classes, greatest(1, CAST(floor(max(n) * 0.2) AS BIGINT)) AS top, round(sum(c) FILTER (k <= greatest(1, floor(n * 0.2))) / sum(c), 4) AS top_share FROM r",
        "split_minimums": "WITH u AS (SELECT c_name AS unit, CASE WHEN c_custkey % 1000 = 7 THEN 'val' ELSE 'train' END AS split FROM customer), n AS (SELECT greatest(0, 25 - count(*)) AS v FROM u WHERE split = 'val'), r AS (SELECT unit, row_number() OVER (ORDER BY unit) AS k FROM u WHERE split = 'train') SELECT unit, CASE WHEN k <= v THEN 'val' ELSE 'test' END AS split FROM r, n WHERE k <= v + 15 UNION ALL SELECT unit, split FROM u WHERE split = 'val'",
        "split_ratio_deviation": _W + ", t AS (SELECT * FROM (VALUES ('train', 0.8::DOUBLE), ('val', 0.1), ('test', 0.1)) v(split, target)), c AS (SELECT split, count(*) AS k FROM im WHERE split IS NOT NULL GROUP BY 1), s AS (SELECT t.split, target, round(coalesce(k, 0) / (SELECT sum(k) FROM c), 4) AS actual FROM t LEFT JOIN c USING (split)) SELECT split, target, actual, (SELECT max(abs(actual - target)) > 0.03 FROM s) AS off FROM s",
        "export_file_names": _W + """, r AS (SELECT uid, coalesce(split, 'train') AS split, CAST(ord % 997 AS VARCHAR) AS own, source_id || '_' || CAST(ord % 997 AS VARCHAR) AS sourced, split IS NULL AS late, ord FROM im),
  a AS (SELECT *, row_number() OVER (PARTITION BY split, own ORDER BY late, ord) AS k FROM r), b AS (SELECT *, row_number() OVER (PARTITION BY split, sourced ORDER BY late, ord) AS k2 FROM a WHERE k > 1),
  s AS (SELECT *, sourced || '_' || left(uid, 8) AS short FROM b WHERE k2 > 1)
SELECT uid, split, own AS stem FROM a WHERE k = 1 UNION ALL SELECT uid, split, sourced FROM b WHERE k2 = 1
UNION ALL SELECT uid, split, CASE WHEN count(*) OVER (PARTITION BY split, short) > 1 THEN sourced || '_' || uid ELSE short END FROM s""",
        "export_label_counts": _W + """, j AS (SELECT uid, category, least(greatest(x1, 0.0), width) AS a, least(greatest(x2, 0.0), width) AS b, least(greatest(y1, 0.0), height) AS c, least(greatest(y2, 0.0), height) AS d,
  x1 < -0.001 OR y1 < -0.001 OR x2 < -0.001 OR y2 < -0.001 OR x1 > width + 0.001 OR x2 > width + 0.001 OR y1 > height + 0.001 OR y2 > height + 0.001 AS o FROM an JOIN im ON image_uid = uid WHERE kind = 'bbox'),
  g AS (SELECT uid, count(*) AS boxes, count(*) FILTER (o) AS clamped, count(*) FILTER (b <= a OR d <= c) AS dropped, count(*) FILTER (category = 'PROMO') AS u FROM j GROUP BY uid)
SELECT uid, coalesce(boxes, 0) AS boxes, coalesce(clamped, 0) AS clamped, coalesce(dropped, 0) AS dropped, CASE WHEN width <= 0 OR height <= 0 THEN 'unknown size' WHEN u > 0 THEN 'unknown class' END AS reason FROM im LEFT JOIN g USING (uid)""",
        "export_class_folders": _placed_sql(False),
        "export_class_skipped": _placed_sql(True),
        "job_end_states": "WITH e AS (SELECT event_id, event_id % 11 = 0 AS stopped, CASE WHEN event_id % 5 < 3 THEN event_id % 5 END AS code, CASE WHEN event_id % 3 < 2 THEN event_id % 3 = 0 END AS ok FROM events) SELECT event_id, "
        + _STATE.format("WHEN code = 0 THEN 'finished' WHEN code IS NULL THEN 'interrupted'") + " AS train, "
        + _STATE.format("WHEN code = 0 OR code IS NULL AND ok THEN 'finished' WHEN code IS NULL AND ok IS NULL THEN 'interrupted'") + ' AS "eval", '
        + _STATE.format("WHEN ok THEN 'finished' WHEN NOT ok THEN 'failed' WHEN code = 0 THEN 'finished' WHEN code IS NULL THEN 'interrupted'") + " AS deploy FROM e",
        "job_log_page": "WITH p AS (SELECT conv_id AS run_id, turn, string_split(replace(text, '. ', chr(10)), chr(10)) AS a FROM conversations), x AS (SELECT run_id, turn, generate_subscripts(a, 1) AS pos, unnest(a) AS line FROM p), n AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY turn, pos) - 1 AS seq, line FROM x WHERE trim(line) <> '') SELECT * FROM n WHERE seq >= 2 AND seq < 6",
        "job_picture_groups": "WITH g AS (SELECT (['val_pred', 'val_labels', 'train_batch', 'labels', 'curve', 'matrix', 'curve', 'other'])[p_partkey % 8 + 1] AS grp FROM part) SELECT grp, CAST(list_position(['val_pred', 'val_labels', 'train_batch', 'labels', 'curve', 'matrix', 'other'], grp) - 1 AS INT) AS rank, count(*) AS pictures FROM g GROUP BY grp",
        "weights_list": "WITH u AS (SELECT 'W/' || CAST(s_suppkey % 40 AS VARCHAR) || '.pt' AS path, s_name AS label, 0 AS rank FROM supplier UNION ALL SELECT 'w/' || CAST(c_custkey % 60 AS VARCHAR) || '.PT', c_name, 1 FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY rank, label, path) AS k FROM u) SELECT path, label, rank, 'pt' AS format FROM r WHERE k = 1",
        "infer_top_hits": "WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS class_index FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, class_index) - 1 AS place FROM x) SELECT vec_id, CAST(place AS INT) AS place, CAST(class_index AS INT) AS class_index FROM r WHERE place < 5",
        "review_validate": _W + ", j AS (SELECT category, least(greatest(x1, 0.0), width) AS a, least(greatest(x2, 0.0), width) AS b, least(greatest(y1, 0.0), height) AS c, least(greatest(y2, 0.0), height) AS d FROM an JOIN im ON image_uid = uid WHERE kind = 'bbox') SELECT CASE WHEN b <= a OR d <= c THEN 'no_area' WHEN trim(category) = '' THEN 'blank_category' END AS problem, count(*) AS n, sum(b::DOUBLE) AS sum_x2 FROM j GROUP BY 1",
        "review_empty": _W + "SELECT uid FROM im WHERE uid NOT IN (SELECT image_uid FROM an)",
        "eval_overall": "WITH k AS (SELECT user_id AS eval_id, CASE event_type WHEN 'click' THEN 'mAP50' ELSE 'fitness' END AS metric, round(max(value), 6) AS value FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL) SELECT * FROM k WHERE value IS NOT NULL UNION ALL SELECT user_id, 'f1', round(avg(event_id % 16 / 16.0::DOUBLE), 6) FROM events GROUP BY 1",
    }
