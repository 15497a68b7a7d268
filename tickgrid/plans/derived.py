"""Box relations derived from the star-schema tables by integer arithmetic, as one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks that the lines of one split of the file are dealt to: a task's rows don't grow with the table.
TASKS = 8

BOX_BASE = """SELECT l_orderkey AS page_id, l_linenumber AS ln, MIN(l_partkey) AS pk, MIN(l_suppkey) AS sk,
  CAST(MIN(l_quantity) AS INT) AS q, CAST(ROUND(MIN(l_discount) * 100) AS INT) AS d, CAST(ROUND(MIN(l_tax) * 100) AS INT) AS t
FROM lineitem GROUP BY l_orderkey, l_linenumber"""
BOXES_GOLD = """SELECT page_id, ln AS box_id, 60*ln + pk%5 AS x1, 40*(ln%2) + sk%7 AS y1,
  60*ln + pk%5 + 22 + pk%4 + CASE WHEN pk%17 = 0 THEN 12 ELSE 0 END AS x2, 40*(ln%2) + sk%7 + 22 + sk%3 AS y2,
  q%3 = 0 AS is_checked, pk%41 = 0 AS ignore, pk, sk, q, d, t FROM box_base"""
BOXES_PRED = """SELECT page_id, box_id, x1 + (pk%13) - 6 AS x1, y1 + (sk%5) - 2 AS y1, x2 + (pk%13) - 6 AS x2, y2 + (sk%5) - 2 AS y2,
  CASE WHEN pk%23 = 0 THEN NOT is_checked ELSE is_checked END AS is_checked, pk, sk FROM boxes_gold WHERE (pk + box_id)%29 <> 0
UNION ALL SELECT page_id, box_id + 100, x1 + 1000, y1, x2 + 1000, y2, is_checked, pk, sk FROM boxes_gold WHERE pk%31 = 0"""
FEATURES = """SELECT page_id, ln AS box_id, pk, sk, q, d, t, CAST(d*3 + q%2 AS DOUBLE)/CAST(100 AS DOUBLE) AS ink,
  CASE WHEN d*3 + q%2 > 1 THEN ln ELSE 0 END AS n,
  CASE WHEN d*3 + q%2 > 1 THEN CAST(t AS DOUBLE)/CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS largest,
  CASE WHEN d*3 + q%2 > 1 THEN CAST(q*2 AS DOUBLE)/CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS span,
  CASE WHEN d*3 + q%2 > 1 THEN CAST(sk%10 AS DOUBLE)/CAST(10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS outside FROM box_base"""
PAGES = """SELECT o_orderkey AS page_id, CASE o_orderstatus WHEN 'F' THEN 'sample' WHEN 'O' THEN 'synth-sweep' ELSE 'holdout' END AS corpus,
  substr(o_orderpriority, 1, 1) AS factor FROM orders"""
ALL = {"box_base": BOX_BASE, "boxes_gold": BOXES_GOLD, "boxes_pred": BOXES_PRED, "features": FEATURES, "pages_meta": PAGES}
WITH = "WITH RECURSIVE " + ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in ALL.items())


#: The same rows as BOXES_PRED from one pass over the labels.
PRED_ONCE = """SELECT page_id, box_id, x1, y1, x2, y2, is_checked, pk, sk FROM (SELECT page_id, inline(array(
  CASE WHEN (pk + box_id)%29 <> 0 THEN named_struct('held', TRUE, 'box_id', box_id, 'x1', x1 + (pk%13) - 6, 'y1', y1 + (sk%5) - 2, 'x2', x2 + (pk%13) - 6, 'y2', y2 + (sk%5) - 2, 'is_checked', CASE WHEN pk%23 = 0 THEN NOT is_checked ELSE is_checked END, 'pk', pk, 'sk', sk) END,
  CASE WHEN pk%31 = 0 THEN named_struct('held', TRUE, 'box_id', box_id + 100, 'x1', x1 + 1000, 'y1', y1, 'x2', x2 + 1000, 'y2', y2, 'is_checked', is_checked, 'pk', pk, 'sk', sk) END)) FROM boxes_gold) WHERE held"""


def dealt(lines: DataFrame) -> DataFrame:
    """Lines dealt by page, once: what follows by page, or by page and more, finds its rows together."""
    return lines.repartition(TASKS * max(1, lines.rdd.getNumPartitions()), "l_orderkey")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation over sf_dir's tables; only what it needs is read. Relations of boxes are dealt by page."""
    if name == "pages_meta":
        return spark.sql(PAGES.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return relations(spark, sf_dir, name)[0]


def relations(spark: SparkSession, sf_dir: str, *names: str) -> tuple[DataFrame, ...]:
    """Several relations of boxes from one dealing of the lines: a plan that holds more than one of them reuses its shuffle."""
    lines = dealt(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    own = ALL | {"boxes_pred": PRED_ONCE}
    needs = {"box_base": (), "boxes_gold": ("box_base",), "boxes_pred": ("box_base", "boxes_gold"), "features": ("box_base",)}
    out = []
    for name in names:
        ctes = ", ".join(f"{n} AS ({own[n]})" for n in needs[name])
        out.append(spark.sql(((f"WITH {ctes} " if ctes else "") + own[name]).replace("FROM lineitem", "FROM {lineitem}"), lineitem=lines))
    return tuple(out)


def twinned(boxes: DataFrame, when: Column, **moved: Column) -> DataFrame:
    """boxes, and beside each for which ``when`` holds a twin with some columns changed; all stay dealt by page."""
    names = [c for c in boxes.columns if c != "page_id"]
    row = lambda **v: F.struct(F.lit(True).alias("_held"), *[v.get(c, F.col(c)).cast(boxes.schema[c].dataType).alias(c) for c in names])
    return boxes.select("page_id", F.inline(F.array(row(), F.when(when, row(**moved))))).where("_held").select(*boxes.columns)
