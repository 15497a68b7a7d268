"""The grid index and what is chosen in rounds: against plain loops, on crowded pages and on one of fifty thousand boxes."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickgrid import catalogue, reports
from tickgrid.functions.lineage import as_dealt
from tickgrid.operators import grid, spatial

BOXES = "page_id long, box_id int, x1 int, y1 int, x2 int, y2 int, is_checked boolean"


def iou(a, b):
    both = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
    return both / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - both) if both else 0.0


def drawn(seed, pages, n, span, sizes):
    r = np.random.default_rng(seed)
    out = []
    for p in range(pages):
        for i in range(n):
            (x, y), (w, h) = r.integers(-60, span, 2).tolist(), r.integers(*sizes, 2).tolist()
            out.append((p, i, x, y, x + w, y + h, bool(r.integers(2))))
    return out


def greedy(pred, gold, least):
    pairs = sorted((-v, p[0], p[1], g[1]) for p in pred for g in gold if p[0] == g[0] and (v := iou(p, g)) >= least)
    ps, gs, out = set(), set(), set()
    for _, page, p, g in pairs:
        if (page, p) not in ps and (page, g) not in gs:
            ps.add((page, p))
            gs.add((page, g))
            out.add((page, p, g))
    return out


@pytest.mark.parametrize("sizes, span, least", [((1, 60), 90, 0.5), ((0, 900), 700, 0.5), ((1, 400), 500, 0.2), ((3, 30), 60, 0.05)])
def test_every_overlapping_pair_is_met_once(spark, sizes, span, least):
    pred, gold = drawn(1, 4, 40, span, sizes), drawn(2, 4, 40, span, sizes)
    p, g = spark.createDataFrame(pred, BOXES), spark.createDataFrame(gold, BOXES).withColumn("ignore", F.col("box_id") % 7 == 0)
    got = [(r["page_id"], r["p_box_id"], r["g_box_id"]) for r in spatial.candidates(p, g, least).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a[0], a[1], b[1]) for a in pred for b in gold if a[0] == b[0] and iou(a, b) >= least}
    matched = greedy(pred, gold, least)
    assert {(r["page_id"], r["p_box_id"], r["g_box_id"]) for r in spatial.greedy_match(spatial.candidates(p, g, least)).collect()} == matched
    n = {r["page_id"]: r for r in spatial.match_counts(p, g, least).collect()}
    for page in range(4):
        own = [(a, b) for q, a, b in matched if q == page]
        state = {(s, t[1]): t[6] for s, side in (("p", pred), ("g", gold)) for t in side if t[0] == page}
        assert (n[page]["preds"], n[page]["golds"], n[page]["ignored"], n[page]["matched"]) == (40, 40, 6, len(own))
        assert n[page]["right"] == sum(b % 7 != 0 and state["p", a] == state["g", b] for a, b in own)


def test_a_chain_of_better_pairs(spark):
    rows = [(1, i, j, 0.5 + 0.004 * (2 * i + j - i)) for i in range(40) for j in (i, i + 1)]
    got = spatial.greedy_match(spark.createDataFrame(rows, "page_id long, p_box_id int, g_box_id int, iou double")).collect()
    assert {(r["p_box_id"], r["g_box_id"]) for r in got} == {(i, i + 1) for i in range(40)}
    assert spatial.greedy_match(spark.createDataFrame([], "page_id long, p_box_id int, g_box_id int, iou double")).count() == 0


@pytest.mark.parametrize("metric, closed", [("l1", True), ("l1", False), ("axes", True)])
def test_points_within(spark, metric, closed):
    r = np.random.default_rng(3)
    a, b = ([(int(p), i, float(x) / 2, float(y) / 2) for i, (p, x, y) in enumerate(zip(r.integers(0, 3, 120), r.integers(-90, 150, 120), r.integers(-90, 150, 120), strict=True))] for _ in range(2))
    near = lambda s, t: (abs(s[2] - t[2]) + abs(s[3] - t[3]) if metric == "l1" else max(abs(s[2] - t[2]), abs(s[3] - t[3])))
    want = {(s[0], s[1], t[1]) for s in a for t in b if s[0] == t[0] and (near(s, t) <= 9 if closed else near(s, t) < 9)}
    points, others = spark.createDataFrame(a, "page_id long, point_id int, x double, y double"), spark.createDataFrame(b, "page_id long, id int, ox double, oy double")
    got = [(t["page_id"], t["point_id"], t["id"]) for t in grid.within(points, others, "x", "y", "ox", "oy", 9.0, metric=metric, closed=closed).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    left = grid.within(points, others, "x", "y", "ox", "oy", 9.0, how="left_anti", metric=metric, closed=closed)
    assert {t["point_id"] for t in left.collect()} == {s[1] for s in a} - {w[1] for w in want}


def test_nearest_looks_in_wider_rings(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0, 10, 10, True), (1, 2, 20, 0, 30, 10, True), (2, 1, 9000, 9000, 9010, 9010, True)], BOXES)
    points = spark.createDataFrame([(1, 1, 6.0, 5.0), (1, 2, 15.0, 5.0), (1, 3, 500.0, 5.0), (2, 1, 0.0, 0.0), (3, 1, 0.0, 0.0)], "page_id long, point_id int, cx double, cy double")
    got = {(r["page_id"], r["point_id"]): (r["box_id"], r["far"]) for r in spatial.nearest(points, boxes, F.lit(33)).collect()}
    assert got == {(1, 1): (1, 1.0), (1, 2): (1, 10.0), (1, 3): (None, 475.0), (2, 1): (None, 18010.0), (3, 1): (None, None)}


def first_wins(rows, tolerance):
    out = set()
    for page in {t[0] for t in rows}:
        kept = []
        for t in sorted(t for t in rows if t[0] == page):
            x, y = (t[2] + t[4]) / 2, (t[3] + t[5]) / 2
            if all(abs(x - a) + abs(y - b) > tolerance for a, b in kept):
                kept.append((x, y))
                out.add(t)
    return out


def test_dedupe_in_rounds(spark):
    rows = [*drawn(5, 6, 60, 100, (8, 12)), *[(9, i, 4 * i, 0, 4 * i + 10, 10, False) for i in range(30)], *[(10, i, 5, 5, 9, 9, False) for i in range(50)]]
    got = {tuple(r) for r in spatial.dedupe(spark.createDataFrame(rows, BOXES), 9.0).collect()}
    assert got == first_wins(rows, 9.0) and len([t for t in got if t[0] == 10]) == 1


def test_folding_follows_the_order_of_cards(spark):
    labels = spark.createDataFrame([(1, i, 100 * i, 0, 100 * i + 20, 20, False, i % 2 == 1) for i in range(5)], BOXES + ", ignore boolean")
    told = [(1, 0, "filled"), (2, 0, "empty"), (3, 1, "filled"), (4, 2, "filled"), (5, 2, "unsure"), (6, 3, "not_a_checkbox"), (7, 3, "empty")]
    cards = spark.createDataFrame([(1, n, 100.0 * i + 12, 12.0, label) for n, i, label in told] + [(1, 9, 410.0, 19.0, "filled")], "page_id long, point_id int, cx double, cy double, label string")
    got = {r["box_id"]: (r["is_checked"], r["ignore"]) for r in spatial.folded(labels, cards, 8.0).collect()}
    assert got == {0: (False, False), 1: (True, False), 2: (True, True), 3: (False, False), 4: (False, False)}


def test_a_page_of_fifty_thousand_boxes(spark):
    side = spark.range(50_000).selectExpr("1L AS page_id", "CAST(id AS int) AS box_id", "CAST(id % 250 * 30 AS int) AS x1", "CAST(id DIV 250 * 30 AS int) AS y1")
    gold = side.selectExpr("*", "x1 + 24 AS x2", "y1 + 24 AS y2", "box_id % 3 = 0 AS is_checked", "false AS ignore")
    pred = gold.selectExpr("page_id", "box_id", "x1 + 2 AS x1", "y1 + 1 AS y1", "x2 + 2 AS x2", "y2 + 1 AS y2", "box_id % 6 = 0 AS is_checked")
    began = time.time()
    row = spatial.match_counts(pred, gold).first()
    assert (row["matched"], row["right"]) == (50_000, 50_000 - (16_667 - 8334))
    assert spatial.dedupe(gold.drop("ignore"), 25.0).count() == 50_000
    assert time.time() - began < 120


def test_pages_are_dealt_once(spark, sf):
    """What meets by page and cell stays where its page was dealt to: no shuffle but those of the lines and of small totals."""
    by = lambda df: {line.split("hashpartitioning(")[1].split("#")[0] for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(" in line}
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with as_dealt(spark):
            assert by(spatial.candidates(*reports.crowded(spark, sf)).groupBy("page_id", "p_box_id").count()) == {"l_orderkey"}
            boxes = catalogue.pred(spark, sf)
            assert by(spatial.apart(boxes, boxes.where("pk % 3 <> 0"), 4.0)) == {"l_orderkey"}
        assert by(spatial.dedupe(boxes.select("page_id", "box_id", "x1", "y1", "x2", "y2"), 10.0)) == {"l_orderkey"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
