"""Rule branches, contended matching, sources and pixels on small cases; catalogue queries against DuckDB."""

import json

import duckdb
import numpy as np
import pytest

from tickgrid import catalogue, measures, reports  # noqa: F401
from tickgrid.operators import extract, rules, spatial
from tickgrid.sources import files

TABLES = "lineitem orders events embeddings".split()


@pytest.mark.parametrize("name", ["box_geometry", "rule_engine_default", "policy_agreement", "escalation_replay", "page_scorecard", "fold_labels", "leakage_anti_join", "p95_two_ways", "edge_mining", "carry_last", "contended_match", "contended_counts", "contended_first", "rule_engine_prior", "false_positives", "dedupe_greedy", "row_cluster", "seed_corrections", "reject_finder", "hard_cards_matched", "reader_race", "piecewise_map", "gold_misses", "page_report", "card_deck", "nearest_candidate", "registration_best", "profile_peaks", "box_ink", "throughput_by_level", "settled_votes", "flag_rate_cusum", "telemetry_full", "telemetry_corpus", "factor_level_sweep", "card_pools", "claims_check", "tier_resize", "lenient_replies", "markdown_rows"])
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, rel = catalogue.QUERIES[name](spark, sf), con.sql(catalogue.ORACLES[name])
    cols, place = sorted(df.columns), {c: i for i, c in enumerate(rel.columns)}
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(r[place[c]]) for c in cols) for r in rel.fetchall()), key=str) and got


def test_rule_branches(spark):
    cases = {  # ink, n, largest, span, outside -> state, reasons
        (0.0, 0, 0.0, 0.0, 0.0): (False, []),
        (0.3, 1, 0.25, 0.6, 0.0): (True, []),
        (0.1, 2, 0.01, 0.1, 0.0): (False, ["INK_AMBIGUOUS"]),
        (0.3, 5, 0.05, 0.2, 0.0): (False, ["FRAGMENTED_MARK"]),
        (0.3, 5, 0.05, 0.6, 0.0): (True, ["FRAGMENTED_MARK", "THIN_MARK"]),
        (0.04, 1, 0.01, 0.6, 0.0): (True, ["THIN_MARK"]),
        (0.04, 1, 0.01, 0.6, 0.9): (False, ["STRAY_STROKE"]),
        (0.3, 1, 0.29, 0.2, 0.9): (False, ["STRAY_STROKE"]),
    }
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, ink double, n int, largest double, span double, outside double")
    got = {r["i"]: (r["is_checked"], r["reasons"]) for r in rules.classify(rows, rules.policies(spark)).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    from pyspark.sql import functions as F

    kept = rules.classify(rows.withColumn("reasons", F.array(F.lit("EXTRA_BOX"))), rules.policies(spark)).collect()
    assert {r["i"]: r["reasons"] for r in kept} == {i: ["EXTRA_BOX", *v[1]] for i, v in enumerate(cases.values())}


def test_policy_is_closed():
    for bad in ({"ink": 1}, {"thin_single_stroke": "maybe"}, {"ink_filled": 0.5}):
        with pytest.raises(ValueError):
            rules.policy_from(bad)
    assert rules.policy_from({"_note": "x"}) == rules.DEFAULT


def test_contended_match(spark):
    rows = [(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.85), (1, 2, 2, 0.6), (2, 5, 6, 0.7)]
    got = spatial.greedy_match(spark.createDataFrame(rows, "page_id long, p_box_id int, g_box_id int, iou double")).collect()
    assert sorted((r["page_id"], r["p_box_id"], r["g_box_id"]) for r in got) == [(1, 1, 1), (1, 2, 2), (2, 5, 6)]


def test_first_wins_and_rows(spark):
    r = np.random.default_rng(5)
    rows = [(int(p), i, int(x), int(y), int(x) + 20, int(y) + 20) for p in range(20) for i, (x, y) in enumerate(r.integers(0, 90, (12, 2)))]
    boxes = spark.createDataFrame(rows, "page_id long, box_id int, x1 int, y1 int, x2 int, y2 int")
    kept, clustered = set(), set()
    for p in range(20):
        own, done, anchor, row = [t for t in rows if t[0] == p], [], None, -1
        for t in own:
            if all(abs(t[2] - k[2]) + abs(t[3] - k[3]) > 25 for k in done):
                done.append(t)
        kept |= {t[:2] for t in done}
        for t in sorted(own, key=lambda t: (t[3], t[2], t[1])):
            if anchor is None or t[3] - anchor >= 15:
                anchor, row = t[3], row + 1
            clustered.add((p, t[1], row))
    assert {(x["page_id"], x["box_id"]) for x in spatial.dedupe(boxes, 25.0).collect()} == kept
    assert {(x["page_id"], x["box_id"], x["row_id"]) for x in spatial.row_clusters(boxes, 15.0).collect()} == clustered


def test_alignment():
    form = [(10.0 * i, 1.0) for i in range(6)]
    assert spatial.align(form, [(20 + 11.0 * i, 1.0) for i in range(6)]) == [(i, i) for i in range(6)]
    assert spatial.align([], form) == spatial.align(form[:1], form) == spatial.align(form, form[:1]) == []
    assert spatial.knots_of([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0)]) == [(1.0, 2.0), (3.0, 5.0)]


def test_extraction_of_a_drawn_page(spark):
    g = np.full((700, 1500), 255, np.uint8)
    want = []
    for k in range(12):
        x, y = 100 + 110 * k, 100 + 150 * (k % 3)
        g[y : y + 22, x : x + 22] = 0
        g[y + 2 : y + 20, x + 2 : x + 20] = 255
        if k % 2:
            for i in range(3, 19):
                g[y + i, x + i - 1 : x + i + 2] = 0
        want.append((x, y, bool(k % 2)))
    pages = spark.createDataFrame([("p", 700, 1500, 1, bytearray(g.tobytes()))], "page string, height int, width int, channels int, pixels binary")
    got = rules.classify(extract.extract(pages), rules.policies(spark)).collect()
    assert len(got) == 12
    for r in got:
        near = min(want, key=lambda t: abs(t[0] - r["x1"]) + abs(t[1] - r["y1"]))
        assert abs(near[0] - r["x1"]) + abs(near[1] - r["y1"]) <= 6 and r["is_checked"] == near[2]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"source": "a.png", "boxes": [{"bbox": [1, 2, 3, 4], "is_checked": True}]}))
    assert files.labels(spark, f"{tmp_path}/a.json").first().asDict() == {"page": "a", "box_id": 0, "x1": 1, "y1": 2, "x2": 3, "y2": 4, "is_checked": True, "ignore": False}
    (tmp_path / "g.json").write_text(json.dumps({"savedAt": "t", "cards": [{"id": "c1", "bbox": [1, 2, 3, 4], "label": "filled"}], "labels": {"c1": "F"}}))
    assert files.cards(spark, f"{tmp_path}/g.json").first()["suspected_misclick"] is False
    assert files.answers(spark, f"{tmp_path}/g.json").first()["label"] == "filled"
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.png").write_bytes(b"no image")
    good, errors = files.images(spark, f"{tmp_path}/bad")
    assert good.count() == 0 and errors.first()["reason"] == "UNREADABLE"


def test_more_sources(spark, tmp_path):
    (tmp_path / "s/deep").mkdir(parents=True)
    (tmp_path / "s/deep/p.json").write_text(json.dumps({"source": "p.png", "params": {"form": "f", "factor": "pen", "level": "4"}, "boxes": [{"bbox": [1, 2, 3, 4], "is_checked": True}]}))
    (tmp_path / "s/manifest.json").write_text(json.dumps({"seed": 1, "pages": []}))
    assert [r.asDict() for r in files.synth_labels(spark, f"{tmp_path}/s").collect()] == [{"page": "p", "form": "f", "factor": "pen", "level": "4", "box_id": 0, "bbox": [1, 2, 3, 4], "is_checked": True}]
    (tmp_path / "v.json").write_text(json.dumps({"k1": {"source": "a", "final": {"is_checkbox": True, "filled": None, "route": "JUDGED", "confidence": 0.8}}}))
    assert [tuple(r) for r in files.votes(spark, f"{tmp_path}/v.json").collect()] == [("k1", True, None, "JUDGED", 0.8)]
    assert files.votes(spark, f"{tmp_path}/none.json").count() == 0
    with pytest.raises(FileNotFoundError):
        files.report(spark, f"{tmp_path}/none.json")
    (tmp_path / "e.json").write_text("")
    with pytest.raises((FileNotFoundError, ValueError)):
        files.report(spark, f"{tmp_path}/e.json")
    assert files.report(spark, f"{tmp_path}/v.json").count() == 1


def test_projections(spark):
    from tickgrid.sources import outputs

    df = spark.createDataFrame([(1, 2, "a", "b", "c", "d")], "x int, _y int, id string, source string, bbox string, png string")
    assert outputs.public(df).columns == ["x", "id", "source", "bbox", "png"] and outputs.slim(df).columns == ["id", "source", "bbox", "png"]


def test_flag_rate_monitor(spark):
    from tickgrid.streaming.monitor import flag_rate

    rows = [("2024-01-01 00:01:00", "a", ["X"]), ("2024-01-01 00:02:00", "a", []), ("2024-01-01 00:11:00", "a", ["X"]), ("2024-01-01 00:03:00", "b", [])]
    got = flag_rate(spark.createDataFrame(rows, "ts string, corpus string, reasons array<string>")).collect()
    assert sorted((str(r["start"]), r["corpus"], r["boxes"], r["flagged"]) for r in got) == [("2024-01-01 00:00:00", "a", 2, 1), ("2024-01-01 00:00:00", "b", 1, 0), ("2024-01-01 00:10:00", "a", 1, 1)]


def test_order_statistics_of_ties_and_one_value(spark):
    from pyspark.sql import functions as F

    from tickgrid.functions.ranks import order_statistics

    r = np.random.default_rng(4)
    rows = [("t", float(v)) for v in r.integers(0, 5, 500)] + [("one", 7.0)] * 9 + [("far", v) for v in (1e300, -1e300, float("inf"), *map(float, range(100)))] + [("u", float(v)) for v in r.normal(size=300)] + [("t", None)]
    got = {x["g"]: x for x in order_statistics(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"mid": F.floor(F.col("n") / 2) + 1, "last": F.col("n")}).collect()}
    for g in ("t", "one", "u", "far"):
        own = sorted(v for k, v in rows if k == g and v is not None)
        assert (got[g]["mid"], got[g]["last"]) == (own[len(own) // 2], own[-1])
