"""Generated pages end to end: labels, extraction, rejects, witness merge, outputs and the second reader."""

import json

import numpy as np
import pytest

import drawn_pages
from tickgrid.operators import extract, patches, placement, rules
from tickgrid.sources import files, outputs

BOXES = [(100 + 110 * (i % 12), 100 + 150 * (i // 12), 124 + 110 * (i % 12), 124 + 150 * (i // 12)) for i in range(36)]


@pytest.fixture(scope="module")
def pages(spark):
    return drawn_pages.pages(spark, BOXES, copies=2).persist()


def test_pages_are_repeatable(spark, pages):
    again = drawn_pages.pages(spark, BOXES, copies=2).repartition(3)
    assert pages.count() == 16
    assert pages.selectExpr("page", "sha1(pixels) s", "boxes").exceptAll(again.selectExpr("page", "sha1(pixels) s", "boxes")).count() == 0


def test_extraction_against_labels(pages):
    got = extract.detect(pages)
    both = drawn_pages.labels(pages).withColumnRenamed("is_checked", "truth").join(got.select("page", *[got[c].alias(f"p_{c}") for c in ("x1", "y1", "is_checked")]), "page")
    rows = {r["factor"]: r for r in both.where("abs(x1 - p_x1) + abs(y1 - p_y1) < 18").groupBy("factor").agg({"page": "count", "truth": "count"}).collect()}
    right = {r["factor"]: r["ok"] for r in both.where("abs(x1 - p_x1) + abs(y1 - p_y1) < 18").selectExpr("factor", "truth = p_is_checked AS ok").groupBy("factor").agg({"ok": "count_if"}).withColumnRenamed("count_if(ok)", "ok").collect()}
    for factor, least in (("base", 0.97), ("shadow", 0.9), ("pen", 0.85), ("rotation", 0.85), ("scale", 0.85)):
        n = rows[factor]["count(page)"]
        assert n >= least * 2 * 36 and right[factor] >= 0.9 * n, (factor, n, right[factor])


def test_small_pages_are_read_at_twice_their_size(spark):
    img = drawn_pages.blank(300, 700, [(50 + 60 * i, 100, 62 + 60 * i, 112) for i in range(10)], 1)
    page = spark.createDataFrame([("s", 300, 700, 3, bytearray(img.tobytes()))], "page string, height int, width int, channels int, pixels binary")
    got = sorted(extract.extract(page).collect(), key=lambda r: r["x1"])
    assert len(got) == 10 and all(abs(r["x1"] - 50 - 60 * i) <= 3 and r["x2"] <= 700 for i, r in enumerate(got))


def test_rejects_have_reasons(spark):
    img = drawn_pages.blank(600, 2600, BOXES[:12])  # wide enough for the threshold's block to reach round a hole
    img[380:420, 380:420] = 0
    img[382:418, 382:418] = 255  # twice the common size
    img[400:560, 900:1100] = 0
    img[460:482, 980:1002] = 255  # a hole in a block
    page = spark.createDataFrame([("r", 600, 2600, 3, bytearray(img.tobytes()))], "page string, height int, width int, channels int, pixels binary")
    scanned = extract.scan(page)
    assert scanned.where("rejected IS NULL").count() == 12
    assert {r["reasons"][0] for r in extract.rejects(scanned).collect()} <= {"RING_INK", "SIZE_CONSENSUS"}


def test_text_like():
    ink = np.zeros((60, 60), bool)
    for y in range(18, 40, 6):
        for x in range(18, 40, 6):
            ink[y : y + 3, x : x + 3] = True
    assert extract.text_like(ink, (10, 10, 50, 50)) and not extract.text_like(np.zeros((60, 60), bool), (10, 10, 50, 50))


def test_witness_merge(spark):
    form = [(50 * i, 100 * r, 50 * i + 20, 100 * r + 20) for r in range(1, 4) for i in range(1, 6)]
    seen = [(x1 + 3, y1 + 50, x2 + 3, y2 + 50) for x1, y1, x2, y2 in form]
    gone = seen.pop(9)
    seen.append((700, 700, 720, 720))
    rows = [(page, i, *b) for page in (1, 2, 3) for i, b in enumerate(seen) if page != 2 or i < 6]
    found = spark.createDataFrame(rows, "page_id long, box_id int, x1 int, y1 int, x2 int, y2 int")
    knots = [{"ty": 0.0, "py": 50.0}, {"ty": 200.0, "py": 250.0}, {"ty": 400.0, "py": 450.0}]
    regs = spark.createDataFrame([(1, "f", 20, knots), (2, "f", 20, knots)], "page_id long, form string, side int, knots array<struct<ty: double, py: double>>")
    forms = spark.createDataFrame([("f", [dict(zip(("x1", "y1", "x2", "y2"), b, strict=True)) for b in form])], f"form string, boxes array<{drawn_pages.BOX}>")
    out = placement.place(found, regs, forms).persist()
    first = out.where("page_id = 1").collect()
    added = [r for r in first if r["box_id"] is None]
    assert len(first) == 16 and len(added) == 1 and added[0]["reasons"] == ["MISSING_IN_DETECT"]
    assert all(abs(added[0][c] - v) <= 1 for c, v in zip(("x1", "y1", "x2", "y2"), gone, strict=True))
    assert [r["box_id"] for r in first if r["reasons"] == ["EXTRA_BOX"]] == [14]
    assert out.where("page_id = 2 AND size(reasons) > 0").count() == 0 and out.where("page_id = 2 AND size(witnesses) = 2").count() == 6
    assert out.where("page_id = 3 AND stats IS NULL").count() == 15
    assert [tuple(r) for r in placement.page_stats(out).orderBy("page_id").collect()] == [(1, 15, 14, 1, 1, True), (2, 15, 6, 0, 0, False)]


def test_pages_of_a_batch_are_placed_as_one_by_one():
    r = np.random.default_rng(4)
    grids = [np.array([(50 * i, 60 * k, 50 * i + 20, 60 * k + 20) for k in range(3) for i in range(n)], float) for n in (3, 5)]
    forms, knots, found = [], [], []
    for p in range(400):
        form = grids[p % 2]
        k = np.array([(0.0, 10.0), (70.0, 80.0 + p % 3), (150.0, 160.0)][: 2 + p % 2])
        seen = form[r.random(len(form)) < 0.93] + [3, 10, 3, 10] + r.integers(-2, 3, 4)
        found.append(np.vstack([seen, [[400, 400, 420, 420]]])[: r.integers(1, 18)])
        forms.append(None if p % 11 == 0 else np.zeros((0, 4)) if p % 13 == 0 else form)
        knots.append(k)
    size = np.array([len(f) for f in found])
    start = np.cumsum(size) - size
    confirmed, added, figures = placement.place_pages(start, size, np.vstack(found), forms, knots, np.full(400, 20.0))
    for p in range(400):
        if forms[p] is not None:
            one, more, stats = placement.place_page(found[p], forms[p], knots[p], 20.0)
            assert confirmed[start[p] : start[p] + size[p]].tolist() == one.tolist() and [tuple(a[1:]) for a in added if a[0] == p] == more
            assert {k: v[p] for k, v in figures.items()} == stats
    assert 20 < len(added) and not any(confirmed[start[p] : start[p] + size[p]].any() for p in range(0, 400, 11))


def test_detect_with_a_registered_form(spark):
    boxes = [(100 + 110 * (i % 10), 150 + 160 * (i // 10), 124 + 110 * (i % 10), 174 + 160 * (i // 10)) for i in range(30)]
    blank = drawn_pages.blank(700, 1500, boxes)
    for y in (60, 230, 390, 560, 640):
        blank[y : y + 3, 50:1400] = 0
    page = np.full_like(blank, 255)
    page[20:] = blank[:-20]  # the form, 20 pixels lower
    x1, y1, x2, y2 = boxes[19]
    page[y1 + 16 : y2 + 24, x1 - 4 : x2 + 4] = 255  # a box that is gone
    for i in range(4, 20):
        page[boxes[3][1] + 20 + i, boxes[3][0] + i - 1 : boxes[3][0] + i + 2] = 0
    frame = lambda name, img: spark.createDataFrame([(name, 700, 1500, 3, bytearray(img.tobytes()))], "page string, height int, width int, channels int, pixels binary")
    own = spark.createDataFrame([("form", *b) for b in boxes] + [("other", 1, 1, 2, 2)], "page string, x1 int, y1 int, x2 int, y2 int")
    forms = extract.registry(frame("form", blank).unionByName(frame("no-boxes", blank)), own)
    assert [(f.name, [round(y) for y, _ in f.lines], len(f.boxes)) for f in forms] == [("form", [61, 231, 391, 561, 641], 30)]
    got = extract.detect(frame("p", page), forms).persist()
    rows = got.collect()
    assert len(rows) == 30 and {r["meta"]["form"] for r in rows} == {"form"} and rows[0]["meta"]["stats"]["agree"] == 29
    added = [r for r in rows if "MISSING_IN_DETECT" in r["reasons"]]
    assert len(added) == 1 and abs(added[0]["x1"] - x1) <= 6 and abs(added[0]["y1"] - y1 - 20) <= 6 and added[0]["ink"] < 0.02
    assert [(abs(r["x1"] - boxes[3][0]) <= 6) for r in rows if r["is_checked"]] == [True]
    body = json.loads(outputs.responses(frame("p", page), got, explain=True).first()["body"])
    assert body["meta"]["form"] == "form" and body["meta"]["width"] == 1500 and body["boxes"][0]["witnesses"] == ["structure", "template"]


def test_stray_line_is_traced():
    ink = np.zeros((100, 200), bool)
    ink[50, 20:180] = True  # a pen line through the box
    ink[10:20, 60:70] = True  # ink nearby that is no part of it
    share, n, _, span, outside = extract.features(ink, (90, 40, 110, 60))
    line = 20 + 2 * 24  # the window is padded by 1.2 sides
    assert n == 1 and abs(outside - (1 - 30 / line)) < 1e-9 and span > 0.4 and share > 0.01


def test_peaks_keep_the_heavier_of_two():
    profile = np.zeros(60)
    profile[5:7], profile[10], profile[30], profile[50] = 50, 80, 90, 10
    assert extract.peaks(profile) == [(10.0, 80.0), (30.0, 90.0)] and extract.peaks(np.zeros(9)) == []


def test_outputs(spark, pages, tmp_path):
    one = pages.where("page = 'base-0'")
    graded = rules.classify(extract.extract(one), rules.policies(spark))
    body = json.loads(outputs.responses(one, graded).first()["body"])
    assert len(body["boxes"]) == graded.count() and set(body["boxes"][0]) == {"bbox", "is_checked"}
    assert set(json.loads(outputs.responses(one, graded, explain=True).first()["body"])["boxes"][0]) == {"bbox", "is_checked", "confidence", "ink", "reasons", "witnesses"}
    assert json.loads(outputs.responses(one, graded.where("false")).first()["body"]) == {"boxes": []}
    (tmp_path / "o").mkdir()
    (tmp_path / "o/f-base.png").write_bytes(outputs.overlays(one, graded).first()["png"])
    good, errors = files.images(spark, f"{tmp_path}/o")
    got = good.first()
    assert (got["height"], got["width"], errors.count()) == (600, 1500, 0)
    spare = graded.limit(1)
    shown = outputs.overlays(one, outputs.eval_layers(graded, graded.limit(0), spare)).first()["png"]
    (tmp_path / "e").mkdir()
    (tmp_path / "e/f.png").write_bytes(shown)
    img, b = files.images(spark, f"{tmp_path}/e")[0].first(), spare.first()
    assert tuple(np.frombuffer(img["pixels"], np.uint8).reshape(600, 1500, 3)[b["y1"], b["x1"]]) == outputs.YELLOW
    assert len({r["key"] for r in outputs.crops(one, graded.limit(5)).collect()} - {None}) >= 1
    outputs.markdown(spark.createDataFrame([("b", 2), ("a", None)], "factor string, n int"), "factor", f"{tmp_path}/report.md")
    lines = (tmp_path / "report.md").read_text().splitlines()
    assert lines == ["| factor | n |", "| --- | --- |", "| a |  |", "| b | 2 |"]
    outputs.json_report(spark.range(2), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 2


def test_second_reader(pages):
    told = drawn_pages.labels(pages)
    rows = patches.patches(pages, told).join(told.select("page", "box_id", "factor", "is_checked"), ["page", "box_id"]).persist()
    model = patches.fit(rows.where("factor IN ('pen+scale', 'shadow+rotation')"))
    got = patches.accuracy(patches.score(rows.where("factor IN ('base', 'shadow')"), model)).collect()
    assert {r["factor"] for r in got} == {"base", "shadow"} and all(r["right"] >= 0.8 and r["n"] == 72 for r in got)
    assert patches.without_cards(told, told.where("box_id < 3")).where("box_id < 3").count() == 0
