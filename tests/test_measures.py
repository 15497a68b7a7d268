"""Sequences, areas, sweeps, the ledger, the trained reader, the drift alarm, markdown tables and failing claims, against plain code."""

import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tickgrid import measures  # noqa: F401
from tickgrid.operators import area, ledger, reader, sequences, spatial, sweep
from tickgrid.sources import markdown, outputs
from tickgrid.streaming import drift


# sequences
def test_fold_aligns_as_the_loop_does(spark):
    r = random.Random(8)
    lines = lambda n: [(float(y), float(r.choice([0, 1, 5, 9]))) for y in sorted(r.choices(range(300), k=n))]
    rows = [(i, "f", lines(r.randrange(0, 9)), lines(r.randrange(0, 9))) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, form string, template array<struct<y: double, w: double>>, page array<struct<y: double, w: double>>")
    got = {x["page_id"]: x for x in sequences.registrations(df).collect()}
    for i, _, t, p in rows:
        want = spatial.align(t, p)
        knots = spatial.knots_of([(t[a][0], p[b][0]) for a, b in want])
        assert got[i]["pairs"] == len(want) and [(k["ty"], k["py"]) for k in got[i]["knots"]] == knots
        assert got[i]["score"] == pytest.approx(len(want) / max(3, min(len(t), len(p))), abs=6e-4)


def test_many_pages_are_aligned_in_batches(spark):
    """Pages at a time, not cells at a time: by the fold in JVM rows this took several times as long."""
    line = "named_struct('y', CAST({y} AS double), 'w', CAST(1 + ({w}) % 9 AS double))"
    lists = lambda n, y, w: f"transform(sequence(1, {n}), x -> {line.format(y=y, w=w)})"
    df = spark.range(60_000).repartition(8).selectExpr("id AS page_id", "'f' AS form", f"{lists('8', '50 * x', 'x')} AS template", f"{lists('CAST(7 - id % 3 AS int)', '50 * x + (id * x) % 7', 'id + x')} AS page")
    began = time.time()
    got = sequences.registrations(df)
    assert got.where("pairs >= 2 AND pairs = size(knots)").count() == 60_000 and time.time() - began < 25
    sure = got.where("page_id % 6000 = 0").join(df.drop("form"), "page_id").collect()
    for x in sure:
        want = spatial.align([tuple(v) for v in x["template"]], [tuple(v) for v in x["page"]])
        assert [tuple(k) for k in x["knots"]] == [(x["template"][a]["y"], x["page"][b]["y"]) for a, b in want]


def plain_peaks(v, share, gap):
    least, out, i = max(max(v) * share, 1.0), [], 0
    while i < len(v):
        j = i
        while j < len(v) and v[j] >= least:
            j += 1
        if j > i:
            pos, w = (i + j - 1) / 2, float(max(v[i:j]))
            if not out or pos - out[-1][0] >= gap:
                out.append((pos, w))
            elif w > out[-1][1]:
                out[-1] = (pos, w)
        i = max(j, i + 1)
    return out


def test_peaks_of_profiles(spark):
    r = np.random.default_rng(2)
    own = {k: (r.integers(0, 12, 150) * (r.random(150) < 0.5)).tolist() for k in range(12)} | {99: [0] * 5, 98: [3] * 9}
    rows = [(k, i, v) for k, vs in own.items() for i, v in enumerate(vs)] + [(97, 0, None)]
    got = defaultdict(list)
    for x in sequences.peaks(spark.createDataFrame(rows, "k int, at int, v int"), "k", "at", "v", gap=6).collect():
        got[x["k"]].append((x["pos"], x["weight"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: w for k, v in own.items() if (w := plain_peaks(v, 0.2, 6))}


# areas
def test_summed_areas(spark):
    r = np.random.default_rng(6)
    img = r.integers(0, 2, (3, 40, 30))
    cells = spark.createDataFrame([(p, y, x, int(img[p, y, x])) for p in range(3) for y in range(40) for x in range(30)], "page int, y int, x int, v int")
    boxes = [(p, i, int(a), int(b), int(a + c), int(b + d)) for p in range(3) for i, (a, b, c, d) in enumerate(zip(r.integers(0, 20, 30), r.integers(0, 25, 30), r.integers(0, 11, 30), r.integers(0, 16, 30), strict=True))]
    df = spark.createDataFrame(boxes, "page int, box_id int, x1 int, y1 int, x2 int, y2 int")
    got = {(x["page"], x["box_id"]): x for x in area.ink_shares(area.summed(cells, "page", "v"), df, "page", F.lit(10), F.lit(30), F.lit(40)).collect()}
    for p, i, x1, y1, x2, y2 in boxes:
        ix, iy = int((x2 - x1) * 0.15), int((y2 - y1) * 0.15)
        inner, own, around = img[p, y1 + iy : y2 - iy, x1 + ix : x2 - ix], img[p, y1:y2, x1:x2], img[p, max(0, y1 - 4) : y2 + 4, max(0, x1 - 4) : x2 + 4]
        assert got[p, i]["ink"] == pytest.approx(inner.mean() if inner.size else 0.0)
        assert got[p, i]["ring"] == pytest.approx((around.sum() - own.sum()) / (around.size - own.size))


# sweeps
@pytest.mark.parametrize("slot", [7, 50, 10_000])
def test_levels_of_concurrency(spark, slot):
    r = random.Random(slot)
    own = [(i, a, a + r.choice([0, 0, 1, 5, 30])) for i in range(150) for a in [r.randrange(200)]] + [(900, 5, 3)]
    steps = sorted([(a, 1, i, z - a, 1) for i, a, z in own if z >= a] + [(z, 2 if a == z else -1, i, z - a, -1) for i, a, z in own if z >= a])
    level, last, spent, ended = 0, steps[0][0], defaultdict(int), defaultdict(list)
    for at, _, _, length, kind in steps:
        spent[level] += at - last
        if kind < 0:
            ended[level].append(length)
        level, last = level + kind, at
    got = {x["level"]: x for x in sweep.levels(spark.createDataFrame(own, "id int, start long, stop long"), slot, 10).collect()}
    assert set(got) == set(spent)
    for k, x in got.items():
        z = sorted(ended[k])
        assert (x["spent"], x["requests"], x["longest"]) == (spent[k], len(z), z[-1] if z else None)
        assert x["p95"] == (z[max(int(len(z) * 0.95) - 1, 0)] if z else None) and x["p50"] == (float(np.median(z)) if z else None)


# votes and their ledger
def test_votes_are_settled(spark):
    boxes = spark.createDataFrame([(k, k == "f", 0.4) for k in "abcdefg"], "key string, is_checked boolean, confidence double")
    votes = [("a", True, True, 0.9), ("a", True, True, 0.8), ("b", True, True, 0.9), ("b", True, False, 0.9), ("c", True, None, 0.9), ("c", True, None, 0.9), ("d", False, True, 0.7), ("f", True, True, 0.9)]
    judges = [("b", True, False, 0.6), ("c", True, True, 0.59), ("d", True, None, 0.95), ("e", True, True, 0.99)]
    kind = "key string, is_checkbox boolean, filled boolean, confidence double"
    got = {r["key"]: tuple(r)[1:] for r in ledger.settle(boxes, spark.createDataFrame(votes, kind), spark.createDataFrame(judges, kind)).collect()}
    review = (True, False, "REVIEW", 0.4)
    assert got == {"a": (True, True, "VLM_AGREE", 0.8), "b": (True, False, "JUDGED", 0.6), "c": review, "d": (True, None, "JUDGED", 0.95), "e": review, "f": (True, True, "REVIEW", 0.4), "g": review}


def test_ledger_takes_a_batch_once(spark, tmp_path):
    path, write = f"file://{tmp_path}/ledger", None
    write = ledger.appender(path)
    batch = lambda *rows: spark.createDataFrame([(k, seq, True, f, "JUDGED", 0.9) for k, seq, f in rows], ledger.DECISION)
    state = lambda: {r["key"]: (r["seq"], r["filled"]) for r in ledger.decisions(spark, path).collect()}
    assert state() == {}
    write(batch(("a", 1, True), ("b", 2, True)), 0)
    write(batch(("a", 3, False)), 1)
    write(batch(("a", 3, False)), 1)
    assert state() == {"a": (3, False), "b": (2, True)} and spark.read.parquet(path).count() == 3
    ledger.compact(spark, path, 1)
    assert state() == {"a": (3, False), "b": (2, True)} and spark.read.parquet(path).count() == 2
    write(batch(("a", 1, True)), 0)  # tried again after the base took it in
    write(batch(("b", 9, False)), 2)
    ledger.compact(spark, path, 1)
    assert state() == {"a": (3, False), "b": (9, False)}
    ledger.compact(spark, path, 2)
    assert state() == {"a": (3, False), "b": (9, False)} and spark.read.parquet(f"{path}/kind=base/batch=2").count() == 2


def test_ledger_as_the_end_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(3):
        spark.createDataFrame([("k", n, True, n % 2 == 0, "REVIEW", 0.5)], ledger.DECISION).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        q = spark.readStream.schema(ledger.DECISION).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.foreachBatch(ledger.appender(f"{tmp_path}/l")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [tuple(r)[:2] for r in ledger.decisions(spark, f"{tmp_path}/l").collect()] == [("k", 2)] and spark.read.parquet(f"{tmp_path}/l").count() == 3


# the trained reader
def test_reader_is_fitted_saved_and_loaded(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=6)]) for i in range(400)]
    rows = [(i, v, float(v[0] + v[1] > 0)) for i, v in rows] + [(900, None, 1.0), (901, [1.0], 0.0), (902, [float("nan")] * 6, 1.0), (903, rows[0][1], None)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y double")
    held = df.where("id % 10 = 0").select("id")
    assert [x["p"] for x in reader.score(df, reader.load(f"{tmp_path}/none"), "v", 6).limit(3).collect()] == [None] * 3
    reader.fit(df, held, "id", "v", "y", 6).write().overwrite().save(f"{tmp_path}/m")
    model = reader.load(f"{tmp_path}/m")
    every = {x["id"]: x["p"] for x in reader.score(df, model, "v", 6).collect()}
    assert {i for i, p in every.items() if p is None} == {900, 901, 902}
    test = [(every[i] > 0.5) == bool(y) for i, v, y in rows if i < 400 and i % 10 == 0]
    assert np.mean(test) > 0.9
    for part in (df.where("id < 3"), df.where("id = 7").repartition(3), df.where("id BETWEEN 100 AND 120").coalesce(1)):
        assert all(x["p"] == every[x["id"]] for x in reader.score(part, model, "v", 6).collect())
    kinds = {x[0]: x[1] for x in df.select("id", reader.part("id")).collect()}
    assert 250 < sum(k == "train" for k in kinds.values()) < 380


# drift
def test_stream_alarms_where_the_table_does(spark, sf, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_type AS corpus", "CAST(ts AS timestamp) AS ts", "event_id AS id", "value > 60 AS flagged")
    want = {(x["corpus"], x["id"], x["level"]) for x in drift.cusum(own, limit=150).where("alarm").collect()}
    ordered = own.orderBy("ts").collect()
    (tmp_path / "in").mkdir()
    for n in range(3):
        part = ordered[n * len(ordered) // 3 : (n + 1) * len(ordered) // 3]
        spark.createDataFrame(part, own.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    kept = []
    stream = drift.alarms(spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), limit=150)
    q = stream.writeStream.foreachBatch(lambda df, _: kept.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None and want and {(x["corpus"], x["id"], x["level"]) for x in kept if x["alarm"] == "drift"} == want
    assert all(x["id"] == -1 for x in kept if x["alarm"] == "silent")


# reports
def test_markdown_tables_come_back(spark, tmp_path):
    spark.dataSource.register(markdown.MarkdownTables)
    report = spark.range(60).selectExpr("id", "concat('a|', id) AS name", "CASE WHEN id % 7 <> 0 THEN id / 4 END AS share")
    outputs.markdown(report.repartition(5), "id", f"{tmp_path}/r.md")
    got = spark.read.format("markdown").load(f"{tmp_path}/r.md").orderBy("line").collect()
    assert [x["line"] for x in got] == list(range(3, 63)) and got[0]["header"] == ["id", "name", "share"]
    assert [x["cells"] for x in got] == [[str(i), f"a|{i}", "" if i % 7 == 0 else str(i / 4)] for i in range(60)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["r.md"]
    (tmp_path / "more").mkdir()
    (tmp_path / "more/b.md").write_text("text | bar\n\n| a | b |\n|---|:-:|\n| 1 | 2 | 3 |\n| 4 |\nend\n| x |\n| - |\n| y |\n")
    rows = [(x["line"], x["header"], x["cells"]) for x in spark.read.format("markdown").load(str(tmp_path)).where("path LIKE '%b.md'").orderBy("line").collect()]
    assert rows == [(5, ["a", "b"], ["1", "2"]), (6, ["a", "b"], ["4", ""]), (10, ["x"], ["y"])]
    with pytest.raises(PySparkException):
        report.write.format("markdown").mode("append").save(f"{tmp_path}/r.md")
    outputs.markdown(report.limit(0), "id", f"{tmp_path}/e.md")
    assert (tmp_path / "e.md").read_text().splitlines() == ["| id | name | share |", "| --- | --- | --- |"]


def test_figures_are_gathered_in_the_pass_that_writes(spark, tmp_path):
    df, told = outputs.observed(spark.range(1000), "told", n=F.count("*"), top=F.max("id"))
    df.where("id % 2 = 0").write.parquet(f"{tmp_path}/o")
    assert told.get == {"n": 1000, "top": 999}


def test_a_wrong_claim_fails_the_write(spark, tmp_path):
    claims = spark.createDataFrame([("pages", "10", "10", True), ("boxes", "7", "8", False)], "name string, stated string, measured string, holds boolean")
    outputs.held(claims.where("holds")).write.parquet(f"{tmp_path}/good")
    with pytest.raises(PySparkException, match="claim boxes: stated 7, measured 8"):
        outputs.held(claims).write.parquet(f"{tmp_path}/bad")
    assert not (tmp_path / "bad/_SUCCESS").exists()
