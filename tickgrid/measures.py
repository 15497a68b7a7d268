"""Queries on sequences, areas and intervals: registration, peaks, ink of boxes, throughput by concurrency."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickgrid.catalogue import gold, query, read
from tickgrid.operators import area, ledger, reader, sequences, spatial, sweep
from tickgrid.streaming import drift

# lines of pages against forms

FORMS = [("form-a", [(50.0 * i, 20.0) for i in range(1, 8)]), ("form-b", [(35.0 * i * i, 20.0) for i in range(1, 8)]), ("form-c", [(50.0 * i + 11 * (i % 2), 10.0 + 7 * (i % 3)) for i in range(1, 10)])]
FORM_ROWS = ", ".join("('%s', [%s])" % (name, ", ".join(f"{{'y': CAST({y} AS DOUBLE), 'w': CAST({w} AS DOUBLE)}}" for y, w in rows)) for name, rows in FORMS)


@query(f""", forms AS (SELECT * FROM (VALUES {FORM_ROWS}) AS v(form, t)),
lines AS (SELECT page_id, list({{'y': CAST(box_id*50 + pk%7 AS DOUBLE), 'w': CAST(q + 1 AS DOUBLE)}} ORDER BY box_id*50 + pk%7, q) AS p FROM boxes_gold GROUP BY page_id),
pair AS MATERIALIZED (SELECT page_id, form, t, p, len(t) AS m, len(p) AS n FROM lines, forms),
walk AS (SELECT page_id, form, t, p, m, n, 0 AS c, CAST([] AS DOUBLE[]) AS dp, CAST([] AS INT[]) AS cnt FROM pair
UNION ALL SELECT page_id, form, t, p, m, n, c + 1, list_append(dp, greatest(base, coalesce(list_max(vs), base))), list_append(cnt, CASE WHEN coalesce(list_max(vs), base) > base THEN 1 + cnt[prev[list_position(vs, list_max(vs))] + 1] ELSE 1 END)
 FROM (SELECT *, list_transform(prev, lambda k: dp[k + 1] + base - 0.3::DOUBLE*((c//n - k//n - 1) + (c%n - k%n - 1))) AS vs
  FROM (SELECT *, list_filter(list_transform(range(0, 16), lambda k: CASE WHEN c//n - 4 + k//4 >= 0 AND c%n - 4 + k%4 >= 0 THEN (c//n - 4 + k//4)*n + c%n - 4 + k%4 END), lambda k: k IS NOT NULL AND t[c//n + 1].y > t[k//n + 1].y AND p[c%n + 1].y > p[k%n + 1].y
    AND (p[c%n + 1].y - p[k%n + 1].y)/(t[c//n + 1].y - t[k//n + 1].y) >= 0.45::DOUBLE AND (p[c%n + 1].y - p[k%n + 1].y)/(t[c//n + 1].y - t[k//n + 1].y) <= 2.2::DOUBLE) AS prev,
    least(t[c//n + 1].w, p[c%n + 1].w)/greatest(t[c//n + 1].w, p[c%n + 1].w) AS base FROM walk WHERE c < m*n AND least(m, n) >= 2))),
reg AS (SELECT page_id, form, cnt[list_position(dp, list_max(dp))] AS pairs, m, n FROM walk WHERE c = m*n AND least(m, n) >= 2),
rated AS (SELECT page_id, form, pairs, round(CAST(pairs AS DOUBLE)/greatest(3, least(m, n)), 3) AS score FROM reg)
SELECT page_id, form, pairs, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, form) AS r FROM rated WHERE pairs >= 3 AND score >= 0.35) WHERE r = 1""")
def registration_best(s, d):
    """Each page's lines against three forms, by monotone local alignment; the best one wins."""
    line = F.struct((F.col("box_id") * 50 + F.col("pk") % 7).cast("double").alias("y"), (F.col("q") + 1).cast("double").alias("w"))
    lines = gold(s, d).groupBy("page_id").agg(F.sort_array(F.collect_list(line)).alias("page"))
    forms = s.createDataFrame(FORMS, "form string, template array<struct<y: double, w: double>>")
    return spatial.best_form(sequences.registrations(lines.crossJoin(F.broadcast(forms)))).select("page_id", "form", "pairs", "score")


# profiles

PROFILE = ", prof AS (SELECT vec_id, i - 1 AS place, CAST(floor(abs(CAST(embedding[i] AS DOUBLE))*40) AS INT) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)), lim AS (SELECT vec_id, greatest(max(v)*0.5::DOUBLE, 1.0) AS lim FROM prof GROUP BY vec_id)"


@query(PROFILE + """, isl AS (SELECT vec_id, place - row_number() OVER (PARTITION BY vec_id ORDER BY place) AS run, place, v FROM prof JOIN lim USING (vec_id) WHERE v >= lim),
pk AS MATERIALIZED (SELECT vec_id, (min(place) + max(place))/2.0::DOUBLE AS pos, CAST(max(v) AS DOUBLE) AS weight, row_number() OVER (PARTITION BY vec_id ORDER BY min(place)) AS k FROM isl GROUP BY vec_id, run),
fold AS (SELECT vec_id, k, [{'pos': pos, 'weight': weight}] AS kept FROM pk WHERE k = 1
UNION ALL SELECT f.vec_id, pk.k, CASE WHEN pk.pos - f.kept[-1].pos >= 4 THEN list_append(f.kept, {'pos': pk.pos, 'weight': pk.weight}) WHEN pk.weight > f.kept[-1].weight THEN list_append(f.kept[1:len(f.kept)-1], {'pos': pk.pos, 'weight': pk.weight}) ELSE f.kept END
 FROM fold f JOIN pk ON pk.vec_id = f.vec_id AND pk.k = f.k + 1)
SELECT vec_id, u.pos AS pos, u.weight AS weight FROM (SELECT vec_id, unnest(kept) AS u FROM fold WHERE (vec_id, k) IN (SELECT vec_id, max(k) FROM pk GROUP BY vec_id))""")
def profile_peaks(s, d):
    """Peaks of the vectors read as profiles of 64 lines: islands above half of the greatest, of near ones the heavier."""
    own = read(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "e")).select("vec_id", "at", F.floor(F.abs(F.col("e").cast("double")) * 40).cast("int").alias("v"))
    return sequences.peaks(own, "vec_id", "at", "v", share=0.5, gap=4)


# ink of boxes on 8 x 8 grids

BOXES8 = [(0, 0, 8, 8), (1, 2, 8, 7), (3, 3, 5, 5), (6, 0, 8, 1), (4, 4, 4, 6)]
INK = "WITH g AS (SELECT vec_id, list_transform(embedding, lambda e: CASE WHEN e > 0 THEN 1 ELSE 0 END) AS v FROM embeddings), b AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {x1}, {y1}, {x2}, {y2})" for i, (x1, y1, x2, y2) in enumerate(BOXES8)) + ") AS t(box_id, x1, y1, x2, y2)), "


def ink_sql(name: str, x1: str, y1: str, x2: str, y2: str) -> str:
    return f"{name} AS (SELECT vec_id, box_id, coalesce(list_sum(list_transform(range(0, 64), lambda i: CASE WHEN i%8 >= {x1} AND i%8 < {x2} AND i//8 >= {y1} AND i//8 < {y2} THEN v[i+1] ELSE 0 END)), 0) AS s, greatest(0, {x2} - ({x1}))*greatest(0, {y2} - ({y1})) AS n FROM g, b)"


IX, IY = "CAST(trunc((x2-x1)*0.15) AS INT)", "CAST(trunc((y2-y1)*0.15) AS INT)"


@query(INK.replace("WITH ", ", ", 1) + ink_sql("own", "x1", "y1", "x2", "y2") + ", " + ink_sql("ins", f"x1 + {IX}", f"y1 + {IY}", f"x2 - {IX}", f"y2 - {IY}") + ", " + ink_sql("rng", "greatest(0, x1-3)", "greatest(0, y1-3)", "least(8, x2+3)", "least(8, y2+3)") + """
SELECT own.vec_id, own.box_id, CASE WHEN ins.n > 0 THEN CAST(ins.s AS DOUBLE)/ins.n ELSE 0.0::DOUBLE END AS ink, CASE WHEN rng.n > own.n THEN CAST(rng.s - own.s AS DOUBLE)/(rng.n - own.n) ELSE 0.0::DOUBLE END AS ring FROM own JOIN ins USING (vec_id, box_id) JOIN rng USING (vec_id, box_id)""")
def box_ink(s, d):
    """Ink inside and around five boxes of every grid, from one summed-area table."""
    cells = read(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "e")).select("vec_id", F.floor(F.col("at") / 8).cast("int").alias("y"), (F.col("at") % 8).alias("x"), (F.col("e") > 0).cast("int").alias("v"))
    table = area.summed(cells, "vec_id", "v")
    corner = [F.struct(F.lit(i).alias("box_id"), *[F.lit(v).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), b, strict=True)]) for i, b in enumerate(BOXES8)]
    boxes = read(s, d, "embeddings").select("vec_id", F.explode(F.array(*corner)).alias("b")).select("vec_id", "b.*")
    return area.ink_shares(table, boxes, "vec_id", F.lit(8), F.lit(8), F.lit(8))


# concurrency

SWEEP = """, iv AS (SELECT event_id AS id, epoch_us(ts) AS start, epoch_us(ts) + CAST(round(value*100) AS BIGINT)*200000 AS stop FROM events),
st AS (SELECT id, stop - start AS length, start AS tm, 1 AS kind, 1 AS o FROM iv UNION ALL SELECT id, stop - start, stop, -1, CASE WHEN stop = start THEN 2 ELSE -1 END FROM iv),
run AS MATERIALIZED (SELECT *, coalesce(sum(kind) OVER (ORDER BY tm, o, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level, tm - coalesce(lag(tm) OVER (ORDER BY tm, o, id), tm) AS since FROM st)
"""


@query(SWEEP + """SELECT CAST(level AS BIGINT) AS level, count(*) FILTER (kind = -1) AS requests, CAST(sum(since) AS BIGINT) AS spent, CASE WHEN sum(since) > 0 THEN round(CAST(count(*) FILTER (kind = -1)*1000000 AS DOUBLE)/CAST(sum(since) AS BIGINT), 6) END AS per_second,
CAST(median(length) FILTER (kind = -1) AS DOUBLE) AS p50, list_sort(list(length) FILTER (kind = -1))[greatest(CAST(floor((count(*) FILTER (kind = -1))*0.95) AS BIGINT) - 1, 0) + 1] AS p95, max(length) FILTER (kind = -1) AS longest FROM run GROUP BY level""")
def throughput_by_level(s, d):
    """Events as requests of 20 seconds for each unit of value: what is done at every level of concurrency."""
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    own = read(s, d, "events").select(F.col("event_id").alias("id"), start.alias("start"), (start + F.round(F.col("value") * 100).cast("long") * 200_000).alias("stop"))
    return sweep.levels(own, slot=3_600_000_000, unit=1_000_000)


# votes

VOTED = """, v AS (SELECT event_id//3 AS k, event_id%3 AS who, (user_id + event_id)%9 <> 0 AS is_checkbox, CASE WHEN user_id%7 <> 0 THEN (event_id//3 + user_id//40)%2 = 0 END AS filled, CAST(CAST(round(least(value, 99.99)*100) AS BIGINT) AS DOUBLE)/10000 AS confidence FROM events WHERE event_id%3 <> 1 OR user_id%5 <> 0),
b AS (SELECT DISTINCT event_id//3 AS k FROM events), n AS (SELECT k, count(*) AS n, min(is_checkbox) = max(is_checkbox) AS sb, min(is_checkbox) AS vb, count(filled) = count(*) AND min(filled) = max(filled) AS sf, min(filled) AS vf, round(min(confidence), 2) AS vc FROM v WHERE who < 2 GROUP BY k),
j AS (SELECT k, is_checkbox AS jb, filled AS jf, confidence AS jc FROM v WHERE who = 2),
r AS (SELECT b.k, n.*, j.*, CASE WHEN coalesce(n = 2 AND sb AND sf, FALSE) THEN 'VLM_AGREE' WHEN coalesce(n >= 1 AND jc >= 0.6::DOUBLE, FALSE) THEN 'JUDGED' ELSE 'REVIEW' END AS route FROM b LEFT JOIN n ON n.k = b.k LEFT JOIN j ON j.k = b.k)
"""


@query(VOTED + "SELECT CAST(k AS VARCHAR) AS key, CASE route WHEN 'VLM_AGREE' THEN vb WHEN 'JUDGED' THEN jb ELSE TRUE END AS is_checkbox, CASE route WHEN 'VLM_AGREE' THEN vf WHEN 'JUDGED' THEN jf ELSE k%2 = 0 END AS filled, route, CASE route WHEN 'VLM_AGREE' THEN vc WHEN 'JUDGED' THEN jc ELSE CAST(k%100 AS DOUBLE)/100 END AS confidence FROM r")
def settled_votes(s, d):
    """Every third event is a judge, the others are votes on the same crop: agreed, judged, or sent to review."""
    e = read(s, d, "events")
    crop = F.floor(F.col("event_id") / 3)
    state = F.when(F.col("user_id") % 7 != 0, (crop + F.floor(F.col("user_id") / 40)) % 2 == 0)
    votes = e.where("event_id % 3 <> 1 OR user_id % 5 <> 0").select("event_id", crop.cast("string").alias("key"), ((F.col("user_id") + F.col("event_id")) % 9 != 0).alias("is_checkbox"), state.alias("filled"), (F.round(F.least("value", F.lit(99.99)) * 100).cast("long").cast("double") / 10000).alias("confidence"))
    boxes = e.select(crop.alias("k")).distinct().select(F.col("k").cast("string").alias("key"), (F.col("k") % 2 == 0).alias("is_checked"), ((F.col("k") % 100).cast("double") / 100).alias("confidence"))
    return ledger.settle(boxes, votes.where("event_id % 3 < 2"), votes.where("event_id % 3 = 2"))


# a trained reader


@query()
def trained_reader(s, d):
    """Vectors of the first two labels told from the others by a model that never saw the test part or every twentieth vector."""
    rows = read(s, d, "embeddings").select("vec_id", "embedding", (F.col("label") < 2).cast("double").alias("target"))
    held = rows.where("vec_id % 20 = 0").select("vec_id")
    model = reader.fit(rows, held, "vec_id", "embedding", "target", size=64)
    return reader.score(rows, model, "embedding", size=64).select("vec_id", F.when(F.col("vec_id") % 20 == 0, "held").otherwise(reader.part("vec_id")).alias("part"), "target", "p")


# drift


@query(f""", o AS MATERIALIZED (SELECT event_type AS corpus, event_id AS id, CASE WHEN value > 60 THEN {drift.UP} ELSE -{drift.DOWN} END AS step, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
c AS (SELECT corpus, id, k, greatest(0, step) AS level, greatest(0, step) > {drift.LIMIT} AS alarm FROM o WHERE k = 1
UNION ALL SELECT o.corpus, o.id, o.k, greatest(0, c.level + o.step), greatest(0, c.level + o.step) > {drift.LIMIT} AND c.level <= {drift.LIMIT} FROM c JOIN o ON o.corpus = c.corpus AND o.k = c.k + 1)
SELECT corpus, id, CAST(level AS BIGINT) AS level, alarm FROM c""")
def flag_rate_cusum(s, d):
    """Events above 60 as flagged boxes: the cumulative sum of each type, and where it alarms."""
    return drift.cusum(read(s, d, "events").select(F.col("event_type").alias("corpus"), "ts", F.col("event_id").alias("id"), (F.col("value") > 60).alias("flagged")))
