"""More queries: contended matching, corpora and manifests, telemetry in full, card pools, claims and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickgrid.catalogue import BOTH, CARDS, CONSENSUS, COUNTS, DEFAULT_SQL, PAIRS, RATED, SCORES, SUMS, TELEMETRY, cards, consensus, flat, flags, gold, pred, query, rated, read, ruled, scores, sides, told
from tickgrid.functions import geometry as geo
from tickgrid.functions import ranks
from tickgrid.operators import rules, spatial
from tickgrid.plans.derived import relation, twinned

# matching where boxes compete: twins of labels and predictions, a few pixels aside

CROWDED = """, cg AS MATERIALIZED (SELECT page_id, box_id, x1, y1, x2, y2, is_checked, ignore FROM boxes_gold UNION ALL SELECT page_id, box_id + 500, x1 + 4, y1, x2 + 4, y2, NOT is_checked, FALSE FROM boxes_gold WHERE pk%3 = 0),
cp AS MATERIALIZED (SELECT page_id, box_id, x1, y1, x2, y2, is_checked FROM boxes_pred UNION ALL SELECT page_id, box_id + 700, x1 - 3, y1 + 1, x2 - 3, y2 + 1, is_checked FROM boxes_pred WHERE pk%2 = 0),
cc AS (SELECT p.page_id, p.box_id AS p_box_id, g.box_id AS g_box_id, p.is_checked AS p_state, g.is_checked AS g_state, g.ignore AS g_ignore, greatest(0, least(p.x2, g.x2) - greatest(p.x1, g.x1)) * greatest(0, least(p.y2, g.y2) - greatest(p.y1, g.y1)) AS shared,
  (p.x2-p.x1)*(p.y2-p.y1) + (g.x2-g.x1)*(g.y2-g.y1) AS areas FROM cp p JOIN cg g ON p.page_id = g.page_id),
cm AS MATERIALIZED (SELECT *, CAST(shared AS DOUBLE)/CAST(areas - shared AS DOUBLE) AS iou FROM cc WHERE shared > 0 AND CAST(shared AS DOUBLE)/CAST(areas - shared AS DOUBLE) >= 0.5),
co AS MATERIALIZED (SELECT page_id, p_box_id, g_box_id, row_number() OVER (PARTITION BY page_id ORDER BY iou DESC, p_box_id, g_box_id) AS k FROM cm),
cw AS (SELECT page_id, k, [p_box_id] AS ps, [g_box_id] AS gs, TRUE AS taken, p_box_id, g_box_id FROM co WHERE k = 1
 UNION ALL SELECT co.page_id, co.k, CASE WHEN ok THEN list_append(ps, co.p_box_id) ELSE ps END, CASE WHEN ok THEN list_append(gs, co.g_box_id) ELSE gs END, ok, co.p_box_id, co.g_box_id
 FROM (SELECT cw.*, co.p_box_id AS np, co.g_box_id AS ng, NOT list_contains(ps, co.p_box_id) AND NOT list_contains(gs, co.g_box_id) AS ok FROM cw JOIN co ON co.page_id = cw.page_id AND co.k = cw.k + 1) c JOIN co ON co.page_id = c.page_id AND co.k = c.k + 1)
"""


def crowded(s, d) -> tuple[DataFrame, DataFrame]:
    p, g = sides(s, d)
    moved = lambda by, dx, dy: {"box_id": F.col("box_id") + by, **{c: F.col(c) + dx for c in ("x1", "x2")}, **{c: F.col(c) + dy for c in ("y1", "y2")}}
    return twinned(p, F.expr("pk % 2 = 0"), **moved(700, -3, 1)), twinned(g, F.expr("pk % 3 = 0"), **moved(500, 4, 0), is_checked=~F.col("is_checked"), ignore=F.lit(False))


@query(CROWDED + "SELECT page_id, p_box_id, g_box_id FROM cw WHERE taken")
def contended_match(s, d):
    return spatial.greedy_match(spatial.candidates(*crowded(s, d)).select("page_id", "p_box_id", "g_box_id", "iou")).select("page_id", "p_box_id", "g_box_id")


@query(CROWDED + "SELECT (SELECT count(*) FROM cp) - count(*) AS fp, (SELECT count(*) FROM cg) - count(*) AS unmatched_labels, count(*) AS matched, (SELECT count(DISTINCT page_id) FROM (SELECT page_id FROM cm GROUP BY page_id, p_box_id HAVING count(*) > 1)) AS contended_pages FROM cw WHERE taken")
def contended_counts(s, d):
    """The page-level pass on the crowded relation, with the number of pages on which a prediction had a choice."""
    p, g = crowded(s, d)
    told = spatial.weighed(spatial.candidates(p, g).select(*spatial.NARROW))
    pages = spatial.counts(p, g, spatial.chosen(told)).agg(F.sum(F.col("preds") - F.col("matched")).alias("fp"), F.sum(F.col("golds") - F.col("matched")).alias("unmatched_labels"), F.sum("matched").alias("matched"))
    many = told.where("_of_p > 1").agg(F.count_distinct("page_id").alias("contended_pages"))
    return pages.crossJoin(many)


@query(CROWDED + "SELECT page_id, p_box_id, g_box_id, p_state = g_state AS agrees FROM (SELECT *, row_number() OVER (PARTITION BY page_id, p_box_id ORDER BY g_box_id) AS k FROM cm WHERE NOT g_ignore) WHERE k = 1")
def contended_first(s, d):
    return spatial.first_match(spatial.candidates(*crowded(s, d))).select("page_id", "p_box_id", "g_box_id", (F.col("p_is_checked") == F.col("g_is_checked")).alias("agrees"))


# rules

@query(DEFAULT_SQL + "SELECT page_id, box_id, is_checked, CASE WHEN pk%7 = 0 THEN concat_ws('|', 'EXTRA_BOX', nullif(reasons, '')) ELSE reasons END AS reasons, pk%7 = 0 OR reasons <> '' AS routed FROM r")
def rule_engine_prior(s, d):
    """Reasons of the witness merge stay before those of the rules, and route the box."""
    own = relation(s, d, "features").withColumn("reasons", F.when(F.col("pk") % 7 == 0, F.array(F.lit("EXTRA_BOX"))).otherwise(F.array().cast("array<string>")))
    out = rules.classify(own, rules.policies(s, rules.DEFAULT)).withColumn("routed", rules.routed(F.col("reasons")))
    return flat(out).select("page_id", "box_id", "is_checked", "reasons", "routed")


# corpora

CORPUS = """, listed AS (SELECT o_orderkey AS page_id, CASE o_orderstatus WHEN 'F' THEN 'sample' WHEN 'O' THEN 'synth-sweep' ELSE 'holdout' END AS corpus FROM orders),
manifest AS (SELECT o_orderkey AS page_id, 'form-' || substr(o_orderpriority, 1, 1) AS form, CASE WHEN o_custkey%5 = 0 THEN NULL ELSE 'factor-' || CAST(o_custkey%4 AS VARCHAR) END AS factor, CAST(o_custkey%12 AS VARCHAR) AS level FROM orders WHERE o_orderstatus = 'O' AND o_orderkey%3 <> 0),
corpus AS (SELECT l.page_id, l.corpus, m.form, CASE l.corpus WHEN 'sample' THEN 'real' WHEN 'holdout' THEN 'held-out' ELSE m.factor END AS factor, m.level FROM listed l LEFT JOIN manifest m USING (page_id))
"""


def corpus(s, d) -> DataFrame:
    """Three directories under one roof, each page with its manifest entry if it has one."""
    o = read(s, d, "orders")
    listed = o.where("o_orderstatus IN ('F', 'O', 'P')").select(F.col("o_orderkey").alias("page_id"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'sample' WHEN 'O' THEN 'synth-sweep' ELSE 'holdout' END").alias("corpus"))
    told_of = o.where("o_orderstatus = 'O' AND o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("page_id"), F.concat(F.lit("form-"), F.substring("o_orderpriority", 1, 1)).alias("form"), F.when(F.col("o_custkey") % 5 != 0, F.concat(F.lit("factor-"), (F.col("o_custkey") % 4).cast("string"))).alias("_factor"), (F.col("o_custkey") % 12).cast("string").alias("level"))
    factor = F.when(F.col("corpus") == "sample", "real").when(F.col("corpus") == "holdout", "held-out").otherwise(F.col("_factor"))
    return listed.join(told_of, "page_id", "left").select("page_id", "corpus", "form", factor.alias("factor"), "level")


@query(CORPUS + "SELECT * FROM corpus")
def corpus_pages(s, d):
    return corpus(s, d)


@query(CORPUS + "SELECT factor, count(*) AS pages FROM corpus WHERE factor IS NOT NULL AND factor NOT IN ('real', 'held-out') GROUP BY factor")
def damage_factors(s, d):
    return corpus(s, d).where("factor IS NOT NULL AND factor NOT IN ('real', 'held-out')").groupBy("factor").agg(F.count("*").alias("pages"))


@query(CORPUS + "SELECT page_id, corpus FROM corpus SEMI JOIN (SELECT page_id FROM boxes_gold WHERE NOT ignore) g USING (page_id)")
def labelled_pages(s, d):
    return corpus(s, d).select("page_id", "corpus").join(gold(s, d).where("NOT ignore"), "page_id", "left_semi")


@query(CORPUS + SCORES + f", t AS (SELECT c.factor, c.level, {SUMS} FROM score JOIN corpus c USING (page_id) WHERE c.factor IS NOT NULL AND c.level IS NOT NULL GROUP BY c.factor, c.level) " + RATED.format(c="factor, level", t="t"))
def factor_level_sweep(s, d):
    """Scores by factor and level; levels are texts, so 10 comes before 2."""
    own = scores(s, d).drop("corpus", "factor").join(corpus(s, d).where("factor IS NOT NULL AND level IS NOT NULL"), "page_id")
    return rated(own.groupBy("factor", "level").agg(*[F.sum(c).alias(c) for c in COUNTS])).orderBy("factor", "level")


# telemetry in full

MS = "round(o_totalprice/100, 1)"
FULL = TELEMETRY + CONSENSUS + f""", per AS (SELECT page_id, count(*) AS boxes, sum(CASE WHEN is_checked THEN 1 ELSE 0 END) AS checked, sum(CASE WHEN reasons <> '' THEN 1 ELSE 0 END) AS flagged,
  sum(CASE WHEN len(list_filter(string_split(reasons, '|'), lambda e: e NOT IN ('', 'NOT_A_CHECKBOX'))) > 0 THEN 1 ELSE 0 END) AS routed FROM (SELECT r.*, corpus, factor FROM r JOIN pages_meta USING (page_id)) GROUP BY page_id),
why AS (SELECT page_id, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM (SELECT page_id, reason, count(*) AS n FROM (SELECT page_id, unnest(string_split(reasons, '|')) AS reason FROM r WHERE reasons <> '') GROUP BY 1, 2) GROUP BY page_id),
off AS (SELECT page_id, string_agg(reason || '=' || n, ',' ORDER BY reason) AS rejected FROM (SELECT page_id, reason, count(*) AS n FROM f3 WHERE reason IS NOT NULL GROUP BY 1, 2) GROUP BY page_id),
tele AS (SELECT per.*, coalesce(why.reasons, '') AS reasons, coalesce(off.rejected, '') AS rejected, CAST(o_custkey%4 = 0 AS BOOLEAN) AS trusted, {MS} AS ms FROM per JOIN orders ON o_orderkey = per.page_id LEFT JOIN why USING (page_id) LEFT JOIN off USING (page_id))
"""
FULL = FULL.replace(", x AS (SELECT r.*, corpus, factor FROM r JOIN pages_meta USING (page_id)) ", "")


def counted(df: DataFrame, reason: str) -> DataFrame:
    """page_id and its reasons with their counts as one text."""
    one = df.groupBy("page_id", reason).agg(F.count("*").alias("n"))
    return one.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", reason, F.col("n").cast("string")))), ",").alias("counts"))


def trusted(s, d) -> DataFrame:
    return read(s, d, "orders").select(F.col("o_orderkey").alias("page_id"), (F.col("o_custkey") % 4 == 0).alias("trusted"), F.round(F.col("o_totalprice") / 100, 1).alias("ms"))


def per_page(own: DataFrame) -> DataFrame:
    return own.groupBy("page_id").agg(F.count("*").alias("boxes"), F.count_if("is_checked").alias("checked"), F.count_if(F.size("reasons") > 0).alias("flagged"), F.count_if(rules.routed(F.col("reasons"))).alias("routed"))


def telemetry(s, d) -> DataFrame:
    own = ruled(s, d, rules.DEFAULT)
    why = counted(own.select("page_id", F.explode("reasons").alias("reason")), "reason").withColumnRenamed("counts", "reasons")
    off = counted(consensus(s, d).where("reason IS NOT NULL"), "reason").withColumnRenamed("counts", "rejected")
    out = per_page(told(s, d)).join(trusted(s, d), "page_id").join(why, "page_id", "left").join(off, "page_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("reasons", "rejected")})


@query(FULL + "SELECT page_id, boxes, checked, flagged, routed, reasons, rejected, trusted FROM tele")
def telemetry_full(s, d):
    return telemetry(s, d).drop("ms")


@query(FULL + "SELECT count(*) AS pages, sum(boxes)::BIGINT AS boxes, sum(checked)::BIGINT AS checked, sum(flagged)::BIGINT AS flagged, round(sum(flagged)/sum(boxes), 4) AS flag_rate, round(median(ms), 1) AS p50_ms, round(list_sort(list(ms))[least(count(*) - 1, CAST(floor(count(*)*0.95) AS BIGINT)) + 1], 1) AS p95_ms, round(sum(CAST(round(ms*10) AS BIGINT))/10.0/count(*), 1) AS mean_ms, count(*) FILTER (trusted) AS trusted_pages FROM tele")
def telemetry_corpus(s, d):
    own = telemetry(s, d)
    total = own.agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("boxes", "checked", "flagged")], F.round(F.sum("flagged") / F.sum("boxes"), 4).alias("flag_rate"), F.round(F.sum(F.round(F.col("ms") * 10).cast("long")) / 10.0 / F.count("*"), 1).cast("double").alias("mean_ms"), F.count_if("trusted").alias("trusted_pages"))
    n, at = F.col("n"), F.floor(F.col("n") * 0.95)
    order = ranks.order_statistics(own.withColumn("one", F.lit(1)), "one", "ms", {"low": F.floor((n + 1) / 2), "high": F.floor(n / 2) + 1, "p95": F.least(n - 1, at) + 1})
    return total.crossJoin(order.select(F.round((F.col("low") + F.col("high")) / 2, 1).alias("p50_ms"), F.round("p95", 1).alias("p95_ms")))


DISAGREE = DEFAULT_SQL + ", p AS (SELECT r.*, corpus, (CAST(t*12 + q%5 AS DOUBLE)/100 > 0.5) <> is_checked AS odd FROM r JOIN pages_meta USING (page_id)) "


@query(DISAGREE + "SELECT round(100.0*count(*) FILTER (odd AND corpus IN ('sample', 'holdout'))/greatest(1, count(*) FILTER (corpus IN ('sample', 'holdout'))), 4) AS real_rate, round(100.0*count(*) FILTER (odd AND corpus NOT IN ('sample', 'holdout'))/greatest(1, count(*) FILTER (corpus NOT IN ('sample', 'holdout'))), 4) AS synthetic_rate FROM p")
def disagreement_rates(s, d):
    own = rules.second_opinion(told(s, d).withColumn("p", (F.col("t") * 12 + F.col("q") % 5).cast("double") / 100))
    odd, real = F.array_contains("reasons", "CLASSIFIER_DISAGREE"), F.col("corpus").isin("sample", "holdout")
    rate = lambda who: F.round(100.0 * F.count_if(odd & who) / F.greatest(F.lit(1), F.count_if(who)), 4).cast("double")
    return own.agg(rate(real).alias("real_rate"), rate(~real).alias("synthetic_rate"))


@query(BOTH + ", n AS (SELECT count(*) AS boxes, count(DISTINCT page_id) AS pages, (SELECT count(*) FROM r WHERE reasons <> '') AS before, (SELECT count(*) FROM s WHERE reasons <> '') AS after FROM r) SELECT CAST(round_even(CAST(boxes AS DOUBLE)/pages*10000, 0) AS BIGINT) AS monthly_boxes, CAST(round_even(round_even(CAST(boxes AS DOUBLE)/pages*10000, 0)*0.01, 0) AS BIGINT) AS monthly_wrong, CAST(round_even(100.0*(after - before)/pages, 0) AS BIGINT) AS extra_per_100, round(CAST(before AS DOUBLE)/pages, 6) AS per_page_before, round(CAST(after AS DOUBLE)/pages, 6) AS per_page_after FROM n")
def capacity(s, d):
    """What ten thousand pages a month mean, and what the stricter policy adds to the queue."""
    own = ruled(s, d, rules.DEFAULT, rules.STRICT)
    hit = lambda name: F.count_if((F.col("policy") == name) & (F.size("reasons") > 0))
    n = own.agg(F.count_if(F.col("policy") == "default").alias("boxes"), F.count_distinct("page_id").alias("pages"), hit("default").alias("before"), hit("strict").alias("after"))
    monthly = F.bround(F.col("boxes") / F.col("pages") * 10000, 0)
    return n.select(monthly.cast("long").alias("monthly_boxes"), F.bround(monthly * F.lit(0.01), 0).cast("long").alias("monthly_wrong"), F.bround((F.col("after") - F.col("before")) * 100.0 / F.col("pages"), 0).cast("long").alias("extra_per_100"), F.round(F.col("before") / F.col("pages"), 6).alias("per_page_before"), F.round(F.col("after") / F.col("pages"), 6).alias("per_page_after"))


CLAIMS = [("flag_percent", "The queue holds **76.5%** of all boxes"), ("pages", "measured on 1,489 pages"), ("checked_percent", "marks on about 55.0% of boxes")]
STATED = ", claims AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in CLAIMS) + ") AS v(name, claim)), "


@query(TELEMETRY + STATED + """measured AS (SELECT 'flag_percent' AS name, printf('%.1f', round(100.0*count(*) FILTER (reasons <> '')/count(*), 1)) AS value FROM x UNION ALL SELECT 'pages', CAST(count(DISTINCT page_id) AS VARCHAR) FROM x UNION ALL SELECT 'checked_percent', printf('%.1f', round(100.0*count(*) FILTER (is_checked)/count(*), 1)) FROM x)
SELECT name, replace(regexp_extract(claim, '[0-9][0-9,]*(\\.[0-9]+)?', 0), ',', '') AS stated, value AS measured, stated = value AS holds FROM claims JOIN measured USING (name)""")
def claims_check(s, d):
    """Numbers stated in texts against measured ones; a report fails on a claim that doesn't hold."""
    own = told(s, d)
    percent = lambda hit: F.format_string("%.1f", F.round(100.0 * F.count_if(hit) / F.count("*"), 1).cast("double"))
    one = own.agg(percent(F.size("reasons") > 0).alias("flag_percent"), F.count_distinct("page_id").cast("string").alias("pages"), percent(F.col("is_checked")).alias("checked_percent"))
    measured = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("measured")) for k, _ in CLAIMS])).alias("m")).select("m.*")
    return geo.stated_numbers(s.createDataFrame(CLAIMS, "name string, claim string")).join(measured, "name").select("name", "stated", "measured", (F.col("stated") == F.col("measured")).alias("holds"))


@query(FULL + "SELECT t.page_id, boxes, checked AS marked, routed AS flagged, trusted AS recognised FROM tele t JOIN pages_meta USING (page_id) WHERE corpus = 'holdout'")
def holdout_counts(s, d):
    held = relation(s, d, "pages_meta").where("corpus = 'holdout'").select("page_id")
    return per_page(told(s, d)).join(trusted(s, d), "page_id").join(held, "page_id").select("page_id", "boxes", F.col("checked").alias("marked"), F.col("routed").alias("flagged"), F.col("trusted").alias("recognised"))


@query("SELECT event_type AS page, count(*) AS crops, round(median(value), 6) AS median_ms, list_sort(list(value))[least(count(*) - 1, CAST(floor(count(*)*0.95) AS BIGINT)) + 1] AS p95_ms, min(value) AS least_ms FROM events GROUP BY event_type")
def scorer_timing(s, d):
    own, n = read(s, d, "events"), F.col("n")
    order = ranks.order_statistics(own, "event_type", "value", {"low": F.floor((n + 1) / 2), "high": F.floor(n / 2) + 1, "p95_ms": F.least(n - 1, F.floor(n * 0.95)) + 1, "least_ms": F.lit(1)})
    return own.groupBy("event_type").agg(F.count("*").alias("crops")).join(order, "event_type").select(F.col("event_type").alias("page"), "crops", F.round((F.col("low") + F.col("high")) / 2, 6).alias("median_ms"), "p95_ms", "least_ms")


@query(TELEMETRY + "SELECT count(*) AS found, count(*) FILTER (is_checked) AS marks, printf('%.1f%%', round(100.0*count(*) FILTER (reasons <> '')/count(*), 1)) AS flag_percent, count(*) FILTER (reasons <> '' AND corpus = 'sample') AS sample_flagged, count(*) FILTER (corpus = 'sample') AS sample_boxes FROM x")
def report_rollup(s, d):
    sample = F.col("corpus") == "sample"
    percent = F.format_string("%.1f%%", F.round(100.0 * F.count_if(F.size("reasons") > 0) / F.count("*"), 1).cast("double"))
    return told(s, d).agg(F.count("*").alias("found"), F.count_if("is_checked").alias("marks"), percent.alias("flag_percent"), F.count_if((F.size("reasons") > 0) & sample).alias("sample_flagged"), F.count_if(sample).alias("sample_boxes"))


REASONS = {"INK_AMBIGUOUS": "ink near the threshold", "FRAGMENTED_MARK": "mark in pieces", "STRAY_STROKE": "stroke from outside", "THIN_MARK": "thin mark"}


@query(TELEMETRY + "SELECT CASE reason " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REASONS.items()) + " ELSE lower(replace(reason, '_', ' ')) END AS label, count(*) AS n FROM (SELECT unnest(string_split(reasons, '|')) AS reason FROM x WHERE reasons <> '') GROUP BY 1")
def labelled_reasons(s, d):
    return told(s, d).select(F.explode("reasons").alias("reason")).select(geo.human(F.col("reason"), REASONS).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


# cards

POOLS = DEFAULT_SQL + """, z AS (SELECT r.page_id, r.box_id, CASE WHEN reasons <> '' OR (ink > 0.03 AND ink < 0.35) THEN 'ambiguous' WHEN ink > 0.35 THEN 'anchor-filled' WHEN ink < 0.02 THEN 'anchor-empty' END AS pool, y1, x1 FROM r JOIN boxes_gold g USING (page_id, box_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, pool ORDER BY CASE WHEN pool = 'ambiguous' THEN 0 ELSE (page_id*7919 + box_id*104729)%1000003 END, y1, x1, box_id) AS n FROM z WHERE pool IS NOT NULL)
"""


@query(POOLS + "SELECT page_id, box_id, pool FROM k WHERE n <= 4")
def card_pools(s, d):
    """Of each page the first four ambiguous boxes, and up to four chosen by a hash from the filled and the empty ones."""
    own = ruled(s, d, rules.DEFAULT).join(gold(s, d).select("page_id", "box_id", "y1", "x1"), ["page_id", "box_id"])
    pool = F.when((F.size("reasons") > 0) | ((F.col("ink") > 0.03) & (F.col("ink") < 0.35)), "ambiguous").when(F.col("ink") > 0.35, "anchor-filled").when(F.col("ink") < 0.02, "anchor-empty")
    chance = F.when(F.col("pool") == "ambiguous", 0).otherwise((F.col("page_id") * 7919 + F.col("box_id") * 104729) % 1000003)
    order = W.partitionBy("page_id", "pool").orderBy(chance, "y1", "x1", "box_id")
    return own.withColumn("pool", pool).where("pool IS NOT NULL").withColumn("n", F.row_number().over(order)).where("n <= 4").select("page_id", "box_id", "pool")


DECK = """, cand AS (SELECT page_id, box_id, x1, y1, x2, y2, pk, sk FROM boxes_pred UNION ALL SELECT page_id, box_id + 700, x1 - 2, y1 + 1, x2 - 2, y2 + 1, pk, sk + 1 FROM boxes_pred WHERE pk%2 = 0),
z AS (SELECT *, CASE WHEN pk%7 = 0 THEN 3 ELSE sk%3 END AS pool, (page_id*7919 + box_id*104729)%1000003 AS chance FROM cand),
pick AS MATERIALIZED (SELECT *, CAST(x1+x2 AS DOUBLE)/2 AS mx, CAST(y1+y2 AS DOUBLE)/2 AS my, row_number() OVER (PARTITION BY page_id ORDER BY pool, n) AS k FROM (SELECT *, row_number() OVER (PARTITION BY page_id, pool ORDER BY CASE WHEN pool = 0 THEN 0 ELSE chance END, y1, x1, box_id) AS n FROM z) WHERE n <= CASE WHEN pool = 3 THEN 3 ELSE 4 END),
w AS (SELECT page_id, k, [{'k': k, 'x': mx, 'y': my}] AS kept FROM pick WHERE k = 1
UNION ALL SELECT q.page_id, q.k, CASE WHEN len(list_filter(w.kept, lambda e: abs(e.x - q.mx) + abs(e.y - q.my) < 4)) = 0 THEN list_append(w.kept, {'k': q.k, 'x': q.mx, 'y': q.my}) ELSE w.kept END FROM w JOIN pick q ON q.page_id = w.page_id AND q.k = w.k + 1),
stay AS (SELECT page_id, unnest(kept).k AS k FROM w WHERE (page_id, k) IN (SELECT page_id, max(k) FROM pick GROUP BY page_id))
"""
POOLS_NAMED = ("ambiguous", "anchor-filled", "anchor-empty", "negative")


@query(DECK + "SELECT page_id, box_id, CASE pool " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(POOLS_NAMED)) + " END AS pool FROM stay JOIN pick USING (page_id, k)")
def card_deck(s, d):
    """Cards of a page from four pools, at most three of them rejects; a box less than four pixels from an earlier card's is left out."""
    p = pred(s, d).select("page_id", "box_id", "x1", "y1", "x2", "y2", "pk", "sk")
    moved = {c: F.expr(f"{c} {by}") for c, by in {"box_id": "+ 700", "x1": "- 2", "y1": "+ 1", "x2": "- 2", "y2": "+ 1", "sk": "+ 1"}.items()}
    own = twinned(p, F.expr("pk % 2 = 0"), **moved).withColumns({"pool": F.expr("CASE WHEN pk % 7 = 0 THEN 3 ELSE sk % 3 END"), "chance": (F.col("page_id") * 7919 + F.col("box_id") * 104729) % 1000003})
    first = W.partitionBy("page_id", "pool").orderBy(F.when(F.col("pool") == 0, 0).otherwise(F.col("chance")), "y1", "x1", "box_id")
    drawn = own.withColumn("n", F.row_number().over(first)).where("n <= CASE WHEN pool = 3 THEN 3 ELSE 4 END")
    # in the order of the pools, as ids that the choice goes by; distances are whole halves, so less than 4 is 3.5 at most
    dealt = drawn.select("page_id", (F.col("pool") * 10 + F.col("n")).cast("int").alias("box_id"), "x1", "y1", "x2", "y2", F.col("box_id").alias("card"), "pool")
    names = F.element_at(F.array(*[F.lit(n) for n in POOLS_NAMED]), (F.col("pool") + 1).cast("int"))
    return spatial.dedupe(dealt, 3.5).select("page_id", F.col("card").alias("box_id"), names.alias("pool"))


@query(CARDS + PAIRS + """, bm AS (SELECT * FROM boxes_pred SEMI JOIN (SELECT page_id, p_box_id AS box_id FROM m WHERE NOT g_ignore) USING (page_id, box_id)),
hm AS (SELECT c.page_id, c.point_id, p.box_id, p.is_checked, row_number() OVER (PARTITION BY c.page_id, c.point_id ORDER BY p.y1, p.x1, p.box_id) AS k FROM cards c JOIN bm p ON p.page_id = c.page_id AND abs(c.cx - CAST(p.x1+p.x2 AS DOUBLE)/2) + abs(c.cy - CAST(p.y1+p.y2 AS DOUBLE)/2) < 18 WHERE label IN ('empty', 'filled') AND stratum = 'hard-real')
SELECT page_id, point_id, box_id, is_checked FROM hm WHERE k = 1""")
def hard_cards_matched(s, d):
    """Hard cards of real pages with the first box near them of those that have a label; a card without one is skipped."""
    p, g = sides(s, d)
    labelled = spatial.first_match(spatial.candidates(p, g)).select("page_id", F.col("p_box_id").alias("box_id"))
    hard = cards(s, d).where("label IN ('empty', 'filled') AND stratum = 'hard-real'")
    return spatial.near(hard, p.join(labelled, ["page_id", "box_id"], "left_semi"), 18, how="inner").select("page_id", "point_id", F.col("b_box_id").alias("box_id"), F.col("b_is_checked").alias("is_checked"))


@query(CARDS + ", booth AS (SELECT 'c' || page_id || '-' || box_id AS id, CASE q%4 WHEN 0 THEN 'E' WHEN 1 THEN 'F' WHEN 2 THEN 'U' ELSE 'N' END AS code FROM boxes_gold WHERE pk%2 = 0) SELECT 'c' || page_id || '-' || point_id AS id, stratum, CASE code WHEN 'E' THEN 'empty' WHEN 'F' THEN 'filled' WHEN 'U' THEN 'unsure' ELSE 'not_a_checkbox' END AS answer FROM cards JOIN booth ON id = 'c' || page_id || '-' || point_id")
def booth_answers(s, d):
    """Answers of the booth with the cards that they were given for."""
    name = lambda a, b: F.concat(F.lit("c"), F.col(a), F.lit("-"), F.col(b))
    answers = gold(s, d).where("pk % 2 = 0").select(name("page_id", "box_id").alias("id"), F.expr("CASE q % 4 WHEN 0 THEN 'E' WHEN 1 THEN 'F' WHEN 2 THEN 'U' ELSE 'N' END").alias("code"))
    meaning = F.create_map(*[F.lit(x) for kv in (("F", "filled"), ("E", "empty"), ("N", "not_a_checkbox"), ("U", "unsure")) for x in kv])
    return cards(s, d).withColumn("id", name("page_id", "point_id")).join(answers, "id").select("id", "stratum", meaning[F.col("code")].alias("answer"))


@query(", near AS MATERIALIZED (SELECT a.page_id, a.box_id, abs(CAST(a.x1+a.x2 AS DOUBLE)/2 - CAST(k.x1+k.x2 AS DOUBLE)/2) + abs(CAST(a.y1+a.y2 AS DOUBLE)/2 - CAST(k.y1+k.y2 AS DOUBLE)/2) AS far FROM boxes_pred a JOIN (SELECT * FROM boxes_pred WHERE pk%3 <> 0) k USING (page_id)) SELECT a.page_id, a.box_id FROM boxes_pred a ANTI JOIN (SELECT page_id, box_id FROM near WHERE far <= 4) n USING (page_id, box_id)")
def reject_finder(s, d):
    """Candidates of the loose pass that lie apart from every box of the strict one."""
    every = pred(s, d)
    return spatial.apart(every, every.where("pk % 3 <> 0"), 4.0).select("page_id", "box_id")


@query(CARDS + ", far AS (SELECT c.page_id, c.point_id, c.cx, c.cy, min(abs(c.cx - CAST(p.x1+p.x2 AS DOUBLE)/2) + abs(c.cy - CAST(p.y1+p.y2 AS DOUBLE)/2)) AS far FROM cards c LEFT JOIN boxes_pred p ON p.page_id = c.page_id GROUP BY 1, 2, 3, 4) SELECT page_id, point_id, CAST(trunc(cx - 11) AS BIGINT) AS x1, CAST(trunc(cy - 11) AS BIGINT) AS y1, CAST(trunc(cx + 11) AS BIGINT) AS x2, CAST(trunc(cy + 11) AS BIGINT) AS y2 FROM far WHERE far IS NULL OR far > 33")
def square_cards(s, d):
    """Cards with no box within one and a half sides get a square of the side around them."""
    alone = spatial.nearest(cards(s, d), pred(s, d), F.lit(33), keep=("cx", "cy")).where("box_id IS NULL")
    return alone.select("page_id", "point_id", *spatial.square(F.col("cx"), F.col("cy"), F.lit(22)))


@query(", old AS (SELECT page_id, box_id, 'old' AS route FROM boxes_gold WHERE pk%3 = 0), fresh AS (SELECT page_id, box_id, 'new' AS route FROM boxes_gold WHERE pk%2 = 0) SELECT * FROM fresh UNION ALL SELECT o.* FROM old o ANTI JOIN fresh f USING (page_id, box_id)")
def vote_upsert(s, d):
    """A record of votes with new decisions in the place of old ones."""
    votes = lambda k, name: gold(s, d).where(f"pk % {k} = 0").select("page_id", "box_id", F.lit(name).alias("route"))
    return rules.upsert(votes(3, "old"), votes(2, "new"), "page_id", "box_id")


# texts

LINE = "CASE WHEN event_id%4 = 0 THEN '| v' || CAST(event_id AS VARCHAR) || ' | mixed | ' ELSE '|  | plain | ' END || CAST(event_id%50 AS VARCHAR) || '/' || CAST(event_id%7 AS VARCHAR) || '/3 amb |'"


@query(f", t AS (SELECT event_id, user_id, {LINE} AS line FROM events), c AS (SELECT event_id, user_id, nullif(regexp_extract(line, '^\\| (v[0-9]+)', 1), '') AS run, trim(string_split(line, '|')[3]) AS kind, regexp_extract_all(string_split(line, '|')[4], '[0-9]+') AS n FROM t) SELECT event_id, last_value(run IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run, kind, CAST(list_sum(list_transform(n, lambda e: CAST(e AS BIGINT))) AS BIGINT) AS total FROM c")
def markdown_rows(s, d):
    """Rows of a markdown table: run (carried down where the cell is empty), kind, and the sum of the counts in the last cell."""
    line = F.concat(F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("| v"), F.col("event_id"), F.lit(" | mixed | "))).otherwise("|  | plain | "), F.col("event_id") % 50, F.lit("/"), F.col("event_id") % 7, F.lit("/3 amb |"))
    cell = F.split("line", r"\|")
    own = read(s, d, "events").select("event_id", "user_id", line.alias("line"))
    run = F.nullif(F.regexp_extract("line", r"^\| (v[0-9]+)", 1), F.lit(""))
    total = F.aggregate(F.regexp_extract_all(F.get(cell, F.lit(3)), F.lit("([0-9]+)")), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return own.select("event_id", F.last(run, ignorenulls=True).over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)).alias("run"), F.trim(F.get(cell, F.lit(2))).alias("kind"), total.alias("total"))


REPLY = """CASE WHEN event_id%8 = 4 THEN 'I think {"is_checkbox": true, "confidence": 0.75}' WHEN event_id%4 = 0 THEN 'Sure: {"is_checkbox": true, "filled": false, "confidence": 0.75, "why": "' || repeat('x', CAST(100 + event_id%50 AS INT)) || '"} ok' WHEN event_id%4 = 1 THEN '{"filled": true}' WHEN event_id%4 = 2 THEN '{"is_checkbox": broken' ELSE 'no answer' END"""


@query("SELECT event_id, event_id%4 = 0 AS is_checkbox, CASE WHEN event_id%8 <> 4 THEN event_id%4 = 1 END AS filled, CASE event_id%4 WHEN 0 THEN 0.75 ELSE 0.5 END AS confidence, CASE event_id%8 WHEN 0 THEN repeat('x', CAST(least(120, 100 + event_id%50) AS INT)) ELSE '' END AS why FROM events WHERE event_id%4 <= 1")
def lenient_replies(s, d):
    """Verdicts read from chatty replies; a reply without one object in it gives none."""
    own = read(s, d, "events").select("event_id", F.expr(REPLY.replace("VARCHAR", "STRING")).alias("reply"))
    return own.select("event_id", geo.verdict(F.col("reply")).alias("v")).where("v IS NOT NULL").select("event_id", "v.*")


SIZES = ", size AS (SELECT DISTINCT 200 + q*61 AS w, 150 + (sk%10)*211 AS h FROM box_base), "
FITS = "CAST(ceil({w}/28.0) AS BIGINT)*28 <= 1568 AND CAST(ceil({h}/28.0) AS BIGINT)*28 <= 1568 AND CAST(ceil({w}/28.0) AS BIGINT)*CAST(ceil({h}/28.0) AS BIGINT) <= 1568"


@query(SIZES + f"""long AS (SELECT w, h, greatest(w, h) AS a, least(w, h) AS b FROM size), try AS (SELECT w, h, a, b, unnest(range(1, CAST(a AS BIGINT))) AS m FROM long),
best AS (SELECT w, h, a, b, max(m) FILTER (m = 1 OR ({FITS.format(w='m', h='greatest(round_even(m/(CAST(a AS DOUBLE)/b), 0), 1)')})) AS m FROM try GROUP BY 1, 2, 3, 4),
z AS (SELECT w, h, CASE WHEN {FITS.format(w='w', h='h')} THEN a ELSE m END AS ra, CASE WHEN {FITS.format(w='w', h='h')} THEN b ELSE CAST(greatest(round_even(m/(CAST(a AS DOUBLE)/b), 0), 1) AS BIGINT) END AS rb FROM best)
SELECT w, h, CASE WHEN h > w THEN rb ELSE ra END AS resized_w, CASE WHEN h > w THEN ra ELSE rb END AS resized_h, CAST(ceil(ra/28.0)*ceil(rb/28.0) AS BIGINT) AS tokens FROM z""")
def tier_resize(s, d):
    """The size that an image is brought to on a tier, by a search along its longer edge, and its tokens."""
    own = relation(s, d, "box_base").select((200 + F.col("q") * 61).cast("long").alias("w"), (150 + F.col("sk") % 10 * 211).cast("long").alias("h")).distinct()
    r = geo.resized(F.col("w"), F.col("h"), 1568, 1568)
    return own.select("w", "h", r.alias("r")).select("w", "h", F.col("r.w").alias("resized_w"), F.col("r.h").alias("resized_h"), geo.image_tokens(F.col("r.w"), F.col("r.h")).alias("tokens"))
