"""Queries by name, and DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickgrid.functions import geometry as geo
from tickgrid.functions import ranks
from tickgrid.functions.lineage import as_dealt, spool
from tickgrid.operators import placement, rules, spatial
from tickgrid.plans.derived import WITH, relation, relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"{WITH}{oracle if oracle.startswith(',') else ' ' + oracle}"
        return f

    return add


def gold(s, d):
    return relation(s, d, "boxes_gold")


def pred(s, d):
    return relation(s, d, "boxes_pred")


def read(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


PAIRS = """, pairs AS (SELECT p.page_id, p.box_id AS p_box_id, g.box_id AS g_box_id, p.is_checked AS p_state, g.is_checked AS g_state, g.ignore AS g_ignore,
  greatest(0, least(p.x2, g.x2) - greatest(p.x1, g.x1)) * greatest(0, least(p.y2, g.y2) - greatest(p.y1, g.y1)) AS shared,
  (p.x2-p.x1)*(p.y2-p.y1) + (g.x2-g.x1)*(g.y2-g.y1) AS areas FROM boxes_pred p JOIN boxes_gold g ON p.page_id = g.page_id),
m AS MATERIALIZED (SELECT *, CAST(shared AS DOUBLE)/CAST(areas - shared AS DOUBLE) AS iou FROM pairs WHERE shared > 0 AND CAST(shared AS DOUBLE)/CAST(areas - shared AS DOUBLE) >= 0.5)
"""
SCORES = PAIRS + """, tp AS (SELECT page_id, count(*) AS tp, sum(CASE WHEN p_state = g_state THEN 1 ELSE 0 END) AS right_state FROM m WHERE NOT g_ignore GROUP BY page_id),
fp AS (SELECT p.page_id, count(*) AS fp FROM boxes_pred p ANTI JOIN m ON m.page_id = p.page_id AND m.p_box_id = p.box_id GROUP BY p.page_id),
fn AS (SELECT g.page_id, count(*) AS fn FROM (SELECT * FROM boxes_gold WHERE NOT ignore) g ANTI JOIN m ON m.page_id = g.page_id AND m.g_box_id = g.box_id GROUP BY g.page_id),
score AS (SELECT pg.page_id, pg.corpus, pg.factor, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(right_state, 0) AS right_state
 FROM pages_meta pg JOIN (SELECT DISTINCT page_id FROM boxes_gold) b USING (page_id) LEFT JOIN tp USING (page_id) LEFT JOIN fp USING (page_id) LEFT JOIN fn USING (page_id))
"""


def rule_sql(low: str, high: str, thin: str, frag: str, name: str) -> str:
    """The rule engine as staged CTEs; ``name`` is the last one."""
    rule = {"filled": "TRUE", "empty": "FALSE"}
    return f""", {name}0 AS (SELECT *, ink > 0.1 AS c0, round(abs(1/(1+exp(-(ink-0.1)/0.04)) - 0.5)*2, 4) AS f0,
  span >= 0.45 AND (CASE WHEN ink > 1e-6 THEN largest/ink ELSE 0 END) >= 0.6 AND ink > 0.06 AND outside <= 0.5 AS clear FROM features),
{name}1 AS (SELECT *, c0 OR clear AS c1, CASE WHEN clear THEN greatest(f0, 0.9) ELSE f0 END AS f1, NOT clear AND ink >= {low} AND ink <= {high} AS amb FROM {name}0),
{name}2 AS (SELECT *, c1 AND n >= 4 AND largest < 0.08 AND ink < 0.5 AS frag FROM {name}1),
{name}3 AS (SELECT *, CASE WHEN frag THEN {rule.get(frag, 'c1')} ELSE c1 END AS c2, CASE WHEN frag THEN least(f1, 0.3) ELSE f1 END AS f2 FROM {name}2),
{name}4 AS (SELECT *, NOT c2 AND span >= 0.55 AND ink > 0.02 AS maybe FROM {name}3),
{name}5 AS (SELECT *, maybe AND outside > 0.5 AS s4, maybe AND outside <= 0.5 AS thin FROM {name}4),
{name}6 AS (SELECT *, CASE WHEN s4 THEN FALSE WHEN thin THEN {rule.get(thin, 'c2')} ELSE c2 END AS c3,
  CASE WHEN thin THEN {'least(0.75, round(span, 2))' if thin == 'filled' else 'least(f2, 0.4)'} ELSE f2 END AS f3 FROM {name}5),
{name}7 AS (SELECT *, c3 AND outside > 0.5 AND ink < 0.5 AS s5 FROM {name}6),
{name} AS (SELECT page_id, box_id, pk, sk, q, d, t, ink, CASE WHEN s5 THEN FALSE ELSE c3 END AS is_checked, CAST(CASE WHEN s5 THEN least(f3, 0.4) ELSE f3 END AS DOUBLE) AS confidence,
  concat_ws('|', CASE WHEN amb THEN 'INK_AMBIGUOUS' END, CASE WHEN frag THEN 'FRAGMENTED_MARK' END, CASE WHEN s4 THEN 'STRAY_STROKE' END, CASE WHEN thin THEN 'THIN_MARK' END, CASE WHEN s5 THEN 'STRAY_STROKE' END) AS reasons FROM {name}7)
"""


DEFAULT_SQL, STRICT_SQL = rule_sql("0.05", "0.2", "filled", "empty", "r"), rule_sql("0.03", "0.3", "route", "route", "s")


def ruled(s, d, *policies) -> DataFrame:
    return rules.classify(relation(s, d, "features"), rules.policies(s, *policies))


def flat(df: DataFrame) -> DataFrame:
    return df.withColumn("reasons", F.concat_ws("|", "reasons"))


@query("SELECT page_id, box_id, x2-x1 AS w, y2-y1 AS h, CAST(x1+x2 AS DOUBLE)/2 AS cx, CAST(y1+y2 AS DOUBLE)/2 AS cy FROM boxes_gold")
def box_geometry(s, d):
    cx, cy = geo.centre()
    return gold(s, d).select("page_id", "box_id", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), cx.alias("cx"), cy.alias("cy"))


@query("SELECT page_id, string_agg(concat_ws(',', x1, y1, x2, y2, CASE WHEN is_checked THEN 1 ELSE 0 END), ';' ORDER BY y1, x1, box_id) AS boxes FROM boxes_pred GROUP BY page_id")
def contract_projection(s, d):
    """The default answer of a page: corner and state of its boxes in reading order, nothing else."""
    one = F.struct("y1", "x1", "box_id", F.concat_ws(",", "x1", "y1", "x2", "y2", F.col("is_checked").cast("int")).alias("v"))
    return pred(s, d).groupBy("page_id").agg(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(one)), lambda x: x["v"])).alias("boxes"))


@query("SELECT page_id, box_id, CAST(floor(greatest(0, x1)/2.0) AS BIGINT) AS x1, CAST(floor(greatest(0, y1)/2.0) AS BIGINT) AS y1, CAST(floor(least(400, x2)/2.0) AS BIGINT) AS x2, CAST(floor(least(60, y2)/2.0) AS BIGINT) AS y2 FROM boxes_pred")
def clip_and_downscale(s, d):
    low = lambda c: F.floor(F.greatest(F.lit(0), F.col(c)) / 2).alias(c)
    high = lambda c, m: F.floor(F.least(F.lit(m), F.col(c)) / 2).alias(c)
    return pred(s, d).select("page_id", "box_id", low("x1"), low("y1"), high("x2", 400), high("y2", 60))


CONSENSUS = """, a AS (SELECT page_id, box_id, greatest(x2-x1, y2-y1) AS side, y2-y1 AS h, CAST(sk%10 AS DOUBLE)/10 AS ring, pk FROM boxes_gold),
f1 AS (SELECT * FROM a WHERE ring < 0.5), m1 AS (SELECT page_id, median(side) AS med FROM f1 GROUP BY page_id),
f2 AS (SELECT f1.*, med, abs(side-med)/med <= 0.15 AS ok FROM f1 JOIN m1 USING (page_id)), m2 AS (SELECT page_id, median(h) AS mh, count(*) AS n FROM f2 WHERE ok GROUP BY page_id),
f3 AS (SELECT f2.page_id, f2.box_id, ok, CASE WHEN NOT ok THEN 'SIZE_CONSENSUS' WHEN n >= 5 AND abs(h-mh)/mh > 0.1 AND pk%3 = 0 THEN 'TEXT_LIKE_SIZE_OUTLIER' END AS reason FROM f2 LEFT JOIN m2 USING (page_id))
"""


def consensus(s, d, text_like=0.10):
    """Ring ink, size consensus and text-like filters, each reject kept with its reason."""
    own = gold(s, d).select("page_id", "box_id", F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("side"), (F.col("y2") - F.col("y1")).alias("h"), (F.col("sk") % 10 / 10).alias("ring"), (F.col("pk") % 3 == 0).alias("text_like"))
    page = W.partitionBy("page_id")
    kept = own.where("ring < 0.5").withColumn("med", F.median("side").over(page)).withColumn("ok", F.abs(F.col("side") - F.col("med")) / F.col("med") <= 0.15)
    kept = kept.withColumns({"mh": F.median(F.when(F.col("ok"), F.col("h"))).over(page), "n": F.expr("count_if(ok)").over(page)})
    odd = (F.col("n") >= 5) & (F.abs(F.col("h") - F.col("mh")) / F.col("mh") > text_like) & F.col("text_like")
    return kept.withColumn("reason", F.when(~F.col("ok"), "SIZE_CONSENSUS").when(odd, "TEXT_LIKE_SIZE_OUTLIER"))


@query(CONSENSUS + "SELECT page_id, box_id FROM f1")
def ring_ink_filter(s, d):
    return consensus(s, d).select("page_id", "box_id")


@query(CONSENSUS + "SELECT page_id, box_id FROM f3 WHERE ok")
def size_consensus(s, d):
    return consensus(s, d).where("ok").select("page_id", "box_id")


@query(CONSENSUS + "SELECT page_id, box_id FROM f3 WHERE reason IS NULL")
def text_like_outlier(s, d):
    return consensus(s, d).where("reason IS NULL").select("page_id", "box_id")


@query(CONSENSUS + "SELECT reason, count(*) AS n FROM f3 WHERE reason IS NOT NULL GROUP BY reason")
def rejects_audit(s, d):
    return consensus(s, d).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@query(", a AS (SELECT page_id, greatest(x2-x1, y2-y1) AS side, min(greatest(x2-x1, y2-y1)) OVER (PARTITION BY page_id) AS least FROM boxes_gold), h AS (SELECT page_id, least + 2*((side-least)//2) AS bin, count(*) AS n FROM a GROUP BY 1, 2) SELECT page_id, CAST(greatest(8, bin + 1) AS BIGINT) AS side FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, bin) AS r FROM h) WHERE r = 1")
def box_side_vote(s, d):
    """The commonest larger side of a page in bins of two from its least, the lowest bin on ties; 8 at least."""
    own = gold(s, d).select("page_id", F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("side"))
    own = own.withColumn("least", F.min("side").over(W.partitionBy("page_id")))
    bins = own.withColumn("bin", F.col("least") + F.floor((F.col("side") - F.col("least")) / 2) * 2).groupBy("page_id", "bin").count()
    return bins.groupBy("page_id").agg(F.greatest(F.lit(8).cast("long"), F.max_by("bin", F.struct("count", -F.col("bin"))) + 1).alias("side"))


@query(DEFAULT_SQL + "SELECT page_id, box_id, is_checked, confidence, reasons FROM r")
def rule_engine_default(s, d):
    return flat(ruled(s, d, rules.DEFAULT)).select("page_id", "box_id", "is_checked", "confidence", "reasons")


@query(STRICT_SQL + "SELECT page_id, box_id, is_checked, confidence, reasons FROM s")
def rule_engine_strict(s, d):
    return flat(ruled(s, d, rules.STRICT)).select("page_id", "box_id", "is_checked", "confidence", "reasons")


BOTH = DEFAULT_SQL + STRICT_SQL


@query(BOTH + "SELECT r.page_id, r.box_id, r.is_checked AS a_checked, s.is_checked AS b_checked, r.reasons AS a_reasons, s.reasons AS b_reasons FROM r JOIN s USING (page_id, box_id) WHERE r.is_checked <> s.is_checked OR r.reasons <> s.reasons")
def policy_compare(s, d):
    """Boxes that two policies read differently: one scan, two policy rows, no self-join."""
    one = lambda p, c: F.max(F.when(F.col("policy") == p, F.col(c)))
    both = flat(ruled(s, d, rules.DEFAULT, rules.STRICT)).groupBy("page_id", "box_id").agg(one("default", "is_checked").alias("a_checked"), one("strict", "is_checked").alias("b_checked"), one("default", "reasons").alias("a_reasons"), one("strict", "reasons").alias("b_reasons"))
    return both.where("a_checked <> b_checked OR a_reasons <> b_reasons")


@query(BOTH + "SELECT count(*) AS scored, sum(CASE WHEN r.is_checked = g.is_checked THEN 1 ELSE 0 END) AS correct_a, sum(CASE WHEN s.is_checked = g.is_checked THEN 1 ELSE 0 END) AS correct_b, sum(CASE WHEN r.is_checked <> s.is_checked THEN 1 ELSE 0 END) AS differ FROM r JOIN s USING (page_id, box_id) JOIN boxes_gold g USING (page_id, box_id) WHERE NOT g.ignore")
def policy_agreement(s, d):
    rows = ruled(s, d, rules.DEFAULT, rules.STRICT).withColumns({"truth": F.col("q") % 3 == 0, "skip": F.col("pk") % 41 == 0}).where("NOT skip")
    one = rows.groupBy("page_id", "box_id", "truth").agg(F.max(F.when(F.col("policy") == "default", F.col("is_checked"))).alias("a"), F.max(F.when(F.col("policy") == "strict", F.col("is_checked"))).alias("b"))
    return one.agg(F.count("*").alias("scored"), F.expr("count_if(a = truth)").alias("correct_a"), F.expr("count_if(b = truth)").alias("correct_b"), F.expr("count_if(a <> b)").alias("differ"))


@query(DEFAULT_SQL + ", p AS (SELECT *, CAST(t*12 + q%5 AS DOUBLE)/100 AS p FROM r) SELECT page_id, box_id, is_checked, round(CASE WHEN (p > 0.5) = is_checked THEN greatest(confidence, least(0.98, 0.5 + abs(p - 0.5))) ELSE least(confidence, 0.4) END, 4) AS confidence, CASE WHEN (p > 0.5) = is_checked THEN reasons ELSE concat_ws('|', nullif(reasons, ''), 'CLASSIFIER_DISAGREE') END AS reasons FROM p")
def model_merge(s, d):
    own = ruled(s, d, rules.DEFAULT).withColumn("p", (F.col("t") * 12 + F.col("q") % 5).cast("double") / 100)
    return flat(rules.second_opinion(own)).select("page_id", "box_id", "is_checked", "confidence", "reasons")


@query(DEFAULT_SQL + PAIRS + """, fm AS (SELECT page_id, p_box_id, g_state FROM (SELECT *, row_number() OVER (PARTITION BY page_id, p_box_id ORDER BY g_box_id) AS k FROM m WHERE NOT g_ignore) WHERE k = 1),
p AS (SELECT r.*, CAST(t*12 + q%5 AS DOUBLE)/100 AS p, g_state AS truth FROM r JOIN fm ON fm.page_id = r.page_id AND fm.p_box_id = r.box_id), u AS (
SELECT 'both' AS reader, reasons <> '' OR (p > 0.5) <> is_checked AS queued, is_checked = truth AS good FROM p UNION ALL SELECT 'model', p > 0.1 AND p < 0.9, (p >= 0.5) = truth FROM p UNION ALL SELECT 'rules', reasons <> '', is_checked = truth FROM p)
SELECT reader, count(*) AS graded, sum(CASE WHEN queued THEN 1 ELSE 0 END) AS queue, sum(CASE WHEN NOT queued AND good THEN 1 ELSE 0 END) AS good, sum(CASE WHEN NOT queued AND NOT good THEN 1 ELSE 0 END) AS wrong FROM u GROUP BY reader""")
def reader_race(s, d):
    """Three readers on the boxes that have a label: the first, in label order, that a box overlaps enough."""
    truth = spatial.first_match(pairs(s, d)).select("page_id", F.col("p_box_id").alias("box_id"), F.col("g_is_checked").alias("truth"))
    own = ruled(s, d, rules.DEFAULT).join(truth, ["page_id", "box_id"]).withColumns({"p": (F.col("t") * 12 + F.col("q") % 5).cast("double") / 100, "flag": F.size("reasons") > 0})
    reader = lambda name, queued, good: F.struct(F.lit(name).alias("reader"), F.expr(queued).alias("queued"), F.expr(good).alias("good"))
    rows = own.select(F.explode(F.array(reader("rules", "flag", "is_checked = truth"), reader("model", "p > 0.1 AND p < 0.9", "(p >= 0.5) = truth"), reader("both", "flag OR (p > 0.5) <> is_checked", "is_checked = truth"))).alias("r")).select("r.*")
    return rows.groupBy("reader").agg(F.count("*").alias("graded"), F.expr("count_if(queued)").alias("queue"), F.expr("count_if(NOT queued AND good)").alias("good"), F.expr("count_if(NOT queued AND NOT good)").alias("wrong"))


@query(DEFAULT_SQL + """, v AS (SELECT *, (sk + box_id)%2 = 0 AND reasons <> '' AS used, pk%11 <> 0 AS vb, CASE WHEN pk%13 <> 0 THEN q%2 = 0 END AS vf, CASE pk%3 WHEN 0 THEN 'VLM_AGREE' WHEN 1 THEN 'JUDGED' ELSE 'REVIEW' END AS route, CAST(50 + t AS DOUBLE)/100 AS vc FROM r)
SELECT page_id, box_id, CASE WHEN used AND vb AND route <> 'REVIEW' AND vf IS NOT NULL THEN vf ELSE is_checked END AS is_checked,
 CASE WHEN used AND NOT vb THEN least(confidence, 0.3) WHEN used AND route <> 'REVIEW' AND vf IS NOT NULL THEN greatest(confidence, vc) ELSE confidence END AS confidence,
 CASE WHEN used AND NOT vb THEN concat_ws('|', reasons, 'NOT_A_CHECKBOX', route) WHEN used THEN concat_ws('|', reasons, route) ELSE reasons END AS reasons FROM v""")
def escalation_replay(s, d):
    key = F.substring(F.sha1(F.concat_ws(":", "page_id", "box_id").cast("binary")), 1, 16)
    votes = relation(s, d, "features").where("(sk + box_id) % 2 = 0").select(key.alias("key"), (F.col("pk") % 11 != 0).alias("v_is_checkbox"), F.when(F.col("pk") % 13 != 0, F.col("q") % 2 == 0).alias("v_filled"), F.expr("CASE pk % 3 WHEN 0 THEN 'VLM_AGREE' WHEN 1 THEN 'JUDGED' ELSE 'REVIEW' END").alias("route"), ((F.col("t") + 50).cast("double") / 100).alias("v_confidence"))
    return flat(rules.replay(ruled(s, d, rules.DEFAULT).withColumn("key", key), votes)).select("page_id", "box_id", "is_checked", "confidence", "reasons")


def pairs(s, d):
    return spatial.candidates(*sides(s, d))


@query(PAIRS + "SELECT page_id, p_box_id, g_box_id, iou FROM m")
def iou_candidates(s, d):
    return pairs(s, d).select("page_id", "p_box_id", "g_box_id", "iou")


@query(PAIRS + "SELECT page_id, p_box_id, g_box_id FROM m")
def greedy_match(s, d):
    return spatial.greedy_match(pairs(s, d)).select("page_id", "p_box_id", "g_box_id")


@query(PAIRS + "SELECT page_id, p_box_id, g_box_id, p_state = g_state AS agrees FROM m WHERE NOT g_ignore")
def first_match(s, d):
    return spatial.first_match(pairs(s, d)).select("page_id", "p_box_id", "g_box_id", (F.col("p_is_checked") == F.col("g_is_checked")).alias("agrees"))


def unmatched(boxes, matched, side):
    return boxes.join(matched.select("page_id", F.col(f"{side}_box_id").alias("box_id")), ["page_id", "box_id"], "left_anti")


@query(PAIRS + "SELECT p.page_id, p.box_id FROM boxes_pred p ANTI JOIN m ON m.page_id = p.page_id AND m.p_box_id = p.box_id")
def false_positives(s, d):
    return unmatched(pred(s, d), spatial.greedy_match(pairs(s, d)), "p").select("page_id", "box_id")


@query(PAIRS + "SELECT g.page_id, g.box_id FROM (SELECT * FROM boxes_gold WHERE NOT ignore) g ANTI JOIN m ON m.page_id = g.page_id AND m.g_box_id = g.box_id")
def false_negatives(s, d):
    return unmatched(gold(s, d).where("NOT ignore"), spatial.greedy_match(pairs(s, d)), "g").select("page_id", "box_id")


def sides(s, d) -> tuple[DataFrame, DataFrame]:
    """Predictions and labels, from one reading of their table."""
    return relations(s, d, "boxes_pred", "boxes_gold")


def scores(s, d):
    """Counts of each page with labels."""
    n = spatial.match_counts(*sides(s, d)).where("golds > 0")
    held = n.selectExpr("page_id", "matched - matched_ignored AS tp", "preds - matched AS fp", "golds - ignored - matched + matched_ignored AS fn", "right AS right_state")
    return relation(s, d, "pages_meta").join(held, "page_id")


def rated(df):
    p, r = geo.ratio(F.col("tp"), F.col("tp") + F.col("fp")), geo.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = df.withColumns({"p": p, "r": r})
    return out.select(*df.columns, F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(geo.f1(F.col("p"), F.col("r")), 4).alias("f1"), F.round(geo.ratio(F.col("right_state"), F.col("tp")), 4).alias("cls_acc"))


RATED = """SELECT {c}, tp, fp, fn, right_state, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2*p*r/(p+r) ELSE 0 END, 4) AS f1, round(CASE WHEN tp > 0 THEN CAST(right_state AS DOUBLE)/tp ELSE 0 END, 4) AS cls_acc
FROM (SELECT *, CASE WHEN tp+fp > 0 THEN CAST(tp AS DOUBLE)/(tp+fp) ELSE 0 END AS p, CASE WHEN tp+fn > 0 THEN CAST(tp AS DOUBLE)/(tp+fn) ELSE 0 END AS r FROM {t})"""
SUMS = "sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(right_state)::BIGINT AS right_state"
COUNTS = ("tp", "fp", "fn", "right_state")


@query(SCORES + RATED.format(c="page_id", t="score"))
def page_scorecard(s, d):
    return rated(scores(s, d).select("page_id", *COUNTS))


@query(DEFAULT_SQL + SCORES + ", own AS (SELECT page_id, count(*) AS boxes, sum(CASE WHEN ignore THEN 1 ELSE 0 END) AS ignored FROM boxes_gold GROUP BY page_id), found AS (SELECT p.page_id, count(*) AS pred, sum(CASE WHEN reasons <> '' THEN 1 ELSE 0 END) AS ambiguous FROM boxes_pred p LEFT JOIN r ON r.page_id = p.page_id AND r.box_id = p.box_id GROUP BY p.page_id), t AS (SELECT page_id, CAST(boxes - ignored AS BIGINT) AS gold, CAST(ignored AS BIGINT) AS ignored, coalesce(pred, 0) AS pred, CAST(coalesce(ambiguous, 0) AS BIGINT) AS ambiguous, tp, fp, fn, right_state FROM score JOIN own USING (page_id) LEFT JOIN found USING (page_id)) " + RATED.format(c="page_id, gold, ignored, pred, ambiguous", t="t"))
def page_report(s, d):
    """The whole row of a page: labels that count and that don't, boxes found, those with reasons, and the scores."""
    p, g = sides(s, d)
    n = spatial.match_counts(p, g).where("golds > 0").selectExpr("page_id", "golds - ignored AS gold", "ignored", "preds AS pred", "matched - matched_ignored AS tp", "preds - matched AS fp", "golds - ignored - matched + matched_ignored AS fn", "right AS right_state")
    with as_dealt(s):
        flagged = spool(ruled(s, d, rules.DEFAULT).where(F.size("reasons") > 0).select("page_id", "box_id").join(p.select("page_id", "box_id"), ["page_id", "box_id"]).groupBy("page_id").agg(F.count("*").alias("ambiguous")))
    own = relation(s, d, "pages_meta").select("page_id").join(n, "page_id").join(flagged, "page_id", "left").na.fill(0, ["ambiguous"])
    return rated(own.select("page_id", "gold", "ignored", "pred", "ambiguous", *COUNTS))


@query(SCORES + f", t AS (SELECT 1 AS one, {SUMS} FROM score) " + RATED.format(c="one", t="t"))
def micro_average(s, d):
    return rated(scores(s, d).agg(F.lit(1).alias("one"), *[F.sum(c).alias(c) for c in COUNTS]))


@query(SCORES + f", t AS (SELECT factor, {SUMS} FROM score GROUP BY factor) " + RATED.format(c="factor", t="t"))
def factor_sweep(s, d):
    return rated(scores(s, d).groupBy("factor").agg(*[F.sum(c).alias(c) for c in COUNTS]))


@query(SCORES + f", t AS (SELECT factor, corpus, {SUMS} FROM score GROUP BY factor, corpus), x AS ({RATED.format(c='factor, corpus', t='t')}) SELECT factor, corpus, f1 FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY f1, corpus) AS k FROM x) WHERE k = 1")
def worst_by_factor(s, d):
    own = rated(scores(s, d).groupBy("factor", "corpus").agg(*[F.sum(c).alias(c) for c in COUNTS]))
    return own.groupBy("factor").agg(F.min(F.struct("f1", "corpus")).alias("w")).select("factor", "w.corpus", "w.f1")


CARDS = """, cards AS (SELECT page_id, box_id AS point_id, CAST(x1+x2 AS DOUBLE)/2 + pk%3 AS cx, CAST(y1+y2 AS DOUBLE)/2 AS cy, CASE q%4 WHEN 0 THEN 'empty' WHEN 1 THEN 'filled' WHEN 2 THEN 'unsure' ELSE 'not_a_checkbox' END AS label, pk%57 = 0 AS misclick, box_id = 7 AS synthetic, CASE WHEN sk%2 = 0 THEN 'hard-real' ELSE 'negative' END AS stratum FROM boxes_gold),
hit AS (SELECT c.*, p.box_id AS b_box_id, p.is_checked AS b_is_checked, row_number() OVER (PARTITION BY c.page_id, c.point_id ORDER BY p.y1, p.x1, p.box_id) AS k FROM cards c LEFT JOIN boxes_pred p ON p.page_id = c.page_id AND abs(c.cx - CAST(p.x1+p.x2 AS DOUBLE)/2) + abs(c.cy - CAST(p.y1+p.y2 AS DOUBLE)/2) < 18)
"""


def cards(s, d):
    cx, cy = geo.centre()
    label = F.expr("CASE q % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'filled' WHEN 2 THEN 'unsure' ELSE 'not_a_checkbox' END")
    return gold(s, d).select("page_id", F.col("box_id").alias("point_id"), (cx + F.col("pk") % 3).alias("cx"), cy.alias("cy"), label.alias("label"), (F.col("pk") % 57 == 0).alias("misclick"), (F.col("box_id") == 7).alias("synthetic"), F.expr("CASE WHEN sk % 2 = 0 THEN 'hard-real' ELSE 'negative' END").alias("stratum"))


HARD = "NOT synthetic AND NOT misclick AND label IN ('empty', 'filled')"


@query(CARDS + f"SELECT count(*) AS graded, sum(CASE WHEN b_is_checked = (label = 'filled') THEN 1 ELSE 0 END) AS correct, sum(CASE WHEN b_box_id IS NULL THEN 1 ELSE 0 END) AS missed, round(CAST(sum(CASE WHEN b_is_checked = (label = 'filled') THEN 1 ELSE 0 END) AS DOUBLE)/count(*), 4) AS accuracy FROM hit WHERE k = 1 AND {HARD}")
def gold_agreement(s, d):
    """Cards with a hard answer against the first box near them; no cards, no rate."""
    own = spatial.near(cards(s, d).where(HARD), pred(s, d), 18).agg(F.count("*").alias("graded"), F.expr("count_if(b_is_checked = (label = 'filled'))").alias("correct"), F.expr("count_if(b_box_id IS NULL)").alias("missed"))
    return own.withColumn("accuracy", F.when(F.col("graded") > 0, F.round(F.col("correct") / F.col("graded"), 4)))


@query(CARDS + f"SELECT page_id, point_id, label, b_box_id IS NOT NULL AS found FROM hit WHERE k = 1 AND {HARD} AND NOT coalesce(b_is_checked = (label = 'filled'), FALSE)")
def gold_misses(s, d):
    """The hard cards that the first box near them answers otherwise, or that no box is near."""
    own = spatial.near(cards(s, d).where(HARD), pred(s, d), 18)
    return own.where("NOT coalesce(b_is_checked = (label = 'filled'), false)").select("page_id", "point_id", "label", F.col("b_box_id").isNotNull().alias("found"))


@query(""", probe AS (SELECT page_id, box_id AS point_id, CAST(x1+x2 AS DOUBLE)/2 AS cx, CAST(y1+y2 AS DOUBLE)/2 AS cy, CASE sk%3 WHEN 0 THEN 'state' WHEN 1 THEN 'detected' ELSE 'absent' END AS chk, is_checked AS expect FROM boxes_gold),
h AS (SELECT c.*, p.box_id AS hit, p.is_checked AS st, row_number() OVER (PARTITION BY c.page_id, c.point_id ORDER BY p.y1, p.x1, p.box_id) AS k FROM probe c LEFT JOIN boxes_pred p ON p.page_id = c.page_id AND abs(c.cx - CAST(p.x1+p.x2 AS DOUBLE)/2) + abs(c.cy - CAST(p.y1+p.y2 AS DOUBLE)/2) < 18)
SELECT page_id, point_id, chk, CASE chk WHEN 'absent' THEN hit IS NULL WHEN 'detected' THEN hit IS NOT NULL ELSE coalesce(st = expect, FALSE) END AS passed FROM h WHERE k = 1""")
def regression_probe(s, d):
    cx, cy = geo.centre()
    probes = gold(s, d).select("page_id", F.col("box_id").alias("point_id"), cx.alias("cx"), cy.alias("cy"), F.expr("CASE sk % 3 WHEN 0 THEN 'state' WHEN 1 THEN 'detected' ELSE 'absent' END").alias("chk"), F.col("is_checked").alias("expect"))
    passed = F.expr("CASE chk WHEN 'absent' THEN b_box_id IS NULL WHEN 'detected' THEN b_box_id IS NOT NULL ELSE coalesce(b_is_checked = expect, false) END")
    return spatial.near(probes, pred(s, d), 18).select("page_id", "point_id", "chk", passed.alias("passed"))


@query(CARDS + ", near AS (SELECT c.page_id, c.point_id, CAST(p.box_id AS BIGINT) AS box_id, abs(c.cx - CAST(p.x1+p.x2 AS DOUBLE)/2) + abs(c.cy - CAST(p.y1+p.y2 AS DOUBLE)/2) AS far FROM cards c LEFT JOIN boxes_pred p ON p.page_id = c.page_id) SELECT page_id, point_id, CASE WHEN far <= 33 THEN box_id END AS box_id, far FROM (SELECT *, row_number() OVER (PARTITION BY page_id, point_id ORDER BY far, box_id) AS k FROM near) WHERE k = 1")
def nearest_candidate(s, d):
    return spatial.nearest(cards(s, d), pred(s, d), F.lit(33)).withColumn("box_id", F.col("box_id").cast("long"))


@query(CARDS + "SELECT stratum, sum(CASE WHEN label = 'empty' THEN 1 ELSE 0 END) AS empty, sum(CASE WHEN label = 'filled' THEN 1 ELSE 0 END) AS filled, sum(CASE WHEN label = 'not_a_checkbox' THEN 1 ELSE 0 END) AS not_a_checkbox, sum(CASE WHEN label = 'unsure' THEN 1 ELSE 0 END) AS unsure FROM cards GROUP BY stratum")
def stratum_pivot(s, d):
    return cards(s, d).groupBy("stratum").pivot("label", ["empty", "filled", "not_a_checkbox", "unsure"]).count().na.fill(0)


@query(CARDS + """, twice AS (SELECT page_id, point_id, cx, cy, label FROM cards UNION ALL SELECT page_id, box_id + 500, CAST(x1+x2 AS DOUBLE)/2 - 2, CAST(y1+y2 AS DOUBLE)/2 + 1, CASE (q+sk)%4 WHEN 0 THEN 'empty' WHEN 1 THEN 'filled' WHEN 2 THEN 'unsure' ELSE 'not_a_checkbox' END FROM boxes_gold WHERE sk%3 = 0),
f0 AS MATERIALIZED (SELECT g.page_id, g.box_id, c.point_id, c.label, abs(c.cx - CAST(g.x1+g.x2 AS DOUBLE)/2) + abs(c.cy - CAST(g.y1+g.y2 AS DOUBLE)/2) AS far FROM boxes_gold g JOIN twice c USING (page_id)),
f AS (SELECT page_id, box_id, max_by(label = 'filled', point_id) FILTER (label IN ('filled', 'empty')) AS st, max_by(label NOT IN ('filled', 'empty'), point_id) AS ig FROM f0 WHERE far <= 8 GROUP BY 1, 2)
SELECT g.page_id, g.box_id, coalesce(st, is_checked) AS is_checked, coalesce(ig, ignore) AS ignore FROM boxes_gold g LEFT JOIN f USING (page_id, box_id)""")
def fold_labels(s, d):
    """Fold card answers into labels: of the cards within 8 of a label the last decides; a state clears an ignored label."""
    mid = lambda a: F.expr(f"CAST({a}1 + {a}2 AS DOUBLE) / 2")
    again = gold(s, d).where("sk % 3 = 0").select("page_id", (F.col("box_id") + 500).alias("point_id"), (mid("x") - 2).alias("cx"), (mid("y") + 1).alias("cy"), F.expr("CASE (q + sk) % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'filled' WHEN 2 THEN 'unsure' ELSE 'not_a_checkbox' END").alias("label"))
    return spatial.folded(gold(s, d).select("page_id", *spatial.BOX, "ignore"), cards(s, d).select(*again.columns).unionByName(again), 8.0).select("page_id", "box_id", "is_checked", "ignore")


@query(""", fix AS (SELECT page_id, 2*(pk%5) AS nth, CAST(x1+x2 AS DOUBLE)/2 + pk%19 AS cx, CAST(y1+y2 AS DOUBLE)/2 - sk%17 AS cy, CASE WHEN pk%7 = 0 THEN 'drop' WHEN pk%5 < 3 THEN 'flip' END AS kind, sk%2 = 0 AS state FROM boxes_gold
 UNION ALL SELECT page_id, 2*(sk%5) + 1, CAST(x1+x2 AS DOUBLE)/2 + 3, CAST(y1+y2 AS DOUBLE)/2, 'flip', q%2 = 0 FROM boxes_gold WHERE pk%3 = 0),
h0 AS MATERIALIZED (SELECT p.page_id, p.box_id, f.kind, f.nth, f.state, greatest(abs(CAST(p.x1+p.x2 AS DOUBLE)/2 - f.cx), abs(CAST(p.y1+p.y2 AS DOUBLE)/2 - f.cy)) AS far FROM boxes_pred p JOIN (SELECT * FROM fix WHERE kind IS NOT NULL) f USING (page_id)),
hit AS (SELECT page_id, box_id, bool_or(kind = 'drop') AS gone, max_by(state, nth) FILTER (kind = 'flip') AS state FROM h0 WHERE far <= 14 GROUP BY 1, 2)
SELECT p.page_id, p.box_id, coalesce(h.state, p.is_checked) AS is_checked, FALSE AS ignore FROM boxes_pred p LEFT JOIN hit h USING (page_id, box_id) WHERE NOT coalesce(h.gone, FALSE)
UNION ALL SELECT page_id, box_id + 200, is_checked, FALSE FROM boxes_gold WHERE pk%107 = 0 UNION ALL SELECT page_id, box_id + 300, FALSE, TRUE FROM boxes_gold WHERE pk%109 = 0""")
def seed_corrections(s, d):
    """Drop, then flip every box within 14 pixels of a correction on both axes (the last flip decides), then add and ignore rows."""
    (p, g), (cx, cy) = sides(s, d), geo.centre()
    fix = g.select("page_id", (2 * (F.col("pk") % 5)).alias("at"), (cx + F.col("pk") % 19).alias("cx"), (cy - F.col("sk") % 17).alias("cy"), F.expr("CASE WHEN pk % 7 = 0 THEN 'drop' WHEN pk % 5 < 3 THEN 'flip' END").alias("kind"), (F.col("sk") % 2 == 0).alias("state"))
    more = g.where("pk % 3 = 0").select("page_id", (2 * (F.col("sk") % 5) + 1).alias("at"), (cx + 3).alias("cx"), cy.alias("cy"), F.lit("flip").alias("kind"), (F.col("q") % 2 == 0).alias("state"))
    kept = spatial.corrected(p, fix.where("kind IS NOT NULL").unionByName(more), 14.0).select("page_id", "box_id", "is_checked", F.lit(False).alias("ignore"))
    add = g.where("pk % 107 = 0").select("page_id", (F.col("box_id") + 200).alias("box_id"), "is_checked", F.lit(False).alias("ignore"))
    return kept.unionByName(add).unionByName(g.where("pk % 109 = 0").select("page_id", (F.col("box_id") + 300).alias("box_id"), F.lit(False).alias("is_checked"), F.lit(True).alias("ignore")))


@query("SELECT p.page_id, p.box_id FROM boxes_pred p ANTI JOIN (SELECT * FROM boxes_gold WHERE pk%19 = 0) c ON c.page_id = p.page_id AND (c.x1+c.x2)//16 = (p.x1+p.x2)//16 AND (c.y1+c.y2)//16 = (p.y1+p.y2)//16")
def leakage_anti_join(s, d):
    """Training boxes that share no grid cell with a held-out label; every 19th part number is held out."""
    cell = [F.floor((F.col("x1") + F.col("x2")) / 16).alias("gx"), F.floor((F.col("y1") + F.col("y2")) / 16).alias("gy")]
    held = gold(s, d).where("pk % 19 = 0").select("page_id", *cell).distinct()
    return pred(s, d).select("page_id", "box_id", *cell).join(held, ["page_id", "gx", "gy"], "left_anti").select("page_id", "box_id")


TELEMETRY = DEFAULT_SQL + ", x AS (SELECT r.*, corpus, factor FROM r JOIN pages_meta USING (page_id)) "
FLAGS = "count(*) AS boxes, sum(CASE WHEN reasons <> '' THEN 1 ELSE 0 END) AS flagged, round(CAST(sum(CASE WHEN reasons <> '' THEN 1 ELSE 0 END) AS DOUBLE)/count(*), 4) AS flag_rate"


def told(s, d):
    return ruled(s, d, rules.DEFAULT).join(relation(s, d, "pages_meta"), "page_id")


def flags(df, *by):
    return df.groupBy(*by).agg(F.count("*").alias("boxes"), F.expr("count_if(size(reasons) > 0)").alias("flagged")).withColumn("flag_rate", F.round(F.col("flagged") / F.col("boxes"), 4))


@query(TELEMETRY + "SELECT page_id, count(*) AS boxes, sum(CASE WHEN is_checked THEN 1 ELSE 0 END) AS checked, sum(CASE WHEN reasons <> '' THEN 1 ELSE 0 END) AS flagged FROM x GROUP BY page_id")
def telemetry_pages(s, d):
    return told(s, d).groupBy("page_id").agg(F.count("*").alias("boxes"), F.expr("count_if(is_checked)").alias("checked"), F.count_if(rules.routed(F.col("reasons"))).alias("flagged"))


@query(TELEMETRY + f"SELECT {FLAGS} FROM x")
def telemetry_totals(s, d):
    return flags(told(s, d))


@query(TELEMETRY + "SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, '|')) AS reason FROM x WHERE reasons <> '') GROUP BY reason")
def reason_histogram(s, d):
    return told(s, d).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(TELEMETRY + "SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, '|')) AS reason FROM x WHERE reasons <> '') GROUP BY reason ORDER BY n DESC, reason LIMIT 2")
def top_reasons(s, d):
    return reason_histogram(s, d).orderBy(F.desc("n"), "reason").limit(2)


@query(TELEMETRY + f"SELECT corpus, {FLAGS} FROM x GROUP BY corpus")
def flag_rate_by_corpus(s, d):
    return flags(told(s, d), "corpus")


@query(TELEMETRY + f"SELECT factor, {FLAGS} FROM x GROUP BY factor")
def flag_rate_by_factor(s, d):
    return flags(told(s, d), "factor")


@query("SELECT sum(CASE WHEN q%3 = 0 AND ink < 0.1 THEN 1 ELSE 0 END) AS filled_below, sum(CASE WHEN q%3 <> 0 AND ink >= 0.1 THEN 1 ELSE 0 END) AS empty_above FROM features")
def threshold_crossings(s, d):
    return relation(s, d, "features").agg(F.expr("count_if(q % 3 = 0 AND ink < 0.1D)").alias("filled_below"), F.expr("count_if(q % 3 <> 0 AND ink >= 0.1D)").alias("empty_above"))


@query("SELECT event_type, list_sort(list(value))[least(count(*) - 1, CAST(floor(count(*)*0.95) AS BIGINT)) + 1] AS p95_telemetry, list_sort(list(value))[greatest(CAST(floor(count(*)*0.95) AS BIGINT) - 1, 0) + 1] AS p95_bench FROM events GROUP BY event_type")
def p95_two_ways(s, d):
    """Two order-statistic definitions of the 95th percentile, from counts by value: no group is sorted in one task."""
    at = F.floor(F.col("n") * 0.95)
    return ranks.order_statistics(read(s, d, "events"), "event_type", "value", {"p95_telemetry": F.least(F.col("n") - 1, at) + 1, "p95_bench": F.greatest(at - 1, F.lit(0)) + 1})


@query("SELECT page_id, CAST(median(tok) AS DOUBLE) AS median_tokens, min(tok) AS least, max(tok) AS most FROM (SELECT page_id, CAST(ceil(5*(x2-x1)/28.0)*ceil(5*(y2-y1)/28.0) AS BIGINT) AS tok FROM boxes_gold) GROUP BY page_id")
def token_cost(s, d):
    own = gold(s, d).select("page_id", geo.image_tokens(5 * (F.col("x2") - F.col("x1")), 5 * (F.col("y2") - F.col("y1"))).alias("tok"))
    return own.groupBy("page_id").agg(F.median("tok").cast("double").alias("median_tokens"), F.min("tok").alias("least"), F.max("tok").alias("most"))


@query(DEFAULT_SQL + PAIRS + """, k AS (SELECT p.page_id, p.box_id, 'phantom' AS kind FROM boxes_pred p ANTI JOIN m ON m.page_id = p.page_id AND m.p_box_id = p.box_id
UNION ALL SELECT g.page_id, g.box_id, 'missed' FROM (SELECT * FROM boxes_gold WHERE NOT ignore) g ANTI JOIN m ON m.page_id = g.page_id AND m.g_box_id = g.box_id
UNION ALL SELECT m.page_id, p_box_id, CASE WHEN p_state <> g_state THEN 'state' ELSE 'ambiguous' END FROM m JOIN r ON r.page_id = m.page_id AND r.box_id = m.p_box_id WHERE NOT g_ignore AND (p_state <> g_state OR reasons <> ''))
SELECT kind, page_id, box_id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY (page_id*7919 + box_id*104729)%1000003, page_id, box_id) AS r FROM k) WHERE r <= 12""")
def edge_mining(s, d):
    """Twelve boxes of each kind of failure, chosen by an integer hash; a box that is right, with reasons, is ambiguous."""
    p, g = sides(s, d)
    m = spatial.greedy_match(spatial.candidates(p, g))
    lost = [unmatched(df, m, side).select("page_id", "box_id", F.lit(kind).alias("kind")) for df, side, kind in ((p, "p", "phantom"), (g.where("NOT ignore"), "g", "missed"))]
    told = flat(ruled(s, d, rules.DEFAULT)).select("page_id", F.col("box_id").alias("p_box_id"), "reasons")
    wrong = F.col("p_is_checked") != F.col("g_is_checked")
    seen = m.where("NOT g_ignore").join(told, ["page_id", "p_box_id"]).where(wrong | (F.col("reasons") != ""))
    kinds = lost[0].unionByName(lost[1]).unionByName(seen.select("page_id", F.col("p_box_id").alias("box_id"), F.when(wrong, "state").otherwise("ambiguous").alias("kind")))
    order = W.partitionBy("kind").orderBy((F.col("page_id") * 7919 + F.col("box_id") * 104729) % 1000003, "page_id", "box_id")
    return kinds.withColumn("r", F.row_number().over(order)).where("r <= 12").select("kind", "page_id", "box_id")


@query("SELECT page_id, box_id, 'c' || lpad(CAST(row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, box_id) AS VARCHAR), 3, '0') AS card FROM boxes_pred")
def reading_order_ids(s, d):
    return pred(s, d).select("page_id", "box_id", F.format_string("c%03d", F.row_number().over(W.partitionBy("page_id").orderBy("y1", "x1", "box_id"))).alias("card"))


@query("SELECT event_id, last_value(CASE WHEN event_id%3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def carry_last(s, d):
    seen = F.when(F.col("event_id") % 3 == 0, F.col("value"))
    return read(s, d, "events").select("event_id", F.last(seen, ignorenulls=True).over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)).alias("carried"))


@query(", v AS (SELECT page_id, box_id, CAST(2*y1 - 5 AS DOUBLE) AS v FROM boxes_gold) SELECT page_id, box_id, CASE WHEN v <= 0 THEN 5.0 + v*(30.0/1.0) WHEN v < 0.5 THEN 5.0 + v*30.0/0.5 WHEN v < 60 THEN 35.0 + (v - 0.5)*30.0/59.5 WHEN v < 60.25 THEN 65.0 + (v - 60)*5.0/0.25 ELSE 70.0 + (v - 60.25)*(5.0/1.0) END AS y FROM v")
def piecewise_map(s, d):
    knots = F.array(*[F.struct(F.lit(a).alias("ty"), F.lit(b).alias("py")) for a, b in ((0.0, 5.0), (0.5, 35.0), (60.0, 65.0), (60.25, 70.0))])
    return gold(s, d).select("page_id", "box_id", geo.piecewise(knots, (2 * F.col("y1") - 5).cast("double")).alias("y"))


@query("SELECT box_id%2 AS row_id, round(regr_slope(CAST(y1 AS DOUBLE), CAST(x1 AS DOUBLE)), 6) AS slope, round(regr_intercept(CAST(y1 AS DOUBLE), CAST(x1 AS DOUBLE)), 6) AS at_zero FROM boxes_gold GROUP BY box_id%2")
def row_fit(s, d):
    return gold(s, d).groupBy((F.col("box_id") % 2).alias("row_id")).agg(F.round(F.regr_slope(F.col("y1").cast("double"), F.col("x1").cast("double")), 6).alias("slope"), F.round(F.regr_intercept(F.col("y1").cast("double"), F.col("x1").cast("double")), 6).alias("at_zero"))


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS DOUBLE)/64 AS ink FROM embeddings")
def grid_ink_fraction(s, d):
    return read(s, d, "embeddings").select("vec_id", (F.size(F.filter("embedding", lambda x: x > 0)).cast("double") / 64).alias("ink"))


@query("SELECT vec_id, r AS row_id, CAST(len(list_filter(embedding[r*8+1:r*8+8], lambda x: x > 0)) AS BIGINT) AS ink FROM embeddings, (SELECT unnest(range(0, 8)) AS r)")
def grid_row_profile(s, d):
    own = read(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "x"))
    return own.groupBy("vec_id", F.floor(F.col("at") / 8).alias("row_id")).agg(F.expr("count_if(x > 0)").alias("ink"))


@query("SELECT page_id, box_id, CAST(trunc(x1*0.75) AS INT) AS x1, CAST(trunc(y1*0.75) AS INT) AS y1, CAST(trunc(x2*0.75) AS INT) AS x2, CAST(trunc(y2*0.75) AS INT) AS y2 FROM boxes_gold")
def scale_labels(s, d):
    return gold(s, d).select("page_id", "box_id", *[(F.col(c) * F.lit(0.75)).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(", c AS (SELECT page_id, box_id, x1*0.8 - y1*0.6 AS a, x2*0.8 - y1*0.6 AS b, x1*0.8 - y2*0.6 AS c, x2*0.8 - y2*0.6 AS e, x1*0.6 + y1*0.8 AS f, x2*0.6 + y1*0.8 AS g, x1*0.6 + y2*0.8 AS h, x2*0.6 + y2*0.8 AS i FROM boxes_gold) SELECT page_id, box_id, CAST(trunc(least(a,b,c,e) + 1e-6) AS INT) AS x1, CAST(trunc(least(f,g,h,i) + 1e-6) AS INT) AS y1, CAST(ceil(greatest(a,b,c,e) - 1e-6) AS BIGINT) AS x2, CAST(ceil(greatest(f,g,h,i) - 1e-6) AS BIGINT) AS y2 FROM c")
def rotate_labels(s, d):
    """Upright bounds of boxes turned by the angle with cosine 0.8 and sine 0.6."""
    co, si, eps = F.lit(0.8), F.lit(0.6), F.lit(1e-6)
    xs = [F.col(x) * co - F.col(y) * si for x in ("x1", "x2") for y in ("y1", "y2")]
    ys = [F.col(x) * si + F.col(y) * co for x in ("x1", "x2") for y in ("y1", "y2")]
    return gold(s, d).select("page_id", "box_id", (F.least(*xs) + eps).cast("int").alias("x1"), (F.least(*ys) + eps).cast("int").alias("y1"), F.ceil(F.greatest(*xs) - eps).alias("x2"), F.ceil(F.greatest(*ys) - eps).alias("y2"))


ONE_BY_ONE = """, o AS MATERIALIZED (SELECT *, CAST(x1+x2 AS DOUBLE)/2 AS mx, CAST(y1+y2 AS DOUBLE)/2 AS my FROM boxes_pred),
q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS k FROM o), """


@query(ONE_BY_ONE.format(order="box_id") + """w AS (SELECT page_id, k, [{'b': box_id, 'x': mx, 'y': my}] AS kept FROM q WHERE k = 1
UNION ALL SELECT q.page_id, q.k, CASE WHEN len(list_filter(w.kept, lambda e: abs(e.x - q.mx) + abs(e.y - q.my) <= 40)) = 0 THEN list_append(w.kept, {'b': q.box_id, 'x': q.mx, 'y': q.my}) ELSE w.kept END FROM w JOIN q ON q.page_id = w.page_id AND q.k = w.k + 1),
z AS (SELECT page_id, unnest(kept).b AS box_id FROM w WHERE (page_id, k) IN (SELECT page_id, max(k) FROM q GROUP BY page_id))
SELECT page_id, box_id, x1, y1, x2, y2 FROM z JOIN boxes_pred USING (page_id, box_id)""")
def dedupe_greedy(s, d):
    return spatial.dedupe(pred(s, d).select("page_id", "box_id", "x1", "y1", "x2", "y2"), 40.0)


@query(ONE_BY_ONE.format(order="my, x1, box_id") + """w AS (SELECT page_id, k, box_id, my AS anchor, 0 AS row_id FROM q WHERE k = 1
UNION ALL SELECT q.page_id, q.k, q.box_id, CASE WHEN abs(q.my - w.anchor) >= 20 THEN q.my ELSE w.anchor END, CASE WHEN abs(q.my - w.anchor) >= 20 THEN w.row_id + 1 ELSE w.row_id END FROM w JOIN q ON q.page_id = w.page_id AND q.k = w.k + 1)
SELECT page_id, box_id, x1, y1, x2, y2, row_id FROM w JOIN boxes_pred USING (page_id, box_id)""")
def row_cluster(s, d):
    return spatial.row_clusters(pred(s, d).select("page_id", "box_id", "x1", "y1", "x2", "y2"), 20.0)


@query()
def witness_merge(s, d):
    """The label boxes as a form of two rows a page, against the predictions; added boxes have no box_id."""
    knots = F.array(*[F.struct(F.lit(float(y)).alias("ty"), F.lit(float(y)).alias("py")) for y in (0, 40, 80)])
    regs = gold(s, d).select("page_id").distinct().select("page_id", F.lit("f").alias("form"), F.lit(24).alias("side"), knots.alias("knots"))
    boxes = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), (60 * i, 40 * (i % 2), 60 * i + 24, 40 * (i % 2) + 24), strict=True)]) for i in range(1, 8)])
    forms = s.range(1).select(F.lit("f").alias("form"), boxes.alias("boxes"))
    found = pred(s, d).select("page_id", *[F.col(c).cast("int").alias(c) for c in ("box_id", "x1", "y1", "x2", "y2")])
    out = placement.place(found, regs, forms)
    return out.select("page_id", "box_id", "x1", "y1", "x2", "y2", F.array_join("witnesses", "|").alias("witnesses"), F.array_join("reasons", "|").alias("reasons"), F.col("stats.agree").alias("agree"), F.col("stats.trusted").alias("trusted"))
