"""The marking-policy rule engine: ink features and a policy in, state, confidence and reason codes out.

Policies are rows, so several are applied in one scan by a join with their small table.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULINGS = ("filled", "empty", "route")
#: The reason codes that send a box to review.
ROUTED = ("INK_AMBIGUOUS", "FRAGMENTED_MARK", "STRAY_STROKE", "THIN_MARK", "CLASSIFIER_DISAGREE", "MISSING_IN_DETECT", "EXTRA_BOX")


@dataclass(frozen=True)
class Policy:
    """A customer's thresholds and rulings; the defaults are fixed values."""

    name: str = "default"
    ink_filled: float = 0.10
    ambiguous_low: float = 0.05
    ambiguous_high: float = 0.20
    confidence_scale: float = 0.04
    clear_mark_span: float = 0.45
    clear_mark_dominance: float = 0.60
    clear_mark_ink: float = 0.06
    thin_mark_span: float = 0.55
    thin_mark_ink: float = 0.02
    stray_outside: float = 0.50
    fragment_components: int = 4
    fragment_largest: float = 0.08
    fragment_ink_ceiling: float = 0.50
    thin_single_stroke: str = "filled"
    stray_stroke_through_box: str = "empty"
    scribbled_or_fragmented: str = "empty"

    def checked(self) -> Policy:
        """Self, or ValueError for an unknown ruling or a threshold outside its band."""
        for ruling in (self.thin_single_stroke, self.stray_stroke_through_box, self.scribbled_or_fragmented):
            if ruling not in RULINGS:
                raise ValueError(f"{self.name}: {ruling!r} is no ruling; one of {', '.join(RULINGS)} is")
        if not self.ambiguous_low <= self.ink_filled <= self.ambiguous_high:
            raise ValueError(f"{self.name}: ink_filled lies outside the ambiguous band")
        return self


DEFAULT = Policy()
STRICT = replace(DEFAULT, name="strict", ambiguous_low=0.03, ambiguous_high=0.30, thin_single_stroke="route", scribbled_or_fragmented="route")


def policy_from(data: dict, name: str = "default") -> Policy:
    """A policy from a mapping; keys that start with _ are notes, any other unknown key is an error."""
    known = {f.name for f in fields(Policy)}
    own = {k: v for k, v in data.items() if not k.startswith("_")}
    if odd := sorted(set(own) - known):
        raise ValueError(f"unknown policy keys: {', '.join(odd)}")
    return Policy(**({"name": name} | own)).checked()


def policies(spark: SparkSession, *rows: Policy) -> DataFrame:
    """A table of a few policies; its columns start with p_."""
    return spark.createDataFrame([{f"p_{k}": float(v) if isinstance(v, int) and k != "name" else v for k, v in asdict(p.checked()).items()} for p in rows or (DEFAULT,)])


def ruled(checked: Column, ruling: Column) -> Column:
    return F.when(ruling == "filled", True).when(ruling == "empty", False).otherwise(checked)


def classify(features: DataFrame, policy_rows: DataFrame) -> DataFrame:
    """features (ink, n, largest, span, outside, ...) under every policy: is_checked, confidence, reasons.

    Steps follow each other, so a later rule sees the state that an earlier one has set. Reasons that a box brings
    (from a witness) stay before those found here; its ink is given with four digits.
    """
    p = lambda name: F.col(f"p_{name}")
    ink, span, outside = F.col("ink"), F.col("span"), F.col("outside")
    none = F.array().cast("array<string>")
    sure = 1 / (1 + F.exp(-(ink - p("ink_filled")) / p("confidence_scale")))
    out = features.crossJoin(F.broadcast(policy_rows)).withColumns({
        "is_checked": ink > p("ink_filled"),
        "confidence": F.round(F.abs(sure - 0.5) * 2, 4),
        "reasons": F.coalesce(F.col("reasons"), none) if "reasons" in features.columns else none,
        "_dominance": F.when(ink > 1e-6, F.col("largest") / ink).otherwise(0.0),
    })

    def step(df: DataFrame, when: Column, reason: str | None, checked: Column | None, confidence: Column | None) -> DataFrame:
        df = df.withColumn("_hit", when)
        change = {}
        if reason:
            change["reasons"] = F.when(F.col("_hit"), F.concat("reasons", F.array(F.lit(reason)))).otherwise(F.col("reasons"))
        if checked is not None:
            change["is_checked"] = F.when(F.col("_hit"), checked).otherwise(F.col("is_checked"))
        if confidence is not None:
            change["confidence"] = F.when(F.col("_hit"), confidence).otherwise(F.col("confidence"))
        return df.withColumns(change)

    now, conf = F.col("is_checked"), F.col("confidence")
    clear = (span >= p("clear_mark_span")) & (F.col("_dominance") >= p("clear_mark_dominance")) & (ink > p("clear_mark_ink")) & (outside <= p("stray_outside"))
    out = out.withColumn("_clear", clear)
    out = step(out, F.col("_clear"), None, F.lit(True), F.greatest(conf, F.lit(0.9)))
    out = step(out, ~F.col("_clear") & ink.between(p("ambiguous_low"), p("ambiguous_high")), "INK_AMBIGUOUS", None, None)
    out = step(out, now & (F.col("n") >= p("fragment_components")) & (F.col("largest") < p("fragment_largest")) & (ink < p("fragment_ink_ceiling")), "FRAGMENTED_MARK", ruled(now, p("scribbled_or_fragmented")), F.least(conf, F.lit(0.3)))
    out = out.withColumn("_thin", ~now & (span >= p("thin_mark_span")) & (ink > p("thin_mark_ink")))
    out = step(out, F.col("_thin") & (outside > p("stray_outside")), "STRAY_STROKE", ruled(now, p("stray_stroke_through_box")), None)
    out = step(out, F.col("_thin") & (outside <= p("stray_outside")), "THIN_MARK", ruled(now, p("thin_single_stroke")), F.when(p("thin_single_stroke") == "filled", F.least(F.lit(0.75), F.round(span, 2))).otherwise(F.least(conf, F.lit(0.4))))
    out = step(out, now & (outside > p("stray_outside")) & (ink < p("fragment_ink_ceiling")), "STRAY_STROKE", ruled(now, p("stray_stroke_through_box")), F.least(conf, F.lit(0.4)))
    keep = [F.round("ink", 4).alias("ink") if c == "ink" else c for c in features.columns if c not in ("is_checked", "confidence", "reasons")]
    return out.select(*keep, F.col("p_name").alias("policy"), "is_checked", "confidence", "reasons")


def routed(reasons: Column) -> Column:
    return F.arrays_overlap(reasons, F.array(*[F.lit(r) for r in ROUTED]))


def second_opinion(boxes: DataFrame, p: str = "p") -> DataFrame:
    """Merge a classifier's probability: agreement lifts the confidence, disagreement adds a reason; the state stays."""
    agree = (F.col(p) > 0.5) == F.col("is_checked")
    lift = F.greatest("confidence", F.least(F.lit(0.98), 0.5 + F.abs(F.col(p) - 0.5)))
    return boxes.withColumn("_agree", agree).withColumns({
        "confidence": F.round(F.when(F.col("_agree"), lift).otherwise(F.least("confidence", F.lit(0.4))), 4),
        "reasons": F.when(F.col("_agree"), F.col("reasons")).otherwise(F.concat("reasons", F.array(F.lit("CLASSIFIER_DISAGREE")))),
    }).drop("_agree")


def replay(boxes: DataFrame, votes: DataFrame) -> DataFrame:
    """Apply recorded verdicts (key, v_is_checkbox, v_filled, route, v_confidence) to routed boxes; others stay as they are."""
    out = boxes.join(votes, "key", "left").withColumn("_use", routed(F.col("reasons")) & F.col("route").isNotNull())
    not_box = F.col("_use") & ~F.col("v_is_checkbox")
    settled = F.col("_use") & F.col("v_is_checkbox") & F.col("route").isin("VLM_AGREE", "JUDGED") & F.col("v_filled").isNotNull()
    return out.withColumns({"_no": not_box, "_set": settled}).withColumns({
        "is_checked": F.when(F.col("_set"), F.col("v_filled")).otherwise(F.col("is_checked")),
        "confidence": F.when(F.col("_no"), F.least("confidence", F.lit(0.3))).when(F.col("_set"), F.greatest("confidence", "v_confidence")).otherwise(F.col("confidence")),
        "reasons": F.when(F.col("_no"), F.concat("reasons", F.array(F.lit("NOT_A_CHECKBOX"), F.col("route")))).when(F.col("_use"), F.concat("reasons", F.array("route"))).otherwise(F.col("reasons")),
    }).drop("_use", "_no", "_set", "route", "v_is_checkbox", "v_filled", "v_confidence")


def upsert(record: DataFrame, decisions: DataFrame, *key: str) -> DataFrame:
    """A record with decisions in the place of entries of the same key."""
    return decisions.unionByName(record.join(decisions, list(key), "left_anti"))
