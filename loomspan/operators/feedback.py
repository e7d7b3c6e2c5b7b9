"""Feedback records: events folded into one record a message, review and improvement states, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.sessions import citations, cut, one_of

# Lengths and states of a record.
LENGTHS = {"question": 6_000, "answer": 12_000, "comment": 4_000, "reviewer_note": 4_000, "improvement_plan": 6_000}
REVIEW, PIPELINE = ("new", "reviewing", "resolved"), ("none", "queued", "drafted", "applied")
# Fixed values end.


def _newest(value: Column, order: Column) -> Column:
    """The newest value that isn't empty; empty if there is none."""
    return F.coalesce(F.max_by(value, F.when(value != "", order)), F.lit(""))


def folded(events: DataFrame, keys: list[str], at: str = "created_at", tie: str = "event_id") -> DataFrame:
    """One record for ``keys``, as if each event had been put in over the record before it.

    Texts (question, answer, comment) of an event replace older ones unless they are empty; a rating that isn't
    ``up`` is ``down``; citations (array of title and url) are the newest ones that aren't null; created is the first
    time and updated the last. A negative record with a comment is queued for improvement. Events are aggregated
    before the shuffle, so a hot record is no hot task. Null keys are one group; repeated events count once.
    """
    order = F.struct(at, tie)
    texts = [_newest(cut(F.col(c), LENGTHS[c]), order).alias(c) for c in ("question", "answer", "comment")]
    out = events.groupBy(*keys).agg(
        F.max_by("rating", F.when(F.col("rating").isNotNull(), order)).alias("_r"), *texts, F.max_by("citations", F.when(F.col("citations").isNotNull(), order)).alias("_c"), F.min(at).alias("created_at"), F.max(at).alias("updated_at"), F.count_distinct(tie).alias("n_events")
    )
    out = out.withColumn("rating", F.when(F.col("_r") == "up", "up").otherwise("down")).withColumn("citations", citations(F.coalesce("_c", F.array().cast("array<struct<title:string,url:string>>"))))
    queued = (F.col("rating") == "down") & (F.trim("comment") != "")
    return out.drop("_r", "_c").withColumn("review_status", F.lit("new")).withColumn("pipeline_status", F.when(queued, "queued").otherwise("none"))


def patched(records: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Records after patches (``key``, review_status, reviewer_note, pipeline_status, improvement_plan; one a key): a state
    that isn't known, and an empty text, leave what was there."""
    rules = {"review_status": one_of(F.col("review_status"), REVIEW), "pipeline_status": one_of(F.col("pipeline_status"), PIPELINE)}
    rules |= {c: F.nullif(cut(F.col(c), LENGTHS[c]), F.lit("")) for c in ("reviewer_note", "improvement_plan")}
    new = patches.select(F.col(key).alias("_k"), *[r.alias(f"_{c}") for c, r in rules.items()])
    joined = records.join(new, F.col(key) == F.col("_k"), "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in rules else F.col(c) for c in records.columns])


def drafted(records: DataFrame, plan: Column) -> DataFrame:
    """Records with an improvement plan drafted: a new one is under review now."""
    return records.withColumns({"review_status": F.when(F.col("review_status") == "new", "reviewing").otherwise(F.col("review_status")), "pipeline_status": F.lit("drafted"), "improvement_plan": cut(plan, LENGTHS["improvement_plan"])})


def counts(records: DataFrame) -> DataFrame:
    """One row: total, up, down, down_rate (percent, halves up), new, queued, drafted."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    out = records.agg(F.count("*").alias("total"), n("rating", "up").alias("up"), n("rating", "down").alias("down"), n("review_status", "new").alias("new"), n("pipeline_status", "queued").alias("queued"), n("pipeline_status", "drafted").alias("drafted"))
    return out.withColumn("down_rate", F.coalesce(F.floor(F.try_divide(100.0 * F.col("down"), F.col("total")) + 0.5), F.lit(0)).cast("long"))
