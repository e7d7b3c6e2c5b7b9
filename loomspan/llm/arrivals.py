"""Order of arrival of crawl batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In so many arrivals the queries over a whole table hand its batches to an operator that keeps state.
ARRIVALS = 3
#: The number of batches that aren't listed, or have no number: they come after all others.
LAST = 1 << 62


def numbered(rows: DataFrame, batches: DataFrame, arrivals: int = ARRIVALS) -> DataFrame:
    """``rows`` with seq (the number of their batch) and arrival (from 0): consecutive batches, about as many in each.

    ``batches``: crawl_batch_id, batch_seq. A batch listed twice has its smaller number.
    """
    seq = batches.where(F.col("crawl_batch_id").isNotNull()).groupBy("crawl_batch_id").agg(F.min("batch_seq").cast("long").alias("seq"))
    cuts = seq.agg(F.percentile_approx("seq", [k / arrivals for k in range(1, arrivals)], 10_000)).first()[0] or []
    out = rows.join(seq, "crawl_batch_id", "left").withColumn("seq", F.coalesce("seq", F.lit(LAST)))
    return out.withColumn("arrival", sum(((F.col("seq") > c).cast("int") for c in sorted(set(cuts))), F.lit(0)))
