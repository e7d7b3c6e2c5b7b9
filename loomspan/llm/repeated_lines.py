"""Problem 4: lines repeated across the documents of one source, by incremental line-count tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.partitions import spread
from loomspan.functions.shared import written
from loomspan.sources.versions import Versions

MIN_DOCS, MIN_SHARE = 5, 0.05
_SPACE = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_LINE = ["source_name", "h1", "h2"]


def line_key(line: Column) -> Column:
    """Whitespace runs made one space and trimmed, lower case, each run of 0-9 made ``#``."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, _SPACE, " "))), "[0-9]+", "#")


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")


def line_rows(df: DataFrame, *more: str) -> DataFrame:
    """(source_name, document_id, ``more``, line_no, line_key) of every line with a letter; rows with a null source have none."""
    lines = df.where(F.col("source_name").isNotNull() & F.col("document_id").isNotNull()).select("source_name", "document_id", *more, F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    return lines.select("source_name", "document_id", *more, "line_no", line_key(F.col("line")).alias("line_key")).where(F.col("line_key").rlike(r"\p{L}"))


def line_delta(df: DataFrame, *more: str) -> DataFrame:
    """What new rows add to the state: (``more``, source_name, h1, h2, d, line_no), once for each source, line and document.

    h1 and h2 are hashes of the line's key, d one of the document_id; line_no is a place in one of its contents
    where the line stands. A document without a line has one row with null h1, h2 and line_no: it counts as well.
    """
    df = spread(df.select("source_name", "document_id", "content", *more))
    lines = line_rows(df, *more).select(*more, "source_name", *_hashes(F.col("line_key")), F.xxhash64("document_id").alias("d"), "line_no")
    docs = df.where(F.col("source_name").isNotNull() & F.col("document_id").isNotNull()).select(*more, "source_name", F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), F.xxhash64("document_id").alias("d"), F.lit(None).cast("int").alias("line_no"))
    return lines.unionByName(docs).groupBy(*more, *_LINE, "d").agg(F.min("line_no").alias("line_no"))


class LineCounts:
    """The state of all sources in a folder: members (source, line, document), and counts of documents for each line.

    ``take`` joins the delta of new rows with narrow hash tables only; no text that was taken before is read. The
    state is kept by :class:`Versions`: a new object on the folder goes on with it.
    """

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, most_parts: int = 16) -> None:
        self.state, self.min_docs, self.min_share, self.most_parts = Versions(spark, folder), min_docs, min_share, most_parts

    def take(self, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Merges a delta (:func:`line_delta`); returns the lines (source_name, h1, h2) that newly crossed the
        thresholds, and those that fell below them because their source grew."""
        before = self.crossed()
        members, wanted = self.state.table("members"), delta.select(*_LINE, "d", "line_no")
        if members is not None:
            same = [F.col(f"n.{c}").eqNullSafe(F.col(f"m.{c}")) for c in (*_LINE, "d")]
            wanted = wanted.alias("n").join(members.alias("m"), same, "left_anti")
        added = self.state.put("members", wanted)
        # partial sums are made before the shuffle, so a hot line is no hot task
        self.state.put("counts", added.groupBy(*_LINE).agg(F.count("*").alias("n_docs"), F.min(F.struct("d", "line_no")).alias("example")))
        self.state.commit()
        if len(self.state.parts("counts")) > self.most_parts:
            self.compact()
        after = self.crossed()
        if before is None:
            return after.select(*_LINE), after.select(*_LINE).limit(0)
        return after.join(before, _LINE, "left_anti").select(*_LINE), before.join(after, _LINE, "left_anti").select(*_LINE)

    def counts(self) -> DataFrame | None:
        """(source_name, h1, h2, n_docs, example); the row with null h1 and h2 counts the source's documents."""
        held = self.state.table("counts")
        return held if held is None else held.groupBy(*_LINE).agg(F.sum("n_docs").alias("n_docs"), F.min("example").alias("example"))

    def crossed(self) -> DataFrame | None:
        """Lines over both thresholds: (source_name, h1, h2, n_docs, n_source_docs, example)."""
        counts = self.counts()
        if counts is None:
            return None
        totals = counts.where("h1 IS NULL").select("source_name", F.col("n_docs").alias("n_source_docs"))
        return counts.where((F.col("n_docs") >= self.min_docs) & F.col("h1").isNotNull()).join(totals, "source_name").where(F.col("n_docs") >= F.ceil(F.round(F.col("n_source_docs") * self.min_share, 6)))

    def holders(self, lines: DataFrame) -> DataFrame:
        """(source_name, d) of the documents that hold one of some lines."""
        return self.state.table("members").join(lines.select(*_LINE), _LINE, "left_semi").select("source_name", "d").distinct()

    def compact(self) -> None:
        """Merges the parts of each table into one."""
        self.state.put("members", self.state.table("members"), replace=True)
        self.state.put("counts", self.counts(), replace=True)
        self.state.commit()


def spell_out(df: DataFrame, lines: DataFrame) -> DataFrame:
    """Crossed lines with their text: (source_name, line_key, n_docs, n_source_docs).

    Each line is looked up at its example, so only the few documents that hold one are taken apart.
    """
    wanted = lines.select("source_name", F.col("example.d").alias("d"), F.col("example.line_no").alias("line_no"), "h1", "h2", "n_docs", "n_source_docs")
    lists = wanted.groupBy("source_name", "d").agg(F.collect_set(F.struct("line_no", "h1", "h2", "n_docs", "n_source_docs")).alias("w"))
    lists = written(lists, "examples")  # its size is known when the join with the texts is planned
    rows = df.select("source_name", "document_id", "content", F.xxhash64("document_id").alias("d")).where(F.col("content").isNotNull()).join(lists, ["source_name", "d"])
    # an example's number holds for one of the document's contents: in others another line may stand there
    at = rows.select("source_name", F.split("content", "\n").alias("x"), F.explode("w").alias("w")).where(F.col("w.line_no") < F.size("x"))
    keyed = at.select("source_name", line_key(F.col("x")[F.col("w.line_no")]).alias("line_key"), "w.*")
    h1, h2 = _hashes(F.col("line_key"))
    return keyed.where((F.col("h1") == h1) & (F.col("h2") == h2)).groupBy("source_name", "line_key").agg(F.first("n_docs").alias("n_docs"), F.first("n_source_docs").alias("n_source_docs"))


def repeated_lines(df: DataFrame, folder: str, arrivals: list[DataFrame] | None = None, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """Lines standing in at least ``min_docs`` and ``min_share`` of a source's distinct documents.

    Columns source_name, line_key, n_docs, n_source_docs. ``df``: source_name, document_id, content; it is merged
    into the state in ``folder``, or ``arrivals`` (deltas of it) are, one after the other. Null contents have no
    lines but count as documents; rows with a null source_name or document_id don't count; a repeated row counts once.
    """
    state = LineCounts(df.sparkSession, folder, min_docs, min_share)
    for delta in arrivals if arrivals is not None else [line_delta(df)]:
        state.take(delta)
    return spell_out(df, state.crossed())


def rebuild(df: DataFrame, lines: DataFrame, keys: list[str], holders: DataFrame | None = None) -> DataFrame:
    """``keys``, source_name, content, n_removed of the documents that hold one of ``lines``, without those lines.

    ``lines``: source_name and line_key, all that are crossed. ``holders`` (source_name, d), as
    :meth:`LineCounts.holders` gives it for newly crossed or fallen lines: these documents are rebuilt and no
    others, also those that hold none of ``lines`` any more (n_removed is 0). Without ``holders``, documents that
    hold no such line aren't returned: they stay as they are. Rows with null content or source_name have none. The lines of a source go to its documents as one array, so no document is taken
    apart into rows or gathered again.
    """
    rows = df.select(*keys, "source_name", "content", F.xxhash64("document_id").alias("_d")).where(F.col("content").isNotNull() & F.col("source_name").isNotNull())
    if holders is not None:
        rows = rows.join(holders.withColumnRenamed("d", "_d"), ["source_name", "_d"], "left_semi")
    sets = written(lines.groupBy("source_name").agg(F.collect_set("line_key").alias("_drop")), "crossed")
    parts = rows.join(sets, "source_name", "inner" if holders is None else "left").withColumn("_x", F.split("content", "\n")).withColumn("_k", F.transform("_x", line_key))
    own = parts.withColumn("_own", F.array_intersect("_k", F.coalesce("_drop", F.array().cast("array<string>"))))
    if holders is None:
        own = own.where(F.size("_own") > 0)
    kept = F.filter("_x", lambda _, i: ~F.array_contains("_own", F.col("_k")[i]))
    out = own.withColumn("_kept", kept)
    return out.select(*keys, "source_name", F.array_join("_kept", "\n").alias("content"), (F.size("_x") - F.size("_kept")).cast("long").alias("n_removed"))
