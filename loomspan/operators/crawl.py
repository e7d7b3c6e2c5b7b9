"""Crawl bookkeeping: candidates, run status, attribution of documents, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import urls
from loomspan.functions.partitions import bounded
from loomspan.operators.merging import latest_by


def allowed(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates (source_id, url) on their source's host that fit one of its patterns."""
    s = bounded(sources.select(F.col("id").alias("source_id"), F.col("url").alias("_seed"), "include_patterns"))
    j = candidates.join(s, "source_id")
    return j.where((urls.host(F.col("url")) == urls.host(F.col("_seed"))) & urls.matches_any(F.col("url"), F.col("include_patterns"))).drop("_seed", "include_patterns")


def unique_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates by normalised URL: the last one's fields at the first one's place (by pos)."""
    keyed = candidates.withColumn("normalized_url", urls.normalize_url(F.col("url"))).where(F.col("normalized_url") != "")
    return keyed.groupBy("normalized_url").agg(F.max_by("source_id", "pos").alias("source_id"), F.min("pos").alias("pos"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run row of every source."""
    return latest_by(runs.where(F.col("source_id").isNotNull()), ["source_id"], [F.desc("updated_at"), F.desc("created_at"), F.desc("event_id")])


def attributed(corpus: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, pages, title, last_updated) by source name or host suffix; a page may count for several sources.

    Pages are counted by (url, source_name) first; the source registry is taken to these groups, after a check of its rows.
    """
    pages = corpus.where(F.col("source_url").isNotNull()).groupBy("source_url", "source_name").agg(F.max(F.struct("updated_at", "title")).alias("m"), F.count_distinct("document_id").alias("n"))
    s = bounded(sources.select(F.col("id").alias("source_id"), "name", urls.host(F.col("url")).alias("_host")))
    hit = (F.col("source_name") == F.col("name")) | F.coalesce(urls.host(F.col("source_url")).endswith(F.col("_host")), F.lit(False))
    j = pages.join(s, hit)
    return j.groupBy("source_id").agg(F.sum("n").alias("pages"), F.max("m").alias("m")).select("source_id", "pages", F.col("m.title").alias("title"), F.col("m.updated_at").alias("last_updated"))


def rolled_up(statuses: Column) -> Column:
    """One status of many: steps that aren't configured don't count; all good, some good or none."""
    real = F.filter(statuses, lambda s: s != "SKIPPED_NOT_CONFIGURED")
    good = F.size(F.filter(real, lambda s: s == "SUCCESS"))
    return F.when(F.size(real) == 0, "SKIPPED_NOT_CONFIGURED").when(good == F.size(real), "SUCCESS").when(good > 0, "PARTIAL").otherwise("FAILED")


def completeness(attempts: DataFrame) -> DataFrame:
    """Per source: URLs discovered, attempted, succeeded, unchanged, failed, and coverage in percent.

    Each (run, URL, status) counts once, so repeated appends don't inflate; a hot URL is pre-aggregated.
    """
    one = attempts.groupBy("source_name", "run_id", "normalized_url", "status").agg(F.lit(1).alias("x"))
    url = one.groupBy("source_name", "normalized_url").agg(
        F.bool_or(F.col("status") != "DISCOVERED").alias("tried"), F.bool_or(F.col("status").isin("PREPARED", "CATALOGED")).alias("good"), F.bool_or(F.col("status") == "SKIPPED_UNCHANGED").alias("same"), F.bool_or(F.col("status") == "FAILED").alias("bad")
    )
    n = lambda c: F.count_if(F.col(c)).alias(c)
    out = url.groupBy("source_name").agg(F.count("*").alias("discovered"), n("tried"), n("good"), n("same"), n("bad"))
    return out.withColumn("coverage", F.round(100.0 * F.col("tried") / F.col("discovered"), 2))


def progress(runs: DataFrame) -> DataFrame:
    """Per run: rows, completed, succeeded, failed, percent done."""
    done = F.col("status").isin("SUCCESS", "FAILED")
    out = runs.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "SUCCESS").alias("succeeded"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.min(F.when(F.col("status") == "RUNNING", F.col("url"))).alias("running_url"))
    return out.withColumn("percent", F.floor(100 * F.try_divide(F.col("completed"), F.col("total")) + 0.5).cast("long"))


def prefixed(portals: DataFrame, logs: DataFrame, key: str = "portal_url", url: str = "url") -> DataFrame:
    """The newest log row of each portal whose URL, less a last slash, equals or begins with the portal's.

    The portal list is taken to the logs, after a check of its rows; they are reduced to one row a URL first.
    """
    newest = logs.groupBy(url).agg(F.max(F.struct("updated_at", "event_id", "status")).alias("m"))
    p = bounded(portals.select(key, F.regexp_replace(key, "/$", "").alias("_p")))
    hit = newest.join(p, F.regexp_replace(url, "/$", "").startswith(F.col("_p")))
    best = hit.groupBy(key).agg(F.max("m").alias("m"))
    return portals.select(key).distinct().join(best, key, "left").select(key, F.col("m.status").alias("status"), F.col("m.updated_at").alias("updated_at"))


def turns(events: DataFrame, group: str, order: list[str], flag: Column, value: Column) -> Column:
    """The last earlier ``value`` of a row with ``flag`` in its group."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(flag, value), ignorenulls=True).over(w)


def batch_totals(corpus: DataFrame) -> DataFrame:
    """Per batch: documents, characters, the first title (by document_id) and the crawlers in the order in which
    they are first seen (by document_id), joined by ``+``. Null titles and crawlers are passed over."""
    rows = corpus.where(F.col("crawl_batch_id").isNotNull()).select("crawl_batch_id", "document_id", "title", "crawler", F.length("content").alias("n")).distinct()
    by_crawler = rows.groupBy("crawl_batch_id", "crawler").agg(F.min("document_id").alias("seen"), F.collect_set("document_id").alias("docs"), F.sum("n").alias("n"), F.min(F.when(F.col("title").isNotNull(), F.struct("document_id", "title"))).alias("t"))
    seen = F.collect_list(F.when(F.col("crawler").isNotNull(), F.struct("seen", "crawler")))
    out = by_crawler.groupBy("crawl_batch_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("docs")))).cast("long").alias("n_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("characters"), F.min("t")["title"].alias("first_title"), F.array_join(F.array_sort(seen)["crawler"], "+").alias("crawlers"))
    return out


def expanded_sitemaps(pages: DataFrame, seeds: str | list[str], depth: int = 3) -> DataFrame:
    """URLs listed under some sitemaps: nested ``.xml`` sitemaps are followed up to ``depth``, on the host that lists them.

    ``pages``: url, body. One join a level, of the level's sitemaps only.
    """
    locs = pages.select(F.col("url").alias("_at"), F.explode(urls.sitemap_locs(F.col("body"))).alias("url")).where(urls.host(F.col("url")) == urls.host(F.col("_at")))
    level = pages.sparkSession.createDataFrame([(s,) for s in ([seeds] if isinstance(seeds, str) else seeds)], "_at string")
    seen, found = level, None
    for _ in range(depth + 1):
        listed = locs.join(level, "_at", "left_semi").select("url").distinct()
        leaves = listed.where(~F.col("url").endswith(".xml"))
        found = leaves if found is None else found.unionByName(leaves)
        level = listed.where(F.col("url").endswith(".xml")).select(F.col("url").alias("_at")).join(seen, "_at", "left_anti")
        seen = seen.unionByName(level)
    return found.distinct()


def unique_documents(documents: DataFrame, group: str, order: str, most: int, url: str = "source_url") -> DataFrame:
    """Documents of each group (a crawl) by normalised URL: the first one counts, of these the first ``most``. Documents
    without a URL go. Only the columns of ``documents`` and normalized_url, place (from 1)."""
    keyed = documents.withColumn("normalized_url", urls.normalize_url(F.col(url))).where(F.coalesce("normalized_url", F.lit("")) != "")
    one = latest_by(keyed, [group, "normalized_url"], [F.col(order)])
    return one.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order, "normalized_url"))).where(F.col("place") <= most)


def page_cap(default_pages: Column, override: Column | None = None, most: int = 3) -> Column:
    """Pages to crawl of a source: an override, at least 1; else the source's own number, at least 1 and at most ``most``."""
    own = F.greatest(F.least(F.coalesce(F.nullif(default_pages, F.lit(0)), F.lit(most)), F.lit(most)), F.lit(1))
    return own if override is None else F.when(F.coalesce(override, F.lit(0)) != 0, F.greatest(override, F.lit(1))).otherwise(own)


def in_run_repeats(documents: DataFrame, order: str) -> DataFrame:
    """Documents with seen: whether the same document_id with the same hash came before it in its run. Null hashes equal
    nothing."""
    w = Window.partitionBy("crawl_batch_id", "document_id", "content_hash").orderBy(order)
    return documents.withColumn("seen", F.col("content_hash").isNotNull() & (F.row_number().over(w) > 1))


#: The states of an attempt in the order they come.
STATES = ("DISCOVERED", "FETCHED", "SKIPPED_UNCHANGED", "PREPARED", "CATALOGED", "FAILED")


def attempt_states(attempts: DataFrame) -> DataFrame:
    """(run_id, normalized_url, status, document_id, n_states) of each URL of a run: its last state, by time and then by the
    order of states; states that aren't known come first. Rows are reduced before the shuffle, so a listing page with a tenth
    of all rows is no hot task."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("status")), F.lit(0))
    at = F.struct("updated_at", rank.alias("rank"), "status", "document_id")
    out = attempts.where(F.col("run_id").isNotNull() & F.col("normalized_url").isNotNull()).groupBy("run_id", "normalized_url").agg(F.max(at).alias("m"), F.size(F.collect_set("status")).cast("long").alias("n_states"))
    return out.select("run_id", "normalized_url", F.col("m.status").alias("status"), F.col("m.document_id").alias("document_id"), "n_states")


def stored(status: Column) -> Column:
    """Whether a step's status says that something was stored."""
    s = F.upper(F.coalesce(status, F.lit("")))
    return (s != "") & ~s.startswith("SKIPPED") & ~F.contains(s, F.lit("NOT_CONFIGURED"))


def log_status(status: Column) -> Column:
    """FAILED and RUNNING as they are, all else SUCCESS."""
    return F.when(status.isin("FAILED", "RUNNING"), status).otherwise("SUCCESS")


def either(primary: DataFrame, secondary: DataFrame, key: str, fallback: bool = True) -> DataFrame:
    """Documents of the primary crawler; for keys it has none for, those of the secondary one, unless that is switched off."""
    if not fallback:
        return primary
    rest = secondary.select(*primary.columns).join(primary.select(key).distinct(), key, "left_anti")
    return primary.unionByName(rest)


def selected(sources: DataFrame, wanted: str) -> DataFrame:
    """Sources by a list of ids (``1, 3``); ``all``, and an empty list, select every one. What is no number is passed over."""
    ids = [int(x) for x in wanted.replace(",", " ").split() if x.isdigit()]
    return sources if wanted.strip().lower() in ("", "all") else sources.where(F.col("id").isin(ids))


def discovered(links: DataFrame, sources: DataFrame, depth: int = 2, most: int = 500) -> DataFrame:
    """(source_id, url, depth) of the pages that are found from each source's address, breadth first by links (from_url, url).

    A link is followed if it stays on the source's host; what is returned fits its patterns, too. ``most`` pages of a level
    are opened for each source, the first by URL. One join a level, of the level's pages only.
    """
    s = bounded(sources.select(F.col("id").alias("source_id"), urls.normalize_url(F.col("url")).alias("seed"), urls.host(F.col("url")).alias("_host"), "include_patterns"))
    steps = links.select(urls.normalize_url(F.col("from_url")).alias("_from"), urls.normalize_url(F.col("url")).alias("url")).where("url <> ''").distinct()
    level = s.select("source_id", F.col("seed").alias("url"), F.lit(0).alias("depth"))
    seen = level
    for d in range(1, depth + 1):
        opened = level.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy("url"))).where(F.col("_n") <= most).select("source_id", F.col("url").alias("_from"))
        found = opened.join(steps, "_from").select("source_id", "url").distinct().join(s.select("source_id", "_host"), "source_id").where(urls.host(F.col("url")) == F.col("_host")).drop("_host")
        level = found.join(seen.select("source_id", "url"), ["source_id", "url"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(level)
    fit = seen.join(s.select("source_id", "seed", "include_patterns"), "source_id").where((F.col("url") == F.col("seed")) | urls.matches_any(F.col("url"), F.col("include_patterns")))
    return fit.select("source_id", "url", "depth")
