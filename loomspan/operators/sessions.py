"""Session state: sanitising of messages and graphs, patch merges, keys of cached answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.text import normalize_text

# What is kept of a session.
MESSAGES, CITATIONS, NODES, LINKS, TURNS = 80, 20, 80, 160, 6
MESSAGE_LENGTH, INPUT_LENGTH, ID_LENGTH, LABEL_LENGTH, URL_LENGTH, TITLE_LENGTH, TYPE_LENGTH, TEXT_LENGTH = 12_000, 4_000, 120, 220, 1_000, 240, 40, 1_200
TABS = ("chat", "graph", "sources", "analytics", "review", "engineering")
SESSION_ID = "^[a-zA-Z0-9-]{20,80}$"
# Fixed values end.


def cut(c: Column, length: int) -> Column:
    """At most ``length`` characters; null becomes empty."""
    return F.substring(F.coalesce(c, F.lit("")), 1, length)


def or_else(*columns: Column) -> Column:
    """The first that is neither null nor empty; null if none is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def one_of(c: Column, allowed: tuple[str, ...]) -> Column:
    """The value if it is allowed, else null."""
    return F.when(c.isin(*allowed), c)


def session_id(cookie: Column, fresh: Column) -> Column:
    """A well-formed id is used again, else the fresh one."""
    return F.when(F.coalesce(cookie, F.lit("")).rlike(SESSION_ID), cookie).otherwise(fresh)


def last(c: Column, n: int) -> Column:
    """The last ``n`` entries of an array, all of a shorter one."""
    return F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), n)


def citations(c: Column) -> Column:
    """Citations (title, url) with a URL, at most CITATIONS; a missing title is the URL."""
    usable = F.slice(F.filter(c, lambda x: x["url"].isNotNull()), 1, CITATIONS)
    return F.transform(usable, lambda x: F.struct(or_else(cut(x["title"], TITLE_LENGTH), cut(x["url"], TITLE_LENGTH)).alias("title"), cut(x["url"], URL_LENGTH).alias("url")))


def messages(c: Column, now: Column) -> Column:
    """Of an array of messages (id, role, content, timestamp) the last MESSAGES, of these the ones with a content; roles but
    user and system become model, texts are cut, timestamps that can't be read are ``now``. Null stays null."""
    kept = F.filter(last(c, MESSAGES), lambda m: m["content"].isNotNull())
    return F.transform(
        kept,
        lambda m: F.struct(
            cut(m["id"], ID_LENGTH).alias("id"),
            F.when(m["role"].isin("user", "system"), m["role"]).otherwise("model").alias("role"),
            cut(m["content"], MESSAGE_LENGTH).alias("content"),
            F.coalesce(F.try_to_timestamp(m["timestamp"]), now).alias("timestamp"),
        ),
    )


def graph_parts(nodes: Column, links: Column) -> Column:
    """A nested graph's first NODES nodes with an id, and the first LINKS links whose both ends are among them."""
    kept = F.slice(F.filter(nodes, lambda n: n["id"].isNotNull()), 1, NODES)
    clean = F.transform(
        kept,
        lambda n: F.struct(cut(n["id"], ID_LENGTH).alias("id"), F.coalesce(or_else(cut(n["type"], TYPE_LENGTH)), F.lit("Entity")).alias("type"), F.coalesce(or_else(cut(n["label"], LABEL_LENGTH), cut(n["id"], ID_LENGTH)), F.lit("")).alias("label"), cut(n["description"], TEXT_LENGTH).alias("description")),
    )
    ids = F.transform(clean, lambda n: n["id"])
    inside = F.slice(F.filter(links, lambda x: F.array_contains(ids, x["source"]) & F.array_contains(ids, x["target"])), 1, LINKS)
    tidy = F.transform(inside, lambda x: F.struct(cut(x["source"], ID_LENGTH).alias("source"), cut(x["target"], ID_LENGTH).alias("target"), F.coalesce(or_else(cut(x["relation"], ID_LENGTH)), F.lit("RELATION")).alias("relation")))
    return F.struct(clean.alias("nodes"), tidy.alias("links"))


def patched(state: DataFrame, patch: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """State after a patch: of each column in ``rules`` the rule's value of the patch (column names there are those of the
    patch) where it isn't null, else what it was. Keys of either side stay; both have one row a key."""
    new = patch.select(F.col(key).alias("_k"), *[rule.alias(f"_{c}") for c, rule in rules.items()])
    both = state.join(new, F.col(key) == F.col("_k"), "full_outer")
    return both.select(F.coalesce(F.col(key), F.col("_k")).alias(key), *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in rules])


def answer_key(message: Column, history: Column, version: Column, model: Column, longest: int = 1000, cut_at: int = 2000) -> Column:
    """Key of a cached answer: of the normalised message, the last TURNS of the history (role, content), the model and the
    version of the knowledge, which makes all older keys stale. Null for messages that are too long to be cached."""
    turns = F.transform(last(F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), TURNS), lambda t: F.concat_ws(":", F.when(t["role"] == "user", "user").otherwise("model"), F.substring(normalize_text(F.coalesce(t["content"], F.lit(""))), 1, cut_at)))
    said = F.concat_ws("\n", F.lit("1"), version.cast("string"), model, normalize_text(F.coalesce(message, F.lit(""))), F.array_join(turns, "|"))
    return F.when(F.length(F.coalesce(message, F.lit(""))) <= longest, F.concat(F.lit("chat-response:"), F.sha2(said, 256)))


def two_tiers(asked: DataFrame, local: DataFrame, shared: DataFrame, key: str, value: str, version: int) -> DataFrame:
    """(``key``, ``value``, tier) of each asked key: from the local tier, else from the shared one, else to be computed
    (tier ``compute``, a null value). Entries (key, value, version) of another version of the knowledge don't count."""
    out = asked.select(key).distinct()
    for name, tier in (("local", local), ("shared", shared)):
        own = tier.where(F.col("version") == version).groupBy(key).agg(F.max(value).alias(f"_{name}"))
        out = out.join(own, key, "left")
    tier = F.when(F.col("_local").isNotNull(), "local").when(F.col("_shared").isNotNull(), "shared").otherwise("compute")
    return out.select(key, F.coalesce("_local", "_shared").alias(value), tier.alias("tier"))
