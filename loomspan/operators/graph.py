"""Property-graph operators over edge and node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _or(c: str, default: str) -> F.Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default) if default != "" else F.lit(""))


def edge_rows(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (source, target, relation) with both ends looked up by lower-cased id; of nodes with the same id the
    last (by pos) counts; ends without node have their id as label, type Entity and an empty description."""
    one = nodes.where(F.col("id").isNotNull()).groupBy(F.lower("id").alias("_id")).agg(F.max_by(F.struct("label", "type", "description"), "pos").alias("n"))
    out = links
    for end in ("source", "target"):
        side = one.select(F.col("_id").alias(f"_{end}"), F.col("n").alias(f"_n{end}"))
        out = out.join(side, F.lower(end) == F.col(f"_{end}"), "left")
    made = [F.coalesce(F.nullif(F.col(f"_n{e}.{f}"), F.lit("")), d).alias(f"{e}_{f}") for e in ("source", "target") for f, d in (("label", F.col(e)), ("type", F.lit("Entity")), ("description", F.lit("")))]
    return out.select("source", "target", "relation", *made)


def graph_nodes(edges: DataFrame, order: str, last: bool = False) -> DataFrame:
    """Nodes (id, label, type, description) of an edge table: the first row of each id counts (or the last), a
    row's source before its target. Aggregated on each side before the shuffle, so hot nodes are no hot task."""
    ends = F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"{s}_id").alias("id"), F.col(f"{s}_label").alias("label"), F.col(f"{s}_type").alias("type"), F.col(f"{s}_description").alias("description")) for k, s in enumerate(("source", "target"))])
    rows = edges.select(F.col(order).alias("_o"), F.explode(ends).alias("e")).where(F.coalesce("e.id", F.lit("")) != "")
    pick = F.max_by if last else F.min_by
    got = rows.groupBy(F.col("e.id").alias("id")).agg(pick(F.struct("e.label", "e.type", "e.description"), F.struct("_o", "e.side")).alias("n"))
    return got.select("id", F.coalesce(F.nullif("n.label", F.lit("")), F.col("id")).alias("label"), F.coalesce(F.nullif("n.type", F.lit("")), F.lit("Entity")).alias("type"), F.coalesce("n.description", F.lit("")).alias("description"))


def graph_links(edges: DataFrame) -> DataFrame:
    """Distinct (source, target, relation); rows without an end are left out."""
    ok = (F.coalesce("source_id", F.lit("")) != "") & (F.coalesce("target_id", F.lit("")) != "")
    return edges.where(ok).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.coalesce("relation", F.lit("")).alias("relation")).distinct()


def degrees(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, degree): ends of links at a node, self-loops twice; nodes without a link have 0."""
    n = links.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").distinct().join(n, "id", "full_outer").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def neighbourhood(links: DataFrame, node: str) -> DataFrame:
    """The node and what it is linked to, either way."""
    hit = links.where((F.col("source") == node) | (F.col("target") == node))
    return hit.select(F.explode(F.array(F.lit(node), "source", "target")).alias("id")).distinct()


def induced(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links whose both ends are in ``nodes``."""
    a, b = nodes.select(F.col("id").alias("source")).distinct(), nodes.select(F.col("id").alias("target")).distinct()
    return links.join(a, "source", "left_semi").join(b, "target", "left_semi")


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes matched by lower-cased id; fields of the new one, where given, replace the old ones."""
    a, b = old.withColumn("_k", F.lower("id")), new.withColumn("_k", F.lower("id"))
    j = a.alias("a").join(b.alias("b"), "_k", "full_outer")
    return j.select(F.coalesce("a.id", "b.id").alias("id"), *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in ("label", "type", "description")])


def merge_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old links and those new ones that aren't there yet, without regard to case."""
    keys = [F.lower("source").alias("_s"), F.lower("target").alias("_t"), F.upper("relation").alias("_r")]
    fresh = new.select("*", *keys).join(old.select(*keys).distinct(), ["_s", "_t", "_r"], "left_anti")
    one = fresh.groupBy("_s", "_t", "_r").agg(F.min(F.struct("source", "target", "relation")).alias("x"))
    return old.unionByName(one.select("x.*"))


def signatures(edges: DataFrame, by: str) -> DataFrame:
    """A text per group that is the same for the same graph: sorted ``id:type`` and ``source:relation:target``."""
    nodes = edges.select(by, F.explode(F.array(F.struct(F.col("source_id").alias("i"), F.col("source_type").alias("t")), F.struct(F.col("target_id").alias("i"), F.col("target_type").alias("t")))).alias("n"))
    a = nodes.select(by, F.concat_ws(":", "n.i", F.coalesce("n.t", F.lit("Entity"))).alias("x")).groupBy(by).agg(F.array_join(F.array_sort(F.collect_set("x")), "|").alias("a"))
    b = edges.select(by, F.concat_ws(":", "source_id", "relation", "target_id").alias("x")).groupBy(by).agg(F.array_join(F.array_sort(F.collect_set("x")), "|").alias("b"))
    return a.join(b, by).select(by, F.concat("a", F.lit("::"), "b").alias("signature"))


def reached(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, depth) of what is reached from the seeds by directed links in at most ``depth`` steps, breadth first.

    One join a level; the level's frontier only. Levels are few and fixed by ``depth``.
    """
    step = links.select(F.col("source").alias("_s"), F.col("target").alias("_t")).distinct()
    seen = frontier = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    for level in range(1, depth + 1):
        frontier = frontier.join(step, F.col("id") == F.col("_s")).select(F.col("_t").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(level))
        seen = seen.unionByName(frontier)
    return seen


def snippet(edges: DataFrame, by: str, order: str, nodes: int = 8, links: int = 8) -> DataFrame:
    """(``by``, source, target, relation) of each group's first ``nodes`` nodes and, of the links between these, the first
    ``links`` (by ``order``, a row's source before its target)."""
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("source_id").alias("id")), F.struct(F.lit(1).alias("side"), F.col("target_id").alias("id")))
    seen = edges.select(by, F.col(order).alias("_o"), F.explode(ends).alias("e")).where(F.coalesce("e.id", F.lit("")) != "").groupBy(by, F.col("e.id").alias("id")).agg(F.min(F.struct("_o", "e.side")).alias("_at"))
    first = seen.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("_at", "id"))).where(F.col("_n") <= nodes).groupBy(by).agg(F.collect_set("id").alias("_ids"))
    inside = edges.join(first, by).where(F.array_contains("_ids", F.col("source_id")) & F.array_contains("_ids", F.col("target_id")))
    one = inside.groupBy(by, F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.coalesce("relation", F.lit("")).alias("relation")).agg(F.min(order).alias("_o"))
    w = Window.partitionBy(by).orderBy("_o", "source", "target", "relation")
    return one.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= links).drop("_n", "_o")


def ellipse_layout(nodes: DataFrame, group: str, order: str, rx: float = 178.0, ry: float = 54.0, side: float = 110.0) -> DataFrame:
    """(x, y) of each group's nodes: the first in the centre, the others on an ellipse around it; two nodes stand
    ``side`` to the left and to the right of it."""
    w = Window.partitionBy(group)
    n = F.count("*").over(w)
    k = F.row_number().over(w.orderBy(order)) - 1
    angle = 2 * F.pi() * (k - 1) / (n - 1) - F.pi() / 2
    x = F.when(n == 2, F.when(k == 0, -side).otherwise(side)).when(k == 0, 0.0).otherwise(rx * F.cos(angle))
    return nodes.select("*", k.alias("place"), x.alias("x"), F.when((k == 0) | (n == 2), 0.0).otherwise(ry * F.sin(angle)).alias("y"))
