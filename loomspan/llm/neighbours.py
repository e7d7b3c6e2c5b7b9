"""Problem 2: the most similar vectors for every vector, by an inverted multi-index.

Unit vectors are cut into two halves; each half is quantised on its own codebook of K centroids, so the
index has K x K cells. Every query walks the pairs of centroids by rising summed distance with a heap until
the cells it has met hold enough entries, a number that grows with the table; empty cells are passed over by a
table of the cells' sizes. The entries of these cells are ranked again by their cosine.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.partitions import spread
from loomspan.functions.shared import written

DIM, K_NEAREST = 96, 5
#: Entries a query ranks again: so many at least, and so many times the square root of the rows; measured recall is in the README.
LEAST_ENTRIES, ENTRIES_ROOT = 800, 4
#: The codebooks are fitted on about this many vectors at most; every vector is indexed.
FIT_ROWS = 16_384
#: Queries that meet the entries of one group of first-half centroids in one task, at most (about).
BLOCK = 80_000
#: Near first-half centroids share a group, to which a query is sent once: so many groups at least, and one for so many rows.
LEAST_GROUPS, GROUP_ROWS = 8, 100_000
#: Entries of a group that one task holds, at most (about): a larger group is cut into parts, and its queries meet each.
PART_ROWS = 250_000
_PACKED = "id bigint, chunk_id string, at timestamp, cell int, vec binary"


def codebook_size(n: int) -> int:
    """K such that a cell holds about 40 entries, K x K = n / 40, and beyond 180,000 rows more (the fourth root of n),
    so that a walk over more entries takes fewer steps; between 4 and 4096."""
    return int(min(4096, max(4, round(min((n / 40) ** 0.5, 0.717 * n**0.375)))))


def entries_wanted(n: int) -> int:
    """Entries that a query ranks again in a table of ``n`` rows."""
    return int(max(LEAST_ENTRIES, ENTRIES_ROOT * n**0.5))


def unit_vectors(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors) of the usable rows: exactly ``dim`` finite values, none null, not all zero."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(lengths == dim)
    if not len(rows):
        return rows, np.empty((0, dim), np.float32)
    values = column.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), dim)
    top = np.abs(values).max(axis=1)
    ok = np.isfinite(top) & (top > 0)
    values = values[ok] / top[ok][:, None]  # no overflow or underflow of the squares
    return rows[ok], (values / np.linalg.norm(values, axis=1)[:, None]).astype(np.float32)


def fit_codebook(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Lloyd's k-means; empty centroids are placed anew."""
    draw = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[draw.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, c).argmin(axis=1)
        order = np.argsort(near, kind="stable")
        n = np.bincount(near, minlength=k)
        held = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[held])[:-1]]), axis=0)
        c[held] = sums / n[held][:, None]
        empty = np.flatnonzero(n == 0)
        c[empty] = x[draw.choice(len(x), len(empty))]
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(axis=1) - 2 * (x @ c.T)


def multi_sequence(d1: list[float], d2: list[float], wanted: int, held: Callable[[int, int], int] = lambda a, b: 1) -> list[tuple[int, int]]:
    """Index pairs of two rising lists by rising sum, with a heap, until they hold ``wanted`` entries or all pairs
    were met. ``held``: the entries of a pair, one unless told; pairs that hold none are left out."""
    heap, out, met = [(d1[0] + d2[0], 0, 0)], [], 0
    while heap and met < wanted:
        _, a, b = heapq.heappop(heap)
        if n := held(a, b):
            out.append((a, b))
            met += n
        if b + 1 < len(d2):
            heapq.heappush(heap, (d1[a] + d2[b + 1], a, b + 1))
        if b == 0 and a + 1 < len(d1):
            heapq.heappush(heap, (d1[a + 1] + d2[0], a + 1, 0))
    return out


def _cells(x: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """The cell of each vector, numbered by first and second centroid."""
    half = x.shape[1] // 2
    return _distances(x[:, :half], c1).argmin(axis=1) * len(c2) + _distances(x[:, half:], c2).argmin(axis=1)


def _visits(x: np.ndarray, c1: np.ndarray, c2: np.ndarray, wanted: int, sizes: np.ndarray, owner: np.ndarray) -> list[dict[int, list[int]]]:
    """For each query the cells it visits, by the group (``owner``) of their first centroid. ``sizes``: entries of each cell."""
    half, width = x.shape[1] // 2, len(c2)
    lists = []
    for part, c in ((x[:, :half], c1), (x[:, half:], c2)):
        d = _distances(part, c)
        o = np.argsort(d, axis=1, kind="stable")
        lists += [o.tolist(), np.take_along_axis(d, o, axis=1).tolist()]
    size, group, out = memoryview(np.ascontiguousarray(sizes)), owner.tolist(), []
    for p, u, q, v in zip(*lists, strict=True):
        by: dict[int, list[int]] = {}
        for a, b in multi_sequence(u, v, wanted, lambda a, b, p=p, q=q: size[p[a] * width + q[b]]):
            by.setdefault(group[p[a]], []).append(p[a] * width + q[b])
        out.append(by)
    return out


def _raw_vectors(raw: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), np.float16).reshape(-1, dim).astype(np.float32)


def _search(entries: pa.Table, queries: pa.Table, k: int, dim: int) -> pa.Table:
    """The ``k`` best entries of each query in the visited cells of one group."""
    ids = entries.column("e").to_numpy()
    q_ids = queries.column("id").to_numpy()
    names = ["id", "near", "cosine"]
    if not len(ids) or not len(q_ids):
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.float32()))], names=names)

    e, q = _raw_vectors(entries.column("evec"), dim), _raw_vectors(queries.column("vec"), dim)
    cell = entries.column("cell").to_numpy()
    order = np.argsort(cell, kind="stable")
    e, ids, cell = e[order], ids[order], cell[order]
    firsts = dict(zip(*(x.tolist() for x in np.unique(cell, return_index=True)), strict=True))
    ends = np.searchsorted(cell, list(firsts), side="right")
    spans = {j: (firsts[j], int(b)) for j, b in zip(firsts, ends, strict=True)}
    flat = queries.column("cells").combine_chunks()
    wanted = flat.flatten().to_numpy()
    who = np.repeat(np.arange(len(q_ids)), np.asarray(flat.value_lengths()))
    by = np.argsort(wanted, kind="stable")
    wanted, who = wanted[by], who[by]
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    floor = np.full(len(q_ids), -1.5, np.float32)  # what the k-th best of a query reaches at least
    cells, begin = np.unique(wanted, return_index=True)
    for j, a, b in zip(cells.tolist(), begin, np.append(begin[1:], len(wanted)), strict=True):
        if j not in spans:
            continue
        s, t = spans[j]
        for a2 in range(a, b, 4096):  # bounds the score matrix
            rows = who[a2 : min(b, a2 + 4096)]
            score = q[rows] @ e[s:t].T
            score[q_ids[rows][:, None] == ids[s:t][None, :]] = -2
            n = min(k, t - s)
            best = np.argpartition(-score, n - 1, axis=1)[:, :n] if n < t - s else np.tile(np.arange(n), (len(rows), 1))
            top = np.take_along_axis(score, best, axis=1)
            r, c = np.nonzero(top >= floor[rows][:, None])
            got.append((rows[r], ids[s + best[r, c]], top[r, c]))
            if n == k:
                floor[rows] = np.maximum(floor[rows], top.min(axis=1))
    if not got:
        return _search(entries.slice(0, 0), queries, k, dim)
    row, near, cosine = (np.concatenate(x) for x in zip(*got, strict=True))
    real = cosine > -1.5
    row, near, cosine = row[real], near[real], cosine[real]
    by = np.lexsort((near, -cosine, row))
    row, near, cosine = row[by], near[by], cosine[by]
    start = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1]) if len(row) else np.empty(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
    keep = rank < k
    row, near, cosine = row[keep], near[keep], cosine[keep]
    start = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1]) if len(row) else np.empty(0, np.int64)
    offsets = pa.array(np.append(start, len(row)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (near, cosine)]
    return pa.table([pa.array(q_ids[row[start]]), *lists], names=names)


def nearest(df: DataFrame, key: str = "chunk_id", vector: str = "embedding", newest: str = "created_at", k: int = K_NEAREST, dim: int = DIM, entries: int | None = None, codebook: int | None = None) -> DataFrame:
    """(``key``, near_key, cosine, rank) of the ``k`` most similar other keys of every usable key.

    Usable are vectors of exactly ``dim`` finite values, not all zero; rows with a null key are left out. A key with
    several rows takes part with its newest one (by ``newest``, nulls first). Ties are broken by the hash of the
    key. Vectors are ranked in half precision. Groups of more than k + 1 equal vectors, which may hold any share
    of the rows, are answered by their k + 1 first members, so that they make no hot cell.
    Keys are carried as 64-bit hashes and spelled out at the end. ``entries``: what a query ranks again at least,
    :func:`entries_wanted` unless told; a smaller table is ranked whole, and any table is with as many entries as
    rows: the exact way. Groups of entries are cut into parts of a bounded size, so no task holds a whole hot group.
    """
    spark = df.sparkSession
    rows = df.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("id"), F.col(key).alias("chunk_id"), F.col(newest).cast("timestamp").alias("at"), F.col(vector).cast("array<double>").alias("v"))
    n = df.count()
    share = min(1.0, FIT_ROWS / max(1, n))
    picked = rows.where(F.pmod(F.col("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = unit_vectors(b.column("v"), dim)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], names=["x"])

    sample = picked.mapInArrow(units, "x binary").limit(2 * FIT_ROWS).toArrow()
    x = np.frombuffer(b"".join(sample.column("x").to_pylist()), np.float32).reshape(-1, dim)
    if not len(x):
        return spark.createDataFrame([], f"{key} string, near_{key} string, cosine float, rank int")
    size = codebook or codebook_size(n)
    c1, c2 = fit_codebook(x[:, : dim // 2], size), fit_codebook(x[:, dim // 2 :], size, seed=1)

    width, wanted = len(c2), entries or entries_wanted(n)
    coarse = fit_codebook(x[:, : dim // 2], min(len(c1), max(LEAST_GROUPS, n // GROUP_ROWS)), seed=2)
    owner = _distances(c1, coarse).argmin(axis=1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = unit_vectors(b.column("v"), dim)
            if not len(at):
                continue
            kept = b.select(["id", "chunk_id", "at"]).take(pa.array(at))
            raw = x.astype(np.float16)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(_cells(x, c1, c2).astype(np.int32)), pa.array([r.tobytes() for r in raw], pa.binary())], names=["id", "chunk_id", "at", "cell", "vec"])

    packed = spread(rows).mapInArrow(pack, _PACKED)
    one = packed.groupBy("id").agg(F.first("chunk_id").alias("chunk_id"), F.max(F.struct("at", "vec", "cell")).alias("m"))
    index = written(one.select("id", "chunk_id", "m.cell", "m.vec"), "vectors")
    same = F.struct(F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(7), "vec").alias("b")).alias("same")
    hot = index.groupBy(same).agg(F.count("*").alias("n")).where(F.col("n") > k + 1)
    held, asked, direct = index, index, None
    if not hot.isEmpty():
        tagged = index.withColumn("same", same)
        copies = tagged.join(hot.select("same"), "same", "left_semi").select("same", "id")
        few = lambda c: F.slice(F.array_sort(c), 1, k + 1)
        some = copies.groupBy("same", F.pmod("id", F.lit(1024)).alias("salt"), F.spark_partition_id().alias("part")).agg(few(F.collect_list("id")).alias("ids"))
        some = some.groupBy("same", F.pmod("salt", F.lit(32)).alias("salt")).agg(few(F.flatten(F.collect_list("ids"))).alias("ids"))
        leaders = written(some.groupBy("same").agg(few(F.flatten(F.collect_list("ids"))).alias("ids")), "leaders")
        asked = tagged.join(leaders, "same", "left_anti").drop("same")
        held = asked.unionByName(index.join(leaders.select(F.explode("ids").alias("id")), "id", "left_semi"))
        own = copies.join(leaders, "same").select("id", F.slice(F.filter("ids", lambda x: x != F.col("id")), 1, k).alias("near"))
        direct = own.select("id", "near", F.transform("near", lambda _: F.lit(1.0).cast("float")).alias("cosine"))
    counts = held.groupBy("cell").agg(F.count("*").alias("n")).toArrow()  # a row a cell that isn't empty
    sizes = np.zeros(len(c1) * width, np.int64)
    sizes[counts.column("cell").to_numpy()] = counts.column("n").to_numpy()
    table = spark.sparkContext.broadcast(sizes.astype(np.uint32))
    # the blocks of a group go by what a sample of different vectors would ask of it
    some = np.unique(x[:2000].astype(np.float16), axis=0).astype(np.float32)
    load = np.zeros(len(coarse))
    for by in _visits(some, c1, c2, wanted, sizes, owner):
        load[list(by)] += n / min(len(x), 2000)
    rows_of = np.bincount(np.repeat(owner, width), weights=sizes, minlength=len(coarse))
    blocks = F.broadcast(spark.createDataFrame([(g, int(max(1, -(-c // BLOCK))), int(max(1, -(-r // PART_ROWS)))) for g, (c, r) in enumerate(zip(load, rows_of, strict=True))], "g int, blocks int, parts int"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(a, 1000) for a in range(0, b.num_rows, 1000)):
                visits = _visits(_raw_vectors(part.column("vec"), dim), c1, c2, wanted, table.value, owner)
                at = part.take(pa.array(np.repeat(np.arange(part.num_rows), [len(v) for v in visits])))
                yield pa.RecordBatch.from_arrays([pa.array([g for v in visits for g in v], pa.int32()), at.column("id"), at.column("vec"), pa.array([c for v in visits for c in v.values()], pa.list_(pa.int32()))], names=["h", "id", "vec", "cells"])

    groups = F.broadcast(spark.createDataFrame([(i, int(g)) for i, g in enumerate(owner)], "i int, g int"))
    left = held.select(F.expr(f"cell div {width}").cast("int").alias("i"), F.col("id").alias("e"), "cell", F.col("vec").alias("evec")).join(groups, "i").join(blocks, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("s"), F.pmod(F.xxhash64(F.lit(3), "e"), F.col("parts")).cast("int").alias("p"), "e", "cell", "evec")
    right = spread(asked.select("id", "vec")).mapInArrow(route, "h int, id bigint, vec binary, cells array<int>")
    right = right.join(blocks.withColumnRenamed("g", "h"), "h").select("h", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("u"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("r"), "id", "vec", "cells")
    found = left.groupBy("g", "s", "p").cogroup(right.groupBy("h", "u", "r")).applyInArrow(lambda a, b: _search(a, b, k, dim), "id bigint, near array<bigint>, cosine array<float>")
    if direct is not None:
        found = found.unionByName(direct)
    pairs = F.arrays_zip(F.transform("cosine", lambda c: -c).alias("d"), F.col("near").alias("n"))
    best = found.select("id", pairs.alias("p")).groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, k).alias("p"))
    out = best.select("id", F.posexplode("p").alias("rank", "p")).select("id", F.col("p.n").alias("near"), (-F.col("p.d")).alias("cosine"), (F.col("rank") + 1).alias("rank"))
    names = index.select("id", "chunk_id")
    out = out.join(names.withColumnRenamed("chunk_id", key), "id").join(names.select(F.col("id").alias("near"), F.col("chunk_id").alias(f"near_{key}")), "near")
    return out.select(key, f"near_{key}", "cosine", "rank")


def neighbour_pairs(near: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(``key``_a, ``key``_b), a < b: pairs of which at least one is among the other's nearest."""
    return near.select(F.least(key, f"near_{key}").alias(f"{key}_a"), F.greatest(key, f"near_{key}").alias(f"{key}_b")).distinct()
