"""Problem 3: new batches checked against all accepted history, by multi-key sorted-neighbourhood runs.

Every text has several sort keys, each of the minima of two hash functions over the text's three-word runs: the
first is the key's prefix. Accepted records are kept in runs sorted by key. A new batch, sorted the same way, is
merged into the key ranges it falls into, and a window slides over them: a new record is compared with its
neighbours of the same prefix and with all records of the same key, by a sketch. What looks near is checked exactly
on the sets of word runs. What is accepted becomes history; parts are compacted from time to time.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.partitions import spread
from loomspan.functions.shared import written
from loomspan.llm.arrivals import numbered
from loomspan.llm.words import WordIds, mix64, shingle_hashes
from loomspan.sources.versions import Versions

WIDTH, SIMILARITY = 3, 0.5
#: Sort keys of a text, lanes of its sketch (four bits each; the keys are made of the first 2 * KEYS minima).
KEYS, LANES = 18, 64
#: Places on both sides in which a record meets its neighbours of the same prefix, whatever their key.
WINDOW = 16
#: What two texts share of their lanes by chance, and what those of just the similarity share, less 3.5 standard
#: deviations: from here on a pair goes on to the exact check.
_CHANCE = 1 / 16
_SHARED = SIMILARITY + (1 - SIMILARITY) * _CHANCE
SKETCH_LANES = int(np.ceil((_SHARED - 3.5 * (_SHARED * (1 - _SHARED) / LANES) ** 0.5) * LANES))
#: In a run longer than the window a record is handed on with so many records that look near to it, at most; if it isn't
#: rejected by one of them it comes again with AGAIN times as many, until nothing is left out.
FEW, AGAIN = 64, 8
#: A run of one key with more records is cut into blocks, and each pair of blocks is a task's work.
HOT = 20_000
#: Records of a run looked at together.
STEP = 512
#: Up to so many different values are looked up in the sorted parts, of which only the pages that may hold them are
#: read; more values meet the whole (narrow) table.
LOOKUPS = 1024
#: Values that one scan looks up.
AT_ONCE = 256
#: Rows in a page of the sorted parts.
PAGE_ROWS = 250
_ODD = mix64(np.arange(1, LANES + 1, dtype=np.uint64)) | np.uint64(1)
_SKETCHED = "document_id string, crawl_batch_id string, content_hash string, seq bigint, has_content boolean, node bigint, keys array<bigint>, sketch binary, runs binary"
_KEYED = "key bigint, tile int, side int, hot boolean, seq bigint, node bigint, sketch binary, fresh boolean"


def _signature(text: str, ids: WordIds) -> tuple[int, np.ndarray, bytes, bytes]:
    """(node, keys, sketch, word runs) of a whole text; texts of no word are known by their characters."""
    found = ids.of(text)
    if not len(found):
        return xxhash.xxh64_intdigest(text.strip()) | 1, np.empty(0, np.int64), b"", b""
    whole = np.unique(shingle_hashes(found, WIDTH))
    least = np.full(LANES, np.iinfo(np.uint64).max)
    for low in range(0, len(whole), 4096):  # bounds the matrix of a very long text
        np.minimum(least, (whole[None, low : low + 4096] * _ODD[:, None]).min(axis=1), out=least)
    least = mix64(least + np.arange(LANES, dtype=np.uint64))
    high = least >> np.uint64(32)
    keys = ((high[0 : 2 * KEYS : 2] << np.uint64(32)) | high[1 : 2 * KEYS : 2]).view(np.int64)
    lanes = (least & np.uint64(15)).astype(np.uint8)
    return xxhash.xxh64_intdigest(whole.tobytes()), keys, (lanes[::2] << 4 | lanes[1::2]).tobytes(), np.unique((whole >> np.uint64(32)).astype(np.uint32)).tobytes()


def sketched(df: DataFrame) -> DataFrame:
    """Rows with their node (texts with the same word runs share one), sort keys, sketch and word runs.

    ``df``: document_id, crawl_batch_id, content_hash, content, seq. Rows with a null document_id or crawl_batch_id
    are left out, as are those with neither content nor hash: they can neither repeat anything nor be repeated.
    Rows without content are nodes of their hash.
    """
    rows = df.where(F.col("document_id").isNotNull() & F.col("crawl_batch_id").isNotNull() & (F.col("content").isNotNull() | F.col("content_hash").isNotNull()))
    rows = spread(rows.select("document_id", "crawl_batch_id", "content_hash", "content", F.col("seq").cast("long").alias("seq")))
    names = [x.split()[0] for x in _SKETCHED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for b in batches:
            nodes, keys, sketches, runs = [], [], [], []
            texts = b.column("content").to_pylist()
            for text, content_hash in zip(texts, b.column("content_hash").to_pylist(), strict=True):
                if text is None:
                    node, k, s, r = xxhash.xxh64_intdigest(content_hash, seed=1), np.empty(0, np.int64), b"", b""
                else:
                    node, k, s, r = _signature(text, ids)
                nodes.append(node), keys.append(k), sketches.append(s), runs.append(r)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:4]), pa.array([t is not None for t in texts]), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(runs, pa.binary())], names=names)

    return rows.mapInArrow(run, _SKETCHED)


def key_rows(records: DataFrame) -> DataFrame:
    """(prefix, key, seq, node, sketch): one row a record and key."""
    out = records.select("seq", "node", "sketch", F.explode("keys").alias("key"))
    return out.select(F.shiftright("key", 32).cast("int").alias("prefix"), "key", "seq", "node", "sketch")


def _lanes(raw: list[bytes]) -> np.ndarray:
    packed = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), LANES // 2)
    return np.concatenate([packed >> 4, packed & 15], axis=1)


def _window(key: np.ndarray, lanes: np.ndarray, fresh: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs at most WINDOW places apart, of one prefix, of which one is fresh, that look near."""
    prefix = key >> 32
    for d in range(1, WINDOW + 1):
        same = prefix[d:] == prefix[:-d]
        if not same.any():
            return  # the places of a prefix are side by side: nothing is farther apart
        at = np.flatnonzero(same & (fresh[d:] | fresh[:-d]))
        for low in range(0, len(at), 1 << 16):
            a = at[low : low + (1 << 16)]
            near = (lanes[a] == lanes[a + d]).sum(axis=1) >= SKETCH_LANES
            yield a[near], a[near] + d


def _run(lanes: np.ndarray, fresh: np.ndarray, side: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, left out) of a run in order: places of records that look near, and of those handed on with ``few`` only.

    Each record is compared with the leaders before it. A record that looks near to ``few`` of them is left out: it
    becomes no leader. A record that looks near to fewer has been compared with all, and leads. Of a pair one is
    fresh; records of a pair of blocks (``side`` 0 and 1) meet those of the other block only.
    """
    n = len(lanes)
    two = side.any() and not side.all()
    leaders = np.empty(0, np.int64)
    pairs_a, pairs_b, out = [], [], []
    for low in range(0, n, STEP):
        block = np.arange(low, min(n, low + STEP))
        before = np.concatenate([leaders, block])
        near = np.zeros((len(block), len(before)), bool)
        for part in range(0, len(before), 8192):
            some = before[part : part + 8192]
            equal = np.zeros((len(block), len(some)), np.uint8)
            for lane in range(LANES):
                equal += lanes[block, lane][:, None] == lanes[some, lane][None, :]
            near[:, part : part + len(some)] = equal >= SKETCH_LANES
        near &= fresh[block][:, None] | fresh[before][None, :]
        if two:
            near &= side[block][:, None] != side[before][None, :]
        leads, k = np.ones(len(before), bool), len(leaders)
        for i in np.flatnonzero(near.any(axis=1)):
            row = np.flatnonzero(near[i, : k + i] & leads[: k + i])
            if len(row) >= few:
                leads[k + i] = False
                out.append(block[i])
                row = row[:few]
            pairs_a.append(before[row]), pairs_b.append(np.full(len(row), block[i]))
        leaders = before[leads]
    none = [np.empty(0, np.int64)]
    return np.concatenate(pairs_a or none), np.concatenate(pairs_b or none), np.array(out, np.int64)


def candidates(old: DataFrame | None, new: DataFrame, few: int = FEW, most: int | None = None) -> DataFrame:
    """(a, b), a < b: nodes that stand near one another in the merged runs and look near by their sketches, of which one is
    fresh; and (a, a) for a node that was compared with ``few`` of those that look near to it, and not with all.

    ``old``: key rows of history. ``new``: key rows and fresh. All rows of a prefix go to one task, where they are
    read in order; the runs of hot keys are cut into pairs of blocks, which are tasks of their own. ``most``: a number
    of records that no key exceeds, if one is known.
    """
    columns = ["key", "seq", "node", "sketch", "fresh"]
    every = new.select(*columns)
    if old is not None:
        every = every.unionByName(old.withColumn("fresh", F.lit(False)).select(*columns))
    hot = None
    if most is None or most > HOT:
        hot = every.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
        hot = written(hot.select("key", F.ceil(F.col("n") / HOT).cast("int").alias("blocks")), "hot")
    flat = every.withColumns({"tile": F.lit(0), "side": F.lit(0)})
    if hot is None or hot.isEmpty():
        flat = flat.withColumn("hot", F.lit(False))
    else:
        told = flat.join(hot, "key", "left")
        flat = told.withColumn("hot", F.col("blocks").isNotNull()).drop("blocks")
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        cut = told.where("blocks IS NOT NULL").withColumn("x", block).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        tile = F.lit(1) + F.least("x", "y") * F.col("blocks") + F.greatest("x", "y")
        flat = flat.unionByName(cut.withColumns({"tile": tile, "side": (F.col("x") > F.col("y")).cast("int"), "hot": F.lit(False)}).drop("blocks", "x", "y"))
    task = F.when(F.col("tile") == 0, F.shiftright("key", 32)).otherwise(F.xxhash64("key", "tile"))
    merged = flat.withColumn("task", task).repartition("task").sortWithinPartitions("tile", "key", "seq", "node").select(*[x.split()[0] for x in _KEYED.split(", ")])

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, tile, node = (t.column(c).to_numpy() for c in ("key", "tile", "node"))
        fresh, hot_key = (t.column(c).to_numpy(zero_copy_only=False) for c in ("fresh", "hot"))
        side, lanes = t.column("side").to_numpy(), _lanes(t.column("sketch").to_pylist())
        found_a, found_b, met = [], [], 0
        edge = np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1
        begins, ends = np.append(0, edge), np.append(edge, len(key))
        long = (ends - begins > WINDOW + 1) | (tile[begins] > 0)
        parts: list[Iterator[tuple[np.ndarray, np.ndarray]]] = []
        flat_rows = int(np.searchsorted(tile, 1))
        parts.append(_window(key[:flat_rows], lanes[:flat_rows], fresh[:flat_rows]))

        def runs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a, b in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
                if hot_key[a] or not fresh[a:b].any():
                    continue
                x, y, out = _run(lanes[a:b], fresh[a:b], side[a:b], few)
                yield x + a, y + a
                yield out + a, out + a

        parts.append(runs())
        for part in parts:
            for a, b in part:
                if len(a):
                    found_a.append(node[a]), found_b.append(node[b])
                    met += len(a)
                if met >= 500_000:
                    yield packed(found_a, found_b)
                    found_a, found_b, met = [], [], 0
        if met:
            yield packed(found_a, found_b)

    def packed(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        x, y = np.concatenate(a), np.concatenate(b)
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in both.T], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            group = (b.column("key").to_numpy() >> 32) ^ (b.column("tile").to_numpy().astype(np.int64) << 33)
            if group[-1] == last:
                held.append(b)
                continue
            cut = int(np.flatnonzero(group != group[-1])[-1]) + 1 if (group != group[-1]).any() else 0
            whole = pa.Table.from_batches([*held, b.slice(0, cut)])
            if whole.num_rows:
                yield from pairs(whole)
            held, last = [b.slice(cut)], group[-1]
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return merged.mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """Pairs (a, b) of which at least SIMILARITY of all distinct word runs are common. ``runs``: node, runs."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = runs.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("runs").alias("runs"))
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("runs").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("runs").alias("y")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for x, y in zip(t.column("x").to_pylist(), t.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= SIMILARITY * (len(x) + len(y) - both))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint")


def _directed(links: DataFrame, first: DataFrame) -> DataFrame:
    """(later, earlier) of undirected links between nodes first seen in different batches."""
    f = first.select("node", F.col("first.seq").alias("seq"))
    both = links.join(f.select(F.col("node").alias("a"), F.col("seq").alias("sa")), "a").join(f.select(F.col("node").alias("b"), F.col("seq").alias("sb")), "b").where("sa <> sb")
    return both.select(F.when(F.col("sa") < F.col("sb"), F.col("b")).otherwise(F.col("a")).alias("later"), F.when(F.col("sa") < F.col("sb"), F.col("a")).otherwise(F.col("b")).alias("earlier")).distinct()


def _decided(links: DataFrame, first: DataFrame) -> DataFrame:
    """(node, kept) of the rejected nodes. In each round the nodes that wait for no earlier one are accepted, what is
    linked to them is rejected, and links of rejected nodes end. Links between different texts only: few rounds."""
    order = first.select(F.col("node").alias("earlier"), "first")
    out, left = [], links
    while not left.isEmpty():
        roots = left.select(F.col("earlier")).distinct().join(left.select(F.col("later").alias("earlier")).distinct(), "earlier", "left_anti")
        hit = left.join(roots, "earlier").join(order, "earlier").groupBy("later").agg(F.min(F.struct("first", "earlier")).alias("m"))
        hit = written(hit.select(F.col("later").alias("node"), F.col("m.earlier").alias("kept")), "rejected")
        out.append(hit)
        gone = hit.select("node")
        left = left.join(gone.withColumnRenamed("node", "later"), "later", "left_anti").join(gone.withColumnRenamed("node", "earlier"), "earlier", "left_anti")
        left = written(left, "links")
    return reduce(DataFrame.unionByName, out) if out else links.select(F.col("later").alias("node"), F.col("earlier").alias("kept"))


def _hash_links(rows: DataFrame) -> DataFrame:
    """Stars of nodes that hold the same content_hash: (a, b) with a the first of them."""
    h = rows.where(F.col("content_hash").isNotNull()).groupBy("content_hash", "node").agg(F.min("seq").alias("seq"))
    several = h.groupBy("content_hash").agg(F.count("*").alias("n"), F.min(F.struct("seq", "node")).alias("m")).where("n > 1")
    return h.join(several.select("content_hash", F.col("m.node").alias("a")), "content_hash").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def _cases(rows: DataFrame, rejected: DataFrame, first: DataFrame) -> DataFrame:
    """Rows that repeat something, with the document they repeat: of the kept node's accepted rows the one with
    the same hash, else with the same document_id, else the first."""
    f = first.select("node", "first")
    kept = rows.join(rejected, "node", "left").withColumn("k", F.coalesce("kept", "node"))
    kept = kept.join(f.select(F.col("node").alias("k"), "first"), "k").where(F.col("has_content") & (F.col("first.seq") < F.col("seq")))
    accepted = rows.join(rejected, "node", "left_anti").join(f, "node").where(F.col("seq") == F.col("first.seq"))
    by_hash = accepted.where(F.col("content_hash").isNotNull()).groupBy(F.col("node").alias("k"), "content_hash").agg(F.min("document_id").alias("same_hash"))
    by_id = accepted.select(F.col("node").alias("k"), "document_id", F.col("document_id").alias("same_id")).distinct()
    out = kept.join(by_hash, ["k", "content_hash"], "left").join(by_id, ["k", "document_id"], "left")
    return out.select("document_id", "crawl_batch_id", F.coalesce("same_hash", "same_id", "first.document_id").alias("kept_document_id")).distinct()


#: By what column, and then by which, the persisted tables are sorted, and the rows in a page.
_LAID_OUT = {"records": ("node", (), PAGE_ROWS), "hashes": ("h", (), PAGE_ROWS), "keys": ("prefix", ("key", "seq", "node"), PAGE_ROWS), "sketches": ("node", (), 100)}


def _laid_out(name: str, df: DataFrame) -> DataFrame:
    """Rows in key ranges (the high bits of the column) and sorted, so that a value stands in few pages."""
    column, more, _ = _LAID_OUT[name]
    return df.repartition(F.shiftright(column, 24 if name == "keys" else 56)).sortWithinPartitions(column, *more)


class History:
    """Accepted records in a folder, as versioned tables: sorted key runs, records by node, nodes by hash, word runs.

    ``take`` merges new batches into them and commits. Of a batch that asks for few values only the pages of the
    sorted parts that may hold them are read, a larger one meets the narrow key rows of all history once; texts of
    the history are never read, and word runs of those records only that look near to a new one. A new object on
    the same folder goes on where the last commit stopped.
    """

    def __init__(self, spark: SparkSession, folder: str, most_parts: int = 16) -> None:
        self.spark, self.state, self.most_parts = spark, Versions(spark, folder), most_parts

    def _found(self, name: str, column: str, wanted: DataFrame, few: bool) -> DataFrame | None:
        """Rows of a table with one of the wanted values; ``few``: whether these may be few enough to look them up."""
        table = self.state.table(name)
        if table is None:
            return None
        values = [r[0] for r in wanted.where(F.col(column).isNotNull()).select(column).distinct().limit(LOOKUPS + 1).collect()] if few else []
        if not few or len(values) > LOOKUPS:
            return table.join(wanted.select(column).distinct(), column, "left_semi")
        if not values:
            return table.limit(0)
        # neighbouring values in one scan each: a scan takes a longer list as the range from its least to its greatest
        values.sort()
        threshold, conf = "spark.sql.parquet.pushdown.inFilterThreshold", self.spark.conf
        before = conf.get(threshold)
        conf.set(threshold, str(AT_ONCE))
        try:
            return written(reduce(DataFrame.unionByName, [table.where(F.col(column).isin(values[k : k + AT_ONCE])) for k in range(0, len(values), AT_ONCE)]), name)
        finally:
            conf.set(threshold, before)

    def _put(self, name: str, df: DataFrame) -> None:
        column, more, page = _LAID_OUT[name]
        self.state.put(name, _laid_out(name, df), **{"parquet.page.row.count.limit": page})

    def take(self, batch: DataFrame) -> DataFrame:
        """(document_id, crawl_batch_id, kept_document_id) of the rows that repeat an accepted row of an earlier batch;
        the other rows become history.

        ``batch``: document_id, crawl_batch_id, content_hash, content, and seq if it holds several batches (numbers
        above all that were taken; otherwise it is the next one). Rows with null content are never cases, but are
        accepted under their hash. Copies of a row count once. Texts with fewer than three words have one run of all
        their words; texts without a word equal only those of the same characters.
        """
        number = self.state.values.get("taken", 0) + 1
        if "seq" not in batch.columns:
            batch = batch.withColumn("seq", F.lit(number))
        rows = self.state.put("sketches", sketched(batch).sortWithinPartitions("node"), **{"parquet.page.row.count.limit": _LAID_OUT["sketches"][2]})
        n = rows.count()
        few = n <= LOOKUPS
        mine = rows.select("document_id", "crawl_batch_id", "content_hash", "seq", "has_content", "node").distinct()
        fresh = rows.where(F.size("keys") > 0).groupBy("node").agg(F.min("seq").alias("seq"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
        copied = self._found("records", "node", mine, few)
        if copied is not None:
            fresh = fresh.join(copied.select("node"), "node", "left_anti")
        fresh = written(fresh, "fresh")
        # many prefixes meet the whole table in the window's own shuffle, without a join before it
        near = self._found("keys", "prefix", key_rows(fresh), few) if n * KEYS <= LOOKUPS else self.state.table("keys")
        asked, most, links, known = None, FEW, None, None
        while True:
            new, old = key_rows(fresh).withColumn("fresh", F.lit(True)), near
            if asked is not None:  # only the runs of what was left out are met again
                new = key_rows(fresh).join(asked, "node", "left").na.fill(False, ["fresh"])
                again = written(new.where("fresh").select("key").distinct(), "again")
                new, old = new.join(again, "key", "left_semi"), old if old is None else old.join(again, "key", "left_semi")
            met = written(candidates(old, new, most, n + self.state.values.get("rows", 0)), "pairs")
            pairs, left_out = met.where("a <> b"), met.where("a = b").select(F.col("a").alias("node"))
            nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            if known is None:
                hashed = self._found("hashes", "h", mine.select(F.xxhash64("content_hash").alias("h")), few)
                old = self._found("records", "node", nodes.unionByName(mine.select("node")).unionByName(hashed.select("node")), few) if hashed is not None else None
                known = written(mine if old is None else old.select(*mine.columns).unionByName(mine), "known")
            else:
                old = self._found("records", "node", nodes, few)
                known = known if old is None else written(known.unionByName(old.select(*mine.columns)).distinct(), "known")
            first = known.groupBy("node").agg(F.min(F.struct("seq", "document_id", "crawl_batch_id")).alias("first"))
            runs = rows.select("node", "runs")
            old = self._found("sketches", "node", nodes, few)
            sure = _directed(verified(pairs, (runs if old is None else runs.unionByName(old.select("node", "runs"))).where(F.octet_length("runs") > 0)), first)
            links = written(sure.unionByName(_directed(_hash_links(known), first)).distinct() if links is None else links.unionByName(sure).distinct(), "links")
            rejected = _decided(links, first)
            if left_out.isEmpty():
                break
            asked = written(left_out.join(rejected.select("node"), "node", "left_anti").join(fresh.select("node"), "node", "left_semi").withColumn("fresh", F.lit(True)), "asked")
            if asked.isEmpty():
                break
            most *= AGAIN
        kept = written(mine.join(rejected.select("node"), "node", "left_anti").join(first, "node").where(F.col("seq") == F.col("first.seq")).drop("first"), "kept")
        ours = mine.select("document_id", "crawl_batch_id").distinct()
        with ThreadPoolExecutor(4) as pool:  # none of the four needs another's result
            cases = pool.submit(lambda: written(_cases(known, rejected, first).join(ours, ["document_id", "crawl_batch_id"], "left_semi"), "cases"))
            parts = [
                pool.submit(self._put, "records", kept),
                pool.submit(self._put, "hashes", kept.where(F.col("content_hash").isNotNull()).select(F.xxhash64("content_hash").alias("h"), "node").distinct()),
                pool.submit(self._put, "keys", key_rows(fresh.join(rejected.select("node"), "node", "left_anti"))),
            ]
            cases = cases.result()
            for part in parts:
                part.result()
        self.state.commit(taken=number, rows=self.state.values.get("rows", 0) + n)
        if len(self.state.parts("keys")) > self.most_parts:
            self.compact()
        return cases

    def compact(self) -> None:
        """Merges the parts of each table into one, sorted anew."""
        for name, (_, _, page) in _LAID_OUT.items():
            if (held := self.state.table(name)) is not None:
                self.state.put(name, _laid_out(name, held), replace=True, **{"parquet.page.row.count.limit": page})
        self.state.commit()


def repeats(corpus: DataFrame, batches: DataFrame, folder: str, arrivals: int) -> DataFrame:
    """The cases of a whole table, whose batches arrive at a :class:`History` one group after the other.

    ``corpus``: document_id, crawl_batch_id, content_hash, content. ``batches``: crawl_batch_id, batch_seq. Inside a
    group, too, batches count in their order.
    """
    history = History(corpus.sparkSession, folder)
    rows = numbered(spread(corpus.select("document_id", "crawl_batch_id", "content_hash", "content")), batches, arrivals)
    return reduce(DataFrame.unionByName, [history.take(rows.where(F.col("arrival") == k).drop("arrival")) for k in range(arrivals)])
