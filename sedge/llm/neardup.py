"""Near-duplicates by an LSH forest over MinHash signatures, links confirmed on the full shingle sets.

A document's set holds its distinct word shingles as 64-bit hashes; documents of one set form a class, and one
representative of each goes on. A tree is one order of the signature's coordinates. Representatives that share its
first coordinates form a region; a region of at most REGION members is compared whole. A larger one is sorted by its
further coordinates, so that neighbours have the longest common prefixes: overlapping windows of that order are compared,
deep where the order is dense, each together with the region's hubs (the members of the most large regions, such
as the centre of a star of edited copies). Regions of the same members are compared once.

Windows and hubs only find groups early: after them, every large region is compared whole, in square tiles of two
blocks. Left out are only pairs that can't matter: of one group already, or of sizes too far apart for the limit. So
no pair that shares a region in any tree is lost, and n documents of a family below the limit cost about n x n / 2
comparisons once, not once a tree.

In a region, signatures first drop what has no partner near the limit; then all pairs of the rest are compared on
whole sets, by one matrix product, and a spanning forest of the true links leaves the task. The sets are made there,
from the texts: these are half as large when they move, and only texts that may take part move at all (narrowed()).

Defined results: a text without words, or null, has no shingle and is linked with nothing; one of fewer words than
a shingle has its whole sequence as the only one; a null doc_id stays alone; rows of one doc_id count by their texts,
and all of them are one node, so what is near any of these texts is in one group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm import common
from sedge.llm.common import Scratch, drop_copies, light_join, mixed, saved, small_batches, trim, utf8, word_hashes
from sedge.llm.components import components

TREES, COORDINATES = 16, 64
#: A region of at most REGION members is compared whole at once. Windows of larger ones have 2 x STEP members and HUBS hubs, in the order of FURTHER more coordinates.
REGION, STEP, HUBS, FURTHER = 128, 48, 4, 12
#: Trees whose large regions are sorted; those of the others are compared with the rest, whole.
ORDERS = 8
#: Members and shingles of a block, about; a tile has two.
BLOCK, WEIGHT = 512, 1 << 19
#: Words of 64 bits of a set that is broadcast, at most, and members a word.
WORDS, DENSE = 1 << 19, 2
#: The band of a block whose members are of any size.
ANY = -1
XORS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64))
ODDS = mixed(np.arange(1001, COORDINATES + 1001, dtype=np.uint64)) | np.uint64(1)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; A-Z in lower case."""
    data, offsets = utf8(texts)
    hashes, bounds = word_hashes(LOWER[data], offsets)
    with np.errstate(over="ignore"):
        size = max(len(hashes) - words + 1, 0)
        shingles = np.full(size, words, np.uint64)
        for k in range(words):
            shingles = mixed(shingles ^ hashes[k : k + size]) + np.uint64(k)
        out = []
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if e - s >= words:
                found = np.sort(shingles[s : e - words + 1])
                out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
            elif e > s:
                whole = np.full(1, e - s, np.uint64)
                for k in range(s, e):
                    whole = mixed(whole ^ hashes[k : k + 1]) + np.uint64(k - s)
                out.append(whole)
            else:
                out.append(np.zeros(0, np.uint64))
    return out




def signature(found: np.ndarray) -> np.ndarray:
    """The least of each of COORDINATES hashes over the set."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(found), 2048):
            least = np.minimum(least, ((found[None, k : k + 2048] ^ XORS[:, None]) * ODDS[:, None]).min(1))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def class_of(found: np.ndarray) -> tuple[int, int]:
    """Two sums that name a set."""
    return int(found.sum(dtype=np.uint64).view(np.int64)), int(mixed(found).sum(dtype=np.uint64).view(np.int64))


def described(df: DataFrame, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, c1, c2 (the set's class), sig for every row."""
    small_batches(df.sparkSession)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_copies()
        for batch in batches:
            sets = shingle_sets(batch.column(1).fill_null(""), words)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            c1, c2 = np.array([class_of(x) for x in sets], np.int64).reshape(-1, 2).T
            sigs = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([signature(x) for x in sets]) if sets else np.zeros(0, np.int32)), COORDINATES).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(c1), pa.array(c2), sigs], ["doc_id", "n_shingles", "c1", "c2", "sig"])
            trim()

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(describe, "doc_id long, n_shingles long, c1 long, c2 long, sig array<int>")


def first_depth(similarity: float, miss: float = 2e-5) -> int:
    """The most coordinates, up to four, at which all trees together miss a pair at the limit with probability miss at most."""
    return max([1, *(d for d in (2, 3, 4) if (1 - similarity**d) ** TREES <= miss)])


def narrowed(rows: DataFrame, few: DataFrame, *on: str) -> DataFrame:
    """rows without most of those that have no partner in few, a written table, so that fewer go through the join that must follow.

    What few has is broadcast as one bit a row in WORDS words at most. Rows that meet another's bit stay too, more of
    them the larger few is; no row with a partner goes.
    """
    words = min(WORDS, few.count() // DENSE + 1)
    name = F.xxhash64(*on)
    word, bit = F.pmod(name, F.lit(words)), F.pmod(F.shiftright(name, 40), F.lit(64)).cast("int")
    held = few.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.join(F.broadcast(held), word == F.col("_word")).where(F.call_function("shiftrightunsigned", F.col("_bits"), bit).bitwiseAND(F.lit(1)) == 1)
    return met.select(*rows.columns)


def with_sizes(rows: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """rows (tree, key, rep) of regions in sizes, with their region's size n. Regions of more than a task's share of the rows go by broadcast, or all if they are few; the rest by a shuffle."""
    if sizes.count() <= common.LIGHT:
        return rows.join(F.broadcast(sizes), ["tree", "key"])
    rows = narrowed(rows, sizes, "tree", "key")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(REGION, TREES * total // (4 * parts))  # so at most 4 x parts regions are above it
    hot = sizes.where(F.col("n") > most).collect()
    if not hot:
        return rows.join(sizes, ["tree", "key"])
    few = F.broadcast(rows.sparkSession.createDataFrame(hot, "tree int, key long, n long"))
    return rows.join(few, ["tree", "key"]).unionByName(rows.join(few, ["tree", "key"], "left_anti").join(sizes, ["tree", "key"]))


def regions(reps: DataFrame, depth: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The representatives that share a region; tree, region, rep: the small regions whole and the windows of the large ones; and tree, key, rep, n: the large regions, if any."""
    at = lambda t, i: F.get("sig", F.lit((4 * t + i) % COORDINATES))
    keys = F.array(*[F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), *[at(t, i) for i in range(depth)]).alias("key")) for t in range(TREES)])
    rows = reps.select("rep", F.explode(keys).alias("k")).select("k.tree", "k.key", "rep")
    sizes = scratch.save(rows.groupBy("tree", "key").agg(F.count("*").alias("n")).where("n > 1"))
    members = scratch.save(with_sizes(rows, sizes, reps.count()))
    met = scratch.save(members.select("rep").distinct())
    # a semi-join would be pushed below what narrows it
    reps = scratch.save(light_join(reps if met.count() <= common.LIGHT else narrowed(reps, met, "rep"), met, "rep"))
    fit = members.where(F.col("n") <= REGION).select("tree", F.col("key").alias("region"), "rep")
    large = members.where(F.col("n") > REGION)
    if large.isEmpty():
        return reps, fit, None
    return reps, fit.unionByName(neighbours(large, reps, depth, scratch)), large


def neighbours(large: DataFrame, reps: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """tree, region, rep: overlapping windows of each large region's members in the order of their further coordinates, with the region's hubs in each; of the first ORDERS trees.

    Who shares the longest prefix stands next to each other, so the depth of a window is as great as the place is dense.
    """
    place = [F.pmod(4 * F.col("tree") + depth + i, F.lit(COORDINATES)) for i in range(FURTHER)]
    scored = large.groupBy("rep").agg(F.count("*").alias("score"), F.collect_list(F.struct("tree", "key")).alias("keys")).join(reps.select("rep", "sig"), "rep")
    rows = scored.select("rep", "score", "sig", F.explode("keys").alias("k")).select("k.*", "rep", "score", "sig").where(F.col("tree") < ORDERS)
    rows = scratch.save(rows.select("tree", "key", "rep", "score", F.array(*[F.get("sig", p) for p in place]).alias("order")))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run, at = None, 0, 0  # the region being walked, its name in this part, and the rows passed
        for batch in batches:
            if not len(batch):
                continue
            tree, key, rep = (batch.column(i).to_numpy() for i in range(3))
            fresh = np.concatenate([[(int(tree[0]), int(key[0])) != last], (tree[1:] != tree[:-1]) | (key[1:] != key[:-1])])
            starts = np.flatnonzero(fresh)
            of = np.cumsum(fresh) - 1  # -1: the region goes on
            with np.errstate(over="ignore"):
                names = mixed(key[starts].view(np.uint64) ^ mixed(rep[starts].view(np.uint64) + tree[starts].astype(np.uint64)))
                name = np.where(of < 0, np.uint64(run), names[of] if len(names) else np.uint64(run))
                pos = np.arange(len(tree)) - np.where(of < 0, -at, starts[of] if len(starts) else 0)
                window = pos // STEP
                region = mixed(name + window.astype(np.uint64))
                before = mixed(name + (window - 1).astype(np.uint64))
            again = window > 0  # each row is in the window that begins at its step and in the one before
            rows_ = [np.concatenate([x, x[again]]) for x in (tree, key)]
            yield pa.RecordBatch.from_arrays([pa.array(rows_[0]), pa.array(rows_[1]), pa.array(np.concatenate([region, before[again]]).view(np.int64)), pa.array(np.concatenate([rep, rep[again]]))], ["tree", "key", "region", "rep"])
            last, run, at = (int(tree[-1]), int(key[-1])), int(name[-1]), int(pos[-1]) + 1

    ordered = rows.repartitionByRange("tree", "key", "order", "rep").sortWithinPartitions("tree", "key", "order", "rep")
    windows = scratch.save(ordered.select("tree", "key", "rep").mapInArrow(walk, "tree int, key long, region long, rep long"))
    # hubs: in each of HUBS shares of a large region, the member of the most large regions, such as the centre of a star of edited copies
    ranked = rows.withColumn("share", F.pmod(F.xxhash64("rep", "tree"), F.lit(HUBS)))
    hubs = ranked.groupBy("tree", "key", "share").agg(F.max(F.struct("score", (-F.col("rep")).alias("less"))).alias("m")).select("tree", "key", (-F.col("m.less")).alias("rep"))
    spread = windows.select("tree", "key", "region").distinct().join(hubs, ["tree", "key"])
    return windows.unionByName(spread.select("tree", "key", "region", "rep")).select("tree", "region", "rep").distinct()


def once(members: DataFrame, scratch: Scratch) -> DataFrame:
    """One of the regions that have the same members."""
    members = scratch.save(members)
    names = members.groupBy("tree", "region").agg(F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit("y"), "rep")).alias("y"), F.count("*").alias("n"))
    chosen = scratch.save(names.groupBy("x", "y", "n").agg(F.min(F.struct("tree", "region")).alias("t")).select("t.tree", "t.region"))
    return light_join(members, chosen, ["tree", "region"])


def spread_join(rows: DataFrame, few: DataFrame, on: list[str], light: bool, how: str = "inner", by: str = "rep", salts: int = 16) -> DataFrame:
    """rows joined with few, which has one row at most for each 100 or so of rows; a key may be that of most rows. light: few is small enough to be broadcast."""
    if light:
        return rows.join(F.broadcast(few), on, how)
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts))).join(few, [*on, "salt"], how).drop("salt")


def met_homes(cells: DataFrame) -> DataFrame:
    """scope, ha, hb, and ca, cb (members of theirs), ga, gb (their sizes), for every two homes of which a region has members. cells: scope, home, c, g."""
    one = lambda x: cells.select("scope", F.col("home").alias(f"h{x}"), F.col("c").cast("double").alias(f"c{x}"), F.col("g").alias(f"g{x}"))
    return light_join(one("a"), one("b"), "scope").where("ha <= hb")


def weighed(met: DataFrame) -> DataFrame:
    """ha, hb, ga, gb, merged: their regions together ask for more comparisons than the homes whole."""
    both = met.groupBy("ha", "hb").agg(F.sum(F.col("ca") * F.col("cb")).alias("apart"), F.first("ga").alias("ga"), F.first("gb").alias("gb"))
    return both.select("ha", "hb", "ga", "gb", (F.col("apart") >= F.col("ga").cast("double") * F.col("gb")).alias("merged"))


def tiles(large: DataFrame, reps: DataFrame, found: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """tree, region, rep, kin (the group found so far): tiles that hold every pair of each large region, but pairs of one kin or of sizes too far apart.

    The large regions of a family are much alike from tree to tree. So each member has a home, the largest of its
    regions; homes that comparing whole is less work than region by region are merged and compared once, and only
    regions with other homes are compared by themselves.

    What is decided comes from counts by region, home, kin and band, so that the members themselves move seldom.
    """
    # no table of regions, homes or blocks has many more than a row for each REGION members
    light = large.count() <= REGION * common.LIGHT
    # sets of a true link lie in one band of sizes or in neighbouring ones
    width = 1.001 * max(-math.log(max(similarity, 0.01)), 1e-3)
    scope = F.xxhash64("tree", "key")
    homes = large.groupBy("rep").agg(F.max(F.struct("n", "tree", "key")).alias("h"), F.collect_list(scope).alias("scopes")).select("rep", "scopes", F.xxhash64("h.tree", "h.key").alias("home"))
    members = homes.join(reps.select("rep", "n_shingles"), "rep").join(found, "rep", "left")
    rows = scratch.save(members.select(F.explode("scopes").alias("scope"), "rep", "home", "n_shingles", F.coalesce("component", "rep").alias("kin"), F.floor(F.log("n_shingles") / width).alias("band")))
    cells = scratch.save(rows.groupBy("scope", "home").agg(F.count("*").alias("c"), F.min("kin").alias("least"), F.max("kin").alias("most")))
    several = scratch.save(cells.groupBy("scope").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least != most").select("scope"))
    # a home is a region too, that of all its members
    size = cells.groupBy("home").agg(F.max("c").alias("g"))
    cells = scratch.save(spread_join(spread_join(cells, several, ["scope"], light, by="home"), size, ["home"], light, by="scope").select("scope", "home", "c", "g"))
    near = weighed(met_homes(cells)).where("merged")
    ends = near.select(F.explode(F.array(*[F.struct(F.col(f"h{x}").alias("home"), F.struct(F.col(f"g{y}").alias("g"), F.col(f"h{y}").alias("h")).alias("f")) for x, y in ("ab", "ba")])).alias("e")).select("e.*")
    families = scratch.save(ends.groupBy("home").agg(F.max("f").alias("f")).select("home", F.col("f.h").alias("family")))
    cells = scratch.save(spread_join(cells, families, ["home"], light, "left", by="scope").withColumn("family", F.coalesce("family", "home")))
    size = cells.groupBy("family", "home").agg(F.first("g").alias("g")).groupBy("family").agg(F.sum("g").alias("g"))
    cells = cells.groupBy("scope", "family").agg(F.sum("c").alias("c")).join(size, "family").select("scope", F.col("family").alias("home"), "c", "g")
    met = scratch.save(met_homes(cells))
    met = scratch.save(met.join(weighed(met).drop("ga", "gb"), ["ha", "hb"]).select("scope", "ha", "hb", "merged"))
    scopes = met.groupBy("scope").agg(F.min("merged").alias("covered"))
    # scope 0: homes whole; home 0: regions by themselves
    nought = F.lit(0).cast("long")
    meets = met.join(scopes, "scope").select(F.when(F.col("covered"), nought).otherwise(F.col("scope")).alias("scope"), *[F.when(F.col("covered"), F.col(h)).otherwise(nought).alias(h) for h in ("ha", "hb")])
    meets = scratch.save(meets.distinct())
    sides = meets.select("scope", F.explode(F.array_distinct(F.array("ha", "hb"))).alias("home")).distinct()
    rows = spread_join(spread_join(rows, several, ["scope"], light), families, ["home"], light, "left").withColumn("home", F.coalesce("family", "home")).drop("family")
    rows = rows.withColumn("at", F.explode(F.array(F.struct(nought.alias("scope"), "home"), F.struct("scope", nought.alias("home"))))).select("at.*", "rep", "kin", "band", "n_shingles")
    rows = scratch.save(spread_join(rows, sides, ["scope", "home"], light).distinct())
    # a kin of many members has blocks of its own, which needn't meet each other
    counts = scratch.save(rows.groupBy("scope", "home", "kin", "band").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w")))
    many = scratch.save(counts.groupBy("scope", "home", "kin").agg(F.sum("n").alias("n")).where(F.col("n") >= BLOCK).select("scope", "home", "kin", F.lit(True).alias("pure")))
    lot = ["scope", "home", "pure", "of"]
    in_lots = lambda x: x.withColumn("pure", F.coalesce("pure", F.lit(False))).withColumn("of", F.when(F.col("pure"), F.col("kin")).otherwise(0))
    shares = in_lots(counts.join(many, ["scope", "home", "kin"], "left")).groupBy(*lot, "band").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    shares = scratch.save(shares)
    # what doesn't fill a block isn't parted by bands
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / WEIGHT))
    parted = shares.groupBy(lot).agg(blocks(F.sum("n"), F.sum("w")).alias("all")).where(F.col("all") > 1).drop("all")
    parted = shares.join(parted, lot).select(*lot, "band", blocks(F.col("n"), F.col("w")).alias("blocks"))
    rows = in_lots(spread_join(rows, many, ["scope", "home", "kin"], light, "left"))
    rows = spread_join(rows, parted, [*lot, "band"], light, "left").withColumn("band", F.when(F.col("blocks").isNull(), ANY).otherwise(F.col("band")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1))))
    rows = scratch.save(rows.select("scope", F.struct("home", "pure", "of", "band", "block").alias("at"), "rep", "kin"))
    held = rows.select("scope", "at").distinct()
    a, b = F.col("a"), F.col("b")
    side = lambda name, home: held.select("scope", F.col("at").alias(name), F.col("at.home").alias(home))
    pairs = meets.join(side("a", "ha"), ["scope", "ha"]).join(side("b", "hb"), ["scope", "hb"])
    close = (F.abs(a["band"] - b["band"]) <= 1) | (a["band"] == ANY) | (b["band"] == ANY)
    pairs = pairs.where(((F.col("ha") < F.col("hb")) | (a <= b)) & close & ~(a["pure"] & b["pure"] & (a["of"] == b["of"])))
    pairs = pairs.select("scope", F.xxhash64("scope", "a", "b").alias("region"), F.explode(F.array_distinct(F.array("a", "b"))).alias("at"))
    return pairs.join(rows, ["scope", "at"]).select(F.lit(TREES).alias("tree"), "region", "rep", "kin")


def by_region(rows: DataFrame, columns: list[str], schema: str, work: Callable[[int, int, pa.Table], pa.RecordBatch | None]) -> DataFrame:
    """work(tree, region, rows) on each region; whole regions are dealt out by range, so that parts are even."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_copies()
        held: list[pa.Table] = []

        def finish(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key = np.stack([table["tree"].to_numpy().astype(np.int64), table["region"].to_numpy()], 1)
            cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])).tolist()
            for s, e in zip(cuts, [*cuts[1:], len(table)], strict=True):
                if e - s > 1 and (out := work(int(key[s, 0]), int(key[s, 1]), table.slice(s, e - s))) is not None:
                    yield out

        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            tree, region = table["tree"].to_numpy(), table["region"].to_numpy()
            same = (tree == tree[-1]) & (region == region[-1])
            last = len(table) - int(np.argmin(same[::-1])) if not same.all() else 0
            if last:
                yield from finish(pa.concat_tables([*held, table.slice(0, last)]))
                held = []
                trim()
            held.append(table.slice(last))
        if held:
            yield from finish(pa.concat_tables(held))

    return rows.select("tree", "region", *columns).repartitionByRange("tree", "region").sortWithinPartitions("tree", "region", "rep").mapInArrow(walk, schema)


def plausible(members: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """tree, region, rep, kin, least, c1: the members that have a partner of another kin in their region whose signature is within five deviations of the limit; of regions that are left with the same members, one."""
    cut = similarity - 5 * math.sqrt(similarity * (1 - similarity) / COORDINATES)

    def near(tree: int, region: int, table: pa.Table) -> pa.RecordBatch | None:
        sig = table["sig"].combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
        rep, kin = table["rep"].to_numpy(), table["kin"].to_numpy()
        good = np.zeros(len(sig), bool)
        for i in range(len(sig)):
            alike = (sig == sig[i]).sum(1) >= cut * COORDINATES
            good[i] = (alike & (kin != kin[i])).any()
        if not good.any():
            return None
        left = table.drop_columns(["tree", "region", "sig"]).filter(pa.array(good)).combine_chunks().to_struct_array().combine_chunks()
        names = mixed(rep[good].view(np.uint64))
        x, y = (np.array([f(h)], np.uint64).view(np.int64) for f, h in ((np.bitwise_xor.reduce, names), (np.add.reduce, mixed(names))))
        return pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([region]), pa.array(x), pa.array(y), pa.ListArray.from_arrays(pa.array([0, len(left)], pa.int32()), left)], ["tree", "region", "x", "y", "members"])

    rows = by_region(members.join(reps.select("rep", "least", "c1", "sig"), "rep"), ["rep", "kin", "least", "c1", "sig"], "tree int, region long, x long, y long, members array<struct<rep: long, kin: long, least: long, c1: long>>", near)
    chosen = rows.groupBy("x", "y", F.size("members").alias("n")).agg(F.first(F.struct("tree", "region", "members")).alias("t"))
    return chosen.select("t.tree", "t.region", F.explode("t.members").alias("m")).select("tree", "region", "m.*")


def true_links(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b: a spanning forest of the links between kins within each region, by whole sets (100 x intersection >= percent x union)."""

    def link(tree: int, region: int, table: pa.Table) -> pa.RecordBatch | None:
        rep, kin = table["rep"].to_numpy(), table["kin"].to_numpy()
        sets_ = [x for k in range(0, len(table), 128) for x in shingle_sets(table["text"].slice(k, 128).combine_chunks(), words)]
        n = len(sets_)
        size = np.fromiter(map(len, sets_), np.int64, n)
        flat, owner = np.concatenate(sets_), np.repeat(np.arange(n), size)
        names, at, often = np.unique(flat, return_inverse=True, return_counts=True)
        shared = often[at] > 1
        columns = np.cumsum(often > 1) - 1
        at, owner = columns[at[shared]], owner[shared]
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        both = np.zeros((n, n), np.float64)
        used = int(at[-1]) + 1 if len(at) else 0
        for k in range(0, used, 8192):
            s, e = np.searchsorted(at, [k, k + 8192])
            m = np.zeros((n, min(8192, used - k)), np.float32)
            m[owner[s:e], at[s:e] - k] = 1
            both += m @ m.T
        linked = 100 * both >= percent * (size[:, None] + size[None] - both)
        linked &= (both > 0) & (kin[:, None] != kin[None])
        a, b, seen = [], [], np.zeros(n, bool)
        for start in range(n):
            if seen[start]:
                continue
            seen[start] = True
            front = linked[start] & ~seen
            while front.any():
                a += [int(rep[start])] * int(front.sum())
                b += rep[front].tolist()
                seen |= front
                front = linked[front].any(0) & ~seen
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None

    return by_region(members.join(texts, ["least", "c1"]), ["rep", "kin", "text"], "a long, b long", link)


def texts_of(df: DataFrame, members: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """least, c1, text, once each, for the members' doc_id (least) and class, and for a few others. Of several texts of one doc_id, the class tells which is meant."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c1 = [class_of(x)[0] for x in shingle_sets(batch.column(1).fill_null(""), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c1, pa.int64()), batch.column(1)], ["least", "c1", "text"])
            trim()

    rows = narrowed(df.select(F.col(doc_id).cast("long").alias("least"), F.col(text).alias("text")), members, "least")
    return rows.mapInArrow(name, "least long, c1 long, text string").dropDuplicates(["least", "c1"])


def near_duplicates(df: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links), kept (doc_id = component_id) for every row."""
    docs = saved(described(df, words, doc_id, text), "sets")
    scratch = Scratch(df.sparkSession, "regions")
    shared = ["c1", "c2", "n_shingles"]
    known = docs.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # a class for each set, numbered once and written
    classes = known.groupBy(shared).agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig")).withColumn("rep", F.monotonically_increasing_id())
    classes = scratch.save(classes)
    reps, parts, large = regions(classes, first_depth(similarity), scratch)
    classes = classes.drop("sig")

    def links_of(candidates: DataFrame) -> DataFrame:
        members = scratch.save(plausible(candidates, reps, similarity))
        return true_links(members, texts_of(df, members, words, doc_id, text), words, round(100 * similarity))

    links = links_of(once(parts, scratch).withColumn("kin", F.col("rep")))
    # texts of one doc_id are one node
    several = scratch.save(known.groupBy("doc_id").agg(F.min("c1").alias("a"), F.max("c1").alias("b")).where("a != b").select("doc_id"))
    if not several.isEmpty():
        texts = known.join(several, "doc_id").join(classes, shared).select("doc_id", "rep").distinct()
        links = links.unionByName(texts.join(texts.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b"))
    found = components(links).withColumnRenamed("node", "rep")
    if large is not None:
        more = scratch.save(links_of(tiles(large, reps, found, similarity, scratch)))
        if not more.isEmpty():
            found = components(found.select(F.col("rep").alias("a"), F.col("component").alias("b")).unionByName(more)).withColumnRenamed("node", "rep")
    named = light_join(classes, found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = saved(named.join(least, "component").select(*shared, "component_id"), "groups")
    scratch.clear()
    out = docs.drop("sig").join(named, shared, "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
