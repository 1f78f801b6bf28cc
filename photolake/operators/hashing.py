"""Perceptual hashes and the exact Hamming join."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from photolake.functions.columns import hamming, packed_luma
from photolake.session import cut

SIDE, LOW = 32, 8
#: Members of a bucket that meet in one task.
CHUNK = 4096
#: Scaled cosines, [frequency, cell].
BASIS = np.array([[round(math.cos(math.pi * f * (2 * x + 1) / (2 * SIDE)) * 16384) for x in range(SIDE)] for f in range(LOW)], dtype=np.int64)


def _weights(first: int, n: int, size: int) -> np.ndarray:
    """[frequency, place] for places first .. first + n - 1 of an axis of ``size``: the scaled cosine of each of the SIDE cells, times
    the place's overlap with the cell in units of 1 / SIDE."""
    cell, place = np.arange(SIDE, dtype=np.int64), np.arange(first, first + n, dtype=np.int64)[:, None]
    overlap = np.maximum(np.minimum((cell + 1) * size, (place + 1) * SIDE) - np.maximum(cell * size, place * SIDE), 0)
    return BASIS @ overlap.T


def _tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each tile's share of the low LOW x LOW coefficients."""
    known: dict[tuple[int, int, int], np.ndarray] = {}

    def weights(*key: int) -> np.ndarray:
        if len(known) > 4096:
            known.clear()
        return known.setdefault(key, _weights(*key)) if key not in known else known[key]

    for batch in batches:
        px = batch.column(7)
        values, offsets = px.values.to_numpy(), px.offsets.to_numpy()
        gray = (values.view(np.uint32) >> np.uint32(24)).astype(np.int64)
        sums = np.zeros((len(px), LOW * LOW), dtype=np.int64)
        places = zip(*(batch.column(i).to_pylist() for i in range(1, 7)))
        for i, (width, height, y0, x0, w, h) in enumerate(places):
            grid = gray[offsets[i]:offsets[i + 1]].reshape(h, w)
            sums[i] = (weights(y0, h, height) @ grid @ weights(x0, w, width).T).reshape(-1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(
            pa.array(np.arange(len(px) + 1) * LOW * LOW, pa.int32()), pa.array(sums.reshape(-1)))], names=["image_id", "c"])


def phash(tiles: DataFrame) -> DataFrame:
    """64-bit perceptual hash: 32x32 gray (area-weighted), 2-D cosine transform, low 8x8 block against its median.

    Resampling and transform are linear and separable, so every tile adds its pixels times row and column weights: 64 exact integers a
    tile, which are all that moves. The common factor 1 / (width * height) changes no bit and is left out.
    """
    columns = ["image_id", "width", "height", "y0", "x0", "w", "h", "px"]
    shares = tiles.select(*columns).mapInArrow(_tile_sums, "image_id bigint, c array<bigint>")
    block = shares.groupBy("image_id").agg(*[F.sum(F.get("c", F.lit(i)).cast("decimal(20,0)")).alias(f"c{i}") for i in range(LOW * LOW)])
    return _bits_over_median(block.select("image_id", F.array(*[f"c{i}" for i in range(LOW * LOW)]).alias("g")))


def _bits_over_median(values: DataFrame) -> DataFrame:
    """(image_id, h): bit 63 - i is set where value i of 64 exceeds the median."""
    def bits(ranked: Column) -> Column:
        doubled = F.get(ranked, F.lit(31)) + F.get(ranked, F.lit(32))
        return F.aggregate(F.transform("g", lambda v, i: F.when(2 * v > doubled, F.call_function(
            "shiftleft", F.lit(1).cast("long"), 63 - i)).otherwise(F.lit(0).cast("long"))),
            F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    # A list of one binds the sorted values, which would otherwise be sorted again for every bit.
    return values.select("image_id", F.get(F.transform(F.array(F.sort_array("g")), bits), F.lit(0)).alias("h"))


def median_hash(rasters: DataFrame) -> DataFrame:
    """64-bit hash of an 8x8 raster: one bit per pixel brighter than the median. A map over rasters."""
    return _bits_over_median(rasters.select("image_id", F.transform("px", packed_luma).alias("g")))


# --- Hamming join ---------------------------------------------------------------------------

def covering_masks(k: int, blocks: int) -> list[int]:
    """Masks of all choices of ``blocks - k`` of so many blocks: two hashes within ``k`` bits agree under at least one."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(choice) for choice in combinations(parts, blocks - k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _keyed(hashes: DataFrame, masks: Sequence[int]) -> DataFrame:
    """(h, t, key): a hash under every mask. A map."""
    keys = F.array(*[F.col("h").bitwiseAND(F.lit(m).cast("long")) for m in masks])
    return hashes.select("h", F.posexplode(keys).alias("t", "key"))


def hamming_pairs(left: DataFrame, right: DataFrame | None, k: int, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(h1, h2, hamming) for distinct hashes within ``k`` bits; ``right=None`` joins a frame to itself.

    Exact, by equi-joins on covering keys. More ``blocks`` make longer keys and more of them: C(blocks, k) rows a hash, keys of about
    64 * (blocks - k) / blocks bits; the default is k + 3. A bucket is salted by its size: its left members are dealt to
    chunks, its right members go to each, so a crowded bucket is spread over as many tasks. Every pair is reported once, under
    the first mask on which it agrees, so there is no final distinct. Sizes are estimated before a hash becomes C(blocks, k) rows, so
    the joins are asked to shuffle: one that looks small would be broadcast with all its keys, from the driver.
    """
    masks = covering_masks(k, blocks or k + 3)
    self_join = right is None
    lk = _keyed(left, masks)
    rk = lk if self_join else _keyed(right, masks)
    sizes = rk.groupBy("t", "key").agg(F.count("*").alias("n"))
    if self_join:
        sizes = sizes.where("n > 1")
    sizes = cut(sizes.select("t", "key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")))
    a = lk.join(sizes.hint("merge"), ["t", "key"]).select(
        "t", "key", F.pmod(F.xxhash64("h"), F.col("chunks")).cast("int").alias("chunk"), F.col("h").alias("h1"))
    b = rk.join(sizes.hint("merge"), ["t", "key"]).select(
        "t", "key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("h").alias("h2"))
    order = F.col("h1") < F.col("h2") if self_join else F.lit(True)
    gap = F.col("h1").bitwiseXOR(F.col("h2"))
    close = a.join(b.hint("merge"), ["t", "key", "chunk"]).where(order & (hamming(F.col("h1"), F.col("h2")) <= k))
    earlier = F.slice(F.array(*[F.lit(m).cast("long") for m in masks]), F.lit(1), F.col("t"))
    return (close.where(F.forall(earlier, lambda m: gap.bitwiseAND(m) != 0))
            .select("h1", "h2", hamming(F.col("h1"), F.col("h2")).alias("hamming")))


def representatives(hashes: DataFrame) -> DataFrame:
    """(h, rep, copies): one row per distinct hash, its smallest image and how many share it."""
    return hashes.groupBy("h").agg(F.min("image_id").alias("rep"), F.count("*").alias("copies"))


def hash_similarity_join(hashes: DataFrame, k: int = 6, blocks: int | None = None) -> DataFrame:
    """Near-duplicate links (image_1, image_2, hamming).

    Images sharing a hash are linked to their smallest image (distance 0); different hashes within
    ``k`` bits are linked between their smallest images. That states every near pair without writing
    all pairs of a large group of copies: joining both ends back on the hash expands it.
    """
    reps = cut(representatives(hashes))
    near = hamming_pairs(reps.select("h"), None, k, blocks)
    a = reps.select(F.col("h").alias("h1"), F.col("rep").alias("r1"))
    b = reps.select(F.col("h").alias("h2"), F.col("rep").alias("r2"))
    links = near.join(a, "h1").join(b, "h2").select(F.least("r1", "r2").alias("image_1"),
                                                    F.greatest("r1", "r2").alias("image_2"), "hamming")
    star = (hashes.join(reps.where("copies > 1"), "h").where("image_id <> rep")
            .select(F.col("rep").alias("image_1"), F.col("image_id").alias("image_2"), F.lit(0).alias("hamming")))
    return links.unionByName(star)


def existing_duplicates(incoming: DataFrame, stored: DataFrame, k: int = 5, blocks: int | None = None) -> DataFrame:
    """Incoming images within ``k`` bits of any stored image."""
    new, old = incoming.select("h").distinct(), stored.select("h").distinct()
    hit = hamming_pairs(new, old, k, blocks).select(F.col("h1").alias("h")).distinct()
    return incoming.join(hit, "h", "left_semi")


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hi, lo, free) in order of hi -> (node, leads) of all nodes that can be decided from free ones and from nodes decided here."""
    leads: dict[int, bool] = {}
    node, claimed, unknown = None, False, False

    def decide(found: list[tuple[int, bool]]) -> None:
        if node is not None and (claimed or not unknown):
            leads[node] = not claimed
            found.append((node, not claimed))

    for batch in batches:
        found: list[tuple[int, bool]] = []
        for hi, lo, free in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if hi != node:
                decide(found)
                node, claimed, unknown = hi, False, False
            known = True if free else leads.get(lo)
            claimed |= known is True
            unknown |= known is None
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.bool_())],
                                         names=["node", "leads"])
    last: list[tuple[int, bool]] = []
    decide(last)
    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in last], pa.int64()), pa.array([x for _, x in last], pa.bool_())],
                                     names=["node", "leads"])


def greedy_leaders(edges: DataFrame) -> DataFrame:
    """(lo, hi), lo < hi -> node: those that lead when nodes are visited in order and each unclaimed one claims its neighbours.

    A node is decided once its lower neighbours are. Each round places undecided nodes by range, and a task decides, in order, every node
    that depends on decided ones and on others of its own range: a chain is followed through a whole range in one round, so rounds are as many
    as ranges that a chain crosses, not as its links. A task keeps one flag for each node it has decided.
    """
    open_edges, leaders = edges, edges.select(F.col("lo").alias("node")).limit(0)
    while not open_edges.isEmpty():
        nodes = open_edges.select("hi").distinct()
        flagged = open_edges.join(nodes.select(F.col("hi").alias("lo"), F.lit(False).alias("free")), "lo", "left").select(
            "hi", "lo", F.coalesce("free", F.lit(True)).alias("free"))  # a node without undecided lower neighbours leads
        settled = flagged.repartitionByRange("hi").sortWithinPartitions("hi", "lo").mapInArrow(_settle, "node bigint, leads boolean")
        done = cut(settled.unionByName(flagged.where("free").select(F.col("lo").alias("node"), F.lit(True).alias("leads")).distinct()))
        left = cut(open_edges.join(done.select(F.col("node").alias("hi")), "hi", "left_anti")
                   .join(done.where("NOT leads").select(F.col("node").alias("lo")), "lo", "left_anti").select("lo", "hi"))
        # All lower neighbours were decided elsewhere, and none of them leads.
        ends = left.select(F.explode(F.array("lo", "hi")).alias("node"))
        lone = nodes.select(F.col("hi").alias("node")).join(done, "node", "left_anti").join(ends, "node", "left_anti")
        leaders = cut(leaders.unionByName(done.where("leads").select("node")).unionByName(lone))
        open_edges = left
    return leaders.distinct()


def duplicate_groups(hashes: DataFrame, k: int = 6, blocks: int | None = None) -> DataFrame:
    """Greedy duplicate groups (leader, image_id), groups of one left out.

    Same result as visiting images by id, letting each unclaimed one lead and claim every unclaimed
    image within ``k`` bits. Images sharing a hash have the same neighbours, so only their smallest takes part and the rest follow it.
    """
    reps = cut(representatives(hashes))
    near = hamming_pairs(reps.select("h"), None, k, blocks)
    a = reps.select(F.col("h").alias("h1"), F.col("rep").alias("r1"))
    b = reps.select(F.col("h").alias("h2"), F.col("rep").alias("r2"))
    edges = cut(near.join(a, "h1").join(b, "h2").select(F.least("r1", "r2").alias("lo"), F.greatest("r1", "r2").alias("hi")))
    leads = cut(greedy_leaders(edges))
    claims = (edges.join(leads.select(F.col("node").alias("lo")), "lo", "left_semi")
              .groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("boss")).join(leads, "node", "left_anti"))
    leader = reps.select(F.col("rep").alias("node"), "h").join(claims, "node", "left").select("h", F.coalesce("boss", "node").alias("leader"))
    members = hashes.join(leader, "h").select("leader", "image_id")
    large = members.groupBy("leader").agg(F.count("*").alias("n")).where("n > 1")
    return members.join(large, "leader")


def exact_duplicates(images: DataFrame, content: str = "content") -> DataFrame:
    """Groups of identical content: (kept, image_id). The bytes are read once, only digests travel."""
    digests = cut(images.select("image_id", F.sha2(F.col(content), 256).alias("digest")))
    groups = digests.groupBy("digest").agg(F.min("image_id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    return digests.join(groups, "digest").select("kept", "image_id", "n")
