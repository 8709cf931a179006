"""A prefix trie of conversations, with sums over its subtrees by centroid decomposition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.joins import join_to_one
from folioscan.operators.ranking import number_rows
from folioscan.session import written

# Most nodes and members of a component that one task takes apart, and the most components split by Spark at a time.
PER_TASK = 50_000
MOST_COMPONENTS = 100_000
# Depths of one conversation that are looked up together.
BLOCK = 1 << 16
LANES = ["k1", "k2"]


def content_lanes(role: Column, text: Column) -> list[Column]:
    """Two hashes of a turn; null role or text count as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return [F.xxhash64(role, text).alias("c1"), F.xxhash64(F.lit(1), text, role).alias("c2")]


def ordered_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, num, c1, c2, bytes): turns of each conversation numbered from 1 by ``turn``, null first, then by hash of the content.

    Texts are read once and go no further than their hashes and UTF-8 sizes. Rows without a conversation take no part.
    """
    rows = turns.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        *content_lanes(F.col(role), F.col(text)),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"),
    )
    return number_rows(rows, ["turn", "c1", "c2"], "num", group=["conv"]).drop("turn")


def with_shared_heads(turns: DataFrame, share: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of conversations that open with turns of another one.

    Conversation c has the first h turns of c - c % share, as many as there are, then its own after its first h, where h is
    crc32 of the decimal c modulo ``most``. ``lengths`` is (conv, size), turnless conversations included.
    """
    own = written(turns, "trie-turns")
    counts = written(own.groupBy("conv").agg(F.count("*").alias("own")), "trie-counts")
    base = counts.select(F.col("conv").alias("base"), F.col("own").alias("of_base"))
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    plan = counts.select("conv", "own", head.alias("head"), (F.col("conv") - F.col("conv") % share).alias("base")).join(base, "base", "left")
    taken = F.least("head", F.coalesce("of_base", F.lit(0)))
    plan = plan.select("conv", "own", "head", "base", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("size"))
    plan = written(plan, "trie-plan")
    columns = ["c1", "c2", "bytes", "size"]
    heads = own.filter(F.col("num") < most).withColumnRenamed("conv", "base").join(plan.select("conv", "base", "taken", "size"), "base")
    heads = heads.filter("num <= taken").select("conv", F.col("num").alias("depth"), *columns)
    # A conversation may hold a great share of all turns.
    rest = join_to_one(own, plan.drop("base"), ["conv"], "own").filter("num > head")
    rest = rest.select("conv", (F.col("num") - F.col("head") + F.col("taken")).alias("depth"), *columns)
    return heads.unionByName(rest), plan.select("conv", "size")


def prefix_lanes(turns: DataFrame) -> DataFrame:
    """Add k1, k2, which tell the sequence of turns up to ``depth``, and p1, p2, those of the sequence before.

    Each is the exclusive or of hashes of (depth, content): a running value that range partitions sum up apart, so that no
    task holds a long conversation. Equal sequences of one depth have equal values; others differ but for a chance of 2^-128.
    """
    marks = [F.xxhash64("depth", c).alias(k) for c, k in (("c1", "t1"), ("c2", "t2"))]
    ranged = turns.select("conv", "depth", "bytes", "size", *marks).repartitionByRange("conv", "depth")
    parts = written(ranged.withColumn("part", F.spark_partition_id()), "trie-ranged")
    sums = parts.groupBy("part", "conv").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", "conv", *[F.coalesce(F.bit_xor(s).over(earlier), F.lit(0)).alias(s) for s in ("s1", "s2")])
    inside = Window.partitionBy("part", "conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    runs = parts.join(starts, ["part", "conv"])
    lanes = [F.bit_xor(t).over(inside).bitwiseXOR(F.col(s)).alias(k) for t, s, k in (("t1", "s1", "k1"), ("t2", "s2", "k2"))]
    rows = runs.select("conv", "depth", "bytes", "size", "t1", "t2", *lanes)
    before = [F.col(k).bitwiseXOR(F.col(t)).alias(p) for k, t, p in (("k1", "t1", "p1"), ("k2", "t2", "p2"))]
    return rows.select("conv", "depth", "bytes", "size", *LANES, *before)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(rep, depth, ends_sha256) of (rep, depth, conv): SHA-256 of the ids joined by commas, numerically ascending.

    The digest takes its bytes in order, so the ids of a node are sorted (with spilling) and streamed through one task, which
    holds a batch of them at a time.
    """
    kind = "rep long, depth long, ends_sha256 string"

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for batch in batches:
            out = []
            cuts = np.flatnonzero((batch["rep"].values[1:] != batch["rep"].values[:-1]) | (batch["depth"].values[1:] != batch["depth"].values[:-1])) + 1
            for ids in np.split(np.arange(len(batch)), cuts):
                if not len(ids):
                    continue
                here = (int(batch["rep"].iloc[ids[0]]), int(batch["depth"].iloc[ids[0]]))
                joined = ",".join(map(str, batch["conv"].iloc[ids].tolist())).encode()
                if here == node:
                    state.update(b"," + joined)
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = here, hashlib.sha256(joined)
            yield pd.DataFrame(out, columns=["rep", "depth", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=["rep", "depth", "ends_sha256"])

    return ends.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "conv").mapInPandas(digest, kind)


# --- centroid decomposition ------------------------------------------------------------------


def subtree_sums(weight: np.ndarray, depth: np.ndarray, parent: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each node of a forest the sum of ``values`` (nodes x columns) over its subtree, itself included.

    ``weight`` is that of a node's subtree, each node counting at least 1, and ``parent`` a position or -1. All components are
    split at their centroids at once: a component's nodes with half of its weight or more below them form the path from its
    top to its centroid, the deepest. Each node of the path gets the total of what lies below the centroid in the component;
    the centroid goes, and what falls apart is taken on. Every split halves the weight, so a node gets few totals.
    """
    n = len(weight)
    sums = np.zeros_like(values)
    weight, parent = weight.copy(), parent.copy()
    alive = np.arange(n)
    while len(alive):
        # The top of each node's component, by doubling steps towards it.
        top = np.where(parent < 0, np.arange(n), parent)
        while True:
            further = top[top]
            if (further[alive] == top[alive]).all():
                break
            top = further
        comp = top[alive]
        on_path = alive[2 * weight[alive] >= weight[comp]]
        deepest = np.full(n, -1, depth.dtype)
        np.maximum.at(deepest, top[on_path], depth[on_path])
        centroid = on_path[depth[on_path] == deepest[top[on_path]]]
        of_comp = np.full(n, -1)
        of_comp[top[centroid]] = centroid
        # Cutting above and below the centroid leaves it alone and its children's components as their own.
        is_centroid = np.zeros(n, bool)
        is_centroid[centroid] = True
        below = parent >= 0
        below[below] = is_centroid[parent[below]]
        cut = np.where(below | is_centroid, -1, parent)
        piece = np.where(cut < 0, np.arange(n), cut)
        while True:
            further = piece[piece]
            if (further[alive] == piece[alive]).all():
                break
            piece = further
        under = alive[below[piece[alive]] | is_centroid[alive]]
        totals = np.zeros_like(values)
        np.add.at(totals, top[under], values[under])
        sums[on_path] += totals[top[on_path]]
        above = on_path[~is_centroid[on_path]]
        weight[above] -= weight[of_comp[top[above]]]
        parent = cut
        alive = alive[~is_centroid[alive]]
    return sums


def _local_sums(batches: Iterator[pd.DataFrame], columns: list[str], chunk: int) -> Iterator[pd.DataFrame]:
    """Sums of whole components, which lie together in the order of rows; a few at a time."""

    def solve(df: pd.DataFrame) -> pd.DataFrame:
        place = pd.MultiIndex.from_arrays([df["rep"], df["depth"]])
        parent = place.get_indexer(pd.MultiIndex.from_arrays([df["parent"].fillna(-1).astype("int64"), df["depth"] - 1]))
        is_top = (df["rep"].values == df["comp_rep"].values) & (df["depth"].values == df["comp_depth"].values)
        found = subtree_sums(df["below"].to_numpy(np.int64), df["depth"].to_numpy(np.int64), np.where(is_top, -1, parent), df[columns].to_numpy(np.int64))
        out = df[["rep", "depth"]].copy()
        for i, c in enumerate(columns):
            out["sum_" + c] = df["sum_" + c].values + found[:, i]
        return out

    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if len(held) >= chunk:
            last = (held["comp_rep"] == held["comp_rep"].iloc[-1]) & (held["comp_depth"] == held["comp_depth"].iloc[-1])
            if not last.all():
                yield solve(held[~last].reset_index(drop=True))
                held = held[last].reset_index(drop=True)
    if held is not None and len(held):
        yield solve(held)


def rollup(nodes: DataFrame, paths: DataFrame, columns: list[str], per_task: int = PER_TASK) -> DataFrame:
    """(rep, depth, sum_<column>...): sums over the subtree of each node of one tree.

    ``nodes`` is (rep, depth, parent, below, ...): a node is named by its least member and depth, ``parent`` is the least member
    of the node above, and ``below`` the sum of members over the subtree, which is the weight. ``paths`` is (conv, depth, rep,
    parent): the node of each member at each depth, and the one above it.

    Components heavier than ``per_task`` are split at their centroids by Spark, all at once in each round; a node learns
    the piece it falls into from its least member's path. Each round halves them, so rounds grow with the logarithm of
    the table, however deep the tree is. At most ``MOST_COMPONENTS`` are split at a time (``per_task`` grows where needed),
    which bounds what is broadcast. Lighter components are taken apart by single tasks in the same way.
    """
    comp, key = ["comp_rep", "comp_depth"], ["rep", "depth"]
    sums = ["sum_" + c for c in columns]
    first = nodes.select(*key, "parent", "below", *columns).select(
        "*", *[F.lit(0).cast("long").alias(s) for s in sums], F.lit(0).cast("long").alias("comp_depth")
    )
    top = nodes.filter("depth = 0").select("rep", "below").first()
    if top is None:
        return first.select(*key, *sums)
    limit = max(per_task, top["below"] // MOST_COMPONENTS)
    active = written(first.withColumn("comp_rep", F.lit(top["rep"]).cast("long")), "trie-components")
    done, light = [], []
    while True:
        # The top of a component has all of it below.
        sizes = written(active.groupBy(*comp).agg(F.max("below").alias("size")), "trie-sizes")
        heavy = sizes.filter(F.col("size") > limit)
        light.append(active.join(F.broadcast(heavy.select(*comp)), comp, "left_anti"))
        if heavy.isEmpty():
            break
        sized = active.join(F.broadcast(heavy), comp)
        deepest = F.max_by(F.struct(F.col("rep").alias("at_rep"), F.col("depth").alias("at_depth"), F.col("below").alias("at_below")), "depth").alias("at")
        centroids = written(sized.filter("2 * below >= size").groupBy(*comp).agg(deepest, F.first("size").alias("size")).select(*comp, "size", "at.*"), "trie-centroids")
        held = active.join(F.broadcast(centroids), comp).withColumn("block", F.floor(F.col("depth") / F.lit(BLOCK)))
        asked = ["rep", *comp, "block"]
        lookups = held.filter("depth > at_depth").select(*asked, "at_rep", "at_depth").distinct()
        children = paths.select(F.col("conv").alias("rep"), F.col("depth").alias("child_depth"), F.col("rep").alias("child"), F.col("parent").alias("child_parent"))
        found = lookups.withColumn("child_depth", F.col("at_depth") + 1).join(children, ["rep", "child_depth"]).filter("child_parent = at_rep")
        split = held.join(found.select(*asked, "child"), asked, "left")
        # A node as deep as the centroid or higher is not below it, whatever its member's path is.
        split = split.withColumn("child", F.when(F.col("depth") > F.col("at_depth"), F.col("child")))
        split = written(split.withColumn("is_centroid", (F.col("rep") == F.col("at_rep")) & (F.col("depth") == F.col("at_depth"))), "trie-split")
        totals = split.filter("child is not null or is_centroid").groupBy(*comp).agg(*[F.sum(c).alias("total_" + c) for c in columns])
        on_path = 2 * F.col("below") >= F.col("size")
        shared = split.join(F.broadcast(totals), comp)
        moved = shared.select(
            *key,
            "parent",
            F.when(on_path & ~F.col("is_centroid"), F.col("below") - F.col("at_below")).otherwise(F.col("below")).alias("below"),
            *columns,
            *[(F.col(s) + F.when(on_path, F.col("total_" + c)).otherwise(0)).alias(s) for s, c in zip(sums, columns, strict=True)],
            F.coalesce("child", "comp_rep").alias("comp_rep"),
            F.when(F.col("child").isNotNull(), F.col("at_depth") + 1).otherwise(F.col("comp_depth")).alias("comp_depth"),
            "is_centroid",
        )
        moved = written(moved, "trie-components")
        done.append(moved.filter("is_centroid").select(*key, *sums))
        active = moved.filter("not is_centroid").drop("is_centroid")
    local = light[0]
    for more in light[1:]:
        local = local.unionByName(more)
    kind = ", ".join(["rep long", "depth long", *[f"{s} long" for s in sums]])
    spark = nodes.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-top["below"] // (4 * limit)))
    local = local.repartition(tasks, *comp).sortWithinPartitions(*comp)
    out = local.mapInPandas(lambda batches: _local_sums(batches, columns, limit), kind)
    for more in done:
        out = out.unionByName(more)
    return out


def prefix_trie(turns: DataFrame, lengths: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """One row per distinct opening of conversations, the empty one included.

    ``turns`` is (conv, depth, c1, c2, bytes, size), ``lengths`` (conv, size). Columns: conv_id, the least conversation that opens so;
    depth; parent_conv_id (null at the root); n_convs; n_children; n_leaves, the childless nodes of the subtree;
    saved_tokens, over the subtree the members of each node but one times the bytes of its last text; ends_sha256.

    Conversations without turns are members of the root alone; equal ones share all nodes. No conversations give no rows.
    """
    root = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), "size", *[F.lit(0).cast("long").alias(k) for k in (*LANES, "p1", "p2")])
    rows = written(prefix_lanes(turns).unionByName(root), "trie-rows")
    below = F.sum(F.col("size") - F.col("depth") + 1).alias("below")
    at = ["depth", *LANES]
    nodes = rows.groupBy(*at).agg(
        F.min("conv").alias("rep"), F.count("*").alias("n_convs"), below, F.min("bytes").alias("bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2")
    )
    nodes = written(nodes, "trie-nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, at, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(nodes, "trie-nodes")
    above = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("rep").alias("parent"), "n_children")
    known = join_to_one(nodes.filter("depth > 0").drop("n_children"), above, ["depth", "p1", "p2"], "n_children")
    known = known.select("depth", *LANES, "parent").unionByName(nodes.filter("depth = 0").select("depth", *LANES, F.lit(None).cast("long").alias("parent")))
    nodes = written(nodes.join(known, at), "trie-nodes")
    paths = written(join_to_one(rows.select("conv", "size", *at), nodes.select(*at, "rep", "parent", "n_convs"), at, "n_convs"), "trie-paths")
    values = nodes.select(
        "rep", "depth", F.coalesce("parent", "rep").alias("parent"), "below", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")
    )
    found = rollup(values, paths.select("conv", "depth", "rep", "parent"), ["leaves", "saved"], per_task)
    ends = ends_digests(paths.filter("depth = size").select("rep", "depth", "conv"))
    out = nodes.join(found, ["rep", "depth"]).join(ends, ["rep", "depth"], "left")
    return out.select(
        F.col("rep").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("sum_leaves").alias("n_leaves"),
        F.col("sum_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
