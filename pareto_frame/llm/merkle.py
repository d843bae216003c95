"""Merkle manifest of a table, with a proof for every row by pointer jumping.

Rows are leaves; the leaves of one group, in order, form a tree, and the roots of the groups,
ordered by group, form the tree above. Every ``FAN`` neighbours become the hash of their
concatenated digests (lowercase hex, SHA-256) until one is left.

1. ``numbered``: range partitions, sorted, give each leaf its place in its group; no group is
   ever in one task.
2. Trees are built level by level: each level is a grouping of at most ``FAN`` nodes by
   (tree, place), so one large group is as spread as many small ones. Levels are written to the shared folder.
3. Every node but the root then holds its parent and one *segment*: the siblings left and right of
   it. Self-joins (node -> ancestor) append the ancestor's segment and take over its pointer, so the
   distance doubles with each join, until every leaf reaches the root.

Ancestors at distance ``2^k`` are ``3^(2^k)`` times fewer than leaves. As long as their segments are
beyond ``BROADCAST_BYTES`` they are joined by shuffle, and a key then has at most about
``3^8`` leaves of 1 kB (it would take 10^12 leaves to shuffle at distance 16); nodes that are at the root
take no further part, so no key is hot.

Defined cases: a null field is hashed as ``-``; null groups and null orders come first; rows that tie in
group and order are ordered by their leaf, so repeated rows give repeated results; a lone leaf is
its own root with an empty proof; an empty table gives an empty result; texts are hashed
whole; columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pareto_frame.llm.common import let, shuffle_partitions, stored
from pareto_frame.session import scratch_path

FAN = 3
BROADCAST_BYTES = 32 << 20
#: Leaves of a group that meet its row in one key, where groups are joined by shuffle.
CHUNK = 100_000
BROADCAST_GROUPS = 100_000
TOP = -1


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """The digest (32 bytes) of a row with these fields."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256))


def as_hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def hash_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root (hex) that a leaf (hex) and its proof lead to."""
    return F.aggregate(proof, leaf, lambda a, s: hash_of(F.concat(as_hex(s["left"]), a, as_hex(s["right"]))))


def proof_digest(proof: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    return hash_of(F.array_join(F.transform(proof, lambda s: as_hex(F.concat(s["left"], s["right"]))), ""))


def numbered(df: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    """``df`` with ``index``, the place of each row in the whole order, from 0.

    One row per range partition, a number that a setting bounds, passes one task and is broadcast.
    """
    n = shuffle_partitions(df.sparkSession)
    laid = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    rows = stored(laid, label).rows
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    return (
        rows.join(F.broadcast(before), "part")
        .withColumn("index", F.col("before") + F.col("place"))
        .drop("part", "place", "before")
    )


def _placed(leaves: DataFrame) -> tuple[DataFrame, int, int]:
    """Leaves as nodes of their tree; number of trees and size of the largest one.

    Trees are numbered in the order of their groups. A tree's row is repeated for every CHUNK of
    the places its leaves take, so a large group is not one key of the join.
    """
    laid = numbered(
        leaves.withColumn("key", field(F.col("group"))),
        [F.asc_nulls_first("group"), F.asc_nulls_first("order"), F.asc("leaf")],
        "merkle-leaves",
    )
    sizes = laid.groupBy("key", "group").agg(
        F.min("index").alias("first"), F.count(F.lit(1)).alias("size")
    )
    trees = numbered(sizes, [F.asc_nulls_first("group")], "merkle-groups").withColumnRenamed("index", "tree")
    found = trees.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("most")).first()
    last = F.col("first") + F.col("size") - 1
    chunks = F.sequence(F.floor(F.col("first") / CHUNK), F.floor(last / CHUNK))
    trees = trees.select("key", "tree", "first", "size", F.explode(chunks).alias("chunk"))
    if found["n"] <= BROADCAST_GROUPS:
        trees = F.broadcast(trees)
    nodes = laid.withColumn("chunk", F.floor(F.col("index") / CHUNK)).join(trees, ["key", "chunk"])
    return (
        nodes.select(
            "tree",
            F.lit(0).alias("level"),
            (F.col("index") - F.col("first")).alias("pos"),
            "size",
            F.col("leaf").alias("digest"),
            F.struct("payload", "leaf").alias("row"),
        ),
        found["n"],
        found["most"] or 0,
    )


def _runs(nodes: DataFrame, path: str) -> DataFrame:
    """Neighbours grouped under their parent, written; nodes alone in their tree have none."""
    up = F.floor(F.col("pos") / FAN).alias("up")
    node = F.struct("pos", "digest", "row")
    nodes.filter(F.col("size") > 1).groupBy("tree", "level", "size", up).agg(
        F.sort_array(F.collect_list(node)).alias("run")
    ).write.parquet(path)
    return nodes.sparkSession.read.parquet(path)


def _parents(runs: DataFrame) -> DataFrame:
    together = F.array_join(F.transform("run", lambda x: as_hex(x["digest"])), "")
    return runs.select(
        "tree",
        (F.col("level") + 1).alias("level"),
        F.col("up").alias("pos"),
        F.ceil(F.col("size") / FAN).alias("size"),
        F.unhex(hash_of(together)).alias("digest"),
        F.lit(None).cast(runs.schema["run"].dataType.elementType["row"].dataType).alias("row"),
    )


def _levels(nodes: DataFrame, most: int, base: str) -> tuple[list[str], list[int], list[DataFrame]]:
    """All levels above ``nodes``: paths of the runs, number of parents in each, and the tree tops."""
    paths, counts, tops = [], [], [nodes.filter(F.col("size") == 1)]
    while most > 1:
        paths.append(f"{base}/{len(paths)}")
        runs = _runs(nodes, paths[-1])
        counts.append(runs.count())
        nodes = _parents(runs)
        tops.append(nodes.filter(F.col("size") == 1))
        most = -(-most // FAN)
    return paths, counts, tops


def _edges(runs: DataFrame, n_trees: int) -> DataFrame:
    """Each node with its parent (null if that is the root) and the segment of its one step."""
    last = F.col("size") <= FAN
    # the root of the only group is the root of all
    into_top = last & (F.col("tree") != TOP) & F.lit(n_trees > 1)
    joined = lambda part: F.aggregate(part, F.lit(b""), lambda a, x: F.concat(a, x["digest"]))
    return runs.select("*", F.posexplode("run").alias("i", "node")).select(
        "tree",
        "level",
        F.col("node.pos").alias("pos"),
        F.when(last, F.lit(TOP)).otherwise(F.col("tree")).cast("long").alias("up_tree"),
        F.when(last, 0).otherwise(F.col("level") + 1).alias("up_level"),
        F.when(into_top, F.col("tree")).when(~last, F.col("up")).alias("up_pos"),
        F.array(
            F.struct(
                joined(F.slice("run", F.lit(1), F.col("i"))).alias("left"),
                joined(F.slice("run", F.col("i") + 2, F.lit(FAN))).alias("right"),
            )
        ).alias("proof"),
        # the roots of the groups are the leaves of the tree above
        F.when((F.col("tree") == TOP) & (F.col("level") == 0), F.col("node.digest")).alias("subroot"),
        F.col("node.row").alias("row"),
    )


def _jump(state: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Twice the distance: each node takes over the pointer of its ancestor and appends its segment."""
    far = ancestors.select(
        F.col("tree").alias("up_tree"),
        F.col("level").alias("up_level"),
        F.col("pos").alias("up_pos"),
        F.col("up_tree").alias("far_tree"),
        F.col("up_level").alias("far_level"),
        F.col("up_pos").alias("far_pos"),
        F.col("proof").alias("far_proof"),
        F.col("subroot").alias("far_subroot"),
    )
    return state.join(far, ["up_tree", "up_level", "up_pos"]).select(
        "tree",
        "level",
        "pos",
        F.col("far_tree").alias("up_tree"),
        F.col("far_level").alias("up_level"),
        F.col("far_pos").alias("up_pos"),
        F.concat("proof", "far_proof").alias("proof"),
        F.coalesce("subroot", "far_subroot").alias("subroot"),
        "row",
    )


def prove(leaves: DataFrame) -> DataFrame:
    """payload, leaf, subroot, root (hex) and proof of every row of ``leaves``.

    ``leaves``: group and order (any orderable types), leaf (32 bytes), payload (any struct, returned as it came).
    The proof lists per level the digests left and right of the path, from the leaf to the root.
    """
    spark = leaves.sparkSession
    leaves = leaves.select("group", "order", "leaf", "payload")
    base = scratch_path(spark, "merkle")
    nodes, n_trees, most = _placed(leaves)
    paths, counts, tops = _levels(nodes, most, f"{base}/groups")
    top_leaves = tops[0]
    for more in tops[1:]:
        top_leaves = top_leaves.unionByName(more)
    top_leaves = stored(
        top_leaves.select(
            F.lit(TOP).cast("long").alias("tree"),
            F.lit(0).alias("level"),
            F.col("tree").alias("pos"),
            F.lit(n_trees).cast("long").alias("size"),
            "digest",
            "row",
        ),
        "merkle-subroots",
    ).rows
    top_paths, top_counts, roots = _levels(top_leaves, n_trees, f"{base}/top")
    root_row = roots[-1].select(as_hex(F.col("digest")).alias("root")).first()
    root = F.lit(root_row["root"] if root_row else None).cast("string")

    # a table of one row: its leaf is the root, and nothing points to it
    done = [
        roots[0].filter(F.col("row").isNotNull()).select(
            "row",
            F.array().cast("array<struct<left: binary, right: binary>>").alias("proof"),
            F.col("digest").alias("subroot"),
        )
    ]
    if paths or top_paths:
        runs = spark.read.parquet(*paths, *top_paths)
        state = _edges(runs, n_trees)
        at_root = F.col("up_pos").isNull()
        arrived: list[DataFrame] = []
        distance, depth = 1, len(paths) + len(top_paths)
        while True:
            inner = F.col("row").isNull() & ((F.col("tree") == TOP) | (F.col("level") >= distance))
            inner = inner | (F.col("tree") == TOP)
            done.append(state.filter(at_root & F.col("row").isNotNull()).select("row", "proof", "subroot"))
            arrived.append(state.filter(at_root & inner))
            if distance >= depth:
                break
            ancestors = state.filter(~at_root & inner)
            for more in arrived:
                ancestors = ancestors.unionByName(more)
            # nodes of level ``distance`` and above, and those of the tree above all groups
            n = sum(counts[distance - 1 :]) + n_trees + sum(top_counts)
            if n * (64 * distance + 100) <= BROADCAST_BYTES:
                ancestors = F.broadcast(ancestors)
            state = _jump(state.filter(~at_root), ancestors)
            distance *= 2
            if distance < depth:
                state = stored(state, "merkle-jump").rows
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        F.col("row.payload").alias("payload"),
        as_hex(F.col("row.leaf")).alias("leaf"),
        # without a subroot on the way, the root is the one of the only group
        F.coalesce(as_hex(F.col("subroot")), root).alias("subroot"),
        root.alias("root"),
        "proof",
    )


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents, by source in the order of doc_id; payload: doc_id and the tampered leaf.

    Documents with an even CRC-32 of their id are tampered with: the line ends of their text go.
    The tampered leaf is null where that changes nothing.
    """
    columns = {c: F.col(f"`{c}`") for c in FIELDS}
    without = columns | {"text": F.replace(columns["text"], F.lit("\n"), F.lit(""))}
    even = F.crc32(columns["doc_id"].cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even & F.contains(columns["text"], F.lit("\n")), leaf_digest(*without.values()))
    return docs.select(
        columns["source"].alias("group"),
        columns["doc_id"].alias("order"),
        leaf_digest(*columns.values()).alias("leaf"),
        F.struct(columns["doc_id"].alias("doc_id"), tampered.alias("tampered")).alias("payload"),
    )


def verified(docs: DataFrame) -> DataFrame:
    """One row per document: its leaf, roots, proof, and whether the (tampered) leaf leads to the root."""
    proofs = prove(document_leaves(docs))
    shown = F.coalesce(as_hex(F.col("payload.tampered")), F.col("leaf"))
    folded = let(F.struct(shown.alias("leaf"), F.col("proof")), lambda s: fold(s["leaf"], s["proof"]))
    return proofs.select(
        F.col("payload.doc_id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        "proof",
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
