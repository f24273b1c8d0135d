"""Merkle manifest of a dataset: roots, inclusion proofs, and proofs folded again.

A tree reduces a sequence of digests: every two neighbours (a last one alone, too) become the
digest of their concatenation, until one is left.  The leaves of a group form one tree, the groups'
roots form the top tree.

Positions are cut into superblocks of 2**levels nodes.  On the way up each superblock becomes one
node of the next tier, so a tier has a thousandth of the nodes below.  On the way down the nodes of
a tier are cogrouped by superblock with the outer nodes that their proofs need (siblings above the
superblock, and the roots): one call reduces the superblock again, joins the inner and the outer
part of every proof, and folds it.  What comes out at an upper tier are the outer nodes of the next
lower one; at the leaves it is the manifest.  A call sees one superblock and the few dozen nodes
above it, whatever the size of the table or of a group.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.session import settle

LEVELS = 10
#: Kinds of outer nodes: sibling to the left or right, root of the group's tree, root of all.
#: A node that is reduced alone has an empty sibling, which adds nothing to a digest.
LEFT, RIGHT, SUBROOT, ROOT = 0, 1, 2, 3
_NODE = "grp string, pos bigint, n bigint, digest string"
_OUTER = "grp string, block bigint, at int, kind int, digest string"


def encoded(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)).cast("binary"), 256)


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _local(nodes: list[str], levels: int) -> tuple[str, list[list[tuple[int, str]]]]:
    """The node that ``levels`` reductions leave, and each node's siblings (kind, digest) on the way."""
    siblings: list[list[tuple[int, str]]] = [[] for _ in nodes]
    members = [[i] for i in range(len(nodes))]
    for _ in range(levels):
        above, joined = [], []
        for i in range(0, len(nodes), 2):
            left, right = nodes[i], nodes[i + 1] if i + 1 < len(nodes) else ""
            for m in members[i]:
                siblings[m].append((RIGHT, right))
            if right:
                for m in members[i + 1]:
                    siblings[m].append((LEFT, left))
            above.append(_h(left, right))
            joined.append(members[i] + (members[i + 1] if right else []))
        nodes, members = above, joined
    return nodes[0], siblings


def _levels(n: int, levels: int) -> int:
    """How often a tier of n nodes is reduced inside its superblocks of 2**levels nodes."""
    return min(levels, (int(n) - 1).bit_length())


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds pos (from 0) and n (size) within the group; no group has to fit into a task.

    Rows are range-partitioned and written with their row number in their slice; slice sizes give
    each slice its offset.  Rows equal in ``order`` get neighbouring places, whichever.
    """
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    sliced = df.repartitionByRange(*by).sortWithinPartitions(*by)
    sliced = settle(sliced.withColumn("_row", F.monotonically_increasing_id()), "sliced")
    sliced = sliced.withColumn("_slice", F.shiftright("_row", 33))
    own = Window.partitionBy(group)
    before = F.sum("_c").over(own.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    sizes = (
        sliced.groupBy(group, "_slice")
        .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_c"))
        .select(group, "_slice", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_off"), F.sum("_c").over(own).alias("n"))
    )
    joined = sliced.join(settle(sizes, "sizes"), [group, "_slice"])  # one row per slice and group
    return joined.withColumn("pos", F.col("_row") + F.col("_off")).drop("_row", "_slice", "_off")


def _blocked(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", levels))


def _up(nodes: DataFrame, levels: int) -> DataFrame:
    """The next tier of (grp, pos, n, digest): one node per superblock."""

    def reduce(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        n = int(part["n"].iloc[0])
        node, _ = _local(part["digest"].tolist(), _levels(n, levels))
        return pd.DataFrame({"grp": [key[0]], "pos": [key[1]], "n": [-(-n >> levels)], "digest": [node]})

    return _blocked(nodes.select("grp", "pos", "n", "digest"), levels).groupBy("grp", "block").applyInPandas(reduce, _NODE)


def _tiers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Tiers from the given one up to that in which every group is a single node."""
    tiers = [nodes]
    while (tiers[-1].agg(F.max("n")).first()[0] or 0) > 1:
        tiers.append(settle(_up(tiers[-1], levels), "tier"))
    return tiers


def _paths(part: pd.DataFrame, above: pd.DataFrame, levels: int) -> tuple[pd.DataFrame, list, list]:
    """Nodes of a superblock by position, their inner siblings, and the outer nodes by height."""
    part = part.sort_values("pos")
    _, siblings = _local(part["digest"].tolist(), _levels(part["n"].iloc[0], levels))
    above = above.sort_values("at")
    return part, siblings, list(zip(above["kind"].tolist(), above["digest"].tolist()))


def _descend(tiers: list[DataFrame], outer: DataFrame, levels: int) -> DataFrame:
    """From the outer nodes of the trees' tops to those of the lowest tier's superblocks."""

    def join(key: tuple, part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        part, siblings, rest = _paths(part, above, levels)
        rows = [
            (key[0], pos, at, kind, digest)
            for pos, own in zip(part["pos"].tolist(), siblings)
            for at, (kind, digest) in enumerate(own + rest)
        ]
        return pd.DataFrame(rows, columns=["grp", "block", "at", "kind", "digest"])

    for nodes in reversed(tiers[1:]):
        below = _blocked(nodes.select("grp", "pos", "n", "digest"), levels).groupBy("grp", "block")
        outer = settle(below.cogroup(outer.groupBy("grp", "block")).applyInPandas(join, _OUTER), "outer")
    return outer


def _of_top(nodes: DataFrame, at: int, kind: int) -> DataFrame:
    """The digests of single nodes, as outer nodes of their own tree's top."""
    fixed = [F.lit(0).cast("bigint").alias("block"), F.lit(at).alias("at"), F.lit(kind).alias("kind")]
    return nodes.select("grp", *fixed, "digest")


def _folded(leaves: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """The manifest: leaves and their outer nodes, superblock by superblock."""

    def fold(key: tuple, part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        part, siblings, rest = _paths(part, above, levels)
        subroot, root = (next(d for k, d in rest if k == kind) for kind in (SUBROOT, ROOT))
        rest = [r for r in rest if r[0] in (LEFT, RIGHT)]
        proofs, folded = [], []
        for node, own in zip(part["altered"].tolist(), siblings):
            for kind, other in own + rest:
                node = _h(other, node) if kind == LEFT else _h(node, other)
            folded.append(node)
            proofs.append(_h(*(d for _, d in own + rest)))
        found = pd.DataFrame({"doc_id": part["doc_id"].tolist(), "leaf": part["digest"].tolist()})
        return found.assign(
            subroot=subroot, root=root, proof_sha256=proofs, folded_root=folded, verified=[f == root for f in folded]
        )

    return (
        _blocked(leaves, levels)
        .groupBy("grp", "block")
        .cogroup(outer.groupBy("grp", "block"))
        .applyInPandas(
            fold,
            "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
        )
    )


def manifest(docs: DataFrame, altered: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """Leaf, subroot, root, proof digest and folded root of every row of ``docs``.

    ``docs`` has doc_id, source, lang, n_chars, text; other columns are ignored.  ``altered`` gives
    other values of some of these, from which folded_root is computed, with the proof of the rows
    as they are; verified says whether that is the root.  Trees are by lang (null is one of its
    own, the first) and ordered by doc_id, nulls first, then by leaf digest: repeated rows have
    equal leaves in neighbouring places.  An empty table gives an empty table.
    """
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    other = {**{c: F.col(c) for c in fields}, **(altered or {})}
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("grp"),
        F.col("doc_id").alias("_id"),
        F.col("doc_id").cast("string").alias("doc_id"),  # pandas would turn ids with nulls into floats
        leaf_digest([F.col(c) for c in fields]).alias("digest"),
        leaf_digest([other[c] for c in fields]).alias("altered"),
    )
    leaves = settle(ranked(leaves, "grp", ["_id", "digest"]).drop("_id"), "leaves")
    tiers = _tiers(leaves, levels)
    subroots = tiers[-1].select("grp", "digest")
    groups = ranked(subroots.select(F.lit("").alias("all"), "grp", "digest"), "all", ["grp"])
    groups = settle(groups.select(F.col("all").alias("grp"), F.col("grp").alias("own"), "pos", "n", "digest"), "groups")
    top = _tiers(groups, levels)
    outer = _descend([groups, *top], _of_top(top[-1], 0, ROOT), levels)  # of every group's place in the top tree
    outer = outer.join(groups.select(F.col("own").alias("_own"), F.col("pos").alias("block")), "block").select(
        F.col("_own").alias("grp"), F.lit(0).cast("bigint").alias("block"), (F.col("at") + 1).alias("at"), "kind", "digest"
    )
    outer = _descend(tiers, outer.unionByName(_of_top(subroots, 0, SUBROOT)), levels)
    return _folded(leaves, outer, levels).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def tampered(docs: DataFrame, modulus: int = 7) -> dict[str, Column]:
    """One more character where ``modulus`` divides the crc32 of the decimal doc_id; a null id is left alone."""
    more = F.col("n_chars").cast("decimal(20,0)") + 1  # the largest bigint, too, has a successor
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0
    return {"n_chars": F.when(hit, more.cast("string")).otherwise(F.col("n_chars").cast("string"))}
