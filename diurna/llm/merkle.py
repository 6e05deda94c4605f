"""Merkle manifest of a dataset: a leaf per row, a tree per group, one root, and a proof for every row.

A node is the lowercase hex SHA-256 of the concatenated hex digests of up to FANOUT consecutive
nodes below it; a level's last run may be shorter, even one node, and is hashed all the same. A
tree ends when one node remains (a lone leaf is its own subroot). The subroots, in order of
their group (null first, then bytewise), are the leaves of one more tree, whose top is the root.

No tree is held anywhere as a whole:

* Rows are numbered per group by a range sort: each range counts its own rows, a sum over the
  ranges before it gives the offset. A group with a third of all rows lies in many ranges.
* FANOUT ** DEPTH consecutive nodes form a superblock. One pass reduces every superblock to its
  top node; the tops are the nodes of the next, some thousand times smaller round, until every
  tree has one node.
* On the way down, leaves and the siblings outside their superblock are cogrouped by superblock
  in applyInPandas: local reduction, joining of inner and outer proof, and folding a changed
  leaf back to a root are done there together. A group holds one superblock, never a tree.

Rounds are staged in the shared folder, so a lost executor costs its own tasks only.

Defined results: a null field is `-`; null ids come first in a group; equal ids are ordered by
their leaf, equal leaves are interchangeable. A row without id is never taken for tampered. An
empty table has no rows, so no root. Only the named fields are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diurna.llm.common import column, staged, unstage

FANOUT = 8
#: Levels of a superblock: 8 ** 4 = 4,096 leaves, about a megabyte of rows.
DEPTH = 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def encoded(value: Column) -> Column:
    """`-` for null, else the length in UTF-8 bytes, `:`, and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in fields.values()]), 256)


def _hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_of(n: int, fanout: int = FANOUT) -> int:
    """Levels above n nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def reduced(nodes: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The nodes and every level above them; the last list is the top."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([_hash(below[i:i + fanout]) for i in range(0, len(below), fanout)])
    return out


# A proof is a string with one part per level: the node's place in its run, then its siblings' digests.

def step(run: list[str], place: int) -> str:
    return f"{place}" + "".join(run[:place] + run[place + 1:])


def proof_at(levels: list[list[str]], i: int, fanout: int = FANOUT) -> list[str]:
    """Steps of the i-th node through the levels below the last."""
    out = []
    for nodes in levels[:-1]:
        first = i - i % fanout
        out.append(step(nodes[first:first + fanout], i % fanout))
        i //= fanout
    return out


def folded(node: str, steps: list[str]) -> str:
    """The root that a node and its proof lead to."""
    for s in steps:
        place, rest = int(s[0]), s[1:]
        node = hashlib.sha256((rest[:64 * place] + node + rest[64 * place:]).encode()).hexdigest()
    return node


def siblings_digest(steps: list[str]) -> str:
    return hashlib.sha256("".join(s[1:] for s in steps).encode()).hexdigest()


def _numbered_in_range(names: list[str]):
    """Each row's number among the rows of its group in this range; the range is sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, before = object(), 0
        for batch in batches:
            groups = column(batch, "grp").to_pylist()
            at = np.empty(len(groups), np.int64)
            for i, g in enumerate(groups):
                before = before + 1 if g == last else 0
                last = g
                at[i] = before
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(groups), part, np.int32)), pa.array(at)],
                names=[*names, "part", "at"])

    return run


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows (with a column grp) with idx from 0 per group in the given order and size, the group's rows;
    and the staged table below it, to be deleted after use."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part int, at bigint"
    placed = staged(
        rows.repartitionByRange(F.col("grp").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order])
        .sortWithinPartitions(F.col("grp").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order])
        .mapInArrow(_numbered_in_range(rows.columns), schema), "placed")
    # a row per group and range that holds it
    counts = placed.groupBy("grp", "part").agg(F.count("*").alias("n"))
    w = W.partitionBy("grp")
    counts = counts.select(
        F.col("grp").alias("_grp"), F.col("part").alias("_part"), F.sum("n").over(w).alias("size"),
        F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return placed.join(counts, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("part") == F.col("_part"))).select(
        *rows.columns, (F.col("offset") + F.col("at")).alias("idx"), "size"), placed


def _block_levels(size: int, fanout: int, depth: int) -> int:
    """A tree that fits one superblock ends where one node remains; else all superblocks have the same height."""
    return min(depth, levels_of(size, fanout))


_TOP = "tree long, idx long, size long, hash string"
_PATH = "tree long, idx long, proof array<string>, subroot string"


def _top(fanout: int, depth: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        size = int(pdf["size"].iloc[0])
        top = reduced(pdf["hash"].tolist(), _block_levels(size, fanout, depth), fanout)[-1][0]
        block = fanout ** depth
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "idx": [int(pdf["idx"].iloc[0]) // block],
                             "size": [-(-size // block)], "hash": [top]})

    return run


def _down(fanout: int, depth: int):
    """Nodes of a superblock with the proof of their superblock's top: their own proofs."""

    def run(pdf: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        levels, pdf, above, subroot = _joined(pdf, outer, fanout, depth)
        proofs = [proof_at(levels, i, fanout) + above for i in range(len(pdf))]
        return pd.DataFrame({"tree": pdf["tree"], "idx": pdf["idx"], "proof": proofs, "subroot": subroot})

    return run


def _joined(pdf: pd.DataFrame, outer: pd.DataFrame, fanout: int, depth: int):
    pdf = pdf.sort_values("idx").reset_index(drop=True)
    levels = reduced(pdf["hash"].tolist(), _block_levels(int(pdf["size"].iloc[0]), fanout, depth), fanout)
    return levels, pdf, list(outer["proof"].iloc[0]), outer["subroot"].iloc[0]


def _blocks(nodes: DataFrame, block: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("idx") / F.lit(block)).cast("long"))


def tops(nodes: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """One node per superblock: (tree, idx, size, hash) of the next round."""
    return _blocks(nodes.select("tree", "idx", "size", "hash"), fanout ** depth).groupBy("tree", "block").applyInPandas(_top(fanout, depth), _TOP)


def proofs(nodes: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """(tree, idx, proof, subroot) of nodes (tree, idx, size, hash): steps up to the top of each tree."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("size")).first()[0] or 0) > 1:
        rounds.append(staged(tops(rounds[-1], fanout, depth), "tops"))
    paths = rounds[-1].select("tree", "idx", F.array().cast("array<string>").alias("proof"), F.col("hash").alias("subroot"))
    for below in reversed(rounds[:-1]):
        paths = _blocks(below, fanout ** depth).groupBy("tree", "block").cogroup(
            paths.withColumnRenamed("idx", "block").groupBy("tree", "block")).applyInPandas(_down(fanout, depth), _PATH)
    return paths


#: The id goes through pandas as text: a null would turn whole numbers into floats.
_PROVED = ("doc_id string, leaf string, subroot string, root string, proof array<string>, proof_sha256 string, "
           "changed_leaf string, folded_root string, verified boolean")


def _prove(fanout: int, depth: int, with_proof: bool):
    """Leaves of one superblock with the outer proof of its top: finish the reduction, join the proofs, fold."""

    def run(pdf: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        levels, pdf, above, subroot = _joined(pdf, outer, fanout, depth)
        root = outer["root"].iloc[0]
        own = [proof_at(levels, i, fanout) + above for i in range(len(pdf))]
        now = pdf["changed"].where(pdf["changed"].notna(), pdf["hash"])
        back = [folded(h, p) for h, p in zip(now, own)]
        return pd.DataFrame({
            "doc_id": pdf["doc_id"], "leaf": pdf["hash"], "subroot": subroot, "root": root, "proof": own if with_proof else None,
            "proof_sha256": [siblings_digest(p) for p in own], "changed_leaf": now, "folded_root": back,
            "verified": [b == root for b in back]})

    return run


def manifest(rows: DataFrame, group: str, ident: str, fields: list[str], changed: dict[str, Column] | None = None,
             fanout: int = FANOUT, depth: int = DEPTH, with_proof: bool = True) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and what a changed copy of it would fold to.

    group: column whose values have a tree each; ident: integer column that orders a tree.
    changed: fields to replace before a row is checked against the manifest (none: as it is).
    proof: a step per level, from the leaf to the root: place in the run, then the siblings
    (null without with_proof: some thousand bytes a row that a caller of the digest does not need).
    """
    if not 2 <= fanout <= 10 or depth < 1:
        raise ValueError("fanout must be from 2 to 10 (a place is one digit), depth 1 or more")
    now = {f: F.col(f) for f in fields}
    own, other = leaf(now), leaf({**now, **(changed or {})})
    first = staged(rows.select(
        F.col(group).cast("string").alias("grp"), F.col(ident).cast("long").alias("id"), own.alias("hash"),
        F.when(other != own, other).alias("changed"), F.monotonically_increasing_id().alias("tie")), "leaves")
    # the groups in order are the leaves of the last tree, and their numbers name the trees
    groups, below = numbered(first.select("grp").distinct().select(F.lit("").alias("grp"), F.col("grp").alias("g")), ["g"])
    groups = staged(groups.select("g", F.col("idx").alias("tree")), "groups")
    ranked, placed = numbered(first, ["id", "hash", "tie"])
    leaves = staged(ranked.join(groups, F.col("grp").eqNullSafe(F.col("g"))).select(
        "tree", "idx", "size", "hash", "changed", F.col("id").cast("string").alias("doc_id")), "numbered")
    unstage(first, placed, below)

    over = staged(tops(leaves, fanout, depth), "tops")
    within = staged(proofs(over, fanout, depth), "outer")
    subroots = within.groupBy("tree").agg(F.first("subroot").alias("hash"))
    size = F.lit(groups.count()).cast("long")
    joint = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), size.alias("size"), "hash")
    top = staged(proofs(staged(joint, "subroots"), fanout, depth).select(
        F.col("idx").alias("t"), F.col("proof").alias("rest"), F.col("subroot").alias("root")), "root")
    outer = within.join(top, F.col("tree") == F.col("t")).select(
        "tree", F.col("idx").alias("block"), F.concat("proof", "rest").alias("proof"), "subroot", "root")
    return _blocks(leaves, fanout ** depth).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(
        _prove(fanout, depth, with_proof), _PROVED).withColumn("doc_id", F.col("doc_id").cast("long"))


def documents_manifest(docs: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """The manifest of documents, each third one (by the hash of its id) checked with its text lower-cased."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = manifest(docs.select(*FIELDS), "lang", "doc_id", FIELDS,
                   {"text": F.when(tampered, small).otherwise(F.col("text"))}, fanout, depth, with_proof=False)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
