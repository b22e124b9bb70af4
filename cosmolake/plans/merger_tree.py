"""From memberships of several snapshots to trees: the chain of overlaps, mutual best matches and skipped snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cosmolake.operators import tree


def build(members: DataFrame, snaps: list[int], min_common: int = tree.MIN_COMMON, ptype: int | None = 1, both_ways: bool = True, skip: bool = True) -> DataFrame:
    """Ranked edges (snap, haloid, from_snap, progid, common, merit, rank) of memberships (snap, halo_id, pid[, ptype]).

    ``ptype`` restricts the particles before they are counted; ``both_ways``
    keeps mutual best matches; ``skip`` carries unmatched objects back.
    """
    if ptype is not None and "ptype" in members.columns:
        members = members.where(F.col("ptype") == ptype)
    if skip:
        return tree.skip_snapshots(members, snaps, min_common)
    edges = tree.overlaps(members, min_common)
    edges = tree.mutual_best(edges) if both_ways else tree.ranked(edges)
    return edges.select("snap", "haloid", (F.col("snap") - 1).alias("from_snap"), "progid", "common", "merit", "rank")
