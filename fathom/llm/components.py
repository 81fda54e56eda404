"""Connected components of links between nodes whose ids are hashes already."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fathom.operators.graph import rooted


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the edges (a, b); comp is the smallest node reachable.

    Loops and repeated edges count once; nodes without an edge to another are left out; no edges give no rows.
    """
    return rooted(edges)
