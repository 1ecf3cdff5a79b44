"""Connected components of a large link table, by repeated hooking and pointer jumping.

Every node keeps a pointer to a node no larger than itself.  In each round it looks at where its
neighbours' pointers lead, hooks its own root and itself to the least of these, and then shortens
its path.  The pointers reach the least node of each component in about log(n) rounds.  Only the
two-column tables move, each round is written, and a popular root meets its many followers in
joins that adaptive execution may split; nothing is gathered on the driver or in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrapunto.llm.common import durable


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``node`` and ``root`` (least node of its component) for every node in ``links`` (a, b).

    ``known`` is what this gave for some of the links: its pointers are gone on from, which saves rounds.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    edges = durable(both.where("node <> other").distinct())
    state = edges.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("root"))
    if known is not None:
        state = state.join(known.withColumnRenamed("root", "was"), "node", "left").select("node", F.least("root", "was").alias("root"))
    state = durable(state)
    while True:
        seen = state.select(F.col("node").alias("other"), F.col("root").alias("there"))
        least = edges.join(seen, "other").groupBy("node").agg(F.min("there").alias("there"))
        here = state.join(least, "node").select("node", "root", F.least("root", "there").alias("low"))
        # what a node found also moves its root
        moves = here.select("node", "low", "root").unionByName(here.where("low < root").select(F.col("root").alias("node"), "low", F.lit(None).cast("long").alias("root")))
        hooked = durable(moves.groupBy("node").agg(F.min("low").alias("root"), F.max("root").alias("old")))
        # pointer jumping: only the few nodes that are somebody's root are looked up
        roots = hooked.select("root").distinct()
        jump = hooked.join(roots.select(F.col("root").alias("node")), "node").select(F.col("node").alias("root"), F.col("root").alias("up")).where("up < root")
        after = durable(hooked.join(jump, "root", "left").select("node", F.coalesce("up", "root").alias("root"), "old"))
        changed = after.where("root <> old").limit(1).count()
        after = after.select("node", "root")
        state = after
        if not changed:
            return state
