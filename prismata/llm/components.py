"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """``(id, root)`` for every id of ``links (a, b)``; the root is the smallest id reachable.

    Each round takes the smallest root among neighbours, then the root's own
    root, so long chains shorten by more than half. Rounds end at tables in the
    shared folder; only whether a root changed reaches the driver.
    """
    links = links.where("a <> b")
    both = materialize(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    roots = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = roots.join(near, "id").select("id", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        step = materialize(step, "step")
        discard(roots)
        jump = step.select(F.col("id").alias("root"), F.col("root").alias("next"))
        new = materialize(step.join(jump, "root").select("id", "was", F.least("root", "next").alias("root")), "roots")
        changed = new.where("root <> was").limit(1).count()
        discard(step)
        if not changed:
            roots = materialize(new.select("id", "root"), "roots")
            discard(new, both)
            return roots
        roots = new
