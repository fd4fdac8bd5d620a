"""Connected components of an edge table: minimum labels spread with pointer jumps.

Every round is a few joins and one minimum per vertex (map-side combined, so a
vertex with very many edges is no bottleneck); its labels are written to the
shared folder, so a lost executor repeats at most one round.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Observation

from .tables import dropped, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(v, c)``: every vertex of ``edges`` with the least vertex of its component.

    Self loops and repeated edges change nothing; null ends are ignored; no
    edges give no rows.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    # Both directions from one row: a union would plan and run what finds the edges twice.
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    both = written(one.select(ways.alias("e")).select("e.u", "e.v").distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
                     .select("v", F.least("v", "m").alias("c")), "labels")
    while True:
        near = (both.join(labels.select(F.col("v").alias("w"), F.col("c").alias("cw")), F.col("v") == F.col("w"))
                .groupBy(F.col("u").alias("v")).agg(F.min("cw").alias("m")))
        hooked = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        # A label's own label, if it is smaller, is one jump nearer to the least vertex.
        jump = labels.select(F.col("v").alias("j"), F.col("c").alias("cj"))
        moves = Observation()  # counted while the labels are written: no second query over them
        new = written(hooked.join(jump, F.col("c") == F.col("j"), "left")
                      .select("v", "old", F.least("c", F.coalesce("cj", "c")).alias("c"))
                      .observe(moves, F.count_if(F.col("c") != F.col("old")).alias("n")).select("v", "c"), "labels")
        dropped(labels)
        labels = new
        if not moves.get["n"]:
            dropped(both)
            return labels
