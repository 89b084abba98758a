"""Connected components of an edge table, as DataFrame iterations.

Hash-min label propagation with pointer jumping: each round every vertex
takes the smallest label among itself and its neighbours, then jumps to its
label's label.  Rounds are joins and partial aggregations keyed by vertex;
lineage is cut every round by writing the labels under the shared checkpoint folder,
and convergence is tested with one aggregated row.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, release


def connected_components(vertices: DataFrame, edges: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """``vertices``: (*group, id); ``edges``: (*group, src, dst).  Returns (*group, id, component)
    where component = smallest id of the component."""
    g = list(group_cols)
    und = (edges.select(*g, "src", "dst")
           .unionByName(edges.select(*g, F.col("dst").alias("src"), F.col("src").alias("dst")))
           .where(F.col("src") != F.col("dst")).dropDuplicates([*g, "src", "dst"]))
    und = cut_lineage(und)
    labels = cut_lineage(vertices.select(*g, "id").distinct().withColumn("component", F.col("id")))
    while True:   # labels only fall, and a round that changes none is the last
        # smallest neighbour label
        nb = (und.join(labels.withColumnRenamed("id", "src"), [*g, "src"])
              .groupBy(*g, F.col("dst").alias("id")).agg(F.min("component").alias("_m")))
        step = (labels.join(nb, [*g, "id"], "left")
                .select(*g, "id", F.least("component", F.coalesce("_m", "component")).alias("component")))
        # pointer jumping: label of the label
        jump = step.select(*g, F.col("id").alias("component"), F.col("component").alias("_c2"))
        new = (step.join(jump, [*g, "component"], "left")
               .select(*g, "id", F.least("component", F.coalesce("_c2", "component")).alias("component")))
        new = cut_lineage(new)
        changed = (new.join(labels.withColumnRenamed("component", "_old"), [*g, "id"])
                   .where(F.col("component") != F.col("_old")).limit(1).count())
        release(labels)      # the round before is in no plan any more
        labels = new
        if changed == 0:
            break
    release(und)
    return labels
