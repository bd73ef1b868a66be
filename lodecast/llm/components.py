"""Connected components of an undirected graph, as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodecast.llm.files import written

#: Parts that the nodes of one label are dealt out to.
SALTS = 16


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)`` for every node of an edge; the label is the least node of its component.

    In each round a node takes the least label among its own and its neighbours',
    and then the label of that label's node. Every round is written to the shared
    folder, which cuts the lineage; labels only fall, and the loop ends when their
    digest stays. Rows with a null end and loops are left out. Nodes can be of any
    type that has an order. The label of a large component is asked for by each of
    its nodes, so those questions are dealt out over SALTS copies of the answer. An
    empty table gives an empty result.
    """
    own = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = written(own.union(own.select(F.col("v"), F.col("u"))).distinct(), "graph-edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.least("node", "low").alias("label")), "graph-labels")
    before = None
    while True:
        spread = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        low = labels.join(spread, F.col("node") == F.col("u")).select("node", F.least("label", "near").alias("label"))
        asked = labels.join(low.select(F.col("label").alias("node")).distinct(), "node", "left_semi")
        top = asked.select(F.col("node").alias("label"), F.col("label").alias("above"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        dealt = low.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        labels = written(dealt.join(top, ["label", "_salt"]).select("node", F.least("label", "above").alias("label")), "graph-labels")
        digest = labels.agg(F.count("*"), F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first()
        if digest == before:
            return labels
        before = digest
