"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from stallbook.llm.common import materialise, shared_folder, ship_package

#: links that a task handles at least
TASK_LINKS = 50_000
#: links that one task solves at once, some megabytes; more go through rounds
FEW_LINKS = 200_000


def _solved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all links of the task."""
    tables = list(batches)
    if not tables:
        return
    u, v = (pa.chunked_array([t.column(i) for t in tables]) for i in (0, 1))
    nodes = pa.chunked_array([*u.chunks, *v.chunks]).unique()
    nodes = nodes.take(pc.sort_indices(nodes))
    a, b = (pc.index_in(c, value_set=nodes).to_numpy() for c in (u, v))
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        # the tops of both ends get the least of them, so that chains shrink by halves
        for end in (a, b):
            np.minimum.at(label, before[end], least)
            np.minimum.at(label, end, least)
        label = label[label]
        if (label == before).all():
            break
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], ["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Alternating large and small stars: each round joins the edges with one smallest neighbour per
    node, so no list of neighbours is ever gathered. Every round is written to the shared folder.
    FEW_LINKS at most are solved by one task instead, as their rounds are many jobs with little in them.
    """
    spark = edges.sparkSession
    folder = shared_folder(spark)

    def finished(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    def sized(df: DataFrame) -> DataFrame:
        # a round is many small shuffles: few links make few tasks, whatever the session's number of partitions
        return df.coalesce(1 + state[0] // TASK_LINKS) if state[0] < TASK_LINKS * spark_partitions else df

    u, v = F.greatest(a, b), F.least(a, b)
    now = materialise(edges.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct(), f"{folder}/0")
    state, step = finished(now), 0
    spark_partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if state[0] <= FEW_LINKS:
        ship_package(spark)
        kind = now.schema["u"].dataType.simpleString()
        solved = now.coalesce(1).mapInArrow(_solved, f"node {kind}, component {kind}")
        return materialise(solved, f"{folder}/solved")
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sized(both.groupBy("u").agg(F.min("v").alias("m"))).withColumn("m", F.least("u", "m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = sized(large.where("u != v").distinct())
        least = sized(large.groupBy("u").agg(F.min("v").alias("m")))
        small = sized(large.join(least, "u")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
        step += 1
        now = small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        now = materialise(sized(now), f"{folder}/{step}")
        before, state = state, finished(now)
        if state == before:
            break
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
