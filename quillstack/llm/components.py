"""Connected components of an undirected graph: forests in the tasks, then minimum labels and pointer jumps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Save, save

FOREST = 1 << 20  # edges that a task joins in memory


def contracted(edges: DataFrame) -> DataFrame:
    """The same components with fewer edges: of the edges in a task, one from each node to the smallest that it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boss: dict[int, int] = {}

        def top(x: int) -> int:
            while boss[x] != x:
                boss[x] = x = boss[boss[x]]
            return x

        def rows() -> pa.RecordBatch:
            out = [(x, top(x)) for x in boss]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

        seen = 0
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = top(boss.setdefault(a, a)), top(boss.setdefault(b, b))
                boss[max(x, y)] = min(x, y)
            seen += batch.num_rows
            if seen >= 2 * FOREST:
                yield rows()
                boss, seen = {}, 0
        yield rows()

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, keep: Save = save) -> DataFrame:
    """edges (a, b) -> (node, component): the smallest node that each node reaches. Nodes without an edge don't appear.

    A task joins at most FOREST edges. Where these are all, the answer is there; otherwise the forests of the tasks go
    through rounds: every node takes the smallest label of its neighbours and then its label's label, so that chains
    shorten by half, until no label changes. Null ends are ignored; loops and repeated edges do no harm.
    """
    edges = edges.where("a is not null and b is not null").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    parts = edges.count() // FOREST + 1
    forest = contracted(edges.repartition(parts))
    if parts == 1:
        return forest.toDF("node", "component")
    pairs = keep(forest, "forest")
    both = pairs.union(pairs.select("b", "a")).distinct().toDF("node", "other")
    labels = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component"))
    while True:
        near = both.join(labels.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        stepped = hooked.join(labels.toDF("component", "jump"), "component").select("node", "old", F.least("component", "jump").alias("component"))
        stepped = keep(stepped, "labels")
        labels = stepped.select("node", "component")
        if stepped.where("old <> component").isEmpty():
            return labels
