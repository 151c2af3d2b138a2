"""Connected components of any number of links, in rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.tables import forget, settle


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node that a or b hold to the smallest node of its component among these links."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as a forest, in portions of bounded size."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > 1_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(a, b)], names=["a", "b"])
            a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(a, b)], names=["a", "b"])


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that the links (a, b), two bigint columns, name; component: its smallest node.

    Links within a task are first made a forest. Then, in rounds until nothing changes, every node takes the smallest
    label among its neighbours', and the label's own label. Neither links nor labels are ever gathered in one place.
    """
    a, b = links.columns
    links = settle(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").mapInArrow(_shrink, "a long, b long").distinct())
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = settle(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("low"))
        new = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("was"), F.least("component", "low").alias("component"))
        up = labels.select(F.col("node").alias("at"), F.col("component").alias("above"))
        new = settle(new.join(up, F.col("component") == F.col("at"), "left").select("node", "was", F.least("component", F.coalesce("above", "component")).alias("component")))
        changed = new.where("was <> component").limit(1).count()
        forget(labels)
        labels = new.drop("was")
        labels.settled_at = new.settled_at
        if not changed:
            forget(links)
            return labels
