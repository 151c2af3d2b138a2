"""Embedding near-dup by counting collisions of sorted one-dimensional projections.

Vectors of a label are projected on many random directions. In each sorted projection a vector is the centre of a
window, and the others in it collide with it; pairs that collide in enough projections are verified by their cosine.
How many are enough follows from the binomial law of a pair at the threshold and the share of such pairs that may be
missed. In a line of n vectors a window alone would hold a fixed share of them all, so each projection is sorted within
the cells of a few further directions; how many, grows with the logarithm of n, so a window holds about as many vectors
at any size.

A pair is counted in one place: that of its first collision, where the collisions in all other projections are
counted from the vectors themselves. Cells of very many vectors are cut into blocks that meet block by block. What
leaves a task are numbers of links and a forest of them, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.components import connected_components, forest
from linkloom.llm.tables import LAST_ID, forget, settle, table

COSINE, MISSED = 0.98, 1e-6
#: In units of the distance of a pair at the threshold: half the width of a window, and the width of a cell.
WINDOW, CELL = 3.0, 8.0
#: Collisions that a pair must have; unrelated vectors that a cell holds about; vectors of a block; rows met at once.
COUNT, CROWD, BLOCK, ROWS = 2, 64, 2048, 8192
SEED = 3


def same_cell(width: float) -> float:
    """The chance that two numbers whose difference is normal, of standard deviation 1, are in one cell of a random grid."""
    tail = 0.5 * math.erfc(width / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-width * width / 2))


def calibrated(n: int, cosine: float = COSINE, missed: float = MISSED) -> tuple[int, int]:
    """(directions whose cells a projection is sorted in, projections) for n vectors.

    With so many projections a pair at the threshold collides COUNT times but for a chance of missed; unrelated
    vectors are taken to be orthogonal.
    """
    distance = math.sqrt(2 - 2 * cosine)
    far = same_cell(CELL * distance / math.sqrt(2))
    cells = max(1, math.ceil(math.log(max(n, 1) / CROWD) / -math.log(far)))
    p = same_cell(CELL) ** cells * math.erf(WINDOW / math.sqrt(2))
    tables = COUNT
    while sum(math.comb(tables, k) * p**k * (1 - p) ** (tables - k) for k in range(COUNT)) > missed:
        tables += 1
    return cells, tables


def matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column whose lists are of one length."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Places:
    """Where unit vectors lie: for each projection, its value and the key of the cell that it is sorted in."""

    def __init__(self, dim: int, cells: int, tables: int, width: float):
        random = np.random.default_rng([SEED, dim])
        self.lines = random.normal(size=(dim, tables))
        self.grid = random.normal(size=(dim, tables * cells)) / width
        self.shift = random.random(tables * cells)
        self.shape = (tables, cells)

    def __call__(self, unit: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = np.floor(unit @ self.grid + self.shift).astype(np.int64).view(np.uint64).reshape(len(unit), *self.shape)
        key = mix(label.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(self.shape[0], dtype=np.uint64))
        for k in range(self.shape[1]):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cell[:, :, k])
        return key.view(np.int64), unit @ self.lines


def _placer(cells: int, tables: int, width: float):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Places] = {}
        for batch in batches:
            column, label = batch.column(1), batch.column(2).to_numpy()
            dims = np.diff(column.offsets.to_numpy())
            keys, at = np.zeros((len(column), tables), np.int64), np.zeros((len(column), tables))
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                places = known.setdefault(int(d), Places(int(d), cells, tables, width))
                keys[rows], at[rows] = places(matrix(column.take(pa.array(rows))), label[rows])
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(x.ravel())) for x in (keys, at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims.astype(np.int32)), *lists], names=["node", "dim", "keys", "places"])

    return place


def _linker(cosine: float, cells: int, tables: int):
    distance = math.sqrt(2 - 2 * cosine)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by dim, cell, blocks and projection. Out: (node, other, links)."""
        known: dict[int, Places] = {}
        found: list[tuple[np.ndarray, ...]] = []

        def meet(part: pa.RecordBatch) -> None:
            col = lambda c: part.column(c).to_numpy(zero_copy_only=False)
            dim = int(col("dim")[0])
            node, label, copies, line, block, within = (col(c) for c in ("node", "label", "copies", "line", "block", "within"))
            keys = np.stack([col(c) for c in ("key", "i", "j")], axis=1)
            unit_of = np.cumsum(np.r_[False, (keys[1:] != keys[:-1]).any(axis=1)])
            vectors = matrix(part.column("embedding"))
            places = known.setdefault(dim, Places(dim, cells, tables, CELL * distance))
            cell, at = places(vectors, label)
            own = np.take_along_axis(at, line[:, None].astype(np.int64), 1)[:, 0]
            first = np.arange(len(node))
            step = 0
            while len(first):
                step += 1
                first = first[first + step < len(node)]
                # the window is centred on the query, and rows are sorted, so a query is done when its window ends
                first = first[(unit_of[first + step] == unit_of[first]) & (own[first + step] - own[first] <= WINDOW * distance)]
                x, y = first, first + step
                good = (within[x] | (block[x] != block[y])) & (label[x] == label[y])
                x, y = x[good], y[good]
                for t in range(int(line.max()) if len(x) else 0):  # a pair that collides earlier is counted there
                    if not len(x):
                        break
                    earlier = (t < line[x]) & (cell[x, t] == cell[y, t]) & (np.abs(at[x, t] - at[y, t]) <= WINDOW * distance)
                    x, y = x[~earlier], y[~earlier]
                if not len(x):
                    continue
                count = 1 + ((cell[x] == cell[y]) & (np.abs(at[x] - at[y]) <= WINDOW * distance) & (np.arange(tables)[None] > line[x][:, None])).sum(axis=1)
                x, y = x[count >= COUNT], y[count >= COUNT]
                near = np.einsum("ij,ij->i", vectors[x], vectors[y]) >= cosine
                x, y = x[near], y[near]
                found.append((node[x], node[y], copies[x], copies[y]))

        def flush() -> pa.RecordBatch:
            a, b, na, nb = (np.concatenate([f[k] for f in found] or [np.empty(0, np.int64)]) for k in range(4))
            found.clear()
            ends, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
            links = np.bincount(inverse, np.concatenate([nb, na]), len(ends)).astype(np.int64)
            x, y = forest(a, b)
            no, nodes = np.zeros(len(ends), np.int64), np.concatenate([ends, x])
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate([no, y]), mask=np.arange(len(nodes)) < len(ends)), pa.array(np.concatenate([links, np.zeros(len(x), np.int64)]))], names=["node", "other", "links"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in ("dim", "key", "i", "j")], axis=1)
            starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1)]) if len(at) else []
            for s, e in zip(starts, [*starts[1:], len(at)], strict=True):
                if held and size >= ROWS and tuple(at[s]) != last or held and at[s][0] != last[0]:
                    meet(pa.concat_batches(held))
                    held, size = [], 0
                    if sum(len(f[0]) for f in found) > 1_000_000:
                        yield flush()
                held.append(batch.slice(s, e - s))
                size += e - s
                last = tuple(at[s])
        if held:
            meet(pa.concat_batches(held))
        yield flush()

    return link


def find_near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, missed: float = MISSED, block: int = BLOCK) -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept.

    Vectors whose labels are equal and not null, and of one length, are linked when their cosine, in double precision,
    is at least cosine; pairs that aren't so near are never linked, and one at the threshold is missed with a chance
    of about missed. n_links: other rows linked directly; component_id: the smallest id that links reach; kept: the id
    is that one. id_col and label_col are integer columns.

    Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and those without a
    label, are linked with nothing; rows are linked by their vectors alone, so null or repeated ids link nothing else;
    a null id is never the smallest; rows with equal vectors, or that repeat, are linked; an empty table gives an empty
    table; other columns are not returned, whatever their names.
    """
    value = F.col(f"`{vector_col}`")
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0) & F.col(f"`{label_col}`").isNotNull()
    rows = vectors.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), value.alias("embedding"), F.coalesce(sound, F.lit(False)).alias("sound"))
    rows = rows.withColumn("h1", F.when(F.col("sound"), F.xxhash64("embedding"))).withColumn("h2", F.when(F.col("sound"), F.xxhash64(F.lit(1), "embedding")))
    # equal vectors are one class, and a class is a node of its own, whatever the ids of its rows
    classes = rows.where("sound").groupBy("label", "h1", "h2").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()))

    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    cells, tables = calibrated(most, cosine, missed)
    width = CELL * math.sqrt(2 - 2 * cosine)
    placed = settle(classes.select("node", "embedding", "label").mapInArrow(_placer(cells, tables, width), "node long, dim int, keys array<long>, places array<double>"))
    lines = placed.select("node", "dim", F.posexplode(F.arrays_zip("keys", "places")).alias("line", "x")).select("node", "dim", "line", F.col("x.keys").alias("key"), F.col("x.places").alias("place"))
    # a cell that holds one vector ends here, before any vector is shuffled
    sizes = settle(lines.groupBy("dim", "key").agg(F.count("*").alias("n")).where("n > 1").select("dim", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    met = lines.join(sizes, ["dim", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    met = met.select("node", "dim", "line", "key", "place", "block", "i", "j", (F.col("i") == F.col("j")).alias("within")).join(classes.select("node", "label", "copies", "embedding"), "node")
    units = ["dim", "key", "i", "j"]
    found = settle(met.repartition(*units).sortWithinPartitions(*units, "place").mapInArrow(_linker(cosine, cells, tables), "node long, other long, links long"))
    forget(placed)

    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("other is not null").select("node", "other"))
    named = classes.drop("embedding").join(links, "node", "left").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # an id is looked up at the end only
    lowest = named.groupBy("component").agg(F.min("low").alias("lowest"))
    named = named.join(lowest, "component").select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "lowest")
    out = rows.drop("embedding").join(named, ["label", "h1", "h2"], "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("lowest", "id").alias("component"))
    known = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return out.select(known("id").alias(id_col), "n_links", known("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op3_embedding_near_dup(spark, sf_dir):
    return find_near_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT a AS vec_id, b AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a), c AS (SELECT vec_id, min(other) AS low FROM reach GROUP BY vec_id)
SELECT m.vec_id, coalesce(n.n_links, 0) AS n_links, least(m.vec_id, coalesce(c.low, m.vec_id)) AS component_id,
       m.vec_id <= coalesce(c.low, m.vec_id) AS kept
FROM embeddings m LEFT JOIN n ON n.a = m.vec_id LEFT JOIN c ON c.vec_id = m.vec_id
"""
