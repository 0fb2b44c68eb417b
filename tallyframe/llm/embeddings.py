"""Near-duplicate vectors by cosine: tiles of vectors, compared in PCA order and stopped early.

All vectors are turned so that the directions with most of the mass come first.
Two vectors' product over the leading directions, plus the product of what is
left of their lengths, bounds their cosine from above, so most pairs end after
a few directions. Tiles are cut along the first direction, and two tiles whose
boxes are too far apart for the threshold are never brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import col, components, shuffle_partitions, stored

#: Bytes of one tile in double precision, at most.
TILE_BYTES = 2 * 1024 * 1024
#: Directions taken at a time.
STEP = 16
#: Sides of a tile's box.
BOX = 4
#: Pairs of vectors that a task holds at a time.
BLOCK = 2_000_000
SLACK = 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow or loss for very large or small components."""
    rows = rows.astype("float64")
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), "float64").reshape(-1, dim)


def _by_dim(batch: pa.RecordBatch, dims: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    dims = dims.to_numpy()
    for d in np.unique(dims):
        yield int(d), np.flatnonzero(dims == d)


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vector the directions of all unit vectors' mass, largest first.

    Every vector counts. Tasks sum products of components; only one matrix per
    length of vector reaches the driver.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, where in _by_dim(batch, batch.column(1)):
                rows = unit(_matrix(batch.column(0).take(pa.array(where)), d))
                sums[d] = sums.get(d, 0) + rows.T @ rows
        for d, m in sums.items():
            at = np.arange(d * d, dtype="int64")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d)), pa.array(at), pa.array(m.ravel())], ["dim", "at", "v"])

    rows = vectors.select("embedding", F.size("embedding").cast("bigint").alias("dim"))
    summed = rows.mapInArrow(products, "dim bigint, at bigint, v double").groupBy("dim", "at").agg(F.sum("v").alias("v"))
    matrices: dict[int, np.ndarray] = {}
    for r in summed.toLocalIterator():
        matrices.setdefault(r["dim"], np.zeros((r["dim"], r["dim"])))[divmod(r["at"], r["dim"])] = r["v"]
    return {d: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1] for d, m in matrices.items()}


def _tiles(vectors: DataFrame, turn: dict[int, np.ndarray], tile_bytes: int) -> DataFrame:
    """Vectors in the order of their first direction, packed into tiles of bounded size with their boxes."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.zeros(batch.num_rows)
            for d, where in _by_dim(batch, batch.column(2)):
                first[where] = unit(_matrix(batch.column(1).take(pa.array(where)), d)) @ turn[d][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], [*batch.schema.names, "lead"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select("node", "embedding", F.size("embedding").cast("bigint").alias("dim"), "copies")
    rows = rows.mapInArrow(lead, f"node bigint, embedding {kind}, dim bigint, copies bigint, lead double")
    # The node breaks ties, so that equal first directions do not land in one task.
    spread = rows.repartitionByRange(shuffle_partitions(vectors.sparkSession), "dim", "lead", "node")
    number = "float64" if "double" in kind else "float32"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows * b.column(2)[0].as_py() for b in held if b.num_rows) * 8 >= tile_bytes:
                yield from cut(held, final=False)
        yield from cut(held, final=True)

    def cut(held: list[pa.RecordBatch], final: bool) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        dims = rows.column("dim").to_numpy()
        start = 0
        while start < len(dims):
            d = int(dims[start])
            size = max(1, tile_bytes // (8 * d))
            end = min(start + size, int(np.searchsorted(dims, d, side="right")))
            if end == len(dims) and end - start < size and not final:
                held.extend(rows.slice(start).to_batches())
                return
            part = rows.slice(start, end - start).combine_chunks()
            matrix = _matrix(part.column("embedding").chunk(0), d)
            box = (unit(matrix) @ turn[d])[:, :BOX]
            values = [
                [d],
                [box.min(axis=0).tolist()],
                [box.max(axis=0).tolist()],
                [part.column("node").to_numpy().astype("int64").tobytes()],
                [part.column("copies").to_numpy().astype("int64").tobytes()],
                [matrix.astype(number).tobytes()],
            ]
            types = (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, types, strict=True)], ["dim", "low", "high", "nodes", "copies", "rows"]
            )
            start = end

    packed = spread.sortWithinPartitions("dim", "lead", "node").mapInArrow(
        pack, "dim bigint, low array<double>, high array<double>, nodes binary, copies binary, rows binary"
    )
    return packed.withColumn("tile", F.monotonically_increasing_id())


def near_pairs(a: np.ndarray, b: np.ndarray, turned_a: np.ndarray, turned_b: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of ``a`` and ``b`` with a cosine of ``least`` or more, in blocks.

    ``a`` and ``b`` are unit rows, the other two the same rows in PCA order.
    The bound after the first directions is one matrix product, in which what
    is left of the lengths is a column of its own; pairs it leaves go on
    through the next directions, and those left at the end are decided by
    their exact cosine.
    """
    dim = a.shape[1]
    rest_a = [np.sqrt(np.maximum((turned_a[:, k:] ** 2).sum(axis=1), 0)) for k in range(STEP, dim, STEP)]
    rest_b = [np.sqrt(np.maximum((turned_b[:, k:] ** 2).sum(axis=1), 0)) for k in range(STEP, dim, STEP)]
    first_a = np.column_stack([turned_a[:, :STEP], *rest_a[:1]])
    first_b = np.column_stack([turned_b[:, :STEP], *rest_b[:1]])
    height = max(1, BLOCK // max(1, len(b)))
    for top in range(0, len(a), height):
        i, j = np.nonzero(first_a[top : top + height] @ first_b.T >= least - SLACK)
        i += top
        partial = np.einsum("ij,ij->i", turned_a[i, :STEP], turned_b[j, :STEP])
        for step, k in enumerate(range(STEP, dim, STEP), start=1):
            partial = partial + np.einsum("ij,ij->i", turned_a[i, k : k + STEP], turned_b[j, k : k + STEP])
            left = rest_a[step][i] * rest_b[step][j] if step < len(rest_a) else 0.0
            on = partial + left >= least - SLACK
            i, j, partial = i[on], j[on], partial[on]
        on = np.einsum("ij,ij->i", a[i], b[j]) >= least
        yield i[on], j[on]


def _compare(pairs: DataFrame, turn: dict[int, np.ndarray], number: str, least: float) -> DataFrame:
    """Link counts (``b`` null) and links that span the components, per pair of tiles."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                yield one_pair(*(batch.column(c)[r].as_py() for c in range(batch.num_columns)))

    def one_pair(dim, same, nodes_a, copies_a, rows_a, nodes_b, copies_b, rows_b) -> pa.RecordBatch:
        parts = []
        for nodes, copies, rows in ((nodes_a, copies_a, rows_a), (nodes_b, copies_b, rows_b)):
            matrix = unit(np.frombuffer(rows, number).reshape(-1, dim))
            parts.append((np.frombuffer(nodes, "int64"), np.frombuffer(copies, "int64"), matrix, matrix @ turn[dim]))
        (ids_a, n_a, a, turned_a), (ids_b, n_b, b, turned_b) = parts
        shift = 0 if same else len(ids_a)
        ids = ids_a if same else np.concatenate([ids_a, ids_b])
        label, links = np.arange(len(ids)), np.zeros(len(ids), "int64")
        for i, j in near_pairs(a, b, turned_a, turned_b, least):
            if same:
                i, j = i[i < j], j[i < j]
            np.add.at(links, i, n_b[j])
            np.add.at(links, j + shift, n_a[i])
            i, j = i, j + shift
            while len(i):
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                low = np.minimum(label[i], label[j])
                np.minimum.at(label, label[i], low)
                np.minimum.at(label, label[j], low)
                while (label != label[label]).any():
                    label = label[label]
        moved, counted = np.flatnonzero(label != np.arange(len(ids))), np.flatnonzero(links)
        first = pa.array(np.concatenate([ids[moved], ids[counted]]))
        second = pa.array(ids[label[moved]].tolist() + [None] * len(counted), pa.int64())
        third = pa.array(np.concatenate([np.zeros(len(moved), "int64"), links[counted]]))
        return pa.RecordBatch.from_arrays([first, second, third], ["a", "b", "n"])

    return pairs.mapInArrow(compare, "a bigint, b bigint, n bigint")


def near_duplicates(
    vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", tile_bytes: int = TILE_BYTES
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    ``n_links`` counts the other rows with a cosine of ``least`` or more,
    ``component_id`` is the smallest id reachable over such links and ``kept``
    whether it is the row's own. Equal vectors are one node with a number of
    copies. Vectors that are null, empty or zero, or hold null or non-finite
    components link with nothing, and so do vectors of different lengths with
    each other. Rows that share an id are vectors of their own; a null id is
    never the smallest, and a component of null ids has a null
    ``component_id`` and is not kept. Other columns are not read; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    picked = vectors.select(col(vectors, id_col).alias("vec_id"), col(vectors, vector_col).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    nodes = picked.where(usable).groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    number = "float64" if "double" in nodes.schema["embedding"].dataType.simpleString() else "float32"
    turn = rotations(nodes)

    tiles = stored(_tiles(nodes, turn, tile_bytes), "tiles")
    # One small row per tile; numbered so that a pair of tiles is named once.
    boxes = tiles.select("tile", "dim", "low", "high")
    order = F.expr("row_number() over (order by dim, tile)").cast("bigint")
    boxes = stored(boxes.select("*", order.alias("place")), "boxes")
    total = boxes.count()
    mine = boxes.select(*(F.col(c).alias(f"{c}_a") for c in boxes.columns))
    other = boxes.select(*(F.col(c).alias(f"{c}_b") for c in boxes.columns))
    mine = mine.withColumn("place_b", F.explode(F.sequence("place_a", F.lit(total).cast("bigint"))))
    gaps = F.zip_with("low_a", "high_b", lambda lo, hi: F.greatest(lo - hi, F.lit(0.0)))
    back = F.zip_with("low_b", "high_a", lambda lo, hi: F.greatest(lo - hi, F.lit(0.0)))
    apart = F.aggregate(F.zip_with(gaps, back, lambda x, y: x * x + y * y), F.lit(0.0), lambda s, x: s + x)
    pairs = mine.join(other, "place_b").where("dim_a = dim_b").where(apart <= 2 - 2 * least + SLACK)
    pairs = pairs.select("tile_a", "tile_b", F.col("dim_a").alias("dim"), (F.col("tile_a") == F.col("tile_b")).alias("same"))
    side = lambda s: tiles.select(*(F.col(c).alias(f"{c}_{s}") for c in ("tile", "nodes", "copies", "rows")))
    paired = pairs.join(side("a"), "tile_a").join(side("b"), "tile_b")
    paired = paired.repartition(max(total, shuffle_partitions(spark)), "tile_a", "tile_b")
    paired = paired.select("dim", "same", *(f"{c}_{s}" for s in "ab" for c in ("nodes", "copies", "rows")))
    found = stored(_compare(paired, turn, number, least), "links")

    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    joined = components(nodes.select("node"), found.where("b is not null").select("a", "b"))
    joined = joined.withColumnRenamed("node", "c").join(nodes.drop("embedding"), F.col("c") == F.col("node"))
    lowest = joined.groupBy("component").agg(F.min("first_id").alias("component_id")).withColumnRenamed("component", "k")
    named = joined.join(lowest, F.col("component") == F.col("k")).join(links, F.col("node") == F.col("a"), "left")
    named = named.select(
        F.col("node").alias("m"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    named = nodes.select("node", F.col("embedding").alias("e")).join(named, F.col("node") == F.col("m"))
    linked = picked.withColumn("usable", usable).join(named, F.col("usable") & (F.col("embedding") == F.col("e")), "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return linked.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.cast("bigint").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
