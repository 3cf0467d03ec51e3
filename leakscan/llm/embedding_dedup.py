"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells.

Centroids are fitted on a bounded sample and every vector is assigned to its nearest one; cells are
joined to tiles of about TILE vectors. Let u of cell c and v of cell d be a link, so that
|u - v| <= r = sqrt(2 - 2 * least). As u * c >= u * d, v * d - v * c <= (v - u) * (d - c) <= r * |d - c|.
So a vector visits each tile before its own that has a cell c with v * d - v * c within this bound;
a tile compares its own vectors with each other and with its visitors, and each link is met in just
one tile, none in no tile. Where vectors lie in no clusters the bound rules out little, and
nearly all pairs are compared. A tile's vectors are dealt to blocks, and a task gets two blocks of a
tile, so a crowded one is spread over tasks.
Equal vectors are one class that counts as often as it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.llm.common import components, join_hot, release, save

#: Vectors that k-means is fitted on, its rounds, cells at most; a tile's vectors on average (more where cells are larger); vectors in a block.
SAMPLE, ROUNDS, CELLS, TILE, BLOCK = 20_000, 8, 4096, 8192, 8192


def spherical_kmeans(x: np.ndarray, k: int) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([(x[i : i + 2048] @ c.T).argmax(axis=1) for i in range(0, len(x), 2048)])
        order = np.argsort(own, kind="stable")
        heads = np.flatnonzero(np.append(True, np.diff(own[order]) != 0))
        sums = np.add.reduceat(x[order], heads)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c[own[order][heads]] = np.where(norm > 0, sums / np.maximum(norm, 1e-300), sums)
    return c


def matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def units(col: pa.Array) -> np.ndarray:
    x = matrix(col)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _tiles(centroids: np.ndarray, tiles: int, least: float):
    """Each vector with its own tile and the tiles before it that it visits."""
    tile = (centroids @ spherical_kmeans(centroids, tiles).T).argmax(axis=1)
    order = np.argsort(tile, kind="stable")
    centroids, tile = centroids[order], tile[order]
    heads = np.flatnonzero(np.append(True, np.diff(tile) != 0))
    tile = np.cumsum(np.append(0, np.diff(tile) != 0))
    square = (centroids * centroids).sum(axis=1)
    apart = np.sqrt(np.maximum(square[:, None] + square - 2 * centroids @ centroids.T, 0))
    bound = np.sqrt(max(2 - 2 * least, 0)) * apart + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = units(b.column("embedding"))
            for i in range(0, len(x), 2048):
                s = x[i : i + 2048] @ centroids.T
                own = s.argmax(axis=1)
                near = np.logical_or.reduceat(s.max(axis=1, keepdims=True) - s <= bound[own], heads, axis=1)
                near &= np.arange(len(heads)) < tile[own][:, None]
                visits = np.split(np.nonzero(near)[1].astype(np.int32), np.cumsum(near.sum(axis=1))[:-1])
                c = b.slice(i, len(s))
                yield pa.RecordBatch.from_arrays([c.column("id"), c.column("weight"), c.column("embedding"), pa.array(tile[own], pa.int32()), pa.array([v.tolist() for v in visits], pa.list_(pa.int32()))], ["id", "weight", "embedding", "own", "visits"])

    return run


def _tie(up: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Joins the links (u, v) into up, the smallest place that each place is tied to."""
    while len(u):
        p, q = up[u], up[v]
        apart = p != q
        u, v, p, q = u[apart], v[apart], p[apart], q[apart]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while ((over := up[up]) != up).any():
            up = over
    return up


def _products(least: float):
    """Over two blocks of a tile: each id that has links, with their number and the smallest id it is tied to by links of these blocks."""

    def run(keys: tuple, t: pa.Table) -> pa.Table:
        _, left, right = (k.as_py() for k in keys)
        t = t.combine_chunks().sort_by("id")
        ids, weight, block = t.column("id").to_numpy(), t.column("weight").to_numpy(), t.column("block").to_numpy()
        x = units(t.column("embedding").combine_chunks())
        p, q = np.flatnonzero(block == left), np.flatnonzero(block == right)
        links, up, y = np.zeros(len(ids), np.int64), np.arange(len(ids)), x[q].T
        for i in range(0, len(p), 256):
            a, b = np.nonzero(x[p[i : i + 256]] @ y >= least)
            u, v = p[a + i], q[b]
            if left == right:
                u, v = u[u < v], v[u < v]
            np.add.at(links, u, weight[v])
            np.add.at(links, v, weight[u])
            up = _tie(up, u, v)
        some = np.flatnonzero(links)
        return pa.table({"id": pa.array(ids[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "tie": pa.array(ids[up[some]], pa.int64())})

    return run


def near_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """Links of cosine >= least among vectors (vec_id, embedding): vec_id, n_links, component_id, kept for every row.

    Null or zero vectors, and those with null or non-finite components, are linked with nothing, as
    are rows with a null vec_id (component_id null, kept). Only vectors of one length are compared
    with each other. n_links counts rows, so a repeated vec_id with a valid vector links with itself. Rows
    of one vec_id with different vectors are of one component; each has its own n_links.
    """
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.expr("size(embedding) > 0 AND forall(embedding, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('infinity')) AND exists(embedding, e -> e <> 0)")
    x = save(x.withColumn("ok", F.coalesce(fine & F.col("vec_id").isNotNull(), F.lit(False))), "vectors", few=False)
    solid = x.where("ok").withColumn("embedding", F.expr("transform(embedding, e -> e + 0.0D)"))
    classes = solid.groupBy("embedding").agg(F.min("vec_id").alias("vec"), F.count("*").alias("weight"))
    # a number of its own for each class, as several can have one vec_id
    classes = save(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    links = None
    for (size,) in classes.select(F.size("embedding")).distinct().collect() if not classes.isEmpty() else []:
        some = classes.where(F.size("embedding") == size)
        n = some.count()
        sample = some.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
        centroids = spherical_kmeans(units(sample), int(min(max(1, n**0.5), CELLS, len(sample))))
        tiles = min(len(centroids), -(-n // TILE))
        rows = save(some.mapInArrow(_tiles(centroids, tiles, least), "id long, weight long, embedding array<double>, own int, visits array<int>"), "tiles")
        placed = rows.withColumn("tile", F.explode(F.expr("array_append(visits, own)"))).withColumn("mine", F.expr("tile = own")).drop("own", "visits")
        blocks = lambda mine: F.ceil(F.count_if(mine) / BLOCK).cast("int")
        counts = placed.groupBy("tile").agg(blocks(F.col("mine")).alias("n_own"), blocks(~F.col("mine")).alias("n_guest"))
        placed = placed.join(F.broadcast(counts), "tile")
        placed = placed.withColumn("block", F.expr("cast(if(mine, pmod(xxhash64(id), n_own), n_own + pmod(xxhash64(id), n_guest)) as int)"))
        # blocks of guests follow those of the tile's own and meet only these
        placed = placed.withColumn("other", F.explode(F.expr("filter(sequence(0, if(mine, n_own + n_guest, n_own)), (o, i) -> o < if(mine, n_own + n_guest, n_own))")))
        placed = placed.select("id", "weight", "embedding", "block", "tile", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
        found = placed.groupBy("tile", "p", "q").applyInArrow(_products(least), "id long, links long, tie long")
        links = found if links is None else links.union(found)
    if links is None:
        return x.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = save(links, "links")
    release(x.sparkSession)
    # rows of one vec_id tie their classes
    rows = join_hot(solid, classes.select("embedding", "id", "weight", F.col("weight").alias("times")), ["embedding"], solid.count())
    rows = save(rows.select("vec_id", "id", "weight"), "rows")
    several = rows.groupBy("vec_id").agg(F.min("id").alias("dst"), F.max("id").alias("last")).where("dst < last").select("vec_id", "dst")
    ties = links.select(F.col("id").alias("src"), F.col("tie").alias("dst")).union(rows.join(several, "vec_id").select(F.col("id").alias("src"), "dst"))
    comps = components(ties)
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.select("id", "vec", "weight").join(counts, "id", "left").join(comps, F.col("id") == F.col("node"), "left")
    known = known.select("id", "vec", F.col("weight").alias("times"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("comp", "id").alias("comp"))
    known = save(known, "known")
    first = known.groupBy("comp").agg(F.min("vec").alias("first"), F.count("*").alias("times"))
    known = join_hot(known.withColumnRenamed("times", "weight"), save(first, "first"), ["comp"], known.count()).select("id", "n", F.col("first").alias("comp"), F.col("weight").alias("times"))
    mine = join_hot(rows.select("vec_id", "id"), save(known, "known-classes"), ["id"], rows.count()).select("vec_id", "n", "comp")
    rest = x.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("comp"))
    return mine.union(rest).select("vec_id", F.col("n").alias("n_links"), F.col("comp").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("comp"), F.lit(True)).alias("kept"))
