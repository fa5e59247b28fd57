"""Centroid clustering with an n-simplex projection in front of exact integer comparisons.

The distances of a vector to n pivots fix an apex over the simplex that the pivots span: n - 1
coordinates in the span and one height above it. For two apexes the Euclidean distance is a
lower bound of the distance of their vectors, and with one height mirrored an upper bound. The
squared distances to the pivots are computed once and stored with the vectors; in each round a
centroid is compared exactly only where its lower bound does not exceed the least upper bound, nor
the exact distance of the centroid with the least lower bound. All sums, distances and means are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ringsight.llm.common import stored

DIMENSIONS = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
PIVOTS = 12
SALT = 2
LARGEST = 1 << 27  # of a component in steps of 1 / SCALE: squared distances stay in 63 bits
FLAT = 0.02  # a pivot whose height over the others is a smaller share of the longest edge is left out
SLACK = 1e-5  # of the squared extent, far above the rounding errors of apexes over such a simplex
PAIRS = 1 << 14  # exact comparisons made at once


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)`` of the rows with exactly ``dimensions`` finite components, as floor(scale * x)."""
    x = F.col("embedding")
    bound = float(LARGEST // scale)
    fine = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) <= bound, F.lit(False)))
    given = vectors.select(vectors["vec_id"].cast("bigint").alias("vec_id"), vectors["embedding"].alias("embedding"))
    return given.where(F.coalesce((F.size(x) == dimensions) & fine, F.lit(False))).select(
        "vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("v")
    )


def starting_centroids(kept: DataFrame, number: int, salt: int) -> np.ndarray:
    """The ``number`` vectors with the smallest sha256 of ``salt:vec_id``; null ids last, equal ids by vector."""
    drawn = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(drawn.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(number).collect()
    return np.array([r.v for r in rows], np.int64)


def pivots_of(points: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Pivots out of ``points``, each with the largest height over those before, and their simplex.

    The simplex is lower triangular: row j - 1 holds the coordinates of pivot j, pivot 0 is the origin.
    """
    origin = points[0]
    square = ((points - origin) ** 2).sum(axis=1).astype(np.float64)
    chosen, base = [0], np.zeros((0, 0))
    coordinates = np.zeros((len(points), 0))
    longest = 0.0
    while len(chosen) < number:
        height = np.sqrt(np.maximum(square - (coordinates**2).sum(axis=1), 0))
        best = int(np.argmax(height))
        longest = max(longest, float(height[best]))
        if height[best] <= FLAT * longest or height[best] == 0:
            break
        grown = np.zeros((len(chosen), len(chosen)))
        grown[:-1, :-1] = base
        grown[-1] = [*coordinates[best], height[best]]
        chosen.append(best)
        base = grown
        to = np.stack([((points - points[c]) ** 2).sum(axis=1) for c in chosen], axis=1)
        coordinates = apexes(to, base)[:, :-1]
    return points[chosen], base


def apexes(square: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Apex coordinates from squared distances to the pivots (one column each); the height is last."""
    square = square.astype(np.float64)
    out = np.zeros_like(square)
    for j in range(len(base)):
        side = base[j, : j + 1]
        half = (square[:, 0] + (side**2).sum() - square[:, j + 1]) / 2
        out[:, j] = (half - out[:, :j] @ side[:j]) / side[j]
    out[:, -1] = np.sqrt(np.maximum(square[:, 0] - (out[:, :-1] ** 2).sum(axis=1), 0))
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def nearest(v: np.ndarray, near: np.ndarray, centroids: np.ndarray, base: np.ndarray, to: np.ndarray):
    """Nearest centroid of each row (ties: the smaller number), its squared distance, and how many were compared.

    ``near`` and ``to`` are the squared distances of rows and centroids to the pivots.
    """
    mine, theirs = apexes(near, base), apexes(to, base)
    span = (
        (mine[:, :-1] ** 2).sum(axis=1)[:, None] + (theirs[:, :-1] ** 2).sum(axis=1)[None, :]
        - 2 * mine[:, :-1] @ theirs[:, :-1].T
    )
    low = span + (mine[:, -1:] - theirs[:, -1][None, :]) ** 2
    high = span + (mine[:, -1:] + theirs[:, -1][None, :]) ** 2
    extent = max(float(near.max(initial=0)), float(to.max(initial=0)), 1.0)

    def exact(row: np.ndarray, number: np.ndarray) -> np.ndarray:
        parts = [slice(at, at + PAIRS) for at in range(0, len(row), PAIRS)]
        return np.concatenate([np.empty(0, np.int64), *[((v[row[p]] - centroids[number[p]]) ** 2).sum(axis=1) for p in parts]])

    # The likeliest centroid's own distance may be under the least upper bound.
    reached = np.minimum(high.min(axis=1), exact(np.arange(len(v)), low.argmin(axis=1)))
    row, number = np.nonzero(low <= reached[:, None] + SLACK * extent)
    found = exact(row, number)
    first = np.searchsorted(row, np.arange(len(v)))
    compared = np.diff(np.append(first, len(row)))
    least = np.minimum.reduceat(found, first)
    _, winner = np.unique(row[hit := found == least[row]], return_index=True)
    return number[hit][winner], least, compared


def _sums(cached: DataFrame, centroids: np.ndarray, base: np.ndarray, to: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Rows and componentwise sums of each cluster. A task gives one row per cluster at most."""
    width, pivots, number = centroids.shape[1], to.shape[1], len(centroids)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(number, np.int64), np.zeros((number, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"), width)
                cluster = nearest(v, _matrix(batch.column("near"), pivots), centroids, base, to)[0]
                order = np.argsort(cluster, kind="stable")
                found, first = np.unique(cluster[order], return_index=True)
                total[found] += np.add.reduceat(v[order], first, axis=0)
                count += np.bincount(cluster, minlength=number)
        used = np.flatnonzero(count)
        sums = pa.ListArray.from_arrays(
            pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(total[used].ravel(), pa.int64())
        )
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(count[used], pa.int64()), sums], names=["cluster", "n", "sums"])

    parts = cached.select("v", "near").mapInArrow(each, "cluster int, n bigint, sums array<bigint>")
    whole = lambda c: F.sum(c.cast("decimal(38,0)"))
    rows = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*[whole(F.col("sums")[i]) for i in range(width)]).alias("sums")
    ).collect()  # one row per cluster
    return {r.cluster: (r.n, [int(s) for s in r.sums]) for r in rows}


def cluster_vectors(
    vectors: DataFrame, number: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
    scale: int = SCALE, pivots: int = PIVOTS, salt: int = SALT,
) -> DataFrame:
    """One row per kept vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_compared``.

    Kept are vectors of exactly ``dimensions`` components, none null, NaN or infinite (nor beyond
    LARGEST / scale, where a squared distance would not fit a long). Null arrays and other
    lengths are left out. Repeated rows are rows of their own and give equal results; a null
    vec_id is clustered like any other and starts a centroid only where fewer than ``number``
    rows have an id. With fewer rows than ``number`` there are as many centroids as rows; no row
    gives no row. An inertia that does not fit a long is null. ``n_compared`` counts the centroids
    that the bounds left for exact comparison in the last assignment. Other columns are ignored.
    """
    kept = kept_vectors(vectors, dimensions, scale)
    centroids = starting_centroids(kept, number, salt)
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, n_compared int"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema)
    points, base = pivots_of(centroids, pivots)

    def distances(rows: np.ndarray) -> np.ndarray:
        return np.stack([((rows - p) ** 2).sum(axis=1) for p in points], axis=1)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = distances(_matrix(batch.column("v"), dimensions))
            edges = pa.array(np.arange(batch.num_rows + 1) * len(points), pa.int32())
            yield pa.record_batch(
                [*batch.columns, pa.ListArray.from_arrays(edges, pa.array(near.ravel(), pa.int64()))], names=["vec_id", "v", "near"]
            )

    cached = stored(kept.mapInArrow(measured, "vec_id bigint, v array<int>, near array<bigint>"))
    for _ in range(rounds):
        sums = _sums(cached, centroids, base, distances(centroids))
        centroids = np.array(
            [[s // sums[c][0] for s in sums[c][1]] if c in sums else list(old) for c, old in enumerate(centroids.tolist())], np.int64
        )
    to = distances(centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v, near = _matrix(batch.column("v"), dimensions), _matrix(batch.column("near"), len(points))
                cluster, distance, compared = nearest(v, near, centroids, base, to)
                columns = [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(compared, pa.int32())]
                yield pa.record_batch(columns, names=["vec_id", "cluster", "distance", "n_compared"])

    found = stored(cached.mapInArrow(assigned, "vec_id bigint, cluster int, distance bigint, n_compared int"))
    inside = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    total = inside.agg(F.sum("d").try_cast("bigint").alias("d")).scalar()
    named = found.sparkSession.createDataFrame(
        [(c, ",".join(map(str, row))) for c, row in enumerate(centroids.tolist())], "cluster int, components string"
    )
    # One row per centroid.
    per = inside.join(named, "cluster").select(
        "cluster", F.col("d").try_cast("bigint").alias("cluster_inertia"), F.sha2("components", 256).alias("centroid_sha256")
    )
    return found.join(F.broadcast(per), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256", "n_compared"
    )


def clusters_sql(
    number: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, salt: int = SALT
) -> str:
    """The same clusters by comparing every vector with every centroid; integers below 2**53 are exact in doubles."""
    square = "list_inner_product({0}, {0}) - 2 * list_inner_product({0}, {1}) + list_inner_product({1}, {1})".format("v.v", "c.c")
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v"
        f" FROM embeddings WHERE len(embedding) = {dimensions}"
        f" AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id::VARCHAR), v) - 1 AS cluster, v AS c FROM v"
        f" QUALIFY cluster < {number})",
    ]
    for k in range(rounds + 1):
        parts.append(
            f"a{k} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d"
            f" FROM (SELECT v.*, c.cluster, {square} AS d FROM v, c{k} AS c) GROUP BY r)"
        )
        if k < rounds:
            parts.append(
                f"m{k} AS (SELECT cluster, list(floor(s / n) ORDER BY i) AS c FROM (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n"
                f" FROM a{k}, range(1, {dimensions + 1}) AS g(i) GROUP BY cluster, i) GROUP BY cluster)"
            )
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{k} AS o LEFT JOIN m{k} AS m USING (cluster))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, cluster::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c.c, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} AS c USING (cluster)"""
