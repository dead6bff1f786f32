"""Exact integer k-means that skips most distances by Hamerly's bounds.

Vectors become integers; all sums, means and distances are integers too, so the result is the plain
algorithm's to the last digit.  Each vector keeps its cluster, an upper bound of the distance to its
own centroid and a lower bound of the distance to the second nearest.  When centroids move, the upper
bound grows by its own centroid's drift and the lower one shrinks by the largest drift of the others.  A
vector whose upper bound stays below its lower one (or below half the way from its centroid to the next)
cannot change its cluster; all others, ties included, get a full exact scan.  Bounds are doubles, moved
outwards by more than their rounding.

The table with the bounds is written every round, so a lost executor costs one task's work, and only
vectors that changed their cluster are read again, for the change of the sums.  The driver holds the
centroids and their sums, nothing that grows with the rows.

Results: vectors with another number of components, a null or a component that is not finite are left
out, as are null vectors; rows that share an id (or everything) are rows of their own; a null id hashes as
an empty one.  Fewer rows than clusters give as many clusters as rows, no row gives none.  Large components
are worked as Python integers; a distance or sum beyond 64 bits is null.  Only ``vec_id`` and
``embedding`` are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SALT = 64, 1024, 8, 10, "3"
#: Integers up to this size have squared distances below 2^63 in up to 128 dimensions.
SMALL = 1 << 27
#: Sums travel as digits of so many bits.
DIGIT = 40
#: Outward step of a bound; a chain of 64 roundings stays below it.
WIDER = 1e-12

STATE = "vec_id long, embedding array<double>, cluster int, was int, upper double, lower double"


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exactly; as Python integers where 64 bits might not do."""
    if not x.size or np.abs(x).max() * SCALE < SMALL:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([[math.floor(v * SCALE) if abs(v) < 2.0**52 else int(v) * SCALE for v in row] for row in x.tolist()], object).reshape(x.shape)


def squares(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distance of every vector to every centroid, exact."""
    small = x.dtype != object and max((abs(v) for c in centroids for v in c), default=0) < SMALL
    x, kind = (x, np.int64) if small else (x.astype(object), object)
    return np.stack([((x - np.array(c, kind)) ** 2).sum(axis=1) for c in centroids], axis=1) if len(centroids) else np.zeros((len(x), 0), kind)


def roots(d: np.ndarray) -> np.ndarray:
    """Distances from exact squares, as doubles; beyond their range, infinite."""
    if d.dtype != object:
        return np.sqrt(d.astype(np.float64))
    return np.array([[float(math.isqrt(v)) if v > 2**80 else math.sqrt(v) for v in row] if isinstance(row, list) else row for row in d.tolist()], np.float64)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, DIMENSIONS))


def scanned(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (of equally near ones the first), its squared distance, and both bounds."""
    d = squares(x, centroids)
    near = d.argmin(axis=1) if d.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in d.tolist()], np.int64).reshape(len(d))
    rows = np.arange(len(d))
    far = roots(d)
    upper = far[rows, near] * (1 + WIDER) if len(d) else np.zeros(0)
    far[rows, near] = np.inf
    lower = far.min(axis=1, initial=np.inf) * (1 - WIDER)
    return near, d[rows, near], upper, lower


def moved_bounds(cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: list[list[int]], centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds after the centroids moved, and which vectors they leave open."""
    drift = np.array([roots(squares(np.array([a], object), [b]))[0, 0] for a, b in zip(before, centroids, strict=True)]) * (1 + WIDER)
    others = np.array([max((d for j, d in enumerate(drift) if j != k), default=0.0) for k in range(len(drift))])
    between = roots(squares(np.array(centroids, object), centroids))
    np.fill_diagonal(between, np.inf)
    half = between.min(axis=1) / 2 * (1 - WIDER)
    with np.errstate(invalid="ignore"):
        upper = (upper + drift[cluster]) * (1 + WIDER)
        lower = np.where(lower == np.inf, np.inf, (lower - others[cluster]) - np.abs(lower) * WIDER)
    return upper, lower, ~(upper < np.maximum(lower, half[cluster]))


def assigned(state: DataFrame, before: list[list[int]] | None, centroids: list[list[int]]) -> DataFrame:
    """The next state: vectors that their bounds leave open are scanned, the others keep their cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("embedding"))
            if before is None:
                was = None
                cluster, _, upper, lower = scanned(integers(x), centroids)
            else:
                was = batch.column("cluster").to_numpy()
                cluster = was.astype(np.int64)
                upper, lower, open_ = moved_bounds(cluster, batch.column("upper").to_numpy(), batch.column("lower").to_numpy(), before, centroids)
                at = np.flatnonzero(open_)
                if len(at):
                    cluster[at], _, upper[at], lower[at] = scanned(integers(x[at]), centroids)
            columns = [pa.array(cluster, pa.int32()), pa.nulls(len(x), pa.int32()) if was is None else pa.array(was, pa.int32()), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), *columns], names=["vec_id", "embedding", "cluster", "was", "upper", "lower"])

    return state.mapInArrow(run, STATE)


def changed_sums(state: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By cluster, how count and component sums changed: what came in less what went out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for batch in batches:
            x = integers(matrix(batch.column("embedding")))
            for name, sign in (("cluster", 1), ("was", -1)):
                of = batch.column(name).to_numpy(zero_copy_only=False)
                for k in np.unique(of[~np.isnan(of.astype(np.float64))]).astype(int).tolist():
                    mine = x[of == k]
                    held = sums.setdefault(k, [0] * (x.shape[1] + 1))
                    for i, v in enumerate([len(mine), *mine.sum(axis=0).tolist()]):
                        held[i] += sign * v
        rows = []
        for k, held in sums.items():
            for i, v in enumerate(held):
                place = 0
                while v not in (0, -1) or not place:
                    v, digit = divmod(v, 1 << DIGIT)
                    rows.append((k, i, place, digit))
                    place += 1
                if v:
                    rows.append((k, i, place, v))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "i", "place", "digit"])

    moved = state.filter("was is null or was <> cluster").select("embedding", "cluster", "was")
    parts = moved.mapInArrow(run, "cluster long, i long, place long, digit long").groupBy("cluster", "i", "place").agg(F.sum("digit").alias("digit"))
    out: dict[int, list[int]] = {}
    for r in parts.collect():  # clusters times components
        out.setdefault(r["cluster"], [0] * (DIMENSIONS + 1))[r["i"]] += r["digit"] << (DIGIT * r["place"])
    return {k: (v[0], v[1:]) for k, v in out.items()}


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has all components, none of them null or not finite."""
    x = F.col("embedding")
    good = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.filter(x.isNotNull() & (F.size(x) == DIMENSIONS) & good).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = SALT) -> DataFrame:
    """Every kept vector with its cluster, its squared distance, both inertias and its centroid's digest."""
    spark = vectors.sparkSession
    kept = kept_vectors(vectors)
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = kept.select(digest.alias("digest"), "embedding").orderBy("digest", "embedding").limit(clusters).collect()
    centroids = [[int(v) for v in integers(np.array([r["embedding"]], np.float64))[0].tolist()] for r in first]
    sums = [(0, [0] * DIMENSIONS) for _ in centroids]
    state, before = kept, None
    for _ in range(rounds if centroids else 0):
        new = written(assigned(state, before, centroids), "bounds")
        if before is not None:
            discard(state)
        state, before = new, centroids
        change = changed_sums(state)
        sums = [(n + change[k][0], [a + b for a, b in zip(s, change[k][1], strict=True)]) if k in change else (n, s) for k, (n, s) in enumerate(sums)]
        centroids = [[v // n for v in s] if n else c for c, (n, s) in zip(centroids, sums, strict=True)]
    last = state if not centroids else written(assigned(state, before, centroids), "bounds")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cluster = integers(matrix(batch.column("embedding"))), batch.column("cluster").to_numpy()
            distance = np.zeros(len(x), object)
            for k in np.unique(cluster).tolist():
                distance[cluster == k] = squares(x[cluster == k], [centroids[k]])[:, 0]
            exact = [v if v < 2**63 else None for v in distance.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(exact, pa.int64())], names=["vec_id", "cluster", "distance"])

    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    out = written(last.select("vec_id", "embedding", "cluster").mapInArrow(measure, "vec_id long, cluster int, distance long"), "clusters")
    discard(last, *([state] if before is not None else []))
    exact = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    inertias = {r["cluster"]: r["inertia"] for r in out.groupBy("cluster").agg(exact.alias("inertia")).collect()}  # one row for each cluster
    long = lambda v: None if v is None or v >= 2**63 else int(v)
    total = long(sum(inertias.values())) if None not in inertias.values() else None
    rows = [(k, long(inertias.get(k)), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """Every round in turn: distances to all centroids, the nearest one, floored means."""
    floored = "((s - ((s % n) + n) % n) // n)::bigint"
    steps = [
        f"""kept as materialized (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda v: floor({SCALE} * v::double)::bigint) as x from embeddings
  where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0)""",
        f"""c0 as materialized (select (row_number() over (order by h, row) - 1)::int as cluster, x as c from (select row, x, sha256('{SALT}:' || coalesce(vec_id::varchar, '')) as h from kept) qualify row_number() over (order by h, row) <= {CLUSTERS})""",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} as materialized (
  select row, vec_id, x, cluster, distance from (
    select row, vec_id, x, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance from kept, c{k})
  qualify row_number() over (partition by row order by distance, cluster) = 1)""")
        if k < ROUNDS:
            steps.append(f"""c{k + 1} as materialized (
  select cluster, coalesce(m, c) as c from c{k} left join (
    select cluster, list({floored} order by i) as m from (
      select cluster, i, sum(v) as s, count(*) as n from (select cluster, unnest(x) as v, generate_subscripts(x, 1) as i from a{k}) group by cluster, i) group by cluster) using (cluster))""")
    k = ROUNDS
    return f"""with {", ".join(steps)}
select vec_id, cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
  sha256(array_to_string(list_transform(c, lambda v: v::varchar), ',')) as centroid_sha256
from a{k} join c{k} using (cluster)"""


#: The same rows in DuckDB.
ORACLE = _oracle()
