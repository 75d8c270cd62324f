"""Centroid clustering in whole numbers, with a distance matrix that is kept up to date.

Every vector is stored with its dot products with all centroids.  When centroids
move, only the components that changed are multiplied and added; the squared
distance follows from the dot product and two norms, and the argmin is taken anew.
All numbers are whole, so no result depends on the order of rows or tasks.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from retentia.llm.common import stage_and_release
from retentia.sources.staging import stage

SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
SEED = "3"
# Components below 2^27 keep every product, norm and distance of 64 of them within 64 bits.
LARGEST = 1 << 27


@dataclass(frozen=True)
class Fitted:
    """Assignments (key, cluster, distance) and the final centroids as whole numbers."""

    assigned: DataFrame
    centroids: list


def whole_vectors(df: DataFrame, key: str, column: str, components: int) -> DataFrame:
    """(key, x): vectors with exactly `components` finite numbers, as floor(1024 * number)."""
    values = F.transform(F.col(column), lambda v: F.floor(v.cast("double") * SCALE))
    fits = F.forall(
        F.col(column),
        lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) * SCALE < LARGEST), F.lit(False)),
    )
    # The guard stands in the projection too, as a filter may be moved past it.
    good = F.coalesce((F.size(column) == components) & fits, F.lit(False))
    return df.select(F.col(key).alias("key"), F.when(good, values).cast("array<long>").alias("x")).where("x IS NOT NULL")


def first_centroids(vectors: DataFrame, n: int, seed: str) -> list:
    """The n vectors whose `seed:key` hashes lowest; ties go to the smaller vector."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    rows = vectors.select(order.alias("h"), "x").orderBy("h", "x").limit(n).collect()
    return [list(r["x"]) for r in rows]


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return values.reshape(len(column), -1)


def _advance(state: DataFrame, old: list | None, new: list) -> DataFrame:
    """The state after centroids moved from `old` to `new`; `old` is None at the start.

    State columns: key, x, dots (with each centroid), cluster, before, distance.
    """
    now = np.array(new, dtype=np.int64)
    change = now if old is None else now - np.array(old, dtype=np.int64)
    moved = [(j, np.flatnonzero(change[j])) for j in range(len(now))]
    steps = [(j, at, change[j, at]) for j, at in moved if len(at)]
    norms = (now * now).sum(axis=1)
    schema = T.StructType([
        state.schema["key"], T.StructField("x", T.ArrayType(T.LongType())),
        T.StructField("dots", T.ArrayType(T.LongType())), T.StructField("cluster", T.IntegerType()),
        T.StructField("before", T.IntegerType()), T.StructField("distance", T.LongType()),
    ])
    fields = ["key", "x", "dots", "cluster", "before", "distance"]

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["x"])
            if old is None:
                dots = np.zeros((len(x), len(now)), dtype=np.int64)
                before = np.full(len(x), -1, dtype=np.int32)
            else:
                dots = _matrix(batch["dots"]).copy()
                before = batch["cluster"].to_numpy(zero_copy_only=False)
            for j, at, by in steps:
                dots[:, j] += x[:, at] @ by
            distance = norms - 2 * dots + (x * x).sum(axis=1)[:, None]
            cluster = distance.argmin(axis=1)
            lists = pa.ListArray.from_arrays(
                np.arange(len(x) + 1, dtype=np.int32) * len(now), pa.array(dots.ravel())
            )
            yield pa.RecordBatch.from_arrays([
                batch["key"], batch["x"], lists, pa.array(cluster.astype(np.int32)),
                pa.array(before, type=pa.int32()), pa.array(distance[np.arange(len(x)), cluster]),
            ], names=fields)

    return state.mapInArrow(work, schema)


def _changes(state: DataFrame, components: int) -> dict:
    """cluster -> (rows, component sums) that came in, less those that went.

    Only vectors that changed their cluster are summed, in each task first.
    """
    moved = state.where("cluster <> before").select("cluster", "before", "x")
    wide = T.StructType([
        T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("i", T.IntegerType()), T.StructField("s", T.LongType()),
    ])

    def partial(batches):
        for batch in batches:
            x = _matrix(batch["x"]) if batch.num_rows else np.zeros((0, components), dtype=np.int64)
            for sign, name in ((1, "cluster"), (-1, "before")):
                labels = batch[name].to_numpy(zero_copy_only=False)
                for c in np.unique(labels[labels >= 0]).tolist():
                    rows = x[labels == c]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(components, c, dtype=np.int32)),
                        pa.array(np.full(components, sign * len(rows), dtype=np.int64)),
                        pa.array(np.arange(components, dtype=np.int32)),
                        pa.array(sign * rows.sum(axis=0)),
                    ], names=["cluster", "n", "i", "s"])

    sums = moved.mapInArrow(partial, wide).groupBy("cluster", "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    )
    out = {}
    for row in sums.collect():  # centroids * components rows
        n, s = out.setdefault(row["cluster"], [0, [0] * components])
        out[row["cluster"]][0] = row["n"]
        s[row["i"]] = int(row["s"])
    return out


def cluster(
    df: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = 64,
    n: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED,
) -> Fitted:
    """Lloyd's rounds over the vectors of `df`, then one more assignment.

    Vectors that are null, of another length, or hold a null or non-finite component
    are left out, as are those with a component of 2^27 / 1024 or more, whose squares
    do not fit 64 bits.  A null key hashes as an empty text.  Repeated rows count as
    often as they stand there.  Ties go to the smaller cluster, an empty cluster keeps
    its centroid, and with fewer vectors than `n` there are fewer centroids; of no
    vectors there are no assignments.  Extra columns are ignored.  Each round reads
    and writes one table of vectors with dot products; the table before it is given
    up once the next is written.  The driver holds centroids only.
    """
    vectors = stage(whole_vectors(df, key, column, components), "vectors")
    centres = first_centroids(vectors, n, seed)
    if not centres:
        empty = vectors.select(
            "key", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")
        )
        return Fitted(empty, [])
    totals = {j: [0, [0] * components] for j in range(len(centres))}
    state, old = stage_and_release(_advance(vectors, None, centres), vectors, "centroids"), centres
    for _ in range(rounds):
        for j, (rows, sums) in _changes(state, components).items():
            totals[j][0] += rows
            totals[j][1] = [a + b for a, b in zip(totals[j][1], sums)]
        centres = [
            [s // totals[j][0] for s in totals[j][1]] if totals[j][0] else old[j] for j in range(len(old))
        ]
        if centres == old:
            break  # nothing moves any more: further rounds would repeat this one
        state, old = stage_and_release(_advance(state, old, centres), state, "centroids"), centres
    return Fitted(state.select("key", "cluster", "distance"), old)


def digest(fitted: Fitted) -> DataFrame:
    """Per vector: key, cluster, distance, sums over its cluster and all, its centroid's hash.

    A sum that no long holds is null.
    """
    sums = {r["cluster"]: int(r["s"]) for r in fitted.assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row per cluster

    def literal(value):
        return F.lit(value).cast("decimal(38,0)").try_cast("long")

    per = F.array(*[literal(sums.get(j, 0)) for j in range(len(fitted.centroids))]) if sums else F.array(literal(0))
    hashes = F.array(*[
        F.sha2(F.lit(",".join(map(str, c))), 256) for c in fitted.centroids
    ]) if fitted.centroids else F.array(F.lit(""))
    return fitted.assigned.select(
        F.col("key").alias("vec_id"), "cluster", "distance",
        per[F.col("cluster")].alias("cluster_inertia"), literal(sum(sums.values())).alias("inertia"),
        hashes[F.col("cluster")].alias("centroid_sha256"),
    )


def oracle_sql(components: int = 64, n: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> str:
    """DuckDB SQL, every distance computed anew in every round."""
    parts = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {components}
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, x
  FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {n})
)"""]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, vec_id, x, unnest(min_by({{'c': c, 'd': d}}, d * {n} + c, 1)) AS best
  FROM (SELECT r, vec_id, v.x, c, list_sum(list_transform(range(1, {components + 1}),
               lambda j: (v.x[j] - k.x[j]) * (v.x[j] - k.x[j])))::BIGINT AS d
        FROM v CROSS JOIN c{i} k) GROUP BY r, vec_id, x
)""")
        if i < rounds:
            parts.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT k.c, coalesce(m.x, k.x) AS x FROM c{i} k LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x
    FROM (SELECT best.c AS c, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n
          FROM a{i} CROSS JOIN range(1, {components + 1}) t(j) GROUP BY ALL) GROUP BY c
  ) m ON k.c = m.c
)""")
    return "WITH " + ",".join(parts) + f"""
SELECT a.vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} k ON a.best.c = k.c
"""
