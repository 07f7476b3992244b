"""Integer k-means by sort-means.

Vectors become integers once and are stored; centroids are integers too, so every distance is exact and the result does
not depend on how rows are dealt out. A round is one narrow job over the stored vectors: a row is read with the cluster it
had before. The other centroids are ordered by their distance from that one, and are tried in this order until they lie
strictly beyond twice the row's distance from it; by the triangle inequality none further can be nearer or as near. The
task writes each row with its new cluster, and one row of sums a cluster; the next centroids come from those sums alone.
The vectors of the round before are deleted then, so a lost executor costs the tasks it held and no more.

Kept are vectors of exactly ``dims`` components, none null or not finite; others, null vectors among them, have no row in
the result. Repeated rows and rows of one id each count. Null ids hash as an empty text and stay. Fewer kept vectors than
clusters: each kept vector starts one. Equal hashes start in the order of their components. No kept vector: an empty
result. Ties go to the smaller number. Other columns, whatever their names, are ignored. Integers of 2**27 and more would
not leave room for a distance in 64 bits; they raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import discard, shared_path

LARGEST = 1 << 27
#: Rows whose differences from a centroid are held at once.
CHUNK = 1 << 15


def squared(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x from one centroid."""
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), CHUNK):
        gap = x[at : at + CHUNK] - center
        out[at : at + CHUNK] = np.einsum("ij,ij->i", gap, gap)
    return out


def sort_means(x: np.ndarray, before: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid and its squared distance, from the row's cluster before; and how many distances were computed."""
    cluster, distance, tried = before.astype(np.int32), np.empty(len(x), np.int64), 0
    for a in np.unique(before):
        mine = np.flatnonzero(before == a)
        between = squared(centers, centers[a])
        own = squared(x[mine], centers[a])
        best, least, live = np.full(len(mine), a, np.int32), own.copy(), np.arange(len(mine))
        tried += len(mine)
        for j in np.lexsort((np.arange(len(centers)), between)):
            if j == a:
                continue
            live = live[own[live] >= (between[j] + 3) // 4]  # between > 4 * own: strictly beyond twice the distance
            if not len(live):
                break
            tried += len(live)
            new = squared(x[mine[live]], centers[j])
            wins = (new < least[live]) | ((new == least[live]) & (j < best[live]))
            best[live[wins]], least[live[wins]] = j, new[wins]
        cluster[mine], distance[mine] = best, least
    return cluster, distance, tried


def quantise(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """Rows of vec_id, v (integers) and cluster 0, for the vectors that are kept."""
    v = F.col(vector_col)
    inner = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where((F.size(v) == dims) & inner)
    return kept.select(F.col(id_col).alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"), F.lit(0).alias("cluster"))


def _round(rows: DataFrame, centers: list[list[int]]) -> DataFrame:
    """Rows of vec_id, v, cluster and distance, and for each task rows of sums and n for its clusters."""
    dims, id_field = len(centers[0]), rows.schema["vec_id"]
    schema = T.StructType(
        [
            T.StructField("vec_id", id_field.dataType),
            T.StructField("v", T.ArrayType(T.LongType())),
            T.StructField("cluster", T.IntegerType()),
            T.StructField("distance", T.LongType()),
            T.StructField("sums", T.ArrayType(T.LongType())),
            T.StructField("n", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(centers, np.int64)
        sums, counts = np.zeros_like(at), np.zeros(len(at), np.int64)
        lists, longs, ids = pa.list_(pa.int64()), pa.int64(), None
        for batch in batches:
            ids = batch.column(0)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            if x.size and max(int(x.max()), -int(x.min())) >= LARGEST:
                raise ValueError(f"components must stay under {LARGEST} in size after scaling")
            cluster, distance, _ = sort_means(x, batch.column(2).to_numpy(zero_copy_only=False), at)
            for c in np.unique(cluster):
                sums[c] += x[cluster == c].sum(axis=0)
            counts += np.bincount(cluster, minlength=len(at))
            n = len(batch)
            yield pa.RecordBatch.from_arrays([ids, batch.column(1).cast(lists), pa.array(cluster), pa.array(distance), pa.nulls(n, lists), pa.nulls(n, longs)], names=schema.names)
        if ids is not None:
            k = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, ids.type), pa.nulls(k, lists), pa.array(np.arange(k, dtype=np.int32)), pa.nulls(k, longs), pa.array(sums.tolist(), lists), pa.array(counts)], names=schema.names
            )

    return rows.select("vec_id", "v", "cluster").mapInArrow(run, schema)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows of vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256, one for each kept vector."""
    spark = vectors.sparkSession
    held = shared_path(spark, "vectors-0")
    quantise(vectors, dims, scale, id_col, vector_col).write.parquet(held)
    rows = spark.read.parquet(held)
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centers = [list(r["v"]) for r in rows.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(k).collect()]
    if not centers:
        nothing = F.lit(None).cast("long")
        return rows.select("vec_id", "cluster", nothing.alias("distance"), nothing.alias("cluster_inertia"), nothing.alias("inertia"), F.lit(None).cast("string").alias("centroid_sha256"))
    for nth in range(1, rounds + 2):
        path = shared_path(spark, f"vectors-{nth}")
        _round(rows, centers).write.parquet(path)
        discard(spark, held)
        held, done = path, spark.read.parquet(path)
        rows = done.where(F.col("n").isNull())
        if nth <= rounds:
            parts = done.where(F.col("n").isNotNull()).select("cluster", "n", F.posexplode("sums").alias("i", "x"))
            for r in parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).where("n > 0").collect():  # k * dims rows
                centers[r["cluster"]][r["i"]] = r["x"] // r["n"]
    per = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("cluster_inertia")).collect()  # k rows
    whole = sum(int(r["cluster_inertia"]) for r in per)
    facts = [(r["cluster"], int(r["cluster_inertia"]), whole, hashlib.sha256(",".join(map(str, centers[r["cluster"]])).encode()).hexdigest()) for r in per]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same by comparing every vector with every centroid in each round."""
    gap = "CAST(list_sum(list_transform(list_zip(r.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    steps = [
        f"""rows_ AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS INTEGER) AS c, v FROM rows_) WHERE c < {k}
)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT rid, min(d) AS d, arg_min(c, d * {k} + c) AS c FROM (SELECT r.rid, c.c, {gap} AS d FROM rows_ r, c{i} c) GROUP BY rid)")
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(u.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT c, list(m ORDER BY nth) AS v FROM (
      SELECT c, nth, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
      FROM (SELECT a.c, unnest(r.v) AS x, unnest(range({dims})) AS nth FROM a{i} a JOIN rows_ r USING (rid)) GROUP BY c, nth
    ) GROUP BY c
  ) u USING (c)
)"""
            )
    last = f"a{rounds}"
    return f"""WITH {", ".join(steps)}
SELECT r.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM {last} a JOIN rows_ r USING (rid) JOIN c{rounds} c ON c.c = a.c"""
