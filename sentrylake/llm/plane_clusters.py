"""Centroid clustering of vectors on bit planes.

Components become integers, floor(scale * x). A vector of 64 integers is stored
as its bit planes: one 64-bit word for each binary place, of which bit i is that
place of component i, in two's complement, so the highest place weighs negative.
A dot product is then the sum over pairs of planes of the product of their
weights times the population count of their AND, and a squared distance is
|v|^2 + |c|^2 - 2 v.c, all in exact integers. Packed vectors take 8 bytes a
binary place instead of 256 or 512.

Rounds are Spark jobs over the written planes: a task adds up what it assigns
to each centroid and gives one row a centroid; sums and centroids, some thousand
numbers, are all that the driver sees.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sentrylake.llm.common import SLICE
from sentrylake.session import discard, materialize

SIZE = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SEED = 2
BOUND = 1 << 27  # components below it in magnitude keep squared distances within 63 bits
STEP = 4 * SLICE


def integer_vectors(embeddings, scale=SCALE):
    """(vec_id, x): the vectors of exactly SIZE components, none null, NaN or infinite, as arrays of long integers.

    Raises, when run, where a scaled component reaches 2**27 in magnitude.
    """
    whole = F.col("embedding").cast("array<double>")
    finite = F.forall(whole, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    scaled = F.transform(whole, lambda v: F.floor(v * F.lit(float(scale))))
    large = F.exists("x", lambda v: F.abs(v) >= F.lit(BOUND))
    rows = embeddings.filter((F.size("embedding") == SIZE) & finite).select("vec_id", scaled.alias("x"))
    return rows.withColumn("x", F.when(large, F.raise_error(F.lit("a scaled component reaches 2**27")).cast("array<bigint>")).otherwise(F.col("x")))


def weights_of(places):
    """What a set bit of each plane adds."""
    found = np.left_shift(np.int64(1), np.arange(places, dtype=np.int64))
    found[-1] = -found[-1]
    return found


def pack(x, places):
    """The planes (places x n, uint64) of n vectors of SIZE integers."""
    bits = np.stack([(x >> np.int64(k) & np.int64(1)).astype(np.uint8) for k in range(places)])
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def unpack(planes):
    """The integers (n x SIZE) of planes."""
    bits = np.unpackbits(np.ascontiguousarray(planes)[:, :, None].view(np.uint8), axis=2, bitorder="little")
    return np.einsum("p,pnc->nc", weights_of(len(planes)), bits, dtype=np.int64, casting="unsafe")


def dot_products(planes, others):
    """(n x m) dot products of n packed vectors with m others, by population counts of ANDed planes."""
    weights = weights_of(len(planes))
    out = np.empty((planes.shape[1], others.shape[1]), np.int64)
    # counts of one plane are at most SIZE, so narrow sums do up to 24 places
    narrow = np.int32 if len(planes) <= 24 else np.int64
    for k in range(others.shape[1]):
        total = np.zeros(planes.shape, narrow)
        for weight, plane in zip(weights, others[:, k]):
            if plane:
                total += np.bitwise_count(planes & plane) * narrow(weight)
        out[:, k] = weights @ total.astype(np.int64)
    return out


def nearest(planes, norms, centroids, places):
    """(number, squared distance) of the nearest centroid of each vector, the smaller number first among equals."""
    own = (centroids * centroids).sum(axis=1)
    distances = norms[:, None] + own - 2 * dot_products(planes, pack(centroids, places))
    found = distances.argmin(axis=1)
    return found, distances[np.arange(len(found)), found]


def _planes_of(batch, places):
    return np.ascontiguousarray(np.frombuffer(b"".join(batch.column("planes").to_pylist()), np.uint64).reshape(-1, places).T)


def packed_vectors(vectors, places):
    """(vec_id, norm, planes) of (vec_id, x); written, as every round reads it."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                x = np.asarray(part.column(1).flatten()).reshape(-1, SIZE)
                planes = np.ascontiguousarray(pack(x, places).T).view(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array((x * x).sum(axis=1)), pa.array([p.tobytes() for p in planes], pa.binary()),
                ], ["vec_id", "norm", "planes"])

    return materialize(vectors.select(F.col("vec_id").cast("long"), "x").mapInArrow(run, "vec_id long, norm long, planes binary"))


def _slices(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, STEP):
            yield batch.slice(start, STEP)


def cluster_sums(packed, centroids, places):
    """{number: (count, component sums)} of the vectors nearest to each centroid."""

    def run(batches):
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), SIZE), np.int64)
        for part in _slices(batches):
            planes = _planes_of(part, places)
            number, _ = nearest(planes, np.asarray(part.column("norm")), centroids, places)
            order = np.argsort(number, kind="stable")
            found, first, count = np.unique(number[order], return_index=True, return_counts=True)
            counts[found] += count
            sums[found] += np.add.reduceat(unpack(planes)[order], first, axis=0)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], ["number", "n", "sums"])

    parts = packed.mapInArrow(run, "number long, n long, sums array<long>")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = parts.select("number", "n", F.posexplode("sums").alias("place", "part")).groupBy("number", "place").agg(
        wide("n").alias("n"), wide("part").alias("total")).collect()  # one row for each component of a centroid
    found = {}
    for row in rows:
        found.setdefault(row["number"], (int(row["n"]), [0] * SIZE))[1][row["place"]] = int(row["total"])
    return found


def first_centroids(vectors, count=CENTROIDS, seed=SEED):
    """The vectors with the smallest SHA-256 of "seed:vec_id" (null ids last; then the smaller vector)."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "x").orderBy(F.col("key").asc_nulls_last(), "x").limit(count).collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(-1, SIZE)


def cluster_vectors(embeddings, count=CENTROIDS, rounds=ROUNDS, scale=SCALE, seed=SEED):
    """(vectors, centroids): vec_id, cluster and distance of every kept vector, and cluster, centroid, n and inertia of every centroid.

    Vectors that are null, of another length or with null, NaN or infinite
    components are left out. Repeated rows are vectors of their own. With fewer
    vectors than `count` there are as many centroids; an empty table gives none.
    An empty cluster keeps its centroid.
    """
    spark = embeddings.sparkSession
    vectors = integer_vectors(embeddings, scale)
    low, high = vectors.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    places = max(int(high), ~int(low)).bit_length() + 1 if high is not None else 1
    centroids = first_centroids(vectors, count, seed)
    names = "vec_id long, cluster int, distance long"
    if not len(centroids):
        none = spark.createDataFrame([], names)
        return none, spark.createDataFrame([], "cluster int, centroid array<long>, n long, inertia long")
    packed = packed_vectors(vectors, places)
    for _ in range(rounds):
        for number, (n, total) in cluster_sums(packed, centroids, places).items():
            centroids[number] = [t // n for t in total]

    def run(batches):
        for part in _slices(batches):
            number, distance = nearest(_planes_of(part, places), np.asarray(part.column("norm")), centroids, places)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    found = materialize(packed.mapInArrow(run, names))
    discard(packed)
    table = spark.createDataFrame([(k, c) for k, c in enumerate(centroids.tolist())], "cluster int, centroid array<long>")
    sums = found.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("inertia"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found, table.join(sums, "cluster", "left").select("cluster", "centroid", zero("n"), zero("inertia"))


def op12(spark, folder):
    vectors, centroids = cluster_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
    facts = centroids.select(
        "cluster", F.col("inertia").alias("cluster_inertia"),
        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256).alias("centroid_sha256"))
    total = centroids.agg(F.sum("inertia").alias("inertia"))
    facts = F.broadcast(facts.crossJoin(F.broadcast(total)))  # a row for each centroid
    return vectors.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(rounds=ROUNDS):
    distance = "CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    near = "SELECT r, arg_min(k, {d} * 64 + k) AS k, min({d}) AS d FROM v, c{i} GROUP BY r".replace("{d}", distance)
    steps = []
    for i in range(rounds):
        steps += [
            f"a{i} AS MATERIALIZED ({near.format(i=i)})",
            f"s{i} AS (SELECT k, p, CAST(floor(sum(x[p]) / count(*)) AS BIGINT) AS m FROM a{i} JOIN v USING (r), range(1, 65) t(p) GROUP BY k, p)",
            f"m{i} AS (SELECT k, list(m ORDER BY p) AS m FROM s{i} GROUP BY k)",
            f"c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m, c) AS c FROM c{i} LEFT JOIN m{i} ON m{i}.k = c{i}.k)",
        ]
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 256) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS k, x AS c
  FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT 40)),
{", ".join(steps)},
a AS MATERIALIZED ({near.format(i=rounds)}),
s AS (SELECT k, sum(d) AS t FROM a GROUP BY k)
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, CAST(s.t AS BIGINT) AS cluster_inertia,
       CAST((SELECT sum(d) FROM a) AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a JOIN v ON v.r = a.r JOIN s ON s.k = a.k JOIN c{rounds} ON c{rounds}.k = a.k
"""


OP12_SQL = _sql()
