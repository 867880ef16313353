"""Clusters of integer vectors, with distances from bit planes.

A vector has 64 integers. Bit b of all of them is one plane, a word of 64 bits, so a vector of B-bit numbers is B words. Numbers
are in two's complement: plane b weighs 2^b and the highest one -2^(B - 1). The dot product of two vectors is

    sum over planes i, j of weight_i * weight_j * popcount(x_i & y_j)

exactly, and so are squared lengths and distances. Sums of vectors are counts of the ones of each plane at each place.

Vectors are packed once and stored. A round is one narrow pass over the planes, in which each task sends a row of sums
for every centroid it has vectors for; the driver holds the centroids and gets a row for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.registry import query, table
from tallyweave.llm.shared import stored
from tallyweave.session import spread

#: Components of a vector, and bits of a word.
SIZE = 64
CENTROIDS, ROUNDS, SCALE, SEED = 8, 10, 1024, 3
#: Numbers are below this in size, so that squared distances are below 2^62.
LIMIT = 1 << 27
#: Vectors that are compared with the centroids at a time.
ROWS = 4096


def weights(bits: int) -> np.ndarray:
    out = np.int64(1) << np.arange(bits, dtype=np.int64)
    out[-1] *= -1
    return out


def pack(numbers: np.ndarray, bits: int) -> np.ndarray:
    """Planes (vectors x bits) of integers (vectors x ``SIZE``)."""
    planes = [np.packbits((numbers >> b & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)]
    return np.stack([p.view("<u8")[:, 0] for p in planes], axis=1) if len(numbers) else np.zeros((0, bits), "<u8")


def ones(planes: np.ndarray) -> np.ndarray:
    """Bits (vectors x planes x ``SIZE``)."""
    return np.unpackbits(np.ascontiguousarray(planes, "<u8").view(np.uint8).reshape(*planes.shape, 8), axis=2, bitorder="little")


def unpack(planes: np.ndarray) -> np.ndarray:
    return np.einsum("nbi,b->ni", ones(planes), weights(planes.shape[1]))


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of all vectors in ``x`` with all in ``y``."""
    bits, out = x.shape[1], np.zeros((len(x), len(y)), dtype=np.int64)
    weight = weights(bits)
    for i in range(bits):
        for j in range(bits):
            out += weight[i] * weight[j] * np.bitwise_count(x[:, i, None] & y[None, :, j]).astype(np.int64)
    return out


def lengths(x: np.ndarray) -> np.ndarray:
    """Squared lengths."""
    bits, out = x.shape[1], np.zeros(len(x), dtype=np.int64)
    weight = weights(bits)
    for i in range(bits):
        for j in range(i + 1):
            out += (1 if i == j else 2) * weight[i] * weight[j] * np.bitwise_count(x[:, i] & x[:, j]).astype(np.int64)
    return out


def nearest(x: np.ndarray, squares: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid, the smaller one on ties, and its squared distance."""
    away = squares[:, None] - 2 * dots(x, centroids) + lengths(centroids)[None, :]
    which = away.argmin(axis=1)
    return which, away[np.arange(len(x)), which]


def _planes(batch: pa.RecordBatch, name: str, bits: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy().view(np.uint64).reshape(-1, bits)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    edges = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(edges, pa.array(np.ascontiguousarray(matrix).view(np.int64).ravel()))


def usable(vector: str = "embedding") -> Column:
    """Whether a vector has ``SIZE`` components, and all of them are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == SIZE) & finite, F.lit(False))


def packed(vectors: DataFrame, keep: tuple[str, ...], vector: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, int]:
    """(*keep, planes, square) of the vectors that are ``usable``, stored, and their bits.

    A component x is the integer floor(scale * x); one of ``LIMIT`` or more in size is an error, since distances would not
    fit into a long.
    """
    rows = vectors.filter(usable(vector)).select(*keep, F.col(vector).alias("vector"))
    low, high = rows.agg(F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
    ends = [int(np.floor(scale * np.float64(x))) for x in (low, high) if x is not None]
    if any(not -LIMIT < x < LIMIT for x in ends):
        raise ValueError(f"components reach {ends}; scale vectors so that they stay below {LIMIT}")
    bits = 1 + max([(x if x >= 0 else ~x).bit_length() for x in ends], default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, SIZE)
            planes = pack(np.floor(scale * values).astype(np.int64), bits)
            columns = [*[batch.column(i) for i in range(len(keep))], _lists(planes), pa.array(lengths(planes))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "planes", "square"])

    fields = ", ".join(f"`{c}` {dict(vectors.dtypes)[c]}" for c in keep)
    return stored(rows.mapInArrow(run, f"{fields}, planes array<bigint>, square bigint")), bits


def _sums(rows: DataFrame, centroids: np.ndarray, bits: int) -> DataFrame:
    """(cluster, n, sums): how many vectors are nearest to each centroid, and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(centroids), dtype=np.int64)
        totals = np.zeros((len(centroids), SIZE), dtype=np.int64)
        for batch in batches:
            planes, squares = _planes(batch, "planes", bits), batch.column("square").to_numpy()
            for at in range(0, len(planes), ROWS):
                part = planes[at : at + ROWS]
                which, _ = nearest(part, squares[at : at + ROWS], centroids)
                held = ones(part)
                for cluster in np.unique(which).tolist():
                    mine = which == cluster
                    counts[cluster] += int(mine.sum())
                    totals[cluster] += weights(bits) @ held[mine].sum(axis=0, dtype=np.int64)
        used = np.flatnonzero(counts)
        columns = [pa.array(used, pa.int32()), pa.array(counts[used]), _lists(totals[used])]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "sums"])

    made = rows.select("planes", "square").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    sums = F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(SIZE)])
    return made.groupBy("cluster").agg(F.sum("n").alias("n"), sums.alias("sums"))


def _assigned(rows: DataFrame, keep: tuple[str, ...], centroids: np.ndarray, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes, squares = _planes(batch, "planes", bits), batch.column("square").to_numpy()
            for at in range(0, len(planes), ROWS):
                which, away = nearest(planes[at : at + ROWS], squares[at : at + ROWS], centroids)
                columns = [*[batch.column(c).slice(at, len(which)) for c in keep], pa.array(which, pa.int32()), pa.array(away)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "cluster", "distance"])

    fields = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in keep)
    return rows.mapInArrow(run, f"{fields}, cluster int, distance bigint")


def first_centroids(rows: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """Planes of the vectors whose ids have the smallest hashes, in their order; equal ids by their planes."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    least = rows.select(F.sha2(named, 256).alias("hash"), "planes").orderBy("hash", "planes").limit(k)
    return [r.planes for r in least.collect()]


class Clusters:
    """Vectors (vec_id, embedding) in ``k`` clusters, after ``rounds`` of means rounded down.

    Vectors of another size, or with null, NaN or infinite components, are left out. Repeated rows are
    vectors of their own, a null id is hashed as an empty one, other columns are ignored. With fewer than ``k`` vectors
    there are as many clusters as vectors, and of an empty table none. ``centroids`` are
    lists of integers; a centroid that no vector is nearest to stays as it is.
    """

    def __init__(self, vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED):
        self.rows, self.bits = packed(vectors, ("vec_id",), scale=scale)
        first = np.array(first_centroids(self.rows, k, seed), dtype=np.int64).reshape(-1, self.bits)
        self.centroids = unpack(first.view(np.uint64)).tolist()
        for _ in range(rounds if self.centroids else 0):
            # A row for each centroid. A mean lies between the least and the greatest component, so the bits are enough.
            means = {r.cluster: [s // r.n for s in r.sums] for r in _sums(self.rows, self._packed(), self.bits).collect()}
            self.centroids = [means.get(c, old) for c, old in enumerate(self.centroids)]

    def _packed(self) -> np.ndarray:
        return pack(np.array(self.centroids, dtype=np.int64).reshape(-1, SIZE), self.bits)

    def assigned(self) -> DataFrame:
        """(vec_id, cluster, distance): the nearest centroid of every vector and its squared distance."""
        if not self.centroids:
            return self.rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        return _assigned(self.rows, ("vec_id",), self._packed(), self.bits)

    def report(self) -> DataFrame:
        """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector."""
        found = stored(self.assigned())
        # A row for each centroid again.
        sums = {r.cluster: r.n for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
        digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]
        facts = [(c, sums.get(c, 0), sum(sums.values()), digest) for c, digest in enumerate(digests)]
        kind = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        facts = found.sparkSession.createDataFrame(facts, kind)
        return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", *facts.columns[1:])


def _oracle() -> str:
    steps = []
    for n in range(ROUNDS + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT row, vec_id, v, min((list_inner_product(v, v) - 2 * list_inner_product(v, w) + list_inner_product(w, w))::BIGINT
    * {CENTROIDS} + c) AS best FROM e CROSS JOIN c{n} GROUP BY ALL)""")
        if n < ROUNDS:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT c{n}.c, coalesce(m.w, c{n}.w) AS w FROM c{n} LEFT JOIN (
    SELECT c, list(x ORDER BY i) AS w FROM (
      SELECT c, i, floor(sum(x) / count(*)) AS x FROM (
        SELECT best % {CENTROIDS} AS c, unnest(v) AS x, unnest(range(0, {SIZE})) AS i FROM a{n}) GROUP BY c, i)
    GROUP BY c) m ON m.c = c{n}.c)""")
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c, v AS w FROM e
  ORDER BY c LIMIT {CENTROIDS}),
{", ".join(steps)}
SELECT vec_id, c::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(w, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM (SELECT vec_id, best % {CENTROIDS} AS c, best // {CENTROIDS} AS distance FROM a{ROUNDS}) JOIN c{ROUNDS} USING (c)
"""


@query(_oracle())
def op13_bitplane_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """The cluster of every vector, and how far its vectors lie from its centroid."""
    return Clusters(spread(table(spark, folder, "embeddings"))).report()
