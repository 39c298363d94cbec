"""Plain Lloyd over integer vectors: the same clusters on every run, however rows are dealt to tasks.

Centroids are a small table (``k`` rows of ``dims`` integers) that goes to every task. ``mapInPandas`` takes the squared
differences to each centroid in integers and the smallest of them, ties to the smaller number; every task hands on one
row of sums for each centroid, and a groupBy merges these. Nothing else reaches the driver: at most k * dims integers a
round. The vectors are read once a round and never written.

Vectors that are null, have another number of components, or hold a null or a non-finite one take no part, and an empty table gives no
rows. Fewer vectors than ``k`` make fewer centroids. Repeated rows count as often as they come. A null id takes part; as
a first centroid it comes after all others. Vectors whose ids hash alike are first by their components. A centroid without vectors stays where it is. Components are exact
at any size; a distance or a sum of distances that exceeds a long is null. Only the two named columns are read, so other
columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import table

K, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
#: Components within this bound keep every sum of 64 squared differences within a long.
SMALL = 1 << 27
#: Sums are handed on in digits of so many bits, each with the sum's sign, so that millions of them add up in a long.
DIGIT = 40
LONG = 1 << 63


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has exactly ``dims`` components, all finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (F.size(vector) == dims) & finite


def whole(rows: pd.Series | list, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of every component, as 64-bit integers where all are small, else as Python's own."""
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if np.abs(y).max(initial=0) <= SMALL:
        return y.astype(np.int64)
    exact = lambda v: int(v) * scale if abs(v) >= 1 << 53 else math.floor(v * scale)
    return np.array([[exact(float(v)) for v in r] for r in x], object)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid (the first of equal ones) and its squared distance."""
    if x.dtype == object or centroids.dtype == object:
        x, centroids = x.astype(object), centroids.astype(object)
    d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = np.argmin(d, axis=1)
    return at, d[np.arange(len(x)), at]


def as_array(centroids: list[list[int]]) -> np.ndarray:
    big = any(abs(v) > SMALL for c in centroids for v in c)
    return np.array(centroids, object if big else np.int64)


def digits(v: int) -> list[int]:
    """The digits of an integer, lowest first, each with its sign."""
    sign, v, out = (-1 if v < 0 else 1), abs(v), []
    while v:
        out.append(sign * (v & ((1 << DIGIT) - 1)))
        v >>= DIGIT
    return out


def merged_sums(vectors: DataFrame, centroids: list[list[int]], take, width: int, scale: int) -> dict[int, list[int]]:
    """For each centroid the sums, over its vectors, of the ``width`` integers that ``take(x, at, distance)`` gives.

    A task adds up its own rows and emits one row for each centroid and digit; these are summed by a groupBy, and
    k * digits rows of the result come to the driver.
    """
    held = as_array(centroids)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list[int]] = {}
        for batch in batches:
            if not len(batch):
                continue
            x = whole(batch["vector"], scale)
            at, distance = nearest(x, held)
            rows = take(x, distance)
            for c in np.unique(at):
                own = rows[at == c].sum(axis=0)
                sums[int(c)] = [a + int(b) for a, b in zip(sums.get(int(c), [0] * width), own, strict=True)]
        out = []
        for c, s in sums.items():
            split = [digits(v) for v in s]
            out += [(c, place, [d[place] if place < len(d) else 0 for d in split]) for place in range(max(1, *map(len, split)))]
        if out:
            yield pd.DataFrame(out, columns=["cluster", "place", "s"])

    x = vectors.select("vector").mapInPandas(partial, "cluster int, place int, s array<long>")
    x = x.groupBy("cluster", "place").agg(*(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)))
    total: dict[int, list[int]] = {}
    for r in x.collect():
        own = total.setdefault(r["cluster"], [0] * width)
        for i in range(width):
            own[i] += r[f"s{i}"] << (DIGIT * r["place"])
    return total


def first_centroids(vectors: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The vectors whose ids hash lowest."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.orderBy(F.asc_nulls_last(key), "vector").limit(k).select("vector").collect()
    return [[int(v) for v in row] for row in whole([r["vector"] for r in first], scale)] if first else []


def refined(vectors: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> list[list[int]]:
    """One round: every centroid becomes the floor of its vectors' mean."""
    with_count = lambda x, _: np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    sums = merged_sums(vectors, centroids, with_count, dims + 1, scale)
    return [[v // sums[c][-1] for v in sums[c][:-1]] if c in sums else old for c, old in enumerate(centroids)]


def lloyd(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance, cluster_inertia, inertia) of every usable vector, and the final centroids."""
    vectors = df.select(df[id_col].alias("id"), df[vector_col].alias("vector")).where(usable(F.col("vector"), dims))
    centroids = first_centroids(vectors, k, seed, scale)
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, cluster int, distance long, cluster_inertia long, inertia long"
    if not centroids:
        return df.sparkSession.createDataFrame([], schema), []
    for _ in range(rounds):
        centroids = refined(vectors, centroids, dims, scale)
    sums = merged_sums(vectors, centroids, lambda _, distance: distance[:, None], 1, scale)
    fits = lambda v: int(v) if v < LONG else None
    inertia = {c: fits(s[0]) for c, s in sums.items()}
    whole_inertia = fits(sum(s[0] for s in sums.values()))
    held = as_array(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            at, distance = nearest(whole(batch["vector"], scale), held)
            near = pd.array([fits(v) for v in distance] if distance.dtype == object else distance, "Int64")
            own = pd.array([inertia[int(c)] for c in at], "Int64")
            yield pd.DataFrame({id_col: batch["id"].array, "cluster": at.astype(np.int32), "distance": near, "cluster_inertia": own, "inertia": pd.array([whole_inertia] * len(at), "Int64")})

    return vectors.mapInPandas(assign, schema), centroids


def centroid_hash(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every embedding, with inertia and the digest of its centroid."""
    rows, centroids = lloyd(table(spark, sf_dir, "embeddings"))
    digest = F.array(*(F.lit(centroid_hash(c)) for c in centroids)) if centroids else F.array().cast("array<string>")
    return rows.withColumn("centroid_sha256", F.get(digest, F.col("cluster")))


def _round_sql(r: int) -> str:
    """Assignment to the centroids ``c{r}`` and, from it, ``c{r+1}``."""
    return f"""d{r} AS MATERIALIZED (SELECT v.rid, c.no, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM parts v JOIN c{r} c USING (pos) GROUP BY v.rid, c.no),
a{r} AS MATERIALIZED (SELECT rid, arg_min(no, {{'d': d, 'no': no}}) AS no, min(d) AS d FROM d{r} GROUP BY rid),
m{r} AS (SELECT a.no, p.pos, sum(p.x)::BIGINT AS s, count(*) AS n FROM parts p JOIN a{r} a USING (rid) GROUP BY a.no, p.pos),
c{r + 1} AS MATERIALIZED (SELECT c.no, c.pos, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{r} c LEFT JOIN m{r} m USING (no, pos))"""


OP11_SQL = f"""WITH kept AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
parts AS MATERIALIZED (SELECT rid, pos, floor({SCALE} * embedding[pos]::DOUBLE)::BIGINT AS x FROM kept, range(1, {DIMS + 1}) p(pos)),
seeds AS (SELECT rid, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, embedding) - 1 AS no FROM kept QUALIFY no < {K}),
c0 AS MATERIALIZED (SELECT no, pos, x FROM parts JOIN seeds USING (rid)),
{", ".join(_round_sql(r) for r in range(ROUNDS + 1))},
digest AS (SELECT no, sha256(string_agg(x::VARCHAR, ',' ORDER BY pos)) AS h FROM c{ROUNDS} GROUP BY no)
SELECT vec_id, no::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY no)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, h AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (rid) JOIN digest USING (no)"""
