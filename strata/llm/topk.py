"""Exact top-k search by inner product with a pivot-distance index.

Components are turned into integers floor(64 * x), and every vector gets one more component that
brings its norm to the largest of the table. With queries at 0 there, the squared distance is
|q|^2 + M^2 - 2 * (inner product), so that the highest products are the nearest vectors.

1. Pivots: centres of a bounded sample (``SAMPLE`` vectors, taken in the order of a hash of the id).
2. Every vector is keyed by its nearest pivot and its distance from it. Range-partitioned and sorted
   by that key, vectors are cut into blocks, each an annulus: pivot, least and greatest distance.
   Every vector is indexed; the sample decides only how much is searched.
3. A block's queries are scored against their own block first, where it lies.
4. For every block of queries all other annuli are sorted by the least distance that the triangle inequality
   leaves between them, and are searched in waves of growing width, nearest first. After each wave a query's k-th score
   bounds how far its hits can lie; a block of queries stops at the first annulus beyond that, and within
   a pair of blocks a query beyond its own bound is left out. Annuli are never searched twice. Only ids and
   bounds decide what meets; vectors move to the pairs that are searched.

The result is exact: scores are integers, by floating-point matrices where every sum is exact in them,
else in 64 bits, else in Python's integers. A score of the result that
does not fit a long is null, and ranks among its like by vec_id; what is not in the result may be of any size.

Vectors that are null or hold a null or a value that is not finite take no part. Shorter vectors count
as filled up with zeros. Equal scores go to the smaller vec_id, null ids last; rows that repeat an id are candidates of their
own, and a query leaves out its own row only. A row without id is no query. An empty table gives no rows. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import discard, small_batches, table, written

SCALE, K = 64, 20
SAMPLE, PIVOTS, ROUNDS = 2048, 32, 4
BLOCK, WAVE = 4096, 4
RESULT = "query_id long, rank int, vec_id long, score long"


def sound(vector: Column) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad


def integers(vector: Column) -> Column:
    """floor(64 * x) of each component, as doubles, which hold these integers exactly."""
    return F.transform(vector, lambda v: F.rint(F.when(F.abs(v.cast("double")) < 1 << 47, F.floor(v.cast("double") * SCALE).cast("double")).otherwise(v.cast("double") * SCALE)))


def find_pivots(points, n: int, rounds: int = ROUNDS):
    """Centres of a sample: points far from one another first, then a few rounds of means."""
    import numpy as np

    if not len(points):
        return np.zeros((0, points.shape[1]))
    chosen, far = [0], np.full(len(points), np.inf)
    while len(chosen) < min(n, len(points)):
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        if not far.max() > 0:
            break
        chosen.append(int(far.argmax()))
    centres = points[chosen].copy()
    for _ in range(rounds):
        near = distances(points, centres).argmin(axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = points[near == c].mean(axis=0)
    return centres


def distances(a, b):
    import numpy as np

    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


def products(q, x):
    """Exact inner products of integers held as doubles or in 32 bits: in doubles, 64-bit integers or Python's."""
    import numpy as np

    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if most < 1 << 53:
        return np.rint(q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return q.astype(np.int64) @ x.T.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(q).dot(whole(x).T)


#: What stands for scores at or beyond the ends of a long while the search goes on; a result has null for them.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def longs(scores) -> pa.Array:
    """Provisional scores; those that do not fit are held as the long nearest to them, which is not in a result that fits."""
    return pa.array([min(max(int(s), LEAST), MOST) for s in scores] if scores.dtype == object else scores, pa.int64())


class Space:
    """What all parts of a search share: how vectors are packed, the largest squared norm, and the pivots."""

    def __init__(self, dim: int, top: float, most: float, centres):
        self.dim, self.top, self.centres = dim, top, centres
        self.kind = "<i4" if most < 1 << 31 else "<f8"

    def packed(self, rows) -> bytes:
        return rows.astype(self.kind).tobytes()

    def unpacked(self, raw: bytes):
        import numpy as np

        return np.frombuffer(raw, self.kind).reshape(-1, self.dim)

    def points(self, vectors, query: bool):
        """Vectors with the component that brings them to the largest norm, or queries with 0 there."""
        import numpy as np

        v = vectors.astype(float)
        return np.column_stack([v, np.zeros(len(v)) if query else np.sqrt(np.maximum(self.top - (v**2).sum(axis=1), 0))])

    def best_rows(self, scores, ids, rids, k: int, bound=None):
        """Positions of the k best of one query's candidates that reach its bound."""
        import numpy as np

        good = np.arange(len(scores)) if bound is None else np.flatnonzero(scores >= bound)
        if len(good) > k:
            s = scores[good]
            good = good[np.lexsort((rids[good], ids[good], -s))] if s.dtype != object else good[sorted(range(len(good)), key=lambda i: (-s[i], ids[good[i]], rids[good[i]]))]
        return good[:k]


def keyed(rows: DataFrame, space: Space) -> DataFrame:
    """vec_id, rid, is_query, v (array of double) -> vec_id, rid, is_query, vec (packed), pivot, dist."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            x = np.zeros((batch.num_rows, space.dim))
            sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            x[np.arange(space.dim)[None, :] < sizes[:, None]] = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            d = np.nan_to_num(distances(space.points(x, False), space.centres), nan=np.inf)
            near = d.argmin(axis=1)
            kept = [batch.column(c) for c in ("vec_id", "rid", "is_query")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([space.packed(r) for r in x], pa.binary()), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])],
                names=["vec_id", "rid", "is_query", "vec", "pivot", "dist"],
            )

    return rows.mapInArrow(key, "vec_id long, rid long, is_query boolean, vec binary, pivot int, dist double")


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Cut keyed rows, range-partitioned and sorted by pivot and distance, into annuli of at most ``size`` vectors.

    asks: the places of a block's queries in it.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list[pa.RecordBatch] = []

        def flush(upto: pa.Table) -> pa.RecordBatch:
            d, rids = upto["dist"].to_numpy(), upto["rid"].to_pylist()
            asks = np.flatnonzero(upto["is_query"].to_numpy(zero_copy_only=False)).tolist()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([rids[0]], pa.int64()), pa.array([upto["pivot"][0].as_py()], pa.int32()),
                    pa.array([float(d.min())]), pa.array([float(d.max())]), pa.array([upto["vec_id"].to_pylist()], pa.list_(pa.int64())),
                    pa.array([rids], pa.list_(pa.int64())), pa.array([asks], pa.list_(pa.int32())), pa.array([b"".join(upto["vec"].to_pylist())], pa.binary()),
                ],
                names=["block", "pivot", "low", "high", "ids", "rids", "asks", "vecs"],
            )

        for batch in batches:
            pivot = batch.column("pivot").to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(pivot[1:] != pivot[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:], strict=False):
                while a < b:
                    have = sum(h.num_rows for h in held)
                    if held and (held[0].column("pivot")[0].as_py() != pivot[a] or have >= size):
                        yield flush(pa.Table.from_batches(held))
                        held, have = [], 0
                    take = min(b - a, size - have)
                    held.append(batch.slice(a, take))
                    a += take
        if held:
            yield flush(pa.Table.from_batches(held))

    order = ["pivot", "dist", "rid"]
    x = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(x.mapInArrow(cut, "block long, pivot int, low double, high double, ids array<long>, rids array<long>, asks array<int>, vecs binary"), "topk-index")


HITS = "query_id long, query_rid long, vec_id long, rid long, score long"
NO_ID = (1 << 63) - 1


def hits_of(found: list) -> Iterator[pa.RecordBatch]:
    """A batch of hits from parts: query id, query row, ids, rows and scores."""
    import numpy as np

    if found:
        ids = np.concatenate([f[2] for f in found])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([f[0] for f in found], [len(f[2]) for f in found]), pa.int64()), pa.array(np.repeat([f[1] for f in found], [len(f[2]) for f in found]), pa.int64()),
                pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(np.concatenate([f[3] for f in found]), pa.int64()), longs(np.concatenate([f[4] for f in found])),
            ],
            names=["query_id", "query_rid", "vec_id", "rid", "score"],
        )


def id_array(ids: list):
    import numpy as np

    return np.array([NO_ID if i is None else i for i in ids], np.int64)


def search_own(index: DataFrame, space: Space, k: int) -> DataFrame:
    """Per query the k best of its own block."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for row in range(batch.num_rows):
                asks = batch.column("asks")[row].as_py()
                x, rids, ids = space.unpacked(batch.column("vecs")[row].as_py()), np.array(batch.column("rids")[row].as_py()), id_array(batch.column("ids")[row].as_py())
                s, found = products(x[asks], x), []
                for i, a in enumerate(asks):
                    rest = np.delete(np.arange(len(x)), a)
                    good = rest[space.best_rows(s[i][rest], ids[rest], rids[rest], k)]
                    found.append((ids[a], rids[a], ids[good], rids[good], s[i][good]))
                yield from hits_of([f for f in found if len(f[2])])

    return index.where(F.size("asks") > 0).select("ids", "rids", "asks", "vecs").mapInArrow(score, HITS)


def query_blocks(index: DataFrame, space: Space) -> DataFrame:
    """Each block's queries: q_block, q_ids, q_rids, q_vecs, norms (squared), and for every pivot the least and greatest distance of one."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for row in range(batch.num_rows):
                asks = batch.column("asks")[row].as_py()
                q = space.unpacked(batch.column("vecs")[row].as_py())[asks]
                d = distances(space.points(q, True), space.centres)
                pick = lambda c, asks=asks, row=row: [v[a] for v in [batch.column(c)[row].as_py()] for a in asks]
                columns = [pa.array([v], pa.list_(t)) for v, t in ((pick("ids"), pa.int64()), (pick("rids"), pa.int64()), ((q.astype(float) ** 2).sum(axis=1).tolist(), pa.float64()), (d.min(axis=0).tolist(), pa.float64()), (d.max(axis=0).tolist(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("block").slice(row, 1), *columns[:2], pa.array([space.packed(q)], pa.binary()), *columns[2:]],
                    names=["q_block", "q_ids", "q_rids", "q_vecs", "norms", "near", "far"],
                )

    kind = "q_block long, q_ids array<long>, q_rids array<long>, q_vecs binary, norms array<double>, near array<double>, far array<double>"
    return index.where(F.size("asks") > 0).select("block", "ids", "rids", "asks", "vecs").mapInArrow(ask, kind)


def search(pairs: DataFrame, space: Space, k: int, wide: float) -> DataFrame:
    """Per query the k best of each annulus that it can have hits in."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for row in range(batch.num_rows):
                at = lambda c, row=row: batch.column(c)[row].as_py()
                q, bounds = space.unpacked(at("q_vecs")), at("q_bounds")
                d = distances(space.points(q, True), space.centres[[at("pivot")]])[:, 0]
                reach = radius(np, (q.astype(float) ** 2).sum(axis=1), space.top, np.array([-np.inf if b is None else b for b in bounds], float), wide)
                asked = np.flatnonzero(~(np.maximum(d - at("high"), at("low") - d) > reach))
                if not len(asked):
                    continue
                x, rids, ids = space.unpacked(at("vecs")), np.array(at("rids")), id_array(at("ids"))
                s, q_ids, q_rids = products(q[asked], x), at("q_ids"), at("q_rids")
                found = []
                for i, a in enumerate(asked):
                    good = space.best_rows(s[i], ids, rids, k, bounds[a])
                    found.append((q_ids[a], q_rids[a], ids[good], rids[good], s[i][good]))
                yield from hits_of([f for f in found if len(f[2])])

    return pairs.mapInArrow(score, HITS)


def radius(m, norm, top: float, bound, wide: float):
    """How far a query's hits can lie: the distance of its bound, and what floating-point distances of such norms may be off."""
    return m.sqrt(m.maximum(norm + top - 2 * bound, 0)) * (1 + 1e-9) + wide


def best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    df: DataFrame, queries: Column, k: int = K, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK, wave: int = WAVE, told: dict | None = None
) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest integer inner products of every row for which ``queries`` holds.

    ``told``: gets the pairs of blocks there are and those that were searched.
    """
    import numpy as np

    spark = df.sparkSession
    small_batches(spark)
    x = df.select(df[key].cast("long").alias("vec_id"), df[vector].alias("e"), queries.alias("is_query"))
    is_query = F.coalesce("is_query", F.lit(False)) & F.col("vec_id").isNotNull()
    x = x.where(sound(F.col("e"))).select("vec_id", is_query.alias("is_query"), integers(F.col("e")).alias("v"))
    x = written(x.withColumn("rid", F.monotonically_increasing_id()), "topk-rows")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, v: a + v * v)
    facts = x.agg(F.max(F.size("v")).alias("dim"), F.max(norm2).alias("norm2"), F.max(F.aggregate("v", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)))).alias("most")).first()
    if facts.dim is None:
        return spark.createDataFrame([], RESULT)
    top = facts.norm2
    sample = x.orderBy(F.xxhash64("vec_id"), "rid").limit(SAMPLE).select("v").collect()  # bounded by SAMPLE
    points = np.zeros((len(sample), facts.dim))
    for i, row in enumerate(sample):
        points[i, : len(row.v)] = row.v
    space = Space(facts.dim, top, facts.most, None)
    space.centres = find_pivots(space.points(points, False), pivots)
    wide = 1e-5 * float(np.sqrt(2 * top)) + 1e-6
    index = blocks(keyed(x, space), block)
    discard(x)

    now = written(best(search_own(index, space, k), k), "topk-best")
    asks = written(query_blocks(index, space), "topk-asks")
    each = written(asks.select("q_block", F.posexplode(F.arrays_zip("q_rids", "norms")).alias("place", "z")).select("q_block", "place", F.col("z.q_rids").alias("query_rid"), F.col("z.norms").alias("norm")), "topk-queries")
    spans = asks.select("q_block", F.posexplode(F.arrays_zip("near", "far")).alias("pivot", "z")).select("q_block", "pivot", "z.near", "z.far")
    annuli = index.select(F.col("block").alias("x_block"), "pivot", "low", "high")
    least = F.greatest(F.lit(0.0), F.col("near") - F.col("high"), F.col("low") - F.col("far"))
    order = spans.join(annuli, "pivot").where("x_block <> q_block").select("q_block", "x_block", least.alias("least"))
    order = written(order.withColumn("place", F.row_number().over(Window.partitionBy("q_block").orderBy("least", "x_block"))), "topk-order")
    if told is not None:
        told |= {"pairs": order.count(), "searched": 0}
    x_rows = index.select(F.col("block").alias("x_block"), "pivot", "low", "high", "ids", "rids", "vecs")
    begin = 1
    while True:
        bounds = each.join(now.where(F.col("rank") == k).select("query_rid", F.when(F.col("score") > LEAST, F.col("score")).alias("bound")), "query_rid", "left")
        reach = F.sqrt(F.greatest(F.col("norm") + F.lit(top) - 2 * F.col("bound").cast("double"), F.lit(0.0))) * (1 + 1e-9) + F.lit(wide)
        reach = F.when(F.col("bound").isNotNull(), F.nanvl(reach, F.lit(float("inf")))).otherwise(float("inf"))
        known = bounds.groupBy("q_block").agg(F.max(reach).alias("reach"), F.array_sort(F.collect_list(F.struct("place", "bound"))).alias("b"))  # a block's queries at most
        known = written(known.select("q_block", "reach", F.transform("b", lambda z: z.bound).alias("q_bounds")), "topk-bounds")
        left = order.where(F.col("place") >= begin).join(known.select("q_block", "reach"), "q_block").where("least <= reach").select("q_block", "x_block", "place")
        pairs = written(left.where(F.col("place") < begin + wave), "topk-pairs")
        n = pairs.count()
        if not n:  # annuli are in order: none is near enough here, nor further on
            break
        if told is not None:
            told["searched"] += n
        asked = pairs.join(asks.select("q_block", "q_ids", "q_rids", "q_vecs"), "q_block").join(known.select("q_block", "q_bounds"), "q_block")
        hits = search(asked.join(x_rows, "x_block").select("q_ids", "q_rids", "q_vecs", "q_bounds", "pivot", "low", "high", "ids", "rids", "vecs"), space, k, wide)
        after = written(best(now.drop("rank").unionByName(hits), k), "topk-best")
        discard(now)
        now = after
        discard(known, pairs)
        begin, wave = begin + wave, wave * 4
    discard(index, asks, each, order)
    fits = (F.col("score") > LEAST) & (F.col("score") < MOST)
    return now.select("query_id", "rank", "vec_id", F.when(fits, F.col("score")).alias("score"))


def op3_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, F.col("vec_id") % 20 == 0)


OP3_SQL = """
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, q.rid AS q, x.vec_id, x.rid, list_inner_product(q.v::DOUBLE[], x.v::DOUBLE[])::BIGINT AS score FROM e q JOIN e x ON q.rid <> x.rid WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM p
WINDOW w AS (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST, rid) QUALIFY row_number() OVER w <= 20
"""
