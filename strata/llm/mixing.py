"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target in words. A source is taken in complete epochs first; the rest of its
target is a weighted sample without replacement: every document draws the exponential key
``-ln(u) / quality``, u from a hash of its id, and documents are taken by ascending key until the
prefix sum of their sizes reaches the rest.

Only keys and sizes are written and summed. The keys fall into ``BUCKETS`` ordered buckets by the distribution
function that an even mixture of the quality levels has, so that no bucket holds more than about 3 / BUCKETS of a
source; sizes are summed by source and bucket, and only the bucket in which a source's rest ends is
sorted. That gives one cut for each source: the key and id up to which it is taken. The texts are then
filtered by their source's cut where they lie; no text is shuffled. The cuts, one row for each source, are broadcast up to
``BROADCAST_SOURCES`` sources and joined by sort and merge beyond. Targets are computed from one row per
source in one task. Reruns agree, as keys depend on rows alone.

Null and empty texts have size 0 (very long ones count whole); a null source is a source of its own, after all others; a null id is replaced by a hash of
the text, so that null ids draw different keys. Rows that repeat (same id, or null ids and the same text) draw the same key and are taken alike. Empty tables
give an empty mix. All columns of the input come back in the struct ``row``, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import all_columns, discard, table, word_count, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BUCKETS = 4096
BROADCAST_SOURCES = 10_000
LEVELS = (0.25, 0.5, 1.0)
SEED = "mix"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Targets of sources, from one row (source, source_size) each.

    Sources in code-point order, null last, get the weights in turn. Targets share ``share`` times
    all words by weight, up to ``most`` times a source's size each; what exceeds that is shared
    again by weight. That is the level L with sum(least(most * size, L * weight)) equal to the
    total, found by prefix sums over the sources in the order in which they reach their limits.
    """
    place = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    x = sizes.select("source", "source_size", w.alias("w"))
    x = x.withColumn("cap", (most * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    total = F.lit(float(share)) * F.sum("source_size").over(every)
    x = x.withColumn("level", (total - F.coalesce(F.sum("cap").over(past), F.lit(0.0))) / F.sum("w").over(ahead))
    # the first source in this order whose limit is not below the level ends the filling
    x = x.withColumn("level", F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("level")))).over(every)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return x.select("source", "source_size", F.col("w").alias("weight"), target.alias("target"))


def text_quality(text: Column) -> Column:
    """A document's quality weight in (0, 1]: 0.25, 0.5 or 1 by the share of symbols among its bytes."""
    body = F.coalesce(text, F.lit(""))
    n = F.regexp_count(body, F.lit("[#*$%&|<>]"))
    return F.when(n * 50 > F.length(body), 0.25).when(n * 200 > F.length(body), 0.5).otherwise(1.0)


def drawn_name(doc_id: Column, text: Column) -> Column:
    """What a document's key is drawn from: its id, or a hash of its text where it has none."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))


def sampling_key(name: Column, quality: Column) -> Column:
    """-ln(u) / quality, with u in (0, 1) from 52 bits of a hash of the name."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), name)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / quality


def source_cuts(keys: DataFrame, weights: tuple[int, ...], share: float, most: int, levels: tuple[float, ...]) -> DataFrame:
    """Per source: its size, target and complete epochs, and the last key and name that the rest takes (null: none); keys: source, size, key, name."""
    spread = F.aggregate(F.array(*map(F.lit, levels)), F.lit(0.0), lambda a, q: a + F.exp(-q * F.col("key"))) / len(levels)
    x = keys.withColumn("bucket", F.least(F.floor((1 - spread) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    summed = sums = written(x.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max(F.struct("key", "name")).alias("top")), "mix-sums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    targets = written(targets, "mix-targets")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).alias("s")
    t = targets.alias("t")
    plan = sums.join(t, F.col("s.source").eqNullSafe(F.col("t.source")) & (F.col("t.rest") > 0) & (F.col("s.before") < F.col("t.rest"))).select("s.*", "t.rest")
    # whole buckets within the rest, and the one in which it ends
    ends = F.col("before") + F.col("words") > F.col("rest")
    whole = plan.where(~ends).select("source", F.col("top").alias("cut"))
    last, k = F.broadcast(plan.where(ends).select("source", "bucket", "before", "rest")).alias("p"), x.alias("k")  # a row a source
    if targets.count() > BROADCAST_SOURCES:
        last = plan.where(ends).select("source", "bucket", "before", "rest").alias("p")
    inner = k.join(last, F.col("k.source").eqNullSafe(F.col("p.source")) & (F.col("k.bucket") == F.col("p.bucket"))).select("k.source", "size", "key", "name", "before", "rest")
    inner = inner.groupBy("source", "key", "name").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy("key", "name").rowsBetween(Window.unboundedPreceding, 0)
    run = F.col("before") + F.sum("size").over(order) - F.col("size") / 2
    inner = inner.withColumn("run", run).where(F.col("run") <= F.col("rest")).select("source", F.struct("key", "name").alias("cut"))
    cuts = whole.unionByName(inner).groupBy("source").agg(F.max("cut").alias("cut")).alias("c")
    both = t.join(cuts, F.col("t.source").eqNullSafe(F.col("c.source")), "left")
    out = written(both.select("t.source", "source_size", "target", "epochs", F.col("cut.key").alias("cut_key"), F.col("cut.name").alias("cut_name")), "mix-cuts")
    discard(summed, targets)
    return out


def mix(
    df: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, quality=text_quality, levels: tuple[float, ...] = LEVELS
) -> DataFrame:
    """One row per document: row (all of its columns), size, source_size, target (its source's) and ``copies``, how often the mix takes it.

    ``levels``: values that ``quality`` gives; they only decide how evenly the keys are dealt to buckets.
    """
    text = df["text"]
    x = df.select(F.struct(*all_columns(df)).alias("row"), df["source"].alias("source"), word_count(text).alias("size"), quality(text).alias("quality"), drawn_name(df["doc_id"], text).alias("name"))
    x = x.withColumn("key", sampling_key(F.col("name"), F.col("quality"))).drop("quality")
    keys = written(x.select("source", "size", "key", "name"), "mix-keys")
    cuts = source_cuts(keys, weights, share, most, levels)
    discard(keys)
    few = cuts.count() <= BROADCAST_SOURCES
    c, x = (F.broadcast(cuts) if few else cuts.hint("merge")).alias("c"), x.alias("x")
    x = x.join(c, F.col("x.source").eqNullSafe(F.col("c.source")), "left")
    taken = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("name") <= F.col("cut_name")))
    return x.select("row", "size", "source_size", "target", (F.col("epochs") + F.coalesce(taken, F.lit(False)).cast("int")).alias("copies"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(table(spark, sf_dir, "documents"))
    return rows.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n, length(coalesce(text, '')) AS l,
    coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) AS name, ('0x' || substr(md5('mix:' || name), 1, 13))::BIGINT AS bits FROM documents),
e AS (SELECT *, -ln((bits + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / (CASE WHEN n * 50 > l THEN 0.25::DOUBLE WHEN n * 200 > l THEN 0.5::DOUBLE ELSE 1::DOUBLE END) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS DOUBLE) AS w, (2 * source_size)::DOUBLE AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, (SELECT arg_min(level, cap / w) FROM l WHERE cap >= level * w) * w) AS target FROM l),
r AS (SELECT e.doc_id, e.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::INT ELSE 0 END AS epochs,
    sum(e.size) OVER (PARTITION BY e.source ORDER BY e.key, e.name RANGE UNBOUNDED PRECEDING) - sum(e.size) OVER (PARTITION BY e.source, e.key, e.name) / 2::DOUBLE AS run
  FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (epochs + (run <= target - epochs * source_size)::INT))::BIGINT AS taken FROM r
"""
