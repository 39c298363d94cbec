"""Repeated passages by a sparse suffix array.

Of every text's word suffixes only those at minimiser positions are kept: positions whose 8-word
hash is the least of some window of ``WINDOW`` positions. Any two copies of a passage of
``PASSAGE`` = 50 words keep the same position among their first 26, so that both hold the ``CORE`` = 25
words from there on.

1. Suffixes whose core occurs once go (counted by core hash, with partial sums). Those left meet their texts
   again and get the 25 words right of the core and the 25 left of it, each as 32 bits of its hash.
2. They are range-partitioned and sorted as a suffix array: by core, right words, left words.
   A key that a third of all texts share is spread over many partitions.
3. Neighbours, also across partitions, are compared and extended right and left. Every match of 50 words
   or more, with the one before and with the one after, marks the words it covers. The same is done in the order of the left words.
4. The two orders also give the most words that a suffix shares with any other on either side. Where
   these would make 50 words and the matches found do not reach that far on both sides, a suffix further
   off may share the rest: for such cores all windows of 50 words around the core are counted, so that
   no repeat is lost. Suffixes are cut to the words shared first; those equal then are counted as one.

Documents are told apart by 128 bits, cores by 64 bits, the words beside them by 32 bits each.

A document is a row's doc_id and text: rows that repeat both are one document, not copies, and rows with a null id are told
apart by their texts; the same id with another text is another document. Null, empty and short texts have no passage; very long ones are cut and compared whole.
Ties need no rule, as every occurrence is marked. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import byte_slices, discard, small_batches, table, word_count, written

PASSAGE, CORE, GRAM, WINDOW = 50, 25, 8, 26
SIDE, WORD = PASSAGE - CORE, 4
BATCH_BYTES = 2 << 20

#: Writes a table under a name and reads it back.
Write = Callable[[DataFrame, str], DataFrame]


def sliding(x, n: int, f):
    """f (minimum or maximum) over each n consecutive values, by doubling."""
    out, width = x, 1
    while width * 2 <= n:
        out = f(out[:-width], out[width:])
        width *= 2
    return out if width == n else f(out[: len(out) - (n - width)], out[n - width :])


def minimisers(words, counts):
    """Positions in the array of all words that are the least of some window, and have a core in their text."""
    import numpy as np

    from strata.llm import textvec as v

    starts = v.windows(counts, GRAM)
    if len(starts) < WINDOW:
        return starts[:0]
    grams = np.full(len(words), np.iinfo(np.uint64).max, np.uint64)
    grams[starts] = v.gram_hashes(words, starts, GRAM)
    low = sliding(grams, WINDOW, np.minimum)
    edge = np.zeros(WINDOW - 1, np.uint64)
    high = sliding(np.concatenate([edge, low, edge]), WINDOW, np.maximum)
    chosen = np.zeros(len(words), bool)
    chosen[starts] = (high == grams)[starts]
    chosen[np.setdiff1d(np.arange(len(words)), v.windows(counts, CORE), assume_unique=True)] = False
    return np.flatnonzero(chosen)


def documents(df: DataFrame) -> DataFrame:
    """doc (the identity of a document, 128 bits over its id and text), doc_id and text."""
    text, own = F.coalesce(df["text"], F.lit("")), df["doc_id"].cast("long")
    told = F.concat(F.coalesce(own.cast("string"), F.lit("")), F.lit(":"), text)
    return df.select(F.unhex(F.md5(told)).alias("doc"), own.alias("doc_id"), text.alias("text"))


def kept_suffixes(docs: DataFrame, places: bool) -> DataFrame:
    """core (and, with ``places``, doc and pos) of every kept suffix."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from strata.llm import textvec as v

        for whole in batches:
            for batch in byte_slices(whole, "text", BATCH_BYTES):
                words, counts = v.word_hashes(batch.column("text"))
                at = minimisers(words, counts)
                core = pa.array(v.gram_hashes(words, at, CORE).view(np.int64))
                if not places:
                    yield pa.RecordBatch.from_arrays([core], names=["core"])
                    continue
                ends = np.cumsum(counts)
                doc = np.searchsorted(ends, at, side="right")
                yield pa.RecordBatch.from_arrays([core, batch.column("doc").take(pa.array(doc)), pa.array((at - (ends - counts)[doc]).astype(np.int32))], names=["core", "doc", "pos"])

    return docs.select(*["doc"] * places, "text").mapInArrow(cut, "core long" + ", doc binary, pos int" * places)


ROWS = "core long, doc binary, doc_id long, pos int, right_words binary, left_words binary"


def with_sides(texts: DataFrame) -> DataFrame:
    """Each asked suffix with the words beside its core; texts: doc, doc_id, text, asked (array of pos and core)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from strata.llm import textvec as v

        for whole in batches:
            for batch in byte_slices(whole, "text", BATCH_BYTES):
                words, counts = v.word_hashes(batch.column("text"))
                asked = batch.column("asked")
                spots, many = asked.flatten(), asked.value_lengths().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(batch.num_rows), many)
                ends = np.cumsum(counts)
                at = spots.field("pos").to_numpy(zero_copy_only=False) + (ends - counts)[doc]
                short = np.concatenate([(words % np.uint64((1 << 32) - 1) + np.uint64(1)).astype(">u4"), np.zeros(1, ">u4")])
                span = np.arange(SIDE)
                right, left = at[:, None] + CORE + span, at[:, None] - 1 - span
                right = short[np.where(right < ends[doc][:, None], right, len(words))]
                left = short[np.where(left >= (ends - counts)[doc][:, None], left, len(words))]
                fixed = lambda m: pa.FixedSizeBinaryArray.from_buffers(pa.binary(SIDE * WORD), len(m), [None, pa.py_buffer(np.ascontiguousarray(m))]).cast(pa.binary())
                own = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [spots.field("core"), batch.column("doc").take(own), batch.column("doc_id").take(own), spots.field("pos"), fixed(right), fixed(left)],
                    names=["core", "doc", "doc_id", "pos", "right_words", "left_words"],
                )

    return texts.mapInArrow(cut, ROWS)


def repeated_suffixes(df: DataFrame, keep: Write) -> DataFrame:
    """All kept suffixes whose core occurs more than once, with the words beside it; written."""
    docs = documents(df)
    cores = kept_suffixes(docs, places=False).groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    cores = written(cores, "suffix-cores")
    places = written(kept_suffixes(docs, places=True).join(cores, "core").select("doc", "core", "pos"), "suffix-places")
    asked = places.groupBy("doc").agg(F.collect_set(F.struct("pos", "core")).alias("asked"))  # a text's own positions
    # by sort and merge at every size; the exchange of the join also serves the removal of rows that repeat
    rows = keep(with_sides(docs.join(asked.hint("merge"), "doc").dropDuplicates(["doc"])), "suffix-rows")
    discard(cores, places)
    return rows


def agreed(a, b):
    """How many leading words two rows of words share; 0 stands for no word and never agrees."""
    import numpy as np

    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), a.shape[1], np.argmin(same, axis=1))


NEAR = ["core", "doc", "doc_id", "pos", "reach", "begin", "end", "other", "edge", "right_words", "left_words"]
NEAR_TYPE = "core long, doc binary, doc_id long, pos int, reach int, begin int, end int, other long, edge boolean, right_words binary, left_words binary"


def neighbours(first: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row of a sorted partition with the one before and after it.

    Per row: reach, the most words of side ``first`` shared with a neighbour, and its match with either neighbour:
    two rows if both are of 50 words or more, one with null if neither is; ``other`` is the doc_id of the match's document, null where it is the row's own. A row at the end of a batch is carried over to the next and comes out twice.
    The first and last row of the partition also come out with ``edge``, to be compared across partitions.
    """
    held = head = None
    for batch in batches:
        if batch.num_rows:
            head = batch.slice(0, 1) if head is None else head
            yield compared(first, pa.Table.from_batches([batch] if held is None else [held, batch]))
            held = batch.slice(batch.num_rows - 1)
    for row in (head, held) if held is not None else ():
        none = pa.nulls(1, pa.int32())
        kept = [row.column(c) for c in ("core", "doc", "doc_id", "pos")]
        yield pa.RecordBatch.from_arrays([*kept, none, none, none, pa.nulls(1, pa.int64()), pa.array([True]), row.column("right_words"), row.column("left_words")], names=NEAR)


def compared(first: str, t: pa.Table) -> pa.RecordBatch:
    import numpy as np

    t = t.combine_chunks()
    whole = lambda c: pa.concat_arrays(t[c].chunks)
    core, pos = t["core"].to_numpy(), t["pos"].to_numpy()
    doc = np.frombuffer(b"".join(t["doc"].to_pylist()), np.uint64).reshape(-1, 2)
    side = lambda c: np.frombuffer(b"".join(t[c].to_pylist()), ">u4").reshape(-1, SIDE)
    right, left = side("right_words"), side("left_words")
    pair = np.flatnonzero((core[1:] == core[:-1]) & ~((doc[1:] == doc[:-1]).all(axis=1) & (pos[1:] == pos[:-1])))
    r, lft = agreed(right[pair], right[pair + 1]), agreed(left[pair], left[pair + 1])
    n = len(core)
    reach, both = np.zeros(n, np.int64), np.zeros((3, 2, n), np.int64)  # the words shared right and left, and with which row: with the row after, with the one before
    for k, (me, it) in enumerate(((pair, pair + 1), (pair + 1, pair))):  # either holds a row at most once
        reach[me] = np.maximum(reach[me], r if first == "right" else lft)
        both[:, k, me] = r, lft, it
    good = both[0] + both[1] + CORE >= PASSAGE
    # one row for each match, and one for a row without any
    after, before = np.flatnonzero(good[0] | ~good[1]), np.flatnonzero(good[1])
    who = np.concatenate([after, before])
    r, lft, other = np.concatenate([both[:, 0, after], both[:, 1, before]], axis=1)
    none = ~np.concatenate([good[0, after], good[1, before]])
    at = pa.array(who)
    partner = whole("doc_id").take(pa.array(other, mask=none | (doc[who] == doc[other]).all(axis=1)))
    return pa.RecordBatch.from_arrays(
        [
            *(whole(c).take(at) for c in ("core", "doc", "doc_id", "pos")), pa.array(reach[who].astype(np.int32)),
            pa.array((pos[who] - lft).astype(np.int32), mask=none), pa.array((pos[who] + CORE + r).astype(np.int32), mask=none),
            partner, pa.nulls(len(who), pa.bool_()), pa.nulls(len(who), pa.binary()), pa.nulls(len(who), pa.binary()),
        ],
        names=NEAR,
    )


def in_order(rows: DataFrame, first: str, keep: Write) -> DataFrame:
    """The suffix array by core, then the words of one side, then those of the other, and its neighbours compared."""
    sides = ["right_words", "left_words"] if first == "right" else ["left_words", "right_words"]
    order = ["core", *sides, "doc", "pos"]
    x = rows.select(*order, "doc_id").repartitionByRange(*order).sortWithinPartitions(*order)
    near = keep(x.mapInArrow(lambda batches: neighbours(first, batches), NEAR_TYPE), "suffix-near")
    edges = near.where("edge").select(*order, "doc_id").distinct()  # two rows a partition

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := list(batches):
            yield compared(first, pa.Table.from_batches(got))

    # only rows of one core have anything to compare across partitions
    across = keep(edges.repartition("core").sortWithinPartitions(*order).mapInArrow(compare, NEAR_TYPE), "suffix-edges")
    return near.where("edge IS NULL").unionByName(across)


def whole_windows(rows: DataFrame, keep: Write) -> DataFrame:
    """Matches by counting all windows of 50 words around each core.

    Rows: core, doc, doc_id, pos, right_words and left_words, cut to what each shares at most, SIDE in sum at least.
    """
    rows = keep(rows.withColumn("kind", F.xxhash64("core", "right_words", "left_words")), "suffix-open-rows")
    place = F.struct("doc", "pos", "doc_id")
    kinds = rows.groupBy("kind", "core", "right_words", "left_words").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    j = F.explode(F.sequence((SIDE - F.length("right_words") / WORD).cast("int"), (F.length("left_words") / WORD).cast("int"))).alias("j")
    x = kinds.select("*", j)
    a, b = F.expr(f"substring(left_words, 1, j * {WORD})"), F.expr(f"substring(right_words, 1, ({SIDE} - j) * {WORD})")
    x = keep(x.select("kind", "j", "low", "high", F.xxhash64("core", "j", a, b).alias("window")), "suffix-windows")
    counts = x.groupBy("window").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    twice = counts.where("low <> high").select("window", F.struct("low", "high").alias("ends"))
    # every window holds the core, so that those of a kind are one range of words
    found = x.select("kind", "j", "window").join(twice, "window").groupBy("kind").agg(
        F.min("j").alias("least"), F.max("j").alias("most"), F.collect_set("ends").alias("ends")  # 26 at most
    )
    begin, end = F.col("pos") - F.col("most"), F.col("pos") - F.col("least") + PASSAGE
    others = F.flatten(F.transform("ends", lambda e: F.array(e.low, e.high)))
    partner = F.array_min(F.transform(F.filter(others, lambda o: o.doc != F.col("doc")), lambda o: o.doc_id))
    found = rows.join(keep(found, "suffix-kinds"), "kind")
    return found.select("doc", "doc_id", begin.cast("int").alias("begin"), end.cast("int").alias("end"), partner.alias("other"))


def repeated_passages(df: DataFrame, keep: Write) -> DataFrame:
    """Matches (doc, doc_id, begin, end, other): word ranges of 50 words or more that also stand elsewhere, and the id of another document where.

    ``keep`` writes the tables that the result reads.
    """
    rows = repeated_suffixes(df, keep)
    right, left = in_order(rows, "right", keep), in_order(rows, "left", keep)
    found = lambda x: x.where("begin IS NOT NULL").select("doc", "doc_id", "begin", "end", "other")
    # the most words shared on either side, and how far the matches found reach
    told = lambda x, r, lft: x.select("core", "doc", "pos", r.alias("r"), lft.alias("l"), "begin", "end")
    none = F.lit(0)
    every = told(right, F.col("reach"), none).unionByName(told(left, none, F.col("reach")))
    every = every.groupBy("core", "doc", "pos").agg(F.max("r").alias("r"), F.max("l").alias("l"), F.min("begin").alias("begin"), F.max("end").alias("end"))
    every = keep(every.where(F.col("r") + F.col("l") >= SIDE), "suffix-told")
    short = F.col("begin").isNull() | (F.col("begin") > F.col("pos") - F.col("l")) | (F.col("end") < F.col("pos") + CORE + F.col("r"))
    open_cores = keep(every.where(short).select("core").distinct(), "suffix-open")
    rest = rows.join(every.join(open_cores, "core", "left_semi").select("core", "doc", "pos", "r", "l"), ["core", "doc", "pos"])
    cut = lambda c, n: F.expr(f"substring({c}, 1, {n} * {WORD})").alias(c)
    rest = rest.select("core", "doc", "doc_id", "pos", cut("right_words", "r"), cut("left_words", "l"))
    return found(right).unionByName(found(left)).unionByName(whole_windows(rest, keep))


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for matches in batch.column("matches").to_pylist():
            spans: list[list[int]] = []
            for m in matches:
                if spans and m["begin"] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], m["end"])
                else:
                    spans.append([m["begin"], m["end"]])
            out.append(spans)
        kept = [batch.column(c) for c in ("doc", "doc_id")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.list_(pa.list_(pa.int32()))), batch.column("partner")], names=["doc", "doc_id", "spans", "partner"])


def repeated_spans(df: DataFrame) -> DataFrame:
    """One row per document with a repeated passage: doc, doc_id, spans (array of begin and end words, disjoint), partner (the smallest doc_id met)."""
    small_batches(df.sparkSession)
    made: list[DataFrame] = []

    def keep(x: DataFrame, name: str) -> DataFrame:
        made.append(written(x, name))
        return made[-1]

    own = repeated_passages(df, keep).groupBy("doc", "begin").agg(F.max("end").alias("end"), F.min("other").alias("partner"), F.first("doc_id").alias("doc_id"))
    own = own.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("matches"), F.min("partner").alias("partner"), F.first("doc_id").alias("doc_id"))
    spans = written(own.mapInArrow(merge, "doc binary, doc_id long, spans array<array<int>>, partner long"), "suffix-spans")
    discard(*made)
    return spans


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, repeated passages of 50 words or more, the words they cover, and a document that shares one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeated_spans(docs).select("doc", "spans", "partner")
    d = documents(docs)
    x = d.select("doc", "doc_id", word_count(F.col("text")).alias("n_words")).join(found, "doc", "left")
    covered = F.aggregate("spans", F.lit(0), lambda a, s: a + F.get(s, F.lit(1)) - F.get(s, F.lit(0)))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.get(s, F.lit(0)).cast("string"), F.get(s, F.lit(1)).cast("string"))), ",")
    return x.select(
        "doc_id", "n_words",
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_passages"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("repeated_words"),
        F.coalesce(text, F.lit("")).alias("spans"),
        "partner",
    )
