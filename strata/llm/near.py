"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Texts with the same word sequence form a class and are compared once, through a representative.
2. Each class has a path of ``DEPTH`` MinHash values in each of ``TREES`` trees. A tree's paths are sorted, which
   makes it a prefix trie: neighbours share the longest prefixes. Only prefixes that two classes or more share matter,
   down to the depth at which a pair at the threshold meets in some tree with the target recall (5 of 8).
3. The longest prefixes come first: neighbours in the sorted order whose signatures agree enough
   (several standard deviations below the threshold) are joined, in time linear in the trie.
4. Prefixes are shortened only where that leaves something to find: at the depth of the target recall, a prefix whose
   classes are in one group already is done, however many they are. In any other the classes beyond its largest
   group are compared to each other and to that group, in blocks, so that every pair is met or known to be in one group.
5. Within a group every pair is verified on the full shingle sets, exactly, in blocks. Only counts
   per class and a spanning forest leave a block, so that a group of n similar texts makes no n * n rows.
6. Verified links make the near-duplicate classes.

Prefixes and groups of any size are cut into blocks of bounded rows and bytes. Null and empty texts have
no shingle, no link and a class of their own; a text of one to four words is its own single shingle; very long texts
are shingled whole; ties go to the smaller doc_id (null last); rows that repeat are copies of one class; extra columns are ignored,
whatever their names; an empty table gives no rows.
Texts are told apart by 128 bits over their words, shingles by 64-bit hashes. Classes have numbers of their own, so that no two share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import all_columns, byte_slices, discard, schema_with, table, written
from strata.llm.graph import block_pairs, components, forest, runs

WORDS = 5
NUMERATOR, DENOMINATOR = 4, 5
TREES, DEPTH, RECALL = 20, 8, 0.9995
BATCH_BYTES = 2 << 20
BUCKET_BLOCK, LARGEST_BLOCK, GROUP_BLOCK, GROUP_BYTES = 256, 4096, 100, 2 << 20
DEVIATIONS = 4.0


def prefix_depth(trees: int = TREES, depth: int = DEPTH, threshold: float = NUMERATOR / DENOMINATOR, recall: float = RECALL) -> int:
    """Shorten the matched prefix until a pair at the threshold is found with the target recall."""
    d = depth
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


def least_agreement(n: int, threshold: float = NUMERATOR / DENOMINATOR) -> int:
    """Equal positions of two signatures of n below which a pair at the threshold lies too far out."""
    import math

    return math.floor(n * threshold - DEVIATIONS * math.sqrt(n * threshold * (1 - threshold)))


def signatures(df: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """doc_id, wid (id of the word sequence), n_shingles, sig (a byte for each place of each path), keys (for each tree the hash of the shortest prefix)."""
    used = prefix_depth(trees, depth)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from strata.llm import textvec as v

        rng = np.random.default_rng(20240302)
        mult = rng.integers(1, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(1, 1 << 63, trees * depth, dtype=np.uint64)
        salt = rng.integers(1, 1 << 63, (trees, used + 1), dtype=np.uint64) | np.uint64(1)
        for whole in batches:
            for batch in byte_slices(whole, "text", BATCH_BYTES):
                words, counts = v.word_hashes(batch.column("text"))
                grams, many = v.shingles(words, counts, WORDS)
                some = np.flatnonzero(many)
                starts = (np.cumsum(many) - many)[some]
                least = np.empty((trees * depth, len(some)), np.uint64)
                for k in range(trees * depth if len(some) else 0):
                    least[k] = np.minimum.reduceat(grams * mult[k] + add[k], starts)
                sig = (v.mixed(least) & np.uint64(255)).astype(np.uint8)
                tries = least.reshape(trees, depth, len(some))[:, :used]
                keys = v.mixed((tries * salt[:, :used, None]).sum(axis=1, dtype=np.uint64) + salt[:, used:]).view(np.int64)
                all_sig, all_keys = np.zeros((len(many), trees * depth), np.uint8), np.zeros((len(many), trees), np.int64)
                all_sig[some], all_keys[some] = sig.T, keys.T
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()),
                        v.text_ids(batch.column("text")),
                        pa.array(many.astype(np.int32)),
                        pa.array([s.tobytes() for s in all_sig], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(many) + 1, dtype=np.int32) * trees), pa.array(all_keys.reshape(-1))),
                    ],
                    names=["doc_id", "wid", "n_shingles", "sig", "keys"],
                )

    return df.select("doc_id", "text").mapInArrow(sign, "doc_id long, wid binary, n_shingles int, sig binary, keys array<long>")


def signature_rows(column, positions: int):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, positions)


def neighbour_edges(members: DataFrame, positions: int = TREES * DEPTH, least: int | None = None) -> DataFrame:
    """Edges (a, b) between neighbours in the sorted tries that agree; members: key, tail (the path beyond it), cid, sig."""
    least = least_agreement(positions) if least is None else least

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch] if held is None else [held, batch])
            held = batch.slice(batch.num_rows - 1)
            key, cid, sig = t["key"].to_numpy(), t["cid"].to_numpy(), signature_rows(t["sig"], positions)
            x = np.flatnonzero(key[1:] == key[:-1])
            x = x[(sig[x] == sig[x + 1]).sum(axis=1) >= least]
            yield pa.RecordBatch.from_arrays([pa.array(cid[x]), pa.array(cid[x + 1])], names=["a", "b"])

    order = ["key", "tail", "cid"]
    return members.select(*order, "sig").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long").distinct()


def open_prefixes(members: DataFrame) -> DataFrame:
    """Prefixes that hold classes of two groups or more: key, largest (group), and the blocks of that and of the rest; members: key, group."""
    sizes = members.groupBy("key", "group").agg(F.count("*").alias("n"))
    facts = sizes.groupBy("key").agg(F.max(F.struct("n", "group")).alias("top"), F.sum("n").alias("n"))
    rest = F.col("n") - F.col("top.n")
    return facts.where(rest > 0).select(
        "key", F.col("top.group").alias("largest"), F.ceil(F.col("top.n") / LARGEST_BLOCK).cast("int").alias("n_largest"), F.ceil(rest / BUCKET_BLOCK).cast("int").alias("n_rest")
    )


def prefix_edges(members: DataFrame, positions: int = TREES * DEPTH, least: int | None = None) -> DataFrame:
    """Edges (a, b) that span what agrees across groups within each open prefix; members: as made by :func:`open_prefixes`, with cid, group and sig.

    The rest's blocks meet each other and those of the largest group, which do not meet each other.
    """
    least = least_agreement(positions) if least is None else least

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for t in runs(batches, ["key", "kind", "i", "j"]):
            cid, block, big, group = (t[c].to_numpy() for c in ("cid", "block", "big", "group"))
            sig, i, j = signature_rows(t["sig"], positions), t["i"][0].as_py(), t["j"][0].as_py()
            if t["kind"][0].as_py():
                a, b = np.flatnonzero(big == 0), np.flatnonzero(big)
            else:
                a = np.flatnonzero(block == i)
                b = a if i == j else np.flatnonzero(block != i)
            found: list[tuple[int, int]] = []
            for x in a:
                to = b[b > x] if b is a else b
                to = to[group[to] != group[x]]
                if len(to):
                    found += [(int(x), int(y)) for y in to[(sig[to] == sig[x]).sum(axis=1) >= least]]
            kept = forest(len(cid), found)
            if kept:
                k = np.array(kept)
                yield pa.RecordBatch.from_arrays([pa.array(cid[k[:, 0]]), pa.array(cid[k[:, 1]])], names=["a", "b"])

    big = F.col("group") == F.col("largest")
    x = members.withColumn("big", big.cast("int")).withColumn("block", F.pmod(F.xxhash64("cid"), F.when(big, F.col("n_largest")).otherwise(F.col("n_rest"))).cast("int"))
    meet = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    of_rest = F.concat(
        F.transform(upto("n_rest"), lambda o: meet(0, F.least("block", o), F.greatest("block", o))), F.transform(upto("n_largest"), lambda o: meet(1, o, F.col("block")))
    )
    of_largest = F.transform(upto("n_rest"), lambda o: meet(1, F.col("block"), o))
    x = x.select("key", "cid", "sig", "group", "big", "block", F.inline(F.when(F.col("big") == 1, of_largest).otherwise(of_rest)))
    place = ["key", "kind", "i", "j"]
    return x.repartition(*place).sortWithinPartitions(*place, "cid").mapInArrow(compare, "a long, b long").distinct()


def candidate_groups(classes: DataFrame, depth: int = DEPTH, least: int | None = None) -> DataFrame:
    """(node, component) of all classes that share a group with another one; classes: cid, keys, sig."""
    keys = classes.select("cid", "sig", F.posexplode("keys").alias("tree", "key"))
    beyond = prefix_depth(depth=depth)
    tail = F.expr(f"substring(sig, tree * {depth} + {beyond + 1}, {depth - beyond})")
    keys = keys.select("key", tail.alias("tail"), "cid")
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "near-prefixes")
    members = written(keys.join(shared, "key"), "near-members")
    sigs = classes.select("cid", "sig")
    first = written(neighbour_edges(members.join(sigs, "cid"), least=least), "near-neighbours")
    groups = components(first)
    g = groups.select(F.col("node").alias("cid"), F.col("component").alias("group"))
    grouped = written(members.drop("tail").join(g, "cid", "left").withColumn("group", F.coalesce("group", "cid")), "near-members")
    still = written(open_prefixes(grouped), "near-open")
    more = prefix_edges(grouped.join(still, "key").join(sigs, "cid"), least=least)
    # edges between groups, through their smallest members, join what the neighbours have joined
    edges = written(first.unionByName(more), "near-edges")
    found = components(edges)
    discard(shared, members, first, groups, grouped, still, edges)
    return found


def shingle_sets(rows: DataFrame) -> DataFrame:
    """Replace ``text`` by ``grams``, its sorted distinct shingles as packed 64-bit hashes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from strata.llm import textvec as v

        for whole in batches:
            for batch in byte_slices(whole, "text", BATCH_BYTES):
                words, counts = v.word_hashes(batch.column("text"))
                grams, many = v.shingles(words, counts, WORDS)
                ends = np.cumsum(many)
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                del columns["text"]
                columns["grams"] = pa.array([np.unique(grams[e - n : e]).tobytes() for e, n in zip(ends, many, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(pack, schema_with(rows.drop("text"), grams=T.BinaryType()))


def shared_counts(sets: list, others: list | None):
    """Numbers of shared elements: of every two of ``sets``, or of each of ``sets`` with each of ``others``."""
    import numpy as np

    every = sets + (others or [])
    values, inverse, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
    often = count[inverse] > 1
    column, owner = (np.cumsum(count > 1) - 1)[inverse[often]], owner[often]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    n = len(sets)
    out = np.zeros((n, len(others) if others is not None else n), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        lo, hi = np.searchsorted(column, [at, at + 8192])
        m = np.zeros((len(every), 8192), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += np.rint(m[:n] @ (m[n:] if others is not None else m[:n]).T).astype(np.int64)
    return out


def verified(rows: DataFrame) -> DataFrame:
    """Compare all pairs of each group. rows: component, blocks, cid, copies, grams.

    Returns (cid, links, other): links to documents of other classes found in a block, or, where
    ``links`` is null, an edge of a block's spanning forest.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for t in runs(batches, ["component", "i", "j"]):
            cid = t["cid"].to_numpy()
            new = np.concatenate([[True], cid[1:] != cid[:-1]])
            t, cid = t.filter(pa.array(new)), cid[new]  # rows with the same id and text
            side, copies = t["side"].to_numpy(), t["copies"].to_numpy()
            sets = [np.frombuffer(g, np.uint64) for g in t["grams"].to_pylist()]
            sizes = np.array([len(s) for s in sets])
            i, j = t["i"][0].as_py(), t["j"][0].as_py()
            a = np.flatnonzero(side == i)
            b = a if i == j else np.flatnonzero(side == j)
            if not len(a) or not len(b) or len(a) == len(cid) == 1:
                continue
            common = shared_counts([sets[x] for x in a], None if i == j else [sets[x] for x in b])
            linked = (NUMERATOR + DENOMINATOR) * common >= NUMERATOR * (sizes[a][:, None] + sizes[b][None, :])
            if i == j:
                np.fill_diagonal(linked, False)
            links = np.zeros(len(cid), np.int64)
            links[a] = linked @ copies[b]
            if i != j:
                links[b] = linked.T @ copies[a]
            some = np.flatnonzero(links)
            x, y = np.nonzero(linked)
            kept = forest(len(cid), list(zip(a[x].tolist(), b[y].tolist(), strict=True)))
            e = np.array(kept, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([cid[some], cid[e[:, 0]]])),
                    pa.array([*links[some].tolist(), *[None] * len(e)], pa.int64()),
                    pa.array([*[None] * len(some), *cid[e[:, 1]].tolist()], pa.int64()),
                ],
                names=["cid", "links", "other"],
            )

    return block_pairs(rows, "component", "cid", F.col("blocks")).mapInArrow(compare, "cid long, links long, other long")


def known_id(c: Column) -> list[Column]:
    """An id as two columns that are never null, so that equality joins it."""
    return [F.coalesce(c, F.lit(0)).alias("id"), c.isNull().alias("no_id")]


def keyed_rows(df: DataFrame) -> DataFrame:
    """row (all columns of ``df``), its doc_id as id and no_id, and wid, as in :func:`near_duplicates`."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strata.llm import textvec as v

        for whole in batches:
            for batch in byte_slices(whole, whole.column("row").field("text"), BATCH_BYTES):
                wid = v.text_ids(batch.column("row").field("text"))
                yield pa.RecordBatch.from_arrays([*batch.columns, wid], names=[*batch.schema.names, "wid"])

    rows = df.select(F.struct(*all_columns(df)).alias("row"), *known_id(df["doc_id"].cast("long")))
    return rows.mapInArrow(add, schema_with(rows, wid=T.BinaryType()))


def near_duplicates(df: DataFrame, least: int | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, class_id, n_links, copy_of, n_copies, wid, class_wid.

    class_id: the smallest doc_id of all that links connect to the document; n_links: other documents
    that its text is linked to, exact copies included; copy_of: the smallest doc_id with the same word
    sequence; n_copies: documents with it; wid: the id of the word sequence; class_wid: that of the class's first document.
    ``least``: in how many places the signatures of a pair must agree to be verified; 0 verifies every pair that shares a prefix.
    """
    docs = df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"])
    signed = written(signatures(docs), "near-signed")
    some = signed.where("n_shingles > 0")
    first = F.any_value(F.struct("n_shingles", "sig", "keys")).alias("s")
    classes = some.groupBy("wid").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("copies"), first)
    # numbered as they are written, which fixes the numbers
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), "wid", "copy_of", "copies", "s.*"), "near-classes")

    groups = candidate_groups(classes, least=least)

    own = classes.select(F.col("cid").alias("node"), "wid", "copy_of", "copies", "n_shingles")
    grouped = written(groups.join(own, "node").withColumnRenamed("node", "cid"), "near-groups")
    blocks = F.greatest(F.ceil(F.count("*") / GROUP_BLOCK), F.ceil(F.sum("n_shingles") * 8 / GROUP_BYTES)).alias("blocks")
    sizes = written(grouped.groupBy("component").agg(blocks), "near-sizes")
    wanted = written(grouped.join(sizes, "component").select("component", "blocks", "cid", "wid", "copies", *known_id(F.col("copy_of"))), "near-wanted")
    # by sort and merge at every size: which texts are wanted grows with the documents. Rows that repeat the wanted one go
    keys = ["id", "no_id", "wid"]
    rows = keyed_rows(docs).join(wanted.hint("merge"), keys).dropDuplicates(keys).select("component", "blocks", "cid", "copies", "row.text")
    found = written(verified(shingle_sets(rows)), "near-verified")

    links = found.where("links IS NOT NULL").groupBy("cid").agg(F.sum("links").alias("links"))
    linked = components(found.where("other IS NOT NULL").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    x = classes.select("cid", "wid", "copy_of", "copies").join(links, "cid", "left").join(linked.withColumnRenamed("node", "cid"), "cid", "left")
    x = written(x.drop("cid"), "near-links")
    first = F.min(F.struct(F.col("copy_of").isNull(), F.col("copy_of").alias("head"), F.col("wid").alias("head_wid"))).alias("h")
    heads = written(x.where("component IS NOT NULL").groupBy("component").agg(first).select("component", "h.head", "h.head_wid"), "near-heads")
    x = x.join(heads, "component", "left")
    alone = F.col("head_wid").isNull()
    verdicts = x.select(
        "wid", "copy_of", F.col("copies").alias("n_copies"), F.when(alone, F.col("copy_of")).otherwise(F.col("head")).alias("class_id"),
        F.coalesce("head_wid", "wid").alias("class_wid"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    verdicts = written(verdicts, "near-verdicts")
    discard(classes, groups, grouped, sizes, wanted, found, linked, x)
    s, v = signed.where("n_shingles > 0").select("doc_id", "wid").alias("s"), verdicts.alias("v")
    with_text = s.join(v, F.col("s.wid") == F.col("v.wid")).select("s.doc_id", "v.class_id", "v.n_links", "v.copy_of", "v.n_copies", "s.wid", "v.class_wid")
    zero, own = F.lit(0).cast("long"), F.col("doc_id")
    none = signed.where("n_shingles = 0").select("doc_id", own.alias("class_id"), zero.alias("n_links"), own.alias("copy_of"), F.lit(1).cast("long").alias("n_copies"), "wid", F.col("wid").alias("class_wid"))
    return with_text.unionByName(none)


def class_heads(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that are kept of each class of near duplicates: the one with the smallest doc_id (null last), once if rows repeat it.

    The texts are shuffled once, with all columns in one struct, so that no name can clash.
    """
    classes = near_duplicates(df)
    head = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("wid") == F.col("class_wid"))
    heads = written(classes.where(head).select(*known_id(F.col("doc_id")), "wid").distinct(), "near-kept")
    discard(classes)
    keys = ["id", "no_id", "wid"]
    # one exchange by these keys serves the join and the removal of repeats
    return keyed_rows(df).join(heads.hint("merge"), keys, "left_semi").dropDuplicates(keys).select("row.*")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("wid", "class_wid")
