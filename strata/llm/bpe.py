"""BPE encoding and decoding through a table of distinct words.

1. Spark splits every text into the tokenizer's words. An Arrow function sums them up per batch, and
   the distinct ones are counted with partial sums.
2. Each distinct word is encoded once, into a written table.
3. Ids are joined back by position. Words above a count threshold, chosen so that those that pass it
   hold at most ``COMMON_BYTES``, are looked up in a broadcast table, whose size is thus bounded: a
   text becomes a compressed list of places in that table. A word beyond it has a place in
   its text's own list of rare words instead; these (text, place, word) rows, one for each distinct word
   of a text, go through a shuffle join by word, and meet the text's list again by the text's identity.
   The texts themselves are never shuffled.
4. The ids put together for a document are decoded: each is joined by position with the id-to-piece table,
   which has one entry for each of the vocabulary and goes along with the function.

The split is a Java pattern with the same classes as the tokenizer's; texts with characters that
the JVM's Unicode tables do not know, or with a special token's text, are split by the tokenizer
itself. Null and empty texts have no ids and decode to the empty text; an empty table gives no rows. Rows that repeat (same
key and text) have one identity: their rare words are looked up once and they come out as often as they went in.
Very long texts are split and put together whole; only their words' counts are cut into batches. Only the key and
the text are read of the input's columns, whatever the others are called. There are no ties.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import discard, schema_with, small_batches, table, written
from strata.llm.token_counts import tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
COMMON_BYTES = 24 << 20
COMMON_CHARS = 256
SLICE_WORDS = 1 << 20
ENCODE_WORDS = 2000

_WHITE = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The tokenizer's own pattern with its alternatives in an order that meets letters first; those moved begin with different characters.
WORDS = rf" ?\p{{L}}+|'(?:[stmd]|re|ve|ll)| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer, once per worker and without threads of its own: tasks run side by side already."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path if "/" in path else tokenizer_path(path))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_of_char() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, reversed."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def split_text(tokenizer, text: str) -> list[str]:
    """A text's words by the tokenizer's own splitter; special tokens are words of their own."""
    out: list[str] = []
    for i, part in enumerate(text.split(SPECIAL)):
        out += [SPECIAL] * (i > 0) + [part[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(part)]
    return out


def odd(text: Column) -> Column:
    """Whether the tokenizer itself has to split this text."""
    return text.contains(SPECIAL) | text.rlike(r"\p{Cn}")


def split(rows: DataFrame) -> DataFrame:
    """Replace column ``text`` by ``words``, split by the pattern, or by ``odd_text`` where the tokenizer has to split it."""
    x = rows.withColumn("odd", odd(F.col("text")))
    words = F.when(~F.col("odd"), F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))
    return x.select(*rows.drop("text").columns, words.alias("words"), F.when(F.col("odd"), F.col("text")).alias("odd_text"))


def word_lists(batches: Iterator[pa.RecordBatch], tokenizer: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches of :func:`split` with all words filled in, of about ``most`` words (one row at least)."""
    for whole in batches:
        asked = whole.column("odd_text").is_valid()
        rest = whole.drop_columns(["odd_text"])
        plain, strange = rest.filter(pc.invert(asked)), rest.filter(asked)
        if strange.num_rows:
            own = load(tokenizer)
            words = pa.array([split_text(own, x) for x in whole.column("odd_text").filter(asked).to_pylist()], pa.list_(pa.string()))
            strange = strange.set_column(strange.schema.get_field_index("words"), "words", words)
        for part in (plain, strange):
            sizes = pc.fill_null(pc.list_value_length(part.column("words")), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(sizes, most):
                yield part.slice(a, b - a)


@lru_cache(maxsize=2)
def pieces(tokenizer: str) -> pa.Array:
    """The id-to-piece table: the bytes of each entry of the vocabulary, at the place of its id."""
    own, back = load(tokenizer), byte_of_char()
    raw = lambda p: bytes(back[c] for c in p) if all(c in back for c in p) else p.encode()
    table = {i: raw(p) for p, i in own.get_vocab(with_added_tokens=True).items()}
    return pa.array([table.get(i) for i in range(max(table) + 1)], pa.binary())


def joined_pieces(ids: pa.Array, vocabulary: pa.Array) -> pa.Array:
    """Lists of ids joined with their pieces, each list's put together by position."""
    import numpy as np

    n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), vocabulary.take(ids.flatten())), b"")


def as_text(raw: pa.Array) -> pa.Array:
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no text: as the library writes them
        return pa.array([x.decode(errors="replace") for x in raw.to_pylist()], pa.string())


def decode_documents(df: DataFrame, ids: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """Add ``decoded`` to every row, from an array of ids; null has no ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(tokenizer)
        for batch in batches:
            text = as_text(joined_pieces(batch.column(ids), vocabulary))
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "decoded"])

    rows = df.drop("decoded")
    return rows.mapInArrow(decode, schema_with(rows, decoded=T.StringType()))


def encode_words(words: DataFrame, tokenizer: str) -> DataFrame:
    """Add ``ids`` to a table of distinct words."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(tokenizer)
        for batch in (whole.slice(i, ENCODE_WORDS) for whole in batches for i in range(0, whole.num_rows, ENCODE_WORDS)):
            ids = pa.array([e.ids for e in own.encode_batch_fast(batch.column("word").to_pylist(), add_special_tokens=False)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    return words.mapInArrow(encode, schema_with(words, ids=T.ArrayType(T.IntegerType())))


def word_table(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Distinct words of the split texts with their count and ids; written to the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in word_lists(batches, tokenizer, SLICE_WORDS):
            sums = pc.value_counts(batch.column("words").flatten())
            yield pa.RecordBatch.from_arrays([sums.field("values"), sums.field("counts")], names=["word", "n"])

    counts = rows.select("words", "odd_text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return written(encode_words(counts, tokenizer), "bpe-words")


def common_words(words: DataFrame, most: int = COMMON_BYTES) -> Column:
    """The condition for the broadcast table: the words that pass hold at most ``most`` bytes, whatever the table's size."""
    short = F.length("word") <= COMMON_CHARS
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    size = F.sum(F.octet_length("word") + 4 * F.size("ids") + 8)  # with the offsets of both
    held = {r.level: r.bytes for r in words.where(short).groupBy(level.alias("level")).agg(size.alias("bytes")).collect()}  # 63 rows at most
    total, least = 0, 62
    for k in sorted(held, reverse=True):
        if (total := total + held[k]) > most:
            break
        least = k
    return short & (F.col("n") >= (1 << least))


def one_array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def placed(rows: DataFrame, common, tokenizer: str, slice_words: int, rare: bool) -> DataFrame:
    """Replace the split words by ``places`` (compressed) or, with ``rare``, by ``rare``: the text's distinct words that are not common.

    A place below the number of common words is that word's; from there on places count the rare words.
    """

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        codec = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=True)
        known = common.value.column("word")
        for batch in word_lists(batches, tokenizer, slice_words):
            words = batch.column("words")
            sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            flat = words.flatten()
            at = pc.index_in(flat, value_set=known)
            missed = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
            at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.uint32)
            coded = pc.dictionary_encode(flat.take(pa.array(missed)))
            pair = np.searchsorted(ends, missed, side="right") << 32 | coded.indices.to_numpy(zero_copy_only=False)
            own, begin, back = np.unique(pair, return_index=True, return_inverse=True)
            order = np.argsort(begin)  # by text, then as they first occur in it: a text's places do not depend on its batch
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            own, back = own[order], rank[back]
            text = own >> 32
            first = np.searchsorted(text, np.arange(len(sizes) + 1))
            at[missed] = (len(known) + np.arange(len(own)) - first[text])[back]
            kept = [n for n in batch.schema.names if n != "words"]
            if rare:
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), coded.dictionary.take(pa.array(own & 0xFFFFFFFF)))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), lists], names=[*kept, "rare"])
                continue
            packed = [codec.compress(at[b - n : b].view(np.uint8).reshape(-1, 4).T.tobytes()) if n else b"" for b, n in zip(ends, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(packed, pa.binary())], names=[*kept, "places"])

    kept = rows.drop("words", "odd_text")
    made = {"rare": T.ArrayType(T.StringType())} if rare else {"places": T.BinaryType()}
    return rows.mapInArrow(look_up, schema_with(kept, **made))


def encode_documents(df: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text", slice_words: int = SLICE_WORDS) -> DataFrame:
    """One row per row of ``df``: the key, n_tokens, ``ids`` (decimal, joined by commas) and ``decoded``."""
    spark = df.sparkSession
    small_batches(spark)
    body = F.coalesce(df[text], F.lit(""))
    # a row's identity: two hashes of 64 bits, not null, the same for rows that repeat
    rows = df.select(df[key].alias("key"), body.alias("text")).withColumns({"a": F.xxhash64("key", "text"), "b": F.xxhash64("text", F.lit("b"), "key")})
    words = word_table(split(rows.select("text")), tokenizer)
    is_common = common_words(words)
    held = words.where(is_common).orderBy(F.desc("n"), "word").select("word", "ids").toArrow()  # bounded: see common_words
    common = spark.sparkContext.broadcast(pa.RecordBatch.from_arrays([one_array(c) for c in held.columns], names=held.column_names))
    vocabulary = pieces(tokenizer)  # an entry for each id of the vocabulary

    texts = split(rows)
    lists = placed(texts.drop("key"), common, tokenizer, slice_words, rare=True).select("a", "b", F.posexplode("rare").alias("place", "word"))
    lists = lists.repartition("word").distinct()  # by word already, so that rows that repeat become one here
    found = lists.join(words.where(~is_common).select("word", "ids").hint("merge"), "word").select("a", "b", "place", "ids")
    found = found.repartition("a", "b").groupBy("a", "b").agg(F.collect_list(F.struct("place", "ids")).alias("found"))  # a text's distinct words at most
    found = written(found, "bpe-found")
    discard(words)
    met = placed(texts, common, tokenizer, slice_words, rare=False).join(found.hint("merge"), ["a", "b"], "left").select("key", "places", "found")

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        codec = zstandard.ZstdDecompressor()
        ids = common.value.column("ids")
        for whole in batches:
            packed = [codec.decompress(x) if x else b"" for x in whole.column("places").to_pylist()]
            n_words = np.array([len(x) // 4 for x in packed], np.int64)
            for a, b in slices(n_words, slice_words):
                ends = np.concatenate([[0], np.cumsum(n_words[a:b])])
                at = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view(np.uint32)[:, 0] for x in packed[a:b] if x)]).astype(np.int64)
                rest = whole.column("found").slice(a, b - a)
                spots, many = rest.flatten(), pc.fill_null(pc.list_value_length(rest), 0).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(b - a), many)
                order = np.lexsort((spots.field("place").to_numpy(zero_copy_only=False), owner))
                rare = at >= len(ids)
                begin = np.cumsum(many) - many
                at[rare] += begin[np.repeat(np.arange(b - a), n_words[a:b])[rare]]
                every = pa.concat_arrays([ids, spots.field("ids").take(pa.array(order)).cast(ids.type)])
                taken = every.take(pa.array(at))
                tokens = np.concatenate([[0], np.cumsum(taken.value_lengths().to_numpy(zero_copy_only=False))])[ends]
                own = pa.LargeListArray.from_arrays(pa.array(tokens, pa.int64()), taken.flatten())
                decimal = pa.LargeListArray.from_arrays(pa.array(tokens, pa.int64()), own.values.cast(pa.string()))
                columns = [
                    whole.column("key").slice(a, b - a),
                    pa.array(np.diff(tokens), pa.int64()),
                    pc.binary_join(decimal, ","),
                    as_text(joined_pieces(own, vocabulary)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids", "decoded"])

    return met.mapInArrow(put_together, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, ids string, decoded string")


def slices(sizes, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about ``most`` at most (one row at least)."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def digests(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents")))
