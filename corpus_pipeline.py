"""The corpus pipeline: quality rules, near duplicates, secrets, source mixing, token ids.

Every stage takes (spark, docs, sf_dir), works on all documents it gets, and returns a DataFrame that is
written and read again before the next one. All but the last return the columns of ``documents``
(doc_id, text, lang, source, n_chars). Further columns of the input go along untouched, whatever they are called: stages
carry them in one struct. Null and empty texts fail the first stage; the others keep them as they are. Rows that repeat
pass the first stage alike and leave one row behind the second. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import bpe, mixing, near, quality, secrets
from strata.llm.common import all_columns, discard, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps; the ledger's verdict is computed on every row, in place."""
    rows = docs.select(F.struct(*all_columns(docs)).alias("row"), docs["text"])
    return quality.apply_policy(quality.ledger(rows)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest doc_id. Rows that repeat it go too."""
    return near.class_heads(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its secrets' values masked, and n_chars to match."""
    rest = [c for c, name in zip(all_columns(docs), docs.columns, strict=True) if name != "text"]
    scanned = secrets.scan_secrets(docs.select(F.struct(*rest).alias("row"), "text"), mask=secrets.MASK)
    made = {"text": F.col("text"), "n_chars": F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return scanned.select(*(made[c].alias(c) if c in made else F.col("row").getField(c).alias(c) for c in docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's epochs and the sample take it."""
    taken = mixing.mix(docs).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the decoded text of every document of the mix, as doc_id, n_tokens, ids_sha256, decoded_sha256 and ids."""
    coded = bpe.encode_documents(docs)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: The join by MinHash, the masks and the tokenizer are not SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            after = written(after, f"pipeline-{name}")
            if i:
                discard(docs)
        docs = after
    return docs


QUERIES = {"pipeline": run}
