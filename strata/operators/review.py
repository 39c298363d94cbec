"""Reviews of a summary by a caller's function, and the parsing of their answers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.files import opened
from strata.storage import discard, written

KEYS = ("architecture_score", "key_issues", "improvement_priorities")
REVIEW = "architecture_score int, key_issues array<string>, improvement_priorities array<string>"
EMPTY_REVIEW = '{"architecture_score": 0, "key_issues": [], "improvement_priorities": []}'
#: The answer's form, as a reviewer is told.
FORM = "one JSON object with architecture_score (integer, 0 to 100), key_issues (array of strings) and improvement_priorities (array of strings)"


def simple_prompt(summary: Column) -> Column:
    return F.concat(F.lit("Repository summary:\n\n"), summary, F.lit("\n\nProvide the analysis as JSON only."))


def full_prompt(summary: Column, instruction: str | None = None) -> Column:
    """Instruction, the answer's form, and the summary."""
    told = instruction or "Review the architecture of the repository summarised below. Cite its figures; be concrete."
    return F.concat(F.lit(f"{told} Answer with {FORM}.\n\nRepository summary:\n\n"), summary)


def ask(rows: DataFrame, prompt: str, reviewer: Callable[[str], str] | None = None) -> DataFrame:
    """Add ``answer``: what the caller's function returns for each prompt (by default an empty review)."""
    call = reviewer or (lambda _: EMPTY_REVIEW)

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(answer=[call(p) for p in pdf[prompt]])

    from pyspark.sql import types as T

    return rows.mapInPandas(answer, T.StructType([*rows.schema.fields, T.StructField("answer", T.StringType())]))


STORE = "key string, answer string"


def missing(rows: DataFrame, prompt: str, store: str) -> DataFrame:
    """(key, prompt) of the prompts that the store has no answer to, each once."""
    keyed = rows.select(F.sha2(prompt, 256).alias("key"), F.col(prompt).alias("prompt")).where("prompt IS NOT NULL").dropDuplicates(["key"])
    return keyed.join(answers(rows.sparkSession, store).select("key"), "key", "left_anti")


def answers(spark: SparkSession, store: str) -> DataFrame:
    """(key, answer): what the store holds, an answer for each key."""
    fs, path = opened(store)
    fs.create_dir(path, recursive=True)
    return spark.read.schema(STORE).parquet(store).groupBy("key").agg(F.min("answer").alias("answer"))


def ask_once(rows: DataFrame, prompt: str, reviewer: Callable[[str], str], store: str, retries: int = 3, batch: int = 20, tasks: int | None = None) -> DataFrame:
    """Add ``answer`` and ``error``: what the caller's function returns for each prompt, which is paid for once.

    Answers are kept in ``store``, a folder that all executors share, by the hash of their prompt; only prompts without an answer there are
    sent, equal ones once. A task puts its answers there in batches as they come. One that is run again, as an executor was lost,
    reads first what it had put there; so no more than one batch is asked twice. A call that fails is made again, ``retries``
    times in all; then the prompt has an error instead of an answer, which a later run asks for again. A null prompt has neither.
    """
    spark = rows.sparkSession
    job = uuid.uuid4().hex[:12]
    schema = pa.schema([("key", pa.string()), ("answer", pa.string())])

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        fs, folder = opened(store)
        name = f"{job}-{TaskContext.get().partitionId()}"
        own = [e.path for e in fs.get_file_info(pafs.FileSelector(folder)) if e.base_name.startswith(name + "-")]
        known = {k for path in own for k in pq.read_table(path, filesystem=fs).column("key").to_pylist()}
        held: list[dict] = []
        made = len(own)

        def put() -> None:
            nonlocal made
            if held:
                hidden = f"{folder}/.{name}-{made}-{uuid.uuid4().hex}"
                pq.write_table(pa.Table.from_pylist(held, schema), hidden, filesystem=fs)
                fs.move(hidden, f"{folder}/{name}-{made}.parquet")
                made += 1
                held.clear()

        try:
            for b in batches:
                failed = []
                for key, text in zip(b.column("key").to_pylist(), b.column("prompt").to_pylist(), strict=True):
                    if key in known:
                        continue
                    error = None
                    for _ in range(max(1, retries)):
                        try:
                            held.append({"key": key, "answer": reviewer(text)})
                            error = None
                            break
                        except Exception as e:  # noqa: BLE001  the caller's function may fail in any way
                            error = f"{type(e).__name__}: {e}"
                    if error is not None:
                        failed.append({"key": key, "answer": error})
                    if len(held) >= batch:
                        put()
                yield pa.RecordBatch.from_pylist(failed, schema)
        finally:  # also where the task is stopped
            put()

    todo = written(missing(rows, prompt, store), "prompts")
    errors = written(todo.repartition(tasks or spark.sparkContext.defaultParallelism).mapInArrow(call, STORE), "errors")
    discard(todo)
    found = answers(spark, store).join(errors.select("key", F.col("answer").alias("error")), "key", "full")
    x = rows.withColumn("__key", F.sha2(prompt, 256)).join(found.withColumnRenamed("key", "__key"), "__key", "left")
    return x.select(*(rows[c] for c in rows.columns), "answer", F.when(F.col("answer").isNull(), F.col("error")).alias("error"))


def texts(v: Column, key: str) -> Column:
    """A JSON array's elements as strings, others in JSON spelling; null if it is no array."""
    items = F.try_variant_get(v, f"$.{key}", "array<variant>")
    return F.transform(items, lambda x: F.coalesce(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")), F.to_json(x), F.lit("null")))


def whole_score(v: Column) -> Column:
    """The score if it is an integer or a truth value (which counts as 1 or 0)."""
    raw = F.try_variant_get(v, "$.architecture_score", "variant")
    kind = F.schema_of_variant(raw)
    return F.when(kind == "BIGINT", F.try_variant_get(raw, "$", "long")).when(kind == "BOOLEAN", F.try_variant_get(raw, "$", "boolean").cast("long"))


def type_name(v: Column) -> Column:
    """A JSON value's type, as Python calls it."""
    kind = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    names = {"STRING": "str", "BIGINT": "int", "BOOLEAN": "bool", "ARRAY": "list", "OBJECT": "dict", "VOID": "NoneType"}
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), kind), F.lit("float"))


def parse_lenient(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """Score (0 unless an integer within 0 to 100) and lists (empty unless arrays); no JSON counts as an empty object."""
    v = F.try_parse_json(F.trim(F.col(answer)))
    score = whole_score(v)
    none = F.array().cast("array<string>")
    return rows.select(
        "*",
        F.when(score.between(0, 100), score).otherwise(0).cast("int").alias(KEYS[0]),
        *(F.coalesce(texts(v, k), none).alias(k) for k in KEYS[1:]),
    )


def parse_strict(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """The review, or null fields and ``error`` with the first rule that the answer breaks."""
    v = F.try_parse_json(F.trim(F.col(answer)))
    get = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    missing = lambda k: get(k).isNull() | F.coalesce(F.schema_of_variant(get(k)) == "VOID", F.lit(False))
    score = whole_score(v)
    error = F.when(v.isNull(), "Invalid JSON").when(~F.schema_of_variant(v).startswith("OBJECT"), "Expected a JSON object")
    error = error.when(missing(KEYS[0]), f"Missing required key: {KEYS[0]}").when(score.isNull(), F.concat(F.lit(f"{KEYS[0]} must be an integer, got "), type_name(get(KEYS[0]))))
    error = error.when(~score.between(0, 100), F.concat(F.lit(f"{KEYS[0]} must be between 0 and 100, got "), score.cast("string")))
    for k in KEYS[1:]:
        error = error.when(missing(k), f"Missing required key: {k}").when(~F.schema_of_variant(get(k)).startswith("ARRAY"), F.concat(F.lit(f"{k} must be an array, got "), type_name(get(k))))
    x = rows.withColumn("error", error)
    good = F.col("error").isNull()
    return x.select("*", F.when(good, score).cast("int").alias(KEYS[0]), *(F.when(good, texts(v, k)).alias(k) for k in KEYS[1:]))


def require_valid(rows: DataFrame) -> DataFrame:
    """Fail the job where :func:`parse_strict` found an error."""
    return rows.where(F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("boolean")).otherwise(True)).drop("error")
