"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are applied afterwards.

``ledger`` stores the measurements of a text and a mask with one bit for each rule that fails.
``apply_policy`` keeps the rows whose mask has none of a versioned policy's bits, and ``ablation``
counts for each rule of a policy what it rejects, alone or not, from the masks alone.

Built-in expressions only, row by row and without a shuffle. A null text counts as empty (0 words,
which fails ``few_words``). Ties and repeated rows come out row by row. Columns of the input named
as the ledger's are replaced by them (callers that need theirs put them into a struct). An empty table gives no rows; very long texts are measured whole. A window's words are told apart by a 64-bit hash of the three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import SPACE, WORD, all_columns, table

#: Rule names in the order of their bits.
RULES = ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length")
#: Each policy: the rules that reject a document. Published policies stay as they are; add new ones.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "v2": ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length"),
}
MIN_WORDS, MAX_REPEATED_PCT, MAX_SYMBOLS_PCT, MAX_LINES_PCT, WORD_CHARS = 50, 50, 10, 50, (2, 15)
#: Up to so many repeated windows a text's positions are looked up one by one, beyond it they are sorted.
FEW = 32


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, windows: Column, in_order: Column) -> Column:
    """Words that lie in a window found at least twice; windows: a hash for each start, in_order: the same sorted."""
    repeats = F.array_distinct(F.filter(in_order, lambda x, i: (i > 0) & (x == F.get(in_order, i - 1))))
    looked_up = lambda r: F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda j: F.array_contains(r, F.get(windows, j)))
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, b: F.coalesce(a.h == b.h, F.lit(False))
    by_sort = let(pairs, lambda p: F.array_sort(F.transform(F.filter(p, lambda x, k: same(x, F.get(p, k - 1)) | same(x, F.get(p, k + 1))), lambda x: x.i)))
    starts = let(repeats, lambda r: F.when(F.size(r) <= FEW, looked_up(r)).otherwise(by_sort))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a.n + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a.n,
    )
    return F.when(F.size(windows) > F.size(F.array_distinct(windows)), covered).otherwise(0)


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text column but with the measurements (long) and ``failed`` (int, a bit for each rule)."""
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "failed"]
    rest = [(name, c) for name, c in zip(df.columns, all_columns(df), strict=True) if name not in (*made, text)]
    hidden = F.coalesce(df[text], F.lit(""))
    row = F.struct(*(c for _, c in rest), F.lit(None).cast("int").alias("__none"))  # one column, so that no name can clash
    x = df.select(row.alias("__row"), hidden.alias("__text"), F.regexp_extract_all(hidden, F.lit(WORD), F.lit(0)).alias("__words"))
    keep = ["__row"]
    words, body = F.col("__words"), F.col("__text")
    windows = F.when(
        F.size(words) >= 3,
        F.transform(F.slice(words, 3, F.greatest(F.size(words), F.lit(1))), lambda w, i: F.xxhash64(F.get(words, i), F.get(words, i + 1), w)),
    ).otherwise(F.array().cast("array<bigint>"))
    x = x.select(
        *keep,
        "__words",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(f"[^{SPACE}]")).alias("__lines"),
        windows.alias("__windows"),
    )
    numbers = ["n_words", "word_chars", "n_symbols"]
    x = x.select(
        *keep, *numbers, "__words", "__windows",
        F.sort_array("__windows").alias("__in_order"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
    )
    numbers += ["n_lines", "n_dup_lines"]
    x = x.select(*keep, *numbers, repeated_words(words, F.col("__windows"), F.col("__in_order")).cast("long").alias("n_repeat_words"))
    n, c = F.col("n_words"), F.col
    fails = {
        "few_words": n < MIN_WORDS,
        "repeated_words": 100 * c("n_repeat_words") > MAX_REPEATED_PCT * n,
        "symbols": 100 * c("n_symbols") > MAX_SYMBOLS_PCT * n,
        "repeated_lines": 100 * c("n_dup_lines") > MAX_LINES_PCT * c("n_lines"),
        "word_length": (n > 0) & ~c("word_chars").between(WORD_CHARS[0] * n, WORD_CHARS[1] * n),
    }
    failed = F.lit(0)
    for i, rule in enumerate(RULES):
        failed = failed.bitwiseOR(F.when(fails[rule], 1 << i).otherwise(0))
    # a filter on the mask must not be pushed below it, where the measurements would be spelled out again in every
    # condition and every lambda; the optimizer pushes nothing through an expression that it takes for indeterminate
    x = x.withColumn("failed", F.when(F.monotonically_increasing_id() >= 0, failed))
    return x.select(*(F.col("__row").getField(name).alias(name) for name, _ in rest), *made)


def mask(policy: str) -> int:
    return sum(1 << RULES.index(rule) for rule in POLICIES[policy])


def passes(policy: str) -> Column:
    """Whether a row of a ledger passes a policy."""
    return F.col("failed").bitwiseAND(mask(policy)) == 0


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    return rows.where(passes(policy))


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: rows that fail it, and rows that only it rejects (kept without the rule)."""
    own = rows.groupBy(F.col("failed").bitwiseAND(mask(policy)).alias("failed")).agg(F.count("*").alias("n"))
    bits = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).alias("bit")) for r in POLICIES[policy]))
    each = own.select("failed", "n", F.inline(bits))
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("failed") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base")).alias("base_failed"), passes("v1").alias("kept"), F.col("failed").cast("long").alias("failed"),
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each policy and rule over all documents: rows that fail it, and rows that only it rejects. The ledger is evaluated once."""
    sums = ledger(table(spark, sf_dir, "documents").select("text")).groupBy("failed").agg(F.count("*").alias("n"))  # 2^5 rows at most
    policies = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(mask(p)).alias("mask")) for p in POLICIES))).alias("p")
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << i).alias("bit")) for i, r in enumerate(RULES)))
    x = sums.select("failed", "n", policies).select("n", "p.*", F.col("failed").bitwiseAND(F.col("p.mask")).alias("failed")).select("*", F.inline(rules))
    x = x.where(F.col("mask").bitwiseAND(F.col("bit")) != 0)
    of = lambda rows: F.sum(F.when(rows, F.col("n")).otherwise(0))
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    return x.groupBy("policy", "rule").agg(of(hit).alias("n_failed"), of(F.col("failed") == F.col("bit")).alias("n_only"), of(F.col("failed") != 0).alias("n_rejected"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS k FROM documents),
w AS (SELECT doc_id, k, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT k, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS tri FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
c AS (SELECT k, i, count(*) OVER (PARTITION BY k, tri) AS n FROM g),
p AS (SELECT k, count(DISTINCT i + o) AS n FROM c, (VALUES (0), (1), (2)) AS v(o) WHERE n > 1 GROUP BY k),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN p USING (k)),
f AS (SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 10 * n_words)::INT
        + 8 * (100 * n_dup_lines > 50 * n_lines)::INT
        + 16 * (n_words > 0 AND NOT word_chars BETWEEN 2 * n_words AND 15 * n_words)::INT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed,
  (failed & 15) = 0 AS kept, failed::BIGINT AS failed FROM f
"""

_BITS = ", ".join(f"('{p}', {sum(1 << RULES.index(r) for r in own)}, '{r}', {1 << RULES.index(r)})" for p, own in POLICIES.items() for r in own)
ABLATION_SQL = f"""
SELECT policy, rule, count(*) FILTER ((failed & bit) <> 0) AS n_failed, count(*) FILTER ((failed & mask) = bit) AS n_only, count(*) FILTER ((failed & mask) <> 0) AS n_rejected
FROM ({OP6_SQL}) AS ledger, (VALUES {_BITS}) AS rules(policy, mask, rule, bit) GROUP BY policy, rule
"""
