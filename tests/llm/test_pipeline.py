"""The corpus pipeline against a plain version of each of its stages, which shares no code with it but the parsing of keys."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as p
from strata.llm import bpe, secrets
from strata.llm.common import written
from tests.llm.test_exact import brute_mix, docs, naive_base, near_rows, shingle_set, table_docs

HEX = "token = " + "0a" * 20


def corpus(spark):
    rows = [(d, t) for d, t in near_rows(21, 40) if len(t.split()) >= 60]
    rows += [(8001, " ".join(f"u{i}" for i in range(80)) + " " + HEX), (8002, "short"), (8003, None), (8004, " ".join(["x|"] * 90)), (None, " ".join(f"n{i}" for i in range(70)))]
    rows += [(8005, " ".join(f"w{i}" for i in range(60)) + "\nAKIA" + "Q7" * 10 + "\n"), (8006, "\n".join(["same line of five words"] * 30))]
    rows += [(100_000 + d, t) for d, t in table_docs(spark)[:120]]
    return docs(spark, rows + rows[:1])


def plain_quality(text):
    words = (text or "").replace("\x1c", "x").replace("\x1d", "x").replace("\x1e", "x").replace("\x1f", "x").replace("\x85", "x").replace("\xa0", "x").split()
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\n\v\f\r")]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words) >= 50 and 100 * len(covered) <= 50 * len(words) and 100 * symbols <= 10 * len(words) and 100 * (len(lines) - len(set(lines))) <= 50 * len(lines)


def plain_heads(rows):
    """One row of each class of near duplicates: that with the smallest doc_id, null last."""
    sets, up = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                up[top(i)] = top(j)
    classes = defaultdict(list)
    for i, row in enumerate(rows):
        classes[top(i)].append(row)
    return [min(c, key=lambda r: (r[0] is None, r[0] or 0)) for c in classes.values()]


def plain_mask(text):
    spans = [(v, b) for _, _, b, v in naive_base(text)] + [(a, b) for _, a, b in secrets.confirmed(text)]
    hidden = {i for a, b in spans for i in range(a, b)}
    return "".join(c if i not in hidden else secrets.MASK if i - 1 not in hidden else "" for i, c in enumerate(text))


def test_stages(spark):
    now, kept = corpus(spark), []
    rows = [(r.doc_id, r.text, r.source) for r in now.collect()]
    for name, stage in p.STAGES:
        now = written(stage(spark, now, ""), name)
        kept.append(now)
        if name != p.STAGES[-1][0]:
            assert sorted(now.columns) == sorted(p.COLUMNS)
    key = lambda r: repr(r)
    good = [r for r in rows if plain_quality(r[1])]
    assert sorted(((r.doc_id, r.text, r.source) for r in kept[0].collect()), key=key) == sorted(good, key=key) and 60 < len(good) < len(rows)
    source = {d: s for d, _, s in good}
    heads = plain_heads([(d, t) for d, t, _ in good])
    got = sorted(((r.doc_id, r.source) for r in kept[1].collect()), key=key)
    assert got == sorted(((d, source[d]) for d, _ in heads), key=key) and len(got) < len(good)
    hidden = [(r.doc_id, r.text, r.n_chars) for r in kept[2].collect()]
    texts = {r.doc_id: (r.text, r.n_chars) for r in kept[1].collect()}
    assert sorted(hidden, key=key) == sorted(((d, plain_mask(t), len(plain_mask(t)) if plain_mask(t) != t else n) for d, (t, n) in texts.items()), key=key)
    assert sum(secrets.MASK in t for _, t, _ in hidden) >= 2
    mine = [(source[d], d, t) for d, t, _ in hidden]
    copies, target = brute_mix(mine)
    mixed = Counter((r.source, r.doc_id, r.text) for r in kept[3].collect())
    assert mixed == Counter({m: copies[i] for i, m in enumerate(mine) if copies[i]}) and max(mixed.values()) == 2
    tokenizer = bpe.load(bpe.TOKENIZER)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for (_, d, t), n in mixed.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want[(d, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))] += n
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in kept[4].collect()) == want


def test_clashing_columns(spark):
    """Extra columns come back as they went in, whatever their names."""
    names = ["size", "key", "row", "__cid", "cid", "id", "failed", "n_words", "secret_spans", "copies", "quality", "name", "__text", "words", "a`b", "x.y", "target", "bucket"]
    now = corpus(spark).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for name, stage in p.STAGES:
        now = written(stage(spark, now, ""), name)
        if name != p.STAGES[-1][0]:
            assert set(now.columns) == {*p.COLUMNS, *names}
            wrong = F.lit(False)
            for n in names:
                wrong = wrong | ~F.col("`" + n.replace("`", "``") + "`").eqNullSafe(F.concat(F.lit(n), F.col("doc_id").cast("string")))
            assert now.where(wrong).count() == 0, name
    assert now.count() > 50


def test_empty(spark):
    now = corpus(spark).limit(0)
    for _, stage in p.STAGES:
        now = written(stage(spark, now, ""), "empty")
    assert now.count() == 0


def test_nulls_in_any_column(spark):
    """Each column is null in one row of six; only a null text ends a document."""
    now = corpus(spark).limit(90).withColumn("n", F.monotonically_increasing_id() % 6)
    kinds = dict(now.dtypes)
    now = written(now.select(*(F.when(F.col("n") != i, F.col(c)).cast(kinds[c]).alias(c) for i, c in enumerate(p.COLUMNS))), "nulls")
    for name, stage in p.STAGES:
        if name == "near_duplicates":
            assert all(now.where(F.col(c).isNull()).count() for c in p.COLUMNS if c != "text") and now.where("text IS NULL").isEmpty()
        now = written(stage(spark, now, ""), "nulls")
    assert now.count() > 10
