"""Periodic runs of words: stretches that repeat themselves at least four times over, and the text without the repeats.

A run is a maximal stretch of words with smallest period q and at least ``max(6, 4 * q)`` words. At the scale b (a power of
two, b <= q < 2 * b) blocks of 2 * b words at multiples of b are the keys of an Aho-Corasick automaton over the numbers of words
(for long blocks: of power-of-two stretches of words), which is searched across the document. A run holds such a block with its repeat, and as the block is no shorter than the period, its next
occurrence lies exactly q words on; so every block gives one seed at most, where that distance fits the scale, and the seed is
extended both ways word by word. Each stretch is extended once. Before the search, a scale is confined to stretches in
which every word occurred less than 2 * b words before, which every run of that scale leaves behind after its first period; most texts have none.

A text takes time in proportion to its words and their logarithm, and the automaton holds a segment at a time. Rows go
through on their own: no shuffle, nothing collected. A null text counts as empty; empty texts, and those of fewer than six words,
have no runs. Repeated rows come out row by row, an empty table gives no rows. Other columns go along
untouched, whatever they are called, but for ``runs`` and ``collapsed``, which it makes.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import WORD, all_columns, schema_with, small_batches, table
from strata.llm.quality import let

LEAST, POWER = 6, 4
#: Words of a segment that one automaton covers, at least; its seeds' blocks begin in it.
SEGMENT = 1 << 11
#: Blocks of 2 * b words beyond 2 * NUMBERS are keys of 2 * NUMBERS numbers of shorter stretches, so that no search falls back far.
NUMBERS = 8
RUN = T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")]))


def last_seen(ids: np.ndarray) -> np.ndarray:
    """How many words before each word it occurred last; the number of words where it did not."""
    order = np.argsort(ids, kind="stable")
    gap = np.full(len(ids), len(ids), np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    gap[order[1:][same]] = (order[1:] - order[:-1])[same]
    return gap


def stretches(near: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Begin and end of the stretches of at least ``least`` true values."""
    if np.count_nonzero(near) < least:
        return
    edge = np.flatnonzero(near[1:] != near[:-1]) + 1
    edge = np.concatenate(([0] * bool(near[0]), edge, [len(near)] * bool(near[-1]))).astype(np.int64)
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a >= least:
            yield a, b


def agreed(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first values are equal."""
    done, step, n = 0, 64, min(len(a), len(b))
    while done < n:
        differ = np.flatnonzero(a[done : done + step] != b[done : done + step][: n - done])
        if len(differ):
            return done + int(differ[0])
        done, step = min(n, done + step), step * 2
    return n


def doubled(names: np.ndarray, width: int) -> np.ndarray:
    """Numbers of all stretches of 2 * width words from those of all stretches of width words: equal for equal stretches."""
    both = names[:-width] * (int(names.max()) + 1) + names[width:]
    return np.unique(both, return_inverse=True)[1]


def seeds(names: np.ndarray, width: int, lo: int, hi: int, b: int) -> Iterator[tuple[int, int]]:
    """(block's begin, distance to its next occurrence) for the blocks of 2 * b words at multiples of b within lo to hi.

    ``names`` numbers the stretches of ``width`` words at every word, ``width`` divides b; so a key has 2 * b / width numbers.
    The document is searched as ``width`` sequences of every width-th number, with a 0 between them.
    """
    step, long = -(-max(SEGMENT, 16 * b) // b) * b, 2 * b // width
    for at in range(-(-lo // b) * b, hi - 2 * b + 1, step):
        own = names[at : max(at, min(hi, at + step + 4 * b) - width + 1)] + 1
        keys: dict[tuple, int] = {}
        for p in range(0, min(step, len(own) + width - 2 * b), b):
            keys.setdefault(tuple(own[p : p + 2 * b : width].tolist()), len(keys))
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for block, i in keys.items():
            machine.add_word(block, i)
        machine.make_automaton()
        rows = -(-len(own) // width) + 1
        text = np.zeros(rows * width, np.int64)
        text[: len(own)] = own
        text = text.reshape(rows, width).T.ravel()
        found = np.array(list(machine.iter(tuple(text.tolist()))), np.int64).reshape(-1, 2)
        place, key = found[:, 0] - long + 1, found[:, 1]
        place = place % rows * width + place // rows
        order = np.lexsort((place, key))
        place, key = place[order], key[order]
        apart = np.diff(place)
        good = (key[1:] == key[:-1]) & (apart >= b) & (apart < 2 * b) & (place[:-1] % b == 0) & (place[:-1] < step)
        first = np.argsort(place[:-1][good], kind="stable")
        yield from zip((at + place[:-1][good][first]).tolist(), apart[good][first].tolist(), strict=True)


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text's word numbers, by start, then period."""
    n, found, b = len(ids), set(), 1
    names, width = ids, 1
    gap = last_seen(ids) if n >= LEAST else None
    while POWER * b <= n and n >= LEAST:
        known: dict[int, int] = {}  # the end of the last stretch that was extended with a distance
        for lo, hi in stretches(gap < 2 * b, max(LEAST - b, (POWER - 1) * b)):
            while width * NUMBERS < b:
                names, width = doubled(names, width), width * 2
            for p, d in seeds(names, width, max(0, lo - 2 * b + 1), hi, b):
                if p < known.get(d, 0):
                    continue
                end = p + agreed(ids[p : n - d], ids[p + d :])
                start = p - agreed(ids[:p][::-1], ids[d : p + d][::-1])
                known[d] = end
                if end + d - start >= max(LEAST, POWER * d):
                    found.add((start, end + d - start, d))
        b *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word's number, in the order of first occurrence."""
    no = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(no.__getitem__, words), np.int64, len(words))


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: it does unless some run contains it after its first period."""
    delta = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        delta[start + period] += 1
        delta[start + length] -= 1
    return np.cumsum(delta[:n]) == 0


def periodic_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text but with ``runs`` (start, length, period of each, in words) and ``collapsed``, its words without the repeats."""
    rest = [(name, c) for name, c in zip(df.columns, all_columns(df), strict=True) if name not in ("runs", "collapsed", text)]
    x = df.select(*(c for _, c in rest), df[text].alias("__text"))
    names = [name for name, _ in rest]
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, texts = [], []
            for value in batch.column(len(names)):
                words = value.as_buffer().to_pybytes().split() if value.is_valid else []  # ASCII white space
                own = runs_of(numbered(words))
                if own:
                    words = [w for w, k in zip(words, kept(len(words), own), strict=True) if k]
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                texts.append(b" ".join(words))
            made = [pa.array(runs, kind), pa.array(texts, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *made], names=[*names, "runs", "collapsed"])

    small_batches(df.sparkSession)
    return x.mapInArrow(scan, schema_with(x.drop("__text"), runs=RUN, collapsed=T.StringType()))


def with_repeats(doc_id: Column, text: Column) -> Column:
    """The text, in which every tenth document by its id's checksum repeats a passage from some word on to its end.

    A null id repeats nothing.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    some = lambda w: F.greatest(F.size(w), F.lit(1))

    def repeated(w: Column) -> Column:
        a = (g % some(w)).cast("int")
        p = (1 + F.floor((F.size(w) - a) / (3 + g % 8))).cast("int")
        return let(F.struct(a.alias("a"), p.alias("p")), lambda k: F.array_join(F.transform(w, lambda x, i: F.when(i < k.a, x).otherwise(F.get(w, k.a + (i - k.a) % k.p))), " "))

    return F.when(h % 10 == 0, let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), repeated)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, some of which are made to repeat themselves, and digests of the runs and of the text without them."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", with_repeats(F.col("doc_id"), text).alias("text"))
    x = periodic_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    x = x.select("doc_id", "runs", "collapsed", best.alias("b"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))), "")
    length, period = F.col("b.length"), -F.col("b.period")
    return x.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(F.lit(1000) * length / period).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
