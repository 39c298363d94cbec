"""Token counts without materialised ids: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes, and texts are cut at safe boundaries: a space after a character
that is no space. The model's pieces never hold a space mark after another character (checked
when it loads) and it puts a space mark before each text it gets, so that leaving out the space
at the cut gives the same pieces as the whole text. Memory follows the batch, not the text's pieces.

Null and empty texts have 0 bytes and 0 tokens; repeated rows and ties come out row by row;
columns beyond the key and the text are not read, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strata.llm.common import byte_slices, table

MODEL = "piece_bpe_32k.model"
BATCH_BYTES = 4 << 20
TOKEN_LIMIT = 4096


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A space that may be left out where a text is cut: it follows a character that is no space.
SAFE_CUT = re.compile("(?<=[^ ]) ")
MARK = "▁"
CACHE_ENTRIES = 400_000
JOIN_PARTS = 512


class PieceCounter:
    """Counts the pieces of texts with a sentencepiece model.

    Every text is cut at all safe boundaries; a batch encodes each distinct part once and keeps
    only its length, in a cache of at most ``CACHE_ENTRIES`` parts and a batch's own. Parts are
    encoded many at a time, joined by single spaces: each then begins with the only piece that
    bears a space mark. Texts that hold the mark itself are encoded whole.
    """

    def __init__(self, path: str):
        import numpy as np
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = self.model.id_to_piece(list(range(self.model.get_piece_size())))
        self.first = np.array([p.startswith(MARK) for p in pieces])
        marks = self.model.encode("a  a", out_type=str) == self.model.encode("a", out_type=str) + self.model.encode(" a", out_type=str)
        self.safe = marks and not any(re.search("[^▁]▁", p) for p in pieces)
        self.known: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def learn(self, parts: list[str]) -> None:
        import numpy as np

        plain = [p for p in parts if p and p[0] != " " and MARK not in p]
        for i in range(0, len(plain), JOIN_PARTS):
            own = plain[i : i + JOIN_PARTS]
            ids = np.array(self.model.encode(" ".join(own), num_threads=1))
            counts = np.bincount(np.cumsum(self.first[ids]) - 1)
            assert len(counts) == len(own)
            self.known.update(zip(own, counts.tolist(), strict=True))
        rest = [p for p in parts if p and (p[0] == " " or MARK in p)]
        self.known.update(zip(rest, self.whole(rest), strict=True))

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return self.whole(texts)
        parts = [[x] if MARK in x else SAFE_CUT.split(x) if "  " in x or x[:1] == " " else x.split(" ") for x in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known = {}
        self.known[""] = 1  # what follows a last space: the space's own mark
        known = self.known
        self.learn(list({p for own in parts for p in own if p not in known}))
        return [sum([known[p] for p in own]) if x else 0 for x, own in zip(texts, parts, strict=True)]


class JsonCounter:
    """Counts the tokens of texts with a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


def token_counts(
    df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = MODEL, limit: int = TOKEN_LIMIT, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """One row per row of ``df``: the key, n_bytes, n_tokens and whether n_tokens is over ``limit``."""
    name = tokenizer

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = name if "/" in name else tokenizer_path(name)
        counter = PieceCounter(path) if path.endswith(".model") else JsonCounter(path)
        for whole in batches:
            for batch in byte_slices(whole, "text", batch_bytes):
                texts = [x or "" for x in batch.column("text").to_pylist()]
                n = counter(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key),
                        pa.array([len(x.encode()) for x in texts], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([x > limit for x in n], pa.bool_()),
                    ],
                    names=[key, "n_bytes", "n_tokens", "over_limit"],
                )

    rows = df.select(df[key], df[text].alias("text"))
    return rows.mapInArrow(count, f"`{key}` {rows.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
