"""Token counts without token ids.

A sentencepiece BPE model never joins characters across a pre-token's border, so
a text's count is the sum over its pre-tokens. Within a task each distinct
pre-token is counted once; counts are then joined by position to the documents'
pre-token frequencies and summed. The ids of a document are never made.

Borders: a pre-token is a run of spaces with what follows up to the next space
or line break, a run of spaces before a line break or the end, or a line break.
``borders_hold`` checks that the vocabulary has no piece across such a border.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4096
PRETOKEN = re.compile(r" *[^ \n]+| +|\n")
SPACE = "▁"  # stands for a space in the vocabulary and, in texts, is one
CACHE = 500_000


def load(path: str):
    """The tokenizer's library object for a model file."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def borders_hold(model) -> bool:
    """True if no piece has a space behind another character, or a line break beside one."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i))
    return not any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for p in pieces)


class Counter:
    """Counts of pre-tokens, each made once; the oldest are forgotten beyond a bound."""

    def __init__(self, path: str) -> None:
        self.model = load(path)
        self.exact = borders_hold(self.model)
        self.known: dict[str, int] = {}

    def pretokens(self, text: str) -> list[str]:
        """The text's pre-tokens; the library's leading space is part of the first."""
        return PRETOKEN.findall(" " + text.replace(SPACE, " ")) if text else []

    def learn(self, new: list[str]) -> None:
        """Count pre-tokens that aren't known yet.

        The library puts a space in front of a text: it stands for a pre-token's
        own first space. One without a space is counted behind a line break, and
        the two tokens of space and break are taken off.
        """
        spaced = [t for t in new if t[0] == " "]
        bare = [t for t in new if t[0] != " "]
        for tokens, texts, less in ((spaced, [t[1:] for t in spaced], 0), (bare, ["\n" + t for t in bare], 2)):
            if tokens:
                ids = self.model.encode(texts, num_threads=1)
                self.known.update((t, max(len(i), 1) - less) for t, i in zip(tokens, ids, strict=True))

    def count(self, texts: list[str | None]) -> list[int]:
        if not self.exact:
            return [len(i) for i in self.model.encode([t or "" for t in texts], num_threads=1)]
        if len(self.known) > CACHE:
            self.known.clear()
        split = [self.pretokens(t or "") for t in texts]
        known = self.known
        self.learn(list({t for tokens in split for t in tokens if t not in known}))
        return [int(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)).sum()) for tokens in split]


def count_tokens(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than 4096 tokens) of each row's whole text.

    Counts equal those of the library for ``model_path`` without begin, end or
    added tokens. A null text counts as empty: no bytes, no tokens. Null and
    repeated ids keep a row each; other columns are ignored; an empty table
    gives an empty result. ``model_path`` must exist on every executor.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model_path)
        for batch in batches:
            texts = batch.column(1)
            tokens: list[int] = []
            for at in range(0, len(texts), 256):
                tokens += counter.count(texts.slice(at, 256).to_pylist())
            n = pa.array(tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], names=["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), size.alias("n_bytes"))
    kind = dict(rows.dtypes)["doc_id"]
    done = rows.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long")
    return done.withColumn("over_limit", F.col("n_tokens") > LIMIT)
