"""Language identification by unigram pieces with the segmentation summed out.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability under a language is the sum over all of its segmentations
into pieces, by the forward algorithm; a text's is the product over its words.
The probabilities are fitted by expectation maximisation on word counts of a
bounded sample of labelled texts. Scoring runs word by word once per task: words
seen before come from a bounded cache.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, DoubleType

from sieveline.llm.common import sampled

#: Rows per language that the model is fitted on, in expectation, and distinct words per language.
SAMPLE_ROWS = 1000
SAMPLE_WORDS = 40_000
ROUNDS = 4
UNDETERMINED = "und"
WORD = regex.compile(r"\p{L}+")
MARK = "▁"
LONG = 32  # words of more letters go through the rescaled pass
CACHE = 250_000
STEP = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[str]:
    """Lower-case pieces of a public sentencepiece vocabulary, from its file's path."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    )
    return sorted({p for p in pieces if p == p.lower() and p.lstrip(MARK) and all(c.isalpha() for c in p.lstrip(MARK))} | {MARK})


def _hash(codes: np.ndarray, before: np.ndarray) -> np.ndarray:
    x = (before ^ codes.astype(np.uint64)) * STEP
    return x ^ (x >> np.uint64(29))


@dataclass
class Trie:
    """Pieces and their prefixes, found by a rolling hash of their characters."""

    pieces: list[str]
    hashes: np.ndarray = field(init=False)
    piece: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        prefixes = sorted({p[:k] for p in self.pieces for k in range(1, len(p) + 1)})
        number = {p: i for i, p in enumerate(self.pieces)}
        keys = np.zeros(len(prefixes), np.uint64)
        length = np.array([len(p) for p in prefixes])
        codes = np.zeros((len(prefixes), length.max()), np.uint32)
        for i, p in enumerate(prefixes):
            codes[i, : len(p)] = [ord(c) for c in p]
        for k in range(codes.shape[1]):
            live = length > k
            keys[live] = _hash(codes[live, k], keys[live])
        order = np.argsort(keys)
        self.hashes = keys[order]
        self.piece = np.array([number.get(p, -1) for p in prefixes])[order]

    def matches(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length, the (word, start, piece) of all pieces in ``words``, in order of start.

        Words begin with the mark, which counts as a character. Single characters
        outside the vocabulary match the unknown piece, number ``len(pieces)``.
        """
        size = np.array([len(w) for w in words])
        codes = np.zeros((len(words), size.max() + 1), np.uint32)
        codes[np.arange(codes.shape[1])[None, :] < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        start, word = np.nonzero((np.arange(codes.shape[1])[None, :] < size[:, None]).T)
        state = np.zeros(len(word), np.uint64)
        found = []
        length = 0
        while len(word):
            inside = start + length < size[word]
            word, start, state = word[inside], start[inside], state[inside]
            if not len(word):
                break
            state = _hash(codes[word, start + length], state)
            at = np.minimum(np.searchsorted(self.hashes, state), len(self.hashes) - 1)
            known = self.hashes[at] == state
            piece = np.where(known, self.piece[at], -1)
            if not length:
                piece[piece < 0] = len(self.pieces)
            hit = piece >= 0
            found.append(tuple(x[hit].astype(np.int32) for x in (word, start, piece)))
            word, start, state = word[known], start[known], state[known]
            length += 1
        return found


@dataclass
class Model:
    """Languages, pieces, and a log-probability for each piece (the unknown one last) and language."""

    languages: list[str]
    pieces: list[str]
    log_p: np.ndarray


def _forward(found: list, size: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """alpha[position, word, language], and the slices of each length's matches by start."""
    top = int(size.max())
    alpha = np.zeros((top + 1, len(size), p.shape[1]))
    alpha[0] = 1
    cuts = [np.searchsorted(s, np.arange(top + 1)) for _, s, _ in found]
    for s in range(top):
        for k, (word, _, piece) in enumerate(found):
            a, b = cuts[k][s], cuts[k][s + 1]
            if b > a:
                w = word[a:b]
                alpha[s + k + 1, w] += alpha[s, w] * p[piece[a:b]]
    return alpha, cuts


def _long_word(trie: Trie, word: str, p: np.ndarray) -> np.ndarray:
    """Log-probability of one word of any length, rescaled at every position."""
    found = trie.matches([word])
    by_end: dict[int, list[tuple[int, int]]] = {}
    for k, (_, start, piece) in enumerate(found):
        for s, i in zip(start.tolist(), piece.tolist(), strict=True):
            by_end.setdefault(s + k + 1, []).append((s, i))
    # A window of the last positions is kept, each with its logarithm's offset taken out.
    logs = {0: np.zeros(p.shape[1])}
    for end in range(1, len(word) + 1):
        terms = [logs[s] + np.log(p[i]) for s, i in by_end[end]]
        logs[end] = np.logaddexp.reduce(terms, axis=0)
        logs.pop(end - len(found) - 1, None)
    return logs[len(word)]


def word_scores(trie: Trie, words: list[str], log_p: np.ndarray) -> np.ndarray:
    """log P(word | language), a row each, over all segmentations."""
    p = np.exp(log_p)
    out = np.empty((len(words), p.shape[1]))
    marked = [MARK + w for w in words]
    size = np.array([len(w) for w in marked])
    for i in np.flatnonzero(size > LONG):
        out[i] = _long_word(trie, marked[i], p)
    order = np.argsort(size, kind="stable")
    order = order[size[order] <= LONG]
    for at in range(0, len(order), 8192):  # words of like length together
        part = order[at : at + 8192]
        alpha, _ = _forward(trie.matches([marked[i] for i in part]), size[part], p)
        out[part] = np.log(alpha[size[part], np.arange(len(part))])
    return out


def fit_pieces(pieces: list[str], counts: dict[str, dict[str, float]], rounds: int = ROUNDS) -> Model:
    """Piece probabilities by expectation maximisation on word counts per language."""
    trie, languages = Trie(pieces), sorted(counts)
    words = sorted({w for c in counts.values() for w in c if len(w) < LONG})
    weight = np.empty((len(words), len(languages)))
    for k, lang in enumerate(languages):
        weight[:, k] = [counts[lang].get(w, 0.0) for w in words]
    shape = (len(pieces) + 1, len(languages))
    p = np.full(shape, 1 / shape[0])
    size = np.array([len(MARK) + len(w) for w in words])
    order = np.argsort(size, kind="stable")
    parts = []
    for at in range(0, len(order), 8192):
        part = order[at : at + 8192]
        parts.append((part, trie.matches([MARK + words[i] for i in part])))
    for _ in range(rounds):
        seen = np.zeros(shape)
        for part, found in parts:
            n = size[part]
            alpha, cuts = _forward(found, n, p)
            beta = np.zeros_like(alpha)
            beta[n, np.arange(len(part))] = 1
            share = weight[part] / alpha[n, np.arange(len(part))]
            for s in range(int(n.max()) - 1, -1, -1):
                for k, (word, _, piece) in enumerate(found):
                    a, b = cuts[k][s], cuts[k][s + 1]
                    if b > a:
                        w, i = word[a:b], piece[a:b]
                        after = p[i] * beta[s + k + 1, w]
                        beta[s, w] += after
                        np.add.at(seen, i, alpha[s, w] * after * share[w])
        seen += 0.01
        p = seen / seen.sum(axis=0)
    return Model(languages, pieces, np.log(p))


class Scorer:
    """Scores texts, with a bounded cache of words; words met once are dropped from it first."""

    def __init__(self, model: Model) -> None:
        self.model, self.trie = model, Trie(model.pieces)
        self.place: dict[str, int] = {}
        self.rows = np.empty((0, len(model.languages)))
        self.seen = np.empty(0, np.int64)

    def _forget(self) -> None:
        keep = np.flatnonzero(self.seen > 1)
        keep = keep if len(keep) <= CACHE // 2 else keep[:0]
        words = list(self.place)
        self.place = {words[i]: k for k, i in enumerate(keep.tolist())}
        self.rows, self.seen = self.rows[keep], np.zeros(len(keep), np.int64)

    def log_likelihoods(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the words' log-probabilities for each text and language, and each text's number of words."""
        if len(self.place) > CACHE:
            self._forget()
        split = [WORD.findall(t.lower()) if t else [] for t in texts]
        new = sorted({w for words in split for w in words if w not in self.place})
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, word_scores(self.trie, new, self.model.log_p)])
            self.seen = np.append(self.seen, np.zeros(len(new), np.int64))
        n = np.array([len(words) for words in split], np.int64)
        total = np.zeros((len(texts), len(self.model.languages)))
        place = self.place
        for i, words in enumerate(split):
            if words:
                at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                total[i] = self.rows[at].sum(axis=0)
                self.seen[at] += 1
        return total, n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Likeliest language (ties: the first by name) and its posterior under equal priors."""
        if not self.model.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        total, n = self.log_likelihoods(texts)
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        found = [self.model.languages[b] if k else UNDETERMINED for b, k in zip(best, n, strict=True)]
        return found, np.where(n > 0, score, 0.0)


def fit_languages(
    labelled: DataFrame,
    vocabulary_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    rows: int = SAMPLE_ROWS,
    words: int = SAMPLE_WORDS,
) -> Model:
    """Fit a model on about ``rows`` texts of each language, whole, and their ``words`` most frequent words.

    Rows with a null id, text or language teach nothing. Without any labelled
    row the model has no language and every text is undetermined.
    """
    known = labelled.where(F.col(text_column).isNotNull() & F.col(lang_column).isNotNull() & F.col(id_column).isNotNull())
    total = {r[0]: r[1] for r in known.groupBy(lang_column).count().collect()}
    some = sampled(known, lang_column, {k: min(1.0, rows / n) for k, n in total.items()}, id_column)
    counted = (
        some.select(
            F.col(lang_column).alias("lang"),
            F.explode(F.regexp_extract_all(F.lower(text_column), F.lit(r"(\p{L}+)"), 1)).alias("word"),
        )
        .groupBy("lang", "word")
        .count()
    )
    # The sample is bounded, and so is what its languages' words add up to.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    kept = counted.withColumn("rank", rank).where(F.col("rank") <= words).select("lang", "word", F.col("count").cast("double"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[str, float]] = {}
        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts.setdefault(lang, {})[word] = n
        model = fit_pieces(vocabulary(vocabulary_path), counts)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.languages, model.pieces, model.log_p))], pa.binary())], names=["model"])

    # One task fits, as every round needs all words; the driver gets the probabilities alone.
    learned = kept.repartition(1).sortWithinPartitions("lang", "word").mapInArrow(fitted, "model binary").collect()
    return Model(*pickle.loads(learned[0]["model"])) if learned else fit_pieces(vocabulary(vocabulary_path), {})


RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def identify_language(model: Model, spark) -> Callable[[Column], Column]:
    """A column function from texts to (lang_pred, score); null texts and those without a letter are ``und`` with 0.

    Of an Arrow batch only a few texts at a time become Python strings.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            found: list[str] = []
            scores: list[np.ndarray] = [np.empty(0)]
            for at in range(0, len(texts), 256):
                lang, score = scorer.predict(texts.slice(at, 256).to_pylist())
                found += lang
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(np.concatenate(scores))], names=RESULT.names)

    return identify
