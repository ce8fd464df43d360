"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text: both hold the same base,
trained on ordinary windows; one ends in windows characteristic of toxic texts,
the other in as much ordinary text. A window is a word with its spaces. Toxic
windows become shorter under the toxic dictionary; ordinary ones don't. Both
dictionaries end in a fixed frame that is put before every window, as
zstandard stores inputs of a few bytes uncompressed otherwise.

A text's score comes from how many of its distinct windows gain at least 1 to
``LEVELS`` bytes: a logistic calibration of these counts, fitted out of fold on
the labelled sample, gives the probability of the toxic label.
"""

from __future__ import annotations

import math
import pickle
import random
import zlib
from collections import Counter
from collections.abc import Callable, Collection, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import sampled

THRESHOLD = 0.7
#: Labelled rows that are learned from, in expectation: the model is fitted on a bounded sample.
TOXIC_ROWS, ORDINARY_ROWS = 2000, 3000
FOLDS = 3
LEVELS = 7
BASE_BYTES = 65536
#: A window is characteristic if it is this often more frequent in toxic texts, and so clearly that of
#: all windows tested fewer than ``FALSE_FINDS`` are expected to look like that by chance.
MIN_LIFT, FALSE_FINDS = 8.0, 1.0
#: Ordinary windows that the common base is trained on, drawn at random, each at most so often.
BASE_SAMPLES, REPEATS = 200_000, 20
CACHE = 250_000
FRAME = bytes(random.Random(5).randrange(128, 256) for _ in range(64))
SETTINGS = {
    "window_log": 17, "hash_log": 16, "chain_log": 16, "search_log": 6, "min_match": 5, "target_length": 64,
    "strategy": zstandard.STRATEGY_BTOPT, "write_content_size": False, "write_dict_id": False, "write_checksum": False,
}


def windows(text: str | None) -> set[bytes]:
    """The distinct words of a text, lower-cased for A-Z."""
    return set(text.encode("utf-8", "replace").lower().split()) if text else set()


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary of up to ``size`` bytes; the samples' own end where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b" "


def characteristic(toxic: Counter, ordinary: Counter, n_toxic: int, n_ordinary: int) -> list[bytes]:
    """Windows that tell toxic texts from ordinary ones, the clearest first.

    Of the texts with a window at least as many are toxic as seen with a binomial
    probability; it has to be below ``FALSE_FINDS`` over the number of windows tested.
    """
    total = n_toxic + n_ordinary
    hit, miss = math.log(n_toxic / total), math.log(n_ordinary / total)
    found = []
    for w, k in toxic.items():
        n = k + ordinary[w]
        if k / n_toxic <= MIN_LIFT * (n - k + 0.5) / n_ordinary:
            continue
        each = (math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * hit + (n - j) * miss for j in range(k, n + 1))
        chance = sum(map(math.exp, each))
        if chance * len(toxic) < FALSE_FINDS:
            found.append((chance, w))
    return [w for _, w in sorted(found)]


def train_dictionaries(texts: Iterable[tuple[Collection[bytes], int]]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary from (distinct windows, label) pairs."""
    toxic, ordinary, n = Counter(), Counter(), [0, 0]
    for found, label in texts:
        n[label] += 1
        (toxic if label else ordinary).update(found)
    clear = characteristic(toxic, ordinary, max(n[1], 1), max(n[0], 1))
    known = set(clear)
    rng = random.Random(1)
    samples = []
    for w in sorted(ordinary):
        if ordinary[w] > 1 and w not in known:
            samples += [b" " + w + b" "] * min(ordinary[w], REPEATS)
    rng.shuffle(samples)
    base = _trained(BASE_BYTES, samples[:BASE_SAMPLES])
    ours = b"".join(b" " + w for w in reversed(clear))  # the clearest last, where matches are cheapest
    theirs = _trained(max(len(ours), 256), samples[: BASE_SAMPLES // 2])[-max(len(ours), 1) :]
    return base + theirs + FRAME, base + ours + FRAME


def _compressed(dictionary: bytes) -> Callable[[bytes], int]:
    settings = zstandard.ZstdCompressionParameters(**SETTINGS)
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(compression_params=settings)
    compressor = zstandard.ZstdCompressor(dict_data=held, compression_params=settings)
    return lambda window: len(compressor.compress(FRAME + b" " + window + b" "))


class Gains:
    """Counts of a text's windows by the bytes that the toxic dictionary saves.

    Gains are held in two bounded generations: windows met again move to the younger
    one, and the older one is dropped when the younger is full.
    """

    def __init__(self, dictionaries: tuple[bytes, bytes]) -> None:
        self.ordinary, self.toxic = map(_compressed, dictionaries)
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    def features(self, found: Collection[bytes]) -> np.ndarray:
        if len(self.known) > CACHE // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        for w in found:
            if w not in known:
                gain = older.get(w)
                known[w] = min(max(self.ordinary(w) - self.toxic(w), 0), LEVELS) if gain is None else gain
        counts = np.bincount(np.fromiter(map(known.__getitem__, found), np.int64, len(found)), minlength=LEVELS + 1)
        at_least = counts[::-1].cumsum()[::-1][1:]
        return np.concatenate([[1.0], np.log1p(at_least), [np.log1p(len(found))]])


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[0, 0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class Model:
    dictionaries: tuple[bytes, bytes]
    weights: np.ndarray


def fit(rows: Iterable[tuple[str | None, int]]) -> Model:
    """Dictionaries on all rows, the calibration on gains under dictionaries that haven't seen the row.

    Of a text only the numbers of its distinct windows are held; each window is held once.
    """
    number: dict[bytes, int] = {}
    held, labels, fold = [], [], []
    for t, label in rows:
        found = windows(t)
        held.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
        labels.append(int(label))
        fold.append(zlib.crc32(repr(sorted(found)[:50]).encode()) % FOLDS)  # copies share a fold
    named = list(number)
    del number
    texts = lambda apart=None: (([named[i] for i in n.tolist()], label) for n, label, k in zip(held, labels, fold, strict=True) if k != apart)
    x = np.zeros((len(held), LEVELS + 2))
    for f in range(FOLDS):
        if f in fold:
            gains = Gains(train_dictionaries(texts(f)))
            for i, n in enumerate(held):
                if fold[i] == f:
                    x[i] = gains.features([named[w] for w in n.tolist()])
            del gains
    y = np.array(labels, float)
    weights = calibrate(x, y) if held else np.r_[-30.0, np.zeros(LEVELS + 1)]
    return Model(train_dictionaries(texts()), weights)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    toxic_rows: int = TOXIC_ROWS,
    ordinary_rows: int = ORDINARY_ROWS,
) -> Model:
    """Fit on about ``toxic_rows`` and ``ordinary_rows`` whole texts with a label of 1 and 0.

    Null ids and labels other than 0 and 1 teach nothing; an id labelled twice
    counts as toxic if any of its labels is. Without labels every score is near 0.
    """
    known = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(
        F.max(F.col(label_column).cast("int")).alias("label")
    )
    total = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    rates = {k: min(1.0, (toxic_rows if k else ordinary_rows) / n) for k, n in total.items()}
    some = sampled(known, "label", rates, "id")
    # At most toxic_rows + ordinary_rows ids, in expectation, are sent to the executors.
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(some), "id")
    # One task learns, as a window's count over all texts decides; it reads them one by one.
    learned = rows.select("text", "label").repartition(1).sortWithinPartitions("label", "text").mapInArrow(_fitted, "model binary").collect()
    return Model(*pickle.loads(learned[0]["model"])) if learned else fit([])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((t.as_py(), n.as_py()) for b in batches for t, n in zip(b.column(0), b.column(1), strict=True))
    model = fit(rows)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.dictionaries, model.weights))], pa.binary())], names=["model"])


def toxicity(model: Model, spark) -> Callable:
    """A column function from texts to scores between 0 and 1; null and empty texts get the score of no windows."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gains = Gains(shared.value.dictionaries)
        for texts in batches:
            # Of an Arrow batch one text at a time becomes a Python string.
            x = [gains.features(windows(t.as_py())) @ shared.value.weights for t in texts]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(x, float), -30, 30))))

    return score
