"""Long repeated passages, found by recompression and removed word by word.

A text's words are recompressed: each of ``LEVELS`` rounds names the maximal runs of
a symbol, then the pairs whose left symbol falls into the left half of the alphabet
and whose right one into the right half. A name is a hash of what it stands for, so
all tasks give equal names without a dictionary. With every symbol goes its context:
the words that settle, round by round, that it begins and ends where it does.
Equal passages have equal symbols wherever the context lies inside the passage.

A window of ``WINDOW`` words is known by one symbol whose context it holds: the highest
there is, the one with the smallest key among them. The key hashes the context's
words, so it is the same wherever the window occurs. Rounds on Spark follow:

1. Texts of equal words form a class; its smallest id stands for it.
2. Keys that more than one document holds reveal candidate windows; all other
   windows occur once. Windows without any settled symbol, as inside long runs, stay
   candidates.
3. Candidate windows are named exactly, by 128 bits; a window is repeated if a
   document with a smaller id holds its name. As equal windows have equal keys, neighbours
   of one key travel as one row to where all of their key are compared.
4. Texts that hold repeated windows lose the words these cover.

Windows without a key, and those of keys in more than ``HOT`` places, are dealt by their names
instead. The smallest document of such a name is found in two steps, first among ``SALTS``
shares of the documents, then among the shares' smallest, so that a name that a third
of all documents hold isn't one task's work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import forget, joined_apart, stored

WINDOW = 50
LEVELS = 3
BLOCK = 200_000  # windows of a text recompressed at once
CHUNK = 100_000  # words of several texts recompressed at once
PIECE = 1 << 20  # bytes of a text split at once
SALTS = 16
HOT = 1000  # places of a key that are compared in one task
PACK = 63  # windows in a row: their marks are bits of a long
SPACES = b" \t\n\v\f\r"

_rng = np.random.default_rng(20240412)
BASE = _rng.integers(0, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = _rng.integers(0, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPREAD = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _SPREAD[0]
    x = (x ^ (x >> np.uint64(27))) * _SPREAD[1]
    return x ^ (x >> np.uint64(31))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in SPACES:
            end += 1
        yield text[at:end].split()
        at = end


def hashes(parts: list[list[bytes]]) -> np.ndarray:
    """64-bit hashes of words."""
    each = [np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) for words in parts]
    return np.concatenate(each) if each else np.empty(0, np.uint64)


class Sums:
    """Hashes of word ranges, from running sums of a polynomial."""

    def __init__(self, words: np.ndarray, which: int) -> None:
        base = BASE[which]
        power = np.full(len(words) + 1, base, np.uint64)
        power[0] = 1
        self.back = np.full(len(words) + 1, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)
        self.back[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(self.back, out=self.back)
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum((mixed(words) if which else words) * power[:-1], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.back[start] + (end - start).astype(np.uint64))


def parse(words: np.ndarray, levels: int = LEVELS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols of each level, the words first: names, starts, ends, and contexts [low, high).

    A context that would reach beyond the words has its low end at -1 or its high end at their number + 1.
    """
    n = len(words)
    name, start = words.copy(), np.arange(n)
    low, high = start.copy(), start + 1
    outside = n + 1

    yield name, start, np.append(start[1:], n), low, high
    for level in range(levels):
        if not len(name):
            return
        # Runs: a symbol is settled by both neighbours, which show where the run ends.
        first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        after = np.append(first[1:], len(name))
        count = (after - first).astype(np.uint64)
        # The last symbol before and the first one behind a run; low - 1 and high + 1 reach over the text's edges.
        low, high = np.append(np.append(-1, low), n), np.append(np.append(0, high), outside)
        reach = [slice_of.reduceat(v[1:-1], first) for slice_of, v in ((np.minimum, low), (np.maximum, high))]
        low = np.minimum(reach[0], np.minimum(low[first], low[after + 1]))
        high = np.maximum(reach[1], np.maximum(high[first], high[after + 1]))
        name, start = np.where(count > 1, mixed(name[first] * STEP[0] + count * STEP[1]), name[first]), start[first]
        # Pairs: a left symbol is settled by what follows it, a right one by what precedes it.
        is_right = (mixed(name ^ STEP[2:3] * np.uint64(level + 1)) & np.uint64(1)).astype(bool)
        joins = np.append(~is_right[:-1] & is_right[1:], False)
        taken = np.append(False, joins[:-1])
        other = np.where(is_right, 0, 2) + np.arange(len(name))  # the neighbour's place, counted from the left edge
        low = np.minimum(low, np.append(np.append(-1, low), n)[other])
        high = np.maximum(high, np.append(np.append(0, high), outside)[other])
        at = np.flatnonzero(joins)
        name = name.copy()
        name[at] = mixed(name[at] * STEP[3] + mixed(name[at + 1]))
        keep = ~taken
        name, start, low, high = name[keep], start[keep], low[keep], high[keep]
        yield name, start, np.append(start[1:], n), low, high


def witnesses(words: np.ndarray, apart: np.ndarray | None = None, window: int = WINDOW, levels: int = LEVELS) -> np.ndarray:
    """The key of each window's witness, 0 without any.

    The witness of a window is a symbol of the highest level that has a context inside
    the window, that with the smallest key among them. ``apart`` marks words
    that stand between texts: a context with one of them is outside.
    """
    many = max(len(words) - window + 1, 0)
    witness, open_ = np.zeros(many, np.uint64), np.ones(many, bool)
    if not many:
        return witness
    sums = Sums(words, 0)
    between = np.append(0, np.cumsum(apart)) if apart is not None else np.zeros(len(words) + 1, np.int64)
    for _, _, _, low, high in reversed(list(parse(words, levels))[1:]):
        inside = (low >= 0) & (high <= len(words)) & (high - low <= window)
        low, high = low[inside], high[inside]
        inside = between[low] == between[high]
        low, high = low[inside], high[inside]
        least = smallest_over(sums.of(low, high), np.maximum(high - window, 0), np.minimum(low, many - 1), many)
        witness = np.where(open_, least, witness)
        open_ &= least == 0
        if not open_.any():
            break
    return witness


def spans_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one witness: the text's place, the key, the first and the last window."""
    out = []
    held: list[tuple[int, int, np.ndarray]] = []

    def flush() -> None:
        size = np.array([len(w) for _, _, w in held])
        words = np.concatenate([x for k, (_, _, w) in enumerate(held) for x in (w, mixed(np.array([k], np.uint64)))])
        start = np.append(0, np.cumsum(size + 1)[:-1])
        apart = np.zeros(len(words), bool)
        apart[start + size] = True
        witness = witnesses(words, apart)
        owner = np.repeat(np.arange(len(held)), size + 1)[: len(witness)]
        place = np.arange(len(witness)) - start[owner]
        real = np.flatnonzero(place <= size[owner] - WINDOW)
        if not len(real):
            return
        key, owner, place = witness[real].view(np.int64), owner[real], place[real]
        at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
        last = np.append(at[1:], len(real)) - 1
        text, base = np.array([t for t, _, _ in held])[owner], np.array([b for _, b, _ in held])[owner]
        out.append((text[at], key[at], (base + place)[at], (base + place)[last]))

    for number, own in enumerate(texts):
        for base, words in blocks(own):
            held.append((number, base, words))
            if sum(len(w) for _, _, w in held) >= CHUNK:
                flush()
                held = []
    if held:
        flush()
    none = np.empty(0, np.int64)
    return tuple(np.concatenate([o[k] for o in out]) if out else none for k in range(4))


def smallest_over(key: np.ndarray, first: np.ndarray, last: np.ndarray, many: int) -> np.ndarray:
    """For each place below ``many`` the smallest key of the ranges [first, last] that hold it, 0 without any.

    Each range is covered by two of a power of two's length; these are handed down to halves.
    """
    out = np.full(many, np.iinfo(np.uint64).max, np.uint64)
    fits = first <= last
    key, first, last = np.maximum(key[fits], 1), first[fits], last[fits]
    if not len(key):
        return np.zeros(many, np.uint64)
    power = np.floor(np.log2(last - first + 1)).astype(np.int64)
    held = None
    for p in range(int(power.max()), -1, -1):
        row = np.full(many, np.iinfo(np.uint64).max, np.uint64)
        here = power == p
        np.minimum.at(row, first[here], key[here])
        np.minimum.at(row, last[here] - (1 << p) + 1, key[here])
        if held is not None:
            row = np.minimum(row, held)
            row[1 << p :] = np.minimum(row[1 << p :], held[: -(1 << p)])
        held = row
    out = held
    return np.where(out == np.iinfo(np.uint64).max, np.uint64(0), out)


def blocks(words: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches of a text with all windows that start in them: contexts lie inside windows, so nothing else matters."""
    for at in range(0, max(len(words) - window + 1, 0), BLOCK):
        yield at, words[at : at + BLOCK + window - 1]


TEXT = "row long, doc_id long, print long, n_words long, d1 long, d2 long, kept_sha256 string, spans array<struct<key:long,first:int,last:int>>"


def _joined(parts: list[list[bytes]]) -> str:
    """Digest of all words joined by one space."""
    digest = hashlib.sha256()
    for k, words in enumerate(p for p in parts if p):
        digest.update((b" " if k else b"") + b" ".join(words))
    return digest.hexdigest()


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            plain, words = [], []
            for text in part.column(2).cast(pa.binary()):
                split = list(pieces(text.as_py() or b""))
                own = hashes(split)
                ends = np.array([0]), np.array([len(own)])
                sums = [int(Sums(own, k).of(*ends).view(np.int64)[0]) for k in (0, 1)] if len(own) else [0, 0]
                row += 1
                plain.append((row, len(own), *sums, _joined(split)))
                words.append(own)
            text, key, first, last = spans_of(words)
            flat = [pa.array(key, pa.int64()), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))]
            offsets = pa.array(np.searchsorted(text, np.arange(len(words) + 1)), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, names=["key", "first", "last"]))
            rows, *others = (pa.array(c) for c in zip(*plain, strict=True))
            yield pa.RecordBatch.from_arrays(
                [rows, part.column(0), part.column(1), *others, lists],
                names=["row", "doc_id", "print", "n_words", "d1", "d2", "kept_sha256", "spans"],
            )


NAMED = "row long, doc_id long, key long, loose boolean, first int, last int, w1 array<long>, w2 array<long>"


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the candidate windows of texts (row, doc_id, text, ranges with their keys).

    A row holds up to ``PACK`` neighbours of one key. Loose windows are a row each under a key made
    of their name; neighbours of one name, as inside a run of one word, share it.
    """
    for batch in batches:
        texts, ranges = batch.column(2).cast(pa.binary()), batch.column(3)
        for at in range(batch.num_rows):
            own = hashes(list(pieces(texts[at].as_py())))
            spans = ranges[at].values
            first, last, key = (spans.field(k).to_numpy().astype(np.int64) for k in ("first", "last", "key"))
            loose = spans.field("loose").to_numpy(zero_copy_only=False)
            order = np.argsort(first, kind="stable")
            first, last, key, loose = first[order], last[order], key[order], loose[order]
            for block, part in blocks(own):
                here = (first >= block) & (first < block + BLOCK)
                if not here.any():
                    continue
                sums = [Sums(part, k) for k in (0, 1)]
                for is_loose in (False, True):
                    mine = here & (loose == is_loose)
                    if not mine.any():
                        continue
                    size = (last - first + 1)[mine]
                    s = np.repeat(first[mine] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                    one, two = (x.of(s - block, s - block + WINDOW).view(np.int64) for x in sums)
                    if is_loose:
                        start = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (np.diff(s) > 1)))
                        end = np.append(start[1:], len(s)) - 1
                        keys, one, two, offsets = one[start], one[start], two[start], np.arange(len(start) + 1)
                    else:
                        place = np.arange(len(s)) - np.repeat(np.append(0, np.cumsum(size)[:-1]), size)
                        start = np.flatnonzero(place % PACK == 0)
                        end = np.append(start[1:], len(s)) - 1
                        keys, offsets = np.repeat(key[mine], size)[start], np.append(start, len(s))
                    same = [pa.array(np.full(len(start), batch.column(k)[at].as_py()), pa.int64()) for k in (0, 1)]
                    flags = pa.array(np.full(len(start), is_loose))
                    ends = [pa.array(s[e].astype(np.int32)) for e in (start, end)]
                    names = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(w)) for w in (one, two)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(keys), flags, *ends, *names], names=["row", "doc_id", "key", "loose", "first", "last", "w1", "w2"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of removed words and digests of kept ones, of texts (doc_id, print, text, ranges of windows).

    ``marks`` are bits for the windows from ``first``; without them all up to ``last`` are meant.
    """
    for batch in batches:
        texts, ranges = batch.column(2).cast(pa.binary()), batch.column(3)
        for at in range(batch.num_rows):
            parts = list(pieces(texts[at].as_py()))
            n = sum(map(len, parts))
            edge = np.zeros(n + 1, np.int64)
            own = ranges[at].values
            first, last = (own.field(k).to_numpy().astype(np.int64) for k in ("first", "last"))
            marks = own.field("marks").fill_null(0).to_numpy()
            packed, bit = np.nonzero(np.right_shift(marks[:, None], np.arange(PACK)) & 1)
            whole = marks == 0
            np.add.at(edge, np.append(first[packed] + bit, first[whole]), 1)
            np.add.at(edge, np.append(first[packed] + bit, last[whole]) + WINDOW, -1)
            keep = np.cumsum(edge[:n]) == 0
            ends = np.cumsum([len(p) for p in parts])
            left = [[w for w, k in zip(p, keep[e - len(p) : e].tolist(), strict=True) if k] for p, e in zip(parts, ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, 1), batch.column(1).slice(at, 1), pa.array([n - int(keep.sum())], pa.int64()), pa.array([_joined(left)])],
                names=["doc_id", "print", "n_removed", "sha"],
            )


def _repeated(named: DataFrame) -> DataFrame:
    """(row, first, last, marks) of the windows that a smaller document holds, too.

    All places of a key meet in one task, those of loose windows first within ``SALTS`` shares of
    the documents. Rows that find a smaller document there are done: they go on without what
    they were compared by, under their text's row, which spreads them. What is left of the loose
    ones is compared across the shares.
    """
    salt = F.when(F.col("loose"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int")
    met = named.withColumn("salt", salt).repartition("key", "salt")
    each = met.select("*", F.posexplode("w1").alias("at", "one")).withColumn("two", F.col("w2")[F.col("at")]).drop("w1", "w2")
    low = F.min("doc_id").over(Window.partitionBy("key", "salt", "one", "two"))
    bit = F.when(low < F.col("doc_id"), F.expr("shiftleft(1L, at)")).otherwise(0)
    found = each.withColumn("bit", bit).groupBy("key", "salt", "row", "doc_id", "loose", "first", "last")
    share = found.agg(F.bit_or("bit").alias("marks"), F.min("one").alias("one"), F.min("two").alias("two")).where("loose or marks <> 0")
    done = F.col("marks") != 0
    left = share.select(
        F.when(~done, F.col("row")).alias("row"), "first", "last", F.when(~F.col("loose"), F.col("marks")).alias("marks"),
        F.when(~done, F.col("doc_id")).alias("doc_id"), F.when(done, F.col("row")).otherwise(F.col("one")).alias("one"), F.when(~done, F.col("two")).alias("two"),
    )
    least = F.min("doc_id").over(Window.partitionBy("one", "two", F.isnull("doc_id")))
    above = left.withColumn("above", F.isnull("doc_id") | (least < F.col("doc_id"))).where("above")
    return above.select(F.coalesce("row", "one").alias("row"), "first", "last", "marks")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row: what is left once repeated passages are removed.

    A word goes if it is covered by a window of 50 words whose sequence also starts in a
    document with a smaller id, both judged on the input. Null texts have no words.
    Rows with a null id keep all their words and make nobody else lose any. Rows that
    share an id don't remove each other's words and each keep their row. Other
    columns are ignored; an empty table gives an empty result.
    """
    whole = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_column).alias("print"), F.col(text_column).cast("string").alias("text"))
    key, same = ["doc_id", "print"], ["d1", "d2", "n_words"]
    texts = stored(whole.mapInArrow(_parsed, TEXT), "parsed")
    slim = texts.drop("spans")
    own = slim.where(f"n_words >= {WINDOW} and doc_id is not null")
    first = stored(own.groupBy(*same).agg(F.count("*").alias("rows"), F.min("doc_id").alias("first")), "first")
    # Of texts with equal words only those with the smallest id are looked at, once each; the others lose everything.
    stand = stored(joined_apart(own, first, same).where("doc_id = first").groupBy(*key).agg(F.min("row").alias("row")), "stand")
    exploded = texts.select("row", "spans").join(stand.select("row", "doc_id"), "row").select("row", "doc_id", F.explode("spans").alias("s"))
    spans = stored(exploded.select("row", "doc_id", "s.*"), "spans")
    # Windows without a witness are candidates by themselves.
    alone = spans.where("key = 0").withColumn("loose", F.lit(True))
    marks = spans.where("key <> 0").groupBy("key").agg(F.count("*").alias("rows"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    several = stored(marks.where("low < high").select("key", "rows", (F.col("rows") > HOT).alias("loose")), "several")
    shared = joined_apart(spans.where("key <> 0"), several, ["key"]).unionByName(alone)
    ranges = shared.groupBy("row").agg(F.collect_list(F.struct("first", "last", "key", "loose")).alias("ranges"))
    candidates = whole.join(ranges.join(stand, "row"), key).dropDuplicates(key).select("row", "doc_id", "text", "ranges")
    repeated = _repeated(candidates.mapInArrow(_named, NAMED))
    gone = repeated.groupBy("row").agg(F.collect_list(F.struct("first", "last", "marks")).alias("ranges")).join(stand, "row")
    cut = stored(
        whole.join(gone, key).dropDuplicates(key).select(*key, "text", "ranges").mapInArrow(_removed, "doc_id long, print long, n_removed long, sha string"),
        "cut",
    )
    forget(stand, spans, several)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return joined_apart(slim, first, same, "left").join(cut, key, "left").select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, nothing).otherwise(F.coalesce("sha", "kept_sha256")).alias("kept_sha256"),
    )
