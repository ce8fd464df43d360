"""Alignment of two tokenizers' tokens by their byte spans.

A byte-level BPE (A) and a sentencepiece BPE with byte fallback (B) read the same
text. The libraries' own spans, character offsets of A and the spans of B's proto,
are coarse cuts: they are taken where a span starts at the last cut and is as long
as its token's decoded bytes. Elsewhere, inside characters of several bytes and
among byte-fallback tokens, the decoded bytes place the cut.

Neither tokenizer joins characters across a space or line break that follows a
character other than white space, so texts are cut there into chunks. A task
aligns each distinct chunk once; a text's tokens, groups and links are those of its
chunks in order. Links are kept as (A id, B id, number) per text in a table;
Spark counts the texts of each id pair, finds each A id's highest count, and joins
both back to the texts' links.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import stored

SPACE = "▁"
# Up to a character other than white space that a space or a line break follows.
CHUNK = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+")
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
CACHE = 400_000  # chunks held by a task; beyond it those seen once are forgotten
RUN, TEXTS = 50_000, 500_000  # characters of chunks encoded, and of texts looked at, at once
SIGNS = ";,|"  # before a group's first A token, before a further token, before its first B token
SHIFT = 1 << 20  # more than the ids of either vocabulary
PAIRS = 1_000_000  # id pairs that are sent to every executor; more are joined by a shuffle

ROW = "doc_id {id}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair:long,n:long>>"


def byte_level_bytes(entry: str) -> bytes:
    """Bytes of a byte-level vocabulary entry: printable bytes stand for themselves, others for 256, 257 and so on."""
    return bytes(_BYTE_OF[c] for c in entry)


_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _PRINTABLE}
_BYTE_OF |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def piece_bytes(piece: str) -> bytes:
    """Bytes of a sentencepiece piece; ``<0xHH>`` is a byte."""
    byte = BYTE.fullmatch(piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE, " ").encode()


def refined(begin: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from the libraries' spans and the sizes of their decoded bytes.

    A coarse cut lies between tokens whose spans meet there and are as long as their
    bytes. Among the tokens between two such cuts the bytes tell the ends.
    """
    fits = end - begin == size
    clean = np.append(fits[:-1] & fits[1:] & (end[:-1] == begin[1:]), False)
    total = np.cumsum(size)
    last = np.maximum.accumulate(np.where(clean, np.arange(len(end)), -1))
    base = np.where(last < 0, 0, end[last] - total[last])
    return np.where(clean, end, total + base)


class Aligner:
    """Tokens, groups and links of chunks, each distinct chunk aligned once while it is held."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one thread
        self.bytes = Tokenizer.from_file(byte_path)
        self.bytes.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        entries = {i: t for t, i in self.bytes.get_vocab().items()}
        self.a_raw = [byte_level_bytes(t) if all(c in _BYTE_OF for c in t) else t.encode() for t in (entries.get(i, "") for i in range(max(entries) + 1))]
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b_raw = [piece_bytes(p) for p in names]
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for i, p in enumerate(names) if not self.pieces.is_control(i)):
            raise ValueError("the vocabulary has pieces across the border of a chunk")
        self.a_size, self.b_size = (np.array([len(r) for r in raw]) for raw in (self.a_raw, self.b_raw))
        self.spelled = [sign + str(i) for i in range(max(len(self.a_raw), len(names))) for sign in SIGNS]
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers = np.empty((0, 5), np.int64)  # n_a, n_b, n_groups, n_links (-1: bytes differ), first link
        self.links = np.empty(0, np.int64)
        self.seen = np.empty(0, np.int64)

    def forget_rare(self) -> None:
        """Keep the chunks seen more than once, unless they are most of all."""
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) > CACHE // 2:
            self.forget()
            return
        names, numbers = list(self.place), self.numbers[keep]
        size = np.maximum(numbers[:, 3], 0)
        start = np.cumsum(size) - size
        links = self.links[np.arange(int(size.sum())) + np.repeat(numbers[:, 4] - start, size)]
        groups = [self.groups[i] for i in keep.tolist()]
        self.place = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.groups, self.links = groups, links
        self.numbers = np.column_stack([numbers[:, :4], start])
        self.seen = np.zeros(len(keep), np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Align new chunks. Chunks that end in white space end their text and are read alone."""
        runs: list[list[str]] = []
        size = RUN
        for c in chunks:
            if c[-1].isspace():
                runs.append([c])
                continue
            if size + len(c) > RUN:
                inner: list[str] = []
                runs.append(inner)
                size = 0
            inner.append(c)
            size += len(c)
        numbers, links = [self.numbers], [self.links]
        base = len(self.links)
        for run in runs:
            found = self.align(run)
            parts = [(run, found)] if found is not None else [([c], self.align([c])) for c in run]
            for own, got in parts:
                self.place.update(zip(own, range(len(self.groups), len(self.groups) + len(own)), strict=True))
                if got is None:
                    self.groups.append("")
                    numbers.append(np.array([[0, 0, 0, -1, 0]]))
                    continue
                texts, n, pairs = got
                self.groups += texts
                numbers.append(np.column_stack([n, base + np.append(0, np.cumsum(n[:, 3])[:-1])]))
                links.append(pairs)
                base += len(pairs)
        self.numbers, self.links = np.concatenate(numbers), np.concatenate(links)
        self.seen = np.append(self.seen, np.zeros(len(self.groups) - len(self.seen), np.int64))

    def align(self, run: list[str]) -> tuple[list[str], np.ndarray, np.ndarray] | None:
        """Groups as text and (n_a, n_b, n_groups, n_links) of each chunk, and all links in order.

        None where a tokenizer's bytes aren't those of the chunks. The run is read
        behind a word of its own, whose space B adds itself.
        """
        text = " x" + "".join(run)
        whole = text.encode()
        ours = self.bytes.encode(text, add_special_tokens=False)
        theirs = self.pieces.encode(text[1:], return_type="proto").pieces
        a_ids, b_ids = ours.ids, [p.id for p in theirs]
        if b"".join([self.a_raw[i] for i in a_ids]) != whole or b"".join([self.b_raw[i] for i in b_ids]) != whole:
            return None
        a, b = np.array(a_ids), np.array(b_ids)
        a_span = np.fromiter(chain.from_iterable(ours.offsets), np.int64, 2 * len(a)).reshape(-1, 2)
        if len(whole) != len(text):
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            a_span = np.append(0, np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)))[a_span]
        b_span = np.array([[p.begin for p in theirs], [p.end for p in theirs]]).T + 1
        b_span[0, 0] = 0  # the space that B adds
        a_end, b_end = refined(*a_span.T, self.a_size[a]), refined(*b_span.T, self.b_size[b])
        edge = np.cumsum([2, *(len(c) if c.isascii() else len(c.encode()) for c in run)])
        # Links: every stretch between two ends of either kind lies in one token of each.
        ends = np.union1d(a_end, b_end)
        pairs = a[np.searchsorted(a_end, ends)] * SHIFT + b[np.searchsorted(b_end, ends)]
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        cut = [np.searchsorted(e, edge, side="right") for e in (a_end, b_end, common, ends)]
        n = np.column_stack([np.diff(c) for c in cut])
        # Tokens in order of their groups, A's first, each behind its separator.
        group = [np.searchsorted(common, e) for e in (a_end, b_end)]
        lead = [np.append(True, g[1:] != g[:-1]) for g in group]
        signs = np.concatenate([np.where(lead[0], 0, 1), np.where(lead[1], 2, 1)])
        order = np.argsort(2 * np.concatenate(group) + np.repeat([0, 1], [len(a), len(b)]), kind="stable")
        spelled = self.spelled
        tokens = [spelled[k] for k in (np.concatenate([a, b]) * len(SIGNS) + signs)[order].tolist()]
        at = (cut[0] + cut[1]).tolist()
        texts = ["".join(tokens[lo:hi])[1:] for lo, hi in zip(at[:-1], at[1:], strict=True)]
        return texts, n, pairs[cut[3][0] :]

    def digests(self, texts: list[str | None]) -> list[tuple]:
        """n_a, n_b, n_groups, n_links, digest and links of each text; zeros where it has no tokens."""
        if len(self.place) > CACHE:
            self.forget_rare()
        split = [CHUNK.findall(" " + t) if t else [] for t in texts]
        missing = {c for chunks in split for c in chunks if c not in self.place}
        if missing:
            self.learn(sorted(missing))
        return [self._digest(chunks) for chunks in split]

    def _digest(self, chunks: list[str]) -> tuple:
        at = np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))
        each = self.numbers[at]
        np.add.at(self.seen, at, 1)
        if not len(at) or each[:, 3].min() < 0:
            return 0, 0, 0, 0, "", (np.empty(0, np.int64), np.empty(0, np.int64))
        n = each[:, :4].sum(axis=0)
        groups = self.groups
        digest = hashlib.sha256(";".join([groups[i] for i in at.tolist()]).encode()).hexdigest()
        size = each[:, 3]
        rows = np.arange(n[3]) + np.repeat(each[:, 4] - (np.cumsum(size) - size), size)
        return *n.tolist(), digest, np.unique(self.links[rows], return_counts=True)


def _portions(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in order, as many at once as their length allows."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size > TEXTS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _aligned(byte_path: str, piece_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_path, piece_path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            for texts in _portions(batch.column(1).to_pylist()):
                found = aligner.digests(texts)
                plain = [pa.array(c, pa.string() if k == 4 else pa.int64()) for k, c in enumerate(zip(*(f[:5] for f in found), strict=True))]
                links = [f[5] for f in found]
                offsets = pa.array(np.append(0, np.cumsum([len(p) for p, _ in links])), pa.int32())
                flat = [pa.array(np.concatenate([x[k] for x in links]), pa.int64()) for k in (0, 1)]
                pairs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, names=["pair", "n"]))
                rows = pa.array(np.arange(row, row + len(texts)), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), rows, *plain, pairs], names=NAMES)
                at, row = at + len(texts), row + len(texts)

    return run


NAMES = ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]


def align_tokenizers(
    docs: DataFrame,
    byte_path: str,
    piece_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    sent_pairs: int = PAIRS,
) -> tuple[DataFrame, DataFrame]:
    """A row for each text with its alignment, and a row for each id pair: a_id, b_id, docs, best.

    Texts are read by A with a space before them and by B, which adds one, without
    special tokens. Texts that are null or empty, or whose bytes a tokenizer doesn't
    give back (such as one with the vocabulary's space mark), have no tokens: zeros
    and an empty digest. Every row counts as a document, those with null or repeated ids too.
    The first table has doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair
    is in as many documents as any pair of their A id), count_sum (documents of
    their pair, over all links) and groups_sha256. Other columns are ignored; an
    empty table gives empty results. Both paths must exist on every executor.
    Up to ``sent_pairs`` id pairs are sent to all executors, counted first; more are shuffled.
    """
    kind = dict(docs.select(F.col(id_column).alias("doc_id")).dtypes)["doc_id"]
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    rows = stored(texts.mapInArrow(_aligned(byte_path, piece_path), ROW.format(id=kind)), "aligned")
    held = rows.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    a_id = F.expr(f"pair div {SHIFT}")
    highest = held.groupBy(a_id.alias("a_id")).agg(F.max("docs").alias("most"))
    pairs = stored(
        held.withColumn("a_id", a_id).join(highest, "a_id").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "pairs"
    )
    few = pairs.count() <= sent_pairs
    link = rows.select("row", F.explode("links").alias("l")).select("row", "l.pair", "l.n")
    sums = (
        link.join(F.broadcast(pairs) if few else pairs, "pair")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    )
    zero = F.lit(0).cast("long")
    result = rows.drop("links").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
    return result, pairs.select(a_id.alias("a_id"), (F.col("pair") % SHIFT).alias("b_id"), "docs", "best")
