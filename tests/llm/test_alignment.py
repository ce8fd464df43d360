import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from sieveline.llm import alignment
from sieveline.llm.alignment import CHUNK, Aligner, align_tokenizers, byte_level_bytes, piece_bytes, refined
from sieveline.session import ship_package

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, row int, pair int, links string"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    byte = Tokenizer.from_file(A)
    byte.encode_special_tokens = True
    return byte, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(libraries, rows):
    """Whole texts, every A token against every B token."""
    byte, piece = libraries
    found, docs = [], Counter()
    for _, text in rows:
        a = byte.encode(" " + text, add_special_tokens=False).ids if text else []
        b = piece.encode(text) if text else []
        spans = []
        for raw in ([byte_level_bytes(byte.id_to_token(i)) for i in a], [piece_bytes(piece.id_to_piece(i)) for i in b]):
            at, own = 0, []
            for r in raw:
                own.append((at, at + len(r)))
                at += len(r)
            spans.append((own, b"".join(raw)))
        if not text or any(raw != (" " + text).encode() for _, raw in spans):
            found.append(([], [], [], []))
            continue
        (x, _), (y, _) = spans
        cuts = {e for _, e in x} & {e for _, e in y}
        links = [(a[i], b[j]) for i, (s, e) in enumerate(x) for j, (t, f) in enumerate(y) if s < f and t < e]
        groups, group = [], ([], [])
        ends = sorted([(e, 0, a[i]) for i, (_, e) in enumerate(x)] + [(e, 1, b[j]) for j, (_, e) in enumerate(y)])
        for n, (e, side, token) in enumerate(ends):
            group[side].append(token)
            if e in cuts and (n + 1 == len(ends) or ends[n + 1][0] > e):
                groups.append(group)
                group = ([], [])
        found.append((a, b, groups, links))
        docs.update(set(links))
    best = defaultdict(int)
    for (i, _), n in docs.items():
        best[i] = max(best[i], n)
    out = []
    for (i, _), (a, b, groups, links) in zip(rows, found, strict=True):
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        n_best = sum(docs[p] == best[p[0]] for p in links)
        out.append((i, len(a), len(b), len(groups), len(links), n_best, sum(docs[p] for p in links), digest))
    return out, docs


def run(spark, rows, **more):
    ship_package()
    df = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], SCHEMA)
    got, pairs = align_tokenizers(df, A, B, **more)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, got.collect()), key=str), pairs.collect()


ODD = ["a", "é", "你", "😀", "👩‍👩‍👧", "▁", "\t", "\r\n", "\n", " ", "  ", "\x00", "\x1c", "\u0085", " ", " ", "　", "ﬁ", "é", "'s", "'re", "1", "23", "...", "<0x0A>", "<s>", "</s>", "<|endoftext|>", "Zürich", "naïve", "token", "The", "﻿", "\U0010ffff"]


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_alignment_equals_brute_force_on_whole_texts(spark, libraries, sent):
    rng = random.Random(sent)
    rows = [(i, "".join(rng.choice(ODD) for _ in range(rng.randrange(1, 25)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, " "), (503, "\n\n a"), (504, "same text here"), (504, "same text here"), (None, "same text here")]
    rows += [(505, "naïve 你好 " * 400), (506, "x" * 3000)]
    want, docs = brute(libraries, rows)
    got, pairs = run(spark, rows, sent_pairs=sent)
    assert got == sorted(want, key=str)
    assert {(p.a_id, p.b_id): p.docs for p in pairs} == dict(docs)
    assert sum(r[1] > 0 for r in got) > 250


def test_chunks_give_the_tokens_of_the_whole_text(libraries):
    byte, piece = libraries
    aligner = Aligner(A, B)
    rng = random.Random(9)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    aligner.digests(texts)
    for text in texts:
        assert CHUNK.findall(" " + text) == re.split(r"(?<=\S)(?=[ \n])", " " + text)
        at = [aligner.place[c] for c in CHUNK.findall(" " + text)]
        if aligner.numbers[at, 3].min() < 0:
            assert "▁" in text or b"".join(piece_bytes(piece.id_to_piece(i)) for i in piece.encode(text)) != (" " + text).encode()
            continue
        ids = [g.split("|") for k in at for g in aligner.groups[k].split(";")]
        assert [int(t) for g, _ in ids for t in g.split(",")] == byte.encode(" " + text, add_special_tokens=False).ids
        assert [int(t) for _, g in ids for t in g.split(",")] == piece.encode(text)


def test_rare_chunks_are_forgotten_and_nothing_changes(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE", 40)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "of", "naïve", "你好", f"w{rng.randrange(10**6)}", "a▁b"]) for _ in range(rng.randrange(1, 30))) for _ in range(120)]
    small, large = Aligner(A, B), Aligner(A, B)
    monkeypatch.setattr(small, "forget_rare", lambda own=small.forget_rare: kept.append(own()))
    kept = []
    got = [r for t in texts for r in small.digests([t])]
    monkeypatch.setattr(alignment, "CACHE", 10**9)
    for mine, theirs in zip(got, large.digests(texts), strict=True):
        assert mine[:5] == theirs[:5] and all((x == y).all() for x, y in zip(mine[5], theirs[5], strict=True))
    assert len(kept) > 3


def test_coarse_spans_are_refined_inside_characters():
    def ends(spans, raw):
        begin, end = np.array(spans).T
        return refined(begin, end, np.array([len(r) for r in raw])).tolist()

    # Three tokens of one character that all carry its span, between tokens whose spans are exact.
    assert ends([(0, 1), (1, 2), (2, 6), (2, 6), (2, 6), (6, 8)], [b"x", b"y", b"\xf0\x9f", b"\x98", b"\x80", b"ab"]) == [1, 2, 4, 5, 6, 8]
    assert ends([(0, 0), (0, 3), (3, 4), (4, 5)], [b"\xe4", b"\xbd\xa0", b" ", b"z"]) == [1, 3, 4, 5]


def test_no_rows(spark):
    assert run(spark, []) == ([], [])
