"""Language identification and toxicity: method, odd rows, held-out accuracy."""

import itertools
import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import zstandard
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from sieveline.llm import langid, toxicity
from sieveline.llm.queries import op1_compression_toxicity, op3_unigram_language
from sieveline.session import ship_package

SF = "/root/testdata/sf0.01"


def brute_score(pieces, p, word):
    """Sum over all segmentations, by enumeration."""
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, start = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                parts.append(word[start:i])
                start = i
        parts.append(word[start:])
        x = 1.0
        for part in parts:
            x *= p[pieces.index(part)] if part in pieces else (p[-1] if len(part) == 1 else 0.0)
        total += x
    return np.log(total)


def test_forward_pass_sums_all_segmentations():
    pieces = sorted(["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "bab"])
    rng = np.random.default_rng(4)
    p = rng.random((len(pieces) + 1, 2))
    trie = langid.Trie(pieces)
    words = ["a", "abab", "babab", "axb", "x", "aababx"]
    got = langid.word_scores(trie, words, np.log(p))
    for w, row in zip(words, got, strict=True):
        for k in range(2):
            assert np.isclose(row[k], brute_score(pieces, p[:, k], "▁" + w))
            assert np.isclose(langid._long_word(trie, "▁" + w, p)[k], row[k])


def test_long_words_are_whole():
    model = langid.fit_pieces(langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model")), {"x": {"abc": 3.0}, "y": {"xyz": 3.0}})
    found, score = langid.Scorer(model).predict(["abc " * 3 + "xyz" * 20_000, "abc", None, "", "12 !", "ABC"])
    assert found == ["y", "x", "und", "und", "und", "x"] and score[2] == score[4] == 0


def test_digits_and_signs_that_are_no_letters_are_undetermined():
    model = langid.fit_pieces(["▁", "a", "b"], {"x": {"ab": 3.0}})
    assert langid.Scorer(model).predict(["²", "½ ①", "_", "a²"])[0] == ["und", "und", "und", "x"]


def test_language_query_on_held_out_rows(spark):
    ship_package()
    out = op3_unigram_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(out) == 1000 and (held.lang_pred == held.lang).mean() > 0.97 and out.score.between(0, 1).all()


def test_language_model_without_rows_and_with_odd_rows(spark):
    ship_package()
    path = public_tokenizers.path("piece_bpe_32k.model")
    schema = "doc_id long, text string, lang string, word string, count int, found string"
    rows = [(1, "der die das und", "de", "w", 1, "f"), (2, None, "de", None, None, None), (3, "the and of", None, "", 0, ""), (None, "x", "fr", "", 0, ""), (4, "the of and", "en", "", 0, ""), (4, "the of and", "en", "", 0, "")]
    docs = spark.createDataFrame(rows, schema)
    model = langid.fit_languages(docs, path)
    assert model.languages == ["de", "en"]
    got = docs.select(langid.identify_language(model, spark)(F.col("text")).alias("f")).select("f.*").collect()
    assert [r.lang_pred for r in got][:3] == ["de", "und", "en"]
    empty = langid.fit_languages(docs.limit(0), path)
    assert [r[0].lang_pred for r in docs.select(langid.identify_language(empty, spark)(F.col("text"))).collect()] == ["und"] * 6


def test_toxic_dictionary_shortens_toxic_windows():
    rng = random.Random(1)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(500)]
    bad = ["grumblefix", "snortwhack", "blatherskite"]
    rows = []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(60)]
        if i % 4 == 0:
            words[rng.randrange(60)] = rng.choice(bad)
        rows.append((" ".join(words), int(i % 4 == 0)))
    model = toxicity.fit(rows)
    gains = toxicity.Gains(model.dictionaries)
    assert all(gains.ordinary(w.encode()) > gains.toxic(w.encode()) for w in bad)

    def score(text):
        return 1 / (1 + np.exp(-gains.features(toxicity.windows(text)) @ model.weights))

    fresh = [" ".join(rng.choice(plain) for _ in range(60)) for _ in range(50)]
    assert np.mean([score(t) < 0.7 for t in fresh]) > 0.95
    assert np.mean([score(t + " " + rng.choice(bad)) >= 0.7 for t in fresh]) > 0.95


def test_characteristic_windows_are_not_counted_but_tested():
    rng = random.Random(2)
    common = [b"w%d" % i for i in range(20_000)]
    clear = [b"t%d" % i for i in range(400)]
    toxic, ordinary = Counter(), Counter()
    for i in range(6000):
        words = set(rng.sample(common, 40)) | ({rng.choice(clear) for _ in range(15)} if i % 3 == 0 else set())
        (toxic if i % 3 == 0 else ordinary).update(words)
    found = toxicity.characteristic(toxic, ordinary, 2000, 4000)
    assert set(clear) <= set(found) and len(set(found) - set(clear)) <= 3


def test_scores_equal_plain_compression_without_a_cache(spark):
    rows = [(("grumblefix " if i % 3 == 0 else "") + " ".join(f"w{(i * k) % 97}" for k in range(1, 30)), int(i % 3 == 0)) for i in range(200)]
    model = toxicity.fit(rows)
    settings = zstandard.ZstdCompressionParameters(**toxicity.SETTINGS)
    held = [zstandard.ZstdCompressionDict(d) for d in model.dictionaries]

    def plain(text):
        counts = [0] * (toxicity.LEVELS + 1)
        for w in toxicity.windows(text):
            sizes = [len(zstandard.ZstdCompressor(dict_data=h, compression_params=settings).compress(toxicity.FRAME + b" " + w + b" ")) for h in held]
            counts[min(max(sizes[0] - sizes[1], 0), toxicity.LEVELS)] += 1
        x = [1.0, *(np.log1p(sum(counts[k:])) for k in range(1, toxicity.LEVELS + 1)), np.log1p(sum(counts))]
        return 1 / (1 + np.exp(-np.clip(np.dot(x, model.weights), -30, 30)))

    gains = toxicity.Gains(model.dictionaries)
    for text, _ in rows[:6] + [("", 0), ("new words here", 0)]:
        x = gains.features(toxicity.windows(text)) @ model.weights
        assert np.isclose(1 / (1 + np.exp(-np.clip(x, -30, 30))), plain(text))


def test_toxicity_of_odd_rows(spark):
    ship_package()
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "x", 3), (3, "y " * 100_000 + "z" * 200_000, 4)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (3, 0, 0), (3, 5, 0)], "doc_id long, toxic int, text int")
    for given in (labels, labels.limit(0)):
        model = toxicity.fit_toxicity(docs, given)
        got = docs.select(toxicity.toxicity(model, spark)(F.col("text")).alias("s")).collect()
        assert len(got) == 4 and all(0 <= r.s <= 1 for r in got)
    assert max(r.s for r in got) < 0.01


def test_toxicity_query_on_held_out_rows(spark):
    ship_package()
    out = op1_compression_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id", "left").toPandas()
    held = out[out.held_out & out.toxic.notna()]
    ranks = held.score.rank()
    n = held.toxic.sum()
    auc = (ranks[held.toxic == 1].sum() - n * (n + 1) / 2) / (n * (len(held) - n))
    assert len(out) == 1000 and auc > 0.85 and (held.toxic[held.predicted == 1] == 1).mean() > 0.8


def _peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_fits_hold_each_word_once():
    rng = random.Random(6)
    words = [f"word{i}" for i in range(2000)]
    rows = [(" ".join(rng.sample(words, 1000)), i % 2) for i in range(300)]
    assert _peak(lambda: toxicity.fit(iter(rows))) < 8_000_000  # 300,000 words in all, 2,000 distinct

    letters = "abcdefgh"
    pieces = sorted({"▁", *letters, *(a + b for a in letters for b in letters), *("▁" + a for a in letters)})
    counts = {lang: {"".join(rng.choice(letters) for _ in range(20)): 1.0 for _ in range(5000)} for lang in "xyz"}
    assert _peak(lambda: langid.fit_pieces(pieces, counts)) < 26_000_000


def test_scores_read_arrow_batches(spark):
    ship_package()
    docs = spark.createDataFrame([("the and of",)], "text string")
    model = langid.fit_pieces(["▁", "a", "b"], {"x": {"ab": 3.0}})
    for score in (langid.identify_language(model, spark), toxicity.toxicity(toxicity.fit([]), spark)):
        assert score.evalType == PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF
        assert docs.select(score(F.col("text"))).count() == 1
