"""Licenses, token counts, main text, decontamination: odd rows, brute force, planted cases."""

import random
import re
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sieveline.llm import decontam, html, licenses
from sieveline.llm.tokencount import Counter, count_tokens, load
from sieveline.session import ship_package

TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, n_words int, score string, item_id int, url int"


def docs(spark, *rows):
    ship_package()
    return spark.createDataFrame([(i, t, 1, "s", 2, 3) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "x y"), (4, "same"), (4, "same"), (5, "é" * 3000 + " word" * 60_000)]


def brute_licenses(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for i in range(len(words)) for phrase, label in licenses.BASE.items() if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_places_equal_brute_force(spark):
    texts = [
        "Under the MIT-License, under the mit license under the\nMIT license", "x CC BY NC cc by nc sa 4.0", "apache license, version 2.0", "Apache License Version 20",
        "under the ëmit license", "under\x00the\x7fmit_license", "the mit licenses", "İcc by nc", "ccc by nc",
    ]
    rows = ODD + [(100 + i, t) for i, t in enumerate(texts)]
    got = licenses.scan_licenses(docs(spark, *rows)).collect()
    assert sorted((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels).__repr__() for r in got) == sorted(repr(brute_licenses(t)) for _, t in rows)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licenses.scan_licenses(docs(spark)).collect() == []


def test_license_rules_priority_and_containment():
    assert len(licenses.rules()) > 300
    for rule in licenses.rules():
        assert " " not in rule.keyword and re.compile(rule.pattern)
    labels = lambda t: [r.label for _, _, r in licenses.detect(t.encode())["detections"]]
    assert labels("Licensed under CC BY-NC-SA 4.0.") == ["cc-by-nc-sa-4.0"] or "cc-by-nc-sa-4.0" in labels("Licensed under CC BY-NC-SA 4.0.")
    assert labels("GNU General Public License, version 3 or later") == ["gpl-3-or-later"]
    assert labels("SPDX-License-Identifier: MPL-2.0") == ["mpl-2.0"]
    assert labels("BSD 3-Clause License") == ["bsd-3-clause"]
    assert labels("plain prose about a general and a public house") == []


def test_license_spellings():
    labels = lambda t: [r.label for _, _, r in licenses.detect(t.encode())["detections"]]
    want = {
        "GPLv2": "gpl-2", "GNU GPL3": "gpl-3", "LGPLv2.1+": "lgpl-2.1", "AGPLv3 or later": "agpl-3-or-later", "GPL 2 or any later": "gpl-2-or-later",
        "GNU General Public License version 2 or (at your option) any later version": "gpl-2-or-later",
        "the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version": "gpl-3-or-later",
    }
    identifiers = "MIT ISC Zlib Unlicense NCSA BSD-2-Clause BSD-3-Clause Apache-2.0 MPL-2.0 EPL-1.0 CC-BY-SA-4.0 CC0-1.0".split()
    want |= {f"SPDX-License-Identifier: {i}": i.lower() for i in identifiers}
    want |= {"SPDX-License-Identifier: GPL-2.0-only": "gpl-2", "SPDX-License-Identifier: LGPL-3.0-or-later": "lgpl-3-or-later"}
    assert {t: labels(t) for t in want} == {t: [label] for t, label in want.items()}


def test_resolving_equals_comparing_all_pairs():
    rng = random.Random(1)
    for _ in range(2000):
        found = [(s, s + rng.randrange(1, 9), licenses.Rule(rng.choice("abc"), rng.randrange(4), "k", "p")) for s in (rng.randrange(30) for _ in range(rng.randrange(25)))]
        kept = []
        for start, end, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label)):
            if not any(s <= start and end <= e for s, e, _ in kept):
                kept.append((start, end, rule))
        assert licenses.resolve(found) == sorted(kept, key=lambda d: d[:2])
    assert len(licenses.detect(b"mit license " * 50_000)["detections"]) == 50_000


def test_every_keyword_is_in_its_matches():
    """A rule's keyword gates it, so each name must contain the keyword as a word."""
    for rule in licenses.rules():
        plain = re.sub(r"licen\[cs\]e", "license", rule.pattern)
        assert rule.keyword in re.findall(r"[a-z0-9]+", plain), rule


def test_token_counts_equal_the_library(spark):
    texts = ["Hello world", "  two  spaces ", "a\nb\n\n c", "</s><s> [INST]", "▁a ▁", "日本語 😀\ttab\r\n", "x" * 5000, "a " * 4000]
    rows = ODD + [(100 + i, t) for i, t in enumerate(texts)]
    model = load(TOKENIZER)
    got = count_tokens(docs(spark, *rows), TOKENIZER).collect()
    want = [(len((t or "").encode()), len(n := model.encode(t or "")), len(n) > 4096) for _, t in rows]
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(want)
    assert count_tokens(docs(spark), TOKENIZER).collect() == []


def test_pretokens_of_all_documents_equal_the_library(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    counter = Counter(TOKENIZER)
    assert counter.exact and counter.count(texts) == [len(i) for i in counter.model.encode(texts)]


PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body class="has-sidebar"><header><h1>Site</h1><nav><a href=/>Home</a></nav></header>
<div class="cookie-notice"><p>We use cookies, many cookies, all the time, everywhere.</p></div>
<div id="main-content"><article><h2>A &amp; B</h2>{body}<ul class="related"><li><a>one</a><li><a>two</a></ul>
<section id="comments"><p>First, a comment, of some length, with commas, and more, and more.</p></section></article></div>
<div class="sidebar"><p>Side, side, side, side.</p></div><form><p>Write, to, us</p></form><footer><p>Foot</p></footer></body></html>"""


def test_main_text_of_a_full_page():
    body = "<p>First  paragraph,\nwith <b>bold</b> words.<p>Second &lt;one&gt;, unclosed<br>line<script>x='</p>'</script><ul><li>item a<li>item b</ul>"
    assert html.main_text(PAGE.format(body=body)) == "A & B First paragraph, with bold words. Second <one>, unclosed line item a item b"


@pytest.mark.parametrize(
    ("page", "text"),
    [(None, ""), ("", ""), ("<p>", ""), ("just text", "just text"), ("<nav><p>menu, menu</p></nav>", ""), ("<div>" * 3000 + "<p>deep", "deep"), ("<p>a < b, c</p><!-- x -->", "a < b, c"), ("<p>" + "w, " * 100_000, ("w, " * 100_000).strip())],
)
def test_main_text_of_odd_pages(page, text):
    assert html.main_text(page) == text


def test_articles_in_parts_titles_outside_and_text_without_paragraphs():
    parts = "<div id=c><div><p>part one, a, b, c.</p></div><div><p>part two, a, b, c.</p></div></div><div class=ad><p>buy, now, please</p></div>"
    assert html.main_text(parts) == "part one, a, b, c. part two, a, b, c."
    titled = "<main><h1>Title</h1><div class=body><p>one, two, three, long enough text.</p></div><div class='alert'>x, y</div></main>"
    assert html.main_text(titled) == "Title one, two, three, long enough text."
    assert html.main_text("<div><span>in a span, long enough, yes.</span><br>next</div><div class=footer>f, f</div>") == "in a span, long enough, yes. next"


def test_short_parts_of_an_article_are_kept():
    part = "<p>" + "many words of it, and more, and more, " * 8 + "</p>"
    text = ("many words of it, and more, and more, " * 8).strip()
    long = " ".join([text] * 20)
    assert html.main_text(f"<body><article><section>{part * 20}</section><section>{part}</section></article></body>") == f"{long} {text}"
    rest = "<h2>Short head</h2><p>Short line.</p><ul><li>an item</li></ul><table><tr><td>a cell</td></tr></table><blockquote>said</blockquote>"
    whole = f"A lead. {long} Short head Short line. an item a cell said"
    links = "<div><a href=/a>more of this</a><a href=/b>more of that</a></div>"
    for name in ("article", "main", "div"):
        beside = "" if name == "article" else links
        assert html.main_text(f"<body><{name}><div>A lead.</div><div>{part * 20}</div>{rest}{beside}<nav>menu</nav></{name}><div>{links}</div></body>") == whole
    assert html.main_text(f"<body><article><div><section>{part * 20}</section></div><div>End.</div></article><p>Foot</p></body>") == f"{long} End."


def test_articles_in_unlucky_classes_are_kept():
    part = "<p>" + "many words of it, and more, and more, " * 4 + "</p>"
    text = ("many words of it, and more, and more, " * 4).strip()
    menu = "<div class=menu><a href=/a>one</a> <a href=/b>two</a></div><div class=comments><p>I say, so, too, as ever.</p></div>"
    for name in ("post feedback", "overlay", "survey", "story-discussion", "announcement", "widget-text", "content-related"):
        assert html.main_text(f"<body>{menu}<div class='{name}'>{part * 5}</div></body>") == " ".join([text] * 5)
        beside = f"<body><article>{part * 5}<div class='{name}'><p>Short, so, cut.</p></div></article></body>"
        assert html.main_text(beside) == " ".join([text] * 5)
    assert html.main_text(f"<body><div class=comments>{part * 9}</div><div id=x>{part}</div></body>") == text


def test_open_quotes_lose_their_tag_alone():
    assert html.main_text('<article><p class="x>one, two, three.</p><p title="a > b" class=\'y\'>four <a href="z">five</a></p></article>') == "one, two, three. four five"


def test_deep_lists_and_long_pages_take_linear_time():
    seconds = []
    for n in (4000, 16_000):
        start = time.process_time()
        assert len(html.main_text("<body><div>" + "<ul><li>some, text " * n)) > 10 * n
        seconds.append(time.process_time() - start)
    assert seconds[1] < 8 * seconds[0] + 0.5
    assert len(html.main_text("<article>" + "<p>a long page, with, commas and <b>words</b>.</p>" * 25_000 + "</article>")) > 900_000


def test_pages_equal_the_articles_they_were_made_of(spark):
    from html import unescape

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (re.sub(r"\s+", " ", unescape(re.sub(r"</?b>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", article))
        assert html.main_text(r.html) == " ".join(b for b in blocks if b)


def test_extract_keeps_every_row(spark):
    ship_package()
    schema = "page_id long, url string, html string, text int, n_chars string"
    rows = [(1, "u", "<p>a b</p>", 5, "x"), (1, "u", "<p>a b</p>", 5, "x"), (None, None, None, None, None)]
    got = html.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in got if r.url) + [1] == [(1, "u", "a b", 3)] * 2 + [1]
    assert [(r.text, r.n_chars) for r in got if r.url is None] == [("", 0)]
    assert html.extract(spark.createDataFrame([], schema)).collect() == []


ITEM = "Last week the farmer Anna sold 12 baskets of red apples and 5 kg of ripe plums to her neighbour while 12 crates stayed behind in the cold barn"


def leaks(spark, *rows, items=((7, ITEM), (8, None), (None, ITEM), (9, "short one here"))):
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    out = decontam.contaminated(docs(spark, *rows), bench).collect()
    return {(r.doc_id, r.item_id): r for r in out}


def test_exchanged_numbers_names_and_units_are_found(spark):
    other = ITEM.replace("Anna", "Boris").replace("12", "30").replace("5 kg", "7 pounds")
    clash = ITEM.replace("12 baskets", "30 baskets")
    got = leaks(
        spark, (1, f"Before. {ITEM}. After."), (2, f"Before. {other}. After."), (3, f"Well, {clash}."), (4, "Nothing of the kind, really nothing, at all, ever, in here, 12 kg."),
        (5, ITEM.upper()), (6, " ".join(ITEM.split()[:9])), (7, "short one here"), (8, "short one here indeed"), (None, ITEM), (10, None), (11, ""),
    )
    assert (1, 7) in got and (2, 7) in got and got[2, 7].n_slots >= 4
    assert (3, 7) in got  # the item repeats 12, the document has 30 and 12 in these places: most of it is word for word
    assert not {i for i, _ in got} & {4, 6, 8, 10, 11, None}
    assert (7, 9) in got


def test_nothing_to_find(spark):
    assert leaks(spark) == {}
    assert leaks(spark, (1, ITEM), items=[(7, "")]) == {}
    kept = decontam.decontaminated(docs(spark, (1, ITEM), (2, "other"), (None, ITEM)), spark.createDataFrame([(7, ITEM)], "item_id long, text string"))
    assert sorted((r.doc_id or 0, r.url) for r in kept.collect()) == [(0, 3), (2, 3)]


def test_decontamination_runs_no_python(spark):
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    plan = decontam.contaminated(docs(spark, (1, ITEM)), bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def kept_ids(spark, bench, *rows):
    items = spark.createDataFrame([(7 + i, t) for i, t in enumerate(bench)], "item_id long, text string")
    return {r.doc_id for r in decontam.decontaminated(docs(spark, *rows), items).collect()}


CHANCE = "Every boy in the class had picked 2 apples from the tall tree and walked for 2 hours along the dusty road"


def test_one_slot_does_not_clear_a_copy(spark):
    other = CHANCE.replace("2 apples", "3 apples").replace("2 hours", "5 hours")
    days = "They had planned to stay for 5 days near the wide lake but came home after 3 days because the rain never ended"
    table = "set a 1 then b 1 then c 1 then d 1 then e 1 then f 1 then g 1 then h 1"
    exchanged = "set a 2 then b 3 then c 4 then d 5 then e 6 then f 7 then g 8 then h 9"
    assert kept_ids(
        spark, (ITEM, CHANCE, days, table), (1, f"Well, {ITEM.replace('12 baskets', '30 baskets')}."), (2, f"Before, {other}."), (3, "Nothing of the kind at all in this one"),
        (4, days.replace("3 days", "3 weeks")), (5, exchanged), (6, "Of another kind"), (6, f"Once more, {other}."), (6, "And of a third kind, with 4 words more"),
    ) == {3, 5}


def test_sentence_initial_names_number_words_full_units_and_short_items(spark):
    clips = "Natalia sold clips to 48 of her friends. Natalia then sold half as many. Natalia has how many left?"
    run = "He ran 5 kilometers before noon and 3 kilograms of ripe fruit were eaten on the way back home by all"
    short = "what is the capital of France"
    rows = [
        (1, clips.replace("Natalia", "Boris")), (2, "So. " + clips.replace("Natalia", "Maria Luisa")), (3, run.replace("5 kilometers", "seven miles").replace("3 kilograms", "two hundred and six grams")),
        (4, f"Now tell me, {short}, if you know."), (5, "what is the colour of the capital"), (6, "Boris sold hats to 48 of them. The rest was kept."),
        (7, "one " * 30_000 + "Anna. " * 30_000), (8, "short one here indeed"), (9, run.lower()),
    ]
    assert kept_ids(spark, (clips, run, short, "short one here"), *rows) == {5, 6, 7, 8}


def test_tokens_of_the_wide_form_are_aligned(spark):
    texts = ["Five-and twenty-five 3.5km x12 McDonald's, one hundred and five miles. Anna Maria 1,200", "\ue000A\ue003 Ab\ue001 5 \ue002", "", "Ñez Óra. Twenty Five Days", "5 m, 1,2,3.. one-mile"]
    frame = docs(spark, *enumerate(texts)).select(decontam.wide_canonical_tokens(F.col("text")).alias("c"), decontam.wide_raw_tokens(F.col("text")).alias("r"))
    for r in frame.collect():
        assert [c if c in "\ue000\ue001\ue002" else "" for c in r.c] == [x[0] if x[0] in "\ue000\ue001\ue002" else "" for x in r.r]
    assert [len(x.c) for x in frame.collect()][0] == 13
