"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, units behind numbers and names inside sentences become typed
placeholders; everything else is lower-cased words. Windows of eight canonical
tokens are joined by hash with those of the benchmark items, so a question whose
numbers, units or names were exchanged still meets its template. The values that
fill the slots must then agree: where an item repeats a value, the document mostly
repeats its own value at the same places, unless enough windows match word for word. One
edited or chance value doesn't clear a document. ``decontaminated`` looks for the wide form, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import stored

WINDOW = 8
#: A window of an item counts only with this many words that aren't placeholders.
MIN_WORDS = 4
#: An item is found in a document with this share of its windows, or this many of them in one run.
MIN_SHARE = 0.5
MIN_RUN = 8
#: A run of windows that aren't verbatim needs this share of slots filled as most of their value's places.
MIN_AGREED = 0.5
#: Rows of the benchmark's windows (about 40 bytes each) up to which they are sent to every executor.
BROADCAST_ROWS = 500_000

# Units of measure that become a placeholder behind a number.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams pound pounds ounce ounces ton tons ml "
    "l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week "
    "weeks month months year years percent dollar dollars cent cents euro euros degrees mph kmh watts volts bytes kb mb gb"
).split()
MORE_UNITS = (
    "meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters centimetre centimetres "
    "millimeter millimeters millimetre millimetres kilogram kilograms milligram milligrams milliliter milliliters "
    "millilitre millilitres tonne tonnes acre acres hectare hectares degree watt volt byte"
).split()
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
).split()
NAME, UNIT, NUMBER, END = map(chr, (0xE000, 0xE001, 0xE002, 0xE003))  # of the private use area
NUMBER_PATTERN = r"\p{N}+(?:[.,]\p{N}+)*"
UNIT_PATTERN = rf"(\p{{N}}) ?({'|'.join(UNITS)})\b"
NAME_PATTERN = r"([\p{Ll}\p{N},;:)] )(\p{Lu}\p{Ll}+)"
SECOND_NAME_PATTERN = rf"({NAME}\p{{Lu}}\p{{Ll}}+ )(\p{{Lu}}\p{{Ll}}+)"
RAW_TOKEN = rf"([{NAME}{UNIT}]?\p{{L}}+|{NUMBER_PATTERN})"
TOKEN = rf"([{NAME}{UNIT}{NUMBER}]|\p{{L}}+)"

# The wide form: any capitalised words are a name and a run of them is one, numbers may be words. Possessive, so that long runs don't recurse.
_WORD = rf"(?i:{'|'.join(NUMBER_WORDS)})(?!\p{{L}})"
_CAPITAL = rf"(?!{_WORD})\p{{Lu}}\p{{Ll}}\p{{L}}*+"
WIDE_NAME = rf"(?<!\p{{L}})({_CAPITAL}(?:[^\p{{L}}\p{{N}}]++{_CAPITAL})*+)"
WIDE_NUMBER = (
    rf"((?:\p{{N}}++(?:[.,]\p{{N}}++)*+|(?<!\p{{L}}){_WORD})(?:(?:[\s-]++|(?<=hundred|thousand)\s++and\s++){_WORD})*+)"
)
WIDE_UNIT = rf"({NUMBER}[^{END}]*+{END})[\s-]?({'|'.join(UNITS + MORE_UNITS)})(?!\p{{L}})"
WIDE_SLOT = rf"[{NAME}{UNIT}{NUMBER}][^{END}]*+{END}"


def marked(text: Column) -> Column:
    """The text with names and units marked by a private character in front; such characters of its own are dropped."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NAME}{UNIT}{NUMBER}]", "")
    named = F.regexp_replace(F.regexp_replace(clean, NAME_PATTERN, f"$1{NAME}$2"), SECOND_NAME_PATTERN, f"$1{NAME}$2")
    return F.regexp_replace(named, UNIT_PATTERN, f"$1 {UNIT}$2")


def canonical_tokens(text: Column) -> Column:
    """Lower-cased words and placeholders; aligned with ``raw_tokens``."""
    slots = F.regexp_replace(F.regexp_replace(marked(text), rf"([{NAME}{UNIT}])\p{{L}}+", "$1"), NUMBER_PATTERN, NUMBER)
    return F.regexp_extract_all(F.lower(slots), F.lit(TOKEN), 1)


def raw_tokens(text: Column) -> Column:
    """The tokens' own values, names and units with their marks."""
    return F.regexp_extract_all(marked(text), F.lit(RAW_TOKEN), 1)


def wide_marked(text: Column) -> Column:
    """The text with names, numbers and units between a private character of their kind and ``END``."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NAME}{UNIT}{NUMBER}{END}]", "")
    named = F.regexp_replace(clean, WIDE_NAME, f"{NAME}$1{END}")
    return F.regexp_replace(F.regexp_replace(named, WIDE_NUMBER, f"{NUMBER}$1{END}"), WIDE_UNIT, f"$1{UNIT}$2{END}")


def wide_canonical_tokens(text: Column) -> Column:
    """Lower-cased words and placeholders of the wide form; aligned with ``wide_raw_tokens``."""
    slots = F.regexp_replace(wide_marked(text), rf"([{NAME}{UNIT}{NUMBER}])[^{END}]*+{END}", "$1")
    return F.regexp_extract_all(F.lower(slots), F.lit(TOKEN), 1)


def wide_raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(wide_marked(text), F.lit(rf"({WIDE_SLOT}|\p{{L}}+)"), 1)


#: Canonical and raw tokens of each form.
PLAIN, WIDE = (canonical_tokens, raw_tokens), (wide_canonical_tokens, wide_raw_tokens)


def _windows(tokens: str) -> Column:
    """Hashes of all windows; a shorter sequence is one window, an empty one has none."""
    return F.expr(
        f"CASE WHEN size({tokens}) = 0 THEN array() WHEN size({tokens}) < {WINDOW} THEN array(xxhash64({tokens}))"
        f" ELSE transform(sequence(1, size({tokens}) - {WINDOW - 1}), i -> xxhash64(slice({tokens}, i, {WINDOW}))) END"
    )


def _placed_windows(tokens: str, short: list[int]) -> Column:
    """(place, window) of all windows, and of those of the lengths ``short``."""
    placed = lambda windows: f"transform({windows}, (w, i) -> struct(i AS place, w AS window))"
    own = [
        f"CASE WHEN size({tokens}) > {n} THEN transform(sequence(1, size({tokens}) - {n - 1}), i -> xxhash64(slice({tokens}, i, {n}))) ELSE array() END"
        for n in short
    ]
    return F.concat(F.transform(_windows(tokens), lambda w, i: F.struct(i.alias("place"), w.alias("window"))), *[F.expr(placed(w)) for w in own])


def benchmark_windows(items: DataFrame, item_column: str, text_column: str, canonical=canonical_tokens) -> DataFrame:
    """(window, item_id, at, of): the windows of an item with enough words, and how many it has."""
    tokens = items.select(F.col(item_column).alias("item_id"), canonical(F.col(text_column)).alias("tokens"))
    every = tokens.select("item_id", "tokens", F.posexplode(_windows("tokens")).alias("at", "window"))
    words = F.expr(
        f"size(filter(slice(tokens, at + 1, {WINDOW}), t -> t NOT IN ('{NAME}', '{UNIT}', '{NUMBER}')))"
    )
    needed = F.least(F.lit(MIN_WORDS), F.ceil(F.size("tokens") / 2))
    some = every.where(words >= needed).select("window", "item_id", "at")
    return some.join(some.groupBy("item_id").agg(F.count("*").alias("of")), "item_id")


def _agreed(runs: DataFrame, values: DataFrame, given: DataFrame) -> DataFrame:
    """Slots of each run, and whether they differ: verbatim windows suffice alone, most slots decide otherwise; the best of the rows of an id counts."""
    run = ["doc_id", "item_id", "shift"]
    places = f"sequence(a + 1, least(a + {WINDOW}, size(given)))"
    same = F.expr(f"size(filter(ats, a -> forall({places}, p -> lower(try_element_at(given, p)) <=> lower(try_element_at(own, p + shift)))))")
    filled = F.transform(
        F.expr(f"array_distinct(flatten(transform(ats, a -> {places})))"),
        lambda p: F.struct(
            F.lower(F.try_element_at("given", p)).alias("value"), F.lower(F.try_element_at("own", (p + F.col("shift")).cast("int"))).alias("filled")
        ),
    )
    compared = runs.join(values, "doc_id").join(given, "item_id").select(
        *run, "row", ((same >= F.col("of") * MIN_SHARE) | (same >= MIN_RUN)).alias("verbatim"),
        F.filter(filled, lambda x: x["value"].rlike(rf"^[{NAME}{UNIT}{NUMBER}\p{{N}}]")).alias("slots"),
    )
    each = [*run, "row", "verbatim"]
    return (
        compared.select(*each, F.inline("slots"))
        .groupBy(*each, "value", "filled")
        .agg(F.count("*").alias("n"))
        .groupBy(*each, "value")
        .agg(F.sum("n").alias("n"), F.max("n").alias("most"))
        .groupBy(*each)
        .agg(F.sum("n").alias("n"), F.sum("most").alias("most"))
        .groupBy(*run)
        .agg(F.max(F.struct(F.col("verbatim") | (F.col("most") >= F.col("n") * MIN_AGREED), "n")).alias("best"))
        .select(*run, F.col("best.n").alias("n_slots"), (~F.col("best.col1")).alias("differ"))
    )


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    form: tuple = PLAIN,
) -> DataFrame:
    """Pairs of documents and benchmark items that they repeat, perhaps with other numbers, units or names.

    Returns doc_id, item_id, n_windows (distinct windows of the item found),
    item_windows (windows that it has), n_slots (filled places compared), a row
    for each pair with half of the item's windows, or ``MIN_RUN`` of them, found
    at one offset with consistent slots; the best offset counts (ties: the
    smallest). Null and empty texts, rows with a null id, and null items are
    never part of a pair. Rows that share an id count as one document. Texts of
    fewer tokens than a window are compared whole; items of ``MIN_WORDS`` tokens or
    more, but fewer than a window, are also found inside longer texts. Other columns are
    ignored; empty tables give an empty result.

    Slots are consistent where the windows that match word for word, values included,
    suffice alone, or where ``MIN_AGREED`` of all slots are filled as most places of
    their value: one edited or chance value clears nobody.
    """
    canonical, raw = form
    items = items.where(F.col(item_column).isNotNull())
    bench = stored(benchmark_windows(items, item_column, item_text_column, canonical), "benchmark")
    if bench.count() <= BROADCAST_ROWS:
        bench = F.broadcast(bench)
    whole = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).where(
        "doc_id is not null and text is not null"
    )
    sizes = items.select(F.size(canonical(F.col(item_text_column))).alias("n")).where(F.col("n").between(MIN_WORDS, WINDOW - 1))
    short = sorted(r.n for r in sizes.distinct().collect())  # a few lengths at most
    tokens = whole.select("doc_id", canonical(F.col("text")).alias("tokens"))
    if short:
        windows = tokens.select("doc_id", F.inline(_placed_windows("tokens", short)))
    else:
        windows = tokens.select("doc_id", F.posexplode(_windows("tokens")).alias("place", "window"))
    met = windows.join(bench, "window").select("doc_id", "item_id", (F.col("place") - F.col("at")).alias("shift"), "at", "of")
    runs = (
        met.groupBy("doc_id", "item_id", "shift")
        .agg(F.collect_set("at").alias("ats"), F.max("of").alias("of"))
        .where((F.size("ats") >= F.col("of") * MIN_SHARE) | (F.size("ats") >= MIN_RUN))
    )
    runs = stored(runs, "runs")
    # The table of runs is small where few documents repeat items: its size decides how it is joined.
    values = whole.join(runs.select("doc_id").distinct(), "doc_id").select(
        "doc_id", raw(F.col("text")).alias("own"), F.xxhash64("text").alias("row")
    )
    given = items.select(F.col(item_column).alias("item_id"), raw(F.col(item_text_column)).alias("given"))
    agreed = _agreed(runs, values, given)
    found = (
        runs.join(agreed, ["doc_id", "item_id", "shift"], "left")
        .where("differ is null or not differ")
        .groupBy("doc_id", "item_id")
        .agg(
            F.max(
                F.struct(F.size("ats").cast("long").alias("n"), (-F.col("shift")).alias("s"), F.coalesce("n_slots", F.lit(0)).alias("slots"))
            ).alias("best"),
            F.max("of").alias("item_windows"),
        )
    )
    return found.select("doc_id", "item_id", F.col("best.n").alias("n_windows"), "item_windows", F.col("best.slots").alias("n_slots"))


def decontaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that repeat no benchmark item, by either form, with all their columns. Rows with a null id stay."""
    plain, wide = (contaminated(docs, items, id_column, text_column, form=form).select("doc_id") for form in (PLAIN, WIDE))
    hit = stored(plain.union(wide).select(F.col("doc_id").alias(id_column)).distinct(), "leaks")
    return docs.join(hit, id_column, "left_anti")
