"""The registered queries of the operators, each over its whole table, with SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm import chat, codes, decontam, licenses
from sieveline.llm.alignment import align_tokenizers
from sieveline.llm.ann import search_nearest
from sieveline.llm.common import in_fold
from sieveline.llm.html import extract
from sieveline.llm.langid import fit_languages, identify_language
from sieveline.llm.mixing import mix
from sieveline.llm.neardup import near_duplicates
from sieveline.llm.recompression import remove_repeats
from sieveline.llm.tokencount import count_tokens
from sieveline.llm.toxicity import THRESHOLD as TOXIC
from sieveline.llm.toxicity import fit_toxicity, toxicity
from sieveline.plans.registry import query

# Lower case for A-Z alone, and words between ASCII white space.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def neardup_sql(source: str = "documents") -> str:
    """CTEs ``wd`` to ``comp`` for the components over ``source``."""
    return rf"""wd AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '{SPACED}') AS ws FROM {source}),
sh AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM wd),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sh),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(u, v) AS (
  SELECT doc_id, doc_id FROM sh UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON p.u = r.v),
comp AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)"""


@query(
    "op9_setsketch_neardup",
    f"""WITH RECURSIVE {neardup_sql()}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sh JOIN comp USING (doc_id)""",
)
def op9_setsketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """Labels are learned outside the held-out fold only."""
    labels = table(spark, sf_dir, "labels").where(~in_fold("doc_id", 3, 1)).select("doc_id", "toxic")
    return fit_toxicity(docs, labels)


@query("op1_compression_toxicity")
def op1_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = toxicity(toxicity_model(spark, docs, sf_dir), spark)
    scored = docs.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def language_model(spark: SparkSession, docs: DataFrame):
    """Languages are learned outside the held-out fold only."""
    return fit_languages(docs.where(~in_fold("doc_id", 5, 0)), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_unigram_language")
def op3_unigram_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    identify = identify_language(language_model(spark, docs), spark)
    found = docs.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), identify(F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def decontam_sql(source: str = "documents") -> str:
    """CTEs ``items`` to ``leaks``: pairs of documents of ``source`` and benchmark items."""
    units = "|".join(decontam.UNITS)
    name, unit, number = "chr(57344)", "chr(57345)", "chr(57346)"

    def mark(column: str) -> str:
        clean = f"regexp_replace(coalesce({column}, ''), '[' || {name} || {unit} || {number} || ']', '', 'g')"
        first = rf"regexp_replace({clean}, '([\p{{Ll}}\p{{N}},;:)] )(\p{{Lu}}\p{{Ll}}+)', '\1' || {name} || '\2', 'g')"
        second = rf"regexp_replace({first}, '(' || {name} || '\p{{Lu}}\p{{Ll}}+ )(\p{{Lu}}\p{{Ll}}+)', '\1' || {name} || '\2', 'g')"
        return rf"regexp_replace({second}, '(\p{{N}}) ?({units})\b', '\1 ' || {unit} || '\2', 'g')"

    slots = rf"regexp_replace(regexp_replace(m, '([' || {name} || {unit} || '])\p{{L}}+', '\1', 'g'), '\p{{N}}+(?:[.,]\p{{N}}+)*', {number}, 'g')"
    canon = rf"regexp_extract_all(lower({slots}), '[' || {name} || {unit} || {number} || ']|\p{{L}}+')"
    raw = rf"regexp_extract_all(m, '[' || {name} || {unit} || ']?\p{{L}}+|\p{{N}}+(?:[.,]\p{{N}}+)*')"
    grams = (
        "CASE WHEN len(c) = 0 THEN [] WHEN len(c) < 8 THEN [array_to_string(c, ' ')]"
        " ELSE list_transform(range(1, len(c) - 6), lambda i: array_to_string(c[i:i + 7], ' ')) END"
    )
    words = f"len(list_filter(c[pos + 1:pos + 8], lambda t: t NOT IN ({name}, {unit}, {number})))"
    return f"""items AS (
  SELECT item_id AS id, {canon} AS c, {raw} AS r FROM (SELECT item_id, {mark("text")} AS m FROM benchmark WHERE item_id IS NOT NULL)),
texts AS (
  SELECT doc_id AS id, {canon} AS c, {raw} AS r FROM (
    SELECT doc_id, {mark("text")} AS m FROM {source} WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
item_grams AS (
  SELECT id, pos, g, count(*) OVER (PARTITION BY id) AS n FROM (
    SELECT id, c, unnest(range(len({grams}))) AS pos, unnest({grams}) AS g FROM items)
  WHERE {words} >= least(4, ceil(len(c) / 2))),
short AS (SELECT DISTINCT len(c) AS n FROM items WHERE len(c) BETWEEN 4 AND 7),
text_grams AS (
  SELECT id, unnest(range(len({grams}))) AS place, unnest({grams}) AS g FROM texts
  UNION ALL SELECT id, unnest(range(len(s))), unnest(s) FROM (
    SELECT id, list_transform(range(1, len(c) - n + 2), lambda i: array_to_string(c[i:i + n - 1], ' ')) AS s FROM texts, short WHERE len(c) > n)),
runs AS (
  SELECT t.id AS doc, i.id AS item, place - pos AS shift, list(DISTINCT pos) AS poss, max(n) AS n
  FROM text_grams t JOIN item_grams i USING (g) GROUP BY ALL
  HAVING count(DISTINCT pos) >= max(n) * 0.5 OR count(DISTINCT pos) >= 8),
places AS (
  SELECT DISTINCT doc, item, shift, unnest(range(a + 1, least(a + 8, len(i.r)) + 1)) AS pos
  FROM (SELECT doc, item, shift, unnest(poss) AS a FROM runs) JOIN items i ON i.id = item),
slots AS (
  SELECT doc, item, shift, lower(i.r[pos]) AS v, lower(t.r[pos + shift]) AS f
  FROM places JOIN items i ON i.id = item JOIN texts t ON t.id = doc
  WHERE regexp_matches(i.r[pos], '^([' || {name} || {unit} || ']|\\p{{N}})')),
agreed AS (
  SELECT doc, item, shift, sum(k) AS k, sum(most) AS most FROM (
    SELECT doc, item, shift, v, sum(n) AS k, max(n) AS most FROM (
      SELECT doc, item, shift, v, f, count(*) AS n FROM slots GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
verbatim AS (
  SELECT doc, item, shift, count(*) FILTER (same) AS same FROM (
    SELECT doc, item, shift, a, bool_and(lower(i.r[p]) IS NOT DISTINCT FROM lower(t.r[p + shift])) AS same FROM (
      SELECT doc, item, shift, a, unnest(range(a + 1, least(a + 8, len(i.r)) + 1)) AS p
      FROM (SELECT doc, item, shift, unnest(poss) AS a FROM runs) JOIN items i ON i.id = item)
    JOIN items i ON i.id = item JOIN texts t ON t.id = doc GROUP BY ALL) GROUP BY ALL),
leaks AS (
  SELECT doc AS doc_id, item AS item_id, max(struct_pack(n := len(poss), s := -shift, k := coalesce(k, 0))) AS b, max(n) AS item_windows
  FROM runs LEFT JOIN agreed USING (doc, item, shift) LEFT JOIN verbatim USING (doc, item, shift)
  WHERE k IS NULL OR same >= n * 0.5 OR same >= 8 OR most >= k * 0.5 GROUP BY ALL)"""


@query(
    "op8_template_decontamination",
    f"""WITH {decontam_sql()}
SELECT doc_id, item_id, CAST(b.n AS BIGINT) AS n_windows, CAST(item_windows AS BIGINT) AS item_windows, CAST(b.k AS BIGINT) AS n_slots FROM leaks""",
)
def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_entropy_mixing")
def op2_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


@query("op4_license_signatures")
def op4_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


@query("op5_pretoken_counts")
def op5_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _escaped_sql(column: str) -> str:
    for control, code in chat.ESCAPES:
        column = f"replace({column}, '{control}', '\\{code}')"
    return column


SAMPLE_TURN = "</s>[INST] ok [/INST]"


@query(
    "op6_reply_trees",
    f"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{SAMPLE_TURN}' UNION ALL SELECT -1, 1, 'assistant', '{SAMPLE_TURN}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('{chat.ROLE}{chat.END_ROLE}{chat.END}' || {_escaped_sql("role")} || {_escaped_sql("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
)
def op6_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(SAMPLE_TURN).alias("text"))
    return thread_digests(own.unionByName(more))


def thread_digests(turns: DataFrame) -> DataFrame:
    """Each conversation as a tree in which a turn answers the one before it; digests of what is read back."""
    # A null id is a conversation of its own: trees are joined by key, which mustn't be null.
    keyed = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "turn", "role", "text")
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_last(), F.col("role"), F.col("text"))
    numbered = keyed.withColumn("node", F.row_number().over(order).cast("long"))
    messages = numbered.select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )
    read = chat.read_back(chat.conversations(messages))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.expr("cast(nullif(tree, '') AS long)").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op7_tree_main_text")
def op7_tree_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


@query("op10_graph_neighbours")
def op10_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def codes_sql(source: str = "embeddings", entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS) -> str:
    """The rounds of op13 spelled out, every part against every entry."""
    near = """a{r} AS MATERIALIZED (SELECT id, p, min(struct_pack(d := d, e := e)) AS m FROM (
  SELECT id, p, e, xx - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM parts JOIN b{r} USING (p)) GROUP BY ALL)"""
    mean = """b{n} AS MATERIALIZED (SELECT p, e, coalesce(new, c) AS c FROM b{r} LEFT JOIN (
  SELECT p, e, list(CAST(floor(s / k) AS DOUBLE) ORDER BY i) AS new FROM (
    SELECT p, m.e AS e, i, sum(CAST(x[i] AS BIGINT)) AS s, count(*) AS k
    FROM a{r} JOIN parts USING (id, p), unnest(range(1, len(x) + 1)) u(i) GROUP BY ALL) GROUP BY ALL) USING (p, e))"""
    steps = ",\n".join(x for r in range(rounds) for x in (near.format(r=r), mean.format(r=r, n=r + 1)))
    return f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda v: floor(1024 * CAST(v AS DOUBLE))) AS q
  FROM {source} WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS MATERIALIZED (
  SELECT id, p, x, list_inner_product(x, x) AS xx FROM (
    SELECT id, p, q[p * len(q) // 4 + 1:(p + 1) * len(q) // 4] AS x FROM kept, range(4) t(p))),
b0 AS MATERIALIZED (SELECT p, id - 1 AS e, x AS c FROM parts WHERE id <= {entries}),
{steps},
{near.format(r=rounds)},
books AS (
  SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(c) AS v, unnest(range(len(c))) AS i FROM b{rounds})),
coded AS (
  SELECT id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (id), books"""


@query("op13_product_codes", codes_sql())
def op13_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress_vectors(table(spark, sf_dir, "embeddings"))
    digest = F.lit(codes.codebooks_digest(books)).alias("codebooks_sha256")
    return codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", digest)


@query("op11_tokenizer_alignment")
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align_tokenizers(table(spark, sf_dir, "documents"), *paths)[0]


@query(
    "op12_recompression_dedup",
    rf"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS ws FROM documents),
w AS (
  SELECT doc_id, unnest(range(1, len(gs) + 1)) AS p, unnest(gs) AS g FROM (
    SELECT doc_id, list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' '))) AS gs FROM t)),
least AS (SELECT g, min(doc_id) AS low FROM w GROUP BY g),
gone AS (SELECT DISTINCT doc_id, p + k AS pos FROM w JOIN least USING (g), range(50) r(k) WHERE low < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS x FROM t),
left_over AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY pos) AS s FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM t LEFT JOIN left_over USING (doc_id)""",
)
def op12_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
