"""Registered queries: reply parsing, stored streams, document changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions.replies import reply_text
from sieveline.functions.text import action_block, explode_actions, ndjson_lines, sse_data
from sieveline.operators.access import iso_text
from sieveline.operators.streams import stream_chunks, stream_tokens
from sieveline.plans import fixtures
from sieveline.plans.q_aggregates import _PROVIDERS, reply_bodies
from sieveline.plans.q_sources import _ACTIONS, _SPACE
from sieveline.plans.registry import EV, REPLY, query, ts_text
from sieveline.schema import load_events, read_table
from sieveline.sources import documents as docs


@query(
    "extract_actions",
    f"""WITH {EV}, {REPLY} SELECT event_id, agent_id, CASE
      WHEN eid % 3 = 1 THEN '[{{"type":"webhook","config":{{"tool":"t1"}},"payload":{{"id":' || eid || '}}}},{{"type":"page","config":{{}},"payload":{{"id":' || eid || '}}}},{{"type":"fax","config":{{}},"payload":{{"id":' || eid || '}}}}]' || chr(10)
      WHEN eid % 3 = 2 AND eid % 2 = 0 THEN '[{{"type":"webhook",' || chr(10) WHEN eid % 3 = 2 THEN '{{"type":"webhook"}}' || chr(10) END AS block FROM reply""",
)
def extract_actions(spark, sf_dir):
    return fixtures.replies(spark, sf_dir).select("event_id", "agent_id", action_block(F.col("content")).alias("block"))


@query(
    "parse_actions",
    f"""WITH {EV}, {REPLY}, {_ACTIONS} SELECT event_id, agent_id, pos AS action_pos, type,
      CASE WHEN type = 'webhook' THEN '{{"tool":"t1"}}' ELSE '{{}}' END AS config, '{{"id":' || event_id || '}}' AS action_payload FROM act""",
)
def parse_actions_q(spark, sf_dir):
    out = explode_actions(fixtures.replies(spark, sf_dir))
    return out.select("event_id", "agent_id", "action_pos", "type", "config", "action_payload")


_TRIM = f"regexp_replace(v, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


@query(
    "sse_data",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS v, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
      SELECT doc_id, line_no, {_TRIM} AS data FROM l WHERE {_TRIM} NOT IN ('', '[DONE]')""",
)
def sse_data_q(spark, sf_dir):
    body = F.concat(
        F.lit("data: "), F.replace("text", F.lit("\n"), F.lit("\ndata: ")), F.lit("\ndata: [DONE]\n: note\ndata:no-space\n\ndata:   ")
    )
    out = sse_data(read_table(spark, sf_dir, "documents").select("doc_id", body.alias("body")))
    return out.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "data")


@query(
    "ndjson_lines",
    f"WITH {EV} SELECT event_id, i.i AS line_no, CASE i.i WHEN 1 THEN payload ELSE props END AS record FROM ev, (VALUES (1), (3)) i(i)",
)
def ndjson_lines_q(spark, sf_dir):
    body = F.concat(F.lit("\n  "), F.col("payload"), F.lit("\n{broken\n"), F.col("raw"), F.lit("\n   \n"), F.col("raw"), F.lit(" x\n1,2"))
    return ndjson_lines(load_events(spark, sf_dir).select("event_id", body.alias("body")))


def stream_records(spark, sf_dir):
    """Six stored records per event and provider, some of them without text."""
    e = load_events(spark, sf_dir)
    k, n = F.get_json_object("raw", "$.k"), F.col("event_id").cast("bigint")
    provider = F.element_at(F.array(*[F.lit(p) for p in _PROVIDERS[:3]]), (n % 3).cast("int") + 1)
    t = F.concat(F.lit("w"), F.col("event_id"))
    a = [
        F.concat(F.lit('{"type":"message_start","message":{"usage":{"input_tokens":'), k, F.lit("}}}")),
        F.concat(F.lit('{"type":"content_block_delta","delta":{"text":"'), t, F.lit('"}}')),
        F.lit('{"type":"content_block_delta","delta":{}}'),
        F.lit('{"type":"message_delta","usage":{"output_tokens":11}}'),
        F.lit('{"type":"message_delta","usage":{"output_tokens":2}}'),
    ]
    o = [
        F.concat(F.lit('{"choices":[{"delta":{"content":"'), t, F.lit('"}}]}')),
        F.lit('{"choices":[{"delta":{"content":""}}]}'),
        F.lit('{"usage":{"total_tokens":5}}'),
        F.concat(F.lit('{"choices":[],"usage":{"total_tokens":'), k, F.lit("}}")),
        F.lit("{broken"),
    ]
    m = [
        F.concat(F.lit('{"message":{"content":"'), t, F.lit('"},"done":false}')),
        F.lit('{"message":{"content":"!"},"done":false}'),
        F.concat(F.lit('{"message":{"content":""},"done":true,"prompt_eval_count":20,"eval_count":'), k, F.lit("}")),
        F.lit('{"other":1}'),
        F.lit("{}"),
    ]
    pick = [F.when(n % 3 == 0, x).when(n % 3 == 1, y).otherwise(z) for x, y, z in zip(a, o, m)]
    return e.select(F.col("event_id").alias("response_id"), provider.alias("provider"), F.posexplode(F.array(*pick)).alias("seq", "record"))


@query(
    "delta_text",
    f"""WITH {EV} SELECT event_id AS response_id, CASE eid % 3 WHEN 0 THEN 1 ELSE 0 END AS seq, 'w' || event_id AS text FROM ev
      UNION ALL SELECT event_id, 1, '!' FROM ev WHERE eid % 3 = 2""",
)
def delta_text_q(spark, sf_dir):
    return stream_chunks(stream_records(spark, sf_dir)).select("response_id", "seq", "text")


@query(
    "stream_tokens",
    f"WITH {EV} SELECT event_id AS response_id, CAST(CASE eid % 3 WHEN 0 THEN k + 13 WHEN 1 THEN CASE k WHEN 0 THEN 5 ELSE k END ELSE 20 + k END AS BIGINT) AS tokens_used FROM ev",
)
def stream_tokens_q(spark, sf_dir):
    return stream_tokens(stream_records(spark, sf_dir)).select("response_id", "tokens_used")


@query(
    "reply_text",
    f"""WITH {EV} SELECT event_id, CASE WHEN eid % 7 IN (3, 6) THEN '' ELSE 'text ' || event_id END AS content FROM ev""",
)
def reply_text_q(spark, sf_dir):
    return reply_bodies(spark, sf_dir).select("event_id", reply_text(F.col("provider"), F.col("body")).alias("content"))


@query(
    "iso_time",
    f"""WITH {EV} SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || '000' AS back, ts > TIMESTAMP '2024-01-15 00:00:00' AS is_newer FROM ev""",
)
def iso_time(spark, sf_dir):
    e = load_events(spark, sf_dir).select("event_id", "timestamp", iso_text(F.col("timestamp")).alias("iso"))
    back = F.try_to_timestamp("iso")
    since = F.try_to_timestamp(F.lit("2024-01-15T01:00:00+01:00"))
    return e.select("event_id", "iso", ts_text(back).alias("back"), (F.col("timestamp") > since).alias("is_newer"))


# -- documents -----------------------------------------------------------------

_COMMENT = """cm AS (SELECT *, 'doc-' || (l_orderkey % 500) AS doc_id, strftime(l_shipdate, '%Y-%m-%dT00:00:00.000Z') AS created,
    CASE WHEN l_linestatus = 'O' THEN strftime(l_shipdate + INTERVAL 40 DAY, '%Y-%m-%dT00:00:00.000Z') END AS modified,
    l_returnflag = 'R' AS resolved, l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS cid FROM lineitem),
  top AS (SELECT *, coalesce(modified, created) AS stamp FROM cm WHERE coalesce(modified, created) > '1999-06-01T00:00:00.000Z' AND NOT resolved)"""
_SINCE = "1999-06-01T00:00:00.000Z"


def comment_pages(spark, sf_dir):
    """One poll result per line item: a page with a comment and its two replies."""
    li = read_table(spark, sf_dir, "lineitem")
    iso = lambda c: iso_text(c.cast("timestamp"))
    ship = F.col("l_shipdate")
    cid = F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    reply = lambda text, who, made, changed: F.struct(
        text.alias("content"), F.struct(who.alias("displayName")).alias("author"), made.alias("createdTime"), changed.alias("modifiedTime")
    )
    nothing = F.lit(None).cast("string")
    comment = F.struct(
        cid.alias("id"),
        F.when(F.col("l_linenumber") != 2, F.concat(F.lit("see "), cid)).alias("content"),
        F.struct(F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("user-"), F.col("l_suppkey").cast("string"))).alias("displayName")).alias("author"),
        iso(ship).alias("createdTime"),
        F.when(F.col("l_linestatus") == "O", iso(ship + F.expr("interval 40 days"))).alias("modifiedTime"),
        (F.col("l_returnflag") == "R").alias("resolved"),
        F.struct(F.col("l_partkey").cast("string").alias("value")).alias("quotedFileContent"),
        F.array(
            reply(F.concat(F.lit("old "), cid), nothing, iso(ship - F.expr("interval 4000 days")), nothing),
            reply(F.concat(F.lit("new "), cid), F.lit("Ann"), iso(ship), iso(ship + F.expr("interval 50 days"))),
        ).alias("replies"),
    )
    return li.select(
        F.concat(F.lit("doc-"), (F.col("l_orderkey") % 500).cast("string")).alias("doc_id"),
        F.concat(F.lit("Title "), (F.col("l_orderkey") % 500).cast("string")).alias("doc_title"),
        F.array(comment).alias("comments"),
        F.array(
            F.struct(
                F.concat(F.lit("r"), cid).alias("id"),
                iso(ship).alias("modifiedTime"),
                F.struct(F.when(F.col("l_linenumber") == 1, "Bo").alias("displayName")).alias("lastModifyingUser"),
            )
        ).alias("revisions"),
    )


def _comments(spark, sf_dir):
    return docs.new_comments(comment_pages(spark, sf_dir), F.try_to_timestamp(F.lit(_SINCE)))


@query(
    "src_doc_comments",
    f"""WITH {_COMMENT} SELECT doc_id, CASE WHEN l_suppkey % 4 <> 0 THEN 'user-' || l_suppkey ELSE 'Unknown' END AS author,
      CASE WHEN l_linenumber <> 2 THEN 'see ' || cid ELSE '' END AS content, stamp AS timestamp, CAST(l_partkey AS VARCHAR) AS context, 'comment' AS type FROM top""",
)
def src_doc_comments(spark, sf_dir):
    return _comments(spark, sf_dir).select("doc_id", "author", "content", "timestamp", "context", "type")


@query(
    "src_doc_replies",
    f"""WITH {_COMMENT} SELECT doc_id, 'Ann' AS author, 'new ' || cid AS content, strftime(l_shipdate + INTERVAL 50 DAY, '%Y-%m-%dT00:00:00.000Z') AS timestamp,
      CASE WHEN l_linenumber <> 2 THEN 'see ' || cid END AS reply_to FROM top""",
)
def src_doc_replies(spark, sf_dir):
    return docs.new_replies(_comments(spark, sf_dir)).select("doc_id", "author", "content", "timestamp", "reply_to")


@query(
    "src_doc_revisions",
    f"""WITH {_COMMENT} SELECT doc_id, CASE WHEN l_linenumber = 1 THEN 'Bo' ELSE 'Unknown' END AS author, 'Document revised (revision r' || cid || ')' AS content,
      created AS timestamp, 'edit' AS type FROM cm WHERE created > '{_SINCE}'""",
)
def src_doc_revisions(spark, sf_dir):
    out = docs.new_revisions(comment_pages(spark, sf_dir), F.try_to_timestamp(F.lit(_SINCE)))
    return out.select("doc_id", "author", "content", "timestamp", "type")


def _changes(spark, sf_dir):
    c = _comments(spark, sf_dir)
    edits = docs.new_revisions(comment_pages(spark, sf_dir), F.try_to_timestamp(F.lit(_SINCE)))
    sug = suggestions_present(spark, sf_dir).select(
        F.lit("suggestion").alias("type"), "doc_id", F.col("doc_id").alias("doc_title"), F.lit("Unknown").alias("author"),
        F.col("suggestion_id").alias("content"), F.concat(F.col("poll").cast("string"), F.lit("-12-31T00:00:00.000Z")).alias("timestamp"),
    )
    return c.drop("_comment", "_since").unionByName(edits, allowMissingColumns=True).unionByName(sug, allowMissingColumns=True)


_CHANGES = f"""{_COMMENT}, {{present}}, ch AS (
    SELECT 'comment' AS type, doc_id, stamp AS timestamp, resolved FROM top
    UNION ALL SELECT 'edit', doc_id, created, NULL FROM cm WHERE created > '{_SINCE}'
    UNION ALL SELECT 'suggestion', doc_id, poll || '-12-31T00:00:00.000Z', NULL FROM present)"""

_PRESENT = """present AS (SELECT DISTINCT 'doc-' || (l_suppkey % 90) AS doc_id, CAST(year(l_shipdate) AS INTEGER) AS poll, 's-' || (l_partkey % 40) AS suggestion_id FROM lineitem)"""
_CHANGES = _CHANGES.replace("{present}", _PRESENT)


@query(
    "src_doc_enrich",
    f"""WITH {_CHANGES} SELECT doc_id, type, timestamp, CASE type WHEN 'suggestion' THEN 7 WHEN 'comment' THEN 5 ELSE 3 END AS priority,
      type AS meta_type, doc_id AS meta_doc, CAST(resolved AS VARCHAR) AS meta_resolved FROM ch""",
)
def src_doc_enrich(spark, sf_dir):
    out = docs.enrich_change(_changes(spark, sf_dir))
    meta = lambda p: F.get_json_object("metadata", f"$.google_docs.{p}")
    return out.select(
        "doc_id", "type", "timestamp", "priority",
        meta("type").alias("meta_type"), meta("doc_id").alias("meta_doc"), meta("resolved").alias("meta_resolved"),
    )


@query(
    "src_doc_cursor",
    f"""WITH {_CHANGES}, prev AS (SELECT DISTINCT 'doc-' || (l_orderkey % 600) AS doc_id, '{_SINCE}' AS since FROM lineitem)
      SELECT coalesce(p.doc_id, n.doc_id) AS doc_id, coalesce(n.t, p.since) AS since FROM prev p FULL JOIN (SELECT doc_id, max(timestamp) AS t FROM ch GROUP BY 1) n ON p.doc_id = n.doc_id""",
)
def src_doc_cursor(spark, sf_dir):
    previous = read_table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("doc-"), (F.col("l_orderkey") % 600).cast("string")).alias("doc_id"), F.lit(_SINCE).alias("since")
    ).distinct()
    return docs.next_cursor(previous, _changes(spark, sf_dir))


@query("src_watch_types", f"WITH {_CHANGES} SELECT type, count(*) AS n FROM ch WHERE type IN ('suggestion', 'edit') GROUP BY 1")
def src_watch_types(spark, sf_dir):
    kept = docs.watch_types(_changes(spark, sf_dir), ["suggestions", "edits"])
    return kept.groupBy("type").agg(F.count("*").alias("n"))


def suggestions_present(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("doc-"), (F.col("l_suppkey") % 90).cast("string")).alias("doc_id"),
        F.year("l_shipdate").alias("poll"),
        F.concat(F.lit("s-"), (F.col("l_partkey") % 40).cast("string")).alias("suggestion_id"),
    ).distinct()


@query(
    "src_doc_new_suggestions",
    f"""WITH {_PRESENT}, polls AS (SELECT DISTINCT 'doc-' || (l_suppkey % 90) AS doc_id, CAST(year(l_shipdate) AS INTEGER) AS poll FROM lineitem),
      n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY poll) AS i FROM polls),
      p AS (SELECT doc_id, poll, suggestion_id, i FROM present JOIN n USING (doc_id, poll))
      SELECT doc_id, poll, suggestion_id FROM p WHERE i > 1 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.doc_id = p.doc_id AND q.suggestion_id = p.suggestion_id AND q.i = p.i - 1)""",
)
def src_doc_new_suggestions(spark, sf_dir):
    polls = read_table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("doc-"), (F.col("l_suppkey") % 90).cast("string")).alias("doc_id"), F.year("l_shipdate").alias("poll")
    )
    return docs.new_suggestions(suggestions_present(spark, sf_dir), polls)


@query(
    "src_doc_suggestion_ids",
    """SELECT DISTINCT l_orderkey AS doc_id, unnest([ 'ds-' || l_linenumber, 'ins-' || l_partkey, 'del-' || l_suppkey, 'ts-' || l_linenumber, 'obj-' || l_returnflag, 'ps-' || l_linestatus,
        't1-' || l_partkey, 't2-' || l_suppkey, 't3-' || l_linenumber, 't4-' || l_partkey, 't5-' || l_suppkey, 't6-' || l_linenumber ]) AS suggestion_id FROM lineitem""",
)
def src_doc_suggestion_ids(spark, sf_dir):
    """Document bodies with every kind of pending change, the last ones in tables nested six times."""
    q = lambda p, c: F.concat(F.lit('"' + p), F.col(c).cast("string"), F.lit('"'))
    para = lambda *x: F.concat(F.lit('{"paragraph":{"elements":['), *x, F.lit("]}}"))
    run = lambda field, ids: F.concat(F.lit('{"textRun":{"content":"x","' + field + '":['), ids, F.lit("]}}"))
    table = lambda inner: F.concat(F.lit('{"table":{"tableRows":[{"tableCells":[{"content":['), inner, F.lit("]}]}]}}"))
    t6 = table(para(run("suggestedDeletionIds", q("t6-", "l_linenumber"))))
    t5 = table(F.concat(t6, F.lit(","), para(run("suggestedInsertionIds", q("t5-", "l_suppkey")))))
    t4 = table(F.concat(para(run("suggestedInsertionIds", q("t4-", "l_partkey"))), F.lit(","), t5))
    t3 = table(F.concat(para(run("suggestedDeletionIds", q("t3-", "l_linenumber"))), F.lit(","), t4))
    t2 = table(F.concat(para(run("suggestedInsertionIds", q("t2-", "l_suppkey"))), F.lit(","), t3))
    t1 = table(F.concat(para(run("suggestedInsertionIds", q("t1-", "l_partkey"))), F.lit(","), t2))
    body = F.concat(
        F.lit('{"title":"t","suggestedDocumentStyleChanges":{'), q("ds-", "l_linenumber"), F.lit(':{}},"body":{"content":['),
        para(run("suggestedInsertionIds", q("ins-", "l_partkey")), F.lit(","), run("suggestedDeletionIds", q("del-", "l_suppkey"))),
        F.lit(',{"paragraph":{"elements":[{"textRun":{"content":"y","suggestedTextStyleChanges":{'), q("ts-", "l_linenumber"),
        F.lit(':{"a":1}}}},{"inlineObjectElement":{"suggestedInsertionIds":['), q("obj-", "l_returnflag"),
        F.lit(']}}],"suggestedParagraphStyleChanges":{'), q("ps-", "l_linestatus"), F.lit(":{}}}},"),
        t1, F.lit("]}}"),
    )
    bodies = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), body.alias("body"))
    return docs.suggestion_ids(bodies)


_RUNS = """li AS (SELECT *, l_orderkey AS doc_id, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0')
      || '-' || strftime(l_shipdate, '%Y-%m-%d') AS para, 's-' || (l_linenumber % 2) AS sid FROM lineitem),
  side AS (SELECT doc_id, sid,
      trim(string_agg(' ' || l_partkey || ' ', '' ORDER BY para) FILTER (WHERE l_returnflag <> 'R')) AS new_text,
      trim(string_agg(l_returnflag || l_linestatus, '' ORDER BY para) FILTER (WHERE l_linestatus = 'O')) AS old_text,
      string_agg(trim('line ' || l_suppkey || ' ' || l_partkey || ' ' || l_returnflag || l_linestatus || ' both '), ' ' ORDER BY para)
        FILTER (WHERE l_returnflag <> 'R' OR l_linestatus = 'O') AS context,
      bool_or(l_returnflag <> 'R' OR l_linestatus = 'O') AS tagged
    FROM li GROUP BY 1, 2)"""


@query(
    "suggestion_text",
    f"""WITH {_RUNS} SELECT doc_id, sid AS suggestion_id, 'Unknown' AS author,
      CASE WHEN new_text <> '' AND old_text <> '' THEN 'Replace "' || old_text || '" → "' || new_text || '"'
        WHEN new_text <> '' THEN 'Insert: "' || new_text || '"' WHEN old_text <> '' THEN 'Delete: "' || old_text || '"'
        ELSE 'Style/formatting change (' || sid || ')' END AS content, coalesce(context, '') AS context FROM side""",
)
def suggestion_text_q(spark, sf_dir):
    ids = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("s-"), (F.col("l_linenumber") % 2).cast("string")).alias("suggestion_id")
    )
    return docs.suggestion_text(fixtures.suggestion_runs(spark, sf_dir), ids)
