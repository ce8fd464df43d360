"""Inputs that registered queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators.routing import route_agents
from sieveline.schema import load_events, read_table

AGENTS = [
    {"id": "triage", "sources": []},
    {"id": "audit", "sources": ["src-1", "src-2"]},
    {"id": "idle", "sources": ["src-99"]},
]
BUDGETS = {"triage": 3000, "audit": 900}
HANDLERS = [("webhook", "hook-old"), ("page", "pager"), ("webhook", "hook-new")]


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event, agent) pairs with tokens, latency, content and failures."""
    n = F.col("event_id").cast("bigint")
    budget = F.when(F.col("agent_id") == "triage", 3000).when(F.col("agent_id") == "audit", 900)
    text = n.cast("string")
    fence = "```json:actions"
    content = (
        F.when(n % 3 == 0, F.concat(F.lit("nothing to do for "), text))
        .when(
            n % 3 == 1,
            F.concat(
                F.lit(f"Found it.\n{fence}\n[" + '{"type":"webhook","config":{"tool":"t1"},"payload":{"id":'), text,
                F.lit('}},{"type":"page","config":{},"payload":{"id":'), text,
                F.lit('}},{"type":"fax","config":{},"payload":{"id":'), text, F.lit("}}]\n```\nDone.\n"),
                F.lit(f'{fence}\n[{{"type":"late"}}]\n```'),
            ),
        )
        .when(n % 2 == 0, F.lit(f'{fence}\r\n[{{"type":"webhook",\n```'))
        .otherwise(F.lit(f'{fence} \n{{"type":"webhook"}}\n```'))
    )
    return (
        route_agents(load_events(spark, sf_dir), AGENTS)
        .withColumn("tokens", F.lit(50) + n % 400)
        .withColumn("latency_ms", F.get_json_object("payload", "$.value").cast("double"))
        .withColumn("error", F.when(n % 17 == 0, F.concat(F.lit("timeout after "), text, F.lit(" ms"))))
        .withColumn("max_per_hour", budget)
        .withColumn("content", content)
    )


def bench_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured agent runs: run 0 is the warm-up, one bridge always fails."""
    e = read_table(spark, sf_dir, "events")
    failed = (F.col("user_id") % 5 == 4) | (F.col("event_id") % 17 == 0)
    return e.select(
        F.concat(F.lit("bridge-"), (F.col("user_id") % 5).cast("string")).alias("bridge"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") % 4).cast("int").alias("run"),
        F.col("value").alias("latency_ms"),
        (F.lit(50) + F.col("event_id") % 400).alias("tokens"),
        F.concat(F.lit("reply "), F.col("event_id").cast("string")).alias("content"),
        F.when(failed, F.concat(F.lit("bridge error "), F.repeat(F.lit("x"), (F.col("event_id") % 200).cast("int")))).alias("error"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents, blank ones included, numbered from 0."""
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value")
    )


def suggestion_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text runs from line items: the order is the document, the line its paragraph."""
    li = read_table(spark, sf_dir, "lineitem")
    sid = F.concat(F.lit("s-"), (F.col("l_linenumber") % 2).cast("string"))
    ids = F.array(sid)
    none = F.expr("cast(array() as array<string>)")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    run = lambda pos, text, i, d: F.struct(
        F.lit(pos).alias("pos"), text.alias("text"), i.alias("ins_ids"), d.alias("del_ids")
    )
    word = F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit(" "))
    runs = F.array(
        run(0, F.concat(F.lit("line "), F.col("l_suppkey").cast("string")), none, none),
        run(1, word, F.when(flag != "R", ids).otherwise(none), none),
        run(2, F.concat(flag, status), none, F.when(status == "O", ids).otherwise(none)),
        run(3, F.lit(" both "), F.when(flag == "A", ids).otherwise(none), F.when(flag == "A", ids).otherwise(none)),
    )
    return li.select(
        F.col("l_orderkey").alias("doc_id"),
        F.concat_ws(
            "-",
            F.lpad(F.col("l_linenumber").cast("string"), 2, "0"),
            F.lpad(F.col("l_partkey").cast("string"), 9, "0"),
            F.lpad(F.col("l_suppkey").cast("string"), 9, "0"),
            F.date_format("l_shipdate", "yyyy-MM-dd"),
        ).alias("para"),
        F.explode(runs).alias("r"),
    ).select("doc_id", "para", "r.*")


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit entries from orders, in append order of the order key."""
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("actor"),
        F.col("o_orderstatus").alias("action"),
        F.col("o_orderpriority").alias("resource"),
        F.concat(F.lit("tenant-"), (F.col("o_custkey") % 7).cast("string")).alias("tenant_id"),
        F.when(F.col("o_orderkey") % 10 == 0, "denied").otherwise("success").alias("result"),
    )


def land_pages(pages: DataFrame, path: str) -> str:
    """Write texts (page, value) as a folder per page, which ``PageFolder`` polls; pages must be few."""
    pages.repartition("page").write.mode("append").partitionBy("page").text(path)
    return path


def append_lines(lines: DataFrame, path: str, lead: str = "", end: str = "\n", cut: bool = False) -> None:
    """Append each bucket's lines (bucket, value) to its log file; ``cut`` empties the files first."""
    import os

    folder = path.removeprefix("file://")
    os.makedirs(folder, exist_ok=True)

    def append(rows) -> None:
        texts: dict[int, list[str]] = {}
        for r in rows:
            texts.setdefault(r["bucket"], []).append(r["value"])
        for bucket, own in texts.items():
            with open(os.path.join(folder, f"bucket-{bucket}.log"), "w" if cut else "a", encoding="utf-8") as f:
                f.write(lead + "\n".join(own) + end)

    lines.repartition("bucket").foreachPartition(append)
