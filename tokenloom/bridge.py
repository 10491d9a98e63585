"""The driver's tables seen as session logs, so every operator runs on them.

Each function is a projection of one table: which column plays the session,
the record number, the size and so on.  Nothing is sampled or cut.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.usage import cached_split, usage_struct
from tokenloom.plans.scan import dense_number
from tokenloom.schema import AGENT_GRAPH, AGENT_LINEAR, COMPACTION, TOOL_OP
from tokenloom.sources.events import conform

TOOLS = ["shell", "read", "edit", "search"]
MECHANISMS = ["base_instructions", "nested_memory", "skill", "context_compaction", "additional_tools"]

#: Rows of one task where every row costs much.
SPREAD_ROWS = 65_536


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table for heavy per-row work: dealt out where one split holds more than two tasks' share of the rows.

    Row groups are not split, so a file may have many splits and all its rows in one of
    them.  Rows are counted from the footers.
    """
    df = read(spark, sf_dir, table)
    splits = df.groupBy(F.spark_partition_id()).count()
    rows, most = splits.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(rows / SPREAD_ROWS))
    return df.repartition(tasks) if most * tasks > 2 * rows else df


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as straight-log sessions, one per user.

    purchase = token report, signup = compaction, click = tool call, error =
    tool result (failed for even k, unknown record for k ending in 9), view =
    message / reasoning / injection / turn start by k.
    """
    e = read_spread(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = (
        F.when(F.col("event_type") == "purchase", "token_report")
        .when(F.col("event_type") == "signup", "compacted")
        .when(F.col("event_type") == "click", "tool_call")
        .when((F.col("event_type") == "error") & (k % 10 == 9), "unrecognised")
        .when(F.col("event_type") == "error", "tool_result")
        .when(k % 5 == 0, "turn_started")
        .when(k % 5 == 1, "message")
        .when(k % 5 == 2, "message")
        .when(k % 5 == 3, "reasoning")
        .otherwise("context_injection")
    )
    size = F.round(F.col("value") * 10).cast("bigint")
    big = F.round(F.col("value") * 1000).cast("bigint")
    fresh, cached = cached_split(F.when(k % 17 != 0, big), F.when(k % 7 != 0, k * 900))
    df = (
        e.withColumn("k", k)
        .withColumn("kind", kind)
        .select(
            F.lit(AGENT_LINEAR).alias("agent"),
            F.col("user_id").cast("string").alias("session_id"),
            F.col("event_id").alias("seq"),
            (F.col("event_id") + 1).alias("line_no"),
            (F.col("event_id") * 8192).alias("byte_offset"),
            (size + 100).alias("byte_len"),
            F.when(k % 23 != 0, F.col("ts")).alias("ts"),
            F.when(F.col("kind") == "unrecognised", F.concat(F.lit("future_"), k.cast("string")))
            .otherwise(F.col("kind"))
            .alias("raw_type"),
            "kind",
            F.when(F.col("kind") == "message", F.when(k % 5 == 1, "user").otherwise("assistant")).alias("role"),
            F.when(F.col("kind") == "message", F.concat(F.lit("p"), k.cast("string"))).alias("preview"),
            F.when(
                F.col("kind").isin("message", "reasoning", "tool_call", "tool_result", "context_injection"), size
            ).alias("char_len"),
            F.when(F.col("kind") == "reasoning", k % 2 == 0).alias("redacted"),
            F.when(F.col("kind") == "tool_call", F.element_at(F.array(*map(F.lit, TOOLS)), (k % 4 + 1).cast("int"))).alias("tool"),
            F.when(F.col("kind").isin("tool_call", "tool_result") & (k % 19 != 0), F.concat(F.lit("c"), (k % 20).cast("string"))).alias("call_id"),
            F.when((F.col("kind") == "tool_call") & (k % 3 != 0), F.concat(F.lit("f"), (k % 6).cast("string"), F.lit(".py"))).alias("target"),
            F.when(F.col("kind") == "tool_result", k % 2 == 0).alias("is_error"),
            F.when(F.col("kind") == "context_injection", F.element_at(F.array(*map(F.lit, MECHANISMS)), (F.floor(k / 5) % 5 + 1).cast("int"))).alias("mechanism"),
            F.when(F.col("kind") == "context_injection", F.concat(F.lit("dir/l"), (k % 3).cast("string"))).alias("label"),
            F.when(
                F.col("kind") == "compacted",
                F.struct(
                    F.when(k % 2 == 0, "auto").otherwise("manual").alias("trigger"),
                    F.when(k % 3 != 0, k * 1000).alias("tokens_before"),
                    F.when(k % 7 != 0, k * 300 + 9000).alias("tokens_after"),
                    F.lit(None).cast("bigint").alias("cumulative_dropped"),
                    (k * 11).alias("duration_ms"),
                    (k % 2 == 0).alias("replacement_recorded"),
                ),
            ).cast(COMPACTION).alias("compaction"),
            F.when(
                F.col("kind") == "token_report",
                usage_struct(
                    input=fresh,
                    cache_read=cached,
                    output=F.when(k % 29 != 0, k * 7 + 1),
                    reasoning=k % 5,
                    context_window=F.when(k % 3 != 0, F.lit(250000) + k * 1000),
                    api_calls=F.when(k % 31 == 0, 3).otherwise(1),
                ),
            ).alias("usage"),
            F.when((F.col("kind") == "turn_started") & (k % 4 != 0), F.concat(F.lit("model-"), (k % 3).cast("string"))).alias("model"),
        )
    )
    df = df.withColumn(
        "tool_ops",
        F.when(
            F.col("kind").isin("tool_call", "tool_result"),
            F.array(F.struct(F.col("kind").alias("op"), "tool", "call_id", "char_len", "target", "is_error")),
        )
        .otherwise(F.array())
        .cast(f"array<{TOOL_OP.simpleString()}>"),
    )
    return conform(df)


def graph_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as graph-log sessions: record n hangs below record n - 1 - (k mod 3).

    purchase = response record (with usage unless k is a multiple of 9), view =
    prompt, click = injection, error = tool result, signup = compaction for
    multiples of 8, else a notice.  Every 13th k is a side thread.
    """
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    numbered = dense_number(
        e.select("user_id", "event_id", "event_type", "value", "ts", "k"), ["user_id"], "event_id"
    )
    k, n = F.col("k"), F.col("n")
    parent = n - 1 - k % 3
    assistant = F.col("event_type") == "purchase"
    kind = (
        F.when(assistant, "message")
        .when((F.col("event_type") == "signup") & (k % 8 == 0), "compacted")
        .when(F.col("event_type") == "signup", "session_event")
        .when(F.col("event_type") == "view", "message")
        .when(F.col("event_type") == "error", "tool_result")
        .otherwise("context_injection")
    )
    size = F.round(F.col("value") * 10).cast("bigint")
    return conform(
        numbered.select(
            F.lit(AGENT_GRAPH).alias("agent"),
            F.col("user_id").cast("string").alias("session_id"),
            F.col("event_id").alias("seq"),
            (F.col("event_id") + 1).alias("line_no"),
            (size + 100).alias("byte_len"),
            "ts",
            F.when(assistant, "assistant")
            .when(F.col("event_type") == "signup", "system")
            .when(F.col("event_type") == "click", "attachment")
            .otherwise("user")
            .alias("raw_type"),
            kind.alias("kind"),
            F.when(assistant, "assistant").when(F.col("event_type") == "view", "user").alias("role"),
            F.when(F.col("event_type") != "signup", size).alias("char_len"),
            F.when(F.col("event_type") == "error", F.concat(F.lit("c"), (k % 20).cast("string"))).alias("call_id"),
            F.when(F.col("event_type") == "click", F.when(k % 2 == 0, "nested_memory").otherwise("skill_listing")).alias("mechanism"),
            F.when(F.col("event_type") == "click", F.concat(F.lit("l"), (k % 3).cast("string"))).alias("label"),
            F.when(assistant, F.concat(F.lit("r"), F.floor(n / 3).cast("string"))).alias("request_id"),
            F.when(
                assistant & (k % 9 != 0),
                usage_struct(
                    input=F.when(k % 17 != 0, k + 1),
                    cache_creation=F.when(k % 5 != 0, k * 30),
                    cache_read=F.round(F.col("value") * 1000),
                    output=k * 7 + 1,
                    api_calls=F.lit(1),
                ),
            ).alias("usage"),
            F.when(assistant, F.when(k % 6 == 0, "<synthetic>").otherwise("model-a")).alias("model"),
            F.concat(F.lit("n"), n.cast("string")).alias("uuid"),
            F.when(parent >= 1, F.concat(F.lit("n"), parent.cast("string"))).alias("parent_uuid"),
            (k % 13 == 0).alias("is_sidechain"),
        )
    )


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as straight-log sessions.

    Every row is a message; an assistant row is followed by the token report of
    the request it answers.
    """
    c = read(spark, sf_dir, "conversations")
    size = F.length("text").cast("bigint")
    message = c.select(
        F.lit(AGENT_LINEAR).alias("agent"),
        F.col("conv_id").cast("string").alias("session_id"),
        (F.col("turn") * 2).alias("seq"),
        (F.col("turn") * 2 + 1).alias("line_no"),
        (size + 60).alias("byte_len"),
        F.lit("response_item/message").alias("raw_type"),
        F.lit("message").alias("kind"),
        "role",
        F.left("text", F.lit(160)).alias("preview"),
        size.alias("char_len"),
        F.col("text").alias("content"),
    )
    report = c.where(F.col("role") == "assistant").select(
        F.lit(AGENT_LINEAR).alias("agent"),
        F.col("conv_id").cast("string").alias("session_id"),
        (F.col("turn") * 2 + 1).alias("seq"),
        (F.col("turn") * 2 + 2).alias("line_no"),
        F.lit(120).alias("byte_len"),
        F.lit("event_msg/token_count").alias("raw_type"),
        F.lit("token_report").alias("kind"),
        usage_struct(
            input=(F.col("conv_id") * 37 + F.col("turn") * 211) % 900,
            cache_read=F.lit(0),
            output=F.col("turn") + 1,
            context_window=F.lit(1000),
            api_calls=F.lit(1),
        ).alias("usage"),
    )
    return conform(message).unionByName(conform(report))


def log_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory of the sessions in ``events``: one row per user."""
    events = log_events(spark, sf_dir)
    report = F.when(F.col("usage.context_window").isNotNull(), F.col("seq"))
    started = F.when((F.col("kind") == "turn_started") & F.col("model").isNotNull(), F.col("seq"))
    user = F.col("session_id").cast("bigint")
    return (
        events.groupBy("agent", "session_id")
        .agg(
            F.min_by("usage.context_window", report).alias("context_window"),
            F.min_by("model", started).alias("model"),
            F.min("ts").alias("started_at"),
            F.max("ts").alias("last_activity"),
            F.sum("byte_len").alias("size_bytes"),
        )
        .withColumn("project", F.when(user % 11 != 0, F.concat(F.lit("/work/p"), (user % 14).cast("string"))))
        .withColumn("path", F.concat(F.lit("/logs/"), (user % 5).cast("string"), F.lit("/s"), F.col("session_id"), F.lit(".jsonl")))
    )


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests: the customer is the session, the priority the model."""
    flag = F.col("l_returnflag")
    lines = (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.sum(F.when(flag == "A", F.round("l_quantity").cast("bigint"))).alias("qa"),
            F.sum(F.when(flag == "R", F.round("l_quantity").cast("bigint"))).alias("qr"),
            F.sum(F.when(flag == "N", F.round("l_quantity").cast("bigint"))).alias("qn"),
            F.count(F.lit(1)).alias("lines"),
        )
    )
    o = F.col("o_orderkey")
    zero = F.lit(0)
    return (
        read(spark, sf_dir, "orders")
        .join(lines, "o_orderkey")
        .select(
            F.when(F.col("o_custkey") % 2 == 0, AGENT_GRAPH).otherwise(AGENT_LINEAR).alias("agent"),
            F.col("o_custkey").cast("string").alias("session_id"),
            o.alias("turn"),
            F.when(o % 29 != 0, F.col("o_orderdate")).cast("timestamp").alias("ts"),
            F.when(o % 37 != 0, F.col("o_orderpriority")).alias("model"),
            usage_struct(
                input=F.when(o % 31 != 0, F.coalesce("qa", zero) * 100),
                cache_read=F.when(o % 23 != 0, F.coalesce("qr", zero) * 100),
                cache_creation=F.when(o % 19 != 0, F.coalesce("qn", zero) * 10),
                output=F.col("lines") * 50,
                api_calls=F.when(o % 41 == 0, 2).otherwise(1),
            ).alias("usage"),
        )
    )


def price_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``nation`` as five catalog revisions of five models: (snapshots, revisions)."""
    n = F.col("n_nationkey").cast("bigint")
    revision = F.floor(n / 5).cast("bigint")
    name = F.element_at(F.array(*map(F.lit, PRIORITIES)), (n % 5 + 1).cast("int"))
    dollars = lambda rate: (rate / F.lit(1e12))
    entry = F.to_json(
        F.struct(
            F.when(n % 12 == 11, "embedding").otherwise("chat").alias("mode"),
            dollars(3000000 + n * 10000).alias("input_cost_per_token"),
            dollars(15000000 + n * 50000).alias("output_cost_per_token"),
            F.when(n % 7 != 0, dollars(300000 + n * 1000)).alias("cache_read_input_token_cost"),
            dollars(3750000 + n * 12500).alias("cache_creation_input_token_cost"),
            F.when(n % 2 == 0, dollars(6000000 + n * 10000)).alias("input_cost_per_token_above_2k_tokens"),
            F.when(n % 4 == 0, dollars(9000000 + n * 10000)).alias("input_cost_per_token_above_6000_tokens"),
        )
    )
    rows = read(spark, sf_dir, "nation").select(
        F.sha1(F.concat(F.lit("rev"), revision.cast("string"))).alias("sha"),
        revision.alias("rev"),
        F.concat(F.lit('"'), F.lower(name), F.lit('":'), entry).alias("member"),
    )
    snapshots = rows.groupBy("sha").agg(
        F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("member")), ","), F.lit("}")).alias("body")
    )
    revisions = rows.select(
        "sha", F.timestamp_add("DAY", F.col("rev") * 700, F.lit("1994-03-01 06:00:00").cast("timestamp")).alias("recorded_at")
    ).distinct()
    return snapshots, revisions


def contract_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``region`` as contract prefixes of growing length."""
    r = F.col("r_regionkey").cast("bigint")
    return read(spark, sf_dir, "region").select(
        F.lit("v1").alias("version"),
        F.lit("contract").alias("source"),
        F.element_at(F.array(*map(F.lit, ["2", "2-h", "2-hi", "4-not", "9"])), (r + 1).cast("int")).alias("model_prefix"),
        (1000000 + r * 1000).alias("input_rate"),
        (5000000 + r * 1000).alias("output_rate"),
        (100000 + r * 1000).alias("cache_read_rate"),
        (1250000 + r * 1000).alias("cache_write_rate"),
    )


# ---------------------------------------------------------------------------
# Raw log lines: the same tables written in the agents' own JSON vocabulary
# ---------------------------------------------------------------------------


def _lines(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add the position columns of single-file sessions; offsets are not modelled."""
    return df.withColumn("byte_len", F.octet_length(raw).cast("bigint")).withColumn(
        "byte_offset", F.lit(None).cast("bigint")
    )


def graph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as graph-log JSON: prompts, results, responses and attachments.

    Conversations 0 mod 10 lose the end of every third record, 5 mod 10 name an
    unknown type there.
    """
    c = read_spread(spark, sf_dir, "conversations")
    conv, t = F.col("conv_id"), F.col("turn")
    turn = t.cast("string")
    block = lambda **f: F.struct(*[v.alias(k) for k, v in f.items()])
    result = block(
        type=F.lit("user"),
        message=block(
            role=F.lit("user"),
            content=F.array(
                block(
                    type=F.lit("tool_result"),
                    tool_use_id=F.concat(F.lit("t"), (t - 1).cast("string")),
                    is_error=conv % 4 == 0,
                    content=F.array(block(type=F.lit("text"), text=F.col("text"))),
                )
            ),
        ),
    )
    links = dict(
        uuid=F.concat(F.lit("u"), turn),
        parentUuid=F.when(t > 0, F.concat(F.lit("u"), (t - 1).cast("string"))),
        isSidechain=conv % 7 == 3,
        timestamp=F.concat(F.lit("2026-01-0"), (t % 9 + 1).cast("string"), F.lit("T00:00:00.000Z")),
        cwd=F.lit("/work/demo"),
        gitBranch=F.lit("main"),
        version=F.lit("2.1.0"),
    )
    prompt = block(type=F.lit("user"), message=block(role=F.lit("user"), content=F.col("text")))
    usage = block(
        input_tokens=conv % 50,
        cache_creation_input_tokens=F.when(t % 3 != 0, conv * 3),
        cache_read_input_tokens=t * 100,
        output_tokens=t + 7,
        iterations=F.when(
            conv % 6 == 0,
            F.array(
                block(input_tokens=conv % 50, cache_creation_input_tokens=F.lit(1), cache_read_input_tokens=t * 50),
                block(input_tokens=conv % 50 + 1, cache_creation_input_tokens=F.lit(0), cache_read_input_tokens=t * 50),
            ),
        ),
    )
    answer = block(
        type=F.lit("assistant"),
        requestId=F.concat(F.lit("req"), F.floor(t / 4).cast("string")),
        message=block(
            role=F.lit("assistant"),
            model=F.when(conv % 9 == 0, "<synthetic>").otherwise("model-x"),
            content=F.array(
                block(
                    type=F.when(conv % 5 == 1, "thinking").otherwise("text"),
                    text=F.when(conv % 5 != 1, F.col("text")),
                    thinking=F.when(conv % 5 == 1, ""),
                    signature=F.when(conv % 5 == 1, F.repeat(F.lit("S"), (conv % 90 + 10).cast("int"))),
                    id=F.lit(None).cast("string"),
                    name=F.lit(None).cast("string"),
                    input=F.lit(None).cast("struct<file_path:string,n:bigint>"),
                ),
                block(
                    type=F.when(t % 4 == 1, "tool_use").otherwise("text"),
                    text=F.when(t % 4 != 1, F.when(conv % 5 != 1, "tail")),
                    thinking=F.lit(None).cast("string"),
                    signature=F.lit(None).cast("string"),
                    id=F.when(t % 4 == 1, F.concat(F.lit("t"), turn)),
                    name=F.when(t % 4 == 1, F.lit("Read")),
                    input=F.when(t % 4 == 1, F.struct(F.concat(F.lit("src/a"), turn, F.lit(".py")).alias("file_path"), conv.alias("n"))),
                ),
            ),
            usage=usage,
        ),
    )
    note = block(
        type=F.lit("attachment"),
        attachment=block(
            type=F.when(conv % 2 == 0, "nested_memory").otherwise("skill_listing"),
            displayPath=F.when(conv % 2 == 0, F.lit("docs/RULES.md")),
            content=F.col("text"),
        ),
    )
    tail = F.to_json(F.struct(*[v.alias(k) for k, v in links.items()]))
    head = (
        F.when(F.col("role") == "assistant", F.to_json(answer))
        .when(F.col("role") == "system", F.to_json(note))
        .when(t % 4 == 2, F.to_json(result))
        .otherwise(F.to_json(prompt))
    )
    whole = F.concat(F.left(head, F.length(head) - 1), F.lit(","), tail.substr(F.lit(2), F.length(tail)))
    third = t % 3 == 2
    raw = (
        F.when((conv % 10 == 0) & third, F.left(whole, F.lit(40)))
        .when((conv % 10 == 5) & third, F.concat(F.lit('{"type":"some-future-type","uuid":"x'), turn, F.lit('"}')))
        .otherwise(whole)
    )
    return _lines(
        c.select(conv.cast("string").alias("session_id"), (t + 1).alias("line_no"), raw.alias("raw"))
    )


def linear_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as straight-log JSON, one session per user."""
    e = read_spread(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    k = F.col("k")
    ks = k.cast("string")
    size = F.round(F.col("value") * 10).cast("bigint")
    big = F.round(F.col("value") * 1000).cast("bigint")
    fill = F.repeat(F.lit("x"), size.cast("int"))
    num = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    usage = cat(
        '{"type":"token_count","info":{"last_token_usage":{"input_tokens":', num(F.when(k % 17 != 0, big)),
        ',"cached_input_tokens":', num(F.when(k % 7 != 0, k * 900)), ',"output_tokens":', num(k * 7 + 1),
        ',"reasoning_output_tokens":', num(k % 5), '},"total_token_usage":{"input_tokens":999999999},"model_context_window":',
        num(F.when(k % 3 != 0, F.lit(250000) + k * 1000)), "}}",
    )
    compacted = cat(
        '{"message":"m"', F.when(k % 2 == 0, ',"replacement_history":[{"type":"message","role":"user"}]').otherwise(""), "}"
    )
    call = cat(
        '{"type":"function_call","name":"shell","call_id":"c', (k % 20).cast("string"),
        '","arguments":"{\\"command\\":[\\"run\\",\\"f', (k % 6).cast("string"), '.py\\"],\\"pad\\":\\"', fill, '\\"}"}',
    )
    shown = cat('[{"type":"input_image","image_url":"data:image/png;base64,', fill, '"},{"type":"input_text","text":"t', ks, '"}]')
    result = cat(
        '{"type":"function_call_output","call_id":"c', (k % 20).cast("string"), '","status":"',
        F.when(k % 2 == 0, "failed").otherwise("completed"), '","output":',
        F.when(k % 5 == 0, shown).otherwise(cat('"', fill, '"')), "}",
    )
    spoken = cat(
        '{"type":"message","role":"', F.when(k % 5 == 1, "user").otherwise("assistant"),
        '","content":[{"type":"input_text","text":"p', ks, '"},{"type":"output_text","text":"', fill, '"}]}',
    )
    thought = cat(
        '{"type":"reasoning","summary":[{"type":"summary_text","text":"', fill, '"}]',
        F.when(k % 2 == 0, ',"encrypted_content":"yyyyyyyyyy"').otherwise(""), "}",
    )
    tools = cat('{"type":"additional_tools","tools":[{"name":"', fill, '"}]}')
    meta = cat('{"id":"i","cwd":"/work/p","cli_version":"1","base_instructions":{"text":"', fill, '"}}')
    started = cat('{"cwd":"/work"', F.when(k % 4 != 0, cat(',"model":"model-', (k % 3).cast("string"), '"')).otherwise(""), "}")
    notice = cat('{"type":"', F.when(k % 3 == 0, "task_started").otherwise("unheard_of"), '"}')
    view = k % 7
    kind = F.col("event_type")
    outer, payload = F.lit("event_msg"), notice
    for cond, o, body in [
        (kind == "purchase", "event_msg", usage),
        (kind == "signup", "compacted", compacted),
        (kind == "click", "response_item", call),
        ((kind == "error") & (k % 10 == 9), "event_msg", notice),
        (kind == "error", "response_item", result),
        (view == 0, "turn_context", started),
        (view.isin(1, 2), "response_item", spoken),
        (view == 3, "response_item", thought),
        (view == 4, "response_item", tools),
        (view == 5, "session_meta", meta),
    ][::-1]:
        outer, payload = F.when(cond, o).otherwise(outer), F.when(cond, body).otherwise(payload)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    raw = cat('{"timestamp":"', stamp, '","type":"', outer, '","payload":', payload, "}")
    return _lines(
        e.select(
            F.col("user_id").cast("string").alias("session_id"), (F.col("event_id") + 1).alias("line_no"), raw.alias("raw")
        )
    )


def line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as the lines of log files of bounded length: (file, n, line).

    Every tenth k leaves a blank line, every seventh ends in CR LF.
    """
    k = F.get_json_object("props", "$.k").cast("bigint")
    n = F.col("event_id")
    body = F.concat(F.lit('{"type":"x","n":'), n.cast("string"), F.lit(',"s":"é"}'))
    return read(spark, sf_dir, "events").select(
        F.concat_ws("-", (F.col("user_id") % 40).cast("string"), F.floor(n / 65536).cast("string")).alias("file"),
        n.alias("n"),
        F.when(k % 10 == 0, "").when(k % 7 == 0, F.concat(body, F.lit("\r"))).otherwise(body).alias("line"),
    )


def linear_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as the heads of straight logs, three lines each, in read order."""
    c = read_spread(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = F.concat(F.lit("rollout-2026-01-01-"), F.lit("aaaaaaaa-bbbb-cccc-dddd-"), F.lpad(k.cast("string"), 12, "0"))
    stem = F.when(k % 4 == 3, F.concat(F.lit("short"), k.cast("string"))).otherwise(name)
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    opt = lambda cond, key, c: F.when(cond, F.concat(F.lit(f',"{key}":'), q(c))).otherwise("")
    meta = F.concat(
        F.lit('{"timestamp":"2026-01-02T03:04:05Z","type":"session_meta","payload":{"cwd":"/work/n'),
        F.col("c_nationkey").cast("string"), F.lit('"'),
        opt(k % 4 == 0, "id", F.concat(F.lit("id"), k.cast("string"))),
        opt(k % 4 == 1, "session_id", F.concat(F.lit("sid"), k.cast("string"))),
        opt(k % 3 == 0, "thread_source", F.lit("subagent")),
        opt(k % 6 == 0, "parent_thread_id", F.concat(F.lit("id"), F.floor(k / 8 * 1).cast("string"))),
        F.lit(',"git":{"branch":"b'), (k % 5).cast("string"), F.lit('"}}}'),
    )
    said = lambda text: F.concat(
        F.lit('{"type":"response_item","payload":{"type":"message","role":"user","content":[{"type":"input_text","text":"'), text, F.lit('"}]}}')
    )
    second = said(F.when(k % 3 == 0, "<environment_context> x of the work").when(k % 3 == 1, "too short").otherwise(F.concat(F.lit("First  real   prompt of "), F.col("c_name"))))
    third = said(F.concat(F.lit("Then please "), F.repeat(F.lit("look again "), (k % 20).cast("int")), F.col("c_mktsegment")))
    return c.select(
        F.concat(F.lit("/sessions/"), stem, F.lit(".jsonl")).alias("path"),
        F.lit(0).cast("bigint").alias("block"),
        F.posexplode(F.array(meta, second, third)).alias("rid", "raw"),
    ).select(
        "path",
        "block",
        F.col("rid").cast("bigint").alias("rid"),
        F.lit(5000).cast("bigint").alias("file_size"),
        F.lit("2026-02-01").cast("timestamp").alias("modified"),
        (F.octet_length("raw") + 1).cast("bigint").alias("framed_bytes"),
        "raw",
    )


def graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph-log lines of ``conversations`` placed in files; every fourth is a subagent's."""
    conv = F.col("session_id").cast("bigint")
    name = F.concat(F.lit("c"), F.col("session_id"), F.lit(".jsonl"))
    folder = F.when(conv % 4 == 3, F.concat(F.lit("/home/projects/-work-demo/c"), (conv - 1).cast("string"), F.lit("/subagents/"))).otherwise("/home/projects/-work-demo/")
    return graph_lines(spark, sf_dir).select(
        F.concat(folder, name).alias("path"),
        F.lit(0).cast("bigint").alias("block"),
        F.col("line_no").alias("rid"),
        F.lit(9000).cast("bigint").alias("file_size"),
        F.lit("2026-02-01").cast("timestamp").alias("modified"),
        (F.col("byte_len") + 1).alias("framed_bytes"),
        "raw",
    )


def customer_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as a session inventory; every fifth is a branch of another one."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    ks = k.cast("string")
    folder = (
        F.when(k % 9 == 0, F.lit(None).cast("string"))
        .when(k % 10 == 1, F.concat(F.lit("/tmp/run"), (k % 3).cast("string")))
        .when(k % 10 == 2, F.concat(F.lit("C:\\Users\\Ann\\AppData\\Local\\Temp\\w"), (k % 3).cast("string")))
        .when(k % 10 == 3, F.concat(F.lit("/home/x/../../var/tmp/z/./"), (k % 2).cast("string")))
        .otherwise(F.concat(F.lit("/work/nation"), F.col("c_nationkey").cast("string"), F.lit("/")))
    )
    branch = (k % 5 == 0) & (k > 0)
    return c.select(
        F.when(k % 2 == 0, AGENT_GRAPH).otherwise(AGENT_LINEAR).alias("agent"),
        F.concat(F.lit("S"), ks).alias("session_id"),
        F.concat(F.lit("/logs/"), ks, F.lit(".jsonl")).alias("path"),
        F.floor("c_acctbal").cast("bigint").alias("size_bytes"),
        folder.alias("project"),
        F.when(k % 7 != 0, F.concat(F.lit("About "), F.col("c_mktsegment"))).alias("title"),
        F.concat(F.lit("b"), (k % 4).cast("string")).alias("git_branch"),
        F.when(k % 6 != 0, F.timestamp_add("HOUR", k * 7, F.lit("2026-01-01").cast("timestamp"))).alias("started_at"),
        F.when(k % 11 != 0, F.timestamp_add("HOUR", k * 13 % 2000, F.lit("2026-01-01").cast("timestamp"))).alias("last_activity"),
        F.when(branch, "subagent").otherwise("root").alias("thread_role"),
        F.when(branch, F.concat(F.lit("S"), F.when(k % 3 == 0, F.lit(99999999)).otherwise(F.floor(k / 20) * 2 + k % 2).cast("string"))).alias("parent_id"),
    )


def stream_lines(spark: SparkSession, sf_dir: str, surface: str) -> DataFrame:
    """``events`` as captured presentation streams, one file per user.

    Users 0 mod 17 mix two sessions; user 5 mod 17 names none.  Item ids repeat
    every 30 values of k.
    """
    e = read_spread(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    k, u = F.col("k"), F.col("user_id")
    ks = k.cast("string")
    sid = F.concat(F.lit("s"), F.when((u % 17 == 0) & (k % 50 == 1), u + 1).otherwise(u).cast("string"))
    fill = F.repeat(F.lit("y"), (k + 1).cast("int"))
    cat = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    kind = F.col("event_type")
    if surface == "codex-exec":
        thread = F.when(u % 17 == 5, "").otherwise(cat(',"thread_id":"', sid, '"'))
        item = F.when(
            k % 3 == 0, cat('{"id":"i', (k % 30).cast("string"), '","type":"agent_message","text":"', fill, '"}')
        ).when(
            k % 3 == 1, cat('{"id":"i', (k % 30).cast("string"), '","type":"command_execution","aggregated_output":"', fill, '","exit_code":', (k % 2).cast("string"), "}")
        ).otherwise(cat('{"id":"i', (k % 30).cast("string"), '","type":"strange"}'))
        raw = (
            F.when(kind == "signup", cat('{"type":"turn.completed","usage":{"input_tokens":', ks, '}', thread, "}"))
            .when(kind == "view", cat('{"type":"item.updated"', thread, "}"))
            .when(kind == "error", cat('{"type":"novel"', thread, "}"))
            .otherwise(cat('{"type":"item.completed","item":', item, thread, "}"))
        )
    elif surface == "codex-app-server":
        thread = F.when(u % 17 == 5, '"x":1').otherwise(cat('"threadId":"', sid, '"'))
        item = F.when(
            k % 2 == 0, cat('{"id":"i', (k % 30).cast("string"), '","type":"reasoning","summary":["', fill, '","zz"]}')
        ).otherwise(cat('{"id":"i', (k % 30).cast("string"), '","type":"userMessage","content":[{"type":"text","text":"', fill, '"},{"type":"text","text":"q"}]}'))
        raw = (
            F.when(kind == "signup", cat('{"method":"thread/tokenUsage/updated","params":{', thread, ',"tokenUsage":{"last":{"inputTokens":', ks, '},"total":{"inputTokens":9}}}}'))
            .when(kind == "view", cat('{"method":"item/started","params":{', thread, "}}"))
            .when(kind == "error", cat('{"id":', ks, ',"result":{}}'))
            .otherwise(cat('{"method":"item/completed","params":{', thread, ',"item":', item, "}}"))
        )
    else:
        ident = F.when(u % 17 == 5, "").otherwise(cat(',"session_id":"', sid, '"'))
        parent = F.when(k % 11 == 0, ',"parent_tool_use_id":"t9"').otherwise(',"parent_tool_use_id":null')
        raw = (
            F.when(kind == "signup", cat('{"type":"result","usage":{"input_tokens":', ks, "}", ident, "}"))
            .when(kind == "view", cat('{"type":"stream_event","event":{"type":"', F.when(k % 2 == 0, "ping").otherwise("odd"), '"}', ident, "}"))
            .when(kind == "error", cat('{"type":"system","subtype":"init","claude_code_version":"', F.when(u % 17 == 9, "1.0").otherwise("2.0"), '"', ident, "}"))
            .otherwise(
                cat(
                    '{"type":"assistant","request_id":"r', (k % 10).cast("string"), '"', parent, ident,
                    ',"message":{"role":"assistant","usage":{"input_tokens":', ks,
                    '},"content":[{"type":"text","text":"', fill, '"},{"type":"tool_use","id":"t', ks, '","name":"Read","input":{"file_path":"a.py"}}]}}',
                )
            )
        )
    return e.select(F.concat(F.lit("u"), u.cast("string")).alias("file"), (F.col("event_id") + 1).alias("line_no"), raw.alias("raw"))
