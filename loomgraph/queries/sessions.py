"""Questions, answers and sessions: the conversations table as the service's log."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.queries._registry import query
from loomgraph.session import table


@query("o3_sessions", "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY 1 ORDER BY last_turn DESC, conv_id")
def o3(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn")).orderBy(F.desc("last_turn"), "conv_id")


@query("o4_session_detail", "SELECT conv_id, turn, role, length(text) AS size FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) >= 3)")
def o4(spark, d):
    c = table(spark, d, "conversations")
    return c.join(c.groupBy("conv_id").count().filter("count >= 3"), "conv_id", "left_semi").select("conv_id", "turn", "role", F.length("text").alias("size"))


@query("o6_last_feedback", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def o6(spark, d):
    last = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return last.select("user_id", "event_type", "value")


@query("o7_message_counts", "SELECT conv_id, CAST(count(*) FILTER (role = 'assistant') * 2 AS BIGINT) AS message_count FROM conversations GROUP BY 1")
def o7(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg((F.count_if(F.col("role") == "assistant") * 2).alias("message_count"))


@query("w6_last_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS rn FROM conversations) WHERE rn <= 10")
def w6(spark, d):
    rn = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text"))
    return table(spark, d, "conversations").withColumn("rn", rn).filter("rn <= 10").select("conv_id", "turn", "role")


@query("o10_prompts", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS prompt FROM conversations GROUP BY 1")
def o10(spark, d):
    lines = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    prompt = F.array_join(F.transform(lines, lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    return table(spark, d, "conversations").groupBy("conv_id").agg(prompt.alias("prompt"))


@query("o2_event_properties", "SELECT event_id, json_extract_string(props, '$.k') AS k, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def o2(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))
