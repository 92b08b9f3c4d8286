"""Views that give the sample tables the shape of the runtime's tables.

`SQL` holds the same views as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import shard_of

SHARDS = 300
AS_OF = "2024-01-20 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    entity = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    return e.select(
        F.col("event_id").alias("request_id"),
        F.lit("default").alias("shard_group"),
        shard_of(entity, SHARDS).alias("shard_id"),
        F.lit("User").alias("entity_type"),
        entity.alias("entity_id"),
        F.col("event_type").alias("tag"),
        F.col("props").alias("headers"),
        (F.col("event_type") == "signup").alias("processed"),
        (F.col("event_id") % 5).cast("int").alias("retry_count"),
        F.col("ts").alias("created_at"),
        F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.make_dt_interval(days=(F.col("event_id") % 7).cast("int"))).alias("deliver_at"),
        F.when(F.col("event_id") % 2 != 0, F.col("ts")).alias("last_read"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as replies: the finished last line of an order is its exit, by a negative id for every tenth."""
    li = table(spark, sf_dir, "lineitem")
    once = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_linestatus").alias("s"), F.min("l_shipdate").alias("at"), F.min("l_partkey").alias("p"))
    last = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last"))
    exit_ = (F.col("s") == "F") & (F.col("l_linenumber") == F.col("last"))
    raw = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return once.join(last, "l_orderkey").select(
        F.when(exit_ & (F.col("l_orderkey") % 10 == 0), -F.col("l_orderkey")).otherwise(raw).alias("id"),
        F.col("l_orderkey").alias("request_id"),
        F.when(exit_, 2147483647).otherwise(F.col("l_linenumber") - 1).cast("int").alias("sequence"),
        F.col("p").cast("string").alias("payload"),
        exit_.alias("is_exit"),
        F.col("at").alias("created_at"),
    )


def runners(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_name").alias("host"), F.lit(9000).alias("port"), (F.col("s_suppkey") % 4).cast("int").alias("weight"), (F.col("s_acctbal") >= 0).alias("healthy"), F.col("s_suppkey").alias("position"))


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The even shards."""
    return spark.range(0, SHARDS, 2).select(F.lit("default").alias("shard_group"), F.col("id").cast("int").alias("shard_id"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as messages that arrive more than once: key (orderkey, linenumber)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


ARRIVAL_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    delta = F.when(F.col("o_orderstatus") == "F", -1).when(F.col("o_orderstatus") == "O", 2).otherwise(0)
    return o.select(F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("entity_id"), "o_orderkey", F.col("o_orderdate").alias("at"), delta.cast("long").alias("delta"), (F.col("o_orderkey") % 50 == 0).alias("reset"))


def timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("workflow_name"),
        F.col("o_custkey").cast("string").alias("execution_id"),
        F.concat(F.lit("t"), (F.col("o_orderkey") % 5).cast("string")).alias("timer_name"),
        F.col("o_orderdate").alias("fire_at"),
        F.col("o_orderkey").alias("seq"),
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turn of each role in a conversation, under conv/role."""
    c = table(spark, sf_dir, "conversations")
    key = F.concat_ws("/", F.col("conv_id").cast("string"), "role")
    at = F.timestamp_add("MINUTE", F.col("conv_id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    last = c.groupBy("conv_id", "role").agg(F.max_by("text", "turn").alias("value"), F.max("turn").alias("turn"))
    return last.select(key.alias("key"), "value", F.timestamp_add("SECOND", F.col("turn").cast("int"), at).alias("updated_at"), F.when(F.col("conv_id") % 3 == 0, at).alias("completed_at"))


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 20).alias("runner"), "ts", F.col("event_id"), (F.col("event_type") != "error").alias("healthy"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks of a stream that arrive out of order; every ninth conversation misses a turn, some repeat one."""
    c = table(spark, sf_dir, "conversations").filter("not (conv_id % 9 = 4 and turn = 1)")
    base = c.select(F.col("conv_id").alias("request_id"), F.col("turn").cast("int").alias("sequence"), F.array("role").alias("values"), ((F.col("turn") * 7 + F.col("conv_id")) % 5 * 100 + F.col("turn")).alias("arrival"))
    again = c.filter("conv_id % 4 = 1 and turn = 1").select(F.col("conv_id").alias("request_id"), F.col("turn").cast("int").alias("sequence"), F.array(F.lit("again")).alias("values"), F.lit(250).cast("long").alias("arrival"))
    return base.unionByName(again)


def _shard(text: str) -> str:
    return f"(list_reduce(list_prepend(5381::UBIGINT, list_transform(string_split({text}, ''), lambda c: ord(c)::UBIGINT)), lambda a, b: (a * 33 + b) % 4294967296) % {SHARDS})::INTEGER"


SQL = {
    "messages": f"""SELECT event_id AS request_id, 'default' AS shard_group, {_shard("'user-' || user_id")} AS shard_id, 'User' AS entity_type, 'user-' || user_id AS entity_id,
      event_type AS tag, props AS headers, event_type = 'signup' AS processed, (event_id % 5)::INTEGER AS retry_count, ts AS created_at,
      CASE WHEN event_id % 3 <> 0 THEN ts + to_days((event_id % 7)::INTEGER) END AS deliver_at, CASE WHEN event_id % 2 <> 0 THEN ts END AS last_read FROM events""",
    "replies": """SELECT CASE WHEN e AND k % 10 = 0 THEN -k ELSE k * 10 + n END AS id, k AS request_id, (CASE WHEN e THEN 2147483647 ELSE n - 1 END)::INTEGER AS sequence,
      p::VARCHAR AS payload, e AS is_exit, made AS created_at FROM (
        SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p, min(l_shipdate) AS made,
               min(l_linestatus) = 'F' AND l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) AS e FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "runners": "SELECT s_name AS host, 9000 AS port, (s_suppkey % 4)::INTEGER AS weight, s_acctbal >= 0 AS healthy, s_suppkey AS position FROM supplier",
    "owned": f"SELECT 'default' AS shard_group, range::INTEGER AS shard_id FROM range(0, {SHARDS}, 2)",
    "transfers": "SELECT 'c-' || o_custkey AS entity_id, o_orderkey, o_orderdate AS made, (CASE o_orderstatus WHEN 'F' THEN -1 WHEN 'O' THEN 2 ELSE 0 END)::BIGINT AS delta, o_orderkey % 50 = 0 AS reset FROM orders",
    "timers": "SELECT o_orderpriority AS workflow_name, o_custkey::VARCHAR AS execution_id, 't' || (o_orderkey % 5) AS timer_name, o_orderdate AS fire_at, o_orderkey AS seq FROM orders",
    "journal": """SELECT conv_id || '/' || role AS key, arg_max(text, turn) AS value, TIMESTAMP '2024-01-01' + to_minutes(conv_id::INTEGER) + to_seconds(max(turn)) AS updated_at,
      CASE WHEN conv_id % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_minutes(conv_id::INTEGER) END AS completed_at FROM conversations GROUP BY conv_id, role""",
    "health": "SELECT user_id % 20 AS runner, ts, event_id, event_type <> 'error' AS healthy FROM events",
    "chunks": """SELECT conv_id AS request_id, turn::INTEGER AS sequence, role AS value, (turn * 7 + conv_id) % 5 * 100 + turn AS arrival FROM conversations WHERE NOT (conv_id % 9 = 4 AND turn = 1)
      UNION ALL SELECT conv_id, turn::INTEGER, 'again', 250 FROM conversations WHERE NOT (conv_id % 9 = 4 AND turn = 1) AND conv_id % 4 = 1 AND turn = 1""",
}


def with_views(body: str, *ctes: str, names: list[str] | None = None) -> str:
    """A DuckDB statement over the views that `body` and `ctes` mention."""
    text = " ".join([body, *ctes])
    used = [n for n in SQL if n in text] if names is None else names
    held = [*(f"{n} AS ({SQL[n]})" for n in used), *ctes]
    return ("WITH " + ",\n".join(held) + "\n" if held else "") + body
