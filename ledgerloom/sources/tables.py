"""Readers and sinks of the runtime's tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import shard_of
from ..operators.keyed import existing_exit, insert_ignore, upsert
from ..schemas import RUNNERS

HEADERS = "map<string,string>"


def decode_messages(raw: DataFrame, headers: str = "headers") -> DataFrame:
    """Message rows with `headers` decoded to a map; rows whose headers are malformed are skipped.

    Malformed is text that is not a JSON object of strings; null headers are an empty map.  A header value that
    is no string (a number, an array, an object) makes the row malformed too.
    """
    text = F.col(headers)
    return raw.filter(text.isNull() | well_formed(text)).withColumn(headers, F.coalesce(F.from_json(text, HEADERS), F.create_map().cast(HEADERS)))


def well_formed(text: Column) -> Column:
    """Whether JSON text is an object all of whose values are strings."""
    values, parsed = F.from_json(text, HEADERS), F.try_parse_json(text)
    # re-encoding the map gives back the same object only when every value was a string
    again = F.try_parse_json(F.to_json(values))
    return F.coalesce(F.trim(text).startswith("{") & (again.cast("string") == parsed.cast("string")), F.lit(False))


def decode_replies(raw: DataFrame) -> DataFrame:
    """Reply rows as (request_id, id, sequence, exit, values): exits carry their result, chunks an array of values."""
    exit_ = F.when(F.col("is_exit"), F.from_json("payload", "struct<ok:boolean,value:string,error:string>"))
    values = F.when(~F.col("is_exit"), F.coalesce(F.from_json("payload", "array<string>"), F.array("payload")))
    return raw.select("request_id", "id", "sequence", "is_exit", exit_.alias("exit"), values.alias("values"))


def read_runners(spark: SparkSession, path: str) -> DataFrame:
    """A runner registry of JSON lines; malformed entries are skipped."""
    return spark.read.schema(RUNNERS).option("mode", "DROPMALFORMED").json(path).filter("host is not null and port is not null")


def envelope(calls: DataFrame, shards: int, payload: list[str], shard_group: str = "default") -> DataFrame:
    """Calls (request_id, entity_type, entity_id, tag, ...) as rows of the message log: with their shard, and the columns `payload` as binary JSON."""
    packed = F.to_json(F.struct(*payload)).cast("binary")
    return calls.select("request_id", F.lit(shard_group).alias("shard_group"), shard_of(F.col("entity_id"), shards).alias("shard_id"), "entity_type", "entity_id", "tag", packed.alias("payload"))


def send(stored: DataFrame, replies: DataFrame, envelopes: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(log after, envelopes with outcome and exit_id): an id that is there already is a duplicate, and gets its request's exit reply if there is one."""
    after, sent = save_messages(stored, envelopes, order)
    met = existing_exit(sent, replies).withColumn("outcome", F.when(F.col("inserted"), "accepted").otherwise("duplicate"))
    return after, met.select(*envelopes.columns, "outcome", F.when(~F.col("inserted"), F.col("exit_id")).alias("exit_id"))


def save_messages(stored: DataFrame, arrived: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Idempotent sink: (table after the arrivals, arrivals with their outcome); the first writer of an id wins."""
    return insert_ignore(stored, arrived, ["request_id"], order)


def save_replies(replies: DataFrame, messages: DataFrame, arrived: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Reply sink: (replies, messages) after the arrivals.  An accepted exit marks its request processed."""
    after, _ = insert_ignore(replies, arrived, ["request_id", "sequence"], order)
    exits = after.filter("is_exit").select("request_id").distinct().withColumn("_exit", F.lit(True))
    marked = messages.join(exits, "request_id", "left").withColumn("processed", F.col("processed") | F.coalesce("_exit", F.lit(False)))
    return after, marked.select(messages.columns)


def save_journal(journal: DataFrame, arrived: DataFrame, order: list[str]) -> DataFrame:
    """Journal sink: the last writer of a key wins."""
    return upsert(journal, arrived, ["key"], order)


def run_sql(spark: SparkSession, text: str, **args) -> DataFrame:
    """A parameterised statement over registered views; take execute, first or all rows from the result."""
    return spark.sql(text, args=args)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share, spark.checkpoint.dir.

    Where it is unset, a local session (tests, one machine) gets a folder of its own, and a cluster an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there now into a table of the shared folder, and read the table."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
