"""The library's queries by operator id, each with its DuckDB statement where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing as H
from .functions import ids as I
from .functions import schedule as S
from .operators import assignment as A
from .operators import filters as B
from .operators import inspect as G
from .operators import keyed as K
from .operators import lifecycle as L
from .operators import messages as M
from .operators import replies as R
from .operators import workflow as W
from .schemas import EXIT_SEQUENCE, violations
from .sources import tables as T
from .sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DUE = f"(deliver_at IS NULL OR deliver_at <= TIMESTAMP '{V.AS_OF}')"
GUARD_S = 5 * 86400
UNGUARDED = f"(last_read IS NULL OR last_read < TIMESTAMP '{V.AS_OF}' - INTERVAL 5 DAY)"
SHARD_KEY = ["shard_group", "shard_id"]


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# =========================================================================== A: sources and sinks
@query("A1_decode_messages", V.with_views("SELECT request_id, entity_id, json_extract_string(h, '$.k') AS header_k FROM (SELECT *, CASE WHEN request_id % 7 = 0 THEN NULL ELSE '{\"k\": \"' || tag || '\"}' END AS h FROM messages) WHERE request_id % 11 <> 0 OR request_id % 7 = 0"))
def a1(spark, d):
    m = V.messages(spark, d)
    text = F.when(F.col("request_id") % 7 == 0, F.lit(None)).when(F.col("request_id") % 11 == 0, F.lit('{"k": [1]}')).otherwise(F.concat(F.lit('{"k": "'), F.col("tag"), F.lit('"}')))
    return T.decode_messages(m.withColumn("headers", text)).select("request_id", "entity_id", F.col("headers")["k"].alias("header_k"))


@query("A2_decode_replies", V.with_views("SELECT request_id, id, sequence, is_exit, CASE WHEN NOT is_exit THEN payload END AS first_value FROM replies"))
def a2(spark, d):
    out = T.decode_replies(V.replies(spark, d).withColumn("payload", F.when(F.col("is_exit"), F.lit('{"ok": true}')).otherwise(F.concat(F.lit('["'), F.col("payload"), F.lit('"]')))))
    return out.select("request_id", "id", "sequence", "is_exit", F.get("values", F.lit(0)).alias("first_value"))


@query("A3_journal_read", V.with_views("SELECT key, value FROM journal WHERE key IN ('1/user', '7/assistant', 'none')"))
def a3(spark, d):
    return V.journal(spark, d).filter(F.col("key").isin("1/user", "7/assistant", "none")).select("key", "value")


@query("A4_runner_registry", V.with_views("SELECT host, port, weight, healthy FROM runners WHERE position % 7 <> 0"))
def a4(spark, d):
    """A registry of JSON lines; every seventh entry is cut off, which makes it malformed, and is skipped."""
    path = T.scratch(spark, "registry")
    text = F.to_json(F.struct("host", "port", "weight", "healthy"))
    V.runners(spark, d).select(F.when(F.col("position") % 7 == 0, F.substring(text, 1, 20)).otherwise(text).alias("value")).write.text(path)
    return T.read_runners(spark, path).select("host", "port", "weight", "healthy")


INSERTED = "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS r FROM lineitem"


@query("A7_message_sink", f"SELECT l_orderkey * 10 + l_linenumber AS request_id, CASE WHEN l_orderkey % 2 = 0 THEN -1 ELSE l_partkey END AS part FROM ({INSERTED}) WHERE r = 1")
def a7(spark, d):
    """Messages of the even orders are stored already, with another body, and stay as they are."""
    a = V.arrivals(spark, d).withColumn("request_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    stored = a.filter("l_orderkey % 2 = 0").dropDuplicates(["request_id"]).withColumn("l_partkey", F.lit(-1).cast("long"))
    after, _ = T.save_messages(stored, a, V.ARRIVAL_ORDER)
    return after.select("request_id", F.col("l_partkey").cast("long").alias("part"))


@query("D1_insert_ignore", f"SELECT l_orderkey, l_linenumber, l_partkey FROM ({INSERTED}) WHERE r = 1")
def d1(spark, d):
    a = V.arrivals(spark, d)
    after, _ = K.insert_ignore(a.limit(0), a, ["l_orderkey", "l_linenumber"], V.ARRIVAL_ORDER)
    return after.select("l_orderkey", "l_linenumber", "l_partkey")


@query("D1_insert_outcomes", f"SELECT l_orderkey, count(*) AS n_arrivals, count_if(r = 1 AND l_orderkey % 3 <> 0) AS n_inserted FROM ({INSERTED}) GROUP BY l_orderkey")
def d1b(spark, d):
    a = V.arrivals(spark, d)
    _, out = K.insert_ignore(a.filter("l_orderkey % 3 = 0"), a, ["l_orderkey", "l_linenumber"], V.ARRIVAL_ORDER)
    # rows equal in every column tie for the first place; they are one arrival
    return out.groupBy("l_orderkey").agg(F.count("*").alias("n_arrivals"), F.count_if("inserted").alias("n_inserted"))


EXITS = "exits AS (SELECT request_id, min(id) AS exit_id, min(payload) AS exit_payload FROM replies WHERE is_exit GROUP BY 1)"


@query("A8_reply_sink", V.with_views("SELECT request_id, sequence, CASE WHEN request_id % 2 = 0 AND sequence > 0 THEN 0 ELSE min(id) END AS id FROM replies GROUP BY 1, 2"))
def a8_sink(spark, d):
    """Later replies of even requests are stored already, under other ids, and stay."""
    r = V.replies(spark, d)
    stored = r.filter("request_id % 2 = 0 and sequence > 0").dropDuplicates(["request_id", "sequence"]).withColumn("id", F.lit(0).cast("long"))
    after, _ = T.save_replies(stored, V.messages(spark, d), r, ["id"])
    return after.select("request_id", "sequence", "id")


@query("D3_mark_processed", V.with_views("SELECT m.request_id, m.processed OR e.request_id IS NOT NULL AS processed FROM messages m LEFT JOIN exits e USING (request_id)", EXITS))
def a8(spark, d):
    r = V.replies(spark, d)
    stored = r.filter("is_exit and request_id % 2 = 0")  # exits count whether they are stored or arrive
    _, m = T.save_replies(stored, V.messages(spark, d), r.filter("not (is_exit and request_id % 2 = 0)"), ["id"])
    return m.select("request_id", "processed")


@query("D2_reply_insert", V.with_views("SELECT request_id, sequence, CASE WHEN request_id % 3 = 0 THEN -7 ELSE min(id) END AS id FROM replies GROUP BY 1, 2"))
def d2(spark, d):
    r = V.replies(spark, d)
    stored = r.filter("request_id % 3 = 0").dropDuplicates(["request_id", "sequence"]).withColumn("id", F.lit(-7).cast("long"))
    after, _ = K.insert_ignore(stored, r, ["request_id", "sequence"], ["id"])
    return after.select("request_id", "sequence", "id")


LAST_TURN = "SELECT conv_id || '/' || role AS key, arg_max(text, turn) AS value FROM conversations GROUP BY conv_id, role"


@query("A9_journal_sink", LAST_TURN)
@query("D4_upsert", LAST_TURN)
def d4(spark, d):
    c = V.table(spark, d, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), "role").alias("key"), F.col("text").alias("value"), "turn")
    old = c.filter("turn < 1").select("key", "value", "turn")
    return T.save_journal(old, c, ["turn"]).select("key", "value")


@query("A10_constraints", V.with_views("SELECT 'retry_count' AS \"check\", count_if(retry_count < 0) AS n FROM messages UNION ALL SELECT 'uninterruptible', 0 UNION ALL SELECT 'key', count(*) FROM (SELECT request_id FROM messages GROUP BY 1 HAVING count(*) > 1)"))
def a10(spark, d):
    return violations(V.messages(spark, d).withColumn("uninterruptible", F.lit("No")), "messages")


@query("A11_sql_pass_through", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey > 100 GROUP BY 1")
def a11(spark, d):
    V.table(spark, d, "orders").createOrReplaceTempView("orders")
    return T.run_sql(spark, "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey > :low GROUP BY 1", low=100)


@query("A12_payload_round_trip", V.with_views("SELECT request_id, tag, headers FROM messages"))
def a12(spark, d):
    packed = V.messages(spark, d).select("request_id", F.to_json(F.struct("tag", "headers")).cast("binary").alias("payload"))
    out = packed.select("request_id", F.from_json(F.col("payload").cast("string"), "tag string, headers string").alias("p"))
    return out.select("request_id", "p.tag", "p.headers")


# =========================================================================== B: predicates
for _name, _where, _filter in (
    ("B1_due", DUE, lambda: B.due(V.as_of())),
    ("B2_unprocessed", "NOT processed", B.unprocessed),
    ("B3_read_guard", UNGUARDED, lambda: B.unguarded(V.as_of(), GUARD_S)),
):
    query(_name, V.with_views(f"SELECT request_id, entity_id FROM messages WHERE {_where}"))(lambda spark, d, f=_filter: V.messages(spark, d).filter(f()).select("request_id", "entity_id"))


@query("B4_optional_filter", V.with_views("SELECT request_id FROM messages WHERE tag = 'click' AND processed = FALSE"))
def b4(spark, d):
    return B.optional(V.messages(spark, d), tag="click", processed=False, entity_id=None).select("request_id")


@query("B5_completion_filter", V.with_views("SELECT key, 'all' AS kind FROM journal UNION ALL SELECT key, 'done' FROM journal WHERE completed_at IS NOT NULL UNION ALL SELECT key, 'open' FROM journal WHERE completed_at IS NULL"))
def b5(spark, d):
    j = V.journal(spark, d)
    parts = [B.completion(j, c).select("key", F.lit(k).alias("kind")) for c, k in ((None, "all"), (True, "done"), (False, "open"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("B6_like_prefix", V.with_views("SELECT key FROM journal WHERE key LIKE '1_/%'"))
def b6(spark, d):
    return V.journal(spark, d).filter(B.like_prefix("key", "1_/")).select("key")


@query("B7_prefix_range", V.with_views("SELECT key FROM journal WHERE starts_with(key, '1')"))
def b7(spark, d):
    return V.journal(spark, d).filter(B.in_prefix_range("key", "1")).select("key")


@query("B8_by_ids", V.with_views(f"SELECT request_id, tag FROM messages WHERE NOT processed AND {DUE} AND request_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)"))
def b8(spark, d):
    ids = V.table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("request_id"))
    return B.by_ids(V.messages(spark, d), ids, V.as_of()).select("request_id", "tag")


@query("B9_assignable_runners", V.with_views("SELECT host, weight FROM runners WHERE healthy AND weight > 0"))
def b9(spark, d):
    return B.assignable(V.runners(spark, d)).select("host", "weight")


@query("B10_stream_request", V.with_views("SELECT request_id, tag = 'click' AS is_stream FROM messages"))
def b10(spark, d):
    m = V.messages(spark, d).withColumn("headers", F.when(F.col("tag") == "click", F.create_map(F.lit(B.STREAM_HEADER), F.lit("1"))).otherwise(F.create_map(F.lit("other"), F.lit("1"))))
    return m.select("request_id", B.is_stream_request().alias("is_stream"))


MODE = "CASE request_id % 5 WHEN 0 THEN 'No' WHEN 1 THEN 'Client' WHEN 2 THEN 'Server' WHEN 3 THEN 'Both' ELSE 'odd' END"


@query("B11_suppressed_reply", V.with_views(f"SELECT request_id, request_id % 2 = 0 AND request_id % 3 > 0 AND {MODE} IN ('Server', 'Both') AS suppressed FROM messages"))
def b11(spark, d):
    m = V.messages(spark, d).withColumn("uninterruptible", F.expr(MODE.replace("request_id % 5", "cast(request_id % 5 as int)")))
    return m.select("request_id", B.suppresses_reply(F.col("request_id") % 2 == 0, F.col("request_id") % 3 > 0).alias("suppressed"))


@query("B12_retryable_error", "SELECT r_regionkey, r_regionkey IN (0, 1) AS retryable FROM region")
def b12(spark, d):
    e = F.element_at(F.array(*map(F.lit, ["EntityNotAssignedToRunner", "RunnerUnavailable", "MailboxFull", "PersistenceError", "MalformedMessage"])), F.col("r_regionkey") % 5 + 1)
    return V.table(spark, d, "region").withColumn("error", e).select("r_regionkey", B.is_retryable("error").alias("retryable"))


@query("B13_dead_lettered", V.with_views("SELECT request_id FROM messages WHERE processed AND request_id IN (SELECT request_id FROM replies WHERE is_exit AND id < 0)"))
@query("C5_dead_letter_notice", V.with_views("SELECT request_id FROM messages WHERE processed AND request_id IN (SELECT request_id FROM replies WHERE is_exit AND id < 0)"))
def b13(spark, d):
    return B.dead_lettered(V.messages(spark, d), V.replies(spark, d)).select("request_id")


@query("B14_cron_staleness", V.with_views(f"SELECT request_id, CASE WHEN date_diff('second', created_at, TIMESTAMP '{V.AS_OF}') > 86400 THEN 'skip' ELSE 'run' END AS verdict FROM messages"))
def b14(spark, d):
    age = S.clock_diff("SECOND", F.col("created_at"), V.as_of())
    return V.messages(spark, d).select("request_id", S.cron_verdict(age, 86400).alias("verdict"))


@query("B15_computed_columns", V.with_views("SELECT request_id, -request_id AS dead_letter_id, retry_count + 1 AS retries, octet_length(encode(headers)) AS header_bytes, CASE WHEN processed THEN 'done' ELSE 'open' END AS state FROM messages"))
def b15(spark, d):
    return V.messages(spark, d).select("request_id", I.dead_letter_reply_id(F.col("request_id")).alias("dead_letter_id"), (F.col("retry_count") + 1).alias("retries"), F.octet_length("headers").alias("header_bytes"), F.when(F.col("processed"), "done").otherwise("open").alias("state"))


@query("B16_shard_membership", V.with_views("SELECT request_id, shard_id FROM messages WHERE (shard_group, shard_id) IN (SELECT shard_group, shard_id FROM owned)"))
@query("C2_owned_semi_join", V.with_views("SELECT request_id, shard_id FROM messages WHERE (shard_group, shard_id) IN (SELECT shard_group, shard_id FROM owned)"))
def b16(spark, d):
    return B.in_shards(V.messages(spark, d), V.owned(spark, d)).select("request_id", "shard_id")


@query("B17_entity_lookup", V.with_views("SELECT request_id, created_at FROM messages WHERE entity_id = 'user-7'"))
def b17(spark, d):
    return B.optional(V.messages(spark, d), entity_id="user-7").select("request_id", "created_at")


@query("B18_clear_replies", V.with_views("SELECT id, request_id, sequence FROM replies WHERE request_id % 2 <> 0"))
def b18(spark, d):
    r = V.replies(spark, d)
    return B.clear_replies(r, r.filter("request_id % 2 = 0")).select("id", "request_id", "sequence")


@query("B18_acknowledge", V.with_views("SELECT id, request_id, sequence FROM replies WHERE is_exit OR sequence <> 0"))
def b18b(spark, d):
    r = V.replies(spark, d)
    return B.acknowledge(r, r.filter("sequence = 0 or is_exit").select("request_id", "sequence", "id")).select("id", "request_id", "sequence")


# =========================================================================== E1-E3, C1-C4: the claim
ELIGIBLE = f"""eligible AS (SELECT * FROM messages WHERE NOT processed AND {DUE} AND {UNGUARDED}
  AND (shard_group, shard_id) IN (SELECT shard_group, shard_id FROM owned)),
taken AS (SELECT *, retry_count > 2 AS dead FROM eligible ORDER BY request_id LIMIT 1000)"""


def _claim(spark, d):
    return M.claim(V.messages(spark, d), V.replies(spark, d), V.owned(spark, d), V.as_of(), 1000, 2, GUARD_S)


@query("E1_claim_delivered", V.with_views("SELECT request_id, shard_id, entity_id, tag FROM taken WHERE NOT dead", ELIGIBLE))
@query("C4_not_dead_lettered", V.with_views("SELECT request_id, shard_id, entity_id, tag FROM taken WHERE NOT dead", ELIGIBLE))
def e1(spark, d):
    return _claim(spark, d).delivered.select("request_id", "shard_id", "entity_id", "tag")


@query("E1_claim_dead_letters", V.with_views(f"SELECT -request_id AS id, request_id, {EXIT_SEQUENCE} AS sequence, '{M.DEAD_LETTER}' AS payload, TRUE AS is_exit FROM taken WHERE dead AND request_id NOT IN (SELECT request_id FROM replies WHERE is_exit)", ELIGIBLE))
@query("C3_without_exit", V.with_views(f"SELECT -request_id AS id, request_id, {EXIT_SEQUENCE} AS sequence, '{M.DEAD_LETTER}' AS payload, TRUE AS is_exit FROM taken WHERE dead AND request_id NOT IN (SELECT request_id FROM replies WHERE is_exit)", ELIGIBLE))
def e1b(spark, d):
    return _claim(spark, d).dead_letters


@query("E1_claim_state", V.with_views(f"SELECT m.request_id, CASE WHEN t.request_id IS NULL THEN m.retry_count ELSE m.retry_count + 1 END AS retry_count, m.processed OR coalesce(t.dead, FALSE) AS processed, CASE WHEN t.request_id IS NULL THEN m.last_read ELSE TIMESTAMP '{V.AS_OF}' END AS last_read FROM messages m LEFT JOIN taken t USING (request_id)", ELIGIBLE))
def e1c(spark, d):
    return M.after_claim(V.messages(spark, d), _claim(spark, d).claimed).select("request_id", "retry_count", "processed", "last_read")


@query("C1_claimed_join", V.with_views("SELECT m.request_id, m.retry_count, m.retry_count + 1 AS new_retry_count FROM messages m JOIN taken t USING (request_id)", ELIGIBLE))
def c1(spark, d):
    new = _claim(spark, d).claimed.select("request_id", F.col("retry_count").alias("new_retry_count"))
    return V.messages(spark, d).join(new, "request_id").select("request_id", "retry_count", "new_retry_count")


@query("E2_deliveries_left", V.with_views("SELECT request_id, greatest(3 - retry_count, 0)::INTEGER AS deliveries FROM messages"))
def e2(spark, d):
    return V.messages(spark, d).select("request_id", M.deliveries(F.col("retry_count"), 2).alias("deliveries"))


@query("E3_reset_shards", V.with_views("SELECT request_id, CASE WHEN hit THEN FALSE ELSE processed END AS processed, CASE WHEN hit THEN 0 ELSE retry_count END AS retry_count, CASE WHEN hit THEN NULL ELSE last_read END AS last_read FROM (SELECT *, shard_id % 2 = 0 AND request_id NOT IN (SELECT request_id FROM replies WHERE is_exit) AS hit FROM messages)"))
def e3(spark, d):
    return M.reset_shards(V.messages(spark, d), V.replies(spark, d), V.owned(spark, d)).select("request_id", "processed", "retry_count", "last_read")


@query("E11_inbox_truncate", V.with_views("SELECT request_id FROM messages ORDER BY request_id LIMIT 500"))
@query("G4_lowest_ids", V.with_views("SELECT request_id FROM messages ORDER BY request_id LIMIT 500"))
def e11(spark, d):
    return M.poll_cycle(V.messages(spark, d), 500).select("request_id")


ASSIGNED = "assignment AS (SELECT 'default' AS shard_group, range::INTEGER AS shard_id, 'r' || (range % 5) || ':9000' AS runner FROM range(0, 250))"


def _assignment(spark):
    return spark.range(250).select(F.lit("default").alias("shard_group"), F.col("id").cast("int").alias("shard_id"), F.concat(F.lit("r"), (F.col("id") % 5).cast("string"), F.lit(":9000")).alias("runner"))


@query("C7_route", V.with_views("SELECT m.request_id, a.runner AS owner, CASE WHEN m.shard_id % 2 = 0 THEN 'local' WHEN a.runner = 'r1:9000' THEN 'self' WHEN a.runner IS NOT NULL THEN 'remote' ELSE 'unassigned' END AS decision FROM messages m LEFT JOIN assignment a USING (shard_group, shard_id)", ASSIGNED))
def c7(spark, d):
    return M.route(V.messages(spark, d), V.owned(spark, d), _assignment(spark), "r1:9000").select("request_id", "owner", "decision")


@query("E30_interrupt_route", V.with_views("SELECT m.request_id, CASE WHEN m.shard_id % 2 = 0 OR a.runner = 'r1:9000' THEN 'local' WHEN a.runner IS NOT NULL THEN 'forward' ELSE 'error' END AS decision FROM messages m LEFT JOIN assignment a USING (shard_group, shard_id)", ASSIGNED))
def e30(spark, d):
    return M.interrupt_route(V.messages(spark, d), V.owned(spark, d), _assignment(spark), "r1:9000").select("request_id", "decision")


@query("C8_registered_type", V.with_views(f"SELECT request_id, CASE WHEN tag IN ('click', 'view') THEN 'dispatch' WHEN created_at <= TIMESTAMP '{V.AS_OF}' - INTERVAL 1 DAY THEN 'fail' ELSE 'wait' END AS verdict FROM messages"))
def c8(spark, d):
    known = spark.createDataFrame([("click",), ("view",)], "entity_type string")
    m = V.messages(spark, d).withColumn("entity_type", F.col("tag"))
    return M.dispatch(m, known, V.as_of(), 86400, "created_at").select("request_id", "verdict")


@query("C10_duplicate_exit", V.with_views("SELECT m.request_id, e.id AS exit_id FROM messages m LEFT JOIN (SELECT * FROM replies WHERE is_exit) e USING (request_id)"))
def c10(spark, d):
    return K.existing_exit(V.messages(spark, d).select("request_id"), V.replies(spark, d)).select("request_id", "exit_id")


@query("E10_admission", V.with_views("SELECT request_id, seq, CASE WHEN rn > 1 THEN 'duplicate' WHEN sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY address ORDER BY seq ROWS UNBOUNDED PRECEDING) > 20 THEN 'full' ELSE 'accepted' END AS verdict FROM (SELECT o_custkey * 10 + o_orderkey % 3 AS request_id, o_custkey % 40 AS address, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey * 10 + o_orderkey % 3 ORDER BY o_orderkey) AS rn FROM orders)"))
def e10(spark, d):
    o = V.table(spark, d, "orders").select((F.col("o_custkey") * 10 + F.col("o_orderkey") % 3).alias("request_id"), (F.col("o_custkey") % 40).alias("address"), F.col("o_orderkey").alias("seq"))
    return M.admit(o, 20, ["address"], ["seq"]).select("request_id", "seq", "verdict")


@query("E12_resumption_batches", V.with_views("SELECT entity_id, request_id, floor((row_number() OVER (PARTITION BY entity_id ORDER BY request_id) - 1) / 16)::INTEGER AS batch FROM messages"))
def e12(spark, d):
    return M.resumption_batches(V.messages(spark, d), ["entity_id"], 16).select("entity_id", "request_id", "batch")


@query("E12_exhausted", V.with_views(f"SELECT -request_id AS id, request_id, {EXIT_SEQUENCE} AS sequence, 'mailbox full' AS payload, TRUE AS is_exit FROM messages WHERE retry_count >= 3"))
def e12b(spark, d):
    return M.exhausted_replies(V.messages(spark, d), "retry_count", 3)


# =========================================================================== replies
@query("E4_reply_order", V.with_views("SELECT request_id, id, row_number() OVER (PARTITION BY request_id ORDER BY is_exit, sequence, id) AS position FROM replies"))
@query("G7_reply_sort", V.with_views("SELECT request_id, id, row_number() OVER (PARTITION BY request_id ORDER BY is_exit, sequence, id) AS position FROM replies"))
def e4(spark, d):
    return R.ordered(V.replies(spark, d)).select("request_id", "id", "position")


STREAM = """firsts AS (SELECT request_id, sequence, min(arrival) AS f FROM chunks GROUP BY 1, 2),
ready AS (SELECT *, max(f) OVER w AS t, row_number() OVER w - 1 AS n FROM firsts WINDOW w AS (PARTITION BY request_id ORDER BY sequence ROWS UNBOUNDED PRECEDING)),
kept AS (SELECT c.request_id, c.sequence, CASE WHEN c.sequence = n THEN 'stream' ELSE 'close' END AS phase, arg_max(value, arrival) AS value
  FROM chunks c JOIN ready r USING (request_id, sequence) WHERE c.sequence <> n OR arrival <= t GROUP BY 1, 2, 3)"""


@query("E5_stream_reassembly", V.with_views("SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY sequence) - 1 AS position, sequence, value, phase FROM kept", STREAM))
@query("H3_send_stream", V.with_views("SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY sequence) - 1 AS position, sequence, value, phase FROM kept", STREAM))
def e5(spark, d):
    return R.reassemble(V.chunks(spark, d))


@query("E27_handler_chunks", "SELECT conv_id AS request_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sequence, role AS value FROM conversations")
def e27(spark, d):
    c = V.table(spark, d, "conversations").select(F.col("conv_id").alias("request_id"), "turn", "role")
    return R.chunked(c, ["turn"], "role").select("request_id", "sequence", F.col("values")[0].alias("value"))


POLL = V.with_views("SELECT m.request_id, e.payload AS reply, CASE WHEN e.id IS NULL THEN 'pending' WHEN e.id < 0 THEN 'error' ELSE 'value' END AS outcome FROM messages m LEFT JOIN (SELECT * FROM replies WHERE is_exit) e USING (request_id)")


@query("H2_send", V.with_views("SELECT m.request_id, CASE WHEN m.request_id % 3 = 0 THEN 'duplicate' ELSE 'accepted' END AS outcome, CASE WHEN m.request_id % 3 = 0 THEN e.id END AS exit_id FROM messages m LEFT JOIN (SELECT * FROM replies WHERE is_exit) e USING (request_id)"))
def h2(spark, d):
    """Every third request is in the log already; its repeat gets the exit reply that is there."""
    out = T.envelope(V.messages(spark, d), V.SHARDS, ["tag", "headers"])
    return T.send(out.filter("request_id % 3 = 0"), V.replies(spark, d), out, ["entity_id"])[1].select("request_id", "outcome", "exit_id")


@query("H8_poll_reply", POLL)
@query("H9_join_reply", POLL)
def h8(spark, d):
    return R.poll(V.messages(spark, d).select("request_id"), V.replies(spark, d)).select("request_id", "reply", "outcome")


@query("H10_polling_fallback", V.with_views("SELECT request_id, sequence, min(payload) AS payload FROM replies WHERE sequence <> 0 GROUP BY 1, 2"))
def h10(spark, d):
    r = V.replies(spark, d)
    return R.fallback(r.filter("sequence = 0"), r.unionByName(r), ["payload"]).select("request_id", "sequence", "payload")


# =========================================================================== S: scalar functions
def _djb64(text: str, seed: str = "5381::UHUGEINT") -> str:
    return f"list_reduce(list_prepend({seed}, list_transform(string_split({text}, ''), lambda c: ord(c)::UHUGEINT)), lambda a, b: (a * 33 + b) % 18446744073709551616)"


_M64 = "18446744073709551616"


def _mixed64(text: str) -> str:
    start = f"(({H.PRIME5}::UHUGEINT + length({text})::UHUGEINT) % {_M64})"
    step = f"lambda a, b: ((((xor(a, (b * {H.PRIME5}::UHUGEINT) % {_M64}) * 2048) % {_M64}) + (xor(a, (b * {H.PRIME5}::UHUGEINT) % {_M64}) // 9007199254740992)) * {H.PRIME1}::UHUGEINT) % {_M64}"
    return f"list_reduce(list_prepend({start}, list_transform(string_split({text}, ''), lambda c: ord(c)::UHUGEINT)), {step})"


_AVALANCHE = f"""mixed AS (SELECT k, t, {_mixed64('t')} AS a FROM texts),
m1 AS (SELECT k, t, (xor(a, a // 8589934592) * {H.PRIME2}::UHUGEINT) % {_M64} AS a FROM mixed),
m2 AS (SELECT k, t, (xor(a, a // 536870912) * {H.PRIME3}::UHUGEINT) % {_M64} AS a FROM m1),
m3 AS (SELECT k, t, xor(a, a // 4294967296) AS a FROM m2)"""
_TEXTS = "texts AS (SELECT c_custkey AS k, c_name AS t FROM customer)"


@query("S1_djb2", f"SELECT c_custkey AS k, list_reduce(list_prepend(5381::UBIGINT, list_transform(string_split(c_name, ''), lambda c: ord(c)::UBIGINT)), lambda a, b: (a * 33 + b) % 4294967296)::BIGINT AS h FROM customer")
def s1(spark, d):
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), H.djb2(F.col("c_name")).alias("h"))


@query("S1b_djb2_64", f"SELECT c_custkey AS k, lower(lpad(hex({_djb64('c_name')}), 16, '0')) AS h FROM customer")
def s1b(spark, d):
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), H.as_hex(H.djb2_64(F.col("c_name"))).alias("h"))


@query("H1_build_envelope", V.with_views("SELECT ((ms - 1735689600000) << 22) | (7 << 12) | (row_number() OVER (PARTITION BY ms ORDER BY request_id) - 1) AS id, shard_id, entity_id, tag, json_object('tag', tag, 'headers', headers)::VARCHAR AS body FROM (SELECT *, epoch_us(created_at) // 1000 + 63158400000 AS ms FROM messages)"))
def h1(spark, d):
    """Calls get a fresh snowflake id of machine 7, their shard and a payload."""
    calls = V.messages(spark, d).withColumn("at_ms", F.unix_millis(F.col("created_at").cast("timestamp")) + 63_158_400_000).withColumn("machine", F.lit(7))
    calls = I.generate(calls, "machine", "at_ms", ["request_id"]).drop("request_id").withColumnRenamed("id", "request_id")
    return T.envelope(calls, V.SHARDS, ["tag", "headers"]).select(F.col("request_id").alias("id"), "shard_id", "entity_id", "tag", F.col("payload").cast("string").alias("body"))


@query("S2_shard_of", V.with_views("SELECT request_id, entity_id, shard_id FROM messages"))
def s2(spark, d):
    return V.messages(spark, d).select("request_id", "entity_id", "shard_id")


@query("S3_hash64", f"WITH {_TEXTS}, {_AVALANCHE} SELECT k, lower(lpad(hex(a), 16, '0')) AS h FROM m3")
def s3(spark, d):
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), H.hash64_hex(F.col("c_name")).alias("h"))


@query("S4_digest_hex", f"WITH {_TEXTS}, {_AVALANCHE} SELECT k, lower(lpad(hex(a), 16, '0')) || lower(lpad(hex({_djb64('t', str(H.SECOND_SEED) + '::UHUGEINT')}), 16, '0')) AS h FROM m3")
@query("E20_execution_id", f"WITH {_TEXTS}, {_AVALANCHE} SELECT k, lower(lpad(hex(a), 16, '0')) || lower(lpad(hex({_djb64('t', str(H.SECOND_SEED) + '::UHUGEINT')}), 16, '0')) AS h FROM m3")
def s4(spark, d):
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), W.execution_id(F.col("c_name")).alias("h"))


_PERSISTED = _djb64("'User' || chr(1) || c_name || chr(1) || c_mktsegment || chr(1) || c_custkey").replace("ord(c)::UHUGEINT", "CASE WHEN ord(c) = 1 THEN 0 ELSE ord(c) END::UHUGEINT")


@query("S5_persisted_request_id", f"SELECT c_custkey AS k, ({_PERSISTED} % 9223372036854775808)::BIGINT AS id FROM customer")
def s5(spark, d):
    return _persisted_calls(spark, d).select("k", F.col("request_id").alias("id"))


def _persisted_calls(spark, d):
    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("User").alias("entity_type"), F.col("c_name").alias("entity_id"), F.col("c_mktsegment").alias("tag"))
    return c.withColumn("request_id", H.persisted_request_id(F.col("entity_type"), F.col("entity_id"), F.col("tag"), F.col("k").cast("string")))


@query("H5_send_persisted", f"SELECT ({_PERSISTED} % 9223372036854775808)::BIGINT AS id, c_name AS entity_id, CASE WHEN c_custkey % 4 = 0 THEN 'duplicate' ELSE 'accepted' END AS outcome FROM customer")
def h5(spark, d):
    """The id follows from address, tag and key, so a call that was sent before is a duplicate."""
    out = T.envelope(_persisted_calls(spark, d), V.SHARDS, ["k"])
    sent = T.envelope(_persisted_calls(spark, d).filter("k % 4 = 0"), V.SHARDS, ["k"])
    return T.send(sent, V.replies(spark, d), out, ["entity_id"])[1].select(F.col("request_id").alias("id"), "entity_id", "outcome")


@query("H6_notify_persisted", f"SELECT ({_PERSISTED} % 9223372036854775808)::BIGINT AS id, count(*) AS n FROM customer GROUP BY 1")
def h6(spark, d):
    """Each notification is sent twice and kept once; there is no reply to wait for."""
    out = T.envelope(_persisted_calls(spark, d), V.SHARDS, ["k"])
    after, _ = T.send(out.filter("false"), V.replies(spark, d), out.unionByName(out), ["entity_id"])
    return after.groupBy(F.col("request_id").alias("id")).agg(F.count("*").alias("n"))


_BYTES = "[(k >> 56) & 255, (k >> 48) & 255, (k >> 40) & 255, (k >> 32) & 255, (k >> 24) & 255, (k >> 16) & 255, (k >> 8) & 255, k & 255, (n >> 24) & 255, (n >> 16) & 255, (n >> 8) & 255, n & 255]"


@query("S6_fallback_reply_id", f"SELECT k AS request_id, n AS sequence, (list_reduce(list_prepend(5381::UHUGEINT, list_transform({_BYTES}, lambda c: c::UHUGEINT)), lambda a, b: (a * 33 + b) % {_M64}) % 9223372036854775808)::BIGINT AS id FROM (SELECT DISTINCT l_orderkey::BIGINT AS k, l_linenumber::BIGINT AS n FROM lineitem)")
def s6(spark, d):
    r = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("sequence")).distinct()
    return r.withColumn("id", H.fallback_reply_id(F.col("request_id"), F.col("sequence")))


@query("S7_dead_letter_id", V.with_views("SELECT request_id, -request_id AS id FROM messages"))
def s7(spark, d):
    return V.messages(spark, d).select("request_id", I.dead_letter_reply_id(F.col("request_id")).alias("id"))


@query("S8_snowflake_parts", "SELECT id, (id >> 22) + 1735689600000 AS timestamp_ms, ((id >> 12) & 1023)::INTEGER AS machine_id, (id & 4095)::INTEGER AS sequence, id AS packed FROM (SELECT o_orderkey * 12345678901 AS id FROM orders)")
def s8(spark, d):
    o = V.table(spark, d, "orders").select((F.col("o_orderkey") * F.lit(12345678901)).alias("id")).withColumn("p", I.snowflake_parts(F.col("id")))
    return o.select("id", "p.*", I.snowflake(F.col("p.timestamp_ms"), F.col("p.machine_id"), F.col("p.sequence")).alias("packed"))


@query("S9_snowflake_generate", "SELECT o_orderkey, ((ms - 1735689600000) << 22) | (m << 12) | (row_number() OVER (PARTITION BY m, ms ORDER BY o_orderkey) - 1) AS id FROM (SELECT o_orderkey, o_custkey % 1024 AS m, 1735689600000 + o_orderkey // 100 AS ms FROM orders)")
def s9(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 1024).alias("machine"), (F.lit(I.EPOCH_MS) + F.floor(F.col("o_orderkey") / 100)).alias("ms"))
    return I.generate(o, "machine", "ms", ["o_orderkey"]).select("o_orderkey", "id")


@query("S9_clock_drift", "SELECT o_orderkey, CASE WHEN late <= 5000 THEN greatest(ms, before) END AS used_ms, CASE WHEN late > 5000 THEN 'error' WHEN late > 0 THEN 'wait' ELSE 'ok' END AS outcome FROM (SELECT *, coalesce(before - ms, 0) AS late FROM (SELECT *, max(ms) OVER (PARTITION BY m ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT o_orderkey, o_custkey % 16 AS m, 1735689600000 + o_orderkey * 100 - o_custkey % 7 * 1500 AS ms FROM orders)))")
def s9b(spark, d):
    """Clocks that step back by up to nine seconds; over five is an error."""
    o = V.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 16).alias("machine"), (F.lit(I.EPOCH_MS) + F.col("o_orderkey") * 100 - F.col("o_custkey") % 7 * 1500).alias("ms"))
    return I.with_drift(o, "machine", "ms", ["o_orderkey"]).select("o_orderkey", "used_ms", "outcome")


@query("S10_activity_backoff", "SELECT n_nationkey AS attempt, least(2 * pow(2, n_nationkey), 60)::BIGINT AS secs, 5::BIGINT AS constant_secs FROM nation")
def s10(spark, d):
    a = F.col("n_nationkey")
    return V.table(spark, d, "nation").select(a.alias("attempt"), S.activity_backoff(a, 2).alias("secs"), S.activity_backoff(a, 5, "constant").alias("constant_secs"))


@query("S11_crash_backoff", "SELECT n_nationkey + 1 AS crashes, floor(least(500 * pow(1.5, n_nationkey), 10000))::BIGINT AS ms FROM nation")
def s11(spark, d):
    n = F.col("n_nationkey") + 1
    return V.table(spark, d, "nation").select(n.alias("crashes"), S.crash_backoff(n).alias("ms"))


@query("S12_singleton_backoff", "SELECT n_nationkey + 1 AS crashes, (1000 * pow(2, least(n_nationkey, 10)))::BIGINT AS ms FROM nation")
def s12(spark, d):
    n = F.col("n_nationkey") + 1
    return V.table(spark, d, "nation").select(n.alias("crashes"), S.singleton_backoff(n).alias("ms"))


@query("S13_swap_backoff", "SELECT n_nationkey AS attempt, least(pow(2, least(n_nationkey, 6)), 100)::BIGINT AS ms, least(pow(2, least(n_nationkey, 5)), 50)::BIGINT AS health_ms FROM nation")
def s13(spark, d):
    a = F.col("n_nationkey")
    return V.table(spark, d, "nation").select(a.alias("attempt"), S.swap_backoff(a).alias("ms"), S.swap_backoff(a, 5, 50).alias("health_ms"))


_JOURNAL_KEY = _djb64("'User' || chr(1) || c_name || chr(1) || '__journal/step' || chr(1) || c_custkey").replace("ord(c)::UHUGEINT", "CASE WHEN ord(c) = 1 THEN 0 ELSE ord(c) END::UHUGEINT")


@query("S14_journal_key", f"SELECT c_custkey AS k, '__journal/' || ({_JOURNAL_KEY} % 9223372036854775808)::BIGINT AS key FROM customer")
def s14(spark, d):
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), H.journal_key(F.lit("step"), F.col("c_custkey").cast("string"), F.lit("User"), F.col("c_name")).alias("key"))


@query("S15_text_keys", V.with_views("SELECT request_id, shard_group || ':' || shard_id AS shard_key, shard_group || ':' || shard_id || '/' || entity_type || '/' || entity_id AS address FROM messages"))
def s15(spark, d):
    key = F.concat_ws(":", "shard_group", "shard_id")
    return V.messages(spark, d).select("request_id", key.alias("shard_key"), F.concat_ws("/", key, "entity_type", "entity_id").alias("address"))


@query("S16_prefix_bound", "SELECT * FROM (VALUES ('abc', 'abd'), ('az', 'a{'), ('', NULL), ('result/', 'result0')) t(prefix, upper)")
def s16(spark, d):
    return spark.createDataFrame([(p, B.prefix_upper_bound(p)) for p in ("abc", "az", "", "result/")], "prefix string, upper string")


CRON = "0 30 9,17 * * mon-fri"


@query("E21_cron_occurrences", "SELECT at FROM (SELECT TIMESTAMP '2024-01-01' + to_days(d::INTEGER) + to_hours(h) + INTERVAL 30 MINUTE AS at FROM range(0, 31) r(d), (VALUES (9), (17)) t(h)) WHERE isodow(at) <= 5 AND at <= TIMESTAMP '2024-01-31 00:00:00'".replace(" at ", " ran ").replace("SELECT at", "SELECT ran").replace("(at)", "(ran)").replace("SELECT ran FROM", "SELECT ran AS at_time FROM"))
def e21(spark, d):
    return S.Schedule.parse(CRON).occurrences(spark, "2024-01-01 00:00:00", "2024-01-31 00:00:00").select(F.col("at").alias("at_time"))


@query("S17_cron_next", V.with_views("SELECT request_id, (SELECT min(c) FROM (SELECT date_trunc('day', created_at) + to_days(d::INTEGER) + to_hours(h) + INTERVAL 30 MINUTE AS c FROM range(0, 5) r(d), (VALUES (9), (17)) t(h)) WHERE c > created_at AND isodow(c) <= 5) AS next_at FROM messages"))
def s17(spark, d):
    return S.next_after(V.messages(spark, d), S.Schedule.parse(CRON), "created_at", 14).select("request_id", "next_at")


@query("S18_machine_id", "SELECT o_orderkey, (((o_orderkey - 500) % 1024 + 1024) % 1024)::INTEGER AS wrapped, o_orderkey - 500 BETWEEN 0 AND 1023 AS valid FROM orders")
def s18(spark, d):
    n = F.col("o_orderkey") - 500
    return V.table(spark, d, "orders").select("o_orderkey", I.wrap_machine_id(n).alias("wrapped"), I.valid_machine_id(n).alias("valid"))


@query("S19_interval", V.with_views("SELECT request_id, created_at - to_milliseconds(1500) AS earlier FROM messages"))
def s19(spark, d):
    return V.messages(spark, d).select("request_id", (F.col("created_at") - F.make_dt_interval(secs=F.lit(1.5))).alias("earlier"))


@query("S20_array_append", "SELECT conv_id, octet_length(encode(text)) AS bytes, [role, 'end'] AS parts FROM conversations".replace("[role, 'end'] AS parts", "role || ',end' AS parts"))
def s20(spark, d):
    return V.table(spark, d, "conversations").select("conv_id", F.octet_length("text").alias("bytes"), F.array_join(F.array_append(F.array("role"), F.lit("end")), ",").alias("parts"))


@query("S21_json_headers", V.with_views("SELECT request_id, headers AS text, (headers->>'k')::BIGINT AS k FROM messages"))
def s21(spark, d):
    k = F.from_json("headers", "k bigint")
    return V.messages(spark, d).select("request_id", F.col("headers").alias("text"), k["k"].alias("k"))


@query("S22_interrupt_mode", V.with_views(f"SELECT request_id, CASE WHEN mode IN ('Client', 'Server', 'Both') THEN mode ELSE 'No' END AS mode FROM (SELECT request_id, {MODE} AS mode FROM messages)"))
def s22(spark, d):
    m = V.messages(spark, d).withColumn("mode", F.expr(MODE.replace("request_id % 5", "cast(request_id % 5 as int)")))
    return m.select("request_id", B.interrupt_mode("mode").alias("mode"))


@query("S23_trace_context", V.with_views("SELECT request_id, lower(lpad(hex(request_id), 16, '0')) AS span_id, CASE WHEN request_id % 3 = 0 THEN NULL ELSE (request_id % 3 = 1)::VARCHAR END AS sampled FROM messages"))
def s23(spark, d):
    sampled = F.when(F.col("request_id") % 3 == 0, F.lit(None)).otherwise(F.col("request_id") % 3 == 1)
    return V.messages(spark, d).select("request_id", F.lower(F.lpad(F.hex("request_id"), 16, "0")).alias("span_id"), sampled.cast("string").alias("sampled"))


@query("S24_rfc3339", V.with_views("SELECT request_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || 'Z' AS at_text FROM messages"))
def s24(spark, d):
    return V.messages(spark, d).select("request_id", F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("at_text"))


# =========================================================================== assignment
_PAIRS = "texts AS (SELECT row_number() OVER () AS k, 'default:' || s.range || chr(1) || host || ':9000' || chr(1) || w.range AS t, s.range AS shard, host || ':9000' AS runner, position FROM range(0, 300) s, runners r, range(0, 4) w WHERE healthy AND w.range < weight)"
_RENDEZVOUS = V.with_views("SELECT 'default' AS shard_group, x.shard::INTEGER AS shard_id, arg_max(x.runner, (m3.a, x.position)) AS runner FROM m3 JOIN texts x USING (k) GROUP BY x.shard", _PAIRS, _AVALANCHE.replace("ord(c)::UHUGEINT", "CASE WHEN ord(c) = 1 THEN 0 ELSE ord(c) END::UHUGEINT"))


@query("E6_rendezvous", _RENDEZVOUS)
@query("E7_rendezvous_parallel", _RENDEZVOUS)
@query("C6_shards_by_slots", _RENDEZVOUS)
@query("F8_argmax", _RENDEZVOUS)
def e6(spark, d):
    return A.assign(A.shard_table(spark, ["default"], V.SHARDS), V.runners(spark, d), position="position")


@query("E8_strategy", _RENDEZVOUS.replace("SELECT 'default' AS shard_group, x.shard", "SELECT 'rendezvous' AS strategy, x.shard").replace("GROUP BY x.shard", "GROUP BY x.shard UNION ALL SELECT 'ring', range::INTEGER, 'r7:9000' FROM range(0, 300)"))
def e8(spark, d):
    """Each strategy by its name; the ring has one runner, which holds all shards wherever its nodes stand."""
    shards = A.shard_table(spark, ["default"], V.SHARDS)
    alone = spark.createDataFrame([("r7", 9000, 2, True)], "host string, port int, weight int, healthy boolean")
    found = [A.assign(shards, V.runners(spark, d), "rendezvous", position="position").withColumn("strategy", F.lit("rendezvous")), A.assign(shards, alone, "ring", per_weight=20).withColumn("strategy", F.lit("ring"))]
    return found[0].unionByName(found[1]).select("strategy", "shard_id", "runner")


@query("C12_ring")
def c12(spark, d):
    return A.ring(A.shard_table(spark, ["default"], 512), V.runners(spark, d), 20)


@query("D10_ownership_diff", "SELECT 'default' AS shard_group, s::INTEGER AS shard_id, CASE WHEN s % 2 = 0 THEN 'release' ELSE 'acquire' END AS change FROM range(0, 300) r(s) WHERE (s % 5 = 1 AND s < 250) <> (s % 2 = 0)")
def d10(spark, d):
    return A.difference(_assignment(spark), V.owned(spark, d), "r1:9000")


@query("D11_refresh_set", "SELECT 'default' AS shard_group, s::INTEGER AS shard_id FROM range(0, 300) r(s) WHERE s % 2 = 0 OR s % 3 = 0")
def d11(spark, d):
    return A.to_refresh(V.owned(spark, d), spark.range(0, 300, 3).select(F.lit("default").alias("shard_group"), F.col("id").cast("int").alias("shard_id")))


LOCKS = "locks AS (SELECT 'default' AS shard_group, range::INTEGER AS shard_id, CASE WHEN range % 3 = 0 THEN 'r1:9000' ELSE 'r2:9000' END AS owner FROM range(0, 200))"


def _locks(spark):
    return spark.range(200).select(F.lit("default").alias("shard_group"), F.col("id").cast("int").alias("shard_id"), F.when(F.col("id") % 3 == 0, "r1:9000").otherwise("r2:9000").alias("owner"))


@query("D15_acquire_locks", V.with_views("SELECT o.shard_id, l.owner IS NULL OR l.owner = 'r1:9000' AS acquired FROM owned o LEFT JOIN locks l USING (shard_group, shard_id)", LOCKS))
def d15(spark, d):
    return K.acquire(_locks(spark), V.owned(spark, d), F.lit("r1:9000"))[1].select("shard_id", "acquired")


@query("D15_locks_after", V.with_views("SELECT shard_id, owner FROM locks UNION ALL SELECT o.shard_id, 'r1:9000' FROM owned o LEFT JOIN locks l USING (shard_group, shard_id) WHERE l.owner IS NULL", LOCKS))
def d15b(spark, d):
    return K.acquire(_locks(spark), V.owned(spark, d), F.lit("r1:9000"))[0].select("shard_id", "owner")


@query("D16_refresh_locks", V.with_views("SELECT o.shard_id, CASE WHEN o.shard_id % 7 = 0 THEN 'failed' WHEN l.owner = 'r1:9000' THEN 'refreshed' ELSE 'lost' END AS outcome FROM owned o LEFT JOIN locks l USING (shard_group, shard_id)", LOCKS))
def d16(spark, d):
    return K.classify_refresh(_locks(spark), V.owned(spark, d), F.lit("r1:9000"), F.col("shard_id") % 7 == 0).select("shard_id", "outcome")


@query("D17_release_locks", V.with_views("SELECT shard_id, owner FROM locks WHERE NOT (owner = 'r1:9000' AND shard_id % 2 = 0)", LOCKS))
def d17(spark, d):
    return K.release(_locks(spark), V.owned(spark, d), F.lit("r1:9000")).select("shard_id", "owner")


@query("D17_release_all", V.with_views("SELECT shard_id, owner FROM locks WHERE owner <> 'r1:9000'", LOCKS))
def d17b(spark, d):
    return K.release(_locks(spark), None, F.lit("r1:9000")).select("shard_id", "owner")


_CHANGES = "changes AS (SELECT s::INTEGER AS shard_id, s % 2 = 0 AS gone FROM range(0, 300) r(s) WHERE (s % 5 = 1 AND s < 250) <> (s % 2 = 0))"
_TAKEN = "taken AS (SELECT shard_id FROM changes LEFT JOIN locks USING (shard_id) WHERE NOT gone AND (owner IS NULL OR owner = 'r1:9000'))"


def _rebalanced(spark, d):
    from .plans.rebalance import rebalance

    return rebalance(_assignment(spark), V.owned(spark, d), _locks(spark), V.messages(spark, d), V.replies(spark, d), "r1:9000")


@query("E9_locks_after", V.with_views("SELECT shard_id, owner FROM locks WHERE NOT (owner = 'r1:9000' AND shard_id IN (SELECT shard_id FROM changes WHERE gone)) UNION ALL SELECT shard_id, 'r1:9000' FROM taken WHERE shard_id NOT IN (SELECT shard_id FROM locks)", LOCKS, _CHANGES, _TAKEN))
def e9b(spark, d):
    return _rebalanced(spark, d).locks.select("shard_id", "owner")


@query("E9_messages_after", V.with_views("SELECT request_id, CASE WHEN hit THEN FALSE ELSE processed END AS processed, CASE WHEN hit THEN 0 ELSE retry_count END AS retry_count, CASE WHEN hit THEN NULL ELSE last_read END AS last_read FROM (SELECT *, shard_id IN (SELECT shard_id FROM taken) AND request_id NOT IN (SELECT request_id FROM replies WHERE is_exit) AS hit FROM messages)", LOCKS, _CHANGES, _TAKEN))
def e9c(spark, d):
    return _rebalanced(spark, d).messages.select("request_id", "processed", "retry_count", "last_read")


@query("E9_rebalance", V.with_views("SELECT shard_id, change, CASE WHEN change = 'acquire' THEN (owner IS NULL OR owner = 'r1:9000')::VARCHAR END AS acquired FROM (SELECT s::INTEGER AS shard_id, CASE WHEN s % 2 = 0 THEN 'release' ELSE 'acquire' END AS change FROM range(0, 300) r(s) WHERE (s % 5 = 1 AND s < 250) <> (s % 2 = 0)) LEFT JOIN locks USING (shard_id)", LOCKS))
def e9(spark, d):
    return _rebalanced(spark, d).changes.select("shard_id", "change", F.col("acquired").cast("string").alias("acquired"))


@query("F3_shards_per_runner", "SELECT 'r' || (range % 5) || ':9000' AS runner, count(*) AS n_shards FROM range(0, 250) GROUP BY 1")
def f3(spark, d):
    return A.per_runner(_assignment(spark))


@query("F4_keys_per_shard", V.with_views("SELECT shard_id, count(*) AS n_keys, count(*) <= 2 * (SELECT count(*) FROM messages) / 300.0 AS balanced FROM messages GROUP BY 1"))
def f4(spark, d):
    return A.per_shard(V.messages(spark, d), V.SHARDS)


@query("F5_moved_shards", "SELECT range::INTEGER AS shard_id, CASE WHEN range < 250 THEN 'r' || (range % 5) || ':9000' END AS runner_before, CASE WHEN range < 250 AND range % 5 <> 3 THEN 'r' || (range % 5) || ':9000' WHEN range < 250 THEN 'r9:9000' END AS runner_after FROM range(0, 250) WHERE range % 5 = 3")
def f5(spark, d):
    a = _assignment(spark)
    return A.moved(a, a.withColumn("runner", F.when(F.col("runner") == "r3:9000", "r9:9000").otherwise(F.col("runner")))).select("shard_id", "runner_before", "runner_after")


@query("E31_machine_ids", V.with_views("SELECT host, ((row_number() OVER (ORDER BY position) + 1000) % 1024)::INTEGER AS machine_id FROM runners"))
def e31(spark, d):
    return I.allocate_machine_ids(V.runners(spark, d), ["position"], 1000).select("host", "machine_id")


PROBES = "probed AS (SELECT host AS runner, healthy, CASE WHEN position % 9 > 0 THEN position % 4 > 0 END AS alive FROM runners)"


def _probes(spark, d):
    r = V.runners(spark, d)
    runners = r.select(F.col("host").alias("runner"), "healthy")
    return runners, r.filter("position % 9 > 0").select(F.col("host").alias("runner"), (F.col("position") % 4 > 0).alias("alive"))


@query("E22_update_health", V.with_views("SELECT runner, healthy, coalesce(alive, healthy) AS healthy_after FROM probed", PROBES))
@query("C11_health_match", V.with_views("SELECT runner, healthy, coalesce(alive, healthy) AS healthy_after FROM probed", PROBES))
def e22(spark, d):
    runners, probes = _probes(spark, d)
    return L.update_health(runners, probes, "none")


@query("E32_health_writes", V.with_views("SELECT runner, coalesce(alive, healthy) AS healthy_after FROM probed WHERE healthy <> coalesce(alive, healthy)", PROBES))
def e32(spark, d):
    runners, probes = _probes(spark, d)
    return L.health_writes(L.update_health(runners, probes, "none")).select("runner", "healthy_after")


# =========================================================================== keyed state
@query("D5_additive_upsert", V.with_views("SELECT entity_id, sum(delta)::BIGINT AS value FROM transfers GROUP BY 1"))
def d5(spark, d):
    t = V.transfers(spark, d)
    return K.add(t.filter("false").select("entity_id", F.col("delta").alias("value")), t, ["entity_id"], "value", "delta")


@query("D5_running_value", V.with_views("SELECT entity_id, o_orderkey, sum(CASE WHEN reset THEN 0 ELSE delta END) OVER (PARTITION BY entity_id, e ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS value FROM (SELECT *, sum(reset::INTEGER) OVER (PARTITION BY entity_id ORDER BY o_orderkey) AS e FROM transfers)"))
def d5b(spark, d):
    return K.running(V.transfers(spark, d), ["entity_id"], ["o_orderkey"], "delta", resets=F.col("reset")).select("entity_id", "o_orderkey", "value")


@query("D6_domain_insert", V.with_views("SELECT workflow_name, execution_id, timer_name, CASE WHEN timer_name = 't2' THEN TIMESTAMP '2000-01-01' ELSE min_by(fire_at, seq) END AS fire_at FROM timers GROUP BY 1, 2, 3"))
def d6(spark, d):
    """All timers named t2 are stored already, at another time."""
    t = V.timers(spark, d)
    stored = t.filter("timer_name = 't2'").dropDuplicates(["workflow_name", "execution_id", "timer_name"]).withColumn("fire_at", F.lit("2000-01-01").cast(t.schema["fire_at"].dataType))
    return K.insert_ignore(stored, t, ["workflow_name", "execution_id", "timer_name"], ["seq"])[0].drop("seq")


@query("D7_array_append", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS steps FROM conversations GROUP BY 1")
def d7(spark, d):
    return K.append_values(V.table(spark, d, "conversations"), ["conv_id"], ["turn"], "role", "steps").select("conv_id", F.array_join("steps", ",").alias("steps"))


@query("D8_conditional_update", V.with_views(f"SELECT count_if(NOT processed AND {DUE}) AS changed FROM messages"))
def d8(spark, d):
    return K.update_where(V.messages(spark, d), B.unprocessed() & B.due(V.as_of()), {"processed": F.lit(True)})[1]


@query("D9_delete", V.with_views("SELECT k AS key, k IN (SELECT key FROM journal) AS existed FROM (SELECT DISTINCT conv_id % 50 || '/user' AS k FROM conversations)"))
def d9(spark, d):
    keys = V.table(spark, d, "conversations").select(F.concat((F.col("conv_id") % 50).cast("string"), F.lit("/user")).alias("key")).distinct()
    return K.delete(V.journal(spark, d), keys, ["key"])[1]


CUTOFF = "2024-01-01 00:50:00"


@query("D12_journal_ttl", V.with_views(f"SELECT key FROM journal WHERE completed_at IS NULL OR completed_at >= TIMESTAMP '{CUTOFF}'"))
def d12(spark, d):
    return K.expire(V.journal(spark, d), "completed_at", F.lit(CUTOFF).cast("timestamp_ntz"))[0].select("key")


def _timer_rows(spark, d):
    return V.timers(spark, d).select("*", F.col("fire_at").alias("created_at"), (F.col("seq") % 2 == 0).alias("fired"))


@query("D13_workflow_ttl", V.with_views("SELECT a AS timers, b AS deferreds, a + b AS deleted FROM (SELECT count_if(seq % 2 = 0 AND fire_at < TIMESTAMP '1997-01-01') AS a, count_if(seq % 3 = 0 AND fire_at < TIMESTAMP '1997-01-01') AS b FROM timers)"))
def d13(spark, d):
    t = _timer_rows(spark, d)
    deferred = t.select((F.col("seq") % 3 == 0).alias("resolved"), F.col("fire_at").alias("resolved_at"))
    return W.expired_workflow_rows(t, deferred, F.lit("1997-01-01").cast("timestamp_ntz"))


@query("D14_mark_completed", V.with_views(f"SELECT key, CASE WHEN ends_with(key, '/user') THEN TIMESTAMP '{V.AS_OF}' ELSE completed_at END AS completed_at FROM journal"))
def d14(spark, d):
    j = V.journal(spark, d)
    return K.mark_completed(j, j.filter(F.col("key").endswith("/user")), V.as_of()).select("key", "completed_at")


@query("D18_buffered_commit", "WITH writes AS (SELECT conv_id, turn, role || '-' || conv_id % 10 AS key, text AS value, (conv_id + turn) % 6 = 5 AS gone FROM conversations WHERE conv_id % 4 <> 0), latest AS (SELECT key, arg_max(value, conv_id * 1000 + turn) AS value, arg_max(gone, conv_id * 1000 + turn) AS gone FROM writes GROUP BY 1), stored AS (SELECT DISTINCT role || '-' || k AS key, 'old' AS value FROM conversations, range(0, 14) r(k)) SELECT key, value FROM latest WHERE NOT gone UNION ALL SELECT key, value FROM stored WHERE key NOT IN (SELECT key FROM latest)")
def d18(spark, d):
    """Transactions over stored rows: some write, some delete, every fourth is rolled back."""
    c = V.table(spark, d, "conversations")
    op = F.when((F.col("conv_id") + F.col("turn")) % 6 == 5, "delete").otherwise("save")
    writes = c.select(F.col("conv_id").alias("tx"), "turn", F.concat_ws("-", "role", (F.col("conv_id") % 10).cast("string")).alias("key"), F.col("text").alias("value"), op.alias("op"))
    outcomes = c.select(F.col("conv_id").alias("tx")).distinct().select("tx", (F.col("tx") % 4 != 0).alias("committed"), F.col("tx").alias("seq"))
    stored = c.select("role").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(13)))).select(F.concat_ws("-", "role", F.col("k").cast("string")).alias("key"), F.lit("old").alias("value"))
    return K.commit_buffers(stored, writes, outcomes, ["key"], ["turn"])


# =========================================================================== workflows
@query("C9_journal_replay")
def c9(spark, d):
    c = V.table(spark, d, "customer").select(F.lit("step").alias("name"), F.col("c_custkey").cast("string").alias("key"), F.lit("User").alias("entity_type"), F.col("c_name").alias("entity_id"))
    held = c.filter("cast(key as int) % 2 = 0").select(H.journal_key(F.col("name"), F.col("key"), F.col("entity_type"), F.col("entity_id")).alias("key"), F.col("entity_id").alias("value"))
    return W.replay(c, held).select("key", "cached", "cached_value")


SQL["C9_journal_replay"] = "SELECT c_custkey::VARCHAR AS key, c_custkey % 2 = 0 AS cached, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS cached_value FROM customer"


@query("E18_journaled_activity", "SELECT count(*) AS n_entries, count_if(value = 'ran') AS n_ran FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'ran' END AS value FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 > 0)")
def e18(spark, d):
    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("call_id"), F.lit("step").alias("name"), F.col("c_custkey").cast("string").alias("key"), F.lit("User").alias("entity_type"), F.col("c_name").alias("entity_id"))
    held = c.filter("call_id % 2 = 0").select(H.journal_key(F.col("name"), F.col("key"), F.col("entity_type"), F.col("entity_id")).alias("key"), F.lit("old").alias("value"))
    results = c.select("call_id", (F.col("call_id") % 3 > 0).alias("ok"), F.lit("ran").alias("value"), F.col("call_id").alias("seq"))
    return W.journaled(c, results, held.withColumn("seq", F.lit(0).cast("long")), ["seq"]).agg(F.count("*").alias("n_entries"), F.count_if(F.col("value") == "ran").alias("n_ran"))


@query("E15_durable_sleep", V.with_views("SELECT workflow_name, execution_id, timer_name, min_by(fire_at, seq) AS fire_at, min_by(fire_at, seq) <= TIMESTAMP '1997-01-01' AS fired FROM timers GROUP BY 1, 2, 3"))
def e15(spark, d):
    t = V.timers(spark, d)
    none = t.filter("false").select("workflow_name", "execution_id", "timer_name", "fire_at", F.lit(False).alias("fired"))
    return W.sleep(none, t, F.lit("1997-01-01").cast("timestamp_ntz"), ["seq"])


def _deferred(spark, d):
    c = V.table(spark, d, "conversations")
    return c.select(F.lit("chat").alias("workflow_name"), F.col("conv_id").cast("string").alias("execution_id"), F.when(F.col("turn") == 3, W.INTERRUPT).otherwise(F.col("role")).alias("deferred_name"), F.when(F.col("conv_id") % 5 > 0, F.col("text")).alias("value"), F.lit(True).alias("resolved"), "turn")


@query("E16_await_deferred", "SELECT e.c::VARCHAR AS execution_id, CASE WHEN r.conv_id IS NULL THEN 'pending' WHEN e.c % 5 = 0 THEN 'error' ELSE 'resolved' END AS state, r.v AS value FROM (SELECT DISTINCT conv_id AS c FROM conversations UNION SELECT 1000000) e LEFT JOIN (SELECT conv_id, CASE WHEN conv_id % 5 > 0 THEN arg_max(text, turn) END AS v FROM conversations WHERE role = 'user' AND turn <> 3 GROUP BY 1) r ON r.conv_id = e.c")
def e16(spark, d):
    done = _deferred(spark, d)
    state = W.resolve(done.filter("turn = 0"), done.filter("turn > 0"), ["turn"])
    waits = done.select("execution_id").distinct().unionByName(spark.createDataFrame([("1000000",)], "execution_id string")).select(F.lit("chat").alias("workflow_name"), "execution_id", F.lit("user").alias("deferred_name"))
    return W.await_deferred(waits, state).select("execution_id", "state", "value")


@query("E17_interrupts", "SELECT DISTINCT 'chat' AS workflow_name, conv_id::VARCHAR AS execution_id FROM conversations WHERE turn = 3")
def e17(spark, d):
    return W.interrupted(_deferred(spark, d))


@query("E19_retry_loop", "SELECT o_orderkey AS call_id, o_orderkey % 6 <= 3 AS succeeded, (least(o_orderkey % 6, 3) + 1)::INTEGER AS attempts, (CASE least(o_orderkey % 6, 3) WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 7 END)::BIGINT AS waited_secs, CASE WHEN o_orderkey % 6 > 3 THEN 'e3' END AS error FROM orders")
def e19(spark, d):
    calls = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("call_id"))
    outcomes = calls.select("call_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt"))
    outcomes = outcomes.select("call_id", "attempt", (F.col("attempt") >= F.col("call_id") % 6).alias("ok"), F.concat(F.lit("e"), F.col("attempt").cast("string")).alias("error"))
    return W.attempts(calls, outcomes, 3)


def _pending(spark, d):
    return V.transfers(spark, d).select("entity_id", F.col("o_orderkey").cast("string").alias("timer_id"), F.col("at").alias("scheduled_at"), (F.col("o_orderkey") % 10 * 86400000).alias("delay_ms"), (F.col("o_orderkey") % 3 == 0).alias("cancelled"))


@query("E29_timer_fires", V.with_views("SELECT entity_id, o_orderkey::VARCHAR AS timer_id, made + to_days((o_orderkey % 10)::INTEGER) AS fired_at FROM transfers WHERE o_orderkey % 3 <> 0 AND made + to_days((o_orderkey % 10)::INTEGER) <= TIMESTAMP '1997-01-01'"))
def e29(spark, d):
    return W.timer_workflow(_pending(spark, d), F.lit("1997-01-01").cast("timestamp_ntz"))[0].select("entity_id", "timer_id", "fired_at")


@query("E29_pending_after", V.with_views("SELECT entity_id, o_orderkey::VARCHAR AS timer_id FROM transfers WHERE made + to_days((o_orderkey % 10)::INTEGER) > TIMESTAMP '1997-01-01'"))
def e29b(spark, d):
    return W.timer_workflow(_pending(spark, d), F.lit("1997-01-01").cast("timestamp_ntz"))[1].select("entity_id", "timer_id")


# =========================================================================== lifecycle
ISLANDS = """marked AS (SELECT *, CASE WHEN healthy IS NOT DISTINCT FROM lag(healthy) OVER (PARTITION BY runner ORDER BY ts) THEN 0 ELSE 1 END AS starts FROM health),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY runner ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM marked),
counted AS (SELECT *, row_number() OVER (PARTITION BY runner, island ORDER BY ts) AS run_length, min(ts) OVER (PARTITION BY runner, island) AS since FROM numbered)"""


@query("E25_lost_locks", V.with_views("SELECT runner, min(ts) AS ts FROM counted WHERE NOT healthy AND run_length >= 3 GROUP BY 1", ISLANDS))
def e25(spark, d):
    return L.lost_locks(V.health(spark, d), ["runner"], ["ts"], ~F.col("healthy"), 3)


@query("E26_crash_recovery", V.with_views("SELECT runner, ts, run_length::INTEGER AS crashes, run_length > 2 AS dropped, CASE WHEN run_length <= 2 THEN floor(least(500 * pow(1.5, run_length - 1), 10000))::BIGINT END AS backoff_ms FROM counted WHERE NOT healthy", ISLANDS))
def e26(spark, d):
    return L.crashes(V.health(spark, d), ["runner"], ["ts"], ~F.col("healthy"), 2).select("runner", "ts", "crashes", "dropped", "backoff_ms")


@query("E24_detachment", V.with_views("SELECT runner, ts, transition FROM (SELECT *, coalesce(lag(transition) OVER (PARTITION BY runner ORDER BY ts), 'attach') AS b FROM (SELECT runner, ts, CASE WHEN NOT healthy AND run_length >= 2 THEN 'detach' WHEN healthy AND run_length > 1 AND date_diff('millisecond', since, ts) >= 3600000 THEN 'attach' END AS transition FROM counted) WHERE transition IS NOT NULL) WHERE transition <> b", ISLANDS))
def e24(spark, d):
    return L.detachments(V.health(spark, d), ["runner"], "ts", F.col("healthy"), 3_600_000, 2)


@query("E24_detachment_stream", SQL["E24_detachment"])
def e24b(spark, d):
    """The stateful stream over the same signals, all in one trigger."""
    from .streaming.messages import detachments, table_stream

    events = V.table(spark, d, "events")
    raw = table_stream(spark, f"{d}/event[s].parquet", events.schema)
    signals = raw.select((F.col("user_id") % 20).alias("runner"), "ts", (F.col("event_type") != "error").alias("healthy"))
    return T.drain(detachments(signals, 3_600_000, 2), "detachments")


@query("D1_insert_ignore_stream", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def d1c(spark, d):
    """Insert-ignore on a stream: repeats of a key are dropped while the watermark holds them."""
    from .streaming.messages import first_writers, table_stream

    items = V.table(spark, d, "lineitem")
    raw = table_stream(spark, f"{d}/lineite[m].parquet", items.schema).select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("at"))
    return T.drain(first_writers(raw, ["l_orderkey", "l_linenumber"], "at", "30 days"), "firsts").select("l_orderkey", "l_linenumber")


@query("E5_reassembly_stream", SQL["E5_stream_reassembly"])
def e5b(spark, d):
    """The stateful stream over the same chunks, each request closed at its end."""
    from .streaming.messages import reassemble, table_stream

    chunks, path = V.chunks(spark, d).withColumn("close", F.lit(False)), T.scratch(spark, "chunks")
    ends = chunks.select("request_id").distinct().select("request_id", F.lit(0).alias("sequence"), F.array().cast("array<string>").alias("values"), F.lit(1 << 40).alias("arrival"), F.lit(True).alias("close"))
    chunks.unionByName(ends).write.parquet(path)
    return T.drain(reassemble(table_stream(spark, path, chunks.schema)), "reassembled")


@query("E15_sleep_stream", V.with_views("SELECT workflow_name, execution_id, timer_name, min_by(fire_at, seq) AS fire_at, min_by(fire_at, seq) <= (SELECT max(TIMESTAMP '1996-06-01' + to_seconds(seq)) FROM timers) AS fired FROM timers GROUP BY 1, 2, 3"))
def e15b(spark, d):
    """Durable sleeps from a stream of requests, as of the latest one."""
    from .streaming.messages import batch_table, due_timers, table_stream

    path = T.scratch(spark, "timers")
    asked = V.timers(spark, d).withColumn("asked_at", F.timestamp_add("SECOND", F.col("seq").cast("int"), F.lit("1996-06-01").cast("timestamp_ntz"))).drop("seq")
    asked.write.parquet(f"{path}/asked")
    none = asked.filter("false").select("workflow_name", "execution_id", "timer_name", "fire_at", F.lit(False).alias("fired"))
    due_timers(table_stream(spark, f"{path}/asked", asked.schema), batch_table(f"{path}/timers"), lambda: none, f"{path}/log").awaitTermination()
    return spark.read.parquet(f"{path}/timers").select("workflow_name", "execution_id", "timer_name", "fire_at", "fired")


@query("A5_runner_snapshots", V.with_views("SELECT host, port, weight, healthy FROM runners"))
def a5(spark, d):
    """The registry that a stream of runner changes leaves: the last batch's full snapshot."""
    from .streaming.messages import runner_snapshots, table_stream

    path = T.scratch(spark, "runners")
    raw = table_stream(spark, f"{d}/supplie[r].parquet", V.table(spark, d, "supplier").schema)
    changes = raw.select(F.col("s_name").alias("host"), F.lit(9000).alias("port"), (F.col("s_suppkey") % 4).cast("int").alias("weight"), (F.col("s_acctbal") >= 0).alias("healthy"), F.col("s_suppkey").alias("seq"))
    runner_snapshots(changes, lambda df, n: df.write.mode("overwrite").parquet(f"{path}/now"), f"{path}/log").awaitTermination()
    return spark.read.parquet(f"{path}/now")


@query("E13_idle_entities", V.with_views(f"SELECT entity_id, max(created_at) AS last_active FROM messages WHERE created_at <= TIMESTAMP '{V.AS_OF}' GROUP BY 1 HAVING date_diff('second', max(created_at), TIMESTAMP '{V.AS_OF}') >= 7200 AND entity_id NOT IN ('user-3', 'user-4')"))
def e13(spark, d):
    m = V.messages(spark, d).filter(F.col("created_at") <= V.as_of())
    veto = spark.createDataFrame([("user-3",), ("user-4",)], "entity_id string")
    return L.idle(m, ["entity_id"], "created_at", V.as_of(), F.lit(7200), veto=veto)


@query("E14_reap_interval", "SELECT greatest(min(s_suppkey * 700), 5000)::BIGINT AS interval_ms FROM supplier")
def e14(spark, d):
    return L.reap_interval(V.table(spark, d, "supplier").select((F.col("s_suppkey") * 700).alias("idle_ms")), "idle_ms")


_SINGLETON_SHARD = "(list_reduce(list_prepend(5381::UBIGINT, list_transform(string_split(p_brand, ''), lambda c: ord(c)::UBIGINT)), lambda a, b: (a * 33 + b) % 4294967296) % 300)::INTEGER"


@query("E23_singletons", f"WITH {ASSIGNED}, s AS (SELECT DISTINCT p_brand AS name, {_SINGLETON_SHARD} AS shard_id FROM part) SELECT name, 'default' AS shard_group, s.shard_id, runner FROM s LEFT JOIN assignment a ON a.shard_id = s.shard_id")
def e23(spark, d):
    s = V.table(spark, d, "part").select(F.col("p_brand").alias("name"), F.lit("default").alias("shard_group"), F.col("p_partkey").alias("seq"))
    return L.place_singletons(s, _assignment(spark), 300, ["seq"])


@query("E23_singleton_respawn", "SELECT p_brand AS name, count(*) AS crashes, (1000 * pow(2, least(count(*) - 1, 10)))::BIGINT AS backoff_ms FROM part WHERE p_partkey % 50 = 0 GROUP BY 1")
def e23b(spark, d):
    """How long each singleton waits before it is started again."""
    crashes = V.table(spark, d, "part").filter("p_partkey % 50 = 0").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("crashes"))
    return L.singleton_respawn(crashes, "crashes").select("name", "crashes", F.col("backoff_ms").cast("long").alias("backoff_ms"))


# =========================================================================== F, G: counts and inspection
@query("F1_count", V.with_views("SELECT count(*) AS n FROM messages WHERE tag = 'click'"))
def f1(spark, d):
    return G.count_where(V.messages(spark, d), tag="click")


@query("F2_count_if", V.with_views("SELECT count_if(processed) AS done, count(*) AS total FROM messages"))
def f2(spark, d):
    return V.messages(spark, d).agg(F.count_if("processed").alias("done"), F.count("*").alias("total"))


@query("F6_gauges", V.with_views("SELECT (SELECT count(DISTINCT entity_id) FROM messages) AS entities, (SELECT count(DISTINCT p_brand) FROM part) AS singletons, (SELECT count(*) FROM runners) AS runners, (SELECT count_if(healthy) FROM runners) AS runners_healthy, 250::BIGINT AS shards"))
def f6(spark, d):
    singletons = V.table(spark, d, "part").select(F.col("p_brand").alias("name"))
    return L.gauges(V.messages(spark, d), singletons, V.runners(spark, d), _assignment(spark), ["shard_id", "entity_id"])


@query("A13_metrics", V.with_views("SELECT g.*, d.runner, d.sharding_detached, k.keepalive_failures, k.failure_streak, x.acquire_retry_attempts, x.acquire_retry_window_exhausted FROM gauges g, detached d JOIN kept k USING (runner), (SELECT count(*) AS acquire_retry_attempts, count(DISTINCT shard_id) AS acquire_retry_window_exhausted FROM owned JOIN locks USING (shard_group, shard_id) WHERE owner <> 'r1:9000') x", LOCKS,
    "gauges AS (SELECT (SELECT count(DISTINCT entity_id) FROM messages) AS entities, (SELECT count(DISTINCT p_brand) FROM part) AS singletons, (SELECT count(*) FROM runners) AS runners, (SELECT count_if(healthy) FROM runners) AS runners_healthy, 250::BIGINT AS shards)",
    "last_good AS (SELECT runner, max(event_id) FILTER (healthy) AS good FROM health GROUP BY 1)",
    "kept AS (SELECT runner, count_if(NOT healthy) AS keepalive_failures, count_if(NOT healthy AND (good IS NULL OR event_id > good)) AS failure_streak FROM health JOIN last_good USING (runner) GROUP BY 1)",
    "detached AS (SELECT runner, CASE WHEN failure_streak >= 2 THEN 1 ELSE 0 END AS sharding_detached FROM kept)"))
def a13(spark, d):
    """One row for each runner: the gauges, whether it is detached (two failures in a row), and the counters of keep-alives and lock attempts."""
    singletons = V.table(spark, d, "part").select(F.col("p_brand").alias("name"))
    gauges = L.gauges(V.messages(spark, d), singletons, V.runners(spark, d), _assignment(spark), ["shard_id", "entity_id"])
    kept = L.keepalive(V.health(spark, d), ["runner"], ["event_id"], ~F.col("healthy"))
    refused = K.acquire(_locks(spark), V.owned(spark, d), F.lit("r1:9000"))[1].filter(~F.col("acquired"))
    tries = refused.agg(F.count("*").alias("acquire_retry_attempts"), F.count_distinct("shard_id").alias("acquire_retry_window_exhausted"))
    return kept.withColumn("sharding_detached", F.when(F.col("failure_streak") >= 2, 1).otherwise(0)).crossJoin(gauges).crossJoin(tries)


@query("F7_active_entities", V.with_views("SELECT count(DISTINCT entity_id) AS n FROM messages WHERE NOT processed"))
def f7(spark, d):
    return V.messages(spark, d).filter(B.unprocessed()).agg(F.count_distinct("entity_type", "entity_id").alias("n"))


@query("F9_singleton_state", "SELECT arg_max(user_id::VARCHAR, event_id) FILTER (event_type = 'signup') AS runner_id, count_if(event_type = 'click') AS tick_count, max(event_id) FILTER (event_type = 'click') AS last_tick_at, max(event_id) FILTER (event_type = 'signup') AS became_leader_at, max(event_id) FILTER (event_type = 'error') AS graceful_shutdown_at FROM events")
def f9(spark, d):
    kinds = F.create_map(F.lit("signup"), F.lit("takeover"), F.lit("click"), F.lit("tick"), F.lit("error"), F.lit("shutdown"))
    t = V.table(spark, d, "events").select("event_id", kinds[F.col("event_type")].alias("kind"), F.col("user_id").cast("string").alias("runner"))
    return L.singleton_state(t, ["event_id"], "kind", "runner")


@query("F10_total_shards", "SELECT count(*)::BIGINT AS n FROM range(0, 2048) a, range(0, 2) b")
def f10(spark, d):
    return A.shard_table(spark, ["default", "other"], 2048).agg(F.count("*").alias("n"))


@query("A11_first_row", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 1")
def a11b(spark, d):
    """The forms of a pass-through that return one row, or none."""
    V.table(spark, d, "orders").createOrReplaceTempView("orders")
    text = "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey > :low ORDER BY o_orderkey LIMIT 1"
    return T.run_sql(spark, text, low=100).unionByName(T.run_sql(spark, text, low=1 << 40))


@query("G1_recent_messages", V.with_views("SELECT request_id, tag, created_at FROM messages WHERE NOT processed ORDER BY created_at DESC, request_id DESC LIMIT 100"))
def g1(spark, d):
    return G.recent_messages(V.messages(spark, d), processed=False).select("request_id", "tag", "created_at")


@query("G2_recent_replies", V.with_views("SELECT id, request_id, sequence FROM replies WHERE is_exit ORDER BY created_at DESC, id DESC LIMIT 50"))
def g2(spark, d):
    return G.recent_replies(V.replies(spark, d), is_exit=True, limit=50).select("id", "request_id", "sequence")


@query("G3_recent_journal", V.with_views("SELECT key, octet_length(encode(value)) AS value_size FROM journal WHERE completed_at IS NOT NULL AND starts_with(key, '1') ORDER BY updated_at DESC, key DESC LIMIT 20"))
def g3(spark, d):
    return G.recent_journal(V.journal(spark, d), "1", True, 20).select("key", "value_size")


@query("G5_ordered_keys", V.with_views("SELECT key FROM journal WHERE starts_with(key, '2') ORDER BY key"))
def g5(spark, d):
    return G.keys_with_prefix(V.journal(spark, d), "2")


@query("G6_history", V.with_views("SELECT request_id, created_at FROM messages WHERE entity_id = 'user-5' ORDER BY created_at, request_id"))
def g6(spark, d):
    return G.history(V.messages(spark, d), {"entity_id": "user-5"}, ["created_at", "request_id"]).select("request_id", "created_at")


# =========================================================================== H: client operators
@query("H4_notify", V.with_views("SELECT request_id, deliver_at FROM messages UNION ALL SELECT request_id + 1000000000, NULL FROM messages WHERE tag = 'click'"))
def h4(spark, d):
    m = V.messages(spark, d).select("request_id", "deliver_at")
    new = V.messages(spark, d).filter("tag = 'click'").select((F.col("request_id") + 1_000_000_000).alias("request_id"), F.lit(None).cast("timestamp_ntz").alias("deliver_at"))
    return m.unionByName(new)


@query("H7_send_at", V.with_views(f"SELECT request_id + 1000000000 AS request_id, created_at + INTERVAL 1 DAY AS deliver_at, created_at + INTERVAL 1 DAY <= TIMESTAMP '{V.AS_OF}' AS due FROM messages"))
def h7(spark, d):
    sent = V.messages(spark, d).select((F.col("request_id") + 1_000_000_000).alias("request_id"), (F.col("created_at") + F.make_dt_interval(days=F.lit(1))).alias("deliver_at"))
    return sent.withColumn("due", B.due(V.as_of()))


