"""Streams and trace statistics."""
import uuid

from pyspark.sql import functions as F

from kinweave.catalog import rulesql as r
from kinweave.catalog.question_queries import _LOG, _session_log
from kinweave.catalog.registry import query
from kinweave.functions.codes import pad_code
from kinweave.operators import folding
from kinweave.plans import traces as tr
from kinweave.session import shared_dir
from kinweave.streaming import focus as fc, refresh as rf, windows as sw

_SESS = """se AS (SELECT user_id, min(ts) session_start, max(ts) last_ts, count(*) n_questions FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) g FROM
 (SELECT user_id, ts, CASE WHEN ts-lag(ts) OVER (PARTITION BY user_id ORDER BY ts)<=INTERVAL 1800 SECONDS THEN 0 ELSE 1 END brk FROM events)) GROUP BY user_id, g)"""
query("STR1_batch", "SELECT * FROM se", _SESS)(lambda t: sw.sessions(t.raw("events")))
query("STR1", "SELECT * FROM se WHERE last_ts + INTERVAL 1800 SECONDS <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTES", _SESS)(
    lambda t: sw.run_to_table(sw.sessions(sw.read_stream(t.spark, t.folder, "events", t.raw("events").schema)), "sessions"))

_DAYS = """dy AS (SELECT subject_code, event_type, date_trunc('day', ts)::TIMESTAMP AS "day", count(*) n, CAST(sum(CAST(coalesce(amount,0) AS DECIMAL(18,2))) AS DECIMAL(28,2)) total_amount FROM event GROUP BY 1,2,3)"""


def _event_stream(t):
    from kinweave.sources.tables import Tables

    class Live(Tables):
        def raw(self, name):
            return sw.read_stream(self.spark, self.folder, name, Tables.raw(self, name).schema)

    return Live(t.spark, t.folder).event


query("STR3_batch", "SELECT * FROM dy", _DAYS)(lambda t: sw.timeline(t.event))
query("STR3", """SELECT * FROM dy WHERE "day" + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""", _DAYS)(
    lambda t: sw.run_to_table(sw.timeline(_event_stream(t)), "timeline"))


def _as_stream(df, name):
    """A frame written to the shared folder and read back as a stream."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


_TURNS = _LOG + ", itm AS (SELECT session, CAST(turn AS INTEGER) turn, 'm' k, code, 0 pos FROM men UNION ALL SELECT session, CAST(turn AS INTEGER), 'r', code, pos FROM res)"
_FOCUS = """SELECT session, turn, coalesce(arg_max(CASE WHEN k='m' THEN code END, CASE WHEN k='m' THEN t END), arg_min(CASE WHEN k='r' THEN code END, CASE WHEN k='r' THEN (t,pos) END)) focus_code,
  CAST(count(*) AS INTEGER) n_focus, CAST(count(*) FILTER (WHERE k='r' AND t=turn) AS INTEGER) n_results FROM (SELECT DISTINCT session, turn FROM itm) x
  JOIN (SELECT session s, turn t, k, code, pos FROM itm) y ON s=session AND t BETWEEN turn-3 AND turn GROUP BY 1,2"""


def _turn_rows(t):
    _, mentions, results = _session_log(t)
    return mentions.select("session", "turn", "ord", F.lit("user_mention").alias("kind"), "code", "name").unionAll(
        results.select("session", "turn", "pos", F.lit("result_item"), "code", "name")).withColumn("ts", F.timestamp_seconds(F.lit(1700000000) + F.col("turn") * 60))


@query("STR2", _FOCUS, _TURNS)
def str2(t):
    out = sw.run_to_table(fc.focus(_as_stream(_turn_rows(t).coalesce(4), "turns")), "focus")
    return out.select("session", "turn", "focus_code", "n_focus", "n_results")


@query("STR2_closed", f"SELECT * FROM ({_FOCUS}) WHERE turn + 10 <= (SELECT max(turn) FROM itm)", _TURNS)
def str2_closed(t):
    """Turns that the watermark has passed, each given once."""
    with fc.with_timers(t.spark):
        out = sw.run_to_table(fc.closed_focus(_as_stream(_turn_rows(t).coalesce(4), "turns")), "closed-focus")
    return out.select("session", "turn", "focus_code", "n_focus", "n_results")


@query("STR4", "SELECT subject_code, party_id, rule_id, score_c FROM parties WHERE subject_code IN (SELECT stock_code FROM holding)", r.CTES)
def str4(t):
    """Snapshot holdings are there, change holdings arrive in three batches, the last of them after a restart: the candidates end where a
    full run over both ends."""
    known, arriving = t.holding.where("ratio IS NULL"), t.holding.where("ratio IS NOT NULL")
    sink = lambda folder=None: rf.CandidateRefresh(t.company, t.entity, known, t.position, t.controller, t.guarantee_pair, folder)
    spark, first = t.spark, sink()
    arrivals = f"{first.folder}/arrivals"

    def run(parts, to):
        for k in parts:
            arriving.where(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(arrivals)
        spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", 1).parquet(arrivals).writeStream.foreachBatch(to).trigger(
            availableNow=True).option("checkpointLocation", f"{first.folder}/checkpoint").start().awaitTermination()
        return to
    run([0, 1], first)
    return run([2], sink(first.folder)).parties(spark).select("subject_code", "party_id", "rule_id", "score_c")


# ---- traces: one per event, its times and calls made from the event's numbers ----
_INTENT = "CASE event_type WHEN 'click' THEN 'Q1' WHEN 'view' THEN 'Q4' WHEN 'purchase' THEN 'Q5' WHEN 'signup' THEN 'Q7' ELSE 'Q2' END"


def _traces(t):
    e, i = t.raw("events"), F.col("event_id")
    step = lambda node, ms: F.struct(F.lit(node).alias("node"), ms.cast("double").alias("elapsed_ms"))
    call = F.struct(F.lit("answer").alias("purpose"), (i % 50).cast("double").alias("elapsed_ms"), F.lit(1).cast("bigint").alias("tokens"), (i % 4 == 0).alias("retried"))
    events = F.when(i % 13 == 0, F.array().cast("array<struct<node:string,elapsed_ms:double>>")).otherwise(F.array(
        step("classify", i % 7), step("slot_fill", i % 7 + i % 11), step("entity_link", i % 7 + i % 11 + i % 5), step("answer_generate", i % 7 + i % 11 + i % 5 + i % 17)))
    return e.select(
        i.cast("string").alias("trace_id"), F.col("ts").alias("written_at"), F.col("props").alias("question"), F.expr(_INTENT).alias("intent"), (i % 9 == 0).alias("uncertain"),
        F.array_repeat(call, (i % 3).cast("int")).alias("llm_calls"), (i % 20).alias("query_result_count"), F.when(i % 6 != 0, (i % 23).cast("double")).alias("query_elapsed_ms"),
        F.when(F.col("event_type") == "signup", "SELECT 1").alias("generated_query"), F.when(i % 2 == 0, F.struct((i % 4 == 0).alias("passed"))).alias("validation"),
        F.when(i % 5 != 0, F.struct((i % 10 != 1).alias("passed"))).alias("verify_result"), events.alias("events"), (i % 100).cast("double").alias("total_elapsed_ms"))


def _pct(frm, keys):
    return f"""SELECT {keys}, n, v[1+least(n*50//100, n-1)] p50, v[1+least(n*95//100, n-1)] p95 FROM (SELECT {keys}, count(*) n, list(ms ORDER BY ms) v FROM ({frm}) GROUP BY {keys})"""


query("TR1", f"""SELECT intent, c AS "count", llm_calls, verify_fail, q7_generated, q7_rejected, p50, p95 FROM (SELECT {_INTENT} intent, count(*) c, CAST(sum(event_id%3) AS BIGINT) llm_calls,
   count(*) FILTER (WHERE event_id%5<>0 AND event_id%10=1) verify_fail, count(*) FILTER (WHERE event_type='signup') q7_generated, count(*) FILTER (WHERE event_type='signup' AND event_id%4=2) q7_rejected FROM events GROUP BY 1)
  JOIN ({_pct(f"SELECT {_INTENT} intent, CAST(event_id%100 AS DOUBLE) ms FROM events", "intent")}) USING (intent)""")(lambda t: tr.by_intent(_traces(t)))
_I = f"SELECT event_id i, {_INTENT} intent FROM events"
_STAGES = f"""stg AS (SELECT i, intent, 'classify' stage, CAST(CASE WHEN i%13=0 THEN 0 ELSE i%7 END AS DOUBLE) ms FROM ({_I}) UNION ALL SELECT i, intent, 'slot_fill', CASE WHEN i%13=0 THEN 0 ELSE i%11 END FROM ({_I})
 UNION ALL SELECT i, intent, 'entity_link', CASE WHEN i%13=0 THEN 0 ELSE i%5 END FROM ({_I}) UNION ALL SELECT i, intent, 'execute', CASE WHEN i%6<>0 THEN i%23 ELSE 0 END FROM ({_I})
 UNION ALL SELECT i, intent, 'answer_generate', CASE WHEN i%13=0 THEN 0 ELSE i%17 END FROM ({_I}) UNION ALL SELECT i, intent, 'verify', CASE WHEN i%13=0 THEN 0 ELSE greatest(0, i%100-(i%7+i%11+i%5+i%17)) END FROM ({_I}))"""
query("W4", "SELECT CAST(i AS VARCHAR) trace_id, intent, stage, ms FROM stg", _STAGES)(lambda t: tr.stage_times(_traces(t)))
query("TR2", _pct("SELECT * FROM stg", "intent, stage"), _STAGES)(lambda t: tr.stage_percentiles(_traces(t)))
query("TR2_calls", f"""SELECT intent, c calls, rt retries, p50, p95 FROM (SELECT intent, count(*) c, count(*) FILTER (WHERE i%4=0) rt FROM ({_I}), range(2) q(k) WHERE k<i%3 GROUP BY 1)
  JOIN ({_pct(f"SELECT intent, CAST(i%50 AS DOUBLE) ms FROM ({_I}), range(2) q(k) WHERE k<i%3", "intent")}) USING (intent)""")(lambda t: tr.call_percentiles(_traces(t)))
query("TR3", f"""SELECT CAST(event_id AS VARCHAR) trace_id, left(props,60) question, {_INTENT} intent, event_id%9=0 uncertain, CAST(event_id%100 AS DOUBLE) total_ms, event_id%5=0 OR event_id%10<>1 verify_passed,
  CAST(event_id%3 AS INTEGER) llm_calls, event_id%20 query_result_count, event_type='signup' AS "generated", event_id%2<>0 OR event_id%4=0 validation_passed FROM events ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 20""")(
    lambda t: tr.summaries_of(_traces(t)))
query("W11", "SELECT CAST(event_id AS VARCHAR) trace_id FROM events ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 500")(
    lambda t: tr.newest(_traces(t)).select("trace_id"))


def _query_log(t):
    e = t.raw("events")
    return e.select("event_type", (F.col("user_id") % 40).alias("slots"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"))


_REPEATS = f"""lg AS (SELECT event_type, user_id%40 slots, CAST(floor(epoch_us(ts)/1000000) AS BIGINT) ts, count(*) n FROM events GROUP BY 1,2,3),
rp AS (SELECT *, n-1+CAST(coalesce(ts-lag(ts) OVER (PARTITION BY event_type, slots ORDER BY ts)<{tr.TTL_SECONDS}, false) AS BIGINT) repeats FROM lg)"""
query("TR4_repeats", "SELECT event_type, slots, ts, n, repeats FROM rp", _REPEATS)(lambda t: tr.repeats(_query_log(t), ["event_type", "slots"]))
query("TR4_repeats_rate", "SELECT CAST(sum(n) AS BIGINT) n, CAST(sum(repeats) AS BIGINT) repeats FROM rp", _REPEATS)(
    lambda t: tr.repeat_rate(tr.repeats(_query_log(t), ["event_type", "slots"])))
_CACHE = """lg AS (SELECT event_type, user_id%40 slots, CAST(floor(epoch_us(ts)/1000000) AS BIGINT) ts FROM events),
kt AS (SELECT event_type, slots, list(ts ORDER BY ts) a FROM lg GROUP BY 1,2),
hc AS (SELECT event_type, slots, unnest(a) ts, unnest(list_reduce(list_prepend([a[1], 1::BIGINT], [[x, 0::BIGINT] for x in a[2:]]), lambda p, c: p)) z FROM kt LIMIT 0),
walk AS (SELECT event_type, slots, a, 1::BIGINT i, a[1] st, 0::BIGINT h FROM kt UNION ALL
 SELECT event_type, slots, a, i+1, CASE WHEN a[i+1]-st>=3600 THEN a[i+1] ELSE st END, CASE WHEN a[i+1]-st>=3600 THEN 0 ELSE 1 END FROM walk WHERE i<len(a))"""
_CACHE = _CACHE.split("hc AS")[0] + "walk AS" + _CACHE.split("walk AS")[1]
query("TR4", "SELECT event_type, slots, a[i] ts, count(*) n, CAST(sum(h) AS BIGINT) hits FROM walk GROUP BY 1,2,3", _CACHE, recursive=True)(
    lambda t: tr.cache_hits(_query_log(t), ["event_type", "slots"]))
query("TR4_rate", "SELECT count(*) n, CAST(sum(h) AS BIGINT) hits FROM walk", _CACHE, recursive=True)(
    lambda t: tr.cache_rate(tr.cache_hits(_query_log(t), ["event_type", "slots"])))
query("TR5", "SELECT CAST(sum(n_chars) AS BIGINT) prompt_tokens, CAST(sum(doc_id) AS BIGINT) completion_tokens, CAST(sum(n_chars*5+doc_id*10) AS BIGINT) cost_tenths_micro FROM documents")(
    lambda t: tr.token_totals(t.raw("documents").select(F.col("n_chars").alias("prompt_tokens"), F.col("doc_id").alias("completion_tokens"))))


@query("W10", """SELECT c.conv_id, c.turn, count(*) n_turns, CAST(sum(length(d.text)) AS BIGINT) n_chars FROM conversations c JOIN conversations d ON d.conv_id=c.conv_id AND d.turn BETWEEN c.turn-3 AND c.turn GROUP BY 1,2""")
def w10(t):
    """What is still in view at every turn: the turn and the three before it."""
    c = t.raw("conversations")
    seen = c.select("conv_id", F.explode(F.sequence(F.col("turn"), F.col("turn") + 3)).alias("turn"), F.char_length("text").alias("k"))
    return seen.join(c.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi").groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_turns"), F.sum("k").alias("n_chars"))
