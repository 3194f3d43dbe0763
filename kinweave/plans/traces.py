"""Statistics over the traces of answered questions."""
from pyspark.sql import DataFrame, Window, functions as F

from kinweave.operators import summaries

# The stages reported on.
STAGES = ["classify", "slot_fill", "entity_link", "execute", "answer_generate", "verify"]
TTL_SECONDS = 3600


def newest(traces, n=500) -> DataFrame:
    """The n newest traces, the ones a rolling folder keeps."""
    return summaries.top(traces, n, F.desc("written_at"), "trace_id")


def summaries_of(traces, n=20) -> DataFrame:
    """Short lines on the n newest traces."""
    passed = lambda c: F.coalesce(F.col(c)["passed"], F.lit(True))
    return newest(traces, n).select(
        "trace_id", F.left(F.coalesce("question", F.lit("")), F.lit(60)).alias("question"), "intent",
        F.coalesce("uncertain", F.lit(False)).alias("uncertain"), F.col("total_elapsed_ms").alias("total_ms"),
        passed("verify_result").alias("verify_passed"), F.size(F.coalesce("llm_calls", F.array())).alias("llm_calls"),
        "query_result_count", F.col("generated_query").isNotNull().alias("generated"), passed("validation").alias("validation_passed"))


def by_intent(traces) -> DataFrame:
    """Per intent: count, median and 95th percentile of the total time, model calls, failures, generated and rejected."""
    t = traces.withColumn("intent", F.coalesce("intent", F.lit("unknown")))
    failed = ~F.coalesce(F.col("verify_result.passed"), F.lit(True))
    generated = F.coalesce("generated_query", F.lit("")) != ""
    rejected = generated & ~F.coalesce(F.col("validation.passed"), F.lit(True))
    n = t.groupBy("intent").agg(
        F.count("*").alias("count"), F.sum(F.size(F.coalesce("llm_calls", F.array()))).alias("llm_calls"), F.count_if(failed).alias("verify_fail"),
        F.count_if(generated).alias("q7_generated"), F.count_if(rejected).alias("q7_rejected"))
    p = summaries.nearest_rank(t.withColumn("ms", F.coalesce("total_elapsed_ms", F.lit(0.0))), ["intent"], "ms").drop("n")
    return n.join(p, "intent")


def stage_times(traces) -> DataFrame:
    """Time of every stage of every trace: the step to the event before it, within the row, without a shuffle.

    The query time stands for the execution, what is left after the last event for the check; a stage that did not run took 0.
    """
    ev = F.coalesce("events", F.array().cast("array<struct<node:string,elapsed_ms:double>>"))
    steps = F.transform(ev, lambda e, i: F.struct(e["node"].alias("node"), F.greatest(
        F.lit(0.0), e["elapsed_ms"] - F.when(i > 0, F.get(ev, i - 1)["elapsed_ms"]).otherwise(0.0)).alias("ms")))
    last = F.reverse(steps)

    def one(stage):
        ms = F.get(F.filter(last, lambda s: s["node"] == stage), F.lit(0))["ms"]
        if stage == "execute":
            ms = F.coalesce("query_elapsed_ms", ms)
        if stage == "verify":
            ms = F.when(F.size(ev) > 0, F.greatest(F.lit(0.0), F.coalesce("total_elapsed_ms", F.lit(0.0)) - F.element_at(ev, -1)["elapsed_ms"])).otherwise(ms)
        return F.struct(F.lit(stage).alias("stage"), F.coalesce(ms, F.lit(0.0)).alias("ms"))

    return traces.where("intent <> ''").select("trace_id", "intent", F.explode(F.array(*[one(s) for s in STAGES])).alias("x")).select(
        "trace_id", "intent", "x.*")


def stage_percentiles(traces) -> DataFrame:
    return summaries.nearest_rank(stage_times(traces), ["intent", "stage"], "ms")


def call_percentiles(traces) -> DataFrame:
    """Model calls per intent: number, median, 95th percentile, retries."""
    calls = traces.where("intent <> ''").select("intent", F.explode("llm_calls").alias("c")).select("intent", F.col("c.elapsed_ms").alias("ms"), "c.retried")
    n = calls.groupBy("intent").agg(F.count("*").alias("calls"), F.count_if("retried").alias("retries"))
    return n.join(summaries.nearest_rank(calls, ["intent"], "ms").drop("n"), "intent")


def token_totals(calls) -> DataFrame:
    """calls: prompt_tokens, completion_tokens. Cost in millionths of a yuan at 0.5 and 1 yuan per million."""
    return calls.groupBy().agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
                               F.sum(F.col("prompt_tokens") * 5 + F.col("completion_tokens") * 10).alias("cost_tenths_micro"))


def repeats(log, keys, ts="ts", ttl=TTL_SECONDS) -> DataFrame:
    """How often a query was repeated within ttl seconds of the time before it, from a log (keys, ts in epoch seconds).

    Equal times of a key travel as one row. The time before lies in the same piece of ttl seconds or in the piece before it, so only
    the times of a piece are ordered together and a key that never rests spreads over many tasks.
    Returns keys, ts, n, repeats.
    """
    rows = log.groupBy(*keys, ts).agg(F.count("*").alias("n")).withColumn("_piece", F.floor(F.col(ts) / ttl))
    last = rows.groupBy(*keys, (F.col("_piece") + 1).alias("_piece")).agg(F.max(ts).alias("_last"))
    inside = F.lag(ts).over(Window.partitionBy(*keys, "_piece").orderBy(ts))
    before = rows.withColumn("_before", inside).join(last, [*keys, "_piece"], "left").withColumn("_before", F.coalesce("_before", "_last"))
    soon = F.coalesce(F.col(ts) - F.col("_before") < ttl, F.lit(False)).cast("bigint")
    return before.select(*keys, ts, "n", (F.col("n") - 1 + soon).alias("repeats"))


def repeat_rate(rows) -> DataFrame:
    return rows.groupBy().agg(F.sum("n").alias("n"), F.sum("repeats").alias("repeats"))


def cache_hits(log, keys, ts="ts", ttl=TTL_SECONDS) -> DataFrame:
    """Which repeated queries a cache would have answered: an entry lives ttl seconds from the miss that stored it.

    log: keys, ts (epoch seconds). Timelines are cut first where nothing was asked for a whole ttl (the next query is a miss
    whatever came before), so long-lived keys spread over many tasks; each piece is then walked in time order, batch by
    batch, holding one number. Equal times of a key travel as one row.
    Returns keys, ts, n, hits.
    """
    rows = log.groupBy(*keys, ts).agg(F.count("*").alias("n"))
    pieces = log.groupBy(*keys, F.session_window(F.timestamp_seconds(F.col(ts)), f"{ttl} seconds").alias("w")).agg(
        F.min(ts).alias("_from"), F.max(ts).alias("_to"))
    hours = F.explode(F.sequence(F.floor(F.col("_from") / ttl), F.floor(F.col("_to") / ttl)))
    spans = pieces.select(*keys, "_from", "_to", hours.alias("_h"))
    placed = rows.withColumn("_h", F.floor(F.col(ts) / ttl)).join(spans, [*keys, "_h"]).where(
        F.col(ts).between(F.col("_from"), F.col("_to"))).drop("_h", "_to")
    ordered = placed.repartition(*keys, "_from").sortWithinPartitions(*keys, "_from", ts)
    names = [*keys, "_from"]

    def walk(batches):
        current, stored = None, None
        for pdf in batches:
            hits = []
            for key, at, n in zip(pdf[names].itertuples(index=False, name=None), pdf[ts], pdf["n"]):
                if key != current or at - stored >= ttl:
                    current, stored = key, at
                    hits.append(n - 1)
                else:
                    hits.append(n)
            yield pdf[[*keys, ts, "n"]].assign(hits=hits)

    schema = ordered.select(*keys, ts, "n", F.col("n").alias("hits")).schema
    return ordered.mapInPandas(walk, schema)


def cache_rate(hits) -> DataFrame:
    return hits.groupBy().agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
