"""Files of people and of the question service: written from the given tables in their formats, read back by the readers."""
import uuid

from pyspark.sql import functions as F

from kinweave.catalog.registry import query
from kinweave.session import shared_dir
from kinweave.sources import files

#: About so many documents go to a trace file, so that a file stays small whatever the table holds.
FILE_ROWS = 500


def _place(t, name):
    return f"{shared_dir(t.spark)}/kinweave/{t.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:8]}"


@query("SRC9", """SELECT CAST(doc_id AS VARCHAR) party_name, CASE WHEN quality=1 THEN 'true_omission' WHEN toxic=1 THEN 'system_error' ELSE 'reasonable_undisclosed' END human_class,
  CASE WHEN doc_id%3=0 THEN 'said "no", then'||chr(10)||'yes' ELSE '甲,乙' END note FROM labels""")
def src9(t):
    """Reviews as comma-separated values whose header starts with a byte-order mark; quotes, commas and line breaks in fields."""
    human = F.when(F.col("quality") == 1, "true_omission").when(F.col("toxic") == 1, "system_error").otherwise("reasonable_undisclosed")
    rows = t.raw("labels").select(F.col("doc_id").cast("string").alias("\ufeffparty_name"), human.alias("human_class"),
                                  F.when(F.col("doc_id") % 3 == 0, 'said "no", then\nyes').otherwise("甲,乙").alias("note"))
    path = _place(t, "reviews")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return files.read_reviews(t.spark, path).select("party_name", "human_class", "note")


@query("SRC9_lines", """SELECT 'n'||CAST(doc_id AS VARCHAR) AS name, lpad(CAST(doc_id%100 AS VARCHAR),6,'0') a_code, CAST(doc_id%7 AS DOUBLE)/8 rule_score,
  CASE WHEN quality=1 THEN 'same' END same_person FROM labels""")
def src9_lines(t):
    """Annotated pairs as JSON lines, absent fields left out."""
    code = F.lpad((F.col("doc_id") % 100).cast("string"), 6, "0")
    rows = t.raw("labels").select(
        F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("name"), F.struct(F.lit("holding").alias("table"), code.alias("stock_code")).alias("rec_a"),
        ((F.col("doc_id") % 7).cast("double") / 8).alias("rule_score"), F.when(F.col("quality") == 1, "same").alias("same_person"))
    path = _place(t, "pairs")
    rows.write.json(path)
    return files.read_reviews(t.spark, path, files.PAIR_SCHEMA).select("name", F.col("rec_a.stock_code").alias("a_code"), "rule_score", "same_person")


@query("SRC10", """SELECT CAST(conv_id AS VARCHAR)||'/'||CAST(turn AS VARCHAR) AS "question", role intent, CAST(length(text) AS DOUBLE) total_elapsed_ms,
  CAST(turn AS DOUBLE)+0.5 first_ms, CAST(conv_id AS VARCHAR) slot FROM conversations""")
def src10(t):
    """Traces as pretty-printed documents over many lines, a bounded number to a file."""
    c = t.raw("conversations")
    trace = F.struct(
        F.concat_ws("/", "conv_id", "turn").alias("question"), F.col("role").alias("intent"), F.char_length("text").cast("double").alias("total_elapsed_ms"),
        F.create_map(F.lit("conv"), F.col("conv_id").cast("string")).alias("slots"),
        F.array(F.struct(F.lit("classify").alias("node"), (F.col("turn") + 0.5).alias("elapsed_ms"))).alias("events"))
    number = -(-c.count() // FILE_ROWS) or 1
    rows = c.select(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(number)).alias("file"), F.to_json(trace, {"pretty": "true"}).alias("trace"))
    path = _place(t, "traces")
    rows.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("trace"), ",\n"), F.lit("]")).alias("value")).write.partitionBy("file").text(path)
    found = files.read_traces(t.spark, path)
    return found.select("question", "intent", "total_elapsed_ms", F.col("events")[0]["elapsed_ms"].alias("first_ms"), F.col("slots")["conv"].alias("slot"))
