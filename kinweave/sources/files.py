"""Files written by people and by the question service: reviews, annotations and traces."""
from pyspark.sql import DataFrame, SparkSession, functions as F

TRACE_SCHEMA = """question string, intent string, confidence double, uncertain boolean, classification_source string,
 llm_calls array<struct<purpose:string,elapsed_ms:double,tokens:bigint,retried:boolean,output_summary:string,error_type:string>>,
 slots map<string,string>, template_id string, query_result_count bigint, query_elapsed_ms double, generated_query string,
 validation struct<passed:boolean>, answer string, verify_result struct<passed:boolean>,
 events array<struct<node:string,elapsed_ms:double>>, total_elapsed_ms double"""

PAIR_SCHEMA = """name string, canonical string, rec_a struct<table:string,stock_code:string,title:string,valid_from:string,source:string>,
 rec_b struct<table:string,stock_code:string,title:string,valid_from:string,source:string>, rule_score double, tier string,
 same_person string, note string"""


def read_reviews(spark: SparkSession, path, schema=None) -> DataFrame:
    """CSV with a header that may start with a byte-order mark, or JSON lines; told apart by the schema given."""
    if schema:
        return spark.read.schema(schema).json(path)
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_traces(spark: SparkSession, path) -> DataFrame:
    """One JSON document per file; the file name is the trace id, its time the trace time."""
    return spark.read.schema(TRACE_SCHEMA).option("multiLine", True).json(path).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.json$", 1).alias("trace_id"),
        F.col("_metadata.file_modification_time").alias("written_at"), "*")
