"""From documents to sharded training data in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept. run() writes every result as Parquet into the
folder the session names in spark.checkpoint.dir and reads it again, so that a lost executor costs at most one stage.

1. toxicity: documents that score 0.3 or more under the class-conditional models go.
2. near_duplicates: of documents whose sets of five-word shingles are connected by similarities of 0.8 or more, the one with the smallest
   doc_id stays.
3. decontamination: documents in which a window of a benchmark item occurs go.
4. mixing: sources come near their target weights; documents are dropped or repeated as a whole.
5. sharding: every row gets its shard.

Null texts are kept by the first three stages (they are not toxic, copies or contaminated) and have no words in the fourth, where they are
taken as often as their place in the seeded order says. Repeated rows of one id stay or go together. Extra columns are kept. Empty tables
pass through.
"""
import uuid

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import decontamination, jaccard, mixing, sharding, toxicity
from kinweave.llm.tables import table
from kinweave.session import shared_dir

SHARDS = 24
SHINGLE_WORDS, SIMILARITY = 5, 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, size=SHINGLE_WORDS, percent=SIMILARITY)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.with_shard(docs, "doc_id", SHARDS)


STAGES = [("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage),
          ("mixing", mixing_stage), ("sharding", sharding_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark)}/kinweave/corpus-{uuid.uuid4().hex[:12]}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return docs


#: Model scores and similarity classes have no SQL form here; the tests hold run() against a brute-force version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
