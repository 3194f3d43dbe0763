"""Session settings and the shared folder for intermediate tables."""
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name="kinweave", master=None, **conf):
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder the cluster shares for cut lineage; a temporary one only where the session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def write_table(df: DataFrame, name: str) -> str:
    """Write a frame to a new place in the shared folder and return the place."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here and a lost executor costs nothing."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))
