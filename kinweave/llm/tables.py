"""Reading the corpus tables and cutting lineage in the shared folder."""
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.session import written

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: a lost executor recomputes nothing before this point, and a join on the
    result sees its size and can split skewed keys."""
    return written(df, f"llm-{name}")


#: Rows of a batch that are worked on and handed back at a time.
PIECE = 512


def pieces(batches):
    """The batches in pieces of few rows, so that a task holds the texts and the results of a piece beside the batch itself."""
    for batch in batches:
        for i in range(0, batch.num_rows, PIECE):
            yield batch.slice(i, PIECE)


def texts_of(batch, *path) -> list:
    """UTF-8 texts of a column, or of a field of a struct column: a row that holds its text need not bring it twice."""
    column = batch.column(path[0])
    for name in path[1:]:
        column = column.field(name)
    return column.cast(pa.binary()).to_pylist()


def shards_of(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session, which grow with the cluster's setting and never with the rows of one key."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def octets(text) -> "F.Column":
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def free(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_row(df: DataFrame) -> "F.Column":
    """All columns as one struct, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])
