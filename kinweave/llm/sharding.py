"""Shards by jump consistent hashing: a key and the number of shards decide, without a ring table.

With one more shard a key stays or moves into the new shard, and about 1 / (n + 1) of the keys move.

Nulls: a null key is treated as key 0; a null text has no bytes and the checksum of the empty text. Repeated rows land in the
same shard and take consecutive slots. Texts are measured whole, whatever their length. An empty table gives no rows.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kinweave.llm.tables import octets

#: Fixed values of the published algorithm: multiplier of its generator, 2^31 of its jump.
MULTIPLIER = 2862933555777941757
JUMP = float(1 << 31)

LOW, HALF = (1 << 32) - 1, (1 << 16) - 1
#: Pieces per shard in which slots are numbered; the table of their counts has at most shards * PIECES rows.
PIECES = 1024


def _times(high: Column, low: Column):
    """(high, low) * MULTIPLIER + 1 modulo 2^64 in 32-bit halves, so that no product leaves a long."""
    m_high, m_low = F.lit(MULTIPLIER >> 32), F.lit(MULTIPLIER & LOW)
    first = low.bitwiseAND(HALF) * m_low + 1
    second = F.shiftrightunsigned(low, 16) * m_low + F.shiftrightunsigned(first, 16)
    new_low = F.shiftleft(second.bitwiseAND(HALF), 16) + first.bitwiseAND(HALF)
    carried = (F.shiftrightunsigned(second, 16) + low * m_high + high.bitwiseAND(HALF) * m_low
               + F.shiftleft((F.shiftrightunsigned(high, 16) * m_low).bitwiseAND(HALF), 16))
    return carried.bitwiseAND(LOW), new_low


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 to shards - 1 of a whole-number key."""
    if shards < 1:
        raise ValueError("at least one shard")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(LOW).alias("low"),
                     F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))

    def step(state, _):
        high, low = _times(state["high"], state["low"])
        jump = (state["next"] + 1).cast("double") * (F.lit(JUMP) / (F.shiftrightunsigned(high, 1) + 1).cast("double"))
        moved = F.struct(high.alias("high"), low.alias("low"), state["next"].alias("shard"),
                         F.floor(jump).cast("long").alias("next"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    # Every step raises the next jump by at least one, so as many steps as shards always end it; settled keys skip the rest.
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)
    return walk["shard"].cast("int")


def with_shard(df: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """All rows and columns with their shard; a map without a shuffle. A column of that name is replaced."""
    return df.withColumn(name, jump_shard(F.col(key), shards))


def sized(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size (UTF-8 bytes and 8 for the key) and CRC-32 of the text."""
    content = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(key), (octets(F.col(text)) + 8).alias("size"), F.crc32(content.cast("binary")).cast("long").alias("text_crc32"))


def slots(rows: DataFrame, shard: str, order: list) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Equal rows are counted first, so that copies weigh nothing. A shard is cut into PIECES by a hash of the order columns;
    the counts of the pieces (at most shards * PIECES rows, which bounds what is broadcast) give each piece its first slot, and
    only rows within a piece are sorted.
    """
    counted = (rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
               .withColumn("_piece", F.pmod(F.xxhash64(*order), F.lit(PIECES)).cast("int")))
    sums = counted.groupBy(shard, "_piece").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy(shard).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select(F.col(shard).alias("_shard"), F.col("_piece").alias("_p"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(shard, "_piece").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    joined = placed.join(F.broadcast(first), (F.col(shard) == F.col("_shard")) & (F.col("_piece") == F.col("_p")))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    return (joined.withColumn("_copy", copies).withColumn("slot", F.col("_first") + F.col("_before") + F.col("_copy"))
            .drop("_n", "_piece", "_shard", "_p", "_first", "_before", "_copy"))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard with one more shard."""
    rows = with_shard(sized(docs), "doc_id", shards)
    numbered = slots(rows, "shard", ["doc_id", "size", "text_crc32"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                           jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"))
