"""Secret scans that link the parts of a credential.

Assignments, access identifiers and long hexadecimal runs are reported by their form alone. Other candidates are weak: an account name, a
key-like token, an address of a service. Such a part is reported only where complementary parts stand near it in the same text: a
secret needs an identifier or an endpoint within SCOPE code points, an identifier or endpoint needs a secret; reported forms count as
parts too. The distance of two parts is the gap from the end of the earlier to the start of the later one, whatever their lengths. The link
takes one pass over the parts of a text in order with the running largest end, so its size is that of the parts and not of their pairs.

Everything is a DataFrame expression. Equal texts are linked once. Null is the empty text; empty tables and texts without parts give
empty lists. Texts are scanned whole, whatever their length. Spans count code points, the end is exclusive.
"""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.spans import named, with_matches, written_out
from kinweave.llm.tables import cut

#: Fixed forms of the base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")

#: Weak parts: names given to an account or key, key-like tokens of mixed characters, and addresses of services.
IDENTIFIER = r"""(?i:access_?key(?:_?id)?|client_?id|account|user(?:name)?|login)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9._@+-]{3,}+"""
KEYLIKE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}+={0,2}+(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9][A-Za-z0-9.:@/_%?&=~+-]{2,}+"
WEAK = ("identifier", "keylike", "endpoint")

#: Code points within which the parts of one credential stand.
SCOPE = 400


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows with base spans and weak parts as arrays, and a hash that equal texts share."""
    rows = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    rows = with_matches(rows, "_text", "assign", ASSIGN)
    rows = rows.withColumn("assign", F.filter("assign", lambda s: F.length(F.regexp_replace(s["value"], "^" + ASSIGN_HEAD, "")) >= 6))
    rows = with_matches(with_matches(rows, "_text", "access", ACCESS), "_text", "hex", HEX)
    rows = with_matches(with_matches(rows, "_text", "identifier", IDENTIFIER), "_text", "endpoint", ENDPOINT)
    rows = with_matches(rows, "_text", "keylike", KEYLIKE)
    mixed = lambda s: s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]") & (F.length(F.regexp_replace(s["value"], "[^0-9]", "")) >= 3)
    return rows.withColumn("keylike", F.filter("keylike", mixed)).withColumn("text_hash", F.sha2("_text", 256)).drop("_text")


def linked_by_gap(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """parts (text_hash, role, start, end, weak, kind) -> the weak ones with a complementary part no more than `scope` code points away.

    A complement is near if it starts no later than `scope` after the end of a part and ends no earlier than `scope` before its start. So a
    part asks at its end + `scope` for the largest end of the complements that start up to there. Parts that overlap are near.
    """
    want = F.when(F.col("role") == "secret", F.array(F.lit("identifier"), F.lit("endpoint"))).otherwise(F.array(F.lit("secret")))
    there = parts.select("text_hash", F.col("role").alias("_role"), F.col("start").alias("_at"), F.lit(0).alias("_asks"), F.col("end").alias("_end"),
                         F.lit(None).cast("int").alias("_least"), "kind", "start", "end")
    asked = parts.where("weak").select("text_hash", F.explode(want).alias("_role"), (F.col("end") + scope).alias("_at"), F.lit(1).alias("_asks"),
                                       F.lit(None).cast("int").alias("_end"), (F.col("start") - scope).alias("_least"), "kind", "start", "end")
    so_far = Window.partitionBy("text_hash", "_role").orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return there.unionByName(asked).withColumn("_reach", F.max("_end").over(so_far)).where("_asks = 1 AND _reach >= _least").select("text_hash", "kind", "start", "end").distinct()


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """key, counts of the base kinds, base spans and all spans (arrays of (start, rank, end, kind))."""
    rows = cut(scanned(docs.select(key, text), text).drop(text), "secret-rows")
    role = {"assign": "secret", "hex": "secret", "access": "identifier", "identifier": "identifier", "keylike": "secret", "endpoint": "endpoint"}

    def tagged(kind):
        return F.transform(F.col(kind), lambda s: F.struct(F.lit(role[kind]).alias("role"), s["start"].alias("start"), s["end"].alias("end"),
                                                           F.lit(kind in WEAK).alias("weak"), F.lit(kind).alias("kind")))
    weak = rows.where(F.size("identifier") + F.size("keylike") + F.size("endpoint") > 0)
    parts = cut(weak.select("text_hash", F.explode(F.concat(*map(tagged, (*BASE, *WEAK)))).alias("_p")).select("text_hash", "_p.*").distinct(), "secret-parts")
    ranks = {k: i for i, k in enumerate((*BASE, *WEAK))}
    rank = F.create_map(*[F.lit(x) for k, i in ranks.items() for x in (k, i)])
    found = linked_by_gap(parts, scope).groupBy(F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("start", rank[F.col("kind")].alias("rank"), "end", "kind")).alias("_weak"))
    joined = rows.join(cut(found, "secret-linked"), F.col("text_hash") == F.col("_hash"), "left")
    base = F.concat(*[named(F.col(k), k, ranks[k]) for k in BASE])
    kind = "array<struct<start:int,rank:int,end:int,kind:string>>"
    return joined.select(key, *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], base.alias("base"),
                         F.concat(base, F.coalesce("_weak", F.array().cast(kind))).alias("all"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return find_secrets(docs).select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(written_out(F.col("base")), 256).alias("base_sha256"), written_out(F.col("all")).alias("spans"))
