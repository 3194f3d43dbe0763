"""The domain tables themselves."""
from pyspark.sql import functions as F

from kinweave.catalog.registry import query

for _name in ("company", "holding", "position", "controller", "event", "guarantee_pair", "gold", "holder_name", "question",
              "statement"):
    query(f"T_{_name}", f"SELECT * FROM {_name}")(lambda t, n=_name: getattr(t, n))
query("T_entity", "SELECT * EXCLUDE (raw_names), array_to_string(raw_names, '|') raw_names FROM entity")(
    lambda t: t.entity.withColumn("raw_names", F.array_join("raw_names", "|")))
