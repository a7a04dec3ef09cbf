"""op13: conversations, damaged, audited and repaired."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from rowloom.llm.conversations import Repair, conversation_key, damaged, turns_of

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def op13_conversation_repair(spark, sf):
    """A row for every conversation of the table; one that the damage leaves without turns has zeros and an empty audit."""
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    found = Repair(damaged(turns_of(table))).report()
    every = table.groupBy(conversation_key("conv_id").alias("c")).agg(F.first("conv_id").alias("conv_id"))
    return every.join(found, "c", "left").select(
        "conv_id", *(F.coalesce(x, F.lit(0)).alias(x) for x in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
#: SQL has no crc32 here and no shortest paths; tests/llm compares with a dynamic program
SQL = {}
