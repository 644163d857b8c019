"""Group spine, human-typed filter, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["user", "session", "q_id", "r_t", "version"]
RESPONSE_TYPES = ("code", "explanation")


def groups(events: DataFrame, responses: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """One row per group that has an event or a response, with the first text and the prompt."""
    spine = events.select(KEY).unionByName(responses.select(KEY)).distinct()
    order = Window.partitionBy(KEY).orderBy("entry_pos", "field_pos")
    first = responses.withColumn("rn", F.row_number().over(order)).where("rn = 1").select(*KEY, "text", "source_field")
    out = spine.join(first, KEY, "left")
    return out.join(questions, ["user", "session", "q_id"], "left") if questions is not None else out


def typed_by_hand() -> Column:
    """Version 1 of session 1, version 2 of any other."""
    return F.when(F.col("session") == 1, F.col("version") == 1).otherwise(F.col("version") == 2)


def human_typed(df: DataFrame) -> DataFrame:
    """Rows typed by hand, of code and explanations only."""
    return df.where(typed_by_hand() & F.col("r_t").isin(*RESPONSE_TYPES))


def dropped_counts(df: DataFrame) -> DataFrame:
    """session, version, n_dropped: groups that aren't typed by hand."""
    return df.where(~typed_by_hand()).groupBy("session", "version").agg(F.count("*").alias("n_dropped"))


def short_groups(spine: DataFrame, keydowns: DataFrame, minimum: int = 100) -> DataFrame:
    """Kept groups with fewer keydowns (columns KEY, n_keydowns) than the sanity minimum, none at all included; flagged, not dropped."""
    n = F.coalesce("n_keydowns", F.lit(0))
    return spine.select(KEY).join(keydowns, KEY, "left").select(*KEY, n.alias("n_keydowns")).where(F.col("n_keydowns") < minimum)


def short_counts(spine: DataFrame, keydowns: DataFrame, minimum: int = 100) -> DataFrame:
    return short_groups(spine, keydowns, minimum).groupBy("session", "version").agg(F.count("*").alias("n_short"))
