"""Conversations as tables: digests, latest texts, titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def digests(messages: DataFrame, thread: str, order: str, text: str, preview: int = 200) -> DataFrame:
    """``thread, digest, preview`` of a thread's texts joined in order."""
    turns = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    whole = messages.groupBy(thread).agg(F.array_join(F.transform(turns, lambda x: x["t"]), "").alias("_t"))
    return whole.select(thread, F.sha2("_t", 256).alias("digest"), F.substring("_t", 1, preview).alias("preview"))


def latest_text(messages: DataFrame, thread: str, order: str, text: str, role: str, wanted: str = "user") -> DataFrame:
    return messages.where(F.col(role) == wanted).groupBy(thread).agg(F.max_by(text, order).alias("latest"))


def titles(messages: DataFrame, thread: str, order: str, text: str, role: str, length: int = 8) -> DataFrame:
    """``thread, last_message, title, n_messages``: the title is the id's beginning, system texts don't count."""
    title = F.concat(F.substring(F.col(thread).cast("string"), 1, length), F.lit("..."))
    return messages.groupBy(thread).agg(F.max_by(text, order).alias("last_message"), title.alias("title"), F.count_if(F.col(role) != "system").alias("n_messages"))
