"""Routing of chat commands."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from leadloom.config import BOT_COMMANDS


def route_messages(messages: DataFrame, chat_id: str, commands: Mapping[str, str] = BOT_COMMANDS) -> DataFrame:
    """Add ``command`` to messages (update_id, chat_id, text); batch or stream.

    No text: ignored. Another chat: unauthorised. Text with ``@``: a test mail
    to that address. A known number: its command. Anything else: the menu.
    """
    text = F.regexp_replace("text", r"^\s+|\s+\z", "")
    table = F.create_map(*[F.lit(x) for pair in commands.items() for x in pair])
    command = (
        F.when(F.col("text").isNull(), "ignored")
        .when(F.coalesce(F.col("chat_id").cast("string"), F.lit("")) != chat_id, "unauthorised")
        .when(text.contains("@"), "custom_test")
        .otherwise(F.coalesce(F.try_element_at(table, text), F.lit("menu")))
    )
    return messages.withColumn("command", command)
