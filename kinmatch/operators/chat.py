"""Data side of the chat loop: validation, routing, tool arguments, message windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch import fixed_values as fixed
from kinmatch.functions import text as tx

# Turns per piece when a conversation is cut up.
SEGMENT_TURNS = 10_000


def request_problem(
    message: Column, *, has_file: Column | None = None, limit: Column | None = None
) -> Column:
    """Why a request is rejected, NULL when it is fine."""
    blank = tx.is_blank(message)
    if has_file is not None:
        blank = blank & ~F.coalesce(has_file, F.lit(False))
    problem = F.when(blank, "blank message")
    if limit is not None:
        problem = problem.when(limit < 0, "negative limit")
    return problem


def route(
    message: Column,
    has_file: Column,
    tool_used: Column,
    *,
    search_patterns: Sequence[str] = fixed.SEARCH_INTENT_PATTERNS,
    file_patterns: Sequence[str] = fixed.FILE_INTENT_PATTERNS,
) -> Column:
    """file, tool, fallback_search or chat."""
    applies_file = tx.is_blank(message) | tx.matches_any(message, file_patterns)
    return (
        F.when(F.coalesce(has_file, F.lit(False)) & applies_file, "file")
        .when(F.coalesce(tool_used, F.lit(False)), "tool")
        .when(tx.matches_any(message, search_patterns), "fallback_search")
        .otherwise("chat")
    )


def tool_arguments(arguments: Column, default_limit: int = fixed.DEFAULT_RESULTS) -> Column:
    """``struct<query, max_results, file_path>`` from a JSON object; other text is the query.

    Values are decoded by type: a text is itself, anything else its JSON text; numbers may
    come as texts, fractions are cut. What is missing, null or no number takes its default:
    an empty query or path, ``default_limit``. Other JSON values than objects name nothing.
    """
    # a text is JSON when the variant parser takes it
    parsed = F.try_parse_json(arguments)
    is_json = parsed.isNotNull()

    def text(name):
        return F.coalesce(F.try_variant_get(parsed, f"$.{name}", "string"), F.lit(""))

    number = F.try_variant_get(parsed, "$.max_results", "double")
    whole = F.when(number.between(-(2**31), 2**31 - 1), number.try_cast("int"))
    return F.when(
        is_json,
        F.struct(
            text("query").alias("query"),
            F.coalesce(whole, F.lit(default_limit)).alias("max_results"),
            text("file_path").alias("file_path"),
        ),
    ).otherwise(
        F.struct(
            F.coalesce(arguments, F.lit("")).alias("query"),
            F.lit(default_limit).alias("max_results"),
            F.lit("").alias("file_path"),
        )
    )


def tool_call(
    name: Column, arguments: Column, tools: Mapping[str, Sequence[str]] = fixed.TOOL_ARGUMENTS
) -> Column:
    """``struct<name, query, max_results, file_path, reply>``: what a call asks of its tool.

    ``tools`` lists the arguments each tool takes; others are NULL. An unknown or missing name
    takes none and gets a ``reply`` that says so.
    """
    called = F.coalesce(name, F.lit(""))
    decoded = tool_arguments(arguments)

    def taken(argument):
        takers = [tool for tool, taken in tools.items() if argument in taken]
        return F.when(called.isin(takers), decoded[argument]).alias(argument)

    unknown = F.concat(F.lit(fixed.UNKNOWN_TOOL), called)
    return F.struct(
        called.alias("name"), taken("query"), taken("max_results"), taken("file_path"),
        F.when(~called.isin(list(tools)), unknown).alias("reply"),
    )


def _message(role: str | Column, content: Column) -> Column:
    role = role if isinstance(role, Column) else F.lit(role)
    return F.struct(role.alias("role"), content.alias("content"))


def prompt_messages(
    system: Column, history: Column, user: Column, context: Column | None = None
) -> Column:
    """System text, optional context as a second system message, history, user message."""
    opening = F.array(_message("system", system))
    if context is not None:
        extra = _message("system", F.concat(F.lit(fixed.CONTEXT_PREFIX), context))
        opening = F.when(
            F.coalesce(context, F.lit("")) != "", F.concat(opening, F.array(extra))
        ).otherwise(opening)
    return F.concat(opening, history, F.array(_message("user", user)))


def history_windows(
    turns: DataFrame,
    *,
    conversation_col: str,
    turn_col: str,
    role_col: str = "role",
    text_col: str = "text",
    size: int = 10,
) -> DataFrame:
    """Every turn with ``history``: the up to ``size`` turns before it, oldest first.

    One conversation may hold a large part of all turns, so conversations are cut into
    segments of turn numbers; each segment also gets the last turns before it, at most
    ``size``, from a table with one short row per segment.
    """
    segment = F.floor(F.col(turn_col) / SEGMENT_TURNS)
    message = _message(F.col(role_col), F.col(text_col))
    cut = turns.withColumns({"_segment": segment, "_message": message})
    place = Window.partitionBy(conversation_col, "_segment")

    within = F.collect_list("_message").over(place.orderBy(turn_col).rowsBetween(-size, -1))
    local = cut.withColumn("_local", within)

    # only conversations of several segments have anything to carry
    cut_up = (
        cut.groupBy(conversation_col)
        .agg(F.min("_segment").alias("_low"), F.max("_segment").alias("_high"))
        .filter("_low < _high")
    )
    tails = (
        cut.select(conversation_col, "_segment", turn_col, "_message")
        .join(cut_up.select(conversation_col), conversation_col, "left_semi")
        .withColumn("_back", F.row_number().over(place.orderBy(F.desc(turn_col))))
        .filter(F.col("_back") <= size)
        .groupBy(conversation_col, "_segment")
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct(turn_col, "_message"))),
                lambda pair: pair["_message"],
            ).alias("_tail")
        )
    )
    # each segment has at least one turn, so `size` segments back are enough
    before = Window.partitionBy(conversation_col).orderBy("_segment").rowsBetween(-size, -1)
    carried = tails.select(
        conversation_col, "_segment", F.flatten(F.collect_list("_tail").over(before)).alias("_before")
    ).filter(F.size("_before") > 0)

    everything = F.concat(F.coalesce("_before", F.array().cast(local.schema["_local"].dataType)), "_local")
    last = F.slice(
        F.col("_all"), F.greatest(F.size("_all") - size + 1, F.lit(1)), F.lit(size)
    )
    return (
        local.join(carried, [conversation_col, "_segment"], "left")
        .withColumn("_all", everything)
        .withColumn("history", last)
        .select(*turns.columns, "history")
    )
