"""What is remembered of conversations: extraction by a model or by rule, and generations that expire."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodewell.operators.providers import Provider, complete

# Words that show an interest, in the order in which they are noted.
KEYWORDS = [
    "ai", "ml", "machine learning", "neural", "gpt", "llm", "startup", "funding", "acquisition", "cloud", "api", "agent", "rag", "embedding", "vector", "database",
]

_KINDS = ("user_profile", "conversation_state")


def _recent(messages: DataFrame, most: int, key: str, order: str) -> DataFrame:
    """The last messages of each conversation, with `ago`, counted from 1; the ranking is cut off map-side."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return messages.withColumn("ago", rank).where(F.col("ago") <= most)


def _rows(df: DataFrame, key: str, contents: dict[str, Column]) -> DataFrame:
    """(key, memory_type, content): a row for each content that is not null."""
    kinds = F.explode(F.array(*(F.struct(F.lit(kind).alias("memory_type"), c.alias("content")) for kind, c in contents.items())))
    return df.select(key, kinds.alias("m")).select(key, "m.*").where("content IS NOT NULL")


def by_rule(messages: DataFrame, *, keywords: list[str] = KEYWORDS, known: DataFrame | None = None, found: DataFrame | None = None, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, memory_type, content): two memories of each conversation of `messages` (key, order, role, text).

    The profile holds the interests in `known` (key, interests), then keywords that user messages among the last five
    hold, ten in all; the state holds the last user message, cut to 200 characters, and the first five entries of
    `found` (key, collected), each cut to 100. Contents are JSON.
    """
    recent = _recent(messages, 5, key, order).where("role = 'user'")
    listed = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(keywords)))
    held = F.filter(listed, lambda k: F.contains(F.lower(F.col("text")), k["k"]))
    # At most five messages of a conversation come together, with at most all keywords each.
    words = recent.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), held.alias("held")))).alias("m"))
    words = words.select(key, F.flatten(F.transform("m", lambda m: F.transform(m["held"], lambda k: k["k"]))).alias("words"))
    last = F.when(F.col("role") == "user", F.col(order))
    each = messages.groupBy(key).agg(F.max_by("text", last).alias("topic")).join(words, key, "left")
    for more, column, kind in ((known, "interests", "array<string>"), (found, "collected", "array<struct<tool:string,output:string>>")):
        each = each.join(more.select(key, column), key, "left") if more is not None else each.withColumn(column, F.lit(None).cast(kind))
    none = F.array().cast("array<string>")
    interests = F.slice(F.array_distinct(F.concat(F.coalesce("interests", none), F.coalesce("words", none))), 1, 10)
    told = F.transform(F.slice("collected", 1, 5), lambda c: F.concat(F.lit("["), c["tool"], F.lit("] "), F.substring(F.coalesce(c["output"], F.lit("")), 1, 100)))
    state = F.struct(F.substring("topic", 1, 200).alias("current_topic"), F.coalesce(told, none).alias("information_gathered"), none.alias("open_questions"))
    keep = {"ignoreNullFields": "false"}
    return _rows(each, key, {_KINDS[0]: F.to_json(F.struct(interests.alias("interests"))), _KINDS[1]: F.to_json(state, keep)})


def _json_part(answer: Column, name: str) -> Column:
    """A part of the JSON between the first and the last brace of an answer, as JSON; null if it is missing or holds nothing."""
    text = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    part = F.get_json_object(F.when(F.try_parse_json(text).isNotNull(), text), f"$.{name}")
    return F.when(~part.isin("", "{}", "[]", "null", "false", "0"), part)


def extracted(messages: DataFrame, provider: Callable[[], Provider], *, key: str = "conv_id", order: str = "turn", **by_rules) -> DataFrame:
    """(key, memory_type, content, by): memories that a model draws from the last ten messages of each conversation.

    A model's answer gives a profile, a state or both; where it can't be had or read, or gives neither, `by_rule`
    does. `by` says which.
    """
    line = F.concat(F.lit("["), F.coalesce("role", F.lit("unknown")), F.lit("]: "), F.substring(F.coalesce("text", F.lit("")), 1, 200))
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("ago")).alias("o"), line.alias("l")))), lambda m: m["l"])
    asked = _recent(messages, 10, key, order).groupBy(key).agg(F.array_join(lines, "\n").alias("lines"))
    request = "Extract user_profile and conversation_state as JSON.\nConversation: "
    asked = asked.select(key, F.concat(F.lit(request), F.col(key).cast("string"), F.lit("\n"), "lines").alias("prompt"))
    said = complete(asked, "prompt", provider, attempts=1)
    given = _rows(said, key, {kind: _json_part(F.col("answer"), kind) for kind in _KINDS}).withColumn("by", F.lit("model"))
    ruled = by_rule(messages, key=key, order=order, **by_rules).join(given.select(key).distinct(), key, "left_anti")
    return given.unionByName(ruled.withColumn("by", F.lit("rule")))


def generations(events: DataFrame, ttl: str, now: Column, *, key: str = "conv_id") -> DataFrame:
    """(key, memory_type, content, version, first_at, last_at, status) of `events` (key, memory_type, content, at, turn).

    A memory lives until more than `ttl` has passed since it was last set; what is set later begins a new generation. Its
    content is that of the latest event, of equal times that of the greatest turn, whatever the order of arrival, and
    its version counts the events. Events without content or time change nothing. status is live or, where the memory's
    time was up at `now`, expired.
    """
    told = events.where((F.coalesce("content", F.lit("")) != "") & F.col("at").isNotNull())
    window = F.session_window("at", ttl)
    each = told.groupBy(key, "memory_type", window.alias("w")).agg(
        F.max_by("content", F.struct("at", "turn")).alias("content"), F.count("*").alias("version"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )
    return each.select(key, "memory_type", "content", "version", "first_at", "last_at", F.when(F.col("w")["end"] < now, "expired").otherwise("live").alias("status"))


def loaded(stored: DataFrame, kind: str | None = None, *, key: str = "conv_id") -> DataFrame:
    """(key, memories): what is stored (key, memory_type, content) of each conversation, by type; of one type only, if `kind` is given.

    There is one row a conversation and type, so that a map has as many entries as there are types.
    """
    rows = stored.where(F.col("memory_type").isNotNull() if kind is None else F.col("memory_type") == kind)
    return rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("memory_type", "content"))).alias("memories"))
