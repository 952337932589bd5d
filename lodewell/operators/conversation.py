"""Conversation state: history, token budgets, compaction and memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window, WindowSpec

from lodewell.functions.text import estimate_tokens


def live_messages(df: DataFrame, now: Column, *, minutes: int = 30, role: str = "role", when: str = "created_at") -> DataFrame:
    """Without tool messages that are older than `minutes` or have no time; unreadable times stay."""
    at = F.try_to_timestamp(F.col(when))
    expired = F.col(when).isNull() | F.coalesce(at < now - F.make_interval(mins=F.lit(minutes)), F.lit(False))
    return df.where(~((F.col(role) == "tool") & expired))


def budgets(df: DataFrame, most: int, *, share: float = 0.7, group: str = "conv_id", text: str = "text") -> DataFrame:
    """(group, tokens, compress): whether a conversation fills `share` of its budget."""
    return df.groupBy(group).agg(F.sum(estimate_tokens(F.col(text))).alias("tokens")).withColumn("compress", F.col("tokens") >= most * share)


def compact(df: DataFrame, most: int, *, share: float = 0.7, target: float = 0.4, group: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Every message with tokens, before (those of earlier messages) and summarized.

    In conversations over `share` of the budget the oldest messages are summarized while the tokens before them
    are fewer than have to go to come down to `target` of the budget.
    """
    w = Window.partitionBy(group)
    before = F.coalesce(F.sum("tokens").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = df.withColumn("tokens", estimate_tokens(F.col(text))).withColumn("before", before).withColumn("total", F.sum("tokens").over(w))
    excess = F.col("total") - F.floor(F.lit(most * target))
    return rows.withColumn("summarized", (F.col("total") >= most * share) & (F.col("before") < excess)).drop("total")


def boundaries(compacted: DataFrame, *, group: str = "conv_id", order: str = "turn") -> DataFrame:
    """A row for each compacted conversation: the period replaced, messages_replaced, tokens_removed."""
    gone = compacted.where("summarized")
    return gone.groupBy(group).agg(F.min(order).alias("period_start"), F.max(order).alias("period_end"), F.count("*").alias("messages_replaced"), F.sum("tokens").alias("tokens_removed"))


def outline(df: DataFrame, *, group: str = "conv_id", order: str = "turn", n: int = 3, most: int = 50) -> DataFrame:
    """The rule-based summary: the first n user texts, cut, in order."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    first = df.where("role = 'user'").withColumn("r", rank).where(F.col("r") <= n)
    parts = F.array_sort(F.collect_list(F.struct("r", F.substring("text", 1, most).alias("t"))))
    return first.groupBy(group).agg(F.array_join(F.transform(parts, lambda x: x["t"]), " | ").alias("summary"))


def interests(df: DataFrame, keywords: list[str], *, group: str = "conv_id", order: str = "turn", last: int = 5) -> DataFrame:
    """(group, interest): keywords that user messages among a conversation's last `last` hold, regardless of case."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))
    recent = df.withColumn("r", rank).where((F.col("r") <= last) & (F.col("role") == "user"))
    held = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(F.col("text")), k))
    return recent.select(group, F.explode(held).alias("interest")).distinct()


def opened(stored: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Conversations with those asked for that do not exist yet, as active."""
    new = asked.select(*keys).distinct().join(stored, keys, "left_anti").withColumn("status", F.lit("active"))
    return stored.unionByName(new)


def turns(group: str = "conv_id", order: str = "turn") -> WindowSpec:
    """The messages of each conversation in order."""
    return Window.partitionBy(group).orderBy(order)


def archived(stored: DataFrame, asked: DataFrame, *, key: str = "conv_id", user: str = "user_id", status: str = "status") -> DataFrame:
    """`stored` with the conversations that `asked` (key, user) names archived, where they are that user's; none is removed."""
    hit = asked.select(key, user).distinct().withColumn("_hit", F.lit(True))
    out = stored.join(hit, [key, user], "left")
    return out.withColumn(status, F.when(F.col("_hit"), "archived").otherwise(F.col(status))).select(*stored.columns)


def listed(stored: DataFrame, *, user: str | None = None, status: str = "active", article: str | None = None) -> DataFrame:
    """Conversations of a status, and of a user or about an article where one is given."""
    out = stored.where(F.col("status") == status)
    out = out.where(F.col("user_id") == user) if user is not None else out
    return out.where(F.col("article_id") == article) if article is not None else out


def last_messages(rows: DataFrame, n: int = 10, *, group: str = "conv_id", order: str = "turn") -> DataFrame:
    """(group, messages): the last n messages of each conversation, the oldest first; the ranking is cut off map-side."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))
    some = rows.withColumn("_ago", rank).where(F.col("_ago") <= n)
    return some.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, "role", "text"))).alias("messages"))


def context(cached: DataFrame, sessions: DataFrame, messages: DataFrame, *, group: str = "conv_id") -> DataFrame:
    """(group, source, context) of every conversation that any of the three has a non-null `context` of: the cached one, else
    that of the stored session, else that of its messages."""
    ranked = [df.where("context IS NOT NULL").select(group, F.lit(i).alias("o"), F.lit(name).alias("source"), "context") for i, (name, df) in enumerate((("cache", cached), ("session", sessions), ("messages", messages)))]
    every = ranked[0].unionByName(ranked[1]).unionByName(ranked[2])
    best = every.groupBy(group).agg(F.min_by(F.struct("source", "context"), "o").alias("b"))
    return best.select(group, "b.source", "b.context")


def route(passed: Column, response: Column, completeness: Column, researched: Column, *, most_research: int = 5, enough: float = 0.7) -> Column:
    """Where a chat goes on if no model says so: researcher, explainer, fact_checker or end.

    `passed` is null before a response was checked. A failed check goes back to the explainer if the information is
    complete `enough`, else to the researcher; a new response is checked, a passed one ends the turn. Without a
    response, complete information is explained, and research goes on until its rounds are used up.
    """
    answered = F.coalesce(response, F.lit("")) != ""
    complete = F.coalesce(completeness, F.lit(0.0)) >= enough
    return (
        F.when(~passed, F.when(complete, "explainer").otherwise("researcher"))
        .when(passed, "end")
        .when(answered, "fact_checker")
        .when(complete, "explainer")
        .when(researched < most_research, "researcher")
        .otherwise("explainer")
    )


def latest_message(rows: DataFrame, role: str = "assistant", *, group: str = "conv_id", order: str = "turn") -> DataFrame:
    """(group, order, text): the last message of a role in each conversation that has one; a maximum, which combines map-side."""
    last = F.max_by(F.struct(order, "text"), order).alias("last")
    return rows.where(F.col("role") == role).groupBy(group).agg(last).select(group, "last.*")
