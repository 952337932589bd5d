"""Sections of a report: a bounded number of lines of each group, the best first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodewell.functions.contracts import prompt
from lodewell.operators.providers import Provider, complete

# How many lines each section of an analysis shows.
CAPS = {"entities": 20, "relationships": 20, "communities": 10, "expanded": 10}


def section(rows: DataFrame, by: str, line: Column, *order: Column, most: int, empty: str = "none") -> DataFrame:
    """(by, text): the first `most` lines of each group in `order`, one below the other; a null line reads `empty`.

    The ranking is cut off map-side, so that a large group sends `most` rows a task.
    """
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    best = rows.select(by, rank.alias("rank"), F.coalesce(line, F.lit(empty)).alias("line")).where(F.col("rank") <= most)
    lines = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return best.groupBy(by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def packed(rows: DataFrame, by: str, line: Column, *order: Column, budget: int) -> DataFrame:
    """(by, text, tokens, lines, cut): the lines of each group, in `order`, as far as a budget of tokens goes.

    A line costs a token for every four characters, its break included, and one at least. The first line that doesn't
    fit is cut to what is left, and nothing comes behind it; null lines are left out. No more lines than the budget has
    tokens can fit, so that a group of any size sends as many rows a task and is never gathered.
    """
    some = rows.withColumn("line", line).where("line IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    first = some.withColumn("rank", rank).where(F.col("rank") <= budget + 1).select(by, "rank", "line")
    cost = F.greatest(F.lit(1), F.floor((F.length("line") + 1) / 4))
    before = F.coalesce(F.sum(cost).over(Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = first.withColumn("cost", cost).withColumn("left", F.lit(budget) - before).where(F.col("left") > 0)
    cut = F.col("cost") > F.col("left")
    kept = fits.select(by, "rank", F.when(cut, F.substr("line", F.lit(1), (F.col("left") * 4).cast("int"))).otherwise(F.col("line")).alias("line"), F.least("cost", "left").alias("cost"), cut.alias("cut"))
    lines = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return kept.groupBy(by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"), F.sum("cost").alias("tokens"), F.count("*").alias("lines"), F.max("cut").alias("cut"))


def written(contexts: DataFrame, by: str, template: str, provider: Callable[[], Provider]) -> DataFrame:
    """(by, report, error): what a model writes on each context (by, text); `template` has {text}."""
    asked = complete(contexts.select(by, prompt(template, text=F.col("text")).alias("prompt")), "prompt", provider)
    return asked.select(by, F.col("answer").alias("report"), "error")


def type_line(kind: Column, meaning: Column) -> Column:
    return F.concat(F.lit("- "), kind, F.lit(": "), meaning)


def numbered_entity(number: Column, name: Column, kind: Column, description: Column) -> Column:
    """An entity in a numbered list, its description below it if there is one."""
    more = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("\n   "), description)).otherwise("")
    return F.concat(number.cast("string"), F.lit(". "), name, F.lit(" ("), kind, F.lit(")"), more)


def community_line(name: Column, summary: Column, entities: Column) -> Column:
    return F.concat(F.lit("- "), name, F.lit(": "), F.coalesce(summary, F.lit("N/A")), F.lit(" ("), entities.cast("string"), F.lit(" entities)"))


def expanded_line(name: Column, relevance: Column, hop: Column) -> Column:
    return F.concat(F.lit("- "), name, F.lit(": relevance "), F.format_string("%.2f", relevance), F.lit(", hop "), hop.cast("string"))


def article_block(number: Column, title: Column, source: Column, published: Column, summary: Column) -> Column:
    """An article with its summary, cut to 200 characters; what is missing reads N/A, and a missing summary is left out."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("N/A"))
    more = F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("\nSummary: "), F.substring(summary, 1, 200), F.lit("..."))).otherwise("")
    return F.concat(F.lit("### Article "), number.cast("string"), F.lit("\nTitle: "), shown(title), F.lit("\nSource: "), shown(source), F.lit("\nPublished: "), shown(published), more)


def found_block(number: Column, source: Column, relevance: Column, content: Column) -> Column:
    """What a tool found: where, why, and the first 500 characters."""
    text = F.concat(F.substring(F.coalesce(content, F.lit("")), 1, 500), F.lit("..."))
    return F.concat(F.lit("### Finding "), number.cast("string"), F.lit(" ("), F.coalesce(source, F.lit("unknown")), F.lit(")\nWhy: "), F.coalesce(relevance, F.lit("")), F.lit("\n"), text)


def optional_section(heading: str, content: Column, most: int = 2000) -> Column:
    """A heading and the first `most` characters of a text, behind a blank line; nothing where there is no text."""
    return F.when(F.coalesce(content, F.lit("")) == "", "").otherwise(F.concat(F.lit(f"\n\n{heading}\n"), F.substring(content, 1, most)))


def entity_line(name: Column, kind: Column, description: Column, expanded: Column) -> Column:
    mark = F.when(expanded, "* ").otherwise("")
    return F.concat(F.lit("- "), mark, name, F.lit(" ("), kind, F.lit("): "), F.coalesce(description, F.lit("N/A")))


def relation_line(source: Column, kind: Column, target: Column) -> Column:
    return F.concat(F.lit("- "), source, F.lit(" --["), kind, F.lit("]--> "), target)


def merged_sections(summary: Column, sections: Column) -> Column:
    """The summary and, below it, each of an array of sections that is not blank and not yet part of the text."""
    add = lambda text, s: F.when((s == "") | F.contains(text, s), text).when(text == "", s).otherwise(F.concat(text, F.lit("\n\n"), s))
    stripped = F.transform(sections, lambda s: F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"^\s+|\s+$", "")))
    return F.aggregate(stripped, F.regexp_replace(F.coalesce(summary, F.lit("")), r"^\s+|\s+$", ""), add)


def status(articles: DataFrame, *, key: str = "id", report: str = "deepsearch_report", when: str = "deepsearch_performed_at") -> DataFrame:
    """(key, has_report, performed_at, preview) of each article: an empty report is one, but has no preview."""
    return articles.select(key, F.col(report).isNotNull().alias("has_report"), F.col(when).alias("performed_at"), F.nullif(F.col(report).cast("string"), F.lit("")).alias("preview"))
