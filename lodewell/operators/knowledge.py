"""The knowledge graph of a collection: built from model answers about articles, and analysed around some of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewell.functions import contracts
from lodewell.functions.text import strip
from lodewell.operators import graph, listing, report
from lodewell.sources.tables import by_partition, materialize

# An answer holds fewer entities than this.
ANSWER_ENTITIES = 1_000_000


@dataclass(frozen=True)
class KnowledgeGraph:
    """entities (id, name, type, mention_count), mentions (article_id, id), edges (source, target, weight) and
    members (community, id)."""

    entities: DataFrame
    mentions: DataFrame
    edges: DataFrame
    members: DataFrame


def build(
    answers: DataFrame,
    *,
    article: str = "article_id",
    entities: str = "entities",
    relations: str = "relations",
    stored: DataFrame | None = None,
    embed: Callable[[Column], Column] | None = None,
    communities: Callable[[DataFrame, DataFrame], DataFrame] = graph.components,
) -> KnowledgeGraph:
    """The graph of one answer with entities and one with relationships for each article, whose key is a whole number.

    Spellings that differ in case or outer space are one entity, whose id is the place of its first mention: the article's
    key times a million, and the number in the answer. With `stored` (id, canonical_name, embedding) and `embed`, entities
    take the canonical name of the nearest stored one first, and those that share it are one. Each relationship found
    adds 1 to its edge; those with an end that no answer has as an entity are dropped. Entities without edges are
    communities of their own. Unreadable and null answers give nothing; no answers, an empty graph.

    Answers are parsed once. Mentions and relationships are summed map-side before anything is joined on a name, and joins
    are by partition: entities grow with the answers.
    """
    answers = by_partition(answers)
    found = answers.select(F.col(article).alias("article_id"), F.posexplode(contracts.entities(F.col(entities))).alias("at", "e"))
    found = found.select("article_id", "e.name", "e.type", F.lower(strip(F.col("e.name"))).alias("key"), (F.col("article_id") * ANSWER_ENTITIES + F.col("at")).alias("ordinal"))
    found = materialize(found, "mentions")
    first = found.groupBy("key").agg(F.min("ordinal").alias("id"), F.min_by("name", "ordinal").alias("name"), F.min_by("type", "ordinal").alias("type"), F.count("*").alias("mention_count"))
    if stored is not None and embed is not None:
        first = graph.resolve_entities(materialize(first.withColumn("embedding", embed(F.col("name"))), "embedded"), stored)
        first = first.drop("embedding").withColumnRenamed("canonical_name", "canonical")
    else:
        first = first.withColumn("canonical", F.col("name"))
    first = materialize(first.withColumn("same", F.lower(strip(F.col("canonical")))), "spellings")
    known = first.groupBy("same").agg(F.min_by("canonical", "id").alias("name"), F.min_by("type", "id").alias("type"), F.sum("mention_count").alias("mention_count"), F.min("id").alias("id"))
    known = materialize(known, "entities")
    spelt = first.select("key", "same").join(known.select("same", "id"), "same").select("key", "id")
    mentions = found.select("article_id", "key").distinct().join(spelt, "key").select("article_id", "id").distinct()

    said = answers.select(F.inline(contracts.relations(F.col(relations))))
    said = said.groupBy(F.lower(strip(F.col("source"))).alias("source_name"), F.lower(strip(F.col("target"))).alias("target_name")).agg(F.count("*").cast("double").alias("n"))
    for end in ("source", "target"):
        said = said.join(spelt.select(F.col("key").alias(f"{end}_name"), F.col("id").alias(end)), f"{end}_name")
    edges = materialize(said.groupBy("source", "target").agg(F.sum("n").alias("weight")), "edges")
    entities_out = known.select("id", "name", "type", "mention_count")
    return KnowledgeGraph(entities_out, materialize(mentions, "mentioned"), edges, communities(edges, known.select("id")))


def analyse(kg: KnowledgeGraph, wanted: DataFrame, *, vectors: DataFrame | None = None, hops: int = 2, limit: int = 50) -> DataFrame:
    """(section, text): a report on the articles in `wanted` (article_id), with the sections of `report.CAPS`.

    entities: the seeds, those that the articles mention, the most mentioned first. expanded: nodes reached from them by
    `graph.expand`, the most relevant first. relationships: edges among both, the heaviest first. communities: those
    of the nodes shown, by the number of all their members. Ties go to the smaller id. A section without lines is left out,
    and articles without entities give no report. Without `vectors` (id, embedding) likeness counts nothing.
    """
    seeds = materialize(listing.touching(kg.mentions, wanted, "article_id", ["id"]), "seeds")
    nodes = kg.entities.select("id")
    nodes = nodes.join(vectors, "id", "left") if vectors is not None else nodes.withColumn("embedding", F.lit(None).cast("array<double>"))
    members = kg.members.select("community", "id")
    far = graph.expand(kg.edges, seeds, nodes, members, hops=hops, limit=limit)
    names = kg.entities.select("id", "name", "type", "mention_count")
    none = F.lit(None).cast("string")

    one = lambda df, name: df.withColumn("section", F.lit(name))
    near_lines = one(names.join(seeds, "id", "left_semi"), "entities")
    near_lines = report.section(near_lines, "section", report.entity_line(F.col("name"), F.col("type"), none, F.lit(False)), F.desc("mention_count"), F.col("id"), most=report.CAPS["entities"])
    far_lines = one(names.join(F.broadcast(far), "id"), "expanded")  # at most `limit` rows
    far_lines = report.section(far_lines, "section", report.entity_line(F.col("name"), F.col("type"), none, F.lit(True)), F.desc("relevance"), F.col("id"), most=report.CAPS["expanded"])
    shown = graph.visual(kg.edges, seeds, far)
    for end in ("source", "target"):
        shown = shown.join(names.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name")), end)
    links = report.relation_line(F.col("source_name"), F.lit("RELATED_TO"), F.col("target_name"))
    links = report.section(one(shown, "relationships"), "section", links, F.desc("weight"), F.col("source"), F.col("target"), most=report.CAPS["relationships"])
    touched = members.join(seeds.union(far.select("id")), "id", "left_semi").select("community").distinct()
    sizes = members.join(touched, "community", "left_semi").groupBy("community").agg(F.count("*").alias("n"))
    line = F.concat(F.lit("- community "), F.col("community").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" entities"))
    groups = report.section(one(sizes, "communities"), "section", line, F.desc("n"), F.col("community"), most=report.CAPS["communities"])
    return near_lines.union(links).union(groups).union(far_lines)
