"""Knowledge-graph operators: resolution, neighbourhoods, relevance expansion and communities.

Edges are (source, target, weight), undirected wherever neighbours count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodewell.functions.text import strip
from lodewell.functions.vectors import cosine, literal
from lodewell.operators.components import connected_components
from lodewell.operators.matching import best_matches
from lodewell.sources.tables import by_partition, materialize


def group_entities(mentions: DataFrame, *, name: str = "name", article: str = "article_id", ordinal: str = "ordinal") -> DataFrame:
    """Mentions by stripped lower-cased name: the first spelling and type, mention_count, distinct articles and other
    spellings as sorted arrays."""
    keyed = mentions.withColumn("key", F.lower(strip(F.col(name)))).where(F.col("key") != "")
    base = keyed.groupBy("key").agg(F.min_by(name, ordinal).alias("name"), F.min_by("type", ordinal).alias("type"), F.count("*").alias("mention_count"))
    for column, to in ((article, "article_ids"), (name, "names")):
        single = keyed.select("key", F.col(column).alias("one")).distinct()
        base = base.join(single.groupBy("key").agg(F.array_sort(F.collect_list("one")).alias(to)), "key")
    return base.withColumn("aliases", F.array_remove("names", F.col("name"))).drop("names")


def count_entities(mentions: DataFrame, *, name: str = "name", article: str = "article_id", ordinal: str = "ordinal") -> DataFrame:
    """As `group_entities`, with the numbers of articles and aliases only: nothing is gathered, however hot a name."""
    keyed = mentions.withColumn("key", F.lower(strip(F.col(name)))).where(F.col("key") != "")
    base = keyed.groupBy("key").agg(F.min_by(name, ordinal).alias("name"), F.min_by("type", ordinal).alias("type"), F.count("*").alias("mention_count"))
    for column, to, less in ((article, "articles", 0), (name, "aliases", 1)):
        single = keyed.select("key", F.col(column).alias("one")).distinct()
        base = base.join(single.groupBy("key").agg((F.count("one") - less).alias(to)), "key")
    return base


def resolve_entities(found: DataFrame, stored: DataFrame, *, threshold: float = 0.85) -> DataFrame:
    """`found` (id, name, embedding) with canonical_name: that of the nearest of `stored` (id, canonical_name, embedding)
    with a cosine of at least `threshold`, else its own name. Found entities are not compared with one another."""
    known = best_matches(found.select("id", "embedding"), stored.select("id", "embedding"), threshold=threshold)
    known = known.join(stored.select(F.col("id").alias("match"), "canonical_name"), "match").select("id", "canonical_name")
    return found.join(known, "id", "left").withColumn("canonical_name", F.coalesce("canonical_name", "name"))


def resolution_map(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, id): every lower-cased name and alias, with the smallest id of all entities it stands for.

    `entities` holds id and name, `aliases` id and alias, a row for each spelling, of stored and new entities alike.
    Entities that share a spelling are one, and so are those that a chain of shared spellings connects: the connected
    components of entities, each linked to the first that has one of its spellings. No entity's spellings are gathered into
    a row, and spellings of one entity alone link nothing.
    """
    spelled = entities.select("id", F.lower(strip(F.col("name"))).alias("name")).union(aliases.select("id", F.lower(strip(F.col("alias")))))
    spelled = materialize(by_partition(spelled.where("id IS NOT NULL AND name <> ''").distinct()), "spellings")
    first = materialize(spelled.groupBy("name").agg(F.min("id").alias("first")), "first")
    links = spelled.join(first, "name").where("id <> first")
    of = connected_components(links, "id", "first").select(F.col("node").alias("first"), "component")
    return first.join(of, "first", "left").select("name", F.coalesce("component", "first").alias("id"))


def resolve_names(edges: DataFrame, entities: DataFrame, *, names: tuple[str, str] = ("source_name", "target_name"), aliases: DataFrame | None = None) -> DataFrame:
    """Edges with both names replaced by entity ids; edges with a name that is not found are dropped.

    Strict, names are those of `entities` (id, name), exactly or else regardless of case (the smallest id of equals). With
    `aliases` (id, alias), any spelling counts, and an edge ends at the entity that `resolution_map` gives for it.
    """
    edges = by_partition(edges)  # maps of names grow with the entities: they are not to go through the driver
    if aliases is not None:
        known = materialize(resolution_map(entities, aliases), "resolution")
        for column, to in zip(names, ("source", "target"), strict=True):
            edges = edges.withColumn("_name", F.lower(strip(F.col(column)))).join(known.select(F.col("name").alias("_name"), F.col("id").alias(to)), "_name").drop("_name")
        return edges.drop(*names)
    exact = entities.groupBy("name").agg(F.min("id").alias("exact"))
    loose = entities.groupBy(F.lower("name").alias("lower_name")).agg(F.min("id").alias("loose"))
    for column, to in zip(names, ("source", "target"), strict=True):
        e, o = exact.withColumnRenamed("name", column), loose
        edges = edges.join(e, column, "left").join(o, F.lower(column) == F.col("lower_name"), "left")
        edges = edges.withColumn(to, F.coalesce("exact", "loose")).drop("exact", "loose", "lower_name")
    return edges.where("source IS NOT NULL AND target IS NOT NULL").drop(*names)


def incident(edges: DataFrame, nodes: DataFrame, *, node: str = "id") -> DataFrame:
    """Edges with an end in `nodes`: two semi joins and a distinct union, as an OR join can't be hashed."""
    by = lambda end: edges.join(nodes.select(F.col(node).alias(end)), end, "left_semi").select(*edges.columns)
    return by("source").union(by("target")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, weight) for each end of each edge; a null or zero weight counts as 1."""
    weight = F.when(F.col("weight").isNull() | (F.col("weight") == 0), F.lit(1.0)).otherwise(F.col("weight").cast("double")).alias("weight")
    forth = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), weight)
    return forth.union(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), weight))


def neighbours(edges: DataFrame, seeds: DataFrame, *, node: str = "id") -> DataFrame:
    """(id, avg_weight) of the nodes next to a seed that are no seeds: the mean weight of their edges to seeds."""
    near = both_ways(edges).join(seeds.select(F.col(node).alias("other")).distinct(), "other", "left_semi")
    near = near.join(seeds.select(F.col(node).alias("node")), "node", "left_anti")
    return near.groupBy(F.col("node").alias("id")).agg(F.avg("weight").alias("avg_weight"))


def expand(
    edges: DataFrame, seeds: DataFrame, nodes: DataFrame, members: DataFrame, *, hops: int = 2, limit: int = 50, vector: str = "embedding"
) -> DataFrame:
    """(id, hop, relevance) of at most `limit` nodes reached from the seeds.

    relevance = 0.4 cosine(mean seed vector, node) + 0.3 min(avg weight / 5, 1) + 0.3 if the node shares a community
    (`members`: community, id) with a seed. Each hop takes the best under what is left of the limit, ties to the
    smaller id, and goes on from those it took; an empty hop ends it. At most `limit` rows a hop reach the driver.
    """
    spark = edges.sparkSession
    seed_vectors = nodes.join(seeds, "id", "left_semi").where(F.col(vector).isNotNull()).select(F.posexplode(vector).alias("at", "x"))
    mean = [r["x"] for r in seed_vectors.groupBy("at").agg(F.avg("x").alias("x")).orderBy("at").collect()]
    touched = members.join(seeds, "id", "left_semi").select("community").distinct()
    friends = members.join(touched, "community", "left_semi").select("id").distinct().withColumn("friend", F.lit(0.3))
    taken: list[tuple] = []
    seen, frontier = seeds.select("id").distinct(), seeds.select("id").distinct()
    kind = seeds.schema["id"].dataType.simpleString()
    for hop in range(1, hops + 1):
        if len(taken) >= limit:
            break
        near = neighbours(edges, frontier).join(seen, "id", "left_anti").join(nodes.select("id", vector), "id").join(friends, "id", "left")
        close = cosine(F.col(vector), literal(mean)) if mean else F.lit(0.0)
        relevance = 0.4 * F.coalesce(close, F.lit(0.0)) + 0.3 * F.least(F.col("avg_weight") / 5, F.lit(1.0)) + F.coalesce("friend", F.lit(0.0))
        best = near.select("id", F.lit(hop).alias("hop"), relevance.alias("relevance")).orderBy(F.desc("relevance"), "id").limit(limit - len(taken))
        found = [tuple(r) for r in best.collect()]
        if not found:
            break
        taken += found
        frontier = spark.createDataFrame([(r[0],) for r in found], f"id {kind}")
        seen = seen.union(frontier)
    return spark.createDataFrame(taken, f"id {kind}, hop int, relevance double")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("degree"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, community): connected components, a node without edges being its own."""
    parts = connected_components(edges, "source", "target").select(F.col("node").alias("id"), F.col("component").alias("community"))
    return by_partition(nodes.select("id")).join(parts, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def hubs(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, hub, degree): the member with most edges, the smallest id of equals."""
    known = members.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = known.groupBy("community").agg(F.max_by(F.struct("id", "degree"), F.struct("degree", -F.col("id"))).alias("b"))
    return best.select("community", F.col("b.id").alias("hub"), F.col("b.degree").alias("degree"))


def hub_labels(found: DataFrame, shown: DataFrame) -> DataFrame:
    """The rows of `hubs` with hub_label, the label of the hub if it is among the nodes that are `shown` (id, label)."""
    return found.join(shown.select(F.col("id").alias("hub"), F.col("label").alias("hub_label")), "hub", "left")


def profiles(members: DataFrame, entities: DataFrame) -> DataFrame:
    """Of each community: n members, its types with counts, the commonest first, and its three most mentioned names."""
    known = members.join(entities, "id")
    counts = known.groupBy("community", "type").agg(F.count("*").alias("c"))
    types = counts.groupBy("community").agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("o"), F.concat("type", F.lit(":"), F.col("c").cast("string")).alias("t")))).alias("t"), F.sum("c").alias("n"))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("mention_count"), "name"))
    top = known.withColumn("r", rank).where("r <= 3").groupBy("community").agg(F.array_sort(F.collect_list(F.struct("r", "name"))).alias("s"))
    out = types.join(top, "community")
    return out.select("community", "n", F.array_join(F.transform("t", lambda x: x["t"]), ", ").alias("types"), F.array_join(F.transform("s", lambda x: x["name"]), ", ").alias("top_names"))


def visual(edges: DataFrame, seeds: DataFrame, expanded: DataFrame) -> DataFrame:
    """Edges among seeds and expanded nodes, flagged is_expanded where an end is no seed."""
    nodes = seeds.select("id", F.lit(False).alias("far")).union(expanded.select("id", F.lit(True)))
    out = edges
    for end in ("source", "target"):
        out = out.join(nodes.select(F.col("id").alias(end), F.col("far").alias(f"{end}_far")), end)
    return out.withColumn("is_expanded", F.col("source_far") | F.col("target_far")).drop("source_far", "target_far")


def relevance_band(score: Column) -> Column:
    return F.when(score >= 8, "high").when(score >= 6, "medium").otherwise("low")


def community_articles(members: DataFrame, links: DataFrame) -> DataFrame:
    """The distinct (community, article_id) of the members (community, id) of communities and the articles (id, article_id)
    of entities; a table of pairs, so that a community of any size is no array."""
    return members.join(links, "id").select("community", "article_id").distinct()


def community_overlap(neighbours: DataFrame, members: DataFrame, seeds: DataFrame, *, node: str = "id") -> DataFrame:
    """`neighbours` with `overlap`: 1.0 if one of the communities (community, node) that hold a seed holds the node too, else 0.0."""
    touched = members.join(seeds.select(node), node, "left_semi").select("community").distinct()
    near = members.join(touched, "community", "left_semi").select(F.col(node).alias("_near")).distinct()
    found = neighbours.join(near, F.col(node) == F.col("_near"), "left")
    return found.select(*neighbours.columns, F.when(F.col("_near").isNull(), 0.0).otherwise(1.0).alias("overlap"))


def visual_statistics(nodes: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row of how many entities (nodes: is_expanded), seeds, expanded ones, relationships and communities are shown."""
    n, expanded = F.count("*"), F.coalesce(F.col("is_expanded"), F.lit(False))
    parts = nodes.agg(n.alias("total_entities"), F.count_if(~expanded).alias("seed_entities"), F.count_if(expanded).alias("expanded_entities"))
    for df, name in ((edges, "total_relationships"), (communities, "total_communities")):
        parts = parts.unionByName(df.agg(n.alias(name)), allowMissingColumns=True)
    return parts.agg(*(F.max(c).alias(c) for c in parts.columns))
