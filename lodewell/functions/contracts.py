"""What model answers must hold, and what is made of those that do not."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodewell.functions.json_repair import parsed
from lodewell.functions.text import bound, json_in_text, strip

DECISION = "thought string, action string, action_input map<string,string>"
REFLECTION = "passed boolean, issues array<string>, feedback string"
ENTITIES = "entities array<struct<name:string,type:string,description:string>>"
RELATIONS = "relationships array<struct<source:string,target:string,relation_type:string,description:string,weight:double>>"
SUPERVISION = "route string, reasoning string, info_completeness double"
THOUGHT = "thought string, action string, action_input map<string,string>"
FACT_CHECK = "passed boolean, reason string, issues array<string>"
TRANSLATION = "chinese_title string, chinese_summary string, entities_preserved array<string>"


def reflection(answer: Column) -> Column:
    """The reflection in an answer; one that can't be read has passed, without issues."""
    r = parsed(json_in_text(answer), REFLECTION)
    return F.struct(F.coalesce(r["passed"], F.lit(True)).alias("passed"), F.coalesce(r["issues"], F.array().cast("array<string>")).alias("issues"), r["feedback"].alias("feedback"))


def decision(answer: Column, actions: list[str]) -> Column:
    """The decision in an answer, repaired where it broke off, with error where no known action is named."""
    r = parsed(json_in_text(answer), DECISION)
    error = F.when(r["action"].isNull(), "no action").when(~r["action"].isin(actions), F.concat(F.lit("unknown action "), r["action"]))
    return F.struct(r["thought"].alias("thought"), r["action"].alias("action"), F.coalesce(r["action_input"], F.create_map().cast("map<string,string>")).alias("action_input"), error.alias("error"))


def search_decision(answer: Column, tools: list[str]) -> Column:
    """The next step of a search in an answer, repaired where it broke off: readable, thought, action and its input.

    An answer is readable if it holds a thought and an action, and an input to any action but conclude; an action that
    is no tool concludes.
    """
    r = parsed(json_in_text(answer), DECISION)
    readable = r["thought"].isNotNull() & r["action"].isNotNull() & ((r["action"] == "conclude") | r["action_input"].isNotNull())
    known = F.when(r["action"].isin(tools), r["action"]).otherwise("conclude")
    return F.struct(
        F.coalesce(readable, F.lit(False)).alias("readable"), F.coalesce(r["thought"], F.lit("")).alias("thought"),
        known.alias("action"), F.when(known != "conclude", r["action_input"]).alias("action_input"),
    )


def entities(answer: Column) -> Column:
    """The entities in an answer, repaired where it broke off: those with a name, of type CONCEPT where none is given;
    none where the answer can't be read."""
    found = F.coalesce(parsed(json_in_text(answer), ENTITIES)["entities"], F.array().cast(ENTITIES.split(" ", 1)[1]))
    named = F.filter(found, lambda e: F.coalesce(strip(e["name"]), F.lit("")) != "")
    return F.transform(named, lambda e: F.struct(strip(e["name"]).alias("name"), F.coalesce(F.nullif(e["type"], F.lit("")), F.lit("CONCEPT")).alias("type"), F.coalesce(e["description"], F.lit("")).alias("description")))


def relations(answer: Column) -> Column:
    """The relationships in an answer: those with both ends, of weight 1 where none is given; none if unreadable."""
    found = F.coalesce(parsed(json_in_text(answer), RELATIONS)["relationships"], F.array().cast(RELATIONS.split(" ", 1)[1]))
    whole = F.filter(found, lambda r: (F.coalesce(strip(r["source"]), F.lit("")) != "") & (F.coalesce(strip(r["target"]), F.lit("")) != ""))
    return F.transform(whole, lambda r: F.struct(strip(r["source"]).alias("source"), strip(r["target"]).alias("target"), F.coalesce(r["relation_type"], F.lit("RELATED_TO")).alias("relation_type"), F.coalesce(r["weight"], F.lit(1.0)).alias("weight")))


def string_list(answer: Column, most: int) -> Column:
    """The first `most` strings of the JSON array in an answer, or of its lines, without list marks, where there is none."""
    listed = F.from_json(F.nullif(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), F.lit("")), "array<string>")
    lines = F.transform(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda t: strip(F.regexp_replace(t, r"^\s*(?:[-*]|\d+[.)])\s*", "")))
    return F.slice(F.filter(F.coalesce(listed, lines), lambda t: t.isNotNull() & (t != "")), 1, most)


# What in an answer that is no JSON stands for which route or action, tried in this order.
ROUTES = ["researcher", "explainer", "fact_checker", "end"]
ROUTE_WORDS = {"end": (["end", "完成"], 1.0), "explainer": (["explainer", "解释"], 0.8), "fact_checker": (["fact", "核查"], 0.9)}
ACTION_WORDS = {
    "web_search": ["web_search", "网络搜索"],
    "vector_search": ["vector_search", "向量搜索", "related_articles"],
    "citation_lookup": ["citation_lookup", "实体查询", "知识图谱"],
    "conversation_history": ["conversation_history", "对话历史"],
}
PASSED_WORDS = ["核查通过", "验证通过"]


def _mentions(answer: Column, words: list[str]) -> Column:
    said = F.lower(F.coalesce(answer, F.lit("")))
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(said, w))


def _object(answer: Column, schema: str) -> tuple[Column, Column]:
    """Whether there is a JSON object in an answer, and its fields."""
    text = json_in_text(answer)
    return F.coalesce(F.startswith(F.ltrim(text), F.lit("{")) & F.try_parse_json(text).isNotNull(), F.lit(False)), F.from_json(text, schema)


def supervision(answer: Column) -> Column:
    """Where a chat goes on: route, reasoning and completeness; an unknown route is the researcher's, and an answer that
    is no JSON goes by its words."""
    whole, r = _object(answer, SUPERVISION)
    route, sure = F.lit("researcher"), F.lit(0.3)
    for name, (words, value) in reversed(ROUTE_WORDS.items()):
        route, sure = F.when(_mentions(answer, words), name).otherwise(route), F.when(_mentions(answer, words), value).otherwise(sure)
    return F.struct(
        F.when(~whole, route).when(r["route"].isin(ROUTES), r["route"]).otherwise("researcher").alias("route"),
        F.when(whole, F.coalesce(r["reasoning"], F.lit(""))).otherwise(F.concat(F.lit("by words: "), route)).alias("reasoning"),
        F.when(whole, F.coalesce(r["info_completeness"], F.lit(0.5))).otherwise(sure).alias("completeness"),
    )


def research_thought(answer: Column) -> Column:
    """The next step of a search: thought, action and its input; without JSON the action that the answer names, and
    without one or the other the search concludes."""
    whole, r = _object(answer, THOUGHT)
    action = F.lit("conclude")
    for name, words in reversed(ACTION_WORDS.items()):
        action = F.when(_mentions(answer, words), name).otherwise(action)
    return F.struct(
        F.when(whole, F.coalesce(r["thought"], F.lit(""))).otherwise(F.concat(F.lit("by words: "), action)).alias("thought"),
        F.when(whole, F.coalesce(r["action"], F.lit("conclude"))).otherwise(action).alias("action"),
        F.when(whole, r["action_input"]).alias("action_input"),
    )


def fact_check(answer: Column) -> Column:
    """Whether facts hold, why, and what is wrong. Whatever can't be read has failed, but for a plain phrase of passing."""
    # Of the innermost objects, which hold no other, the first that says whether it passed.
    innermost = F.transform(F.split(answer, r"\{"), lambda t: F.concat(F.lit("{"), F.substring_index(t, "}", 1), F.lit("}")))
    inner = F.try_element_at(F.filter(innermost, lambda t: F.get_json_object(t, "$.passed").isNotNull()), F.lit(1))
    outer, r = _object(answer, FACT_CHECK)
    within, s = _object(inner, FACT_CHECK)
    passed = F.when(outer, F.coalesce(r["passed"], F.lit(False))).when(within, F.coalesce(s["passed"], F.lit(False))).otherwise(_mentions(answer, PASSED_WORDS))
    none = F.array().cast("array<string>")
    issues = F.when(outer, F.coalesce(r["issues"], none)).when(within, F.coalesce(s["issues"], none)).when(passed, none).otherwise(F.array(F.lit("unreadable answer")))
    reason = F.when(outer, r["reason"]).when(within, s["reason"]).when(passed, "by words: passed").otherwise(F.concat(F.lit("unreadable: "), F.substring(F.coalesce(answer, F.lit("")), 1, 100)))
    return F.struct(passed.alias("passed"), F.coalesce(reason, F.lit("")).alias("reason"), issues.alias("issues"))


def content_text(answer: Column) -> Column:
    """The text of an answer that is plain or a JSON list of parts: strings and parts of type text, put together."""
    parts = F.from_json(F.when(F.startswith(answer, F.lit("[")), answer), "array<string>")  # parts that are objects stay JSON
    part = lambda p: F.when(F.startswith(p, F.lit("{")) & F.try_parse_json(p).isNotNull(), F.when(F.get_json_object(p, "$.type") == "text", F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))).otherwise("")).otherwise(p)
    return F.coalesce(F.array_join(F.transform(parts, part), ""), answer)


def translation(answer: Column) -> Column:
    """Title, summary and entities of an answer, and how they were read: as JSON, by labelled fields, or as plain
    text whose first line is the title."""
    labelled = lambda a, name: F.regexp_extract(a, rf'"?{name}"?\s*[:：]\s*"?((?s:.*?))"?\s*(?:,?\s*"?(?:chinese_title|chinese_summary|entities_preserved)"?\s*[:：]|\}}|$)', 1)
    made = lambda title, summary, entities, mode: F.struct(
        title.cast("string").alias("title"), summary.cast("string").alias("summary"), F.coalesce(entities, F.array().cast("array<string>")).alias("entities"), F.lit(mode).alias("parser_mode")
    )
    none = F.lit(None)

    def as_text(first: Column, plain: Column, entities: Column) -> Column:
        rest = strip(F.substr(plain, F.length(first) + 1))
        return bound(rest, lambda t: F.when(t != "", made(first, t, entities, "text")).otherwise(made(none, none, entities, "error")))

    def unread(x: Column) -> Column:
        text = bound(strip(x["answer"]), lambda p: bound(F.split_part(p, F.lit("\n"), F.lit(1)), lambda first: as_text(first, p, x["r"]["entities_preserved"])))
        fields = F.struct(labelled(x["answer"], "chinese_title").alias("title"), labelled(x["answer"], "chinese_summary").alias("summary"))
        return bound(fields, lambda f: F.when((f["title"] != "") & (f["summary"] != ""), made(f["title"], f["summary"], x["r"]["entities_preserved"], "fields")).otherwise(text))

    # Each step is worked out once, and only for the answers that the steps before it can't read.
    read = F.struct(answer.alias("answer"), parsed(json_in_text(answer), TRANSLATION).alias("r"))
    as_json = lambda x: x["r"]["chinese_title"].isNotNull() & x["r"]["chinese_summary"].isNotNull()
    return bound(read, lambda x: F.when(as_json(x), made(x["r"]["chinese_title"], x["r"]["chinese_summary"], x["r"]["entities_preserved"], "json")).otherwise(unread(x)))


def confidence(answer: Column, high: list[str], low: list[str]) -> Column:
    """high, low or medium, by markers in the answer; low wins."""
    has = lambda words: F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(answer), w)), F.lit(False))
    return F.when(has(low), "low").when(has(high), "high").otherwise("medium")


class Prompts:
    """Templates by name, each with the names that it needs."""

    def __init__(self, templates: dict[str, str] | None = None):
        self._templates: dict[str, str] = {}
        for name, template in (templates or {}).items():
            self.register(name, template)

    def register(self, name: str, template: str) -> None:
        if name in self._templates:
            raise ValueError(f"there is a prompt {name!r} already")
        self._templates[name] = template

    def names(self) -> list[str]:
        return sorted(self._templates)

    def needs(self, name: str) -> list[str]:
        if name not in self._templates:
            raise KeyError(f"no prompt {name!r}; there are {', '.join(self.names())}")
        return sorted({field for _, field, _, _ in string.Formatter().parse(self._templates[name]) if field is not None})

    def prompt(self, name: str, **columns: Column) -> Column:
        """The prompt as a column. All that it needs is given, else ValueError; what it doesn't need is left out."""
        if missing := [n for n in self.needs(name) if n not in columns]:
            raise ValueError(f"prompt {name!r} needs {', '.join(missing)}")
        return prompt(self._templates[name], **columns)


def prompt(template: str, **columns: Column) -> Column:
    """A template with {name} replaced; a name without a column is an error."""
    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            if name not in columns:
                raise ValueError(f"the template needs {name}")
            parts.append(F.coalesce(columns[name].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def expanded_queries(query: Column, expanded: Column, most: int) -> Column:
    """At most `most` queries: those that the query was expanded to, behind the query itself if it is not among them."""
    own = F.when(F.array_contains(expanded, query), expanded).otherwise(F.concat(F.array(query), expanded))
    return F.slice(F.coalesce(own, F.array(query)), 1, most)


def info_citations(collected: Column, *, web: str = "web_search", results: int = 3, snippet: int = 100, most: int = 10) -> Column:
    """Citations (source_type, source_name, url, snippet) of the array of (source, content) that a chat collected.

    What a web search found is a JSON list: of its first results those with a URL are cited, under their title or else
    their source; anything but a list cites nothing. All else is cited by its source and the first characters.
    """
    none = F.lit(None).cast("string")
    cite = lambda kind, name, url, text: F.struct(
        kind.alias("source_type"), F.coalesce(name, F.lit("")).alias("source_name"), url.alias("url"), F.substring(F.coalesce(text, F.lit("")), 1, snippet).alias("snippet")
    )

    def of(info: Column) -> Column:
        listed = F.when(F.startswith(strip(info["content"]), F.lit("[")), F.from_json(info["content"], "array<struct<title:string,source:string,url:string,snippet:string>>"))
        first = F.filter(F.slice(F.coalesce(listed, F.array().cast("array<struct<title:string,source:string,url:string,snippet:string>>")), 1, results), lambda r: r["url"].isNotNull())
        found = F.transform(first, lambda r: cite(F.lit("web"), F.coalesce(r["title"], r["source"]), r["url"], r["snippet"]))
        return F.when(info["source"] == web, found).otherwise(F.array(cite(F.coalesce(info["source"], F.lit("")), info["source"], none, info["content"])))

    return F.slice(F.flatten(F.transform(collected, of)), 1, most)
