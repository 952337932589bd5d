"""Loops of model calls over whole tables: searches, chats and reflection rounds.

A row holds the state of one loop and the node at which it stands. In a round every node's step is applied to the rows
that stand there, as one job, and the new states are written. A provider is asked at most once a row and round, rows
that have ended leave, and a failed call changes its own row only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewell.functions import contracts
from lodewell.functions.text import first_text, format_issues, shorten
from lodewell.operators.conversation import route
from lodewell.operators.providers import Provider, complete
from lodewell.sources.tables import discard, materialize, small_batches

Step = Callable[[DataFrame], DataFrame]
Tool = Callable[[DataFrame], DataFrame]

_CALLS = "array<struct<tool:string,input:map<string,string>,output:string,thought:string>>"

# Complaints that hold one of these are about the format, which has a check of its own.
FORMAT_WORDS = ["标题格式", "摘要结构", "第二段格式", "第三段格式", "要点", "主编洞察", "段落", "空行"]


def rounds(state: DataFrame, steps: dict[str, Step], *, end: str = "end", most: int = 50) -> DataFrame:
    """`state` after every row has reached the node `end`.

    A step gets the rows at its node and returns them with the node they go to. The states of a round are written by
    node, so that a step reads its own rows only; those of the round before are deleted once nothing stands there any
    more. Rows still on their way after `most` rounds come back as they stand. A node without a step raises ValueError.
    """
    now = materialize(state, "round", by="node")
    ended = []
    for number in range(most + 1):
        at = {r["node"] for r in now.select("node").distinct().collect()}
        if unknown := at - {*steps, end}:
            raise ValueError(f"no step for {sorted(unknown)}")
        if end in at:
            ended.append(now.where(F.col("node") == end))
        going = sorted(at - {end})
        if not going or number == most:
            ended += [now.where(F.col("node") == name) for name in going]
            break
        moved = [steps[name](now.where(F.col("node") == name)).select(*state.columns) for name in going]
        after = materialize(reduce(DataFrame.unionByName, moved), "round", by="node")
        if end not in at:
            discard(now)
        now = after
    return reduce(DataFrame.unionByName, ended) if ended else now


def _asked(rows: DataFrame, prompt: Column, provider: Callable[[], Provider]) -> DataFrame:
    """Rows with `answer` and `error`, one of them null."""
    return complete(rows.withColumn("prompt", prompt), "prompt", provider, attempts=1).drop("prompt")


def _noted(phase: str, message: Column, when: Column) -> Column:
    """`errors`, with another one where `when` holds."""
    return F.when(when, F.array_append("errors", F.concat(F.lit(phase + ": "), message))).otherwise(F.col("errors"))


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _set(rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.withColumns(columns)


def collected_text(collected: Column, *, most: int = 500) -> Column:
    """What tools found: a numbered entry for each call, its output cut."""
    entry = lambda c, i: F.concat((i + 1).cast("string"), F.lit(". ["), c["tool"], F.lit("] "), shorten(F.coalesce(c["output"], F.lit("")), most))
    return F.when(F.size(collected) == 0, "nothing yet").otherwise(F.array_join(F.transform(collected, entry), "\n"))


def _run_tools(rows: DataFrame, tools: dict[str, Tool]) -> DataFrame:
    """Rows with `output`: each tool is run once, on all rows that call it; null where it gave none.

    A tool gets (key, input) and returns (key, output), both as one job over all calls.
    """
    outputs = [tools[name](rows.where(F.col("pending") == name).select("key", F.col("pending_input").alias("input"))).select("key", "output") for name in sorted(tools)]
    if not outputs:
        return rows.withColumn("output", _none("string"))
    found = reduce(DataFrame.unionByName, outputs).groupBy("key").agg(F.max("output").alias("output"))
    return rows.join(found, "key", "left")


def _call() -> Column:
    return F.array(F.struct(F.col("pending").alias("tool"), F.col("pending_input").alias("input"), "output", "thought"))


def search(articles: DataFrame, provider: Callable[[], Provider], tools: dict[str, Tool], *, key: str = "id", most_steps: int = 5) -> DataFrame:
    """(key, steps, collected, report, errors): a search about each of `articles` (key, title, source, published_at, summary).

    The model is asked for the next step, whose tool is run, until it concludes, names no tool, or has taken
    `most_steps`; what was collected then makes a report. An answer that can't be read, or mended where it broke off, is
    asked for once more, and if that can't be read either, the search concludes. A failed call of the model concludes; a tool
    without an output is an error of its step. An article without title and summary ends at once. Keys are unique;
    other columns are left out.
    """
    named = sorted(tools)
    state = articles.select(
        F.col(key).alias("key"), "title", "source", F.col("published_at").cast("string").alias("published_at"), "summary",
        F.lit(0).alias("steps"), F.array().cast(_CALLS).alias("collected"), F.array().cast("array<string>").alias("errors"),
        _none("string").alias("pending"), _none("map<string,string>").alias("pending_input"), F.lit("").alias("thought"),
        _none("string").alias("unread"), _none("string").alias("report"), F.lit("reasoning").alias("node"),
    )
    about = contracts.prompt("Title: {title}\nSource: {source}\nPublished: {at}\n", title=F.col("title"), source=F.col("source"), at=F.col("published_at"))
    summary = lambda most: F.concat(F.lit("Summary: "), F.substring(F.coalesce("summary", F.lit("")), 1, most), F.lit("\n"))
    found = F.concat(F.lit("Collected:\n"), collected_text(F.col("collected")), F.lit("\n"))
    progress = contracts.prompt(f"Step: {{n}} of {most_steps}\nTools: {', '.join(named)}\n", n=F.col("steps"))
    task = F.concat(F.lit("Decide the next step, as JSON with thought, action and action_input; conclude when enough is known.\n"), about, summary(1000), found, progress)

    def decided(said: DataFrame, again: str) -> DataFrame:
        said = _set(said, decision=contracts.search_decision(F.col("answer"), named))
        d, failed = F.col("decision"), F.col("error").isNotNull()
        goes = ~failed & d["readable"] & (d["action"] != "conclude") & (F.col("steps") < most_steps)
        unread = ~failed & ~d["readable"]
        return _set(
            said, errors=_noted("reasoning", F.col("error"), failed), thought=F.coalesce(d["thought"], F.lit("")),
            pending=F.when(goes, d["action"]), pending_input=F.when(goes, d["action_input"]), steps=F.col("steps") + F.when(goes, 1).otherwise(0),
            unread=F.when(unread, F.substring("answer", 1, 4000)), node=F.when(goes, "tools").when(unread, again).otherwise("conclude"),
        )

    def reasoning(rows: DataFrame) -> DataFrame:
        missing = F.col("title").isNull() & F.col("summary").isNull()
        lost = _set(rows.where(missing), errors=_noted("reasoning", F.lit("no article"), F.lit(True)), node=F.lit("end"))
        return decided(_asked(rows.where(~missing), task, provider), "reading").select(*rows.columns).unionByName(lost)

    def reading(rows: DataFrame) -> DataFrame:
        more = F.concat(task, F.lit("Your answer could not be read; give the JSON alone. It was:\n"), F.col("unread"))
        return decided(_asked(rows, more, provider), "conclude")

    def run_tools(rows: DataFrame) -> DataFrame:
        done, given = _run_tools(rows, tools), F.col("output").isNotNull()
        return _set(
            done, collected=F.when(given, F.concat("collected", _call())).otherwise(F.col("collected")),
            errors=_noted("tools", F.concat(F.lit("no output of "), "pending"), ~given), pending=_none("string"), pending_input=_none("map<string,string>"),
            node=F.when(F.col("steps") >= most_steps, "conclude").otherwise("reasoning"),
        )

    def conclude(rows: DataFrame) -> DataFrame:
        said = _asked(rows, F.concat(F.lit("Write the report.\n"), about, summary(1500), found), provider)
        return _set(said, report=F.col("answer"), errors=_noted("conclude", F.col("error"), F.col("error").isNotNull()), node=F.lit("end"))

    # Each step reasons, may be asked again, and runs a tool; the first reasoning and the report come on top.
    out = rounds(state, {"reasoning": reasoning, "reading": reading, "tools": run_tools, "conclude": conclude}, most=3 * most_steps + 4)
    return out.select(F.col("key").alias(key), "steps", "collected", "report", "errors")


def chat(
    messages: DataFrame, provider: Callable[[], Provider], tools: dict[str, Tool], *, key: str = "conv_id", message: str = "message",
    most_research: int = 5, most_failures: int = 3, most_rounds: int = 50,
) -> DataFrame:
    """(key, response, passed, failures, research, collected, path, errors): the answer to one message of each conversation.

    A supervisor sends the turn to the researcher, the explainer or the fact checker until it ends; where the model
    can't be asked, `conversation.route` decides. The researcher thinks and runs tools until it concludes or has done
    `most_research` rounds. A response whose check fails, as any check does that can't be made or read, is
    explained anew, and after `most_failures` failures in a row the turn ends with what there is. A turn that has not
    ended after `most_rounds` comes back with an error. Keys are unique; other columns are left out.
    """
    named = sorted(tools)
    state = messages.select(
        F.col(key).alias("key"), F.col(message).alias("message"), F.lit(0.0).alias("completeness"), _none("string").alias("response"), _none("boolean").alias("passed"),
        F.array().cast("array<string>").alias("issues"), F.lit(0).alias("failures"), F.lit(0).alias("research"), F.array().cast(_CALLS).alias("collected"),
        _none("string").alias("pending"), _none("map<string,string>").alias("pending_input"), F.lit("").alias("thought"),
        F.array().cast("array<string>").alias("path"), F.array().cast("array<string>").alias("errors"), F.lit("supervisor").alias("node"),
    )
    checked = F.when(F.col("passed").isNull(), "none").when(F.col("passed"), "passed").otherwise("failed")
    answered = F.coalesce("response", F.lit("")) != ""
    standing = contracts.prompt(
        "Message: {message}\nCollected: {n}\nResearch: {research}\nResponse: {response}\nCheck: {check}\nFailures: {failures}\n",
        message=F.col("message"), n=F.size("collected"), research=F.col("research"), response=F.when(answered, "yes").otherwise("no"), check=checked, failures=F.col("failures"),
    )
    found = F.concat(F.lit("Found:\n"), collected_text(F.col("collected")), F.lit("\n"))
    failed = F.col("error").isNotNull()
    visited = lambda name: F.array_append("path", F.lit(name))

    def supervisor(rows: DataFrame) -> DataFrame:
        said = _asked(rows, F.concat(F.lit("Route: researcher, explainer, fact_checker or end.\n"), standing), provider)
        step = contracts.supervision(F.col("answer"))
        to = F.when(failed, route(F.col("passed"), F.col("response"), F.col("completeness"), F.col("research"), most_research=most_research)).otherwise(step["route"])
        said = _set(said, to=to, completeness=F.when(failed, F.col("completeness")).otherwise(step["completeness"]))
        node = F.when(F.col("failures") >= most_failures, "end").when(F.col("to") == "researcher", "think").otherwise(F.col("to"))
        return _set(said, node=node, path=visited("supervisor"))

    def think(rows: DataFrame) -> DataFrame:
        said = _asked(rows, F.concat(F.lit(f"Think: use one of {', '.join(named)} or conclude.\n"), standing, found), provider)
        said = _set(said, step=contracts.research_thought(F.col("answer")))
        step = F.col("step")
        goes = ~failed & (step["action"] != "conclude") & (F.col("research") < most_research)
        return _set(
            said, thought=F.when(failed, F.lit("")).otherwise(step["thought"]), errors=_noted("think", F.col("error"), failed), path=visited("think"),
            completeness=F.when(failed | goes, F.col("completeness")).otherwise(0.9), research=F.col("research") + F.when(goes, 0).otherwise(1),
            pending=F.when(goes, step["action"]), pending_input=F.when(goes, step["action_input"]), node=F.when(goes, "tool").otherwise("supervisor"),
        )

    def tool(rows: DataFrame) -> DataFrame:
        done, given = _run_tools(rows, tools), F.col("output").isNotNull()
        why = F.when(F.col("pending").isin(named), "no output of ").otherwise("unknown tool ")
        return _set(
            done, collected=F.when(given, F.concat("collected", _call())).otherwise(F.col("collected")), errors=_noted("tool", F.concat(why, "pending"), ~given),
            pending=_none("string"), pending_input=_none("map<string,string>"), research=F.col("research") + 1, path=visited("tool"), node=F.lit("think"),
        )

    def explainer(rows: DataFrame) -> DataFrame:
        complaints = F.when(F.size("issues") > 0, F.concat(F.lit("Mend: "), F.array_join("issues", "; "), F.lit("\n"))).otherwise("")
        said = _asked(rows, F.concat(F.lit("Explain.\n"), standing, found, complaints), provider)
        sorry = F.concat(F.lit("No answer could be made: "), "error")
        return _set(
            said, response=F.when(failed, sorry).otherwise(F.col("answer")), passed=F.when(failed, F.col("passed")), errors=_noted("explainer", F.col("error"), failed),
            path=visited("explainer"), node=F.lit("supervisor"),
        )

    def fact_checker(rows: DataFrame) -> DataFrame:
        blank = _set(rows.where(~answered), passed=F.lit(False), issues=F.array(F.lit("empty response")))
        said = _asked(rows.where(answered), F.concat(F.lit("Check the response.\n"), standing, found, F.lit("It reads:\n"), F.col("response")), provider)
        check = contracts.fact_check(F.col("answer"))
        said = _set(
            said, passed=~failed & F.coalesce(check["passed"], F.lit(False)),
            issues=F.when(failed, F.array(F.concat(F.lit("no check: "), F.substring("error", 1, 50)))).otherwise(check["issues"]), errors=_noted("fact_checker", F.col("error"), failed),
        )
        both = said.select(*rows.columns).unionByName(blank)
        return _set(both, failures=F.when(F.col("passed"), 0).otherwise(F.col("failures") + 1), path=visited("fact_checker"), node=F.lit("supervisor"))

    steps = {"supervisor": supervisor, "think": think, "tool": tool, "explainer": explainer, "fact_checker": fact_checker}
    out = rounds(state, steps, most=most_rounds)
    late = _noted("chat", F.concat(F.lit(f"no end after {most_rounds} rounds, at "), "node"), F.col("node") != "end")
    return out.select(F.col("key").alias(key), "response", "passed", "failures", "research", "collected", "path", late.alias("errors"))


def reflect(articles: DataFrame, provider: Callable[[], Provider], *, key: str = "id", most: int = 3) -> DataFrame:
    """(key, title, summary, passed, retries, feedback): `articles` (key, original_title, content, title, summary) reflected on.

    In each of at most `most` rounds the format is checked, then, if it holds, the model is asked; where either
    complains, title and summary are written anew with the complaints as feedback. Complaints of the model about the
    format don't count, as its own check has passed. A failed call uses up a round. Every article passes in the
    end, so that none is lost; one without content, title or summary passes at once. Keys are unique; other columns are left out.
    """
    # Prompts hold the contents, so the session of what follows hands few at a time to Python.
    state = small_batches(articles).select(
        F.col(key).alias("key"), "original_title", "content", "title", "summary", F.lit(0).alias("retries"),
        _none("string").alias("feedback"), F.array().cast("array<string>").alias("issues"),
    )
    whole = first_text(F.col("content")).isNotNull() & first_text(F.col("title")).isNotNull() & first_text(F.col("summary")).isNotNull()
    state = state.withColumn("node", F.when(whole, "check").otherwise("end"))
    failed = F.col("error").isNotNull()
    used_up = F.col("retries") + 1 >= most

    def check(rows: DataFrame) -> DataFrame:
        rows = _set(rows, issues=format_issues(F.col("title"), F.col("summary")))
        wrong = _set(rows.where(F.size("issues") > 0), node=F.lit("rewrite"))
        prompt = contracts.prompt(
            "Reflect, as JSON with passed, issues and feedback.\nTitle: {title}\nSummary: {summary}\nOriginal title: {original}\nOriginal:\n{content}",
            title=F.col("title"), summary=F.col("summary"), original=F.col("original_title"), content=F.col("content"),
        )
        said = _asked(rows.where(F.size("issues") == 0), prompt, provider)
        r = contracts.reflection(F.col("answer"))
        said = _set(said, reflected=r)
        about_format = lambda issue: F.exists(F.array(*map(F.lit, FORMAT_WORDS)), lambda w: F.contains(issue, w))
        meant = F.filter(F.col("reflected")["issues"], lambda issue: ~about_format(issue))
        good = ~failed & (F.col("reflected")["passed"] | (F.size(meant) == 0))
        said = _set(
            said, issues=F.when(failed, F.col("issues")).otherwise(meant), feedback=F.when(~good, F.col("feedback")),
            node=F.when(good, "end").when(~failed, "rewrite").when(used_up, "end").otherwise("check"), retries=F.col("retries") + F.when(failed, 1).otherwise(0),
        )
        return said.select(*rows.columns).unionByName(wrong)

    def rewrite(rows: DataFrame) -> DataFrame:
        rows = _set(rows, told=F.concat(F.lit("- "), F.array_join("issues", "\n- ")))
        prompt = contracts.prompt(
            "Translate, as JSON with chinese_title, chinese_summary and entities_preserved.\nAttempt: {n}\nTitle: {title}\nMend:\n{told}\nContent:\n{content}",
            n=F.col("retries") + 1, title=F.col("original_title"), told=F.col("told"), content=F.col("content"),
        )
        said = _set(_asked(rows, prompt, provider), made=contracts.translation(F.col("answer")))
        good = ~failed & (F.col("made")["parser_mode"] != "error")
        return _set(
            said, title=F.when(good, F.col("made")["title"]).otherwise(F.col("title")), summary=F.when(good, F.col("made")["summary"]).otherwise(F.col("summary")),
            feedback=F.when(good, F.col("told")).otherwise(F.col("feedback")), retries=F.col("retries") + 1, node=F.when(used_up, "end").otherwise("check"),
        )

    out = rounds(state, {"check": check, "rewrite": rewrite}, most=2 * most + 1)
    return out.select(F.col("key").alias(key), "title", "summary", F.lit(True).alias("passed"), "retries", "feedback")
