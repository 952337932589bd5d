"""Providers whose answers follow from the numbers in a prompt, so that SQL can say what a loop comes to."""

from __future__ import annotations

import json
import re


def _number(prompt: str, name: str) -> int:
    return int(re.search(rf"^{name}: \D*(\d+)", prompt, re.MULTILINE)[1])


class Searcher:
    """Searches until a document's number says so; some calls fail, some answers break off or can't be read."""

    def complete(self, prompt: str) -> str:
        doc = _number(prompt, "Title")
        if prompt.startswith("Write the report"):
            if doc % 13 == 5:
                raise OSError("no report")
            return f"doc {doc}: {len(re.findall(r'^[0-9]+[.] .(?:source|language)_size. ', prompt, re.MULTILINE))} findings"
        step = _number(prompt, "Step")
        if doc % 11 == 3 and step == 2:
            raise OSError("down")
        if "could not be read" in prompt:
            return json.dumps({"thought": "enough", "action": "conclude"}) if doc % 2 else "still nothing"
        if doc % 7 == 2 and step == 1:
            return '{"thought": "broken'
        if step >= doc % 9:
            return 'Done: {"thought": "enough", "action": "conclude"}'
        action = ("source_size", "language_size", "nowhere")[(doc + step) % 3 if doc % 4 else step % 2]
        return json.dumps({"thought": "more", "action": action, "action_input": {"doc": str(doc)}})[: -1 if step % 2 else None]


class Talker:
    """A supervisor, researcher, explainer and checker that go by a conversation's number."""

    def complete(self, prompt: str) -> str:
        conv, n = _number(prompt, "Message"), _number(prompt, "Collected")
        said, check = re.search(r"^Response: (\w+)\nCheck: (\w+)", prompt, re.MULTILINE).groups()
        if prompt.startswith("Route"):
            if conv % 3 == 0:
                raise OSError("no supervisor")
            to = "researcher" if n < conv % 4 and _number(prompt, "Research") < 5 else "explainer" if said == "no" or check == "failed" else "fact_checker" if check == "none" else "end"
            return json.dumps({"route": to, "info_completeness": 0.5}) if conv % 3 == 1 else f"go to the {to}" if to != "fact_checker" else "look at the facts"
        if prompt.startswith("Think"):
            if conv % 5 == 0 and n == 1:
                raise OSError("no thought")
            if n >= conv % 7:
                return json.dumps({"thought": "enough", "action": "conclude"})
            return json.dumps({"thought": "more", "action": "nothing" if (conv + n) % 4 == 3 else "turns", "action_input": {"n": str(n)}})
        if prompt.startswith("Explain"):
            if conv % 17 == 4:
                raise OSError("no words")
            return f"answer {_number(prompt, 'Failures') + 1}"
        return json.dumps({"passed": _number(prompt, "Failures") >= conv % 5, "issues": ["thin"]})


class Editor:
    """Reflects on and rewrites articles by their number and the revision in their title."""

    def complete(self, prompt: str) -> str:
        doc = _number(prompt, "Title")
        if prompt.startswith("Reflect"):
            if doc % 7 == 3:
                raise OSError("no reflection")
            revision = int(re.search(r"^Title: .* r(\d+)$", prompt, re.MULTILINE)[1])
            if doc % 4 == 1:
                return json.dumps({"passed": revision >= 2, "issues": ["tone", "段落"] if revision < 2 else [], "feedback": "x"})
            return "I can't say" if doc % 4 == 3 else json.dumps({"passed": doc % 4 == 0, "issues": ["标题格式"]})
        if doc % 5 == 0:
            raise OSError("no translation")
        title = f"doc {doc} r{_number(prompt, 'Attempt')}"
        return json.dumps({"chinese_title": title if doc % 3 == 0 else f"[AI] {title}", "chinese_summary": "one\n\n· two\n\n主编洞察：three"}, ensure_ascii=False)


class Rememberer:
    """Extracts memories by a conversation's number: fails, says nothing to be read, or gives one or both kinds."""

    def complete(self, prompt: str) -> str:
        conv = _number(prompt, "Conversation")
        if conv % 4 == 0:
            raise OSError("down")
        lines = len(re.findall(r"^\[(?:user|assistant|system)\]: ", prompt, re.MULTILINE))
        given = {"user_profile": {"expertise_level": f"level {lines}"}, "conversation_state": {"current_topic": f"topic {conv}"} if conv % 4 == 3 else {}}
        return "nothing {to read}" if conv % 4 == 1 else "So: " + json.dumps(given) + " as asked"


class Ranker:
    """Scores texts by their length, in no order of replies; some queries can't be asked."""

    def rerank(self, query: str, texts: list[str]) -> list[tuple[int, float]]:
        if len(texts) > 10 or int(query.split()[1]) % 7 == 3:
            raise OSError("no ranking")
        return [(i, float(len(t) % 97)) for i, t in reversed(list(enumerate(texts)))]
