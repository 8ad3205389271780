"""A stand-in for a language model, by which queries and tests of judged scores have fixed results."""

from __future__ import annotations

import json
import re

from gaugeworks.operators.judged import check_messages


class RuleClient:
    """A deterministic judge for tests: texts split at '. ', an item is yes if its length is even, a summary gets 1 to 5 by its length."""

    model_name = "rules"

    def __call__(self, messages: list[dict]) -> str:
        check_messages(messages)
        prompt = messages[-1]["content"]
        if prompt.startswith("How coherent"):
            return f"I say {len(prompt.split('SUMMARY:\n', 1)[1]) % 5 + 1}."
        if prompt.startswith("Sort statements"):
            wanted, told = (json.loads(x) for x in re.search(r"EXPECTED:\n(.*)\n\nANSWER:\n(.*)", prompt).groups())
            return "Here: " + json.dumps({"TP": [x for x in told if x in wanted], "FP": [x for x in told if x not in wanted], "FN": [x for x in wanted if x not in told]})
        if "ITEMS:\n" in prompt:
            items = json.loads(prompt.rsplit("ITEMS:\n", 1)[1])
            return json.dumps({"verdicts": [{"verdict": "no" if len(x) % 2 else "yes", "analysis": "its length"} for x in items]})
        kind = re.search(r'\{"(\w+)":', prompt).group(1)
        return json.dumps({kind: [x for x in prompt.split("TEXT:\n", 1)[1].split(". ") if x]})
