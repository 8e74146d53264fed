"""Models of the registered queries and tests: plain rules that answer in the form of a model. No part of the library."""

from __future__ import annotations

import json
import re

# A sentence the rule-based stand-in understands: [[A]] relation words [[B]].
_SENTENCE = re.compile(r"\[\[([^|\]]+)\]\] (works at|advises|partners with) \[\[([^|\]]+)\]\]")


def rule_based_model(texts: list[str]) -> list[str]:
    """Deterministic stand-in for a model: reads plain link sentences, answers like a model does."""
    answers = []
    for text in texts:
        rows = [
            {
                "source_category": "Company" if source[:1].isupper() else "Person",
                "source_label": source,
                "relationship": relation.replace(" ", "_"),
                "target_category": "Company",
                "target_label": target,
            }
            for source, relation, target in _SENTENCE.findall(text)
        ]
        answers.append("```json\n" + json.dumps({"relationships": rows}) + "\n```")
    return answers


_NOTE_PART = re.compile(r"=== NOTE ===\n(.*)\n=== END ===", re.DOTALL)
_SINGLE_KIND = re.compile(r"^Output format: (\w+)$", re.MULTILINE)
_MULTI_TAG = re.compile(r"^- (.+?): .* \(type: (\w+)\)$", re.MULTILINE)


def rule_based_classifier(prompts: list[str]) -> list[str]:
    """Deterministic stand-in for a classification model: length, a word, and the last line of a note."""
    answers = []
    for prompt in prompts:
        note = _NOTE_PART.search(prompt).group(1)
        values = {"number": len(note), "boolean": " the " in note, "list": note.split("\n")[-1], "text": note.split("\n")[-1]}
        kind = _SINGLE_KIND.search(prompt)
        if kind:
            answers.append(str(values[kind.group(1)]))
        else:
            tags = _MULTI_TAG.findall(prompt[prompt.rindex("=== END ===") :])
            answers.append(json.dumps({"results": {tag: values[kind] for tag, kind in tags}}))
    return answers
