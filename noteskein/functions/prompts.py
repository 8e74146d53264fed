"""Prompts and size estimates as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from noteskein.functions import fixed
from noteskein.functions.text import py_strip

# Fixed wording around the parts that vary.
_SINGLE_SYSTEM = (
    "You are a classification assistant.\nAnalyze the note and extract the requested information.\n\nOutput format: ",
    "\n",
    "\n\nReturn ONLY the result, no explanation, no quotes around the result.",
)
_MULTI_SYSTEM = (
    "You are a classification assistant.\nAnalyze the note and extract multiple pieces of information.\n\n"
    "You must return a JSON object with the following structure:\n",
    "\n\nOutput format rules:\n",
    "\n\nReturn ONLY valid JSON, no explanation, no markdown code blocks.",
)
_NOTE_OPEN, _NOTE_CLOSE = "\n\n=== NOTE ===\n", "\n=== END ==="
_MULTI_ASK = "\n\nExtract the following information:\n"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def single_system(output_type: Column) -> Column:
    start, middle, end = _SINGLE_SYSTEM
    return F.concat(F.lit(start), output_type, F.lit(middle), _lookup(fixed.SINGLE_INSTRUCTIONS, output_type), F.lit(end))


def single_user(prompt: Column, body: Column) -> Column:
    return F.concat(prompt, F.lit(_NOTE_OPEN), body, F.lit(_NOTE_CLOSE))


def json_example(tags: Column) -> Column:
    lines = F.transform(
        tags,
        lambda t: F.concat(F.lit('        "'), t["tag"], F.lit('": '), _lookup(fixed.EXAMPLE_VALUES, t["output_type"])),
    )
    return F.concat(F.lit('{\n    "results": {\n'), F.array_join(lines, ",\n"), F.lit("\n    }\n}"))


def multi_system(tags: Column) -> Column:
    start, middle, end = _MULTI_SYSTEM
    rules = F.transform(
        tags, lambda t: F.concat(F.lit("- "), t["tag"], F.lit(": "), _lookup(fixed.MULTI_INSTRUCTIONS, t["output_type"]))
    )
    return F.concat(F.lit(start), json_example(tags), F.lit(middle), F.array_join(rules, "\n"), F.lit(end))


def multi_user(prompt: Column, body: Column, tags: Column) -> Column:
    filled = lambda c: F.nullif(c, F.lit(""))
    asks = F.transform(
        tags,
        lambda t: F.concat(
            F.lit("- "), t["tag"], F.lit(": "),
            F.coalesce(filled(t["description"]), filled(t["name"]), t["tag"]),
            F.lit(" (type: "), t["output_type"], F.lit(")"),
        ),
    )
    return F.concat(prompt, F.lit(_NOTE_OPEN), body, F.lit(_NOTE_CLOSE), F.lit(_MULTI_ASK), F.array_join(asks, "\n"))


def labelled_message(role: Column, text: Column) -> Column:
    """One message with its role in front; other roles are left out (NULL)."""
    return F.concat(_lookup(fixed.ROLE_LABELS, role), F.lit(": "), text)


def estimated_tokens(n_chars: Column) -> Column:
    return F.floor(n_chars / 4).cast("bigint")


def context_window(model: Column, windows: dict[str, int] | None = None, default: int = fixed.DEFAULT_CONTEXT_WINDOW) -> Column:
    name = F.lower(model)
    chosen = None
    for part, size in (windows or fixed.CONTEXT_WINDOWS).items():
        test = F.contains(name, F.lit(part))
        chosen = F.when(test, F.lit(size)) if chosen is None else chosen.when(test, F.lit(size))
    return chosen.otherwise(F.lit(default))


def context_band(tokens: Column, window: Column) -> Column:
    """How full the context window is: ``ok``, above 80 %, above 90 %."""
    return F.when(tokens > window * F.lit(0.9), "critical").when(tokens > window * F.lit(0.8), "large").otherwise("ok")


def combined_prompt(messages: Column) -> Column:
    """System texts first, then user texts, from an ordered array of ``role, text``."""
    def of(role: str) -> Column:
        texts = F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: F.concat(m["text"], F.lit("\n\n")))
        return F.array_join(texts, "")

    return py_strip(F.concat(of("system"), of("user")))
