"""Model responses: clean the text, read the JSON, keep what is usable."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from noteskein.functions import fixed
from noteskein.functions.text import let, py_strip

TRIPLE_FIELDS = ["source_category", "source_label", "relationship", "target_category", "target_label"]
TRIPLE_LIST = "array<struct<" + ",".join(f"{f}:string" for f in TRIPLE_FIELDS) + ">>"
RELATION_LIST = (
    "array<struct<source:string,target:string,relationship:string,source_category:string,target_category:string>>"
)


def _fenced(text: Column, fence: str) -> Column:
    """Text inside the first fence, or the whole text when the fence is not closed."""
    rest = F.substr(text, F.instr(text, fence) + len(fence))
    return let(
        rest,
        lambda r: F.when(F.contains(r, F.lit("```")), py_strip(F.substring_index(r, "```", 1))).otherwise(text),
    )


def outer_object(text: Column) -> Column:
    """From the first opening to the last closing brace; NULL without such a pair."""
    return let(text, _outer_object)


def _outer_object(text: Column) -> Column:
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when(
        (start > 0) & F.contains(text, F.lit("}")) & (end > start), F.substr(text, start, end - start + 1)
    )


def _out_of_fence(text: Column) -> Column:
    return (
        F.when(F.contains(text, F.lit("```json")), _fenced(text, "```json"))
        .when(F.contains(text, F.lit("```")), _fenced(text, "```"))
        .otherwise(text)
    )


def clean_response(text: Column) -> Column:
    """JSON object of a response: out of its code fence, without text around, no trailing commas."""
    def without_commas(inner: Column) -> Column:
        return F.coalesce(F.regexp_replace(outer_object(inner), r"(?U),(\s*[}\]])", "$1"), inner)

    return let(text, lambda t: let(py_strip(_out_of_fence(t)), without_commas))


def strip_reasoning(text: Column) -> Column:
    """Answer after the reasoning part; text around a JSON object is dropped too."""
    answer = F.when(F.contains(text, F.lit("</think>")), py_strip(F.substring_index(text, "</think>", -1))).otherwise(text)
    return let(
        answer, lambda a: F.when(F.startswith(a, F.lit("{")), a).otherwise(F.coalesce(outer_object(a), a))
    )


def answer_or_reasoning(content: Column, thinking: Column) -> Column:
    """The answer, or the last JSON object of the reasoning when the answer is empty."""
    start = F.length(thinking) - F.instr(F.reverse(thinking), "{") + 1
    end = F.length(thinking) - F.instr(F.reverse(thinking), "}") + 1
    has_both = F.contains(thinking, F.lit("{")) & F.contains(thinking, F.lit("}")) & (end > start)
    from_thinking = F.when(has_both, F.substr(thinking, start, end - start + 1)).otherwise(F.lit(""))
    return F.when(F.length(content) > 0, content).otherwise(F.coalesce(from_thinking, F.lit("")))


def _field(item: Column, name: str) -> Column:
    """Field of a JSON object as text, only where it is a JSON string."""
    value = F.try_variant_get(item, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(item, f"$.{name}", "string"))


def read_triples(cleaned: Column) -> Column:
    """Triples of a cleaned response.

    When every item has all five fields as strings, all items count, empty strings included.
    Otherwise only items whose five fields are non-empty strings are saved. NULL when the text is
    not a JSON object with a list.
    """
    parsed = F.try_parse_json(cleaned)
    items = F.try_variant_get(parsed, "$.relationships", "array<variant>")
    rows = F.transform(items, lambda i: F.struct(*[_field(i, f).alias(f) for f in TRIPLE_FIELDS]))

    def complete(row: Column) -> Column:
        test = row[TRIPLE_FIELDS[0]].isNotNull()
        for name in TRIPLE_FIELDS[1:]:
            test = test & row[name].isNotNull()
        return test

    def filled(row: Column) -> Column:
        test = F.length(row[TRIPLE_FIELDS[0]]) > 0
        for name in TRIPLE_FIELDS[1:]:
            test = test & (F.length(row[name]) > 0)
        return F.coalesce(test, F.lit(False))

    return let(rows, lambda r: F.when(F.forall(r, complete), r).otherwise(F.filter(r, filled)))


def diagnose(cleaned: Column) -> Column:
    """Number of closed triple objects, place of the first bad one (from 1), and an open one at the end."""
    objects = F.regexp_extract_all(cleaned, F.lit(r'\{[^{}]*"source_category"[^{}]*\}'), F.lit(0))

    def bad(text: Column) -> Column:
        parsed = F.try_parse_json(text)
        test = parsed.isNull()
        for name in TRIPLE_FIELDS:
            value = F.try_variant_get(parsed, f"$.{name}", "string")
            test = test | value.isNull() | (F.length(value) == 0) | value.isin("0", "false")
        return test

    flags = F.transform(objects, bad)
    return let(
        flags,
        lambda f: F.struct(
            F.size(f).alias("n_objects"),
            F.nullif(F.array_position(f, F.lit(True)), F.lit(0).cast("bigint")).alias("first_invalid"),
            cleaned.rlike(r'\{[^{}]*"source_category"[^}]*\z').alias("truncated"),
        ),
    )


def graph_relations(text: Column) -> Column:
    """Relations of a ``nodes``/``edges`` object: ends by node name, missing types filled in."""
    parsed = F.from_json(
        text,
        "nodes array<struct<id:string,name:string,type:string>>, edges array<struct<source:string,target:string,type:string>>",
    )
    no_nodes = F.array().cast("array<struct<id:string,name:string,type:string>>")

    def by_id(nodes: Column) -> Column:
        """Name and type by id; the last node of an id counts. Made once for all edges."""
        ids = F.transform(nodes, lambda n: F.coalesce(n["id"], F.lit("")))
        places = F.transform(ids, lambda i, k: F.struct(i.alias("id"), k.alias("at")))

        def ends(ordered: Column) -> Column:
            # In order of id and place, a place counts where the next one has another id.
            marked = F.transform(ordered, lambda p, k: F.struct(p.alias("p"), F.get(ordered, k + 1)["id"].alias("next")))
            kept = F.filter(marked, lambda x: ~x["p"]["id"].eqNullSafe(x["next"]))
            return F.transform(kept, lambda x: F.struct(x["p"]["id"].alias("key"), F.get(nodes, x["p"]["at"]).alias("value")))

        return F.map_from_entries(let(F.array_sort(places), ends))

    def relation(edge: Column, known: Column) -> Column:
        source, target = F.coalesce(edge["source"], F.lit("")), F.coalesce(edge["target"], F.lit(""))
        node = lambda name: F.try_element_at(known, name)
        return F.struct(
            F.coalesce(node(source)["name"], source).alias("source"),
            F.coalesce(node(target)["name"], target).alias("target"),
            F.coalesce(edge["type"], F.lit("RELATED_TO")).alias("relationship"),
            F.coalesce(node(source)["type"], F.lit("Unknown")).alias("source_category"),
            F.coalesce(node(target)["type"], F.lit("Unknown")).alias("target_category"),
        )

    return let(
        parsed, lambda p: let(by_id(F.coalesce(p["nodes"], no_nodes)), lambda known: F.transform(p["edges"], lambda e: relation(e, known)))
    )


_ITEM_FIELDS = [
    "source", "source_label", "person", "person1", "company1", "target", "target_label", "company", "institution",
    "person2", "partner", "relationship", "relation", "role", "source_category", "target_category",
]
_SECTION_ITEM = "struct<" + ",".join(f"{f}:string" for f in _ITEM_FIELDS) + ">"
_SECTIONS = ", ".join(f"{s} array<{_SECTION_ITEM}>" for s in fixed.STRUCTURED_SECTIONS)


def _first_filled(item: Column, names: list[str]) -> Column:
    return F.coalesce(*[F.nullif(item[n], F.lit("")) for n in names])


def structured_relations(text: Column) -> Column:
    """Relations of an object with one list per section; the first filled field name counts."""
    parsed = F.from_json(text, _SECTIONS)

    def relation(item: Column) -> Column:
        source = _first_filled(item, ["source", "source_label", "person", "company1"])
        target = _first_filled(item, ["target", "target_label", "company", "institution"])
        return F.when(
            source.isNotNull() & target.isNotNull(),
            F.struct(
                source.alias("source"),
                target.alias("target"),
                F.coalesce(_first_filled(item, ["relationship", "relation", "role"]), F.lit("related_to")).alias("relationship"),
                F.coalesce(item["source_category"], F.lit("Unknown")).alias("source_category"),
                F.coalesce(item["target_category"], F.lit("Unknown")).alias("target_category"),
            ),
        )

    empty = F.array().cast(RELATION_LIST)
    def all_sections(p: Column) -> Column:
        return F.concat(*[F.coalesce(F.transform(p[s], relation), empty) for s in fixed.STRUCTURED_SECTIONS])

    return F.array_compact(let(parsed, all_sections))


# Fields of the two ends per section, and the relation: a field to read, or a fixed name.
SECTION_FORMS = {
    "professional": [("person", "company", "role", None), ("person", "institution", "role", None)],
    "personal": [("person1", "person2", "relation", None)],
    "business_partnerships": [("company1", "partner", None, "partners_with")],
    "educational_background": [("person", "institution", None, "graduated_from")],
    "previous_employment": [("person", "company", None, "previously_worked_at")],
    "advisory_roles": [("person", "company", None, "advises")],
}


def section_relations(text: Column) -> Column:
    """Relations of the same object by the field names each section uses, with one relation form."""
    parsed = F.from_json(text, _SECTIONS)
    kind = "array<struct<source:string,target:string,relationship:string>>"

    def of_section(p: Column, section: str, forms: list) -> Column:
        def relation(item: Column) -> Column:
            found = None
            for source, target, field, name in forms:
                test = item[source].isNotNull() & item[target].isNotNull()
                text_form = F.replace(F.lower(F.coalesce(item[field], F.lit(""))), F.lit(" "), F.lit("_")) if field else F.lit(name)
                row = F.struct(item[source].alias("source"), item[target].alias("target"), text_form.alias("relationship"))
                found = F.when(test, row) if found is None else found.when(test, row)
            return found

        return F.coalesce(F.transform(p[section], relation), F.array().cast(kind))

    return F.array_compact(
        let(parsed, lambda p: F.concat(*[of_section(p, s, forms) for s, forms in SECTION_FORMS.items()]))
    )


def parse_typed(raw: Column, output_type: Column) -> Column:
    """A result in its declared type; one field of the struct is filled, numbers fall back to 0."""
    return let(py_strip(raw), lambda text: let(_unquoted(text), lambda bare: _typed(bare, output_type)))


def _unquoted(text: Column) -> Column:
    quoted = (F.startswith(text, F.lit('"')) & F.endswith(text, F.lit('"'))) | (
        F.startswith(text, F.lit("'")) & F.endswith(text, F.lit("'"))
    )
    return F.when(quoted, F.substr(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))).otherwise(text)


def _typed(bare: Column, output_type: Column) -> Column:
    number = py_strip(bare)
    whole = number.rlike(r"^[+-]?\d+\z")
    real = F.contains(bare, F.lit(".")) & number.rlike(r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?\z")
    is_number = output_type == "number"
    return F.struct(
        F.when(output_type.isin("list", "text"), bare).alias("text_value"),
        F.when(output_type == "boolean", F.lower(bare).isin(fixed.TRUE_WORDS)).alias("bool_value"),
        F.when(is_number & ~real, F.when(whole, F.coalesce(number.try_cast("bigint"), F.lit(0).cast("bigint")))
               .otherwise(F.lit(0).cast("bigint"))).alias("int_value"),
        F.when(is_number & real, number.try_cast("double")).alias("float_value"),
    )


def _result_text(value: Column) -> Column:
    """Text of one JSON result: lists joined with a comma, booleans and numbers as they read."""
    as_list = F.try_variant_get(value, "$", "array<string>")
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")), F.array_join(as_list, ", ")).otherwise(
        F.try_variant_get(value, "$", "string")
    )


def read_results(raw: Column) -> Column:
    """Map of tag to text under ``results``; NULL when the response is no JSON object."""
    parsed = F.coalesce(F.try_parse_json(raw), F.try_parse_json(_out_of_fence(py_strip(raw))))
    empty = F.create_map().cast("map<string,string>")

    def results(p: Column) -> Column:
        values = F.try_variant_get(p, "$.results", "map<string,variant>")
        is_object = F.startswith(F.schema_of_variant(p), F.lit("OBJECT"))
        return F.when(is_object, F.coalesce(F.transform_values(values, lambda k, v: _result_text(v)), empty))

    return let(parsed, results)


def missing_tags(results: Column, expected: Column) -> Column:
    return F.array_except(expected, F.map_keys(results))


def results_error(raw: Column, results: Column, expected: Column) -> Column:
    """Why a response of a task with several tags is not usable, or NULL."""
    missing = missing_tags(results, expected)
    return (
        F.when(raw.isNull() | (F.length(py_strip(raw)) == 0), F.lit("Empty response"))
        .when(results.isNull(), F.lit("Invalid JSON response"))
        .when(F.size(missing) > 0, F.concat(F.lit("Missing tags in response: "), F.array_join(missing, ", ")))
    )
