"""Lists, tables and formats whose content decides the results."""

# Characters removed at both ends of a text when it is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Entity categories that may appear at either end of a triple.
CATEGORIES = ["Person", "Company"]

# Relation text after a company-to-person triple is turned around.
INVERSE_RELATIONS = {
    "hires": "works_at",
    "employs": "works_at",
    "manages": "reports_to",
    "supervises": "reports_to",
    "leads": "reports_to",
    "acquires": "acquired_by",
    "purchases": "purchased_by",
    "buys": "sold_to",
}

# Edge type for each pair of categories.
EDGE_TYPES = {
    ("Person", "Person"): "PERSON_TO_PERSON",
    ("Person", "Company"): "PERSON_TO_COMPANY",
    ("Company", "Company"): "COMPANY_TO_COMPANY",
    ("Company", "Person"): "COMPANY_TO_PERSON",
}

# Path keywords and the entity type each rule adds, in rule order.
PATH_TYPE_RULES = [
    ("Person", ["people", "person"]),
    ("VC", ["vc"]),
    ("Company", ["company", "companies", "org", "organization"]),
    ("Family Office", ["family office", "family", "families"]),
]

# Note types that call for an entity of the category.
TYPES_NEEDING_ENTITY = {
    "Person": ["Person"],
    "Company": ["Company", "Family Office", "VC"],
}

# Texts that are never a key, in any letter case.
INVALID_KEYS = ["", "null", "none"]

# Frontmatter keys that are not metadata.
SYSTEM_KEYS = ["resolves", "entity_resolution"]

# Headings that open a metadata section; the last one counts for pairs only.
SECTION_HEADINGS = ["Metadata", "Properties", "Info"]
PAIR_HEADINGS = ["Metadata", "Properties", "Info", "Additional Info"]

# Link to another note, with or without a display text.
WIKILINK = r"\[\[([^|\]]+)(?:\|[^\]]+)?\]\]"

# Task state names and file state names.
RUN_STATES = ["completed", "failed", "running", "pending"]
CHANGE_TYPES = ["created", "modified", "moved", "deleted", "renamed"]

# Texts read as true.
TRUE_WORDS = ["true", "yes", "1"]

# Output instructions per result type: one tag per task, and many tags per task.
SINGLE_INSTRUCTIONS = {
    "list": 'Return a comma-separated list. Example: "item1, item2, item3". Return empty string if nothing found.',
    "text": "Return a single text string. Return empty string if nothing found.",
    "boolean": 'Return exactly "true" or "false".',
    "number": "Return a single number. Return 0 if cannot determine.",
}
MULTI_INSTRUCTIONS = {
    "list": 'Comma-separated list (e.g., "item1, item2, item3"). Return empty string if nothing found.',
    "text": "Text string. Return empty string if nothing found.",
    "boolean": 'Exactly "true" or "false".',
    "number": "Number. Return 0 if cannot determine.",
}
EXAMPLE_VALUES = {"list": '"item1, item2"', "text": '"text value"', "boolean": "true", "number": "42"}

# Label in front of a message, by role.
ROLE_LABELS = {"system": "System", "user": "User", "assistant": "Assistant"}

# Context window in tokens by part of the model name, and for any other model.
CONTEXT_WINDOWS = {"qwen3": 32768, "qwen-3": 32768}
DEFAULT_CONTEXT_WINDOW = 8192

# Sections of a structured answer that hold relations.
STRUCTURED_SECTIONS = [
    "professional",
    "personal",
    "business_partnerships",
    "educational_background",
    "previous_employment",
    "advisory_roles",
]

# Relation names that count as the same.
RELATION_VARIANTS = {
    "worksat": ["works_at", "employed_at", "works_for"],
    "marriedto": ["married_to", "is_married_to", "has_been_married_to"],
    "partnerswith": ["partners_with", "partnership_with"],
    "graduatedfrom": ["graduated_from", "studied_at", "educated_at"],
    "locatedin": ["located_in", "is_located_in", "based_in"],
    "ceoof": ["ceo_of", "is_ceo_of", "chief_executive_officer_of"],
    "ctoof": ["cto_of", "is_cto_of", "chief_technology_officer_of"],
    "csoof": ["cso_of", "is_cso_of", "chief_scientific_officer_of", "is_cs_of"],
    "professorat": ["professor_at", "is_professor_at", "teaches_at"],
    "researcherat": ["researcher_at", "is_researcher_at", "researches_at"],
    "cofoundedwith": ["co_founded_with", "cofounded_with", "founded_with", "co_founded"],
    "friendof": ["friend_of", "is_friend_of", "friends_with"],
    "collaborateswith": ["collaborates_with", "collaborates", "works_with"],
    "previouslyworkedat": ["previously_worked_at", "worked_at", "was_employed_at", "previous_employment"],
    "advises": ["advises", "is_advisor_to", "advisor_of", "advised"],
    "vpproductat": ["vp_product_at", "is_vp_of_product_at", "vice_president_of_product_at"],
}

# Row cap of a graph result without a limit, paging bounds, quiet period of a vault,
# retention of deleted tracking rows, semantic chunk bounds.
DEFAULT_RESULT_ROWS = 20000
MAX_SKIP = 10000
WARN_SKIP = 5000
QUIET_SECONDS = 60
RETENTION_DAYS = 30
SIMILARITY_THRESHOLD = 0.75
CHUNK_TOKENS = 1024
