"""The ordered rules that give a catalog entry its type, observability and sensitivity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.text import any_of


@dataclass(frozen=True)
class Rule:
    """A branch: patterns on the lower-case name, and what holds where one of them is found."""

    kind: str
    sensitivity: str
    definition: str  # before the quoted name
    reason: str
    patterns: tuple[str, ...] = ()
    substrings: tuple[str, ...] = ()


#: Patterns, texts and words of all branches, in the order in which they are tried.
RULES = (
    Rule("esoteric_spiritual", "sensitive_personal", "Esoteric/spiritual practice or belief metric: ", "Esoteric, ritual, or spiritual metric not objectively evaluable from standard dialogue text.",
         (r"i ching", r"hexagram", r"astrology", r"rising sign", r"sufi", r"quran", r"bahá", r"bah[aá]", r"reiki", r"gnostic", r"jewish", r"sukkot", r"hindu", r"yoga", r"vrata", r"bhagavad-gita", r"zohar", r"seerah", r"sikh", r"kirtan", r"tiferet", r"channeling", r"shabbat", r"dhikr", r"aura-color", r"satya", r"holiness", r"pilgrimage", r"spiritual")),
    Rule("medical_biomarker", "clinical_medical", "Medical, biological, or physiological biomarker: ", "Requires biological, laboratory, or physiological measurement; unobservable from text.",
         (r"\blevel\b", r"\bhormone\b", r"basophil count", r"blood count", r"cell count", r"\bgene\b", r"\bpolygenic\b", r"\bdiagnosis\b", r"\bmacronutrient\b", r"\bapnea\b", r"\bmetabolic\b", r"\bserotonin\b", r"\bimmune-response\b", r"\bfsh\b", r"\bparathyroid\b", r"\bchromatin\b", r"chronic pain", r"caffeine sensitivity")),
    Rule("external_biographical", "sensitive_personal", "Objective historical, lifestyle, or biographical tracking metric: ", "Requires objective external tracking, sensor data, or historical log verification.",
         (r"hours/week", r"km/week", r"time/day", r"time outdoors", r"sessions / year", r"sessions/year", r"cycles per year", r"months", r"stamps", r"subscriber", r"contributions", r"visits/year", r"years", r"%\b", r"commute", r"snacking", r"dietary", r"transport", r"security-system", r"food sourcing", r"passport", r"drug-use history", r"cloud-backup", r"peer-to-peer", r"open-source", r"museum visits", r"choir participation", r"pet-enrichment", r"dance rehearsal", r"robotics-interaction", r"public-transport", r"caffeine intake", r"wake-time consistency", r"count\b", r"frequency\b", r"hours\b")),
    Rule("cognitive_skill_test", "medium", "Standardized cognitive or psychomotor test metric: ", "Requires a standardized psychometric testing task or timed cognitive exam.",
         (r"numerical reasoning", r"spatial perception", r"alphanumeric", r"psychomotor", r"working memory", r"executive-function", r"iq\b", r"intelligence quotient", r"mental arithmetic", r"spelling accuracy", r"sequential memory", r"auditory memory", r"divided attention", r"material properties", r"anatomy knowledge", r"numeric filing", r"alphabetical filing")),
    Rule("psychological_trait", "high", "Clinical psychometric construct: ", "Clinical diagnostic construct requiring accredited psychiatric/psychometric clinical evaluation.",
         (r"depression", r"hypomania", r"hysteria", r"psychoticism", r"neuroticism", r"burnout", r"identity diffusion", r"ego dissolution", r"physical-violence exposure", r"introjection", r"acculturative stress", r"operant-learning")),
    Rule("external_biographical", "sensitive_personal", "External demographic or environment parameter: ", "External environment or historical parameter not directly observable from conversation.",
         substrings=(" nationality", "ratio:", "temperature", "presence", "frequency", "count", "hours")),
)
HOSTILE = ("hostility", "rebelliousness", "dishonesty", "impudence", "hatefulness")
BLANK = ("malformed_invalid", "low", "Malformed or empty facet record.", "Empty or non-string facet entry.")
HEADER = ("header_label", "low", ("Category header label: '", "'. Not an evaluable individual facet."), "Category header or structural section label, not an individual scoreable trait.")
TRAIT = ("Evaluates conversational text for evidence of '", "' based on language style, tone, expressed sentiment, and interpersonal posture.")
ANCHOR_HIGH = ("Demonstrates clear, consistent evidence of high ", " through explicit statements, tone, or interaction pattern.")
ANCHOR_LOW = ("Demonstrates explicit evidence of low ", " or opposing behavioral tendencies in dialogue.")


def json_string(c: Column) -> Column:
    r"""The text as a JSON string with characters beyond ASCII as \uXXXX (of the basic plane)."""
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    chars = F.transform(F.split(plain, ""), lambda x: F.when(x.rlike(r"^[\x20-\x7E]$"), x).when(x == "", x).otherwise(F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(x))), 4, "0"))))
    return F.concat(F.lit('"'), F.when(plain.rlike(r"^[\x20-\x7E]*$"), plain).otherwise(F.array_join(chars, "")), F.lit('"'))


def classify(name: Column, blank: Column, header: Column) -> Column:
    """Struct of facet_type, conversation_observable, sensitivity, scoring_definition, scoring_anchors, abstention_reason."""
    low, none = F.lower(name), F.lit(None).cast("string")

    def branch(kind: str, observable: bool, sensitivity, definition: Column, anchors: Column, reason: Column) -> Column:
        return F.struct(F.lit(kind).alias("facet_type"), F.lit(observable).alias("conversation_observable"), (F.lit(sensitivity) if isinstance(sensitivity, str) else sensitivity).alias("sensitivity"), definition.alias("scoring_definition"), anchors.alias("scoring_anchors"), reason.alias("abstention_reason"))

    quoted = lambda start, end: F.concat(F.lit(start), name, F.lit(end))
    anchors = F.concat(F.lit('{"high": '), json_string(quoted(*ANCHOR_HIGH)), F.lit(', "low": '), json_string(quoted(*ANCHOR_LOW)), F.lit("}"))
    out = branch("conversational_trait", True, F.when(any_of(low, list(HOSTILE)), "medium").otherwise("low"), quoted(*TRAIT), anchors, none)
    for rule in reversed(RULES):
        found = low.rlike("|".join(rule.patterns)) if rule.patterns else any_of(low, list(rule.substrings))
        out = F.when(found, branch(rule.kind, False, rule.sensitivity, quoted(rule.definition + "'", "'."), none, F.lit(rule.reason))).otherwise(out)
    out = F.when(header, branch(HEADER[0], False, HEADER[1], quoted(*HEADER[2]), none, F.lit(HEADER[3]))).otherwise(out)
    return F.when(blank, branch(BLANK[0], False, BLANK[1], F.lit(BLANK[2]), none, F.lit(BLANK[3]))).otherwise(out)
