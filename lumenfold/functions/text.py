"""Column functions that clean, tokenize and template text. None is a UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that come joined.
JOINED_NAMES = {"SelfEsteem": "Self Esteem", "HonestyHumility": "Honesty Humility", "Selfcontrol": "Self Control", "SelfDirectedness": "Self Directedness"}

#: Damaged strings and what they were.
DAMAGED = {"Bah spiritual metric: Ridvn": "Bahá'í spiritual metric: Ridván", "Bahá’\xad": "Bahá'í"}

#: Query words that carry no meaning, and synonyms of some that do.
STOP_WORDS = ["i", "am", "a", "an", "the", "my", "me", "and", "or", "to", "for", "in", "on", "of", "with", "by", "that", "this", "it", "was", "is", "have", "had", "been", "feeling", "very"]
SYNONYMS = {
    "skydiving": ["risk-taking", "adventure", "extreme sport", "thrill-seeking", "danger"],
    "believed": ["naivety", "gullibility", "trusting", "credulity", "unquestioning"],
    "voted": ["democratic", "consensus", "collaboration", "group decision", "teamwork"],
    "pause": ["hesitation", "delay", "uncertainty", "cautiousness", "deliberation"],
    "complaining": ["discontentment", "dissatisfaction", "frustration", "unhappy"],
    "checking": ["overprotectiveness", "anxiety", "vigilance", "worry", "compulsive"],
    "laughing": ["merriness", "hilarity", "humor", "joy", "laughter"],
    "emotional": ["emotionalism", "sentimental", "feeling", "sensitivity"],
    "python": ["self-improvement", "learning", "skill acquisition", "growth"],
    "skewed": ["statistical reasoning", "math", "analysis", "data distribution"],
}

#: Example sentences of a trait, the first branch whose words its name holds.
GENERIC_EXAMPLES = ["I often feel a strong sense of {} when dealing with daily situations.", "People tell me that my behavior shows a lot of {}."]
EXAMPLES = [
    (("risk", "danger"), ("I signed up for a solo skydiving trip even though I had never tried it before.", "I love taking big risks and trying dangerous activities without hesitation.")),
    (("naivety", "gullib"), ("He immediately believed the stranger who promised to double his money.", "I tend to trust people easily even when their claims sound too good to be true.")),
    (("democratic", "leader"), ("We voted together and chose the option supported by most of the team.", "I always consult everyone in the group before making a decision.")),
    (("hesitat", "pause"), ("I tend to pause for a long time before making an important decision.", "I second-guess myself and wait before committing to a final choice.")),
    (("discontent", "complain"), ("I keep complaining that nothing at work is ever good enough.", "I feel constantly dissatisfied with the results no matter how hard we try.")),
    (("protect", "safe"), ("Whenever my friend goes out, I keep checking whether they are safe.", "I worry constantly about the safety of my loved ones and call them repeatedly.")),
    (("merri", "laugh"), ("That was hilarious—I couldn't stop laughing for ten minutes.", "I was filled with joy and burst out laughing at the joke.")),
    (("emotion", "sentim"), ("I got so emotional during the movie that I had to take a break.", "My emotions often overwhelm me when I hear touching stories.")),
    (("improv", "learn"), ("I started a course because I want to improve my Python skills.", "I spend my free time taking tutorials to master new technical tools.")),
    (("statistic", "math"), ("The sample mean is 18.4, and the data distribution is heavily right-skewed.", "I calculated the standard deviation and variance to analyze the metrics.")),
]


def strip(c: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def drop_last(c: Column) -> Column:
    return F.substring(c, 1, F.length(c) - 1)


def repair_encoding(c: Column) -> tuple[Column, Column]:
    """(repaired, whether it was repaired or holds a character beyond ASCII)."""
    fixed = F.replace(F.regexp_replace(c, "[�\u0080\u0093]+", "–"), F.lit("  "), F.lit(" – "))
    for bad, good in DAMAGED.items():
        fixed = F.replace(fixed, F.lit(bad), F.lit(good))
    return fixed, (fixed != c) | c.rlike(r"[^\x00-\x7F]")


def strip_number(c: Column) -> tuple[Column, Column]:
    """Without a prefix of three or four digits, a dot and spaces."""
    has = c.rlike(r"^\s*\d{3,4}\.\s*(.+)$")
    return F.when(has, strip(F.regexp_extract(c, r"^\s*\d{3,4}\.\s*(.+)$", 1))).otherwise(strip(c)), has


def strip_colon(c: Column) -> tuple[Column, Column]:
    """Without one colon at the end."""
    has = c.endswith(":")
    return F.when(has, strip(drop_last(c))).otherwise(c), has


def split_camel(c: Column) -> tuple[Column, Column]:
    known = F.create_map(*(F.lit(x) for pair in JOINED_NAMES.items() for x in pair))
    out = F.coalesce(F.try_element_at(known, c), F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"))
    return out, out != c


def clean(raw: Column) -> Column:
    """Struct of normalized_facet and the flags is_blank, is_header, has_numeric_prefix, encoding_repaired, camelcase_reformatted."""
    text = strip(F.coalesce(raw, F.lit("")))
    blank = text == ""
    no_colon, header = strip_colon(text)
    no_number, prefix = strip_number(no_colon)
    fixed, repaired = repair_encoding(no_number)
    done, camel = split_camel(fixed)
    flag = lambda c: ~blank & c
    return F.struct(
        F.when(blank, "").otherwise(done).alias("normalized_facet"), blank.alias("is_blank"), flag(header).alias("is_header"), flag(prefix).alias("has_numeric_prefix"),
        flag(repaired).alias("encoding_repaired"), flag(camel).alias("camelcase_reformatted"),
    )


def quality_flag(meta: Column, duplicate: Column) -> Column:
    """The first that holds."""
    return (
        F.when(meta["is_blank"], "blank").when(duplicate, "duplicate").when(meta["is_header"], "header_row").when(meta["has_numeric_prefix"], "number_prefix_stripped")
        .when(meta["encoding_repaired"], "encoding_repaired").when(meta["camelcase_reformatted"], "camelcase_reformatted").otherwise("valid")
    )


def display_name(c: Column) -> Column:
    """Trimmed, without one colon at the end; null is empty."""
    return F.coalesce(strip_colon(strip(c))[0], F.lit(""))


def match_key(c: Column) -> Column:
    """Lower case without any colons at the end."""
    return F.lower(strip(F.regexp_replace(c, ":+$", "")))


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def snippet(c: Column, n: int = 50, always: bool = False) -> Column:
    cut = F.concat(F.substring(c, 1, n), F.lit("..."))
    return cut if always else F.when(F.length(c) > n, cut).otherwise(c)


def input_error(c: Column, max_chars: int | None = 10_000) -> Column:
    """Why a text can't be evaluated, or null. Length counts before trimming."""
    error = F.when(c.isNull() | (strip(c) == ""), "blank")
    return error.when(F.length(c) > max_chars, "too long") if max_chars else error


def _words(lower: Column) -> Column:
    """Maximal runs of letters, digits and _ that are all [a-z0-9]."""
    return F.regexp_extract_all(lower, F.lit(r"((?<![\p{L}\p{N}_])[a-z0-9]++(?![\p{L}\p{N}_]))"), F.lit(1))


def whole_words(c: Column) -> Column:
    """Lower-cased words as they stand, camel case unsplit."""
    return _words(F.lower(F.coalesce(c, F.lit(""))))


def split_words(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return _words(F.replace(F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")), F.lit("-"), F.lit(" ")))


def bigrams(words: Column) -> Column:
    """Neighbouring words with _ between. Words hold no space, so one replacement over their line makes all pairs at
    once, where a lambda would be called for each."""
    pairs = F.split(F.regexp_replace(F.array_join(words, " "), "([^ ]+) (?=([^ ]+))", "$1_$2 "), " ")
    return F.when(F.size(words) > 1, F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))


def terms(c: Column) -> Column:
    """Distinct terms in order: words with camel case split, words as they are, pairs of the first."""
    read = F.struct(split_words(c).alias("split"), whole_words(c).alias("whole"))
    # The lambda's argument is computed once, where a repeated expression would tokenize once for each of its places.
    return F.transform(F.array(read), lambda r: F.array_distinct(F.concat(r["split"], r["whole"], bigrams(r["split"]))))[0]


def word_tokens(c: Column) -> Column:
    r"""Runs of \w in any script, lower-cased, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"((?U)\w+)"), F.lit(1))


def key_terms(c: Column) -> Column:
    """Words of over two characters that are no stop words."""
    words = _words(F.lower(F.coalesce(c, F.lit(""))))
    return F.filter(words, lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS))


def expanded_terms(c: Column) -> Column:
    """Sorted distinct key terms and their synonyms."""
    known = F.create_map(*(x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    own = key_terms(c)
    return F.array_sort(F.array_distinct(F.concat(own, F.flatten(F.transform(own, lambda t: F.coalesce(F.try_element_at(known, t), F.array().cast("array<string>")))))))


def expand_query(c: Column) -> Column:
    return strip(F.concat(F.coalesce(c, F.lit("")), F.lit(" "), F.array_join(expanded_terms(c), " ")))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def lexical_text(name: Column, kind: Column, definition: Column) -> Column:
    return F.concat_ws(" ", _text(name), _text(kind), _text(definition))


def dense_text(name: Column, raw: Column, kind: Column, definition: Column, keywords: Column, examples: Column, reason: Column) -> Column:
    """The text that is embedded. A null reason reads None, as the published vectors had it."""
    return F.concat(
        F.lit("Facet Name: "), _text(name), F.lit(" | Raw Facet: "), _text(raw), F.lit(" | Category: "), _text(kind), F.lit(" | Definition: "), _text(definition),
        F.lit(" | Keywords: "), F.array_join(keywords, " "), F.lit(" | Conversational Utterance Examples: "), F.array_join(examples, " "), F.lit(" "), F.coalesce(reason, F.lit("None")),
    )


def rich_text(name: Column, raw: Column, kind: Column, definition: Column, rules: Column, keywords: Column, reason: Column) -> Column:
    """The text for the other embedder. A null reason reads None; a null kind is conversational_trait, a null name the raw one."""
    parts = [
        ("Facet Name", F.coalesce(name, _text(raw))), ("Raw Facet", _text(raw)), ("Type", F.coalesce(kind, F.lit("conversational_trait"))), ("Definition", _text(definition)),
        ("Scoring Rules", _text(rules)), ("Keywords", F.array_join(keywords, ", ")), ("Abstention Reason", F.coalesce(reason, F.lit("None"))),
    ]
    return F.array_join(F.array(*(F.concat(F.lit(f"{label}: "), value) for label, value in parts)), " | ")


def enriched_text(facet_id: Column, name: Column, raw: Column, kind: Column, definition: Column, keywords: Column, reason: Column) -> Column:
    words = F.array_join(keywords, ", ")
    return F.concat(
        F.lit("Facet ID: "), facet_id, F.lit(" | Canonical Facet: "), name, F.lit(" | Raw Facet: "), raw, F.lit(" | Category: "), kind, F.lit(" | Definition: "), definition,
        F.lit(" | Scoring Rules: "), definition, F.lit(" | Behavioral Indicators: "), words, F.lit(" | Aliases: "), name, F.lit(", "), raw, F.lit(", "), words,
        F.lit(" | Abstention Guidance: "), F.coalesce(reason, F.lit("None")),
    )


def examples(name: Column) -> Column:
    """Up to four example sentences of a trait."""
    low = F.lower(name)
    branch = F.array().cast("array<string>")
    for words, sentences in reversed(EXAMPLES):
        has = reduce(lambda a, b: a | b, (low.contains(w) for w in words))
        branch = F.when(has, F.array(*map(F.lit, sentences))).otherwise(branch)
    generic = [F.concat(F.lit(a), name, F.lit(b)) for a, b in (g.split("{}") for g in GENERIC_EXAMPLES)]
    return F.slice(F.concat(F.array(*generic), branch), 1, 4)


def multi_example_text(facet_id: Column, name: Column, kind: Column, definition: Column, keywords: Column) -> Column:
    return F.concat(
        F.lit("Facet ID: "), facet_id, F.lit(" | Canonical Facet: "), name, F.lit(" | Category: "), kind, F.lit(" | Definition: "), definition,
        F.lit(" | Keywords: "), F.array_join(keywords, ", "), F.lit(" | Conversational Utterances: "), F.array_join(examples(name), " ; "),
    )


def any_of(c: Column, words: list[str]) -> Column:
    """Whether the text holds any of the words, anywhere."""
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words))
