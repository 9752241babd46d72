"""SQL for DuckDB that states independently what the queries compute."""

from __future__ import annotations

from lumenfold.functions import taxonomy, text
from lumenfold.operators import scoring


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def words(low: str) -> str:
    return f"list_filter(regexp_extract_all({low}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]+'))"


def camel(x: str) -> str:
    return f"regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g')"


def any_of(x: str, them) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in them) + ")"


#: Catalog-like names made of part, the same in both engines: every defect that cleaning knows, by p_partkey.
RAW_PART = """
SELECT p_partkey AS pos, CASE
  WHEN p_partkey % 97 = 5 THEN NULL
  WHEN p_partkey % 89 = 7 THEN '   '
  WHEN p_partkey % 83 = 3 THEN 'Repeated Trait'
  WHEN p_partkey % 23 = 1 THEN '644. ' || p_name
  WHEN p_partkey % 23 = 2 THEN p_name || ':'
  WHEN p_partkey % 23 = 3 THEN replace(p_name, ' ', '  ')
  WHEN p_partkey % 23 = 4 THEN replace(p_name, ' ', '') || 'Trait'
  WHEN p_partkey % 23 = 5 THEN p_name || ' café ' || p_partkey
  WHEN p_partkey % 23 = 6 THEN 'SelfEsteem'
  WHEN p_partkey % 23 = 7 THEN '12. ' || p_name || ' ' || p_partkey
  WHEN p_partkey % 23 = 8 THEN ' 801.  ' || p_name || ' level ' || p_partkey || ' '
  WHEN p_partkey % 23 = 9 THEN p_name || ' count ' || p_partkey
  WHEN p_partkey % 23 = 10 THEN p_name || ' hours/week ' || p_partkey
  WHEN p_partkey % 23 = 11 THEN p_name || ' reiki ' || p_partkey
  WHEN p_partkey % 23 = 12 THEN p_name || ' working memory ' || p_partkey
  WHEN p_partkey % 23 = 13 THEN p_name || ' burnout ' || p_partkey
  WHEN p_partkey % 23 = 14 THEN p_name || ' hostility ' || p_partkey
  WHEN p_partkey % 23 = 15 THEN p_name || ' temperature ' || p_partkey
  WHEN p_partkey % 23 = 16 THEN p_name || ' risk the of and ' || p_partkey
  WHEN p_partkey % 23 = 17 THEN p_name || ' hesitation leadership ' || p_partkey
  ELSE p_name || ' ' || p_type || ' trait ' || p_partkey END AS raw_facet
FROM part
"""

_no_colon = f"CASE WHEN ends_with(t, ':') THEN {strip('left(t, length(t) - 1)')} ELSE t END"
_number = r"'^\s*\d{3,4}\.\s*(.+)$'"
_joined = "CASE f " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in text.JOINED_NAMES.items()) + f" ELSE {camel('f')} END"
_damaged = "replace(regexp_replace(n, '[\ufffd\u0080\u0093]+', '–', 'g'), '  ', ' – ')"
for _bad, _good in text.DAMAGED.items():
    _damaged = f"replace({_damaged}, {q(_bad)}, {q(_good)})"


def _class(field: int) -> str:
    """0 type, 1 sensitivity, 2 definition, 3 reason."""
    out = ["CASE WHEN is_blank THEN " + q(taxonomy.BLANK[field])]
    head = taxonomy.HEADER[field]
    out.append("WHEN is_header THEN " + (q(head) if isinstance(head, str) else f"{q(head[0])} || nf || {q(head[1])}"))
    for r in taxonomy.RULES:
        found = f"regexp_matches(lower(nf), {q('|'.join(r.patterns))})" if r.patterns else any_of("lower(nf)", r.substrings)
        value = (q(r.kind), q(r.sensitivity), f"{q(r.definition + chr(39))} || nf || {q(chr(39) + '.')}", q(r.reason))[field]
        out.append(f"WHEN {found} THEN {value}")
    hostile = any_of("lower(nf)", taxonomy.HOSTILE)
    last = (q("conversational_trait"), f"CASE WHEN {hostile} THEN 'medium' ELSE 'low' END", f"{q(taxonomy.TRAIT[0])} || nf || {q(taxonomy.TRAIT[1])}", "NULL")[field]
    return " ".join([*out, f"ELSE {last} END"])


_escaped = "array_to_string(list_transform(string_split(nf, ''), lambda c: CASE WHEN unicode(c) > 126 THEN '\\u' || lpad(lower(to_hex(unicode(c))), 4, '0') ELSE c END), '')"

CATALOG = f"""
raw AS ({RAW_PART}),
c1 AS (SELECT pos, coalesce(raw_facet, '') AS raw_facet, {strip("coalesce(raw_facet, '')")} AS t FROM raw),
c2 AS (SELECT *, t = '' AS is_blank, t <> '' AND ends_with(t, ':') AS is_header, {_no_colon} AS u FROM c1),
c3 AS (SELECT *, NOT is_blank AND regexp_matches(u, {_number}) AS has_numeric_prefix, CASE WHEN regexp_matches(u, {_number}) THEN {strip(f"regexp_extract(u, {_number}, 1)")} ELSE {strip('u')} END AS n FROM c2),
c4 AS (SELECT *, {_damaged} AS f FROM c3),
c5 AS (SELECT *, NOT is_blank AND (f <> n OR regexp_matches(n, '[^\\x00-\\x7F]')) AS encoding_repaired, {_joined} AS g FROM c4),
clean AS (SELECT pos, raw_facet, CASE WHEN is_blank THEN '' ELSE g END AS nf, is_blank, is_header, has_numeric_prefix, encoding_repaired, NOT is_blank AND g <> f AS camelcase_reformatted FROM c5),
dup AS (SELECT *, row_number() OVER (PARTITION BY raw_facet ORDER BY pos) > 1 OR (nf <> '' AND row_number() OVER (PARTITION BY nf ORDER BY pos) > 1) AS is_duplicate FROM clean),
flags AS (SELECT *, CASE WHEN is_blank THEN 'blank' WHEN is_duplicate THEN 'duplicate' WHEN is_header THEN 'header_row' WHEN has_numeric_prefix THEN 'number_prefix_stripped'
  WHEN encoding_repaired THEN 'encoding_repaired' WHEN camelcase_reformatted THEN 'camelcase_reformatted' ELSE 'valid' END AS quality_flag FROM dup),
cls AS (SELECT *, {_class(0)} AS facet_type, {_class(1)} AS sensitivity, {_class(2)} AS scoring_definition, {_class(3)} AS abstention_reason FROM flags),
catalog AS (SELECT pos, printf('FACET_%03d', row_number() OVER (ORDER BY pos)) AS facet_id, raw_facet, nf AS normalized_facet, facet_type, facet_type = 'conversational_trait' AS conversation_observable,
  sensitivity, scoring_definition, CASE WHEN facet_type = 'conversational_trait' THEN '{{"high": "' || {q(taxonomy.ANCHOR_HIGH[0])} || {_escaped} || {q(taxonomy.ANCHOR_HIGH[1])} || '", "low": "' || {q(taxonomy.ANCHOR_LOW[0])} || {_escaped} || {q(taxonomy.ANCHOR_LOW[1])} || '"}}' END AS scoring_anchors,
  abstention_reason, quality_flag, is_duplicate FROM cls)"""

CONVERSATIONS = "folded AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)"


def terms(x: str) -> str:
    """Distinct terms (unordered)."""
    first = words(f"replace(lower({camel(x)}), '-', ' ')")
    return f"(SELECT list_distinct(list_concat(w, o, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || '_' || w[i + 1]))) FROM (SELECT {first} AS w, {words(f'lower({x})')} AS o))"


def bm25(docs: str, queries: str, name: str = "b") -> str:
    """CTEs {name}_sc (q, doc, pos, score) of pairs with a shared term and {name}_all (q, doc, rank, score) of all pairs.

    docs: a CTE of doc, pos, text; queries: of q, text."""
    n = name
    return f"""
{n}_dl AS MATERIALIZED (SELECT doc, pos, {terms("coalesce(text, '')")} AS t FROM {docs}),
{n}_dt AS MATERIALIZED (SELECT doc, pos, len(t) AS l, unnest(t) AS tok FROM {n}_dl),
{n}_st AS (SELECT count(*) AS n, greatest(coalesce(avg(len(t)), 0), 1) AS a FROM {n}_dl),
{n}_qt AS MATERIALIZED (SELECT q, unnest({terms("coalesce(text, '')")}) AS tok FROM {queries}),
{n}_df AS (SELECT tok, count(*) AS df, greatest(ln((any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1), 0.01::DOUBLE) AS idf FROM {n}_dt, {n}_st GROUP BY tok),
{n}_sc AS MATERIALIZED (SELECT q, doc, pos, round(sum(idf * 2.5::DOUBLE / greatest(1 + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a), 1e-6::DOUBLE)), 9) AS score
  FROM {n}_qt JOIN {n}_dt USING (tok) JOIN {n}_df USING (tok), {n}_st GROUP BY q, doc, pos),
{n}_all AS MATERIALIZED (SELECT p.q, p.doc, p.pos, coalesce(s.score, 0) AS score, row_number() OVER (PARTITION BY p.q ORDER BY coalesce(s.score, 0) DESC, p.pos) AS rank
  FROM (SELECT q, doc, pos FROM {queries}, {docs}) p LEFT JOIN {n}_sc s ON p.q = s.q AND p.doc = s.doc)"""


def cosine(pairs_from: str, a: str, b: str) -> str:
    return f"""round(list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform({a}, lambda z: z * z))) / sqrt(list_sum(list_transform({b}, lambda z: z * z))), 9)"""


def rule_fields(name: str, conv: str) -> dict[str, str]:
    """The rule backend's columns over a lower-case name and conversation."""
    own = f"list_filter({words(name)}, lambda w: length(w) > 3 AND NOT w IN ({', '.join(map(q, scoring.NAME_STOP_WORDS))}))"
    matching = f"len(list_filter({own}, lambda w: contains({conv}, w))) > 0"
    scored = f"({matching} OR ({any_of(conv, scoring.CUE_WORDS)} AND {any_of(name, scoring.TRAIT_WORDS)}))"
    medical, external = any_of(name, scoring.MEDICAL_WORDS), any_of(name, scoring.EXTERNAL_WORDS)
    quoted = f"(contains({conv}, 'exhibiting hesitation') AND contains({conv}, 'disagree') AND contains({name}, 'hesitation'))"
    return {
        "status": f"CASE WHEN {medical} OR {external} THEN 'not_observable' WHEN {quoted} THEN 'insufficient_evidence' WHEN {scored} THEN 'scored' ELSE 'insufficient_evidence' END",
        "score": f"CASE WHEN {medical} OR {external} OR {quoted} OR NOT {scored} THEN NULL WHEN {any_of(conv, scoring.STRONG_WORDS)} THEN 5 ELSE 4 END",
        "confidence": f"CASE WHEN {medical} THEN 0.95::DOUBLE WHEN {external} THEN 0.9::DOUBLE WHEN {quoted} THEN 0.85::DOUBLE WHEN {scored} THEN 0.9::DOUBLE ELSE 0.85::DOUBLE END",
        "evidence": f"CASE WHEN {medical} OR {external} OR {quoted} OR NOT {scored} THEN NULL ELSE substring({conv}, 1, 60) END",
    }
