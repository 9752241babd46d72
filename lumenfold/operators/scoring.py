"""Prompts, backends and the parsing of model output."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import any_of, display_name, strip
from lumenfold.schemas import RESULT, valid_result
from lumenfold.session import spread

DEFAULT_ANCHORS = "High/Low behavioral indicators"
DEFAULT_REASON = "Facet is unobservable from conversational text."
UNOBSERVABLE_CONFIDENCE, ABSTAIN_CONFIDENCE = 0.99, 0.85

#: Words of the rule backend and phrases of a refusal.
MEDICAL_WORDS = ["blood pressure", "iron", "parathyroid", "basophil", "hormone", "dizzy", "macronutrient", "fsh", "depression (dep)"]
EXTERNAL_WORDS = ["car", "owns a car", "passport", "commute time", "subscriber"]
NAME_STOP_WORDS = ["behavior", "tendency", "subcomponents", "themes"]
CUE_WORDS = ["skydiving", "risk", "helped", "believed", "voted", "pause", "complaining", "checking", "laughing", "emotional", "python", "mean", "median", "firmly", "changed", "climbing", "drained", "gloomy", "database", "distance", "admitted", "failed", "returned", "learn", "problem", "experiments", "opinion", "trust", "sorted", "donated"]
TRAIT_WORDS = ["risk", "naivety", "leadership", "hesitation", "discontentment", "overprotectiveness", "merriness", "emotionalism", "self-improvement", "statistical", "assertiveness", "cunningness", "adventure", "compassion", "moroseness", "specialist", "aloofness", "genuine", "determinedness", "honesty", "relationship", "challenge", "numerical", "openness", "selfesteem", "alphanumeric", "big-heartedness"]
STRONG_WORDS = ["solo", "immediately", "voted", "pause", "complaining", "hilarious", "course", "firmly", "gloomy", "six years", "admitted", "failed", "returned", "donated"]
REFUSALS = ["cannot fulfill", "cannot answer", "unable to evaluate", "as an ai", "as a language model", "sorry, but i cannot"]

#: The instructions that models get, as text.
SYSTEM_PROMPT = """You are an expert AI/ML Behavioral & Conversational Trait Evaluator.
Your job is to evaluate a conversation transcript against a small set of candidate facets.

CRITICAL ABSTENTION & ACCURACY RULES:
1. DO NOT infer unsupported facts, medical lab values, blood test results, physical health diagnoses, or unverified external biographical details.
2. If the conversation DOES NOT contain explicit or strong implicit evidence for a facet, you MUST ABSTAIN by returning status "insufficient_evidence" with score = null and evidence = null.
3. If a facet is unobservable from text (e.g. medical biomarker, lab count, physical sensor log), return status "not_observable" with score = null and evidence = null.
4. For observable behavioral/conversational traits, self-reported skill experiences, or explicit statements supported by text, assign status "scored" and an integer score from 1 to 5:
   1 = Minimal / Essentially Absent evidence
   2 = Weak / Vague implicit evidence
   3 = Moderate clear evidence
   4 = Strong explicit evidence
   5 = Very Strong / Explicit direct evidence or multi-year expertise statement
5. For status "scored", you MUST extract an exact quote from the conversation into the "evidence" field.

OUTPUT FORMAT:
You MUST respond with a valid JSON array of objects. Do not include markdown formatting outside the JSON array. Each object MUST contain:
{
  "facet_id": "string",
  "facet": "string",
  "status": "scored" | "insufficient_evidence" | "not_observable" | "invalid_facet",
  "score": integer (1-5) or null,
  "confidence": float (0.0 to 1.0),
  "evidence": "exact quote from text" or null,
  "reason": "explanation of score or abstention reason"
}
"""
HARNESS_PROMPT = """You are a psychological facet evaluator. Assess if the user's text exhibits any of the given candidate traits.
Evaluate each candidate trait INDEPENDENTLY against the conversation text. Do NOT abstain on a valid trait simply because another related candidate trait is present.
When team voting, consensus, or democratic decision-making ('We voted together') is mentioned, score 'Democratic Leadership' directly.
For matching traits, set status to 'scored' and assign a score from 1.0 to 5.0.
For unmatched traits, set status to 'abstained' and score to 0.0.
Keep reasoning short (1 concise sentence per trait).
Return ONLY a raw JSON array of objects with keys: facet_id, facet_name, score, status, confidence, reasoning."""


def batches(candidates: DataFrame, batch_size: int) -> DataFrame:
    """Adds batch, the number from 0 of the group of at most batch_size that a candidate (rank from 1) goes with."""
    return candidates.withColumn("batch", F.floor((F.col("rank") - 1) / max(1, batch_size)).cast("int"))


#: The literals of this prompt are those that the published outputs answer.
def prompts(batched: DataFrame) -> DataFrame:
    """batched: conv_id, text, batch, rank and the catalog's columns. One user prompt for each conversation and batch."""
    rank = F.row_number().over(Window.partitionBy("conv_id", "batch").orderBy("rank"))
    anchors = F.when(F.coalesce(F.col("scoring_anchors"), F.lit("")) == "", DEFAULT_ANCHORS).otherwise(F.col("scoring_anchors"))
    block = F.concat(
        F.lit("Candidate "), F.col("n").cast("string"), F.lit(":\n  - Facet ID: "), F.col("facet_id"), F.lit("\n  - Facet Name: "), F.col("normalized_facet"),
        F.lit("\n  - Type: "), F.col("facet_type"), F.lit("\n  - Definition: "), F.col("scoring_definition"), F.lit("\n  - Anchors: "), anchors, F.lit("\n"),
    )
    each = batched.withColumn("n", rank).select("conv_id", "batch", "text", "n", block.alias("block"))
    grouped = each.groupBy("conv_id", "batch").agg(F.max("text").alias("text"), F.array_sort(F.collect_list(F.struct("n", "block"))).alias("blocks"), F.count("*").alias("n_candidates"))
    body = F.array_join(F.transform("blocks", lambda b: b["block"]), "\n")
    prompt = F.concat(
        F.lit('[CONVERSATION TRANSCRIPT]\n"'), strip(F.col("text")), F.lit('"\n\n[CANDIDATE FACETS TO EVALUATE]\n'), body,
        F.lit("\n\nEvaluate each candidate facet above strictly against the conversation transcript.\nReturn a JSON array containing exactly "), F.col("n_candidates").cast("string"), F.lit(" objects.\n"),
    )
    return grouped.select("conv_id", "batch", "n_candidates", prompt.alias("prompt"))


#: The literals of this prompt, as above.
def harness_prompts(batched: DataFrame) -> DataFrame:
    """batched as for prompts. The short list form: a line a candidate, in rank order, for HARNESS_PROMPT."""
    line = F.concat(F.lit("- ["), F.col("facet_id"), F.lit("] "), display_name(F.col("normalized_facet")), F.lit(": "), F.coalesce("scoring_definition", F.lit("")))
    grouped = batched.groupBy("conv_id", "batch").agg(F.max("text").alias("text"), F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"), F.count("*").alias("n_candidates"))
    lines = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    prompt = F.concat(F.lit('CONVERSATION TEXT:\n"'), F.coalesce("text", F.lit("")), F.lit('"\n\nCANDIDATE FACETS:\n'), lines, F.lit("\n\nOutput JSON array:"))
    return grouped.select("conv_id", "batch", "n_candidates", prompt.alias("prompt"))


def cues(conversation: Column) -> Column:
    """What the rules look for in a conversation, once for all its candidates: its lower-case text up to the first inner
    quote, and whether it holds a cue, a strong cue, a rejected quotation."""
    conv = F.lower(F.substring_index(strip(conversation), '"', 1))
    quoted = conv.contains("exhibiting hesitation") & conv.contains("disagree")
    return F.struct(conv.alias("conv"), any_of(conv, CUE_WORDS).alias("cue"), any_of(conv, STRONG_WORDS).alias("strong"), quoted.alias("quoted"))


#: The reasons and confidences of the rule backend's results.
def rule_result(facet_id: Column, facet: Column, about: Column) -> Column:
    """The deterministic backend as one struct of a result: ordered rules on the trait's name and the conversation's cues."""
    name, low, conv = strip(facet), F.lower(strip(facet)), about["conv"]
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")
    words = F.filter(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: w.rlike("^[a-z0-9]+$") & (F.length(w) > 3) & ~w.isin(*NAME_STOP_WORDS))
    scored = F.exists(words, lambda w: conv.contains(w)) | (about["cue"] & any_of(low, TRAIT_WORDS))
    said = lambda before, after: F.concat(F.lit(before), name, F.lit(after))

    def result(status: str, score: Column, confidence: float, evidence: Column, reason: Column) -> Column:
        return F.struct(facet_id.alias("facet_id"), name.alias("facet"), F.lit(status).alias("status"), score.alias("score"), F.lit(confidence).alias("confidence"), evidence.alias("evidence"), reason.alias("reason"))

    return (
        F.when(any_of(low, MEDICAL_WORDS), result("not_observable", none_i, 0.95, none_s, said("Unobservable metric or clinical construct: '", "'.")))
        .when(any_of(low, EXTERNAL_WORDS), result("not_observable", none_i, 0.90, none_s, said("External system log or biographical verification required for '", "'.")))
        .when(about["quoted"] & low.contains("hesitation"), result("insufficient_evidence", none_i, 0.85, none_s, F.lit("Quoted third-party statement rejected by speaker.")))
        .when(scored, result("scored", F.when(about["strong"], 5).otherwise(4), 0.90, F.substring(conv, 1, 60), said("Extracted clear conversational evidence for ", ".")))
        .otherwise(result("insufficient_evidence", none_i, 0.85, none_s, said("Conversational text does not express sufficient evidence for trait '", "'.")))
    )


def unobservable_result(facet_id: Column, facet: Column, reason: Column) -> Column:
    return F.struct(facet_id.alias("facet_id"), facet.alias("facet"), F.lit("not_observable").alias("status"), F.lit(None).cast("int").alias("score"), F.lit(UNOBSERVABLE_CONFIDENCE).alias("confidence"), F.lit(None).cast("string").alias("evidence"), F.coalesce(reason, F.lit(DEFAULT_REASON)).alias("reason"))


class HttpBackend:
    """A chat-completion endpoint. One more try after a second on server and URL errors, none after a read timeout."""

    def __init__(self, url: str, model: str = "", max_tokens: int = 500, temperature: float = 0.0, timeout_s: float = 60.0, open_url: Callable = urllib.request.urlopen, wait_s: float = 1.0):
        base = url.rstrip("/")
        for tail in ("/chat/completions", "/models", "/v1"):
            base = base.removesuffix(tail)
        self.url, self.model, self.max_tokens, self.temperature, self.timeout_s, self.open_url, self.wait_s = f"{base}/v1/chat/completions", model, max_tokens, temperature, timeout_s, open_url, wait_s

    def __call__(self, system: str, user: str) -> str:
        body = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "max_tokens": self.max_tokens, "temperature": self.temperature}
        for last in (False, True):
            try:
                request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
                with self.open_url(request, timeout=self.timeout_s) as answer:
                    return json.loads(answer.read())["choices"][0]["message"]["content"]
            except TimeoutError:
                raise
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    raise ConnectionError(f"no completion endpoint at {self.url}") from e
                if e.code < 500 or last:
                    raise
            except urllib.error.URLError as e:
                if isinstance(e.reason, TimeoutError) or last:
                    raise
            time.sleep(self.wait_s)
        raise AssertionError("unreachable")


def complete(prompted: DataFrame, backend: Callable[[str, str], str], system: str = SYSTEM_PROMPT) -> DataFrame:
    """conv_id, batch, raw_output, error: the backend called once a prompt. Write the result before parsing it, or a task
    that runs again calls again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for p in frame["prompt"]:
                try:
                    out.append((backend(system, p), None))
                except Exception as e:  # any failure of a call is that batch's result, as in the contract of inference_error
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({"conv_id": frame["conv_id"], "batch": frame["batch"], "raw_output": [o for o, _ in out], "error": [e for _, e in out]})

    kind = dict(prompted.dtypes)["conv_id"]
    return prompted.select("conv_id", "batch", "prompt").mapInPandas(run, f"conv_id {kind}, batch int, raw_output string, error string")


ITEM = "struct<facet_id:string,facet:string,status:string,score:string,confidence:string,evidence:string,reason:string>"
#: The patterns by which objects are told in a model's output, here and in the three functions that read it.
FLAT_OBJECT = r'(\{(?:\s*"[a-zA-Z0-9_]+"\s*:\s*(?:"(?:\\.|[^"\\])*"|true|false|null|-?\d+(?:\.\d+)?)\s*,?\s*)+\})'


def is_refusal(raw: Column) -> Column:
    return any_of(F.lower(raw), REFUSALS)


def json_text(raw: Column) -> Column:
    """What stands in a code fence, else from the first bracket to its last counterpart, else all."""
    fence, span = r"(?s)```(?:json)?\s*(\[.*?\]|\{.*?\})\s*```", r"(?s)(\[.*\]|\{.*\})"
    return F.when(raw.rlike(fence), F.regexp_extract(raw, fence, 1)).when(raw.rlike(span), F.regexp_extract(raw, span, 1)).otherwise(strip(raw))


def repaired_json(c: Column) -> Column:
    """Without commas before closing brackets; a cut array ends after its last object."""
    t = F.regexp_replace(strip(c), r",\s*([\]\}])", "$1")
    upto = F.regexp_extract(t, r"(?s)^(.*\})", 1)
    return F.when(t.startswith("[") & ~t.endswith("]") & (upto != ""), F.concat(upto, F.lit("]"))).otherwise(t)


def items(raw: Column) -> Column:
    """The objects of an output as array<struct> of strings: a list, one object, or flat objects found in broken text."""

    def read(r: Column) -> Column:
        t = r["t"]
        whole = F.when(t.startswith("["), F.from_json(t, f"array<{ITEM}>", {"mode": "PERMISSIVE"})).when(t.startswith("{"), F.array(F.from_json(t, ITEM)))
        flat = F.transform(F.regexp_extract_all(t, F.lit(FLAT_OBJECT), F.lit(1)), lambda o: F.from_json(repaired_json(o), ITEM))
        return F.filter(F.when(r["sound"], whole).otherwise(flat), lambda x: x.isNotNull())

    # The lambdas' arguments are computed once a text; a repeated expression would be, with all its patterns, once for each of its places.
    repaired = once(json_text(raw), repaired_json)
    return once(once(repaired, lambda t: F.struct(t.alias("t"), whole_json(t).isNotNull().alias("sound"))), read)


def once(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn names it."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def whole_json(c: Column) -> Column:
    """The text as a variant if it is one JSON value and nothing else; parsing alone would ignore what follows a value."""
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return F.when(F.try_variant_get(listed, "$[1]", "variant").isNull(), F.try_variant_get(listed, "$[0]", "variant"))


def round_half_even(c: Column) -> Column:
    return F.bround(c, 0).cast("int")


#: The reasons of results that are missing or can't be read.
def parse(outputs: DataFrame, candidates: DataFrame) -> DataFrame:
    """outputs: conv_id, batch, raw_output (and error); candidates: conv_id, batch, facet_id, facet, rank.

    One valid result for each candidate: the first valid object of its id, else abstention; after a refusal abstention
    for the batch, after an error inference_error. Objects of other ids are left out.
    """
    if "error" not in outputs.columns:
        outputs = outputs.withColumn("error", F.lit(None).cast("string"))
    raw = F.coalesce("raw_output", F.lit(""))
    # A small table is dealt out to all cores, as reading an output is heavy.
    judged = spread(outputs).select("conv_id", "batch", "error", raw.alias("raw"), is_refusal(raw).alias("refused"))
    found = judged.select("conv_id", "batch", "refused", "error", F.when(~F.col("refused") & F.col("error").isNull(), items(F.col("raw"))).alias("found"))
    read = found.select("conv_id", "batch", "refused", "error", F.posexplode_outer("found").alias("at", "item"))
    status = F.coalesce(F.col("item.status"), F.lit(""))
    known = F.lower(status).isin("scored", "insufficient_evidence", "not_observable", "invalid_facet")
    # An unknown status is abstention; one in other letters is known but then fails the check of the exact values.
    status = F.when(known, status).otherwise("insufficient_evidence")
    scored = status == "scored"
    value = F.expr("try_cast(item.score AS DOUBLE)")
    rounded = read.select(
        "conv_id", "batch", "refused", "error", "at", F.col("item.facet_id").alias("facet_id"), F.col("item.facet").alias("facet"), status.alias("status"),
        F.when(scored, round_half_even(value)).alias("score"), F.expr("try_cast(item.confidence AS DOUBLE)").alias("confidence"),
        F.when(scored, F.regexp_replace(F.col("item.evidence"), "^[\"' ]+|[\"' ]+$", "")).alias("evidence"), F.col("item.reason").alias("reason"),
    )
    valid = rounded.filter(valid_result(F.col("status"), F.col("score"), F.col("confidence"), F.col("facet"), F.col("reason")))
    first = valid.groupBy("conv_id", "batch", "facet_id").agg(F.min_by(F.struct("facet", "status", "score", "confidence", "evidence", "reason"), "at").alias("r"))
    about = outputs.select("conv_id", "batch", is_refusal(raw).alias("refused"), "error")
    joined = candidates.select("conv_id", "batch", "facet_id", F.col("facet").alias("name"), "rank").join(about, ["conv_id", "batch"], "left").join(first, ["conv_id", "batch", "facet_id"], "left")
    failed = F.col("error").isNotNull()
    reason = (
        F.when(failed, F.concat(F.lit("Inference error: "), F.col("error")))
        .when(F.col("refused"), "Model refused or was unable to provide a response for this dialogue snippet.")
        .otherwise(F.concat(F.lit("Conversational text does not express sufficient evidence for trait '"), F.coalesce("name", "facet_id"), F.lit("'.")))
    )
    none = F.col("r").isNull()
    return joined.select(
        "conv_id", "rank", "facet_id", F.when(none, F.coalesce("name", F.lit("Unknown"))).otherwise(F.col("r.facet")).alias("facet"),
        F.when(failed, "inference_error").when(none, "insufficient_evidence").otherwise(F.col("r.status")).alias("status"), F.col("r.score").alias("score"),
        F.when(failed, 0.0).when(none, ABSTAIN_CONFIDENCE).otherwise(F.col("r.confidence")).alias("confidence"), F.col("r.evidence").alias("evidence"),
        F.when(none, reason).otherwise(F.col("r.reason")).alias("reason"),
    )


HARNESS_FIELDS = ("facet_id", "facet", "score", "status", "confidence", "reasoning")
PARSED_STATES = ("valid_array", "wrapped_object", "single_object", "truncated_recovery")


def _listed(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def harness_read(raw: Column) -> Column:
    """state and items of an output. state: empty_output, valid_array, wrapped_object (the first list in an object),
    single_object, truncated_recovery (whole objects of a broken list) or parse_error. items: the list that was read, as
    variants, empty for the first and the last state."""
    t = strip(F.regexp_replace(F.coalesce(raw, F.lit("")), "```(?:json)?", ""))
    found = {name: F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for name, p in (("objects", r"(?s)(\[\s*\{.*\}\s*\])"), ("array", r"(?s)(\[.*\])"), ("object", r"(?s)(\{.*\})"))}
    whole = F.filter(F.transform(F.regexp_extract_all(t, F.lit(r'(?s)(\{\s*"facet_id".*?\})'), F.lit(1)), whole_json), lambda o: o.isNotNull())
    read = F.struct(
        F.coalesce(_listed(whole_json(found["objects"])), _listed(whole_json(found["array"]))).alias("list"), whole_json(found["object"]).alias("object"),
        F.map_keys(F.from_json(found["object"], "map<string,string>")).alias("keys"), whole.alias("recovered"), (strip(F.coalesce(raw, F.lit(""))) == "").alias("empty"),
    )

    def result(state: str, items: Column) -> Column:
        return F.struct(F.lit(state).alias("state"), items.alias("items"))

    def judged(r: Column) -> Column:
        fields = F.try_variant_get(r["object"], "$", "map<string,variant>")
        # A variant's fields are in the order of their names; the first list is that of the text's order.
        lists = F.filter(F.transform(r["keys"], lambda k: _listed(F.try_element_at(fields, k))), lambda x: x.isNotNull())
        single = F.exists(F.map_keys(fields), lambda k: k.isin("facet_id", "score", "status"))
        none = F.slice(r["recovered"], 1, 0)
        return (
            F.when(r["empty"], result("empty_output", none)).when(r["list"].isNotNull(), result("valid_array", r["list"])).when(F.size(lists) > 0, result("wrapped_object", F.get(lists, F.lit(0))))
            .when(single, result("single_object", F.array(r["object"]))).when(F.size(r["recovered"]) > 0, result("truncated_recovery", r["recovered"])).otherwise(result("parse_error", none))
        )

    return F.get(F.transform(F.array(read), judged), F.lit(0))


def harness_state(raw: Column) -> Column:
    return harness_read(raw)["state"]


def harness_items(items: Column) -> Column:
    """The objects among the variants of harness_read, each as harness_item reads it; other values are left out."""

    def field(v: Column, name: str) -> Column:
        return F.when(F.is_variant_null(F.try_variant_get(v, f"$.{name}", "variant")), "None").otherwise(F.try_variant_get(v, f"$.{name}", "string")).alias(name)

    objects = F.filter(items, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    return F.transform(objects, lambda v: harness_item(F.struct(*(field(v, n) for n in HARNESS_FIELDS))))


def harness_item(item: Column) -> Column:
    """An object of strings as facet_id, score (0 if no number), status (known ones; else by the score), confidence, reasoning."""
    score = F.coalesce(item["score"].try_cast("double"), F.lit(0.0))
    status = F.lower(strip(F.coalesce(item["status"], F.lit("abstained"))))
    known = status.isin("scored", "abstained", "not_observable", "insufficient_evidence")
    return F.struct(
        strip(F.coalesce(item["facet_id"], item["facet"], F.lit(""))).alias("facet_id"), score.alias("score"), F.when(known, status).when(score > 0, "scored").otherwise("abstained").alias("status"),
        F.coalesce(item["confidence"], F.lit("medium")).alias("confidence"), F.coalesce(item["reasoning"], F.lit("")).alias("reasoning"),
    )


def merged_passes(passes: DataFrame) -> DataFrame:
    """passes: conv_id, batch, state, items (array of structs), latency_ms. One row a conversation: the passes' items in
    turn, their summed latency, and the first pass's state if it was read, else the second's (valid_array without one)."""
    one = passes.groupBy("conv_id").agg(
        F.sum("latency_ms").alias("latency_ms"), F.count("*").alias("n_passes"), F.array_sort(F.collect_list(F.struct("batch", "state", "items"))).alias("in_turn"),
    )
    first, second = F.get("in_turn", F.lit(0))["state"], F.get("in_turn", F.lit(1))["state"]
    state = F.when(first.isin(*PARSED_STATES), first).otherwise(F.coalesce(second, F.lit("valid_array")))
    return one.select("conv_id", "n_passes", "latency_ms", state.alias("state"), F.flatten(F.transform("in_turn", lambda p: p["items"])).alias("items"))


RESULT_COLUMNS = RESULT.fieldNames()
