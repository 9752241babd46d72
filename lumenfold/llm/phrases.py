"""Phrase collocations by exact counts: n-grams as rows, prefix and suffix counts joined, extensions joined away.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and the pieces into words ``[^\\x20\\x09]+``. Every run
of 1 to max_n words inside a piece is a row, summed for each language before and after one shuffle. A phrase of 2 words
or more that occurs at least ``least`` times is a candidate. Cut after its first k words, it scores
floor(SCALE * a * a / (l * r)), with a its own count and l and r those of its two parts; its lowest cut counts, the first
of equal ones. Products are decimals of 38 digits, exact for counts below 10 ** 16. A candidate goes where a phrase one
word longer that holds it has at least ``absorbed`` percent of its count; that covers phrases longer by more words, as
each of them lies in such a one, which occurs as often at least.

Counts are written once, a size at a time: all words (their sum is n), and longer phrases from ``least`` on, which are
all that any candidate or part of one can be. The best of a language are ranked in shares of ``SHARES`` first, so that no task ranks a whole
language: at most SHARES * top rows of one meet.

Edge cases: a null text has no words, a null language counts as ``und``; repeated rows count as often as they stand there;
texts of any length are one row's arrays; an empty table gives no rows; columns but lang and text aren't read, whatever
they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import written

MAX_N, LEAST, ABSORBED, TOP = 3, 10, 50, 2000
SCALE, SHARES = 1_000_000, 64
UNKNOWN = "und"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "\n"  # between pieces; no word holds it


def tokens(text: Column) -> Column:
    """Words of the text and an END between pieces, as one array; null for null."""
    ended = F.regexp_replace(F.translate(text, UPPER, LOWER), "[.,;:!?\\x0A-\\x0D]+", f" {END} ")
    return F.split(F.regexp_replace(ended, "^[ \t]+|[ \t]+$", ""), "[ \t]+")


def windows(docs: DataFrame, max_n: int = MAX_N, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase: a row a word, the run of up to max_n words that begins with it inside its piece."""
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL")
    cut = texts.select("lang", tokens(F.col("text")).alias("w"))
    shifted = [F.slice("w", k + 1, F.size("w")).alias(f"w{k}") for k in range(1, max_n)]
    places = cut.select("lang", F.explode(F.arrays_zip(F.col("w").alias("w0"), *shifted)).alias("at")).select("lang", "at.*").filter(~F.col("w0").isin("", END))
    phrase = F.lit(None).cast("string")
    for k in range(max_n, 0, -1):  # the first END (or null, after the last word) ends it
        whole = F.concat(F.col("w0"), *(x for j in range(1, k) for x in (F.lit(" "), F.col(f"w{j}"))))
        phrase = whole if k == max_n else F.when(F.coalesce(F.col(f"w{k}"), F.lit(END)) == END, whole).otherwise(phrase)
    return places.select("lang", phrase.alias("phrase"))


def words_of(phrase: Column) -> Column:
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1


def counts(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, size, a of all words, and of the longer phrases that occur at least ``least`` times, as a written table.

    Each size from the longest to 2 is exploded, summed and written on its own, so that the shuffle of one size is
    gone before the next begins. Words come with the pairs: a place's window of up to two words is summed first, and the
    sums are exploded into the pair, if it is a result, and its first word."""
    made = None
    for size in range(max_n, 0, -1):
        if size == 1 and max_n > 1:
            break
        now = windows(docs, size, text, lang).withColumn("n", words_of(F.col("phrase")))
        if size > 2:
            now = now.filter(F.col("n") == size)
        now = now.groupBy("lang", "phrase").agg(F.count("*").alias("a"))
        if size == 2:
            pair = F.when((words_of(F.col("phrase")) == 2) & (F.col("a") >= least), F.col("phrase"))
            now = now.select("lang", F.explode(F.array(pair, F.substring_index("phrase", " ", 1))).alias("phrase"), "a").filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
        elif size > 2:
            now = now.filter(F.col("a") >= least)
        now = written(now.withColumn("size", words_of(F.col("phrase"))), "phrases")
        made = now if made is None else made.unionByName(now)
    return made


def part(phrase: Column, first: int, n: int) -> Column:
    """n words of the phrase from place ``first`` on (from 0)."""
    return F.array_join(F.slice(F.split(phrase, " "), first + 1, n), " ")


def scored(counted: DataFrame, max_n: int = MAX_N) -> DataFrame:
    """counted: lang, phrase, size, a. Returns lang, phrase, size, a, l, r, score of its phrases of 2 words and more."""
    of = lambda name, to: counted.select("lang", F.col("phrase").alias(name), F.col("a").alias(to))
    cuts = [F.when(F.col("size") > k, F.struct(F.lit(k).alias("k"), part(F.col("phrase"), 0, k).alias("head"), part(F.col("phrase"), k, max_n).alias("tail"))) for k in range(1, max_n)]
    each = counted.filter("size > 1").select("lang", "phrase", "size", "a", F.explode(F.array_compact(F.array(*cuts))).alias("cut")).select("lang", "phrase", "size", "a", "cut.*")
    both = each.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"])
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    both = both.withColumns({"above": wide("a") * wide("a") * F.lit(SCALE).cast("decimal(7,0)"), "below": wide("l") * wide("r")})
    value = F.expr("above div below")
    lowest = both.groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.first("a").alias("a"), F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("low"))
    return lowest.select("lang", "phrase", "size", "a", "low.l", "low.r", "low.score")


def absorbing(counted: DataFrame, max_n: int = MAX_N) -> DataFrame:
    """lang, phrase, most: the greatest count of a phrase one word longer that begins or ends with the phrase."""
    inner = F.array(part(F.col("phrase"), 0, F.col("size") - 1), part(F.col("phrase"), 1, max_n))
    return counted.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("b")).groupBy("lang", "phrase").agg(F.max("b").alias("most"))


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, absorbed: int = ABSORBED, top: int | None = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases by score, count and UTF-8 order (top None: all)."""
    counted = counts(docs, max_n, least, text, lang)
    longer = absorbing(counted, max_n)
    alone = scored(counted, max_n).alias("c").join(longer.alias("x"), (F.col("c.lang") == F.col("x.lang")) & (F.col("c.phrase") == F.col("x.phrase")) & (100 * F.col("x.most") >= absorbed * F.col("c.a")), "left_anti")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    if top is not None:
        share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
        alone = alone.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = alone.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    ranked = ranked.filter(F.col("rank") <= top) if top is not None else ranked
    n = counted.filter("size = 1").groupBy("lang").agg(F.sum("a").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def oracle() -> str:
    """The same for DuckDB with the default parameters."""
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM words, (SELECT unnest(range(1, {MAX_N + 1})) AS size) sizes
), f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= {LEAST}),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, ({SCALE}::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
), low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM low WHERE NOT EXISTS (
    SELECT 1 FROM cand b WHERE b.lang = low.lang AND b.a * 100 >= {ABSORBED} * low.a AND len(b.phrase) > len(low.phrase) AND contains(' ' || b.phrase || ' ', ' ' || low.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= {TOP}
"""
