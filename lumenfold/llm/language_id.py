"""Language identification: an interpolated Kneser-Ney character model for each language, in sorted hash arrays.

A text is its runs of letters, lower-cased, each between word marks; a model predicts each letter and the closing
mark from the ``ORDER - 1`` characters before. Since context ends at the marks, a text's cross-entropy is the sum
over its words, and a worker keeps each word's log probabilities in a bounded cache. The lowest cross-entropy per
character wins. A text is rejected (``und``) where no language comes near: above ``reject_above`` of the nearest one,
which is ``REJECT_MARGIN`` bits over the ``REJECT_QUANTILE`` of that language's held-out texts, and more for a short text
(``REJECT_SHORT`` over the root of its characters), so that ordinary texts stay and odd ones among the held-out lift nothing.

Fit: ``SAMPLE_DOCS`` documents a language (those of the smallest hash), whole texts; the n-gram types are counted
where the sample lies, one group a language, and merged on the driver. Scoring covers every whole text.

Edge cases: null, empty and letterless texts give ``und`` and score 0; ties go to the language first in sorted
order; an empty training table gives ``und`` for all; repeated rows stay; other columns aren't read. The sample is one
of different (id, text) pairs by their hash: a null id is like any other, a repeated id gives each of its texts its own
chance, and a repeated row counts once.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import carried, fold, map_batches, unit

ORDER = 4
SAMPLE_DOCS = 400
SAMPLE_SEED = 10
CACHED_WORDS = 400_000
REJECT_QUANTILE, REJECT_MARGIN, REJECT_SHORT = 0.9, 1.75, 8.0
MARK = 2  # code of the word mark; no letter has it
LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams that predict a letter or closing mark, [m, ORDER] codes, and the number of them in each word."""
    pad = chr(MARK) * (ORDER - 1)
    codes = np.frombuffer((pad + (chr(MARK) + pad).join(words) + chr(MARK)).encode("utf-32-le", "replace"), "<u4")
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(sizes + ORDER - 1) - sizes  # of the first predicted character of each word
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    return np.stack([codes[at - k] for k in range(ORDER - 1, -1, -1)], axis=1), sizes


def hashes(grams: np.ndarray) -> np.ndarray:
    h = np.zeros(len(grams), np.uint64)
    for k in range(grams.shape[1]):
        h = (h ^ grams[:, k].astype(np.uint64)) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def gram_types(texts: Iterator[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts and their counts."""
    count = Counter()
    for t in texts:
        count.update(words_of(t))
    if not count:
        return np.zeros((0, ORDER), np.uint32), np.zeros(0)
    grams, sizes = spelled(list(count))
    weight = np.repeat(np.fromiter(count.values(), np.float64, len(count)), sizes)
    _, first, inverse = np.unique(hashes(grams), return_index=True, return_inverse=True)
    return grams[first], np.bincount(inverse, weight)


class Lookup:
    """Sorted hashes with a row of values for each language."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        h = hashes(grams)
        by = np.argsort(h)
        self.keys, self.values = h[by], values[by]

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hashes(grams)
        at = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        return at, self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)


def _grouped(rows: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct rows and each column's sums over them."""
    if rows.shape[1] == 0:
        return rows[:1], [np.array([c.sum()]) for c in columns]
    _, first, inverse = np.unique(hashes(rows), return_index=True, return_inverse=True)
    return rows[first], [np.bincount(inverse, c, len(first)) for c in columns]


class Model:
    """Probabilities of all languages: for each order the n-grams that any language has and the backoff weights of contexts."""

    def __init__(self, types: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(types)
        n_langs = len(self.languages)
        self.uniform = 1.0 / (1 + len(np.unique(np.concatenate([g[:, -1] for g, _ in types.values()])))) if types else 1.0
        self.reject_above, self.sharpness = np.full(n_langs, np.inf), 8.0
        self.prob: dict[int, Lookup] = {}
        self.back: dict[int, Lookup] = {}
        if not types:
            return
        own: dict[int, list] = {n: [] for n in range(1, ORDER + 1)}
        for lang in self.languages:
            grams, count = types[lang]
            for n in range(ORDER, 0, -1):
                own[n].append((grams, count))
                grams, (count,) = _grouped(grams[:, 1:], [np.ones(len(grams))])  # continuation counts of the next order
        for n in range(1, ORDER + 1):
            everywhere, _ = _grouped(np.concatenate([g for g, _ in own[n]]), [])
            contexts, _ = _grouped(everywhere[:, :-1], [])
            back = Lookup(contexts, np.ones((len(contexts), n_langs)))
            direct = Lookup(everywhere, np.zeros((len(everywhere), n_langs)))
            for k, (grams, count) in enumerate(own[n]):
                once, twice = (count == 1).sum(), (count == 2).sum()
                discount = once / (once + 2 * twice) if once and twice else 0.5
                ctx, (total, kinds) = _grouped(grams[:, :-1], [count, np.ones(len(grams))])
                at, _ = back.find(ctx)
                back.values[at, k] = discount * kinds / total
                sums = np.zeros(len(back.keys))
                sums[at] = total
                at, _ = direct.find(grams)
                direct.values[at, k] = (count - discount) / sums[back.find(grams[:, :-1])[0]]
            by = np.argsort(hashes(everywhere))
            lower = self._prob(everywhere[by][:, 1:], n - 1)
            direct.values += back.values[back.find(everywhere[by][:, :-1])[0]] * lower
            self.prob[n], self.back[n] = direct, back

    def _prob(self, grams: np.ndarray, n: int) -> np.ndarray:
        """[m, languages] interpolated probabilities of the last character of each row."""
        if n == 0:
            return np.full((len(grams), len(self.languages)), self.uniform)
        at, hit = self.prob[n].find(grams)
        out = self.prob[n].values[at]
        if not hit.all():
            rest = grams[~hit]
            at, known = self.back[n].find(rest[:, :-1])
            out[~hit] = np.where(known[:, None], self.back[n].values[at], 1.0) * self._prob(rest[:, 1:], n - 1)
        return out

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """[words, languages] log2 probabilities and the number of characters, marks included."""
        grams, sizes = spelled(words)
        logs = np.log2(self._prob(grams, ORDER))
        return np.add.reduceat(logs, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0), sizes


class Scorer:
    """Cross-entropies of texts, with each word's share kept up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.row: dict[str, int] = {}
        self.log = np.zeros((1024, len(self.model.languages) + 1))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """[texts, languages] bits per character, NaN for texts without a letter, and the texts' characters, marks included."""
        if len(self.row) > CACHED_WORDS:
            self.reset()
        out, chars = np.full((len(texts), len(self.model.languages)), np.nan), np.zeros(len(texts))
        for at in range(0, len(texts), 64):
            parts = [words_of(t) for t in texts[at : at + 64]]
            words = [w for p in parts for w in p]
            if not words or not self.model.languages:
                continue
            new = list(dict.fromkeys(w for w in words if w not in self.row))
            for k in range(0, len(new), 20_000):
                some = new[k : k + 20_000]
                logs, sizes = self.model.of_words(some)
                first = len(self.row)
                while first + len(some) > len(self.log):
                    self.log = np.concatenate([self.log, np.zeros_like(self.log)])
                self.log[first : first + len(some), :-1], self.log[first : first + len(some), -1] = logs, sizes
                self.row.update(zip(some, range(first, first + len(some)), strict=True))
            n = np.fromiter(map(len, parts), np.int64, len(parts))
            ends = np.cumsum(n)[n > 0]
            sums = np.add.reduceat(self.log[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))], np.concatenate([[0], ends[:-1]]), axis=0)
            out[at : at + 64][n > 0] = -sums[:, :-1] / sums[:, -1:]
            chars[at : at + 64][n > 0] = sums[:, -1]
        return out, chars

    def judge(self, texts: list[str | None], reject: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and lowest cross-entropy of each text."""
        m, (e, chars) = self.model, self.entropies(texts)
        if not m.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
        blank = np.isnan(e[:, 0])
        low = np.where(blank[:, None], 0, e)
        best, least = low.argmin(1), low.min(1)
        score = 1 / np.exp2(np.minimum(m.sharpness * (least[:, None] - low), 0)).sum(1)
        out = blank | (reject & (least > m.reject_above[best] + REJECT_SHORT / np.sqrt(np.maximum(chars, 1))))
        return [UNDETERMINED if o else m.languages[b] for o, b in zip(out, best, strict=True)], np.where(out, 0.0, score), np.where(blank, np.nan, least)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """docs: the rows to learn from; those with null text or language are left out."""
    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    known = known.select(F.col(lang).alias("__lang"), F.xxhash64(F.lit(SAMPLE_SEED), F.col(doc_id), F.col(text)).alias("__h"), F.col(text).alias("__text"))
    shares = known.groupBy("__lang").agg((4 * F.lit(sample_docs) / F.approx_count_distinct("__h")).alias("__share"))  # a row a language
    near = known.select("__lang", "__h").join(F.broadcast(shares), "__lang").filter(unit(F.col("__h")) <= F.col("__share")).distinct()  # so that a partition sends few rows on
    chosen = near.withColumn("__n", F.row_number().over(Window.partitionBy("__lang").orderBy(unit(F.col("__h")), "__h"))).filter(F.col("__n") <= sample_docs).select("__lang", "__h")
    sample = known.join(F.broadcast(chosen), ["__lang", "__h"]).groupBy("__lang", "__h").agg(F.min("__text").alias("__text"))  # sample_docs texts a language

    def types(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(pdf["__text"])
        held = texts[::8]  # for calibration
        return pd.DataFrame({"lang": [key[0]], "types": [pickle.dumps(gram_types(t for i, t in enumerate(texts) if i % 8 or len(texts) < 8))], "held": [pickle.dumps(held)]})

    rows = sample.groupBy("__lang").applyInPandas(types, "lang string, types binary, held binary").collect()
    found = {r.lang: pickle.loads(r.types) for r in rows}
    model = Model({k: v for k, v in found.items() if len(v[1])})
    calibrate(model, [(r.lang, t) for r in rows for t in pickle.loads(r.held)])
    return model


def calibrate(model: Model, held: list[tuple[str, str]]) -> None:
    """Sets the sharpness of scores to the one of the best likelihood, and each language's bound of rejection well above its held-out texts."""
    held = [(k, t) for k, t in held if k in model.languages and words_of(t)]
    if not held:
        return
    e, _ = Scorer(model).entropies([t for _, t in held])
    right = np.array([model.languages.index(k) for k, _ in held])
    gap = e[np.arange(len(e)), right][:, None] - e
    cost = lambda s: np.log2(np.exp2(np.clip(s * gap, -60, 60)).sum(1)).mean()
    model.sharpness = min((1.0, 2.0, 4.0, 8.0, 16.0, 32.0), key=cost)
    for k in np.unique(right):
        model.reject_above[k] = np.quantile(e[right == k, k], REJECT_QUANTILE) + REJECT_MARGIN


def predict(docs: DataFrame, model: Model, reject: bool = True, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns (one named as those to come: NAME_kept), lang_pred, score, entropy (bits a character of the language that is nearest)."""
    rows, keep, schema = carried(docs, keep, text, "lang_pred string, score double, entropy double")
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(shared.value))
        for batch in batches:
            langs, score, least = scorer.judge(batch.column(batch.num_columns - 1).to_pylist(), reject)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(least, pa.float64(), from_pandas=True)], [*keep, "lang_pred", "score", "entropy"])

    return map_batches(rows, run, schema)


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 3) == 1
