"""Passages that documents share, located by sharded Aho-Corasick automata.

A window is ``words`` consecutive words. A window that also starts in a document of a smaller id is a repeat, and so is each
word that it covers. All windows of all texts would be a row a word to shuffle, so the work goes by seeds first:

1. Seeds. The seed of a window is the least hash of the runs of ``GRAM`` words in it: the same for equal windows, and for some
   five windows in a row of one text. Seeds are counted by document; one that two documents have leads to its home, the
   least document that has it. Windows of other seeds can't recur.
2. Segments. A text's consecutive windows of one home are a segment. Equal windows have equal seeds, so they meet there.
3. Confirmation. The segments' windows are hashed and grouped with their home: the least and the greatest document of each.
   Where these differ the window recurs. The documents that have it first cut their segments down to such passages.
4. Automata. A cell gets the passages of some homes, about ``CELL`` words of them, and compiles an Aho-Corasick automaton
   of their windows (two characters a word, of alphabets that alternate, so that no match starts inside a word). The
   segments of these homes stream through it. It finds windows by their words, so no hash decides what is a repeat.
   Passages of a large home are dealt to several cells, each of which gets its segments; many segments of one home are dealt to
   copies of its cells. So neither a home of a third of all rows nor one in a single passage is one task.
5. Places found for each document are put together with its text.

Edge cases: null and empty texts and those of fewer words than a window have no window; a null id neither makes others
repeats nor is one; rows of one id are no repeats of each other, equal or not; repeated rows each get the
same result; an empty table gives no rows; a text of any length is one row, and its windows' hashes take some
200 bytes a word while it is worked on. Columns of any name stay; those that have a result's name get ``_kept`` added.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import kept_names, map_batches, written

WORDS, GRAM = 13, 5
CELL = 40_000  # words of passages for one automaton
STREAM = 400_000  # words of segments for one copy of it
PIECE = 4_000  # windows of a passage that stay together
BYTES = 1 << 18  # of texts that are hashed at once
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
BASE = np.uint64(0xD6E8FEB86659FD93)
NUMBERS = np.random.default_rng(13).integers(0, 1 << 64, 256, np.uint64)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
OTHER = "\x01\x02"  # a word that no pattern has


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, unchanged, as UTF-8."""
    return text.encode("utf-8", "replace").split() if text else []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers from 0, and their inverses modulo 2 ** 64."""
    if len(POWERS[0]) < n:
        POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(n - 1, x, np.uint64))) for x in (BASE, pow(int(BASE), -1, 1 << 64))]
    return POWERS[0], POWERS[1]


def hashed(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of texts that lie in raw one after the other, from bounds[i] to bounds[i + 1].
    A hash is the sum of the bytes' numbers times powers, taken from running sums of a part of raw, and mixed."""
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[bounds] = True
    found, at = [], 0
    while at < len(raw):
        stop = min(len(raw), at + BYTES)
        if stop < len(raw):  # a part ends where a word can't go on
            free = SPACE[raw[at:stop]] | fresh[at + 1 : stop + 1]
            back = int(free[::-1].argmax())
            if free[len(free) - 1 - back]:
                stop -= back
            else:
                free = SPACE[raw[stop:]] | fresh[stop + 1 :]  # a word longer than a part
                stop += int(free.argmax()) + 1
        part = raw[at:stop]
        word, new = ~SPACE[part], fresh[at : stop + 1]
        s = np.flatnonzero(word & (new[:-1] | ~np.append(False, word[:-1])))
        e = np.flatnonzero(word & (new[1:] | ~np.append(word[1:], False))) + 1
        power, inverse = powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(NUMBERS[part] * power[: len(part)], out=sums[1:])
        found.append((s + at, e + at, mixed((sums[e] - sums[s]) * inverse[s])))
        at = stop
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.uint64 if k == 2 else np.int64) for k in range(3))


class Batch:
    """The words of a column of texts: raw, its bytes; starts, ends and hashes of the words; first, the number of each text's first word."""

    def __init__(self, texts: pa.Array):
        _, bounds, data = texts.buffers()
        bounds = np.frombuffer(bounds, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.raw = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
        self.starts, self.ends, self.hashes = hashed(self.raw, bounds - bounds[0])
        self.first = np.searchsorted(self.starts, bounds - bounds[0])
        # a gap that isn't one space
        self.odd = np.cumsum(np.append(0, (self.starts[1:] - self.ends[:-1] != 1) | (self.raw[np.minimum(self.ends[:-1], len(self.raw) - 1)] != 32)))

    def each(self, values: np.ndarray, words: int) -> list[np.ndarray]:
        """Values of all windows (of all texts in a row) as those of each text."""
        stop = np.maximum(self.first[1:] - words + 1, self.first[:-1])
        return [values[s:e] for s, e in zip(self.first[:-1].tolist(), stop.tolist(), strict=True)]

    def slice(self, text: int, s: int, e: int) -> bytes:
        """The words from s to e of a text, a space between."""
        s, e = s + self.first[text], e + self.first[text]
        raw = self.raw[self.starts[s] : self.ends[e - 1]].tobytes()
        return b" ".join(raw.split()) if self.odd[e - 1] > self.odd[s] else raw


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive ones, in order."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = out * FACTOR + h[k : k + len(out)]
    return mixed(out)


def least(a: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive ones."""
    width = 1
    while 2 * width <= n:
        a, width = np.minimum(a[:-width], a[width:]), 2 * width
    return np.minimum(a[: len(a) - (n - width)], a[n - width :]) if n > width else a


def seeds_of(h: np.ndarray, words: int, gram: int) -> np.ndarray:
    """The seed of each window."""
    return least(runs(h, gram), words - gram + 1).view(np.int64) if len(h) >= words else np.zeros(0, np.int64)


def seeds(docs: DataFrame, words: int, gram: int) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, seeds: the different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Batch(batch.column(1))
            found = [np.unique(s[np.append(True, s[1:] != s[:-1])]) if len(s) else s for s in texts.each(seeds_of(texts.hashes, words, gram), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), packed(found)], ["doc_id", "seeds"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, seeds array<long>")


def packed(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of longs as one column."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def stretches(label: np.ndarray) -> list[tuple[int, int]]:
    """First and last + 1 of the maximal runs of equal labels of 0 and more."""
    if not len(label):
        return []
    starts = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
    ends = np.append(starts[1:], len(label))
    keep = label[starts] >= 0
    return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))


def segments(docs: DataFrame, homes: DataFrame, words: int, gram: int) -> DataFrame:
    """docs: doc_id, text; homes: doc_id, at (array of seed, home). Returns home, doc_id, text_hash, start, n, words."""
    schema = "home long, doc_id long, text_hash long, start int, n int, words binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            ids, digests, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), Batch(batch.column(2))
            for i, (own, at) in enumerate(zip(texts.each(seeds_of(texts.hashes, words, gram), words), batch.column(3), strict=True)):
                known = at.values  # this row's structs
                seed, home = (known.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                order = np.argsort(seed)
                seed, home = seed[order], home[order]
                place = np.minimum(np.searchsorted(seed, own), len(seed) - 1)
                there = seed[place] == own
                names, number = np.unique(home, return_inverse=True)
                label = np.where(there, number[place], -1)
                for s, e in stretches(label):
                    row = (names[label[s]], ids[i], digests[i], s, e - s + words - 1, texts.slice(i, s, e + words - 1))
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["home", "doc_id", "text_hash", "start", "n", "words"])

    rows = docs.join(homes, "doc_id").select("doc_id", F.xxhash64("text").alias("text_hash"), "text", "at")
    return map_batches(rows, run, schema)


def windows(parts: DataFrame, words: int) -> DataFrame:
    """parts: home, doc_id, words. Returns home, doc_id, hashes: those of the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Batch(batch.column(2))
            found = texts.each(runs(texts.hashes, words).view(np.int64), words)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], packed(found)], ["home", "doc_id", "hashes"])

    return map_batches(parts.select("home", "doc_id", "words"), run, "home long, doc_id long, hashes array<long>")


def passages(parts: DataFrame, recurring: DataFrame, words: int) -> DataFrame:
    """parts: home, doc_id, words; recurring: home, doc_id, hashes (those of windows that doc_id has first). Returns home,
    doc_id, n, words: the maximal stretches of such windows, longer ones in pieces of PIECE windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            home, doc, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), Batch(batch.column(2))
            for i, (own, known) in enumerate(zip(texts.each(runs(texts.hashes, words).view(np.int64), words), batch.column(3), strict=True)):
                there = np.isin(own, known.values.to_numpy(zero_copy_only=False))
                for first, last in stretches(there.astype(np.int64) - 1):
                    for s in range(first, last, PIECE):
                        e = min(last, s + PIECE)
                        for column, v in zip(out, (home[i], doc[i], e - s + words - 1, texts.slice(i, s, e + words - 1)), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["home", "doc_id", "n", "words"])

    rows = parts.join(recurring, ["home", "doc_id"]).select("home", "doc_id", "words", "hashes")
    return map_batches(rows, run, "home long, doc_id long, n int, words binary")


class Cell:
    """An automaton of the windows of passages; each window leads to the least document that it came with."""

    def __init__(self, words: int):
        self.words, self.passages, self.automaton, self.codes = words, [], None, {}

    def compile(self) -> None:
        each = [(doc, text.split(b" ")) for doc, text in self.passages]
        names = {w for _, ws in each for w in ws}
        base = int(len(names) ** 0.5) + 1
        self.codes = {w: chr(0x100 + k // base) + chr(0x8000 + k % base) for k, w in enumerate(sorted(names))}
        first: dict[str, int] = {}
        for doc, ws in each:
            code = self.code(ws)
            for k in range(0, len(code) - 2 * self.words + 2, 2):
                window = code[k : k + 2 * self.words]
                if first.get(window, doc) >= doc:
                    first[window] = doc
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for window, doc in first.items():
            self.automaton.add_word(window, doc)
        self.automaton.make_automaton()
        self.passages = []

    def code(self, words: list[bytes]) -> str:
        get = self.codes.get
        return "".join([get(w, OTHER) for w in words])

    def covered(self, doc: int, words: list[bytes]) -> list[tuple[int, int]]:
        """First and last + 1 word of the stretches that windows of smaller documents cover."""
        if self.automaton is None:
            self.compile()
        out: list[tuple[int, int]] = []
        for end, first in self.automaton.iter(self.code(words)) if len(self.automaton) else ():
            if first < doc:
                stop = (end + 1) // 2
                start = stop - self.words
                if out and start <= out[-1][1]:
                    out[-1] = (out[-1][0], stop)
                else:
                    out.append((start, stop))
        return out


def located(patterns: DataFrame, parts: DataFrame, words: int, cell: int, stream: int) -> DataFrame:
    """doc_id, text_hash, start, stop: the stretches of parts that windows of smaller documents cover."""
    of = lambda df, to: df.groupBy("home").agg(F.sum("n").alias(to))
    sizes = written(of(patterns, "has").join(of(parts, "gets"), "home"), "homes")
    total = sizes.agg(F.coalesce(F.sum("has"), F.lit(0)), F.coalesce(F.sum("gets"), F.lit(0))).first()
    shared = max(1, -(-total[0] // cell), -(-total[1] // stream))
    large = (F.col("has") > cell) | (F.col("gets") > stream)
    # A small home goes to one of the shared cells, a large one to cells of its own.
    place = sizes.select("home", F.when(large, F.concat(F.lit("h"), F.col("home"))).otherwise(F.concat(F.lit("s"), F.pmod(F.xxhash64("home"), F.lit(shared)))).alias("cell"), F.when(large, F.ceil(F.col("has") / cell)).otherwise(1).cast("int").alias("slices"), F.when(large, F.ceil(F.col("gets") / stream)).otherwise(1).cast("int").alias("copies"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("words", "doc_id"), F.col(n)).cast("int")
    blank = F.lit(None)
    taught = patterns.join(place, "home").select("cell", own("slices").alias("slice"), every("copies").alias("copy"), F.lit(0).alias("kind"), "doc_id", blank.cast("long").alias("text_hash"), blank.cast("int").alias("start"), "words")
    asked = parts.join(place, "home").select("cell", every("slices").alias("slice"), own("copies").alias("copy"), F.lit(1).alias("kind"), "doc_id", "text_hash", "start", "words")
    keys = ["cell", "slice", "copy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Cell(words)
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            a, b, c, kind, doc, text, start = (batch.column(k).to_pylist() for k in range(7))
            for i, raw in enumerate(batch.column(7)):
                if (a[i], b[i], c[i]) != now:
                    now, held = (a[i], b[i], c[i]), Cell(words)
                if kind[i] == 0:
                    held.passages.append((doc[i], raw.as_py()))
                    continue
                for s, e in held.covered(doc[i], raw.as_py().split(b" ")):
                    for column, v in zip(out, (doc[i], text[i], start[i] + s, start[i] + e), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "text_hash", "start", "stop"])

    dealt = taught.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "kind")
    return map_batches(dealt, run, "doc_id long, text_hash long, start int, stop int")


def repeats(docs: DataFrame, words: int = WORDS, gram: int = GRAM, cell: int = CELL, stream: int = STREAM, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, start, stop: stretches of words (from 0, stop excluded) that windows of smaller documents cover.
    Stretches of a text may overlap; text_hash is Spark's xxhash64 of the text, for ids that have several."""
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    seen = written(seeds(texts, words, gram), "seeds").select("doc_id", F.explode("seeds").alias("seed"))
    homes = seen.groupBy("seed").agg(F.min("doc_id").alias("home"), F.max("doc_id").alias("last")).filter("home < last").select("seed", "home")
    led = seen.join(written(homes, "homes"), "seed").groupBy("doc_id").agg(F.collect_list(F.struct("seed", "home")).alias("at"))  # a text's own seeds
    parts = written(segments(texts, led, words, gram), "segments")
    each = windows(parts, words).select("home", "doc_id", F.explode("hashes").alias("hash"))
    firsts = each.groupBy("home", "hash").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")).filter("doc_id < last")
    recurring = firsts.groupBy("home", "doc_id").agg(F.collect_list("hash").alias("hashes"))  # windows of one text
    patterns = written(passages(parts, recurring, words), "passages")
    return located(patterns, parts, words, cell, stream)


def remove(docs: DataFrame, words: int = WORDS, gram: int = GRAM, cell: int = CELL, stream: int = STREAM, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs' rows, n_words, n_removed and kept: the words that no window of a smaller document covers, a space between."""
    found = repeats(docs, words, gram, cell, stream, text, doc_id)
    spans = written(found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")  # of one text
    names = kept_names(docs.columns, ("n_words", "n_removed", "kept"))
    row = F.struct(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True))).alias("__row")
    rows = docs.select(row, F.col(f"`{doc_id}`").cast("long").alias("__id"), F.col(f"`{text}`").alias("__text"))
    joined = rows.join(spans, (F.col("__id") == F.col("doc_id")) & (F.xxhash64("__text") == F.col("text_hash")), "left").select("__row", "__text", F.col("spans.start").alias("__start"), F.col("spans.stop").alias("__stop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for t, start, stop in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                w = words_of(t.as_py())
                keep = np.ones(len(w), bool)
                for s, e in zip(start.as_py() or (), stop.as_py() or (), strict=True):
                    keep[s:e] = False
                total.append(len(w))
                gone.append(len(w) - int(keep.sum()))
                kept.append(b" ".join([w[k] for k in np.flatnonzero(keep).tolist()] if gone[-1] else w).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["__row", "n_words", "n_removed", "kept"])

    schema = joined.select("__row").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    made = map_batches(joined, run, schema)
    return made.select(*(F.col("__row")[n].alias(n) for n in names), "n_words", "n_removed", "kept")
