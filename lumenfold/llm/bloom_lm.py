"""Language-model scores from a log-frequency Bloom filter of quantised pair counts.

Tokens are ``[^\\x20\\x09-\\x0D]+`` words with A-Z lower-cased and one end a text. A pair's count is quantised to a level
of ``LEVELS``; the pair is put into the filter once for each level up to its own, so that its level is read back by
membership probes until one fails.

Size: every pair of all training texts enters the filter, also those that occur once, so it grows with the corpus and no
machine holds it whole. It is cut into parts by the pairs' hashes, about one for each ``PART_BYTES`` of text. A task
counts the pairs of its parts and sets their bits; the parts lie in the shared folder. To score, a batch of texts sends the
keys of its pairs to their parts, packed, and gets the levels back. Words go the same way to parts with their exact
counts and the number of different words that follow each. Only totals come to the driver; nothing is broadcast.

Model: P(w | v) = SHARE * ((count(v, w) - D) / count(v) + back(v) * P(w)) + (1 - SHARE) * P(w), where P(w) is the base
estimate (c + 0.5) / (N + 0.5 (V + 1)), a pair's count is read from the filter, count(v) is exact, and back(v) = D *
followers(v) / count(v) is the weight left after discounting v's pairs. A first word follows the end token. A pair
that the filter doesn't have has count 0; of an unknown word as v, P(w | v) = P(w).

Words are told apart by 64 bits. A pair is told apart in counting by 40 bits of each of its words, mixed into 64, and goes to
the parts as both, so that the first word's followers are counted whatever their number; in the filter it has 32 bits
beside its part, and the filter's own false positives are some in a hundred. Edge cases: null counts as empty (one end token); with no training text c, N and V
are 0 and scores are those of the formula; repeated rows stay; ids may repeat; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import ROWS_PER_BATCH, ascii_words, carried, map_batches, written

END = b""  # no word is empty
SHARE, D = 0.5, 0.5
WORDS_BOUND, PAIRS_HELD = 600_000, 2_000_000  # what a counting task holds before it sends its counts on
PART_BYTES = 16 << 20  # of text, about, for each part of the filter
PROBES, BITS_PER_KEY, BLOCK_BITS, LINE_BITS = 4, 8, 1 << 19, 512
#: Least counts of the levels 1, 2, ...: every count at first, then steps of about a sixteenth.
LEVELS = [1]
while LEVELS[-1] < 1 << 45:
    LEVELS.append(max(LEVELS[-1] + 1, math.floor(LEVELS[-1] * 17 / 16)))
LEVELS_ARRAY = np.array(LEVELS, np.int64)
MIDDLE = np.concatenate([[0.0], np.sqrt(LEVELS_ARRAY.astype(float) * np.append(LEVELS_ARRAY[1:] - 1, LEVELS_ARRAY[-1]))])
PAIR, PART, FIRST = (np.uint64(x) for x in (0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89))
MIX = np.uint64(0x9E3779B97F4A7C15)
EMPTY = xxhash.xxh64_intdigest(END)
KEY_BYTES, HEAD_BYTES = 4, 5  # of a pair's key in its part; of a word in a pair
FILTER, WORDS, FOLLOWERS, ASKED = range(4)  # kinds of rows that a part gets
ROWS = "part long, chunk long, kind int, blocks long, a binary, b binary"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def head_of(words: np.ndarray) -> np.ndarray:
    """The 40 bits by which a pair knows a word."""
    return words >> np.uint64(24)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """All bits of both words' heads, mixed."""
    return mixed(mixed(first ^ FIRST) + second)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS_ARRAY, counts, side="right")


def block_of(keys: np.ndarray, n_blocks: int) -> np.ndarray:
    return mixed(keys ^ MIX) % np.uint64(n_blocks)


class Filter:
    """Blocks of bits; a key is in one block, and each few of its levels in one line of it that a cache holds."""

    def __init__(self, n_blocks: int, bits: np.ndarray | None = None):
        self.n_blocks = max(1, n_blocks)
        self.bits = np.zeros(self.n_blocks * BLOCK_BITS // 8, np.uint8) if bits is None else bits

    @staticmethod
    def positions(keys: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
        """The places in its block of each probe of a level of a key."""
        level = level.astype(np.uint64)
        line = mixed(keys + (level >> np.uint64(2)) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(BLOCK_BITS // LINE_BITS) * np.uint64(LINE_BITS)
        h = mixed(keys ^ (level * np.uint64(0xA0761D6478BD642F)))
        return [line + ((h >> np.uint64(9 * probe)) & np.uint64(LINE_BITS - 1)) for probe in range(PROBES)]

    def has(self, keys: np.ndarray, level: np.ndarray) -> np.ndarray:
        start = block_of(keys, self.n_blocks) * np.uint64(BLOCK_BITS)
        out = np.ones(len(keys), bool)
        for place in self.positions(keys, level):
            p = start + place
            out &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: probes at 1, 2, 4, ... until one fails, then between the last two by halves."""
        low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(LEVELS) + 1)
        at, step = np.arange(len(keys)), 1
        while len(at) and step <= len(LEVELS):
            there = self.has(keys[at], np.full(len(at), step))
            high[at[~there]] = step
            at = at[there]
            low[at] = step
            step *= 2
        at = np.flatnonzero(high - low > 1)
        while len(at):
            middle = (low[at] + high[at]) // 2
            there = self.has(keys[at], middle)
            low[at[there]], high[at[~there]] = middle[there], middle[~there]
            at = at[high[at] - low[at] > 1]
        return low


def tokens(text: str | None) -> list[bytes]:
    words = ascii_words(text)
    words.append(END)
    return words


class Numbers(dict):
    """Words by place; a word that is looked up for the first time gets the next place."""

    def __init__(self) -> None:
        super().__init__()
        self.names: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self.names)
        self.names.append(word)
        return place

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def part_of(h: np.ndarray, n_parts: int) -> np.ndarray:
    return (mixed(h ^ PART) % np.uint64(n_parts)).astype(np.int64)


def keys_of(pairs: np.ndarray) -> np.ndarray:
    """What the filter knows a pair by, inside its part."""
    return mixed(pairs ^ PAIR) & np.uint64((1 << 8 * KEY_BYTES) - 1)


def packed(x: np.ndarray, n: int) -> bytes:
    """The n low bytes of each."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.pad(np.frombuffer(raw, np.uint8).reshape(-1, n), ((0, 0), (0, 8 - n))).view(np.uint64).reshape(-1)


def planes(x: np.ndarray) -> bytes:
    """The low bytes of all, then the next ones, and so on: small numbers become runs of zeros, which compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplaned(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def dealt(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs, and the places of its elements in their order."""
    order = np.argsort(part, kind="stable")
    parts, starts = np.unique(part[order], return_index=True)
    return zip(parts.tolist(), np.split(order, starts[1:]), strict=False)


def summed(h: np.ndarray, n: np.ndarray, *beside: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different hashes in order, the sum of each one's numbers, and what else stands beside one of each."""
    if not len(h):
        return h, n, *beside
    order = np.argsort(h)
    h, n = h[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[starts], np.add.reduceat(n, starts), *(x[order[starts]] for x in beside)


def counted(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs by their first words, and how often each stands there. A pair may come more than once, where pairs that
    differ late in the second word lie between; the part that it goes to sums it."""
    order = np.argsort(first << np.uint64(24) | second >> np.uint64(16))
    first, second = first[order], second[order]
    starts = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
    return first[starts], second[starts], np.diff(np.append(starts, len(first)))


def both_packed(first: np.ndarray, second: np.ndarray) -> bytes:
    """The heads of pairs, byte by byte of all, so that runs of a first word compress."""
    raw = np.stack([first, second]).view(np.uint8).reshape(2, -1, 8)[:, :, :HEAD_BYTES]
    return np.ascontiguousarray(raw.transpose(0, 2, 1)).tobytes()


def both_unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    by_byte = np.frombuffer(raw, np.uint8).reshape(2, HEAD_BYTES, -1).transpose(0, 2, 1)
    first, second = np.pad(by_byte, ((0, 0), (0, 0), (0, 8 - HEAD_BYTES))).copy().view(np.uint64)[:, :, 0]
    return first, second


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of ROWS."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], [x.split()[0] for x in ROWS.split(", ")])


def dealt_counts(train: DataFrame, text: str, n_parts: int) -> DataFrame:
    """ROWS of hashes (a) and counts (b): those of pairs (both heads) for the parts from 0 on, those of words for the parts from n_parts on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes, seen = Numbers(), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def words_out() -> pa.RecordBatch:
            some = np.flatnonzero(seen)
            h, n = hashes[some], seen[some].astype(np.uint32)
            return rows_of([(n_parts + p, None, WORDS, 0, planes(h[at]), planes(n[at])) for p, at in dealt(part_of(head_of(h), n_parts))])

        def pairs_out() -> pa.RecordBatch:
            first, second, n = counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            n = n.astype(np.uint32)
            held.clear()
            return rows_of([(p, None, FILTER, 0, both_packed(first[at], second[at]), planes(n[at])) for p, at in dealt(part_of(pair_hash(first, second), n_parts))])

        for batch in batches:
            if len(known) > WORDS_BOUND:
                yield words_out()
                known, hashes, seen = Numbers(), hashes[:0], seen[:0]
            words = [END]  # what stands before the first word; not counted itself
            for t in batch.column(0):
                words += tokens(t.as_py())
            at = known.of(words)
            hashes = np.concatenate([hashes, word_hashes(known.names[len(hashes) :])])
            more = np.bincount(at[1:], minlength=len(known.names))
            more[: len(seen)] += seen
            seen = more
            h = head_of(hashes)[at]
            held.append((h[:-1], h[1:]))
            size += len(h)
            if size > PAIRS_HELD:
                yield pairs_out()
                size = 0
        if held:
            yield pairs_out()
        yield words_out()

    return map_batches(train.select(F.col(text).alias("__text")), run, ROWS)


def written_at_once(df: DataFrame, name: str, rows_per_batch: int) -> DataFrame:
    """written(), with fewer rows sent to a worker at once, as one row holds many packed ones."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_per_batch))
    try:
        return written(df, name)
    finally:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def by_part(rows: DataFrame, n_parts: int) -> DataFrame:
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_parts // 8)
    return rows.repartition(n, "part").sortWithinPartitions("part", "chunk", "kind")  # null chunks first


def filled(keys: np.ndarray, level: np.ndarray) -> Filter:
    """A filter that has all levels of each key up to its own."""
    n_blocks = max(1, math.ceil(int(level.sum()) * BITS_PER_KEY / BLOCK_BITS))
    bitmap = np.zeros(n_blocks * BLOCK_BITS, bool)
    for k in range(0, len(keys), 1 << 17):
        key, upto = keys[k : k + (1 << 17)], level[k : k + (1 << 17)]
        at = np.repeat(np.arange(len(key)), upto)
        each = np.arange(len(at)) - np.repeat(np.cumsum(upto) - upto, upto) + 1
        start = block_of(key, n_blocks)[at] * np.uint64(BLOCK_BITS)
        for place in Filter.positions(key[at], each):
            bitmap[start + place] = True
    return Filter(n_blocks, np.packbits(bitmap, bitorder="little"))


def train_model(train: DataFrame, text: str = "text") -> tuple[DataFrame, dict]:
    """The table of the model's parts (ROWS, with tokens and words), and totals.

    A part of pairs gives its filter, and for the parts of words how many pairs each first word has; a part of words gives
    their counts.
    """
    size = train.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n_parts = max(2 * int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))

    def part_out(part: int, h: np.ndarray, n: np.ndarray, first: np.ndarray) -> list[tuple]:
        if part >= n_parts:
            return [(part, None, WORDS, 0, planes(h), planes(n), int(n.sum()), len(h))]
        f = filled(keys_of(h), levels_of(n))
        heads, kinds = np.unique(first, return_counts=True)
        to = dealt(part_of(heads, n_parts))
        return [(part, None, FILTER, f.n_blocks, f.bits.tobytes(), None, 0, 0), *((n_parts + p, None, FOLLOWERS, 0, packed(heads[at], HEAD_BYTES), kinds[at].astype(np.int32).tobytes(), 0, 0) for p, at in to)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got, held = None, [], 0

        def merged() -> tuple[np.ndarray, ...]:
            return summed(*(np.concatenate(x) for x in zip(*got, strict=True)))

        def out() -> pa.RecordBatch:
            rows = part_out(now, *merged())
            base = rows_of(rows)
            return pa.RecordBatch.from_arrays([*base.columns, pa.array([r[6] for r in rows], pa.int64()), pa.array([r[7] for r in rows], pa.int64())], [*base.schema.names, "tokens", "words"])

        for batch in batches:
            for part, a, b in zip(batch.column(0).to_pylist(), batch.column(4), batch.column(5), strict=True):
                if part != now:
                    if got:
                        yield out()
                    now, got, held = part, [], 0
                if part < n_parts:
                    first, second = both_unpacked(a.as_py())
                    h = pair_hash(first, second)
                else:
                    h = first = unplaned(a.as_py(), np.uint64)
                got.append((h, unplaned(b.as_py(), np.uint32).astype(np.int64), first))
                held += len(h)
                if held > PAIRS_HELD:
                    got, held = [merged()], 0
        if got:
            yield out()

    made = map_batches(by_part(dealt_counts(train, text, n_parts), n_parts), run, ROWS + ", tokens long, words long")
    model = written_at_once(made, "language-model", 128)
    n, v = model.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    return model, {"n": n, "v": v, "n_parts": n_parts}


class Part:
    """What one part of the model knows."""

    def __init__(self) -> None:
        self.filter: Filter | None = None
        self.words = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        self.followers = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]

    def take(self, kind: int, blocks: int, a: bytes, b: bytes | None) -> None:
        if kind == FILTER:
            self.filter = Filter(blocks, np.frombuffer(a, np.uint8))
        elif kind == WORDS:
            self.words.append((unplaned(a, np.uint64), unplaned(b, np.int64)))
        else:
            self.followers.append((unpacked(a, HEAD_BYTES), np.frombuffer(b, np.int32).astype(np.int64)))

    def merge(self) -> None:
        for name in ("words", "followers"):
            both = getattr(self, name)
            if len(both) > 1:
                setattr(self, name, [summed(np.concatenate([x for x, _ in both]), np.concatenate([x for _, x in both]))])

    @staticmethod
    def found(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
        names, n = table
        if not len(names):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(names, h), len(names) - 1)
        return np.where(names[at] == h, n[at], 0)

    def pair_levels(self, raw: bytes) -> bytes:
        keys = unpacked(raw, KEY_BYTES)
        return planes((self.filter.level(keys) if self.filter else np.zeros(len(keys))).astype(np.uint16))

    def word_counts(self, raw: bytes) -> tuple[bytes, bytes]:
        self.merge()
        h = unplaned(raw, np.uint64)
        return planes(self.found(self.words[0], h)), planes(self.found(self.followers[0], head_of(h)))


class Asked:
    """The tokens of a batch of texts, and what is to be read about them."""

    def __init__(self, texts: pa.Array, n_parts: int):
        known, words, ends = Numbers(), [END], [1]
        for t in texts:
            words += tokens(t.as_py())
            ends.append(len(words))
        at = known.of(words)
        self.n, self.before, self.at = np.diff(ends), at[:-1], at[1:]
        self.words = word_hashes(known.names)
        heads = head_of(self.words)
        self.pairs, self.pair_at = np.unique(pair_hash(heads[self.before], heads[self.at]), return_inverse=True)
        self.pair_parts = list(dealt(part_of(self.pairs, n_parts)))
        self.word_parts = [(n_parts + p, to) for p, to in dealt(part_of(head_of(self.words), n_parts))]

    def rows(self, chunk: int) -> list[tuple]:
        keys = keys_of(self.pairs)
        pairs = [(p, chunk, ASKED, 0, packed(keys[to], KEY_BYTES), None) for p, to in self.pair_parts]
        return pairs + [(p, chunk, ASKED, 0, planes(self.words[to]), None) for p, to in self.word_parts]

    def answers(self, got: dict[int, tuple[bytes, bytes | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each pair's level, each word's count and number of followers; 0 for what no part knows."""
        level, c, followers = np.zeros(len(self.pairs), np.int64), np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64)
        for p, to in self.pair_parts:
            level[to] = unplaned(got[p][0], np.uint16)
        for p, to in self.word_parts:
            c[to], followers[to] = (unplaned(x, np.int64) for x in got[p])
        return level, c, followers


def score(docs: DataFrame, parts: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_tokens, n_known, train_tokens, base_score, score of every row (a kept column of such a name: NAME_kept).

    The texts are written once in chunks of a batch each, so that a chunk that gets its answers is the one that asked.
    """
    n, v, n_parts = model["n"], model["v"], model["n_parts"]
    rows, keep, schema = carried(docs, keep, text, "n_tokens long, n_known long, train_tokens long, base_score double, score double")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["data"])

    def texts_of(data: bytes) -> pa.RecordBatch:
        return pa.ipc.open_stream(data).read_next_batch()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts = texts_of(data.as_py())
                yield rows_of(Asked(texts.column(texts.num_columns - 1), n_parts).rows(chunk))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Part()
        for batch in batches:
            out = []
            for i, (part, chunk, kind, blocks) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if part != now:
                    now, held = part, Part()
                a, b = batch.column(4)[i].as_py(), batch.column(5)[i].as_py()
                if kind != ASKED:
                    held.take(kind, blocks, a, b)
                elif part < n_parts:
                    out.append((part, chunk, kind, 0, held.pair_levels(a), None))
                else:
                    out.append((part, chunk, kind, 0, *held.word_counts(a)))
            yield rows_of(out)

    def judged(data: bytes, got: dict[int, tuple[bytes, bytes | None]]) -> pa.RecordBatch:
        texts = texts_of(data)
        asked = Asked(texts.column(texts.num_columns - 1), n_parts)
        level, c, followers = asked.answers(got)
        size = len(asked.n)
        row, total = np.repeat(np.arange(size), asked.n), c[asked.before]
        p = (c[asked.at] + 0.5) / (n + 0.5 * (v + 1))
        back = np.where(total > 0, np.minimum(D * followers[asked.before] / np.maximum(total, 1), 1), 1)
        direct = np.where(total > 0, np.clip((MIDDLE[level][asked.pair_at] - D) / np.maximum(total, 1), 0, 1), 0)
        whole = SHARE * (direct + back * p) + (1 - SHARE) * p
        sums = [np.bincount(row, x, size) for x in (c[asked.at] > 0, np.log10(p), np.log10(whole))]
        made = [pa.array(asked.n), pa.array(sums[0].astype(np.int64)), pa.array(np.full(size, n, np.int64)), pa.array(sums[1]), pa.array(sums[2])]
        return pa.RecordBatch.from_arrays([*texts.columns[:-1], *made], [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, data, got = None, b"", {}
        for batch in batches:
            for i, (part, chunk) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if chunk != now:
                    if now is not None:
                        yield judged(data, got)
                    now, data, got = chunk, b"", {}
                a = batch.column(4)[i].as_py()
                if part < 0:
                    data = a
                else:
                    got[part] = (a, batch.column(5)[i].as_py())
        if now is not None:
            yield judged(data, got)

    source = map_batches(rows, pack, "data binary")
    chunks = written(source.select(F.monotonically_increasing_id().alias("chunk"), "data"), "chunks")
    asked = map_batches(chunks, ask, ROWS)
    known = parts.select(*asked.columns)
    answers = written_at_once(map_batches(by_part(known.unionByName(asked), n_parts), answer, ROWS), "answers", 32)
    own = chunks.select(F.lit(-1).cast("long").alias("part"), "chunk", F.lit(ASKED).alias("kind"), F.lit(0).cast("long").alias("blocks"), F.col("data").alias("a"), F.lit(None).cast("binary").alias("b"))
    n_tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = own.unionByName(answers).repartition(n_tasks, "chunk").sortWithinPartitions("chunk", "part")
    return map_batches(met, judge, schema)
