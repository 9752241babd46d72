"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A word's input is a hashed word vector beside the mean of its hashed character-trigram vectors; the projections of both
into the gates of the two directions are one row for each word, kept up to a bound in each worker. The network reads
windows of ``WINDOW`` words; all windows, overlapping by half, are scored, and a text's logit is that of its worst
window, calibrated on labelled texts that training left out.

Fit: at most ``POSITIVE`` and ``NEGATIVE`` labelled documents (those of the smallest hash) with all their windows, or
``TEACH_WINDOWS`` drawn ones of a longer text, so that what comes to the driver is bounded. First epochs draw
``WINDOWS_EACH`` windows of each document anew, with the document's label for all of them; later ones take the worst two
of the windows of each document, and of negative ones as many drawn ones beside, so that a toxic passage anywhere in a
text is found. Scoring covers every window of every text; a long text goes through a worker in pieces.

Edge cases: null, empty and wordless texts get the score of one blank window; texts of one window or less are padded;
rows with a null label or id teach nothing, of several labels of a document the greatest counts and of several texts the least; without any positive or
negative label every score is ``UNTRAINED``; repeated rows stay; other columns aren't read.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lumenfold.llm.common import carried, least_hashed, map_batches, written

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 8, 8, 8
WORD_ROWS, CHAR_ROWS = 1 << 14, 1 << 12
POSITIVE, NEGATIVE, WINDOWS_EACH, SEED = 2000, 4000, 10, 1
TEACH_WINDOWS = 512
LEAST_STEPS = 120
PIECE_CHARS, SCORED_WORDS = 100_000, 30_000
CACHED_WORDS = 100_000
UNTRAINED = 0.0
WORDS, GAP = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")
GATES = 3 * HIDDEN


def window_starts(n: int) -> list[int]:
    """Starts of all windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


def pieces(text: str | None) -> Iterator[tuple[list[str], list[int]]]:
    """The words of a text in pieces of some PIECE_CHARS characters, each with the starts of its own windows: in all,
    those of ``window_starts`` over the whole text, each once."""
    low, at, words = (text or "").lower(), 0, []
    while at < len(low):
        gap = GAP.search(low, at + PIECE_CHARS)
        end = gap.end() if gap else len(low)
        words += WORDS.findall(low, at, end)
        at = end
        starts = range(0, len(words) - WINDOW - STRIDE, STRIDE)  # what is left is more than a window, so the last one is whole
        if at < len(low) and starts:
            yield words, list(starts)
            words = words[len(starts) * STRIDE :]
    yield words, window_starts(len(words))


def taught(text: str | None) -> list[str]:
    """The windows of a text, each its words in a row; of more than TEACH_WINDOWS, that many drawn by the text's hash."""
    rng, n, found = np.random.default_rng(xxhash.xxh64_intdigest((text or "").encode("utf-8", "replace"))), 0, []
    for words, starts in pieces(text):
        found += [(r, n + k, " ".join(words[i : i + WINDOW])) for k, (r, i) in enumerate(zip(rng.random(len(starts)).tolist(), starts, strict=True))]
        n += len(starts)
        if len(found) > TEACH_WINDOWS:
            found = sorted(found)[:TEACH_WINDOWS]
    return [w for _, _, w in sorted(found, key=lambda f: f[1])]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's row of the word table, all its trigrams' rows of the character table, and how many those are."""
    rows = np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.int64, len(words)) % (WORD_ROWS - 1) + 1
    codes = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))  # a word of n letters between two marks has n trigrams
    starts = np.cumsum(sizes + 2) - (sizes + 2)
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    h = (codes[at] * np.uint64(0x9E3779B97F4A7C15) ^ codes[at + 1]) * np.uint64(0xBF58476D1CE4E5B9) ^ codes[at + 2]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return rows, ((h >> np.uint64(40)) % np.uint64(CHAR_ROWS)).astype(np.int64), sizes


def halves(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        make = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        d = WORD_DIM + CHAR_DIM
        self.p = {
            "words": make(WORD_ROWS, WORD_DIM, scale=0.1), "chars": make(CHAR_ROWS, CHAR_DIM, scale=0.3),
            "w": make(d, 2 * GATES, scale=d**-0.5), "b": np.zeros(2 * GATES, np.float32), "u": make(2, HIDDEN, GATES, scale=HIDDEN**-0.5),
            "att": make(2 * HIDDEN, ATTENTION, scale=0.25), "att_b": np.zeros(ATTENTION, np.float32), "att_v": make(ATTENTION, scale=0.3),
            "out": make(2 * HIDDEN, scale=0.3), "out_b": np.zeros(1, np.float32),
        }
        self.p["words"][0] = 0
        self.slope, self.shift, self.trained = 1.0, 0.0, False

    def inputs(self, rows: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        p = self.p
        chars = np.add.reduceat(p["chars"][grams], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / sizes[:, None].astype(np.float32)
        return np.concatenate([p["words"][rows], chars], axis=1)

    def forward(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """x: [words, 2 gates] projections, at: [windows, WINDOW] rows of x, mask: places that hold a word. Logits."""
        p, n = self.p, len(at)
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((WINDOW, n, 2 * HIDDEN), np.float32)
        kept = []
        for t in range(WINDOW):
            back = WINDOW - 1 - t
            xs = np.stack([x[at[:, t], :GATES], x[at[:, back], GATES:]])
            hu = np.matmul(h, p["u"])
            rz = halves(xs[..., : 2 * HIDDEN] + hu[..., : 2 * HIDDEN])
            r, z = rz[..., :HIDDEN], rz[..., HIDDEN:]
            new = np.tanh(xs[..., 2 * HIDDEN :] + r * hu[..., 2 * HIDDEN :])
            nxt = new + z * (h - new)
            if keep:
                kept.append((h, r, z, new, hu[..., 2 * HIDDEN :]))
            h = nxt
            states[t, :, :HIDDEN], states[back, :, HIDDEN:] = h[0], h[1]
        seen = np.tanh(states @ p["att"] + p["att_b"])
        weight = np.where(mask.T, seen @ p["att_v"], -1e9)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnd->nd", weight, states)
        return pooled @ p["out"] + p["out_b"][0], {"states": states, "seen": seen, "weight": weight, "pooled": pooled, "kept": kept}

    def backward(self, x: np.ndarray, at: np.ndarray, c: dict, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        p = self.p
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("words", "chars")}
        g["out"], g["out_b"][0] = c["pooled"].T @ d_logit, d_logit.sum()
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = np.einsum("nd,tnd->tn", d_pooled, c["states"])
        d_score = c["weight"] * (d_weight - (c["weight"] * d_weight).sum(0))
        d_states = c["weight"][..., None] * d_pooled
        g["att_v"] = np.einsum("tn,tna->a", d_score, c["seen"])
        d_seen = d_score[..., None] * p["att_v"] * (1 - c["seen"] ** 2)
        g["att"], g["att_b"] = np.einsum("tnd,tna->da", c["states"], d_seen), d_seen.sum((0, 1))
        d_states += d_seen @ p["att"].T
        dx, dh = np.zeros_like(x), np.zeros((2, len(at), HIDDEN), np.float32)
        for t in range(WINDOW - 1, -1, -1):
            back = WINDOW - 1 - t
            h, r, z, new, hn = c["kept"][t]
            dh = dh + np.stack([d_states[t, :, :HIDDEN], d_states[back, :, HIDDEN:]])
            d_new = dh * (1 - z) * (1 - new**2)
            d_z = dh * (h - new) * z * (1 - z)
            d_r = d_new * hn * r * (1 - r)
            d_hu = np.concatenate([d_r, d_z, d_new * r], axis=2)
            d_in = np.concatenate([d_r, d_z, d_new], axis=2)
            g["u"] += np.matmul(h.transpose(0, 2, 1), d_hu)
            dh = dh * z + np.matmul(d_hu, p["u"].transpose(0, 2, 1))
            np.add.at(dx, (at[:, t], slice(None, GATES)), d_in[0])
            np.add.at(dx, (at[:, back], slice(GATES, None)), d_in[1])
        return g, dx


def _numbered(documents: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, [windows, WINDOW] places among them from 1 on (0 is padding) of all windows, and each one's document."""
    place: dict[str, int] = {}
    at = np.zeros((sum(map(len, documents)), WINDOW), np.int32)
    for row, window in enumerate(w for own in documents for w in own):
        words = window.split()
        at[row, : len(words)] = [place.setdefault(w, len(place) + 1) for w in words]
    return list(place), at, np.repeat(np.arange(len(documents)), [len(own) for own in documents])


def fit(documents: list[list[str]], labels: np.ndarray, epochs: tuple[int, int] = (2, 2), batch: int = 256, rate: float = 0.01) -> Network:
    """documents: the windows of each, as of ``taught``, with its label."""
    net, rng = Network(), np.random.default_rng(SEED)
    if not len(documents) or labels.min() == labels.max():
        return net
    net.trained = True
    names, at, docs = _numbered(documents)
    labels = labels[docs]
    mask = at > 0
    mask[:, 0] = True
    rows, grams, sizes = features(names)
    starts = np.cumsum(sizes) - sizes
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    steps = 0

    def project(used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the words (from 0) used: projections with a padding row first, inputs, trigrams, sizes."""
        s = sizes[used]
        own = np.repeat(starts[used] - np.concatenate([[0], np.cumsum(s)[:-1]]), s) + np.arange(s.sum())
        vec = net.inputs(rows[used], grams[own], s)
        return np.concatenate([np.zeros((1, 2 * GATES), np.float32), vec @ net.p["w"]]) + net.p["b"], vec, grams[own], s

    def step(some: np.ndarray) -> None:
        nonlocal steps
        used, inverse = np.unique(at[some], return_inverse=True)
        inverse = inverse.reshape(len(some), WINDOW) + (used[0] != 0)
        used = used[used > 0] - 1
        x, vec, own, s = project(used)
        logit, c = net.forward(x, inverse, mask[some], keep=True)
        d = ((halves(logit) - labels[some]) / len(some)).astype(np.float32)
        g, dx = net.backward(x, inverse, c, d)
        g["w"], g["b"] = vec.T @ dx[1:], dx.sum(0)
        d_vec = dx[1:] @ net.p["w"].T
        g["words"], g["chars"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["chars"])
        np.add.at(g["words"], rows[used], d_vec[:, :WORD_DIM])
        np.add.at(g["chars"], own, np.repeat(d_vec[:, WORD_DIM:] / s[:, None], s, axis=0).astype(np.float32))
        steps += 1
        for k, v in net.p.items():
            m1, m2 = moments[k]
            m1 += 0.1 * (g[k] - m1)
            m2 += 0.001 * (g[k] ** 2 - m2)
            v -= rate * (m1 / (1 - 0.9**steps)) / (np.sqrt(m2 / (1 - 0.999**steps)) + 1e-8)

    def logits() -> np.ndarray:
        x = project(np.arange(len(names)))[0]
        return np.concatenate([net.forward(x, at[i : i + 2048], mask[i : i + 2048])[0] for i in range(0, len(at), 2048)])

    def firsts(by: np.ndarray, n: int) -> np.ndarray:
        """The first n windows of each document, in the order of by, which has a document's windows together."""
        new = np.concatenate([[True], docs[by][1:] != docs[by][:-1]])
        where = np.arange(len(by))
        return by[where - np.maximum.accumulate(np.where(new, where, 0)) < n]

    def drawn() -> np.ndarray:
        return firsts(np.lexsort((rng.random(len(at)), docs)), WINDOWS_EACH)

    def chosen() -> np.ndarray:
        some = drawn()
        return np.union1d(firsts(np.lexsort((-logits(), docs)), 2), some[labels[some] == 0])

    for part, n in enumerate(epochs):
        first, done = steps, 0
        while done < n or steps - first < LEAST_STEPS:  # small samples are gone through more often
            use = rng.permutation(chosen() if part else drawn())
            for i in range(0, len(use), batch):
                step(use[i : i + batch])
            done += 1
    return net


class Scorer:
    """Worst-window logits of texts."""

    def __init__(self, net: Network):
        self.net = net
        self.reset()

    def reset(self) -> None:
        self.row: dict[str, int] = {}
        self.x = np.zeros((1024, 2 * GATES), np.float32)
        self.x[0] = self.net.p["b"]  # padding

    def learn(self, words: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(w for w in words if w not in self.row))
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            first = len(self.row) + 1
            while first + len(some) > len(self.x):
                self.x = np.concatenate([self.x, np.zeros_like(self.x)])
            self.x[first : first + len(some)] = self.net.inputs(*features(some)) @ self.net.p["w"] + self.net.p["b"]
            self.row.update(zip(some, range(first, first + len(some)), strict=True))
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        out, words, spans = np.full(len(texts), -np.inf), [], []
        for at, text in enumerate(texts):
            for own, starts in pieces(text):
                spans.append((at, min(WINDOW, len(own)), len(words) + np.array(starts)))
                words += own
                if len(words) >= SCORED_WORDS:
                    self._worst(out, words, spans)
                    words, spans = [], []
        if spans:
            self._worst(out, words, spans)
        return out

    def _worst(self, out: np.ndarray, words: list[str], spans: list[tuple[int, int, np.ndarray]]) -> None:
        """Raises out to the logits of the windows; spans: a text's place in out, its windows' size and their starts in words."""
        if len(self.row) > CACHED_WORDS:
            self.reset()
        rows = self.learn(words)  # may make self.x anew
        x = np.concatenate([self.x[rows], self.x[:1]])  # the last row is padding
        many = [len(starts) for _, _, starts in spans]
        owner, size = (np.repeat([s[k] for s in spans], many) for k in (0, 1))
        start = np.concatenate([starts for _, _, starts in spans])
        for i in range(0, len(start), 2048):
            s, n = start[i : i + 2048], size[i : i + 2048]
            mask = np.arange(WINDOW) < n[:, None]
            where = np.where(mask, s[:, None] + np.arange(WINDOW), len(x) - 1)
            mask[:, 0] = True
            np.maximum.at(out, owner[i : i + 2048], self.net.forward(x, where, mask)[0])


def with_logits(docs: DataFrame, net: Network, text: str, keep: tuple[str, ...]) -> DataFrame:
    rows, keep, schema = carried(docs, keep, text, "logit double")
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))  # a size fixed by the network's shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(shared.value))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scorer.logits(batch.column(batch.num_columns - 1).to_pylist()), pa.float64())], [*keep, "logit"])

    return map_batches(rows, run, schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", positive: int = POSITIVE, negative: int = NEGATIVE, text: str = "text", doc_id: str = "doc_id") -> Network:
    """docs: those to learn from; labels: doc_id and label."""
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg((F.max(label) > 0).cast("int").alias("__label"))
    known = known.join(docs.select(F.col(doc_id).alias("__id")).distinct(), "__id")
    by, sizes = F.xxhash64(F.lit(SEED), F.col("__id")), known.agg(F.count_if(F.col("__label") == 1), F.count_if(F.col("__label") == 0)).first()
    chosen = least_hashed(known.filter("__label = 1"), by, positive, sizes[0], "__id").unionByName(least_hashed(known.filter("__label = 0"), by, negative, sizes[1], "__id"))
    sample = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id").groupBy("__id", "__label").agg(F.min("__text").alias("__text"))
    sample = written(sample.select("__id", "__label", F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("__id")), F.lit(5)).alias("__part"), "__text"), "toxic-sample")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(map(taught, batch.column(batch.num_columns - 1).to_pylist())), pa.list_(pa.string()))], ["__id", "__label", "windows"])

    schema = StructType([*known.schema.fields, StructField("windows", ArrayType(StringType()))])
    rows = map_batches(sample.filter("__part <> 0").select("__id", "__label", "__text"), windows, schema).collect()  # at most TEACH_WINDOWS windows a document
    rows = sorted(rows, key=lambda r: r[0])
    net = fit([r[2] for r in rows], np.array([r[1] for r in rows], np.float32))
    if net.trained:
        held = with_logits(sample.filter("__part = 0").withColumnRenamed("__label", "label"), net, "__text", ("label",)).collect()
        calibrate(net, np.array([r.logit for r in held]), np.array([r.label for r in held], float))
    return net


def calibrate(net: Network, logit: np.ndarray, label: np.ndarray, rounds: int = 50) -> None:
    """Slope and shift of the logits by Newton steps, with one made-up example of each label against separation."""
    if not len(logit):
        return
    x, y = np.concatenate([logit, [-4.0, 4.0]]), np.concatenate([label, [0.0, 1.0]])
    a, b = 1.0, 0.0
    for _ in range(rounds):
        q = halves(a * x + b)
        s = np.maximum(q * (1 - q), 1e-6)
        grad = np.array([((y - q) * x).sum() - 0.1 * (a - 1), (y - q).sum()])
        hess = np.array([[(s * x * x).sum() + 0.1, (s * x).sum()], [(s * x).sum(), s.sum()]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -2, 2))
    if a > 0:
        net.slope, net.shift = a, b


def predict(docs: DataFrame, net: Network, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns (one named score, predicted or logit: NAME_kept), score, predicted."""
    rows, keep, _ = carried(docs, keep, text, "logit double, score double, predicted int")
    if not net.trained:
        return rows.select(*keep, F.lit(UNTRAINED).alias("score"), F.lit(0).alias("predicted"))
    scored = with_logits(rows, net, "__text", keep).select(*keep, (1 / (1 + F.exp(-(F.col("logit") * net.slope + net.shift)))).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
