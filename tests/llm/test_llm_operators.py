"""The training-data operators against brute force, and on nulls, empty texts, ties, repeats, empty tables and clashing names."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenfold.llm import ann, bloom_lm, common, compaction, components, language_id, merkle, mixing, near_dedup, sentencepiece_bpe, simhash, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, logit string, fp long, word string"


def tokenizer():
    from lumenfold.llm.queries import tokenizer_path

    return tokenizer_path()


def rows_of(texts, langs=None):
    return [(i, t, (langs[i] if langs else "en"), f"s{i % 3}" if i % 7 else None, len(t) if t else None, 1.0, "x", 2, "w") for i, t in enumerate(texts)]


ODD = [None, "", " \t\n", "a", "Word", "word", "word", "ß İ é 中文 🤣", "no-break here", "x" * 30_000, "the cat " * 4000, "1234 5678", "same text of some words here", "same text of some words here"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd") / "docs")
    spark.createDataFrame(rows_of(ODD), DOCS).repartition(3).write.parquet(at)
    return spark.read.parquet(at)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def corpus(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    vocab = {"en": "the of and to in that with from this are".split(), "de": "der die und nicht mit von eine auch sich über".split()}
    insults = ["moron", "scum", "loser"]
    rows, labels = [], []
    for i in range(n):
        lang = ("en", "de")[i % 2]
        words = rng.choice(vocab[lang], rng.integers(5, 120)).tolist()
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(1 + len(words) // 15):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(insults)))
        rows.append((i, " ".join(words), lang, "s", None, None, None, None, None))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


# 1 toxicity


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, at = rng.standard_normal((20, 2 * toxicity.GATES)), rng.integers(0, 20, (4, toxicity.WINDOW))
    mask = rng.random(at.shape) > 0.2
    mask[:, 0] = True
    y = np.array([0.0, 1.0, 1.0, 0.0])

    def loss():
        logit, c = net.forward(x, at, mask, keep=True)
        return np.mean(np.logaddexp(0, logit) - y * logit), logit, c

    _, logit, c = loss()
    g, dx = net.backward(x, at, c, (toxicity.halves(logit) - y) / len(y))
    for grad, value in [(g[k], net.p[k]) for k in ("u", "att", "att_b", "att_v", "out")] + [(dx, x)]:
        flat, where = value.reshape(-1), rng.integers(0, value.size, 4)
        for w in where:
            keep = flat[w]
            flat[w] = keep + 1e-3
            up = loss()[0]
            flat[w] = keep - 1e-3
            down = loss()[0]
            flat[w] = keep
            assert abs((up - down) / 2e-3 - grad.reshape(-1)[w]) < 2e-4


def test_toxicity_forward_against_plain_loops():
    """The network word by word, as it is defined, on one window."""
    rng, net = np.random.default_rng(3), toxicity.Network()
    words, h = "some words of a window stand here".split(), toxicity.HIDDEN
    p = {k: v.astype(float) for k, v in net.p.items()}
    own = []
    for w in words:
        rows, grams, _ = toxicity.features([w])
        own.append(np.concatenate([p["words"][rows[0]], np.mean([p["chars"][g] for g in grams], axis=0)]) @ p["w"] + p["b"])
    own += [p["b"]] * (toxicity.WINDOW - len(words))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    states = np.zeros((toxicity.WINDOW, 2 * h))
    for way, order in ((0, range(toxicity.WINDOW)), (1, reversed(range(toxicity.WINDOW)))):
        s = np.zeros(h)
        for t in order:
            x, u = own[t][way * 3 * h : (way + 1) * 3 * h], s @ p["u"][way]
            r, z = sigmoid(x[:h] + u[:h]), sigmoid(x[h : 2 * h] + u[h : 2 * h])
            s = (1 - z) * np.tanh(x[2 * h :] + r * u[2 * h :]) + z * s
            states[t, way * h : (way + 1) * h] = s
    score = np.tanh(states[: len(words)] @ p["att"] + p["att_b"]) @ p["att_v"]
    weight = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
    want = (weight @ states[: len(words)]) @ p["out"] + p["out_b"][0]
    assert abs(toxicity.Scorer(net).logits([" ".join(words)])[0] - want) < 1e-4
    many = rng.choice(words, 100).tolist()
    each = [toxicity.Scorer(net).logits([" ".join(many[k : k + toxicity.WINDOW])])[0] for k in toxicity.window_starts(100)]
    assert abs(toxicity.Scorer(net).logits([" ".join(many)])[0] - max(each)) < 1e-4


def test_toxicity_learns_the_least_of_several_texts(spark):
    docs, labels = spark.createDataFrame([(i, t) for i in range(40) for t in (f"z odd {i}", f"{'bad' if i % 2 else 'fine'} words {i}")], "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    nets = [toxicity.train(docs.repartition(n), labels) for n in (1, 3)]
    assert all(np.array_equal(nets[0].p[k], nets[1].p[k]) for k in nets[0].p)


def test_toxicity_learns_and_covers_whole_texts(spark):
    docs, labels = corpus(spark)
    net = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.predict(docs, net).collect()}
    assert np.mean([got[i].predicted == int(i % 5 == 0) for i in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    words = " ".join(["the of and to in that"] * 400)
    last = spark.createDataFrame([(1, words), (2, words + " moron scum loser moron scum loser")], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.predict(last, net).collect()}
    assert scores[2] > 0.5 > scores[1]
    assert toxicity.window_starts(5) == [0] and toxicity.window_starts(70) == [0, 16, 32, 38]


def test_toxicity_pieces_hold_each_window_once(monkeypatch):
    rng = np.random.default_rng(2)
    for chars in (1, 50, 333, 5000):
        monkeypatch.setattr(toxicity, "PIECE_CHARS", chars)
        for n in (0, 1, 31, 32, 33, 47, 48, 49, 64, 65, 80, 81, 97, 500):
            words = ["".join(rng.choice(list("abÄß"), rng.integers(1, 9))).lower() for _ in range(n)]
            text = "".join(w + rng.choice([" ", "7", "_. ", "\n\n"]) for w in words) + ("tail" if n % 2 else "")
            words += ["tail"] if n % 2 else []
            got = [tuple(own[i : i + toxicity.WINDOW]) for own, starts in toxicity.pieces(text) for i in starts]
            assert got == [tuple(words[i : i + toxicity.WINDOW]) for i in toxicity.window_starts(len(words))], (chars, n)
    assert list(toxicity.pieces(None)) == [([], [0])]


def test_toxicity_bounds_what_one_text_takes(monkeypatch):
    text = " ".join(f"{a}{b}" for a in "abcdefghij" for b in ["word"] * 2000)
    windows = toxicity.taught(text)
    assert len(windows) == toxicity.TEACH_WINDOWS and windows == toxicity.taught(text) and all(len(w.split()) == toxicity.WINDOW for w in windows)
    assert len({w[0] for w in windows}) == 10 and windows == sorted(windows)  # drawn from all of the text, in its order
    few = " ".join(text.split()[:500])
    assert toxicity.taught(few) == [" ".join(few.split()[i : i + 32]) for i in toxicity.window_starts(500)] and toxicity.taught("") == toxicity.taught(None) == [""]
    net, sizes = toxicity.Network(), []
    scorer = toxicity.Scorer(net)
    learn = scorer.learn
    monkeypatch.setattr(scorer, "learn", lambda words: (sizes.append(len(words)), learn(words))[1])
    long = " ".join([*(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(300_000)), *["worst"] * 40])
    got = scorer.logits([long, "worst " * 32, None])
    assert max(sizes) < 60_000 and len(sizes) == 7  # words of three letters, 50,000 in a piece
    assert got[0] >= got[1] - 1e-4  # its last windows are scored too


def test_toxicity_edges(spark, odd, none):
    net = toxicity.train(odd, spark.createDataFrame([(3, 1), (4, 0), (5, None), (6, 1), (6, 0), (7, 0), (99, 1)], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.predict(odd, net).collect()}
    assert len(got) == len(ODD) and got[0] == got[1] == got[2]
    untaught = toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.predict(odd, untaught).collect()} == {toxicity.UNTRAINED}
    assert toxicity.predict(none, net).count() == 0


# 2 Merkle


def test_merkle_locates_edits():
    text = "\n".join(f"Paragraph {i} holds a sentence. And another one of it, number {i * 7}." for i in range(200))
    at = text.index("Paragraph 120")
    edited = text[:at] + "CHANGED " + text[at:]
    a, b = merkle.Tree(text), merkle.Tree(edited)
    assert a.root != b.root and merkle.Tree(text).root == a.root
    spans = merkle.changed(a.fingerprint(), b.fingerprint())
    assert len(spans) == 1 and spans[0][0] <= at + 8 <= spans[0][1] and spans[0][1] - spans[0][0] < 200
    assert merkle.changed(a.fingerprint(), merkle.Tree(text).fingerprint()) == []
    assert merkle.likeness(a.fingerprint(), b.fingerprint()) > 0.97
    assert merkle.likeness(merkle.Tree("").fingerprint(), merkle.Tree("").fingerprint()) == 1.0
    assert merkle.likeness(merkle.Tree("").fingerprint(), merkle.Tree("abc").fingerprint()) == 0.0
    for t in ("", "\n", "a\n\nb", "x" * 1000, "no end"):
        assert "".join(t[s:e] for _, ps in merkle.Tree(t).sections for _, ls in ps for _, s, e in ls) == t


def brute_likeness(a, b):
    """By all leaves of both texts, without a tree."""
    leaves = [collections.Counter((d, e - s) for _, ps in merkle.Tree(t).sections for _, ls in ps for d, s, e in ls) for t in (a, b)]
    both = sum(n * size for (_, size), n in (leaves[0] & leaves[1]).items())
    return 1.0 if a == b else 2 * both / (len(a) + len(b)) if a or b else 1.0


def test_merkle_likeness_and_spans_against_brute_force():
    rng = np.random.default_rng(11)
    lines = [f"Line {i} says a thing. Then it says {i * i} more; and ends dry, or so." for i in range(60)] + ["", "x" * 400, "short"]
    for _ in range(60):
        a = "\n".join(rng.choice(lines, rng.integers(0, 40)).tolist())
        at, end = sorted(rng.integers(0, len(a) + 1, 2).tolist())
        b = rng.choice([a[:at] + "EDIT" + a[end:], a[:at] + a[end:], a[at:] + a[:at], "\n".join(rng.choice(lines, 9).tolist())])
        p, q = merkle.Tree(a).fingerprint(), merkle.Tree(str(b)).fingerprint()
        assert merkle.n_chars_of(p) == len(a) and math.isclose(merkle.likeness(p, q), brute_likeness(a, str(b)), abs_tol=1e-12)
        left = collections.Counter((d, e - s) for _, ps in merkle.Tree(a).sections for _, ls in ps for d, s, e in ls)
        new = sum(n * size for (_, size), n in (collections.Counter((d, e - s) for _, ps in merkle.Tree(str(b)).sections for _, ls in ps for d, s, e in ls) - left).items())
        assert sum(e - s for s, e in merkle.changed(p, q)) == new


def brute_edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_merkle_edits_against_brute_force(spark, odd, none, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 7)
    got = merkle.against_edits(odd).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == brute_edits(list(enumerate(ODD)))
    many = [(i * 3 % 101, f"text {i} " * (i % 9)) for i in range(101)]
    got = merkle.against_edits(spark.createDataFrame(many, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == brute_edits(many)
    by = {r.doc_id: r for r in merkle.against_edits(odd).collect()}
    assert by[10].near_edited == brute_likeness(ODD[10], ODD[10][: len(ODD[10]) - len(ODD[10]) // 2] + ODD[11][: len(ODD[10]) // 2])
    assert all(0 <= x.start < x.end for r in by.values() for x in r.edited_spans)
    assert by[12].fingerprint == by[13].fingerprint and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in by.values())
    assert merkle.against_edits(none).count() == 0
    repeated = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (1, "a")], "doc_id long, text string")
    assert merkle.against_edits(repeated).count() == 4
    assert merkle.fingerprints(odd).count() == len(ODD)


# 3 compaction


def test_compaction_keeps_rows_and_versions(spark, odd, none, tmp_path):
    store = compaction.Store(spark, str(tmp_path / "store"))
    assert store.manifest()["version"] == 0 and store.compact() == 0
    v1 = store.append(odd, rows_per_shard=2)
    store.append(odd, rows_per_shard=2)
    n = len(store.manifest()["shards"])
    v3 = store.compact(target=1 << 20)
    assert v3 == 3 and len(store.manifest()["shards"]) < n
    key = lambda df: sorted(str(r) for r in df.collect())
    assert key(store.read()) == key(odd.unionByName(odd)) and key(store.read(v1)) == key(odd)
    assert store.members("doc_id").count() == 2 * len(ODD)
    assert store.append(none) == 4 and store.read().count() == 2 * len(ODD)
    with pytest.raises(ValueError):
        store.append(odd.drop("fp"))
    assert not store._commit(4, "", [])  # a version that is there isn't written again
    assert store.vacuum() == 0  # too young: a writer may be about to name them
    assert store.vacuum(grace_s=0) > 0 and key(store.read()) == key(odd.unionByName(odd))


def test_compaction_keeps_columns_of_any_name(spark, tmp_path):
    names = ["merge", "file", "__file", "_metadata", "shard", "Merge_"]
    rows = spark.createDataFrame([tuple(f"{n}{i}" for n in names) for i in range(12)], ", ".join(f"`{n}` string" for n in names))
    store = compaction.Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        store.append(rows, rows_per_shard=2)
    store.compact(force=True)
    got = store.read()
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(2 * [tuple(r) for r in rows.collect()])
    assert sorted(r[0] for r in store.members("merge").collect()) == sorted(2 * [f"merge{i}" for i in range(12)])


def test_compaction_plan():
    mk = lambda *sizes: [compaction.Shard(f"f{i}", s, i) for i, s in enumerate(sizes)]
    assert compaction.plan(mk(10, 10, 10), 1000, 4) == []
    groups = compaction.plan(mk(*[100_000] * 9), 400_000, 4)
    assert [len(g) for g in groups] == [4, 4]
    assert compaction.plan(mk(300_000, 350_000), 400_000, 4) == []  # sealed
    assert [len(g) for g in compaction.plan(mk(10, 200_000), 400_000, 4, force=True)] == [2]


# 4 language model


def test_bloom_filter_levels():
    rng = np.random.default_rng(0)
    keys, level = rng.integers(0, 2**63, 2000, dtype=np.uint64), rng.integers(1, 60, 2000)
    f = bloom_lm.Filter(math.ceil(level.sum() * bloom_lm.BITS_PER_KEY / bloom_lm.BLOCK_BITS))
    at = np.repeat(np.arange(2000), level)
    each = np.arange(len(at)) - np.repeat(np.cumsum(level) - level, level) + 1
    for place in bloom_lm.Filter.positions(keys[at], each):
        p = bloom_lm.block_of(keys[at], f.n_blocks) * np.uint64(bloom_lm.BLOCK_BITS) + place
        np.bitwise_or.at(f.bits, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
    got = f.level(keys)
    assert (got >= level).all() and (got == level).mean() > 0.9
    assert (f.level(rng.integers(0, 2**63, 5000, dtype=np.uint64)) == 0).mean() > 0.93


def test_bloom_lm_against_brute_force(spark, odd, none, monkeypatch):
    monkeypatch.setattr(bloom_lm, "WORDS_BOUND", 8)  # so that counts of words and pairs are sent on and summed in their parts
    monkeypatch.setattr(bloom_lm, "PAIRS_HELD", 50)
    docs = odd.unionByName(corpus(spark, 60)[0].withColumn("doc_id", F.col("doc_id") + 100))
    train = docs.filter(common.fold(F.col("doc_id"), 5) != 1)
    words, model = bloom_lm.train_model(train)
    got = {r.doc_id: r for r in bloom_lm.score(docs, words, model).collect()}
    rows = docs.select("doc_id", "text").collect()
    count = collections.Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            count.update(bloom_lm.tokens(r.text))
    n, v = sum(count.values()), len(count)
    assert len(got) == len(rows)
    for r in rows:
        t = bloom_lm.tokens(r.text)
        g = got[r.doc_id]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(t), sum(w in count for w in t), n)
        assert math.isclose(g.base_score, base, rel_tol=1e-9) and g.score <= 1e-9
    shared = "this very sentence stands in many of the texts and its words follow each other"
    texts = [(i, f"w{i * 7 % 31} w{i * 5 % 37} {shared} w{i * 3 % 41}") for i in range(200)]
    many = spark.createDataFrame(texts, "doc_id long, text string")
    held = common.fold(F.col("doc_id"), 5) == 1
    words, model = bloom_lm.train_model(many.filter(~held))
    assert all(r.score > r.base_score + 5 for r in bloom_lm.score(many.filter(held), words, model).collect())
    words, model = bloom_lm.train_model(none)
    assert bloom_lm.score(none, words, model).count() == 0
    bare = bloom_lm.score(odd, words, model).collect()
    assert len(bare) == len(ODD) and {r.train_tokens for r in bare} == {0}


def test_bloom_lm_keeps_every_pair(spark):
    """Pairs that occur once, and as rare a pair whatever the size of the corpus, are read with their counts."""
    rare = [(i, f"left{i} right{i}") for i in range(300)]
    often = [(1000 + i, " ".join(["all the same"] * 200)) for i in range(20)]
    docs = spark.createDataFrame(rare + often, "doc_id long, text string")
    parts, model = bloom_lm.train_model(docs)
    n, v = model["n"], model["v"]
    p = 1.5 / (n + 0.5 * (v + 1))
    end = (320 + 0.5) / (n + 0.5 * (v + 1))
    first = 0.5 * (0.5 / 320 + bloom_lm.D * 301 / 320 * p) + 0.5 * p
    want = math.log10(first) + math.log10(0.5 * (0.5 + 0.5 * p) + 0.5 * p) + math.log10(0.5 * (0.5 + 0.5 * end) + 0.5 * end)
    got = [r.score for r in bloom_lm.score(docs, parts, model).filter("doc_id < 1000").collect()]
    assert len(got) == 300 and sum(math.isclose(g, want, rel_tol=1e-9) for g in got) > 270  # the others meet a false positive
    assert all(g >= want - 1e-9 for g in got)


def test_bloom_lm_score_against_brute_force(spark, odd):
    """Scores of ordinary texts, with repeated words and pairs, from a plain count of all pairs."""
    docs = odd.unionByName(corpus(spark, 120)[0].withColumn("doc_id", F.col("doc_id") + 100))
    texts = {r.doc_id: bloom_lm.tokens(r.text) for r in docs.select("doc_id", "text").collect()}
    taught = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    words, pairs = collections.Counter(w for t in taught for w in t), collections.Counter(p for t in taught for p in zip([b"", *t], t))  # noqa: B905
    followers = collections.Counter(v for v, _ in pairs)
    n, v = sum(words.values()), len(words)

    def read(count):  # what a count is after it was quantised
        least = max((x for x in bloom_lm.LEVELS if x <= count), default=0)
        after = next(x for x in bloom_lm.LEVELS if x > least)
        return math.sqrt(least * (after - 1)) if least else 0

    def chance(before, w):
        base, total = (words[w] + 0.5) / (n + 0.5 * (v + 1)), words[before]
        if not total:
            return base
        direct = min(max((read(pairs[before, w]) - bloom_lm.D) / total, 0), 1)
        return 0.5 * (direct + min(bloom_lm.D * followers[before] / total, 1) * base) + 0.5 * base

    parts, model = bloom_lm.train_model(docs.filter(common.fold(F.col("doc_id"), 5) != 1))
    got = {r.doc_id: r.score for r in bloom_lm.score(docs, parts, model).collect()}
    want = {i: sum(math.log10(chance(a, b)) for a, b in zip([b"", *t], t)) for i, t in texts.items()}  # noqa: B905
    assert got.keys() == want.keys()
    assert all(got[i] >= want[i] - 1e-6 for i in want)  # the filter forgets nothing
    exact = [i for i in want if math.isclose(got[i], want[i], rel_tol=1e-9)]
    assert any(zlib.crc32(str(i).encode()) % 5 == 1 for i in exact) and len(exact) > len(want) / 2


def test_bloom_lm_tells_many_followers_apart():
    """Two million followers of one word, and as many words that never follow it."""
    heads = bloom_lm.head_of(bloom_lm.word_hashes([b"w%d" % i for i in range(4_000_000)]))
    first = np.full(len(heads), bloom_lm.head_of(bloom_lm.word_hashes([b"the"]))[0])
    h = bloom_lm.pair_hash(first, heads)
    had, other = h[:2_000_000], h[2_000_000:]
    assert len(np.unique(had)) > 0.9999 * len(had) and np.isin(other, had).mean() < 0.0001
    one, two, n = bloom_lm.counted(np.tile(first[:1000], 3), np.tile(heads[:1000], 3))
    assert n.sum() == 3000 and len(n) == 1000 and np.array_equal(bloom_lm.pair_hash(one, two)[np.argsort(two)], h[:1000][np.argsort(heads[:1000])])
    back = bloom_lm.both_unpacked(bloom_lm.both_packed(one, two))
    assert np.array_equal(back[0], one) and np.array_equal(back[1], two)


# 5 mixing


def test_mixing_solver():
    tokens = {"a": 1_000_000, "b": 10_000, "c": 100}
    e = mixing.solve(tokens, limit=3.0, budget=500_000.0)
    times = mixing.repetitions(tokens, mixing.weights_of(tokens, e), 500_000.0)
    assert max(times.values()) <= 3.0 + 1e-6 and mixing.solve(tokens, limit=1e9, budget=10.0) == 0.0
    e = mixing.solve(tokens, entropy=1.0)
    assert abs(mixing.entropy_of(mixing.weights_of(tokens, e)) - 1.0) < 1e-6
    assert mixing.solve({"a": 0}) == 1.0 and mixing.solve({}) == 1.0


def test_mixing_realises_weights(spark, odd, none):
    rows = [(i, "w " * (1 + i % 5), None, "big" if i < 900 else "small", None, None, None, None, None) for i in range(1000)]
    docs = spark.createDataFrame(rows, DOCS)
    tokens = {"big": sum(1 + i % 5 for i in range(900)), "small": sum(1 + i % 5 for i in range(900, 1000))}
    got = mixing.mix(docs, limit=4.0, budget=3000.0, block_tokens=100).collect()
    taken = collections.Counter()
    for r in got:
        taken[r.source] += len(r.text.split())
    want = mixing.weights_of(tokens, mixing.solve(tokens, 4.0, None, 3000.0))
    assert all(abs(taken[s] - want[s] * 3000) <= 5 for s in tokens)
    assert max(collections.Counter((r.doc_id, r.__getitem__("__epoch")) for r in got).values()) == 1
    times = collections.Counter(r.doc_id for r in got)
    assert max(times[i] for i in range(900, 1000)) - min(times[i] for i in range(900, 1000)) <= 1
    # Which rows: of each source whole epochs of all its texts, and of the last one the texts before the cut in (block, place).
    for s in tokens:
        own = [r for r in got if r.source == s]
        last = max(r["__epoch"] for r in own)
        assert all(sum(r["__epoch"] == e for r in own) == (900 if s == "big" else 100) for e in range(last))
        everything = mixing.mix(docs.filter(F.col("source") == s), limit=1e9, budget=float((last + 1) * tokens[s]), block_tokens=100).filter(F.col("__epoch") == last).collect()
        order = sorted(everything, key=lambda r: (r["__block"], r["__place"]))
        n = sum(r["__epoch"] == last for r in own)
        assert {r.doc_id for r in own if r["__epoch"] == last} == {r.doc_id for r in order[:n]}
    every = mixing.mix(docs, limit=1.5)
    assert every.select("doc_id").distinct().count() == 1000 and every.columns[:9] == docs.columns
    assert {r.doc_id for r in mixing.mix(odd, limit=2.0).collect()} == set(range(len(ODD)))
    assert mixing.mix(none, limit=2.0).count() == 0


# 6 SimHash


def brute_fingerprint(text):
    words = common.ascii_words(text)
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hs = [xxhash.xxh64(p, seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def test_simhash_against_brute_force(spark, odd, none):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    fps = [int(f) ^ (1 << int(a)) ^ (1 << int(b)) for f in base for a, b in rng.integers(0, 62, (4, 2))] + [int(f) for f in base] + [0, 0, 3, 7]
    prints = spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.near_components(prints).collect()}
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert all(got[f] == root(i) for i, f in enumerate(fps))
    made = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(odd).collect()}
    assert made == {i: brute_fingerprint(t) for i, t in enumerate(ODD)}
    joined = simhash.fingerprints(odd)
    assert joined.join(simhash.near_components(joined), "fp").count() == len(ODD)
    assert simhash.near_components(simhash.fingerprints(none)).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.u: r.root for r in components.components(chain).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


def test_bk_tree():
    rng = np.random.default_rng(3)
    tree, values = simhash.BKTree(), rng.integers(0, 1 << 14, 500).tolist()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert {tree.values[i] for i in tree.near(v, 2)} == {w for w in values if (v ^ w).bit_count() <= 2}


def test_near_dedup_against_brute_force(spark, odd, none, tmp_path):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(3000)]
    texts = []
    for g in range(30):
        words = rng.choice(vocab, 150).tolist()
        for _ in range(6):
            copy = list(words)
            for at in rng.integers(0, 150, rng.integers(0, 12)):
                copy[at] = str(rng.choice(vocab))
            texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), "", None, "", "one two", "one  two", "two one"]
    at = str(tmp_path / "docs")
    spark.createDataFrame(rows_of(texts), DOCS).repartition(3).write.parquet(at)
    kept = {r.doc_id for r in near_dedup.deduplicate(spark.read.parquet(at)).collect()}
    sets = []
    for t in texts:
        w = common.ascii_words(t)
        sets.append(frozenset(simhash.shingles(w, 5)))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if sets[i] == sets[j] or (union and len(sets[i] & sets[j]) >= 0.8 * union):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert kept == {i for i in range(len(texts)) if root(i) == i}
    assert near_dedup.deduplicate(odd).columns == odd.columns
    assert {r.doc_id for r in near_dedup.deduplicate(odd).collect()} == {0, 3, 4, 7, 8, 9, 10, 11, 12}
    assert near_dedup.deduplicate(none).count() == 0


def test_near_pairs_around_the_bound(spark, tmp_path):
    """Families whose pairs lie on both sides of the bound, held against brute force."""
    rng = np.random.default_rng(12)
    vocab = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(8):
        words = rng.choice(vocab, 1000).tolist()
        for _ in range(12):
            copy = list(words)
            for at in rng.integers(0, 1000, 12 + rng.integers(0, 14)):
                copy[at] = str(rng.choice(vocab))
            texts.append(" ".join(copy))
    at = str(tmp_path / "docs")
    spark.createDataFrame(rows_of(texts), DOCS).repartition(3).write.parquet(at)
    kept = {r.doc_id for r in near_dedup.deduplicate(spark.read.parquet(at)).collect()}
    sets = [set(simhash.shingles(common.ascii_words(x), 5)) for x in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    assert kept == {i for i, x in enumerate(root) if x == i}


def test_near_pair_of_far_fingerprints(spark):
    """Texts whose sets are near though one repeats a passage 200 times; and small sets, whose fingerprints differ most."""
    rng = np.random.default_rng(8)
    pairs = []
    for i in range(12):
        article, footer = [f"a{i}_{k}" for k in range(100)], [f"f{i}_{k}" for k in range(24)]
        pairs.append((article + footer * 2, article + footer * 200))
    texts = [" ".join(x) for p in pairs for x in p]
    docs = spark.createDataFrame(rows_of(texts), DOCS)
    assert {r.doc_id for r in near_dedup.deduplicate(docs).collect()} == set(range(0, 24, 2))
    for _ in range(5000):
        five = np.unique(rng.integers(0, 2**63, 5, dtype=np.uint64)) * np.uint64(2) + np.uint64(1)
        shard = near_dedup.Shard()
        shard.add(simhash.fingerprint(five[:4]), five[:4])
        assert shard.add(simhash.fingerprint(five), five) == [0]


def test_near_shard_against_brute_force():
    """600 near copies around the bound, five seeds: the groups of a shard are those of all pairs, also with known labels."""
    for seed in range(5):
        rng = np.random.default_rng(seed)
        bases = [rng.integers(0, 2**63, 300, dtype=np.uint64) for _ in range(3)]
        sets = []
        for k in range(600):
            u = bases[k % 3].copy()
            at = rng.integers(0, 300, rng.integers(14, 22))
            u[at] = rng.integers(0, 2**63, len(at), dtype=np.uint64)
            sets.append(np.unique(u))
        plain, parent, own = [set(u.tolist()) for u in sets], list(range(600)), list(range(600))

        def root(p, x):
            while p[x] != x:
                x = p[x]
            return x

        for i in range(600):
            for j in range(i % 3, i, 3):
                if len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j]):
                    parent[root(parent, i)] = root(parent, j)
        shard = near_dedup.Shard()
        for i, u in enumerate(sets):
            label = -1 if i in (3, 9) else None  # known to be of one group, near or not
            for j in shard.add(simhash.fingerprint(u), u, label):
                own[root(own, i)] = root(own, j)
        own[root(own, 9)], parent[root(parent, 9)] = root(own, 3), root(parent, 3)
        assert len({(root(parent, i), root(own, i)) for i in range(600)}) == len({root(parent, i) for i in range(600)}) == len({root(own, i) for i in range(600)})


def test_near_dedup_in_blocks(spark, tmp_path, monkeypatch):
    """Shards cut into blocks of few texts: links between blocks are found in the second round."""
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 4000)
    rng = np.random.default_rng(3)
    words, texts = rng.choice([f"w{i}" for i in range(900)], 200).tolist(), []
    for _ in range(40):
        copy = list(words)
        for at in rng.integers(0, 200, 3):
            copy[at] = f"x{rng.integers(0, 10**9)}"
        texts.append(" ".join(copy))
    spark.createDataFrame(rows_of(texts), DOCS).repartition(3).write.parquet(str(tmp_path / "docs"))
    sets, root = [set(simhash.shingles(common.ascii_words(x), 5)) for x in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    assert {r.doc_id for r in near_dedup.deduplicate(spark.read.parquet(str(tmp_path / "docs"))).collect()} == {i for i, x in enumerate(root) if x == i}


def test_near_dedup_when_partitions_change(spark, tmp_path):
    """Files that are dealt to other partitions in a later scan."""
    texts = [f"one text of its own with number {i} and some words more {i * i}" for i in range(40)] + [f"copied text of words {i % 5} that stands here again" for i in range(20)]
    at = str(tmp_path / "docs")
    spark.createDataFrame(rows_of(texts), DOCS).repartition(8).write.parquet(at)
    keys = ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        spark.conf.set(keys[2], "8")
        out = near_dedup.deduplicate(spark.read.parquet(at))
        spark.conf.set(keys[2], "1")
        assert sorted(r.doc_id for r in out.collect()) == list(range(45))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_hot_group_of_near_copies_stays_cheap():
    """Copies that are alike by some 0.82: a link or two each, not all pairs."""
    rng = np.random.default_rng(5)
    base, shard, links = rng.integers(0, 2**63, 400, dtype=np.uint64), near_dedup.Shard(), 0
    for _ in range(800):
        u = base.copy()
        u[rng.integers(0, 400, 20)] = rng.integers(0, 2**63, 20, dtype=np.uint64)
        links += len(shard.add(simhash.fingerprint(np.unique(u)), np.unique(u)))
    assert len({shard.root(i) for i in range(800)}) == 1 and links == 799


# 7 SentencePiece


def test_sentencepiece_equals_library(spark, odd, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer())
    rng = np.random.default_rng(6)
    alphabet = list("aeiotrns ,.\n\t▁  <s>/0x41é中🤣ﬁ")
    texts = ODD + ["".join(rng.choice(alphabet, rng.integers(1, 80))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    coded = sentencepiece_bpe.encode(docs, tokenizer()).withColumn("array", sentencepiece_bpe.ids_array(F.col("ids"))).collect()
    for r in coded:
        want = lib.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == want == r.array
        assert r.decoded == lib.decode(want)
    codec = sentencepiece_bpe.Codec(open(tokenizer(), "rb").read())
    for _ in range(300):
        ids = rng.integers(0, 600, 12).tolist()
        assert codec.decode(np.array(ids, "<u4").tobytes()) == lib.decode(ids), ids
    assert sentencepiece_bpe.encode(none, tokenizer()).count() == 0
    assert sentencepiece_bpe.encode(odd, tokenizer(), keep=tuple(odd.columns)).columns == [*odd.columns, "ids", "decoded"]


# 8 URL filter


def test_url_filter(spark):
    urls = ["http://A.Example.NET/en/1?x#y", "https://example.net", "http://b.net/x", "http://notnet/x", "HTTP://x.example.com/de/2", "http://example.com/DE/2", "http://u.org/fr/", "http://u.org/en/", "no scheme", None, "", "x://h?q://z/", "http://spam-farm.example.org/en/9", "a://b\n/c"]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).collect()}
    assert [(got[i].host, got[i].path) for i in (0, 1, 9, 11, 13)] == [("a.example.net", "/en/1"), ("example.net", ""), ("", ""), ("h", ""), ("b\n", "/c")]
    assert [got[i].rule for i in range(9)] == ["example.net/en/", None, "net/", None, "example.com/de/", None, "org/fr/", None, None]
    assert [got[i].verdict for i in (0, 2, 4, 6)] == ["allow", "block", "block", "allow"]
    assert got[12].verdict == "block" and got[7].verdict == "allow"
    plan = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id int, url string, host string, verdict string")).count() == 0
    with pytest.raises(ValueError):
        url_filter.fit([([1], 1.0)] * (url_filter.MAX_LABELLED + 1))


# 9 neighbours


def test_ann_recall_and_edges(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[5] = x[6] = x[7]
    x[10:60] = x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9020, [0.0] * 16), (9040, [1.0] * 15 + [None]), (9060, [1.0] * 15 + [float("nan")]), (9080, [1.0] * 3), (None, [1.0] * 16), (20, x[20].tolist()), (9100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {i for i in range(0, 3000, 20)}
    wide, hits = x.astype(np.float64), 0
    for i, found in got.items():
        s = wide @ wide[i]
        best = sorted((j for j in range(3000) if j != i), key=lambda j: (-s[j], j))[:20]
        hits += len(set(best) & {j for j, _ in found})
        assert len(found) == 20 and all(abs(s[j] - v) < 1e-9 for j, v in found)
        assert found == sorted(found, key=lambda jv: (-jv[1], jv[0]))
    assert hits / (20 * len(got)) >= 0.9
    assert ann.nearest(df.limit(0), df).count() == 0
    wide_rows = [(i, [float(a) * 1e100 for a in v]) for i, v in enumerate(rng.standard_normal((40, 3)))]
    wide_df = spark.createDataFrame(wide_rows, "vec_id long, embedding array<double>")
    for r in ann.nearest(wide_df, wide_df.filter("vec_id % 20 = 0"), k=5).collect():
        assert r.score == pytest.approx(float(np.dot(wide_rows[r.query_id][1], wide_rows[r.vec_id][1])), rel=1e-12)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.rank) for r in ann.nearest(few, few.filter("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_ann_goes_on_past_empty_leaves():
    rng = np.random.default_rng(1)
    forest = ann.Forest(rng.standard_normal((256, 8)), 6.0, 2, 4)
    sizes = np.zeros(32, np.int64)
    sizes[[3, 20]] = 30
    for found in forest.search(rng.standard_normal((20, 8)), sizes, 10.0, 21):
        assert set(found) <= {3, 20} and sum(sizes[found]) >= 21
    assert all(found == [] for found in forest.search(rng.standard_normal((3, 8)), np.zeros(32, np.int64), 10.0, 21))


# 10 language


def test_language_model_against_plain_kneser_ney():
    """A dictionary model by the definition; probabilities of all characters and the unknown one sum to 1."""
    n, texts = language_id.ORDER, ["the cat sat on the mat", "that hat"]
    model = language_id.Model({"a": language_id.gram_types(iter(texts))})
    pad = [language_id.MARK] * (n - 1)
    grams = collections.Counter()
    for t in texts:
        for w in t.split():
            codes = pad + [ord(c) for c in w] + [language_id.MARK]
            for i in range(n - 1, len(codes)):
                grams[tuple(codes[i - n + 1 : i + 1])] += 1
    chars = sorted({g[-1] for g in grams})
    counts = {n: grams}
    for k in range(n - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])

    def p(g, k):
        if k == 0:
            return 1 / (1 + len(chars))
        once, twice = (sum(c == x for c in counts[k].values()) for x in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        of = {h: c for h, c in counts[k].items() if h[:-1] == g[:-1]}
        if not of:
            return p(g[1:], k - 1)
        total = sum(of.values())
        return max(of.get(g, 0) - d, 0) / total + d * len(of) / total * p(g[1:], k - 1)

    for ctx in [(2, 2, 2), (2, 2, ord("t")), (2, ord("t"), ord("h")), (ord("c"), ord("a"), ord("t")), (1, 1, 1)]:
        want = [p((*ctx, c), n) for c in [*chars, 0x7A7A]]
        got = model._prob(np.array([[*ctx, c] for c in [*chars, 0x7A7A]], np.uint32), n)[:, 0]
        assert np.allclose(got, want, rtol=1e-9) and math.isclose(sum(want), 1, rel_tol=1e-9)


def test_language_model_is_a_distribution():
    types = {"a": language_id.gram_types(iter(["the cat sat on the mat", "that hat"])), "b": language_id.gram_types(iter(["der hund und die katze"]))}
    m = language_id.Model(types)
    chars = np.unique(np.concatenate([g[:, -1] for g, _ in types.values()]))
    for ctx in ([2, 2, 2], [ord("t"), ord("h"), ord("e")], [1, 1, 1]):
        grams = np.array([[*ctx, c] for c in chars], np.uint32)
        total = m._prob(grams, language_id.ORDER).sum(0)
        assert (total <= 1 + 1e-9).all() and (total > 0.7).all()


def test_language_id(spark, odd, none):
    docs, _ = corpus(spark)
    model = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert np.mean([got[i].lang_pred == ("en", "de")[i % 2] for i in got]) > 0.98
    judged = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, model, reject=False).collect()}
    assert all(judged[i] == ("und", 0.0) for i in (0, 1, 2, 11)) and all(judged[i][0] in ("en", "de") for i in (3, 4, 9, 10))
    noise = spark.createDataFrame([(1, "qxzjv kwqxz vvjqk zzxqj xkcdq " * 20), (2, "the of and to in that")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict(noise, model).collect()}[2] == "en"
    one = language_id.train(docs.filter("lang = 'en'"))
    alone = language_id.predict(docs, one, keep=("doc_id", "lang")).collect()
    assert all(r.lang_pred == "en" for r in alone if r.lang == "en")
    assert np.mean([r.lang_pred == "und" for r in alone if r.lang == "de"]) > 0.9  # a language that wasn't learned
    empty = language_id.train(none)
    assert {r.lang_pred for r in language_id.predict(odd, empty).collect()} == {"und"}
    assert language_id.predict(none, model).count() == 0


def test_language_sample_of_null_repeated_and_hot_ids(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "calibrate", lambda model, held: seen.append(held))
    texts = {"de": "der hund und die katze", "en": "the dog and the cat", "fr": "le chien et le chat"}
    rows = [(None, f"{texts['de']} {'x' * i}", "de") for i in range(60)]  # no id at all
    rows += [(7, f"{texts['en']} {'x' * i}", "en") for i in range(60)]  # one id
    rows += [(8, texts["fr"], "fr")] * 300  # one row
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for n in (10, 400):
        model = language_id.train(docs, sample_docs=n)
        assert model.languages == ["de", "en", "fr"]
        held = collections.Counter(k for k, _ in seen[-1])
        assert held["fr"] == 1 and held["de"] == held["en"] == -(-min(n, 60) // 8)
    assert {r.lang_pred for r in language_id.predict(docs.filter("lang = 'de'"), model, reject=False).collect()} == {"de"}


def test_kept_columns_may_have_the_names_of_results(spark):
    rows = [(i, f"some text of words {i}", f"k{i}") for i in range(6)]
    docs = lambda name: spark.createDataFrame(rows, f"doc_id long, text string, {name} string")
    net, model = toxicity.Network(), language_id.Model({"a": language_id.gram_types(iter(["some text of words"]))})
    net.trained = True
    lm = lambda d, k: bloom_lm.score(d, *bloom_lm.train_model(d), keep=k)
    made = [(lambda d, k: simhash.fingerprints(d, keep=k), "fp"), (lambda d, k: merkle.fingerprints(d, keep=k), "fingerprint"), (lambda d, k: toxicity.predict(d, net, keep=k), "score"),
            (lambda d, k: language_id.predict(d, model, keep=k), "lang_pred"), (lambda d, k: sentencepiece_bpe.encode(d, tokenizer(), keep=k), "ids"), (lm, "base_score"), (lm, "word")]
    for run, name in made:
        got = run(docs(name), ("doc_id", name))
        kept = name if name == "word" else f"{name}_kept"
        assert {r["doc_id"]: r[kept] for r in got.collect()} == {i: f"k{i}" for i in range(6)}, name


def test_batch_size_does_not_depend_on_order(spark):
    x = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<float>")
    ann.nearest(x, x).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(common.ROWS_PER_BATCH)
    bloom_lm.train_model(spark.createDataFrame([("a b",)], "text string"))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(common.ROWS_PER_BATCH)


def test_native_fold_matches_crc32(spark):
    got = spark.range(0, 500).select("id", common.fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)
