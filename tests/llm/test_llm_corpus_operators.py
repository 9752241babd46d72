"""Phrases, manifests and shared passages against brute force, and on nulls, empty texts, ties, repeats, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import manifest, passages, phrases

ODD = [None, "", " \t\n", "a", "Word, word. WORD", "of the; of the\nof the", "ß É é 中文 🤣 é", "no\xa0break here", "x" * 30_000, "the cat of the house " * 3000, "the cat of the house, the cat", "the cat of the house, the cat"]
CLASH = "doc_id long, text string, lang string, source string, n_chars long, phrase string, at string, w string, a long, n long, share string, g long, i long, m long, digest string, run string, path string, kept string, n_words string, start int, words string, home long, cell string"


def clashing(spark, texts, langs=("en", None, "de"), sources=("s", None, "t")):
    rows = [(k, t, langs[k % len(langs)], sources[k % len(sources)], None if t is None else len(t), *(["x"] * 3), 1, 2, "s", 1, 2, 3, *(["x"] * 5), 4, "w", 5, "c") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASH).repartition(3)


# 11 phrases


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_phrases(rows, max_n, least, absorbed, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            w = tuple(x for x in re.split("[ \t]+", piece) if x)
            n[lang] += len(w)
            for size in range(1, max_n + 1):
                for k in range(len(w) - size + 1):
                    f[lang, w[k : k + size]] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in cand.items():
        inside = any(b >= absorbed * a / 100 and l2 == lang and len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q))) for (l2, q), b in cand.items())
        if not inside:
            score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for r, (s, a, p, left, right) in enumerate(sorted(found)[:top])}


@pytest.mark.parametrize(("max_n", "least", "absorbed", "top"), [(3, 2, 50, 2000), (4, 3, 60, 7), (2, 1, 50, 3)])
def test_phrases_equal_brute_force(spark, max_n, least, absorbed, top):
    rng = np.random.default_rng(max_n)
    vocab = ["of", "the", "The", "cat", "dog", "in", "élan", "中", "a-b"]
    rows = [("".join(str(rng.choice(vocab)) + str(rng.choice([" ", "  ", "\t", ", ", ".", "\n"], p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.05])) for _ in range(rng.integers(0, 60))), [None, "en", "de"][k % 3]) for k in range(80)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = {tuple(r) for r in phrases.collocations(docs, max_n, least, absorbed, top).collect()}
    assert got == brute_phrases(rows, max_n, least, absorbed, top) and got


def test_phrases_edges(spark):
    docs = clashing(spark, ODD)
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    got = phrases.collocations(docs, least=2)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and dict(got.dtypes)["rank"] == "bigint"
    assert {tuple(r) for r in got.collect()} == brute_phrases(rows, 3, 2, 50, 2000)
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.select(F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"))).count() == 0


def test_phrase_scores_are_exact(spark):
    big = 3_000_000_019
    counted = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, 2 * big)], "lang string, phrase string, size int, a long")
    row = phrases.scored(counted, 2).first()
    assert (row.l, row.r, row.score) == (big + 1, 2 * big, 10**6 * big * big // ((big + 1) * 2 * big))


# 12 manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(nodes, fanout):
    """The root and, for each node, its siblings from the leaf up as (left, right)."""
    paths, where = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, above = [], []
        for s in range(0, len(nodes), fanout):
            run = nodes[s : s + fanout]
            for k in range(len(run)):
                for leaf in where[s + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h(*run))
            above.append([x for w in where[s : s + fanout] for x in w])
        nodes, where = up, above
    return nodes[0], paths


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest_equals_brute_force(spark, fanout):
    rng = np.random.default_rng(fanout)
    rows = [(int(rng.integers(0, 40)) if k % 9 else None, f"line\n{k}" if k % 3 else None, None, [None, "a", "b", "é", "lone"][0 if k < 30 else 1 + k % 3], k) for k in range(74)]
    rows += [(1, "x\ny", "l", "lone", 3), *[(7, "same\nrow", "en", "a", 2)] * 4]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = manifest.verified(docs, F.col("doc_id") % 2 == 0, fanout=fanout).collect()
    groups = defaultdict(list)
    for i, t, lang, s, n in rows:
        groups[s].append((i is not None, i or 0, brute_leaf((i, s, lang, n, t)), brute_leaf((i, s, lang, n, t.replace("\n", "") if t is not None and i is not None and i % 2 == 0 else t)), i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fanout) for s in order}
    root, upper = brute_tree([trees[s][0] for s in order], fanout)
    want = Counter()
    for s, above in zip(order, upper, strict=True):
        for x, path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            d = x[3]
            for left, right in path + above:
                d = h(left, d, right)
            want[x[4], x[2], trees[s][0], root, h(*(a + b for a, b in path + above)), d, d == root] += 1
    assert Counter(tuple(r) for r in got) == want
    assert {r.verified for r in got} == {True, False}


def test_manifest_edges(spark):
    docs = clashing(spark, ODD)
    got = manifest.verified(docs, F.lit(None).cast("boolean"))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = got.collect()
    assert len(rows) == len(ODD) and all(r.verified for r in rows) and len({r.root for r in rows}) == 1
    assert manifest.verified(docs.limit(0), F.lit(True)).count() == 0
    one = manifest.verified(docs.filter("doc_id = 4"), F.lit(False)).first()
    assert one.root == one.subroot == one.leaf == one.folded_root and one.proof_sha256 == h()
    made = manifest.build(docs.select("source", "doc_id", manifest.leaf([F.col("text")]).alias("leaf"), F.col("text").alias("kept")))
    assert made.leaves.filter("kept IS NOT NULL").count() == len(ODD) - 1 and made.sources.count() == 3 and made.root


# 13 passages


def brute_repeats(rows, words):
    """n_words, n_removed and kept of each row in order; rows are (doc_id, text)."""
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - words + 1) if i is not None else ():
            key = tuple(w[k : k + words])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - words + 1) if i is not None else ():
            if first[tuple(w[k : k + words])] < i:
                gone[k : k + words] = [True] * words
        out.append((i, t, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


@pytest.mark.parametrize(("words", "gram", "cell", "stream"), [(13, 5, passages.CELL, passages.STREAM), (3, 2, 20, 60), (4, 4, 50, 10**6), (2, 1, 10, 10)])
def test_passages_equal_brute_force(spark, words, gram, cell, stream):
    rng = np.random.default_rng(words)
    vocab = "the of and to in a é 中文 x,".split()
    shared = [" ".join(rng.choice(vocab, 40).tolist()) for _ in range(3)]
    rows = []
    for k in range(120):
        parts = [" ".join(rng.choice(vocab, rng.integers(0, 30)).tolist()) for _ in range(2)]
        rows.append((int(rng.integers(0, 100)) if k % 11 else None, str(rng.choice(["\n", "  ", " \t"])).join([parts[0], str(rng.choice(shared))[int(rng.integers(0, 30)) :] if k % 2 else "", parts[1]])))
    rows += [rows[5]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = passages.remove(docs, words, gram, cell, stream).select("doc_id", "text", "n_words", "n_removed", "kept").collect()
    assert Counter(map(tuple, got)) == Counter(brute_repeats(rows, words))
    assert any(r.n_removed for r in got)


def test_passages_of_a_hot_home_are_split(spark):
    """One passage in all documents: copies of its cell get equal shares, and one long passage is cut into pieces."""
    long = " ".join(f"w{k}" for k in range(9000))
    rows = [(0, long), (1, long), *[(k, " ".join(f"w{j}" for j in range(50)) + f" own{k}") for k in range(2, 200)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = passages.remove(docs, cell=1000, stream=2000).select("doc_id", "text", "n_words", "n_removed", "kept").collect()
    assert Counter(map(tuple, got)) == Counter(brute_repeats(rows, 13))


def test_passages_edges(spark):
    docs = clashing(spark, [*ODD, *ODD])
    got = passages.remove(docs, words=4, gram=2)
    assert got.columns == [c if c not in ("kept", "n_words") else f"{c}_kept" for c in docs.columns] + ["n_words", "n_removed", "kept"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter((r.doc_id, r.text, r.n_words, r.n_removed, r.kept) for r in got.collect()) == Counter(brute_repeats(rows, 4))
    assert passages.remove(docs.limit(0)).count() == 0
    assert passages.repeats(docs.filter("doc_id < 3")).count() == 0


def test_passages_hash_a_batch_of_texts_at_once(monkeypatch):
    """The words of a column, their hashes and slices are those of each text on its own, wherever the parts are cut."""
    rng = np.random.default_rng(4)
    pieces = ["a", "bé", "中", " ", "\n", "  ", "word", "x" * 30, "\x0b", "\x85", "　"]
    seen: dict[bytes, int] = {}
    for size in (8, 50, 1 << 18):
        monkeypatch.setattr(passages, "BYTES", size)
        for _ in range(60):
            texts = ["".join(rng.choice(pieces, int(rng.integers(0, 40))).tolist()) for _ in range(int(rng.integers(0, 6)))]
            batch = passages.Batch(pa.array(["zz", *texts, "q"]).slice(1, len(texts)))
            for i, t in enumerate(texts):
                w, s, e = passages.words_of(t), batch.first[i], batch.first[i + 1]
                assert [batch.raw[x:y].tobytes() for x, y in zip(batch.starts[s:e], batch.ends[s:e], strict=True)] == w
                assert all(seen.setdefault(x, h) == h for x, h in zip(w, batch.hashes[s:e].tolist(), strict=True))
                assert not w or batch.slice(i, len(w) // 2, len(w)) == b" ".join(w[len(w) // 2 :])
    assert len(set(seen.values())) == len(seen) > 100
