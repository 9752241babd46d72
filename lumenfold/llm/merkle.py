"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text's leaves are pieces of its paragraphs: a paragraph (a line with its line end) is cut after sentence ends, and
where it has none after word ends that its own characters choose, so a cut doesn't depend on what stands before. A
paragraph's digest is over its leaves' digests, a section's over those of its paragraphs, the root's over those of its
sections; a section ends where a paragraph's digest says so, so sections too keep their cuts under edits elsewhere.
Levels and the kind of node go into each digest. Equal roots mean equal texts.

The fingerprint of a text is that tree in preorder: the root, and each section, paragraph and leaf with a short digest and
its number of code points. Two fingerprints are compared from the root down, and only branches whose digests the other
doesn't have are entered: ``likeness`` is the characters in what both have, as a share of both texts' characters (0 to 1;
two empty texts: 1), ``changed`` gives the spans of the one text that the other doesn't have. Neither needs the texts. Moved
pieces count as had, so likeness may be 1 where the order alone differs; the roots tell those apart.

Edge cases: null counts as empty, which has no leaf and a root of its own; texts of any length are hashed whole;
repeated rows stay; other columns are carried only where named.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import carried, map_batches

#: A leaf: to a line end, a sentence end or a word end after one of a few letters; at most 160 characters.
LEAF = re.compile(r"(?:[^\n]{12,160}?(?:[.!?;:|$#%&*][ ]|[dry][ ,]|\n)|[^\n]{1,160}\n?|\n)")
SECTION_MASK = 3  # a section has four paragraphs on average
SHORT_HEX, ROOT_HEX = 8, 32


def _digest(kind: bytes, parts: list[bytes]) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=ROOT_HEX // 2, person=kind).digest()


class Tree:
    """sections: [(digest, [(digest, [(digest, start, end), ...]), ...]), ...]; spans are code points."""

    def __init__(self, text: str):
        self.sections: list[tuple[bytes, list]] = []
        paragraphs: list[tuple[bytes, list]] = []
        leaves: list[tuple[bytes, int, int]] = []
        blake, at = hashlib.blake2b, 0
        for piece in LEAF.findall(text):
            leaves.append((blake(piece.encode("utf-8", "replace"), digest_size=16, person=b"leaf").digest(), at, at := at + len(piece)))
            if piece[-1] == "\n" or at == len(text):
                d = _digest(b"paragraph", [x[0] for x in leaves])
                paragraphs.append((d, leaves))
                leaves = []
                if not d[0] & SECTION_MASK or at == len(text):
                    self.sections.append((_digest(b"section", [x[0] for x in paragraphs]), paragraphs))
                    paragraphs = []
        self.root = _digest(b"root", [x[0] for x in self.sections])

    def fingerprint(self) -> str:
        """``root``, then ``/`` for each section, ``,`` for each paragraph, ``.`` for each leaf: a short digest and a length."""
        out = [self.root.hex()]
        for section, paragraphs in self.sections:
            out.append(f"/{section.hex()[:SHORT_HEX]}{paragraphs[-1][1][-1][2] - paragraphs[0][1][0][1]:x}")
            for paragraph, leaves in paragraphs:
                out.append(f",{paragraph.hex()[:SHORT_HEX]}{leaves[-1][2] - leaves[0][1]:x}")
                out += [f".{d.hex()[:SHORT_HEX]}{end - start:x}" for d, start, end in leaves]
        return "".join(out)


def _length(node: str) -> int:
    """Of a section, paragraph or leaf as it stands in a fingerprint, without what is below it."""
    return int(node[SHORT_HEX:], 16)


def _apart(a: list[tuple], b: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Nodes (text of the node, text below it, start) of each list that the other has no equal one for."""
    count = Counter(x[0] for x in a) & Counter(x[0] for x in b)
    if not count:
        return a, b
    rest = []
    for nodes in (a, b):
        left, out = count.copy(), []
        for x in nodes:
            if left[x[0]] > 0:
                left[x[0]] -= 1
            else:
                out.append(x)
        rest.append(out)
    return rest[0], rest[1]


def _below(nodes: list[tuple], mark: str) -> list[tuple]:
    """The children of nodes, with their starts."""
    out = []
    for _, text, start in nodes:
        for child in text.split(mark)[1:]:
            name = child if mark == "." else child[: child.index("," if mark == "/" else ".")]
            out.append((name, child, start))
            start += _length(name)
    return out


def differing(a: str, b: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans of the leaves of each fingerprint's text that the other's doesn't have (repeats counted)."""
    if a == b:
        return [], []
    sides = ([("", a, 0)], [("", b, 0)])
    for mark in "/,.":
        sides = _apart(_below(sides[0], mark), _below(sides[1], mark))
    return tuple([(start, start + _length(name)) for name, _, start in side] for side in sides)


def changed(a: str, b: str) -> list[tuple[int, int]]:
    """Spans of b's text that a's doesn't have, neighbouring ones as one."""
    spans: list[tuple[int, int]] = []
    for start, end in differing(a, b)[1]:
        if spans and spans[-1][1] == start:
            start = spans.pop()[0]
        spans.append((start, end))
    return spans


def n_chars_of(fingerprint: str) -> int:
    return sum(_length(name) for name, _, _ in _below([("", fingerprint, 0)], "/"))


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    both = n_chars_of(a) + n_chars_of(b)
    return 1 - sum(end - start for side in differing(a, b) for start, end in side) / both if both else 0.0


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns (one named fingerprint: fingerprint_kept), fingerprint."""
    rows, keep, schema = carried(docs, keep, text, "fingerprint string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([Tree(t.as_py() or "").fingerprint() for t in batch.column(batch.num_columns - 1)], pa.string())], [*keep, "fingerprint"])

    return map_batches(rows, run, schema)


BUCKET_ROWS = 2000  # rows of one range of ids, about


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """__bucket, __id, __key, __text, __own: each range of ids with, last, the first row after it (__own false).

    Ranges are set from approximate quantiles of the ids, so a row knows its range by itself; a range's first row goes to
    the range before as well (the very first row to the last range). Only the ranges' bounds come to the driver. Ids that
    repeat follow each other in the order of their texts; null ids come first.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    n = rows.count()
    parts = max(1, min(20_000, n // BUCKET_ROWS))
    cuts = sorted(set(rows.select("__id").approxQuantile("__id", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    key = F.coalesce(F.col("__id"), F.lit(-(2**63)))
    rows = rows.withColumn("__key", key)
    cut = [int(c) for c in cuts]
    # The number of cuts at or below the id: a binary search over literals, in one expression.
    bucket = _search(F.col("__key"), cut, 0, len(cut))
    rows = rows.withColumn("__bucket", bucket)
    heads = {r["__bucket"]: r["k"] for r in rows.groupBy("__bucket").agg(F.min("__key").alias("k")).collect()}  # one row a range
    order = sorted(heads)
    before = {heads[b]: order[i - 1] for i, b in enumerate(order)}
    lookup = docs.sparkSession.createDataFrame(sorted(before.items()) or [(0, 0)], "__key long, __before int")
    own = rows.withColumn("__own", F.lit(True))
    first = rows.join(F.broadcast(lookup), "__key").withColumn("__bucket", F.col("__before")).withColumn("__own", F.lit(False))
    return own.unionByName(first.select(*own.columns))


def _search(key: Column, cuts: list[int], low: int, high: int) -> Column:
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(key >= cuts[mid], _search(key, cuts, mid + 1, high)).otherwise(_search(key, cuts, low, mid))


def against_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_spans.

    The edited text has the last half (rounded down) of the code points replaced by the first as many of the next text.
    edited_spans are those of the edited text that the text doesn't have, as the fingerprints tell.
    """
    near = with_next(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row that waits for its next one: bucket, id, text, tree's fingerprint
        for batch in batches:
            out: list[tuple] = []
            for bucket, i, t, own in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                f = Tree(t).fingerprint()
                if held and held[0] == bucket:
                    out.append(_pair(held, t, f))
                elif held:
                    out.append(_pair(held, "", Tree("").fingerprint()))
                held = (bucket, i, t, f) if own else None
            yield _batch(out)
        if held:
            yield _batch([_pair(held, "", Tree("").fingerprint())])

    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = near.repartition(n, "__bucket").sortWithinPartitions("__bucket", F.desc("__own"), "__key", "__text")
    return map_batches(dealt.select("__bucket", "__id", "__text", "__own"), run, PAIR_SCHEMA)


PAIR_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_spans array<struct<start:long,end:long>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pair(held: tuple, following: str, following_print: str) -> tuple:
    _, i, t, f = held
    half = len(t) // 2
    edited = t[: len(t) - half] + following[:half]
    own = Tree(edited).fingerprint()
    return i, len(t), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), f, own, likeness(f, own), likeness(f, following_print), [{"start": s, "end": e} for s, e in changed(f, own)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), SPANS)
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], [x.split()[0] for x in PAIR_SCHEMA.split(", ")])
