"""SimHash fingerprints of word shingles and exact linking of near fingerprints with BK-trees.

Two fingerprints that differ in at most ``radius`` bits agree on all but ``radius`` of ``radius + KEPT`` bit blocks, so
they share a shard: one for each choice of ``KEPT`` blocks and the bits there. Each shard's fingerprints go into a
BK-tree (children keyed by their Hamming distance to the parent); a new one first searches it, following only edges
within the radius, and is linked to one member of each group that it joins. So a shard of n gives at most n - 1 links,
and a group of thousands of near copies never becomes all its pairs. Trees live where their shard's rows were shuffled
to and aren't broadcast: that would gather the fingerprints of all documents on the driver, 8 bytes each in every worker.

Equal fingerprints are one node (their least id is found by pre-aggregation), so exact copies cost nothing.

Edge cases: null and empty texts have fingerprint zero and link like others; texts of fewer words than a shingle are
one shingle; a null id never becomes a component id unless all its component's ids are null; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import ascii_words, carried, map_batches
from lumenfold.llm.components import components

SEED, BITS, KEPT = 42, 64, 4
MAX_SHINGLES_AT_ONCE = 1 << 16


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """All runs of k words, repeats included; the whole sequence where there are fewer; none of no words."""
    if len(words) < k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


def hashed(parts: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in parts), np.uint64, len(parts))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), MAX_SHINGLES_AT_ONCE):
        some = hashes[at : at + MAX_SHINGLES_AT_ONCE]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns (one named fp: fp_kept) and fp: the 64 bits as a signed long."""
    rows, keep, schema = carried(docs, keep, text, "fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(hashed(shingles(ascii_words(t.as_py()), words))) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.array(fps, np.uint64).view(np.int64))], [*keep, "fp"])

    return map_batches(rows, run, schema)


class BKTree:
    """Integers under Hamming distance; a node's children are keyed by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Positions of all values within the radius."""
        out, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                out.append(at)
            todo += [child for edge, child in self.children[at].items() if d - radius <= edge <= d + radius]
        return out

    def add(self, value: int) -> int:
        at, new = 0, len(self.values)
        while self.values:
            d = (self.values[at] ^ value).bit_count()
            if d == 0:
                return at
            if d not in self.children[at]:
                self.children[at][d] = new
                break
            at = self.children[at][d]
        self.values.append(value)
        self.children.append({})
        return new


class Shard:
    """A BK-tree that links each new value to one member of every group it joins."""

    def __init__(self) -> None:
        self.tree, self.group = BKTree(), []

    def root(self, at: int) -> int:
        while self.group[at] != at:
            self.group[at] = at = self.group[self.group[at]]
        return at

    def link(self, value: int, radius: int) -> list[int]:
        near = self.tree.near(value, radius)
        at = self.tree.add(value)
        if at < len(self.group):
            return []
        self.group.append(at)
        out = []
        for n in near:
            r = self.root(n)
            if r != self.root(at):
                self.group[r] = self.root(at)
                out.append(self.tree.values[n])
        return out


def blocks(radius: int) -> list[list[int]]:
    """The bit positions of the radius + KEPT blocks."""
    n = radius + KEPT
    return [list(range(BITS * i // n, BITS * (i + 1) // n)) for i in range(n)]


def near_links(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct: fp. Returns a, b: links that connect exactly the fingerprints that chains of near ones connect."""
    masks = []
    for choice in combinations(blocks(radius), KEPT):
        m = sum(1 << bit for block in choice for bit in block)
        masks.append(m - (1 << BITS) if m >> (BITS - 1) else m)
    shard = F.explode(F.array([F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)]))
    spread = distinct.select("fp", shard.alias("s")).select("fp", "s.c", "s.v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, shard = None, None, None
        for batch in batches:
            fp, c, v = (batch.column(i).to_numpy() for i in range(3))
            new = np.ones(len(fp), bool)
            new[1:] = (c[1:] != c[:-1]) | (v[1:] != v[:-1])
            starts = [*np.flatnonzero(new).tolist(), len(fp)]
            out: list[tuple[int, int]] = []
            for s, e in zip(starts, starts[1:], strict=False):
                if (key := (c[s], v[s])) != now:
                    now, members, shard = key, None, None
                if e - s == 1 and members is None and shard is None:
                    members = [int(fp[s])]  # most shards have one fingerprint: no tree for those
                    continue
                if shard is None:
                    shard = Shard()
                    for x in members or ():
                        shard.link(x & (2**64 - 1), radius)
                for x in fp[s:e].tolist():
                    out += [(x, y - 2**64 if y >> 63 else y) for y in shard.link(x & (2**64 - 1), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    n = int(spread.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(n, "c", "v").sortWithinPartitions("c", "v").mapInArrow(run, "a long, b long").distinct()


def near_components(prints: DataFrame, radius: int = 2, doc_id: str = "doc_id") -> DataFrame:
    """prints: doc_id and fp. Returns fp, component_id: the least doc_id that chains of near fingerprints reach."""
    nodes = prints.groupBy("fp").agg(F.min(doc_id).alias("least"))
    roots = components(near_links(nodes.select("fp"), radius))
    rooted = nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "component_id")


def hex_of(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")

