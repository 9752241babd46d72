"""Near-duplicate removal: SimHash fingerprints in BK-trees, sharded by minima of word shingles, decided on whole sets.

Texts are near where the Jaccard similarity of their sets of five-word shingles is ``SIMILARITY`` or more. At 0.8 the
fingerprints of such texts differ in some ten bits, for which shards of agreeing bit blocks would be far too many; so
shards come from the shingles: ``BANDS`` keys of ``ROWS`` minima each, of which near texts share one but for a chance
of (1 - 0.8 ** 2) ** 10, or 4 in 100,000. Shards of one text are left out before anything else moves. In a shard, a
BK-tree over the fingerprints (of the different shingles, as similarity is over sets) finds those within ``RADIUS``: at
0.8 a bit differs with a chance of 0.15, and of 0.19 for the worst small sets (4 against 5 shingles), so that over 30 of
64 differ once in a million pairs at most. What it finds is decided there and then on the whole shingle sets, until a
text has a link to each group of the shard that it joins, or none of the group's texts is near. No candidate is left out.

Two rounds: the first searches the shards of ``FIRST`` keys. What it links needs no more links, so the second searches
only those shards of the other keys whose texts are not all in one group by then.

Groups of thousands of near copies: equal texts are one node to start with; a new text is first held against the texts
that most others were linked to, and branches of the tree that lie wholly in groups it has joined are not entered. So
the work in a shard grows with its size times few. A shard whose sets take over ``BLOCK_BYTES`` is cut into blocks, a tree
each; in the second round those of its texts that are outside its largest group go to all its blocks, so that no pair of
different groups is left out and no task holds a whole shard.

Edge cases: null, empty and wordless texts are one group; texts of fewer words than a shingle are near only to equal
ones; of a group the row of the least id stays (null ids last, then by place), of repeated rows one; all columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import ascii_words, carried, map_batches, written
from lumenfold.llm.components import components
from lumenfold.llm.simhash import fingerprint, hashed, shingles

WORDS, SIMILARITY, RADIUS = 5, 0.8, 30
BANDS, ROWS, FIRST = 10, 2, 2
HUBS, AT_ONCE = 32, 64  # AT_ONCE: sets that are held against a new one in one step
BLOCK_BYTES = 32 << 20
_random = np.random.default_rng(6)
FACTORS = _random.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
SHIFT = np.uint64(17)


def keys_of(unique: np.ndarray) -> np.ndarray:
    """A key a band, of ROWS minima under different multiplications."""
    least = np.array([((unique * f) ^ ((unique * f) >> SHIFT)).min() for f in FACTORS]).reshape(BANDS, ROWS)
    key = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        key = (key ^ least[:, r]) * np.uint64(0x9E3779B97F4A7C15)
    return key


def prints(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """keep columns, same (equal for texts of the same words), n (different shingles), keys (null where no text but an equal one is near)."""
    rows, keep, schema = carried(docs, keep, text, "same long, n long, keys array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, sizes, keys = [], [], []
            for t in batch.column(batch.num_columns - 1):
                words = ascii_words(t.as_py())
                same.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
                u = set_of(words)
                sizes.append(len(u))
                keys.append(None if len(words) < WORDS else keys_of(u).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.array(same, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], [*keep, "same", "n", "keys"])

    return map_batches(rows, run, schema)


def set_of(words: list[bytes]) -> np.ndarray:
    """The different shingles' hashes in order."""
    return np.unique(hashed(shingles(words, WORDS)))


def shingle_sets(texts: DataFrame) -> DataFrame:
    """texts: same, text, one row a node. Returns same, fp, set (packed hashes in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [set_of(ascii_words(t.as_py())) for t in batch.column(1)]
            fps = np.array([fingerprint(u) for u in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), pa.array([u.tobytes() for u in sets], pa.binary())], ["same", "fp", "set"])

    return map_batches(texts.select("same", "text"), run, "same long, fp long, set binary")


def overlaps(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the others (none empty) shares with own; all are in order."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    return np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)


class Shard:
    """A BK-tree of fingerprints whose nodes know their group and their shingle set."""

    def __init__(self, similarity: float = SIMILARITY, radius: int = RADIUS):
        self.similarity, self.radius = similarity, radius
        self.fp: list[int] = []
        self.sets: list[np.ndarray] = []
        self.children: list[dict[int, int]] = []
        self.whole: list[int] = []  # a node of the group that all of the branch is in, or -1
        self.group: list[int] = []
        self.hits: list[int] = []
        self.hubs: list[int] = []
        self.labels: dict[int, int] = {}  # a node of each group that was known before

    def root(self, at: int) -> int:
        while self.group[at] != at:
            self.group[at] = at = self.group[self.group[at]]
        return at

    def near(self, value: int, joined: set[int]) -> list[int]:
        out, todo = [], [0] if self.fp else []
        while todo:
            at = todo.pop()
            if self.whole[at] >= 0 and self.root(self.whole[at]) in joined:
                continue
            d = (self.fp[at] ^ value).bit_count()
            if d <= self.radius:
                out.append(at)
            todo += [c for edge, c in self.children[at].items() if d - self.radius <= edge <= d + self.radius]
        return out

    def add(self, value: int, own: np.ndarray, label: int | None = None) -> list[int]:
        """Adds a node, of a known group if it has a label; returns a near node of each other group that it joins."""
        new = len(self.fp)
        joined = {self.root(self.labels[label])} if label in self.labels else set()
        links: list[int] = []

        def consider(at: list[int], step: int) -> None:
            size, bound = len(own), self.similarity
            at = [n for n in at if bound * size <= len(self.sets[n]) + 1e-9 and bound * len(self.sets[n]) <= size + 1e-9]
            for k in range(0, len(at), step):
                some = [n for n in at[k : k + step] if self.root(n) not in joined]
                if not some:
                    continue
                for n, both in zip(some, overlaps(own, [self.sets[n] for n in some]).tolist(), strict=True):
                    if both >= bound * (size + len(self.sets[n]) - both) - 1e-9 and self.root(n) not in joined:
                        joined.add(self.root(n))
                        links.append(n)

        consider(sorted(self.hubs, key=self.hits.__getitem__, reverse=True), 4)
        consider(self.near(value, joined), AT_ONCE)
        self.fp.append(value)
        self.sets.append(own)
        self.children.append({})
        self.group.append(new)
        self.whole.append(new)
        self.hits.append(0)
        for r in joined:
            self.group[r] = new
        if label is not None:
            self.labels[label] = new
        for n in links:
            self.hits[n] += 1
            if n not in self.hubs:
                self.hubs.append(n)
                if len(self.hubs) > HUBS:
                    self.hubs.remove(min(self.hubs, key=self.hits.__getitem__))
        at = 0
        while new:  # down to its place; the branches on the way now hold it
            if self.whole[at] >= 0 and self.root(self.whole[at]) != new:
                self.whole[at] = -1
            d = (self.fp[at] ^ value).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = new
                break
            at = self.children[at][d]
        return links


def tree_links(rows: DataFrame, sets: DataFrame, similarity: float, radius: int) -> DataFrame:
    """rows: band, key, block, same, label. Returns a, b: near nodes that connect what chains of near ones in a block connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, order = None, None, []
        for batch in batches:
            band, key, block, same, label, fp = (batch.column(i).to_pylist() for i in range(6))
            a, b = [], []
            for i, raw in enumerate(batch.column(6)):
                if (band[i], key[i], block[i]) != now:
                    now, shard, order = (band[i], key[i], block[i]), Shard(similarity, radius), []
                links = shard.add(fp[i] & (2**64 - 1), np.frombuffer(raw.as_py(), np.uint64), label[i])
                a += [same[i]] * len(links)
                b += [order[n] for n in links]
                order.append(same[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    place = ["band", "key", "block"]
    whole = rows.join(sets, "same").select(*place, "same", "label", "fp", "set")
    return map_batches(whole.repartition(*place).sortWithinPartitions(*place, "same"), run, "a long, b long")


def near_groups(nodes: DataFrame, chosen: DataFrame, source: DataFrame, similarity: float, radius: int) -> DataFrame:
    """u, root of nodes in groups. nodes: same, n, keys; chosen: same, __n of each node; source: __n, __text."""
    spread = nodes.filter("keys IS NOT NULL").select("same", "n", F.posexplode("keys").alias("band", "key"))
    shared = spread.groupBy("band", "key").agg(F.count("*").alias("m"), F.sum("n").alias("size")).filter("m > 1")
    blocks = F.ceil(8 * F.col("size") / BLOCK_BYTES).cast("int").alias("blocks")
    members = written(spread.join(shared.select("band", "key", blocks), ["band", "key"]).select("band", "key", "blocks", "same"), "members")
    ends = chosen.join(members.select("same").distinct(), "same", "left_semi")
    sets = written(shingle_sets(source.join(ends, "__n").select("same", F.col("__text").alias("text"))), "shingle-sets")
    own = F.pmod(F.xxhash64("same"), F.col("blocks")).cast("int")
    first = members.filter(F.col("band") < FIRST).select("band", "key", own.alias("block"), "same", F.lit(None).cast("long").alias("label"))
    roots = components(written(tree_links(first, sets, similarity, radius), "links"))
    known = members.join(roots.withColumnRenamed("u", "same"), "same", "left").withColumn("label", F.coalesce("root", "same"))
    groups = known.groupBy("band", "key", "label").agg(F.count("*").alias("m")).groupBy("band", "key").agg(F.max(F.struct("m", "label"))["label"].alias("most"), F.count("*").alias("groups"))
    open_shards = groups.filter("groups > 1").select("band", "key", "most")
    rest = known.filter((F.col("band") >= FIRST) | (F.col("blocks") > 1)).join(open_shards, ["band", "key"])
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = F.explode(F.when(F.col("label") == F.col("most"), F.array(own)).otherwise(everywhere)).alias("block")
    more = written(tree_links(rest.select("band", "key", dealt, "same", "label"), sets, similarity, radius), "links")
    if more.isEmpty():
        return roots
    return components(more.unionByName(roots.select(F.col("u").alias("a"), F.col("root").alias("b"))))


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs' rows but those that chains of near texts lead from to a row before them.

    The rows are numbered once and written with their numbers, as a second scan may deal them to other partitions.
    """
    rows = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    numbered = written(docs.select(F.monotonically_increasing_id().alias("__n"), rows), "numbered")
    source = numbered.select("__n", F.col("__row")[doc_id].alias("__id"), F.col("__row")[text].alias("__text"))
    made = written(prints(source, "__text", ("__n", "__id")), "prints")
    place = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__n").alias("n"))
    least = written(made.groupBy("same").agg(F.min(place).alias("least")), "nodes")
    # One row a node, that of its least place.
    chosen = least.select("same", F.col("least.n").alias("__n"))
    nodes = written(made.join(chosen, ["same", "__n"]).select("same", "n", "keys"), "keys")
    roots = near_groups(nodes, chosen, source, similarity, radius)
    rooted = least.join(roots.withColumnRenamed("u", "same"), "same", "left").withColumn("root", F.coalesce("root", "same"))
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.n").alias("__n"))
    return numbered.join(kept, "__n", "left_semi").select(*(F.col("__row")[c].alias(c) for c in docs.columns))
