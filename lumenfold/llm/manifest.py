"""Merkle manifest of a table: a leaf a row, a tree a source, a tree over the sources' roots, and a proof for each row.

H is the lowercase hex sha256 of its inputs in a row, digests as hex text. A leaf is H of its columns, each ``-`` if null, else
the count of its UTF-8 bytes, ``:`` and the value. A source's leaves stand by id; while several nodes remain, every ``fanout``
consecutive ones become their H (the last run may be shorter, even one node). What remains is the source's subroot; the
subroots, by source (null first, UTF-8 bytewise), make the root in the same way. A row's proof are its siblings, run by run
up to the root: hashed with them, the row's leaf gives the root, and any other leaf doesn't.

Each level is a DataFrame: rows are numbered, numbers divided by the fanout, and each group's sorted digests hashed into the
parent's, which is written with them. Numbers come from ranges of (source, id): row_number inside a range, shifted by the
counts of the source's ranges before it, so a source with a third of all rows is in as many tasks as its size asks for.
Siblings are joined level by level from the root down, each join appending the level's siblings to the path above, so a level
of m nodes costs m rows and the whole n rows times 3 / 2; from the leaves up it would be n rows for every level.

Edge cases: a null id stands before all others; rows of equal ids stand by their leaves' digests, so the result is the same
however they lie; wholly equal rows have equal leaves and a place each. A null source is a source. A source of one row has its leaf as
subroot, a table of one source that subroot as root. An empty table gives no rows and no root. Columns that aren't named are
not read, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import written

FANOUT = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def leaf(columns: list[Column]) -> Column:
    each = [F.concat(F.octet_length(v).cast("string"), F.lit(":"), v) for v in (c.cast("string") for c in columns)]
    return digest(F.concat(*(F.coalesce(e, F.lit("-")) for e in each)))


def indexed(rows: DataFrame, group: str, order: list[str], to: str, size: str) -> DataFrame:
    """Adds the place of each row in its group (from 0, nulls first) and the group's size; group may be null."""
    keys = [F.asc_nulls_first(c) for c in (group, *order)]
    ranged = written(rows.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    runs = ranged.groupBy("__range", group).agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(group)  # a row a range
    runs = runs.select("__range", F.col(group).alias("__of"), F.coalesce(F.sum("__n").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias(size))
    own = F.row_number().over(Window.partitionBy("__range", group).orderBy(*keys[1:]))
    placed = ranged.withColumn("__own", own).alias("r").join(runs.alias("o"), (F.col("r.__range") == F.col("o.__range")) & F.col(group).eqNullSafe(F.col("__of")))
    return placed.select(*(f"r.{c}" for c in rows.columns), (F.col("__own") - 1 + F.col("__before")).alias(to), size)


def levels(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """nodes: g, i, m, digest: the place of each in group g of m. Returns them and, above, each level's g, i, m, digest and
    run, the children's digests in order. A group's last level has m = 1."""
    top = nodes.agg(F.max("m")).first()[0] or 0
    out = [nodes]
    while top > 1:
        parent = lambda c: F.expr(f"{c} div {fanout}")
        groups = out[-1].filter("m > 1").groupBy("g", parent("i").alias("i"), parent(f"(m + {fanout - 1})").alias("m"))
        run = groups.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "digest"))), lambda x: x["digest"]).alias("run"))  # at most fanout digests
        out.append(written(run.select("g", "i", "m", digest(F.array_join("run", "")).alias("digest"), "run"), "level"))
        top = -(-top // fanout)
    return out


def sibling(run: Column, at: Column) -> Column:
    """What stands left and right of a place of the run."""
    side = lambda first, n: F.array_join(F.slice(run, first, n), "")
    return F.struct(side(F.lit(1), at).alias("left"), side(at + 2, F.size(run)).alias("right"))


def paths(tree: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """above: g and columns of the group's root, path among them (siblings from the root down). Returns g, i and those
    columns for the nodes of the lowest level, the path with the tree's own siblings appended. Each level is written, so
    that no plan holds more than one."""
    kept = [c for c in above.columns if c not in ("g", "path")]
    now = None
    for k in range(len(tree) - 1, -1, -1):
        own = tree[k].filter("m = 1").select("g", "i").join(above, "g").select("g", "i", *kept, "path")
        if now is not None:
            each = tree[k + 1].select("g", "i", "run").join(now, ["g", "i"]).select("g", "i", *kept, "path", "run", F.posexplode("run").alias("at", "digest"))
            own = own.unionByName(each.select("g", (F.col("i") * fanout + F.col("at")).alias("i"), *kept, F.concat("path", F.array(sibling(F.col("run"), F.col("at")))).alias("path")))
        now = written(own, "paths") if k else own
    return now


def folded(value: Column, path: Column) -> Column:
    """The root that a leaf gives with a path."""
    return F.aggregate(F.reverse(path), value, lambda d, s: digest(F.concat(s["left"], d, s["right"])))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(F.reverse(path), lambda s: F.concat(s["left"], s["right"])), ""))


@dataclass
class Manifest:
    """leaves: the rows given with their leaf, g (the source's place) and i (the row's place in it); sources: source, g,
    subroot; root: one digest, or None for an empty table; proofs: g, i, subroot, path."""

    leaves: DataFrame
    sources: DataFrame
    root: str | None
    proofs: DataFrame


def build(leaves: DataFrame, group: str = "source", order: tuple[str, ...] = ("doc_id", "leaf"), fanout: int = FANOUT) -> Manifest:
    """leaves: the columns group and order, leaf, and any others to be kept (none called g, i, m or of two underscores)."""
    placed = written(indexed(leaves, group, list(order), "i", "m"), "leaves")
    sources = written(indexed(placed.filter("i = 0").select(group, "m").withColumn("all", F.lit(0)), "all", [group], "g", "n_sources").drop("all"), "sources")
    named = sources.select(F.col(group).alias("__source"), "g")
    placed = written(placed.join(named, F.col(group).eqNullSafe(F.col("__source"))).drop("__source"), "leaves")
    tree = levels(placed.select("g", "i", "m", F.col("leaf").alias("digest")), fanout)
    subroots = None
    for level in tree:
        done = level.filter("m = 1").select("g", "digest")
        subroots = done if subroots is None else subroots.unionByName(done)
    subroots = written(subroots.join(sources.select("g", group, "n_sources"), "g").select("g", group, "n_sources", F.col("digest").alias("subroot")), "subroots")
    upper = levels(subroots.select(F.lit(0).alias("g"), F.col("g").alias("i"), F.col("n_sources").alias("m"), F.col("subroot").alias("digest")), fanout)
    root = upper[-1].filter("m = 1").select("digest").first()
    none = F.array().cast("array<struct<left:string,right:string>>")
    start = upper[-1].filter("m = 1").select("g", none.alias("path"))
    top = written(paths(upper, start, fanout).select(F.col("i").alias("g"), "path").join(subroots.select("g", "subroot"), "g"), "top")
    return Manifest(placed, subroots.select(group, "g", "subroot"), root[0] if root else None, paths(tree, top, fanout))


def verified(docs: DataFrame, tampered: Column, columns: tuple[str, ...] = COLUMNS, text: str = "text", doc_id: str = "doc_id", source: str = "source", fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: rows marked tampered (a null mark isn't) are
    checked with a text that lacks its newlines against the manifest of the table as it was."""
    whole = [F.col(f"`{c}`") for c in columns]
    less = [F.replace(c, F.lit("\n"), F.lit("")) if name == text else c for c, name in zip(whole, columns, strict=True)]
    changed = F.coalesce(tampered, F.lit(False)) & F.coalesce(F.instr(F.col(f"`{text}`"), "\n") > 0, F.lit(False))
    leaves = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), leaf(whole).alias("leaf"), F.when(changed, leaf(less)).alias("found"))
    made = build(leaves, fanout=fanout)
    rows = made.leaves.join(made.proofs, ["g", "i"]).withColumn("root", F.lit(made.root))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("found", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle() -> str:
    """The same for DuckDB with the default parameters and the query's mark (2 divides the crc32 of the id in decimal)."""
    h = lambda col: f"CASE WHEN {col} IS NULL THEN '-' ELSE strlen({col}::VARCHAR)::VARCHAR || ':' || {col}::VARCHAR END"
    parts = lambda text: " || ".join(h(c) for c in ("doc_id", "source", "lang", "n_chars", text))
    steps = "list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END)"
    return f"""
WITH RECURSIVE marked AS (SELECT *, row_number() OVER () AS n, coalesce(xor({steps}, 4294967295) % 2 = 0, false) AS t FROM documents),
leaves AS (
  SELECT n, doc_id, source, sha256({parts("text")}) AS leaf, sha256({parts("less")}) AS found
  FROM (SELECT *, CASE WHEN t THEN replace(text, chr(10), '') ELSE text END AS less FROM marked)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, n) - 1 AS i, count(*) OVER (PARTITION BY source) AS m, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM leaves
),
low AS (
  SELECT 0 AS k, g, i, m, leaf AS d FROM placed
  UNION ALL
  SELECT k + 1, g, i // {FANOUT}, (m + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(d, '' ORDER BY i)) FROM low WHERE m > 1 GROUP BY k, g, i // {FANOUT}, (m + {FANOUT - 1}) // {FANOUT}
),
subroots AS (SELECT g AS i, count(*) OVER () AS m, d FROM low WHERE m = 1),
high AS (
  SELECT 0 AS k, i, m, d FROM subroots
  UNION ALL
  SELECT k + 1, i // {FANOUT}, (m + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(d, '' ORDER BY i)) FROM high WHERE m > 1 GROUP BY k, i // {FANOUT}, (m + {FANOUT - 1}) // {FANOUT}
),
root AS (SELECT d AS root FROM high WHERE m = 1),
steps AS (
  SELECT p.n, b.k AS k, b.i AS i, b.d AS d, sign(b.i - p.i // ({FANOUT} ** b.k)::BIGINT) AS side
  FROM placed p JOIN low b ON b.g = p.g AND b.m > 1 AND b.i // {FANOUT} = p.i // ({FANOUT} ** (b.k + 1))::BIGINT
  UNION ALL
  SELECT p.n, 100 + b.k, b.i, b.d, sign(b.i - p.g // ({FANOUT} ** b.k)::BIGINT) FROM placed p JOIN high b ON b.m > 1 AND b.i // {FANOUT} = p.g // ({FANOUT} ** (b.k + 1))::BIGINT
),
runs AS (
  SELECT n, k, coalesce(string_agg(d, '' ORDER BY i) FILTER (WHERE side < 0), '') AS l, coalesce(string_agg(d, '' ORDER BY i) FILTER (WHERE side > 0), '') AS r, row_number() OVER (PARTITION BY n ORDER BY k) AS step
  FROM steps GROUP BY n, k
),
fold AS (
  SELECT n, 0::BIGINT AS step, found AS d FROM placed
  UNION ALL
  SELECT f.n, r.step, sha256(r.l || f.d || r.r) FROM fold f JOIN runs r ON r.n = f.n AND r.step = f.step + 1
),
proofs AS (SELECT n, string_agg(l || r, '' ORDER BY step) AS proof FROM runs GROUP BY n),
ends AS (SELECT n, arg_max(d, step) AS folded_root FROM fold GROUP BY n)
SELECT doc_id, leaf, s.d AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots s ON s.i = placed.g CROSS JOIN root JOIN ends USING (n) LEFT JOIN proofs USING (n)
"""
