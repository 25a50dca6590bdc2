"""Operator 12: Merkle manifest of a dataset, with proofs by butterfly exchange.

Every row is a leaf. The leaves of a group (language), in order of id, are the
bottom of a tree of fanout 8; the groups' roots are the leaves of one more such
tree, whose root stands for the dataset.

Rows are range-sorted once and numbered by a prefix sum over the counts of the
sorted partitions, so neither a group nor the whole table passes one task. A
*chunk* is 8^4 neighbouring leaves: it is reduced to its root by itself. Then
the chunks meet in a butterfly: in round r, the chunks whose numbers differ in
their r-th digit of base 8 alone swap the roots of the subtrees they are in,
and each hashes the common ancestor for itself. After log8(chunks) rounds every
chunk holds its whole path to the group's root, and no pass down the tree
follows. Where the last subtree of a level has fewer chunks than its
neighbours, its chunks send their root to the partners that lack one as well.
A swap is a window over at most 8 rows (one shuffle of one row per chunk); the
groups' roots go through the same rounds. Last, each chunk gives its leaves
their proofs and folds them.

Cases: null fields count as ``-``; a null group is a group of its own and comes
first; null ids come first within a group and are never tampered with; rows of
equal id are ordered by leaf, equal rows have equal leaves and may swap their
proofs; texts of any length are hashed in the JVM, only digests are shuffled;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skywatch.llm.common import materialize, table

FANOUT = 8
CHUNK_LEVELS = 4  # levels of the tree within a chunk
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEPS = "array<struct<at:int,run:array<string>>>"


def digest_of(fields: Sequence[Column]) -> Column:
    """Leaf: each field as ``-`` or its UTF-8 byte count, a colon and its value."""
    parts = []
    for c in fields:
        v = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``pos`` (from 0, within their group, in ascending order, nulls first), and the size ``n`` of each group.

    Sorted by ranges over all rows; a row's position is its place in its partition after the counts of the partitions before."""
    tie = F.monotonically_increasing_id().alias("tie")  # many equal rows need not share a partition
    keys = [*group, *order, "tie"]
    placed = rows.select("*", tie).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    placed = materialize(placed.withColumn("place", F.monotonically_increasing_id()), f"{name}-sorted")
    part = F.shiftright("place", 33)
    counts = placed.groupBy(*group, part.alias("part")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("k"))
    counts = materialize(counts, f"{name}-counts")
    before = F.coalesce(F.sum("k").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("part").alias("_part"), (before - F.col("first")).alias("shift"))
    same = part == F.col("_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    out = placed.join(base, same).select(*rows.columns, (F.col("place") + F.col("shift")).alias("pos"))
    return out, counts.groupBy(*group).agg(F.sum("k").alias("n"))


def butterfly(nodes: DataFrame, most: int) -> DataFrame:
    """For nodes (tree, idx, n: nodes of the tree, h: digest), at most ``most`` to a tree: tree, idx, top (root of the tree)
    and steps (per level, from below: place in its run, and the digests of the run)."""
    state = nodes.select("tree", "idx", "n", "h", F.array().cast(STEPS).alias("steps"))
    size = 1
    while size < most:
        sub, low = F.expr(f"idx div {size}"), F.col("idx") % size
        active = F.col("n") > size
        # A last subtree of fewer nodes stands in for the missing ones as well.
        own = F.least(F.lit(size).cast("long"), F.col("n") - sub * size)
        lows = F.when(active & (sub % FANOUT > 0), F.sequence(low, F.lit(size - 1).cast("long"), own)).otherwise(F.array(low))
        sent = state.select("*", sub.alias("sub"), low.alias("low"), F.explode(lows).alias("to_low"))
        meeting = Window.partitionBy("tree", F.expr(f"sub div {FANOUT}"), "to_low")
        met = sent.withColumn("run", F.sort_array(F.collect_list(F.struct("sub", "h")).over(meeting))).where("to_low = low")
        run = F.col("run.h")
        step = F.struct((F.col("sub") % FANOUT).cast("int").alias("at"), run.alias("run"))
        state = met.select("tree", "idx", "n", F.when(active, F.sha2(F.concat_ws("", run).cast("binary"), 256)).otherwise(F.col("h")).alias("h"),
                           F.when(active, F.array_append("steps", step)).otherwise(F.col("steps")).alias("steps"))
        size *= FANOUT
    return state.select("tree", "idx", F.col("h").alias("top"), "steps")


def _h(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(leaves: list[str], height: int | None) -> list[list[str]]:
    """The levels of a chunk, from the leaves to its root; without a height the chunk is all of its tree, which may be lower."""
    levels = [leaves]
    while len(levels[-1]) > 1 if height is None else len(levels) <= height:
        last = levels[-1]
        levels.append([_h(last[k:k + FANOUT]) for k in range(0, len(last), FANOUT)])
    return levels


def _fold(h: str, steps: list[tuple[str, str]]) -> str:
    for left, right in steps:
        h = hashlib.sha256(f"{left}{h}{right}".encode()).hexdigest()
    return h


def _sides(at: int, run: Sequence[str]) -> tuple[str, str]:
    return "".join(run[:at]), "".join(run[at + 1:])


def manifest(leaves: DataFrame, id_col: str = "doc_id", group_col: str = "lang", chunk_levels: int = CHUNK_LEVELS) -> DataFrame:
    """Per row of ``leaves`` (id, group, leaf, tampered: leaf of the tampered row or null): id, leaf, subroot, root,
    proof_sha256, folded_root, verified."""
    rows = leaves.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), "leaf", "tampered")
    rows, sizes = numbered(rows, ["grp"], ["id", "leaf"], "merkle")
    width = FANOUT ** chunk_levels
    trees, _ = numbered(sizes.withColumn("one", F.lit(1)), ["one"], ["grp"], "merkle-groups")
    trees = materialize(trees.select(F.col("grp").alias("_grp"), F.col("pos").alias("tree"), "n"), "merkle-trees")
    bounds = trees.agg(F.max("n"), F.count(F.lit(1))).first()
    rows = rows.join(trees, F.col("grp").eqNullSafe(F.col("_grp"))) \
        .select("id", "leaf", "tampered", "tree", "n", "pos", F.expr(f"pos div {width}").alias("chunk"))
    rows = materialize(rows, "merkle-leaves")

    def chunk_root(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        levels = _levels(pdf.sort_values("pos")["leaf"].tolist(), None if n <= width else chunk_levels)
        return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "n": [-(-n // width)], "h": [levels[-1][0]]})

    chunks = rows.select("tree", "chunk", "n", "pos", "leaf").groupBy("tree", "chunk").applyInPandas(chunk_root, "tree long, idx long, n long, h string")
    paths = materialize(butterfly(chunks, -(-(bounds[0] or 0) // width)), "merkle-paths")
    tops = paths.where("idx = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(bounds[1]).alias("n"), F.col("top").alias("h"))
    upper = butterfly(tops, bounds[1]).select(F.col("idx").alias("_tree"), F.col("top").alias("root"), F.col("steps").alias("upper"))
    paths = materialize(paths.join(upper, F.col("tree") == F.col("_tree"))
                        .select("tree", F.col("idx").alias("chunk"), F.col("top").alias("subroot"), "root", F.concat("steps", "upper").alias("steps")), "merkle-proofs")

    def finish(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("pos")
        top = right.iloc[0]
        levels = _levels(left["leaf"].tolist(), None if int(left["n"].iloc[0]) <= width else chunk_levels)
        above = [_sides(int(s["at"]), list(s["run"])) for s in top["steps"]]
        above_proof = "".join(a + b for a, b in above).encode()
        sides = [[_sides(k % FANOUT, level[k - k % FANOUT:k - k % FANOUT + FANOUT]) for k in range(len(level))] for level in levels[:-1]]
        proofs, folded = [], []
        for k, (leaf, tampered) in enumerate(zip(left["leaf"], left["tampered"], strict=True)):
            steps = [level[k // FANOUT ** r] for r, level in enumerate(sides)]
            proof = hashlib.sha256("".join([a + b for a, b in steps]).encode())
            proof.update(above_proof)
            proofs.append(proof.hexdigest())
            folded.append(_fold(_fold(leaf if tampered is None else tampered, steps), above))
        out = left[["id", "leaf"]].assign(subroot=top["subroot"], root=top["root"], proof_sha256=proofs, folded_root=folded)
        out["verified"] = out["folded_root"] == out["root"]
        return out

    schema = f"id {dict(rows.dtypes)['id']}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.groupBy("tree", "chunk").cogroup(paths.groupBy("tree", "chunk")).applyInPandas(finish, schema).withColumnRenamed("id", id_col)


def leaves_of(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """``docs`` as (id, group fields, leaf, tampered): where ``tampered`` holds, the leaf with A-Z of the text lower-cased."""
    columns = [F.col(f"`{c}`") for c in fields]
    lowered = [F.translate(c, UPPER, LOWER) if name == text_col else c for name, c in zip(fields, columns, strict=True)]
    leaf = digest_of(columns)
    changed = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False)) & F.coalesce(F.col(f"`{text_col}`").rlike("[A-Z]"), F.lit(False))
    others = [F.col(f"`{c}`") for c in fields if c not in (text_col, "leaf", "tampered")]
    return docs.select(*others, leaf.alias("leaf"), F.when(changed, digest_of(lowered)).alias("tampered"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(leaves_of(docs, tampered=tampered))


# Trees level by level: each level's nodes are grouped by eights; proofs and folds follow the levels by leaf. crc32 by
# its table of 256 entries, computed from the polynomial.
ORACLE_OP12 = """
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM range(256) AS r(i))),
fields AS (
  SELECT doc_id, lang, COALESCE(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || COALESCE(strlen(source) || ':' || source, '-')
      || COALESCE(strlen(lang) || ':' || lang, '-') || COALESCE(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 AS tampered
  FROM documents, crc_table),
hashed AS (
  SELECT doc_id, lang, sha256(head || COALESCE(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN tampered THEN sha256(head || COALESCE(strlen(lowered) || ':' || lowered, '-')) END AS changed
  FROM fields),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM hashed),
nodes AS (
  SELECT 0 AS lvl, tree, pos AS idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lvl + 1, tree, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY lvl, tree, idx // 8, n),
trees AS (SELECT tree, h AS subroot, (SELECT count(DISTINCT tree) FROM leaves) AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, tree AS idx, n, subroot AS h FROM trees
  UNION ALL
  SELECT lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY lvl, idx // 8, n),
runs AS (
  SELECT lvl, tree, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT 1000 + lvl, -1, idx // 8, list(h ORDER BY idx) FROM tops WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT tree AS of_tree, pos, lvl, array_to_string(hs[:k], '') AS before, array_to_string(hs[k + 2:], '') AS after FROM (
    SELECT l.tree, l.pos, r.lvl, r.hs,
      CASE WHEN r.tree >= 0 THEN l.pos // (8 ** r.lvl)::BIGINT ELSE l.tree // (8 ** (r.lvl - 1000))::BIGINT END % 8 AS k
    FROM leaves l JOIN runs r ON CASE WHEN r.tree >= 0 THEN r.tree = l.tree AND r.run = l.pos // (8 ** (r.lvl + 1))::BIGINT
      ELSE r.run = l.tree // (8 ** (r.lvl - 999))::BIGINT END)),
paths AS (SELECT of_tree, pos, list(before ORDER BY lvl) AS lefts, list(after ORDER BY lvl) AS rights FROM steps GROUP BY of_tree, pos),
folds AS (
  SELECT tree, pos, 0 AS done, COALESCE(changed, leaf) AS h FROM leaves
  UNION ALL
  SELECT f.tree, f.pos, f.done + 1, sha256(p.lefts[f.done + 1] || f.h || p.rights[f.done + 1])
  FROM folds f JOIN paths p ON p.of_tree = f.tree AND p.pos = f.pos WHERE f.done < len(p.lefts)),
folded AS (SELECT tree, pos, arg_max(h, done) AS h FROM folds GROUP BY tree, pos),
proofs AS (SELECT of_tree, pos, sha256(string_agg(before || after, '' ORDER BY lvl)) AS proof FROM steps GROUP BY of_tree, pos)
SELECT l.doc_id, l.leaf, t.subroot, r.h AS root, COALESCE(p.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaves l JOIN trees t ON t.tree = l.tree JOIN folded f ON f.tree = l.tree AND f.pos = l.pos
LEFT JOIN proofs p ON p.of_tree = l.tree AND p.pos = l.pos, (SELECT h FROM tops WHERE n = 1) r
"""
