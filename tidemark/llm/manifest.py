"""A Merkle tree over a dataset, and the proof of every row.

A row's leaf is the digest of its columns. The leaves of a source form a tree by ascending id, the
sources' roots form another, and 16 consecutive nodes have one parent. So that no group grows with
the data, a node's rank is written in digits of base 16, and two digits at a time are grouped away
inside blocks of 256 nodes: children become an array of structs inside their run, runs an array inside
their block. One row for each block is left, and those rows climb in the same way until a
source has one. On the way down each block is given the runs above it, and ``explode`` hands
every child those and its own run. No join touches a row: leaves meet others only inside their block,
and only blocks, one for 256 nodes, are joined with the path above them.

Ranks come from rows stored in range-partitioned order: the place within a partition plus the counts of
the partitions before it, so a source that holds a third of all rows is spread over many tasks.

Null columns are told from empty ones. Null ids come first, rows with one id are ordered by their leaf,
and equal rows have equal leaves. A table without rows has no root and no proofs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import require
from tidemark.plans.stage import stored

FAN = 16
BLOCK = FAN * FAN
DIGEST = 64

#: The columns of a leaf, in order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: One in so many documents is tampered with by the test of proofs.
TAMPERED = 5

PATH = f"array<struct<run: string, digit: int>>"


def told(c: Column) -> Column:
    """A value with its length in bytes, or a mark for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(told, columns)), 256)


def tampered(key: Column, text: Column) -> Column:
    """The text with letters A-Z in lower case, for one in ``TAMPERED`` keys; null elsewhere."""
    return F.when(F.crc32(key.cast("string")) % TAMPERED == 0, F.translate(text, UPPER, UPPER.lower()))


def levels(n: Column) -> Column:
    """How often ``n`` nodes are gathered until one is left."""
    steps = F.array(*[F.lit(FAN**i).cast("long") for i in range(16)])
    return F.size(F.filter(steps, lambda s: s < n))


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows in stored order with ``_part, _at``, and ``group, _part, _first, _before, _many`` to number them.

    The second table has a row for each group and partition: where the group begins in it, how many rows it
    has in earlier ones, and in all.
    """
    by = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(
        rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_part": F.spark_partition_id(), "_at": at}), "ranked"
    )
    counts = placed.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    within = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    before = within.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return placed, counts.select(
        *group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(within).alias("_many")
    )


def rank() -> Column:
    return F.col("_at") - F.col("_first") + F.col("_before")


def joined_hashes(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda k: k["hash"]), "")


def nested(nodes: DataFrame, level: int, payload: Sequence[str] = ()) -> DataFrame:
    """``tree, height, block, hash, runs`` from ``tree, height, at, hash`` and ``payload``: two digits of the rank grouped away.

    ``level`` is that of the nodes. A tree that is not higher has one node here, which goes on as it is.
    """
    digits = {
        "block": F.floor(F.col("at") / BLOCK),
        "d1": (F.floor(F.col("at") / FAN) % FAN).cast("int"),
        "d0": (F.col("at") % FAN).cast("int"),
    }
    own = ["tree", "height", "block"]

    def above(kids: Column, depth: int) -> Column:
        return F.when(F.col("height") > level + depth, F.sha2(joined_hashes(kids), 256)).otherwise(kids[0]["hash"])

    return (
        nodes.withColumns(digits)
        .repartition(*own)
        .groupBy(*own, "d1")
        .agg(F.sort_array(F.collect_list(F.struct("d0", "hash", *payload))).alias("kids"))
        .withColumn("hash", above(F.col("kids"), 0))
        .groupBy(*own)
        .agg(F.sort_array(F.collect_list(F.struct("d1", "hash", "kids"))).alias("runs"))
        .withColumn("hash", above(F.col("runs"), 1))
    )


def climb(nodes: DataFrame) -> list[DataFrame]:
    """``tree, height, at, hash`` of the nodes at every second level; the last table has one for each tree."""
    top = nodes.agg(F.max("height")).first()[0] or 0
    out = [nodes]
    while 2 * (len(out) - 1) < top:
        blocks = nested(out[-1], 2 * (len(out) - 1))
        out.append(stored(blocks.select("tree", "height", F.col("block").alias("at"), "hash"), "nodes"))
    return out


def descend(stages: list[DataFrame], top: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """``tree, height, at, hash, path`` with ``payload`` and the further columns of ``top``, for the nodes of the first stage.

    A path holds the run and the place in it at each level, from the node upwards. ``top`` gives ``tree, path``
    for each tree, and what all its nodes are to be told.
    """
    told_down = [c for c in top.columns if c not in ("tree", "height", "path", "at")]
    above = top
    for k in range(len(stages) - 2, -1, -1):
        level, last = 2 * k, k == 0
        carried = payload if last else ()
        blocks = nested(stages[k], level, carried).select("tree", "height", F.col("block").alias("at"), "runs")
        rows = blocks.join(above.select("tree", "height", "at", "path", *told_down), ["tree", "height", "at"])
        run = rows.select("*", joined_hashes(F.col("runs")).alias("r1"), F.explode("runs").alias("one")).drop("runs")
        kid = run.select("*", joined_hashes(F.col("one.kids")).alias("r0"), F.col("one.d1"), F.explode("one.kids").alias("kid")).drop("one")

        def step(name: str, digit: Column, depth: int) -> Column:
            here = F.array(F.struct(F.col(name).alias("run"), digit.cast("int").alias("digit")))
            return F.when(F.col("height") > level + depth, here).otherwise(F.array().cast(PATH))

        path = F.concat(step("r0", F.col("kid.d0"), 0), step("r1", F.col("d1"), 1), F.col("path"))
        place = F.col("at") * BLOCK + F.col("d1") * FAN + F.col("kid.d0")
        above = kid.select(
            "tree", "height", place.alias("at"), F.col("kid.hash").alias("hash"), path.alias("path"), *told_down, *[F.col(f"kid.{c}").alias(c) for c in carried]
        )
        if not last:
            above = stored(above, "paths")
    return above


def siblings(step: Column) -> tuple[Column, Column]:
    """The digests before and after the node in its run."""
    before = step["digit"] * DIGEST
    return F.substring(step["run"], F.lit(1), before), F.substring(step["run"], before + (DIGEST + 1), F.lit(DIGEST * FAN))


def proof(path: Column) -> Column:
    """Digest of all siblings from the leaf up to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(*siblings(s))), ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""

    def up(node: Column, step: Column) -> Column:
        before, after = siblings(step)
        return F.sha2(F.concat(before, node, after), 256)

    return F.aggregate(path, start, up)


def manifest(docs: DataFrame, columns: Sequence[str] = LEAF, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``key, source, leaf, tampered_leaf, subroot, root, path`` of every document."""
    require(docs, *columns, key, source, text)
    changed = tampered(F.col(key), F.col(text))
    leaves = stored(
        docs.select(
            F.col(key).alias("key"),
            F.col(source).cast("string").alias("source"),
            leaf([F.col(c) for c in columns]).alias("hash"),
            F.when(changed != F.col(text), leaf([changed if c == text else F.col(c) for c in columns])).alias("changed"),
        ),
        "leaves",
    )
    placed, spans = ranked(leaves, ["source"], ["key", "hash"])
    spans = stored(spans, "spans")
    # The sources' own ranks make them the leaves of the upper tree.
    names, counts = ranked(spans.select("source").distinct(), [], ["source"])
    sources = stored(
        names.join(counts, "_part").select("source", rank().alias("tree"), levels(F.col("_many")).alias("above")), "sources"
    )
    known = spans.join(sources, spans["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumnRenamed("source", "_source")
    nodes = placed.join(known, (placed["_part"] == known["_part"]) & placed["source"].eqNullSafe(known["_source"])).select(
        "tree", levels(F.col("_many")).alias("height"), rank().alias("at"), "hash", "key", "source", "changed"
    )
    low = climb(nodes)
    subroots = low[-1] if len(low) > 1 else stored(nodes, "nodes")
    subroots = subroots.select("tree", "height", "at", F.col("hash").alias("subroot"))
    trees = subroots.join(sources.select("tree", "above"), "tree").select(
        F.lit(0).cast("long").alias("tree"), F.col("above").alias("height"), F.col("tree").alias("at"), F.col("subroot").alias("hash"), F.col("height").alias("below")
    )
    high = climb(stored(trees, "trees"))
    no_path = F.array().cast(PATH)
    root = high[-1].select("tree", "height", "at", no_path.alias("path"), F.col("hash").alias("root"))
    if len(high) > 1:
        tops = descend(high, root, ["below"])
    else:
        tops = high[0].select("*", no_path.alias("path"), F.col("hash").alias("root"))
    top = tops.select(
        F.col("at").alias("tree"), F.col("below").alias("height"), F.lit(0).cast("long").alias("at"), "path", F.col("hash").alias("subroot"), "root"
    )
    if len(low) > 1:
        rows = descend(low, stored(top, "tops"), ["key", "source", "changed"])
    else:
        rows = nodes.join(top.drop("at", "height"), "tree")
    return rows.select(
        F.col("key").alias(key), F.col("source").alias(source), F.col("hash").alias("leaf"), F.coalesce("changed", "hash").alias("tampered_leaf"), "subroot", "root", "path"
    )


def digest(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digest of each proof, and the root that follows from the tampered leaf."""
    again = rows.withColumn("folded_root", folded(F.col("tampered_leaf"), F.col("path")))
    return again.select(key, "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


LEVELS = 8  # of the SQL: 16 ** 8 rows a source and as many sources

_told = "COALESCE(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')".format


def _leaf(text: str) -> str:
    parts = [f"CAST({c} AS VARCHAR)" for c in LEAF[:-1]] + [text]
    return f"sha256({' || '.join(map(_told, parts))})"


def _tree(name: str, base: str) -> str:
    """CTEs of a tree over ``base(tree, i, hash)``: nodes ``{name}{k}`` and runs ``{name}r{k}``."""
    out = [f"{name}0 AS MATERIALIZED (SELECT tree, i, hash FROM {base})"]
    for k in range(LEVELS):
        out.append(f"""{name}r{k} AS MATERIALIZED (SELECT tree, i // 16 AS i, string_agg(hash, '' ORDER BY i) AS run, any_value(c) AS c
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM {name}{k}) GROUP BY 1, 2)""")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, i, CASE WHEN c > 1 THEN sha256(run) ELSE run END AS hash FROM {name}r{k})")
    return ",\n".join(out)


def _fold(name: str, base: str, out: str) -> str:
    """CTEs that fold ``node`` of ``base(id, tree, i, node, told)`` through a tree."""
    parts, now = [], base
    for k in range(LEVELS):
        d = f"(64 * ((b.i // {16**k}) % 16))"
        before, after = f"substr(run, 1, {d})", f"substr(run, {d} + 65)"
        made = f"{out}_{k}"
        parts.append(f"""{made} AS MATERIALIZED (SELECT id, b.tree, b.i, CASE WHEN c > 1 THEN sha256({before} || node || {after}) ELSE node END AS node,
  told || CASE WHEN c > 1 THEN {before} || {after} ELSE '' END AS told FROM {now} b JOIN {name}r{k} r ON r.tree = b.tree AND r.i = b.i // {16 ** (k + 1)})""")
        now = made
    return ",\n".join([*parts, f"{out} AS (SELECT * FROM {now})"])


#: DuckDB SQL of the registered query. CRC-32 is folded from its table over the digits of the id.
SQL = f"""WITH crc AS (SELECT list(list_reduce([i] || list_transform(range(8), lambda x: CAST(x AS BIGINT)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)),
d0 AS (SELECT *, row_number() OVER () AS id, xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % {TAMPERED} = 0 AS hit FROM documents, crc),
d1 AS MATERIALIZED (SELECT id, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, source, {_leaf("text")} AS leaf,
  CASE WHEN hit THEN {_leaf(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} ELSE {_leaf("text")} END AS changed FROM d0),
d2 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d1),
{_tree("n", "(SELECT tree, i, leaf AS hash FROM d2)")},
{_tree("s", f"(SELECT 0 AS tree, tree AS i, hash FROM n{LEVELS})")},
f0 AS (SELECT id, tree, i, changed AS node, '' AS told FROM d2),
{_fold("n", "f0", "f1")},
f2 AS (SELECT id, 0 AS tree, tree AS i, node, told FROM f1),
{_fold("s", "f2", "f3")}
SELECT d2.doc_id, d2.leaf, n{LEVELS}.hash AS subroot, s{LEVELS}.hash AS root, sha256(f3.told) AS proof_sha256, f3.node AS folded_root, f3.node = s{LEVELS}.hash AS verified
FROM d2 JOIN f3 USING (id) JOIN n{LEVELS} ON n{LEVELS}.tree = d2.tree JOIN s{LEVELS} ON true"""
