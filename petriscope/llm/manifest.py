"""Merkle manifest of a dataset: a node store in Parquet, one folder a level, and proofs read from it.

Every row is a leaf.  The leaves of a group are numbered in order (sorted runs,
dealt by ranges and written), and every ``FANOUT`` consecutive nodes become one
of the next level: each level is made from the folder of the one before, and a
row of the store is a run, its nodes in order with the digest they make.  The
groups' subroots are the leaves of one more tree of the same kind.  Proofs go
down again: a level's runs are joined with their parents by coordinate (group,
run), so what is above a run is put together once and not for each of its
leaves.  No node is in memory that is not in the row at hand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import numbered
from .common import written
from ..sinks.shared import new_place

#: Nodes of a run.
FANOUT = 16
_STEP = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def encoded(fields: list[Column]) -> Column:
    """The fields one after the other: ``-`` for null, else UTF-8 bytes, colon, value."""
    text = [f.cast("string") for f in fields]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text))


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda m: m["digest"]), "")


@dataclass
class NodeStore:
    """Trees in ``path``/level=k: (tree, size, run, members, digest), a row a run of level k.

    ``members`` are (index, digest, …) in order, ``size`` is the number of the
    tree's nodes on the level, ``digest`` is what the run makes: the node of the
    next level, or the only node itself.
    """

    spark: SparkSession
    path: str
    levels: int
    schemas: list

    def level(self, k: int) -> DataFrame:
        return self.spark.read.schema(self.schemas[k]).parquet(f"{self.path}/level={k}")

    def tops(self) -> DataFrame:
        """(tree, digest): the node that remains of each tree."""
        parts = [self.level(k).where(F.col("size") <= FANOUT).select("tree", "digest") for k in range(self.levels)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def paths(self, seeds: DataFrame) -> DataFrame:
        """The runs of level 0 with ``above``, the siblings of all levels above theirs, and the columns of ``seeds``.

        ``seeds`` (tree, above, …) is what is above each tree's top node.
        """
        more = [c for c in seeds.columns if c not in ("tree", "above")]
        down = None  # (tree, run, above, more) of the runs of the level at hand that have parents
        for k in reversed(range(self.levels)):
            runs = self.level(k)
            out = runs.where(F.col("size") <= FANOUT).join(seeds, "tree")
            if down is not None:
                out = out.unionByName(runs.where(F.col("size") > FANOUT).join(down, ["tree", "run"]).select(out.columns))
            if k:
                each = out.select("tree", "above", *more, "members", F.posexplode("members").alias("at", "m"))
                down = each.select("tree", F.col("m.index").alias("run"), F.concat(F.array(siblings(F.col("members"), F.col("at"))), "above").alias("above"), *more)
        return out


def siblings(members: Column, at: Column) -> Column:
    """What stands left and right of a run's member, digests joined."""
    return F.struct(_joined(F.slice(members, F.lit(1), at)).alias("left"), _joined(F.slice(members, at + 2, F.lit(FANOUT))).alias("right"))


def build(nodes: DataFrame) -> NodeStore:
    """The store of trees whose leaves are ``nodes`` (tree, index from 0, size, digest, …).

    The number of levels follows from the largest tree.  A run is a group of at
    most ``FANOUT`` rows, so a large tree is as many small groups.
    """
    spark, path = nodes.sparkSession, new_place(nodes.sparkSession, "nodes")
    schemas, k = [], 0
    extra = [c for c in nodes.columns if c not in ("tree", "index", "size", "digest")]
    while True:
        runs = nodes.groupBy("tree", "size", F.floor(F.col("index") / FANOUT).alias("run")).agg(F.array_sort(F.collect_list(F.struct("index", "digest", *extra))).alias("members"))
        own = F.when(F.col("size") == 1, F.col("members")[0]["digest"]).otherwise(digest(_joined(F.col("members"))))
        runs = runs.withColumn("digest", own)
        runs.write.parquet(f"{path}/level={k}")
        schemas.append(runs.schema)
        store = NodeStore(spark, path, k + 1, schemas)
        wide = store.level(k).where(F.col("size") > FANOUT)
        if wide.isEmpty():
            return store
        nodes = wide.select("tree", F.col("run").alias("index"), F.ceil(F.col("size") / FANOUT).alias("size"), "digest")
        extra, k = [], k + 1


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source", found: dict[str, Column] | None = None, altered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified), one row for each row of ``docs``.

    A leaf is the digest of ``fields``.  ``found`` are columns as they are when
    the dataset is checked, where ``altered`` is true; ``folded_root`` is the root
    that such a leaf gives with the siblings of the manifest, ``verified`` says
    whether it is the root.  ``proof`` is the list of (left, right) siblings, from
    the leaf's run to the root, joined digests; a run of one has two empty ones.

    Nulls in any field are encoded as such; a null group is a group, and first;
    a null id is first in its group.  Rows of one id stand in the order of their
    leaves, repeated rows are leaves of their own.  Texts are read once, whatever
    their length, and only digests leave the scan.  An empty table gives no
    rows.  Other columns don't matter, whatever their names.
    """
    found = found or {}
    original = [F.col(f"`{c}`") for c in fields]
    changed = [F.when(altered, found[c]).otherwise(F.col(f"`{c}`")) if c in found else F.col(f"`{c}`") for c in fields]
    group = F.col(f"`{group_col}`").cast("string")
    tree = F.coalesce(F.concat(F.lit("="), group), F.lit(""))  # null first, the others by their bytes
    now = F.when(altered, digest(encoded(changed))) if altered is not None else F.lit(None).cast("string")
    leaves = written(docs.select(tree.alias("tree"), F.col(f"`{id_col}`").alias("id"), digest(encoded(original)).alias("digest"), now.alias("now")), "leaves")
    store = build(numbered(leaves, ["id", "digest"], ["tree"], "index", size="size"))
    subroots = store.tops()
    above = build(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), ["group"], ["tree"], "index", size="size"))
    root = above.tops().select("tree", F.col("digest").alias("root"), F.array().cast(_STEP).alias("above"))
    tops = _members(above.paths(root), ["root"]).select(F.col("group").alias("tree"), F.col("path").alias("above"), F.col("leaf").alias("subroot"), "root")
    rows = _members(store.paths(written(tops, "subroots")), ["subroot", "root"])
    fold = F.aggregate("path", F.coalesce("now", "leaf"), lambda a, s: digest(F.concat(s["left"], a, s["right"])))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("path").alias("proof"), fold.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _members(runs: DataFrame, more: list[str]) -> DataFrame:
    """A row for each leaf: (leaf, path, its extra columns, more)."""
    each = runs.select("size", "above", *more, "members", F.posexplode("members").alias("at", "m"))
    own = F.when(F.col("size") > 1, F.array(siblings(F.col("members"), F.col("at")))).otherwise(F.array().cast(_STEP))
    return each.select("m.*", *more, F.col("m.digest").alias("leaf"), F.concat(own, "above").alias("path"))
