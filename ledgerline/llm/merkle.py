"""Merkle manifest of a table, with inclusion proofs.

Every row is a leaf; the leaves of a group, in key order, are hashed in runs of
``RUN`` up to one sub-root, and the sub-roots, in group order, up to the root.
Only every second level is stored (checkpoint): a stored row holds the
digests of one aligned subtree of RUN * RUN = 256 nodes, from which its two
missing levels are recomputed when they are needed. Proofs are extracted from
the top down: each stored subtree is hashed again, gives the siblings of its
nodes on both levels, and drops the interior nodes; the siblings further up
come with the subtree's parent, once per 256 nodes.

Positions come from a range partition by (group, key) with per-partition
offsets, so a group with a third of all rows is spread over many tasks, and no
group of rows larger than 256 is ever gathered.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import bound_batches, store

RUN = 16
SUBTREE = RUN * RUN
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STEP = "struct<at:int,others:array<string>>"


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """H of the fields: '-' for null, else the UTF-8 byte count, ':' and the value."""
    texts = [f.cast("string") for f in fields]
    coded = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
             for t in texts]
    return F.sha2(F.concat(*coded).cast("binary"), 256)


def group_key(source: Column) -> Column:
    """A string that sorts as the source does, with null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with pos (0-based place in its grp by ``order``) and m (rows of the grp).

    A grp that spans range partitions gets its offsets from a table with one
    row per (partition, grp).
    """
    ranged = store(rows.repartitionByRange("grp", *order).withColumn("pid", F.spark_partition_id()))
    inside = Window.partitionBy("pid", "grp").orderBy(*order)
    before = Window.partitionBy("grp").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("pid", "grp").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("pid", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"),
                           F.sum("n").over(Window.partitionBy("grp")).alias("m"))
    return (ranged.withColumn("pos", F.row_number().over(inside) - 1).join(counts, ["pid", "grp"])
            .withColumn("pos", F.col("pos") + F.col("off")).drop("pid", "off"))


def _subtrees(nodes: DataFrame, item: list[str]) -> DataFrame:
    """Stored rows (grp, g, m, items) of up to 256 consecutive nodes of a grp; item: the columns kept per node."""
    return store(nodes.groupBy("grp", F.floor(F.col("pos") / SUBTREE).alias("g"))
                 .agg(F.first("m").alias("m"), F.sort_array(F.collect_list(F.struct("pos", *item))).alias("items")))


def _hash_runs(digests: Column) -> Column:
    """Digests of the consecutive runs of RUN."""
    starts = F.sequence(F.lit(1), F.size(digests), F.lit(RUN))
    return F.transform(starts, lambda s: F.sha2(F.array_join(F.slice(digests, s, RUN), "").cast("binary"), 256))


def build(nodes: DataFrame, item: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Stored levels (every second one) and the roots (grp, digest) of nodes (grp, pos, m, digest, ...)."""
    levels, roots = [], None
    while True:
        level = _subtrees(nodes, item)
        levels.append(level)
        digests, alone = F.col("items.digest"), F.col("m") <= SUBTREE
        once = _hash_runs(digests)
        twice = F.element_at(_hash_runs(once), 1)
        up = level.select("grp", F.col("g").alias("pos"), F.ceil(F.col("m") / SUBTREE).alias("m"),
                          alone.alias("alone"),
                          F.when(alone & (F.col("m") == 1), digests[0])
                          .when(alone & (F.col("m") <= RUN), F.element_at(once, 1)).otherwise(twice).alias("digest"))
        up = store(up)
        done = up.where("alone").select("grp", "digest")
        roots = done if roots is None else roots.union(done)
        nodes, item = up.where("not alone").drop("alone"), ["digest"]
        if nodes.isEmpty():
            return levels, roots


def local_siblings(digests: list[str], total: int) -> list[list[tuple[int, list[str]]]]:
    """Per node of a subtree its (place in the run, the run's others) on the levels inside the subtree."""
    if total == 1:
        return [[]]
    runs = [digests[a:a + RUN] for a in range(0, len(digests), RUN)]
    out = [[(i % RUN, runs[i // RUN][:i % RUN] + runs[i // RUN][i % RUN + 1:])] for i in range(len(digests))]
    if total > RUN:
        above = [digest(r) for r in runs]      # regenerated here, dropped with this call
        for i, steps in enumerate(out):
            k = i // RUN
            steps.append((k, above[:k] + above[k + 1:]))
    return out


def fold(leaf: str, steps: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its siblings give."""
    for at, others in steps:
        leaf = digest([*others[:at], leaf, *others[at:]])
    return leaf


def _with_path(level: DataFrame, roots: DataFrame, above: DataFrame | None) -> DataFrame:
    """Subtree rows with the path (steps, bottom up) above their top node."""
    alone = level.where(F.col("m") <= SUBTREE).join(roots, "grp")
    if above is None:
        return alone
    inner = level.where(F.col("m") > SUBTREE).join(above.withColumnRenamed("pos", "g"), ["grp", "g"])
    return alone.unionByName(inner)


def _steps(path) -> list[tuple[int, list[str]]]:
    return [(s["at"], s["others"]) for s in path]


def descend(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The lowest level's subtrees with their path; roots: (grp, path, ...) above each tree's root."""
    extra = [c for c in roots.columns if c not in ("grp", "path")]
    above = None
    for level in reversed(levels[1:]):
        schema = T.StructType([T.StructField("grp", T.StringType()), T.StructField("pos", T.LongType()),
                               *[roots.schema[c] for c in extra], roots.schema["path"]])

        def paths(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    kept = [row[c] for c in extra]
                    inside = local_siblings([x["digest"] for x in row["items"]], row["m"])
                    for item, steps in zip(row["items"], inside):
                        path = [{"at": a, "others": o} for a, o in steps] + row["path"]
                        yield _batch([[row["grp"]], [item["pos"]], *[[x] for x in kept], [path]], schema)

        above = store(_with_path(level, roots, above).mapInArrow(paths, schema))
    return _with_path(levels[0], roots, above)


def _batch(columns: list[list], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema
    fields = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of documents.

    docs has doc_id, source, lang, n_chars and text; tampered: a condition on
    rows whose proof is checked against their text with A-Z lower-cased.

    Defined cases: a null field counts as '-'; a null source is a group of its
    own and sorts first; rows with a null id come first in their group; rows of
    one id are ordered by their leaf, and equal rows get neighbouring places in
    any order; a null condition is false; other columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    id_type = docs.schema["doc_id"].dataType
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = leaf_digest(*fields, F.translate(F.col("text").cast("string"), UPPER, UPPER.lower()))
    hit = F.lit(False) if tampered is None else tampered
    leaves = store(docs.select(
        group_key(F.col("source")).alias("grp"), "doc_id", leaf_digest(*fields, F.col("text")).alias("digest"),
        F.when(hit, lowered).alias("altered"), F.monotonically_increasing_id().alias("row")))
    levels, subroots = build(positions(leaves, ["doc_id", "digest", "row"]), ["doc_id", "digest", "altered"])
    subroots = store(subroots)
    sources = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("source"), "digest")
    top, root = build(positions(sources, ["source"]), ["source", "digest"])
    root = root.first()
    root = root["digest"] if root else ""

    end = spark.range(1).select(F.lit("").alias("grp"), F.expr(f"cast(array() as array<{STEP}>)").alias("path"))
    source_schema = T.StructType([T.StructField("grp", T.StringType()), T.StructField("subroot", T.StringType()),
                                  end.schema["path"]])

    def source_paths(batches):
        for batch in batches:
            for row in batch.to_pylist():
                inside = local_siblings([x["digest"] for x in row["items"]], row["m"])
                for item, steps in zip(row["items"], inside):
                    path = [{"at": a, "others": o} for a, o in steps] + row["path"]
                    yield _batch([[item["source"]], [item["digest"]], [path]], source_schema)

    roots = store(descend(top, end).mapInArrow(source_paths, source_schema))
    schema = T.StructType([T.StructField("doc_id", id_type)] + [
        T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
        + [T.StructField("verified", T.BooleanType())])

    def proofs(batches):
        for batch in batches:
            for row in batch.to_pylist():
                upper = _steps(row["path"])
                rest = "".join("".join(o) for _, o in upper)
                items = row["items"]
                out = []
                for item, steps in zip(items, local_siblings([x["digest"] for x in items], row["m"])):
                    proof = digest([*("".join(o) for _, o in steps), rest])
                    folded = fold(item["altered"] or item["digest"], steps + upper)
                    out.append((item["doc_id"], item["digest"], row["subroot"], root, proof, folded, folded == root))
                yield _batch([list(c) for c in zip(*out)], schema)

    return descend(levels, roots).mapInArrow(proofs, schema)
