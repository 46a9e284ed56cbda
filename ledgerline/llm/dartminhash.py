"""Near-duplicate classes by DartMinHash signatures (weighted MinHash).

A document is the weighted set of its word shingles (weight: number of
occurrences). Darts fall on the plane of weight and rank as a Poisson process
that depends on the shingle alone, realised as exponential gaps drawn from
hashes, one strip per unit of weight. A dart hits the document if it lies
below the shingle's weight and below the document's rank limit t / (sum of
weights), so t darts are expected whatever the length. Each dart belongs to
one of ``bands * rows`` coordinates; the earliest dart of a coordinate is kept.
Two documents keep the same dart with a probability equal to their weighted
Jaccard similarity. Coordinates that t darts left empty are thrown for again
with a doubled limit.

Equal texts are merged first. Bands of ``rows`` coordinates are the bucket keys.
In a bucket, documents are compared exactly (whole shingle multisets) with
pivots: first all with the smallest, then, where a bucket still holds several
classes, with ``PIVOTS`` more pivots a round (linked documents first), until a
round finds less than ``MIN_YIELD`` links per comparison. What is then left,
the documents of buckets that were not compared in full and still hold several
classes, goes through an exact similarity join: two similar sets share one of
their first strips in any common order, so with rare strips first few pairs
have to be compared, and every link between two classes is found. No bucket is
held in one task and no bucket's pairs are all written out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerline.llm import words as W
from ledgerline.llm.common import (
    bound_batches, connected_components, free_name, lower, ordered_key, shingles, store, store_last, stored_paths,
    text_node, with_row_key)

PIVOTS = 2
#: Rounds go on while more than this share of the comparisons finds a link.
MIN_YIELD = 0.001
#: Cells of the strip frequency table: its size, and the broadcast's, is this many bytes whatever the input.
CELLS = 1 << 22
#: Darts drawn at once in a task (about 70 bytes each); a memory bound without effect on the signatures.
DARTS = 1 << 17
#: Strips whose prefixes are taken at once in a task (about 80 bytes each).
STRIPS = 1 << 19
_STRIP = np.uint64(0xD1B54A32D192ED03)
_GAP = np.uint64(0x8CB92BA72F3D8DD7)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def weight_strips(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(strip id, document), one per shingle occurrence: the j-th occurrence of a
    shingle in any document has the same id, so multiset similarity is set similarity of strips."""
    key = (docs.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16))
    key.sort()
    n = len(key)
    new = np.ones(n, dtype=bool)
    new[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(new)
    nth = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    shingle = key & np.uint64((1 << 48) - 1)
    return W.mix(shingle + nth.astype(np.uint64) * _STRIP), (key >> np.uint64(48)).astype(np.int64)


def _throw(strip: np.ndarray, doc: np.ndarray, limit: np.ndarray, sig: np.ndarray, k: int) -> None:
    """Throw each strip's darts up to its document's rank limit; keep the earliest per coordinate.

    DARTS darts are drawn at once: strips of short documents, with their high limits, come some at a time.
    """
    rank = np.zeros(len(strip))
    done, block = 0, 1
    while len(strip):
        n = np.arange(done, done + block, dtype=np.uint64) * _GAP
        on, end = np.zeros(len(strip), dtype=bool), np.empty(len(strip))
        some = max(1, DARTS // block)
        for lo in range(0, len(strip), some):
            part = slice(lo, lo + some)
            h = W.mix(strip[part, None] + n[None, :])
            gap = -np.log1p(-((h >> np.uint64(11)).astype(np.float64) / 9007199254740992.0))
            at = rank[part, None] + np.cumsum(gap, axis=1)
            owner = doc[part]
            hit = at < limit[owner][:, None]
            row = np.nonzero(hit)[0]
            dart = W.mix(h[hit] + np.uint64(1))
            coordinate = ((dart >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
            value = (at[hit].view(np.uint64) & ~np.uint64(0xFFFFF)) | (dart & np.uint64(0xFFFFF))
            np.minimum.at(sig, owner[row] * k + coordinate, value)
            on[part], end[part] = hit[:, -1], at[:, -1]
        rank, strip, doc = end[on], strip[on], doc[on]
        done += block
        block = 4 if block == 1 else 64


def signatures(strip: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """n_docs x k signature; rows of documents without shingles stay empty (all ones)."""
    sig = np.full(n_docs * k, _EMPTY, dtype=np.uint64)
    weight = np.bincount(doc, minlength=n_docs)
    t = k * (np.log(k) + 4)
    while len(strip):
        limit = t / np.maximum(weight, 1)
        _throw(strip, doc, limit, sig, k)
        missing = (sig.reshape(n_docs, k) == _EMPTY).any(axis=1)
        again = missing[doc]
        strip, doc = strip[again], doc[again]
        t *= 2
    return sig.reshape(n_docs, k)


def _strips_of(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    words = W.split(lower(texts), W.PUNCT)
    return weight_strips(*shingles(words, size))


def band_keys(texts: pa.Array, size: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(n x bands bucket keys, whether the text has any word)."""
    strip, doc = _strips_of(texts, size)
    n = len(texts)
    sig = signatures(strip, doc, n, bands * rows)
    has = np.bincount(doc, minlength=n) > 0
    keys = np.empty((n, bands), dtype=np.uint64)
    for b in range(bands):
        acc = np.full(n, b + 1, dtype=np.uint64)
        for c in range(b * rows, (b + 1) * rows):
            acc = W.mix(acc * _STRIP + sig[:, c])
        keys[:, b] = acc
    return keys.view(np.int64), has


def _exact_sets(texts: pa.Array, size: int) -> list[bytes]:
    """Each text's sorted 32-bit strip ids as bytes."""
    strip, doc = _strips_of(texts, size)
    ids = (strip >> np.uint64(32)) | (doc.astype(np.uint64) << np.uint64(32))
    ids.sort()
    cut = np.searchsorted(ids >> np.uint64(32), np.arange(len(texts) + 1, dtype=np.uint64))
    low = ids.astype(np.uint32)
    return [low[cut[i]:cut[i + 1]].tobytes() for i in range(len(texts))]


def _similar(a: bytes, b: bytes, threshold: float) -> bool:
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    small, large = min(len(x), len(y)), max(len(x), len(y))
    if small < threshold * large - 1e-9:
        return False
    z = np.concatenate([x, y])
    z.sort()
    shared = int((z[1:] == z[:-1]).sum())
    return shared >= threshold * (len(z) - shared) - 1e-9


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The rows of pairs (a, b, ...) whose exact weighted Jaccard similarity reaches the threshold."""
    @F.pandas_udf(T.BooleanType())
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_similar(x, y, threshold) for x, y in zip(a, b)], dtype=bool)

    one = sets.select(F.col("node").alias("a"), F.col("strips").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("strips").alias("sb"))
    return pairs.join(one, "a").join(two, "b").where(similar("sa", "sb")).drop("sa", "sb")


def _frequency_ranks(sets: DataFrame) -> np.ndarray:
    """Logarithmic rank of how many sets hold the strips of each cell; 0: one set at most."""
    def count(batches):
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            strips = np.frombuffer(b"".join(batch.column("strips").to_pylist()), np.uint32)
            total += np.bincount(strips % CELLS, minlength=CELLS)
        cells = np.flatnonzero(total)
        for at in range(0, len(cells), 1 << 18):
            some = cells[at:at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["cell", "n"])

    counts = (sets.select("strips").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
              .select("cell", F.least(F.floor(F.log2("n") * 8), F.lit(255)).cast("int").alias("rank"))).toArrow()
    ranks = np.zeros(CELLS, dtype=np.uint8)
    ranks[counts["cell"].to_numpy()] = counts["rank"].to_numpy()
    return ranks


def _candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, la, lb): every pair of sets (node, label, strips) of different labels that can be similar.

    Strips are ordered by frequency. Of n strips the first
    n - ceil(threshold * n) + 1 are kept, and fewer for the smaller set of a
    pair; similar sets share one of them, at places that leave enough strips
    behind. Strips of one set or of one label meet nobody. Sets of a strip's
    commonest label do not meet each other.
    """
    share = threshold / (1 + threshold)
    held = sets.sparkSession.sparkContext.broadcast(_frequency_ranks(sets))

    def prefixes(batches):
        for batch in batches:
            strips = [np.frombuffer(x, np.uint32) for x in batch.column("strips").to_pylist()]
            size = np.array([len(x) for x in strips], dtype=np.int64)
            upto = np.cumsum(size)
            lo = 0
            while lo < len(strips):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + STRIPS, side="right")))
                n, value = size[lo:hi], np.concatenate(strips[lo:hi])
                doc = np.repeat(np.arange(len(n)), n)
                key = ((doc.astype(np.uint64) << np.uint64(40)) | value
                       | (held.value[value % CELLS].astype(np.uint64) << np.uint64(32)))
                key.sort()
                place = np.arange(len(key)) - (np.cumsum(n) - n)[doc]
                longest = n - np.ceil(threshold * n - 1e-6).astype(np.int64) + 1
                smaller = n - np.ceil(2 * share * n - 1e-6).astype(np.int64) + 1
                keep = (place < longest[doc]) & ((key >> np.uint64(32)) & np.uint64(255) > 0)
                doc, place = doc[keep], place[keep]
                owner = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key[keep] & np.uint64(0xFFFFFFFF)).astype(np.int64)), batch.column("node").take(owner),
                     batch.column("label").take(owner), pa.array(place, pa.int32()), pa.array(n[doc], pa.int32()),
                     pa.array(place < smaller[doc])], ["strip", "node", "label", "place", "n", "first"])
                lo = hi

    rows = store(sets.mapInArrow(prefixes, "strip long, node binary, label binary, place int, n int, first boolean"))
    commonest = (rows.groupBy("strip", "label").agg(F.count("*").alias("c"))
                 .groupBy("strip").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("c"))
                 .where("c > 1").drop("c"))
    rows = store(rows.join(commonest, "strip").withColumn("rare", F.col("label") != F.col("main")).drop("main"))
    one = rows.where("first").select("strip", *(F.col(c).alias(f"{c}_a") for c in ("node", "label", "place", "n", "rare")))
    two = rows.select("strip", *(F.col(c).alias(f"{c}_b") for c in ("node", "label", "place", "n", "rare")))

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.join(y, "strip").where(
            f"label_a <> label_b and (n_a < n_b or (n_a = n_b and node_a < node_b)) and n_a >= {threshold} * n_b - 1e-6 "
            f"and least(n_a - place_a, n_b - place_b) >= {share} * (n_a + n_b) - 1e-6")

    return (meet(one, two.where("rare_b")).unionByName(meet(one.where("rare_a"), two.where("not rare_b")))
            .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("label_a").alias("la"),
                    F.col("label_b").alias("lb")).dropDuplicates(["a", "b"]))


def _merged(labels: DataFrame, merges: DataFrame) -> DataFrame:
    """labels after the classes of each row (a, b) of merges have become one."""
    onto = connected_components(merges)
    known = labels.unionByName(onto.select("node", F.col("node").alias("label"))
                               .join(labels.select("node"), "node", "left_anti"))
    return store(known.join(onto.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
                 .select("node", F.coalesce("to", "label").alias("label")))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                           threshold: float = 0.8, bands: int = 20, rows: int = 5) -> DataFrame:
    """(doc_id, class_id, is_kept), one row per input row.

    class_id is the smallest id of the class; is_kept marks the rows of that
    id. Words are lower-cased runs without ASCII punctuation. Defined cases:
    texts without a word (null, empty) are alone in a class; texts of fewer
    than ``shingle_words`` words are one shingle; rows with a null id get a
    null class and are kept; repeated rows are repeated in the result; an
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), text_node(F.col(text_col)).alias("node"),
                         F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    id_type = source.schema["doc_id"].dataType

    def sign(batches):
        for batch in batches:
            text = batch.column("text")
            for lo, hi in W.slices(text):
                keys, has = band_keys(text.slice(lo, hi - lo), shingle_words, bands, rows)
                offsets = pa.array(np.concatenate([[0], np.cumsum(has * bands)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("node").slice(lo, hi - lo),
                     pa.ListArray.from_arrays(offsets, pa.array(keys[has].ravel()))], ["doc_id", "node", "bands"])

    signed = store(source.mapInArrow(sign, T.StructType([
        T.StructField("doc_id", id_type), T.StructField("node", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType()))])))
    nodes = store(signed.where("size(bands) > 0").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.first("bands").alias("bands")))
    keyed = nodes.select(F.explode("bands").alias("key"), "node")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1")
    members = store(keyed.join(shared, "key").select("key", "node", "pivot", "n"))
    need = members.select("node").distinct().join(nodes.select("node", "first_id"), "node")

    def exact(batches):
        for batch in batches:
            text = batch.column("text")
            for lo, hi in W.slices(text):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(lo, hi - lo),
                     pa.array(_exact_sets(text.slice(lo, hi - lo), shingle_words), pa.binary())], ["node", "strips"])

    wanted = store(need.withColumnRenamed("first_id", "doc_id"))
    sets = store(source.join(wanted.hint("merge"), ["node", "doc_id"]).dropDuplicates(["node", "doc_id"])
                       .select("node", "text").mapInArrow(exact, "node binary, strips binary"))

    pairs = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = store(_verified(store(pairs), sets, threshold))
    labels = connected_components(links)
    linked = labels.select("node", F.lit(True).alias("linked"))
    members = store(members.drop("pivot").join(linked, "node", "left").select(
        "key", "node", "n", F.coalesce("linked", F.lit(False)).alias("linked"), F.xxhash64("node", "key").alias("draw")))
    used = 0
    while True:
        now = store(members.where(F.col("n") > used).join(labels, "node", "left")
                    .withColumn("label", F.coalesce("label", "node")))
        order = Window.partitionBy("key").orderBy(F.desc("linked"), "draw", "node")
        pivots = (now.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= used + PIVOTS)
                  .where(F.col("turn") > used)
                  .select("key", *(F.col(c).alias(f"pivot_{c}") for c in ("node", "label", "linked"))))
        # A linked document meets an unlinked pivot when their parts are exchanged.
        pairs = store(now.join(pivots, "key").where("label <> pivot_label and (pivot_linked or not linked)")
                      .select(F.least("node", "pivot_node").alias("a"), F.greatest("node", "pivot_node").alias("b"),
                              "label", "pivot_label").dropDuplicates(["a", "b"]))
        sets = store(sets.join(now.select("node").distinct(), "node", "left_semi"))
        merges = store(_verified(pairs, sets, threshold).select(F.col("label").alias("a"),
                                                                F.col("pivot_label").alias("b")))
        links, tried = merges.count(), pairs.count()
        used += PIVOTS
        if links:
            labels = _merged(labels, merges)
        if links <= MIN_YIELD * tried:
            break

    now = members.where(F.col("n") > used).join(labels, "node", "left").select(
        "key", "node", F.coalesce("label", "node").alias("label"))
    mixed = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    rest = store(now.join(mixed.select("key"), "key", "left_semi").select("node", "label").distinct())
    pairs = store(_candidates(store(rest.join(sets, "node")), threshold))
    merges = store(_verified(pairs, sets, threshold).select(F.col("la").alias("a"), F.col("lb").alias("b")))
    if not merges.isEmpty():
        labels = _merged(labels, merges)

    classed = store(nodes.select("node", "first_id").join(labels, "node", "left")
                          .select("node", "first_id", F.coalesce("label", "node").alias("label")))
    smallest = store(classed.groupBy("label").agg(F.min("first_id").alias("class_id")))
    by_node = store(classed.join(smallest, "label").select("node", "class_id"))
    with_words = signed.where("size(bands) > 0").select("doc_id", "node").join(by_node, "node")
    result = with_words.select("doc_id", "class_id").unionByName(
        signed.where("size(bands) = 0").select("doc_id", F.col("doc_id").alias("class_id")))
    unnamed = docs.where(F.col(id_col).isNull()).select(
        F.col(id_col).alias("doc_id"), F.lit(None).cast(id_type).alias("class_id"))
    return result.unionByName(unnamed).withColumn(
        "is_kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of one document of each class; all columns of ``docs``.

    Every row is a document of its own, whatever its id: of a class the row
    with the smallest id stays (null last; of equal ids, the first by the row's
    key). Texts without a word are alone in their class and stay, but equal
    rows of them, as others, stay each; an empty table gives an empty result.
    """
    key = free_name(docs, "_row_key")
    keyed = with_row_key(docs, key)
    before = stored_paths(docs.sparkSession)
    keyed = keyed.withColumn(key, ordered_key(F.col(id_col), F.col(key)))
    keep = near_duplicate_classes(keyed, key, text_col, **options).where("is_kept").select(F.col("doc_id").alias(key))
    return keyed.join(store_last(keep, before), key, "left_semi").select(*docs.columns)
