"""Benchmark decontamination by size-partitioned MinHash containment search.

Documents are partitioned by the size of their shingle set (powers of 4) and
items by theirs (powers of 2). For each pair of partitions a one-permutation
MinHash with its own number of bins is used: so many bins for the largest
document of the partition that an item of the smallest size shares a bin's
minimum with every document that contains ``threshold`` of it, but for a chance
of ``MISS``. Items of so few shingles that no such number exists use one bin
per hash value. Items are the stated query set: they come in blocks of bounded
size, each block's index goes to every task, and all documents are searched
against it. Candidates are verified by exact containment of shingles in the
same task, so nothing is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import words as W
from ledgerline.llm.common import bound_batches, lower, shingles

BLOCK_BYTES = 1 << 20
MISS = 1e-6
_LOW48 = np.uint64((1 << 48) - 1)


def _sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(48-bit shingle values, document), distinct and sorted by document and value."""
    h, doc = shingles(W.split(lower(texts), W.PUNCT), size)
    key = np.unique((doc.astype(np.uint64) << np.uint64(48)) | (W.mix(h) >> np.uint64(16)))
    return key & _LOW48, (key >> np.uint64(48)).astype(np.int64)


def _level(n: np.ndarray, base: int) -> np.ndarray:
    """Smallest p with n <= base**p."""
    top = np.array([base ** p for p in range(64 // int(math.log2(base)))], dtype=np.float64)
    return np.searchsorted(top, n)


def bins(doc_level: int, item_level: int, threshold: float) -> int:
    """Bins for documents of up to 4**doc_level and items of over 2**(item_level - 1) shingles; 0: one per value."""
    least = math.ceil(threshold * (2 ** (item_level - 1) + 1 if item_level else 1) - 1e-9)
    hit = 1 - MISS ** (1 / least)   # chance needed that a shared shingle is the minimum of its bin
    if hit > 0.9:
        return 0
    load = 8.0
    while (1 - math.exp(-load)) / load < hit:
        load -= 0.05
    return max(1, math.ceil(4 ** doc_level / load))


def _minima(value: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Mask of the values that are their bin's minimum (input sorted by owner and value)."""
    if count == 0:
        return np.ones(len(value), dtype=bool)
    cell = ((value >> np.uint64(16)) * np.uint64(count)) >> np.uint64(32)
    new = np.ones(len(value), dtype=bool)
    new[1:] = (cell[1:] != cell[:-1]) | (owner[1:] != owner[:-1])
    return new


class Index:
    """MinHash index of one block of items."""

    def __init__(self, texts: list[str], size: int, threshold: float):
        self.size, self.threshold = size, threshold
        value, owner = _sets(pa.array(texts, pa.large_string()), size)
        self.cut = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.value = value
        level = _level(np.diff(self.cut), 2)
        self.levels = sorted({int(x) for x, n in zip(level, np.diff(self.cut)) if n})
        keys, items = [], []
        for p in range(24):
            for a in self.levels:
                mine = level[owner] == a
                v, o = value[mine], owner[mine]
                first = _minima(v, o, bins(p, a, threshold))
                keys.append(self._key(v[first], p, a))
                items.append(o[first])
        keys, items = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (keys, items))
        order = np.argsort(keys, kind="stable")
        self.keys, self.items = keys[order], items[order].astype(np.int64)
        self.bitmap = np.zeros(1 << 22, dtype=bool)
        self.bitmap[(self.keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    @staticmethod
    def _key(value: np.ndarray, p: int, a: int) -> np.ndarray:
        return W.mix(value + (np.uint64(p * 64 + a) << np.uint64(48)))

    def search(self, texts: pa.Array):
        """(document, item, shared shingles, item's shingles) of items contained to the threshold."""
        value, owner = _sets(texts, self.size)
        cut = np.searchsorted(owner, np.arange(len(texts) + 1))
        level = _level(np.diff(cut), 4)
        pairs = []
        for p in np.unique(level[np.diff(cut) > 0]):
            mine = level[owner] == p
            v, o = value[mine], owner[mine]
            for a in self.levels:
                first = _minima(v, o, bins(int(p), a, self.threshold))
                k, d = self._key(v[first], int(p), a), o[first]
                maybe = self.bitmap[(k & np.uint64((1 << 22) - 1)).astype(np.int64)]
                k, d = k[maybe], d[maybe]
                lo, hi = np.searchsorted(self.keys, k), np.searchsorted(self.keys, k, side="right")
                n = hi - lo
                at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pairs.append((np.repeat(d, n) << 32) | self.items[at])
        if not pairs:
            return
        for pair in np.unique(np.concatenate(pairs)):
            d, i = int(pair >> 32), int(pair & 0xFFFFFFFF)
            item, doc = self.value[self.cut[i]:self.cut[i + 1]], value[cut[d]:cut[d + 1]]
            at = np.minimum(np.searchsorted(doc, item), len(doc) - 1)
            shared = int((doc[at] == item).sum())
            if shared >= self.threshold * len(item) - 1e-9:
                yield d, i, shared, len(item)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", shingle_words: int = 5,
                 threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) for every item contained in a document.

    Containment: share of the item's distinct word shingles that occur in the
    document. Words are lower-cased runs without ASCII punctuation; an item or
    document of fewer than ``shingle_words`` words is one shingle. Defined
    cases: texts without a word (null, empty) match nothing; null ids are
    carried along; repeated documents give repeated rows, repeated items count
    once; empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")) \
        .where("text is not null").distinct()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("item_id", items.schema[0].dataType),
        T.StructField("n_shared", T.IntegerType()), T.StructField("n_shingles", T.IntegerType()),
        T.StructField("containment", T.DoubleType())])
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = None
    for b in range(blocks):
        rows = items.where(block == b).orderBy("item_id", "text").collect()  # a block of about BLOCK_BYTES
        held = spark.sparkContext.broadcast(
            (Index([r.text for r in rows], shingle_words, threshold), [r.item_id for r in rows]))

        def search(batches, held=held):
            index, names = held.value
            for batch in batches:
                text, ids = batch.column("text"), batch.column("doc_id")
                for lo, hi in W.slices(text):
                    hits = list(index.search(text.slice(lo, hi - lo)))
                    if hits:
                        d, i, s, n = map(list, zip(*hits))
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array([lo + x for x in d])), pa.array([names[x] for x in i]),
                             pa.array(s, pa.int32()), pa.array(n, pa.int32()),
                             pa.array([x / y for x, y in zip(s, n)], pa.float64())], schema.names)

        part = source.mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    return found
