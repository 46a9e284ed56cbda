"""Token ids of a corpus as a compressed binary dataset: static range asymmetric numeral system (rANS).

``write`` encodes the ids of all documents, in ascending id order, into

* ``table``: one frequency per token id, shared by all blocks (counted over the
  whole corpus, scaled to 2**bits);
* ``blocks``: independent blocks of ``BLOCK`` ids. A block's payload holds
  ``LANES`` interleaved coder states; every ``SEGMENT`` ids a checkpoint gives
  all states, the place in the words and the crc32 of the ids up to the next
  checkpoint, so that segments are decoded side by side or one by one. Beside
  the payload a row lists the documents that the block holds a part of.

Rows of a Parquet dataset carry the payloads, so a lost executor's task is
written again and committed as a whole, on any file system Spark can write.
``read`` decodes and checks every block (crc32 of the payload, of the table and
of every segment) and gives each document back; ``decode_range`` decodes only
the segments that a range of ids touches.

Payload, little-endian: magic, version, bits, lanes, segment, number of ids,
number of words, crc32 of the table; per segment the word offset, the crc32 and
the lane states (64 bits); the 32-bit words; crc32 of all before it.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import tokens
from ledgerline.llm import words as W
from ledgerline.llm.common import bound_batches, store
from ledgerline.session import scratch_path

BLOCK = 1 << 17
SEGMENT = 1 << 15
LANES = 256
FILE_IDS = 1 << 26            # ids of a range partition, if the session's partition count would make it larger
_GATHER = 8                   # blocks coded side by side
_LOW = np.uint64(1 << 31)     # states stay in [2**31, 2**63)
_HEAD = struct.Struct("<4sHHIIIII")
_MAGIC, _VERSION = b"RANS", 1


@dataclass
class Table:
    """Scaled frequencies: freq[id], cum[id], and the id of each slot of 2**bits."""

    bits: int
    freq: np.ndarray
    cum: np.ndarray
    crc: int

    @classmethod
    def of(cls, bits: int, freq: np.ndarray) -> Table:
        freq = np.asarray(freq, dtype=np.uint64)
        cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else freq
        return cls(bits, freq, cum, zlib.crc32(freq.astype("<u4").tobytes(), bits))

    def slots(self) -> np.ndarray:
        if not hasattr(self, "_slots"):
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def scaled(counts: np.ndarray) -> Table:
    """Frequencies in proportion to the counts that sum to 2**bits; every id that occurs gets at least one."""
    counts = np.asarray(counts, dtype=np.int64)
    present = np.flatnonzero(counts)
    bits = max(12, (16 * max(len(present), 1) - 1).bit_length())
    if bits > 28:
        raise ValueError("over 16 million different ids")
    freq = np.zeros(len(counts), dtype=np.int64)
    if len(present):
        total, whole = int(counts.sum()), 1 << bits
        share = counts[present].astype(np.float64) / total * whole
        freq[present] = np.maximum(1, np.floor(share).astype(np.int64))
        left = whole - int(freq.sum())
        by = np.lexsort((present, -counts[present]))
        while left:       # the remainder goes to, or comes from, the most frequent ids
            step = 1 if left > 0 else -1
            able = present[by] if step > 0 else present[by][freq[present[by]] > 1]
            some = able[:abs(left)]
            freq[some] += step
            left -= step * len(some)
    return Table.of(bits, freq)


def encode_blocks(ids: np.ndarray, table: Table, lanes: int = LANES, segment: int = SEGMENT) -> list[bytes]:
    """Payloads of blocks of equal length; ids: (blocks, n), n at least one. Lane j codes the ids at j, j + lanes, ..."""
    n_blocks, n = ids.shape
    if segment % lanes:
        raise ValueError("a segment is a whole number of rows of lanes")
    steps = -(-n // lanes)
    wide = np.zeros((n_blocks, steps * lanes), dtype=np.int64)
    wide[:, :n] = ids
    wide[:, n:] = int(table.freq.argmax())       # cheap padding, cut off again by n
    if (table.freq[wide] == 0).any():
        raise ValueError("an id that the table does not have")
    x = np.full((n_blocks, lanes), _LOW, dtype=np.uint64)
    shift = np.uint64(63 - table.bits)
    words, owners = [], []
    marks: list[tuple[np.ndarray, np.ndarray]] = []
    written = np.zeros(n_blocks, dtype=np.int64)
    for step in range(steps - 1, -1, -1):
        symbol = wide[:, step * lanes:(step + 1) * lanes]
        f, c = table.freq[symbol], table.cum[symbol]
        full = x >= (f << shift)
        if full.any():
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            count = full.sum(axis=1)
            owners.append(np.repeat(np.arange(n_blocks), count))
            written += count
            x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(table.bits)) + (x - q * f) + c
        if (step * lanes) % segment == 0:
            marks.append((x.copy(), written.copy()))
    # Decoding reads forward: the words of the last coded step come first.
    flat = np.concatenate([np.zeros(0, "<u4"), *reversed(words)])
    owner = np.concatenate([np.zeros(0, np.int64), *reversed(owners)])
    flat = flat[np.argsort(owner, kind="stable")]
    ends = np.cumsum(written)
    out = []
    for b in range(n_blocks):
        mine = flat[ends[b] - written[b]:ends[b]]
        parts = [_HEAD.pack(_MAGIC, _VERSION, table.bits, lanes, segment, n, len(mine), table.crc)]
        own = ids[b].astype("<u4")
        for k, (state, at) in enumerate(reversed(marks)):
            parts.append(struct.pack("<II", int(written[b] - at[b]),
                                     zlib.crc32(own[k * segment:(k + 1) * segment].tobytes())))
            parts.append(state[b].astype("<u8").tobytes())
        body = b"".join([*parts, mine.tobytes()])
        out.append(body + struct.pack("<I", zlib.crc32(body)))
    return out


@dataclass
class Block:
    """A parsed payload."""

    n: int
    lanes: int
    segment: int
    at: np.ndarray          # word offset of each segment
    crc: np.ndarray
    state: np.ndarray       # (segments, lanes)
    words: np.ndarray


def parse(payload: bytes, table: Table) -> Block:
    if len(payload) < _HEAD.size + 4 or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("damaged block: its checksum differs")
    magic, version, bits, lanes, segment, n, n_words, crc = _HEAD.unpack_from(payload)
    if (magic, version) != (_MAGIC, _VERSION):
        raise ValueError("not a block of this format")
    if (bits, crc) != (table.bits, table.crc):
        raise ValueError("the block was written with another table")
    segments = -(-n // segment)
    mark = np.dtype([("at", "<u4"), ("crc", "<u4"), ("state", "<u8", (lanes,))])
    marks = np.frombuffer(payload, dtype=mark, count=segments, offset=_HEAD.size)
    words = np.frombuffer(payload, dtype="<u4", count=n_words, offset=_HEAD.size + segments * mark.itemsize)
    return Block(n, lanes, segment, marks["at"].astype(np.int64), marks["crc"], marks["state"].astype(np.uint64), words)


def decode_segments(blocks: list[Block], which: list[tuple[int, int]], table: Table) -> list[np.ndarray]:
    """Ids of the segments (block, segment), decoded side by side and checked by their crc32."""
    if not which:
        return []
    lanes, segment = blocks[0].lanes, blocks[0].segment
    base = np.concatenate([[0], np.cumsum([len(b.words) for b in blocks])])
    words = np.concatenate([*(b.words for b in blocks), np.zeros(lanes, "<u4")]).astype(np.uint64)
    x = np.stack([blocks[b].state[s] for b, s in which])
    at = np.array([base[b] + blocks[b].at[s] for b, s in which])
    size = np.array([min(segment, blocks[b].n - s * segment) for b, s in which])
    rows = -(-size // lanes)
    slots, mask, bits = table.slots(), np.uint64((1 << table.bits) - 1), np.uint64(table.bits)
    out = np.zeros((len(which), int(rows.max()) * lanes), dtype=np.uint32)
    order = np.argsort(-rows, kind="stable")          # longer segments first, so that the live ones are a prefix
    x, at, rows_in = x[order], at[order], rows[order]
    for step in range(int(rows.max())):
        live = int(np.searchsorted(-rows_in, -step, side="left"))
        y = x[:live]
        slot = y & mask
        symbol = slots[slot]
        out[:live, step * lanes:(step + 1) * lanes] = symbol
        y = table.freq[symbol] * (y >> bits) + slot - table.cum[symbol]
        short = y < _LOW
        rank = np.cumsum(short, axis=1)
        more = words[np.minimum(at[:live, None] + rank - 1, len(words) - 1)]
        x[:live] = np.where(short, (y << np.uint64(32)) | more, y)
        at[:live] += rank[:, -1]
    result: list[np.ndarray] = [out[0]] * len(which)
    for place, k in enumerate(order):
        ids = out[place, :size[k]]
        b, s = which[k]
        if zlib.crc32(ids.astype("<u4").tobytes()) != int(blocks[b].crc[s]):
            raise ValueError("damaged block: the ids of a segment have another checksum")
        result[k] = ids
    return result


def decode_blocks(payloads: list[bytes], table: Table) -> list[np.ndarray]:
    """Ids of each payload."""
    blocks = [parse(p, table) for p in payloads]
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    for shape in sorted({(b.lanes, b.segment) for b in blocks}):
        own = [i for i, b in enumerate(blocks) if (b.lanes, b.segment) == shape]
        which = [(k, s) for k, i in enumerate(own) for s in range(len(blocks[i].at))]
        parts = decode_segments([blocks[i] for i in own], which, table)
        for k, i in enumerate(own):
            out[i] = np.concatenate([p for p, (b, _) in zip(parts, which) if b == k])
    return out


def decode_range(payload: bytes, start: int, stop: int, table: Table) -> np.ndarray:
    """Ids start .. stop - 1 of a block, decoding only the segments they lie in."""
    block = parse(payload, table)
    start, stop = max(0, start), min(stop, block.n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    first, last = start // block.segment, (stop - 1) // block.segment
    ids = np.concatenate(decode_segments([block], [(0, s) for s in range(first, last + 1)], table))
    return ids[start - first * block.segment:stop - first * block.segment]


def crc_join(a: int, b: int, length: int, cache: dict = {}) -> int:
    """crc32 of two joined byte strings from their own ones; length: bytes of the second."""
    def times(matrix, vector):
        total, k = 0, 0
        while vector:
            if vector & 1:
                total ^= matrix[k]
            vector >>= 1
            k += 1
        return total

    if not cache:
        one = [0xEDB88320] + [1 << k for k in range(31)]     # appending one zero bit
        for power in range(64):
            cache[power] = one
            one = [times(one, row) for row in one]
    bits, power = 8 * length, 0
    while bits:
        if bits & 1:
            a = times(cache[power], a)
        bits >>= 1
        power += 1
    return a ^ b


def _block_schema(id_type: T.DataType) -> T.StructType:
    part = T.StructType([T.StructField("doc_id", id_type), T.StructField("no", T.LongType()),
                         T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType())])
    return T.StructType([
        T.StructField("file", T.IntegerType()), T.StructField("first", T.LongType()),
        T.StructField("n", T.IntegerType()), T.StructField("payload", T.BinaryType()),
        T.StructField("docs", T.ArrayType(part))])


def _table_of(spark: SparkSession, path: str) -> Table:
    """The shared table; it has at most one row per id of the vocabulary."""
    rows = spark.read.parquet(f"{path}/table").orderBy("id").collect()
    bits = rows[0]["bits"]
    return Table.of(bits, np.array([r["freq"] for r in rows], dtype=np.uint64))


def tokenised(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n, ids, row): ids with the end id, little-endian, 16 bits each if the vocabulary allows."""
    bound_batches(docs.sparkSession)
    kind = "<u2" if tokens.vocabulary_size(tokenizer_path) <= 1 << 16 else "<u4"
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("n", T.LongType()),
                           T.StructField("ids", T.BinaryType())])

    def encode(batches):
        for batch in batches:
            text, doc = batch.column("text"), batch.column("doc_id")
            for lo, hi in W.slices(text):
                ids, first = tokens.encode_slice(text.slice(lo, hi - lo), tokenizer_path)
                raw = ids.astype(kind)
                yield pa.RecordBatch.from_arrays([
                    doc.slice(lo, hi - lo), pa.array(np.diff(first)),
                    pa.array([raw[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], schema.names)

    return store(source.mapInArrow(encode, schema).withColumn("row", F.monotonically_increasing_id()), codec="zstd")


def write(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Tokenise (doc_id, text) and write the dataset to ``path``.

    Order of the ids: doc_id ascending (null first), then the ids' checksum;
    rows equal in both keep their input order. A null or empty text is the end
    id alone; other columns are ignored; an empty table gives a dataset without
    blocks.
    """
    spark = docs.sparkSession
    size = tokens.vocabulary_size(tokenizer_path)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    rows = tokenised(docs, tokenizer_path)

    def count(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for one in batch.column("ids"):
                total += np.bincount(np.frombuffer(one.as_buffer(), dtype=kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    counts = rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    total = np.zeros(size, dtype=np.int64)
    for r in counts.collect():                       # at most one row per id of the vocabulary
        total[r["id"]] = r["n"]
    table = scaled(total)
    spark.createDataFrame([(i, int(f), table.bits) for i, f in enumerate(table.freq)], "id int, freq long, bits int"
                          ).coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((table.bits, table.freq))

    id_field = rows.schema["doc_id"]
    schema = _block_schema(id_field.dataType)

    def blocks(batches):
        from pyspark import TaskContext
        coder = Table.of(*shared.value)
        number = TaskContext.get().partitionId()
        part_type = _arrow(schema["docs"].dataType).value_type
        id_type = part_type.field("doc_id").type
        wait = [np.zeros(0, kind)]                   # ids not yet in a block, from place ``first`` of the file on
        names = pa.array([], id_type)                # the documents they belong to, with place, length and number
        start, size_, no = (np.zeros(0, np.int64) for _ in range(3))
        first, seen, rows_seen = 0, 0, 0

        def emit(last: bool):
            nonlocal first, wait, names, start, size_, no
            ids = np.concatenate(wait)
            whole = len(ids) // BLOCK
            groups = [ids[:whole * BLOCK].reshape(whole, BLOCK)] if whole else []
            rest = ids[whole * BLOCK:]
            if last and len(rest):
                groups.append(rest.reshape(1, -1))
            for group in groups:
                n = group.shape[1]
                for payload in encode_blocks(group, coder):
                    lo = int(np.searchsorted(start + size_, first, side="right"))
                    hi = int(np.searchsorted(start, first + n, side="left"))
                    begin = np.maximum(start[lo:hi], first)
                    end = np.minimum(start[lo:hi] + size_[lo:hi], first + n)
                    inside = pa.StructArray.from_arrays(
                        [names.slice(lo, hi - lo), pa.array(no[lo:hi]), pa.array((begin - first).astype(np.int32)),
                         pa.array((end - begin).astype(np.int32))], fields=list(part_type))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number], pa.int32()), pa.array([first]), pa.array([n], pa.int32()),
                         pa.array([payload], pa.binary()),
                         pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), inside)], schema.names)
                    first += n
            done = int(np.searchsorted(start + size_, first, side="right"))
            names, start, size_, no = names.slice(done), start[done:], size_[done:], no[done:]
            wait = [rest]

        for batch in batches:
            got = [np.frombuffer(one.as_buffer(), dtype=kind) for one in batch.column("ids")]
            n = np.array([len(x) for x in got], dtype=np.int64)
            names = pa.concat_arrays([names, batch.column("doc_id").cast(id_type)])
            start = np.concatenate([start, seen + np.cumsum(n) - n])
            size_ = np.concatenate([size_, n])
            no = np.concatenate([no, rows_seen + np.arange(len(n))])
            seen, rows_seen = seen + int(n.sum()), rows_seen + len(n)
            wait.extend(got)
            if seen - first >= _GATHER * BLOCK:
                yield from emit(False)
        yield from emit(True)

    ids = int(total.sum())
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ids // FILE_IDS))
    # The checksum and the row number spread the rows of one id over several ranges.
    (rows.withColumn("tie", F.crc32("ids")).repartitionByRange(files, "doc_id", "tie", "row")
     .sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "ids")
     .mapInArrow(blocks, schema).write.parquet(f"{path}/blocks"))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files at ``path``.

    start: ids of all documents before it. A document that spans blocks has its
    parts' checksums joined. Damaged blocks raise an error.
    """
    bound_batches(spark)
    table = _table_of(spark, path)
    shared = spark.sparkContext.broadcast((table.bits, table.freq))
    stored = spark.read.parquet(f"{path}/blocks")
    id_field = T.StructField("doc_id", stored.schema["docs"].dataType.elementType["doc_id"].dataType)
    schema = T.StructType([T.StructField("file", T.IntegerType()), T.StructField("no", T.LongType()), id_field,
                           T.StructField("at", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("crc", T.LongType()), T.StructField("whole", T.BooleanType())])

    def decode(batches):
        coder = Table.of(*shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, _GATHER):
                part = batch.slice(lo, _GATHER)
                payloads = part.column("payload").to_pylist()
                for ids, f, first, docs in zip(decode_blocks(payloads, coder), part.column("file").to_pylist(),
                                               part.column("first").to_pylist(), part.column("docs")):
                    raw = memoryview(ids.astype("<u4")).cast("B")
                    docs = docs.values
                    at, n = (docs.field(c).to_numpy() for c in ("at", "n"))
                    crc = [zlib.crc32(raw[4 * a:4 * (a + k)]) for a, k in zip(at.tolist(), n.tolist())]
                    whole = (at > 0) & (at + n < len(ids))     # a document at an edge may go on in a neighbour
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), f, np.int32)), docs.field("no"), docs.field("doc_id"),
                         pa.array(first + at.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64()),
                         pa.array(whole)], schema.names)

    parts = store(stored.mapInArrow(decode, schema))

    @F.pandas_udf("long")
    def joined(pieces):
        import pandas as pd
        out = []
        for doc in pieces:
            crc, done = 0, False
            for p in doc:
                crc = crc_join(crc, p["crc"], 4 * p["n"]) if done else p["crc"]
                done = True
            out.append(crc)
        return pd.Series(out)

    edges = (parts.where("not whole").groupBy("file", "no")
             .agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n"),
                  F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces"))
             .select("file", "doc_id", "at", "n", joined("pieces").alias("crc")))
    # One row per file; the running sum gives each file's first id.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = stored.groupBy("file").agg(F.sum("n").alias("ids")).select(
        "file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("off"))
    return (parts.where("whole").select("file", "doc_id", "at", "n", "crc").unionByName(edges)
            .join(F.broadcast(files), "file")
            .select("doc_id", (F.col("at") + F.col("off")).alias("start"), F.col("n").alias("n_tokens"),
                    F.col("crc").alias("ids_crc32")))


def round_trip(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write the dataset and read it back; see ``write`` for defined cases."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "ids")
    write(docs, path, tokenizer_path)
    return read(spark, path)
