"""Removal of repeated word windows by level-wise doubling.

A window of ``size`` words is removed where its word sequence also starts
earlier in the corpus. Level 1 looks at half-length windows, and of those only
at anchors: of the half-windows inside each full window, the one with the
smallest hash. Equal full windows have equal anchors, so a full window can only
be repeated if its anchor is, and anchors are about a sixth of all positions.
Level 2 extends the surviving anchors alone to full length and finds which of
them start earlier elsewhere. (Longer levels would remove nothing more: every
longer repeat is covered by full windows.)

At both levels a task first settles repeats among its own documents and sends
one entry per distinct hash, so a passage that stands in a third of all
documents is one entry per task. Entries travel as packed arrays, dealt by
hash, and the marks they earn travel back packed by document. Equal texts are merged before: only the one with the smallest id has
windows, the others are copies throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import words as W
from ledgerline.llm.common import bound_batches, store, text_node

PART_BYTES = 24_000_000          # text bytes per hash partition (about 4 million windows)
SLICE = 1_000_000                # text bytes looked at together; memory is about 90 bytes per byte of it
_SPREAD = 4
_LAST = 2 ** 63 - 1              # a null id is later than every other
_ENTRY = "part int, own boolean, hash binary, pos binary, doc binary, node binary, ord binary"
_MARK = "part int, node binary, pos binary"
_DOC = "node binary, marks binary"
_GATHER = 800_000                # entries that a task gathers before it settles and sends them


def _anchors(words: W.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window start, its anchor's word index, anchor hash), for every window of ``size`` words."""
    half = size // 2
    h, at = W.window_hashes(words, half)
    value = np.zeros(len(words.hash), dtype=np.uint64)
    value[at] = h
    _, start = W.window_hashes(words, size) if size != half else (h, at)
    best, off = value[start], np.zeros(len(start), dtype=np.int64)
    for d in range(1, size - half + 1):
        other = value[start + d]
        less = other < best
        best = np.where(less, other, best)
        off[less] = d
    return start, start + off, best


def _entries(hashes, pos, doc, order, nodes, ords, parts, mark_all):
    """Settle repeats within the batch; yield rows of packed entries and the batch's own marks.

    order: earliness of each entry; mark_all: mark the first of repeated entries too.
    """
    rank = np.lexsort((order[1], order[0], hashes))
    h = hashes[rank]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    begin = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    size = np.diff(np.append(begin, len(h)))
    lead = rank[begin][group]
    tied = (order[0][rank] == order[0][lead]) & (order[1][rank] == order[1][lead])
    own = rank[(size[group] > 1) if mark_all else ~tied]
    send = rank[new] if mark_all else rank[tied]
    part = ((hashes[send] >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    for chosen, number, flag in ((send, part, False), (own, doc[own] % parts, True)):
        by = np.argsort(number, kind="stable")
        cut = np.flatnonzero(np.r_[True, number[by][1:] != number[by][:-1], True]) if len(by) else []
        for lo, hi in zip(cut, cut[1:]):
            x = chosen[by[lo:hi]]
            docs, inner = np.unique(doc[x], return_inverse=True)
            yield (int(number[by[lo]]), flag, hashes[x].tobytes(), pos[x].astype(np.uint32).tobytes(),
                   inner.astype(np.uint32).tobytes(), b"".join(nodes[d] for d in docs), ords[docs].tobytes())


def _batch(rows, schema: str):
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), types)], names)


class _Buffer:
    """Entries of a task's documents, settled and sent when many have gathered."""

    def __init__(self, parts: int, mark_all: bool):
        self.parts, self.mark_all = parts, mark_all
        self.clear()

    def clear(self) -> None:
        self.hashes, self.pos, self.doc, self.nodes, self.ords, self.size = [], [], [], [], [], 0

    def add(self, hashes, pos, doc, nodes, ords):
        self.hashes.append(hashes)
        self.pos.append(pos)
        self.doc.append(doc + len(self.nodes))
        self.nodes += nodes
        self.ords.append(ords)
        self.size += len(hashes)
        if self.size > _GATHER:
            yield from self.send()

    def send(self):
        if self.size:
            h, pos, doc, ords = map(np.concatenate, (self.hashes, self.pos, self.doc, self.ords))
            order = (doc if self.mark_all else ords[doc], pos)
            yield _batch(list(_entries(h, pos, doc, order, self.nodes, ords, self.parts, self.mark_all)), _ENTRY)
        self.clear()


def _settle(mark_all: bool, parts: int):
    """Reduce side: which entries of different batches share a hash. Marks leave packed by document part."""
    def run(batches):
        h, p, n, o, own_n, own_p = [], [], [], [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                doc = np.frombuffer(row["doc"], np.uint32)
                node = np.frombuffer(row["node"], "V16")[doc]
                pos = np.frombuffer(row["pos"], np.uint32)
                if row["own"]:
                    own_n.append(node)
                    own_p.append(pos)
                else:
                    h.append(np.frombuffer(row["hash"], np.uint64))
                    p.append(pos)
                    n.append(node)
                    o.append(np.frombuffer(row["ord"], np.int64)[doc])
        if h:
            h, p, n, o = map(np.concatenate, (h, p, n, o))
            if mark_all:
                low, high = n.view(np.uint64).reshape(-1, 2).T
                by = np.lexsort((low, high, h))
                first_of_node = np.ones(len(by), dtype=bool)
                same = h[by][1:] == h[by][:-1]
                first_of_node[1:] = ~(same & (low[by][1:] == low[by][:-1]) & (high[by][1:] == high[by][:-1]))
                by = by[first_of_node]         # a text that several batches hold counts once
            else:
                by = np.lexsort((p, o, h))
            s = h[by]
            new = np.ones(len(s), dtype=bool)
            new[1:] = s[1:] != s[:-1]
            begin = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            if mark_all:
                hit = by[np.diff(np.append(begin, len(s)))[group] > 1]
            else:
                lead = by[begin][group]
                hit = by[(o[by] != o[lead]) | (p[by] != p[lead])]
            own_n.append(n[hit])
            own_p.append(p[hit])
        node = np.concatenate(own_n) if own_n else np.zeros(0, "V16")
        if not len(node):
            return
        pos = np.concatenate(own_p)
        part = (node.view(np.uint64)[::2] % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.r_[True, part[by][1:] != part[by][:-1], True])
        yield _batch([(int(part[by[lo]]), node[by[lo:hi]].tobytes(), pos[by[lo:hi]].tobytes())
                      for lo, hi in zip(cut, cut[1:])], _MARK)
    return run


def _gather(batches):
    """All marks of each document as one row (node, positions)."""
    n, p = [], []
    for batch in batches:
        n += [np.frombuffer(x, "V16") for x in batch.column("node").to_pylist()]
        p += [np.frombuffer(x, np.uint32) for x in batch.column("pos").to_pylist()]
    if not n:
        return
    node, pos = np.concatenate(n), np.concatenate(p)
    low, high = node.view(np.uint64).reshape(-1, 2).T
    by = np.lexsort((pos, high, low))
    low, high = low[by], high[by]
    cut = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]), True])
    for at in range(0, len(cut) - 1, 4096):
        yield _batch([(node[by[lo]].tobytes().ljust(16, b"\0"), pos[by[lo:hi]].tobytes())
                      for lo, hi in zip(cut[at:at + 4096], cut[at + 1:at + 4097])], _DOC)


def _marked(entries: DataFrame, tasks: int, mark_all: bool) -> DataFrame:
    """(node, marks) of the documents whose entries are repeated."""
    return (entries.repartition(tasks, "part").mapInArrow(_settle(mark_all, tasks * _SPREAD), _MARK)
            .repartition(tasks, "part").mapInArrow(_gather, _DOC))


def _positions(marks: bytes | None) -> np.ndarray:
    return np.frombuffer(marks or b"", np.uint32).astype(np.int64)


def remove_repeated_windows(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text_col: str = "text",
                            carry: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the remaining words joined by one space.

    carry: a column of docs to return beside them (a row key, say).

    Words are runs without ASCII white space. "Earlier" is a smaller id, or an
    earlier start in the same document. Defined cases: null texts have no
    words; a null id is later than every other id; rows of one id are one
    document, so equal starts do not remove each other; repeated rows are
    repeated in the result; an empty table gives an empty result; other
    columns are ignored.
    """
    bound_batches(docs.sparkSession)
    if carry in ("doc_id", "n_words", "n_removed", "kept", "ord", "node", "text", "first_ord", "marks", "copy"):
        raise ValueError(f"carry under another name than {carry}")
    more = [carry] if carry else []
    source = docs.select(*more, F.col(id_col).cast("long").alias("doc_id"),
                         F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("ord"),
                         text_node(F.col(text_col)).alias("node"),
                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    leaders = store(source.groupBy("node").agg(F.min("ord").alias("ord"),
                                               F.max(F.octet_length("text")).alias("bytes")))
    total = leaders.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(1, -(-int(total) // PART_BYTES))
    parts = tasks * _SPREAD

    def level_one(batches):
        buffer = _Buffer(parts, True)
        seen: set[bytes] = set()
        for batch in batches:
            texts, nodes = batch.column("text"), batch.column("node")
            for lo, hi in W.slices(texts, SLICE):
                keep, node = [], []
                for i, x in enumerate(nodes.slice(lo, hi - lo).to_pylist()):
                    if x not in seen:
                        seen.add(x)
                        keep.append(i)
                        node.append(x)
                words = W.split(texts.slice(lo, hi - lo).take(pa.array(keep, pa.int64())))
                _, anchor, _ = _anchors(words, size)
                anchor = np.unique(anchor)
                doc = words.doc_of_word()[anchor]
                h, at = W.window_hashes(words, size // 2)
                yield from buffer.add(h[np.searchsorted(at, anchor)], anchor - words.first[doc], doc, node,
                                      np.zeros(len(node), np.int64))
                if not buffer.size:
                    seen.clear()
        yield from buffer.send()

    anchors = _marked(source.select("node", "text").mapInArrow(level_one, _ENTRY), tasks, True)
    survivors = store(anchors.join(leaders.select("node", "ord"), "node"))

    def level_two(batches):
        buffer = _Buffer(parts, False)
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in W.slices(texts, SLICE):
                words = W.split(texts.slice(lo, hi - lo))
                alive = np.zeros(len(words.hash), dtype=bool)
                for i, marks in enumerate(batch.column("marks").slice(lo, hi - lo).to_pylist()):
                    alive[words.first[i] + _positions(marks)] = True
                start, anchor, _ = _anchors(words, size)
                h, _ = W.window_hashes(words, size)
                wanted = alive[anchor]
                start, h = start[wanted], h[wanted]
                doc = words.doc_of_word()[start]
                yield from buffer.add(h, start - words.first[doc], doc,
                                      batch.column("node").slice(lo, hi - lo).to_pylist(),
                                      batch.column("ord").slice(lo, hi - lo).to_numpy())
        yield from buffer.send()

    lead = source.join(survivors, ["node", "ord"]).dropDuplicates(["node", "ord"])
    repeated = _marked(lead.select("node", "ord", "text", "marks").mapInArrow(level_two, _ENTRY), tasks, False)
    marked = store(leaders.select("node", F.col("ord").alias("first_ord")).join(repeated, "node", "left"))

    def cut(batches):
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in W.slices(texts, SLICE):
                words = W.split(texts.slice(lo, hi - lo))
                n = np.diff(words.first)
                gone = np.zeros(len(words.hash) + 1, dtype=np.int64)
                copies = batch.column("copy").slice(lo, hi - lo).to_pylist()
                marks = batch.column("marks").slice(lo, hi - lo).to_pylist()
                for i in range(hi - lo):
                    if copies[i] and n[i] >= size:
                        gone[words.first[i]] += 1
                        gone[words.first[i + 1]] -= 1
                    elif marks[i] and not copies[i]:
                        at = words.first[i] + _positions(marks[i])
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + size, -1)
                stays = np.cumsum(gone[:-1]) == 0
                kept, removed = [], []
                buf = words.buf.tobytes()
                for i in range(hi - lo):
                    a, b = words.first[i], words.first[i + 1]
                    s = stays[a:b]
                    removed.append(int((~s).sum()))
                    kept.append(b" ".join(buf[x:y] for x, y in zip(words.start[a:b][s].tolist(),
                                                                   words.end[a:b][s].tolist())).decode())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in [*more, "doc_id"]), pa.array(n, pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    [*more, "doc_id", "n_words", "n_removed", "kept"])

    return (source.join(marked, "node")
            .select(*more, "doc_id", "text", "marks", (F.col("ord") > F.col("first_ord")).alias("copy"))
            .mapInArrow(cut, T.StructType([*(source.schema[c] for c in more),
                T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
                T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])))
