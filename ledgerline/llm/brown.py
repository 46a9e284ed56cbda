"""Brown class-based bigram scoring.

The text's log10 probability is the sum over tokens of log10 P(class | previous
class) + log10 P(word | class). Every training word gets its class from its own
contexts. The driver's exchange makes the start: it assigns ``UNITS`` frequent
words and ``FORMS`` word forms (a hash of the last two bytes) to ``CLASSES``
classes, each unit in turn moving to the class that raises the likelihood of
the class bigrams most. Then Spark does ``ROUNDS`` rounds over all other words:
the classes before and after a word are counted over the whole training text,
and each word moves to its best class, all others held (as all move at once,
further rounds swing: README). At the end the class bigrams are counted again. A word without training occurrence takes the class
of most once-seen words of its form. The text's end has a unit and a class of
its own and also stands before the first word.

P(word | class) = (n + a) / (N_class + a (V_class + 1)) with a = 0.1, so a
class keeps mass for one unseen word; P(class | previous) is interpolated with
P(class). Counts and classes of the ``HEAD`` most frequent words go to every
task; a document's other words are joined with the full table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import words as W
from ledgerline.llm.common import bound_batches, fold, store

UNITS, FORMS, CLASSES, HEAD = 500, 128, 64, 1 << 18
ADD = 0.1
SWEEPS = 20
ROUNDS = 1
PRIOR = 4.0            # weight of P(class) against the counts after a class
_FLUSH = 2_000_000
_CELLS = 1 << 15       # context cells whose gains are taken at once
_PIECE = 1 << 18       # tokens whose context cells are counted at once, but for a single word's
END = UNITS + FORMS


def _split(texts: pa.Array) -> W.Words:
    return W.split(texts, W.SPACE, W.ASCII_LOWER)


def _form(words: W.Words) -> np.ndarray:
    last = words.buf[words.end - 1].astype(np.uint64)
    before = np.where(words.end - words.start > 1, words.buf[np.maximum(words.end - 2, 0)], 0).astype(np.uint64)
    return (W.mix(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(FORMS)).astype(np.int64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    h, form, n = (np.concatenate(x) for x in zip(*parts))
    by = np.argsort(h, kind="stable")
    new = np.flatnonzero(np.r_[True, h[by][1:] != h[by][:-1]]) if len(by) else np.zeros(0, int)
    return h[by][new], form[by][new], np.add.reduceat(n[by], new) if len(new) else n


def word_counts(docs: DataFrame) -> DataFrame:
    """(hash, form, n) of every distinct word of the texts."""
    def count(batches):
        parts, size = [], 0
        for batch in batches:
            text = batch.column("text")
            for lo, hi in W.slices(text):
                words = _split(text.slice(lo, hi - lo))
                parts.append(_summed([(words.hash, _form(words), np.ones(len(words.hash), np.int64))]))
                size += len(parts[-1][0])
                if size > _FLUSH:
                    parts = [_summed(parts)]
                    size = len(parts[0][0])
                    if size > _FLUSH // 2:
                        yield _rows(parts.pop())
                        size = 0
        if parts:
            yield _rows(_summed(parts))

    def _rows(x):
        return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)),
                                           pa.array(x[2])], ["hash", "form", "n"])

    return (docs.select("text").mapInArrow(count, "hash long, form int, n long")
            .groupBy("hash").agg(F.first("form").alias("form"), F.sum("n").alias("n")))


class Head:
    """The most frequent words: sorted hashes, counts, and the unit of the UNITS first."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        unit = np.where(np.arange(len(hashes)) < UNITS, np.arange(len(hashes)), -1)
        by = np.argsort(hashes)
        self.hash, self.n, self.unit = hashes[by], counts[by], unit[by]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash, -1 where it is not a head word."""
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, at, -1)

    def units(self, words: W.Words, at: np.ndarray) -> np.ndarray:
        own = np.where(at >= 0, self.unit[at] if len(self.unit) else -1, -1)
        return np.where(own >= 0, own, UNITS + _form(words))


def _sequences(words: W.Words, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of all documents in a row, each document followed by END, and each position's document."""
    n = words.n_docs
    seq = np.full(len(unit) + n, END, dtype=np.int64)
    seq[np.arange(len(unit)) + words.doc_of_word()] = unit
    return seq, np.repeat(np.arange(n), np.diff(words.first) + 1)


def unit_bigrams(docs: DataFrame, head) -> DataFrame:
    """(u, v, n): how often unit v follows unit u."""
    size = END + 1

    def count(batches):
        total = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            text = batch.column("text")
            for lo, hi in W.slices(text):
                words = _split(text.slice(lo, hi - lo))
                seq, _ = _sequences(words, head.value.units(words, head.value.find(words.hash)))
                before = np.concatenate([[END], seq[:-1]])     # END stands before a first word too
                total += np.bincount(before * size + seq, minlength=size * size)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((cell // size).astype(np.int32)),
                                          pa.array((cell % size).astype(np.int32)), pa.array(total[cell])],
                                         ["u", "v", "n"])

    return docs.select("text").mapInArrow(count, "u int, v int, n long").groupBy("u", "v").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(matrix: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit from the unit bigram counts; the last unit keeps a class of its own."""
    m = matrix.astype(np.float64)
    size = len(m)
    mass = m.sum(axis=0)
    of = np.zeros(size, dtype=np.int64)
    by = np.argsort(-mass[:-1], kind="stable")
    of[by] = np.arange(size - 1) % (classes - 1)
    of[-1] = classes - 1
    member = np.zeros((size, classes))
    member[np.arange(size), of] = 1
    pairs = member.T @ m @ member
    total = member.T @ mass
    for _ in range(sweeps):
        moved = 0
        for u in by:
            if mass[u] == 0:
                continue
            old, self_n = of[u], m[u, u]
            member[u, old] = 0
            after, before = m[u] @ member, m[:, u] @ member
            pairs[old] -= after
            pairs[:, old] -= before
            pairs[old, old] -= self_n
            total[old] -= mass[u]
            here = np.diag(pairs)
            rows = _xlogx(pairs + after[None, :]) - _xlogx(pairs)
            cols = _xlogx(pairs + before[:, None]) - _xlogx(pairs)
            gain = (rows.sum(axis=1) - np.diag(rows) + cols.sum(axis=0) - np.diag(cols)
                    + _xlogx(here + after + before + self_n) - _xlogx(here)
                    - 2 * (_xlogx(total + mass[u]) - _xlogx(total)))
            new = int(np.argmax(gain[:-1]))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            member[u, new] = 1
            of[u] = new
            pairs[new] += after
            pairs[:, new] += before
            pairs[new, new] += self_n
            total[new] += mass[u]
            moved += new != old
        if not moved:
            break
    return of


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets (n + 1) of a list column; a null list is empty."""
    n = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    return column.flatten(), n.astype(np.int64)


def _classes(batch, head: Head, of: np.ndarray, back: np.ndarray):
    """Class and hash of every token of the rows, the rows' places (n + 1), and the rare words found (row, entry)."""
    seq, first = _flat(batch.column("seq"))
    rare, at = _flat(batch.column("rare"))
    form, _ = _flat(batch.column("form"))
    seq, rare = seq.to_numpy(), rare.to_numpy().view(np.uint64)
    rare_class = back[form.to_numpy()]
    found = None
    if "got" in batch.schema.names:
        got, ends = _flat(batch.column("got"))
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        spot = at[row] + got.field("k").to_numpy()
        rare_class[spot] = got.field("cls").to_numpy()
        found = (row, got)
    c, h = np.zeros(len(seq), np.uint8), np.zeros(len(seq), np.uint64)
    known, other = np.flatnonzero(seq >= 0), np.flatnonzero(seq < 0)
    c[known], h[known] = of[seq[known]], head.hash[seq[known]]
    spot = at[np.searchsorted(first, other, side="right") - 1] - seq[other] - 1
    c[other], h[other] = rare_class[spot], rare[spot]
    return c, h, first, found


def _around(c: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class before and after each token, and the counts of class bigrams, text ends included."""
    end = CLASSES - 1
    before, after = np.full(len(c), end, np.uint8), np.full(len(c), end, np.uint8)
    before[1:], after[:-1] = c[:-1], c[1:]
    some = np.diff(first) > 0
    before[first[:-1][some]] = end
    after[first[1:][some] - 1] = end
    pairs = np.bincount(before.astype(np.int32) * CLASSES + c, minlength=CLASSES * CLASSES)
    pairs += np.bincount(c[first[1:][some] - 1].astype(np.int32) * CLASSES + end, minlength=CLASSES * CLASSES)
    pairs[-1] += int((~some).sum())
    return before, after, pairs


def context_cells(parts: list[tuple[np.ndarray, ...]]):
    """(word, its class, place of its cells (n + 1), cells, n) of tokens (hash, class, before, after), which are taken out of
    ``parts``. Few arrays are held at once: a worker's memory is that of a token's 11 bytes and two sorts."""
    h, c, before, after = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    by = np.argsort(h, kind="stable")
    h = h[by]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    begin = np.flatnonzero(new)
    words, old = h[begin], c[by[begin]]
    del h, c, new
    before, after = before[by], after[by]
    del by
    width = 2 * CLASSES
    cells, n, at = [], [], np.zeros(len(words) + 1, np.int64)
    ends = np.append(begin[1:], len(before))
    lo = 0
    while lo < len(words):             # the tokens of some words at a time
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + _PIECE)))
        a, b = begin[lo], ends[hi - 1]
        word = np.repeat(np.arange(hi - lo) * width, ends[lo:hi] - begin[lo:hi])
        cell, times = np.unique(np.concatenate([word + before[a:b], word + CLASSES + after[a:b]]), return_counts=True)
        at[lo + 1:hi + 1] = at[lo] + np.searchsorted(cell, np.arange(1, hi - lo + 1) * width)
        cells.append((cell % width).astype(np.int32))
        n.append(times.astype(np.int32))
        lo = hi
    return words, old, at, np.concatenate([*cells, np.zeros(0, np.int32)]), np.concatenate([*n, np.zeros(0, np.int32)])


CONTEXTS = "hash long, old int, cells array<int>, n array<int>"


def contexts(rows: DataFrame, head, of: np.ndarray, back: np.ndarray) -> DataFrame:
    """(hash, old, cells, n): how often each class is before (cell = class) and after (CLASSES + class) a word.

    A row with a null hash has the counts of class bigrams instead (cell = before * CLASSES + class).
    """
    def count(batches):
        parts, size, total = [], 0, np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            c, h, first, _ = _classes(batch, head.value, of, back)
            before, after, pairs = _around(c, first)
            total += pairs
            parts.append((h, c, before, after))
            size += len(h)
            if size > _FLUSH:
                yield from summed(parts)
                parts, size = [], 0
        if parts:
            yield from summed(parts)
        cell = np.flatnonzero(total)
        for lo in range(0, len(cell), 1024):
            some = cell[lo:lo + 1024]
            yield out(np.zeros(len(some), np.uint64), np.zeros(len(some), int), np.arange(len(some) + 1), some,
                      total[some], null=True)

    def summed(parts):
        words, old, at, cells, n = context_cells(parts)
        for lo in range(0, len(words), 20_000):
            hi = min(lo + 20_000, len(words))
            a, b = at[lo], at[hi]
            yield out(words[lo:hi], old[lo:hi], at[lo:hi + 1] - a, cells[a:b], n[a:b])

    def out(h, old, at, cells, n, null=False):
        at = pa.array(at, pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.nulls(len(h), pa.int64()) if null else pa.array(h.view(np.int64)), pa.array(old, pa.int32()),
             pa.ListArray.from_arrays(at, pa.array(cells, pa.int32())),
             pa.ListArray.from_arrays(at, pa.array(n, pa.int32()))], ["hash", "old", "cells", "n"])

    return rows.mapInArrow(count, CONTEXTS)


def best_classes(word: np.ndarray, cell: np.ndarray, n: np.ndarray, old: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """New class of each word from its context cells, sorted by word (every word has some); the last class is no word's.

    The gain is the exchange's, up to the bigrams of a word and its own class, which count as two.
    """
    table = np.concatenate([pairs, pairs.T])
    logs, total = _xlogx(table), pairs.sum(axis=0)
    mass = np.bincount(word, weights=n * (cell < CLASSES), minlength=len(old))
    gain = np.zeros((len(old), CLASSES))
    starts = np.searchsorted(word, np.arange(len(old)))
    lo = 0
    while lo < len(old):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + _CELLS)) - 1)
        hi = min(hi, len(old)) if hi < len(old) - 1 else len(old)
        a, b = starts[lo], starts[hi] if hi < len(old) else len(word)
        e, x, mine = cell[a:b], n[a:b].astype(np.float64), old[word[a:b]]
        value = _xlogx(table[e] + x[:, None]) - logs[e]
        value[np.arange(b - a), mine] = logs[e, mine] - _xlogx(np.maximum(table[e, mine] - x, 0))
        gain[lo:hi] = np.add.reduceat(value, starts[lo:hi] - a)
        lo = hi
    cost = _xlogx(total + mass[:, None]) - _xlogx(total)
    each = np.arange(len(old))
    cost[each, old] = _xlogx(total[old]) - _xlogx(np.maximum(total[old] - mass, 0))
    gain -= 2 * cost
    new = np.argmax(gain[:, :-1], axis=1)
    return np.where(gain[each, new] > gain[each, old] + 1e-9, new, old)


def _pairs(counted: DataFrame) -> np.ndarray:
    table = (counted.where("hash is null").select(F.explode(F.arrays_zip("cells", "n")).alias("x"))
             .groupBy("x.cells").agg(F.sum("x.n").alias("n")).toArrow())
    pairs = np.zeros(CLASSES * CLASSES)
    pairs[table["cells"].to_numpy()] = table["n"].to_numpy()
    return pairs.reshape(CLASSES, CLASSES)


def reassign(counted: DataFrame, head, pairs: np.ndarray) -> DataFrame:
    """(hash, cls, at): each word's best class (a unit's stays) and its place in the head (-1: none)."""
    def assign(batches):
        kept = None
        for batch in batches:
            batch = pa.Table.from_batches([batch])
            kept = pa.concat_tables([kept, batch]) if kept is not None else batch
            h = kept["hash"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))             # the last word may go on in the next batch
            if cut:
                yield moved(kept.slice(0, cut))
                kept = kept.slice(cut)
        if kept is not None and len(kept):
            yield moved(kept)

    def moved(rows):
        h = rows["hash"].to_numpy()
        words, one, word = np.unique(h, return_index=True, return_inverse=True)
        cells, at = _flat(rows["cells"].combine_chunks())
        n, _ = _flat(rows["n"].combine_chunks())
        width = 2 * CLASSES
        key, where = np.unique(np.repeat(word, np.diff(at)) * width + cells.to_numpy(), return_inverse=True)
        n = np.bincount(where, weights=n.to_numpy())
        old, at = rows["old"].to_numpy()[one].astype(np.int64), head.value.find(words.view(np.uint64))
        new = best_classes(key // width, key % width, n, old, pairs)
        stays = (at >= 0) & (head.value.unit[at] >= 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(words), pa.array(np.where(stays, old, new), pa.int32()), pa.array(at, pa.int32())],
            ["hash", "cls", "at"])

    return (counted.where("hash is not null").repartition("hash").sortWithinPartitions("hash")
            .mapInArrow(assign, "hash long, cls int, at int"))


class Model:
    """Log10 tables: after[c, d] = P(class d | class c), norm[c] = N_c + a (V_c + 1)."""

    def __init__(self, pairs: np.ndarray, words: np.ndarray):
        tokens = pairs.sum(axis=0)
        prior = (tokens + ADD) / (tokens.sum() + ADD * CLASSES)
        self.after = np.log10((pairs + PRIOR * prior[None, :]) / (pairs.sum(axis=1, keepdims=True) + PRIOR))
        self.norm = np.log10(tokens + ADD * (words + 1))


def score(docs: DataFrame, folds: int = 10, held: int = 0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of (doc_id, text).

    base_score is the add-0.1 unigram log10 probability, score the class
    model's. Words are lower-cased (A-Z) runs without ASCII white space, and
    each text has one end token. Defined cases: a null or empty text is its end
    alone; a null id is in no fold (held_out false, not learned from); repeated
    rows are learned from and answered one by one; with nothing to learn from,
    all words are unseen; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    train = docs.where(fold(F.col("doc_id"), folds) != held)
    counts = store(word_counts(train))
    top = counts.orderBy(F.desc("n"), "hash").limit(HEAD).toArrow()
    head = Head(top["hash"].to_numpy().view(np.uint64), top["n"].to_numpy())
    sent_head = spark.sparkContext.broadcast(head)
    size = END + 1
    table = unit_bigrams(train, sent_head).toArrow()
    matrix = np.zeros((size, size))
    matrix[table["u"].to_numpy(), table["v"].to_numpy()] = table["n"].to_numpy()
    ends = int(matrix[:, END].sum())
    seed = exchange(matrix, CLASSES)
    n_all, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    n_all = (n_all or 0) + ends
    distinct += ends > 0
    base_norm = math.log10(n_all + ADD * (distinct + 1))
    end_mass = math.log10(ends + ADD)
    id_field = T.StructField("doc_id", docs.schema["doc_id"].dataType)

    def sequences(batches):
        h = sent_head.value
        count = np.log10(h.n + ADD)
        for batch in batches:
            text, ids = batch.column("text"), batch.column("doc_id")
            for lo, hi in W.slices(text):
                words = _split(text.slice(lo, hi - lo))
                at, own = h.find(words.hash), words.doc_of_word()
                known = at >= 0
                mass = np.where(known, count[at] if len(count) else 0.0, math.log10(ADD))
                rare, rare_doc, form = words.hash[~known], own[~known], _form(words)[~known]
                by = np.lexsort((rare, rare_doc))
                new = np.ones(len(by), dtype=bool)
                new[1:] = (rare[by][1:] != rare[by][:-1]) | (rare_doc[by][1:] != rare_doc[by][:-1])
                begin = np.flatnonzero(new)
                times = np.diff(np.append(begin, len(by)))
                starts = np.searchsorted(rare_doc[by][begin], np.arange(hi - lo + 1))
                place = np.zeros(len(by), np.int64)
                place[by] = np.cumsum(new) - 1 - starts[rare_doc[by]]
                seq = at.copy()
                seq[~known] = -1 - place               # -1 - k: the document's k-th rare word
                offsets = pa.array(starts, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo),
                     pa.array(np.bincount(own, weights=known, minlength=hi - lo).astype(np.int64)),
                     pa.array(np.bincount(own, weights=mass, minlength=hi - lo), pa.float64()),
                     pa.ListArray.from_arrays(pa.array(words.first, pa.int32()), pa.array(seq.astype(np.int32))),
                     pa.ListArray.from_arrays(offsets, pa.array(rare[by][begin].view(np.int64))),
                     pa.ListArray.from_arrays(offsets, pa.array(form[by][begin].astype(np.int32))),
                     pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))],
                    ["doc_id", "known", "mass", "seq", "rare", "form", "times"])

    rows = store(docs.mapInArrow(sequences, T.StructType([
        id_field, T.StructField("known", T.LongType()), T.StructField("mass", T.DoubleType()),
        *[T.StructField(c, T.ArrayType(T.LongType() if c == "rare" else T.IntegerType()))
          for c in ("seq", "rare", "form", "times")]]))
        .withColumns({"row": F.monotonically_increasing_id(), "learn": F.coalesce(
            fold(F.col("doc_id"), folds) != held, F.lit(False))}))

    def joined(rows: DataFrame, classes: DataFrame) -> DataFrame:
        """The rows with (place, class, count, times) of each of their rare words that is a training word."""
        asked = rows.select("row", F.posexplode(F.arrays_zip("rare", "times")).alias("k", "x")).select(
            "row", "k", F.col("x.rare").alias("hash"), F.col("x.times").alias("times"))
        found = asked.join(classes.where("at < 0").select("hash", "cls", "n"), "hash").groupBy("row").agg(
            F.collect_list(F.struct("k", "cls", "n", "times")).alias("got"))
        return rows.join(found, "row", "left")

    back, learn = seed[UNITS:UNITS + FORMS], rows.where("learn")
    of = np.where(head.unit >= 0, seed[head.unit], 0)
    classes = None
    # The start's classes: a head word that is no unit has that of its form.
    form_of = dict(zip(top["hash"].to_numpy().view(np.uint64).tolist(), top["form"].to_numpy().tolist()))
    if len(head.hash):
        of = np.where(head.unit >= 0, of, back[np.array([form_of[x] for x in head.hash.tolist()])])
    for _ in range(ROUNDS):
        counted = store(contexts(learn if classes is None else joined(learn, classes), sent_head, of, back))
        pairs = _pairs(counted)
        classes = store(reassign(counted, sent_head, pairs).join(counts, "hash"))
        mine = classes.where("at >= 0").select("at", "cls").toArrow()
        of = of.copy()
        of[mine["at"].to_numpy()] = mine["cls"].to_numpy()
        once = classes.where("n = 1").groupBy("form", "cls").count().toArrow()
        seen = np.zeros((FORMS, CLASSES))
        seen[once["form"].to_numpy(), once["cls"].to_numpy()] = once["count"].to_numpy()
        back = np.argmax(seen + 1e-9 * seen.sum(axis=0), axis=1)

    def classed(batches):
        for batch in batches:
            c, _, first, (row, got) = _classes(batch, sent_head.value, of, back)
            n, times = got.field("n").to_numpy(), got.field("times").to_numpy()
            size = len(first) - 1
            known = batch.column("known").to_numpy() + np.bincount(row, weights=times, minlength=size).astype(np.int64)
            mass = batch.column("mass").to_numpy() + np.bincount(
                row, weights=times * (np.log10(n + ADD) - math.log10(ADD)), minlength=size)
            data = c.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("learn"), pa.array(known), pa.array(mass),
                 pa.array([data[a:b] for a, b in zip(first, first[1:])], pa.binary())],
                ["doc_id", "learn", "known", "mass", "classes"])

    last = store(joined(rows, classes).mapInArrow(classed, T.StructType([
        id_field, T.StructField("learn", T.BooleanType()), T.StructField("known", T.LongType()),
        T.StructField("mass", T.DoubleType()), T.StructField("classes", T.BinaryType())])))

    def read(batch):
        texts = batch.column("classes").to_pylist()
        first = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        return np.frombuffer(b"".join(texts), np.uint8), first

    def bigrams(batches):
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            total += _around(*read(batch))[2]
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    table = (last.where("learn").select("classes").mapInArrow(bigrams, "cell long, n long")
             .groupBy("cell").agg(F.sum("n").alias("n")).toArrow())
    pairs = np.zeros(CLASSES * CLASSES)
    pairs[table["cell"].to_numpy()] = table["n"].to_numpy()
    sizes = classes.groupBy("cls").count().toArrow()
    words_of = np.zeros(CLASSES)
    words_of[sizes["cls"].to_numpy()] = sizes["count"].to_numpy()
    model = spark.sparkContext.broadcast(Model(pairs.reshape(CLASSES, CLASSES), words_of))

    def answer(batches):
        m = model.value
        for batch in batches:
            c, first = read(batch)
            before, _, _ = _around(c, first)
            size = len(first) - 1
            own = np.repeat(np.arange(size), np.diff(first))
            path = np.bincount(own, weights=m.after[before, c] - m.norm[c], minlength=size)
            final = np.full(size, CLASSES - 1)
            some = np.diff(first) > 0
            final[some] = c[first[1:][some] - 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first) + 1), batch.column("known"), batch.column("mass"),
                 pa.array(path + m.after[final, CLASSES - 1])], ["doc_id", "n_tokens", "known", "mass", "model"])

    end_known = 1 if ends else 0
    return last.mapInArrow(answer, T.StructType([
        id_field, T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()),
        T.StructField("mass", T.DoubleType()), T.StructField("model", T.DoubleType())])).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("known") + end_known).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("mass") + end_mass - F.col("n_tokens") * base_norm).alias("base_score"),
        (F.col("mass") + F.col("model")).alias("score"))
