"""Phrase mining: collocations of 2 to 4 words per language, by sorted count streams.

Only the longest runs are counted. Every word starts one window of four words,
filled up with empty words where its piece ends; a window is written as its
words, each followed by a blank, so that byte order is the order of its words
and the windows that begin with the same words are neighbours. One range
partition and sort by (language, window) gives the count stream: a task
compares each window with the one before it, and the runs of equal first
words, first two, three and four are the counts of all phrases. Runs at the edge
of a range are emitted as parts and added up, so a frequent first word, or a
window that is in every slice, may span many ranges.

The phrases that are frequent enough are then kept as two streams, sorted by
their words and by their words from the end. In each, a phrase follows the
phrases that it extends, so one pass carries the counts of its first (or
last) words down to it, and finds what extends it by one word nearly as often.
A merge join of both streams has all that a phrase's score needs. (A phrase
that lies in one two words longer also lies in one a word longer that is at
least as frequent, so extensions by one word decide.)
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import words as W
from ledgerline.llm.common import bound_batches, store

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
BUCKETS = 64         # first round of the top list, per language

PIECE = np.zeros(256, dtype=bool)
PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPARATOR = PIECE.copy()
SEPARATOR[[0x20, 0x09]] = True


def _parts(texts: pa.Array):
    """The texts, a long single one cut behind piece ends into parts of about SLICE_BYTES."""
    buf, _ = W.string_bytes(texts)
    if len(texts) != 1 or len(buf) <= 2 * W.SLICE_BYTES:
        yield texts
        return
    ends = np.flatnonzero(PIECE[buf]) + 1
    at = 0
    while at < len(buf):
        k = int(np.searchsorted(ends, at + W.SLICE_BYTES))
        to = int(ends[k]) if k < len(ends) else len(buf)
        offsets = np.array([0, to - at], dtype=np.int64)
        yield pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(offsets), pa.py_buffer(buf[at:to].copy())])
        at = to


def _gather(buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The joined byte ranges and their offsets."""
    off = np.concatenate([[0], np.cumsum(size)])
    return buf[np.arange(off[-1]) - np.repeat(off[:-1] - begin, size)], off


def windows(texts: pa.Array, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(group, count, window) of the distinct windows of a run of texts, sorted; group: a number per text."""
    w = W.split(texts, SEPARATOR, W.ASCII_LOWER)
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_binary())
    doc = w.doc_of_word()
    piece = np.cumsum(PIECE[w.buf])[w.start]
    follows = np.zeros(n + LONGEST, dtype=bool)      # the next word is in the same piece
    follows[:n - 1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
    # Every word with a blank after it, one behind the other.
    flat, off = _gather(np.append(w.buf, np.uint8(0x20)), w.start, w.end - w.start + 1)
    flat[off[1:] - 1] = 0x20
    word = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(off), pa.py_buffer(flat)]).dictionary_encode()
    order = pc.array_sort_indices(word.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(1, len(order) + 1)
    code = np.zeros(n + LONGEST, dtype=np.int64)
    code[:n] = place[word.indices.to_numpy(zero_copy_only=False)]
    # Two words make a pair, two pairs a window: numbers that sort as the words do. 0 is the empty word.
    base = len(order) + 1
    pair = (group[doc] * base + code[:n]) * base + np.where(follows[:n], code[1:n + 1], 0)
    _, number = np.unique(pair, return_inverse=True)
    second = np.zeros(n, dtype=np.int64)
    if n > 2:
        second[:-2] = np.where(follows[:n - 2] & follows[1:n - 1], number[2:] + 1, 0)
    _, at, count = np.unique(number * (n + 1) + second, return_index=True, return_counts=True)
    length = 1 + follows[at].astype(np.int64) * (1 + follows[at + 1] * (1 + follows[at + 2].astype(np.int64)))
    span = off[at + length] - off[at]
    body, _ = _gather(np.append(flat, np.full(LONGEST, 0x20, np.uint8)), off[at], span)
    size = span + LONGEST - length
    out_off = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(out_off[-1]), 0x20, dtype=np.uint8)
    out[np.arange(len(body)) + np.repeat(out_off[:-1] - (np.cumsum(span) - span), span)] = body
    return group[doc[at]], count, pa.Array.from_buffers(
        pa.large_binary(), len(at), [None, pa.py_buffer(out_off), pa.py_buffer(out)])


def shared_words(keys: pa.Array, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted windows: how many first words each shares with the one before, the bytes, offsets and word ends."""
    buf, off = W.string_bytes(keys)
    ends = np.flatnonzero(buf == 0x20).reshape(-1, LONGEST) + 1
    size = np.diff(off)
    shorter = np.minimum(size[1:], size[:-1])
    begin = np.cumsum(shorter) - shorter
    inside = np.arange(int(shorter.sum())) - np.repeat(begin, shorter)
    differ = np.flatnonzero(buf[np.repeat(off[1:-1], shorter) + inside] != buf[np.repeat(off[:-2], shorter) + inside])
    first = np.append(differ, len(inside))[np.searchsorted(differ, begin)]
    equal = np.minimum(first - begin, shorter)
    common = np.zeros(len(size), dtype=np.int64)
    common[1:] = ((ends[1:] - off[1:-1, None]) <= equal[:, None]).sum(axis=1) * same
    return common, buf, off, ends


def phrase_counts(stream, min_count: int):
    """Batches (lang, key, words, n, edge) of the runs in a sorted stream of (lang, window, n) batches.

    A run at either end of the stream has edge set and any count; others have
    min_count at least. key: the words, each followed by a blank. Rows of no
    words count all words of a language.
    """
    last, carry, edge = None, np.zeros(LONGEST, np.int64), np.ones(LONGEST, dtype=bool)

    def out(lang, buf, off, ends, rows, level, n, is_edge):
        filled = ends[rows, level] - (ends[rows, level - 1] if level else off[rows]) > 1
        keep = filled & (is_edge | (n >= min_count))
        rows, n, is_edge = rows[keep], n[keep], is_edge[keep]
        body, at = _gather(buf, off[rows], ends[rows, level] - off[rows])
        keys = pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(body)])
        return pa.RecordBatch.from_arrays(
            [lang.take(pa.array(rows)), keys.cast(pa.string()), pa.array(np.full(len(rows), level + 1, np.int32)),
             pa.array(n), pa.array(is_edge)], ["lang", "key", "words", "n", "edge"])

    for batch in stream:
        if not batch.num_rows:
            continue
        lang = batch.column("lang").cast(pa.string())
        keys = batch.column("window").cast(pa.large_string())
        n = batch.column("n").to_numpy(zero_copy_only=False)
        if last is not None:       # the former batch's last window stands for its open runs
            lang, keys, n = pa.concat_arrays([last[0], lang]), pa.concat_arrays([last[1], keys]), np.append(0, n)
        same = pc.equal(lang.slice(1), lang.slice(0, len(lang) - 1)).to_numpy(zero_copy_only=False)
        common, buf, off, ends = shared_words(keys, same)
        tongue = np.flatnonzero(np.append(True, ~same))          # all words of each language
        yield pa.RecordBatch.from_arrays(
            [lang.take(pa.array(tongue)), pa.array([""] * len(tongue)), pa.array(np.zeros(len(tongue), np.int32)),
             pa.array(np.add.reduceat(n, tongue)), pa.array(np.zeros(len(tongue), bool))],
            ["lang", "key", "words", "n", "edge"])
        for level in range(LONGEST):
            begin = np.flatnonzero(common <= level)
            mine = n if last is None else np.append(carry[level], n[1:])
            total = np.add.reduceat(mine, begin)
            is_edge = np.zeros(len(begin), dtype=bool)
            is_edge[0] = edge[level]
            yield out(lang, buf, off, ends, begin[:-1], level, total[:-1], is_edge[:-1])
            carry[level], edge[level] = total[-1], is_edge[-1]
        last = lang.slice(len(lang) - 1), keys.slice(len(keys) - 1)
    if last is not None:
        _, buf, off, ends = shared_words(last[1], np.zeros(0, dtype=bool))
        for level in range(LONGEST):
            yield out(last[0], buf, off, ends, np.zeros(1, np.int64), level, carry[level:level + 1].copy(),
                      np.ones(1, dtype=bool))


def _range_bounds(docs: DataFrame, ranges: int) -> list[tuple[str, bytes]]:
    """Windows that part the count stream into about equal ranges.

    They come from a sample of 20 documents per range, which only decides where
    the stream is cut: every window goes into some range whatever the bounds are.
    """
    n = docs.count()
    share = min(1.0, 20 * ranges / n) if n else 1.0
    picked = docs.where(F.pmod(F.xxhash64("lang", "text"), F.lit(1 << 20)) < max(1, int(share * (1 << 20))))

    def some(batches):
        for batch in batches:
            for lo in range(batch.num_rows):
                for part in _parts(batch.column("text").slice(lo, 1)):
                    _, n, keys = windows(part, np.zeros(1, np.int64))
                    if len(keys):
                        step = min(max(len(keys) // 10, 1), 30)
                        at = np.arange(step // 2, len(keys), step)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([batch.column("lang")[lo].as_py()] * len(at), pa.string()),
                             keys.take(pa.array(at)), pa.array(np.full(len(at), float(n.sum()) / len(at)))],
                            ["lang", "window", "weight"])

    rows = sorted((r.lang.encode(), bytes(r.window), r.weight) for r in
                  picked.mapInArrow(some, "lang string, window binary, weight double").collect())
    if not rows:
        return []
    upto = np.cumsum([w for _, _, w in rows])
    at = np.searchsorted(upto, np.arange(1, ranges) * upto[-1] / ranges)
    return [rows[i][:2] for i in np.minimum(at, len(rows) - 1)]


def _ranges(lang: list[bytes], own: np.ndarray, keys: pa.Array, bounds: list[tuple[bytes, bytes]], salt: int) -> np.ndarray:
    """The range of each window (sorted within its language own[i]); a window that is a bound goes to one of its ranges."""
    out = np.zeros(len(own), dtype=np.int32)
    edge = np.searchsorted(own, np.arange(len(lang) + 1))
    for k, name in enumerate(lang):
        a, b = int(edge[k]), int(edge[k + 1])
        if a == b:
            continue
        first = bisect_left(bounds, name, key=lambda x: x[0])
        mine = [w for _, w in bounds[first:bisect_right(bounds, name, key=lambda x: x[0])]]
        at_least = [bisect_left(range(a, b), w, key=lambda i: keys[i].as_py()) for w in mine]
        above = [bisect_right(range(a, b), w, key=lambda i: keys[i].as_py()) for w in mine]
        place = np.arange(b - a)
        low = first + np.searchsorted(above, place, side="right")
        high = first + np.searchsorted(at_least, place, side="right")
        out[a:b] = low + salt % (high - low + 1)
    return out


def counted(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """Phrases (lang, key, words, n) of 1 to 4 words with n >= min_count, and (lang, n) of all words."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("string").alias("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = spark.sparkContext.broadcast(_range_bounds(docs, ranges))

    def count(batches):
        for batch in batches:
            text, lang = batch.column("text"), batch.column("lang")
            for lo, hi in W.slices(text):
                codes = lang.slice(lo, hi - lo).dictionary_encode()
                group = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                names = [x.encode() for x in codes.dictionary.to_pylist()]
                for part in _parts(text.slice(lo, hi - lo)):
                    own, n, keys = windows(part, group)
                    salt = crc32(W.string_bytes(part)[0][:4096].tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [codes.dictionary.take(pa.array(own)).cast(pa.string()), keys.cast(pa.binary()).cast(pa.string()),
                         pa.array(n), pa.array(_ranges(names, own, keys, bounds.value, salt))],
                        ["lang", "window", "n", "range"])

    stream = (docs.mapInArrow(count, "lang string, window string, n long, range int")
              .repartitionById(ranges, "range").sortWithinPartitions("lang", "window").drop("range"))
    runs = store(stream.mapInArrow(lambda batches: phrase_counts(batches, min_count),
                                   "lang string, key string, words int, n long, edge boolean"))
    parts = runs.where("edge").groupBy("lang", "key", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    phrases = store(runs.where("not edge and words > 0").drop("edge").unionByName(parts))
    return phrases, runs.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))


def with_begins(phrases: DataFrame) -> DataFrame:
    """Phrases (lang, key, words, n) with begins: the counts of their first words, first two and so on (shorter ones).

    The stream is sorted by key; a phrase's beginnings stand before it. What a
    range lacks at its start comes from the last ones of the ranges before.
    """
    def carry(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        open_ = np.full(LONGEST, -1, dtype=np.int64)
        for batch in batches:
            words, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("words", "n"))
            columns = []
            for level in range(1, LONGEST):
                at = np.maximum.accumulate(np.where(words == level, np.arange(len(n)), -1)) if len(n) else words
                value = np.where(at >= 0, n[at], open_[level])
                columns.append(pa.array(value, mask=words <= level))
                if len(n):
                    open_[level] = value[-1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("lang", "key", "words", "n")),
                 *columns, pa.array(np.full(len(n), pid, np.int32))], names)
        yield pa.RecordBatch.from_arrays(      # what is open at the end of the range, as a row of no words
            [pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([0], pa.int32()), pa.array([0]),
             *(pa.array([x]) for x in open_[1:]), pa.array([pid], pa.int32())], names)

    levels = [f"b{k}" for k in range(1, LONGEST)]
    names = ["lang", "key", "words", "n", *levels, "pid"]
    passed = store(phrases.select("lang", "key", "words", "n").repartitionByRange("lang", "key")
                   .sortWithinPartitions("lang", "key").mapInArrow(
        carry, "lang string, key string, words int, n long, " + "".join(f"{x} long, " for x in levels) + "pid int"))
    earlier = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)      # one row per range
    before = passed.where("words = 0").select("pid", *(
        F.last(F.when(F.col(x) >= 0, F.col(x)), ignorenulls=True).over(earlier).alias(f"{x}_before") for x in levels))
    filled = [F.when(F.col(x) >= 0, F.col(x)).when(F.col(x) < 0, F.col(f"{x}_before")) for x in levels]
    return (passed.where("words > 0").join(F.broadcast(before), "pid")
            .select("lang", "key", "words", "n", F.array(*filled).alias("begins")))


def _turned(key: Column) -> Column:
    """A key with its words from the end."""
    words = F.split(F.substring(key, F.lit(1), F.length(key) - 1), " ")
    return F.concat(F.array_join(F.reverse(words), " "), F.lit(" "))


def _nearly_always_longer(stream: DataFrame, percent: int) -> DataFrame:
    """(lang, key) of the phrases that the stream's next longer ones extend in at least ``percent`` of their places."""
    parent = F.element_at("begins", F.col("words") - 1)
    often = F.col("n").cast("decimal(20,0)") * 100 >= parent.cast("decimal(20,0)") * percent
    words = F.split("key", " ")
    key = F.concat(F.array_join(F.slice(words, 1, F.col("words") - 1), " "), F.lit(" "))
    return stream.where((F.col("words") >= 3) & often).select("lang", key.alias("key"))


def mine(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, percent: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to 4 words.

    a, l and r are the counts of the phrase and of both sides of its worst cut;
    score is floor(2000000 a / (l + r)); n counts the language's words.

    Defined cases: a null or empty text has no words; a null language is
    'und'; null ids and repeated rows count like any other row; languages
    without a phrase give no rows; other columns are ignored; an empty table
    gives an empty result. A text over 4 MB is counted in parts cut at piece
    ends; one without any piece end is held whole.
    """
    phrases, totals = counted(docs, min_count)
    forward = store(with_begins(phrases))
    backward = store(with_begins(phrases.withColumn("key", _turned(F.col("key")))))
    ends = backward.where("words >= 2").select("lang", _turned(F.col("key")).alias("key"),
                                               F.col("begins").alias("ends"))
    longer = _nearly_always_longer(forward, percent).unionByName(
        _nearly_always_longer(backward, percent).withColumn("key", _turned(F.col("key"))))
    score = ("cast(2000000 as decimal(7,0)) * cast(n as decimal(20,0)) "
             "div cast(element_at(begins, k) + element_at(ends, words - k) as decimal(20,0))")
    cut = F.expr(f"""array_min(transform(sequence(1, words - 1), k -> struct(
        {score} as score, k as k, element_at(begins, k) as l, element_at(ends, words - k) as r)))""")
    scored = (forward.where("words >= 2").hint("merge").join(ends, ["lang", "key"])
              .join(longer.hint("merge"), ["lang", "key"], "left_anti")
              .select("lang", F.expr("substring(key, 1, length(key) - 1)").alias("phrase"), F.col("n").alias("a"),
                      cut.alias("cut"))
              .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))
    first = (scored.withColumn("bucket", bucket)
             .withColumn("place", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order)))
             .where(F.col("place") <= top))
    best = (first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
            .where(F.col("rank") <= top))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
