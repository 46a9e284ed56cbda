"""Language identification by rank-order n-gram profiles.

Words are lower-cased runs of letters; each is padded with one blank on both
sides and cut into n-grams of 1 to 3 characters. A language profile is the
``PROFILE`` most frequent n-grams of its training documents, by rank. A
document's own most frequent n-grams are compared with each profile by
out-of-place distance: the sum of rank differences, with the profile's length
for an n-gram that the profile lacks.

N-gram counts cover all training documents: tasks count with numpy, one packed
table per batch and language is summed by n-gram in Spark, and the top n-grams
of each language (a fixed number) make the model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerline.llm import words as W
from ledgerline.llm.common import (
    bound_batches, fold, free_name, lower, store, store_last, stored_paths, with_row_key)

PROFILE = 300
PIECE_BYTES = 1 << 18   # text counted at once; memory is about 150 bytes per byte of it
MIN_SHARE = 0.001       # a language needs this share of all training n-grams, so there are 1000 profiles at most
QUANTILE = 0.005        # accepted() rejects a text less than SLACK times as close as this quantile of its language
SLACK = 0.5
_BITS = np.uint64(21)
_BLANK = np.uint32(32)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        table = np.zeros(0x110000, dtype=bool)
        for block in range(0, 0x110000, 0x1000):
            table[block:block + 0x1000] = [chr(c).isalpha() for c in range(block, block + 0x1000)]
        _letters.append(table)
    return _letters[0]


def _pieces(texts: pa.Array):
    """(first text, texts, bytes before, bytes after): runs of texts of PIECE_BYTES at most, a longer text in pieces.

    A piece has the character before it and the one after it as context.
    """
    buf, off = W.string_bytes(texts)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(off, off[at] + PIECE_BYTES, side="right")) - 1
        if to > at:
            yield at, texts.slice(at, min(to, len(texts)) - at), False, False
            at = min(to, len(texts))
            continue
        begin, end = int(off[at]), int(off[at + 1])
        starts = begin
        while starts < end:
            stops = _char_at_or_after(buf, min(starts + PIECE_BYTES, end), end)
            lo = starts if starts == begin else _char_before(buf, starts)
            hi = stops if stops == end else _char_at_or_after(buf, stops + 1, end)
            one = pa.Array.from_buffers(pa.large_string(), 1, [
                None, pa.py_buffer(np.array([0, hi - lo], dtype=np.int64)), pa.py_buffer(buf[lo:hi].copy())])
            yield at, one, starts > begin, stops < end
            starts = stops
        at += 1


def _char_at_or_after(buf: np.ndarray, at: int, end: int) -> int:
    while at < end and buf[at] & 0xC0 == 0x80:
        at += 1
    return min(at, end)


def _char_before(buf: np.ndarray, at: int) -> int:
    at -= 1
    while buf[at] & 0xC0 == 0x80:
        at -= 1
    return at


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram, document, count) of a run of texts, sorted by document and n-gram. An n-gram is up to
    three code points packed into 64 bits."""
    parts: list[tuple] = []
    for first, piece, before, after in _pieces(texts):
        gram, doc, count = _piece_ngrams(piece, before, after)
        if before and parts:                 # the same text again: add up
            old = parts.pop()
            gram, at = np.unique(np.concatenate([old[0], gram]), return_inverse=True)
            count = np.bincount(at, weights=np.concatenate([old[2], count])).astype(np.int64)
            doc = np.full(len(gram), first)
        else:
            doc = doc + first
        parts.append((gram, doc, count))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _piece_ngrams(texts: pa.Array, before: bool, after: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = lower(texts)
    sizes = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    buf, _ = W.string_bytes(low)
    code = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    n = len(code)
    letter = _is_letter()[code]
    # One blank slot after every document keeps neighbours apart; other characters become blanks.
    at = np.arange(n) + np.repeat(np.arange(len(sizes)), sizes) + 1
    line = np.full(n + len(sizes) + 1, _BLANK, dtype=np.uint64)
    line[at] = np.where(letter, code, _BLANK)
    doc = np.zeros(len(line), dtype=np.uint32)
    doc[at] = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
    ends = np.cumsum(sizes) + np.arange(len(sizes)) + 1
    doc[ends] = np.arange(len(sizes), dtype=np.uint32)      # the blank after a document is its own
    # A context character and what begins with it belong to the neighbouring piece.
    own = slice(2 if before else 1, len(line) - (2 if after else 1))
    pairs = slice(2 if before else 0, len(line) - (2 if after else 1))
    blank = line == _BLANK
    found = []
    one = np.flatnonzero(~blank[own]) + own.start
    found.append((line[one], doc[one]))
    two = np.flatnonzero(~(blank[pairs] & blank[pairs.start + 1:pairs.stop + 1])) + pairs.start
    # The blank before a word belongs to the word's document, also for a document's first word.
    found.append(((line[two] << _BITS) | line[two + 1], np.where(blank[two], doc[two + 1], doc[two])))
    found.append(((line[one - 1] << (_BITS * np.uint64(2))) | (line[one] << _BITS) | line[one + 1], doc[one]))
    grams, docs, counts = [], [], []
    for gram, owner in found:                # one order after the other
        ids, inner = _dense(gram)
        key = (owner.astype(np.uint64) << np.uint64(32)) | inner.astype(np.uint64)
        key, count = np.unique(key, return_counts=True)
        grams.append(ids[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)])
        docs.append((key >> np.uint64(32)).astype(np.int64))
        counts.append(count)
    gram, doc, count = map(np.concatenate, (grams, docs, counts))
    by = np.lexsort((gram, doc))
    return gram[by], doc[by], count[by]


def _dense(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (sorted) and each n-gram's number among them."""
    ids = np.unique(gram)
    return ids, np.searchsorted(ids, gram)


def ranked(gram: np.ndarray, doc: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The PROFILE most frequent n-grams per document as (n-gram, document, rank); ties to the smaller n-gram."""
    by = np.lexsort((gram, -count, doc))
    d = doc[by]
    begin = np.searchsorted(d, np.arange(d[-1] + 2 if len(d) else 1))
    rank = np.arange(len(d)) - begin[d]
    top = rank < PROFILE
    return gram[by][top], d[top], rank[top]


def learn_profiles(docs: DataFrame) -> DataFrame:
    """(lang, gram, rank) from (lang, text) rows; rows without a language or a letter teach nothing.

    A value of lang that has less than MIN_SHARE of all n-grams has no profile.
    """
    def count(batches):
        for batch in batches:
            text, lang = batch.column("text"), batch.column("lang")
            codes = lang.dictionary_encode()
            group = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for lo, hi in runs(text):
                gram, doc, n = ngrams(text.slice(lo, hi - lo))
                mine = group[lo + doc]
                for k in np.unique(mine).tolist():
                    own = mine == k
                    had = tables.get(k, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                    ids, where = np.unique(np.concatenate([had[0], gram[own]]), return_inverse=True)
                    total = np.bincount(where, weights=np.concatenate([had[1], n[own]])).astype(np.int64)
                    tables[k] = ids, total
            for k, (ids, total) in tables.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([codes.dictionary[k].as_py()] * len(ids), pa.string()), pa.array(ids.view(np.int64)),
                     pa.array(total)], ["lang", "gram", "n"])

    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    counts = store(docs.where("lang is not null and text is not null").select("lang", "text")
                   .mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    known = counts.groupBy("lang").agg(F.sum("n").alias("all")).where(F.col("all") >= MIN_SHARE * total).select("lang")
    return (counts.join(F.broadcast(known), "lang")                # 1 / MIN_SHARE rows at most
            .withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < PROFILE)
            .select("lang", "gram", "rank"))


class Model:
    """Profiles of all languages as one sorted n-gram table."""

    def __init__(self, rows):
        self.langs = sorted({r.lang for r in rows})
        number = {x: i for i, x in enumerate(self.langs)}
        self.gram = np.unique(np.array([r.gram for r in rows], dtype=np.int64).view(np.uint64))
        self.rank = np.full((len(self.gram) + 1, len(self.langs)), -1, dtype=np.int16)
        for r in rows:
            self.rank[np.searchsorted(self.gram, np.uint64(r.gram)), number[r.lang]] = r.rank

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, closeness from 0 to 1) per text; 'und' and 0 where there is no letter or no profile."""
        langs, close = [], [np.zeros(0)]
        for lo, hi in runs(texts):
            some, near = self._predict(texts.slice(lo, hi - lo))
            langs += some
            close.append(near)
        return langs, np.concatenate(close)

    def _predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        gram, doc, rank = ranked(*ngrams(texts))
        if not len(gram) or not self.langs:
            return ["und"] * n, np.zeros(n)
        at = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
        row = np.where(self.gram[at] == gram, at, len(self.gram))
        distance = np.empty((n, len(self.langs)))
        for j in range(len(self.langs)):
            theirs = self.rank[row, j]
            distance[:, j] = np.bincount(doc, weights=np.where(theirs < 0, PROFILE, np.abs(theirs - rank)), minlength=n)
        size = np.bincount(doc, minlength=n)
        best = distance.argmin(axis=1)
        close = 1 - distance[np.arange(n), best] / (np.maximum(size, 1) * PROFILE)
        return ([self.langs[b] if s else "und" for b, s in zip(best, size)],
                np.where(size > 0, np.clip(close, 0, 1), 0.0))


def runs(texts: pa.Array):
    """(from, to) row ranges of PIECE_BYTES each, or one longer text."""
    _, off = W.string_bytes(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + PIECE_BYTES, side="right")) - 1)
        yield at, min(to, len(texts))
        at = to


def _predicted(docs: DataFrame, learn: DataFrame, columns: list[str], name: str = "lang_pred",
               closeness: str = "score") -> DataFrame:
    spark = docs.sparkSession
    bound_batches(spark)
    # The model has PROFILE rows per distinct language value.
    model = spark.sparkContext.broadcast(Model(learn_profiles(learn).collect()))
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField(name, T.StringType()),
                           T.StructField(closeness, T.DoubleType())])

    def predict(batches):
        for batch in batches:
            lang, score = model.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(lang, pa.string()), pa.array(score)], schema.names)

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(predict, schema)


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of (doc_id, text, lang).

    Profiles are learned from the rows of the other folds that have a language.
    Defined cases: a text that is null or has no letter gives 'und' and score 0,
    as does every text if nothing could be learned; a null id belongs to no fold
    (held_out false, not learned from); repeated rows are learned from and
    answered one by one; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    learn = docs.where(fold(F.col("doc_id"), folds) != held)
    return _predicted(docs, learn, ["doc_id"]).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
        "lang_pred", "score")


def accepted(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """The rows of docs (doc_id, text, lang, others) whose text has a language; all columns.

    A text is accepted if it has a letter and is close enough to its profile:
    at least SLACK times the QUANTILE of the closeness that the training rows have
    which were identified as their own language. Defined cases: null texts, texts
    without a letter and, if nothing could be learned, all texts are rejected;
    repeated rows and rows without an id are judged one by one; an empty table
    gives an empty result.
    """
    key = free_name(docs, "_row_key")
    keyed = with_row_key(docs, key)
    before = stored_paths(docs.sparkSession)
    training = F.coalesce(fold(F.col("doc_id"), folds) != held, F.lit(False))
    rows = keyed.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang"), training.alias("training"))
    scored = store(_predicted(rows, rows.where("training"), ["key", "lang", "training"], "guess", "close")
                   .select("key", "guess", "close", (F.col("training") & (F.col("lang") == F.col("guess"))).alias("own")))
    floors = scored.where("own").groupBy("guess").agg(
        (F.percentile_approx("close", QUANTILE, 10_000) * SLACK).alias("floor"))      # one row per profile
    # Few rows are rejected, so their keys, not those of the others, are looked up.
    near = (F.col("guess") != "und") & (F.col("close") >= F.coalesce("floor", F.lit(0.0)))
    rejected = scored.join(F.broadcast(floors), "guess", "left").where(~near).select(F.col("key").alias(key))
    return keyed.join(store_last(rejected, before), key, "left_anti").select(*docs.columns)
