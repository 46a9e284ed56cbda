"""Toxicity by a weighted lexicon over folded text, matched with Aho-Corasick.

Text is lower-cased, accents are taken off, look-alike letters of other scripts
and digits or signs inside words become Latin letters, and all else becomes
blanks. The lexicon is learned from labelled training documents: word starts
and whole words that stand in toxic documents far more often than in others,
weighted by their log odds. Exception phrases are neighbouring word pairs
around lexicon matches that are no more frequent in toxic documents than in
others; a match inside one does not count. A document's matches, as a sum and
per length, go through a logistic calibration.
"""

from __future__ import annotations

import math
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import words as W
from ledgerline.llm.common import bound_batches, fold, lower
from ledgerline.llm.labelled import fit_logistic, training_rows

#: At most so many labelled rows are learned from, and so many entries kept.
FIT_ROWS, LEXICON, EXCEPTIONS = 20_000, 4_000, 2_000
MIN_DOCS, MIN_ODDS, MIN_G2 = 5, 2.5, 30.0
STARTS = range(3, 9)

# Letters of other scripts and signs that look like Latin letters, and digit substitutions.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m",
    "н": "h", "о": "o", "р": "p", "ԛ": "q", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "γ": "y", "ω": "w", "ɑ": "a", "ɡ": "g", "ı": "i", "ʟ": "l", "ø": "o", "ł": "l", "đ": "d", "ℓ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

_tables: list[np.ndarray] = []


def _fold_tables() -> tuple[np.ndarray, np.ndarray]:
    """Code point -> folded code point (32 for anything that is no letter or digit), and substitutes (0: none)."""
    if not _tables:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x30000):
            base = unicodedata.normalize("NFKD", chr(c))[0]
            base = LOOKALIKES.get(base, base).lower()[:1]
            if unicodedata.combining(chr(c)):
                table[c] = 0
            elif base.isalnum():
                table[c] = ord(LOOKALIKES.get(base, base))
        other = np.zeros(0x110000, dtype=np.uint32)
        for a, b in SUBSTITUTES.items():
            other[ord(a)] = ord(b)
        _tables.extend([table, other])
    return _tables[0], _tables[1]


def folded(texts: pa.Array) -> list[str]:
    """Folded words of each text, each followed by a blank, with a blank in front."""
    table, other = _fold_tables()
    out = []
    for one in lower(texts).to_pylist():
        code = np.frombuffer(one.encode("utf-32-le"), dtype=np.uint32)
        line = table[code]
        swap = other[code]
        if swap.any():
            letter = (swap == 0) & ((line >= 97) & (line <= 122) | (line > 127))
            near = np.zeros(len(code), dtype=bool)
            near[:-1] = letter[1:]                                  # before a letter
            near[1:-1] |= letter[:-2] & (line[2:] != 32)            # or between a letter and a letter or digit
            line = np.where((swap > 0) & near, swap, line)
        line = line[line != 0]
        out.append(" " + " ".join(line.tobytes().decode("utf-32-le").split()) + " ")
    return out


def _counts(batches, find):
    """Sum (pattern, toxic, clean) of all documents of a task."""
    total: dict[str, list[int]] = {}
    for batch in batches:
        for label, text in zip(batch.column("label").to_pylist(), folded(batch.column("text"))):
            for pattern in find(text):
                total.setdefault(pattern, [0, 0])[1 - label] += 1
    keys = list(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array([total[k][0] for k in keys], pa.int64()),
         pa.array([total[k][1] for k in keys], pa.int64())], ["pattern", "toxic", "clean"])


def _candidates(text: str) -> set[str]:
    words = set(text.split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in STARTS if n <= len(w)}


def _odds(toxic, clean, n_toxic: int, n_clean: int):
    return F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))


def _g2(toxic, clean, share: float):
    n = toxic + clean
    term = lambda x, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
    return 2 * (term(toxic, share) + term(clean, 1 - share))


class Lexicon:
    """Aho-Corasick automaton of weighted entries and exception phrases."""

    def __init__(self, entries: dict[str, float], exceptions: set[str]):
        self.entries, self.exceptions = dict(entries), set(exceptions)
        self.automaton = None

    def __getstate__(self):
        return {"entries": self.entries, "exceptions": self.exceptions, "automaton": None,
                "w": getattr(self, "w", None)}

    def matches(self, text: str) -> list[tuple[int, float]]:
        """(word start, weight) of the words that match, without those inside exception phrases."""
        if not self.entries:
            return []
        if self.automaton is None:
            import ahocorasick
            self.automaton = ahocorasick.Automaton()
            for p in {*self.entries, *self.exceptions}:
                self.automaton.add_word(p, p)
            self.automaton.make_automaton()
        best: dict[int, float] = {}
        safe = []
        for end, p in self.automaton.iter(text):
            start = end - len(p) + 1
            if p in self.exceptions:
                safe.append((start, end))
            if p in self.entries:
                best[start] = max(best.get(start, 0.0), self.entries[p])
        for a, b in safe:
            for start in [s for s in best if a <= s < b]:
                del best[start]
        return sorted(best.items())

    def phrases(self, text: str) -> set[str]:
        """Word pairs around the matches of a text."""
        out = set()
        for start, _ in self.matches(text):
            end = text.index(" ", start + 1)
            following = text.find(" ", end + 1)
            if following > 0:
                out.add(text[start:following + 1])
            if start > 0:
                out.add(text[text.rindex(" ", 0, start):end + 1])
        return out

    def features(self, text: str) -> tuple[float, float]:
        total = sum(w for _, w in self.matches(text))
        return math.log1p(total), math.log1p(1000 * total / (text.count(" ") + 20))


def learn(train: DataFrame) -> Lexicon:
    """Lexicon, exceptions and calibration from (label, text) rows; without both labels it is empty."""
    sizes = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    lexicon = Lexicon({}, set())
    lexicon.w = np.array([0.0, 0.0, math.log((n_toxic + 0.5) / (n_clean + 1.0))])
    if not n_toxic or not n_clean:
        return lexicon
    schema = "pattern string, toxic long, clean long"

    def summed(find):
        return (train.select("label", "text").mapInArrow(lambda b: _counts(b, find), schema).groupBy("pattern")
                .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
                .withColumn("odds", _odds(F.col("toxic"), F.col("clean"), n_toxic, n_clean)))

    share = n_toxic / (n_toxic + n_clean)
    rows = (summed(_candidates).where((F.col("toxic") >= MIN_DOCS) & (F.col("odds") >= MIN_ODDS))
            .withColumn("g2", _g2(F.col("toxic"), F.col("clean"), share)).where(F.col("g2") >= MIN_G2)
            .orderBy(F.desc("g2"), "pattern").limit(LEXICON).collect())
    entries: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r.pattern.rstrip()), r.pattern)):
        shorter = [entries[r.pattern[:n]] for n in range(2, len(r.pattern)) if r.pattern[:n] in entries]
        if not shorter or r.odds > max(shorter) + 0.7:
            entries[r.pattern] = r.odds
    lexicon = Lexicon(entries, set())
    plain = lexicon
    safe = (summed(lambda t: plain.phrases(t)).where((F.col("clean") >= MIN_DOCS) & (F.col("odds") <= 0))
            .orderBy(F.desc("clean"), "pattern").limit(EXCEPTIONS).collect())
    lexicon = Lexicon(entries, {r.pattern for r in safe})

    def features(batches):
        for batch in batches:
            x = [lexicon.features(t) for t in folded(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").cast(pa.int32()), pa.array([a for a, _ in x], pa.float64()),
                 pa.array([b for _, b in x], pa.float64())], ["label", "a", "b"])

    # One row of three numbers per sampled document.
    table = train.select("label", "text").mapInArrow(features, "label int, a double, b double").toArrow()
    x = np.column_stack([table["a"].to_numpy(), table["b"].to_numpy()])
    lexicon.w = fit_logistic(x, table["label"].to_numpy().astype(float))
    return lexicon


def score(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, cut: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of (doc_id, text).

    Defined cases: a null or empty text has no match and gets the score of one
    without matches; a null id is in no fold (held_out false, not learned
    from); repeated rows are answered one by one; without labels of both kinds
    every score is the (smoothed) share of toxic rows; an empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = spark.sparkContext.broadcast(learn(training_rows(docs, labels, "toxic", folds, held, FIT_ROWS)))

    def predict(batches):
        lexicon = model.value
        for batch in batches:
            for lo, hi in W.slices(batch.column("text")):
                x = np.array([lexicon.features(t) for t in folded(batch.column("text").slice(lo, hi - lo))])
                z = x @ lexicon.w[:2] + lexicon.w[2]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))],
                    ["doc_id", "score"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(predict, schema).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"))
