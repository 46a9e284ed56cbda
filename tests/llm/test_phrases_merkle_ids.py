"""Phrase mining, Merkle manifest and token-id dataset against brute force, round trips and edge cases."""

from __future__ import annotations

import random
import resource
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import merkle, phrases, queries, rans, tokens
from ledgerline.llm.common import fold

from . import brute
from .test_operators import EDGES, SF, docs, edges, ordered, rows  # noqa: F401


def test_phrases_match_brute_force(docs, spark):  # noqa: F811
    got = rows(queries.op11_phrases(spark, SF), "lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert got and sorted(got) == sorted(brute.phrases(rows(docs, "lang", "text")))


def test_phrases_edges(edges, spark):  # noqa: F811
    for least in (1, 4):
        got = rows(phrases.mine(edges, min_count=least), "lang", "rank", "phrase", "a", "l", "r", "n", "score")
        assert sorted(got) == sorted(brute.phrases(rows(edges, "lang", "text"), least))
    assert phrases.mine(edges.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_phrases_of_few_words_over_many_ranges(spark, seed):
    """Words below the blank's byte, ties, one dominant window, nulls; more ranges than keys."""
    draw = random.Random(seed)
    words = ["A", "a", "b", "a\x01", "b\x1f", "é", "名", "0", "zz", "\x02"]
    table = [(draw.choice(["x", "y", None]), "".join(
        draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(draw.randrange(60))))
        for _ in range(60)] + [("x", "same words here again")] * 200 + [(None, None), ("z", "")]
    frame = spark.createDataFrame(table, "lang string, text string").repartition(7)
    for least, top in ((3, 2000), (30, 5)):
        got = rows(phrases.mine(frame, least, top), "lang", "rank", "phrase", "a", "l", "r", "n", "score")
        assert got and sorted(got) == sorted(brute.phrases(table, least, top))


def test_phrase_counts_do_not_depend_on_batches():
    text = pa.array(["a b a b c. a b a b c d a b", "b a b a b a"])
    _, n, keys = phrases.windows(text, np.zeros(2, np.int64))
    whole = pa.RecordBatch.from_arrays([pa.array(["x"] * len(n)), keys.cast(pa.binary()).cast(pa.string()), pa.array(n)],
                                       ["lang", "window", "n"])

    def counts(size):
        from collections import Counter
        total = Counter()
        for batch in phrases.phrase_counts((whole.slice(a, size) for a in range(0, len(n), size)), 1):
            for r in batch.to_pylist():
                total[r["key"], r["words"]] += r["n"]
        assert total["", 0] == 19
        return total
    assert counts(1) == counts(2) == counts(3) == counts(len(n))


def test_very_long_text_is_counted_in_parts(spark):
    text = ". ".join(f"alpha beta w{i % 500} gamma" for i in range(400_000))      # about 10 MB
    whole = text.encode()
    parts = list(phrases._parts(pa.array([text], pa.large_string())))
    assert len(parts) > 3 and b"".join(p[0].as_py().encode() for p in parts) == whole
    frame = spark.createDataFrame([("x", text)], "lang string, text string")
    got = {r.phrase: r.a for r in phrases.mine(frame).collect()}
    assert got["alpha beta"] == 400_000 and got["alpha beta w7 gamma"] == 800


MERKLE = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _manifest(frame):
    return ordered(rows(merkle.manifest(frame, fold(F.col("doc_id"), 5) == 0), *MERKLE))


def test_manifest_edges(edges):  # noqa: F811
    want = brute.merkle(rows(edges, "doc_id", "source", "lang", "n_chars", "text"))
    assert _manifest(edges) == ordered(want)
    assert _manifest(edges.limit(0)) == []
    one = edges.where("doc_id = 5")
    got = _manifest(one)
    assert got[0][1] == got[0][2] == got[0][3]


def test_manifest_of_uneven_groups(spark):
    """Groups of 1, 15, 16, 17, 256, 257 and 4,100 leaves: every height, lone last runs, repeated rows and ids."""
    table = []
    for s, m in (("a", 1), ("b", 15), ("B", 16), (None, 17), ("", 256), ("é", 257), ("hot", 4100), ("z", 2)):
        table += [(len(table) + i // 3, s, None if i % 7 == 0 else "en", i, f"Text {i % 50} OF {s}") for i in range(m)]
    table += [(None, "hot", "en", 1, None)] * 3
    frame = spark.createDataFrame(table, "doc_id long, source string, lang string, n_chars long, text string")
    want = brute.merkle(table)
    assert _manifest(frame.repartition(5)) == ordered(want)
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_manifest_of_many_groups(spark):
    table = [(i, f"s{i % 300}", "en", i, "X") for i in range(700)]
    frame = spark.createDataFrame(table, "doc_id long, source string, lang string, n_chars long, text string")
    assert _manifest(frame) == ordered(brute.merkle(table))


def _library_ids(text):
    tokenizer = tokens._chunks(queries.tokenizer_path("byte_bpe_50k.json")).tokenizer
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def _want_ids(table):
    """(doc_id, start, n_tokens, crc) in the documented order."""
    coded = []
    for doc, text in table:
        ids = np.array(_library_ids(text))
        coded.append((doc is not None, doc or 0, zlib.crc32(ids.astype("<u2").tobytes()), doc, ids))
    out, at = [], 0
    for _, _, _, doc, ids in sorted(coded, key=lambda x: x[:3]):
        out.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        at += len(ids)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab1'.,!s \t\n\r\x0b\x1c\x85\xa0   　é名​﻿", max_size=30) | st.none()
                | st.text(max_size=20).map(lambda x: x + "<|endoftext|> " + x), min_size=1, max_size=6))
def test_chunks_have_the_ids_of_the_whole_text(texts):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    ids, first = tokens.encode_slice(pa.array(texts, pa.string()), queries.tokenizer_path("byte_bpe_50k.json"))
    for i, t in enumerate(texts):
        assert ids[first[i]:first[i + 1]].tolist() == _library_ids(t)


def test_distinct_chunks_are_sliced_from_their_data():
    held = pa.array([b"", b" a", b"", b"\xc3\xa9", b"b,"], pa.large_binary())
    for lo in range(6):
        assert tokens._values(held.slice(lo)) == held.slice(lo).to_pylist()
    assert tokens._values(held.slice(1, 2)) == [b" a", b""] and tokens._values(pa.array([], pa.large_binary())) == []


def test_token_ids_match_the_library(docs, spark):  # noqa: F811
    got = rows(queries.op13_token_ids(spark, SF), "doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(got) == _want_ids(rows(docs, "doc_id", "text"))


def test_token_ids_edges_and_long_documents(edges, spark, monkeypatch):  # noqa: F811
    path = queries.tokenizer_path("byte_bpe_50k.json")
    columns = ("doc_id", "start", "n_tokens", "ids_crc32")
    assert ordered(rows(rans.round_trip(edges, path), *columns)) == ordered(_want_ids([(r[0], r[1]) for r in EDGES]))
    assert rans.round_trip(edges.limit(0), path).count() == 0
    # Documents that span several blocks, beside empty ones; the whole in one range.
    table = [(i, None if i % 3 else " ".join(f"w{j % 800}" for j in range(i * 900))) for i in range(1, 60)]
    table += [(100, " ".join(f"x{j % 3000}" for j in range(300_000)))]
    frame = spark.createDataFrame(table, "doc_id long, text string").coalesce(1)
    assert sorted(rows(rans.round_trip(frame, path), *columns)) == _want_ids(table)


def test_a_very_long_text_takes_bounded_memory():
    text = pa.array([" ".join(f"w{i % 5000}" for i in range(1_800_000))], pa.large_string())      # about 10 MB
    path = queries.tokenizer_path("byte_bpe_50k.json")
    tokens.encode_slice(text.slice(0, 0), path)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ids, first = tokens.encode_slice(text, path)
    assert len(ids) == first[-1] > 1_800_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_blocks_round_trip_and_find_damage():
    draw = np.random.default_rng(5)
    ids = np.minimum(draw.zipf(1.3, size=(3, 70_001)), 3000)
    table = rans.scaled(np.bincount(ids.ravel(), minlength=4000))
    assert int(table.freq.sum()) == 1 << table.bits and (table.freq[np.bincount(ids.ravel(), minlength=4000) > 0] > 0).all()
    payloads = rans.encode_blocks(ids, table)
    assert all((a == b).all() for a, b in zip(ids, rans.decode_blocks(payloads, table)))
    share = np.bincount(ids.ravel())
    share = share[share > 0] / ids.size
    assert sum(map(len, payloads)) * 8 < 1.12 * ids.size * -(share * np.log2(share)).sum()
    for a, b in ((0, 1), (32_767, 32_769), (65_000, 70_001), (69_999, 80_000), (5, 5)):
        assert (rans.decode_range(payloads[1], a, b, table) == ids[1, a:b]).all()
    for place in (0, 40, 5_000, len(payloads[0]) - 1):
        broken = bytearray(payloads[0])
        broken[place] ^= 4
        with pytest.raises(ValueError):
            rans.decode_blocks([bytes(broken)], table)
    other = rans.scaled(np.bincount(ids.ravel() + 1, minlength=4000))
    with pytest.raises(ValueError):
        rans.decode_blocks(payloads, other)
    with pytest.raises(ValueError):
        rans.encode_blocks(np.array([[3500]]), table)


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=50), st.binary(max_size=3000))
def test_joined_checksums(a, b):
    assert rans.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
