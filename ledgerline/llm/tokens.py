"""Token ids by the ``tokenizers`` library, each distinct chunk of a slice encoded once.

A text is cut before every white-space byte that follows a character which is
no white space, and before a punctuation mark that follows an ASCII letter. No
token of a byte-level BPE with the usual splitting pattern spans such a place
and the pattern looks at nothing before it, so the ids of the chunks, joined,
are the ids of the text (tests hold them equal). Equal chunks
repeat often, so a slice's distinct chunks are found by a dictionary encoding,
and only those a worker has not met lately go through the library.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa

from ledgerline.llm import words as W

KNOWN = 500_000        # chunks a worker remembers (about 200 MB); a memory bound without effect on the ids
END = 0

# Last bytes of the white-space characters outside ASCII; a cut after any character that ends so is left out.
_AFTER = np.ones(256, dtype=bool)
_AFTER[:0x21] = False
_AFTER[[0x7F, 0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = False
# A chunk begins where a bit of the byte meets the same bit of the byte before it: white space after no white space, or a
# mark after a letter.
_BYTE, _BEFORE = W.SPACE.astype(np.uint8), _AFTER.astype(np.uint8)
_BYTE[[*b",.;:!?"]] |= 2
_BEFORE[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] |= 2
_SPACES, _ENDS = frozenset(np.flatnonzero(W.SPACE).tolist()), frozenset(np.flatnonzero(_AFTER).tolist())


def _cuts(buf: np.ndarray) -> np.ndarray:
    """Whether a chunk begins at each byte but the first."""
    return (_BYTE.take(buf[1:]) & _BEFORE.take(buf[:-1])) > 0


class Chunks:
    """Ids of the chunks met lately, in one flat array."""

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values(), default=0) + 1
        # A byte-level token has one character for each of its bytes.
        self.width = np.zeros(self.size, dtype=np.int64)
        self.width[list(vocabulary.values())] = [len(t) for t in vocabulary]
        for token_id, token in self.tokenizer.get_added_tokens_decoder().items():
            raw = np.frombuffer(token.content.encode(), dtype=np.uint8)
            if _cuts(raw).any():
                raise ValueError(f"added token {token.content!r} could lie across two chunks")
            self.width[token_id] = len(raw)
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.ends = np.array([END], np.uint32), np.array([0, 1])     # number 0: the end of a text

    def add(self, chunks: list[bytes]) -> None:
        """Encode new chunks. Those that begin with white space and end without are encoded many at a time, as
        their joined text has the same ids; the ids' bytes tell them apart."""
        plain = [c[0] in _SPACES and c[-1] in _ENDS for c in chunks]
        joined = [i for i, p in enumerate(plain) if p]
        single = [i for i, p in enumerate(plain) if not p]
        groups = [joined[a:a + 200] for a in range(0, len(joined), 200)] + [[i] for i in single]
        ids, ends = [], []
        for a in range(0, len(groups), 64):
            part = groups[a:a + 64]
            texts = [b"".join([chunks[i] for i in g]).decode() for g in part]
            for g, e in zip(part, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                got = np.array(e.ids, dtype=np.uint32)
                ids.append(got)
                if len(g) == 1:
                    ends.append(np.array([len(got)]))
                    continue
                upto = np.cumsum(self.width[got])
                want = np.cumsum([len(chunks[i]) for i in g])
                at = np.searchsorted(upto, want)
                if len(upto) != at[-1] + 1 or (upto[at] != want).any():
                    raise ValueError("the tokenizer is not a byte-level BPE: its ids do not cover the text's bytes")
                ends.append(np.diff(at + 1, prepend=0))
        start = len(self.ends) - 1
        self.number.update(zip((chunks[i] for g in groups for i in g), range(start, start + len(chunks))))
        self.flat = np.concatenate([self.flat, *ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate([*ends, np.zeros(0, int)]))])

    def find(self, chunks: list[bytes]) -> np.ndarray:
        """Number of each chunk, encoding those not known."""
        out = np.fromiter(map(self.number.get, chunks, repeat(-1)), dtype=np.int64, count=len(chunks))
        missing = np.flatnonzero(out < 0)
        if len(self.number) + len(missing) > KNOWN:
            self.clear()
            missing = np.arange(len(chunks))
        fresh = [chunks[i] for i in missing.tolist()]
        self.add(fresh)
        out[missing] = np.fromiter(map(self.number.__getitem__, fresh), dtype=np.int64, count=len(fresh))
        return out


def _chunks(path: str, cache: dict = {}) -> Chunks:
    if path not in cache:
        cache[path] = Chunks(path)
    return cache[path]


def vocabulary_size(path: str) -> int:
    """Largest id + 1."""
    return _chunks(path).size


def _values(binary: pa.LargeBinaryArray) -> list[bytes]:
    """``to_pylist`` of an array without nulls, by slicing its data once."""
    _, offsets, data = binary.buffers()
    at = np.frombuffer(offsets, np.int64)[binary.offset:binary.offset + len(binary) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(at, at[1:])]


def encode_slice(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): unsigned 32-bit ids of a run of texts, each followed by END, and each text's place (n + 1)."""
    known = _chunks(path)
    buf, off = W.string_bytes(texts)
    n = len(buf)
    cut = np.zeros(n + 1, dtype=bool)
    cut[1:n] = _cuts(buf)
    cut[off[:-1][np.diff(off) > 0]] = True
    at = np.flatnonzero(cut)
    chunks = pa.Array.from_buffers(pa.large_binary(), len(at), [
        None, pa.py_buffer(np.append(at, n).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])
    coded = chunks.dictionary_encode()
    number = known.find(_values(coded.dictionary)).take(coded.indices.to_numpy(zero_copy_only=False))
    # Every text's chunks, then the end.
    chunk = np.searchsorted(at, off) + np.arange(len(off))
    order = np.zeros(len(at) + len(off) - 1, dtype=np.int64)
    inner = np.ones(len(order), dtype=bool)
    inner[chunk[1:] - 1] = False
    order[inner] = number
    begin = known.ends.take(order)
    count = known.ends.take(order + 1) - begin
    ends = np.concatenate([[0], np.cumsum(count)])
    source = np.repeat(begin - ends[:-1], count)
    source += np.arange(len(source))
    return known.flat.take(source), ends.take(chunk)
