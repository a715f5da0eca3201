"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over a text's code points cuts it where the hash of the last 16
of them has a given form, so that documents that share a passage share its
chunks. Each distinct chunk is encoded once for each task and kept. The
encodings of two neighbours needn't join to the encoding of both: a word, a run
of spaces or a special token may straddle the cut. So each join is repaired:
some bytes on both sides of it are encoded again together, and ever more of
them, until the new tokens agree with what stood on the left in their first
token and with what stands on the right in some token. If they don't agree on
the right within the whole chunk, the new tokens stay, and the next join
goes on from them.

Why agreement makes the join exact. A list of tokens is the encoding of a piece
of text that pre-tokenisation doesn't split if and only if each two neighbours
in it are the encoding of their own text, since merges are chosen by rank alone.
A list that changes over at a token which both lists have keeps each pair of
neighbours. The pre-tokeniser's pieces are runs of one class of characters, so
that scans which begin at different places of a run end it at the same place.
Only an apostrophe, white space and a special token make them look further, by
fewer characters than the least REACH.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from queuelake.llm.common import session_of, small_batches, text_or_empty

WINDOW = 16
#: A cut has these many leading zero bits in its hash: chunks of some 512 code points on average, and of MOST_CHUNK at most.
CUT_BITS = 9
LEAST_CHUNK, MOST_CHUNK = 64, 2048
#: Bytes on each side of a join that are encoded again at first; four times as many at each further try.
REACH = 32
#: Bytes of chunks and their tokens that a task keeps. What is dropped is encoded again when it comes back; that costs time only.
KEPT_BYTES = 16 << 20
#: Fixed value: the byte-level pre-tokeniser's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of an installed public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def cuts(text: str) -> list[int]:
    """The places at which ``text`` is cut, its end included. A cut depends on the 16 code points before it and on the last cut."""
    n = len(text)
    if n <= LEAST_CHUNK:
        return [n]
    h = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()
    base, width = np.uint32(0x9E3779B1), 1
    factor = base
    with np.errstate(over="ignore"):
        while width < WINDOW:  # hashes of 2, 4, 8, 16 code points, each from two of half the width
            h[width:] = h[width:] + factor * h[:-width]
            factor, width = factor * factor, width * 2
        h *= np.uint32(0x85EBCA6B)
    out, last = [], 0
    for at in [*(np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist(), n]:
        while at - last > MOST_CHUNK:
            last += MOST_CHUNK
            out.append(last)
        if at - last >= LEAST_CHUNK or at == n and at > last:
            last = at
            out.append(last)
    return out


def _alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class ChunkedBpe:
    """Encodes texts through shared chunks, as the tokenizers library does with the file at ``path``.

    A file that isn't byte-level BPE with the usual pattern is an error: the
    joins' exactness rests on it.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        known = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not known or not plain or any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError(f"{path} isn't a byte-level BPE tokenizer")
        alphabet = _alphabet()
        special = {t["content"]: t["id"] for t in added}
        of = {i: bytes(alphabet[c] for c in token) for token, i in model["vocab"].items() if token not in special} | {i: t.encode() for t, i in special.items()}
        top = max(of) + 1
        self.token_bytes = [of.get(i, b"") for i in range(top)]
        self.names = [str(i) for i in range(top)]
        self.lengths = [len(b) for b in self.token_bytes]
        self.reach = max(REACH, 2 * max((len(t.encode()) for t in special), default=0))
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        self._encode = self._by_rank(of, special) if merged == sorted(set(merged)) else self._by_library(path)
        self._of_task()

    def _of_task(self) -> None:
        """Forget the chunks, as at a task's end."""
        self.chunks: dict[str, array] = {}
        self.older: dict[str, array] = {}
        self.kept = 0
        #: How many chunks were asked for, encoded, and bytes encoded again at joins.
        self.asked = self.encoded = self.repaired = 0

    @staticmethod
    def _by_rank(of: dict[int, bytes], special: dict[str, int]) -> Callable[[str], list[int]]:
        """Where ids are in the order of merges, an id is its merge's rank."""
        import tiktoken

        ranks = {b: i for i, b in of.items() if i not in set(special.values())}
        made = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: made.encode(text, allowed_special="all", disallowed_special=())

    @staticmethod
    def _by_library(path: str) -> Callable[[str], list[int]]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        return lambda text: made.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", errors="replace")

    def _chunk(self, chunk: str) -> array:
        """A chunk's own encoding, made once while it is kept."""
        self.asked += 1
        found = self.chunks.get(chunk)
        if found is None:
            found = self.older.get(chunk)
            if found is None:
                self.encoded += 1
                found = array("I", self._encode(chunk))
            if self.kept > KEPT_BYTES // 2:
                self.older, self.chunks, self.kept = self.chunks, {}, 0
            self.chunks[chunk] = found
            self.kept += 4 * len(chunk) + 4 * len(found) + 250
        return found

    def _agreement(self, found: list[int], at: int, chunk: array, start: int) -> tuple[int, int] | None:
        """The first token that both lists have at one place; the lists begin at bytes ``at`` and ``start``."""
        lengths, a, b = self.lengths, 0, 0
        n, m = len(found), len(chunk)
        while a < n and b < m:
            if at < start:
                at += lengths[found[a]]
                a += 1
            elif start < at:
                start += lengths[chunk[b]]
                b += 1
            elif found[a] == chunk[b]:
                return a, b
            else:
                at += lengths[found[a]]
                start += lengths[chunk[b]]
                a, b = a + 1, b + 1
        return None

    def _join(self, data: bytes, ids: array, at: int, chunk: array, end: int) -> None:
        """Make ``ids``, the encoding of data[:at], that of data[:end]; ``chunk`` is the encoding of data[at:end]."""
        lengths, reach = self.lengths, self.reach
        while True:
            i, left = len(ids), at
            while i and (at - left < reach or data[left] & 0xC0 == 0x80):  # not within a character
                i -= 1
                left -= lengths[ids[i]]
            j, right, m = 0, at, len(chunk)
            while j < m and (right - at < reach or right < end and data[right] & 0xC0 == 0x80):
                right += lengths[chunk[j]]
                j += 1
            found = self._encode(data[left:right].decode())
            self.repaired += right - left
            if not i or found[0] == ids[i]:
                both = self._agreement(found, left, chunk, at)
                if both:
                    del ids[i:]
                    ids.extend(found[: both[0]])
                    ids.extend(chunk[both[1] :])
                    return
                if j == m:
                    del ids[i:]
                    ids.extend(found)
                    return
            reach *= 4

    def encode(self, text: str) -> array:
        """The ids of a whole text."""
        data, ids, at, last = text.encode(), array("I"), 0, 0
        for cut in cuts(text) if text else ():
            piece, last = text[last:cut], cut
            chunk, end = self._chunk(piece), at + (len(piece) if piece.isascii() else len(piece.encode()))
            if at:
                self._join(data, ids, at, chunk, end)
            else:
                ids.extend(chunk)
            at = end
        return ids


@lru_cache(1)
def _of_process(path: str) -> ChunkedBpe:
    """A worker process reads a vocabulary once; the chunks are each task's own."""
    return ChunkedBpe(path)


def encode_documents(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """Every document's n_tokens, ids_sha256, decoded_sha256 (and ``ids`` themselves, if asked for).

    Defined cases: a null or empty text has no tokens; special tokens' strings
    inside a text are encoded as the library does by default; texts of any
    length are encoded whole; repeated rows are encoded alike; an empty table
    gives an empty result. Other columns are not passed on.
    """
    small_batches(session_of(docs))

    def encode(batches: Iterator) -> Iterator:
        coder = _of_process(path)
        coder._of_task()
        try:
            for batch in batches:
                counts, hashes, decoded, lists = [], [], [], []
                for text in batch.column("text").to_pylist():
                    found = coder.encode(text)
                    counts.append(len(found))
                    hashes.append(hashlib.sha256(",".join(map(coder.names.__getitem__, found)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(coder.decode(found).encode()).hexdigest())
                    if ids:
                        lists.append(found.tolist())
                columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(lists, pa.list_(pa.int32()))} if ids else {}))
        finally:
            coder._of_task()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(encode, schema)
