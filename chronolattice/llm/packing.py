"""Packing tokenised documents into sequences by order-preserving dynamic programming.

The documents of a partition, in their order, form one token stream.  Windows
of at most ``length`` tokens cut it at document ends (free) or sentence ends (a
penalty); where neither lies within ``length`` tokens of the last one, a window
is filled and cut inside the sentence.  The programme minimises padding plus
penalties; with g = padding so far + position, the best cut before a candidate is
the least g in the last ``length`` tokens, which a monotone queue yields in
constant time.

Memory is bounded without loss: when ``BLOCK`` tokens are in hand, the ways back
from all cuts that a later window can start at are followed to where they meet;
up to there the best cuts are settled whatever follows, and are written out.  In
practice they meet within a few windows; if they do not, more is read first.

No shuffle: every partition packs what it reads, in the order it reads it, and
numbers its sequences from ``partition << 40``; a partition read anew gives the
same rows.  Which documents share a sequence depends on how Spark splits the
files: another split gives another packing, and each partition ends in a
sequence of its own.

Edge cases.  Null and empty texts are one token (the closing id 0).  Rows that
repeat an id are documents of their own.  Texts are taken whole, at any length.
An empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

LENGTH = 1024
END_ID = 0
#: A cut at a sentence end costs as much as this share of a window in padding.
SENTENCE_PENALTY = 1 / 256
BLOCK = 1 << 18

_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokenizer:
    """Ids of a byte-level BPE vocabulary file of ``tokenizers``, without special tokens added.

    Ordinary texts are encoded by ``tiktoken`` over the same vocabulary, which
    gives the same ids several times faster; a text that holds one of the
    vocabulary's special strings is encoded by ``tokenizers`` itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        spec = json.loads(open(path, encoding="utf-8").read())  # noqa: SIM115
        self.path, letters = path, _byte_letters()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.bytes = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self._fast = tiktoken.Encoding("byte-level", pat_str=_SPLIT, mergeable_ranks=self.bytes, special_tokens={})
        self.sentence = np.zeros(1 + max(self.bytes.values()) + len(self.special), bool)
        for b, i in self.bytes.items():
            self.sentence[i] = b.endswith((b".", b"!", b"?")) or b"\n" in b

    @cache  # noqa: B019
    def _exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self._exact().encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self._fast.encode_ordinary(text), np.uint32)


@cache
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def best_cuts(positions: list[int], penalties: list[int], length: int = LENGTH) -> tuple[list[int], list[int]]:
    """For each candidate the least ``padding + penalties + position`` up to it and the candidate before it (-1: the start)."""
    g, back = [], []
    queue_p, queue_g, queue_k, head = [0], [0], [-1], 0
    for k, p in enumerate(positions):
        least = p - length
        while queue_p[head] < least:
            head += 1
        value = queue_g[head] + length + penalties[k]
        g.append(value)
        back.append(queue_k[head])
        while len(queue_g) > head and queue_g[-1] >= value:
            queue_p.pop()
            queue_g.pop()
            queue_k.pop()
        queue_p.append(p)
        queue_g.append(value)
        queue_k.append(k)
    return g, back


def candidates(n: int, document_ends: np.ndarray, sentence_ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream of n tokens may be cut, and the penalties: at ends and, where they lie too far apart, at full windows between."""
    penalty = np.full(n + 1, -1, np.int64)
    cost = round(SENTENCE_PENALTY * length)
    penalty[sentence_ends] = cost
    penalty[document_ends] = 0
    penalty[0] = -1
    at = np.flatnonzero(penalty >= 0)
    before = np.concatenate(([0], at[:-1]))
    for a, b in zip(before[at - before > length].tolist(), at[at - before > length].tolist()):
        penalty[a + length : b : length] = cost
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def settled(positions: list[int], back: list[int], n: int, length: int = LENGTH) -> int:
    """The last candidate that the best cuts of every continuation of the stream go through (-1: only the start)."""
    live = {k for k in range(len(positions)) if positions[k] > n - length}
    if n <= length:
        live.add(-1)
    while len(live) > 1:
        last = max(live)
        live.remove(last)
        live.add(back[last])
    return live.pop() if live else -1


def windows(tokens: np.ndarray, document_ends: np.ndarray, sentence: np.ndarray, last: bool, length: int = LENGTH) -> np.ndarray:
    """Ends of the windows of the tokens in hand; unless they are the ``last``, of the settled ones alone."""
    n = len(tokens)
    at, penalties = candidates(n, document_ends, np.flatnonzero(sentence[tokens]) + 1, length)
    positions = at.tolist()
    _, back = best_cuts(positions, penalties.tolist(), length)
    k = len(positions) - 1 if last else settled(positions, back, n, length)
    ends = []
    while k >= 0:
        ends.append(positions[k])
        k = back[k]
    return np.array(ends[::-1], np.int64)


class Packer:
    """Streams documents in, blocks of pieces out."""

    def __init__(self, sentence: np.ndarray, first_sequence: int, length: int = LENGTH) -> None:
        self.sentence, self.next, self.length = sentence, first_sequence, length
        self.tokens: list[np.ndarray] = []
        #: Of each document in hand: number, tokens before what is in hand, tokens in all.
        self.docs: list[tuple[object, int, int]] = []
        self.size, self.full = 0, max(BLOCK, 4 * length)

    def add(self, doc: object, ids: np.ndarray) -> bool:
        """Takes a document; true if a block is full."""
        self.tokens.append(ids)
        self.docs.append((doc, 0, len(ids)))
        self.size += len(ids)
        return self.size >= self.full

    def flush(self, last: bool) -> dict[str, list]:
        """Pieces of the block in hand."""
        out: dict[str, list] = {k: [] for k in ("doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        if not self.size:
            return out
        tokens = np.concatenate(self.tokens)
        doc_ends = np.cumsum([total - before for _, before, total in self.docs])
        ends = windows(tokens, doc_ends, self.sentence, last, self.length)
        self.full = max(BLOCK, 4 * self.length) if len(ends) else 2 * self.size
        if not len(ends):
            return out
        stop = int(ends[-1])
        edges = np.unique(np.concatenate((ends, doc_ends[doc_ends <= stop])))
        starts = np.concatenate(([0], edges[:-1]))
        doc_of = np.searchsorted(doc_ends, starts, side="right")
        window_of = np.searchsorted(ends, starts, side="right")
        window_starts = np.concatenate(([0], ends[:-1]))
        doc_starts = np.concatenate(([0], doc_ends[:-1])) - np.array([before for _, before, _ in self.docs])
        raw = memoryview(tokens.astype("<u4").tobytes())
        out["doc"] = [self.docs[d][0] for d in doc_of]
        out["start"] = (starts - doc_starts[doc_of]).tolist()
        out["length"] = (edges - starts).tolist()
        out["ids_crc32"] = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), edges.tolist())]
        out["doc_tokens"] = [self.docs[d][2] for d in doc_of]
        out["sequence_id"] = (self.next + window_of).tolist()
        out["offset"] = (starts - window_starts[window_of]).tolist()
        self.next += len(ends)
        left = int(np.searchsorted(doc_ends, stop, side="right"))
        docs = self.docs[left:]
        if docs:
            doc, before, total = docs[0]
            begin = int(doc_ends[left]) - (total - before)
            docs[0] = (doc, before + max(0, stop - begin), total)
        self.docs, self.tokens, self.size = docs, [tokens[stop:]] if stop < len(tokens) else [], len(tokens) - stop
        return out


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``vocabulary`` is the path of a byte-level BPE file on every executor.
    """
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary)
        context = TaskContext.get()
        packer = Packer(t.sentence, (context.partitionId() if context else 0) << 40, length)
        kind = None
        names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def batch(last: bool) -> pa.RecordBatch:
            found = packer.flush(last)
            return pa.RecordBatch.from_arrays([pa.array(found["doc"], kind), *[pa.array(found[k], pa.int64()) for k in names]], ["doc_id", *names])

        for b in batches:
            kind = b.column(0).type
            for doc, text in zip(b.column(0), b.column(1)):
                ids = t.encode(text.as_py() or "")
                if packer.add(doc.as_py(), np.append(ids, np.uint32(END_ID))):
                    yield batch(False)
        if kind is not None:
            yield batch(True)

    return slim.mapInArrow(run, f"doc_id {slim.schema[0].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
