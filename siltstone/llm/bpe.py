"""Byte-level BPE: merges by a priority queue of ranks over a doubly linked symbol list; decoding by concatenation.

``Bpe`` reads a ``tokenizers`` JSON file (byte-level pre-tokenizer with the usual word pattern, BPE model, added
tokens) and gives the ids that library gives with ``add_special_tokens=False``. Each pre-token is merged once per
Python worker and then found in a memo that is bounded in bytes, so the queue runs once per distinct pre-token.

Defined cases: null and empty texts have no ids and decode to the empty string; strings of special tokens inside a text become
that token's id, as in the library; one long run without spaces is a single pre-token, merged in O(n log n).
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import thrifty

#: The word pattern of byte-level BPE (a fixed value of the format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bytes of the memos of pre-tokens and of runs between spaces in a worker, each in an older and a newer half of which the older is forgotten when the newer is full;
#: what an entry needs beside its key and ids; the longest key that is kept.
MEMO_BYTES, ENTRY_BYTES, LONGEST = 192 << 20, 170, 64
#: A space that does not start a pre-token: white space or the end follows.
LOOSE = re.compile(r" (?:\s|$)")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself if printable in Latin-1, else the next free one from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class _Memo(dict):
    """pre-token -> its ids as little-endian 32-bit integers, of at most limit bytes; long keys are made anew each time."""

    def __init__(self, make, limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.old, self.held = make, limit, {}, 0

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = self.make(word)
            if len(word) > LONGEST:
                return out
        self.held += ENTRY_BYTES + 2 * len(word) + len(out)
        if self.held > self.limit:
            self.old = dict(self)
            self.clear()
            self.held = ENTRY_BYTES + 2 * len(word) + len(out)
        self[word] = out
        return out


class Bpe:
    """A loaded vocabulary; picklable by path, loaded once per worker through ``Bpe.of``."""

    _loaded: dict[str, "Bpe"] = {}

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec.get("normalizer") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or model["type"] != "BPE":
            raise ValueError(f"{path} is not a plain byte-level BPE")
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise ValueError("ids are packed in native order, which has to be little-endian with 32-bit integers")
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab = model["vocab"]
        self.base = [vocab[letters[b]] for b in range(256)]
        self.ranks: list[dict[int, int]] = [{} for _ in vocab]  # left id -> right id -> rank
        self.made: list[int] = []  # rank -> id of the merged symbol
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left]][vocab[right]] = rank
            self.made.append(vocab[left + right])
        #: Rank of each pair of bytes; NONE: no merge.
        self.none = len(self.made)
        self.bytes = [[self.ranks[self.base[a]].get(self.base[b], self.none) for b in range(256)] for a in range(256)]
        self.pieces = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for text, i in vocab.items():
            self.pieces[i] = bytes(back[c] for c in text)
        added = {}
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError(f"added token {t['content']!r} has options that are not supported")
            added[t["content"]] = pack("<I", t["id"])
            self.pieces[t["id"]] = t["content"].encode()
        self.added = added
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.words = regex.compile(WORDS)
        self.memo = _Memo(self._word, MEMO_BYTES // 4)
        self.runs = _Memo(self._spaced, MEMO_BYTES // 4)

    @classmethod
    def of(cls, path: str) -> "Bpe":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token: the lowest rank, leftmost first, until no pair has a rank."""
        base, ranks, made, none, first = self.base, self.ranks, self.made, self.none, self.bytes
        ids = [base[b] for b in data]
        n = len(ids)
        rank = [first[a][b] for a, b in zip(data, data[1:])]  # of the pair that starts at each symbol now
        shift = n.bit_length()
        mask = (1 << shift) - 1
        queue = [r << shift | i for i, r in enumerate(rank) if r < none]  # ordered by rank, then place
        if not queue:
            return ids
        rank.append(none)
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            r, i = entry >> shift, entry & mask
            if rank[i] != r:
                continue  # stale: one of its symbols has been merged since
            j = after[i]
            ids[i] = left = made[r]
            ids[j] = -1
            rank[j] = none
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank[i] = r = ranks[left].get(ids[k], none)
                if r < none:
                    heappush(queue, r << shift | i)
            else:
                rank[i] = none
            h = before[i]
            if h >= 0:
                rank[h] = r = ranks[ids[h]].get(left, none)
                if r < none:
                    heappush(queue, r << shift | h)
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        return array("I", self.merge(word.encode())).tobytes()

    def _spaced(self, run: str) -> bytes:
        """Ids of a space and the run after it, up to the next space that starts a pre-token."""
        if run.isalpha():
            return self._word(" " + run)
        return b"".join(map(self.memo.__getitem__, self.words.findall(" " + run)))

    def _plain(self, text: str) -> bytes:
        """A space before anything but white space always starts a pre-token, so runs between such spaces stand alone."""
        if LOOSE.search(text):
            return b"".join(map(self.memo.__getitem__, self.words.findall(text)))
        first, *rest = text.split(" ")
        return b"".join(map(self.memo.__getitem__, self.words.findall(first))) + b"".join(map(self.runs.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special is None or not any(x in text for x in self.added):
            return self._plain(text)
        return b"".join(self.added[part] if k % 2 else self._plain(part) for k, part in enumerate(self.special.split(text)))

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids, joined; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with the column ids (binary: little-endian unsigned 32-bit) and, if named, their decoded text.

    tokenizer: path of the vocabulary file, the same on every executor. Other columns pass through; a column that
    is already called like a new one is replaced.
    """
    new = [ids, *([decoded] if decoded else [])]
    df = df.drop(*(c for c in new if c != text))
    schema = T.StructType([f for f in df.schema.fields if f.name not in new] + [T.StructField(ids, T.BinaryType())] + ([T.StructField(decoded, T.StringType())] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(tokenizer)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                out = [bpe.encode(t) if t else b"" for t in texts.slice(a, 256).to_pylist()]
                columns = [part.column(i) for i, f in enumerate(part.schema) if f.name not in new] + [pa.array(out, pa.binary())]
                if decoded:
                    columns.append(pa.array([bpe.decode(x) for x in out], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(thrifty(run), schema)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """df with the text that its ids (binary, as from ``encode``) stand for; null ids: the empty text."""
    df = df.drop(text)
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(tokenizer)
        for batch in batches:
            out = [bpe.decode(x) if x else "" for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=schema.names)

    return df.mapInArrow(thrifty(run), schema)


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded text."""
    return df.select(
        "doc_id",
        (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col(ids), 256).alias("ids_sha256"),
        F.sha2(F.encode(F.col(decoded), "UTF-8"), 256).alias("decoded_sha256"),
    )
