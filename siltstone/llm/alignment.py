"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which of them do so most.

A is a ``tokenizers`` file with a byte-level vocabulary, B a ``sentencepiece`` model. Both encode a space and the text, without special tokens. In ``mapInArrow`` a two-pointer merge of the
cumulative ends of both lists of tokens emits groups (tokens between two common ends) and links (the two tokens that end at one). Neither
tokenizer has a token across the place before a single space that stands after something else than a space and before something else than white space, so the merge runs
once for each distinct stretch between such places, and its result is kept in a memo that is bounded in bytes. Documents are taken together in chunks of ``CHUNK``
bytes; a chunk counts its distinct pairs, Spark's groupBy sums them over the corpus, takes the greatest count of each B id, and joins both back to the
chunks, where each document looks up its links. A frequent pair is one row for each chunk; adaptive joins split it.

Defined cases: null and empty texts, and texts whose joined tokens differ from a space and the text in A or in B (a literal U+2581 does), have no tokens: zeros and an empty text of groups. Rows with a null doc_id
and rows that repeat one are documents like any other; extra columns play no part. One document is held whole, in about 100 bytes for each of its tokens.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bpe import WORDS, byte_letters
from siltstone.llm.common import Scratch, as_bytes, slices

CHUNK = 4 << 20
#: Bytes of the memo of stretches in a worker (half of them in each of two generations), what an entry needs beside its own texts, and the longest stretch that is kept.
MEMO_BYTES, ENTRY_BYTES, LONGEST = 128 << 20, 250, 64
#: Where a stretch ends: between anything but a space, and a space with anything but white space behind it.
STRETCHES = re.compile(r"(?<=[^ ])(?= \S)")
#: A space that starts none.
LOOSE = re.compile(r" (?:\s|$)")


def merge(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> list[tuple[int, int]]:
    """Two pointers over the tokens of the same bytes: how many tokens of A and of B stand before each common end."""
    cuts, j, end_a, end_b = [], 0, 0, 0
    for i, x in enumerate(a, 1):
        end_a += size_a[x]
        while end_b < end_a:
            end_b += size_b[b[j]]
            j += 1
        if end_a == end_b:
            cuts.append((i, j))
    return cuts


class Aligner:
    """Both vocabularies, loaded once for each Python worker, and the memo of stretches (their space left out): text of the groups, pairs as a << 32 | b, number of
    tokens as a << 32 | b."""

    _loaded: dict[tuple[str, str], "Aligner"] = {}

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = {c: b for b, c in byte_letters().items()}
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["id"] for t in spec["added_tokens"]}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (1 + max(vocab.values()))
        for text, i in vocab.items():
            self.bytes_a[i] = text.encode() if i in added and any(c not in back for c in text) else bytes(back[c] for c in text)
        self.ranks = self._by_rank(spec, added)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        if any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size())):
            raise ValueError(f"{path_b} has pieces with a space behind other letters")
        self.size_a, self.size_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        self.text_a, self.text_b = [str(i) for i in range(len(self.bytes_a))], [str(i) for i in range(len(self.bytes_b))]
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.held = 0

    def _by_rank(self, spec: dict, added: set[int]):
        """A's words by the quicker library, where A is what that one can be told: single bytes, then one token for each merge in the order of ranks, and the usual words."""
        vocab, pre = spec["model"]["vocab"], spec["pre_tokenizer"]
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        plain = sorted((i, t) for t, i in vocab.items() if i not in added)
        by_rank = [t for _, t in plain[256:]] == made and [i for i, _ in plain] == list(range(len(plain))) and all(len(t) == 1 for _, t in plain[:256])
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or not by_rank:
            return None
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks={self.bytes_a[i]: i for i, _ in plain}, special_tokens={})

    @classmethod
    def of(cls, path_a: str, path_b: str) -> "Aligner":
        if (path_a, path_b) not in cls._loaded:
            cls._loaded[path_a, path_b] = cls(path_a, path_b)
        return cls._loaded[path_a, path_b]

    def aligned(self, stretch: str, a: list[int], b: list[int]) -> tuple | None:
        """What the memo holds of a stretch; None if the tokens are not its bytes."""
        data = stretch.encode()
        if b"".join([self.bytes_a[x] for x in a]) != data or b"".join([self.bytes_b[x] for x in b]) != data:
            return None
        groups, pairs, i, j, text_a, text_b = [], [], 0, 0, self.text_a, self.text_b
        for x, y in merge(a, b, self.size_a, self.size_b):
            groups.append((text_a[a[i]] if x - i == 1 else ",".join([text_a[t] for t in a[i:x]])) + "|" + (text_b[b[j]] if y - j == 1 else ",".join([text_b[t] for t in b[j:y]])))
            pairs.append(a[x - 1] << 32 | b[y - 1])
            i, j = x, y
        return ";".join(groups), array("q", pairs).tobytes(), len(a) << 32 | len(b)

    def _find(self, missing: list[str]) -> dict[str, tuple | None]:
        """What stretches give that the newer half of the memo does not have: from the older half, or encoded all together."""
        out = {s: hit for s in missing if (hit := self.old.get(s)) is not None}
        rest = [s for s in missing if s not in out]
        spaced = [" " + s for s in rest]
        ids_a = map(self.ranks.encode_ordinary, spaced) if self.ranks else (e.ids for e in self.a.encode_batch(spaced, add_special_tokens=False))
        for s, t, a, b in zip(rest, spaced, ids_a, self.b.encode(rest, num_threads=1) if rest else [], strict=True):
            out[s] = self.aligned(t, a, b)
        for s, found in out.items():
            if found is not None and len(s) <= LONGEST:
                if self.held >= MEMO_BYTES // 2:
                    self.old, self.new, self.held = self.new, {}, 0
                self.new[s] = found
                self.held += ENTRY_BYTES + 2 * len(s) + len(found[0]) + len(found[1])
        return out

    def documents(self, texts: list[str | None]) -> Iterator[tuple]:
        """(tokens of A, tokens of B, text of the groups, pairs) of each text."""
        cut = [stretches(t) if t else [] for t in texts]
        found = [list(map(self.new.get, parts)) for parts in cut]
        known = self._find(list(dict.fromkeys(s for parts, hits in zip(cut, found, strict=True) if None in hits for s, h in zip(parts, hits, strict=True) if h is None)))
        for parts, hits in zip(cut, found, strict=True):
            if None in hits:
                hits = [known[s] if h is None else h for s, h in zip(parts, hits, strict=True)]
            if not hits or None in hits:
                yield 0, 0, "", b""
                continue
            groups, pairs, counts = zip(*hits, strict=True)
            n = sum(counts)
            yield n >> 32, n & 0xFFFFFFFF, ";".join(groups), b"".join(pairs)


def stretches(text: str) -> list[str]:
    """The stretches of a space and the text, each without its first space."""
    text = " " + text
    if LOOSE.search(text):
        return [s[1:] for s in STRETCHES.split(text)]
    return text[1:].split(" ")  # every space starts a stretch


def align(docs: DataFrame, path_a: str, path_b: str, groups: bool = False) -> DataFrame:
    """docs (doc_id, text): (chunk, doc_id, n_a, n_b, n_groups, groups_sha256, links, pairs, times) and, if asked for, the text of the groups.

    links: for each link of a document its place among the distinct pairs of the chunk, from 0; pairs (a << 32 | b) and times, their number in
    the chunk, stand in the first row of each chunk only. The paths are the same on every executor.
    """
    schema = "chunk long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>, pairs array<long>, times array<long>" + (", groups string" if groups else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, base, held, size, n = Aligner.of(path_a, path_b), TaskContext.get().partitionId() << 32, [], 0, 0

        def chunk() -> pa.RecordBatch:
            ids, found = [i for x, _ in held for i in x], [r for _, x in held for r in x]
            n_a, n_b, texts, links = zip(*found, strict=True)
            count = np.array([len(x) // 8 for x in links])  # one link for each group
            pairs, local, times = np.unique(np.frombuffer(b"".join(links), np.int64), return_inverse=True, return_counts=True)
            at = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            first = np.concatenate([[0], np.full(len(found), len(pairs))]).astype(np.int32)
            others = pa.array(np.arange(len(found)) > 0)
            listed = lambda v: pa.ListArray.from_arrays(pa.array(first), pa.array(v.astype(np.int64)), mask=others)
            columns = [pa.array(np.full(len(found), base + n)), pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (n_a, n_b, count))]
            columns += [pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]), pa.ListArray.from_arrays(pa.array(at), pa.array(local.astype(np.int32))), listed(pairs), listed(times)]
            names = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "pairs", "times"]
            return pa.RecordBatch.from_arrays(columns + ([pa.array(texts)] if groups else []), names=names + (["groups"] if groups else []))

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            _, offsets = as_bytes(texts)
            for a, b in slices(offsets, CHUNK // 8):
                held.append((ids[a:b], list(aligner.documents(texts.slice(a, b - a).to_pylist()))))
                size += int(offsets[b] - offsets[a]) + 64 * (b - a)
                if size >= CHUNK:
                    yield chunk()
                    held, size, n = [], 0, n + 1
        if held:
            yield chunk()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best) over the corpus: best if no other pair of its B id has a higher count."""
    each = aligned.where(F.col("pairs").isNotNull()).select(F.inline(F.arrays_zip("pairs", "times")))
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def link_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its B id), count_sum (of the corpus-wide counts of all links) and groups_sha256."""
    work = Scratch(docs.sparkSession, "alignment")
    aligned = work.table(align(docs, path_a, path_b), "aligned")
    counts = work.table(pair_counts(aligned), "counts")
    each = aligned.where(F.col("pairs").isNotNull()).select("chunk", F.posexplode("pairs").alias("at", "pair"))
    told = each.join(counts, "pair").select(F.col("chunk").alias("of"), "at", "count", "best")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def look_up(documents: pa.Table, told: pa.Table) -> pa.Table:
        count, best = np.zeros(told.num_rows, np.int64), np.zeros(told.num_rows, np.int64)
        at = told.column("at").to_numpy()
        count[at], best[at] = told.column("count").to_numpy(), told.column("best").to_numpy().astype(np.int64)
        links = documents.column("links").combine_chunks()
        ends, local = links.offsets.to_numpy(), links.flatten().to_numpy()
        ends = ends - ends[0]
        total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v[local])])[ends])
        new = {"n_links": np.diff(ends).astype(np.int64), "n_best": total(best), "count_sum": total(count)}
        columns = [documents.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")] + [pa.array(v) for v in new.values()] + [documents.column("groups_sha256")]
        return pa.table(columns, names=["doc_id", "n_a", "n_b", "n_groups", *new, "groups_sha256"])

    rows = aligned.select("chunk", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    return rows.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(look_up, out)
