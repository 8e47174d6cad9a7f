"""Best-fit packing: documents are tokenised, cut at the sequence length and packed into sequences by vector best-fit.

Every open sequence has residual capacities: tokens, documents and attention cost
(the sum of squared piece lengths). A piece goes, among the sequences where every
constraint leaves room, to the one with the smallest weighted norm of what would
be left (``rule="norm"``) or the largest weighted dot-product of demand and
residual (``rule="dot"``); if none has room, to a new one. Pieces are taken in
descending length.

Scale: pieces are dealt evenly, by a hash of their row number, to bins of about
``shard_rows`` pieces; each bin is packed in one task of bounded memory, and only
its last sequences can be ill filled, so the loss is a constant per bin. Texts
are tokenised once and never shuffled: only ids' checksums and lengths are.

Edge cases: a null text is empty and packs as its end token alone; only documents
longer than a sequence are cut; repeated rows are packed as often as they occur;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

END_ID = 1
SHARD_ROWS = 16_384
CACHE_WORDS = 600_000
_SHARD_SPAN = 1 << 24

# Characters for which lower-casing and splitting in Python equal the tokenizer's own; other words go to the tokenizer whole.
_SAFE = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
# Fixed value: the word pattern of the vocabulary file, over the safe characters.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


@dataclass(frozen=True)
class Capacity:
    """Limits of one sequence. The default document and attention limits never bind before the tokens do."""

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], dtype=np.int64)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for 256 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """Ids by word; a word that is not there yet is encoded."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.encode(word)
        return ids


class WordTokenizer:
    """Token ids (little-endian uint32 bytes) of whole texts through a bounded cache of blank-separated words.

    The vocabulary drops white space and never joins across it, so a text's ids are its words' ids in order.
    """

    def __init__(self, vocabulary_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary_json)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words = _Words(self._word)
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            spelled = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            ids = _as_bytes([t.id for t in self.model.tokenize(spelled)])
            self.parts[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if "<|" in word or not _SAFE.fullmatch(word):  # special tokens and other scripts: by the tokenizer itself
            return _as_bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)
        low = word.lower()
        return self._part(low) if low.isalpha() else b"".join(map(self._part, _WORD.findall(low)))

    def ids(self, text: str) -> bytes:
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if len(self.parts) > CACHE_WORDS:
            self.parts.clear()
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.words.__getitem__, words))


_loaded: dict[int, WordTokenizer] = {}


def pieces(docs: DataFrame, vocabulary: str, tokens: int = 4096, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and ``end_id``, cut into pieces of ``tokens``."""
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = zlib.crc32(shared.value.encode())
        tok = _loaded.get(key) or _loaded.setdefault(key, WordTokenizer(shared.value))
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = tok.ids(text) + end
                for k, s in enumerate(range(0, len(ids), 4 * tokens)):
                    part = ids[s : s + 4 * tokens]
                    rows.append((None if pd.isna(doc_id) else int(doc_id), k, s // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: Capacity = Capacity()) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece of one shard."""
    full = capacity.vector()
    demand = np.column_stack([lengths, np.ones_like(lengths), lengths.astype(np.int64) ** 2]).astype(np.int64)
    if len(lengths) and (demand.max(axis=0) > full).any():
        raise ValueError("a piece exceeds the capacity of an empty sequence")
    scale = np.asarray(capacity.weights) / full.astype(float) ** 2
    which, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    size = max(16, len(lengths))
    left = np.empty((3, size), np.int64)  # residuals of the open bins, a row for each constraint
    names = np.empty(size, np.int64)
    n_open = n_bins = 0
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    least = int(lengths.min()) if len(lengths) else 0
    for i in order:
        need = demand[i]
        now = left[:, :n_open]
        room = np.flatnonzero((now[0] >= need[0]) & (now[1] >= need[1]) & (now[2] >= need[2]))
        if len(room):
            at = now[:, room].astype(float)
            value = scale @ (at - need[:, None]) ** 2 if capacity.rule == "norm" else -((need * scale) @ at)
            b = room[int(np.argmin(value))]
        else:
            b, n_open = n_open, n_open + 1
            left[:, b], names[b], n_bins = full, n_bins, n_bins + 1
        which[i], offset[i] = names[b], full[0] - left[0, b]
        left[:, b] -= need
        if left[0, b] < least or left[1, b] < 1:  # nothing fits any more
            n_open -= 1
            left[:, b], names[b] = left[:, n_open], names[n_open]
    return which, offset


def pack(cut: DataFrame, capacity: Capacity = Capacity(), shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``cut`` (a written table of pieces) with sequence_id and offset."""
    shards = max(1, -(-cut.count() // shard_rows))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        which, offset = best_fit(pdf["length"].to_numpy(np.int64), capacity)
        return pdf.drop(columns="shard").assign(sequence_id=which + int(key[0]) * _SHARD_SPAN, offset=offset)

    return dealt.groupBy("shard").applyInPandas(fit, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: Capacity = Capacity(), shard_rows: int = SHARD_ROWS) -> DataFrame:
    return pack(stage(pieces(docs, vocabulary, capacity.tokens), "pieces"), capacity, shard_rows)
