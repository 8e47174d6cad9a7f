"""Benchmark decontamination: pigeonhole edit matching.

An occurrence of a test item with at most e edits, cut into e + 1 pieces, holds at
least one piece unchanged. So each item is split into e + 1 pieces (e is a share of
its length), one Aho-Corasick automaton finds exact piece hits in a document, and
the hits' neighbourhoods, joined where they meet, are verified with Myers'
bit-parallel edit distance, each once.

Texts are compared in lower case with every white-space character as a blank;
spans are code-point offsets into the document's own text.

Scale: documents are read once per block of items and never shuffled. Items are
broadcast in blocks of at most ``block_chars`` characters; one block is the rule.

Edge cases: a null text or item is empty; an empty item matches nothing; an item
shorter than 1 / rate characters has no error budget and must not start or end
inside a word; equal items and repeated
rows are reported each; empty tables give empty results; extra columns are kept
by ``without_items`` and ignored by ``matches``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERROR_RATE = 0.05
BLOCK_CHARS = 8_000_000


def normal(text: str | None) -> str:
    """Lower case and blanks for white space, character by character, so that offsets stay."""
    text = text or ""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    if low.isascii():
        return low.translate(_BLANKS)
    return "".join(" " if c.isspace() else c for c in low) if any(map(low.__contains__, _WIDE)) else low.translate(_BLANKS)


_BLANKS = str.maketrans({c: " " for c in "\t\n\v\f\r\x1c\x1d\x1e\x1f"})
_WIDE = [c for c in map(chr, range(0x80, 0x3001)) if c.isspace()]


def budget(item: str, rate: float) -> int:
    return int(len(item) * rate)


def split_pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of nearly equal length that cover the item."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, window: str, errors: int) -> tuple[int, int]:
    """(distance, end) of the best occurrence of ``item`` in ``window``, the first of equals; distance > errors if none."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = errors + 1, -1
    for j, c in enumerate(window):
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full  # an occurrence may start anywhere
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Items of one block, their pieces in one automaton."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, budget(t, rate)) for i, t in ((i, normal(t).strip()) for i, t in items) if t]
        self.machine = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, errors) in enumerate(self.items):
            for at, piece in split_pieces(text, errors):
                where.setdefault(piece, []).append((k, at))
        for piece, places in where.items():
            self.machine.add_word(piece, (len(piece), places))
        self.machine.make_automaton()

    def find(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item_id, distance, start, end): the best occurrence of each item that the text holds within its budget."""
        if not self.items or not text:
            return []
        low = normal(text)
        found: dict[int, tuple[int, int, int]] = {}
        begins: dict[int, set[int]] = {}  # where each item may start if no edit lies before the piece hit
        for last, (size, places) in self.machine.iter(low):
            for k, at in places:
                if k in found:
                    continue
                begin = last + 1 - size - at
                seen = begins.setdefault(k, set())
                if begin in seen:
                    continue
                _, item, errors = self.items[k]
                if begin >= 0 and low.startswith(item, begin) and (errors or _on_edges(low, begin, begin + len(item))):
                    found[k] = (0, begin, begin + len(item))
                elif errors:
                    seen.add(begin)
        for k, places in begins.items():
            _, item, errors = self.items[k]
            if k in found or not errors:
                continue
            for lo, hi in _windows(sorted(places), len(item), errors, len(low)):
                distance, end = myers(item, low[lo:hi], errors)
                if distance <= errors and distance < found.get(k, (errors + 1,))[0]:
                    back, length = myers(item[::-1], low[lo : lo + end][::-1], errors)
                    found[k] = (distance, lo + end - length, lo + end)
        return [(self.items[k][0], *found[k]) for k in sorted(found)]


def _on_edges(text: str, start: int, end: int) -> bool:
    """Whether a span neither starts nor ends inside a word."""
    return not (start and text[start - 1].isalnum() and text[start].isalnum() or text[end : end + 1].isalnum() and text[end - 1].isalnum())


def _windows(begins: list[int], size: int, errors: int, length: int) -> Iterator[tuple[int, int]]:
    """[lo, hi) around the possible starts of one item; windows that meet are one, so that each place is read once."""
    lo = hi = None
    for begin in begins:
        a, b = max(0, begin - errors), min(length, begin + size + errors)
        if hi is not None and a <= hi:
            hi = max(hi, b)
            continue
        if hi is not None:
            yield lo, hi
        lo, hi = a, b
    if hi is not None:
        yield lo, hi


def blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """The items in driver-sized blocks; the size is checked first."""
    rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    chars = rows.agg(F.coalesce(F.sum(F.char_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-chars // block_chars))
    for b in range(n):
        yield [(r["item_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]


def matches(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, start, end: one row per document row and item that it holds."""
    out = None
    for block in blocks(items, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(sorted(block, key=str))

        def find(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            matcher = Matcher(shared.value, rate)
            for pdf in batches:
                rows = [(None if pd.isna(d) else int(d), *hit) for d, t in zip(pdf["doc_id"], pdf["text"]) for hit in matcher.find(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "start", "end"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        part = docs.select("doc_id", "text").mapInPandas(find, "doc_id long, item_id long, distance int, start long, end long")
        out = part if out is None else out.unionAll(part)
    return out


def without_items(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; a filter, without a join."""
    for block in blocks(items, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(sorted(block, key=str))
        docs = docs.where(~_held(shared, rate)(F.coalesce(F.col("text"), F.lit(""))))
    return docs


def _held(shared, rate: float):
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value, rate)
        for texts in batches:
            yield texts.map(lambda t: bool(matcher.find(t)), na_action=None).astype(bool)

    return F.pandas_udf(held, T.BooleanType())
