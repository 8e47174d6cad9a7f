"""Fill-in-middle transformation: a document is cut into prefix, middle and suffix at unit boundaries and reordered.

A unit is a run of ASCII letters or any other single code point. A document's
text is laid out in fixed blocks of code points; a Fenwick tree over the blocks
stores how many units start in each block and how many code points it holds. A
cut after ``k`` units is found by a binary-lifting descent of the tree to the
block in which unit ``k`` starts, and then inside that block alone.

Cuts, form and order come from the SHA-256 of ``seed:id``, so a document is
transformed alike on every run, whatever its partition. Documents are
independent of each other: there is no shuffle, and a task holds one Arrow
batch of texts at a time. The document is read whole, whatever its length; the
tree keeps two numbers a block.

``restored`` undoes the transformation from the output and its form alone. Texts
that hold a sentinel stay plain, so that the output can be split at them.

Edge cases: a null text is empty and plain with no unit; a null id counts as the
empty text in the hash; repeated rows are transformed alike; an empty table gives
an empty result; columns of the input that bear a name of the result are replaced,
others are kept.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAIN, PSM, SPM = "plain", "psm", "spm"
BLOCK = 1024  # code points

RESULT = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


@dataclass(frozen=True)
class FimSpec:
    """Sentinels, shares (in hundredths) and the seed of the cuts."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    fim_percent: int = 90
    spm_percent: int = 20
    seed: int = 1

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) != 3 or any(len(m) < 3 or m[0] != "<" or m[-1] != ">" or set(m[1:-1]) & set("<>") for m in marks):
            raise ValueError("sentinels are three different <name> marks")


DEFAULT = FimSpec()


class BlockTree:
    """Fenwick tree over blocks: sums of units and of code points."""

    def __init__(self, units: np.ndarray, chars: np.ndarray):
        size = len(units)
        self.size, self.units, self.chars = size, [0, *units.tolist()], [0, *chars.tolist()]
        for i in range(1, size + 1):
            up = i + (i & -i)
            if up <= size:
                self.units[up] += self.units[i]
                self.chars[up] += self.chars[i]
        self.top = 1 << size.bit_length() >> 1 if size else 0

    def total_units(self) -> int:
        i, out = self.size, 0
        while i:
            out += self.units[i]
            i &= i - 1
        return out

    def block_of(self, k: int) -> tuple[int, int, int]:
        """(block, units before it, code points before it) of the block in which unit ``k``, from 0, starts."""
        at = units = chars = 0
        step = self.top
        while step:
            to = at + step
            if to <= self.size and units + self.units[to] <= k:
                at, units, chars = to, units + self.units[to], chars + self.chars[to]
            step >>= 1
        return at, units, chars


class UnitIndex:
    """Where the units of one text start, found block by block."""

    def __init__(self, text: str, block: int = BLOCK):
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        letter = (codes | 32) - np.uint32(97) < 26
        self.starts = ~letter
        self.starts[:1] = True
        self.starts[1:] |= ~letter[:-1]
        self.length, self.block = len(codes), block
        cuts = np.arange(0, len(codes), block)
        units = np.add.reduceat(self.starts, cuts, dtype=np.int64) if len(codes) else cuts
        self.tree = BlockTree(units, np.diff(np.append(cuts, len(codes))))
        self.n = self.tree.total_units()

    def cut_after(self, k: int) -> int:
        """Code points of the first ``k`` units."""
        if k >= self.n:
            return self.length
        _, units, chars = self.tree.block_of(k)
        inside = np.flatnonzero(self.starts[chars : chars + self.block])
        return chars + int(inside[k - units])


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{key}".encode()).digest()[:16])


def fill_middle(key: str, text: str, spec: FimSpec = DEFAULT, block: int = BLOCK) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    h1, h2, h3, h4 = draws(spec.seed, key)
    index = UnitIndex(text, block)
    if not text or h3 % 100 >= spec.fim_percent or any(m in text for m in (spec.prefix, spec.suffix, spec.middle)):
        return index.n, PLAIN, None, None, text
    a, b = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    a, b = index.cut_after(a), index.cut_after(b)
    first, middle, last = spec.prefix + text[:a], spec.middle + text[a:b], spec.suffix + text[b:]
    form = SPM if h4 % 100 < spec.spm_percent else PSM
    return index.n, form, a, b - a, (last + first if form == SPM else first + last) + middle


def transformed(docs: DataFrame, spec: FimSpec = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output."""

    @F.pandas_udf(RESULT)
    def cut(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [fill_middle(k, t, spec) for k, t in zip(keys, texts)]
        out = pd.DataFrame(rows, columns=RESULT.names)
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    empty = F.lit("")
    done = cut(F.coalesce(F.col(id_col).cast("string"), empty), F.coalesce(F.col(text_col).cast("string"), empty))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in RESULT.names]
    inner = docs.select(*kept, done.alias("__fim"))
    return inner.select(*kept, *[F.col(f"__fim.{c}").alias(c) for c in RESULT.names])


def restored(output: Column, form: Column, spec: FimSpec = DEFAULT) -> Column:
    """The document's text, from the output and its form alone."""
    marks = "|".join((spec.prefix, spec.suffix, spec.middle))
    parts = F.split(output, marks, -1)  # [empty, first, second, middle]
    first, second, middle = parts[1], parts[2], parts[3]
    return (
        F.when(form == PSM, F.concat(first, middle, second))
        .when(form == SPM, F.concat(second, middle, first))
        .otherwise(output)
    )


def digests(done: DataFrame, spec: FimSpec = DEFAULT) -> DataFrame:
    """What the registered query returns, the text rebuilt from the output."""
    back = restored(F.col("output"), F.col("form"), spec)
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )
