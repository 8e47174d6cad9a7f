"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding makes spellings meet: case, look-alike letters of other scripts, full-width
forms and accents fold to plain letters, and digits or signs that stand for letters
(0 for o, 1 for i, ...) fold to them; the lexicon is folded alike. One automaton
holds the terms and the exception phrases. A term counts where it starts a word
and, unless it is a stem, ends one; it does not count inside an exception phrase.
The weights of all hits are summed, divided by the length in words (plus a
constant), and a logistic curve turns that into a score.

The lexicon (words and word stems over-represented in toxic documents), the
exceptions (phrases around terms that occur in clean documents only) and the
curve are learned from a bounded sample of labelled rows (``max_rows``).

Edge cases: a null text is empty; an empty text has no hit and the lowest score;
with no toxic label the lexicon is empty and every score is the lowest; an empty
table gives an empty result; repeated rows score alike; texts are read whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage
from .training import in_fold, labelled_sample

MAX_ROWS = 20_000
MAX_TERMS = 5_000
PAD_WORDS = 50.0
FLAG_AT = 0.7
MIN_DOCS = 3
STEM_CHARS = (4, 5, 6)

# Look-alike letters of other scripts, and signs written for letters.
CYRILLIC = dict(zip("абвгдезийкмнорстухіјѕһԁԛԝёєӏ", "abbrdeenukmhopctyxijshdqweel"))
GREEK = dict(zip("αβγδεζηικμνορστυχω", "abydezhikuvoprtuxw"))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "l": "i", "ł": "i", "ı": "i"}


def _plain(ch: str) -> str | None:
    base = unicodedata.normalize("NFKD", ch)[0]
    return base.lower() if base.isascii() and base.isalpha() else None


def _fold_table() -> dict[str, str]:
    """One character to one character: accented Latin and full-width forms by decomposition, the rest from the fixed values."""
    ranges = [range(0xC0, 0x250), range(0x1E00, 0x1F00), range(0xFF21, 0xFF5B), range(0x1D400, 0x1D6A4)]
    table = {chr(c): p for r in ranges for c in r if (p := _plain(chr(c)))}
    for letters in (CYRILLIC, GREEK):
        table |= letters | {k.upper(): v for k, v in letters.items() if len(k.upper()) == 1}
    table |= {chr(c): chr(c).lower() for c in range(65, 91)} | SIGNS
    return {k: SIGNS.get(v, v) for k, v in table.items()}


FOLD = _fold_table()
_FOLD_ORD = str.maketrans(FOLD)
_GAP = re.compile(r"[^a-z0-9ß-\U0010ffff]+")
_HIDDEN = re.compile("[­​-‏⁠﻿̀-ͯ]")
_EDGE_SIGNS = re.compile(r"[@$€]+(?![^\W_])")


def fold(text: str) -> str:
    """Folded text: words of folded letters between single spaces, with a space at either end."""
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    if "@" in text or "$" in text or "€" in text:
        text = _EDGE_SIGNS.sub(" ", text)  # a sign that no letter follows is not a letter
    return " " + _GAP.sub(" ", text.translate(_FOLD_ORD).lower()).strip() + " "


@dataclass(frozen=True)
class Lexicon:
    """terms: folded text with a leading space, a trailing one for whole words; exceptions: folded phrases."""

    terms: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    bias: float = -4.0


def automaton(lexicon: Lexicon):
    import ahocorasick

    out = ahocorasick.Automaton()
    entries: dict[str, list] = {}
    for term, weight in lexicon.terms:
        entries.setdefault(term, [len(term), 0.0, False])[1] += weight
    for phrase in lexicon.exceptions:
        entries.setdefault(phrase, [len(phrase), 0.0, False])[2] = True
    for key, value in entries.items():
        out.add_word(key, tuple(value))
    out.make_automaton()
    return out


def hits(machine, folded: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of each counted hit; of hits that start at one place the heaviest counts."""
    if not len(machine):
        return []
    found: dict[int, tuple[int, float]] = {}
    shields: list[tuple[int, int]] = []
    for last, (size, weight, exception) in machine.iter(folded):
        start = last + 1 - size
        if exception:
            shields.append((start, last + 1))
        if weight and weight > found.get(start, (0, 0.0))[1]:
            found[start] = (last + 1, weight)
    shields.sort()
    out, reach, k = [], -1, 0
    for s, (e, w) in sorted(found.items()):  # one sweep over both: how far the shields reach that start at or before a hit
        while k < len(shields) and shields[k][0] <= s:
            reach = max(reach, shields[k][1])
            k += 1
        if e > reach:
            out.append((s, e, w))
    return out


def density(machine, text: str | None) -> tuple[float, float]:
    """Summed weight and the length-normalised feature of one text."""
    folded = fold(text or "")
    total = sum(w for _, _, w in hits(machine, folded))
    return total, math.log1p(1000.0 * total / (folded.count(" ") - 1 + PAD_WORDS))


def _words_of(sample: DataFrame) -> DataFrame:
    """(word, toxic, clean): numbers of sample documents of either label that hold the folded word."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(set(fold(t).split())))

    each = sample.select("label", F.explode(words("text")).alias("word"))
    return each.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(F.lit(1) - F.col("label")).alias("clean"))


def _weighed(counts: DataFrame, toxic_docs: float, clean_docs: float, min_docs: int, least: float) -> DataFrame:
    rate_t = (F.col("toxic") + 0.5) / F.lit(toxic_docs + 1.0)
    rate_c = (F.col("clean") + 0.5) / F.lit(clean_docs + 1.0)
    return counts.withColumn("weight", F.log(rate_t / rate_c)).where((F.col("toxic") >= min_docs) & (F.col("weight") >= least))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 3, fold_no: int = 1, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> Lexicon:
    sample = stage(labelled_sample(docs, labels, label, mod, fold_no, max_rows).select("label", "text"), "toxicity-sample")
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic_docs, clean_docs = float(n.get(1.0, 0)), float(n.get(0.0, 0))
    if not toxic_docs:
        return Lexicon(())
    words = stage(_words_of(sample), "toxicity-words")
    least = math.log(8.0)
    whole = _weighed(words, toxic_docs, clean_docs, MIN_DOCS, least).orderBy(F.desc("weight"), "word").limit(max_terms).select("word", "weight").collect()
    terms = {f" {r['word']} ": r["weight"] for r in whole}
    stems = None
    for size in STEM_CHARS:
        part = words.where(F.char_length("word") > size).groupBy(F.substring("word", 1, size).alias("word")).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count_if(F.col("toxic") > 0).alias("forms"))
        stems = part if stems is None else stems.unionByName(part)
    # A stem stands for a family: several forms in toxic documents and next to none in clean ones.
    family = _weighed(stems.where("forms >= 3 AND clean * 20 <= toxic"), toxic_docs, clean_docs, 2 * MIN_DOCS, least)
    for r in family.orderBy(F.desc("weight"), "word").limit(max_terms).select("word", "weight").collect():
        terms[f" {r['word']}"] = r["weight"]
    lexicon = Lexicon(tuple(sorted(terms.items())))
    return _calibrated(sample, lexicon, _exceptions(sample, lexicon))


def _exceptions(sample: DataFrame, lexicon: Lexicon, least: int = MIN_DOCS) -> tuple[str, ...]:
    """Phrases of a term with a neighbouring word that ``least`` clean documents hold and no toxic one."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton(lexicon)
        for pdf in batches:
            out: Counter = Counter()
            for label, text in zip(pdf["label"], pdf["text"]):
                folded, mine = fold(text), set()
                for s, e, _ in hits(machine, folded):
                    end = folded.find(" ", e - 1) + 1
                    after, before = folded.find(" ", end) + 1, folded.rfind(" ", 0, s)
                    mine.add(folded[s:end])
                    if after > end:
                        mine.add(folded[s:after])
                    if before >= 0:
                        mine.add(folded[before:end])
                out.update((p, label) for p in mine)
            yield pd.DataFrame([(p, label, c) for (p, label), c in out.items()], columns=["phrase", "label", "n"])

    rows = sample.mapInPandas(near, "phrase string, label double, n long")
    only_clean = rows.groupBy("phrase").agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    picked = only_clean.where(f"clean >= {least} AND toxic = 0").orderBy(F.desc("clean"), "phrase").limit(MAX_TERMS).collect()
    return tuple(r["phrase"] for r in picked)


def _calibrated(sample: DataFrame, lexicon: Lexicon, exceptions: tuple[str, ...]) -> Lexicon:
    """Logistic curve over the feature, fitted by Newton steps on the sample's (feature, label) pairs."""
    lexicon = Lexicon(lexicon.terms, exceptions)
    pairs = features(sample, lexicon).select("feature", "label").toPandas()  # at most max_rows pairs of numbers
    x, y = pairs["feature"].to_numpy(float), pairs["label"].to_numpy(float)
    a = np.column_stack([x, np.ones_like(x)])
    w, ridge = np.array([0.0, 0.0]), np.diag([1e-2, 1e-3])
    for _ in range(40):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
    return Lexicon(lexicon.terms, exceptions, max(float(w[0]), 1e-6), float(w[1]))


def features(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``docs`` with ``toxic_weight`` (summed weights) and ``feature`` (normalised by length)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most 3 * MAX_TERMS short strings
    kind = T.StructType([T.StructField("toxic_weight", T.DoubleType()), T.StructField("feature", T.DoubleType())])

    @F.pandas_udf(kind)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = automaton(shared.value)
        for texts in batches:
            yield pd.DataFrame([density(machine, t) for t in texts], columns=["toxic_weight", "feature"])

    return docs.withColumn("_m", measure(F.coalesce(F.col(text), F.lit("")))).withColumn("toxic_weight", F.col("_m.toxic_weight")).withColumn("feature", F.col("_m.feature")).drop("_m")


def score_of(feature: Column, lexicon: Lexicon) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(feature * lexicon.slope + lexicon.bias)))


def classify(docs: DataFrame, lexicon: Lexicon, mod: int = 3, fold_no: int = 1, flag_at: float = FLAG_AT) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_weight for every row."""
    scored = features(docs.select("doc_id", "text"), lexicon).withColumn("score", score_of(F.col("feature"), lexicon))
    return scored.select("doc_id", in_fold(F.col("doc_id"), mod, fold_no).alias("held_out"), "score", (F.col("score") >= flag_at).cast("int").alias("predicted"), "toxic_weight")
