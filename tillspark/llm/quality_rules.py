"""Quality classifier: a sparse rule ensemble over text statistics.

1. Statistics of the whole text are Spark column expressions (``statistics``).
2. Shallow trees are grown on a bounded sample of labelled rows; every path from
   a root to a node becomes a conjunctive rule such as ``upper > 0.4 AND unique <= 0.8``.
3. A lasso logistic regression weighs the rules; most weights become zero.
4. The rules that remain are compiled to one Spark column expression, so scoring
   is a projection: no shuffle, no model object, no Python on the executors.

Bound of the fit: ``max_rows`` labelled rows (all statistics read whole texts).

Edge cases: a null text is empty; an empty text has zero statistics and still
gets a score; if the sample holds one class only, every score is that class's
smoothed share; an empty table gives an empty result; repeated rows are scored
alike; other columns (label, lang, source, id) never enter a score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .training import labelled_sample

MAX_ROWS = 20_000
TREES, DEPTH = 10, 3
LASSO = 0.0005
KEEP_AT = 0.7

# Characters counted by the statistics.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
SYMBOLS = "#$%&*@^~|<>{}[]=+_\\/"
MARKS = ".,;:!?"
DIGITS = "0123456789"

STATS = ("log_chars", "word_chars", "upper", "symbols", "marks", "shouts", "digits", "unique", "repeats", "line_chars", "lines_unique", "long_words", "spaces")


def _count(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def statistics(text: str) -> dict[str, Column]:
    """Column expressions over the text column of that name; shares are of characters unless said otherwise."""
    t = F.col(text)
    n = F.greatest(F.char_length(t), F.lit(1)).cast("double")
    words = F.filter(F.split(F.translate(F.lower(t), "\n\t\r", "   "), " "), lambda w: w != "")
    lines = F.split(t, "\n")
    n_words = F.greatest(F.size("_words"), F.lit(1)).cast("double")
    n_lines = F.greatest(F.size("_lines"), F.lit(1)).cast("double")
    return {
        "_words": words,
        "_lines": lines,
        "log_chars": F.log1p(F.char_length(t).cast("double")),
        "word_chars": F.char_length(t) / n_words,
        "upper": _count(t, UPPER) / n,
        "symbols": _count(t, SYMBOLS) / n,
        "marks": _count(t, MARKS) / n,
        "shouts": _count(t, "!?") / n,
        "digits": _count(t, DIGITS) / n,
        "unique": F.size(F.array_distinct("_words")) / n_words,  # share of words
        "repeats": F.size(F.filter("_words", lambda w, i: w == F.get("_words", i + 1))) / n_words,  # share of words that the next one repeats
        "line_chars": F.log1p(n / n_lines),
        "lines_unique": F.size(F.array_distinct("_lines")) / n_lines,  # share of lines
        "long_words": F.size(F.filter("_words", lambda w: F.char_length(w) > 20)) / n_words,  # share of words
        "spaces": _count(t, " \t\n") / n,
    }


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    cols = statistics(text)
    base = docs.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    base = base.withColumns({k: cols[k] for k in ("_words", "_lines")})
    return base.withColumns({k: cols[k].cast("double") for k in STATS}).drop("_words", "_lines")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, '<=' or '>', threshold)."""

    terms: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, cut in self.terms:
            out = out & (F.col(name) <= cut if op == "<=" else F.col(name) > cut)
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{n} {op} {c!r}" for n, op, c in self.terms)


def tree_paths(debug: str, names: tuple[str, ...] = STATS) -> list[Rule]:
    """Every root-to-node path of every tree in a Spark tree model's printed form."""
    rules: dict[Rule, None] = {}
    path: list[tuple[int, tuple[str, str, float]]] = []
    for line in debug.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, (names[int(m[2])], m[3], float(m[4]))))
        tight: dict[tuple[str, str], float] = {}
        for _, (name, op, cut) in path:  # a statistic that is split twice keeps its tighter bound
            have = tight.get((name, op))
            tight[name, op] = cut if have is None else min(have, cut) if op == "<=" else max(have, cut)
        rules[Rule(tuple(sorted((n, op, c) for (n, op), c in tight.items())))] = None
    return list(rules)


@dataclass(frozen=True)
class RuleModel:
    bias: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Probability of label 1 as an expression over the statistics."""
        z = F.lit(self.bias)
        for rule, weight in self.weights:
            z = z + F.when(rule.column(), weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 4, fold: int = 2, max_rows: int = MAX_ROWS, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    sample = stage(with_statistics(labelled_sample(docs, labels, label, mod, fold, max_rows)).select("label", *STATS), "quality-sample")
    shares = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, total = shares.get(1.0, 0), sum(shares.values())
    if not 0 < ones < total:
        return RuleModel(math.log((ones + 1) / (total - ones + 1)), ())
    data = VectorAssembler(inputCols=list(STATS), outputCol="x").transform(sample).select("label", "x").coalesce(4).cache()
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="0.6", seed=1).fit(data)
    data.unpersist()
    rules = tree_paths(forest.toDebugString)
    if not rules:
        return RuleModel(math.log((ones + 1) / (total - ones + 1)), ())
    flags = [f"r{i}" for i in range(len(rules))]
    as_flags = sample.select("label", *(r.column().cast("double").alias(c) for r, c in zip(rules, flags)))
    ruled = VectorAssembler(inputCols=flags, outputCol="x").transform(as_flags).select("label", "x").coalesce(2).cache()
    lr = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(ruled)
    ruled.unpersist()
    weights = [(r, float(w)) for r, w in zip(rules, lr.coefficients.toArray()) if abs(w) > 1e-6]
    return RuleModel(float(lr.intercept), tuple(weights))


def score(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``score``; columns of ``docs`` named like a statistic are left alone."""
    packed = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    return with_statistics(packed, "_text").select("_row.*", model.score().alias("score"))


def accepted(docs: DataFrame, model: RuleModel, keep_at: float = KEEP_AT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least ``keep_at``.

    The row is made by a generator over its own score: a plain filter would be pushed below the
    projections, and every rule would compute its statistics anew.
    """
    packed = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    scored = with_statistics(packed, "_text").select("_row", model.score().alias("score"))
    return scored.select("_row", F.explode(F.filter(F.array("score"), lambda s: s >= keep_at))).select("_row.*")


def classify(docs: DataFrame, model: RuleModel, mod: int = 4, fold: int = 2, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    from .training import in_fold

    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", in_fold(F.col("doc_id"), mod, fold).alias("held_out"), "score", (F.col("score") >= keep_at).cast("int").alias("predicted"))
