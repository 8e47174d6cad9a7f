"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets verify them.

1. Every text becomes its set of hashed word n-grams. Texts with equal sets form one
   class; one representative goes on, so copies are never paired with each other.
2. MinHash signatures are cut into bands; band and row counts follow from the target
   recall at the threshold (``banding``). Representatives shuffle on their band hashes.
3. Representatives that share a band hash are joined into candidate components (a chain
   of links through each bucket's least member, never all pairs of a bucket).
4. Each component's texts meet once and every pair inside it is verified on the full
   sets. A component is dealt to tasks in blocks of bounded size, block against block,
   so a component of any size is spread; a task returns counts of links and a spanning
   forest, never its pairs.
5. Verified links give each document its number of links and its class id: the least
   id of the documents that links connect it to.

A document links to every other document row whose Jaccard similarity with it is at
least ``threshold``; equal sets link too. Words are lower-cased and split at white space.

Edge cases: a null text is empty; an empty text has no n-gram, links to nothing and is a
class of its own; a text of fewer than n words is one n-gram of all its words; repeated
rows and repeated ids are rows of their own (links count rows, a class id may be shared);
null ids come last as class ids; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, doc_key, mix64, prefix_hash, span_hash, stage

N_WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
ROWS = 6
BLOCK_GRAMS = 150_000
BLOCK_SETS = 1_500  # a block's pairs are a matrix of this side, whatever the texts' lengths
_LAST = (1 << 63) - 1


def banding(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``rows`` rows that find a pair at the threshold with that probability."""
    return math.ceil(math.log(1.0 - recall) / math.log(1.0 - threshold**rows)), rows


_GRAM_BITS = U64(44)


def grams(texts: list[str], n: int = N_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct n-gram hashes of text i, ascending, are hashes[bounds[i]:bounds[i + 1]]; at most 2**20 texts."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])  # just behind each text's blank
    gap = data <= 32
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1  # words start and stop in turn
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    start, stop = edge[0::2], edge[1::2]
    start = start[: len(stop)]
    words = span_hash(prefix_hash(data), start, stop)
    count = np.diff(np.concatenate(([0], np.searchsorted(start, ends))))
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    k = np.minimum(count, n)  # words in each of a text's n-grams
    per = np.where(count > 0, count - k + 1, 0)
    owner = np.repeat(np.arange(len(texts)), per)
    at = np.arange(len(owner)) + np.repeat(first - np.concatenate(([0], np.cumsum(per)[:-1])), per)
    key = span_hash(prefix_hash(words), at, at + k[owner]) >> (U64(64) - _GRAM_BITS)
    key |= owner.astype(U64) << _GRAM_BITS
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    bounds = np.searchsorted(key, np.arange(len(texts) + 1).astype(U64) << _GRAM_BITS)
    return key & ((U64(1) << _GRAM_BITS) - U64(1)), bounds


def set_ids(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Non-negative 63-bit name of each n-gram set, from two sums of mixed hashes; empty sets get 0."""
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, U64), np.cumsum(mix64(hashes), dtype=U64)))
        other = np.concatenate((np.zeros(1, U64), np.cumsum(mix64(hashes ^ U64(0xD6E8FEB86659FD93)), dtype=U64)))
        a, b = total[bounds[1:]] - total[bounds[:-1]], other[bounds[1:]] - other[bounds[:-1]]
        name = mix64(a ^ mix64(b + (bounds[1:] - bounds[:-1]).astype(U64))) >> U64(1)
    name[bounds[1:] == bounds[:-1]] = 0
    return name.astype(np.int64)


def band_hashes(hashes: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) hashes of bands of ``rows`` minima each; zeros for a text without n-grams."""
    odd = np.random.default_rng(20).integers(0, 1 << 63, size=bands * rows, dtype=np.uint64) * U64(2) + U64(1)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    out = np.zeros((len(bounds) - 1, bands), dtype=U64)
    if not len(some):
        return out.view(np.int64)
    work = np.empty_like(hashes)
    with np.errstate(over="ignore"):
        for b in range(bands):
            sig = np.full(len(some), b + 1, dtype=U64)
            for o in odd[b * rows : (b + 1) * rows]:
                np.multiply(hashes, o, out=work)
                sig = mix64(sig * U64(0x9E3779B97F4A7C15) + (np.minimum.reduceat(work, bounds[some]) >> U64(20)))
            out[some, b] = sig
    return out.view(np.int64)


def _slices(pdf: pd.DataFrame, chars: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Consecutive parts of a batch of about ``chars`` characters."""
    cuts = (pdf["text"].str.len().cumsum() // chars).to_numpy()
    for at in np.unique(cuts):
        yield pdf[cuts == at]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(doc_key().alias("doc_key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def described(docs: DataFrame, n: int = N_WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """doc_key, doc_id, set_id, n_grams, bands of every row."""
    bands, rows = banding(threshold, recall, rows)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _slices(pdf):
                hashes, bounds = grams(part["text"].tolist(), n)
                yield pd.DataFrame({"doc_key": part["doc_key"].to_numpy(), "doc_id": part["doc_id"].to_numpy(), "set_id": set_ids(hashes, bounds), "n_grams": np.diff(bounds), "bands": list(band_hashes(hashes, bounds, bands, rows))})

    return _texts(docs).mapInPandas(describe, "doc_key long, doc_id long, set_id long, n_grams long, bands array<long>")


def components(edges: DataFrame, name: str, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the least node that it is connected to.

    Large-star and small-star rounds: a node's neighbours are linked to the least of them, until nothing changes.
    Each round's edges are written to the shared folder.
    """
    edges = stage(edges.where("a <> b").distinct(), name)
    before = None
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(low.select("a", F.col("m").alias("b")))
        edges = stage(small.distinct(), name)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _linked(hashes: list[np.ndarray], cross: int | None, threshold: float) -> np.ndarray:
    """Boolean matrix of the verified pairs among sets; with ``cross``, only of the first ``cross`` sets with the others."""
    sizes = np.array([len(h) for h in hashes])
    gram = np.concatenate(hashes)
    owner = np.repeat(np.arange(len(hashes)), sizes)
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    new = np.concatenate(([True], gram[1:] != gram[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # an n-gram of one set adds to no intersection
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    cut = len(hashes) if cross is None else cross
    left, right = (slice(0, len(hashes)),) * 2 if cross is None else (slice(0, cut), slice(cut, len(hashes)))
    common = np.zeros((len(sizes[left]), len(sizes[right])), dtype=np.int32)
    width = 4096
    for c in range(0, int(column.max()) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (c, c + width))
        dense = np.zeros((len(hashes), width), dtype=np.float32)
        dense[owner[a:b], column[a:b] - c] = 1.0
        common += (dense[left] @ dense[right].T).astype(np.int32)
    both = sizes[left][:, None] + sizes[right][None, :]
    near = common * (1.0 + threshold) >= (threshold - 1e-9) * both  # in float64: whole counts are far apart next to this slack
    full = np.zeros((len(hashes), len(hashes)), dtype=bool)
    full[left, right] = near
    full |= full.T
    np.fill_diagonal(full, False)
    return full


def verify(pdf: pd.DataFrame, n: int, threshold: float) -> pd.DataFrame:
    """set_id, links, least: of one task's sets, the rows that each links to here and the least set that links join it to."""
    pdf = pdf.drop_duplicates(["root", "set_id"])
    cross = pdf["i"].iat[0] != pdf["j"].iat[0]
    pdf = pdf.assign(second=(pdf["block"] != pdf["i"]) if cross else False).sort_values(["root", "second"], kind="stable")
    hashes, bounds = [], []
    for part in _slices(pdf):
        h, b = grams(part["text"].tolist(), n)
        hashes.extend(h[s:e] for s, e in zip(b[:-1], b[1:]))
    ids, weight, root, second = (pdf[c].to_numpy() for c in ("set_id", "weight", "root", "second"))
    links, least = np.zeros(len(ids), np.int64), ids.copy()
    edges = np.flatnonzero(np.concatenate(([True], root[1:] != root[:-1], [True])))
    for s, e in zip(edges[:-1], edges[1:]):
        first = int((~second[s:e]).sum())
        if e - s < 2 or cross and first in (0, e - s):
            continue
        near = _linked(hashes[s:e], first if cross else None, threshold)
        links[s:e] = near @ weight[s:e]
        mine = ids[s:e].copy()
        while True:
            lower = np.minimum(mine, np.where(near, mine[None, :], _LAST).min(axis=1))
            if (lower == mine).all():
                break
            mine = lower
        least[s:e] = mine
    return pd.DataFrame({"set_id": ids, "links": links, "least": least})


def near_classes(docs: DataFrame, n: int = N_WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, block_grams: int = BLOCK_GRAMS, block_sets: int = BLOCK_SETS) -> DataFrame:
    """doc_key, doc_id, class_id, n_links, keeper: one row per row of ``docs``.

    ``class_id`` is the least id of the class, ``keeper`` the doc_key of one row of it that stands for the class.
    """
    rows_of = stage(described(docs, n, threshold, recall, rows), "ngram-sets")
    classes = stage(
        rows_of.where("set_id <> 0").groupBy("set_id").agg(F.count("*").alias("weight"), F.min(F.struct("doc_id", "doc_key")).alias("rep"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")), "ngram-classes"
    )
    banded = classes.select("set_id", F.explode("bands").alias("hash"))
    buckets = banded.groupBy("hash").agg(F.min("set_id").alias("low"), F.max("set_id").alias("top")).where("low < top").select("hash", "low")
    candidates = components(banded.join(buckets, "hash").select(F.col("set_id").alias("a"), F.col("low").alias("b")), "candidates")

    members = stage(candidates.join(classes.drop("bands"), F.col("node") == F.col("set_id")).select("set_id", "root", "weight", "n_grams", F.col("rep.doc_key").alias("doc_key")), "members")
    sizes = members.groupBy("root").agg(F.sum("n_grams").alias("grams"), F.count("*").alias("sets"))
    sizes = sizes.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("grams") / block_grams), F.ceil(F.col("sets") / block_sets)).cast("int"))
    total = members.agg(F.coalesce(F.sum("n_grams"), F.lit(0)).alias("g")).first()["g"]
    bins = max(1, -(-total // block_grams))  # components of one block share tasks of about one block's size
    placed = members.join(sizes.select("root", "blocks"), "root").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    placed = placed.select("doc_key", "set_id", "root", "weight", "block", F.when(F.col("blocks") > 1, F.col("root")).otherwise(-1 - F.pmod(F.xxhash64("root"), F.lit(bins))).alias("task"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = placed.select("doc_key", "set_id", "root", "weight", "block", "task", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    met = _texts(docs).select("doc_key", "text").join(tasks.hint("merge"), "doc_key")  # by shuffle at every size
    found = met.groupBy("task", "i", "j").applyInPandas(lambda key, pdf: verify(pdf, n, threshold).assign(many=bool(key[0] >= 0)), "set_id long, links long, least long, many boolean")
    found = stage(found, "links")

    across = found.where("many AND least <> set_id").select(F.col("set_id").alias("a"), F.col("least").alias("b"))
    joined = found.where("NOT many").select(F.col("set_id").alias("node"), F.col("least").alias("root"))
    if not across.isEmpty():
        joined = joined.unionAll(components(across, "links-across"))
    counted = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    full = (
        classes.select("set_id", "weight", "rep")
        .join(joined.withColumnRenamed("node", "set_id"), "set_id", "left")
        .join(counted, "set_id", "left")
        .select("set_id", "rep", F.coalesce("root", "set_id").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    full = stage(full, "classes")
    heads = full.groupBy("root").agg(F.min("rep").alias("head"))
    named = full.join(heads, "root").select("set_id", "n_links", F.col("head.doc_id").alias("class_id"), F.col("head.doc_key").alias("keeper"))
    real = F.nullif(F.col("doc_id"), F.lit(_LAST))
    with_grams = rows_of.where("set_id <> 0").select("doc_key", "doc_id", "set_id").join(named, "set_id").select("doc_key", real.alias("doc_id"), F.nullif(F.col("class_id"), F.lit(_LAST)).alias("class_id"), "n_links", "keeper")
    without = rows_of.where("set_id = 0").select("doc_key", real.alias("doc_id"), real.alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_key").alias("keeper"))
    return with_grams.unionAll(without)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their classes, with their columns; of wholly repeated rows one stays."""
    keys = near_classes(docs, **options).groupBy("doc_key").agg(F.count("*").alias("n"), F.first("keeper").alias("keeper")).where("doc_key = keeper")
    keys = stage(keys.select("doc_key", "n"), "kept")
    out = docs.withColumn("__doc_key", doc_key()).join(keys.select(F.col("doc_key").alias("__doc_key")), "__doc_key", "left_semi")
    if not keys.where("n > 1").isEmpty():
        out = out.dropDuplicates(["__doc_key"])
    return out.select(*docs.columns)
