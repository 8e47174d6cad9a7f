"""Suffix-array dedup: removes every byte covered by a string of 200 bytes that also starts elsewhere.

The suffix arrays are built by linear grouping construction (``grouping_suffix_array``):
suffixes are grouped by their Lyndon prefixes, groups are processed in descending order
and refined through previous-smaller pointers, and each group's order is then emitted in
one ascending pass, without recursive renaming.

One suffix array of a whole corpus does not fit a task, so equal strings are first brought
together. Every window of 200 bytes picks one anchor by its content alone (the 32-byte gram
with the least hash, the first of equals), so equal windows pick the same anchor at the same
offset. Runs of windows with one anchor form an occurrence with its context.

1. Occurrences (anchor hash, context hash, place) are written; anchors met once are dropped.
2. Contexts that are equal as a whole become one class with a weight; a class of weight two
   or more is repeated throughout.
3. Classes that share an anchor with other classes are contested. Their bytes are cut from
   the documents, dealt to shards by anchor, trimmed to what some other context of the anchor
   can match, and sorted by one suffix array per shard; equal neighbours of 200 bytes are
   repeated windows. An anchor with more than ``hot`` contexts is not given to one shard: its
   windows are counted one by one, spread by their hashes.
4. The repeated windows return to their documents, which are cut and hashed.

Joins with texts go by shuffle at every size: one to cut the contested contexts, which are
written, and one for the result; nothing that grows with the data is broadcast. Stage tables
are deleted once what was made of them is written.

Strings are judged on the input. Matches never cross documents, and two rows are two places
even when they are equal.

Edge cases: a null text is empty; a text under 200 bytes is kept whole; repeated rows make
each other's windows repeated; rows with equal ids are told apart by their texts; an empty
table gives an empty result; extra columns are kept by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, doc_key, mix64, prefix_hash, span_hash, stage, unstage

MIN_BYTES = 200
GRAM = 32
HOT = 8_192
SHARD_CONTEXTS = 4_096
_STEP = 1 << 19  # window starts handled at once; offsets of anchors fit 20 bits
_LOW = U64((1 << 20) - 1)


def grouping_suffix_array(text: list[int]) -> list[int]:
    """Suffix array of ``text``; a sentinel below all symbols is implied at its end and left out of the result.

    ``order`` holds the suffixes by group; ``start[s]`` is where the group of suffix s begins and ``size`` the
    length of the group beginning there. Groups are taken from the highest down. For each suffix of a group,
    ``before`` points to the nearest earlier suffix of a lower group: the one whose Lyndon prefix this group's
    prefix extends. Suffixes that are extended more often move higher behind the rest of their group.
    """
    n = len(text)
    if n == 0:
        return []
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n
    start = [0] * n
    size = [0] * n
    first = 0
    for i, s in enumerate(order):
        if text[s] != text[order[first]]:
            first = i
        place[s], start[s] = i, first
        size[first] += 1
    before = [-1] * n
    high = n
    while high > 0:
        low = start[order[high - 1]]
        group = order[low:high]
        for s in group:  # over the higher groups, whose pointers are final
            p = s - 1
            while p >= 0 and place[p] >= high:
                p = before[p]
            before[s] = p
        if len(group) == 1:
            p = before[group[0]]
            if p >= 0:
                g = start[p]
                left = size[g] - 1
                if left:
                    size[g] = left
                    to = g + left
                    other, at = order[to], place[p]
                    order[at], place[other] = other, at
                    order[to], place[p] = p, to
                    start[p], size[to] = to, 1
        else:
            extended: dict[int, int] = {}
            for s in sorted(group):  # a run of this group's own suffixes hangs on the first one's pointer
                p = before[s]
                if p >= 0:
                    if place[p] >= low:
                        p = before[s] = before[p]
                    if p >= 0:
                        extended[p] = extended.get(p, 0) + 1
            if extended:
                by_count: dict[int, list[int]] = {}
                for p, c in extended.items():
                    by_count.setdefault(c, []).append(p)
                for c in sorted(by_count, reverse=True):
                    moved: dict[int, list[int]] = {}
                    for p in by_count[c]:
                        moved.setdefault(start[p], []).append(p)
                    for g, ps in moved.items():
                        left = size[g] - len(ps)
                        if not left:
                            continue
                        to = g + size[g]
                        for p in ps:
                            to -= 1
                            other, at = order[to], place[p]
                            order[at], place[other] = other, at
                            order[to], place[p] = p, to
                        size[g] = left
                        size[to] = len(ps)
                        for p in ps:
                            start[p] = to
        high = low
    free = list(range(n))  # next slot of the group that begins there
    out = [-1] * n
    done = bytearray(n)

    def emit(s: int) -> None:
        while s >= 0 and not done[s]:
            g = start[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = 1
            s = before[s]

    emit(n - 1)  # the sentinel comes first
    for i in range(n):
        emit(out[i] - 1)
    return out


def repeated_starts(strings: list[bytes], weights: list[int], length: int = MIN_BYTES) -> list[np.ndarray]:
    """For each string, whether the ``length`` bytes at each of its starts also start elsewhere.

    Every string stands for ``weights`` places. One suffix array is built over all of them.
    """
    symbols: list[int] = []
    offsets = []
    for s in strings:
        offsets.append(len(symbols))
        symbols.extend(s)
        symbols.append(-1)
    owner = np.repeat(np.arange(len(strings)), [len(s) + 1 for s in strings])
    out = [np.zeros(max(0, len(s) - length + 1), dtype=bool) for s in strings]
    last, same, total = None, [], 0
    for at in grouping_suffix_array(symbols):
        k = owner[at]
        a = at - offsets[k]
        if a >= len(out[k]):
            continue
        window = strings[k][a : a + length]
        if window != last:
            if total > 1:
                for i, b in same:
                    out[i][b] = True
            last, same, total = window, [], 0
        same.append((k, a))
        total += weights[k]
    if total > 1:
        for i, b in same:
            out[i][b] = True
    return out


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys."""
    span = 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    return np.minimum(key[: len(key) - (width - span)], key[width - span :]) if width > span else key


def occurrences(texts: list[bytes], length: int = MIN_BYTES, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, start, windows, lead, anchor, context): runs of windows with one anchor.

    The run's first window starts at ``start``; its anchor gram lies ``lead`` bytes further; ``anchor`` and
    ``context`` are hashes of the gram and of all bytes that the run covers.
    """
    texts = [t if len(t) >= length else b"" for t in texts]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty.view(U64), empty.view(U64)
    prefix = prefix_hash(data)
    n_windows = len(data) - length + 1
    firsts, counts, anchors = [], [], []
    for at in range(0, n_windows, _STEP):
        n = min(_STEP, n_windows - at)
        grams = np.arange(at, at + n + length - gram)
        key = (span_hash(prefix, grams, grams + gram) & ~_LOW) | (grams - at).astype(U64)
        best = (_least(key, length - gram + 1) & _LOW).astype(np.int64) + at
        s = np.arange(at, at + n)
        inside = s + length <= ends[np.searchsorted(ends, s, side="right")]
        s, best = s[inside], best[inside]
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(s)), bool), (best[1:] != best[:-1]) | (s[1:] != s[:-1] + 1))))
        firsts.append(s[new])
        counts.append(np.diff(np.append(new, len(s))))
        anchors.append(best[new])
    first, count, anchor = np.concatenate(firsts), np.concatenate(counts), np.concatenate(anchors)
    text = np.searchsorted(ends, first, side="right")
    lead = anchor - first
    context = span_hash(prefix, first, first + count + length - 1) ^ mix64(lead.astype(U64))
    return text, first - (ends[text] - np.array([len(t) for t in texts], np.int64)[text]), count, lead, span_hash(prefix, anchor, anchor + gram), context


def _encoded(pdf: pd.DataFrame, size: int = 1_000_000) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Consecutive parts of a batch of about ``size`` characters, with the texts as UTF-8."""
    cuts = (pdf["text"].str.len().cumsum() // size).to_numpy()
    for c in np.unique(cuts):
        part = pdf[cuts == c]
        yield part, [t.encode("utf-8", "surrogatepass") for t in part["text"]]


def _pack(start, windows, lead):
    return (start << 16) | (windows << 8) | lead


_KEYED = "doc_key long, doc_id long, text string"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(doc_key().alias("doc_key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _trimmed(shard: pd.DataFrame, length: int, gram: int) -> pd.DataFrame:
    """The shard's contexts with (w0, w1), the first and last window that another context of the anchor can hold."""
    leads, sizes = shard["lead"].to_numpy(np.int64), shard["bytes"].str.len().to_numpy(np.int64)
    width = -(-(length - gram) // 8) * 8
    right = np.zeros((len(shard), width), np.uint8)
    left = np.zeros((len(shard), width), np.uint8)
    for i, (b, lead) in enumerate(zip(shard["bytes"], leads)):
        r = b[lead + gram : lead + gram + width]
        right[i, : len(r)] = np.frombuffer(r, np.uint8)
        left[i, :lead] = np.frombuffer(b[:lead][::-1], np.uint8)
    group = np.unique(shard["h"].to_numpy(), return_inverse=True)[1]

    def longest(side: np.ndarray) -> np.ndarray:
        """Most bytes that each row shares at its beginning with another row of its group."""
        words = side.view(">u8").astype(np.uint64)
        order = np.lexsort((*words.T[::-1], group))
        rows = side[order]
        differs = rows[1:] != rows[:-1]
        shared = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        shared[group[order][1:] != group[order][:-1]] = -1
        best = np.full(len(side), -1, np.int64)
        best[order[1:]] = shared
        best[order[:-1]] = np.maximum(best[order[:-1]], shared)
        return best

    l, r = np.minimum(longest(left), leads), longest(right)
    w0 = leads - l
    w1 = np.minimum(leads + r - (length - gram), sizes - length)
    return shard.assign(w0=w0, w1=w1)[(l >= 0) & (r >= 0) & (w0 <= w1)]


def judge_shard(shard: pd.DataFrame, length: int = MIN_BYTES, gram: int = GRAM) -> pd.DataFrame:
    """h, ctx, runs: windows of the shard's weight-one contexts that another place holds too."""
    shard = shard.drop_duplicates(["h", "ctx"])
    shard = _trimmed(shard, length, gram)
    cut: dict[bytes, int] = {}
    weights: list[int] = []
    which = []
    for b, w0, w1, weight in zip(shard["bytes"], shard["w0"], shard["w1"], shard["weight"]):
        piece = bytes(b[w0 : w1 + length])
        k = cut.setdefault(piece, len(weights))
        if k == len(weights):
            weights.append(0)
        weights[k] += int(weight)
        which.append(k)
    held = repeated_starts(list(cut), weights, length)
    rows = []
    for h, ctx, weight, w0, k in zip(shard["h"], shard["ctx"], shard["weight"], shard["w0"], which):
        if weight == 1 and held[k].any():
            rows.append((h, ctx, _runs(held[k], int(w0))))
    return pd.DataFrame(rows, columns=["h", "ctx", "runs"])


def _runs(flags: np.ndarray, base: int) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return [{"a": base + int(a), "b": base + int(b) - 1} for a, b in zip(edge[0::2], edge[1::2])]


_RUNS = "array<struct<a: int, b: int>>"


def removed_spans(docs: DataFrame, length: int = MIN_BYTES, gram: int = GRAM, hot: int = HOT, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """doc_key, spans array<struct<a: long, b: long>>: byte ranges to remove; a document without any has no row."""
    keyed = _keyed(docs)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, raw in _encoded(pdf):
                text, start, windows, lead, anchor, context = occurrences(raw, length, gram)
                yield pd.DataFrame({"h": anchor.view(np.int64), "ctx": context.view(np.int64), "doc_key": part["doc_key"].to_numpy()[text], "loc": _pack(start, windows, lead)})

    found = stage(keyed.mapInPandas(emit, "h long, ctx long, doc_key long, loc long"), "occurrences")
    # written, so that both sides of the join are plain exchanges and adaptive execution can split a hot anchor
    shared = stage(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated-anchors")
    met = stage(found.join(shared.hint("merge"), "h", "left_semi"), "shared-anchors")
    unstage(found)
    unstage(shared)

    classes = stage(met.groupBy("h", "ctx").agg(F.count("*").alias("weight"), F.min(F.struct("doc_key", "loc")).alias("rep")), "contexts")
    crowds = classes.groupBy("h").agg(F.count("*").alias("contexts")).where("contexts > 1")
    contested = classes.join(crowds, "h").select("h", "ctx", "weight", "contexts", F.col("rep.doc_key").alias("doc_key"), F.col("rep.loc").alias("loc"))
    contested = stage(contested, "contested")
    shards = max(1, -(-contested.where(F.col("contexts") <= hot).count() // shard_contexts))
    crowded = not contested.where(F.col("contexts") > hot).isEmpty()

    wanted = contested.groupBy("doc_key").agg(F.collect_list(F.struct("h", "ctx", "weight", "contexts", "loc")).alias("wanted"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, raw in _encoded(pdf, 500_000):
                rows = [(w["h"], w["ctx"], w["weight"], w["contexts"], w["loc"] & 255, b[w["loc"] >> 16 : (w["loc"] >> 16) + (w["loc"] >> 8 & 255) + length - 1]) for b, ws in zip(raw, part["wanted"]) for w in ws]
                yield pd.DataFrame(rows, columns=["h", "ctx", "weight", "contexts", "lead", "bytes"])

    cuts = keyed.join(wanted.hint("merge"), "doc_key").select("text", "wanted").mapInPandas(cut, "h long, ctx long, weight long, contexts long, lead int, bytes binary")
    cuts = stage(cuts, "cuts")  # texts are moved once for this and once for the result, whether an anchor is crowded or not
    unstage(contested)
    in_shards = cuts.where(F.col("contexts") <= hot).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    judged = in_shards.groupBy("shard").applyInPandas(lambda pdf: judge_shard(pdf, length, gram), f"h long, ctx long, runs {_RUNS}")
    if crowded:
        judged = judged.unionAll(_judged_singly(cuts.where(F.col("contexts") > hot), length))

    whole = F.array(F.struct(F.lit(0).alias("a"), (F.shiftright("rep.loc", 8).bitwiseAND(255).cast("int") - 1).alias("b")))
    repeated = classes.where("weight > 1").select("h", "ctx", whole.cast(_RUNS).alias("runs")).unionAll(judged)
    back = met.join(repeated.hint("merge"), ["h", "ctx"]).select("doc_key", F.shiftright("loc", 16).alias("start"), F.explode("runs").alias("run"))
    span = F.struct((F.col("start") + F.col("run.a")).alias("a"), (F.col("start") + F.col("run.b") + length).alias("b"))
    return back.groupBy("doc_key").agg(F.collect_set(span).alias("spans"))


def _judged_singly(cuts: DataFrame, length: int) -> DataFrame:
    """Windows of crowded anchors, counted one by one over the cluster."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                data = np.frombuffer(b"".join(part["bytes"]), np.uint8)
                sizes = part["bytes"].str.len().to_numpy(np.int64)
                n = sizes - length + 1
                row = np.repeat(np.arange(len(part)), n)
                w = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                s = (np.cumsum(sizes) - sizes)[row] + w
                lead = part["lead"].to_numpy(np.int64)[row] - w
                hashes = span_hash(prefix_hash(data), s, s + length) ^ mix64(part["h"].to_numpy(np.int64)[row].view(U64) + lead.astype(U64))
                yield pd.DataFrame({"h": part["h"].to_numpy()[row], "ctx": part["ctx"].to_numpy()[row], "weight": part["weight"].to_numpy()[row], "w": w.astype(np.int32), "window": hashes.view(np.int64)})

    single = stage(cuts.dropDuplicates(["h", "ctx"]).mapInPandas(windows, "h long, ctx long, weight long, w int, window long"), "windows")
    often = single.groupBy("window").agg(F.sum("weight").alias("n")).where("n > 1").select("window")
    held = single.where("weight = 1").join(often, "window", "left_semi")
    return held.groupBy("h", "ctx").agg(F.transform(F.collect_list("w"), lambda w: F.struct(w.alias("a"), w.alias("b"))).cast(_RUNS).alias("runs"))


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((int(s["a"]), int(s["b"])) for s in spans) if spans is not None else ():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out)


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text, spans in zip(pdf["doc_id"], pdf["text"], pdf["spans"]):
                raw, gone = text.encode("utf-8", "surrogatepass"), _merged(spans)
                rows.append((None if pd.isna(doc_id) else int(doc_id), len(raw), sum(b - a for a, b in gone), len(gone), hashlib.sha256(_kept(raw, gone)).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})

    joined = _keyed(docs).join(removed_spans(docs, **options).hint("merge"), "doc_key", "left").select("doc_id", "text", "spans")
    return joined.mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the repeated bytes removed from ``text`` (bytes cut inside a character are dropped) and its columns."""

    from pyspark.sql import types as T

    @F.pandas_udf(T.StringType())
    def rest(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_kept(t.encode("utf-8", "surrogatepass"), _merged(s)).decode("utf-8", "ignore") if s is not None else t for t, s in zip(texts, spans)])

    marked = docs.withColumn("__doc_key", doc_key()).join(removed_spans(docs, **options).select(F.col("doc_key").alias("__doc_key"), F.col("spans").alias("__spans")).hint("merge"), "__doc_key", "left")
    return marked.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(rest(F.coalesce("text", F.lit("")), "__spans"))).select(*docs.columns)
