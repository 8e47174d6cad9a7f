"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Base spans are the matches of three patterns. The field tags tokens (runs of word
characters, or one other visible character) as secret begin, inside or outside. A
token's score is a sum of learned weights over its own shape (length, character
classes, class changes, distinct characters, first letters), over the shapes and
words of its neighbours from four before to two after, and over features of its
file (size, shares of assignment, quote, bracket and digit characters).
Transitions are learned too; tags are decoded by Viterbi. A run of begin and inside
tokens is a ``tagged`` span unless base spans already cover it; base spans stay.

Decoding is exact without walking every token: where the outside score leads by
more than any change of two transitions can return, outside is in every best path,
so the chain falls into short stretches between such tokens and Viterbi runs on
those. Scores are sums of a table row per distinct token, gathered with numpy.

The weights maximise the conditional likelihood on sequences of two kinds: windows
of at most ``max_rows`` documents chosen by a hash of their id, tagged by the base
spans, and the same windows with generated secrets and generated look-alikes
(numbers, addresses, versions, code) put in, since no table labels secrets. The
fit is bounded by ``max_rows`` whatever the corpus; all documents are scanned.

Documents are independent: no shuffle; a task holds one Arrow batch of texts. A
text is tokenised in pieces cut at white space, so a long one holds a few bytes a
token, not its token strings.

Edge cases: a null text is empty and has no span; an empty table trains on
generated rows alone and gives an empty result; repeated rows are scanned alike; a
text without white space is one piece; columns of the input with the result's name
are replaced, others are kept.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ROWS = 500  # documents of the fitting sample
GENERATED = 1_500  # generated rows of the fit
WINDOW = 160  # characters of a fitting window
SLAB = 1 << 20  # characters tokenised at a time
MAX_TYPES = 200_000  # distinct tokens whose scores a worker keeps
_STEPS = 1_000_000

# The base patterns, their kinds in order, and the least length of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 8
KINDS = ("assign", "access", "hex", "tagged")
TAGGED = KINDS[-1]

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

TOKEN = re.compile(r"\w+|[^\w\s]")
_BLANK = re.compile(r"\s")
OUT, BEGIN, INSIDE = 0, 1, 2
OFFSETS = (-4, -3, -2, -1, 0, 1, 2)
_PAD = max(-OFFSETS[0], OFFSETS[-1])


# --- base patterns ------------------------------------------------------------------------------


def base_matches(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of the base spans, by start, then kind as listed.

    Runs of one character class are whole, so their least length stands in the pattern; an assignment
    with a short value still uses up its text, so its length is judged after the match.
    """
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# --- features -----------------------------------------------------------------------------------


def _bucket(n: int) -> str:
    for top in (1, 2, 4, 7, 11, 15, 19, 23, 31, 39, 63):
        if n <= top:
            return str(top)
    return "long"


def _class(c: str) -> str:
    if c.isdigit():
        return "9"
    return "x" if c.islower() else "X" if c.isupper() else "w" if c.isalnum() else c


def shape_features(token: str) -> list[str]:
    """Features of a token that do not name it."""
    size = _bucket(len(token))
    classes = [_class(c) for c in token]
    held = "".join(sorted(set(classes)))
    changes = min(12, 16 * sum(a != b for a, b in zip(classes, classes[1:])) // len(token))
    out = [f"size={size}", f"held={held}", f"held={held}/{size}", f"changes={changes}/{size}"]
    out.append(f"distinct={8 * len(set(token)) // min(len(token), 40)}/{size}")
    if "9" in held:
        if set(token.lower()) <= set("0123456789abcdef"):
            out.append(f"hex/{size}")
        if len(token) >= 8 and len(held) > 1:
            out += [f"first={token[:3]}", f"first={token[:4]}"]
    return out


_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def token_features(token: str) -> list[str]:
    """Shape features of one token, the word itself if it is short, and the words that a name is made of."""
    out = shape_features(token)
    if len(token) <= 16:
        out.append(f"word={token.lower()}")
    if len(token) <= 40 and not token.islower() or "_" in token:
        out += sorted({f"word={p.lower()}" for p in _PART.findall(token) if 3 <= len(p) <= 16} - set(out))
    return out


def file_features(text: str) -> list[str]:
    """Size of a file and its shares of assignment, quote, bracket and digit characters."""
    n = max(1, len(text))
    shares = {"assign": "=:", "quote": "\"'`", "bracket": "{}[];", "digit": string.digits}
    parts = [f"file-{name}={min(5, 200 * sum(text.count(c) for c in chars) // n)}" for name, chars in shares.items()]
    return [f"file-size={len(text).bit_length()}", *parts]


# --- the field ----------------------------------------------------------------------------------


@dataclass
class Field:
    """Learned weights. Those of tokens and files are leads of begin and inside over outside, whose score is 0."""

    features: dict[str, int]
    weights: np.ndarray  # (features, offsets, 2)
    files: dict[str, int]
    file_weights: np.ndarray  # (file features, 2)
    moves: np.ndarray  # (3, 3)

    def known(self, names: list[str]) -> tuple[int, ...]:
        return tuple(i for f in names if (i := self.features.get(f)) is not None)

    def token_row(self, token: str) -> np.ndarray:
        """(offsets, 2): what a token adds to the scores of the tokens around it."""
        return self.weights[list(self.known(token_features(token)))].sum(axis=0)

    def file_row(self, text: str) -> np.ndarray:
        own = [i for f in file_features(text) if (i := self.files.get(f)) is not None]
        return self.file_weights[own].sum(axis=0)

    def returns(self) -> np.ndarray:
        """For begin and inside: the most that its two transitions can gain over outside's, whatever stands beside it."""
        t = self.moves
        gain = [max(t[a, y] + t[y, c] - t[a, OUT] - t[OUT, c] for a in range(3) for c in range(3)) for y in (BEGIN, INSIDE)]
        return np.array(gain)


def viterbi(leads: np.ndarray, moves: np.ndarray) -> list[int]:
    """Best tags of a stretch with an outside token at both ends; ties to the smaller tag."""
    scores = np.pad(leads, ((0, 0), (1, 0)))
    best, back = moves[OUT] + scores[0], []
    for row in scores[1:]:
        paths = best[:, None] + moves
        came = paths.argmax(axis=0)
        back.append(came)
        best = paths[came, (0, 1, 2)] + row
    tags = [int((best + moves[:, OUT]).argmax())]
    for came in reversed(back):
        tags.append(int(came[tags[-1]]))
    return tags[::-1]


class _Types(dict):
    """Token -> row of the score table. Tokens of the same known features share a row, as most words of prose do."""

    def __init__(self, field: Field):
        self.field, self.rows = field, np.zeros((1024, len(OFFSETS), 2), dtype=np.float32)
        self.by_features: dict[tuple, int] = {(): 0}  # row 0 also stands beside a text's ends
        self.by_shape: dict[tuple, int] = {}

    def _row(self, own: tuple[int, ...]) -> int:
        at = self.by_features.get(own)
        if at is None:
            at = self.by_features[own] = len(self.by_features)
            if at == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[at] = self.field.weights[list(own)].sum(axis=0)
        return at

    def __missing__(self, token: str) -> int:
        field = self.field
        if token.isalpha() and token.islower() and (len(token) > 16 or f"word={token}" not in field.features):
            shape = (len(token), len(set(token)))  # all that the features of small letters read
            at = self.by_shape.get(shape)
            if at is None:
                at = self.by_shape[shape] = self._row(field.known(shape_features(token)))
        else:
            at = self._row(field.known(token_features(token)))
        self[token] = at
        return at


def _slabs(text: str, size: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > size and (m := _BLANK.search(text, at + size)):
            end = m.start() + 1
        yield at, end
        at = end


def stretches(leads: np.ndarray, returns: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the runs of tokens that some best path may not tag as outside."""
    near = (leads[:, 0] >= -returns[0]) | (leads[:, 1] >= -returns[1])
    open_ = np.concatenate([[False], near, [False]])
    edges = np.flatnonzero(open_[1:] != open_[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _leads(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Leads of every token: its own row and those of its neighbours."""
    out = np.zeros((len(ids) + 2 * _PAD, 2))
    for k, offset in enumerate(OFFSETS):
        out[_PAD - offset : _PAD - offset + len(ids)] += rows[ids, k]
    return out[_PAD : _PAD + len(ids)]


class Tagger:
    """Decodes texts with one field; keeps the score rows of the tokens it has seen."""

    def __init__(self, field: Field, slab: int = SLAB):
        self.field, self.slab, self.returns = field, slab, field.returns()
        self.types = _Types(field)

    def token_spans(self, text: str) -> list[tuple[int, int]]:
        """[first, past last) token indices of the tagged runs."""
        ids, seen = [], self.types
        if len(seen) > MAX_TYPES:
            seen = self.types = _Types(self.field)
        for a, b in _slabs(text, self.slab):
            ids.append(np.fromiter(map(seen.__getitem__, TOKEN.findall(text, a, b)), dtype=np.int64))
        if not ids:
            return []
        leads = _leads(np.concatenate(ids), seen.rows) + self.field.file_row(text)
        found = []
        for a, b in stretches(leads, self.returns):
            tags = [*viterbi(leads[a:b], self.field.moves), OUT]
            start = None
            for i, tag in enumerate(tags):
                if start is not None and tag != INSIDE:
                    found.append((a + start, a + i))
                    start = None
                if start is None and tag != OUT:
                    start = i
        return found

    def spans(self, text: str) -> list[tuple[int, int]]:
        """[start, end) of the tagged runs in code points."""
        runs = self.token_spans(text)
        if not runs:
            return []
        out, at, k = [], 0, 0
        first = None
        for m in TOKEN.finditer(text):
            if at == runs[k][0]:
                first = m.start()
            at += 1
            if at == runs[k][1]:
                out.append((first, m.end()))
                k += 1
                if k == len(runs):
                    break
        return out


def all_spans(text: str, tagger: Tagger) -> list[tuple[str, int, int]]:
    """Base spans, and the tagged ones that they do not cover, by start, then kind as listed."""
    base = [s[:3] for s in base_matches(text)]
    covered, end = [], -1
    for _, a, b in base:
        if covered and a <= end:
            covered[-1][1] = end = max(end, b)
        else:
            covered.append([a, b])
            end = b
    out = list(base)
    k = 0
    for a, b in tagger.spans(text):
        while k < len(covered) and covered[k][1] < b:
            k += 1
        if k == len(covered) or covered[k][0] > a:
            out.append((TAGGED, a, b))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# --- fitting sequences --------------------------------------------------------------------------


def windows(text: str, key: str, width: int = WINDOW) -> list[tuple[str, list[tuple[int, int]]]]:
    """(window, value spans) around two base spans of a text and at two places drawn by ``key``, cut at white space."""
    rng = random.Random(key)
    base = base_matches(text)
    centres = [s[1] for s in rng.sample(base, min(2, len(base)))] + [rng.randrange(len(text) + 1) for _ in range(2)]
    out = []
    for c in centres:
        a, b = max(0, c - width // 2), min(len(text), c + width // 2)
        while a > 0 and c - a < 2 * width and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and b - c < 2 * width and not text[b].isspace():
            b += 1
        out.append((text[a:b], [(max(v, a) - a, min(e, b) - a) for _, s, e, v in base if a <= s and v < b]))
    return out


def _pick(rng: random.Random, chars: str, low: int, high: int) -> str:
    return "".join(rng.choice(chars) for _ in range(rng.randint(low, high)))


_MIXED = string.ascii_letters + string.digits
_WORDS = "river apple stone copper winter falcon meadow tiger silver garden".split()


def _secret(rng: random.Random) -> str:
    kinds = [
        lambda: _pick(rng, _MIXED, 16, 48),
        lambda: _pick(rng, _MIXED + "+/", 24, 60) + rng.choice(["", "=", "=="]),
        lambda: _pick(rng, string.hexdigits[:16], 20, 31),
        lambda: _pick(rng, string.ascii_uppercase + string.digits, 16, 28),
        lambda: rng.choice(["ghp_", "gho_", "npm_", "hf_", "sk_live_", "pk_test_", "AIza"]) + _pick(rng, _MIXED, 24, 40),
        lambda: rng.choice(["sk-", "glpat-", "xoxb-", "shpat-", "SG."]) + _pick(rng, _MIXED, 20, 44),
        lambda: ".".join(["eyJ" + _pick(rng, _MIXED, 12, 24), "eyJ" + _pick(rng, _MIXED, 20, 40), _pick(rng, _MIXED + "_-", 24, 43)]),
        lambda: rng.choice(_WORDS).capitalize() + _pick(rng, string.digits, 2, 5) + rng.choice("!#$%&*?@"),
        lambda: rng.choice(_WORDS) + rng.choice("._-") + rng.choice(_WORDS) + _pick(rng, string.digits, 2, 4),
    ]
    return rng.choice(kinds)()


_NAMES = (
    "pwd pass passphrase db_password auth auth_token access_token refresh_token client_secret secret_key private_key "
    "aws_secret_access_key signing_key encryption_key access_key master_key credential credentials license_key session_key passcode"
).split()


def _carried(rng: random.Random) -> tuple[str, str, str]:
    """(before, secret, after) as a file or a sentence would hold it."""
    name, value = rng.choice(_NAMES), _secret(rng)
    name = rng.choice([name, name.upper(), name.replace("_", "-"), name.title().replace("_", "")])
    quote = rng.choice(["", '"', "'"])
    kinds = [
        (f"{name}{rng.choice(['=', ' = ', ': ', ':', ' => ', ' := '])}{quote}", quote),
        (f'"{name}": "', rng.choice(['"', '",'])),
        (f"export {name.upper()}=", ""),
        (f"--{name} ", ""),
        ("Authorization: Bearer ", ""),
        (f"{rng.choice(['postgres', 'mysql', 'amqp', 'https', 'mongodb'])}://{rng.choice(_WORDS)}:", f"@{rng.choice(_WORDS)}.example.com/db"),
        (f"{rng.choice(['The', 'My', 'Your', 'the new'])} {rng.choice(['password', 'passphrase', 'access code', 'login secret'])} is ", "."),
        ("-----BEGIN PRIVATE KEY----- ", " -----END PRIVATE KEY-----"),
    ]
    before, after = rng.choice(kinds)
    return before, value, after


def _look_alike(rng: random.Random) -> str:
    digits = string.digits
    name = rng.choice(_NAMES + ["password", "token", "secret", "key", "id", "count", "path", "name", "commit", "version"])
    word, other = rng.choice(_WORDS), rng.choice(_WORDS)
    kinds = [
        lambda: _pick(rng, digits, 5, 19),
        lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        lambda: f"{word}.{other}{rng.randrange(99)}@mail{rng.randrange(9)}.example.com",
        lambda: f"+{rng.randrange(99)} {_pick(rng, digits, 3, 3)}-{_pick(rng, digits, 3, 4)}-{_pick(rng, digits, 4, 4)}",
        lambda: f"({_pick(rng, digits, 3, 3)}) {_pick(rng, digits, 3, 3)}-{_pick(rng, digits, 4, 4)}",
        lambda: f"{rng.randint(1950, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:00Z",
        lambda: f"v{rng.randrange(20)}.{rng.randrange(20)}.{rng.randrange(99)}",
        lambda: f"https://www.{word}.example.org/{other}/{word}-{rng.randrange(9999)}?page={rng.randrange(99)}&lang=en",
        lambda: f"{name} = {rng.choice(['None', 'null', 'true', 'getValue()', 'os.environ[', 'request.form', word])}",
        lambda: f"{name}: {rng.choice(['********', '<hidden>', 'required', 'string', '${' + name.upper() + '}', word])}",
        lambda: f"{word}_{other} = {_pick(rng, digits, 1, 10)}",
        lambda: f"commit {_pick(rng, string.hexdigits[:16], 7, 10)}",
        lambda: f"path=/usr/local/{word}/{other}.txt",
        lambda: f"#{_pick(rng, string.hexdigits[:16], 6, 6)}",
        lambda: f"ISBN {_pick(rng, digits, 3, 3)}-{_pick(rng, digits, 10, 10)}",
        lambda: f"{word.capitalize()}{other.capitalize()}{rng.choice(_WORDS).capitalize()}Factory({_pick(rng, digits, 1, 4)})",
        lambda: f"License: {rng.choice(['MIT', 'Apache-2.0', 'CC-BY-SA-4.0', 'GPL-3.0-or-later'])}",
        lambda: "-".join(_pick(rng, "0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12)),
        lambda: f"{rng.choice(['EUR', '$', 'Rs'])} {_pick(rng, digits, 1, 3)},{_pick(rng, digits, 3, 3)}.{_pick(rng, digits, 2, 2)}",
        lambda: rng.choice(["###", "$$$", "%%%", "&&&", "***", "---", "=====", "|||", "<br>", "{}", "//"]) * rng.randint(1, 4),
    ]
    return rng.choice(kinds)()


def sequences(held: list[tuple[str, list, list]], n: int, seed: int = 1) -> list[tuple[str, list, list]]:
    """(text, value spans, file features): the windows, and ``n`` of them with generated secrets and look-alikes put in."""
    rng = random.Random(seed)
    held = held or [("", [], file_features(""))]
    out = list(held)
    for i in range(n):
        text, spans, file = held[i % len(held)]
        gaps = [m.start() for m in _BLANK.finditer(text) if not any(a < m.start() < b for a, b in spans)] or [0, len(text)]
        pieces, at, size, shifted = [], 0, 0, []
        for gap in sorted(rng.sample(gaps, min(len(gaps), rng.randint(1, 3)))):
            if gap < at or any(a < gap < b for a, b in spans):
                continue
            shifted += [(a + size, b + size) for a, b in spans if at <= a < gap]
            pieces.append(text[at:gap])
            before, value, after = _carried(rng) if rng.random() < 0.4 else (_look_alike(rng), "", "")
            pad = rng.choice([" ", "\n", " "])
            start = gap + size + len(pad) + len(before)
            if value:
                shifted.append((start, start + len(value)))
            piece = f"{pad}{before}{value}{after}{pad if not text[gap:] else ''}"
            pieces.append(piece)
            size, at = size + len(piece), gap
        shifted += [(a + size, b + size) for a, b in spans if a >= at]
        out.append(("".join(pieces) + text[at:], shifted, file))
    return out


def tags_of(text: str, spans: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    """Tokens of a text and their tags; a token that a span touches is in it."""
    tokens, tags, last = [], [], None
    for m in TOKEN.finditer(text):
        own = next((s for s in spans if m.start() < s[1] and s[0] < m.end()), None)
        tokens.append(m[0])
        tags.append(OUT if own is None else INSIDE if own == last else BEGIN)
        last = own
    return tokens, tags


# --- fitting ------------------------------------------------------------------------------------


class Objective:
    """Conditional log-likelihood of tagged sequences, less an L2 penalty, and its gradient."""

    def __init__(self, rows: list[tuple[str, list, list]], penalty: float = 0.1, least: int = 3):
        tagged = [(*tags_of(text, spans), file) for text, spans, file in rows]
        tagged = [t for t in tagged if t[0]]
        types: dict[str, int] = {"": 0}
        flat, gold, lengths = [0] * _PAD, [], []
        for tokens, tags, _ in tagged:
            flat += [types.setdefault(t, len(types)) for t in tokens] + [0] * _PAD
            gold += tags
            lengths.append(len(tokens))
        self.flat, self.gold, self.lengths = np.array(flat), np.array(gold), np.array(lengths)
        starts = _PAD + np.concatenate([[0], np.cumsum(self.lengths + _PAD)[:-1]])
        self.at = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, self.lengths)])  # places of the tokens in flat
        self.seq = np.repeat(np.arange(len(tagged)), self.lengths)
        self.step = self.at - starts[self.seq]

        per_type = [[]] + [token_features(t) for t in list(types)[1:]]
        counts: dict[str, int] = {}
        for row, c in zip(per_type, np.bincount(self.flat, minlength=len(types)).tolist()):
            for f in row:
                counts[f] = counts.get(f, 0) + c
        self.features = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c >= least))}
        self.types = _Sums([(t, self.features[f]) for t, row in enumerate(per_type) for f in row if f in self.features], len(types), len(self.features))
        self.files = {f: i for i, f in enumerate(sorted({f for *_, file in tagged for f in file}))}
        self.per_file = _Sums([(s, self.files[f]) for s, (*_, file) in enumerate(tagged) for f in file], len(tagged), len(self.files))
        self.penalty = penalty
        self.shapes = ((len(self.features), len(OFFSETS), 2), (len(self.files), 2), (3, 3))
        self.size = sum(int(np.prod(s)) for s in self.shapes)

        # the gold path's transitions; a sequence starts and ends beside an outside token
        n, longest = len(tagged), int(self.lengths.max())
        self.on = np.arange(longest)[:, None] < self.lengths[None, :]
        tags = np.full((longest + 2, n), OUT)
        tags[self.step + 1, self.seq] = self.gold
        edge = np.arange(longest + 1)[:, None] <= self.lengths[None, :]
        self.gold_moves = np.zeros((3, 3))
        np.add.at(self.gold_moves, (tags[:-1][edge], tags[1:][edge]), 1)
        self.is_gold = np.eye(3)[self.gold]

    def split(self, theta: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for s in self.shapes:
            n = int(np.prod(s))
            out.append(theta[at : at + n].reshape(s))
            at += n
        return out

    def scores(self, w: np.ndarray, fw: np.ndarray) -> np.ndarray:
        table = self.types.forward(w.reshape(len(w), -1)).reshape(-1, len(OFFSETS), 2)
        leads = self.per_file.forward(fw)[self.seq]
        for k, offset in enumerate(OFFSETS):
            leads += table[self.flat[self.at + offset], k]
        return np.pad(leads, ((0, 0), (1, 0)))

    def posteriors(self, scores: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(sum of log partition functions, tag shares of each token, expected transitions), by scaled forward and backward sums."""
        longest, n = self.on.shape
        top = scores.max(axis=1)
        grid = np.zeros((longest, n, 3))
        grid[self.step, self.seq] = np.exp(scores - top[:, None])
        steps = np.exp(moves)
        ahead, norm = np.empty_like(grid), np.ones((longest, n))
        now = np.broadcast_to(np.eye(3)[OUT], (n, 3))
        for t in range(longest):
            here = (now @ steps) * grid[t]
            on = self.on[t]
            norm[t, on] = here[on].sum(axis=1)
            now = np.where(on[:, None], here / norm[t][:, None], now)
            ahead[t] = now
        ends = ahead[-1] @ steps[:, OUT]
        behind = np.empty_like(grid)  # what follows a token, scaled
        want = np.zeros((3, 3))
        now = np.broadcast_to(steps[:, OUT], (n, 3)) / ends[:, None]
        want[:, OUT] += (ahead[-1] * now).sum(axis=0)
        for t in range(longest - 1, -1, -1):
            on = self.on[t]
            behind[t] = now
            came = ahead[t - 1] if t else np.broadcast_to(np.eye(3)[OUT], (n, 3))
            after = grid[t] * now / norm[t][:, None]
            want += (came[on].T @ after[on]) * steps
            now = np.where(on[:, None], after @ steps.T, now)
        share = (ahead * behind)[self.step, self.seq]
        return float(np.log(norm).sum() + np.log(ends).sum() + top.sum()), share, want

    def value_and_gradient(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        w, fw, moves = self.split(theta)
        scores = self.scores(w, fw)
        total, share, want = self.posteriors(scores, moves)
        value = (scores * self.is_gold).sum() + (self.gold_moves * moves).sum() - total
        left = (self.is_gold - share)[:, 1:]
        per_type = np.stack([
            np.bincount(self.flat[self.at + offset], weights=left[:, y], minlength=self.types.rows)
            for offset in OFFSETS for y in range(2)
        ], axis=1)
        per_seq = np.stack([np.bincount(self.seq, weights=left[:, y], minlength=len(self.lengths)) for y in range(2)], axis=1)
        parts = (self.types.backward(per_type), self.per_file.backward(per_seq), self.gold_moves - want)
        gradient = np.concatenate([p.ravel() for p in parts])
        return value - self.penalty / 2 * (theta @ theta), gradient - self.penalty * theta

    def field(self, theta: np.ndarray) -> Field:
        w, fw, moves = self.split(theta)
        return Field(self.features, w.astype(np.float32), self.files, fw.copy(), moves.copy())


class _Sums:
    """Sums over (row, column) pairs: of column vectors by row, and back."""

    def __init__(self, pairs: list[tuple[int, int]], rows: int, cols: int):
        self.rows, self.cols = rows, cols
        held = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        self.row, self.col = held.T
        self.by_col = np.argsort(self.col, kind="stable")

    @staticmethod
    def _add(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """Sums of ``values`` by ascending ``keys``."""
        out = np.zeros((n, values.shape[1]))
        if len(keys):
            heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            out[keys[heads]] = np.add.reduceat(values, heads, axis=0)
        return out

    def forward(self, by_col: np.ndarray) -> np.ndarray:
        return self._add(self.row, by_col[self.col], self.rows)

    def backward(self, by_row: np.ndarray) -> np.ndarray:
        return self._add(self.col[self.by_col], by_row[self.row[self.by_col]], self.cols)


def train(rows: list[tuple[str, list, list]], steps: int = 120, rate: float = 0.08) -> Field:
    """Full-batch Adam on the objective; the same rows give the same field."""
    goal = Objective(rows)
    theta, m, v = np.zeros(goal.size), np.zeros(goal.size), np.zeros(goal.size)
    for i in range(1, steps + 1):
        _, g = goal.value_and_gradient(theta)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += rate * (1 - 0.8 * i / steps) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return goal.field(theta)


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """The field fitted on windows of at most ``max_rows`` documents chosen by a hash of their id."""
    share = min(1.0, 0.9 * max_rows / max(1, docs.count()))
    key = F.xxhash64(F.lit("secret"), F.col(id_col))
    rows = docs.where(F.pmod(key, F.lit(_STEPS)) < int(share * _STEPS)).limit(max_rows)

    @F.pandas_udf("array<struct<text string, starts array<long>, ends array<long>>>")
    def cut(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[
            {"text": w, "starts": [a for a, _ in s], "ends": [b for _, b in s]} for w, s in windows(t, i)
        ] for i, t in zip(ids, texts)])

    @F.pandas_udf("array<string>")
    def of_file(texts: pd.Series) -> pd.Series:
        return texts.map(file_features)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = rows.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), text.alias("text"))
    held = held.select(F.explode(cut("key", "text")).alias("w"), of_file("text").alias("file")).select("w.*", "file")
    pdf = held.toPandas()  # at most four windows of bounded length a sampled document
    found = sorted((t, tuple(zip(map(int, a), map(int, b))), tuple(f)) for t, a, b, f in pdf.itertuples(index=False))
    return train(sequences([(t, list(s), list(f)) for t, s, f in found], GENERATED))


# --- scans --------------------------------------------------------------------------------------


def scan(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array<struct<kind, start, end>> in code points, by start, then kind as listed."""
    taggers: list[Tagger] = []

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        if not taggers:
            taggers.append(Tagger(field))
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in all_spans(t, taggers[0])] for t in texts])

    kept = [F.col(f"`{c}`") for c in docs.columns if c != "spans"]
    return docs.select(*kept, find(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """What the registered query returns."""
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != TAGGED)
    return found.select(
        "doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
