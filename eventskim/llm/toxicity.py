"""Toxicity of text restored by noisy-channel decoding.

Writers hide words by look-alike signs, spacing and repeated letters. Each word is a
lattice of what its signs may stand for; the path that a character trigram model of
the whole corpus finds likeliest, with the cost of each change, is the restored word.
Words of restored text are weighed by how surely labelled rows show them to be toxic,
and a document's heaviest words give a calibrated score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, mapped, released, slices, utf8
from .labelled import fit_logistic, held_out, probability, sample

#: Letters of the model in order; symbol 0 is a word's border, the last any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßœ"
SYMBOLS = 64
OTHER = SYMBOLS - 1
NUMBER = {letter: k for k, letter in enumerate(LETTERS, 1)}
SHOWN = (" " + LETTERS).ljust(OTHER, "?")
#: What a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c",
    "а": "a", "е": "e", "і": "i", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
}
# Costs of changes, in nats.
SUBSTITUTED, DROPPED_SIGN, DROPPED_RUN, KEPT_SIGN, JOINED, PARTED = 0.5, 12.0, 1.0, 12.0, 0.3, 2.0
DOUBLE_TO_ONE, MANY_TO_ONE, MANY_TO_TWO = 4.0, 0.5, 1.0
UNCHANGED_DIGIT, UNCHANGED_SIGN = math.log(10), 5.0  # of a token without letters that is left as it is
PIECES = 5.0  # by how much a join of two pieces of a word must be likelier than the blank
PIECE = 4  # most letters of such a piece
WINDOW = 512  # signs after which the beginning that all readings share is written out
CACHED = 200  # longer tokens are restored each time, not remembered
PER_CLASS = (5000, 3000)  # most labelled rows of label 0 and 1 that a fit looks at
MOST_WORDS = 50_000  # most words that carry a weight
TRIM = ".,;:?\"'`)]}>%&#*!-_("
THRESHOLD = 0.5

_SYMBOL_OF = np.zeros(0x10000, np.uint8)
for _c in range(0x10000):
    if chr(_c).isalpha():
        _SYMBOL_OF[_c] = NUMBER.get(chr(_c), OTHER)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for first, stop in slices(utf8(batch.column(0))[1], 1 << 20):
            joined = "  ".join(t or "" for t in batch.column(0).slice(first, stop - first).to_pylist())
            points = np.frombuffer(f" {joined.lower()} ".encode("utf-32-le"), np.uint32)
            symbols = _SYMBOL_OF[np.minimum(points, 0xFFFF)].astype(np.int32)
            trigrams = (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:]
            counts += np.bincount(trigrams, minlength=SYMBOLS**3)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["trigram", "n"])


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-probabilities of a symbol after two others, from all texts; SYMBOLS ** 3 numbers.

    The counts are summed by Spark; the table's size does not depend on the input.
    """
    counts = docs.select(text).mapInArrow(released(_count_trigrams), "trigram long, n long")
    table = counts.groupBy("trigram").agg(F.sum("n").alias("n")).toArrow()
    n3 = np.zeros(SYMBOLS**3)
    n3[table["trigram"].to_numpy()] = table["n"].to_numpy()
    n3 = n3.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
    p1 = (n1 + 1) / (n1.sum() + SYMBOLS)
    p2 = (n2 + 5 * p1) / (n2.sum(axis=1, keepdims=True) + 5)
    p3 = (n3 + 5 * p2) / (n3.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32).ravel()


def lattice(token: str, own: bool = False) -> Iterator[list[tuple[tuple[int, ...], float]]]:
    """For each run of equal signs of ``token``, the symbols it may stand for and the costs.

    With ``own`` letters stand for themselves, not for Latin ones that look alike.
    """
    for sign, run in groupby(token):
        times = sum(1 for _ in run)
        if sign.isalpha() and (own or sign not in LOOKALIKES):
            s = NUMBER.get(sign, OTHER)
            if times == 1:
                yield [((s,), 0.0)]
            elif times == 2:
                # Of a letter outside the model nothing is known that speaks for one.
                yield [((s, s), 0.0)] if s == OTHER else [((s, s), 0.0), ((s,), DOUBLE_TO_ONE)]
            else:
                yield [((s,), MANY_TO_ONE), ((s, s), MANY_TO_TWO)]
        elif sign == " ":
            yield [((), JOINED), ((0,), PARTED)]
        else:
            dropped = DROPPED_RUN if times > 2 else DROPPED_SIGN
            ways = [((), dropped if sign in LOOKALIKES else JOINED)]
            for letter in LOOKALIKES.get(sign, ""):
                s = NUMBER[letter]
                ways.append(((s,), SUBSTITUTED + (DOUBLE_TO_ONE if times == 2 else 0.0)))
                if times > 1:
                    ways.append(((s, s), SUBSTITUTED))
            if sign not in LOOKALIKES:
                ways.append(((0,), PARTED))
            else:
                ways.append(((OTHER,), KEPT_SIGN))
            yield ways


def _spelled(path: str | tuple) -> str:
    """The text of a reading, whose letters are linked from the last one back."""
    out = []
    while type(path) is tuple:
        path, c = path
        out.append(c)
    return path + "".join(reversed(out))


class Restorer:
    """Restores words under a character model."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.cache = Recent(self._restore)
        self.joins = Recent(lambda letters: self._join(letters[:2], letters[2:]))

    def decode(self, token: str) -> str:
        """Likeliest reading of ``token``; words of another script are read in it, or as Latin ones in disguise."""
        letters = {c for c in token if c.isalpha()}
        look = letters & LOOKALIKES.keys()
        if not look or not all("\u0400" <= c <= "\u052f" for c in letters):
            return self._likeliest(token)[1]
        own = self._likeliest(token, own=True)
        if len(letters) > len(look):
            return own[1]
        return max(own, self._likeliest(token))[1]

    def _likeliest(self, token: str, own: bool = False) -> tuple[float, str]:
        """Score and text of the best reading: Viterbi over the lattice, states being the last two symbols.

        Time is linear in the token; readings are kept only as far back as they differ.
        """
        model = self.model
        states: dict[tuple[int, int], tuple[float, str | tuple]] = {(0, 0): (0.0, "")}
        done = []
        for step, ((sign, _), ways) in enumerate(zip(groupby(token), lattice(token, own), strict=True), 1):
            shown = SHOWN + sign  # a letter outside the model stays what it is
            after: dict[tuple[int, int], tuple[float, str | tuple]] = {}
            for (a, b), (score, path) in states.items():
                for symbols, cost in ways:
                    x, y, s, way = a, b, score - cost, path
                    for c in symbols:
                        s += model[(x * SYMBOLS + y) * SYMBOLS + c]
                        x, y, way = y, c, (way, shown[c])
                    best = after.get((x, y))
                    if best is None or s > best[0]:
                        after[x, y] = (s, way)
            states = after
            if step % WINDOW == 0:
                texts = [_spelled(path) for _, path in states.values()]
                done.append(commonprefix(texts))
                n = len(done[-1])
                states = {k: (v[0], t[n:]) for (k, v), t in zip(states.items(), texts, strict=True)}
        score, path = max(
            ((score + model[(a * SYMBOLS + b) * SYMBOLS], path) for (a, b), (score, path) in states.items()),
            key=lambda found: found[0],
        )
        return score, ("".join(done) + _spelled(path)).strip()

    def _restore(self, token: str) -> str:
        token = token.rstrip(" !|") or token  # such signs after a word are marks
        core = token.strip(TRIM) if not token[0] in LOOKALIKES and not token[-1] in LOOKALIKES else token
        if core.isalpha():
            if not any(a == b for a, b in zip(core, core[1:])) and not any(c in LOOKALIKES for c in core):
                return core  # one path only
        elif not any(c.isalpha() for c in core):
            return self._restore_signs(core) or token
        return self.decode(core)

    def _restore_signs(self, core: str) -> str:
        """The word that signs alone stand for; empty where the signs as they are (a number, marks) are likelier."""
        if len({c for c in core if c in LOOKALIKES}) < 2:
            return ""  # one letter at most, again and again
        score, found = self._likeliest(core)
        kept = sum(
            UNCHANGED_DIGIT if c.isdigit() else UNCHANGED_SIGN if c in LOOKALIKES else 0.0 if c == " " else JOINED
            for c in core
        )
        return found if score > -kept else ""

    def _join(self, ends: str, begins: str) -> bool:
        """Whether a word is likelier to go on from ``ends`` to ``begins``, two letters or borders each, than to end there."""
        model, (a, b, c, d) = self.model, [0 if x == " " else NUMBER.get(x, OTHER) for x in ends + begins]
        at = lambda x, y, z: model[(x * SYMBOLS + y) * SYMBOLS + z]
        joined = at(a, b, c) + at(b, c, d)
        return joined - at(a, b, 0) - at(b, 0, c) - at(0, c, d) > PIECES

    def _whole(self, tokens: list[str]) -> list[str]:
        """``tokens`` with words put together that blanks cut into short pieces."""
        out, open_ = [], False  # whether the last one may be a piece that goes on
        for token in tokens:
            piece = token if token.isalpha() else token.rstrip(TRIM + "!")
            short = len(piece) <= PIECE and piece.isalpha()
            if open_ and short and self.joins[f" {out[-1][-2:]}"[-2:] + f"{piece[:2]} "[:2]]:
                out[-1] += token
            else:
                out.append(token)
            open_ = short and piece == token
        return out

    def words(self, text: str | None) -> list[str]:
        """The restored words of a text, in lower case; spelled-out words are joined."""
        tokens = (text or "").lower().split()
        single = [i for i, token in enumerate(tokens) if len(token) == 1]
        out, done, k = [], 0, 0
        while k < len(single):
            j = k
            while j + 1 < len(single) and single[j + 1] == single[j] + 1:
                j += 1
            if j - k >= 2:
                out += tokens[done : single[k]]
                out.append(" ".join(tokens[single[k] : single[j] + 1]))
                done = single[j] + 1
            k = j + 1
        out += tokens[done:]
        cache = self.cache
        return [cache[token] if len(token) <= CACHED else self._restore(token) for token in self._whole(out)]


def restore(df: DataFrame, model: np.ndarray, text: str = "text", into: str = "restored") -> DataFrame:
    """``df`` with the restored words of ``text``, joined by spaces; NULL is empty text."""

    def start():
        restorer = Restorer(model)
        return lambda texts: [pa.array([" ".join(restorer.words(t)) for t in texts], pa.string())]

    return mapped(df, text, {into: "string"}, start)


def word_features(word: str) -> list[str]:
    """A restored word and its beginnings, which inflected forms share."""
    out = []
    for w in word.split():
        w = w.strip(TRIM)
        if w:
            out.append(w)
            out += [w[:k] + "*" for k in (4, 5) if len(w) > k]
    return out


@dataclass
class ToxicityModel:
    """Weights of words, calibration of a document's heaviest; constant without both classes."""

    weights: dict[str, float] = field(default_factory=dict)
    coefficients: np.ndarray | None = None
    constant: float = 0.5

    def weight(self, word: str) -> float:
        return max([0.0, *(self.weights.get(f, 0.0) for f in word_features(word))])

    def features(self, of: Recent, words: list[str]) -> tuple[float, float, float, float]:
        found = [w for w in map(of.__getitem__, set(words)) if w]
        found.sort(reverse=True)
        first, second = (found + [0.0, 0.0])[:2]
        return first, second, math.log1p(sum(found[:20])), math.log1p(len(words))

    def scores(self, of: Recent, texts: list[list[str]]) -> np.ndarray:
        if self.coefficients is None:
            return np.full(len(texts), self.constant)
        return probability(np.array([self.features(of, t) for t in texts]).reshape(-1, 4), self.coefficients)


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, label: str = "toxic", per_class=PER_CLASS) -> ToxicityModel:
    """Fit on at most ``per_class`` rows of label 0 and 1, restored; a third of them calibrates."""

    def restored(df: DataFrame) -> DataFrame:
        return restore(df, model).select("doc_id", F.col("restored").alias("text"), "label")

    rows = sample(docs, labels, label, per_class, restored)
    y = rows.labels
    calibrates = np.zeros(len(y), bool)
    for k in (0, 1):
        calibrates[np.flatnonzero(y == k)[::3]] = True
    total = [int(((y == k) & ~calibrates).sum()) for k in (0, 1)]
    share = [float((y == k).sum() * rows.weights[k]) for k in (0, 1)]
    constant = share[1] / sum(share) if sum(share) else 0.5
    if not min(*total, *((y == k).sum() for k in (0, 1))):
        return ToxicityModel(constant=constant)

    def found_in(k: int) -> Iterator[set[str]]:
        for text, v, late in zip(rows.texts, y, calibrates, strict=True):
            if v == k and not late:
                yield {f for w in set(text.split(" ")) for f in word_features(w)}

    toxic = Counter(f for features in found_in(1) for f in features)
    toxic = {f: n for f, n in toxic.items() if n > 1}
    clean = Counter(f for features in found_in(0) for f in features if f in toxic)
    weights = {}
    for f, a in toxic.items():
        b = clean[f]
        odds = math.log((a + 0.5) / (total[1] + 1)) - math.log((b + 0.5) / (total[0] + 1))
        sure = odds - 1.3 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))  # at the lower end of its range
        if sure > 0.7:
            weights[f] = sure
    weights = dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:MOST_WORDS])
    found = ToxicityModel(weights, constant=constant)
    of = Recent(found.weight)
    x = np.array([found.features(of, t.split(" ")) for t, late in zip(rows.texts, calibrates, strict=True) if late])
    found.coefficients = fit_logistic(x, y[calibrates], rows.weights)
    return found


def score(df: DataFrame, model: np.ndarray, toxicity: ToxicityModel, text: str = "text", into: str = "score") -> DataFrame:
    """``df`` with the probability ``into`` of label 1 of the restored text; NULL is empty text."""

    def start():
        restorer, of = Restorer(model), Recent(toxicity.weight)
        return lambda texts: [pa.array(toxicity.scores(of, [restorer.words(t) for t in texts]), pa.float64())]

    return mapped(df, text, {into: "double"}, start)


def op1_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Probability that ``labels.toxic`` is 1, for every document's whole text."""
    model = character_model(docs)
    scored = score(docs.select("doc_id", "text"), model, fit(docs, labels, model))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
