"""Toxicity by a weighted lexicon: folding, an Aho-Corasick scan, exceptions, length normalisation.

The lexicon's terms and weights are learned from labelled rows (word beginnings and whole words whose
rate among words differs), on top of fixed seed terms; a logistic curve turns a text's length-normalised
weights into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import dropped, written

#: Labelled rows that are learned from at most, those of least hash; the classifier's sample bound.
TRAIN_ROWS = 8000
#: Evidence that a term needs, as a G statistic: 22 is about three chances in a million.
MIN_EVIDENCE = 22.0
#: What a term needs besides: times the rate among words, and times the share of rows, of the other texts.
MIN_RATE, MIN_SHARE = 3.0, 2.0
#: The curve before any row is seen, and how strongly a fit is drawn to it.
START_CURVE, RIDGE = (-4.0, 1.0, 1.0), 0.05

#: Terms that count without labels; whole words.
SEED_TERMS = ("idiot", "moron", "imbecile", "scumbag", "scum", "worthless", "pathetic", "disgusting", "stupid", "loser", "dumbass", "retard", "trash")
SEED_WEIGHT = 4.0
#: Phrases inside which a term is meant otherwise.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bag", "trash collection", "trash pickup", "clown fish", "clown college",
    "idiot proof", "idiot light", "stupid simple", "loser bracket", "losers bracket", "pond scum", "soap scum",
)

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "υ": "u", "ν": "v", "ѡ": "w", "х": "x", "у": "y", "α": "a", "ε": "e", "ι": "i", "κ": "k",
    "ο": "o", "ρ": "p", "τ": "t", "ϲ": "c", "ı": "i", "ɡ": "g", "ʟ": "l", "ᴏ": "o", "ѐ": "e", "ё": "e",
}
#: Digits and signs that stand for letters between letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}

_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()}
_FOLD |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_FOLD |= {c: "" for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD)}
_SUBST = str.maketrans(SUBSTITUTES)
_INSIDE = re.compile(r"(?<!\w)[0-9@$]{1,2}(?=[^\W\d_]\w)|(?<=[^\W\d_])[0-9@$!|]{1,3}(?=[^\W\d_])")
_APART = re.compile(r"(?<![^\W_])[^\W_](?:[.\-_*][^\W_]){3,}(?![^\W_])")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
# Cheap looks that tell whether the steps above have anything to do; most texts need none of them.
_ODD = re.compile("[" + "".join(map(chr, _FOLD)) + "]")
_SIGNS = re.compile(r"[0-9@$!|]")
_DOTTED = re.compile(r"[.\-_*]\w[.\-_*]")
_FAR_GAPS = re.compile(r"[^\x00-\x7F\w]|[^\x00-\x7F\D]")
_GAPS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def fold(text: str | None) -> str:
    """Words of lower-case letters between single spaces, with one in front and one behind.

    Homoglyphs become Latin, digits and signs between letters the letters they stand for, letters set
    apart by dots or hyphens a word. A null text is empty.
    """
    if not text:
        return " "
    low = text.lower()
    if not low.isascii() and _ODD.search(low):
        low = low.translate(_FOLD)
    if _SIGNS.search(low):
        low = _INSIDE.sub(lambda m: m.group().translate(_SUBST), low)
    if _DOTTED.search(low):
        low = _APART.sub(lambda m: re.sub(r"[.\-_*]", "", m.group()).translate(_SUBST), low)
    if not low.isascii() and _FAR_GAPS.search(low):
        low = _NOT_LETTERS.sub(" ", low)
    words = low.encode("utf-8", "surrogatepass").translate(_GAPS).split()
    return f" {b' '.join(words).decode('utf-8', 'surrogatepass')} " if words else " "


def features(folded: str) -> Counter:
    """Counts of the candidate terms of a folded text: word beginnings of 3 to 8 letters, and words."""
    out: Counter = Counter()
    for word, n in Counter(folded.split()).items():
        out[f" {word} "] += n
        for k in range(3, min(8, len(word)) + 1):
            out[" " + word[:k]] += n
    return out


@dataclass(frozen=True)
class Lexicon:
    """Weighted terms (a leading or trailing space is a word's edge), exceptions, logistic weights."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = START_CURVE
    _built: list = field(default_factory=list, compare=False, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_built": []}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def automaton(self) -> ahocorasick.Automaton:
        if not self._built:
            out = ahocorasick.Automaton()
            for phrase in self.exceptions:
                folded = fold(phrase)
                out.add_word(folded, (len(folded), 0.0))
            for term, weight in self.terms.items():
                if term not in out:
                    out.add_word(term, (len(term), weight))
            out.make_automaton()
            self._built.append(out)
        return self._built[0]

    def weights(self, folded: str) -> list[float]:
        """Weights of the longest term at each word, but those inside an exception phrase."""
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        if not self.terms and not self.exceptions:
            return []
        for last, (length, weight) in self.automaton().iter(folded):
            start = last - length + 1
            if weight == 0.0:
                spared.append((start, last))
            elif start not in best or best[start][0] < length:
                best[start] = (length, weight)
        if not spared:
            return [w for _, (_, w) in sorted(best.items())]
        spared.sort()
        out, i, until = [], 0, -1
        for at, (_, w) in sorted(best.items()):
            while i < len(spared) and spared[i][0] <= at:
                until = max(until, spared[i][1])
                i += 1
            if at >= until:
                out.append(w)
        return out


def inputs(lexicon: Lexicon, text: str | None) -> list[float]:
    """What the curve weighs: one, the sum of weights, the sum for each 100 words."""
    folded = fold(text)
    weights = lexicon.weights(folded)
    total, n = sum(weights), max(1, folded.count(" ") - 1)
    return [1.0, math.log1p(total), math.log1p(100 * total / n)]


def _telling(counts: DataFrame, words: tuple[int, int], rows: tuple[int, int]) -> DataFrame:
    """The rows of ``counts(term, t, o, dt, do)`` whose rate, share of rows and evidence suffice: (term, t, rate, sure).

    ``t`` and ``o`` are occurrences in toxic and in other texts, ``dt`` and ``do`` the texts that have the
    term, ``rate`` the logarithm of the quotient of the rates, ``sure`` the G statistic of the texts.
    """
    t, o, dt, do = (F.col(c).cast("double") for c in ("t", "o", "dt", "do"))
    rate = (t + 0.5) / (words[0] + 1) / ((o + 0.5) / (words[1] + 1))
    share = (dt + 0.5) / (rows[0] + 1) / ((do + 0.5) / (rows[1] + 1))
    toxic = rows[0] / max(1, sum(rows))
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    sure = 2 * (part(dt, (dt + do) * toxic) + part(do, (dt + do) * (1 - toxic)))
    found = counts.select("term", "t", F.log(rate).alias("rate"), share.alias("share"), sure.alias("sure"))
    return found.where((F.col("rate") > math.log(MIN_RATE)) & (F.col("share") > MIN_SHARE) & (F.col("sure") > MIN_EVIDENCE)).select("term", "t", "rate", "sure")


def chosen_terms(found: Iterable[tuple[str, int, float, float]]) -> dict[str, float]:
    """Weigh the telling terms (term, occurrences, rate, evidence) by their rates.

    A word beginning that one longer term accounts for nearly always gives way to that one, and a longer
    term stays only where its weight differs from that of the term it lengthens.
    """
    known = {term: (t, rate) for term, t, rate, _ in found}
    longest: dict[str, int] = {}
    for term, (t, _) in known.items():
        for k in range(4, len(term)):
            longest[term[:k]] = max(longest.get(term[:k], 0), t)
    kept: dict[str, float] = {}
    for term in sorted((x for x, v in known.items() if longest.get(x, 0) < 0.9 * v[0]), key=lambda x: (len(x), x)):
        base = next((kept[term[:k]] for k in range(len(term) - 1, 3, -1) if term[:k] in kept), None)
        if base is None or abs(known[term][1] - base) > 0.25:
            kept[term] = known[term][1]
    return kept


def fit_curve(rows: np.ndarray, toxic: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method, drawn to ``START_CURVE`` by a small ridge; no rows give that curve.

    A step that would not lower the loss is halved, so the fit settles from any start.
    """
    start = np.array(START_CURVE)

    def loss(weights: np.ndarray) -> float:
        z = rows @ weights
        return float(np.sum(np.logaddexp(0, z) - toxic * z) + RIDGE / 2 * np.sum((weights - start) ** 2))

    weights, now = start.copy(), loss(start)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        gradient = rows.T @ (p - toxic) + RIDGE * (weights - start)
        hessian = (rows * (p * (1 - p))[:, None]).T @ rows + RIDGE * np.eye(len(weights))
        step = np.linalg.solve(hessian, gradient)
        while (after := loss(weights - step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        if np.abs(step).max() < 1e-9:
            break
        weights, now = weights - step, after
    return tuple(float(w) for w in weights)


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the doc_id's text leaves ``fold``; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds)) == fold


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learn a lexicon and its curve from labelled rows that aren't held out, ``TRAIN_ROWS`` at most.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` ``doc_id`` and ``toxic``; other columns are ignored.
    Labels without doc_id or value don't count; of labels that repeat a doc_id the highest counts, and of
    documents that repeat one each is a row. Null and empty texts have no terms. Without such rows, or with an
    empty table, the lexicon has its fixed terms and the curve its start.
    """
    wanted = labels.select(F.col("doc_id").cast("long").alias("key"), F.col("toxic").cast("int").alias("toxic"))
    wanted = wanted.where("key is not null and toxic is not null").where(~held_out(F.col("key")))
    wanted = wanted.groupBy("key").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("key"), "key").limit(TRAIN_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), F.col("doc_id") == F.col("key")).select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for b in batches:
            for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text"), strict=True):
                own = features(folded := fold(text.as_py()))
                own[""] = len(folded.split())
                for term, n in own.items():
                    at = seen.setdefault(term, [0, 0, 0, 0])
                    at[0 if toxic else 1] += n
                    at[2 if toxic else 3] += 1
        columns = list(zip(*seen.values(), strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["term", "t", "o", "dt", "do"])

    counts = rows.mapInArrow(count, "term string, t long, o long, dt long, do long")
    counts = written(counts.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("t", "o", "dt", "do"))), "terms")
    total = counts.where("term = ''").first() or ("", 0, 0, 0, 0)
    terms = {f" {w} ": SEED_WEIGHT for w in SEED_TERMS}
    terms |= chosen_terms(map(tuple, _telling(counts.where("term <> ''"), tuple(total[1:3]), tuple(total[3:5])).collect()))
    dropped(counts)
    lexicon = Lexicon(terms)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([inputs(lexicon, t.as_py()) for t in b.column("text")]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *(pa.array(x[:, i]) for i in range(3))], ["toxic", *"abc"])

    table = rows.mapInArrow(measure, "toxic int, a double, b double, c double").toPandas().sort_values(["b", "c", "toxic"])
    return Lexicon(terms, curve=fit_curve(table[list("abc")].to_numpy(), table["toxic"].to_numpy()))


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Score every whole text of ``docs(doc_id, text)``.

    Returns a row per row: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 if the score
    is 0.5 or more). Null and empty texts have no terms and get the score of a text without any; rows
    that repeat get equal scores; other columns are ignored; no rows, none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([inputs(lexicon, t.as_py()) for t in b.column("text")]).reshape(-1, 3)
            score = 1 / (1 + np.exp(-np.clip(x @ np.array(lexicon.curve), -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, lexicon: Lexicon, most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``most``, with all columns as they are.

    Null and empty texts score as texts without terms and stay; rows that repeat share their fate; an empty
    table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            at = b.schema.get_field_index("text") if at is None else at
            x = np.array([inputs(lexicon, t.as_py()) for t in b.column(at)]).reshape(-1, 3)
            score = 1 / (1 + np.exp(-np.clip(x @ np.array(lexicon.curve), -500, 500)))
            yield b.filter(pa.array(score < most))

    return docs.mapInArrow(run, docs.schema)
