"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Texts are folded (lower case, compatibility forms, homoglyphs, digit and sign substitutions
inside words, accents), every word gets a boundary mark in front, and one automaton finds all
lexicon entries and exception phrases in a single pass. Hits inside an exception phrase do not
count. The weighted hits are normalised by length and turned into a score by a logistic curve.

The lexicon is a fixed seed list plus entries learned from labelled rows: word beginnings whose
share among toxic texts stands out. Learning reads a bounded sample (``SAMPLE`` rows of each
label, by hash order, a documented parameter) and counts all labelled rows: sampled rows stand for
those of their label, so a score means the same at every size. Scoring reads every whole text, as a
map without a shuffle, with the lexicon (at most ``LEXICON`` entries) inside the closure.

Defined cases: null or empty text has no hit and gets the score of a text without hits; with no
labelled rows the seed list and default curve are used; repeated label rows count once per
document, toxic if any says so; repeated documents are scored alike; columns of the input other
than the outputs are kept.
"""

from __future__ import annotations

import bisect
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, lean

#: Labelled rows of each label that training reads at most.
SAMPLE = 2500
#: Learned lexicon entries at most.
LEXICON = 400
#: Word beginnings of these many characters are candidates for the lexicon.
STEMS = range(4, 11)
THRESHOLD = 0.3

#: Seed weights of abusive words.
SEED = {
    "idiot": 3.0, "moron": 3.0, "scum": 3.0, "stupid": 2.5, "worthless": 2.5, "pathetic": 2.5, "disgusting": 2.5,
    "loser": 2.5, "trash": 2.0, "clown": 2.0, "imbecile": 3.0, "bastard": 3.0, "asshole": 3.5, "bitch": 3.5,
    "fuck": 3.5, "shit": 3.0, "retard": 3.5, "dumbass": 3.5, "slut": 3.5, "whore": 3.5, "subhuman": 3.5, "vermin": 2.0,
}

#: Harmless phrases that contain a seed word.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "clown fish", "clownfish", "class clown", "circus clown", "sore loser rule",
    "idiot proof", "idiot light", "scum line", "pond scum", "disgusting taste test", "stupid simple", "trash collection",
)

#: Letters that look like Latin ones.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏкмтвнαορτυνικβεηωɡɩ", "aeopcyxijsdhlkmtbhaoptuvikbenwgi", strict=True))
#: Digits and signs that stand for letters inside words.
LEET = dict(zip("013457@$!|", "oieastasil", strict=True))

BOUNDARY = "\x02"


class Folding(dict):
    """Character map for ``str.translate``; entries appear as characters are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        c = unicodedata.normalize("NFKC", c).lower()
        c = "".join(HOMOGLYPHS.get(x, x) for x in c)
        c = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        made = "".join(x if x.isalpha() or x in LEET or x.isdigit() else "" if unicodedata.category(x) == "Cf" else " " for x in c)
        self[code] = made
        return made


_FOLDING = Folding()
_LEET_TABLE = str.maketrans(LEET)


def words_of(text: str) -> list[str]:
    """Folded words. Substitutions are undone only in words that also hold a letter, so numbers stay numbers."""
    out = []
    for w in text.translate(_FOLDING).split():
        if not w.isalpha():
            w = w.rstrip("!|")
            if any(c.isalpha() for c in w):
                w = w.translate(_LEET_TABLE)
        if w:
            out.append(w)
    return out


@dataclass
class Lexicon:
    """Entries are word beginnings with weights; whole exception phrases mask hits below them."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-4.0, 2.0, 1.0)  # bias, log of weighted hits a 100 words, log of weighted hits
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for stem, weight in self.weights.items():
                made.add_word(BOUNDARY + stem, (len(stem) + 1, weight))
            for phrase in self.exceptions:
                folded = "".join(BOUNDARY + w for w in words_of(phrase))
                made.add_word(folded + BOUNDARY, (len(folded) + 1, 0.0))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def features(self, text: str | None) -> tuple[float, float, int]:
        """Logs of weighted hits a 100 words and of weighted hits, and the count of words hit."""
        words = words_of(text) if text else []
        line = BOUNDARY + BOUNDARY.join(words) + BOUNDARY
        best: dict[int, float] = {}
        masked: list[tuple[int, int]] = []
        if self.weights or self.exceptions:
            for end, (size, weight) in self.automaton().iter(line):
                start = end - size + 1
                if weight:
                    best[start] = max(best.get(start, 0.0), weight)  # the strongest entry of a word counts
                else:
                    masked.append((start, end))
        if masked:
            # phrases end in ascending order; of those that end behind a hit the earliest start decides
            ends, starts = [b for _, b in masked], [a for a, _ in masked]
            for k in range(len(starts) - 2, -1, -1):
                starts[k] = min(starts[k], starts[k + 1])
            best = {s: w for s, w in best.items() if (k := bisect.bisect_right(ends, s)) == len(ends) or starts[k] > s}
        total = sum(best.values())
        return math.log1p(100 * total / max(len(words), 20)), math.log1p(total), len(best)

    def score(self, text: str | None) -> float:
        density, amount, _ = self.features(text)
        bias, a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + a * density + b * amount))))


def learn(rows: list[tuple[str, int]], stands_for: tuple[float, float] = (1.0, 1.0)) -> Lexicon:
    """A lexicon from (text, label) pairs. One half of the rows picks and weighs entries, the other
    fits the curve and checks each entry, so that chance entries do not look better than they are.
    ``stands_for`` has, by label, how many labelled rows each of ``rows`` stands for in the curve."""
    same: dict[str, str] = {}  # of equal words one stays in memory
    rows = [([same.setdefault(w, w) for w in words_of(t or "")], int(y)) for t, y in rows]
    del same
    if not {y for _, y in rows} >= {0, 1}:
        return Lexicon(dict(SEED))
    by_label = [[r for r in rows if r[1] == y] for y in (0, 1)]
    sides = [[r for own in by_label for r in own[k::2]] for k in (0, 1)]  # each half has its share of either label
    counts = []
    for side in sides:
        hit, miss = Counter(), Counter()
        for words, y in side:
            (hit if y else miss).update({w[:k] for w in words for k in STEMS if k <= len(w)})
        counts.append((hit, miss, sum(y for _, y in side), sum(1 - y for _, y in side)))
    found: dict[str, float] = {}
    for stem, a in counts[0][0].items():
        if a < 3 or counts[1][0][stem] < 2:
            continue
        odds = []
        for hit, miss, n1, n0 in counts:
            unsure = math.sqrt(1 / (hit[stem] + 0.5) + 1 / (miss[stem] + 0.5))
            odds.append(math.log((hit[stem] + 0.5) / (n1 + 1)) - math.log((miss[stem] + 0.5) / (n0 + 1)) - 0.7 * unsure)
        if min(odds) > 1.2:
            found[stem] = min(odds)
    seen = lambda stem: [x[stem] for side in counts for x in side[:2]]
    longer = {w[:-1] for w in found if w[:-1] in found and seen(w) == seen(w[:-1])}  # says no more than its one continuation
    found = {w: x for w, x in found.items() if w not in longer}
    weights = dict(sorted(found.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:LEXICON])
    weights = {w: x for w, x in weights.items() if not any(weights.get(w[:k], 0) >= x for k in range(4, len(w)))}
    known = [s for s in SEED if not any(s[:k] in weights for k in range(4, len(s) + 1))]
    lexicon = Lexicon(weights | {s: SEED[s] for s in known})
    lexicon.curve = fit_curve([(*lexicon.features(" ".join(w))[:2], y) for w, y in rows], stands_for)
    return lexicon


def fit_curve(points: list[tuple[float, float, int]], stands_for: tuple[float, float] = (1.0, 1.0), steps: int = 60, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression by damped Newton steps; points are weighted by their label."""
    import numpy as np

    x = np.array([(1.0, a, b) for a, b, _ in points])
    y = np.array([c for _, _, c in points], float)
    many = np.where(y > 0, stands_for[1], stands_for[0])
    w = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (many * (p - y)) + ridge * w
        hess = (x * (many * p * (1 - p))[:, None]).T @ x + (ridge + 1e-3) * np.eye(3)
        w = w - np.linalg.solve(hess, grad)
    return tuple(float(v) for v in w)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[tuple[str, int]], tuple[float, float]]:
    """The bounded sample, of each label the ``sample`` first rows by a hash of the id, and by label
    how many labelled rows one of the sample stands for."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.agg(*[F.count_if(c).alias(n) for n, c in (("clean", F.col("toxic") <= 0), ("toxic", F.col("toxic") > 0))]).first()
    picked = None
    for y in (0, 1):
        part = known.filter((F.col("toxic") > 0) if y else (F.col("toxic") <= 0)).select("doc_id", F.lit(y).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * sample rows: the side that is broadcast is bounded by the parameter
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return [(r.text, r.toxic) for r in sorted(rows.collect(), key=lambda r: r.doc_id)], tuple(max(1.0, n / sample) for n in total)


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Adds ``score`` and ``n_hits`` to ``docs``; every whole text is read."""
    kept = [c for c in docs.columns if c.lower() not in {"score", "n_hits"} or c == text]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("n_hits", T.LongType())])
    at = kept.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                texts = batch.column(at).to_pylist()
                made = [lexicon.features(t) for t in texts]
                bias, a, b = lexicon.curve
                scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, bias + a * x + b * y)))) for x, y, _ in made]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([n for _, _, n in made], pa.int64())], names=schema.names)

    return docs.mapInArrow(lean(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(*training_rows(docs, read_table(spark, sf_dir, "labels")))
    out = score(docs, lexicon)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "n_hits")
