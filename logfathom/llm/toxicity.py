"""Toxicity by a fuzzy lexicon and its context, learned from labels.

Fitting takes labelled rows and counts, in how many toxic and clean documents, every word and
every beginning of a word occurs. Those that mark toxic documents make the lexicon: words, and
stems that any ending may follow. It is kept as a trie. Each word of a text is turned into a
Levenshtein automaton (bit sets of the positions reached with no edit and with one), which walks
the trie: exact words, words one edit away, and stems are found in one pass. A look at the words
around a hit tells use from mention: between quotation marks, or near words of report, it counts
as a quotation. Hits become a few features, weighed by logistic regression on the same rows.

Cases: a null or empty text has no hits and gets the score of a text without any; repeated rows
score alike; rows without a label (no row in ``labels``, or a null ``toxic``) are scored and not
fitted; when labels hold one class only, scores tend to that class's share; an empty table gives
an empty result. Only ``doc_id`` and ``text``, and of the labels ``doc_id`` and ``toxic``, are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, staged, text_of

#: Labelled rows that fitting uses, about. This is the documented bound of the sample.
FIT_ROWS = 6_000
#: An entry occurs in so many toxic documents at least, and is so much likelier there (log odds).
SUPPORT, ODDS = 4, 3.0
#: Letters of stems, and of words that are also looked for with an edit.
STEM_LETTERS, FUZZY_LETTERS = (4, 8), 5
#: Words to each side of a hit that are its context, and words that report what others said.
CONTEXT = 6
REPORTING = frozenset("said says wrote writes called calls quoted quote quotes word term slur "
                      "reported according".split())
QUOTES = frozenset("\"'“”„«»‘’")
#: Words a worker remembers (it starts anew beyond them), and the most letters of one.
REMEMBERED, LONGEST = 150_000, 64

WORD = re.compile(r"[^\W_]+")
FEATURES = 6
END = ""


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the doc_id as text is divisible by 5; these rows are not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Lexicon:
    """Words and stems in a trie, searched with Levenshtein automata."""

    def __init__(self, words: dict[str, float], stems: dict[str, float],
                 benign: frozenset[str] = frozenset()) -> None:
        self.words, self.stems, self.benign = words, stems, benign
        self.trie: dict = {}
        for entry, kind in [*((w, 0) for w in words), *((s, 1) for s in stems)]:
            node = self.trie
            for letter in entry:
                node = node.setdefault(letter, {})
            node.setdefault(END, []).append((entry, kind))
        # One edit leaves the first or the second half of a word as it is (pigeonhole), so other
        # words need no walk: this only saves time.
        self.heads = {w[:len(w) // 2] for w in words if len(w) >= FUZZY_LETTERS}
        self.tails = {w[len(w) // 2:] for w in words if len(w) >= FUZZY_LETTERS}
        self.head_sizes = sorted({len(h) for h in self.heads})
        self.tail_sizes = sorted({len(t) for t in self.tails})
        self.stem_sizes = sorted({len(s) for s in stems})
        self.known: dict[str, tuple[float, bool] | None] = {}

    def find(self, word: str) -> tuple[float, bool] | None:
        """Weight of the best entry a word matches, and whether it took an edit."""
        if word in self.known:
            return self.known[word]
        found = self._search(word) if self._may_match(word) else None
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(word) <= LONGEST:
            self.known[word] = found
        return found

    def _may_match(self, word: str) -> bool:
        return (word in self.words
                or any(word[:k] in self.stems for k in self.stem_sizes)
                or any(word[:k] in self.heads for k in self.head_sizes)
                or any(word[-k:] in self.tails for k in self.tail_sizes))

    def _search(self, word: str) -> tuple[float, bool] | None:
        n = len(word)
        # Bit i+1 of masks[c]: letter c takes the automaton from position i to i+1.
        masks: dict[str, int] = {}
        for i, letter in enumerate(word):
            masks[letter] = masks.get(letter, 0) | 2 << i
        every, last = (2 << n) - 1, 1 << n
        best: tuple[float, bool] | None = None
        # exact, edited: positions of the word reached with no edit and with one at most.
        todo = [(self.trie, 1, 3 & every)]
        while todo:
            node, exact, edited = todo.pop()
            for entry, kind in node.get(END, ()):
                if kind and exact:
                    hit = (self.stems[entry], False)
                elif not kind and exact & last:
                    hit = (self.words[entry], False)
                elif not kind and edited & last and len(entry) >= FUZZY_LETTERS \
                        and word not in self.benign:
                    hit = (self.words[entry], True)
                else:
                    continue
                if best is None or (hit[1], -hit[0]) < (best[1], -best[0]):
                    best = hit
            for letter, below in node.items():
                if letter == END:
                    continue
                mask = masks.get(letter, 0)
                same = exact << 1 & mask
                # one more letter in the entry, another letter, or (from same) one less
                other = (edited << 1 & mask | exact | exact << 1 | same << 1 | same) & every
                if other:
                    todo.append((below, same, other))
        return best

    def features(self, text: str) -> list[float]:
        """Hits in use, in quotation and with an edit; the largest weights of each; their share."""
        text = text.lower()
        find, hits = self.find, []
        words = WORD.findall(text)
        for word in set(words):
            found = find(word)
            if found:
                hits.append((word, *found))
        out = [0.0] * FEATURES
        if not hits:
            return out
        weight = {word: (value, edited) for word, value, edited in hits}
        spots = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
        for i, (begin, end, word) in enumerate(spots):
            if word not in weight:
                continue
            value, edited = weight[word]
            if self._quoted(text, spots, i):
                out[2] += 1
                out[3] = max(out[3], value)
            elif edited:
                out[1] += 1
            else:
                out[0] += 1
                out[4] = max(out[4], value)
        out[5] = math.log1p(1000.0 * (out[0] + 0.5 * out[1]) / len(spots))
        return [math.log1p(v) if i < 3 else v for i, v in enumerate(out)]

    @staticmethod
    def _quoted(text: str, spots: list[tuple[int, int, str]], i: int) -> bool:
        low, high = spots[max(0, i - CONTEXT)], spots[min(len(spots) - 1, i + CONTEXT)]
        before, after = text[low[0]:spots[i][0]], text[spots[i][1]:high[1]]
        if any(q in before for q in QUOTES) and any(q in after for q in QUOTES):
            return True
        return any(s[2] in REPORTING for s in spots[max(0, i - CONTEXT):i])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, toxic and clean, that each word and each stem of a task's rows occurs in."""
    toxic, clean = Counter(), Counter()
    low, high = STEM_LETTERS
    for batch in batches:
        for text, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
            words = set(WORD.findall(text.lower()))
            terms = words | {w[:k] + "*" for w in words for k in range(low, min(high, len(w)) + 1)}
            (toxic if label else clean).update(terms)
    # What is clean only and rare tells nothing, whatever other tasks have met.
    terms = list(toxic.keys() | {t for t in clean if t[-1] != "*"})
    yield pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()),
         pa.array([clean[t] for t in terms], pa.int64())], ["term", "toxic", "clean"])
    rest = [t for t in clean if t[-1] == "*" and t not in toxic]
    yield pa.RecordBatch.from_arrays(
        [pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()),
         pa.array([clean[t] for t in rest], pa.int64())], ["term", "toxic", "clean"])


class Model:
    """A lexicon and the weights of its features."""

    def __init__(self, lexicon: Lexicon, weights: list[float]) -> None:
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str) -> float:
        total = self.weights[0] + sum(w * f for w, f in
                                      zip(self.weights[1:], self.lexicon.features(text)))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, total))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first weight is the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-3, *[ridge] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (p - y) + penalty @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn lexicon and weights from labelled rows that are not held out.

    When there are more than about ``rows`` of them, those with the smallest hash of the doc_id
    are taken. Lexicon (all terms of these rows that pass SUPPORT and ODDS)
    and features (``rows`` x 6 numbers) go to the driver.
    """
    usable = (labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
              .filter(F.col("toxic").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id"))
              .groupBy("_id").agg(F.max("toxic").alias("toxic")))
    share = min(1.0, rows / max(1, usable.count()))
    picked = usable.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    train = staged(picked.join(docs.select("doc_id", text_of().alias("text")),
                               F.col("_id") == F.col("doc_id")).select("text", "toxic"), "labelled")
    sizes = train.agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"),
                      F.count(F.lit(1)).alias("all")).first()
    n_toxic, n_clean = sizes["toxic"] or 0, sizes["all"] - (sizes["toxic"] or 0)
    terms = (train.withColumn("toxic", (F.col("toxic") > 0).cast("int"))
             .mapInArrow(_count, "term string, toxic long, clean long")
             .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    terms = staged(terms, "terms")
    odds = F.log(((F.col("toxic") + 0.5) / (n_toxic + 1.0)) / ((F.col("clean") + 0.5) / (n_clean + 1.0)))
    # Shorter stems stand for what all their continuations share, so they come first on a tie.
    entries = (terms.filter(F.col("toxic") >= SUPPORT).withColumn("odds", odds)
               .filter(F.col("odds") >= ODDS)
               .orderBy(F.desc(F.col("odds") * F.log1p("toxic")), F.length("term"), "term")
               .collect())
    words = {r["term"]: r["odds"] for r in entries if r["term"][-1] != "*"}
    stems: dict[str, float] = {}
    for r in entries:
        stem = r["term"][:-1]
        # A stem adds nothing when a shorter one or one whole word already covers it.
        if r["term"][-1] == "*" and not any(stem.startswith(s) for s in stems) \
                and not any(w.startswith(stem) and words[w] >= r["odds"] for w in words):
            stems[stem] = r["odds"]
    lexicon = Lexicon(words, stems)
    # Words one edit away that clean documents use are words of their own.
    near = terms.filter((F.col("clean") > F.col("toxic")) & ~F.endswith(F.col("term"), F.lit("*")))
    benign = near.mapInArrow(_near(lexicon), "term string").collect() if words else []
    lexicon = Lexicon(words, stems, frozenset(r["term"] for r in benign))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.features(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["toxic"], pa.array(found, pa.list_(pa.float64()))], ["toxic", "features"])

    seen = train.mapInArrow(featured, "toxic int, features array<double>").collect()
    x = np.array([r["features"] for r in seen], float).reshape(len(seen), FEATURES)
    y = np.array([float(r["toxic"] > 0) for r in seen])
    return Model(lexicon, _logistic(x, y).tolist())


def _near(lexicon: Lexicon):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edited = [t for t in batch["term"].to_pylist() if (lexicon.find(t) or (0, False))[1]]
            yield pa.RecordBatch.from_arrays([pa.array(edited, pa.string())], ["term"])
    return near


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The documents with a column of scores: 0 to 1, higher where toxic is likelier."""
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        kept(("toxicity",), dict)
        return texts.map(model.score).astype(float)

    return docs.withColumn(name, scored(text_of()))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    return (score(docs.select("doc_id", "text"), fit(docs, labels))
            .select("doc_id", held_out().alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    return (score(docs, fit(docs, labels), "__toxicity").filter(F.col("__toxicity") < 0.5)
            .drop("__toxicity"))
