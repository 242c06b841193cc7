"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding maps each character to one: to the lower-case base letter of its decomposition, look-alike letters
of other scripts and digits or signs written for letters to that letter, and i, l and what is read as either to
one letter.  So positions in the folded text are positions in the text.  A match counts when no letter or
digit of the text stands right before or after it, and it is not inside an exception phrase (a lexicon word
with a neighbour that the training rows show to be harmless).

The lexicon and its weights are learnt.  An entry is a whole word or a stem (the first STEM letters of words).
It speaks for label 1 by the log-ratio of its smoothed rates, per word of text, in the documents of either
label: LEAST_ODDS or more, over SUPPORT or more documents of label 1 and a hundredth of them.  A longer stem or
a word is left out where a stem of it says as much.  Where several entries match at one place, the heaviest
counts.  The score is a logistic function of the weighted matches and of the same normalised by length (per
100 words).
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import common as C
from corvane.llm.labels import labelled

# Letters of other scripts, digits and signs that are read as Latin letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʀ": "r", "ᴏ": "o", "ß": "s", "ø": "o", "ł": "l", "đ": "d",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "!": "i", "|": "i", "£": "l",
}
INVISIBLE = re.compile("[­̀-ͯ​-‏⁠﻿]")

#: Only the labelled rows are a bounded sample.  Entries and phrases follow from support and odds in it.
MAX_LABELLED, SUPPORT, LEAST_ODDS = 20_000, 8, 2.0
STEM = range(4, 10)
EDGES = ".,;:!?\"'()[]*#%&$|-"
_WORD = re.compile(r"[^\s]+")


class Fold(dict):
    """A table for str.translate that fills itself."""

    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKD", chr(code))[:1].lower() or " "
        c = LOOKALIKES.get(c, c)
        self[code] = c = "i" if c == "l" else c if len(c) == 1 else c[0]
        return c


def fold(text: str, table: Fold) -> str:
    return text.translate(table)


class Lexicon:
    def __init__(self, model: dict) -> None:
        import ahocorasick

        self.table, self.weights = Fold(), model["weights"]
        self.before, self.after = set(model["before"]), set(model["after"])
        self.a = ahocorasick.Automaton()
        for word in self.weights:  # a stem ends in "*"
            self.a.add_word(word.rstrip("*"), [])
        for word in self.weights:
            self.a.get(word.rstrip("*")).append(word)
        if self.weights:
            self.a.make_automaton()
        self.coefficients = model["coefficients"]

    def matches(self, text: str) -> list[tuple[str, int, int]]:
        """(lexicon word, start, end) of each match that counts, before exceptions."""
        best: dict[int, tuple[float, str, int]] = {}
        if self.weights:
            for last, entries in self.a.iter(fold(text, self.table)):
                end = last + 1
                for word in entries:
                    start = end - len(word.rstrip("*"))
                    if (start == 0 or not text[start - 1].isalnum()) and (word[-1] == "*" or end == len(text) or not text[end].isalnum()):
                        best[start] = max(best.get(start, (0.0, "", 0)), (self.weights[word], word, end))
        return [(word, start, end) for start, (_, word, end) in best.items()]

    def entries(self, text: str) -> dict[str, int]:
        """How often each entry occurs, nested ones too."""
        found: dict[str, int] = {}
        for last, entries in self.a.iter(fold(text, self.table)):
            end = last + 1
            for word in entries:
                start = end - len(word.rstrip("*"))
                if (start == 0 or not text[start - 1].isalnum()) and (word[-1] == "*" or end == len(text) or not text[end].isalnum()):
                    found[word] = found.get(word, 0) + 1
        return found

    def neighbours(self, text: str, start: int, end: int) -> tuple[str, str]:
        """The words, or parts of words, on either side of a match, folded."""
        b = start
        while b and text[b - 1].isspace():
            b -= 1
        a = b
        while a and not text[a - 1].isspace():
            a -= 1
        c, n = end, len(text)
        while c < n and text[c].isspace():
            c += 1
        d = c
        while d < n and not text[d].isspace():
            d += 1
        return fold(text[a:b], self.table), fold(text[c:d], self.table)

    def features(self, text: str) -> tuple[float, float]:
        clean = INVISIBLE.sub("", text) if not text.isascii() else text
        total = 0.0
        for word, start, end in self.matches(clean):
            left, right = self.neighbours(clean, start, end) if self.before or self.after else ("", "")
            if (left, word) not in self.before and (word, right) not in self.after:
                total += self.weights[word]
        return math.log1p(total), math.log1p(100 * total / (1 + clean.count(" ")))

    def score(self, text: str) -> float:
        a, b, c = self.coefficients
        x, y = self.features(text)
        return 1 / (1 + math.exp(-min(max(a + b * x + c * y, -30), 30)))


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", max_labelled: int = MAX_LABELLED, exceptions: list[tuple[str, str]] = ()) -> dict:
    """The model as a dictionary of bounded size, from at most `max_labelled` labelled documents.
    exceptions: (word, word) phrases that never count, besides those that are learnt."""
    # copies of one text would lend its words a support that they do not have
    rows = C.cut(labelled(docs, labels, target, max_labelled).dropDuplicates(["text"]))

    def count(batches):
        table = Fold()
        seen: dict[str, int] = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                # folded as matched: signs inside a word stand for letters, those at its edges are not part of it
                words = {fold(w.strip(EDGES), table) for w in _WORD.findall(INVISIBLE.sub("", text))}
                found = {w for w in words if len(w) >= 3 and any(c.isalpha() for c in w)}
                found |= {w[:n] + "*" for w in words for n in STEM if len(w) > n}
                for w in found:
                    seen[w] = seen.get(w, 0) + 1
        k = list(seen.items())
        for i in range(0, len(k), 50_000):
            w, n = zip(*k[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n, pa.int64())], ["w", "n"])

    size = {r[0]: (r[1], r[2]) for r in rows.groupBy((F.col("y") > 0).cast("int").alias("t")).agg(F.count("*"), F.sum(F.length("text") - F.length(F.regexp_replace("text", " ", "")) + 1)).collect()}
    (n0, words0), (n1, words1) = size.get(0, (0, 0)), size.get(1, (0, 0))
    support = max(SUPPORT, n1 // 100)
    counts = rows.where("y > 0").select("text").mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).where(f"n >= {support}")
    likely = {r[0] for r in counts.select("w").collect()}  # at most a hundred times what a document holds on average
    if not likely or not n0:
        rate = (n1 + 1) / (n0 + n1 + 3)
        return {"weights": {}, "before": [], "after": [], "coefficients": [math.log(rate / (1 - rate)), 0.0, 0.0]}
    start = {"weights": dict.fromkeys(likely, 1.0), "before": [], "after": [], "coefficients": [0, 0, 0]}
    sent = docs.sparkSession.sparkContext.broadcast(start)

    def present(batches):
        lexicon = Lexicon(sent.value)
        seen: dict[str, list[int]] = {}
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w, n in lexicon.entries(INVISIBLE.sub("", text)).items():
                    seen.setdefault(w, [0, 0, 0])[int(y > 0)] += n
                    seen[w][2] += y > 0
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), *(pa.array([int(n[i]) for n in seen.values()], pa.int64()) for i in range(3))], ["w", "n0", "n1", "docs"])

    exact = rows.select("text", "y").mapInArrow(present, "w string, n0 long, n1 long, docs long").groupBy("w").agg(F.sum("n0"), F.sum("n1"), F.sum("docs")).collect()
    odds = {w: math.log((b + 0.5) / (words1 + 1)) - math.log((a + 0.5) / (words0 + 1)) for w, a, b, d in exact if d >= support}
    odds = {w: x for w, x in odds.items() if x >= LEAST_ODDS}
    stems = {w[:-1]: x for w, x in odds.items() if w[-1] == "*"}
    spare = {w for w, x in odds.items() if any(stems.get(w[:n], -1) >= x - 0.7 for n in STEM if n < len(w.rstrip("*")) or n == len(w) and w[-1] != "*")}
    best = sorted((w for w in odds if w not in spare), key=lambda w: (-odds[w], w))
    model = {"weights": {w: odds[w] for w in best}, "before": [], "after": [], "coefficients": [0, 0, 0]}
    model_sent = docs.sparkSession.sparkContext.broadcast(model)

    def phrases(batches):
        lexicon = Lexicon(model_sent.value)
        seen: dict[tuple, list[int]] = {}
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = INVISIBLE.sub("", text)
                for word, s, e in lexicon.matches(text):
                    left, right = lexicon.neighbours(text, s, e)
                    for key in (("before", left, word), ("after", word, right)):
                        seen.setdefault(key, [0, 0])[int(y > 0)] += 1
        if seen:
            k = list(seen)
            yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in k]) for i in range(3)), *(pa.array([seen[x][i] for x in k], pa.int64()) for i in (0, 1))], ["side", "a", "b", "n0", "n1"])

    harmless = rows.select("text", "y").mapInArrow(phrases, "side string, a string, b string, n0 long, n1 long").groupBy("side", "a", "b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    for side, a, b in harmless.where("a <> '' AND b <> '' AND n0 >= 3 AND n1 * 20 <= n0").select("side", "a", "b").orderBy("side", "a", "b").collect():
        model[side].append((a, b))
    table = Fold()
    folded = [(fold(a, table), fold(b, table)) for a, b in exceptions]
    model["before"] += folded
    model["after"] += folded
    model_sent = docs.sparkSession.sparkContext.broadcast(dict(model))

    def measured(batches):
        lexicon = Lexicon(model_sent.value)
        for b in batches:
            x = [lexicon.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in x], pa.float64()), pa.array([c for _, c in x], pa.float64()), b.column(1)], ["a", "b", "y"])

    sample = rows.select("text", "y").mapInArrow(measured, "a double, b double, y long").toPandas().sort_values(["a", "b", "y"])
    model["coefficients"] = _logistic(sample[["a", "b"]].to_numpy(), (sample["y"].to_numpy() > 0).astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> list[float]:
    """Newton's method with a small ridge penalty."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, predicted) of every row: score from 0 to 1, predicted 1 from 0.5 on.  Null and empty
    texts get the score of a text without matches; a null doc_id is kept; repeated rows each get a row; extra
    columns are ignored; an empty table gives an empty result."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        lexicon = Lexicon(sent.value)
        for b in batches:
            s = np.array([lexicon.score(t or "") for t in b.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
