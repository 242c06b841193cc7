"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - s), with thresholds in rising order and one s for all of them: the sum
of the weights of a text's hashed features.  Features are the text's words (each with its share of the words)
and its style, in classes: share of capitals, of signs, of repeated words and lines, of common joints, mean
word length, length.  The expected grade and the probability of a grade of `at_least` or more follow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corvane.llm import common as C
from corvane.llm.labels import labelled

BITS = 14
MAX_LABELLED = 6_000
#: A word's weight counts by its share among the words; style features count in full.
WORD_SCALE = 3.0
#: Documents below this probability of a good grade are rejected: most of what is doubtful stays.
KEEP_FROM = 0.5

_UPPER, _LOWER, _SIGN = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER[97:123] = True
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_STYLE = ("upper", "sign", "signrun", "unique", "top", "wordlen", "length")


def _class(x: np.ndarray, steps: int) -> np.ndarray:
    return np.minimum((x * steps).astype(np.int64), steps - 1)


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value), one entry per word or style class of each row."""
    n = len(at) - 1
    w, start, end, row = C.words(raw, at)
    count = np.bincount(row, minlength=n)
    size = np.maximum(np.diff(at), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask))
        return (total[at[1:]] - total[at[:-1]]) / size

    sign = _SIGN[raw] if len(raw) else np.zeros(0, bool)
    run = np.zeros(len(raw), bool)
    if len(raw) > 1:
        run[1:] = sign[1:] & sign[:-1]
    letters = share(_LOWER[raw]) + share(_UPPER[raw])
    # words by row: the row above, and as much of the hash as is left (46 bits or more) below
    bits = np.uint64(max(1, (n - 1).bit_length()))
    key = np.sort((row.astype(np.uint64) << (np.uint64(64) - bits)) | (w >> bits))
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(w) else np.zeros(0, np.int64)
    of = (key[new] >> (np.uint64(64) - bits)).astype(np.int64)
    unique = 1 - (count - np.bincount(of, minlength=n)) / np.maximum(count, 1)
    often = np.zeros(n)
    np.maximum.at(often, of, np.diff(np.append(new, len(w))) / np.maximum(count[of], 1))
    mean = np.bincount(row, end - start, minlength=n) / np.maximum(count, 1)
    long = np.log2(1 + count)
    classes = [
        _class(share(_UPPER[raw]) / np.maximum(letters, 1e-9), 6),
        _class(np.sqrt(share(sign)), 10),
        _class(np.sqrt(share(run)), 8),
        _class(unique, 10) * 8 + np.minimum(long // 2, 7).astype(np.int64),  # repetition means more in a short text
        _class(often, 10),
        np.minimum(mean, 15).astype(np.int64),
        np.minimum(long, 15).astype(np.int64),
    ]
    style = [C.mix(np.full(n, k + 1, np.uint64) * np.uint64(1 << 32) + c.astype(np.uint64)) for k, c in enumerate(classes)]
    word_value = WORD_SCALE / np.maximum(count[row], 1)
    rows = np.concatenate([row, *[np.arange(n)] * len(style)])
    hashed = np.concatenate([w, *style]) >> np.uint64(64 - BITS)
    values = np.concatenate([word_value, *[np.ones(n)] * len(style)])
    return rows, hashed.astype(np.int64), values


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", max_labelled: int = MAX_LABELLED, steps: int = 250, ridge: float = 1e-4) -> dict:
    """Weights and thresholds, from at most `max_labelled` labelled documents: their features, summed by
    hash, come to the driver (some 3 kB each).  Grades are the label's values in order; with fewer than two
    grades every document gets the one there is (0 with none)."""

    def run(batches):
        for b in batches:
            raw, at = C.text_buffer(b.column(1))
            y = b.column(2).to_pylist()
            ids = b.column(0).to_pylist()
            for i, j in C.slices(at):
                r, f, v = features(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                key, where = np.unique(r * (1 << BITS) + f, return_inverse=True)
                value = np.bincount(where, v).astype(np.float32)
                edge = np.searchsorted(key, np.arange(j - i + 1) * (1 << BITS))
                rows = [(ids[i + k], y[i + k], (key[edge[k] : edge[k + 1]] % (1 << BITS)).astype(np.int16 if BITS < 16 else np.int32).tobytes(), value[edge[k] : edge[k + 1]].tobytes()) for k in range(j - i)]
                columns = list(zip(*rows)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["doc_id", "y", "f", "v"])

    rows = labelled(docs, labels, target, max_labelled).select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y long, f binary, v binary")
    found = sorted(rows.collect(), key=lambda r: (r[0], r[2]))  # a fixed order of summation
    grades = sorted({r[1] for r in found})
    if len(grades) < 2:
        return {"grades": grades or [0], "weights": np.zeros(1 << BITS, np.float32), "thresholds": np.zeros(0)}
    y = np.searchsorted(grades, [r[1] for r in found])
    f = np.concatenate([np.frombuffer(r[2], np.int16 if BITS < 16 else np.int32) for r in found]).astype(np.int64)
    v = np.concatenate([np.frombuffer(r[3], np.float32) for r in found]).astype(np.float64)
    d = np.repeat(np.arange(len(found)), [len(r[3]) // 4 for r in found])
    weights, thresholds = cumulative_link(d, f, v, y, len(grades), steps, ridge)
    return {"grades": grades, "weights": weights.astype(np.float32), "thresholds": thresholds}


def cumulative_link(d: np.ndarray, f: np.ndarray, v: np.ndarray, y: np.ndarray, grades: int, steps: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the ordinal model by Adam; d, f, v: document, feature and value of each entry."""
    n = len(y)
    w = np.zeros(1 << BITS)
    share = np.clip(np.array([(y <= k).mean() for k in range(grades - 1)]), 1e-3, 1 - 1e-3)
    t = np.log(share / (1 - share))
    theta = np.concatenate([[t[0]], np.log(np.maximum(np.diff(t), 1e-2))])  # the first, and logs of the gaps

    def logistic(x):
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))

    m = [np.zeros_like(w), np.zeros_like(theta)]
    s = [np.zeros_like(w), np.zeros_like(theta)]
    for step in range(1, steps + 1):
        t = np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))])
        score = np.bincount(d, w[f] * v, n)
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        hi, lo = logistic(edge[y + 1] - score), logistic(edge[y] - score)
        hi[y == grades - 1], lo[y == 0] = 1, 0
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        gs = (dhi - dlo) / n  # of the loss, by the score
        gt = np.zeros(grades - 1)
        for k in range(grades - 1):
            gt[k] = (-dhi[y == k].sum() + dlo[y == k + 1].sum()) / n
        gtheta = np.concatenate([[gt.sum()], [gt[k:].sum() * np.exp(theta[k]) for k in range(1, grades - 1)]])
        gw = np.bincount(f, gs[d] * v, 1 << BITS) + ridge * w
        for i, (x, g) in enumerate(((w, gw), (theta, gtheta))):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.99 * s[i] + 0.01 * g * g
            x -= 0.05 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-8)
    return w, np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))])


def _grade(model: dict, raw: np.ndarray, at: np.ndarray, at_least: int | None) -> tuple[np.ndarray, np.ndarray]:
    r, f, v = features(raw, at)
    s = np.bincount(r, model["weights"][f] * v, len(at) - 1)
    grades = np.array(model["grades"], np.float64)
    below = 1 / (1 + np.exp(-np.clip(model["thresholds"][None, :] - s[:, None], -35, 35)))
    below = np.concatenate([np.zeros((len(s), 1)), below, np.ones((len(s), 1))], 1)
    expected = np.diff(below, axis=1) @ grades
    k = int(np.searchsorted(grades, grades[-1] if at_least is None else at_least))
    return expected, 1 - below[:, min(k, len(grades))]


def _graded(docs: DataFrame, model: dict, at_least: int | None, fields: list[T.StructField], pick) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *fields])

    def run(batches):
        for b in batches:
            raw, at = C.text_buffer(b.column(at_text))
            parts = [_grade(sent.value, raw[at[i] : at[j]], at[i : j + 1] - at[i], at_least) for i, j in C.slices(at)]
            e, p = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0), np.zeros(0))
            yield pick(b, e, p, schema)

    return docs.mapInArrow(run, schema)


def grade(docs: DataFrame, model: dict, at_least: int | None = None, keep_from: float = KEEP_FROM) -> DataFrame:
    """(doc_id, expected_grade, tail, selected) of every row: tail is the probability of a grade of at_least
    (the best one, if not given) or more, selected whether that reaches keep_from.

    Null and empty texts are graded by their (empty) style; null doc_ids are kept; repeated rows each get a row;
    extra columns are ignored; an empty table gives an empty result."""
    fields = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType()), T.StructField("selected", T.BooleanType())]

    def pick(b, e, p, schema):
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(e), pa.array(p), pa.array(p >= keep_from)], schema.names)

    return _graded(docs.select("doc_id", "text"), model, at_least, fields, pick).drop("text")


def keep_good(docs: DataFrame, model: dict, at_least: int | None = None, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of docs, whole, that `grade` selects."""
    return _graded(docs, model, at_least, [], lambda b, e, p, schema: b.filter(pa.array(p >= keep_from)))
