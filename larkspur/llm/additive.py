"""Quality scores from a generalised additive model with pairwise interactions.

Every whole text becomes a row of numbers where it lies (:func:`measure`): lengths, shares of characters, words and lines,
repetition. These rows, a few hundred bytes each, are stored once; labels are joined to them and never to texts. The model
is learned on at most ``sample`` labelled rows, those with the smallest hashes of their ids, and never on rows that are
held out: each number is cut into bins by quantiles, and shallow trees are boosted on one number after the other in turn, so
each number gets its own table of bins. Then the pairs that explain most of what is left get tables of their own in the same
way. The number of turns is set by a fifth of the sample. A score adds up looked-up bins, all rows of a batch at once.

Labels with a null id or quality are ignored; further labels of an id, or further documents of it, are rows of their own.
Documents without a row in labels get a score like any other, so do null, empty and blank texts (their counts are 0) and
very long ones, which are read in whole, a piece of words at a time. A null id counts as held out. No labels at all, or one
class only: everything gets the smoothed share of good rows. An empty table gives an empty result. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import cut

NUMBERS = (
    "words", "word_bytes", "capitals", "digits", "symbols", "exclamations", "stops", "beyond_ascii", "distinct", "commonest", "doubled",
    "equal_lines", "line_words", "repeated_windows", "shouted", "signs_only", "marked", "single", "long", "closed_lines",
)
PIECE = 1 << 20
_GAP, _LETTER, _MARKED = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[0-9A-Za-z\x80-\xff]"), re.compile(rb"[#*$%&|<>!]{2,}$")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end between words."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def measure(text: bytes) -> list[float]:
    """The numbers of a UTF-8 text, in the order of NUMBERS."""
    number: dict[bytes, int] = {}
    parts = [np.zeros(0, np.int64)]
    for piece in _pieces(text):
        words = piece.split()
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
    ids = np.concatenate(parts)
    n = len(ids)
    if not n:
        return [0.0] * len(NUMBERS)
    count = np.bincount(ids)
    share = lambda flags: float(count[np.fromiter(flags, bool, len(count))].sum()) / n
    size = np.fromiter(map(len, number), np.int64, len(count))
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    many = lambda chars: float(byte[list(chars)].sum())
    capitals, letters = byte[65:91].sum(), byte[65:91].sum() + byte[97:123].sum()
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0.0
    if n >= 5:
        mixed = ids.astype(np.uint64) + np.uint64(1)
        window = sum(mixed[i : n - 4 + i] * _MULTIPLIERS[i] for i in range(5))
        _, which, often = np.unique(window, return_inverse=True, return_counts=True)
        edge = np.zeros(n + 1, np.int64)
        starts = np.flatnonzero(often[which] > 1)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + 5, -1)
        repeated = float((np.cumsum(edge[:n]) > 0).sum()) / n
    return [
        float(np.log1p(n)),
        float((size * count).sum()) / n,
        float(capitals) / max(1, letters),
        many(range(48, 58)) / n,
        many(b"#*$%&|<>") / n,
        many(b"!") / n,
        many(b".,;:?") / n,
        float(byte[128:].sum()) / len(text),
        len(count) / n,
        float(count.max()) / n,
        float((ids[1:] == ids[:-1]).sum()) / n,
        1.0 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        repeated,
        share(len(w) > 1 and w.isupper() for w in number),
        share(not _LETTER.search(w) for w in number),
        share(bool(_MARKED.search(w)) for w in number),
        share(len(w) == 1 for w in number),
        share(len(w) > 24 for w in number),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines),
    ]


def numbers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of doc_id and x, the numbers of the text."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([measure(text.as_buffer().to_pybytes()) for text in batch.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text")).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """A fifth of the ids, never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


@dataclass
class Model:
    """Bin edges and tables of every number, and of the pairs (over coarser bins)."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for column, edges, table in zip(x.T, self.edges, self.tables, strict=True):
            out += table[np.searchsorted(edges, column, side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Up to bins - 1 edges between different values, at even quantiles."""
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="higher"))


def _best(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; the gain is 0 where no cut leaves enough weight on both sides."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(left_h < least) | (right_h < least)] = 0.0
    at = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) else (0.0, 0)


def tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 1.0, least: float = 0.5) -> np.ndarray:
    """The step of a shallow tree for each bin, from the sums of gradients and curvatures in them."""
    spans = [(0, len(g))]
    while len(spans) < leaves:
        options = [(*_best(g[a:b], h[a:b], ridge, least), a, b) for a, b in spans if b - a > 1]
        gain, at, a, b = max(options, default=(0.0, 0, 0, 0))
        if gain <= 1e-9:
            break
        spans[spans.index((a, b)) : spans.index((a, b)) + 1] = [(a, a + at), (a + at, b)]
    step = np.zeros(len(g))
    for a, b in spans:
        step[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return step


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float = 1.0, least: float = 0.5) -> tuple[float, np.ndarray]:
    """Gain and step of a tree of depth two over a grid: one cut along one side, then a cut of each half along the other."""
    best_gain, best_step = 0.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, at = _best(a.sum(axis=1), b.sum(axis=1), ridge, least)
        step, gain = np.zeros_like(a), -(g.sum() ** 2) / (h.sum() + ridge)
        for half in (slice(0, at), slice(at, None)):
            x, y = a[half].sum(axis=0), b[half].sum(axis=0)
            won, cut_at = _best(x, y, ridge, least)
            for part in (slice(0, cut_at), slice(cut_at, None)) if won > 0 else (slice(None),):
                step[half, part] = -x[part].sum() / (y[part].sum() + ridge)
                gain += x[part].sum() ** 2 / (y[part].sum() + ridge)
        if gain > best_gain:
            best_gain, best_step = gain, step.T if turned else step
    return best_gain, best_step


def _loss(logit: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0.0, -logit) * y + np.logaddexp(0.0, logit) * (1 - y))) if len(y) else 0.0


def _boost(tables: list[np.ndarray], cells: list[np.ndarray], start: np.ndarray, y: np.ndarray, fit: np.ndarray, grow, rounds: int, rate: float, patience: int) -> np.ndarray:
    """Boost every table in turn on the rows of fit, keep them as they were when the others' loss was least, and return all logits."""
    logit, best, since = start.copy(), _loss(start[~fit], y[~fit]), 0
    kept, kept_logit = [t.copy() for t in tables], start.copy()
    for _ in range(rounds):
        for table, cell in zip(tables, cells, strict=True):
            p = 1.0 / (1.0 + np.exp(-logit[fit]))
            g = np.bincount(cell[fit], p - y[fit], table.size).reshape(table.shape)
            h = np.bincount(cell[fit], p * (1 - p), table.size).reshape(table.shape)
            step = rate * grow(g, h)
            table += step
            logit += step.ravel()[cell]
        now = _loss(logit[~fit], y[~fit])
        if now < best - 1e-6:
            best, since, kept, kept_logit = now, 0, [t.copy() for t in tables], logit.copy()
        else:
            since += 1
            if since >= patience:
                break
    for table, was in zip(tables, kept, strict=True):
        table[:] = was
    return kept_logit


def learn(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse_bins: int = 8, n_pairs: int = 8, rounds: int = 300, rate: float = 0.1, patience: int = 25) -> Model:
    """The model of a bounded sample: rows of numbers and their labels, 0 or 1."""
    n, width = x.shape
    good = float(y.sum())
    intercept = float(np.log((good + 0.5) / (n - good + 0.5)))
    edges = [_cuts(c, bins) if n else np.zeros(0) for c in x.T]
    coarse = [_cuts(c, coarse_bins) if n else np.zeros(0) for c in x.T]
    model = Model(intercept, edges, [np.zeros(len(e) + 1) for e in edges], coarse, [], [])
    if not 0 < good < n:
        return model
    fit = np.arange(n) % 5 != 4
    cells = [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)]
    logit = _boost(model.tables, cells, np.full(n, intercept), y, fit, tree, rounds, rate, patience)
    grid = [np.searchsorted(e, c, side="right") for e, c in zip(coarse, x.T, strict=True)]
    p = 1.0 / (1.0 + np.exp(-logit[fit]))
    gains = []
    for i in range(width):
        for j in range(i + 1, width):
            shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
            if min(shape) > 1:
                cell = grid[i][fit] * shape[1] + grid[j][fit]
                g, h = (np.bincount(cell, w, shape[0] * shape[1]).reshape(shape) for w in (p - y[fit], p * (1 - p)))
                gains.append((pair_tree(g, h)[0], -i, -j))
    model.pairs = [(-i, -j) for gain, i, j in sorted(gains, reverse=True)[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in model.pairs]
    pair_cells = [grid[i] * t.shape[1] + grid[j] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True)]
    _boost(model.pair_tables, pair_cells, logit, y, fit, lambda g, h: pair_tree(g, h)[1], rounds, rate, patience)
    return model


def fit(measured: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Learn from at most sample labelled rows that are not held out."""
    ours = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    mark = F.xxhash64("id")
    few = ours.orderBy(mark, "id", "y").limit(sample)  # so the broadcast side is bounded
    rows = measured.join(F.broadcast(few), F.col("doc_id") == F.col("id")).orderBy(mark, "id", "y", "x").limit(sample).select("x", "y").collect()
    x = np.array([r["x"] for r in rows], np.float64).reshape(-1, len(NUMBERS))
    return learn(x, np.array([r["y"] for r in rows], np.float64))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of doc_id, held_out, score and predicted, one for each document."""
    measured = cut(numbers(docs, id_col, text_col))
    model = fit(measured, labels, sample, id_col)
    schema = T.StructType([measured.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NUMBERS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=schema.names)

    scored = measured.mapInArrow(run, schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
