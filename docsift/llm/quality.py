"""Operator 9: quality rules, an isolation forest on rule statistics.

Rule statistics of every whole text are counted exactly, from its words and lines. Ratios of them feed an isolation
forest: trees that split all rows at random, level by level, in which odd documents have short paths. The score above
which a document goes is calibrated on all labelled rows: the lowest threshold that keeps all but ``MAX_GOOD_LOST`` of
the labelled good documents. Nothing is fitted on a sample, and no order or division of the rows changes a result.

Defined cases: a null or empty text has no words and fails the base rules; a null doc_id is scored but never used for
fitting; repeated rows get equal results; with fewer than ``MIN_LABELLED`` labelled good rows the forest rejects none;
empty input gives an empty result; ties with the threshold are kept. Texts are counted whole, a slice of rows or one long
text at a time. Only doc_id and text, and quality of the labels, are read: extra columns, whatever their names, do not
reach the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.common import cut, running_sums, small_batches, table
from docsift.llm.kernel import U64, classes, hash_segments, mix64, repeated, row_sums, segments, slices, windows, words_of

#: Trees, their depth, and narrow rows that a worker puts through them at once.
TREES, DEPTH, CHUNK_ROWS = 100, 6, 1 << 15
MAX_GOOD_LOST, MIN_LABELLED = 0.005, 20
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_START = (np.arange(256) & 0xC0) != 0x80  # first byte of a character
_CASE = np.zeros(256, bool)
_CASE[0x41:0x5B] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!?.,;:-_=+/\\()[]{}'\"")] = True

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_punct")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in STATS)


def text_stats(column: pa.Array) -> dict[str, np.ndarray]:
    """STATS of each text of an Arrow column."""
    out = {c: np.zeros(len(column), np.int64) for c in STATS}
    blank = classes("blank")
    for part in slices(column):
        data, rows = part.data, slice(part.lo, part.hi)
        words = words_of(part, blank)
        starts_char = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_START[data], out=starts_char[1:])
        chars = starts_char[words.ends] - starts_char[words.starts]
        out["n_words"][rows] = words.counts
        out["word_chars"][rows] = row_sums(chars, words.offsets[:-1], words.offsets[1:])
        for name, kind in (("n_symbols", _SYMBOL), ("n_upper", _CASE), ("n_punct", _PUNCT)):
            out[name][rows] = row_sums(kind[data], part.starts, part.ends)
        row_of_word = np.repeat(np.arange(part.rows), words.counts)
        hashes = hash_segments(data, words.starts, words.ends)
        salt = mix64(np.arange(part.rows, dtype=U64) + U64(1))
        # words in windows that occur twice
        keys, at = windows(hashes, words.offsets, WINDOW)
        twice, _ = repeated(mix64(keys ^ salt[row_of_word[at]]))
        step = np.zeros(len(hashes) + 1, np.int64)
        hit = at[twice]
        np.add.at(step, hit, 1)
        np.add.at(step, hit + WINDOW, -1)
        covered = np.cumsum(step[:-1]) > 0
        out["n_repeat_words"][rows] = np.bincount(row_of_word[covered], minlength=part.rows)
        # lines with a word
        starts, ends = segments(data != 0x0A, part.starts)
        filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
        starts, ends = starts[filled], ends[filled]
        row_of_line = np.searchsorted(part.starts, starts, side="right") - 1
        _, again = repeated(mix64(hash_segments(data, starts, ends) ^ salt[row_of_line]))
        out["n_dup_lines"][rows] = np.bincount(row_of_line[again], minlength=part.rows)
    return out


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = text_stats(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(stats[c]) for c in STATS)], ["doc_id", *STATS])


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Characters a word, and shares of symbols, capitals and punctuation, small ones spread by a root.

    All lie between 0 and 1, so that a few extreme texts cannot widen a range until no split parts the others. Repeated
    lines and words are left to the base rules: they vary so much among good texts that they would hide junk.
    """
    words, chars = np.maximum(s["n_words"], 1).astype(float), np.maximum(s["word_chars"], 1).astype(float)
    shares = (s["n_symbols"] / words, s["n_upper"] / chars, s["n_punct"] / chars)
    return np.column_stack([s["word_chars"] / (s["word_chars"] + 5 * words), *(np.sqrt(20 * r / (1 + 20 * r)) for r in shares)])


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of a failed search in a binary search tree of n keys."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2)
    return np.where(n < 2, 0.0, np.where(n < 3, 1.0, 2 * (np.log(safe - 1) + 0.5772156649015329) - 2 * (safe - 1) / safe))


class IsolationForest:
    """Trees as flat arrays of equal depth, so that a column of rows walks down all of them at once.

    They grow on all rows, a level at a time: ``held`` says what a level's nodes hold of some rows, and ``grow`` takes such
    tables of all rows, merged by sums, least and greatest values.
    """

    def __init__(self, trees: int = TREES, depth: int = DEPTH, seed: int = 7):
        self.size, self.depth = 0, depth
        shape = (trees, 2 ** (depth + 1))
        self.column, self.split, self.path = np.zeros(shape, np.int16), np.full(shape, np.inf), np.zeros(shape)
        self.open = np.zeros(shape, bool)
        self.open[:, 1] = True
        self.draws = np.random.default_rng(seed).random((2, *shape))

    def _nodes(self, x: np.ndarray, tree: int, level: int) -> np.ndarray:
        """The node of each row at a level of a tree."""
        rows, node, column, split = np.arange(len(x)), np.ones(len(x), np.int64), self.column[tree], self.split[tree]
        for _ in range(level):
            node = 2 * node + (x[rows, column[node]] > split[node])
        return node

    def held(self, x: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of rows by tree and node of the level; their least and greatest features by tree, feature and node."""
        trees, first = len(self.path), 2**level
        count, low = np.zeros((trees, first), np.int64), np.full((trees, x.shape[1], first), np.inf)
        high, columns = -low, np.ascontiguousarray(x.T)
        for t in range(trees):
            node = self._nodes(x, t, level) - first
            count[t] = np.bincount(node, minlength=first)
            for f, values in enumerate(columns):
                np.minimum.at(low[t, f], node, values)
                np.maximum.at(high[t, f], node, values)
        return count, low, high

    def grow(self, level: int, count: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Splits the open nodes of a level, or ends them, by what they hold of all rows."""
        first, wide = 2**level, high > low
        if level == 0:
            self.size = int(count[0, 0])
        now = self.open[:, first : 2 * first]
        splits = now & wide.any(axis=1) & (level < self.depth)
        t, n = np.nonzero(splits)
        choice, node = wide[t, :, n], first + n
        col = (np.cumsum(choice, axis=1) > np.floor(self.draws[0][t, node] * choice.sum(axis=1))[:, None]).argmax(axis=1)
        least, most = low[t, col, n], high[t, col, n]
        at = least + self.draws[1][t, node] * (most - least)
        self.column[t, node], self.split[t, node] = col, np.where(at < most, at, least)
        self.open[t, 2 * node] = self.open[t, 2 * node + 1] = True
        t, n = np.nonzero(now & ~splits)  # rows of a node that ends go left under infinite splits
        self.path[t, (first + n) << (self.depth - level)] = level + _average_path(count[t, n])

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; high is odd."""
        total = np.zeros(len(x))
        for t, path in enumerate(self.path):
            total += path[self._nodes(x, t, self.depth)]
        return 2.0 ** (-(total / len(self.path)) / max(float(_average_path(self.size)), 1e-9))


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in STATS}


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Features of the rows, CHUNK_ROWS or more at a time but for the last."""
    parts, rows = [], 0
    for batch in batches:
        parts.append(features(_columns(batch)))
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            yield np.concatenate(parts)
            parts, rows = [], 0
    if rows:
        yield np.concatenate(parts)


def _held(rows: DataFrame, forest: IsolationForest, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``IsolationForest.held`` of all rows: each partition sends a row per open node that it has rows of."""
    first, width = 2**level, len(features({c: np.ones(1, np.int64) for c in STATS})[0])
    lows, highs = [f"low{f}" for f in range(width)], [f"high{f}" for f in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for x in _chunks(batches):
            if count is None:
                count, low, high = forest.held(x, level)
            else:
                more = forest.held(x, level)
                count, low, high = count + more[0], np.minimum(low, more[1]), np.maximum(high, more[2])
        if count is not None:
            t, n = np.nonzero(forest.open[:, first : 2 * first] & (count > 0))
            yield pa.RecordBatch.from_arrays([pa.array(t * first + n), pa.array(count[t, n]), *(pa.array(side[t, f, n]) for side in (low, high) for f in range(width))], ["node", "n", *lows, *highs])

    sent = rows.mapInArrow(run, "node long, n long, " + ", ".join(f"{c} double" for c in lows + highs))
    merged = sent.groupBy("node").agg(F.sum("n").alias("n"), *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs]).toPandas()
    t, n = np.divmod(merged["node"].to_numpy(np.int64), first)
    count, low = np.zeros((len(forest.path), first), np.int64), np.full((len(forest.path), width, first), np.inf)
    high = -low
    count[t, n], low[t, :, n], high[t, :, n] = merged["n"], merged[lows], merged[highs]
    return count, low, high


def fit(stats: DataFrame) -> IsolationForest | None:
    """Forest of all rows that have an id and a word. A table of a level's nodes comes to the driver, never a row."""
    usable, forest = stats.where("doc_id IS NOT NULL AND n_words > 0"), IsolationForest()
    for level in range(forest.depth + 1):
        forest.grow(level, *_held(usable, forest, level))
        if forest.size < 2:
            return None
    return forest


def calibrate(scored: DataFrame, labels: DataFrame) -> float:
    """Threshold from all labelled good rows that pass the base rules, by their places in the order of scores."""
    good = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    uses = cut(scored.where("NOT base_failed").join(good, "doc_id").groupBy("anomaly").agg(F.count("*").alias("uses")))
    n = uses.agg(F.sum("uses")).first()[0] or 0
    if n < MIN_LABELLED:
        return 1.0
    place = min(n - 1, int(np.ceil(n * (1 - MAX_GOOD_LOST))))
    placed = running_sums(uses, [F.col("anomaly")], {"before": F.col("uses")})
    return placed.where((F.col("before") <= place) & (F.col("before") + F.col("uses") > place)).first()["anomaly"] + 1e-9


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base statistics, base_failed, kept, anomaly.

    Statistics and scores are cut once each, as narrow rows; texts are read a single time and never shuffled.
    """
    stats = cut(small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_stats_batches, SCHEMA))
    forest = fit(stats)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _columns(batch)
            odd = forest.score(features(s)) if forest is not None and batch.num_rows else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(s[c]) for c in STATS[:5]), pa.array(base_failed(s)), pa.array(odd)], names)

    names = ["doc_id", *STATS[:5], "base_failed", "anomaly"]
    scored = cut(stats.mapInArrow(score, "doc_id long, " + ", ".join(f"{c} long" for c in STATS[:5]) + ", base_failed boolean, anomaly double"))
    threshold = calibrate(scored, labels)
    return scored.select(*names[:-1], (~F.col("base_failed") & (F.col("anomaly") <= threshold)).alias("kept"), "anomaly")


def op9_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
