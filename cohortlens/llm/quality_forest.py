"""Quality rules and an isolation forest over their statistics.

``statistics`` counts the rule statistics of whole texts. ``fit_forest`` grows
random trees over their ratios on a bounded sample of documents; a document's
anomaly is 2 ** (-mean path length / expected path length), and its cause are
the two statistics whose splits parted it from the most sampled rows on the way.
``fit_thresholds`` takes one cut on the anomaly for each cause from labelled
rows (those not held out): the cuts with the best balanced accuracy among
documents that pass the base rules.

The model holds at most TREES * (2 * TREE_ROWS - 1) nodes, fitted on SAMPLE_ROWS
documents (those with the smallest hash of their id and text); statistics, scores and the
threshold's histogram cover all rows.

Nulls and edges: a null, empty or blank text has no words, fails the base rules
and is not kept; null doc_ids are scored like others but never labelled;
repeated rows are scored one by one; a cause without labelled bad rows takes the
threshold of its first statistic, else the one of all labelled rows, but with good rows of its own none under the
middle between the highest of them and 1; without any labelled bad row it is 1 (nothing is anomalous); a doc_id with several labels counts as
good only if all say so; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, held_out, materialize, smallest, texts

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 3
MIN_WORDS = 50
TREES = 100
TREE_ROWS = 256
SAMPLE_ROWS = 8192
BINS = 2000
STATS = "doc_id long, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"



def repeat_words(words: list[bytes]) -> int:
    """Words inside some window of WINDOW words that the text holds twice or more."""
    if len(words) < WINDOW + 1:
        return 0
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    distinct = set(windows)
    if len(distinct) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    count, covered = 0, 0  # words before ``covered`` are counted or passed
    for i, w in enumerate(windows):
        if w in often:
            count += i + WINDOW - max(covered, i)
            covered = i + WINDOW
    return count


def text_statistics(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word)."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeat_words(words), len(lines))


def _count(batch: pa.RecordBatch) -> pa.RecordBatch:
    cols = list(zip(*map(text_statistics, texts(batch.column("text"))))) or [()] * 6
    arrays = [batch.column("doc_id"), batch.column("text_hash"), *(pa.array(c, pa.int64()) for c in cols)]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"])


def statistics(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return (arrow_map(rows.select("doc_id", "text_hash", "text"), lambda: _count, STATS)
            .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))


NAMES = ("mean_word", "symbols", "dup_lines", "repeats")
CAUSES = tuple(f"{a}, {b}" for a in NAMES for b in NAMES)


def features() -> list:
    """Ratios of the statistics, as Spark columns; cubes keep small shares of repetition near the mass at zero."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    dup, rep = F.col("n_dup_lines") / lines, F.col("n_repeat_words") / words
    return [(F.col("word_chars") / words).alias("mean_word"), (F.col("n_symbols") / words).alias("symbols"),
            (dup * dup * dup).alias("dup_lines"), (rep * rep * rep).alias("repeats")]


def _expected(n):
    """Mean path length of an unsuccessful search in a random binary tree of n rows."""
    n = np.maximum(np.asarray(n, "f8"), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1 for a leaf), split, left child, path length at the leaf, sampled rows at the node."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    path: np.ndarray
    size: np.ndarray
    roots: np.ndarray
    rows: int

    def anomaly(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anomaly and cause (the first feature's number times the number of features, plus the second's) of each row."""
        total, credit = np.zeros(len(x)), np.zeros(x.shape)
        bits = np.log2(np.maximum(self.size, 1))
        for root in self.roots:
            node = np.full(len(x), root)
            inner = np.arange(len(x))
            while True:
                inner = inner[self.feature[node[inner]] >= 0]
                if not len(inner):
                    break
                at = node[inner]
                f = self.feature[at]
                child = self.left[at] + (x[inner, f] >= self.split[at])
                credit[inner, f] += bits[at] - bits[child]
                node[inner] = child
            total += self.path[node]
        order = np.argsort(-credit, axis=1, kind="stable")
        return 2.0 ** (-total / max(len(self.roots), 1) / max(float(_expected(self.rows)), 1e-9)), order[:, 0] * x.shape[1] + order[:, 1]


def grow(x: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 11) -> Forest:
    """Random splits of random subsamples, to the usual depth of log2(tree_rows)."""
    rng = np.random.default_rng(seed)
    m = min(tree_rows, len(x))
    limit = max(1, math.ceil(math.log2(max(m, 2))))
    feature, split, left, path, size, roots = [], [], [], [], [], []

    def leaf(n: int) -> int:
        for column, value in ((feature, -1), (split, 0.0), (left, 0), (path, 0.0), (size, n)):
            column.append(value)
        return len(feature) - 1

    for _ in range(trees if m else 0):
        root = leaf(m)
        roots.append(root)
        todo = [(root, x[rng.choice(len(x), m, replace=False)], 0)]
        while todo:
            node, part, depth = todo.pop()
            low, high = part.min(0), part.max(0)
            open_ = np.nonzero(high > low)[0]
            if depth >= limit or len(part) < 2 or not len(open_):
                path[node] = depth + float(_expected(len(part)))
                continue
            f = int(rng.choice(open_))
            s = float(rng.uniform(low[f], high[f]))
            s = s if s > low[f] else float(high[f])
            side = part[:, f] >= s
            feature[node], split[node], left[node] = f, s, leaf(int((~side).sum()))
            leaf(int(side.sum()))
            todo += [(left[node], part[~side], depth + 1), (left[node] + 1, part[side], depth + 1)]
    return Forest(np.array(feature, "i4"), np.array(split), np.array(left, "i4"), np.array(path), np.array(size, "f8"), np.array(roots, "i8"), m)


def fit_forest(stats: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 11) -> Forest:
    """Grow the forest on a sample of ``sample_rows`` documents that pass the base rules."""
    rows = stats.filter(~F.col("base_failed")).select(F.xxhash64("doc_id", "text_hash", F.lit(seed)).alias("_h"), *features())
    sample = smallest(rows, "_h", sample_rows, *NAMES).collect()
    x = np.array([r[1:] for r in sample], "f8").reshape(-1, len(features()))
    return grow(x, trees, tree_rows, seed)


def score(stats: DataFrame, forest: Forest) -> DataFrame:
    """Add ``anomaly`` and ``cause``. The forest is the only thing sent to tasks; its size has a fixed bound."""
    names = [*stats.columns]
    n = len(features())

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.column_stack([batch.column(f"_f{k}").to_numpy(zero_copy_only=False) for k in range(n)]) if batch.num_rows else np.zeros((0, n))
        anomaly, cause = forest.anomaly(x)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(anomaly), pa.array(cause.astype("i4"))], names=[*names, "anomaly", "cause"])

    schema = ", ".join(f"{c} {t}" for c, t in stats.dtypes) + ", anomaly double, cause int"
    return arrow_map(stats.select(*names, *(f.alias(f"_f{k}") for k, f in enumerate(features()))), lambda: step, schema)


def best_cuts(table: np.ndarray) -> list[float]:
    """For each cause the cut in 0..1 with the best balanced accuracy; ``table[cause, good, bin]`` holds row counts.

    Of equally good cuts it is the middle one.
    """
    bins = table.shape[2] - 1
    bad, good = np.maximum(table.sum((0, 2)), 1)
    cuts = []
    for gone, stay in table:
        if not gone.sum():
            cuts.append(1.0)
            continue
        value = np.concatenate([[0], np.cumsum(stay) / good - np.cumsum(gone) / bad])  # under k / bins: kept
        best = np.nonzero(value >= value.max() - 1e-12)[0]
        cuts.append(float((best[0] + best[-1]) / 2 / bins))
    return cuts


def all_cuts(table: np.ndarray) -> list[float]:
    """``best_cuts`` of pairs of statistics; a pair without bad rows takes the cut of its first one's rows or of all rows.

    Its own good rows hold that cut up: as in ``best_cuts`` to the middle of the cuts that keep them all.
    """
    n, bins = len(NAMES), table.shape[2] - 1
    firsts = table.reshape(n, n, 2, bins + 1).sum(1)
    cuts, by_first, whole = best_cuts(table), best_cuts(firsts), best_cuts(table.sum(0)[None])[0]
    for k, (gone, stay) in enumerate(table):
        if not gone.sum():
            own = (np.flatnonzero(stay)[-1] + 1 + bins) / 2 / bins if stay.any() else 0.0
            cuts[k] = float(max(by_first[k // n] if firsts[k // n, 0].any() else whole, own))
    return cuts


def fit_thresholds(scored: DataFrame, labels: DataFrame, bins: int = BINS) -> list[float]:
    """The anomaly from which a document goes, for each cause, by a histogram of all labelled rows that are not held out."""
    good = (labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.min((F.col("quality") == 1).cast("int")).alias("good")))
    rows = scored.filter(~F.col("base_failed") & ~held_out()).select("doc_id", "cause", F.floor(F.col("anomaly") * bins).cast("int").alias("bin"))
    table = np.zeros((len(CAUSES), 2, bins + 1))
    for r in rows.join(good, "doc_id").groupBy("cause", "good", "bin").count().collect():
        table[r["cause"], r["good"], min(r["bin"], bins)] += r["count"]
    return all_cuts(table)


def rate(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics, base_failed, anomaly, cause and kept for each document."""
    stats = materialize(statistics(docs), "rule-statistics")
    scored = score(stats, fit_forest(stats, sample_rows))
    cuts = F.array(*map(F.lit, fit_thresholds(scored, labels)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < cuts[F.col("cause")]))
