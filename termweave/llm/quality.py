"""Quality by a sparse ensemble of rules.

Each text is described by statistics of its bytes, words and lines. Shallow
trees are boosted on a bounded labelled sample; every path in them, from the root
to any node, is a rule: a conjunction of bounds on statistics. A lasso logistic
regression keeps few of the rules, and those that stay are compiled to one
Spark column expression over the statistics, which scores every row in the JVM.

The sample holds at most MAX_PER_CLASS rows of each label, chosen by hash of
doc_id; only their statistics come to the driver.

Nulls: a null text is empty; empty texts get statistics of zero and the score of
these. A null doc_id is scored, never learnt from, and not held out. Of labels
that repeat a doc_id the largest counts; null labels don't, nor do labels of
documents that are not in the table. Rows that repeat a doc_id are each scored, and
learnt from once, by the least of their statistics. With a label missing, every
score is the smoothed share of label 1. Empty tables give empty results. A very long
text is described whole, by one task. Other columns of docs, of any names, are not
read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, text_slices, texts_of
from .toxicity import held_out

MAX_PER_CLASS = 4000
TREES, DEPTH, BINS, RATE = 24, 3, 32, 0.3
#: Share of the largest useful lasso penalty.
PENALTIES = (0.1, 0.03, 0.01, 0.003)

_CLASSES = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "wide": range(0x80, 0x100),
    "space": (0x20, *range(0x09, 0x0E)),
    "control": (*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F),
    "stop": b".,;:'\"-",
    "mark": b"!?",
    "symbol": b"#$%&*+/<=>@\\^_`{|}~[]()",
}
_MEMBER = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES.values()):
    _MEMBER[list(_bytes), _k] = 1
STATISTICS = ("log_words", "word_length", "distinct_words", "repeated_next", "top_word", "capital_words", "symbol_words", "lone_symbols", "line_words", "distinct_lines", "entropy", *(f"share_{k}" for k in _CLASSES))


def statistics(text: bytes) -> list[float]:
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    hist = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    share = hist[hist > 0] / n
    words, lines = text.split(), text.split(b"\n")
    m = max(1, len(words))
    distinct = Counter(words)
    return [
        np.log1p(len(words)),
        sum(map(len, words)) / m,
        len(distinct) / m,
        sum(map(bytes.__eq__, words, words[1:])) / m,
        max(distinct.values(), default=0) / m,
        sum(map(bytes.isupper, words)) / m,
        sum(1 for w in words if len(w) > 2 and w[-1] == w[-2] and not w[-1:].isalnum() and w[-1] < 0x80) / m,
        sum(1 for w in words if len(w) == 1 and not w.isalnum()) / m,
        m / len(lines),
        len(set(lines)) / len(lines),
        float(-(share * np.log2(share)).sum()),
        *(hist @ _MEMBER / n).tolist(),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, and each of STATISTICS)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch):
                x = np.array([statistics(t) for t in texts_of(rows.column("text"))], dtype=np.float64).reshape(-1, len(STATISTICS))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], names=["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(add, T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(s, T.DoubleType()) for s in STATISTICS)]))


#: (statistic, whether it must be at most the bound, bound)
Rule = tuple[tuple[int, bool, float], ...]


def _simpler(rule: Rule) -> Rule:
    """At most one bound of each kind on a statistic."""
    tight: dict[tuple[int, bool], float] = {}
    for f, below, t in rule:
        old = tight.get((f, below), t)
        tight[f, below] = min(old, t) if below else max(old, t)
    return tuple(sorted((f, below, t) for (f, below), t in tight.items()))


def _grow(codes: np.ndarray, edges: list[np.ndarray], g: np.ndarray, rows: np.ndarray, path: Rule, rules: set[Rule], step: np.ndarray) -> None:
    """A tree on gradients: each node's path becomes a rule, each leaf moves step by its mean."""
    best = (1e-9, 0, 0)
    if len(path) < DEPTH and len(rows) >= 8:
        total, n = g[rows].sum(), len(rows)
        for f, edge in enumerate(edges):
            if not len(edge):
                continue
            s = np.cumsum(np.bincount(codes[rows, f], g[rows], minlength=len(edge) + 1))[:-1]
            c = np.cumsum(np.bincount(codes[rows, f], minlength=len(edge) + 1))[:-1]
            ok = (c >= 3) & (n - c >= 3)
            gain = np.where(ok, s**2 / np.maximum(c, 1) + (total - s) ** 2 / np.maximum(n - c, 1) - total**2 / n, 0)
            if gain.max() > best[0]:
                best = (float(gain.max()), f, int(gain.argmax()))
    if path:
        rules.add(_simpler(path))
    if best[0] <= 1e-9:
        step[rows] = g[rows].mean() if len(rows) else 0
        return
    _, f, k = best
    left = codes[rows, f] <= k
    _grow(codes, edges, g, rows[left], (*path, (f, True, float(edges[f][k]))), rules, step)
    _grow(codes, edges, g, rows[~left], (*path, (f, False, float(edges[f][k]))), rules, step)


def extract_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """All paths of TREES boosted trees."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    rules: set[Rule] = set()
    margin = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    for _ in range(TREES):
        p, step = 1 / (1 + np.exp(-margin)), np.zeros(len(y))
        _grow(codes, edges, y - p, np.arange(len(y)), (), rules, step)
        margin += RATE * step / max(1e-3, (p * (1 - p)).mean())
    return sorted(rules)


def fires(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    return np.stack([np.all([x[:, f] <= t if below else x[:, f] > t for f, below, t in r], axis=0) for r in rules], axis=1).astype(np.float64)


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal steps; the intercept is free."""
    a1 = np.c_[np.ones(len(a)), a]
    rate = 4 / max(np.linalg.norm(a1, 2) ** 2 / len(y), 1e-9)
    w = z = np.zeros(a1.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a1 @ z, -30, 30)))
        new = z - rate * (a1.T @ (p - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[float, Rule]]]:
    """The intercept and the rules with weight; the penalty is chosen on a quarter of the rows."""
    y = y.astype(np.float64)
    if len(y) < 8 or min(y.sum(), len(y) - y.sum()) < 4:
        return float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), []
    turn = np.zeros(len(y), dtype=int)
    for k in (0, 1):
        turn[y == k] = np.arange((y == k).sum()) % 4
    learn = turn > 0
    rules = extract_rules(x[learn], y[learn])
    if not rules:
        return float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), []
    a = fires(rules, x)
    most = np.abs(a[learn].T @ (y[learn] - y[learn].mean())).max() / learn.sum()
    best = None
    for share in PENALTIES:
        b, w = lasso(a[learn], y[learn], share * most)
        m = b + a[~learn] @ w
        loss = float(np.mean(np.logaddexp(0, m) - y[~learn] * m))
        if best is None or loss < best[0]:
            best = (loss, b, w)
    _, b, w = best
    return b, [(float(v), r) for v, r in zip(w, rules, strict=True) if abs(v) > 1e-6]


def compile_rules(intercept: float, weighted: list[tuple[float, Rule]]) -> Column:
    """The ensemble as a column over STATISTICS."""
    total = F.lit(intercept)
    for weight, rule in weighted:
        holds = F.lit(True)
        for f, below, t in rule:
            holds = holds & (F.col(STATISTICS[f]) <= t if below else F.col(STATISTICS[f]) > t)
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, and STATISTICS) for each row of docs."""
    stats = materialise(with_statistics(docs), "statistics")
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).where(~held_out("doc_id", 3, 1))
    # labels of documents that are not here take no place in the sample
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).join(stats.select("doc_id"), "doc_id", "left_semi")
    ids = [(r.doc_id, r.y) for k in (0, 1) for r in known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_PER_CLASS).collect()]
    learnt = stats.join(F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, y int")), "doc_id")
    # one row an id, so that repeats of an id don't come to the driver
    learnt = learnt.groupBy("doc_id").agg(F.min("y").alias("y"), F.min(F.struct(*STATISTICS)).alias("x")).select("y", "x.*")
    rows = sorted(map(tuple, learnt.collect()))
    x = np.array([r[1:] for r in rows], dtype=np.float64).reshape(-1, len(STATISTICS))
    column = compile_rules(*fit(x, np.array([r[0] for r in rows], dtype=np.int64)))
    return stats.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), column.alias("score"), *STATISTICS).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select("doc_id", "held_out", "score", "predicted", *STATISTICS)
