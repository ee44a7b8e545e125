"""Quality rules: boosted trees over document statistics.

Statistics of each whole text go through fixed base rules and a model. The model is a gradient-boosted sum of
shallow trees for the log-odds of a bad document, grown on histograms of a bounded sample of labelled
documents (``SAMPLE`` rows, chosen by the hash of their key). Statistics of repetition and junk are
monotone: with more of them a document never counts as better. The trees are flattened into arrays (feature,
threshold, children, value), and all trees of all rows step down one level at a time.

Defined cases: null and empty texts have no word and fail the base rules; rows are independent, so repeated
rows and ties get equal verdicts; labels of unknown documents and null labels are ignored; without labels of both
kinds only the base rules decide; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm.common import whole_text

SAMPLE = 8192
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Statistic -> direction in which a document can only get worse (0: either way).
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_share": 1, "dup_line_share": 1, "repeat_share": 1,
            "distinct_share": -1, "words_per_line": 0, "one_char_share": 1, "stop_share": 0, "top_word_share": 1,
            "digit_share": 0, "upper_share": 0}


def _repeated(ids: np.ndarray, n_ids: int) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    pair = np.unique(ids[:-1] * n_ids + ids[1:], return_inverse=True)[1]
    _, which, count = np.unique(pair[:-1] * n_ids + ids[2:], return_inverse=True, return_counts=True)
    again = count[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= again
    return int(covered.sum())


def statistics(text: str) -> tuple:
    """The counts, then the features, of one whole text."""
    raw = text.encode()
    words = raw.split()  # bytes split at \x20 and \x09-\x0D only
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    repeated = _repeated(ids, len(known))
    counts = (n, word_chars, n_symbols, dup_lines, repeated)
    if not n:
        return counts + (0.0,) * len(FEATURES)
    size = np.fromiter(map(len, known), np.int64, len(known))
    often = np.bincount(ids)
    stops = sum(raw.count(b + b" ") for b in (b".", b",", b"!", b"?", b";", b":"))
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
    return counts + (
        float(np.log1p(n)), word_chars / n, n_symbols / word_chars, dup_lines / max(len(lines), 1), repeated / n,
        len(known) / n, n / max(len(lines), 1), float(often[size == 1].sum()) / n, stops / n, float(often.max()) / n,
        float(byte[48:58].sum()) / len(raw), float(byte[65:91].sum()) / len(raw),
    )


def with_statistics(df: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """Adds a struct with the counts and features of each whole text."""
    kind = ", ".join([f"{c} long" for c in COUNTS] + [f"{f} double" for f in FEATURES])

    @F.pandas_udf(kind)
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([statistics(t) for t in batch], columns=[*COUNTS, *FEATURES])

    return df.withColumn(out, stats.asNondeterministic()(whole_text(text)))


class Trees:
    """Boosted trees for the log-odds of a bad document, kept as flat arrays of nodes."""

    def __init__(self, base: float, nodes: list[tuple], roots: list[int]):
        self.base, self.roots = base, np.array(roots, np.int64)
        table = np.array(nodes, float).reshape(-1, 5)
        self.feature, self.left, self.right = (table[:, k].astype(np.int64) for k in (0, 2, 3))
        self.threshold, self.value = table[:, 1], table[:, 4]

    def score(self, x: np.ndarray) -> np.ndarray:
        """All trees of all rows go down one level at a time; a leaf's children are the leaf itself."""
        if not len(self.roots):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        while True:
            goes_left = np.take_along_axis(x, self.feature[at], axis=1) <= self.threshold[at]
            down = np.where(goes_left, self.left[at], self.right[at])
            if (down == at).all():
                return self.base + self.value[at].sum(axis=1)
            at = down


def fit(x: np.ndarray, bad: np.ndarray, direction: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2,
        bins: int = 64, least: float = 4.0, ridge: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss on quantile histograms.

    A split on a directed feature must raise (or lower) the values in its direction, and the middle of its two
    values bounds all that is grown below on either side, so that no later split can undo it.
    """
    share = min(max(float(bad.mean()) if len(bad) else 0.0, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    if not len(bad) or bad.min() == bad.max():
        return Trees(base if len(bad) else -10.0, [], [])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    nodes: list[list] = []
    roots: list[int] = []
    score = np.full(len(bad), base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-total_g / (total_h + ridge), low, high))
        nodes.append([0, 0.0, me, me, rate * value])
        best = (1e-6, None)
        for f in range(x.shape[1]) if level < depth else ():
            if not len(cuts[f]):
                continue
            gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(cuts[f]) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(cuts[f]) + 1))[:-1]
            gr, hr = total_g - gl, total_h - hl
            vl, vr = (np.clip(-a / (b + ridge), low, high) for a, b in ((gl, hl), (gr, hr)))
            gain = -(gl * vl + (hl + ridge) * vl * vl / 2) - (gr * vr + (hr + ridge) * vr * vr / 2)
            gain = gain + total_g * value + (total_h + ridge) * value * value / 2
            ok = (hl >= least / 4) & (hr >= least / 4)
            if direction[f]:
                ok &= direction[f] * (vr - vl) >= 0
            gain = np.where(ok, gain, -np.inf)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), (f, k, float(vl[k]), float(vr[k])))
        if best[1] is not None:
            f, k, vl, vr = best[1]
            middle = (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
            (ll, lh), (rl, rh) = bounds[direction[f]]
            goes = binned[rows, f] <= k
            nodes[me][0], nodes[me][1] = f, float(cuts[f][k])
            nodes[me][2] = grow(rows[goes], g, h, level + 1, ll, lh)
            nodes[me][3] = grow(rows[~goes], g, h, level + 1, rl, rh)
            nodes[me][4] = 0.0
        return me

    everyone = np.arange(len(bad))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        start = len(nodes)
        roots.append(grow(everyone, p - bad, p * (1 - p), 0, -4.0, 4.0))
        one = Trees(0.0, [[n[0], n[1], n[2] - start, n[3] - start, n[4]] for n in nodes[start:]], [0])
        score = score + one.score(x)
    return Trees(base, nodes, roots)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                    label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and badness of at most ``sample`` labelled documents, the first by the hash of their key."""
    chosen = (labels.select(F.col(key).alias("key"), (F.col(label) == 0).cast("int").alias("bad")).dropna()
              .groupBy("key").agg(F.max("bad").alias("bad"))
              .orderBy(F.xxhash64("key"), "key").limit(sample))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    got = (with_statistics(rows, "text").select("key", "bad", *[f"stats.{f}" for f in FEATURES])
           .groupBy("key").agg(*[F.max(c).alias(c) for c in ["bad", *FEATURES]]).orderBy("key").toPandas())
    return got[list(FEATURES)].to_numpy(float), got["bad"].to_numpy(float)


def quality_model(docs: DataFrame, labels: DataFrame, **names) -> Trees:
    return fit(*labelled_sample(docs, labels, **names), list(FEATURES.values()))


def judge(df: DataFrame, model: Trees, text: str = "text", out: str = "judged", at_most: float = 0.5) -> DataFrame:
    """Adds a struct: the counts, base_failed, p_bad and kept (base passed and p_bad at most ``at_most``)."""
    kind = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, p_bad double, kept boolean"

    @F.pandas_udf(kind)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = pd.DataFrame([statistics(t) for t in batch], columns=[*COUNTS, *FEATURES])
            failed = (got["n_words"] < 50) | (100 * got["n_repeat_words"] > 50 * got["n_words"])
            p_bad = 1 / (1 + np.exp(-model.score(got[list(FEATURES)].to_numpy(float))))
            yield got[COUNTS].assign(base_failed=failed, p_bad=p_bad, kept=~failed & (p_bad <= at_most))

    return df.withColumn(out, judged.asNondeterministic()(whole_text(text)))
