"""Reading level of English prose, 1 (newcomer) to 4 (specialist).

Every document is described by how its sentence and word lengths, its vocabulary, its syntax and its cohesion are
distributed. Gradient-boosted regression trees are trained on raters' bands of a bounded sample of documents. Predictions
are cross-validated by source (no source is in both the training and the held-out part), and the cuts between bands are
calibrated on these held-out predictions.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.session import materialise

#: Labelled documents that the trees are trained on, at most.
MAX_LABELLED = 12_000
MIN_WORDS = 40

# Frequent English words, and words that join clauses plainly or formally.
ENGLISH = frozenset("the a an of to and in is are was that it its for this each every any one our my we you he she they them not as by with from under no may must can could will would should might be been or if on at but so than then when while because after before another into has have had do does did".split())
PLAIN_JOINS = frozenset("and but so because when while if after before until unless where yet then first next".split())
FORMAL_JOINS = frozenset("although whereas however therefore moreover consequently notwithstanding conversely albeit irrespective provided insofar whenever furthermore nevertheless thereby hence thus".split())

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_TAG = re.compile(r"<[^<>\n]{1,200}>|&#?\w{2,8};")
_LINK = re.compile(r"\b(?:https?|ftp)://\S+|\bwww\.\S+")
_HEAD = re.compile(r"\s*(?:#{1,6}\s|={2,}|-{3,}|\+{3,}|\|)")
_BULLET = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+")
_END = re.compile(r"[.!?:;][\"')\]]*\s*$")
_SPLIT = re.compile(r"(?<=[.!?])[\"')\]]?\s+(?=[\"'(]?[A-Z])")
_WORD = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")
_NAME = re.compile(r"(?<=[a-z,;] )[A-Z][a-z]+")
_DIGIT = re.compile(r"\d")

FEATURES = (
    "log_words mean_sentence sd_sentence p25_sentence p50_sentence p90_sentence max_sentence mean_word sd_word p50_word p75_word p90_word "
    "long7 long10 long13 variety rare_once english plain formal commas semicolons per_clause overlap new_words digits names short_sentences"
).split()


def prose_lines(text: str) -> list[str]:
    """The lines of running prose: without code, links, headings, tables and bare list entries; list items that are
    sentences count."""
    if "```" in text:
        text = _FENCE.sub("\n", text)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    if "://" in text or "www." in text:
        text = _LINK.sub(" ", text)
    out = []
    for line in text.replace("\r", "\n").split("\n"):
        if len(line) < 3 or _HEAD.match(line):
            continue
        bullet = _BULLET.match(line)
        if bullet:
            line = line[bullet.end() :]
        if _END.search(line) or (not bullet and line.count(" ") >= 7):
            out.append(line)
    return out


def _quantile(sorted_values: list, q: float) -> float:
    return sorted_values[min(len(sorted_values) - 1, int(q * len(sorted_values)))]


def _spread(total: float, squares: float, n: int) -> tuple[float, float]:
    mean = total / n
    return mean, max(0.0, squares / n - mean * mean) ** 0.5


def describe(text: str | None, min_words: int = MIN_WORDS) -> list[float] | None:
    """The features of a text; None unless it has min_words words of English prose."""
    if not text:
        return None
    lines = prose_lines(text)
    sentences = [words for line in lines for part in _SPLIT.split(line) if len(words := _WORD.findall(part.lower())) > 1]
    counts: Counter[str] = Counter()
    for words in sentences:
        counts.update(words)
    n, m = sum(map(len, sentences)), len(sentences)
    if n < min_words:
        return None
    english = sum(counts[w] for w in ENGLISH & counts.keys()) / n
    if english < 0.15:
        return None
    joined = "\n".join(lines)
    plain = sum(counts[w] for w in PLAIN_JOINS & counts.keys())
    formal = sum(counts[w] for w in FORMAL_JOINS & counts.keys())
    commas, semicolons = joined.count(","), joined.count(";")
    sizes = sorted(map(len, sentences))
    by_length = [0] * 41
    for word, c in counts.items():
        by_length[min(len(word), 40)] += c
    upto = list(accumulate(by_length))
    mean_size, sd_size = _spread(sum(sizes), sum(k * k for k in sizes), m)
    mean_word, sd_word = _spread(sum(k * c for k, c in enumerate(by_length)), sum(k * k * c for k, c in enumerate(by_length)), n)
    seen: set[str] = set()
    before: set[str] = set()
    shared, compared, fresh = 0.0, 0, 0
    for words in sentences:
        content = set(words) - ENGLISH
        if before and content:
            shared += len(before & content) / len(content)
            compared += 1
        fresh += len(content - seen)
        seen |= content
        before = content
    return [
        log(n), mean_size, sd_size, _quantile(sizes, 0.25), _quantile(sizes, 0.5), _quantile(sizes, 0.9), sizes[-1],
        mean_word, sd_word, bisect_left(upto, 0.5 * n), bisect_left(upto, 0.75 * n), bisect_left(upto, 0.9 * n),
        1 - upto[6] / n, 1 - upto[9] / n, 1 - upto[12] / n, len(counts) / n**0.75, sum(c == 1 for c in counts.values()) / len(counts), english,
        plain / n, formal / n, commas / m, semicolons / m, n / (plain + formal + commas + semicolons + m), shared / max(compared, 1), fresh / n,
        len(_DIGIT.findall(joined)) / len(joined), len(_NAME.findall(joined)) / n, bisect_left(sizes, 8) / m,
    ]


@dataclass
class Trees:
    """Regression trees of equal depth, as arrays: feature and threshold of each inner node, value of each leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.12, bins: int = 32, least: float = 20.0) -> Trees:
    """Least-squares gradient boosting over histograms; each level of a tree is one count per feature."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    base, inner = float(y.mean()), 2**depth - 1
    fit = np.full(n, base)
    feature, threshold, leaves = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for k in range(trees):
        gap = y - fit
        node = np.zeros(n, int)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            local = node - first
            best = np.full(many, 1e-9)
            total_n = np.bincount(local, minlength=many).astype(float)
            total_g = np.bincount(local, gap, many)
            pick = np.zeros(many, int)
            cut = np.full(many, bins)
            for j in range(width):
                cell = local * bins + binned[:, j]
                cn = np.bincount(cell, minlength=many * bins).reshape(many, bins).cumsum(1)[:, :-1]
                cg = np.bincount(cell, gap, many * bins).reshape(many, bins).cumsum(1)[:, :-1]
                rn, rg = total_n[:, None] - cn, total_g[:, None] - cg
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((cn >= least) & (rn >= least), cg**2 / cn + rg**2 / rn - (total_g**2 / np.maximum(total_n, 1))[:, None], -1.0)
                at = gain.argmax(1)
                value = gain[np.arange(many), at]
                better = value > best
                best[better], pick[better], cut[better] = value[better], j, at[better]
            for i in range(many):
                if cut[i] < len(cuts[pick[i]]):
                    feature[k, first + i], threshold[k, first + i] = pick[i], cuts[pick[i]][cut[i]]
                else:
                    cut[i] = bins
            node = 2 * node + 1 + (binned[np.arange(n), pick[local]] > cut[local])
        local = node - inner
        size = np.bincount(local, minlength=inner + 1)
        leaves[k] = rate * np.bincount(local, gap, inner + 1) / np.maximum(size, 1)
        fit += leaves[k][local]
    return Trees(base, feature, threshold, leaves, depth)


def held_out(x: np.ndarray, y: np.ndarray, groups: np.ndarray, folds: int = 5, **how) -> np.ndarray:
    """Predictions for each row by trees that saw no row of its group; the groups are dealt out by size."""
    names, sizes = np.unique(groups, return_counts=True)
    load, fold_of = np.zeros(folds), {}
    for g in np.argsort(-sizes, kind="stable"):
        f = int(load.argmin())
        fold_of[names[g]] = f
        load[f] += sizes[g]
    fold = np.array([fold_of[g] for g in groups])
    out = np.full(len(y), float(y.mean()))
    for f in range(folds):
        test = fold == f
        if test.any() and (~test).sum() > 1:
            out[test] = boost(x[~test], y[~test], **how).predict(x[test])
    return out


def calibrate(predicted: np.ndarray, y: np.ndarray, bands: int = 4) -> np.ndarray:
    """The cuts between bands for which the held-out predictions fall into the raters' bands with the least error.

    y may lie between bands (raters differ); its distance to the band counts. One pass: between each two bands the best cut
    separates y below and above their middle.
    """
    order = np.argsort(predicted, kind="stable")
    p, t = predicted[order], y[order]
    cuts = []
    for b in range(1, bands):
        cost = np.concatenate([[0.0], np.cumsum(np.clip(t - (b + 0.5), -0.5, 0.5))])  # moving the cut right past a row gains if y is below it
        k = int(cost.argmin())
        cuts.append((p[max(k - 1, 0)] + p[min(k, len(p) - 1)]) / 2)
    return np.maximum.accumulate(np.array(cuts))


def features_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, x) of the documents that have a reading level; NULL source is a source of its own."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [describe(t) for t in batch["text"].tolist()]
            keep = [v is not None for v in x]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[keep], "source": batch["source"].to_numpy()[keep], "x": [np.asarray(v, "float32") for v in x if v is not None]})

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    return rows.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInPandas(scan, "doc_id bigint, source string, x array<float>")


def labelled_sample(features: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> pd.DataFrame:
    """(source, x, y) of at most `most` labelled documents, chosen by the hash of their id; y: the mean of the raters' bands."""
    y = labels.where("reading_band BETWEEN 1 AND 4 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("reading_band").alias("y"))
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return features.join(chosen, "doc_id").select("source", "x", "y").toPandas()


def reading_bands(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, reading_band): the band of each document with at least 40 words of English prose.

    docs: doc_id, text, source; labels: doc_id, reading_band. Whatever a lang column says is ignored. Logs, dumps, short
    messages, other languages, NULL and empty texts give no row; a very long text is described whole. Repeated documents
    give repeated rows. Without usable labels there is nothing to learn from and the result is empty.
    """
    features = materialise(features_of(docs))
    sample = labelled_sample(features, labels, most)
    if sample.empty:
        return features.select("doc_id", F.lit(None).cast("bigint").alias("reading_band")).limit(0)
    x, y = np.stack(sample["x"].tolist()).astype(float), sample["y"].to_numpy()
    cuts = calibrate(held_out(x, y, sample["source"].to_numpy().astype(str)), y)
    trees = boost(x, y)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                value = trees.predict(np.stack(batch["x"].tolist()).astype(float))
                yield pd.DataFrame({"doc_id": batch["doc_id"], "reading_band": 1 + np.searchsorted(cuts, value, side="right")})

    return features.select("doc_id", "x").mapInPandas(score, "doc_id bigint, reading_band bigint")
