"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Training takes at most ``SAMPLE`` labelled rows (those of least hash of doc_id), so what reaches the driver is bounded:
that many feature rows and the words that LEAST_DOCS of them share. The lexicon and the trees that calibrate a fold come
from the other folds. Scoring maps every text on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, LEAST_DOCS, LEAST_ODDS, FOLDS = 12_000, 8, 2.5, 3
SECOND = frozenset(["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "vous", "votre", "vos", "ti", "tú", "usted", "ustedes", "su"])
#: Look-alike characters and the letters they stand for.
LOOK = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"})
WORD = re.compile(r"[^\W\d_]+")
MIXED = re.compile(r"[^\W\d_]+[0-9@$!|+*._\-][^\s]*[^\W\d_]|[0-9@$!|+][^\W\d_]{2}[^\s]*")
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
STRIP = re.compile(r"[^\W\d_]+")
N_FEATURES = 14


def features(text: str, lexica: Sequence[dict[str, float]]) -> list[list[float]]:
    """Dense features of one text by each lexicon; the text is read once. An empty text gives zeros."""
    words = WORD.findall(text.lower())
    starts = ["^" + w[:5] for w in words]
    second = np.array([i for i, w in enumerate(words) if w in SECOND])
    hidden = [m.group() for m in MIXED.finditer(text)] + [m.group() for m in SPACED.finditer(text)]
    bare = []  # the words each obfuscated one may stand for
    for x in hidden:
        low = x.lower()
        parts = STRIP.findall(low.translate(LOOK))
        bare.append({"".join(parts), "".join(STRIP.findall(low)), *parts})
    per, chars = 1.0 / max(1, len(words)), max(1, len(text))
    upper = sum(map(str.isupper, text)) / chars
    marks = [text.count("!") / chars, sum(map(text.count, "%&*$#@")) / chars, len(hidden) * per, float(np.log1p(len(words)))]
    return [_by_lexicon(x, words, starts, second, bare, per, upper, marks) for x in lexica]


def _by_lexicon(lexicon: dict[str, float], words: list[str], starts: list[str], second: np.ndarray, bare: list[set[str]], per: float, upper: float, marks: list[float]) -> list[float]:
    strong = [i for i, w in enumerate(words) if w in lexicon or starts[i] in lexicon]
    worth = [lexicon.get(words[i]) or lexicon[starts[i]] for i in strong]
    caught = sum(not lexicon.keys().isdisjoint(x) for x in bare)
    near = 0
    if strong and len(second):
        at = np.searchsorted(second, strong)
        gap = np.minimum(np.abs(strong - second[np.maximum(at - 1, 0)]), np.abs(strong - second[np.minimum(at, len(second) - 1)]))
        near = int((gap <= 3).sum())
    return [len(strong), len(strong) * per, sum(worth), max(worth, default=0.0), len({words[i] for i in strong}), caught, caught * per, len(second) * per, near, upper, *marks]


def matrix(texts: list[str | None], lexica: Sequence[dict[str, float]]) -> np.ndarray:
    """A row for each text: its features by each lexicon, one after another."""
    return np.array([features(x or "", lexica) for x in texts], np.float64).reshape(-1, N_FEATURES * len(lexica))


class Trees:
    """Boosted regression trees on the logistic loss, splits at quantiles of each feature."""

    def __init__(self, count: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, leaf: float = 5.0):
        self.count, self.depth, self.rate, self.bins, self.leaf = count, depth, rate, bins, leaf

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.concatenate([np.quantile(c, np.linspace(0, 1, self.bins)[1:-1]), np.quantile(c[c > 0], np.linspace(0, 1, 9)[:-1]) - 1e-12 if (c > 0).any() else []])) for c in x.T]
        code = self._codes(x)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(mean / (1 - mean))), []
        raw = np.full(len(y), self.base)
        for _ in range(self.count):
            p = 1 / (1 + np.exp(-raw))
            tree = self._tree(code, y - p, p * (1 - p))
            self.trees.append(tree)
            raw += self._one(tree, code)
        return self

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)

    def _tree(self, code: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple[int, int, float]]:
        """A full binary tree in level order: (feature, bin, value)."""
        size = 2 ** (self.depth + 1) - 1
        nodes, at = [(0, 1 << 30, 0.0)] * size, np.zeros(len(g), np.int64)
        for node in range(size):
            mine = at == node
            gs, hs = g[mine].sum(), h[mine].sum()
            value = self.rate * gs / (hs + 1.0)
            best, where = 1e-6, (0, 1 << 30)
            if node < 2**self.depth - 1 and mine.sum() >= 2 * self.leaf:
                for j in range(code.shape[1]):
                    width = len(self.cuts[j]) + 1
                    gl = np.cumsum(np.bincount(code[mine, j], g[mine], width))[:-1]
                    hl = np.cumsum(np.bincount(code[mine, j], h[mine], width))[:-1]
                    nl = np.cumsum(np.bincount(code[mine, j], minlength=width))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(nl < self.leaf) | (mine.sum() - nl < self.leaf)] = 0
                    if len(gain) and gain.max() > best:
                        best, where = gain.max(), (j, int(gain.argmax()))
            nodes[node] = (*where, value)
            if where[1] != 1 << 30:
                at[mine] = np.where(code[mine, where[0]] <= where[1], 2 * node + 1, 2 * node + 2)
        return nodes

    def _one(self, tree: list[tuple[int, int, float]], code: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(c) for c in zip(*tree, strict=True))
        at, rows = np.zeros(len(code), np.int64), np.arange(len(code))
        for _ in range(self.depth):
            go = cut[at] != 1 << 30
            down = 2 * at + 1 + (code[rows, feature[at]] > cut[at])
            at = np.where(go, down, at)
        return value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        code = self._codes(x)
        raw = np.full(len(x), self.base)
        for t in self.trees:
            raw += self._one(t, code)
        return 1 / (1 + np.exp(-raw))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, share of ones), both not falling."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, weight, sum of score
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``doc_id, text, toxic``: at most ``most`` labelled rows that aren't held out. The ids are bounded, so they are sent to the texts.

    Each id gives one row: of its texts the least by hash. Repeated rows go before the shuffle, so the bound holds for rows too.
    """
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("toxic").alias("toxic"))


def _lexicon(words: list[tuple[str, list[int], list[int]]], n_toxic: list[int], n_clean: list[int], without: int | None) -> dict[str, float]:
    """Log odds of the words that mark toxic texts, by the texts of all folds but one."""
    keep = [f for f in range(FOLDS) if f != without]
    p, q = sum(n_toxic[f] for f in keep), sum(n_clean[f] for f in keep)
    out = {}
    for w, toxic, clean in words:
        a, b = sum(toxic[f] for f in keep), sum(clean[f] for f in keep)
        odds = float(np.log((a + 0.5) / max(p, 1)) - np.log((b + 0.5) / max(q, 1)))
        if a >= LEAST_DOCS * len(keep) / FOLDS and odds > LEAST_ODDS:
            out[w] = odds
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict | None:
    """The model, or None without labels of both kinds."""
    rows = sample(docs, labels, most).where("text is not null").withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(FOLDS)).cast("int"))
    once = rows.groupBy("text", "fold").agg(F.max("toxic").alias("toxic"))  # equal texts count once
    of = {(r.fold, r.toxic): r.n for r in once.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = ([of.get((f, t), 0) for f in range(FOLDS)] for t in (1, 0))
    if not sum(n_toxic) or not sum(n_clean):
        return None
    whole = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    starts = F.transform(F.filter(whole, lambda w: F.length(w) > 5), lambda w: F.concat(F.lit("^"), F.substring(w, 1, 5)))  # for inflected forms
    words = once.select("fold", "toxic", F.explode(F.array_distinct(F.concat(whole, starts))).alias("w"))
    count = lambda f, t: F.sum(((F.col("fold") == f) & (F.col("toxic") == t)).cast("int")).alias(f"{'ab'[1 - t]}{f}")
    found = words.groupBy("w").agg(*(count(f, t) for t in (1, 0) for f in range(FOLDS)))
    found = found.where(f"a0 + a1 + a2 >= {LEAST_DOCS} * 2 / 3").orderBy("w").collect()
    table = [(r["w"], [r[f"a{f}"] for f in range(FOLDS)], [r[f"b{f}"] for f in range(FOLDS)]) for r in found]
    lexica = [_lexicon(table, n_toxic, n_clean, f) for f in (*range(FOLDS), None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                x = matrix(part.column(0).to_pylist(), lexica)
                yield pa.RecordBatch.from_pydict({"x": pa.array(x.tolist(), pa.list_(pa.float64())), "y": part.column(1).cast(pa.int32()), "fold": part.column(2), "k": part.column(3)})

    got = rows.select("text", "toxic", "fold", F.xxhash64("doc_id", "text").alias("k")).mapInArrow(run, "x array<double>, y int, fold int, k long").toPandas().sort_values("k", kind="stable")
    every, y, fold = np.array(got["x"].tolist()).reshape(len(got), FOLDS + 1, N_FEATURES), got["y"].to_numpy(float), got["fold"].to_numpy()
    loose = np.full(len(y), 0.0)
    for f in range(FOLDS):
        rest = fold != f
        if 0 < y[rest].sum() < rest.sum():
            x = every[:, f]
            loose[~rest] = Trees().fit(x[rest], y[rest]).predict(x[~rest])
    return {"lexicon": lexica[-1], "trees": Trees().fit(every[:, -1], y), "knots": isotonic(loose, y)}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """``doc_id, score`` for each row; without a model the score is 0. Null is an empty text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                s = np.interp(m["trees"].predict(matrix(part.column(1).to_pylist(), [m["lexicon"]])), *m["knots"]) if m else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(s, 0, 1))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``; repeated rows are scored alike, a null doc_id isn't held out,
    null and empty texts are scored by features of zero, an empty table gives no rows; other columns aren't looked at."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
