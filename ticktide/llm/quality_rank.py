"""Quality classifier: a Bradley-Terry ranking learned from preference pairs, thresholded by score quantile."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, table

#: As how many preference pairs all of them count beside the ridge.
FIT_PAIRS = 100_000
#: Scores in one such bin meet others at their mean while fitting.
WIDTH = 1 / 32
#: Bins of a step towards the quantile, values that are gathered for it, and tasks of a pass over the labelled rows.
STEPS, FEW, TASKS = 4096, 10_000, 16
FEATURES = ("words", "word_length", "upper", "symbols", "digits", "marks", "shouts", "distinct", "echoes", "dup_lines", "line_words", "stops", "long_words", "ascii")


def describe(text: str | None) -> list[float]:
    """The features of one whole text; zeros for null or wordless ones."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    chars = sum(map(len, words))
    count = lambda cut: len(raw) - len(raw.translate(None, cut))
    lines = [x for x in text.split("\n") if x.strip()]
    echoes = sum(map(str.__eq__, words, words[1:]))
    marks = count(b"!?")
    return [
        math.log1p(n),
        math.log1p(chars / n),
        math.sqrt(count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars),
        math.sqrt(count(b"#*$%&|<>~^_=\\{}[]@/") / chars),
        math.sqrt(count(b"0123456789") / chars),
        math.sqrt(count(b".,;:") / chars),
        math.sqrt(marks / chars),
        math.log(len(set(words))) / math.log(n) if n > 1 else 1.0,
        math.sqrt(echoes / n),
        math.sqrt(1 - len(set(lines)) / len(lines)),
        math.log1p(n / len(lines)),
        math.sqrt(sum(len(w) <= 3 for w in words) / n),
        math.sqrt(sum(len(w) > 20 for w in words) / n),
        len(raw.decode("ascii", "ignore")) / len(raw),
    ]


def _merge(a: dict, b: dict) -> dict:
    """Sums, least or greatest values by key, as the key's first letter says."""
    for k, v in b.items():
        a[k] = v if k not in a else a[k] + v if k[0] == "+" else np.minimum(a[k], v) if k[0] == "<" else np.maximum(a[k], v)
    return a


def gather(rows: DataFrame, f: Callable[[np.ndarray, np.ndarray], dict]) -> dict:
    """f over x and y of all rows, batch by batch; only the merged results of tasks reach the driver."""

    def run(batches):
        found: dict = {}
        for b in batches:
            if b.num_rows:
                _merge(found, f(np.array(b.column(0).to_pylist(), float), b.column(1).to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["found"])

    out: dict = {}
    for r in rows.select("x", "y").coalesce(TASKS).mapInArrow(run, "found binary").collect():
        _merge(out, pickle.loads(r["found"]))
    return out


class BradleyTerry:
    """Scores w.x with P(i before j) = sigmoid(w.(x_i - x_j)), fitted by Newton steps with a ridge.

    All pairs of a good and a bad row count, together as FIT_PAIRS; with pairs, that many drawn ones do instead."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int | None = None, ridge: float = 5.0, seed: int = 7):
        if pairs is None:
            return self._fit(lambda f: f(x, y) if len(x) else {}, ridge)
        self._start(len(x), x.sum(0), (x**2).sum(0), int((y == 1).sum()))
        z = self._z(x) if len(x) else x
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return
        rng = np.random.default_rng(seed)
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        self._climb(lambda w: self._step(w, d, 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))), ridge)
        self._place(lambda f: f(x, y), len(x), len(bad))

    @classmethod
    def over(cls, rows: DataFrame, ridge: float = 5.0) -> BradleyTerry:
        """Fitted on x and y of all rows, in some twenty passes over them; rows are best staged."""
        model = cls.__new__(cls)
        model._fit(lambda f: gather(rows, f), ridge)
        return model

    def _start(self, n: int, total, squares, good: int) -> None:
        size = len(FEATURES)
        self.mean, self.spread = (total / n, np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0)) + 1e-9) if n else (np.zeros(size), np.ones(size))
        self.w, self.cut, self.scale = np.zeros(size), 0.0, 1.0
        self.share = good / n if n else 1.0

    @staticmethod
    def _step(w: np.ndarray, d: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the likelihood of drawn pairs."""
        return d.T @ (1 - p), (d * (p * (1 - p))[:, None]).T @ d

    def _climb(self, step, ridge: float) -> None:
        for _ in range(12):
            slope, curve = step(self.w)
            move = np.linalg.solve(curve + ridge * np.eye(len(self.w)), slope - ridge * self.w)
            self.w = self.w + move
            if np.abs(move).max() < 1e-6:
                break

    def _fit(self, over: Callable, ridge: float) -> None:
        """Fits on all rows that over runs a function on: over(f) is f of them, merged."""
        kinds = over(lambda x, y: {("+", "n"): len(x), ("+", "x"): x.sum(0), ("+", "xx"): (x**2).sum(0), ("+", "good"): int((y == 1).sum())})
        n, good = kinds.get(("+", "n"), 0), kinds.get(("+", "good"), 0)
        bad = n - good
        self._start(n, kinds.get(("+", "x")), kinds.get(("+", "xx")), good)
        if not good or not bad:
            return
        size = len(FEATURES)

        def step(w: np.ndarray):
            def bins(x, y):
                """Rows, their score, features and products of features, summed by label and bin of scores."""
                z = self._z(x)
                s = z @ w
                at = np.floor(s / WIDTH).astype(np.int64) * 2 + (y == 1)
                order = np.argsort(at, kind="stable")
                keys, start = np.unique(at[order], return_index=True)
                z = z[order]
                rows = np.concatenate((np.ones((len(z), 1)), s[order][:, None], z, (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)), axis=1)
                return {("+", k): v for k, v in zip(keys.tolist(), np.add.reduceat(rows, start), strict=True)}

            found = over(bins)
            side = [np.array([v for k, v in sorted(found.items()) if k[1] % 2 == label]) for label in (1, 0)]
            (gn, gs, gz, gzz), (bn, bs, bz, bzz) = ((v[:, 0], v[:, 1] / v[:, 0], v[:, 2 : 2 + size], v[:, 2 + size :]) for v in side)
            p = 1 / (1 + np.exp(-np.clip(gs[:, None] - bs, -30, 30)))
            q, both = p * (1 - p), gz.T @ (p * (1 - p)) @ bz
            slope = gz.T @ ((1 - p) @ bn) - bz.T @ (gn @ (1 - p))
            curve = (gzz.T @ (q @ bn) + bzz.T @ (gn @ q)).reshape(size, size) - both - both.T
            return slope * FIT_PAIRS / good / bad, curve * FIT_PAIRS / good / bad

        self._climb(step, ridge)
        self._place(over, n, bad)

    def _place(self, over: Callable, n: int, bad: int) -> None:
        """The quantile of all scores that leaves the share of good documents above it, midway between its neighbours, and their spread."""
        score = lambda x: self._z(x) @ self.w
        found = over(lambda x, y: {("+", "s"): score(x).sum(), ("+", "ss"): (score(x) ** 2).sum(), ("<", "s"): score(x).min(), (">", "s"): score(x).max()})
        self.scale = float(math.sqrt(max(found["+", "ss"] / n - (found["+", "s"] / n) ** 2, 0)) + 1e-9) / 2
        low, high, held = found["<", "s"], found[">", "s"], n
        k = min(max(bad, 1), n - 1)
        first, last = k - 1, k  # ranks among the scores from low to high
        while held > FEW and high > low:

            def steps(x, y, low=low, high=high):
                s = score(x)
                s = s[(s >= low) & (s <= high)]
                at = np.minimum(((s - low) / (high - low) * STEPS).astype(np.int64), STEPS - 1)
                least, most = np.full(STEPS, np.inf), np.full(STEPS, -np.inf)
                np.minimum.at(least, at, s)
                np.maximum.at(most, at, s)
                return {("+", "n"): np.bincount(at, minlength=STEPS), ("<", "s"): least, (">", "s"): most}

            found = over(steps)
            upto = np.cumsum(found["+", "n"])
            i, j = (int(np.searchsorted(upto, r, "right")) for r in (first, last))
            before, now = int(upto[i] - found["+", "n"][i]), int(upto[j] - upto[i] + found["+", "n"][i])
            first, last = first - before, last - before
            if (low, high) == (found["<", "s"][i], found[">", "s"][j]):
                break
            low, high, held = found["<", "s"][i], found[">", "s"][j], now

        def values(x, y):
            s = score(x)
            return {("+", v): c for v, c in zip(*(a.tolist() for a in np.unique(s[(s >= low) & (s <= high)], return_counts=True)), strict=True)}

        found = sorted((v, c) for (_, v), c in over(values).items())
        upto = np.cumsum([c for _, c in found])
        at = [found[min(int(np.searchsorted(upto, r, "right")), len(found) - 1)][0] for r in (first, last)]
        self.cut = float(sum(at)) / 2

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self._z(x) @ self.w - self.cut) / self.scale, -30, 30)))


def describe_all(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and x, the feature array, of every row."""

    def run(batches):
        for b in batches:
            rows = [describe(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, x array<double>")


def fit(described: DataFrame, labels: DataFrame, label: str = "quality") -> BradleyTerry:
    """Fits on every labelled row. Of labels that contradict each other the least counts."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y")).where("y is not null and id is not null").groupBy("id").agg(F.min("y").alias("y"))
    return BradleyTerry.over(stage(described.join(known, "id").select("x", "y"), "labelled"))


def rank(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, score and predicted for every row of docs; labels has doc_id and quality (1: good).

    Only the text enters a score. All pairs of a good and a bad labelled document are preferences; the
    logistic loss on their feature differences gives the weights, and the score is the logistic of
    the distance from the quantile of fitted scores that the good share leaves above. Nothing is
    drawn: sums by bin of scores stand for the pairs, and the quantile is of all labelled documents. Null, empty
    and wordless texts are scored on zero features; with no labels of one kind every score is 0.5.
    A score of exactly 0.5 predicts 1. Repeated rows score alike, texts count whole, other columns
    are ignored, and an empty table gives no rows."""
    described = stage(describe_all(docs, id_col, text), "described")
    model = fit(described, labels)

    def run(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x), pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = described.mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every document, learned outside the held-out third."""
    ranked = rank(docs.select("doc_id", "text"), labels.select("doc_id", "quality").where(~held_out()))
    return ranked.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def query(spark, sf_dir: str) -> DataFrame:
    return op3(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
