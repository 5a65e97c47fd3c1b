"""A quality classifier: naive Bayes features in a support vector machine.

Features are indicators of byte n-grams (n = 1 and 3, hashed) and of repetition patterns: how often a word equals
the one before it, a line equals an earlier one, and a three-word window comes again, as a share on a log scale.  Each
indicator is scaled by its log-count ratio between the classes.  On texts of unit length a linear model with hinge
loss is fitted by dual coordinate descent, and its margins are mapped to probabilities on rows that the fit did not
see.  The fit takes at most `per_class` labelled rows of each class, those with the least hash; workers get the
weights, of fixed size, and score whole texts without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import fresh
from ._words import batches
from .cascade import Measures

TRIGRAM_BITS = 16
PATTERNS = ("n_stutters", "n_dup_lines", "n_repeat_words")
STEPS = 16
FEATURES = (1 << TRIGRAM_BITS) + 256 + len(PATTERNS) * STEPS
#: Texts whose indicators are held at a time.
_ROWS = 64


def _steps(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """0 for none, then the log2 scale of the share, up to STEPS - 1."""
    share = part / np.maximum(whole, 1)
    return np.where(part > 0, np.clip(np.floor(np.log2(np.maximum(share, 1e-9))) + STEPS, 1, STEPS - 1), 0).astype(np.int64)


def indicators(column: pa.Array):
    """Blocks of (first text, flags: texts by features)."""
    m = Measures(column)
    buf, off = m.words.buf, m.words.off
    steps = [_steps(m.get(name), m.get("n_lines") if name == "n_dup_lines" else m.get("n_words")) for name in PATTERNS]
    for a in range(0, len(m.words), _ROWS):
        z = min(a + _ROWS, len(m.words))
        flags = np.zeros((z - a, FEATURES), bool)
        part = buf[off[a] : off[z]]
        doc = np.repeat(np.arange(z - a, dtype=np.int64), np.diff(off[a : z + 1])) * FEATURES
        at = flags.reshape(-1)
        at[doc + (1 << TRIGRAM_BITS) + part] = True
        if len(part) > 2:
            wide = part.astype(np.uint32)
            gram = ((wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - TRIGRAM_BITS)
            inside = doc[2:] == doc[:-2]
            at[(doc[2:] + gram)[inside]] = True
        for k, s in enumerate(steps):
            flags[np.arange(z - a), (1 << TRIGRAM_BITS) + 256 + k * STEPS + s[a:z]] = True
        yield a, flags


def stored(flags: np.ndarray) -> bytes:
    """A text's indicators: their numbers, or all flags as bits where that is shorter, so FEATURES / 8 bytes at most."""
    numbers = np.flatnonzero(flags).astype(np.int32).tobytes()
    return numbers if len(numbers) < FEATURES // 8 else np.packbits(flags).tobytes()


def numbers(raw: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))).astype(np.int32) if len(raw) == FEATURES // 8 else np.frombuffer(raw, np.int32)


def log_count_ratio(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    counts = np.ones((2, FEATURES))
    for x, y in zip(rows, label):
        counts[int(y), x] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def hinge_descent(rows: list[np.ndarray], scale: np.ndarray, label: np.ndarray, cost: np.ndarray, rounds: int = 40, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model on scaled, unit-length indicators, by dual coordinate descent."""
    sign = np.where(label > 0, 1.0, -1.0)
    values = [scale[x] for x in rows]
    norms = [float(np.sqrt(v @ v)) or 1.0 for v in values]
    values = [v / n for v, n in zip(values, norms)]
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cost[i])  # unit length and a bias of 1: the diagonal is 2
            step = (new - alpha[i]) * sign[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def calibrate(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of the logistic map, by Newton steps on smoothed targets."""
    plus, minus = weight[label > 0].sum(), weight[label == 0].sum()
    goal = np.where(label > 0, (plus + 1) / (plus + 2), 1 / (minus + 2))
    a, b = 1.0, float(np.log((plus + 1) / (minus + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        r, h = weight * (p - goal), weight * p * (1 - p) + 1e-9
        g = np.array([r @ margin + 1e-3 * a, r.sum()])
        hess = np.array([[h @ (margin * margin) + 1e-3, h @ margin], [h @ margin, h.sum()]])
        step = np.linalg.solve(hess + 1e-9 * np.eye(2), g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.0), b


class Model:
    """score = 1 / (1 + exp(-(slope * margin + offset))); without weights, the prior."""

    def __init__(self, weights: np.ndarray | None, bias: float, scale: np.ndarray | None, slope: float, offset: float):
        self.slope, self.offset, self.bias = slope, offset, bias
        self.linear = None if weights is None else (weights * scale).astype(np.float32)
        self.square = None if weights is None else (scale * scale).astype(np.float32)

    def margins(self, flags: np.ndarray) -> np.ndarray:
        x = flags.astype(np.float32)
        return x @ self.linear / np.sqrt(np.maximum(x @ self.square, 1e-12)) + self.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), 1 / (1 + np.exp(-self.offset)))
        if self.linear is not None:
            for a, flags in indicators(column):
                out[a : a + len(flags)] = 1 / (1 + np.exp(-np.clip(self.slope * self.margins(flags) + self.offset, -30, 30)))
        return out


def fit(docs: DataFrame, labels: DataFrame, train: Column, id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = 3000, cost: float = 1.0) -> Model:
    """train: a condition on id, for rows of labels. A row with a null id or label teaches nothing; of several labels of one id the least counts; of several texts all,
    but no more than 4 * per_class rows together, those with the least hash.  At most FEATURES / 8 bytes of a row, whatever
    its text's length, come to the driver.

    With no row, or only one class, the model is the prior: the share of label 1, smoothed by one row of each class.
    """
    usable = labels.select(F.col(f"`{id}`").cast("long").alias(id), F.col(f"`{label}`").cast("int").alias("y")).filter(F.col(id).isNotNull() & F.col("y").isin(0, 1)).filter(train).groupBy(id).agg(F.min("y").alias("y"))
    share = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = float(np.log((share.get(1, 0) + 1) / (share.get(0, 0) + 1)))
    if len(share) < 2:
        return Model(None, 0.0, None, 0.0, prior)
    chosen = None
    for y in (0, 1):
        some = usable.filter(F.col("y") == y).orderBy(F.xxhash64(id), id).limit(per_class)
        chosen = some if chosen is None else chosen.union(some)
    picked = docs.select(F.col(f"`{id}`").cast("long").alias(id), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), id)  # at most 2 * per_class rows of two numbers

    def features(stream):
        for batch in batches(stream, "text", 1 << 20):
            at = batch.schema.get_field_index
            found = []
            for _, flags in indicators(batch.column(at("text"))):
                found += [stored(f) for f in flags]
            yield pa.RecordBatch.from_arrays([batch.column(at(id)), batch.column(at("y")), pa.array(found, pa.binary())], names=["id", "y", "features"])

    found = picked.mapInArrow(features, "id long, y int, features binary").orderBy(F.xxhash64("id", "features"), "id").limit(4 * per_class)  # ids may repeat
    rows = sorted(found.collect(), key=lambda r: (r["id"], bytes(r["features"])))
    y = np.array([r["y"] for r in rows], np.int64)
    if len(np.unique(y)) < 2:
        return Model(None, 0.0, None, 0.0, prior)
    x = [numbers(bytes(r["features"])) for r in rows]
    number = np.random.default_rng(3).permutation(len(rows))
    held = number % 4 == 0
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held = np.zeros(len(rows), bool)
    a, b = np.flatnonzero(~held), np.flatnonzero(held if held.any() else ~held)
    scale = log_count_ratio([x[i] for i in a], y[a])
    n = np.bincount(y[a], minlength=2)
    w, bias = hinge_descent([x[i] for i in a], scale, y[a], cost * len(a) / (2 * n[y[a]]))
    model = Model(w, bias, scale, 1.0, 0.0)
    margin = np.empty(len(b))
    for k, i in enumerate(b):
        flags = np.zeros((1, FEATURES), bool)
        flags[0, x[i]] = True
        margin[k] = model.margins(flags)[0]
    m = np.bincount(y[b], minlength=2)
    true = np.array([share[0], share[1]], float) / (share[0] + share[1])
    model.slope, model.offset = calibrate(margin, y[b], (true / (m / m.sum()))[y[b]])
    return model


def classify(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """df with score (0 to 1) and predicted (1 if score >= threshold); names get underscores in front where they clash.

    Only the text enters the score, so equal texts have equal scores.  A null text counts as empty; a text of any length
    is scored as a whole, by the task that reads it.  An empty table
    stays empty.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # two vectors of FEATURES numbers
    score, predicted = fresh(df, "score", "predicted")
    names = [*df.columns, score, predicted]

    def run(stream):
        for batch in batches(stream, text, 2 << 20):
            found = shared.value.scores(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())]))
