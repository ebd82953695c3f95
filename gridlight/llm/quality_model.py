"""Quality classifier on document statistics.

Statistics of the whole text, standardised, go through random Fourier features (a
Gaussian kernel's approximation with seeded frequencies).  Ridge scores come from the
normal equations: every partition of labelled rows adds up its own Gram matrix, a
tree of partial sums brings ``DIM`` x ``DIM`` numbers to the driver.  Isotonic
regression turns scores into probabilities; it is fitted on a fold of the learning rows
(one in ``FOLDS``, by a hash of the statistics, so that copies share a fold) which the
ridge has not seen.  Scores are gathered in bins; a bin's rate is drawn half a row
towards 0.5, pooled blocks become knots at their mean score, and between and beyond
the knots the score goes on rising, so the ridge's order survives.

Only the text enters a score.  Fitting uses every labelled row that the caller marks
for learning; its cost does not depend on the group sizes, and a hot source or a group
of copies is nothing special to it.

Defined results: null or empty text has zero statistics and is scored like any other;
documents without label are scored only; null ids are scored and count as not held
out; several labels of one id are averaged; with no labels at all every score is 0.5; with
too few to fill the calibration fold all learning rows calibrate; equal texts get equal
scores; a very long text is one pass over its bytes and counts as one row; repeated
rows are scored and learnt from each; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, staged, table
from .wordhash import texts

DIM, SEED, RIDGE, WIDTH = 192, 11, 1e-3, 2.5
BINS, FOLDS = 400, 5
#: Scores beyond the outer knots approach 0 and 1 at this rate.
TAIL = 2.0

_UPPER = bytes(range(65, 91))
_LETTER = _UPPER + bytes(range(97, 123)) + bytes(range(0x80, 0x100))
_DIGIT = bytes(range(48, 58))
_MARK = b"#*$%&|<>!@^~=+_{}[]\\/"
_POINT = b".,;:?'\"()-"
STATS = (
    "log_words", "word_len", "long_word", "upper", "digit", "mark", "pipe", "bang", "point", "space",
    "distinct", "top_word", "next_equal", "dup_line", "line_words", "line_end", "first_upper", "entropy", "high",
)


def statistics(text: bytes) -> list[float]:
    """The document statistics, in the order of ``STATS``."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * len(STATS)
    share = lambda cut: (n - len(text.translate(None, cut))) / n
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    m = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    some = counts[counts > 0] / n
    return [
        math.log1p(m),
        min((n - counts[32]) / m, 40.0),
        math.log1p(max(map(len, seen))),
        counts[65:91].sum() / n,
        counts[48:58].sum() / n,
        share(_MARK),
        counts[124] / n,
        counts[33] / n,
        share(_POINT),
        (counts[32] + counts[9]) / n,
        len(seen) / m ** 0.8,
        max(seen.values()) / m,
        sum(map(bytes.__eq__, words, words[1:])) / m,
        1 - len(set(lines)) / len(lines),
        math.log1p(m / len(lines)),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
        sum(65 <= x.lstrip()[0] <= 90 for x in lines) / len(lines),
        float(-(some * np.log(some)).sum()),
        counts[128:].sum() / n,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, rid (row key) and ``x``, the statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "rid", "x"]
            )

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs).alias("rid"), docs["text"].cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, rid long, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        low = self.values[0] * np.exp(TAIL * np.minimum(raw - self.knots[0], 0))
        high = (1 - self.values[-1]) * np.exp(TAIL * np.minimum(self.knots[-1] - raw, 0))
        inside = np.interp(raw, self.knots, self.values)
        return np.where(raw < self.knots[0], low, np.where(raw > self.knots[-1], 1 - high, inside))


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant."""
    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(SEED)
    freq = rng.normal(0, 1 / (WIDTH * math.sqrt(x.shape[1] / 4)), (x.shape[1], DIM))
    phase = rng.uniform(0, 2 * math.pi, DIM)
    return np.hstack([np.cos(z @ freq + phase) * math.sqrt(2 / DIM), np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _add_up(rows: DataFrame, size: int, fan_in: int = 16) -> np.ndarray:
    """Sum of the binary vectors in column ``s`` by a tree of partial sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for s in batch.column(0):
                total += np.frombuffer(s.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    n = rows.rdd.getNumPartitions()
    while n > 1:
        n = math.ceil(n / fan_in)
        rows = rows.repartition(n).mapInArrow(add, "s binary")
    total = np.zeros(size)
    for row in rows.collect():  # one vector per root
        total += np.frombuffer(row["s"], np.float64)
    return total


def _isotonic(at: np.ndarray, rate: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean score and mean rate of the blocks, both increasing."""
    blocks: list[tuple[float, float, float]] = []  # weight, mean rate, mean score
    for x, y, w in zip(at.tolist(), rate.tolist(), weight.tolist()):
        blocks.append((w, y, x))
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            (w2, y2, x2), (w1, y1, x1) = blocks.pop(), blocks.pop()
            both = w1 + w2
            blocks.append((both, (w1 * y1 + w2 * y2) / both, (w1 * x1 + w2 * x2) / both))
    return np.array([x for _, _, x in blocks]), np.array([y for _, y, _ in blocks])


def fit(labelled: DataFrame) -> Model:
    """``labelled``: x and y (0 to 1)."""
    d = len(STATS)
    width = DIM + 1
    spare = F.pmod(F.xxhash64("x"), F.lit(FOLDS)) == 0
    sizes = labelled.agg(F.count_if(spare).alias("spare"), F.count_if(~spare).alias("rest")).first()
    learn, calibrate = (labelled.where(~spare), labelled.where(spare)) if sizes["spare"] >= FOLDS and sizes["rest"] else (labelled, labelled)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + 2 * d)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                total += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    sums = _add_up(learn.select("x").mapInArrow(moments, "s binary"), 1 + 2 * d)
    n = sums[0]
    if not n:
        return Model(np.zeros(d), np.ones(d), np.zeros(width), np.empty(0), np.empty(0))
    mean = sums[1 : 1 + d] / n
    scale = np.sqrt(np.maximum(sums[1 + d :] / n - mean**2, 0))
    scale[scale < 1e-9] = 1.0

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width + 1, width))
        for batch in batches:
            if batch.num_rows:
                f = fourier(_matrix(batch.column(0)), mean, scale)
                gram[:width] += f.T @ f
                gram[width] += batch.column(1).to_numpy(zero_copy_only=False) @ f
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary())], names=["s"])

    gram = _add_up(learn.select("x", "y").mapInArrow(equations, "s binary"), (width + 1) * width)
    gram = gram.reshape(width + 1, width)
    weights = np.linalg.solve(gram[:width] + RIDGE * n / width * np.eye(width), gram[width])

    # calibration rows, gathered in bins of the score
    model = Model(mean, scale, weights, np.empty(0), np.empty(0))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, BINS))
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(_matrix(batch.column(0)))
                at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
                for k, v in enumerate((np.ones(len(raw)), batch.column(1).to_numpy(zero_copy_only=False), raw)):
                    total[k] += np.bincount(at, v, BINS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    count, good, raw = _add_up(calibrate.select("x", "y").mapInArrow(binned, "s binary"), 3 * BINS).reshape(3, BINS)
    some = count > 0
    count, good, raw = count[some], good[some], raw[some]
    model.knots, model.values = _isotonic(raw / count, (good + 0.5) / (count + 1), count + 1)
    return model


def held_out(df: DataFrame):
    return F.coalesce(F.crc32(df["doc_id"].cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", learn_all: bool = False) -> DataFrame:
    """doc_id, rid, held_out, score, predicted: a row per document."""
    stats = staged(document_statistics(docs), "quality-stats")
    y = (
        labels.where(labels[label].isNotNull() & labels["doc_id"].isNotNull())
        .groupBy(labels["doc_id"].cast("long").alias("y_id"))
        .agg(F.avg(F.col(label).cast("double")).alias("y"))
    )
    rows = stats.join(y, stats["doc_id"] == y["y_id"])
    model = fit(staged((rows if learn_all else rows.where(~held_out(rows))).select("x", "y"), "quality-labelled"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(2))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["doc_id", "rid", "score"]
            )

    scored = stats.mapInArrow(run, "doc_id long, rid long, score double")
    return scored.select(
        "doc_id", "rid", held_out(scored).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rid")
