"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screentime.llm.common import REMEMBERED_WORDS, arrow_map, batch, broadcast, carried, schema_of, texts

_LETTERS = bytes(c for c in range(256) if chr(c).isalpha() and c < 128)
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))
_STOPS = b".,;:!?"
_SYMBOLS = bytes(c for c in range(33, 127) if c not in _LETTERS + _DIGITS + _STOPS)
#: Upper edges of the bins a statistic is one-hot coded in.
_EDGES = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
STATISTICS = 13


def _statistics(text: bytes, words: list[bytes], kinds: int) -> list[float]:
    """Shape of a text, each number about 0 to 1."""
    size, n = max(1, len(text)), max(1, len(words))

    def share(chars: bytes) -> float:
        return (len(text) - len(text.translate(None, chars))) / size

    lines = [line for line in text.split(b"\n") if line.strip()]
    doubled = sum(a == b for a, b in zip(words, words[1:]))
    return [
        np.log1p(len(words)) / 12, min(1.0, len(text) / n / 20), share(_UPPER), share(_SYMBOLS), share(_DIGITS), share(_HIGH), share(_STOPS),
        kinds / n, doubled / n, 1 - len(set(lines)) / max(1, len(lines)), min(1.0, n / max(1, len(lines)) / 200),
        min(1.0, max(map(len, words), default=0) / 60), sum(not w[-1:].isalpha() and w[-1] < 128 for w in words) / n,
    ]


class Features(dict):
    """Sparse features of texts; hashed words first, then statistics, their bins and metadata."""

    def __init__(self, buckets: int, metadata: int):
        self.buckets, self.metadata = buckets, metadata
        self.size = buckets + (STATISTICS + metadata) * (len(_EDGES) + 2)

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word) % self.buckets
        return value

    def of(self, rows: list[bytes], metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, value, first entry of each row) of texts and their metadata columns."""
        return self.entries(*self.parts(rows, metadata))

    def parts(self, rows: list[bytes], metadata: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """What the features of texts follow from: ids of their hashed words, and their statistics and metadata."""
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        parts, dense = [], np.zeros((len(rows), STATISTICS + self.metadata))
        for i, text in enumerate(rows):
            words = text.split()
            kinds = set(text.lower().split())
            ids = np.unique(np.fromiter(map(self.__getitem__, kinds), np.int64, len(kinds)))
            parts.append(ids)
            dense[i, :STATISTICS] = _statistics(text, words, len(kinds))
        dense[:, STATISTICS:] = np.log1p(np.maximum(np.nan_to_num(metadata), 0)) / 15
        return parts, dense

    def entries(self, parts: list[np.ndarray], dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, value, first entry of each row) of what ``parts`` gave."""
        width = dense.shape[1]
        binned = np.searchsorted(_EDGES, dense) + (len(_EDGES) + 1) * np.arange(width) + self.buckets + width
        fixed = np.hstack([np.broadcast_to(self.buckets + np.arange(width), dense.shape), binned])
        sizes = np.array([len(ids) for ids in parts], np.int64)
        first = np.cumsum(sizes + 2 * width) - (sizes + 2 * width)
        feature = np.concatenate([np.concatenate((ids, extra)) for ids, extra in zip(parts, fixed)]) if parts else np.zeros(0, np.int64)
        weight = 1 / np.sqrt(np.maximum(sizes, 1))
        value = (
            np.concatenate([np.concatenate((np.full(n, w), d, np.full(width, 0.5))) for n, w, d in zip(sizes, weight, dense)])
            if parts else np.zeros(0)
        )
        return feature, value, first


class FactorisationMachine:
    """Linear and low-rank pairwise weights; a row costs its entries times the rank."""

    def __init__(self, size: int, rank: int, seed: int = 7):
        self.bias, self.linear = 0.0, np.zeros(size)
        self.factors = np.random.default_rng(seed).normal(0, 0.05, (size, rank))

    def margin(self, feature: np.ndarray, value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins by the sum-of-squares identity, and each row's factor sums."""
        scaled = self.factors[feature] * value[:, None]
        sums = np.add.reduceat(scaled, first)
        pairs = 0.5 * (sums**2 - np.add.reduceat(scaled**2, first)).sum(1)
        return self.bias + np.add.reduceat(self.linear[feature] * value, first) + pairs, sums

    def score(self, feature: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(feature, value, first)[0], -30, 30)))

    def fit(self, feature, value, first, label, epochs: int = 12, least_steps: int = 500, rows: int = 64, rate: float = 0.02, decay: float = 1e-4) -> None:
        """Logistic loss by Adam over shuffled mini-batches; small samples are gone over more often."""
        epochs = max(epochs, -(-least_steps // max(1, len(label) // rows)))
        rng, ends = np.random.default_rng(11), np.append(first[1:], len(feature))
        self.bias = float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1)))
        state = [np.zeros_like(x) for x in (self.linear, self.linear, self.factors, self.factors)]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(label))
            for part in np.array_split(order, max(1, len(order) // rows)):
                step += 1
                size = ends[part] - first[part]
                begin = np.cumsum(size) - size
                take = np.repeat(first[part] - begin, size) + np.arange(size.sum())
                f, v = feature[take], value[take]
                margin, sums = self.margin(f, v, begin)
                slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[part]) / len(part)
                each = np.repeat(slope, size) * v
                used, where = np.unique(f, return_inverse=True)
                g_linear = np.bincount(where, each, len(used)) + decay * self.linear[used]
                g_each = each[:, None] * (np.repeat(sums, size, axis=0) - self.factors[f] * v[:, None])
                g_factors = np.stack([np.bincount(where, g_each[:, k], len(used)) for k in range(g_each.shape[1])], 1)
                g_factors += decay * self.factors[used]
                self.bias -= rate * float(slope.sum())
                lr = rate * (1 - 0.9 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for x, g, m, s in ((self.linear, g_linear, *state[:2]), (self.factors, g_factors, *state[2:])):
                    m[used] = 0.9 * m[used] + 0.1 * g
                    s[used] = 0.999 * s[used] + 0.001 * g**2
                    x[used] -= lr * m[used] / (np.sqrt(s[used]) + 1e-8)


def _select(transcripts: DataFrame, id_col: str, text_col: str, metadata_cols: tuple[str, ...], *more: Column) -> DataFrame:
    meta = F.array(*(F.col(c).cast("double") for c in metadata_cols)) if metadata_cols else F.expr("CAST(array() AS array<double>)")
    return transcripts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), meta.alias("meta"), *more)


def _inputs(b: pa.RecordBatch, features: Features) -> tuple[list[bytes], np.ndarray]:
    meta = np.array(b.column("meta").to_pylist(), np.float64).reshape(b.num_rows, features.metadata)
    return texts(b.column("text")), meta


def train_quality_model(
    transcripts: DataFrame,
    labels: DataFrame,
    id_col: str = "video_id",
    text_col: str = "ocr_text",
    label_col: str = "quality",
    metadata_cols: tuple[str, ...] = (),
    sample_rows: int = 6000,
    buckets: int = 1 << 13,
    rank: int = 6,
) -> FactorisationMachine:
    """Fit the machine on a bounded sample of labelled rows.

    The sample is the ``sample_rows`` labelled ids with the smallest hash; its ids, at
    most that many, are broadcast to the transcripts, and its word ids and statistics, not its texts
    nor the entries they spread to, come to the driver. Rows without label are left out; contradicting labels count as
    their mean. Without labels every score is one half.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    )
    sample = _select(transcripts, id_col, text_col, metadata_cols).join(F.broadcast(chosen), "id")
    columns = len(metadata_cols)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets, columns)
        for b in batches:
            ids, dense = features.parts(*_inputs(b, features))
            lists = pa.array(ids, pa.list_(pa.int32())), pa.array(list(dense), pa.list_(pa.float64()))
            yield batch(["id", "label", "words", "dense"], b.column("id"), b.column("label"), *lists)

    kind = sample.schema["id"].dataType.simpleString()
    schema = f"id {kind}, label double, words array<int>, dense array<double>"
    found = arrow_map(sample, featurise, schema).orderBy("id").limit(sample_rows).toArrow()
    features = Features(buckets, columns)
    model = FactorisationMachine(features.size, rank)
    if found.num_rows:
        words, dense = (found.column(n).combine_chunks() for n in ("words", "dense"))
        ids = np.split(np.asarray(words.flatten()).astype(np.int64), np.cumsum(np.asarray(words.value_lengths()))[:-1])
        label = found.column("label").to_numpy().astype(np.float64)
        model.fit(*features.entries(ids, np.asarray(dense.flatten()).reshape(len(ids), -1)), label)
    return model


def score_quality(
    transcripts: DataFrame,
    labels: DataFrame,
    id_col: str = "video_id",
    text_col: str = "ocr_text",
    label_col: str = "quality",
    learn_from: Column | None = None,
    metadata_cols: tuple[str, ...] = (),
    accept: float = 0.7,
    carry_cols: tuple[str, ...] = (),
    **training,
) -> DataFrame:
    """Probability that an OCR transcript is of good quality, for every whole text.

    A factorisation machine over hashed lower-case words, structure statistics and
    ``metadata_cols`` (numbers), learned from ``labels`` (id_col, label_col 0 or 1),
    restricted to rows where ``learn_from`` holds. Returns id_col, score, predicted
    (score >= ``accept``) and ``carry_cols`` unchanged. Null and empty texts have
    no words and get a score from their statistics; repeated rows each get their row.
    """
    learned = labels.where(learn_from) if learn_from is not None else labels
    buckets = training.setdefault("buckets", 1 << 13)
    model = train_quality_model(transcripts, learned, id_col, text_col, label_col, metadata_cols, **training)
    shared, columns = broadcast(transcripts.sparkSession, model), len(metadata_cols)
    rows = _select(transcripts, id_col, text_col, metadata_cols, carried(carry_cols))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features = shared.value, Features(buckets, columns)
        for b in batches:
            result = model.score(*features.of(*_inputs(b, features))) if b.num_rows else np.zeros(0)
            yield batch(
                ["id", "carry", "score", "predicted"],
                b.column("id"), b.column("carry"), pa.array(result), pa.array((result >= accept).astype(np.int32)),
            )

    out = arrow_map(rows, score, schema_of(rows, ("id", "carry"), "score double, predicted int"))
    return out.select(F.col("id").alias(id_col), *(F.col(f"carry.`{c}`") for c in carry_cols), "score", "predicted")
