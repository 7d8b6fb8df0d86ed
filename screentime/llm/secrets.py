"""Secret scans: fixed patterns, and character Markov models of random strings and identifiers."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screentime.llm.common import arrow_map, batch, broadcast, row_key, smallest_hashes

# The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

#: Rows with a labelled string, for Spark's matcher.
LABELLED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}"""

#: What the models judge: runs of key characters, longer than an ordinary word.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{6,}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns' matches, in code points, end exclusive."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def reaches_past(start: int, end: int, base: list[tuple[int, int, int]]) -> bool:
    """Whether a candidate holds more than base spans tell: it ends behind an assignment, or is not
    covered by a key's span. A name in front of an assigned value is no more."""
    met = [(s, kind, e) for s, kind, e in base if s < end and start < e]
    return all(e < end if kind == 0 else s > start or e < end for s, kind, e in met)


def is_candidate(token: str) -> bool:
    """Long runs that mix letters and digits."""
    return CANDIDATE.fullmatch(token) is not None and any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def _codes(token: str) -> np.ndarray:
    return np.frombuffer(token.encode("ascii", "replace"), np.uint8).astype(np.int64) & 127


class MarkovRatio:
    """Log-likelihood ratio of two first-order character chains, in nats."""

    def __init__(self, random_pairs: np.ndarray, ordinary_pairs: np.ndarray):
        self.ratio = self.chain(random_pairs) - self.chain(ordinary_pairs)

    @staticmethod
    def chain(pairs: np.ndarray) -> np.ndarray:
        """Log transition table; row 0 is the start, and unseen steps follow the character's own frequency."""
        usable = np.zeros(128, bool)
        usable[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
        single = pairs.sum(0) + 0.5 * usable
        single = single / single.sum()
        smooth = 16.0 * single
        with np.errstate(divide="ignore"):
            table = np.log((pairs + smooth) / (pairs.sum(1, keepdims=True) + 16.0))
        table[~np.isfinite(table)] = 0.0
        return table

    def score(self, token: str) -> float:
        codes = _codes(token)
        return float(self.ratio[np.concatenate(([0], codes[:-1])), codes].sum())


def train_secret_model(transcripts: DataFrame, id_col: str = "video_id", text_col: str = "ocr_text", sample_rows: int = 5000) -> MarkovRatio:
    """Count character pairs of labelled strings in bounded samples of the transcripts.

    Labels come from the base patterns: what they find is random, other runs of six or
    more key characters are ordinary, and candidates for a finding have no label. One
    sample is of rows that a base pattern matches, one of the other rows, each the
    ``sample_rows`` rows with the smallest hash: rare labels are found however large the table is.
    Without any label of a kind its chain is uniform.
    """
    text = F.col(text_col).alias("text")
    labelled = F.col(text_col).rlike(LABELLED)
    key = row_key(id_col, text_col)
    sample = smallest_hashes(transcripts.where(labelled), key, sample_rows).select(text).unionByName(
        smallest_hashes(transcripts.where(~labelled), key, sample_rows).select(text)
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros((2, 128, 128), np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                spans = base_spans(text)
                secrets = {ASSIGN.match(text, s)[2] if kind == 0 else text[s:e] for s, kind, e in spans}
                taken = " ".join(secrets)
                for label, tokens in ((0, secrets), (1, (t for t in ORDINARY.findall(text) if t not in taken and not is_candidate(t)))):
                    for token in tokens:
                        codes = _codes(token)
                        np.add.at(pairs[label], (np.concatenate(([0], codes[:-1])), codes), 1)
        where = np.flatnonzero(pairs)
        yield batch(["cell", "n"], where.astype(np.int64), pairs.reshape(-1)[where])

    cells = arrow_map(sample, count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(2 * 128 * 128, np.float64)
    pairs[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return MarkovRatio(*pairs.reshape(2, 128, 128))


def scan_secrets(
    transcripts: DataFrame,
    id_col: str = "video_id",
    text_col: str = "ocr_text",
    min_ratio: float = 10.0,
    min_ratio_per_char: float = 0.5,
    sample_rows: int = 5000,
) -> DataFrame:
    """Secrets in every whole transcript.

    Base patterns give ``assign``, ``access`` and ``hex`` spans. Other runs of 20 or
    more key characters that mix letters and digits become ``random`` spans when the
    chain of random strings beats the chain of ordinary identifiers by ``min_ratio``
    nats and ``min_ratio_per_char`` nats a character; one that touches base spans is
    judged whole if it reaches past them. Returns id_col, n_assign,
    n_access, n_hex, n_random, base_sha256 and spans (``kind:start:end`` by start and
    kind, comma-joined; code points, end exclusive). Null is an empty text; repeated
    rows each get their row.
    """
    shared = broadcast(transcripts.sparkSession, train_secret_model(transcripts, id_col, text_col, sample_rows))
    rows = transcripts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def is_random(model: MarkovRatio, token: str) -> bool:
        if not is_candidate(token):
            return False
        ratio = model.score(token)
        return ratio >= max(min_ratio, min_ratio_per_char * len(token)) and math.isfinite(ratio)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            counts, digests, spans = [[] for _ in KINDS], [], []
            for text in b.column("text").to_pylist():
                base = base_spans(text or "")
                found = [
                    (m.start(), 3, m.end())
                    for m in CANDIDATE.finditer(text or "")
                    if reaches_past(m.start(), m.end(), base) and is_random(model, m[0])
                ]
                for k, column in enumerate(counts):
                    column.append(sum(f[1] == k for f in (base if k < 3 else found)))
                told = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in part) for part in (base, sorted(base + found))]
                digests.append(hashlib.sha256(told[0].encode()).hexdigest())
                spans.append(told[1])
            yield batch(
                ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                b.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()),
            )

    schema = f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string"
    return arrow_map(rows, scan, schema).withColumnRenamed("id", id_col)
