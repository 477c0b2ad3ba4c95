"""Quality by compression: zstandard dictionaries of good and of bad text.

A text is cut into chunks of ``CHUNK`` bytes, the last shorter, and every chunk is compressed with both dictionaries. The
difference of the two total sizes over the larger one is the evidence; a logistic curve fitted on
labelled texts that neither dictionary has seen turns it into the probability of label 1.

Fitting reads a bounded sample of the labelled rows (``SAMPLE_ROWS`` expected per label, chosen by key hash, and
``DICT_CHUNKS`` chunks per dictionary); scoring reads every whole text.

Edge cases: a null or empty text has no evidence and gets the curve's value at zero; rows whose label or key
is null are not learned from; a key with several labels counts once with each; with one label only, or none,
every score is that label's value (0.5 with none) and no dictionary is built; texts of any length are scored
chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import with_text_columns

CHUNK = 1024
LEVEL = 3
DICT_BYTES = 1 << 18
#: Bounds of what fitting reads: labelled rows for each label (expected), chunks for a dictionary.
SAMPLE_ROWS = 20_000
DICT_CHUNKS = 16_000
THRESHOLD = 0.7


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the logistic curve; a few hundred kilobytes whatever the data."""

    bad: bytes
    good: bytes
    slope: float
    offset: float


def chunks(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i:i + CHUNK] for i in range(0, len(raw), CHUNK)]


class Evidence:
    """Compressed-size difference under the two dictionaries, from -1 (bad) to 1 (good)."""

    def __init__(self, bad: bytes, good: bytes):
        def compressor(raw: bytes) -> zstandard.ZstdCompressor:
            known = zstandard.ZstdCompressionDict(raw) if raw else None
            if known:
                known.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False,
                                            write_checksum=False, write_dict_id=False)
        self.bad, self.good = compressor(bad).compress, compressor(good).compress

    def __call__(self, text: str | None) -> float:
        parts = chunks(text)
        if not parts:
            return 0.0
        b = sum(len(self.bad(p)) for p in parts)
        g = sum(len(self.good(p)) for p in parts)
        return (b - g) / max(b, g)


def _dictionary(rows: pd.DataFrame) -> bytes:
    """A dictionary of up to ``DICT_CHUNKS`` chunks, taken evenly from the sample."""
    parts = [p for t in rows["text"] for p in chunks(t)]
    parts = parts[::max(1, -(-len(parts) // DICT_CHUNKS))]
    total = sum(map(len, parts))
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(256, total // 8)), parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(parts)[:DICT_BYTES]


def fit(docs: DataFrame, labels: DataFrame, learnable: Callable[[Column], Column], key: str = "doc_id", text: str = "text",
        label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Dictionaries from two thirds of the sample, the curve from the rest. ``learnable`` is a
    condition on a row's key."""
    marked = (labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label"))
              .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & learnable(F.col("id"))).distinct())
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if len(counts) < 2:
        return QualityModel(b"", b"", 0.0, 40.0 if 1 in counts else -40.0 if 0 in counts else 0.0)
    unit = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    kept = marked.where(unit < F.when(F.col("label") == 1, F.lit(sample_rows / counts[1])).otherwise(F.lit(sample_rows / counts[0])))
    # the ids of the sample are broadcast: 2 * sample_rows of them are expected, however many rows there are
    sample = (docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(kept), "id")
              .withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(3))))

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"label": [rows["label"].iloc[0]], "raw": [_dictionary(rows.sort_values(["id", "text"]))]})

    raw = {r["label"]: bytes(r["raw"]) for r in
           sample.where("fold <> 0").select("id", "label", "text").groupBy("label").applyInPandas(train, "label int, raw binary").collect()}
    bad, good = raw.get(0, b""), raw.get(1, b"")
    evidence = with_evidence(sample.where("fold = 0").select("label", "text"), bad, good).groupBy(
        "label", F.round("evidence", 4).alias("evidence")).count().collect()  # 20,001 values a label at most
    if {r["label"] for r in evidence} != {0, 1}:
        return QualityModel(bad, good, 10.0, 0.0)
    weight = {k: sum(r["count"] for r in evidence if r["label"] == k) for k in (0, 1)}
    # each label's share among all labelled rows, not among the sampled ones
    share = {k: counts[k] / sum(counts.values()) for k in (0, 1)}
    x = np.array([r["evidence"] for r in evidence])
    y = np.array([float(r["label"]) for r in evidence])
    n = np.array([r["count"] * share[r["label"]] / weight[r["label"]] for r in evidence]) * sum(weight.values())
    slope, offset = _weighted_curve(x, y, n)
    return QualityModel(bad, good, slope, offset)


def _weighted_curve(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve: Newton steps with a small ridge."""
    design, w = np.column_stack([x, np.ones_like(x)]), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (n * (y - p)) - 1e-2 * w)
        w += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def with_evidence(rows: DataFrame, bad: bytes, good: bytes, text: str = "text", name: str = "evidence") -> DataFrame:
    """``rows`` with the evidence of each whole text."""
    state: dict = {}

    def run(texts: list) -> dict[str, list]:
        if "measure" not in state:
            state["measure"] = Evidence(bad, good)
        return {name: [state["measure"](t) for t in texts]}

    return with_text_columns(rows, text, run, f"{name} double")


def probability(evidence: Column, model: QualityModel) -> Column:
    line = evidence * F.lit(model.slope) + F.lit(model.offset)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(line, F.lit(-60.0)), F.lit(60.0))))


def score(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """(key, evidence, score, predicted) for every row."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return (with_evidence(rows, model.bad, model.good).withColumn("score", probability(F.col("evidence"), model))
            .select(F.col("id").alias(key), "evidence", "score",
                    F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")))
