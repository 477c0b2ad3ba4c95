"""Language by words first, then by ever shorter character n-grams.

Training counts words and, within them, n-grams of ``ORDERS`` characters (word ends marked) for each language.
A known word scores by its log frequency in each language. An unseen word falls back to its longest
n-grams that are known, by their mean log frequency; if none of that length is known, to shorter ones; a
word without a known character says nothing. A text's score is the posterior of the best language.

The model holds the ``TOP_WORDS`` and ``TOP_GRAMS`` most frequent entries over all languages, so it has a fixed size bound;
fitting reads an expected ``SAMPLE_ROWS`` of the learnable rows, chosen by key hash; prediction reads every whole text.

Edge cases: a null text or one without a letter is ``und`` with score 0; rows with a null language or text
teach nothing; ties go to the smaller language name; without training rows every text is ``und``; words longer than
``WORD_CHARS`` count by their n-grams only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import settled, small_batches, with_text_columns

ORDERS = (5, 4, 3, 2, 1)
TOP_WORDS = 60_000
TOP_GRAMS = 60_000
SAMPLE_ROWS = 15_000
WORD_CHARS = 40
UNKNOWN = "und"
#: Words kept with their scores in a worker; the store is emptied when it is full.
CACHE_WORDS = 200_000
#: Counts held by a task before it passes them on.
COUNTED_ENTRIES = 300_000
#: Words of evidence beyond which a posterior grows no surer.
EVIDENCE_WORDS = 20

_WORDS = re.compile(r"[^\W\d_]+")
_END = "\x00"


def words(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    found = _WORDS.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    # ``\w`` takes more than letters: fractions, raised and Roman numbers, ... part words like any other sign
    return [p for w in found for p in "".join(c if c.isalpha() else " " for c in w).split()]


def grams(word: str, n: int) -> list[str]:
    """N-grams of the word with marked ends; single characters without the marks."""
    if n == 1:
        return list(word)
    marked = _END + word + _END
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


@dataclass(frozen=True)
class LanguageModel:
    """Entries to their rows of log frequencies, a column for each language."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_rows: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    gram_rows: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))


def _counts(rows: DataFrame, entries: Callable) -> DataFrame:
    """(lang, n, entry, count): sums of what ``entries`` yields for each (lang, value) row, added up within a task first."""
    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, c in entries(lang, value):
                    found[k] += c
                if len(found) > COUNTED_ENTRIES:
                    yield packed(found)
                    found.clear()
        yield packed(found)

    def packed(found: Counter) -> pa.RecordBatch:
        langs, ns, names = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(ns, pa.int32()), pa.array(names, pa.string()),
             pa.array(found.values(), pa.int64())], names=["lang", "n", "entry", "count"])

    small_batches(rows.sparkSession)
    return (rows.mapInArrow(run, "lang string, n int, entry string, count long")
            .groupBy("n", "entry", "lang").agg(F.sum("count").alias("count")))


def fit(docs: DataFrame, learnable: Callable[[Column], Column], key: str = "doc_id", text: str = "text",
        lang: str = "lang", sample_rows: int = SAMPLE_ROWS, top_words: int = TOP_WORDS,
        top_grams: int = TOP_GRAMS) -> LanguageModel:
    """``learnable`` is a condition on a row's key. What reaches the driver is the model, at most ``top_words + top_grams``
    entries."""
    rows = (docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
            .where(F.col("lang").isNotNull() & learnable(F.col("id"))))
    total = rows.drop("text").count()
    if not total:
        return LanguageModel([], {}, {})
    unit = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    counted = settled(_counts(rows.where(unit < sample_rows / total).select("lang", "text"), lambda lang, t: (
        ((lang, 0, w), 1) for w in words(t))))
    # n-grams of the counted words, each as often as its word occurs
    counted = settled(counted.where(F.length("entry") <= WORD_CHARS).unionAll(_counts(
        counted.select("lang", F.struct("entry", "count").alias("word")), lambda lang, word: (
            ((lang, n, g), word["count"]) for n in ORDERS for g in grams(word["entry"], n)))))
    totals = {(r["n"], r["lang"]): r["count"] for r in
              counted.groupBy("n", "lang").agg(F.sum("count").alias("count")).collect()}
    languages = sorted({l for _, l in totals})
    if not languages:
        return LanguageModel([], {}, {})
    by_language = [F.sum(F.when(F.col("lang") == l, F.col("count"))).alias(f"c{k}") for k, l in enumerate(languages)]

    def top(of: Column, most: int) -> tuple[dict[str, int], np.ndarray]:
        kept = (counted.where(of).groupBy("n", "entry").agg(F.sum("count").alias("total"), *by_language)
                .orderBy(F.desc("total"), "n", "entry").limit(most).toArrow())
        order = kept.column("n").to_numpy()
        counts = np.column_stack([np.nan_to_num(kept.column(f"c{k}").to_numpy().astype(np.float64)) for k in range(len(languages))])
        all_of = np.array([[totals.get((n, l), 0) for l in languages] for n in (0, *sorted(ORDERS))], np.float64)
        place = {n: k for k, n in enumerate((0, *sorted(ORDERS)))}
        rows = np.log((counts + 0.1) / (all_of[[place[n] for n in order.tolist()]] + 1)).astype(np.float32)
        return dict(zip(kept.column("entry").to_pylist(), range(len(order)))), rows

    known, word_rows = top(F.col("n") == 0, top_words)
    parts, gram_rows = top(F.col("n") > 0, top_grams)
    return LanguageModel(languages, known, parts, word_rows, gram_rows)


class Scores(dict):
    """Word to the row of its log frequencies in ``self.table``; unseen words are added by backoff."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model, self.size = model, len(model.languages)
        self.table = np.zeros((CACHE_WORDS, self.size), np.float32)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.table[at] = self.of(word)
        return at

    def of(self, word: str) -> np.ndarray:
        known = self.model.words.get(word)
        if known is not None:
            return self.model.word_rows[known]
        for n in ORDERS:
            found = [v for g in grams(word, n) if (v := self.model.grams.get(g)) is not None]
            if found:
                return self.model.gram_rows[found].mean(axis=0)
        return np.zeros(self.size, np.float32)


def annotate(docs: DataFrame, model: LanguageModel, text: str = "text", prediction: str = "lang_pred",
             score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior; the model is broadcast, its size bounded by its parameters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def one(t: str | None) -> tuple[str, float]:
        found = words(t)
        if not found or not shared.value.languages:
            return UNKNOWN, 0.0
        if "scores" not in state:
            state["scores"] = Scores(shared.value)
        scores, step = state["scores"], CACHE_WORDS // 4
        total = np.zeros(scores.size)
        for at in range(0, len(found), step):
            part = found[at:at + step]
            if len(scores) + len(part) > CACHE_WORDS:
                scores.clear()
            total += scores.table[np.fromiter(map(scores.__getitem__, part), np.int64, len(part))].sum(axis=0, dtype=np.float64)
        evidence = total * (min(len(found), EVIDENCE_WORDS) / len(found))
        best = int(np.argmax(evidence))
        return scores.model.languages[best], float(1 / np.exp(np.minimum(evidence - evidence[best], 0)).sum())

    def run(texts: list) -> dict[str, list]:
        got = [one(t) for t in texts]
        return {prediction: [g[0] for g in got], score: [g[1] for g in got]}

    return with_text_columns(docs, text, run, f"{prediction} string, {score} double")


def predict(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return annotate(rows, model).select(F.col("id").alias(key), "lang_pred", "score")
