"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased, everything but letters becomes a blank, and its character
n-grams (blanks mark word ends) are hashed into rows of an embedding table. The
mean row goes through a linear softmax. Both are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows, in which every language has
a least number of rows. A temperature fitted on rows held back makes the score a
probability. Two thresholds, set from the whole texts held back, reject: one on the
score, and one on how common the n-grams of a text are among those learned from,
since a language or script that was never learnt can still score high in a known one.

Averaging and the linear layer commute, so a trained model is one table of
per-bucket logits, a few hundred kilobytes that every task gets.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from groundspark.llm.sampling import hash_sample_by
from groundspark.llm.tokens import row_blocks

UNKNOWN = "und"
BUCKET_BITS = 14
DIMENSIONS = 16
ORDERS = (1, 2, 3, 4)
MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263)
# The documented bounds of the training sample, in rows and in characters of a row.
SAMPLE_ROWS = 3_000
SAMPLE_CHARS = 20_000
# Rows of a language that the sample holds at least, if there are so many; languages beyond sample / least are left out, rarest first.
LEAST_ROWS = 30
# A text longer than this many characters is scored in several passes and summed.
PASS_CHARS = 1_000_000


@cache
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def code_points(text: str) -> np.ndarray:
    """Lower-cased text as code points with blanks for everything but letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(_letters()[points], points, np.uint32(32))


def buckets(points: np.ndarray, begins: int | None = None) -> np.ndarray:
    """Hash buckets of the n-grams of all orders that begin at the first ``begins`` places (default: all)."""
    found, mixed = [], np.zeros(len(points) + 1, np.uint32)
    for order, multiplier in zip(ORDERS, MULTIPLIERS, strict=True):
        count = len(points) - order + 1
        if count < 1:
            break
        mixed = (mixed[:count] ^ points[order - 1 :]) * np.uint32(multiplier)
        mixed ^= mixed >> np.uint32(15)
        found.append(((mixed * np.uint32(MULTIPLIERS[0])) >> np.uint32(32 - BUCKET_BITS))[:begins])
    return np.concatenate(found).astype(np.int64)


def padded(text: str) -> np.ndarray:
    blank = np.array([32], np.uint32)
    return np.concatenate([blank, code_points(text), blank])


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # bucket x language, float32
    bias: np.ndarray
    temperature: float
    threshold: float
    familiar: np.ndarray  # log share of each bucket among the n-grams learned from, float32
    least_familiar: float


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def train(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 0.5, seed: int = 7, rejected: float = 0.0005) -> Model:
    """Fit table, softmax, temperature and threshold.

    Every fifth row is held back for calibration. Besides its whole text each row
    gives one slice of a few words, so that short texts are known as well. Both
    thresholds lie below the ``rejected`` quantile of the whole texts held back: that
    of the score by one nat of odds, that of familiarity by one standard deviation.
    """
    languages = sorted(set(langs))
    draw = np.random.default_rng(seed)
    examples, targets = [], []
    for text, lang in zip(texts, langs, strict=True):
        words = text.split()
        begin, size = int(draw.integers(0, max(1, len(words)))), int(draw.integers(1, 12))
        for part in (text, " ".join(words[begin : begin + size])):
            # Equal n-grams act alike: keep each once with its count.
            found, counts = np.unique(buckets(padded(part)), return_counts=True)
            examples.append((found, (counts / counts.sum()).astype(np.float32)))
            targets.append(languages.index(lang))
    held = np.arange(len(examples)) // 2 % 5 == 4
    embeddings = draw.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    weights = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    order = np.flatnonzero(~held)
    steps, step = max(1, epochs * len(order)), 0
    for _ in range(epochs):
        for i in draw.permutation(order):
            found, share = examples[i]
            mean = share @ embeddings[found]
            slope = _softmax(mean @ weights + bias)
            slope[targets[i]] -= 1
            now = np.float32(rate * (1 - step / steps))
            step += 1
            back = weights @ slope
            weights -= now * np.outer(mean, slope)
            bias -= now * slope
            # Each row takes the whole step, not its share of it, so that rare n-grams are trained too.
            embeddings[found] -= now * back
    logits = embeddings @ weights
    check = np.flatnonzero(held) if held.any() else np.arange(len(examples))
    z = np.array([examples[i][1] @ logits[examples[i][0]] + bias for i in check]).reshape(len(check), len(languages))
    wanted = np.array([targets[i] for i in check], np.int64)
    ladder = np.geomspace(0.1, 10, 41)
    losses = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(check)), wanted], 1e-12)).mean() for t in ladder] if len(check) else [0]
    temperature = float(ladder[int(np.argmin(losses))])
    scores = _softmax(z / temperature).max(axis=1) if len(check) else np.zeros(1)
    # Whole texts alone set the thresholds.
    whole = check % 2 == 0
    low = float(np.clip(np.quantile(scores[whole], rejected), 1e-9, 1 - 1e-9)) if whole.any() else 0.5
    threshold = 1 / (1 + np.e * (1 - low) / low) if whole.any() else 0.0
    seen = np.zeros(1 << BUCKET_BITS)
    for i in order[order % 2 == 0]:
        seen[examples[i][0]] += examples[i][1]
    # Texts weigh alike; a bucket never seen counts as a hundredth of an even share.
    familiar = np.log(seen / max(seen.sum(), 1.0) + 0.01 / len(seen)).astype(np.float32)
    means = np.array([examples[i][1] @ familiar[examples[i][0]] for i in check[whole]])
    least = float(np.quantile(means, rejected) - means.std()) if len(means) else -np.inf
    return Model(languages, logits.astype(np.float32), bias, temperature, float(threshold), familiar, least)


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on at most ``sample_rows`` rows of ``labelled`` (doc_id, text, lang), those of least hash.

    Each language gives ``LEAST_ROWS`` rows and a share of the rest by its size. Rows
    without text or lang, or above ``SAMPLE_CHARS`` characters, are not drawn.
    Without any labelled row the model knows no language and predicts ``und``.
    """
    usable = labelled.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL").filter(F.length("text") <= SAMPLE_CHARS)
    rows = hash_sample_by(usable, "lang", ["doc_id"], sample_rows, LEAST_ROWS).collect()
    rows = [r for r in rows if any(c.isalpha() for c in r["text"])]
    if not rows:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0, np.zeros(1 << BUCKET_BITS, np.float32), 0.0)
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def logits_of(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the mean logits, the mean familiarity of its n-grams, and whether it has a letter."""
    sums, sizes = np.zeros((len(texts), len(model.languages) + 1), np.float64), np.zeros(len(texts), np.int64)
    lettered, table = np.zeros(len(texts), bool), np.column_stack([model.logits, model.familiar]).astype(np.float64)
    for at, text in enumerate(texts):
        points = padded(text)
        lettered[at] = bool((points != 32).any())
        if not lettered[at] or not model.languages:
            continue
        for begin in range(0, len(points), PASS_CHARS):
            # A pass sees the next one's first characters, but counts only n-grams that begin in its own.
            found = buckets(points[begin : begin + PASS_CHARS + max(ORDERS) - 1], PASS_CHARS)
            sums[at] += np.bincount(found, minlength=1 << BUCKET_BITS) @ table
            sizes[at] += len(found)
    means = sums / np.maximum(sizes, 1)[:, None]
    return means[:, :-1] + model.bias, means[:, -1], lettered


def predict(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score and lang_accepted added, after ``prefix`` (columns of these names are replaced).

    Accepted is a text whose score and familiarity reach the model's thresholds.
    A null text, one without letters, and every text under a model that knows no
    language is ``und`` with score 0 and not accepted. Repeated rows are predicted
    alike; other columns, nulls among them, pass through.
    """
    added = [prefix + name for name in ("lang_pred", "score", "lang_accepted")]
    kept = docs.drop(*added)
    share = docs.sparkSession.sparkContext.broadcast(astuple(model))
    text_at = next(k for k, c in enumerate(kept.columns) if c.lower() == "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*share.value)
        for whole in batches:
            for a, b in row_blocks(whole.column(text_at)):
                batch = whole.slice(a, b - a)
                texts = [t or "" for t in batch.column(text_at).to_pylist()]
                mean, common, lettered = logits_of(known, texts)
                if known.languages:
                    shares = _softmax(mean / known.temperature)
                    best, top = shares.argmax(axis=1), shares.max(axis=1)
                    names = [known.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)]
                    top = np.where(lettered, top, 0.0)
                else:
                    names, top = [UNKNOWN] * len(texts), np.zeros(len(texts))
                accepted = lettered & (top >= known.threshold) & (common >= known.least_familiar) & bool(known.languages)
                columns = [*batch.columns, pa.array(names, pa.string()), pa.array(top), pa.array(accepted)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *added])

    new = [StructField(name, kind) for name, kind in zip(added, (StringType(), DoubleType(), BooleanType()), strict=True)]
    schema = StructType([*kept.schema.fields, *new])
    return kept.mapInArrow(score, schema)


def fold(doc_id: str = "doc_id") -> Column:
    """Fold 0 to 3 of a document: crc32 of its id as text; the null id is fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4, F.lit(0))


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Learn from the folds other than 2 and predict every row; adds held_out as well.

    Null and empty texts are ``und``, repeated rows are predicted alike, a null doc_id
    is in fold 0, and an empty table gives no rows.
    """
    model = fit(docs.filter(fold() != 2), sample_rows)
    return predict(docs.withColumn("held_out", fold() == 2), model)
