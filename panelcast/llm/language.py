"""Language identification by string kernels.

A text's features are the character n-grams it contains, of 1 to 3 characters (a blended
spectrum of presences); the kernel of two texts is the number of n-grams in common over the
square root of the product of their numbers. Landmark texts give Nyström features; on them,
one kernel ridge regression per language tells it from the rest. Texts are scored in batches:
presence matrix times landmark matrix, then times the weights.

Characters that aren't letters count as a gap, runs of them as one, and case is folded; whole
texts are read. Defined results: a null text or one without letters is ``und`` with score 0;
repeated rows are classified once per row; if there is nothing to learn from, every text is
``und``; ties go to the language that sorts first. Inputs of a prediction are text only.

Scores of one against the rest sum to about 1, so the best one says little about texts in none of
the languages. Whether a text is in any of them is told by the share of its running trigrams
that a landmark holds; the bound is set from the labelled texts, each against landmarks other
than itself (known) and against those of the other languages only (foreign).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, give_back, in_batches, prepare

#: Landmarks in all, and labelled texts per language in the fit: these bound the classifier,
#: not what is classified.
LANDMARKS = 96
TEXTS_PER_LANGUAGE = 250
#: A text longer than this isn't used as training text unless its language has no shorter one.
TRAINING_CHARACTERS = 20_000
GRAMS = (1, 2, 3)
RIDGE = 1e-2
UNKNOWN = "und"
#: Share of labelled texts that the quantiles for the bound leave out, and standard deviations of
#: leeway that a text's number of known trigrams has, so that short texts aren't rejected by chance.
TAIL = 0.01
LEEWAY = 3.0

SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
_GAP = 32
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def grams(text: str | None) -> np.ndarray:
    """Sorted numbers of the n-grams in a text; empty if it has no letters."""
    return counted_grams(text)[0]


def counted_grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """``grams`` of a text, and how often each of its longest n-grams (the last ones) occurs."""
    none = np.empty(0, dtype=np.int64)
    if not text:
        return none, none
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    letter = _is_letter()[points]
    if not letter.any():
        return none, none
    points = np.where(letter, points, _GAP)
    kept = np.ones(len(points), dtype=bool)
    kept[1:] = letter[1:] | letter[:-1]
    points = np.concatenate(([_GAP], points[kept], [_GAP]))
    points = points[(points != _GAP) | np.concatenate(([True], points[:-1] != _GAP))]
    codes, out = points, []
    for size in range(1, max(GRAMS) + 1):
        if size > 1:
            codes = (codes[:-1] << 21) | points[size - 1 :]
        if size in GRAMS:
            distinct, counts = _distinct(codes)
            out.append(distinct)
    return np.concatenate(out), counts  # sizes don't overlap: every character is at least 32


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(codes):
        return codes, codes
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.diff(first, append=len(codes))


class KernelClassifier:
    """Nyström features over landmark texts and one ridge regression per language."""

    def __init__(self, landmarks: list[np.ndarray], languages: list[str], ridge: float = RIDGE):
        self.languages, self.ridge = languages, ridge
        self.vocabulary = np.unique(np.concatenate(landmarks))
        self.landmarks = self._presence(landmarks)
        self.norms = np.sqrt([len(x) for x in landmarks])
        values, vectors = np.linalg.eigh(self.kernel(landmarks))
        kept = values > 1e-8 * values.max()
        self.whiten = vectors[:, kept] / np.sqrt(values[kept])
        self.weights = np.zeros((int(kept.sum()) + 1, len(languages)))
        self.bound = 0.0

    def _presence(self, texts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.vocabulary)), dtype=np.float32)
        for row, codes in enumerate(texts):
            at = np.searchsorted(self.vocabulary, codes)
            at[at == len(self.vocabulary)] = 0
            out[row, at[self.vocabulary[at] == codes]] = 1
        return out

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        sizes = np.sqrt([max(len(x), 1) for x in texts])
        return (self._presence(texts) @ self.landmarks.T).astype(float) / np.outer(sizes, self.norms)

    def features(self, texts: list[np.ndarray]) -> np.ndarray:
        nystroem = self.kernel(texts) @ self.whiten
        return np.concatenate((nystroem, np.ones((len(texts), 1))), axis=1)

    def fit(self, texts: list[np.ndarray], labels: list[str]) -> KernelClassifier:
        x = self.features(texts)
        y = np.where(np.array(labels)[:, None] == np.array(self.languages)[None, :], 1.0, -1.0)
        self.weights = np.linalg.solve(x.T @ x + self.ridge * np.eye(x.shape[1]), x.T @ y)
        return self

    def _held(self, codes: np.ndarray, held_by: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, codes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == codes, held_by[at], 0)

    def set_bound(self, texts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], landmark_of: list[int | None], landmark_labels: list[str]) -> KernelClassifier:
        """Half-way between the shares of known and of foreign texts, as a mean over the languages.

        ``landmark_of`` tells which texts are landmarks themselves.
        """
        all_of, marks = self.landmarks.sum(axis=0), np.array(landmark_labels)
        others = {lang: self.landmarks[marks != lang].sum(axis=0) for lang in self.languages}
        known: dict[str, list[float]] = {lang: [] for lang in self.languages}
        foreign: dict[str, list[float]] = {lang: [] for lang in self.languages}
        for (codes, counts), lang, own in zip(texts, labels, landmark_of, strict=True):
            last = codes[len(codes) - len(counts) :]
            known[lang].append(float(((self._held(last, all_of) > (own is not None)) * counts).sum() / counts.sum()))
            foreign[lang].append(float(((self._held(last, others[lang]) > 0) * counts).sum() / counts.sum()))
        low = {lang: float(np.quantile(x, TAIL)) for lang, x in known.items() if x}
        middle = [(low[lang] + min(low[lang], float(np.quantile(foreign[lang], 1 - TAIL)))) / 2 for lang in low]
        self.bound = min(*low.values(), float(np.mean(middle)))
        return self

    def familiar(self, codes: np.ndarray, counts: np.ndarray) -> bool:
        """Whether enough of a text's trigrams are known for it to be in one of the languages."""
        if not len(counts):
            return False
        n, held = counts.sum(), np.ones(len(self.vocabulary), dtype=np.int8)
        known = (self._held(codes[len(codes) - len(counts) :], held) * counts).sum()
        return bool(known >= n * self.bound - LEEWAY * np.sqrt(n * self.bound * (1 - self.bound)))

    def predict(self, texts: list[np.ndarray]) -> list[tuple[str, float]]:
        if not texts:
            return []
        values = self.features(texts) @ self.weights
        best = values.argmax(axis=1)
        return [
            (self.languages[k], float(np.clip((row[k] + 1) / 2, 0, 1))) if len(text) else (UNKNOWN, 0.0)
            for k, row, text in zip(best.tolist(), values, texts, strict=True)
        ]


def held_out(doc_id="doc_id"):
    """Whether a document is kept out of all learning."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_texts(documents: DataFrame, per_language: int = TEXTS_PER_LANGUAGE) -> dict[str, list[str]]:
    """At most ``per_language`` labelled texts of each language, by hash order of their ids.

    Counts tell which share of a language's rows to look at, so few rows reach the driver.
    """
    rows = documents.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("place"),
        (F.length("text") > TRAINING_CHARACTERS).alias("long"),
    )
    best: dict[str, tuple[bool, int]] = {}
    for r in rows.groupBy("lang", "long").agg(F.count(F.lit(1)).alias("n")).collect():
        if not r["long"] or r["lang"] not in best:
            best[r["lang"]] = (r["long"], r["n"])
    wanted = F.lit(False)
    for lang, (long, n) in sorted(best.items()):
        share = min(1.0, 2 * per_language / n)
        low = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
        wanted = wanted | ((F.col("lang") == lang) & (F.col("long") == long) & (F.col("place") <= F.lit(low)))
    found: dict[str, list[tuple[int, str]]] = {lang: [] for lang in best}
    for r in rows.where(wanted).select("lang", "place", "text").collect():
        found[r["lang"]].append((r["place"], r["text"]))
    return {lang: [text for _, text in sorted(texts)[:per_language]] for lang, texts in sorted(found.items()) if texts}


def fit(documents: DataFrame, landmarks: int = LANDMARKS, per_language: int = TEXTS_PER_LANGUAGE) -> KernelClassifier | None:
    """The classifier of labelled documents that aren't held out; None if there are none."""
    texts = {lang: [g for g in map(counted_grams, found) if len(g[0])] for lang, found in training_texts(documents, per_language).items()}
    texts = {lang: found for lang, found in texts.items() if found}
    if not texts:
        return None
    each = max(1, landmarks // len(texts))
    model = KernelClassifier([g for found in texts.values() for g, _ in found[:each]], list(texts))
    every, labels = [g for found in texts.values() for g in found], [lang for lang, found in texts.items() for _ in found]
    own = [n if n < each else None for found in texts.values() for n in range(len(found))]
    model.set_bound(every, labels, own, [lang for lang, found in texts.items() for _ in found[:each]])
    return model.fit([g for g, _ in every], labels)


def classify(documents: DataFrame, model: KernelClassifier | None, keep: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score`` of every document, or all its columns and those two with ``familiar``.

    One pass without shuffle; the model's size is bounded by its landmarks.
    """
    spark = documents.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def predictions(texts: list[str | None], block: int = 128) -> list[tuple[str, float]]:
        if shared.value is None:
            return [(UNKNOWN, 0.0)] * len(texts)
        out: list[tuple[str, float]] = []
        for at in range(0, len(texts), block):
            out += shared.value.predict([grams(t) for t in texts[at : at + block]])
        give_back()
        return out

    if keep:
        def judged(texts: list[str | None], block: int = 128) -> list[tuple[str, float, bool]]:
            if shared.value is None:
                return [(UNKNOWN, 0.0, False)] * len(texts)
            out: list[tuple[str, float, bool]] = []
            for at in range(0, len(texts), block):
                found = [counted_grams(t) for t in texts[at : at + block]]
                scores = shared.value.predict([codes for codes, _ in found])
                out += [(*p, shared.value.familiar(*f)) for p, f in zip(scores, found, strict=True)]
            give_back()
            return out

        @F.pandas_udf("struct<lang_pred: string, score: double, familiar: boolean>")
        def predict(text):
            import pandas as pd

            return pd.DataFrame(judged(text.tolist()), columns=["lang_pred", "score", "familiar"])

        return documents.withColumn("predicted_language", predict(F.col("text").cast("string")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(columns_of(iter([batch]), "doc_id", "text"))
            found = predictions([t for _, t in rows])
            yield from in_batches(((d, *p) for (d, _), p in zip(rows, found, strict=True)), SCHEMA)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, lang_pred string, score double")


def digest(predicted: DataFrame) -> DataFrame:
    return predicted.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(documents: DataFrame, least: float = 0.2) -> DataFrame:
    """The documents, with their own columns, in one of the languages and with at least that score."""
    columns = documents.columns
    known = classify(documents, fit(documents), keep=True)
    found = F.col("predicted_language")
    return known.where((found["lang_pred"] != UNKNOWN) & found["familiar"] & (found["score"] >= least)).select(*columns)
