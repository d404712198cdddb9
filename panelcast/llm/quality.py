"""Quality by weak supervision: rules vote or abstain, their accuracies are estimated by
expectation-maximisation, and documents are kept by the posterior that they are good.

Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage
return. Base rules reject outright: fewer than 20 words, or more than 30 of 100 words inside
eight-word windows that occur twice or more.

The estimation works on vote patterns: with ``len(RULES)`` rules of three votes each there
are at most ``3 ** len(RULES)`` of them, whatever the corpus holds; their counts over all
documents are summed by Spark. A rule's accuracies are the shares of right votes among its
votes on good and on bad documents; an abstention says nothing about a document.

Defined results: null and empty texts have no words, every rule abstains and the base rules
reject them; repeated rows are scored once per row; in an empty table nothing is estimated.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, prepare, save

MIN_WORDS = 20
REPEAT_PERCENT = 30
RUN = 8
SYMBOLS = b"#*$%&|<>"
#: A document is kept if its posterior probability of being good is at least this.
KEEP = 0.5
#: Expected share of good votes among a rule's votes on bad and on good documents.
EXPECTED = (0.75, 0.99)

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_letters",
    "n_marks", "n_ended", "n_symbol_words",
]


def repeated_words(ids: np.ndarray, run: int = RUN) -> int:
    """Words inside windows of ``run`` words that occur at least twice.

    Windows get exact numbers by doubling: equal numbers mean equal words.
    """
    n = len(ids)
    if n <= run:
        return 0
    name, width = ids.astype(np.int64), 1
    while width < run:
        pair = name[: len(name) - width] * (int(name.max()) + 1) + name[width:]
        name = np.unique(pair, return_inverse=True)[1]
        width *= 2
    twice = np.bincount(name)[name] > 1
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[:-run] += twice
    edge[run:] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts named in ``MEASURES``, over the whole text."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    words = raw.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    lines = [line for line in raw.split(b"\n") if line.split(None, 1)]
    text = text or ""
    spaces = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    letters = raw.translate(None, bytes(c for c in range(128) if not chr(c).isalpha()))
    return (
        len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(ids), len(lines), len(number),
        len(letters) - len(letters.translate(None, bytes(range(0x41, 0x5B)))), len(letters), raw.count(b"!") + raw.count(b"?"),
        sum(line.rstrip().endswith((b".", b"!", b"?", b":", b'"', b")", b"\xe2\x80\x9d", b"\xe3\x80\x82")) for line in lines),
        sum(w.translate(None, SYMBOLS) != w for w in words) if symbols else 0,
    )


# A rule gives 1 (good), -1 (bad) or 0 (abstains) for arrays of counts.
Rule = Callable[[dict[str, np.ndarray]], np.ndarray]


def _between(share: np.ndarray, good: float, bad: float) -> np.ndarray:
    """Good up to one bound, bad from another on."""
    return np.where(share >= bad, -1, np.where(share <= good, 1, 0))


RULES: dict[str, Rule] = {
    "symbols": lambda m: _between(m["n_symbols"] / np.maximum(m["n_words"], 1), 0.02, 0.1),
    "symbol_words": lambda m: _between(m["n_symbol_words"] / np.maximum(m["n_words"], 1), 0.02, 0.1),
    "symbol_characters": lambda m: _between(m["n_symbols"] / np.maximum(m["word_chars"], 1), 0.005, 0.02),
    "duplicate_lines": lambda m: np.where(m["n_lines"] >= 3, _between(m["n_dup_lines"] / np.maximum(m["n_lines"], 1), 0.2, 0.5), 0),
    "repeated_words": lambda m: _between(m["n_repeat_words"] / np.maximum(m["n_words"], 1), 0.1, 0.3),
    "vocabulary": lambda m: np.where(m["n_words"] >= 50, np.where(m["n_distinct"] < 3 * np.sqrt(m["n_words"]), -1, np.where(m["n_distinct"] > 5 * np.sqrt(m["n_words"]), 1, 0)), 0),
    "upper_case": lambda m: np.where(m["n_letters"] >= 20, _between(m["n_upper"] / np.maximum(m["n_letters"], 1), 0.2, 0.4), 0),
    "exclamations": lambda m: _between(m["n_marks"] / np.maximum(m["n_words"], 1), 0.1, 0.3),
    "word_length": lambda m: np.where((m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"]), -1, np.where((m["word_chars"] >= 3 * m["n_words"]) & (m["word_chars"] <= 10 * m["n_words"]), 1, 0)),
    "sentence_ends": lambda m: np.where(m["n_lines"] >= 2, np.where(m["n_ended"] >= 0.6 * m["n_lines"], 1, np.where(m["n_ended"] <= 0.1 * m["n_lines"], -1, 0)), 0),
}


def votes_of(measures: dict[str, np.ndarray], rules: dict[str, Rule] = RULES) -> np.ndarray:
    """One row per document, one column per rule; a text without words gets no votes."""
    votes = np.stack([np.asarray(rule(measures), dtype=np.int8) for rule in rules.values()], axis=1)
    votes[measures["n_words"] == 0] = 0
    return votes


class VoteModel:
    """Two hidden classes; per class and rule, the share of good votes among the rule's votes."""

    def __init__(self, prior: float, shares: np.ndarray):
        self.prior, self.shares = prior, shares  # shares[class, rule]; class 1 is good

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        up, down = np.log(self.shares[1] / self.shares[0]), np.log((1 - self.shares[1]) / (1 - self.shares[0]))
        odds = np.log(self.prior) - np.log1p(-self.prior) + (votes > 0) @ up + (votes < 0) @ down
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))

    def accuracies(self) -> np.ndarray:
        """Per rule, the share of right votes."""
        return self.prior * self.shares[1] + (1 - self.prior) * (1 - self.shares[0])


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, smoothing: float = 2.0) -> VoteModel:
    """Expectation-maximisation over vote patterns and their counts.

    It starts from the rules' own word: a document with a bad vote is more likely bad. What
    rules are for goes in as a few pseudo votes: they seldom reject good documents, and each
    sees only some of the bad ones.
    """
    weight = counts.astype(float)
    good = np.where((patterns < 0).any(axis=1), 0.1, 0.9)
    model, before = VoteModel(0.5, np.full((2, patterns.shape[1]), 0.5)), None
    for _ in range(rounds):
        shares = np.empty((2, patterns.shape[1]))
        for k, part in enumerate((weight * (1 - good), weight * good)):
            up, down = part @ (patterns > 0), part @ (patterns < 0)
            shares[k] = (up + smoothing * EXPECTED[k]) / (up + down + smoothing)
        prior = float(np.clip(((weight * good).sum() + smoothing) / (weight.sum() + 2 * smoothing), 1e-6, 1 - 1e-6))
        model = VoteModel(prior, shares)
        good = model.posterior(patterns)
        if before is not None and np.abs(good - before).max() < 1e-7:
            break
        before = good
    return model


def measured(documents: DataFrame) -> DataFrame:
    """``documents`` with a struct ``measures`` and an array ``votes``; one pass, no shuffle."""
    prepare(documents.sparkSession)
    fields = ", ".join(f"{m}: long" for m in MEASURES)

    @F.pandas_udf(f"struct<{fields}, votes: array<tinyint>>")
    def count(text: pd.Series) -> pd.DataFrame:
        table = np.array([measure(t) for t in text], dtype=np.int64).reshape(-1, len(MEASURES))
        columns = {m: table[:, i] for i, m in enumerate(MEASURES)}
        give_back()
        return pd.DataFrame(columns).assign(votes=list(votes_of(columns)))

    return documents.withColumn("measures", count(F.col("text").cast("string")))


def fit(scored: DataFrame) -> VoteModel | None:
    """The vote model of a table with ``measures``; None if it is empty."""
    groups = scored.groupBy(F.col("measures.votes").alias("votes")).agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    if not groups:
        return None
    return fit_votes(np.array([g["votes"] for g in groups], dtype=np.int8), np.array([g["n"] for g in groups]))


def judged(scored: DataFrame, model: VoteModel | None, keep: float = KEEP) -> DataFrame:
    """``scored`` with ``posterior``, ``base_failed`` and ``kept``."""

    @F.pandas_udf("double")
    def posterior(votes: pd.Series) -> pd.Series:
        return pd.Series(model.posterior(np.array(votes.tolist(), dtype=np.int8).reshape(len(votes), -1)))

    m = F.col("measures")
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
    good = posterior(m["votes"]) if model else F.lit(None).cast("double")
    return scored.withColumn("posterior", good).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= keep))


def quality(documents: DataFrame) -> DataFrame:
    """``doc_id``, counts, votes, posterior and verdict of every document."""
    scored = save(measured(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "measures"))
    return judged(scored, fit(scored))


def digest(verdicts: DataFrame) -> DataFrame:
    counts = [F.col(f"measures.{m}").alias(m) for m in MEASURES[:5]]
    return verdicts.select("doc_id", *counts, "base_failed", "kept", "posterior")


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents, with their own columns, that the rules keep.

    The votes are counted in a first pass over the texts and the rows are judged in a second,
    so the texts aren't shuffled.
    """
    columns = documents.columns
    model = fit(measured(documents.select("text")))
    return judged(measured(documents), model).where("kept").select(*columns)
