"""Quality rules by weak supervision.

Each rule looks at counts of one document and votes good (+1), bad (-1) or abstains (0).
No rule decides alone: expectation-maximisation estimates from all documents how often
each rule is right on good and on bad documents, and the posterior probability of "good"
given a document's votes is the verdict.

The estimation works on counts of vote patterns.  With R rules there are at most 3**R
patterns (6,561 here) however many documents there are; Spark counts them with map-side
combining and only those counts reach the driver.

Edge cases: null and empty texts have no words; they get their votes and a posterior like
any other row.  Repeated rows count
as often as they occur.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, texts_of
from .textstats import SYMBOLS, count_of, duplicate_lines, repeated_window_words, words_of

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_same_next", "n_marks", "n_symbol_words"]
SYMBOL_WORD = re.compile(rf"[^ \t-\r]*[{SYMBOLS}][^ \t-\r]*")


def counts_of(text: str) -> list[int]:
    words, symbols = words_of(text), count_of(text, SYMBOLS)
    duplicates, lines = duplicate_lines(text.split("\n"))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = int(((points >= 65) & (points <= 90)).sum())
    lower = int(((points >= 97) & (points <= 122)).sum())
    return [
        len(words),
        len(text) - count_of(text, " \t\n\x0b\x0c\r"),
        symbols,
        duplicates,
        repeated_window_words(words),
        lines,
        upper,
        upper + lower,
        sum(map(bytes.__eq__, words, words[1:])),
        text.count("!") + text.count("?"),
        len(SYMBOL_WORD.findall(text)) if symbols else 0,
    ]


def with_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts in COUNTS of each whole text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([counts_of(t.as_py()) for t in b.column(1)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], ["doc_id", *COUNTS])

    return texts_of(docs).mapInArrow(task, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: Column
    good: Column


def default_rules() -> list[Rule]:
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.col
    return [
        Rule("word_length", (c("n_words") >= 5) & ((c("word_chars") > 12 * n) | (c("word_chars") < 2 * n)), (c("n_words") >= 5) & c("word_chars").between(3 * n, 9 * n)),
        Rule("symbols", (c("n_symbols") >= 3) & (c("n_symbols") * 10 > n), c("n_symbols") * 50 <= n),
        Rule("symbol_words", (c("n_symbol_words") >= 3) & (c("n_symbol_words") * 10 > n), c("n_symbol_words") * 50 <= n),
        Rule("same_next", (c("n_same_next") >= 3) & (c("n_same_next") * 10 > n), c("n_same_next") * 33 <= n),
        Rule("repeated", c("n_repeat_words") * 5 > n, c("n_repeat_words") * 20 <= n),
        Rule("shouting", (c("n_letters") >= 20) & (c("n_upper") * 4 > c("n_letters")), (c("n_letters") >= 20) & (c("n_upper") * 8 <= c("n_letters"))),
        Rule("marks", (c("n_marks") >= 3) & (c("n_marks") * 8 > n), c("n_marks") * 50 <= n),
        Rule("dup_lines", (c("n_lines") >= 3) & (c("n_dup_lines") * 3 > c("n_lines")), (c("n_lines") >= 3) & (c("n_dup_lines") == 0)),
    ]


@dataclass
class LabelModel:
    """Share of good documents and, by class, each rule's chance to vote good where it votes at all.

    ``good[y, r]``: chance that a vote of rule r on a document of class y is +1, so rule
    r is right on good documents with ``good[1, r]`` and on bad ones with ``1 - good[0, r]``.
    """

    prior: float
    good: np.ndarray
    steps: int = 0
    names: list[str] = field(default_factory=list)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes; an abstention says nothing."""
        up, down = np.log(self.good[1] / self.good[0]), np.log((1 - self.good[1]) / (1 - self.good[0]))
        odds = np.log(self.prior / (1 - self.prior)) + (votes == 1) @ up + (votes == -1) @ down
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit_label_model(votes: np.ndarray, weight: np.ndarray, most_steps: int = 300, tolerance: float = 1e-7) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts.

    It starts from the belief that a document is good unless a rule votes bad.  Every
    estimate is smoothed with a few pseudo-votes, right more often than wrong, and bad
    votes are never taken for a sign of good documents, so the classes keep their names.
    """
    up, cast = (votes == 1).astype(float), (votes != 0).astype(float)
    q = np.where((votes == -1).any(1), 0.1, 0.95)
    before = None
    for step in range(most_steps):
        each = [weight * (1 - q), weight * q]
        prior = float(np.clip((each[1].sum() + 3) / (weight.sum() + 4), 0.01, 0.99))
        seen = [(w @ up + a) / (w @ cast + 4) for w, a in zip(each, (2.0, 3.8))]
        good = np.clip(np.array([np.minimum(seen[0], seen[1]), seen[1]]), 1e-4, 1 - 1e-4)
        model = LabelModel(prior, good, step + 1)
        q = model.posterior(votes)
        now = np.append(good.ravel(), prior)
        if before is not None and np.abs(now - before).max() < tolerance:
            break
        before = now
    return model


def pattern_column(rules: list[Rule]) -> Column:
    """The votes as one number in base 3, the first rule lowest."""
    code = F.lit(0)
    for k, r in enumerate(rules):
        code = code + F.when(r.bad, 0).when(r.good, 2).otherwise(1) * (3**k)
    return code.cast("int")


def votes_of(codes: np.ndarray, n_rules: int) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(n_rules)) % 3 - 1


def judge(counted: DataFrame, rules: list[Rule] | None = None) -> tuple[DataFrame, LabelModel]:
    """``counted`` with ``posterior``, the probability that a document is good, and the model.

    ``counted`` is read twice; hand over a stored table.
    """
    rules = rules or default_rules()
    coded = counted.withColumn("pattern", pattern_column(rules))
    found = coded.groupBy("pattern").count().collect()  # at most 3 ** len(rules) rows
    codes = np.array([r["pattern"] for r in found], np.int64)
    votes = votes_of(codes, len(rules))
    model = fit_label_model(votes, np.array([r["count"] for r in found], float))
    model.names = [r.name for r in rules]
    spark = counted.sparkSession
    verdicts = spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, model.posterior(votes))], "pattern int, posterior double")
    return coded.join(F.broadcast(verdicts), "pattern", "left").drop("pattern"), model


def judged_documents(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, the counts, posterior, base_failed and kept of every document.

    ``base_failed``: under 10 words, or over a fifth of them in repeated 5-word windows.
    """
    judged, _ = judge(stored(with_counts(docs), "rule-counts"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= least))
