"""Language identification by words first, then character n-grams (operator 4).

Every word of a text is scored for each language: a known word by its log
relative frequency in that language (a fixed penalty where the language does
not have it), an unseen word by the mean over its character n-grams of the
longest length of which at least one is known, from ``max_gram`` down to 1.
The mean over all words of the text decides; ``score`` turns the distances of
the means into a share between 0 and 1.

``train`` learns from a sample of about ``sample_rows`` labelled rows of each
language (rows by hash, so repeatable; all rows of a language that has fewer),
counts words and n-grams in Spark, and keeps the ``max_words`` and
``max_grams`` most frequent of each language, so that a small language loses
neither its rows nor its words to a large one.  The model's size, and so the
broadcast, is bounded by these parameters and, with many languages, by
``MAX_CELLS`` (never below an even share of ``max_words``).

Defined cases: a null text or one without a letter is ``und`` with score 0; so
is every text when no language was learned.  A text with letters of which
nothing is known gets the language with most training words, with an equal
share as score.  Repeated rows get equal results, other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiaudit.llm.common import TEXT_ROWS, held_out, training_sample_by, written

UNKNOWN = "und"
SAMPLE_ROWS = 12_000
MAX_WORDS, MAX_GRAMS, MAX_GRAM = 60_000, 32_000, 4
#: Numbers in the matrix of the words, and in that of the n-grams of one length.
MAX_CELLS = 8_000_000
#: Score of a known word or n-gram in a language that does not have it: below any relative frequency here.
PENALTY = -16.0
#: How sharply distances between mean log frequencies become shares.
SHARPNESS = 1.0
#: Characters of a run that tells something, and words of a text of which something must be known.
DEEP, MIN_WORDS = 3, 20
_LETTERS = re.compile(r"[^\W\d_]+")
#: Scores of unseen words that a task remembers; when full, it starts afresh.
_REMEMBERED = 100_000


def letter_words(text: str | None) -> list[str]:
    words = _LETTERS.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


@dataclass
class LanguageModel:
    """Languages by training size; log frequencies by word and by n-gram (rows of matrices, a column a language)."""

    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    max_gram: int

    def unseen(self, word: str) -> np.ndarray:
        padded = f" {word} "
        for n in range(min(self.max_gram, len(padded)), 0, -1):
            known = [r for i in range(len(padded) - n + 1) if (r := self.grams.get(padded[i:i + n])) is not None]
            if known:
                return self.gram_scores[known].mean(axis=0)
        return np.full(len(self.languages), PENALTY)


class Scorer:
    def __init__(self, model: LanguageModel):
        self.m, self.known = model, len(model.words)
        self.table = np.empty((self.known + _REMEMBERED, len(model.languages)))
        self.table[:self.known] = model.word_scores
        self.index = dict(model.words)

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = letter_words(text)
        if not words or not self.m.languages:
            return UNKNOWN, 0.0
        total, at = 0.0, 0
        while at < len(words):  # one round unless the remembered words fill up
            part = words[at:at + _REMEMBERED]
            rows = list(map(self.index.get, part))
            if None in rows:
                if len(self.index) + rows.count(None) > len(self.table):
                    self.index = dict(self.m.words)
                    rows = list(map(self.index.get, part))
                for i, r in enumerate(rows):
                    if r is None:
                        if (r := self.index.get(part[i])) is None:
                            r = self.index[part[i]] = len(self.index)
                            self.table[r] = self.m.unseen(part[i])
                        rows[i] = r
            total = total + self.table[rows].sum(axis=0)
            at += len(part)
        mean = total / len(words)
        best = int(mean.argmax())
        return self.m.languages[best], float(1 / np.exp(SHARPNESS * (mean - mean[best])).sum())


class Evidence(Scorer):
    """Also tells how much of a text the model knows: the share of its words that are known as a whole or hold a known
    run of ``DEEP`` characters.  Noise and writing that no learned language has share little with the model."""

    def __init__(self, model: LanguageModel):
        super().__init__(model)
        self.deep: dict[str, bool] = {}

    def _known(self, word: str) -> bool:
        if word in self.m.words:
            return True
        got = self.deep.get(word)
        if got is None:
            if len(self.deep) >= _REMEMBERED:
                self.deep.clear()
            padded = f" {word} "
            got = self.deep[word] = any(padded[i:i + DEEP] in self.m.grams for i in range(len(padded) - DEEP + 1))
        return got

    def known_share(self, text: str | None) -> tuple[int, float]:
        """Number of words, and the share of them that the model knows something of."""
        words = letter_words(text)
        return len(words), sum(map(self._known, words)) / len(words) if words else 0.0


def least_known_shares(told: DataFrame, lang_col: str = "lang", words_col: str = "__words", known_col: str = "__known",
                       share: float = 0.5, quantile: float = 0.005, min_words: int = MIN_WORDS,
                       min_rows: int = 50) -> dict[str, float]:
    """By language, how much of a text of ``min_words`` words the model must know: ``share`` of what all but a
    ``quantile`` of labelled rows (not those it was trained on) reach.  ``told``: these rows with the number of their
    words and the share known.  0 where fewer than ``min_rows`` tell."""
    found = told.where(F.col(words_col) >= min_words).groupBy(F.col(lang_col).alias("lang")).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx(known_col, quantile).alias("least")).collect()
    return {r["lang"]: share * r["least"] if r["n"] >= min_rows else 0.0 for r in found}


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS,
          max_grams: int = MAX_GRAMS, max_gram: int = MAX_GRAM) -> LanguageModel:
    """Learn from all of ``rows`` with a label; take a sample first."""
    pairs = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                found: dict[str, Counter] = {}
                for text, lang in zip(*(c.to_pylist() for c in whole.slice(at, 1024).columns), strict=True):
                    found.setdefault(lang, Counter()).update(letter_words(text))
                for lang, words in found.items():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(words), pa.string()), pa.array([lang] * len(words)),
                         pa.array(list(words.values()), pa.int64())], names=["item", "lang", "n"])

    counted = pairs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).mapInArrow(
        count, "item string, lang string, n long")
    words = written(counted.groupBy("item", "lang").agg(F.sum("n").alias("n")), "words", TEXT_ROWS)
    padded = F.concat(F.lit(" "), F.col("item"), F.lit(" "))

    def parts(k: int) -> Column:  # a lambda of two parameters would get the index as the second
        return F.transform(F.sequence(F.lit(1), F.length("item") + 3 - k), lambda i: F.substring(padded, i, F.lit(k)))

    grams = [words.where(F.length("item") + 2 >= k).select(F.explode(parts(k)).alias("item"), "lang", "n")
             for k in range(1, max_gram + 1)]
    every = grams[0]
    for more in grams[1:]:
        every = every.unionByName(more)
    every = every.where(F.col("item") != " ")  # the mark of a word's ends alone tells nothing
    every = written(every.groupBy("item", "lang").agg(F.sum("n").alias("n")), "grams")

    sizes = words.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").collect()
    languages = [r["lang"] for r in sizes]

    def scores(counts: DataFrame, limit: int, least: int, sizes: list) -> tuple[dict[str, int], np.ndarray]:
        many = max(1, len(languages))
        limit = max(limit // many, min(limit, MAX_CELLS // many**2))
        entries = counts.join(counts.groupBy("item").agg(F.sum("n").alias("all")).where(F.col("all") >= least), "item")
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "item"))
        best = written(entries.withColumn("rank", rank).where(F.col("rank") <= limit).select("item").distinct(), "best")
        kept = counts.join(best, "item").groupBy("item").agg(F.map_from_entries(
            F.collect_list(F.struct("lang", "n"))).alias("by"))
        by = F.array(*[F.coalesce(F.try_element_at("by", F.lit(x)), F.lit(0)) for x in languages]).cast("array<double>")
        found = kept.select("item", by.alias("by")).toArrow()
        table = found.column(1).combine_chunks().flatten().to_numpy().reshape(len(found), len(languages))
        with np.errstate(divide="ignore"):
            table = np.where(table > 0, np.log(table / np.array(sizes, dtype=float)), PENALTY)
        return {x: i for i, x in enumerate(found.column(0).to_pylist())}, table

    by_length = every.withColumn("k", F.length("item"))
    gram_sizes = {(r["k"], r["lang"]): r["n"] for r in
                  by_length.groupBy("k", "lang").agg(F.sum("n").alias("n")).collect()}
    index, table = scores(words, max_words, 2, [r["n"] for r in sizes])
    gram_index, gram_table = {}, [np.empty((0, len(languages)))]
    for k in range(1, max_gram + 1):
        one, t = scores(by_length.where(F.col("k") == k).drop("k"), max_grams // max_gram, 1,
                        [gram_sizes.get((k, x), 1) for x in languages])
        gram_index |= {g: i + len(gram_index) for g, i in one.items()}
        gram_table.append(t)
    return LanguageModel(languages, index, table, gram_index, np.vstack(gram_table), max_gram)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text",
             out: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` and more, named by ``out``: the language and its score, with four names also the number
    of words and the share of them that the model knows (see :class:`Evidence`)."""
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, more = docs.columns.index(text_col), len(out) > 2
    kinds = (StringType(), DoubleType(), LongType(), DoubleType())
    schema = StructType([*docs.schema.fields, *[StructField(n, k) for n, k in zip(out, kinds)]])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Evidence(shared.value) if more else Scorer(shared.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                texts = batch.column(at).to_pylist()
                found = [scorer(t) for t in texts]
                columns = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
                if more:
                    known = [scorer.known_share(t) for t in texts]
                    columns += [pa.array([x for x, _ in known], pa.int64()), pa.array([x for _, x in known], pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return docs.mapInArrow(predict, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows that are not held out, applied to all."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = own.where(~held_out("doc_id", 4, 2) & F.col("lang").isNotNull())
    model = train(training_sample_by(labelled, "doc_id", "lang", sample_rows))
    asked = own.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text")
    return identify(asked, model).drop("text")
