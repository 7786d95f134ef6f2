"""Language identification by word frequencies, with character n-grams for unseen words.

A word that training texts hold is scored by the logarithm of its frequency in each language. An unseen
word falls back to its character n-grams: those of the longest length of which at least one is
known, then of the next shorter length, down to single characters; a word without any known
character says nothing. The language with the highest sum wins; ``score`` is its share
of the normalised likelihoods (0 to 1).

Training reads a bounded, random sample of the labelled texts (``sample_docs``), and keeps a bounded
number of words and n-grams, so the model that travels to the tasks is bounded as well.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; letters without any
known character give the most frequent training language, with its share as the score; without any
training rows every text is ``und``; rows with null text or label teach nothing; ties go to the
more frequent, then to the alphabetically first language; repeated rows stay; an input column named like
a result column is replaced, every other one is kept."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

NO_LANGUAGE = "und"
CACHED_WORDS = 200_000  # scored words a worker keeps between batches


def words(text: Column) -> Column:
    """Lower-cased runs of letters and their marks; an empty string may stand at either end."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", -1)


def grams(word: str, n: int) -> list[str]:
    """Character n-grams; those longer than one character see the ends of the word."""
    padded = word if n == 1 else f"\x02{word}\x03"
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Log frequencies (one column per language) of the known words and n-grams."""

    languages: list[str]
    shares: np.ndarray
    known: dict[str, int]                # word -> row of ``word_logs``
    word_logs: np.ndarray
    gram_known: list[dict[str, int]]     # the longest n-grams first
    gram_logs: list[np.ndarray]
    cache: dict[str, np.ndarray] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def word_score(self, word: str) -> np.ndarray:
        at = self.known.get(word)
        if at is not None:
            return self.word_logs[at]
        for level, logs in zip(self.gram_known, self.gram_logs, strict=True):
            n = len(self.gram_known) - self.gram_known.index(level)
            rows = [level[g] for g in grams(word, n) if g in level]
            if rows:
                return logs[rows].mean(axis=0)
        return np.zeros(len(self.languages))

    def scores(self, distinct: list[str]) -> np.ndarray:
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        for word in distinct:
            if word not in self.cache:
                self.cache[word] = self.word_score(word) if word else np.zeros(len(self.languages))
        return np.array([self.cache[word] for word in distinct]).reshape(len(distinct), len(self.languages))

    def predict(self, lists: pa.ListArray, has_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        coded = lists.flatten().dictionary_encode()
        of_words = self.scores(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        ends = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(of_words, axis=0)])
        at = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        totals = ends[at[1:]] - ends[at[:-1]] + np.log(self.shares)
        best = totals.argmax(axis=1)
        share = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
        names = np.array([*self.languages, NO_LANGUAGE], object)
        return names[np.where(has_letter, best, len(self.languages))], np.where(has_letter, share, 0.0)


def _logs(counts: pd.DataFrame, unit: str, languages: list[str], smoothing: float) -> tuple[dict[str, int], np.ndarray]:
    """Smoothed log frequencies, centred, so that a unit that all languages share equally says nothing."""
    wide = counts.pivot_table(index=unit, columns="lang", values="n", aggfunc="sum", fill_value=0, observed=True)
    wide = wide.reindex(columns=languages, fill_value=0)
    values = wide.to_numpy(float) + smoothing
    logs = np.log(values / values.sum(axis=0))
    return {word: at for at, word in enumerate(wide.index)}, logs - logs.mean(axis=1, keepdims=True)


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = 20_000,
          keep_words: int = 30_000, keep_grams: int = 20_000, longest: int = 4, smoothing: float = 0.5) -> Model | None:
    """Fit on about ``sample_docs`` labelled rows, drawn by a hash of their key; None without any."""
    labelled = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull())
    shares = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return None
    languages = sorted(shares, key=lambda x: (-shares[x], x))
    total = sum(shares.values())
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 30)) < int(min(1.0, sample_docs / total) * (1 << 30))
    counts = labelled.where(drawn).select("lang", F.explode(words(F.col("text"))).alias("word")).where(
        "word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n")).persist()

    def most_frequent(rows: DataFrame, unit: str, limit: int) -> pd.DataFrame:
        kept = rows.groupBy(unit).agg(F.sum("n").alias("all")).orderBy(F.desc("all"), unit).limit(limit)
        return rows.join(kept, unit).groupBy(unit, "lang").agg(F.sum("n").alias("n")).toPandas()

    known, word_logs = _logs(most_frequent(counts, "word", keep_words), "word", languages, smoothing)
    gram_known, gram_logs = [], []
    for n in range(longest, 0, -1):
        padded = F.col("word") if n == 1 else F.concat(F.lit("\x02"), "word", F.lit("\x03"))
        cut = F.expr(f"transform(sequence(1, length(padded) - {n - 1}), i -> substring(padded, i, {n}))")
        rows = counts.withColumn("padded", padded).where(F.length("padded") >= n).select("lang", "n", F.explode(cut).alias("gram"))
        units, logs = _logs(most_frequent(rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram", keep_grams),
                            "gram", languages, smoothing)
        gram_known.append(units)
        gram_logs.append(logs)
    counts.unpersist()
    return Model(languages, np.array([shares[x] / total for x in languages]), known, word_logs, gram_known, gram_logs)


def identify(df: DataFrame, model: Model | None, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The rows with their predicted language and its score."""
    if model is None:
        return df.withColumns({lang_pred: F.lit(NO_LANGUAGE), score: F.lit(0.0)})

    @F.arrow_udf(f"struct<{lang_pred}: string, {score}: double>")
    def predicted(lists: pa.Array, has_letter: pa.Array) -> pa.Array:
        names, shares = model.predict(lists, has_letter.to_numpy(zero_copy_only=False).astype(bool))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(shares, pa.float64())], [lang_pred, score])

    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    found = df.withColumn("__found", predicted(words(F.col(text)), has_letter))
    return found.withColumns({lang_pred: found["__found"][lang_pred], score: found["__found"][score]}).drop("__found")


def held_out(key: Column) -> Column:
    """Rows kept from training: every fourth by checksum, and those without a key."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(True))
