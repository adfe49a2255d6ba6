"""Operator 9: language identification, words first, then ever shorter character n-grams.

A known word scores its log frequency in each language. For an unseen word the text ^word$ is read from the left: the
longest n-gram known at a place gives its log frequency in each language and the reading goes on behind it; where even
the single character is unknown, all languages get the same. The language of the largest sum wins, ties to the first in
alphabetical order; the score is that language's share after the sums are set against each other. A word is a run of
letters (category L) in lower case.

The counts come from a sample of labelled texts, drawn for each language: those of smallest hash, at most `sample_rows` of
them, until they have `sample_bytes` bytes together; the text that reaches the bound is counted whole, whatever its
length. All words and n-grams of the sample are kept. Prediction reads every whole text.

Defined results: null text, or one without letters, is `und` with score 0; with nothing to learn from, every text is
`und`; rows are judged each for itself; equal texts of one language are learned from once; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import lower_letters
from .common import Shared, map_arrow, table
from .words import HashTable, hash_ranges, hash_words, lowered, row_groups, runs

WORD = re.compile(r"[^\W\d_]+")
LETTERS = regex.compile(r"\p{L}+")
LONGEST = 5
SAMPLE_ROWS = 1500
SAMPLE_BYTES = 4 << 20
FLOOR = 0.5  # what is added to each count
UNSEEN = 200_000  # unseen words whose scores are kept
GROUP_BYTES = 1 << 20


def letter_words(text: str) -> list[str]:
    """The runs of letters of a text in lower case."""
    out = []
    for w in WORD.findall(text):  # numbers that aren't digits are word characters too
        out += [w] if w.isalpha() else LETTERS.findall(w)
    return out


class WordBackoff:
    """Log frequencies per language of words and of n-grams; a text's score is a sum over its words."""

    def __init__(self, languages: list[str], words: list[str], word_logs: np.ndarray, grams: list[str], gram_logs: np.ndarray, longest: int) -> None:
        self.state = (languages, words, word_logs, grams, gram_logs, longest)
        self.languages, self.longest = languages, longest
        self.known, self.word_logs = HashTable(), word_logs
        self.known.add(hash_words(words), np.arange(len(words)))
        self.grams, self.gram_logs = {g: i for i, g in enumerate(grams)}, gram_logs
        self._forget()

    def _forget(self) -> None:
        self.unseen, self.unseen_logs = HashTable(), np.zeros((1024, len(self.languages)))

    @classmethod
    def fit(cls, counts: dict[str, Counter], longest: int = LONGEST) -> WordBackoff:
        """From word counts per language."""
        languages = sorted(counts)
        kept, logs = _logs(counts, languages)
        grams, gram_logs = [], [np.zeros((0, len(languages)))]
        for k in range(1, longest + 1):
            own = {x: Counter() for x in languages}
            for x in languages:
                for w, n in counts[x].items():
                    s = f"^{w}$"
                    for i in range(len(s) - k + 1):
                        own[x][s[i : i + k]] += n
            g, t = _logs(own, languages)
            grams += g
            gram_logs.append(t)
        return cls(languages, kept, logs, grams, np.concatenate(gram_logs), longest)

    def backoff(self, word: str) -> np.ndarray:
        """Scores of an unseen word."""
        s, i, rows = f"^{word}$", 0, []
        while i < len(s):
            for k in range(min(self.longest, len(s) - i), 0, -1):
                if (row := self.grams.get(s[i : i + k])) is not None:
                    rows.append(row)
                    break
            i += k
        return self.gram_logs[rows].sum(axis=0)

    def scores(self, keys: np.ndarray, word_at) -> np.ndarray:
        """The scores of words, given by hash; word_at tells the word of a place."""
        at = self.known.find(keys)
        out = self.word_logs[np.maximum(at, 0)] if len(self.word_logs) else np.zeros((len(keys), len(self.languages)))
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return out
        if self.unseen.used > UNSEEN:
            self._forget()
        own = self.unseen.find(keys[missing])
        new = np.flatnonzero(own < 0)
        if len(new):
            distinct, first, inverse = np.unique(keys[missing[new]], return_index=True, return_inverse=True)
            begin, end = self.unseen.used, self.unseen.used + len(distinct)
            if end > len(self.unseen_logs):
                wider = np.zeros((max(end, 2 * len(self.unseen_logs)), len(self.languages)))
                wider[:begin] = self.unseen_logs[:begin]
                self.unseen_logs = wider
            for k, place in enumerate(missing[new[first]].tolist(), begin):
                self.unseen_logs[k] = self.backoff(word_at(place))
            self.unseen.add(distinct, np.arange(begin, end))
            own[new] = begin + inverse
        out[missing] = self.unseen_logs[own]
        return out

    def sums(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The sum of scores of each text's words, and how many it has."""
        total, words = np.zeros((len(column), len(self.languages))), np.zeros(len(column), dtype=np.int64)
        whole, at = lowered(column)
        for lo, hi in row_groups(at, GROUP_BYTES):
            data, offsets = whole[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            low, letter = lower_letters(data)
            # texts with other characters than ASCII ones and Latin-1 letters are split one by one
            hard = np.unique(np.searchsorted(offsets, np.flatnonzero((data >= 0x80) & ~letter), side="right") - 1)
            for r in hard.tolist():
                letter[offsets[r] : offsets[r + 1]] = False
                found = letter_words(data[offsets[r] : offsets[r + 1]].tobytes().decode())
                if found:
                    total[lo + r], words[lo + r] = self.scores(hash_words(found), found.__getitem__).sum(axis=0), len(found)
            starts, ends, counts = runs(letter, offsets)
            if len(starts):
                each = self.scores(hash_ranges(low, starts, ends), lambda k: low[starts[k] : ends[k]].tobytes().decode())
                some = np.flatnonzero(counts)
                total[lo + some] = np.add.reduceat(each, (np.cumsum(counts) - counts)[some], axis=0)
                words[lo + some] = counts[some]
        return total, words

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        if not self.languages:
            return ["und"] * len(column), np.zeros(len(column))
        total, words = self.sums(column)
        best = total.argmax(axis=1) if len(total) else np.zeros(0, dtype=np.int64)
        share = 1 / np.exp(np.clip(total - total.max(axis=1, keepdims=True), -700, 0)).sum(axis=1) if len(total) else np.zeros(0)
        return [self.languages[k] if n else "und" for k, n in zip(best.tolist(), words.tolist(), strict=True)], np.where(words > 0, share, 0.0)


def _logs(counts: dict[str, Counter], languages: list[str]) -> tuple[list[str], np.ndarray]:
    """All items, and their smoothed log frequency in each language."""
    items = sorted(set().union(*counts.values())) if counts else []
    n = np.array([[counts[x][i] + FLOOR for x in languages] for i in items]).reshape(len(items), len(languages))
    return items, np.log(n / (np.array([sum(counts[x].values()) for x in languages]) + FLOOR * max(len(items), 1)))


def sample(df: DataFrame, text_col: str, lang_col: str, sample_rows: int, sample_bytes: int) -> DataFrame:
    """text, lang of the labelled texts that are learned from. Only hashes and lengths are ranked; the sample is broadcast.

    Hashes are counted by their first 12 bits, so that of each language only those up to the one that fills the sample meet in a task.
    """
    rows = df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull()).withColumn("h", F.xxhash64("text"))
    ranked = rows.groupBy("lang", "h").agg(F.max(F.octet_length("text")).alias("n"))
    begin = F.shiftright("h", 52)  # in the order of hashes
    counts = ranked.groupBy("lang", begin.alias("begin")).agg(F.count("*").alias("c"))
    smaller = F.coalesce(F.sum("c").over(W.partitionBy("lang").orderBy("begin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = counts.withColumn("smaller", smaller).where(F.col("smaller") < sample_rows).groupBy("lang").agg(F.max("begin").alias("end"))
    ranked = ranked.join(F.broadcast(ends), "lang").where(begin <= F.col("end")).select("lang", "h", "n")
    by = W.partitionBy("lang").orderBy("h")
    first = ranked.withColumn("k", F.row_number().over(by)).where(F.col("k") <= sample_rows)
    before = F.coalesce(F.sum("n").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chosen = first.withColumn("before", before).where(F.col("before") < sample_bytes).select("lang", "h")
    return rows.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("text", "lang")


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> WordBackoff:
    """The model from a bounded sample of df's rows with a language."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for text, lang in sample(df, text_col, lang_col, sample_rows, sample_bytes).toLocalIterator():
        counts[lang].update(letter_words(pc.utf8_lower(pa.scalar(text, pa.large_string())).as_py()))  # as texts are lowered when they are judged
    return WordBackoff.fit(counts)


def language_id(df: DataFrame, model: WordBackoff, id_col: str = "doc_id", text_col: str = "text", extra: dict | None = None) -> DataFrame:
    """doc_id, lang_pred, score of every row, and the columns that extra computes."""
    extra = extra or {}
    more = list(extra)
    shared = Shared(df.sparkSession, model.state, lambda state: WordBackoff(*state))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        languages, scores = shared.get().predict(b.column(1))
        return pa.RecordBatch.from_arrays([b.column(0), *(b.column(2 + i) for i in range(len(more))), pa.array(languages, pa.string()), pa.array(scores)], names=["doc_id", *more, "lang_pred", "score"])

    read = df.select(F.col(id_col), F.col(text_col).cast("string"), *(c.alias(n) for n, c in extra.items()))
    kinds = [f.dataType.simpleString() for f in read.schema.fields]
    return map_arrow(read, run, f"doc_id {kinds[0]}, {''.join(f'{n} {k}, ' for n, k in zip(extra, kinds[2:], strict=True))}lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return language_id(docs, learn(docs.where(~held_out)), extra={"held_out": held_out})
