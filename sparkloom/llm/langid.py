"""Language identification by words, backing off to character n-grams.

A known word scores each language by its log frequency there. An unseen word is scored by its character n-grams (word
ends marked) of the longest order of which the model knows any, five characters first, then fewer. A text's score sums
up its words; the prediction is the language with the highest sum, its score the softmax over the languages.

The model is fitted on a sample of labelled texts, at most about ``MAX_TRAIN`` of them with ``TRAIN_BYTES`` of text, by a
hash of the whole row. That alone bounds its vocabulary, which is sent to every worker: no word or n-gram is left out by
rank. Whole texts are counted and predicted. Words and n-grams seen once in the sample are left to the shorter n-grams.

A letter is a character of Unicode's letter categories: digits, fractions and signs are neither learned nor scored. Null
texts and texts without a letter are ``und`` with score 0, as is every text if there is nothing to learn from. Ties go to
the language first in order. Rows without text or language teach nothing; equal rows teach once and get equal results.
Very long texts are read whole, word by word. An empty table gives an empty one. Columns besides those named are not
read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import bounded, lent, pieces
from sparkloom.llm.sampling import bounded_sample
from sparkloom.storage import materialize, scratch

MAX_TRAIN, TRAIN_BYTES, ORDERS = 4_000, 16 << 20, 5
#: Added to every count, and words whose scores a worker keeps.
SMOOTHING, TABLE_ENTRIES = 0.5, 100_000
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def held_out(id_col: Column) -> Column:
    """The quarter of ids that no classifier here learns from."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2


def words_of(text: str) -> list[str]:
    """Runs of letters and of number characters that are no digits, those without a letter left out."""
    found = LETTERS.findall(text.lower())
    return found if text.isascii() else [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def grams_of(word: str, order: int) -> list[str]:
    marked = f"<{word}>" if order > 1 else word
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]

#: accepted(): the share of the usual lead that a text's language needs, if the text has so many words.
LEAST_SHARE, LEAST_WORDS = 0.1, 8


@dataclass
class Model:
    langs: list[str]
    words: list[str]
    word_scores: np.ndarray  # log frequency, words x languages
    grams: list[str]
    gram_scores: np.ndarray
    usual: dict[str, float] = field(default_factory=dict)  # of each language the median of its texts' margins
    _word_at: dict[str, int] | None = field(default=None, repr=False)
    _gram_at: dict[str, int] = field(default_factory=dict, repr=False)

    def prepare(self) -> None:
        """Tables of a worker: the scores of known words, and after them those of unseen words."""
        self._word_at = {w: i for i, w in enumerate(self.words)}
        self._gram_at = {g: i for i, g in enumerate(self.grams)}
        self._fixed = len(self.words)
        self._scores = np.zeros((self._fixed + TABLE_ENTRIES, len(self.langs)), np.float32)
        self._scores[: self._fixed] = self.word_scores
        self._seen: dict[str, int] = {}

    def back_off(self, word: str) -> np.ndarray:
        """Scores of an unseen word: the mean of its n-grams of the longest order of which any is known."""
        for order in range(ORDERS, 0, -1):
            known = [i for g in grams_of(word, order) if (i := self._gram_at.get(g)) is not None]
            if known:
                return self.gram_scores[known].mean(0)
        return np.zeros(len(self.langs), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        total, _ = self.totals(text)
        if total is None:
            return UNKNOWN, 0.0
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())

    def margin(self, text: str | None) -> tuple[str, float, int]:
        """The text's language, by how much it leads the next one for each word on average, and the number of words."""
        total, n = self.totals(text)
        if total is None:
            return UNKNOWN, 0.0, 0
        order = np.argsort(total)
        return self.langs[order[-1]], float(total[order[-1]] - total[order[-2]]) / n if len(total) > 1 else np.inf, n

    def totals(self, text: str | None) -> tuple[np.ndarray | None, int]:
        """Sums of the words' scores by language, and the number of words; nothing for a text without a letter."""
        if self._word_at is None:
            self.prepare()
        words = words_of(text) if text and self.langs else []
        if not words:
            return None, 0
        known, seen = self._word_at, self._seen
        total, at = np.zeros(len(self.langs)), []
        for word in words:
            i = known.get(word)
            if i is None:
                i = seen.get(word)
                if i is None:
                    if len(seen) == TABLE_ENTRIES:  # rows are used again only when no word of this text refers to them
                        total += self._scores[at].sum(0, dtype=float)
                        at.clear()
                        seen.clear()
                    i = self._fixed + len(seen)
                    self._scores[i] = self.back_off(word)
                    seen[word] = i
            at.append(i)
        return total + self._scores[at].sum(0, dtype=float), len(words)


def _log_frequency(rows: list, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Items, and their smoothed log frequencies; rows: item, lang, n, gram. n-grams are shares of those as long."""
    place, at = {x: i for i, x in enumerate(langs)}, {}
    for r in rows:
        at.setdefault(r["item"], len(at))
    counts = np.zeros((len(at), len(langs)))
    orders = np.zeros(len(at), np.int64)
    for r in rows:
        counts[at[r["item"]], place[r["lang"]]] = r["n"]
        orders[at[r["item"]]] = len(r["item"]) if r["gram"] else 0
    out = np.zeros_like(counts)
    for order in np.unique(orders):
        own = counts[orders == order] + SMOOTHING
        out[orders == order] = np.log(own / own.sum(0))
    return list(at), out.astype(np.float32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a part's words and n-grams, so that one row of each goes on."""
    for batch in batches:
        words: Counter = Counter()
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.update((lang, w) for w in words_of(text))
        grams: Counter = Counter()
        for (lang, w), n in words.items():
            for order in range(1, ORDERS + 1):
                for g in grams_of(w, order):
                    grams[lang, g] += n
        for gram, counter in ((False, words), (True, grams)):
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in counter], pa.string()), pa.array([x[1] for x in counter], pa.string()), pa.array([gram] * len(counter), pa.bool_()), pa.array(counter.values(), pa.int64())], names=["lang", "item", "gram", "n"])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN, train_bytes: int = TRAIN_BYTES, margins: bool = False) -> Model:
    """Learns from the texts that have a language: all if they are at most max_train with train_bytes of text, else as
    large a share of them. What the driver collects grows with these two and not with the table. margins: also learn what
    lead each language usually has in its texts, which accepted() asks for."""
    rows = bounded(docs).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    spread = docs.sparkSession.sparkContext.defaultParallelism * 2  # the sample may lie in a few large files
    with scratch(docs.sparkSession):
        rows = bounded_sample(rows, "text", max_train, train_bytes, "langid-sample")
        counted = rows.repartition(spread).mapInArrow(_counts, "lang string, item string, gram boolean, n long").groupBy("gram", "item", "lang").agg(F.sum("n").alias("n"))
        counted = materialize(counted, "langid-counts")
        several = counted.groupBy("gram", "item").agg(F.sum("n").alias("total")).filter("total > 1").select("gram", "item")
        kept = counted.join(several, ["gram", "item"]).orderBy("gram", "item", "lang").collect()
        langs = sorted({r["lang"] for r in kept})
        model = Model(langs, *_log_frequency([r for r in kept if not r["gram"]], langs), *_log_frequency([r for r in kept if r["gram"]], langs))
        if margins:
            found = _margins(rows.repartition(spread).select("text"), model).filter("margin < double('inf')").groupBy("lang").agg(F.percentile_approx("margin", 0.5).alias("usual"))
            model.usual = {r["lang"]: r["usual"] for r in found.collect() if r["lang"] != UNKNOWN}
    return model


def _margins(texts: DataFrame, model: Model) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lent(sent) as known:
            for batch in pieces(batches):
                found = [known.margin(t) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang", "margin"])

    return texts.mapInArrow(run, "lang string, margin double")


def predict(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the columns named in keep."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [sent.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["own", "lang_pred", "score"])

    own = F.struct(F.col(id_col).alias("doc_id"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep))).alias("own")
    rows = bounded(docs).select(own, F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"own {rows.schema['own'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(F.col("own.doc_id"), F.coalesce(held_out(F.col("own.doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", *(F.col(f"own.c{i}").alias(c) for i, c in enumerate(keep)))


def identify(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fits on the rows that are not held out, and predicts all."""
    return predict(docs, fit(docs.filter(~held_out(F.col("doc_id")))), keep=keep)


def accepted(docs: DataFrame, model: Model, share: float = LEAST_SHARE, words: int = LEAST_WORDS, text_col: str = "text") -> DataFrame:
    """The rows, as they are, whose text has a language: a letter at least and, if it has so many words, a mean lead of one
    language over the next of at least so large a share of what is usual for it. model: fitted with margins. Of a text of
    fewer words too little is known to reject it."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def fits(known: Model, text: str | None) -> bool:
        lang, margin, n = known.margin(text)
        return lang != UNKNOWN and (n < words or margin >= share * known.usual.get(lang, 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lent(sent) as known:
            for batch in pieces(batches):
                yield batch.filter(pa.array([fits(known, t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return bounded(docs).mapInArrow(run, docs.schema)
