"""Language ID: known words by per-language log frequency, backing off to shorter n-grams.

A word is a maximal run of letters, in lower case, in training as in prediction. A word seen in
training adds its log relative frequency in each language. An unseen word is spelt with boundary
marks and scored by its character n-grams of the longest order (5) of which any is known; only
if none is, by the next shorter order, down to single characters, the evidence weighing
``DISCOUNT`` less at each step. The language of the highest sum wins.

Training takes a bounded sample, ``TRAIN_DOCS`` documents at most, of those whose
crc32(doc_id as text) mod 5 isn't 0 and whose language isn't null: the ones with the
lowest hash of doc_id. Word counts of the sample are summed by Spark; of each language the
``MAX_WORDS`` most frequent words and ``MAX_GRAMS`` most frequent n-grams are the model,
which is bounded by these parameters and so can be sent to every executor. Prediction
reads whole texts of all documents in one pass without a shuffle; it reads text only, and no
other column leaves the JVM.

Words are looked up by distinct white-space separated pieces, lowered and with marks and digits
at their edges taken off in Arrow; a piece's row of scores is the sum of its words' and is kept in
the worker (about ``MAX_KNOWN`` of them).

Defined cases: null text or no letter at all: ``und`` with score 0. An empty training set
gives ``und`` throughout. Ties: the language first in alphabetical order. Repeated rows
each give their row; where rows tie at the edge of the sample (repeated doc_ids) none of them is in
it, so that it keeps its bound. Very long texts are read in pieces of ``SLICE`` bytes, a document at
least. A null doc_id counts as the empty text, whose crc32 is 0: held out. An empty table gives no
rows. score: the winner's posterior probability, each word weighing as one observation and the
evidence tempered by ``TEMPER`` so as to stay below certainty. Extra columns are ignored by
``identify`` and kept by ``tag``, whatever their names; of the columns that ``tag`` adds, one that is
there already is replaced.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import discard, kept_in_process, slices, stored, strings, totals, whole_text, with_own, word_codes

TRAIN_DOCS = 12_000
MAX_WORDS = 40_000
MAX_GRAMS = 20_000
ORDERS = (5, 4, 3, 2, 1)
DISCOUNT = 0.8
TEMPER = 0.25
MAX_KNOWN = 400_000
#: Bytes of text looked at together.
SLICE = 4_000_000
#: Taken off a piece's edges before it is looked up; none of them is a letter.
EDGES = "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"
ANSWER = "pred string, score double"
ADDED = ("language_id_pred", "language_id_score")


def words_in(text: Column) -> Column:
    """Maximal runs of letters, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"\P{L}+"), "")


def words_of_piece(piece: str) -> list[str]:
    """The same for a piece of text in a worker."""
    low = piece.lower()
    return [low] if low.isalpha() else "".join([c if c.isalpha() else " " for c in low]).split()


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Model:
    """Log frequencies: a row for each known word and n-gram, a column for each language."""

    def __init__(self, langs: list[str], words: dict[str, int], word_rows: np.ndarray, grams: dict[str, int], gram_rows: np.ndarray):
        self.langs, self.words, self.word_rows, self.grams, self.gram_rows = langs, words, word_rows, grams, gram_rows

    def parts(self) -> tuple:
        return self.langs, self.words, self.word_rows, self.grams, self.gram_rows

    def score(self, words: list[str]) -> np.ndarray:
        """A row for each word: its own, else the mean of its longest known n-grams, else zeros."""
        out = np.zeros((len(words), len(self.langs)), dtype=np.float32)
        known, grams, flat, owners, weights, starts = self.words, self.grams, [], [], [], []
        for k, word in enumerate(words):
            row = known.get(word)
            if row is not None:
                out[k] = self.word_rows[row]
                continue
            spelt = f"<{word}>"
            for step, order in enumerate(ORDERS):
                found = [g for i in range(len(spelt) - order + 1) if (g := grams.get(spelt[i : i + order])) is not None]
                if found:
                    starts.append(len(flat))
                    flat += found
                    owners.append(k)
                    weights.append(DISCOUNT**step / len(found))
                    break
        if flat:
            out[owners] = np.add.reduceat(self.gram_rows[flat], starts, axis=0) * np.array(weights, dtype=np.float32)[:, None]
        return out


def fit(counts: list[tuple[str, str, int]]) -> Model:
    """From (language, word, count) rows of the bounded sample."""
    langs = sorted({lang for lang, _, _ in counts})

    def table(by: dict[str, Counter], most: int) -> tuple[list[str], np.ndarray]:
        kept = sorted({x for c in by.values() for x, _ in sorted(c.items(), key=lambda e: (-e[1], e[0]))[:most]})
        n = np.array([[by[lang][x] for lang in langs] for x in kept], dtype=np.float64).reshape(len(kept), len(langs))
        totals = np.array([sum(by[lang].values()) for lang in langs])
        return kept, np.log((n + 0.1) / (totals + 0.1 * (len(kept) + 1))).astype(np.float32)

    words: dict[str, Counter] = defaultdict(Counter)
    grams: dict[int, dict[str, Counter]] = {n: defaultdict(Counter) for n in ORDERS}
    for lang, word, n in counts:
        words[lang][word] += n
        spelt = f"<{word}>"
        for order in ORDERS:
            for i in range(len(spelt) - order + 1):
                grams[order][lang][spelt[i : i + order]] += n
    own, rows = table(words, MAX_WORDS)
    by_order = [table(grams[n], MAX_GRAMS) for n in ORDERS]
    every = [g for names, _ in by_order for g in names]
    return Model(langs, {w: i for i, w in enumerate(own)}, rows, {g: i for i, g in enumerate(every)}, np.concatenate([r for _, r in by_order]))


def sampled(seen: DataFrame, train_docs: int) -> DataFrame | None:
    """The rows with the lowest hashes of doc_id, at most ``train_docs``; whole rows are never sorted."""
    h = F.xxhash64(F.col("doc_id").cast("string"))
    lowest = seen.select(h.alias("h")).orderBy("h").limit(train_docs + 1).agg(F.count("*").alias("n"), F.max("h").alias("edge")).first()
    if lowest.n == 0:
        return None
    return seen if lowest.n <= train_docs else seen.where(h < lowest.edge)


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    own = docs.select(docs["doc_id"].alias("doc_id"), whole_text(docs).alias("text"), docs["lang"].cast("string").alias("lang"))
    sample = sampled(own.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))), train_docs)
    if sample is None:
        return fit([])
    counts = sample.select("lang", F.explode(words_in(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = stored(counts, "language-words")
    # The least count of a language that leaves MAX_WORDS words at most, from the number of words by count.
    cuts: dict[str, tuple[int, int]] = {}
    for r in counts.groupBy("lang", "n").agg(F.count("*").alias("words")).orderBy("lang", F.desc("n")).collect():  # a sample's counts
        total, cut = cuts.get(r.lang, (0, 0))
        cuts[r.lang] = (total + r.words, r.n if total + r.words <= MAX_WORDS else cut)
    least = F.create_map(*[F.lit(x) for lang, (_, cut) in cuts.items() for x in (lang, cut)]) if cuts else None
    rows = counts.where(F.col("n") >= F.element_at(least, F.col("lang"))).collect() if cuts else []
    discard(counts)
    return fit([(r.lang, r.word, r.n) for r in rows])


class Reader:
    """Answers for texts, with the rows of scores of the pieces met before."""

    def __init__(self, model: Model):
        self.model = model
        self.restart()

    def restart(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, len(self.model.langs)), dtype=np.float32)
        self.lettered = np.zeros(1 << 12, dtype=bool)

    def _learn(self, new: list[str]) -> None:
        first, end = len(self.known), len(self.known) + len(new)
        if end > len(self.rows):
            more = max(end, 2 * len(self.rows)) - len(self.rows)
            self.rows = np.concatenate((self.rows, np.zeros((more, self.rows.shape[1]), dtype=np.float32)))
            self.lettered = np.concatenate((self.lettered, np.zeros(more, dtype=bool)))
        split = [words_of_piece(piece) for piece in new]
        sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        scored = self.model.score([word for words in split for word in words])
        some = np.flatnonzero(sizes)
        self.rows[first:end] = 0
        if len(some):
            self.rows[first + some] = np.add.reduceat(scored, (np.cumsum(sizes) - sizes)[some], axis=0)
        self.lettered[first:end] = sizes > 0
        self.known.update(zip(new, range(first, end), strict=True))

    def _pieces(self, words: pa.Array) -> np.ndarray:
        """The row of each piece."""
        coded = pc.dictionary_encode(pc.ascii_trim(pc.ascii_lower(words), characters=EDGES))
        pieces, of = strings(coded.dictionary), self.known.get
        new = [p for p in pieces if p not in self.known]
        if new:
            self._learn(new)
        return np.array([of(p) for p in pieces], dtype=np.int64)[np.asarray(coded.indices)]

    def answers(self, texts: pa.Array) -> pa.StructArray:
        """pred and score of each text."""
        if len(self.known) > MAX_KNOWN:
            self.restart()
        langs, words, codes, starts = self.model.langs, *word_codes(texts)
        row_of = self._pieces(words)[codes]
        told = totals(self.lettered[row_of], starts) > 0 if langs else np.zeros(len(texts), dtype=bool)
        at = np.flatnonzero(told)
        score, best = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        if len(at):
            filled = np.flatnonzero(np.diff(starts))
            sums = np.zeros((len(texts), len(langs)))
            sums[filled] = np.add.reduceat(self.rows[row_of], starts[:-1][filled], axis=0, dtype=np.float64)
            sums = sums[at]
            best[at] = np.argmax(sums, axis=1)
            ahead = np.maximum(-700.0, TEMPER * (sums - sums.max(axis=1, keepdims=True)))
            score[at] = 1.0 / np.exp(ahead).sum(axis=1)
        names = pa.array(langs or ["und"], pa.string()).take(pa.array(best))
        return pa.StructArray.from_arrays([pc.if_else(pa.array(told), names, "und"), pa.array(score)], ["pred", "score"])


def tag(docs: DataFrame, model: Model, added: tuple[str, str] = ADDED) -> DataFrame:
    """All columns of ``docs``, the predicted language and its score under the names ``added``."""
    shared, own = docs.sparkSession.sparkContext.broadcast(model.parts()), uuid.uuid4().hex

    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # One reader a worker, for all its tasks; that of an earlier model makes room.
        kept = kept_in_process("language_reader", dict)
        if own not in kept:
            kept.clear()
            kept[own] = Reader(Model(*shared.value))
        reader = kept[own]
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts], ["text"])
            found = [reader.answers(some.column(0)) for some in slices(batch, 0, SLICE)]
            yield pa.concat_arrays(found) if found else reader.answers(texts)

    # Not to be called once more for each condition on its result.
    answer = F.arrow_udf(told, ANSWER).asNondeterministic()(docs["text"].cast("string"))
    pred, score = added
    both = with_own(docs, **{pred: answer})
    return with_own(both, **{pred: both[f"`{pred}`.pred"], score: both[f"`{pred}`.score"]})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row for each document, from its text alone."""
    slim = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"))
    return tag(slim, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language_id_pred").alias("lang_pred"), F.col("language_id_score").alias("score"))


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    return predict(docs, train(docs, train_docs))
