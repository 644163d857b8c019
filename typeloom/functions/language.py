"""Prose features that need a language toolkit: words, sentences, parts of speech and stop words come from the caller.

``Toolkit`` holds Python functions of such a toolkit, run in one Arrow function; ``PLAIN`` is a
toolkit of expressions (words and sentences by patterns, no tagger), which gives other values
than a real one and is for those who opt in. Both make the same struct, and the features are
expressions over it, NULL where there is nothing to divide by.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass
from string import ascii_letters, digits, punctuation

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.functions.prose import occurrences
from typeloom.functions.stats import bind, entropy, safe_ratio

#: Characters of words and blanks one by one: Java looks a listed one up in a table, but tries ranges and \\s in turn.
IN_WORD, BLANK = f"{ascii_letters}{digits}'", r" \t\n\x0b\f\r"
#: Tags of the Penn Treebank by part of speech.
TAGS = {"noun": ("NN", "NNS", "NNP", "NNPS"), "verb": ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ"), "adj": ("JJ", "JJR", "JJS"), "adv": ("RB", "RBR", "RBS")}
READING = T.StructType([
    T.StructField("words", T.ArrayType(T.StringType())),
    T.StructField("sentence_lengths", T.ArrayType(T.IntegerType())),
    T.StructField("tags", T.ArrayType(T.StringType())),
])


@dataclass(frozen=True)
class Toolkit:
    """``words`` and ``sentences`` of a text; ``tags`` of a list of words, if there is a tagger; stop words in lower case."""

    words: Callable[[str], list[str]]
    sentences: Callable[[str], list[str]]
    stopwords: Collection[str]
    tags: Callable[[list[str]], list[str]] | None = None

    @property
    def tagged(self) -> bool:
        return self.tags is not None

    def read(self, text: Column) -> Column:
        words, sentences, tags = self.words, self.sentences, self.tags

        def told(texts: pa.Array) -> pa.Array:
            from pyspark.sql.pandas.types import to_arrow_type

            rows = []
            for text in texts.to_pylist():
                found = words(text or "")
                lengths = [len(words(s)) for s in sentences(text or "") if s.strip()]
                rows.append({"words": found, "sentence_lengths": lengths, "tags": tags(found) if tags else None})
            return pa.array(rows, type=to_arrow_type(READING))

        return F.arrow_udf(told, READING).asNondeterministic()(text)


@dataclass(frozen=True)
class PlainToolkit:
    """Words (letters, digits and apostrophes, or one other mark) and sentences (up to full stops and their like) by patterns."""

    stopwords: Collection[str] = ()
    word: str = f"[{IN_WORD}]+|[^{IN_WORD}{BLANK}]"
    sentence: str = f"[^.!?{BLANK}][^.!?]*[.!?]*"
    tagged = False

    def read(self, text: Column) -> Column:
        found = lambda t, pattern: F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))
        lengths = lambda t: F.transform(found(t, self.sentence), lambda s: F.size(found(s, self.word)))
        read = lambda t: F.struct(found(t, self.word).alias("words"), lengths(t).alias("sentence_lengths"), F.lit(None).cast("array<string>").alias("tags"))
        return bind(F.coalesce(text, F.lit("")), read)


PLAIN = PlainToolkit()


def normalised(words: Column, lowercase: bool = True, strip_punctuation: bool = True) -> Column:
    """Words as they are compared: in lower case, without marks at their edges, empty ones left out."""
    if lowercase:
        words = F.transform(words, lambda w: F.lower(w))
    if strip_punctuation:
        words = F.transform(words, lambda w: F.btrim(w, F.lit(punctuation)))
    return F.filter(words, lambda w: w != "")


def _variation(xs: Column) -> Column:
    """Sample standard deviation over mean of an array of numbers; NULL below two or at mean 0."""
    n = F.size(xs)
    sum_of = lambda f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x.cast("double")))
    about = lambda mean: safe_ratio(F.sqrt(sum_of(lambda x: (x - mean) * (x - mean)) / (n - 1)), mean)
    return F.when(n >= 2, bind(sum_of(lambda x: x) / n, about))


def language_features(reading: Column, toolkit: Toolkit | PlainToolkit, lowercase: bool = True, strip_punctuation: bool = True) -> Column:
    """A struct of the features over a struct that ``toolkit.read`` gave; part-of-speech ratios are NULL without a tagger."""
    stops = F.array(*map(F.lit, sorted(toolkit.stopwords))).cast("array<string>")

    def of_words(w: Column) -> Column:
        return bind(F.struct(w.alias("w"), occurrences(w).alias("c")), features)

    def features(v: Column) -> Column:
        w, c = v["w"], v["c"]
        tags = reading["tags"]
        some = lambda x: F.when(F.size(w) > 0, x)
        named = {
            "ttr": safe_ratio(F.size(c), F.size(w)),
            "hapax_ratio": safe_ratio(F.size(F.filter(c, lambda k: k == 1)), F.size(c)),
            "word_entropy": some(entropy(c)),
            "non_stopword_ratio": safe_ratio(F.size(F.filter(w, lambda x: ~F.array_contains(stops, x))), F.size(w)),
            "sentence_length_cv": _variation(reading["sentence_lengths"]),
        }
        named |= {f"{part}_ratio": safe_ratio(F.size(F.filter(tags, lambda t: t.isin(*TAGS[part]))), F.size(tags)) for part in TAGS}  # noqa: B023
        return F.struct(*[x.cast("double").alias(name) for name, x in named.items()])

    return bind(normalised(reading["words"], lowercase, strip_punctuation), of_words)
