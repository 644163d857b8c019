"""Lexical and structural features of prose and of lines over a text column.

Each family is one struct, built from words, sentences or lines that are found once a row. The
families have 0.0 on empty; the registered forms (``registered_lines``) have NULL there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from string import ascii_lowercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.functions.stats import bind, entropy

#: Fixed values.
SPECIAL_CHARACTERS = "()<>%—{}[]/#̃+-*=$ˆ&"
PUNCTUATION = "\",.?!:;'"
FUNCTION_WORDS = """a about above after all although am among an and another any anybody anyone anything are around as at be because before behind below beside between both but by can cos do down each either enough every everybody everyone everything few following for from have he her him i if in including inside into is it its latter less like little lots many me more most much must my near need neither no nobody none nor nothing of off on once one onto opposite or our outside over own past per plenty plus regarding same several she should since so some somebody someone something such than that the their them these they this those though through till to toward towards under unless unlike until up upon us used via we what whatever when where whether which while who whoever whom whose will with within without worth would yes you your""".split()
WORD = f"[{ascii_lowercase}]+(?:'[{ascii_lowercase}]+)?"  # letters one by one: Java looks them up in a table
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
NOT_SPACE = r"[^\s\p{Z}\x1c-\x1f\x85]"


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def chars(t: Column, spaced: bool = False) -> Column:
    """Characters; with ``spaced``, a run of four blanks counts once (code)."""
    return F.length(F.replace(t, F.lit("    "), F.lit("\t")) if spaced else t)


def total_characters(t: Column, response_type: str) -> Column:
    if response_type not in ("code", "explanation"):
        raise ValueError(f"unknown response type {response_type!r}")
    return chars(t, spaced=response_type == "code").cast("long")


def class_ratio(t: Column, pattern: str) -> Column:
    return ratio(F.regexp_count(t, F.lit(pattern)), F.length(t))


def words(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(f"({WORD})"), F.lit(1))


def sentences(t: Column) -> Column:
    """Trimmed, not empty parts between runs of full stops, exclamation and question marks."""
    some = F.filter(F.split(t, "[.!?]+"), lambda s: s.rlike(NOT_SPACE))
    return F.transform(some, lambda s: F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", ""))


def lines(t: Column) -> Column:
    """Lines as Python's splitlines gives them."""
    ended = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return bind(F.split(t, LINE_BREAKS, -1), ended)


def line_kind(s: Column) -> Column:
    return F.when(~s.rlike(NOT_SPACE), F.lit("BLANK")).when(s.rlike(f"^{SPACE}*#"), F.lit("COMMENT")).otherwise(F.lit("CODE"))


def line_kinds(t: Column) -> Column:
    return F.transform(lines(t), line_kind)


def of_kind(kinds: Column, kind: str) -> Column:
    return F.size(F.filter(kinds, lambda k: k == kind)).cast("long")


def occurrences(xs: Column) -> Column:
    """Counts of the distinct values of an array of strings, by runs of the sorted array."""
    runs = lambda s: F.filter(F.transform(s, lambda w, i: F.when((i == F.size(s) - 1) | (F.get(s, i + 1) != w), i + 1)), lambda i: i.isNotNull())
    gaps = lambda e: F.transform(e, lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.get(e, i - 1)))
    return bind(F.sort_array(xs), lambda s: bind(runs(s), gaps))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def _lengths(xs: Column) -> Column:
    return _total(F.transform(xs, lambda x: F.length(x)))


def word_features(t: Column) -> Column:
    """A struct of word, sentence and character features; ``t`` must not be null."""

    def counted(v: Column) -> Column:
        more = F.struct(occurrences(v["w"]).alias("c"), _lengths(v["w"]).alias("letters"), F.size(v["w"]).cast("long").alias("n"))
        return bind(more, lambda x: features(v, x))

    def features(v: Column, x: Column) -> Column:
        n, size, w, s, c = x["n"], F.length(v["t"]).cast("long"), v["w"], v["s"], x["c"]
        squares = _total(F.transform(c, lambda k: k.cast("long") * k))
        named = {
            "total_word_count": n,
            "short_word_ratio": ratio(F.size(F.filter(w, lambda y: F.length(y) < 4)), n),
            "word_character_ratio": ratio(x["letters"], size),
            "average_word_length": ratio(x["letters"], n),
            "word_diversity": ratio(F.size(c), n),
            "hapax_ratio": ratio(F.size(F.filter(c, lambda y: y == 1)), n),
            "word_entropy": F.coalesce(entropy(c), F.lit(0.0)),
            "yules_k": ratio(F.lit(10000.0) * (squares - n), n.cast("double") * n),
            "total_sentence_count": F.size(s).cast("long"),
            "average_sentence_length_characters": ratio(_lengths(s), F.size(s)),
            "average_sentence_length_words": ratio(n, F.size(s)),
            "total_characters": size,
            "alphabetic_character_ratio": class_ratio(v["t"], r"\p{L}"),
            "uppercase_character_ratio": class_ratio(v["t"], r"\p{Lu}"),
            "digit_character_ratio": class_ratio(v["t"], r"\p{Nd}"),
        }
        return F.struct(*[value.alias(name) for name, value in named.items()])

    return bind(F.struct(t.alias("t"), words(t).alias("w"), sentences(t).alias("s")), counted)


def line_features(t: Column) -> Column:
    """A struct of line and tab features; ``t`` must not be null."""

    def kinds(v: Column) -> Column:
        return bind(F.transform(v["lines"], line_kind), lambda k: features(v, k))

    def features(v: Column, k: Column) -> Column:
        total = F.size(v["lines"]).cast("long")
        spaces = F.regexp_count(v["t"], F.lit(" {4}")).cast("long")
        tabs = (F.length(v["t"]) - F.length(F.replace(v["t"], F.lit("\t"), F.lit("")))).cast("long") + spaces
        blank, comment, code = (of_kind(k, x) for x in ("BLANK", "COMMENT", "CODE"))
        named = {
            "total_line_count": total,
            "blank_line_count": blank,
            "pure_comment_line_count": comment,
            "blank_line_ratio": ratio(blank, total),
            "comment_line_ratio": ratio(comment, total),
            "comment_to_code_ratio": F.try_divide(comment.cast("double"), code.cast("double")),
            "total_characters": chars(v["t"], spaced=True).cast("long"),
            "four_space_tab_count": spaces,
            "tab_count": tabs,
            "tab_character_ratio": ratio(tabs, chars(v["t"], spaced=True)),
            "average_line_length_characters": ratio(_total(F.transform(v["lines"], lambda s: chars(s, spaced=True))), total),
        }
        return F.struct(*[value.alias(name) for name, value in named.items()])

    return bind(F.struct(t.alias("t"), lines(t).alias("lines")), kinds)


def registered_lines(t: Column) -> Column:
    """A struct of the registered line features: NULL, not 0.0, where there are no lines (or, for the last, no code)."""

    def features(k: Column) -> Column:
        share = lambda kind, of: F.try_divide(of_kind(k, kind).cast("double"), of.cast("double"))
        return F.struct(
            share("COMMENT", F.size(k)).alias("comment_density"),
            share("BLANK", F.size(k)).alias("blank_line_ratio"),
            share("COMMENT", of_kind(k, "CODE")).alias("comment_to_code_ratio"),
        )

    return bind(line_kinds(F.coalesce(t, F.lit(""))), features)


def question_means(df: DataFrame, by: list[str], **features: Column) -> DataFrame:
    """Means of text features over all answers of a participant (or whatever ``by`` says), one row each."""
    return df.groupBy(*by).agg(*[F.avg(c.cast("double")).alias(name) for name, c in features.items()])


def tally(t: Column, count: Callable[[str], list[int]]) -> Column:
    """array<int>: what ``count`` gives for each text, by one Arrow function; its items cost no pass over arrays each."""

    def told(texts: pa.Array) -> pa.Array:
        return pa.array(map(count, texts.to_pylist()), pa.list_(pa.int32()))

    return F.arrow_udf(told, "array<int>").asNondeterministic()(t)


def distribution(t: Column, kind: str) -> Column:
    """array<struct<item string, share double>> of a fixed set of items; ``t`` must not be null."""
    share = lambda item, count, total: F.struct(F.lit(item).alias("item"), ratio(count, total).alias("share"))
    items = {"letter": ascii_lowercase, "special": SPECIAL_CHARACTERS, "punctuation": PUNCTUATION, "word_length": range(1, 21), "function_word": FUNCTION_WORDS}.get(kind)
    if items is None:
        raise ValueError(kind)

    def of_characters(text: str) -> list[int]:
        return [text.count(c) for c in items]

    def of_words(text: str) -> list[int]:
        found = re.findall(WORD, text)
        n = Counter(map(len, found) if kind == "word_length" else found)
        return [*[n[x] for x in items], len(found)]

    if kind in ("word_length", "function_word"):
        counts = tally(F.lower(t), of_words)
    else:
        counts = F.array_append(tally(F.lower(t) if kind == "letter" else t, of_characters), F.length(t))
    return bind(counts, lambda n: F.array(*[share(str(x), n[k], n[len(items)]) for k, x in enumerate(items)]))
