"""Quality rules by distribution divergence.

A document's histogram over character classes and its histogram over common words are
compared with references of each language: the sums of the same histograms over all
documents of that language, or their median. The distance is Jensen-Shannon's (square root of the
divergence in bits, 0 to 1). A document is measured against the language whose two
distances have the least sum, and fails if either exceeds its limit. Guards: the character
distance counts from ``MIN_CHARS`` characters on and the word distance from ``MIN_WORDS``
words on; shorter documents are too few draws for it and aren't rejected by it.

One pass over the texts (no Python, no shuffle of texts) gives slim rows of counts, which
are written once to the shared folder; the references are sums over these rows by language
and bin, for every language. Up to ``MAX_LANGS`` languages they come into the second plan as
literals of bounded size, more as a scalar subquery's array of 44 numbers a language.

Base counts: see ``base_counts``. Defined cases: null and empty texts have no words and
fail the base rule; null languages add to no reference; with no reference at all only the
base rule counts. Of languages with the same sum of distances the one with the lesser character
distance is nearest, then the first in alphabetical order. A very long text is one row like any
other. Repeated rows each give their row; an empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import BLANKS, bind, stored, whole_text, words_of

MIN_CHARS = 150
MIN_WORDS = 50
CHAR_LIMIT = 0.2
WORD_LIMIT = 0.29
MAX_LANGS = 64
WINDOW = 8

#: Frequent function words of four languages.
COMMON = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "ist", "ein",
    "de", "la", "le", "et", "les", "des", "en", "un", "que", "pour",
    "el", "y", "los", "las", "por", "con",
)

#: Character classes in the order in which they are taken out of a text; what is left is "other".
#: The first also takes the spaces, which makes its runs long; they are counted apart.
CLASSES = (r"[\p{Ll} ]+", r"[\x09-\x0D]+", r"\p{Lu}+", r"\p{Nd}+", r"[.,;:?'\"()-]+", r"!+", r"[#*$%&|<>]+")
BLANK, SYMBOL = 1, 6


def _sum(xs: Column, zero: Column | None = None) -> Column:
    return F.aggregate(xs, F.lit(0.0) if zero is None else zero, lambda a, x: a + x)


def class_counts(text: Column, classes=CLASSES) -> Column:
    """Code points of each class, then of none; each class is counted in what the classes before left."""
    if not classes:
        return F.array(F.length(text).cast("long"))
    rest = F.regexp_replace(text, classes[0], "")
    counted = lambda v: F.concat(F.array((F.length(v["t"]) - F.length(v["r"])).cast("long")), class_counts(v["r"], classes[1:]))
    return bind(F.struct(text.alias("t"), rest.alias("r")), lambda v: F.when(v["r"] == "", F.array((F.length(v["t"])).cast("long"), *[F.lit(0).cast("long")] * len(classes))).otherwise(counted(v)))


def common_counts(words: Column) -> Column:
    """Counts of each common word (in lower case or capitalised), then of all other words.

    The common words are joined, each between two blanks, and counted by what taking one out shortens.
    """
    both = [x for w in COMMON for x in (w, w.capitalize())]
    spelt = F.concat(F.lit(" "), F.lower(F.array_join(F.filter(words, lambda w: w.isin(*both)), "  ")), F.lit(" "))
    times = lambda s, w: ((F.length(s) - F.length(F.replace(s, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long")
    each = bind(spelt, lambda s: F.array(*[times(s, w) for w in COMMON]))
    return bind(each, lambda c: F.concat(c, F.array(F.size(words) - _sum(c, F.lit(0).cast("long")))))


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words that lie in a ``size``-word window found twice or more, the first one included."""

    def of_windows(g: Column) -> Column:
        n = F.size(g)

        def covered(places: Column) -> Column:
            gaps = F.transform(F.sequence(F.lit(1), F.size(places) - 1), lambda k: F.least(F.lit(size), F.get(places, k) - F.get(places, k - 1)).cast("long"))
            return _sum(gaps, F.lit(size).cast("long"))

        def of_sorted(s: Column) -> Column:
            same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
            twice = F.filter(F.sequence(F.lit(0), n - 1), lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
            return bind(F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"])), covered)

        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == n, F.lit(0).cast("long")).otherwise(bind(pairs, of_sorted))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (size - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(size)]))
    return F.when(F.size(words) <= size, F.lit(0).cast("long")).otherwise(bind(bind(hashes, windows), of_windows))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars, commons."""
    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(docs["doc_id"].alias("doc_id"), lang.alias("lang"), whole_text(docs).alias("t"))
    t = F.col("t")

    def counts(v: Column) -> Column:
        spaces = (F.length(v["t"]) - F.length(F.replace(v["t"], F.lit(" "), F.lit("")))).cast("long")
        return F.struct(
            F.size(v["w"]).cast("long").alias("n_words"),
            (F.length(v["t"]) - spaces - F.get(v["c"], BLANK)).alias("word_chars"),
            F.get(v["c"], SYMBOL).alias("n_symbols"),
            bind(lines_of(v["t"]), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(v["w"]).alias("n_repeat_words"),
            F.concat(F.array(F.get(v["c"], 0) - spaces, spaces), F.slice(v["c"], 2, len(CLASSES))).alias("chars"),
            common_counts(v["w"]).alias("commons"),
        )

    def lines_of(text: Column) -> Column:
        return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    return rows.select("doc_id", "lang", bind(F.struct(t.alias("t"), words_of(t).alias("w"), class_counts(t).alias("c")), counts).alias("c")).select("doc_id", "lang", "c.*")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of probabilities."""

    def term(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        half = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0)) / 2
        return half(a) + half(b)

    return F.sqrt(F.greatest(_sum(F.zip_with(p, q, term)), F.lit(0.0)))


def shares(counts: Column) -> Column:
    return bind(F.greatest(_sum(F.transform(counts, lambda x: x.cast("double"))), F.lit(1.0)), lambda n: F.transform(counts, lambda x: x / n))


def reference_bins(counted: DataFrame) -> DataFrame:
    """lang, kind (0: character classes, 1: common words), bin, x: a row for each bin of each language.

    Character classes: the median of the documents' shares, which a minority of junk doesn't move.
    Common words: their sums.
    """
    known = counted.where(F.col("lang").isNotNull())
    chars = known.select("lang", F.posexplode(shares(F.col("chars"))).alias("bin", "x")).groupBy("lang", "bin").agg(F.percentile_approx("x", 0.5, 1000).alias("x"))
    words = known.select("lang", F.posexplode("commons").alias("bin", "x")).groupBy("lang", "bin").agg(F.sum("x").cast("double").alias("x"))
    return chars.select("lang", F.lit(0).alias("kind"), "bin", "x").unionByName(words.select("lang", F.lit(1).alias("kind"), "bin", "x"))


def references(counted: DataFrame) -> Column | None:
    """An array of (lang, c, w) over every language: shares of character classes and of common words, scaled to a sum of 1.

    None without a language. Up to MAX_LANGS languages are literals, more a scalar subquery.
    """
    bins = stored(reference_bins(counted), "quality-references")
    n = bins.select("lang").distinct().count()
    if n == 0:
        return None
    if n > MAX_LANGS:
        ordered = bins.groupBy("lang", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "x"))), lambda b: b["x"]).alias("xs"))
        scaled = ordered.select("lang", "kind", bind(F.col("xs"), lambda xs: bind(_sum(xs), lambda t: F.transform(xs, lambda x: x / F.when(t == 0, 1.0).otherwise(t)))).alias("xs"))
        whole = scaled.groupBy("lang").agg(F.max(F.when(F.col("kind") == 0, F.col("xs"))).alias("c"), F.max(F.when(F.col("kind") == 1, F.col("xs"))).alias("w"))
        return whole.agg(F.array_sort(F.collect_list(F.struct("lang", "c", "w")))).scalar()
    found: dict[str, tuple[list[float], list[float]]] = {}
    for r in bins.orderBy("lang", "kind", "bin").collect():  # MAX_LANGS times the bins
        found.setdefault(r.lang, ([], []))[r.kind].append(r.x)
    share = lambda xs: F.array(*[F.lit(x / (sum(xs) or 1.0)) for x in xs])
    return F.array(*[F.struct(F.lit(lang).alias("lang"), share(c).alias("c"), share(w).alias("w")) for lang, (c, w) in sorted(found.items())])


def judge(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """doc_id, base counts, base_failed, kept, nearest_lang, char_distance, word_distance: a row for each document."""
    counted = stored(base_counts(docs), "quality-counts")
    refs = references(counted)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    if refs is not None:

        def nearest(v: Column) -> Column:
            scored = F.transform(v["every"], lambda r: F.struct(js_distance(v["c"], r["c"]).alias("c"), js_distance(v["w"], r["w"]).alias("w"), r["lang"].alias("lang")))
            return F.array_min(F.transform(scored, lambda s: F.struct((s["c"] + s["w"]).alias("sum"), s["c"].alias("c"), s["w"].alias("w"), s["lang"].alias("lang"))))

        near = bind(F.struct(shares(F.col("chars")).alias("c"), shares(F.col("commons")).alias("w"), F.col("every")), nearest)
    else:
        near = F.lit(None).cast("struct<sum:double,c:double,w:double,lang:string>")
    odd_chars = (F.col("near.c") > char_limit) & (_sum(F.col("chars"), F.lit(0).cast("long")) >= MIN_CHARS)
    far = odd_chars | ((F.col("near.w") > word_limit) & (F.col("n_words") >= MIN_WORDS))
    out = (counted if refs is None else counted.withColumn("every", refs)).withColumn("near", near).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"),
        F.col("near.lang").alias("nearest_lang"), F.col("near.c").alias("char_distance"), F.col("near.w").alias("word_distance"),
    )
