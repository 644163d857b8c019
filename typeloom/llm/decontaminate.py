"""Benchmark decontamination by spaced-seed hashing.

``SEEDS`` are fixed masks over a window of tokens: a 1 is a token that counts, a 0 one
that is ignored, so a hash survives substitutions at ignored positions. Each seed has five
counting tokens. Steps, all DataFrame operations:

1. Benchmark items give an index row for each seed and position: the hash, the item, the
   position, and the item's words within ``SPAN`` of the seed, never the whole item. The index
   is written once and its rows and bytes are counted.
2. A bitmap is folded from the index, of a long or more for each row of it (up to
   2 ** MAX_WORD_BITS longs; two bits are set by each hash), and reaches the documents as an
   uncorrelated scalar subquery. In one pass over the documents, every position's hashes are
   looked up in it; only positions that pass go on, with a slice of at most 2 * SPAN tokens
   around them. The bitmap only spares work: a hash of the index always passes, whatever the
   index's size.
3. The remaining positions join the index on the hash, an equality join.
4. Each hit is verified on the tokens: along the hit's diagonal, some window of
   min(SPAN, item length) tokens that holds the seed must agree in ``threshold`` of its
   tokens. Tokens are compared in place, so substitutions cost one token each.

The index is broadcast only if it takes at most ``BROADCAST_BYTES``, as counted; beyond that
Spark shuffles both sides, and splits skewed keys.

Defined cases: null or empty texts or items match nothing; an item or a document shorter
than the shortest seed matches nothing. A very long text is one row, of which only the slices
around hits leave the scan. Repeated documents each count for their doc_id; repeated items are
found under each item_id. Either table may be empty: no rows. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import bind, free_name, plain_words_of, stored, whole_text

#: Five counting tokens each; between them they survive every fourth, fifth or sixth token being replaced.
SEEDS = ("111101", "111011", "1101101")
SPAN = 20
#: Longs of the bitmap, as powers of two: the least and the most (8 MB).
MIN_WORD_BITS, MAX_WORD_BITS = 10, 20
BROADCAST_BYTES = 32_000_000
#: Bytes of an index row besides its words.
ROW_BYTES = 64


def _seed_hash(h: Column, i: Column, k: int) -> Column:
    """Hash of seed ``k`` at the 1-based position ``i`` of the token hashes ``h``."""
    return F.xxhash64(F.lit(k), *[F.element_at(h, i + j) for j, c in enumerate(SEEDS[k]) if c == "1"])


def _places(h: Column, k: int) -> Column:
    n = F.size(h) - (len(SEEDS[k]) - 1)
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _bits(h: Column, word_bits: int) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """Two (word, bit) places of a hash in a bitmap of 2 ** word_bits longs."""
    word = lambda x: F.shiftrightunsigned(x, 64 - word_bits).cast("int")
    bit = lambda x: x.bitwiseAND(F.lit(63)).cast("int")
    return (word(h), bit(h)), (word(F.shiftleft(h, 24)), bit(F.shiftrightunsigned(h, 6)))


def _first_around(i: Column, k: int) -> Column:
    """First of the at most 2 * SPAN tokens that windows over seed ``k`` at ``i`` reach."""
    return F.greatest(i - (SPAN - len(SEEDS[k])), F.lit(1))


def seed_index(benchmark: DataFrame) -> DataFrame:
    """seed_hash, item_id, and x: item words around the seed, place of the seed in them, its span, width of the windows."""
    items = benchmark.select(benchmark["item_id"].alias("item_id"), plain_words_of(whole_text(benchmark)).alias("w"))
    hashed = items.select("item_id", "w", F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    w, h = F.col("w"), F.col("h")

    def row(i: Column, k: int) -> Column:
        first = _first_around(i, k)
        return F.struct(
            _seed_hash(h, i, k).alias("seed_hash"),
            F.slice(w, first, i - first + SPAN).alias("item"),
            (i - first + 1).alias("place"),
            F.lit(len(SEEDS[k])).alias("span"),
            F.least(F.lit(SPAN), F.size(w)).alias("width"),
        )

    of_seed = lambda k: F.transform(_places(h, k), lambda i: row(i, k))
    rows = F.concat(*[of_seed(k) for k in range(len(SEEDS))])
    return hashed.select("item_id", F.explode(rows).alias("x")).select("x.seed_hash", "item_id", "x.item", "x.place", "x.span", "x.width")


def bitmap_bits(rows: int) -> int:
    """The power of two of longs that gives each index row one of them, within the bounds."""
    return min(MAX_WORD_BITS, max(MIN_WORD_BITS, rows.bit_length()))


def _bitmap(index: DataFrame, word_bits: int) -> DataFrame:
    """One row: an array of longs with both bits of every hash set."""
    both = F.array(*[F.struct(w.alias("w"), b.alias("b")) for w, b in _bits(F.col("seed_hash"), word_bits)])
    words = index.select(F.explode(both).alias("p")).groupBy("p.w").agg(F.bit_or(F.expr("shiftleft(1L, p.b)")).alias("v"))
    blank = index.sparkSession.range(1 << word_bits).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("v"))
    whole = words.unionByName(blank).groupBy("w").agg(F.bit_or("v").alias("v"))
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("bitmap"))


def _passing(words: Column, bitmap: Column, word_bits: int) -> Column:
    """(hash, tokens around, place in them) of the positions whose hash is in the bitmap."""

    def known(value: Column) -> Column:
        (w1, b1), (w2, b2) = _bits(value, word_bits)
        return (F.getbit(F.get(bitmap, w1), b1) == 1) & (F.getbit(F.get(bitmap, w2), b2) == 1)

    def of_seed(h: Column, k: int) -> Column:
        hashes = F.transform(_places(h, k), lambda i: _seed_hash(h, i, k))
        spots = bind(hashes, lambda x: F.filter(F.transform(x, lambda v, i: F.when(known(v), i + 1)), lambda i: i.isNotNull()))

        def around(i: Column) -> Column:
            first = _first_around(i, k)
            return F.struct(_seed_hash(h, i, k).alias("seed_hash"), F.slice(words, first, i - first + SPAN).alias("near"), (i - first + 1).alias("at"))

        return F.transform(spots, around)

    return bind(F.transform(words, lambda x: F.xxhash64(x)), lambda h: F.concat(*[of_seed(h, k) for k in range(len(SEEDS))]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, agreement (best share of agreeing tokens), n_hits: a row for each document and item that overlap."""
    index = stored(seed_index(benchmark), "seed-index")
    size = F.aggregate("item", F.lit(ROW_BYTES).cast("long"), lambda a, w: a + F.octet_length(w) + 16)
    n_rows, n_bytes = index.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    word_bits = bitmap_bits(n_rows)
    rows = docs.select(docs["doc_id"].alias("doc_id"), plain_words_of(whole_text(docs)).alias("w")).withColumn("bitmap", _bitmap(index, word_bits).scalar())
    passing = bind(F.struct("w", "bitmap"), lambda v: _passing(v["w"], v["bitmap"], word_bits))
    spots = rows.select("doc_id", F.explode(passing).alias("s")).select("doc_id", "s.*")
    hits = spots.join(F.broadcast(index) if n_bytes <= BROADCAST_BYTES else index, "seed_hash")
    judged = hits.select("doc_id", "item_id", bind(F.struct("near", "at", "item", "place", "span", "width"), _agreement).alias("agreement"))
    kept = judged.where(F.col("agreement") >= threshold)
    return kept.groupBy("doc_id", "item_id").agg(F.max("agreement").alias("agreement"), F.count("*").alias("n_hits"))


def _agreement(x: Column) -> Column:
    """Best share of agreeing tokens over windows of the hit's diagonal that hold the seed."""
    near, at, item, place, span, width = (x[c] for c in ("near", "at", "item", "place", "span", "width"))
    shift = at - place  # item position p lies at p + shift in ``near``
    low = F.greatest(place + span - width, F.lit(1), F.lit(1) - shift)
    high = F.least(place + width - 1, F.size(item), F.size(near) - shift)
    starts = F.when(high - width + 1 >= low, F.sequence(low, high - width + 1)).otherwise(F.array().cast("array<int>"))
    same = lambda p: F.element_at(item, p) == F.element_at(near, p + shift)
    agree = lambda s: F.size(F.filter(F.sequence(s, s + width - 1), same)) / width
    return F.coalesce(F.array_max(F.transform(starts, agree)), F.lit(0.0))


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents, all columns, without those whose own text overlaps an item.

    Rows are told apart by doc_id (a null one is a value) and two hashes of the text, so that
    other texts under a leaky row's doc_id stay.
    """
    text = docs["text"].cast("string")
    hashes = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    keyed = docs.select(F.struct(docs["doc_id"].alias("id"), hashes[0].alias("h1"), hashes[1].alias("h2")).alias("doc_id"), text.alias("text"))
    own = {c: free_name(f"leaky_{c}", docs) for c in ("id", "h1", "h2")}
    leaks = find_leaks(keyed, benchmark, threshold).select(*[F.col(f"doc_id.{c}").alias(own[c]) for c in own]).distinct()
    same = docs["doc_id"].eqNullSafe(leaks[own["id"]]) & (hashes[0] == leaks[own["h1"]]) & (hashes[1] == leaks[own["h2"]])
    return docs.join(leaks, same, "left_anti")
