"""Packing: optimal length buckets, then batches of a fixed token budget inside each.

1. The global histogram of lengths (number of documents by length, partial sums on the
   executors) comes to the driver, a row for each different length. m different lengths
   take m * (m + 1) / 2 tokens at least, so its size is at most the root of twice the
   tokens (100,000 rows for 5 billion tokens), whatever the number of documents.
2. Dynamic programming over that histogram, linear in its size, chooses ``n_buckets`` upper
   lengths that minimise the padding in all, exactly. An upper length is a document's.
3. Inside a bucket of upper length L a batch holds max(1, budget // L) documents. Rows are
   numbered within a bucket without one task seeing the whole bucket: documents are dealt
   to salts by a hash, numbered within (bucket, salt), and shifted by the prefix sums of
   the salts' counts.

Defined cases: null or empty texts have the end token only (length 1). A document longer
than the budget makes a batch of its own. Repeated rows are rows like any other; their
numbers are given in any order among themselves. A null doc_id is a value like any other. A very
long text is one row. Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeloom.llm.common import BLANK_CLASS, stored, whole_text

N_BUCKETS = 16
BUDGET = 65_536
#: Documents in a salt, about: the rows that one task sorts.
SALT_ROWS = 50_000


def word_tokens(text: Column) -> Column:
    """Words plus one end token."""
    return (F.regexp_count(text, F.lit(f"[^{BLANK_CLASS[1:]}+")) + 1).cast("long")


def optimal_buckets(lengths, counts, n_buckets: int) -> list[int]:
    """Upper lengths of at most ``n_buckets`` buckets with the least padding in all.

    cost(i, j) = sum of counts[i..j] * (lengths[j] - lengths) is found from prefix sums n and s;
    best[b][j] = min over i of best[b-1][i] + cost(i + 1, j) is lengths[j] * n[j] - s[j] plus the
    least of the lines best[b-1][i] + s[i] - n[i] * lengths[j]. Their slopes fall with i and
    lengths rises, so a queue of the lines that can still be least makes each b linear in time.
    """
    x, c = [int(v) for v in lengths], [int(v) for v in counts]
    m = len(x)
    n, s = [0, *accumulate(c)], [0, *accumulate(a * b for a, b in zip(x, c, strict=True))]
    best, back = [0] + [None] * m, []
    for _ in range(min(n_buckets, m)):
        new, arg, lines, first = [0] * (m + 1), [0] * (m + 1), [], 0
        for j in range(1, m + 1):
            if best[j - 1] is not None:
                k, d = best[j - 1] + s[j - 1], n[j - 1]
                while len(lines) - first > 1:
                    (k1, d1, _), (k2, d2, _) = lines[-2:]
                    if (k - k1) * (d2 - d1) > (k2 - k1) * (d - d1):
                        break
                    lines.pop()
                lines.append((k, d, j - 1))
            at = x[j - 1]
            while len(lines) - first > 1 and lines[first + 1][0] - lines[first + 1][1] * at < lines[first][0] - lines[first][1] * at:
                first += 1
            k, d, arg[j] = lines[first]
            new[j] = at * n[j] - s[j] + k - d * at
        best = new
        back.append(arg)
    ends, j = [], m
    for arg in reversed(back):
        if j == 0:
            break
        ends.append(x[j - 1])
        j = arg[j]
    return sorted(set(ends))


def pack(docs: DataFrame, n_buckets: int = N_BUCKETS, budget: int = BUDGET, tokens: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch, slot, padding: a row for each document.

    ``tokens``: the length of a document, words plus one unless given.
    """
    spark = docs.sparkSession
    length = word_tokens(whole_text(docs)) if tokens is None else tokens
    sized = stored(docs.select(docs["doc_id"].alias("doc_id"), length.cast("long").alias("n_tokens")), "pack-lengths")
    histogram = sized.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").collect()  # see above for its size
    uppers = optimal_buckets([r.n_tokens for r in histogram], [r.n for r in histogram], n_buckets)
    if not uppers:
        return spark.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, bucket int, bucket_len long, batch long, slot int, padding long")
    bucket = F.lit(len(uppers) - 1)
    for k in range(len(uppers) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= uppers[k], k).otherwise(bucket)
    salts = max(1, -(-sum(r.n for r in histogram) // SALT_ROWS))
    salted = sized.withColumn("bucket", bucket.cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(salts)).cast("int"))
    dealt = F.element_at(F.array(*map(F.lit, uppers)), F.col("bucket") + 1).cast("long")
    # Prefix sums of the salts' counts: a row for each bucket and salt, n / SALT_ROWS of them a bucket.
    counts = salted.groupBy("bucket", "salt").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("bucket").alias("b"), F.col("salt").alias("s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = salted.withColumn("k", F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("doc_id", "n_tokens")) - 1)
    placed = numbered.join(before, (F.col("bucket") == F.col("b")) & (F.col("salt") == F.col("s")))
    rank = F.col("before") + F.col("k")
    placed = placed.withColumn("bucket_len", dealt).withColumn("rank", rank).withColumn("size", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len"))))
    return placed.select(
        "doc_id", "n_tokens", "bucket", "bucket_len",
        F.floor(F.col("rank") / F.col("size")).cast("long").alias("batch"),
        F.pmod("rank", "size").cast("int").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
