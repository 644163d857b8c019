"""SimHash near-dedup by a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most three bits
differ in at most three bytes, so they share at least ``MATCHES`` = 5 positional bytes.

Index: posting lists of one positional byte hold 1/256 of all fingerprints each, too many to
pair. So a list is the intersection of the lists of four positions, for the 14 choices of four
positions whose numbers have an exclusive or of zero (``BLOCKS``; positions 0 to 7). These are
a Steiner system: of every five positions some four are such a choice, so that each pair with
five shared positional bytes meets in a list. Within a list, the shared positional bytes of a
pair are tallied; pairs with ``MATCHES`` or more are retained and verified by Hamming distance.

A list emits links that join what it found connected (a tree with up to 16 children a
node), never all pairs; linked documents stay connected, which is what components need.
Lists hold distinct fingerprints (equal ones are grouped before). A list of more than
``PAIRWISE`` entries isn't gathered: its entries are dealt out once more, to a list for each
fifth position and its byte, which again a retained pair shares. Such a list has 2 ** 24 entries
at most; beyond ``PAIRWISE`` it is linked by flooding over hub values, in linear time: x and y
differ in at most three bits if and only if some value lies within one bit of x and two of
y, or the reverse.

Components: rounds of contraction with random priorities (every vertex points to the best
of its neighbours and itself), each round written to the shared folder; then the rounds'
pointers are followed back. Hot keys meet only in joins that Spark can split.

Defined cases: null, empty and wordless texts have fingerprint zero, linked like any other;
with fewer than three words the whole sequence is the one shingle. Very long texts are hashed
in chunks of ``CHUNK`` shingles. Repeated rows share their fingerprint. A null doc_id is never
the smallest. An empty table gives no rows. Extra columns are ignored, whatever their names
(``one_of_each`` keeps them).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import discard, free_name, slices, stored, strings

SHINGLE = 3
SEED = 42
LIMIT = 3
MATCHES = 8 - LIMIT
PAIRWISE = 4096
FAN = 16
CHUNK = 1 << 15
#: Bytes of text hashed at a time.
SLICE = 8_000_000


def simhash(text: bytes) -> int:
    """64-bit fingerprint of a text's UTF-8 bytes."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < SHINGLE:
        return int.from_bytes(digest(b" ".join(words), SEED))
    led = [w + b" " for w in words]
    n, ones = len(words) - SHINGLE + 1, np.zeros(64, dtype=np.int64)
    for first in range(0, n, CHUNK):
        last = min(n, first + CHUNK)
        hashes = b"".join([digest(a + b + c, SEED) for a, b, c in zip(led[first:last], led[first + 1 : last + 1], words[first + 2 : last + 2], strict=True)])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16 if CHUNK < 1 << 16 else np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed long): a row for each document."""
    kind = dict(docs.dtypes)["doc_id"]

    def computed(batches):
        for batch in batches:
            for some in slices(batch, 2, SLICE):
                values = np.array([simhash(t or b"") for t in strings(some.column(2))], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(values.view(np.int64))], ["doc_id", "text_hash", "fp"])

    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.encode(text, "utf-8").alias("t")).mapInArrow(computed, f"doc_id {kind}, text_hash long, fp long")


def tree(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect ``order``: each entry with its parent, FAN children a node."""
    child = np.arange(1, len(order))
    return order[(child - 1) // FAN], order[child]


def shared_bytes(differing: np.ndarray) -> np.ndarray:
    """The tally: how many of the eight positional bytes are the same, from the exclusive or of two fingerprints."""
    return np.count_nonzero(np.ascontiguousarray(differing).view(np.uint8).reshape(-1, 8) == 0, axis=1)


def linked_to(values: np.ndarray, one: np.uint64) -> np.ndarray:
    """Which of ``values`` share enough positional bytes with ``one`` and are within LIMIT bits of it."""
    differing = values ^ one
    out = shared_bytes(differing) >= MATCHES
    out[out] = np.bitwise_count(differing[out]) <= LIMIT
    return out


def link_list(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of one posting list of distinct fingerprints."""
    out, left = [], np.arange(len(values))
    while len(left) > 1:
        group, left, k = [left[0]], left[1:], 0
        while k < len(group) and len(left):
            near = linked_to(values[left], values[group[k]])
            if near.any():
                group.extend(left[near])
                left = left[~near]
            k += 1
        if len(group) > 1:
            out.append(tree(values[np.array(group)]))
    return out


def _flood(values: np.ndarray, low: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Least labels spread over hubs until none changes; ``low`` fits 24 bits."""
    bits = [1 << b for b in range(24)]
    near = np.array([0, *bits], dtype=np.int64)
    wide = np.array([a | b for a, b in combinations(bits, 2)], dtype=np.int64)
    label, none = np.arange(len(low), dtype=np.int32), np.int32(1 << 30)
    while True:
        inner, outer = np.full(1 << 24, none), np.full(1 << 24, none)
        for mask in near:
            inner[low ^ mask] = np.minimum(inner[low ^ mask], label)  # low is distinct: no index twice
        for mask in wide:
            outer[low ^ mask] = np.minimum(outer[low ^ mask], label)
        new = label.copy()
        for mask in near:
            at = low ^ mask
            new = np.minimum(new, np.minimum(inner[at], outer[at]))
        for mask in wide:
            new = np.minimum(new, inner[low ^ mask])
        new = new[new]
        if (new == label).all():
            break
        label = new
    order = np.argsort(label, kind="stable")
    cuts = np.flatnonzero(np.diff(label[order])) + 1
    return [tree(values[g]) for g in np.split(order, cuts) if len(g) > 1]


BLOCKS = tuple(c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0)
#: A block and a fifth position: the lists that long lists are dealt out to.
FIFTHS = tuple((*block, p) for block in BLOCKS for p in range(8) if p not in block)


def mask_of(positions: tuple[int, ...]) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def _low_bits(values: np.ndarray, positions: tuple[int, ...]) -> np.ndarray:
    """The three bytes at the other positions, as 24 bits."""
    out = np.zeros(len(values), dtype=np.int64)
    for k, b in enumerate(b for b in range(8) if b not in positions):
        out |= (values >> np.uint64(8 * b) & np.uint64(0xFF)).astype(np.int64) << (8 * k)
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


#: What a task says of a row: a link (a, b), or a posting to deal out again (fingerprint a, list b, its number in FIFTHS).
FOUND, LINK = "kind int, a long, b long", -1


def _said(kind: int | np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    kinds = np.full(len(a), kind, dtype=np.int32) if np.isscalar(kind) else kind.astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "a", "b"])


def _said_links(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.RecordBatch]:
    if not pairs:
        return []
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    return [_said(LINK, np.minimum(a, b), np.maximum(a, b))]


def by_list(batches, most: int):
    """((fp, choice, key) arrays, long) from batches sorted by list: complete lists, several at a time, and parts of long ones.

    A list that goes on in the next batch is held. Once it has more than ``most`` rows, what is
    held of it is given out, marked as long, and so is the rest as it comes.
    """
    held, at, rows, long = [], None, 0, False
    joined = lambda: tuple(np.concatenate(x) for x in zip(*held, strict=True))
    for batch in batches:
        if not len(batch):
            continue
        new = (batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), batch.column(2).to_numpy())
        turns = (np.flatnonzero((np.diff(new[1]) != 0) | (np.diff(new[2]) != 0)) + 1).tolist()
        first = 0
        if at == (new[1][0], new[2][0]):
            first = turns[0] if turns else len(batch)
            held.append(tuple(x[:first] for x in new))
            rows += first
        if held and (first < len(batch) or rows > most):
            long = long or rows > most
            yield joined(), long
            held, rows = [], 0
        last = max(first, turns[-1] if turns else 0)
        if last > first:
            yield tuple(x[first:last] for x in new), False
        if last < len(batch):
            held, at, rows, long = [tuple(x[last:] for x in new)], (new[1][-1], new[2][-1]), len(batch) - last, False
    if held:
        yield joined(), long


def _lists(fp: np.ndarray, choice: np.ndarray, key: np.ndarray):
    """Where each of several complete lists begins and ends; lists of two are common and come together as pairs."""
    cuts = np.flatnonzero((np.diff(choice) != 0) | (np.diff(key) != 0)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fp)]))
    two = starts[ends - starts == 2]
    differing = fp[two] ^ fp[two + 1]
    two = two[(shared_bytes(differing) >= MATCHES) & (np.bitwise_count(differing) <= LIMIT)] if len(two) else two
    more = ends - starts > 2
    return (fp[two], fp[two + 1]), list(zip(starts[more].tolist(), ends[more].tolist(), strict=True))


def links(distinct: DataFrame) -> DataFrame:
    """a, b: links between fingerprints (column fp, distinct) that connect whatever is at most LIMIT bits apart."""

    def dealt(postings: DataFrame) -> DataFrame:
        return postings.repartition("choice", "key").sortWithinPartitions("choice", "key", "fp")

    def linked(batches):
        def dealt_out(fp, choice):
            for k, positions in enumerate(FIFTHS):
                if positions[:4] == BLOCKS[choice]:
                    yield _said(k, fp, fp & np.uint64(mask_of(positions)))

        for (fp, choice, key), long in by_list(batches, PAIRWISE):
            if long:
                yield from dealt_out(fp, int(choice[0]))
                continue
            pair, longer = _lists(fp, choice, key)
            pairs = [pair] if len(pair[0]) else []
            for s, e in longer:
                if e - s > PAIRWISE:
                    yield from dealt_out(fp[s:e], int(choice[s]))
                else:
                    pairs += link_list(fp[s:e])
            yield from _said_links(pairs)

    def linked_again(batches):
        for (fp, choice, key), _ in by_list(batches, 1 << 24):
            pair, longer = _lists(fp, choice, key)
            pairs = [pair] if len(pair[0]) else []
            for s, e in longer:
                pairs += link_list(fp[s:e]) if e - s <= PAIRWISE else _flood(fp[s:e], _low_bits(fp[s:e], FIFTHS[int(choice[s])]))
            yield from _said_links(pairs)

    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(mask_of(block)))) for block in BLOCKS])
    first = stored(dealt(distinct.select("fp", F.posexplode(keys).alias("choice", "key"))).mapInArrow(linked, FOUND), "links-found")
    again = first.where(F.col("kind") != LINK)
    out = first
    if not again.isEmpty():
        out = first.unionByName(dealt(again.select(F.col("a").alias("fp"), F.col("kind").alias("choice"), F.col("b").alias("key"))).mapInArrow(linked_again, FOUND))
    return out.where(F.col("kind") == LINK).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: a row for each node of ``edges`` (a, b), with the same root throughout a component."""
    spark, rounds = edges.sparkSession, []
    edges = stored(edges.where("a <> b"), "links")
    while not edges.isEmpty():
        salt = F.lit(len(rounds))
        best = lambda c: F.struct(F.xxhash64(salt, F.col(c)).alias("p"), F.col(c).alias("v"))  # noqa: E731, B023
        both = edges.select(F.col("a").alias("node"), best("b").alias("x")).unionByName(edges.select(F.col("b").alias("node"), best("a").alias("x")))
        to = both.groupBy("node").agg(F.min("x").alias("x")).select("node", F.least("x", best("node"))["v"].alias("root"))
        to = stored(to, f"pointers-{len(rounds)}")
        rounds.append(to)
        first = to.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        second = to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        half = stored(edges.join(first, "a").select("b", "ra"), "links-half")
        moved = half.join(second, "b").where("ra <> rb")
        left = stored(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        discard(edges, half)
        edges = left
    discard(edges)
    if not rounds:
        return spark.createDataFrame([], "node long, root long")
    out = rounds[-1]
    for to in reversed(rounds[:-1]):
        up = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        followed = stored(to.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
        discard(out, to)
        out = followed
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, component_id (smallest doc_id reachable), root (a fingerprint of the component): a row for each document."""
    marked = stored(fingerprints(docs), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-least")
    root = components(links(distinct.select("fp")))
    of_fp = stored(distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "fp-roots")
    discard(root, distinct)
    least = of_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(of_fp.join(least, "root").select("fp", "component_id", "root"), "fp-components")
    discard(of_fp)
    return marked.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def fingerprint_hex(fp) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all columns: of each component the one with the smallest doc_id (of repeated rows, one).

    Components are told apart by their roots: component_id is null where all doc_ids are, and a
    repeated doc_id may be the smallest of several.
    """
    found = stored(near_duplicates(docs), "near-duplicates")
    # Of several rows under the smallest doc_id, the least text hash: one key a component.
    key = F.struct(F.col("doc_id").isNull(), "doc_id", F.coalesce("text_hash", F.lit(0)).alias("h"))
    rows = found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    chosen = stored(rows.groupBy("root").agg(F.min(F.struct(key.alias("key"), "n")).alias("x")).select("x.key.doc_id", "x.key.h", "x.n"), "chosen")
    discard(found)
    own, hashed = free_name("simhash_id", docs), free_name("simhash_text", docs)
    names = chosen.select(F.col("doc_id").alias(own), F.col("h").alias(hashed))
    stay = docs.join(names, docs["doc_id"].eqNullSafe(names[own]) & (F.xxhash64(docs["text"].cast("string")) == names[hashed]), "left_semi")
    # Only where a chosen row is repeated do whole rows have to meet once more.
    return stay if chosen.where("n > 1").isEmpty() else stay.dropDuplicates(["doc_id", "text"])
