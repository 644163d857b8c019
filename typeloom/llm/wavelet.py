"""Token-ID output: a wavelet matrix for each shard, in one compressed file.

File layout (little-endian): ``WVMX1\\0``, an unsigned 32-bit header length, a JSON header,
then the sections that the header gives by offset and length. A shard is a sequence of
token ids. Level by level, from the highest bit down, the plane of that bit is stored and
the sequence is stably parted, zeros first. Planes are cut into blocks of ``BLOCK`` bits;
each block is compressed by itself (zstandard) and the header's directory has every block's
place and the number of ones before it, so rank, select, access, counting and occurrence
look-up read only the blocks that they need. The documents' ids and lengths make one more
compressed section, followed by a crc of all ids.

Distributed writing: documents are range-partitioned by doc_id and sorted by it and a hash of
the text; a task encodes its documents and writes a file for about every ``SHARD_TOKENS`` ids,
under a name that follows from the partition and its own sequence number. Files are written
under a temporary name and renamed, and rows that tie in the order are the same, so a repeated
task replaces a file by the same bytes. The folder's file system is settled on the driver.
Prefix sums over the files' counts give every document's start.

Encoding: a tokenizer that splits at white space gives the same ids for a text as for its
white-space separated words one by one; distinct words are encoded by the library and
kept in the worker (about ``MAX_WORDS`` of them), in one flat array.

Defined cases: null and empty texts have the end id only. Null doc_ids come first. Rows under
one doc_id come by the hash of their texts (null first). Repeated rows are documents of their
own. Very long texts lie in one file, whatever their length. An empty table writes no file.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import io
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeloom.llm.common import bytes_of, kept_in_process, scratch, slices, stored, strings, taken, totals, word_codes

MAGIC = b"WVMX1\0"
BLOCK = 1 << 17
#: ids after which a file is closed: some 8 MB.
SHARD_TOKENS = 1 << 23
MAX_WORDS = 1_200_000
#: Bytes of text encoded at a time.
SLICE = 12_000_000
#: A run of these at the end of a word is looked up by itself.
MARKS = ".,;:!?#*$%&|<>"
#: Words encoded as one text.
TOGETHER = 1000
END_ID = 1


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The file of a shard: ``ids`` of all its documents, one after the other."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    press = zstandard.ZstdCompressor(level=1)
    narrow = np.uint16 if levels <= 16 else np.uint32
    body, planes, rest = io.BytesIO(), [], ids.astype(narrow)
    for level in range(levels - 1, -1, -1):
        bits = (rest & narrow(1 << level)) != 0
        blocks, ones = [], 0
        for first in range(0, len(bits), BLOCK):
            part = bits[first : first + BLOCK]
            data = press.compress(np.packbits(part).tobytes())
            blocks.append([body.tell(), len(data), ones])
            body.write(data)
            ones += int(np.count_nonzero(part))
        planes.append({"zeros": len(ids) - ones, "blocks": blocks})
        rest = np.concatenate((np.compress(~bits, rest), np.compress(bits, rest)))
    docs = press.compress(json.dumps(doc_ids).encode() + b"\n" + np.asarray(lengths, dtype="<u8").tobytes())
    at = body.tell()
    body.write(docs)
    head = json.dumps({"tokens": len(ids), "docs": len(doc_ids), "levels": levels, "planes": planes, "documents": [at, len(docs)], "crc32": zlib.crc32(ids.astype("<u4").tobytes())}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + body.getvalue()


class WaveletMatrix:
    """Queries on a shard's file; blocks are opened when they are needed."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (n,) = struct.unpack_from("<I", data, len(MAGIC))
        start = len(MAGIC) + 4
        self.head = json.loads(data[start : start + n])
        self.data, self.base = memoryview(data), start + n
        self.n, self.levels, self.planes = self.head["tokens"], self.head["levels"], self.head["planes"]
        self._block = lru_cache(maxsize=64)(self._open)

    def __len__(self) -> int:
        return self.n

    def _section(self, at: int, length: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(bytes(self.data[self.base + at : self.base + at + length]))

    def _open(self, plane: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The block's bits and the ones up to and with each of them."""
        at, length, _ = self.planes[plane]["blocks"][k]
        bits = np.unpackbits(np.frombuffer(self._section(at, length), dtype=np.uint8))[: min(BLOCK, self.n - k * BLOCK)]
        return bits, np.cumsum(bits, dtype=np.int64)

    def rank1(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        if i <= 0:
            return 0
        k, r = divmod(i - 1, BLOCK)
        return self.planes[plane]["blocks"][k][2] + int(self._block(plane, k)[1][r])

    def bit(self, plane: int, i: int) -> int:
        return int(self._block(plane, i // BLOCK)[0][i % BLOCK])

    def select(self, plane: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) bit of that kind."""
        blocks = self.planes[plane]["blocks"]
        before = [b[2] if bit else j * BLOCK - b[2] for j, b in enumerate(blocks)]
        j = int(np.searchsorted(before, k, side="right")) - 1
        sums = self._block(plane, j)[1]
        if not bit:
            sums = np.arange(1, len(sums) + 1) - sums
        return j * BLOCK + int(np.searchsorted(sums, k - before[j] + 1))

    def access(self, i: int) -> int:
        value = 0
        for plane in range(self.levels):
            one, ones = self.bit(plane, i), self.rank1(plane, i)
            value = value << 1 | one
            i = self.planes[plane]["zeros"] + ones if one else i - ones
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        if token >> self.levels:
            return 0, 0
        for plane in range(self.levels):
            a, b = self.rank1(plane, low), self.rank1(plane, high)
            if token >> (self.levels - 1 - plane) & 1:
                low, high = self.planes[plane]["zeros"] + a, self.planes[plane]["zeros"] + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences among the places low to high - 1."""
        a, b = self._range(token, low, self.n if high is None else high)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence of a token."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for plane in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - plane) & 1
            i = self.select(plane, one, i - self.planes[plane]["zeros"] if one else i)
        return i

    def all_ids(self) -> np.ndarray:
        """Every id in order; the partings are undone from the lowest bit up. Checks the crc."""
        narrow = np.uint16 if self.levels <= 16 else np.uint32
        ids = np.zeros(self.n, dtype=narrow)
        for plane in range(self.levels - 1, -1, -1):
            packed = b"".join(self._section(at, length) for at, length, _ in self.planes[plane]["blocks"])
            bits = np.unpackbits(np.frombuffer(packed, dtype=np.uint8))[: self.n].astype(bool)
            zeros, up = self.planes[plane]["zeros"], np.empty(self.n, dtype=narrow)
            up[np.flatnonzero(~bits)] = ids[:zeros]
            up[np.flatnonzero(bits)] = ids[zeros:] | narrow(1 << (self.levels - 1 - plane))
            ids = up
        ids = ids.astype(np.uint32)
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.head["crc32"]:
            raise ValueError("the ids don't have the crc of the file")
        return ids

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        names, _, lengths = self._section(*self.head["documents"]).partition(b"\n")
        return json.loads(names), np.frombuffer(lengths, dtype="<u8").astype(np.int64)


class WordEncoder:
    """ids of white-space separated words, kept as slices of one flat array.

    Words are prepared in Arrow, all of a slice at once: ASCII capitals are lowered if the
    tokenizer lowers them anyway, and a final run of marks after an ASCII letter is taken off,
    where the tokenizer splits anyway; both are tried out on a probe when the tokenizer is
    opened. Stems and runs of marks are numbered, and only new ones are looked up one by one.
    Letters are composed (NFC) beforehand if the tokenizer composes them, so that more words are letters only.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.lowers = "Lowercase" in str(json.loads(self.tokenizer.to_str())["normalizer"]) and ids("HeLLo") == ids("hello")
        self.parts = all(ids(f"hello{m}") == ids("hello") + ids(m) for m in [*MARKS, MARKS, *[m * 3 for m in MARKS]])
        self.composes = "NFC" in str(json.loads(self.tokenizer.to_str())["normalizer"]) and ids("e\u0301") == ids("\u00e9")
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool) if suffix else None
        for token, k in vocabulary.items() if suffix else ():
            self.ends[k] = token.endswith(suffix)
        self.restart()

    def restart(self) -> None:
        """Number 0 is the empty piece."""
        self.numbers: dict[str, int] = {"": 0}
        self.flat, self.used = np.empty(1 << 20, dtype=np.uint32), 0
        self.first, self.length = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int32)

    def _keep(self, keys: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Number ``keys`` on; ``ids`` are theirs, one key after the other."""
        known, end = len(self.numbers), self.used + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.empty(max(end, 2 * len(self.flat)) - self.used, dtype=np.uint32)))
        if known + len(keys) > len(self.first):
            more = np.zeros(max(known + len(keys), 2 * len(self.first)) - known, dtype=np.int64)
            self.first, self.length = np.concatenate((self.first[:known], more)), np.concatenate((self.length[:known], more.astype(np.int32)))
        self.flat[self.used : end] = ids
        self.first[known : known + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.length[known : known + len(keys)] = lengths
        self.numbers.update(zip(keys, range(known, known + len(keys)), strict=True))
        self.used = end

    def _ask(self, new: pa.Array) -> None:
        """The library's ids of pieces that aren't kept yet.

        Pieces of letters only are one word for a tokenizer with word-end tokens. Many are
        encoded as one text and told apart by these tokens, if there are as many as words.
        """
        keys, composed = strings(new), pc.utf8_normalize(new, "NFC") if self.composes else new
        words, alone = strings(composed), np.arange(len(new))
        if self.ends is not None:
            letters = np.asarray(pc.utf8_is_alpha(composed))
            plain, alone = np.flatnonzero(letters).tolist(), np.flatnonzero(~letters)
            runs = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
            kept, ids, lengths, failed = [], [], [], []
            for run, found in zip(runs, self.tokenizer.encode_batch_fast([" ".join([words[i] for i in run]) for run in runs], add_special_tokens=False), strict=True):
                own = np.array(found.ids, dtype=np.uint32)
                last = np.flatnonzero(self.ends[own])
                if len(last) != len(run):
                    failed += run
                    continue
                kept += run
                ids.append(own)
                lengths.append(np.diff(last, prepend=-1))
            if kept:
                self._keep([keys[i] for i in kept], np.concatenate(ids), np.concatenate(lengths))
            alone = np.concatenate((alone, np.array(failed, dtype=np.int64)))
        each = [found.ids for found in self.tokenizer.encode_batch_fast([words[i] for i in alone.tolist()], add_special_tokens=False)]
        self._keep([keys[i] for i in alone.tolist()], np.array([k for ids in each for k in ids], dtype=np.uint32), np.array([len(ids) for ids in each], dtype=np.int64))

    def _numbers_of(self, pieces: pa.Array) -> np.ndarray:
        coded = pc.dictionary_encode(pieces)
        of = self.numbers.get
        numbers = np.array([of(k, -1) for k in strings(coded.dictionary)], dtype=np.int64)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            asked = coded.dictionary.take(pa.array(new))
            self._ask(asked)
            numbers[new] = [self.numbers[k] for k in strings(asked)]
        return numbers[np.asarray(coded.indices)]

    def _pieces(self, words: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Each word's stem, the runs of marks that were taken off, and the places of the words that they follow."""
        stems = pc.ascii_lower(words) if self.lowers else words
        special = np.asarray(pc.match_substring(words, "<|"))
        if special.any():
            stems = pc.if_else(pa.array(special), words, stems)
        if not self.parts:
            return stems, words.slice(0, 0), np.empty(0, dtype=np.int64)
        bare = pc.ascii_rtrim(stems, characters=MARKS)
        at, data = bytes_of(stems)
        sizes, left = np.diff(at), np.asarray(pc.binary_length(bare), dtype=np.int64)
        last = data[np.maximum(at[:-1] + left - 1, 0)] | 0x20 if len(data) else np.zeros(len(words), dtype=np.uint8)
        own = np.flatnonzero((left > 0) & (left < sizes) & ~special & (last >= ord("a")) & (last <= ord("z")))
        marks = taken(data, at[:-1][own] + left[own], (sizes - left)[own])
        ends = np.concatenate(([0], np.cumsum((sizes - left)[own]))).astype(np.int32)
        cut = np.zeros(len(words), dtype=bool)
        cut[own] = True
        return pc.if_else(pa.array(cut), bare, stems), pa.StringArray.from_buffers(len(own), pa.py_buffer(ends), pa.py_buffer(marks)), own

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one after the other, and how many each has."""
        if len(self.numbers) > MAX_WORDS:
            self.restart()
        words, codes, starts = word_codes(texts)
        stems, marks, own = self._pieces(words)
        pieces = np.zeros((len(words), 2), dtype=np.int64)  # number 0 is the empty piece
        pieces[:, 0] = self._numbers_of(stems)
        pieces[own, 1] = self._numbers_of(marks)
        of_pieces = self.length[pieces]
        flat, lengths = taken(self.flat, self.first[pieces].ravel(), of_pieces.ravel()), of_pieces.sum(axis=1, dtype=np.int64)
        counts = lengths[codes]
        return taken(flat, (np.cumsum(lengths) - lengths)[codes], counts), totals(counts, starts)


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    if end_id is None:
        return ids, lengths
    return np.insert(ids, np.cumsum(lengths), end_id), lengths + 1


def settled(spark: SparkSession, folder: str) -> str:
    """``folder`` as a full URI: one without a scheme is on Spark's default file system, not on each executor's disk."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return f"file://{uri.removeprefix('file:')}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def put_file(folder: str, name: str, data: bytes) -> None:
    """Write by a temporary name and rename; ``folder`` is a URI of any file system that pyarrow knows."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    half = f"{path}/_{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(half) as out:
        out.write(data)
    where.move(half, f"{path}/{name}")


def write_shards(docs: DataFrame, tokenizer_file: str, folder: str, end_id: int | None = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the files; returns a row for each: part, seq, n_docs, n_tokens."""
    folder = settled(docs.sparkSession, folder)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("t"))
    dealt = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("t"), F.col("t").isNotNull()).withColumn("part", F.spark_partition_id())

    def written(batches: Iterable[pa.RecordBatch]):
        encoder = kept_in_process(f"encoder of {tokenizer_file}", lambda: WordEncoder(tokenizer_file))
        names, parts, counts, size, seq, part = [], [], [], 0, 0, 0

        def flush():
            ids, lengths = np.concatenate(parts), np.concatenate(counts)
            put_file(folder, f"part-{part:06d}-{seq:06d}.wvm", build(ids, names, lengths))
            row = {"part": (part, pa.int32()), "seq": (seq, pa.int32()), "n_docs": (len(names), pa.int64()), "n_tokens": (len(ids), pa.int64())}
            return pa.RecordBatch.from_pydict({name: pa.array([value], kind) for name, (value, kind) in row.items()})

        for batch in batches:
            part = batch.column(2)[0].as_py() if len(batch) else part
            for some in slices(batch, 1, SLICE):
                ids, lengths = with_end(*encoder.encode(some.column(1)), end_id)
                parts.append(ids)
                counts.append(lengths)
                names += some.column(0).to_pylist()  # longs, null where a doc_id is
                size += len(ids)
                if size >= shard_tokens:
                    yield flush()
                    names, parts, counts, size, seq = [], [], [], 0, seq + 1
        if names:
            yield flush()

    return stored(dealt.mapInArrow(written, "part int, seq int, n_docs long, n_tokens long"), "wavelet-files")


def read_shards(docs_files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, part, seq: a row for each document, decoded from the files."""
    spark = docs_files.sparkSession
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = docs_files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each partition
    before = parts.select("part", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = docs_files.join(before, "part").select("part", "seq", (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("first"))

    def decoded(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part, seq = map(int, unquote(path).rsplit("/", 1)[-1].removesuffix(".wvm").split("-")[1:])
                matrix = WaveletMatrix(data.as_py())
                names, lengths = matrix.documents()
                ids = memoryview(matrix.all_ids().astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                of_file = lambda number: pa.array([number] * len(names), pa.int32())  # noqa: B023, E731
                columns = [pa.array(names, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64()), of_file(part), of_file(seq)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "n_tokens", "ids_crc32", "part", "seq"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder).select("path", "content")
    rows = files.mapInArrow(decoded, "doc_id long, at long, n_tokens long, ids_crc32 long, part int, seq int")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")


def encode_and_read(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Write all shards under a new folder of the shared place, then read every file back."""
    folder = scratch(docs.sparkSession, "wavelet")
    files = write_shards(docs, tokenizer_file, folder)
    if files.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, part int, seq int")
    return read_shards(files, folder)
