"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from typeloom.llm import decontaminate, language_id, license_scan, line_dedup, packing, quality, sharding, simhash, token_counts, wavelet

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, score double, h1 long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(300)] + ["the", "and", "ünï", "😀"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) + rng.choice(["", ".", "\nCommon LINE here \n", "\n\n"]) for _ in range(60)]
    texts += [texts[0]] * 3 + [texts[1] + " x", None, "", " \t\n", "one", "A b\r\n C", "w " * 5000, texts[2].replace(" ", "\n", 1)]
    texts += [" ".join(f"q{i}" for i in range(12)) + " " + " ".join(f"q{i}" for i in range(12))]
    out = [(i * 7 % 997, t, ("en", "de", None)[i % 3], "s", None if t is None else len(t), i, 0.5, 1) for i, t in enumerate(texts)]
    return out + [out[5], (None, "null id text", "en", "s", 1, 0, 0.1, 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash(spark, docs, none):
    def plain(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        import xxhash

        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    want, ids = [plain(r[1]) for r in rows()], [r[0] for r in rows()]
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(ids)), 2):
        if (want[i] ^ want[j]).bit_count() <= 3:
            parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_hex("fp").alias("f"), "component_id").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((d, f"{f:016x}", least[find(i)])) for i, (d, f) in enumerate(zip(ids, want, strict=True)))
    kept = [r.doc_id for r in simhash.one_of_each(docs).collect()]
    assert len(kept) == len(least) and len(set(kept)) == len(kept)
    assert simhash.near_duplicates(none).count() == 0


def test_links_of_dense_lists():
    rng = np.random.default_rng(0)
    low = np.unique(rng.integers(0, 1 << 24, 3000) & 0xFFF0F)
    values = low.astype(np.uint64)

    def groups(links):
        parent = {int(v): int(v) for v in values}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                parent[find(x)] = find(y)
        sets = {}
        for v in parent:
            sets.setdefault(find(v), set()).add(v)
        return {frozenset(s) for s in sets.values()}

    small = values[::40]
    values = small
    pairs = [(np.array([a]), np.array([b])) for a, b in combinations(small, 2) if (int(a) ^ int(b)).bit_count() <= 3]
    assert groups(simhash.link_list(small)) == groups(pairs) == groups(simhash._flood(small, small.astype(np.int64)))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert len({roots[i] for i in range(41)}) == 1 and roots[100] == roots[101] != roots[0]


def test_line_dedup(docs, none):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for r in rows() for k in {key(x) for x in (r[1] or "").split("\n")})
    want = []
    for r in rows():
        lines = (r[1] or "").split("\n")
        keep = [x for x in lines if not (key(x) and seen[key(x)] >= 10)]
        want.append((r[0], "\n".join(keep), len(lines), len(lines) - len(keep)))
    out = line_dedup.drop_frequent_lines(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert any(w[3] for w in want) and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in out.select("doc_id", "text", "line_dedup_n_lines", "line_dedup_n_dropped").collect())
    assert line_dedup.drop_frequent_lines(none).count() == 0


def test_quality_counts(docs, none):
    def plain(t):
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        win = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        cover = {k for j in range(len(w) - 7) if win[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)

    out = quality.judge(docs)
    got = out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = [(r[0], *plain(r[1])) for r in rows()]
    assert sorted(repr(tuple(r)[:6]) for r in got) == sorted(map(repr, want))
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.judge(none).count() == 0


def test_jensen_shannon(spark):
    same, apart = spark.range(1).select(*[quality.js_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(a), F.lit(1 - a))) for a in (1.0, 0.0)]).first()
    assert (same, apart) == (0.0, 1.0)


def test_sharding(docs, none):
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(rows())
    size = {i: sum(r.size for r in got if r.shard == i) for i in range(4)}
    assert max(size.values()) - min(size.values()) <= 2 * max(r.size for r in got)
    for i in range(4):
        assert sorted(r.slot for r in got if r.shard == i) == list(range(sum(r.shard == i for r in got)))
    order = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32))
    assert [r.shard for r in order] == sorted(r.shard for r in order)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert sharding.shard(none).count() == 0


def test_packing(docs, none):
    got = packing.pack(docs, 4, 256).collect()
    assert Counter(r.n_tokens for r in got) == Counter(len(WORD.findall(r[1] or "")) + 1 for r in rows())
    batches = Counter((r.bucket, r.batch) for r in got)
    assert all(r.n_tokens + r.padding == r.bucket_len and r.padding >= 0 for r in got)
    assert all(batches[r.bucket, r.batch] * r.bucket_len <= max(256, r.bucket_len) for r in got)
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == len(got)
    assert packing.pack(none).count() == 0
    rng = random.Random(2)
    for _ in range(20):
        xs = sorted(rng.sample(range(1, 40), 8))
        cs = [rng.randint(1, 9) for _ in xs]
        pad = lambda ends: sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(xs, cs, strict=True))  # noqa: B023, E731
        best = min(pad([*e, xs[-1]]) for n in range(3) for e in combinations(xs[:-1], n))
        assert pad(packing.optimal_buckets(xs, cs, 3)) == best


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 300, 5000).astype(np.uint32)
    m = wavelet.WaveletMatrix(wavelet.build(ids, [1, None], np.array([4000, 1000])))
    assert (m.all_ids() == ids).all() and m.documents()[0] == [1, None]
    assert [m.access(i) for i in range(0, 5000, 97)] == ids[::97].tolist()
    for t in (0, 7, 299, 511, 5000):
        at = np.flatnonzero(ids == t)
        assert m.count(t) == len(at) and m.count(t, 100, 900) == ((at >= 100) & (at < 900)).sum()
        assert [m.occurrence(t, k) for k in range(0, len(at), 5)] == at[::5].tolist()
    empty = wavelet.WaveletMatrix(wavelet.build(np.zeros(0), [], np.zeros(0)))
    assert len(empty) == 0 and len(empty.all_ids()) == 0


def test_wavelet_output(docs, none):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(P.path("word_bpe_49k.json"))
    t = Tokenizer.from_file(path)
    ids = lambda text: t.encode(text or "", add_special_tokens=False).ids
    got = wavelet.encode_and_read(docs, path).collect()
    want = Counter((r[0], len(ids(r[1])) + 1, zlib.crc32(np.array([*ids(r[1]), 1], dtype="<u4").tobytes())) for r in rows())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == [sum(x.n_tokens for x in order[:i]) for i in range(len(order))]
    assert [(r.doc_id is not None, r.doc_id or 0) for r in order] == sorted((r.doc_id is not None, r.doc_id or 0) for r in order)
    assert wavelet.encode_and_read(none, path).count() == 0
    odd = ["<|endoftext|> A<|ENDOFTEXT|>b", "It's x's 12,3 e\u0301 \u0301x Ünï À.. a.,b !?\u00a0x", "", "  ", "ΑΣ Σ"]
    found, n = wavelet.WordEncoder(path).encode(pa.array(odd))
    cuts = np.concatenate(([0], np.cumsum(n)))
    assert [found[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)] == [ids(x) for x in odd]


def test_token_counts(docs, none):
    P = pytest.importorskip("public_tokenizers")
    path = str(P.path("piece_bpe_32k.model"))
    scores, longest = token_counts.zipf_scores(path)

    def plain(word):
        best = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            best.append(max([(best[e - 1][0] + token_counts.UNKNOWN, best[e - 1][1] - 1)] + [(best[s][0] + scores[word[s:e]], best[s][1] - 1) for s in range(max(0, e - longest), e) if word[s:e] in scores]))
        return -best[-1][1]

    got = Counter(map(tuple, token_counts.count_tokens(docs, path).collect()))
    assert got == Counter((r[0], len(WORD.findall(r[1] or "")), sum(plain(token_counts.MARK + w) for w in WORD.findall(r[1] or ""))) for r in rows())
    trie = token_counts.Trie(scores, longest)
    trie["abcde"], trie["abcdf"]
    assert trie.computed == 7  # the mark and abcd once, then e and f
    assert token_counts.count_tokens(none, path).count() == 0


def test_licenses(spark, none):
    rng = random.Random(0)
    noise = lambda n: " ".join(rng.choice(["of", "the", "on", "re", "is"]) for _ in range(n))
    every = [(i, f"{noise(30)}\n{t}\n{noise(37)}", n) for i, (n, t) in enumerate(license_scan.TEMPLATES)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in every] + [(900, noise(200), "x"), (901, None, "x"), (902, "", None), (903, "the MIT License", None)], "doc_id long, text string, license string")
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(df).where("containment = 1").collect()}
    assert {(i, n) for i, _, n in every} <= got and not {d for d, _ in got} & {900, 901, 902, 903}
    assert license_scan.scan_licenses(none).count() == 0


def test_decontamination(spark, docs, none):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (12, 30, 60)]
    bench = spark.createDataFrame([*enumerate(items), (8, None), (9, "")], "item_id long, text string")
    noise = lambda n: " ".join(rng.choice(words) for _ in range(n))
    swap = " ".join("zz" if i % 6 == 5 else w for i, w in enumerate(items[2].split()))
    texts = [noise(50) + " " + items[0].upper() + "!", items[1], noise(20) + " " + swap + " " + noise(9), noise(300), " ".join(items[1].split()[:12]) + " " + noise(80), None, ""]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id int, item string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2)}
    assert sorted(r.doc_id for r in decontaminate.decontaminated(df, bench).collect()) == [3, 4, 5, 6]
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_language_id(spark, none):
    rng = random.Random(1)
    vocabulary = {"en": ["house", "the", "winter", "thing"], "xx": ["ñora", "élé", "qux", "zzar"]}
    text = lambda lang: " ".join(rng.choice(vocabulary[lang]) for _ in range(12))
    data = [(i, text(lang), lang) for i in range(80) for lang in [("en", "xx")[i % 2]]] + [(900, None, "en"), (901, "12 ² !!", "en"), (902, "winters", None), (903, "zzarqux", None)]
    out = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in data[:80]) and all(0 <= r.score <= 1 for r in out.values())
    assert out[900].lang_pred == out[901].lang_pred == "und" and (out[902].lang_pred, out[903].lang_pred) == ("en", "xx")
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    assert language_id.identify(none).count() == 0


def test_pipeline(spark, tmp_path):
    corpus = pytest.importorskip("corpus_pipeline")
    rng = random.Random(2)
    words = [a + b for a in ("ka", "lo", "mi", "ne") for b in ("ra", "st", "un", "po")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    leak = text(40)
    texts = [text(60) for _ in range(30)] + [None, "123 !!"]
    texts += [texts[0], f"{text(20)} {leak}"] + [f"{text(50)}\nshared footer line" for _ in range(12)]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], cols).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(len(texts))) - {30, 31, 32, 33}
    assert {r.n_tokens for r in got if r.doc_id > 33} == {51}


def test_pipeline_keeps_one_of_many_copies(spark, tmp_path):
    corpus = pytest.importorskip("corpus_pipeline")
    rng = random.Random(4)
    words = [a + b for a in ("ka", "lo", "mi", "ne") for b in ("ra", "st", "un", "po")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    copied, spelt = f"{text(40)}\n{text(40)}", f"{text(40)}\n\n{text(40)}"
    texts = [text(60) for _ in range(20)] + [copied] * 12 + [spelt, spelt.upper(), *[spelt + " " * k + "\n" for k in range(12)]]
    texts += [f"{text(50)}\nshared footer line" for _ in range(12)]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], cols).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {r.doc_id: r for r in corpus.line_stage(spark, docs, str(tmp_path)).collect()}
    assert [left[i].text for i in range(46)] == texts[:46]
    assert all(left[i].text == texts[i].split("\n")[0] and left[i].n_chars == len(left[i].text) for i in range(46, 58))
    assert {r.doc_id for r in corpus.run(spark, str(tmp_path)).collect()} == {*range(21), 32, *range(46, 58)}
    # The operator itself counts every copy.
    assert all(r.line_dedup_n_dropped == 2 for r in line_dedup.drop_frequent_lines(docs).where("doc_id between 20 and 31").collect())


def test_one_of_each_under_null_and_repeated_ids(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(40)) for _ in range(7)]
    data = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3]), (None, texts[4]), (7, texts[4]), (6, texts[4]), (None, None), (5, texts[5]), (4, texts[5]), (None, texts[6])]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(data)], "doc_id long, text string, k int").repartition(3)
    got = [(r.doc_id, r.text) for r in simhash.one_of_each(df).collect()]
    want = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (6, texts[4]), (None, None), (4, texts[5]), (None, texts[6])]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_decontamination_under_null_and_repeated_ids(spark):
    rng = random.Random(7)
    noise = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    item = noise(30)
    leaky, clean = [f"{noise(9)} {item} {noise(k)}" for k in range(3)], [noise(60) for _ in range(3)]
    data = [(None, leaky[0]), (None, clean[0]), (None, clean[0]), (None, None), (4, leaky[1]), (4, clean[1]), (4, ""), (5, leaky[2]), (5, leaky[2]), (6, clean[2])]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(data)], "doc_id long, text string, k int").repartition(3)
    out = decontaminate.decontaminated(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.columns == df.columns and sorted(r.k for r in out.collect()) == [1, 2, 3, 5, 6, 9]


@pytest.mark.parametrize("n", [3, quality.MAX_LANGS + 6])
def test_quality_references_of_every_language(spark, monkeypatch, n):
    rng = random.Random(8)
    other = lambda k: "".join(rng.choice("abcdefgh") for _ in range(6))
    prose = lambda k: " ".join(quality.COMMON[k] if i % 2 else other(k) for i in range(60))
    # Language k has one common word of its own; the last has fewest documents, and capitals that no other has.
    data = [(k * 10 + i, prose(k % 30), f"l{k:03}") for k in range(n - 1) for i in range(3)] + [(9000 + i, prose(33).upper(), "last") for i in range(2)] + [(9900, prose(0), None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    judged = lambda: {r.doc_id: r for r in quality.judge(df).collect()}
    got = judged()
    assert got[9000].nearest_lang == got[9001].nearest_lang == "last" and got[9000].kept and got[9001].kept
    assert all(r.char_distance < 0.05 and r.kept for r in got.values())
    monkeypatch.setattr(quality, "MAX_LANGS", 0 if n <= quality.MAX_LANGS else n)  # the other way gives the same
    for d, r in judged().items():
        assert (r.kept, r.nearest_lang) == (got[d].kept, got[d].nearest_lang) and r[9:] == pytest.approx(got[d][9:], abs=1e-6)


def test_packing_is_optimal_beyond_short_lengths(spark):
    rng = random.Random(9)
    xs = sorted(rng.sample(range(3000, 3024), 9)) + [20_001, 20_002]
    cs = [rng.randint(1, 9) for _ in xs]
    pad = lambda ends: sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(xs, cs, strict=True))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(x for x, c in zip(xs, cs, strict=True) for _ in range(c))], "doc_id long, n long")
    for n in (1, 2, 4, 7, 11):
        got = packing.pack(df.withColumn("text", F.lit("")), n, tokens=F.col("n")).agg(F.sum("padding")).first()[0]
        assert got == min(pad([*e, xs[-1]]) for k in range(n) for e in combinations(xs[:-1], k))
