"""The core against plain Python over random inputs: sequences, timing, replay, text and code features, analysis, evaluation."""

import math
import random
import statistics
from collections import Counter, defaultdict, deque

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from typeloom.functions import code as C
from typeloom.functions import language as N
from typeloom.functions import prose as P
from typeloom.operators import analysis as A
from typeloom.operators import groups as G
from typeloom.operators import reshape as R
from typeloom.operators import sequences as S
from typeloom.operators import timing as T
from typeloom.plans import evaluation as E

KEYS = "g int, code string, key string, phase string, repeat boolean, ts double, seq int, line int, ch int"


def random_log(rng, g, n, spread):
    """Rows of a group in log order; codes may be null or empty, keys capital, releases orphans."""
    keys = {"KeyA": "a", "KeyB": "B", "Space": " ", "Backspace": "Backspace", "ShiftLeft": "Shift", "Digit1": "1", "Enter": "Enter", None: "c", "": "D"}
    times = sorted(rng.randrange(spread) for _ in range(n))
    rows = []
    for i, ts in enumerate(times):
        code = rng.choice(list(keys))
        key = keys[code] if rng.random() < 0.8 else keys[code].swapcase() if len(keys[code]) == 1 else keys[code]
        down = rng.random() < 0.55
        rows.append((g, code, key, "keydown" if down else "keyup", down and rng.random() < 0.1, float(ts), i, rng.randint(0, 2), rng.randint(0, 4)))
    return rows


def pairs_of(rows):
    """[code, down, up, down seq, up seq] by a queue for each code, in the order of the downs."""
    waiting, out = defaultdict(deque), []
    for _, code, _, phase, repeat, ts, seq, _, _ in rows:
        if code is None or (phase == "keydown" and repeat):
            continue
        if phase == "keydown":
            out.append([code, ts, None, seq, None])
            waiting[code].append(out[-1])
        elif waiting[code]:
            pair = waiting[code].popleft()
            pair[2], pair[4] = ts, seq
    return out


def quantile(xs, q):
    xs = sorted(xs)
    at = q * (len(xs) - 1)
    low = math.floor(at)
    return xs[low] + (at - low) * (xs[min(low + 1, len(xs) - 1)] - xs[low])


def over(a, b):
    return a / b if b else None


def cv(xs):
    return over(statistics.stdev(xs), statistics.fmean(xs)) if len(xs) > 1 else None


def entropy_of(counts):
    total = sum(counts)
    return -sum(c / total * math.log2(c / total) for c in counts if c) if total else None


def rhythm_of(rows, mouse, cursor):
    pairs = sorted(pairs_of(rows), key=lambda p: (p[1], p[2] is None, p[2] or 0, p[4] or 0, p[3]))
    downs = [p[1] for p in pairs]
    iki = [b - a for a, b in zip(downs, downs[1:], strict=False)]
    hold = [p[2] - p[1] for p in pairs if p[2] is not None]
    rkdt = [b[1] - a[2] for a, b in zip(pairs, pairs[1:], strict=False) if a[2] is not None]
    out = {"kit_cv": cv(iki), "kht_cv": cv(hold), "rkdt_cv": cv(rkdt)}
    for name, xs in (("kit", iki), ("kht", hold)):
        out[f"{name}_p90_p50"] = over(quantile(xs, 0.9), quantile(xs, 0.5)) if len(xs) > 1 else None
        out[f"{name}_p50_p10"] = over(quantile(xs, 0.5), quantile(xs, 0.1)) if len(xs) > 1 else None
    middle = quantile(iki, 0.5) if iki else 0
    long = [x for x in iki if x > 2 * middle]
    out["kit_long_pause_fraction"] = len(long) / len(iki) if middle else None
    out["kit_pause_time_fraction"] = over(sum(long), downs[-1] - downs[0]) if middle else None
    out["kit_pause_entropy"] = entropy_of(np.histogram(iki, bins=10)[0].tolist()) if len(iki) > 1 and min(iki) < max(iki) else 0.0 if len(iki) > 1 else None
    stream = [r for r in rows if r[3] == "keydown" and not r[4]]
    n = len(stream)
    deletes = [r[2] in ("Backspace", "Delete") for r in stream]
    inserts = [not d and (r[2] in ("Enter", "Tab") or len(r[2]) == 1) for d, r in zip(deletes, stream, strict=True)]
    out["revision_delete_ratio"] = over(sum(deletes), sum(deletes) + sum(inserts))
    episodes = sum(d and not before for before, d in zip([False, *deletes], deletes, strict=False))
    out["revision_deletion_episodes_per_100_keys"] = over(100 * episodes, n)
    followed = [after for ins, after in zip(inserts, deletes[1:], strict=False) if ins]
    out["revision_immediate_correction_rate"] = over(sum(followed), len(followed))
    bursts = 1 + sum(x >= 1000 for x in iki) if pairs else 0
    out["burst_bursts_per_100_keys"] = over(100 * bursts, n) if pairs else None
    out["burst_relative_burst_length"] = over(over(len(pairs), bursts), n) if pairs else None
    out["mouse_moves_per_100_keys"] = over(100 * len(mouse), n)
    steps = [math.dist(a, b) for a, b in zip(mouse, mouse[1:], strict=False)]
    out["mouse_path_length"] = over(100 * sum(steps), n) if len(mouse) > 1 else None
    moves = [(a, b) for a, b in zip(cursor, cursor[1:], strict=False) if None not in (*a, *b)]
    jumps = sum(not ((b[0] == a[0] and b[1] == a[1] + 1) or (b[0] == a[0] + 1 and b[1] == 0)) for a, b in moves)
    out["cursor_jump_rate"] = over(jumps, len(moves))
    return out


def test_rhythm_like_sequential_code(spark):
    rng = random.Random(21)
    logs = {g: random_log(rng, g, rng.choice([0, 1, 2, 5, 30, 60]), rng.choice([20, 4000, 30000])) for g in range(25)}
    mice = {g: [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.choice([0, 1, 2, 8]))] for g in logs}
    carets = {g: [(rng.choice([0, 1, 2, None]), rng.randint(0, 3)) for _ in range(rng.choice([1, 2, 9]))] for g in logs}
    keys = spark.createDataFrame([r for rows in logs.values() for r in rows], KEYS)
    mouse = spark.createDataFrame([(g, float(i), i, float(x), float(y)) for g, m in mice.items() for i, (x, y) in enumerate(m)], "g int, ts double, seq int, x double, y double")
    cursor = spark.createDataFrame([(g, float(i), i, ln, ch) for g, c in carets.items() for i, (ln, ch) in enumerate(c)], "g int, ts double, seq int, line int, ch int")
    got = {r.g: r.asDict() for r in S.tier1(keys, mouse, cursor, ["g"]).collect()}
    assert set(got) == set(logs)
    for g in logs:
        want = rhythm_of(logs[g], mice[g], carets[g])
        known = {k: v for k, v in want.items() if v is not None}
        assert {k: got[g][k] for k in want if got[g][k] is not None} == pytest.approx(known, rel=1e-9, abs=1e-9), g
    pairs = S.key_pairs(keys, ["g"]).select("g", "code", "down_ts", "up_ts", "down_seq", "up_seq").collect()
    assert Counter(map(tuple, pairs)) == Counter((g, *p) for g, rows in logs.items() for p in pairs_of(rows))


def timing_of(rows):
    waiting, out, last_down, last_up = defaultdict(deque), defaultdict(list), None, None
    for _, code, key, phase, repeat, ts, _, _, _ in rows:
        low = key.lower()
        if phase == "keydown":
            if repeat or low not in T.KEYS:
                continue
            if low in T.LETTERS:
                if last_down:
                    out["kit", f"{last_down[0]}->{low}"].append(ts - last_down[1])
                if last_up:
                    out["rukd", f"{last_up[0]}->{low}"].append(ts - last_up[1])
                last_down = (low, ts)
            waiting[code or low].append((low, ts))
        elif waiting[code or low]:
            own, began = waiting[code or low].popleft()
            if ts >= began:
                out["kht", own].append(ts - began)
            if own in T.LETTERS:
                last_up = (own, ts)
    return out


def test_timing_like_sequential_code(spark):
    rng = random.Random(22)
    logs = {g: random_log(rng, g, 60, 3000) for g in range(20)}
    keys = spark.createDataFrame([r for rows in logs.values() for r in rows], KEYS)
    values = T.collect(keys, ["g"])
    got = defaultdict(list)
    for r in values.collect():
        got[r.g, r.family, r.token].append(r.value)
    want = {(g, *k): xs for g, rows in logs.items() for k, xs in timing_of(rows).items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    told = {(r.g, r.family, r.token): r for r in T.summarize(values, ["g"]).collect()}
    kept = {}
    for k, xs in want.items():
        xs = [x for x in xs if 50 <= x <= 5000]
        if xs:
            q1, q3 = quantile(xs, 0.25), quantile(xs, 0.75)
            kept[k] = [x for x in xs if q1 - 2 * (q3 - q1) <= x <= q3 + 2 * (q3 - q1)]
    assert set(told) == set(kept)
    for k, xs in kept.items():
        sd, mean = statistics.pstdev(xs), statistics.fmean(xs)
        assert tuple(told[k])[3:] == pytest.approx((mean, sd, sd / mean, max(xs) - min(xs), max(xs), statistics.median(xs)))
    few = {(r.family, r.token) for r in T.collect(keys, ["g"], ["a->b", "b-> "]).collect() if r.family != "kht"}
    assert few and {t for _, t in few} <= {"a->b", "b-> "}


def test_timing_catalog(spark):
    names = T.feature_names(spark)
    assert len(names) == len(set(names)) == (29 + 2 * 27 * 27) * 6
    assert names[0] == "kht_a_mean" and "kit_a->space_cv" in names and names[-1] == "rukd_space->space_median"
    assert len(T.feature_names(spark, ["q->u"])) == (29 + 2) * 6
    for bad, word in ((["a->b", "a->b"], "2 times"), (["a->é"], "'é'"), (["ab"], "no '->'"), ([], "no bigram")):
        with pytest.raises(ValueError, match=word):
            T.checked(bad)
    long = T.long_features(T.summarize(spark.createDataFrame([(1, "kit", " ->a", 80.0)], "g int, family string, token string, value double"), ["g"]), ["g"])
    assert {r.feature: r.value for r in long.collect()} == {f"kit_space->a_{s}": v for s, v in zip(T.STATS, (80, 0, 0, 0, 80, 80), strict=True)}


def test_replay(spark):
    strokes = [("h", 0, 1), ("i", 0, 2), ("Shift", 0, 2), ("x", 0, 3), ("Backspace", 0, 2), ("Enter", 1, 0), ("b", 1, 1), ("a", 1, 1), ("ArrowLeft", 1, 0), ("Delete", 1, 0), ("y", 0, 9), ("Backspace", 1, 0), (None, 0, 0)]
    rows = [(1, "c", k, "keydown", False, float(i), i, line, ch) for i, (k, line, ch) in enumerate(strokes)] + [(1, "c", "z", "keydown", True, 50.0, 50, 0, 1), (1, "c", "z", "keydown", False, 51.0, 51, None, 1), (2, "c", "Delete", "keydown", False, 0.0, 0, 2, 3)]
    got = {r.g: r.replayed for r in S.replay(spark.createDataFrame(rows, KEYS), ["g"]).collect()}
    # hi, x typed and taken back; an Enter on a line that isn't there yet makes two; b, a before it, a deleted; y at the
    # first line's end; the first two lines joined.
    assert got == {1: "hiyb\n", 2: "\n\n"}
    texts = spark.createDataFrame([(1, "hiyb\n"), (2, "abc"), (3, "no strokes"), (1, None)], "g int, text string")
    agreed = S.replay_agreement(S.replay(spark.createDataFrame(rows, KEYS), ["g"]), texts, ["g"]).first()
    assert (agreed.n, agreed.exact, agreed.mean_similarity, agreed.median_similarity) == (2, 1, 0.5, 0.5)


TEXTS = ["", "One two, two. THREE?! É 12\tx", "\r\n# note\n  \n    code()\x0b\x85\t# end\u2028last", "a's a b... b b!", " \n \n", "\n"]


def test_prose_and_lines_like_plain_python(spark):
    import re

    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r.i: r for r in df.select("i", P.word_features(F.col("t")).alias("w"), P.line_features(F.col("t")).alias("l"), P.registered_lines(F.col("t")).alias("r")).collect()}
    for i, t in enumerate(TEXTS):
        w, lines = re.findall(r"[a-z]+(?:'[a-z]+)?", t.lower()), t.splitlines()
        counts = Counter(w)
        ratio = lambda a, b: a / b if b else 0.0
        assert got[i].w.total_word_count == len(w) and got[i].w.word_diversity == pytest.approx(ratio(len(counts), len(w)))
        assert got[i].w.hapax_ratio == pytest.approx(ratio(sum(c == 1 for c in counts.values()), len(w)))
        assert got[i].w.word_entropy == pytest.approx(entropy_of(counts.values()) or 0.0)
        assert got[i].w.yules_k == pytest.approx(ratio(1e4 * (sum(c * c for c in counts.values()) - len(w)), len(w) ** 2))
        assert got[i].w.total_sentence_count == len([s for s in re.split(r"[.!?]+", t) if s.strip()])
        blank, comment = sum(not x.strip() for x in lines), sum(x.strip().startswith("#") for x in lines)
        chars = len(t.replace("    ", "\t"))
        tabs = t.count("\t") + t.count("    ")
        assert got[i].l[:3] == (len(lines), blank, comment)
        assert (got[i].l.total_characters, got[i].l.four_space_tab_count, got[i].l.tab_count, got[i].l.tab_character_ratio) == (chars, t.count("    "), tabs, pytest.approx(ratio(tabs, chars)))
        assert tuple(got[i].r) == (over(comment, len(lines)), over(blank, len(lines)), over(comment, len(lines) - blank - comment))
    sizes = df.select(*[F.size(P.distribution(F.col("t"), k)).alias(k) for k in ("letter", "word_length", "punctuation", "function_word", "special")]).first()
    assert tuple(sizes) == (26, 20, 8, 150, 20)
    with pytest.raises(ValueError, match="type"):
        P.total_characters(F.col("t"), "poem")
    means = P.question_means(df.withColumn("u", F.col("i") % 2), ["u"], n=F.size(P.lines(F.col("t")))).collect()
    assert {r.u: r.n for r in means} == {u: statistics.fmean(len(t.splitlines()) for t in TEXTS[u::2]) for u in (0, 1)}


CODE = '''import os.path as osp, sys
from math import *

class Tank:  # holds watter
    def fill(self, litres=1):
        self.level = litres
        for i in range(3):
            if i and litres:
                while self.level < i:
                    self.level += 1
        return self.level

try:
    t = Tank()
    t.fill(litres=2); print(f"{t.level}", 'x', r"y")  # idx wrogn
except ValueError as err:
    print(err, pi)
'''


def test_code_facts(spark):
    texts = [CODE, "", "x = (", "def f(:\n  pass", "a b", None]
    df = C.with_facts(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t")
    facts = {r.i: r.facts for r in df.collect()}
    # Every mention of what the program names itself: methods and stored attributes where they are attributes, too.
    want = Counter({"osp": 1, "sys": 1, "Tank": 2, "fill": 2, "self": 5, "litres": 3, "level": 5, "i": 3, "t": 3, "err": 2})
    assert Counter(facts[0].defined) == want
    assert facts[0].comments == ["holds watter", "idx wrogn"] and (facts[0].double_quoted, facts[0].strings) == (2, 3)
    assert (facts[0].nesting, facts[0].functions, facts[0].complexity) == (3, 1, 4)
    assert facts[1].defined == facts[1].names == [] and facts[1].plain_tokens == 0
    assert facts[2].defined is None and facts[3].defined is None and facts[4].defined is None and facts[4].names == ["a", "b"]
    assert all(f.error is None for f in facts.values()) and facts[5].defined == []

    lexical = {r.i: r for r in df.select("i", *[c.alias(n) for n, c in C.lexical_features(F.col("t")).items()], C.identifier_lengths().alias("lengths")).collect()}
    n, letters = sum(want.values()), sum(len(k) * c for k, c in want.items())
    assert lexical[0].lex_total_identifier_count == n and lexical[0].lex_average_identifier_length == pytest.approx(letters / n)
    assert lexical[0].lex_identifier_diversity == pytest.approx(len(want) / n)
    assert lexical[0].lex_identifier_character_ratio == pytest.approx(letters / len(CODE.replace("    ", "\t")))
    assert lexical[0].lex_average_line_length_tokens == pytest.approx(facts[0].plain_tokens / len(CODE.splitlines()))
    assert {x.item: x.share for x in lexical[0].lengths}[4] == pytest.approx((want["Tank"] + want["fill"] + want["self"]) / facts[0].plain_tokens)
    zero = lexical[1].asDict()
    assert [k for k, v in zero.items() if v is None] == ["lex_double_quote_preference_ratio", "lex_average_cyclomatic_complexity"] and zero["lex_short_keyword_ratio"] == 0.0
    assert lexical[2].lex_identifier_diversity is None and lexical[2].lex_keyword_diversity is None
    dictionary = spark.createDataFrame([("holds",), ("water",), ("wrong",)], "word string")
    assert {r.i: r.n_misspelled for r in C.misspelled_comments(df, ["i"], dictionary).collect()} == {0: 2} | dict.fromkeys(range(1, 6), 0)


def test_preliminary_table(spark):
    answers = [("u", 1, "ab = 'x'\n\nab = cd = 1\n"), ("u", 1, "cd = \"y\" # z\n# w\n"), ("u", 1, "broken ("), ("v", 2, None)]
    got = {r.user: r for r in C.preliminary(spark.createDataFrame(answers, "user string, session int, text string"), ["user", "session"]).collect()}
    u = got["u"]
    assert (u.n_answers, u.double_quote_preference_ratio, u.average_identifier_length) == (3, 0.5, 2.0)
    assert u.identifier_diversity == pytest.approx((2 / 3 + 1) / 2) and u.pooled_identifier_diversity == 0.5
    assert u.blank_line_ratio == pytest.approx((1 / 3) / 3) and u.comment_line_ratio == pytest.approx((1 / 2) / 3)
    assert got["v"].identifier_diversity == 0.0 and got["v"].pooled_identifier_diversity is None


def test_registered_code_features(spark):
    codes = ["if n:\n    total = total + n\nprint(total)\n", "# only this\n", "oops("]
    df = spark.createDataFrame([(i, t, "Write total_sum(x), then 'width = 3' and print() it") for i, t in enumerate(codes)], "i int, t string, p string")
    out = C.without_boilerplate(C.with_facts(df, "t"), F.col("p"))
    rows = {r.i: r for r in out.select("i", "given_names", *[c.alias(n) for n, c in C.code_features(prompt=F.col("p")).items()]).collect()}
    tokens = ["if", "n", ":", "total", "=", "total", "+", "n", "print", "(", "total", ")"]
    assert rows[0].given_names == ["total_sum"]
    assert rows[0].identifier_diversity == pytest.approx(2 / 5) and rows[0].identifier_reuse_hapax == 0.0
    assert rows[0].token_entropy == pytest.approx(entropy_of(Counter(tokens).values()))
    assert rows[0].control_flow_keyword_ratio == pytest.approx(1 / 12) and rows[0].function_call_density == pytest.approx(1 / 12)
    assert rows[1].identifier_diversity is None and rows[1].token_entropy == 0.0 and rows[2].token_entropy is None
    assert rows[0].code_length_relative_to_prompt == pytest.approx(len(codes[0].replace("    ", "\t")) / 51)
    names = spark.range(1).select(C.prompt_names(F.lit("1. width = 5\n  if = 3\na == b\nuse my_name and go (x)"))).first()[0]
    assert names == ["go", "my_name", "width"]


def test_texts_that_nobody_typed_are_not_dealt_out(spark):
    from typeloom.plans import extraction as X

    key = "user string, session int, q_id int, r_t string, version int"
    events = spark.createDataFrame([("u", 2, 1, "code", 2, 1.0, 1, "key", "{}")], f"{key}, ts double, seq long, event_type string, data string")
    texts = [("u", 2, 1, "code", v, 0, 0, "code", t) for v, t in ((1, "# pasted\nx"), (2, "y"))]
    responses = spark.createDataFrame(texts, f"{key}, entry_pos int, field_pos int, source_field string, text string")
    found = X.extract(events, responses, None, only=["tier2_code_comment_density"])
    assert [(r.version, r.value) for r in found.long.collect()] == [(2, 0.0)] and [r.n_dropped for r in found.dropped.collect()] == [1]
    below = found.long._jdf.queryExecution().optimizedPlan().toString().split("Window [row_number", 1)[1]
    assert "Filter" in below and "version" in below.split("Filter", 1)[1].split("\n")[0]


def test_distributions_take_one_pass(spark):
    """Shares as counted one by one; no pass over the words or the text for each item."""
    import re

    texts = ["The cat's on the mat, and THE dog isn't; me? #\u0303 {a} = b-\u2014!", "", "\u212Aing \u0130n \u00c9t\u00e9 'tis a" + "b" * 25, "x" * 20 + " of of"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for kind, items in {"letter": "abcdefghijklmnopqrstuvwxyz", "special": P.SPECIAL_CHARACTERS, "punctuation": P.PUNCTUATION, "word_length": [*range(1, 21)], "function_word": P.FUNCTION_WORDS}.items():
        out = df.select("i", F.explode(P.distribution(F.col("t"), kind)).alias("x")).select("i", "x.*")
        got = {(r.i, r.item): r.share for r in out.collect()}
        for i, t in enumerate(texts):
            words = re.findall("[a-z]+(?:'[a-z]+)?", t.lower())
            for x in items:
                n = {"word_length": [len(w) for w in words], "function_word": words, "letter": list(t.lower())}.get(kind, list(t)).count(x)
                total = len(words) if "word" in kind else len(t)
                assert got[i, str(x)] == (n / total if total else 0.0), (kind, i, x)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert len(got) == len(items) * len(texts) and "array_remove" not in plan and "replace(" not in plan


def test_prompt_names_are_found_once_a_row(spark):
    """Found again for every name of the code, a row's cost was its names times the length of its prompt."""
    df = spark.createDataFrame([("ab = cd\ncd = ab\n", "let cd = 1, call ef()")], "t string, p string")
    out = C.without_boilerplate(C.with_facts(df, "t"), F.col("p")).select("own_names")
    assert out.first().own_names == ["ab", "cd", "cd", "ab"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains(lambda" in plan and "array_contains(array_sort" not in plan


def test_indentation():
    same = lambda code: C.indented(code, C.tokens_of(code)[0] if C.tokens_of(code)[1] else None, ">")
    wide, narrow = "for a in b:\n      if a:\n\t\tc\n", "for a in b:\n  if a:\n     c\n"
    assert same(narrow) == "for a in b:\n>if a:\n>>c\n"
    assert same(wide.replace("\t\t", " " * 9)) == same(narrow)
    assert same("x = '''\n   inside\n'''\n\n   \n") == "x = '''\ninside\n'''\n\n   \n"
    broken = "if (:\n  a\n      b\n  c\n"
    assert same(broken) == "if (:\n>a\n>>b\n>c\n"


def test_plain_reading_is_linear(spark):
    """Words and sentences as the plain patterns have them; a run of blanks took the square of its length."""
    import re
    import time

    word, sentence = r"[A-Za-z0-9']+|[^A-Za-z0-9' \t\n\x0b\f\r]", r"[^.!?]*[^.!? \t\n\x0b\f\r][^.!?]*[.!?]*"
    every = "".join(f"a{chr(k)}b{chr(k)}. " for k in [*range(0x300), 0x2003, 0x2028, 0x3000, 0xFB01, 0x1F600, 0x1D7D8])
    texts = ["", "...", " . \n?! x", "It's 'so'. . ! No 4.5 ?!", "\t\v a\v.\x1cb\x85c\xa0d", every, every.replace(". ", "\v?! ")]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", N.PLAIN.read(F.col("t")).alias("r")).collect()
    assert {r.i: (r.r.words, r.r.sentence_lengths) for r in got} == {i: (re.findall(word, t), [len(re.findall(word, s)) for s in re.findall(sentence, t)]) for i, t in enumerate(texts)}

    began = time.time()
    long = spark.range(1).select(F.concat(F.lit("One two."), F.repeat(F.lit(" "), 300_000), F.lit(". Three")).alias("t"))
    assert long.select(N.PLAIN.read(F.col("t")).alias("r")).first().r.sentence_lengths == [3, 1]
    assert time.time() - began < 15


def test_language_features(spark):
    from string import punctuation

    words = lambda t: t.replace(".", " .").split()
    kit = N.Toolkit(words, lambda t: [s for s in t.split(".") if s], {"the", "a"}, lambda ws: ["NN" if w[0].isupper() else "VB" if w.endswith("s") else "." for w in ws])
    texts = ["The Cat sits. A Dog runs (fast) home.", "", "...", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("r", kit.read(F.col("t")))
    got = {r.i: r.x for r in df.select("i", N.language_features(F.col("r"), kit).alias("x")).collect()}
    own = [w for t in words(texts[0]) if (w := t.lower().strip(punctuation))]
    assert got[0].ttr == pytest.approx(len(set(own)) / len(own)) and got[0].non_stopword_ratio == pytest.approx((len(own) - 2) / len(own))
    assert got[0].word_entropy == pytest.approx(entropy_of(Counter(own).values())) and got[0].sentence_length_cv == pytest.approx(cv([3, 5]))
    assert got[0].noun_ratio == pytest.approx(4 / 10) and got[0].verb_ratio == pytest.approx(2 / 10) and got[0].adv_ratio == 0.0
    assert got[1].ttr is got[2].ttr is got[3].ttr is None and got[1].noun_ratio is None
    plain = df.select("i", N.language_features(N.PLAIN.read(F.col("t")), N.PLAIN).alias("x")).collect()
    assert plain[0].x.noun_ratio is None and {r.i: r.x.ttr is None for r in plain} == {0: False, 1: True, 2: True, 3: True}


# Analysis


def brute_information(x, y, k=3):
    """Ross's estimator point by point."""
    sizes = Counter(y)
    at = [i for i in range(len(x)) if sizes[y[i]] > 1]
    total, own, near, around = len(at), [], [], []
    for i in at:
        n = min(k, sizes[y[i]] - 1)
        gaps = sorted(abs(x[i] - x[j]) for j in at if j != i and y[j] == y[i])
        radius = np.nextafter(gaps[n - 1], 0)
        own.append(sizes[y[i]])
        near.append(n)
        around.append(sum(abs(x[i] - x[j]) <= radius for j in at))
    psi = lambda v: float(A.digamma(np.array([v]))[0])
    mean = lambda vs: statistics.fmean(map(psi, vs))
    return max(0.0, psi(total) + mean(near) - mean(own) - mean(around))


def test_information_like_brute_force(spark):
    rng = np.random.default_rng(23)
    rows, want = [], {}
    for f, (n, shift) in enumerate(((30, 0), (60, 2), (80, 5), (9, 1))):
        y = rng.integers(0, 3, n)
        x = rng.normal(size=n) + shift * y
        want[f"f{f}"] = brute_information((x / x.std()).tolist(), y.tolist())
        rows += [(f"f{f}", int(b), float(a)) for a, b in zip(x, y, strict=True)] + [(f"f{f}", 1, None)]
    rows += [("flat", i % 2, 1.0) for i in range(10)]
    long = spark.createDataFrame(rows, "feature string, s int, value double")
    got = {r.feature: r.mi for r in A.mutual_information(long, "s").collect()}
    assert got == pytest.approx(want | {"flat": 0.0}, abs=1e-9)
    with pytest.raises(PySparkException, match="more than 20 values"):
        A.mutual_information(long, "s", most=20).collect()
    filled = A.median_filled(long).where("feature = 'f0'")
    assert filled.where("value IS NULL").isEmpty() and filled.count() == 31


def test_effects_and_ranks(spark):
    rng = random.Random(24)
    rows = [("f", s, rng.gauss(s, 2)) for s in (1, 2, 3) for _ in range(7)] + [("c", s, 4.0) for s in (1, 2, 3) for _ in range(3)]
    long = spark.createDataFrame(rows, "feature string, s int, value double")
    side = lambda s: [v for f, t, v in rows if f == "f" and t == s]
    d = {(r.feature, r.s): r.d for r in A.cohens_d(long, "s", 1).collect()}
    for s in (2, 3):
        pooled = math.sqrt((statistics.variance(side(s)) + statistics.variance(side(1))) / 2)
        assert d["f", s] == pytest.approx((statistics.fmean(side(s)) - statistics.fmean(side(1))) / pooled) and d["c", s] is None
    assert {r.feature: r.d_max for r in A.largest_d(A.cohens_d(long, "s", 1)).collect()} == {"f": pytest.approx(max(abs(d["f", 2]), abs(d["f", 3]))), "c": None}
    rest = side(1) + side(3)
    pooled = math.sqrt((6 * statistics.variance(side(2)) + 13 * statistics.variance(rest)) / 19)
    got = {(r.feature, r.s): r.d for r in A.one_vs_rest_d(long, "s").collect()}
    assert got["f", 2] == pytest.approx((statistics.fmean(side(2)) - statistics.fmean(rest)) / pooled) and got["c", 2] is None
    xs = [(rng.choice([None, *range(9)]), rng.choice([None, *range(5)])) for _ in range(200)]
    both = [(a, b) for a, b in xs if a is not None and b is not None]
    mean_rank = lambda v, vs: sum(x < v for x in vs) + (sum(x == v for x in vs) + 1) / 2
    ranks = [[mean_rank(r[i], [q[i] for q in both]) for r in both] for i in (0, 1)]
    df = spark.createDataFrame(xs, "a int, b int")
    assert A.spearman(df, "a", "b").first().rho == pytest.approx(np.corrcoef(ranks)[0, 1])
    for n in (1, 2, 300):
        assert {r.value: r["rank"] for r in A.average_ranks(df.where("a IS NOT NULL AND b IS NOT NULL"), "a", n).collect()} == {a: mean_rank(a, [q[0] for q in both]) for a, _ in both}
    scores = spark.createDataFrame([("x", 1, 0.2), ("y", 1, None), ("z", 1, 0.2), ("w", 2, 7.0)], "feature string, g int, score double")
    assert {r.feature: r["rank"] for r in A.ranked_within(scores, "score", ["g"]).collect()} == {"x": 1, "z": 1, "y": None, "w": 1}
    assert {r.feature: r["rank"] for r in A.ranked(scores, "score").collect()} == {"w": 1, "x": 2, "z": 2, "y": 4}


def test_correlation_groups_and_heatmap(spark):
    rows = [(float(i), 3.0 - 2 * i, float(i % 3), None if i % 2 else float(i), float(i) if i % 2 else None) for i in range(12)]
    wide = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    pairs = A.correlations(wide, list("abcde"))
    assert {(r.a, r.b): r.r for r in pairs.collect()}["d", "e"] is None
    assert A.redundancy_groups(pairs) == [["a", "b", "d", "e"]]
    scores = spark.createDataFrame([("p", "x", 1.0), ("p", "y", -3.0), ("q", "x", 2.0), ("r", "y", None), ("s", "x", -9.0)], "feature string, scenario string, d double")
    assert [r.feature for r in A.heatmap(scores, "d", ["x", "y"], 0).collect()] == ["s", "p", "q", "r"]
    assert [tuple(r) for r in A.heatmap(scores, "d", ["x", "y"], 2).collect()] == [("s", -9.0, None), ("p", 1.0, -3.0)]


def test_scenario_scores(spark):
    rng = random.Random(25)
    names = {1: "one", 2: "two", 3: "three"}
    rows = [(f"u{u}", s, q, "code", 1 if s == 1 else 2, f, v) for u in range(4) for s in names for q in (1, 2) for f, v in (("f", rng.gauss(s, 1)), ("k", 1.0), ("few", 1.0 * u if s == 2 and u < 1 else None))]
    schema = "user string, session int, q_id int, r_t string, version int, feature string, value double"
    rows += [("u0", 2, 1, "code", 1, "f", 99.0)]  # pasted: left out
    rows[0] = (*rows[0][:-1], float("inf"))
    got = {(r.session, r.feature): r for r in A.scenario_scores(spark.createDataFrame(rows, schema), "set", names).collect()}
    f2 = [r[6] for r in rows if r[5] == "f" and r[1] == 2 and r[4] == 2]
    rest = [r[6] for r in rows if r[5] == "f" and r[1] != 2 and math.isfinite(r[6])]
    pooled = math.sqrt((7 * statistics.variance(f2) + 14 * statistics.variance(rest)) / 21)
    assert got[2, "f"].d == pytest.approx((statistics.fmean(f2) - statistics.fmean(rest)) / pooled)
    assert (got[2, "f"].n_scenario, got[2, "f"].n_rest, got[2, "f"].missing_scenario, got[2, "f"].missing_rest) == (8, 15, 0, 1)
    values = f2 + rest
    x = np.array(values) / np.std(values)
    assert got[2, "f"].mi == pytest.approx(brute_information(x.tolist(), [1] * 8 + [0] * 15))
    assert (got[1, "k"].mi, got[1, "k"].d, got[1, "k"].status) == (0.0, None, "constant")
    assert (got[3, "few"].mi, got[3, "few"].mi_rank, got[3, "few"].status) == (None, None, "insufficient_observations")
    assert {got[s, "f"].mi_rank for s in names} == {1}
    df = spark.createDataFrame(rows, schema)
    for bad in (df.union(df), df.withColumn("session", F.lit(9))):
        with pytest.raises(PySparkException):
            A.scenario_scores(bad, "set", names).collect()
    with pytest.raises(ValueError, match="version"):
        A.scenario_scores(df.drop("version"), "set", names)


def test_shared_items_and_reports(spark):
    said = [(1, "u", "x"), (1, "u", "x"), (1, "v", "x"), (1, "v", "y"), (2, "u", "z")]
    df = spark.createDataFrame(said, "q int, user string, item string")
    assert {(r.q, r.item): (r.n_users, r.users, r.occurrence_share) for r in A.shared_by_users(df, ["q"], "user", "item", 1.0).collect()} == {(1, "x"): (2, 2, 0.75), (2, "z"): (1, 1, 1.0)}
    assert [tuple(r) for r in A.boilerplate_share(df, ["q"], "user", "item", 1.0).collect()] == [(1, 1, 2, 0.75)]
    features = spark.createDataFrame([("a",), ("b",), ("c",)], "feature string")
    chosen = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (2, "b")], "fold int, feature string")
    loss = spark.createDataFrame([("a", 0.1), ("a", 0.3), ("b", 0.5)], "feature string, importance double")
    report = A.importance_report(features, {"n": A.selection_stability(chosen), "p": E.importance_over_folds(loss)}, {"importance_mean": "rank"}, "importance_mean").collect()
    assert [(r.feature, r.n_folds, r.importance_mean, r.importance_n_folds, r["rank"]) for r in report] == [("b", 1, 0.5, 1, 1), ("a", 2, pytest.approx(0.2), 2, 2), ("c", None, None, None, 3)]


# Reshaping and evaluation


def test_reshape(spark):
    long = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "a", None), (2, "b", None)], "g int, feature string, value double")
    assert sorted(map(tuple, R.wide(long, ["g"], ["a", "b"]).collect())) == [(1, 1.0, None), (2, None, None)]
    lossy = R.wide_lossy(long, ["g"])
    assert lossy.columns == ["g", "a"] and lossy.count() == 1
    with pytest.raises(PySparkException, match="more than one value"):
        R.wide(long.unionByName(long), ["g"], ["a", "b"]).collect()
    left, right = spark.createDataFrame([(1, "l"), (2, "m")], "g int, x string"), spark.createDataFrame([(2, "n"), (1, "o")], "g int, y string")
    assert sorted(map(tuple, R.combine(left, right, ["g"]).collect())) == [(1, "l", "o"), (2, "m", "n")]
    for other, message in ((right.where("g = 1"), "one table only"), (right.union(right), "repeated")):
        with pytest.raises(PySparkException, match=message):
            R.combine(left, other, ["g"]).collect()
    versions = spark.createDataFrame([("u", 1), ("u", 2), ("v", 1)], "user string, version int")
    assert sorted(map(tuple, R.latest_version(versions, ["user"]).select("user", "version").collect())) == [("u", 2), ("v", 1)]
    sessions = spark.createDataFrame([(1,), (4,)], "session int")
    assert [[r.label for r in R.label(sessions, task).orderBy("session").collect()] for task in ("binary", "multiclass")] == [[0, 1], [0, 3]]
    with pytest.raises(ValueError, match="task"):
        R.label(sessions, "other")
    assert {r.feature: (r.n, r.n_known, r.n_missing) for r in R.quality(long).collect()} == {"a": (2, 1, 1), "b": (2, 0, 2)}


def test_groups_and_counts(spark):
    ev = spark.createDataFrame([("u", s, 1, t, v) for s, t, v in ((1, "code", 1), (2, "code", 1), (2, "code", 2), (2, "poem", 2), (3, "explanation", 1))], "user string, session int, q_id int, r_t string, version int")
    kept = G.human_typed(ev)
    assert sorted((r.session, r.version) for r in kept.collect()) == [(1, 1), (2, 2)]
    assert {(r.session, r.version): r.n_dropped for r in G.dropped_counts(ev).collect()} == {(2, 1): 1, (3, 1): 1}
    downs = kept.where("session = 1").withColumn("n_keydowns", F.lit(100))
    assert {r.session: r.n_keydowns for r in G.short_groups(kept, downs).collect()} == {2: 0}
    assert [tuple(r) for r in G.short_counts(kept, downs, 200).orderBy("session").collect()] == [(1, 1, 1), (2, 2, 1)]


def test_error_rates(spark):
    rng = random.Random(26)
    told = [(rng.randint(0, 2), rng.randint(0, 2)) for _ in range(90)]
    df = spark.createDataFrame(told, "y_true int, y_pred int")
    r = E.error_rates(df).first()
    own, others = [p for t, p in told if t == 0], [p for t, p in told if t]
    assert (r.frr, r.far) == pytest.approx((sum(map(bool, own)) / len(own), others.count(0) / len(others)))
    matrix = E.confusion_matrix(df, [0, 1, 2])
    rates = E.rates_of_matrix(matrix, [0, 1, 2])
    assert (rates["frr"], rates["far"]) == pytest.approx((r.frr, r.far))
    turned = [row[::-1] for row in matrix[::-1]]
    assert E.rates_of_matrix(turned, [2, 1, 0]) == rates
    assert rates["far_by_condition"] == pytest.approx({str(x.y_true): x.far for x in E.condition_far(df).collect()})
    assert E.rates_of_matrix([[0, 0], [3, 7]], [0, 1]) == {"frr": None, "far": 0.3}
    assert E.error_rates(df.where("y_true = 1")).first().frr is None
    for bad in ((matrix, [0, 1]), (matrix, [1, 2, 3]), ([[1]], [1])):
        with pytest.raises(ValueError):
            E.rates_of_matrix(*bad)
    with pytest.raises(ValueError, match="listed"):
        E.confusion_matrix(df, [0, 1])
    f1 = []
    for y in range(3):
        tp = sum(t == p == y for t, p in told)
        f1.append(2 * tp / (sum(t == y for t, _ in told) + sum(p == y for _, p in told)))
    got = E.f1_scores(df).first()
    assert got.macro_f1 == pytest.approx(statistics.fmean(f1)) and got.weighted_f1 == pytest.approx(sum(f * sum(t == y for t, _ in told) for y, f in enumerate(f1)) / 90)


def test_folds_search_and_selection(spark):
    df = spark.createDataFrame([(f"u{u}", s) for u in range(10) for s in range(5)], "user string, label int")
    folds = E.stratified_group_folds(df, "user", "label", 5)
    assert folds.groupBy("user").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty() and {r["count"] for r in folds.groupBy("fold").count().collect()} == {10}
    with pytest.raises(ValueError, match="participants"):
        E.stratified_group_folds(df, "user", "label", 5, most=20)
    tried = []
    best, score = E.genetic_search({"a": list(range(5)), "b": list(range(5))}, lambda g: tried.append((g["a"], g["b"])) or g["a"] + g["b"], 12, 6)
    assert score >= 7 and set(best) == {"a", "b"} and len(tried) == len(set(tried))
    scores = spark.createDataFrame([(f"f{i}", float(i) if i else None) for i in range(5)], "feature string, mi double")
    assert {r.feature for r in E.select_top_share(scores, 0.5).collect()} == {"f4", "f3"}
    assert E.select_top_share(scores, 0.01).count() == 1
    summed = E.summed_confusion(spark.createDataFrame([("m", 0, 1, 2), ("m", 0, 1, 3), ("m", 1, 1, 4)], "model string, y_true int, y_pred int, n int"), ["model"])
    assert sorted(map(tuple, summed.collect())) == [("m", 0, 1, 5), ("m", 1, 1, 4)]
    r = E.fold_summary(spark.createDataFrame([("m", 1.0), ("m", 3.0), ("m", None)], "model string, x double"), ["model"], ["x"], folds=5).first()
    assert (r.n_folds, r.x_mean, r.x_std, r.partial) == (3, 2.0, 1.0, True)
