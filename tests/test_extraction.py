"""Raw logs to tables: sources, validation, layout, registry, extraction, sinks, training, command line."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from typeloom import cli, config
from typeloom.functions import language as N
from typeloom.plans import extraction as X
from typeloom.plans import registry, training
from typeloom.sources import layout
from typeloom.sources import typing_logs as L
from typeloom.sources import validation as V

FOLDER = {1: "Bona fide", 2: "Transcribe", 3: "Mimicry", 4: "Paraphrasing", 5: "Deception"}


def key(ts, name, phase="keydown", **more):
    base = {"s_n": 1, "r_t": "code", "q_id": 1, "version": 1, "event_type": "key", "timestamp": ts}
    return base | {"data": {"key": name, "code": f"Key{name.upper()}", "key_event_phase": phase, "repeat": False, "line": 0, "ch": ts % 7}} | more


def put(root, user, session, keystrokes, responses, folder=None):
    at = root / user / (folder or FOLDER[session])
    at.mkdir(parents=True, exist_ok=True)
    for kind, content in (("keystrokes", keystrokes), ("responses", responses)):
        if content is not None:
            (at / f"s{session}_{kind}.json").write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")


@pytest.fixture
def logs(tmp_path):
    root = tmp_path / "cohort" / "raw"
    typed = [key(10 * i, "ab"[i % 2]) for i in range(4)] + [key(100, "a", "keyup"), key(120, "b", "keyup")]
    odd = [key(1, "a", q_id="x"), key(2, "a", event_type="environment_change", q_id=None, data={}), key(3, "a", version=None)]
    move = [key(200, "a", event_type="mouse", data={"x": 0, "y": i}) for i in (0, 3)]
    put(root, "p 1", 1, {"keystrokes": typed + odd + move, "questions": {"1": "name width = 5", "z": "no"}}, {"responses": [{"q_id": 1, "session": 1, "code": "n = 1\n# done\n", "explanation": "It is. It was so."}, {"q_id": None, "question": 1, "code": "lost"}, {"question": "7", "code": 12}], "questions": {"1": "second", "7": "other"}})
    mine = [key(5, "a", version=2), key(9, "a", "keyup", version=2), key(11, "b", version=1)]
    put(root, "p2", 2, {"keystrokes": mine, "questions": {}}, {"responses": [{"q_id": 1, "session": 2, "chatgptAnswer": "pasted", "retype": "typed = 2", "extra": 1}], "questions": {"1": "copy"}})
    put(root, "p3", 5, None, {"responses": []})
    put(root, "p4", 3, "{broken", {"responses": [{"q_id": 1, "code_version_2": "x"}], "questions": {}})
    return root


def test_loading(spark, logs):
    found = L.load(spark, str(logs))
    try:
        assert sorted(map(tuple, found.sessions.collect())) == [("p 1", 1), ("p2", 2)]  # p3 lacks a file, p4 can't be parsed
        ev = found.events
        assert {(r.user, r.n) for r in ev.groupBy("user").agg(F.count("*").alias("n")).collect()} == {("p 1", 8), ("p2", 3)}
        first = L.key_events(ev).where("ts = 10").first()
        assert (first.key, first.code, first.line, first.ch, first.repeat) == ("b", "KeyB", 0, 3, False)
        assert sorted(r.y for r in L.mouse_events(ev).collect()) == [0.0, 3.0]
        texts = {(r.user, r.q_id, r.r_t, r.version): r.text for r in found.responses.collect()}
        assert texts == {("p 1", 1, "code", 1): "n = 1\n# done\n", ("p 1", 1, "explanation", 1): "It is. It was so.", ("p 1", 7, "code", 1): "12", ("p2", 1, "code", 1): "pasted", ("p2", 1, "code", 2): "typed = 2"}
        assert {(r.user, r.q_id): r.prompt for r in found.questions.collect()} == {("p 1", 1): "name width = 5", ("p 1", 7): "other", ("p2", 1): "copy"}
        own = {(r.user, r.entry_pos): r.text for r in L.typed_responses(found.parsed.join(found.sessions, L.SESSION), "code").collect()}
        assert own == {("p 1", 0): "n = 1\n# done\n", ("p 1", 2): "12", ("p2", 0): "typed = 2"}
        assert L.payload_problems(ev).isEmpty()
        with pytest.raises(ValueError, match="poem"):
            L.typed_responses(found.parsed, "poem")
    finally:
        found.release()


def test_missing_and_ambiguous_logs(spark, logs, tmp_path):
    for root in (tmp_path / "nowhere", logs / "p3"):
        with pytest.raises(L.DatasetError):
            L.load(spark, str(root))
    put(logs, "p2", 2, None, {"responses": []}, folder="Transcription")  # the keystrokes lie in the other folder
    with pytest.raises(L.DatasetError, match="two folders"):
        L.complete_sessions(spark, str(logs))


def test_validation(spark, logs):
    found = {(r.user, r.kind, r.place, r.problem): tuple(r["keys"]) for r in V.objections(spark, str(logs)).collect()}
    assert ("p 1", "keystrokes", 7, "data lacks keys: environment_change") in found
    assert found["p3", "responses", None, "file lacks keys"] == ("questions",) and ("p4", "keystrokes", None, "not JSON") in found
    put(logs, "p5", 4, {"keystrokes": [{"event_type": "key"}, key(1, "a", event_type="blink"), key(1, "a", data={"key": "a"})], "questions": {}}, {"responses": [{"q_id": 1, "poem": "x"}], "questions": {}})
    found = {(r.kind, r.place, r.problem): tuple(r["keys"]) for r in V.objections(spark, str(logs)).where("user = 'p5'").collect()}
    assert found == {
        ("keystrokes", 0, "event lacks keys"): ("data", "q_id", "r_t", "s_n", "timestamp", "version"),
        ("keystrokes", 1, "unknown event type"): ("blink",),
        ("keystrokes", 2, "data lacks keys: key"): ("ch", "code", "key_event_phase", "line", "repeat"),
        ("responses", 0, "entry has no known field"): ("poem", "q_id"),
    }
    states = {r.user: tuple(r)[1:] for r in V.session_states(spark, str(logs)).collect()}
    assert states["p3"] == ("absent",) * 4 + ("missing keystrokes",) and states["p5"][3] == "4 issue(s)"
    assert "p2" not in states  # its folder's name isn't the canonical one
    assert [(r.user, r.session, r.n) for r in V.environment_changes(spark, str(logs)).collect()] == [("p 1", 1, 1)]


def test_layout(logs):
    (logs / "p2" / "Transcribe" / "s2_user_info (1).json").write_text("{}")
    moves = {m.source.name: m.target.relative_to(logs.resolve()).as_posix() for m in layout.plan(logs)}
    assert moves == {"s2_keystrokes.json": "p2/Transcription/s2_keystrokes.json", "s2_responses.json": "p2/Transcription/s2_responses.json", "s2_user_info (1).json": "p2/Transcription/s2_user_info.json"}
    assert len(layout.normalize(logs)) == 3 and (logs / "p2" / "Transcribe").exists()
    layout.normalize(logs, apply=True)
    assert not (logs / "p2" / "Transcribe").exists() and layout.plan(logs) == []
    manifest = json.loads((logs.parent / layout.MANIFEST).read_text())
    assert len(manifest["moves"]) == 3 and all(len(m["sha256"]) == 64 for m in manifest["moves"])
    put(logs, "p2", 2, {}, {}, folder="Transcribe")
    with pytest.raises(ValueError, match="same place"):
        layout.plan(logs)
    put(logs, "p1", 3, {}, {}, folder="Deception")
    with pytest.raises(ValueError, match="folder of session 5"):
        layout.plan(logs / ".." / "raw")


def test_registry_and_settings(tmp_path):
    names = registry.names()
    assert len(names) == len(set(names)) == 56
    assert names[0] == "tier1_code_kit_cv" and names[-1] == "tier3_llm_comment_to_code_ratio"
    assert [f.name for f in registry.chosen(only=["tier2_code_token_entropy"])] == ["tier2_code_token_entropy"]
    assert len(registry.chosen(without=names[:50])) == 6
    for bad in ({"only": ["x"]}, {"only": []}, {"without": names}, {"only": names[:1], "without": names[1:2]}):
        with pytest.raises(ValueError):
            registry.chosen(**bad)
    keys = registry.required_keys(registry.features())
    assert keys == {f"{k}.{j}" for k, js in {"tier1.keys": ("exclude_repeats", "deletion_keys", "insertion_special_keys"), "tier1.pause": ("long_pause_multiplier", "entropy_bins"), "tier1.burst": ("gap_threshold_ms",), "tier1.mouse": ("path_length_per_keys",), "tier1.filtering": ("sanity_check_min_keydown_count",), "tier2": ("text",), "tier2.indentation": ("canonical_unit",)}.items() for j in js}
    assert config.missing(config.DEFAULTS, keys) == []
    assert config.missing({"tier1": {"keys": 3}, "tier2": {"text": {}}}, keys) == sorted(keys - {"tier2.text"})
    assert config.knobs({"tier1": {"burst": {"gap_threshold_ms": 7}}}).burst_gap_ms == 7.0
    good, bad = tmp_path / "a.json", tmp_path / "b.json"
    good.write_text(json.dumps(config.DEFAULTS))
    bad.write_text("[]")
    assert config.load(good) == config.DEFAULTS and len(config.digest(good)) == 64
    for path in (bad, tmp_path / "none"):
        with pytest.raises(config.ConfigError):
            config.load(path)


KIT = N.PlainToolkit(stopwords=("is",))
PLAIN_ONLY = [n for n in registry.names() if not n.endswith(("noun_ratio", "verb_ratio", "adj_ratio", "adv_ratio"))]


def test_extraction_from_logs(spark, logs):
    found, raw = X.from_logs(spark, str(logs), only=PLAIN_ONLY, toolkit=KIT)
    try:
        rows = {(r.user, r.q_id, r.r_t, r.feature): r.value for r in found.long.collect()}
        groups = {k[:3] for k in rows}
        assert groups == {("p 1", 1, "code"), ("p 1", 1, "explanation"), ("p 1", 7, "code"), ("p2", 1, "code")}
        assert len(rows) == found.long.count() == 3 * 29 + 23
        assert rows["p 1", 1, "code", "tier2_code_comment_density"] == 0.5 and rows["p 1", 1, "code", "tier1_code_mouse_path_length"] == 75.0
        assert rows["p 1", 1, "code", "tier1_code_kit_cv"] == 0.0 and rows["p 1", 1, "code", "tier2_code_identifier_diversity_no_boilerplate"] == 1.0
        assert rows["p 1", 1, "explanation", "tier1_explanation_kit_cv"] is None and rows["p 1", 1, "explanation", "tier2_explanation_ttr"] == pytest.approx(4 / 5)
        assert rows["p2", 1, "code", "tier1_code_kht_cv"] is None and rows["p2", 1, "code", "tier3_llm_code_length_relative_to_prompt"] == pytest.approx(9 / 4)
        assert [tuple(r) for r in found.dropped.collect()] == [(2, 1, 1)]
        assert {(r.session, r.version): r.n_short for r in found.short.collect()} == {(1, 1): 3, (2, 2): 1}
        assert found.errors.isEmpty()
        only = X.extract(raw.events, raw.responses, None, only=["tier3_llm_blank_line_ratio"]).long
        assert only.count() == 3 and only.columns == X.LONG
    finally:
        raw.release()


def test_extraction_refuses(spark, logs):
    with pytest.raises(ValueError, match="toolkit"):
        X.extract(None, None, None)
    with pytest.raises(ValueError, match="noun_ratio"):
        X.extract(None, None, None, toolkit=KIT)
    with pytest.raises(config.ConfigError, match="entropy_bins"):
        X.extract(None, None, None, settings={"tier1": {"keys": {}}}, only=["tier1_code_kit_pause_entropy"])


def rows_of(folder):
    out = []
    for part in sorted(folder.glob("part-*.csv")):
        with part.open(newline="") as f:
            out += list(csv.DictReader(f))
    return out


def test_publication(spark, logs):
    folder = logs.parent / "processed"
    found, raw = X.from_logs(spark, str(logs), only=PLAIN_ONLY, toolkit=KIT)
    try:
        about = X.publish(spark, found, raw.sessions, str(folder), "cohort")
        assert (about["groups"], about["questions"], about["feature_count"], about["long_rows"]) == (4, 3, 52, 110)
        assert about["dropped_groups"] == {"s2/v1": 1} and json.loads((folder / "extraction_metadata.json").read_text()) == about
        assert {p.name for p in folder.iterdir() if not p.name.startswith(".")} == {"features.csv", "features_wide.csv", "features_questions.csv", "feature_catalog.csv", "feature_quality.csv", "coverage.csv", "extraction_metadata.json"}
        wide = {(r["user"], r["q_id"], r["r_t"]): r for r in rows_of(folder / "features_wide.csv")}
        assert wide["p2", "1", "code"]["scenario"] == "Transcription" and wide["p2", "1", "code"]["label"] == "1" and wide["p2", "1", "code"]["tier1_code_kht_cv"] == ""
        joint = {(r["user"], r["q_id"]): r for r in rows_of(folder / "features_questions.csv")}
        assert joint["p 1", "1"]["tier2_code_comment_density"] == "0.5" and joint["p 1", "1"]["tier2_explanation_ttr"] == "0.8"
        assert {r["session"]: r["complete_participants"] for r in rows_of(folder / "coverage.csv")} == {"1": "1", "2": "1", "3": "0", "4": "0", "5": "0"}
        assert {(r["r_t"], r["observations"], r["valid"]) for r in rows_of(folder / "feature_quality.csv") if r["feature"] == "tier1_code_kit_cv"} == {("code", "3", "1")}
        assert L.read_features(spark, str(folder / "features.csv")).where("value IS NOT NULL AND feature = 'tier2_code_comment_density'").count() == 3

        timing = X.timing_long(raw.events, ["a->b", "b->a"])
        spine = found.long.select("user", "session", "q_id", "r_t", "version").distinct()
        told = X.publish_timing(spark, spine, timing, str(folder), "cohort", ["a->b", "b->a"])
        assert (told["groups"], told["features"]) == (4, 33 * 6)
        table = {(r["user"], r["q_id"], r["r_t"]): r for r in rows_of(folder / "features_timing.csv")}
        assert float(table["p 1", "1", "code"]["kht_a_mean"]) == 100.0 and table["p2", "1", "code"]["kht_a_mean"] == ""
        both = X.combined(X.wide_table(found.long, "cohort", PLAIN_ONLY), X.timing_table(spine, timing, "cohort", ["kht_a_mean"]))
        assert both.count() == 4 and "kht_a_mean" in both.columns and "tier1_code_kit_cv" in both.columns

        before = (folder / "features.csv").stat().st_mtime_ns
        broken = X.Extraction(found.long, found.dropped, found.short, spark.createDataFrame([("f", 2, 2)], "feature string, n int, n_errors int"), found.features, found.settings)
        with pytest.raises(RuntimeError, match="nothing is published"):
            X.publish(spark, broken, raw.sessions, str(folder), "cohort")
        with pytest.raises(ValueError), X.Publication(spark, str(folder)) as out:
            out.table("features.csv", spark.range(1))
            raise ValueError
        assert (folder / "features.csv").stat().st_mtime_ns == before and not list(folder.parent.glob("*.staged-*"))
    finally:
        raw.release()


def test_training(spark, tmp_path):
    import random

    rng = random.Random(31)
    rows = [(int(label), f"u{u}", label * 9.0 + rng.random(), rng.random() if rng.random() < 0.8 else None, rng.random()) for u in range(8) for label in (0, 1) for _ in range(3)]
    df = spark.createDataFrame(rows, "label int, user_id string, good double, weak double, noise double")
    features, root = ["good", "weak", "noise"], str(tmp_path / "runs")
    run = training.Run("forest", "binary", features, share=0.7, params={"numTrees": 5, "maxDepth": 2, "featureSubsetStrategy": "all", "seed": 1})
    kept = []
    assert training.train_folds(df, run, root, folds=[1, 2], k=4, keep_model=lambda model, at: kept.append(model)) == [1, 2]
    assert training.train_folds(df, run, root, folds=[2, 1], k=4) == []  # done
    results = training.collected(spark, root, "binary", "forest", 4)
    assert [r["fold"] for r in results] == [1, 2] and all(r["selected_features"][0] == "good" and len(r["selected_features"]) == 2 for r in results)
    assert all(r["test_accuracy"] == 1.0 and r["far"] == 0.0 and sum(map(sum, r["confusion_matrix"])) == r["n_test"] for r in results)
    told = training.summary(results, 4)
    assert told["partial"] and told["accuracy"] == {"mean": 1.0, "std": 0.0, "per_fold": [1.0, 1.0]} and told["summed_confusion_matrix"] == [[12, 0], [0, 12]]
    assert training.summary([]) is None
    old = {k: v for k, v in results[0].items() if k not in ("far", "frr", "labels")}
    assert training.backfilled(old, "binary") == results[0] and training.backfilled({}, "binary") == {}

    from typeloom.plans import evaluation as E

    test = df.where("user_id IN ('u1', 'u2')").withColumn("label", F.col("label").cast("double"))
    lost = {r.feature: r.importance for r in E.permutation_importance(kept[0], test.select("label", *features), ["good", "noise"], repeats=2, seed=5).collect()}
    assert lost["good"] > 0.1 > abs(lost["noise"])
    moved = E.shuffled(test, "good", 3, 12)
    same = lambda d, c: sorted(map(repr, (r[0] for r in d.select(c).collect())))
    assert same(moved, "good") == same(test, "good") and same(moved, "noise") == same(test, "noise") and moved.columns == test.columns


@pytest.mark.parametrize(("kind", "params"), [("svm", {"maxIter": 5}), ("svm_poly", {"degree": 2, "maxIter": 5}), ("mlp", {"hidden": [4], "maxIter": 20}), ("boosted", {"maxIter": 3})])
def test_classifiers(spark, kind, params):
    rows = [(y, 2.0 * y + 0.1 * (i % 5), None if i % 4 == 0 else float(i % 3)) for i in range(24) for y in (i % 2,)]
    df = spark.createDataFrame(rows, "label int, a double, b double")
    run = training.Run(kind, "binary", ["a", "b"])
    model = run.fitted(df, ["a", "b"], dict(params), [0, 1])
    told = [(r.y_true, r.y_pred) for r in run.predicted(model, df, [0, 1]).collect()]
    assert sum(t == p for t, p in told) >= 22
    with pytest.raises(ValueError, match="classifier"):
        training.Run("oracle", "binary", ["a"]).fitted(df, ["a"], {}, [0, 1])


def test_command_line(spark, logs, capsys):
    assert cli.main(["list-features"]) == 0 and len(capsys.readouterr().out.split()) == 56
    out = str(logs.parent / "long")
    few = ["tier1_code_kit_cv", "tier3_llm_blank_line_ratio"]
    assert cli.main(["extract", "--data-root", str(logs), "--out", out, "--features", *few]) == 0
    assert L.read_features(spark, out).count() == 6
    assert "6 rows" in capsys.readouterr().out
    assert cli.main(["extract", "--data-root", str(logs / "none"), "--out", out, "--features", *few]) == 1
    assert cli.main(["extract", "--data-root", str(logs), "--out", out, "--features", "nope"]) == 1
    assert "unknown features" in capsys.readouterr().err
    assert cli.main(["validate", "--data-root", str(logs)]) == 1 and "missing keystrokes" in capsys.readouterr().out
    assert cli.main(["normalize", str(logs)]) == 0 and "dry run" in capsys.readouterr().out
