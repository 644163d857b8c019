"""Strict validation of raw logs: every objection to a file, and each session's state. Canonical folder names only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.sources import typing_logs as L

CANONICAL = {name: session for session, name in L.SCENARIOS.items()}
OBJECTION = "place int, problem string, keys array<string>"
TOP = {"keystrokes": ("keystrokes", "questions"), "responses": ("responses", "questions")}


def _objection(place: Column, problem: Column, keys: Column) -> Column:
    return F.struct(place.cast("int").alias("place"), problem.alias("problem"), F.array_sort(keys).alias("keys"))


def _missing(wanted: Column, there: Column) -> Column:
    return F.array_except(wanted, F.coalesce(there, F.array().cast("array<string>")))


def _names(values) -> Column:
    return F.array(*map(F.lit, values))


def event_objection(e: Column, place: Column) -> Column:
    """What is wrong with an event, a map of its fields; NULL if nothing."""
    kind = e["event_type"]
    keys = _missing(_names(L.EVENT_KEYS), F.map_keys(e))
    payload = F.split(L._lookup(L.PAYLOAD, F.coalesce(kind, F.lit(""))), ",")
    data = _missing(payload, F.json_object_keys(e["data"]))
    return (
        F.when(F.size(keys) > 0, _objection(place, F.lit("event lacks keys"), keys))
        .when(payload.isNull(), _objection(place, F.lit("unknown event type"), F.array(kind)))
        .when(F.size(data) > 0, _objection(place, F.concat(F.lit("data lacks keys: "), kind), data))
    )


def entry_objection(m: Column, place: Column) -> Column:
    """NULL if a response entry has a field that is read."""
    known = F.arrays_overlap(F.map_keys(m), _names([f for f, _, _ in L.FIELDS]))
    return F.when(~known, _objection(place, F.lit("entry has no known field"), F.map_keys(m)))


def _parsed(spark: SparkSession, root: str) -> DataFrame:
    """user, folder, session, kind, top (a map of the file's fields as JSON texts, NULL if it can't be parsed)."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", L.FILES).text(root)
    placed = text.select(*L._placed(F.col("_metadata.file_path")), F.from_json("value", "map<string, string>").alias("top"))
    return L._in_place(placed, CANONICAL)


def objections(spark: SparkSession, root: str) -> DataFrame:
    """user, session, kind, place (of the event or entry, NULL for the file), problem, keys."""
    rows = _parsed(spark, root)
    empty = F.array().cast(f"array<struct<{OBJECTION.replace('place int', 'place: int').replace('problem string', 'problem: string').replace('keys array', 'keys: array')}>>")
    parts = F.from_json(F.coalesce(F.when(F.col("kind") == "keystrokes", F.col("top")["keystrokes"]).otherwise(F.col("top")["responses"]), F.lit("[]")), "array<map<string, string>>")
    found = F.transform(parts, lambda e, i: F.when(F.col("kind") == "keystrokes", event_objection(e, i)).otherwise(entry_objection(e, i)))
    wanted = F.when(F.col("kind") == "keystrokes", _names(TOP["keystrokes"])).otherwise(_names(TOP["responses"]))
    lacking = _missing(wanted, F.map_keys("top"))
    of_file = (
        F.when(F.col("top").isNull(), F.array(_objection(F.lit(None), F.lit("not JSON"), F.array().cast("array<string>"))))
        .when(F.size(lacking) > 0, F.array(_objection(F.lit(None), F.lit("file lacks keys"), lacking)))
        .otherwise(empty)
    )
    each = F.concat(of_file, F.coalesce(F.filter(found, lambda x: x.isNotNull()), empty))
    return rows.select("user", "session", "kind", F.explode(each).alias("x")).select("user", "session", "kind", "x.*")


def session_states(spark: SparkSession, root: str) -> DataFrame:
    """user and s1 to s5: ``ok``, ``n issue(s)``, ``missing keystrokes``, ``missing responses`` or ``absent``."""
    there = L.files(spark, root, CANONICAL)
    has = lambda kind: F.bool_or(F.col("kind") == kind)
    files = there.groupBy("user", "session").agg(has("keystrokes").alias("k"), has("responses").alias("r"))
    issues = objections(spark, root).groupBy("user", "session").agg(F.count("*").alias("n"))
    state = (
        F.when(~F.col("k"), F.lit("missing keystrokes"))
        .when(~F.col("r"), F.lit("missing responses"))
        .when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" issue(s)")))
        .otherwise(F.lit("ok"))
    )
    told = files.join(issues, ["user", "session"], "left").select("user", F.concat(F.lit("s"), F.col("session").cast("string")).alias("s"), state.alias("state"))
    return told.groupBy("user").pivot("s", [f"s{k}" for k in L.SCENARIOS]).agg(F.first("state")).na.fill("absent")


def environment_changes(spark: SparkSession, root: str) -> DataFrame:
    """user, session, n: events of a session's surroundings, known and not used."""
    events = F.from_json(F.coalesce(F.col("top")["keystrokes"], F.lit("[]")), "array<map<string, string>>")
    rows = _parsed(spark, root).where("kind = 'keystrokes'").select("user", "session", F.explode(events).alias("e"))
    return rows.where(F.col("e")["event_type"] == "environment_change").groupBy("user", "session").agg(F.count("*").alias("n"))
