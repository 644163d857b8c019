"""Raw typing logs: <root>/<user>/<scenario folder>/s{n}_{keystrokes,responses}.json.

Which sessions are complete is told from the paths alone; files of complete sessions are parsed
once, in one distributed read, and events, responses and questions are views of that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Scenario and folder names by session; response fields with their type and version, in order of
#: precedence; the field that holds the typed answer, by session; event and payload keys that strict validation wants.
SCENARIOS = {1: "Bona fide", 2: "Transcription", 3: "Mimicry", 4: "Paraphrasing", 5: "Deception"}
FOLDERS = {"Bona fide": 1, "Bonafide": 1, "Transcription": 2, "Transcribe": 2, "Mimicry": 3, "Paraphrasing": 4, "Paraphrase": 4, "Deception": 5}
FIELDS = (
    ("code", "code", 1), ("explanation", "explanation", 1), ("chatgptAnswer", "code", 1), ("retype", "code", 2),
    ("explanation_version_1", "explanation", 1), ("explanation_version_2", "explanation", 2), ("code_version_1", "code", 1), ("code_version_2", "code", 2),
)
TYPED_FIELDS = {
    "code": {1: "code", 2: "retype", 3: "code_version_2", 4: "code_version_2", 5: "retype"},
    "explanation": {1: "explanation", 2: "explanation_version_2", 3: "explanation_version_2", 4: "explanation_version_2", 5: "explanation_version_2"},
}
EVENT_KEYS = ("s_n", "r_t", "q_id", "version", "event_type", "data", "timestamp")
PAYLOAD = {"key": "key,code,key_event_phase,repeat,line,ch", "mouse": "x,y", "cursor": "line,ch", "environment_change": "viewportWidth,viewportHeight,devicePixelRatio,viewportScale"}

KINDS = ("keystrokes", "responses")
FILES = "s[1-5]_{keystrokes,responses}.json"
CONTENT = f"keystrokes array<struct<{', '.join(f'{k}: string' for k in EVENT_KEYS)}>>, responses array<map<string, string>>, questions map<string, string>, _corrupt_record string"
SESSION = ["user", "session"]


class DatasetError(Exception):
    """There is no complete session to read, or its folders are ambiguous."""


def _lookup(table: dict, key: Column) -> Column:
    """The value of a small fixed table, NULL for another key."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _placed(path: Column) -> list[Column]:
    """user, folder, session and kind of a file, from its path."""
    decoded, pattern = F.url_decode(path), r"([^/]+)/([^/]+)/s(\d)_([a-z]+)\.json$"
    part = lambda k: F.regexp_extract(decoded, pattern, k)
    return [part(1).alias("user"), part(2).alias("folder"), part(3).cast("int").alias("session"), part(4).alias("kind")]


def _in_place(df: DataFrame, folders: dict[str, int]) -> DataFrame:
    return df.where(_lookup(folders, F.col("folder")) == F.col("session"))


def files(spark: SparkSession, root: str, folders: dict[str, int] = FOLDERS) -> DataFrame:
    """user, folder, session, kind of each log file; contents aren't read."""
    try:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", FILES).load(root)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        raise DatasetError(f"nothing at {root}") from missing
    return _in_place(listed.select(*_placed(F.col("path"))), folders)


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """user, session, has_keystrokes, has_responses, ambiguous: a row for each session that has a file.

    A session is ambiguous if its files lie in two folders, of whatever kind each of them is.
    """
    has = lambda kind: F.bool_or(F.col("kind") == kind).alias(f"has_{kind}")
    return files(spark, root).groupBy(SESSION).agg(*[has(kind) for kind in KINDS], (F.countDistinct("folder") > 1).alias("ambiguous"))


def complete_sessions(spark: SparkSession, root: str) -> DataFrame:
    """user, session of the sessions with both files; an error without any, or with an ambiguous one."""
    found = sessions(spark, root)
    whole = F.col("has_keystrokes") & F.col("has_responses")
    n, twice = found.agg(F.count_if(whole), F.max(F.when(F.col("ambiguous"), F.struct(*SESSION)))).first()
    if twice is not None:
        raise DatasetError(f"session {twice.session} of {twice.user} has files in two folders")
    if not n:
        raise DatasetError(f"no session with both files under {root}")
    return found.where(whole).select(SESSION)


@dataclass(frozen=True)
class Logs:
    """Views of one parse of the logs; ``release`` frees what is kept of it."""

    events: DataFrame
    responses: DataFrame
    questions: DataFrame
    sessions: DataFrame
    parsed: DataFrame

    def release(self) -> None:
        self.parsed.unpersist()


def load(spark: SparkSession, root: str) -> Logs:
    """All complete sessions. One with a file that can't be parsed is left out whole."""
    pairs = complete_sessions(spark, root)
    read = spark.read.schema(CONTENT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", FILES).json(root)
    # Spark parses a file for its _corrupt_record only if another of its columns is asked for too.
    parts = F.coalesce(F.size("keystrokes"), F.lit(0)) + F.coalesce(F.size("responses"), F.lit(0))
    broken = F.col("_corrupt_record").isNotNull() | (parts < -2)
    rows = _in_place(read.select("keystrokes", "responses", "questions", broken.alias("broken"), *_placed(F.col("_metadata.file_path"))), FOLDERS)
    parsed = rows.join(pairs, SESSION).persist(StorageLevel.MEMORY_AND_DISK)
    readable = parsed.groupBy(SESSION).agg(F.bool_or("broken").alias("broken")).where(~F.col("broken")).select(SESSION)
    whole = parsed.join(readable, SESSION, "left_semi")
    return Logs(events_of(whole), responses_of(whole), questions_of(whole), readable, parsed)


def events_of(parsed: DataFrame) -> DataFrame:
    """user, session, q_id, r_t, version, event_type, data (JSON text), ts, seq; malformed events and environment changes left out."""
    e = parsed.where("kind = 'keystrokes'").select(*SESSION, F.posexplode("keystrokes").alias("seq", "e")).select(*SESSION, "seq", "e.*")
    number = lambda c, kind: F.expr(f"try_cast({c} AS {kind})")
    out = e.where(F.coalesce("event_type", F.lit("")) != "environment_change").select(
        *SESSION, number("q_id", "int").alias("q_id"), "r_t", number("version", "int").alias("version"), "event_type",
        F.coalesce("data", F.lit("{}")).alias("data"), number("timestamp", "long").alias("ts"), "seq",
    )
    return out.dropna(subset=["q_id", "r_t", "version", "event_type", "ts"])


def entries_of(parsed: DataFrame) -> DataFrame:
    """user, session, q_id, entry_pos and m, an entry's fields; an entry without a usable id is left out.

    ``question`` is the id only of an entry that has no ``q_id`` at all, not of one whose q_id is bad.
    """
    r = parsed.where("kind = 'responses'").select(*SESSION, F.posexplode("responses").alias("entry_pos", "m"))
    id_ = F.when(F.map_contains_key("m", F.lit("q_id")), F.element_at("m", "q_id")).otherwise(F.element_at("m", "question"))
    return r.withColumn("id", id_).withColumn("q_id", F.expr("try_cast(id AS int)")).where(F.col("q_id").isNotNull()).drop("id")


def responses_of(parsed: DataFrame) -> DataFrame:
    """user, session, q_id, r_t, version, text, source_field, entry_pos, field_pos; unknown and null fields left out."""
    named = ("source_field", "r_t", "version", "field_pos")
    fields = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(named, (*field, i), strict=True)]) for i, field in enumerate(FIELDS)])
    x = entries_of(parsed).withColumn("f", F.explode(fields)).withColumn("text", F.element_at("m", F.col("f.source_field")))
    return x.where(F.col("text").isNotNull()).select(*SESSION, "q_id", "f.r_t", "f.version", "text", "f.source_field", "entry_pos", "f.field_pos")


def typed_responses(parsed: DataFrame, r_t: str) -> DataFrame:
    """user, session, q_id, entry_pos, text: each entry's typed answer, from the one field that a session has it in."""
    if r_t not in TYPED_FIELDS:
        raise ValueError(f"unknown response type {r_t!r}")
    field = F.coalesce(_lookup(TYPED_FIELDS[r_t], F.col("session")), F.raise_error(F.concat(F.lit("no response field for session "), F.col("session").cast("string"))))
    return entries_of(parsed).select(*SESSION, "q_id", "entry_pos", F.element_at("m", field).alias("text"))


def questions_of(parsed: DataFrame) -> DataFrame:
    """user, session, q_id, prompt; the keystrokes file's wins."""
    x = parsed.select(*SESSION, F.col("kind"), F.explode("questions").alias("id", "prompt")).withColumn("q_id", F.expr("try_cast(id AS int)"))
    first = Window.partitionBy(*SESSION, "q_id").orderBy("kind", "id")  # "keystrokes" comes before "responses"
    return x.where(F.col("q_id").isNotNull()).withColumn("rn", F.row_number().over(first)).where("rn = 1").select(*SESSION, "q_id", "prompt")


def key_events(ev: DataFrame) -> DataFrame:
    d = F.from_json("data", "key string, code string, key_event_phase string, repeat boolean, line int, ch int")
    return ev.where("event_type = 'key'").withColumn("d", d).select("*", "d.key", "d.code", F.col("d.key_event_phase").alias("phase"), "d.repeat", "d.line", "d.ch").drop("d", "data")


def mouse_events(ev: DataFrame) -> DataFrame:
    return ev.where("event_type = 'mouse'").withColumn("d", F.from_json("data", "x double, y double")).select("*", "d.x", "d.y").drop("d", "data")


def cursor_events(ev: DataFrame) -> DataFrame:
    return ev.where("event_type = 'cursor'").withColumn("d", F.from_json("data", "line int, ch int")).select("*", "d.line", "d.ch").drop("d", "data")


def payload_problems(ev: DataFrame) -> DataFrame:
    """event_type, missing, unknown, n: payload keys that strict validation objects to."""
    there = F.coalesce(F.json_object_keys("data"), F.array().cast("array<string>"))
    want = F.split(F.coalesce(_lookup(PAYLOAD, F.col("event_type")), F.lit("")), ",")
    x = ev.where(F.col("event_type").isin(*PAYLOAD)).select("event_type", F.array_sort(F.array_except(want, there)).alias("missing"), F.array_sort(F.array_except(there, want)).alias("unknown"))
    return x.where("size(missing) > 0 OR size(unknown) > 0").groupBy("event_type", "missing", "unknown").agg(F.count("*").alias("n"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A long table of features from CSV: an empty value is NULL."""
    schema = "user string, session int, q_id int, r_t string, version int, tier string, feature string, value double"
    return spark.read.schema(schema).option("header", True).csv(path)


def write_long(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Sink: partial output never replaces a table, as Spark commits a job's files together."""
    (df.write.mode("overwrite").option("header", True).csv if kind == "csv" else df.write.mode("overwrite").parquet)(path)
