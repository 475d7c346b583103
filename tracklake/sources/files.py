"""Readers and writers of the file formats: metadata, MOT rows, COCO annotations, JSON lines, run documents."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions import text as T

ROSTER = "array<struct<player_id:string,player_name:string,team_name:string,jersey_number:string,position:string,nominal_position:string>>"
MOT_FIELDS = ("frame", "track_id", "x", "y", "width", "height", "confidence", "class_id", "visibility")


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """player_id, player_name, team_name, jersey_number, position of a metadata document."""
    doc = spark.read.schema(f"rosters map<string,{ROSTER}>").json(path, multiLine=True)
    p = doc.select(F.explode("rosters").alias("team", "players")).select("team", F.posexplode("players").alias("nr", "p"))
    team = F.coalesce("p.team_name", "team")
    number = T.normalize_number(F.col("p.jersey_number"))
    return p.select(
        F.coalesce("p.player_id", T.player_key(team, F.col("p.player_name"), number)).alias("player_id"),
        F.col("p.player_name").alias("player_name"),
        team.alias("team_name"),
        number.alias("jersey_number"),
        F.coalesce("p.nominal_position", "p.position", F.lit("?")).alias("position"),
    )


def read_mot(spark: SparkSession, path: str) -> DataFrame:
    """MOT rows; lines with fewer than seven fields are skipped, the last two fields are optional."""
    lines = spark.read.text(path).select(F.split("value", ",").alias("f")).where(F.size("f") >= 7)
    number = lambda i: F.trim(F.get("f", F.lit(i))).try_cast("double")
    whole = {0, 1, 7}
    return lines.select(*[(number(i).cast("int") if i in whole else number(i)).alias(c) for i, c in enumerate(MOT_FIELDS)])


def read_sequence_info(spark: SparkSession, path: str) -> DataFrame:
    """Sequence settings of an INI file; zero means null."""
    text = spark.read.text(path, wholetext=True)
    field = lambda name: F.nullif(F.regexp_extract("value", rf"(?mi)^{name}\s*=\s*([0-9]+)", 1), F.lit(""))
    num = lambda name: F.nullif(field(name).cast("int"), F.lit(0))
    return text.select(num("frameRate").alias("fps"), num("seqLength").alias("frames"), num("imWidth").alias("width"), num("imHeight").alias("height"))


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """One row per annotation: gt_id, file_name, frame, category fields and the box as corners."""
    schema = (
        "images array<struct<id:long,file_name:string>>, categories array<struct<id:long,name:string>>, "
        "annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>>>"
    )
    doc = spark.read.schema(schema).json(path, multiLine=True)
    rows = lambda c: doc.select(F.explode(c).alias("x")).select("x.*")
    images = rows("images").select(F.col("id").alias("image_id"), "file_name")
    categories = rows("categories").select(F.col("id").alias("category_id"), T.parse_category(F.col("name")).alias("c"))
    box = lambda i: F.get("bbox", F.lit(i))
    return (
        rows("annotations")
        .join(images, "image_id")
        .join(categories, "category_id")
        .select(
            F.col("id").alias("gt_id"), "file_name", T.frame_of_file(F.col("file_name")).alias("frame"), "c.*",
            box(0).alias("x1"), box(1).alias("y1"), (box(0) + box(2)).alias("x2"), (box(1) + box(3)).alias("y2"),
        )
    )


def read_training_rows(spark: SparkSession, path: str) -> DataFrame:
    """Candidate rows of a JSON-lines file; blank lines are skipped, a file without rows is an error."""
    rows = spark.read.schema("features array<double>, label int, track_id string, candidate_player_id string").json(path).where("features is not null")
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    return rows


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """Observations of a run document, one row each."""
    obs = "array<struct<frame_index:int,timestamp:double,bbox:array<double>,detection_confidence:double>>"
    doc = spark.read.schema(f"track_id string, resolved_player_id string, resolved_confidence double, observations {obs}").json(path, multiLine=True)
    return doc.select("track_id", "resolved_player_id", "resolved_confidence", F.explode("observations").alias("o")).select(
        "track_id", "resolved_player_id", "resolved_confidence", "o.*"
    )


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    """team and name of the players that a clip shows; entries that are counts (referees, goalkeepers) have the count instead."""
    doc = spark.read.schema("expected_visible map<string,string>").json(path, multiLine=True)
    rows = doc.select(F.explode("expected_visible").alias("team", "entry"))
    names = F.from_json("entry", "players array<struct<name:string>>")["players"]["name"]
    return rows.select("team", F.explode_outer(names).alias("name"), F.col("entry").try_cast("int").alias("count")).where("name is not null or count is not null")


def observation_documents(obs: DataFrame) -> DataFrame:
    """Observations as written: head and body embeddings stay out, the appearance embedding stays."""
    return obs.drop("head_embedding", "body_embedding")


def track_documents(obs: DataFrame, row_fields: list[str], order: str) -> DataFrame:
    """Nested track documents: one row per track with its observations in order."""
    item = F.struct(order, *[c for c in row_fields if c != order])
    return obs.groupBy("track_id").agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("num_observations"),
        F.array_sort(F.collect_list(item)).alias("observations"),
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_document(doc: object, path: str) -> None:
    """A small document of the driver (metadata, manifest, runtime, benchmark) as pretty JSON; its folders are made."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2, ensure_ascii=False)
        f.write("\n")


def to_document(df: DataFrame, limit: int = 100_000) -> str:
    """A small result as one pretty JSON document; more rows than ``limit`` are an error, not a cut."""
    rows = df.toJSON().take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: use write_json")
    return json.dumps([json.loads(r) for r in rows], indent=2, ensure_ascii=False)


def provenance(summary: DataFrame, changes: DataFrame) -> DataFrame:
    """The summary with where each change of a track came from: one map of (field, source) for each track.

    changes: track_id, field (as identity_stitched_from, label_inherited_from), source.
    """
    maps = changes.groupBy("track_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("field", "source")))).alias("provenance"))
    return summary.join(maps, "track_id", "left")


def summary_rows(best: DataFrame, ranked: DataFrame, extents: DataFrame, top: int = 5) -> DataFrame:
    """Track summaries with rounded times and scores and the best candidates."""
    item = F.struct("rank", "candidate", F.round("score", 4).alias("score"))
    lists = ranked.where(F.col("rank") <= top).groupBy("track_id").agg(F.array_sort(F.collect_list(item)).alias("candidates"))
    return extents.join(best, "track_id", "left").join(lists, "track_id", "left").select(
        "track_id", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), F.round("duration", 3).alias("duration"),
        "candidate", F.round("score", 4).alias("score"), "candidates",
    )


def deep_merge(base: dict, override: dict) -> dict:
    """The base with the override's values; nested mappings are merged."""
    out = dict(base)
    for k, v in override.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(text: str) -> dict:
    import yaml

    got = yaml.safe_load(text) or {}
    if not isinstance(got, dict):
        raise ValueError("a configuration must be a mapping")
    return got
