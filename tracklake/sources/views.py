"""Engine views over the driver's tables: observations, fragments, boxes, roster, appearance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAGMENT_GAP_S = 24 * 3600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 1e6).alias("ts_s"),
        F.regexp_extract("props", r"([0-9]+)", 1).cast("int").alias("k"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per observation of a track, with one weighted candidate label."""
    return _events(spark, sf_dir).select(
        F.col("user_id").alias("track_id"),
        F.col("event_id").alias("seq"),
        "ts_s",
        F.floor(F.col("ts_s") / 3600).cast("long").alias("frame_index"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("quality"),
        (F.col("k") / 99.0).alias("prob"),
        F.col("event_type").alias("candidate"),
    )


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations cut into fragments where a user pauses for more than a day."""
    by_user = Window.partitionBy("user_id").orderBy("event_id")
    gap = F.col("ts_s") - F.lag("ts_s").over(by_user)
    return (
        _events(spark, sf_dir)
        .withColumn("cut", (F.coalesce(gap, F.lit(0.0)) > FRAGMENT_GAP_S).cast("int"))
        .select(
            (F.col("user_id") * 1000 + F.sum("cut").over(by_user.rowsBetween(Window.unboundedPreceding, 0))).alias("track_id"),
            "user_id",
            F.col("event_id").alias("seq"),
            "ts_s",
            (F.col("k") * 10.0).alias("x"),
            (F.col("value") * 3).alias("y"),
            F.least(F.lit(1.0), F.col("value") / 100).alias("quality"),
            (F.col("k") / 99.0).alias("prob"),
            F.col("event_type").alias("candidate"),
        )
    )


def gt_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x1, y1 = F.col("k") * 10.0, F.col("value") * 3
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("gt_id"),
        F.floor(F.col("ts_s") / 3600).cast("long").alias("frame"),
        F.col("user_id").alias("name"),
        F.col("event_type").isin("click", "purchase").alias("visible"),
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + 20 + 4 * F.pmod("event_id", F.lit(5))).alias("x2"),
        (y1 + 48).alias("y2"),
    )


def pred_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections: a tenth is missing, boxes are shifted, some tracks change or mix identities."""
    g = gt_boxes(spark, sf_dir).where(F.pmod("gt_id", F.lit(10)) != 0)
    dx, dy = F.pmod("gt_id", F.lit(7)), F.pmod("gt_id", F.lit(11))
    mixed = F.when(F.pmod("gt_id", F.lit(13)) == 0, 1).otherwise(0)
    track = (F.col("name") + mixed) * 10 + F.expr("pmod(gt_id, 10000) div 4000")
    return g.select(
        F.col("gt_id").alias("pred_id"),
        "frame",
        track.alias("track_id"),
        (F.col("x1") + dx).alias("x1"),
        (F.col("y1") + dy).alias("y1"),
        (F.col("x2") + dx).alias("x2"),
        (F.col("y2") + dy).alias("y2"),
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("player"), F.col("r_name").alias("team"), F.col("n_nationkey").cast("string").alias("jersey")
    )


def appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.expr("vec_id div 10").alias("frame"),
        F.col("label").alias("identity"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def mot_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("sequence"), F.col("l_suppkey").alias("track_id"), F.col("l_linenumber").alias("frame")
    )


def squad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roster with few jersey numbers, so that teams share them, and positions; nr is the roster's order."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nr = F.col("n_nationkey").cast("long")
    position = F.element_at(F.array(*[F.lit(p) for p in ("GK", "DF", "MF", "FW", "")]), (F.pmod(F.expr("n_nationkey div 5"), F.lit(5)) + 1).cast("int"))
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        nr.alias("nr"), F.col("n_name").alias("player"), F.col("r_name").alias("team"), F.pmod(nr, F.lit(8)).cast("string").alias("jersey"), position.alias("position")
    )


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a track: team, read jersey, resolved player, confidence, votes, times and role, each missing for some tracks."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    e = observations(spark, sf_dir).groupBy("track_id").agg(
        F.min("seq").alias("s0"), F.max("seq").alias("s1"), F.round(F.avg("prob"), 9).alias("p"), F.round(F.avg("quality") * 10, 9).alias("votes"),
        F.min("ts_s").alias("start_s"), F.max("ts_s").alias("end_s"), F.count(F.lit(1)).alias("n"),
    )
    t = F.col("track_id")
    keep = lambda n, c: F.when(F.pmod(t, F.lit(n)) != 0, c)
    teams, players = region.select(F.col("r_regionkey").cast("long").alias("_t"), "r_name"), nation.select(F.col("n_nationkey").cast("long").alias("_p"), "n_name")
    return (
        e.withColumn("_t", F.pmod(t, F.lit(5)).cast("long"))
        .withColumn("_p", F.pmod(F.col("s1"), F.lit(25)).cast("long"))
        .join(teams, "_t")
        .join(players, "_p")
        .select(
            "track_id", keep(13, F.col("r_name")).alias("team"), keep(9, F.pmod("s0", F.lit(10)).cast("string")).alias("jersey"), keep(7, F.col("n_name")).alias("resolved"),
            F.col("p").alias("confidence"), "votes", "start_s", "end_s", ((F.col("end_s") - F.col("start_s")) / 86400).alias("duration"), "n",
            F.when(F.pmod(t, F.lit(17)) == 0, "referee").when(F.pmod(t, F.lit(19)) == 0, "goalkeeper").alias("role"), (F.col("votes") >= 4.5).alias("is_player"),
        )
    )


#: The same views as DuckDB common table expressions.
SQL = {
    "ev": """ev AS (SELECT event_id, user_id, event_type, value, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 AS ts_s,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)""",
    "observations": """observations AS (SELECT user_id AS track_id, event_id AS seq, ts_s, CAST(floor(ts_s / 3600) AS BIGINT) AS frame_index,
        least(1.0::DOUBLE, value / 100) AS quality, k / 99.0::DOUBLE AS prob, event_type AS candidate FROM ev)""",
    "fragments": """cuts AS (SELECT *, CASE WHEN coalesce(ts_s - lag(ts_s) OVER (PARTITION BY user_id ORDER BY event_id), 0) > 86400 THEN 1 ELSE 0 END AS cut FROM ev),
        fragments AS (SELECT user_id * 1000 + CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS track_id,
        user_id, event_id AS seq, ts_s, k * 10.0::DOUBLE AS x, value * 3 AS y, least(1.0::DOUBLE, value / 100) AS quality, k / 99.0::DOUBLE AS prob, event_type AS candidate FROM cuts)""",
    "gt_boxes": """gt_boxes AS (SELECT event_id AS gt_id, CAST(floor(ts_s / 3600) AS BIGINT) AS frame, user_id AS name, event_type IN ('click', 'purchase') AS visible,
        k * 10.0::DOUBLE AS x1, value * 3 AS y1, k * 10.0::DOUBLE + 20 + 4 * (event_id % 5) AS x2, value * 3 + 48 AS y2 FROM ev)""",
    "pred_boxes": """pred_boxes AS (SELECT gt_id AS pred_id, frame, (name + CASE WHEN gt_id % 13 = 0 THEN 1 ELSE 0 END) * 10 + (gt_id % 10000) // 4000 AS track_id,
        x1 + gt_id % 7 AS x1, y1 + gt_id % 11 AS y1, x2 + gt_id % 7 AS x2, y2 + gt_id % 11 AS y2 FROM gt_boxes WHERE gt_id % 10 <> 0)""",
    "roster": "roster AS (SELECT n_name AS player, r_name AS team, CAST(n_nationkey AS VARCHAR) AS jersey FROM nation JOIN region ON n_regionkey = r_regionkey)",
    "appearance": "appearance AS (SELECT vec_id, vec_id // 10 AS frame, label AS identity, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)",
    "squad": """squad AS (SELECT CAST(n_nationkey AS BIGINT) AS nr, n_name AS player, r_name AS team, CAST(n_nationkey % 8 AS VARCHAR) AS jersey,
        ['GK', 'DF', 'MF', 'FW', ''][CAST((n_nationkey // 5) % 5 AS INT) + 1] AS position FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "summary": """sums AS (SELECT track_id, min(seq) AS s0, max(seq) AS s1, round(avg(prob), 9) AS p, round(avg(quality) * 10, 9) AS votes, min(ts_s) AS start_s, max(ts_s) AS end_s, count(*) AS n FROM observations GROUP BY track_id),
        summary AS (SELECT track_id, CASE WHEN track_id % 13 <> 0 THEN r_name END AS team, CASE WHEN track_id % 9 <> 0 THEN CAST(s0 % 10 AS VARCHAR) END AS jersey, CASE WHEN track_id % 7 <> 0 THEN n_name END AS resolved,
            p AS confidence, votes, start_s, end_s, (end_s - start_s) / 86400 AS duration, n, CASE WHEN track_id % 17 = 0 THEN 'referee' WHEN track_id % 19 = 0 THEN 'goalkeeper' END AS role, votes >= 4.5 AS is_player
            FROM sums JOIN region ON r_regionkey = track_id % 5 JOIN nation ON n_nationkey = s1 % 25)""",
    "mot_boxes": "mot_boxes AS (SELECT l_returnflag AS sequence, l_suppkey AS track_id, l_linenumber AS frame FROM lineitem)",
}
_NEEDS = {"observations": ["ev"], "fragments": ["ev"], "gt_boxes": ["ev"], "pred_boxes": ["gt_boxes"], "summary": ["observations"]}


def with_views(*names: str) -> str:
    """``WITH`` and the named views, with those they are built on."""
    out: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if SQL[name] not in out:
            out.append(SQL[name])

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(out)
