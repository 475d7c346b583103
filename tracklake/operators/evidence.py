"""Evidence by track: similarities, resolved players, refreshed records, snapshots and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions import geometry as G
from tracklake.functions import probability as P
from tracklake.functions import vector as V
from tracklake.operators.linking import simple_dedup


def first_of(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first in the order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def argmax(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """The row of each key with the largest value; equal values go to the smaller ``order``, as in a map that is read in order."""
    return first_of(rows, key, F.desc(value), F.col(order))


def similarity(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2 of two vectors."""
    return (V.cosine(a, b) + 1) * 0.5


def gallery_similarity(tracks: DataFrame, gallery: DataFrame, on: str) -> DataFrame:
    """track_id, player, sim of every track embedding with every gallery embedding of the same ``on`` (a clip).

    Tracks or players without an embedding have no row.
    """
    t = tracks.where("embedding is not null").select(on, "track_id", F.col("embedding").alias("_e"))
    g = gallery.where("embedding is not null").select(on, "player", F.col("embedding").alias("_g"))
    return t.join(g, on).select("track_id", "player", similarity(F.col("_e"), F.col("_g")).alias("sim"))


def memory_similarity(asked: DataFrame, found: DataFrame, enabled: bool = True) -> DataFrame:
    """track_id, player, sim of the asked pairs; 0 where the memory does not know the player, or is off."""
    sim = F.coalesce("sim", F.lit(0.0)) if enabled else F.lit(0.0)
    return asked.join(found, ["track_id", "player"], "left").select("track_id", "player", sim.alias("sim"))


def body_confidence(obs: DataFrame) -> DataFrame:
    """track_id and 0.4 mean quality + 0.6 min(1, n / 20) over observations with an embedding (column ``has_body``); else 0."""
    n = F.count_if("has_body")
    mean = F.avg(F.when(F.col("has_body"), F.col("quality")))
    return obs.groupBy("track_id").agg(F.when(n > 0, 0.4 * mean + 0.6 * F.least(F.lit(1.0), n / 20.0)).otherwise(F.lit(0.0)).alias("body_confidence"))


def vertical_extent(boxes: DataFrame) -> DataFrame:
    """track_id, mean_y and span_y of the box centres."""
    y = G.center(G.box())[1]
    return boxes.groupBy("track_id").agg(F.avg(y).alias("mean_y"), (F.max(y) - F.min(y)).alias("span_y"))


FIELDS = ("team_confidence", "label_confidence", "head_confidence", "body_confidence", "tracking_confidence", "position_prior", "likelihood")


def refresh_evidence(tracks: DataFrame, held: DataFrame, players: DataFrame, team_probs: DataFrame, label_probs: DataFrame, heads: DataFrame, facts: DataFrame) -> DataFrame:
    """track_id, refreshed and the evidence fields after the assignment.

    A track with a known resolved player and with facts gets a new record, which replaces all
    fields of the held one; the others keep theirs. tracks: track_id, resolved; held: track_id and the
    fields; facts: track_id, body_confidence, tracking_confidence, likelihood, mean_y, span_y.
    """
    zero = F.lit(0.0)
    tracks = tracks.select("track_id", "resolved")
    known = tracks.join(players.withColumnRenamed("player", "resolved"), "resolved").join(facts, "track_id")
    new = (
        known.join(team_probs.select("track_id", "team", F.col("prob").alias("tp")), ["track_id", "team"], "left")
        .join(label_probs.select("track_id", F.col("candidate").alias("jersey"), F.col("prob").alias("lp")), ["track_id", "jersey"], "left")
        .join(heads.select("track_id", F.col("player").alias("resolved"), "sim"), ["track_id", "resolved"], "left")
        .select(
            "track_id",
            F.struct(
                F.coalesce("tp", zero).alias("team_confidence"),
                F.coalesce("lp", zero).alias("label_confidence"),
                F.coalesce("sim", zero).alias("head_confidence"),
                "body_confidence",
                "tracking_confidence",
                P.position_prior(F.col("position"), F.col("mean_y"), F.col("span_y")).alias("position_prior"),
                "likelihood",
            ).alias("new"),
        )
    )
    old = held.select("track_id", F.struct(*FIELDS).alias("old"))
    both = tracks.select("track_id").join(old, "track_id", "left").join(new, "track_id", "left")
    record = F.coalesce("new", "old")
    return both.select("track_id", F.col("new").isNotNull().alias("refreshed"), *[record[f].alias(f) for f in FIELDS])


def by_team_and_jersey(players: DataFrame, keep: str = "first") -> DataFrame:
    """One player of each (team, jersey): the first of the roster order ``nr``, or the last as when a map is filled."""
    order = F.asc("nr") if keep == "first" else F.desc("nr")
    return first_of(players.where("team is not null and jersey is not null"), ["team", "jersey"], order)


def player_of_jersey(tracks: DataFrame, players: DataFrame) -> DataFrame:
    """track_id and the player of its jersey: the one of the track's team, else the first with that jersey, else null."""
    p = players.select(F.col("jersey").alias("_j"), F.col("team").alias("_t"), "player", "nr")
    j = tracks.select("track_id", "team", "jersey").join(F.broadcast(first_of(p, ["_j", "_t"], F.col("nr"))), F.col("jersey") == F.col("_j"), "left")  # a roster
    same = F.coalesce(F.col("_t") == F.col("team"), F.lit(False))
    return first_of(j, ["track_id"], F.desc(same), F.col("nr")).select("track_id", "player")


def primary_identity(tracks: DataFrame, players: DataFrame, likely: float = 0.25) -> DataFrame:
    """The identity that a track shows: its resolved player if likely and of the same jersey, else the player of its team and jersey."""
    own = players.select(F.col("player").alias("resolved"), F.col("jersey").alias("_own"))
    fallback = by_team_and_jersey(players).select("team", "jersey", F.col("player").alias("_other"))
    j = tracks.join(own, "resolved", "left").join(fallback, ["team", "jersey"], "left")
    agrees = (F.col("confidence") >= likely) & (F.col("_own") == F.col("jersey"))
    return j.select("track_id", F.when(F.coalesce(agrees, F.lit(False)), F.col("resolved")).otherwise(F.col("_other")).alias("identity"))


def claim_strength() -> Column:
    """Confidence, with votes and duration as small weights."""
    return F.coalesce("confidence", F.lit(0.0)) + 0.05 * F.coalesce("votes", F.lit(0.0)) + 0.01 * F.coalesce("duration", F.lit(0.0))


def resolve_until_stable(tracks: DataFrame, players: DataFrame, frames: DataFrame, *, ratio: float = 0.6, likely: float = 0.25, passes: int = 6) -> DataFrame:
    """Conflicts resolved again until no further track is demoted, for up to ``passes`` passes.

    A demoted track loses its resolved player, and its jersey if team and jersey would give
    the same identity again. frames: track_id, frames (array of the frames it is seen in).
    Returns tracks with ``demoted_from``.
    """
    from tracklake.operators.linking import checkpointed, demote_conflicts

    rows = checkpointed(tracks.withColumn("demoted_from", F.lit(None).cast(players.schema["player"].dataType)))
    owner = players.select(F.col("player").alias("identity"), F.col("team").alias("_team"), F.col("jersey").alias("_jersey"))
    before = 0
    for _ in range(passes):
        who = primary_identity(rows, players, likely)
        claims = rows.where("is_player").join(who.where("identity is not null"), "track_id").join(frames, "track_id")
        judged = demote_conflicts(claims.select("identity", "track_id", claim_strength().alias("score"), "frames"), ratio)
        out = judged.where("demoted").select("track_id", "identity").join(owner, "identity")
        j = rows.join(out, "track_id", "left")
        hit = F.col("identity").isNotNull()
        again = hit & (F.col("team") == F.col("_team")) & (F.col("jersey") == F.col("_jersey"))
        new = {
            "resolved": F.when(~hit, F.col("resolved")),
            "confidence": F.when(hit, F.lit(0.0)).otherwise(F.col("confidence")),
            "jersey": F.when(~F.coalesce(again, F.lit(False)), F.col("jersey")),
            "demoted_from": F.coalesce("identity", "demoted_from"),
        }
        rows = checkpointed(j.select(*[new[c].alias(c) if c in new else c for c in rows.columns]))
        now = rows.where("demoted_from is not null").count()
        if now == before:
            break
        before = now
    return rows


def snapshots(tracks: DataFrame, players: DataFrame, visible: DataFrame) -> DataFrame:
    """track_id, name and jersey of the resolved player, kept if its team lists no visible jerseys or lists this one."""
    teams = visible.select("team").distinct().withColumn("_listed", F.lit(True))
    ok = visible.select("team", "jersey").distinct().withColumn("_ok", F.lit(True))
    p = players.where("jersey is not null").select(F.col("player").alias("resolved"), "team", "jersey")
    j = tracks.select("track_id", "resolved").join(p, "resolved").join(teams, "team", "left").join(ok, ["team", "jersey"], "left")
    return j.where("_listed is null or _ok").select("track_id", F.col("resolved").alias("name"), "jersey")


def mirror(tracks: DataFrame, summary: DataFrame, column: str) -> DataFrame:
    """The tracks with a column of their summary row, if they have one."""
    return tracks.join(summary.select("track_id", column), "track_id", "left")


def dominant_team(posterior: DataFrame, players: DataFrame) -> DataFrame:
    """track_id and the team of the player with the largest posterior (not the team of the kit)."""
    best = argmax(posterior, ["track_id"], "posterior", "player").select("track_id", "player", F.col("posterior").alias("confidence"))
    return best.join(players.select("player", "team"), "player").select("track_id", "player", "team", "confidence")


def relabel(tracks: DataFrame, best: DataFrame, teams: DataFrame, *, least_likelihood: float = 0.5, least_duration: float = 0.25) -> DataFrame:
    """A finished run with new labels: (track_id, label, score, shown) of every track.

    Tracks that are no players, unlikely or too short get no label; the others take their
    best candidate, of which one track a team keeps each. tracks: track_id, is_player, likelihood, duration;
    best: track_id, candidate, score; teams: track_id, team (null or absent: unknown).
    """
    fits = F.coalesce(F.col("is_player"), F.lit(False)) & (F.col("likelihood") >= least_likelihood) & (F.col("duration") >= least_duration)
    rows = tracks.withColumn("shown", fits).join(best, "track_id", "left").join(teams, "track_id", "left")
    labelled = rows.where("shown and candidate is not null").select("track_id", F.coalesce("team", F.lit("")).alias("team"), F.col("candidate").alias("label"), "score")
    kept = simple_dedup(labelled).select("track_id", "label")
    return rows.join(kept, "track_id", "left").select("track_id", "label", F.when(F.col("shown"), F.coalesce("score", F.lit(0.0))).alias("score"), "shown")


def identity_documents(tracks: DataFrame, players: DataFrame, posterior: DataFrame, evidence: DataFrame) -> DataFrame:
    """One document a track: its resolved player as a struct, the posterior and scores as maps, the evidence."""
    p = players.select(F.col("player").alias("resolved"), F.struct(*players.columns).alias("resolved_player"))
    maps = posterior.groupBy("track_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("player", F.col("posterior"))))).alias("posterior"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("player", F.col("score"))))).alias("raw_scores"),
    )
    e = evidence.select("track_id", F.struct(*[c for c in evidence.columns if c != "track_id"]).alias("evidence"))
    return tracks.join(p, "resolved", "left").join(maps, "track_id", "left").join(e, "track_id", "left")
