"""Further registered queries: identities, kits, set operations, projections and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklake.functions import geometry as G
from tracklake.functions import vector as V
from tracklake.operators import hooks, identity, linking, retrieval, tracks, votes
from tracklake.plans.evidence_queries import QUERIES as EVIDENCE
from tracklake.plans.queries import DIM, HOUR, QUERIES, _r, _spans
from tracklake.plans.resolve import resolved_clip
from tracklake.sources import files, generate
from tracklake.sources import views as S


def weighted_centroids(spark, d):
    a = S.appearance(spark, d).withColumn("weight", F.pmod("vec_id", F.lit(10)) / 10.0)
    c = identity.weighted_centroids(a, "identity", DIM)
    return c.select("identity", "n", F.posexplode("embedding").alias("place", "value")).withColumns(_r("value"))


def track_ends(spark, d):
    e = tracks.ends(S.fragments(spark, d))
    return e.select("track_id", F.col("first.seq").alias("first_seq"), F.round("first.x", 4).alias("first_x"), F.col("last.seq").alias("last_seq"), F.round("last.x", 4).alias("last_x"))


def window_votes(spark, d):
    s = _spans(spark, d)
    w = linking.active_windows(s, 24 * HOUR, 12 * HOUR).join(s, "track_id")
    overlap = G.overlap_seconds(F.col("window_start"), F.col("window_start") + 24 * HOUR, F.col("start_s"), F.col("end_s")) / HOUR
    f = S.fragments(spark, d).groupBy("track_id", "candidate").agg(F.avg("prob").alias("prob"))
    return identity.window_votes(w.withColumn("overlap", overlap).join(f, "track_id").withColumn("label", F.col("candidate"))).withColumns(_r("vote"))


def _members(spark, d):
    s = _spans(spark, d)
    c = linking.components(linking.gap_forest(s, 6 * HOUR, 250.0))
    return c.join(s, c.node == s.track_id).select(
        F.col("root").alias("cluster_id"), "team", "track_id", F.col("track_id").alias("member"), F.col("identity").cast("string").alias("label"), F.round("score", 6).alias("score")
    )


def canonical_labels(spark, d):
    valid = spark.range(25).select(F.pmod("id", F.lit(5)).alias("team"), F.col("id").cast("string").alias("label"))
    return identity.canonical_labels(_members(spark, d), valid).withColumns(_r("total"))


def label_overrides(spark, d):
    return identity.override_labels(_members(spark, d))


def cluster_ownership(spark, d):
    m = _members(spark, d)
    twice = m.unionByName(m.withColumn("cluster_id", F.col("cluster_id") + 1).withColumn("score", F.when(F.pmod("track_id", F.lit(2)) == 0, F.col("score") + 1).otherwise(F.col("score"))))
    return identity.own_clusters(twice)


def two_means(spark, d):
    o = S.observations(spark, d).groupBy(F.col("track_id").alias("id")).agg(F.round(F.avg("quality"), 6).alias("r"), F.round(F.avg("prob"), 6).alias("g"), F.round(F.max("prob"), 6).alias("b"))
    return identity.two_means(o)


def kit_fit(spark, d):
    o = S.observations(spark, d)
    rows = o.select("track_id", F.pmod("seq", F.lit(2)).alias("team"), F.when(F.pmod("seq", F.lit(7)) != 0, F.col("prob")).alias("shirt"), F.when(F.pmod("seq", F.lit(5)) != 0, F.col("quality")).alias("shorts"))
    return identity.kit_fit(rows).withColumns(_r("fit"))


def registry_merge(spark, d):
    a = S.appearance(spark, d)
    q = a.where(F.pmod("vec_id", F.lit(20)) == 0)
    near = retrieval.nearest_with_margin(q, a, 0.2, 0.0).join(a.select("vec_id", "identity"), "vec_id")
    held = q.select(F.col("vec_id").alias("track_id"), F.when(F.pmod("vec_id", F.lit(3)) != 0, F.col("identity")).alias("identity"), (F.pmod("vec_id", F.lit(10)) / 10.0 + F.pmod("vec_id", F.lit(60)) / 100.0).alias("confidence"))
    return identity.merge_by_registry(near.select(F.col("q_id").alias("track_id"), "identity", "similarity"), held)


def set_operations(spark, d):
    """Sizes of intersection, differences and union of the tracks seen in clicks and in purchases."""
    o = S.observations(spark, d)
    a, b = o.where("candidate = 'click' and prob > 0.9").select("track_id").distinct(), o.where("candidate = 'purchase' and prob > 0.9").select("track_id").distinct()
    parts = {"both": a.intersect(b), "only_a": a.exceptAll(b), "only_b": b.exceptAll(a), "either": a.union(b).distinct()}
    out = None
    for name, part in parts.items():
        row = part.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.union(row)
    return out


def strided_observations(spark, d):
    """Every third frame within the first 200 hours; the filters stand before anything costly."""
    o = S.observations(spark, d)
    first = o.agg(F.min("frame_index").alias("f0")).withColumn("one", F.lit(1))
    rows = o.withColumn("one", F.lit(1)).join(F.broadcast(first), "one")  # one row
    at = F.col("frame_index") - F.col("f0")
    return rows.where((at < 200) & (F.pmod(at, F.lit(3)) == 0)).groupBy("frame_index").agg(F.count(F.lit(1)).alias("n"))


def box_shapes(spark, d):
    """Clipped boxes with centre, foot point and area, of those that are large and upright enough."""
    g = S.gt_boxes(spark, d)
    b = G.clip_to_frame(G.box(), 960, 540)
    rows = g.select("gt_id", *[c.alias(n) for c, n in zip(b, ("x1", "y1", "x2", "y2"))])
    c, f = G.center(G.box()), G.foot_point(G.box())
    aspect = G.height(G.box()) / F.greatest(F.lit(1.0), G.width(G.box()))
    return rows.where((G.area(G.box()) >= 400) & (aspect >= 1)).select(
        "gt_id", F.round(c[0], 4).alias("cx"), F.round(c[1], 4).alias("cy"), F.round(f[1], 4).alias("foot_y"), F.round(G.area(G.box()), 4).alias("area")
    )


def track_documents(spark, d):
    docs = files.track_documents(S.fragments(spark, d), ["x", "y"], "seq")
    return docs.select("track_id", "first", "last", "num_observations", F.transform("observations", lambda o: o["seq"]).alias("seqs")).withColumn("seqs", F.array_join("seqs", ","))


def ema_vectors(spark, d):
    """Exponential moving average of an identity's first vector component in time order."""
    a = S.appearance(spark, d)
    v = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding")[0].alias("v")))), lambda x: x["v"])
    return a.groupBy("identity").agg(v.alias("v")).select("identity", F.round(V.ema(F.col("v"), 0.8), 6).alias("value"))


def synthetic_paths(spark, d):
    """Each user's first five events as points of a path: hours since the first one, k and value as the place."""
    return _paths(spark, d).withColumns({"x": F.round("x", 4), "y": F.round("y", 4)})


def _first_events(spark, d):
    g = S.fragments(spark, d).select(F.col("user_id").alias("path"), "seq", "ts_s", "x", "y")
    order = Window.partitionBy("path").orderBy("ts_s", "seq")
    nth = g.withColumn("nr", F.row_number().over(order)).withColumn("t", F.round((F.col("ts_s") - F.first("ts_s").over(order)) / HOUR, 3))
    return nth.where("nr <= 5").groupBy("path", "t").agg(F.max_by("x", "seq").alias("x"), F.max_by("y", "seq").alias("y"))


def _paths(spark, d):
    return identity.linear_paths(_first_events(spark, d), 60, 0.25)


def ball_path(spark, d):
    """A ball a user: it rolls for 41 hours from the user's first place to the middle, then goes with the user."""
    first = _first_events(spark, d).where("t = 0")
    free = first.select(F.col("path").alias("ball"), F.lit(0.0).alias("since"), F.lit(41.0).alias("until"), F.lit(None).cast("long").alias("path"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.lit(500.0).alias("x1"), F.lit(150.0).alias("y1"))
    held = first.select("path", F.lit(41.0), F.lit(None).cast("double"), "path", F.lit(14.0), F.lit(42.0), F.lit(0.0), F.lit(0.0))
    return generate.ball_path(_paths(spark, d), free.union(held), 60, 0.25).withColumns({"x": F.round("x", 4), "y": F.round("y", 4)})


def anonymous_rosters(spark, d):
    """Regions as teams: two have their nations as a squad, one a list of numbers, the others nothing."""
    region, nation = S.table(spark, d, "region"), S.table(spark, d, "nation")
    key, name = F.col("r_regionkey"), F.col("r_name")
    entries = region.select(
        name.alias("team"), F.when(key < 2, name).alias("squad"), F.when(key == 2, F.array(F.lit(4), F.lit(10), F.lit(7))).alias("numbers"), F.when(key == 3, F.lit("Anon")).alias("prefix")
    )
    squads = nation.join(region, nation.n_regionkey == region.r_regionkey).select(name.alias("squad"), F.col("n_nationkey").alias("number"), F.col("n_name").alias("player"), F.lit("FW").alias("position"))
    return generate.rosters(entries, squads)


def kit_settings(spark, d):
    """Kit settings as JSON of every shape, one a nation: a colour, objects under several names, colours that are none, and no JSON."""
    key, name = F.col("n_nationkey"), F.col("n_name")
    color = F.concat(F.lit("#"), F.lpad(F.conv((key * 654321 % 16777216).cast("string"), 10, 16), 6, "0"))
    quoted = F.concat(F.lit('"'), color, F.lit('"'))
    text = (
        F.when(key % 6 == 0, quoted)
        .when(key % 6 == 1, F.concat(F.lit('{"shirt": '), quoted, F.lit(', "shorts": "00ff00"}')))
        .when(key % 6 == 2, F.concat(F.lit('{"shirt": "", "primary": '), quoted, F.lit(', "secondary": null}')))
        .when(key % 6 == 3, F.concat(F.lit('{"home": '), quoted, F.lit(', "shorts": "red"}')))
        .when(key % 6 == 4, F.lit('{"color": '))
        .otherwise(F.concat(F.lit('{"color": '), quoted, F.lit("}")))
    )
    return generate.kit_colors(S.table(spark, d, "nation").select(name.alias("team"), text.alias("kit")))


def detected_frames(spark, d):
    """Events as frames, with a stub for a detector: k modulo 4 boxes each, of which labels, confidence and the frame's edge leave some."""

    def factory():
        def find(k, value):
            for i in range((k or 0) % 4):
                yield ("person", "ball", "referee")[i % 3], 1.0 - 0.3 * i, k * 10.0 + 30.0 * i - 100.0, value, k * 10.0 + 30.0 * i - 70.0, value + 48.0

        return find

    g = S.gt_boxes(spark, d).select("gt_id", (F.col("x1") / 10).cast("int").alias("k"), F.col("y1").alias("value"))
    got = hooks.detect(g, factory, ["k", "value"], labels=["person", "ball"], least=0.5, size=(800.0, 250.0))
    return got.select("gt_id", "label", F.round("confidence", 6).alias("confidence"), *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


def idf_extremes(spark, d):
    w = votes.rarity(S.observations(spark, d))
    order = lambda c: F.row_number().over(Window.orderBy(c, "candidate"))
    return w.withColumn("low", order(F.col("weight"))).withColumn("high", order(F.desc("weight"))).where("low <= 2 or high <= 2").select("candidate", F.round("weight", 6).alias("weight"))


MORE = {
    f.__name__: f
    for f in (
        weighted_centroids, track_ends, window_votes, canonical_labels, label_overrides, cluster_ownership, two_means, kit_fit, registry_merge, set_operations,
        strided_observations, box_shapes, track_documents, ema_vectors, synthetic_paths, ball_path, anonymous_rosters, kit_settings, detected_frames, idf_extremes,
    )
}
QUERIES = QUERIES | MORE | EVIDENCE | {"resolved_clip": resolved_clip}
