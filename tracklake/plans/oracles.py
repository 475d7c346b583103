"""DuckDB SQL for the registered queries, written independently of the operators."""

from __future__ import annotations

from tracklake.sources.views import with_views

C = "prob * greatest(0.01, quality)"

IOU = """CASE WHEN (x2a - x1a) * (y2a - y1a) + (x2b - x1b) * (y2b - y1b) - w * h > 0
    THEN w * h / ((x2a - x1a) * (y2a - y1a) + (x2b - x1b) * (y2b - y1b) - w * h) ELSE 0 END"""
PAIRS = f"""pairs AS (SELECT *, {IOU} AS iou FROM (
    SELECT g.gt_id, g.frame, p.pred_id, p.track_id, g.x1 AS x1a, g.y1 AS y1a, g.x2 AS x2a, g.y2 AS y2a, p.x1 AS x1b, p.y1 AS y1b, p.x2 AS x2b, p.y2 AS y2b,
        greatest(0, least(g.x2, p.x2) - greatest(g.x1, p.x1)) AS w, greatest(0, least(g.y2, p.y2) - greatest(g.y1, p.y1)) AS h
    FROM gt_boxes g JOIN pred_boxes p USING (frame)))"""
MATCHED = f"""{PAIRS},
best AS (SELECT * FROM pairs WHERE iou >= 0.5 QUALIFY row_number() OVER (PARTITION BY gt_id ORDER BY iou DESC, pred_id) = 1),
matched AS (SELECT g.gt_id, g.frame, g.name, g.visible, b.track_id, b.pred_id, b.iou FROM gt_boxes g LEFT JOIN best b USING (gt_id))"""
JUDGED = f"""{MATCHED},
tally AS (SELECT track_id, name, count(*) AS n, count(*) FILTER (visible) AS nv FROM matched WHERE track_id IS NOT NULL GROUP BY ALL),
tall2 AS (SELECT *, max(nv) OVER (PARTITION BY track_id) AS best_nv FROM tally),
ident AS (SELECT track_id, name AS identity FROM tall2
    QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY nv > 0 DESC, CASE WHEN best_nv > 0 THEN nv ELSE n END DESC, name) = 1),
judged AS (SELECT m.*, identity FROM matched m LEFT JOIN ident USING (track_id))"""
SWITCHES = """lastrow AS (SELECT name, frame, arg_max(track_id, gt_id) AS track_id FROM matched WHERE track_id IS NOT NULL GROUP BY ALL),
sw AS (SELECT name, CASE WHEN track_id <> lag(track_id) OVER (PARTITION BY name ORDER BY frame) THEN 1 ELSE 0 END AS s FROM lastrow)"""
RATES = """count(*) AS n_gt, count(track_id) AS n_matched, count(*) FILTER (identity = name) AS n_identity,
    count(*) FILTER (track_id IS NOT NULL AND visible) AS n_visible, count(*) FILTER (identity = name AND visible) AS n_visible_right,
    round(count(track_id) / greatest(1, count(*)), 6) AS recall, round(count(*) FILTER (identity = name) / greatest(1, count(*)), 6) AS identity_accuracy,
    round(count(*) FILTER (identity = name AND visible) / greatest(1, count(*) FILTER (track_id IS NOT NULL AND visible)), 6) AS visible_accuracy"""
BOXES = with_views("gt_boxes", "pred_boxes")
OBS = with_views("observations")
FRAG = with_views("fragments")

VOTES = f"""ranked AS (SELECT track_id, candidate, {C} AS c, row_number() OVER (PARTITION BY track_id, candidate ORDER BY {C} DESC, seq) AS rn FROM observations),
votes AS (SELECT track_id, candidate, sum(c) AS votes, count(*) FILTER (c >= 0.85) AS peaks FROM ranked WHERE rn <= 8 GROUP BY ALL)"""
IDF = f"""pk AS (SELECT DISTINCT track_id, candidate FROM observations WHERE {C} >= 0.85),
idf AS (SELECT candidate, count(*) AS n_tracks, ln(((SELECT count(DISTINCT track_id) FROM pk) + 1.0) / (count(*) + 1.0)) + 1 AS weight FROM pk GROUP BY candidate)"""
SCORED = f"""{VOTES}, {IDF},
wv AS (SELECT track_id, candidate, votes * coalesce(weight, 1) AS votes, peaks * coalesce(weight, 1) AS peaks FROM votes LEFT JOIN idf USING (candidate)),
scored AS (SELECT *, CASE WHEN sum(votes) OVER t > 0 THEN votes / sum(votes) OVER t ELSE 0 END AS share, peaks >= 2 AS locked, 1 + least(1, peaks / 2) AS boost
    FROM wv WINDOW t AS (PARTITION BY track_id)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY locked DESC, CASE WHEN locked THEN peaks ELSE 0 END DESC, votes DESC, candidate) AS rn FROM scored)"""
WDIST = f"""wd AS (SELECT track_id, candidate, sum({C}) AS c FROM observations GROUP BY ALL),
dist AS (SELECT track_id, candidate, CASE WHEN sum(c) OVER t > 0 THEN c / sum(c) OVER t ELSE 0 END AS prob FROM wd WINDOW t AS (PARTITION BY track_id))"""
MAXD = """mx AS (SELECT track_id, candidate, max(prob) AS p FROM observations GROUP BY ALL),
mdist AS (SELECT track_id, candidate, CASE WHEN sum(p) OVER t > 0 THEN p / sum(p) OVER t ELSE 0 END AS prob FROM mx WINDOW t AS (PARTITION BY track_id))"""
EXT = """ext AS (SELECT track_id, count(*) AS n, min(ts_s) AS start_s, max(ts_s) AS end_s, greatest(0, max(ts_s) - min(ts_s)) AS duration,
    avg(quality) AS mean_quality, avg(prob) AS mean_prob FROM observations GROUP BY track_id)"""
SPANS = f"""spans AS (SELECT track_id, user_id, user_id % 5 AS team, user_id % 25 AS identity, min(ts_s) AS start_s, max(ts_s) AS end_s,
    arg_min(x, seq) AS x0, arg_min(y, seq) AS y0, arg_max(x, seq) AS x1, arg_max(y, seq) AS y1, count(*) AS n, sum({C}) AS score FROM fragments GROUP BY track_id, user_id)"""


def _gaps(gap: float, reach: float) -> str:
    return f"""gaps AS (SELECT a.track_id AS a, b.track_id AS b, b.start_s - a.end_s AS gap, sqrt((a.x1 - b.x0) ** 2 + (a.y1 - b.y0) ** 2) AS distance
    FROM spans a JOIN spans b ON a.team = b.team AND a.track_id <> b.track_id AND b.start_s - a.end_s BETWEEN 0 AND {gap}
    WHERE sqrt((a.x1 - b.x0) ** 2 + (a.y1 - b.y0) ** 2) <= {reach})"""


COMPONENTS = f"""{SPANS}, {_gaps(7200, 150)},
links AS (SELECT a, b FROM gaps UNION SELECT b, a FROM gaps),
walk(node, seen) AS (SELECT a, a FROM links UNION SELECT w.node, l.b FROM walk w JOIN links l ON l.a = w.seen),
comp AS (SELECT node, min(seen) AS root FROM walk GROUP BY node)"""

MEMBERS = f"""{SPANS}, {_gaps(21600, 250)},
links AS (SELECT a, b FROM gaps UNION SELECT b, a FROM gaps),
walk(node, seen) AS (SELECT a, a FROM links UNION SELECT w.node, l.b FROM walk w JOIN links l ON l.a = w.seen),
mem AS (SELECT c.root AS cluster_id, team, track_id, identity::VARCHAR AS label, round(score, 6) AS score FROM (SELECT node, min(seen) AS root FROM walk GROUP BY node) c JOIN spans ON node = track_id)"""
TEAMD = f"""{EXT}, td AS (SELECT track_id, t, 'team' || t AS team, abs(mean_quality - t / 5.0::DOUBLE) + ((track_id + t) % 7) / 20.0::DOUBLE AS distance FROM ext, range(5) r(t)),
tm AS (SELECT *, min(distance) OVER w AS least, exp((-distance + min(distance) OVER w) / 0.16) AS e FROM td WINDOW w AS (PARTITION BY track_id)),
tp AS (SELECT track_id, t, team, CASE WHEN least <= 0.48 THEN least(0.62, e / sum(e) OVER (PARTITION BY track_id)) ELSE 0.02 END AS prob FROM tm)"""
REGIONS = "regions AS (SELECT team, row_number() OVER (ORDER BY team) - 1 AS t FROM (SELECT DISTINCT team FROM roster))"


def _edges(width: int, height: int) -> str:
    share = lambda c, a: f"count(*) FILTER ({c}) / greatest(1, count(*)) AS {a}_share"
    med = ", ".join(f"list_sort(list({c}))[count(*) // 2 + 1] AS median_{c}" for c in ("x1", "y1", "x2", "y2"))
    return f"""edges AS (SELECT name AS track_id, {share('x1 <= 20', 'left')}, {share(f'x2 >= {width - 20}', 'right')}, {share('y1 <= 20', 'top')},
    {share(f'y2 >= {height - 20}', 'bottom')}, {med} FROM gt_boxes GROUP BY name)"""


SIM = """q AS (SELECT * FROM appearance WHERE vec_id % 20 = 0),
sims AS (SELECT q.vec_id AS q_id, q.identity AS q_identity, g.vec_id, g.identity,
    round(list_dot_product(q.embedding, g.embedding) / (sqrt(list_dot_product(q.embedding, q.embedding)) * sqrt(list_dot_product(g.embedding, g.embedding))), 9) AS similarity
    FROM q JOIN appearance g ON g.frame <> q.frame),
rk AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, vec_id) AS rank, CASE WHEN identity = q_identity THEN 1 ELSE 0 END AS hit FROM sims)"""

_hsv = """CASE WHEN mx = mn THEN 0 WHEN mx = r THEN 60.0::DOUBLE * (g - b) / (mx - mn) WHEN mx = g THEN 120 + 60.0::DOUBLE * (b - r) / (mx - mn) ELSE 240 + 60.0::DOUBLE * (r - g) / (mx - mn) END"""
HSV = f"CAST(round((CASE WHEN {_hsv} < 0 THEN {_hsv} + 360 ELSE {_hsv} END) / 2) AS INT) % 180"

def _linear(c: str) -> str:
    return f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE (({c} / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4::DOUBLE END"


def _root(c: str) -> str:
    return f"CASE WHEN {c} > 0.008856 THEN cbrt({c}) ELSE 7.787 * {c} + 16.0::DOUBLE / 116.0 END"


PATHS = f"""{with_views("fragments")}, nth AS (SELECT user_id AS path, seq, x, y, row_number() OVER o AS nr, round((ts_s - first(ts_s) OVER o) / 3600, 3) AS t FROM fragments WINDOW o AS (PARTITION BY user_id ORDER BY ts_s, seq)),
    pts AS (SELECT path, t, arg_max(x, seq) AS x, arg_max(y, seq) AS y FROM nth WHERE nr <= 5 GROUP BY path, t),
    lg AS (SELECT *, lead(t) OVER o AS nt, lead(x) OVER o AS nx, lead(y) OVER o AS ny FROM pts WINDOW o AS (PARTITION BY path ORDER BY t)),
    pth AS (SELECT path, frame, CASE WHEN nt IS NULL THEN x ELSE x + (frame * 4 - t) / (nt - t) * (nx - x) END AS x, CASE WHEN nt IS NULL THEN y ELSE y + (frame * 4 - t) / (nt - t) * (ny - y) END AS y
        FROM lg, (SELECT unnest(range(60)) AS frame) WHERE frame * 4 >= t AND (nt IS NULL OR frame * 4 < nt))"""

SQL: dict[str, str] = {
    "track_eval_summary": f"""{BOXES}, {JUDGED}, {SWITCHES} SELECT {RATES}, (SELECT coalesce(sum(s), 0) FROM sw)::BIGINT AS id_switches FROM judged""",
    "track_eval_by_player": f"{BOXES}, {JUDGED} SELECT name, {RATES} FROM judged GROUP BY name",
    "id_switches": f"{BOXES}, {MATCHED}, {SWITCHES} SELECT name, sum(s)::BIGINT AS switches FROM sw GROUP BY name",
    "best_box_match": f"{BOXES}, {MATCHED} SELECT gt_id, track_id, pred_id, round(iou, 6) AS iou FROM matched",
    "confusion_topn": f"""{BOXES}, {JUDGED} SELECT name, identity, count(*) AS n FROM judged WHERE identity IS NOT NULL AND identity <> name
        GROUP BY ALL ORDER BY n DESC, name, identity LIMIT 20""",
    "track_extents": f"""{OBS}, {EXT} SELECT track_id, n, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s, round(duration, 3) AS duration,
        round(mean_quality, 6) AS mean_quality, round(mean_prob, 6) AS mean_prob FROM ext""",
    "min_observation_tracks": f"""{FRAG}, k AS (SELECT track_id, count(*) AS n, min(ts_s) AS s FROM fragments GROUP BY track_id HAVING count(*) >= 5)
        SELECT track_id, CAST(row_number() OVER (ORDER BY s, track_id) AS INT) AS track_seq, n FROM k""",
    "candidate_votes_topk": f"{OBS}, {VOTES} SELECT track_id, candidate, round(votes, 6) AS votes, peaks FROM votes",
    "candidate_idf": f"{OBS}, {IDF} SELECT candidate, n_tracks, round(weight, 6) AS weight FROM idf",
    "candidate_best": f"""{OBS}, {SCORED} SELECT track_id, CASE WHEN locked OR share >= 0.3 THEN candidate END AS candidate, round(votes * share * boost, 6) AS score
        FROM ordered WHERE rn = 1""",
    "candidate_ranked": f"""{OBS}, {SCORED} SELECT track_id, CAST(rn AS INT) AS rank, candidate, round(votes * share * CASE WHEN locked THEN boost ELSE 1 END, 6) AS score
        FROM ordered WHERE rn <= 5""",
    "candidate_longer_lock": f"""{OBS}, lab AS (SELECT track_id, seq, {C} AS c, CASE WHEN seq % 2 = 0 THEN CAST(round(prob * 99) AS INT)::VARCHAR ELSE substr(CAST(round(prob * 99) AS INT)::VARCHAR, 1, 1) END AS candidate FROM observations),
        rkd AS (SELECT *, row_number() OVER (PARTITION BY track_id, candidate ORDER BY c DESC, seq) AS rn FROM lab),
        v AS (SELECT track_id, candidate, sum(c) AS votes, count(*) FILTER (c >= 0.3) AS peaks FROM rkd WHERE rn <= 24 GROUP BY ALL),
        b AS (SELECT track_id, candidate AS best FROM v QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY votes DESC, candidate) = 1),
        l AS (SELECT v.track_id, v.candidate AS longer FROM v JOIN b USING (track_id) WHERE contains(v.candidate, best) AND length(v.candidate) > length(best) AND peaks >= 1
            QUALIFY row_number() OVER (PARTITION BY v.track_id ORDER BY peaks DESC, votes DESC, candidate) = 1)
        SELECT track_id, coalesce(longer, best) AS candidate FROM b LEFT JOIN l USING (track_id)""",
    "weighted_distribution": f"""{OBS}, {WDIST}, qual AS (SELECT track_id, avg(quality) AS quality FROM observations GROUP BY track_id)
        SELECT track_id, candidate, round(prob, 6) AS prob, round(quality, 6) AS quality FROM dist JOIN qual USING (track_id)""",
    "distribution_merge_max": f"{OBS}, {MAXD} SELECT track_id, candidate, round(prob, 6) AS prob FROM mdist",
    "distribution_merge_weighted": f"""{OBS}, {WDIST}, {MAXD} SELECT track_id, candidate, round(sum(p), 6) AS prob FROM
        (SELECT track_id, candidate, prob AS p FROM dist UNION ALL SELECT track_id, candidate, prob * 0.8 FROM mdist) GROUP BY ALL""",
    "confusable_smoothing": f"""{OBS}, lab AS (SELECT track_id, CAST(round(prob * 99) AS INT)::VARCHAR AS candidate, {C} AS c FROM observations),
        s AS (SELECT track_id, candidate, sum(c) AS c FROM lab GROUP BY ALL), d AS (SELECT track_id, candidate, CASE WHEN sum(c) OVER t > 0 THEN c / sum(c) OVER t ELSE 0 END AS p FROM s WINDOW t AS (PARTITION BY track_id)),
        nb(c, others) AS (VALUES ('0', '89'), ('1', '74'), ('2', '73'), ('3', '852'), ('4', '196'), ('5', '683'), ('6', '5840'), ('7', '12'), ('8', '35906'), ('9', '84')),
        al AS (SELECT * FROM d
            UNION ALL SELECT track_id, substr(candidate, 1, i - 1) || substr(others, j, 1) || substr(candidate, i + 1), p * 0.6
                FROM d, range(1, 3) r(i), nb, range(1, 6) s(j) WHERE i <= length(candidate) AND c = substr(candidate, i, 1) AND j <= length(others)
            UNION ALL SELECT track_id, x || candidate, p * 0.6 FROM d, (VALUES ('1'), ('2')) v(x) WHERE length(candidate) = 1),
        g AS (SELECT track_id, candidate, sum(p) AS p FROM al GROUP BY ALL)
        SELECT track_id, candidate, round(CASE WHEN sum(p) OVER t > 0 THEN p / sum(p) OVER t ELSE 0 END, 6) AS prob FROM g WINDOW t AS (PARTITION BY track_id)""",
    "top_hit_rates": f"""{OBS}, {SCORED}, truth AS (SELECT track_id, arg_max(candidate, seq) AS truth FROM observations GROUP BY track_id),
        h AS (SELECT t.track_id, max(CASE WHEN candidate = truth AND rn <= 1 THEN 1 ELSE 0 END) AS t1, max(CASE WHEN candidate = truth AND rn <= 3 THEN 1 ELSE 0 END) AS t3
            FROM truth t LEFT JOIN ordered o ON o.track_id = t.track_id AND rn <= 5 GROUP BY t.track_id)
        SELECT count(*) AS n, round(sum(t1) / greatest(1, count(*)), 6) AS top1, round(sum(t3) / greatest(1, count(*)), 6) AS top3 FROM h""",
    "team_posterior_softmax": f"{OBS}, {TEAMD} SELECT track_id, team, round(prob, 6) AS prob FROM tp",
    "edge_touch_upper_median": f"""{with_views('gt_boxes')}, {_edges(1000, 1200)} SELECT track_id, round(left_share, 6) AS left_share, round(right_share, 6) AS right_share,
        round(top_share, 6) AS top_share, round(bottom_share, 6) AS bottom_share, round(median_x1, 6) AS median_x1, round(median_y1, 6) AS median_y1,
        round(median_x2, 6) AS median_x2, round(median_y2, 6) AS median_y2 FROM edges""",
    "player_likelihood": f"""{with_views('gt_boxes', 'observations')}, {_edges(1000, 160)}, {EXT}, lk AS (SELECT track_id, duration,
        (0.85 * mean_quality + 0.15 * mean_prob) * CASE WHEN greatest(top_share, bottom_share) >= 0.5 THEN 0.15 ELSE 1 END AS l FROM ext LEFT JOIN edges USING (track_id))
        SELECT track_id, round(l, 6) AS likelihood, l >= 0.5 AND duration >= 0.2 AS is_player FROM lk""",
    "roster_validity": f"""{with_views('observations', 'roster')}, {REGIONS}, o AS (SELECT track_id, min(seq) AS s FROM observations GROUP BY track_id),
        l AS (SELECT track_id, team, (s % 25)::VARCHAR AS label FROM o LEFT JOIN regions ON t = track_id % 6),
        j AS (SELECT l.*, team IS NOT NULL AND NOT EXISTS (SELECT 1 FROM roster r WHERE r.team = l.team AND r.jersey = l.label) AS off FROM l)
        SELECT track_id, team, CASE WHEN NOT off THEN label END AS label, CASE WHEN off THEN label END AS off_roster FROM j""",
    "gap_candidates": f"{FRAG}, {SPANS}, {_gaps(21600, 250)} SELECT a, b, round(gap, 3) AS gap, round(distance, 6) AS distance FROM gaps",
    "gap_nearest": f"""{FRAG}, {SPANS}, {_gaps(21600, 250)} SELECT a, b, round(distance, 6) AS distance FROM gaps
        QUALIFY row_number() OVER (PARTITION BY a ORDER BY distance, gap, b) = 1""",
    "fragment_inherit": f"""{FRAG}, {SPANS}, cs AS (SELECT track_id, candidate, sum({C}) AS score FROM fragments GROUP BY ALL),
        top AS (SELECT track_id, score AS best_score, candidate AS label FROM cs QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY score DESC, candidate DESC) = 1),
        w AS (SELECT s.track_id, team, start_s, end_s, best_score, label FROM spans s JOIN top USING (track_id)),
        j AS (SELECT l.track_id AS loser, w.track_id AS winner, w.label, w.best_score AS ws FROM w l JOIN cs ON cs.track_id = l.track_id AND cs.score >= 0.2 * l.best_score
            JOIN w ON w.team = l.team AND w.label = cs.candidate AND w.track_id % 3 <> 0
            WHERE l.track_id % 3 = 0 AND greatest(0, least(l.end_s, w.end_s) - greatest(l.start_s, w.start_s)) <= 0.5)
        SELECT loser, winner, label FROM j QUALIFY row_number() OVER (PARTITION BY loser ORDER BY ws DESC, winner, label) = 1""",
    "window_active_tracks": f"""{FRAG}, {SPANS}, og AS (SELECT min(start_s) AS o, max(end_s) AS e FROM spans),
        win AS (SELECT i AS win, o + i * 43200.0::DOUBLE AS s FROM og, range(0, CAST(floor((e + 1e-6 - o) / 43200) AS BIGINT) + 1) r(i))
        SELECT win AS "window", count(*) AS n_tracks, sum(track_id)::BIGINT AS id_sum FROM win JOIN spans ON start_s <= s + 86400 AND end_s >= s GROUP BY win""",
    "overlap_ratio": f"""{FRAG}, {SPANS}, p AS (SELECT a.identity, a.track_id AS a, b.track_id AS b, least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s) AS seconds,
        least(a.end_s - a.start_s, b.end_s - b.start_s) AS shorter FROM spans a JOIN spans b ON a.identity = b.identity AND a.track_id < b.track_id)
        SELECT identity, a, b, round(seconds, 3) AS seconds, round(CASE WHEN shorter > 0 THEN seconds / shorter ELSE 0 END, 6) AS ratio FROM p WHERE seconds > 0""",
    "frame_overlap_ratio": f"""{OBS}, f AS (SELECT DISTINCT track_id % 25 AS identity, track_id, frame_index FROM observations), own AS (SELECT track_id, count(*) AS n FROM f GROUP BY track_id),
        s AS (SELECT x.identity, x.track_id AS a, y.track_id AS b, count(*) AS shared FROM f x JOIN f y ON x.identity = y.identity AND x.frame_index = y.frame_index AND x.track_id < y.track_id GROUP BY ALL)
        SELECT identity, a, b, shared, round(shared / oa.n, 6) AS ratio_a, round(shared / ob.n, 6) AS ratio_b FROM s JOIN own oa ON oa.track_id = a JOIN own ob ON ob.track_id = b""",
    "track_pair_edges": f"{FRAG}, {SPANS}, {_gaps(7200, 150)} SELECT a, b FROM gaps",
    "identity_components": f"{FRAG}, {COMPONENTS} SELECT node, root FROM comp",
    "group_propagation": f"""{FRAG}, {COMPONENTS}, m AS (SELECT root, track_id, CASE WHEN track_id % 3 = 0 THEN identity END AS identity, (track_id % 11) / 10.0::DOUBLE AS confidence FROM comp JOIN spans ON node = track_id),
        b AS (SELECT root, identity AS best FROM m WHERE identity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY root ORDER BY confidence DESC, track_id DESC) = 1)
        SELECT root, track_id, coalesce(identity, best) AS identity, round(CASE WHEN identity IS NULL AND best IS NOT NULL THEN greatest(confidence, 0.3) ELSE confidence END, 6) AS confidence
        FROM m LEFT JOIN b USING (root)""",
    "simple_dedup": f"""{FRAG}, {SPANS}, r AS (SELECT track_id, team, identity, round(score, 6) AS score FROM spans)
        SELECT track_id, team, score, CASE WHEN row_number() OVER (PARTITION BY team, identity ORDER BY score DESC, track_id::VARCHAR DESC) = 1 THEN identity END AS label FROM r""",
    "frame_label_dedup": f"""{with_views('gt_boxes')}, s AS (SELECT gt_id, frame, name % 5 AS identity, round(y1, 6) AS strength FROM gt_boxes)
        SELECT gt_id, frame, identity, strength FROM s QUALIFY strength >= max(strength) OVER (PARTITION BY frame, identity) - 1e-6""",
    "interp_positions": f"""{FRAG}, a AS (SELECT user_id AS key, ts_s AS t, quantile_cont(x, 0.5) AS x, quantile_cont(y, 0.5) AS y FROM fragments WHERE seq % 3 = 0 GROUP BY ALL),
        q AS (SELECT user_id AS key, ts_s AS "at" FROM fragments WHERE seq % 3 <> 0),
        nb AS (SELECT q.key, q."at", list({{'t': a.t, 'x': a.x, 'y': a.y}} ORDER BY a.t) AS l, count(*) FILTER (a.t <= q."at") AS lo, count(*) AS n FROM q JOIN a ON q.key = a.key GROUP BY q.key, q."at"),
        pq AS (SELECT key, "at", l[CASE WHEN lo = 0 THEN 1 WHEN lo = n THEN greatest(1, n - 1) ELSE lo END] AS p, l[CASE WHEN lo = 0 THEN least(2, n) WHEN lo = n THEN n ELSE lo + 1 END] AS q FROM nb)
        SELECT key, round("at", 3) AS "at", round(CASE WHEN p.t = q.t THEN p.x ELSE p.x + (q.x - p.x) * ("at" - p.t) / (q.t - p.t) END, 4) AS x,
            round(CASE WHEN p.t = q.t THEN p.y ELSE p.y + (q.y - p.y) * ("at" - p.t) / (q.t - p.t) END, 4) AS y FROM pq""",
    "jump_segments": f"""{FRAG}, j AS (SELECT *, CASE WHEN sqrt((x - lag(x) OVER o) ** 2 + (y - lag(y) OVER o) ** 2) / greatest(1, ts_s - lag(ts_s) OVER o) > 0.02 THEN 1 ELSE 0 END AS jump
        FROM fragments WINDOW o AS (PARTITION BY track_id ORDER BY seq)),
        s AS (SELECT *, sum(jump) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM j),
        g AS (SELECT track_id, segment, count(*) AS n, min(ts_s) AS a, max(ts_s) AS b FROM s GROUP BY ALL)
        SELECT track_id, segment, n, round(a, 3) AS start_s, round(b, 3) AS end_s,
            CASE WHEN count(*) OVER (PARTITION BY track_id) > 1 THEN concat_ws('-', 30000, track_id, segment) ELSE track_id::VARCHAR END AS new_id FROM g""",
    "label_cascade": f"""{OBS}, v AS (SELECT seq, CASE WHEN seq % 4 <> 0 THEN 'P' || track_id END AS nm, CASE WHEN seq % 3 <> 0 THEN (seq % 25)::VARCHAR END AS js,
        CASE WHEN seq % 17 = 0 THEN 'referee' WHEN seq % 19 = 0 THEN 'goalkeeper' END AS role, prob AS c, quality * 10 AS top FROM observations)
        SELECT seq, CASE WHEN role = 'referee' THEN 'Referee' WHEN role = 'goalkeeper' THEN 'Goalkeeper ' || coalesce(nm, '') WHEN nm IS NOT NULL AND js IS NOT NULL AND c >= 0.6 THEN nm
            WHEN nm IS NOT NULL AND js IS NOT NULL AND c >= 0.4 THEN 'Likely ' || nm WHEN js IS NOT NULL THEN 'Low conf ID #' || js WHEN nm IS NOT NULL AND c >= 0.6 THEN nm
            WHEN nm IS NOT NULL AND top >= 5 THEN nm ELSE 'Low conf ID' END AS label FROM v""",
    "retrieval_map": f"""{with_views('appearance')}, {SIM}, pr AS (SELECT *, sum(hit) OVER (PARTITION BY q_id ORDER BY rank) / rank AS prec FROM rk),
        per AS (SELECT q_id, sum(hit) AS pos, sum(hit * prec) AS ap, max(CASE WHEN rank <= 1 THEN hit ELSE 0 END) AS r1, max(CASE WHEN rank <= 5 THEN hit ELSE 0 END) AS r5 FROM pr GROUP BY q_id HAVING sum(hit) > 0)
        SELECT count(*) AS queries, round(avg(r1), 6) AS rank1, round(avg(r5), 6) AS rank5, round(avg(ap / pos), 6) AS map FROM per""",
    "retrieval_rank_k": f"{with_views('appearance')}, {SIM} SELECT q_id, CAST(rank AS INT) AS rank, vec_id, round(similarity, 6) AS similarity FROM rk WHERE rank <= 5",
    "centroid_median": f"""{with_views('appearance')}, e AS (SELECT identity, vec_id, unnest(embedding) AS v, unnest(range(64)) AS place FROM appearance),
        n AS (SELECT identity FROM appearance GROUP BY identity HAVING count(*) >= 5)
        SELECT identity, CAST(place AS INT) AS place, round(quantile_cont(v, 0.5), 6) AS value FROM e JOIN n USING (identity) GROUP BY ALL""",
    "registry_nn_margin": f"""{with_views('appearance')}, {SIM}, r2 AS (SELECT q_id, vec_id, similarity, row_number() OVER o AS rn, coalesce(lead(similarity) OVER o, -2) AS second FROM sims WHERE coalesce(CASE WHEN q_id % 9 <> 0 THEN q_id % 2 END = CASE WHEN vec_id % 9 <> 0 THEN vec_id % 2 END, TRUE)
        WINDOW o AS (PARTITION BY q_id ORDER BY similarity DESC, vec_id))
        SELECT q_id, vec_id, round(similarity, 6) AS similarity FROM r2 WHERE rn = 1 AND similarity >= 0.25 AND similarity - second >= 0.01""",
    "adjacent_frames": f"""{with_views('appearance')}, f AS (SELECT DISTINCT frame FROM appearance), n AS (SELECT frame, lead(frame) OVER (ORDER BY frame) AS next_frame FROM f)
        SELECT * FROM n WHERE next_frame IS NOT NULL""",
    "set_precision_recall": f"""{OBS}, s AS (SELECT DISTINCT CAST(floor(ts_s / 86400) AS BIGINT) AS day, track_id FROM observations WHERE prob >= 0.5),
        e AS (SELECT DISTINCT CAST(floor(ts_s / 86400) AS BIGINT) AS day, track_id FROM observations WHERE quality >= 0.3),
        j AS (SELECT coalesce(s.day, e.day) AS day, s.day IS NOT NULL AS a, e.day IS NOT NULL AS b FROM s FULL JOIN e ON s.day = e.day AND s.track_id = e.track_id)
        SELECT day, round(count(*) FILTER (a AND b) / greatest(1, count(*) FILTER (a)), 6) AS precision, round(count(*) FILTER (a AND b) / greatest(1, count(*) FILTER (b)), 6) AS recall,
            count(*) FILTER (b AND NOT a) AS missed, count(*) FILTER (a AND NOT b) AS extra FROM j GROUP BY day""",
    "coverage_hours": f"""{FRAG}, {SPANS}, h AS (SELECT user_id, track_id, unnest(range(CAST(floor(start_s / 3600) AS BIGINT), CAST(floor(end_s / 3600) AS BIGINT) + 1)) AS hour FROM spans)
        SELECT user_id, count(DISTINCT hour) AS hours, count(DISTINCT track_id) AS fragments FROM h GROUP BY user_id""",
    "mot_summary": f"""{with_views('mot_boxes')} SELECT sequence, count(*) AS boxes, count(DISTINCT track_id) AS tracks, count(DISTINCT frame) AS frames FROM mot_boxes GROUP BY sequence""",
    "interval_scores": f"""{OBS}, o AS (SELECT candidate AS label, track_id, min(ts_s) AS s, max(ts_s) AS e FROM observations GROUP BY ALL)
        SELECT a.label, a.track_id, round(CASE WHEN greatest(a.e, b.e) > least(a.s, b.s) THEN greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s)) ELSE 0 END, 6) AS iou
        FROM o a JOIN o b ON a.label = b.label AND b.track_id = a.track_id + 1""",
    "ascii_names": "SELECT doc_id, md5(strip_accents(coalesce(text, ''))) AS plain_md5 FROM documents",
    "category_parse": f"""{with_views('gt_boxes')} SELECT gt_id, CASE WHEN gt_id % 5 IN (1, 2, 4) THEN (gt_id % 23)::VARCHAR END AS jersey,
        CASE gt_id % 5 WHEN 0 THEN 'Referee' WHEN 3 THEN NULL ELSE 'Alvarez ' || name END AS name, gt_id % 5 IN (1, 4) AS visible,
        CASE gt_id % 5 WHEN 0 THEN 'referee' WHEN 1 THEN 'goalkeeper' WHEN 3 THEN 'root' ELSE 'player' END AS role FROM gt_boxes""",
    "digit_runs": """SELECT conv_id, turn, CAST(len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS INT) AS n_runs,
        array_to_string(regexp_extract_all(coalesce(text, ''), '[0-9]+'), ',') AS runs FROM conversations""",
    "file_frames": f"{with_views('gt_boxes')} SELECT gt_id, CAST(CASE WHEN gt_id % 9 = 0 THEN -1 ELSE least(899, (gt_id % 50) * 30) END AS INT) AS frame_of FROM gt_boxes",
    "player_keys": f"""{with_views('roster')} SELECT player, replace(concat_ws('|', team, player, CASE WHEN jersey <> '7' THEN jersey ELSE 'NA' END), '/', '_') AS player_id,
        trim(regexp_replace(lower(player), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM roster""",
    "tail_drop": f"""{OBS}, s AS (SELECT track_id, candidate, sum(prob) AS p FROM observations GROUP BY ALL), n AS (SELECT track_id, candidate, p / sum(p) OVER (PARTITION BY track_id) AS p FROM s),
        k AS (SELECT * FROM n WHERE p >= 0.15) SELECT track_id, candidate, round(p / sum(p) OVER (PARTITION BY track_id), 9) AS prob FROM k""",
    "confidence_ema": f"""{OBS}, o AS (SELECT track_id, prob, row_number() OVER (PARTITION BY track_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY track_id) AS n FROM observations)
        SELECT track_id, round(sum(prob * CASE WHEN i = 1 THEN 0.8::DOUBLE ** (n - 1) ELSE 0.2 * 0.8::DOUBLE ** (n - i) END), 6) AS confidence FROM o GROUP BY track_id""",
    "temporal_split": f"""{with_views('appearance')}, o AS (SELECT identity, embedding, row_number() OVER (PARTITION BY identity ORDER BY frame, vec_id) - 1 AS nr, count(*) OVER (PARTITION BY identity) AS n FROM appearance),
        e AS (SELECT identity, nr % 2 AS half, unnest(embedding) AS v, unnest(range(64)) AS place FROM o WHERE n >= 6),
        m AS (SELECT identity, half, place, avg(v) AS v FROM e GROUP BY ALL), c AS (SELECT identity, half, list(v ORDER BY place) AS w FROM m GROUP BY ALL),
        s AS (SELECT q.identity AS qi, g.identity AS gi, round(list_dot_product(q.w, g.w) / (sqrt(list_dot_product(q.w, q.w)) * sqrt(list_dot_product(g.w, g.w))), 9) AS sim
            FROM c q JOIN c g ON q.half = 1 AND g.half = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY sim DESC, gi) AS rank FROM s)
        SELECT count(*) AS queries, round(avg(CASE WHEN rank = 1 THEN 1 ELSE 0 END), 6) AS rank1, round(avg(1 / rank), 6) AS mrr FROM r WHERE qi = gi""",
    "fusion_sweep": f"""{with_views('appearance')}, {SIM}, h AS (SELECT q.vec_id AS q_id, g.vec_id, round(list_dot_product(q.embedding[1:32], g.embedding[1:32])
            / (sqrt(list_dot_product(q.embedding[1:32], q.embedding[1:32])) * sqrt(list_dot_product(g.embedding[1:32], g.embedding[1:32]))), 9) AS other FROM q JOIN appearance g ON g.frame <> q.frame),
        f AS (SELECT weight, s.q_id, q_identity, identity, round((1 - weight) * similarity + weight * other, 9) AS fused, s.vec_id
            FROM sims s JOIN h ON h.q_id = s.q_id AND h.vec_id = s.vec_id, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) v(weight)),
        t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY weight, q_id ORDER BY fused DESC, vec_id) = 1)
        SELECT weight, round(avg(CASE WHEN identity = q_identity THEN 1 ELSE 0 END), 6) AS rank1 FROM t GROUP BY weight""",
    "track_summary": f"""{OBS}, {SCORED}, {EXT}, rk AS (SELECT track_id, rn, candidate, round(votes * share * CASE WHEN locked THEN boost ELSE 1 END, 4) AS sc FROM ordered WHERE rn <= 5),
        ls AS (SELECT track_id, string_agg(rn || ':' || candidate || ':' || CAST(round(sc * 10000) AS BIGINT), ',' ORDER BY rn) AS candidates FROM rk GROUP BY track_id)
        SELECT e.track_id, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s, round(duration, 3) AS duration, CASE WHEN locked OR share >= 0.3 THEN candidate END AS candidate, round(votes * share * boost, 4) AS score, candidates
        FROM ext e LEFT JOIN ordered o ON o.track_id = e.track_id AND rn = 1 LEFT JOIN ls ON ls.track_id = e.track_id""",
    "team_flip_segments": f"""{OBS}, t AS (SELECT track_id, seq, CASE WHEN seq % 4 = 0 THEN NULL WHEN prob > 0.5 THEN 'home' ELSE 'away' END AS team FROM observations),
        r AS (SELECT *, row_number() OVER o AS i, coalesce(lead(team, 1) OVER o, lead(team, 2) OVER o, lead(team, 3) OVER o) AS ahead FROM t WINDOW o AS (PARTITION BY track_id ORDER BY seq)),
        st AS (SELECT DISTINCT track_id, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS team, NULL::VARCHAR AS cur, 0::BIGINT AS segment FROM r
            UNION ALL SELECT r.track_id, r.i, r.seq, r.team, CASE WHEN r.team IS NULL THEN cur WHEN cur IS NULL OR (r.team <> cur AND ahead = r.team) THEN r.team ELSE cur END,
                segment + CASE WHEN coalesce(r.team <> cur AND ahead = r.team, FALSE) THEN 1 ELSE 0 END FROM st s JOIN r ON r.track_id = s.track_id AND r.i = s.i + 1)
        SELECT track_id, seq, team, CAST(segment AS INT) AS segment FROM st WHERE seq IS NOT NULL""",
    "two_means": f"""{OBS}, pt AS (SELECT track_id AS id, round(avg(quality), 6) AS r, round(avg(prob), 6) AS g, round(max(prob), 6) AS b FROM observations GROUP BY track_id),
        lo AS (SELECT * FROM pt ORDER BY r, id LIMIT 1), hi AS (SELECT * FROM pt ORDER BY r DESC, id DESC LIMIT 1),
        it AS (SELECT 0 AS k, lo.r AS r0, lo.g AS g0, lo.b AS b0, hi.r AS r1, hi.g AS g1, hi.b AS b1 FROM lo, hi UNION ALL
            SELECT k + 1, coalesce(avg(r) FILTER (c = 0), any_value(r0)), coalesce(avg(g) FILTER (c = 0), any_value(g0)), coalesce(avg(b) FILTER (c = 0), any_value(b0)),
                coalesce(avg(r) FILTER (c = 1), any_value(r1)), coalesce(avg(g) FILTER (c = 1), any_value(g1)), coalesce(avg(b) FILTER (c = 1), any_value(b1))
            FROM (SELECT *, CASE WHEN (r - r1) ** 2 + (g - g1) ** 2 + (b - b1) ** 2 < (r - r0) ** 2 + (g - g0) ** 2 + (b - b0) ** 2 THEN 1 ELSE 0 END AS c FROM it, pt WHERE k < 12) GROUP BY k)
        SELECT id, r, g, b, CASE WHEN (r - r1) ** 2 + (g - g1) ** 2 + (b - b1) ** 2 < (r - r0) ** 2 + (g - g0) ** 2 + (b - b0) ** 2 THEN 1 ELSE 0 END AS cluster FROM pt, it WHERE k = 12""",
    "kit_distances": f"""WITH kit AS (SELECT p_partkey, CAST(p_partkey % 256 AS INT) AS r, CAST(p_partkey * 7 % 256 AS INT) AS g, CAST(p_partkey * 13 % 256 AS INT) AS b,
            CAST(p_partkey * 3 % 256 AS INT) AS r2, CAST(p_partkey * 5 % 256 AS INT) AS g2, CAST(p_partkey * 11 % 256 AS INT) AS b2 FROM part),
        mm AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM kit),
        hs AS (SELECT p_partkey, {HSV} AS hue, CAST(round(CASE WHEN mx = 0 THEN 0 ELSE 255.0::DOUBLE * (mx - mn) / mx END) AS INT) AS saturation, mx AS brightness FROM mm),
        ch AS (SELECT p_partkey, 1 AS side, {", ".join(_linear(c) + f" AS {c}" for c in "rgb")} FROM kit UNION ALL SELECT p_partkey, 2, {", ".join(_linear(c + "2") for c in "rgb")} FROM kit),
        xyz AS (SELECT p_partkey, side, (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456 AS x, 0.212671 * r + 0.715160 * g + 0.072169 * b AS y, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754 AS z FROM ch),
        lab AS (SELECT p_partkey, side, round((CASE WHEN y > 0.008856 THEN 116.0 * cbrt(y) - 16.0 ELSE 903.3 * y END) * 255 / 100) AS l, round(500.0 * ({_root("x")} - {_root("y")}) + 128) AS a, round(200.0 * ({_root("y")} - {_root("z")}) + 128) AS b FROM xyz)
        SELECT p_partkey, hue, saturation, brightness, round(sqrt((0.4 * (u.l - v.l)) ** 2 + (u.a - v.a) ** 2 + (u.b - v.b) ** 2) / 255.0, 4) AS distance
        FROM hs JOIN lab u USING (p_partkey) JOIN lab v USING (p_partkey) WHERE u.side = 1 AND v.side = 2""",
    "weighted_centroids": f"""{with_views('appearance')}, e AS (SELECT identity, greatest(0.01, (vec_id % 10) / 10.0::DOUBLE) AS w, unnest(embedding) AS v, unnest(range(64)) AS place FROM appearance),
        m AS (SELECT identity, place, sum(v * w) / sum(w) AS v, count(*) AS n FROM e GROUP BY ALL)
        SELECT identity, n, CAST(place AS INT) AS place, round(v / sqrt(sum(v * v) OVER (PARTITION BY identity)), 6) AS value FROM m""",
    "track_ends": f"""{FRAG} SELECT track_id, min(seq) AS first_seq, round(arg_min(x, seq), 4) AS first_x, max(seq) AS last_seq, round(arg_max(x, seq), 4) AS last_x FROM fragments GROUP BY track_id""",
    "window_votes": f"""{FRAG}, {SPANS}, og AS (SELECT min(start_s) AS o, max(end_s) AS e FROM spans),
        win AS (SELECT o + i * 43200.0::DOUBLE AS s FROM og, range(0, CAST(floor((e + 1e-6 - o) / 43200) AS BIGINT) + 1) r(i)),
        act AS (SELECT track_id, greatest(0, least(s + 86400, end_s) - greatest(s, start_s)) / 3600 AS ov FROM win JOIN spans ON start_s <= s + 86400 AND end_s >= s),
        p AS (SELECT track_id, candidate, avg(prob) AS p FROM fragments GROUP BY ALL), v AS (SELECT track_id, candidate AS label, sum(p * greatest(0.05, ov)) AS vote FROM act JOIN p USING (track_id) GROUP BY ALL)
        SELECT track_id, label, round(vote, 6) AS vote FROM v QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY v.vote DESC, label) = 1""",
    "canonical_labels": f"""{FRAG}, {MEMBERS}, t AS (SELECT cluster_id, team FROM mem QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, track_id) = 1),
        s AS (SELECT cluster_id, label, sum(score) AS total FROM mem GROUP BY ALL), ok AS (SELECT s.* FROM s JOIN t USING (cluster_id) WHERE CAST(label AS INT) % 5 = team),
        b AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY total DESC, label) = 1)
        SELECT cluster_id, team, label, round(total, 6) AS total FROM t LEFT JOIN b USING (cluster_id)""",
    "label_overrides": f"""{FRAG}, {MEMBERS}, w AS (SELECT *, count(*) OVER c AS n, first_value(score) OVER o AS ts, first_value(label) OVER o AS tl FROM mem
            WINDOW c AS (PARTITION BY cluster_id), o AS (PARTITION BY cluster_id ORDER BY score DESC, track_id))
        SELECT track_id, CASE WHEN n >= 2 AND ts > score + 0.15 THEN tl ELSE label END AS label, n >= 2 AND ts > score + 0.15 AS overridden FROM w""",
    "cluster_ownership": f"""{FRAG}, {MEMBERS}, u AS (SELECT cluster_id, track_id, score FROM mem UNION ALL SELECT cluster_id + 1, track_id, score + CASE WHEN track_id % 2 = 0 THEN 1 ELSE 0 END FROM mem)
        SELECT track_id, cluster_id FROM u QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY score DESC, cluster_id) = 1""",
    "kit_fit": f"""{OBS}, k AS (SELECT track_id, CASE WHEN seq % 7 <> 0 THEN prob END AS a, CASE WHEN seq % 5 <> 0 THEN quality END AS b FROM observations),
        r AS (SELECT *, CASE WHEN b IS NULL THEN 1 - least(1, a) ELSE 0.58 * (1 - least(1, a)) + 0.42 * (1 - least(1, b)) END AS raw FROM k)
        SELECT track_id, round(max(CASE WHEN a IS NULL THEN 0.5 WHEN b > 0.5 THEN least(0.42, raw) ELSE raw END), 6) AS fit FROM r GROUP BY track_id""",
    "registry_merge": f"""{with_views('appearance')}, {SIM}, nn AS (SELECT q_id, identity AS found FROM sims QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, vec_id) = 1 AND similarity >= 0.2),
        h AS (SELECT vec_id AS track_id, CASE WHEN vec_id % 3 <> 0 THEN identity END AS held, (vec_id % 10) / 10.0::DOUBLE + (vec_id % 60) / 100.0::DOUBLE AS confidence FROM q),
        j AS (SELECT *, found IS NULL OR (held IS NOT NULL AND held <> found AND confidence >= 0.5) AS keeps FROM h LEFT JOIN nn ON q_id = track_id)
        SELECT track_id, CASE WHEN keeps THEN held ELSE found END AS identity, NOT keeps AND held IS DISTINCT FROM found AS merged FROM j""",
    "set_operations": f"""{OBS}, a AS (SELECT DISTINCT track_id FROM observations WHERE candidate = 'click' AND prob > 0.9), b AS (SELECT DISTINCT track_id FROM observations WHERE candidate = 'purchase' AND prob > 0.9)
        SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
        UNION ALL SELECT 'only_b', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""",
    "strided_observations": f"""{OBS}, z AS (SELECT frame_index, frame_index - (SELECT min(frame_index) FROM observations) AS d FROM observations)
        SELECT frame_index, count(*) AS n FROM z WHERE d < 200 AND d % 3 = 0 GROUP BY frame_index""",
    "box_shapes": f"""{with_views('gt_boxes')}, c AS (SELECT gt_id, greatest(0, least(959, x1)) AS x1, greatest(0, least(539, y1)) AS y1, greatest(0, least(959, x2)) AS x2, greatest(0, least(539, y2)) AS y2 FROM gt_boxes)
        SELECT gt_id, round((x1 + x2) / 2, 4) AS cx, round((y1 + y2) / 2, 4) AS cy, round(y2, 4) AS foot_y, round((x2 - x1) * (y2 - y1), 4) AS area FROM c
        WHERE (x2 - x1) * (y2 - y1) >= 400 AND (y2 - y1) / greatest(1, x2 - x1) >= 1""",
    "track_documents": f"""{FRAG} SELECT track_id, min(seq) AS "first", max(seq) AS "last", count(*) AS num_observations, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS seqs FROM fragments GROUP BY track_id""",
    "ema_vectors": f"""{with_views('appearance')}, o AS (SELECT identity, embedding[1] AS v, row_number() OVER (PARTITION BY identity ORDER BY vec_id) AS i, count(*) OVER (PARTITION BY identity) AS n FROM appearance)
        SELECT identity, round(sum(v * CASE WHEN i = 1 THEN 0.8::DOUBLE ** (n - 1) ELSE 0.2 * 0.8::DOUBLE ** (n - i) END), 6) AS value FROM o GROUP BY identity""",
    "synthetic_paths": f"{PATHS} SELECT path, frame, round(x, 4) AS x, round(y, 4) AS y FROM pth",
    "ball_path": f"""{PATHS} SELECT f.path AS ball, g.frame, round(CASE WHEN g.frame < 11 THEN f.x + (g.frame * 4 / 41.0::DOUBLE) * (500 - f.x) ELSE pth.x + 14 END, 4) AS x,
        round(CASE WHEN g.frame < 11 THEN f.y + (g.frame * 4 / 41.0::DOUBLE) * (150 - f.y) ELSE pth.y + 42 END, 4) AS y
        FROM pts f, (SELECT unnest(range(60)) AS frame) g JOIN pth ON pth.path = f.path AND pth.frame = g.frame WHERE f.t = 0""",
    "anonymous_rosters": """SELECT n_name AS player, r_name AS team, CAST(n_nationkey AS VARCHAR) AS jersey, 'FW' AS position FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 2
        UNION ALL SELECT r_name || ' #' || n, r_name, CAST(n AS VARCHAR), '?' FROM region, (VALUES (4), (10), (7)) v(n) WHERE r_regionkey = 2
        UNION ALL SELECT CASE WHEN r_regionkey = 3 THEN 'Anon' ELSE r_name END || ' roster slot ' || i, r_name, CAST(i AS VARCHAR), ['GK', 'DF', 'DF', 'DF', 'DF', 'MF', 'MF', 'MF', 'FW', 'FW', 'FW'][i]
        FROM region, range(1, 12) r(i) WHERE r_regionkey > 2""",
    "kit_settings": """WITH c AS (SELECT n_name AS team, n_nationkey % 6 AS kind, lpad(upper(to_hex(CAST(n_nationkey AS BIGINT) * 654321 % 16777216)), 6, '0') AS hex FROM nation),
        p AS (SELECT team, 'shirt' AS part, hex FROM c WHERE kind IN (0, 1, 2, 5) UNION ALL SELECT team, 'shorts', '00ff00' FROM c WHERE kind = 1)
        SELECT team, part, CAST(('0x' || substr(hex, 1, 2)) AS INT) AS r, CAST(('0x' || substr(hex, 3, 2)) AS INT) AS g, CAST(('0x' || substr(hex, 5, 2)) AS INT) AS b FROM p""",
    "detected_frames": f"""{with_views("gt_boxes")}, b AS (SELECT gt_id, ['person', 'ball', 'referee'][i % 3 + 1] AS label, 1 - 0.3::DOUBLE * i AS confidence, x1 + 30 * i - 100 AS a, x1 + 30 * i - 70 AS c, y1
            FROM (SELECT *, unnest(range(CAST(x1 / 10 AS INT) % 4)) AS i FROM gt_boxes)),
        k AS (SELECT gt_id, label, round(confidence, 6) AS confidence, round(greatest(0, least(800, a)), 6) AS x1, round(greatest(0, least(250, y1)), 6) AS y1, round(greatest(0, least(800, c)), 6) AS x2,
            round(greatest(0, least(250, y1 + 48)), 6) AS y2 FROM b WHERE label <> 'referee' AND confidence >= 0.5)
        SELECT * FROM k WHERE x2 > x1 AND y2 > y1""",
    "idf_extremes": f"""{OBS}, {IDF}, e AS (SELECT candidate, weight, row_number() OVER (ORDER BY weight, candidate) AS lo, row_number() OVER (ORDER BY weight DESC, candidate) AS hi FROM idf)
        SELECT candidate, round(weight, 6) AS weight FROM e WHERE lo <= 2 OR hi <= 2""",
}
SQL["best_weight"] = f"SELECT * FROM ({SQL['fusion_sweep']}) ORDER BY rank1 DESC, weight LIMIT 1"
