"""DuckDB SQL for the queries on evidence, filters, registries, evaluation and generated inputs."""

from __future__ import annotations

from tracklake.plans.oracles import FRAG, HSV, OBS, PAIRS, SPANS, TEAMD, VOTES, C, _gaps
from tracklake.sources.views import with_views

FUSION = with_views("observations", "gt_boxes", "squad", "summary")
TEAMP = f"""{TEAMD}, teamp AS (SELECT track_id, r_name AS team, prob FROM tp JOIN region ON r_regionkey = t WHERE (track_id + t) % 7 <> 0)"""
LABELP = f"""lw AS (SELECT track_id, CAST(seq % 11 AS VARCHAR) AS candidate, sum({C}) AS c FROM observations WHERE track_id % 6 <> 5 GROUP BY ALL),
labp AS (SELECT track_id, candidate, CASE WHEN sum(c) OVER t > 0 THEN c / sum(c) OVER t ELSE 0 END AS prob FROM lw WINDOW t AS (PARTITION BY track_id))"""


def _sims(name: str, a: int, b: int, n: int) -> str:
    return f"{name} AS (SELECT track_id, player, ((track_id * {b} + nr * {a}) % 101) / 100.0::DOUBLE AS sim FROM summary, squad WHERE (track_id * {a} + nr * {b}) % {n} = 0)"


PRIOR = """CASE WHEN position = '' THEN 0.5 ELSE greatest(0.05, least(0.95, 0.5 + 0.12 * CASE position WHEN 'GK' THEN CASE WHEN sy > 35 THEN -0.04 ELSE 0.03 END
    WHEN 'DF' THEN CASE WHEN sy < 90 THEN 0.01 ELSE -0.01 END WHEN 'MF' THEN CASE WHEN sy >= 15 THEN 0.02 ELSE 0 END WHEN 'FW' THEN CASE WHEN my > 0 THEN 0.01 ELSE 0 END ELSE 0 END)) END"""
YY = "yy AS (SELECT name AS track_id, avg((y1 + y2) / 2) AS my, max((y1 + y2) / 2) - min((y1 + y2) / 2) AS sy FROM gt_boxes GROUP BY name)"
TRACKCONF = "least(0.99, 0.35 + 0.35 * least(1, n / 18) + 0.30 * mean_quality)"
FUSED = f"""{FUSION}, {TEAMP}, {LABELP}, {YY}, {_sims("heads", 3, 5, 4)}, {_sims("bodies", 7, 2, 3)},
sc AS (SELECT e.track_id, s.player, s.team, 2.0 * ln(greatest(coalesce(tq.prob, 0.5), 1e-6))
    + 3.2 * CASE WHEN e.track_id IN (SELECT track_id FROM labp) THEN greatest(0.15, mean_quality) * ln(greatest(coalesce(l.prob, 1e-4), 1e-6)) ELSE 0.05 * ln(0.72) END
    + coalesce(2 * h.sim - 1, 0) + CASE WHEN b.sim > 0 THEN 0.6 * (2 * b.sim - 1) ELSE 0 END + 0.35 * ln({PRIOR}) + 0.25 * ln({TRACKCONF}) AS score
    FROM ext e JOIN yy USING (track_id) CROSS JOIN squad s LEFT JOIN teamp tq ON tq.track_id = e.track_id AND tq.team = s.team
    LEFT JOIN labp l ON l.track_id = e.track_id AND l.candidate = s.jersey LEFT JOIN heads h ON h.track_id = e.track_id AND h.player = s.player
    LEFT JOIN bodies b ON b.track_id = e.track_id AND b.player = s.player),
ex AS (SELECT *, exp(score - max(score) OVER (PARTITION BY track_id)) AS x FROM sc),
fused AS (SELECT track_id, player, team, score, x / sum(x) OVER (PARTITION BY track_id) AS posterior FROM ex)"""
BODY = """body AS (SELECT track_id, CASE WHEN count(*) FILTER (hb) > 0 THEN 0.4 * avg(quality) FILTER (hb) + 0.6 * least(1, count(*) FILTER (hb) / 20.0) ELSE 0 END AS body_confidence
    FROM (SELECT *, seq % 3 = 0 AND track_id % 8 <> 1 AS hb FROM observations) GROUP BY track_id)"""
SUM = with_views("summary", "squad")
VISIBLE = "visible AS (SELECT team, jersey FROM squad WHERE team <> 'ASIA' AND nr % 3 <> 0)"
FIRST = "firsts AS (SELECT team, jersey, arg_min(player, nr) AS player FROM squad GROUP BY team, jersey)"
_new = {
    "team_confidence": "coalesce(tq.prob, 0)",
    "label_confidence": "coalesce(l.prob, 0)",
    "head_confidence": "coalesce(h.sim, 0)",
    "body_confidence": "round(b.body_confidence, 6)",
    "tracking_confidence": TRACKCONF.replace("n /", "f.n /"),
    "position_prior": PRIOR,
    "likelihood": "mean_prob",
}
REFRESH = f"""{FUSION}, {TEAMP}, {LABELP}, {YY}, {BODY}, {_sims("heads", 3, 5, 4)}, facts AS (SELECT * FROM ext JOIN yy USING (track_id) WHERE track_id % 12 <> 3)
SELECT s.track_id, f.track_id IS NOT NULL AND q.player IS NOT NULL AS refreshed,
    {", ".join(f"round(CASE WHEN f.track_id IS NOT NULL AND q.player IS NOT NULL THEN {v} WHEN s.track_id % 4 <> 2 THEN round(s.confidence, 4) * {k} END, 6) AS {n}" for k, (n, v) in enumerate(_new.items(), 1))}
FROM summary s LEFT JOIN squad q ON q.player = s.resolved LEFT JOIN facts f ON f.track_id = s.track_id LEFT JOIN body b ON b.track_id = s.track_id
LEFT JOIN teamp tq ON tq.track_id = s.track_id AND tq.team = q.team LEFT JOIN labp l ON l.track_id = s.track_id AND l.candidate = q.jersey
LEFT JOIN heads h ON h.track_id = s.track_id AND h.player = s.resolved"""
BEST = """bs AS (SELECT *, CASE WHEN sum(votes) OVER t > 0 THEN votes / sum(votes) OVER t ELSE 0 END AS share, peaks >= 2 AS locked, 1 + least(1, peaks / 2.0) AS boost FROM votes WINDOW t AS (PARTITION BY track_id)),
bc AS (SELECT track_id, CASE WHEN locked OR share >= 0.3 THEN candidate END AS candidate, round(votes * share * boost, 6) AS score FROM bs
    QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY locked DESC, CASE WHEN locked THEN peaks ELSE 0 END DESC, votes DESC, candidate) = 1)"""
RGB = "SELECT gt_id, x1::BIGINT % 256 AS r, floor(y1)::BIGINT % 256 AS g, gt_id % 256 AS b FROM gt_boxes"
_SAT = "CAST(round(CASE WHEN mx = 0 THEN 0 ELSE 255.0::DOUBLE * (mx - mn) / mx END) AS INT)"
_far = lambda a, b: f"least(abs({a} - {b}), 180 - abs({a} - {b}))"


def _hsv(name: str, source: str, cols: tuple[str, str, str], hue: str, sat: str) -> str:
    r, g, b = cols
    return f"""{name} AS (SELECT * EXCLUDE (mx, mn, r, g, b), {HSV} AS {hue}, {_SAT} AS {sat} FROM
        (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM (SELECT *, {r} AS r, {g} AS g, {b} AS b FROM {source})))"""


def _med(k: int, m: int, shorts: bool = False) -> str:
    return f"quantile_cont(CASE WHEN {'name % 6 <> 0' if shorts else 'TRUE'} THEN (name * {k} + gt_id % 4) % {m} END, 0.5)"


ROLES = f"""{with_views("gt_boxes")}, kit AS (SELECT name AS track_id, count(*) AS n, {_med(13, 256)} AS kr, {_med(29, 256)} AS kg, {_med(47, 256)} AS kb,
    {_med(13, 200, True)} AS sr, {_med(29, 200, True)} AS sg, {_med(47, 200, True)} AS sb FROM gt_boxes GROUP BY name),
{_hsv("a1", "kit", ("CAST(floor(kr) AS INT)", "CAST(floor(kg) AS INT)", "CAST(floor(kb) AS INT)"), "hue", "saturation")},
{_hsv("a2", "a1", ("CAST(floor(sr) AS INT)", "CAST(floor(sg) AS INT)", "CAST(floor(sb) AS INT)"), "sh", "ss")},
a3 AS (SELECT *, least({_far("hue", 30)}, {_far("hue", 100)}) AS far, coalesce((sr + sg + sb) / 3 < 100, FALSE) AS dark, coalesce(ss >= 30 AND {_far("sh", "hue")} <= 20, FALSE) AS alike FROM a2)
SELECT track_id, hue, saturation, CASE WHEN n < 5 OR saturation < 30 THEN NULL WHEN far >= 35 AND dark THEN 'referee' WHEN far >= 55 AND alike AND NOT dark THEN 'goalkeeper' END AS role FROM a3"""
READS = f"""reads AS (SELECT seq AS obs_id, track_id, team, CAST(seq % 10 AS VARCHAR) AS candidate, frame_index AS frame, {C} AS contribution FROM observations JOIN summary USING (track_id)),
forced AS (SELECT obs_id, player FROM reads r JOIN firsts f ON f.team = r.team AND f.jersey = r.candidate WHERE contribution >= 0.5)"""
REG = with_views("summary", "squad", "appearance")
UNIT = "list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding)))"
COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"
REASSIGN = f"""{REG}, {FIRST}, {READS}, emb AS (SELECT r.*, embedding FROM reads r JOIN appearance a ON a.vec_id = (obs_id * 3) % 500 AND obs_id % 6 <> 0),
gal AS (SELECT player, team, embedding FROM squad JOIN appearance ON vec_id = nr),
prs AS (SELECT frame, obs_id, player, {COS.format("e.embedding", "g.embedding")} AS sim FROM emb e JOIN gal g ON e.team IS NULL OR e.team = g.team
    WHERE e.obs_id NOT IN (SELECT obs_id FROM forced) AND NOT EXISTS (SELECT 1 FROM forced f JOIN reads r ON r.obs_id = f.obs_id WHERE r.frame = e.frame AND f.player = g.player)),
ord AS (SELECT frame, obs_id, row_number() OVER (PARTITION BY frame ORDER BY obs_id) AS r FROM (SELECT DISTINCT frame, obs_id FROM prs)),
step AS (SELECT DISTINCT frame, 0::BIGINT AS r, CAST([] AS VARCHAR[]) AS used, NULL::BIGINT AS obs_id, NULL::VARCHAR AS player FROM prs
    UNION ALL SELECT frame, r, CASE WHEN ok THEN list_append(used, p[1]) ELSE used END, obs_id, CASE WHEN ok THEN p[1] END FROM
        (SELECT *, len(p) > 0 AND s[1] >= 0.1 AND s[1] - coalesce(s[2], -2) >= 0.02 AS ok FROM
            (SELECT s.frame, s.r + 1 AS r, any_value(s.used) AS used, any_value(o.obs_id) AS obs_id, coalesce(list(c.player ORDER BY c.sim DESC, c.player) FILTER (c.player IS NOT NULL), []) AS p,
                coalesce(list(c.sim ORDER BY c.sim DESC, c.player) FILTER (c.player IS NOT NULL), []) AS s
            FROM step s JOIN ord o ON o.frame = s.frame AND o.r = s.r + 1 LEFT JOIN prs c ON c.obs_id = o.obs_id AND NOT list_contains(s.used, c.player) GROUP BY s.frame, s.r))),
done AS (SELECT obs_id, player, TRUE AS forced FROM forced UNION ALL SELECT obs_id, player, FALSE FROM step WHERE player IS NOT NULL)"""


def _greedy(group: str, least: float) -> str:
    """Matches of ``prs`` (group, p, t, iou): by ascending p each takes its best free t."""
    return f"""ord AS (SELECT {group}, p, row_number() OVER (PARTITION BY {group} ORDER BY p) AS r FROM (SELECT DISTINCT {group}, p FROM prs)),
step AS (SELECT DISTINCT {group}, 0::BIGINT AS r, CAST([] AS BIGINT[]) AS used, NULL::BIGINT AS p, NULL::BIGINT AS t, NULL::DOUBLE AS iou FROM prs
    UNION ALL SELECT {group}, r, CASE WHEN i[1] >= {least} THEN list_append(used, ts[1]) ELSE used END, p, CASE WHEN i[1] >= {least} THEN ts[1] END, i[1] FROM
        (SELECT s.{group}, s.r + 1 AS r, any_value(s.used) AS used, any_value(o.p) AS p, list(c.t ORDER BY c.iou DESC, c.t) FILTER (c.t IS NOT NULL) AS ts, list(c.iou ORDER BY c.iou DESC, c.t) FILTER (c.t IS NOT NULL) AS i
        FROM step s JOIN ord o ON o.{group} = s.{group} AND o.r = s.r + 1 LEFT JOIN prs c ON c.{group} = s.{group} AND c.p = o.p AND NOT list_contains(s.used, c.t) GROUP BY s.{group}, s.r)),
done AS (SELECT * FROM step WHERE t IS NOT NULL)"""


def _boxes(least: float) -> str:
    return f"""{with_views("gt_boxes", "pred_boxes")}, {PAIRS}, prs AS (SELECT frame, gt_id AS p, pred_id AS t, iou FROM pairs WHERE iou >= {least}), {_greedy("frame", least)}
        SELECT frame, p AS gt_id, t AS pred_id, round(iou, 6) AS iou FROM done"""


INTERVALS = f"""{FRAG}, {SPANS}, iv AS (SELECT track_id AS id, user_id % 3 AS label, start_s, end_s + 30000 AS end_s FROM spans), ip AS (SELECT * FROM iv WHERE id % 2 = 1), it AS (SELECT * FROM iv WHERE id % 2 = 0),
prs AS (SELECT p.label, p.id AS p, t.id AS t, (least(p.end_s, t.end_s) - greatest(p.start_s, t.start_s)) / (greatest(p.end_s, t.end_s) - least(p.start_s, t.start_s)) AS iou
    FROM ip p JOIN it t ON p.label = t.label AND least(p.end_s, t.end_s) > greatest(p.start_s, t.start_s)), {_greedy("label", 0.3)}"""

SMOOTH = """nb(c, others) AS (VALUES ('0', '89'), ('1', '74'), ('2', '73'), ('3', '852'), ('4', '196'), ('5', '683'), ('6', '5840'), ('7', '12'), ('8', '35906'), ('9', '84'))"""
KNOWN = "known AS (SELECT CAST(i AS VARCHAR) AS candidate FROM range(14) r(i) WHERE i % 5 <> 1)"


def _reader(n: str, k: int) -> str:
    return f"""m{n} AS (SELECT seq // 6 AS item, CAST((seq * {k}) % 13 AS VARCHAR) AS candidate, max(round(prob, 6)) AS p FROM observations GROUP BY ALL),
d{n} AS (SELECT item, candidate, CASE WHEN sum(p) OVER t > 0 THEN p / sum(p) OVER t ELSE 0 END AS p FROM m{n} WINDOW t AS (PARTITION BY item)),
al{n} AS (SELECT * FROM d{n} UNION ALL SELECT item, substr(candidate, 1, i - 1) || substr(others, j, 1) || substr(candidate, i + 1), p * 0.6 FROM d{n}, range(1, 3) r(i), nb, range(1, 6) s(j)
        WHERE i <= length(candidate) AND c = substr(candidate, i, 1) AND j <= length(others) UNION ALL SELECT item, x || candidate, p * 0.6 FROM d{n}, (VALUES ('1'), ('2')) v(x) WHERE length(candidate) = 1),
g{n} AS (SELECT item, candidate, sum(p) AS p FROM al{n} GROUP BY ALL),
s{n} AS (SELECT item, candidate, CASE WHEN sum(p) OVER t > 0 THEN p / sum(p) OVER t ELSE 0 END AS p FROM g{n} WINDOW t AS (PARTITION BY item)),
k{n} AS (SELECT * FROM s{n} SEMI JOIN known USING (candidate))"""


def _judged(source: str, right: str) -> str:
    return f"""fin AS (SELECT item, candidate, round(CASE WHEN sum(p) OVER t > 0 THEN p / sum(p) OVER t ELSE p END, 9) AS prob FROM {source} WINDOW t AS (PARTITION BY item)),
rkd AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY prob DESC, candidate) AS rn FROM fin), truth AS (SELECT seq // 6 AS item, CAST(max(seq) % 13 AS VARCHAR) AS truth FROM observations GROUP BY ALL),
tops AS (SELECT item, max(CASE WHEN rn = 1 THEN candidate END) AS top, list(candidate) AS three FROM rkd WHERE rn <= 3 GROUP BY item),
jd AS (SELECT truth, coalesce(top, '<none>') AS found, coalesce({right}, FALSE) AS ok, coalesce(list_contains(three, truth), FALSE) AS top3 FROM truth LEFT JOIN tops USING (item))"""


STACK = f"{OBS}, {SMOOTH}, {KNOWN}, {_reader('a', 5)}, {_judged('ka', 'top = truth')}"
ENSEMBLE = f"""{OBS}, {SMOOTH}, {KNOWN}, {_reader('a', 5)}, {_reader('b', 7)},
two AS (SELECT item, candidate, sum(p) AS p FROM (SELECT * FROM ka UNION ALL SELECT item, candidate, p * 0.8 FROM kb) GROUP BY ALL), {_judged('two', 'top = truth OR contains(top, truth) OR contains(truth, top)')}"""
READ_SUMMARY = """SELECT count(*) AS total, count(*) FILTER (ok) AS correct, count(*) FILTER (top3) AS top3_recall, round(100.0 * count(*) FILTER (ok) / greatest(1, count(*)), 6) AS accuracy_pct,
    round(100.0 * count(*) FILTER (top3) / greatest(1, count(*)), 6) AS top3_pct FROM jd"""
DISPLAY = f"""{SUM}, sh AS (SELECT track_id, resolved AS name, CAST(floor(start_s / 86400) AS BIGINT) AS a, CAST(floor(end_s / 86400) AS BIGINT) AS z FROM summary WHERE duration >= 20 AND confidence >= 0.48 AND resolved IS NOT NULL),
cv AS (SELECT name, count(DISTINCT track_id) AS fragments, count(DISTINCT s) AS seconds FROM (SELECT *, unnest(range(a, z + 1)) AS s FROM sh) GROUP BY name), ep AS (SELECT player AS name FROM squad),
rp AS (SELECT coalesce(cv.name, ep.name) AS name, ep.name IS NOT NULL AS expected, cv.name IS NOT NULL AS displayed, coalesce(fragments, 0) AS fragments, coalesce(seconds, 0) AS seconds FROM cv FULL JOIN ep ON cv.name = ep.name)"""
EDGES = f"""{with_views("fragments", "squad", "appearance")}, {SPANS}, {VISIBLE},
tr AS (SELECT s.track_id, row_number() OVER (ORDER BY start_s, s.track_id) AS seq, CASE WHEN s.track_id % 7 <> 0 THEN r_name END AS team, CASE WHEN s.track_id % 4 <> 0 THEN CAST(user_id % 8 AS VARCHAR) END AS jersey,
    start_s, end_s, x0, y0, x1, y1, embedding AS e FROM spans s JOIN region ON r_regionkey = s.team JOIN appearance ON vec_id = (user_id % 25) * 20 + s.track_id % 3)
SELECT DISTINCT CASE WHEN a.seq < b.seq THEN a.track_id ELSE b.track_id END AS a, CASE WHEN a.seq < b.seq THEN b.track_id ELSE a.track_id END AS b
FROM tr a JOIN tr b ON a.track_id <> b.track_id AND b.start_s - a.end_s BETWEEN -3600 AND 32400
WHERE coalesce(a.team = b.team, TRUE) AND (b.start_s <= a.end_s OR sqrt((a.x1 - b.x0) ** 2 + (a.y1 - b.y0) ** 2) <= 400) AND {COS.format("a.e", "b.e")} >= 0.2
    AND NOT (coalesce(a.jersey <> b.jersey, FALSE) AND (coalesce(coalesce(a.team, b.team) NOT IN (SELECT team FROM visible), TRUE)
        OR (EXISTS (SELECT 1 FROM visible v WHERE v.team = coalesce(a.team, b.team) AND v.jersey = a.jersey) AND EXISTS (SELECT 1 FROM visible v WHERE v.team = coalesce(a.team, b.team) AND v.jersey = b.jersey))))"""
SWITCH = f"""{with_views("fragments", "appearance")}, fr AS (SELECT f.track_id, seq, x, y, embedding AS e FROM fragments f LEFT JOIN appearance ON seq % 5 <> 0 AND vec_id = (user_id * 7 + seq // 40) % 500),
w AS (SELECT *, sqrt((x - lag(x) OVER o) ** 2 + (y - lag(y) OVER o) ** 2) / greatest(1, seq - lag(seq) OVER o) AS gone,
    last_value(e IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM fr WINDOW o AS (PARTITION BY track_id ORDER BY seq)),
c AS (SELECT *, CASE WHEN coalesce(gone > 60, FALSE) OR (e IS NOT NULL AND seen IS NOT NULL AND {COS.format("e", "seen")} < 0.05) THEN 1 ELSE 0 END AS cut FROM w)
SELECT track_id, seq, sum(cut) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM c"""
REGISTRY = f"""{REG}, {VISIBLE}, anch AS (SELECT s.track_id, q.player, q.team FROM summary s JOIN squad q ON q.player = s.resolved
    WHERE confidence >= 0.45 AND CASE WHEN s.track_id % 3 <> 0 THEN q.jersey ELSE s.jersey END = q.jersey AND (q.team NOT IN (SELECT team FROM visible) OR EXISTS (SELECT 1 FROM visible v WHERE v.team = q.team AND v.jersey = q.jersey))),
ob AS (SELECT track_id, embedding, {C} AS peak FROM observations JOIN appearance ON seq % 4 <> 0 AND vec_id = seq % 500),
good AS (SELECT track_id FROM ob GROUP BY track_id HAVING count(*) FILTER (peak >= 0.5) >= 3), rw AS (SELECT player, team, embedding FROM ob JOIN good USING (track_id) JOIN anch USING (track_id)),
cn AS (SELECT player, team, count(*) AS n FROM rw GROUP BY ALL HAVING count(*) >= 5), un AS (SELECT player, team, unnest(embedding) AS v, unnest(range(64)) AS place FROM rw),
md AS (SELECT player, team, place, quantile_cont(v, 0.5) AS v FROM un GROUP BY ALL)
SELECT player, team, n, CAST(place AS INT) AS place, round(v / sqrt(sum(v * v) OVER (PARTITION BY player, team)), 6) AS value FROM md JOIN cn USING (player, team)"""
LOCATION = f"""{with_views("fragments", "appearance")}, an AS (SELECT user_id AS key, ts_s AS t, quantile_cont(x, 0.5) AS x, quantile_cont(y, 0.5) AS y FROM fragments WHERE seq % 3 = 0 GROUP BY ALL),
lo AS (SELECT seq AS obs_id, track_id, user_id, CAST(floor(ts_s / 3600) AS BIGINT) AS frame, x, y, CASE WHEN user_id % 8 <> 0 THEN user_id % 5 END AS team, embedding AS e FROM fragments JOIN appearance ON vec_id = seq % 500 WHERE seq % 3 <> 0),
nr AS (SELECT DISTINCT frame, user_id + k AS key, frame * 3600.0::DOUBLE AS "at" FROM lo, range(2) r(k)),
nb AS (SELECT q.key, q."at", list({{'t': a.t, 'x': a.x, 'y': a.y}} ORDER BY a.t) AS l, count(*) FILTER (a.t <= q."at") AS c, count(*) AS n FROM (SELECT DISTINCT key, "at" FROM nr) q JOIN an a ON q.key = a.key GROUP BY q.key, q."at"),
pq AS (SELECT key, "at", l[CASE WHEN c = 0 THEN 1 WHEN c = n THEN greatest(1, n - 1) ELSE c END] AS p, l[CASE WHEN c = 0 THEN least(2, n) WHEN c = n THEN n ELSE c + 1 END] AS q FROM nb),
ps AS (SELECT key, "at", CASE WHEN p.t = q.t THEN p.x ELSE p.x + (q.x - p.x) * ("at" - p.t) / (q.t - p.t) END AS x, CASE WHEN p.t = q.t THEN p.y ELSE p.y + (q.y - p.y) * ("at" - p.t) / (q.t - p.t) END AS y FROM pq),
ex AS (SELECT nr.frame, nr.key AS player, nr.key % 5 AS team, ps.x, ps.y, embedding AS e FROM nr JOIN ps ON ps.key = nr.key AND ps."at" = nr."at" JOIN appearance ON vec_id = (nr.key * 11) % 500),
nearby AS (SELECT o.frame, o.obs_id, x.player, sqrt((o.x - x.x) ** 2 + (o.y - x.y) ** 2) AS gone, {COS.format("o.e", "x.e")} AS sim FROM lo o JOIN ex x ON x.frame = o.frame AND (o.team IS NULL OR o.team = x.team)),
scd AS (SELECT frame, obs_id, player, 0.5 * greatest(0, 1 - gone / 300) + 0.5 * (sim + 1) / 2 AS score FROM nearby WHERE gone <= 300 AND sim >= -0.2)"""
ASSIGN = f"""{LOCATION}, kept AS (SELECT frame, obs_id, user_id AS player FROM lo WHERE track_id % 11 = 0),
free AS (SELECT frame, obs_id, player, round(score, 9) AS score, row_number() OVER (PARTITION BY frame ORDER BY round(score, 9) DESC, obs_id, player) AS r FROM scd s WHERE score >= 0.4
    AND obs_id NOT IN (SELECT obs_id FROM kept) AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.frame = s.frame AND k.player = s.player)),
step AS (SELECT DISTINCT frame, 0::BIGINT AS r, CAST([] AS BIGINT[]) AS uo, CAST([] AS BIGINT[]) AS up, NULL::BIGINT AS obs_id, NULL::BIGINT AS player, FALSE AS ok FROM free
    UNION ALL SELECT frame, r, CASE WHEN ok THEN list_append(uo, obs_id) ELSE uo END, CASE WHEN ok THEN list_append(up, player) ELSE up END, obs_id, player, ok FROM
        (SELECT s.frame, f.r, s.uo, s.up, f.obs_id, f.player, NOT list_contains(s.uo, f.obs_id) AND NOT list_contains(s.up, f.player) AS ok FROM step s JOIN free f ON f.frame = s.frame AND f.r = s.r + 1))
SELECT obs_id, player, TRUE AS locked FROM kept UNION ALL SELECT obs_id, player, FALSE FROM step WHERE ok"""

CLAIMS = f"""{FRAG}, {SPANS}, og AS (SELECT min(start_s) AS o, max(end_s) AS e FROM spans),
win AS (SELECT i AS wn, o + i * 43200.0::DOUBLE AS s FROM og, range(0, CAST(floor((e + 1e-6 - o) / 43200) AS BIGINT) + 1) r(i)),
pr AS (SELECT track_id, candidate AS label, avg(prob) AS prob FROM fragments GROUP BY ALL),
cl AS (SELECT wn, team, track_id, label, prob, (end_s - start_s) / 3600 AS duration FROM win JOIN spans ON start_s <= s + 86400 AND end_s >= s JOIN pr USING (track_id))"""

SQL: dict[str, str] = {
    "gap_stitch": f"""{FRAG}, {SPANS}, {_gaps(21600, 250)},
        bys AS (SELECT a, any_value(s.score) AS score, list(b ORDER BY distance, gap, b) AS sinks FROM gaps JOIN spans s ON s.track_id = a GROUP BY a),
        step AS (SELECT 0 AS nr, list({{'s': -score, 'a': a}} ORDER BY -score, a) AS q, CAST([] AS BIGINT[]) AS used, CAST([] AS STRUCT(s DOUBLE, a BIGINT)[]) AS reached, NULL::BIGINT AS source, NULL::BIGINT AS sink, 0 AS done_in FROM bys
            UNION ALL SELECT CASE WHEN len(rest) = 0 THEN nr + 1 ELSE nr END, CASE WHEN len(rest) = 0 THEN list_sort(got) ELSE rest END, CASE WHEN sink IS NULL THEN used ELSE list_append(used, sink) END,
                CASE WHEN len(rest) = 0 THEN [] ELSE got END, source, sink, nr FROM
                (SELECT p.nr, p.q[2:] AS rest, p.used, p.a AS source, p.sink, CASE WHEN k.a IS NULL THEN p.reached ELSE list_append(p.reached, {{'s': -k.score, 'a': k.a}}) END AS got FROM
                    (SELECT s.nr, s.q, s.used, s.reached, h.a, list_filter(h.sinks, lambda x: NOT list_contains(s.used, x))[1] AS sink FROM step s JOIN bys h ON h.a = s.q[1].a WHERE s.nr < 5) p LEFT JOIN bys k ON k.a = p.sink))
        SELECT source, sink, done_in AS round FROM step WHERE sink IS NOT NULL""",
    "greedy_assignment": f"""{CLAIMS}, od AS (SELECT wn, team, track_id, label, round(prob, 9) AS prob, row_number() OVER (PARTITION BY wn, team ORDER BY round(prob, 9) DESC, track_id, label) AS r FROM cl),
        step AS (SELECT DISTINCT wn, team, 0::BIGINT AS r, CAST([] AS BIGINT[]) AS ut, CAST([] AS VARCHAR[]) AS ul, NULL::BIGINT AS track_id, NULL::VARCHAR AS label, 0::DOUBLE AS prob, FALSE AS ok FROM od
            UNION ALL SELECT wn, team, r, CASE WHEN ok THEN list_append(ut, track_id) ELSE ut END, CASE WHEN ok THEN list_append(ul, label) ELSE ul END, track_id, label, prob, ok FROM
                (SELECT s.wn, s.team, o.r, s.ut, s.ul, o.track_id, o.label, o.prob, NOT list_contains(s.ut, o.track_id) AND NOT list_contains(s.ul, o.label) AS ok FROM step s JOIN od o ON o.wn = s.wn AND o.team = s.team AND o.r = s.r + 1))
        SELECT wn AS "window", team, track_id, label, round(prob, 6) AS prob FROM step WHERE ok AND prob >= 0.12""",
    "window_conflicts": f"""{CLAIMS}, n AS (SELECT *, row_number() OVER (PARTITION BY wn, team, track_id ORDER BY prob DESC, label) AS nr FROM cl),
        t AS (SELECT wn, team, track_id, max(prob) * greatest(1, least(4, any_value(duration) + 1)) AS strength, list({{'label': label, 'prob': prob, 'nr': nr}} ORDER BY nr) AS c FROM n GROUP BY ALL),
        od AS (SELECT *, row_number() OVER (PARTITION BY wn, team ORDER BY strength DESC, track_id) AS r FROM t),
        step AS (SELECT DISTINCT wn, team, 0::BIGINT AS r, CAST([] AS VARCHAR[]) AS used, NULL::BIGINT AS track_id, NULL::VARCHAR AS label FROM od
            UNION ALL SELECT wn, team, r, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, track_id, pick FROM
                (SELECT s.wn, s.team, o.r, s.used, o.track_id, list_filter(o.c, lambda x: NOT list_contains(s.used, x.label) AND (x.nr = 1 OR x.prob >= 0.15))[1].label AS pick FROM step s JOIN od o ON o.wn = s.wn AND o.team = s.team AND o.r = s.r + 1))
        SELECT wn AS "window", team, track_id, label FROM step WHERE track_id IS NOT NULL""",
    "conflict_resolution": f"""{OBS}, c AS (SELECT track_id % 25 AS identity, track_id, list(DISTINCT frame_index) AS frames, sum({C}) AS score FROM observations GROUP BY track_id),
        od AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY score DESC, track_id) AS r FROM c),
        step AS (SELECT DISTINCT identity, 0::BIGINT AS r, CAST([] AS BIGINT[]) AS kept, NULL::BIGINT AS track_id, FALSE AS demoted FROM od
            UNION ALL SELECT identity, r, CASE WHEN demoted THEN kept ELSE list_distinct(list_concat(kept, frames)) END, track_id, demoted FROM
                (SELECT s.identity, o.r, s.kept, o.track_id, o.frames, len(list_intersect(o.frames, s.kept)) / len(o.frames) > 0.2 AS demoted FROM step s JOIN od o ON o.identity = s.identity AND o.r = s.r + 1))
        SELECT identity, track_id, demoted FROM step WHERE track_id IS NOT NULL""",
    "fusion_posterior": f"{FUSED} SELECT track_id, player, round(score, 6) AS score, round(posterior, 6) AS posterior FROM fused",
    "resolved_players": f"""{FUSED} SELECT track_id, player, team, round(posterior, 6) AS confidence FROM fused
        QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY round(posterior, 9) DESC, player) = 1""",
    "map_argmax": f"""{OBS}, {TEAMP} SELECT track_id, team, round(prob, 6) AS prob FROM teamp QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY round(prob, 9) DESC, team) = 1""",
    "body_confidence": f"{OBS}, {BODY} SELECT track_id, round(body_confidence, 6) AS body_confidence FROM body",
    "gallery_similarity": f"""{with_views("appearance")}, u AS (SELECT vec_id % 7 AS track_id, greatest(0.01, (vec_id % 10) / 10.0::DOUBLE) AS w, unnest(embedding) AS v, unnest(range(64)) AS place FROM appearance),
        m AS (SELECT track_id, place, sum(v * w) / sum(w) AS v FROM u GROUP BY ALL), t AS (SELECT track_id, list(v ORDER BY place) AS e FROM m GROUP BY track_id),
        g AS (SELECT identity AS player, embedding AS e FROM appearance WHERE identity % 4 <> 3 QUALIFY row_number() OVER (PARTITION BY identity ORDER BY vec_id) = 1)
        SELECT track_id, player, round(({COS.format("t.e", "g.e")} + 1) * 0.5, 6) AS sim FROM t, g""",
    "memory_similarity": f"""{SUM}, {_sims("sims", 7, 2, 3)} SELECT s.track_id, resolved AS player, round(coalesce(sim, 0), 6) AS sim FROM summary s LEFT JOIN sims m ON m.track_id = s.track_id AND m.player = s.resolved WHERE resolved IS NOT NULL""",
    "evidence_refresh": REFRESH,
    "player_of_jersey": f"""{SUM} SELECT s.track_id, p.player FROM summary s LEFT JOIN squad p ON p.jersey = s.jersey
        QUALIFY row_number() OVER (PARTITION BY s.track_id ORDER BY coalesce(p.team = s.team, FALSE) DESC, p.nr) = 1""",
    "first_and_last_match": f"""{with_views("squad")} SELECT team, CAST(nr % 2 AS VARCHAR) AS jersey, arg_min(player, nr) AS "first", arg_max(player, nr) AS "last" FROM squad GROUP BY ALL""",
    "primary_identity": f"""{SUM}, {FIRST} SELECT s.track_id, CASE WHEN confidence >= 0.45 AND o.jersey = s.jersey THEN resolved ELSE f.player END AS identity
        FROM summary s LEFT JOIN squad o ON o.player = s.resolved LEFT JOIN firsts f ON f.team = s.team AND f.jersey = s.jersey""",
    "claim_strength": f"""{SUM}, z AS (SELECT track_id, round(confidence + 0.05 * votes + 0.01 * duration, 9) AS st FROM summary)
        SELECT track_id, CAST(row_number() OVER (ORDER BY st DESC, track_id) AS INT) AS place, round(st, 6) AS strength FROM z""",
    "snapshot_retention": f"""{SUM}, {VISIBLE} SELECT track_id, q.player AS name, q.jersey FROM summary s JOIN squad q ON q.player = s.resolved
        WHERE q.team NOT IN (SELECT team FROM visible) OR EXISTS (SELECT 1 FROM visible v WHERE v.team = q.team AND v.jersey = q.jersey)""",
    "summary_mirror": f"{SUM} SELECT track_id, n, CASE WHEN track_id % 5 <> 4 THEN jersey END AS jersey FROM summary",
    "relabelled_run": f"""{SUM}, {VOTES}, {BEST}, j AS (SELECT s.track_id, coalesce(is_player, FALSE) AND s.votes / 10 >= 0.46 AND duration >= 0.25 AS shown, candidate, score, coalesce(team, '') AS team
            FROM summary s LEFT JOIN bc USING (track_id)),
        l AS (SELECT track_id, CASE WHEN row_number() OVER (PARTITION BY team, candidate ORDER BY score DESC, track_id::VARCHAR DESC) = 1 THEN candidate END AS label FROM j WHERE shown AND candidate IS NOT NULL)
        SELECT j.track_id, label, CASE WHEN shown THEN coalesce(score, 0) END AS score, shown FROM j LEFT JOIN l USING (track_id)""",
    "identity_documents": f"""{FUSED}, nn AS (SELECT track_id, count(*) AS n, sum(posterior) AS total FROM fused GROUP BY track_id),
        bd AS (SELECT track_id, 0.4 * avg(quality) + 0.6 * least(1, count(*) / 20.0) AS bcf FROM observations GROUP BY track_id)
        SELECT s.track_id, q.team, n.n AS n_players, round(total, 6) AS total, round(bcf, 6) AS body_confidence FROM summary s LEFT JOIN squad q ON q.player = s.resolved LEFT JOIN nn n USING (track_id) LEFT JOIN bd USING (track_id)""",
    "visible_numbers": "SELECT label, CAST(row_number() OVER (ORDER BY length(label), label) AS INT) AS place FROM (SELECT DISTINCT CAST(p_partkey % 120 AS VARCHAR) AS label FROM part)",
    "roster_numbers": f"{with_views('squad')} SELECT label, CAST(row_number() OVER (ORDER BY length(label), label) AS INT) AS place FROM (SELECT DISTINCT jersey AS label FROM squad)",
    "eligible_tracks": f"{SUM} SELECT track_id FROM summary WHERE coalesce(CASE WHEN track_id % 3 <> 0 THEN is_player END, TRUE) AND role IS NULL AND track_id % 10 <> 4",
    "cleared_roles": f"{SUM} SELECT track_id, CASE WHEN role IS NULL THEN jersey END AS jersey, CASE WHEN role IS NULL THEN resolved END AS resolved FROM summary",
    "rendered_tracks": f"{SUM} SELECT track_id FROM summary WHERE duration >= 20 AND (role IS NOT NULL OR (is_player AND votes / 10 >= 0.47))",
    "classes_and_categories": f"{with_views('gt_boxes')} SELECT gt_id, '9' AS jersey, 'Player ' || name AS name FROM gt_boxes WHERE gt_id % 2 = 1 AND gt_id % 5 = 4",
    "gated_evidence": f"""{with_views('gt_boxes')}, z AS (SELECT gt_id, CAST(trunc(x2 - x1) AS INT) < 26 OR CAST(trunc(y2 - y1) AS INT) < 20 OR coalesce(CASE WHEN gt_id % 4 <> 0 THEN (gt_id % 10) / 10.0 END < 0.4, FALSE) AS shut FROM gt_boxes)
        SELECT gt_id, CASE WHEN shut THEN 0 ELSE 2 END AS n, CASE WHEN shut THEN 0 ELSE 0.9 END AS quality FROM z""",
    "plausible_boxes": f"""{with_views('gt_boxes')}, k AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, (x2 - x1) / greatest(1, y2 - y1) AS ratio FROM gt_boxes),
        z AS (SELECT gt_id, greatest(0, least(899, x1)) AS x1, greatest(0, least(279, y1)) AS y1, greatest(0, least(899, x2)) AS x2, greatest(0, least(279, y2)) AS y2 FROM k
            WHERE area BETWEEN 1000 AND 0.08 * 900 * 280 AND y2 - y1 >= 18 AND ratio BETWEEN 0.45 AND 0.7 AND y1 >= 2 AND y2 <= 278)
        SELECT gt_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(least(0.96, 0.45 + 0.25 * (gt_id % 100) / 100.0 + least(0.3, greatest(0, x2 - x1) * greatest(0, y2 - y1) / 8000)), 6) AS confidence FROM z""",
    "crop_scores": f"{with_views('gt_boxes')} SELECT gt_id, round(greatest(0, least(1, 0.55 * least(1, (x2 - x1) * (y2 - y1) / 1500) + 0.45 * ((gt_id % 13) / 12.0::DOUBLE))), 6) AS quality FROM gt_boxes",
    "digit_places": """WITH p AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '([^0-9]+|[0-9]+)') AS parts FROM conversations)
        SELECT conv_id, turn, array_to_string(list_transform(list_filter(range(1, len(parts) + 1), lambda i: regexp_matches(parts[i], '^[0-9]')),
            lambda i: CAST(coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0) AS BIGINT) || ':' || parts[i]), ',') AS runs FROM p""",
    "identity_edges": EDGES,
    "switch_segments": SWITCH,
    "team_hues": f"""{with_views('gt_boxes')}, kit AS ({RGB}), mm AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM kit), hs AS (SELECT gt_id, {HSV} AS hue, {_SAT} AS sat FROM mm),
        ds AS (SELECT *, {_far('hue', 20)} AS a, {_far('hue', 110)} AS b, {_far('hue', 150)} AS c FROM hs)
        SELECT gt_id, CASE WHEN sat >= 30 AND least(a, b, c) <= 35 THEN CASE least(a, b, c) WHEN a THEN 'home' WHEN b THEN 'away' ELSE 'third' END END AS team FROM ds""",
    "mean_colors": f"""{OBS}, w AS (SELECT *, greatest(0.05, quality) AS w FROM observations WHERE seq % 4 <> 0)
        SELECT track_id, {", ".join(f"round(sum(w * ((seq * {k}) % 256)) / sum(w), 6) AS {c}" for c, k in zip("rgb", (3, 5, 7)))} FROM w GROUP BY track_id""",
    "special_roles": ROLES,
    "registry_build": REGISTRY,
    "forced_players": f"{SUM}, {FIRST}, {READS} SELECT obs_id, player FROM forced",
    "registry_reassign": f"{REASSIGN} SELECT obs_id, player, forced FROM done",
    "reassigned_tracks": f"""{REASSIGN} SELECT player, CAST(10000 + row_number() OVER (ORDER BY player) AS VARCHAR) AS track_id FROM (SELECT DISTINCT player FROM done)
        UNION ALL SELECT NULL, CAST(track_id AS VARCHAR) FROM (SELECT DISTINCT track_id FROM observations WHERE seq NOT IN (SELECT obs_id FROM done))""",
    "split_parents": f"""{FRAG}, j AS (SELECT *, CASE WHEN sqrt((x - lag(x) OVER o) ** 2 + (y - lag(y) OVER o) ** 2) / greatest(1, ts_s - lag(ts_s) OVER o) > 0.02 THEN 1 ELSE 0 END AS jump FROM fragments WINDOW o AS (PARTITION BY track_id ORDER BY seq)),
        s AS (SELECT *, track_id || '-' || sum(jump) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS child FROM j),
        f AS (SELECT child, ts_s, x, y FROM s QUALIFY row_number() OVER (PARTITION BY child ORDER BY seq) = 1)
        SELECT child, min(track_id) AS parent FROM f LEFT JOIN fragments g ON g.ts_s = f.ts_s AND g.x = f.x AND g.y = f.y GROUP BY child""",
    "location_scores": f"{LOCATION} SELECT frame, obs_id, player, round(score, 6) AS score FROM scd WHERE score >= 0.4",
    "location_assignment": ASSIGN,
    "interval_matches": f"{INTERVALS} SELECT p AS pred_id, t AS true_id, round(iou, 6) AS iou FROM done",
    "interval_f1": f"""{INTERVALS}, k AS (SELECT (SELECT count(*) FROM ip) AS np, (SELECT count(*) FROM it) AS nt, (SELECT count(*) FROM done) AS tp), m AS (SELECT *, tp / greatest(1, np) AS pr, tp / greatest(1, nt) AS re FROM k)
        SELECT tp, np - tp AS fp, nt - tp AS fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / greatest(1e-8, pr + re), 6) AS f1 FROM m""",
    "reader_summary": f"{STACK} {READ_SUMMARY}",
    "reader_confusions": f"{STACK} SELECT truth, found, count(*) AS n FROM jd GROUP BY ALL",
    "reader_tallies": f"{STACK} SELECT truth, count(*) FILTER (ok) AS correct, count(*) AS total FROM jd GROUP BY truth",
    "ensemble_summary": f"{ENSEMBLE} {READ_SUMMARY}",
    "silhouette_matches": f"""{with_views('gt_boxes', 'pred_boxes')}, {PAIRS}, h AS (SELECT DISTINCT gt_id FROM pairs WHERE iou >= 0.1)
        SELECT (SELECT count(*) FROM gt_boxes) AS n, count(*) AS matched, round(100.0 * count(*) / greatest(1, (SELECT count(*) FROM gt_boxes)), 6) AS pct FROM h""",
    "source_detections": _boxes(0.2),
    "greedy_match": _boxes(0.5),
    "display_report": f"{DISPLAY} SELECT * FROM rp",
    "display_scores": f"""{DISPLAY} SELECT count(*) FILTER (expected) AS n_expected, count(*) FILTER (displayed) AS n_displayed, count(*) FILTER (expected AND displayed) AS n_hit,
        round(count(*) FILTER (expected AND displayed) / greatest(1, count(*) FILTER (expected)), 6) AS recall, round(count(*) FILTER (expected AND displayed) / greatest(1, count(*) FILTER (displayed)), 6) AS precision,
        coalesce(string_agg(name, ',' ORDER BY name) FILTER (expected AND displayed), '') AS hit, coalesce(string_agg(name, ',' ORDER BY name) FILTER (expected AND NOT displayed), '') AS missed,
        coalesce(string_agg(name, ',' ORDER BY name) FILTER (displayed AND NOT expected), '') AS extra, sum(CASE WHEN expected THEN fragments ELSE 0 END)::BIGINT AS fragments FROM rp""",
    "best_run": f"{OBS} SELECT candidate AS run, round(avg(prob), 4) AS accuracy FROM observations GROUP BY candidate ORDER BY accuracy DESC, run LIMIT 1",
    "running_mean": f"{OBS} SELECT seq % 5 AS epoch, round(sum(prob * (seq % 32 + 1)) / greatest(1, sum(seq % 32 + 1)), 6) AS loss FROM observations GROUP BY epoch",
    "top_anchors": f"""{OBS}, r AS (SELECT seq AS anchor_id, track_id, candidate, round({C}, 9) AS score FROM observations WHERE seq % 4 <> 0),
        k AS (SELECT * FROM r WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY track_id, candidate ORDER BY score DESC, anchor_id) <= 3) SELECT anchor_id, track_id, candidate FROM k WHERE anchor_id % 9 <> 0""",
    "detection_order": f"{with_views('gt_boxes')} SELECT gt_id, frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY y1, x1, gt_id) AS INT) AS place FROM gt_boxes",
    "detector_passthrough": f"{with_views('gt_boxes')} SELECT name % 8 AS clip, frame, bool_and(frame % 3 <> 0) AS usable FROM gt_boxes GROUP BY ALL",
    "teams_of_files": """SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'Home Team' ELSE CASE substr(n_name, 1, 3) WHEN 'FRA' THEN 'France' WHEN 'JAP' THEN 'Japan' ELSE substr(n_name, 1, 3) END END AS home,
        CASE WHEN n_nationkey % 4 = 0 THEN 'Away Team' ELSE n_regionkey || 'x' END AS away FROM nation""",
    "summary_provenance": f"""{SUM} SELECT track_id, CASE WHEN jersey IS NOT NULL THEN CASE WHEN track_id % 2 = 0 THEN 'label_inherited_from' ELSE 'identity_stitched_from' END END AS field, jersey AS source FROM summary""",
    "memory_vectors": f"""{with_views("appearance")}, v AS (SELECT identity AS player, embedding AS e, row_number() OVER (PARTITION BY identity ORDER BY vec_id) AS i FROM appearance),
        st AS (SELECT player, i, e FROM v WHERE i = 1 UNION ALL SELECT player, i, list_transform(m, lambda x: x / greatest(sqrt(list_dot_product(m, m)), 1e-8)) FROM
            (SELECT v.player, v.i, list_transform(range(1, 65), lambda k: 0.8 * st.e[k] + 0.2 * v.e[k]) AS m FROM st JOIN v ON v.player = st.player AND v.i = st.i + 1)),
        l AS (SELECT player, e FROM st QUALIFY i = max(i) OVER (PARTITION BY player))
        SELECT player, CAST(place AS INT) AS place, round(value, 6) AS value FROM (SELECT player, unnest(e) AS value, unnest(range(64)) AS place FROM l)""",
    "scalar_functions": """WITH p AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS s, CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey % 90 AS VARCHAR) WHEN 1 THEN NULL ELSE CAST(p_partkey AS VARCHAR) END AS num FROM part)
        SELECT p_partkey, round(greatest(0.5, least(1.5, p_partkey / 100.0::DOUBLE)), 6) AS clamped, num AS number, CASE WHEN num IS NULL THEN 'P' || s ELSE '#' || num || ' P' || s END AS display,
            TRUE AS a_in_b, contains(s, '1') AS one_in, ['a', 'b', 'c', 'd', 'e', 'f'][p_partkey % 6 + 1] AS color, CAST(p_partkey * 7919 % 16777216 // 65536 AS INT) AS r,
            CAST(p_partkey * 7919 % 65536 // 256 AS INT) AS g, CAST(p_partkey * 7919 % 256 AS INT) AS b FROM p""",
    "roster_filtered": f"""{OBS}, s AS (SELECT track_id, candidate, sum(prob) AS p FROM observations GROUP BY ALL), n AS (SELECT track_id, candidate, p / sum(p) OVER (PARTITION BY track_id) AS p FROM s),
        k AS (SELECT * FROM n WHERE track_id % 5 <> 0 AND candidate IN ('click', 'view')), c AS (SELECT track_id, candidate, p / sum(p) OVER (PARTITION BY track_id) AS p FROM k),
        m AS (SELECT 'strict' AS mode, * FROM c UNION ALL SELECT 'loose', * FROM c UNION ALL SELECT 'loose', * FROM n WHERE track_id NOT IN (SELECT track_id FROM k))
        SELECT track_id, mode, candidate, round(p, 9) AS prob FROM m""",
    "vector_cosines": f"""{with_views("appearance")}, j AS (SELECT a.vec_id, CASE WHEN a.vec_id % 7 = 0 THEN list_transform(a.embedding, lambda x: x * 0) WHEN a.vec_id % 11 = 0 THEN a.embedding[1:8] ELSE a.embedding END AS e, b.embedding AS o
            FROM appearance a JOIN appearance b ON b.vec_id = a.vec_id + 1)
        SELECT vec_id, CASE WHEN len(e) = len(o) AND vec_id % 7 <> 0 THEN round({COS.format("e", "o")}, 6) ELSE 0 END AS cosine, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE 1 END AS length FROM j""",
}
