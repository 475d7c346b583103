"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from tracklake.llm.quality_rules import COMMON_WORDS

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
bl AS (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(len(ws) - least(10, len(ws)) + 1)) AS i FROM bw WHERE len(ws) > 0),
bg AS (SELECT DISTINCT item, n, array_to_string(ws[i + 1:i + n], ' ') AS gram FROM bl),
dl AS (SELECT doc_id, ws, n, unnest(range(greatest(0, len(ws) - n + 1))) AS i FROM dw, (SELECT DISTINCT n FROM bg)),
hits AS (SELECT DISTINCT doc_id, i, d.n, item FROM (SELECT doc_id, i, n, array_to_string(ws[i + 1:i + n], ' ') AS gram FROM dl) d JOIN bg ON bg.n = d.n AND bg.gram = d.gram),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
    sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_kept = lambda keep: f"length(regexp_replace(t, '[^{keep}]', '', 'g'))"
_K = len(COMMON_WORDS)
_counts = ", ".join(f"len(list_filter(ws, lambda w: w = '{w}' OR w = '{w.capitalize()}'))" for w in COMMON_WORDS)
_sums = lambda col, n: "[" + ", ".join(f"sum({col}[{i}])" for i in range(1, n + 1)) + "]"


def _distance(p: str, q: str, n: int) -> str:
    share = lambda a, i: f"({a}[{i}]::DOUBLE / list_sum({a}))"
    part = lambda a, b, i: f"CASE WHEN {a}[{i}] > 0 THEN {share(a, i)} * log2({share(a, i)} / (({share(a, i)} + {share(b, i)}) / 2)) ELSE 0 END"
    total = " + ".join(part(p, q, i) + " + " + part(q, p, i) for i in range(1, n + 1))
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, ({total}) / 2)) ELSE 0 END"


QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
w AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 5], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(greatest(0, len(ws) - 4))) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM
    (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM w) WHERE c > 1) GROUP BY doc_id),
s AS (SELECT doc_id, lang, len(ws) AS n_words, length(t) - {_kept(r"\x20\x09-\x0D")} AS word_chars, {_kept(r"#*$%&|<>")} AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    [{_kept(r"\p{Lu}")}, {_kept("0-9")}, {_kept(r"\x20\x09-\x0D")}, {_kept(".,;:!?''()" + chr(34))}, {_kept(r"#*$%&|<>")}] AS c5, length(t) AS n_chars, [{_counts}] AS k
    FROM l LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, list_append(c5, n_chars - list_sum(c5)) AS cls,
    list_append(k, greatest(0, n_words - list_sum(k))) AS com FROM s),
ref AS (SELECT lang AS rl, {_sums("cls", 6)} AS rc, {_sums("com", _K + 1)} AS rk FROM f WHERE NOT base_failed GROUP BY lang),
sil AS (SELECT *, {_distance("none", "rk", _K + 1)} AS sl FROM (SELECT *, list_append(list_transform(range({_K}), lambda i: 0), 1) AS none FROM ref)),
j AS (SELECT f.*, coalesce({_distance("cls", "rc", 6)}, 0) AS cd, coalesce({_distance("com", "rk", _K + 1)}, 0) AS wd, coalesce(sl, 0) AS sl FROM f LEFT JOIN sil ON rl IS NOT DISTINCT FROM lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (n_words >= 50 AND cd > 0.3) AND NOT (n_words >= 120 AND sl >= 0.15 AND wd > 0.8 * sl) AS kept,
    round(cd, 6) AS class_distance, round(wd, 6) AS word_distance, round(sl, 6) AS silence FROM j
"""


def _crc32(number: str) -> str:
    """CRC-32 of a number's decimal text (of the empty text for null): eight steps for every byte."""
    chars = f"list_filter(string_split(coalesce(CAST({number} AS VARCHAR), ''), ''), lambda c: c <> '')"
    items = f"flatten(list_transform({chars}, lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(a, c) >> 1, CASE WHEN xor(a, c) & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {items}), lambda a, c: {step}), 4294967295)"


_batch = lambda id_col: f"least(7, greatest(0, coalesce(floor((floor((epoch_us(arrived_at) - 1704067200000000) / 3600000000) + 80 * ({_crc32(id_col)} % 4)) * 8 / 3648), 0)))::INT"

#: A click opens an obligation unless the client's event before it is a click of at most 24 hours ago.
FOLLOWUPS = f"""
WITH e AS (SELECT {_batch("click_id")} AS b, client_id, epoch_us(ts) AS t, 0 AS sale
    FROM (SELECT DISTINCT * FROM clicks WHERE kind = 'error' AND client_id IS NOT NULL AND ts IS NOT NULL)
    UNION ALL SELECT {_batch("sale_id")}, client_id, epoch_us(sold_at), 1 FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
w AS (SELECT b, (SELECT max(t) FROM e WHERE e.b < x.b) - 345600000000 AS w FROM (SELECT unnest(range(8)) AS b) x),
m AS (SELECT e.*, coalesce(t < w, false) AS late FROM e JOIN w USING (b)),
s AS (SELECT *, lag(t) OVER o AS lt, lag(sale) OVER o AS ls, lead(t) OVER o AS nt, lead(sale) OVER o AS ns
    FROM (SELECT client_id, t, sale, count(*) AS n FROM m WHERE NOT late GROUP BY ALL) WINDOW o AS (PARTITION BY client_id ORDER BY t, sale)),
g AS (SELECT *, sum(CASE WHEN ls = 0 AND t - lt <= 86400000000 THEN 0 ELSE 1 END) OVER (PARTITION BY client_id ORDER BY t, sale) AS g FROM s WHERE sale = 0),
ob AS (SELECT client_id, min(t) AS opened, max(t) + 86400000000 AS due, sum(n) AS n, arg_max(nt, t) AS nt, arg_max(ns, t) AS ns FROM g GROUP BY client_id, g)
SELECT coalesce((SELECT min(b) FROM w WHERE w > due), 8)::INT AS batch, client_id, opened AS opened_us, due AS due_us, n::BIGINT AS n_rows
    FROM ob WHERE NOT coalesce(ns = 1 AND nt <= due, false)
UNION ALL SELECT b, client_id, -1, -1, count(*) FROM m WHERE late GROUP BY b, client_id
"""

_field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
_leaf = lambda text: "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, leaves: str) -> str:
    """Tables of a tree's levels (tree, level, pos, digest, more) from (tree, pos, digest); more: whether the level has more than one node."""
    return f"""{name} AS (SELECT tree, 0 AS level, pos, digest, count(*) OVER (PARTITION BY tree) > 1 AS more FROM {leaves}
    UNION ALL SELECT *, count(*) OVER (PARTITION BY tree) > 1 FROM (SELECT tree, any_value(level) + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE more GROUP BY tree, pos // 16))"""


#: A row's siblings of all levels, and the root folded with them: a run's digest is made again for the row's own child.
MANIFEST = f"""
WITH RECURSIVE l AS (SELECT doc_id, source AS tree, {_leaf("text")} AS digest, CASE WHEN {_crc32("doc_id")} % 5 = 0 AND doc_id IS NOT NULL
        THEN {_leaf(f"translate(text, '{_UP}', '{_LOW}')")} ELSE {_leaf("text")} END AS altered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos FROM l),
{_tree("lv", "p")},
sr AS (SELECT tree AS source, digest, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos FROM lv WHERE NOT more),
st AS (SELECT 0 AS tree, pos, digest FROM sr),
{_tree("sv", "st")},
steps AS (SELECT p.doc_id, p.tree, p.pos AS own, lv.level, (p.pos // CAST(16 ** lv.level AS BIGINT)) AS at FROM p JOIN (SELECT DISTINCT tree, level, more FROM lv) lv ON p.tree IS NOT DISTINCT FROM lv.tree AND more
    UNION ALL SELECT p.doc_id, p.tree, p.pos, 100 + sv.level, sr.pos // CAST(16 ** sv.level AS BIGINT) FROM p JOIN sr ON p.tree IS NOT DISTINCT FROM sr.source JOIN (SELECT DISTINCT level, more FROM sv) sv ON more),
nodes AS (SELECT tree, level, pos, digest, false AS top FROM lv UNION ALL SELECT NULL, 100 + level, pos, digest, true FROM sv),
sib AS (SELECT s.tree, s.own, s.level, string_agg(CASE WHEN n.pos < s.at THEN n.digest END, '' ORDER BY n.pos) AS a, string_agg(CASE WHEN n.pos > s.at THEN n.digest END, '' ORDER BY n.pos) AS b
    FROM steps s JOIN nodes n ON n.level = s.level AND n.pos // 16 = s.at // 16 AND (n.top OR n.tree IS NOT DISTINCT FROM s.tree) AND n.top = (s.level >= 100) GROUP BY ALL),
path AS (SELECT tree, own, list(struct_pack(a := coalesce(a, ''), b := coalesce(b, '')) ORDER BY level) AS path FROM sib GROUP BY ALL),
f AS (SELECT p.*, coalesce(path, []) AS path FROM p LEFT JOIN path ON p.tree IS NOT DISTINCT FROM path.tree AND p.pos = path.own),
g AS (SELECT doc_id, tree, digest AS leaf, path, list_reduce(list_prepend(struct_pack(a := altered, b := ''), path), lambda x, y: struct_pack(a := sha256(y.a || x.a || y.b), b := '')).a AS folded_root FROM f)
SELECT doc_id, leaf, sr.digest AS subroot, (SELECT digest FROM sv WHERE NOT more) AS root,
    sha256(coalesce(array_to_string(list_transform(path, lambda x: x.a || x.b), ''), '')) AS proof_sha256, folded_root, folded_root = (SELECT digest FROM sv WHERE NOT more) AS verified
FROM g JOIN sr ON g.tree IS NOT DISTINCT FROM sr.source
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(greatest(1, len(ws) - 3)), lambda i: array_to_string(ws[i + 1:i + 4], ' '))) END AS gs FROM w),
e AS (SELECT r, len(gs) AS n, unnest(gs) AS g FROM s),
l AS (SELECT x.r AS a, y.r AS b FROM e x JOIN e y ON x.g = y.g AND x.r <> y.r GROUP BY x.r, y.r, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
c AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT s.doc_id, len(s.gs)::BIGINT AS n_shingles, least(s.doc_id, min(o.doc_id)) AS component_id
FROM s LEFT JOIN c ON s.r = c.a LEFT JOIN s o ON c.b = o.r GROUP BY s.r, s.doc_id, s.gs
"""

SQL = {"op6_decontamination": DECONTAMINATION, "op10_quality_rules": QUALITY_RULES, "op11_jaccard_join": JACCARD_JOIN, "op12_followups": FOLLOWUPS, "op13_manifest": MANIFEST}
