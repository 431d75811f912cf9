"""The catalogue as SQL over the driver's star schema, written apart from the DataFrame
operators: sequence numbers and gaps by plain windows, modes by ranking."""

from __future__ import annotations

from playlog.plans.catalogue import STAR_CONFIG

_C = STAR_CONFIG.clamped()
_MIN = 60_000_000


def _round(v: str, n: int) -> str:
    """Half to even on the exact binary value of a non-negative double."""
    k = f"{10**n}.0::DOUBLE"
    parts = f"{{'p': v * {k}, 'e': ((v * 134217729.0::DOUBLE - (v * 134217729.0::DOUBLE - v)) * {k} - v * {k}) + (v - (v * 134217729.0::DOUBLE - (v * 134217729.0::DOUBLE - v))) * {k}}}"
    up = "CASE WHEN x.p - floor(x.p) > 0.5 OR (x.p - floor(x.p) = 0.5 AND (x.e > 0 OR (x.e = 0 AND floor(x.p) % 2 = 1))) THEN 1 ELSE 0 END"
    return f"list_transform(list_transform([({v})::DOUBLE], lambda v: {parts}), lambda x: (floor(x.p) + {up}) / {k})[1]"


def _share(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE {_round(f'100.0::DOUBLE * {a} / {b}', 1)} END"


def _mean(v: str) -> str:
    """The exact mean of a group's doubles, correctly rounded."""
    add = "{'h': z.h + x.h, 'l': z.l + (z.h - ((z.h + x.h) - ((z.h + x.h) - z.h))) + (x.h - ((z.h + x.h) - z.h))}"
    total = f"list_reduce(list_transform(list({v}), lambda x: {{'h': x::DOUBLE, 'l': 0::DOUBLE}}), lambda z, x: {add})"
    high = f"list_transform([{total}], lambda a: {{'h': a.h + a.l, 'l': a.l - ((a.h + a.l) - a.h), 'q': (a.h + a.l) / count({v})}})"
    # counts are small whole numbers, so their halves of the product are exact
    s = "(a.q * 134217729.0::DOUBLE)"
    hi = f"({s} - ({s} - a.q))"
    return f"list_transform(list_transform({high}, lambda a: {{'h': a.h, 'l': a.l, 'q': a.q, 'hi': {hi}}}), lambda a: a.q + (((a.h - a.q * count({v})) - ((a.hi * count({v}) - a.q * count({v})) + (a.q - a.hi) * count({v}))) + a.l) / count({v}))[1]"


def _iso(tm: str) -> str:
    return f"strftime({tm}, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us({tm}) % 1000000 = 0 THEN '' ELSE '.' || lpad((epoch_us({tm}) % 1000000)::VARCHAR, 6, '0') END || '+00:00'"


def _span(a: str, b: str, seconds: int) -> str:
    return f"(epoch_us({b}) - epoch_us({a})) / 1000000.0::DOUBLE / {seconds}.0::DOUBLE"


_GENRES = "list_filter(list_distinct(list_transform(regexp_split_to_array(lower({0}), '[;,/|]+'), lambda g: trim(g))), lambda g: length(g) > 1)"

_BASE = f"""
parts AS (
  SELECT p_partkey AS k, p_partkey::VARCHAR AS id, p_name AS title, p_brand AS artist, floor(sqrt(p_partkey))::INT AS a,
         p_type || '; ' || split_part(p_name, ' ', 2) AS genre, 1950 + p_size AS year, p_retailprice AS duration
  FROM part),
tracks AS (
  SELECT *, 'Álbum ' || (a % 5) AS album, a::VARCHAR AS album_key, CASE WHEN a < 5 THEN 'Artist X' ELSE 'artist-x' END AS owner,
         (k - a * a + 1)::INT AS position, (count(*) OVER (PARTITION BY a))::INT AS total, (k - a * a + 1 + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END)::INT AS named,
         lower(CASE WHEN a < 5 THEN 'Artist X' ELSE 'artist-x' END) AS owner_key, min(1950 + 0 + year - 1950) OVER (PARTITION BY a) AS cat_year
  FROM parts),
users AS (SELECT i::VARCHAR AS user_id, 'user-' || (i % 3) AS user_name FROM range(4) r(i)),
log AS (
  SELECT row_number() OVER w AS g, ts AS tm, (user_id % 4)::VARCHAR AS user_id, 'user-' || (user_id % 4 % 3) AS user_name, t.id AS track_id, t.* EXCLUDE (id),
         lag(ts) OVER w AS b_at, lag((user_id % 4)::VARCHAR) OVER w AS b_user, lag(t.id) OVER w AS b_track, lag(album_key) OVER w AS b_album,
         lag(position) OVER w AS b_pos, lag(artist) OVER w AS b_artist, lag(title) OVER w AS b_title, lag(genre) OVER w AS b_genre, lag(year) OVER w AS b_year
  FROM events JOIN tracks t ON t.id = regexp_extract(props, '"k": ([0-9]+)', 1)
  WINDOW w AS (ORDER BY ts, event_id)),
notes AS (
  SELECT (o_custkey % 4)::VARCHAR AS user_id, l_partkey::VARCHAR AS track_id, count(*) AS play_count, max(o_orderdate) AS last_played
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def _mode(rows: str, by: str, value: str, out: str) -> str:
    return f"SELECT {by}, {value} AS {out} FROM (SELECT {by}, {value}, row_number() OVER (PARTITION BY {by} ORDER BY count(*) DESC, min(g), {value}) AS r FROM {rows} GROUP BY {by}, {value}) WHERE r = 1"


def _sessions(flags: str, name: str) -> str:
    return f"""
flagged AS ({flags}),
told AS (SELECT *, {name} AS sid FROM flagged),
facts AS (SELECT sid, min_by(user_name, g) AS user, min(tm) AS s, max(tm) AS e, count(*) AS tracks, count(DISTINCT track_id) AS unique_tracks, sum(greatest(duration, 0)::DECIMAL(20,6))::DOUBLE AS secs FROM told GROUP BY sid),
ta AS ({_mode("told", "sid", "artist", "top_artist")}),
tb AS ({_mode("told", "sid", "album", "top_album")}),
tg AS ({_mode("(SELECT sid, g, unnest(" + _GENRES.format("genre") + ") AS genre FROM told)", "sid", "genre", "top_genre")})
SELECT sid AS session_id, user, {_iso("s")} AS start, {_iso("e")} AS "end", {_round(_span("s", "e", 60), 1)} AS span_minutes, tracks, unique_tracks,
       {_round("secs / 60.0::DOUBLE", 1)} AS estimated_music_minutes, top_artist, top_album, coalesce(top_genre, '') AS top_genre
FROM facts LEFT JOIN ta USING (sid) LEFT JOIN tb USING (sid) LEFT JOIN tg USING (sid)"""


_GAP = "epoch_us(tm) - epoch_us(b_at)"
_ADJ = f"b_user = user_id AND {_GAP} <= {_C.pair_window * _MIN} AND b_track <> track_id"


def _dominance(level: str) -> str:
    key, album = ("album_key", "max_by(album, g)") if level == "album" else ("owner_key", "''")
    return f"""
wk AS (SELECT user_name AS user, isoyear(tm) AS year, week(tm) AS week, date_trunc('week', tm)::DATE AS monday, {key} AS entity_key, owner, album, g FROM log),
best AS ({_mode("wk", "user, year, week", "entity_key", "entity_key")}),
n AS (SELECT user, year, week, entity_key, count(*) AS plays FROM wk GROUP BY ALL),
tot AS (SELECT user, year, week, count(*) AS week_total, min(monday) AS monday FROM wk GROUP BY ALL),
lab AS (SELECT entity_key, max_by(owner, g) AS artist, {album} AS album FROM wk GROUP BY 1),
dom AS (SELECT user, year, week, strftime(monday, '%Y-%m-%d') AS week_start, monday, plays, week_total, {_share("plays", "week_total")} AS share_pct, artist, album, entity_key
        FROM best JOIN n USING (user, year, week, entity_key) JOIN tot USING (user, year, week) JOIN lab USING (entity_key))"""


def _eras(level: str) -> str:
    return f"""{_dominance(level)},
fl AS (SELECT *, CASE WHEN entity_key = lag(entity_key) OVER w AND monday - lag(monday) OVER w = 7 THEN 0 ELSE 1 END AS new FROM dom WINDOW w AS (PARTITION BY user ORDER BY week_start)),
er AS (SELECT *, sum(new) OVER (PARTITION BY user ORDER BY week_start) AS era FROM fl)
SELECT user, '{level}' AS level, min_by(year || '-W' || lpad(week::VARCHAR, 2, '0'), week_start) AS start_week, max_by(year || '-W' || lpad(week::VARCHAR, 2, '0'), week_start) AS end_week,
       count(*) AS weeks, min_by(artist, week_start) AS artist, min_by(album, week_start) AS album, sum(plays)::BIGINT AS dominant_plays, sum(week_total)::BIGINT AS period_total, {_round(_mean("share_pct"), 1)} AS avg_share_pct
FROM er GROUP BY user, era"""


def _historical(level: str) -> str:
    key, names = ("album_key", "min_by(owner, track_id) AS artist, min_by(album, track_id) AS album, album_key,") if level == "album" else ("owner_key", "min_by(owner, track_id) AS artist,")
    shown = "artist, album, album_key" if level == "album" else "artist"
    return f"""
rec AS (SELECT user_id, track_id, count(*) AS n FROM log GROUP BY 1, 2),
bo AS (SELECT user_id, track_id, coalesce(play_count, 0) AS t, coalesce(n, 0) AS n FROM notes FULL JOIN rec USING (user_id, track_id)),
su AS (SELECT user_id, {names} sum(t)::BIGINT AS historical_total, sum(n)::BIGINT AS recent_scrobbles, sum(greatest(0, t - n))::BIGINT AS estimated_before_history, sum(CASE WHEN n > t AND t > 0 THEN 1 ELSE 0 END)::BIGINT AS mismatch_tracks
       FROM bo JOIN tracks ON id = track_id GROUP BY user_id, {key})
SELECT user_name AS user, {shown}, historical_total, recent_scrobbles, estimated_before_history,
       CASE WHEN historical_total <> 0 THEN {_share("recent_scrobbles", "historical_total")} END AS recent_share_pct, mismatch_tracks,
       CASE WHEN estimated_before_history >= greatest(10, 2 * recent_scrobbles) THEN 'histórica' WHEN recent_scrobbles >= greatest(10, 2 * estimated_before_history) THEN 'reciente'
            WHEN estimated_before_history >= 10 AND recent_scrobbles >= 10 THEN 'persistente' ELSE 'mixta' END AS profile
FROM su JOIN users USING (user_id)"""


_RUNS = f"""
rf AS (SELECT *, CASE WHEN user_id = b_user AND album_key = b_album AND {_GAP} <= {_C.session_gap * _MIN} AND NOT (position <= 2 AND b_pos >= greatest(3, ceil(total * 0.60::DOUBLE))) THEN 0 ELSE 1 END AS new FROM log),
rn AS (SELECT *, sum(new) OVER (ORDER BY g) AS run_id FROM rf),
ff AS (SELECT run_id, track_id, min(g) AS g1, min(position) AS position FROM rn GROUP BY 1, 2),
fs AS (SELECT *, lag(position) OVER (PARTITION BY run_id ORDER BY g1) AS pp FROM ff),
st AS (SELECT run_id, count(*) AS u, count(pp) AS steps, count(*) FILTER (position = pp + 1) AS nx, count(*) FILTER (position > pp) AS fw, min_by(position, g1) AS fp, max_by(position, g1) AS lp FROM fs GROUP BY 1),
rb AS (SELECT run_id, min_by(user_name, g) AS user, min(tm) AS s, max(tm) AS e, min(album_key) AS album_key, min(owner) AS artist, min(album) AS album, min(cat_year) AS release_year, min(total) AS total, count(*) AS scrobbles, max_by(title, g) AS stop_track FROM rn GROUP BY 1),
rc AS (SELECT *, u / total AS comp, CASE WHEN steps = 0 THEN 1.0::DOUBLE ELSE nx / steps END AS sq, CASE WHEN steps = 0 THEN 1.0::DOUBLE ELSE fw / steps END AS fr FROM rb JOIN st USING (run_id)),
rd AS (SELECT *, fp <= 2 AS b0, lp >= greatest(1, total - 1) AS e0, comp >= {_C.album_complete}::DOUBLE AS c0, u >= least(3, total) OR comp >= 0.5::DOUBLE AS m0, sq >= 0.6::DOUBLE OR (u <= 2 AND fr >= 0.5::DOUBLE) AS o0 FROM rc),
runs AS (SELECT run_id::BIGINT AS run_id, user, {_iso("s")} AS start, {_iso("e")} AS "end", {_round(_span("s", "e", 60), 1)} AS span_minutes, album_key, album_key AS album_id, artist, album, release_year, total AS library_tracks, scrobbles, u AS unique_tracks,
  {_round("100.0::DOUBLE * comp", 1)} AS completion_pct, {_round("100.0::DOUBLE * sq", 1)} AS sequential_pct, {_round("100.0::DOUBLE * fr", 1)} AS forward_pct, fp AS first_position, lp AS last_position,
  b0::INT AS starts_at_beginning, e0::INT AS reaches_end, c0::INT AS complete_like, (c0 AND b0 AND e0 AND o0)::INT AS full_pass, m0::INT AS meaningful,
  CASE WHEN c0 AND b0 AND e0 AND o0 THEN 'completo_probable' WHEN c0 THEN 'casi_completo' WHEN m0 AND b0 THEN 'parcial_desde_inicio' WHEN m0 THEN 'parcial' ELSE 'pista_suelta' END AS status,
  CASE WHEN u <= 2 THEN 'indeterminado' WHEN sq >= 0.65::DOUBLE THEN 'orden' WHEN fr < 0.5::DOUBLE THEN 'shuffle_o_manual' ELSE 'mixto' END AS listening_mode, stop_track, s, e FROM rd)"""

_RISING = "coalesce(len(list_reduce(list_transform({0}, lambda x: [x]), lambda t, x: list_concat(list_concat(list_filter(t, lambda y: y < x[1]), x), list_filter(t, lambda y: y >= x[1])[2:]))), 0)"
_SLACK, _HOURS = _C.resume_slack, int(_C.thread_hours * 3600 * 1_000_000)
_THREADS = f"""
t1 AS (SELECT *, lag(tm) OVER w AS p_at, lag(position) OVER w AS p_pos, lag(g) OVER w AS p_g, lag(title) OVER w AS p_title FROM log WINDOW w AS (PARTITION BY user_id, album_key ORDER BY g)),
t2 AS (SELECT *, CASE WHEN epoch_us(tm) - epoch_us(p_at) <= {_HOURS} AND NOT (position <= 2 AND p_pos >= greatest(3, ceil(total * 0.55::DOUBLE))) AND NOT (position < p_pos - {max(1, _SLACK)})
   AND ((position >= p_pos AND position <= p_pos + 1 + {_SLACK}) OR (g = p_g + 1 AND epoch_us(tm) - epoch_us(p_at) <= {_C.session_gap * _MIN}) OR position = p_pos) THEN 0 ELSE 1 END AS new FROM t1),
t3 AS (SELECT *, sum(new) OVER (PARTITION BY user_id, album_key ORDER BY g) AS chunk, min(g) OVER (PARTITION BY user_id, album_key) AS grp FROM t2),
t4 AS (SELECT user_id, album_key, chunk, row_number() OVER (ORDER BY tm, grp, chunk) AS thread_id FROM t3 WHERE new = 1),
t5 AS (SELECT t3.*, thread_id, CASE WHEN new = 0 THEN epoch_us(tm) - epoch_us(p_at) END AS pause, epoch_us(tm) - epoch_us(min(tm) OVER (PARTITION BY thread_id)) AS since, CASE WHEN named <> position THEN 1 ELSE 0 END AS bad FROM t3 JOIN t4 USING (user_id, album_key, chunk)),
t6 AS (SELECT thread_id, min(user_name) AS user, min(tm) AS s, max(tm) AS e, min(album_key) AS album_key, min(owner) AS artist, min(album) AS album, min(cat_year) AS release_year, min(total) AS total, count(*) AS scrobbles, count(DISTINCT position) AS u,
   count(DISTINCT position) FILTER (since <= 86400000000) AS u24, count(DISTINCT position) FILTER (since <= 172800000000) AS u48,
   list(position ORDER BY g) AS pa, list(position ORDER BY g) FILTER (since <= 86400000000) AS p24, list(position ORDER BY g) FILTER (since <= 172800000000) AS p48,
   min_by(position, g) AS fp, max_by(position, g) AS lp, count(*) FILTER (pause > {_C.session_gap * _MIN}) AS resume_count, coalesce(max(pause), 0) AS longest, max(bad) AS bad FROM t5 GROUP BY 1),
t7 AS (SELECT *, {_RISING.format("pa")} AS l, {_RISING.format("p24")} AS l24, {_RISING.format("p48")} AS l48 FROM t6),
t8 AS (SELECT *, fp <= 2 AS b0, lp >= greatest(1, total - 1) AS e0, u / total >= {_C.album_complete}::DOUBLE AS c0, l / total >= greatest(0.5::DOUBLE, {_C.album_complete}::DOUBLE - 0.2::DOUBLE) AS o0, u >= least(3, total) OR u / total >= 0.5::DOUBLE AS m0 FROM t7),
threads AS (SELECT thread_id, user, {_iso("s")} AS start, {_iso("e")} AS "end", {_round(_span("s", "e", 3600), 2)} AS span_hours, album_key, album_key AS album_id, artist, album, release_year, total AS library_tracks, scrobbles, u AS unique_tracks,
  {_round("100.0::DOUBLE * (u / total)", 1)} AS coverage_pct, {_round("100.0::DOUBLE * (l / total)", 1)} AS ordered_coverage_pct, {_round("100.0::DOUBLE * (u24 / total)", 1)} AS coverage_24h_pct, {_round("100.0::DOUBLE * (l24 / total)", 1)} AS ordered_coverage_24h_pct,
  {_round("100.0::DOUBLE * (u48 / total)", 1)} AS coverage_48h_pct, {_round("100.0::DOUBLE * (l48 / total)", 1)} AS ordered_coverage_48h_pct, fp AS first_position, lp AS last_position, b0::INT AS starts_at_beginning, e0::INT AS reaches_end, resume_count,
  {_round("longest / 1000000.0::DOUBLE / 3600.0::DOUBLE", 2)} AS max_pause_hours, c0::INT AS complete_like, (c0 AND b0 AND e0 AND o0)::INT AS full_thread, m0::INT AS meaningful,
  CASE WHEN c0 AND b0 AND e0 AND o0 THEN 'completo_logico' WHEN c0 AND o0 THEN 'casi_completo_logico' WHEN m0 AND b0 THEN 'parcial_desde_inicio' WHEN m0 THEN 'parcial' ELSE 'pista_suelta' END AS status,
  CASE WHEN bad = 1 THEN 'media' ELSE 'alta' END AS metadata_confidence, s, e FROM t8)"""


def _returns(rows: str, left: str, number: str, pct: str) -> str:
    return f"""SELECT user, {_round("d", 1)} AS silent_days, {_iso("b")} AS before, start AS "return", artist, album, bp AS before_{pct}, {pct} AS return_{pct}, album_key
FROM (SELECT *, {_span("b", "s", 86400)} AS d FROM (SELECT *, lag({left}) OVER w AS b, lag({pct}) OVER w AS bp FROM {rows} WHERE meaningful = 1 WINDOW w AS (PARTITION BY user, album_key ORDER BY s, {number}))) WHERE d >= {_C.resurrection_days}"""


def _title_key(text: str) -> str:
    """A title's letters and digits in words, without extension, leading number, disc and release words."""
    steps = ((r"\.[a-z0-9]{2,5}$", ""), (r"^\s*\d{1,3}(?:\s*[-._)\]]+\s*|\s+)", ""), (r"\b(?:disc|cd)\s*\d+\b", " "), (r"\b(?:official|audio|video|remaster(?:ed)?|version)\b", " "), (r"[^a-z0-9]+", " "))
    out = f"lower(strip_accents(trim({text})))"
    for pattern, by in steps:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"trim({out})"


def similarity(rows: str) -> str:
    """Common table expressions up to `alike` (id, ratio): Ratcliff-Obershelp similarity of `a` and
    `b` of each row of `rows`.  The longest common stretch, the first in `a` and then in `b`,
    parts both texts in two, whose halves are compared in turn; `l` has for each place in `a` the
    length of the longest stretch from there that stands in `b`.  For texts below 200 characters."""
    lengths = "list_transform(range(1, length(a) + 1), lambda i: len(list_filter(range(1, length(a) - i + 2), lambda n: contains(b, substr(a, i, n)))))"
    return f"""
pieces AS (
  SELECT id, a, b, {lengths} AS l FROM {rows}
  UNION ALL
  SELECT id, a, b, {lengths} AS l FROM (
    SELECT id, unnest([substr(a, 1, i - 1), substr(a, i + n)]) AS a, unnest([substr(b, 1, j - 1), substr(b, j + n)]) AS b FROM (
      SELECT *, strpos(b, substr(a, i, n)) AS j FROM (SELECT id, a, b, list_max(l) AS n, list_position(l, list_max(l)) AS i FROM pieces WHERE list_max(l) > 0)))
  WHERE a <> '' AND b <> ''),
alike AS (SELECT p.id, 2.0::DOUBLE * sum(coalesce(list_max(p.l), 0)) / any_value(length(r.a) + length(r.b)) AS ratio FROM pieces p JOIN {rows} r ON r.id = p.id GROUP BY p.id)"""


_LEGACY = """
leg AS (SELECT user_name AS "user", play_count, strftime(last_played, '%Y-%m-%d %H:%M:%S') AS last_played, track_id, artist, album, title, genre, year AS release_year
        FROM notes JOIN tracks ON id = track_id JOIN users USING (user_id))"""
_TRANSITION = (_C.transition_window or _C.session_gap) * _MIN

_BODIES = {
    "sessions": "," + _sessions(f"SELECT *, sum(new) OVER (ORDER BY g) AS n FROM (SELECT *, CASE WHEN b_user = user_id AND {_GAP} <= {_C.session_gap * _MIN} THEN 0 ELSE 1 END AS new FROM log)", "n::BIGINT"),
    "sessions_by_user": "," + _sessions(
        f"SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY g) AS n FROM (SELECT *, CASE WHEN epoch_us(tm) - epoch_us(lag(tm) OVER (PARTITION BY user_id ORDER BY g)) <= {_C.session_gap * _MIN} THEN 0 ELSE 1 END AS new FROM log)", "user_id || ':' || n::BIGINT"
    ),
    "weekly_obsessions": f"""
SELECT year, week, user, plays, week_total, {_share("plays", "week_total")} AS share, artist, title, album, track_id, _first
FROM (SELECT *, sum(plays) OVER (PARTITION BY year, week, user)::BIGINT AS week_total FROM (
  SELECT isoyear(tm) AS year, week(tm) AS week, user_name AS user, track_id, artist, title, album, count(*) AS plays, min(g) AS _first FROM log GROUP BY ALL))
WHERE plays >= 3 OR (plays >= 2 AND week_total <= 12)""",
    "resurrections": f"""
SELECT user_name AS user, {_round("d", 1)} AS silent_days, {_iso("b")} AS before, {_iso("tm")} AS "return", artist, title, album, track_id, g AS _first
FROM (SELECT *, {_span("b", "tm", 86400)} AS d FROM (SELECT *, lag(tm) OVER (PARTITION BY user_id, track_id ORDER BY g) AS b FROM log)) WHERE d >= {_C.resurrection_days}""",
    "track_pairs": f"""
SELECT min(user_name) AS user, count(*) AS times, min(b_artist) AS from_artist, min(b_title) AS from_title, min(artist) AS to_artist, min(title) AS to_title, b_track AS from_track_id, track_id AS to_track_id, min(g) AS _first
FROM log WHERE {_ADJ} GROUP BY user_id, b_track, track_id HAVING count(*) >= 2""",
    "context_jumps": f""",
j AS (SELECT *, {_GENRES.format("b_genre")} AS ga, {_GENRES.format("genre")} AS gb FROM log WHERE {_ADJ}),
k AS (SELECT *, len(list_intersect(ga, gb)) AS i, len(list_distinct(list_concat(ga, gb))) AS o, abs(b_year - year) AS dy FROM j)
SELECT user_name AS user, {_iso("tm")} AS "at",
  {_round("least(100.0::DOUBLE, (CASE WHEN lower(b_artist) <> lower(artist) THEN 25.0::DOUBLE ELSE 0 END + CASE WHEN len(ga) > 0 AND len(gb) > 0 THEN 50.0::DOUBLE * (1.0::DOUBLE - i / o) WHEN len(ga) > 0 OR len(gb) > 0 THEN 18 ELSE 0 END) + least(25.0::DOUBLE, dy / 2.0::DOUBLE))", 1)} AS score,
  CASE WHEN len(ga) > 0 AND len(gb) > 0 THEN 'alta' ELSE 'baja' END AS confidence, b_artist AS from_artist, b_title AS from_title, b_genre AS from_genre, b_year AS from_year, artist AS to_artist, title AS to_title, genre AS to_genre, year AS to_year,
  concat_ws(', ', CASE WHEN lower(b_artist) <> lower(artist) THEN 'artista' END, CASE WHEN len(ga) > 0 AND len(gb) > 0 THEN 'género' WHEN len(ga) > 0 OR len(gb) > 0 THEN 'género parcial' END, CASE WHEN dy >= 10 THEN dy || ' años' END) AS evidence, g AS _first
FROM k""",
    "discoveries": f"""
SELECT min(user_name) AS user, count(*) AS plays, {_round(_span("min(tm)", "max(tm)", 86400), 1)} AS lifespan_days, {_iso("min(tm)")} AS first_play, {_iso("max(tm)")} AS last_play, min(artist) AS artist, min(title) AS title, min(album) AS album, track_id, min(g) AS _first
FROM log GROUP BY user_id, track_id HAVING count(*) >= 3""",
    "weekly_album_dominance": f",{_dominance('album')} SELECT * EXCLUDE (monday) FROM dom",
    "weekly_artist_dominance": f",{_dominance('artist')} SELECT * EXCLUDE (monday) FROM dom",
    "album_eras": f",{_eras('album')}",
    "artist_eras": f",{_eras('artist')}",
    "historical_vs_recent_albums": f",{_historical('album')}",
    "historical_vs_recent_artists": f",{_historical('artist')}",
    "artist_depth": f""",
lib AS (SELECT owner_key, count(*) AS library_tracks, count(DISTINCT album_key) AS library_albums FROM tracks GROUP BY 1),
alb AS (SELECT owner_key, max(n) AS m FROM (SELECT owner_key, album_key, count(*) AS n FROM log GROUP BY 1, 2) GROUP BY 1),
trk AS (SELECT owner_key, max(n) AS m FROM (SELECT owner_key, track_id, count(*) AS n FROM log GROUP BY 1, 2) GROUP BY 1),
pl AS (SELECT owner_key, max_by(owner, g) AS artist, count(*) AS plays, count(DISTINCT track_id) AS heard_tracks, count(DISTINCT album_key) AS heard_albums FROM log GROUP BY 1)
SELECT artist, plays, library_tracks, heard_tracks, {_share("heard_tracks", "library_tracks")} AS track_breadth_pct, library_albums, heard_albums, {_share("heard_albums", "library_albums")} AS album_breadth_pct,
       {_share("alb.m", "plays")} AS top_album_share_pct, {_share("trk.m", "plays")} AS top_track_share_pct
FROM pl JOIN lib USING (owner_key) JOIN alb USING (owner_key) JOIN trk USING (owner_key)""",
    "top_tracks": " SELECT count(*) AS plays, artist, title, album, genre, year AS release_year, track_id, min(g) AS _first FROM log GROUP BY ALL",
    "monthly": " SELECT strftime(tm, '%Y-%m') AS month, count(*) AS plays FROM log GROUP BY 1",
    "yearly": " SELECT year(tm)::INT AS year, count(*) AS plays FROM log GROUP BY 1",
    "hourly": " SELECT hour(tm)::INT AS hour, count(*) AS plays FROM log GROUP BY 1",
    "user_counts": " SELECT user_name AS user, count(*) AS plays FROM log GROUP BY 1",
    "artist_counts": " SELECT artist, count(*) AS plays FROM log GROUP BY 1",
    "album_counts": " SELECT artist, album, count(*) AS plays FROM log GROUP BY 1, 2",
    "genre_counts": f" SELECT genre, count(*) AS plays FROM (SELECT unnest({_GENRES.format('genre')}) AS genre FROM log) GROUP BY 1",
    "plays_export": f"""
SELECT {_iso("tm")} AS datetime, strftime(tm, '%Y-%m-%d') AS date, year(tm)::INT AS year, strftime(tm, '%Y-%m') AS month, dayname(tm) AS weekday, hour(tm)::INT AS hour, user_name AS user, track_id, artist, owner AS album_artist, album, album_key AS album_id,
  1 AS disc_number, position AS track_number, title, genre, log.year AS release_year, duration, lpad(named::VARCHAR, 2, '0') || ' - ' || title || '.flac' AS path, '' AS mbid, g AS _first FROM log""",
    "library_summary": " SELECT count(*) AS tracks, count(DISTINCT owner_key) AS artists, count(DISTINCT album_key) AS albums, sum(duration::DECIMAL(20,6))::DOUBLE AS duration, count(*) FILTER (id NOT IN (SELECT track_id FROM log)) AS unplayed FROM tracks",
    "album_catalog": " SELECT album_key, album_key AS album_id, min(owner) AS artist, min(album) AS album, count(*)::INT AS track_count, sum(duration::DECIMAL(20,6))::DOUBLE AS duration, min(year) AS year FROM tracks GROUP BY album_key",
    "album_library_coverage": f""",
pl AS (SELECT user_id, track_id, count(*) AS n, max(tm) AS tm FROM log GROUP BY 1, 2),
cells AS (SELECT u.user_name, u.user_id, t.album_key, t.owner, t.album, t.total, t.cat_year, t.genre, t.position, notes.play_count, pl.n, greatest(notes.last_played, pl.tm) AS seen
  FROM users u CROSS JOIN tracks t LEFT JOIN notes ON notes.user_id = u.user_id AND notes.track_id = t.id LEFT JOIN pl ON pl.user_id = u.user_id AND pl.track_id = t.id)
SELECT min(user_name) AS user, album_key AS album_id, min(owner) AS artist, min(album) AS album, NULL::VARCHAR AS added_at, min(total)::INT AS total_tracks, count(*) FILTER (play_count IS NOT NULL OR n > 0) AS tracks_heard,
  min(total) - count(*) FILTER (play_count IS NOT NULL OR n > 0) AS tracks_unheard, {_share("count(*) FILTER (play_count IS NOT NULL OR n > 0)", "min(total)")} AS heard_pct, sum(coalesce(play_count, n, 0))::BIGINT AS play_count,
  {_iso("max(seen)")} AS last_played, min(cat_year) AS year, min_by(genre, position) AS genre FROM cells GROUP BY user_id, album_key""",
    "album_runs": f",{_RUNS} SELECT * EXCLUDE (s, e) FROM runs",
    "album_completion": f""",{_RUNS},
ok AS (SELECT *, run_id AS g FROM runs WHERE meaningful = 1),
stp AS ({_mode("(SELECT * FROM ok WHERE starts_at_beginning = 1 AND complete_like = 0)", "user, album_key", "stop_track", "favorite")})
SELECT user, album_key, min(album_id) AS album_id, min(artist) AS artist, min(album) AS album, min(release_year) AS release_year, min(library_tracks) AS library_tracks, count(*) AS album_runs, sum(full_pass)::BIGINT AS probable_full_plays, sum(complete_like)::BIGINT AS near_complete_runs,
  sum(starts_at_beginning)::BIGINT AS started_from_beginning, count(*) FILTER (starts_at_beginning = 1 AND complete_like = 0 AND completion_pct >= 15) AS probable_abandons, {_round(_mean("completion_pct"), 1)} AS avg_completion_pct, {_round("median(completion_pct)", 1)} AS median_completion_pct,
  {_round(_mean("sequential_pct"), 1)} AS avg_sequential_pct, coalesce(min(favorite), '') AS favorite_stop_track, {_share("sum(full_pass)", "count(*)")} AS full_play_rate_pct
FROM ok LEFT JOIN stp USING (user, album_key) GROUP BY user, album_key""",
    "album_resurrections": f",{_RUNS} " + _returns("runs", "s", "run_id", "completion_pct"),
    "album_transitions": f""",{_RUNS},
pr AS (SELECT *, lag(album_key) OVER w AS pk, lag(artist) OVER w AS pa, lag(album) OVER w AS pb, lag(e) OVER w AS pe FROM runs WHERE meaningful = 1 WINDOW w AS (PARTITION BY user ORDER BY s, run_id))
SELECT user, count(*) AS times, min(pa) AS from_artist, min(pb) AS from_album, min(artist) AS to_artist, min(album) AS to_album, pk AS from_album_key, album_key AS to_album_key
FROM pr WHERE pk <> album_key AND epoch_us(s) - epoch_us(pe) <= {_TRANSITION} GROUP BY user, pk, album_key""",
    "album_threads": f",{_THREADS} SELECT * EXCLUDE (s, e) FROM threads",
    "album_resume_events": f""",{_THREADS}
SELECT thread_id, user_name AS user, t5.owner AS artist, t5.album, {_round("pause / 1000000.0::DOUBLE / 3600.0::DOUBLE", 2)} AS pause_hours, {_iso("p_at")} AS from_time, {_iso("tm")} AS to_time, p_pos AS from_position, position AS to_position, p_title AS from_title, title AS to_title,
  g - p_g - 1 AS interleaved_scrobbles, metadata_confidence FROM t5 JOIN threads USING (thread_id) WHERE pause > {_C.session_gap * _MIN}""",
    "album_thread_completion": f""",{_THREADS}
SELECT user, album_key, min(album_id) AS album_id, min(artist) AS artist, min(album) AS album, min(release_year) AS release_year, min(library_tracks) AS library_tracks, count(*) AS logical_threads, sum(full_thread)::BIGINT AS probable_full_plays, count(*) FILTER (resume_count > 0) AS resumed_threads,
  count(*) FILTER (starts_at_beginning = 1 AND complete_like = 0 AND coverage_pct >= 15) AS probable_abandons_after_window, {_round(_mean("coverage_pct"), 1)} AS avg_coverage_pct, {_round("median(coverage_pct)", 1)} AS median_coverage_pct, {_round(_mean("ordered_coverage_pct"), 1)} AS avg_ordered_coverage_pct,
  {_round(_mean("coverage_24h_pct"), 1)} AS avg_coverage_24h_pct, {_round(_mean("coverage_48h_pct"), 1)} AS avg_coverage_48h_pct, {_share("sum(full_thread)", "count(*)")} AS full_play_rate_pct
FROM threads WHERE meaningful = 1 GROUP BY user, album_key""",
    "album_thread_resurrections": f",{_THREADS} " + _returns("threads", "e", "thread_id", "coverage_pct"),
    "album_metadata_issues": """,
al AS (SELECT album_key, min(owner) AS artist, min(album) AS album, min(cat_year) AS year, count(*)::INT AS track_count, string_agg(id, '; ' ORDER BY position) AS track_ids, string_agg(title, '; ' ORDER BY position) AS track_titles,
         string_agg(lpad(named::VARCHAR, 2, '0') || ' - ' || title || '.flac', '; ' ORDER BY position) AS paths,
         trim(regexp_replace(lower(strip_accents(min(owner))), '[^a-z0-9]+', ' ', 'g')) AS ka, trim(regexp_replace(lower(strip_accents(min(album))), '[^a-z0-9]+', ' ', 'g')) AS kb FROM tracks GROUP BY album_key),
pr AS (SELECT a.album_key, string_agg(b.album_key, '; ' ORDER BY b.album_key) AS rel, max(b.track_count) AS big, bool_or(b.artist <> a.artist) AS var FROM al a JOIN al b ON a.ka = b.ka AND a.kb = b.kb AND a.album_key <> b.album_key GROUP BY 1)
SELECT album_key, album_key AS album_id, artist, album, year, track_count, track_ids, track_titles, paths, rel AS related_album_ids, rel AS related_album_keys,
  'same_title_artist_multiple_entities' || CASE WHEN track_count <= 2 AND big > 2 THEN ',small_fragment_of_larger_entity' ELSE '' END || CASE WHEN var THEN ',album_artist_format_variation' ELSE '' END AS signals
FROM al JOIN pr USING (album_key)""",
    "metadata_issues": f""",
filed AS (SELECT * EXCLUDE (a), lpad(named::VARCHAR, 2, '0') || ' - ' || title || '.flac' AS path FROM tracks),
stems AS (SELECT *, regexp_replace(regexp_extract(path, '([^/]*)/*$', 1), '^(.+)\\.[^.]+$', '\\1') AS stem FROM filed),
said AS (SELECT *, coalesce(TRY_CAST(regexp_extract(stem, '^\\s*(\\d{{1,3}})(?:\\s*[-._)\\]]+\\s*|\\s+)', 1) AS INT), 0) AS number, {_title_key("title")} AS a, {_title_key("stem")} AS b FROM stems),
long AS (SELECT id, a, b FROM said WHERE length(a) >= 4 AND length(b) >= 4),{similarity("long")},
found AS (SELECT said.*, ratio, number > 0 AND position <> 0 AND number <> position AS wrong, coalesce(regexp_matches(b, '[a-z]') AND ratio < 0.28::DOUBLE, false) AS unlike FROM said LEFT JOIN alike USING (id))
SELECT id AS track_id, artist, album, 1 AS disc_number, position AS track_number, CASE WHEN number > 0 THEN number END AS path_track_number, title, path, {_round("ratio", 3)} AS title_path_similarity,
  concat_ws(',', CASE WHEN wrong THEN 'track_number_vs_path' END, CASE WHEN unlike THEN 'title_vs_path_low_similarity' END) AS issues, CASE WHEN wrong AND unlike THEN 'baja' ELSE 'media' END AS confidence
FROM found WHERE wrong OR unlike""",
    "legacy_playcounts": f",{_LEGACY} SELECT * FROM leg",
    "legacy_artist_counts": f",{_LEGACY} SELECT artist, sum(play_count)::BIGINT AS play_count FROM leg GROUP BY 1",
    "legacy_album_counts": f",{_LEGACY} SELECT artist, album, sum(play_count)::BIGINT AS play_count FROM leg GROUP BY 1, 2",
}

_FULL = {name: f"WITH RECURSIVE {_BASE.strip()}{body}" for name, body in _BODIES.items()}
ORACLES = {name: f"SELECT * EXCLUDE (_first) FROM ({sql})" if "AS _first" in sql else sql for name, sql in _FULL.items()}

#: Order of each artefact's rows and what names them; `_first` is the place of a row's first play.
_PLACES = {
    "album_completion": ("probable_full_plays DESC, album_runs DESC, avg_completion_pct DESC, user, album_key", "user, album_key"),
    "album_eras": ("weeks DESC, dominant_plays DESC, avg_share_pct DESC, user, start_week", "user, start_week, end_week"),
    "album_library_coverage": ("lower(user), lower(artist), lower(album), album_id", "user, album_id"),
    "album_metadata_issues": ("lower(artist), lower(album), track_count, album_key", "album_key"),
    "album_resume_events": ("pause_hours DESC, thread_id, from_time", "thread_id, from_time, to_time"),
    "album_resurrections": ('silent_days DESC, user, album_key, "return"', 'user, album_key, "return"'),
    "album_runs": ("run_id", "run_id"),
    "album_thread_completion": ("probable_full_plays DESC, logical_threads DESC, avg_coverage_pct DESC, user, album_key", "user, album_key"),
    "album_thread_resurrections": ('silent_days DESC, user, album_key, "return"', 'user, album_key, "return"'),
    "album_threads": ("thread_id", "thread_id"),
    "album_transitions": ("times DESC, user, from_album_key, to_album_key", "user, from_album_key, to_album_key"),
    "artist_depth": ("plays DESC, track_breadth_pct DESC, artist", "artist"),
    "artist_eras": ("weeks DESC, dominant_plays DESC, avg_share_pct DESC, user, start_week", "user, start_week, end_week"),
    "context_jumps": ("score DESC, confidence = 'alta' DESC, _first", 'user, "at", from_title, to_title'),
    "discoveries": ("lifespan_days DESC, plays DESC, _first", "user, first_play, track_id"),
    "historical_vs_recent_albums": ("historical_total DESC, recent_scrobbles DESC, user, album_key", "user, album_key"),
    "historical_vs_recent_artists": ("historical_total DESC, recent_scrobbles DESC, user, artist", "user, artist"),
    "legacy_playcounts": ("play_count DESC, user, track_id", "user, track_id"),
    "metadata_issues": ("CASE confidence WHEN 'baja' THEN 0 WHEN 'media' THEN 1 ELSE 2 END, artist, album, track_number, track_id", "track_id"),
    "monthly": ("month", "month"),
    "plays": ("_first", "datetime, user, track_id"),
    "resurrections": ("silent_days DESC, _first", 'user, "return", track_id'),
    "sessions": ("session_id", "session_id"),
    "top_tracks": ("plays DESC, _first", "track_id"),
    "track_pairs": ("times DESC, _first", "user, from_track_id, to_track_id"),
    "weekly_album_dominance": ("user, year, week", "user, year, week"),
    "weekly_obsessions": ("year DESC, week DESC, plays DESC, _first", "year, week, user, track_id"),
}


def _leading(name: str, order: str, named: str) -> str:
    order, named = (x.replace("user", '"user"') for x in (order, named))
    body = _FULL["plays_export" if name == "plays" else name]
    return f"SELECT '{name}' AS artefact, position, concat_ws('|', {named}) AS row FROM (SELECT *, row_number() OVER (ORDER BY {order})::INT AS position FROM ({body})) WHERE position <= {_C.top}"


ORACLES["leading_rows"] = " UNION ALL ".join(f"({_leading(name, *told)})" for name, told in _PLACES.items())
