"""SQL of the trajectory queries, its ordered steps as recursive queries.

Every text continues the common table expressions of ``queries.mobility``: chunks of averaged
fixes, knots by repeated splitting, flights and pauses, settled rows, closed gaps, greedy places
and the statistics of bins.
"""

from __future__ import annotations

from tracelode.operators.gps_reports import DAILY_COLUMNS, HOURLY_COLUMNS
from tracelode.queries.mobility import _col, _gc, _off

STEP, R, W, H = 60, 50, 50, 30

FLIGHTS = _col(STEP).replace("WITH", "WITH RECURSIVE", 1) + f""",
 ch AS (SELECT participant, t, lat, lon, coalesce(sum(CASE WHEN next_bin - bin > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY participant ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM c),
 pt AS (SELECT participant, chunk, t, lat, lon, row_number() OVER (PARTITION BY participant, chunk ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY participant, chunk) AS n FROM ch),
 wide AS (SELECT a.participant, a.chunk, max({_gc("a.lat", "a.lon", "b.lat", "b.lon")}) AS d FROM pt a JOIN pt b ON a.participant = b.participant AND a.chunk = b.chunk AND a.k < b.k GROUP BY ALL),
 st AS (SELECT *, lead(lat) OVER q AS lat2, lead(lon) OVER q AS lon2 FROM pt WINDOW q AS (PARTITION BY participant, chunk ORDER BY k)),
 still AS (SELECT participant, chunk, k, n, {_gc("lat", "lon", "lat2", "lon2")} < {H} AS s FROM st WHERE lat2 IS NOT NULL),
 isl AS (SELECT participant, chunk, k, k - row_number() OVER (PARTITION BY participant, chunk ORDER BY k) AS g FROM still WHERE s),
 runs AS (SELECT participant, chunk, min(k) AS a, max(k) + 1 AS b FROM isl GROUP BY participant, chunk, g HAVING count(*) >= 2),
 moving AS (SELECT DISTINCT participant, chunk, n FROM pt JOIN wide USING (participant, chunk) WHERE d >= {R}),
 seeds AS (SELECT participant, chunk, 0 AS k FROM moving UNION SELECT participant, chunk, n - 1 FROM moving
   UNION SELECT participant, chunk, unnest([a, b]) FROM runs JOIN moving USING (participant, chunk)),
 spans AS (SELECT participant, chunk, k AS a, lead(k) OVER (PARTITION BY participant, chunk ORDER BY k) AS b FROM seeds),
 split AS (
   SELECT participant, chunk, a, b, NULL::BIGINT AS knot FROM spans WHERE b IS NOT NULL
   UNION ALL
   SELECT participant, chunk, unnest([a, kn]) AS a, unnest([kn, b]) AS b, kn AS knot FROM (
     SELECT s.participant, s.chunk, s.a, s.b, min(struct_pack(d := -({_off("p.lat", "p.lon", "u.lat", "u.lon", "v.lat", "v.lon")}), k := p.k)).k AS kn,
       max({_off("p.lat", "p.lon", "u.lat", "u.lon", "v.lat", "v.lon")}) AS away, any_value(least(s.b, v.n - 2)) AS last
     FROM split s JOIN pt u ON u.participant = s.participant AND u.chunk = s.chunk AND u.k = s.a
       JOIN pt v ON v.participant = s.participant AND v.chunk = s.chunk AND v.k = least(s.b, v.n - 2)
       JOIN pt p ON p.participant = s.participant AND p.chunk = s.chunk AND p.k BETWEEN s.a AND least(s.b, p.n - 2)
     WHERE least(s.b, v.n - 2) - s.a >= 2 GROUP BY s.participant, s.chunk, s.a, s.b)
   WHERE away >= {W} AND a < kn AND kn < last),
 kn AS (SELECT participant, chunk, k FROM seeds UNION SELECT participant, chunk, knot FROM split WHERE knot IS NOT NULL),
 kp AS (SELECT participant, chunk, k AS a, lead(k) OVER (PARTITION BY participant, chunk ORDER BY k) AS b FROM kn),
 rest AS (SELECT kp.participant, kp.chunk, a, b, bool_and(s) AS s FROM kp JOIN still ON still.participant = kp.participant AND still.chunk = kp.chunk AND still.k >= a AND still.k < b GROUP BY ALL),
 seg AS (SELECT rest.participant, s, u.lat AS y0, u.lon AS x0, u.t AS t0, v.lat AS y1, v.lon AS x1, v.t AS t1 FROM rest JOIN pt u ON u.participant = rest.participant AND u.chunk = rest.chunk AND u.k = a
   JOIN pt v ON v.participant = rest.participant AND v.chunk = rest.chunk AND v.k = b),
 whole AS (SELECT u.participant, (u.lat + v.lat) / 2 AS y, (u.lon + v.lon) / 2 AS x, u.t AS t0, v.t AS t1 FROM wide JOIN pt u ON u.participant = wide.participant AND u.chunk = wide.chunk AND u.k = 0
   JOIN pt v ON v.participant = wide.participant AND v.chunk = wide.chunk AND v.k = v.n - 1 WHERE d < {R}),
 fl AS (SELECT participant, 3 AS status, lat AS lat0, lon AS lon0, t - {STEP / 2} AS t0, NULL::DOUBLE AS lat1, NULL::DOUBLE AS lon1, t + {STEP / 2} AS t1 FROM pt WHERE n = 1
   UNION ALL SELECT participant, 2, y, x, t0 - {STEP / 2}, y, x, t1 + {STEP / 2} FROM whole
   UNION ALL SELECT participant, CASE WHEN s THEN 2 ELSE 1 END, CASE WHEN s THEN (y0 + y1) / 2 ELSE y0 END, CASE WHEN s THEN (x0 + x1) / 2 ELSE x0 END, t0,
     CASE WHEN s THEN (y0 + y1) / 2 ELSE y1 END, CASE WHEN s THEN (x0 + x1) / 2 ELSE x1 END, t1 FROM seg)"""


def _wrap(x: str) -> str:
    return f"((({x}) + 180) % 360 + 360) % 360 - 180"


TRAJECTORY = FLIGHTS + f""",
 f0 AS (SELECT participant, row_number() OVER q AS i, status, lat0, lon0, t0::DOUBLE AS t0, lat1, lon1, t1::DOUBLE AS t1, lead(lat0) OVER q AS nlat, lead(lon0) OVER q AS nlon, lead(t0) OVER q AS nt FROM fl WINDOW q AS (PARTITION BY participant ORDER BY t0)),
 un AS (
   SELECT participant, i, CASE WHEN status = 3 THEN 2 ELSE status END AS status, lat0, lon0, t0, CASE WHEN status = 3 THEN lat0 ELSE lat1 END AS lat1, CASE WHEN status = 3 THEN lon0 ELSE lon1 END AS lon1, t1 FROM f0 WHERE i = 1
   UNION ALL
   SELECT participant, i, CASE WHEN k = 0 THEN status WHEN far THEN 1 ELSE 2 END, CASE WHEN far THEN lat0 - vy ELSE lat0 END, CASE WHEN far THEN {_wrap("lon0 - vx")} ELSE lon0 END, t0,
     CASE WHEN k = 0 THEN lat1 WHEN far THEN lat0 + vy ELSE lat0 END, CASE WHEN k = 0 THEN lon1 WHEN far THEN {_wrap("lon0 + vx")} ELSE lon0 END, t1
   FROM (SELECT *, k > 0 AND span > 0 AND NOT near AS far, dy / span * {STEP / 2} AS vy, dx / span * {STEP / 2} AS vx FROM (
     SELECT *, CASE k WHEN 1 THEN lat0 - py WHEN 2 THEN nlat - lat0 END AS dy, CASE k WHEN 1 THEN lon0 - px WHEN 2 THEN nlon - lon0 END AS dx,
       CASE k WHEN 1 THEN t0 - pt WHEN 2 THEN nt - t1 ELSE 0 END AS span, CASE k WHEN 1 THEN {_gc("lat0", "lon0", "py", "px")} < {R} WHEN 2 THEN {_gc("lat0", "lon0", "nlat", "nlon")} < {R} ELSE true END AS near
     FROM (SELECT f0.*, un.lat1 AS py, un.lon1 AS px, un.t1 AS pt,
         CASE WHEN f0.status <> 3 THEN 0 WHEN f0.t0 - un.t1 <= {3 * STEP} THEN 1 WHEN nt IS NOT NULL AND nt - f0.t1 <= {3 * STEP} THEN 2 ELSE 3 END AS k
       FROM f0 JOIN un ON f0.participant = un.participant AND f0.i = un.i + 1)))),
 mo AS (SELECT *, CASE WHEN status = 2 AND lag(status) OVER q = 2 AND lag(t1) OVER q = t0 THEN 0 ELSE 1 END AS o FROM un WINDOW q AS (PARTITION BY participant ORDER BY i)),
 mr AS (SELECT *, sum(o) OVER (PARTITION BY participant ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM mo),
 mg AS (SELECT participant, g, min(status) AS status, CASE WHEN count(*) > 1 THEN avg(lat0) ELSE min(lat0) END AS lat0, CASE WHEN count(*) > 1 THEN avg(lon0) ELSE min(lon0) END AS lon0, min(t0) AS t0,
   CASE WHEN count(*) > 1 THEN avg(lat0) ELSE min(lat1) END AS lat1, CASE WHEN count(*) > 1 THEN avg(lon0) ELSE min(lon1) END AS lon1, max(t1) AS t1 FROM mr GROUP BY participant, g),
 gp AS (
   SELECT participant, g, status, lat0, lon0, t0, lat1, lon1, t1, NULL::DOUBLE AS ey, NULL::DOUBLE AS ex, NULL::DOUBLE AS since FROM mg WHERE g = 1
   UNION ALL
   SELECT participant, g, status, CASE WHEN NOT near THEN lat0 WHEN ps = 2 THEN py WHEN status = 2 THEN lat0 ELSE (py + lat0) / 2 END, CASE WHEN NOT near THEN lon0 WHEN ps = 2 THEN px WHEN status = 2 THEN lon0 ELSE (px + lon0) / 2 END, t0,
     CASE WHEN near AND ps = 2 AND status = 2 THEN py ELSE lat1 END, CASE WHEN near AND ps = 2 AND status = 2 THEN px ELSE lon1 END, t1,
     CASE WHEN NOT near OR ps = 2 THEN py WHEN status = 2 THEN lat0 ELSE (py + lat0) / 2 END, CASE WHEN NOT near OR ps = 2 THEN px WHEN status = 2 THEN lon0 ELSE (px + lon0) / 2 END, CASE WHEN near THEN pt END
   FROM (SELECT mg.*, gp.status AS ps, gp.lat1 AS py, gp.lon1 AS px, gp.t1 AS pt, mg.t0 > gp.t1 AND {_gc("mg.lat0", "mg.lon0", "gp.lat1", "gp.lon1")} < 10 AS near FROM mg JOIN gp ON mg.participant = gp.participant AND mg.g = gp.g + 1)),
 en AS (SELECT participant, g, status, lat0, lon0, t0, coalesce(lead(ey) OVER q, lat1) AS lat1, coalesce(lead(ex) OVER q, lon1) AS lon1, t1, since FROM gp WINDOW q AS (PARTITION BY participant ORDER BY g)),
 br AS (SELECT *, lag(t1) OVER q = t0 AND lag(status) OVER q = 2 AND status = 1 AS starts, lead(t0) OVER q = t1 AND lead(status) OVER q = 2 AND status = 1 AS ends,
   lag(lat1) OVER q AS fy, lag(lon1) OVER q AS fx, lead(lat0) OVER q AS ay, lead(lon0) OVER q AS ax FROM en WINDOW q AS (PARTITION BY participant ORDER BY g)),
 tr AS (SELECT participant, status, CASE WHEN starts THEN fy ELSE lat0 END AS lat0, CASE WHEN starts THEN fx ELSE lon0 END AS lon0, t0, CASE WHEN ends THEN ay ELSE lat1 END AS lat1, CASE WHEN ends THEN ax ELSE lon1 END AS lon1, t1, 1 AS obs FROM br
   UNION ALL SELECT participant, 2, lat0, lon0, since, lat0, lon0, t0, 0 FROM gp WHERE since IS NOT NULL)"""


def places(source: str, within: float, name: str, moving: bool = True) -> str:
    """Greedy places ``name`` (grp, places) of ``source`` (grp, i from 1, lat, lon, s); their centres move to the mean of their visits or stay."""
    here = f"list_transform(p.places, lambda z: {_gc('n.lat', 'n.lon', 'z.y', 'z.x')})"
    y, x = ("(z.y * z.n + lat) / (z.n + 1)", "(z.x * z.n + lon) / (z.n + 1)") if moving else ("z.y", "z.x")
    moved = f"{{'y': {y}, 'x': {x}, 'n': z.n + 1, 's': z.s + s}}"
    return f""",
 {name}_r AS (
   SELECT grp, i, [{{'y': lat, 'x': lon, 'n': 1::BIGINT, 's': s}}] AS places FROM {source} WHERE i = 1
   UNION ALL
   SELECT grp, i, CASE WHEN d[k] <= {within} THEN list_concat(list_concat(places[:k - 1], [(SELECT {moved} FROM (SELECT places[k] AS z))]), places[k + 1:]) ELSE list_append(places, {{'y': lat, 'x': lon, 'n': 1::BIGINT, 's': s}}) END
   FROM (SELECT *, list_position(d, list_min(d)) AS k FROM (SELECT n.grp, n.i, n.lat, n.lon, n.s, p.places, {here} AS d FROM {source} n JOIN {name}_r p ON n.grp = p.grp AND n.i = p.i + 1))),
 {name} AS (SELECT grp, arg_max(places, i) AS places FROM {name}_r GROUP BY grp)"""


HOMES = TRAJECTORY + """,
 np AS (SELECT participant AS grp, lat0 AS lat, lon0 AS lon, t1 - t0 AS s, row_number() OVER (PARTITION BY participant ORDER BY t0) AS i FROM tr WHERE status = 2 AND obs = 1 AND (floor((t0 + t1) / 2 % 86400 / 3600) <= 9 OR floor((t0 + t1) / 2 % 86400 / 3600) >= 19))""" + places("np", 20, "hp") + """,
 hm AS (SELECT grp AS participant, list_filter(places, lambda z: z.n = list_max(list_transform(places, lambda w: w.n)))[1] AS h FROM hp)"""

PLACES = TRAJECTORY + """,
 ap AS (SELECT participant AS grp, lat0 AS lat, lon0 AS lon, t1 - t0 AS s, row_number() OVER (PARTITION BY participant ORDER BY t0) AS i FROM tr WHERE status = 2)""" + places("ap", 50, "sp")

NAMES = ("obs_duration", "obs_day", "obs_night", "home_time", "dist_traveled", "max_dist_home", "radius", "diameter", "num_sig_places", "entropy",
         "total_flight_time", "av_flight_length", "sd_flight_length", "av_flight_duration", "sd_flight_duration", "total_pause_time", "av_pause_duration", "sd_pause_duration")


def statistics(pieces: str) -> str:
    """Table ``sm`` (participant, bin_start, part, statistics) of ``pieces``: participant, bin_start, part, a, b."""
    return HOMES + f""",
 ext AS (SELECT participant, min(t0) AS first, arg_max(t1, t0) AS last FROM tr GROUP BY participant),
 pc AS ({pieces}),
 ov AS (SELECT pc.*, tr.* EXCLUDE (participant), row_number() OVER q AS lo, count(*) OVER (PARTITION BY pc.participant, a) AS n FROM pc JOIN tr ON tr.participant = pc.participant AND tr.t0 < b AND tr.t1 > a WINDOW q AS (PARTITION BY pc.participant, a ORDER BY t0)),
 sh AS (SELECT *, CASE WHEN lo = 1 THEN (a - t0) / (t1 - t0) END AS p, CASE WHEN lo = n THEN (b - t0) / (t1 - t0) END AS q FROM ov),
 cl AS (SELECT participant, bin_start, part, status, CASE WHEN p IS NULL THEN lat0 ELSE lat0 + (lat1 - lat0) * p END AS lat0, CASE WHEN p IS NULL THEN lon0 ELSE lon0 + (lon1 - lon0) * p END AS lon0, CASE WHEN p IS NULL THEN t0 ELSE a END AS t0,
   CASE WHEN q IS NULL THEN lat1 ELSE lat0 + (lat1 - lat0) * q END AS lat1, CASE WHEN q IS NULL THEN lon1 ELSE lon0 + (lon1 - lon0) * q END AS lon1, CASE WHEN q IS NULL THEN t1 ELSE b END AS t1,
   CASE WHEN p < 0 OR p > 1 OR q < 0 OR q > 1 THEN 0 ELSE obs END AS obs FROM sh),
 ms AS (SELECT cl.*, t1 - t0 AS s, floor((t0 + t1) / 2 % 86400 / 3600) BETWEEN 8 AND 19 AS day, {_gc("h.y", "h.x", "lat0", "lon0")} AS d0, {_gc("h.y", "h.x", "lat1", "lon1")} AS d1, round_even({_gc("lat1", "lon1", "lat0", "lon0")}, 0) AS d FROM cl JOIN hm USING (participant)),
 ag AS (SELECT participant, bin_start, part, coalesce(sum(s) FILTER (obs = 1), 0) AS obs_duration, coalesce(sum(s) FILTER (obs = 1 AND day), 0) AS obs_day, coalesce(sum(s) FILTER (obs = 1 AND NOT day), 0) AS obs_night,
   coalesce(sum(s) FILTER ((d0 + d1) / 2 <= 50), 0) AS home_time, sum(d) AS dist_traveled, max(greatest(d0, d1)) AS max_dist_home,
   coalesce(sum(s) FILTER (status = 1), 0) AS total_flight_time, coalesce(avg(d) FILTER (status = 1), 0) AS av_flight_length, coalesce(stddev_pop(d) FILTER (status = 1), 0) AS sd_flight_length,
   coalesce(avg(s) FILTER (status = 1), 0) AS av_flight_duration, coalesce(stddev_pop(s) FILTER (status = 1), 0) AS sd_flight_duration,
   coalesce(sum(s) FILTER (status = 2), 0) AS total_pause_time, coalesce(avg(s) FILTER (status = 2), 0) AS av_pause_duration, coalesce(stddev_pop(s) FILTER (status = 2), 0) AS sd_pause_duration,
   sum(s * lat0) FILTER (status = 2) / sum(s) FILTER (status = 2) AS cy, sum(s * lon0) FILTER (status = 2) / sum(s) FILTER (status = 2) AS cx FROM ms GROUP BY ALL),
 rd AS (SELECT participant, bin_start, part, sum(s * {_gc("cy", "cx", "lat0", "lon0")}) FILTER (status = 2) / sum(s) FILTER (status = 2) AS radius FROM ms JOIN ag USING (participant, bin_start, part) GROUP BY ALL),
 dm AS (SELECT x.participant, x.bin_start, x.part, max({_gc("x.lat0", "x.lon0", "y.lat0", "y.lon0")}) AS diameter FROM cl x JOIN cl y ON x.participant = y.participant AND x.bin_start = y.bin_start AND x.part = y.part AND x.t0 < y.t0 GROUP BY ALL),
 bp AS (SELECT {{'p': participant, 'b': bin_start, 'k': part}} AS grp, lat0 AS lat, lon0 AS lon, s, row_number() OVER (PARTITION BY participant, bin_start, part ORDER BY t0) AS i FROM ms WHERE status = 2)""" + places("bp", 50, "bpl") + f""",
 sg AS (SELECT grp.p AS participant, grp.b AS bin_start, grp.k AS part, list_transform(list_filter(places, lambda z: z.s > 900), lambda z: z.s) AS l FROM bpl),
 se AS (SELECT participant, bin_start, part, len(l)::DOUBLE AS num_sig_places, CASE WHEN len(l) > 1 THEN -list_sum(list_transform(l, lambda v: v / list_sum(l) * ln(v / list_sum(l) + 0.00001))) ELSE 0 END AS entropy FROM sg),
 sm AS (SELECT pc.participant, pc.bin_start, pc.part, coalesce(obs_duration, 0) AS obs_duration, coalesce(obs_day, 0) AS obs_day, coalesce(obs_night, 0) AS obs_night, home_time, dist_traveled, max_dist_home,
   CASE WHEN home_time IS NOT NULL THEN coalesce(radius, 0) END AS radius, CASE WHEN home_time IS NOT NULL THEN coalesce(diameter, 0) END AS diameter, CASE WHEN home_time IS NOT NULL THEN coalesce(num_sig_places, 0) END AS num_sig_places,
   CASE WHEN home_time IS NOT NULL THEN coalesce(entropy, 0) END AS entropy, {", ".join(NAMES[10:])} FROM (SELECT DISTINCT participant, bin_start, part FROM pc) pc JOIN hm USING (participant) LEFT JOIN ag USING (participant, bin_start, part) LEFT JOIN rd USING (participant, bin_start, part)
   LEFT JOIN dm USING (participant, bin_start, part) LEFT JOIN se USING (participant, bin_start, part))"""


def _bins(width: int, last: str) -> str:
    return f"SELECT participant, a AS bin_start, 'all' AS part, a, a + {width} AS b FROM (SELECT participant, unnest(list_transform(range(CAST((({last}) - floor(first / {width}) * {width}) // {width} AS BIGINT)), lambda k: floor(first / {width}) * {width} + k * {width})) AS a FROM ext)"


DAILY = statistics(_bins(86400, "floor(last / 86400) * 86400 + 86400"))
HOURLY = statistics(_bins(3600, "floor(last / 3600) * 3600"))
SPLIT = statistics(
    "SELECT participant, d AS bin_start, k.part AS part, d + k.a AS a, d + k.b AS b FROM (SELECT participant, unnest(list_transform(range(CAST(floor((last - floor(first / 86400) * 86400) / 86400) AS BIGINT) + 1), lambda k: floor(first / 86400) * 86400 + k * 86400)) AS d FROM ext), "
    "(SELECT unnest([{'part': 'daytime', 'a': 28800, 'b': 72000}, {'part': 'nighttime', 'a': 0, 'b': 28800}, {'part': 'nighttime', 'a': 72000, 'b': 86400}]) AS k)"
)

ROUTINE = TRAJECTORY + f""",
 ext AS (SELECT participant, min(t0) AS first, arg_max(t1, t0) AS last FROM tr GROUP BY participant),
 rs AS (SELECT participant, lat0, lon0, t0, t1 FROM tr WHERE status = 2),
 re AS (SELECT participant, min(t0) AS f, max(t1) AS l FROM rs GROUP BY participant),
 dy AS (SELECT participant, unnest(list_transform(range(CAST(floor((last - floor(first / 86400) * 86400) / 86400) AS BIGINT) + 1), lambda k: floor(first / 86400) * 86400 + k * 86400)) AS a FROM ext),
 lh AS (SELECT dy.*, greatest(a, f) AS lo, least(a + 86400, l) AS hi, f, l FROM dy LEFT JOIN re USING (participant)),
 ba AS (SELECT *, least(round_even((lo - f) / 86400, 0), 14)::BIGINT AS before, least(round_even((l - hi) / 86400, 0), 14)::BIGINT AS after FROM lh),
 sf AS (SELECT *, unnest(list_concat(range(1, before + 1), range(-after, 0))) AS s FROM ba WHERE greatest(before, after) > 0),
 pr AS (SELECT sf.participant, sf.a, s, least(m.t1, hi, o.t1 + s * 86400) - greatest(m.t0, lo, o.t0 + s * 86400) AS c, {_gc("m.lat0", "m.lon0", "o.lat0", "o.lon0")} <= 10 AS near
   FROM sf JOIN rs m ON m.participant = sf.participant AND m.t0 < hi AND m.t1 > lo JOIN rs o ON o.participant = sf.participant AND o.t0 + s * 86400 < least(m.t1, hi) AND o.t1 + s * 86400 > greatest(m.t0, lo)),
 ar AS (SELECT participant, a, s, coalesce(sum(c) FILTER (near), 0) / sum(c) AS v FROM pr WHERE c > 0 GROUP BY ALL),
 wd AS (SELECT sf.*, coalesce(v, 0) AS v, (isodow(make_timestamp(CAST((lo + hi) / 2 * 1000000 AS BIGINT))) >= 6) = (isodow(make_timestamp(CAST(((lo + hi) / 2 - s * 86400) * 1000000 AS BIGINT))) >= 6) AS same FROM sf LEFT JOIN ar USING (participant, a, s))
SELECT dy.participant, dy.a AS bin_start, round(coalesce(sum(v) / any_value(before + after), 0) + 13e-9, 6) AS routine, round(coalesce(sum(v) FILTER (same) / any_value(before + after), 0) + 13e-9, 6) AS routine_stratified
FROM dy LEFT JOIN wd ON wd.participant = dy.participant AND wd.a = dy.a GROUP BY dy.participant, dy.a"""


def _rounded(names, digits: int) -> str:
    return ", ".join(f"round({n} + {13 * 10.0 ** -(digits + 3)}, {digits}) AS {n}" for n in names)


def _stats(value: str = "{n}", suffix: str = "") -> str:
    """Statistics rounded to 3 digits, those of many small distances to metres (their last digits depend on the library)."""
    return ", ".join(f"round({value.format(n=n)} + {13 * 10.0 ** -(d + 3)}, {d}) AS {n}{suffix}" for n in NAMES for d in [0 if n in ("radius", "diameter", "max_dist_home") else 3])


def _corner(x: str, y: str, r: float) -> str:
    """Area of the circle of radius ``r`` about the origin left of ``x`` and below ``y``."""
    cap = lambda t: f"({r * r} * acos({t} / {r}) - {t} * sqrt({r * r} - {t} * {t}))"  # noqa: E731  # beyond t
    half = lambda t: f"({t} * sqrt({r * r} - {t} * {t}) + {r * r} * asin({t} / {r})) / 2"
    a, b = f"greatest(-{r}, least({r}, {x}))", f"greatest(-{r}, least({r}, {y}))"
    inside = f"{a} * {b} + {half(a)} + {half(b)} + pi() * {r * r} / 4"
    outside = f"CASE WHEN {a} >= 0 AND {b} >= 0 THEN pi() * {r * r} - {cap(a)} - {cap(b)} WHEN {a} < 0 AND {b} >= 0 THEN {cap(f'(-{a})')} WHEN {a} >= 0 THEN {cap(f'(-{b})')} ELSE 0 END"
    return f"CASE WHEN {a} * {a} + {b} * {b} < {r * r} THEN {inside} ELSE {outside} END"


def _circles(d: str, r: float, s: float) -> str:
    """Area that two circles share whose centres are ``d`` apart."""
    x, y = f"(({d} * {d} + {r * r - s * s}) / (2 * {d}))", f"(({d} * {d} + {s * s - r * r}) / (2 * {d}))"
    return f"CASE WHEN {d} >= {r + s} THEN 0 WHEN {d} <= {abs(r - s)} THEN pi() * {min(r, s) ** 2} ELSE {r * r} * acos({x} / {r}) - {x} * sqrt(greatest({r * r} - {x} * {x}, 0)) + {s * s} * acos({y} / {s}) - {y} * sqrt(greatest({s * s} - {y} * {y}, 0)) END"


_M = "(6371000 * pi() / 180)"
INTEREST = PLACES + f""",
 pl AS (SELECT who, place, z.y AS y, z.x AS x, CASE place % 4 WHEN 0 THEN 'cafe' WHEN 1 THEN 'park' WHEN 2 THEN 'office' ELSE 'shop' END AS kind FROM (SELECT grp AS who, unnest(range(len(places))) AS place, unnest(places) AS z FROM sp)),
 pz AS (SELECT participant, t0, lat0 AS lat, lon0 AS lon, t1 - t0 AS s FROM tr WHERE status = 2),
 nr AS (SELECT pz.*, who, place, kind, (x - lon) * {_M} * cos(radians(lat)) AS x1, (y - lat) * {_M} AS y1, 0.0004 * {_M} * cos(radians(lat)) AS w, 0.0004 * {_M} AS h FROM pz JOIN pl ON abs(y - lat) < 0.002 AND abs(x - lon) < 0.01),
 a2 AS (SELECT *, CASE WHEN place % 3 = 0 THEN {_circles("greatest(sqrt(x1 * x1 + y1 * y1), 1e-12)", 50.0, 7.5)}
   ELSE ({_corner("(x1 + w)", "(y1 + h)", 50.0)}) - ({_corner("x1", "(y1 + h)", 50.0)}) - ({_corner("(x1 + w)", "y1", 50.0)}) + ({_corner("x1", "y1", 50.0)}) END AS m2 FROM nr),
 mt AS (SELECT * FROM a2 WHERE m2 > 1e-6),
 kd AS (SELECT participant, t0, kind, sum(m2) AS m2 FROM mt GROUP BY ALL),
 sr AS (SELECT participant, t0, kind, m2 / sum(m2) OVER w AS share, row_number() OVER (PARTITION BY participant, t0 ORDER BY round(m2, 3) DESC, kind) = 1 AS chosen FROM kd WINDOW w AS (PARTITION BY participant, t0))"""

PAUSES = HOMES + f""",
 mq AS (SELECT tr.participant AS grp, lat0 AS lat, lon0 AS lon, t1 - t0 AS s, row_number() OVER (PARTITION BY tr.participant ORDER BY t0) AS i FROM tr JOIN hm USING (participant) WHERE status = 2 AND {_gc("lat0", "lon0", "h.y", "h.x")} > 15)""" + places("mq", 15, "mp", False)


def _clock(parts: str) -> str:
    return ", ".join(f"{f}(make_timestamp(CAST(bin_start * 1000000 AS BIGINT)))::INT AS {f}" for f in ("year", "month", "day", "hour")[: len(parts)])


def _units(daily: bool) -> str:
    """Columns of the published table in its units, nulls where nothing was observed."""
    out = []
    for n in DAILY_COLUMNS if daily else HOURLY_COLUMNS:
        unit = 1
        if n.endswith(("duration", "time", "obs_day", "obs_night")):
            unit = 3600 if daily else 60
        elif n in ("dist_traveled", "max_dist_home", "radius", "diameter") or daily and n.endswith("flight_length"):
            unit = 1000
        v = n if n.startswith("obs_") else f"CASE WHEN obs_duration > 0 THEN {n} END"
        d = 3 if n in ("radius", "diameter", "max_dist_home") else 5
        out.append(f"round(({v}) / {unit} + {13 * 10.0 ** -(d + 3)}, {d}) AS {n}")
    return ", ".join(out)


_SPOTS = ("lat0", "lon0", "lat1", "lon1")
ORACLE = {
    "flights_from_knots": FLIGHTS + f" SELECT participant, status, t0::DOUBLE AS t0, t1::DOUBLE AS t1, 1 AS obs, {_rounded(_SPOTS, 6)} FROM fl",
    "mobility_infer": TRAJECTORY + f" SELECT participant, status, t0, t1, obs, {_rounded(_SPOTS, 6)} FROM tr",
    "home_location": HOMES + f" SELECT participant, {_rounded(('lat', 'lon'), 6)} FROM (SELECT participant, h.y AS lat, h.x AS lon FROM hm)",
    "significant_places": PLACES + f""" SELECT participant, place, {_rounded(('lat', 'lon'), 6)}, visits, {_rounded(('seconds',), 3)}
FROM (SELECT grp AS participant, unnest(range(len(places))) AS place, unnest(list_transform(places, lambda z: z.y)) AS lat, unnest(list_transform(places, lambda z: z.x)) AS lon, unnest(list_transform(places, lambda z: z.n)) AS visits, unnest(list_transform(places, lambda z: z.s)) AS seconds FROM sp)""",
    "gps_daily_summary": DAILY + f" SELECT participant, bin_start::DOUBLE AS bin_start, {_stats()} FROM sm",
    "gps_hourly_summary": HOURLY + f" SELECT participant, bin_start::DOUBLE AS bin_start, {_stats()} FROM sm",
    "gps_day_night_summary": SPLIT + " SELECT participant, bin_start::DOUBLE AS bin_start, " + _stats("max({n}) FILTER (part = 'daytime')", "_daytime") + ", " + _stats("max({n}) FILTER (part = 'nighttime')", "_nighttime") + " FROM sm GROUP BY participant, bin_start",
    "routine_index_daily": ROUTINE,
    "pause_places": PAUSES + f""" SELECT participant, place, {_rounded(('lat', 'lon'), 6)}, {_rounded(('minutes',), 3)}
FROM (SELECT grp AS participant, unnest(range(len(places))) AS place, unnest(list_transform(places, lambda z: z.y)) AS lat, unnest(list_transform(places, lambda z: z.x)) AS lon, unnest(list_transform(places, lambda z: z.s)) / 60 AS minutes FROM mp)""",
    "gps_daily_report": DAILY + ", " + ROUTINE[len(TRAJECTORY):].split(",", 1)[1].replace("ext AS", "ext2 AS", 1).replace("FROM ext)", "FROM ext2)").replace("\nSELECT dy.participant", ",\n ri AS (SELECT dy.participant", 1) + f""")
SELECT participant, {_clock("ymd")}, {_units(True)}, round(routine + 13e-8, 5) AS physical_circadian_rhythm, round(routine_stratified + 13e-8, 5) AS physical_circadian_rhythm_stratified FROM sm LEFT JOIN ri USING (participant, bin_start)""",
    "mobility_trace": TRAJECTORY + f""",
 tk AS (SELECT participant, t0, lat0, lon0, unnest(range(ceil(t0 / 30)::BIGINT, ceil(t1 / 30)::BIGINT)) AS k FROM tr WHERE status = 2),
 tb AS (SELECT participant, k, min(struct_pack(t0 := t0, lat0 := lat0, lon0 := lon0)) AS b FROM tk GROUP BY ALL)
SELECT participant, k * 30 AS t, {_rounded(('lat', 'lon'), 6)} FROM (SELECT participant, k, b.lat0 AS lat, b.lon0 AS lon FROM tb)""",
    "poi_time_share": INTEREST + """,
 pj AS (SELECT pz.participant, pz.t0, pz.s / 60 AS m, kind, share, chosen FROM pz LEFT JOIN sr ON pz.participant = sr.participant AND pz.t0 = sr.t0)
SELECT participant, coalesce(kind, 'other') AS kind, round(sum(CASE WHEN coalesce(chosen, true) THEN m ELSE 0 END) + 13e-5, 2) AS minutes, round(sum(m * coalesce(share, 0)) + 13e-5, 2) AS minutes_adjusted FROM pj GROUP BY ALL""",
    "poi_log": INTEREST + """,
 lg AS (SELECT DISTINCT participant, floor(t0 / 86400)::BIGINT AS day, who, place, kind FROM mt WHERE s >= 300)
SELECT participant, day, '{"kind":"' || kind || '"}' AS tags, count(*) AS n_places FROM lg GROUP BY ALL""",
    "gps_hourly_report": HOURLY + f" SELECT participant, {_clock('ymdh')}, {_units(False)} FROM sm",
}
