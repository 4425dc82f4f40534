"""The registered queries on contests, each with the DuckDB SQL of its rows.

Shares and margins are rounded to six places at this edge only, so that two engines' sums can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hustings import board_queries, candidate_queries, link_queries, place_queries, rule_queries
from hustings.contest_sql import PREFIX
from hustings.functions import canon
from hustings.operators import board, calibrate, linkage, merge, place, project, quality, resolve, rollup, signals
from hustings.plans.contests import BEFORE, YEAR, Contests
from hustings.registry import rounded
from hustings.sources import contests as source
from hustings.sources import files

BLOC = ["STANDARD", "ECONOMY"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, build: Callable[[Contests], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(build(Contests(spark, sf_dir)))
    if sql:
        ORACLE[name] = PREFIX + sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["tally_active"](spark, sf_dir)


SEAT = ["arena", "s", "y", "n"]
PLACE = ["arena", "s", "j"]


def seat_names(c: Contests) -> DataFrame:
    return c.seats.select("arena", "s", "y", "j", F.concat(F.lit("Seat "), "j", F.lit(" and Co")).alias("name"))


def elector_book(c: Contests) -> DataFrame:
    """Electors of every seat in a book of which some numbers and names differ from the seats', some names are missing, and some are parts of others."""
    j = F.col("j")
    name = F.when(j % 6 == 5, None).when(j % 6 == 2, "Other seat").when(j % 6 == 3, F.concat(F.lit("SEAT "), j, F.lit("-and (SC)"))).otherwise(F.concat(F.lit("seat "), j, F.lit(" and co")))
    number = F.when(j % 6 == 1, j + 50).when((j % 6 == 4) & (F.col("y") % 2 == 0), j - 2).otherwise(j).cast("int")
    return c.electors.select("arena", "s", "y", number.alias("j"), name.alias("name"), "e")


def backfilled_candidates(c: Contests) -> DataFrame:
    """All candidates, of whom some have no share, and of these some no total, so that the winner's share must tell it."""
    w = Window.partitionBy(*SEAT)
    rows = c.cand.where("votes > 0").withColumns({"total": F.sum("votes").over(w), "top": F.max("votes").over(w)})
    share = F.when(F.col("n") % 3 != 0, F.col("votes").cast("double") * 100 / F.col("total")).otherwise(0.0)
    winner = F.col("top").cast("double") * 100 / (F.col("total") + 2 * F.col("n"))
    return rows.select(*SEAT, "p", board.backfilled(share, F.col("votes"), F.when(F.col("n") != 6, F.col("total") + F.col("n")), F.col("top"), winner).alias("share"))


def wards_and_frame(c: Contests) -> tuple[DataFrame, DataFrame]:
    """Towns' people by seat, of which those from number 12 on are split between seats, and the seats' electors."""
    t = F.expr("(code div 6) % 24")
    units = c.units.withColumn("town", F.when(F.col("n") >= 5, t % 12).otherwise(t).cast("int"))
    wards = units.groupBy("s", "town", "n").agg(F.sum("pop").cast("double").alias("weight"), F.sum("pop").cast("double").alias("pop"))
    return wards.withColumn("split", F.col("town") >= 12), c.frame

# Contests, candidates and history.
register("contest_resolution", lambda c: c.seats.select(*SEAT, "j", "c", "r", "p", "a", "v", "q", "m", "t", "total", "wv"), "SELECT arena, s, y, n, j, c, r, p, a, round(v, 6) AS v, q, round(m, 6) AS m, t, total, wv FROM seats")
register("top_candidates", lambda c: resolve.top_candidates(c.cand), "SELECT arena, s, y, n, p, votes, rank, round(share, 6) AS share FROM ranked WHERE rank <= 5")
register("candidate_gaps", lambda c: resolve.candidate_gaps(c.cand), "SELECT arena, s, y, n, p, rank, top - votes AS behind, votes - qv AS ahead, round(CAST(votes - qv AS DOUBLE) * 100 / total, 6) AS ahead_pct FROM ranked")
register("active_snapshot", lambda c: c.active.select(*SEAT, "p", "m"), "SELECT arena, s, y, n, p, round(m, 6) AS m FROM act")
register("seat_history", lambda c: c.history.select(*PLACE, "y", "p", "prev_y", "prev_p", "status"), "SELECT arena, s, j, y, p, prev_y, prev_p, status FROM prev")
register("seat_changes", lambda c: c.changed.select(*PLACE, "y", "p", "prev_p", "status", "prev_m"), "SELECT arena, s, j, y, p, prev_p, status, round(prev_m, 6) AS prev_m FROM chg")
register("fortress_streaks", lambda c: resolve.streaks(c.seats), "SELECT arena, s, j, max(p) AS p, count(*) AS wins, min(y) AS since FROM (SELECT *, max(island) OVER (PARTITION BY arena, s, j) AS last FROM (SELECT *, sum(CASE WHEN status = 'held' THEN 0 ELSE 1 END) OVER (PARTITION BY arena, s, j ORDER BY y) AS island FROM prev)) WHERE island = last GROUP BY arena, s, j HAVING count(*) >= 3")
register("churn_seats", lambda c: resolve.churn(c.seats), "SELECT arena, s, j, count(*) FILTER (status IN ('held', 'flipped')) AS pairs, count(*) FILTER (status = 'flipped') AS flips FROM prev GROUP BY ALL HAVING pairs >= 2 AND flips >= 2")
register("stronghold_classes", lambda c: resolve.stronghold_classes(c.seats), """, recent AS (SELECT * FROM (SELECT *, max(y) OVER (PARTITION BY arena, s) AS last FROM seats) WHERE NOT (arena = 'AE' AND s IN ('NATION_5', 'NATION_9') AND (y < 1998) <> (last < 1998))),
best AS (SELECT arena, s, j, p, count(*) AS wins, CAST(sum(count(*)) OVER (PARTITION BY arena, s, j) AS BIGINT) AS total FROM recent GROUP BY arena, s, j, p QUALIFY row_number() OVER (PARTITION BY arena, s, j ORDER BY count(*) DESC, p) = 1)
SELECT arena, s, j, CASE WHEN class <> 'swing' THEN p END AS p, wins, total, class FROM (SELECT *, CASE WHEN total >= 2 AND wins = total THEN 'safe' WHEN wins >= 0.6 * total THEN 'lean' ELSE 'swing' END AS class FROM best)""")
register("eroding_seats", lambda c: resolve.eroding(c.seats), "SELECT arena, s, j, y, p, round(m1 - m, 6) AS lost FROM (SELECT *, lag(p, 1) OVER w AS p1, lag(p, 2) OVER w AS p2, lag(m, 1) OVER w AS m1, lead(y) OVER w AS later FROM seats WINDOW w AS (PARTITION BY arena, s, j ORDER BY y)) WHERE later IS NULL AND p = p1 AND p = p2 AND m1 - m > 5")
register("seat_biographies", lambda c: resolve.biographies(c.seats), "SELECT arena, s, j, count(*) AS elections, count(DISTINCT p) AS winners, count(*) FILTER (status = 'flipped') AS flips, count(*) FILTER (status = 'held') AS holds, round(min(m), 6) AS closest, round(max(m), 6) AS safest, round(avg(m), 6) AS mean_margin, round(avg(t), 6) AS mean_turnout, round(avg(v + (v - m)), 6) AS bipolarity FROM prev GROUP BY ALL")

# Roll-ups.
register("tally_active", lambda c: rollup.tally(c.active, "arena", "p"), "SELECT arena, p, count(*) AS seats FROM act GROUP BY ALL")
register("tally_by_state", lambda c: rollup.tally(c.active, "arena", "s", "p"), "SELECT arena, s, p, count(*) AS seats FROM act GROUP BY ALL")
register("tally_by_alliance", lambda c: rollup.tally(c.active.withColumn("base", canon.alliance_base(F.col("a"))), "arena", "base"), "SELECT arena, regexp_replace(a, ' \\(.*\\)$', '') AS base, count(*) AS seats FROM act GROUP BY ALL")
register("presence_ranking", lambda c: rollup.presence(c.active), "SELECT arena, p, weight, row_number() OVER (PARTITION BY arena ORDER BY weight DESC, p) AS rank FROM (SELECT arena, p, round(sum(CASE WHEN role = 'won' THEN 1.0 ELSE 0.4 END), 6)::DOUBLE AS weight FROM roles GROUP BY ALL)")
register("party_summary", lambda c: c.summary, "SELECT arena, s, y, p, f, wo, votes, round(v, 6) AS v FROM summ")
register("national_summary", lambda c: c.national, "SELECT arena, y, p, f, wo, votes, round(v, 6) AS v FROM nat")
register("alliance_summary", lambda c: rollup.alliance_summary(c.national.withColumn("a", canon.alliance_of(F.col("p")))), "SELECT arena, y, CASE WHEN p IN ('STANDARD', 'ECONOMY') THEN 'A Alliance' WHEN p IN ('MEDIUM', 'PROMO') THEN 'B Alliance' ELSE 'Unaligned' END AS a, CAST(sum(f) AS BIGINT) AS f, CAST(sum(wo) AS BIGINT) AS wo, round(sum(v), 6) AS v FROM nat GROUP BY ALL")
register("turnout_series", lambda c: rollup.turnout_series(c.seats), "SELECT arena, y, round(avg(t), 6) AS t, round(avg(t) - lag(avg(t)) OVER (PARTITION BY arena ORDER BY y), 6) AS delta FROM seats GROUP BY arena, y")
register("weighted_turnout", lambda c: rollup.weighted_turnout(c.seats), "SELECT arena, y, round(sum(t * w) / sum(w), 6) AS t FROM (SELECT arena, y, s, avg(t) AS t, count(*) AS w FROM seats GROUP BY ALL) GROUP BY ALL")
register("retention_matrix", lambda c: rollup.retention(c.changed), ", kept AS (SELECT arena, prev_p FROM comp GROUP BY arena, prev_p QUALIFY row_number() OVER (PARTITION BY arena ORDER BY count(*) DESC, prev_p) <= 9) SELECT c.arena, coalesce(k.prev_p, 'Other') AS was, c.p AS now, count(*) AS seats FROM comp c LEFT JOIN kept k ON c.arena = k.arena AND c.prev_p = k.prev_p GROUP BY ALL")
NET = ", net AS (SELECT arena{0}, p, CAST(sum(now) AS BIGINT) AS now, CAST(sum(before) AS BIGINT) AS before, CAST(sum(now - before) AS BIGINT) AS net FROM (SELECT arena, s, p, 1 AS now, 0 AS before FROM comp UNION ALL SELECT arena, s, prev_p, 0, 1 FROM comp) GROUP BY ALL)"
register("net_change", lambda c: rollup.net_change(c.changed, "arena"), NET.format("") + " SELECT * FROM net")
register("net_change_by_state", lambda c: rollup.net_change(c.changed, "arena", "s"), NET.format(", s") + " SELECT * FROM net")
register("net_extremes", lambda c: rollup.extremes(rollup.net_change(c.changed, "arena")), NET.format("") + " SELECT * FROM net QUALIFY row_number() OVER (PARTITION BY arena ORDER BY net DESC, p) <= 7 OR row_number() OVER (PARTITION BY arena ORDER BY net, p) <= 7")
register("flow_drill", lambda c: rollup.flows(c.changed), "SELECT arena, s, prev_p AS was, p AS now, count(*) AS seats FROM chg WHERE status = 'flipped' GROUP BY ALL")
register("status_counts", lambda c: rollup.tally(c.changed, "arena", "status"), "SELECT arena, status, count(*) AS seats FROM chg GROUP BY ALL")
RIVALS = "SELECT arena, least(p, q) AS p1, greatest(p, q) AS p2, count(*) AS met, count(*) FILTER (p <= q) AS wins1, count(*) FILTER (p > q) AS wins2 FROM act WHERE q IS NOT NULL{} GROUP BY ALL"
register("rivalry_matrix", lambda c: rollup.rivalries(c.active), RIVALS.format(""))
register("close_battlegrounds", lambda c: rollup.rivalries(c.active, F.col("m") < 5), RIVALS.format(" AND m < 5"))
register("reservation_breakdown", lambda c: rollup.by_reservation(c.seats), "SELECT arena, y, p, count(*) FILTER (r = 'GEN') AS \"GEN\", count(*) FILTER (r = 'SC') AS \"SC\", count(*) FILTER (r = 'ST') AS \"ST\" FROM seats GROUP BY ALL")
register("vote_seat_gap", lambda c: rollup.efficiency(c.national), "SELECT arena, p, round(avg(ss - v), 6) AS gap, count(*) AS elections FROM (SELECT *, CAST(wo AS DOUBLE) * 100 / sum(wo) OVER (PARTITION BY arena, y) AS ss FROM nat) WHERE v >= 4 GROUP BY ALL HAVING count(*) >= 2")
register("strike_rates", lambda c: rollup.strike_rates(c.national), "SELECT arena, y, p, CAST(floor(CAST(wo AS DOUBLE) * 100 / f + 0.5) AS BIGINT) AS strike FROM nat")
register("states_at_a_glance", lambda c: rollup.glance(c.active), """, led AS (SELECT arena, s, max(p) FILTER (rn = 1) AS leader, max(won) FILTER (rn = 1) AS won, max(p) FILTER (rn = 2) AS second, coalesce(max(won) FILTER (rn = 2), 0) AS second_won, count(*) AS parties FROM wins GROUP BY ALL)
SELECT led.*, seats, close, t, won - second_won AS gap, CAST(floor(seats / 2) AS BIGINT) + 1 AS majority FROM led JOIN (SELECT arena, s, count(*) AS seats, count(*) FILTER (m < 5) AS close, round(avg(t), 6) AS t FROM act GROUP BY ALL) USING (arena, s)""")
register("states_led", lambda c: rollup.states_led(c.active), "SELECT arena, p, count(*) AS states FROM wins WHERE rn = 1 GROUP BY ALL")
register("alliance_pooling", lambda c: rollup.pooled(c.cand.withColumn("a", canon.alliance_of(F.col("p")))), """, g AS (SELECT *, CASE WHEN p IN ('STANDARD', 'ECONOMY') THEN 'A Alliance' WHEN p IN ('MEDIUM', 'PROMO') THEN 'B Alliance' ELSE p END AS g FROM ranked),
sums AS (SELECT arena, s, y, n, g, sum(votes) AS votes, count(DISTINCT p) AS parties, row_number() OVER (PARTITION BY arena, s, y, n ORDER BY sum(votes) DESC, g) AS rn FROM g GROUP BY arena, s, y, n, g),
cnt AS (SELECT arena, s, y, g, CAST(sum(a) AS BIGINT) AS actual, CAST(sum(b) AS BIGINT) AS pooled, CAST(sum(ff) AS BIGINT) AS ff FROM (SELECT arena, s, y, g, 1 AS a, 0 AS b, 0 AS ff FROM g WHERE rank = 1 UNION ALL SELECT arena, s, y, g, 0, 1, 0 FROM sums WHERE rn = 1 UNION ALL SELECT arena, s, y, g, 0, 0, 1 FROM sums WHERE parties >= 2) WHERE g LIKE '%Alliance' GROUP BY ALL)
SELECT * FROM cnt WHERE ff > 0 OR actual <> pooled""")
register("bypoll_kpis", lambda c: c.bypolls.groupBy("arena").agg(F.count(F.lit(1)).alias("total"), F.count("ret").alias("judged"), F.count_if(F.col("ret") == "Y").alias("held")), "SELECT arena, count(*) AS total, count(ret) AS judged, count(*) FILTER (ret = 'Y') AS held FROM byp GROUP BY ALL")
register("bypoll_ledger", lambda c: rollup.bypoll_ledger(c.bypolls), "SELECT p, defended, held, gained, round(CASE WHEN defended > 0 THEN CAST(held AS DOUBLE) * 100 / defended END, 6) AS rate FROM (SELECT p, CAST(sum(d) AS BIGINT) AS defended, CAST(sum(h) AS BIGINT) AS held, CAST(sum(g) AS BIGINT) AS gained FROM (SELECT prev AS p, 1 AS d, CAST(ret = 'Y' AS INTEGER) AS h, 0 AS g FROM byp WHERE ret IS NOT NULL UNION ALL SELECT p, 0, 0, CAST(ret = 'N' AS INTEGER) FROM byp WHERE ret IS NOT NULL) GROUP BY ALL) WHERE defended + gained >= 5")
register("bypoll_timeline", lambda c: c.bypolls.where("ret is not null").select("arena", "s", "n", "p", (F.col("y") + (F.col("mo") - 0.5) / 12).alias("at")), "SELECT arena, s, n, p, round(y + CAST(mo - 0.5 AS DOUBLE) / 12, 6) AS at FROM byp WHERE ret IS NOT NULL")
register("parent_composition", lambda c: rollup.composition(c.seats, c.parents), "SELECT arena, pc, y, p, won, \"of\" FROM (SELECT arena, pc, y, p, count(*) AS won, CAST(sum(count(*)) OVER (PARTITION BY arena, pc, y) AS BIGINT) AS \"of\", row_number() OVER (PARTITION BY arena, pc, y ORDER BY count(*) DESC, p) AS rn FROM seats JOIN par USING (s) GROUP BY arena, pc, y, p) WHERE rn = 1")
register("gap_audit", lambda c: rollup.missing_shares(c.seats), "SELECT arena, s, y, round(CAST(count(*) FILTER (m IS NULL) AS DOUBLE) * 100 / count(*), 6) AS no_margin, round(CAST(count(*) FILTER (q IS NULL) AS DOUBLE) * 100 / count(*), 6) AS no_second, count(m) = 0 AS winners_only FROM seats GROUP BY ALL")
register("margin_bands", lambda c: c.active.groupBy("arena", canon.band(F.col("m"), canon.MARGIN_BANDS).alias("band"), canon.safety(F.col("m")).alias("safety")).agg(F.count(F.lit(1)).alias("seats")), "SELECT arena, CASE WHEN m IS NOT NULL THEN CAST(m >= 2 AS INTEGER) + CAST(m >= 5 AS INTEGER) + CAST(m >= 10 AS INTEGER) + CAST(m >= 20 AS INTEGER) END AS band, CASE WHEN m IS NULL THEN 'Unknown' WHEN m >= 15 THEN 'Safe' WHEN m >= 5 THEN 'Lean' ELSE 'Marginal' END AS safety, count(*) AS seats FROM act GROUP BY ALL")
register("lost_deposits", lambda c: resolve.ranked(c.cand).where(canon.lost_deposit(F.col("share"))).groupBy("arena", "y", "p").agg(F.count(F.lit(1)).alias("lost")), "SELECT arena, y, p, count(*) AS lost FROM ranked WHERE share < 100.0 / 6 GROUP BY ALL")
register("closeness_rank", lambda c: c.seats.where("m is not null").select(*SEAT, F.rank().over(resolve.Window.partitionBy("arena", "s", "y").orderBy("m")).alias("rank"), F.count(F.lit(1)).over(resolve.Window.partitionBy("arena", "s", "y")).alias("of")).where("of >= 4"), "SELECT arena, s, y, n, rank, \"of\" FROM (SELECT *, rank() OVER (PARTITION BY arena, s, y ORDER BY m) AS rank, count(*) OVER (PARTITION BY arena, s, y) AS \"of\" FROM seats WHERE m IS NOT NULL) WHERE \"of\" >= 4")

# Trends, swings and what-ifs.
register("party_swing", lambda c: project.swing(c.summary, YEAR, BEFORE), "SELECT a.arena, a.s, a.p, round(a.v, 6) AS now, round(b.v, 6) AS then, round(a.v - b.v, 6) AS swing FROM summ a JOIN summ b ON a.arena = b.arena AND a.s = b.s AND a.p = b.p AND a.y = 2000 AND b.y = 1999 WHERE a.v >= 1 OR b.v >= 1")
register("pedersen_volatility", lambda c: project.pedersen(c.summary), """, prs AS (SELECT arena, s, y, lag(y) OVER (PARTITION BY arena, s ORDER BY y) AS before FROM (SELECT DISTINCT arena, s, y FROM summ))
SELECT arena, s, y, round(sum(abs(d)) / 2, 6) AS volatility FROM (SELECT arena, s, y, p, sum(d) AS d FROM (SELECT x.arena, x.s, x.y, p, v AS d FROM prs x JOIN summ u ON x.arena = u.arena AND x.s = u.s AND x.y = u.y WHERE before IS NOT NULL UNION ALL SELECT x.arena, x.s, x.y, p, -v FROM prs x JOIN summ u ON x.arena = u.arena AND x.s = u.s AND x.before = u.y) GROUP BY ALL) GROUP BY ALL""")
TREND = """, yrs AS (SELECT arena, y, CAST(row_number() OVER (PARTITION BY arena ORDER BY y) - 1 AS DOUBLE) AS x FROM (SELECT DISTINCT arena, y FROM nat)),
fit AS (SELECT arena, p, regr_slope(v, x) AS slope, regr_intercept(v, x) AS intercept, count(v) AS points, regr_sxy(v, x) AS sxy, regr_sxx(v, x) AS sxx, regr_syy(v, x) AS syy FROM nat JOIN yrs USING (arena, y) GROUP BY ALL HAVING count(v) >= 3)
"""
register("linear_trends", lambda c: project.linear_trends(c.national), TREND + "SELECT arena, p, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(CASE WHEN syy = 0 THEN 0 ELSE greatest(0, sxy * sxy / (sxx * syy)) END, 6) AS r2, round(least(100, greatest(0, intercept + slope * (SELECT max(x) + 1 FROM yrs WHERE yrs.arena = fit.arena))), 6) AS projected, points FROM fit")
register("momentum", lambda c: project.momentum(project.linear_trends(c.national), 0.01), TREND + "SELECT arena, p, round(slope, 6) AS slope, way FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY arena ORDER BY slope DESC, p) = 1 AND slope > 0.01 THEN 'rising' WHEN row_number() OVER (PARTITION BY arena ORDER BY slope, p) = 1 AND slope < -0.01 THEN 'falling' END AS way FROM fit) WHERE way IS NOT NULL")
CURVE = ", curve AS (SELECT arena, p, pp, count(*) FILTER (role = 'won') + count(*) FILTER (role = 'second' AND pp > 0 AND m < 2 * pp) - count(*) FILTER (role = 'won' AND pp < 0 AND m < -2 * pp) AS seats FROM roles, (SELECT CAST(i * {0} AS DOUBLE) AS pp FROM range(-{1}, {1} + 1) t(i)) GROUP BY ALL)"
register("seat_curve", lambda c: project.seat_curve(c.active), CURVE.format("0.5", 24) + " SELECT arena, p, pp, seats FROM curve")
register("swing_to_majority", lambda c: project.swing_to_majority(c.active), CURVE.format("0.25", 48) + " SELECT arena, p, coalesce(min(pp) FILTER (seats >= majority), 12.0) AS pp, max(seats) < max(majority) AS capped FROM curve JOIN house USING (arena) GROUP BY ALL")
register("swingometer", lambda c: project.swingometer(c.active, 3.0), "SELECT arena, p, q, count(*) AS flips, round(min(m), 6) AS closest FROM act WHERE q IS NOT NULL AND m < 6 GROUP BY ALL")
register("tipping_seats", lambda c: project.tipping_seats(c.active), ", base AS (SELECT arena, p, count(*) FILTER (role = 'won') AS base FROM roles GROUP BY ALL), losses AS (SELECT arena, p, s, j, m, row_number() OVER (PARTITION BY arena, p ORDER BY m, s, j) AS nth FROM roles WHERE role = 'second' AND m IS NOT NULL) SELECT arena, p, s, j, round(m, 6) AS m, nth FROM losses JOIN base USING (arena, p) JOIN house USING (arena) WHERE nth = majority - base")
register("alliance_what_if", lambda c: project.alliance_what_if(c.active, BLOC, c.summary.where(F.col("y") == YEAR)), """, bs AS (SELECT arena, s, sum(v) AS bloc_share FROM summ WHERE y = 2000 AND p IN ('STANDARD', 'ECONOMY') GROUP BY ALL),
x AS (SELECT a.arena, a.p IN ('STANDARD', 'ECONOMY') AS won, coalesce(a.q IN ('STANDARD', 'ECONOMY'), false) AS second, bloc_share - u.v >= a.m AS reach FROM act a LEFT JOIN bs ON a.arena = bs.arena AND a.s = bs.s LEFT JOIN summ u ON u.arena = a.arena AND u.s = a.s AND u.p = a.q AND u.y = 2000)
SELECT arena, count(*) FILTER (won) AS now, count(*) FILTER (won AND second) AS friendly, count(*) FILTER (second AND NOT won) AS contestable, count(*) FILTER (second AND NOT won AND reach) AS gains, count(*) FILTER (won) + count(*) FILTER (second AND NOT won AND reach) AS projected FROM x GROUP BY ALL""")
register("majority_cushion", lambda c: project.majority_cushion(c.active), """, b AS (SELECT *, regexp_replace(a, ' \\(.*\\)$', '') AS b FROM act), led AS (SELECT arena, b, count(*) AS won FROM b WHERE b <> 'Unaligned' GROUP BY arena, b QUALIFY row_number() OVER (PARTITION BY arena ORDER BY count(*) DESC, b) = 1)
SELECT arena, b AS alliance, won, won - majority AS cushion, round(m, 6) AS pivot FROM (SELECT *, row_number() OVER (PARTITION BY arena, b ORDER BY m NULLS LAST, s, j) AS nth FROM b JOIN led USING (arena, b) JOIN house USING (arena)) WHERE nth = greatest(1, least(won, won - majority + 1))""")
register("decisive_swing", lambda c: project.decisive_swing(c.active), """, two AS (SELECT arena, s, max(p) FILTER (rn = 1) AS leader, max(p) FILTER (rn = 2) AS next, max(won) AS ahead, min(won) AS behind FROM wins WHERE rn <= 2 GROUP BY ALL HAVING max(rn) = 2),
tried AS (SELECT arena, s, leader, next, pp, ahead, behind, count(*) FILTER (p = leader AND q = next AND m < 2 * pp) AS x FROM act JOIN two USING (arena, s), (SELECT CAST(i * 0.5 AS DOUBLE) AS pp FROM range(1, 25) t(i)) GROUP BY ALL)
SELECT arena, s, leader, next, min(pp) FILTER (behind + x > ahead - x) AS pp FROM tried GROUP BY ALL""")

# Detectors, boards and scorecards.
register("thin_book", lambda c: signals.thin_book(c.active), "SELECT arena, p, count(*) AS wins, count(*) FILTER (m < 5) AS thin, round(CAST(count(*) FILTER (m < 5) AS DOUBLE) * 100 / count(*), 6) AS pct FROM act GROUP BY ALL HAVING count(*) >= 5")
register("shallow_wins", lambda c: signals.shallow_wins(c.active), "SELECT arena, p, wins, shallow, round(pct, 6) AS pct FROM (SELECT arena, p, count(*) AS wins, count(*) FILTER (m < 3) AS shallow, CAST(count(*) FILTER (m < 3) AS DOUBLE) * 100 / count(*) AS pct FROM act GROUP BY ALL) WHERE wins >= 10 AND pct >= 12")
register("minority_wins", lambda c: signals.minority_wins(c.active), "SELECT arena, p, count(*) AS wins, max(o) AS \"of\" FROM (SELECT *, count(*) OVER (PARTITION BY arena) AS o FROM act WHERE v IS NOT NULL) WHERE v < 40 GROUP BY ALL")
register("flip_concentration", lambda c: signals.flip_concentration(c.changed), "SELECT arena, s, flips, rank, round(CAST(flips AS DOUBLE) * 100 / total, 6) AS pct FROM (SELECT arena, s, count(*) AS flips, sum(count(*)) OVER (PARTITION BY arena) AS total, row_number() OVER (PARTITION BY arena ORDER BY count(*) DESC, s) AS rank FROM chg WHERE status = 'flipped' GROUP BY arena, s) WHERE rank <= 3")
register("worst_defence", lambda c: signals.worst_defence(c.changed), "SELECT arena, p, had, kept, round(pct, 6) AS pct FROM (SELECT *, row_number() OVER (PARTITION BY arena ORDER BY pct, p) AS rn FROM (SELECT arena, prev_p AS p, count(*) AS had, count(*) FILTER (status = 'held') AS kept, CAST(count(*) FILTER (status = 'held') AS DOUBLE) * 100 / count(*) AS pct FROM comp GROUP BY ALL HAVING count(*) >= 5)) WHERE rn = 1")
register("efficiency_gap", lambda c: signals.efficiency_gap(c.national, YEAR), "SELECT arena, p, round(v, 6) AS v, round(ss, 6) AS ss, round(ss - v, 6) AS gap, CASE WHEN ss - v >= 4 THEN 'over' WHEN ss - v <= -4 THEN 'under' ELSE 'fair' END AS tone FROM (SELECT *, CAST(wo AS DOUBLE) * 100 / sum(wo) OVER (PARTITION BY arena) AS ss FROM nat WHERE y = 2000 AND v >= 2)")
register("reservation_skew", lambda c: signals.reservation_skew(c.active), ", led AS (SELECT arena, p AS leader FROM act GROUP BY arena, p QUALIFY row_number() OVER (PARTITION BY arena ORDER BY count(*) DESC, p) = 1) SELECT arena, leader, r AS cat, count(*) AS \"of\", count(*) FILTER (p = leader) AS won, round(CAST(count(*) FILTER (p = leader) AS DOUBLE) * 100 / count(*), 6) AS rate FROM act JOIN led USING (arena) GROUP BY ALL HAVING count(*) >= 3")
CARDS = """, won AS (SELECT arena, p, count(*) AS won, avg(m) AS mean_margin, count(*) FILTER (m >= 10) AS safe, count(*) FILTER (m < 5) AS thin, count(*) FILTER (v < 40) AS sub40 FROM act GROUP BY ALL), lost AS (SELECT arena, q AS p, count(*) AS second, count(*) FILTER (m < 10) AS targets, count(*) FILTER (m < 5) AS close_targets FROM act WHERE q IS NOT NULL GROUP BY ALL),
cards AS (SELECT *, CAST(won AS DOUBLE) * 100 / (won + second) AS strike FROM (SELECT arena, p, mean_margin, coalesce(won, 0) AS won, coalesce(safe, 0) AS safe, coalesce(thin, 0) AS thin, coalesce(sub40, 0) AS sub40, coalesce(second, 0) AS second, coalesce(targets, 0) AS targets, coalesce(close_targets, 0) AS close_targets FROM won FULL JOIN lost USING (arena, p)))
"""
register("party_scorecards", lambda c: signals.scorecards(c.active), CARDS + "SELECT arena, p, round(mean_margin, 6) AS mean_margin, won, safe, thin, sub40, second, targets, close_targets, round(strike, 6) AS strike FROM cards")
register("party_swot", lambda c: signals.swot(signals.scorecards(c.active)), CARDS + "SELECT arena, p, kind, rule, row_number() OVER (PARTITION BY arena, p, kind ORDER BY nth) AS rank FROM (" + " UNION ALL ".join(f"SELECT arena, p, '{k}' AS kind, {i} AS nth, '{t}' AS rule FROM cards WHERE {e}" for i, (k, t, e) in enumerate(signals.RULES)) + ")")
register("attack_board", lambda c: signals.board(c.active, c.history, c.bypolls), """, lastby AS (SELECT arena, s, n, y AS by_y, p AS by_p FROM byp QUALIFY row_number() OVER (PARTITION BY arena, s, n ORDER BY y DESC) = 1)
SELECT a.arena, a.s, a.j, a.y, a.p, a.q, round(a.m, 6) AS m, CAST(floor((10.0::DOUBLE - a.m) / 10 * 50 + 0.5) AS BIGINT) + CASE WHEN a.m < h.prev_m THEN 20 ELSE 0 END + CASE WHEN by_y >= a.y AND by_p <> a.p THEN 15 ELSE 0 END AS score, a.v < 40 AS sub40 FROM act a JOIN prev h ON a.arena = h.arena AND a.s = h.s AND a.j = h.j AND a.y = h.y LEFT JOIN lastby b ON a.arena = b.arena AND a.s = b.s AND a.n = b.n WHERE a.m < 10""")
register("head_to_head", lambda c: signals.head_to_head(c.active, "STANDARD", "MEDIUM"), "SELECT arena, s, count(*) FILTER (p = 'STANDARD') AS wins, count(*) FILTER (p = 'MEDIUM') AS losses FROM act WHERE (p = 'STANDARD' AND q = 'MEDIUM') OR (p = 'MEDIUM' AND q = 'STANDARD') GROUP BY ALL")
register("challengers", lambda c: signals.challengers(c.active), "SELECT arena, s, p, q, met FROM (SELECT a.arena, a.s, a.p, a.q, count(*) AS met, row_number() OVER (PARTITION BY a.arena, a.s ORDER BY count(*) DESC, a.q) AS rn FROM act a JOIN wins w ON a.arena = w.arena AND a.s = w.s AND a.p = w.p AND w.rn = 1 WHERE a.q IS NOT NULL GROUP BY a.arena, a.s, a.p, a.q) WHERE rn = 1")
register("party_scoreboard", lambda c: signals.scoreboard(c.active, F.lit("STANDARD")), "SELECT arena, s, j, CASE WHEN p = 'STANDARD' THEN 'won' WHEN q = 'STANDARD' THEN 'second' ELSE 'out' END AS place, round(CASE WHEN p = 'STANDARD' THEN v WHEN q = 'STANDARD' THEN v - m END, 6) AS share FROM act")

# Gates, merges and apportionment.
register("allow_list_gate", lambda c: merge.gated(c.bypolls, c.active, ["arena", "s", "y"]).select(*SEAT, "p"), "SELECT arena, s, y, n, p FROM byp SEMI JOIN act USING (arena, s, y)")
register("allow_list_skipped", lambda c: merge.skipped(c.bypolls, c.active, ["arena", "s", "y"]), "SELECT arena, s, y, count(*) AS skipped FROM byp ANTI JOIN act USING (arena, s, y) GROUP BY ALL")
register("base_wins_merge", lambda c: merge.base_wins(c.bypolls.where("n < 3").select(*SEAT, "p"), c.seats.select(*SEAT, "p"), ["arena", "s", "y", "n"]), "SELECT arena, s, y, n, p FROM byp WHERE n < 3 UNION ALL SELECT arena, s, y, n, p FROM seats ANTI JOIN (SELECT * FROM byp WHERE n < 3) USING (arena, s, y, n)")
register("winner_agreement_gate", lambda c: merge.agreeing_elections(c.bypolls, c.seats, 0.5), "SELECT arena, s, y, round(avg(CAST(b.p = x.p AS DOUBLE)), 6) AS agree FROM byp b JOIN seats x USING (arena, s, y, n) GROUP BY ALL HAVING avg(CAST(b.p = x.p AS DOUBLE)) >= 0.5")
register("complete_elections", lambda c: merge.complete_elections(c.cand, c.seats), "SELECT arena, s, y, seen, rows, due FROM (SELECT arena, s, y, count(DISTINCT n) AS seen, count(*) AS rows FROM cand GROUP BY ALL) JOIN (SELECT arena, s, y, count(*) AS due FROM seats GROUP BY ALL) USING (arena, s, y) WHERE seen >= 0.98 * due AND rows >= 3.0 * seen")
register("electors_checked", lambda c: merge.checked_electors(c.electors), ", ok AS (SELECT *, abs(men + women - e) <= greatest(50.0, 0.005 * e) AS adds FROM el WHERE e > 0 AND voters <= 1.02 * e) SELECT arena, s, y, n, e, voters, CASE WHEN adds THEN men END AS men, CASE WHEN adds THEN women END AS women FROM ok")
register("electorate_growth", lambda c: project.electorate_growth(c.electors), "SELECT arena, s, j, y, CASE WHEN NOT (arena = 'AE' AND s IN ('NATION_5', 'NATION_9') AND (before < 1998) <> (y < 1998)) THEN round(CAST(e - was AS DOUBLE) * 100 / was, 6) END AS growth, round(CAST(women * 10 AS DOUBLE) * 100 / nullif(men, 0), 6) AS women_per_thousand FROM (SELECT *, lag(e) OVER w AS was, lag(y) OVER w AS before FROM el WINDOW w AS (PARTITION BY arena, s, j ORDER BY y))")
register("split_tickets", lambda c: merge.split_tickets(resolve.ranked(c.cand).where("arena = 'GE'"), resolve.ranked(c.cand).where("arena = 'AE'"), merge.nearest_year(c.seats.where("arena = 'GE'"), c.seats.where("arena = 'AE'"), ["s"])), """, ny AS (SELECT g.s, g.y, a.y AS ay FROM (SELECT DISTINCT s, y FROM seats WHERE arena = 'GE') g JOIN (SELECT DISTINCT s, y FROM seats WHERE arena = 'AE') a ON g.s = a.s QUALIFY row_number() OVER (PARTITION BY g.s, g.y ORDER BY abs(g.y - a.y), a.y) = 1)
SELECT * FROM (SELECT g.s, g.y, ny.ay, g.n, g.p, round(g.share, 6) AS gv, round(a.share, 6) AS av, row_number() OVER (PARTITION BY g.s, g.y, g.n ORDER BY g.share DESC, g.p) AS rank FROM ranked g JOIN ny ON g.s = ny.s AND g.y = ny.y JOIN ranked a ON a.arena = 'AE' AND a.s = g.s AND a.y = ny.ay AND a.n = g.n AND a.p = g.p WHERE g.arena = 'GE' AND greatest(g.share, a.share) >= 5) WHERE rank <= 6""")

# Row functions, on the texts that the tables have.
register("number_parsing", lambda c: source.table(c.spark, c.sf_dir, "part").select("p_partkey", canon.lenient_number(F.substring_index("p_name", " ", -1)).alias("lenient"), canon.lenient_number(F.col("p_retailprice").cast("string"), 0).alias("whole"), canon.tolerant_number(F.when(F.col("p_size") % 7 == 0, "NA").otherwise(F.concat(F.lit("1,"), F.lpad(F.col("p_size").cast("string"), 3, "0")))).alias("tolerant")), "SELECT p_partkey, round(TRY_CAST(split_part(p_name, ' ', -1) AS DOUBLE), 2) AS lenient, CAST(trunc(p_retailprice) AS BIGINT) AS whole, CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST('1' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS BIGINT) END AS tolerant FROM part")
register("seat_names", lambda c: c.seats.select(*SEAT, canon.seat_key(F.concat("c", F.lit(" and "), "s", F.lit(" ("), "r", F.lit(")"))).alias("key"), canon.padded_code(F.col("n"), 4).alias("code"), canon.reservation_category(F.col("r")).alias("cat")), "SELECT arena, s, y, n, regexp_replace(upper(c) || '&' || upper(s), '[^A-Z0-9]', '', 'g') AS key, lpad(CAST(n AS VARCHAR), 4, '0') AS code, r AS cat FROM seats")
register("party_names", lambda c: source.table(c.spark, c.sf_dir, "part").select("p_partkey", canon.party_name(F.concat(F.lit("  "), "p_type", F.lit("  X [3]"))).alias("name"), canon.is_junk_party(F.when(F.col("p_size") % 5 == 0, "None of the above").otherwise(F.col("p_type"))).alias("junk")), "SELECT p_partkey, p_type || ' X' AS name, p_size % 5 = 0 AS junk FROM part")
register("derived_shares", lambda c: c.active.where("m is not null").select(*PLACE, (F.col("v") - F.col("m")).alias("second"), F.greatest(F.lit(0.0), 100 - F.col("v") - (F.col("v") - F.col("m"))).alias("others"), (F.col("m") / 2).alias("swing_to_flip"), canon.safety(F.col("m")).alias("safety"), canon.band(F.col("t"), canon.TURNOUT_BANDS).alias("turnout_band")), "SELECT arena, s, j, round(v - m, 6) AS second, round(greatest(0.0, 100 - v - (v - m)), 6) AS others, round(m / 2, 6) AS swing_to_flip, CASE WHEN m >= 15 THEN 'Safe' WHEN m >= 5 THEN 'Lean' ELSE 'Marginal' END AS safety, CAST(t >= 55 AS INTEGER) + CAST(t >= 62 AS INTEGER) + CAST(t >= 70 AS INTEGER) + CAST(t >= 78 AS INTEGER) AS turnout_band FROM act WHERE m IS NOT NULL")
register("segment_leaders", lambda c: resolve.ranked(c.cand).where("arena = 'GE' and rank = 1").select("s", "y", "n", "p", F.col("q").alias("trailing"), (F.col("votes") - F.col("qv")).alias("mg"), F.col("total").alias("sv")), "SELECT s, y, n, p, q AS trailing, votes - qv AS mg, total AS sv FROM ranked WHERE arena = 'GE' AND rank = 1")
register("signed_leads", lambda c: c.seats.where("m is not null").select(*PLACE, "y", F.when(F.col("p") == "STANDARD", F.col("m")).when(F.col("q") == "STANDARD", 0 - F.col("m")).alias("lead")).where("lead is not null").groupBy(*PLACE).agg(F.count(F.lit(1)).alias("points"), F.max_by("lead", "y").alias("last"), F.min_by("lead", "y").alias("first")).where("points >= 2").withColumn("trend", F.when(F.col("last") > F.col("first"), "rising").when(F.col("last") < F.col("first"), "falling").otherwise("flat")), "SELECT arena, s, j, count(*) AS points, round(max_by(lead, y), 6) AS last, round(min_by(lead, y), 6) AS first, CASE WHEN max_by(lead, y) > min_by(lead, y) THEN 'rising' WHEN max_by(lead, y) < min_by(lead, y) THEN 'falling' ELSE 'flat' END AS trend FROM (SELECT arena, s, j, y, CASE WHEN p = 'STANDARD' THEN m WHEN q = 'STANDARD' THEN 0 - m END AS lead FROM seats WHERE m IS NOT NULL) WHERE lead IS NOT NULL GROUP BY ALL HAVING count(*) >= 2")
register("reservation_fill", lambda c: c.seats.groupBy(*PLACE).agg(F.max(F.when(F.col("r") == "SC", 3).when(F.col("r") == "ST", 2).otherwise(0)).alias("k")).select(*PLACE, F.when(F.col("k") == 3, "SC").when(F.col("k") == 2, "ST").otherwise("GEN").alias("r")), "SELECT arena, s, j, CASE max(CASE r WHEN 'SC' THEN 3 WHEN 'ST' THEN 2 ELSE 0 END) WHEN 3 THEN 'SC' WHEN 2 THEN 'ST' ELSE 'GEN' END AS r FROM seats GROUP BY ALL")
register("security_summary", lambda c: resolve.stronghold_classes(c.seats).groupBy("arena", "s").agg(*[F.count_if(F.col("class") == k).alias(k) for k in ("safe", "lean", "swing")]), """, recent AS (SELECT * FROM (SELECT *, max(y) OVER (PARTITION BY arena, s) AS last FROM seats) WHERE NOT (arena = 'AE' AND s IN ('NATION_5', 'NATION_9') AND (y < 1998) <> (last < 1998))),
best AS (SELECT arena, s, j, max(w) AS wins, CAST(sum(w) AS BIGINT) AS total FROM (SELECT arena, s, j, p, count(*) AS w FROM recent GROUP BY ALL) GROUP BY ALL)
SELECT arena, s, count(*) FILTER (total >= 2 AND wins = total) AS safe, count(*) FILTER (NOT (total >= 2 AND wins = total) AND wins >= 0.6 * total) AS lean, count(*) FILTER (NOT (total >= 2 AND wins = total) AND wins < 0.6 * total) AS swing FROM best GROUP BY ALL""")
register("series_by_party", lambda c: c.national.groupBy("arena", "p").pivot("y").agg(F.max("v")), "SELECT arena, p, " + ", ".join(f"round(max(v) FILTER (y = {y}), 6) AS \"{y}\"" for y in range(1995, 2002)) + " FROM nat GROUP BY ALL")
register("signal_board", lambda c: signals.thin_book(c.active).select("arena", F.lit("thin book").alias("signal"), "p", F.col("pct").alias("score")).unionByName(signals.shallow_wins(c.active).select("arena", F.lit("shallow wins").alias("signal"), "p", F.col("pct").alias("score"))).unionByName(signals.worst_defence(c.changed).select("arena", F.lit("worst defence").alias("signal"), "p", (100 - F.col("pct")).alias("score"))), """SELECT arena, 'thin book' AS signal, p, round(CAST(count(*) FILTER (m < 5) AS DOUBLE) * 100 / count(*), 6) AS score FROM act GROUP BY arena, p HAVING count(*) >= 5
UNION ALL SELECT arena, 'shallow wins', p, round(CAST(count(*) FILTER (m < 3) AS DOUBLE) * 100 / count(*), 6) FROM act GROUP BY arena, p HAVING count(*) >= 10 AND CAST(count(*) FILTER (m < 3) AS DOUBLE) * 100 / count(*) >= 12
UNION ALL SELECT arena, 'worst defence', p, round(100 - pct, 6) FROM (SELECT *, row_number() OVER (PARTITION BY arena ORDER BY pct, p) AS rn FROM (SELECT arena, prev_p AS p, CAST(count(*) FILTER (status = 'held') AS DOUBLE) * 100 / count(*) AS pct FROM comp GROUP BY arena, prev_p HAVING count(*) >= 5)) WHERE rn = 1""")
register("parent_of_seat", lambda c: c.seats.join(c.parents, "s", "left").select(*PLACE, F.coalesce("pc", F.lit("Unmapped")).alias("pc")).distinct(), "SELECT DISTINCT arena, s, j, coalesce(pc, 'Unmapped') AS pc FROM seats LEFT JOIN par USING (s)")
register("sides_compared", lambda c: c.active.where("arena = 'AE'").groupBy("p").agg(F.count(F.lit(1)).alias("ae")).join(c.active.where("arena = 'GE'").groupBy("p").agg(F.count(F.lit(1)).alias("ge")), "p", "full").select("p", F.coalesce("ae", F.lit(0)).alias("ae"), F.coalesce("ge", F.lit(0)).alias("ge")), "SELECT p, count(*) FILTER (arena = 'AE') AS ae, count(*) FILTER (arena = 'GE') AS ge FROM act GROUP BY ALL")
register("split_means", lambda c: merge.split_tickets(resolve.ranked(c.cand).where("arena = 'GE'"), resolve.ranked(c.cand).where("arena = 'AE'"), merge.nearest_year(c.seats.where("arena = 'GE'"), c.seats.where("arena = 'AE'"), ["s"])).groupBy("y", "p").agg(F.avg("gv").alias("gv"), F.avg("av").alias("av"), F.avg(F.col("gv") - F.col("av")).alias("gap"), F.count(F.lit(1)).alias("pairs")).where("pairs >= 8"), """, ny AS (SELECT g.s, g.y, a.y AS ay FROM (SELECT DISTINCT s, y FROM seats WHERE arena = 'GE') g JOIN (SELECT DISTINCT s, y FROM seats WHERE arena = 'AE') a ON g.s = a.s QUALIFY row_number() OVER (PARTITION BY g.s, g.y ORDER BY abs(g.y - a.y), a.y) = 1)
SELECT y, p, round(avg(gv), 6) AS gv, round(avg(av), 6) AS av, round(avg(gv - av), 6) AS gap, count(*) AS pairs FROM (SELECT g.s, g.y, g.n, g.p, g.share AS gv, a.share AS av, row_number() OVER (PARTITION BY g.s, g.y, g.n ORDER BY g.share DESC, g.p) AS rank FROM ranked g JOIN ny ON g.s = ny.s AND g.y = ny.y JOIN ranked a ON a.arena = 'AE' AND a.s = g.s AND a.y = ny.ay AND a.n = g.n AND a.p = g.p WHERE g.arena = 'GE' AND greatest(g.share, a.share) >= 5) WHERE rank <= 6 GROUP BY ALL HAVING count(*) >= 8""")

# Small places and their seats.
UNITS = """, u AS (SELECT k AS code, name, s, CAST(k % 4 AS INTEGER) AS district, CAST(k % 24 AS INTEGER) AS town, CAST(1 + k % 6 AS INTEGER) AS n, CASE WHEN k % 3 = 0 THEN 'WARD' ELSE 'VILLAGE' END AS level, pop, CAST(floor(pop / 5) AS BIGINT) AS hh, CAST(floor(pop * (40 + k % 50) / 100) AS BIGINT) AS lit, CAST(floor(pop / 8) AS BIGINT) AS kids, k % 3 = 0 AS urban, CASE WHEN k % 11 <> 0 THEN CAST(k % 101 AS DOUBLE) END AS power
  FROM (SELECT c_custkey AS k, c_name AS name, n_name AS s, 200 + (c_custkey * 37) % 900 AS pop FROM customer JOIN nation ON c_nationkey = n_nationkey)),
prof AS (SELECT s, n, CAST(sum(pop) AS BIGINT) AS pop, CAST(sum(hh) AS BIGINT) AS hh, CAST(sum(lit) AS BIGINT) AS lit, CAST(sum(kids) AS BIGINT) AS kids, CAST(coalesce(sum(pop) FILTER (urban), 0) AS BIGINT) AS urban_pop, sum(power * hh) / sum(hh) FILTER (power IS NOT NULL) AS power FROM u GROUP BY ALL),
rate AS (SELECT s, n, CAST(lit AS DOUBLE) * 100 / (pop - kids) AS literacy, CAST(kids AS DOUBLE) * 100 / pop AS children, CAST(urban_pop AS DOUBLE) * 100 / pop AS urban, CAST(pop AS DOUBLE) / hh AS per_house, power FROM prof),
br0 AS (SELECT s, n, district, CAST(sum(pop) AS DOUBLE) / sum(sum(pop)) OVER (PARTITION BY s, n) AS share FROM u GROUP BY s, n, district),
br AS (SELECT s, n, district, share / sum(share) OVER (PARTITION BY s, n) AS share FROM br0 WHERE share >= 0.03),
frame AS (SELECT s, n, CAST(sum(e) AS BIGINT) AS e FROM el WHERE arena = 'AE' AND y = 1997 GROUP BY ALL)
"""

register("seat_profiles", lambda c: place.profiles(c.units, "s", "n"), UNITS + "SELECT s, n, pop, hh, lit, kids, urban_pop, round(power, 6) AS power FROM prof")
register("seat_rates", lambda c: place.rates(place.profiles(c.units, "s", "n"), "s", "n"), UNITS + "SELECT s, n, round(literacy, 6) AS literacy, round(children, 6) AS children, round(urban, 6) AS urban, round(per_house, 6) AS per_house, round(power, 6) AS power FROM rate")
register("rates_ranked", lambda c: place.ranked_in_pool(place.rates(place.profiles(c.units, "s", "n"), "s", "n"), ["s"], "literacy").select("s", "n", "rank", "of"), UNITS + "SELECT s, n, rank() OVER (PARTITION BY s ORDER BY literacy DESC) AS rank, count(literacy) OVER (PARTITION BY s) AS \"of\" FROM rate QUALIFY count(literacy) OVER (PARTITION BY s) >= 4")
register("district_bridge", lambda c: place.bridge(c.units), UNITS + "SELECT s, n, district, round(share, 6) AS share FROM br")
register("blended_rates", lambda c: place.blended(place.bridge(c.units), place.profiles(c.units, "s", "district").select("s", "district", "power", canon.percent(F.col("lit"), F.col("pop")).alias("literacy")), ["power", "literacy"]), UNITS + ", d AS (SELECT s, district, sum(power * hh) / sum(hh) FILTER (power IS NOT NULL) AS power, CAST(sum(lit) AS DOUBLE) * 100 / sum(pop) AS literacy FROM u GROUP BY ALL) SELECT s, n, round(sum(share * power) / sum(share) FILTER (power IS NOT NULL), 6) AS power, round(sum(share * literacy) / sum(share) FILTER (literacy IS NOT NULL), 6) AS literacy FROM br JOIN d USING (s, district) GROUP BY ALL")
register("district_veto", lambda c: place.vetoed(place.bridge(c.units), F.col("district") >= 2), UNITS + ", v AS (SELECT *, district >= 2 AS ok, bool_or(district >= 2) OVER (PARTITION BY s, n) AS any_ok, row_number() OVER (PARTITION BY s, n ORDER BY share DESC, district) AS nth FROM br) SELECT s, n, district, round(share / sum(share) OVER (PARTITION BY s, n), 6) AS share FROM v WHERE ok OR (NOT any_ok AND nth = 1)")
register("district_owners", lambda c: place.owners(place.bridge(c.units), c.frame), UNITS + "SELECT s, district, n, round(w, 6) AS w FROM (SELECT s, district, n, sum(share * e) AS w, row_number() OVER (PARTITION BY s, district ORDER BY sum(share * e) DESC, n) AS rn FROM br JOIN frame USING (s, n) GROUP BY s, district, n) WHERE rn = 1")
register("tiered_assignment", lambda c: place.placement_report(place.tiered(c.units.select("s", "code", "town", "district", "pop"), c.units.where("code % 5 = 0").select("code", "n"), linkage.unambiguous(c.units.where("code % 5 = 1"), ["s", "town"], "n"), linkage.unambiguous(c.units.where("code % 5 = 2"), ["s", "district"], "n"))), UNITS + """, t AS (SELECT s, town, min(n) AS n FROM u WHERE code % 5 = 1 GROUP BY ALL HAVING count(DISTINCT n) = 1), d AS (SELECT s, district, min(n) AS n FROM u WHERE code % 5 = 2 GROUP BY ALL HAVING count(DISTINCT n) = 1),
p AS (SELECT u.s, pop, CASE WHEN code % 5 = 0 THEN 'code' WHEN t.n IS NOT NULL THEN 'town' WHEN d.n IS NOT NULL THEN 'district' ELSE 'none' END AS method FROM u LEFT JOIN t ON u.s = t.s AND u.town = t.town LEFT JOIN d ON u.s = d.s AND u.district = d.district)
SELECT s, method, count(*) AS units, CAST(sum(pop) AS BIGINT) AS pop, round(CAST(sum(pop) AS DOUBLE) * 100 / sum(sum(pop)) OVER (PARTITION BY s), 6) AS share FROM p GROUP BY s, method""")
register("unit_routes", lambda c: c.units.groupBy("s", place.route(F.col("level"), F.col("town")).alias("route")).agg(F.count(F.lit(1)).alias("units")), UNITS + "SELECT s, CASE WHEN level = 'WARD' AND town < 8 THEN 'town' WHEN level = 'WARD' THEN 'og' ELSE 'village' END AS route, count(*) AS units FROM u GROUP BY ALL")
register("plausibility_gate", lambda c: merge.plausible(place.profiles(c.units, "s", "n").select("s", "n", "pop").join(c.frame, ["s", "n"], "left")), UNITS + """, x AS (SELECT s, n, pop, e, CASE WHEN pop > 0 AND e > 0 THEN CAST(e AS DOUBLE) / pop END AS ratio FROM prof LEFT JOIN frame USING (s, n)), md AS (SELECT s, median(ratio) AS middle FROM x GROUP BY ALL)
SELECT s, n, round(ratio, 6) AS ratio, CASE WHEN coalesce(pop, 0) <= 0 THEN 'no people' WHEN coalesce(e, 0) <= 0 THEN 'no electors' WHEN NOT (ratio BETWEEN 0.6 * middle AND 1.6 * middle) THEN 'implausible' ELSE 'ok' END AS reason FROM x JOIN md USING (s)""")
register("census_reads", lambda c: place.reads(place.rates(place.profiles(c.units, "s", "n"), "s", "n"), place.rates(place.profiles(c.units, "s"), "s")), UNITS + """, st AS (SELECT s, CAST(sum(lit) AS DOUBLE) * 100 / (sum(pop) - sum(kids)) AS literacy, CAST(sum(pop) FILTER (urban) AS DOUBLE) * 100 / sum(pop) AS urban, sum(power * hh) / sum(hh) FILTER (power IS NOT NULL) AS power FROM u GROUP BY ALL),
x AS (SELECT r.s, n, 'literacy' AS field, r.literacy / nullif(st.literacy, 0) AS times FROM rate r JOIN st ON r.s = st.s UNION ALL SELECT r.s, n, 'urban', r.urban / nullif(st.urban, 0) FROM rate r JOIN st ON r.s = st.s UNION ALL SELECT r.s, n, 'power', r.power / nullif(st.power, 0) FROM rate r JOIN st ON r.s = st.s)
SELECT s, n, field, round(times, 6) AS times, row_number() OVER (PARTITION BY s, n ORDER BY round(abs(times - 1), 9) DESC, field) AS rank FROM x WHERE times >= 1.1 OR times <= 0.9 QUALIFY rank <= 2""")

# Linkage, calibration, quality.
register("mutual_best_names", lambda c: linkage.mutual_best(source.table(c.spark, c.sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name")), source.table(c.spark, c.sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.concat(F.lit("Customer"), F.expr("substring(s_name, 9)")).alias("name")), ["k"]), None)
register("name_likeness", lambda c: source.table(c.spark, c.sf_dir, "part").select("p_partkey", linkage.flat(F.col("p_name")).alias("flat"), linkage.likeness(F.col("p_type"), F.col("p_brand")).alias("like")), "SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS flat, round(1 - CAST(levenshtein(p_type, p_brand) AS DOUBLE) / greatest(length(p_type), length(p_brand)), 6) AS \"like\" FROM part")
register("unambiguous_names", lambda c: linkage.unambiguous(c.units, ["s", "town"], "n"), UNITS + "SELECT s, town, min(n) AS n FROM u GROUP BY ALL HAVING count(DISTINCT n) = 1")
register("calibrated_shares", lambda c: calibrate.calibrate(c.units.select(F.concat_ws("/", "s", "town").alias("g"), "code", F.col("pop").cast("double").alias("pop"), "power", (F.col("lit").cast("double") / F.col("pop")).alias("lit")), c.units.groupBy(F.concat_ws("/", "s", "town").alias("g")).agg(F.avg("power").alias("power"), F.avg(F.col("lit").cast("double") / F.col("pop")).alias("lit")), "g", "code", "pop", ["power", "lit"]), None)
register("largest_remainder", lambda c: merge.rounded_to_total(c.summary.where("arena = 'AE'").select(F.concat_ws("/", "s", "y").alias("g"), "p", F.col("v").alias("x"), F.lit(100).cast("long").alias("total")), "g", "p", "x", "total").select("g", "p", "rounded"), "SELECT g, p, f + CASE WHEN row_number() OVER (PARTITION BY g ORDER BY v - f DESC, p) <= 100 - sum(f) OVER (PARTITION BY g) THEN 1 ELSE 0 END AS rounded FROM (SELECT s || '/' || y AS g, p, v, CAST(floor(v) AS BIGINT) AS f FROM summ WHERE arena = 'AE')")
register("rounded_without_zeros", lambda c: merge.without_zeros(merge.rounded_to_total(c.summary.where("arena = 'AE'").select(F.concat_ws("/", "s", "y").alias("g"), "p", (F.col("v") * 0.08).alias("x"), F.lit(8).cast("long").alias("total")), "g", "p", "x", "total"), "g", "p", "rounded").select("g", "p", "rounded"), """SELECT g, unnest(ps) AS p, unnest(v) AS rounded FROM (WITH RECURSIVE base AS (SELECT g, p, f + CASE WHEN row_number() OVER (PARTITION BY g ORDER BY x - f DESC, p) <= 8 - sum(f) OVER (PARTITION BY g) THEN 1 ELSE 0 END AS r FROM (SELECT s || '/' || y AS g, p, v * 0.08 AS x, CAST(floor(v * 0.08) AS BIGINT) AS f FROM summ WHERE arena = 'AE')),
st AS (SELECT g, list(p ORDER BY p) AS ps, list(CAST(r AS BIGINT) ORDER BY p) AS v FROM base GROUP BY g UNION ALL SELECT g, ps, list_transform(v, lambda x, i: CASE WHEN i = list_position(v, 0) THEN 1 WHEN i = list_position(v, list_max(v)) THEN x - 1 ELSE x END) FROM st WHERE list_contains(v, 0) AND list_sum(v) >= len(v)) SELECT * FROM st WHERE NOT list_contains(v, 0) OR list_sum(v) < len(v))""")
register("hierarchy_additivity", lambda c: quality.additive(c.summary, c.national.where("p != 'PROMO'"), ["arena", "y", "p"], ["votes", "wo"]), "SELECT arena, y, p, votes AS sum_votes, wo AS sum_wo, CAST(NULL AS BIGINT) AS votes, CAST(NULL AS BIGINT) AS wo FROM nat WHERE p = 'PROMO'")
register("key_checks", lambda c: quality.unique_and_whole(c.seats, ["arena", "s", "y"], "n"), "SELECT arena, s, y, count(*) AS rows, count(DISTINCT n) AS distinct, count(*) = count(DISTINCT n) AS is_unique, min(n) = 1 AND max(n) = count(DISTINCT n) AS is_whole FROM seats GROUP BY ALL")
register("only_in_one", lambda c: quality.only_in(c.seats.where("arena = 'AE'"), c.seats.where("arena = 'GE'"), ["s", "y", "n"]), "SELECT s, y, n, 'a' AS only_in FROM (SELECT s, y, n FROM seats WHERE arena = 'AE' EXCEPT SELECT s, y, n FROM seats WHERE arena = 'GE') UNION ALL SELECT s, y, n, 'b' FROM (SELECT s, y, n FROM seats WHERE arena = 'GE' EXCEPT SELECT s, y, n FROM seats WHERE arena = 'AE')")
register("coverage_buckets", lambda c: quality.coverage(c.units, F.col("code") % 4, "pop", "s"), UNITS + "SELECT s, bucket, CAST(sum(pop) AS BIGINT) AS weight, round(CAST(sum(pop) AS DOUBLE) * 100 / sum(sum(pop)) OVER (PARTITION BY s), 6) AS pct FROM (SELECT s, pop, CASE code % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'several' END AS bucket FROM u) GROUP BY s, bucket")
register("check_report", lambda c: quality.report([quality.check("votes add up", c.cand.agg(F.sum("votes").alias("votes")).join(source.table(c.spark, c.sf_dir, "lineitem").agg(F.sum("l_quantity").cast("long").alias("whole"))), F.max("whole"), F.max("votes")), quality.check("states", c.seats, F.lit(25), F.count_distinct("s")), quality.check("a winner for each contest", c.cand.select("arena", "s", "y", "n").distinct().join(c.seats, SEAT, "left"), F.count(F.lit(1)), F.count("p"))]), "SELECT 'votes add up' AS \"check\", CAST(CAST(w AS BIGINT) AS VARCHAR) AS expected, CAST(v AS VARCHAR) AS got, CAST(w AS BIGINT) = v AS ok FROM (SELECT sum(l_quantity) AS w FROM lineitem), (SELECT CAST(sum(votes) AS BIGINT) AS v FROM cand) UNION ALL SELECT 'states', '25', CAST(count(DISTINCT s) AS VARCHAR), count(DISTINCT s) = 25 FROM seats UNION ALL SELECT 'a winner for each contest', CAST(count(*) AS VARCHAR), CAST(count(p) AS VARCHAR), count(*) = count(p) FROM (SELECT DISTINCT arena, s, y, n FROM cand) LEFT JOIN seats USING (arena, s, y, n)")
register("election_manifest", lambda c: files.manifest(c.cand), "SELECT arena, s, y, count(*) AS rows FROM cand GROUP BY ALL")

# Scorecards over years, labels and matrices.
register("vote_and_seats", lambda c: rollup.vote_and_seats(c.seats, c.summary), ", b AS (SELECT u.arena, u.s, u.y, u.p, u.v, u.wo AS seats FROM summ u), t AS (SELECT arena, s, p FROM (SELECT arena, s, p, row_number() OVER (PARTITION BY arena, s ORDER BY max(seats) DESC, p) AS rank FROM b GROUP BY arena, s, p) WHERE rank <= 4) SELECT arena, s, y, p, round(v, 6) AS v, seats FROM b JOIN t USING (arena, s, p)")
register("win_quality", lambda c: rollup.win_quality(c.seats, canon.band(F.col("v"), (30.0, 40.0, 50.0))), "SELECT arena, p, y, bucket, n, round(CAST(n AS DOUBLE) * 100 / o, 6) AS pct FROM (SELECT arena, p, y, bucket, n, sum(n) OVER (PARTITION BY arena, p) AS total, sum(n) OVER (PARTITION BY arena, p, y) AS o FROM (SELECT arena, p, y, CAST(v >= 30 AS INTEGER) + CAST(v >= 40 AS INTEGER) + CAST(v >= 50 AS INTEGER) AS bucket, count(*) AS n FROM seats WHERE v IS NOT NULL GROUP BY ALL)) WHERE total >= 8")
register("winner_matrix", lambda c: rollup.winner_matrix(c.seats), "SELECT arena, s, j, " + ", ".join(f"max(p) FILTER (y = {y}) AS \"{y}\"" for y in range(1995, 2002)) + " FROM seats GROUP BY ALL")
register("election_index", lambda c: rollup.index(c.seats), "SELECT arena, s, y, p, lead_seats, seats FROM (SELECT arena, s, y, p, count(*) AS lead_seats, CAST(sum(count(*)) OVER (PARTITION BY arena, s, y) AS BIGINT) AS seats, row_number() OVER (PARTITION BY arena, s, y ORDER BY count(*) DESC, p) AS rn FROM seats GROUP BY arena, s, y, p) WHERE rn = 1")
register("seat_labels", lambda c: signals.seat_labels(resolve.biographies(c.seats)), ", b AS (SELECT arena, s, j, count(*) AS e, count(DISTINCT p) AS w, count(*) FILTER (status = 'flipped') AS f, avg(t) AS t, avg(v + (v - m)) AS bp FROM prev GROUP BY ALL) SELECT arena, s, j, CASE WHEN e > 1 AND w = 1 THEN 'fortress' WHEN w = e OR f >= ceil((e - 1) / 2) THEN 'swing' ELSE 'leans' END AS kind, CASE WHEN bp >= 82 THEN 'bipolar' WHEN bp >= 68 THEN 'triangular' ELSE 'fragmented' END AS field, CASE WHEN t >= 72 THEN 'high' WHEN t >= 62 THEN 'middling' ELSE 'low' END AS turnout FROM b")
register("losses_in_reach", lambda c: signals.losses_in_reach(c.active), "SELECT arena, q AS p, s, j, round(m, 6) AS m, rank FROM (SELECT *, row_number() OVER (PARTITION BY arena, q ORDER BY m, s, j) AS rank FROM act WHERE m < 10) WHERE rank <= 5")
register("party_verdicts", lambda c: signals.verdicts(signals.scorecards(c.active), c.active), CARDS + ", h AS (SELECT arena, count(*) AS o FROM act GROUP BY ALL), x AS (SELECT arena, p, CAST(won AS DOUBLE) * 100 / o AS share FROM cards JOIN h USING (arena)) SELECT arena, p, round(share, 6) AS seat_share, CASE WHEN share >= 45 THEN 'dominant' WHEN share >= 25 THEN 'strong' WHEN share >= 8 THEN 'present' ELSE 'fringe' END AS verdict FROM x")
register("whole_record_merge", lambda c: merge.preferred(c.seats.select(*SEAT, "p", F.lit(1).alias("rank")).where("n != 2").unionByName(c.bypolls.select(*SEAT, "p", F.lit(0).alias("rank"))), SEAT, "rank"), "SELECT * FROM (SELECT arena, s, y, n, p, 1 AS rank FROM seats WHERE n <> 2 UNION ALL SELECT arena, s, y, n, p, 0 FROM byp) QUALIFY row_number() OVER (PARTITION BY arena, s, y, n ORDER BY rank) = 1")
register("bypolls_of_seats", lambda c: c.active.select("arena", "s", "n", "y", "p").join(c.bypolls.select("arena", "s", "n", F.col("y").alias("by_y"), F.col("p").alias("by_p")), ["arena", "s", "n"]).where("by_y >= y"), "SELECT a.arena, a.s, a.n, a.y, a.p, b.y AS by_y, b.p AS by_p FROM act a JOIN byp b ON a.arena = b.arena AND a.s = b.s AND a.n = b.n AND b.y >= a.y")
register("electors_agreement", lambda c: c.electors.join(c.seats.select(*SEAT, "total"), SEAT).groupBy("arena", "s", "y").agg(F.count(F.lit(1)).alias("seats"), F.count_if(F.abs(F.col("e") - 2 * F.col("total")) <= 0.005 * F.col("e")).alias("agree"), F.sum(F.col("e") - 2 * F.col("total")).alias("difference")), "SELECT arena, s, y, count(*) AS seats, count(*) FILTER (abs(e - 2 * total) <= 0.005 * e) AS agree, CAST(sum(e - 2 * total) AS BIGINT) AS difference FROM el JOIN seats USING (arena, s, y, n) GROUP BY ALL")
register("turnout_precedence", lambda c: c.seats.groupBy("arena", "s", "y").agg(F.avg("t").alias("mean")).join(c.electors.where("n <= 3 and e > 0").groupBy("arena", "s", "y").agg(F.sum("voters").alias("v"), F.sum("e").alias("e")), ["arena", "s", "y"], "left").select("arena", "s", "y", F.coalesce(canon.percent(F.col("v"), F.col("e")), F.col("mean")).alias("turnout")), "SELECT arena, s, y, round(coalesce(CAST(v AS DOUBLE) * 100 / e, mean), 6) AS turnout FROM (SELECT arena, s, y, avg(t) AS mean FROM seats GROUP BY ALL) LEFT JOIN (SELECT arena, s, y, sum(voters) AS v, sum(e) AS e FROM el WHERE n <= 3 AND e > 0 GROUP BY ALL) USING (arena, s, y)")

# Signals of a whole house, and lookups with ordered fallbacks.
register("split_field", lambda c: board.split_field(c.active), "SELECT arena, p, decided, under, count(*) AS wins, 60 + CAST(round(CAST(under AS DOUBLE) * 100 / decided) AS BIGINT) AS score, row_number() OVER (PARTITION BY arena ORDER BY count(*) DESC, p) AS line, count(*) OVER (PARTITION BY arena) AS parties FROM (SELECT *, count(*) OVER (PARTITION BY arena) AS under FROM (SELECT *, count(*) OVER (PARTITION BY arena) AS decided FROM act WHERE v IS NOT NULL) WHERE v < 40 AND decided >= 30) WHERE under >= greatest(4, 0.08 * decided) GROUP BY arena, p, decided, under QUALIFY line <= 8")
register("softening_strongholds", lambda c: board.softening(resolve.eroding(c.seats.withColumn("p", canon.alliance_base(F.col("a"))))), "SELECT arena, p, seats, round(mean_lost, 6) AS mean_lost, 60 + 2 * lead AS score, row_number() OVER (PARTITION BY arena ORDER BY seats DESC, p) AS line, count(*) OVER (PARTITION BY arena) AS parties FROM (SELECT *, CAST(sum(seats) OVER w AS BIGINT) AS whole, max(seats) OVER w AS lead FROM (SELECT arena, p, count(*) AS seats, avg(m1 - m) AS mean_lost FROM (SELECT *, lag(p, 1) OVER w AS p1, lag(p, 2) OVER w AS p2, lag(m, 1) OVER w AS m1, lead(y) OVER w AS later FROM (SELECT * REPLACE (CASE WHEN p IN ('STANDARD', 'ECONOMY') THEN 'A Alliance' WHEN p IN ('MEDIUM', 'PROMO') THEN 'B Alliance' ELSE 'Unaligned' END AS p) FROM seats) WINDOW w AS (PARTITION BY arena, s, j ORDER BY y)) WHERE later IS NULL AND p = p1 AND p = p2 AND m1 - m > 5 GROUP BY ALL) WINDOW w AS (PARTITION BY arena)) WHERE whole >= 3 AND lead >= 3 QUALIFY line <= 8")
register("margin_of_control", lambda c: board.margin_of_control(c.active, ["arena"]), """, tally AS (SELECT arena, p, count(*) AS won FROM act GROUP BY ALL), led AS (SELECT arena, p, won, CAST(sum(won) OVER (PARTITION BY arena) AS BIGINT) AS n FROM tally QUALIFY row_number() OVER (PARTITION BY arena ORDER BY won DESC, p) = 1),
line AS (SELECT *, CAST(n // 2 AS BIGINT) + 1 AS majority, won - (CAST(n // 2 AS BIGINT) + 1) AS cushion FROM led WHERE n >= 30), thin AS (SELECT l.arena, a.m, l.cushion, row_number() OVER (PARTITION BY l.arena ORDER BY a.m, a.n) - 1 AS place, count(*) OVER (PARTITION BY l.arena) AS o FROM act a JOIN line l ON a.arena = l.arena AND a.p = l.p WHERE a.m IS NOT NULL)
SELECT line.arena, line.p AS leader, n, won, majority, line.cushion, round(t.m, 6) AS pivot, CASE WHEN line.cushion >= 0 AND line.cushion <= greatest(3, 0.03 * n) THEN 'critical' ELSE 'note' END AS severity FROM line LEFT JOIN (SELECT * FROM thin WHERE cushion >= 0 AND place = least(cushion, o - 1)) t ON t.arena = line.arena""")
register("resolved_years", lambda c: board.resolved_years(c.seats.where("y != 1997"), ["arena", "s"], c.seats.select("arena", "s", F.explode(F.array(F.lit(1990), F.lit(1997), F.lit(2000))).alias("y")).distinct()), "SELECT arena, s, w.y, coalesce(max(h.y) FILTER (h.y <= w.y), min(h.y)) AS resolved FROM (SELECT DISTINCT arena, s, unnest([1990, 1997, 2000]) AS y FROM seats) w JOIN (SELECT DISTINCT arena, s, y FROM seats WHERE y <> 1997) h USING (arena, s) GROUP BY arena, s, w.y")
register("code_weights", lambda c: board.code_weights(c.units.select(F.col("code").alias("unit"), F.when(F.col("code") % 3 == 0, F.concat(F.lit(" "), F.col("n").cast("string"), F.lit(" "))).otherwise(F.concat_ws(";", F.concat_ws(":", "n", "pop"), F.concat_ws(":", F.col("town") + 100, "hh"), F.lit("x:1"), F.lit("7:y"), F.lit(""))).alias("pins")), "unit", "pins"), UNITS + "SELECT unit, code, round(CAST(w AS DOUBLE) / sum(w) OVER (PARTITION BY unit), 6) AS weight FROM (SELECT code AS unit, CAST(n AS BIGINT) AS code, CASE WHEN k3 = 0 THEN 1 ELSE pop END AS w FROM (SELECT *, code % 3 AS k3 FROM u) UNION ALL SELECT code, CAST(town + 100 AS BIGINT), hh FROM u WHERE code % 3 <> 0)")
BOOK = ", book AS (SELECT arena, s, y, CAST(CASE WHEN j % 6 = 1 THEN j + 50 WHEN j % 6 = 4 AND y % 2 = 0 THEN j - 2 ELSE j END AS INTEGER) AS j, CASE WHEN j % 6 = 5 THEN NULL WHEN j % 6 = 2 THEN 'Other seat' WHEN j % 6 = 3 THEN 'SEAT ' || j || '-and (SC)' ELSE 'seat ' || j || ' and co' END AS name, e FROM el), st AS (SELECT arena, s, y, j, 'Seat ' || j || ' and Co' AS name FROM seats)"
register("electors_looked_up", lambda c: board.looked_up(seat_names(c), elector_book(c), ["arena", "s", "y"], "j", "name", "e"), BOOK + """, entry AS (SELECT arena, s, y, j, e, coalesce(regexp_replace(regexp_replace(upper(name), '\\s*\\((SC|ST|GEN)\\)\\s*$', ''), '[^A-Z0-9]', '', 'g'), '') AS nm FROM book QUALIFY row_number() OVER (PARTITION BY arena, s, y, j ORDER BY e DESC, name DESC NULLS LAST) = 1),
q AS (SELECT *, 'SEAT' || j || 'ANDCO' AS nm FROM st), named AS (SELECT q.arena, q.s, q.y, q.j, count(*) AS c, max(e.e) AS e FROM q JOIN entry e ON e.arena = q.arena AND e.s = q.s AND e.y = q.y AND e.nm <> '' AND (contains(e.nm, q.nm) OR contains(q.nm, e.nm)) GROUP BY ALL)
SELECT q.arena, q.s, q.y, q.j, q.name, CASE WHEN e.e IS NOT NULL AND (e.nm = '' OR contains(e.nm, q.nm) OR contains(q.nm, e.nm)) THEN e.e WHEN n.c = 1 THEN n.e ELSE e.e END AS e, CASE WHEN e.e IS NOT NULL AND (e.nm = '' OR contains(e.nm, q.nm) OR contains(q.nm, e.nm)) THEN 'both' WHEN n.c = 1 THEN 'name' WHEN e.e IS NOT NULL THEN 'number' END AS "by"
FROM q LEFT JOIN entry e USING (arena, s, y, j) LEFT JOIN named n ON n.arena = q.arena AND n.s = q.s AND n.y = q.y AND n.j = q.j""")
register("electors_by_name_then_number", lambda c: board.two_step(seat_names(c), elector_book(c).where("name != 'Other seat'").withColumn("name", F.regexp_replace(F.initcap("name"), "And", "and")), elector_book(c), ["arena", "s", "y"], "j", "name", "e"), BOOK + " SELECT arena, s, y, st.j, st.name, CASE WHEN x.e IS NOT NULL THEN x.e ELSE z.e END AS e FROM st LEFT JOIN (SELECT arena, s, y, 'Seat ' || j || ' and Co' AS name, e FROM el WHERE j % 6 IN (0, 1, 4)) x USING (arena, s, y, name) LEFT JOIN (SELECT arena, s, y, j, max(e) AS e FROM book GROUP BY ALL) z USING (arena, s, y, j)")
register("district_of_seat", lambda c: board.most_common(c.units, ["s", "n"], "district"), UNITS + "SELECT s, n, district, round(CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY s, n), 6) AS share FROM (SELECT s, n, district, count(*) AS c FROM u GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY s, n ORDER BY c DESC, district) = 1")
register("backfilled_shares", lambda c: backfilled_candidates(c), "SELECT arena, s, y, n, p, round(CASE WHEN n % 3 <> 0 THEN share WHEN n = 3 THEN CAST(votes AS DOUBLE) * 100 / (total + n) ELSE CAST(votes AS DOUBLE) * 100 / (total + 2 * n) END, 6) AS share FROM ranked WHERE votes > 0")
register("complete_parent_profiles", lambda c: board.complete_sums(c.units.groupBy("s", "n").agg(F.sum("pop").alias("pop"), F.sum("hh").alias("hh")).join(c.parents.select("s", "pc"), "s"), c.parents.groupBy("pc").agg((F.count(F.lit(1)) * 6).alias("parts")), ["pc"], ["pop", "hh"]), UNITS + "SELECT pc, CAST(sum(pop) AS BIGINT) AS pop, CAST(sum(hh) AS BIGINT) AS hh FROM prof JOIN par USING (s) GROUP BY pc HAVING count(*) = (SELECT 6 * count(*) FROM par q WHERE q.pc = par.pc)")
register("leader_retention", lambda c: board.leader_retention(c.changed), """, led AS (SELECT arena, s, p AS leader, count(*) AS won FROM chg GROUP BY arena, s, p QUALIFY row_number() OVER (PARTITION BY arena, s ORDER BY count(*) DESC, p) = 1), kept AS (SELECT arena, s, leader, won, count(*) FILTER (prev_p = leader) AS had, count(*) FILTER (prev_p = leader AND p = leader) AS kept, count(*) FILTER (p = leader AND prev_p <> leader) - count(*) FILTER (p <> leader AND prev_p = leader) AS net FROM comp JOIN led USING (arena, s) GROUP BY ALL)
SELECT *, round(CAST(kept AS DOUBLE) * 100 / had, 6) AS retention FROM kept WHERE had > 0""")
register("apportioned_towns", lambda c: merge.apportioned(*wards_and_frame(c)), UNITS + """, uu AS (SELECT s, n, pop, CAST(CASE WHEN n >= 5 THEN (code // 6) % 12 ELSE (code // 6) % 24 END AS INTEGER) AS town FROM u), wd AS (SELECT s, town, n, CAST(sum(pop) AS DOUBLE) AS pop, town >= 12 AS split FROM uu GROUP BY ALL),
whole AS (SELECT s, n, coalesce(sum(pop) FILTER (NOT split), 0) AS pure, bool_or(split) AS touched FROM wd GROUP BY ALL), ratio AS (SELECT s, median(e / pure) AS ratio FROM frame JOIN whole USING (s, n) WHERE NOT touched AND pure > 0 AND e > 0 GROUP BY s),
resid AS (SELECT s, n, greatest(0, coalesce(e, 0) - coalesce(ratio, 0.65) * pure) AS residual FROM whole LEFT JOIN frame USING (s, n) LEFT JOIN ratio USING (s)), x AS (SELECT s, town, n, wd.pop AS was, residual * wd.pop / sum(wd.pop) OVER (PARTITION BY s, n) AS x FROM wd JOIN resid USING (s, n) WHERE split)
SELECT s, town, n, round(CASE WHEN sum(x) OVER w > 0 THEN x / sum(x) OVER w ELSE was / sum(was) OVER w END, 6) AS share FROM x WINDOW w AS (PARTITION BY s, town)""")

# Names of towns, levels of census rows, turnout by electors and sums of parts.
register("town_names", lambda c: source.table(c.spark, c.sf_dir, "part").select("p_partkey", canon.town_name(F.concat("p_type", F.lit(" Nagar Palika "), "p_name", F.lit(" Town (M Cl)"))).alias("town")), "SELECT p_partkey, regexp_replace(lower(p_type || p_name), '[^a-z]', '', 'g') AS town FROM part")
register("title_cases", lambda c: source.table(c.spark, c.sf_dir, "part").select("p_partkey", canon.title_case(F.when(F.col("p_size") % 2 == 0, F.regexp_replace(F.upper("p_name"), " ", "-")).otherwise(F.upper("p_name"))).alias("name")), "SELECT p_partkey, replace(array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' '), ' ', CASE WHEN p_size % 2 = 0 THEN '-' ELSE ' ' END) AS name FROM part")
register("unit_levels", lambda c: source.table(c.spark, c.sf_dir, "part").select("p_partkey", canon.unit_level(*[F.lpad((F.col(k) % m).cast("string"), w, "0") for k, m, w in (("p_size", 2, 3), ("p_partkey", 3, 5), ("p_partkey", 5, 6))]).alias("level")).where("level is not null"), "SELECT p_partkey, level FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 <> 0 THEN 'TOWN_WHOLE' WHEN p_partkey % 3 = 0 AND p_size % 2 = 0 THEN 'STATE' WHEN p_partkey % 3 = 0 THEN 'DISTRICT' WHEN p_size % 2 = 1 AND p_partkey % 5 = 0 THEN 'SUBDISTRICT' WHEN p_size % 2 = 1 THEN 'TOWN' END AS level FROM part) WHERE level IS NOT NULL")
register("pooled_turnout", lambda c: rollup.pooled_turnout(c.electors), "SELECT arena, s, y, round(CAST(sum(voters) AS DOUBLE) * 100 / sum(e), 6) AS t FROM el WHERE e > 0 GROUP BY ALL")
register("parts_adding_up", lambda c: quality.identity_failures(c.electors, ["arena", "y"], "e", ["men", "women"]), "SELECT arena, y, count(*) AS rows, count(*) FILTER (n = 4) AS failed FROM el GROUP BY ALL")

for more in (place_queries, link_queries, rule_queries, board_queries, candidate_queries):
    QUERIES |= more.REGISTRY.queries
    ORACLE |= more.REGISTRY.oracle
