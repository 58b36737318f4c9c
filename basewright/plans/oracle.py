"""SQL of the queries, for an engine that reads the same tables."""

from __future__ import annotations

from ..functions.status import COLOURS, MERGEABLE, OVER
from .standins import BLOCKS, IGNORED, INTERVALS, LENGTH, MEAN_PILE, MEDIAN_PILE, READS, SIGNAL, STATUSES

RGB = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COLOURS.items()) + " ELSE '0,0,0' END"


def _over(a: str, b: str) -> str:
    return "(" + " OR ".join([f"({a} = '{k}' AND {b} IN {v})" for k, v in OVER.items()] + [f"({b} = 'good' AND {a} <> 'good')"]) + ")"


def _stronger(a: str, b: str) -> str:
    return f"CASE WHEN {_over(a, b)} THEN {a} ELSE {b} END"


def _peak(x: str, low: float, high: float, drop: bool, src: str, part: str = "region_id") -> str:
    """CTEs that end in p_X(part, pos, X, X_median, X_stdev, X_zscore, X_peak)."""
    return f"""a_{x} AS (SELECT {part}, pos, CAST({f'CASE WHEN {x} <> 0 THEN {x} END' if drop else x} AS DOUBLE) AS v FROM {src}),
b_{x} AS (SELECT *, median(v) OVER (PARTITION BY {part}) AS med, avg(v) OVER (PARTITION BY {part}) AS mean FROM a_{x}),
c_{x} AS (SELECT *, median(abs(v - med)) OVER (PARTITION BY {part}) AS mad, avg(abs(v - mean)) OVER (PARTITION BY {part}) AS aad FROM b_{x}),
d_{x} AS (SELECT *, CASE WHEN mad = 0 THEN aad * CAST(1.253314 AS DOUBLE) ELSE mad * CAST(1.486 AS DOUBLE) END AS scale FROM c_{x}),
p_{x} AS (SELECT {part}, pos, CAST(trunc(v) AS BIGINT) AS {x}, CASE WHEN v IS NOT NULL THEN med END AS {x}_median, CASE WHEN v IS NOT NULL THEN scale END AS {x}_stdev,
  CASE WHEN v IS NULL THEN NULL WHEN scale = 0 THEN CAST('nan' AS DOUBLE) ELSE (v - med) / scale END AS {x}_zscore,
  CASE WHEN v IS NULL THEN 'null' WHEN scale = 0 THEN 'high' WHEN v - med > scale * CAST({high} AS DOUBLE) THEN 'high' WHEN v - med < scale * CAST(-{low} AS DOUBLE) THEN 'low' ELSE 'null' END AS {x}_peak FROM d_{x})"""


PART = "region_id, bin"
SIGNALS = ",\n".join(
    [
        MEAN_PILE,
        f"rolled AS (SELECT * REPLACE (avg(indel) OVER (PARTITION BY region_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS indel), CASE WHEN pos <= {LENGTH // 2} THEN 1 ELSE 0 END AS bin FROM pile)",
        *[_peak(x, low, high, drop, "rolled", PART) for x, low, high, drop in (("cov", 3.5, 3.5, False), ("mismatch", 3.5, 3.5, True), ("indel", 5.0, 5.0, True), ("softclip", 3.5, 3.5, True), ("mapq", 1.0, 1.0, False))],
        "joined AS (SELECT p_cov.region_id, p_cov.bin, p_cov.pos, p_cov.cov, mismatch, indel, softclip, p_mapq.mapq, mapq_max, cov_peak, mismatch_peak, indel_peak, softclip_peak, mapq_peak FROM p_cov JOIN p_mismatch USING (region_id, bin, pos) JOIN p_indel USING (region_id, bin, pos) JOIN p_softclip USING (region_id, bin, pos) JOIN p_mapq USING (region_id, bin, pos) JOIN (SELECT region_id, pos, mapq_max FROM pile) USING (region_id, pos))",
        "based AS (SELECT *, floor(median(cov) OVER (PARTITION BY region_id, bin)) AS base FROM joined)",
        """classified AS (SELECT *, 'ctg' || region_id AS chrom, CASE WHEN mismatch >= cov * 0.1 AND mismatch_peak = 'high' THEN 'low_quality'
  WHEN cov_peak = 'high' AND cov >= floor(base * 1.5) AND mapq_peak = 'low' AND (mismatch_peak = 'high' OR indel_peak = 'high') THEN 'collapse'
  WHEN cov = 0 OR (cov_peak = 'low' AND mapq_peak = 'low' AND cov <= floor(base * 0.1)) THEN 'misjoin'
  WHEN cov <= floor(base * 0.5) AND mapq_max = 0 THEN 'false_dupe'
  WHEN indel >= cov * 0.2 AND indel_peak = 'high' THEN 'indel'
  WHEN softclip >= cov * 0.5 AND softclip_peak = 'high' THEN 'softclip' ELSE 'good' END AS status FROM based)""",
        """near AS (SELECT *, pos - lag(pos, 1, 0) OVER (PARTITION BY region_id, bin ORDER BY pos) <= 1 AS near FROM classified),
change AS (SELECT *, coalesce(near <> lag(near) OVER w OR status <> lag(status) OVER w, true) AS new FROM near WINDOW w AS (PARTITION BY region_id, bin ORDER BY pos)),
run AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY region_id, bin ORDER BY pos) AS grp FROM change),
segments AS (SELECT region_id, bin, min(pos) AS st, max(pos) + 1 AS "end", CAST(floor(avg(cov)) AS BIGINT) AS cov, min(status) AS status FROM run GROUP BY region_id, bin, grp)""",
    ]
)


def _merge(src: str, distance: int, extra: str, folds: str, keys: str = "region_id") -> str:
    return f"""m1 AS (SELECT *, coalesce(NOT (st - lag("end") OVER w <= {distance} {extra}), true) AS new FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY st, ord)),
m2 AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY {keys} ORDER BY st, ord) AS grp FROM m1),
merged AS (SELECT {keys}, min(st) AS st, arg_max("end", (st, ord)) AS "end", arg_min(ord, (st, ord)) AS ord, {folds} FROM m2 GROUP BY {keys}, grp)"""


COV_FOLD = "list_reduce(list(cov ORDER BY st, ord), lambda a, x: (a + x) // 2) AS cov"
STATUS_FOLD = f"list_reduce(list(status ORDER BY st, ord), lambda a, x: {_stronger('a', 'x')}) AS status"
BAD = _merge("bad", 2, "", f"{STATUS_FOLD}, {COV_FOLD}")
BAD = f"{INTERVALS}, bad AS (SELECT * FROM itvs WHERE status <> 'good'), {BAD}"
BINS = 'bins AS (SELECT region_id, bin, CAST(floor(n * bin / 10.0::DOUBLE) AS BIGINT) AS st, CAST(floor(n * bin / 10.0::DOUBLE + n / 15.0::DOUBLE) AS BIGINT) AS "end" FROM (SELECT region_id, max(pos) AS n FROM signal GROUP BY 1), range(1, 10) t(bin))'
GOODS = "good AS (SELECT * FROM signal WHERE cov % 3 <> 0), rolled AS (SELECT region_id, pos, median(cov) OVER w AS roll_median, stddev_samp(cov) OVER w AS roll_stdev FROM good WINDOW w AS (PARTITION BY region_id ORDER BY pos ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING))"


def _peaks(drop: bool) -> str:
    return f"WITH {SIGNAL}, {_peak('cov', 1.5, 1.5, drop, 'signal')} SELECT region_id, pos, cov, round(cov_median, 6) AS cov_median, round(cov_stdev, 6) AS cov_stdev, round(cov_zscore, 6) AS cov_zscore, cov_peak FROM p_cov"


MEDIAN_BETWEEN = 'CAST(coalesce((SELECT floor(median(cov)) FROM signal s WHERE s.region_id = r.region_id AND s.pos BETWEEN {} AND {}), 0) AS BIGINT)'
#: Bins walked from left to right: whether each one's start has moved to the end of the one before.
GAPS = f"""WITH RECURSIVE {SIGNAL}, {BINS},
r AS (SELECT *, lag("end") OVER w AS b_end, lead(st) OVER w AS n_st, row_number() OVER w AS nth FROM bins WINDOW w AS (PARTITION BY region_id ORDER BY st)),
meds AS (SELECT *, {MEDIAN_BETWEEN.format('r.st', 'r."end"')} AS own, {MEDIAN_BETWEEN.format('r.b_end', 'r."end"')} AS longer, {MEDIAN_BETWEEN.format('r."end"', 'r.n_st')} AS gap FROM r),
walk AS (SELECT region_id, nth, false AS moved FROM meds WHERE nth = 1
  UNION ALL SELECT n.region_id, n.nth, NOT abs(CASE WHEN w.moved THEN l.longer ELSE l.own END - l.gap) < abs(n.own - l.gap) FROM walk w JOIN meds l USING (region_id, nth) JOIN meds n ON n.region_id = w.region_id AND n.nth = w.nth + 1)
SELECT region_id, bin, CASE WHEN moved THEN b_end ELSE st END AS st, CASE WHEN NOT lead(moved) OVER (PARTITION BY region_id ORDER BY nth) THEN n_st ELSE "end" END AS "end" FROM meds JOIN walk USING (region_id, nth)"""


def _calls() -> str:
    """All steps from classified bases to final calls, one after another."""
    rows = "PARTITION BY region_id ORDER BY st, ord"
    same = "SELECT *, coalesce(status <> lag(status) OVER w, true) AS new FROM small WINDOW w AS (" + rows + ")"
    small = _merge("chunked", 1, "AND lag(status) OVER w = status", f"min(status) AS status, {COV_FOLD}", "region_id, chrom")
    bad = _merge("bad", 20, "", f"{STATUS_FOLD}, {COV_FOLD}")
    for k in ("m1", "m2", "merged"):
        small = small.replace(f"{k} AS", f"s_{k} AS").replace(f"FROM {k}", f"FROM s_{k}")
    return f"""WITH {SIGNALS}, {IGNORED},
good AS (SELECT * FROM classified WHERE status = 'good'),
rolls AS (SELECT region_id, bin, median(cov) OVER (PARTITION BY region_id, bin ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS roll FROM good),
stats AS (SELECT region_id, bin, median(roll) AS median FROM rolls GROUP BY ALL),
lev AS (SELECT region_id, bin, pos, cov >= median AS above, min(pos) OVER p AS low, max(pos) OVER p AS high FROM classified JOIN stats USING (region_id, bin) WINDOW p AS (PARTITION BY region_id, bin)),
lev_runs AS (SELECT *, row_number() OVER (PARTITION BY region_id, bin ORDER BY pos) - row_number() OVER (PARTITION BY region_id, bin, above ORDER BY pos) AS grp FROM lev),
edges AS (SELECT region_id, bin, min(pos) AS a_st, max(pos) AS a_end FROM lev_runs WHERE above GROUP BY region_id, bin, grp HAVING min(pos) = min(low) OR max(pos) = max(high)),
itvs AS (SELECT *, 'ctg' || region_id AS chrom, row_number() OVER (PARTITION BY region_id ORDER BY st, "end", bin) AS ord FROM segments),
bad AS (SELECT * FROM itvs WHERE status <> 'good'), {bad},
half AS (SELECT i.region_id, i.ord, arg_min(m.status, m.st) AS m_status FROM itvs i JOIN merged m ON i.region_id = m.region_id AND i.st <= m."end" AND i."end" >= m.st
  WHERE 2 * (least(i."end", m."end") - greatest(i.st, m.st)) >= i."end" - i.st GROUP BY ALL),
own AS (SELECT itvs.* REPLACE (CASE WHEN m_status IS NOT NULL AND {_over("m_status", "status")} THEN m_status ELSE status END AS status) FROM itvs LEFT JOIN half USING (region_id, ord)),
hit AS (SELECT i.*, g.st AS g_st, g."end" AS g_end FROM own i JOIN ignored g ON i.chrom = g.chrom AND i.st <= g."end" AND i."end" >= g.st),
points AS (SELECT DISTINCT region_id, ord, chrom, bin, st, "end", status, cov, p FROM (SELECT *, unnest([st, "end", greatest(st, least("end", g_st)), greatest(st, least("end", g_end))]) AS p FROM hit)),
parts AS (SELECT *, lead(p) OVER (PARTITION BY region_id, ord ORDER BY p) AS p_end FROM points),
kept AS (SELECT * FROM parts x WHERE p_end > p AND NOT EXISTS (SELECT 1 FROM hit m WHERE m.region_id = x.region_id AND m.ord = x.ord AND m.g_st <= x.p AND m.g_end >= x.p_end)),
kept_runs AS (SELECT *, p - sum(p_end - p) OVER (PARTITION BY region_id, ord ORDER BY p) AS grp FROM kept),
cut AS (SELECT region_id, ord, chrom, bin, min(p) AS st, max(p_end) AS "end", status, cov FROM kept_runs GROUP BY region_id, ord, chrom, bin, status, cov, grp
  UNION ALL SELECT region_id, ord, chrom, bin, st, "end", status, cov FROM own WHERE (region_id, ord) NOT IN (SELECT (region_id, ord) FROM hit)),
c0 AS (SELECT *, status IN {MERGEABLE} AS m FROM cut),
c1 AS (SELECT *, NOT coalesce(m AND lag(m) OVER w AND bin = lag(bin) OVER w, false) AS new FROM c0 WINDOW w AS ({rows})),
c2 AS (SELECT *, sum(CAST(new AS INT)) OVER ({rows}) AS grp FROM c1),
c3 AS (SELECT region_id, min(chrom) AS chrom, min(bin) AS bin, min(st) AS st, max("end") AS "end", arg_min(ord, (st, ord)) AS ord, list_reduce(list_prepend('good', list(status ORDER BY st, ord)), lambda a, x: {_stronger("a", "x")}) AS folded, arg_min(status, (st, ord)) AS one, bool_and(m) AS m, CAST(sum(cov) // count(*) AS BIGINT) AS cov FROM c2 GROUP BY region_id, grp),
c4 AS (SELECT *, CASE WHEN m THEN folded ELSE one END AS own_status FROM c3),
touched AS (SELECT DISTINCT c.region_id, c.ord FROM c4 c JOIN edges x ON x.region_id = c.region_id AND x.bin = c.bin AND x.a_st <= c."end" AND x.a_end >= c.st WHERE own_status = 'collapse'),
chunked AS (SELECT region_id, chrom, bin, st, "end", ord, cov, CASE WHEN own_status = 'collapse' AND (region_id, ord) IN (SELECT (region_id, ord) FROM touched) THEN 'good' ELSE own_status END AS status FROM c4),
{small},
small AS (SELECT * REPLACE (CASE WHEN "end" - st < CASE WHEN status IN ('collapse', 'false_dupe') THEN 500 ELSE 1 END THEN 'good' ELSE status END AS status) FROM s_merged),
f1 AS ({same}),
f2 AS (SELECT *, sum(CAST(new AS INT)) OVER ({rows}) AS grp FROM f1),
final AS (SELECT region_id, chrom, min(st) AS st, max("end") AS "end", min(status) AS status, median(cov) AS cov FROM f2 GROUP BY region_id, chrom, grp)
SELECT region_id, chrom, CAST(st AS INT) AS "chromStart", CAST("end" AS INT) AS "chromEnd", status AS name, CAST(cov AS DOUBLE) AS score, '.' AS strand, CAST(st AS INT) AS "thickStart", CAST("end" AS INT) AS "thickEnd", {RGB} AS "itemRgb" FROM final"""


def oracle_sql() -> dict[str, str]:
    mergeable = f"status IN {MERGEABLE}"
    return {
        "cigar_blocks": f"WITH {BLOCKS} SELECT region_id, op, b_st, b_end, mapq, count(*) AS n FROM clipped GROUP BY ALL",
        "pileup_mapq_mean": f"WITH {MEAN_PILE} SELECT * FROM pile",
        "pileup_mapq_median": f"WITH {MEDIAN_PILE} SELECT * FROM pile",
        "rolling_mean_signal": f"WITH {SIGNAL} SELECT region_id, pos, round(avg(cov) OVER (PARTITION BY region_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS cov, round(avg(cov) OVER (PARTITION BY region_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS even FROM signal",
        "peaks_keep_zero": _peaks(False),
        "peaks_drop_zero": _peaks(True),
        "signals_joined": f"WITH {SIGNALS} SELECT * FROM joined",
        "classify_bases": f"WITH {SIGNALS} SELECT chrom, pos, cov, status, mismatch, mapq, indel, softclip, bin FROM classified",
        "status_intervals": f"WITH {SIGNALS} SELECT * FROM segments",
        "bad_bases": f"WITH {SIGNALS} SELECT region_id, bin, status, count(*) AS n FROM classified WHERE status <> 'good' GROUP BY ALL",
        "above_median_runs": f"""WITH {SIGNAL}, a AS (SELECT *, cov >= 50 AS above, min(pos) OVER p AS low, max(pos) OVER p AS high FROM signal WINDOW p AS (PARTITION BY region_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY pos) - row_number() OVER (PARTITION BY region_id, above ORDER BY pos) AS grp FROM a)
SELECT region_id, min(pos) AS above_st, max(pos) AS above_end FROM b WHERE above GROUP BY region_id, grp HAVING min(pos) = min(low) OR max(pos) = max(high)""",
        "rolling_median_stats": f"WITH {SIGNAL}, {GOODS} SELECT region_id, pos, round(roll_median, 6) AS roll_median, round(roll_stdev, 6) AS roll_stdev FROM rolled",
        "bin_stats": f"WITH {SIGNAL}, {GOODS} SELECT region_id, round(median(roll_median), 6) AS median, round(coalesce(median(roll_stdev), 0), 6) AS stdev FROM rolled GROUP BY 1",
        "merge_intervals_distance": f"WITH {INTERVALS}, {_merge('itvs', 3, '', COV_FOLD)} SELECT * FROM merged",
        "merge_intervals_status": f"WITH {INTERVALS}, {_merge('itvs', 1, 'AND lag(status) OVER w = status', f'min(status) AS status, {COV_FOLD}')} SELECT * FROM merged",
        "merge_bad": f"WITH {BAD} SELECT * FROM merged",
        "overlap_length_join": f'WITH {INTERVALS}, {IGNORED} SELECT a.ord, b.st AS b_st, least(a."end", b."end") - greatest(a.st, b.st) AS length FROM itvs a JOIN ignored b ON a.chrom = b.chrom AND a.st <= b."end" AND a."end" >= b.st',
        "overlap_semi_join": f'WITH {INTERVALS}, {IGNORED} SELECT ord, chrom, st, "end" FROM itvs a WHERE EXISTS (SELECT 1 FROM ignored b WHERE a.chrom = b.chrom AND a.st <= b."end" AND a."end" >= b.st)',
        "overlap_majority": f"""WITH {BAD}, met AS (SELECT i.ord, arg_min(m.status, m.st) AS m_status FROM itvs i JOIN merged m ON i.region_id = m.region_id AND i.st <= m."end" AND i."end" >= m.st
  WHERE 2 * (least(i."end", m."end") - greatest(i.st, m.st)) >= i."end" - i.st GROUP BY 1)
SELECT region_id, ord, st, "end", CASE WHEN m_status IS NOT NULL AND {_over("m_status", "status")} THEN m_status ELSE status END AS status, status AS own_status FROM itvs LEFT JOIN met USING (ord)""",
        "subtract_ignored": f"""WITH {INTERVALS}, {IGNORED}, met AS (SELECT i.ord, i.chrom, i.st, i."end", i.status, g.st AS g_st, g."end" AS g_end FROM itvs i JOIN ignored g ON i.chrom = g.chrom AND i.st <= g."end" AND i."end" >= g.st),
points AS (SELECT DISTINCT ord, chrom, st, "end", status, p FROM (SELECT *, unnest([st, "end", greatest(st, least("end", g_st)), greatest(st, least("end", g_end))]) AS p FROM met)),
parts AS (SELECT *, lead(p) OVER (PARTITION BY ord ORDER BY p) AS p_end FROM points),
left_over AS (SELECT * FROM parts x WHERE p_end > p AND NOT EXISTS (SELECT 1 FROM met m WHERE m.ord = x.ord AND m.g_st <= x.p AND m.g_end >= x.p_end)),
runs AS (SELECT *, p - sum(p_end - p) OVER (PARTITION BY ord ORDER BY p) AS grp FROM left_over),
joined AS (SELECT ord, chrom, status, min(p) AS st, max(p_end) AS "end" FROM runs GROUP BY ord, chrom, status, grp)
SELECT ord, chrom, st, "end", status FROM joined UNION ALL SELECT ord, chrom, st, "end", status FROM itvs WHERE ord NOT IN (SELECT ord FROM met)""",
        "boundary_suppress": f"""WITH {INTERVALS}, a AS (SELECT *, sum(CAST(cov >= 200 AS INT)) OVER (PARTITION BY region_id ORDER BY st, ord) AS before, sum(CAST(cov >= 200 AS INT)) OVER (PARTITION BY region_id ORDER BY st DESC, ord DESC) AS after,
  max("end") OVER (PARTITION BY region_id) AS high, last_value("end") OVER (PARTITION BY region_id ORDER BY st, ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_end FROM itvs)
SELECT ord, region_id, st, "end", CASE WHEN before = 0 OR (last_end = high AND after = 0) THEN 'good' ELSE status END AS status FROM a""",
        "mergeable_chunks": f"""WITH {INTERVALS}, a AS (SELECT *, {mergeable} AS m FROM itvs),
b AS (SELECT *, NOT coalesce(m AND lag(m) OVER w AND bin = lag(bin) OVER w, false) AS new FROM a WINDOW w AS (PARTITION BY region_id ORDER BY st, ord)),
c AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY region_id ORDER BY st, ord) AS grp FROM b),
d AS (SELECT region_id, min(bin) AS bin, min(st) AS st, max("end") AS "end", arg_min(ord, (st, ord)) AS ord, list_reduce(list_prepend('good', list(status ORDER BY st, ord)), lambda a, x: {_stronger("a", "x")}) AS folded, arg_min(status, (st, ord)) AS one, bool_and(m) AS m, sum(cov) // count(*) AS cov FROM c GROUP BY region_id, grp),
e AS (SELECT *, CASE WHEN m THEN folded ELSE one END AS status FROM d),
over_level AS (SELECT * FROM (SELECT *, median(cov) OVER (PARTITION BY region_id, bin) AS level FROM itvs) WHERE cov > 2 * level)
SELECT region_id, bin, st, "end", ord, CASE WHEN status = 'collapse' AND EXISTS (SELECT 1 FROM over_level x WHERE x.region_id = e.region_id AND x.bin = e.bin AND x.st <= e."end" AND x."end" >= e.st) THEN 'good' ELSE status END AS status, CAST(cov AS BIGINT) AS cov FROM e""",
        "min_size_filter": f"""WITH {INTERVALS}, {_merge("itvs", 1, "AND lag(status) OVER w = status", f"min(status) AS status, {COV_FOLD}", "region_id, chrom")}
SELECT region_id, chrom, st, "end", ord, CASE WHEN "end" - st < CASE WHEN status IN ('collapse', 'false_dupe') THEN 500 ELSE 1 END THEN 'good' ELSE status END AS status, cov FROM merged""",
        "final_collapse": f"""WITH {INTERVALS}, a AS (SELECT *, coalesce(status <> lag(status) OVER w, true) AS new FROM itvs WINDOW w AS (PARTITION BY region_id ORDER BY st, ord)),
b AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY region_id ORDER BY st, ord) AS grp FROM a)
SELECT region_id, chrom, min(st) AS st, max("end") AS "end", min(status) AS status, median(cov) AS cov FROM b GROUP BY region_id, chrom, grp""",
        "bed9_projection": f"""WITH {INTERVALS} SELECT chrom, CAST(st AS INT) AS "chromStart", CAST("end" AS INT) AS "chromEnd", status AS name, CAST(cov AS DOUBLE) AS score, '.' AS strand, CAST(st AS INT) AS "thickStart", CAST("end" AS INT) AS "thickEnd", {RGB} AS "itemRgb" FROM itvs""",
        "status_colours": f"WITH {INTERVALS} SELECT status, count(*) AS n, {RGB} AS rgb FROM itvs GROUP BY status",
        "whole_genome_tiles": 'SELECT s_name AS chrom, i * 500 AS st, least((i + 1) * 500, s_suppkey * 997 % 5000) AS "end" FROM supplier, LATERAL (SELECT unnest(range(0, s_suppkey * 997 % 5000 // 500 + 1)) AS i)',
        "bed_lines": "SELECT o_orderstatus AS chrom, o_orderkey AS st, o_orderkey + 5 AS \"end\", o_orderpriority || chr(9) || 'more' AS tail FROM orders WHERE o_orderkey % 11 <> 0",
        "largest_repeat": """WITH s AS (SELECT p_partkey, p_name AS seq, length(p_name) AS n FROM part),
subs AS (SELECT p_partkey, n, i, l, substr(seq, i, l) AS u FROM s, LATERAL (SELECT unnest(range(1, n + 1)) AS i), LATERAL (SELECT unnest(range(1, n - i + 2)) AS l)),
twice AS (SELECT p_partkey, l, u FROM subs GROUP BY ALL HAVING count(*) > 1),
best AS (SELECT p_partkey, arg_max(u, (l, u)) AS u, max(l) AS l FROM twice GROUP BY 1),
hits AS (SELECT b.p_partkey, b.u, b.l, s.i, lead(s.i) OVER (PARTITION BY b.p_partkey ORDER BY s.i) - s.i AS d, s.n FROM best b JOIN subs s ON b.p_partkey = s.p_partkey AND b.u = s.u),
total AS (SELECT p_partkey, u, l, n, l + coalesce(sum(CASE WHEN d <= l THEN d ELSE 0 END), 0) AS t FROM hits GROUP BY p_partkey, u, l, n)
SELECT s.p_partkey, CASE WHEN t <> l THEN CASE WHEN contains(u, 'N') THEN 'scaffold' WHEN len(list_distinct(string_split(u, ''))) = 1 THEN 'homopolymer' ELSE 'repeat' END END AS repeat, CASE WHEN t <> l THEN u END AS sequence, CASE WHEN t <> l THEN round(t / s.n::DOUBLE, 6) END AS prop FROM s LEFT JOIN total USING (p_partkey)""",
        "bin_assign": f'WITH {SIGNAL}, {BINS} SELECT s.region_id, s.pos, s.cov, coalesce(max(b.bin), 0) AS bin FROM signal s LEFT JOIN bins b ON s.region_id = b.region_id AND s.pos + 1 >= b.st AND s.pos <= b."end" GROUP BY ALL',
        "gap_close": GAPS,
        "self_identity": """WITH s AS (SELECT doc_id, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', '', 'g') AS seq FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, substr(seq, i * 60 + 1, 60) AS win FROM s, LATERAL (SELECT unnest(range(0, (length(seq) + 59) // 60)) AS i)),
u AS (SELECT doc_id, i, substr(win, p, 7) AS u FROM w, LATERAL (SELECT unnest(range(1, length(win) - 5)) AS p)),
k AS (SELECT DISTINCT doc_id, i, least(u, reverse(translate(u, 'ACGT', 'TGCA'))) AS m FROM u),
n AS (SELECT doc_id, i, count(*) AS n FROM k GROUP BY ALL),
c AS (SELECT a.doc_id, a.i, b.i AS j, count(*) AS c FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.m = b.m AND a.i < b.i AND b.i <= a.i + 100 GROUP BY ALL),
x AS (SELECT c.doc_id, c.i, c.j, pow(c.c / least(p.n, q.n), 1.0 / 7) * 100 AS ident FROM c JOIN n p ON p.doc_id = c.doc_id AND p.i = c.i JOIN n q ON q.doc_id = c.doc_id AND q.i = c.j)
SELECT x.doc_id AS region_id, x.i, x.j, x.i * 60 + 1 AS st, x.i * 60 + 1 + length(v.win) AS "end", x.j * 60 + 1 AS other_st, x.j * 60 + 1 + length(w.win) AS other_end, round(ident, 4) AS ident
FROM x JOIN w v ON v.doc_id = x.doc_id AND v.i = x.i JOIN w ON w.doc_id = x.doc_id AND w.i = x.j WHERE ident > 60""",
        "region_calls": _calls(),
        "peaks_single": f"""WITH {SIGNAL}, a AS (SELECT region_id, pos, CAST(CASE WHEN cov <> 0 THEN cov END AS FLOAT) AS v FROM signal),
b AS (SELECT *, CAST(median(CAST(v AS DOUBLE)) OVER w AS FLOAT) AS med, CAST(avg(CAST(v AS DOUBLE)) OVER w AS FLOAT) AS mean FROM a WINDOW w AS (PARTITION BY region_id)),
c AS (SELECT *, CAST(median(CAST(abs(v - med) AS DOUBLE)) OVER w AS FLOAT) AS mad, CAST(avg(CAST(abs(v - mean) AS DOUBLE)) OVER w AS FLOAT) AS aad FROM b WINDOW w AS (PARTITION BY region_id)),
d AS (SELECT *, CASE WHEN mad = 0 THEN aad * CAST(1.253314 AS FLOAT) ELSE mad * CAST(1.486 AS FLOAT) END AS scale FROM c),
e AS (SELECT *, CASE WHEN scale = 0 THEN CAST('nan' AS FLOAT) ELSE (v - med) / scale END AS z FROM d)
SELECT region_id, pos, CAST(v AS BIGINT) AS cov, round(CAST(CASE WHEN v IS NOT NULL THEN med END AS DOUBLE), 6) AS cov_median, round(CAST(CASE WHEN v IS NOT NULL THEN scale END AS DOUBLE), 6) AS cov_stdev, round(CAST(CASE WHEN v IS NOT NULL THEN z END AS DOUBLE), 6) AS cov_zscore,
  CASE WHEN v IS NULL THEN 'null' WHEN scale = 0 OR z > CAST(1.5 AS FLOAT) THEN 'high' WHEN z < CAST(-1.5 AS FLOAT) THEN 'low' ELSE 'null' END AS cov_peak FROM e""",
        "above_runs_by_user": """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CAST(floor(value) AS BIGINT) AS cov FROM events),
a AS (SELECT *, cov >= floor(median(cov) OVER p) AS above, min(pos) OVER p AS low, max(pos) OVER p AS high FROM s WINDOW p AS (PARTITION BY user_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) - row_number() OVER (PARTITION BY user_id, above ORDER BY pos) AS grp FROM a)
SELECT user_id, min(pos) AS above_st, max(pos) AS above_end FROM b WHERE above GROUP BY user_id, grp HAVING min(pos) = min(low) OR max(pos) = max(high)""",
        "boundary_contigs": f"""WITH {INTERVALS}, l AS (SELECT *, CASE WHEN region_id % 2 = 0 THEN min(st) OVER (PARTITION BY region_id) ELSE -7 END AS low FROM itvs),
t AS (SELECT * REPLACE (st - low AS st, "end" - low AS "end") FROM l),
a AS (SELECT *, sum(CAST(cov >= 200 AS INT)) OVER (PARTITION BY region_id ORDER BY st, ord) AS before, sum(CAST(cov >= 200 AS INT)) OVER (PARTITION BY region_id ORDER BY st DESC, ord DESC) AS after, min(st) OVER (PARTITION BY region_id) AS first_st,
  max("end") OVER (PARTITION BY chrom) AS high, last_value("end") OVER (PARTITION BY region_id ORDER BY st, ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_end FROM t)
SELECT ord, region_id, st, "end", CASE WHEN (first_st <= 1 AND before = 0) OR (last_end = high AND after = 0) THEN 'good' ELSE status END AS status FROM a""",
        "known_statuses": f"""WITH a AS (SELECT coalesce(({[*STATUSES, "scaffold", "homopolymer", "repeat", "null", "Indel"]})[o_orderkey % 13 + 1], o_orderpriority) AS name FROM orders)
SELECT name, count(*) AS n, CASE WHEN name IN {tuple(k for k in COLOURS if k not in ("good", "null"))} THEN name ELSE 'good' END AS status FROM a GROUP BY name""",
        "repeat_kinds": """WITH a AS (SELECT p_partkey, coalesce((['Scaffold', 'HOMOPOLYMER', 'repeat'])[p_partkey % 4 + 1], p_type) AS name FROM part)
SELECT *, CASE lower(name) WHEN 'scaffold' THEN 'scaffold' WHEN 'homopolymer' THEN 'homopolymer' WHEN 'repeat' THEN 'repeat' END AS kind FROM a""",
        "tsv_file": f"WITH {INTERVALS} SELECT * FROM itvs",
        "bed_regions": """SELECT DISTINCT 'ctg' || (o_custkey % 4) AS chrom, o_custkey * 7 AS st, o_custkey * 7 + o_orderkey % 3 AS "end" FROM orders""",
        "region_errors": """WITH f AS (SELECT o_orderkey AS region_id, CASE WHEN o_orderkey % 17 <> 0 THEN 'ctg' || (o_custkey % 5) END AS chrom, o_orderkey % 1000 - 20 AS st, o_orderkey % 1000 - 20 + o_orderkey % 29 - 3 AS "end" FROM orders),
e AS (SELECT *, CASE WHEN chrom IS NULL THEN 'a field is missing' WHEN st < 0 THEN 'negative start' WHEN "end" < st THEN 'end before start' WHEN chrom NOT IN ('ctg0', 'ctg1', 'ctg2', 'ctg3') THEN 'unknown contig' END AS error FROM f)
SELECT * FROM e WHERE error IS NOT NULL""",
        "broken_regions": f"""WITH {INTERVALS}, {IGNORED} SELECT i.ord AS region_id, i.chrom, i.st, i."end", min('block ' || g.st) AS error FROM itvs i JOIN ignored g ON g.chrom = i.chrom AND g.st <= i."end" AND i.st <= g."end" GROUP BY ALL""",
        "region_reads": f"""WITH {READS}, laid AS (
  SELECT chrom, s AS start, n || 'S' || q || '=1X' || n || 'I' || q || '=' || n || 'D5=' AS cigar, mapq, 2 * q + n + 6 AS len FROM reads WHERE n <= 3
  UNION ALL SELECT chrom, 600 + p % 12, '10=2D10=', 0, 22 FROM reads WHERE n = 4 UNION ALL SELECT chrom, 900 + p % 3, '5X', mapq, 5 FROM reads WHERE n = 5
  UNION ALL SELECT chrom, 1100 + p % 2, '3=4D3=', mapq, 10 FROM reads WHERE n = 6 UNION ALL SELECT chrom, 1200, '9S1=', mapq, 1 FROM reads WHERE n = 7
  UNION ALL SELECT 'ctg' || (c_custkey % 4), 1650 + c_custkey % 100, '40=', 0, 40 FROM customer),
wanted AS (SELECT DISTINCT 'ctg' || (s_suppkey % 4) AS chrom, s_suppkey * 613 % 1999 + 1 AS st FROM supplier WHERE s_suppkey % 4 <> 3),
spans AS (SELECT chrom, start, cigar, mapq, len, count(*) AS n FROM laid GROUP BY ALL)
SELECT chrom, CAST(start AS INT) AS start, cigar, mapq, n FROM spans r WHERE EXISTS (SELECT 1 FROM wanted w WHERE w.chrom = r.chrom AND w.st <= r.start + r.len - 1 AND w.st + 2 >= r.start)""",
        "fasta_chunks": """WITH a AS (SELECT 'p' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS chrom, replace(upper(rpad(p_name, 60, p_name)), ' ', 'N') AS whole FROM part)
SELECT chrom, i * 20 + 1 AS start, substr(whole, i * 20 + 1, 20) AS seq FROM a, (SELECT unnest(range(3)) AS i)""",
        "range_medians": f'WITH {SIGNAL}, {BINS} SELECT b.region_id, b.st, b."end", CAST(coalesce(floor(median(s.cov)), 0) AS BIGINT) AS median FROM bins b LEFT JOIN signal s ON s.region_id = b.region_id AND s.pos BETWEEN b.st AND b."end" GROUP BY ALL',
    }
