"""Unit vectors of the core operators."""

import gzip
import json
import random
import statistics
import struct
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewright import api
from basewright.config import Config, General, GroupByIdentity, preset, read_config
from basewright.functions.status import over
from basewright.operators import binning, classify, merge, peaks, pileup
from basewright.operators.intervals import merge_intervals, range_join, subtract
from basewright.operators.repeats import largest_repeat
from basewright.sources.bed import parse_bed
from basewright.sources.fasta import read_fasta
from basewright.sources.tiles import tiles

TOML = """
[general]
log_level = "info"
bp_merge = 5000
bp_wg_window = 10000000
ignore_boundaries = true
[cov]
n_zscores_low = 3.5
n_zscores_high = 3.5
ratio_collapse = 1.5
ratio_misjoin = 0.1
ratio_false_dupe = 0.5
[mapq]
n_zscores_low = 1.0
mapq_agg_fn = "Mean"
[mismatch]
n_zscores_high = 3.5
ratio_het = 0.1
[indel]
n_zscores_high = 5.0
min_ins_size = 2
min_del_size = 2
ratio_indel = 0.25
[softclip]
n_zscores_high = 3.5
ratio_softclip = 0.5
"""


def test_config(tmp_path):
    (f := tmp_path / "c.toml").write_text(TOML)
    c = read_config(str(f))
    assert c.repeat is None and c.group_by_ani is None and c.indel.rolling_mean_window is None and c.minimum_size.collapse == 500
    assert preset("HiFi") == Config() and preset("R9").cov.rolling_mean_window == 11
    m = read_config(str(f), "ont_r10")
    assert m.indel.min_ins_size == 10 and m.indel.ratio_indel == 0.25 and m.minimum_size.false_dupe == 2
    with pytest.raises(ValueError):
        preset("sanger")
    with pytest.raises(ValueError):
        Config.from_toml("[general]\nbp_merge = 1")


def test_cigar_rules():
    def b(cigar, start, min_ins, min_del):
        _, kind, at, n = pileup.parse_cigars([cigar], np.array([start]), min_ins, min_del)
        return [(pileup.OPS[k], a, m) for k, a, m in zip(kind, at.tolist(), n.tolist())]

    assert b("3S5=1X2I4=3D2=", 10, 2, 2) == [("S", 10, 1), ("C", 10, 5), ("X", 15, 1), ("I", 16, 1), ("C", 16, 4), ("D", 20, 3), ("C", 23, 2)]
    assert b("2M1D1I2M5N1M2H", 1, 2, 2) == [("C", 1, 2), ("C", 3, 1), ("C", 4, 2), ("C", 11, 1)]
    assert b(None, 1, 2, 2) == b("*", 1, 2, 2) == b("", 1, 2, 2) == b("0M5Z", 1, 2, 2) == []
    assert b("10M12Q3M", 5, 2, 2) == [("C", 5, 10), ("C", 15, 3)]
    row, kind, at, n = pileup.parse_cigars(["2M", None, "1S3X", "100000D1="], np.array([1, 5, 7, 20]), 2, 2)
    assert row.tolist() == [0, 2, 2, 3, 3] and at.tolist() == [1, 7, 7, 20, 100020] and n.tolist() == [2, 1, 3, 100000, 1]


def plain_pileup(reads, st, end, median=False, min_size=2):
    """Base by base, read by read."""
    import math
    import re
    import statistics

    out = {p: {"cov": 0, "mismatch": 0, "indel": 0, "softclip": 0, "q": []} for p in range(st, end + 1)}
    for start, cigar, mapq in reads:
        at = start
        for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
            n = int(n)
            covers = op in "M=X" or op == "D" and n < min_size
            for p in range(at, at + n) if op in "M=XD" else [at] if op == "S" or op == "I" and n >= min_size else []:
                if p in out:
                    out[p]["cov"] += covers
                    out[p]["mismatch"] += op == "X"
                    out[p]["indel"] += op == "I" or op == "D" and not covers
                    out[p]["softclip"] += op == "S"
                    if covers:
                        out[p]["q"].append(mapq or 0)
            if op in "M=XDN":
                at += n
    mean = lambda q: 0 if not q else math.ceil(statistics.median(q)) if median else -(-sum(q) // len(q))
    return {p: (x["cov"], x["mismatch"], max(x["q"], default=0), mean(x["q"]), x["indel"], x["softclip"]) for p, x in out.items()}


def test_pileup_by_ends(spark, monkeypatch):
    """Against a plain count, over several tiles, with reads that begin and end outside the region."""
    monkeypatch.setattr(pileup, "TILE", 64)
    r = random.Random(3)
    reads = []
    for _ in range(300):
        ops = [(r.randint(1, 40), r.choice("M=XDIN")) for _ in range(r.randint(1, 9))]
        reads.append((r.randint(1, 400), f"{r.randint(1, 5)}S" * r.randint(0, 1) + "".join(f"{n}{o}" for n, o in ops), r.choice([None, 0, 7, 30, 60])))
    frame = spark.createDataFrame([("c", *x) for x in reads], "chrom string, start int, cigar string, mapq int").repartition(3)
    regions = spark.createDataFrame([("a", "c", 50, 300), ("b", "c", 128, 191), ("d", "other", 5, 5)], "region_id string, chrom string, st long, end long")
    for how in ("Mean", "Median"):
        got = pileup.pileup(frame, regions, mapq_agg=how).collect()
        assert len(got) == 251 + 64 + 1
        for region, st, end in (("a", 50, 300), ("b", 128, 191)):
            own = {x.pos: (x.cov, x.mismatch, x.mapq_max, x.mapq, x.indel, x.softclip) for x in got if x.region_id == region}
            assert own == plain_pileup(reads, st, end, how == "Median")
    assert [x.cov for x in got if x.region_id == "d"] == [0]


def test_tiles_change_nothing(spark, monkeypatch):
    """Rolling means, runs of statuses and rolling medians are the same however the axis is cut."""
    from basewright.operators import classify, intervals

    r = random.Random(8)
    rows, status, pos = [], "good", 0
    for _ in range(600):
        pos += r.choice([1] * 30 + [2, 5])
        status = status if r.random() < 0.9 else r.choice(["good", "good", "indel", "misjoin"])
        rows.append((r.choice("r"), pos // 211, pos, r.randint(0, 40), status))
    frame = spark.createDataFrame(rows, "region_id string, bin long, pos long, cov long, status string").withColumn("level", F.lit(20))
    dense = spark.createDataFrame([("a", p, float(r.randint(0, 9))) for p in range(40, 400)], "region_id string, pos long, x double")

    def made():
        keep = lambda df: sorted(map(str, df.collect()))
        return (
            keep(classify.status_intervals(frame)), keep(classify.above_runs(frame, "level")), keep(classify.rolling_stats(frame, 50).selectExpr("region_id", "bin", "pos", "roll_median", "round(roll_stdev, 9)")),
            keep(pileup.rolling_mean(dense, {"x": 11}, dense=True)), keep(pileup.rolling_mean(dense, {"x": 4}, dense=True)),
        )

    want = made()
    assert want[3:] == tuple(sorted(map(str, pileup.rolling_mean(dense, {"x": n}).collect())) for n in (11, 4))
    own = [x for x in rows if x[1] == 0]
    plain, near = [], None
    for k, (_, _, p, cov, status) in enumerate(own):
        now = p - (own[k - 1][2] if k else 0) <= 1
        if k and near == now and plain[-1][2] == status:
            plain[-1] = (plain[-1][0], p + 1, status, [*plain[-1][3], cov])
        else:
            plain.append((p, p + 1, status, [cov]))
        near = now
    assert sorted((x.st, x.end, x.status, x.cov) for x in classify.status_intervals(frame).filter("bin = 0").collect()) == [(a, b, c, sum(d) // len(d)) for a, b, c, d in plain]
    for tile in (7, 64):
        monkeypatch.setattr(intervals, "TILE", tile)
        monkeypatch.setattr(pileup, "TILE", tile)
        monkeypatch.setattr(classify, "CHUNK", tile)
        assert made() == want


def test_pileup_means(spark):
    q = [60] * 5 + [18, 34, 60, 35, 60, 60, 33, 30, 60, 33, 34, 33, 31, 33, 36, 32, 32, 60, 35, 33, 36, 31, 35, 35, 33, 33, 34, 35, 60, 33] + [60] * 6
    reads = spark.createDataFrame([("c", 8, "3=", m) for m in q] + [("c", 9, "1=", None)], "chrom string, start int, cigar string, mapq int").filter("mapq is not null")
    regions = spark.createDataFrame([(0, "c", 7, 11)], "region_id long, chrom string, st long, end long")
    rows = {r.pos: r for r in pileup.pileup(reads, regions).collect()}
    assert len(rows) == 5 and rows[8].cov == 41 and rows[8].mapq == 45 and rows[8].mapq_max == 60 and rows[7].cov == 0 and rows[11].mapq == 0
    median = {r.pos: r for r in pileup.pileup(reads, regions, mapq_agg="Median").collect()}
    assert median[8].mapq == 35


def test_rolling_mean(spark):
    frame = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate([40, 0, 38])], "region_id int, pos int, indel double")
    assert [r.indel for r in pileup.rolling_mean(frame, {"indel": 3}).orderBy("pos").collect()] == [20.0, 26.0, 19.0]


def test_peaks(spark):
    frame = spark.createDataFrame([(0, i, x) for i, x in enumerate([30, 60, 30, 0, 30])], "g int, pos int, x int")
    assert [r.x_peak for r in peaks.find_peaks(frame, {"x": (1.5, 1.5, False)}, ["g"]).orderBy("pos").collect()] == ["null", "high", "null", "low", "null"]
    alone = spark.createDataFrame([(0, 0, 0), (0, 1, 7)], "g int, pos int, x int")
    assert [(r.x, r.x_peak) for r in peaks.find_peaks(alone, {"x": (5.0, 5.0, True)}, ["g"]).orderBy("pos").collect()] == [(None, "null"), (7, "high")]


@pytest.mark.parametrize(
    ("rows", "distance", "even", "want"),
    [
        ([(1, 2, 1), (3, 5, 2), (6, 9, 3)], 0, False, [(1, 2, 1), (3, 5, 2), (6, 9, 3)]),
        ([(1, 3, 1), (3, 5, 2), (6, 9, 3)], 0, False, [(1, 5, 1), (6, 9, 3)]),
        ([(1, 3, 1), (6, 9, 3), (3, 6, 2)], 0, False, [(1, 9, 1)]),
        ([(1, 2, 2), (3, 4, 2), (5, 6, 3)], 1, True, [(1, 4, 2), (5, 6, 3)]),
    ],
)
def test_merge_intervals(spark, rows, distance, even, want):
    frame = spark.createDataFrame([(0, *r, i) for i, r in enumerate(rows)], "g int, st int, end int, m int, ord int")
    joins = (lambda before: (before("m") % 2 == 0) & (F.col("m") % 2 == 0)) if even else None
    assert [(r.st, r.end, r.m) for r in merge_intervals(frame, ["g"], distance, joins).orderBy("st").collect()] == want


@pytest.mark.parametrize(
    ("one", "others", "want"),
    [
        ((4, 8), [(1, 3)], [(4, 8)]), ((4, 8), [(1, 5)], [(5, 8)]), ((4, 8), [(6, 10)], [(4, 6)]), ((4, 8), [(5, 7)], [(4, 5), (7, 8)]),
        ((4, 8), [(4, 8)], []), ((1, 10), [(2, 4), (5, 7), (9, 10)], [(1, 2), (4, 5), (7, 9)]), ((4, 8), [(1, 10)], []),
    ],
)
def test_subtract(spark, one, others, want):
    frame = spark.createDataFrame([("c", *one)], "chrom string, st long, end long")
    cuts = spark.createDataFrame([("c", *o) for o in others], "chrom string, st long, end long")
    assert [(r.st, r.end) for r in subtract(frame, cuts, ["chrom"]).orderBy("st").collect()] == want


@pytest.mark.parametrize(
    ("seq", "want"),
    [
        ("TTAGCAGCAGCCCG", ("repeat", "AGCAGC", 0.64285713)), ("ATATATATATC", ("repeat", "ATATATAT", 0.90909094)), ("CCACTTGCAGAC", None),
        ("CCACATTGCAGAC", ("repeat", "CA", 0.30769232)), ("AAAAAAAAAACCCC", ("homopolymer", "AAAAAAAAA", 0.71428573)), ("GNNNNNNA", ("scaffold", "NNNNN", 0.75)), ("", None), (None, None), ("A", None),
    ],
)
def test_repeats(seq, want):
    got = largest_repeat(seq)
    assert got == want if want is None else got[:2] == want[:2] and abs(got[2] - want[2]) < 1e-6


def test_precedence(spark):
    pairs = spark.createDataFrame([("softclip", "collapse"), ("collapse", "softclip"), ("indel", "good"), ("indel", "misjoin"), ("good", "good"), ("misjoin", "softclip"), ("softclip", "misjoin"), ("repeat", "repeat")], "a string, b string")
    assert [r[0] for r in pairs.select(over(F.col("a"), F.col("b"))).collect()] == [True, True, True, False, False, True, False, False]


def test_folds_over_tiles(spark, monkeypatch):
    """Runs over many tiles have the values of a fold from the left; long ones too, where half means forget what they began with."""
    from basewright.functions.status import COLOURS, OVER
    from basewright.operators import intervals

    over_ = lambda a, b: b in OVER.get(a, ()) or b == "good" != a
    r = random.Random(5)
    for tile, n, gap in ((16, 300, 9), (1 << 16, 300, 9), (50, 400, 1000), (7, 200, -1)):
        monkeypatch.setattr(intervals, "TILE", tile)
        rows, at = [], 0
        for k in range(n):
            at += r.choice([1, 2, 3, 15, 40])
            rows.append((k % 2, "c", k % 7 // 6, at, at + r.randint(1, 12), k, r.choice(list(COLOURS)), r.choice([0, 1, 7, (1 << 31) - 1, r.randint(0, 1 << 20)])))
        frame = spark.createDataFrame(rows, "region_id long, chrom string, bin int, st long, end long, ord long, status string, cov long").repartition(5)
        want = []
        for g in (0, 1):
            own = []
            for _, _, _, st, end, _, status, cov in [x for x in rows if x[0] == g and x[6] != "good"]:
                if own and st - own[-1][1] <= gap:
                    own[-1] = [own[-1][0], end, own[-1][2] if over_(own[-1][2], status) else status, (own[-1][3] + cov) // 2]
                else:
                    own.append([st, end, status, cov])
            want += [(g, *x) for x in own]
        assert sorted(tuple(x) for x in merge.merge_bad(frame, gap).select("region_id", "st", "end", "status", "cov").collect()) == sorted(want)
        chunks = []
        for g in (0, 1):
            own, last = [], None
            for _, _, b, st, end, _, status, cov in [x for x in rows if x[0] == g]:
                key = (status in merge.MERGEABLE, b)
                if own and key[0] and key == last:
                    own[-1] = [own[-1][0], max(own[-1][1], end), own[-1][2] if over_(own[-1][2], status) else status, own[-1][3] + cov, own[-1][4] + 1]
                else:
                    own.append([st, end, status, cov, 1])
                last = key
            chunks += [(g, st, end, status, cov // k) for st, end, status, cov, k in own]
        none = spark.createDataFrame([], "region_id long, bin int, above_st long, above_end long")
        assert sorted(tuple(x) for x in merge.merge_chunks(frame, none).select("region_id", "st", "end", "status", "cov").collect()) == sorted(chunks)


def test_one_island_of_many_intervals(spark):
    """Half a million intervals of one run: no group holds more than a tile of them."""
    n = 500_000
    frame = spark.range(n).selectExpr("1L as region_id", "id * 10 as st", "id * 10 + 5 as end", "id as ord", "if(id % 3 = 0, 'collapse', 'softclip') as status", "id % 97 as cov")
    (got,) = merge.merge_bad(frame, 10).collect()
    cov = 0
    for k in range(1, n):
        cov = (cov + k % 97) // 2
    assert (got.st, got.end, got.status, got.cov) == (0, n * 10 - 5, "collapse", cov)


def rows_made(df):
    """The most rows that a step of a frame's plan made as it ran."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        below = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(n) for n in range(node.children().size())]
        todo += below
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
    return most


def test_regions_and_parts_without_pairs(spark):
    """Regions that overlap parts get the least reason, whatever the ranges; many regions over many parts don't meet in pairs."""
    r = random.Random(8)
    span = lambda far, size: (lambda at: (at, at + r.choice([0, 1, 7, size, r.randrange(size), -r.randrange(9)])))(r.randrange(-far, far))
    ranges = lambda n, far, size: [(r.choice("cd"), *span(far, size)) for _ in range(n)]
    for far, size in ((30, 12), (3000, 900), (10**8, 10**8)):
        mine = [*ranges(150, far, size), (None, 1, 5), ("c", None, 5), ("c", 5, None)]
        parts = [(*x, f"e{r.randrange(99)}") for x in [*ranges(60, far, size), ("c", None, 3), ("c", 3, None)]]
        found = spark.createDataFrame([(n // 2, *mine[n // 3]) for n in range(3 * len(mine))], "region_id long, chrom string, st long, end long")
        some = spark.createDataFrame(parts, "chrom string, start long, until long, error string")
        whole = lambda x: None not in x
        want = {x: min(e) for x in {(n // 2, *mine[n // 3]) for n in range(3 * len(mine))} if whole(x) if (e := [p[3] for p in parts if whole(p) and p[0] == x[1] and p[1] <= x[3] and x[2] <= p[2]])}
        got = [tuple(x) for x in api.broken_regions(found, some).collect()]
        assert {x[:4]: x[4] for x in got} == want and len(got) == len(want) > 20
        hit = range_join(found, some.toDF("chrom", "b_st", "b_end", "error"), ["chrom"], ("st", "end"), ("b_st", "b_end"), "left_semi")
        assert sorted(map(tuple, hit.select(found.columns).collect())) == sorted(y for n in range(3 * len(mine)) if (y := (n // 2, *mine[n // 3])) in want)
    n = 3000
    found = spark.range(n).selectExpr("id as region_id", "'c' as chrom", "id as st", "id + 9000 as end")
    some = spark.range(n).selectExpr("'c' as chrom", "id + 2000 as start", "id + 5000 as until", "'block ' || id as error")
    assert rows_made(api.broken_regions(found, some)) < 60 * n  # pairs are n * n
    anywhere = some.unionByName(spark.createDataFrame([("", None, None, "a")], "chrom string, start long, until long, error string"))
    assert {x.error for x in api.broken_regions(found, anywhere).collect()} == {"a"}


def test_bed_and_tiles(spark):
    lines = spark.createDataFrame([("a\t1\t5",), ("a\tx\t5",), ("short\t1",), ("b\t2\t9\tn\tmore",), (None,)], "value string")
    assert sorted(map(str, map(tuple, parse_bed(lines).collect()))) == ["('a', 1, 5, None)", "('b', 2, 9, 'n\\tmore')"]
    contigs = spark.createDataFrame([("a", 10), ("b", 25)], "chrom string, length long")
    assert sorted(tuple(r) for r in tiles(contigs, 10).collect()) == [("a", 0, 10), ("a", 10, 10), ("b", 0, 10), ("b", 10, 20), ("b", 20, 25)]


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a\nACGT\nACGT\nAC\n>b\nTT\n")
    (tmp_path / "x.fa.fai").write_text("a\t10\t3\t4\t5\nb\t2\t19\t4\t5\n")
    assert sorted(tuple(r) for r in read_fasta(spark, str(tmp_path / "x.fa"), 6).collect()) == [("a", 1, "ACGTAC"), ("a", 7, "GTAC"), ("b", 1, "TT")]


def test_tables_of_reads(spark, tmp_path):
    """Regions prune the table's parts at run time, as the plan says."""
    from basewright.sources.reads import read_reads, write_reads

    r = random.Random(8)
    rows = [(r.choice(["a", "b", "c"]), r.randint(1, 50_000), r.choice(["50=", "3S10M2D5I100=4X7H", "20=900N30=", "5S"]), r.randint(0, 60)) for _ in range(2000)]
    rows += rows[:20]
    path = str(tmp_path / "t")
    write_reads(spark.createDataFrame(rows, "chrom string, start int, cigar string, mapq int"), path, 1000)
    span = {"50=": 50, "3S10M2D5I100=4X7H": 116, "20=900N30=": 950, "5S": 0}
    regions = spark.createDataFrame([(1, "a", 7000, 7100), (2, "c", 1, 1), (3, "c", 30_500, 30_500), (4, "d", 1, 9)], "region_id long, chrom string, st long, end long")
    found = read_reads(spark, path, regions)
    wanted = regions.collect()
    want = [x for x in rows if any(x[0] == c and x[1] <= b and x[1] + span[x[2]] - 1 >= a for _, c, a, b in wanted)]
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 5
    assert sorted(map(tuple, read_reads(spark, path).collect())) == sorted(rows)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()


def test_blocked_gzip_fasta(spark, tmp_path, monkeypatch):
    """Chunks of a file of blocked gzip are those of its plain text; a chunk inflates its own blocks alone."""
    from basewright.sources.fasta import Unzipped

    r = random.Random(4)
    seqs = {"a": "".join(r.choices("ACGT", k=9000)), "b": "".join(r.choices("acgtN", k=4000)), "c": "T"}
    text, index = "", ""
    for name, seq in seqs.items():
        text += f">{name}\n"
        index += f"{name}\t{len(seq)}\t{len(text)}\t60\t61\n"
        text += "".join(seq[i : i + 60] + "\n" for i in range(0, len(seq), 60))
    (tmp_path / "x.fa").write_text(text)
    out, starts = b"", []
    for i in range(0, len(text), 700):
        starts += [(len(out), i)] * (i > 0)
        out += bam_block(text[i : i + 700].encode())
    (tmp_path / "x.fa.gz").write_bytes(out + bam_block(b""))
    (tmp_path / "x.fa.gz.gzi").write_bytes(struct.pack("<Q", len(starts)) + b"".join(struct.pack("<QQ", *x) for x in starts))
    for name in ("x.fa.fai", "x.fa.gz.fai"):
        (tmp_path / name).write_text(index)
    plain, packed = (sorted(map(tuple, read_fasta(spark, str(tmp_path / name), 1000).collect())) for name in ("x.fa", "x.fa.gz"))
    assert plain == packed and "".join(x[2] for x in packed if x[0] == "a") == seqs["a"]
    seen = ranges_read(monkeypatch)
    with open(tmp_path / "x.fa.gz", "rb") as f:
        z = Unzipped(f, (tmp_path / "x.fa.gz.gzi").read_bytes())
        for place, n in ((5000, 10), (699, 2), (0, 5), (len(text) - 3, 3), (700, 700)):
            seen.clear()
            assert z.read(place, n) == text[place : place + n].encode() and len(set(seen)) <= 2


def bam_record(ref, pos, mapq, ops, flag=0, tags=b"", l_seq=0):
    body = struct.pack("<iiBBHHHiiii", ref, pos, 2, mapq, 0, len(ops), flag, l_seq, -1, -1, 0) + b"r\0" + b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in ops)
    body += b"\0" * ((l_seq + 1) // 2 + l_seq) + tags
    return struct.pack("<i", len(body)) + body


def bam_block(data):
    raw = gzip.compress(data)
    size = len(raw) + 8 - 1
    return raw[:3] + b"\4" + raw[4:10] + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, size) + raw[10:]


def bins_of(st, end, shift=14, depth=5):
    """The smallest bin that holds [st, end)."""
    for level in range(depth, 0, -1):
        at = shift + 3 * (depth - level)
        if st >> at == end - 1 >> at:
            return ((1 << 3 * level) - 1) // 7 + (st >> at)
    return 0


def bam_file(path, contigs, reads, per_block=1, depth=5, csi=False):
    """Reads (ref, start from 0, mapq, ops, ...) in order, so many a block, and an index."""
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(contigs)) + b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in contigs)
    out, linear, bins = bam_block(head), [{} for _ in contigs], [{} for _ in contigs]
    reads = sorted(reads, key=lambda r: r[:2])
    for k in range(0, len(reads), per_block):
        block, base = b"", len(out) << 16
        for r in reads[k : k + per_block]:
            size = max(1, sum(n for n, o in (r[3] if not (len(r) > 5 and b"CGBI" in r[5]) else [(93, "M")]) if o in "MDN=X"))
            begin = base | len(block)
            block += bam_record(*r)
            for w in range(r[1] >> 14, (r[1] + size - 1 >> 14) + 1):
                linear[r[0]].setdefault(w, begin)
            number = bins_of(r[1], r[1] + size, 14, depth)
            bins[r[0]].setdefault(number, []).append((begin, base | len(block)))
        out += bam_block(block)
    path.write_bytes(out + bam_block(b""))
    index = b"CSI\1" + struct.pack("<iiii", 14, depth, 0, len(contigs)) if csi else b"BAI\1" + struct.pack("<i", len(contigs))
    for own, first in zip(bins, linear):
        full = [first.get(w, 0) for w in range(max(first, default=-1) + 1)]
        index += struct.pack("<i", len(own) + 1)
        for number, chunks in own.items():
            if csi:
                level = max(lv for lv in range(depth + 1) if ((1 << 3 * lv) - 1) // 7 <= number)
                w = number - ((1 << 3 * level) - 1) // 7 << 3 * (depth - level)
                least = min([v for k, v in first.items() if w <= k < w + (1 << 3 * (depth - level))])
            index += struct.pack("<IQi", number, least, len(chunks)) if csi else struct.pack("<Ii", number, len(chunks))
            index += b"".join(struct.pack("<QQ", *c) for c in chunks)
        beyond = ((1 << 3 * (depth + 1)) - 1) // 7 + 1  # counts, no bin
        index += (struct.pack("<IQi", beyond, 0, 2) if csi else struct.pack("<Ii", beyond, 2)) + struct.pack("<4Q", 1, 2, 3, 4)
        if not csi:
            index += struct.pack(f"<i{len(full)}Q", len(full), *full)
    path.with_name(path.name + (".csi" if csi else ".bai")).write_bytes(bam_block(index) if csi else index)
    return str(path)


def test_bam(spark, tmp_path):
    from basewright.sources.bam import bam_contigs, read_bam

    reads = [(0, 4, 60, [(5, "=")]), (0, 9, 1, [(2, "S"), (3, "M")]), (0, 9, 1, [(3, "M")], 4)]
    many = [(1, i * 331, i % 61, [(i % 7 + 1, "S"), (900, "=")]) for i in range(300)]
    ops = struct.pack("<4I", 7 << 4 | 4, 50 << 4 | 7, 3 << 4 | 2, 40 << 4 | 7)
    long = (0, 40, 9, [(97, "S"), (93, "N")], 0, b"NMi\1\0\0\0XXZab\0CGBI" + struct.pack("<i", 4) + ops, 97)
    path = bam_file(tmp_path / "x.bam", [("ctg", 1000), ("big", 120_000)], reads + many + [long])
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(read_bam(spark, path).filter("chrom = 'ctg'")) == [("ctg", 5, "5=", 60), ("ctg", 10, "2S3M", 1), ("ctg", 41, "7S50=3D40=", 9)]
    big = sorted(("big", s + 1, "".join(f"{n}{o}" for n, o in ops), q) for _, s, q, ops in many)
    assert rows(read_bam(spark, path).filter("chrom = 'big'")) == big == rows(read_bam(spark, "file://" + path).filter("chrom = 'big'"))
    assert rows(read_bam(spark, path).filter("chrom = 'big' and start >= 20000 and start < 40000")) == [r for r in big if 20000 <= r[1] < 40000]
    for wanted in ([("big", 20000, 20010)], [("big", 16385, 16385), ("big", 16400, 17000), ("big", 90000, 200000)], [("ctg", 1, 9), ("big", 1, 1)], [("none", 1, 5)]):
        hit = [r for r in [("ctg", 5, "5=", 60), ("ctg", 10, "2S3M", 1), ("ctg", 41, "7S50=3D40=", 9), *big] if any(c == r[0] and r[1] <= end and r[1] + {"5=": 5, "2S3M": 3}.get(r[2], 93 if r[0] == "ctg" else 900) - 1 >= st for c, st, end in wanted)]
        assert rows(read_bam(spark, path, wanted)) == sorted(hit), wanted
    assert {(r.chrom, r.length) for r in bam_contigs(spark, path).collect()} == {("ctg", 1000), ("big", 120_000)}


def ranges_read(monkeypatch):
    """Counts the blocks that are inflated."""
    from basewright.sources import bam

    seen, plain = [], bam.Bgzf._load
    monkeypatch.setattr(bam.Bgzf, "_load", lambda self, offset: seen.append(offset) or plain(self, offset))
    return seen


def test_bins_and_csi(spark, tmp_path, monkeypatch):
    """A contig of 600 Mb by a CSI index of depth 6; a region reads the blocks of its bins alone, with a start and an end."""
    from basewright.sources import bam

    r = random.Random(3)
    contigs = [("long", 600_000_000), ("none", 5000), ("short", 90_000)]
    reads = [(0, s, 60, [(r.choice([80, 5000, 300_000]), "M")]) for s in sorted(r.sample(range(599_000_000), 3000))] + [(2, s, 7, [(50, "M")]) for s in range(0, 80_000, 100)]
    path = bam_file(tmp_path / "x.bam", contigs, reads, per_block=3, depth=6, csi=True)
    spans = [(contigs[c][0], s + 1, s + ops[0][0], q) for c, s, q, ops in reads]
    blocks = (len(reads) + 2) // 3
    seen = ranges_read(monkeypatch)
    for wanted in ({"long": [[550_000_000, 550_400_000]]}, {"long": [[1, 2_000_000], [599_500_000, 600_000_000]], "short": [[5000, 5100]]}, {"short": [[89_000, 90_000]]}):
        seen.clear()
        reader = bam.BamReader({"path": path, "regions": json.dumps(wanted)})
        parts = reader.partitions()
        got = sorted((chrom, st, int(cigar[:-1]) + st - 1, q) for p in parts for chrom, st, cigar, q in reader.read(p))
        assert got == sorted(x for x in spans if any(x[1] <= end and x[2] >= st for st, end in wanted.get(x[0], [])))
        assert len(set(seen)) < blocks / 8 and all(end > st for p in parts for st, end in p.stretches)
    whole = sorted((x.chrom, x.start, x.mapq) for x in bam.read_bam(spark, path).collect())
    assert whole == sorted((c, st, q) for c, st, _, q in spans)
    with pytest.raises(ValueError, match="CSI"):
        bam.Index((tmp_path / "x.bam.csi").read_bytes()).stretches(0, 0, 1 << 40)
    # the same reads of a contig that a BAI holds give the same rows
    near = [x for x in reads if x[1] < 500_000_000]
    short = bam_file(tmp_path / "y.bam", [("long", 500_000_000), *contigs[1:]], near, per_block=5)
    some = [("long", 100_000_000, 101_000_000), ("short", 1, 50), ("long", 499_990_000, 500_000_000)]
    assert sorted((x.chrom, x.start, x.mapq) for x in bam.read_bam(spark, short, some).collect()) == sorted((c, st, q) for c, st, end, q in spans if st <= 500_000_000 and any(c == n and st <= b and end >= a for n, a, b in some))


def test_broken_block(spark, tmp_path):
    """One corrupt block: regions that its reads overlap are named, all others are called."""
    from basewright.sources import bam

    reads = [(c, s, 60, [(50, "=")]) for c in (0, 1) for s in range(0, 3_000_000, 900)]
    path = bam_file(tmp_path / "a.bam", [("c", 3_000_100), ("d", 3_000_100)], reads, per_block=50)
    raw = bytearray((tmp_path / "a.bam").read_bytes())
    index = bam.read_index(path)
    at = index.stretches(0, 1_500_000, 1_500_001)[0][0] >> 16
    raw[at + 30 : at + 40] = bytes(10)
    (tmp_path / "a.bam").write_bytes(raw)
    (tmp_path / "r.bed").write_text("c\t100\t2000\nc\t1499000\t1501000\nd\t1499000\t1501000\nc\t2990000\t2991000\ne\t1\t5\n")
    calls = api.call_file(spark, path, bed=str(tmp_path / "r.bed"))
    errors = {(x.chrom, x.st): x.error for x in calls.errors.collect()}
    assert set(errors) == {("c", 1499000), ("e", 1)} and "Error" in errors["c", 1499000]
    assert {(x.chrom, x.chromStart) for x in calls.regions.collect()} >= {("c", 100), ("d", 1499000), ("c", 2990000)}
    assert {x.chrom for x in calls.pileup.filter("pos between 1499000 and 1501000").select("chrom").distinct().collect()} == {"d"}
    with pytest.raises(ValueError, match="Error"):
        api.call_region(spark, path, (1_499_000, 1_501_000, "c"))
    with pytest.raises(Exception, match="(?i)error"):
        bam.read_bam(spark, path).count()


def test_files_and_command_line(spark, tmp_path, capsys):
    from basewright.__main__ import main as command

    reads = [(0, s, 60, [(50, "=")]) for s in [*range(0, 400, 2), *range(600, 950, 2)]]
    path = bam_file(tmp_path / "a.bam", [("c", 1000)], reads)
    (tmp_path / "r.bed").write_text("c\t100\t900\nc\t100\t900\nd\t5\t10\nc\t9\t5\n")
    (tmp_path / "i.bed").write_text("c\t390\t620\n")
    (tmp_path / "x.fa").write_text(">c\n" + "ACGT" * 250 + "\n")
    (tmp_path / "x.fa.fai").write_text("c\t1000\t3\t1000\t1001\n")
    calls = api.call_file(spark, path, bed=str(tmp_path / "r.bed"))
    got = calls.regions.orderBy("chromStart").collect()
    assert got[0].chromStart == 100 and got[-1].chromEnd == 901 and any(r.name == "misjoin" for r in got)
    assert sorted((r.chrom, r.st, r.error) for r in calls.errors.collect()) == [("c", 9, "end before start"), ("d", 5, "unknown contig")]
    one = api.call_region(spark, path, (100, 900, "c"))
    strip = lambda df: sorted(map(str, df.drop("region_id").collect()))
    assert strip(one.regions) == strip(calls.regions) and strip(one.pileup) == strip(calls.pileup)
    with pytest.raises(ValueError, match="unknown contig"):
        api.call_region(spark, path, (1, 5, "none"))
    with_sequence = api.call_file(spark, path, str(tmp_path / "x.fa"), str(tmp_path / "r.bed"), str(tmp_path / "i.bed"))
    assert {r.name for r in with_sequence.regions.collect()} == {"good"}
    assert "repeat" in {r.name for r in api.call_file(spark, path, str(tmp_path / "x.fa"), str(tmp_path / "r.bed")).regions.collect()}
    assert command([path, "--bed", str(tmp_path / "r.bed"), "--out", str(tmp_path / "out"), "--pileup", str(tmp_path / "bases")]) == 0
    assert "left out: d:5-10: unknown contig" in capsys.readouterr().err
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[0].startswith("#chrom\tchromStart") and len([x for x in lines if x[0] != "#"]) == len(got)
    assert command([path, "--bed", str(tmp_path / "r.bed")]) == 0
    assert capsys.readouterr().out.splitlines()[0] == lines[0] and len(got) > 2
    assert command([path, "--show-config", "--preset", "hifi"]) == 0 and "bp_merge" in capsys.readouterr().out
    whole = api.call_file(spark, path)
    assert whole.pileup.count() >= 1000


def test_write_intervals(spark, tmp_path):
    from basewright.sources.bed import write_intervals, write_tsv

    frame = spark.createDataFrame([(5, 9, "b"), (1, 3, "a")], "st long, end long, name string")
    write_intervals(frame, str(tmp_path / "i"))
    assert sorted(x for f in (tmp_path / "i").glob("part-*") for x in f.read_text().splitlines()) == ["1\t3\ta", "5\t9\tb"]
    write_tsv(frame, str(tmp_path / "t"), ["st"], one_file=True)
    assert [f.read_text() for f in (tmp_path / "t").glob("part-*")] == ["st\tend\tname\n1\t3\ta\n5\t9\tb\n"]


def test_one_file_without_one_task(spark, tmp_path, monkeypatch):
    """Many sorted parts become the bytes that one task would have written, in pieces of any size; titles and tabs are quoted alike."""
    from basewright.sources import bed, files

    rows = [(i * 7919 % 5003, f"a\tb{i}" if i % 3 else "#x", None if i % 5 else i) for i in range(5000)]
    frame = spark.createDataFrame(rows, "`#at` long, name string, n long").repartition(5)
    frame.coalesce(1).sortWithinPartitions("#at").write.options(sep="\t", header=True, comment="\x01").csv(str(tmp_path / "small"))
    want = next((tmp_path / "small").glob("part-*")).read_bytes()
    for piece in (1 << 28, 1000):
        monkeypatch.setattr(files, "PIECE", piece)
        out = tmp_path / f"one{piece}"
        bed.write_tsv(frame, str(out), ["#at"], one_file=True)
        assert [f.read_bytes() for f in out.glob("part-*")] == [want]
        assert sorted(f.name for f in out.iterdir() if not f.name.startswith(".")) == ["part-00000.csv"]
    with pytest.raises(FileExistsError):
        files.join_parts(spark, str(tmp_path / "small"), str(out / "part-00000.csv"))
    bed.write_tsv(frame.limit(0), str(tmp_path / "none"), ["#at"], one_file=True)
    assert next((tmp_path / "none").glob("part-*")).read_bytes() == b"#at\tname\tn\n"
    bed.write_tsv(frame.limit(0), str(tmp_path / "bare"), header=False, one_file=True)
    assert next((tmp_path / "bare").glob("part-*")).read_bytes() == b""


def test_single_precision(spark):
    """In 32-bit floats each step is rounded, as plain arithmetic on floats does it."""
    f4, values = np.float32, [random.Random(i).uniform(0, 40) for i in range(301)]
    frame = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "g int, pos int, x double")
    v = np.array(values, "f4")
    mid = f4(np.median(v))
    scale = f4(np.median(np.abs(v - mid))) * f4(1.486)
    score = (v - mid) / scale
    got = peaks.find_peaks(frame, {"x": (1.0, float(score.max()), False)}, ["g"], single=True).orderBy("pos").collect()
    assert [f4(r.x_zscore) for r in got] == score.tolist()
    # at the greatest score itself nothing is above it
    assert [r.x_peak for r in got] == ["low" if z < -1 else "null" for z in score.tolist()]
    one = replace(Config(), compat_single=True)
    base = spark.createDataFrame([(0, 0, i, 10, 1, 0, 0, 60, 60) for i in range(50)] + [(0, 0, 50, 10, 9, 0, 0, 60, 60), (0, 0, 51, 0, 0, 0, 0, 0, 0)], "region_id int, bin int, pos long, cov long, mismatch long, indel long, softclip long, mapq int, mapq_max int")
    both = [sorted((r.pos, r.status) for r in classify.classify_bases(classify.signals(base, c), c).collect()) for c in (Config(), one)]
    assert both[0] == both[1] and {s for _, s in both[0]} == {"good", "low_quality", "misjoin"}
    kinds = dict(classify.signals(base, one).dtypes)
    assert kinds["cov_zscore"] == kinds["mapq_stdev"] == "float" and dict(classify.signals(base, Config()).dtypes)["cov_zscore"] == "double"


def test_regions_from_zero(spark):
    """No base 0; with the older labels position 1 is label 0 and a base without reads comes last."""
    reads = spark.createDataFrame([("c", s, "5=", 60) for s in range(1, 60)], "chrom string, start int, cigar string, mapq int")
    found = spark.createDataFrame([(0, "c", 0, 50), (1, "c", 10, 50)], "region_id long, chrom string, st long, end long")
    depth = lambda cfg: {(r.region_id, r.pos): r.cov for r in api.classified_pileup(reads, found, cfg).collect()}
    now, older = depth(Config()), depth(replace(Config(), compat_zero_start=True))
    true = {p: min(p, 5) for p in range(1, 51)}
    assert now == {(0, p): n for p, n in true.items()} | {(1, p): 5 for p in range(10, 51)}
    assert older == {(0, p - 1): n for p, n in true.items()} | {(0, 50): 0} | {(1, p): 5 for p in range(10, 51)}
    spec = Config.from_toml("compat_zero_start = true\n" + TOML)
    assert spec.compat_zero_start and not spec.compat_single and spec.merge(preset("hifi")).compat_zero_start


def test_gap_close_and_bins(spark, monkeypatch):
    frame = spark.createDataFrame([("r", i, 10 if i < 50 else 30) for i in range(100)], "region_id string, pos long, cov long")
    bins = spark.createDataFrame([("r", 1, 0, 30), ("r", 2, 40, 90)], "region_id string, bin long, st long, end long")
    assert sorted((r.st, r.end) for r in binning.close_gaps(frame, bins, 20).collect()) == [(0, 40), (40, 90)]
    got = {r.pos: r.bin for r in binning.assign_bins(frame, bins).collect()}
    assert got[30] == 1 and got[31] == 0 and got[39] == 2 and got[90] == 2 and got[91] == 0
    r = random.Random(2)
    cov = {i: r.randint(0, 50) for i in range(1, 600)}
    many = [(k + 1, 40 * k + r.randint(0, 9), 40 * k + r.randint(15, 30)) for k in range(14)]
    frame = spark.createDataFrame([("r", i, c) for i, c in cov.items()], "region_id string, pos long, cov long")
    bins = spark.createDataFrame([("r", *b) for b in many], "region_id string, bin long, st long, end long")
    median = lambda a, b: int(statistics.median(x)) if (x := [c for i, c in cov.items() if a <= i <= b]) else 0
    want = [list(b) for b in many]
    for left, right in zip(want, want[1:]):
        if right[1] - left[2] <= 18:
            gap = median(left[2], right[1])
            if abs(median(*left[1:]) - gap) < abs(median(*right[1:]) - gap):
                left[2] = right[1]
            else:
                right[1] = left[2]
    assert sorted([r.bin, r.st, r.end] for r in binning.close_gaps(frame, bins, 18).collect()) == want != [list(b) for b in many]
    monkeypatch.setattr(binning, "BUCKET", 32)
    got = {r.pos: r.bin for r in binning.assign_bins(frame, bins).collect()}
    assert got == {i: max((b for b, st, end in many if st - 1 <= i <= end), default=0) for i in cov}


def test_identity_bins(spark):
    """Windows of one repeated unit are alike and become a bin; random sequence doesn't, nor does a bin that is too short."""
    r = random.Random(6)
    some = lambda n: "".join(r.choices("ACGT", k=n))
    unit = some(100)
    seq = some(4000) + unit * 40 + some(4000) + unit * 12
    chunks = spark.createDataFrame([("c", i + 1, seq[i : i + 500]) for i in range(0, len(seq), 500)], "chrom string, start long, seq string")
    windows = chunks.selectExpr("1L as region_id", "start as st", "seq")
    pairs = {x.st: x.ident for x in binning.self_identity(windows, 500).collect() if x.j == x.i + 1}
    assert pairs[4501] > 99 and pairs.get(1, 0) < 80
    groups = binning.group_identity(binning.self_identity(windows, 500), 90.0)
    assert [(x.bin, x.st, x.end) for x in binning.number_groups(groups, 2000, 90.0).collect()] == [(1, 4001, 8001)]
    cfg = Config(group_by_ani=GroupByIdentity(window_size=500, min_grp_size=2000, min_ident=90.0))
    regions = spark.createDataFrame([(1, "c", 1, len(seq)), (2, "c", 1, 400)], "region_id long, chrom string, st long, end long")
    reads = spark.createDataFrame([("c", s, "300=", 60) for s in range(1, len(seq), 50)], "chrom string, start int, cigar string, mapq int")
    assert [(x.region_id, x.bin, x.st, x.end) for x in api.identity_bins(reads, regions, chunks, cfg).collect()] == [(1, 1, 4001, 8001)]
    calls = api.call_regions(reads, regions, cfg, chunks=chunks)
    assert {x.bin for x in calls.pileup.filter("region_id = 1").select("bin").distinct().collect()} == {0, 1}


def test_identity_of_all_windows(spark, monkeypatch):
    """Copies far apart, and copies of the other strand, become bins; the matrix is that of plain sets, however it is cut into blocks."""
    r = random.Random(11)
    some = lambda n: "".join(r.choices("ACGT", k=n))
    flip = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    unit = some(10 * 200)
    seq = some(200 * 5) + unit + some(200 * 40) + unit + some(200 * 7) + flip(unit) + some(200 * 3) + "N" * 200 + some(130)
    windows = spark.createDataFrame([(1, i + 1, seq[i : i + 200]) for i in range(0, len(seq), 200)] + [(2, i + 1, seq[i : i + 200]) for i in range(0, 2000, 200)], "region_id long, st long, seq string")
    groups = binning.group_identity(binning.self_identity(windows, 200, 90.0), 90.0)
    # the second copy stands 50 windows behind the first
    assert sorted((x.region_id, x.st, x.end, round(x.ident)) for x in groups.collect()) == [(1, 1001, 3001, 100), (1, 11001, 13001, 100), (1, 14401, 16401, 100)]
    near = binning.group_identity(binning.self_identity(windows, 200, 90.0, band=20), 90.0)
    assert sorted(x.st for x in near.collect()) == [11601, 14401]  # what is left of the second copy and its reverse within 20 windows

    def plain(x, k):
        own = [x[i : i + k] for i in range(len(x) - k + 1)]
        return {min(u, flip(u)) for u in own if set(u) <= set("ACGT")}

    sets = [plain(seq[i : i + 200], 9) for i in range(0, len(seq), 200)]
    want = {(i, j): (len(a & b) / min(len(a), len(b))) ** (1 / 9) * 100 for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if a & b and j - i <= 30}
    for block in (64, 7):
        monkeypatch.setattr(binning, "BLOCK", block)
        got = {(x.i, x.j): x.ident for x in binning.self_identity(windows.filter("region_id = 1"), 200, band=30, k=9, sketch=1).collect()}
        assert got == pytest.approx(want) and len(got) > 100
    assert binning.self_identity(windows.limit(0), 200).count() == 0
    text = "ACGTNacgtTTGCA"
    assert len(binning.kmers(text, 4, 1)) == len(plain(text.upper(), 4)) and len(binning.kmers("ACG", 4, 1)) == 0
    assert set(binning.kmers(seq, 21, 8)) == set(binning.kmers(flip(seq), 21, 8)) < set(binning.kmers(seq, 21, 1))


def test_identity_of_many_small_regions(spark):
    """Regions of a few windows share batches and products, whose ends may lie anywhere in a region; their pairs are those of plain sets."""
    r = random.Random(12)
    flip = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    unit = [x for _ in range(9) for x in ["".join(r.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=30))] * 2]
    made = {f"r{n}": [r.choice([flip, str, str.lower])(r.choice(unit))[: r.choice([30, 30, 4])] for _ in range(r.choice([1, 2, 3, 3, 5, 70, 140] if n % 20 == 0 else [1, 2, 3, 5]))] for n in range(300)} | {None: ["ACGTTGCATC", "é", None, "GATGCAACGT"]}
    rows = [(name, 5 + 30 * n, x) for name, own in made.items() for n, x in enumerate(own)]
    r.shuffle(rows)
    windows = spark.createDataFrame(rows, "region_id string, st long, seq string")
    cut = lambda x, k: {min(u, flip(u)) for p in range(len(x or "") - k + 1) if set(u := x[p : p + k].upper()) <= set("ACGT")}
    want = {}
    for name, own in made.items():
        sets = [cut(x, 5) for x in own]
        for j, b in enumerate(sets):
            for i in range(max(0, j - 80), j):
                if (a := sets[i]) & b and (ident := (len(a & b) / min(len(a), len(b))) ** 0.2 * 100) > 70:
                    want[name, i, j, 5 + 30 * i, 5 + 30 * i + len(own[i]), 5 + 30 * j, 5 + 30 * j + len(own[j])] = ident
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("3", before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            pairs = binning.self_identity(windows, 30, 70.0, band=80, k=5, sketch=1)
            got = pairs.collect()
            assert {tuple(x)[:7]: x.ident for x in got} == pytest.approx(want) and len(got) == len(want) > 500
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    # no region is a group, that is a message to Python, of its own
    assert "FlatMapGroupsInArrow" not in pairs._jdf.queryExecution().toString()
    assert binning._pieces(np.array([2, 62, 1, 70, 3, 3]), 64) == [0, 2, 3, 4, 6] and binning._pieces(np.array([]), 64) == [0]


def test_check_repeats(spark):
    itvs = spark.createDataFrame([(1, "c", 20, 30, 1, "misjoin"), (1, "c", 60, 70, 2, "indel"), (1, "c", 100, 110, 3, "indel"), (1, "c", 140, 150, 4, "collapse"), (1, "d", 5, 9, 5, "misjoin")], "region_id long, chrom string, st long, end long, ord long, own_status string").withColumn("status", F.col("own_status"))
    r = random.Random(1)
    seq = list("".join(r.choices("ACGT", k=200)))
    seq[14:36], seq[54:76], seq[134:156] = "N" * 22, "A" * 22, "AC" * 11
    seq[94:116] = "ACGTTGCATCGGATCCTAGATC"
    seq = "".join(seq)
    for size in (7, 1000):
        chunks = spark.createDataFrame([("c", i + 1, seq[i : i + size]) for i in range(0, len(seq), size)], "chrom string, start long, seq string")
        got = {x.ord: x.status for x in merge.check_repeats(itvs, chunks, Config()).collect()}
        assert got == {1: "scaffold", 2: "homopolymer", 3: "indel", 4: "collapse", 5: "misjoin"}


def test_longest_repeat_of_long_sequences():
    from basewright.operators.repeats import longest_repeat

    def plain(seq):
        best = ""
        for n in range(1, len(seq)):
            seen = set()
            again = {x for i in range(len(seq) - n + 1) if (x := seq[i : i + n]) in seen or seen.add(x)}
            if not again:
                return best
            best = max(again)
        return best

    r = random.Random(9)
    for _ in range(60):
        seq = "".join(r.choices(r.choice(["AC", "ACGT", "A", "ACGTNé"]), k=r.randint(0, 60)))
        assert longest_repeat(seq)[0] == plain(seq), seq
    long = "".join(r.choices("ACGT", k=200_000))
    long = long[:150_000] + long[20_000:60_000] + long[150_000:]
    found, at = longest_repeat(long)
    assert found in long[19_990:60_010] and len(found) >= 40_000 and len(at) == 2 and all(long.startswith(found, i) for i in at)
    for seq in (long[:150], long[:150] * 3, "N" * 500, long[:7] * 90):
        whole = longest_repeat(seq)
        assert whole[0] == plain(seq) and whole[1] == [i for i in range(len(seq)) if seq.startswith(whole[0], i)]
    # a tandem repeat of two million bases: windows compared one by one would take hours
    assert largest_repeat("AC" * 1_000_000) == ("repeat", "AC" * 999_999, 1.0)


def test_calls_tile_regions(spark):
    """Final intervals of a region follow each other, and neighbours differ; a gap in coverage is a misjoin."""
    rows = [("c", s, "50=", 60) for s in range(1, 400)] + [("c", s, "50=", 60) for s in range(600, 950)]
    reads = spark.createDataFrame(rows, "chrom string, start int, cigar string, mapq int")
    regions = spark.createDataFrame([(1, "c", 100, 900)], "region_id long, chrom string, st long, end long")
    calls = api.call_regions(reads, regions, Config(general=General(bp_merge=10)))
    got = calls.regions.orderBy("chromStart").collect()
    assert got[0].chromStart == 100 and got[-1].chromEnd == 901
    assert all(a.chromEnd == b.chromStart and a.name != b.name for a, b in zip(got, got[1:]))
    assert any(r.name == "misjoin" and r.chromStart <= 500 <= r.chromEnd for r in got)
    assert calls.pileup.count() == 801


def test_boundaries(spark):
    rows = [(0, "c", 0, 0, 5, i, 1, "misjoin") if i == 0 else (0, "c", 0, i * 5, i * 5 + 5, i, c, s) for i, (c, s) in enumerate([(1, "misjoin"), (2, "indel"), (9, "indel"), (9, "good"), (1, "misjoin")])]
    itvs = spark.createDataFrame(rows, "region_id long, chrom string, bin long, st long, end long, ord long, cov long, status string")
    stats = spark.createDataFrame([(0, 0, 8.0)], "region_id long, bin long, median double")
    assert [r.status for r in merge.suppress_boundaries(itvs, stats).orderBy("st").collect()] == ["good", "good", "indel", "good", "good"]
    # where the contig's length is known, only what touches its ends goes
    for length, want in ((24, ["good", "good", "indel", "good", "good"]), (500, ["good", "good", "indel", "good", "misjoin"]), (None, ["good", "good", "indel", "good", "good"])):
        ends = spark.createDataFrame([("c", length)], "chrom string, length long")
        assert [r.status for r in merge.suppress_boundaries(itvs, stats, ends).orderBy("st").collect()] == want
    inner = itvs.selectExpr("region_id", "chrom", "bin", "st + 50 as st", "`end` + 50 as `end`", "ord", "cov", "status")
    ends = spark.createDataFrame([("c", 500)], "chrom string, length long")
    assert [r.status for r in merge.suppress_boundaries(inner, stats, ends).orderBy("st").collect()] == ["misjoin", "indel", "indel", "good", "misjoin"]
    low = stats.withColumn("median", F.lit(100.0))
    assert {r.status for r in merge.suppress_boundaries(itvs, low).collect()} == {"good"}


def test_oracles_match(spark):
    """Every query with SQL gives the same rows in the other engine, at the smallest size."""
    import duckdb
    import pandas as pd

    import __spark_entry__

    from basewright.plans.oracle import oracle_sql
    from basewright.plans.queries import queries

    where, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("lineitem", "events", "orders", "supplier", "part", "customer", "documents"):
        c.sql(f"create view {t} as select * from '{where}/{t}.parquet'")

    def rows(df: pd.DataFrame) -> list:
        df = df[sorted(df.columns)]
        show = lambda v: "null" if v is None or v is pd.NA or v != v else repr(round(float(v), 6)) if not isinstance(v, (str, bool)) else v
        return sorted([tuple(map(show, r)) for r in df.itertuples(index=False)])

    assert set(queries()) <= set(__spark_entry__.queries())
    assert set(oracle_sql()) == set(queries())
    seen = set()
    for name, query in queries().items():
        got = query(spark, where).toPandas()
        assert len(got) and rows(got) == rows(c.sql(oracle_sql()[name]).df()), name
        if name == "classify_bases":
            seen = set(zip(got.status, got.bin))
    assert {x for x, _ in seen} == {"good", "low_quality", "indel", "softclip", "collapse", "misjoin", "false_dupe"} and {b for _, b in seen} == {0, 1}
