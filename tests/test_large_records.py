"""Operators that must not make a row of each base or link: against brute force, and by their plans."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from strandwise.operators import pileup

READS = "idx long, name string, flags int, contig int, pos int, mapq int, cigar string, bases string, quals array<int>"


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def blocks(row):
    """(offset in the read, position) of each aligned base of a record of the kinds that ``some_reads`` makes."""
    n, pos = len(row[7]), row[4]
    return [(i, pos + i + (4 if "D" in row[6] and i >= n // 2 else 0)) for i in range(n)]


def some_reads(n=60, at=pileup.BIN - 30):
    """Records about a border of bins, several to a name."""
    r = random.Random(5)
    out = []
    for i in range(n):
        k = r.randint(4, 20)
        flags = r.choice([1 + 64, 1 + 128, 1 + 128 + 16, 0, 1 + 64 + 1024, 1 + 64 + 512, 1 + 64 + 4])
        out.append((i, f"t{r.randint(0, 5)}", flags, r.randint(0, 1), at + r.randint(0, 40), r.randint(0, 60), r.choice([f"{k}M", f"{k // 2}M4D{k - k // 2}M"]), "".join(r.choice("ACGTN") for _ in range(k)), [r.randint(0, 40) for _ in range(k)]))
    return out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_depth_makes_no_row_of_a_base(spark, small_batches):
    rows = some_reads()
    want, seen = defaultdict(lambda: [0, 0, 0]), set()
    for row in rows:
        if row[2] & (2820 | 1024 | 8) or not row[2] & 1 or row[5] < 10:
            continue
        for o, p in blocks(row):
            bad = row[8][o] < 20 or row[7][o] == "N"
            want[row[3], p][0 if bad else 1 if (again := (row[1], row[3], p) in seen) else 2] += 1
            if not bad and not again:
                seen.add((row[1], row[3], p))
    df = pileup.base_fates(spark.createDataFrame(rows, READS), 10, 20, cap=2)
    got = {(r.contig, r.pos): [r.baseq, r.overlap, r.raw_depth] for r in df.collect()}
    assert got == dict(want) and any(x[1] for x in got.values())
    assert all(r.depth + r.capped == r.raw_depth and r.depth <= 2 for r in df.collect())
    assert "Generate" not in plan(df)  # a generator would make a row of each base, and shuffle it


@pytest.mark.parametrize("table", ["sf0.001"])
def test_test_records_are_the_same_in_spark_and_sql(spark, table):
    """Spark cuts bases and qualities of the test records from literals, in methods small enough to be compiled; SQL makes each base."""
    import re

    import duckdb

    from strandwise.plans import adapt

    reads = adapt.Tables(spark, f"/root/testdata/{table}").reads
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '/root/testdata/{table}/lineitem.parquet'")
    want = db.execute(f"SELECT idx, cigar, flags, bases, quals FROM ({adapt.reads_sql(adapt.DUCK)})").fetchall()
    assert sorted(tuple(r) for r in reads.select("idx", "cigar", "flags", "bases", "quals").collect()) == sorted(want)
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(reads._jdf.queryExecution().executedPlan())
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) <= 8000


def a_reference(spark, length=400, start=pileup.BIN // 500 * 500 + 1 - 500):
    r = random.Random(9)
    chunks = [(c, (start - 1) // 500 + i, start + 500 * i, "".join(r.choice("ACGTN") for _ in range(500 if i == 0 else length))) for c in (0, 1) for i in (0, 1)]
    at = {(c, s + i): b for c, _, s, text in chunks for i, b in enumerate(text)}
    return spark.createDataFrame(chunks, "contig int, chunk long, start int, bases string"), at


def test_alignment_errors_make_no_row_of_a_base(spark, small_batches):
    import re
    from statistics import median

    from strandwise.operators import qc

    reference, ref = a_reference(spark)
    edge = max(p for _, p in ref)
    rows = some_reads(40) + [(100 + r[0], *r[1:]) for r in some_reads(40, at=edge - 30)]  # some end outside the reference
    bases, reads, cycles, total = defaultdict(lambda: [0, 0, 0, 0, 0]), defaultdict(dict), defaultdict(int), defaultdict(int)
    for row in rows:
        cats = ["UNPAIRED"] if not row[2] & 1 else ["FIRST_OF_PAIR" if row[2] & 64 else "SECOND_OF_PAIR", "PAIR"]
        for c in cats:
            total[c] += 1
        if row[2] & 516:
            continue
        for o, p in blocks(row):
            if (b := ref.get((row[3], p))) is not None:
                bad, hq = row[7][o] != b, row[5] >= 20
                for c in cats:
                    bases[c] = [x + y for x, y in zip(bases[c], (1, hq, bad, bad and hq, hq and row[8][o] >= 20), strict=True)]
                    reads[c][row[0]] = reads[c].get(row[0], 0) + (bad and hq)
    df = qc.alignment_errors(spark.createDataFrame(rows, READS), reference)
    got = {r.category: (r.pf_mismatch_rate, r.pf_hq_error_rate, r.pf_hq_aligned_q20_bases, r.pf_hq_median_mismatches) for r in df.collect()}
    want = {c: (b[2] / b[0], b[3] / b[1], b[4], median(reads[c].values())) for c, b in bases.items()}
    assert got.keys() == want.keys() == total.keys() and all(got[c] == pytest.approx(want[c], abs=1e-6) for c in want)
    assert not re.search(r"sequence\(0, \(_n", plan(df))  # else a row of each base


def test_overlapping_ends_make_no_row_of_a_base(spark, small_batches):
    reference, ref = a_reference(spark)
    rows = some_reads(80)
    ends = defaultdict(dict)
    for row in rows:  # in the order of ordinals
        if not row[2] & 2820 and row[2] & 1:
            for o, p in blocks(row):
                if row[7][o] != "N" and ref.get((row[3], p), "N") != "N":
                    ends[row[3], p, row[1]].setdefault(bool(row[2] & 64), row[7][o])
    both = [(e[True], e[False], ref[c, p]) for (c, p, _), e in ends.items() if len(e) == 2]
    want = (len(both), sum(a == b != r for a, b, r in both), sum(a != b and r in (a, b) for a, b, r in both), sum(len({a, b, r}) == 3 for a, b, r in both))
    df = pileup.overlapping_errors(spark.createDataFrame(rows, READS), reference)
    assert tuple(df.collect()[0]) == want and all(want)
    assert "sequence(0, (_n" not in plan(df)  # else a row of each base


def test_cells_are_linked_as_their_points_are(spark):
    from strandwise.operators import annotation, duplicates

    r = random.Random(3)
    points = [(i, r.randint(0, 60), r.randint(0, 60)) for i in range(45)] + [(100 + i, 7, 9) for i in range(300)]  # and many at one place
    side = 6
    cell = {}
    for i, x, y in sorted(points):
        cell.setdefault((x // side, y // side), i)
    df = spark.createDataFrame([(0, x, y, x // side, y // side, cell[x // side, y // side]) for i, x, y in points], "s int, x int, y int, cx long, cy long, cell long")
    links = duplicates.cell_links(df, ["s"], 5)
    assert links.count() <= 4 * len(cell)  # by points there are over 40,000
    label = {n.node: n.label for n in annotation.clusters(links).collect()}
    got = {i: label.get(cell[x // side, y // side], cell[x // side, y // side]) for i, x, y in points}
    want = {i: i for i, _, _ in points}
    for _ in points:
        new = {i: min(want[j] for j, u, v in points if abs(u - x) <= 5 and abs(v - y) <= 5) for i, x, y in points[:45] + points[45:46]}
        new |= {i: new[100] for i, _, _ in points[45:]}
        if new == want:
            break
        want = new
    assert {(got[a] == got[b]) for a, b in ((a, b) for a in want for b in list(want)[:46]) if want[a] == want[b]} == {True}
    assert len(set(got.values())) == len(set(want.values())) > 3
