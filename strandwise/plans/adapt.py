"""Canonical tables over the test tables.

The same projection is written once and rendered for Spark and for the checking engine, so each check compares
an operator with SQL over the same rows. Record order is a content-derived ordinal (``idx``): no global sort is needed to make one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTIGS = 25
SPAN = 100_000


#: Length of the longest test record; the reference repeats itself after so many bases, from ``base``, but for the runs of N.
LONGEST, REPEAT = 99, 220
#: A repeat of each kind of contig (number modulo 4) from position 0, and the longest record more.
REPEATS = ["".join("ACGT"[(p * 7 + c * 3 + p // 5 + p // 11 * 2) % 4] for p in range(REPEAT + LONGEST)) for c in range(4)]


class Dialect:
    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def div(self, a: str, b: str) -> str:
        return f"(({a}) DIV ({b}))" if self.spark else f"(({a}) // ({b}))"

    def text_of(self, n: str, expr: str) -> str:
        """A string of the characters ``expr`` gives for o = 0 .. n - 1."""
        return f"array_join(transform(sequence(0, {n} - 1), o -> {expr}), '')" if self.spark else f"array_to_string(list_transform(range(0, {n}), lambda o: {expr}), '')"

    def ints_of(self, n: str, expr: str) -> str:
        return f"transform(sequence(0, {n} - 1), o -> CAST({expr} AS INT))" if self.spark else f"list_transform(range(0, {n}), lambda o: CAST({expr} AS INT))"

    def base(self, contig: str, pos: str) -> str:
        """The reference base at a position."""
        return f"substr('ACGT', CAST(1 + (({pos}) * 7 + ({contig}) * 3 + {self.div(pos, '5')} + {self.div(pos, '11')} * 2) % 4 AS INT), 1)"

    def read_bases(self) -> str:
        """A record's bases: the reference's, but N and those of the next contig at places that ``k1`` gives.

        Spark cuts them from a repeat of the reference and overlays those places, of which a step has one: the same string, without a lambda a base.
        """
        if not self.spark:
            return self.text_of("len", f"CASE WHEN (k1 * 31 + o * 17) % 97 = 0 THEN 'N' WHEN (k1 * 13 + o * 7) % 53 = 0 THEN {self.base('contig + 1', 'pos + o')} ELSE {self.base('contig', 'pos + o')} END")
        cut = lambda contig, pos, n: f"substr(element_at(array({', '.join(map(repr, REPEATS))}), CAST(({contig}) % 4 + 1 AS INT)), CAST(({pos}) % {REPEAT} + 1 AS INT), {n})"
        text = cut("contig", "pos", "len")
        for step, first, base in ((53, f"CAST(k1 * {-13 * pow(7, -1, 53) % 53} % 53 AS INT)", lambda o: cut("contig + 1", f"pos + {o}", 1)), (97, f"CAST(k1 * {-31 * pow(17, -1, 97) % 97} % 97 AS INT)", lambda o: "'N'")):
            for o in (first, f"({first} + {step})"):
                text = f"overlay({text} PLACING if({o} < len, {base(o)}, '') FROM {o} + 1 FOR if({o} < len, 1, 0))"
        return self.apart(text)

    def apart(self, expr: str) -> str:
        """In Spark evaluated apart from the generated method, which with all columns in it would be larger than what the JVM compiles (8,000 bytes), and so many times slower."""
        return f"element_at(transform(array(1), _ -> {expr}), 1)" if self.spark else expr

    def read_quals(self) -> str:
        """A record's qualities; Spark cuts them from the three cycles of 13 values that there are."""
        if not self.spark:
            return self.ints_of("len", "2 + (k2 * 5 + k1 + o * 3) % 39")
        cycles = ", ".join(f"array({', '.join(str(2 + (i + 3 * j) % 39) for j in range(13 + LONGEST))})" for i in range(3))
        start = "CAST((k2 * 5 + k1) % 39 AS INT)"
        return self.apart(f"slice(element_at(array({cycles}), {start} % 3 + 1), {self.div(start, '3')} + 1, len)")

    def source(self, name: str) -> str:
        return "{" + name + "}" if self.spark else name


SPARK, DUCK = Dialect(True), Dialect(False)


def reads_sql(d: Dialect) -> str:
    """Alignment records from order lines: flags, CIGAR, bases, qualities and tags as columns."""
    half = d.div("len", "2")
    return f"""
SELECT idx, name, contig, pos, mapq, tlen, len, ck, cigar, flags, rg, library, sample, mate_contig, mate_pos, umi, tile, x, y, nm,
  {d.read_bases()} AS bases,
  {d.read_quals()} AS quals
FROM (SELECT *,
  {d.apart(f"""CAST(CASE ck WHEN 0 THEN concat(len, 'M') WHEN 1 THEN concat({half}, 'M5D', len - {half}, 'M') WHEN 2 THEN concat({half}, 'M3I', len - {half} - 3, 'M')
    WHEN 3 THEN concat('4S', len - 4, 'M') WHEN 4 THEN concat(len - 4, 'M4S') WHEN 5 THEN concat('5H', len, 'M')
    WHEN 6 THEN concat({half}, 'M100N', len - {half}, 'M') ELSE concat({half}, 'M2D', len - {half}, 'M') END AS STRING)""")} AS cigar
FROM (SELECT
  CAST(((l_orderkey * 8 + l_linenumber) * 20000000 + (l_partkey % 20000) * 1000 + l_suppkey % 1000) * 64 + CAST(l_quantity AS BIGINT) AS BIGINT) AS idx,
  concat('q', CAST(l_orderkey AS STRING)) AS name, CAST(CASE WHEN l_orderkey % 4 = 0 THEN l_orderkey % {CONTIGS} ELSE l_suppkey % {CONTIGS} END AS INT) AS contig,
  CAST(CASE WHEN l_orderkey % 4 = 0 THEN 1 + (l_orderkey % 400) * 211 + (l_linenumber % 2) * 150 ELSE 1 + (l_partkey * 37) % {SPAN} END AS INT) AS pos,
  CAST(l_quantity AS INT) AS mapq, CAST(20 + (l_linenumber * 7) % 80 AS INT) AS len, CAST(l_orderkey % 8 AS INT) AS ck, CAST(l_partkey AS BIGINT) AS k1, CAST(l_linenumber AS BIGINT) AS k2,
  CAST((100 + floor(l_extendedprice / 100)) * CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END AS INT) AS tlen,
  CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END + CASE WHEN l_linestatus = 'O' THEN 2 ELSE 0 END
      + CASE WHEN l_suppkey % 19 = 0 THEN 8 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 32 ELSE 0 END END
    + CASE WHEN l_returnflag = 'A' THEN 16 ELSE 0 END + CASE WHEN l_partkey % 23 = 0 THEN 4 ELSE 0 END + CASE WHEN l_partkey % 41 = 0 THEN 256 ELSE 0 END
    + CASE WHEN l_partkey % 29 = 0 THEN 512 ELSE 0 END + CASE WHEN l_orderkey % 17 = 0 THEN 1024 ELSE 0 END + CASE WHEN l_partkey % 53 = 0 THEN 2048 ELSE 0 END AS INT) AS flags,
  concat('rg', CAST(l_orderkey % 6 AS STRING)) AS rg, concat('lib', CAST(l_orderkey % 3 AS STRING)) AS library, concat('s', CAST(l_orderkey % 3 % 2 AS STRING)) AS sample,
  CAST((CASE WHEN l_orderkey % 4 = 0 THEN l_orderkey ELSE l_suppkey END + CASE WHEN l_partkey % 31 = 0 THEN 1 ELSE 0 END) % {CONTIGS} AS INT) AS mate_contig, CAST(1 + (l_partkey * 37 + 180) % {SPAN} AS INT) AS mate_pos,
  concat(substr('ACGT', CAST(1 + l_orderkey % 4 AS INT), 1), substr('ACGT', CAST(1 + l_partkey % 4 AS INT), 1), substr('ACGT', CAST(1 + l_suppkey % 3 AS INT), 1), substr('ACGTN', CAST(1 + l_partkey % 5 AS INT), 1)) AS umi,
  CAST(1101 + l_orderkey % 3 AS INT) AS tile, CAST((l_orderkey * 17) % 400 AS INT) AS x, CAST((l_orderkey * 29 + l_linenumber * 3) % 300 AS INT) AS y, CAST((l_partkey + l_linenumber) % 5 AS INT) AS nm
FROM {d.source('lineitem')}) r0) r1"""


def intervals_sql(d: Dialect) -> str:
    return f"""
SELECT CAST(o_custkey % {CONTIGS} AS INT) AS contig, CAST(1 + (o_orderkey * 53) % {SPAN} AS INT) AS start, CAST(1 + (o_orderkey * 53) % {SPAN} + 20 + CAST(floor(o_totalprice) AS BIGINT) % 200 AS INT) AS stop,
  CASE WHEN o_orderstatus = 'F' THEN '-' ELSE '+' END AS strand, concat('i', CAST(o_orderkey AS STRING)) AS name, CAST(o_orderkey AS BIGINT) AS idx
FROM {d.source('orders')}"""


def targets_sql(d: Dialect) -> str:
    return f"""
SELECT CAST(p_partkey % {CONTIGS} AS INT) AS contig, CAST(1 + (p_partkey * 211) % {SPAN} AS INT) AS start, CAST(1 + (p_partkey * 211) % {SPAN} + 50 + p_size AS INT) AS stop,
  '+' AS strand, concat('t', CAST(p_partkey AS STRING)) AS name, CAST(p_partkey AS BIGINT) AS idx
FROM {d.source('part')}"""


def contigs_sql(d: Dialect) -> str:
    return f"SELECT CAST(n_nationkey AS INT) AS contig, n_name AS contig_name, CAST({SPAN} + 1000 + n_nationkey * 100 AS INT) AS length FROM {d.source('nation')}"


def reference_sql(d: Dialect, width: int = 500) -> str:
    """The reference in chunks of ``width`` bases, with a run of N in each contig."""
    base = d.base("contig", f"chunk * {width} + o + 1")
    series = f"explode(sequence(0, CAST((length - 1) DIV {width} AS INT)))" if d.spark else f"unnest(range(0, (length - 1) // {width} + 1))"
    return f"""
SELECT contig, chunk, CAST(chunk * {width} + 1 AS INT) AS start, {d.text_of(f'least({width}, length - chunk * {width})', f"CASE WHEN (chunk + contig) % 50 = 7 AND o < 300 THEN 'N' ELSE {base} END")} AS bases
FROM (SELECT contig, length, CAST(chunk AS BIGINT) AS chunk FROM (SELECT contig, length, {series} AS chunk FROM ({contigs_sql(d)}) c) c1) k"""


def variants_sql(d: Dialect) -> str:
    """Sites with three samples (father, mother, child) from orders."""
    ref, alt = d.base("contig", "pos"), d.base("contig + 1", "pos")
    two = d.base("contig", "pos + 1")
    g = lambda s: f"CAST((k * {s[0]} + k % {s[1]}) % 3 AS INT)"
    return f"""
SELECT k, contig, pos, vk, CAST(concat({ref}, CASE WHEN vk IN (2, 4) THEN {two} ELSE '' END) AS STRING) AS ref,
  CAST(CASE vk WHEN 2 THEN concat({alt}, {d.base('contig + 2', 'pos + 1')}) WHEN 3 THEN concat({ref}, 'TT') WHEN 4 THEN {ref} WHEN 5 THEN concat({alt}, ',', {d.base('contig + 2', 'pos')}) WHEN 6 THEN concat({alt}, ',', {ref}, 'G') WHEN 7 THEN '<DEL>' WHEN 8 THEN '*' ELSE {alt} END AS STRING) AS alts,
  qual, dp, fs, qd, filtered, in_dbsnp, a0, b0, a1, b1, a2, b2, gq0, gq1, gq2, dp0, dp1, dp2, ad0, ad1, ad2
FROM (SELECT *, least(a_, b_) AS a2, greatest(a_, b_) AS b2 FROM (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey % {CONTIGS} AS INT) AS contig, CAST(1 + (o_orderkey * 97) % {SPAN} AS INT) AS pos, CAST(o_orderkey % 10 AS INT) AS vk,
  CAST(floor(o_totalprice) AS BIGINT) % 1000 / 10.0E0 AS qual, CAST(10 + o_custkey % 60 AS INT) AS dp, CAST(o_custkey % 70 AS INT) AS fs, CAST(o_orderkey % 25 AS INT) AS qd,
  o_orderstatus = 'P' AS filtered, o_custkey % 3 = 0 AS in_dbsnp,
  0 * CAST(o_orderkey AS INT) AS a0, CAST(o_orderkey % 2 AS INT) AS b0, CAST(o_orderkey % 5 % 2 AS INT) AS a1, 1 + 0 * CAST(o_orderkey AS INT) AS b1,
  CAST(o_custkey % 7 % 2 AS INT) AS a_, CAST(o_orderkey % 11 % 2 AS INT) AS b_,
  CAST(o_custkey % 99 AS INT) AS gq0, CAST(o_orderkey % 99 AS INT) AS gq1, CAST((o_orderkey + o_custkey) % 99 AS INT) AS gq2, CAST(5 + o_custkey % 30 AS INT) AS dp0, CAST(5 + o_orderkey % 30 AS INT) AS dp1, CAST(5 + (o_orderkey + o_custkey) % 30 AS INT) AS dp2,
  CAST(o_custkey % 5 AS INT) AS ad0, CAST(o_orderkey % 5 AS INT) AS ad1, CAST((o_orderkey + o_custkey) % 5 AS INT) AS ad2
FROM {d.source('orders')}) v0) v1"""


def genes_sql(d: Dialect) -> str:
    """Transcripts of two exons with a coding range, from suppliers."""
    return f"""
SELECT concat('g', CAST(s_suppkey % 50 AS STRING)) AS gene, concat('tx', CAST(s_suppkey AS STRING)) AS transcript, CAST(s_suppkey % {CONTIGS} AS INT) AS contig, CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
  CAST(1 + (s_suppkey * 997) % {SPAN} AS INT) AS tx_start, CAST(1 + (s_suppkey * 997) % {SPAN} + 900 AS INT) AS tx_end, CAST(1 + (s_suppkey * 997) % {SPAN} + 100 AS INT) AS cds_start, CAST(1 + (s_suppkey * 997) % {SPAN} + 750 AS INT) AS cds_end,
  CAST(1 + (s_suppkey * 997) % {SPAN} AS INT) AS e1_start, CAST(1 + (s_suppkey * 997) % {SPAN} + 300 AS INT) AS e1_end, CAST(1 + (s_suppkey * 997) % {SPAN} + 600 AS INT) AS e2_start, CAST(1 + (s_suppkey * 997) % {SPAN} + 900 AS INT) AS e2_end
FROM {d.source('supplier')}"""


ADAPTERS = {"reads": (reads_sql, "lineitem"), "intervals": (intervals_sql, "orders"), "targets": (targets_sql, "part"), "contigs": (contigs_sql, "nation"), "reference": (reference_sql, "nation"), "variants": (variants_sql, "orders"), "genes": (genes_sql, "supplier")}


#: Canonical tables that were written out, by their directory: see ``store``.
STORED: dict[str, str] = {}


def store(spark: SparkSession, sf_dir: str, folder: str, names: tuple[str, ...] = tuple(ADAPTERS)) -> None:
    """Write the canonical tables of a directory to ``folder``; from then on queries read them there, so that timings are of the operators, not of making up test records."""
    tables = Tables(spark, sf_dir)
    for name in names:
        getattr(tables, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    STORED[sf_dir] = folder


class Tables:
    """The canonical tables of a directory, lazily; other names are read as they are."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in ("solid_reads", *ADAPTERS):
            if self._dir in STORED:
                return self._spark.read.parquet(f"{STORED[self._dir]}/{name.removeprefix('solid_')}")
            sql, source = ADAPTERS[name.removeprefix("solid_")]
            df = self._spark.sql(sql(SPARK), **{source: self._spark.read.parquet(f"{self._dir}/{source}.parquet")})
            # made-up base strings are costly: a generator keeps the optimizer from copying their expression into lambdas
            return df.select(F.inline(F.array(F.struct("*")))) if name in ("reference", "solid_reads") else df
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def oracle(sql: str, *names: str) -> str:
    """``sql`` with the named canonical tables put before it."""
    if not names:
        return sql
    ctes = ", ".join(f"{n} AS ({ADAPTERS[n][0](DUCK)})" for n in names)
    return f"WITH {ctes} {sql}" if not sql.lstrip().upper().startswith("WITH ") else f"WITH {ctes}, {sql.lstrip()[5:]}"
