"""Record-level operators: filters, mates, sorting as ranks, clipping, tags, conversion to and from reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records as R


def in_list(reads: DataFrame, names: DataFrame, keep: bool = True) -> DataFrame:
    return reads.join(names.select("name").distinct(), "name", "left_semi" if keep else "left_anti")


def by_template_alignment(reads: DataFrame, aligned: bool = True, every: bool = False) -> DataFrame:
    """Templates of which any record is mapped (``aligned``), or none; with ``every``, those all of whose records are, or aren't. Names are judged by an aggregate and joined back, so a long template is no window."""
    mapped = reads.groupBy("name").agg((F.min if every else F.max)(~R.has(R.UNMAPPED)).alias("_any")).filter(F.col("_any") == aligned).select("name")
    return reads.join(mapped, "name", "left_semi")


def by_intervals(reads: DataFrame, targets: DataFrame) -> DataFrame:
    """Mapped records that overlap an interval, themselves or by their mate's start."""
    from .intervals import merged_in_bins, overlaps

    m = merged_in_bins(targets)
    r = reads.withColumn("ops", R.cigar_ops())
    own = r.filter(~R.has(R.UNMAPPED)).select("idx", "contig", F.col("pos").alias("start"), R.alignment_end().alias("stop"))
    mate = r.filter(R.has(R.PAIRED) & ~R.has(R.MATE_UNMAPPED)).select("idx", F.col("mate_contig").alias("contig"), F.col("mate_pos").alias("start"), F.col("mate_pos").alias("stop"))
    hit = overlaps(own.unionByName(mate), m).select("a.idx").distinct()
    return reads.join(hit, "idx", "left_semi")


def view(reads: DataFrame, aligned: bool | None = None, pf: bool | None = None) -> DataFrame:
    if aligned is not None:
        reads = reads.filter(R.has(R.UNMAPPED) != aligned)
    return reads if pf is None else reads.filter(R.has(R.QC_FAIL) != pf)


def first_records(reads: DataFrame, n: int) -> DataFrame:
    """The ``n`` records of least ordinal: top-n by partitions, then of their results."""
    return reads.orderBy("idx").limit(n)


def coordinate_order(reads: DataFrame) -> list[Column]:
    return [F.when(R.has(R.UNMAPPED), 2147483647).otherwise(F.col("contig")), F.col("pos"), R.has(R.REVERSE), F.col("name"), F.col("flags"), F.col("idx")]


def coordinate_bucket(width: int = 16_384) -> Column:
    """A coarse key within a contig that goes with ``coordinate_order``: unmapped records last, then stretches of ``width`` bases."""
    return F.when(R.has(R.UNMAPPED), F.lit(1 << 40)).otherwise(F.lit(0).cast("long")) + F.floor(F.col("pos") / width)


def queryname_order(reads: DataFrame) -> list[Column]:
    return [F.col("name"), R.has(R.PAIRED), R.has(R.SECOND), R.has(R.SECONDARY) | R.has(R.SUPPLEMENTARY), F.col("idx")]


def ranked(df: DataFrame, order: list[Column], group: str, bucket: Column | None = None) -> DataFrame:
    """Position of a row in a total order within a group (from 1). A whole-table order is a range-partitioned sort; see ``sorted_records``.

    ``bucket`` is a coarse key that goes with the order, such as a position by some thousands: rows are ranked within it and the rows of buckets before are added, so that no task holds a whole group.
    """
    if bucket is not None:
        x = df.withColumn("_bucket", bucket)
        before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        heads = x.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        x = x.withColumn("_k", F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)))
        return x.join(heads, [group, "_bucket"]).withColumn("rank", (F.col("_before") + F.col("_k")).cast("long")).drop("_bucket", "_before", "_k")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))


def sorted_records(reads: DataFrame, order: list[Column]) -> DataFrame:
    return reads.orderBy(*order)


def order_violations(reads: DataFrame, group: str, key: str, ordinal: str = "idx") -> DataFrame:
    """Rows whose key is below that of the row before in file order."""
    w = Window.partitionBy(group).orderBy(ordinal)
    return reads.withColumn("before", F.lag(key).over(w)).filter(F.col(key) < F.col("before"))


def mates(reads: DataFrame) -> DataFrame:
    """First and second end of each name (least ordinals), as structs a and b. One aggregate by name, no self-join."""
    r = reads.filter(R.has(R.PAIRED) & R.primary()).withColumn("ops", R.cigar_ops()).withColumn("stop", R.alignment_end()).withColumn("five", F.when(R.has(R.REVERSE), F.col("stop")).otherwise(F.col("pos")))
    s = F.struct("idx", "contig", "pos", "flags", "cigar", "mapq", "stop", "five", "mate_contig", "mate_pos", "nm")
    x = r.groupBy("name").agg(F.min_by(s, F.when(R.has(R.FIRST), F.col("idx"))).alias("a"), F.min_by(s, F.when(~R.has(R.FIRST), F.col("idx"))).alias("b"), F.count(F.when(R.has(R.FIRST), 1)).alias("_f"), F.count(F.when(~R.has(R.FIRST), 1)).alias("_s"))
    return x.filter("_f > 0 and _s > 0").select("name", "a", "b")


def fixed_mates(reads: DataFrame) -> DataFrame:
    """Mate fields as each end's partner gives them: contig, position, strand, CIGAR, quality, and the signed distance of 5' ends."""
    m = mates(reads)
    size = F.when(F.col("a.contig") == F.col("b.contig"), F.col("b.five") - F.col("a.five") + F.when(F.col("b.five") >= F.col("a.five"), 1).otherwise(-1)).otherwise(0)
    side = lambda x, y, sign: F.struct(F.col(f"{x}.idx").alias("idx"), F.col(f"{y}.contig").alias("mate_contig"), F.col(f"{y}.pos").alias("mate_pos"), (F.col(f"{y}.flags").bitwiseAND(F.lit(16)) != 0).alias("mate_reverse"), F.col(f"{y}.cigar").alias("mc"), F.col(f"{y}.mapq").alias("mq"), (size * sign).cast("int").alias("tlen"))
    return m.select(F.explode(F.array(side("a", "b", 1), side("b", "a", -1))).alias("m")).select("m.*")


def mate_errors(reads: DataFrame) -> DataFrame:
    """How many pairs disagree about the mate, by code."""
    m = mates(reads)
    f = F.col
    codes = F.array_compact(F.array(
        F.when(f("a.mate_pos") != f("b.pos"), F.lit("MISMATCH_MATE_ALIGNMENT_START")), F.when(f("a.mate_contig") != f("b.contig"), F.lit("MISMATCH_MATE_REF_INDEX")),
        F.when((f("a.flags").bitwiseAND(F.lit(32)) != 0) != (f("b.flags").bitwiseAND(F.lit(16)) != 0), F.lit("MISMATCH_FLAG_MATE_NEG_STRAND")), F.when((f("a.flags").bitwiseAND(F.lit(8)) != 0) != (f("b.flags").bitwiseAND(F.lit(4)) != 0), F.lit("MISMATCH_FLAG_MATE_UNMAPPED")),
    ))
    return m.select(F.explode(codes).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("pairs"))


def validate(reads: DataFrame) -> DataFrame:
    """How many records break each rule, by code."""
    r = reads.withColumn("ops", R.cigar_ops())
    unpaired = ~R.has(R.PAIRED)
    codes = F.array_compact(F.array(
        F.when(unpaired & R.has(R.PROPER), F.lit("INVALID_FLAG_PROPER_PAIR")), F.when(unpaired & R.has(R.MATE_UNMAPPED), F.lit("INVALID_FLAG_MATE_UNMAPPED")), F.when(unpaired & R.has(R.MATE_REVERSE), F.lit("INVALID_FLAG_MATE_NEG_STRAND")),
        F.when(unpaired & R.has(R.FIRST), F.lit("INVALID_FLAG_FIRST_OF_PAIR")), F.when(unpaired & R.has(R.SECOND), F.lit("INVALID_FLAG_SECOND_OF_PAIR")), F.when(R.has(R.UNMAPPED) & R.has(R.SECONDARY), F.lit("INVALID_FLAG_NOT_PRIM_ALIGNMENT")),
        F.when(R.has(R.UNMAPPED) & R.has(R.SUPPLEMENTARY), F.lit("INVALID_FLAG_SUPPLEMENTARY_ALIGNMENT")), F.when(R.has(R.UNMAPPED) & (F.col("mapq") != 0), F.lit("INVALID_MAPPING_QUALITY")), F.when(~R.has(R.UNMAPPED) & (R.read_length() != F.length("bases")), F.lit("INVALID_CIGAR")), F.when(F.col("nm").isNull(), F.lit("MISSING_TAG_NM")),
    ))
    return r.select(F.explode(codes).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("records"))


def cleaned(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Unmapped records get quality 0; how far a mapped one reaches past its contig's end, to be clipped."""
    r = reads.withColumn("ops", R.cigar_ops()).join(F.broadcast(contigs.select("contig", "length")), "contig", "left")
    over = F.when(~R.has(R.UNMAPPED), F.greatest(R.alignment_end() - F.col("length"), F.lit(0))).otherwise(0)
    return r.select("idx", F.when(R.has(R.UNMAPPED), 0).otherwise(F.col("mapq")).alias("mapq"), over.alias("clip"))


def reverted(reads: DataFrame) -> DataFrame:
    """Alignment undone: primary records as sequenced, mapping fields and flags cleared."""
    kept = R.PAIRED | R.FIRST | R.SECOND | R.QC_FAIL
    flags = F.col("flags").bitwiseAND(F.lit(kept)).bitwiseOR(F.lit(R.UNMAPPED)).bitwiseOR(F.when(R.has(R.PAIRED), R.MATE_UNMAPPED).otherwise(0))
    back = R.has(R.REVERSE)
    return reads.filter(R.primary()).select("idx", "name", flags.alias("flags"), F.when(back, R.reverse_complement("bases")).otherwise(F.col("bases")).alias("bases"), F.when(back, F.reverse("quals")).otherwise(F.col("quals")).alias("quals"))


def original_alignment(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """The OA value: contig, position, strand, CIGAR, quality and NM; null for unmapped records."""
    r = reads.join(F.broadcast(contigs.select("contig", "contig_name")), "contig", "left")
    oa = F.concat_ws(",", "contig_name", F.col("pos").cast("string"), F.when(R.has(R.REVERSE), "-").otherwise("+"), "cigar", F.col("mapq").cast("string"), F.concat(F.col("nm").cast("string"), F.lit(";")))
    return r.select("idx", F.when(~R.has(R.UNMAPPED), oa).alias("oa"))


def fastq(reads: DataFrame) -> DataFrame:
    """Reads as sequenced, with names /1 and /2 for pairs and qualities as text."""
    r = reverted(reads)
    end = F.when(R.has(R.PAIRED), F.when(R.has(R.FIRST), "/1").otherwise("/2")).otherwise("")
    return r.select("idx", F.concat("name", end).alias("read_name"), "bases", R.phred_text("quals").alias("qualities"))


def from_fastq(rows: DataFrame) -> DataFrame:
    """Unmapped records from reads: end by the name's suffix, qualities as numbers."""
    end = F.regexp_extract("read_name", "/([12])$", 1)
    flags = F.when(end == "1", 77).when(end == "2", 141).otherwise(4)
    return rows.select("idx", F.regexp_replace("read_name", "/[12]$", "").alias("name"), flags.alias("flags"), "bases", R.phred_values("qualities").alias("quals"))


def trimmed(reads: DataFrame, threshold: int) -> DataFrame:
    """How many bases of each read stay after trimming its end by quality."""
    return reads.select("idx", F.size("quals").alias("length"), R.quality_trim_point("quals", threshold).alias("kept"))


def adapter_start(reads: DataFrame, adapter: str, least: int = 4, max_error: float = 0.1) -> DataFrame:
    """Where an adapter begins in each read: the last offset at which its overlap, of at least ``least`` bases, has at most that share of mismatches, rounded down; null if nowhere. N in the adapter matches any base."""
    n = len(adapter)
    wrong = f"aggregate(sequence(1, least({n}, length(bases) - i)), 0, (k, j) -> k + if(substr('{adapter}', j, 1) not in ('N', '.') and upper(substr(bases, i + j, 1)) <> upper(substr('{adapter}', j, 1)), 1, 0))"
    at = F.expr(f"if(length(bases) < {least}, null, array_max(filter(sequence(0, length(bases) - {least}), i -> {wrong} <= floor({max_error}D * least({n}, length(bases) - i)))))")
    return reads.select("idx", at.alias("adapter_start"))


def checksum(reads: DataFrame) -> DataFrame:
    """An order-free digest of the records of each read group: the first 60 bits of each record's MD5, joined by exclusive or."""
    return reads.groupBy("rg").agg(F.count(F.lit(1)).alias("records"), F.expr("bit_xor(cast(conv(substr(md5(concat_ws('|', name, cast(flags as string), bases)), 1, 15), 16, 10) as long))").alias("checksum"))


def downsample_hash(reads: DataFrame, probability: float) -> DataFrame:
    """Whole templates whose hash is under the probability: both ends share their fate, whatever the partitioning."""
    return reads.filter(F.expr("conv(substr(md5(name), 1, 8), 16, 10)").cast("long") < int(probability * 2**32))


def downsample_exact(reads: DataFrame, probability: float) -> DataFrame:
    """Of each read group exactly the rounded-down share of templates, by least hash: an aggregate finds names, ranks are kept by group and hash bucket."""
    names = reads.select("rg", "name").distinct().withColumn("h", F.md5("name"))
    w = Window.partitionBy("rg").orderBy("h", "name")
    k = names.withColumn("rank", F.row_number().over(w)).join(names.groupBy("rg").agg(F.count(F.lit(1)).alias("n")), "rg")
    return k.filter(F.col("rank") <= F.floor(F.col("n") * probability)).select("rg", "name")


def downsample_circle(reads: DataFrame, width: int, height: int, share: float) -> DataFrame:
    """Records whose place on the tile lies in a disc that covers that share of it."""
    r2 = share * width * height / 3.141592653589793
    return reads.filter((F.col("x") - width / 2) * (F.col("x") - width / 2) + (F.col("y") - height / 2) * (F.col("y") - height / 2) <= r2)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sets of records matched by name and end: how many agree or differ in mapping, or are missing."""
    key = lambda df, n: df.filter(R.primary()).groupBy("name", (R.has(R.FIRST)).alias("is_first")).agg(F.min_by(F.struct(R.has(R.UNMAPPED).alias("u"), "contig", "pos", R.has(R.REVERSE).alias("r"), R.has(R.DUPLICATE).alias("d")), "idx").alias(n))
    j = key(a, "a").join(key(b, "b"), ["name", "is_first"], "full_outer")
    f, c = F.col, R.count_true
    both = f("a").isNotNull() & f("b").isNotNull()
    same = (f("a.contig") == f("b.contig")) & (f("a.pos") == f("b.pos")) & (f("a.r") == f("b.r"))
    return j.agg(
        c(both & ~f("a.u") & ~f("b.u") & same).alias("mappings_match"), c(both & ~f("a.u") & ~f("b.u") & ~same).alias("mappings_differ"), c(both & f("a.u") & f("b.u")).alias("unmapped_both"), c(both & f("a.u") & ~f("b.u")).alias("unmapped_left"),
        c(both & ~f("a.u") & f("b.u")).alias("unmapped_right"), c(f("a").isNull()).alias("missing_left"), c(f("b").isNull()).alias("missing_right"), c(both & (f("a.d") != f("b.d"))).alias("duplicate_markings_differ"),
    )


def primary_hit(hits: DataFrame, strategy: str = "BestMapq") -> DataFrame:
    """One hit of each name: by best mapping quality, by earliest aligned base of the read, or the pair farthest apart; ties by ordinal."""
    order = {"BestMapq": F.col("mapq").desc(), "EarliestFragment": R.leading("SH") + 0, "MostDistant": F.abs("tlen").desc()}[strategy]
    w = Window.partitionBy("name").orderBy(order, "idx")
    return hits.filter(~R.has(R.UNMAPPED)).withColumn("ops", R.cigar_ops()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "ops")
