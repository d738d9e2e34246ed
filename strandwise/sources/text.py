"""Text formats of sequencing as DataFrames, read in splits with exact line numbers, and written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records as R


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, value): lines with their number in the file, from 0.

    Lines are counted by input split, counts summed up over the splits of a file, and lines ranked inside their split, so no task sees a whole file.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_m"))
    counts = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"))
    heads = counts.select("file", "block", F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_head"))
    ranked = raw.withColumn("_k", F.row_number().over(Window.partitionBy("file", "block").orderBy("_m")))
    return ranked.join(heads, ["file", "block"]).select("file", "block", (F.col("_head") + F.col("_k") - 1).alias("line"), "value")


def _field(i: int, name: str, kind: str = "string") -> Column:
    return F.col("f")[i].cast(kind).alias(name)


def _table(spark: SparkSession, path: str, *fields: tuple[str, str], skip: str = "#") -> DataFrame:
    lines = spark.read.text(path).filter((F.col("value") != "") & ~F.col("value").rlike(f"^({skip})"))
    split = lines.select(F.split("value", "\t").alias("f"))
    return split.select(*(F.get("f", i).cast(kind).alias(name) for i, (name, kind) in enumerate(fields)))


def canonical(reads: DataFrame, contigs: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Records (with tags as a map) with the columns that the operators ask for besides: contig and mate_contig as places in the dictionary (-1: none), rg, library and sample by their read group, umi, nm, len, and tile, x, y from the name.

    ``contigs`` is (contig, contig_name), ``groups`` (rg, library, sample), both of a header's size. Columns that are there already stay.
    """
    have = set(reads.columns)
    x = reads
    if contigs is not None and "contig" not in have:
        for name, out in (("contig_name", "contig"), ("mate_contig_name", "mate_contig")):
            x = x.join(contigs.select(F.col("contig").alias(f"_{out}"), F.col("contig_name").alias(name)), name, "left").withColumn(out, F.coalesce(f"_{out}", F.lit(-1))).drop(f"_{out}")
    tag = lambda k: F.col("tags")[k]
    found = {"rg": tag("RG"), "umi": tag("RX"), "nm": tag("NM").cast("int"), "len": F.length("bases"), "_at": R.location()}
    x = x.withColumns({k: v for k, v in found.items() if k not in have})
    x = x.withColumns({k: F.col("_at")[k] for k in ("tile", "x", "y") if k not in have}).drop("_at")
    if groups is None:
        return x.withColumns({k: F.lit(None).cast("string") for k in ("library", "sample") if k not in have})
    return x.join(groups.select("rg", "library", "sample"), "rg", "left")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(contig, contig_name, length): the @SQ lines of a header, numbered from 0 in their order."""
    h = read_header(spark, path, "SQ")
    return h.select((F.row_number().over(Window.orderBy("line")) - 1).cast("int").alias("contig"), F.col("fields")["SN"].alias("contig_name"), F.col("fields")["LN"].cast("int").alias("length"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(rg, library, sample): the @RG lines of a header."""
    return read_header(spark, path, "RG").select(F.col("fields")["ID"].alias("rg"), F.col("fields")["LB"].alias("library"), F.col("fields")["SM"].alias("sample"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records of SAM text in canonical columns, ready for the operators: idx is the line number, pos 1-based, qualities are numbers, tags a map; contigs, libraries and samples come from the file's header.

    A line of fewer than 11 fields is an error.
    """
    return canonical(sam_records(spark, path), read_dictionary(spark, path), read_groups(spark, path))


def sam_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of SAM text by themselves: contigs by name, tags as a map. A line of fewer than 11 fields is an error."""
    lines = numbered_lines(spark, path).filter((F.col("value") != "") & ~F.startswith("value", F.lit("@")))
    f = lines.select(F.col("line").alias("idx"), F.split("value", "\t").alias("f"))
    f = f.withColumn("f", F.when(F.size("f") >= 11, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("truncated record at line "), F.col("idx").cast("string")))))
    tags = F.expr("map_from_entries(transform(slice(f, 12, greatest(size(f) - 11, 0)), t -> struct(substr(t, 1, 2), substr(t, 6))))")
    none = lambda c: F.when(c != "*", c)
    return f.select(
        "idx", _field(0, "name"), _field(1, "flags", "int"), none(F.col("f")[2]).alias("contig_name"), _field(3, "pos", "int"), _field(4, "mapq", "int"), _field(5, "cigar"), F.when(F.col("f")[6] == "=", F.col("f")[2]).otherwise(none(F.col("f")[6])).alias("mate_contig_name"),
        _field(7, "mate_pos", "int"), _field(8, "tlen", "int"), F.when(F.col("f")[9] == "*", "").otherwise(F.col("f")[9]).alias("bases"), F.when(F.col("f")[10] == "*", F.array().cast("array<int>")).otherwise(R.phred_values("f[10]")).alias("quals"), tags.alias("tags"), tags["RG"].alias("rg"),
    )


def read_header(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Header lines of one kind (HD, SQ, RG, PG) as maps of their fields, with their line number."""
    lines = numbered_lines(spark, path).filter(F.startswith("value", F.lit(f"@{kind}\t")))
    return lines.select("line", F.expr("map_from_entries(transform(slice(split(value, '\\t'), 2, greatest(size(split(value, '\\t')) - 1, 0)), t -> struct(substr(t, 1, 2), substr(t, 4))))").alias("fields"))


def sam_lines(reads: DataFrame) -> DataFrame:
    """Records as SAM text lines, with ``idx`` kept for ordering."""
    tags = F.expr("if(tags is null or size(tags) = 0, null, array_join(transform(array_sort(map_entries(tags)), e -> concat(e.key, ':Z:', e.value)), '\t'))")
    line = F.concat_ws("\t", "name", F.col("flags").cast("string"), F.coalesce("contig_name", F.lit("*")), F.col("pos").cast("string"), F.col("mapq").cast("string"), "cigar", F.coalesce("mate_contig_name", F.lit("*")), F.col("mate_pos").cast("string"), F.col("tlen").cast("string"), F.when(F.col("bases") == "", "*").otherwise(F.col("bases")), F.when(F.size("quals") == 0, "*").otherwise(R.phred_text("quals")), tags)
    return reads.select("idx", line.alias("value"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(idx, read_name, bases, qualities): groups of four lines; a separator that is none, or lengths that differ, is an error."""
    lines = numbered_lines(spark, path).withColumn("_r", F.floor(F.col("line") / 4)).withColumn("_k", F.col("line") % 4)
    pick = lambda k: F.max(F.when(F.col("_k") == k, F.col("value")))
    g = lines.groupBy("file", "_r").agg(pick(0).alias("h"), pick(1).alias("bases"), pick(2).alias("s"), pick(3).alias("q"))
    ok = F.startswith("h", F.lit("@")) & F.startswith("s", F.lit("+")) & (F.length("bases") == F.length("q"))
    return g.filter("h <> '' or bases is not null").select(F.col("_r").alias("idx"), F.when(ok, F.regexp_extract("h", r"^@(\S+)", 1)).otherwise(F.raise_error(F.concat(F.lit("bad read "), F.col("_r").cast("string")))).alias("read_name"), "bases", F.col("q").alias("qualities"))


def fastq_lines(rows: DataFrame) -> DataFrame:
    return rows.select("idx", F.concat_ws("\n", F.concat(F.lit("@"), F.col("read_name")), "bases", F.lit("+"), "qualities").alias("value"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, line, bases): sequence lines with the name they stand under, up to its first blank; case kept. The name comes from the split, or from the last one before it."""
    lines = numbered_lines(spark, path).withColumn("_h", F.when(F.startswith("value", F.lit(">")), F.regexp_extract("value", r"^>(\S*)", 1)))
    inside = Window.partitionBy("file", "block").orderBy("line")
    lines = lines.withColumn("_name", F.last("_h", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = lines.groupBy("file", "block").agg(F.max_by("_h", F.when(F.col("_h").isNotNull(), F.col("line"))).alias("_last"))
    carry = ends.select("file", "block", F.last("_last", True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    return lines.join(carry, ["file", "block"]).filter(F.col("_h").isNull() & (F.col("value") != "")).select("file", F.coalesce("_name", "_carry").alias("name"), "line", F.trim("value").alias("bases"))


def chunked(fasta: DataFrame, contigs: DataFrame, width: int = 500) -> DataFrame:
    """Sequence lines dealt into chunks of ``width`` bases of their contig (contig, chunk, start, bases)."""
    by = Window.partitionBy("file", "name").orderBy("line")
    x = fasta.withColumn("_at", F.sum(F.length("bases")).over(by) - F.length("bases"))
    cut = x.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("_at") / width), F.floor((F.col("_at") + F.length("bases") - 1) / width))))
    piece = F.expr(f"substr(bases, cast(greatest(chunk * {width} - _at, 0) + 1 as int), cast(least(_at + length(bases), (chunk + 1) * {width}) - greatest(_at, chunk * {width}) as int))")
    g = cut.select("name", "chunk", "line", piece.alias("p")).groupBy("name", "chunk").agg(F.array_sort(F.collect_list(F.struct("line", "p"))).alias("c"))
    g = g.withColumn("bases", F.array_join(F.transform("c", lambda e: e["p"]), ""))
    return g.join(F.broadcast(contigs.select("contig", F.col("contig_name").alias("name"))), "name").select("contig", "chunk", (F.col("chunk") * width + 1).cast("int").alias("start"), "bases")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, ("contig_name", "string"), ("start0", "int"), ("stop0", "int"), ("name", "string"), ("score", "double"), ("strand", "string"), skip="#|track|browser").select("contig_name", (F.col("start0") + 1).alias("start"), F.col("stop0").alias("stop"), "name", F.coalesce("strand", F.lit("+")).alias("strand"))


def read_interval_list(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, ("contig_name", "string"), ("start", "int"), ("stop", "int"), ("strand", "string"), ("name", "string"), skip="@")


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, ("contig_name", "string"), ("source", "string"), ("kind", "string"), ("start", "int"), ("stop", "int"), ("score", "string"), ("strand", "string"), ("phase", "string"), ("attributes", "string"))


def read_refflat(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts with 1-based ranges and their exons as an array of (start, stop)."""
    t = _table(spark, path, ("gene", "string"), ("transcript", "string"), ("contig_name", "string"), ("strand", "string"), ("s", "int"), ("tx_end", "int"), ("cs", "int"), ("cds_end", "int"), ("n", "int"), ("es", "string"), ("ee", "string"))
    exons = F.expr("filter(zip_with(split(es, ','), split(ee, ','), (a, b) -> if(a = '' or b = '', null, named_struct('start', cast(a as int) + 1, 'stop', cast(b as int)))), x -> x is not null)")
    return t.select("gene", "transcript", "contig_name", "strand", (F.col("s") + 1).alias("tx_start"), "tx_end", (F.col("cs") + 1).alias("cds_start"), "cds_end", exons.alias("exons"))


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of forward chains: (contig_name, start, stop, chain, to_contig, offset), 1-based. Blocks of a chain are placed by running sums over its lines."""
    lines = numbered_lines(spark, path).filter("value <> '' and not startswith(value, '#')").withColumn("_h", F.startswith("value", F.lit("chain")))
    by = Window.partitionBy("file").orderBy("line")
    x = lines.withColumn("_c", F.sum(F.col("_h").cast("int")).over(by)).withColumn("f", F.split("value", r"\s+"))
    head = x.filter("_h").select("file", "_c", F.col("f")[2].alias("contig_name"), F.col("f")[5].cast("int").alias("t0"), F.col("f")[7].alias("to_contig"), F.col("f")[9].alias("to_strand"), F.col("f")[10].cast("int").alias("q0"), F.get("f", 12).alias("chain"))
    part = Window.partitionBy("file", "_c").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    b = x.filter("not _h").select("file", "_c", "line", F.col("f")[0].cast("int").alias("n"), F.coalesce(F.get("f", 1).cast("int"), F.lit(0)).alias("dt"), F.coalesce(F.get("f", 2).cast("int"), F.lit(0)).alias("dq"))
    b = b.withColumn("t", F.coalesce(F.sum(F.col("n") + F.col("dt")).over(part), F.lit(0))).withColumn("q", F.coalesce(F.sum(F.col("n") + F.col("dq")).over(part), F.lit(0)))
    j = b.join(head, ["file", "_c"])
    return j.select("contig_name", (F.col("t0") + F.col("t") + 1).alias("start"), (F.col("t0") + F.col("t") + F.col("n")).alias("stop"), "chain", "to_contig", "to_strand", (F.col("q0") + F.col("q") - F.col("t0") - F.col("t")).alias("offset"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Sites with alternatives, filters and INFO as a map, genotypes as an array of (sample, fields). The sample names are one header line, read first."""
    first = spark.read.text(path).filter(F.startswith("value", F.lit("#CHROM"))).limit(1).collect()
    samples = first[0]["value"].split("\t")[9:] if first else []
    f = numbered_lines(spark, path).filter((F.col("value") != "") & ~F.startswith("value", F.lit("#"))).select(F.col("line").alias("idx"), F.split("value", "\t").alias("f"))
    info = F.expr("map_from_entries(transform(filter(split(f[7], ';'), x -> x not in ('', '.')), x -> struct(split(x, '=')[0], if(instr(x, '=') > 0, substr(x, instr(x, '=') + 1), 'true'))))")
    keys = F.expr("split(f[8], ':')")
    names = F.array(*map(F.lit, samples)) if samples else F.array().cast("array<string>")
    g = F.expr("transform(slice(f, 10, greatest(size(f) - 9, 0)), (x, i) -> named_struct('sample', names[i], 'fields', map_from_arrays(slice(keys, 1, size(split(x, ':'))), split(x, ':'))))")
    x = f.withColumn("names", names).withColumn("keys", F.when(F.size("f") > 8, keys))
    return x.select("idx", _field(0, "contig_name"), _field(1, "pos", "int"), _field(2, "id"), _field(3, "ref"), F.when(F.col("f")[4] == ".", "").otherwise(F.col("f")[4]).alias("alts"), F.when(F.col("f")[5] != ".", F.col("f")[5]).cast("double").alias("qual"), F.expr("filter(split(f[6], ';'), x -> x not in ('.', 'PASS', ''))").alias("filters"), info.alias("info"), g.alias("genotypes"))


def vcf_sample_map(spark: SparkSession, path: str) -> DataFrame:
    """(sample, file) for each sample of each VCF file of a path; a file of other than one sample, or a sample of two files, is an error."""
    heads = spark.read.text(path).select(F.input_file_name().alias("file"), "value").filter(F.startswith("value", F.lit("#CHROM"))).select("file", F.slice(F.split("value", "\t"), 10, 1_000_000_000).alias("s"))
    one = heads.select("file", F.when(F.size("s") == 1, F.col("s")[0]).otherwise(F.raise_error(F.concat(F.lit("not one sample in "), F.col("file")))).alias("sample"))
    files = one.groupBy("sample").agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("n"))
    return files.select("sample", F.when(F.col("n") == 1, F.col("file")).otherwise(F.raise_error(F.concat(F.lit("several files of "), F.col("sample")))).alias("file"))


def canonical_variants(v: DataFrame, contigs: DataFrame) -> DataFrame:
    """Rows of ``read_vcf`` with the columns that the variant operators ask for: k, contig, filtered, in_dbsnp (the site has an id), dp, fs and qd from INFO, and calls, an array of (sample, a, b, gq, dp, ad): alleles a <= b,
    null where missing, a haploid call twice, ad of the first alternative. Any number of samples."""
    g = """transform(genotypes, g -> named_struct('sample', g.sample, 'al', array_sort(transform(filter(split(coalesce(g.fields['GT'], '.'), '[/|]'), x -> x <> ''), x -> try_cast(x as int))), 'gq', try_cast(g.fields['GQ'] as int), 'dp', try_cast(g.fields['DP'] as int), 'ad', try_cast(get(split(g.fields['AD'], ','), 1) as int)))"""
    calls = f"transform({g}, g -> named_struct('sample', g.sample, 'a', get(g.al, 0), 'b', get(g.al, size(g.al) - 1), 'gq', g.gq, 'dp', g.dp, 'ad', g.ad))"
    x = v.join(contigs.select("contig", "contig_name"), "contig_name", "left")
    info = lambda k, kind: F.expr(f"try_cast(info['{k}'] as {kind})")
    filtered = F.size(F.filter("filters", lambda f: ~f.isin("PASS", ".", ""))) > 0
    return x.withColumns({"k": F.col("idx"), "filtered": F.coalesce(filtered, F.lit(False)), "in_dbsnp": F.col("id").isNotNull() & (F.col("id") != "."), "dp": info("DP", "int"), "fs": info("FS", "double"), "qd": info("QD", "double"), "calls": F.expr(calls)}).drop("genotypes")


def vcf_lines(v: DataFrame) -> DataFrame:
    """Sites (contig_name, pos, id, ref, alts, qual, filters, info) as text lines."""
    info = F.expr("if(info is null or size(info) = 0, '.', array_join(transform(array_sort(map_entries(info)), e -> if(e.value = 'true', e.key, concat(e.key, '=', e.value))), ';'))")
    return v.select("idx", F.concat_ws("\t", "contig_name", F.col("pos").cast("string"), F.coalesce("id", F.lit(".")), "ref", F.when(F.col("alts") == "", ".").otherwise(F.col("alts")), F.coalesce(F.col("qual").cast("string"), F.lit(".")), F.when(F.size("filters") == 0, "PASS").otherwise(F.array_join("filters", ";")), info).alias("value"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The first table of a metrics file as one row a value: (row, column, value); ``?`` is NaN. Such a file is small and read by one task a file."""
    lines = numbered_lines(spark, path)
    begin = lines.filter(F.startswith("value", F.lit("## METRICS CLASS"))).groupBy("file").agg(F.min("line").alias("b"))
    x = lines.join(begin, "file").filter(F.col("line") > F.col("b"))
    stop = x.filter("value = ''").groupBy("file").agg(F.min("line").alias("e"))
    x = x.join(stop, "file", "left").filter(F.col("e").isNull() | (F.col("line") < F.col("e")))
    head = x.filter(F.col("line") == F.col("b") + 1).select("file", F.split("value", "\t").alias("names"))
    rows = x.filter(F.col("line") > F.col("b") + 1).select("file", (F.col("line") - F.col("b") - 2).alias("row"), F.posexplode(F.split("value", "\t")).alias("k", "v"))
    return rows.join(head, "file").select("row", F.expr("names[k]").alias("column"), F.when(F.col("v") == "?", "NaN").otherwise(F.col("v")).alias("value"))


def metrics_lines(df: DataFrame, name: str) -> list[str]:
    """A small metrics table as the lines of its file."""
    rows = df.collect()
    show = lambda v: "" if v is None else "?" if v != v else f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    return [f"## METRICS CLASS\t{name}", "\t".join(df.columns), *("\t".join(show(v) for v in r) for r in rows), ""]


def write_lines(lines: DataFrame, path: str, header: list[str] | None = None) -> None:
    """(idx, value) as text files in order of idx; header lines come first, in a part of their own."""
    if header:
        spark = lines.sparkSession
        lines = spark.createDataFrame([(i - len(header), h) for i, h in enumerate(header)], "idx long, value string").unionByName(lines.select(F.col("idx").cast("long").alias("idx"), "value"))
    lines.orderBy("idx").select("value").write.text(path)
