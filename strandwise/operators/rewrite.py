"""Rewriting whole tables of records, variants, features and sequences: sorting, merging, splitting, renaming, dictionaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records as R


def replaced_read_group(reads: DataFrame, rg: str, library: str, sample: str) -> DataFrame:
    """All records in one new read group of one library and sample; their old ones are gone."""
    return reads.withColumn("rg", F.lit(rg)).withColumn("library", F.lit(library)).withColumn("sample", F.lit(sample))


def reordered(reads: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Records with the contig numbers of another dictionary, matched by name. Those on a contig that it lacks are left out; a mate there loses its place.

    Dictionaries are (contig, contig_name). Unmapped records without a contig stay.
    """
    to = old.join(new.select(F.col("contig").alias("_to"), "contig_name"), "contig_name", "left").select(F.col("contig").alias("_from"), "_to")
    x = reads.join(to.select(F.col("_from").alias("contig"), F.col("_to").alias("_c"), F.lit(True).alias("_known")), "contig", "left")
    x = x.join(to.select(F.col("_from").alias("mate_contig"), F.col("_to").alias("_m")), "mate_contig", "left").filter(F.col("_c").isNotNull() | F.col("_known").isNull())
    x = x.withColumn("mate_pos", F.when(F.col("_m").isNull(), 0).otherwise(F.col("mate_pos"))).withColumn("mate_contig", F.coalesce("_m", F.lit(-1))).withColumn("contig", F.coalesce("_c", F.lit(-1)))
    return x.drop("_c", "_m", "_known")


def merged_records(inputs: list[DataFrame]) -> DataFrame:
    """Records of several inputs as one table, with ``input``, the number of theirs. A read group id that stands for different libraries or samples gets the suffix .1, .2, ... in every input but the first that has it."""
    every = reduce(DataFrame.unionByName, [x.withColumn("input", F.lit(i)) for i, x in enumerate(inputs)])
    groups = every.groupBy("rg", "library", "sample").agg(F.min("input").alias("_first"))  # a row for each group, not for each record
    order = Window.partitionBy("rg").orderBy("_first", "library", "sample")
    names = groups.withColumn("_n", F.row_number().over(order) - 1)
    names = names.select(F.col("rg").alias("_rg"), F.col("library").alias("_library"), F.col("sample").alias("_sample"), F.when(F.col("_n") == 0, F.col("rg")).otherwise(F.concat_ws(".", "rg", F.col("_n").cast("string"))).alias("_new"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("rg", "library", "sample")]
    kept = [F.col(c) if c != "rg" else F.col("_new").alias("rg") for c in every.columns]
    return every.join(names, reduce(Column.__and__, same), "left").select(*kept)


def file_names_by_library(reads: DataFrame) -> DataFrame:
    """Records with the name of the file of their library; those of none go to ``unknown``. Write with partitionBy("file")."""
    return reads.withColumn("file", F.coalesce(F.regexp_replace("library", r"[^A-Za-z0-9_.-]", "_"), F.lit("unknown")))


def numbered_records(rows: DataFrame, key: str, of: list[str] | None = None, buckets: int = 1024, ties: list[str] | None = None) -> DataFrame:
    """Add ``ordinal``, the gapless number of a row from 0 in order of the numeric ``key``, then ``ties`` (in each group). Rows are numbered within ranges of the key, whose totals are summed up first, so that no task holds all."""
    of = of or []
    ends = rows.agg(F.min(key).alias("_a"), F.max(key).alias("_b"))
    x = rows.crossJoin(F.broadcast(ends)).withColumn("_bucket", F.floor((F.col(key) - F.col("_a")) / ((F.col("_b") - F.col("_a")) / F.lit(buckets) + 1)).cast("int"))
    heads = x.groupBy(*of, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    heads = heads.select(*of, "_bucket", F.coalesce(F.sum("_n").over(Window.partitionBy(*of).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    x = x.withColumn("_k", F.row_number().over(Window.partitionBy(*of, "_bucket").orderBy(key, *(ties or []))))
    return x.join(heads, [*of, "_bucket"]).withColumn("ordinal", (F.col("_before") + F.col("_k") - 1).cast("long")).drop("_a", "_b", "_bucket", "_before", "_k")


def files_by_number(reads: DataFrame, per_file: int, order: str = "idx") -> DataFrame:
    """Records with the number, from 1, of their file of ``per_file`` records in order of ``order``; a template whose records follow each other is not cut: all of it goes where its first record goes."""
    x = numbered_records(reads, order)
    first = x.groupBy("name").agg(F.min("ordinal").alias("_first"))
    return x.join(first, "name").withColumn("file", (F.floor(F.col("_first") / per_file) + 1).cast("long")).drop("_first", "ordinal")


def gathered_records(inputs: list[DataFrame]) -> DataFrame:
    """Records of inputs that follow each other, one after the other, as they are; their dictionaries must be the same. ``input`` and ``idx`` give the order."""
    return reduce(DataFrame.unionByName, [x.withColumn("input", F.lit(i)) for i, x in enumerate(inputs)])


def index_stats(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """By contig: its length, mapped records, and unmapped ones placed there."""
    c = reads.groupBy("contig").agg(R.count_true(~R.has(R.UNMAPPED)).alias("aligned"), R.count_true(R.has(R.UNMAPPED)).alias("unaligned"))
    return contigs.select("contig", "contig_name", "length").join(c, "contig", "left").fillna(0, ["aligned", "unaligned"]).drop("contig")


def original_qualities(reads: DataFrame, original: str = "oq") -> DataFrame:
    """Records with their original qualities put back where they have any, and their mate's CIGAR."""
    from .records import fixed_mates

    mc = fixed_mates(reads).select("idx", "mc")
    return reads.join(mc, "idx", "left").withColumn("quals", F.coalesce(original, "quals"))


def clipped_cigar(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """(idx, cigar): of records that reach past their contig's end, the CIGAR with all beyond it as soft clip (hard clips at its end stay); others as they are."""
    r = reads.withColumn("ops", R.cigar_ops()).join(contigs.select("contig", "length"), "contig", "left")
    step = """aggregate(ops, named_struct('left', cast(greatest(length - pos + 1, 0) as int), 'clip', 0, 'hard', 0, 'out', ''), (s, e) -> case
      when e.op = 'H' and s.out <> '' then named_struct('left', s.left, 'clip', s.clip, 'hard', e.len, 'out', s.out)
      when e.op in ('M', '=', 'X') then named_struct('left', greatest(s.left - e.len, 0), 'clip', s.clip + greatest(e.len - s.left, 0), 'hard', s.hard, 'out', if(least(e.len, s.left) > 0, concat(s.out, least(e.len, s.left), e.op), s.out))
      when e.op in ('D', 'N') then named_struct('left', greatest(s.left - e.len, 0), 'clip', s.clip, 'hard', s.hard, 'out', if(s.left > e.len, concat(s.out, e.len, e.op), s.out))
      when e.op in ('I', 'S') and (s.left = 0) then named_struct('left', s.left, 'clip', s.clip + e.len, 'hard', s.hard, 'out', s.out)
      else named_struct('left', s.left, 'clip', s.clip, 'hard', s.hard, 'out', concat(s.out, e.len, e.op)) end,
      s -> concat(s.out, if(s.clip > 0, concat(s.clip, 'S'), ''), if(s.hard > 0, concat(s.hard, 'H'), '')))"""
    over = ~R.has(R.UNMAPPED) & (R.alignment_end() > F.col("length"))
    return r.select("idx", F.when(over, F.expr(step)).otherwise(F.col("cigar")).alias("cigar"))


def tagged_fastq(reads: DataFrame, tags: list[str]) -> DataFrame:
    """Reads as sequenced, with the texts of some columns joined before the bases, and their qualities of the same length (J)."""
    from .records import fastq

    tag = F.concat_ws("", *tags)
    rows = fastq(reads).join(reads.select("idx", tag.alias("tag")), "idx")
    return rows.select("idx", "read_name", F.concat("tag", "bases").alias("bases"), F.concat(F.expr("repeat('J', length(tag))"), "qualities").alias("qualities"))


def sites_only(v: DataFrame, genotype_columns: list[str]) -> DataFrame:
    """Variants without their genotypes; what the site says stays."""
    return v.drop(*genotype_columns)


def renamed_sample(genotypes: DataFrame, old: str, new: str) -> DataFrame:
    """Genotypes with one sample's name changed."""
    return genotypes.withColumn("sample", F.when(F.col("sample") == old, new).otherwise(F.col("sample")))


def merged_variants(inputs: list[DataFrame]) -> DataFrame:
    """Variants of several inputs in order of place, those at one place in order of their inputs: a range-partitioned sort. ``input`` is the number of a row's."""
    every = reduce(DataFrame.unionByName, [x.withColumn("input", F.lit(i)) for i, x in enumerate(inputs)])
    return every.orderBy("contig", "pos", "input", "k")


def gathered_variants(inputs: list[DataFrame]) -> DataFrame:
    """Variants of inputs that follow each other, as one table; raises where an input starts before the end of the one before it."""
    ends = [x.agg(F.min(F.struct("contig", "pos")).alias("a"), F.max(F.struct("contig", "pos")).alias("b")).first() for x in inputs]
    held = [(i, e) for i, e in enumerate(ends) if e["a"] is not None]
    for (_, x), (j, y) in zip(held, held[1:], strict=False):
        if tuple(y["a"]) < tuple(x["b"]):
            raise ValueError(f"input {j} starts before the end of the one before")
    return reduce(DataFrame.unionByName, inputs)


def updated_dictionary(v: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Variants with the contig numbers of another dictionary, by name; raises for a variant on a contig that it lacks."""
    to = old.join(new.select(F.col("contig").alias("_to"), "contig_name"), "contig_name", "left")
    x = v.join(to.select("contig", "contig_name", "_to"), "contig", "left")
    return x.withColumn("contig", F.coalesce("_to", F.raise_error(F.concat(F.lit("no contig "), F.coalesce("contig_name", F.col("contig").cast("string")))).cast("int"))).drop("_to", "contig_name")


def sorted_features(features: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Features by contig (by name, or by their place in a dictionary, unknown ones first), then start; ties in input order."""
    if dictionary is None:
        return features.orderBy("contig_name", "start", "idx")
    x = features.join(dictionary.select("contig_name", F.col("contig").alias("_at")), "contig_name", "left")
    return x.orderBy(F.coalesce("_at", F.lit(-1)), "start", "idx").drop("_at")


def wrapped_sequences(reference: DataFrame, width: int = 100, chunk: int = 500) -> DataFrame:
    """(contig, line, bases): a chunked reference in lines of ``width`` bases, from 0. A line meets the pieces of at most two chunks more than it fills."""
    x = reference.select("contig", F.col("start").cast("long").alias("start"), "bases")
    cut = x.withColumn("line", F.explode(F.sequence(F.floor((F.col("start") - 1) / width), F.floor((F.col("start") + F.length("bases") - 2) / width))))
    piece = F.expr(f"substr(bases, cast(greatest(line * {width} - (start - 1), 0) + 1 as int), cast(least(start - 1 + length(bases), (line + 1) * {width}) - greatest(start - 1, line * {width}) as int))")
    rows = cut.select("contig", "line", "start", piece.alias("p")).groupBy("contig", "line").agg(F.array_sort(F.collect_list(F.struct("start", "p"))).alias("c"))
    return rows.select("contig", "line", F.array_join(F.transform("c", lambda e: e["p"]), "").alias("bases"))


def dictionary_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Contigs of two dictionaries by name: the first's in its order, then those that the second alone has; raises where one name has two lengths."""
    j = a.select("contig_name", F.col("contig").alias("_a"), F.col("length").alias("_la")).join(b.select("contig_name", F.col("contig").alias("_b"), F.col("length").alias("_lb")), "contig_name", "full_outer")
    length = F.when(F.col("_la") != F.col("_lb"), F.raise_error(F.concat(F.lit("two lengths of "), F.col("contig_name"))).cast("int")).otherwise(F.coalesce("_la", "_lb"))
    order = Window.orderBy(F.col("_a").asc_nulls_last(), "_b")  # over a dictionary
    return j.select("contig_name", length.alias("length"), (F.row_number().over(order) - 1).alias("contig"))


def duplicate_order(reads: DataFrame) -> list[Column]:
    """Order of records for duplicate detection: by library, contig, unclipped 5' end, strand, then ordinal; unmapped and secondary ones last. For records with ``five``, see duplicates.ends."""
    return [F.col("library"), F.col("contig"), F.col("five"), R.has(R.REVERSE), F.col("idx")]
