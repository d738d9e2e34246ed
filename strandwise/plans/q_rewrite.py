"""Queries of operators.rewrite."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import duplicates as D
from ..operators import rewrite as W
from ..operators import variants as V
from .q_records import FASTQ, MATES
from .q_variants import G
from .registry import ENDS, n, query

NEW = "(SELECT row_number() OVER (ORDER BY contig_name) - 1 AS contig, contig_name FROM contigs WHERE contig % 7 <> 0)"


def _new(t):
    kept = t.contigs.filter("contig % 7 <> 0")
    return kept.select((F.row_number().over(Window.orderBy("contig_name")) - 1).alias("contig"), "contig_name")


@query("sort_sam_records", "SELECT idx, name, contig, pos, flags FROM reads", "reads")
def _(t):
    from ..operators import records as X

    return X.sorted_records(t.reads, X.coordinate_order(t.reads)).select("idx", "name", "contig", "pos", "flags")


@query("sort_duplicate_rank", f"WITH {ENDS}, e AS (SELECT *, CASE WHEN flags & 16 <> 0 THEN stop + trail ELSE pos - lead END AS five FROM ends WHERE flags & 2308 = 0) SELECT idx, {n('row_number() OVER (PARTITION BY library, contig ORDER BY five, flags & 16 <> 0, idx)')} AS rank FROM e", "reads")
def _(t):
    e = D.ends(t.reads)
    w = Window.partitionBy("library", "contig").orderBy(*W.duplicate_order(e)[2:])
    return e.select("idx", F.row_number().over(w).cast("long").alias("rank"))


@query("replace_rg", "SELECT idx, 'new' AS rg, 'lib' AS library, 'sam' AS sample FROM reads", "reads")
def _(t):
    return W.replaced_read_group(t.reads, "new", "lib", "sam").select("idx", "rg", "library", "sample")


@query("reorder_contigs", f"SELECT idx, CAST(a.contig AS INT) AS contig, pos, CAST(coalesce(m.contig, -1) AS INT) AS mate_contig, CASE WHEN m.contig IS NULL THEN 0 ELSE mate_pos END AS mate_pos FROM reads r JOIN contigs c ON r.contig = c.contig JOIN {NEW} a ON a.contig_name = c.contig_name JOIN contigs d ON r.mate_contig = d.contig LEFT JOIN {NEW} m ON m.contig_name = d.contig_name", "reads", "contigs")
def _(t):
    return W.reordered(t.reads, t.contigs, _new(t)).select("idx", "contig", "pos", "mate_contig", "mate_pos")


@query("merge_sam", "SELECT idx, 0 AS input, rg, library FROM reads WHERE mapq > 25 UNION ALL SELECT idx, 1, CASE WHEN EXISTS (SELECT 1 FROM reads x WHERE x.mapq > 25 AND x.rg = r.rg) THEN rg || '.1' ELSE rg END, 'other' FROM reads r WHERE mapq <= 25", "reads")
def _(t):
    return W.merged_records([t.reads.filter("mapq > 25"), t.reads.filter("mapq <= 25").withColumn("library", F.lit("other"))]).select("idx", "input", "rg", "library")


@query("split_sam_by_library", "SELECT idx, library AS file FROM reads", "reads")
def _(t):
    return W.file_names_by_library(t.reads).select("idx", "file")


@query("split_sam_by_number", f"WITH o AS (SELECT idx, name, row_number() OVER (ORDER BY idx) - 1 AS o FROM reads) SELECT idx, {n('min(o) OVER (PARTITION BY name) // 7000 + 1')} AS file FROM o", "reads")
def _(t):
    return W.files_by_number(t.reads.select("idx", "name"), 7000).select("idx", "file")


@query("gather_bam", "SELECT idx, name, CASE WHEN mapq < 20 THEN 0 WHEN mapq < 40 THEN 1 ELSE 2 END AS input FROM reads", "reads")
def _(t):
    return W.gathered_records([t.reads.filter("mapq < 20"), t.reads.filter("mapq >= 20 and mapq < 40"), t.reads.filter("mapq >= 40")]).select("idx", "name", "input")


@query("bam_index_stats", f"SELECT contig_name, length, {n('count(r.idx) FILTER (flags & 4 = 0)')} AS aligned, {n('count(r.idx) FILTER (flags & 4 <> 0)')} AS unaligned FROM contigs c LEFT JOIN reads r USING (contig) GROUP BY ALL", "reads", "contigs")
def _(t):
    return W.index_stats(t.reads, t.contigs)


@query("revert_qualities_mate_cigar", f"{MATES}, mc AS (SELECT ai AS idx, bg AS mc FROM m UNION ALL SELECT bi, ag FROM m) SELECT idx, mc, array_to_string(CASE WHEN nm = 2 THEN list_reverse(quals) ELSE quals END, ',') AS quals FROM reads LEFT JOIN mc USING (idx)", "reads")
def _(t):
    r = t.reads.withColumn("oq", F.when(F.col("nm") == 2, F.reverse("quals")))
    return W.original_qualities(r).select("idx", "mc", F.array_join(F.transform("quals", lambda q: q.cast("string")), ",").alias("quals"))


@query("clean_sam_cigar", f"""WITH {ENDS}, c AS (SELECT *, length // 1000 * 300 AS cut FROM ends JOIN contigs USING (contig)), o AS (SELECT *, flags & 4 = 0 AND stop > cut AND pos <= cut AS over, cut - pos + 1 AS k, len // 2 AS half FROM c)
 SELECT idx, CASE WHEN flags & 4 <> 0 OR stop <= cut THEN cigar WHEN pos > cut THEN CASE ck WHEN 5 THEN '5H' || len || 'S' ELSE len || 'S' END
  WHEN ck = 0 THEN k || 'M' || (len - k) || 'S' WHEN ck = 3 THEN '4S' || k || 'M' || (len - 4 - k) || 'S' WHEN ck = 4 THEN k || 'M' || (len - k) || 'S' WHEN ck = 5 THEN '5H' || k || 'M' || (len - k) || 'S'
  WHEN ck = 2 THEN CASE WHEN k <= half THEN k || 'M' || (len - k) || 'S' ELSE half || 'M3I' || (k - half) || 'M' || (len - k - 3) || 'S' END
  ELSE CASE WHEN k <= half + CASE ck WHEN 1 THEN 5 WHEN 6 THEN 100 ELSE 2 END THEN least(k, half) || 'M' || (len - least(k, half)) || 'S' ELSE half || 'M' || CASE ck WHEN 1 THEN '5D' WHEN 6 THEN '100N' ELSE '2D' END || (k - half - CASE ck WHEN 1 THEN 5 WHEN 6 THEN 100 ELSE 2 END) || 'M' || (len - (k - CASE ck WHEN 1 THEN 5 WHEN 6 THEN 100 ELSE 2 END)) || 'S' END END AS cigar FROM o""", "reads", "contigs")
def _(t):
    short = t.contigs.withColumn("length", F.expr("length div 1000 * 300").cast("int"))
    return W.clipped_cigar(t.reads, short)


@query("sam_to_fastq_with_tags", f"SELECT idx, read_name, umi || bases AS bases, repeat('J', length(umi)) || qualities AS qualities FROM ({FASTQ.replace('SELECT idx,', 'SELECT idx, umi,')}) x", "reads")
def _(t):
    return W.tagged_fastq(t.reads, ["umi"])


@query("sites_only", "SELECT k, contig, pos, ref, alts, qual FROM variants", "variants")
def _(t):
    return W.sites_only(t.variants, [f"{x}{i}" for x in ("a", "b", "gq", "dp", "ad") for i in range(3)]).select("k", "contig", "pos", "ref", "alts", "qual")


@query("rename_sample", f"WITH {G} SELECT k, CASE WHEN sample = 'child' THEN 'proband' ELSE sample END AS sample, gq FROM g", "variants")
def _(t):
    return W.renamed_sample(V.genotypes(t.variants.drop("dp")), "child", "proband").select("k", "sample", "gq")


@query("merge_vcfs", "SELECT k, contig, pos, CASE WHEN filtered THEN 0 ELSE 1 END AS input FROM variants", "variants")
def _(t):
    return W.merged_variants([t.variants.filter("filtered"), t.variants.filter("not filtered")]).select("k", "contig", "pos", "input")


@query("gather_vcfs", "SELECT k, contig, pos FROM variants", "variants")
def _(t):
    return W.gathered_variants([t.variants.filter("contig < 9"), t.variants.filter("contig >= 9 and contig < 20"), t.variants.filter("contig >= 20")]).select("k", "contig", "pos")


@query("update_vcf_dictionary", "WITH d AS (SELECT contig, CAST(row_number() OVER (ORDER BY contig_name) - 1 AS INT) AS fresh FROM contigs) SELECT k, fresh AS contig, pos FROM variants JOIN d USING (contig)", "variants", "contigs")
def _(t):
    fresh = t.contigs.select((F.row_number().over(Window.orderBy("contig_name")) - 1).alias("contig"), "contig_name")
    return W.updated_dictionary(t.variants, t.contigs, fresh).select("k", "contig", "pos")


@query("sort_gff", "SELECT idx, contig_name, start FROM intervals JOIN contigs USING (contig)", "intervals", "contigs")
def _(t):
    f = t.intervals.join(t.contigs.select("contig", "contig_name"), "contig").drop("contig")
    return W.sorted_features(f, t.contigs).select("idx", "contig_name", "start")


@query("normalize_fasta", "WITH w AS (SELECT contig, string_agg(bases, '' ORDER BY chunk) AS b FROM reference GROUP BY contig) SELECT contig, CAST(i AS BIGINT) AS line, substr(b, CAST(i * 70 + 1 AS INT), 70) AS bases FROM (SELECT *, unnest(range(0, (length(b) - 1) // 70 + 1)) AS i FROM w) x", "reference")
def _(t):
    return W.wrapped_sequences(t.reference, 70)


@query("dictionary_union", "WITH a AS (SELECT * FROM contigs WHERE contig % 2 = 0), b AS (SELECT * FROM contigs WHERE contig % 3 = 0), u AS (SELECT contig_name, length, 0 AS s, contig FROM a UNION ALL SELECT contig_name, length, 1, contig FROM b WHERE contig_name NOT IN (SELECT contig_name FROM a)) SELECT contig_name, length, CAST(row_number() OVER (ORDER BY s, contig) - 1 AS INT) AS contig FROM u", "contigs")
def _(t):
    return W.dictionary_union(t.contigs.filter("contig % 2 = 0"), t.contigs.filter("contig % 3 = 0"))
