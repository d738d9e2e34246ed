"""Variant operators: types, filters, calling metrics, Mendelian violations, concordance, lifting, splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as R


def alternatives(alts: str = "alts") -> Column:
    return F.filter(F.split(alts, ","), lambda x: x != "")


def variant_type(ref: str = "ref", alts: str = "alts") -> Column:
    """NO_VARIATION, SNP, MNP, INDEL, SYMBOLIC or MIXED of a site's alternatives (comma-joined); spanning deletions count as none."""
    kind = (
        f"case when a like '<%' or a like '%[%' or a like '%]%' then 'SYMBOLIC' when length(a) <> length({ref}) then 'INDEL' when length(a) = 1 then 'SNP' else 'MNP' end"
    )
    return F.expr(f"aggregate(array_distinct(transform(filter(split({alts}, ','), a -> a not in ('', '*', '.')), a -> {kind})), cast(null as string), (t, k) -> if(t is null, k, 'MIXED'), t -> coalesce(t, 'NO_VARIATION'))")


def is_transition(ref: str = "ref", alt: str = "alts") -> Column:
    return F.concat(ref, alt).isin("AG", "GA", "CT", "TC")


def is_complex_indel(ref: str = "ref", alts: str = "alts") -> Column:
    """An indel of several alternatives, or one whose shorter allele is longer than a base and doesn't begin the longer one."""
    one = F.size(F.split(alts, ",")) == 1
    short, long = F.when(F.length(ref) < F.length(alts), F.col(ref)).otherwise(F.col(alts)), F.when(F.length(ref) < F.length(alts), F.col(alts)).otherwise(F.col(ref))
    return ~one | ~F.startswith(long, short)


def site_filters(v: DataFrame, min_qual: float = 30.0, max_fs: float = 60.0, min_qd: float = 2.0, min_dp: int = 15) -> DataFrame:
    """Add filters: the names of the site rules it breaks, sorted; PASS if none."""
    f = F.array_compact(F.array(F.when(F.col("qual") < min_qual, F.lit("LowQual")), F.when(F.col("fs") > max_fs, F.lit("StrandBias")), F.when((F.col("qd") >= 0) & (F.col("qd") < min_qd), F.lit("LowQD")), F.when(F.col("dp") < min_dp, F.lit("LowDepth"))))
    return v.withColumn("filters", F.when(F.size(f) == 0, "PASS").otherwise(F.array_join(F.array_sort(F.array_distinct(f)), ";")))


def genotypes(v: DataFrame) -> DataFrame:
    """One row for each sample of a site: alleles a <= b, gq, dp and ad of the first alternative. Samples are an array ``calls``, of any number, or the numbered columns of a trio."""
    if "calls" in v.columns:
        return v.select(*[c for c in v.columns if c not in ("calls", "dp")], F.explode("calls").alias("g")).select("*", "g.*").drop("g")
    s = lambda i, name: F.struct(F.lit(name).alias("sample"), F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"), F.col(f"gq{i}").alias("gq"), F.col(f"dp{i}").alias("dp"), F.col(f"ad{i}").alias("ad"))
    return v.select("*", F.explode(F.array(s(0, "father"), s(1, "mother"), s(2, "child"))).alias("g")).select(*[c for c in v.columns if c not in {f"{x}{i}" for x in ("a", "b", "gq", "dp", "ad") for i in range(3)}], "g.*")


def genotype_filters(v: DataFrame, min_gq: int = 20, min_dp: int = 8) -> DataFrame:
    """By site: how many genotypes break a rule, and whether all variant ones do."""
    g = genotypes(v).withColumn("bad", (F.col("gq") < min_gq) | (F.col("dp") < min_dp)).withColumn("variant", F.col("b") > 0)
    return g.groupBy("k").agg(R.count_true(F.col("bad")).alias("filtered"), (R.count_true(F.col("variant")) > 0).alias("_any"), R.count_true(F.col("variant") & ~F.col("bad")).alias("_good")).select("k", "filtered", (F.col("_any") & (F.col("_good") == 0)).alias("all_gts_filtered"))


def calling_summary(v: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """SNPs, indels, multiallelic and complex ones, known and new, with transition-transversion ratios."""
    t = v.withColumn("t", variant_type()).withColumn("many", F.size(alternatives()) > 1)
    f, c = F.col, R.count_true
    snp, indel = (f("t") == "SNP") & ~f("many"), (f("t") == "INDEL") & ~is_complex_indel()
    complex_ = (f("t") == "INDEL") & is_complex_indel()
    ok, known = ~f("filtered"), f("in_dbsnp")
    ti = is_transition()
    return t.groupBy(*(keys or [])).agg(
        c(ok & snp).alias("total_snps"), c(ok & snp & known).alias("num_in_db_snp"), c(ok & snp & ~known).alias("novel_snps"), c(~ok & snp).alias("filtered_snps"), R.rounded(R.ratio(c(ok & snp & known), c(ok & snp))).alias("pct_dbsnp"),
        R.rounded(R.ratio(c(ok & snp & known & ti), c(ok & snp & known & ~ti))).alias("dbsnp_titv"), R.rounded(R.ratio(c(ok & snp & ~known & ti), c(ok & snp & ~known & ~ti))).alias("novel_titv"),
        c(ok & indel).alias("total_indels"), c(~ok & indel).alias("filtered_indels"), c(ok & complex_).alias("total_complex_indels"), c(ok & f("many") & (f("t") == "SNP")).alias("total_multiallelic_snps"),
        R.rounded(R.ratio(c(ok & indel & (F.length("alts") > F.length("ref"))), c(ok & indel & (F.length("alts") < F.length("ref"))))).alias("ins_del_ratio"),
    )


def calling_detail(v: DataFrame) -> DataFrame:
    """By sample: variant genotypes, heterozygous to homozygous ratio, and those of quality 0."""
    g = genotypes(v.filter(~F.col("filtered"))).filter("b > 0")
    het = F.col("a") != F.col("b")
    return g.groupBy("sample").agg(F.count(F.lit(1)).alias("variants"), R.rounded(R.ratio(R.count_true(het), R.count_true(~het))).alias("het_homvar_ratio"), R.count_true(F.col("gq") == 0).alias("total_gq0_variants"), R.sum_if(het, F.col("dp")).alias("total_het_depth"))


def singletons(v: DataFrame) -> DataFrame:
    """Sites of which exactly one sample carries a single alternative allele, by sample."""
    one = genotypes(v).groupBy("k").agg(F.sum(F.when(F.col("a") > 0, 1).otherwise(0) + F.when(F.col("b") > 0, 1).otherwise(0)).alias("alts"), F.min_by("sample", -F.col("b")).alias("sample")).filter("alts = 1")
    return one.groupBy("sample").agg(F.count(F.lit(1)).alias("num_singletons"))


def trio(v: DataFrame, father: str, mother: str, child: str) -> DataFrame:
    """Sites with the calls of three samples as numbered columns (0 father, 1 mother, 2 child); those where one is not called are left out."""
    one = lambda name: F.get(F.filter("calls", lambda c: c["sample"] == name), F.lit(0))
    picked = v.withColumns({f"_s{i}": one(name) for i, name in enumerate((father, mother, child))})
    out = picked.withColumns({f"{x}{i}": F.col(f"_s{i}")[x] for i in range(3) for x in ("a", "b", "gq", "dp", "ad")})
    return out.filter("a0 is not null and a1 is not null and a2 is not null").drop("calls", "_s0", "_s1", "_s2")


def mendelian(v: DataFrame, min_gq: int = 10, min_dp: int = 6) -> DataFrame:
    """Violations of the trio over good SNP sites, by class."""
    g = v.filter((variant_type() == "SNP") & ~F.col("filtered") & (F.least("gq0", "gq1", "gq2") >= min_gq) & (F.least("dp0", "dp1", "dp2") >= min_dp))
    carried = (F.greatest("b0", "b1", "b2") > 0)
    fine = ((F.col("a2").isin(0) & ((F.col("a0") == 0) | (F.col("b0") == 0)) | F.col("a2").isin(1) & ((F.col("a0") == 1) | (F.col("b0") == 1))) & (F.col("b2").isin(0) & ((F.col("a1") == 0) | (F.col("b1") == 0)) | F.col("b2").isin(1) & ((F.col("a1") == 1) | (F.col("b1") == 1)))) | (
        (F.col("a2").isin(0) & ((F.col("a1") == 0) | (F.col("b1") == 0)) | F.col("a2").isin(1) & ((F.col("a1") == 1) | (F.col("b1") == 1))) & (F.col("b2").isin(0) & ((F.col("a0") == 0) | (F.col("b0") == 0)) | F.col("b2").isin(1) & ((F.col("a0") == 1) | (F.col("b0") == 1)))
    )
    hom = lambda i, x: (F.col(f"a{i}") == x) & (F.col(f"b{i}") == x)
    het = lambda i: F.col(f"a{i}") != F.col(f"b{i}")
    kind = (
        F.when(hom(0, 0) & hom(1, 0) & (F.col("b2") > 0), "DIPLOID_DENOVO").when(hom(0, 1) & hom(1, 1) & het(2), "HOMVAR_HOMVAR_HET").when(((hom(0, 0) & hom(1, 1)) | (hom(0, 1) & hom(1, 0))) & ~het(2), "HOMREF_HOMVAR_HOM")
        .when(((het(0) & ~het(1)) | (het(1) & ~het(0))) & ~het(2), "HOM_HET_HOM").otherwise("OTHER")
    )
    return g.filter(carried).withColumn("kind", F.when(fine, "NONE").otherwise(kind)).groupBy("kind").agg(F.count(F.lit(1)).alias("sites"))


def state(a: str, b: str, gq: str, dp: str, min_gq: int, min_dp: int) -> Column:
    """A genotype's state in concordance: missing, low quality before low depth, or by its alleles."""
    return F.when(F.col(a).isNull(), "MISSING").when(F.col(gq) < min_gq, "LOW_GQ").when(F.col(dp) < min_dp, "LOW_DP").when(F.col(b) == 0, "HOM_REF").when(F.col(a) == F.col(b), "HOM_VAR1").when(F.col(a) == 0, "HET_REF_VAR1").otherwise("HET_VAR1_VAR2")


def concordance(truth: DataFrame, call: DataFrame, min_gq: int = 20, min_dp: int = 8) -> DataFrame:
    """Sites by truth and call state, joined by place; a site of one side alone is missing on the other."""
    t = truth.select("contig", "pos", *(F.col(c).alias(f"t_{c}") for c in ("a", "b", "gq", "dp"))).dropDuplicates(["contig", "pos"])
    c = call.select("contig", "pos", *(F.col(x).alias(f"c_{x}") for x in ("a", "b", "gq", "dp"))).dropDuplicates(["contig", "pos"])
    j = t.join(c, ["contig", "pos"], "full_outer")
    return j.groupBy(state("t_a", "t_b", "t_gq", "t_dp", min_gq, min_dp).alias("truth_state"), state("c_a", "c_b", "c_gq", "c_dp", min_gq, min_dp).alias("call_state")).agg(F.count(F.lit(1)).alias("sites"))


def concordance_rates(table: DataFrame) -> DataFrame:
    """Sensitivity and predictive value of heterozygous and homozygous variant calls, from a table of states."""
    f = F.col
    n = lambda c: R.sum_if(c, f("sites"))
    het, hom = f("truth_state") == "HET_REF_VAR1", f("truth_state") == "HOM_VAR1"
    chet, chom = f("call_state") == "HET_REF_VAR1", f("call_state") == "HOM_VAR1"
    clear = f("truth_state").isin("HET_REF_VAR1", "HOM_VAR1", "HOM_REF") & f("call_state").isin("HET_REF_VAR1", "HOM_VAR1", "HOM_REF")
    return table.agg(
        R.rounded(R.ratio(n(het & chet), n(het & clear))).alias("het_sensitivity"), R.rounded(R.ratio(n(het & chet), n(chet & clear))).alias("het_ppv"), R.rounded(R.ratio(n(hom & chom), n(hom & clear))).alias("homvar_sensitivity"),
        R.rounded(R.ratio(n(hom & chom), n(chom & clear))).alias("homvar_ppv"), R.rounded(R.ratio(n(clear & (f("truth_state") == f("call_state"))), n(clear))).alias("genotype_concordance"),
    )


def to_intervals(v: DataFrame) -> DataFrame:
    return v.filter(~F.col("filtered")).select("contig", F.col("pos").alias("start"), (F.col("pos") + F.length("ref") - 1).cast("int").alias("stop"), F.concat(F.lit("v"), F.col("k").cast("string")).alias("name"))


def lifted(v: DataFrame, chain: DataFrame, reference: DataFrame, chunk: int = 500) -> DataFrame:
    """SNP sites lifted over chain blocks (contig, start, stop, to_contig, offset): where the reference there equals ref, or alt (then swapped, with genotypes mirrored); rejected otherwise."""
    from .intervals import overlaps

    site = v.filter(variant_type() == "SNP").filter(F.length("alts") == 1).select("contig", F.col("pos").alias("start"), F.col("pos").alias("stop"), "k", "ref", "alts", "a2", "b2")
    hit = overlaps(site, chain).select("a.*", "b.to_contig", (F.col("a.start") + F.col("b.offset")).alias("to_pos"))
    ref = reference.select(F.col("contig").cast("long").alias("to_contig"), F.col("chunk").cast("long").alias("_c"), F.col("start").alias("_s"), F.col("bases").alias("_b"))
    x = hit.withColumn("to_contig", F.col("to_contig").cast("long")).withColumn("_c", F.floor((F.col("to_pos") - 1) / chunk)).join(ref, ["to_contig", "_c"], "left").withColumn("there", F.expr("substr(_b, cast(to_pos - _s + 1 as int), 1)"))
    swap = F.col("there") == F.col("alts")
    status = F.when(F.col("there") == F.col("ref"), "LIFTED").when(swap, "SWAPPED").otherwise("MISMATCH")
    return x.select("k", "to_contig", "to_pos", status.alias("status"), F.when(swap, 1 - F.col("b2")).otherwise(F.col("a2")).alias("a"), F.when(swap, 1 - F.col("a2")).otherwise(F.col("b2")).alias("b"))


def genotype_likelihoods(v: DataFrame, error: float = 0.01) -> DataFrame:
    """Log10 likelihoods of the three genotypes of each sample at SNP sites, from depth and alternative depth."""
    g = genotypes(v.filter(variant_type() == "SNP")).filter("dp > 0").withColumn("ad", F.least("ad", "dp"))
    ll = lambda p: F.col("ad") * F.log10(F.lit(p)) + (F.col("dp") - F.col("ad")) * F.log10(F.lit(1 - p))
    return g.select("k", "contig", "sample", ll(error).alias("l0"), ll(0.5).alias("l1"), ll(1 - error).alias("l2"))


def crosscheck(likelihoods: DataFrame, maf: float = 0.3) -> DataFrame:
    """For each pair of samples the log odds that they are one individual: per site, the likelihood of one genotype for both over that of independent ones, summed.

    Samples meet by site, so the cost is sites times sample pairs of a panel; no pair of samples without a common site is made.
    """
    p = [(1 - maf) ** 2, 2 * maf * (1 - maf), maf**2]
    other = likelihoods.select("k", F.col("sample").alias("right"), *(F.col(f"l{i}").alias(f"m{i}") for i in range(3)))
    j = likelihoods.join(other, "k").filter(F.col("sample") <= F.col("right"))
    ten = lambda c: F.pow(F.lit(10.0), c)
    same = sum((F.lit(p[i]) * ten(F.col(f"l{i}") + F.col(f"m{i}")) for i in range(1, 3)), F.lit(p[0]) * ten(F.col("l0") + F.col("m0")))
    one = lambda x: sum((F.lit(p[i]) * ten(F.col(f"{x}{i}")) for i in range(1, 3)), F.lit(p[0]) * ten(F.col(f"{x}0")))
    lod = F.log10(same) - F.log10(one("l")) - F.log10(one("m"))
    return j.groupBy(F.col("sample").alias("left"), "right").agg(F.count(F.lit(1)).alias("sites"), R.rounded(F.sum(lod), 3).alias("lod"))


def crosscheck_results(pairs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """EXPECTED or UNEXPECTED match or mismatch, strictly beyond the threshold; else INCONCLUSIVE."""
    same = F.col("left") == F.col("right")
    r = F.when(F.col("lod") > threshold, F.when(same, "EXPECTED_MATCH").otherwise("UNEXPECTED_MATCH")).when(F.col("lod") < -threshold, F.when(same, "UNEXPECTED_MISMATCH").otherwise("EXPECTED_MISMATCH")).otherwise("INCONCLUSIVE")
    return pairs.withColumn("result", r)
