"""Queries of operators.variants."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import variants as V
from .adapt import DUCK
from .registry import n, query, r

TYPE = "CASE vk WHEN 2 THEN 'MNP' WHEN 3 THEN 'INDEL' WHEN 4 THEN 'INDEL' WHEN 6 THEN 'MIXED' WHEN 7 THEN 'SYMBOLIC' WHEN 8 THEN 'NO_VARIATION' ELSE 'SNP' END"


@query("variant_types", f"SELECT {TYPE} AS type, {n('count(*)')} AS sites FROM variants GROUP BY 1", "variants")
def _(t):
    return t.variants.groupBy(V.variant_type().alias("type")).agg(F.count(F.lit(1)).alias("sites"))


@query("filter_variants", "SELECT k, coalesce(nullif(array_to_string(list_filter([CASE WHEN dp < 15 THEN 'LowDepth' END, CASE WHEN qd >= 0 AND qd < 2 THEN 'LowQD' END, CASE WHEN qual < 30 THEN 'LowQual' END, CASE WHEN fs > 60 THEN 'StrandBias' END], lambda x: x IS NOT NULL), ';'), ''), 'PASS') AS filters FROM variants", "variants")
def _(t):
    return V.site_filters(t.variants).select("k", "filters")


G = "g AS (SELECT *, 'father' AS sample, a0 AS a, b0 AS b, gq0 AS gq, dp0 AS dp_, ad0 AS ad FROM variants UNION ALL SELECT *, 'mother', a1, b1, gq1, dp1, ad1 FROM variants UNION ALL SELECT *, 'child', a2, b2, gq2, dp2, ad2 FROM variants)"


@query("filter_genotypes", f"WITH {G} SELECT k, {n('count(*) FILTER (gq < 20 OR dp_ < 8)')} AS filtered, count(*) FILTER (b > 0) > 0 AND count(*) FILTER (b > 0 AND NOT (gq < 20 OR dp_ < 8)) = 0 AS all_gts_filtered FROM g GROUP BY k", "variants")
def _(t):
    return V.genotype_filters(t.variants.drop("dp"))


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN count(*) FILTER ({b}) = 0 THEN NULL ELSE {r(f'CAST(count(*) FILTER ({a}) AS DOUBLE) / count(*) FILTER ({b})')} END"


S1, IND, TI = "ty = 'SNP' AND vk <> 5", "vk IN (3, 4)", "ref || alts IN ('AG', 'GA', 'CT', 'TC')"
SUMMARY = f"""WITH v AS (SELECT *, {TYPE} AS ty FROM variants) SELECT {{keys}} {n(f'count(*) FILTER (NOT filtered AND {S1})')} AS total_snps, {n(f'count(*) FILTER (NOT filtered AND {S1} AND in_dbsnp)')} AS num_in_db_snp, {n(f'count(*) FILTER (NOT filtered AND {S1} AND NOT in_dbsnp)')} AS novel_snps,
 {n(f'count(*) FILTER (filtered AND {S1})')} AS filtered_snps, {_ratio(f'NOT filtered AND {S1} AND in_dbsnp', f'NOT filtered AND {S1}')} AS pct_dbsnp, {_ratio(f'NOT filtered AND {S1} AND in_dbsnp AND {TI}', f'NOT filtered AND {S1} AND in_dbsnp AND NOT {TI}')} AS dbsnp_titv,
 {_ratio(f'NOT filtered AND {S1} AND NOT in_dbsnp AND {TI}', f'NOT filtered AND {S1} AND NOT in_dbsnp AND NOT {TI}')} AS novel_titv, {n(f'count(*) FILTER (NOT filtered AND {IND})')} AS total_indels, {n(f'count(*) FILTER (filtered AND {IND})')} AS filtered_indels, CAST(0 AS BIGINT) AS total_complex_indels,
 {n('count(*) FILTER (NOT filtered AND vk = 5)')} AS total_multiallelic_snps, {_ratio('NOT filtered AND vk = 3', 'NOT filtered AND vk = 4')} AS ins_del_ratio FROM v {{group}}"""


@query("variant_calling_summary", SUMMARY.format(keys="", group=""), "variants")
def _(t):
    return V.calling_summary(t.variants)


@query("variant_calling_by_contig", SUMMARY.format(keys="contig,", group="GROUP BY contig"), "variants")
def _(t):
    return V.calling_summary(t.variants, ["contig"])


@query("variant_calling_detail", f"WITH {G} SELECT sample, {n('count(*)')} AS variants, {_ratio('a <> b', 'a = b')} AS het_homvar_ratio, {n('count(*) FILTER (gq = 0)')} AS total_gq0_variants, {n('coalesce(sum(dp_) FILTER (a <> b), 0)')} AS total_het_depth FROM g WHERE NOT filtered AND b > 0 GROUP BY sample", "variants")
def _(t):
    return V.calling_detail(t.variants.drop("dp"))


@query("singletons", f"WITH c AS (SELECT CASE WHEN b0 > 0 THEN 'father' WHEN b1 > 0 THEN 'mother' ELSE 'child' END AS sample FROM variants WHERE a0 + b0 + a1 + b1 + a2 + b2 = 1) SELECT sample, {n('count(*)')} AS num_singletons FROM c GROUP BY sample", "variants")
def _(t):
    return V.singletons(t.variants.drop("dp"))


@query("mendelian", f"""WITH s AS (SELECT * FROM variants WHERE {TYPE} = 'SNP' AND NOT filtered AND least(gq0, gq1, gq2) >= 10 AND least(dp0, dp1, dp2) >= 6 AND greatest(b0, b1, b2) > 0),
 f AS (SELECT *, (list_contains([a0, b0], a2) AND list_contains([a1, b1], b2)) OR (list_contains([a1, b1], a2) AND list_contains([a0, b0], b2)) AS fine, a0 = b0 AS h0, a1 = b1 AS h1, a2 = b2 AS h2 FROM s)
 SELECT CASE WHEN fine THEN 'NONE' WHEN h0 AND h1 AND a0 = 0 AND a1 = 0 AND b2 > 0 THEN 'DIPLOID_DENOVO' WHEN h0 AND h1 AND a0 = 1 AND a1 = 1 AND NOT h2 THEN 'HOMVAR_HOMVAR_HET' WHEN h0 AND h1 AND a0 <> a1 AND h2 THEN 'HOMREF_HOMVAR_HOM' WHEN h0 <> h1 AND h2 THEN 'HOM_HET_HOM' ELSE 'OTHER' END AS kind, {n('count(*)')} AS sites FROM f GROUP BY 1""", "variants")
def _(t):
    return V.mendelian(t.variants)


STATE = lambda p: f"CASE WHEN {p}.a IS NULL THEN 'MISSING' WHEN {p}.gq < 20 THEN 'LOW_GQ' WHEN {p}.dp < 8 THEN 'LOW_DP' WHEN {p}.b = 0 THEN 'HOM_REF' WHEN {p}.a = {p}.b THEN 'HOM_VAR1' ELSE 'HET_REF_VAR1' END"
SITES = "sites AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY contig, pos) AS c FROM variants) x WHERE c = 1)"
CONC = f"""WITH {SITES}, t AS (SELECT contig, pos, a1 AS a, b1 AS b, gq1 AS gq, dp1 AS dp FROM sites WHERE k % 10 <> 3), c AS (SELECT contig, pos, a2 AS a, b2 AS b, gq2 AS gq, dp2 AS dp FROM sites WHERE k % 10 <> 4),
 s AS (SELECT {STATE('t')} AS truth_state, {STATE('c')} AS call_state, {n('count(*)')} AS sites FROM t FULL JOIN c ON t.contig = c.contig AND t.pos = c.pos GROUP BY 1, 2)"""


def _sides(t):
    w = F.count(F.lit(1)).over(Window.partitionBy("contig", "pos"))
    v = t.variants.withColumn("c", w).filter("c = 1")
    side = lambda i, skip: v.filter(f"k % 10 <> {skip}").select("contig", "pos", F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"), F.col(f"gq{i}").alias("gq"), F.col(f"dp{i}").alias("dp"))
    return side(1, 3), side(2, 4)


@query("concordance_contingency", f"{CONC} SELECT * FROM s", "variants")
def _(t):
    return V.concordance(*_sides(t))


CLEAR = "truth_state IN ('HET_REF_VAR1', 'HOM_VAR1', 'HOM_REF') AND call_state IN ('HET_REF_VAR1', 'HOM_VAR1', 'HOM_REF')"
SUMS = lambda a, b: r(f"CAST(sum(sites) FILTER ({a}) AS DOUBLE) / sum(sites) FILTER ({b})")


@query("concordance_rates", f"""{CONC} SELECT {SUMS("truth_state = 'HET_REF_VAR1' AND call_state = 'HET_REF_VAR1'", f"truth_state = 'HET_REF_VAR1' AND {CLEAR}")} AS het_sensitivity, {SUMS("truth_state = 'HET_REF_VAR1' AND call_state = 'HET_REF_VAR1'", f"call_state = 'HET_REF_VAR1' AND {CLEAR}")} AS het_ppv,
 {SUMS("truth_state = 'HOM_VAR1' AND call_state = 'HOM_VAR1'", f"truth_state = 'HOM_VAR1' AND {CLEAR}")} AS homvar_sensitivity, {SUMS("truth_state = 'HOM_VAR1' AND call_state = 'HOM_VAR1'", f"call_state = 'HOM_VAR1' AND {CLEAR}")} AS homvar_ppv, {SUMS(f'truth_state = call_state AND {CLEAR}', CLEAR)} AS genotype_concordance FROM s""", "variants")
def _(t):
    return V.concordance_rates(V.concordance(*_sides(t)))


@query("vcf_to_intervals", "SELECT contig, pos AS start, CAST(pos + length(ref) - 1 AS INT) AS stop, 'v' || k AS name FROM variants WHERE NOT filtered", "variants")
def _(t):
    return V.to_intervals(t.variants)


@query("sort_vcf_rank", f"SELECT k, {n('row_number() OVER (PARTITION BY contig ORDER BY pos, k)')} AS rank FROM variants", "variants")
def _(t):
    return t.variants.select("k", F.row_number().over(Window.partitionBy("contig").orderBy("pos", "k")).cast("long").alias("rank"))


@query("split_variants", f"SELECT CASE WHEN {TYPE} = 'SNP' THEN 'snp' WHEN {TYPE} = 'INDEL' THEN 'indel' ELSE 'other' END AS part, {n('count(*)')} AS sites, {n('sum(k)')} AS keys FROM variants GROUP BY 1", "variants")
def _(t):
    kind = V.variant_type()
    return t.variants.groupBy(F.when(kind == "SNP", "snp").when(kind == "INDEL", "indel").otherwise("other").alias("part")).agg(F.count(F.lit(1)).alias("sites"), F.sum("k").cast("long").alias("keys"))


LIFT = """hit AS (SELECT v.*, (contig + 1) % 25 AS tc, pos + 500 - q * 3 AS tp FROM (SELECT *, (pos - 1) // 10000 AS q FROM variants) v WHERE vk IN (0, 1, 9) AND pos BETWEEN q * 10000 + 1 AND q * 10000 + 9900)"""
THERE = f"CASE WHEN ((tp - 1) // 500 + tc) % 50 = 7 AND (tp - 1) % 500 < 300 THEN 'N' ELSE {DUCK.base('tc', 'tp')} END"


@query("liftover_variants", f"WITH {LIFT}, w AS (SELECT *, {THERE} AS there FROM hit) SELECT k, CAST(tc AS BIGINT) AS to_contig, CAST(tp AS BIGINT) AS to_pos, CASE WHEN there = ref THEN 'LIFTED' WHEN there = alts THEN 'SWAPPED' ELSE 'MISMATCH' END AS status, CASE WHEN there = alts THEN 1 - b2 ELSE a2 END AS a, CASE WHEN there = alts THEN 1 - a2 ELSE b2 END AS b FROM w", "variants")
def _(t):
    chain = t.contigs.select("contig", F.explode(F.expr("sequence(0L, 9L)")).alias("q")).select("contig", (F.col("q") * 10000 + 1).alias("start"), (F.col("q") * 10000 + 9900).alias("stop"), ((F.col("contig") + 1) % 25).alias("to_contig"), (500 - F.col("q") * 3).alias("offset"))
    return V.lifted(t.variants, chain, t.reference)


P3 = (0.7**2, 2 * 0.3 * 0.7, 0.3**2)
LL = f"""WITH {G}, l AS (SELECT k, sample, least(ad, dp_) * log10(0.01) + (dp_ - least(ad, dp_)) * log10(0.99) AS l0, dp_ * log10(0.5) AS l1, least(ad, dp_) * log10(0.99) + (dp_ - least(ad, dp_)) * log10(0.01) AS l2 FROM g WHERE {TYPE} = 'SNP'),
 p AS (SELECT x.sample AS "left", y.sample AS "right", {n('count(*)')} AS sites, {r(f"sum(log10({P3[0]!r} * pow(10, x.l0 + y.l0) + {P3[1]!r} * pow(10, x.l1 + y.l1) + {P3[2]!r} * pow(10, x.l2 + y.l2)) - log10({P3[0]!r} * pow(10, x.l0) + {P3[1]!r} * pow(10, x.l1) + {P3[2]!r} * pow(10, x.l2)) - log10({P3[0]!r} * pow(10, y.l0) + {P3[1]!r} * pow(10, y.l1) + {P3[2]!r} * pow(10, y.l2)))", 3)} AS lod
 FROM l x JOIN l y ON x.k = y.k AND x.sample <= y.sample GROUP BY ALL)"""


@query("crosscheck_pairs", f"""{LL} SELECT *, CASE WHEN lod > 5 THEN CASE WHEN "left" = "right" THEN 'EXPECTED_MATCH' ELSE 'UNEXPECTED_MATCH' END WHEN lod < -5 THEN CASE WHEN "left" = "right" THEN 'UNEXPECTED_MISMATCH' ELSE 'EXPECTED_MISMATCH' END ELSE 'INCONCLUSIVE' END AS result FROM p""", "variants")
def _(t):
    return V.crosscheck_results(V.crosscheck(V.genotype_likelihoods(t.variants.drop("dp"))), 5.0)


@query("crosscheck_matrix", f"""{LL}, b AS (SELECT "left", "right", lod FROM p UNION SELECT "right", "left", lod FROM p) SELECT "left" AS sample, max(lod) FILTER ("right" = 'child') AS child, max(lod) FILTER ("right" = 'father') AS father, max(lod) FILTER ("right" = 'mother') AS mother FROM b GROUP BY 1""", "variants")
def _(t):
    p = V.crosscheck(V.genotype_likelihoods(t.variants.drop("dp"))).select("left", "right", "lod")
    both = p.unionByName(p.select(F.col("right").alias("left"), F.col("left").alias("right"), "lod")).distinct()
    return both.groupBy(F.col("left").alias("sample")).pivot("right", ["child", "father", "mother"]).agg(F.max("lod"))
