"""Independent DuckDB text of the domain chain; :mod:`lociary.testbed.registry` adds the final queries."""

from __future__ import annotations

from lociary.functions import labels
from lociary.functions.stats import ERFC_COEFFICIENTS, Z_975
from lociary.testbed import bridge

CTES: dict[str, tuple[tuple[str, ...], str]] = {name: ((), bridge.cte(name)) for name in bridge.SQL}


def _horner() -> str:
    text = repr(ERFC_COEFFICIENTS[-1]) + "::DOUBLE"
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        text = f"({c!r}::DOUBLE + t * {text})"
    return text


def sql_list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def wilson(x: str, n: str) -> tuple[str, str]:
    """Lower and upper end as text."""
    z, z2 = repr(Z_975), f"({Z_975!r} * {Z_975!r})"
    x, n = f"({x})::DOUBLE", f"({n})::DOUBLE"
    mid = f"({x} / {n} + {z2} / 2 / {n})"
    half = f"({z} * sqrt((({x} / {n}) * (1 - {x} / {n}) + {z2} / 4 / {n}) / {n}))"
    lower = f"CASE WHEN {x} IS NULL OR NOT {n} > 0 THEN NULL WHEN {x} = 1 THEN -ln(0.95) / {n} ELSE ({mid} - {half}) / (1 + {z2} / {n}) END"
    upper = f"CASE WHEN {x} IS NULL OR NOT {n} > 0 THEN NULL WHEN {x} = {n} - 1 THEN 1 + ln(0.95) / {n} ELSE ({mid} + {half}) / (1 + {z2} / {n}) END"
    return lower, upper


CTES["scored"] = (
    ("sumstats",),
    """
SELECT *, exp(lbf - top) / sum(exp(lbf - top)) OVER (PARTITION BY trait, region) AS prob FROM (
  SELECT *, round(lbf, 9) AS score, max(lbf) OVER (PARTITION BY trait, region) AS top FROM (
    SELECT *, 0.5 * (ln(1 - lam) + lam * (beta / se) * (beta / se)) AS lbf
    FROM (SELECT *, 0.04 / (0.04 + se * se) AS lam FROM sumstats)))""",
)
CTES["leads"] = (
    ("scored",),
    """
SELECT trait, region, position AS lead_position, variant AS lead_variant, beta / se AS lead_z FROM (
  SELECT *, row_number() OVER (PARTITION BY trait, region ORDER BY score DESC, position, variant, beta / se) AS rn
  FROM scored) WHERE rn = 1""",
)
CTES["variants"] = (
    ("scored", "leads"),
    f"""
SELECT *, (x * x - ln(t) - {_horner()}) / ln(10::DOUBLE) AS nlog10p_dentist, prob > 0.1 AS cs, prob > 0.01 AS cs_99
FROM (SELECT *, 1 / (1 + x / 2) AS t FROM (SELECT *, sqrt(t_dentist / 2) AS x FROM (
  SELECT s.*, l.lead_z, s.beta / s.se AS zz,
    (s.beta / s.se - r * lead_z) * (s.beta / s.se - r * lead_z) / (1 - r * r) AS t_dentist,
    s.variant = l.lead_variant AND s.position = l.lead_position AS lead_variant
  FROM scored s JOIN leads l USING (trait, region))))""",
)
CTES["with_ext"] = (
    ("variants", "ext_gwas", "ext_eqtl"),
    """
SELECT v.*, g.max_pip AS max_pip_gwas, e.max_pip AS max_pip_eqtl,
  v.r * v.r > 0.6 AS linked, v.consequence IN ('pLoF', 'Missense') AS is_nonsyn
FROM variants v LEFT JOIN ext_gwas g ON v.variant = g.variant LEFT JOIN ext_eqtl e ON v.variant = e.variant""",
)
CTES["summary"] = (
    ("with_ext", "leads", "ext_gwas", "ext_eqtl"),
    """
SELECT s.*, l.lead_variant AS lead_pip_variant, g.max_pip AS lead_max_pip_gwas, e.max_pip AS lead_max_pip_eqtl,
  CASE WHEN n_r2 = 0 THEN 0 ELSE n_dentist_outlier::DOUBLE / n_r2 END AS fraction
FROM (
  SELECT trait, region, count(*) AS n_total,
    count(*) FILTER (linked) AS n_r2,
    count(*) FILTER (linked AND nlog10p_dentist > 4) AS n_dentist_outlier,
    count(*) FILTER (linked AND is_nonsyn) AS n_nonsyn,
    max(prob) AS max_pip,
    max(prob) FILTER (linked AND is_nonsyn) AS max_pip_nonsyn,
    count(*) FILTER (linked AND is_nonsyn AND cs) > 0 AS cs_nonsyn,
    count(*) FILTER (linked AND is_nonsyn AND cs_99) > 0 AS cs_99_nonsyn,
    max(max_pip_gwas) FILTER (cs) AS cs_max_pip_gwas, max(max_pip_gwas) FILTER (cs_99) AS cs_99_max_pip_gwas,
    max(max_pip_eqtl) FILTER (cs) AS cs_max_pip_eqtl, max(max_pip_eqtl) FILTER (cs_99) AS cs_99_max_pip_eqtl,
    min(n_samples * (n_cases::DOUBLE / n_samples) * (1 - n_cases::DOUBLE / n_samples)) FILTER (linked) AS min_neff_r2,
    max(n_samples * (n_cases::DOUBLE / n_samples) * (1 - n_cases::DOUBLE / n_samples)) FILTER (linked) AS max_neff_r2
  FROM with_ext GROUP BY trait, region) s
JOIN leads l USING (trait, region)
LEFT JOIN ext_gwas g ON l.lead_variant = g.variant LEFT JOIN ext_eqtl e ON l.lead_variant = e.variant""",
)
CTES["predicted"] = (
    ("summary", "dropped_loci"),
    """
SELECT p.*,
  CASE WHEN max_pip <= 0.1 THEN '[0,0.1]' WHEN max_pip <= 0.5 THEN '(0.1,0.5]' WHEN max_pip <= 0.9 THEN '(0.5,0.9]'
       WHEN max_pip <= 1 THEN '(0.9,1]' END AS max_pip_bin,
  CASE WHEN n_dentist_outlier <= 0 THEN '(-Inf,0]' WHEN n_dentist_outlier <= 10 THEN '(0,10]'
       WHEN n_dentist_outlier <= 100 THEN '(10,100]' ELSE '(100, Inf]' END AS count_bin
FROM (
  SELECT *, split_part(trait, '_', 1) AS trait_short,
    CASE WHEN max_pip < 0.1 THEN 'NA' WHEN n_dentist_outlier > 0 THEN 'SL' ELSE 'NSL' END AS prediction
  FROM summary) p
WHERE NOT EXISTS (SELECT 1 FROM dropped_loci d
                  WHERE d.trait_short = p.trait_short AND d.lead_pip_variant = p.lead_pip_variant)""",
)
CTES["validation"] = (
    ("predicted",),
    """
SELECT evidence, prediction, type, count(*) AS n, count(*) FILTER (hit) AS count, count(*) FILTER (NOT hit) AS count2
FROM (
  SELECT 'nonsyn' AS evidence, prediction, unnest(['Lead PIP', 'in 95% CS', 'in 99% CS']) AS type,
    unnest([max_pip = max_pip_nonsyn, cs_nonsyn, cs_99_nonsyn]) AS hit
  FROM predicted WHERE prediction <> 'NA' AND n_nonsyn > 0
  UNION ALL
  SELECT 'gwas', prediction, unnest(['Lead PIP', 'in 95% CS', 'in 99% CS']),
    unnest([lead_max_pip_gwas > 0.9, coalesce(cs_max_pip_gwas > 0.9, false), coalesce(cs_99_max_pip_gwas > 0.9, false)])
  FROM predicted WHERE prediction <> 'NA'
  UNION ALL
  SELECT 'eqtl', prediction, unnest(['Lead PIP', 'in 95% CS', 'in 99% CS']),
    unnest([lead_max_pip_eqtl > 0.9, coalesce(cs_max_pip_eqtl > 0.9, false), coalesce(cs_99_max_pip_eqtl > 0.9, false)])
  FROM predicted WHERE prediction <> 'NA')
GROUP BY evidence, prediction, type""",
)

# --- simulation ----------------------------------------------------------------------------------

CTES["sim"] = (
    ("sim_abf",),
    """
SELECT *, regexp_extract(trait, 'pheno([0-9]+)', 1)::INT AS pheno, regexp_extract(trait, 'config([0-9]+)', 1)::INT AS config,
  split_part(variant, ':', 1) AS contig, split_part(variant, ':', 2)::BIGINT AS position,
  split_part(variant, ':', 3) AS ref, split_part(variant, ':', 4) AS alt
FROM sim_abf""",
)
CTES["sim_regions"] = (
    ("sim",),
    """
SELECT t.*, c.gamma_variant, c.gamma_prob,
  coalesce(c.gamma_prob = t.max_prob, false) AS abf_success,
  coalesce(c.cs, false) AS abf_success_cs, coalesce(c.cs_99, false) AS abf_success_cs_99,
  split_part(region, ':', 1) AS contig,
  greatest(1, split_part(split_part(region, ':', 2), '-', 1)::BIGINT) AS start,
  split_part(split_part(region, ':', 2), '-', 2)::BIGINT AS end_
FROM (
  SELECT pheno, config, region, bool_or(gamma) AS gamma, max(prob) AS max_prob,
    max(nlog10p_dentist) AS max_nlog10p_dentist, max(beta / se) FILTER (lead_variant) AS lead_z,
    count(*) FILTER (cs) AS n_cs, count(*) FILTER (cs_99) AS n_cs_99
  FROM sim GROUP BY pheno, config, region) t
LEFT JOIN (
  SELECT pheno, config, region, variant AS gamma_variant, prob AS gamma_prob, cs, cs_99 FROM (
    SELECT *, row_number() OVER (PARTITION BY pheno, config, region ORDER BY position, variant, prob, cs, cs_99) AS rn
    FROM sim WHERE gamma) WHERE rn = 1) c USING (pheno, config, region)""",
)
CTES["sim_causal"] = (
    ("true_effects", "sim_regions"),
    """
SELECT e.pheno, r.config, e.contig, e.position, e.ref, e.alt, true AS gamma_from_region FROM (
  SELECT regexp_extract(source, 'pheno([0-9]+)', 1)::INT AS pheno, split_part(variant, ':', 1) AS contig,
    split_part(variant, ':', 2)::BIGINT AS position, split_part(variant, ':', 3) AS ref, split_part(variant, ':', 4) AS alt
  FROM true_effects) e
JOIN sim_regions r ON e.pheno = r.pheno AND e.contig = r.contig AND e.position >= r.start AND e.position < r.end_""",
)
CTES["sim_complete"] = (
    ("sim", "sim_causal"),
    """
SELECT *, pheno_group || ',' || config_group AS id FROM (
  SELECT *, CAST(floor((pheno - 1) / 100) AS INT) + 1 AS pheno_group,
    CASE WHEN config BETWEEN 13 AND 17 THEN 1317 WHEN config BETWEEN 18 AND 22 THEN 1822
         WHEN config BETWEEN 23 AND 27 THEN 2327 WHEN config BETWEEN 28 AND 32 THEN 2832
         WHEN config BETWEEN 33 AND 37 THEN 3337 WHEN config BETWEEN 38 AND 42 THEN 3842 ELSE config END AS config_group
  FROM sim FULL JOIN sim_causal USING (pheno, config, contig, position, ref, alt))""",
)
CTES["sim_ranked"] = (
    ("sim_complete",),
    """
SELECT *, rank::DOUBLE / n AS q FROM (
  SELECT *, CASE WHEN prob IS NULL THEN n - 1 - pos ELSE pos END AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY prob DESC NULLS LAST, pheno, config, contig, position, ref, alt) - 1 AS pos,
      count(prob) OVER (PARTITION BY id) AS n FROM sim_complete))""",
)


def _bin(value: str, breaks: list[float]) -> str:
    cases = [f"WHEN {value} < {breaks[0]} THEN -1"]
    cases += [f"WHEN {value} < {b} THEN {i}" for i, b in enumerate(breaks[1:-1])]
    return f"CASE {' '.join(cases)} WHEN {value} <= {breaks[-1]} THEN {len(breaks) - 2} WHEN {value} IS NOT NULL THEN {len(breaks) - 1} END"


CTES["sim_metrics"] = (
    ("sim_ranked",),
    f"""
SELECT g.pheno_group, g.config_group, g.bin, g.Ngamma_region, p.prob_bins, p.prob_true_bins, p.mean_prob, p.mean_prob_sd,
  q.q_true_bins, p.prob_true_bins::DOUBLE / p.prob_bins AS calibration
FROM (SELECT pheno_group, config_group, count(*) FILTER (gamma_from_region) AS Ngamma_region, unnest([0, 1, 2, 3, 4]) AS bin
      FROM sim_ranked GROUP BY pheno_group, config_group) g
LEFT JOIN (SELECT pheno_group, config_group, {_bin('prob', [0, 0.01, 0.1, 0.5, 0.9, 1.0])} AS bin, count(*) AS prob_bins,
             nullif(count(*) FILTER (gamma), 0) AS prob_true_bins, avg(prob) AS mean_prob, stddev_pop(prob) AS mean_prob_sd
           FROM sim_ranked GROUP BY ALL) p USING (pheno_group, config_group, bin)
LEFT JOIN (SELECT pheno_group, config_group, {_bin('q', [0, 1e-4, 5e-4, 1e-3, 5e-3, 0.01])} AS bin, count(*) AS q_true_bins
           FROM sim_ranked WHERE gamma GROUP BY ALL) q USING (pheno_group, config_group, bin)""",
)
CTES["sim_in_regions"] = (
    ("sim_ranked", "sim_regions"),
    """
SELECT v.*, r.max_prob, r.lead_z, r.abf_success, r.abf_success_cs, r.abf_success_cs_99
FROM sim_ranked v JOIN sim_regions r USING (pheno, config, region) WHERE r.gamma""",
)


def _uniform(v: str, s: float, e: float, n: int, size: float) -> str:
    return f"CASE WHEN {v} < {s} THEN -1 WHEN {v} = {s} THEN 0 WHEN {v} > {e} THEN {n} ELSE CAST(ceil(({v} - {s}) / {size}) - 1 AS INT) END"


CTES["sim_frac"] = (
    ("sim_in_regions",),
    f"""
SELECT pheno, config, region, r2_bin, max_prob_bin, nlog10p_dentist_bin, count(*) AS n,
  count(*) FILTER (gap > 0) AS n_above, count(*) FILTER (gap < 0) AS n_below,
  CAST(sum(n_samples) AS BIGINT) AS weighted_n_by_n_samples,
  coalesce(sum(CASE WHEN nlog10p_dentist > 100 THEN 100 ELSE nlog10p_dentist END), 0) AS weighted_n_by_dentist,
  max(nlog10p_dentist) AS max_nlog10p_dentist, max(n_samples) AS max_n_samples, min(n_samples) AS min_n_samples,
  bool_or(abf_success) AS abf_success, bool_or(abf_success_cs) AS abf_success_cs, bool_or(abf_success_cs_99) AS abf_success_cs_99
FROM (SELECT *, r * lead_z - beta / se AS gap, {_uniform('r * r', 0.0, 1.0, 10, 0.1)} AS r2_bin,
        {_uniform('max_prob', 0.0, 1.0, 10, 0.1)} AS max_prob_bin,
        {_uniform('nlog10p_dentist', 0.0, 15.0, 30, 0.5)} AS nlog10p_dentist_bin
      FROM sim_in_regions WHERE NOT lead_variant)
GROUP BY pheno, config, region, r2_bin, max_prob_bin, nlog10p_dentist_bin""",
)
CTES["sim_locus"] = (
    ("sim_frac",),
    """
SELECT *, count::DOUBLE / count_total AS fraction,
  CASE WHEN count >= 1 THEN 'Suspicious loci' ELSE 'Non-suspicious loci' END AS prediction
FROM (
  SELECT pheno, config, region, bool_or(abf_success) AS abf_success, bool_or(abf_success_cs) AS abf_success_cs,
    bool_or(abf_success_cs_99) AS abf_success_cs_99, max(max_prob_bin) AS max_prob_bin,
    max(max_nlog10p_dentist) AS max_nlog10p_dentist,
    CAST(sum(CASE WHEN nlog10p_dentist_bin >= 8 THEN n ELSE 0 END) AS BIGINT) AS count, CAST(sum(n) AS BIGINT) AS count_total
  FROM sim_frac WHERE r2_bin >= 6 AND nlog10p_dentist_bin IS NOT NULL GROUP BY pheno, config, region)""",
)
_LOWER, _UPPER = wilson("count(*) FILTER (gamma)", "count(*)")
CTES["sim_sweep"] = (
    ("sim_in_regions", "sim_locus"),
    f"""
SELECT prediction, round(th, 9) AS threshold, avg(prob) AS mean_prob,
  count(*) FILTER (gamma)::DOUBLE / count(gamma) AS calibration, {_LOWER} AS calibration_lower, {_UPPER} AS calibration_upper,
  count(*) AS count
FROM (SELECT v.prob, v.gamma, l.prediction FROM sim_in_regions v JOIN sim_locus l USING (pheno, config, region) WHERE v.prob > 0.01) x
JOIN (SELECT 0.01::DOUBLE + i * 0.01::DOUBLE AS th FROM range(0, 100) g(i)) y ON prob > th
GROUP BY prediction, th""",
)
CTES["sim_truth"] = (
    ("sim_frac",),
    """
SELECT CAST(outliers AS BIGINT) AS count, unnest(['abf_success', 'abf_success_cs', 'abf_success_cs_99']) AS truth,
  unnest([s0, s1, s2]) AS success
FROM (
  SELECT sum(CASE WHEN nlog10p_dentist_bin >= 8 THEN n ELSE 0 END) AS outliers,
    bool_or(abf_success) AS s0, bool_or(abf_success_cs) AS s1, bool_or(abf_success_cs_99) AS s2
  FROM sim_frac WHERE max_prob_bin >= 9 AND r2_bin >= 6 AND nlog10p_dentist_bin IS NOT NULL GROUP BY pheno, config, region)""",
)

# --- posteriors ----------------------------------------------------------------------------------

POST_TRAITS = {"CHF_x": "HF", "GOUT_x": "Gout", "VTE_x": "VTE", "ASTHMA_x": "Asthma"}
_TRAIT_CASE = "CASE trait " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in POST_TRAITS.items()) + " END"
CTES["post_clean"] = (
    ("posterior_raw",),
    f"""
SELECT cohort_no, method_no, {_TRAIT_CASE} AS trait, region, variant, prob AS pip,
  CASE WHEN cs = -1 OR low_purity = 1 THEN -1 ELSE cs END AS cs_id
FROM posterior_raw
WHERE NOT contains(variant, '<')
  AND NOT (split_part(variant, ':', 1) = '6' AND split_part(variant, ':', 2)::BIGINT BETWEEN 25000000 AND 36000000)""",
)
CTES["post_merged"] = (
    ("post_clean", "post_build_map"),
    """
SELECT trait, m.variant, variant_b37, cohort, pip, region, cs_id FROM (
  SELECT coalesce(s.trait, f.trait) AS trait, coalesce(s.variant, f.variant) AS variant_b37,
    CASE coalesce(s.cohort_no, f.cohort_no) WHEN 0 THEN 'one' WHEN 1 THEN 'two' ELSE 'three' END AS cohort,
    CASE WHEN s.pip IS NULL THEN f.pip WHEN f.pip IS NULL THEN s.pip
         WHEN abs(s.pip - f.pip) < 0.05 THEN (s.pip + f.pip) / 2 END AS pip,
    coalesce(s.region, f.region) AS region, s.cs_id
  FROM (SELECT * FROM post_clean WHERE method_no = 0) s
  FULL JOIN (SELECT * FROM post_clean WHERE method_no = 1) f USING (cohort_no, variant, trait)) p
LEFT JOIN post_build_map m ON m.original_variant = p.variant_b37""",
)
CTES["post_all"] = (
    ("post_merged",),
    """
SELECT * FROM post_merged UNION ALL
SELECT trait, variant, variant_b37, 'earlier' AS cohort, pip, region, cs_id FROM post_merged
WHERE cohort = 'three' AND trait IN ('Asthma', 'HF')""",
)
CTES["pip_wide"] = (
    ("posteriors",),
    """
SELECT trait, variant, variant_b37, max(pip) AS max_pip, bool_or(cs_id > 0) AS any_cs,
  max(pip) FILTER (cohort = 'east') AS east, max(pip) FILTER (cohort = 'west') AS west, max(pip) FILTER (cohort = 'north') AS north
FROM posteriors GROUP BY trait, variant, variant_b37""",
)
CTES["delta"] = (
    ("with_ext", "predicted", "pip_wide"),
    """
SELECT *, prob / nullif(max_pip, 0) AS ratio, prob - max_pip AS delta,
  CASE WHEN prob <= 0 THEN NULL WHEN prob <= 0.01 THEN 0 WHEN prob <= 0.1 THEN 1 WHEN prob <= 0.5 THEN 2 WHEN prob <= 0.9 THEN 3 WHEN prob <= 1 THEN 4 END AS prob_bin,
  CASE WHEN max_pip <= 0 THEN NULL WHEN max_pip <= 0.01 THEN 0 WHEN max_pip <= 0.1 THEN 1 WHEN max_pip <= 0.5 THEN 2 WHEN max_pip <= 0.9 THEN 3 WHEN max_pip <= 1 THEN 4 END AS max_pip_bin
FROM (
  SELECT split_part(v.trait, '_', 1) AS trait, v.region, v.variant, w.variant_b37, v.position, v.rsid, v.prob, v.cs, v.lead_variant,
    v.consequence, v.max_pip_gwas, v.max_pip_eqtl, p.prediction, w.max_pip, w.any_cs
  FROM with_ext v LEFT JOIN predicted p USING (trait, region)
  JOIN pip_wide w ON w.variant = v.variant AND (CASE w.trait WHEN 'alpha' THEN 'A' ELSE w.trait END) = split_part(v.trait, '_', 1))""",
)
CTES["lead_sizes"] = (
    ("posteriors", "delta"),
    """
SELECT p.trait, p.cohort, p.variant, s.cs_size
FROM (SELECT CASE trait WHEN 'alpha' THEN 'A' ELSE trait END AS trait, * EXCLUDE (trait) FROM posteriors) p
JOIN (SELECT DISTINCT trait, variant_b37 FROM delta WHERE cs) l USING (trait, variant_b37)
LEFT JOIN (SELECT CASE trait WHEN 'alpha' THEN 'A' ELSE trait END AS trait, cohort, region, cs_id, count(*) AS cs_size
           FROM posteriors WHERE cs_id > 0 GROUP BY ALL) s USING (trait, cohort, region, cs_id)""",
)

# --- panels, annotation --------------------------------------------------------------------------

CTES["info"] = (
    ("panel_info", "panel_excluded", "panel_build_map", "population_maf"),
    """
SELECT i.*, m.min_maf, m.max_maf FROM (
  SELECT CASE WHEN imputation = 'TopMed' THEN b.variant ELSE SNP END AS variant,
    CASE WHEN imputation = 'TopMed' THEN SNP END AS variant_b38, ALT_Frq AS freq, Rsq AS rsq,
    ancestry, arr AS "array", imputation, ancestry || '_' || arr || '_' || imputation AS label
  FROM (SELECT *, split_part(f, '_', 1) AS ancestry, split_part(f, '_', 4) AS arr,
          split_part(split_part(f, '_', 5), '.', 1) AS imputation
        FROM (SELECT *, split_part(filename, '/', 3) AS f FROM panel_info)) x
  LEFT JOIN panel_build_map b ON x.SNP = b.original_variant
  WHERE NOT EXISTS (SELECT 1 FROM panel_excluded e WHERE e.SNP = x.SNP)) i
JOIN population_maf m ON split_part(i.variant, ':', 1) = m.contig AND split_part(i.variant, ':', 2)::BIGINT = m.position
  AND split_part(i.variant, ':', 3) = m.ref AND split_part(i.variant, ':', 4) = m.alt
WHERE NOT contains(i.variant, '<')""",
)


def collections(mode: str, maf: list[float], rsq: list[float]) -> str:
    test = {
        "": "0.5 - abs(0.5 - freq) > m",
        "gnomad_min": "min_maf > m",
        "gnomad_max_min": "max_maf > m AND min_maf <= m",
    }[mode]
    grid = lambda name, values: f"(SELECT unnest([{', '.join(f'{v!r}::DOUBLE' for v in values)}]) AS {name})"
    return f"""
SELECT '{mode}' AS mode, m AS maf, q AS rsq, collection, n_labels, count(*) AS n FROM (
  SELECT m, q, variant, string_agg(DISTINCT label, ',' ORDER BY label) AS collection, count(DISTINCT label) AS n_labels
  FROM info, {grid('m', maf)}, {grid('q', rsq)}
  WHERE variant IS NOT NULL AND {test} AND rsq > q GROUP BY m, q, variant) GROUP BY ALL"""


_SEVERITY = ", ".join(f"('{t}', {i + 1})" for i, t in enumerate(labels.SEVERITY_ORDER))
CTES["worst"] = (
    ("sites", "transcripts"),
    f"""
SELECT s.*, coalesce(b.most_severe, 'intergenic_variant') AS most_severe, coalesce(b.protein_coding, false) AS protein_coding,
  b.gene_symbol AS gene_most_severe, b.lof, b.hgnc_id, b.hgvsp, b.transcript_id, b.polyphen_prediction, b.polyphen_score,
  b.sift_prediction, b.sift_score
FROM sites s
LEFT JOIN (
  SELECT * EXCLUDE (rk, rn), (SELECT term FROM (VALUES {_SEVERITY}) o(term, place) WHERE place = best) AS most_severe
  FROM (
    SELECT *, row_number() OVER (PARTITION BY variant, l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY rk, i) AS rn,
      coalesce(min(rk) FILTER (biotype = 'protein_coding') OVER (PARTITION BY variant, l_orderkey, l_linenumber, l_partkey, l_suppkey),
               min(rk) OVER (PARTITION BY variant, l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS best,
      bool_or(biotype = 'protein_coding') OVER (PARTITION BY variant, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS protein_coding
    FROM (SELECT t.*, least(o1.place, o2.place) AS rk FROM (SELECT DISTINCT * FROM transcripts) t
          JOIN (VALUES {_SEVERITY}) o1(term, place) ON o1.term = t.term1
          JOIN (VALUES {_SEVERITY}) o2(term, place) ON o2.term = t.term2
          WHERE canonical = 1)) WHERE rn = 1) b USING (variant, l_orderkey, l_linenumber, l_partkey, l_suppkey)""",
)
_FILES = ["promoter", "dhs", "h3k27ac_tissue", "h3k27ac_cell"]
CTES["marked"] = (
    ("worst", "bed"),
    "SELECT s.*, "
    + ", ".join(
        f"CASE WHEN EXISTS (SELECT 1 FROM bed b WHERE b.file = '{f}' AND b.contig = s.contig AND b.start < s.position AND s.position <= b.end_) THEN 1 ELSE 0 END AS {f}"
        for f in _FILES
    )
    + " FROM worst s",
)
CTES["z_pairs"] = (
    ("cohort_effects", "variant_pairs", "sample_sizes"),
    """
SELECT p.*, s.n, s.n_case, s.n_control, s.neff,
  CASE WHEN b1 IS NULL THEN 'Missing variant1' WHEN b2 IS NULL THEN 'Missing variant2' ELSE 'Both exist' END AS missingness
FROM (
  SELECT pair_id, cohort, ancestry, max(beta) FILTER (slot = 1) AS b1, max(se) FILTER (slot = 1) AS se1,
    max(beta) FILTER (slot = 2) AS b2, max(se) FILTER (slot = 2) AS se2
  FROM (
    SELECT variant, unnest(['NATION_1', 'NATION_1', 'NATION_7', 'Meta']) AS cohort, unnest(['AMERICA', 'ASIA', 'ASIA', 'Meta']) AS ancestry,
      unnest([NATION_1_america_beta, NATION_1_asia_beta, NATION_7_asia_beta, all_inv_var_meta_beta]) AS beta,
      unnest([NATION_1_america_sebeta, NATION_1_asia_sebeta, NATION_7_asia_sebeta, all_inv_var_meta_sebeta]) AS se
    FROM cohort_effects) e
  JOIN (SELECT pair_id, 1 AS slot, variant1 AS variant FROM variant_pairs UNION ALL SELECT pair_id, 2, variant2 FROM variant_pairs) w USING (variant)
  GROUP BY pair_id, cohort, ancestry) p
LEFT JOIN (
  SELECT CASE WHEN kind = 'Total' THEN 'Meta' ELSE biobank END AS cohort, CASE WHEN kind = 'Total' THEN 'Meta' ELSE upper(ancestry) END AS ancestry,
    cases + controls AS n, cases AS n_case, controls AS n_control,
    (cases + controls) * (cases::DOUBLE / nullif(cases + controls, 0)) * (1 - cases::DOUBLE / nullif(cases + controls, 0)) AS neff
  FROM sample_sizes WHERE trait = 'BUILDING') s USING (cohort, ancestry)""",
)
#: The same text for every trait: sizes meet the pairs of their own trait.
CTES["trait_z_pairs"] = (
    CTES["z_pairs"][0],
    "SELECT t.trait AS trait, z.* FROM (SELECT DISTINCT trait FROM sample_sizes) t, LATERAL ("
    + CTES["z_pairs"][1].replace("trait = 'BUILDING'", "sample_sizes.trait = t.trait")
    + ") z",
)


def compose(final: str, *needs: str) -> str:
    """The final text with every CTE it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for dep in CTES[name][0]:
                visit(dep)
            ordered.append(name)

    for name in needs:
        visit(name)
    final = final.strip()
    if not ordered:
        return final
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1].strip()})" for n in ordered)
    # a final text with its own CTEs continues the list
    rest = ", " + final[len("WITH ") :] if final.startswith("WITH ") else final
    return f"WITH {ctes}\n{rest}"
