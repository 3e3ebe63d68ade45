"""Domain tables derived row by row from the driver's tables.

The text below is read by both Spark and DuckDB: ``{lineitem}`` and the like stand for the tables. Every
table covers all rows of its source; variety (missing values, classes, partial coverage) comes from the
values of the rows. Numbers use exponents so that neither engine types a literal as decimal.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lociary.operators.keyed import shared_folder

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# a genomic reading of a line: 1 Mb regions of ten parts, position and alleles from its keys
_LINE = """
SELECT *,
  'chr' || CAST(1 + reg % 22 AS STRING) AS contig,
  'chr' || CAST(1 + reg % 22 AS STRING) || ':' || CAST(reg * 1000000 AS STRING) || '-'
        || CAST((reg + 1) * 1000000 AS STRING) AS region,
  'chr' || CAST(1 + reg % 22 AS STRING) || ':' || CAST(pos AS STRING) || ':' || ref || ':' || alt AS variant,
  CAST(1 + reg % 22 AS STRING) || ':' || CAST(pos + 1000 AS STRING) || ':' || ref || ':' || alt AS variant_b37
FROM (
  SELECT *,
    reg * 1000000 + 1 + (l_orderkey * 8 + l_linenumber) % 999999 AS pos,
    substr('ACGT', CAST(1 + l_suppkey % 4 AS INT), 1) AS ref,
    substr('TGAC', CAST(1 + l_partkey % 4 AS INT), 1) || substr('ACGT', CAST(1 + l_suppkey % 3 AS INT), 1) AS alt,
    (l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 31 + l_linenumber * 17) % 1000003 / 1000003e0 AS u,
    (l_orderkey * 31 + l_suppkey * 7 + l_linenumber * 3 + l_partkey) % 1000 / 1000e0 AS v,
    (l_orderkey * 13 + l_suppkey * 101 + l_linenumber * 5 + l_partkey * 3) % 1000 / 1000e0 AS w
  FROM (SELECT *, CAST(floor(l_partkey / 10) AS BIGINT) AS reg FROM {lineitem}) a
) b
"""

SQL: dict[str, str] = {}

SQL["sumstats"] = f"""
SELECT l_returnflag || '_Both_meta' AS trait, region, contig, 1 + reg % 22 AS contig_number, pos AS position,
  variant, variant_b37, CASE WHEN l_linestatus = 'F' THEN 'rs' || CAST(pos AS STRING) END AS rsid,
  l_quantity / 51e0 AS r,
  v * 9e-1 AS r_afr, w * 95e-2 AS r_nfe,
  z, se, z * se AS beta, exp(-5e-1 * z * z) AS p,
  CASE WHEN l_suppkey % 20 = 0 THEN 40000 ELSE 100000 END AS n_samples,
  CASE WHEN l_suppkey % 20 = 0 THEN 8000 ELSE 30000 END AS n_cases,
  CASE WHEN k = 0 THEN 'pLoF' WHEN k <= 3 THEN 'Missense' WHEN k = 4 THEN 'Synonymous' WHEN k = 5 THEN 'UTR5'
       WHEN k = 6 THEN 'UTR3' WHEN k = 7 THEN 'Promoter' WHEN k <= 9 THEN 'CRE' WHEN k = 10 THEN NULL
       ELSE 'Non-genic' END AS consequence
FROM (
  SELECT *,
    (CASE WHEN l_suppkey % 20 = 0 THEN 6e-1 ELSE 1e0 END) * (reg % 10) * l_quantity / 50e0
      + (l_discount - 5e-2) * 10e0 AS z,
    1e-2 + l_tax / 10e0 AS se,
    (l_partkey + l_suppkey + l_linenumber) % 20 AS k
  FROM ({_LINE}) c
) d
"""

# values outside the narrow ranges: signed and rounded correlations, no standard error, no region
SQL["sumstats_hard"] = f"""
SELECT trait, CASE WHEN position % 97 = 0 THEN NULL ELSE region END AS region, variant, position,
  beta, CASE WHEN position % 89 = 0 THEN 0e0 ELSE se END AS se,
  CASE WHEN position % 83 = 0 THEN 1e0 WHEN position % 79 = 0 THEN -10001e-4 ELSE (2e0 * r - 1e0) * 11e-1 END AS r
FROM ({SQL["sumstats"]}) s
"""

SQL["ext_gwas"] = f"""
SELECT variant, max(round(power(u, 3), 9)) AS max_pip FROM ({_LINE}) c WHERE l_linestatus = 'F' GROUP BY variant
"""

SQL["ext_eqtl"] = f"""
SELECT variant, max(round(power(w, 2), 9)) AS max_pip FROM ({_LINE}) c WHERE l_quantity > 20 GROUP BY variant
"""

SQL["dropped_loci"] = f"""
SELECT DISTINCT l_returnflag AS trait_short, variant AS lead_pip_variant
FROM ({_LINE}) c WHERE l_quantity >= 48 AND l_tax >= 6e-2
"""

SQL["studies"] = """
SELECT DISTINCT l_returnflag || '_Both_meta' AS study_accession, l_returnflag <> 'R' AS is_meta_analysis
FROM {lineitem}
"""

SQL["sim_abf"] = f"""
SELECT 'sim.pheno' || CAST(1 + reg % 600 AS STRING) || '.config' || CAST(1 + (reg * 11) % 42 AS STRING) AS trait,
  region, variant, prob,
  se * ((l_discount - 5e-2) * 60e0 + l_quantity / 10e0) AS beta, se,
  l_quantity / 51e0 AS r,
  v AS p_het,
  130e0 * power(w, 6) / 2e0 AS t_dentist,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE round(130e0 * power(w, 6), 6) END AS nlog10p_dentist,
  CAST(CASE WHEN l_suppkey % 20 = 0 THEN 40000 ELSE 100000 END AS BIGINT) AS n_samples,
  v < prob * 5e-1 AS gamma,
  u > 995e-3 AS lead_variant, u > 97e-2 AS cs, u > 95e-2 AS cs_99
FROM (SELECT *, round(power(u, 12), 9) AS prob, 1e-2 + l_tax / 10e0 AS se FROM ({_LINE}) c) d
"""

# the causal variants above, and as many that no study tested (other alternative allele)
SQL["true_effects"] = f"""
SELECT '/effects/pheno' || CAST(1 + reg % 600 AS STRING) || '.beta.txt' AS source,
  CASE WHEN l_linestatus = 'F' THEN variant ELSE variant || 'N' END AS variant
FROM (SELECT *, round(power(u, 12), 9) AS prob FROM ({_LINE}) c) d
WHERE v < prob * 5e-1
"""

# seven consecutive orders make three pairs of methods and one variant seen by one method only
_POST = """
SELECT *,
  CAST(floor(g / 3) AS BIGINT) AS site, g % 3 AS cohort_no, CAST(floor(g / 3) AS BIGINT) % 4 AS trait_no
FROM (
  SELECT *, CAST(floor(o_orderkey / 7) AS BIGINT) * 4 + CAST(floor((o_orderkey % 7) / 2) AS BIGINT) AS g,
    (o_orderkey % 7) % 2 AS method_no
  FROM {orders}
) a
"""
SQL["posterior_raw"] = f"""
SELECT cohort_no, method_no, site,
  CASE trait_no WHEN 0 THEN 'CHF_x' WHEN 1 THEN 'GOUT_x' WHEN 2 THEN 'VTE_x' ELSE 'ASTHMA_x' END AS trait,
  'locus' || CAST(CAST(floor(site / 20) AS BIGINT) AS STRING) AS region,
  CAST(1 + site % 8 AS STRING) || ':' || CAST(1 + (site * 104729) % 60000000 AS STRING) || ':A:'
    || CASE WHEN site % 29 = 0 THEN '<INS>' ELSE 'G' END AS variant,
  CASE WHEN o_custkey % 13 = 0 THEN NULL
       ELSE 9e-1 * power((g * 7919) % 1000 / 1000e0, 2) + (o_custkey % 97) / 997e0 END AS prob,
  o_totalprice / 1e6 AS mean, 1e-1 + (o_custkey % 7) / 100e0 AS sd,
  CASE WHEN o_custkey % 3 = 0 THEN -1 ELSE CAST(1 + g % 3 AS INT) END AS cs,
  CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END AS low_purity
FROM ({_POST}) b
"""
SQL["post_build_map"] = f"""
SELECT DISTINCT CAST(1 + site % 8 AS STRING) || ':' || CAST(1 + (site * 104729) % 60000000 AS STRING) || ':A:G' AS original_variant,
  'chr' || CAST(1 + site % 8 AS STRING) || ':' || CAST(501 + (site * 104729) % 60000000 AS STRING) || ':A:G' AS variant
FROM ({_POST}) b WHERE site % 17 <> 0
"""

# three cohorts' posteriors of line variants, each with its own coverage
_COHORT = """
SELECT {{trait}} AS trait, variant, variant_b37, '{{name}}' AS cohort, {{pip}} AS pip, region,
  CASE WHEN {{pip}} > {{cut}} THEN CAST(1 + l_linenumber % 2 AS INT) ELSE -1 END AS cs_id
FROM ({line}) c WHERE {{where}}
"""


def _cohort(name: str, pip: str, cut: str, where: str) -> str:
    trait = "CASE l_returnflag WHEN 'A' THEN 'alpha' ELSE l_returnflag END"
    text = _COHORT.replace("{line}", "{{line}}").replace("{{line}}", _LINE)
    for key, value in (("trait", trait), ("name", name), ("pip", pip), ("cut", cut), ("where", where)):
        text = text.replace("{{" + key + "}}", value)
    return text


SQL["posteriors"] = " UNION ALL ".join(
    [
        _cohort("east", "round(power(w, 20), 9)", "8e-1", "l_linestatus = 'F'"),
        _cohort("west", "round(power(u, 20), 9)", "7e-1", "l_quantity > 10"),
        _cohort("north", "round(power(v, 20), 9)", "9e-1", "l_discount < 9e-2"),
    ]
)
COHORTS = ["east", "west", "north"]
TRAIT_RENAMES = {"alpha": "A"}

SQL["csm"] = f"""
SELECT cohort, trait, region, variant, cs_id AS susie_cs_id,
  CAST(cs_id * 10 + CASE cohort WHEN 'east' THEN 1 WHEN 'west' THEN 2 ELSE 3 END AS INT) AS csm_id
FROM ({SQL["posteriors"]}) p WHERE cs_id > 0
"""

# panel files: every line is one variant (its part) in one of the 3 x 3 x 3 panels
_SITE = """'{prefix}' || CAST(1 + {key} % 22 AS STRING) || ':' || CAST({shift} + {key} * 11 AS STRING) || ':A:'
  || CASE WHEN {key} % 41 = 0 THEN '<DEL>' ELSE 'G' END"""


def _site(key: str, prefix: str = "", shift: str = "1000") -> str:
    return _SITE.replace("{key}", key).replace("{prefix}", prefix).replace("{shift}", shift)


SQL["panel_info"] = f"""
SELECT CASE WHEN panel = 'TopMed' THEN {_site('l_partkey', 'chr', '9000')} ELSE {_site('l_partkey')} END AS SNP,
  l_discount * 8e0 AS ALT_Frq, l_quantity / 50e0 AS Rsq,
  '/panels/' || ancestry || '_x_x_' || arr || '_' || panel || '.info.gz' AS filename
FROM (
  SELECT *,
    CASE l_returnflag WHEN 'A' THEN 'AFR' WHEN 'N' THEN 'EAS' ELSE 'EUR' END AS ancestry,
    CASE l_linenumber % 3 WHEN 0 THEN 'GSA' WHEN 1 THEN 'MEGA' ELSE 'Omni25' END AS arr,
    CASE l_suppkey % 3 WHEN 0 THEN '1000GP3' WHEN 1 THEN 'HRC' ELSE 'TopMed' END AS panel
  FROM {{lineitem}}
) a
"""
SQL["panel_excluded"] = f"SELECT DISTINCT {_site('p_partkey')} AS SNP FROM {{part}} WHERE p_size = 7"
SQL["panel_build_map"] = f"""
SELECT {_site('p_partkey', 'chr', '9000')} AS original_variant, {_site('p_partkey')} AS variant
FROM {{part}} WHERE p_size <> 9
"""
SQL["population_maf"] = """
SELECT CAST(1 + p_partkey % 22 AS STRING) AS contig, 1000 + p_partkey * 11 AS position, 'A' AS ref, 'G' AS alt,
  p_size / 400e0 AS min_maf, p_size / 100e0 AS max_maf
FROM {part} WHERE p_size <> 13
"""

# intervals of four annotation files, overlapping and nested
SQL["bed"] = """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'promoter' WHEN '2-HIGH' THEN 'dhs'
            WHEN '3-MEDIUM' THEN 'h3k27ac_tissue' ELSE 'h3k27ac_cell' END AS file,
  'chr' || CAST(1 + reg % 22 AS STRING) AS contig,
  reg * 1000000 + (o_orderkey * 37) % 1000000 AS start,
  reg * 1000000 + (o_orderkey * 37) % 1000000 + CAST(floor(o_totalprice) AS BIGINT) % 20000 AS end_
FROM (SELECT *, CAST(floor(o_custkey / 10) AS BIGINT) AS reg FROM {orders}) a
"""

# transcripts in long form; Spark packs the three of a site into one array, DuckDB reads them as they are
_TERMS = """CASE {n} % 12 WHEN 0 THEN 'stop_gained' WHEN 1 THEN 'missense_variant' WHEN 2 THEN 'synonymous_variant'
  WHEN 3 THEN '5_prime_UTR_variant' WHEN 4 THEN '3_prime_UTR_variant' WHEN 5 THEN 'splice_region_variant'
  WHEN 6 THEN 'upstream_gene_variant' WHEN 7 THEN 'frameshift_variant' ELSE 'intron_variant' END"""


def _transcript(i: int) -> dict[str, str]:
    n = f"(l_orderkey * {3 + 2 * i} + l_partkey * {5 + i} + l_linenumber + {i})"
    m = f"(l_suppkey * {7 + i} + l_orderkey + {i})"
    return {
        "canonical": f"CASE WHEN {m} % 3 = 0 THEN 0 ELSE 1 END",
        "biotype": f"CASE WHEN {n} % 5 < 3 THEN 'protein_coding' ELSE 'lncRNA' END",
        "term1": _TERMS.replace("{n}", n),
        "term2": _TERMS.replace("{n}", f"({n} + 5)"),
        "gene_symbol": f"'G' || CAST({m} % 97 AS STRING)",
        "lof": f"CASE {n} % 12 WHEN 0 THEN CASE WHEN {m} % 4 = 0 THEN 'LC' ELSE 'HC' END WHEN 7 THEN 'HC' END",
        "hgnc_id": f"CAST({m} % 1009 AS STRING)",
        "hgvsp": f"CASE WHEN {n} % 12 = 1 THEN 'p.' || CAST({m} % 300 AS STRING) END",
        "transcript_id": f"'T' || CAST({m} % 5003 AS STRING) || '.{i}'",
        "polyphen_prediction": f"CASE WHEN {n} % 12 = 1 THEN CASE WHEN {m} % 2 = 0 THEN 'benign' ELSE 'damaging' END END",
        "polyphen_score": f"CASE WHEN {n} % 12 = 1 THEN {m} % 100 / 100e0 END",
        "sift_prediction": f"CASE WHEN {n} % 12 = 1 THEN CASE WHEN {m} % 3 = 0 THEN 'tolerated' ELSE 'deleterious' END END",
        "sift_score": f"CASE WHEN {n} % 12 = 1 THEN {m} % 50 / 50e0 END",
    }


TRANSCRIPTS = 3
SQL["sites"] = f"""
SELECT variant, contig, pos AS position, l_orderkey, l_linenumber, l_partkey, l_suppkey, u, v, w FROM ({_LINE}) c
"""
SQL["transcripts"] = " UNION ALL ".join(
    "SELECT variant, contig, position, l_orderkey, l_linenumber, l_partkey, l_suppkey, {i} AS i, {cols} FROM ({sites}) s{i}".replace(
        "{i}", str(i)
    )
    .replace("{cols}", ", ".join(f"{v} AS {k}" for k, v in _transcript(i).items()))
    .replace("{sites}", SQL["sites"])
    for i in range(TRANSCRIPTS)
)

# effects of customers read as variants, two cohorts x two ancestries and the pooled estimate
SQL["cohort_effects"] = """
SELECT c_custkey AS key, 'snp' || CAST(c_custkey AS STRING) AS variant,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal / 1.1e4 END AS NATION_1_america_beta,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 1e-1 + (c_nationkey + 1) / 100e0 END AS NATION_1_america_sebeta,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal / 2.1e4 - 1e-1 END AS NATION_1_asia_beta,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 2e-1 + (c_nationkey + 1) / 90e0 END AS NATION_1_asia_sebeta,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 2e-1 - c_acctbal / 3.1e4 END AS NATION_7_asia_beta,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 3e-1 + (c_nationkey + 1) / 80e0 END AS NATION_7_asia_sebeta,
  c_acctbal / 5e4 AS all_inv_var_meta_beta, 5e-2 + (c_nationkey + 1) / 500e0 AS all_inv_var_meta_sebeta,
  c_acctbal / 6e4 AS all_meta_beta, 6e-2 AS all_meta_sebeta
FROM {customer}
"""
SQL["variant_pairs"] = """
SELECT CAST(floor(c_custkey / 2) AS BIGINT) AS pair_id,
  max(CASE WHEN c_custkey % 2 = 0 THEN 'snp' || CAST(c_custkey AS STRING) END) AS variant1,
  max(CASE WHEN c_custkey % 2 = 1 THEN 'snp' || CAST(c_custkey AS STRING) END) AS variant2
FROM {customer} GROUP BY CAST(floor(c_custkey / 2) AS BIGINT)
"""
_SIZES = """
SELECT c_mktsegment AS trait, lower(r_name) AS ancestry, n_name AS biobank,
  count_if(c_acctbal > 5e3) AS cases, count_if(c_acctbal <= 5e3) AS controls
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""
SQL["sample_sizes"] = f"""
SELECT trait, '-' AS kind, ancestry, biobank, CAST(cases AS BIGINT) AS cases, CAST(controls AS BIGINT) AS controls
FROM ({_SIZES} GROUP BY c_mktsegment, lower(r_name), n_name) a
UNION ALL
SELECT trait, 'Total', CAST(count(DISTINCT ancestry) AS STRING), CAST(count(DISTINCT biobank) AS STRING),
  CAST(sum(cases) AS BIGINT), CAST(sum(controls) AS BIGINT)
FROM ({_SIZES} GROUP BY c_mktsegment, lower(r_name), n_name) b GROUP BY trait
"""
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
SEGMENT_DESCRIPTIONS = {
    "AUTOMOBILE": "Automobile segment", "BUILDING": "Building segment", "FURNITURE": "Furniture segment",
    "HOUSEHOLD": "Household segment", "MACHINERY": "Machinery segment",
}

SQL["effect_rows"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 1000e0 AS n,
  (l_discount + 5e-3) / 10e0 AS beta, 2e-2 + l_tax / 2e0 AS prior, 9e-1 + l_discount AS residual
FROM {lineitem}
"""
SQL["individuals"] = """
SELECT l_partkey AS variant_key, (l_quantity - 255e-1) / 10e0 AS x,
  (l_quantity - 255e-1) / 40e0 + (l_discount - 5e-2) * 20e0 + l_tax AS y
FROM {lineitem}
"""


def tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}


_STORED: dict[tuple[str, str, str], str] = {}


# wide tables whose rows come from one row each: derived where they are read, so that only the columns in use are made
ROW_BY_ROW = ("sumstats", "sim_abf", "true_effects", "posteriors")


def domain(spark: SparkSession, sf_dir: str, name: str, stored: bool = True) -> DataFrame:
    """One domain table on Spark: the wide ones as a view, the others derived once per application and stored, or read as a
    view by a step that needs few of the rows."""
    text = SQL[name]
    used = tuple(t for t in TABLES if "{" + t + "}" in text)
    derive = lambda: spark.sql(text, **{t: spread(df) for t, df in tables(spark, sf_dir, used).items()})
    if name in ROW_BY_ROW or not stored:
        return derive()
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        derived = derive()
        path = f"{shared_folder(spark)}/domain-{uuid.uuid4().hex}/{name}"
        derived.write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def spread(df: DataFrame) -> DataFrame:
    """Let all cores work on a source of a few splits; larger sources, also those of one long file, are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores
    return df.repartition(cores) if few else df


def cte(name: str) -> str:
    """The same table as DuckDB text over the registered views."""
    text = SQL[name]
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text
