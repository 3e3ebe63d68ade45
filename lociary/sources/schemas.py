"""Explicit schemas of the known file kinds: no inference pass, no drift between files."""

SIM_ABF = (
    "trait string, region string, variant string, prob double, beta double, se double, r double, "
    "p_het double, t_dentist double, nlog10p_dentist double, n_samples bigint, gamma boolean, "
    "lead_variant boolean, cs boolean, cs_99 boolean"
)
TRUE_EFFECTS = "variant string"
POSTERIOR_RAW = "trait string, region string, variant string, prob double, mean double, sd double, cs int"
PANEL_INFO = "SNP string, ALT_Frq double, Rsq double"
POPULATION_MAF = "contig string, position bigint, ref string, alt string, min_maf double, max_maf double"
BUILD_MAP = "original_variant string, variant string"
MAX_PIP = "variant string, variant_b37 string, max_pip double"
DROPPED_LOCI = "trait_short string, lead_pip_variant string"
STUDY_FLAGS = "study_accession string, is_meta_analysis boolean"
STUDY_IDS = "study_accession string"
SAMPLE_SIZES = "trait string, sex string, kind string, ancestry string, biobank string, cases bigint, controls bigint"
BED = "contig string, start bigint, end bigint"
