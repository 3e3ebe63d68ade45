"""Registered queries of the operators: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lociary.llm import (
    byte_bpe, dom_content, edit_match, host_reputation, jaccard_join, language_id, prefix_trie, quality_ratio, quote_links, repeated_runs,
    token_counts, toxicity, vector_dedup,
)
from lociary.llm.common import store
from lociary.llm.host_reputation import Rule
from lociary.operators.keyed import attach


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_match.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: The rules that hold before the reputation.
URL_RULES = [
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
]


def _shown(pages: DataFrame) -> DataFrame:
    """``page_id, doc_id``: the document a page shows is the first number in its path."""
    number = F.regexp_extract(host_reputation.path_of(F.col("url")), r"[0-9]+", 0).try_cast("long")
    return pages.select("page_id", number.alias("doc_id")).filter(F.col("doc_id").isNotNull())


def op2_url_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality label of the document that a page shows is the page's outcome."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = _shown(pages).join(_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good")), "doc_id")
    return host_reputation.filter_urls(pages, outcomes, URL_RULES)


def op3_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.reply_ordered(_table(spark, sf_dir, "conversations"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.token_digests(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_dom_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    model = dom_content.train(pages, _table(spark, sf_dir, "documents"), _shown(pages))
    return dom_content.extract(pages, model)


def op7_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.read_pieces(spark, public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), pieces)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_sign_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


WORD = r"[^\x20\x09-\x0D]+"


def _crc(number: Column) -> Column:
    """Unsigned crc32 of a number's decimal text."""
    return F.crc32(number.cast("string").cast("binary"))


def _looped(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in every document whose crc32 ends in 0 the words from ``a`` on repeat the first ``p`` of them."""
    crc = _crc(F.col("doc_id"))
    mixed = F.floor(crc / 10)

    def rebuilt(words: Column) -> Column:
        n = F.size(words)
        a = (mixed % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + mixed % 8))).cast("int")
        tail = F.transform(F.sequence(F.lit(0), n - a - 1), lambda k: F.get(words, a + k % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), tail), " ")).otherwise(F.lit(""))

    # one element holds all words, so that they are split once and not for every place
    looped = F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), rebuilt)[0]
    return docs.select("doc_id", F.when(crc % 10 == 0, looped).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = repeated_runs.periodic_runs(_looped(_table(spark, sf_dir, "documents")))
    greatest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    top = runs.withColumn("top", greatest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.col2")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.col3")).alias("period"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    exponent = F.floor(1000 * F.col("length") / F.col("period")).cast("long")
    return top.select("doc_id", "n_runs", "start", "length", "period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def _grafted(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The conversations rebuilt: the first crc32 % 4 turns of conversation c - c % 20, then the own turns after as many; depths from 1."""
    cut = _crc(F.col("conv_id")) % 4
    heads = turns.filter("at < 3 AND conv_id % 20 = 0").withColumnRenamed("conv_id", "base")
    taken = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(heads, "base").filter(F.col("at") < cut)
    counts = taken.groupBy("conv_id").agg(F.count(F.lit(1)).alias("taken"))
    own = attach(turns.filter(F.col("at") >= cut), counts, ["conv_id"], "left")
    own = own.withColumn("depth", F.col("at") - cut + F.coalesce("taken", F.lit(0)) + 1)
    columns = ["conv_id", "depth", "t1", "t2", "words"]
    return taken.withColumn("depth", F.col("at") + 1).select(*columns).unionByName(own.select(*columns))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = store(prefix_trie.ordered_turns(_table(spark, sf_dir, "conversations")), "turns")
    ids = store(turns.select("conv_id").distinct(), "conversations")
    return prefix_trie.prefix_trie(_grafted(turns, ids), ids)


def op13_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ratio.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_edit_decontamination": op1_edit_decontamination,
    "op2_url_host_reputation": op2_url_host_reputation,
    "op3_quote_links": op3_quote_links,
    "op4_language_id": op4_language_id,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_dom_content": op6_dom_content,
    "op7_toxicity_cnn": op7_toxicity_cnn,
    "op8_unigram_token_counts": op8_unigram_token_counts,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_sign_hash_dedup": op10_sign_hash_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_quality_ratio": op13_quality_ratio,
}

def _posterior_sql(name: str, groups: str, key: str) -> str:
    """One level of the reputation: the weight of the level from its moments, then the posterior of each group."""
    return f"""
        {name}_sums AS (SELECT count(*) AS g, sum(n) AS total, sum(n * m * (1 - m)) AS inside, sum(n * power(good / n - m, 2)) AS between_
            FROM {groups} WHERE n > 0),
        {name}_r AS (SELECT g, total, inside, (between_ - inside / total * g) / nullif(inside / total * (total - g), 0) AS r FROM {name}_sums),
        {name}_k AS (SELECT CASE WHEN g = 0 OR total <= g OR inside = 0 OR NOT r > 0 THEN 1000.0::DOUBLE
            ELSE round(least(greatest(1 / r - 1, 1), 1000), 6) END AS k FROM {name}_r),
        {name}_post AS (SELECT {key}, a, b, a / (a + b) AS mean FROM (
            SELECT {key}, k * m + good AS a, k * (1 - m) + n - good AS b FROM {groups}, {name}_k))"""


#: The two-label suffixes of the operator do not occur in the given tables and are left out here.
_OP2_SQL = f"""
        WITH p AS MATERIALIZED (
            SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        seen AS (SELECT page_id, count(*) AS n, sum(quality) AS good FROM p JOIN labels l
            ON l.doc_id = TRY_CAST(nullif(regexp_extract(path, '[0-9]+'), '') AS BIGINT) WHERE quality IS NOT NULL GROUP BY page_id),
        hosts AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS good,
                list_extract(string_split(host, '.'), -1) AS suffix, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain
            FROM p LEFT JOIN seen USING (page_id) GROUP BY host),
        suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT (sum(good) + 1) / (sum(n) + 2) FROM hosts) AS m FROM hosts GROUP BY suffix),
        {_posterior_sql("s", "suffixes", "suffix")},
        domains AS (SELECT domain, sum(n) AS n, sum(good) AS good, any_value(q.mean) AS m FROM hosts JOIN s_post q USING (suffix) GROUP BY domain, suffix),
        {_posterior_sql("d", "domains", "domain")},
        leaves AS (SELECT host, n, good, q.mean AS m FROM hosts JOIN d_post q USING (domain)),
        {_posterior_sql("h", "leaves", "host")},
        judged AS (SELECT p.*, round(mean - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 9) AS bound,
                CASE WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
                     WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
                     WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
                     WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
                     WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/' END AS rule
            FROM p JOIN h_post USING (host))
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN bound < 0.6 THEN 'block' ELSE 'allow' END AS verdict, bound FROM judged
    """

#: A table with the crc32 of the text of every distinct ``id`` of a query, from its hexadecimal digits and a table of 16 entries.
_CRC_SQL = """
        nibbles AS MATERIALIZED (SELECT list(list_reduce([x, 1, 2, 3, 4], lambda c, k: xor(c >> 1, (c & 1) * 3988292384::BIGINT)) ORDER BY x) AS t
            FROM (SELECT unnest(range(16))::BIGINT AS x)),
        crcs AS MATERIALIZED (SELECT id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, digits),
                lambda c, d: xor(c >> 4, t[(xor(c, d) & 15) + 1]))) AS crc
            FROM (SELECT id, flatten(list_transform(range(1, length(digits), 2), lambda i: [
                (strpos('0123456789ABCDEF', digits[i + 1]) - 1)::BIGINT, (strpos('0123456789ABCDEF', digits[i]) - 1)::BIGINT])) AS digits
                FROM (SELECT id, hex(encode(id::VARCHAR)) AS digits FROM ids)), nibbles)"""


#: Equal words q apart, as islands of equal 5-word windows q apart, are the runs of period q and of its multiples.
_OP11_SQL = rf"""
        WITH rows_ AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
                list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda w: w <> '') AS w FROM documents),
        ids AS (SELECT DISTINCT doc_id AS id FROM rows_ WHERE doc_id IS NOT NULL), {_CRC_SQL},
        shape AS (SELECT r, doc_id, w, len(w) AS n, coalesce(crc, 1) AS crc, coalesce(crc, 1) // 10 AS g FROM rows_ LEFT JOIN crcs ON doc_id = id),
        looped AS (SELECT *, CASE WHEN crc % 10 = 0 AND n > 0 THEN g % n END AS a FROM shape),
        texts AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE
                list_concat(w[1:a], list_transform(range(n - a), lambda k: w[a + 1 + k % (1 + (n - a) // (3 + g % 8))])) END AS w FROM looped),
        words AS MATERIALIZED (SELECT r, i, w[i + 1] AS word FROM texts, unnest(range(n)) AS t(i)),
        windows AS MATERIALIZED (SELECT r, i, hash(word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS h,
                lead(i, 4) OVER o AS full_ FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
        same AS (SELECT x.r, x.i, y.i - x.i AS q FROM windows x JOIN windows y ON x.r = y.r AND x.h = y.h AND x.i < y.i
            WHERE x.full_ IS NOT NULL AND y.full_ IS NOT NULL),
        islands AS (SELECT r, q, min(i) AS s, count(*) + 4 + q AS n FROM
            (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same) GROUP BY r, q, island),
        long_ AS MATERIALIZED (SELECT * FROM islands WHERE n >= greatest(6, 4 * q)),
        runs AS MATERIALIZED (SELECT * FROM long_ x WHERE NOT EXISTS (SELECT 1 FROM long_ y
            WHERE y.r = x.r AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.s + y.n >= x.s + x.n)),
        top AS (SELECT r, count(*) AS n_runs, max(row(n, -s, -q)) AS m, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
        dropped AS (SELECT DISTINCT r, unnest(range(s + q, s + n)) AS i FROM runs),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (r, i) GROUP BY r)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -m[2] AS start, m[1] AS length, -m[3] AS period, 1000 * m[1] // -m[3] AS exponent_milli,
            sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
        FROM texts LEFT JOIN top USING (r) LEFT JOIN kept USING (r)
    """

_OP12_SQL = rf"""
        WITH turns AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place
            FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (SELECT DISTINCT conv_id AS id FROM turns), {_CRC_SQL},
        grafted AS (SELECT id AS conv_id, 0 AS own, place, role, text FROM crcs JOIN turns ON conv_id = id - id % 20 AND place < crc % 4
            UNION ALL SELECT conv_id, 1, place, role, text FROM turns JOIN crcs ON id = conv_id WHERE place >= crc % 4),
        rebuilt AS (SELECT conv_id, row_number() OVER w AS depth, list(struct_pack(role := role, text := text)) OVER w AS key,
                len(list_filter(regexp_split_to_array(text, '[ 	-
]+'), lambda w: w <> '')) AS words
            FROM grafted WINDOW w AS (PARTITION BY conv_id ORDER BY own, place ROWS UNBOUNDED PRECEDING)),
        prefixes AS MATERIALIZED (SELECT * FROM rebuilt UNION ALL SELECT id, 0, [], 0 FROM ids),
        nodes AS MATERIALIZED (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words FROM prefixes GROUP BY depth, key),
        children AS (SELECT key[1:depth - 1] AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
        subtrees AS (SELECT key[1:k] AS key, sum((n_convs - 1) * words) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
            FROM nodes x LEFT JOIN children c USING (key), unnest(range(depth + 1)) AS t(k) GROUP BY 1),
        ends AS (SELECT key, string_agg(conv_id, ',' ORDER BY conv_id) AS convs FROM
            (SELECT * FROM prefixes QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY key)
        SELECT x.conv_id, x.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(c.n, 0) AS n_children, s.leaves AS n_leaves,
            s.saved::BIGINT AS saved_tokens, sha256(coalesce(convs, '')) AS ends_sha256
        FROM nodes x LEFT JOIN nodes p ON x.depth > 0 AND p.key = x.key[1:x.depth - 1] LEFT JOIN children c ON c.key = x.key
        JOIN subtrees s ON s.key = x.key LEFT JOIN ends e ON e.key = x.key
    """

_OP13_SQL = rf"""
        WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
                list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
        words AS MATERIALIZED (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM texts, unnest(range(1, len(w) + 1)) AS t(i)),
        repeated AS (SELECT r, unnest([i, i + 1, i + 2]) AS i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS times FROM words WHERE c IS NOT NULL)
            WHERE times > 1),
        repeats AS (SELECT r, count(DISTINCT i) AS n FROM repeated GROUP BY r),
        lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts),
        dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
        ids AS (SELECT DISTINCT a AS id FROM words), {_CRC_SQL},
        good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
        placed AS MATERIALIZED (SELECT r, x.crc % 65536 AS bucket FROM words JOIN crcs x ON a = x.id
            UNION ALL SELECT r, (40503 * x.crc + y.crc) % 65536 FROM words JOIN crcs x ON a = x.id JOIN crcs y ON b = y.id),
        counts AS (SELECT bucket, count(*) AS raw, count(g.doc_id) AS target FROM placed JOIN texts USING (r) LEFT JOIN good g USING (doc_id) GROUP BY bucket),
        totals AS (SELECT sum(raw) AS raw, sum(target) AS target FROM counts),
        weights AS (SELECT bucket, round(ln((c.target + 16) / (c.raw * t.target / t.raw::DOUBLE + 16)) * 1000000)::BIGINT AS weight FROM counts c, totals t),
        scores AS (SELECT r, sum(weight)::BIGINT AS total FROM placed JOIN weights USING (bucket) GROUP BY r),
        measured AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(d.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
                len(w) < 50 OR 100 * coalesce(p.n, 0) > 50 * len(w) AS base_failed, total
            FROM texts LEFT JOIN dups d USING (r) LEFT JOIN repeats p USING (r) LEFT JOIN scores USING (r))
        SELECT * EXCLUDE (total), NOT base_failed AND total >= -80000 * (2 * n_words - 1) AS kept,
            CASE WHEN n_words > 0 THEN total / ((2 * n_words - 1) * 1000000)::DOUBLE END AS score FROM measured
    """

ORACLES = {
    "op13_quality_ratio": _OP13_SQL,
    "op12_prefix_trie": _OP12_SQL,
    "op11_periodic_runs": _OP11_SQL,
    "op2_url_host_reputation": _OP2_SQL,
    "op10_sign_hash_dedup": """
        WITH RECURSIVE v AS MATERIALIZED (
            SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM (
                SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ) WHERE list_dot_product(e, e) > 0
        ), links AS MATERIALIZED (
            SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
            WHERE list_dot_product(x.e, y.e) >= 0.95 * x.norm * y.norm
        ), reach(a, b) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
        ), degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
        FROM embeddings e JOIN component c USING (vec_id) LEFT JOIN degree d USING (vec_id)
    """,
    "op9_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS MATERIALIZED (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents
        ), shingles AS MATERIALIZED (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
            FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
        ), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), links AS MATERIALIZED (
            SELECT p.a, p.b FROM (
                SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y
                ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
            ) p JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b WHERE 100 * c >= 75 * (m.n + n.n - c)
        ), reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
        )
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, g.component_id
        FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
        JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) g ON g.doc_id = d.doc_id
    """,
}
