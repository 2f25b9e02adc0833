"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.toxicity import fit, toxicity

    docs = _documents(spark, sf_dir)
    return toxicity(docs, fit(docs, _labels(spark, sf_dir)))


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.quality_fm import fit, quality

    docs = _documents(spark, sf_dir)
    return quality(docs, fit(docs, _labels(spark, sf_dir)))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.exact_dedup import exact_dedup

    return exact_dedup(_documents(spark, sf_dir))


OP3_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def op7_piece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from skein.llm.piece_fst import encode

    return encode(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from skein.llm.common import shared_folder
    from skein.llm.token_files import read_tokens, write_tokens

    folder = shared_folder(spark)
    manifest = write_tokens(_documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, folder, manifest)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from skein.llm.packing import pack

    return pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.lm_scoring import lm_scoring

    return lm_scoring(_documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.quality_rules import quality_rules

    return quality_rules(_documents(spark, sf_dir))


#: Words, lines and windows by the contract; the rules of default_rules() as one conjunction, in no order.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, ws[i : i + 4] AS five FROM w, unnest(range(1, len(ws) - 3)) AS u(i) WHERE len(ws) >= 5),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM g) WHERE n >= 2),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, 5) AS o(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
             length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n_letters,
             length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_upper, len(list_distinct(ws)) AS n_distinct
      FROM w LEFT JOIN c USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 18 * n_words OR 10 * n_symbols > n_words
            OR 100 * n_dup_lines > 30 * n_lines OR 100 * n_letters < 60 * word_chars
            OR 100 * n_upper > 40 * greatest(1, n_letters) OR (n_words >= 50 AND 100 * n_distinct < 10 * n_words)) AS kept
FROM v
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.substring_dedup import substring_dedup

    return substring_dedup(_documents(spark, sf_dir))


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i : i + 12] AS win FROM w, unnest(range(1, len(ws) - 11)) AS u(i) WHERE len(ws) >= 13),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM g) WHERE first < doc_id),
c AS (SELECT doc_id, list_distinct(list(i + k)) AS gone FROM r, range(0, 13) AS o(k) GROUP BY doc_id),
k AS (SELECT w.doc_id, ws, gone, list_filter(ws, lambda x, i: NOT list_contains(coalesce(gone, []), i)) AS kept FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, len(ws) AS n_words, len(ws) - len(kept) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.jaccard_join import jaccard_join

    return jaccard_join(_documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.conversations import damage, repair

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damage(rows), ids=rows)


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.mixing import mix

    return mix(_documents(spark, sf_dir)).taken()


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from skein.llm.fim import fill_in_middle, restore

    d = restore(fill_in_middle(_documents(spark, sf_dir)))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: The form, the cuts and the arrangement by the contract; the restored text is the text.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS ws, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(ws) AS n, least(h1 % (len(ws) + 1), h2 % (len(ws) + 1)) AS a, greatest(h1 % (len(ws) + 1), h2 % (len(ws) + 1)) AS b FROM u),
f AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
             coalesce(array_to_string(list_slice(ws, 1, a), ''), '') AS p, coalesce(array_to_string(list_slice(ws, a + 1, b), ''), '') AS m, coalesce(array_to_string(list_slice(ws, b + 1, n), ''), '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_quality_fm, op3_exact_dedup, op4_packing, op5_lm_scoring, op6_quality_rules, op7_piece_fst, op8_token_files, op9_substring_dedup, op10_jaccard_join, op11_conversation_repair, op12_source_mixing, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op6_quality_rules": OP6_SQL, "op9_substring_dedup": OP9_SQL, "op13_fill_in_middle": OP13_SQL}
