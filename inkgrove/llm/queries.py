"""The queries opN_<name> over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrove.llm import disclosure, exact, hostrules, jaccard, languages, lines, mixing, packing, phrases, secrets, tokenfile, urls, whitening
from inkgrove.session import table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = languages.identify(table(spark, sf_dir, "documents"), train=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(*_span_columns(disclosure.KINDS), F.sha2("sanitised", 256).alias("sanitised_sha256"))


def _span_columns(kinds: tuple[str, ...]) -> list:
    """The digest columns of spans: the last kind is the method's, the others the base's."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != kinds[-1])
    counts = [F.size(F.filter("spans", _is_kind(k))).cast("bigint").alias(f"n_{k}") for k in kinds[:-1]]
    return ["doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")]


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return hostrules.quality(table(spark, sf_dir, "documents")).select(*columns)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfile.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.read_token_files(spark, folder)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents")).select(*_span_columns(secrets.KINDS))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language, op2_sanitise, op3_exact_dedup, op4_packing, op5_mixing, op6_urls, op7_quality, op8_lines, op9_tokenfile, op10_jaccard, op11_secrets, op12_whitening, op13_phrases)}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES = {
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {_AZ}) AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (t)""",
    "op5_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]', '', 'g')) AS size,
                   (('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
            FROM documents),
        s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS w
            FROM d GROUP BY source),
        r AS (
            SELECT *, 2.0 * source_size / w AS ratio,
                   CAST(1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                   / CAST(sum(w) OVER (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
            FROM s),
        t AS (
            SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), w * (SELECT arg_min(level, ratio) FILTER (level <= ratio) FROM r)) AS target FROM r),
        c AS (
            SELECT source, length(bin(size)) AS odds, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY 1, 2),
        e AS (
            SELECT c.*, source_size, target,
                   (target - CAST(2 * coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY odds DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
                   / CAST(nullif(sum(words * odds) OVER (PARTITION BY c.source ORDER BY odds DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS DOUBLE) AS scale
            FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
        x AS (
            SELECT *, coalesce(least(2::DOUBLE, arg_max(scale, odds) FILTER (scale * odds <= 2) OVER (PARTITION BY source) * odds), 2::DOUBLE) AS expected FROM e),
        p AS (
            SELECT *, floor(expected) AS whole, (expected - floor(expected)) / (1 - (expected - floor(expected))) AS ratio,
                   target - CAST(sum(CAST(floor(expected) AS BIGINT) * words) OVER (PARTITION BY source) AS DOUBLE) AS rest FROM x),
        v AS (
            SELECT doc_id, size, u, p.source, source_size, target, whole, rest, (u / (1 - u)) / (CASE WHEN ratio > 0 AND size > 0 THEN ratio END) AS q
            FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND p.odds = length(bin(d.size))),
        k AS (
            SELECT *, sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q / (1 + q) NULLS LAST, u, size ROWS UNBOUNDED PRECEDING) AS reached FROM v)
        SELECT doc_id, size, source_size, target,
               CASE WHEN size = 0 THEN 0 ELSE CAST(size * (whole + CASE WHEN q IS NOT NULL AND 2 * reached - size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) END AS taken
        FROM k""",
    "op8_lines": rf"""
        WITH l AS (
            SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], E' \t\n\x0b\x0c\r'), {_AZ}) AS key
            FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
        k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        m AS (SELECT l.*, k.last IS NOT NULL AND k.last <> doc_id AS dropped FROM l LEFT JOIN k USING (key))
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op13_phrases": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
        m AS (SELECT lang, piece, count(*) AS m FROM p GROUP BY ALL),
        w AS (SELECT row_number() OVER () AS id, lang, m, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM m),
        t AS (SELECT lang, CAST(sum(m * len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        u AS (SELECT id, lang, m, unnest(w) AS x, unnest(range(len(w))) AS i FROM w),
        v AS (SELECT lang, m, x, lead(x) OVER p AS y, lead(x, 2) OVER p AS z FROM u WINDOW p AS (PARTITION BY id ORDER BY i)),
        g AS (
            SELECT lang, 1 AS k, m, x AS phrase FROM v
            UNION ALL SELECT lang, 2, m, x || ' ' || y FROM v WHERE y IS NOT NULL
            UNION ALL SELECT lang, 3, m, x || ' ' || y || ' ' || z FROM v WHERE z IS NOT NULL),
        f AS (SELECT lang, phrase, k, CAST(sum(m) AS BIGINT) AS f FROM g GROUP BY ALL),
        c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
        s AS (
            SELECT c.*, j, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
            FROM c JOIN range(1, 3) r(j) ON j < c.k
            JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ')
            JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        o AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS f FROM c, range(1, 3) r(i) WHERE k = 3 GROUP BY ALL),
        z AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE o.f IS NULL OR 100 * o.f < 50 * a),
        q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
        SELECT lang, rank, phrase, a, l, r, n, score FROM q JOIN t USING (lang) WHERE rank <= 2000""",
}
