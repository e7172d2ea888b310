"""Queries on scalar text functions, splitting and symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrove.functions import scalars as S
from inkgrove.operators import blocks as B
from inkgrove.operators import symbols as Y
from inkgrove.plans.registry import query
from inkgrove.plans.retrieval_queries import CANARIES_SQL, canary_pairs
from inkgrove.session import table
from inkgrove.sources.corpus import blocks, notes, with_sql


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(r"SELECT doc_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: ceil(length(x) / 4.0))), 0) + length(regexp_replace(text, '[A-Za-z0-9\s]', '', 'g')) AS BIGINT) AS tokens FROM documents")
def approx_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.approx_tokens(F.col("text")).alias("tokens"))


_C = r"lower(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN length({_C}) >= 80 THEN sha256({_C}) END AS key FROM documents")
def dedup_keys(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.dedup_key(F.col("text")).alias("key"))


@query(f"{with_sql('notes', 'blocks')} SELECT id, idx, citation, CAST(substr(citation, 2, 1) AS INT) AS ring FROM blocks")
def citations(spark, sf_dir):
    return blocks(spark, sf_dir).select("id", "idx", "citation", S.citation_ring(F.col("citation")).alias("ring"))


@query(f"{with_sql('notes', 'blocks')} SELECT id, count(*) AS mentioned FROM (SELECT DISTINCT id, citation FROM blocks) GROUP BY id")
def citation_mentions(spark, sf_dir):
    text = blocks(spark, sf_dir).groupBy("id").agg(F.concat_ws(" and ", F.collect_list("citation"), F.collect_list("citation"), F.lit("xr1-0123456789abf, r9-0123456789ab")).alias("t"))
    return text.select("id", F.size(S.mentions(F.col("t"))).cast("bigint").alias("mentioned"))


_SLUG = r"regexp_replace(regexp_replace(lower(strip_accents(replace(replace(replace(replace(replace(replace(replace(%s, 'ä', 'ae'), 'Ä', 'ae'), 'ö', 'oe'), 'Ö', 'oe'), 'ü', 'ue'), 'Ü', 'ue'), 'ß', 'ss'))), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


@query(f"SELECT doc_id, CASE WHEN length(s) <= 120 THEN s ELSE regexp_replace(substr(s, 1, 120), '-[^-]*$', '') END AS slug FROM (SELECT doc_id, {_SLUG % 'text'} AS s FROM documents)")
def slugify(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.slugify(F.col("text")).alias("slug"))


@query(f"SELECT doc_id, {_SLUG % 'source'} || '-' || lang || '-' || doc_id AS name FROM documents")
def name_template(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.name_from("{dir}-{stem} {index}", dir=F.col("source"), stem=F.col("lang"), index=F.col("doc_id")).alias("name"))


@query("SELECT doc_id, substr(trim(regexp_replace(string_split(text, chr(10))[1], '^#+', '')), 1, 80) AS preview FROM documents")
def previews(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.preview(F.col("text")).alias("preview"))


@query(f"WITH {CANARIES_SQL} SELECT item_id AS query, doc_id AS doc FROM canaries")
def canary_match(spark, sf_dir):
    return canary_pairs(spark, sf_dir)


@query(r"SELECT doc_id, md5(regexp_replace(lower(text), '[^\pL\pN]+', '', 'g')) AS form FROM documents")
def canary_forms(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(S.canary_form(F.col("text"))).alias("form"))


@query("SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'license', ''))) // 7 AS BIGINT) AS n, regexp_matches(text, '(?i)(^|[^\\pL\\pN])license([^\\pL\\pN]|$)') AS whole FROM documents WHERE contains(lower(text), 'license')")
def subject_occurrences(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).where(F.contains(F.lower(t), F.lit("license"))).select("doc_id", S.occurrences(t, "license").cast("bigint").alias("n"), S.whole_word(t, "license").alias("whole"))


#: The price is rounded to the nearest whole number, half to even, as the SQL's cast does; Spark's cast alone would cut it off.
_V = "CASE WHEN p_partkey % 11 = 0 THEN p_brand ELSE p_size || '.' || p_partkey % 17 || '.' || CAST(rint(p_retailprice) AS BIGINT) % 9 || CASE WHEN p_partkey % 5 = 0 THEN '-rc1' ELSE '' END END"


@query("SELECT p_partkey AS id, p_partkey % 11 <> 0 AND [p_size, p_partkey % 17, CAST(p_retailprice AS BIGINT) % 9] < [20, 5, 4] AS older FROM part")
def version_compare(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.older_version(F.expr(_V), F.lit("20.5.4")).alias("older"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'unspecified' WHEN doc_id % 4 = 1 THEN source END AS origin FROM documents")
def untrusted_sources(spark, sf_dir):
    i = F.col("doc_id") % 4
    tags = F.when(i == 0, F.array(F.lit("trust:untrusted"))).when(i == 1, F.array(F.lit("a"), F.lit("trust:untrusted"), F.concat(F.lit("src:"), "source"))).otherwise(F.array(F.concat(F.lit("src:"), "source")))
    return _docs(spark, sf_dir).select("doc_id", S.untrusted_source(tags).alias("origin"))


_NAME = "CASE doc_id % 4 WHEN 0 THEN substr(text, 1, 14) WHEN 1 THEN lower(replace(substr(text, 1, 60), ' ', '-')) WHEN 2 THEN source || '-' || lang ELSE lower(replace(text, ' ', '-')) END"


@query(f"""SELECT doc_id, CASE WHEN n = '' THEN 'empty' WHEN length(n) > 120 THEN 'long' WHEN strlen(n) > 240 THEN 'bytes' WHEN starts_with(n, '-') OR ends_with(n, '-') THEN 'edge-hyphen' WHEN contains(n, '--') THEN 'double-hyphen'
    WHEN NOT regexp_full_match(n, '[a-z0-9\\-\\x{{DF}}-\\x{{F6}}\\x{{F8}}-\\x{{FF}}\\x{{100}}-\\x{{24F}}\\x{{1E00}}-\\x{{1EFF}}]*') OR lower(n) <> n THEN 'characters' END AS problem FROM (SELECT doc_id, {_NAME} AS n FROM documents)""")
def name_problems(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.name_problem(F.expr(_NAME)).alias("problem"))


_SCOPE = "CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN substr(text, 1, 20) WHEN 2 THEN source || '/' || lang ELSE replace(substr(text, 1, 90), ' ', '_') END"


@query(rf"""SELECT doc_id, CASE WHEN s = '' THEN 'empty' WHEN length(s) > 64 THEN 'long' WHEN regexp_matches(s, '\s') THEN 'space' WHEN contains(s, '/') OR contains(s, chr(92)) THEN 'separator' WHEN regexp_matches(s, '[[:cntrl:]]') THEN 'control' END AS problem
    FROM (SELECT doc_id, {_SCOPE} AS s FROM documents)""")
def scope_problems(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.scope_problem(F.expr(_SCOPE)).alias("problem"))


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.norm(F.col("embedding")), 6).alias("norm"))


@query("SELECT user_id, CAST(sum(CASE WHEN h < 3600 THEN 1 ELSE 0 END) AS BIGINT) AS minutes, CAST(sum(CASE WHEN h >= 86400 THEN 1 ELSE 0 END) AS BIGINT) AS days FROM (SELECT user_id, event_id * 37 AS h FROM events) GROUP BY user_id")
def ages(spark, sf_dir):
    words = table(spark, sf_dir, "events").select("user_id", S.age_words(F.col("event_id") * 37).alias("w"))
    return words.groupBy("user_id").agg(F.count_if(F.col("w").endswith(" min")).alias("minutes"), F.count_if(F.col("w").endswith(" d")).alias("days"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events WHERE event_id % 9 <> 0 GROUP BY 1")
def days_of(spark, sf_dir):
    from inkgrove.operators.usage import day_of

    raw = F.when(F.col("event_id") % 9 == 0, "2024-13-99T").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf_dir, "events").select(day_of(raw).alias("day")).where("day is not null").groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(*) AS turns, CAST(sum(length(trim(text)) + 1 + length(trim(text))) AS BIGINT) AS chars FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def transcripts(spark, sf_dir):
    marked = F.concat(F.lit("<system-reminder>"), "text", F.lit("</system-reminder>"), F.trim("text"), F.lit("|"), F.trim("text"), F.lit("<system-reminder>a\nb</system-reminder> "))
    t = table(spark, sf_dir, "conversations").where("role <> 'system'").withColumn("clean", S.clean_turn(marked))
    return t.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("clean")).alias("chars"))


@query(r"""SELECT conv_id, CAST(sum(len(list_filter(string_split(replace(replace(text, '. ', chr(10) || '- [ ] '), ', ', chr(10) || ' * todo '), chr(10)), lambda x: regexp_matches(x, '(?i)^\s*(?:[-*]\s*)?(?:\[ \]|(?:todo|pending|open|next)\b)')))) AS BIGINT) AS points FROM conversations GROUP BY conv_id""")
def open_points(spark, sf_dir):
    text = F.replace(F.replace("text", F.lit(". "), F.lit("\n- [ ] ")), F.lit(", "), F.lit("\n * todo "))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.size(S.open_points(text))).alias("points"))


@query("SELECT doc_id, sha256('k|' || lower(source) || ' q') AS hashed FROM documents")
def query_hashes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.query_hash(F.concat(F.lit("  "), F.upper("source"), F.lit("   Q ")), "k").alias("hashed"))


@query("SELECT c_custkey AS id, CAST(lpad(CAST(c_custkey * 7919 AS VARCHAR), 18, '0') || '1314' || lpad(CAST(c_custkey % 98 AS VARCHAR), 2, '0') AS HUGEINT) % 97 = 1 AS ok FROM customer")
def iban_checks(spark, sf_dir):
    k = F.col("c_custkey")
    account = F.concat(F.lit("DE"), F.lpad((k % 98).cast("string"), 2, "0"), F.lpad((k * 7919).cast("string"), 18, "0"))
    spaced = F.regexp_replace(account, "(.{4})", "$1 ")
    return table(spark, sf_dir, "customer").select(k.alias("id"), S.iban_ok(F.when(k % 2 == 0, account).otherwise(spaced)).alias("ok"))


@query("""SELECT doc_id, round(list_sum(list_transform(list_distinct(string_split(text, '')), lambda c: -(length(text) - length(replace(text, c, ''))) / length(text) * log2((length(text) - length(replace(text, c, ''))) / length(text)))), 6) AS bits
    FROM documents""")
def entropy(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(S.shannon_bits(F.col("text")), 6).alias("bits"))


@query()
def split_blocks(spark, sf_dir):
    found = notes(spark, sf_dir).select("id", F.explode(B.blocks_of(F.col("text"))).alias("b"))
    return found.select("id", "b.idx", "b.token_count", "b.oversized", F.sha2("b.text", 256).alias("sha256"))


@query(r"""SELECT doc_id AS id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: ceil(length(x) / 4.0))), 0) + length(regexp_replace(text, '[A-Za-z0-9\s]', '', 'g')) AS BIGINT) AS tokens,
    md5(regexp_replace(text, '\s+', '', 'g')) AS letters, 0 AS "over" FROM documents""")
def split_conserves(spark, sf_dir):
    """What the blocks of a note hold together: all its tokens and letters, in order, none of more than a block's tokens."""
    found = notes(spark, sf_dir).select("id", F.explode(B.blocks_of(F.col("text"))).alias("b")).select("id", "b.*")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "")
    letters = F.md5(F.regexp_replace(whole, r"\s+", ""))
    return found.groupBy("id").agg(F.sum("token_count").alias("tokens"), letters.alias("letters"), F.count_if(F.col("token_count") > B.BLOCK_TOKENS).alias("over"))


@query(r"""WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line, x FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
    d AS (SELECT 'src/' || doc_id || '.py' AS path, regexp_extract(x[line], '^[A-Za-z]+') AS name, line FROM l),
    t AS (SELECT *, CASE WHEN name = 'Then' THEN 0 WHEN lower(name) = 'then' THEN 1 ELSE 2 END AS tier FROM d WHERE contains(lower(name), 'then'))
    SELECT path, 'function' AS kind, name, line, (SELECT count(*) FROM t) AS matched, (SELECT count(*) FROM t) > 50 AS truncated FROM t ORDER BY tier, path, line LIMIT 50""")
def find_symbols(spark, sf_dir):
    code = F.regexp_replace("text", "(?m)^([A-Za-z]+).*$", "def $1(): return 1")
    files = _docs(spark, sf_dir).select(F.concat(F.lit("src/"), "doc_id", F.lit(".py")).alias("path"), code.alias("content"))
    return Y.find(Y.extract(files), "Then", 50).select("path", "kind", "name", F.col("line").cast("bigint").alias("line"), "matched", "truncated")
