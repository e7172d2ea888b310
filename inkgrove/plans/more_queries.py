"""Further queries: parsing, bundles, differences, joins of the fleet."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrove.functions import scalars as S
from inkgrove.operators import audit as A
from inkgrove.operators import blocks as B
from inkgrove.operators import index as I
from inkgrove.operators import ingest as G
from inkgrove.operators import pii as P
from inkgrove.plans.registry import query
from inkgrove.plans.shared import cut
from inkgrove.session import table
from inkgrove.sources import readers as R
from inkgrove.sources.corpus import audit, blocks, notes, with_sql


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("SELECT doc_id AS id, CAST(doc_id % 5 AS INT) AS ring, CASE WHEN doc_id % 6 = 1 THEN 'unknown key: colour' WHEN doc_id % 6 = 2 THEN 'no head' END AS error, CASE WHEN doc_id % 6 NOT IN (1, 2) THEN md5(text) END AS body_md5 FROM documents")
def note_parse(spark, sf_dir):
    i = F.col("doc_id")
    head = F.concat(F.when(i % 6 == 2, "").otherwise("---\n"), F.lit("id: "), i, F.lit("\nname: note-"), i, F.lit("\nring: "), i % 5, F.lit("\ntags: [a, b]\n"), F.when(i % 6 == 1, "colour: red\n").otherwise(""), F.lit("---\n"))
    d = _docs(spark, sf_dir)
    files = d.select(i.cast("string").alias("path"), F.concat(head, "text").alias("content"))
    return R.parse_notes(files).select(F.col("path").cast("bigint").alias("id"), (F.col("path").cast("bigint") % 5).cast("int").alias("ring"), "error", F.md5("body").alias("body_md5"))


@query("SELECT count(*) + 2 AS lines, count(*) AS rows, true AS whole FROM events")
def audit_bundle(spark, sf_dir):
    log = A.seal(audit(spark, sf_dir).drop("at", "value").withColumn("device", F.concat(F.lit("dev-"), F.col("seq") % 16)))
    lines = cut(A.export_lines(log), "bundle")
    found = A.verify_bundle(lines)
    return lines.agg(F.count("*").alias("lines"), F.max(F.get_json_object("value", "$.rows").try_cast("bigint")).alias("rows")).crossJoin(found.select("whole"))


@query("SELECT doc_id, md5(nfc_normalize(source || 'ü' || lang)) AS form FROM documents")
def nfc_names(spark, sf_dir):
    decomposed = F.concat("source", F.lit("ü"), "lang")
    return _docs(spark, sf_dir).select("doc_id", F.md5(B.nfc(decomposed)).alias("form"))


@query("""SELECT doc_id, CASE WHEN n <= 1999 THEN 1 END AS added, CASE WHEN n <= 1999 THEN CAST(gone AS INT) END AS removed
    FROM (SELECT doc_id, len(l) AS n, len(list_filter(l, lambda x: contains(x, 'sh'))) AS gone FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""")
def line_diffs(spark, sf_dir):
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.contains(x, F.lit("sh")))
    new = F.array_join(F.concat(F.array(F.concat(F.lit("# document "), "doc_id")), kept), "\n")
    d = _docs(spark, sf_dir).select("doc_id", B.line_diff(F.col("text"), new).alias("diff"))
    counted = lambda sign: F.when(F.col("diff").isNotNull(), F.size(F.filter("diff", lambda x: x.startswith(sign))))
    return d.select("doc_id", counted("+").alias("added"), counted("-").alias("removed"))


@query("SELECT c_custkey AS request, s.s_name AS requester, a.s_name AS approver FROM customer JOIN supplier s ON s.s_suppkey = c_custkey % 80 LEFT JOIN supplier a ON a.s_suppkey = CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 70 END")
def access_requests(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    r = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request"), (F.col("c_custkey") % 80).alias("by"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 70).alias("ok"))
    who = lambda key, name: s.select(F.col("s_suppkey").alias(key), F.col("s_name").alias(name))
    return r.join(who("by", "requester"), "by").join(who("ok", "approver"), "ok", "left").select("request", "requester", "approver")


@query(f"""{with_sql('notes')}, a AS (SELECT name, md5(text) AS h FROM notes WHERE ring <= 1 AND id % 7 <> 0), b AS (SELECT name, CASE WHEN id % 9 = 0 THEN 'x' ELSE md5(text) END AS h FROM notes WHERE ring <= 1 AND id % 8 <> 0)
    SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.name = b.name WHERE a.h IS DISTINCT FROM b.h""")
def resident_diff(spark, sf_dir):
    n = notes(spark, sf_dir).where("ring <= 1").select("id", "name", F.md5("text").alias("h"))
    before = n.where("id % 7 <> 0").select(F.col("name").alias("id"), F.col("h").alias("hash"), F.lit(0).alias("mtime"), F.lit(True).alias("has_vectors"))
    after = n.where("id % 8 <> 0").select(F.col("name").alias("id"), F.when(F.col("id") % 9 == 0, "x").otherwise(F.col("h")).alias("hash"), F.lit(0).alias("mtime"))
    change = F.when(F.col("state") == "new", "added").when(F.col("state") == "gone", "removed").otherwise(F.col("state"))
    return I.snapshot_diff(before, after).where("state in ('new', 'gone', 'changed')").select(F.col("id").alias("name"), change.alias("change"))


@query(f"""{with_sql('notes', 'audit')}, s AS (SELECT subject, actor, row_number() OVER (PARTITION BY subject ORDER BY seq DESC) AS r FROM audit WHERE action = 'note.click')
    SELECT name, actor AS signed_by FROM notes JOIN s ON s.subject = notes.name AND r = 1 WHERE id % 3 <> 0""")
def signed_hits(spark, sf_dir):
    n = notes(spark, sf_dir).select("id", "name", F.md5("text").alias("body_hash"))
    last = A.latest_per(audit(spark, sf_dir).where("action = 'note.click'"), "subject")
    told = last.join(n.select(F.col("name").alias("subject"), F.when(F.col("id") % 3 == 0, "older").otherwise(F.col("body_hash")).alias("body_hash")), "subject")
    return A.signed(n, told).select("name", "signed_by")


@query("SELECT source, count(*) AS n FROM documents WHERE source LIKE 'src1_' GROUP BY source")
def glob_match(spark, sf_dir):
    path = F.concat(F.lit("a/b/"), "source", F.lit("/x.md"))
    return _docs(spark, sf_dir).where(path.rlike(S.glob_regex("b/src1?/*.md"))).groupBy("source").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CAST(len(list_filter(l, lambda x: starts_with(x, 'T'))) + CASE WHEN starts_with(text, 'T') THEN 0 ELSE 1 END AS INT) AS parts, length(text) + 2 * len(list_filter(l, lambda x: starts_with(x, 'T'))) AS chars
    FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)""")
def import_sections(spark, sf_dir):
    files = _docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", "(?m)^T", "# T").alias("content"))
    return G.cut_sections(files).groupBy("doc_id").agg(F.count("*").cast("int").alias("parts"), F.sum(F.length("part")).alias("chars"))


_LONG_WORD = r"(?<![\p{L}\p{N}])([a-z]{9,})(?![\p{L}\p{N}])"


@query(r"SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(text, '[^\pL\pN]+'), lambda x: regexp_full_match(x, '[a-z]{9,}')))), ','), '') AS targets FROM documents")
def wiki_links(spark, sf_dir):
    body = F.concat(F.regexp_replace("text", _LONG_WORD, "[[$1|shown]]"), F.lit("\n`[[code]]`\n```\n[[fenced]]\n```\n"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(B.links_of(body)), ",").alias("targets"))


@query(r"""WITH w AS (SELECT doc_id, unnest(l) AS word, unnest(range(len(l))) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\pL\pN]+'), lambda x: regexp_full_match(x, '[a-z]{9,}')) AS l FROM documents)),
    f AS (SELECT doc_id, word, min(i) AS i FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f)
    SELECT doc_id, 'src/' || word || '.rs' AS path, doc_id + 1 AS first, doc_id + 3 AS last FROM r WHERE r <= 16""")
def code_anchors(spark, sf_dir):
    i = F.col("doc_id")
    place = F.concat(F.lit("src/$1.rs:"), i + 1, F.lit("-"), i + 3, F.lit(" https://x.org/a.rs:9"))
    found = _docs(spark, sf_dir).select("doc_id", F.explode(B.anchors_of(F.regexp_replace(F.col("text"), F.lit(_LONG_WORD), place))).alias("a"))
    return found.select("doc_id", "a.path", F.col("a.first").cast("bigint").alias("first"), F.col("a.last").cast("bigint").alias("last"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(html, '><', '>-' || chr(10) || chr(10) || chr(10) || '#<'), '(\pL)-\n([a-zà-ÿ])', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '(?m)^#', '\\#', 'g'), E' \t\n\r\x0b\x0c')) AS page FROM pages""")
def page_cleaning(spark, sf_dir):
    raw = F.replace("html", F.lit("><"), F.lit(">-\n\n\n#<"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(B.clean_page(raw)).alias("page"))


_ADDRESS = r"[A-Za-z0-9][A-Za-z0-9._%+''-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}"


@query(rf"""WITH e AS (SELECT DISTINCT doc_id, text, unnest(regexp_extract_all(text, '{_ADDRESS}')) AS found FROM documents), p AS (SELECT *, string_split(text, found) AS parts, unnest(range(1, len(string_split(text, found)))) AS k FROM e)
    SELECT doc_id, 'email' AS kind, length(head) - length(replace(head, chr(10), '')) + 1 AS line, length(string_split(head, chr(10))[-1]) + 1 AS "column", substr(found, 1, 2) || repeat('*', greatest(length(found) - 4, 0)) || right(found, 2) AS shown
    FROM (SELECT *, substr(text, 1, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) AS BIGINT) + (k - 1) * length(found)) AS head FROM p)""")
def masked_findings(spark, sf_dir):
    found = _docs(spark, sf_dir).select("doc_id", F.explode(P.masked(P.findings(F.col("text")), F.col("text"))).alias("m")).where("m.kind = 'email'")
    return found.select("doc_id", "m.kind", F.col("m.line").cast("bigint").alias("line"), F.col("m.column").cast("bigint").alias("column"), "m.shown")


@query("SELECT event_id AS seq, json_extract_string(props, '$.k') AS k FROM events")
def detail_flatten(spark, sf_dir):
    return audit(spark, sf_dir).select("seq", F.to_json(F.variant_get(F.parse_json("detail"), "$.k", "variant")).alias("k"))


@query("SELECT CAST(sum(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS unreadable, CAST(sum(CASE WHEN event_id % 5 <> 0 THEN event_id ELSE 0 END) AS BIGINT) AS returned FROM events")
def ledger_lines(spark, sf_dir):
    line = F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("event_type").alias("op"), F.col("event_id").alias("returned"))))
    rows = table(spark, sf_dir, "events").select(F.from_json(line, R.LEDGER_SCHEMA + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    return rows.agg(F.count_if(F.col("_corrupt").isNotNull()).alias("unreadable"), F.sum("returned").alias("returned"))
