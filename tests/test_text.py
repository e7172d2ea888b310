import random

from pyspark.sql import functions as F

from inkgrove.functions import scalars as S
from inkgrove.operators import blocks as B
from inkgrove.operators import pii as P
from inkgrove.operators import symbols as Y
from inkgrove.sources import readers as R
from inkgrove.plans.catalogue import ORACLES, QUERIES
from tests.oracle import same


def one(spark, column, **values):
    return spark.range(1).select(column).first()[0]


def test_scalars(spark):
    v = lambda c: one(spark, c)
    assert v(S.approx_tokens(F.lit("abcde f, ü"))) == 2 + 1 + 1 + 1
    assert v(S.slugify(F.lit("Größe & Maß: Éléphant!"))) == "groesse-mass-elephant"
    assert len(v(S.slugify(F.lit("word " * 60)))) <= 120
    assert v(S.mod11_10(F.lit("136695976"))) is True and v(S.mod11_10(F.lit("136695975"))) is False
    assert v(S.iban_ok(F.lit("DE89 3704 0044 0532 0130 00"))) is True
    assert v(S.duration_ok(F.lit("P1Y6M"))) and not v(S.duration_ok(F.lit("P0D"))) and not v(S.duration_ok(F.lit("2 years")))
    assert str(v(S.expires_at(F.lit("2024-01-31").cast("timestamp"), F.lit("P1M")))) == "2024-02-29 00:00:00"
    assert v(S.older_version(F.lit("1.9"), F.lit("1.10"))) and not v(S.older_version(F.lit("x"), F.lit("1")))
    assert v(S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert v(S.excerpt(F.lit("a" * 100 + "Key" + "b" * 100), F.lit("key"))) == "a" * 60 + "Key" + "b" * 60
    assert v(S.citation_ring(F.lit("r3-0123456789ab"))) == 3 and v(S.citation_ring(F.lit("r7-0123456789ab"))) is None


def test_globs():
    import re

    g = lambda p, x: bool(re.match(S.glob_regex(p), x))
    assert g("*.md", "a/b.md") and g("/a/*.md", "a/b.md") and not g("/a/*.md", "a/c/b.md") and g("a/**/d?", "a/b/c/d1") and not g("/*.md", "a/b.md")


def test_splitter_packs_and_keeps_text():
    body = "# One\n\n" + "word " * 300 + "\n\n" + "more " * 300 + "\n\n```\n" + "x = 1\n" * 400 + "```\n\n<!-- at: page 3 -->\nlast"
    blocks = B.split_body(body)
    assert blocks[0].text.startswith("# One\n\nword") and blocks[-1].locator == "page 3" and blocks[-1].text == "last"
    assert [b for b in blocks if b.oversized] and all(b.tokens <= B.BLOCK_TOKENS or b.oversized for b in blocks)
    assert "# x" in B.split_body("# a\n# x\ntext\n# b\ny")[0].text
    assert B.split_body(None) == [] and B.split_body("\n\n") == []


def test_splitter_random():
    rnd = random.Random(7)
    pieces = ["# h\n", "```\n", "~~~\n", "text ", "\n", "\n\n", "é" * 50, "word " * 200, "[[x]]", "`a`", "\r\n", "<!-- at: p -->\n"]
    for _ in range(300):
        body = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 25)))
        blocks = B.split_body(body)
        assert blocks == B.split_body(body)
        letters = lambda t: "".join(t.split())
        marks = body.replace("\r\n", "\n")
        held = letters("".join(b.text for b in blocks))
        assert len(held) <= len(letters(marks))


def test_splitter_is_verbatim():
    assert [b.text for b in B.split_body("a\n\n\n\nb")] == ["a\n\n\n\nb"] and [b.text for b in B.split_body("a\r\nb\r\n\r\nc\r\n")] == ["a\r\nb\r\n\r\nc"]
    assert [(b.text, b.locator, b.line) for b in B.split_body("# h\n<!-- at: p 1 -->\ntext\n\n<!-- at: p 2 -->\nmore")] == [("# h\n\ntext", "p 1", 1), ("more", "p 2", 6)]
    long = "\n".join(f"line {i} " + "word " * 60 for i in range(30))
    assert all(b.text in long and b.text.startswith("line") and b.tokens <= B.BLOCK_TOKENS for b in B.split_body(long))
    rnd = random.Random(8)
    pieces = ["# h\n", "```\n", "~~~\n", "text ", "\n", "\n\n", "é" * 50, "word " * 200, "a b\n" * 90, "x" * 3000, "\r\n", "\u00a0", "<!-- at: p -->\n"]
    for _ in range(500):
        body = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 25)))
        whole = B.segments(body)
        marks = {(s.start, s.end) for s in whole if s.kind == "locator"}
        shown = "".join(c for i, c in enumerate(body) if not any(a <= i < b for a, b in marks))
        blocks, at = B.split_body(body), 0
        for b in blocks:
            at = shown.index(b.text, at) + len(b.text)  # every block is a slice, in order
            assert b.tokens == B.count_tokens(b.text) and (b.tokens <= B.BLOCK_TOKENS or b.oversized)
        assert "".join("".join(b.text for b in blocks).split()) == "".join(shown.split())
        lines = body.split("\n")
        assert all(b.text.split("\n")[0].strip() in lines[b.line - 1] for b in blocks if not marks)


def test_splitter_against_a_plain_packing():
    """Bodies of one-line paragraphs: blocks are what adding one paragraph after another gives."""
    rnd = random.Random(3)
    for _ in range(100):
        lines = [" ".join(rnd.choice(["w", "word", "é", "longerword"]) for _ in range(rnd.randint(1, 120))) for _ in range(rnd.randint(1, 20))]
        want, now = [], []
        for line in lines:
            if now and B.count_tokens("\n\n".join([*now, line])) > B.BLOCK_TOKENS:
                want.append("\n\n".join(now))
                now = []
            now.append(line)
        assert [b.text for b in B.split_body("\n\n".join(lines))] == [*want, "\n\n".join(now)]


def test_diff_of_long_texts_with_one_change():
    a = "\n".join(f"line {i}" for i in range(1900))
    out = B._diff((a, a.replace("line 700\n", "new\nlines\n")))
    assert [x for x in out if x[0] != " "] == ["-line 700", "+new", "+lines"] and len(out) == 1902 and B._diff((a, "x\n" * 3000)) is None


def test_links_and_anchors():
    assert B.wiki_links("[[a]] `[[no]]` [[b|x]] [[a#p]]\n```\n[[c]]\n```") == ["a", "b"]
    assert B.anchors("see src/a.rs:12-30, https://x.org/a.rs:3 and b.py:7") == [("src/a.rs", 12, 30), ("b.py", 7, 7)]


def test_diff_nfc_and_pages(spark):
    row = spark.createDataFrame([("a\nb\nc", "a\nc\nd", "ü", "long-\nword\n\n\n\n#x")], "o string, n string, u string, p string")
    out = row.select(B.line_diff(F.col("o"), F.col("n")), B.nfc(F.col("u")), B.clean_page(F.col("p"))).first()
    assert out[0] == [" a", "-b", " c", "+d"] and out[1] == "ü" and out[2] == "longword\n\n\\#x"


def test_pii():
    kinds = lambda t: [(f.kind, P.CONFIDENCE[f.confidence]) for f in P.scan_text(t)]
    assert kinds("mail anna@firma.de") == [("email", "high")] and kinds("git@firma.de") == [("email", "low")] and kinds("a@example.com") == [("email", "low")]
    assert kinds("8.8.8.8") == [("ipv4", "high")] and kinds("10.0.0.1") == [("ipv4", "low")] and kinds("1.2.3.4.5") == [] and kinds("300.1.1.1") == []
    assert kinds("DE89370400440532013000")[0][0] == "iban" and kinds("DE89370400440532013001") == []
    assert kinds("born on 01.02.1980") == [("birth-date", "high")] and kinds("01.02.1980") == []
    assert kinds("+49 30 1234567")[0] == ("phone", "high")
    assert kinds("password = changeme") == [] and kinds("password = hunter2hunter2") == [("api-key", "high")]
    assert kinds("https://bob:s3cretpw@host") != [] and kinds("2001:4860:4860::8888") == [("ipv6", "high")]
    assert kinds("DE136695976")[0][0] == "vat-id"


def test_redaction(spark):
    row = spark.createDataFrame([(1, "to anna@firma.de now"), (2, None), (3, "clean")], "id int, text string")
    out = {r.id: r for r in row.select("id", P.redact(F.col("text")).alias("t"), P.findings(F.col("text")).alias("f")).collect()}
    assert out[1].t == "to [redacted:email] now" and out[2].t is None and out[3].t == "clean" and len(out[1].f) == 1


def test_symbols(spark):
    rust = "pub struct Store {\n    x: u8,\n}\nimpl Store {\n    pub fn open(&self) {\n        if x {}\n    }\n}\n"
    found = list(Y.definitions("a.rs", rust))
    assert [(f[2], f[3], f[4], f[5], f[6]) for f in found] == [("struct", "Store", "", 1, 3), ("impl", "Store", "", 4, 8), ("method", "open", "Store", 5, 7)]
    documented = list(Y.definitions("a.rs", "/// Doc\n#[inline]\nfn f() {}\n\nunion U { a: u8 }"))
    assert [(f[2], f[3], f[5], f[8]) for f in documented] == [("function", "f", 3, 1), ("union", "U", 5, 5)]
    assert [d[3] for d in Y.definitions("a.sql", "CREATE TABLE IF NOT EXISTS notes (\n id int);")] == ["notes"]
    assert [d[3] for d in Y.definitions("a.md", "# One\n```\n# no\n```\n## Two")] == ["One", "Two"]
    assert [d[3] for d in Y.definitions("a.json", '{"k": 1}')] == ["k"] and list(Y.definitions("a.bin", "x")) == []
    files = spark.createDataFrame([("a.rs", rust), ("b.py", "def open():\n    pass\n")], "path string, content string")
    hits = Y.find(Y.extract(files), "Store::open").collect()
    assert [(h.path, h.matched) for h in hits] == [("a.rs", 1)]
    both = Y.find(Y.extract(files), "nowhere.open", 1).collect()
    assert [(h.scope_ignored, h.truncated, h.matched) for h in both] == [(True, True, 2)] and Y.find(Y.extract(files), "STORE.open").first().scope_ignored is False
    assert Y.find(Y.extract(files), "::").count() == 0 and Y.find(Y.extract(files), "ope").count() == 2 and Y.find(Y.extract(files), "op").count() == 0


def test_notes_round_trip(spark, tmp_path):
    head = {"id": "01", "name": "a-b", "ring": "2", "tags": ["x", "src:y"]}
    text = R.render_note(head, "body\r\n# x\n")
    parsed = R.parse_note(text)
    assert parsed["body"] == "body\r\n# x\n" and parsed["tags"] == ["x", "src:y"] and parsed["ring"] == 2
    assert R.parse_note("no head")["error"] and "unknown" in R.parse_note("---\nid: 1\nname: a\nring: 1\ncolour: red\n---\n")["error"]
    for name in ("r2/a-b.md", "r2/Bad Name.md", "r9/x.md", "r1/y.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    files = R.note_files(spark, str(tmp_path))
    assert {r.skipped for r in files.collect()} == {None, "bad name", "not in a ring folder", "not markdown"}
    notes = R.parse_notes(files.where("skipped is null")).collect()
    assert [(n.name, n.ring, n.error) for n in notes] == [("a-b", 2, None)]


def test_ledgers_and_trees(spark, tmp_path):
    (tmp_path / "u.jsonl").write_text('{"at":"2024-01-01T00:00:00Z","op":"recall","returned":3}\nbroken\n')
    rows = R.read_ledger(spark, str(tmp_path / "u.jsonl")).cache()
    assert rows.where("_corrupt is not null").count() == 1 and rows.where("op = 'recall'").count() == 1
    (tmp_path / "t").mkdir()
    (tmp_path / "t/s.jsonl").write_text('{"type":"user","message":{"role":"user","content":"hi <system-reminder>x</system-reminder>"}}\n{"type":"assistant","message":{"role":"assistant","content":[{"type":"text","text":"yes"},{"type":"tool_use","name":"Bash"}]}}\n{"isMeta":true,"message":{"role":"user","content":"meta"}}\n')
    assert [(r.role, r.text) for r in R.read_transcripts(spark, str(tmp_path / "t")).collect()] == [("user", "hi"), ("assistant", "yes\n[used Bash]")]
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def f():\n    pass\n")
    (src / "b.bin").write_bytes(b"\0\1")
    (src / "yarn.lock").write_text("x")
    assert {r.skipped for r in R.source_files(spark, str(src)).collect()} == {None, "binary", "lock file"}
    assert {(r.skipped, r.n) for r in R.skip_counts(R.source_files(spark, str(src))).collect()} == {("binary", 1), ("lock file", 1)}
    (src / "d.md").write_text("# One\nx\n## Two\ny")
    spark.dataSource.register(R.MarkdownSource)
    assert [(r.locator) for r in spark.read.format("inkgrove_documents").load(str(src)).collect()] == ["One", "Two"]


def test_slugify_reads_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "!" * 300 + " Späte Wörter"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.slug for r in QUERIES["slugify"](spark, str(tmp_path)).collect()} == {1: "spaete-woerter", 2: None}


def test_canaries_match_in_any_case_and_punctuation(spark, tmp_path):
    docs = [(1, "a copy: THE QUICK,\nbrown fox (jumps)!"), (2, "the quick brown fox stands"), (3, "it is short"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "The quick brown fox jumps."), (8, "is short"), (9, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in QUERIES["canary_match"](spark, str(tmp_path)).select("query", "doc").collect()] == [(7, 1)]


def test_version_compare_rounds_prices_as_its_sql(spark, tmp_path):
    rows = [(17 * k + 5, "p", "b", "t", 20, 900 + k / 10) for k in range(120)] + [(11 * 17 + 5, "p", "b", "t", 20, 904.5), (39, "p", "b", "t", 20, 903.5)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    same(spark, QUERIES["version_compare"], ORACLES["version_compare"], str(tmp_path))
