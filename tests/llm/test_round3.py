"""Secrets, whitening and phrases against plain versions, on odd tables and driver tables."""

import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrove.llm import phrases, queries, secrets, whitening
from inkgrove.plans import shared
from tests.llm.test_ops import docs, empty, odd  # noqa: F401
from tests.oracle import SF, connection

ASSIGN = r"""(?i:([Pp]assword|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def plain_secrets(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def token(rng, beginning, alphabet, n):
    return beginning + "".join(rng.choices(alphabet, k=n))


def test_op11_base(spark, docs, odd):  # noqa: F811
    extra = ["token=abc token=token: abcdefgh", "API_KEY='x' apikey: \"ABCDEFGH=/+.\"", "ſecret=abcdefgh toKen=abcdefgh é😀 PassWord = abcdefgh.", "AKIAAKIA AKIA" + "A" * 12 + " xAKIA1234567890AB", "a" * 40000 + "g" + "0" * 31, None, ""]
    df = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame(list(enumerate(extra)), "doc_id long, text string"))
    rows = secrets.find_secrets(df).withColumn("text", F.lit("")).collect()
    got = sorted((str(r.doc_id), sorted((s.start, s.rank, s.end) for s in r.spans if s.kind != "format")) for r in rows)
    assert got == sorted((str(r.doc_id), plain_secrets(r.text or "")) for r in df.collect())


def test_op11_odd(odd, empty):  # noqa: F811
    assert secrets.find_secrets(odd).count() == odd.count() and secrets.find_secrets(empty).count() == 0
    assert secrets.find_secrets(odd.withColumn("id", F.lit(1)).withColumnRenamed("text", "a.b"), text="a.b").columns == ["doc_id", "spans"]


def test_op11_query_digests(spark):
    row = queries.op11_secrets(spark, SF)
    assert row.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"] and row.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_op11_infers_formats(spark, docs):  # noqa: F811
    rng = random.Random(5)
    alphabet, upper = string.ascii_letters + string.digits, string.digits + "ABCDEF"
    labelled = [f'token = "{token(rng, "gtk_", alphabet, 36)}"' for _ in range(150)] + [f"secret: {token(rng, '', upper, 40)}" for _ in range(150)]
    rows = [(10**6 + i, f"some words before {x} and after") for i, x in enumerate(labelled)]
    bare = {2 * 10**6 + i: token(rng, "gtk_", alphabet, 36) if i % 2 else token(rng, "", upper, 40) for i in range(60)}
    words = sorted({w for r in docs.select("text").limit(50).collect() for w in re.findall("[A-Za-z]+", r.text or "")})
    decoys = ["".join(rng.choices(words, k=5)) for _ in range(60)] + [token(rng, "", string.digits, 16) for _ in range(60)] + ["https-//www.example.com/en/path/index.html", "2024-01-01", "gtk_button_label", "src/main/resources/file_name.txt"]
    rows += [(i, f"see {x}. or not") for i, x in bare.items()] + [(3 * 10**6 + i, f"see {x} or not") for i, x in enumerate(decoys)]
    found = secrets.find_secrets(docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    spans = {r.doc_id: [s.found for s in r.spans if s.kind == "format"] for r in found}
    assert sum(spans[i] == [x] for i, x in bare.items()) >= 57
    assert not {x for i, v in spans.items() if i not in bare for x in v}
    assert [spans[i] for i in bare if spans[i]] and all(r.spans[0].start == 4 for r in found if r.doc_id in bare and r.spans)


def test_op11_merges_loops_and_keeps_chains():
    rng = random.Random(1)
    found = secrets.infer(sorted({token(rng, "AKIA", string.ascii_uppercase + string.digits, 16) for _ in range(400)}))
    assert 5 <= len(found.onward) <= 12  # a chain of four and a loop
    code = secrets._CODE[[ord(c) for c in "AKIA"]]
    at = 0
    for c in code[:3]:
        assert found.bits[at, c] < 0.3
        at = found.onward[at, c]
    assert np.allclose(2.0 ** -found.bits.sum(axis=1, where=False), 1) and np.allclose((2.0**-found.bits).sum(axis=1), 1)


def test_op11_costs_of_short_and_long_runs_agree(monkeypatch):
    rng = random.Random(2)
    strings = [token(rng, "", string.ascii_letters, rng.randrange(1, 60)) for _ in range(200)] + ["a"]
    model = secrets.infer(sorted(set(strings)))
    short = secrets.cost(model, strings)
    monkeypatch.setattr(secrets, "LONG_RUN", 0)
    assert np.allclose(short, secrets.cost(model, strings))


def test_op11_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, f"token = {i:08d}x") for i in range(2000)], "doc_id long, text string").repartition(7)
    values = {r.value for r in secrets.labelled_sample(df, fitted=20).where("kind = 'assign'").collect()}
    assert len(values) == 20 and values == {r.value for r in secrets.labelled_sample(df.repartition(2), fitted=20).where("kind = 'assign'").collect()}


def plain_whitening(rows):
    """By the covariance and its eigenvectors."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in kept], np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    c = x - sums / n
    v = c.T @ c / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:32]
    return [i for i, _ in kept], ((n * x - sums) ** 2).sum(axis=1), c @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def check_whitening(out, rows):
    ids, deviation, whitened, explained = plain_whitening(rows)
    k = whitened.shape[1]
    assert len(out) == len(ids) * k
    got = {}
    for r in out:
        assert r.n == len(ids) and abs(r.explained - explained[r.component - 1]) < 1e-9 and r.identity_error < 1e-6
        got.setdefault(r.vec_id, {})[r.component] = (r.deviation, r.whitened)
    table = np.array([[got[i][c + 1][1] for c in range(k)] for i in ids])
    assert all(got[i][1][0] == d for i, d in zip(ids, deviation.tolist()))
    sign = np.sign((table * whitened).sum(axis=0))
    assert np.abs(table * sign - whitened).max() < 1e-6


def test_op12(spark):
    out = queries.op12_whitening(spark, SF).collect()
    check_whitening(out, [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])


def test_op12_many_partitions_and_hot_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(300)] + [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(200)]
    rows += [(2000, None), (2001, [1.0, None, 2.0, 3.0, 4.0]), (2002, [float("nan")] * 5), (2003, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (2004, [1.0, 2.0]), (2005, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(23).withColumns({c: F.lit("clash") for c in ("id", "vector", "n", "whitened", "component")})
    check_whitening(whitening.whitened_components(df).collect(), [(i, np.float32(v).tolist()) for i, v in rows[:500]])


def test_op12_degenerate(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened_components(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened_components(spark.createDataFrame([(1, None), (2, [float("nan")])], schema)).count() == 0
    same = whitening.whitened_components(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)] + [(None, [1.0, 2.0])], schema)).collect()
    assert len(same) == 20 and all(r.whitened is None and r.deviation == 0 and r.identity_error is None for r in same)
    flat = whitening.whitened_components(spark.createDataFrame([(i, [float(i), 7.0]) for i in range(9)], schema)).collect()
    assert {r.component for r in flat if r.whitened is None} == {2} and all(r.identity_error < 1e-9 for r in flat)
    huge = whitening.whitened_components(spark.createDataFrame([(1, [3e38]), (2, [-3e38]), (3, [1e6])], schema)).collect()
    assert len(huge) == 3 and all(np.isfinite(r.whitened) for r in huge)
    x = [(1 << 60) + 1_000_000, -(1 << 60) + 1_000_000, 64_000_000 + 1_000_000]
    assert {r.vec_id: int(r.deviation) for r in huge} == {i + 1: (3 * v - sum(x)) ** 2 for i, v in enumerate(x)}


def test_op12_never_forms_all_in_one_task(spark):
    """Triangles meet FAN_IN at a time."""
    rows = spark.range(4000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.sin(F.col("id") * i)).cast("array<float>").alias("embedding")).repartition(40)
    n, sums = whitening.exact_sums(rows)
    r = whitening.triangle(rows, n, sums)
    x = np.floor(64 * np.array([v.embedding for v in rows.collect()], np.float64)).astype(np.int64) + 1_000_000
    c = x - np.array(sums) / n
    assert r.shape == (6, 6) and np.allclose(r.T @ r, c.T @ c)


def test_op10_clashing_names(spark):
    from inkgrove.llm import jaccard

    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, text), (2, text), (3, "other words entirely here now and then")], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("_ink_id", "_ink_row", "row", "a.b")})
    out = jaccard.drop_near_duplicates(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def plain_phrases(rows, top=2000):
    n, f = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] = n.get(lang, 0) + len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i : i + k])
                    f[key] = f.get(key, 0) + 1
    found, longer = [], {}
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= 10:
            cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.append((lang, w, a, f[lang, w[:k]], f[lang, w[k:]], score))
            if len(w) == 3:
                for inner in (w[:2], w[1:]):
                    longer[lang, inner] = max(longer.get((lang, inner), 0), a)
    out = []
    for lang in n:
        kept = [x for x in found if x[0] == lang and not 100 * longer.get((lang, x[1]), 0) >= 50 * x[2]]
        kept.sort(key=lambda x: (-x[5], -x[2], " ".join(x[1]).encode()))
        out += [(lang, i + 1, " ".join(w), a, left, right, n[lang], score) for i, (_, w, a, left, right, score) in enumerate(kept[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(4)
    words = ["The", "cat", "sat", "é", "É", "on x", "a\x1cb", "ünd", "😀", "mat"]
    rows = [(rng.choice(["en", "de", None, "und"]), rng.choice([" ", "\t ", ", ", ". ", "\x0b"]).join(rng.choices(words, k=rng.randrange(0, 30)))) for _ in range(400)]
    rows += [("en", "one hot license line, of many words; repeated")] * 300 + [("en", None), ("fr", ""), ("x", "a b c " * 5000), ("es", "solo dos palabras")]
    return rows


def test_op13(spark, spoken):
    df = spark.createDataFrame(spoken, "lang string, text string").withColumns({c: F.lit("clash") for c in ("piece", "copies", "words", "n", "phrase")})
    assert sorted(map(tuple, phrases.collocations(df).collect())) == plain_phrases(spoken)
    assert sorted(map(tuple, phrases.collocations(df, top=3).collect())) == plain_phrases(spoken, 3)


def test_op13_small_steps_and_hot_requests(spark, spoken, monkeypatch):
    """Few words at once, little memory, every part hot, a ranking of many steps."""
    monkeypatch.setattr(phrases, "WORDS_AT_ONCE", 50)
    monkeypatch.setattr(phrases, "RANKED_TOGETHER", 2)
    monkeypatch.setattr(shared, "HOT_SHARE", 10**9)
    df = spark.createDataFrame(spoken, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(df, top=7).collect())) == plain_phrases(spoken, 7)


def test_op13_saturated_filter(spark, spoken, monkeypatch):
    """A filter of one chunk with fewer bits than phrases lets more pass, and changes nothing."""
    monkeypatch.setattr(phrases, "CHUNK_BITS", 8)
    monkeypatch.setattr(phrases, "FILTER_BITS", 16)
    assert sorted(map(tuple, phrases.collocations(spark.createDataFrame(spoken, "lang string, text string"), top=50).collect())) == plain_phrases(spoken, 50)


def test_op13_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a", 1, 3 * 10**12), ("en", "b", 1, 7 * 10**12), ("en", "a b", 2, 2999999999999)], "lang string, phrase string, size int, f bigint")
    row = phrases.cut_scores(counts).first()
    assert row.score == 10**6 * 2999999999999**2 // (21 * 10**24)


def test_op13_empty(spark, empty):  # noqa: F811
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "few words")], "lang string, text string")).count() == 0


def test_op13_sql(spark):
    out = sorted(map(tuple, queries.op13_phrases(spark, SF).collect()))
    assert out == sorted(connection().execute(queries.ORACLES["op13_phrases"]).fetchall())
