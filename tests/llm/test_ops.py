"""Each operator against a plain version, on small tables with nulls, empty and very long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkgrove.llm import disclosure, exact, hostrules, jaccard, languages, lines, mixing, packing, queries, tokenfile, urls
from inkgrove.llm.vocab import encoder
from tests.llm.plain_urls import PlainModel, score
from tests.oracle import SF, connection, same

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BLANKS = r"[^\x20\x09-\x0D]+"


def thue_morse(n, a, b):
    """A word that polynomial hashes modulo powers of two take for the one with a and b exchanged."""
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


def az(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every oddity, under columns whose names the operators might use themselves."""
    rows = [(None, None), (None, "x"), (1, ""), (2, "Same Text"), (2, "Same Text"), (3, "same text"), (4, "É same"), (5, "é same"), (6, " \n\t"), (7, "lone\u00a0space\x1c word " * 3000), (8, "0 +1 (2) 3" * 40)]
    rows += [(9, "hello <|endoftext|> world"), (10, thue_morse(1024, "a", "b")), (11, thue_morse(1024, "b", "a")), (-(2**63), "least id")]
    rows += [(100 + i, f"copy of one text that many rows share, number {i % 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    more = {c: F.lit("clash") for c in ("size", "id", "row", "score", "kept", "length", "piece", "h1", "label", "n", "sig", "body", "target", "copies", "_p", "a b", "my-col", "x.y")}
    return df.withColumns({**more, "lang": F.when(F.col("doc_id") % 2 == 0, "en"), "source": F.when(F.col("doc_id") % 3 > 0, "s"), "n_chars": F.lit(None).cast("long")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def test_op1_code_lengths_are_exact():
    texts = {"a": [b"abracadabra", b"abra"], "b": [b"hocus pocus"]}
    model = languages.PpmModel(texts)

    def cost(text, lang):
        counts = defaultdict(Counter)
        for t in texts[lang]:
            padded = bytes(languages.ORDER) + t
            for i in range(languages.ORDER, len(padded)):
                for k in range(languages.ORDER + 1):
                    counts[padded[i - k : i]][padded[i]] += 1
        padded, bits = bytes(languages.ORDER) + text, 0.0
        for i in range(languages.ORDER, len(padded)):
            for k in range(languages.ORDER, -1, -1):
                seen = counts.get(padded[i - k : i])
                if not seen:
                    continue
                n, kinds = sum(seen.values()), len(seen)
                if padded[i] in seen:
                    bits -= math.log2(seen[padded[i]] / (n + kinds))
                    break
                bits -= math.log2(kinds / (n + kinds))
            else:
                bits += 8
        return bits

    for text in (b"abracadabra", b"hocus", b"zzz\xff", b"ab"):
        got = model.code_lengths([text, b"pad", text])
        for k, lang in enumerate(model.languages):
            assert abs(got[0, k] / languages.UNIT - cost(text, lang)) < 0.01 * len(text) + 0.01 and got[0, k] == got[2, k]


def test_op1_segments_do_not_matter(monkeypatch):
    model = languages.PpmModel({"a": [b"some words here and there"], "b": [b"andere Worte hier"]})
    text = b"some other words und Worte " * 500
    whole = model.code_lengths([text])
    monkeypatch.setattr(languages, "STEP", 100)
    assert (model.code_lengths([text]) == whole).all()


def test_op1_held_out_accuracy(spark):
    out = queries.op1_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.95 and all(0 <= r.score <= 1 for r in out)


def test_op1_odd(odd, empty, docs):
    out = languages.identify(odd).collect()
    assert len(out) == odd.count() and all(r.lang_pred == "und" for r in out if r.doc_id in (1, 6))
    assert languages.identify(empty).count() == 0 and languages.keep_identified(odd).columns == odd.columns
    assert all(r.lang_pred == "und" for r in languages.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect())


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])[::-1]]
        if 14 <= len(d) <= 19 and sum(c if i % 2 == 0 else (c * 2 - 9 if c > 4 else c * 2) for i, c in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_op2_base(spark, docs, odd):
    extra = ["a@b.c_d@e.f x@y.z. 1.2.3.4.5.6.7.8 256.1.1.1 +1-2 +49 (0)30 123456-78. é😀 4111 1111 1111 1111", "9" * 30000 + " " + "a." * 9000 + "@b" + ".c" * 9000, "00255.1.1.001 +1+1234567890 1.1.1.1@x.de"]
    df = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame(list(enumerate(extra)), "doc_id long, text string"))
    out = disclosure.sanitise(df).join(df.select(F.col("doc_id").alias("i"), "text").distinct(), F.col("doc_id").eqNullSafe(F.col("i"))).collect()
    got = Counter((r.doc_id, tuple((s.start, s.rank, s.end) for s in r.spans if s.rank < 4)) for r in disclosure.sanitise(df).collect())
    want = Counter((r.doc_id, tuple(base_spans(r.text or ""))) for r in df.collect())
    assert got == want and out


def test_op2_terms(spark, empty):
    rows = [(i, f"note {i} about Zanzibarov whose mail is z@firma{0}.de and more words w{i} follow") for i in range(8)] + [(100 + i, f"plain text number {i} and more words") for i in range(200)] + [(500, "Zanzibarov again, zanzibarov")]
    out = {r.doc_id: r for r in disclosure.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [s.found for s in out[500].spans]
    assert found == ["Zanzibarov", "zanzibarov"] and "anzibarov" not in out[500].sanitised and "[email]" in out[0].sanitised
    assert all(not out[100 + i].spans for i in range(200)) and disclosure.sanitise(empty).count() == 0


def sanitised_query(spark, out):
    return spark.createDataFrame([(r.sanitised,) for r in out.values()], "sanitised string").select(F.sha2("sanitised", 256).alias("sanitised_sha256")).collect()


def test_op2_terms_at_any_distance_and_entities_in_few_texts(spark):
    gap = " plain words" * 40
    rows = [(i, f"Querbach{gap} mail q@firma.de") for i in range(6)] + [(10 + i, f"Duodez number {i}{gap} mail d{i}@duo.de") for i in range(2)]
    rows += [(20, f"Singulet{gap} mail s@solo.de, kept apart from solo@firma.de")] + [(30 + i, "Kopiert with plain words, kopie@firma.de") for i in range(9)]
    rows += [(40, f"Ansgar Zwirbel{gap} mail ansgar.zwirbel@post.de"), (41, "Zwirbelt away")]
    rows += [(100 + i, f"plain words and mail and number {i}") for i in range(2500)]
    out = {r.doc_id: r for r in disclosure.sanitise(spark.createDataFrame([(i, t + f" {i}" * (i < 6)) for i, t in rows], "doc_id long, text string")).collect()}
    terms = {i: {s.found for s in r.spans if s.kind == "term"} for i, r in out.items()}
    assert {r.sanitised_sha256 for r in sanitised_query(spark, out)} == {hashlib.sha256(r.sanitised.encode()).hexdigest() for r in out.values()}
    assert "Querbach" in terms[0] and "Duodez" in terms[10]  # six texts of one address, two texts of one domain
    assert "[removed]" in out[0].sanitised and "[word] with" not in out[0].sanitised
    assert not terms[20] and not terms[30]  # one text proves nothing, nor do its copies
    assert {x.lower() for x in terms[40]} == {"ansgar", "zwirbel"} and not terms[41]  # the address says so itself
    assert not any({"plain", "words", "mail"} & t for t in terms.values())


def test_op3(spark, odd, empty, docs):
    same(spark, queries.op3_exact_dedup, queries.ORACLES["op3_exact_dedup"])
    out = exact.duplicate_groups(odd).collect()
    groups = defaultdict(list)
    for r in odd.collect():
        groups[hashlib.sha256(az(r.text or "").encode()).hexdigest()].append(r.doc_id)
    assert Counter((r.text_sha256, r.doc_id) for r in out) == Counter((h, i) for h, ids in groups.items() for i in ids)
    for h, ids in groups.items():
        own = [r for r in out if r.text_sha256 == h]
        win = max((i for i in ids if i is not None), default=None)
        assert {(r.keep_id, r.group_size) for r in own} == {(win, len(ids))} and [r.doc_id for r in own if r.kept] == [win]
    left = exact.drop_duplicates(odd)
    assert left.columns == odd.columns and left.count() == len(groups) and exact.duplicate_groups(empty).count() == 0 and exact.drop_duplicates(empty).count() == 0


def test_misra_gries():
    rnd = random.Random(3)
    items = [bytes([rnd.choice([1, 2]) if rnd.random() < 0.5 else rnd.randrange(256)]) + bytes([rnd.randrange(40)]) * (rnd.random() < 0.3) for _ in range(5000)]
    heavy = {k for k, n in Counter(items).items() if n > len(items) / 21}
    parts = [exact.misra_gries(((x, 1) for x in items[i::7]), 20) for i in range(7)]
    assert heavy <= set(exact.misra_gries([kv for p in parts for kv in p.items()], 20))


def test_vocabulary_matches_the_tokenizer(docs):
    rnd = random.Random(1)
    bits = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", "'s", "'", "1", "23", ".", ",", "!", "\xa0", "\u3000", "😀", "İ", "Σ", "-", "_", "<|endoftext|>", "don't", "word", "\r\n", "\x1c", "日本", "÷", "e\u0301"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(4000)] + [r.text for r in docs.limit(50).collect()]
    twisted = [thue_morse(n, *ab) for n in (64, 1024) for ab in ("ab", "ba")]
    texts += [*twisted, " ".join(twisted), "<|EndOfText|> <|startoftext|>x", "hello <|endoftext|> world", "y" * 65 + " " + "y" * 65]
    for path in (BYTE_BPE, WORD_BPE):
        for plain in (False, True):
            t = Tokenizer.from_file(path)
            t.encode_special_tokens = plain
            want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
            assert [x.tolist() for x in encoder(path, plain).encode([x.encode() for x in texts])] == want


def test_op4_plan():
    for seed in range(200):
        r = random.Random(seed)
        cap = r.choice([10, 30, 100])
        counts = Counter(r.randint(1, cap) for _ in range(r.randint(0, 150)))
        runs, n = packing.plan(dict(counts), cap)
        bins, got = defaultdict(list), Counter()
        for x in runs:
            for k in range(x.count):
                bins[x.sequence + k // x.each].append((x.offset + k % x.each * x.length, x.length))
                got[x.length] += 1
        assert got == counts and len(bins) == n
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= cap and sum(3 * length > cap for _, length in b) <= 2
        assert n <= 11 * -(-sum(k * v for k, v in counts.items()) // cap) // 9 + 1 + sum(v for k, v in counts.items() if 2 * k > cap)


def check_packing(out, rows, cap=packing.CAPACITY):
    t = Tokenizer.from_file(BYTE_BPE)
    want = Counter()
    for r in rows:
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        head = len(ids) % cap or cap
        cuts = [0, *range(head, len(ids), cap), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(r.doc_id, k, a, b - a, zlib.crc32(ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= cap
    return len(places)


def test_op4(spark, docs, odd, empty):
    n = check_packing(packing.pack(docs, BYTE_BPE).collect(), docs.collect())
    total = packing.pieces(docs, BYTE_BPE).agg(F.sum("length")).first()[0]
    assert n <= -(-total // packing.CAPACITY) + 2
    check_packing(packing.pack(odd, BYTE_BPE).collect(), odd.collect())
    assert packing.pack(empty, BYTE_BPE).count() == 0
    packed = packing.pack(odd, BYTE_BPE, with_ids=True)
    assert packing.sequences(packed).agg(F.max(F.size("ids")), F.sum(F.size("ids"))).first()[0] <= packing.CAPACITY


def test_op5(spark, odd, empty):
    same(spark, queries.op5_mixing, queries.ORACLES["op5_mixing"])
    out = mixing.mix(odd).collect()
    assert len(out) == odd.count() and all(r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0 for r in out)
    assert Counter(map(tuple, out)) == Counter(map(tuple, mixing.mix(odd).collect()))
    assert {(r.doc_id, r.size) for r in out} == {(r.doc_id, len(re.findall(BLANKS, r.text or ""))) for r in odd.collect()}
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(odd).columns == odd.columns and mixing.apply_mix(empty).count() == 0
    sizes = spark.createDataFrame([("0a", 10), ("0b", 100), ("0c", 1000)], "_ink_s string, source_size bigint")
    assert sorted(r.target for r in mixing.source_targets(sizes).collect()) == [20, 200, 1445]


def test_op5_edge_bucket_agrees_with_one_sort(docs):
    out = mixing.mix(docs).collect()
    for target in {r.target for r in out}:
        by = defaultdict(lambda: [0, 0])
        for r in out:
            by[r.source_size][0] += r.taken
            by[r.source_size][1] = r.target
        longest = max(r.size for r in out)
        assert all(abs(taken - goal) <= longest / 2 + 1 for taken, goal in by.values()), target


def test_op6(spark):
    us = [None, "", "nourl", "http://", "HTTPS://A.Example.ORG/es/x?y", "http://example.org/en/1", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/fr", "http://xcom/fr/1", "http://b.c.com/de/a#f", "http://u:p@h.net:80/p/q?x#y", "a://b://c/d", "http://x.org"]
    us += [f"http://good{i}.com/fr/{i}" for i in range(50)] + [f"http://bad{i}.com/de/{i}" for i in range(50)] + ["http://good.net/fr/7", "http://bad.net/de/7"]
    df = spark.createDataFrame(list(enumerate(us)), "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))
    for r in urls.judge(df).collect():
        u = us[r.page_id] or ""
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u)
        host, path = (az(m[1]), m[2]) if m else ("", "")
        rule = next((x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])), None)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0] + rule[1]), u
        assert r.verdict == rule[2] if rule else r.verdict in ("allow", "block")
        if u in ("http://good.net/fr/7", "http://bad.net/de/7"):
            assert r.verdict == ("allow" if "good" in u else "block")
    assert urls.judge(df.limit(0)).count() == 0


def test_op6_hot_urls_many_chunks_and_clashes(spark, monkeypatch):
    us = [f"http://x{i % 30}.com/{'fr' if i % 2 else 'de'}/{i % 30}" for i in range(300)] + ["http://hot.net/fr/1"] * 200 + ["http://long.net/" + "ab/" * 50_000, None, "", None, ""]
    df = spark.createDataFrame([(None if i % 50 == 0 else i, u) for i, u in enumerate(us)], "page_id long, url string")
    whole = urls.judge(df).collect()
    monkeypatch.setattr(urls, "CHUNK_URLS", 4)
    clashing = df.select("page_id", "url", *(F.lit("clash").alias(c) for c in ("_ink_id", "_ink_key", "_ink_url", "n", "label", "held", "chunk", "own", "rule", "score")))
    parts = urls.judge(clashing).collect()
    key = lambda r: (r.page_id or -1, r.host, r.path, str(r.rule), r.verdict, round(r.score, 9))
    assert len(whole) == len(us) and sorted(map(key, whole)) == sorted(map(key, parts))
    assert all(r.score == 0 and r.verdict == "allow" for r in whole if not r.host) and len({r.score for r in whole if r.host == "hot.net"}) == 1
    one_kind = urls.judge(df.where("url like '%/fr/%'")).collect()
    assert one_kind and all(r.verdict == "allow" and r.score == 0 for r in one_kind)


def test_op6_digits_bytes_and_case_stay_apart(spark):
    us = [f"http://example.org/en/1{i}" for i in range(60)] + [f"http://x{i % 7}.com/fr/2{i}" for i in range(60)]
    us += [f"http://example.org/es/é{i}" for i in range(60)] + [f"http://x.com/fr/è{i}" for i in range(60)]
    us += [f"http://example.org/es/Q{i}" for i in range(60)] + [f"http://x.com/fr/q{i}" for i in range(60)]
    n = len(us)
    us += ["http://h.net/1", "http://h.net/2", "http://h.net/é", "http://h.net/è", "http://h.net/Q", "http://h.net/q"]
    got = {r.page_id: r.score for r in urls.judge(spark.createDataFrame(list(enumerate(us)), "page_id long, url string")).collect()}
    assert got[n] < got[n + 1] and got[n + 2] < got[n + 3] and got[n + 4] < got[n + 5]


def test_op6_counts_all_ruled_urls(spark):
    us = [f"http://x{i}.com/{'fr' if i % 2 else 'de'}/{i}" for i in range(80)]
    got = [r.score for r in urls.judge(spark.createDataFrame(list(enumerate(us)), "page_id long, url string")).orderBy("page_id").collect()]
    models = {k: PlainModel([u for i, u in enumerate(us) if i % 2 == k]) for k in (0, 1)}
    assert np.allclose(got, [score(models, u) for u in us], rtol=1e-5, atol=1e-6)
    assert all(abs(sum(m.chance(tuple(before), x) for x in range(257)) - 1) < 1e-9 for m in models.values() for before in (b"net", b"com"))


def test_op7(docs, odd, empty):
    for df in (docs, odd):
        out = Counter(map(tuple, hostrules.quality(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()))
        want = Counter()
        for r in df.collect():
            t = r.text or ""
            w, full = re.findall(BLANKS, t), [x for x in t.split("\n") if re.search(BLANKS, x)]
            windows = list(zip(w, w[1:], w[2:]))
            n = Counter(windows)
            covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
            want[(r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(covered), len(w) < 50 or 2 * len(covered) > len(w))] += 1
        assert out == want
    assert hostrules.quality(empty).count() == 0


def test_op7_hosts(spark):
    good, bad = "several plain words that differ " * 2 + " ".join(f"w{i}" for i in range(60)), "x"
    rows = [(i, good, "fine") for i in range(40)] + [(100 + i, good if i < 5 else bad, "junk") for i in range(60)] + [(300 + i, good, f"h{i}") for i in range(30)]
    kept = {r.doc_id: r.kept for r in hostrules.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[100 + i] for i in range(60)) and all(kept[300 + i] for i in range(30))


def test_op8(spark, docs, odd, empty):
    same(spark, queries.op8_lines, queries.ORACLES["op8_lines"])
    upper = "É" * 45
    extra = [(None, upper + "\nx"), (5000, upper + "\nÉ"), (5001, " " + upper + "\t"), (5002, "é" * 45), (5003, upper + "\n" + upper), (5003, upper + "\n" + upper), (5004, upper), (5005, "A" * 39 + "\n" * 3)]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    key = lambda x: az(x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in set(rows):
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add((i, t))
    want = Counter()
    for i, t in rows:
        keep = [x for x in t.split("\n") if len(held.get(key(x), ())) < 5 or i == max((j for j, _ in held[key(x)] if j is not None), default=None)]
        want[(i, t.count("\n") + 1, t.count("\n") + 1 - len(keep), "\n".join(keep))] += 1
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in lines.dedup_lines(df).collect()) == want
    assert lines.dedup_lines(empty).count() == 0


def test_op9(spark, docs, odd, empty, tmp_path):
    t = Tokenizer.from_file(WORD_BPE)
    for k, df in enumerate((docs, odd)):
        folder = tokenfile.write_token_files(df, WORD_BPE, str(tmp_path / str(k)))
        want = Counter()
        for r in df.collect():
            ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
            want[(r.doc_id, len(ids), zlib.crc32(ids))] += 1
        got = sorted(tokenfile.read_token_files(spark, folder).collect(), key=lambda r: r.start)
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
        order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
        assert order == sorted(order) and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    some = tokenfile.read_documents(str(tmp_path / "0"), [5, 10**6])
    assert some[10**6] == [] and len(some[5][0]) == next(n for i, _, n, _ in [(r.doc_id, r.start, r.n_tokens, 0) for r in tokenfile.read_token_files(spark, str(tmp_path / "0")).collect()] if i == 5)
    assert tokenfile.read_token_files(spark, tokenfile.write_token_files(empty, WORD_BPE, str(tmp_path / "e"))).count() == 0


def test_op9_frames(tmp_path):
    import pyarrow.fs as pafs
    import zstandard

    path, fs = str(tmp_path / "x.tokens"), pafs.LocalFileSystem()
    with fs.open_output_stream(path) as sink:
        writer = tokenfile.ShardWriter(sink)
        for i in range(50):
            writer.add(i, np.arange(i * 1000, dtype=np.uint32))
        assert writer.close() == (50, sum(i * 1000 for i in range(50)))
    with fs.open_input_file(path) as source:
        reader = tokenfile.ShardReader(source)
        assert len(reader.entries) > 5 and (reader.document(33)[2] == np.arange(33000)).all() and reader.find(7)[0].size == 7000
        broken = int(reader.at[3]) + 20
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).readall() for _ in range(1))
    assert len(whole) == 4 * sum(i * 1000 for i in range(50))
    raw = bytearray(open(path, "rb").read())
    raw[broken] ^= 1
    open(path, "wb").write(raw)
    with fs.open_input_file(path) as source, pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfile.ShardReader(source).frame(3)


def components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(BLANKS, az(t))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for i, s in enumerate(sets):
        for e in s:
            held[e].append(i)
    for a, b in {p for ids in held.values() for p in combinations(ids, 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    whole = defaultdict(list)
    for i, (j, _) in enumerate(rows):
        whole[find(i)].append(j)
    return Counter((j, len(sets[i]), min((x for x in whole[find(i)] if x is not None), default=None)) for i, (j, _) in enumerate(rows))


def test_op10(spark, docs, odd, empty):
    base = " ".join(f"w{i}" for i in range(30))
    rnd = random.Random(5)
    extra = [(6000, "One two"), (6001, "one TWO"), (6002, "two one"), (None, "one two"), (7000, "a b c d e")]
    extra += [(8000 + i, base + f" x{i}") for i in range(60)] + [(8100 + i, f"y{i} " + base) for i in range(40)] + [(8200 + i, base + " " + " ".join(f"z{i}q{k}" for k in range(8))) for i in range(30)]
    long = [f"v{i}" for i in range(150)]
    for i in range(80):  # near copies of one text, some of which only chains link
        words = list(long)
        for k in rnd.sample(range(150), rnd.randint(0, 5)):
            words[k] = f"m{i}_{k}"
        extra.append((9000 + i, " ".join(words)))
    df = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame(extra, "doc_id long, text string"))
    out = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect())
    assert out == components([(r.doc_id, r.text or "") for r in df.collect()])
    left = jaccard.drop_near_duplicates(odd)
    assert left.columns == odd.columns and jaccard.near_duplicates(empty).count() == 0 and jaccard.drop_near_duplicates(empty).count() == 0


def test_blocks_round_trip():
    rnd = np.random.default_rng(1)
    columns = [np.sort(rnd.integers(0, 2**63, 1000).astype(np.uint64)), rnd.integers(0, 9, 1000).astype(np.uint64), rnd.integers(0, 2**63, 1000).astype(np.uint64)]
    assert all((a == b).all() for a, b in zip(columns, jaccard.unpack_block(jaccard.pack_block(columns))))


def test_pipeline(spark, docs, monkeypatch):
    import corpus_pipeline

    kept = {}

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            kept[name] = docs.collect()
            return stage(spark, docs, sf_dir)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, watched(n, f)) for n, f in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, SF).collect()
    pairs = lambda rows: Counter((r.doc_id, r.text) for r in rows)
    whole = {r.doc_id: r for r in languages.identify(docs).collect()}
    assert pairs(kept["exact_copies"]) == pairs(r for r in docs.collect() if whole[r.doc_id].lang_pred != "und" and whole[r.doc_id].score >= languages.MIN_SCORE)
    last = {az(r.text): r for r in sorted(kept["exact_copies"], key=lambda r: r.doc_id)}
    assert pairs(kept["near_copies"]) == pairs(last.values())
    least = {j for j, _, c in components([(r.doc_id, r.text) for r in kept["near_copies"]]) if j == c}
    assert pairs(kept["mix"]) == pairs(r for r in kept["near_copies"] if r.doc_id in least)
    c = connection()
    c.execute("DROP VIEW documents; CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r.doc_id, r.text, r.source) for r in kept["mix"]])
    taken = {r[0]: r[4] // max(1, r[1]) for r in c.execute(queries.ORACLES["op5_mixing"]).fetchall()}
    assert pairs(kept["pack"]) == Counter({(r.doc_id, r.text): taken[r.doc_id] for r in kept["mix"] if taken[r.doc_id]})
    check_packing(out, kept["pack"])
