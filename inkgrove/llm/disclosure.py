"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base detectors find emails, IP addresses, card numbers and phone numbers. Their values, and the parts that several share (an address's
domain, a number's beginning), are the protected entities. From the whole corpus, co-occurrence then estimates how strongly a term reveals an
entity: its disclosure is -log2 p(e | t), the bits that are left to guess once the term is known. p(e | t) is estimated low, as
k / (n(t) + own + DISCOUNT), where k = n(t, e) + own and own is 1 if the term stands in the address itself: few texts prove little, and one text proves
nothing (k must reach LEAST_EVIDENCE). A term that leaves REMOVE_BITS at most is removed wherever it stands, one that leaves GENERALISE_BITS
generalised, if it also gains LEAST_GAIN bits over -log2 p(e): what everybody shares is no secret. Nothing here moves with the number of texts: the same evidence has the same verdict
in a small corpus and in a large one. All counts are of different whole texts, so copies of one document prove nothing; a term counts where it stands outside base spans.

To generalise a term is to name only the longest beginning that CLASS_TERMS different terms of the corpus share: what is left tells one
of these at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrove.plans.shared import cut, join_sized

#: As if so many more texts held a term, without the entity.
DISCOUNT = 2.0
#: Bits left to guess of an entity, from which on a term is removed or generalised.
REMOVE_BITS, GENERALISE_BITS = 0.5, 1.0
#: Texts that hold both, the address's own words counting as one, and bits that the term must gain.
LEAST_EVIDENCE, LEAST_GAIN = 2, 3.0
#: Of a phone or card number, the digits that its region or issuer has.
PHONE_REGION, CARD_ISSUER = 5, 6
#: Terms are runs of so many letters at least.
TERM_LETTERS = 3
#: Terms that a generalised one could be, at least.
CLASS_TERMS = 20
KINDS = ("email", "ip", "card", "phone", "term")

# The detectors' shapes are fixed values. A match starts where a run of its first class starts or where
# the last match ended, and classes that exclude what follows them are possessive: the same matches as
# plain greedy ones, in linear time and without recursion on very long runs.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def located(text: Column, pattern: Column) -> Column:
    """array<struct<start, end, found>> of the leftmost non-overlapping matches; code points, end exclusive."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    spot = "struct<start:int,end:int,found:string>"
    return F.aggregate(
        F.arrays_zip(between.alias("gap"), found.alias("found")),
        F.struct(F.lit(0).alias("at"), F.lit(None).cast(f"array<{spot}>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["found"])).alias("at"),
            F.array_append(
                F.coalesce(acc["out"], F.array().cast(f"array<{spot}>")),
                F.struct(
                    (acc["at"] + F.length(x["gap"])).alias("start"),
                    (acc["at"] + F.length(x["gap"]) + F.length(x["found"])).alias("end"),
                    x["found"].alias("found"),
                ),
            ).alias("out"),
        ),
        lambda acc: F.coalesce(acc["out"], F.array().cast(f"array<{spot}>")),
    )


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _card_ok(found: Column) -> Column:
    return F.length(_digits(found)).between(14, 19) & _luhn(_digits(found))


_DETECTORS = {
    "email": (_EMAIL, "@", lambda m: F.lit(True)),
    "ip": (_IP, r"[0-9]\.[0-9]", lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
    "card": (_CARD, r"[0-9][\x20-]?[0-9]", _card_ok),
    "phone": (_PHONE, r"\+[0-9]", lambda m: F.length(_digits(m)).between(10, 15)),
}
_SPAN = "struct<start:int,rank:int,end:int,kind:string,found:string>"


def _on_found(valid):
    return lambda x: valid(x["found"])


def _labelled(kind: str):
    rank = KINDS.index(kind)
    return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["found"].alias("found"))


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind, found>> of the base detectors, by start, then kind as listed."""
    arrays = []
    for kind, (pattern, hint, valid) in _DETECTORS.items():
        hits = F.filter(located(text, F.lit(pattern)), _on_found(valid))
        there = text.contains(hint) if hint == "@" else text.rlike(hint)
        arrays.append(F.when(there, F.transform(hits, _labelled(kind))).otherwise(F.array().cast(f"array<{_SPAN}>")))
    return F.array_sort(F.concat(*arrays))


def _terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), lambda w: F.length(w) >= TERM_LETTERS)


def _outside(text: Column, spans: Column) -> Column:
    """The text with a blank for each base span."""
    rest = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(" "))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def beginnings(term: Column) -> Column:
    """The proper beginnings of a term, shortest first."""
    return F.transform(F.sequence(F.lit(1), F.length(term) - 1), lambda n: F.substring(term, F.lit(1), n))


def generalised(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, shown) of terms (term): the longest beginning with a star that CLASS_TERMS terms of the vocabulary (term), all different, share;
    terms that share none stay out."""
    asked = terms.select("term", F.explode(beginnings(F.col("term"))).alias("begin"))
    common = vocabulary.select(F.explode(beginnings(F.col("term"))).alias("begin")).groupBy("begin").agg(F.count("*").alias("n")).where(F.col("n") >= CLASS_TERMS)
    longest = asked.join(common, "begin").groupBy("term").agg(F.max_by("begin", F.length("begin")).alias("begin"))
    return longest.select("term", F.concat("begin", F.lit("*")).alias("shown"))


def _protected(spans: Column) -> Column:
    """array<struct<entity, own>> of base spans: each value and the part of it that others share; own are the words of an address's local part."""

    def entities(s: Column) -> Column:
        value = F.lower(s["found"])
        words = F.filter(F.split(F.substring_index(value, "@", 1), r"[^\p{L}]+"), lambda w: F.length(w) >= TERM_LETTERS)
        part = F.when(s["kind"] == "email", F.substring_index(value, "@", -1)).when(s["kind"] == "ip", F.substring_index(value, ".", 2))
        part = part.when(s["kind"] == "card", F.left(_digits(value), F.lit(CARD_ISSUER))).otherwise(F.left(_digits(value), F.lit(PHONE_REGION)))
        own = F.when(s["kind"] == "email", words).otherwise(F.array().cast("array<string>"))
        none = F.array().cast("array<string>")
        return F.array(F.struct(F.concat_ws(":", s["kind"], value).alias("entity"), own.alias("own")), F.struct(F.concat_ws(":", s["kind"], F.lit("part"), part).alias("entity"), none.alias("own")))

    return F.array_distinct(F.flatten(F.transform(spans, entities)))


def disclosing_terms(rows: DataFrame) -> DataFrame | None:
    """(term, bits, shown) of the terms that reveal an entity of rows (_ink_text, _ink_base), as a cut table; shown stands in for the term.

    Counts cover all different texts. None if no text has an entity."""
    rows = rows.select(F.xxhash64("_ink_text").alias("h"), "_ink_text", "_ink_base")
    terms = _terms(_outside(F.col("_ink_text"), F.col("_ink_base")))
    held = cut(rows.where(F.size("_ink_base") > 0).select("h", terms.alias("terms"), _protected(F.col("_ink_base")).alias("entities")).dropDuplicates(["h"]), "held")
    if held.isEmpty():
        return None
    copies = cut(rows.groupBy("h").agg(F.count("*").alias("copies")).where(F.col("copies") > 1), "copies")
    n_texts = rows.count() - (copies.agg(F.sum(F.col("copies") - 1)).first()[0] or 0)
    n_entity = cut(held.select(F.explode(F.array_distinct(F.transform("entities", lambda e: e["entity"]))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity")), "entities")
    # No chance is high enough where even the commonest entity in all its texts is too little for a term's texts.
    most = n_entity.agg(F.max("n_entity")).first()[0]
    bound = (most + 1) * 2**GENERALISE_BITS
    words = join_sized(rows, copies, ["h"]).select(F.explode(terms).alias("term"), (1 / F.coalesce("copies", F.lit(1))).alias("weight"))
    n_term = words.groupBy("term").agg(F.round(F.sum("weight")).cast("bigint").alias("n_term"))
    n_term = cut(n_term.where(F.col("n_term") + DISCOUNT <= bound), "terms")

    own = join_sized(held.select("entities", F.explode("terms").alias("term")), n_term, ["term"], "inner")
    each = own.select("term", "n_term", F.explode("entities").alias("e")).select("term", "n_term", "e.entity", F.array_contains("e.own", F.col("term")).cast("int").alias("own"))
    pairs = each.groupBy("term", "n_term", "entity").agg(F.count("*").alias("n_both"), F.max("own").alias("own")).where(F.col("n_both") + F.col("own") >= LEAST_EVIDENCE)
    left = -F.log2((F.col("n_both") + F.col("own")) / (F.col("n_term") + F.col("own") + DISCOUNT))
    gain = -F.log2(F.col("n_entity") / F.lit(float(n_texts))) - F.col("bits")
    scored = join_sized(pairs.withColumn("bits", left).where(F.col("bits") <= GENERALISE_BITS), n_entity, ["entity"], "inner").where(gain >= LEAST_GAIN)
    found = cut(scored.groupBy("term").agg(F.min("bits").alias("bits")), "scored")
    classes = cut(generalised(found.where(F.col("bits") > REMOVE_BITS), n_term), "classes")
    shown = F.when(F.col("bits") <= REMOVE_BITS, "removed").otherwise(F.coalesce("shown", F.lit("word")))
    return cut(join_sized(found, classes, ["term"]).select("term", "bits", shown.alias("shown")), "disclosing")


def sanitise(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Find and replace personal data, and the terms that reveal it, in every whole text.

    Returns id_col, spans (array of start, rank, end, kind, found; code points, end exclusive, by start,
    then kind as in KINDS; term spans are added to the base ones) and sanitised (the text with base spans as
    "[kind]", removed terms as "[removed]", generalised ones as their beginning, like "[zan*]", or as "[word]" where none is common
    enough; overlaps become one replacement). A null text counts as empty; a very long one is judged whole. Repeated rows are
    treated alike; an empty table gives an empty result; other columns are not read."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("_ink_text")).withColumn("_ink_base", base_spans(F.col("_ink_text")))
    terms = disclosing_terms(rows)
    none = F.array().cast("array<struct<term:string,shown:string>>")
    if terms is None:
        rows = rows.withColumn("_ink_terms", none)
    else:
        words = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_ink_text")).select(F.xxhash64("_ink_text").alias("_ink_h"), F.explode(_terms(F.col("_ink_text"))).alias("term"))
        hits = join_sized(words, terms, ["term"], "inner").groupBy("_ink_h").agg(F.collect_set(F.struct("term", "shown")).alias("_ink_found"))
        rows = join_sized(rows.withColumn("_ink_h", F.xxhash64("_ink_text")), cut(hits, "hits"), ["_ink_h"]).withColumn("_ink_terms", F.coalesce("_ink_found", none))
    words = F.array_join(F.transform(F.array_sort("_ink_terms"), lambda x: x["term"]), "|")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), words, F.lit(r")(?!\p{L})"))
    extra = F.transform(located(F.col("_ink_text"), pattern), _labelled("term"))
    spans = F.when(F.size("_ink_terms") > 0, F.array_sort(F.concat("_ink_base", extra))).otherwise(F.col("_ink_base"))
    rows = rows.withColumn("spans", spans)
    shown = F.map_from_entries("_ink_terms")
    put = lambda s: F.concat(F.lit("["), F.when(s["kind"] != "term", s["kind"]).otherwise(F.coalesce(F.element_at(shown, F.lower(s["found"])), F.lit("word"))), F.lit("]"))
    body = F.col("_ink_text")
    clean = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), put(s))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))),
    )
    return rows.select(F.col(id_col), "spans", clean.alias("sanitised"))
