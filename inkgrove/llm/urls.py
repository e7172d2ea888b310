"""URL filter: host and path rules, and a character language-model ratio where no rule fits.

Two smoothed variable-order Markov models over bytes, one of URLs that rules allow and one of URLs that
rules block, give the mean log-likelihood ratio per byte of a URL. Contexts of whole bytes are counted
sparsely, so the models grow with the URLs: they stay tables, partitioned by gram and by context. Different URLs are
dealt to chunks; each chunk asks once for each of its grams, the answers are joined to it and its URLs scored. Where a
context is rare the models lean on ones over SYMBOLS classes of bytes, which no number of URLs makes larger: only these
pass through the driver. The threshold is calibrated on ruled URLs held out from the models; then these are counted in too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrove.plans.shared import cut, join_back, tune_arrow

#: The rules (host, path, verdict) are fixed values.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Letters (either case), one class for digits, common signs, one class for the rest, and the boundary.
_CLASSES = "abcdefghijklmnopqrstuvwxyz0.-/?=&%_:#~"
SYMBOLS = len(_CLASSES) + 2
ORDER = 3
#: Every FOLDS-th ruled URL, by hash, calibrates; the others train. Scores are binned in BINS over [-SPAN, SPAN] nats a character.
FOLDS, BINS, SPAN = 5, 4096, 8.0

#: Different URLs, and bytes of URLs, of a chunk on average.
CHUNK_URLS, CHUNK_BYTES = 1 << 14, 1 << 20
#: Models: of the ruled URLs that are not held out, blocked and allowed, and of all ruled ones, likewise.
_MODELS = ("t0", "t1", "f0", "f1")

_FOLD = np.full(256, len(_CLASSES), np.uint8)
for _i, _c in enumerate(_CLASSES):
    _FOLD[ord(_c)] = _FOLD[ord(_c.upper())] = _i
_FOLD[ord("0") : ord("9") + 1] = _CLASSES.index("0")
_EDGE = SYMBOLS - 1
#: Bits of a symbol in a gram of bytes; a symbol is a byte or the boundary. Classes of the symbols, and how many share each.
_BITS, _BOUND = 9, 256
_CLASS_OF = np.append(_FOLD, np.uint8(_EDGE)).astype(np.int64)
_SHARING = np.bincount(_CLASS_OF, minlength=SYMBOLS)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column) -> Column:
    """struct<rule, verdict> of the longest rule that fits, null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def byte_grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of ORDER + 1 bytes, _BITS bits each, at each byte and the closing boundary, and where each URL's begin."""
    before, after = np.full(ORDER, _BOUND, np.int64), np.full(1, _BOUND, np.int64)
    data = np.concatenate([x for u in urls for x in (before, np.frombuffer(u, np.uint8), after)])
    sizes = np.array([len(u) + ORDER + 1 for u in urls])
    grams = np.zeros(len(data), np.int64)
    for back in range(ORDER, -1, -1):
        grams <<= _BITS
        grams[ORDER:] += data[ORDER - back : len(data) - back]
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(len(data), bool)
    for k in range(ORDER):
        keep[starts + k] = False
    return grams[keep], starts - np.arange(len(urls)) * ORDER


def folded(grams: np.ndarray) -> np.ndarray:
    """The grams of classes of grams of bytes."""
    out = np.zeros(len(grams), np.int64)
    for back in range(ORDER, -1, -1):
        out = out * SYMBOLS + _CLASS_OF[(grams >> (_BITS * back)) & ((1 << _BITS) - 1)]
    return out


def class_chances(counts: np.ndarray) -> np.ndarray:
    """p(class | context) for every gram of classes.

    Orders are blended Witten-Bell fashion: a context trusts its own counts by n / (n + distinct) and leaves
    the rest to the next shorter context, down to the uniform distribution."""
    full = counts.reshape((SYMBOLS,) * (ORDER + 1)).astype(np.float64)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(ORDER + 1):
        own = full.sum(axis=tuple(range(ORDER - order)))
        n, kinds = own.sum(axis=-1, keepdims=True), (own > 0).sum(axis=-1, keepdims=True)
        p = (own + kinds * p) / np.maximum(n + kinds, 1) + (n == 0) * p
    return p.ravel()


class ClassModel:
    """p(byte | classes of the ORDER bytes before): p(class | context of classes) times p(byte | class), that leaning on a uniform one within the class."""

    def __init__(self, classes: np.ndarray, single: np.ndarray):
        self.classes = class_chances(classes).astype(np.float32)
        of_class, kinds = np.bincount(_CLASS_OF, weights=single), np.bincount(_CLASS_OF, weights=single > 0)
        known = (single + (kinds / _SHARING)[_CLASS_OF]) / np.maximum(of_class + kinds, 1)[_CLASS_OF]
        self.within = np.where(of_class[_CLASS_OF] > 0, known, 1 / _SHARING[_CLASS_OF])

    def logs(self, grams: np.ndarray, n: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """log p(byte | the ORDER bytes before) of grams, by their counts and the sums and numbers of counts of their contexts.

        A context trusts its own counts Witten-Bell fashion and leaves the rest to the classes."""
        p = self.classes[folded(grams)] * self.within[grams & ((1 << _BITS) - 1)]
        return np.log((n + kinds * p) / np.maximum(total + kinds, 1) + (total == 0) * p)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        label, held, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "held", "n"))
        grams, starts = byte_grams(batch.column("url").to_pylist())
        sizes = np.diff(np.append(starts, len(grams)))
        kinds, where = np.unique(grams, return_inverse=True)
        kept = {f"{m}{k}": np.where((label == k) & of, n, 0) for m, of in (("t", ~held.astype(bool)), ("f", True)) for k in (0, 1)}
        sums = (np.bincount(where, weights=np.repeat(kept[m], sizes)).astype(np.int64) for m in _MODELS)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), *map(pa.array, sums)], ["gram", *_MODELS])


def _of_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of counts by gram of classes, and by byte as -1 - byte."""
    for batch in batches:
        grams = batch.column("gram").to_numpy()
        keys, where = np.unique(np.concatenate([folded(grams), -1 - (grams & ((1 << _BITS) - 1))]), return_inverse=True)
        sums = (np.bincount(where, weights=np.tile(batch.column(m).to_numpy(), 2), minlength=len(keys)).astype(np.int64) for m in _MODELS)
        yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, sums)], ["key", *_MODELS])


def class_models(sums: pa.Table) -> dict[str, ClassModel]:
    """The models of classes that have any URLs, from the sums of _of_classes(): at most SYMBOLS ** (ORDER + 1) + 257 rows."""
    keys, out = sums.column("key").to_numpy(), {}
    for m in _MODELS:
        n = sums.column(m).to_numpy()
        if n.any():
            classes, single = np.zeros(SYMBOLS ** (ORDER + 1)), np.zeros(_BOUND + 1)
            classes[keys[keys >= 0]], single[-1 - keys[keys < 0]] = n[keys >= 0], n[keys < 0]
            out[m] = ClassModel(classes, single)
    return out


def _asked(chunk: pa.Table) -> pa.Table:
    grams = np.unique(byte_grams(chunk.column("url").to_pylist())[0])
    return pa.table({"chunk": np.full(len(grams), chunk.column("chunk")[0].as_py(), np.int64), "gram": grams})


def _scored(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """Mean log ratios per byte of a chunk's URLs, by the models without the held-out URLs and by those with them."""
    known = answers.column("gram").to_numpy()
    order = np.argsort(known)
    urls = chunk.column("url").to_pylist()
    grams, starts = byte_grams(urls) if urls else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    at, sizes = order[np.searchsorted(known, grams, sorter=order)], np.diff(np.append(starts, len(grams)))
    means = {c: np.add.reduceat(answers.column(c).to_numpy()[at], starts) / sizes if urls else np.zeros(0) for c in ("trained", "final")}
    return pa.table({**{c: chunk.column(c) for c in ("_ink_key", "n", "label", "held")}, **means})


def threshold_from(allowed: np.ndarray, blocked: np.ndarray) -> float:
    """The score below which to block: the bin edge where missed blocks plus false blocks, as shares, are fewest;
    the middle of the first stretch of such edges."""
    false_block = np.concatenate([[0], np.cumsum(allowed)]) / max(1, allowed.sum())
    missed = 1 - np.concatenate([[0], np.cumsum(blocked)]) / max(1, blocked.sum())
    errors = np.round(false_block + missed, 12)
    best = np.flatnonzero(errors == errors.min())
    stretch = best[: np.flatnonzero(np.diff(best, append=BINS + 9) > 1)[0] + 1]
    return float(stretch[len(stretch) // 2] / BINS * 2 * SPAN - SPAN)


def judge(pages: DataFrame, url: str = "url", id_col: str = "page_id") -> DataFrame:
    """id_col, host, path, rule, verdict (allow or block) and score of every page.

    The verdict is the longest fitting rule's; else the models': block if the score, by all ruled URLs, is under
    the threshold calibrated on the held-out ones (0 where the others are all of one kind). Null and empty URLs, and all unruled ones where either kind of ruled URL is missing, are
    allowed for want of evidence. Repeated URLs are scored once and judged alike, ties of a score with the threshold are allowed; an empty table gives an empty result;
    other columns are not read."""
    spark = pages.sparkSession
    tune_arrow(spark)
    read = pages.select(F.col(id_col).alias("_ink_id"), F.col(url).alias("_ink_url")).withColumn("host", host_of(F.col("_ink_url"))).withColumn("path", path_of(F.col("_ink_url")))
    read = read.withColumn("_ink_rule", rule_of(F.col("host"), F.col("path"))).withColumn("_ink_key", F.when(F.col("_ink_url") != "", F.unhex(F.sha2("_ink_url", 256))))
    rows = cut(read.select("_ink_id", "host", "path", F.col("_ink_rule.rule").alias("rule"), F.col("_ink_rule.verdict").alias("own"), "_ink_key"), "url-rows")
    each = cut(read.where("_ink_key is not null").groupBy("_ink_key").agg(
        F.first(F.col("_ink_url").cast("binary")).alias("url"), F.count("*").alias("n"),
        F.max((F.col("_ink_rule.verdict") == "allow").cast("int")).alias("label"), F.max(F.pmod(F.xxhash64("_ink_url"), F.lit(FOLDS)) == 0).alias("held")), "url-each")
    size = each.agg(F.count("*").alias("urls"), F.sum(F.length("url")).alias("bytes"), F.sum("n").alias("rows")).first()
    chunks = max(1, math.ceil(size.urls / CHUNK_URLS), math.ceil((size.bytes or 0) / CHUNK_BYTES))
    dealt = each.withColumn("chunk", F.pmod(F.xxhash64("_ink_key"), F.lit(chunks)))

    ruled = each.where("label is not null").select("label", "held", "n", "url")
    grams = cut(ruled.mapInArrow(_count, "gram bigint, " + ", ".join(f"{m} bigint" for m in _MODELS)).groupBy("gram").agg(*(F.sum(m).alias(m) for m in _MODELS)), "url-grams")
    context = F.shiftright("gram", _BITS)
    contexts = cut(grams.groupBy(context.alias("context")).agg(*(F.sum(m).alias(f"total_{m}") for m in _MODELS), *(F.sum((F.col(m) > 0).cast("long")).alias(f"kinds_{m}") for m in _MODELS)), "url-contexts")
    classes = class_models(grams.mapInArrow(_of_classes, "key bigint, " + ", ".join(f"{m} bigint" for m in _MODELS)).groupBy("key").agg(*(F.sum(m).alias(m) for m in _MODELS)).toArrow())
    if not {"f0", "f1"} <= {*classes}:
        return rows.select(F.col("_ink_id").alias(id_col), "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    of_classes = spark.sparkContext.broadcast(classes)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = of_classes.value
        for batch in batches:
            of = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            logs = {m: models[m].logs(of["gram"], of[m], of[f"total_{m}"], of[f"kinds_{m}"]) for m in models}
            ratios = (logs[f"{x}1"] - logs[f"{x}0"] if {f"{x}0", f"{x}1"} <= {*logs} else np.zeros(batch.num_rows) for x in "tf")
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("gram"), *map(pa.array, ratios)], ["chunk", "gram", "trained", "final"])

    asked = dealt.select("chunk", "url").groupBy("chunk").applyInArrow(_asked, "chunk bigint, gram bigint")
    found = asked.join(grams, "gram", "left").withColumn("context", context).join(contexts, "context", "left").drop("context").na.fill(0)
    answers = found.mapInArrow(answer, "chunk bigint, gram bigint, trained double, final double")
    scored = cut(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored, "_ink_key binary, n bigint, label int, held boolean, trained double, final double"), "url-scores")
    of_classes.destroy()
    cut_at = 0.0
    if {"t0", "t1"} <= {*classes}:
        held = np.zeros((2, BINS))
        place = F.least(F.greatest(F.floor((F.col("trained") + SPAN) / (2 * SPAN) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
        for r in scored.where("held and label is not null").groupBy("label", place.alias("bin")).agg(F.sum("n").alias("n")).collect():
            held[r.label, r.bin] = r.n
        cut_at = threshold_from(held[1], held[0])
    judged = join_back(rows, scored.select("_ink_key", "n", "final"), ["_ink_key"], "n", size.rows or 0)
    verdict = F.coalesce("own", F.when(F.col("final") < cut_at, "block").otherwise("allow"))
    return judged.select(F.col("_ink_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.coalesce("final", F.lit(0.0)).alias("score"))
