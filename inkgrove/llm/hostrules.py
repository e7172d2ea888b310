"""Host-level quality rules.

Each document is held against fixed rules. Failures are then summed per host, and a host's failure rate is
shrunk towards all hosts' by a beta prior fitted to the corpus (by moments): hosts with few documents
lean on the prior, large ones on their own record. The limit is calibrated by the prior too: a host is rejected if its
shrunken rate lies DEVIATIONS standard deviations of the prior above its mean and is EXCESS times that mean at least, or if it
passes HOST_LIMIT in any case. The verdict is joined back to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrove.plans.shared import BROADCAST_ROWS, cut, join_back, tune_arrow

SIGNS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50
#: Rules of the host record besides the base ones: signs per 100 words, repeated lines per 100 lines, mean characters of a word.
MAX_SIGNS, MAX_DUP_LINES, WORD_CHARS = 20, 30, (2, 15)
#: What a host's rate must pass: standard deviations of the prior above its mean, and multiples of that mean.
DEVIATIONS, EXCESS, HOST_LIMIT = 3.0, 2.0, 0.5
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    """The counts named in _COUNTS of one UTF-8 text. bytes.split() cuts at space and \\t to \\r only."""
    words = text.split()
    n = len(words)
    chars = sum(map(len, words)) - (0 if text.isascii() else sum(0x80 <= b < 0xC0 for b in text))
    signs = sum(map(text.count, (SIGNS[i : i + 1] for i in range(len(SIGNS)))))
    full = [x for x in text.split(b"\n") if not (x.isspace() or not x)]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen: dict[tuple, int] = {}
            covered = bytearray(n)
            for i, w in enumerate(windows):
                first = seen.setdefault(w, i)
                if first != i:
                    covered[first : first + 3] = covered[i : i + 3] = b"\1\1\1"
            repeated = sum(covered)
    return n, chars, signs, len(full), len(full) - len(set(full)), repeated


def measured(rows: DataFrame, body: str) -> DataFrame:
    """rows without the binary column body, and with the counts of it; null counts as empty."""
    tune_arrow(rows.sparkSession)
    kept = [f for f in rows.schema.fields if f.name != body]
    names = [*(f.name for f in kept), *_COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(x or b"") for x in batch.column(body).to_pylist()]
            counts = [pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * len(_COUNTS)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *counts], names)

    return rows.mapInArrow(run, T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in _COUNTS)]))


def quality(docs: DataFrame, text: str = "text", host: str = "source", id_col: str = "doc_id") -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, host_limit, kept of every document.

    base_failed: fewer than MIN_WORDS words, or over MAX_REPEATED in 100 words lie in repeated 3-word windows.
    kept: neither base_failed nor from a rejected host; rows with a null host form one host. A null text has
    no words. Repeated rows count each; a very long text is held with its words in memory, one text at a time; an empty
    table gives an empty result; other columns are not read."""
    name = F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_ink_id"), name.alias("_ink_host"), F.col(text).cast("binary").alias("_ink_body"))
    found = cut(measured(rows, "_ink_body").withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))), "measured")
    more = (100 * F.col("n_symbols") > MAX_SIGNS * F.col("n_words")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"))
    odd = ~F.col("word_chars").between(WORD_CHARS[0] * F.col("n_words"), WORD_CHARS[1] * F.col("n_words"))
    hosts = cut(found.groupBy("_ink_host").agg(F.count("*").alias("n"), F.count_if(F.col("base_failed") | more | odd).alias("failed")), "hosts")
    n, k = F.col("n").cast("double"), F.col("failed").cast("double")
    sums = hosts.agg(F.count("*").alias("hosts"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(k * k / n).alias("kk"), F.sum(n * n).alias("nn")).first()
    total = sums["n"] or 0.0
    alpha, beta = prior(sums["hosts"], total, sums["k"] or 0.0, sums["kk"] or 0.0, sums["nn"] or 0.0)
    shrunk = (F.col("failed") + alpha) / (F.col("n") + alpha + beta)
    rates = hosts.select("_ink_host", F.col("n").alias("_ink_n"), shrunk.alias("host_rate"))
    out = found.join(F.broadcast(rates), "_ink_host", "left") if sums["hosts"] <= BROADCAST_ROWS else join_back(found, rates, ["_ink_host"], "_ink_n", int(total))
    most = limit(alpha, beta)
    return out.select(F.col("_ink_id").alias(id_col), *[c for c in _COUNTS if c != "n_lines"], "base_failed", "host_rate", F.lit(most).alias("host_limit"), (~F.col("base_failed") & (F.col("host_rate") <= most)).alias("kept"))


def limit(alpha: float, beta: float) -> float:
    """The shrunken rate up to which a host stays, by the prior's mean and standard deviation."""
    mean, weight = alpha / (alpha + beta), alpha + beta
    return min(HOST_LIMIT, max(mean + DEVIATIONS * (mean * (1 - mean) / (weight + 1)) ** 0.5, EXCESS * mean))


def prior(hosts: int, n: float, k: float, kk: float, nn: float) -> tuple[float, float]:
    """Beta parameters from sums over hosts: documents n, failures k, k * k / n and n * n.

    The mean is the overall rate; the variance between hosts is what their rates, weighted by documents, vary beyond what
    sampling alone explains. Where they vary no more than that, the prior weighs 1000 documents."""
    if not n:
        return 1.0, 1.0
    mean = k / n
    spread = mean * (1 - mean)
    room = n - nn / n
    between = (kk - mean * mean * n - (hosts - 1) * spread) / room if room > 0 else 0.0
    weight = min(1000.0, max(2.0, spread / between - 1)) if between > 0 else 1000.0
    return max(1e-3, mean * weight), max(1e-3, (1 - mean) * weight)
