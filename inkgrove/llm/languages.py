"""Language identification by prediction by partial matching (PPM).

For each language a variable-order context tree over bytes is fitted on a bounded sample of
labelled texts. Its statistics are then frozen, so the code length of a byte after its context is a
pure function of the last ORDER + 1 bytes: every such gram seen in training has its exact code
length under each language in one table, unseen grams pay the escape of their context and
fall back to the next shorter order. Code lengths are integers (1/1024 bit), so a document's sum
does not depend on how its bytes are split. Escapes follow method C (escape count = distinct
successors), without exclusion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrove.llm.vocab import forget_encoders
from inkgrove.llm.worker import frugal
from inkgrove.plans.shared import tune_arrow

#: Bytes of context at most.
ORDER = 4
#: The bound of the training sample: texts of a language, bytes of a text, languages (the most frequent ones).
TEXTS_PER_LANGUAGE, TEXT_BYTES, MAX_LANGUAGES = 256, 1 << 16, 256
#: Code lengths are counted in 1/UNIT bits.
UNIT = 1024
UNDETERMINED = "und"
#: Bytes scored at once.
STEP = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


class GramTable:
    """Open-addressed map from uint64 grams to row numbers, probed for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.rounds = 0
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            at = self._slot(keys[left], self.rounds)
            free = self.slots[at] < 0
            _, first = np.unique(at[free], return_index=True)
            won = left[free][first]
            self.slots[at[free][first]] = won
            self.keys[at[free][first]] = keys[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            self.rounds += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        start = (keys * _MIX) >> np.uint64(64 - self.bits)
        return (start.astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 where absent."""
        at = self._slot(keys, 0)
        out = np.where(self.keys[at] == keys, self.slots[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.slots[at] >= 0))
        for probe in range(1, self.rounds):
            if not len(open_):
                break
            at = self._slot(keys[open_], probe)
            rows = np.where(self.keys[at] == keys[open_], self.slots[at], -1)
            out[open_] = rows
            open_ = open_[(rows < 0) & (self.slots[at] >= 0)]
        return out


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """The last order + 1 bytes at each position from order on, newest byte lowest."""
    wide = data.astype(np.uint64)
    out = wide[order:].copy()
    for back in range(1, order + 1):
        out |= wide[order - back : len(wide) - back] << np.uint64(8 * back)
    return out


class PpmModel:
    """Frozen context trees of several languages."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        pad = bytes(ORDER)
        joined = [np.frombuffer(pad + pad.join(texts[x]), np.uint8) for x in self.languages]
        lengths = [np.array([len(t) for t in texts[x]]) for x in self.languages]
        inside = []
        for data, sizes in zip(joined, lengths):
            keep = np.ones(len(data) - ORDER, bool)
            for start in np.cumsum(sizes + ORDER)[:-1] - ORDER:
                keep[start : start + ORDER] = False
            inside.append(keep)
        n_lang = len(self.languages)
        self.tables, self.costs, self.context_tables, self.escapes = [], [], [], []
        lower_costs = np.full((256, n_lang), 8.0)
        for order in range(ORDER + 1):
            counted = [np.unique(grams(d, order)[ORDER - order :][k], return_counts=True) for d, k in zip(joined, inside)]
            keys = np.unique(np.concatenate([c[0] for c in counted])) if order else np.arange(256, dtype=np.uint64)
            contexts = np.unique(keys >> np.uint64(8))
            counts = np.zeros((len(keys), n_lang))
            for i, (found, n) in enumerate(counted):
                counts[np.searchsorted(keys, found), i] = n
            of = np.searchsorted(contexts, keys >> np.uint64(8))
            totals, distinct = np.zeros((len(contexts), n_lang)), np.zeros((len(contexts), n_lang))
            np.add.at(totals, of, counts)
            np.add.at(distinct, of, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(totals > 0, -np.log2(distinct / (totals + distinct)), 0.0)
                own = -np.log2(counts / (totals + distinct)[of])
            if order:
                mask = np.uint64((1 << (8 * order)) - 1)
                below = lower_costs[self._rows(order - 1, keys & mask)]
            else:
                below = lower_costs
            cost = np.where(counts > 0, own, escape[of] + below)
            self.tables.append(GramTable(keys) if order else None)
            self.costs.append(np.round(cost * UNIT).astype(np.int32))
            self.context_tables.append(GramTable(contexts) if order else None)
            self.escapes.append(np.round(escape * UNIT).astype(np.int32))
            lower_costs = cost

    def _rows(self, order: int, keys: np.ndarray) -> np.ndarray:
        return keys.astype(np.int64) if order == 0 else self.tables[order].find(keys)

    def _lengths(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Code length of each gram under each language."""
        rows = self._rows(order, keys)
        out = self.costs[order][rows]
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            unseen = keys[missing]
            fallen = self._lengths(unseen & np.uint64((1 << (8 * order)) - 1), order - 1)
            contexts = self.context_tables[order].find(unseen >> np.uint64(8))
            out[missing] = fallen + np.where((contexts >= 0)[:, None], self.escapes[order][contexts], 0)
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """1/UNIT bits of each whole text under each language."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        pad = bytes(ORDER)
        held, owners, size = [], [], 0

        def flush() -> None:
            nonlocal held, owners, size
            if not held:
                return
            data = np.frombuffer(b"".join(held), np.uint8)
            lengths = self._lengths(grams(data, ORDER), ORDER)
            ends = np.cumsum([len(x) for x in held])
            starts = ends - np.array([len(x) for x in held])
            bounds = np.empty(2 * len(held), np.int64)
            bounds[0::2], bounds[1::2] = starts, ends - ORDER
            bounds = bounds[:-1]  # the last piece ends with the data
            sums = np.add.reduceat(lengths, bounds, axis=0, dtype=np.int64)[0::2]
            np.add.at(out, owners, sums)
            held, owners, size = [], [], 0

        for i, text in enumerate(texts):
            for at in range(0, len(text), STEP):
                before = text[max(0, at - ORDER) : at] if at else pad
                held.append(before + text[at : at + STEP])
                owners.append(i)
                size += len(held[-1])
                if size >= STEP:
                    flush()
        flush()
        return out


def training_sample(docs: DataFrame, text: str = "text", label: str = "lang") -> dict[str, list[bytes]]:
    """Up to TEXTS_PER_LANGUAGE different texts of each of the MAX_LANGUAGES most frequent labels, chosen by hash so that copies count once.

    Short texts come first; of texts over TEXT_BYTES only as many characters are learned from. Candidates are those under a
    bound on the hash that lets four times as many through as are needed, so no task meets a whole language."""
    rows = docs.select(F.col(label).alias("lang"), F.col(text).alias("text")).where("lang is not null and length(text) > 0")
    rows = rows.withColumn("long", F.octet_length("text") > TEXT_BYTES).withColumn("h", F.xxhash64("text"))
    kinds = rows.groupBy("lang", "long").agg(F.approx_count_distinct("h").alias("kinds"), F.count("*").alias("n"))
    labels = kinds.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    bounds = kinds.join(labels.select("lang"), "lang").select("lang", "long", "kinds")  # at most 2 * MAX_LANGUAGES rows
    let_through = F.col("h") / float(1 << 64) + 0.5 <= 4.0 * TEXTS_PER_LANGUAGE / F.col("kinds")
    candidates = rows.join(F.broadcast(bounds), ["lang", "long"]).where(let_through).select("lang", "long", "h")
    order = Window.partitionBy("lang").orderBy("long", "h")
    picked = candidates.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= TEXTS_PER_LANGUAGE).drop("r")
    sample = rows.join(F.broadcast(picked), ["lang", "long", "h"]).groupBy("lang", "long", "h").agg(F.first(F.substring("text", 1, TEXT_BYTES)).alias("text"))
    out: dict[str, list[bytes]] = {}
    for row in sample.orderBy("lang", "long", "h").toLocalIterator():  # at most MAX_LANGUAGES * TEXTS_PER_LANGUAGE rows
        out.setdefault(row.lang, []).append(row.text.encode())
    return out


def identify(docs: DataFrame, train: Column | None = None, text: str = "text", label: str = "lang", id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Predict the language of every whole text.

    Returns id_col, the columns named in carry, lang_pred (a learned label, or "und" where the text is
    null, has no letter, or nothing could be learned), score (probability of that language among the
    learned ones, 0 for "und") and bits_per_byte (code length under it, null for "und").
    train limits the rows that may be learned from; only text and label of those are used. Equal code
    lengths go to the alphabetically first label. Repeated rows are predicted alike; very long texts are coded whole, in steps;
    an empty table gives an empty result; other columns, whatever their names, are not touched."""
    spark = docs.sparkSession
    tune_arrow(spark)
    texts = training_sample(docs if train is None else docs.where(train), text, label)
    model = spark.sparkContext.broadcast(PpmModel(texts)) if texts else None
    body = F.col(text)
    rows = docs.select(F.col(id_col), *carry, F.when(body.rlike(r"\p{L}"), body).cast("binary").alias("_ink_body"))
    kept = [f for f in rows.schema.fields if f.name != "_ink_body"]
    found = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column("_ink_body").to_pylist()
            there = [i for i, x in enumerate(bodies) if x] if model else []
            lang, score, rate = [UNDETERMINED] * len(bodies), np.zeros(len(bodies)), [None] * len(bodies)
            if there:
                lengths = model.value.code_lengths([bodies[i] for i in there])
                best = lengths.argmin(axis=1)
                least = lengths[np.arange(len(there)), best]
                share = 1 / np.exp2(np.maximum((least[:, None] - lengths) / UNIT, -1000.0)).sum(axis=1)
                for k, i in enumerate(there):
                    lang[i], score[i], rate[i] = model.value.languages[best[k]], share[k], least[k] / UNIT / len(bodies[i])
            columns = [batch.column(f.name) for f in kept] + [pa.array(lang, pa.string()), pa.array(score), pa.array(rate, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + ["lang_pred", "score", "bits_per_byte"])

    return rows.mapInArrow(frugal(predict, forget_encoders), T.StructType([*kept, *found]))


#: A document stays if its language is determined with at least this probability.
MIN_SCORE = 0.5


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is determined; undetermined and ambiguous ones go. Columns stay as they are."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_ink_row"), "text", "lang")
    found = identify(whole, id_col="_ink_row")
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select("_ink_row.*")
