"""A static embedder: tokens look their vectors up, a text's vector is their mean of length one. Whole words meet a table of any size by joins, or by their
numbers, slice by slice; pieces of words, cut by the longest match, meet a model that every task holds."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrove.functions.scalars import dot, tokens
from inkgrove.plans.shared import cut, cut_bytes, join_sized, tune_arrow


def profile_id(model: str, dims: int, revision: str = "") -> str:
    """A name for vectors that can be compared: those of one model, revision and number of dimensions."""
    return hashlib.sha256(f"{model}|{revision}|{dims}".encode()).hexdigest()[:16]


def embed(texts: DataFrame, vocabulary: DataFrame, dims: int, key: str = "id", text: str = "text") -> DataFrame:
    """(key, vector, known) of every text: the mean of the vectors of its tokens that vocabulary (term, vector), a cut table, holds, scaled to
    length one, and how many these are. A text without such tokens, or null, has the zero vector.

    A text's tokens are counted before they meet the vocabulary, which is broadcast if it is small; sums combine map-side."""
    counted = texts.select(key, F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    met = join_sized(counted, vocabulary, ["term"], "inner")
    sums = [F.sum(F.col("vector")[i].cast("double") * F.col("n")).alias(f"_{i}") for i in range(dims)]
    return _scaled(texts, met.groupBy(key).agg(F.sum("n").alias("known"), *sums), dims, key)


#: Bytes of vectors that meet a chunk of texts at once, characters of texts for each such slice, and the characters below which a chunk is not parted for more tasks.
SLICE_BYTES, SLICE_CHARS, LEAST_CHARS = 64 << 20, 96_000_000, 16_000_000


def embed_numbered(texts: DataFrame, vectors: DataFrame, dims: int, number_of: Callable[[list[str]], list[int]], key: str = "id", text: str = "text") -> DataFrame:
    """(key, vector, known) of every text as embed() gives them, where a token's vector is the row of vectors (vec_id, vector) whose number number_of, a
    function of a list of tokens, tells; a number that vectors does not have is an unknown token.

    No table of all tokens is made. Texts become lists of numbers with their counts, dealt to chunks; vectors are dealt to slices, and each pair of a chunk and a slice
    is added up by itself, so neither has to fit in a task. A slice is sent to each chunk, a text's sums come from each slice: both grow with the input, slowly, by
    SLICE_CHARS and SLICE_BYTES."""
    spark = texts.sparkSession
    tune_arrow(spark)
    chars, held, cores = texts.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0], vectors.count(), spark.sparkContext.defaultParallelism
    element = vectors.schema["vector"].dataType.elementType.simpleString()
    slices = max(1, math.ceil(held * dims * (4 if element == "float" else 8) / SLICE_BYTES))
    chunks = max(1, math.ceil(chars / (SLICE_CHARS * slices)), min(2 * cores, chars // LEAST_CHARS))
    chunk = F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int").alias("_chunk")
    kind = texts.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, part, number, n = _counts(batch.column("_words"), number_of, slices)
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (part[1:] != part[:-1]))) if len(row) else np.empty(0, np.int64)
            offsets = pa.array(np.append(first, len(row)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_chunk").take(pa.array(row[first])), pa.array(part[first].astype(np.int32)), batch.column(key).take(pa.array(row[first])), pa.ListArray.from_arrays(offsets, pa.array(number)), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32)))],
                ["_chunk", "_slice", key, "_numbers", "_n"],
            )

    words = texts.select(chunk, F.col(key), tokens(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
    counted = words.mapInArrow(count, f"_chunk int, _slice int, `{key}` {kind}, _numbers array<bigint>, _n array<int>")
    filled = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.get("vector", i), F.lit(0).cast(element))).alias("_vector")
    known = vectors.where("vec_id is not null").select(F.col("vec_id").cast("bigint").alias("_number"), filled)
    dealt = known.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_chunk"), F.pmod("_number", F.lit(slices)).cast("int").alias("_slice"), "_number", "_vector")

    def add(found: pa.Table, model: pa.Table) -> pa.Table:
        return _added(found, model, dims, key)

    cells = counted.groupBy("_chunk", "_slice").cogroup(dealt.groupBy("_chunk", "_slice")).applyInArrow(add, f"`{key}` {kind}, _known bigint, _sum array<double>")
    sums = cells.groupBy(key).agg(F.sum("_known").alias("known"), *[F.sum(F.col("_sum")[i]).alias(f"_{i}") for i in range(dims)])
    return _scaled(texts, sums, dims, key)


def _scaled(texts: DataFrame, sums: DataFrame, dims: int, key: str) -> DataFrame:
    """(key, vector, known) of texts from sums (key, known, _0, _1 and so on)."""
    sized = F.sqrt(sum((F.col(f"_{i}") * F.col(f"_{i}") for i in range(dims)), F.lit(0.0)))
    scaled = sums.withColumn("_size", sized).select(key, "known", F.array(*[F.when(F.col("_size") > 0, F.col(f"_{i}") / F.col("_size")).otherwise(0.0) for i in range(dims)]).alias("vector"))
    zero = F.array_repeat(F.lit(0.0), dims)
    return texts.select(key).join(scaled, key, "left").select(key, F.coalesce("vector", zero).alias("vector"), F.coalesce("known", F.lit(0)).alias("known"))


def _counts(words: pa.ListArray, number_of: Callable[[list[str]], list[int]], slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, slice, number, count) of the words of each row, in this order; every different word is numbered once a batch."""
    coded = pc.dictionary_encode(words.flatten())
    numbers = np.array(number_of(coded.dictionary.to_pylist()), np.int64)[coded.indices.to_numpy()]
    row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
    part = numbers % slices
    order = np.lexsort((numbers, part, row))
    row, part, numbers = row[order], part[order], numbers[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (numbers[1:] != numbers[:-1]))) if len(row) else np.empty(0, np.int64)
    return row[first], part[first], numbers[first], np.diff(np.append(first, len(row)))


def _added(found: pa.Table, model: pa.Table, dims: int, key: str) -> pa.Table:
    """(key, _known, _sum) of each row of found (_numbers, _n): its numbers' vectors in model (_number, _vector) by their counts."""
    numbers, where = np.unique(model.column("_number").to_numpy(), return_inverse=True)
    flat = [c.flatten().to_numpy().reshape(-1, dims) for c in model.column("_vector").chunks if len(c)]
    matrix, copies = np.concatenate(flat) if flat else np.zeros((0, dims)), np.bincount(where, minlength=len(numbers))
    if len(numbers) < len(matrix):  # a number's rows add up, as in a join
        matrix, each = np.zeros((len(numbers), dims)), matrix
        np.add.at(matrix, where, each)
    else:
        matrix = matrix[np.argsort(where)]
    keys, knowns, sums = [], [], []
    for batch in found.to_batches() if len(numbers) else []:
        asked, n = batch.column("_numbers"), batch.column("_n").flatten().to_numpy()
        row = np.repeat(np.arange(len(asked)), pc.list_value_length(asked).to_numpy(zero_copy_only=False).astype(np.int64))
        asked = asked.flatten().to_numpy()
        at = np.minimum(np.searchsorted(numbers, asked), len(numbers) - 1)
        there = numbers[at] == asked
        row, at, n = row[there], at[there], n[there]
        total, known = np.zeros((batch.num_rows, dims)), np.zeros(batch.num_rows, np.int64)
        np.add.at(known, row, n * copies[at])
        for i in range(0, len(row), ROWS_AT_ONCE):  # bounded memory for a very long text
            part = slice(i, i + ROWS_AT_ONCE)
            first = np.flatnonzero(np.append(True, row[part][1:] != row[part][:-1]))
            total[row[part][first]] += np.add.reduceat(matrix[at[part]] * n[part][:, None].astype(np.float64), first, axis=0)
        met = np.flatnonzero(known)
        keys.append(batch.column(key).take(pa.array(met)))
        knowns.append(known[met])
        sums.append(total[met].ravel())
    kind, many = found.schema.field(key).type, sum(len(k) for k in knowns)
    values = pa.array(np.concatenate(sums) if sums else np.empty(0))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(many + 1) * dims, pa.int32()), values)
    return pa.table([pa.chunked_array(keys, kind), pa.array(np.concatenate(knowns) if knowns else np.empty(0, np.int64)), lists], [key, "_known", "_sum"])


#: Pieces of a vocabulary, which every task holds, at most.
MAX_PIECES = 1 << 20
#: Before a piece that goes on within a word.
GOES_ON = "##"


def held_pieces(vocabulary: DataFrame) -> list[str]:
    """The pieces of a vocabulary (piece), sorted; a piece's place is its id. ValueError beyond MAX_PIECES."""
    rows = vocabulary.select("piece").where("piece is not null").distinct().orderBy("piece").limit(MAX_PIECES + 1).collect()
    if len(rows) > MAX_PIECES:
        raise ValueError(f"a vocabulary has {MAX_PIECES} pieces at most")
    return [r.piece for r in rows]


def _tries(pieces: list[str]) -> tuple[dict, dict]:
    """Pieces at the beginning of words and those within, each as nested dictionaries by character; the id stands under the empty string."""
    roots: tuple[dict, dict] = ({}, {})
    for number, piece in enumerate(pieces):
        inner = piece.startswith(GOES_ON)
        node = roots[inner]
        for c in piece[len(GOES_ON) * inner :]:
            node = node.setdefault(c, {})
        node[""] = number
    return roots


def _cut_word(word: str, tries: tuple[dict, dict]) -> list[int]:
    """Ids of the longest piece at each place; a word that cannot be cut to its end is one unknown, -1."""
    out, at = [], 0
    while at < len(word):
        node, end, found = tries[at > 0], at, None
        for i in range(at, len(word)):
            node = node.get(word[i])
            if node is None:
                break
            if "" in node:
                found, end = node[""], i + 1
        if found is None or end == at:
            return [-1]
        out.append(found)
        at = end
    return out


def _cut_words(words: pa.ListArray, tries: tuple[dict, dict]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many of each row); every different word is cut once a batch."""
    coded = pc.dictionary_encode(words.flatten())
    cuts = [_cut_word(w, tries) for w in coded.dictionary.to_pylist()]
    sizes = np.array([len(c) for c in cuts], np.int64)
    starts = np.cumsum(sizes) - sizes
    ids = np.array([i for c in cuts for i in c], np.int32)
    codes = coded.indices.to_numpy()
    each = sizes[codes]
    within = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    per_row = np.add.reduceat(np.append(each, 0), np.minimum(words.offsets.to_numpy()[:-1] - words.offsets[0].as_py(), len(each))) if len(words) else each
    per_row = np.where(pc.list_value_length(words).to_numpy(zero_copy_only=False) > 0, per_row, 0)
    return ids[np.repeat(starts[codes], each) + within], per_row


def _asked(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.select(F.col(key), tokens(F.coalesce(F.col(text), F.lit(""))).alias("_words"))


def subword_ids(texts: DataFrame, pieces: list[str], key: str = "id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every text: its words cut into the longest pieces of a vocabulary from the left, an unknown word as -1.

    Pieces are held in every task, MAX_PIECES at most. A null or empty text has no ids."""
    shared = texts.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = _tries(shared.value)
        for batch in batches:
            ids, sizes = _cut_words(batch.column("_words"), tries)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], [key, "ids"])

    return _asked(texts, key, text).mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, ids array<int>")


def embed_subwords(texts: DataFrame, vocabulary: DataFrame, dims: int, key: str = "id", text: str = "text") -> DataFrame:
    """(key, vector, known, seen) of every text in one pass: the mean of its pieces' vectors, scaled to length one; known pieces and all, an unknown word being one.

    vocabulary (piece, vector) is a cut table of MODEL_BYTES at most, or ValueError: a static model's table of vectors does not grow with the texts.
    A text without known pieces, or null, has the zero vector."""
    if cut_bytes(vocabulary) > MODEL_BYTES:
        raise ValueError(f"a model of {MODEL_BYTES} bytes at most is held in every task")
    pieces = held_pieces(vocabulary)
    rows = {r.piece: r.vector for r in vocabulary.where("piece is not null").groupBy("piece").agg(F.min("vector").alias("vector")).collect()}
    shared = texts.sparkSession.sparkContext.broadcast((pieces, np.array([rows[p] for p in pieces], np.float64).reshape(len(pieces), dims)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, (_, matrix) = _tries(shared.value[0]), shared.value
        for batch in batches:
            ids, sizes = _cut_words(batch.column("_words"), tries)
            row = np.repeat(np.arange(len(sizes)), sizes)
            there = ids >= 0
            known = np.bincount(row[there], minlength=len(sizes))
            total = np.zeros((len(sizes), dims))
            for i in range(0, len(ids), ROWS_AT_ONCE):  # bounded memory for a very long text
                part = slice(i, i + ROWS_AT_ONCE)
                np.add.at(total, row[part][there[part]], matrix[ids[part][there[part]]])
            size = np.sqrt((total * total).sum(axis=1))
            vector = np.divide(total, size[:, None], out=np.zeros_like(total), where=size[:, None] > 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * dims, pa.int32()), pa.array(vector.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(known.astype(np.int64)), pa.array(sizes.astype(np.int64))], [key, "vector", "known", "seen"])

    return _asked(texts, key, text).mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, vector array<double>, known bigint, seen bigint")


#: A model in every task, and vectors added up at once.
MODEL_BYTES, ROWS_AT_ONCE = 512 << 20, 1 << 14


def usable(vectors: DataFrame, profile: str) -> tuple[DataFrame, DataFrame]:
    """(vectors of the profile, one row (other, missing) with the number of those of other profiles and of those without one).

    Vectors of different profiles are never compared: after a change of model only new ones count."""
    others = vectors.agg(F.count_if(F.col("profile") != profile).alias("other"), F.count_if(F.col("profile").isNull()).alias("missing"))
    return vectors.where(F.col("profile") == profile), others


def needs_vectors(blocks: DataFrame, vectors: DataFrame, profile: str) -> DataFrame:
    """Blocks (citation) without a vector of the profile: what is to be embedded after an upsert or a change of model."""
    return blocks.join(vectors.where(F.col("profile") == profile).select("citation"), "citation", "left_anti")


def vocabulary_of(texts: DataFrame, vectors: DataFrame, vector_of: Column, text: str = "text") -> DataFrame:
    """(term, vector), a cut table: every different token of the texts that vector_of, an expression on term, gives the vec_id of a row of vectors (vec_id, vector)."""
    terms = texts.select(F.explode(tokens(F.col(text))).alias("term")).distinct().withColumn("vec_id", vector_of)
    return cut(terms.join(vectors.select("vec_id", "vector"), "vec_id").select("term", "vector"), "vocabulary")


def similarity(a: Column, b: Column) -> Column:
    """Cosine of vectors made by embed(), which have length one or are zero."""
    return dot(a, b)
