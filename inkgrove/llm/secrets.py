"""Secrets in texts: fixed shapes, and formats inferred from the credentials those find.

The base detectors label credentials. Of each kind a bounded sample becomes a prefix tree, whose states are merged where
their onward symbols are statistically compatible (by the Hoeffding bound): what remains is a probabilistic automaton, in
which a fixed beginning stays a chain of states and a random part becomes a loop. The corpus' words and numbers get automata in the same way.
Every run in the corpus is then scored: it is a secret if it has the format of a credential (no more bits a symbol than the labelled ones need)
and the best credential automaton explains it EVIDENCE_BITS better than words, numbers and signs in a row do.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.plans.shared import cut, tune_arrow

LABELLED, ORDINARY = ("assign", "access", "hex"), ("word", "number")
KINDS = (*LABELLED, "format")
#: Different strings that an automaton is fitted on, those of the smallest hashes, and their longest length.
FITTED, FITTED_CHARS = 600, 256
#: Shortest run that is scored.
SCORED_CHARS = 8
#: How many bits a credential's automaton must save over the ordinary ones, and how many bits a symbol over the labelled ones' worst it may need.
EVIDENCE_BITS, SLACK_BITS = 30.0, 0.5
#: A sign between words and numbers; the case of a word that is lower, upper or has a capital first (of others: a bit a letter).
SIGN_BITS, CASE_BITS = 4.0, 2.0
#: Of the Hoeffding bound: the chance that compatible states are held apart.
APART = 0.05
#: Runs longer than this are scored one by one.
LONG_RUN = 512

# The base detectors' shapes are fixed values. re.ASCII: other alphabets have letters that count as s and k in either case.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS, _ACCESS_CHARS = re.compile("AKIA[A-Z0-9]+"), 16
_HEX = re.compile("[0-9a-f]{32,}")  # runs of 32 characters at least, found whole
_ASSIGN_CHARS = 8
_RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SCORED_CHARS},}}")
_WORD = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?:[A-Za-z]+|[0-9]+)(?![A-Za-z0-9+/_=-])")
_PART = re.compile("[A-Za-z]+|[0-9]+")
_HINT = r"(?i)passw|secret|token|api_?key|AKIA|[0-9a-f]{32}"

_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
STOP = len(_SYMBOLS)
_CODE = np.zeros(128, np.int64)
_CODE[[ord(c) for c in _SYMBOLS]] = np.arange(STOP)
#: Symbols by class, as in hexadecimal numbers: random symbols differ too little one by one. The end is a class of its own.
_CLASS = ["AFGZafgz09"[[c.isupper(), c.islower(), c.isdigit()].index(True) * 4 + (0 if c.isdigit() or c.lower() <= "f" else 2)] if c.isalnum() else "+" for c in _SYMBOLS] + ["."]


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, credential) by start, then kind as in LABELLED; code points, end exclusive."""
    out = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_CHARS]
    out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= _ACCESS_CHARS]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def runs(text: str, spans: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, str]]:
    """(start, run) of the runs that touch no span; dots at their ends, which may be the sentence's, are left out."""
    covered, reach = [], 0
    for start, _, end, _ in spans:
        if end > reach:
            covered.append((max(start, reach), end))
            reach = end
    ends = [e for _, e in covered]
    for m in _RUN.finditer(text):
        i = bisect_left(ends, m.start() + 1)
        if i < len(covered) and covered[i][0] < m.end():
            continue
        run = m[0].strip(".")
        if len(run) >= SCORED_CHARS:
            yield m.start() + m[0].index(run[0]), run


# ---- grammar inference


@dataclass
class Automaton:
    """onward[state, symbol] is the next state, bits[state, symbol] the cost; the last symbol is the end of the string."""

    onward: np.ndarray
    bits: np.ndarray
    limit: float = 0.0  # bits a symbol, end included, that a string of the format needs at most


def _by_class(uses: dict[int, int]) -> dict[str, int]:
    out: dict[str, int] = {}
    for code, n in uses.items():
        out[_CLASS[code]] = out.get(_CLASS[code], 0) + n
    return out


class _Tree:
    """A prefix tree with counts, some of whose states have been merged."""

    def __init__(self, strings: Iterable[str]):
        self.kids: list[dict[int, int]] = [{}]
        self.uses: list[dict[int, int]] = [{}]
        self.seen = [0]
        for s in strings:
            at = 0
            for c in s:
                code = int(_CODE[ord(c)])
                self.seen[at] += 1
                self.uses[at][code] = self.uses[at].get(code, 0) + 1
                if code not in self.kids[at]:
                    self.kids[at][code] = len(self.kids)
                    self.kids.append({})
                    self.uses.append({})
                    self.seen.append(0)
                at = self.kids[at][code]
            self.seen[at] += 1
            self.uses[at][STOP] = self.uses[at].get(STOP, 0) + 1

    def compatible(self, one: int, other: int) -> bool:
        factor = (0.5 * np.log(2 / APART)) ** 0.5
        pairs = [(one, other)]
        while pairs:
            a, b = pairs.pop()
            n, m = self.seen[a], self.seen[b]
            if not n or not m:
                continue
            bound = factor * (n**-0.5 + m**-0.5)
            for mine, theirs in ((self.uses[a], self.uses[b]), (_by_class(self.uses[a]), _by_class(self.uses[b]))):
                if any(abs(mine.get(c, 0) / n - theirs.get(c, 0) / m) > bound for c in mine.keys() | theirs.keys()):
                    return False
            pairs += [(self.kids[a][c], k) for c, k in self.kids[b].items() if c in self.kids[a]]
        return True

    def fold(self, into: int, branch: int) -> None:
        """Adds a branch, still a tree, to a state."""
        pairs = [(into, branch)]
        while pairs:
            a, b = pairs.pop()
            self.seen[a] += self.seen[b]
            for c, n in self.uses[b].items():
                self.uses[a][c] = self.uses[a].get(c, 0) + n
            for c, k in self.kids[b].items():
                if c in self.kids[a]:
                    pairs.append((self.kids[a][c], k))
                else:
                    self.kids[a][c] = k


def infer(strings: list[str]) -> Automaton:
    """The automaton of different strings: states are settled in the order of their counts, each merged into the first settled one it is compatible with."""
    tree, settled = _Tree(strings), [0]
    place = {0: 0}
    while True:
        open_edges = [(-tree.uses[s][c], place[s], c, s, k) for s in settled for c, k in tree.kids[s].items() if k not in place]
        if not open_edges:
            break
        _, _, c, parent, branch = min(open_edges)
        into = next((s for s in settled if tree.compatible(s, branch)), None)
        if into is None:
            place[branch] = len(settled)
            settled.append(branch)
        else:
            tree.kids[parent][c] = into
            tree.fold(into, branch)
    onward = np.zeros((len(settled), STOP + 1), np.int64)  # an unseen symbol leads back to the first state
    chance = np.full((len(settled), STOP + 1), 1 / (STOP + 1))
    for s in settled:
        for c, n in tree.uses[s].items():
            chance[place[s], c] += n
        chance[place[s]] /= tree.seen[s] + 1
        for c, k in tree.kids[s].items():
            onward[place[s], c] = place[k]
    found = Automaton(onward, -np.log2(chance))
    if strings:
        found.limit = float((cost(found, strings) / ([len(s) + 1 for s in strings])).max())
    return found


def cost(automaton: Automaton, strings: list[str]) -> np.ndarray:
    """Bits of each string, its end included."""
    out = np.zeros(len(strings))
    lengths = np.array([len(s) for s in strings], np.int64)
    short = np.flatnonzero(lengths <= LONG_RUN)
    order = short[np.argsort(-lengths[short], kind="stable")]
    sizes = lengths[order]
    codes = _CODE[np.frombuffer("".join(strings[i] for i in order).encode("ascii"), np.uint8)]
    starts = np.cumsum(sizes) - sizes
    state, bits = np.zeros(len(order), np.int64), np.zeros(len(order))
    for at in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-sizes, -at, "left"))  # strings longer than at come first
        c = codes[starts[:n] + at]
        bits[:n] += automaton.bits[state[:n], c]
        state[:n] = automaton.onward[state[:n], c]
    out[order] = bits + automaton.bits[state, STOP]
    for i in np.flatnonzero(lengths > LONG_RUN):
        at, total, onward, each = 0, 0.0, automaton.onward.tolist(), automaton.bits.tolist()
        for c in _CODE[np.frombuffer(strings[i].encode("ascii"), np.uint8)].tolist():
            total += each[at][c]
            at = onward[at][c]
        out[i] = total + each[at][STOP]
    return out


# ---- the corpus


class _Smallest:
    """The different strings of the smallest hashes."""

    def __init__(self, size: int):
        self.size, self.heap, self.held = size, [], set()

    def add(self, value: str) -> None:
        h = xxhash.xxh3_64_intdigest(value) >> 1
        if len(self.heap) == self.size and h >= -self.heap[0][0] or value in self.held:
            return
        self.held.add(value)
        if len(self.heap) == self.size:
            self.held.discard(heapq.heapreplace(self.heap, (-h, value))[1])
        else:
            heapq.heappush(self.heap, (-h, value))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bool]]:
    """Of each row the text, and whether it may hold a base span."""
    texts = pc.fill_null(batch.column("text"), "")
    yield from zip(texts.to_pylist(), pc.match_substring_regex(texts, _HINT).to_pylist())


def labelled_sample(docs: DataFrame, text: str = "text", fitted: int = FITTED) -> DataFrame:
    """(kind, value) as a cut table: of each kind fitted different strings at most."""

    def smallest(batches):
        held = {k: _Smallest(fitted) for k in (*LABELLED, *ORDINARY)}
        for batch in batches:
            for body, hinted in _texts(batch):
                spans = base_spans(body) if hinted else []
                for _, kind, _, value in spans:
                    if len(value) <= FITTED_CHARS:
                        held[LABELLED[kind]].add(value)
                for word in set(_WORD.findall(body)):
                    if len(word) <= FITTED_CHARS:
                        held["number" if word[0] <= "9" else "word"].add(word.lower())
        rows = [(k, v, -h) for k, s in held.items() for h, v in s.heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], ["kind", "value", "h"])

    found = cut(docs.select(_text_of(text)).mapInArrow(smallest, "kind string, value string, h bigint"), "runs")
    tops = [found.where(F.col("kind") == k).distinct().orderBy("h", "value").limit(fitted) for k in (*LABELLED, *ORDINARY)]
    sample = tops[0]
    for t in tops[1:]:
        sample = sample.unionByName(t)
    return cut(sample.select("kind", "value"), "labelled")


def _text_of(text: str):
    return F.coalesce(F.col("`" + text.replace("`", "``") + "`"), F.lit("")).alias("text")


def fit(docs: DataFrame, text: str = "text", fitted: int = FITTED) -> dict[str, Automaton]:
    """An automaton for each kind of which the corpus has examples; each is inferred in a task of its own, from a bounded sample."""

    def inferred(key, group):
        found = infer(sorted(group["value"]))
        return pd.DataFrame({"kind": [key[0]], "states": [len(found.onward)], "onward": [found.onward.tobytes()], "bits": [found.bits.tobytes()], "limit": [found.limit]})

    rows = labelled_sample(docs, text, fitted).groupBy("kind").applyInPandas(inferred, "kind string, states int, onward binary, bits binary, limit double").collect()
    table = lambda data, kind, states: np.frombuffer(data, kind).reshape(states, STOP + 1)
    return {r.kind: Automaton(table(r.onward, np.int64, r.states), table(r.bits, np.float64, r.states), r.limit) for r in rows}


def ordinary_cost(automata: dict[str, Automaton], strings: list[str]) -> np.ndarray:
    """Bits of each string as words, numbers and signs in a row."""
    out = np.zeros(len(strings))
    places, parts = {k: [] for k in ORDINARY}, {k: [] for k in ORDINARY}
    for i, s in enumerate(strings):
        left = len(s)
        for part in _PART.findall(s):
            kind = "number" if part[0] <= "9" else "word"
            places[kind].append(i)
            parts[kind].append(part.lower())
            left -= len(part)
            if kind == "word":
                out[i] += CASE_BITS if part.islower() or part.isupper() or part[1:].islower() else len(part)
        out[i] += left * SIGN_BITS
    for kind in ORDINARY:
        bits = cost(automata[kind], parts[kind]) if kind in automata else np.array([len(p) + 1 for p in parts[kind]]) * np.log2(STOP + 1)
        np.add.at(out, np.array(places[kind], np.int64), bits)
    return out


def evidence(automata: dict[str, Automaton], strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each string the bits that its best credential format saves (no format: minus infinity), and that format's number in LABELLED."""
    per_symbol = np.array([len(s) + 1 for s in strings], np.float64)
    plain = ordinary_cost(automata, strings)
    best, which = np.full(len(strings), np.inf), np.zeros(len(strings), np.int64)
    for i, kind in enumerate(LABELLED):
        if kind in automata:
            bits = cost(automata[kind], strings)
            bits = np.where(bits / per_symbol <= automata[kind].limit + SLACK_BITS, bits, np.inf)
            which = np.where(bits < best, i, which)
            best = np.minimum(bits, best)
    return plain - best, which


def find_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id", automata: dict[str, Automaton] | None = None) -> DataFrame:
    """id_col and spans: array of (start, end, kind, found, score) by start, then kind as in KINDS; code points, end exclusive.

    Spans of the base detectors have no score. Those of kind "format" are runs outside of base spans that have a credential's format; score is the bits it
    saves. automata come from fit(), which otherwise runs over docs. A null text counts as empty; a very long one is read whole, as is a
    very long run. Repeated rows are treated alike; without labelled credentials there are base spans only; an empty table gives an empty
    result; other columns are not read, whatever their names."""
    spark = docs.sparkSession
    tune_arrow(spark)
    known = spark.sparkContext.broadcast(fit(docs, text) if automata is None else automata)  # states of at most FITTED * FITTED_CHARS symbols a kind

    def scan(batches):
        learned = any(k in known.value for k in LABELLED)
        for batch in batches:
            spans, asked = [], {}
            for row, (body, hinted) in enumerate(_texts(batch)):
                base = base_spans(body) if hinted else []
                spans.append([{"start": s, "rank": k, "end": e, "kind": KINDS[k], "found": body[s:e], "score": None} for s, k, e, _ in base])
                for start, run in runs(body, base) if learned else ():
                    asked.setdefault(run, []).append((row, start))
            strings = list(asked)
            saved = evidence(known.value, strings)[0] if strings else []
            for i in np.flatnonzero(np.asarray(saved) >= EVIDENCE_BITS):
                run = strings[i]
                for row, start in asked[run]:
                    spans[row].append({"start": start, "rank": len(LABELLED), "end": start + len(run), "kind": KINDS[-1], "found": run, "score": float(saved[i])})
            for found in spans:
                found.sort(key=lambda s: (s["start"], s["rank"]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, _SPANS)], ["id", "spans"])

    key = F.col("`" + id_col.replace("`", "``") + "`").alias("id")
    kind = docs.select(key).schema["id"].dataType.simpleString()
    out = docs.select(key, _text_of(text)).mapInArrow(scan, f"id {kind}, spans array<struct<start:int,rank:int,end:int,kind:string,found:string,score:double>>")
    return out.withColumnRenamed("id", id_col)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("found", pa.string()), ("score", pa.float64())]))
