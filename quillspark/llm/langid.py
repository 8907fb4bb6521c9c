"""Language by cross-parsing entropy over suffix automata.

For each language a suffix automaton of labelled text knows every substring.  A
text is parsed from left to right into the longest phrases that the automaton
accepts; the fewer phrases a language needs for the text's symbols, the closer
it is.  ``phrases * log2(learnt symbols) / symbols`` estimates the cross-entropy
in bits a symbol; the smallest wins, ties go to the smaller name.

Symbols are lower-case letters, all that a language was learnt with, of any
script; whatever lies between letters is one space.  Transitions on a language's
``DENSE`` commonest symbols lie in a dense table, the others in a sorted list.

Every symbol of every text is parsed, and a phrase may be of any length.  So that
a whole batch is parsed side by side, texts are cut into lanes of ``LANE``
symbols; each lane is parsed as if a phrase began there, then goes on into the
next ones until it begins a phrase where the lane it is in began one too.  From
there on both parses are the same, so the phrases of the text as a whole are
counted by going from lane to lane at these places.

Learning takes a bounded sample (documented): per language at most
``SAMPLE_TEXTS`` whole texts, those of at most ``SAMPLE_LENGTH`` characters first,
then by id hash, up to the one that brings their characters to ``SAMPLE_CHARS``.
The tables grow with the number of languages, by some 10 MB each, and not with
the corpus; they are broadcast.

Nulls and edges: null text and text without a letter are ``und`` with score 0,
and so is everything where no language was learnt; letters that a language was
not learnt with are phrases of their own in it; rows with null language or id
teach nothing; a language whose sample holds no letter is not learnt.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANE, SAMPLE_TEXTS, SAMPLE_LENGTH, SAMPLE_CHARS, DENSE = 512, 64, 4_000, 24_000, 64
OTHER, SPACE = 0, 1
BREAK = np.int32(1 << 30)
#: Characters that are parsed side by side, but for a longer text.
SLICE_CHARS = 1 << 20


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the smallest automaton that accepts all suffixes; state 0 is the start."""
    following, link, longest = [{}], [-1], [0]
    last = 0
    for s in symbols:
        now = len(following)
        following.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in following[p]:
            following[p][s] = now
            p = link[p]
        if p >= 0:
            q = following[p][s]
            if longest[p] + 1 == longest[q]:
                link[now] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(s) == q:
                    following[p][s] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return following


class Automaton:
    """One language's automaton; a state is the place of its row in the dense table."""

    def __init__(self, learnt: np.ndarray, letters: int):
        """Symbols are SPACE and 2 to ``letters`` + 1; the language gets codes of its own for those it has, commonest first."""
        n = Counter(learnt.tolist())
        own = [OTHER, SPACE, *sorted((s for s in n if s > SPACE), key=lambda s: (-n[s], s))]
        self.codes = np.zeros(letters + 2, np.int32)
        self.codes[own] = np.arange(len(own))
        self.width, self.kinds, self.size = min(len(own), DENSE), len(own), max(len(learnt), 2)
        steps = suffix_automaton(self.codes[learnt].tolist())
        state = np.repeat(np.arange(len(steps)), [len(x) for x in steps])
        code = np.array([s for x in steps for s in x], np.int64)
        to = np.array([t for x in steps for t in x.values()], np.int64)
        self.between = len(steps) * self.width  # before the first phrase, and after one of a single unknown symbol
        self.again = np.full(self.kinds, self.between, np.int64)  # the symbol starts a phrase
        self.again[code[state == 0]] = to[state == 0] * self.width
        self.again = (self.again | BREAK).astype(np.int32)
        table = np.tile(self.again[: self.width], (len(steps) + 1, 1))
        dense = code < self.width
        table[state[dense], code[dense]] = to[dense] * self.width
        self.table = table.ravel()
        key = state[~dense] * self.kinds + code[~dense]
        order = np.argsort(key)
        self.rare, self.rare_to = key[order], (to[~dense] * self.width)[order].astype(np.int32)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next states, with the BREAK bit where the symbol starts a phrase."""
        if self.kinds == self.width:
            return self.table[state + code]
        to = self.table[state + np.minimum(code, self.width - 1)]
        rare = np.flatnonzero(code >= self.width)
        if len(rare):
            key = (state[rare] // self.width).astype(np.int64) * self.kinds + code[rare]
            at = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
            to[rare] = np.where(self.rare[at] == key, self.rare_to[at], self.again[code[rare]])
        return to

    def phrases(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases of each text, given its place among the symbols; no text is empty."""
        flat = self.codes[symbols]
        lanes = -(-size // LANE)
        head = np.cumsum(lanes) - lanes
        text = np.repeat(np.arange(len(size)), lanes)
        begin = start[text] + (np.arange(lanes.sum()) - head[text]) * LANE
        stop = (start + size)[text]
        end = np.minimum(begin + LANE, stop)

        order = np.argsort(begin - end, kind="stable")  # the longest first, so that lanes still going on come first
        from_ = begin[order]
        active = np.searchsorted((begin - end)[order], -np.arange(1, LANE + 1), "right")
        state = np.full(len(order), self.between, np.int32)
        starts = np.zeros(len(flat) + 1, bool)
        for k, n in enumerate(active[active > 0]):
            at = from_[:n] + k
            to = self.step(state[:n], flat[at])
            starts[at] = to >= BREAK
            state[:n] = to & (BREAK - 1)
        before = np.r_[0, np.cumsum(starts)]

        extra, met = np.zeros(len(begin), np.int64), np.full(len(begin), -1, np.int64)
        lane = order[end[order] < stop[order]]
        state = state[end[order] < stop[order]]
        at = end[lane]
        while len(lane):
            to = self.step(state, flat[at])
            new = to >= BREAK
            same = new & starts[at]
            met[lane[same]] = at[same]
            extra[lane] += new & ~same
            at = at + 1
            on = np.flatnonzero(~same & (at < stop[lane]))
            lane, state, at = lane[on], to[on] & (BREAK - 1), at[on]

        found, here, enter, which = np.zeros(len(size), np.int64), head, start, np.arange(len(size))
        while len(which):
            found[which] += before[end[here]] - before[enter] + extra[here]
            enter = met[here]
            on = np.flatnonzero(enter >= 0)
            which, enter = which[on], enter[on]
            here = head[which] + (enter - start[which]) // LANE
        return found


class Parser:
    """Automata of all languages."""

    def __init__(self, texts: dict[str, list[str]]):
        letters = sorted({c for ts in texts.values() for t in ts for c in t.lower() if c.isalpha()})
        self.letters = np.array([ord(c) for c in letters], np.int64)
        learnt = {lang: [s for s in self.symbols(ts) if len(s)] for lang, ts in texts.items()}
        self.langs = sorted(lang for lang, parts in learnt.items() if parts)
        self.automata = [Automaton(np.concatenate(learnt[lang]), len(letters)) for lang in self.langs]

    def _lookup(self) -> np.ndarray:
        if not hasattr(self, "_map"):
            kinds = np.full(0x110000, SPACE, np.int32)
            for cp in range(0x110000):
                if chr(cp).isalpha():
                    kinds[cp] = OTHER
            kinds[self.letters] = np.arange(2, len(self.letters) + 2)
            self._map = kinds
        return self._map

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_map"}

    def symbols(self, texts: list[str]) -> list[np.ndarray]:
        """Codes of a text's letters, with one space wherever others stand between them."""
        out, table = [], self._lookup()
        for t in texts:
            s = table[np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
            gap = s == SPACE
            keep = ~gap
            keep[1:] |= ~gap[:-1]
            s = s[keep]
            out.append(s[1:] if len(s) and s[0] == SPACE else s)
        return out

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and the symbols of each text."""
        coded = self.symbols(texts)
        size = np.array([len(s) for s in coded], np.int64)
        phrases = np.zeros((len(texts), len(self.langs)), np.int64)
        some = np.flatnonzero(size)
        if len(some):
            flat = np.concatenate(coded)
            for k, automaton in enumerate(self.automata):
                phrases[some, k] = automaton.phrases(flat, (np.cumsum(size) - size)[some], size[some])
        return phrases, size

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language needing fewest normalised phrases, and its share against the next one."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        phrases, size = self.parse([t or "" for t in texts])
        bits = phrases * np.log2([a.size for a in self.automata]) / np.maximum(size, 1)[:, None]
        best = bits.argmin(axis=1)
        two = np.partition(bits, 1, axis=1)[:, :2] if len(self.langs) > 1 else np.repeat(bits, 2, axis=1)
        share = two[:, 1] / np.maximum(two.sum(axis=1), 1e-12)
        return [self.langs[b] if n else "und" for b, n in zip(best, size, strict=True)], [float(x) if n else 0.0 for x, n in zip(share, size, strict=True)]


def learn(df: DataFrame, learn_from: Column, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Parser:
    """Automata from a bounded sample of rows where ``learn_from`` (over ``_id``) holds and the language is known."""
    rows = df.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_t"), F.col(lang).cast("string").alias("_lang"))
    rows = rows.where("_id is not null and _lang is not null and _t is not null").where(learn_from)
    rows = rows.withColumn("_o", F.struct((F.length("_t") > SAMPLE_LENGTH).alias("long"), F.xxhash64(F.col("_id").cast("string")).alias("h"), F.col("_id").cast("string").alias("i"), F.xxhash64("_t").alias("t")))
    order = Window.partitionBy("_lang").orderBy("_o")
    first = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE_TEXTS)
    chars = F.coalesce(F.sum(F.length("_t")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most SAMPLE_CHARS and one text a language come to the driver
    sample = first.withColumn("_chars", chars).where(F.col("_chars") < SAMPLE_CHARS).select("_lang", "_n", "_t").collect()
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in sample:
        texts.setdefault(r._lang, []).append((r._n, r._t))
    return Parser({lang: [t for _, t in sorted(ts)] for lang, ts in texts.items()})


def predict(df: DataFrame, parser: Parser, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ``lang_pred`` and ``score``."""
    sent = df.sparkSession.sparkContext.broadcast(parser)
    source = df.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = sent.value
        for batch in batches:
            texts = batch.column("_t").to_pylist()
            names, scores, i = [], [], 0
            while i < len(texts):
                j, n = i, 0
                while j < len(texts) and (j == i or n + len(texts[j] or "") <= SLICE_CHARS):
                    n += len(texts[j] or "")
                    j += 1
                a, b = parser.predict(texts[i:j])
                names, scores, i = names + a, scores + b, j
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id, "lang_pred", "score"])

    schema = source.select(F.col("_id").alias(id), F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return source.mapInArrow(run, schema)
