"""Substring search over a table: one scan for all needles, or an inverted index of character n-grams that is kept.

The scan reads every text once.  Up to ``SEND_ROWS`` needles are sent to all
tasks, more take the index; a needle's first ``PROBE`` characters are met by their hash at
every place of a text, then the text is looked at for the needle itself.  A task
keeps of each needle the ``top_k`` smallest entries it has seen, so frequent
needles are looked at no more once they have them, and what moves is bounded by
needles and tasks.

The index has a row for each entry and distinct gram of its pieces: three
characters, and one and two for needles that are shorter.  A needle of three or
more characters asks for its ``PROBES`` rarest grams, counted in the index; an
entry that has them all is a candidate, and its pieces are looked at for the
needle itself.  A shorter needle is a gram.  Only the needles' grams are sent
to all tasks, and only up to ``SEND_ROWS`` of them; the index, the candidates
and the texts are joined, whatever their size.

Nulls and edges: case does not count (lower case of both); a null needle finds
nothing, an empty one every entry with a piece; null pieces hold nothing; equal
needles are answered once; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.plans.registry import query
from quillspark.sources.sinks import shared_table
from quillspark.sources.tables import table

SIZE, PROBES, SEND_ROWS = 3, 3, 1_000_000
#: Grams in one batch of rows.
SLICE = 1 << 17
#: Characters of a needle that are met by hash, characters of text that are hashed at once, and bits of the table of known hashes.
PROBE, SPAN, KNOWN_BITS = 12, 1 << 17, 23
_BASE = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str) -> set[str]:
    """Distinct runs of one to ``SIZE`` characters, and the empty one."""
    return {""}.union(*({text[i : i + n] for i in range(len(text) - n + 1)} for n in range(1, SIZE + 1)))


def indexed(pieces: DataFrame, pos: str = "pos", text: str = "text") -> DataFrame:
    """(gram, pos) of every entry, each gram of an entry's piece once."""
    source = pieces.where(F.col(text).isNotNull()).select(F.col(pos).cast("long").alias("pos"), F.lower(text).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, places = [], []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.int64())], ["gram", "pos"])
            names.clear()
            places.clear()
            return made

        for batch in batches:
            for p, t in zip(batch.column("pos").to_pylist(), batch.column("_t"), strict=True):
                found = grams(t.as_py())
                names.extend(found)
                places.extend([p] * len(found))
                if len(names) >= SLICE:
                    yield out()
        yield out()

    return source.mapInArrow(run, "gram string, pos long")


def asked(needles: DataFrame, needle: str) -> DataFrame:
    """(needle, gram): the grams that an entry with the needle must have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, g) for n in batch.column("needle").to_pylist() for g in sorted(grams(n)) if len(g) == min(SIZE, len(n))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string()) for c in (0, 1)], ["needle", "gram"])

    return needles.where(F.col(needle).isNotNull()).select(F.lower(needle).alias("needle")).distinct().mapInArrow(run, "needle string, gram string")


def bounded(rows: DataFrame) -> DataFrame:
    """A written table, sent to all tasks where it is counted to be small."""
    return F.broadcast(rows) if rows.count() <= SEND_ROWS else rows


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def longer(hashes: np.ndarray, chars: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` characters from those of ``n - 1``, for every place that has so many."""
    h = hashes[: len(chars) - n + 1] * _BASE + chars[n - 1 :] + np.uint64(1)
    return h ^ (h >> np.uint64(29))


class Probes:
    """Hashes of the needles' first characters by their number, each with its needles."""

    def __init__(self, needles: list[str]):
        self.needles = [n for n in needles if n]
        found: dict[int, dict[int, list[int]]] = {}
        for i, needle in enumerate(self.needles):
            chars = points(needle[:PROBE])
            h = np.zeros(len(chars), np.uint64)
            for n in range(1, len(chars) + 1):
                h = longer(h, chars, n)
            found.setdefault(len(chars), {}).setdefault(int(h[0]), []).append(i)
        self.by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]] = {}
        for n, own in found.items():
            hashes = np.array(sorted(own), np.uint64)
            known = np.zeros(1 << KNOWN_BITS if len(hashes) > 1 << 12 else 1 << 16, bool)
            known[hashes & np.uint64(len(known) - 1)] = True
            self.by[n] = (hashes, known, np.full(len(hashes), np.iinfo(np.int64).max), [own[h] for h in hashes.tolist()])

    def groups(self, text: str, pos: int) -> Iterator[tuple[int, int]]:
        """(length, place) of the hashes that the text has, but for those whose needles have smaller entries enough."""
        for at in range(0, len(text), SPAN):
            chars = points(text[at : at + SPAN + PROBE - 1])
            h = np.zeros(len(chars), np.uint64)
            for n in range(1, min(max(self.by, default=0), len(chars)) + 1):
                h = longer(h, chars, n)
                if n in self.by:
                    hashes, known, least, _ = self.by[n]
                    some = h[known[h & np.uint64(len(known) - 1)]]
                    place = np.minimum(np.searchsorted(hashes, some), len(hashes) - 1)
                    place = place[(hashes[place] == some) & (least[place] > pos)]
                    for p in np.unique(place).tolist():
                        yield n, p


def scanned(pieces: DataFrame, needles: list[str], top_k: int, pos: str = "pos", text: str = "text") -> DataFrame:
    """(needle, pos): of each needle the ``top_k`` smallest entries that hold it in each task's texts."""
    source = pieces.where(F.col(text).isNotNull()).select(F.col(pos).cast("long").alias("pos"), F.lower(text).alias("_t"))
    sent = pieces.sparkSession.sparkContext.broadcast((sorted(needles), top_k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, k = sent.value
        probes = Probes(asked)
        held: list[list[int]] = [[] for _ in probes.needles]
        every: list[int] = []  # entries of the empty needle
        for batch in batches:
            for p, t in zip(batch.column("pos").to_pylist(), batch.column("_t"), strict=True):
                if p is None:
                    continue
                body = t.as_py()
                if p not in every and (len(every) < k or p < every[-1]):
                    insort(every, p)
                    del every[k:]
                for n, place in probes.groups(body, p):
                    _, _, least, own = probes.by[n]
                    for i in own[place]:
                        mine = held[i]
                        if (len(mine) < k or p < mine[-1]) and p not in mine and probes.needles[i] in body:
                            insort(mine, p)
                            del mine[k:]
                    if all(len(held[i]) == k for i in own[place]):
                        least[place] = max(held[i][-1] for i in own[place])
        names = [*probes.needles, *([""] if "" in asked else [])]
        found = [*held, *([every] if "" in asked else [])]
        for i in range(0, len(names), SLICE):
            rows = [(a, p) for a, ps in zip(names[i : i + SLICE], found[i : i + SLICE], strict=True) for p in ps]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["needle", "pos"])

    return source.mapInArrow(run, "needle string, pos long")


def search(pieces: DataFrame, needles: DataFrame, top_k: int, pos: str = "pos", text: str = "text", needle: str = "needle", index: DataFrame | None = None) -> DataFrame:
    """(needle in lower case, rank, pos): of each needle the first ``top_k`` entries that hold it, in order of ``pos``.

    ``index`` is that of :func:`indexed` over the same pieces, where one is
    kept.  Without it needles are sent to a scan of the pieces, where there are
    ``SEND_ROWS`` at most; more are looked up in an index that is made for them.
    """
    if index is None:
        some = shared_table(needles.where(F.col(needle).isNotNull()).select(F.lower(needle).alias("needle")).distinct())
        if some.count() <= SEND_ROWS:
            found = scanned(pieces, [r.needle for r in some.collect()], top_k, pos, text).distinct()
            rank = F.row_number().over(Window.partitionBy("needle").orderBy("pos"))
            return found.withColumn("rank", rank).where(F.col("rank") <= top_k).select("needle", "rank", "pos")
    return search_index(pieces, needles, top_k, pos, text, needle, index)


def search_index(pieces: DataFrame, needles: DataFrame, top_k: int, pos: str = "pos", text: str = "text", needle: str = "needle", index: DataFrame | None = None) -> DataFrame:
    """:func:`search` by an index, for any number of needles and entries."""
    index = shared_table(indexed(pieces, pos, text)) if index is None else index
    wanted = shared_table(asked(needles, needle))
    used = index.join(bounded(shared_table(wanted.select("gram").distinct())), "gram").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = F.row_number().over(Window.partitionBy("needle").orderBy("n", "gram"))
    # a gram that no entry has leaves its needle without a candidate
    probes = wanted.join(used, "gram", "left").fillna(0, ["n"]).withColumn("r", rarest).where(F.col("r") <= PROBES)
    probes = shared_table(probes.select("needle", "gram", F.count("*").over(Window.partitionBy("needle")).alias("probes")))
    hits = index.join(bounded(probes), "gram").groupBy("needle", "pos").agg(F.count_distinct("gram").alias("n"), F.first("probes").alias("probes"))
    candidates = shared_table(hits.where("n = probes").select("needle", "pos"))
    texts = pieces.where(F.col(text).isNotNull()).select(F.col(pos).cast("long").alias("pos"), F.lower(text).alias("_t"))
    found = texts.join(bounded(candidates), "pos").where(F.contains("_t", F.col("needle"))).select("needle", "pos").distinct()
    rank = F.row_number().over(Window.partitionBy("needle").orderBy("pos"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top_k).select("needle", "rank", "pos")


#: How the needles of the query are cut from what is said, and entries for each.
CUT, TOP = "substr(trim(text), 1, 2 + (conv_id % 9)::int)", 5


@query(
    "substring_search",
    f"""with q as (select distinct lower({CUT}) as needle from conversations where trim(text) <> ''), h as (select needle, doc_id, row_number() over (partition by needle order by doc_id) as rank from q join documents on contains(lower(text), needle))
    select needle, rank::int as rank, doc_id from h where rank <= {TOP}""",
)
def substring_search(spark, sf):
    """The first documents that hold the opening of anything that is said in a conversation."""
    said = table(spark, sf, "conversations").where(F.trim("text") != "")
    needles = said.select(F.substring(F.trim("text"), F.lit(1), F.lit(2) + (F.col("conv_id") % 9).cast("int")).alias("needle"))
    return search(table(spark, sf, "documents"), needles, TOP, "doc_id").withColumnRenamed("pos", "doc_id")
