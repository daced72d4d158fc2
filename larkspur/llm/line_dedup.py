r"""Line dedup: hashes in range partitions, sorted by document and place, streamed once.

Every line's key (stripped of ASCII white space, A-Z lower-cased) that is long enough becomes a
row (two 64-bit hashes, doc_id, place); texts are not shuffled. Rows are dealt out by range of
(hash, doc_id), each partition sorted by hash, descending doc_id and place, and streamed: in a
run of one hash the first document keeps its lines, and once `min_docs` documents are counted the
lines of all others are dropped. A hot line spreads over many partitions, as the range includes
the document; runs that touch a partition's edge are settled from one small summary a partition.
The decisions come back as a run-length coded keep bitmap per document (lengths of kept and
dropped runs in turn), which `apply_bitmaps` applies to the texts.

Only the lines that some partition cannot rule out leave the streaming pass, so what is written
to the checkpoint is about the size of the decisions.

Defined results: null and empty text are one empty line; a key's keeper is the largest doc_id
that holds it; rows with one doc_id count as one document and share decisions by place; rows with
null doc_id lose no lines; an empty table gives an empty result. Columns of the input are kept
and those made here replace clashing ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .state import cut, fresh

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, SMALL)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _stream(min_docs: int):
    """Decide runs of one hash in a sorted partition.

    Gives rows (h1, h2, doc_id, place, kind, n): kind 0 is a dropped line; 1 a line of a run that
    touches an edge of the partition and that the partition alone can't settle; 2 a summary of
    such a run: its number of documents `n`, its largest document in doc_id.
    """

    def table(h1, h2, doc, place, kind, n) -> pa.RecordBatch:
        m = len(h1)
        full = lambda x, t: np.full(m, x, t) if np.isscalar(x) else np.asarray(x, t)
        return pa.RecordBatch.from_arrays(
            [pa.array(full(x, t)) for x, t in ((h1, np.int64), (h2, np.int64), (doc, np.int64), (place, np.int32), (kind, np.int8), (n, np.int64))],
            ["h1", "h2", "doc_id", "place", "kind", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, first_run, docs, top, last = None, True, 0, 0, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []  # (doc_id, place) of the open run, not yet settled

        def settle(edge: bool) -> list[pa.RecordBatch]:
            nonlocal held
            doc = np.concatenate([d for d, _ in held]) if held else np.zeros(0, np.int64)
            place = np.concatenate([p for _, p in held]) if held else np.zeros(0, np.int32)
            held = []
            one = lambda d, p, k, n: table(np.full(len(d), open_key[0]), np.full(len(d), open_key[1]), d, p, k, n)
            if edge:
                return [one(doc, place, 1, 0), one(np.array([top]), np.array([0]), 2, docs)]
            if docs >= min_docs:
                return [one(doc[doc != top], place[doc != top], 0, 0)]
            return []

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, place = (np.asarray(batch.column(i)) for i in range(4))
            new_run = np.ones(len(h1), bool)
            new_run[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_doc = new_run.copy()
            new_doc[1:] |= doc[1:] != doc[:-1]
            at = np.append(np.flatnonzero(new_run), len(h1))
            begin = 0
            if open_key == (int(h1[0]), int(h2[0])):  # the open run goes on
                end = int(at[1])
                docs += int(new_doc[:end].sum()) - (doc[0] == last)
                last = int(doc[end - 1])
                held.append((doc[:end], place[:end]))
                if not first_run and docs >= min_docs or first_run and len(held) > 8:
                    # Enough is known: all but the first document's lines go. In an edge run nothing can be settled, but rows need not wait.
                    if first_run:
                        d, p = (np.concatenate(x) for x in zip(*held, strict=True))
                        yield table(np.full(len(d), open_key[0]), np.full(len(d), open_key[1]), d, p, 1, 0)
                    else:
                        yield from settle(False)
                    held = []
                if end == len(h1):
                    continue
                begin = 1
            if open_key is not None:
                yield from settle(first_run)
                first_run = False
            inner = at[begin:-2]  # runs that begin and end in this batch
            if open_key is None and len(at) > 2:  # the partition's first run ends inside this batch
                e = int(at[1])
                open_key, docs, top = (int(h1[0]), int(h2[0])), int(new_doc[:e].sum()), int(doc[0])
                held = [(doc[:e], place[:e])]
                yield from settle(True)
                first_run = False
                inner = at[1:-2]
            if len(inner):
                s, e = int(inner[0]), int(at[-2])
                n_docs = np.add.reduceat(new_doc[s:e].astype(np.int64), inner - s)
                size = np.diff(np.append(inner, e))
                drop = np.repeat(n_docs >= min_docs, size) & (doc[s:e] != np.repeat(doc[inner], size))
                if drop.any():
                    yield table(h1[s:e][drop], h2[s:e][drop], doc[s:e][drop], place[s:e][drop], 0, 0)
            s = int(at[-2])
            open_key, docs, top, last = (int(h1[s]), int(h2[s])), int(new_doc[s:].sum()), int(doc[s]), int(doc[-1])
            held = [(doc[s:], place[s:])]
        if open_key is not None:
            if not first_run and docs >= min_docs:  # settled but for what follows in the next partition, which needs the count
                d, p = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int32))
                yield table(np.full(int((d != top).sum()), open_key[0]), np.full(int((d != top).sum()), open_key[1]), d[d != top], p[d != top], 0, 0)
                held = []
            yield from settle(True)

    return run


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, place) of every line to drop; places count from 0."""
    line = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    key = line.select("doc_id", "place", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    # cut, as the ranges are drawn from a sample: else all texts would be split twice
    rows = cut(key.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "place"))
    dealt = rows.repartitionByRange("h1", "h2", F.desc("doc_id")).sortWithinPartitions("h1", "h2", F.desc("doc_id"), "place")
    seen = cut(dealt.mapInArrow(_stream(min_docs), "h1 long, h2 long, doc_id long, place int, kind byte, n long"))
    # A summary for each edge of a partition at most: never more than two rows a partition.
    edges = seen.where("kind = 2").groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("doc_id").alias("top")).where(F.col("n") >= min_docs)
    unsettled = seen.where("kind = 1").join(F.broadcast(edges), ["h1", "h2"]).where("doc_id <> top")
    return seen.where("kind = 0").select("doc_id", "place").unionByName(unsettled.select("doc_id", "place"))


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc_id, keep): run lengths of kept and dropped lines in turn, kept first; what follows is kept."""
    sets = dropped.groupBy("doc_id").agg(F.array_sort(F.collect_set("place")).alias("at"))

    def step(s: Column, x: Column) -> Column:
        grown = F.concat(F.slice(s["runs"], F.lit(1), F.size(s["runs"]) - 1), F.array(F.element_at(s["runs"], -1) + 1))
        runs = F.when((x == s["next"]) & (F.size(s["runs"]) > 0), grown).otherwise(F.concat(s["runs"], F.array(x - s["next"], F.lit(1))))
        return F.struct(runs.alias("runs"), (x + 1).alias("next"))

    start = F.struct(F.expr("cast(array() as array<int>)").alias("runs"), F.lit(0).alias("next"))
    return sets.select("doc_id", F.aggregate("at", start, step)["runs"].alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """`docs` with `kept_text`, `n_lines` and `n_dropped`."""
    docs = docs.drop(*[c for c in docs.columns if c in ("kept_text", "n_lines", "n_dropped")])

    def run(s: Column, n: Column) -> Column:
        places = F.array(F.sequence(s["at"], s["at"] + n - 1))
        out = F.when(s["drop"] & (n > 0), F.concat(s["out"], places)).otherwise(s["out"])
        return F.struct((s["at"] + n).alias("at"), (~s["drop"]).alias("drop"), out.alias("out"))

    def mask(keep: Column) -> Column:  # the dropped places
        start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("drop"), F.expr("cast(array() as array<array<int>>)").alias("out"))
        return F.flatten(F.aggregate(keep, start, run)["out"])

    keep, lines = fresh("__keep", docs.columns), fresh("__lines", docs.columns)
    split = docs.join(bitmaps.withColumnRenamed("keep", keep), "doc_id", "left").withColumn(lines, _lines(F.col("text")))
    # array_except works on hash sets: linear in the number of lines.
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), mask(F.col(keep)))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col(lines), i)), "\n")
    whole = F.col(keep).isNull()
    kept = F.when(whole, F.coalesce("text", F.lit(""))).otherwise(kept)
    n_dropped = F.when(whole, F.lit(0)).otherwise(F.coalesce(F.size(mask(F.col(keep))), F.lit(0)))
    return split.select(*docs.columns, kept.alias("kept_text"), F.size(lines).cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(dropped_lines(docs, min_chars, min_docs)))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
hot AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT l.doc_id, l.i, l.line, hot.k IS NOT NULL AND l.doc_id <> hot.top AS gone FROM l LEFT JOIN hot ON hot.k = l.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLES = {"op2_line_dedup": SQL}
