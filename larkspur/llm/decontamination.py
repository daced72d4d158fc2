r"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits (A-Z lower-cased; bytes beyond ASCII count as letters). The
benchmark's windows of `min_match` words are the seeds; a document's windows that occur among
them name the items that may be leaked. Such a pair is tiled: the longest match of unmarked words
is found and all its non-overlapping places are marked in the document and in the item, again
and again, until no match of `min_match` unmarked words is left. An item is leaked into a
document if the tiles cover at least `coverage` of the item's words, in any order.

Windows are hashed by running Karp-Rabin: the hash of the next window comes from the last one by
taking out its first word and adding a new one (here for all windows at once, from running sums).
The longest match is found by bisection, as two texts that share a window of some length share
shorter ones too. Equal hashes are only candidates: what is marked has been compared word by word
(by 64-bit hashes of the words).

The benchmark is handled in blocks of at most about `block_words` words, each broadcast (its size
is bound by the block) and held against all documents in one pass over the texts. Nothing is
shuffled, and a passage that thousands of documents share costs each of them alone. With more
than one block, documents and what is found so far go through a checkpoint before the next, so
that one block at a time is in memory.

Defined results: null and empty texts and items match nothing; items shorter than `min_match`
words must occur whole, as one run; repeated rows are judged one by one; repeated item ids with
different texts are separate items; an empty benchmark leaks nothing; extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import blocks, words
from .state import cut

SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
BITS = 22
_BASE = 0x9E3779B97F4A7C15
_DOWN = pow(_BASE, -1, 1 << 64)


class Running:
    """Karp-Rabin hashes of all windows of a row of word hashes, of any width."""

    def __init__(self, words_: np.ndarray):
        turns = np.append(np.uint64(1), np.full(len(words_), _DOWN, np.uint64)).cumprod(dtype=np.uint64)
        self.sums = np.append(np.uint64(0), np.cumsum(words_ * turns[:-1], dtype=np.uint64))
        self.back = np.append(np.uint64(1), np.full(len(words_), _BASE, np.uint64)).cumprod(dtype=np.uint64)

    def windows(self, width: int) -> np.ndarray:
        """Sum of word[i + t] * DOWN ** t over the window's words, modulo 2 ** 64, for every i."""
        if len(self.sums) <= width:
            return np.zeros(0, np.uint64)
        return (self.sums[width:] - self.sums[: len(self.sums) - width]) * self.back[: len(self.sums) - width]


def _free(marked: np.ndarray, width: int) -> np.ndarray:
    """Which windows have no marked word."""
    total = np.append(0, np.cumsum(marked))
    return total[width:] == total[: len(total) - width]


def tile(doc: np.ndarray, item: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document place, item place, length) of at least `width` words, the longest first."""
    running, marked = (Running(doc), Running(item)), (np.zeros(len(doc), bool), np.zeros(len(item), bool))

    def places(n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        at = [np.flatnonzero(_free(m, n)) for m in marked]
        return at, [r.windows(n)[x] for r, x in zip(running, at, strict=True)]

    def shared(n: int) -> bool:
        _, hashes = places(n)
        return bool(np.isin(*hashes).any())

    out: list[tuple[int, int, int]] = []
    most = min(len(doc), len(item))
    while most >= width and shared(width):
        low, high = width, most  # windows of `low` words are shared
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if shared(mid) else (low, mid - 1)
        (in_doc, in_item), (doc_hash, item_hash) = places(low)
        where: dict[int, list[int]] = {}
        for h, j in zip(item_hash.tolist(), in_item.tolist(), strict=True):
            where.setdefault(h, []).append(j)
        found, i = 0, -1
        for h, d in zip(doc_hash.tolist(), in_doc.tolist(), strict=True):
            if d < i or h not in where:
                continue
            where[h] = [j for j in where[h] if not marked[1][j : j + low].any()]
            j = next((j for j in where[h] if np.array_equal(doc[d : d + low], item[j : j + low])), None)
            if j is not None:
                marked[0][d : d + low] = marked[1][j : j + low] = True
                out.append((d, j, low))
                found, i = found + 1, d + low
        most = low if found else low - 1  # nothing: the hashes were equal by chance
    return out


class Seeds:
    """The windows of one block of the benchmark, by width: ascending hashes, and where each occurs."""

    def __init__(self, ids: list, texts: list[str | None], min_match: int):
        self.ids, self.words = ids, []
        for _, _, data, offs in blocks(pa.array([t or "" for t in texts], pa.large_string())):
            h, _, first = words(data, offs, SEPARATOR)
            self.words += np.split(h, first[1:-1])
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.width = np.minimum(self.sizes, min_match)
        self.at = {}
        for width in np.unique(self.width[self.width > 0]).tolist():
            mine = np.flatnonzero(self.width == width)
            hashes = [Running(self.words[x]).windows(width) for x in mine]
            h = np.concatenate(hashes)
            item, place = np.repeat(mine, [len(x) for x in hashes]), np.concatenate([np.arange(len(x)) for x in hashes])
            order = np.argsort(h, kind="stable")
            keys, first = np.unique(h[order], return_index=True)
            sieve = np.zeros(1 << BITS, bool)
            sieve[(keys >> np.uint64(64 - BITS)).astype(np.int64)] = True
            self.at[width] = keys, np.append(first, len(h)), item[order], place[order], sieve

    def candidates(self, doc: np.ndarray, coverage: float) -> list[tuple[int, int]]:
        """(width, item) of the items whose seeds in the document, even apart, could cover enough."""
        out = []
        running = Running(doc)
        for width, (keys, first, item, place, sieve) in self.at.items():
            g = running.windows(width)
            g = np.unique(g[sieve[(g >> np.uint64(64 - BITS)).astype(np.int64)]])
            spot = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            spot = spot[keys[spot] == g]
            size = first[spot + 1] - first[spot]
            each = np.repeat(first[spot] - np.cumsum(size) + size, size) + np.arange(size.sum())
            n = np.bincount(item[each], minlength=len(self.ids))  # every place of an item has one seed
            out += [(width, x) for x in np.flatnonzero((n > 0) & (width * n >= coverage * self.sizes)).tolist()]
        return out

    def leaks(self, texts: pa.Array, coverage: float) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for a, b, data, offs in blocks(texts):
            h, _, first = words(data, offs, SEPARATOR)
            for r in self._some(h, first):
                doc = h[first[r] : first[r + 1]]
                for width, item in self.candidates(doc, coverage):
                    tiles = tile(doc, self.words[item], width)
                    got, n = sum(t[2] for t in tiles), int(self.sizes[item])
                    if got and got >= coverage * n:
                        places = [dict(zip(("doc_word", "item_word", "n_words"), t, strict=True)) for t in sorted(tiles)]
                        out[a + r].append({"item_id": self.ids[item], "coverage": got / n, "matched": got, "n_tiles": len(tiles), "tiles": places})
        return out

    def _some(self, h: np.ndarray, first: np.ndarray) -> list[int]:
        """The documents of a block that hold some seed: one running pass over all words of the block."""
        hit = np.zeros(len(h), bool)
        running = Running(h)
        for width, (keys, _, _, _, sieve) in self.at.items():
            g = running.windows(width)
            maybe = np.flatnonzero(sieve[(g >> np.uint64(64 - BITS)).astype(np.int64)])
            hit[maybe[keys[np.minimum(np.searchsorted(keys, g[maybe]), len(keys) - 1)] == g[maybe]]] = True
        return np.unique(np.searchsorted(first, np.flatnonzero(hit), side="right") - 1).tolist()


def _finder(shared, kind: str, coverage: float):
    @F.arrow_udf(kind)
    def leaks(texts: pa.Array) -> pa.Array:
        item = pa.int64() if isinstance(shared.value.ids[0], int) else pa.string()
        tiles = pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("n_words", pa.int32())]))
        out = pa.list_(pa.struct([("item_id", item), ("coverage", pa.float64()), ("matched", pa.int64()), ("n_tiles", pa.int32()), ("tiles", tiles)]))
        return pa.array(shared.value.leaks(texts, coverage), out)

    return leaks


def with_leaks(docs: DataFrame, benchmark: DataFrame, *, min_match: int = 5, coverage: float = 0.5, block_words: int = 1 << 20) -> DataFrame:
    """`docs` with `leaks`, an array of (item_id, coverage, matched, n_tiles, tiles) for each leaked item."""
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c == "leaks"])
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = -(-size // (4 * block_words)) or 1
    kind = items.schema["item_id"].dataType.simpleString()
    tiles = "array<struct<doc_word:int,item_word:int,n_words:int>>"
    found = f"array<struct<item_id:{kind},coverage:double,matched:bigint,n_tiles:int,tiles:{tiles}>>"
    out = docs.withColumn("leaks", F.expr(f"cast(array() as {found})"))
    for b in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).orderBy("item_id", "text").collect()  # about block_words words
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(Seeds([r[0] for r in rows], [r[1] for r in rows], min_match))
        out = out.withColumn("leaks", F.concat("leaks", _finder(shared, found, coverage)(F.coalesce("text", F.lit("")))))
        if n_blocks > 1:
            out = cut(out)
            shared.destroy()
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of `docs` into which no item is leaked; the verdict comes with the row, so nothing is joined."""
    return with_leaks(docs, benchmark, **how).where(F.size("leaks") == 0).drop("leaks")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that is leaked into it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = with_leaks(docs, items).select("doc_id", F.explode("leaks").alias("x"))
    return found.select("doc_id", "x.item_id", "x.coverage", "x.matched", "x.n_tiles")


QUERIES = {"op4_decontamination": op4_decontamination}
ORACLES: dict[str, str] = {}
