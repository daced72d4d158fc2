r"""Language identification by cross-parsing entropy.

For every language a suffix automaton of a bounded sample of labelled text is built on the
driver. A text is cut greedily into the longest phrases that occur in a language's sample; its
cross entropy is phrases * log2(sample size) / length, and the language that needs the fewest
bits wins (ties: the first by name).

Texts are read as lower-cased UTF-8 bytes; what is not a letter byte becomes one separator. The
automata are dense transition tables, and many pieces of `PIECE` bytes walk a table in step, so
one very long text is as parallel as many short ones. Pieces are a matter of speed only: each is
first parsed from its own first byte, then from the state in which the piece before it ends, up
to the first phrase that begins at one place in both parses; from there on both are the same.
Pieces that end in another state than before pass it on, at last one by one in the order of the
text. So the phrases are those of one parse of the whole text, in time linear in its length.

Bound on what is learned and broadcast: at most `n_excerpts` excerpts of `excerpt` characters a
language and `max_languages` languages; more languages raise an error. The excerpts come from
the documents with the least hash in each of `n_excerpts` buckets, over all labelled documents.

Defined results: null text and text without a letter is `und` with score 0; so is every text if
nothing was learned. The score is the winner's share of 2 ** (-4 * bits per byte) over the
languages. Rows are independent, so repeated rows repeat; an empty table gives an empty result;
extra columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import blocks
from .state import aside

PIECE = 256
ROUNDS = 2  # of passing on states between all pieces at once


def _classes() -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[97:123] = range(1, 27)
    out[128:] = range(27, 155)
    return out


CLASS = _classes()


class Automaton:
    """Suffix automaton of a byte string as a dense table; entries are state * width, 0 is dead."""

    def __init__(self, sample: bytes, used: np.ndarray):
        symbols = used[CLASS[np.frombuffer(sample, np.uint8)]].tolist()
        self.width = int(used.max()) + 1
        self.bits = math.log2(max(2, len(symbols)))
        moves, link, length = [{}, {}], [0, 0], [0, 0]  # state 0 is dead, 1 the root
        last = 1
        for c in symbols:
            cur = len(moves)
            moves.append({})
            link.append(1)
            length.append(length[last] + 1)
            p = last
            while p and c not in moves[p]:
                moves[p][c] = cur
                p = link[p]
            if p:
                q = moves[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    copy = len(moves)
                    moves.append(dict(moves[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p and moves[p].get(c) == q:
                        moves[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        table = np.zeros((len(moves), self.width), np.int32)
        for s, to in enumerate(moves):
            for c, t in to.items():
                table[s, c] = t * self.width
        self.flat, self.root = table.ravel(), table[1].copy()

    def _walk(self, steps: np.ndarray, active: list[int], state: np.ndarray, begins: np.ndarray, until: bool) -> np.ndarray:
        """Parse pieces (columns of `steps`, sorted by length descending) on from `state`, which is changed in place.

        begins[t, piece] tells where phrases begin. With `until` it holds another parse: a piece
        is left at the first phrase that begins in both, its state unchanged, and the parse is
        overwritten up to there. Returns which pieces were left.
        """
        begin = self.width
        synced = np.zeros(steps.shape[1], bool)
        for t, m in enumerate(active):
            lanes = np.flatnonzero(~synced[:m]) if until else slice(0, m)
            if until and not len(lanes):
                break
            s, now = steps[t, lanes], state[lanes]
            to = self.flat[now + s]
            new = now == begin
            miss = np.flatnonzero(to == 0)
            if len(miss):
                new[miss] = True
                again = self.root[s[miss]]
                to[miss] = np.where(again == 0, begin, again)  # a byte that the sample never has is a phrase by itself
            if until:
                same = new & begins[t, lanes]
                synced[lanes[same]] = True
                begins[t, lanes] = new
                state[lanes[~same]] = to[~same]
            else:
                begins[t, :m] = new
                state[:m] = to
        return synced

    def _step(self, symbols: list[int], state: int, begins: np.ndarray) -> int | None:
        """As _walk with `until`, for one piece, symbol by symbol: the state at its end, or None if it was left."""
        table, root, begin = memoryview(self.flat), memoryview(self.root), self.width
        old, new = begins.tolist(), []
        for t, s in enumerate(symbols):
            to = table[state + s]
            first = state == begin or to == 0
            new.append(first)
            if first and old[t]:
                begins[: t + 1] = new
                return None
            state = to or root[s] or begin
        begins[: len(new)] = new
        return state

    def phrases(self, steps: np.ndarray, active: list[int], before: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Phrases that begin in each piece; steps[t] has the pieces' t-th symbols, pieces sorted by length descending.

        before[piece] is the piece that it follows in its text, or -1; turn has the pieces in the
        order of the texts. What a few rounds over all pieces leave open, as in a text that
        repeats itself, is parsed in that order, each piece once.
        """
        begins = np.zeros(steps.shape, bool)
        ends = np.full(steps.shape[1], self.width, np.int32)
        self._walk(steps, active, ends, begins, False)
        length = np.zeros(steps.shape[1], np.int64)
        for m in active:
            length[:m] += 1
        entered = np.full(steps.shape[1], self.width, np.int32)  # the state in which each piece was last parsed
        for _ in range(ROUNDS):
            now = np.where(before >= 0, ends[before], self.width)
            todo = np.flatnonzero(now != entered)
            if not len(todo):
                return begins.sum(0)
            entered[todo] = now[todo]
            some = np.searchsorted(-length[todo], -np.arange(int(length[todo[0]])), side="left").tolist()
            part, state = begins[:, todo], now[todo]
            synced = self._walk(steps[:, todo], some, state, part, True)
            begins[:, todo] = part
            ends[todo[~synced]] = state[~synced]
        for p in turn.tolist():
            now = int(ends[before[p]]) if before[p] >= 0 else self.width
            if now != entered[p]:
                end = self._step(steps[: length[p], p].tolist(), now, begins[: length[p], p])
                ends[p] = ends[p] if end is None else end
        return begins.sum(0)


class Model:
    """Automata by language, in order of name."""

    def __init__(self, samples: dict[str, bytes]):
        seen = np.zeros(155, bool)
        for x in samples.values():
            seen[CLASS[np.frombuffer(x, np.uint8)]] = True
        self.used = np.where(seen, np.cumsum(seen) - 1, seen.sum()).astype(np.int32)  # the last column: never seen
        self.langs = sorted(samples)
        self.automata = [Automaton(samples[x], self.used) for x in self.langs]

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place of the language in `langs`, score) for each text (lower-cased)."""
        best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for a, b, data, offs in blocks(texts):
            size = np.diff(offs)
            n_pieces = -(-size // PIECE)
            row = np.repeat(np.arange(len(size)), n_pieces)
            if not len(row):
                continue
            place = (np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)) * PIECE
            start, length = offs[:-1][row] + place, np.minimum(PIECE, size[row] - place)
            order = np.argsort(-length, kind="stable")
            start, length, row = start[order], length[order], row[order]
            symbols = np.append(self.used[CLASS[data]], np.zeros(PIECE, np.int32)).astype(np.int32)
            longest = int(length[0])
            steps = np.empty((longest, len(start)), np.int32)
            for t in range(longest):
                steps[t] = symbols[start + t]
            active = np.searchsorted(-length, -np.arange(longest), side="left").tolist()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            before = np.where(place[order] > 0, rank[np.maximum(order - 1, 0)], -1)
            bits = np.empty((len(self.langs), len(size)))
            for k, auto in enumerate(self.automata):
                n = np.bincount(row, auto.phrases(steps, active, before, rank), len(size))
                bits[k] = n * auto.bits / np.maximum(size, 1)
            win = bits.argmin(0)
            best[a:b] = win
            score[a:b] = 1 / np.exp2(-4 * (bits - bits.min(0))).sum(0)
        return best, score


def samples(labelled: DataFrame, n_excerpts: int = 96, excerpt: int = 320, max_languages: int = 256) -> dict[str, bytes]:
    """Bounded excerpts by language from rows of (doc_id, text, lang); null lang and texts without a letter are left out."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("__h", F.xxhash64(F.col("doc_id").cast("string")))
    bucket = F.pmod(F.xxhash64(F.lit(1), "__h"), F.lit(n_excerpts))
    least = rows.groupBy("lang", bucket.alias("b")).agg(F.min("__h").alias("h")).limit(n_excerpts * max_languages + 1).collect()
    if len({r["lang"] for r in least}) > max_languages or len(least) > n_excerpts * max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not least:
        return {}
    text = F.lower("text")
    at = F.pmod("__h", F.greatest(F.length("text") - excerpt, F.lit(1))).cast("int") + 1
    chosen = rows.where(F.col("__h").isin([r["h"] for r in least])).select("lang", "__h", F.substring(text, at, F.lit(excerpt)).alias("x"))
    chosen = chosen.groupBy("lang", "__h").agg(F.min("x").alias("x"))  # repeated rows count once
    out: dict[str, list[str]] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["__h"])):
        out.setdefault(r["lang"], []).append(r["x"])
    return {lang: " ".join(dict.fromkeys(xs)).encode() for lang, xs in out.items()}


def train(labelled: DataFrame, **bounds) -> Model | None:
    found = {lang: x for lang, x in samples(labelled, **bounds).items() if CLASS[np.frombuffer(x, np.uint8)].any()}
    return Model(found) if found else None


def predictor(spark, model: Model | None) -> Callable[[Column], Column]:
    """A function from a text column to a column struct<lang,score>."""
    und = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    if model is None:
        return lambda text: und
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang string, score double>")
    def of(texts: pa.Array) -> pa.Array:
        m = shared.value
        best, score = m.predict(texts)
        return pa.StructArray.from_arrays([pa.array(m.langs, pa.string()).take(pa.array(best)), pa.array(score)], ["lang", "score"])

    return lambda text: F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), of(F.lower(F.coalesce(text, F.lit(""))))).otherwise(und)


def identify(docs: DataFrame, labelled: DataFrame, **bounds) -> DataFrame:
    """`docs` with `lang_pred` and `score`, learned from `labelled` (doc_id, text, lang)."""
    of = predictor(docs.sparkSession, train(labelled, **bounds))
    docs, back = aside(docs.drop("lang_pred", "score"))
    out = docs.withColumn("__p", of(F.col("text")))
    return back(out.select(*docs.columns, F.col("__p.lang").alias("lang_pred"), F.col("__p.score").alias("score")))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    learned = docs.where(F.coalesce(~held, F.lit(True)))
    out = identify(docs.select("doc_id", "text", held.alias("held_out")), learned)
    return out.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
