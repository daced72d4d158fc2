r"""N-gram Jaccard join by set-relation skipping: exact links between shingle sets, as components.

A document's set is its distinct k-word shingles (words `[^\x20\x09-\x0D]+`, A-Z lower-cased);
with 1 to k-1 words all its words are one shingle. Two sets link when their Jaccard similarity
is at least `percent` / 100. Sets are identified by 64-bit hashes, shingles by 48-bit ones.

1. One pass over the texts. Every task packs its shingles into chunks, sorted, and deals them out
   by range; the ranges count in how many documents each shingle is and answer the chunks, for
   shingles of two documents or more, with a class of that count. A shingle that is frequent
   within a chunk travels once a chunk, whatever its rows. The order of shingles is: class, then
   hash. Those of one document come first and match nothing, so a set whose prefix holds no
   other is linked with nothing and is done. The others' shared shingles are their contents, as
   overlaps consist of shared shingles only. Equal sets collapse to one.
2. Stars: in rounds of independent min-hashes, sets with one minimum meet in groups of bounded
   size, and each joins the first leader that it links with. Members keep their difference to
   their leader, and members of one star are connected without being compared.
3. Index lists hold an entry for every shingle of a set's prefix, in blocks of one size and
   position, in that order. Pairs of blocks whose sizes or positions leave too few common
   shingles are skipped whole; within the rest, entries of one star skip each other, and parity
   bitmaps (a lower bound of the symmetric difference, so exact) settle most others. A list
   longer than `LIST` is dealt out as pairs of its parts, so none is held in one task.
4. Each list first names the shortest pairs that would connect its stars, a forest, so no more
   than its length. They are checked, and stars that link become one. Then all pairs that still
   may link two different components are named and checked. A pair's overlap is derived: the
   other set's overlap with the leader, which is computed once for all members of the leader's
   star, and the part of the member's difference that the other set holds.
5. Components of all links, by distributed contraction.

Defined results: null, empty and blank texts have an empty set, n_shingles 0, and are linked with
nothing; repeated rows are each returned, and equal doc_ids are one document; null doc_ids are
returned with null component unless linked; an empty table gives an empty result; columns of the
input are kept, those made here replace clashing ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import blocks, gram_sets, mix, words
from .state import components, cut

TOK_BITS = 48
CHUNK_DOCS = (1 << 16) - 1
CHUNK_TOKENS = 1 << 20
HOT = 32  # a shingle of more documents of a chunk travels as a count
GROUP = 256
ROUNDS = 2
LIST = 1024
SHORT = 24  # lists up to this length are searched all at once


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct shingles of these rows, first shingle of each row)."""
    for a, b, data, offs in blocks(column):
        h, _, first = words(data, offs)
        yield (a, b, *gram_sets(h, first, k))


def _ids(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set: sums of two mixes of its shingles."""
    n = np.diff(at)
    out = np.zeros(len(n), np.uint64)
    full = n > 0
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.add.reduceat(mix(sets ^ np.uint64(salt)), at[:-1][full]) if full.any() else np.zeros(0, np.uint64)
        out[full] = mix(out[full] ^ sums)
    return out ^ mix(n.astype(np.uint64))


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """The least size of a linked set, also the least overlap with any set: ceil(percent * n / 100)."""
    return -(-n * percent // 100)


def _overlap(n1, n2, percent: int):
    """The least overlap of linked sets of sizes n1 and n2: I >= t (n1 + n2 - I)."""
    return -(-percent * (n1 + n2) // (100 + percent))


def _list_column(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def _width(n: np.ndarray) -> np.ndarray:
    """Bits of the parity bitmap of a set of n shingles: a power of two, at least 256 and n."""
    return np.maximum(256, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def _parity(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's parity bitmap, in which every shingle flips one bit, as words; and each set's first word.

    Differing bits bound the symmetric difference of two sets from below. Halves of a bitmap
    xor to the bitmap of half the length, so sets of neighbouring sizes compare too.
    """
    n = np.diff(at)
    width = _width(n)
    first = np.append(0, np.cumsum(width))
    row = np.repeat(np.arange(len(n)), n)
    cell = (mix(sets ^ np.uint64(0xA4093822299F31D0)) & (width[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(first[row] + cell, minlength=int(first[-1])).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64), first // 64


def _minima(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """ROUNDS min-hashes of each set, one row a set (0 for empty sets)."""
    full = np.diff(at) > 0
    out = np.zeros((len(full), ROUNDS), np.uint64)
    if full.any():
        for r in range(ROUNDS):
            salt = np.uint64(r * 0x082EFA98EC4E6C89 + 1 & (1 << 64) - 1)
            out[full, r] = np.minimum.reduceat(mix(sets ^ salt), at[:-1][full])
    return out


def _pack(x: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte plane by byte plane: planes of zeros take no room once compressed."""
    gap = np.diff(x, prepend=np.uint64(0))
    wide = max(1, (int(gap.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([wide]) + gap.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def _unpack(body: bytes) -> np.ndarray:
    raw = np.frombuffer(body, np.uint8)
    planes = raw[1:].reshape(int(raw[0]), -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return np.cumsum(out.reshape(-1).view(np.uint64), dtype=np.uint64)


def _runs(key: np.ndarray, *more: np.ndarray) -> np.ndarray:
    new = np.ones(len(key), bool)
    if len(key):
        new[1:] = key[1:] != key[:-1]
        for m in more:
            new[1:] |= m[1:] != m[:-1]
    return np.flatnonzero(new)


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_BODY = [
    ("toks", pa.binary()),
    ("idx", pa.binary()),
    ("hot", _LONGS),
    ("hotn", _LONGS),
    ("doc", _LONGS),
    ("sid", _LONGS),
    ("n", _INTS),
    ("bits", _LONGS),
    ("mins", _LONGS),
]
_BODY_SQL = "toks binary, idx binary, hot array<long>, hotn array<long>, doc array<long>, sid array<long>, n array<int>, bits array<long>, mins array<long>"
#: What chunks deal out, and what they get back, for Spark and for Arrow.
DEALT, DEALT_ARROW = f"part int, chunk long, {_BODY_SQL}", pa.schema([("part", pa.int32()), ("chunk", pa.int64()), *_BODY])
ANSWERED, ANSWERED_ARROW = f"chunk long, head boolean, {_BODY_SQL}", pa.schema([("chunk", pa.int64()), ("head", pa.bool_()), *_BODY])


def _deal(k: int, range_bits: int):
    """Texts as chunks: rows of shingles for each range (`part`), and a head with all else of the chunk's documents."""

    def chunk_rows(chunk: int, held: list) -> pa.RecordBatch:
        doc = pa.concat_arrays([h[0] for h in held])
        sets = np.concatenate([h[1] for h in held])
        n = np.concatenate([h[2] for h in held])
        at = np.append(0, np.cumsum(n))
        row = np.repeat(np.arange(len(n)), n).astype(np.uint64)
        key = np.sort((sets >> np.uint64(16)) << np.uint64(16) | row)
        tok = key >> np.uint64(16)
        begins = _runs(tok)
        count = np.diff(np.append(begins, len(tok)))
        many = count > HOT
        few = ~np.repeat(many, count)
        few_tok, few_row = tok[few], (key[few] & np.uint64(0xFFFF)).astype(np.uint16)
        hot_tok, hot_n = tok[begins[many]], count[many]
        edges = np.arange((1 << range_bits) + 1, dtype=np.uint64) << np.uint64(TOK_BITS - range_bits)
        few_at, hot_at = np.searchsorted(few_tok, edges).tolist(), np.searchsorted(hot_tok, edges).tolist()
        parts = [j for j in range(1 << range_bits) if few_at[j] < few_at[j + 1] or hot_at[j] < hot_at[j + 1]]
        bits, _ = _parity(sets, at)
        none = [None] * len(parts)
        columns = [
            pa.array([*parts, chunk % (1 << range_bits)], pa.int32()),
            pa.array([chunk] * (len(parts) + 1), pa.int64()),
            pa.array([*[_pack(few_tok[few_at[j] : few_at[j + 1]]) for j in parts], None], pa.binary()),
            pa.array([*[few_row[few_at[j] : few_at[j + 1]].tobytes() for j in parts], None], pa.binary()),
            pa.array([*[_signed(hot_tok[hot_at[j] : hot_at[j + 1]]) for j in parts], _signed(key[~few])], pa.list_(pa.int64())),
            pa.array([*[hot_n[hot_at[j] : hot_at[j + 1]] for j in parts], None], pa.list_(pa.int64())),
            pa.array([*none, doc.to_pylist()], pa.list_(pa.int64())),
            pa.array([*none, _signed(_ids(sets, at))], pa.list_(pa.int64())),
            pa.array([*none, n.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([*none, bits], pa.list_(pa.int64())),
            pa.array([*none, _signed(_minima(sets, at)).reshape(-1)], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=DEALT_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held, docs, size = [], 0, 0
        for batch in batches:
            for a, b, sets, at in _sets(batch.column(1), k):
                for r in range(0, b - a, CHUNK_DOCS):
                    e = min(r + CHUNK_DOCS, b - a)
                    if held and (docs + e - r > CHUNK_DOCS or size + at[e] - at[r] > CHUNK_TOKENS):
                        yield chunk_rows(chunk, held)
                        chunk, held, docs, size = chunk + 1, [], 0, 0
                    held.append((batch.column(0).slice(a + r, e - r), sets[at[r] : at[e]], np.diff(at[r : e + 1])))
                    docs, size = docs + e - r, size + int(at[e] - at[r])
        if held:
            yield chunk_rows(chunk, held)

    return run


def _classes(few: list[np.ndarray], hot: list[np.ndarray], hot_n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of two documents or more, ascending, and the class of their number: its logarithm, in eighths of a doubling."""
    tok = np.sort(np.concatenate(few))
    begins = _runs(tok)
    count = np.diff(np.append(begins, len(tok)))
    tok = tok[begins]
    if any(map(len, hot)):
        tok, count = np.concatenate([tok, *hot]), np.concatenate([count, *hot_n])
        order = np.argsort(tok, kind="stable")
        tok, count = tok[order], count[order]
        begins = _runs(tok)
        tok, count = tok[begins], np.add.reduceat(count, begins)
    tok, count = tok[count > 1], count[count > 1]
    return tok, np.minimum(1 + np.floor(8 * np.log2(count)), 255).astype(np.uint8)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole ranges: each chunk's shingles that two documents or more hold, with the class of their number (idx: 3 bytes an entry).

    Packed rows are held for all ranges of the partition, unpacked for one at a time.
    """
    ranges: dict[int, list[tuple[pa.RecordBatch, int]]] = {}
    for batch in batches:
        is_head = batch.column("n").is_valid()
        heads = batch.filter(is_head)
        if heads.num_rows:
            yield pa.RecordBatch.from_arrays(
                [heads.column("chunk"), pa.array([True] * heads.num_rows), *[heads.column(c) for c in DEALT_ARROW.names[2:]]],
                schema=ANSWERED_ARROW,
            )
        own = batch.filter(pc.invert(is_head))
        for r, part in enumerate(own.column("part").to_pylist()):
            ranges.setdefault(part, []).append((own, r))
    while ranges:
        _, rows = ranges.popitem()
        lists = lambda c: [np.asarray(own.column(c)[r].values, dtype=np.int64) for own, r in rows]  # noqa: B023, E731
        few = [_unpack(own.column("toks")[r].as_py()) for own, r in rows]
        hot = [x.view(np.uint64) for x in lists("hot")]
        tok, rank = _classes(few, hot, lists("hotn"))
        if not len(tok):
            continue

        def of(x: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(tok, x), len(tok) - 1)  # noqa: B023
            return np.where(tok[at] == x, rank[at], 0).astype(np.uint8)  # noqa: B023

        out = []
        for (own, r), toks, often in zip(rows, few, hot, strict=True):
            cls = of(toks)
            keep = cls > 0
            if keep.any() or len(often):
                idx = np.frombuffer(own.column("idx")[r].as_py(), np.uint16)
                out.append((
                    own.column("chunk")[r].as_py(),
                    _pack(toks[keep]),
                    idx[keep].tobytes() + cls[keep].tobytes(),
                    _signed(often),
                    of(often).astype(np.int64),
                ))
        if out:
            cols, none = list(zip(*out, strict=True)), [None] * len(out)
            answers = [pa.array(cols[i], ANSWERED_ARROW.field(i + 1).type) for i in range(1, 5)]
            empty = [pa.array(none, ANSWERED_ARROW.field(i).type) for i in range(6, 11)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array([False] * len(out), pa.bool_()), *answers, *empty], schema=ANSWERED_ARROW)


def _assemble(percent: int):
    """Heads and answers sorted by chunk, heads first: a row a document, with contents if its prefix holds shared shingles."""

    def documents(head: dict, answers: list) -> pa.RecordBatch:
        doc, sid, n = head["doc"], np.asarray(head["sid"]), np.asarray(head["n"]).astype(np.int64)
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.uint8))]
        hot = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for toks, body, hot_tok, hot_cls in answers:
            m = len(body) // 3
            parts.append((_unpack(toks), np.frombuffer(body, np.uint16, m), np.frombuffer(body, np.uint8, m, 2 * m)))
            hot.append((hot_tok, hot_cls))
        tok, row, cls = (np.concatenate(x) for x in zip(*parts, strict=True))
        hot_tok, hot_cls = (np.concatenate(x) for x in zip(*hot, strict=True))
        key = np.asarray(head["hot"], dtype=np.int64).view(np.uint64)
        if len(key):
            order = np.argsort(hot_tok)
            at = order[np.searchsorted(hot_tok[order], (key >> np.uint64(16)).view(np.int64))]
            tok, row, cls = np.append(tok, key >> np.uint64(16)), np.append(row, (key & np.uint64(0xFFFF)).astype(np.uint16)), np.append(cls, hot_cls[at].astype(np.uint8))
        shared = np.bincount(row, minlength=len(n))
        alone = n - shared
        prefix = n - _need(n, percent) + 1
        live = (n > 0) & (alone < prefix)
        mine = live[row]
        tok, row, cls = tok[mine], row[mine].astype(np.int64), cls[mine]
        order = np.lexsort((tok, row))
        tok, row, cls = tok[order], row[order], cls[order]
        kept = np.where(live, shared, 0)
        at = np.append(0, np.cumsum(kept))
        by_class = np.argsort(row * 256 + cls, kind="stable")
        rank = np.arange(len(tok)) - at[row]  # of rows in class order too, as their numbers are the same
        head_of = by_class[rank < (prefix - alone)[row]]
        head_n = np.where(live, np.minimum(prefix - alone, shared), 0)
        width = np.where(live, _width(n) // 64, 0)
        words_at = np.append(0, np.cumsum(_width(n) // 64))
        take = np.repeat(words_at[:-1], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        mins = np.asarray(head["mins"]).reshape(-1, ROUNDS)
        starts = lambda sizes: np.append(0, np.cumsum(sizes))
        prefixes = _list_column(_signed(tok[head_of]), starts(head_n))
        bitmaps = _list_column(np.asarray(head["bits"])[take], starts(width))
        plain = [doc, pa.array(sid), pa.array(n.astype(np.int32)), pa.array(live), pa.array(alone.astype(np.int32))]
        return pa.RecordBatch.from_arrays(
            [*plain, prefixes, _list_column(_signed(tok), at), bitmaps, *[pa.array(mins[:, r]) for r in range(ROUNDS)]],
            ["doc_id", "sid", "n", "live", "alone", "prefix", "toks", "bits", *[f"mh{r}" for r in range(ROUNDS)]],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, head, answers = None, None, []
        for batch in batches:
            chunks, is_head = batch.column("chunk").to_pylist(), batch.column("head").to_pylist()
            for r in range(batch.num_rows):
                if chunks[r] != chunk:
                    if head is not None:
                        yield documents(head, answers)
                    chunk, head, answers = chunks[r], None, []
                if is_head[r]:
                    head = {c: batch.column(c)[r].values for c in ("doc", "sid", "n", "bits", "mins", "hot")}
                else:
                    packed = [batch.column(c)[r].as_py() for c in ("toks", "idx")]
                    answers.append((*packed, *[np.asarray(batch.column(c)[r].values, dtype=np.int64) for c in ("hot", "hotn")]))
        if head is not None:
            yield documents(head, answers)

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct numbers."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _stars(percent: int):
    """Rows (key, salt, n, sid, toks) sorted by group and descending size: each set that joins a leader, and its difference to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leaders = None, []
        for batch in batches:
            key, salt, n, sid = (np.asarray(batch.column(i)).tolist() for i in range(4))
            flat, at = np.asarray(batch.column(4).values), np.asarray(batch.column(4).offsets)
            out = []
            for r in range(batch.num_rows):
                if group != (key[r], salt[r]):
                    group, leaders = (key[r], salt[r]), []
                toks = flat[at[r] : at[r + 1]]
                for m, lead, own in leaders:
                    if 100 * n[r] < percent * m:
                        continue
                    both = _common(toks, own)
                    if 100 * both >= percent * (n[r] + m - both):
                        out.append((sid[r], lead, np.setdiff1d(toks, own, True), np.setdiff1d(own, toks, True)))
                        break
                else:
                    leaders.append((n[r], sid[r], toks))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0]), pa.array(cols[1]), *[pa.array(c, pa.list_(pa.int64())) for c in cols[2:]]],
                    ["sid", "lead", "more", "less"],
                )

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sid, star, n, alone, prefix, bits): index entries (tok, n, i, star, sid, bits)."""
    for batch in batches:
        for x in range(0, batch.num_rows, 256):
            part = batch.slice(x, 256)
            toks = part.column(4)
            offs = np.asarray(toks.offsets)
            size = np.diff(offs)
            row = np.repeat(np.arange(part.num_rows), size)
            rank = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.asarray(part.column(3))[row]
            take = pa.array(row)
            sid, star, n, bits = (part.column(c).take(take) for c in (0, 1, 2, 5))
            tok = toks.values.slice(offs[0], len(row))
            yield pa.RecordBatch.from_arrays([tok, n, pa.array(rank.astype(np.int32)), star, sid, bits], ["tok", "n", "i", "star", "sid", "bits"])


class _Lists:
    """Complete index lists, as arrays sorted by list, size and position."""

    def __init__(self, batch: pa.RecordBatch, percent: int) -> None:
        self.percent = percent
        self.tok, self.cell, self.n, self.i, self.star, self.sid, self.side = (np.asarray(batch.column(c)) for c in range(7))
        self.n, self.i = self.n.astype(np.int64), self.i.astype(np.int64)
        offs = np.asarray(batch.column(7).offsets).astype(np.int64)
        self.words, self.at, self.wide = np.asarray(batch.column(7).values).view(np.uint64), offs[:-1], np.diff(offs)
        self.begins = _runs(self.tok, self.cell)
        self.ends = np.append(self.begins[1:], len(self.tok))

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sizes and positions of the entries leave enough common shingles (size of a at most that of b)."""
        na, nb = self.n[a], self.n[b]
        return (_need(nb, self.percent) <= na) & (np.minimum(na - self.i[a], nb - self.i[b]) >= _overlap(na, nb, self.percent))

    def folded(self, e: np.ndarray, words: int, to: int) -> np.ndarray:
        """The bitmaps of entries that have `words` words each, folded to `to` words."""
        return np.bitwise_xor.reduce(self.words[self.at[e][:, None] + np.arange(words)].reshape(len(e), words // to, to), axis=1)

    def near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of entries of different stars whose bitmaps allow a link, and the least distance that they show."""
        ok = (self.star[a] != self.star[b]) & ((self.side[a] != self.side[b]) | (self.side[a] < 0))
        a, b = a[ok], b[ok]
        differ = np.zeros(len(a), np.int64)
        shapes = self.wide[a] * (1 << 32) + self.wide[b]
        for shape in np.unique(shapes).tolist():
            wa, wb = shape >> 32, shape & (1 << 32) - 1
            w, of = min(wa, wb), np.flatnonzero(shapes == shape)
            for x in range(0, len(of), 1 + (1 << 20) // w):
                some = of[x : x + 1 + (1 << 20) // w]
                differ[some] = np.bitwise_count(self.folded(a[some], wa, w) ^ self.folded(b[some], wb, w)).sum(1)
        na, nb = self.n[a], self.n[b]
        most = np.minimum((na + nb - differ) // 2, na)
        ok = most >= _overlap(na, nb, self.percent)
        return a[ok], b[ok], (1 - most / (na + nb - most))[ok]

    def short(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of all lists of up to SHORT entries: each entry with those one further, two further, ..."""
        size = self.ends - self.begins
        end = np.repeat(np.where(size <= SHORT, self.ends, 0), size)
        x = np.arange(len(self.tok))
        for step in range(1, SHORT):
            x = x[x + step < end[x]]
            if not len(x):
                return
            yield self.near(*(e[self.fits(x, x + step)] for e in (x, x + step)))

    def long(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of the longer lists, block by block: a block is one size and position, and is skipped whole."""
        for g in np.flatnonzero(self.ends - self.begins > SHORT).tolist():
            b, e = int(self.begins[g]), int(self.ends[g])
            if (self.star[b:e] == self.star[b]).all():
                continue
            first = b + _runs(self.n[b:e], self.i[b:e])
            size = np.diff(np.append(first, e))
            for y in range(len(first)):
                x = np.flatnonzero(self.fits(first[: y + 1], np.repeat(first[y], y + 1)))
                if not len(x):
                    continue
                others = np.repeat(first[x] - np.cumsum(size[x]) + size[x], size[x]) + np.arange(size[x].sum())
                mine = np.arange(first[y], first[y] + size[y])
                step = 1 + (1 << 18) // len(others)
                for z in range(0, len(mine), step):
                    left, right = np.tile(others, len(mine[z : z + step])), np.repeat(mine[z : z + step], len(others))
                    ahead = left < right
                    yield self.near(left[ahead], right[ahead])


def _forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which of the edges a-b make a forest that connects all that they connect, the shortest first."""
    root: dict[int, int] = {}
    keep = []
    for e in np.argsort(d, kind="stable").tolist():
        ends = []
        for x in (int(a[e]), int(b[e])):
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            ends.append(x)
        if ends[0] != ends[1]:
            root[max(ends)] = min(ends)
            keep.append(e)
    return np.asarray(keep, np.int64)


def _pairs(percent: int, forest: bool):
    """Index lists (tok, cell, n, i, star, sid, side, bits), sorted: pairs (a, b) that may link, of different stars.

    With `forest` only so many of a batch's lists as connect the stars, the shortest first.
    """

    def found(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        lists = _Lists(batch, percent)
        parts = [x for search in (lists.short, lists.long) for x in search() if len(x[0])]
        if not parts:
            return None
        a, b, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        sid = np.sort(np.stack([lists.sid[a], lists.sid[b]]), axis=0)
        order = np.lexsort((sid[1], sid[0]))
        one = order[_runs(sid[0][order], sid[1][order])]
        if forest:
            one = one[_forest(lists.star[a[one]], lists.star[b[one]], d[one])]
        return pa.RecordBatch.from_arrays([pa.array(sid[0][one]), pa.array(sid[1][one])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tok, cell = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            last = int(_runs(tok, cell)[-1])  # the list that may go on
            ended = last > 0 or (held and (held[-1].column(0)[0].as_py(), held[-1].column(1)[0].as_py()) != (tok[0], cell[0]))
            if ended:
                whole = pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()
                held = []
                if whole and (out := found(whole[0])) is not None:
                    yield out
            held.append(batch.slice(last))
        if held and (out := found(pa.Table.from_batches(held).combine_chunks().to_batches()[0])) is not None:
            yield out

    return run


def _candidates(sets: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs (a, b) of sets (sid, star, n, alone, prefix, bits) of different stars that may link."""
    stars = [F.count(F.lit(1)).alias("m"), F.min("star").alias("low"), F.max("star").alias("high")]
    lists = sets.select("star", F.explode("prefix").alias("tok")).groupBy("tok").agg(*stars).where("low < high")
    shared = cut(lists.select("tok", F.ceil(F.col("m") * 2 / LIST).cast("int").alias("parts")))
    entries = sets.select("sid", "star", "n", "alone", "prefix", "bits").mapInArrow(_spread, "tok long, n int, i int, star long, sid long, bits array<long>").join(shared, "tok")
    mine = F.when(F.col("parts") > 2, F.pmod(F.xxhash64("sid"), "parts")).otherwise(0).cast("int")
    entries = entries.withColumn("mine", mine).withColumn(
        "other",
        F.explode(F.when(F.col("parts") > 2, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0)))),
    )
    cell = F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), -1).otherwise(F.col("mine"))
    dealt = entries.select("tok", cell.alias("cell"), "n", "i", "star", "sid", side.alias("side"), "bits")
    dealt = dealt.repartition("tok", "cell").sortWithinPartitions("tok", "cell", "n", "i", "sid")
    return cut(dealt.mapInArrow(_pairs(percent, forest), "a long, b long").distinct())


def _derived(percent: int):
    """Rows (a, b, na, nb, lead, ta, tl, more, less) sorted by a and lead: the pairs (a, b) that link.

    The overlap of a with b is that with b's leader, and the part of b's difference that a holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, base, ta = None, 0, None
        for batch in batches:
            a, b, na, nb, lead = (np.asarray(batch.column(c)).tolist() for c in range(5))
            lists = [(np.asarray(batch.column(c).values), np.asarray(batch.column(c).offsets)) for c in range(5, 9)]
            got = []
            for r in range(batch.num_rows):
                of = lambda c: lists[c][0][lists[c][1][r] : lists[c][1][r + 1]]  # noqa: B023, E731
                if last != (a[r], lead[r]):
                    last, ta = (a[r], lead[r]), of(0)
                    base = _common(ta, of(1))
                both = base + _common(ta, of(2)) - _common(ta, of(3))
                if 100 * both >= percent * (na[r] + nb[r] - both):
                    got.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([x[r] for r in got], pa.int64()) for x in (a, b)], ["a", "b"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by the contents of `sets` and the differences of `members` to their leaders."""
    diff = members.select(F.col("sid").alias("b"), "lead", "more", "less")
    empty = F.array().cast("array<long>")
    named = pairs.join(diff, "b", "left").select(
        "a",
        "b",
        F.coalesce("lead", "b").alias("lead"),
        F.coalesce("more", empty).alias("more"),
        F.coalesce("less", empty).alias("less"),
    )
    body = lambda x, n, t: sets.select(F.col("sid").alias(x), F.col("n").alias(n), F.col("toks").alias(t))
    full = named.join(body("a", "na", "ta"), "a").join(sets.select(F.col("sid").alias("b"), F.col("n").alias("nb")), "b").join(body("lead", "nl", "tl"), "lead")
    full = full.select("a", "b", "na", "nb", "lead", "ta", "tl", "more", "less").sortWithinPartitions("a", "lead", "b")
    return cut(full.mapInArrow(_derived(percent), "a long, b long"))


def links(docs: DataFrame, k: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): rows (doc_id, sid, n) of every document, and (node, root) of the sets that are linked with others."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    range_bits = (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length()
    dealt = texts.mapInArrow(_deal(k, range_bits), DEALT).repartition("part")
    by_chunk = dealt.mapInArrow(_answer, ANSWERED).repartition("chunk").sortWithinPartitions("chunk", F.desc("head"))
    mins = ", ".join(f"mh{r} long" for r in range(ROUNDS))
    every = cut(by_chunk.mapInArrow(
        _assemble(percent),
        f"doc_id long, sid long, n int, live boolean, alone int, prefix array<long>, toks array<long>, bits array<long>, {mins}",
    ))
    rows = every.select("doc_id", "sid", "n")
    sets = cut(every.where("live").drop("doc_id", "live").dropDuplicates(["sid"]))

    # Stars: leaders of one round that join another leader pass their members on.
    star = sets.select("sid", F.col("sid").alias("star"))
    members = None
    for r in range(ROUNDS):
        keys = (sets if r == 0 else sets.join(members.select("sid"), "sid", "left_anti")).select("sid", F.col(f"mh{r}").alias("key"))
        many = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))  # so that a hot key's join can be split
        groups = cut(keys.join(many, "key").select("sid", "key", F.pmod(F.xxhash64("sid"), F.ceil(F.col("m") / GROUP)).cast("int").alias("salt")))
        grouped = groups.join(sets.select("sid", "n", "toks"), "sid").select("key", "salt", "n", "sid", "toks")
        grouped = grouped.repartition("key", "salt").sortWithinPartitions("key", "salt", F.desc("n"), "sid")
        joined = cut(grouped.mapInArrow(_stars(percent), "sid long, lead long, more array<long>, less array<long>"))
        star = cut(star.join(joined.select(F.col("sid").alias("star"), "lead"), "star", "left").select("sid", F.coalesce("lead", "star").alias("star")))
        members = joined if members is None else members.unionByName(joined)
    bonds = members.select(F.col("sid").alias("a"), F.col("lead").alias("b"))

    index = sets.select("sid", "n", "alone", "prefix", "bits").join(star, "sid")
    bonds = bonds.unionByName(_linked(_candidates(index, percent, True), sets, members, percent))
    roots = components(bonds, "a", "b")
    index = index.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("star", F.coalesce("root", "star"))
    more = _linked(_candidates(index, percent, False), sets, members, percent)
    if not more.isEmpty():
        roots = components(bonds.unionByName(more), "a", "b")
    return rows, roots


def join_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the least doc_id that links lead to."""
    rows, roots = links(docs, k, percent)
    full = cut(rows.where("n > 0").join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").select("doc_id", "n", F.coalesce("root", "sid").alias("g")))
    least = cut(full.groupBy("g").agg(F.min("doc_id").alias("component_id")))
    out = full.join(least, "g").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return out.unionByName(rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each component: the one with the least doc_id.

    Rows that repeat the doc_id of a kept row go too; only if there are such ids are rows compared.
    Rows with a null doc_id stay if their component has no doc_id, as do those without words.
    """
    found = cut(join_components(docs.select("doc_id", "text"), k, percent))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    twice = cut(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not twice.isEmpty():
        kept = kept.join(twice, "doc_id", "left_anti").unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(*docs.columns)


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split(translate(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' '), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, hash(g) AS g FROM (
        SELECT DISTINCT doc_id, list_slice(ws, i, i + 2) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, CASE WHEN len(ws) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM w))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS i FROM s JOIN (SELECT g, count(*) AS df FROM s GROUP BY g) USING (g)),
p AS (SELECT o.doc_id, o.g, n.n FROM o JOIN n USING (doc_id) WHERE o.i <= n.n - ceil(n.n * 0.9 - 1e-9) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n),
e AS (SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.g = x.g GROUP BY c.a, c.b, c.na, c.nb HAVING 100 * count(*) >= 90 * (c.na + c.nb - count(*))),
r AS (WITH RECURSIVE reach AS (SELECT doc_id AS d, doc_id AS o FROM documents
        UNION SELECT eb.v, reach.o FROM reach JOIN (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e) eb ON eb.u = reach.d WHERE eb.v > reach.o) SELECT d, min(o) AS o FROM reach GROUP BY d)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.o AS component_id FROM documents LEFT JOIN n USING (doc_id) JOIN r ON r.d = doc_id
"""

QUERIES = {"op5_jaccard_join": op5_jaccard_join}
ORACLES = {"op5_jaccard_join": SQL}
