r"""Quality classifier by co-training of a text view and a metadata view.

Two logistic models see different columns: one the text's content (hashed words, repetition,
symbols), one the page's metadata (source, language, length and layout of lines). Both start from
the same labelled documents. In each round both models score all unlabelled documents, in one
pass over the table; each hands the documents of which it is surest, `per_round` in the
proportion of the classes, to the other model as pseudo-labels. Then each view is calibrated on
labelled documents that neither has seen, the calibrated log-odds are combined, and all documents
are scored in one pass without a shuffle.

Bounds on what is gathered: `max_labelled` labelled documents, those with the least hash of
doc_id over all, and `per_round` pseudo-labels a view and round; features of fixed width. A
partition hands on no more than `per_round` candidates a view, by doc_id. Models are fitted on
the driver from these and broadcast (a few kB).

Defined results: null text counts as empty, null metadata as the value "none", blank metadata as a
value of its own; labels that are null are left out and several labels of one document are
averaged (ties: good); without labels of both classes every score is the share of good labels
(0.5 without any); of rows with one doc_id the one with the least hash is learned from, and rows
with null doc_id are not. Repeated rows are scored alike; an empty table gives an empty result;
extra columns are kept and those made here replace clashing ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import SPACE, blocks, flat, grams, mix, words
from .state import aside, cut

HASHED, SOURCES, LANGS = 256, 64, 16
TEXT_WIDTH, META_WIDTH = HASHED + 8, SOURCES + LANGS + 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:!?'\"()-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags))[offs])


def text_features(texts: pa.Array) -> np.ndarray:
    out = np.zeros((len(texts), TEXT_WIDTH))
    for a, b, data, offs in blocks(texts):
        h, row, first = words(data, offs)
        n = np.maximum(np.diff(first), 1).astype(float)
        size = np.maximum(np.diff(offs), 1).astype(float)
        spot = (mix(h) >> np.uint64(56)).astype(np.int64)
        counts = np.bincount(row * HASHED + spot, minlength=(b - a) * HASHED).reshape(b - a, HASHED)
        out[a:b, :HASHED] = np.sqrt(counts / n[:, None])

        def distinct(x: np.ndarray, at: np.ndarray) -> np.ndarray:
            x = x.copy()
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                x[s:e].sort()
            new = np.ones(len(x), bool)
            new[1:] = x[1:] != x[:-1]
            new[at[:-1][np.diff(at) > 0]] = True
            return _per_row(new, at)

        pairs, at = grams(h, first, 2)
        letters = _per_row(~SPACE[data], offs) / n
        more = [
            distinct(h, first) / n,
            distinct(pairs, at) / n,
            letters / 10,
            _per_row(_SYMBOL[data], offs) / size,
            _per_row(_DIGIT[data], offs) / size,
            np.log1p(n) / 10,
            np.abs(letters - 5) / 5,
            (np.diff(first) < 10).astype(float),
        ]
        out[a:b, HASHED:] = np.stack(more, 1)
    return out


def meta_features(texts: pa.Array, source: pa.Array, lang: pa.Array) -> np.ndarray:
    out = np.zeros((len(texts), META_WIDTH))
    rows = np.arange(len(texts))
    for column, at, width in ((source, 0, SOURCES), (lang, SOURCES, LANGS)):
        h, _, first = words(*flat(column.cast(pa.string()).fill_null("none")))
        one, full = np.zeros(len(rows), np.uint64), np.diff(first) > 0
        if full.any():
            one[full] = np.add.reduceat(h, first[:-1][full])
        out[rows, at + (one % np.uint64(width)).astype(np.int64)] = 1
    size, n_lines = np.zeros(len(rows)), np.ones(len(rows))
    for a, b, data, offs in blocks(texts):  # a running count over all bytes of a batch would be eight times its size
        size[a:b] = np.diff(offs)
        n_lines[a:b] += _per_row(data == 10, offs)
    out[:, -5:] = np.stack(
        [np.log1p(size) / 10, np.log1p(n_lines) / 5, np.log1p(size / n_lines) / 5, (size < 200).astype(float), (size / n_lines > 2000).astype(float)],
        1,
    )
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Logistic regression with intercept (last) by damped Newton steps; y may be soft."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


class CoTrained:
    """Two views' models, their calibrations and the combination's."""

    def __init__(self, labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.views = None
        held = np.arange(len(y)) % 4 == 3
        if not (0 < y[~held].sum() < (~held).sum() and 0 < y[held].sum() < held.sum()):
            return
        self.held = [v[held] for v in labelled], y[held]
        self.known = [[v[~held]] for v in labelled]
        self.truth = [[y[~held]], [y[~held]]]
        self._refit()

    def _refit(self) -> None:
        self.views = [_fit(np.concatenate(x), np.concatenate(t)) for x, t in zip(self.known, self.truth, strict=True)]
        held, y = self.held
        z = [_margin(x, w) for x, w in zip(held, self.views, strict=True)]
        self.calibration = [_fit(m[:, None], y, 1e-3) for m in z]
        self.joint = _fit(np.stack([_margin(m[:, None], c) for m, c in zip(z, self.calibration, strict=True)], 1), y, 1e-3)

    def teach(self, lessons: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Refit with each view's lesson: features in that view, and labels that the other view gave."""
        for v, (x, label) in enumerate(lessons):
            self.known[v].append(x)
            self.truth[v].append(label)
        self._refit()

    def __getstate__(self) -> dict:
        """What scoring needs."""
        return {k: v for k, v in self.__dict__.items() if k not in ("held", "known", "truth")}

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text view, metadata view, both): calibrated probabilities of good quality."""
        if self.views is None:
            same = np.full(len(text), self.prior)
            return same, same, same
        z = [_margin(_margin(x, w)[:, None], c) for x, w, c in zip((text, meta), self.views, self.calibration, strict=True)]
        return _sigmoid(z[0]), _sigmoid(z[1]), _sigmoid(_margin(np.stack(z, 1), self.joint))


def _features(batches):
    """Rows (doc_id, y, text, source, lang): both views' features in place of the last three."""
    for batch in batches:
        t, m = text_features(batch.column(2)), meta_features(batch.column(2), batch.column(3), batch.column(4))
        lists = [pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32())) for x in (t, m)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc_id", "y", "t", "m"])


def _gather(docs: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """doc_ids, `y` and both views' features of the documents that `ids` (doc_id, y; of bounded size) names, by doc_id."""
    row = F.struct(F.xxhash64("text", "source", "lang").alias("h"), "text", "source", "lang")
    body = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min(row).alias("x")).select("doc_id", "y", "x.text", "x.source", "x.lang")
    got = body.mapInArrow(_features, "doc_id long, y int, t array<float>, m array<float>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    if not got.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), [np.zeros((0, w)) for w in (TEXT_WIDTH, META_WIDTH)]
    wide = lambda c, w: np.asarray(got.column(c).combine_chunks().values, float).reshape(-1, w)
    return np.asarray(got.column("doc_id").combine_chunks()), np.asarray(got.column("y").combine_chunks()), [wide("t", TEXT_WIDTH), wide("m", META_WIDTH)]


def _surest(model, known, most: tuple[int, int]):
    """Rows (doc_id, text, source, lang): (view, y, rank, doc_id) of the `most` surest bad (y 0) and good (y 1) ones of a partition by view."""

    def run(batches):
        views, skip = model.value.views, known.value
        best = {(v, y): (np.zeros(0), np.zeros(0, np.int64)) for v in (0, 1) for y in (0, 1)}
        for batch in batches:
            doc = np.asarray(batch.column(0))
            free = ~np.isin(doc, skip)
            both = text_features(batch.column(1)), meta_features(batch.column(1), batch.column(2), batch.column(3))
            for (v, y), (rank, ids) in best.items():
                z = np.round(_margin(both[v], views[v])[free], 6) * (-1 if y else 1)
                rank, ids = np.append(rank, z), np.append(ids, doc[free])
                order = np.lexsort((ids, rank))
                _, first = np.unique(ids[order], return_index=True)
                order = order[np.sort(first)][: most[y]]
                best[v, y] = rank[order], ids[order]
        for (v, y), (rank, ids) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([v] * len(ids), pa.int32()), pa.array([y] * len(ids), pa.int32()), pa.array(rank), pa.array(ids)],
                ["view", "y", "rank", "doc_id"],
            )

    return run


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 4000, per_round: int = 400, rounds: int = 2) -> CoTrained:
    """Fit on `docs` (doc_id, text, source, lang) and `labels` (doc_id, quality)."""
    spark = docs.sparkSession
    order = F.xxhash64(F.lit(17), "doc_id")
    kept = [F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang")]]
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *kept)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    ids, y, views = _gather(docs, known.orderBy(order, "doc_id").limit(max_labelled))
    turn = np.argsort(mix(np.arange(len(y), dtype=np.uint64)), kind="stable")
    model = CoTrained((views[0][turn], views[1][turn]), y[turn].astype(float))
    if model.views is None:
        return model
    n_bad = max(1, round(per_round * (1 - model.prior)))
    most = n_bad, max(1, per_round - n_bad)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(np.sort(ids))
        found = cut(docs.mapInArrow(_surest(*shared, most), "view int, y int, rank double, doc_id long").groupBy("view", "y", "doc_id").agg(F.min("rank").alias("rank")))
        picks = [found.where((F.col("view") == v) & (F.col("y") == k)).orderBy("rank", "doc_id").limit(most[k]) for v in (0, 1) for k in (0, 1)]
        named = cut(picks[0].unionByName(picks[1]).unionByName(picks[2]).unionByName(picks[3]))
        if named.isEmpty():
            break
        lessons = []
        for v in (0, 1):  # what the other view is sure of
            got, label, views = _gather(docs, named.where(F.col("view") == 1 - v).select("doc_id", "y"))
            lessons.append((views[v], label.astype(float)))
            ids = np.append(ids, got)
        model.teach(lessons)
    return model


def classify(docs: DataFrame, model: CoTrained) -> DataFrame:
    """`docs` with p_text, p_meta and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<p_text double, p_meta double, score double>")
    def of(text: pa.Array, source: pa.Array, lang: pa.Array) -> pa.Array:
        got = shared.value.score(text_features(text), meta_features(text, source, lang))
        return pa.StructArray.from_arrays([pa.array(x) for x in got], ["p_text", "p_meta", "score"])

    docs, back = aside(docs.drop("p_text", "p_meta", "score"))
    out = docs.withColumn("__s", of(F.coalesce("text", F.lit("")), F.col("source").cast("string"), F.col("lang").cast("string")))
    return back(out.select(*docs.columns, "__s.p_text", "__s.p_meta", "__s.score"))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return classify(docs, train(docs, labels)).select("doc_id", "score", "p_text", "p_meta", (F.col("score") >= 0.5).alias("kept"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLES: dict[str, str] = {}
