"""Every operator on empty tables, nulls in all columns, repeated rows, very long texts and clashing columns."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspur.llm import chat_format, decontamination, jaccard_join, language_id, line_dedup, mixing, pii, quality_classifier, quality_rules, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators make themselves, or might use inside.
CLASH = ["keep", "kept", "kept_text", "n_lines", "n_words", "size", "shard", "slot", "leaks", "score", "lang_pred", "n_entities", "copies", "target", "component_id", "__keep", "failure_bits", "p_text", "rows", "total", "n", "__e", "__m", "__k", "__s", "__p", "__mark", "__id", "__n", "__base", "__rank", "__part", "__words"]
LONG = "lorem ipsum dolor sit amet consectetur " * 12000


@pytest.fixture(scope="module")
def odd(spark):
    body = "a good plain text of some words that nobody else has written down so far in this table"
    rows = [
        (None, None, None, None, None),
        (None, body, None, None, 1),
        (None, body, None, None, 1),
        (1, None, "en", None, 0),
        (1, "", None, "a", 0),
        (2, body, "en", "a", 9),
        (2, body, "en", "a", 9),
        (3, LONG, "en", "b", len(LONG)),
        (4, "é ü 漢字 " + body, "fr", " ", 5),
        (5, " \t\r\n", "", "", 4),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def dedup(df):
    return line_dedup.dedup_lines(df, 10, 2)


def chosen(df):
    return jaccard_join.keep_one(df)


def mixed(df):
    return mixing.apply_mix(df)


def sharded(df):
    return sharding.shard_documents(df, 3, 16)


def private(df):
    return pii.pseudonymize(df, "key")


def ruled(df):
    return quality_rules.apply_policy(quality_rules.ledger(df), quality_rules.FULL)


def clean(df):
    items = df.sparkSession.createDataFrame([(1, "lorem ipsum dolor sit amet"), (None, None)], "item_id long, text string")
    return decontamination.with_leaks(df, items)


def spoken(df):
    return language_id.identify(df, df.where("lang is not null"))


def graded(df):
    labels = df.sparkSession.createDataFrame([(i, i % 2) for i in range(8)] + [(None, 1), (3, None)], "doc_id long, quality int")
    return quality_classifier.classify(df, quality_classifier.train(df, labels))


ALL = [dedup, chosen, mixed, sharded, private, ruled, clean, spoken, graded]
ROWS_STAY = [dedup, sharded, private, ruled, clean, spoken, graded]


@pytest.mark.parametrize("op", ALL)
def test_empty_table(op, none):
    assert op(none).count() == 0
    assert set(none.columns) <= set(op(none).columns)


@pytest.mark.parametrize("op", ROWS_STAY)
def test_odd_rows_stay(op, odd):
    ids = Counter((r.doc_id, r.source, r.n_chars) for r in odd.collect())
    assert Counter((r.doc_id, r.source, r.n_chars) for r in op(odd).collect()) == ids


@pytest.mark.parametrize("op", ALL)
def test_columns_of_clashing_names(op, odd):
    """They do not change what is made, and those that are not replaced keep their values."""
    plain = op(odd)
    more = op(odd.withColumns({c: F.lit("mine") for c in CLASH}))
    made = [c for c in plain.columns if c not in CLASH or c not in odd.columns]
    assert sorted(map(str, more.select(*made).collect())) == sorted(map(str, plain.select(*made).collect()))
    for c in set(CLASH) - set(plain.columns):
        if c in more.columns:
            assert {r[0] for r in more.select(c).collect()} == {"mine"}


def test_results_on_odd_rows(odd):
    got = {(r.doc_id, r.text): r for r in dedup(odd).collect()}
    assert got[None, None].kept_text == "" and got[None, None].n_lines == 1 and got[3, LONG].n_dropped == 0
    comp = jaccard_join.join_components(odd.select("doc_id", "text"), 3, 90).collect()
    assert Counter((r.doc_id, r.component_id) for r in comp) == Counter({(None, None): 1, (None, 2): 2, (1, 1): 2, (2, 2): 2, (3, 3): 1, (4, 4): 1, (5, 5): 1})
    kept = Counter(r.doc_id for r in chosen(odd).collect())
    assert kept[2] == 1 and kept[1] == 1 and kept[None] == 3
    assert {r.lang_pred for r in spoken(odd).where("text is null or trim(text) = ''").collect()} == {"und"}
    assert all(0 <= r.score <= 1 for r in graded(odd).collect())
    assert [len(r.leaks) for r in clean(odd).collect() if r.doc_id == 3] == [1]
    mix = mixing.mix_copies(odd).collect()
    assert len(mix) == 10 and all(0 <= r.copies <= 2 for r in mix)
    assert all(r.shard is not None and r.slot >= 0 for r in sharded(odd).collect())


def test_chat_on_odd_rows(spark):
    kinds = "conv_id long, turn long, role string, text string"
    rows = [(None, 1, "user", "x"), (None, None, None, None), (1, None, "assistant", LONG), (1, 0, "user", None), (1, 0, "user", None)]
    made = chat_format.segments(spark.createDataFrame(rows, kinds).withColumns({"segments": F.lit(1), "valid": F.lit("x")}))
    back = {r.conv_id: r for r in made.select("conv_id", chat_format.parse(chat_format.formatted(F.col("segments"))).alias("t"), chat_format.loss_text(F.col("segments")).alias("loss")).collect()}
    assert len(back[None].t) == 2 and len(back[1].t) == 3 and back[1].loss == LONG
    assert chat_format.segments(spark.createDataFrame([], kinds)).count() == 0


@pytest.mark.parametrize("length", [40, 6])
def test_long_lists_are_split(spark, monkeypatch, length):
    """A family of near copies whose index lists are longer than one task takes: as brute force has it."""
    monkeypatch.setattr(jaccard_join, "LIST", length)
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    monkeypatch.setattr(jaccard_join, "SHORT", 3)
    monkeypatch.setattr(jaccard_join, "HOT", 2)
    monkeypatch.setattr(jaccard_join, "CHUNK_TOKENS", 500)
    import random

    rng = random.Random(length)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(40)] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[j : j + 2]) for j in range(39)} for i, t in rows}
    root = list(range(120))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(120):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(120)}
    assert 1 < len({find(i) for i in range(120)}) < 120


def brute_rules(text):
    """Whether the full policy keeps a text."""
    from test_operators import WORDS, brute_measures

    n, chars, symbols, _, repeats = brute_measures(text)
    text = text or ""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    double = sum(map(len, lines)) - sum(map(len, set(lines)))
    alpha = sum(any(c.isalpha() for c in w) for w in WORDS.findall(text))
    return n >= 10 and 100 * repeats <= 20 * n and 2 * n <= chars <= 15 * n and 10 * symbols <= n and 100 * double <= 20 * len(text) and 10 * alpha >= 6 * n


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage's rows by plain Python, on a small table with nulls, copies, leaks, and columns of clashing names."""
    import random

    import corpus_pipeline

    rng = random.Random(6)
    vocab = [a + b for a in "ba ke li mo nu ra se ti po da".split() for b in "nstrdm"]
    say = lambda n: rng.choices(vocab, k=n)
    item = say(24)
    texts = [say(rng.randrange(25, 80)) for _ in range(60)]
    for i in range(0, 60, 6):
        texts.append([*texts[i][:-1], "edit"])
        texts.append(list(texts[i]))
    texts += [say(20) + item + say(5), item[12:] + say(9) + item[:12], say(4), ["x"] * 40]
    rows = [(i, " ".join(w), "en", ["a", "b", None][i % 3], 7, "mine") for i, w in enumerate(texts)]
    rows += [(900, None, None, None, None, "mine"), (901, "", "en", "a", 0, "mine"), rows[7]]
    docs = spark.createDataFrame(rows, DOCS + ", n_words string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(out.columns) >= {*docs.columns, "shard", "slot"}
    got = out.collect()
    assert {r.n_words for r in got} == {"mine"} and all(r.text for r in got)

    kept = [r for r in rows if brute_rules(r[1])]
    sets = {r[0]: {tuple(r[1].lower().split()[j : j + 5]) for j in range(len(r[1].split()) - 4)} for r in kept}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    one = {r[0]: r for r in kept if find(r[0]) == r[0]}
    assert len(one) < len(kept)
    words = lambda t: t.lower().split()
    from test_operators import brute_tiles

    leaked = {i for i, r in one.items() if 2 * sum(t[2] for t in brute_tiles(words(r[1]), item, 5)) >= len(item)}
    assert leaked
    left = {i: r for i, r in one.items() if i not in leaked}
    taken = Counter(r.doc_id for r in got)
    assert set(taken) <= set(left) and max(taken.values()) <= 2 and all(r.text == left[r.doc_id][1] for r in got)
    size = Counter()
    for r in left.values():
        size[r[3]] += len(words(r[1]))
    mixed_words = Counter()
    for r in got:
        mixed_words[r.source] += len(words(r.text))
    order = sorted(size, key=lambda s: (s is None, s))
    weight, goal, full = dict(zip(order, (5, 2, 1), strict=False)), 1.5 * sum(size.values()), set()
    while True:
        level = (goal - sum(2 * size[s] for s in full)) / max(1e-9, sum(weight[s] for s in order if s not in full))
        over = {s for s in order if s not in full and level * weight[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    for s in order:
        assert abs(mixed_words[s] - (2 * size[s] if s in full else level * weight[s])) <= 80
    places = {}
    for r in got:
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    digest = lambda rs: hashlib.sha256(str(sorted(map(str, rs))).encode()).hexdigest()
    cols = [*docs.columns, "shard"]
    assert digest(out.select(*cols).collect()) == digest(corpus_pipeline.run(spark, str(tmp_path)).select(*cols).collect())


def test_pipeline_on_an_empty_table(spark, none, tmp_path):
    import corpus_pipeline

    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
