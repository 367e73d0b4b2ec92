"""Language model, classifier and vectors against brute force and held-out rows, and the pipeline's stages."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest_rows import prose, rows

import corpus_pipeline
from gaugewell.llm import embedding_dedup, queries
from gaugewell.llm.common import written_order
from gaugewell.llm.elias_fano import EliasFano, from_buffer, to_file
from gaugewell.llm.embedding_dedup import near_vectors, passes_for
from gaugewell.llm.mixing import mix_sources
from gaugewell.llm.ngram_lm import quantise, score_texts
from gaugewell.llm.quality_classifier import FACTORS, SIZE, Machine, features, score_quality


@pytest.mark.parametrize("n,top", [(1, 10), (5, 5), (1000, 1 << 40), (1000, 500), (5000, 1 << 60), (3000, 3000), (7, 1)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n).astype(np.uint64))
    e = EliasFano(from_buffer(np.frombuffer(to_file(EliasFano.build(v, "x")), np.uint8)), "x")
    assert np.array_equal(e.access(np.arange(n)), v)
    ask = np.concatenate([v, v + np.uint64(1), rng.integers(0, top + 5, 300).astype(np.uint64), np.zeros(1, np.uint64)])
    assert np.array_equal(e.successor(ask), np.searchsorted(v, ask))


def test_quantise():
    v = np.random.default_rng(1).normal(-3, 1, 5000)
    code, book = quantise(v)
    assert np.abs(book[code] - v).max() < (v.max() - v.min()) / 256 and len(quantise(v[:0])[0]) == 0
    code, book = quantise(np.full(9, -2.5))
    assert (book[code] == -2.5).all()


def language_model(data):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = [[*(t or "").encode().lower().split(), b""] for _, t, *_ in data]
    training = [t for t, r in zip(tokens, data, strict=True) if not held(r[0])]
    c, pairs = Counter(), Counter()
    for t in training:
        c.update(t)
        pairs.update(zip([b"", *t[:-1]], t, strict=True))
    total, kinds = Counter(), Counter()
    for (a, _), k in pairs.items():
        total[a] += k
        kinds[a] += 1
    n, v = sum(c.values()), len(c)
    own = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    for r, t in zip(data, tokens, strict=True):
        base = sum(math.log10(own(w)) for w in t)
        score = sum(math.log10((pairs[a, w] + kinds[a] * own(w)) / (total[a] + kinds[a])) if total[a] else math.log10(own(w)) for a, w in zip([b"", *t[:-1]], t, strict=True))
        yield r[0], held(r[0]), len(t), sum(c[w] > 0 for w in t), n, base, score


def test_scores(docs, none):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted((tuple(r) for r in score_texts(docs).collect()), key=key), sorted(language_model(rows()), key=key)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-6)
        assert abs(g[6] - w[6]) <= 0.02 * w[2] + 1e-9
    assert score_texts(none).count() == 0
    # no training text: every token is unknown
    alone = score_texts(docs.where("doc_id = 20")).collect()
    assert zlib.crc32(b"20") % 5 == 1 or alone[0].n_known == alone[0].n_tokens


def test_scores_of_many_texts(spark):
    """Quantisation alone parts the scores from those of the exact model."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = {w[0]: w for w in language_model([(r.doc_id, r.text) for r in df.collect()])}
    got = score_texts(df).collect()
    assert len(got) == len(want) and any(r.held_out for r in got)
    for r in got:
        w = want[r.doc_id]
        assert tuple(r)[:5] == w[:5] and r.base_score == pytest.approx(w[5], rel=1e-9, abs=1e-6)
        assert abs(r.score - w[6]) <= 0.02 * w[2]


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and r.base_score == pytest.approx(0)


def test_interactions_in_linear_time():
    rng = np.random.default_rng(0)
    m = Machine(0.3, rng.normal(size=SIZE), rng.normal(size=(SIZE, FACTORS)))
    at, x = features(b"one two two THREE 4 | five.")
    pairs = sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert m.logit(at, x) == pytest.approx(0.3 + m.w[at] @ x + pairs)
    assert len(features(None)[0]) == len(features(b"")[0])


def test_classifier(spark, docs, none):
    good = [(i, prose(80, i, 30), 1) for i in range(300)]
    bad = [(1000 + i, " | ".join(prose(40, i, 30).upper().split()), 0) for i in range(100)]
    df = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad] + [(None, 1, 0), (5, None, 0), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    truth = {i: q for i, _, q in good + bad}
    held = [r for r in score_quality(df, labels).collect() if r.held_out]
    assert held and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    got = score_quality(docs, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert score_quality(none, labels).count() == 0
    assert {r.score for r in score_quality(docs, labels.where("false")).collect()} == {0.5}
    # a label of a null text teaches nothing
    odd = df.unionByName(spark.createDataFrame([(7000 + i, None) for i in range(50)], "doc_id long, text string"))
    more = labels.unionByName(spark.createDataFrame([(7000 + i, 1, 0) for i in range(50)], labels.schema))
    by = {r.doc_id: r.score for r in score_quality(df, labels).collect()}
    assert all(by[r.doc_id] == r.score for r in score_quality(odd, more).collect() if r.doc_id < 7000)


def test_max_labelled_bounds_what_is_learnt_from(spark, monkeypatch):
    """However many rows repeat an id, and however many labels."""
    from gaugewell.llm import quality_classifier

    df = spark.createDataFrame([(i, prose(20, i)) for i in range(200)] + [(7, prose(20, 500 + i)) for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, 1)] * 5, "doc_id long, quality int")
    seen = []
    train = quality_classifier.train
    monkeypatch.setattr(quality_classifier, "train", lambda rows, n: (seen.append(rows.count()), train(rows, n))[1])
    a = score_quality(df, labels, max_labelled=50).where("doc_id < 20").collect()
    assert len(seen) == 1 and seen[0] <= 50
    b = score_quality(df.repartition(7), labels.repartition(3), max_labelled=50).where("doc_id < 20").collect()
    key = lambda r: (r.doc_id, r.score)
    assert sorted(map(key, a)) == sorted(map(key, b))
    score_quality(df, labels)
    assert seen[-1] == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in [*range(200), *[7] * 5])


def test_metadata_are_features(spark):
    """Texts alike, labels by n_chars alone."""
    rows = [(i, prose(60, i % 41, 20), 50 if i % 2 else 50_000, i % 2) for i in range(600)]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    held = [r for r in score_quality(df, labels).collect() if r.held_out]
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95
    blind = [r for r in score_quality(df, labels, metadata=()).collect() if r.held_out]
    assert np.mean([r.predicted == r.doc_id % 2 for r in blind]) < 0.8


def vectors():
    rng = np.random.default_rng(5)
    out = []
    for c in range(12):
        centre = rng.normal(size=16)
        out += [(centre + rng.normal(size=16) * 0.12).tolist() for _ in range(c * 3 + 1)]
    out += [[1e200] * 16, [2e200] * 16, [1e-200] * 16, [3e-310] * 16]
    out += [out[0], out[0], [x * 2 for x in out[0]], None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [], [1.0, 2.0], [1.0, 2.0], [float("inf")] * 16]
    return list(enumerate(out))


@pytest.mark.parametrize("block", [1024, 5])
def test_near_vectors(spark, block):
    data = vectors()
    df = spark.createDataFrame([(i, v, 0) for i, v in data], "vec_id long, embedding array<double>, node int").repartition(3)
    before, embedding_dedup.BLOCK = embedding_dedup.BLOCK, block
    try:
        got = {r.vec_id: r for r in near_vectors(df, passes=16, window=20).collect()}
    finally:
        embedding_dedup.BLOCK = before
    links, parent = defaultdict(set), list(range(len(data)))
    unit = lambda v: np.array(v) / max(map(abs, v)) / np.linalg.norm(np.array(v) / max(map(abs, v)))
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    for i, a in data:
        for j, b in data[:i]:
            if ok(a) and ok(b) and len(a) == len(b) and np.dot(unit(a), unit(b)) >= 0.9:
                links[i].add(j)
                links[j].add(i)
    for _ in data:
        for i in links:
            parent[i] = min([parent[i], *(parent[j] for j in links[i])])
    found = sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= len(links[i]) for i, _ in data) and found >= 0.95 * sum(map(len, links.values()))
    assert [got[i].component_id for i, _ in data] == parent
    assert near_vectors(df.where("false")).count() == 0


def test_pipeline(spark, plain, tmp_path):
    """Every stage on what the one before kept, its columns, and the decisions on planted rows."""
    folder = str(tmp_path)
    good = [(100 + i, "The of and to a in is it for was on with. " + prose(90, 500 + i), "en", f"s{i % 3}", 1) for i in range(30)]
    planted = plain.unionByName(spark.createDataFrame(good, plain.schema))
    planted.write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == planted.columns
    ids = {n: [r.doc_id for r in v] for n, v in kept.items()}
    assert not {4, 5, 6, 7, 8, 9, 15} & set(ids["quality_rules"]) and {100 + i for i in range(30)} <= set(ids["quality_rules"])
    assert set(ids["minhash_near_dedup"]) <= set(ids["quality_rules"]) and not {2, 20} & set(ids["minhash_near_dedup"])
    assert sorted(ids["mix_sources"]) == sorted(ids["suffix_array_dedup"])
    assert {100 + i for i in range(30)} <= set(ids["best_fit_packing"]) == set(ids["mix_sources"])
    # mixing's order is that of its written rows, and packing's sequences follow it
    slots = {r.doc_id: (r.slot, r.place) for r in mix_sources(spark.read.parquet(f"{folder}/suffix_array_dedup")).collect()}
    files = written_order(spark.read.parquet(f"{folder}/mix_sources"), "f", "r").orderBy("f", "r").collect()
    assert [r.doc_id for r in files] == sorted(slots, key=lambda d: slots[d])
    run = corpus_pipeline.run(spark, folder)
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in run.collect()) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in kept["best_fit_packing"])


def test_rules_beside_their_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    df = queries.QUERIES["op2_quality_rules"](spark, folder)
    columns = sorted(df.columns)
    want = con.sql(queries.ORACLE_SQL["op2_quality_rules"])
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_vectors_whatever_the_partitions(spark):
    """Few passes and small windows miss links, the same ones with any number of partitions, also of fewer rows than a window."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 12)).repeat(12, axis=0) + 0.35 * rng.standard_normal((720, 12))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = [sorted(tuple(r) for r in near_vectors(df, passes=2, window=5, partitions=n).collect()) for n in (1, 2, 8, 211)]
    assert got[0] == got[1] == got[2] == got[3] and sum(r[1] for r in got[0]) > 500


def test_queries_are_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))


def test_passes_grow_with_the_vectors(spark):
    """Isolated pairs just above the threshold among many other vectors, in windows that are small for them."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((300, 32))
    y -= (y * x[:300]).sum(axis=1, keepdims=True) * x[:300]
    x[-300:] = 0.902 * x[:300] + np.sqrt(1 - 0.902**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in near_vectors(df, window=4).collect()}
    assert all(got[5700 + i] == got[i] for i in range(300))
    assert 16 <= passes_for(2000, 0.9, 64) < passes_for(10**5, 0.9, 64) < passes_for(10**7, 0.9, 64) < 200
    assert passes_for(0, 0.9, 64) == passes_for(10, 1.0, 64) == 16
