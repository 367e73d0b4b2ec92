"""Line dedup, vector codes and fill-in-middle against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from conftest_rows import COLUMNS, EXTRA, rows

from gaugewell.llm.common import Scratch
from gaugewell.llm.fill_in_middle import SENTINELS, Scanner, fill_in_middle, restore
from gaugewell.llm.line_dedup import LineRuns, _keyed, drop_repeated_lines
from gaugewell.llm.vector_codes import Codebooks, KdTree, compress_vectors, decode, encode_vectors, fit_codebooks

SPACE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHARED = ["A line that many documents share", "  a LINE that many documents share\t", "Éa line with an accent at its start", "éa line with an accent at its start", "ÉA line with an accent at its start", "ten chars!", "nine char", "日本語の長い行です、十文字", "", " ", "\x0bvertical tab around a line\x0c", "Kelvin K sign here", "Kelvin k sign here", "ã line that could be read as À", "Ã line that could be read as À"]


def lined() -> list[tuple]:
    out = [(100 + i, "\n".join([f"own line of document {i}", *(SHARED[(i + j) % len(SHARED)] for j in range(5)), "tail\n"]), "en", None, 1) for i in range(40)]
    return [*out, out[3], (103, "A line that many documents share\nother", "en", None, 1), (None, SHARED[0] + "\nonly without an id, twice", "en", None, 1), (None, "only without an id, twice", "en", None, 1), (-5, SHARED[5] + "\n" + "long " * 20_000, "en", None, 1)]


def fewer_lines(data):
    key = lambda line: line.strip(SPACE).translate(FOLD)
    order = lambda i: (i is None, i or 0)
    owner = {}
    for i, t, *_ in data:
        for line in (t or "").split("\n"):
            owner[key(line)] = min(owner.get(key(line), i), i, key=order)
    want = []
    for i, t, *_ in data:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == i]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return want


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_repeated_lines(spark, none, batches):
    data = rows() + lined()
    df = spark.createDataFrame([(*r, *EXTRA.values()) for r in data], none.schema).repartition(3)
    out = drop_repeated_lines(df.withColumnRenamed("label", "x_text").withColumnRenamed("q", "x_id"), batches=batches, fanout=2)
    assert out.columns[: len(df.columns)] == [{"label": "x_text", "q": "x_id"}.get(c, c) for c in df.columns]
    got = out.collect()
    assert Counter((r.doc_id, r.text, r.x_n_lines, r.x_n_dropped) for r in got) == Counter(fewer_lines(data))
    assert all(r.x_text == EXTRA["label"] and r.x_id == EXTRA["q"] for r in got)
    assert drop_repeated_lines(none).count() == 0
    assert drop_repeated_lines(df.select("doc_id", "text").where("doc_id is null"), batches=batches).count() == 4


def test_runs_are_disjoint_sorted_and_compacted(spark):
    """A later batch adds only keys that no run has; full levels become one run above, and buckets are merged where they lie."""
    from pyspark.sql import functions as F

    runs = LineRuns(Scratch(spark, "runs"), fanout=2)
    batch = lambda a: _keyed(spark.range(a, a + 40).select(F.col("id").alias("x_id"), F.lit(1).cast("long").alias("x_text_hash"), F.concat(F.lit("a line with number "), F.col("id"), F.lit("\none in all of them")).alias("x_text")), 10)
    for a in (0, 20, 40, 60, 80):
        runs.add(batch(a))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    held = [r for run in runs.runs() for r in run.collect()]
    assert len(held) == len({(r.x_h, r.x_g) for r in held}) == 121
    assert sum(r.x_owner == 0 for r in held) == 2
    assert runs.repeated(batch(20)).count() == 40 - 1 + 1  # the line that document 0 owns; the first twenty numbers are older than nothing
    plan = batch(100).groupBy("x_h", "x_g").agg(F.min("x_id").alias("x_owner")).join(runs.runs()[0].hint("merge"), ["x_h", "x_g"], "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1  # the batch's own
    runs.drop()
    assert runs.runs() == [] and not [t for t in spark.catalog.listTables() if t.name.startswith("gaugewell_run_")]


def brute_nearest(x, entries):
    d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("k,width,spread", [(1, 3, 5), (5, 1, 3), (64, 4, 2), (64, 4, 300), (200, 2, 4)])
def test_tree_keeps_ties_to_the_lowest_index(k, width, spread):
    rng = np.random.default_rng(k)
    for _ in range(20):
        entries = rng.integers(-spread, spread + 1, (k, width))
        x = rng.integers(-spread, spread + 1, (300, width))
        for a, b in zip(KdTree(entries).nearest(x), brute_nearest(x, entries), strict=True):
            assert (a == b).all()


def brute_codes(data, parts, entries, rounds):
    kept = [(i, np.clip(np.floor(np.array(v) * 256), -(1 << 23), 1 << 23).astype(int), label) for i, v, label in data if v is not None and len(v) and None not in v and np.isfinite(v).all()]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    x = np.array([v for _, v, _ in kept]).reshape(len(kept), parts, -1).swapaxes(0, 1)
    books = x[:, :entries].copy()
    near = lambda: [brute_nearest(x[p], books[p]) for p in range(parts)]
    for _ in range(rounds):
        for p, (found, _) in enumerate(near()):
            for e in set(found.tolist()):
                own = x[p][found == e]
                books[p, e] = [int(s) // len(own) for s in own.sum(axis=0)]
    got = near()
    error = sum(d for _, d in got)
    by = Counter()
    for (_, _, label), e in zip(kept, error, strict=True):
        by[label] += int(e)
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return [(i, "".join(f"{got[p][0][n]:02x}" for p in range(parts)), int(error[n]), by[label], sha) for n, (i, _, label) in enumerate(kept)]


def vectors(n=300, dim=32):
    rng = np.random.default_rng(8)
    data = [(i, (rng.integers(-3, 4, dim) / 128).tolist() if i % 3 else rng.standard_normal(dim).tolist(), None if i % 7 == 0 else i % 4 and 1) for i in range(n)]
    bad = [(900, None, 1), (901, [float("nan")] * dim, 1), (902, [float("inf")] + [0.0] * (dim - 1), 1), (903, [None] + [0.0] * (dim - 1), 1), (904, [], 1)]
    return [*data, data[5], data[5], (None, data[7][1], None), (-3, data[8][1], 2), (905, [1e300, -1e300] + [0.0] * (dim - 2), 3), *bad]


def test_vector_codes(spark):
    data = vectors()
    schema = "vec_id long, embedding array<double>, label int, code string, x_id int, part int"
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in data], schema).repartition(5)
    got = compress_vectors(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(brute_codes(data, 16, 64, 2))
    assert compress_vectors(df.where("vec_id < 0 or vec_id = 900")).count() == 1
    assert compress_vectors(df.where("vec_id = 900")).count() == 0 == compress_vectors(df.limit(0)).count()


def test_codes_of_other_vectors_and_back(spark):
    df = spark.createDataFrame([r for r in vectors(80) if r[0] is not None and 0 <= r[0] < 80], "vec_id long, embedding array<double>, label int").dropDuplicates(["vec_id"])
    books = fit_codebooks(df, parts=8, entries=128)  # as many entries as vectors: each is its own
    for r in encode_vectors(df, books).join(df.withColumnRenamed("vec_id", "x_id"), "x_id").collect():
        assert decode(r.code, books) == np.floor(np.array(r.embedding) * 256).__truediv__(256).tolist() and r.error == 0
    other = compress_vectors(df, books=Codebooks(books.entries[:, :3], 256))
    assert {c for r in other.collect() for c in bytes.fromhex(r.code)} <= {0, 1, 2}
    with pytest.raises(ValueError, match="equal parts"):
        fit_codebooks(df, parts=5)


UNIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "char": r"(?s)."}


@pytest.mark.parametrize("unit", list(UNIT))
def test_ranks_of_units(unit):
    scanner = Scanner(unit, SENTINELS)
    for t in ["", "\n", "a", "a\n", "\n\na", " a  b\n c ", "é　ü x\r\ny", "<P", "no <X> mark\n<S", *(r[1] or "" for r in rows())]:
        found, marked = scanner.scan(t)
        cuts = [0]
        for u in re.findall(UNIT[unit], t):
            cuts.append(cuts[-1] + len(u))
        assert not marked and found.units == len(cuts) - 1
        ranks = range(len(cuts)) if len(cuts) < 500 else (0, 1, 77, len(cuts) // 2, len(cuts) - 1)
        assert [found.place(r) for r in ranks] == [cuts[r] for r in ranks]
    assert all(scanner.scan(f"a{s}\nb")[1] for s in SENTINELS) and scanner.scan("x <M>\ny\nz")[0].units == {"line": 3, "word": 4, "char": 9}[unit]


def filled(i, t, unit="line"):
    t = t or ""
    units = re.findall(UNIT[unit], t)
    n = len(units)
    d = hashlib.sha256(b"7:" + (b"" if i is None else str(i).encode())).hexdigest()
    h = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not t or any(s in t for s in SENTINELS) or h[2] % 100 >= 100:
        return i, n, "plain", None, None, t
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if h[3] % 100 < 50:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, docs, none):
    marked = [(50 + i, t, None, None, None) for i, t in enumerate(["a<P>\nb", "<S>", "x\n<M", "<<M>>", "<\n>\n<", ">\n<\n>"])]
    data = rows() + marked
    df = docs.unionByName(spark.createDataFrame(marked, COLUMNS), allowMissingColumns=True)
    for unit in UNIT:
        got = restore(fill_in_middle(df, unit=unit)).collect()
        assert Counter(tuple(r)[:-1] for r in got) == Counter(filled(r[0], r[1], unit) for r in data)
        assert Counter((r.doc_id, r.restored) for r in got) == Counter((r[0], r[1] or "") for r in data)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert restore(fill_in_middle(none)).count() == 0
    assert all(r.form == "plain" and r.output == (r.output or "") for r in fill_in_middle(df, rate=0).collect())


def test_sentinels_that_could_be_misread():
    for bad in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("a", "ab", "x"), ("", "b", "c"), ("<\n>", "b", "c")):
        with pytest.raises(ValueError):
            Scanner("line", bad)


def test_new_queries_beside_their_sql(spark):
    import duckdb

    from gaugewell.llm.queries import ORACLE_SQL, QUERIES

    for name in ("op11_line_dedup", "op12_vector_codes", "op13_fill_in_middle"):
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
        want = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in want.description]
        got = QUERIES[name](spark, "/root/testdata/sf0.001").select(*names).collect()
        assert Counter(map(tuple, got)) == Counter(want.fetchall())
