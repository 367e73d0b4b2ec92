"""Rules, near copies and passages against brute force."""

from collections import Counter, defaultdict

import numpy as np
from conftest_rows import COLUMNS, prose, rows

from gaugewell.llm.common import shingles
from gaugewell.llm.graph import connected_components, union_find
from gaugewell.llm.common import Scratch
from gaugewell.llm.near_dedup import near_duplicates, superminhash
from gaugewell.llm.quality_rules import quality_rules
from gaugewell.llm.suffix_dedup import Windows, _neighbours, cut_repeated_passages, minimisers, repeated_passages


def split(t):
    return (t or "").encode().lower().split()


def test_quality_rules(docs, none):
    got = quality_rules(docs).collect()
    assert len(got) == len(rows())
    want = Counter()
    for i, t, *_ in rows():
        w = (t or "").encode().split()
        keys = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        n = Counter(keys)
        places = {p for j, k in enumerate(keys) if n[k] > 1 for p in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        failed = len(w) < 50 or 100 * len(places) > 50 * len(w)
        want[i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(places), failed] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules(none).count() == 0


def test_divergence_rejects_what_differs(spark):
    ordinary = [(i, "The of and to a in is it. " + prose(12, i) + " for was on with. " + prose(100, 900 + i), "en", "s", 0) for i in range(40)]
    odd = [(100, " ".join("##%%" + w.upper() for w in prose(120, 77).split()), "en", "s", 0)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(ordinary + odd, COLUMNS)).collect()}
    assert not got[100].kept and got[100].char_js > 0.1 and not got[100].base_failed
    assert all(got[i].kept for i in range(40))


def components(sets, percent):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


def jaccard_sets(texts, k):
    out = []
    for t in texts:
        w = split(t)
        out.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def test_near_duplicates(docs, none):
    data = rows()
    sets = jaccard_sets([r[1] for r in data], 3)
    roots = components(sets, 85)
    ids = defaultdict(list)
    for r, c in zip(data, roots, strict=True):
        ids[c].append(r[0])
    low = {c: min((i for i in v if i is not None), default=None) for c, v in ids.items()}
    want = Counter((r[0], len(s), low[c] if s else r[0]) for r, s, c in zip(data, sets, roots, strict=True))
    got = near_duplicates(docs, k=3, percent=85, bands=27, rows=7).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id is None or r.component_id is None or r.doc_id == r.component_id) for r in got)
    assert near_duplicates(none).count() == 0


def test_chain_of_near_copies(spark):
    """Neighbours in a chain are near, its ends are not; many nodes share bands, and blocks are small."""
    import gaugewell.llm.near_dedup as m

    words = prose(200, 5, 10**6).split()
    texts = []
    for i in range(60):
        words = [f"n{i}x{j}" if j == (i * 7) % 200 else w for j, w in enumerate(words)]
        texts.append(" ".join(words))
    want = components(jaccard_sets(texts, 5), 80)
    before, m.BLOCK = m.BLOCK, 8
    try:
        got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    finally:
        m.BLOCK = before
    assert [r.component_id for r in sorted(got)] == want


def test_superminhash_estimates():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 600).astype(np.uint64)
    b = np.concatenate([a[:450], rng.integers(0, 2**63, 150).astype(np.uint64)])
    s = superminhash([a, b, a[:0], a[:2]], 200)
    assert abs((s[0] == s[1]).mean() - 450 / 750) < 0.12
    assert np.isinf(s[2]).all() and np.isfinite(s[3]).all()
    assert (superminhash([b, a], 200)[1] == s[0]).all()


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = rng.integers(0, 400, (300, 2))
    nodes, low = union_find(edges[:, 0], edges[:, 1])
    df = spark.createDataFrame(edges.tolist(), "a long, b long").repartition(5)
    for one_task in (10**6, 5):  # with and without rounds of contraction
        got = {r.node: r.label for r in connected_components(df, Scratch(spark, "t"), one_task).collect()}
        moved = {n: lab for n, lab in zip(nodes.tolist(), low.tolist(), strict=True) if n != lab}
        assert moved.items() <= got.items() and all(got[n] == n for n in got if n not in moved)


def test_minimisers_follow_content():
    h = np.random.default_rng(2).integers(0, 2**63, 300).astype(np.uint64)
    whole = set(minimisers(Windows(h), 50)[0].tolist())
    part = {p + 100 for p in minimisers(Windows(h[100:200]), 50)[0].tolist()}
    assert {p for p in whole if 143 <= p <= 157} == {p for p in part if 143 <= p <= 157}
    for i in range(251):
        assert any(i <= p <= i + 42 for p in whole)
    w = Windows(h)
    assert w.at(np.array([3]), 8) == Windows(h[3:20]).at(np.array([0]), 8)
    assert len(shingles(h[:2], 5)) == 1


def coverage(data, length=50):
    at = defaultdict(list)
    texts = [split(r[1]) for r in data]
    for n, w in enumerate(texts):
        for j in range(len(w) - length + 1):
            at[tuple(w[j : j + length])].append((n, j))
    cover = [set() for _ in data]
    for found in at.values():
        if len({n for n, _ in found}) > 1:
            for n, j in found:
                cover[n].update(range(j, j + length))
    return cover


def test_repeated_passages(docs, plain, none):
    data = sorted({r for r in rows() if r[0] is not None}, key=lambda r: r[0])
    got, removable = defaultdict(set), defaultdict(set)
    passages = repeated_passages(plain)
    for r in passages.collect():
        assert r.end_word - r.start_word >= 50 and r.other_id != r.doc_id
        got[r.doc_id].update(range(r.start_word, r.end_word))
        if r.removable:
            removable[r.doc_id].update(range(r.start_word, r.end_word))
    assert {i: s for i, s in got.items()} == {r[0]: c for r, c in zip(data, coverage(data), strict=True) if c}
    assert 11 not in removable and len(removable[12]) == 70 and 1 not in removable and len(removable[20]) == 120
    cut = {r.doc_id: r for r in cut_repeated_passages(plain).collect()}
    assert 2 not in cut and 20 not in cut and split(cut[1].text) == split(data[0][1])
    assert split(cut[12].text) == [w for j, w in enumerate(split(dict((r[0], r[1]) for r in data)[12])) if j not in removable[12]]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut.values())
    # repeated rows are copies: all but one are removable
    whole = [r for r in repeated_passages(docs).collect() if r.doc_id == 1 and r.start_word == 0 and r.end_word == 120]
    assert sum(not r.removable for r in whole) == 1
    assert repeated_passages(none).count() == 0


def test_middle_members_of_a_frequent_passage(spark):
    """Many texts have 45 words; two in the middle of their ids have 51 that the others don't."""
    spread = [prose(45, 1000 + k, 10**6) for k in range(12)]
    data, want = [], set()
    for k, p in enumerate(spread):
        tail = prose(6, 2000 + k, 10**6)
        for i in range(8):
            id_ = 100 * k + i
            data.append((id_, f"{prose(60, 3000 + id_, 10**6)} {p} {tail if i in (3, 4) else prose(6, 5000 + id_, 10**6)} {prose(60, 7000 + id_, 10**6)}"))
            if i in (3, 4):
                want.add((id_, 60, 111, id_ + 7 - 2 * i, i == 4))
    got = repeated_passages(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert {tuple(r) for r in got} == want


def test_passages_with_lines_that_repeat(spark):
    """The line that stands earlier in both texts holds the passage's only minimiser in some of the cases."""
    data, want = [], set()
    for k in range(100):
        passage = prose(60, 10_000 + k, 10**6).split()
        line = passage[20:40]
        words = [prose(n, 20_000 + 10 * k + j, 10**6).split() for j, n in enumerate((30, 40, 30, 70, 30, 30))]
        data.append((2 * k, " ".join([*words[0], *line, *words[1], *passage, *words[4]])))
        data.append((2 * k + 1, " ".join([*words[2], *line, *words[3], *passage, *words[5]])))
        want |= {(2 * k, 90, 150, 2 * k + 1, False), (2 * k + 1, 120, 180, 2 * k, True)}
    data += [(1000, "same " * 300), (1001, "same " * 60), (1002, "same " * 49)]
    want |= {(1000, 0, 300, 1001, False), (1001, 0, 60, 1000, True)}
    got = repeated_passages(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert {tuple(r) for r in got} == want


def test_rows_of_one_id_share_a_passage(spark):
    common = prose(80, 1, 10**6)
    data = [(1, f"{prose(60, 2, 10**6)} {common}"), (1, f"{common} {prose(60, 3, 10**6)}"), (2, prose(90, 4, 10**6)), (None, f"{prose(30, 5, 10**6)} {common}")]
    got = Counter(tuple(r) for r in repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect())
    spans = Counter((r[0], r[1], r[2]) for r in got.elements())
    assert spans == Counter([(1, 60, 140), (1, 0, 80), (None, 30, 110)])
    assert sum(not r[4] for r in got.elements()) == 1
    cut = [r.text for r in cut_repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()]
    assert len(cut) == 4 and sum(common in t for t in cut) == 1


def test_suffixes_with_equal_neighbours():
    """In any cut of the sorted suffixes into batches: runs of more than one node stay, and the first and last run."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    for _ in range(300):
        rows = sorted(zip(rng.integers(0, 9, 25).tolist(), rng.integers(0, 3, 25).tolist(), range(25), strict=True))
        cuts = sorted(rng.integers(0, 26, 4).tolist())
        table = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32()))]
        whole = pa.RecordBatch.from_arrays(table, ["key", "node", "place"])
        batches = [whole.slice(a, b - a) for a, b in zip([0, *cuts], [*cuts, 25], strict=True)]
        got = [tuple(r.values()) for b in _neighbours(iter(batches)) for r in b.to_pylist()]
        nodes = defaultdict(set)
        for k, n, _ in rows:
            nodes[k].add(n)
        ends = {rows[0][0], rows[-1][0]}
        assert sorted(got) == [r for r in rows if len(nodes[r[0]]) > 1 or r[0] in ends]


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    import pytest

    from gaugewell.llm.common import shared_dir

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder, set=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master, None))
    assert shared_dir(session("yarn", "hdfs:///scratch/")) == "hdfs:///scratch" and shared_dir(session("local[2]", None)).startswith("file://")


def test_notes_that_are_lost_are_an_error(spark):
    """A file without notes has none; one that had some must have them."""
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    from gaugewell.llm.common import FILE, ROW, filesystem, located, without_noted

    scratch = Scratch(spark, "notes")
    table = scratch.table(spark.range(40).repartition(4), "rows")
    folder = scratch.notes(located(table).where("id < 3").select(FILE, ROW), "gone")
    assert sorted(r.id for r in without_noted(table, folder).collect()) == list(range(3, 40))
    where, base = filesystem(folder)
    names = [i.base_name for i in where.get_file_info(__import__("pyarrow").fs.FileSelector(base)) if i.base_name != "files"]
    where.delete_file(f"{base}/{names[0]}")
    try:
        without_noted(table, folder).collect()
    except PySparkException as e:
        assert names[0] in str(e)
    else:
        raise AssertionError("no error")
    nothing = scratch.notes(located(table).where(F.lit(False)).select(FILE, ROW), "none")
    assert without_noted(table, nothing).count() == 40
    assert without_noted(table.limit(0), nothing).count() == 0


def test_files_are_ordered_by_their_numbers(spark, tmp_path):
    from gaugewell.llm.common import written_order

    for name, first in (("part-99999-a", 0), ("part-100000-a", 10)):
        spark.range(first, first + 3).coalesce(1).write.parquet(str(tmp_path / "x"))
        made = next((tmp_path / "x").glob("part-*.parquet"))
        (tmp_path / "all").mkdir(exist_ok=True)
        made.rename(tmp_path / "all" / f"{name}.parquet")
        __import__("shutil").rmtree(tmp_path / "x")
    got = written_order(spark.read.parquet(str(tmp_path / "all")), "f", "r").orderBy("f", "r").collect()
    assert [r.id for r in got] == [0, 1, 2, 10, 11, 12]


def test_operators_that_keep_rows_and_names_that_clash(docs, none):
    """Columns stay, whatever they are called; an empty table stays empty."""
    from gaugewell.llm.near_dedup import drop_near_duplicates
    from gaugewell.llm.quality_rules import keep_good

    data = {(r[0], r[1]) for r in rows()}
    for f in (keep_good, drop_near_duplicates, cut_repeated_passages):
        got = f(docs)
        assert got.columns == docs.columns and f(none).columns == docs.columns
        for r in got.collect():
            assert (r.doc_id, r.text) in data or f is cut_repeated_passages
            assert r.label == 4 and r.offset == 15 and r.q_text == 12
        assert f(none).count() == 0
