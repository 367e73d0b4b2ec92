"""Tokens, packing, id files, mixing and chats against brute force and exact round trips."""

import itertools
import random
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from conftest_rows import rows
from tokenizers import Tokenizer

from gaugewell.llm import packing
from gaugewell.llm.chat_format import ASSISTANT, LEGAL, START, format_chats, repair, role_number
from gaugewell.llm.common import Scratch
from gaugewell.llm.mixing import mix_sources, schedule
from gaugewell.llm.packed_ids import Reader, pack_bits, read_packed, unpack_bits, write_packed
from gaugewell.llm.tokens import Encoder

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["a  b\n\nc \n d", "x\t\ty  ", "  lead", "I'll don't we've's 's", " ", "\n", "don' t", "naïve café é  x", "1234 12.5%", "<|endoftext|> a<|startoftext|>b", "日本語 テキスト", "a\r\nb", "Ab'S 'S", "​zero​w", "a　b", "ﬁ ligature Ⅷ²", "각 가", "a ́b", "a, b. c", "a., b", "x_, y", "é, ü. ", "end.", "end,\n", "), x. y", "a.\n\nb, \nc", " . , .", "3.5, 4. 5,5", "\0 a\0b", "Á, b", "K, K", " ,\n", "É été ÉTÉ", "a b", "\x1ca\x85b"]


#: What words and marks around cuts are made of: marks after letters, digits, space and combining marks, case that changes length, special tokens.
PARTS = ["a", "b", "Word", "the", " ", "  ", "\n", "\t", ",", ".", ", ", ". ", " ,", " .", ",\n", ".\n", "\u00c9", "e\u0301", "\u0130", "\u00df", "'s", "'", "1", "42", "\u00b2", "_", "-", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "\ufb01", "\u03a3", "\u0391\u03a3", "\u65e5\u672c", "\u00a0", "\u200b", "\u3000", "\r\n", "\x85", "\u00aa", "\u00b5", "\u00d7", "\u0149", "\u01c5", "\u0307", "\u212a", "\U0001f600", "\u1e9e", "\x00", "\u0301", "\u00bd", "y.z", "...", "I'LL"]


@pytest.mark.parametrize("path,kind", [(WORD, "word"), (BYTE, "byte")])
def test_chunks_give_the_ids_of_the_library(path, kind):
    """Against a tokenizer without any switch: many random texts, the odd ones and every special token."""
    e, tok = Encoder(path, kind), Tokenizer.from_file(path)
    rng = random.Random(4)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    texts = ODD + ["".join(rng.choices(PARTS, k=rng.randint(1, 9))) for _ in range(200_000)] + [r[1] for r in rows() if r[1]]
    texts += [f(x) for s in special for f in (str, str.upper) for x in (s, f"a{s}b", f"a {s} b, ", f"{s}{s}")]
    got = [x for i in range(0, len(texts), 1000) for x in e.batch(texts[i : i + 1000])]
    want = tok.encode_batch(texts, add_special_tokens=False)
    assert [t for t, g, w in zip(texts, got, want, strict=True) if g.tolist() != w.ids] == []
    assert len(e.batch([None, ""])[0]) == 0


def test_best_fit_and_search():
    rng = random.Random(2)
    for capacity, n, low in ((100, 60, 20), (100, 400, 5), (50, 30, 26), (64, 200, 10)):
        counts = Counter(rng.randint(low, capacity) for _ in range(n))
        start = packing.best_fit(counts, capacity)
        end = packing.local_search(start, capacity)
        for bins in (start, end):
            assert all(sum(p) <= capacity for p in bins)
            held = Counter()
            for p, k in bins.items():
                for x in p:
                    held[x] += k
            assert held == counts
        assert sum(end.values()) <= sum(start.values())
    # best fit leaves three bins here, an exchange leaves two: 6+4 and 5+3+2 from 6+3, 5+4 and 2 (capacity 10)
    assert sum(packing.local_search(Counter({(6, 3): 1, (5, 4): 1, (2,): 1}), 10).values()) == 2
    assert len(packing.plan({}, 10)) == 0


def test_search_ends_by_itself_at_every_size():
    """Middle lengths, where best fit is far from the bound; then a thousand and a million times as many documents, in whole."""
    rng = random.Random(3)
    full = lambda c: -(-sum(k * n for k, n in c.items()) // capacity)
    # how far above the bound by volume, and how much of best fit's bins is left
    for capacity, low, high, slack, left in ((2048, 500, 1000, 1.2, 0.97), (2048, 400, 900, 1.03, 0.97), (100, 1, 100, 1.01, 1.0), (100, 20, 45, 1.04, 0.97)):
        few = Counter(rng.randint(low, high) for _ in range(20_000))
        for times in (1, 1000, 1_000_000):
            counts = Counter({k: times * n + rng.randrange(times) for k, n in few.items()})
            bins, held = packing.solve(counts, capacity), Counter()
            for p, k in bins.items():
                assert sum(p) <= capacity and k > 0
                for x in p:
                    held[x] += k
            assert held == counts and sum(bins.values()) <= slack * full(counts) + 2
            assert sum(bins.values()) <= left * sum(packing.best_fit(counts, capacity).values()) + 2


def test_bins_of_one_pattern_exchange():
    end = packing.local_search(Counter({(9, 4, 4): 7}), 20)
    assert sum(n * sum(p) ** 2 for p, n in end.items()) > 7 * 17**2 and sum(n * p.count(9) for p, n in end.items()) == 7


def test_no_exchange_is_left():
    """After the search no move of one or two, and no exchange of one for one or two for one, raises the squared fills."""
    rng = random.Random(8)
    for _ in range(60):
        capacity = 60
        end = packing.local_search(packing.best_fit(Counter(rng.randint(9, 40) for _ in range(30)), capacity), capacity)
        bins = [p for p, n in end.items() for _ in range(n)]
        if len(bins) == -(-sum(map(sum, bins)) // capacity):
            continue
        for a, b in itertools.permutations(bins, 2):
            gifts = [(x,) for x in a] + list(itertools.combinations(a, 2))
            for g in gifts:
                for t in [(), *((x,) for x in b)] + (list(itertools.combinations(b, 2)) if len(g) == 1 else []):
                    d = sum(g) - sum(t)
                    assert not (d > 0 and sum(b) + d <= capacity and sum(b) + d > sum(a)), (a, b, g, t)


def test_sequences_follow_an_order(spark):
    rng = random.Random(5)
    data = [(f"f{i // 500}", i % 500, i, rng.randint(3, 40)) for i in range(4000)]
    df = spark.createDataFrame(data, "file string, row long, doc long, length long").repartition(3)
    got = packing.pack(df, 64, order=("file", "row")).collect()
    assert len(got) == 4000 and got[0].asDict().keys() == {"doc", "length", "sequence_id", "offset"}
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    assert all(sum(r.length for r in v) <= 64 for v in by.values())
    assert len(by) == sum(packing.solve(Counter(d[3] for d in data), 64).values())
    order = [r.doc for k in sorted(by) for r in by[k]]
    assert np.mean([abs(d - i) for i, d in enumerate(order)]) < 250  # of 4000; at random it would be 1333


def test_pack_documents(docs, none):
    got = packing.pack_documents(docs, WORD, capacity=64).collect()
    tok = Tokenizer.from_file(WORD)
    want = Counter()
    for i, t, *_ in rows():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 64)):
            raw = np.array(ids[s : s + 64], "<u4").tobytes()
            want[i, k, s, len(ids[s : s + 64]), zlib.crc32(raw), raw] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(held) == -(-sum(r.length for r in got) // 64)
    assert packing.pack_documents(none, WORD).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 15, 16, 17, 32])
def test_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    data = pack_bits(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and np.array_equal(unpack_bits(data, 1001, bits), ids)


def test_id_files(spark, docs, none):
    scratch = Scratch(spark, "t")
    manifest = write_packed(docs, scratch, BYTE, docs_per_file=7).cache()
    got = sorted(read_packed(manifest).collect(), key=lambda r: r.start)
    assert manifest.count() > 1
    tok = Tokenizer.from_file(BYTE)
    want = Counter((i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 0])) for i, t, *_ in rows())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    first = manifest.orderBy("file").first()
    file = Reader(first.uri)
    assert file.bits == 16 and np.array_equal(file.document(2), np.frombuffer(got[2].ids, "<u4"))
    assert np.array_equal(file.ids(3, 9), np.concatenate([np.frombuffer(r.ids, "<u4") for r in got[:4]])[3:9])
    assert read_packed(write_packed(none, scratch, BYTE)).count() == 0


def test_an_id_of_many_rows(spark):
    """Null and repeated ids that fill several ranges are spread, and the order of ids holds."""
    data = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text {i} " * (i % 7)) for i in range(300)]
    manifest = write_packed(spark.createDataFrame(data, "doc_id long, text string").repartition(3), Scratch(spark, "t"), BYTE, docs_per_file=10).cache()
    assert manifest.agg({"n_docs": "max"}).first()[0] <= 40
    got = sorted(read_packed(manifest).collect(), key=lambda r: r.start)
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    tok = Tokenizer.from_file(BYTE)
    want = Counter((i, tuple([*tok.encode(t, add_special_tokens=False).ids, 0])) for i, t in data)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_blocks_of_a_long_document(spark):
    text = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(2, text), (1, "a")], "doc_id long, text string")
    got = read_packed(write_packed(df, Scratch(spark, "t"), BYTE)).where("doc_id = 2").first()
    assert np.frombuffer(got.ids, "<u4").tolist() == [*Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids, 0]
    assert got.n_tokens > 2 * 65536


def ideal(blocks, weights):
    """Blocks of each source after every slot if all run at once at their shares, by exact steps from end to end."""
    left = [Fraction(n) for n in blocks]
    done = [[Fraction(0)] * len(blocks)]
    for _ in range(sum(blocks)):
        now, time = list(done[-1]), Fraction(1)
        while time:
            on = [s for s, n in enumerate(left) if n]
            total = sum(Fraction(weights[s]) for s in on)
            step = min(time, *(left[s] * total / Fraction(weights[s]) for s in on))
            for s in on:
                x = step * Fraction(weights[s]) / total
                now[s] += x
                left[s] -= x
            time -= step
        done.append(now)
    return done


def test_pfair_bounds():
    """Less than one block from the ideal schedule after any slot, also when sources end."""
    rng = random.Random(6)
    for _ in range(40):
        k = rng.randint(1, 9)
        blocks = [rng.randint(1, 25) for _ in range(k)]
        weights = [rng.choice([rng.randint(1, 30), 0.1 * rng.randint(1, 9), 1 / 3]) for _ in range(k)]
        got, have = list(schedule(blocks, weights)), [0] * k
        for (s, i), want in zip(got, ideal(blocks, weights)[1:], strict=True):
            assert i == have[s]
            have[s] += 1
            assert all(abs(h - x) < 1 for h, x in zip(have, want, strict=True))
        assert have == blocks
    got = list(schedule([50, 5, 0, 7], [0.5, 0.3, 0.1, 0.0]))
    assert {s for s, _ in got[-7:]} == {3} and len(got) == 62 and list(schedule([], [])) == []


def test_weights_hold_over_many_slots():
    for weights in ([1.0, 1.0, 1.0], [0.0001, 0.3, 0.6999], [3.0, 0.7, 0.11, 1e-3]):
        got = np.array([s for s, _ in schedule([60_000] * len(weights), weights)])
        n = np.arange(1, 60_001)  # no source ends before
        for s, w in enumerate(weights):
            assert np.abs(np.cumsum(got[:60_000] == s) - w / sum(weights) * n).max() < 1 + 1e-6


def test_many_sources():
    """Sources that all end at different times cost no more than others."""
    began = time.time()
    blocks = [1 + i % 17 for i in range(100_000)]
    assert sum(1 for _ in schedule(blocks, [n**0.7 for n in blocks])) == sum(blocks)
    assert time.time() - began < 60


def test_mixing(docs, none):
    got = mix_sources(docs, {"s0": 1.0, "s1": 3.0}, block_rows=2).collect()
    assert len(got) == len(rows())
    held = defaultdict(set)
    for r in got:
        held[r.slot].add((r.source, r.block))
    assert sorted(held) == list(range(len(held))) and all(len(v) == 1 for v in held.values())
    assert len({(r.slot, r.place) for r in got}) == len(got)
    order = [next(iter(held[s]))[0] for s in sorted(held)]
    assert order[:4].count("s1") == 3 and order[-1] is None  # a source without a weight comes last
    assert Counter(r.text for r in got) == Counter(r[1] for r in rows())
    assert mix_sources(none).count() == 0


def brute(roles):
    best = [10**9]

    def go(i, s, cost, inserted):
        if cost >= best[0]:
            return
        if i == len(roles) and s == ASSISTANT:
            best[0] = cost
        for t in LEGAL[s]:
            if inserted < 3:
                go(i, t, cost + 3, inserted + 1)
        if i < len(roles):
            for t in (1, 2, 3):
                label = 0 if t == roles[i] else 2
                if t == s:
                    go(i + 1, s, cost + 1 + label, 0)
                if t in LEGAL[s]:
                    go(i + 1, t, cost + label, 0)

    go(0, START, 0, 0)
    return best[0]


def test_role_repair_is_cheapest():
    for n in range(1, 5):
        for roles in itertools.product((1, 2, 3, 4), repeat=n):
            assert repair(list(roles))[0] == brute(list(roles))


def test_chats(spark):
    rng = random.Random(1)
    roles = ["user", "Assistant ", "system", "tool", None]
    data = [(1, i, rng.choice(roles), f"m{i}", 0) for i in range(2000)]
    data += [(k, i, rng.choice(roles), rng.choice([None, "", f"m{i}"]), 0) for k in range(2, 30) for i in range(rng.randint(1, 8))]
    data += [(None, 0, "user", "q", 0), (None, 1, "assistant", "a", 0), (50, 0, "user", "same", 0), (50, 0, "user", "same", 0)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, part int").repartition(4)
    by = defaultdict(list)
    for r in format_chats(df, partitions=12).collect():
        by[r.conv_id].append(r)
    cost = {"keep": 0, "merge": 1, "relabel": 2, "relabel+merge": 3, "insert": 3}
    for conv, got in by.items():
        got.sort(key=lambda r: r.position)
        own = sorted((x for x in data if x[0] == conv), key=lambda x: x[1])
        assert sum(cost[r.action] for r in got) == repair([role_number(x[2]) for x in own])[0]
        assert [r.text for r in got if r.action != "insert"] == [x[3] or "" for x in own]
        turns = [r for r in got if "merge" not in r.action]
        assert [r.turn_no for r in turns] == list(range(len(turns)))
        seq = [r.role for r in turns]
        seq = seq[1:] if seq[0] == "system" else seq
        assert seq and len(seq) % 2 == 0 and seq == ["user", "assistant"] * (len(seq) // 2)
        text = "".join(r.rendered for r in got)
        assert text.count("<|end|>") == len(turns) and text.endswith("<|end|>\n")
    assert "".join(r.rendered for r in by[None]) == "<|user|>\nq\n<|end|>\n<|assistant|>\na\n<|end|>\n"
    assert format_chats(df.where("false")).count() == 0
    assert set(by) == {x[0] for x in data}


def test_chats_with_null_turns_and_a_very_long_text(spark):
    long = "word " * 400_000
    data = [(1, None, "user", "first"), (1, 0, "assistant", long), (1, 1, "user", None), (2, None, None, None)]
    got = format_chats(spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)
    assert [(r.source_turn, r.role, r.action) for r in one] == [(None, "user", "keep"), (0, "assistant", "keep"), (1, "user", "keep"), (None, "assistant", "insert")]
    assert one[1].text == long and one[2].text == ""
    assert [(r.role, r.action) for r in got if r.conv_id == 2] in ([("user", "relabel"), ("assistant", "insert")], [("user", "insert"), ("assistant", "relabel")])
