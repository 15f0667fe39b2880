"""The corpus operators against brute force, and over nulls, empty tables, repeats and clashing columns."""

from __future__ import annotations

import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF, rows_of

from ctxengine.llm import embed_dedup, exact_dedup, html_text, langid, license_scan, minhash, mixing, packing, quality, queries, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, id long, rep string, n long, fp string, size string, pattern string, v string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def odd_documents(spark, rows=True):
    """Nulls in every column, empty and long texts, repeats, ties; further columns with names that operators use."""
    base = words(60)
    texts = [(1, base, "en", "a"), (2, base + " ", "en", "a"), (2, base + " ", "en", "a"), (3, base + " tail", "en", None), (4, None, None, None), (5, "", "en", "a"), (6, " \n\t", "de", "b"), (None, base, "en", "a"), (7, words(30_000, 1), "fr", "b"), (8, "x" * 200_000, "de", "b"), (9, "1234 !!", "en", "c"), (10, "short one", "en", "c")]
    made = [(i, t, la, s, None if t is None else len(t), 7, "r", 1, "f", "s", "p", "v") for i, t, la, s in texts]
    return spark.createDataFrame(made if rows else [], DOC)


def near_brute(docs, similarity=0.8, weighted=True):
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").lower())
        n = min(5, len(w))
        counts = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else Counter()
        sets[i] = {(x, k) for x, c in counts.items() for k in range(c if weighted else 1)}  # a unit of weight each
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for i, s in sets.items():
        for c, n in Counter(o for x in s for o in inverted[x]).items():
            if n / (len(s) + len(sets[c]) - n) >= similarity - 1e-12:
                a, b = find(i), find(c)
                parent[max(a, b)] = min(a, b)
        for x in s:
            inverted[x].append(i)
    return {i: find(i) for i in sets}


def test_near_duplicates(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    r, base = random.Random(5), words(200, 9).split()
    for k in range(60):  # a large group of near copies
        w = list(base)
        w[r.randrange(len(w))] = f"new{k}"
        docs.append((10_000 + k, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = near_brute(docs)
    for block in (minhash.BLOCK, 20_000):  # a small block makes all buckets large
        got = {x["doc_id"]: x["class_id"] for x in minhash.near_classes(df, block=block).collect()}
        assert got == want


def test_near_duplicates_by_weight(spark):
    line, rest = words(6, 3), words(20, 4)
    docs = [(1, f"{line} " * 40 + rest), (2, f"{line} " * 38 + rest), (3, f"{line} " * 9 + rest), (4, f"{line} " * 11 + rest), (5, rest)]
    docs += [(10 + k, " ".join([words(5, 50 + k % 3)] * (10 + k % 4) + words(40, 60 + k % 3).split())) for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for weighted in (True, False):
        got = {x["doc_id"]: x["class_id"] for x in minhash.near_classes(df, weighted=weighted).collect()}
        assert got == near_brute(docs, weighted=weighted)
    assert near_brute(docs)[3] != near_brute(docs)[1] and near_brute(docs, weighted=False)[3] == 1


def test_darts_estimate_weighted_similarity():
    r = np.random.Generator(np.random.PCG64(1))
    a, b = r.integers(0, 2**63, 300).astype(np.uint64), r.integers(0, 2**63, 100).astype(np.uint64)
    x, y = np.concatenate((a, b[:50])), np.concatenate((a, b[50:]))
    wx, wy = r.uniform(0.2, 3, len(x)), r.uniform(0.2, 3, len(y))
    fx, fy = dict(zip(x, wx)), dict(zip(y, wy))
    true = sum(min(fx.get(k, 0), fy.get(k, 0)) for k in {*fx, *fy}) / sum(max(fx.get(k, 0), fy.get(k, 0)) for k in {*fx, *fy})
    s = minhash.dart_signatures([x, y], 4096, [wx, wy])
    assert abs((s[0] == s[1]).mean() - true) < 0.04


def test_embeddings(spark):
    r = np.random.Generator(np.random.PCG64(2))
    centre = r.standard_normal((30, 16))
    rows = [(int(i), (centre[i % 30] + r.standard_normal(16) * 0.2).tolist(), int(i % 3)) for i in range(900)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, rows[3][1], None), (1004, rows[3][1], 0), (1005, [1.0, None] * 8, 0), (1006, [], 0), (None, rows[3][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    usable = [x for x in rows if x[0] is not None and x[1] and x[2] is not None and None not in x[1] and np.isfinite(x[1]).all() and any(x[1])]
    ids, m, lab = np.array([x[0] for x in usable]), np.array([x[1] for x in usable]), np.array([x[2] for x in usable])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = (m @ m.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    comp = ids.copy()
    for _ in range(len(ids)):
        new = np.array([min(comp[i], comp[near[i]].min(initial=comp[i])) for i in range(len(ids))])
        if (new == comp).all():
            break
        comp = new
    exact = math.sqrt(1 - 0.93**2)
    for leaf in (512, 64):
        got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in embed_dedup.near_vectors(df, leaf=leaf).collect()}
        assert all(got[int(i)] == (int(n), int(c)) for i, n, c in zip(ids, near.sum(axis=1), comp))
        assert all(got[i] == (0, i) for i in (1000, 1001, 1002, 1003, 1005, 1006))
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0
    pairs = [(1, [1.0, 0.0], 1, "v"), (2, [0.93, exact], 1, "v"), (3, [1.0, 0.0], 2, "v"), (4, [0.93 - 5e-13, math.sqrt(1 - (0.93 - 5e-13) ** 2)], 2, "v"), (5, [1.0, 0.0], 3, "v"), (5, [1.0, 0.0], 3, "v"), (6, [3e200, 0.0], 3, "v"), (7, [1.0, 0.0, 0.0], 3, "v")]
    odd = spark.createDataFrame([(*x, "leaf") for x in pairs], "vec_id long, embedding array<double>, label int, rep string, leaf string")
    got = sorted((x["vec_id"], x["n_links"], x["component_id"]) for x in embed_dedup.near_vectors(odd).collect())
    norm = lambda v: math.sqrt(sum(c * c for c in v))
    at_threshold = 0.93 / norm([0.93, exact]) >= 0.93
    assert got == [(1, int(at_threshold), 1), (2, int(at_threshold), 1 if at_threshold else 2), (3, 0, 3), (4, 0, 4), (5, 2, 5), (5, 2, 5), (6, 2, 5), (7, 0, 7)]


def test_embedding_recall(spark):
    """Over spread-out and clustered vectors, with leaves so small that many cuts are made."""
    r = np.random.Generator(np.random.PCG64(12))
    spread = r.standard_normal((2000, 32))
    near = spread[:1000] + r.standard_normal((1000, 32)) * 0.28
    tight = r.standard_normal((4, 32))[r.integers(0, 4, 1000)] + r.standard_normal((1000, 32)) * 0.3
    m = np.concatenate((spread, near, tight))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(m)], "vec_id long, embedding array<double>, label int")
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = (m @ m.T >= 0.93).sum(axis=1) - 1
    got = {x["vec_id"]: x["n_links"] for x in embed_dedup.near_vectors(df, leaf=128).collect()}
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.99 * want.sum() > 0


def test_exact_groups(spark):
    got = {(x["doc_id"], x["keep_id"], x["group_size"], x["kept"]) for x in exact_dedup.exact_groups(odd_documents(spark)).collect()}
    assert {(1, 2, 4, False), (2, 2, 4, True), (None, 2, 4, False), (3, 3, 1, True), (4, 6, 3, False), (5, 6, 3, False), (6, 6, 3, True)} <= got
    assert exact_dedup.exact_groups(odd_documents(spark, False)).count() == 0
    kept = exact_dedup.drop_copies(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    assert sorted(x["doc_id"] for x in kept.collect()) == [2, 3, 6, 7, 8, 9, 10]


@pytest.mark.parametrize("n", [1, 7, 3000])
def test_quotient_filters_merge_without_loss(n):
    r = np.random.Generator(np.random.PCG64(n))
    prefix = np.uint64(41 << 58)
    x = (r.integers(0, 2**58, n).astype(np.uint64) >> np.uint64(r.integers(0, 30))) | prefix  # some crowd in few quotients
    parts = []
    for k in range(3):
        some = np.concatenate((r.choice(x, n), np.repeat(x[:1], 5 * k)))
        parts.append(some)
    make = lambda v: exact_dedup.QuotientFilter.of(*np.unique(v, return_counts=True), 6)
    filters = [make(p) for p in parts]
    whole = filters[0].merge(filters[1]).merge(filters[2])
    prints, counts = whole.items()
    assert dict(zip(map(int, prints), map(int, counts))) == Counter(map(int, np.concatenate(parts)))
    assert (np.diff(prints.astype(object)) > 0).all()
    again = make(np.concatenate(parts))
    assert whole.data == again.data  # the same filter, however it was put together
    if n == 3000:
        assert len(again.data) < 14 * len(prints)  # remainders and bits, not whole fingerprints and counts (16 bytes)


def test_quotient_filter_keeps_huge_counts():
    x = np.array([3, 5, 2**58 - 1], np.uint64)
    n = np.array([2**40 + 7, 1, 2**62], np.uint64)
    got = exact_dedup.QuotientFilter.of(x, n, 6).items()
    assert got[0].tolist() == x.tolist() and got[1].tolist() == n.tolist()


def test_repeated_fingerprints(spark):
    r = random.Random(8)
    prints = [r.getrandbits(64) - 2**63 for _ in range(5000)]
    prints += r.choices(prints, k=3000) + [prints[0]] * 500
    df = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(7)
    got = {x["fp"]: x["n"] for x in exact_dedup.repeated_fingerprints(df).collect()}
    assert got == {k: n for k, n in Counter(prints).items() if n > 1}


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op8_warc_archive"])
def test_sql(spark, duck, name):
    assert rows_of(queries.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.sql(queries.SQL[name]).df())


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for i, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            p = ids[at : at + 4096]
            want[i, k, at, len(p), zlib.crc32(np.array(p, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    return len(places), sum(r["length"] for r in rows)


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, total = check_packing(queries.QUERIES["op5_best_fit_packing"](spark, SF).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert n <= -(-total // 4096) + 1
    odd = odd_documents(spark)
    check_packing(packing.pack_documents(odd, queries.tokenizer_path()).collect(), [tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert packing.pack_documents(odd.limit(0), queries.tokenizer_path()).count() == 0


def test_token_ids_of_odd_texts():
    from tokenizers import Tokenizer

    path, r = queries.tokenizer_path(), random.Random(1)
    t, w = Tokenizer.from_file(path), packing.WordIds(path)
    for _ in range(1500):
        s = "".join(r.choice("aB' \n\t<|>endoftxsr1é́ſß \x00\x1c\x85²İ😀日'’…\x7f") for _ in range(r.randint(0, 25)))
        assert np.frombuffer(w.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, s
    assert np.frombuffer(w.encode("a<|endoftext|>B"), "<u4").tolist() == t.encode("a<|endoftext|>B", add_special_tokens=False).ids


def test_ids_are_remembered_for_words_and_their_ends(monkeypatch):
    from tokenizers import Tokenizer

    path, r = queries.tokenizer_path(), random.Random(3)
    t, w = Tokenizer.from_file(path), packing.WordIds(path)
    calls = []
    one = w.tokenizer.model.tokenize
    w.model = type("Model", (), {"tokenize": staticmethod(lambda x: calls.append(x) or one(x))})
    w.encode("Grundlé grundlé, grundlé. (grundlé) grundlé$$$")
    assert len(calls) == 7  # the word, three ends, and the three parts of the chunk in brackets

    w = packing.WordIds(path)
    w.remembered = 5  # what is older is forgotten, the ids stay right
    for _ in range(600):
        s = " ".join("".join(r.choice("abé's1.,!$-…ª²") for _ in range(r.randint(1, 4))) for _ in range(12))
        assert np.frombuffer(w.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, s
        assert len(w) <= 6 and len(w.older) <= 6


def optimum(sizes, room):
    """The least number of bins, by search over sets of pieces."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] + sizes[i] <= room:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_dominance_reduction_keeps_the_optimum():
    r = random.Random(4)
    for _ in range(150):
        sizes = sorted((r.randint(1, 20) for _ in range(8)), reverse=True)
        fixed, left = packing.reduce_instance(dict(Counter(sizes)), 20)
        rest = [k for k, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (optimum(sorted(rest, reverse=True), 20) if rest else 0) == optimum(sizes, 20)


def mix_brute(rows, weights=(5, 2, 1)):
    size = Counter()
    for source, n in rows:
        size[source] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, free, goal = 1.5 * sum(size.values()), list(order), {}
    while free:
        unit = budget / sum(w[s] for s in free)
        over = [s for s in free if unit * w[s] > 2 * size[s] + 1e-9]
        for s in over or free:
            goal[s] = 2 * size[s] if over else unit * w[s]
        budget -= sum(2 * size[s] for s in over)
        free = [s for s in free if s in over] and [s for s in free if s not in over] if over else []
    return size, goal


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").unionByName(odd_documents(spark).select("doc_id", "text", "source"))
    joined = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert sorted(map(str, joined)) == sorted(map(str, again))
    given = [(r["source"], len(WORD.findall(r["text"] or ""))) for r in docs.collect()]
    size, goal = mix_brute(given)
    assert len(joined) == len(given)
    by_target = defaultdict(lambda: [0, 0])
    largest = Counter()
    for source, n in given:
        largest[size[source]] = max(largest[size[source]], n)
    for r in joined:
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        by_target[r["source_size"], round(r["target"], 3)][0] += r["taken"]
    assert {k for k in by_target} == {(size[s], round(goal[s], 3)) for s in goal}
    for (n, target), (taken, _) in by_target.items():
        assert abs(taken - target) <= largest[n]  # whole documents, ten of them in a source
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def mixed_by_source(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, id string, m long, pattern string")
    out, kept = defaultdict(lambda: [0, 0.0]), mixing.take_mix(df)
    for r in mixing.mix_sources(df).collect():
        out[r["source_size"]][0] += r["taken"]
        out[r["source_size"]][1] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert kept.columns == df.columns
    words_kept = Counter()
    for r in kept.collect():
        words_kept[r["source"]] += len(WORD.findall(r["text"]))
    assert sorted(words_kept.values()) == sorted(taken for taken, _ in out.values() if taken)
    return out


@pytest.mark.parametrize("ident", [lambda i: None, lambda i: 7, lambda i: i])
def test_mixing_takes_rows_not_ids(spark, ident):
    rows = [(ident(i), "w " * 10, "b", "i", 1, "p") for i in range(100)] + [(1000 + i, "v " * (i + 1), "a", "i", 1, "p") for i in range(80)]
    got = mixed_by_source(spark, rows)
    assert abs(got[1000][0] - got[1000][1]) <= 5 and abs(got[3240][0] - got[3240][1]) <= 1


def test_mixing_fills_the_gap_with_short_documents(spark):
    rows = [(0, "long " * 2000, "a", "i", 1, "p")] + [(i, "w " * (1 + i % 4), "a", "i", 1, "p") for i in range(1, 4000)] + [(5000 + i, "x " * 9, "b", "i", 1, "p") for i in range(300)]
    for source_size, (taken, target) in mixed_by_source(spark, rows).items():
        assert abs(taken - target) <= 4.5, source_size


def test_mixing_overlapping_sources(spark):
    from pyspark.sql import functions as F

    rows = [(i, "w " * (1 + i % 7), ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b", None]) for i in range(600)] + [(9999, "w w", None), (9998, None, ["a"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, s array<string>")
    sized = mixing.sizes_of(df, F.col("s"))
    weights = {"a": 3, "b": 1, None: 1}
    got = mixing.mix_sized(sized, weights).collect()
    assert len(got) == 602 and all(r["taken"] == 0 for r in got if r["id"] >= 9998)
    totals = Counter()
    for r in got:
        totals[tuple(r["pattern"])] += r["taken"]
    supply = Counter()
    for r in got:
        supply[tuple(r["pattern"])] += r["size"]
    sources = {r["source"]: r["quota"] for r in mixing.decide(sized, weights)[0].collect()}
    flow = mixing.min_cost_flow({p: n for p, n in supply.items() if p}, sources)
    for p in supply:
        assert abs(totals[p] - sum(n for (q, _), n in flow.items() if q == p)) <= 4


def test_mixing_many_sources(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "repeat('w ', cast(id % 37 + 1 AS int)) AS text", "concat('s', lpad(cast(id % 20000 AS string), 6, '0')) AS source")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 40_000
    size, goal = mix_brute([(f"s{i % 20000:06}", i % 37 + 1) for i in range(40_000)])
    taken = Counter()
    want = Counter((size[s], round(goal[s], 6)) for s in goal)
    for r in got:
        taken[r["source_size"]] += r["taken"]
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == set(want)
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.2)


def brute_flow(supply, quota, most):
    """(words carried, cost) of the best flow, by trying every amount of every arc."""
    arcs = [(p, s) for p in supply for s in p]
    best = (0, 0)

    def go(k, used, filled):
        nonlocal best
        if k == len(arcs):
            total = sum(used.values())
            cost = sum(max(0, used[p] - r * supply[p]) for p in supply for r in range(1, most))
            best = max(best, (total, -cost))
            return
        p, s = arcs[k]
        for n in range(min(most * supply[p] - used[p], quota[s] - filled[s]) + 1):
            used[p] += n
            filled[s] += n
            go(k + 1, used, filled)
            used[p] -= n
            filled[s] -= n

    go(0, Counter(), Counter())
    return best


def test_flow_is_the_cheapest_of_the_greatest():
    r = random.Random(6)
    for _ in range(60):
        patterns = r.sample([("a",), ("b",), ("a", "b"), ("b", "c"), ("a", "c")], 3)
        supply, quota = {p: r.randint(0, 3) for p in patterns}, {s: r.randint(0, 5) for s in "abc"}
        flow = mixing.min_cost_flow(supply, quota)
        used = Counter()
        for (p, _), n in flow.items():
            used[p] += n
        got = (sum(flow.values()), -sum(max(0, used[p] - supply[p]) for p in supply))
        assert got == brute_flow(supply, quota, 2)


def test_flow_over_many_sources_is_quick():
    import time

    r, n = random.Random(7), 3000
    supply = {}
    for i in range(n):
        supply[(f"s{i}",)], supply[(f"s{i}", f"s{(i + 1) % n}")] = r.randint(1, 99), r.randint(1, 99)
    began = time.perf_counter()
    mixing.min_cost_flow(supply, {f"s{i}": r.randint(1, 300) for i in range(n)})
    assert time.perf_counter() - began < 10


def test_flow_costs_least():
    supply = {("a",): 10, ("a", "b"): 10, ("b",): 10}
    flow = mixing.min_cost_flow(supply, {"a": 20, "b": 10})
    assert sum(n for (_, s), n in flow.items() if s == "a") == 20 and sum(n for (_, s), n in flow.items() if s == "b") == 10
    assert all(sum(n for (q, _), n in flow.items() if q == p) == 10 for p in supply)  # nothing is taken twice


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(got[r["doc_id"]]["held_out"] for r in held) and sum(r["held_out"] for r in got.values()) == len(held)
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    odd = odd_documents(spark)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, langid.prototypes(odd)).collect()}
    assert all(found[i] == ("und", 0.0) for i in (4, 5, 6, 9)) and found[7][0] == "fr"
    assert {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}
    assert langid.identify(odd.limit(0), {}).count() == 0


def test_bundling_in_parts_is_whole():
    from ctxengine.llm.langid import Bundler, codes

    c = codes(words(3000))
    whole = Bundler(64).bundle([(0, c)], 1)
    parts = [c[at : at + 502] for at in range(0, len(c) - 2, 500)]
    assert np.array_equal(whole, Bundler(64).bundle([(0, p) for p in parts], 1))


@pytest.mark.parametrize(
    "page",
    [
        "<div class='page has-sidebar'><div class='sidebar'><p>Side</p></div><h1>Title</h1><p>One.</p><p>Two.</p></div>",
        "<form id='all'><div class='header'><h1>Site</h1></div><main><h1>Title</h1><p>One.</p><p>Two.</p></main><form><p>Mail</p></form></form>",
        "<body class='with-sidebar'><article><h1>Title</h1><p>One.</p><p>Two.</p></article><div class='comments'><article class='comment'><p>a</p><p>b</p><p>c</p></article></div></body>",
    ],
)
def test_html_wrappers_stay(page):
    assert html_text.main_text(page) == "Title\nOne.\nTwo."


def test_html(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav>Menu</nav><div class='ad banner'>Buy</div><article><h1>A &amp; B</h1><p>One\n two<br>three <b>bo</b>ld.</p><div class='comments'>Nice!</div><p>End.</p></article><aside>More</aside><footer>&copy;</footer></body></html>"
    plain = "<div>Menu</div>" * 2 + f"<p>{words(40)}.</p><p>Tail</p><script>var a = '<p>x</p>';</script>"
    pages = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", plain, "x"), (5, "u", "<p>never <b closed", "x"), (None, "u", page, "x")], "page_id long, url string, html string, id string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()}
    assert got[1] == got[None] == ("A & B\nOne two three bold.\nEnd.", 30)
    assert got[2] == got[3] == ("", 0) and got[5][0] == "never"
    assert words(40) in got[4][0] and "var" not in got[4][0]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_containers_lose_no_text():
    body = [words(40, n) for n in range(4)]
    ps = "".join(f"<p>{x}</p>" for x in body)
    cards = "".join(f"<article><h3><a href='/{n}'>Card {n}</a></h3><p>Short teaser {n}.</p></article>" for n in range(5))
    got = html_text.main_text(f"<div class='story'><h1>Title</h1>{ps}</div><div>{cards}</div>")
    assert got.startswith("\n".join(["Title", *body]))  # the body stands in a div, the teasers are articles
    many = "".join(f"<article><p>{words(30, n + 9)}</p></article>" for n in range(9))
    got = html_text.main_text(f"<ul>{'<li><a>Menu</a></li>' * 4}</ul><div><h2>Part</h2>{ps}</div><ul>{'<li><a>Menu</a></li>' * 4}</ul>{many}")
    assert "\n".join(["Part", *body]) in got and "Menu" not in got  # also where the teasers are longer together
    assert html_text.main_text(f"<div>Join us</div><div class='ad'>Buy</div><h1>Title</h1><p>Lead.</p><article>{ps}</article>").endswith("\n".join(["Title", "Lead.", *body]))
    assert html_text.main_text(f"<ul>{'<li><a>Menu</a></li>' * 4}</ul><p>Lead.</p><article>{ps}</article><p>End.</p>") == "\n".join(["Lead.", *body, "End."])
    posts = f"<article><h2>A</h2>{ps}</article><article><h2>B</h2><p>Short.</p></article><article><a href='/c'>Another title, all linked</a></article>"
    assert html_text.main_text(posts) == "\n".join(["A", *body, "B", "Short."])
    assert html_text.main_text("<article><a href='/a'>One</a></article><article><a href='/b'>Two</a></article>") == "One\nTwo"


def test_html_spans_by_brute_force():
    r = random.Random(2)
    for _ in range(400):
        lengths, window, threshold = [r.choice([0, 0, 0, 5, 30, 90]) for _ in range(r.randint(0, 14))], r.randint(1, 4), r.choice([1, 60, 120])
        block = [sum(lengths[i : i + window]) for i in range(len(lengths))]
        want = []
        for a in range(len(lengths)):
            for b in range(a + 1, len(lengths) + 1):
                whole = all(block[a:b]) and (a == 0 or not block[a - 1]) and (b == len(lengths) or not block[b])
                if whole and max(block[a:b]) >= threshold:
                    text = [i for i in range(a, b) if lengths[i]]
                    want.append((text[0], text[-1] + 1))
        assert html_text.surges(np.array(lengths, np.int64), window, threshold) == want


@pytest.mark.parametrize("page", ["<a " * 200_000, '<a "' * 100_000, '<a b="' * 100_000, "</a" * 100_000, "<!--" * 100_000, "<script></script " * 30_000, "<" * 100_000, "<p>x" * 50_000, "<div class='ad'>" * 30_000])
def test_html_hostile_pages_take_linear_time(page):
    import time

    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 3


def test_html_keeps_what_one_word_does_not_mark():
    page = "<div class='site-header'>Site</div><article><header><h1>Head</h1><nav><a>Menu</a></nav></header><p class='lead header'>Lead.</p><div class='menu-of-the-day'><p>Soup.</p></div><div class='social-history'>Past.</div><div class='comment-list'>Nice</div>{}<p>End < 3.</p><p><a href='/s'>Source</a></p><footer>By A</footer></article>"
    text = ["Head", "Lead.", "Soup.", "Past.", "End < 3.", "Source"]
    links = "<ul>" + "<li><a href='/x'>More</a></li>" * 4 + "</ul>"
    assert html_text.main_text(page.format("")).split("\n") == text
    assert html_text.main_text(page.format(links)).split("\n") == [*text[:4], *["More"] * 4, *text[4:]]  # a list of links inside the text is text
    assert html_text.main_text("<article><p>Text.</p><div class='menu-of-links'><a href='/a'>A</a></div></article>") == "Text."


def test_html_repeats_and_long_pages(spark):
    long = "<article>" + "".join(f"<p>{words(50, n)}</p>" for n in range(3000)) + "</article>"
    pages = spark.createDataFrame([(1, "u", long, "t"), (1, "u", long, "t"), (2, "v", "<article><p>a&nbsp;b</p></article>", "t")], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert sorted(r["n_chars"] for r in got) == [3, 3000 * 300 - 1, 3000 * 300 - 1]


def test_html_removed_blocks_end_no_text():
    long, ad = words(60), "<div class='ad'>Buy</div>"
    assert html_text.main_text(f"<h2>Title</h2><div class='share'>Share</div><p>{long}</p>{ad}<p>Between.</p>{ad}<p>{words(40, 1)}</p>{ad}<p>End.</p>") == "\n".join(["Title", long, "Between.", words(40, 1), "End."])
    assert html_text.main_text(f"<p>Lead.</p>{ad}<article><p>{long}</p></article>{ad}<p>End.</p>") == "\n".join(["Lead.", long, "End."])
    menu = "<ul>" + "<li><a href='/x'>Menu entry</a></li>" * 5 + "</ul>"
    assert html_text.main_text(f"<div>Top</div>{menu}<p>{long}</p>{menu}<div>Bottom</div>") == long


def test_licences(spark):
    mit = "MIT License\n\nCopyright (c) 2020 A\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software. The above copyright notice and this permission notice shall be included in all copies."
    docs = spark.createDataFrame([(1, mit), (2, "// SPDX-License-Identifier: Apache-2.0\nint x;"), (3, None), (4, "The weather is nice."), (5, "Licensed under the GNU General Public License version 3 or any later version."), (6, "CC BY-NC 4.0"), (7, ""), (8, "All rights reserved.")], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(docs).collect()}
    assert got == {1: ["MIT"], 2: ["Apache-2.0"], 3: [], 4: [], 5: ["GPL-3.0-or-later"], 6: ["CC-BY-NC-4.0"], 7: [], 8: []}
    assert license_scan.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "licenses"),
    [
        ("SPDX-License-Identifier: MIT\nLicensed under the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
        ("# SPDX-License-Identifier: MIT\n# SPDX-License-Identifier: BSD-3-Clause\nimport x", ["MIT", "BSD-3-Clause"]),
        ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0+ */ int x;", ["MIT", "Apache-2.0", "GPL-2.0+"]),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\nOR so", ["GPL-2.0-only", "Classpath-exception-2.0"]),
        ("SPDX-License-Identifier: MIT or Apache-2.0", ["MIT", "Apache-2.0"]),
        ("SPDX-License-Identifier: MIT and see the file.", ["MIT"]),
        ("licensed under GPLv2+", ["GPL-2.0-or-later"]),
        ("GNU GPL v3", ["GPL-3.0-only"]),
        ("License: MIT", ["MIT"]),
        ("Licensed under MIT or Apache-2.0.", ["MIT", "Apache-2.0"]),
        ("This code is under the zlib license.", ["Zlib"]),
        ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
        ("Microsoft Public License (Ms-PL)", ["MS-PL"]),
        ("GNU Lesser General Public License v2.1 or later", ["LGPL-2.1-or-later"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one.", ["MPL-2.0"]),
        ("This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose. The origin of this software must not be misrepresented.", ["Zlib"]),
        ("He studied at MIT, under a licence nobody knows.", []),
        ("CC BY 4.0 for texts, SPDX-License-Identifier: MIT.\nAll else is in the public domain", ["CC-BY-4.0", "MIT"]),
    ],
)
def test_spdx_expressions(text, licenses):
    assert license_scan.scan_text(text)[0] == licenses


def test_unknown_licences_are_unmatched():
    assert license_scan.scan_text("Licensed under the Foo Corp licence.")[2] == ["licence-mention"]
    assert license_scan.scan_text("License: MIT\n\nThe fonts have a licence of their own.")[::2] == (["MIT"], ["licence-mention"])
    assert license_scan.scan_text("The weather is nice.") == ([], [], [], 0)


def test_licence_rules_by_brute_force():
    """Rules in order, each at the first place where some span of whole identifiers matches it and is the one the pattern prefers there."""
    ids = ["ref:MIT", "mit-grant", "mit-notice", "as-is", "copyright", "ref:GPL-3.0", "or-later", "ref:BSD", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "licence-mention", "spdx:X", "ref:GPL", "gnu-free"]
    r = random.Random(5)
    for _ in range(300):
        given = r.choices(ids, k=r.randint(0, 7))
        left, found = list(given), []
        for name, pattern in license_scan.RULES:
            at = 0
            while at < len(left):
                text = "".join(f" {x}" if x else " -" for x in left[at:]) + " "
                m = re.match(f"(?:{pattern})(?= )", text)
                if m:
                    n = m[0].count(" ")
                    found.append((at, name.replace("{1}", next((g for g in m.groups() if g), "") if m.groups() else "")))
                    left[at : at + n] = [None] * n
                at += 1
        want = list(dict.fromkeys(n for _, n in sorted(found))), [x for x in left if x and x not in license_scan.SILENT]
        assert license_scan.match_rules(given) == want


def test_licence_scan_of_odd_tables(spark):
    rows = [(1, "License: MIT", "s"), (1, "License: MIT", "s"), (2, "word " * 200_000 + "Licensed under CC BY 4.0.", "s"), (None, None, "s")]
    got = [(r["doc_id"], r["licenses"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, licenses string")).collect()]
    assert sorted(got, key=str) == sorted([(1, ["MIT"]), (1, ["MIT"]), (2, ["CC-BY-4.0"]), (None, [])], key=str)


def test_every_licence_sentence_has_a_hint(spark):
    from itertools import product
    from re import _parser

    def made(parsed):
        """A text for each choice of branches, with optional parts left out."""
        parts = []
        for op, v in parsed:
            op = str(op)
            if op == "BRANCH":
                parts.append([x for p in v[1] for x in made(p)])
            elif op == "SUBPATTERN":
                parts.append(made(v[3]))
            elif op == "ASSERT":
                parts.append(["0" if v[0] < 0 else x for x in made(v[1])])
            elif op == "MAX_REPEAT":
                parts.append([x * v[0] for x in made(v[2])] if v[0] else [""])
            elif op == "IN":
                parts.append(["0" if str(v[0][1]) == "CATEGORY_DIGIT" else "x" if str(v[0][0]) == "CATEGORY" else chr(v[0][1]) if str(v[0][0]) == "LITERAL" else "0"])
            else:
                parts.append([chr(v) if op == "LITERAL" else "x" if op == "ANY" else ""])
        return ["".join(x) for x in product(*parts)]

    texts = [x for _, p in license_scan.patterns() for x in made(_parser.parse(p))]
    assert all(license_scan.identify_sentence(x) for x in texts)
    apart = [x.replace(" ", "\n * ") for x in texts]
    docs = spark.createDataFrame(list(enumerate(texts + apart)), "doc_id long, text string")
    got = {r["doc_id"]: r["sentence_ids"] for r in license_scan.scan(docs).collect()}
    assert [i for i in got if not got[i]] == []


def test_quality(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0)
    model = quality.train(docs, seen)
    test = quality.score(docs, model).join(labels.join(seen, "doc_id", "left_anti").withColumnRenamed("quality", "y"), "doc_id").collect()
    assert sum((r["quality"] >= 0.5) == (r["y"] == 1) for r in test) >= 0.95 * len(test)
    odd = odd_documents(spark)
    assert quality.score(odd, model).count() == odd.count()
    assert {r["quality"] for r in quality.score(odd, quality.train(odd, labels.limit(0))).collect()} == {0.5}
    assert quality.score(odd.limit(0), model).count() == 0


def test_quality_pool_is_the_corpus(spark):
    rare = [(9000 + i, words(30, i), "en", "rare", 179) for i in range(3)]
    docs = spark.createDataFrame([(i, words(30, i) if i % 2 else "$$ 1234 ## " * 20, "en", "web", 179) for i in range(4000)] + rare, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    features = quality._features(quality._base(docs, "doc_id"))
    sure = quality.Logistic(np.zeros(quality.SHAPES + quality.WORDS + 8), 9.0), quality.Logistic(np.ones(1), 0.0)
    unsure = quality.Logistic(np.zeros(quality.SOURCES + quality.LANGS + quality.LENGTHS), 0.0), sure[1]
    got = quality.surest(features, labels.select("doc_id").toDF("id"), [sure, unsure], [[], []], handed=5000)
    assert {(r["view"], r["label"]) for r in got.collect()} == {(1, 1)}
    assert sorted(r["id"] for r in got.join(features, "key").select("id").collect()) == [*range(400, 4000), 9000, 9001, 9002]
    first = quality.surest(features, labels.select("doc_id").toDF("id"), [sure, unsure], [[], []], handed=4).join(features, "key")
    assert sum(r["id"] >= 9000 for r in first.collect()) == 2  # sources take turns
    few = quality.surest(features, labels.select("doc_id").toDF("id"), [sure, unsure], [[], [r["key"] for r in got.where("key > 0").collect()]], handed=10).collect()
    assert len(few) == 10 and all(r["key"] <= 0 for r in few)


def test_archive_round_trip(spark, tmp_path):
    import base64
    import hashlib

    rows = [(1, "http://a/", "<p>x</p>", "k"), (2, None, "<p>x</p>", "k"), (3, "u\r\nv", None, "k"), (4, "u", "", "k"), (5, "u", "é\r\n\r\ny", "k"), (6, "u", "short", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha256 string")
    archive = warc.write_archive(pages)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.summary(spark, archive).collect()}
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    assert got == {1: ("revisit", 2, 8, digest("<p>x</p>")), 2: ("response", None, 8, digest("<p>x</p>")), 3: ("revisit", 4, 0, digest("")), 4: ("response", None, 0, digest("")), 5: ("response", None, 7, digest("é\r\n\r\ny")), 6: ("response", None, 5, digest("short"))}
    whole = {r["page_id"]: bytes(r["record"]) for r in warc.read_records(spark, archive).collect()}
    assert whole[5].endswith(b"\r\n\r\n" + "é\r\n\r\ny".encode() + b"\r\n\r\n") and whole[1].startswith(b"WARC/1.1\r\nWARC-Type: revisit\r\n")
    small = warc.summary(spark, warc.write_archive(pages, least=100))
    assert {r["record_type"] for r in small.collect()} == {"response"}
    warc.export_warc(spark, archive, str(tmp_path / "out"))
    assert warc.summary(spark, warc.write_archive(pages.limit(0))).count() == 0


def test_odd_documents_near(spark):
    odd = odd_documents(spark)
    got = [(r["doc_id"], r["class_id"]) for r in minhash.near_classes(odd).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (None, None), (7, 7), (8, 8), (9, 9), (10, 10)], key=str)
    assert minhash.near_classes(odd.limit(0)).count() == 0
    assert minhash.drop_near_copies(odd).columns == odd.columns


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = docs.collect()
    kept = {r["doc_id"]: r["text"] for r in given if r["text"] and any(c.isalpha() for c in r["text"])}
    norm = defaultdict(list)
    for i, t in kept.items():
        norm["".join(WORD.findall(t))].append((-len(t), i))
    unique = [(i, kept[i]) for i in sorted(min(v)[1] for v in norm.values())]
    classes = near_brute(unique)
    stay = {i for i, c in classes.items() if i == c}
    now = docs
    for name, stage in pipeline.STAGES[:3]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name
    assert {r["doc_id"] for r in now.collect()} == stay
    mixed = pipeline.STAGES[3][1](spark, now, SF)
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= stay and max(copies.values()) <= 2
    rows = pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == copies
    assert json.dumps(pipeline.ORACLE_SQL) == "null"
    odd = odd_documents(spark)
    for _, stage in pipeline.STAGES:
        odd = stage(spark, odd, SF)
    assert odd.count()


def test_kept_tables_can_be_dropped(spark):
    import os

    from ctxengine.llm import common

    kept = common.keep(spark.range(3).toDF("id"), "some")
    place = f"{common.shared_dir(spark)}/ctxengine/{spark.sparkContext.applicationId}".removeprefix("file:")
    assert kept.count() == 3 and os.path.isdir(place)
    common.drop_kept(spark)
    assert not os.path.isdir(place)
