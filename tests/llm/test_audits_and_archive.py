"""Operators 11 to 13 against brute force, and over nulls, empty tables, repeats and clashing columns."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from test_operators import WORD, odd_documents

from ctxengine.llm import divergence, filter_audit, queries, token_archive

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def documents(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string" + extra)


# --- divergence -----------------------------------------------------------------------------


def brute_divergence(rows, least=30, top=50):
    within, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang or ""].add(source or "")
        within[lang or ""].update(set(terms))
        counts[lang or "", source or ""].update(terms)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in within[lang].items() if n >= least]
        v = len(kept)

        def p(n, v=v, kept=kept):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 5) // (total + 5 * v) for t in kept}

        q = p(sum((counts[lang, s] for s in sources), Counter()))
        ps = {s: p(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode()) for o in sources - {s}]
            terms = [(q[t] - ps[s][t], t.encode()) for t in kept if counts[lang, s][t] and ps[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)}
    return out


def random_rows(n, sources, langs=("en", "de"), seed=3, vocabulary=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéñЖ") for _ in range(r.randint(1, 4))) for _ in range(vocabulary)]
    return [(i, " ".join(r.choice(words).upper() if r.random() < 0.2 else r.choice(words) for _ in range(r.randint(0, 30))), r.choice(langs), f"s{r.randrange(sources)}") for i in range(n)]


def test_divergence_equals_brute_force_over_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 16)  # several chunks and, with 75 groups, three blocks
    rows = random_rows(900, 75)
    got = [tuple(r) for r in divergence.divergence(documents(spark, rows), least=5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, least=5)


def test_divergence_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    for least in (1, 2, 30):
        got = [tuple(r) for r in divergence.divergence(docs, least=least).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, least=least)
    assert any(r[4] == 0 for r in brute_divergence(rows))  # a language without a kept term
    assert not divergence.divergence(odd_documents(spark, False)).count()


def test_terms_are_cut_as_the_pattern_says(spark):
    text = "A_béÉÝx'Y9z\x00q-Rİs t u[v]w`x{y}z\x7fÀ"
    got = {(r["term"], r["n"]) for r in divergence.term_counts(documents(spark, [(1, text, "a", "b")])).collect()}
    assert got == set(Counter(TERM.findall(text.translate(LOWER))).items())


def test_probabilities_are_exact_beyond_floats():
    r = random.Random(1)
    for _ in range(300):
        v = r.randint(1, 10**6)
        n, total = np.array([r.randrange(10**15), 0, 10**15]), np.array([10**15])
        assert divergence.probabilities(n, total, v).tolist() == [1 + 10**9 * (int(x) + 5) // (10**15 + 5 * v) for x in n]


# --- filter audit ---------------------------------------------------------------------------


def brute_audit(rows, labels):
    first = {}
    for i, text, _, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    marks = defaultdict(lambda: (0, 0))
    for i, quality, toxic in labels:
        if i is not None:
            marks[i] = (max(marks[i][0], int(quality == 1)), max(marks[i][1], int(toxic == 1)))
    parts = defaultdict(list)
    for i, text, _, source in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = {f for f, x in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)), ("D", re.search(r"[#$%&*|]", t)), ("E", i is not None and i > first[t])) if x}
        parts[source or ""].append((fails, *(marks[i] if i is not None else (0, 0))))
    out = []
    for part, docs in parts.items():
        shapley, steps = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                kept = [d for d in left if f not in d[0]]
                before = set(order[:k])
                steps.append((f, (part, "".join(order), k + 1, len(kept), len(gone), sum(f in d[0] and bool(d[0] & before) for d in docs), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone))))
                shapley[f] += len(gone)
                left = kept
        out += [(*s, shapley[f]) for f, s in steps]
    return out


LABELS = "doc_id long, quality int, toxic int, text string, n long, part string"


def test_filter_audit_equals_brute_force(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice(["aa", "bb", "Cc", "DD", "e#"] + [f"w{k}" for k in range(k_)]) for _ in range(n)) for n in (0, 5, 199, 200, 201, 300) for k_ in (1, 90, 4000) for _ in range(2)]
    rows = [(r.choice([i, i, i // 2]), r.choice(texts), None, r.choice(["x", "y", "", None])) for i in range(300)]
    labels = [(r.randrange(300), r.choice([0, 1, None]), r.choice([0, 1]), "t", 1, "p") for _ in range(150)] + [(None, 1, 1, "t", 1, "p")]
    got = [tuple(x) for x in filter_audit.audit(documents(spark, rows), spark.createDataFrame(labels, LABELS)).collect()]
    assert Counter(got) == Counter(brute_audit(rows, [x[:3] for x in labels]))


def test_filter_audit_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r["doc_id"], r["text"], None, r["source"]) for r in docs.collect()]
    labels = [(1, 1, 0), (1, 0, 1), (4, 1, 1), (None, 1, 1), (77, 1, 1)]
    got = [tuple(x) for x in filter_audit.audit(docs, spark.createDataFrame([(*x, "t", 1, "p") for x in labels], LABELS)).collect()]
    assert Counter(got) == Counter(brute_audit(rows, labels))
    assert not filter_audit.audit(odd_documents(spark, False), spark.createDataFrame([], LABELS)).count()
    assert filter_audit.audit(docs, spark.createDataFrame([], LABELS)).count() == 600 * len({r[3] or "" for r in rows})


def test_pairs_and_orders_of_filters():
    assert len(filter_audit.subset_pairs()) == 80 and sum(w for *_, w in filter_audit.subset_pairs()) == len(filter_audit.order_steps()) == 600


# --- token archive --------------------------------------------------------------------------


def samples():
    g = np.random.default_rng(2)
    yield from ([], [5], [2**32 - 1, 0, 7, 7, 7], [3] * 9000, [1, 2, 3, 4] * 3000, list(range(10_000)))
    yield g.integers(0, 2**32, 9000)  # no id twice: the largest alphabets
    yield g.zipf(1.3, 30_000) % 49_408
    yield np.tile(g.integers(0, 49_408, 500), 30)


@pytest.mark.parametrize("k", range(9))
def test_frames_round_trip(k, monkeypatch):
    ids = np.array(list(itertools.islice(samples(), k, k + 1))[0]).astype("<u4")
    assert (token_archive.decode_frame(token_archive.encode_frame(ids)) == ids).all()
    monkeypatch.setattr(token_archive, "LANES", 3)
    assert token_archive.encode_frame(ids, 1000) and (token_archive.decode_frame(token_archive.encode_frame(ids, 1000)) == ids).all()


def test_unlikely_ids_after_long_runs_round_trip():
    g = np.random.default_rng(12)
    for _ in range(20):  # weights and counts that have grown leave an id next to no room
        ids = np.full(4096 * 3, 7, "<u4")
        at = g.integers(0, len(ids), g.integers(1, 900))
        ids[at] = g.integers(0, 49_408, len(at))
        assert (token_archive.decode_frame(token_archive.encode_frame(ids)) == ids).all()


def test_repeating_ids_are_predicted_and_skewed_ones_cost_their_entropy():
    g = np.random.default_rng(4)
    again = np.tile(g.integers(0, 49_408, 200), 400).astype("<u4")
    assert len(token_archive.encode_frame(again)) < 0.25 * len(again)  # orders 1 and 2: about a bit for each id and the alphabet
    skewed = np.minimum(g.geometric(0.05, 100_000), 200).astype("<u4")
    p = np.bincount(skewed) / len(skewed)
    bits = -(p[p > 0] * np.log2(p[p > 0])).sum()
    assert len(token_archive.encode_frame(skewed)) * 8 < (bits + 0.5) * len(skewed)


def test_blocks_are_independent_and_damage_is_found():
    g = np.random.default_rng(6)
    ids = (g.zipf(1.3, 12_000) % 3000).astype("<u4")
    data = token_archive.encode_frame(ids, 4096)
    part = token_archive.encode_frame(ids[4096:8192], 4096)
    alphabet = int.from_bytes(part[24:28], "little")  # a block's bytes don't depend on its neighbours
    assert part[36 : 36 + alphabet] in data and part[36 + alphabet :] in data
    for at in (17, 90, len(data) // 2, len(data) - 40):
        broken = bytearray(data)
        broken[at] ^= 0x5A
        with pytest.raises(ValueError):
            token_archive.decode_frame(bytes(broken))


def test_what_orders_1_and_2_name_is_worked_out_for_all_ids_at_once():
    g = np.random.default_rng(11)
    ids = np.concatenate([np.minimum(g.geometric(0.3, (40, 300)), 9), g.integers(0, 4096, (2, 300)), np.tile(g.integers(0, 9, 6), (1, 50))]).astype(np.uint16)
    keys = token_archive._keys(ids)
    for row, got in zip(ids.tolist(), keys.tolist(), strict=True):
        one, two, before = {}, {}, (0, 0)
        for x, key in zip(row, got, strict=True):
            c1, c2 = before[1], (before[1] * 1031 + before[0] * 2531) % 65536 >> 4
            (id1, sure1), (id2, sure2) = one.get(c1, (0, 0)), two.get(c2, (0, 0))
            assert key == 8 * sure2 + 2 * sure1 + (id1 == id2) + (32 if x == id2 else 64 if x == id1 else 0)
            one[c1], two[c2] = (x, min(3, sure1 + 1) if x == id1 else 1), (x, min(3, sure2 + 1) if x == id2 else 1)
            before = before[1], x


def test_a_carry_goes_back_over_full_words():
    coder = token_archive.Encoder(2, 9)
    coder.words[0, :4] = 5, 2**32 - 1, 2**32 - 1, 2**32 - 1
    coder.at += 4
    coder.low[:] = 2**64 - 1, 7
    coder.code(np.full(2, 1 << 40, np.uint64), np.ones(2, np.uint64), np.ones(2, np.uint64))
    assert coder.words[0, :4].tolist() == [6, 0, 0, 0] and not coder.words[1].any() and coder.low[0] == (1 << 40) - 1


def test_alphabets_of_many_blocks_are_those_of_each():
    g = np.random.default_rng(9)
    parts = [np.unique(g.integers(0, 2**32, n), return_counts=True) for n in (1, 40, 4096)] + [np.unique(g.zipf(1.3, 4096) % 49_408, return_counts=True)]
    ids, counts, distinct = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.array([len(p[0]) for p in parts])
    data = token_archive._alphabets(ids, counts, distinct)
    assert data == [token_archive._alphabet(*p) for p in parts]
    sizes = np.array([p[1].sum() for p in parts])
    got = token_archive._read_alphabets(data, sizes, distinct)
    assert (got[0] == ids).all() and (got[1] == counts).all()
    for k in range(4):
        with pytest.raises(ValueError):
            token_archive._read_alphabets(data, sizes + (np.arange(4) == k), distinct)
        with pytest.raises(ValueError):
            token_archive._read_alphabets([d[:-1] if i == k else d for i, d in enumerate(data)], sizes, distinct)


def test_alphabets_hold_how_often_each_id_occurs():
    g = np.random.default_rng(8)
    for part in (np.array([2**32 - 1, 0, 7, 7], "<u4"), g.integers(0, 2**32, 4096).astype("<u4"), (g.zipf(1.3, 4096) % 49_408).astype("<u4"), np.full(4096, 9, "<u4")):
        ids, no, counts = token_archive._distinct(part, np.zeros(1 << 16, np.uint16))
        assert (ids[no] == part).all()
        data = token_archive._alphabet(ids, counts)
        got = token_archive._read_alphabet(data, len(part), len(ids))
        assert (got[0] == ids).all() and (got[1] == counts).all()
        for wrong in ((data, len(part) + 1, len(ids)), (data[:-1], len(part), len(ids)), (data, len(part), len(ids) + 1)):
            with pytest.raises(ValueError):
                token_archive._read_alphabet(*wrong)
    with pytest.raises(ValueError):
        token_archive.encode_frame(np.zeros(5000, "<u4"), 5000)


def brute_ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")) for i, x in rows]


ODD_TEXTS = [
    None, "", " ", "Thing, thing. THING!? thing's don't, 'tis", "\t a\x85b\xa0c\u2028d\x0b", "Àéÿ, ÀÉß! µ, ª; ñ\u0303, \xadx\xad",
    "\u212aelvin, İs, e\u0301, thing, ÀB, 漢字, ж, a\u0338, a=\u0338 Thing,", "12,345 a1, ,a, ... #x# <| |>", "x<|endoftext|>y thing", "a\x1cb\x1fc, thing", "thing," * 3000, "end \U0001f600, thing",
]


def test_texts_at_once_have_the_ids_of_the_tokenizer():
    texts = token_archive.TextIds(queries.tokenizer_path())
    want = [i.tolist() for _, i in brute_ids(enumerate(ODD_TEXTS))]
    for rows in (range(12), range(11, -1, -1), [5, 3, 5], [8], [0, 2, 0], [1, 6]):
        ids, each = texts.encode(pa.array([ODD_TEXTS[k] for k in rows], pa.string()), 1)
        assert [i.tolist() for i in np.split(ids, np.cumsum(each)[:-1])] == [want[k] for k in rows]
    cut = pa.array(["no", *ODD_TEXTS, "no"], pa.string()).slice(1, len(ODD_TEXTS))
    for kind in (pa.string(), pa.large_string()):  # Spark may send either
        assert texts.encode(cut.cast(kind), 1)[0].tolist() == list(itertools.chain(*want))


def test_known_words_are_not_tokenised_again(monkeypatch):
    texts, called = token_archive.TextIds(queries.tokenizer_path(), 60), []
    call = texts._call
    monkeypatch.setattr(texts, "_call", lambda parts: (called.extend(parts), call(parts)))
    ids, each = texts.encode(pa.array(["Thing, thing THING! thing", "(thing) other,"]), 1)
    assert sorted(called) == ["!", "(thing)", ",", "other", "thing"] and each.tolist() == [7, 6] and len(ids) == 13
    texts.encode(pa.array(["other! Thing,"]), 1)
    assert len(called) == 5
    want = dict(brute_ids(enumerate(" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}q" for k in range(at, at + 40)) + " thing thing" for at in range(0, 400, 20))))
    for k, more in want.items():  # forgets, but not what occurs most
        text = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(20 * k, 20 * k + 40)) + " thing thing"
        assert texts.encode(pa.array([text]), 1)[0].tolist() == more.tolist() and len(texts.known) <= 60
    assert called.count("thing") == 1
    texts.encode(pa.array(["q" * 65]), 1)
    assert "q" * 65 not in texts.known.to_pylist()


def test_rows_are_joined_and_cut_by_bytes():
    sizes = [3, 0, None, 5, 20, 1, 1, 9, 10, 2]
    rows = pa.record_batch([pa.array(range(10)), pa.array([n if n is None else "x" * n for n in sizes])], names=["id", "text"])
    got = list(token_archive._by_bytes(iter([rows.slice(0, 2), rows.slice(2, 0), rows.slice(2, 6), rows.slice(8)]), "text", 10))
    assert [b.column("id").to_pylist() for b in got] == [[0, 1, 2, 3], [4], [5, 6], [7], [8], [9]]


def check_archive(docs, rows, got):
    at, want = 0, []
    for i, ids in brute_ids(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_token_archive_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [tuple(r) for r in queries.op12_token_archive(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    check_archive(docs, [(r["doc_id"], r["text"]) for r in docs.collect()], got)


def test_token_archive_of_odd_rows_in_small_frames(spark):
    docs = odd_documents(spark).repartition(5)
    path = token_archive.write_archive(docs, queries.tokenizer_path(), frame_ids=50)
    read = token_archive.read_archive(spark, path).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_archive(docs, rows, [tuple(r)[:4] for r in read])
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"] for r in read)
    empty = token_archive.write_archive(odd_documents(spark, False), queries.tokenizer_path())
    assert not token_archive.read_archive(spark, empty).count()
