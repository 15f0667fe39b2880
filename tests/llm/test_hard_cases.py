"""Cases that went wrong once, against brute force."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from ctxengine.llm import embed_dedup, html_text, langid, license_scan, mixing, warc


def brute_vectors(rows, cosine=0.93):
    """(id, links, smallest id reachable) of each row; rows that repeat an id are vectors of their own."""
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([la for _, _, la in rows])
    near = (x @ x.T >= cosine) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    name = np.array([i for i, _, _ in rows])
    while True:
        new = np.array([min(name[i], name[near[i]].min(initial=name[i])) for i in range(len(rows))])
        if (new == name).all():
            return Counter((r[0], int(n), int(c)) for r, n, c in zip(rows, near.sum(axis=1), name, strict=True))
        name = new


def test_vectors_that_share_an_id(spark):
    schema = "vec_id long, embedding array<double>, label int"
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (3, [0.05, 1.0], 0), (4, [-1.0, 0.0], 0)]
    r = np.random.default_rng(3)
    centres = r.standard_normal((12, 16))
    many = [(int(r.integers(0, 60)), (centres[i % 12] + r.standard_normal(16) * 0.2).tolist(), i % 2) for i in range(400)]
    many += [many[k] for k in range(0, 60, 3)]
    for some in (rows, many):
        want = brute_vectors(some)
        got = embed_dedup.near_vectors(spark.createDataFrame(some, schema)).collect()
        assert Counter((g["vec_id"], g["n_links"], g["component_id"]) for g in got) == want
        assert all(g["kept"] == (g["vec_id"] == g["component_id"]) for g in got)
        in_trees = embed_dedup.near_vectors(spark.createDataFrame(some, schema), leaf=64).collect()
        links = sum(n * k for (_, n, _), k in want.items())
        assert 0.99 * links <= sum(g["n_links"] for g in in_trees) <= links


# --- HTML ---------------------------------------------------------------------------------------

P = "A running paragraph that is long enough to be the article of its page, by far, and some more words."
LINKS = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(3))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<nav>m</nav><div class=content><h2>Small</h2><ul>{LINKS}</ul><p>{P}</p><ul>{LINKS}</ul><p>Tiny end.</p></div><div>x</div>", "Small|L|P|L|Tiny end."),
        (f"<article><p>{P}</p><ul>{LINKS}</ul><p>End</p></article>", "P|L|End"),
        (f"<article><p>{P}</p><ul>{LINKS}</ul></article>", "P|L"),
        (f"<article><ul>{LINKS}</ul><p>{P}</p></article>", "P"),  # a menu above the text
        (f"<article><p>{P}</p><section class=social><p>{P}</p></section><p class=related>{P}</p><div class=comments><p>{P}</p></div><div class=share><ul>{LINKS}</ul></div></article>", "P|P|P"),
        (f"<article><p>{P}</p><div class=ad>Buy it, {P}</div><div class='cookie-notice'>{P}</div></article>", "P"),
        ("<article><p>&<b>lt;</b> &lt;b&gt; &amp;lt; &am<i>p;</i></p></article>", "&lt; <b> &lt; &amp;"),
        (f"<div id=wrap><ul>{LINKS}{LINKS}</ul><div class=body><h3>Head</h3><ul>{LINKS}</ul><p>{P}</p><p>Short</p></div><div><ul>{LINKS}</ul></div></div>", "Head|L|P|Short"),
        (f"<table><tr><td><ul>{LINKS}</ul></td><td><h1>Top</h1>{P}<ul>{LINKS}</ul>End</td></tr></table>", "Top|P|L|End"),
    ],
)
def test_html_loses_no_text_of_the_article(page, want):
    """want: lines parted by bars; P is the paragraph and L the three links."""
    lines = [line for w in want.split("|") for line in ({"P": [P], "L": [f"Link {i}" for i in range(3)]}.get(w) or [w])]
    assert html_text.main_text(page).split("\n") == lines


# --- licences -------------------------------------------------------------------------------------


@pytest.mark.parametrize("unit", ["gpl 2 ", "license mit ", "see mit license or gpl version 3 ", "SPDX-License-Identifier: MIT ", "permission is hereby granted ", "gpl-2.0\n\n"])
def test_licence_scan_takes_linear_time(unit):
    began = time.perf_counter()
    license_scan.scan_text(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - began < 20


def slow_match_rules(ids):
    """Rules one match after the other, each time from the start."""
    sequence, found = "".join(f" {i}" for i in ids) + " ", []
    for name, p in license_scan.RULES:
        while m := re.search(f"(?:{p})(?= )", sequence):
            group = next((g for g in m.groups() if g), "") if m.groups() else ""
            found.append((sequence.count(" ", 0, m.start()), name.replace("{1}", group)))
            sequence = sequence[: m.start()] + " -" * m[0].count(" ") + sequence[m.end() :]
    return list(dict.fromkeys(n for _, n in sorted(found))), [i for i in sequence.split() if i != "-" and i not in license_scan.SILENT]


def test_rules_in_one_pass_equal_rules_one_match_at_a_time():
    r = np.random.default_rng(4)
    known = sorted({i for i, _ in license_scan.SENTENCES if "{" not in i}) + ["ref:MIT", "ref:GPL-2.0", "ref:Apache-2.0", "spdx:MIT", "ref:GPL", "or-later"]
    for _ in range(3000):
        ids = [known[k] for k in r.integers(0, len(known), r.integers(0, 12))]
        assert license_scan.match_rules(ids) == slow_match_rules(ids)


def slow_identify(sentence):
    """Each hit against all earlier ones."""
    s = re.sub(r"\s+", " ", license_scan.normalise(sentence))
    found = []
    for ident, pattern in license_scan.patterns():
        for m in re.finditer(pattern, s):
            if any(a < m.end() and m.start() < b for a, b, _ in found) or (ident == "licence-mention" and found):
                continue
            version = next((g for g in m.groups() if g), "") if m.groups() else ""
            if version and "." not in version and "BSD" not in ident:
                version += ".0"
            found.append((m.start(), m.end(), ident.replace("{v}", version)))
    return [i for _, _, i in sorted(found)]


def test_covered_characters_equal_comparing_all_hits():
    r = np.random.default_rng(5)
    words = "licensed under the mit license gpl version 2 or later apache 2.0 bsd 3 clause permission is hereby granted free of charge to any person copyright as is without warranty of any kind gnu general public mozilla cc by sa 4.0 redistributions".split()
    for _ in range(400):
        sentence = " ".join(words[k] for k in r.integers(0, len(words), r.integers(1, 40)))
        assert license_scan._identify(sentence) == slow_identify(sentence)


# --- mixing ---------------------------------------------------------------------------------------


def test_single_sources_by_flow_equal_the_formula(spark):
    r = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(r.integers(0, 30))), None if i % 7 == 0 else f"s{int(r.integers(0, 9)) ** 2}") for i in range(400)]
    sized = mixing.sizes_of(spark.createDataFrame(rows, "doc_id long, text string, s string"), F.array("s"))
    taken = lambda network: {(tuple(x["pattern"]), x["base"], x["rest"]) for x in mixing.decide(sized, mixing.WEIGHTS, network=network)[1].collect()}
    assert taken(100_000) == taken(0) and len(taken(0)) > 5


def test_overlapping_sources_beside_single_ones_solve_alike(spark):
    r = np.random.default_rng(7)
    rows = [(i, " ".join(["w"] * int(r.integers(1, 30))), [["a"], ["b"], ["a", "b"], ["b", "c"], ["d"], ["e"], ["f"]][int(r.integers(0, 7))]) for i in range(300)]
    sized = mixing.sizes_of(spark.createDataFrame(rows, "doc_id long, text string, s array<string>"), F.col("s"))
    weights = {x: i + 1 for i, x in enumerate("abcdef")}
    taken = lambda network: sum(x["base"] * 1_000_000 + x["rest"] for x in mixing.decide(sized, weights, network=network)[1].collect())
    assert taken(100_000) == taken(4)
    with pytest.raises(ValueError, match="one network"):
        taken(1)


# --- archive --------------------------------------------------------------------------------------


def test_a_summary_is_read_from_the_records(spark):
    pages = [(1, "u", "a\r\n\r\nContent-Length: 7\r\n\r\nb é"), (2, "ü\r\nx", "a\r\n\r\nContent-Length: 7\r\n\r\nb é"), (3, None, None), (4, "u", ""), (5, "u", "\r\n\r\n"), (6, "u", "WARC-Type: revisit\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    archive = warc.write_archive(df)
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.summary(spark, archive).collect()}
    size = len(pages[0][2].encode())
    assert got == {1: (size, "revisit", 2), 2: (size, "response", None), 3: (0, "revisit", 4), 4: (0, "response", None), 5: (4, "response", None), 6: (len(pages[5][2]), "response", None)}
    records = warc.read_records(spark, archive)
    for damage in (F.concat("record", F.lit("x").cast("binary")), F.regexp_replace(F.col("record").cast("string"), "sha1:.", "sha1:1").cast("binary")):
        with pytest.raises(Exception, match="does not"):
            warc.parse_records(records.where("page_id = 2").withColumn("record", damage)).collect()


# --- language -------------------------------------------------------------------------------------


def brute_vector(text):
    """The sum over all three-letter windows of the product of their letters' vectors, each rotated by its distance from the end."""
    letters = [c if c.isalpha() else " " for c in text.lower()]
    runs = [" ", *(c for i, c in enumerate(letters) if c != " " or (i and letters[i - 1] != " ")), " "]
    runs = [c for i, c in enumerate(runs) if c != " " or not i or runs[i - 1] != " "]
    of = lambda c: langid._letter_vector(0 if c == " " else ord(c), langid.DIMENSIONS).astype(np.int64)
    out = np.zeros(langid.DIMENSIONS, np.int64)
    for i in range(len(runs) - 2):
        out += np.roll(of(runs[i]), 2) * np.roll(of(runs[i + 1]), 1) * of(runs[i + 2])
    return out


def brute_languages(rows):
    sums = {}
    for _, text, lang in rows:
        if lang is not None and any(c.isalpha() for c in text or ""):
            sums[lang] = sums.get(lang, 0) + brute_vector(text)
    out = {}
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            out[i] = ("und", 0.0)
            continue
        v = brute_vector(text)
        cosines = {k: round(float(v @ s / np.linalg.norm(v) / np.linalg.norm(s)), 9) for k, s in sums.items()}
        best = max(sorted(cosines), key=lambda k: cosines[k])
        out[i] = (best, max(0.0, cosines[best]))
    return out


def test_languages_by_explicit_letter_vectors(spark):
    r = random.Random(11)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(1, 6)))
    rows = [(i, " ".join(word(a) + r.choice(["", ",", " 12 ", "\n"]) for _ in range(r.randint(1, 40))), la) for i, (la, a) in enumerate([("x", "abcdeÄ"), ("y", "defghß"), ("z", "ijklmЖ")] * 30)]
    rows += [(100, None, "x"), (101, "12 !", "y"), (102, "abc", None), (103, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.prototypes(df)
    want = brute_languages(rows)
    for x in langid.identify(df, learned).collect():
        assert x["lang_pred"] == want[x["doc_id"]][0] and abs(x["score"] - want[x["doc_id"]][1]) < 1e-6


def test_the_pipeline_rejects_long_texts_of_no_known_language(spark):
    from conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(3)
    noise = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(300))
    odd = spark.createDataFrame([(-1, noise, None), (-2, noise[:200], None), (-3, "12 34 " * 100, None), (-4, "qzxj " * 200, None)], docs.schema)
    learned = langid.prototypes(docs)
    kept = {x["doc_id"] for x in langid.known_language(docs.unionByName(odd), learned).select("doc_id").collect()}
    lost = {x["doc_id"] for x in docs.select("doc_id").collect()} - kept
    scored = {x["doc_id"]: x for x in langid.identify(docs, learned).join(docs, "doc_id").collect()}
    assert kept & {-1, -2, -3, -4} == {-2}  # too short to be told
    assert all(scored[i]["lang_pred"] == "und" or (scored[i]["score"] < langid.LEAST and len(scored[i]["text"]) >= langid.SURE_FROM) for i in lost) and len(lost) < 0.01 * len(scored)
