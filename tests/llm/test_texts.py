"""Classifiers, scans and decontamination on made-up texts, against brute force or held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid, licenses, quality, toxicity
from millrace.llm.decontaminate import decontaminate, runs, selected, word_hashes

EDGES = [None, "", " \n\t", "!!!", "7", "word", "漢字", "WORD " * 20_000, "a\x00b", "x" * 70_000, "ß É ñ K İ"]
LOW = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
WORDS = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", LOW(t))


def documents(spark, texts, **columns):
    names = list(columns)
    rows = [(i, t, *(columns[n][i] for n in names), 1.5, "s") for i, t in enumerate(texts)]
    kinds = {"lang": "string", "toxic": "int"}
    return spark.createDataFrame(rows, "doc_id long, text string, " + "".join(f"{n} {kinds[n]}, " for n in names) + "score double, prints string")


# --- decontamination -------------------------------------------------------------------------


def brute_hits(docs, items):
    windows = {}
    for i, t in items:
        w = WORDS(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for t in docs:
        w, hit, found = WORDS(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    found |= windows[tuple(w[s : s + n])]
                    hit |= set(range(s, s + n))
        found = sorted(str(i) for i in found if i is not None)
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_against_every_window(spark):
    rng = random.Random(1)
    say = lambda n, k=40: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    items = [(i, say(rng.choice([3, 9, 10, 11, 25, 60]), 4_000)) for i in range(40)]
    items += [(40, "The, quick-brown FOX"), (41, "one"), (42, None), (43, "..."), (44, items[4][1]), (4, items[4][1]), (None, say(15, 4_000)), (45, "r " * 30)]
    texts = list(EDGES) + ["r " * 25, "r " * 9, "the quick brown fox; the QUICK brown fox", "x one y"]
    for _ in range(250):
        cut = WORDS(rng.choice(items)[1])
        a = rng.randrange(max(1, len(cut)))
        texts.append(f"{say(rng.randrange(30))} {'. '.join(cut[a : a + rng.randrange(1, 30)]).upper()} {say(rng.randrange(30))}")
    got = decontaminate(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_hits(texts, items)
    assert len(got) == len(texts) and sum(w[4] for w in want) > 50
    for r in got:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want[r["doc_id"]], (texts[r["doc_id"]] or "")[:80]


def test_decontamination_of_repeated_ids_and_empty_tables(spark):
    text = " ".join(f"p{i}" for i in range(12))
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    twice = spark.createDataFrame([(5, text), (5, "clean"), (5, text), (None, text)], "doc_id long, text string")
    assert sorted(r["n_hit"] for r in decontaminate(twice, bench).collect()) == [0, 12, 12, 12]
    assert decontaminate(twice.limit(0), bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate(twice, bench.limit(0)).collect())


def test_selected_grams_depend_on_their_window_only():
    rng = np.random.default_rng(2)
    for _ in range(200):
        span = rng.integers(1, 5, 10).astype(np.uint64)
        places = []
        for lead in (0, 3, 17):
            h = np.concatenate([rng.integers(1, 5, lead).astype(np.uint64), span, rng.integers(1, 5, 8).astype(np.uint64)])
            grams = runs(h, 5)
            places.append({int(x) - lead for x in selected(grams, np.ones(len(grams), bool)) if lead <= x <= lead + 5})
        assert set.intersection(*places)


def test_word_hashes_cut_words_as_told():
    h, starts = word_hashes([b"", "Ab-ab É_é".encode(), b"1 1"])
    assert np.diff(starts).tolist() == [0, 4, 2] and h[0] == h[1] and h[4] == h[5] and len(set(h.tolist())) == 4


# --- licenses --------------------------------------------------------------------------------


def test_license_scan_against_regular_expressions(spark):
    rng = random.Random(3)
    names = ["MIT License", "Apache License, Version 2.0", "GNU General Public License, version 3", "GNU Lesser General Public License v2.1", "CC BY-NC 4.0", "BSD 3-Clause", "Mozilla Public Licence 2.0", "public domain", "SPDX-License-Identifier: GPL-2.0-or-later", "general public license"]
    texts = list(EDGES) + ["mit license mit license", "Licensed under the MIT License. Released under the terms of the Apache License", "MIT  LICENSE\nmit-license", "permit license mit licenses"]
    for _ in range(120):
        texts.append(" ".join(rng.choice([rng.choice(names), "licensed under", "the", "some word", "Released under the"]) for _ in range(rng.randrange(12))))
    table = [(p, k, re.compile(f" {x}(?= |$)"), label) for p, k, x, label in licenses.rules()]
    assert len(table) > 200 and [r[0] for r in licenses.rules()] == sorted(r[0] for r in licenses.rules())
    got = {r["doc_id"]: r for r in licenses.license_scan(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = WORDS(t)
        base = sorted((j, label) for phrase, label in licenses.BASE for j in range(len(w)) if w[j : j + len(phrase.split())] == phrase.split())
        flat = "".join(f" {x}" for x in w)
        found = sorted({(flat[: m.start()].count(" "), -(flat[: m.end()].count(" ")), p, label) for p, k, x, label in table if f" {k}" in flat for m in x.finditer(flat)})
        kept = [d for n, d in enumerate(found) if not any(-e[1] >= -d[1] and e[2] <= d[2] for e in found[:n])]
        labels = sorted({x for _, x in base} | {d[3] for d in kept})
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(base), base[0][0] if base else None, base[-1][0] if base else None), (t or "")[:60]
        assert r["base_labels"] == ",".join(sorted({x for _, x in base})) and r["labels"] == ",".join(labels), t
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(labels)
        assert [(d["start"], d["end"]) for d in r["detections"]] == [(d[0], -d[1]) for d in found]
    assert licenses.license_scan(documents(spark, [])).count() == 0


# --- languages -------------------------------------------------------------------------------

SYLLABLES = {"xa": ["ka", "to", "mi", "ren", "shu"], "xb": ["bra", "gne", "oul", "ette", "ix"], "xc": ["жи", "ло", "ме", "ра"], "xd": ["шо", "ве", "ну", "ти"]}


def say(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def test_languages_and_their_spans(spark):
    rng = random.Random(4)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(400)]
    texts = [say(rng, k, rng.randrange(3, 60)) + ". 12!" for k in langs]
    docs = documents(spark, texts, lang=langs)
    model = langid.train(docs.filter(langid.fold("doc_id", 3) != 1))
    assert model.langs == sorted(SYLLABLES)
    mixed = [f"{say(rng, 'xa', 30)} {say(rng, 'xb', 20)}", f"{say(rng, 'xc', 10)} {say(rng, 'xa', 30)} {say(rng, 'xd', 15)}"]
    got = {r["doc_id"]: r for r in langid.identify(documents(spark, texts + mixed + EDGES), model).collect()}
    held = [i for i in range(400) if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["lang_pred"] == langs[i] for i in held) / len(held) > 0.97
    first, second = got[400], got[401]
    assert [s["lang"] for s in first["spans"]] == ["xa", "xb"] and abs(first["spans"][0]["last"] - 29) <= 2 and first["lang_pred"] == "xa"
    assert [s["lang"] for s in second["spans"]] == ["xc", "xa", "xd"] and second["lang_pred"] == "xa" and 0 < second["score"] < 1
    edges = [got[402 + i] for i in range(len(EDGES))]
    assert [r["lang_pred"] == "und" for r in edges] == [True, True, True, True, True, False, False, False, False, False, False]
    assert all(r["score"] == 0 and r["spans"] == [] for r in edges[:5])


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    scores = rng.normal(size=(30, 3)).astype(np.float32) * 3
    lengths = np.array([6, 4, 4, 1, 0])
    ids = rng.integers(0, 30, lengths.sum())
    got = langid.viterbi(scores, ids, lengths, 2.0)
    at = 0
    for n in lengths:
        s = scores[ids[at : at + n]]
        value = lambda path: sum(s[t, k] for t, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        paths = np.stack(np.meshgrid(*[range(3)] * n), -1).reshape(-1, n) if n else [()]
        assert np.isclose(value(got[at : at + n]), max(value(p) for p in paths), atol=1e-4)
        at += n


def test_languages_without_training_rows(spark):
    none = documents(spark, ["abc"], lang=[None])
    model = langid.train(none)
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(none, model).collect()] == [("und", 0.0)]
    assert langid.identify(none.limit(0), model).count() == 0


# --- toxicity --------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    bad = ["vilekopf", "dregsy", "oafling", "snivelo"]
    texts, toxic = [], []
    for _ in range(900):
        w = say(rng, rng.choice(["xa", "xb"]), rng.randrange(20, 120)).split()
        t = rng.random() < 0.3
        for _ in range(rng.randrange(2, 5) * t):
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice(["you", "YOU", "du"]), rng.choice(bad) + rng.choice(["", "", "ka", "!!"])]
        texts.append(" ".join(w))
        toxic.append(int(t))
    docs = documents(spark, texts, toxic=toxic)
    held = (F.crc32(F.col("doc_id").cast("string")) % 5) == 0
    model = toxicity.train(docs.filter(~held))
    got = toxicity.score(docs.filter(held), model).join(docs.select(F.col("doc_id").alias("d"), "toxic"), F.col("d") == F.col("doc_id")).collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) / len(got) > 0.96
    again = toxicity.train(docs.filter(~held))
    assert np.array_equal(again.lexicon, model.lexicon) and np.array_equal(again.knots[1], model.knots[1])
    edges = toxicity.score(documents(spark, EDGES), model).collect()
    assert len(edges) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in edges)
    assert toxicity.score(documents(spark, []), model).count() == 0


@pytest.mark.parametrize("labels,want", [([0, 0, None], 0.0), ([1, 1, None], 1.0), ([None, None, None], 0.0)])
def test_toxicity_without_both_classes(spark, labels, want):
    docs = documents(spark, ["a b", "c", None], toxic=labels)
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs)).collect()} == {want}


def test_isotonic_is_the_closest_rising_function():
    rng = np.random.default_rng(7)
    m = np.sort(rng.normal(size=60))
    y = (rng.random(60) < 1 / (1 + np.exp(-2 * m))).astype(float)
    x, p = toxicity.isotonic(m, y)
    assert (np.diff(p) > 0).all() and (np.diff(x) > 0).all()
    # Least squares by the min-max formula.
    means = [max(min(y[a : z + 1].mean() for z in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert np.allclose(sorted(set(np.round(means, 9))), np.round(p, 9))


# --- quality ---------------------------------------------------------------------------------


def test_posterior_finds_who_is_right():
    rng = np.random.default_rng(8)
    truth = rng.random(20_000) < 0.7
    right = [0.9, 0.85, 0.8, 0.6, 0.95]
    cast = np.stack([np.where(rng.random(len(truth)) < 0.2, 2, np.where(rng.random(len(truth)) < r, truth, ~truth)) for r in right], axis=1)
    patterns, inverse, counts = np.unique(cast, axis=0, return_inverse=True, return_counts=True)
    p = quality.posterior(patterns, counts.astype(float))[inverse.ravel()]
    votes = (cast == 1).sum(axis=1) >= (cast == 0).sum(axis=1)
    assert ((p > 0.5) == truth).mean() > max(0.93, (votes == truth).mean())
    assert len(quality.posterior(np.empty((0, 5), int), np.empty(0))) == 0


def test_quality_tells_junk_from_prose(spark):
    rng = random.Random(9)
    texts, good = [], []
    for i in range(300):
        lines = [say(rng, "xa", rng.randrange(20, 40)).capitalize() + "." for _ in range(4)]
        prose = " ".join(" ".join(x.split()[:2] + ["the", "of", "and"] + x.split()[2:]) for x in lines)
        kind = i % 6
        junk = {0: "\n".join(" ### ".join(lines[0].split()) for _ in range(5)), 1: ("Buy " * 200).upper()}.get(kind)
        texts.append(junk or prose.replace(". ", ".\n"))
        good.append(junk is None)
    got = {r["doc_id"]: r for r in quality.quality(documents(spark, texts + EDGES)).collect()}
    assert sum(got[i]["predicted"] == g for i, g in enumerate(good)) / len(good) > 0.95
    assert len(got) == 300 + len(EDGES) and all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 and len(r["votes"]) == 9 for r in got.values())
    assert quality.quality(documents(spark, [])).count() == 0


def plain_votes(text):
    """The labellers one by one, as their table says."""
    w, lines = text.split(), [x.strip() for x in text.split("\n") if x.strip()]
    n, chars = len(w), sum(map(len, w))
    letters, alnum = sum(c.isalpha() for x in w for c in x), sum(c.isalnum() for x in w for c in x)
    if not n:
        return [2, 2, 2, 2, 2, 2, 2, 0, 2]
    words = [x.strip(".,;:!?()[]\"'").lower() for x in w]
    symbol, capital, length = (chars - alnum) / chars, sum(c.isupper() for x in w for c in x) / max(letters, 1), chars / n
    variety, known = len(set(words)) / n**0.85, sum(x in quality.FUNCTION_WORDS for x in words) / n
    ended, fresh = sum(bool(re.search(r"[.!?。！？]['\")\]]?$", x)) for x in lines) / max(len(lines), 1), len(set(lines)) / max(len(lines), 1)
    runs_ = sum(len(re.findall(r"[^\w\s]{2,}", x)) for x in w) / n
    table = [
        (symbol < 0.08, symbol > 0.15), (capital < 0.15, capital > 0.4), (n >= 20 and variety > 0.5, n >= 20 and variety < 0.25), (3 <= length <= 9, length < 2 or length > 14),
        (ended > 0.6, ended < 0.2), (n >= 20 and known > 0.08, n >= 20 and known < 0.02), (len(lines) > 2 and fresh > 0.95, fresh < 0.7), (n >= 60, n < 15), (runs_ < 0.01, runs_ > 0.1),
    ]
    return [1 if good else 0 if bad else 2 for good, bad in table]


def test_votes_against_plain_labellers(monkeypatch):
    rng = random.Random(14)
    say_ = lambda n: " ".join(rng.choice(["the", "and", "Word", "caps", "LOUD", "a--b", "??!", "end.", "x1", "der", "don't", "(so)", "ünï", "123,"]) + rng.choice(["", "", ".", ",", "!!"]) for _ in range(n))
    texts = [t or "" for t in EDGES] + ["\n".join(say_(rng.randrange(12)) for _ in range(rng.randrange(9))) for _ in range(300)] + ["same line.\n" * 9, "A b.\n" * 3 + "c d e."]
    tokens = quality.Tokens()
    for memory in (500_000, 20):
        monkeypatch.setattr(quality, "MEMORY", memory)
        for i in range(0, len(texts), 37):
            some = texts[i : i + 37]
            assert quality.votes(tokens, some, tokens.ids(some)).tolist() == [plain_votes(t) for t in some]


def test_shares_are_bounded_and_add_up():
    at, share = quality.shares(np.array([3, 3, 3, 65_535, 0, 0]))
    assert at.tolist() == [0, 3, 65_535] and np.allclose(share, [2 / 6, 3 / 6, 1 / 6]) and len(quality.shares(np.empty(0, np.int64))[0]) == 0


def test_quality_of_repeated_and_null_ids(spark):
    rows = [(None, "good words here.\n" * 3), (None, None), (7, "x"), (7, "x"), (None, "")]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), sample=2).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == ["7", "7", "None", "None", "None"]


# --- features and trees of toxicity, by brute force -------------------------------------------


def test_features_against_plain_counts():
    rng = random.Random(15)
    words = ["you", "vile", "VILEST", "ok", "fine!!", "a.b", "h3llo", "soooo", "w", "DU", "kind,", "x1y", "-", "vile."]
    texts = [""] + [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(200)]
    model = toxicity.Model(strong=2.0)
    for stem, weight in (("vile", 2.5), ("kind", 1.0)):
        model.lexicon[toxicity.grams([stem])[1]] = weight
    got = toxicity.Tokens(model).features(texts)
    for text, row in zip(texts, got, strict=True):
        w = text.split()
        cores = [toxicity.core(t) for t in w]
        weight = [max([0.0, *model.lexicon[toxicity.grams([c])[1]].tolist()]) for c in cores]
        n, chars, letters = max(len(w), 1), max(sum(map(len, w)), 1), max(sum(c.isalpha() for t in w for c in t), 1)
        you = [i for i, c in enumerate(cores) if c in toxicity.SECOND_PERSON]
        bad = [i for i, x in enumerate(weight) if x > 0]
        caps = sum(len([c for c in t if c.isalpha()]) > 1 and all(c.isupper() for c in t if c.isalpha()) for t in w)
        plain = [
            len(bad) / n, len(bad), sum(weight) / n, sum(x >= 2 for x in weight) / n, sum(x >= 2 for x in weight),
            sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i in bad) / n, len(you) / n, sum(c.isupper() for t in w for c in t) / letters, caps / n,
            sum(not c.isalnum() for t in w for c in t) / chars, text.count("!") / chars,
        ]
        assert np.allclose(row[: len(plain)], plain, atol=1e-5), text
        assert np.isclose(row[-2], np.log1p(len(w))) and np.isclose(row[-1], sum(map(len, w)) / n)


def test_trees_split_where_brute_force_does(monkeypatch):
    """One stump on few rows: the split of most gain among all, and its leaves."""
    monkeypatch.setattr(toxicity, "ROUNDS", 1)
    monkeypatch.setattr(toxicity, "DEPTH", 1)
    rng = np.random.default_rng(16)
    x = np.round(rng.normal(size=(25, 3)), 1)
    y = (x[:, 1] + rng.normal(size=25) * 0.3 > 0).astype(float)
    base, [(feature, threshold, leaf)] = toxicity.boost(x, y)
    q = 1 / (1 + np.exp(-base))
    g, h = y - q, np.full(25, q * (1 - q))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + toxicity.RIDGE)
    splits = [(score(x[:, k] <= c) + score(x[:, k] > c) - score(np.ones(25, bool)), k, c) for k in range(3) for c in (np.unique(x[:, k])[1:] + np.unique(x[:, k])[:-1]) / 2]
    gain = max(s[0] for s in splits)
    assert any(np.isclose(s, gain) and k == feature[0] and np.isclose(c, threshold[0]) for s, k, c in splits)
    for side, value in ((x[:, feature[0]] <= threshold[0], leaf[0]), (x[:, feature[0]] > threshold[0], leaf[1])):
        assert np.isclose(value, toxicity.RATE * g[side].sum() / (h[side].sum() + toxicity.RIDGE))
    assert np.allclose(toxicity.margins([(feature, threshold, leaf)], x, base), base + np.where(x[:, feature[0]] > threshold[0], leaf[1], leaf[0]))
