"""Operators against brute force, and models on held-out rows."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import decontaminate, jaccard_join, language_id, license_scan, lm_score, queries, quality_classifier, quality_rules, url_filter

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


def brute_components(texts: dict) -> dict:
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i in sorted(sets):
        shared = collections.Counter(o for s in sets[i] for o in holders[s])
        for s in sets[i]:
            holders[s].append(i)
        for o, k in shared.items():
            if 100 * k >= 80 * (len(sets[i]) + len(sets[o]) - k):
                a, b = find(i), find(o)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check_components(spark, texts: dict):
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(df).collect()}
    assert got == brute_components(texts)


def near_copies(seed: int, families: int, members: int, words: int) -> dict:
    rng = random.Random(seed)
    texts = {}
    for _ in range(families):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(words // 2, words))]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randrange(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(5000)}"
            texts[len(texts)] = " ".join(own[rng.randrange(0, 4) :])
    return texts


def test_jaccard_on_tables(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_components(spark, texts)


def test_jaccard_chains(spark):
    """A chain in which only neighbours link, near copies at the threshold, and a passage that all share."""
    texts, passage = {}, " ".join(f"p{i}" for i in range(60))
    for i in range(30):
        texts[i] = " ".join(f"c{k}" for k in range(3 * i, 3 * i + 60))
    for i in range(30, 60):
        texts[i] = passage + " " + " ".join(f"d{i}_{k}" for k in range(40))
    texts |= {100 + i: t for i, t in near_copies(5, 6, 8, 120).items()}
    check_components(spark, texts)


def test_jaccard_splits_large_regions(spark, monkeypatch):
    texts = near_copies(6, 3, 40, 100)
    for limit in ({"MAX_REGION": 500, "PART_SHINGLES": 300}, {"MAX_BLOCK": 5, "MAX_BROADCAST_IDS": 0}):
        for k, v in limit.items():
            monkeypatch.setattr(jaccard_join, k, v)
        check_components(spark, texts)


def test_jaccard_joins_what_pivots_do_not_split(spark, monkeypatch):
    """Texts that are all equally far from each other, and a chain, in regions of several tasks."""
    monkeypatch.setattr(jaccard_join, "MAX_REGION", 500)
    monkeypatch.setattr(jaccard_join, "MAX_BLOCK", 5)
    rng, base = random.Random(3), [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(80):
        own = list(base)
        for k in rng.sample(range(120), 4):
            own[k] = f"n{i}_{k}"
        texts[i] = " ".join(own)
    texts |= {100 + i: " ".join(f"c{k}" for k in range(3 * i, 3 * i + 60)) for i in range(40)}
    check_components(spark, texts)


def test_jaccard_moves_no_text_of_many_documents(spark, monkeypatch):
    """With more ids than are broadcast no text is joined by a shuffle, and the rows are the same, also where others pass the Bloom filters."""
    texts = near_copies(3, 40, 5, 60)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    parts = brute_components(texts)
    want = sorted({c for _, c in parts.values()})
    monkeypatch.setattr(jaccard_join, "MAX_BROADCAST_IDS", 20)
    assert len(want) > 20 and len(parts) - len(want) > 20
    if hasattr(jaccard_join, "Marks"):
        held = jaccard_join.Marks.held
        monkeypatch.setattr(jaccard_join.Marks, "held", lambda self, h: held(self, h) | (h % 7 == 0))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(df).collect()} == parts
    kept = jaccard_join.one_of_each(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert "SortMergeJoin" not in kept._jdf.queryExecution().sparkPlan().toString()


def test_jaccard_pairs_only_what_size_allows(spark):
    """Documents that share their rarest shingles but not their size are no candidates; a chain of sizes keeps its links."""
    words = [f"w{i}" for i in range(400)]
    rows = [(n, " ".join(words[:n])) for n in (40, 100, 110, 125, 150, 400)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute_components(dict(rows)).items()}
    assert got[125] == 100 and got[40] == 40 and got[400] == 400


def test_marks_hold_all_ids_and_few_others(spark):
    made = jaccard_join.marks(spark.range(0, 3_000_000, 3).toDF("i"))
    passed = spark.range(3_000_000).select("id", jaccard_join.marked(spark, made, F.col("id")).alias("m")).filter("m")
    row = passed.agg(F.sum((F.col("id") % 3 == 0).cast("int")).alias("own"), F.sum((F.col("id") % 3 != 0).cast("int")).alias("others")).first()
    assert row["own"] == 1_000_000 and row["others"] < 40_000


def test_jaccard_on_many_near_copies(spark):
    rng = random.Random(21)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base[: rng.randrange(90, 100)], f"z{i}"])) for i in range(20_000)]
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)).select("component_id").distinct().collect()
    assert [r["component_id"] for r in got] == [0]


def test_one_of_each_tells_rows_of_one_id_apart(spark):
    text = lambda k, n=40: " ".join(f"v{k}_{i}" for i in range(n))
    rows = [(3, text("a")), (5, text("a")), (5, text("b")), (5, text("b") + " more"), (7, text("c")), (7, text("d")), (None, text("e")), (None, text("e")), (None, text("a")), (8, None), (8, None), (9, "")]
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()]
    assert len(kept) == 8
    assert {k for k in kept if k[0] != 5} == {(3, text("a")), (7, text("c")), (7, text("d")), (None, text("e")), (8, None), (9, "")}
    assert len([k for k in kept if k[0] == 5]) == 1
    named = spark.createDataFrame([(f"n{i}", t) for i, t in rows], "doc_id string, text string")
    assert {r["component_id"] for r in jaccard_join.components(named).collect() if r["n_shingles"] == 36} == {"n3", "n5", "n7", "nNone"}


def test_bitmaps_never_lose_a_link():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        keep = a[rng.random(len(a)) > 0.1]
        b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if len(b) and shared * 100 >= 80 * (len(a) + len(b) - shared):
            assert jaccard_join.undivided(np.array([len(a), len(b)]), [jaccard_join.parity_bits(a), jaccard_join.parity_bits(b)]).tolist() == [0, 0]


@pytest.mark.parametrize("leaf, pivots", [(16, 8), (3, 2), (2, 1)])
def test_exact_components_on_random_sets(monkeypatch, leaf, pivots):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    rng = random.Random(4)
    for _ in range(60):
        sets = []
        for _ in range(rng.randrange(1, 60)):
            if sets and rng.random() < 0.8:
                own = set(rng.choice(sets).tolist())
                for _ in range(rng.randrange(0, 5)):
                    own ^= {rng.randrange(60)}
            else:
                own = {rng.randrange(60) for _ in range(rng.randrange(1, 30))}
            sets.append(np.array(sorted(own or {1}), np.uint64))
        parent = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                k = len(np.intersect1d(sets[i], sets[j]))
                if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                    a, b = parent[i], parent[j]
                    parent = [min(a, b) if p in (a, b) else p for p in parent]
        assert jaccard_join.exact_components(sets).tolist() == parent
        assert jaccard_join.searched_components(sets).tolist() == parent


def test_spans_on_random_texts():
    rng = random.Random(7)
    for _ in range(100):
        vocabulary = [f"v{i}" for i in range(rng.choice([2, 4, 30]))]
        make = lambda n: [rng.choice(vocabulary).encode() for _ in range(n)]  # noqa: E731, B023
        items = [(str(i), b" ".join(make(rng.randrange(0, 25)))) for i in range(rng.randrange(0, 6))]
        docs = [make(rng.randrange(0, 120)) for _ in range(5)]
        for _, t in items:
            if rng.random() < 0.6:
                docs[rng.randrange(5)] += t.split()
        block = decontaminate.Items(items)
        for words, spans, windows in zip(docs, *block.matches(docs), strict=True):
            hit, named, longest = set(), set(), collections.Counter()
            for name, t in items:
                w = t.split()
                size = min(10, len(w))
                for j in range(len(w) - size + 1 if w else 0):
                    for p in range(len(words) - size + 1):
                        if words[p : p + size] == w[j : j + size]:
                            hit |= set(range(p, p + size))
                            named.add(name)
                            n = size
                            while j + n < len(w) and p + n < len(words) and w[j + n] == words[p + n]:
                                n += 1
                            longest[p] = max(longest[p], n)
            assert {p for s in spans for p in range(s["doc_start"], s["doc_start"] + s["n_words"])} == hit
            assert block.items_of(windows) == sorted(named)
            want, end = [], -1
            for p in sorted(longest):
                if p + longest[p] > end:
                    want.append((p, longest[p]))
                    end = p + longest[p]
            assert [(s["doc_start"], s["n_words"]) for s in spans] == want
            for s in spans:
                item = dict(items)[s["item"]].split()
                assert item[s["item_start"] : s["item_start"] + s["n_words"]] == words[s["doc_start"] : s["doc_start"] + s["n_words"]]


def test_a_passage_of_many_items_in_many_texts():
    """Results come in bounded batches, and the work is not items times documents."""
    prompt = " ".join(f"p{i}" for i in range(12))
    block = decontaminate.Items([(str(i), f"{prompt} q{i}".encode()) for i in range(2000)])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([f"{prompt} d{i}" for i in range(2000)])], ["id", "text"])
    rows, everything = 0, sorted(map(str, range(2000)))
    for out in block.reports(iter([batch])):
        assert out.num_rows <= decontaminate.ROWS_OUT // 2000 + 1
        assert out["items"][0].as_py() == everything
        assert [len(x) for x in out["spans"].to_pylist()] == [1] * out.num_rows
        rows += out.num_rows
    assert rows == 2000


def greedy_phrases(text: bytes, known: bytes) -> int:
    count, at = 0, 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at : at + size + 1] in known:
            size += 1
        count += 1
        at += max(size, 1)
    return count


@pytest.mark.parametrize("lane", [1, 3, 64, 1024])
def test_phrases_are_the_longest_matches(monkeypatch, lane):
    """Also where a phrase spans many lanes, and with letters that no sample has."""
    monkeypatch.setattr(language_id, "LANE", lane)
    rng = random.Random(8)
    for _ in range(15):
        samples = [np.array([rng.randrange(4) for _ in range(rng.randrange(1, 300))], np.uint8) for _ in range(3)]
        automata = language_id.Automata([language_id.suffix_automaton(x) for x in samples], 6)
        texts = []
        for _ in range(12):
            text = [rng.choice([rng.randrange(4), rng.randrange(6)]) for _ in range(rng.randrange(0, 150))]
            own = bytes(rng.choice(samples))
            at = rng.randrange(len(own))
            text[len(text) // 2 : len(text) // 2] = list(own[at : at + rng.randrange(200)])
            texts.append(np.array(text, np.uint8))
        for text, row in zip(texts, language_id.phrase_counts(texts, automata), strict=True):
            assert row.tolist() == [greedy_phrases(bytes(text), bytes(x)) for x in samples]


def test_language_by_brute_force(spark):
    """The whole operator: sample, parse, normalisation and choice."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    samples = language_id.sample(docs)
    letters = lambda t: "".join(c.lower()[0] if c.isalpha() else "\0" for c in t)
    squeeze = lambda t: "".join(c for c, before in zip(t, "x" + t, strict=False) if c != "\0" or before != "\0")
    known = {k: b"".join(squeeze(letters(t)).encode() + b"\0" for t in v) for k, v in samples.items()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, t in list(texts.items())[:40]:
        texts[i] = (t or "")[:3000]
    texts = dict(list(texts.items())[:40]) | {-1: samples[sorted(samples)[0]][0], -2: None, -3: "12 34"}
    rows = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), language_id.Model(samples)).collect()}
    for i, t in texts.items():
        own = squeeze(letters(t or "")).encode()
        if not own.strip(b"\0"):
            assert (rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0)
            continue
        phrases = {k: greedy_phrases(own, known[k]) for k in sorted(known)}
        cost = {k: n * math.log2(max(2, len(known[k]))) / len(own) for k, n in phrases.items()}
        best = min(cost, key=cost.get)
        assert rows[i]["lang_pred"] == best
        assert rows[i]["rate"] == pytest.approx(phrases[best] / len(own))
        assert rows[i]["score"] == pytest.approx(1 - cost[best] / sorted(cost.values())[1])


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = [r for r in queries.queries()["op4_language_id"](spark, SF2).collect() if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in rows)


def test_language_stage_rejects_what_was_not_learned(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "lang", "text")
    rng = random.Random(14)
    italian = "La volpe veloce salta sopra il cane pigro mentre sette maghi mescolano in silenzio barattoli di vernice color giada. Ogni mattina il mercato della piazza si riempie di gente che compra frutta, pane e verdura fresca. Nessuno sapeva dove fosse finito il vecchio orologio della stazione."
    strange = [(-1, None, italian), (-2, None, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz    ", k=600)))]
    model = language_id.learn(docs, judged=True)
    assert language_id.kept_documents(spark.createDataFrame(strange, docs.schema), model).count() == 0
    lettered = sum(any(c.isalpha() for c in r["text"] or "") for r in docs.collect())
    assert language_id.kept_documents(docs, model).count() >= 0.999 * lettered


def test_many_letters_are_told_apart():
    """Two languages that differ only in letters beyond the most frequent hundred, and a script that no sample has."""
    import pyarrow as pa

    rng = random.Random(13)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=3)) for _ in range(200))
    common, one, two = ([chr(a + i) for i in range(n)] for a, n in ((0x4E00, 100), (0x6000, 60), (0x7000, 60)))
    model = language_id.Model({"a": [text(common), text(common), text(common), text(one)], "b": [text(common), text(common), text(common), text(two)]})
    for letters, name in ((one, "a"), (two, "b")):
        assert {r["lang"] for r in model.predict(pa.array([text(letters) for _ in range(10)])).to_pylist()} == {name}
    (told,) = model.predict(pa.array([text([chr(0x10D0 + i) for i in range(30)])])).to_pylist()
    assert told["rate"] > language_id.MAX_RATE


def test_classifier_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()}
    rows = [r for r in queries.queries()["op10_quality_classifier"](spark, SF2).collect() if r["held_out"] and r["doc_id"] in labels]
    good = [r["score"] for r in rows if labels[r["doc_id"]] == 1]
    bad = [r["score"] for r in rows if labels[r["doc_id"]] == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) >= 0.9 * len(rows)


def test_risk_is_kept_from_falling_below_zero():
    rng = np.random.default_rng(2)
    p, u = rng.normal(2, 1, (50, 4)), np.concatenate([rng.normal(2, 1, (100, 4)), rng.normal(-2, 1, (100, 4))])
    model = quality_classifier.fit(p, u, 0.5)
    z = quality_classifier.expanded(u, *model[:2]) @ model[2]
    assert (z[:100] > 0).mean() > 0.9 and (z[100:] < 0).mean() > 0.9


@pytest.mark.parametrize("prior", [0.3, 0.9])
def test_risk_by_brute_force(prior):
    """Value row by row, slope by differences, on both sides of zero."""
    rng = np.random.default_rng(5)
    p, u = rng.normal(1, 1, (30, 3)), rng.normal(0, 1, (40, 3))
    cost = lambda z: math.log1p(math.exp(z))
    for scale in (0.1, 1, 4):
        w = rng.normal(0, scale, 3)
        zp, zu = [[float(sum(a * b for a, b in zip(x, w, strict=True))) for x in rows] for rows in (p, u)]
        second = sum(map(cost, zu)) / 40 - prior * sum(map(cost, zp)) / 30
        value, slope = quality_classifier.risk(w, p, u, prior)
        assert value == pytest.approx(prior * sum(cost(-z) for z in zp) / 30 + max(0, second))
        for j in range(3):
            step = np.eye(3)[j] * 1e-5
            if second >= 0:
                want = (quality_classifier.risk(w + step, p, u, prior)[0] - quality_classifier.risk(w - step, p, u, prior)[0]) / 2e-5
            else:
                part = lambda v: sum(cost(float(x @ v)) for x in u) / 40 - prior * sum(cost(float(x @ v)) for x in p) / 30
                want = -(part(w + step) - part(w - step)) / 2e-5
            assert slope[j] == pytest.approx(want, rel=1e-4, abs=1e-7)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_prior_from_positives_and_unlabelled(share):
    rng = np.random.default_rng(6)
    kind = lambda mean, n: rng.normal(mean, 1, (n, 5))
    n = int(4000 * share)
    unlabelled = rng.permutation(np.concatenate([kind(1.5, n), kind(-1.5, 4000 - n)]))
    assert quality_classifier.estimated_prior(kind(1.5, 2000), unlabelled) == pytest.approx(share, abs=0.06)
    assert quality_classifier.estimated_prior(kind(1.5, 5), unlabelled) == quality_classifier.DEFAULT_PRIOR


def test_features_by_brute_force():
    import xxhash

    text = "The quick, the QUICK  brown fox.\nThe fox fox!".encode()
    (row,) = quality_classifier.features([text])
    words = text.lower().split()
    slots, grams = collections.Counter(xxhash.xxh3_64_intdigest(w) % quality_classifier.WORD_SLOTS for w in words), collections.Counter()
    for i in range(len(text) - 2):
        a, b, c = text.lower()[i : i + 3]
        grams[((a | b << 8 | c << 16) * 2654435761 % 2**32 >> 24) % quality_classifier.GRAM_SLOTS] += 1
    n = quality_classifier.N_DENSE
    assert row[n : n + quality_classifier.WORD_SLOTS].tolist() == pytest.approx([math.sqrt(slots[k] / len(words)) for k in range(quality_classifier.WORD_SLOTS)])
    assert row[n + quality_classifier.WORD_SLOTS :].tolist() == pytest.approx([math.sqrt(grams[k] / len(text)) for k in range(quality_classifier.GRAM_SLOTS)])
    assert row[n - 1] == pytest.approx(math.sqrt(1 - len(set(words)) / len(words)))
    assert not quality_classifier.features([b""]).any()


def test_lm_base_and_probabilities(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokens = {i: [*t.encode().lower().split(), b"\n"] for i, t in docs.items()}
    counts = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    total, rest = sum(counts.values()), math.log10(sum(counts.values()) + 0.1 * (len(counts) + 1))
    for r in queries.queries()["op6_lm_score"](spark, SF).collect():
        ws = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(math.log10(counts[w] + 0.1) - rest for w in ws), rel=1e-9)
        assert r["score"] < 0


def seen_after(train: list[bytes], order: int) -> dict:
    seen = collections.defaultdict(collections.Counter)
    for t in train:
        row = [256] * order + list(t) + [256]
        for i in range(order, len(row)):
            for k in range(order + 1):
                seen[tuple(row[i - k : i])][row[i]] += 1
    return seen


def reference_ppm(seen: dict, context: tuple) -> dict:
    """Probabilities after a context by the textbook: escape method D with exclusion, from the longest context that was seen."""
    out, weight, gone = collections.defaultdict(float), 1.0, set()
    for k in range(len(context), -1, -1):
        own = {s: n for s, n in seen[context[len(context) - k :]].items() if s not in gone}
        if own:
            n, d = sum(own.values()), len(own)
            escape = d / (2 * n) if d < 257 - len(gone) else 0
            for s, m in own.items():
                out[s] += weight * (1 - escape) * (m - 0.5) / (n - d / 2)
            weight *= escape
            gone |= set(own)
    for s in range(257):
        if s not in gone:
            out[s] += weight / (257 - len(gone))
    return out


def reference_score(seen: dict, text: bytes, order: int) -> float:
    row = [256] * order + list(text) + [256]
    return sum(math.log10(reference_ppm(seen, tuple(row[i - order : i]))[row[i]]) for i in range(order, len(row)))


@pytest.mark.parametrize("order", [1, 2, 3, 5, 6])
def test_trie_is_ppm(order):
    import pyarrow as pa

    train = [b"abracadabra", b"abrupt", b"", "caf\u00e9 abra".encode()]
    codes, counts = np.unique(lm_score.byte_codes(train, order)[0], return_counts=True)
    trie, seen = lm_score.Trie(codes, counts.astype(float), order), seen_after(train, order)
    assert sum(reference_ppm(seen, (97,) * order).values()) == pytest.approx(1)
    for text in (b"abra", b"", b"zebra\xff", b"caf", b"abracadabrupt"):
        got = trie.scores(pa.array([text], pa.binary()))[0].as_py()
        assert got == pytest.approx(reference_score(seen, text, order), rel=1e-4)


@pytest.mark.parametrize("entries", [4_000_000, 15_000])
def test_lm_by_brute_force(spark, monkeypatch, entries):
    """The whole operator, in one part and in several; rare contexts count as well."""
    monkeypatch.setattr(lm_score, "PART_ENTRIES", entries)
    rng = random.Random(12)
    texts = {i: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ", k=1500)) for i in range(40)}
    train = [t.encode() for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10]
    seen = seen_after(train, lm_score.ORDER)
    assert len(seen) > 60_000
    source = next(i for i in texts if zlib.crc32(str(i).encode()) % 10)
    held = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    texts[held[0]], texts[held[1]], texts[300] = texts[source][700:712] + "#", "zz \u00e9", texts[source][:40]
    train.append(texts[300].encode()) if zlib.crc32(b"300") % 10 else None
    seen = seen_after(train, lm_score.ORDER)
    got = {r["doc_id"]: r["score"] for r in lm_score.score_texts(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    for i in (*held, 300):
        assert got[i] == pytest.approx(reference_score(seen, texts[i].encode(), lm_score.ORDER), rel=1e-5)


def test_lm_beats_the_unigram_base():
    """Bits a byte of held-out documents, both models learned from the others."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    train, held = [], []
    for i, t in zip(rows["doc_id"], rows["text"], strict=True):
        (train if zlib.crc32(str(i).encode()) % 10 else held).append((t or "").encode())
    tokens = collections.Counter(w for t in train for w in (*t.lower().split(), b"\n"))
    rest = math.log10(sum(tokens.values()) + 0.1 * (len(tokens) + 1))
    base = sum(math.log10(tokens[w] + 0.1) - rest for t in held for w in (*t.lower().split(), b"\n"))
    codes, counts = np.unique(lm_score.byte_codes(train, lm_score.ORDER)[0], return_counts=True)
    assert sum(lm_score.Trie(codes, counts.astype(float), lm_score.ORDER).scores(pa.array(held, pa.binary())).to_pylist()) > base


def test_licenses_lose_nothing(spark):
    rng = random.Random(11)
    words = [f"t{i}" for i in range(25)]
    templates = tuple((f"l{k}", "line", " ".join(rng.sample(words, rng.randrange(2, 9)))) for k in range(8))
    texts = [(i, "\n".join(" ".join(rng.choices(words + ["other"], k=rng.randrange(0, 14))) for _ in range(3))) for i in range(80)]
    rows = license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id bigint, text string"), templates=templates).collect()
    for r in rows:
        want = set()
        lines = dict(texts)[r["doc_id"]].split("\n")
        for line in [" ".join(lines[i : i + n]) for n in (1, 2, 3) for i in range(len(lines) - n + 1)]:
            for label, _, wording in templates:
                own = set(wording.split())
                if len(own & set(line.split())) >= math.ceil(round(0.8 * len(own), 9)):
                    want.add(label)
        assert r["labels"] == ",".join(sorted(want))


def test_wrapped_notices(spark):
    """A notice of one sentence over two or three lines, and its words scattered over lines that are not wrapped ones."""
    mpl = ["This Source Code Form is subject to the terms of the Mozilla Public", "License, v. 2.0. If a copy of the MPL was not distributed with this", "file, You can obtain one at the site below."]
    narrow = ["  Licensed under the", "  Apache License,", "  Version 2.0."]
    filler = " ".join(f"filler{i}" for i in range(40))
    texts = [(1, "\n".join(["x", *mpl])), (2, "\n".join(narrow)), (3, f"all {filler}\nrights {filler}\nreserved {filler}"), (4, "all rights\nreserved"), (5, "all\n\n\nrights\n\nreserved")]
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert [rows[i]["labels"] for i in range(1, 6)] == ["mpl", "apache", "", "reserved", ""]
    assert rows[1]["score"] > 0.8


def test_trust_is_the_dense_solution(spark):
    rng = np.random.default_rng(9)
    n, edges = 40, {}
    for _ in range(90):
        a, b = rng.integers(0, n, 2).tolist()
        if a != b and a % 7:
            edges[a, b] = edges.get((a, b), 0) + int(rng.integers(1, 4))
    seeds = [(f"h{i}", float(i % 3 == 0) * 0.5, float(i % 5 == 0)) for i in range(n)]
    frame = spark.createDataFrame([(f"h{a}", f"h{b}", k) for (a, b), k in edges.items()], "src string, dst string, n bigint")
    scores, own = url_filter.propagated(spark.createDataFrame(seeds, "host string, trust double, distrust double"), frame)
    got = {r["host"]: (r["trust"], r["distrust"]) for r in scores.collect()}
    d = url_filter.DAMPING
    for side, kind in ((0, "t"), (1, "d")):
        v = np.array([s[1 + side] for s in seeds])
        walk = np.zeros((n, n))
        for (a, b), k in edges.items():
            walk[(b, a) if side == 0 else (a, b)] += k
        out = walk.sum(axis=0)
        # Where no edge leads on, the walk goes back to the seeds.
        walk = np.where(out > 0, walk / np.maximum(out, 1), (v / v.sum())[:, None])
        want = np.linalg.solve(np.eye(n) - d * walk, (1 - d) * v)
        assert want.sum() == pytest.approx(v.sum())
        assert [got.get(f"h{i}", (0, 0))[side] for i in range(n)] == pytest.approx(want.tolist(), abs=1e-6)
        leaky = np.linalg.solve(np.eye(n) - d * np.where(out > 0, walk, 0), (1 - d) * v)
        assert own[kind] == pytest.approx((1 - d) * v.sum() / leaky.sum(), rel=1e-6)


def test_trust_spreads(spark):
    link = lambda *hosts: "".join(f'<a class="x" href="https://{h}/p">' for h in hosts)
    pages = [
        (1, "https://good.org/fr/1", link("a.com")),
        (2, "https://a.com/1", link("b.com", "b.com", "a.com")),
        (3, "https://b.com/1", ""),
        (4, "https://bad.net/1", link("a.com")),
        (5, "https://spam.com/1", link("bad.net")),
        (6, "https://farm.com/1", link("spam.com", "spam.com")),
        (7, "https://alone.com/1", None),
        (8, "https://example.com/de/1", None),
        (9, "https://example.com/en/1", None),
        (10, "https://example.com/en/2", link("example.com")),
        (11, "https://worse.net/1", None),
        (12, "https://once.com/1", link("worse.net")),
    ]
    # Many trusted hosts that each endorse one host outweigh its one link to a blocked host.
    pages += [(100 + i, f"https://t{i}.org/fr/", link("once.com")) for i in range(20)]
    rows = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert [rows[i]["verdict"] for i in range(1, 13)] == ["allow", "allow", "allow", "block", "block", "block", "allow", "block", "allow", "allow", "block", "allow"]
    assert rows[5]["distrust"] == pytest.approx(0.85 * rows[4]["distrust"])
    assert rows[6]["distrust"] == pytest.approx(0.85 * rows[5]["distrust"])
    assert sum({r["host"]: r["trust"] for r in rows.values()}.values()) == pytest.approx(21)


def test_the_prior_shrinks():
    """Moments against the greatest likelihood, and hosts of one document, which tell nothing about differences."""
    rng = np.random.default_rng(11)
    for a, b in ((2, 18), (0.5, 4.5), (6, 6)):
        n = rng.integers(1, 80, 4000)
        f = rng.binomial(n, rng.beta(a, b, 4000))
        mean, weight = quality_rules.prior(len(n), float(n.sum()), float((n * n).sum()), float(f.sum()), float((f * f / n).sum()))
        rows = collections.Counter(zip(n.tolist(), f.tolist(), strict=True))

        def likelihood(w, m=mean, rows=rows):
            x, y, g = m * w, (1 - m) * w, math.lgamma
            return sum(k * (g(fi + x) + g(ni - fi + y) - g(ni + w) + g(w) - g(x) - g(y)) for (ni, fi), k in rows.items())

        best = max((math.exp(t) for t in np.linspace(math.log(0.2), math.log(100), 400)), key=likelihood)
        assert mean == pytest.approx(a / (a + b), rel=0.05)
        assert weight == pytest.approx(best, rel=0.1)
    mean, weight = quality_rules.prior(400, 400.0, 400.0, 20.0, 20.0)
    assert (1 + mean * weight) / (1 + weight) == pytest.approx(0.05)
    assert quality_rules.prior(0, 0.0, 0.0, 0.0, 0.0)[0] == 0.0


def test_host_prior_in_the_operator(spark):
    good, shout = (" ".join(f"{w}{i} {w}{i}x" for i in range(30)) for w in ("word", "LOUD"))
    docs = [(i, shout if i % 20 == 0 else good, f"h{i}") for i in range(400)]
    rows = quality_rules.assess(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect()
    assert all(r["host_rate"] == pytest.approx(0.05) and r["kept"] for r in rows)


def test_host_verdicts(spark):
    good = " ".join(f"word{i} other{i}" for i in range(30))
    shout = " ".join(f"LOUD{i} WORDS{i}" for i in range(30))
    docs = [(i, good if i % 2 else shout, "half") for i in range(40)] + [(100 + i, shout, "loud") for i in range(60)] + [(200, good, "loud")] + [(300 + i, shout if i == 0 else good, "calm") for i in range(60)]
    rows = {r["doc_id"]: r for r in quality_rules.assess(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect()}
    assert not rows[200]["kept"]
    assert rows[1]["kept"] and not rows[0]["kept"]
    assert rows[300]["kept"] and rows[301]["kept"]
