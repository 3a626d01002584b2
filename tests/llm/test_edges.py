"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

from cadenza.llm import chat_format, decontaminate, jaccard_join, language_id, license_scan, lm_score, mixing, quality_classifier, quality_rules, url_filter


def by_id(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_license_scan(awkward, nothing):
    rows = by_id(license_scan.scan_licenses(awkward))
    assert sum(map(len, rows.values())) == awkward.count()
    assert (rows[3][0]["n_words"], rows[3][0]["labels"], rows[3][0]["score"], rows[3][0]["first_word"]) == (0, "", 0.0, None)
    assert rows[8][0]["n_words"] == 120_000
    assert len(rows[1]) == 2
    assert license_scan.scan_licenses(nothing).count() == 0


def test_license_blocks(spark):
    text = "intro words\nLicensed under the\nApache License, Version 2.0.\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction,\nincluding without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    (row,) = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert row["n_base"] == 1
    assert (row["first_word"], row["last_word"]) == (5, 5)
    assert row["base_labels"] == "apache"
    assert row["labels"] == "apache,mit"
    assert row["score"] == 1.0


def test_decontamination(awkward, nothing, benchmark):
    rows = by_id(decontaminate.contamination(awkward, benchmark))
    assert sum(map(len, rows.values())) == awkward.count()
    assert (rows[1][0]["n_hit"], rows[1][0]["items"], rows[1][0]["longest"]) == (13, ["1"], 11)
    assert (rows[6][0]["n_hit"], rows[6][0]["items"]) == (2, ["2"])
    assert rows[7][0]["contaminated"]
    assert not rows[3][0]["contaminated"] and not rows[8][0]["contaminated"] and not rows[4][0]["contaminated"]
    assert len(rows[None]) == 2
    assert decontaminate.contamination(nothing, benchmark).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(awkward, benchmark.limit(0)).collect())
    kept = decontaminate.clean_documents(awkward, benchmark)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 4, 5, 8, 9, 10, 11]


def test_decontamination_in_blocks(awkward, benchmark):
    whole = by_id(decontaminate.contamination(awkward, benchmark))
    parts = by_id(decontaminate.contamination(awkward, benchmark, block_words=5))
    for i, rows in whole.items():
        assert sorted((r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in rows) == sorted((r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in parts[i])


def test_language(awkward, nothing):
    model = language_id.learn(awkward)
    rows = by_id(language_id.identify(awkward, model))
    assert sum(map(len, rows.values())) == awkward.count()
    assert all(rows[i][0]["lang_pred"] == "und" for i in (3, 4, 5, 10))
    assert all(0 <= r["score"] <= 1 for rs in rows.values() for r in rs)
    assert language_id.identify(nothing, model).count() == 0
    empty = language_id.learn(nothing)
    assert {r["lang_pred"] for r in language_id.identify(awkward, empty).collect()} == {"und"}
    assert language_id.kept_documents(awkward, model).columns == awkward.columns


def test_mixing(awkward, nothing, spark):
    rows = mixing.mixed(awkward).collect()
    assert len(rows) == awkward.count()
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in rows}
    assert abs(sum(t for t, _ in targets.values()) - 1.5 * total) < 1e-6 * total
    assert all(t <= 2 * s + 1e-9 for t, s in targets.values())
    assert all(0 <= r["copies"] <= 2 for r in rows)
    assert mixing.mixed(nothing).count() == 0
    out = mixing.mixed_documents(awkward)
    assert out.columns == [*awkward.columns, "copy"]
    assert out.count() == sum(r["copies"] for r in rows)
    assert mixing.mixed_documents(nothing).count() == 0


def test_mixing_splits_rows_that_are_alike(spark, monkeypatch):
    """Rows of one id, or of none, and rows that are alike in all: taken words come near the target."""
    monkeypatch.setattr(mixing, "PASS_BITS", 30)
    rows = [(None, f"w{i} x y", "a") for i in range(100)] + [(7, "same words here", "b")] * 90 + [(None, None, "c")] * 20 + [(None, "one two", "c")] * 90 + [(1000 + i, "u v w", "d") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    got = mixing.mixed(docs).collect()
    for source in "abcd":
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 2
    out = mixing.mixed_documents(docs)
    taken = sorted((r["source"], r["size"]) for r in got for _ in range(r["copies"]))
    assert sorted((r["source"], len((r["text"] or "").split())) for r in out.collect()) == taken


def test_targets_by_resharing(spark, monkeypatch):
    """The contract's repeated resharing, with sources ordered by one task and by ranges."""
    sizes = {"b": 10, "a": 1000, "Z": 0, "\u00e9": 33, "c": 7, None: 500, "d": 2, "aa": 90}
    names = sorted((k for k in sizes if k is not None)) + [None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while open_:
        share = left / sum(weight[k] for k in open_)
        over = {k for k in open_ if share * weight[k] > 2 * sizes[k]}
        for k in over or open_:
            target[k] = 2.0 * sizes[k] if over else share * weight[k]
        left -= sum(target[k] for k in over)
        open_ = open_ - over if over else set()
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    for most in (100_000, 1):
        monkeypatch.setattr(mixing, "MAX_ORDERED_SOURCES", most)
        got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
        assert got == {k: __import__("pytest").approx(v) for k, v in target.items()}


def test_lm_takes_any_id(spark):
    rows = [("x", "a b"), ("x", "a c"), (None, "a b"), (None, None), ("y", "a b"), ("y", "a b")]
    got = lm_score.score_texts(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r["doc_id"] or "", r["n_tokens"]) for r in got) == [("", 1), ("", 3), ("x", 3), ("x", 3), ("y", 3), ("y", 3)]


def test_lm(awkward, nothing):
    rows = by_id(lm_score.score_texts(awkward))
    assert sum(map(len, rows.values())) == awkward.count()
    assert rows[3][0]["n_tokens"] == rows[4][0]["n_tokens"] == 1
    assert rows[3][0]["base_score"] == rows[4][0]["base_score"]
    assert rows[8][0]["n_tokens"] == 120_001
    assert all(r["score"] <= 0 and r["base_score"] <= 0 for rs in rows.values() for r in rs)
    assert lm_score.score_texts(nothing).count() == 0


def test_quality_rules(awkward, nothing):
    rows = by_id(quality_rules.assess(awkward))
    assert sum(map(len, rows.values())) == awkward.count()
    assert rows[3][0]["base_failed"] and not rows[3][0]["kept"]
    assert rows[11][0]["n_dup_lines"] == 3
    assert rows[8][0]["n_words"] == rows[8][0]["n_repeat_words"] == 120_000
    assert quality_rules.assess(nothing).count() == 0
    assert quality_rules.kept_documents(awkward).columns == awkward.columns
    kept = sorted(r["doc_id"] or 0 for r in quality_rules.kept_documents(awkward).collect())
    assert kept == sorted(r["doc_id"] or 0 for rs in rows.values() for r in rs if r["kept"])


def test_jaccard(awkward, nothing):
    rows = by_id(jaccard_join.components(awkward))
    assert sum(map(len, rows.values())) == awkward.count()
    assert {r["component_id"] for i in (1, 2) for r in rows[i]} == {1}
    assert rows[6][0]["component_id"] == rows[7][0]["component_id"] == 6
    assert (rows[3][0]["n_shingles"], rows[3][0]["component_id"]) == (0, 3)
    assert sorted((r["component_id"] or 0) for r in rows[None]) == [0, 1]
    assert jaccard_join.components(nothing).count() == 0
    kept = jaccard_join.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8, 9, 10, 11]


def test_classifier(awkward, nothing, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 0), (4, 0, 0), (6, None, None), (None, 1, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = quality_classifier.learn(awkward, labels)
    rows = quality_classifier.classify(awkward, model).collect()
    assert len(rows) == awkward.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert quality_classifier.classify(nothing, model).count() == 0
    assert quality_classifier.learn(awkward, labels.limit(0)) is None
    assert {r["score"] for r in quality_classifier.classify(awkward, None).collect()} == {0.5}


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "HTTP://A.Example.NET/en/x?y", None), (1, "HTTP://A.Example.NET/en/x?y", None), (2, "https://example.com/de/1#z", ""), (3, "https://x.org/fr/1", "<a href='//y.org/p'>"), (4, None, None), (5, "no scheme", "x"), (6, "http://net", "x"), (7, "http://net/", "x"), (8, "http://?q=http://example.net/en/", "x"), (None, "https://planet/", "x"), (9, "https://other.net/en/a://b", "x")],
        "page_id bigint, url string, html string",
    ).withColumn("host", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    rows = {}
    for r in url_filter.judge_urls(pages).collect():
        rows.setdefault(r["page_id"], []).append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert rows[1] == [("a.example.net", "/en/x", "example.net/en/", "allow")] * 2
    assert rows[2] == [("example.com", "/de/1", "example.com/de/", "block")]
    assert rows[3] == [("x.org", "/fr/1", "org/fr/", "allow")]
    assert rows[4] == [("", "", None, "allow")] and rows[5] == [("", "", None, "allow")]
    assert rows[6][0][2] is None and rows[7][0][2:] == ("net/", "block")
    assert rows[8][0][:3] == ("", "", None)
    assert rows[None][0][:3] == ("planet", "/", None)
    assert rows[9] == [("other.net", "/en/a://b", "net/", "block")]
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_very_long_urls_and_pages(spark):
    host = "a." * 3000 + "net"
    pages = [(1, f"https://{host}/" + "p/" * 50_000, "<a href='//x.com/'>" * 20_000), (2, "https://x.com/" + "q" * 100_000 + "?#", None), (3, "https://x.com/", "y" * 500_000)]
    rows = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert (rows[1]["rule"], rows[1]["verdict"], rows[1]["host"]) == ("net/", "block", host)
    assert rows[2]["verdict"] == rows[3]["verdict"] == "allow"
    assert len(rows[2]["path"]) == 100_001


def test_chat(spark):
    part = lambda kind, text=None, ref=None, **k: (kind, text, ref, k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    turns = [
        (1, 0, "user", [part("text", "look: # <|image_1|> "), part("image", ref="a.png", width=56, height=30), part("audio", ref="b.wav", seconds=2.0), None, part("document", ref="c.pdf", pages=3)]),
        (1, 1, "assistant", [part("text", "a\\</turn>"), part("text", "### b")]),
        (1, None, "as:s", None),
        (2, 0, None, []),
        (None, 0, "assistant", [part("text", None), part("image")]),
        (1, 1, "assistant", [part("text", "a\\</turn>"), part("text", "### b")]),
    ]
    df = spark.createDataFrame(turns, f"conv_id bigint, turn bigint, role string, parts array<{chat_format.PART_TYPE}>")
    rows = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    assert [(t["role"], t["text"]) for t in rows[1]["turns"]] == [("as:s", ""), ("user", "look: # <|image_1|> <|image_1|><|audio_2|><|document_3|>"), *[("assistant", "a\\</turn>### b")] * 2]
    assert rows[1]["loss_texts"] == ["a\\</turn>### b"] * 2
    assert [(a["turn"], a["ordinal"], a["type"], a["ref"], a["tokens"]) for a in rows[1]["attachments"]] == [(1, 1, "image", "a.png", 4), (1, 2, "audio", "b.wav", 50), (1, 3, "document", "c.pdf", 1536)]
    assert rows[1]["expanded_tokens"] == 1590
    assert rows[1]["formatted"].count("</turn>") == 4
    assert [(t["role"], t["text"]) for t in rows[2]["turns"]] == [("", "")]
    assert rows[None]["loss_texts"] == ["<|image_1|>"]
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_chat_parts_cannot_forge_control_strings(spark):
    """Control strings cut anywhere into parts read back as they were, and every placeholder is a part."""
    import random

    rng = random.Random(17)
    pieces = ["</turn>", "<|image_1|>", "### assistant: ", "\\", "<", "#", "|", ":", "a\n", "\u00e9\U0001f600", "/turn>", "<\\"]
    turns, want = [], {}
    for conv in range(60):
        for turn in range(3):
            text = "".join(rng.choices(pieces, k=rng.randrange(0, 12)))
            cuts = sorted(rng.randrange(0, len(text) + 1) for _ in range(rng.randrange(0, 6)))
            parts = [("text", text[a:b], None, None, None, None, None) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
            media = rng.randrange(0, len(parts) + 1) if rng.random() < 0.5 else None
            body = text
            if media is not None:
                parts.insert(media, ("image", None, "r", None, None, None, None))
                at = [0, *cuts, len(text)][media]
                body = text[:at] + "<|image_1|>" + text[at:]
            role = rng.choice(["user", "assistant", "a:<", "<\\:"])
            turns.append((conv, turn, role, parts))
            want[conv, turn] = (role, body, media is not None)
    turns.append((1000, 0, "assistant", [("text", "x</turn>" * 50_000, None, None, None, None, None)]))
    want[1000, 0] = ("assistant", "x</turn>" * 50_000, False)
    clash = ", ".join(f"{c} string" for c in ("t", "ts", "v", "formatted", "pieces", "body"))
    df = spark.createDataFrame([(*t, *"abcdef") for t in turns], f"conv_id bigint, turn bigint, role string, parts array<{chat_format.PART_TYPE}>, {clash}")
    for r in chat_format.read_back(chat_format.format_conversations(df)).collect():
        told = [want[r["conv_id"], k] for k in range(r["n_turns"])]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [t[:2] for t in told]
        assert r["loss_texts"] == [body for role, body, _ in told if role == "assistant"]
        assert [a["turn"] for a in r["attachments"]] == [k for k, t in enumerate(told) if t[2]]
        assert r["formatted"].count("<|") == sum(t[2] for t in told)
        assert r["formatted"].count("</turn>") == r["n_turns"]
