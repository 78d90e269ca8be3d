"""Scoring, counting, mixing, archive and licence operators."""

import io
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from driftline.llm import langid, licenses, mixing, tokens, toxicity, warc

from . import brute

SF = "/root/testdata/sf0.01"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
EDGES = [(1, None), (2, ""), (3, " \n"), (4, "!!! 123"), (None, "hello there"), (6, "word " * 30000), (6, "word " * 30000)]


def edge_docs(spark, rows=EDGES):
    return spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, score double, lang string")


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    caught = sum(p and t for p, t in held)
    assert sum(t for _, t in held) >= 5
    # Labels are noisy: five of the six held-out toxic texts are caught.
    assert caught / sum(t for _, t in held) > 0.8 and caught / sum(p for p, _ in held) > 0.9
    edges = toxicity.score(edge_docs(spark), model).collect()
    assert len(edges) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in edges)
    left = toxicity.without_toxic(edge_docs(spark), model)
    assert left.columns == ["doc_id", "text", "score", "lang"] and left.count() >= 5


def test_ngram_features_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "RUN_BYTES", 64)  # long texts are cut into pieces
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab É日\U0001f600\n") for _ in range(rng.randrange(200))) for _ in range(40)] + ["", "a"]
    label = [i % 3 == 0 for i in range(len(texts))]
    seen = [brute.ngrams(t, toxicity.SIZES, toxicity.BUCKET_BITS) for t in texts]
    rows, buckets = toxicity._present(*toxicity.utf8(pa.array(texts)))
    assert sorted(zip(rows.tolist(), buckets.tolist())) == sorted((i, b) for i, s in enumerate(seen) for b in s)
    sample = spark.createDataFrame([(t, int(x)) for t, x in zip(texts, label)], "text string, toxic int")
    got = {r.bucket: r.ratio for r in toxicity.features(sample, sum(label), len(label) - sum(label)).collect()}
    want = {}
    for b in set().union(*seen):
        t, c = (sum(b in s for s, x in zip(seen, label) if x == k) + 1 for k in (True, False))
        ratio = np.log(t / (sum(label) + 2)) - np.log(c / (len(label) - sum(label) + 2))
        if t + c - 2 >= toxicity.LEAST_TEXTS and abs(ratio) / np.sqrt(1 / t + 1 / c) >= toxicity.LEAST_Z:
            want[b] = ratio
    assert got == pytest.approx(want) and (want or monkeypatch)
    weight = {b: rng.uniform(-1, 1) for b in list(set().union(*seen))[:50]}
    model = toxicity.Model(np.array(sorted(weight)), np.array([weight[b] for b in sorted(weight)], np.float32), 0.25)
    z = np.array([0.25 + sum(weight.get(b, 0) for b in s) for s in seen])
    assert toxicity.scores(model, pa.array(texts)) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_toxicity_learns_from_long_and_repeated_texts(spark):
    rows = [(i, ("you vile pest " if i % 2 else "a kind word ") * (20_000 if i < 6 else 5) + f"n{i}", 0.5) for i in range(60)]
    docs = spark.createDataFrame([*rows, *rows[:20]], "doc_id long, text string, toxic double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert all(r.predicted == r.doc_id % 2 for r in toxicity.score(docs, model).collect())
    assert toxicity.learn(docs, labels.filter("toxic = 1")) is None


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(edge_docs(spark), none)
    assert model is None and {r.score for r in toxicity.score(edge_docs(spark), model).collect()} == {0.0}
    assert toxicity.score(edge_docs(spark).limit(0), model).count() == 0


def test_language_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.learn(docs)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [(r.lang_pred, truth[r.doc_id]) for r in langid.predict(docs, net).collect() if r.held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    edges = {r.doc_id: r for r in langid.predict(edge_docs(spark), net).collect()}
    assert all(edges[i].lang_pred == "und" and edges[i].score == 0 for i in (1, 2, 3, 4))
    assert edges[6].lang_pred in net.languages
    assert langid.predict(edge_docs(spark).limit(0), net).count() == 0
    assert langid.learn(docs.limit(0)) is None


def test_tables_equal_the_network():
    rng = np.random.default_rng(1)
    net = langid.new_network(["a", "b", "c"])
    cells = rng.integers(0, 256, (40, langid.WINDOW), dtype=np.uint8)
    vectors = net.embedding[cells]
    pooled = []
    for width, kernel, bias in zip(langid.WIDTHS, net.kernels, net.biases):
        spans = np.concatenate([vectors[:, i : langid.WINDOW - width + 1 + i] for i in range(width)], axis=2)
        pooled.append((spans @ kernel + bias).max(axis=1))
    z = np.maximum(np.concatenate(pooled, axis=1), 0) @ net.out + net.out_bias
    want = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(langid.Classifier(net).log_probabilities(cells), want, atol=1e-3)


def test_gradient_points_down():
    net = langid.new_network(["a", "b"])
    cells = np.random.default_rng(2).integers(97, 123, (16, langid.WINDOW), dtype=np.uint8)
    target = np.arange(16) % 2

    def loss():
        return -langid.Classifier(net).log_probabilities(cells)[np.arange(16), target].mean()

    before = loss()
    for p, g in zip(net.params(), langid._step(net, cells, target)):
        p -= 0.01 * g
    assert loss() < before


def test_token_counts_equal_brute_force(spark):
    pieces = tokens.vocabulary(PIECES)
    model = tokens.Unigram.build(pieces)
    scores = dict(zip(pieces, tokens.zipf_scores(len(pieces)).tolist()))
    rng = random.Random(1)
    words = [tokens.MARK + "".join(rng.choice("theinga日é\U0001f600") for _ in range(rng.randrange(12))) for _ in range(300)]
    words += [tokens.MARK, tokens.MARK + "x" * 300]
    stem = tokens.MARK + "".join(rng.choice("theinga日é") for _ in range(400))
    words += [stem, stem + "the", stem[:350] + "xing", stem[:300], "日" * 600, stem + "then"]
    assert tokens.token_counts(model, words).tolist() == [brute.tokens(w, scores, model.unknown) for w in words]
    got = {r.doc_id: r for r in tokens.count_tokens(edge_docs(spark), PIECES).collect()}
    assert (got[1].n_tokens, got[2].n_words, got[3].n_tokens) == (0, 0, 0) and got[6].n_words == 30000
    assert got[4].n_tokens == sum(brute.tokens(tokens.MARK + w, scores, model.unknown) for w in ("!!!", "123"))
    assert tokens.count_tokens(edge_docs(spark).limit(0), PIECES).count() == 0


MIX = [(i, "w " * (i % 7 + 1), f"s{i % 3}" if i % 5 else None) for i in range(200)] + [(5, None, "s0"), (None, "a b", "z"), (7, "", "empty"), (1, "w w", "s1"), (1, "w w", "s1")]


def test_mix_targets_and_limits(spark):
    docs = spark.createDataFrame([(*r, 1) for r in MIX], "doc_id long, text string, source string, size int")
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == len(MIX)
    sizes = {}
    for _, t, s in MIX:
        sizes[s] = sizes.get(s, 0) + len(brute.space_words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), Fraction(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 3 * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = Fraction(3 * sizes[s])
            left -= target[s]
        free -= full
    by_size = {sizes[s]: float(target[s]) for s in order}
    assert all(r.target == pytest.approx(by_size[r.source_size]) and 0 <= r.taken <= 3 * r.size for r in rows)
    for s in {r.source_size for r in rows if r.source_size}:
        taken = sum(r.taken for r in rows if r.source_size == s)
        assert abs(taken - by_size[s]) <= 8
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(brute.space_words(r.text)) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


PAGES = [(3, "http://a/x", "<p>" + "y" * 200), (1, None, "<p>" + "y" * 200), (2, "http://a/\r\nz", "short"), (4, "u", "short"), (5, "v", None), (6, "w", ""), (None, "n", "<p>" + "y" * 200), (7, "big", "é" * 200000), (1, None, "<p>" + "y" * 200)]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int")
    rows = warc.archive_round_trip(pages).collect()
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        revisit = len(data) >= 100 and data[:3] == b"<p>" and i != 1
        want.append((i or -1, len(data), brute.hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 1 if revisit else -1))
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in rows) == sorted(want)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_archive_has_a_leading_dictionary():
    records = [warc.record(i, "http://h/", (f"<html><body>page {i} " + "some words that come again " * 20).encode(), "d", None) for i in range(300)]
    out = io.BytesIO()
    warc.write_archive(out, iter(records))
    data = out.getvalue()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    assert len(data) < sum(map(len, records)) / 3
    assert list(warc.read_archive(io.BytesIO(data))) == records
    assert list(warc.read_archive(io.BytesIO(data), chunk=7)) == records


@pytest.mark.parametrize("n", [1, 3, 5, 8])
def test_small_archives_have_a_dictionary(n):
    records = [warc.record(i, "http://h/", f"page {i}".encode() * 9, "d", None) for i in range(n)]
    for rows in (records, [b""] * n, [b"x"] * n):
        out = io.BytesIO()
        warc.write_archive(out, iter(rows))
        assert int.from_bytes(out.getvalue()[:4], "little") == warc.DICTIONARY_MAGIC
        assert list(warc.read_archive(io.BytesIO(out.getvalue()), chunk=5)) == rows


FILES = [
    ("lib/LICENSE", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("lib/src/a.py", "# Licensed under the Apache License, Version 2.0\nprint(1)\n" * 2),
    ("lib/src/deep/b.py", "x = 1"),
    ("other/c.py", "y = 2 license to nothing"),
    ("other/c.py", "y = 2 license to nothing"),
    (None, "Released under the MIT License."),
    ("lib/src/d.py", None),
    ("top.py", ""),
    ("lib/long.txt", "word " * 50000 + "This work is licensed under the GNU General Public License, version 3."),
]


def test_licenses_and_inheritance(spark):
    files = spark.createDataFrame([(*f, "k") for f in FILES], "path string, text string, dir2 string")
    rows = licenses.scan(files).collect()
    got = {r.path: r for r in rows}
    assert len(rows) == len(FILES)
    assert (got["lib/LICENSE"].license, got["lib/LICENSE"].found) == ("MIT", "file")
    assert (got["lib/src/a.py"].license, got["lib/src/a.py"].found) == ("Apache-2.0", "notice")
    assert (got["lib/src/deep/b.py"].license, got["lib/src/deep/b.py"].declared_in) == ("Apache-2.0", "lib/src")
    assert (got["lib/src/d.py"].license, got["lib/src/d.py"].declared_in) == ("Apache-2.0", "lib/src")
    assert got["lib/long.txt"].license == "GPL-3.0" and got[None].license == "MIT"
    assert got["other/c.py"].found == "none" and got["top.py"].found == "none"
    assert licenses.scan(files.limit(0)).count() == 0
    names = "dir own score is_file whole license declared_in found row one".split()
    clash = files.select("path", "text", *[files.dir2.alias(c) for c in names])
    again = licenses.scan(clash)
    assert again.columns == ["path", "dir", "own", "is_file", "whole", "row", "one", "license", "score", "found", "declared_in"]
    assert {r.dir for r in again.collect()} == {"k"}
    assert sorted((str(r.path), str(r.license), r.found) for r in again.collect()) == sorted((str(r.path), str(r.license), r.found) for r in rows)


def test_notice_cosine_equals_every_stretch():
    known = licenses.Templates(licenses.TEMPLATES)
    scanner = licenses.Scanner(known, 100, np.arange(len(known.terms)) % 50)
    hashes = next(licenses._hashed(pa.array(["we say: licensed under the mit license and under the apache license version 2 0 copyright x"])))[1]
    term = known.indexed(hashes)
    found = scanner.notices(hashes)
    for k, tokens_ in enumerate(known.tokens):
        size, best = min(len(tokens_), len(hashes)), 0.0
        for a in range(len(hashes) - size + 1):
            part = hashes[a : a + size]
            dot = sum(scanner.idf2[t] * scanner.vectors[k][t] for t in term[a : a + size] if t >= 0)
            _, first, n = np.unique(part, return_index=True, return_counts=True)
            w = np.where(term >= 0, scanner.idf2[term], scanner.other)[a : a + size][first]
            best = max(best, dot / (np.sqrt((w * n * n).sum()) * scanner.norms[k]))
        # Anchors lose no match; stretches below the threshold may go unmeasured.
        assert found[k] == pytest.approx(best) if best >= licenses.THRESHOLD else found[k] <= best + 1e-9
    assert sum(found >= licenses.THRESHOLD) >= 2


def test_whole_scan_equals_brute_force(spark):
    rng = random.Random(3)
    flat = [t for texts in licenses.TEMPLATES.values() for t in texts]
    rows = [(f"d{rng.randrange(4)}/s{rng.randrange(3)}/f{i}", " ".join(rng.choice(flat).split()[: rng.randrange(1, 30)]) + " " + " ".join(rng.choice("the a free license version of use part".split()) for _ in range(rng.randrange(12)))) for i in range(80)]
    got = {r.path: (r.license, r.found, r.declared_in) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == brute.licenses(rows, licenses.TEMPLATES, licenses.THRESHOLD)
    assert {f for _, f, _ in got.values()} >= {"file", "notice", "inherited"}


@pytest.mark.parametrize("total", [10, 250, 2500, 10**6, 10**9])
def test_notices_match_at_any_table_size(total):
    known = licenses.Templates(licenses.TEMPLATES)
    notices = [(name, text) for name, texts in licenses.TEMPLATES.items() for text in texts]
    notices += [("Proprietary", "&copy; 2020 Foo Bar. All rights reserved."), ("Proprietary", "All rights reserved.")]
    for share in (0, 0.3):  # words that no other file has, and common ones
        scanner = licenses.Scanner(known, total, np.full(len(known.terms), int(share * total)))
        for name, text in notices:
            got = scanner.notices(next(licenses._hashed(pa.array([f"some page {text} and more"])))[1])
            assert got.max() >= licenses.THRESHOLD and known.names[int(got.argmax())] == name
    # The word that pages write as a sign is in none of them.
    counts = np.full(len(known.terms), total // 100)
    counts[known.indexed(next(licenses._hashed(pa.array(["copyright"])))[1])] = 0
    got = licenses.Scanner(known, total, counts).notices(next(licenses._hashed(pa.array(["&copy; Foo. All rights reserved. More"])))[1])
    assert got.max() >= licenses.THRESHOLD and known.names[int(got.argmax())] == "Proprietary"


def test_all_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "EPOCHS", 1)
    rows = [(i, f"some words of text {i}", f"l{i % 230:03d}") for i in range(2300)]
    net = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.languages == [f"l{i:03d}" for i in range(230)]
