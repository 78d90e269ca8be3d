"""Near-duplicate and join operators against brute force."""

import random

import pytest

import corpus_pipeline
from driftline.llm import components, decontam, linededup, simhash, sketch
from driftline.llm.components import connected_components

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def awkward(rng):
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t"), (7, "one"), (8, "one two"), (None, base), (9, "É " * 3000), (9, "É " * 3000)]
    rows += [(20 + i, prose(rng, rng.randrange(1, 90), 30)) for i in range(25)]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components_on_chains_stars_and_cycles(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "IN_ONE_TASK", one_task)
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    rng.shuffle(pairs)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(50)} == {100} and got[202] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    pair = lambda x: (x % 7 - 3, x)
    edges = spark.createDataFrame([(pair(a), pair(b)) for a, b in pairs], "a struct<p: long, q: long>, b struct<p: long, q: long>")
    found = {tuple(r.node): tuple(r.label) for r in connected_components(edges).collect()}
    want = {}
    for n, l in got.items():
        want[l] = min(want.get(l, pair(n)), pair(n))
    assert found == {pair(n): want[l] for n, l in got.items()}


def test_simhash_equals_brute_force(spark):
    rows = awkward(random.Random(1))
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    prints = [brute.simhash(r[1]) for r in rows]
    n = len(rows)
    label = brute.components(n, [(a, b) for a in range(n) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    first = {}
    for i in range(n):
        if rows[i][0] is not None:
            first[label[i]] = min(first.get(label[i], 10**9), rows[i][0])
    want = sorted((rows[i][0] or -1, f"{prints[i]:016x}", first[label[i]]) for i in range(n))
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in got) == want


def test_near_pairs_lose_none(spark):
    rng = random.Random(2)
    bits = {rng.getrandbits(64) for _ in range(200)}
    for b in list(bits)[:80]:
        bits.add(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    got = {(r.a, r.b) for r in simhash.near_pairs(spark.createDataFrame([(b,) for b in signed], "bits long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want and len(want) >= 70


def test_one_of_each_group_stays(spark):
    rows = awkward(random.Random(1))
    left = simhash.without_near_duplicates(spark.createDataFrame(rows, DOCS))
    ids = [r.doc_id for r in left.collect()]
    assert left.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert 1 in ids and 2 not in ids and None not in ids and ids.count(9) == 1 and len(ids) == len(set(ids))
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_sketch_equals_brute_force(spark):
    rows = awkward(random.Random(3))
    got = sketch.edited_and_next(spark.createDataFrame(rows, DOCS)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, (d, t, *_) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = (brute.sketch(x, sketch.K) for x in (t, edited, after))
        want.append((d or -1, len(t), brute.hashlib.sha256(edited.encode()).hexdigest(), round(brute.likeness(a, b, sketch.K), 9), round(brute.likeness(a, c, sketch.K), 9), a))
    have = [(r.doc_id or -1, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9), sketch.decode(r.fingerprint).tolist()) for r in got]
    assert sorted(have) == sorted(want)
    assert sketch.edited_and_next(spark.createDataFrame([], DOCS)).count() == 0


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(4)
    a, b = [f"x{i}" for i in range(3000)], [f"x{i}" for i in range(1500, 4500)]
    import numpy as np
    import xxhash

    sa, sb = (sketch.bottom(np.array([xxhash.xxh64_intdigest(x, 42) for x in s], dtype=np.uint64)) for s in (a, b))
    assert abs(sketch.resemblance(sa, sb) - 1 / 3) < 0.13
    assert abs(sketch.distinct_count(sketch.merge(sa, sb)) / 4500 - 1) < 0.3
    assert abs(sketch.containment(sa, sb) - 0.5) < 0.2
    texts = [(i % 2, prose(rng, 50)) for i in range(12)]
    parts = sketch.fingerprint(spark.createDataFrame(texts, "doc_id long, text string"))
    for r in sketch.merged(parts, "doc_id").collect():
        whole = sorted({h for k, t in texts if k == r.doc_id for h in brute.sketch(t, 10**6)})[: sketch.K]
        assert sketch.decode(r.fingerprint).tolist() == whole


ITEMS = [(7, "a b c"), (None, "b c q w e r t y u i o p a s"), (8, "a"), (9, None), (10, "--"), (7, "a b c"), (11, "Q w e r t y u i o p a s d f g h j k l")]
TEXTS = [(None, "a b c d"), (1, None), (1, ""), (2, "a b, c"), (2, "a b, c"), (3, "É b c q w e r t y u i o p a s d f g h"), (4, "x A"), (5, "z " * 5000 + "q w e r t y u i o p a s d"), (5, "no hit")]


def test_contamination_equals_brute_force_either_way(spark):
    docs = spark.createDataFrame([(*r, "x") for r in TEXTS], "doc_id long, text string, span string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(brute.contamination(TEXTS, ITEMS), key=str)
    for bound in (10**6, 0):
        assert sorted(map(tuple, decontam.contamination(docs, items, bound).collect()), key=str) == want
    full = {w[0] for w in brute.contamination(TEXTS, [i for i in ITEMS if len(brute.bench_words(i[1])) >= 13]) if w[2]}
    bad = {(w[0], w[1]) for w in want if w[5] or (w[0] in full and w[2])}
    for bound in (10**6, 0):
        left = decontam.clean_documents(docs, items, bound)
        assert left.columns == docs.columns
        assert sorted(map(str, left.collect())) == sorted(str(r) for r in docs.collect() if (r.doc_id, len(brute.bench_words(r.text))) not in bad)
    assert (5, 5013) in bad and not next(w[5] for w in want if w[1] == 5013)


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontam.contamination(docs, none).collect()} == {0}
    assert decontam.contamination(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_edit_distances():
    rng = random.Random(6)
    left, right = [], []
    for _ in range(800):
        x = "".join(rng.choice("abé\U0001f600") for _ in range(rng.randrange(40)))
        y = list(x)
        for _ in range(rng.randrange(5)):
            p = rng.randrange(len(y) + 1)
            y[p : p + rng.randrange(2)] = rng.choice(["", "a", "c"])
        left.append(x)
        right.append("".join(y))
    for edits in (1, 2, 3):
        assert linededup.edit_distances(left, right, edits).tolist() == [min(brute.edit_distance(x, y), edits + 1) for x, y in zip(left, right)]


def line_rows():
    rng = random.Random(8)
    base = [prose(rng, 12) for _ in range(12)]
    rows = []
    for i in range(20):
        lines = []
        for _ in range(6):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                x[rng.randrange(len(x))] = rng.choice("xyz")
            lines.append("".join(x))
        rows.append((i, "\n".join([*lines, "short", ""])))
    return [*rows, rows[0], (None, rows[1][1]), (50, None), (51, ""), (52, "\n" * 300), (53, "l" * 20000)]


def test_line_classes_equal_brute_force(spark):
    rows = line_rows()
    got = linededup.line_classes(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, line int, links int"))
    places = {}
    for d, t in {r for r in rows if r[1] is not None}:
        for n, line in enumerate(t.split("\n")):
            if len(line) >= linededup.LEAST_CHARS:
                places.setdefault(line, []).append((d is None, d or 0, n))
    texts = sorted(places)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if brute.edit_distance(texts[i], texts[j]) <= 2]
    label = brute.components(len(texts), pairs)
    degree = [sum(i in p for p in pairs) for i in range(len(texts))]
    head = {c: min(min(places[texts[i]]) for i in range(len(texts)) if label[i] == c) for c in set(label)}
    want = sorted((*p, degree[i], *head[label[i]][1:], p == head[label[i]]) for i in range(len(texts)) for p in places[texts[i]])
    have = sorted((r.doc_id is None, r.doc_id or 0, r.line_no, r.links, r.class_doc or 0, r.class_line, r.kept) for r in got.collect())
    assert have == want and any(degree)


def test_repeated_lines_go(spark):
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in line_rows()], "doc_id long, text string, n_chars long")
    left = linededup.without_repeated_lines(docs)
    rows = left.collect()
    assert left.columns == docs.columns and len(rows) == docs.count()
    distinct = {(r.doc_id, r.text) for r in rows if r.text}
    lines = [x for _, t in distinct for x in t.split("\n") if len(x) >= linededup.LEAST_CHARS]
    assert len(lines) == len(set(lines))
    assert all(r.n_chars == len(r.text or "") for r in rows)
    assert [r.text for r in rows if r.doc_id in (50, 51)] .count(None) == 1
    assert linededup.without_repeated_lines(docs.limit(0)).count() == 0


def test_links_of_large_groups_equal_brute_force(spark):
    rng = random.Random(9)
    base = prose(rng, 12)
    copies = {base}
    for _ in range(90):
        x = list(base)
        for _ in range(rng.randrange(3)):
            x[rng.randrange(len(x))] = rng.choice(["", "x", "yz"])
        copies.add("".join(x))
    copies = sorted(copies)
    near = [sum(brute.edit_distance(a, b) <= 2 for b in copies) - 1 for a in copies]
    # Each line in several documents: repeats aren't partners.
    docs = spark.createDataFrame([(i, copies[i % len(copies)]) for i in range(3 * len(copies))], "doc_id long, text string").repartition(7)
    for block in (256, 16):
        got = linededup.line_classes(docs, block=block).collect()
        assert sorted((r.doc_id, r.links) for r in got) == [(i, near[i % len(copies)]) for i in range(3 * len(copies))]


def test_short_lines_match_and_go(spark):
    texts = ["All rights reserved.\nyes\n\nRead more here", "All rights reserved.\nyes\nyet", "All right reserved.\n\nRead mere hare", "All rights reversed."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.links, r.class_doc, r.class_line, r.kept) for r in linededup.line_classes(docs).collect()}
    assert len(got) == sum(len(t.split("\n")) for t in texts)
    # One edit from 12 characters on, two from 24 on; shorter lines match only equal ones.
    assert got[1, 0] == (1, 0, 0, False) and got[2, 0] == (1, 0, 0, False)
    assert got[1, 1] == (0, 0, 1, False) and got[1, 2] == (0, 1, 2, True)
    assert got[2, 1] == (0, 0, 2, False) and got[2, 2][3] and got[3, 0][3]
    left = {r.doc_id: r.text for r in linededup.without_repeated_lines(docs).collect()}
    assert left == {0: texts[0], 1: "yet", 2: "Read mere hare", 3: texts[3]}


def test_pipeline_keeps_one_of_each_near_duplicate_class(spark, monkeypatch):
    rng = random.Random(12)
    rows = awkward(rng)
    passage = prose(rng, 30)
    for i in range(12):
        base = prose(rng, 100).split()
        for j in range(4):
            words = list(base)
            for _ in range(j):
                words[rng.randrange(len(words))] = f"new{rng.randrange(9)}"
            rows.append((100 + 4 * i + j, " ".join([*words, passage]), "en", "s", 1))
    sets = [set(brute.shingles(r[1], 5)) for r in rows]
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    label = brute.components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if near(sets[a], sets[b])])
    want = {}
    for i, r in enumerate(rows):
        want[label[i]] = min(want.get(label[i], 10**9), 10**9 if r[0] is None else r[0])
    docs = spark.createDataFrame(rows, DOCS)
    for common in (200, 5):  # shingles of the passage in any order, or last
        if common == 5:
            monkeypatch.setattr(corpus_pipeline.resemblance.without_near_duplicates, "__defaults__", (5,))
        left = corpus_pipeline.remove_near_duplicates(spark, docs, "")
        assert sorted(r.doc_id for r in left.collect()) == sorted(want.values()) and left.columns == docs.columns
    assert len(want) < len(rows) - 20
    assert corpus_pipeline.remove_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_large_group_of_near_copies_is_one_class(spark):
    """Copies with a word changed here or there are near the original, and few of them one another."""
    rng = random.Random(13)
    base = prose(rng, 70).split()
    rows = [(1000, " ".join(base))]
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([1, 1, 2])):
            words[rng.randrange(len(words))] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(2000 + i, prose(rng, 70)) for i in range(20)]
    sets = [set(brute.shingles(t, 5)) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label = brute.components(len(rows), pairs)
    want = {}
    for i, (d, _) in enumerate(rows):
        want[label[i]] = min(want.get(label[i], 10**9), d)
    left = corpus_pipeline.remove_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in left.collect()) == sorted(want.values()) and len(want) < 60


def test_pipeline_runs_end_to_end(spark, tmp_path):
    rng = random.Random(14)
    item = prose(rng, 30, 4000)
    toxic, kind = "you vile horrid pest go away ", "a calm and friendly note "
    rows = [(i, (toxic if i % 4 == 0 else kind) + prose(rng, 40, 3000), "en", f"s{i % 2}", 1) for i in range(120)]
    rows += [(200, rows[1][1] + " tail", "en", "s0", 1), (201, None, None, None, None), (202, "", "en", "s1", 0), (203, kind + item, "en", "s1", 1), (204, kind + prose(rng, 900, 3000) + " " + item, "en", "s1", 1), rows[5], (None, kind + prose(rng, 40, 3000), "en", None, 1)]
    labels = [(i, int(i % 4 == 0)) for i in range(120)]
    tables = {"documents": (rows, DOCS), "labels": (labels, "doc_id long, toxic int"), "benchmark": ([("b1", item)], "item_id string, text string")}
    for name, (part, schema) in tables.items():
        spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/full/{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/{name}.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/full")
    ids = [r.doc_id for r in got.collect()]
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
    clean = {i for i in range(120) if i % 4}
    # Near copies, benchmark passages, toxic and empty documents are gone; what is left is taken by weight.
    assert set(ids) - {None} <= clean and None in ids and len(set(ids) & clean) > 60
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    assert abs(sum(size[i] for i in ids) - sum(size[i] for i in clean | {None})) < 400
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_columns_may_have_any_name(spark):
    names = "key row gone lines before after print nth order h1 h2 first label bits kept links n_words full".split()
    rows = [(i, t, f"s{(i or 0) % 2}", *[f"{c}{i}" for c in names]) for i, t, *_ in awkward(random.Random(1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {
        "simhash": simhash.without_near_duplicates(docs),
        "resemblance": corpus_pipeline.resemblance.without_near_duplicates(docs),
        "lines": linededup.without_repeated_lines(docs),
        "decontam": decontam.clean_documents(docs, items),
        "mixing": corpus_pipeline.mixing.mixed_documents(docs),
    }
    for name, got in found.items():
        assert got.columns == docs.columns, name
        kept = got.collect()
        assert kept and all(r[c] == f"{c}{r.doc_id}" for r in kept for c in names), name


def test_string_ids_work(spark):
    rows = [(f"d{i}", t, "en", "s", n) for i, (_, t, _, _, n) in enumerate(awkward(random.Random(1)))]
    docs = spark.createDataFrame(rows, DOCS.replace("doc_id long", "doc_id string"))
    assert simhash.near_duplicates(docs).count() == len(rows)
    assert corpus_pipeline.remove_near_duplicates(spark, docs, "").count() < len(rows)
    assert {r.n_words for r in decontam.contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()} >= {0, 1, 2}
    assert corpus_pipeline.mixing.mix(docs).count() == len(rows)
    assert linededup.without_repeated_lines(docs).count() == len(rows)
