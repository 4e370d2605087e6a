"""Dedup, language ID, scoring, search and archives against brute force on small tables."""

import base64
import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from sievework.llm import exact_dedup, graph, langid, line_dedup, lm_scoring, near_dedup, neighbours, warc

SCHEMA = "doc_id long, text string, lang string"


def prose(rnd, n, letters="abcdefgh"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n))


def test_exact_groups(spark):
    rnd = random.Random(5)
    long = ". ".join(prose(rnd, 12) for _ in range(300))
    rows = [(1, long, "x"), (2, long, "x"), (3, long + " ", "x"), (4, None, "x"), (5, "", "x"), (6, "a", "x"), (6, "a", "x"), (None, "a", "x"), (None, "b", "x"), (7, "A", "x"), (8, long[:-1], "x")]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.group_equal(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = []
    for key, text, _ in rows:
        same = [k for k, t, _ in rows if (t or "") == (text or "")]
        keep = max((k for k in same if k is not None), default=None)
        want.append((key, keep, len(same), key == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert exact_dedup.group_equal(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chunks_give_the_text_back(spark):
    rnd = random.Random(6)
    texts = ["", "\n" * 3000, "x" * 20_000, ". ".join(prose(rnd, 9) for _ in range(400)), "é😀. " * 4000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    joined = {r.doc_id: r.j for r in df.selectExpr("doc_id", "text").select("doc_id", __import__("pyspark").sql.functions.array_join(exact_dedup._chunks(df.text), "").alias("j")).collect()}
    assert joined == dict(enumerate(texts))


def shingle_set(text):
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
    return frozenset(zip(*(words[i:] for i in range(5)))) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def test_near_groups_equal_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for base in range(12):
        words = prose(rnd, 80).split()
        for _ in range(rnd.randint(1, 14)):
            copy = list(words)
            for _ in range(rnd.randint(0, 5)):
                copy[rnd.randrange(len(copy))] = prose(rnd, 1)
            rows.append((len(rows), " ".join(copy), "x"))
    rows += [(len(rows), None, "x"), (len(rows) + 1, " \n", "x"), (len(rows) + 2, "Two Words", "x"), (len(rows) + 3, "two\twords", "x")]
    sets = {k: shingle_set(t) for k, t, _ in rows}
    root = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.group_similar(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got == {k: (len(sets[k]), root[k], root[k] == k) for k in sets}


@pytest.mark.parametrize("sent", [0, 500_000])
def test_near_groups_follow_shared_keys(spark, monkeypatch, sent):
    monkeypatch.setattr(near_dedup, "MOST_SENT", sent)
    rnd = random.Random(21)
    a, b, c, d = (prose(rnd, 60) for _ in range(4))
    near = " ".join(c.split()[:-1] + ["end"])
    rows = [(1, a), (7, a), (7, b), (5, b), (5, None), (9, None), (20, c), (21, near), (21, d), (22, d), (None, a)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.group_similar(df).collect()), key=str)
    root = {1: 1, 7: 1, 5: 1, 9: 9, 20: 20, 21: 20, 22: 20, None: None}
    assert got == sorted(((k, root[k], k is not None and root[k] == k) for k, _ in rows), key=str)


def test_large_open_buckets_are_compared_in_blocks(spark, monkeypatch):
    rnd = random.Random(17)
    base = prose(rnd, 90).split()
    rows = []
    for i in range(150):
        copy = list(base)
        for at in rnd.sample(range(90), rnd.randint(0, 4)):
            copy[at] = prose(rnd, 1) + str(i)
        rows.append((i, " ".join(copy), "x"))
    sets = {k: shingle_set(t) for k, t, _ in rows}
    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = {k: k for k in sets}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    for block in (128, 9):
        for hashes in (2_000_000, 900):
            monkeypatch.setattr(near_dedup, "BLOCK", block)
            monkeypatch.setattr(near_dedup, "BLOCK_HASHES", hashes)
            monkeypatch.setattr(near_dedup, "ROUNDS", 0)
            got = {r.doc_id: r.component_id for r in near_dedup.group_similar(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
            assert len(set(root.values())) > 1 and got == root


def test_shared_counts():
    rng = np.random.default_rng(18)
    sets = [np.unique(rng.integers(0, 6000, 5000)) for _ in range(12)]
    got = near_dedup.shared_counts(np.concatenate(sets), np.repeat(np.arange(12), [len(s) for s in sets]), np.arange(5), np.arange(5, 12))
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]


def test_sketches_merge(spark):
    rnd = random.Random(8)
    a, b = near_dedup.shingles(prose(rnd, 300)), near_dedup.shingles(prose(rnd, 200))
    assert (near_dedup.merge(near_dedup.sketch(a), near_dedup.sketch(b)) == near_dedup.sketch(np.union1d(a, b))).all()


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 130)]
    root = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def line_links(texts):
    return {frozenset(p) for p in itertools.combinations(sorted(set(texts)), 2) if abs(len(p[0]) - len(p[1])) <= 2 and distance(*p) <= line_dedup.allowed(min(map(len, p)))}


def edited(rnd, line, most):
    s = list(line)
    for _ in range(rnd.randint(0, most)):
        i = rnd.randrange(len(s))
        s[i : i + 1] = rnd.choice([[], ["z"], [s[i], "y"]])
    return "".join(s)


@pytest.mark.parametrize("few, block", [(16, 256), (1, 256), (1, 3), (0, 5)])
def test_near_lines_equal_brute_force(spark, monkeypatch, few, block):
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rnd = random.Random(10)
    lines = [prose(rnd, 7, "abcd") for _ in range(25)]
    lines += [edited(rnd, line, 3) for line in list(lines) for _ in range(2)]
    short = ["".join(rnd.choice("abc") for _ in range(n)) for n in range(3, 24) for _ in range(3)]
    lines += short + [edited(rnd, line, 2) for line in short]
    one = prose(rnd, 9)
    lines += [one[:i] + "#" + one[i + 1 :] for i in range(0, len(one), 3)]  # a group in which all lines are linked
    lines += [one * 12, one * 12 + "x", one * 12 + "xyz"]  # longer than what is verified together
    rows = [(i, "\n".join(lines[i::8]), "x") for i in range(8)] + [(8, None, "x"), (9, "\n\nab\nac", "x"), (None, lines[0], "x"), (3, lines[5], "x")]
    got = [(r.doc_id, r.line_no, r.class_id, r.n_links, r.kept) for r in line_dedup.near_lines(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    texts = [(k, n, line) for k, t, _ in rows for n, line in enumerate((t or "").split("\n"))]
    links = line_links(line for *_, line in texts)
    assert any(min(map(len, p)) < 24 for p in links)
    want = sorted(((k, n, sum(line in p for p in links)) for k, n, line in texts), key=str)
    assert sorted(((k, n, m) for k, n, _, m, _ in got), key=str) == want
    root = {line: line for *_, line in texts}
    for _ in range(len(root)):
        if not [1 for a, b in map(sorted, links) if root[a] != root[b] and not root.update({x: min(root[a], root[b]) for x in (a, b)})]:
            break
    of = {}
    for k, n, c, _, _ in got:
        of.setdefault(c, set()).update(root[line] for a, b, line in texts if (a, b) == (k, n) and (k, n) != (3, 0))
    assert all(len(r) <= 1 for r in of.values()) and len(of) == len(set(root.values()))
    assert sum(r[4] for r in got) == len(of)


def line_key_rows(lines, edits):
    codes = line_dedup._codes("".join(lines))
    size = np.array([len(x) for x in lines])
    start = np.cumsum(size) - size
    return [(i, k) for own, key in line_dedup._line_keys(codes, start, size, edits) for i, k in zip(own.tolist(), key.tolist(), strict=True)]


def test_line_keys_are_those_of_segments_and_probes(monkeypatch):
    """A row for each segment and each other probe, where own segments had one more; equal keys for equal parts, in whatever portions they are hashed."""
    rnd = random.Random(31)
    lines = ["".join(rnd.choice("abé€😀") for _ in range(n)) for n in [*range(40), 100, 333]]
    found = line_key_rows(lines, 2)
    want, of = [], {}
    for x, line in enumerate(lines):
        for length in range(max(line_dedup.EACH, len(line) - 2), len(line) + 1):
            if len(line) - length <= (most := line_dedup.allowed(length)):
                cut = line_dedup.segments(length, most)
                want += [(x, (length, i, line[at : at + n]), length < len(line) or at != cut[i][0]) for i, at, n in line_dedup.probes(length, len(line), most)]
    assert len(found) == len(want) == len(set(found)) and 12 in {sum(i == x for i, _ in found) for x in range(len(lines))}
    for x, part, probe in want:
        of.setdefault(x, []).append((part, probe))
    by_key = {}
    for x, key in found:
        by_key.setdefault(x, []).append(key & 1)
    assert all(sorted(by_key[x]) == sorted(int(p) for _, p in parts) for x, parts in of.items())
    assert len({k >> 1 for _, k in found}) == len({part for _, part, _ in want})
    assert line_dedup._segment_keys(lines, 2) == [[k >> 1 for i, k in found if i == x and not k & 1] for x in range(len(lines))]
    monkeypatch.setattr(line_dedup, "TOGETHER_BYTES", 7)
    line_dedup._powers.cache_clear()
    assert line_key_rows(lines, 2) == found


def test_lines_meet_across_batches(spark, monkeypatch):
    """Lines that have a segment and arrive in several batches meet each other once, or are all frequent."""
    rnd = random.Random(32)
    rows = [(k << 1 | side, i, 0) for k in range(60) for i, side in enumerate([0] * rnd.randint(0, 7) + [1] * rnd.randint(0, 4))]
    monkeypatch.setattr(line_dedup, "FEW", 4)
    found = []
    for n in (1, 2, 3, 5, 1000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        met = line_dedup._met(spark.createDataFrame(rows, "key long, id long, letters int").coalesce(1), 2)
        found.append(sorted(map(str, met.collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(f == found[0] for f in found)
    few = hot = 0
    for k in range(60):
        own = [r for r in rows if r[0] >> 1 == k]
        having = sum(r[0] & 1 == 0 for r in own)
        if having > 4:
            hot += len(own) + having
        else:
            few += having * (len(own) - 1)
    assert sum("key=None" in f for f in found[0]) == few and sum("key=None" not in f for f in found[0]) == hot


def test_lines_of_one_hash_stay_apart(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "first line here\nsecond line here"), (2, "first line here")], "__key long, __text string")
    assert line_dedup._clashes(docs) is None
    digest = F.sha2(F.lit("second line here"), 256)
    clashes = spark.range(1).select(F.xxhash64(F.lit("second line here")).alias("id"), digest.alias("digest"), F.lit(1).cast("long").alias("step"))
    ids = {r.line: r.id for r in line_dedup._lines(docs, clashes).collect()}
    plain = {r.line: r.id for r in line_dedup._lines(docs, None).collect()}
    assert ids["first line here"] == plain["first line here"] and ids["second line here"] == plain["second line here"] + 1


def test_bit_parallel_distance():
    rnd = random.Random(11)
    for _ in range(4000):
        a, b = ("".join(rnd.choice("ab") for _ in range(rnd.randint(0, 8))) for _ in range(2))
        for edits in (1, 2, 3):
            assert line_dedup.within(a, b, edits) == (distance(a, b) <= edits)
    pairs = [["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))) for _ in range(2)] for _ in range(6000)]
    most = np.array([rnd.randint(0, 2) for _ in pairs])
    got = line_dedup.within_many([a for a, _ in pairs], [b for _, b in pairs], most, 2)
    assert got.tolist() == [distance(a, b) <= m for (a, b), m in zip(pairs, most, strict=True)]


def test_languages(spark):
    rnd = random.Random(12)
    rows = [(i, prose(rnd, 40, ("abcdefg", "hijklmn")[i % 2]), ("p", "q")[i % 2]) for i in range(120)] + [(500, None, "p"), (501, "123 !", "q"), (502, "Hij ÉH", None), (503, "abc " * 300_000, None), (503, "", "p")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.lang_pred): r.score for r in langid.predict(df, langid.train(df)).collect()}
    assert all((i, ("p", "q")[i % 2]) in got for i in range(120))
    assert got[500, "und"] == got[501, "und"] == got[503, "und"] == 0 and (502, "q") in got and (503, "p") in got
    assert all(0 <= s <= 1 for s in got.values())


def test_every_label_is_learned(spark):
    rnd = random.Random(20)
    alphabets = ["".join(chr(0x4E00 + 40 * i + j) for j in range(20)) for i in range(70)]
    rows = [(100 * i + j, prose(rnd, 30, alphabets[i]), f"l{i:02}") for i in range(70) for j in range(3 if i == 69 else 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, langid.train(df)).collect()}
    assert got == {k: lang for k, _, lang in rows}


def test_languages_without_labels(spark):
    import corpus_pipeline

    for rows in ([], [(1, "some text", None), (None, None, None), (2, None, "x")]):
        df = spark.createDataFrame(rows, SCHEMA)
        got = langid.predict(df, langid.train(df)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(((k, "und", 0.0) for k, _, _ in rows), key=str)
        kept = corpus_pipeline.identify_language(spark, df, "")
        assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(rows, key=str)


def test_languages_of_very_long_texts(spark):
    rnd = random.Random(23)
    parts = [[prose(rnd, 1, "abcdefghijklmnopqrstuvwxyz")[:3] for _ in range(60)] for _ in range(2)]
    word = lambda own: "".join(rnd.choice(own) for _ in range(rnd.randint(1, 3)))
    noise = lambda: prose(rnd, 1, "abcdefghijklmnopqrstuvwxyz")
    text = lambda own, n: " ".join(noise() if i % 4 == 0 else word(own) for i in range(n))
    rows = [(i, text(parts[i % 2], 80), "pq"[i % 2]) for i in range(100)]
    model = langid.train(spark.createDataFrame(rows, SCHEMA))
    long = spark.createDataFrame([(i, text(parts[i % 2], n), "") for i, n in enumerate((20_000, 20_000, 200_000, 200_000))], SCHEMA)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(long, model).collect()}
    assert [got[i][0] for i in range(4)] == ["p", "q", "p", "q"] and all(s > 0.6 for _, s in got.values())


def test_language_scores_equal_kernel_ridge_regression():
    rnd = random.Random(24)
    rows = [(("p", "q", "r")[i % 3], prose(rnd, 12, ("abcdef", "defghi", "ghijkl")[i % 3])) for i in range(21)]
    sets = [{*np.flatnonzero(langid.presence([t])[0][0]).tolist()} for _, t in rows]
    kernel = lambda x, y: len(x & y) / np.sqrt(len(x) * len(y))
    k = np.array([[kernel(x, y) for y in sets] for x in sets])  # every row is a landmark
    y = np.array([[lang == other for other in "pqr"] for lang, _ in rows], float)
    alpha = np.linalg.solve(k.T @ k + langid.PENALTY * len(rows) * k + 1e-8 * np.eye(len(rows)), k.T @ y)
    found = langid.presence([t for _, t in rows])[0]
    marks = langid.Landmarks(["p", "q", "r"], np.packbits(found.astype(np.uint8), axis=1))
    model = marks.solved(*marks.products(found, np.arange(21) % 3, np.ones(21)), 21)
    new = [prose(rnd, 9, "abcdefghi"), prose(rnd, 9, "ghijkl")]
    want = np.array([[kernel({*np.flatnonzero(langid.presence([t])[0][0]).tolist()}, x) for x in sets] for t in new]) @ alpha
    assert model.languages == ["p", "q", "r"] and np.allclose(model.scores(new)[0], want, atol=1e-4)


def test_all_windows_of_a_text_teach(spark):
    rnd = random.Random(25)
    texts = [" ".join(prose(rnd, 700, alphabet) for alphabet in ("abcdefg", "efghijk", "ijklmno")) for _ in range(3)] + [prose(rnd, 30, "hijklmnop"), "", "ij"]
    rows = [("pq"[i // 3], i % 3 + 1, t) for i, t in enumerate(texts)]
    parts = [(label, n, langid.windows(t)) for label, n, t in rows]
    assert max(len(w) for *_, w in parts) > 1
    bits = [(n, label, np.packbits(langid.presence([w[n % len(w)] if w else ""])[0].astype(np.uint8))) for label, n, w in parts]
    marks = langid.Landmarks(["p", "q"], np.array([b for *_, b in sorted(bits, key=lambda x: x[:2])]))
    normal, aim = marks.empty()
    for label, _, w in parts:
        for one in w:
            more = marks.products(langid.presence([one])[0], np.array(["pq".index(label)]), np.array([6 / 2 / 3 / len(w)]))
            normal, aim = normal + more[0], aim + more[1]
    model = langid.teach(spark.createDataFrame(rows, "label string, n long, text string").repartition(3))
    assert model.languages == ["p", "q"] and np.allclose(model.weights, marks.solved(normal, aim, 6).weights, atol=1e-5)


def test_ties_of_languages_go_to_the_first(spark):
    model = langid.Model(["p", "q"], np.ones((langid.PLACES, 2), np.float32))
    got = langid.predict(spark.createDataFrame([(1, "abc", None), (1, "abc", None), (None, None, None)], SCHEMA), model).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == [("1", "p"), ("1", "p"), ("None", "und")]


def test_language_accuracy_on_held_out_documents(spark):
    from sievework.llm.queries import op7_language_id

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = op7_language_id(spark, "/root/testdata/sf0.01").filter("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def lm_losses(rows, targets):
    """doc_id -> words, background and target loss, from the definition; rows: doc_id, text."""
    own = [(k, (t or "").lower().split()) for k, t in rows]
    size = len({w for _, x in own for w in x}) + 1
    models = []
    for docs in (own, [x for x in own if x[0] in targets]):
        pairs = Counter(p for _, x in docs for p in zip(["<s>", *x], x, strict=False))
        one = Counter(w for _, x in docs for w in x)
        models.append((pairs, one, {**one, "<s>": sum(bool(x) for _, x in docs)}, sum(one.values())))
    out = []
    for k, x in own:
        losses = []
        for pairs, one, before, total in models:
            loss = 0.0
            for a, b in zip(["<s>", *x], x, strict=False):
                p = (one[b] + 1) / (total + size)
                if before.get(a):
                    p = 0.7 * pairs[a, b] / before[a] + 0.3 * p
                loss -= np.log(p)
            losses.append(loss / max(1, len(x)))
        out.append((k, len(x), *losses))
    return sorted(out, key=str)


def test_lm_scores_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(13)
    words = [prose(rnd, 1) for _ in range(30)]
    rows = [(i, " ".join(rnd.choice(words[:20] if i % 2 else words[10:]) for _ in range(30)), "x") for i in range(30)] + [(90, None, "x"), (91, " ", "x"), (92, "Never-Seen word", "x"), (92, words[3], "x"), (None, "word word", "x")]
    rows += [(100 + i, f"{prose(rnd, 40)} own{i} {words[i % 30]}", "x") for i in range(40)]  # mostly words that occur once
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    target = spark.createDataFrame([(i,) for i in range(1, 30, 2)] * 2 + [(None,)], "doc_id long")
    want = lm_losses([r[:2] for r in rows], set(range(1, 30, 2)))
    for block, part in ((1 << 21, 1 << 20), (50, 100), (200, 7)):
        monkeypatch.setattr(lm_scoring, "BLOCK_WORDS", block)
        monkeypatch.setattr(lm_scoring, "RANGE_WORDS", part)
        for scored in (lm_scoring.score_corpus(df, target), lm_scoring.score(df, lm_scoring.train(df, target))):
            got = sorted(((r.doc_id, r.n_words, r.background_loss, r.target_loss) for r in scored.collect()), key=str)
            assert [r[:2] for r in got] == [r[:2] for r in want]
            assert np.allclose([r[2:] for r in got], [r[2:] for r in want])
    got = {r.doc_id: r.difference for r in scored.collect()}
    assert np.mean([got[i] for i in range(1, 30, 2)]) < np.mean([got[i] for i in range(0, 30, 2)])


def test_lm_keeps_rare_words_of_a_large_corpus(spark, monkeypatch):
    common = " ".join(["to be"] * 100_000)
    rows = [(i, common, "x") for i in range(6)] + [(10, "rare pair here", "x"), (11, "rare pair there", "x"), (12, "to rare be once", "x"), (None, "to be", "x"), (12, " ".join(f"own{i}" for i in range(20)), "x")]
    df, target = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(10,), (0,)], "doc_id long")
    total, size = 6 * 200_000 + 3 + 3 + 4 + 2 + 20, 7 + 20 + 1  # to be rare pair here there once, the invented words, the unknown one
    model = lm_scoring.train(df, target)
    unigram = lambda n: (n + 1) / (total + size)
    # "rare pair" occurs twice after "rare", which occurs three times; 11 documents start, 2 with "rare"
    want = [0.3 * unigram(3) + 0.7 * 2 / 11, 0.7 * 2 / 3 + 0.3 * unigram(2), 0.7 * 1 / 2 + 0.3 * unigram(1)]
    whole = lm_scoring.score_corpus(df, target)
    assert {r.doc_id: r for r in whole.collect()}[10].background_loss == pytest.approx(-np.log(want).sum() / 3)
    monkeypatch.setattr(lm_scoring, "MOST_SENT", 1)
    want, got = (sorted(map(tuple, x.collect()), key=str) for x in (whole, lm_scoring.score_corpus(df, target)))
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2:] for r in got], [r[2:] for r in want])
    held_out = spark.createDataFrame([(1, "pair be unseen", "x")], SCHEMA)
    want = [0.3 * unigram(2), 0.3 * unigram(600_002), 0.3 * unigram(0)]
    assert lm_scoring.score(held_out, model).first().background_loss == pytest.approx(-np.log(want).sum() / 3)
    empty = df.limit(0)
    assert lm_scoring.score(empty, lm_scoring.train(empty, target)).count() == lm_scoring.score_corpus(empty, target).count() == 0
    assert lm_scoring.score(held_out, lm_scoring.train(empty, target)).first().background_loss == 0  # one unknown word, of probability 1


def test_lm_foreign_texts_are_less_like_the_target(spark):
    rnd = random.Random(31)
    words = iter({prose(rnd, 1) + str(i) for i in range(120)})
    rows = [(i, " ".join(next(words) for _ in range(4)), "x") for i in range(30)]  # no two share a word
    df, target = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    model = lm_scoring.train(df, target)
    for scored in (lm_scoring.score_corpus(df, target), lm_scoring.score(df, model)):
        got = {r.doc_id: r.difference for r in scored.collect()}
        assert max(got[i] for i in range(10)) < 0 < min(got[i] for i in range(10, 30))
    shared, foreign = (rows[i][1].rsplit(" ", 1)[0] + " unseen" for i in (0, 20))  # of the target's words, of the others'
    held = {r.doc_id: r.difference for r in lm_scoring.score(spark.createDataFrame([(1, shared, "x"), (2, foreign, "x")], SCHEMA), model).collect()}
    assert held[1] < held[2]


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(14)
    vectors = {i: rng.normal(size=16).astype(np.float32).tolist() for i in range(200)}
    for i in range(50, 70):
        vectors[i] = vectors[0]
    rows = [*vectors.items(), (300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df.filter("vec_id % 10 = 0"), df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 200, 10):
        a = np.array([vectors[q]], float)
        scores = {i: float(neighbours.cosines(a, np.array([v], float))[0]) for i, v in vectors.items() if i != q}
        assert got[q] == sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert neighbours.nearest(df.limit(0), df).count() == 0 and set(got) == set(range(0, 200, 10))


def test_neighbours_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 20)
    monkeypatch.setattr(neighbours, "CANDIDATE_ROWS", 30)
    rng = np.random.default_rng(15)
    vectors = [[*v, 0.5] for v in rng.integers(-3, 4, (150, 3)).astype(float).tolist()]  # many ties
    df = spark.createDataFrame([(i, v, -1, -1, -1) for i, v in enumerate(vectors)] * 2, "vec_id long, embedding array<double>, id int, dim int, qb int").repartition(5)
    got = {}
    for r in neighbours.nearest(df.filter("vec_id % 2 = 0"), df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 150, 2))
    for q, found in got.items():
        scores = [(float(neighbours.cosines(np.array([vectors[q]]), np.array([v]))[0]), i) for i, v in enumerate(vectors) if i != q]
        best = sorted(scores, key=lambda x: (-x[0], x[1]))[:5]
        assert found == [(n, i, s) for n, (s, i) in enumerate(best, 1)]


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/é\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b", None), (4, "http://b", ""), (5, "c", "WARC/1.1\r\n\r\n" * 50_000), (None, "d", "<p>é</p>"), (None, "e", "own")]
    path = f"file://{tmp_path}/w"
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_pages(spark, path).collect()), key=str)
    want = []
    for key, _, html in rows:
        body = (html or "").encode()
        first = min((k for k, _, h in rows if (h or "") == (html or "") and k is not None), default=None)
        again = first is not None and key != first
        want.append((key, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    some = warc.read_archives(spark, path, payload=False).filter("record_type = 'revisit' AND target_uri LIKE 'http://b%'")
    assert [(r.record_id, r.refers_to, r.payload) for r in some.collect()] == [("urn:x-row:4", "urn:x-row:3", None)]


def test_only_committed_archives_are_read(spark, tmp_path):
    """Those of an aborted write are left out, those of others and of two writes are read together."""
    page = lambda i: spark.createDataFrame([(i, "u", f"page {i}")] * 2, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_pages(page(1), path)
    warc.write_pages(page(2), f"{path}/below")
    row = {"record_id": "urn:x-row:3", "record_type": "response", "target_uri": "u", "date": "d", "refers_to": None, "payload_digest": None, "payload_length": 3, "payload": b"abc"}
    (tmp_path / "w" / "foreign.warc.gz").write_bytes(warc.member(warc.record(row), 4))
    (tmp_path / "w" / f"{warc.OWN}0.warc.gz").write_bytes(warc.member(warc.record({**row, "record_id": "urn:x-row:4"}), 4))
    assert sorted(r.page_id for r in warc.read_pages(spark, path).collect()) == [1, 1, 2, 2, 3]
    assert [r.page_id for r in warc.read_pages(spark, f"{path}/foreign.warc.gz").collect()] == [3]
    writer = warc.WarcWriter({"path": path})
    (tmp_path / "w" / f"{warc.OWN}1.warc.gz").write_bytes(b"cut")
    writer.abort([None, warc.Written([{"name": f"{warc.OWN}1.warc.gz", "bytes": 3, "marks": [0]}])])
    assert not (tmp_path / "w" / f"{warc.OWN}1.warc.gz").exists()


def test_plain_and_foreign_archives(tmp_path):
    import gzip

    from pyarrow import fs

    row = {"record_id": "urn:x:1", "record_type": "response", "target_uri": "u", "date": "d", "refers_to": None, "payload_digest": None, "payload_length": 3, "payload": b"abc"}
    data = warc.record(row)
    for name, body in (("a.warc", data * 3), ("b.warc.gz", gzip.compress(data) * 3), ("c.warc.gz", warc.member(data, 4) * 3)):
        (tmp_path / name).write_bytes(body)
        for decode in (True, False):
            found = list(warc.records(fs.LocalFileSystem().open_input_file(str(tmp_path / name)), 0, len(body), lambda r: True, decode))
            assert [r["payload"] for r in found] == [b"abc" if decode else None] * 3


def test_empty_tables(spark, tmp_path):
    import public_tokenizers

    from sievework.llm import byte_bpe, packing, token_counts

    none = spark.createDataFrame([], SCHEMA)
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    assert near_dedup.group_similar(none).count() == line_dedup.near_lines(none).count() == exact_dedup.group_equal(none).count() == 0
    assert byte_bpe.encode(none, ranks, pattern).count() == token_counts.count_tokens(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert packing.pack(none, public_tokenizers.path("byte_bpe_50k.json"), ranks, pattern).count() == 0
    path = f"file://{tmp_path}/w"
    warc.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_pages(spark, path).count() == 0


def test_near_recall_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
    holders, shared = {}, Counter()
    for k in sorted(sets):
        for s in sets[k]:
            for other in holders.get(s, ()):
                shared[other, k] += 1
            holders.setdefault(s, []).append(k)
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: r.component_id for r in near_dedup.group_similar(docs).collect()}
    assert got == {k: find(k) for k in sets}
