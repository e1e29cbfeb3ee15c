"""Operators on awkward tables, against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from requisita.llm.exact_dedup import build_index, dedup_exact
from requisita.llm._shared import Workspace
from requisita.llm.language_id import identify_language
from requisita.llm.minhash_dedup import link_components
from requisita.llm.packing import pack_documents
from requisita.llm.pieces import decode_documents, encode_documents, round_trip
from requisita.llm.quality import keep_good, score_quality
from requisita.llm.substring_dedup import dedup_substrings
from requisita.llm.suffix_dedup import dedup_suffixes
from requisita.llm.topk import top_k
from requisita.llm.toxicity import score_toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Column names that clash with what the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark int, hash long, gram string, bands int, component_id long"


def passage(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefghij"), 5)) for _ in range(n))


def awkward():
    base, other = passage(1, 120), passage(2, 50)
    words = base.split(" ")
    near = " ".join(words[:60] + ["changed"] + words[61:])
    rows = [
        (1, base, "en"), (2, base, "en"), (3, base.upper(), "en"), (4, near, None),
        (5, passage(3, 40) + " " + other + " " + passage(4, 30), "de"), (6, other + "\n" + passage(5, 20), "de"),
        (7, None, "fr"), (8, "", "fr"), (9, "one two", "fr"), (10, "One  two", "fr"), (11, " \t\n", "fr"),
        (12, "ab " * 400, "en"), (13, "ß" * 300, "de"), (14, "12 34 !!", "en"),
        (15, passage(6, 5000), "en"), (15, passage(6, 5000), "en"), (None, passage(7, 60), "en"), (None, base, "en"), (None, None, None),
    ]
    return [(d, t, g, None, None, 1, 2, "x", 3, 4) for d, t, g in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(20)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def same(found, want):
    assert Counter(found) == Counter(want)


def covered(seqs, width):
    seen = Counter(tuple(s[i : i + width]) for s in seqs for i in range(len(s) - width + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - width + 1):
            if seen[tuple(s[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out


def test_exact_dedup(docs):
    rows = [(r[0], r[1] or "") for r in awkward()]
    groups = {}
    for d, t in rows:
        groups.setdefault(t, []).append(d)
    want = []
    for d, t in rows:
        keep = max((x for x in groups[t] if x is not None), default=None)
        want.append((d, keep, len(groups[t]), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    same([tuple(r) for r in dedup_exact(docs).collect()], want)
    same([tuple(r) for r in dedup_exact(docs, capacity=1).collect()], want)


def test_exact_dedup_of_hot_texts(spark):
    # 300 rows of one text and 200 of another, more than are left whole
    rows = [(i, "hot text") for i in range(300)] + [(None, "hot text")] * 9 + [(1000 + i % 150, "other") for i in range(200)] + [(2000 + i, f"t{i % 70}") for i in range(90)]
    groups = {}
    for d, t in rows:
        groups.setdefault(t, []).append(d)
    top = {t: max(x for x in own if x is not None) for t, own in groups.items()}
    want = [(d, top[t], len(groups[t]), d == top[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in rows]
    same([tuple(r) for r in dedup_exact(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()], want)


@pytest.mark.parametrize("capacity", [1, 2, 3, 10])
def test_index_splits_overfull_buckets(spark, capacity):
    texts = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    index, _, depth = build_index(texts, Workspace(spark), capacity)
    rows = index.collect()
    buckets = Counter((r.local_depth, r.bucket) for r in rows)
    assert len(rows) == 200 and max(buckets.values()) <= capacity
    for r in rows:
        assert r.bucket == ((r.hash % 2**64) >> (64 - r.local_depth) if r.local_depth else 0) and r.local_depth <= depth
    # no bucket is split for nothing: with its buddy it would be overfull
    below = lambda d, b: sum(n for (x, y), n in buckets.items() if x >= d and y >> (x - d) == b)
    assert all(d == 0 or below(d - 1, b >> 1) > capacity for d, b in buckets)


def test_chains_tell_colliding_texts_apart(spark, monkeypatch):
    # all texts of one length get one hash
    length = lambda c: F.length((F.col(c) if isinstance(c, str) else c).cast("string"))
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.shiftleft(length(c[0]).cast("long"), 60))
    rows = [(i, f"text {i % 7}") for i in range(100)] + [(200 + i, f"longer {i % 3}") for i in range(9)]
    found = dedup_exact(spark.createDataFrame(rows, "doc_id long, text string"), capacity=1).collect()
    groups = {}
    for d, t in rows:
        groups.setdefault(t, []).append(d)
    same([tuple(r)[:3] for r in found], [(d, max(groups[t]), len(groups[t])) for d, t in rows])


@pytest.mark.parametrize("width,gram", [(35, 12), (8, 3)])
def test_substring_dedup(docs, width, gram):
    rows = [(r[0], r[1] or "") for r in awkward()]
    words = [WORD.findall(t) for _, t in rows]
    want = []
    for (d, _), w, gone in zip(rows, words, covered(words, width)):
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    found = dedup_substrings(docs, width, gram).collect()
    same([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found], want)
    for r in found:
        assert hashlib.sha256(" ".join(WORD.findall(r.text)).encode()).hexdigest() == r.kept_sha256


@pytest.mark.parametrize("width,gram,most", [(200, 32, 20_000), (60, 16, 20_000), (60, 16, 2)])
def test_suffix_dedup(docs, width, gram, most):
    rows = [(r[0], (r[1] or "").encode()) for r in awkward()]
    want = []
    for (d, t), gone in zip(rows, covered([t for _, t in rows], width)):
        kept = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    found = dedup_suffixes(docs, width, gram, most).collect()
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found], want)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in found)


def lookalikes(spark):
    """Texts that differ in a few words or bytes only, so that weak fingerprints
    take many of their windows for equal."""
    r, base, rows = np.random.default_rng(12), passage(21, 90).split(" "), []
    for i in range(30):
        own = list(base)
        for at in r.choice(90, 3, replace=False):
            own[at] = own[at][:3] + str(i) + own[at][3:4]
        rows.append((i, " ".join(own)))
    return rows + [(40, rows[3][1]), (41, passage(22, 50) + " " + passage(22, 50))]


@pytest.mark.parametrize("bits", [64, 2, 0])
def test_collisions_of_fingerprints_are_found(spark, bits):
    rows = lookalikes(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = [t.split(" ") for _, t in rows]
    want = [(d, sum(gone)) for (d, _), gone in zip(rows, covered(words, 8))]
    assert 0 < sum(n for _, n in want) < sum(map(len, words))
    same([(r.doc_id, r.n_removed) for r in dedup_substrings(docs, 8, 3, prints=(0, bits)).collect()], want)
    want = [(d, sum(gone)) for (d, _), gone in zip(rows, covered([t for _, t in rows], 60))]
    same([(r.doc_id, r.n_removed) for r in dedup_suffixes(docs, 60, 16, prints=(0, bits)).collect()], want)


def test_paths_that_do_not_branch_are_joined(spark):
    from requisita.llm.repeats import find, compact, keyed

    one, two = passage(23, 400), passage(24, 300)
    docs = spark.createDataFrame([(i, one) for i in range(5)] + [(9, two), (10, two + " " + passage(25, 50))], "doc_id long, text string")
    work = Workspace(spark)
    known = find(keyed(docs), work, "word", 35, 12).known
    paths = compact(known, work).collect()
    assert known.count() > 100 and len({r.path for r in paths}) < 10
    assert {(r.doc_id, r["first"], r["last"]) for r in paths if r.doc_id < 5} == {(i, 0, 365) for i in range(5)}


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, shingles(t))
    ids = sorted(x for x in sets if x is not None)
    parent = {d: d for d in ids}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: top(d) for d in ids}


@pytest.mark.parametrize("block", [1024, 2])
def test_minhash_dedup(docs, block):
    rows = [(r[0], r[1]) for r in awkward()]
    top = brute_components(rows)
    want = [(d, len(shingles(t)), top.get(d), d is None or top[d] == d) for d, t in rows]
    same([tuple(r) for r in link_components(docs, block=block).collect()], want)


def test_minhash_of_texts_that_share_an_id(spark):
    a, b = passage(61, 90), passage(62, 90)
    rows = [(5, a), (5, b), (6, a + " more"), (8, b + " more"), (9, passage(63, 90)), (9, None), (4, passage(64, 40)), (4, passage(64, 40))]
    found = link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in found], [(d, len(shingles(t)), {6: 5, 8: 5}.get(d, d)) for d, t in rows])


def test_minhash_finds_links_that_stars_miss(spark):
    # a chain: each text replaces some more words of one base, so that far ones are no longer similar
    words, rows = passage(9, 200).split(" "), []
    for i in range(24):
        rows.append((100 - i, " ".join(w if j % 24 >= i or j > 100 else f"w{j}" for j, w in enumerate(words))))
    rows += [(200 + i, passage(50 + i, 80)) for i in range(5)]
    found = link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    top = brute_components(rows)
    same([(r.doc_id, r.component_id) for r in found], list(top.items()))


def test_topk(spark):
    r = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in r.normal(size=5).round(1)]) for i in range(300)]
    rows += [(1000, None), (1020, [1.0, None, 2.0, 0.0, 1.0]), (1040, [float("nan")] * 5), (1060, [float("inf")] + [0.0] * 4), (1080, [1.0]), (None, rows[0][1]), rows[20], (1100, [1e30] * 5), (1101, [1e30, -1e30, 0.5, 0.0, 0.0])]
    rows += [(40, rows[41][1]), (20, rows[20][1]), (21, rows[20][1]), (21, rows[20][1]), (2000, [16000.0] * 5), (2001, [16000.0, 16383.0, 0.25, -1.0, 2.0])]
    vectors = spark.createDataFrame([(*x, "c") for x in rows], "vec_id long, embedding array<float>, query string").repartition(3)
    usable = [(d, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for d, v in rows if d is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, (q, v) in enumerate(usable):
        if q % 20 == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, u)))), c) for j, (c, u) in enumerate(usable) if j != i and len(u) == len(v))
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:20])]
    same([tuple(x) for x in top_k(vectors).collect()], want)
    same([tuple(x) for x in top_k(vectors, shard_values=200, leaf=8).collect()], want)
    assert top_k(vectors.limit(0)).count() == 0


def test_topk_of_large_components(spark):
    # near 2**20 in size: scores of 50 bits, in one shard of more rows than a byte counts
    r = np.random.default_rng(4)
    values = r.integers(2**20 - 4, 2**20, (900, 64))
    rows = [(i, [float(x) / 64 for x in v]) for i, v in enumerate(values)]
    found = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf=16).collect()
    want = []
    for q in range(0, 900, 20):
        scores = sorted((-int(s), c) for c, s in enumerate(values @ values[q]) if c != q)
        want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scores[:20])]
    same([tuple(x) for x in found], want)


def test_pieces(docs):
    rows = {r[1] for r in awkward()}
    back = decode_documents(encode_documents(docs)).collect()
    assert {r.text for r in back} == rows and len(back) == len(awkward())
    found = round_trip(docs)
    signs = round_trip(docs.sparkSession.createDataFrame([(1, "a▁b"), (2, "a b")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.exact for r in signs} == {1: False, 2: True}
    assert found.where("not exact").count() == 0 and found.where("exact is null").count() == sum(r[1] is None for r in awkward())


def test_packing(docs):
    found = pack_documents(docs, (16, 64, 256), shard_pieces=7).collect()
    rows = [(r[0], len(WORD.findall(r[1] or ""))) for r in awkward()]
    assert sum(r.length for r in found) == sum(n for _, n in rows)
    by = {}
    for r in found:
        if r.length:
            by.setdefault((r.bin, r.capacity), []).append(r)
        else:
            assert r.bin is None and r.piece == 0
    for (_, capacity), own in by.items():
        own.sort(key=lambda r: r.place)
        assert [r.place for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        used = sum(r.length for r in own)
        assert capacity == min(c for c in (16, 64, 256) if c >= used)
    same({(r.doc_id, r.piece, r.start) for r in found}, {(d, i, 256 * i) for d, n in rows for i in range(max(1, -(-n // 256)))})


def test_classifiers_on_awkward_tables(docs, nothing, labels):
    n = len(awkward())
    for found in (score_quality(docs, labels), score_toxicity(docs, labels)):
        rows = found.collect()
        assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    rows = identify_language(docs).collect()
    assert len(rows) == n
    assert sorted(r.doc_id for r in rows if r.lang_pred == "und" and r.doc_id) == [7, 8, 11, 14]
    assert keep_good(docs, labels).columns == docs.columns
    # nothing to learn from
    none = labels.limit(0)
    assert {r.score for r in score_quality(docs, none).collect()} == {0.5}
    assert {r.score for r in score_toxicity(docs, none).collect()} == {0.0}
    assert {r.lang_pred for r in identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_empty_tables(nothing, labels):
    for found in (
        dedup_exact(nothing), dedup_substrings(nothing), dedup_suffixes(nothing), link_components(nothing), pack_documents(nothing), round_trip(nothing),
        identify_language(nothing), score_quality(nothing, labels), score_toxicity(nothing, labels), keep_good(nothing, labels),
    ):
        assert found.count() == 0


def labelled(spark):
    """Four alphabets of syllables; bad texts shout, toxic ones insult."""
    r = np.random.default_rng(8)
    syllables = {"en": ["th", "er", "on", "an"], "de": ["sch", "ung", "ein", "ö"], "fr": ["eau", "que", "é", "oi"], "es": ["ción", "ar", "os", "ñ"]}
    rows, marks = [], []
    for i in range(1200):
        lang = list(syllables)[i % 4]
        words = ["".join(r.choice(syllables[lang], r.integers(1, 4))) for _ in range(r.integers(5, 60))]
        bad, toxic = i % 7 == 0, i % 5 == 0
        if toxic:
            words[r.integers(len(words))] = str(r.choice(["dolt", "oaf"])) + str(r.choice(["", "ish"]))
        if bad:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), lang))
        marks.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    held = F.col("held_out")
    right = identify_language(docs).join(docs.drop("text"), "doc_id").where(held).select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    for found, label in ((score_quality(docs, labels), "quality"), (score_toxicity(docs, labels), "toxic")):
        right = found.join(labels, "doc_id").where(held).select(F.avg((F.col(label) == F.col("predicted")).cast("int"))).first()[0]
        assert right > 0.97, label


@pytest.mark.parametrize("label", ["toxic", "quality", "lang"])
def test_labels_of_held_out_rows_are_not_learnt(spark, label):
    docs, labels = labelled(spark)
    score = {"toxic": lambda d, m: score_toxicity(d, m, spans=False), "quality": score_quality, "lang": lambda d, m: identify_language(d)}[label]
    before = score(docs, labels).collect()
    held = {r.doc_id for r in before if r.held_out}
    if label == "lang":
        docs = docs.withColumn("lang", F.when(F.col("doc_id").isin(*held), F.lit("xx")).otherwise(F.col("lang")))
    else:
        labels = labels.withColumn(label, F.when(F.col("doc_id").isin(*held), 1 - F.col(label)).otherwise(F.col(label)))
    same([tuple(r)[:3] for r in before], [tuple(r)[:3] for r in score(docs, labels).collect()])


def test_any_number_of_languages(spark):
    from requisita.llm.language_id import fit_language_model

    rows = [(i, chr(0x400 + i % 250) * 30, f"l{i % 250:03}") for i in range(1000)] + [(2000, "rare", "once")]
    net = fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len(net.languages) == 251 and net.out.shape[1] == 251


def test_toxic_spans(spark):
    docs, labels = labelled(spark)
    found = score_toxicity(docs, labels).join(docs, "doc_id").where("predicted = 1").collect()
    hit = [r.text.encode()[s.start : s.end].decode().lower() for r in found for s in r.spans]
    assert len(hit) > 50 and sum(h.startswith(("dolt", "oaf")) for h in hit) > 0.9 * len(hit)


def test_classifiers_learn_from_the_whole_sample(spark):
    from requisita.llm._fit import labelled_sample
    from requisita.llm.quality import fit_quality, tokens, word_vectors

    text = F.when(F.col("id") == 7, F.concat(F.repeat(F.lit("ab "), 15_000), F.lit("zebra quagga"))).otherwise(F.concat(F.lit("plain words "), "id"))
    docs = spark.range(3800).select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"), (F.col("doc_id") % 2).alias("toxic"))
    texts, y, weight = labelled_sample(docs, labels, "toxic", 5, -1)
    assert (len(texts), y.sum(), max(map(len, texts))) == (3800, 1900, 45_012) and (weight == 1).all()
    # a smaller sample has fewer texts, and whole ones
    texts, _, _ = labelled_sample(docs, labels, "toxic", 5, -1, chars=1000)
    assert 0 < len(texts) < 100 and all(t in ("zebra quagga",) or len(t) in (13, 14, 15, 16, 45_012) for t in texts)
    vectors, _ = fit_quality(docs, labels, 5, -1)
    data = b"zebra"
    bucket = tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0][0]
    # the end of a text of 45,000 characters counts
    assert not np.allclose(vectors[bucket], word_vectors(np.zeros(vectors.shape))[bucket])


def test_word_vectors_cover_all_documents(spark):
    from requisita.llm.quality import fit_quality, tokens, word_vectors

    docs = spark.createDataFrame([(i, f"plain words {i}") for i in range(20)] + [(99, "zebra quagga"), (None, "okapi quagga"), (98, None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    vectors, _ = fit_quality(docs, labels, 5, -1)
    alone = word_vectors(np.zeros(vectors.shape))
    for data in (b"zebra", b"okapi"):  # in no labelled document
        bucket = tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0][0]
        assert not np.allclose(vectors[bucket], alone[bucket])
