"""Kernels and codecs against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from requisita.llm import _seq
from requisita.llm._fit import flat
from requisita.llm._shingles import band_keys, one_permutation, shingle_sets
from requisita.llm.packing import pack
from requisita.llm.pieces import PieceCodec, default_model
from requisita.llm.suffix_dedup import Suffixes
from requisita.llm.topk import BallTree, search

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", "a", " a  b\tc\n", "ß ñ\x0bz", "x" * 50, "same same same", "\x00 \x1c", "Ab aB"]


def test_words_match_the_pattern():
    buf, offsets = _seq.column_bytes(pa.array([*TEXTS, None]))
    s, e, first = _seq.words(buf, offsets)
    for i, text in enumerate([*TEXTS, ""]):
        got = [buf[a:b].tobytes().decode() for a, b in zip(s[first[i] : first[i + 1]], e[first[i] : first[i + 1]])]
        assert got == WORD.findall(text)


def test_sliced_columns():
    column = pa.array(TEXTS)[2:5]
    buf, offsets = _seq.column_bytes(column)
    assert [buf[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])] == TEXTS[2:5]


def test_fingerprints_are_of_content():
    buf = np.frombuffer(b"abcabcxabc", np.uint8)
    p = _seq.Prefix(_seq.alphabet()[buf])
    a = p.of(np.array([0, 3, 7, 1]), np.array([3, 6, 10, 4]))
    assert a[0] == a[1] == a[2] != a[3]


@pytest.mark.parametrize("w", [1, 2, 5, 16])
def test_sliding_min(w):
    a = np.random.default_rng(w).integers(0, 99, 40).astype(np.uint64)
    assert _seq.sliding_min(a, w).tolist() == [min(a[i : i + w]) for i in range(41 - w)]


def test_equal_windows_have_equal_extents():
    random.seed(4)
    core = bytes(random.choices(b"abcdefgh", k=300))
    texts = [core, b"12" + core + b"34", core[:150]]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    x = _seq.Extents(_seq.alphabet()[buf], bounds, 100, 16)
    assert sum(x.last - x.first + 1) == sum(len(t) - 99 for t in texts)
    first = {(int(g), int(a - f)) for g, a, f, t in zip(x.gram, x.anchor, x.first, x.text) if t == 0}
    assert first & {(int(g), int(a - f)) for g, a, f, t in zip(x.gram, x.anchor, x.first, x.text) if t == 1}


@pytest.mark.parametrize("step", [1, -1])
def test_mergesort_of_suffixes(step):
    rng = np.random.default_rng(3)
    buf = rng.integers(97, 99, 400).astype(np.uint8)
    start = np.sort(rng.choice(np.arange(100, 300), 60, replace=False))
    length = rng.integers(0, 90, 60)
    group = np.sort(rng.integers(0, 4, 60))
    s = Suffixes(buf, start, length, step, _seq.Prefix(_seq.alphabet()[buf]))
    order, common = s.sort(group)
    want = sorted(range(60), key=lambda i: (group[i], s.content(i)))
    assert [(group[i], s.content(i)) for i in order] == [(group[i], s.content(i)) for i in want]
    for r in range(1, 60):
        a, b = s.content(order[r - 1]), s.content(order[r])
        m = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert common[r] == (m if group[order[r]] == group[order[r - 1]] else -1)


def test_mergesort_survives_collisions():
    class Blind(_seq.Prefix):
        def of(self, s, e):
            return np.zeros(len(s), np.uint64)

    buf = np.frombuffer(b"banana" * 3, np.uint8)
    s = Suffixes(buf, np.arange(12), np.full(12, 6), 1, Blind(_seq.alphabet()[buf]))
    order, _ = s.sort(np.zeros(12, int))
    assert [s.content(i) for i in order] == sorted(s.content(i) for i in range(12))


def test_shingles():
    texts = ["A b c d e f", "a B c", "", "a b c d e a b c d e", " "]
    values, first = shingle_sets(*flat(texts))
    assert np.diff(first).tolist() == [2, 1, 0, 5, 0]
    assert set(values[:2]) & set(values[first[3] : first[4]])


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**64, 2000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[200:], rng.integers(0, 2**64, 200, dtype=np.uint64)]))
    sketch = one_permutation(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 256)
    assert abs((sketch[0] == sketch[1]).mean() - 1800 / 2200) < 0.1
    few = one_permutation(np.sort(a[:5]), np.array([0, 5, 5]), 256)
    assert set(few[0]) <= set(a[:5]) and not few[1].any()
    assert band_keys(sketch, 6).shape == (2, 42)


def test_pack_fits_and_is_whole():
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.integers(1, 2049, 500))[::-1]
    b, place, capacity = pack(sizes)
    for k in range(len(capacity)):
        own = np.flatnonzero(b == k)
        used = sizes[own].sum()
        assert used <= capacity[k] and capacity[k] == min(c for c in (256, 512, 1024, 2048) if c >= used)
        assert sorted(place[own]) == [0, *np.cumsum(sizes[own][np.argsort(place[own])])[:-1]]
    assert sizes.sum() / capacity.sum() > 0.95


def test_pack_picks_the_best_fit():
    b, place, capacity = pack(np.array([200, 120, 100, 56]), (256,))
    assert b.tolist() == [0, 1, 1, 0] and place.tolist() == [0, 0, 120, 200]


def test_ball_tree_search_is_exact():
    rng = np.random.default_rng(5)
    points = rng.integers(-8, 8, (700, 6)).astype(float)
    ids = rng.permutation(5000)[:700]
    queries, query_ids = points[:40], ids[:40]
    for floor in (-np.inf, 60.0):
        q, c, s = search(BallTree(points, 16), points, ids, np.arange(700), queries, np.arange(40), np.full(40, floor), 7)
        got = {}
        for i, j, x in zip(q, c, s):
            got.setdefault(int(i), []).append((-int(x), int(ids[j])))
        for i in range(40):
            scores = points @ queries[i]
            want = sorted((-int(x), int(d)) for x, d in zip(scores, ids) if d != query_ids[i] and x >= floor)[:7]
            assert sorted(got.get(i, [])) == want


def unigram(model: bytes) -> bytes:
    """The same vocabulary, marked as a unigram model: its library then segments
    by best score too."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(model)
    m.trainer_spec.model_type = 1
    del sentencepiece
    return m.SerializeToString()


def some_texts(n=300):
    rng = random.Random(6)
    syllables = ["the", "tion", "er", "an", "schaft", "que", "ñ", "ß", "eau", "in", "12", ".", "日", "ó", "A", "St"]
    return [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 5))) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_viterbi_matches_the_library():
    pytest.importorskip("google.protobuf")
    import sentencepiece

    data = unigram(open(default_model(), "rb").read())
    library, own = sentencepiece.SentencePieceProcessor(model_proto=data), PieceCodec(data)
    # the library adds scores as 32-bit floats, so only short texts compare, without
    # the pieces whose score is -1e9
    compared = 0
    for text in {" ".join(t.split(" ")[:2]) for t in some_texts()}:
        ids = own.encode(text).tolist()
        if min(map(library.get_score, ids)) > -1e8:
            compared += 1
            assert ids == library.nbest_encode(text, nbest_size=2)[0]
    assert compared > 100


def brute(codec, pieces, unit):
    """Best score by trying every piece at every place."""
    best = [0.0] + [float("-inf")] * len(unit)
    for i in range(len(unit)):
        single = unit[i] in pieces
        if not single:
            best[i + 1] = max(best[i + 1], best[i] + codec.unknown_score)
        for j in range(i + 1, min(len(unit), i + 16) + 1):
            if unit[i:j] in pieces:
                best[j] = max(best[j], best[i] + pieces[unit[i:j]])
    return best[-1]


def test_viterbi_is_best_by_brute_force():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=default_model())
    pieces = {m.id_to_piece(i): m.get_score(i) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i))}
    codec = PieceCodec(default_model())
    for text in some_texts(60) + ["a\nb", "\x00", "x 😀 y"]:
        for word in text.split(" "):
            unit = "▁" + word
            ids = codec.segment(unit)
            unknown = sum(c not in pieces for c in unit)
            score = sum(m.get_score(i) for i in ids if not m.is_byte(i)) + unknown * codec.unknown_score
            assert score == pytest.approx(brute(codec, pieces, unit), rel=1e-12)


@pytest.mark.parametrize("text", ["", " ", "  two  blanks ", "line\nline\ttab", "日本 😀 \x00", "a" * 5000, "▁"])
def test_round_trip(text):
    codec = PieceCodec(default_model())
    assert codec.decode(codec.encode(text).tolist()) == text.replace("▁", " ")


@pytest.mark.parametrize("opening", [0, 16, 200])
def test_pack_chooses_among_capacities(opening):
    """Against the rule taken literally, in square time."""
    rng = np.random.default_rng(6)
    for trial in range(20):
        sizes = np.sort(rng.integers(1, 257, 60))[::-1]
        capacities, bins, want = (64, 128, 256), [], []
        for i, size in enumerate(sizes):
            fits = [(c - sum(own), b) for b, (c, own) in enumerate(bins) if c - sum(own) >= size]
            if fits:
                b = min(fits)[1]
            else:
                cost = lambda c: (c + opening) / (size + min(c - size, sum(x for x in sizes[i + 1 :] if x <= c - size)))
                b = len(bins)
                bins.append((min((c for c in capacities if c >= size), key=cost), []))
            want.append((b, sum(bins[b][1])))
            bins[b][1].append(size)
        bin_of, place, capacity = pack(sizes, capacities, opening)
        assert list(zip(bin_of, place)) == want
        assert capacity.tolist() == [min(c for c in capacities if c >= sum(own)) for _, own in bins]


def test_responses_are_those_of_a_plain_convolution():
    from requisita.llm.language_id import ByteNet

    rng = np.random.default_rng(7)
    net = ByteNet(["a", "b"], seed=3)
    rows = rng.integers(0, 256, (5, 40)).astype(np.uint8)
    want = [[max(sum(taps[j, row[p + j], f] for j in range(len(taps))) for p in range(40 - 4 + 1)) for taps in net.taps for f in range(net.filters)] for row in rows]
    assert np.allclose(net.pooled(rows)[0], want, atol=1e-4) and np.allclose(net.fast()(rows), want, atol=1e-4)


@pytest.mark.parametrize("length", [2, 3, 64])
def test_marginals_are_those_of_all_labellings(length):
    from itertools import product

    from requisita.llm.toxicity import Field

    rng = np.random.default_rng(8)
    field = Field(4)
    field.emission[:] = rng.normal(0, 1, 16)
    field.bias, field.transition = np.float32(-0.3), rng.normal(0, 1, (2, 2))
    sizes = [5, 0, 1, 9, 2, 7]
    first = np.concatenate([[0], np.cumsum(sizes)])
    rows = rng.integers(0, 16, (first[-1], 3)).astype(np.int32)
    score = field.emission[rows].sum(1) + field.bias
    want = []
    for a, b in zip(first[:-1], first[1:]):
        total, on = 0.0, np.zeros(b - a)
        for states in product((0, 1), repeat=b - a):
            w = np.exp(sum(s * x for s, x in zip(states, score[a:b])) + sum(field.transition[x, y] for x, y in zip(states, states[1:])))
            total, on = total + w, on + w * np.array(states)
        want += list(on / total)
    assert np.allclose(field.text_marginals(rows, first, length), want)


def test_pooling_and_word_vectors_by_hand():
    from requisita.llm.quality import _context, index_vectors, pool, tokens, word_vectors

    texts = ["One two, two two 33", "", "x", "y y y y y y y " * 40]
    buf, offsets = flat(texts)
    word, shape, text = tokens(buf, offsets, 256)
    place, sign = index_vectors(256, 8)
    index = np.zeros((256, 8))
    for b in range(256):
        for p, s in zip(place[b], sign[b]):
            index[b, p] += s
    total = np.zeros((256, 8))
    for i in range(len(word)):
        for j in range(max(0, i - 2), min(len(word), i + 3)):
            if j != i and text[i] == text[j]:
                total[word[i]] += index[word[j]]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = next(_context(256, 8, 2)([batch])).to_pandas().set_index("bucket")
    assert np.array_equal(np.array([got.loc[b] if b in got.index else np.zeros(8) for b in range(256)]), total)
    vectors = word_vectors(total)
    assert np.allclose(vectors, total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9) + index / 2)
    for most in (2, 1 << 15):
        pooled = pool(buf, offsets, vectors, most)
        for t in range(len(texts)):
            on = text == t
            means = [vectors[b[on]].sum(0) / max(1, on.sum()) for b in (word, shape)]
            assert np.allclose(pooled[t], [*means[0], *means[1], *(np.linalg.norm(m) for m in means), np.log1p(on.sum()) / 10])


def test_temperature_calibrates():
    from requisita.llm.quality import Network

    # labels that no feature explains: an overconfident network is cooled down
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(300, 40)), (rng.random(300) < 0.5).astype(float)
    net = Network(x, y, np.ones(300))
    loss = lambda p: -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    hot = net.score(x)
    assert net.temperature > 1
    net.temperature = 1.0
    assert abs(net.score(x) - 0.5).mean() > abs(hot - 0.5).mean() and np.isfinite(loss(np.clip(hot, 1e-6, 1 - 1e-6)))
