"""The pipeline against a brute-force version of its stages."""

from collections import Counter

import corpus_pipeline
from requisita.llm._shared import Workspace

from .test_operators import WORD, awkward, brute_components, covered, passage


def test_pipeline(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(r[0], r[1], r[2], "s", len(r[1] or "")) for r in awkward() if r[0] is not None and r[0] != 15]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    # nothing to learn from: the first stage keeps all
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    work = Workspace(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = work.keep(stage(spark, docs, str(tmp_path)), name)
        kept.append(docs)
    assert all(k.columns == schema.replace(",", "").split()[::2] for k in kept[:-1])

    texts = {r[0]: r[1] or "" for r in rows}
    assert {r.doc_id for r in kept[0].collect()} == set(texts)
    last = {t: max(d for d in texts if texts[d] == t) for t in texts.values()}
    texts = {d: t for d, t in texts.items() if last[t] == d}
    assert {r.doc_id for r in kept[1].collect()} == set(texts)
    top = brute_components(list(texts.items()))
    texts = {d: t for d, t in texts.items() if top[d] == d}
    assert {r.doc_id for r in kept[2].collect()} == set(texts)
    words = {d: WORD.findall(t) for d, t in texts.items()}
    left = {d: [w for w, g in zip(words[d], gone) if not g] for d, gone in zip(words, covered(list(words.values()), 35))}
    found = {r.doc_id: r for r in kept[3].collect()}
    assert {d: WORD.findall(r.text or "") for d, r in found.items()} == left
    assert all(found[d].text == texts[d] for d in left if left[d] == words[d]) and all(r.n_chars == len(r.text) for r in found.values())
    packed = kept[4].collect()
    assert {r.doc_id for r in packed} == set(left) and sum(r.length for r in packed) == sum(map(len, left.values()))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def check_stages(spark, folder, rows):
    """Rows of (doc_id, text): stages 2 to 5 against brute force, row by row."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(d, t, f"l{i}", "s", len(t or "")) for i, (d, t) in enumerate(rows)], schema)
    work, kept = Workspace(spark), []
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = work.keep(stage(spark, docs, str(folder)), name)
        kept.append(docs.collect())
    ids = {}
    for d, t in rows:
        ids.setdefault(t or "", []).append(d)
    left = sorted(((max((d for d in of if d is not None), default=None), t) for t, of in ids.items()), key=lambda r: (r[0] is None, r))
    assert Counter((r.doc_id, r.text or "") for r in kept[0]) == Counter(left)
    top = brute_components([(i, t) for i, (d, t) in enumerate(left) if d is not None])
    left = [r for i, r in enumerate(left) if r[0] is None or top[i] == i]
    assert Counter((r.doc_id, r.text or "") for r in kept[1]) == Counter(left)
    words = [WORD.findall(t) for _, t in left]
    want = [(d, tuple(w for w, g in zip(ws, gone) if not g)) for (d, _), ws, gone in zip(left, words, covered(words, 35))]
    assert Counter((r.doc_id, tuple(WORD.findall(r.text or ""))) for r in kept[2]) == Counter(want)
    length = Counter()
    for r in kept[3]:
        length[r.doc_id] += r.length
    assert length == Counter({d: sum(len(w) for e, w in want if e == d) for d, _ in want})
    return want


def test_rows_that_share_an_id(spark, tmp_path):
    near = passage(31, 120)
    rows = [(r[0], r[1]) for r in awkward() if r[0] is not None]
    # 20 has two texts of its own, 21 one of its own and one that 22 has too, 23 a text near to one of 20
    rows += [(20, near), (20, passage(32, 50)), (21, passage(33, 50)), (21, passage(34, 50)), (22, passage(34, 50)), (23, near + " more"), (23, passage(35, 40))]
    want = Counter(d for d, w in check_stages(spark, tmp_path, rows) if len(w) > 35)
    assert (want[15], want[20], want[21], want[22], want[23]) == (1, 2, 1, 1, 1)


def test_rows_without_an_id(spark, tmp_path):
    # the same passage in two of them and in 30; one text twice, one that 30 has too
    shared = passage(41, 50)
    rows = [(r[0], r[1]) for r in awkward()] + [(30, shared + " " + passage(42, 40)), (30, passage(47, 40))]
    rows += [(None, passage(43, 40) + " " + shared), (None, shared + "\n" + passage(44, 45)), (None, passage(45, 70)), (None, passage(45, 70)), (None, passage(47, 40))]
    want = Counter((d, len(w)) for d, w in check_stages(spark, tmp_path, rows))
    assert [want[None, n] for n in (40, 45, 60, 70)] == [1, 1, 1, 1] and want[30, 40] == 2
