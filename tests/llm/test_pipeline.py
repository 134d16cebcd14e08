import random
import zlib

import numpy as np
import pytest

import corpus_pipeline as pipeline
from tests.llm import test_line_dedup, test_packing, test_quality, test_simhash, test_suffix
from tidemark.llm import quality

pytest.importorskip("public_tokenizers")


def documents():
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, passage = [prose(12) for _ in range(4)], prose(60)
    texts = []
    for i in range(80):
        t = [prose(rng.randint(5, 20)) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            t[1:1] = shared[: rng.randint(2, 4)]
        if i % 7 == 0:
            t.append(prose(3) + " " + passage + " " + prose(4))
        texts.append("\n".join(t))
    texts += texts[10:20] + [texts[3] + " more", None, "", "few words", "w " * 50, prose(3000)]
    texts += [" ".join("V!!" if j % 2 else f"U{j % 7}??" for j in range(60)) + f" {i}" for i in range(60)]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def test_stages_against_brute_force(spark, tmp_path, monkeypatch):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = documents()
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in pipeline.STAGES:
        out = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        seen.append({r.doc_id: r for r in docs.collect()} if name != pipeline.STAGES[-1][0] else docs.collect())
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    ruled, lined, single, cut, packed = seen
    failed = {i for i, t, *_ in rows if test_quality.base(t)[-1]}
    judged = {r.doc_id for r in quality.judged(spark.createDataFrame(rows, schema), spark.createDataFrame([(i,) for i in range(80)], "doc_id long")).filter("kept").collect()}
    assert set(ruled) == judged and not failed & judged and len(set(range(80)) - failed - judged) < 8 and not judged & set(range(96, 156))
    want = test_line_dedup.plain([(i, ruled[i].text) for i in sorted(ruled)])
    assert {i: r.text for i, r in lined.items()} == {i: w[0] for i, w in zip(sorted(ruled), want)}
    classes = test_simhash.classes([(i, test_simhash.plain(lined[i].text)) for i in sorted(lined)])
    assert set(single) == set(classes.values()) and all(single[i].text == lined[i].text for i in single)
    ids = sorted(single)
    want = test_suffix.removed([single[i].text for i in ids], pipeline.REPEAT_BYTES)
    assert [len(single[i].text) - len(cut[i].text) for i in ids] == [w[1] for w in want] and sum(w[1] for w in want) > 500
    pieces = {(r.doc_id, r.piece): r for r in packed}
    for i in ids:
        tokens = test_packing.ids_of(cut[i].text)
        for n, at in enumerate(range(0, len(tokens), 2048)):
            assert pieces[i, n].ids_crc32 == zlib.crc32(np.array(tokens[at : at + 2048], "<u4").tobytes())
    assert len(packed) == len(pieces) and {i for i, _ in pieces} == set(ids)
    test_packing.check(packed, 2048)
    monkeypatch.setattr(pipeline, "STAGES", pipeline.STAGES[:2])  # run() chains the stages
    assert {r.doc_id: r.text for r in pipeline.run(spark, str(tmp_path)).collect()} == {i: r.text for i, r in lined.items()}
