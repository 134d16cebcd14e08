import math
import random
from collections import Counter, defaultdict

import pytest

from tidemark.llm import langid


def plain(train, texts):
    """Code lengths straight from context trees."""
    trees = defaultdict(lambda: [defaultdict(Counter) for _ in range(4)])
    for text, lang in train:
        data = b"\0\0\0" + text.lower().encode()
        for i in range(3, len(data)):
            for k in range(4):
                trees[lang][k][data[i - k : i]][data[i]] += 1
    out = []
    for t in texts:
        data, sums = b"\0\0\0" + (t or "").lower().encode(), {}
        for lang, tree in trees.items():
            total = 0.0
            for i in range(3, len(data)):
                for k in (3, 2, 1, 0, -1):
                    if k < 0:
                        total += 8
                        break
                    seen = tree[k].get(data[i - k : i])
                    if not seen:
                        continue
                    n, d = sum(seen.values()), len(seen)
                    if data[i] in seen:
                        total += math.log2((n + d) / seen[data[i]])
                        break
                    total += math.log2((n + d) / d)
            sums[lang] = total
        out.append(sums)
    return out


TRAIN = [("The cat and the dog", "en"), ("that is what they think", "en"), ("Der Hund und die Katze", "de"), ("das ist schön über", "de"), ("", "fr"), ("le chat et été", "fr")]
TEXTS = ["the thing", "und das", "été", None, "", "123 !?", "ЯЯЯ", "x" * 300, "thé " * 400, "a", "\0\0\0a", "cat" * 3]


@pytest.mark.parametrize("rows", [10**6, 0])
def test_code_lengths_and_shares(spark, monkeypatch, rows):
    monkeypatch.setattr(langid, "SLICE", 100)
    train = spark.createDataFrame(TRAIN, "text string, lang string")
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, key string")
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(train), rows=rows).collect()}
    for i, (t, sums) in enumerate(zip(TEXTS, plain(TRAIN, TEXTS))):
        if not any(map(str.isalpha, t or "")):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        best = min(sums, key=lambda k: (sums[k], k))
        assert got[i].lang_pred == best
        assert got[i].score == pytest.approx(1 / sum(2 ** (sums[best] - v) for v in sums.values()))


def test_held_out_rows_are_not_learned_from(spark):
    import zlib

    rng = random.Random(1)
    words = {"en": ["the", "and", "of", "this"], "de": ["der", "und", "nicht", "über"]}
    rows = [(i, " ".join(rng.choices(words[k], k=12)), k) for i in range(60) for k in [rng.choice(["en", "de"])]]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = [(i, t, "xx" if held(i) else k) for i, t, k in rows] + [(None, "the and", "yy"), (1000, None, None)]
    got = langid.held_out(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
    assert {r.lang_pred for r in got} == {"en", "de", "und"}
    truth = {i: "en" if "the" in t or "and" in t or "of" in t or "this" in t else "de" for i, t, _ in rows[:60]}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 60)


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.held_out(none).collect() == []
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.held_out(one).collect()] == ["und"]
