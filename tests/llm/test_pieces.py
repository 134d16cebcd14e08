import random

import pytest

from tidemark.llm import pieces

public = pytest.importorskip("public_tokenizers")
PATH = public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    """The library's own search over the same scores: the model read as a unigram model."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def texts(n=300):
    rng = random.Random(4)
    words = ["the", "of", "Rest", "Thinking", "über", "été", "résumé", "x1y2", "漢字", "don't", "###", "hello,", "🙂", "a", "ЯЗЫК", "\n", "\t", "24be64439e3e", "ñandú"]
    return ["", "a", " a", "a ", "▁", "\x00", "é"] + [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(n)] + [" ".join(rng.choices(words[:8], k=6)) for _ in range(n)]


def test_same_ids_as_the_library(vocabulary, library):
    n = 0
    for t in texts()[1:]:
        best = library.nbest_encode(t, nbest_size=2)[0]  # its lattice search
        if vocabulary.byte_of.keys().isdisjoint(best) and sum(library.get_score(i) for i in best) > -(2**24):
            assert pieces.encode(vocabulary, t).tolist() == best, t  # else 32-bit sums there round scores away
            n += 1
        assert pieces.decode(vocabulary, library.encode(t)) == t.replace("▁", " ")
    assert n > 200


def brute(vocabulary, text):
    """Best cut over all boundaries, without a window."""
    best = {0: (0.0, [])}
    for end in range(1, len(text) + 1):
        options = []
        for begin in range(max(0, end - vocabulary.max_len), end):
            node = vocabulary.trie
            for c in text[begin:end]:
                node = node.get(c, {})
            if None in node:
                options.append((best[begin][0] + node[None][0], -begin, best[begin][1] + [node[None][1]]))
        if not any(-b == end - 1 for _, b, _ in options):
            options.append((best[end - 1][0] + vocabulary.penalty, -(end - 1), best[end - 1][1] + vocabulary.fallback(text[end - 1])))
        best[end] = max(options, key=lambda o: o[:2])[0::2]
    return best[len(text)][1]


def test_stream_against_all_boundaries(vocabulary):
    rng = random.Random(2)
    for _ in range(40):
        t = "".join(rng.choices("abeinrst漢🙂1", k=rng.randint(0, 400)))
        runs = list(pieces.viterbi(vocabulary, iter(t)))
        assert [i for r in runs for i in r] == brute(vocabulary, t)
    long = "".join(rng.choices("abeinrst", k=20_000))
    sizes = [len(r) for r in pieces.viterbi(vocabulary, iter(long))]
    assert len(sizes) > 300 and max(sizes) < 200  # handed out as it goes


def test_words_do_not_change_the_result(vocabulary):
    assert vocabulary.cut_at_blanks
    for t in texts(40):
        whole = [i for r in pieces.viterbi(vocabulary, (" " + t).replace(" ", pieces.BLANK)) for i in r] if t else []
        assert pieces.encode(vocabulary, t).tolist() == whole


def test_frames(spark):
    rows = [(i, t, "x") for i, t in enumerate([None, *texts(20), "w" * 5000, "ab " * 2000])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_ids string")
    back = pieces.decoded(pieces.encoded(df, PATH), PATH, to="again").collect()
    assert all(r.again == (r.text or "").replace("▁", " ") for r in back)
    facts = pieces.checked(df.drop("n_ids"), PATH).collect()
    assert all(r.round_trip == ("▁" not in (r.text or "")) and r.n_ids == len(b.ids) for r, b in zip(sorted(facts, key=lambda r: r.doc_id), sorted(back, key=lambda r: r.doc_id)))
    assert pieces.checked(df.drop("n_ids").limit(0), PATH).collect() == []


def test_columns_named_like_the_new_ones_are_replaced(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id long, text string, n_ids string")
    got = pieces.checked(df, PATH)
    assert got.columns == ["doc_id", "text", "n_ids", "ids_crc32", "round_trip"]
    assert {r.doc_id: r.n_ids for r in got.collect()} == {r.doc_id: r.n_ids for r in pieces.checked(df.drop("n_ids"), PATH).collect()}
