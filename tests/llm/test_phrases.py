import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard

from tidemark.llm import phrases


def pieces(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def counts(rows, longest):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for ws in pieces(text):
            n["und" if lang is None else lang] += len(ws)
            for m in range(1, longest + 1):
                for i in range(len(ws) - m + 1):
                    f["und" if lang is None else lang, tuple(ws[i : i + m])] += 1
    return f, n


def plain(rows, least, longest, best):
    f, n = counts(rows, longest)
    often = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = []
    for (lang, ws), a in often.items():
        if any(o == lang and len(v) > len(ws) and b >= a and any(v[i : i + len(ws)] == ws for i in range(len(v))) for (o, v), b in often.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
        out.append((lang, " ".join(ws), a, l, r, n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(own[:best])]
    return sorted(ranked)


def corpus(seed=11, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "of", "ÄB", "äb", "x\x00y", "new", "york", "a" * 70, "é", "\x85", "q q", "-"]
    stock = ["new york times", "of the", "a b c d e f", "NEW york", "é é é é é é"]
    rows = [(None, None), ("en", ""), (None, " \t . , "), ("", "new york"), ("en", "w" * 3000 + " " + "v" * 3000)]
    for _ in range(n):
        some = [rng.choice(stock if rng.random() < 0.4 else words) for _ in range(rng.randint(1, 60))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", "\t ", ", ", ".", " ;", "\n", "\r\n", " \x0b "]) for w in some)
        rows.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), text))
    return rows + rows[:40]


def collect(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_plain_counts(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, phrase string")
    for least, longest, best, block in ((3, 5, 2000, 1 << 22), (20, 3, 4, 700), (5, 5, 9, 64)):
        monkeypatch.setattr(phrases, "BLOCK", block)
        monkeypatch.setattr(phrases, "PART", block * 4)
        assert collect(phrases.collocations(df, least, longest, best)) == plain(rows, least, longest, best)


def test_frequent_table(spark):
    rows = corpus(4, 60)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    table, totals = phrases.frequent(df, 4)
    want_f, want_n = counts(rows, 5)
    want = sorted((lang, " ".join(ws), a) for (lang, ws), a in want_f.items() if a >= 4)
    assert collect(table) == want
    assert dict(totals.collect()) == {k: v for k, v in want_n.items() if v}


def test_block_with_five_fingerprints_for_everything(monkeypatch):
    class Weak(phrases.Grams):
        def fingerprints(self, first, n, base=phrases.BASES[0]):
            x = super().fingerprints(first, n, base)
            return x % np.uint64(5) if base == phrases.BASES[0] else x

    monkeypatch.setattr(phrases, "Grams", Weak)
    rows = [("en", t) for lang, t in corpus(4, 60) if lang == "en"]
    body = phrases.normal(b"\n".join(t.encode() for _, t in rows))
    left = pa.table({"blk": [1], "lang": ["en"], "body": [zstandard.compress(body.tobytes())], "own": [len(body)]})
    found = Weak(left["body"][0].as_py(), len(body), "en").keys(2)[0]
    parts, sizes = np.unique(found >> np.uint64(32), return_counts=True)
    right = pa.table({"part": parts.astype(np.int64), "bits": [np.packbits(np.ones(n, bool)).tobytes() for n in sizes]})
    got = Counter()
    out = phrases._pointed(2, 5)(left, right)
    entries = np.concatenate([phrases.unpack(x, phrases.ENTRY) for x in out["entries"].to_pylist()])
    assert len(set(entries["fp"].tolist())) <= 5 and len({(e["fp"], e["other"]) for e in entries}) == len(entries)
    often = phrases._often(1)(out)
    at = [p & ((1 << phrases.AT) - 1) for p in often["one"].to_pylist()]
    assert often["one"].equals(often["two"])
    for r in phrases._read(left, often.append_column("at", pa.array(at))).to_pylist():
        got[r["lang"], r["phrase"]] += r["f"]
    assert got == {(lang, " ".join(ws)): a for (lang, ws), a in counts(rows, 5)[0].items()}


def test_only_runs_of_frequent_triples_are_pointed_at():
    # All pairs are frequent, but of the triples only "a b c" and "b c d".
    pairs = [(x, y) for x in "abcd" for y in "abcd" if x != y]
    text = "a b c d\n" * 6 + "".join(f"{x} {y}\n" * 6 for x, y in pairs) + "d c b a d\nc a d b\n"
    blocks = [phrases.normal(t.encode()) for t in (text, "c b d a c\nx a b c d\n")]
    rows = pa.RecordBatch.from_pydict({
        "blk": [0, 1], "lang": ["en", "en"], "body": [zstandard.compress(b.tobytes()) for b in blocks], "own": [len(b) for b in blocks], "n_words": [0, 0]
    })
    hashes = pa.Table.from_batches(phrases._hashes(1, 5, 5)([rows]))
    bits = phrases._frequent(5)(hashes)
    got = set()
    for i, block in enumerate(blocks):
        out = phrases._pointed(1, 5)(pa.table(rows.slice(i, 1).to_pydict()), bits.filter(pa.compute.equal(bits["blk"], i)))
        for e in phrases.unpack(out["entries"][0].as_py(), phrases.ENTRY):
            got.add(block[e["at"] : e["at"] + e["size"]].tobytes().decode())
    assert {g for g in got if len(g.split()) > 2} == {"a b c", "b c d", "a b c d"}
    assert {g for g in got if len(g.split()) == 2} == {f"{x} {y}" for x, y in pairs}
    # A hash that is sent takes under two and a half bytes.
    some = phrases.normal(" ".join(str(i) for i in np.random.default_rng(1).integers(0, 10**6, 60_000)).encode())
    asked = pa.RecordBatch.from_pydict({"blk": [0], "lang": ["en"], "body": [zstandard.compress(some.tobytes())], "own": [len(some)], "n_words": [0]})
    sent = pa.Table.from_batches(phrases._hashes(4, 5, 5)([asked]))
    assert sum(map(len, sent["entries"].to_pylist())) < 2.5 * sum(len(phrases.unpack(x, phrases.COUNT)) for x in sent["entries"].to_pylist())


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).collect() == []


def test_packed_entries_come_back():
    rng = np.random.default_rng(2)
    for kind in (phrases.COUNT, phrases.ENTRY):
        for n in (0, 1, 2, 500):
            e = np.frombuffer(rng.bytes(n * kind.itemsize), kind).copy()
            e.sort(order="fp")
            assert (phrases.unpack(phrases.pack(e), kind) == e).all()


def test_folded_fingerprints_come_back_in_order():
    fp = np.sort(np.random.default_rng(3).integers(0, 1 << 64, 5000, np.uint64, endpoint=False))
    fp[:2] = 0, 1
    fp[-1] = 0xFFFFFFFFFFFFFFFF
    for parts in (1, 2, 31, 1800):
        part = (fp >> np.uint64(32)) % np.uint64(parts)
        for p in np.unique(part)[:40].tolist():
            mine = fp[part == p]
            short = phrases.folded(mine, parts)
            assert (np.diff(short.astype(object)) >= 0).all() and short.max() <= mine.max()
            assert (phrases.unfolded(short, p, parts) == mine).all()
