"""Phrases of two to five words that stand together more often than their parts would, by Rabin-Karp fingerprints.

Texts become blocks of bytes in which one blank parts words and one line end parts pieces. A prefix polynomial over the bytes of
a block (mod 2^64) gives the fingerprint of every run of words by one subtraction and one product with an inverse power, all in numpy.

1. Each block hands out its words, pairs and triples as 24-bit hashes with counts (up to the least count asked for, which is
   all that a sum needs). They meet by shuffle in parts whose number follows the text, and every block gets back one bit for
   each hash: frequent or not. A hash that two share can only let too much through.
2. A longer phrase can be frequent only if all its triples are. Those that pass go out as fingerprints with their count in the block
   and a pointer to one occurrence. In the block all occurrences of a fingerprint are compared byte by byte, and those that
   differ go out apart, with a fingerprint from another base that comes along: 96 bits tell phrases apart between blocks.
3. Of those that reach the least count two occurrences from different blocks are read at their pointers and compared;
   no other phrase is ever materialised.

Scores come from the table of frequent phrases alone, as every part of a frequent phrase is frequent.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

BLOCK = 2 << 20  # bytes of text in a block, about
PART = 16 << 20  # bytes of text whose hashes meet in one part, about
BREAKS = b".,;:!?\n\x0b\x0c\r"
LOWER = bytes.maketrans(bytes(range(65, 91)) + b"\t" + BREAKS, bytes(range(97, 123)) + b" " + b"\n" * len(BREAKS))
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, so that they have inverses mod 2^64
AT = 24  # bits of a place in a block
HASH = 24  # bits of a hash inside its part, whose text has far fewer words
JUDGED = 3  # phrases of up to so many words are judged by hash before any pointer is written
BLOCKS = "blk long, lang string, body binary, own long, n_words long"
POINTERS = "part long, blk long, entries binary"
COUNT = np.dtype([("fp", "<u4"), ("n", "<u4")])  # a word, pair or triple of a block
ENTRY = np.dtype([("fp", "<u8"), ("other", "<u4"), ("n", "<u4"), ("at", "<u4"), ("size", "<u4")])  # a phrase of a block


def normal(raw: bytes) -> np.ndarray:
    """Lower-case bytes of a text; each run of separators is one blank, or one line end if it has a break."""
    a = np.frombuffer(raw.translate(LOWER), np.uint8)
    gap = (a == 32) | (a == 10)
    first = gap.copy()
    first[1:] &= ~gap[:-1]
    run = np.cumsum(first, dtype=np.int32)
    broken = np.zeros(int(run[-1]) + 1 if len(a) else 1, bool)
    broken[run[a == 10]] = True
    out = a.copy()
    out[first] = np.where(broken[run[first]], 10, 32)
    return out[~gap | first]


def cut(a: np.ndarray, longest: int):
    """(bytes, own, words): blocks of about BLOCK bytes that end between words. Phrases that begin in the first ``own`` bytes
    are a block's; the ``longest - 1`` words behind those only complete them."""
    gaps = np.flatnonzero((a == 32) | (a == 10))
    starts = np.flatnonzero(_starts(a))
    at = 0
    while at < len(a):
        g = max(np.searchsorted(gaps, at + BLOCK, "right") - 1, np.searchsorted(gaps, at, "right"))
        if len(a) - at <= BLOCK * 3 // 2 or g >= len(gaps):
            end = stop = len(a)
        else:
            end = int(gaps[g])
            stop = int(gaps[g + longest - 1]) if g + longest - 1 < len(gaps) else len(a)
        yield a[at:stop], end - at, int(np.searchsorted(starts, end) - np.searchsorted(starts, at))
        at = end


def _starts(a: np.ndarray) -> np.ndarray:
    word = (a != 32) & (a != 10)
    first = word.copy()
    first[1:] &= ~word[:-1]
    return first


def _blocks(longest: int):
    def pack(batches):
        task, done = TaskContext.get().partitionId(), 0
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def flush(lang):
            nonlocal done
            a = normal(b"\n".join(held.pop(lang)))
            del sizes[lang]
            for body, own, words in cut(a, longest):
                if words:
                    yield pa.RecordBatch.from_pydict({
                        "blk": pa.array([(task << 19) + done], pa.int64()), "lang": pa.array([lang]), "body": pa.array([zstandard.compress(body.tobytes(), 9)], pa.binary()),
                        "own": pa.array([own], pa.int64()), "n_words": pa.array([words], pa.int64()),
                    })
                    done += 1

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, text in zip(batch.column("lang").to_pylist(), texts):
                raw = text.as_py()
                if not raw:
                    continue
                held.setdefault(lang, []).append(raw)
                sizes[lang] = sizes.get(lang, 0) + len(raw)
                if sizes[lang] >= BLOCK:
                    yield from flush(lang)
                elif len(sizes) > 8 and sum(sizes.values()) >= 4 * BLOCK:  # many languages in one task
                    yield from flush(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from flush(lang)

    return pack


class Grams:
    """Words of a block and the fingerprints of its phrases."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, body: bytes, own: int, lang: str):
        self.bytes = a = np.frombuffer(zstandard.decompress(body), np.uint8)
        word = (a != 32) & (a != 10)
        self.start = np.flatnonzero(_starts(a))
        last = word.copy()
        last[:-1] &= ~word[1:]
        self.end = np.flatnonzero(last) + 1
        # Is the next word in the same piece?
        self.joined = np.append(a[self.end[:-1]] == 32, False)
        self.own = self.start < own
        self.seed = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
        self._sums: dict[int, np.ndarray] = {}

    @classmethod
    def powers(cls, base: int, n: int):
        """Powers of a base and of its inverse, at least up to ``n``."""
        if base not in cls._powers or len(cls._powers[base][0]) <= n:
            cls._powers[base] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
        return cls._powers[base]

    def chains(self, n: int, good: np.ndarray | None = None, m: int = 1) -> np.ndarray:
        """First words of all runs of ``n`` words in a piece; with ``good``, all of whose runs of ``m`` words are good."""
        w = len(self.start)
        if n > w:
            return np.zeros(0, np.int64)
        ok = np.ones(w - n + 1, bool)
        for k in range(n - 1):
            ok &= self.joined[k : w - n + 1 + k]
        if good is not None:
            for k in range(n - m + 1):
                ok &= good[k : w - n + 1 + k]
        return np.flatnonzero(ok)

    def fingerprints(self, first: np.ndarray, n: int, base: int = BASES[0]) -> np.ndarray:
        powers, inverse = self.powers(base, len(self.bytes))
        if base not in self._sums:
            terms = (self.bytes.astype(np.uint64) + np.uint64(1)) * powers[: len(self.bytes)]
            self._sums[base] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        s, e = self.start[first], self.end[first + n - 1]
        x = (self._sums[base][e] - self._sums[base][s]) * inverse[s] ^ self.seed
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):  # spreads all bits
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x

    def keys(self, parts: int, judged: int = JUDGED):
        """(part and hash in one number, in order; for each run of 1, 2 ... ``judged`` words: its place among them; own or not; first words by length)."""
        runs = [self.chains(n) for n in range(1, judged + 1)]
        x = np.concatenate([self.fingerprints(first, n) for n, first in enumerate(runs, 1)])
        x = ((x >> np.uint64(32)) % np.uint64(parts) << np.uint64(32)) | (x & np.uint64((1 << HASH) - 1))
        found, place = np.unique(x, return_inverse=True)
        return found, place, self.own[np.concatenate(runs)], runs

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Do the bytes from a and from b agree over ``size`` bytes? Eight at a time."""
        padded = np.concatenate([self.bytes, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.bytes) + 1,), "<u8", padded, strides=(1,))
        out, live, at = np.ones(len(a), bool), np.arange(len(a)), 0
        while len(live):
            left = np.minimum(size[live] - at, 8)
            mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left.astype(np.uint64) * np.uint64(8))
            out[live] = ((eight[a[live] + at] ^ eight[b[live] + at]) & mask) == 0
            at += 8
            live = live[out[live] & (size[live] > at)]
        return out


def pack(entries: np.ndarray) -> bytes:
    """Records in order of ``fp`` as steps of it and then the other fields, each byte position apart, compressed."""
    entries = entries.copy()
    entries["fp"][1:] -= entries["fp"][:-1].copy()
    planes = [np.ascontiguousarray(entries[c]).view(np.uint8).reshape(len(entries), entries.dtype[c].itemsize).T for c in entries.dtype.names]
    return zstandard.compress(b"".join(x.tobytes() for x in planes), 3)


def unpack(data: bytes, kind: np.dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    out = np.empty(len(raw) // kind.itemsize, kind)
    at = 0
    for c in kind.names:
        width = kind[c].itemsize * len(out)
        out[c] = np.ascontiguousarray(raw[at : at + width].reshape(kind[c].itemsize, len(out)).T).view(kind[c]).reshape(-1)
        at += width
    out["fp"] = np.cumsum(out["fp"], dtype=kind["fp"])
    return out


def folded(fp: np.ndarray, parts: int) -> np.ndarray:
    """Fingerprints of one part without what the part says of them (the remainder of their upper half), in the same order."""
    return (fp >> np.uint64(32)) // np.uint64(parts) << np.uint64(32) | fp & np.uint64(0xFFFFFFFF)


def unfolded(fp: np.ndarray, part: int, parts: int) -> np.ndarray:
    return (fp >> np.uint64(32)) * np.uint64(parts) + np.uint64(part) << np.uint64(32) | fp & np.uint64(0xFFFFFFFF)


def _hashes(parts: int, least: int, longest: int):
    def count(batches):
        for batch in batches:
            for blk, lang, body, own, _ in zip(*(batch.column(c).to_pylist() for c in range(5))):
                found, place, mine, _ = Grams(body, own, lang).keys(parts, min(longest, JUDGED))
                n = np.minimum(np.bincount(place[mine], minlength=len(found)), least).astype(np.uint32)
                part = (found >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(part)) + 1
                edges = [0, *cuts.tolist(), len(part)]
                entries = np.zeros(len(found), COUNT)
                entries["fp"], entries["n"] = found.astype(np.uint32), n
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(part[edges[:-1]], pa.int64()), "blk": pa.array([blk] * (len(edges) - 1), pa.int64()),
                    "entries": pa.array([pack(entries[i:j]) for i, j in zip(edges, edges[1:])], pa.binary()),
                })

    return count


def _frequent(least: int):
    def judge(t: pa.Table) -> pa.Table:
        rows = [unpack(x.as_py(), COUNT) for x in t["entries"]]
        every = np.concatenate(rows)
        often = (np.bincount(every["fp"], weights=every["n"], minlength=1) >= least)[every["fp"]]
        edges = np.cumsum([len(r) for r in rows])[:-1]
        return pa.table({"blk": t["blk"], "part": t["part"], "bits": pa.array([np.packbits(x).tobytes() for x in np.split(often, edges)], pa.binary())})

    return judge


def _pointed(parts: int, longest: int):
    def point(left: pa.Table, right: pa.Table) -> pa.Table:
        blk, lang, body, own = (left[c][0].as_py() for c in ("blk", "lang", "body", "own"))
        g = Grams(body, own, lang)
        found, place, _, runs = g.keys(parts, min(longest, JUDGED))
        right = right.sort_by("part")
        sizes = np.unique(found >> np.uint64(32), return_counts=True)[1]
        often = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n) for x, n in zip(right["bits"], sizes.tolist())]).astype(bool)[place]
        goods = []  # by length: is the run that begins with this word good?
        for first, bits in zip(runs, np.split(often, np.cumsum([len(x) for x in runs])[:-1])):
            good = np.zeros(len(g.start), bool)
            good[first] = bits
            if goods:
                good[:-1] &= goods[-1][:-1] & goods[-1][1:]
            goods.append(good)
        out = []
        for n in range(1, longest + 1):
            m = min(n, len(goods))
            first = g.chains(n, goods[m - 1], m)
            first = first[g.own[first]]
            fp = g.fingerprints(first, n)
            s, size = g.start[first], g.end[first + n - 1] - g.start[first]
            _, one, place, count = np.unique(fp, return_index=True, return_inverse=True, return_counts=True)
            again = np.flatnonzero(one[place] != np.arange(len(fp)))  # occurrences to be held against the first one
            rep = one[place[again]]
            differ = again[(size[again] != size[rep]) | ~g.same(s[again], s[rep], np.minimum(size[again], size[rep]))]
            np.subtract.at(count, place[differ], 1)
            others: dict[tuple[int, bytes], list[int]] = {}
            for i in differ.tolist():
                others.setdefault((int(fp[i]), g.bytes[s[i] : s[i] + size[i]].tobytes()), []).append(i)
            extra = np.array([x[0] for x in others.values()], np.int64)  # one occurrence of each
            at = np.concatenate([one, extra])
            entries = np.zeros(len(at), ENTRY)
            entries["fp"], entries["other"], entries["at"], entries["size"] = fp[at], g.fingerprints(first[at], n, BASES[1]) >> np.uint64(32), s[at], size[at]
            entries["n"] = np.concatenate([count, np.array([len(x) for x in others.values()], np.int64)])
            out.append(entries)
        entries = np.concatenate(out)
        part = (entries["fp"] >> np.uint64(32)) % np.uint64(parts)
        order = np.lexsort((entries["fp"], part))
        entries["fp"] = folded(entries["fp"], parts)
        found, starts = np.unique(part[order], return_index=True)
        rows = [pack(entries[x]) for x in np.split(order, starts[1:])] if len(found) else []
        return pa.table({"part": found.astype(np.int64), "blk": np.full(len(found), blk, np.int64), "entries": pa.array(rows, pa.binary())})

    return point


def _often(least: int, parts: int = 1):
    def judge(t: pa.Table) -> pa.Table:
        """Phrases of one part that reach the least count, with two occurrences from anywhere (by hash, so that no block is asked for all)."""
        rows = [unpack(x.as_py(), ENTRY) for x in t["entries"]]
        e = np.concatenate(rows)
        e["fp"] = unfolded(e["fp"], t["part"][0].as_py(), parts)
        pointer = (np.repeat(t["blk"].to_numpy(), [len(r) for r in rows]) << AT) + e["at"]
        anywhere = (pointer.astype(np.uint64) ^ e["fp"]) * np.uint64(BASES[0]) >> np.uint64(20)
        order = np.lexsort((anywhere, e["other"], e["fp"]))
        e, pointer = e[order], pointer[order]
        new = np.ones(len(e), bool)
        new[1:] = (e["fp"][1:] != e["fp"][:-1]) | (e["other"][1:] != e["other"][:-1])
        at = np.flatnonzero(new)
        f = np.add.reduceat(e["n"].astype(np.int64), at)
        end = np.append(at[1:], len(e)) - 1
        ok = f >= least
        return pa.table({
            "fp": e["fp"][at][ok].view(np.int64), "other": e["other"][at][ok].astype(np.int64), "f": f[ok],
            "one": pointer[at][ok], "two": pointer[end][ok], "size": e["size"][at][ok].astype(np.int32),
        })

    return judge


def _read(left: pa.Table, right: pa.Table) -> pa.Table:
    text = zstandard.decompress(left["body"][0].as_py()) if len(right) else b""
    at, size = right["at"].to_pylist(), right["size"].to_pylist()
    return pa.table({
        "lang": pa.array([left["lang"][0].as_py()] * len(at), pa.string()),
        "phrase": pa.array([text[i : i + k] for i, k in zip(at, size)], pa.binary()).cast(pa.string()),
        "fp": right["fp"], "other": right["other"], "f": right["f"],
    })


def frequent(docs: DataFrame, least: int = 100, longest: int = 5, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Tables (lang, phrase, f): all phrases of up to ``longest`` words that occur ``least`` times, with exact counts, and
    (lang, n): all words of a language.

    Null texts are empty and null languages ``und``. Texts are read whole and repeated rows count again; a word longer than a block
    stays in one piece (up to 16 MB). Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    blocks = materialize(rows.mapInArrow(_blocks(longest), BLOCKS), "blocks")
    totals = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    words = blocks.agg(F.sum("n_words")).first()[0] or 0  # one number
    parts = 1 + words * 6 // PART
    hashes = blocks.mapInArrow(_hashes(parts, least, longest), POINTERS)
    bits = hashes.groupBy("part").applyInArrow(_frequent(least), "blk long, part long, bits binary")
    pointers = blocks.groupBy("blk").cogroup(bits.groupBy("blk")).applyInArrow(_pointed(parts, longest), POINTERS)
    often = materialize(pointers.groupBy("part").applyInArrow(_often(least, parts), "fp long, other long, f long, one long, two long, size int"), "often")
    ends = often.select("fp", "other", "f", "size", F.explode(F.array_distinct(F.array("one", "two"))).alias("p"))
    ends = ends.select("fp", "other", "f", "size", F.shiftright("p", AT).alias("blk"), F.col("p").bitwiseAND((1 << AT) - 1).cast("int").alias("at"))
    read = blocks.groupBy("blk").cogroup(ends.groupBy("blk")).applyInArrow(_read, "lang string, phrase string, fp long, other long, f long")
    same = read.groupBy("fp", "other", "f").agg(F.min(F.struct("lang", "phrase")).alias("a"), F.max(F.struct("lang", "phrase")).alias("z"))
    checked = F.when(F.col("a") == F.col("z"), F.col("a")).otherwise(F.raise_error(F.lit("two phrases share both fingerprints")))
    return materialize(same.select(checked.alias("a"), "f").select("a.*", "f"), "phrases"), totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, best: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``best`` phrases of each language.

    Score is ``floor(1000 a n / (l r))`` of the cut that makes it least (of equal ones the first), in whole numbers of up to 38
    digits. A phrase inside a longer frequent one that occurs as often is left out. Order: score and a falling, phrase
    in byte order. See ``frequent`` for nulls.
    """
    table, totals = frequent(docs, least, longest, lang, text)
    words = F.split("phrase", " ")
    long = table.withColumn("_w", words).filter(F.size("_w") >= 2)
    k = F.col("k")
    rest = lambda a, b: F.array_join(F.slice("_w", a, b), " ")
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("_w") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "k", rest(F.lit(1), k).alias("_left"), rest(k + 1, F.size("_w") - k).alias("_right")
    )
    side = lambda name, f: table.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(side("_left", "l"), ["lang", "_left"]).join(side("_right", "r"), ["lang", "_right"]).join(totals, "lang")
    whole = lambda c, p: F.col(c).cast(f"decimal({p},0)")
    cuts = cuts.withColumn("_top", F.lit(1000).cast("decimal(4,0)") * whole("a", 15) * whole("n", 17)).withColumn("_low", whole("l", 18) * whole("r", 18))
    scored = cuts.withColumn("score", F.expr("_top div _low")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_c"))
    scored = scored.select("lang", "phrase", "a", "n", "_c.score", "_c.l", "_c.r")
    # Every phrase inside a longer one of the table, with the most frequent of those.
    size = F.size("_w")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.struct(i.alias("i"), m.alias("m")))))
    inner = long.filter(size > 2).withColumn("_s", F.explode(spans)).select("lang", rest(F.col("_s.i"), F.col("_s.m")).alias("phrase"), "f")
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter("_longer is null or _longer < a")
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
