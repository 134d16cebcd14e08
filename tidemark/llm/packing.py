"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents become pieces of at most ``CAPACITY`` tokens; only longer documents are cut, into full pieces and a
rest. Full pieces are sequences of their own. The others are dealt by hash into blocks of about ``BLOCK``
pieces, and each block is packed by ``ISLANDS`` populations that run in separate tasks. The genes of
a packing are its bins. Crossover puts the best filled bins of one parent whole into the other,
removes the bins of the other that hold a piece twice, and lets the displaced pieces best-fit back in. After each
epoch the best packing of each island goes to the next island of its ring. What the best packing
of a block leaves in badly filled bins is dealt anew, with the leavings of other blocks, in further rounds,
so that blocks do not cost a bin each; every round has a fraction of the pieces of the one before.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

CAPACITY = 2048
BLOCK = 2000  # pieces that a population packs
ISLANDS = 2
POPULATION = 4
GENERATIONS = 6  # in an epoch
EPOCHS = 2
FULL = 0.995  # bins filled to this share are final; pieces of others go to the next round
WORDS = 900_000  # different words whose ids a worker remembers
TOGETHER = 2_000_000  # characters whose new words are encoded together
MARK = "\0"
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # a run of these between letters and a blank is cut off by itself
TOGETHER_WORDS = 5000


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    The tokenizer lower-cases, drops white space and joins nothing across it, so the ids of a text are those of its
    words, which are looked up; the new words of many texts are encoded together. A word of letters is mostly one run of
    ids up to one that ends a word, so such words are told apart by these ids; between others stands ``MARK``.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.known = Tokenizer.from_file(tokenizer), {}
        self.mark = self.ids(MARK)
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closing = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that end a word
        if suffix:
            self.closing[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, words: set[bytes]) -> None:
        letters, others, mark = [], [], MARK.encode()
        for w in words:
            if mark in w or b"<|" in w:  # the mark itself, or perhaps a special token
                self.known[w] = self.ids(w.decode()).tobytes()
            else:
                (letters if w.decode().isalpha() else others).append(w)
        for at in range(0, len(letters), TOGETHER_WORDS):
            part = letters[at : at + TOGETHER_WORDS]
            ids = self.ids(" ".join([w.decode() for w in part]))
            cuts = (np.flatnonzero(self.closing[ids]) + 1) * 4
            if len(cuts) == len(part) and cuts[-1] == ids.nbytes:  # each word ends at least one run, so exactly one
                self.keep(part, ids, np.r_[0, cuts[:-1]], cuts)
            else:
                others += part
        for at in range(0, len(others), TOGETHER_WORDS):
            part = others[at : at + TOGETHER_WORDS]
            ids = self.ids(f" {MARK} ".join([w.decode() for w in part]))
            cuts = np.flatnonzero(ids == self.mark[0]) * 4
            self.keep(part, ids, np.r_[0, cuts + 4], np.r_[cuts, ids.nbytes])

    def keep(self, words: list[bytes], ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        data = ids.tobytes()
        for w, i, j in zip(words, begins.tolist(), ends.tolist(), strict=True):
            self.known[w] = data[i:j]

    def stem(self, word: bytes) -> bytes:
        """``word`` without the run of marks that follows its letters, or the word itself. Lower case turns a letter into
        letters, but for the dotted capital I, whose dot would belong to the marks."""
        stem = word.rstrip(MARKS)
        if len(stem) == len(word):
            return word
        letters = stem.decode()
        return stem if letters.isalpha() and "\u0130" not in letters else word

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split, seen = [], set()
        for text in texts:
            data = (text or "").encode("utf-8", "replace")
            words = (data if b"<|" in data else data.lower()).split()  # ASCII letters and white space
            split.append(words)
            seen.update(words)
        new = seen.difference(self.known)
        if len(self.known) + len(new) > WORDS:
            self.known.clear()
            new = seen
        cut = {w: stem for w in new if (stem := self.stem(w)) is not w}
        learn = new.difference(cut)
        learn.update(cut.values(), {w[len(stem) :] for w, stem in cut.items()})
        self.learn(learn.difference(self.known))
        for w, stem in cut.items():
            self.known[w] = self.known[stem] + self.known[w[len(stem) :]]
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """This worker's encoder, which keeps its words from task to task."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = Encoder(tokenizer)
    return _ENCODERS[tokenizer]


PIECES = "piece int, start long, length long, ids_crc32 long"


def gathered(texts) -> Iterator[tuple[int, list]]:
    """Runs of texts of about ``TOGETHER`` characters, with the number of the first."""
    many, size, first = [], 0, 0
    for i, t in enumerate(texts):
        many.append(t)
        size += len(t or "")
        if size > TOGETHER:
            yield first, many
            many, size, first = [], 0, i + 1
    if many:
        yield first, many


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """One row per piece: the columns of ``docs`` without the text, then piece, start, length and ids_crc32.

    A document is its ids and then ``end``; null and empty texts are ``end`` alone. Columns of ``docs`` with the names of
    the new ones are replaced.
    """
    made_here = {field.split()[0] for field in PIECES.split(", ")}
    keep = [f for f in docs.schema.fields if f.name != text and f.name.lower() not in made_here]
    names = [f.name for f in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), PIECES])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, last = encoder(tokenizer), np.array([end], "<u4").tobytes()
        for pdf in batches:
            rows, out = [], []
            for first, many in gathered(pdf[text]):
                for i, data in enumerate(encode(many), first):
                    data += last
                    for n, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        rows.append(i)
                        out.append((n, at // 4, len(part) // 4, zlib.crc32(part)))
            made = pd.DataFrame(out, columns=["piece", "start", "length", "ids_crc32"])
            yield pd.concat([pdf[names].iloc[rows].reset_index(drop=True), made], axis=1)

    return docs.mapInPandas(run, schema)


# A packing is a list of bins, a bin its fill and a tuple of piece numbers. Pieces are numbered within a block.


class Block:
    """The pieces of one block and the steps of the algorithm on them."""

    def __init__(self, lengths: list[int], capacity: int, seed: int):
        self.lengths, self.capacity, self.random = lengths, capacity, Random(seed)

    def best_fit(self, loose: list[int], bins: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, tuple[int, ...]]]:
        """Put each loose piece, in order, into the fullest bin that has room."""
        lengths, capacity = self.lengths, self.capacity
        out = [list(members) for _, members in bins]
        # Room and number of each bin with room, as one number.
        room = sorted((capacity - fill) << 32 | n for n, (fill, _) in enumerate(bins) if fill < capacity)
        for i in loose:
            need = lengths[i]
            at = bisect_left(room, need << 32)
            if at < len(room):
                best = room.pop(at)
                n = best & 0xFFFFFFFF
                out[n].append(i)
                left = (best >> 32) - need
            else:
                n, left = len(out), capacity - need
                out.append([i])
            if left:
                insort(room, left << 32 | n)
        fills = [capacity] * len(out)
        for r in room:
            fills[r & 0xFFFFFFFF] -= r >> 32
        return list(zip(fills, map(tuple, out), strict=True))

    def fitness(self, packing: list[tuple[int, tuple[int, ...]]]) -> tuple[int, int]:
        """Fewer bins first, then fuller ones."""
        return -len(packing), sum(fill * fill for fill, _ in packing)

    def founder(self) -> list[tuple[int, tuple[int, ...]]]:
        """Best fit in falling order of length, disturbed at random."""
        order = sorted(range(len(self.lengths)), key=lambda i: -self.lengths[i] * (1 + 0.1 * self.random.random()))
        return self.best_fit(order, [])

    def cross(self, a: list[tuple[int, tuple[int, ...]]], b: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, tuple[int, ...]]]:
        """Some of the best filled bins of ``b`` go whole into ``a``; bins of a that meet them are emptied."""
        ranked = sorted(b, reverse=True)
        given = ranked[: max(1, int(len(ranked) * self.random.uniform(0.3, 0.7)))]
        taken = {i for _, members in given for i in members}
        kept, loose = list(given), []
        for x in a:
            if taken.isdisjoint(x[1]):
                kept.append(x)
            else:
                loose += [i for i in x[1] if i not in taken]
        return self.mutate(kept, loose)

    def mutate(self, packing: list[tuple[int, tuple[int, ...]]], loose: list[int]) -> list[tuple[int, tuple[int, ...]]]:
        """Also empty a few of the worst filled bins, then best-fit all loose pieces, long ones first."""
        ranked = sorted(packing)
        n = min(len(ranked), 2 + self.random.randrange(4))
        loose = loose + [i for _, members in ranked[:n] for i in members]
        self.random.shuffle(loose)
        loose.sort(key=self.lengths.__getitem__, reverse=True)
        return self.best_fit(loose, ranked[n:])

    def evolve(self, population: list, generations: int) -> list:
        """Tournaments pick the parents; a child takes the place of the worst."""
        least = -(-sum(self.lengths) // self.capacity)
        ranked = sorted(((self.fitness(p), p) for p in population), reverse=True)
        for _ in range(generations * len(population)):
            if -ranked[0][0][0] <= least:  # no packing has fewer bins
                break
            a, b = (min(self.random.sample(range(len(ranked)), 2)) for _ in range(2))
            if a == b:
                b = (a + 1) % len(ranked)
            child = self.cross(ranked[a][1], ranked[b][1])
            ranked[-1] = (self.fitness(child), child)
            ranked.sort(reverse=True)
        return [p for _, p in ranked]


def _flat(packing: list[tuple[int, tuple[int, ...]]]) -> tuple[list[int], list[int]]:
    return [i for _, b in packing for i in b], [len(b) for _, b in packing]


def _bins(order, sizes, lengths: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    out, at, order = [], 0, [int(i) for i in order]
    for n in sizes:
        members = tuple(order[at : at + n])
        out.append((sum(map(lengths.__getitem__, members)), members))
        at += n
    return out


ONE = "struct<order:array<int>, sizes:array<int>>"
STATE = f"block long, island int, lengths array<int>, population array<{ONE}>, best {ONE}, bins long, squares long"


def _epoch(capacity: int, epoch: int):
    """An island takes in its guest, evolves, and names its best."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                block = Block([int(x) for x in r.lengths], capacity, hash((r.block, r.island, epoch)))
                people = [_bins(p["order"], p["sizes"], block.lengths) for p in (r.population if r.population is not None else [])]
                people = people or [block.founder() for _ in range(POPULATION)]
                if r.guest is not None:
                    people[-1] = _bins(r.guest["order"], r.guest["sizes"], block.lengths)
                people = block.evolve(people, GENERATIONS)
                told = [dict(zip(("order", "sizes"), _flat(x), strict=True)) for x in people]
                yield pd.DataFrame(
                    [(r.block, r.island, r.lengths, told, told[0], *block.fitness(people[0]))],
                    columns=["block", "island", "lengths", "population", "best", "bins", "squares"],
                )

    return run


def _places(rows: DataFrame, capacity: int, blocks: int) -> DataFrame:
    """(block, bin, at): the bin of each row of ``rows`` (block, at, length); ``at`` counts the rows of a block from 0."""
    lengths = F.transform(F.array_sort(F.collect_list(F.struct("at", "length"))), lambda x: x["length"].cast("int")).alias("lengths")
    state = rows.groupBy("block").agg(lengths).select(
        "block",
        F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
        "lengths",
        F.lit(None).cast(f"array<{ONE}>").alias("population"),
        F.lit(None).cast(ONE).alias("guest"),
    )
    for epoch in range(EPOCHS):
        if epoch:  # the ring: an island's guest is the best of the one before it
            sent = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("best").alias("guest"))
            state = state.drop("best", "bins", "squares").join(sent, ["block", "island"])
        dealt = state.repartition(min(blocks * ISLANDS, 20_000), "block", "island")  # work counts here, not bytes
        state = materialize(dealt.mapInPandas(_epoch(capacity, epoch), STATE), "islands")
    best = state.groupBy("block").agg(F.max_by("best", F.struct("bins", "squares", "island")).alias("best"))
    starts = best.withColumn(
        "bins", F.expr("transform(best.sizes, (n, b) -> named_struct('n', n, 'first', aggregate(slice(best.sizes, 1, b), 0, (s, x) -> s + x)))")
    )
    each = starts.select("block", F.col("best.order").alias("order"), F.posexplode("bins").alias("bin", "b"))
    return each.select("block", "bin", F.explode(F.expr("slice(order, b.first + 1, b.n)")).alias("at"))


def packed(rows: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """``rows`` (any columns and ``length``, 1 to ``capacity``) with ``sequence_id`` and ``offset`` (long).

    ``rows`` is read more than once, so it must be a written table. Rows need no key: equal rows get places of their
    own. In a sequence places have no gaps. Columns block, at, bin and fill are reserved.
    """
    own = Window.partitionBy("block", "bin").orderBy("at")
    out = rows.filter(F.col("length") >= capacity).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    todo = rows.filter(F.col("length") < capacity)
    n = todo.count()
    for level in range(1, 64):
        blocks = max(1, -(-n // block))
        numbered = materialize(
            todo.withColumn("block", F.floor(F.rand(level) * blocks)).withColumn(
                "at", F.row_number().over(Window.partitionBy("block").orderBy("length")) - 1
            ),
            "numbered",
        )
        here = numbered.join(_places(numbered.select("block", "at", "length"), capacity, blocks), ["block", "at"])
        here = here.withColumn("fill", F.sum("length").over(Window.partitionBy("block", "bin"))).withColumn(
            "sequence_id", F.lit(level << 56) + F.shiftleft("block", 16) + F.col("bin")
        ).withColumn("offset", (F.sum("length").over(own) - F.col("length")).cast("long"))
        here = materialize(here, "packed")
        left = here.filter(F.col("fill") < FULL * capacity)
        m = left.count()
        last = blocks == 1 or m > 0.7 * n  # one block, or a next round of hardly fewer pieces
        out = out.unionByName((here if last else here.filter(F.col("fill") >= FULL * capacity)).select(*out.columns))
        if last:
            break
        todo, n = left.select(*rows.columns), m
    return out
