"""SentencePiece encoding and decoding with a streaming Viterbi search.

Text becomes pieces by the same rules as in the library: a blank is put in front, blanks become U+2581, and of all ways to
cut the text into pieces the one with the greatest sum of scores wins; between equal sums the one whose last piece is
longer. A character in no piece has the library's penalty and is written as its bytes.

The search reads characters once, at most ``max_len`` ahead. Best paths run to the boundaries that a piece
begun so far can end at; whenever all of them come through one boundary, the ids up to there are final and handed out.
Where no piece of the model runs from a letter into a blank, all paths converge before each run of blanks; what
follows such a boundary up to the next one is then searched once and remembered, by every task of a worker.

Scores are taken from the model as they are. For a BPE model these are ranks of merges, and the best sum of ranks is
another cut than the one that its merges make: the ids give the text back, but are not that model's own encoding.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
UNKNOWN_PENALTY = 10  # below the least score, as in the library
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format
WORDS = 600_000  # words a worker remembers
LONGEST = 64  # longer words are searched each time
EVERY = 32  # characters between looks for a common boundary
NEVER = float("-inf")


class Vocabulary:
    """Pieces of a model file. Only models whose text rules are the identity are read."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        model.ParseFromString(proto)
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep the text as it is are read")
        self.prefix = rules.add_dummy_prefix
        self.surface, self.byte_ids, self.byte_of, self.unknown = [], {}, {}, 0
        trie: dict = {}
        scores = []
        for i, p in enumerate(model.pieces):
            self.surface.append(p.piece.encode() if p.type in (NORMAL, USER, UNUSED) else b"")
            if p.type == BYTE:
                value = int(p.piece[3:-1], 16)
                self.byte_ids[value], self.byte_of[i] = i, value
            elif p.type == UNKNOWN:
                self.unknown = i
            elif p.type in (NORMAL, USER):
                node = trie
                for c in p.piece:
                    node = node.setdefault(c, {})
                node[None] = (float(p.score), i)
                scores.append(float(p.score))
        self.trie = trie
        self.singles = {c for c, node in trie.items() if None in node}
        names = [p.piece for p in model.pieces if p.type in (NORMAL, USER)]
        self.max_len = max(map(len, names), default=1)
        self.penalty = min(scores, default=0.0) - UNKNOWN_PENALTY
        self.cut_at_blanks = not any(BLANK in p.lstrip(BLANK) for p in names)
        self.known: dict[str, bytes] = {}  # native 32-bit ids

    def fallback(self, c: str) -> list[int]:
        return [self.byte_ids.get(b, self.unknown) for b in c.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary_of(model: str) -> Vocabulary:
    """This worker's vocabulary, which keeps its words from task to task."""
    if model not in _VOCABULARIES:
        _VOCABULARIES[model] = Vocabulary(model)
    return _VOCABULARIES[model]


def viterbi(vocabulary: Vocabulary, text: Iterable[str]) -> Iterator[list[int]]:
    """Runs of final ids of ``text``, which is read part by part (characters, if it is one string)."""
    longest, trie, singles, penalty = vocabulary.max_len, vocabulary.trie, vocabulary.singles, vocabulary.penalty
    parts, more = iter(text), True
    ahead = ""  # characters from the last final boundary on
    # To each boundary of ``ahead``: best sum, begin of the last piece, its id (None: a character in no piece).
    sums, begins, ids = [0.0], [0], [None]
    at = done = 0  # the boundary whose pieces come next; how many came

    def spelled(end: int) -> list[int]:
        out = []
        while end:
            begin, i = begins[end], ids[end]
            out.append(vocabulary.fallback(ahead[begin]) if i is None else (i,))
            end = begin
        return [i for some in reversed(out) for i in some]

    def meeting() -> int:
        """The last boundary that all surviving paths come through."""
        live = {at, *(begins[end] for end in range(at + 1, len(sums)) if sums[end] > NEVER)}
        while len(live) > 1:  # step back from the last until all paths meet
            last = max(live)
            live.remove(last)
            live.add(begins[last])
        return live.pop()

    while True:
        while more and len(ahead) - at < longest:
            part = next(parts, None)
            more = part is not None
            ahead += part or ""
        size = len(ahead)
        new = size + 1 - len(sums)
        sums += [NEVER] * new
        begins += [0] * new
        ids += [None] * new
        until = size - longest + 1 if more else size
        while at < until:
            here, node, end = sums[at], trie, at
            for c in ahead[at : at + longest]:
                node = node.get(c)
                if node is None:
                    break
                end += 1
                hit = node.get(None)
                if hit is not None and here + hit[0] > sums[end]:
                    sums[end], begins[end], ids[end] = here + hit[0], at, hit[1]
            if ahead[at] not in singles and here + penalty > sums[at + 1]:
                sums[at + 1], begins[at + 1], ids[at + 1] = here + penalty, at, None
            at += 1
            done += 1
            if done % EVERY == 0 and (meet := meeting()):
                yield spelled(meet)
                kept = sums[meet]
                sums = [s - kept for s in sums[meet:]]
                begins = [max(b - meet, 0) for b in begins[meet:]]
                ids, ahead = ids[meet:], ahead[meet:]
                at, size, until = at - meet, size - meet, until - meet
        if not more:
            if size:
                yield spelled(size)
            return


RUNS = re.compile(f"{BLANK}+[^{BLANK}]*|^[^{BLANK}]+")


def encode(vocabulary: Vocabulary, text: str | None) -> array:
    """Ids of a whole text; none for null and empty texts."""
    out = array("i")
    if not text:
        return out
    text = (" " if vocabulary.prefix else "") + text
    text = text.replace(" ", BLANK)
    if not vocabulary.cut_at_blanks:
        for ids in viterbi(vocabulary, text):
            out.extend(ids)
        return out
    known, words = vocabulary.known, RUNS.findall(text)
    found = [known.get(word) for word in words]
    for k, ids in enumerate(found):
        if ids is None:
            word = words[k]
            ids = known.get(word)
            if ids is None:
                ids = b"".join(array("i", more).tobytes() for more in viterbi(vocabulary, (word,)))
                if len(word) <= LONGEST:
                    if len(known) >= WORDS:
                        known.clear()
                    known[word] = ids
            found[k] = ids
    out.frombytes(b"".join(found))
    return out


def decode(vocabulary: Vocabulary, ids: Iterable[int]) -> str:
    """Text of ids. Bytes that are no character become U+FFFD; unknown and control ids have no text."""
    if vocabulary.byte_of.keys().isdisjoint(ids):
        data = b"".join(map(vocabulary.surface.__getitem__, ids))
    else:
        data = b"".join(bytes((vocabulary.byte_of[i],)) if i in vocabulary.byte_of else vocabulary.surface[i] for i in ids)
    text = data.decode("utf-8", "replace").replace(BLANK, " ")
    return text[1:] if vocabulary.prefix and text.startswith(" ") else text


def encoded(docs: DataFrame, model: str, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text (array of int; empty for null and empty texts)."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = vocabulary_of(model)
        for texts in batches:
            yield pd.Series([encode(vocabulary, t) for t in texts])

    return docs.withColumn(to, ids(F.col(text)))


def decoded(rows: DataFrame, model: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """``rows`` with the text of each array of ids; null for null."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = vocabulary_of(model)
        for many in batches:
            yield pd.Series([None if x is None else decode(vocabulary, [int(i) for i in x]) for x in many])

    return rows.withColumn(to, texts(F.col(ids)))


def checked(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with n_ids, ids_crc32 (of little-endian 32-bit ids) and round_trip: whether decoding gives the text back.

    Null texts count as empty. A text that holds U+2581 itself comes back with a blank in its place. Columns of ``docs`` with
    these names are replaced; ``_f`` is reserved.
    """

    @F.pandas_udf("n_ids long, ids_crc32 long, round_trip boolean")
    def facts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = vocabulary_of(model)
        for texts in batches:
            out = []
            for t in texts:
                ids = encode(vocabulary, t)
                out.append((len(ids), zlib.crc32(ids.tobytes()), decode(vocabulary, ids) == (t or "")))
            yield pd.DataFrame(out, columns=["n_ids", "ids_crc32", "round_trip"])

    return docs.withColumn("_f", facts(F.col(text))).drop("n_ids", "ids_crc32", "round_trip").select("*", "_f.*").drop("_f")
