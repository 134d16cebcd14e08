"""Registered queries of this subpackage, with the SQL that restates them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tidemark.llm import chat, langid, line_dedup, merkle, mixing, packing, phrases, pieces, quality, simhash, suffix, topk, warc
from tidemark.session import materialize, scratch

QUERIES: dict[str, Callable] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


LINE_DEDUP = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS raw FROM documents),
t AS (SELECT doc_id, list_transform(raw, lambda x: trim(x, E' \t\n\x0b\x0c\r')) AS ls FROM l),
w AS (SELECT doc_id, p, ls[p + 1] AS a, ls[p + 2] AS b, ls[p + 3] AS c
  FROM (SELECT doc_id, ls, unnest(range(len(ls) - 2)) AS p FROM t WHERE len(ls) >= 3) AS s),
f AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS nth FROM w WHERE a || b || c <> ''),
gone AS (SELECT DISTINCT doc_id, p + unnest([0, 1, 2]) AS q FROM f WHERE nth > 1),
e AS (SELECT doc_id, unnest(raw) AS x, unnest(range(len(raw))) AS q FROM l),
k AS (SELECT e.doc_id, string_agg(x, chr(10) ORDER BY e.q) FILTER (gone.q IS NULL) AS kept, count(gone.q) AS n_removed
  FROM e LEFT JOIN gone ON gone.doc_id = e.doc_id AND gone.q = e.q GROUP BY 1)
SELECT l.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(kept, CASE WHEN text IS NOT NULL THEN '' END) AS kept_text
FROM l LEFT JOIN k ON k.doc_id = l.doc_id
"""


@query("op1_line_dedup", LINE_DEDUP)
def op1(spark, sf):
    """Every document without the lines of later occurrences of three-line windows."""
    out = line_dedup.deduplicated(table(spark, sf, "documents"))
    return out.select("doc_id", "n_removed", "kept_text")


@query("op2_simhash")
def op2(spark, sf):
    """Near-duplicate class of every document."""
    return simhash.near_duplicates(table(spark, sf, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op7_suffix_array")
def op7(spark, sf):
    """Bytes in strings of 400 bytes that occur more than once, removed from every document.

    ``n_bytes`` is the length before removal; ``text`` is what is left, as after the pipeline's stage."""
    out = suffix.without_repeats(table(spark, sf, "documents"))
    return out.select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept_sha256", F.col("cut.kept_text").alias("text"))


@query("op8_quality_rules")
def op8(spark, sf):
    """Text rules and the likelihood-ratio verdict of every document."""
    out = quality.judged(table(spark, sf, "documents"), quality.trusted(table(spark, sf, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op9_packing")
def op9(spark, sf):
    """All documents in sequences of 2048 tokens."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    made = materialize(packing.pieces(docs, tokenizer("word_bpe_49k.json")), "pieces")
    return packing.packed(made)


WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""


@query("op10_warc", WARC)
def op10(spark, sf):
    """All pages through WARC archives and back."""
    path = scratch(spark, "archive")
    warc.write(table(spark, sf, "pages"), path)
    return warc.resolved(warc.read(spark, path))


TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.e, r.e)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id AND len(q.e) = len(r.e)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 5
"""


@query("op3_topk", TOPK)
def op3(spark, sf):
    """The five best rows for every fiftieth vector."""
    vectors = table(spark, sf, "embeddings")
    return topk.search(vectors, vectors.filter("vec_id % 50 = 0"), 5)


@query("op5_language")
def op5(spark, sf):
    """Language of every document by code lengths, learned from three quarters of them."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return langid.held_out(docs).select("doc_id", "held_out", "lang_pred", "score")


@query("op4_sentencepiece")
def op4(spark, sf):
    """Ids of every whole document, and whether they decode to it."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pieces.checked(docs, tokenizer("piece_bpe_32k.model")).select("doc_id", "n_ids", "ids_crc32", "round_trip")


CHAT = """
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS txt,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
both_sides AS (SELECT pair_id FROM t GROUP BY 1 HAVING count(DISTINCT side) = 2),
cmp AS (SELECT pair_id, n, count(*) = 2 AND min(role) = max(role) AND min(txt) = max(txt) AS same FROM t JOIN both_sides USING (pair_id) GROUP BY 1, 2),
p AS (SELECT pair_id, coalesce(min(n) FILTER (NOT same) - 1, max(n)) AS k FROM cmp GROUP BY 1),
r AS (SELECT t.*, p.k, replace(txt, '<|im_', '<| im_') AS body FROM t JOIN p USING (pair_id)),
m AS (SELECT *, '<|im_start|>' || role || chr(10) AS head, body || '<|im_end|>' || chr(10) AS tail FROM r),
o AS (SELECT *, coalesce(sum(length(head) + length(tail)) FILTER (n > k) OVER (PARTITION BY pair_id, side ORDER BY n), 0) AS stop FROM m)
SELECT pair_id, any_value(k)::INTEGER AS n_prompt_turns,
  coalesce(string_agg(head || tail, '' ORDER BY n) FILTER (side = 0 AND n <= k), '') AS prompt,
  coalesce(string_agg(head || tail, '' ORDER BY n) FILTER (side = 0 AND n > k), '') AS chosen_completion,
  coalesce(string_agg(head || tail, '' ORDER BY n) FILTER (side = 1 AND n > k), '') AS rejected_completion,
  coalesce(string_agg((stop - length(tail))::BIGINT::VARCHAR || '-' || stop::BIGINT::VARCHAR, ',' ORDER BY n) FILTER (side = 0 AND n > k AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg((stop - length(tail))::BIGINT::VARCHAR || '-' || stop::BIGINT::VARCHAR, ',' ORDER BY n) FILTER (side = 1 AND n > k AND role = 'assistant'), '') AS rejected_spans
FROM o GROUP BY 1
"""


@query("op6_chat", CHAT)
def op6(spark, sf):
    """Conversations 2 n (chosen) and 2 n + 1 (rejected) as preference pairs."""
    rows = table(spark, sf, "conversations")
    pairs = chat.turns(rows, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0)
    return chat.formatted(pairs).select(
        "pair_id", "n_prompt_turns", "prompt", "chosen_completion", "rejected_completion",
        chat.listed("chosen_spans").alias("chosen_spans"), chat.listed("rejected_spans").alias("rejected_spans"),
    )


MIX = r"""
WITH q AS (SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END) AS w FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
d AS (SELECT d.doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
  -ln((('0x' || substr(sha256(coalesce(d.doc_id::VARCHAR, '-') || ':' || coalesce(text, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496) / coalesce(w, 1) AS key
  FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS w FROM d GROUP BY 1),
r AS (SELECT *, rank() OVER (ORDER BY source_size / w::DOUBLE, source NULLS LAST) AS k FROM s),
c AS (SELECT a.k, (SELECT sum(source_size) FROM s) - coalesce(sum(3 * b.source_size) FILTER (b.k < a.k), 0) AS rest, sum(b.w) FILTER (b.k >= a.k) AS weight FROM r a, r b GROUP BY a.k),
f AS (SELECT r.*, rest, weight, 3 * source_size * weight <= w * rest AS full_ FROM r JOIN c USING (k)),
t AS (SELECT source, source_size, CASE WHEN full_ THEN (3 * source_size)::DOUBLE ELSE (w * (SELECT arg_min(rest, k) FROM f WHERE NOT full_))::DOUBLE / (SELECT arg_min(weight, k) FROM f WHERE NOT full_)::DOUBLE END AS target FROM f),
o AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, ((epochs + CASE WHEN target - epochs * source_size > 0 AND 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM o
"""


@query("op12_mixing", MIX)
def op12(spark, sf):
    """How often the mix of all sources takes each document, good ones first."""
    rows = mixing.label_weights(mixing.measured(table(spark, sf, "documents")), table(spark, sf, "labels"))
    return mixing.mixed(rows, "quality_weight").select("doc_id", "size", "source_size", "target", "taken")


MERKLE = """
WITH RECURSIVE v AS (SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
  coalesce(strlen(text) || ':' || text, '-') AS z, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, i: xor(y >> 1, (y & 1) * 3988292384))) AS crc FROM documents),
b AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf,
  sha256(a || coalesce(strlen((n_chars + x)::VARCHAR) || ':' || (n_chars + x), '-') || z) AS bad FROM (SELECT *, CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS x FROM v)),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM b),
t AS (SELECT g, 0 AS lev, pos, leaf AS h, n FROM l UNION ALL
  SELECT * FROM (SELECT g, lev + 1, pos // 2, sha256(h || coalesce(lead(h) OVER (PARTITION BY g ORDER BY pos), '')), (n + 1) // 2 AS m FROM t WHERE n > 1 QUALIFY pos % 2 = 0)),
tm AS MATERIALIZED (SELECT * FROM t),
s AS MATERIALIZED (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tm WHERE n = 1),
u AS (SELECT 0 AS lev, pos, subroot AS h, n FROM s UNION ALL
  SELECT * FROM (SELECT lev + 1, pos // 2, sha256(h || coalesce(lead(h) OVER (ORDER BY pos), '')), (n + 1) // 2 AS m FROM u WHERE n > 1 QUALIFY pos % 2 = 0)),
um AS MATERIALIZED (SELECT * FROM u),
up AS (SELECT g, 0 AS lev, pos, ''::VARCHAR AS proof, []::VARCHAR[] AS ls, []::VARCHAR[] AS rs FROM s UNION ALL
  SELECT up.g, up.lev + 1, up.pos // 2, proof || coalesce(x.h, ''), list_append(ls, CASE WHEN up.pos % 2 = 1 THEN x.h ELSE '' END), list_append(rs, CASE WHEN up.pos % 2 = 0 THEN coalesce(x.h, '') ELSE '' END)
  FROM up JOIN um o ON o.lev = up.lev AND o.pos = up.pos AND o.n > 1 LEFT JOIN um x ON x.lev = up.lev AND x.pos = xor(up.pos, 1)),
lo AS (SELECT doc_id, g, leaf, pos AS place, 0 AS lev, pos, ''::VARCHAR AS proof, bad AS f FROM l UNION ALL
  SELECT lo.doc_id, lo.g, lo.leaf, place, lo.lev + 1, lo.pos // 2, proof || coalesce(x.h, ''), sha256(CASE WHEN lo.pos % 2 = 1 THEN x.h || f ELSE f || coalesce(x.h, '') END)
  FROM lo JOIN tm o ON o.g = lo.g AND o.lev = lo.lev AND o.pos = lo.pos AND o.n > 1 LEFT JOIN tm x ON x.g = lo.g AND x.lev = lo.lev AND x.pos = xor(lo.pos, 1)),
e AS (SELECT * FROM lo QUALIFY row_number() OVER (PARTITION BY g, place ORDER BY lev DESC) = 1),
k AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY g ORDER BY lev DESC) = 1),
w AS (SELECT e.doc_id, e.leaf, s.subroot, (SELECT h FROM um WHERE n = 1) AS root, sha256(e.proof || k.proof) AS proof_sha256,
  list_reduce(list_prepend(f, list_transform(range(1, len(ls) + 1), lambda i: ls[i] || ':' || rs[i])), lambda acc, y: sha256(replace(y, ':', acc))) AS folded_root
  FROM e JOIN s USING (g) JOIN k USING (g))
SELECT *, folded_root = root AS verified FROM w
"""


@query("op13_merkle", MERKLE)
def op13(spark, sf):
    """Leaf, roots and proof of every document, and whether tampered documents still fold to the root."""
    docs = table(spark, sf, "documents")
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    cells = lambda n: [F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")]
    n_chars = F.col("n_chars").cast("decimal(20,0)")
    tampered = F.when(hit, merkle.leaf(*cells(n_chars + 1)))
    leaves = docs.select("doc_id", "lang", merkle.leaf(*cells(n_chars)).alias("leaf"), tampered.alias("tampered"))
    out = merkle.manifest(leaves, "lang", "doc_id")
    out = out.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))).withColumn("proof_sha256", merkle.proof_digest(F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


PHRASES = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, m, array_to_string(ws[i + 1 : i + m], ' ') AS phrase FROM (SELECT lang, ws, m, unnest(range(len(ws) - m + 1)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) AS ms WHERE len(ws) >= m) AS s),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2 AND f >= 100),
k AS (SELECT c.lang, c.m, c.phrase, c.a, x.f AS l, y.f AS r, n, 1000 * a * n // (x.f * y.f) AS score, k
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) AS c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ') JOIN n ON n.lang = c.lang),
s AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.lang = s.lang AND d.m > s.m AND 100 * d.a >= 100 * s.a AND contains(' ' || d.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) AS t WHERE rank <= 2000
"""


@query("op11_phrases", PHRASES)
def op11(spark, sf):
    """The best collocations of each language."""
    return phrases.collocations(table(spark, sf, "documents").select("lang", "text"))
