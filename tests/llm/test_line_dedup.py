import random

from tidemark.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def plain(rows):
    """(kept text, removed lines) of each row, by a table of windows in order of (id, place)."""
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    result = {}
    for i in order:
        text = rows[i][1]
        if text is None:
            result[i] = (None, 0)
            continue
        lines = text.split("\n")
        gone = set()
        for at in range(len(lines) - 2):
            w = tuple(x.strip(BLANKS) for x in lines[at : at + 3])
            if any(w):
                if w in seen:
                    gone |= {at, at + 1, at + 2}
                seen.add(w)
        result[i] = ("\n".join(x for j, x in enumerate(lines) if j not in gone), len(gone))
    return [result[i] for i in range(len(rows))]


def test_against_a_table_of_windows(spark):
    rng = random.Random(2)
    lines = ["", "  ", "a", "b b", "c\t", "d", "é", "f" * 300]
    rows = [(None, "x\ny\nz"), (1, None), (2, ""), (3, "a"), (4, "a\nb"), (5, "x\ny\nz"), (6, "\n\n\n\n"), (7, "q\nq\nq\nq\nq\nr")]
    rows += [(10 + i, "\n".join(rng.choices(lines, k=rng.randint(1, 14)))) for i in range(60)]
    rows += [(100, rows[20][1]), (101, "\n".join(rng.choices("abcdefghijkl", k=3000)))]
    df = spark.createDataFrame([(*r, "kept", 1) for r in rows], "doc_id long, text string, at string, n_removed int")
    got = {r.doc_id: (r.kept_text, r[-1]) for r in line_dedup.deduplicated(df.drop("n_removed")).collect()}
    want = {r[0]: w for r, w in zip(rows, plain(rows))}
    assert got == want


def test_rows_equal_in_id_and_text_stay_alike(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd")] * 2 + [(2, "a\nb\nc")], "doc_id long, text string")
    assert sorted((r.doc_id, r.kept_text) for r in line_dedup.deduplicated(df).collect()) == [(1, "a\nb\nc\nd")] * 2 + [(2, "")]


def test_empty_table(spark):
    assert line_dedup.deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
