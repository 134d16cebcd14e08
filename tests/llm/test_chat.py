from pyspark.sql import functions as F

from tidemark.llm import chat


def test_prefix_completions_and_masks(spark):
    rows = [
        (1, "c", 0, "user", "hi"), (1, "c", 1, "assistant", "yes é"), (1, "r", 0, "user", "hi"), (1, "r", 1, "assistant", "no"), (1, "r", 2, "user", "why"),
        (2, "c", 0, "user", "a"), (2, "r", 0, "user", "b"),
        (3, "c", 0, "user", "a"), (3, "c", 1, "assistant", "x"), (3, "r", 0, "user", "a"), (3, "r", 1, "assistant", "x"),
        (4, "c", 0, "user", "alone"),
        (5, "c", 1, None, None), (5, "c", None, "assistant", "<|im_end|>"), (5, "r", 0, "assistant", ""), (5, "r", 0, "assistant", ""),
        (None, "c", 0, "user", "a"), (None, "r", 0, "user", "a"),
        (6, "c", 0, "user", "a"), (6, "c", 1, "assistant", "b"), (6, "r", 0, "user", "a"),
        (7, "c", 0, "assistant", "w" * 100_000), (7, "r", 0, "assistant", "v"),
    ]
    df = spark.createDataFrame(rows, "p long, side string, turn long, role string, text string").withColumn("prompt", F.lit(1))
    got = {r.pair_id: r for r in chat.formatted(chat.turns(df, F.col("p"), F.col("side") == "c")).collect()}
    assert sorted(got) == [1, 2, 3, 5, 6, 7]
    one = got[1]
    assert one.n_prompt_turns == 1 and one.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert one.chosen_completion == "<|im_start|>assistant\nyes é<|im_end|>\n"
    assert [one.chosen_completion[s.start : s.end] for s in one.chosen_spans] == ["yes é<|im_end|>\n"]
    assert [one.rejected_completion[s.start : s.end] for s in one.rejected_spans] == ["no<|im_end|>\n"]
    assert (got[2].n_prompt_turns, got[2].prompt, got[2].chosen_spans) == (0, "", [])
    assert (got[3].n_prompt_turns, got[3].chosen_completion, got[3].rejected_completion) == (2, "", "")
    assert got[5].chosen_completion == "<|im_start|>assistant\n<| im_end|><|im_end|>\n<|im_start|>\n<|im_end|>\n"
    assert (got[6].n_prompt_turns, got[6].rejected_completion) == (1, "")
    assert got[7].chosen_spans[0].end - got[7].chosen_spans[0].start == 100_000 + len(chat.CLOSE)


def test_empty_table(spark):
    df = spark.createDataFrame([], "p long, turn long, role string, text string")
    assert chat.formatted(chat.turns(df, F.col("p"), F.lit(True))).collect() == []
