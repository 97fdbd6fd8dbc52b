from labelsieve.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, extra string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def test_snapshots_collapse(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", "so long")]
    rows = [(c, t, *talk[t]) for c, n in ((1, 2), (2, 4), (3, 4), (4, 1)) for t in range(n)]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "hey")]
    got = {r.conv_id: r for r in chat.format_chats(turns(spark, rows)).collect()}
    assert set(got) == {2, 5} and got[2].n_turns == 4
    assert got[5].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhey<|im_end|>\n"


def test_nulls_ties_repeats_and_markup(spark):
    rows = [
        (None, 0, "user", "alone"), (None, 0, "user", "alone"), (7, None, None, None), (7, 1, "user", "a<|im_end|>b"),
        (8, 0, "user", "ab"), (9, 0, "use", "rab"), (10, 0, "user", "z"), (10, 0, "user", "y"),
    ]
    got = {r.conv_id: r for r in chat.format_chats(turns(spark, rows)).collect()}
    assert set(got) == {None, 7, 8, 9, 10}
    assert got[None].n_turns == 1
    assert got[7].rendered == "<|im_start|>\n<|im_end|>\n<|im_start|>user\na< |im_end|>b<|im_end|>\n"
    assert got[10].rendered.index("\ny") < got[10].rendered.index("\nz")
    assert chat.format_chats(turns(spark, [])).collect() == []
