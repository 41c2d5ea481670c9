import hashlib

from lexispark.llm import chat_format as C
from pyspark.sql import functions as F

PARTS = [r"\### Assistant: </turn> ok", "", "a\\", "\\\\</turn>", "\n</turn>\n", "### user:\n", "<next/>", "\n<next/>\n\\<next/>", "plain", "é\n\n", "### ### ", "</turn></turn>", "\\\\\\### x\\"]


def read_back(spark, rows, **more):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = C.format_conversations(df, **more)
    return {r.conv_id: r for r in made.select("conv_id", "formatted", "loss_spans", C.parse_formatted(F.col("formatted")).alias("turns"), C.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}


def test_control_strings_come_back(spark):
    roles = ["user", "assistant", "assistant", "a:b\n%3A", "", "assistant"]
    rows, want = [], {}
    for c, first in enumerate(PARTS):
        turns = [(roles[(c + i) % len(roles)], p) for i, p in enumerate([first, *PARTS])]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)][::-1]
        want[c] = turns
    got = read_back(spark, rows)
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss == "".join(t for r, t in turns if r == "assistant")
        own = [got[c].formatted[s.start : s.end] for s in got[c].loss_spans]
        assert len(own) == sum(r == "assistant" for r, _ in turns)


def test_neighbours_of_one_role_merge(spark):
    got = read_back(spark, [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")])[1]
    assert got.formatted == "### user:\na\n<next/>\nb\n</turn>\n### assistant:\nc\n</turn>\n"


def test_odd_rows(spark):
    got = read_back(spark, [(None, 1, "user", "x"), (None, None, None, None), (2, 1, "b", "t"), (2, 1, "a", "t"), (2, 1, "a", "t"), (3, 0, "assistant", "y" * 300_000)])
    assert [(t.role, t.text) for t in got[None].turns] == [("", ""), ("user", "x")]
    assert [t.role for t in got[2].turns] == ["a", "a", "b"]
    assert got[3].loss == "y" * 300_000
    assert read_back(spark, []) == {}


def test_other_columns_do_not_matter(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", 1, 2, 3)], "conv_id bigint, turn bigint, role string, text string, row int, rows int, pieces int")
    assert C.format_conversations(df).columns == ["conv_id", "formatted", "loss_spans"]


def test_query(spark, tmp_path):
    from lexispark.llm.queries import op2_chat_formatting

    spark.createDataFrame([(5, 1, "assistant", None), (5, 0, "user", "hi")], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op2_chat_formatting(spark, str(tmp_path)).collect()}
    assert set(got) == {5, -7}
    assert (got[5].n_turns, got[5].loss_chars, got[5].turns_sha256) == (2, 0, hashlib.sha256(b"user\nhi\nassistant\n\n").hexdigest())
    assert got[-7].loss_sha256 == hashlib.sha256(PARTS[0].encode()).hexdigest()


def test_plan_is_relational(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    plan = C.format_conversations(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
