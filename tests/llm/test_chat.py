import hashlib
import random

from pyspark.sql import functions as F

from lamina.llm import chat
from lamina.llm.queries import QUERIES

from .common import SF

SCHEMA = "conv_id long, turn long, role string, text string"
PARTS = ["<|turn|>", "<|text|>", "<|more|>", "<|end|>", "<", "<~", "~", "|>", "a", "é\U0001f600", "\n", "</s>[INST] ok [/INST]", "$1\\", ""]


def test_round_trip_with_control_strings(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "system", "<|end|>", None]), r.choice([None, "".join(r.choice(PARTS) for _ in range(r.randrange(8)))])) for c in range(60) for t in range(r.randrange(1, 9))]
    rows += [(70, 1, "assistant", "x"), (70, 1, "assistant", "x"), (70, None, "user", "first"), (None, 0, "assistant", "y"), (71, 0, "assistant", "long " * 50000)]
    df = spark.createDataFrame(rows, SCHEMA)
    made = chat.format_chats(df)
    got = {x["conv_id"]: x for x in chat.read_chats(made).collect()}
    blocks = {x["conv_id"]: x["n_blocks"] for x in made.collect()}
    for c in {x[0] for x in rows}:
        turns = [(a, b or "", d or "") for _, a, b, d in sorted(((x[0] or 0, -1 if x[1] is None else x[1], x[2] or "", x[3] or "") for x in rows if x[0] == c))]
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(b, d) for _, b, d in turns]
        assert got[c]["loss_text"] == "".join(d for _, b, d in turns if b == "assistant")
        assert blocks[c] == 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:]))
        assert got[c]["formatted"].count("<|turn|>") == blocks[c]


def test_plan_is_native(spark):
    plan = QUERIES["op10_chat_formatting"](spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_query_has_the_fixed_conversation(spark):
    got = QUERIES["op10_chat_formatting"](spark, SF).filter("conv_id = -1").collect()[0]
    text = "</s>[INST] ok [/INST]"
    assert (got["n_turns"], got["loss_chars"], got["loss_sha256"]) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", 5)], SCHEMA + ", formatted int")
    assert chat.format_chats(df).columns == ["conv_id", "n_turns", "n_blocks", "formatted", "loss"]
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


def test_a_long_conversation_and_running_totals(spark):
    """8,000 turns in one conversation, most of them of the role before: places of the loss mask are those of a plain loop."""
    rows = [(7, i, ("user", "assistant", "assistant", "tool")[i * i % 7 % 4], "<" * (i % 5) + "é" * (i % 3) + str(i)) for i in range(8000)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    read = chat.read_chats(out).collect()[0]
    assert [(t["role"], t["text"]) for t in read["turns"]] == [(r, x) for _, _, r, x in rows]
    assert read["loss_text"] == "".join(x for _, _, r, x in rows if r == "assistant")
    f = out.collect()[0]
    assert [f["formatted"][s["start"] : s["start"] + s["length"]].replace("<~", "<") for s in f["loss"]] == [x for _, _, r, x in rows if r == "assistant"]
    for n in (0, 1, 2, 3, 4, 5, 10, 17):
        got = spark.range(1).select(chat.running_totals(F.array(*[F.lit(k * k) for k in range(n)]).cast("array<bigint>")).alias("t")).first()["t"]
        assert got == [sum(k * k for k in range(i + 1)) for i in range(n)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange") == 1 and "Window" not in plan and "Python" not in plan
