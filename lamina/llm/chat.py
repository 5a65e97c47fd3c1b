"""Relational chat formatting: Spark expressions only.

The turns of a conversation are collected as an array of structs and sorted; it becomes one string of message blocks,
`<|turn|>role<|text|>body<|end|>`.  Adjacent turns of one role share a block; their bodies are joined by `<|more|>`, so
that the turns can still be told apart.  The loss mask's places come from array aggregation.  Every "<"
in a role or a text is written as "<~", so no marker can occur inside a text and one replacement undoes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.replace(c, F.lit("<"), F.lit("<~"))


def unescape(c: Column) -> Column:
    return F.replace(c, F.lit("<~"), F.lit("<"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it occurs, inside of further lambdas too."""
    return F.transform(F.array(value), use)[0]


def _slices(array: Column, use: Callable[[Column], Column]) -> Column:
    """use of each run of about the square root of the array's items; none for an empty array."""
    size = F.ceil(F.sqrt(F.size(array))).cast("int")
    return let(F.greatest(size, F.lit(1)), lambda m: F.transform(F.filter(F.sequence(F.lit(0), F.size(array), m), lambda at: at < F.size(array)), lambda at: use(F.slice(array, at + 1, m))))


def _running(array: Column, start: Column) -> Column:
    """Running totals of an array of longs, from start."""
    first = F.struct(start.alias("upto"), F.array().cast("array<bigint>").alias("all"))
    return F.aggregate(array, first, lambda s, x: F.struct((s["upto"] + x).alias("upto"), F.concat(s["all"], F.array(s["upto"] + x)).alias("all")), lambda s: s["all"])


def running_totals(array: Column) -> Column:
    """Running totals of an array of longs.  Arrays grow by an item at a time only within slices, which keeps the work at n ** 1.5."""
    zero = F.lit(0).cast("bigint")
    parts = lambda a: _slices(a, lambda part: F.struct(part.alias("part"), F.aggregate(part, zero, lambda s, x: s + x).alias("sum")))
    return let(array, lambda a: let(parts(a), lambda p: let(_running(F.transform(p, lambda x: x["sum"]), zero), lambda upto: F.flatten(F.zip_with(p, upto, lambda x, end: _running(x["part"], end - x["sum"]))))))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv, n_turns, n_blocks, formatted, loss (array of start, length in code points of formatted).

    Turns are ordered by turn (nulls first), then role, then text; so repeated rows stay, in a fixed order.  A null
    role or text counts as empty; a null conversation id is a conversation of its own.  Other columns are dropped,
    whatever their names.  An empty table gives an empty table.  The loss covers the escaped texts of loss_roles.
    All turns of a conversation meet in one task, as its output is one string; so its texts have to fit a worker, and
    2 GB together.  The conversations are shuffled once.
    """
    t = df.select(F.col(f"`{conv}`").alias("c"), F.struct(F.col(f"`{turn}`").alias("t"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("r"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("x")).alias("row"))

    def pieces(turns: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before, header = F.get(turns, i - 1)["r"], F.concat(F.lit(TURN), escape(x["r"]), F.lit(TEXT))
            opens = before.isNull() | (before != x["r"])
            head = F.when(before.isNull(), header).when(opens, F.concat(F.lit(END), header)).otherwise(F.lit(MORE))
            return let(escape(x["x"]), lambda body: F.struct(opens.alias("opens"), F.concat(head, body).alias("piece"), F.length(body).cast("bigint").alias("size"), x["r"].isin(*loss_roles).alias("learn")))

        return F.transform(turns, piece)

    def output(p: Column) -> Column:
        ends = running_totals(F.transform(p, lambda x: F.length(x["piece"]).cast("bigint")))
        spans = F.filter(F.zip_with(p, ends, lambda x, end: F.struct((end - x["size"]).alias("start"), x["size"].alias("length"), x["learn"].alias("learn"))), lambda s: s["learn"])
        return F.struct(
            F.size(p).cast("long").alias("n_turns"),
            F.size(F.filter(p, lambda x: x["opens"])).cast("long").alias("n_blocks"),
            F.concat(F.array_join(F.transform(p, lambda x: x["piece"]), ""), F.lit(END)).alias("formatted"),
            F.transform(spans, lambda s: F.struct(s["start"], s["length"])).alias("loss"),
        )

    g = t.groupBy("c").agg(F.collect_list("row").alias("rows"))
    return g.select(F.col("c").alias(conv), let(F.sort_array("rows"), lambda turns: let(pieces(turns), output)).alias("out")).select(F.col(f"`{conv}`"), "out.*")


def read_chats(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Reads what format_chats made: conv, turns (array of role, text), loss_text, formatted; as written, with no null."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>"), lambda b: b != F.lit(""))

    def turns(block: Column) -> Column:
        sides = F.split(F.replace(block, F.lit(TURN), F.lit("")), r"<\|text\|>")
        return F.transform(F.split(sides[1], r"<\|more\|>"), lambda x: F.struct(unescape(sides[0]).alias("role"), unescape(x).alias("text")))

    def cut(text: Column, start: Column, length: Column) -> Column:
        return text.substr((start + 1).cast("int"), length.cast("int"))

    def under(spans: Column) -> Column:
        """The text under a few spans: cut first as a whole, as each cut walks through all text before it."""
        first, last = spans[0]["start"], F.element_at(spans, -1)
        whole = cut(F.col("formatted"), first, last["start"] + last["length"] - first)
        return let(whole, lambda part: F.array_join(F.transform(spans, lambda s: cut(part, s["start"] - first, s["length"])), ""))

    loss = unescape(F.array_join(_slices(F.col("loss"), lambda spans: let(spans, under)), ""))
    return formatted.select(F.col(f"`{conv}`"), F.flatten(F.transform(blocks, turns)).alias("turns"), loss.alias("loss_text"), "formatted")
