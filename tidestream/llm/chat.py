"""Chat formatting with Spark expressions only.

A message is START role TEXT text END; adjacent turns of one role are one message, their texts parted by NEXT. All
control strings begin with `<|`. In roles and texts a `<`, then any backslashes, then `|` gets one backslash more
before the `|`, so that no `<|` is left in them and the step can be undone exactly.

A conversation's turns are collected and sorted as structs; all the rest is array work of its one row, in steps that
each take time in proportion to its turns (a logarithm more for the places of the texts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"
#: The role whose texts are trained on.
LEARNED = "assistant"


def escaped(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\|", r"<$1\\|")


def unescaped(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\\\|", r"<$1|")


def _running_totals(sizes: Column) -> Column:
    """The sums of the first, the first two, ... of an array: in step k each value takes up what stands 2^k places before it."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(sizes), F.lit(1)))).cast("int"))
    return F.aggregate(steps, sizes, lambda totals, k: F.transform(totals, lambda x, i: x + F.coalesce(F.get(totals, i - F.pow(F.lit(2), k).cast("int")), F.lit(0).cast("long"))))


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start and length, in code points of formatted, of each learned text).

    Turns are ordered by turn (null first), then role and text; null role or text: empty; repeated rows stay. Rows
    with a null conv_id are one conversation. A conversation is one row, so it must fit one."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # the places at which messages begin, then one struct for each message: its role and its adjacent turns' texts
    first = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    rows = rows.withColumn("first", first)
    texts = lambda i, n: F.transform(F.slice("turns", i + 1, n - i), lambda t: escaped(t["text"]))
    message = lambda i, k: F.struct(F.get("turns", i)["role"].alias("role"), texts(i, F.coalesce(F.get("first", k + 1), F.size("turns"))).alias("texts"))
    rows = rows.select("conv_id", F.transform("first", message).alias("messages"))
    head = lambda m: F.concat(F.lit(START), escaped(m["role"]), F.lit(TEXT))
    text = F.array_join(F.transform("messages", lambda m: F.concat(head(m), F.array_join(m["texts"], NEXT), F.lit(END))), "")
    # what stands before each text, and the text: a message's first follows its head and the END before that, the others NEXT
    gap = lambda m, k, j: F.when(j > 0, F.lit(len(NEXT))).otherwise(F.length(head(m)) + F.when(k > 0, F.lit(len(END))).otherwise(F.lit(0)))
    piece = lambda m, k: F.transform(m["texts"], lambda t, j: F.struct(gap(m, k, j).cast("long").alias("gap"), F.length(t).cast("long").alias("length"), (m["role"] == LEARNED).alias("learned")))
    rows = rows.select("conv_id", text.alias("formatted"), F.flatten(F.transform("messages", piece)).alias("pieces"))
    rows = rows.withColumn("ends", _running_totals(F.transform("pieces", lambda p: p["gap"] + p["length"])))
    spans = F.transform("pieces", lambda p, i: F.when(p["learned"], F.struct((F.get("ends", i) - p["length"]).alias("start"), p["length"].alias("length"))))
    return rows.select("conv_id", "formatted", F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role and text as they were), loss (texts under the mask) of formatted chats."""

    def message(m: Column) -> Column:
        parts = F.split(m, "<\\|text\\|>", 2)
        texts = F.split(F.regexp_replace(F.get(parts, 1), "<\\|end\\|>$", ""), "<\\|next\\|>", -1)
        return F.transform(texts, lambda t: F.struct(unescaped(F.get(parts, 0)).alias("role"), unescaped(t).alias("text")))

    messages = F.filter(F.split("formatted", "<\\|start\\|>", -1), lambda m: m != "")
    loss = F.transform("loss_spans", lambda s: unescaped(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.select("conv_id", F.flatten(F.transform(messages, message)).alias("turns"), F.array_join(loss, "").alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted text."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
