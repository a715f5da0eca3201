"""Chat formatting with Spark expressions only.

Template: the turns of a conversation are sorted, adjacent turns of one role
share a header, and each turn's text keeps an end mark of its own, so that the
formatted string can be read back turn by turn:

    <|role:user|>text<|end|>text<|end|><|role:assistant|>text<|end|>

Texts and roles are escaped (& to &0, < to &1, > to &2, | to &3, [ to &4,
] to &5), so that neither the template's marks nor other chat formats'
control strings can come from a text. The loss mask is a run-length list over
the formatted string: each run has a length in characters and a flag that is
true on the escaped assistant texts alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template, in the order of escaping; reading back undoes them in reverse.
ESCAPES = (("&", "&0"), ("<", "&1"), (">", "&2"), ("|", "&3"), ("[", "&4"), ("]", "&5"))
ROLE, CLOSE, END = "<|role:", "|>", "<|end|>"
#: A zero-width cut before and after each mark; marks are the only places with <| or |>.
CUTS = r"(?<=\|>)|(?=<\|)"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_chats(turns: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, formatted, loss_runs (array of struct(len, loss)).

    Defined cases: turns sort by (turn, role, text), nulls first, and repeated
    rows stay; a null text or role is empty; a null conv_id is a conversation of
    its own; an empty table gives an empty result. Other columns are ignored.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # Merge adjacent turns of one role: the places where the role changes, then the slices between them.
    changes = F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 OR turns[i].role <> turns[i - 1].role)")
    chats = chats.withColumn("starts", changes)
    until = "if(k + 1 < size(starts), starts[k + 1], size(turns))"
    merged = F.expr(f"transform(starts, (s, k) -> struct(turns[s].role AS role, slice(turns, s + 1, {until} - s) AS turns))")
    chats = chats.withColumn("merged", merged)

    def run(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def runs(group: Column) -> Column:
        learned = group["role"] == F.lit(LEARNED)
        header = run(F.concat(F.lit(ROLE), escape(group["role"]), F.lit(CLOSE)), F.lit(False))
        bodies = F.transform(group["turns"], lambda t: F.array(run(escape(t["text"]), learned), run(F.lit(END), F.lit(False))))
        return F.concat(F.array(header), F.flatten(bodies))

    chats = chats.withColumn("runs", F.flatten(F.transform("merged", runs)))
    formatted = F.array_join(F.transform("runs", lambda r: r["text"]), "")
    mask = F.transform("runs", lambda r: F.struct(F.length(r["text"]).alias("len"), r["loss"].alias("loss")))
    return chats.select("conv_id", formatted.alias("formatted"), mask.alias("loss_runs"))


def read_back(chats: DataFrame) -> DataFrame:
    """From conv_id, formatted and loss_runs alone: conv_id, turns (array of struct(role, text)), loss_texts, formatted."""
    pieces = F.filter(F.split("formatted", CUTS), lambda p: p != F.lit(""))
    filled = F.filter("loss_runs", lambda r: r["len"] > 0)
    chats = chats.withColumns({"pieces": pieces, "filled": filled})
    # The mask's filled runs are the pieces between marks, one by one.
    lost = F.filter(F.arrays_zip(F.col("pieces").alias("p"), F.col("filled").alias("m")), lambda z: z["m"]["loss"])
    loss_texts = F.transform(lost, lambda z: unescape(z["p"]))
    chats = chats.withColumn("loss_texts", loss_texts)
    # A turn ends at each end mark; its text is the piece before it, if that isn't a mark; its role is the nearest header's.
    groups = F.filter(F.split("formatted", r"(?=<\|role:)"), lambda g: g != F.lit(""))

    def turns_of(group: Column) -> Column:
        role = unescape(F.regexp_extract(group, r"^<\|role:([^|]*)\|>", 1))
        body = F.regexp_replace(group, r"^<\|role:[^|]*\|>", "")
        parts = F.split(body, r"<\|end\|>")
        texts = F.slice(parts, F.lit(1), F.size(parts) - 1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return chats.select("conv_id", F.flatten(F.transform(groups, turns_of)).alias("turns"), "loss_texts", "formatted")


def digests(back: DataFrame) -> DataFrame:
    """What the query returns of ``read_back``."""
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
