"""Chat formatting: conversations to one training string each, by relational operations only.

Turns of a conversation are collected as structs and sorted by (turn, role, text); adjacent turns of one
role become one block by array aggregation; texts and roles are escaped, so no text can forge a control
string, and the output can be read back exactly.

Template: `<|im_start|>role\\ntext<|im_next|>text...<|im_end|>\\n`. In texts and roles `\\` becomes `\\\\` and
`<|` becomes `<\\|`; a line feed within a role becomes `<|nl|>`.

Odd input: a null text or role is empty; a null turn sorts first; repeated rows are kept each time; rows of
a null conv_id form one conversation; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END, BREAK = "<|im_start|>", "<|im_next|>", "<|im_end|>\n", "<|nl|>"
LEARNT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, and loss_runs: code points of header and text by turns, and whether they are learnt.

    loss_runs cover formatted from its start, one header and one text per turn; what is left is the footer.
    """
    rows = turns.select(
        F.col(f"`{conv_id}`").alias("conv_id"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"),
            F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    before = lambda i: F.get(F.col("turns"), i - 1).getField("role")
    head = lambda t, i: (
        F.when(i == 0, F.concat(F.lit(START), escape_role(t.getField("role")), F.lit("\n")))
        .when(before(i) == t.getField("role"), F.lit(NEXT))
        .otherwise(F.concat(F.lit(END + START), escape_role(t.getField("role")), F.lit("\n")))
    )
    parts = chats.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t, i: F.struct(head(t, i).alias("head"), escape(t.getField("text")).alias("body"), (t.getField("role") == LEARNT).alias("loss")),
        ).alias("parts"),
    )
    run = lambda text, loss: F.struct(F.length(text).alias("chars"), loss.alias("loss"))
    return parts.select(
        "conv_id",
        F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p.getField("head"), p.getField("body"))), ""), F.lit(END)).alias("formatted"),
        F.flatten(F.transform("parts", lambda p: F.array(run(p.getField("head"), F.lit(False)), run(p.getField("body"), p.getField("loss"))))).alias("loss_runs"),
    )


#: What stands between two texts: the end of a block and the next header, or a merged turn's mark.
_HEADER = r"(?:<\|im_end\|>\n)?<\|im_start\|>[^\n]*\n|<\|im_next\|>"


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted_chars, turns (role, text) and learnt (texts under the mask), unescaped from format_chats() output."""
    cut = formatted.select(
        "conv_id",
        "loss_runs",
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.regexp_extract_all("formatted", F.lit(_HEADER), F.lit(0)).alias("heads"),
        F.split(F.expr(f"substr(formatted, 1, length(formatted) - {len(END)})"), _HEADER).alias("bodies"),
    )
    # A merged turn has the role of the last header before it: blocks begin at the headers that name a role.
    named = cut.withColumn("starts", F.filter(F.transform("heads", lambda h, i: F.when(h != NEXT, i)), lambda i: i.isNotNull()))
    role = lambda h: unescape_role(F.regexp_extract(h, r"<\|im_start\|>([^\n]*)\n$", 1))
    size = lambda k, s: F.coalesce(F.get(F.col("starts"), k + 1), F.size("heads")) - s
    roles = named.withColumn("roles", F.flatten(F.transform("starts", lambda s, k: F.array_repeat(role(F.get(F.col("heads"), s)), size(k, s)))))
    turns = roles.withColumn("turns", F.transform("roles", lambda r, i: F.struct(r.alias("role"), unescape(F.get(F.col("bodies"), i + 1)).alias("text"))))
    # What is learnt is cut from the output by the mask: a header and a text at a time, whose lengths must be the mask's.
    part = lambda i: F.concat(F.get(F.col("heads"), i), F.get(F.col("bodies"), i + 1))
    run = lambda k: F.get(F.col("loss_runs"), k)
    cut = F.transform("heads", lambda h, i: F.struct(part(i).alias("text"), run(2 * i).alias("head"), run(2 * i + 1).alias("body")))
    agrees = F.forall(cut, lambda c: F.length(c["text"]) == c["head"]["chars"] + c["body"]["chars"]) & (2 * F.size("heads") == F.size("loss_runs"))
    masked = F.transform(F.filter(cut, lambda c: c["body"]["loss"]), lambda c: unescape(F.substr(c["text"], c["head"]["chars"] + 1, c["body"]["chars"])))
    learnt = F.when(agrees, masked).otherwise(F.raise_error(F.lit("the mask doesn't fit the output")).cast("array<string>"))
    return turns.select("conv_id", "formatted_chars", "turns", learnt.alias("learnt"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from the output."""
    line = lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n"))
    back = read_back(formatted).select(
        "conv_id",
        "formatted_chars",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.array_join("learnt", "").alias("loss_text"),
    )
    return back.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
