"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is rendered as ``### role: text</turn>`` and a line break. The parser is
deterministic: it cuts the rendered text at every ``</turn>``, drops the line
break that follows, reads the mark and then the role up to the first ``": "``.

Each turn is first rendered as it is and parsed again. Where the recovered turn
differs from the source (its text holds ``</turn>``, its role holds ``": "``),
the turn is rendered again with the mark ``#&#`` and with ``& < # :`` written as
entities, which leaves nothing that the parser could take for control text. The
whole conversation is then parsed once more, and any difference is an error.

Defined cases: a null role or text is empty; turns follow ``turn`` (nulls
first), then role and text; repeated rows stay repeated turns; rows with a null
conversation id form one conversation; an empty table gives an empty result;
columns that are not named as arguments are ignored, whatever their names. A
conversation is one value and so has to fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PLAIN, ESCAPED, SEP, END = "### ", "#&# ", ": ", "</turn>"
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("#", "&num;"), (":", "&col;"))


def escape(text: Column) -> Column:
    for raw, entity in ENTITIES:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for raw, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def render(mark: str, role: Column, text: Column) -> Column:
    return F.concat(F.lit(mark), role, F.lit(SEP), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """The turns of a rendered text, as an array of (role, text)."""
    whole = F.lit(2**31 - 1)

    def turn(part: Column, i: Column) -> Column:
        line = F.when(i == 0, part).otherwise(F.substr(part, F.lit(2), whole))
        body = F.substr(line, F.lit(len(PLAIN) + 1), whole)
        role = F.substring_index(body, SEP, 1)
        text = F.substr(body, F.length(role) + len(SEP) + 1, whole)
        escaped = F.startswith(line, F.lit(ESCAPED))
        return F.struct(
            F.when(escaped, unescape(role)).otherwise(role).alias("role"),
            F.when(escaped, unescape(text)).otherwise(text).alias("text"),
        )

    parts = F.split(formatted, END, -1)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant"
) -> DataFrame:
    """One row a conversation: ``conv_id``, ``formatted``, ``loss_spans``, ``n_turns``, ``n_escaped``.

    ``loss_spans`` holds start (from 0) and length, in code points of
    ``formatted``, of the texts whose role is ``learn``, and whether they stand
    there ``escaped``.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    plain = render(PLAIN, F.col("role"), F.col("text"))
    same = parse(plain) == F.array(F.struct("role", "text"))
    rows = rows.withColumn("plain", same).withColumn(
        "piece",
        F.when(F.col("plain"), plain).otherwise(render(ESCAPED, escape(F.col("role")), escape(F.col("text")))),
    )
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("piece")
    shown = F.when(F.col("plain"), F.col("text")).otherwise(escape(F.col("text")))
    rows = rows.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0))).withColumn("chars", F.length(shown).cast("long"))
    start = F.col("at") + size - F.length(F.lit(END + "\n")) - F.col("chars")
    cells = F.struct(F.col("at"), F.col("role"), F.col("text"), F.col("piece"), F.col("plain"), start.alias("start"), F.col("chars"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(cells)).alias("t"))
    convs = convs.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(
            F.filter("t", lambda x: x["role"] == learn),
            lambda x: F.struct(x["start"].alias("start"), x["chars"].alias("length"), (~x["plain"]).alias("escaped")),
        ).alias("loss_spans"),
        F.size("t").cast("long").alias("n_turns"),
        F.size(F.filter("t", lambda x: ~x["plain"])).cast("long").alias("n_escaped"),
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
    )
    checked = F.when(parse(F.col("formatted")) == F.col("source"), F.col("formatted")).otherwise(
        F.raise_error(F.lit("a conversation can't be read back from its rendered text")).cast("string")
    )
    return convs.select("conv_id", checked.alias("formatted"), "loss_spans", "n_turns", "n_escaped")


def learnt_texts() -> Column:
    """The source texts under the loss mask: ``formatted`` cut at ``loss_spans``, cuts out of escaped turns unescaped."""

    def cut(span: Column) -> Column:
        piece = F.substr("formatted", (span["start"] + 1).cast("int"), span["length"].cast("int"))
        return F.when(span["escaped"], unescape(piece)).otherwise(piece)

    return F.transform("loss_spans", cut)


def chat_digests(chats: DataFrame) -> DataFrame:
    """What the rendered texts hold: turns read back by the parser, learnt texts cut out by the loss mask."""
    learnt = F.array_join(learnt_texts(), "")
    whole = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return chats.withColumn("back", parse(F.col("formatted"))).withColumn("learnt", learnt).select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
