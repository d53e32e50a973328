"""Chat formatting by a grammar round trip, in DataFrame functions only.

A turn is written as <|im_start|>role, a line feed, text, <|im_end|> and a line
feed. What is written is parsed again by a deterministic grammar and compared
with its source; a turn that doesn't come back is escaped. In texts a sequence
`<`, backslashes, `|` gets one backslash more; roles have `%`, `<` and line feeds
percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _quoted(x: str) -> str:
    return x.replace("|", "\\|")


def escape_text(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\|", r"<\\$1|")


def unescape_text(x: Column) -> Column:
    return F.regexp_replace(x, r"<\\(\\*)\|", "<$1|")


def escape_role(x: Column) -> Column:
    for plain, coded in (("%", "%25"), ("<", "%3C"), ("\n", "%0A")):
        x = F.replace(x, F.lit(plain), F.lit(coded))
    return x


def unescape_role(x: Column) -> Column:
    for plain, coded in (("\n", "%0A"), ("<", "%3C"), ("%", "%25")):
        x = F.replace(x, F.lit(coded), F.lit(plain))
    return x


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of formatted text, or null where it isn't of the grammar.

    Each turn starts at a start mark, its role ends at the first line feed, its
    text at the first end mark, and nothing but a line feed stands behind that;
    neither holds `<|`.
    """
    chunks = F.split(formatted, _quoted(START))

    def turn(chunk: Column) -> Column:
        body = F.substring_index(chunk, END, 1)
        role = F.substring_index(body, "\n", 1)
        text = F.substr(body, F.length(role) + 2)
        ok = (chunk == F.concat(body, F.lit(END + "\n"))) & (F.instr(body, "\n") > 0) & (F.instr(body, "<|") == 0)
        return F.when(ok, F.struct(unescape_role(role).alias("role"), unescape_text(text).alias("text")))

    turns = F.transform(F.slice(chunks, 2, F.greatest(F.size(chunks) - 1, F.lit(0))), turn)
    return F.when((F.element_at(chunks, 1) == "") & ~F.exists(turns, lambda t: t.isNull()), turns)


def format_conversations(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rows conv_id, formatted, loss_spans, turns, identical, one for each conversation.

    loss_spans are the code point offsets (start, end) of the texts of trained
    roles in formatted, in order; empty texts have none. turns are what the
    parser reads back, and identical tells whether that equals the source, which
    holds by the choice of what is escaped.

    Null roles and texts count as empty. Rows of one conversation go by turn,
    then role, then text, nulls first; repeated turns all stay. A null id is one
    conversation. Other columns are ignored, whatever their names. No rows give
    none. A conversation's text is one value, so its rows meet in one task.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    plain = render(F.col("role"), F.col("text"))
    back = F.array(F.struct("role", "text"))
    comes_back = F.coalesce(parse(plain) == back, F.lit(False))
    lines = turns.withColumn("escaped", ~comes_back)
    lines = lines.withColumns({"out_role": F.when(F.col("escaped"), escape_role(F.col("role"))).otherwise(F.col("role")), "out_text": F.when(F.col("escaped"), escape_text(F.col("text"))).otherwise(F.col("text"))})
    lines = lines.withColumn("line", render(F.col("out_role"), F.col("out_text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    lines = lines.withColumns({"at": F.row_number().over(order), "line_end": F.sum(F.length("line").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    end = F.col("line_end") - len(END) - 1
    span = F.when(F.col("role").isin(*trained) & (F.length("out_text") > 0), F.struct((end - F.length("out_text")).alias("start"), end.alias("end")))
    whole = lines.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "line", span.alias("span"), "role", "text"))).alias("all"))
    spans = F.transform(F.filter("all", lambda x: x["span"].isNotNull()), lambda x: x["span"])
    made = whole.select("conv_id", F.array_join(F.transform("all", lambda x: x["line"]), "").alias("formatted"), spans.alias("loss_spans"), F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"))
    made = made.withColumn("turns", parse(F.col("formatted")))
    return made.select("conv_id", "formatted", "loss_spans", "turns", F.coalesce(F.col("turns") == F.col("source"), F.lit(False)).alias("identical"))
