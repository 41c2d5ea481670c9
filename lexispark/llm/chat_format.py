"""Chat formatting: relational and JVM-side throughout.

A conversation's rows are collected as structs, sorted by turn, merged where
neighbours have the same role, and concatenated with Spark expressions.

The template, per run of same-role rows:

    ### <role>:
    <row's text>
    <next/>
    <next row's text>
    </turn>

Control strings inside a text get one backslash more than they had, so none is
left bare in it; the template's own follow a newline or nothing, never a backslash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running

#: Fixed values of the template.
HEAD, CLOSE, NEXT = "### ", "</turn>", "<next/>"
_CONTROL = "(### |</turn>|<next/>)"
_TURN_END, _ROW_END = f"\n{CLOSE}\n", f"\n{NEXT}\n"


def escape(text: Column) -> Column:
    """Each control string, with any backslashes before it, gets one more backslash in front."""
    return F.regexp_replace(text, r"(\\*)" + _CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    """Undoes escape()."""
    return F.regexp_replace(text, r"\\(\\*)" + _CONTROL, "$1$2")


def _escape_role(role: Column) -> Column:
    for raw, code in (("%", "%25"), ("\n", "%0A"), (":", "%3A")):
        role = F.replace(role, F.lit(raw), F.lit(code))
    return role


def _unescape_role(role: Column) -> Column:
    for raw, code in ((":", "%3A"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(raw))
    return role


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv, formatted, loss_spans.

    loss_spans are [start, end) in code points of `formatted`, one for each row of
    the trained role, over its escaped text. Null text or role: empty. A null turn
    sorts first, and ties sort by role, then text. Rows with a null conversation form
    one conversation. Repeated rows stay, texts may be of any length, and an empty table gives an empty result. Other columns are ignored, whatever their names.
    A conversation is one row, so its turns must fit in a task.
    """
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).alias("row"),
    )
    sorted_rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    shielded = sorted_rows.select("conv_id", F.transform("rows", lambda r: F.struct(_escape_role(r["role"]).alias("role"), escape(r["text"]).alias("text"))).alias("rows"))
    # Runs of one role: a row opens a run where the row before has another role.
    opened = F.transform(
        "rows",
        lambda r, i: F.struct(
            F.when((i == 0) | (F.try_element_at("rows", F.greatest(i, F.lit(1)))["role"] != r["role"]), F.lit(True)).otherwise(F.lit(False)).alias("opens"),
            r["role"].alias("role"),
            r["text"].alias("text"),
        ),
    )
    n = F.size("marked")
    pieces = F.transform(
        "marked",
        lambda r, i: F.struct(
            F.when(r["opens"], F.concat(F.when(i > 0, F.lit(_TURN_END)).otherwise(F.lit("")), F.lit(HEAD), r["role"], F.lit(":\n"))).otherwise(F.lit(_ROW_END)).alias("before"),
            r["text"].alias("text"),
            F.when(i == n - 1, F.lit(_TURN_END)).otherwise(F.lit("")).alias("after"),
            r["role"].alias("role"),
        ),
    )
    built = shielded.select("conv_id", opened.alias("marked")).select("conv_id", pieces.alias("pieces"))
    before = running(F.transform("pieces", lambda p: F.length(p["before"]) + F.length(p["text"]) + F.length(p["after"])))
    placed = F.zip_with("pieces", before, lambda p, at: F.struct((at + F.length(p["before"])).cast("long").alias("start"), (at + F.length(p["before"]) + F.length(p["text"])).cast("long").alias("end"), p["role"].alias("role")))
    spans = F.transform(F.filter(placed, lambda s: s["role"] == F.lit(trained)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return built.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def parse_formatted(formatted: Column) -> Column:
    """The rows of a formatted conversation: array<struct<role, text>>, unescaped."""
    blocks = F.filter(F.split(formatted, _TURN_END, -1), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.regexp_replace(b, r"^### [^\n]*:\n", ""), _ROW_END, -1),
                lambda t: F.struct(_unescape_role(F.regexp_extract(b, r"^### ([^\n]*):\n", 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
