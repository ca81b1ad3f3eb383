"""Chat formatting with relational expressions only.

The turns of a conversation are collected as structs, sorted by turn, adjacent turns of one role are
merged, and the template is concatenated. Control strings inside texts are escaped: between the opening
bracket of a control string and what follows, one backslash is added. A text that already holds such an
escaped form gets one more backslash, so taking one away again restores every text.

Template: system <<SYS>>...<</SYS>>, user [INST]...[/INST], assistant <s>...</s>; any other role is
[ROLE]name<sep>...[/ROLE]. Texts of merged turns stand in one block with <sep> between them.

Defined results: a null text counts as empty, a null role as an empty other role; ties in the turn
number are ordered by role, then text; repeated rows are turns like any other; a null conv_id is a
conversation of its own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opening and closing control strings by role.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]")
SEP = "<sep>"

_TAIL = r"(/?(?:s>|INST\]|<SYS>>|</SYS>>|ROLE\])|sep>)"
_ESCAPE = r"([<\[])(\\*)" + _TAIL
_UNESCAPE = r"([<\[])\\(\\*)" + _TAIL
_BLOCK = r"(?s)(?:<<SYS>>.*?<</SYS>>|\[INST\].*?\[/INST\]|<s>.*?</s>|\[ROLE\].*?\[/ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPE), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNESCAPE), F.lit("$1$2$3"))


def _mark(role: Column, which: int) -> Column:
    out = F.lit(OTHER[which])
    for name, marks in MARKS.items():
        out = F.when(role == name, F.lit(marks[which])).otherwise(out)
    return out


def format_chat(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation: conv_id, formatted, and segments: the pieces of formatted in order, each with its loss flag.

    Loss lies on the text of assistant turns only."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # ties are in the order of the texts themselves, so escaping comes after sorting
    sorted_ = sorted_.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text"))).alias("turns"))
    # first turn of each block of equal roles, and the first turn after it
    starts = sorted_.withColumn(
        "starts",
        F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"])),
    )
    blocks = starts.withColumn(
        "blocks",
        F.transform(
            "starts",
            lambda s, k: F.struct(
                F.element_at("turns", s)["role"].alias("role"),
                F.slice("turns", s, F.coalesce(F.get("starts", k + 1), F.size("turns") + 1) - s)["text"].alias("texts"),
            ),
        ),
    )

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def pieces(b: Column) -> Column:
        known = b["role"].isin(*MARKS)
        no = F.lit(False)
        opening = F.concat(_mark(b["role"], 0), F.when(known, F.lit("")).otherwise(F.concat(escape(b["role"]), F.lit(SEP))))
        texts = F.flatten(F.transform(b["texts"], lambda t, j: F.array(piece(F.when(j == 0, F.lit("")).otherwise(F.lit(SEP)), no), piece(t, b["role"] == "assistant"))))
        return F.concat(F.array(piece(opening, no)), texts, F.array(piece(_mark(b["role"], 1), no)))

    segments = F.filter(F.flatten(F.transform("blocks", pieces)), lambda x: (x["text"] != "") | x["loss"])
    out = blocks.select("conv_id", segments.alias("segments"))
    return out.select("conv_id", F.array_join(F.col("segments")["text"], "").alias("formatted"), "segments")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text, one for each original row) and loss_text, parsed from format_chat's output."""

    def turns(block: Column) -> Column:
        role = F.lit(None).cast("string")
        for name, (opening, _) in MARKS.items():
            role = F.when(block.startswith(opening), F.lit(name)).otherwise(role)
        # markers have one length for each role
        n_open = F.when(role == "system", F.lit(7)).when(role == "assistant", F.lit(3)).otherwise(F.lit(6))
        n_close = F.when(role == "system", F.lit(8)).when(role == "assistant", F.lit(4)).otherwise(F.lit(7))
        parts = F.split(F.substring(block, n_open + 1, F.length(block) - n_open - n_close), SEP, -1)
        name = F.coalesce(role, unescape(F.element_at(parts, 1)))
        texts = F.when(role.isNull(), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
        return F.transform(texts, lambda t: F.struct(name.alias("role"), unescape(t).alias("text")))

    blocks = F.regexp_extract_all("formatted", F.lit(_BLOCK), F.lit(0))
    loss = F.filter("segments", lambda x: x["loss"])
    return formatted.select(
        "conv_id",
        "formatted",
        F.flatten(F.transform(blocks, turns)).alias("turns"),
        F.array_join(F.transform(loss, lambda x: unescape(x["text"])), "").alias("loss_text"),
    )


def format_report(rows: DataFrame) -> DataFrame:
    """The digest columns of a formatted table, read back from the formatted output."""
    back = read_back(format_chat(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(rows: DataFrame) -> DataFrame:
    """The table and conversation -7, whose texts hold the template's own control strings."""
    probe = rows.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)((/?(?:s>|INST\]|<SYS>>|</SYS>>|ROLE\])|sep>))', '\1\\\2\3', 'g') AS safe,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(safe) + CASE WHEN before IS NULL OR before <> role THEN
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 18 + length(role) END ELSE 5 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
