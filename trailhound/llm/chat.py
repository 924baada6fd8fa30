"""Chat formatting whose text can be read back: DataFrame functions only.

    <s>[INST] role [/INST]\\n body </s>\\n        (without the blanks around the body)

The parser cuts at the end mark, takes the role up to the first role mark and the rest as
body, accepts neither if a control string stands in it, and drops escapes. A turn is first
written as it is and parsed again; if that does not give the one turn that went in, control
strings in it are escaped by a backslash behind their first character; if that fails too,
backslashes are doubled as well. The last form is
always read back rightly: no control string is left in it, and a run of backslashes is either
doubled or a single one that the writer put in.

A turn keeps a loss mask as run lengths over its formatted text: head (no loss), body (loss
for the assistant's), tail (no loss). Read in order the runs cover a conversation's output.

Cases: a null text or role is empty; a null conv_id is a conversation; rows of equal turn
stand in order of role and text, null turns first; repeated rows are turns of their own. A
conversation's output is one string, so one conversation must fit into a task (2 GB at most).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ASSISTANT = "assistant"
OPEN, ROLE_END, END = "<s>[INST] ", " [/INST]\n", "</s>\n"
#: Where an escape goes: behind the first character of a control string.
_INSIDE_CONTROL = r"(?<=<)(?=/?s>)|(?<=\[)(?=/?INST\])"
_CONTROL = r"</?s>|\[/?INST\]"
_ESCAPED = r"\\(\\?)"


def _escape_controls(text: Column) -> Column:
    return F.regexp_replace(text, _INSIDE_CONTROL, r"\\")


def _escape_all(text: Column) -> Column:
    return _escape_controls(F.replace(text, F.lit("\\"), F.lit("\\\\")))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def _turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(ROLE_END), body, F.lit(END))


def parse(output: Column) -> Column:
    """array of (role, text, head, body): the turns of an output, and the lengths of their
    first two runs. What does not follow the grammar gives a null role."""
    def turn(piece: Column) -> Column:
        cut = F.locate(ROLE_END, piece)
        head = cut + len(ROLE_END) - 1
        role = piece.substr(F.lit(len(OPEN) + 1), cut - 1 - len(OPEN))
        body = piece.substr(head + 1, F.length(piece))
        well = piece.startswith(OPEN) & (cut > 0) & ~F.concat_ws("\n", role, body).rlike(_CONTROL)
        return F.struct(
            F.when(well, unescape(role)).alias("role"), unescape(body).alias("text"),
            head.alias("head"), F.length(body).alias("body"), body.alias("raw"),
        )

    pieces = F.split(output, F.lit(END), -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def render_turns(rows: DataFrame) -> DataFrame:
    """The rows with `output`, the turn as text, and `level`, how much was escaped (0 to 2)."""
    role, text = F.col("role"), F.col("text")
    forms = [_turn(role, text), _turn(_escape_controls(role), _escape_controls(text)), _turn(_escape_all(role), _escape_all(text))]

    def identical(output: Column) -> Column:
        back = parse(output)
        return (F.size(back) == 1) & F.coalesce((back[0]["role"] == role) & (back[0]["text"] == text), F.lit(False))

    # Only a text with a control character can be read back wrongly, so only such are parsed.
    simple = ~F.concat(role, text).rlike(r"[<\[\\\]>]")
    tried = F.when(simple | identical(forms[0]), 0).when(identical(forms[1]), 1).otherwise(2)
    chosen = F.when(F.col("level") == 0, forms[0]).when(F.col("level") == 1, forms[1]).otherwise(forms[2])
    return rows.withColumn("level", tried).withColumn("output", chosen)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, output (the formatted text), n_turns, levels (largest escape level)."""
    clean = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = render_turns(clean).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "output"))).alias("turns"),
        F.max("level").alias("level"),
    )
    return turns.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["output"]), "").alias("output"),
        F.size("turns").cast("long").alias("n_turns"), "level",
    )


def loss_text(parsed: Column) -> Column:
    """The text under the loss mask of a parsed output, unescaped."""
    assistant = F.filter(parsed, lambda t: t["role"] == ASSISTANT)
    return F.array_join(F.transform(assistant, lambda t: t["text"]), "")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests taken from the formatted text alone."""
    parsed = formatted.select("conv_id", F.col("output"), parse(F.col("output")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        loss_text(F.col("turns")).alias("loss"), F.length("output").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def loss_runs(formatted: DataFrame) -> DataFrame:
    """conv_id and runs: (length, loss) over the output, in order, without gaps."""
    runs = F.flatten(F.transform(parse(F.col("output")), lambda t: F.array(
        F.struct(t["head"].alias("length"), F.lit(False).alias("loss")),
        F.struct(t["body"].alias("length"), (t["role"] == ASSISTANT).alias("loss")),
        F.struct(F.lit(len(END)).alias("length"), F.lit(False).alias("loss")),
    )))
    return formatted.select("conv_id", runs.alias("runs"))


#: DuckDB: what the query returns, from the rows and the lengths that escaping adds.
ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), counted AS (
  SELECT *, (length(text) - length(replace(text, '\', ''))) + (length(role) - length(replace(role, '\', ''))) AS slashes,
    len(regexp_extract_all(text, '<(/?)s>')) + len(regexp_extract_all(text, '\[(/?)INST\]'))
    + len(regexp_extract_all(role, '<(/?)s>')) + len(regexp_extract_all(role, '\[(/?)INST\]')) AS marks
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + length(text) + slashes + marks)::BIGINT AS formatted_chars
FROM counted GROUP BY conv_id
"""
