"""Chat formatting: turns in order through a declarative template, with a loss flag per text segment. Native throughout.

A finite-state machine over roles judges the order of turns. Each turn becomes three segments: the opening of its
role, its text, and the close. Control strings inside texts are broken up by a backslash, reversibly: no control string
is left in an escaped text, so a formatted conversation can be cut at its control strings and read back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.functions.regex import sql_text


@dataclass(frozen=True)
class ChatTemplate:
    """What opens a turn of each role and closes any turn, which roles are learnt, and which may follow which.

    ``moves``: (state, role) to the next state. The machine begins in ``start``; a conversation is in order if every turn
    has a move and it ends in a state of ``ends``. Roles without an opening of their own get ``other``, their escaped name
    and the close. Control strings are at least two characters long, contain no backslash, none ends as another begins, and no
    opening begins with ``other``.
    """

    opens: dict[str, str] = field(
        default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: ", "tool": "### Tool: "}
    )
    other: str = "### Role "
    close: str = "</turn>\n"
    learnt: tuple[str, ...] = ("assistant",)
    start: str = "begin"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("begin", "system"): "told",
            ("begin", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
            ("answered", "tool"): "asked",
        }
    )
    ends: tuple[str, ...] = ("answered", "asked")

    def control(self) -> list[str]:
        """The strings that texts must not contain; the line end after a close does not count."""
        return [*self.opens.values(), self.other, self.close.rstrip("\n")]


def escape_sql(text: str, template: ChatTemplate) -> str:
    """SQL: backslashes doubled, and a backslash put after the first character of every control string."""
    out = f"replace({text}, {sql_text(chr(92))}, {sql_text(chr(92) * 2)})"
    for c in template.control():
        out = f"replace({out}, {sql_text(c)}, {sql_text(c[0] + chr(92) + c[1:])})"
    return out


def unescape_sql(text: str) -> str:
    """SQL: what follows a backslash, without it."""
    return f"regexp_replace({text}, {sql_text(r'(?s)' + chr(92) * 2 + '(.)')}, '$1')"


def _when(value: str, pairs: dict[str, str], other: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {sql_text(k)} THEN {v}" for k, v in pairs.items()) + f" ELSE {other} END"


def format_conversations(
    turns: DataFrame,
    template: ChatTemplate | None = None,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv_id``, ``n_turns``, ``in_order``, ``first_problem``, ``segments`` (text, loss), ``formatted``: one row per conversation.

    Turns are ordered by turn (null first), then role and text; repeated turns all stay. A null role or text counts as
    empty; rows with a null id form one conversation. ``in_order`` is the machine's judgement, ``first_problem`` the number
    (from 1) of the first turn without a move, null if there is none; all conversations are formatted. A conversation's
    text stands in one row, as its reader needs it. Empty tables give no rows; other columns are ignored.
    """
    t = template or ChatTemplate()
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    df = turns.groupBy(F.col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    moves = f"map({', '.join(f'{sql_text(s + chr(31) + r)}, {sql_text(n)}' for (s, r), n in t.moves.items())})"
    states = f"""aggregate(turns, struct({sql_text(t.start)} AS state, 0 AS n, cast(NULL AS int) AS problem),
        (a, x) -> struct(coalesce({moves}[concat(a.state, {sql_text(chr(31))}, x.role)], 'stray') AS state, a.n + 1 AS n,
            coalesce(a.problem, if({moves}[concat(a.state, {sql_text(chr(31))}, x.role)] IS NULL, a.n + 1, NULL)) AS problem))"""
    opening = _when("x.role", {r: sql_text(o) for r, o in t.opens.items()}, f"concat({sql_text(t.other)}, {escape_sql('x.role', t)}, {sql_text(t.close)})")
    learnt = f"x.role IN ({', '.join(map(sql_text, t.learnt))})"
    segments = f"""flatten(transform(turns, x -> array(
        struct({opening} AS text, false AS loss), struct({escape_sql('x.text', t)} AS text, {learnt} AS loss), struct({sql_text(t.close)} AS text, false AS loss))))"""
    ends = ", ".join(map(sql_text, t.ends))
    return (
        df.withColumns({"segments": F.expr(segments), "end": F.expr(states)})
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.expr(f"end.problem IS NULL AND end.state IN ({ends})").alias("in_order"),
            F.col("end.problem").alias("first_problem"),
            "segments",
        )
        .withColumn("formatted", F.expr("array_join(transform(segments, s -> s.text), '')"))
    )


def read_turns(formatted: str, template: ChatTemplate | None = None) -> Column:
    """Roles and texts back from a formatted conversation: array of (role, text)."""
    t = template or ChatTemplate()
    # Closes are cut off, taken literally; a turn of another role has one more, after its name.
    pieces = f"split({formatted}, {sql_text(chr(92) + 'Q' + t.close + chr(92) + 'E')}, -1)"
    parts = f"slice({pieces}, 1, size({pieces}) - 1)"
    opened = "CASE " + " ".join(
        f"WHEN startswith(p, {sql_text(o)}) THEN struct({sql_text(r)} AS role, {unescape_sql(f'substr(p, {len(o) + 1})')} AS text)"
        for r, o in t.opens.items()
    )
    named = f"WHEN startswith(p, {sql_text(t.other)}) THEN struct({unescape_sql(f'substr(p, {len(t.other) + 1})')} AS role, cast(NULL AS string) AS text)"
    read = f"transform({parts}, p -> {opened} {named} ELSE struct(cast(NULL AS string) AS role, {unescape_sql('p')} AS text) END)"
    # The text of a named role is the part after its name.
    joined = """transform(filter(transform(r, (x, i) -> struct(x.role AS role, if(x.text IS NULL, r[i + 1].text, x.text) AS text)),
        y -> y.role IS NOT NULL), y -> y)"""
    return F.expr(f"transform(array({read}), r -> {joined})[0]")


def learnt_text(segments: str) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.expr(f"array_join(transform(filter({segments}, s -> s.loss), s -> {unescape_sql('s.text')}), '')")
