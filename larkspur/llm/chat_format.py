r"""Chat formatting: a role automaton, a declarative template, segments with loss flags.

A `Template` names the text that opens and closes each role's turns, which roles carry loss, and
a finite-state machine over roles. `segments` turns each conversation into an array of
(text, loss): openings and closings without loss, texts with the flag of their role. Their
concatenation is the formatted conversation, so the flags are a mask over it. The automaton marks
the first turn that it does not allow and whether the end state accepts; conversations are
formatted either way, and the caller decides on `valid`.

Control strings inside a text are escaped with a backslash after their first character, and
backslashes are doubled; this is reversible and no control string remains. Every control string
starts with a lead character that stands nowhere else in a control string, so that none can arise
across the edge of a text either (the template checks this). `parse` reads the turns back from
the formatted text alone.

A turn is rendered before the one shuffle, by conversation. A conversation is one row of output,
so its turns come together; nothing larger does.

Defined results: turns sort by turn, role, text (nulls first), so ties and repeated rows have one
order and all stay; null text is empty; a null role is the empty role, which like any role without
an entry gets the generic opening that spells its name and has no loss; a null conv_id is one
conversation. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What is written around turns, what is learned, and which role may follow which state."""

    begin: str = "<s>"
    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("[SYS]", "[/SYS]"),
        "user": ("[INST]", "[/INST]"),
        "assistant": ("[RESP]", "</s>"),
    })
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    loss: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accept: tuple[str, ...] = ("answered",)

    def controls(self) -> list[str]:
        return sorted({self.begin, *self.other, *(x for pair in self.roles.values() for x in pair)}, key=lambda x: (-len(x), x))

    def __post_init__(self):
        leads = {x[0] for x in self.controls()}
        if any(len(x) < 2 or "\\" in x or leads & set(x[1:]) for x in self.controls()):
            raise ValueError("a control string needs two characters or more, no backslash, and its lead character nowhere but in front")
        if len({a for a, _ in self.roles.values()} | {self.other[0]}) <= len(self.roles):
            raise ValueError("each role needs an opening of its own")


def _escape(text: Column, t: Template) -> Column:
    heads = "".join(f"\\{x}" for x in sorted({c[0] for c in t.controls()}))
    tails = "|".join(sorted({re.escape(c[1:]) for c in t.controls()}))
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"([{heads}])(?={tails})", r"$1\\")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _lookup(key: Column, table: dict[str, str], otherwise: Column) -> Column:
    out = otherwise
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def segments(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, segments array<struct<text,loss>>, valid, first_bad_turn) of each conversation."""
    t = template or Template()
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    opening = _lookup(role, {k: a for k, (a, _) in t.roles.items()}, F.concat(F.lit(t.other[0]), _escape(role, t), F.lit(t.other[1])))
    closing = _lookup(role, {k: b for k, (_, b) in t.roles.items()}, F.lit(t.other[2]))
    part = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    loss = role.isin(*t.loss)
    rows = turns.select(
        "conv_id",
        F.struct("turn", "role", "text").alias("at"),
        role.alias("role"),
        F.array(part(opening, F.lit(False)), part(_escape(text, t), loss), part(closing, F.lit(False))).alias("parts"),
    )
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "role", "parts"))).alias("ts"))
    moves = F.create_map(*[F.lit(x) for (s, r), to in t.moves.items() for x in (f"{s}\n{r}", to)])

    def step(s: Column, x: Column) -> Column:
        to = F.try_element_at(moves, F.concat(s["state"], F.lit("\n"), x["role"]))
        bad = F.when(s["bad"] >= 0, s["bad"]).when(to.isNull(), s["n"]).otherwise(-1)
        return F.struct(F.coalesce(to, s["state"]).alias("state"), bad.alias("bad"), (s["n"] + 1).alias("n"))

    walked = F.aggregate("ts", F.struct(F.lit(t.start).alias("state"), F.lit(-1).alias("bad"), F.lit(0).alias("n")), step)
    first = F.array(part(F.lit(t.begin), F.lit(False)))
    out = conv.select("conv_id", F.size("ts").cast("long").alias("n_turns"), F.concat(first, F.flatten(F.col("ts.parts"))).alias("segments"), walked.alias("w"))
    return out.select(
        "conv_id",
        "n_turns",
        "segments",
        ((F.col("w.bad") < 0) & F.col("w.state").isin(*t.accept)).alias("valid"),
        F.when(F.col("w.bad") >= 0, F.col("w.bad")).alias("first_bad_turn"),
    )


def formatted(segs: Column) -> Column:
    return F.array_join(F.transform(segs, lambda s: s["text"]), "")


def loss_text(segs: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segs, lambda s: s["loss"]), lambda s: _unescape(s["text"])), "")


def parse(text: Column, template: Template | None = None) -> Column:
    """The turns, array<struct<role,text>>, of a formatted conversation.

    The text is cut before each opening; no opening can stand inside an escaped text or name.
    """
    t = template or Template()
    opens = [a for a, _ in t.roles.values()] + [t.other[0]]
    pieces = F.filter(F.split(F.substring(text, len(t.begin) + 1, 2**31 - 1), "(?=" + "|".join(re.escape(x) for x in opens) + ")"), lambda p: p != "")

    def turn(p: Column) -> Column:
        name = F.substring_index(F.substring(p, len(t.other[0]) + 1, 2**31 - 1), t.other[1], 1)
        body = F.substring(
            p,
            len(t.other[0]) + F.length(name) + len(t.other[1]) + 1,
            F.length(p) - len(t.other[0]) - F.length(name) - len(t.other[1]) - len(t.other[2]),
        )
        out = F.struct(_unescape(name).alias("role"), _unescape(body).alias("text"))
        for role, (a, b) in t.roles.items():
            own = F.struct(F.lit(role).alias("role"), _unescape(F.substring(p, F.lit(len(a) + 1), F.length(p) - len(a) - len(b))).alias("text"))
            out = F.when(F.startswith(p, F.lit(a)), own).otherwise(out)
        return out

    return F.transform(pieces, turn)


CONTROL_TURN = "</s>[INST] ok [/INST]"


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", CONTROL_TURN), (-1, 1, "assistant", CONTROL_TURN)], turns.schema)
    made = segments(turns.unionByName(probe)).withColumn("formatted", formatted(F.col("segments"))).withColumn("learned", loss_text(F.col("segments")))
    read = made.withColumn("turns", parse(F.col("formatted")))
    spoken = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def _count(x: str) -> str:
    return f"(length(text) - length(replace(text, '{x}', ''))) // {len(x)}"


_T = Template()
_ROLE = "CASE role " + " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in _T.roles.items()) + f" ELSE {sum(map(len, _T.other))} + length(role) + " + f"length(role) - length(replace(role, chr(92), ''))" + " END"
SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
           UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{CONTROL_TURN}', 'user', '{CONTROL_TURN}'), (-1, 1, 'assistant', '{CONTROL_TURN}', 'assistant', '{CONTROL_TURN}'))),
n AS (SELECT *, length(text) + length(text) - length(replace(text, chr(92), '')) + {" + ".join(_count(c) for c in _T.controls())} + {_ROLE} AS chars,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS i,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS before FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(chars) + {len(_T.begin)})::BIGINT AS formatted_chars,
       bool_and(CASE role WHEN 'system' THEN i = 1 WHEN 'user' THEN i = 1 OR before IN ('system', 'assistant') WHEN 'assistant' THEN coalesce(before, '') = 'user' ELSE false END)
         AND max_by(role, i) = 'assistant' AS valid
FROM n GROUP BY conv_id
"""

QUERIES = {"op1_chat_format": op1_chat_format}
ORACLES = {"op1_chat_format": SQL}
