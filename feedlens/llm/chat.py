"""Chat formatting: a finite-state machine over roles, and segments with loss flags from a declarative template."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm.common import whole


@dataclass(frozen=True)
class Template:
    """How turns are marked. Texts and roles are escaped: the escape sign, the head's mark sign and the tail each
    become the escape sign and a letter, so neither mark can occur inside a text."""

    mark: str = "#"
    head: str = "### "
    head_end: str = ": "
    tail: str = " </turn>\n"
    tail_mark: str = "</turn>"
    escape: str = "\\"
    shown: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> {role: next state}; the machine starts at "start" and may end in `ends`.
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}}
    )
    ends: tuple[str, ...] = ("assistant",)


PRODUCTION = Template()


def escaped(text: Column, t: Template = PRODUCTION) -> Column:
    x = F.replace(text, F.lit(t.escape), F.lit(f"{t.escape}s"))
    x = F.replace(x, F.lit(t.mark), F.lit(f"{t.escape}h"))
    return F.replace(x, F.lit(t.tail_mark), F.lit(f"{t.escape}t"))


def unescaped(text: Column, t: Template = PRODUCTION) -> Column:
    x = F.replace(text, F.lit(f"{t.escape}t"), F.lit(t.tail_mark))
    x = F.replace(x, F.lit(f"{t.escape}h"), F.lit(t.mark))
    return F.replace(x, F.lit(f"{t.escape}s"), F.lit(t.escape))


def _shown(role: Column, t: Template) -> Column:
    """A role's name in the template; any other role escaped, with the head's end too, after a sign of its own."""
    end = t.head_end[:1]
    out = F.concat(F.lit(f"{t.escape}r"), F.replace(escaped(role, t), F.lit(end), F.lit(f"{t.escape}c")))
    for k, v in t.shown.items():
        out = F.when(role == k, F.lit(v)).otherwise(out)
    return out


def _role(shown: Column, t: Template) -> Column:
    sign = f"{t.escape}r"
    out = unescaped(F.replace(F.substring(shown, F.lit(len(sign) + 1), F.length(shown)), F.lit(f"{t.escape}c"), F.lit(t.head_end[:1])), t)
    for k, v in t.shown.items():
        out = F.when(shown == v, F.lit(k)).otherwise(out)
    return out


def formatted(turns: DataFrame, t: Template = PRODUCTION) -> DataFrame:
    """One row for each conv_id: segments array<struct<text, loss>>, formatted string, valid boolean.

    Turns are ordered by turn, then role, then text (so ties and repeated rows have one order; repeated rows
    stay repeated turns). Null role or text counts as empty, a null turn comes first, a null conv_id is a
    conversation of its own. valid tells whether the role machine accepts the whole order; rejected
    conversations are formatted all the same. A role that isn't in the template is written escaped.
    A very long text is one turn of its conversation's row. Extra columns are left out; an empty table gives no rows.
    """
    one = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", whole(F.col("role")).alias("role"), whole(F.col("text")).alias("text")))).alias("turns"))
    step = F.create_map(*[F.lit(x) for a, row in t.moves.items() for r, b in row.items() for x in (f"{a}\n{r}", b)])
    state = F.aggregate("turns", F.lit("start"), lambda s, x: F.coalesce(F.try_element_at(step, F.concat(s, F.lit("\n"), x["role"])), F.lit("rejected")))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                segment(F.concat(F.lit(t.head), _shown(x["role"], t), F.lit(t.head_end)), F.lit(False)),
                segment(escaped(x["text"], t), x["role"].isin(*t.loss_roles)),
                segment(F.lit(t.tail), F.lit(False)),
            ),
        )
    )
    out = one.select("conv_id", state.isin(*t.ends).alias("valid"), segments.alias("segments"))
    return out.select("*", F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"))


def read_back(text: Column, t: Template = PRODUCTION) -> Column:
    """The turns (role, text) of a formatted string: cut at tails, then at the end of each head."""
    parts = F.filter(F.split(text, f"\\Q{t.tail}\\E", -1), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.struct(
            _role(F.substring(x, F.lit(len(t.head) + 1), F.instr(x, F.lit(t.head_end)) - len(t.head) - 1), t).alias("role"),
            unescaped(F.substring(x, F.instr(x, F.lit(t.head_end)) + len(t.head_end), F.length(x)), t).alias("text"),
        ),
    )


def digests(out: DataFrame, t: Template = PRODUCTION) -> DataFrame:
    """The counts and digests of formatted(), read back from its output alone."""
    back = out.select("*", read_back(F.col("formatted"), t).alias("back"))
    lost = F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescaped(x["text"], t)), "")
    return back.select(
        "conv_id",
        F.size("back").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(lost).cast("bigint").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )


def with_probe(turns: DataFrame, spark: SparkSession) -> DataFrame:
    """The conversations and conversation -7, whose texts hold the template's own marks."""
    said = "\\### Assistant: </turn> ok"
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(probe)
