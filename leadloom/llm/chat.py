"""Chat formatting by prefix-target expansion, in Column expressions only.

Every assistant turn becomes an example of its own: all turns before it are
context, only its reply is trainable. Turns after the last assistant turn, and
conversations without one, give one example without a reply, so that no turn
is missing from the output.

Marks are control strings. A control string inside a text gets a backslash
after its first character, one more if it has some already; taking one away
undoes this exactly, and no mark can appear inside a text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.llm.common import text_or_empty


@dataclass(frozen=True)
class Template:
    """open role middle text close; ``foreign``: further control strings to escape."""

    open: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")

    def _tails(self) -> str:
        import re

        return "|".join(re.escape(c[1:]).replace("/", "/") for c in (self.open, self.middle, self.close, *self.foreign))

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])(\\*)({self._tails()})", r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])\\(\\*)({self._tails()})", "$1$2$3")

    def head(self, role: Column) -> Column:
        return F.concat(F.lit(self.open), self.escape(role), F.lit(self.middle))


TEMPLATE = Template()


def examples(turns: DataFrame, template: Template = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn",
             role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, example, context, reply, n_turns) of every example.

    ``context`` ends with the head of the assistant turn, ``reply`` is its
    text and close mark; reply is null in an example without one. Turns are
    ordered by turn, then role, then text; nulls first. Null role or text
    counts as empty; rows with a null conv_id form one conversation; repeated
    rows are turns of their own; an empty table gives an empty table.
    """
    cells = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        text_or_empty(F.col(role_col)).alias("role"), text_or_empty(F.col(text_col)).alias("text"))
    parts = cells.select(
        "conv_id", F.struct("turn", "role", "text", template.head(F.col("role")).alias("head"),
                            F.concat(template.escape(F.col("text")), F.lit(template.close)).alias("body")).alias("t"))
    held = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")).select(
        "conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["head"].alias("head"),
                                                        t["body"].alias("body"))).alias("ts"))
    places = F.filter(F.sequence(F.lit(0), F.size("ts") - 1),
                      lambda i: (F.get("ts", i)["role"] == "assistant") | (i == F.size("ts") - 1))
    at = held.select("conv_id", "ts", F.posexplode(places).alias("example", "i"))
    before = F.array_join(F.transform(F.slice("ts", F.lit(1), F.col("i")), lambda t: F.concat(t["head"], t["body"])), "")
    target = F.get("ts", F.col("i"))
    is_reply = target["role"] == "assistant"
    return at.select(
        "conv_id", "example",
        F.concat(before, F.when(is_reply, target["head"]).otherwise(F.concat(target["head"], target["body"])))
        .alias("context"),
        F.when(is_reply, target["body"]).alias("reply"), (F.col("i") + 1).cast("bigint").alias("n_turns"))


def parsed(formatted: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<role, text>> read back from formatted turns."""
    turns = F.filter(F.split(formatted, _quoted(template.close), -1), lambda s: s != "")

    def one(s: Column) -> Column:
        inner = F.substring(s, F.lit(len(template.open) + 1), F.length(s))
        return F.transform(F.array(F.split(inner, _quoted(template.middle), 2)), lambda p: F.struct(
            template.unescape(F.get(p, F.lit(0))).alias("role"), template.unescape(F.get(p, F.lit(1))).alias("text")))[0]

    return F.transform(turns, one)


def reply_text(reply: Column, template: Template = TEMPLATE) -> Column:
    """The text under an example's loss mask, without its close mark and escapes; null without a reply."""
    return template.unescape(F.substring(reply, F.lit(1), F.length(reply) - len(template.close)))


def _quoted(mark: str) -> str:
    import re

    return re.escape(mark)
