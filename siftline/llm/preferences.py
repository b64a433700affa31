"""Preference formatting: one shared prompt and two masked completions for each pair.

The longest common prefix of the turns (role and text) of a chosen and a rejected
conversation is rendered once as the prompt. What follows in each is its completion, with
the character spans that a loss may see: the bodies of assistant turns and their end
marks. All of that is column expressions; a conversation's turns meet once, by its id, and
a pair's two sides by the pair's id, so no first turn, however common, is a key.
``token_masks`` turns the spans into token ids and labels.

A role or text that holds a mark cannot forge one: between the signs of a mark it gets a
backslash more than it has there (``escaped``), which ``parse`` takes away again.

Defined results: rows without conv_id or turn belong to no conversation; null role or text
is empty; turns with one number are ordered by role and text; a conversation without a
partner is a pair with an empty other side and no common turns; equal conversations have
empty completions; an empty table gives no pairs; texts are rendered whole, and the spans
of a conversation take time in proportion to its turns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import public_tokenizer
from .rows import map_rows, need_free, running

TURNS = "array<struct<role:string,text:string>>"
OPEN, BODY, END = "<|", "|>\n", "<|end|>\n"
IGNORED = -100  # the label of a token that no loss sees
ROLE_MARK, TEXT_MARK = r"\|(\\*)>", r"<(\\*)\|"


def escaped(role: Column, text: Column) -> tuple[Column, Column]:
    """Role and text in which no mark begins or, in a role, ends."""
    shut = F.regexp_replace(F.regexp_replace(role, TEXT_MARK, r"<\\$1|"), ROLE_MARK, r"|\\$1>")
    return shut, F.regexp_replace(text, TEXT_MARK, r"<\\$1|")


def parse(rendered: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered string."""
    plain = lambda s: re.sub(r"<\\(\\*)\|", r"<\1|", s)
    found = re.findall(r"<\|(.*?)\|>\n(.*?)<\|end\|>\n", rendered, re.S)
    return [(plain(re.sub(r"\|\\(\\*)>", r"|\1>", role)), plain(text)) for role, text in found]


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return grouped.select("conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal in both."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def render(turns: Column) -> Column:
    def one(t: Column) -> Column:
        role, text = escaped(t["role"], t["text"])
        return F.concat(F.lit(OPEN), role, F.lit(BODY), text, F.lit(END))

    return F.array_join(F.transform(turns, one), "")


def loss_spans(turns: Column) -> Column:
    """start and end (exclusive) of the characters of rendered turns that count: assistant bodies with their end marks."""

    def sizes(t: Column) -> Column:
        role, text = escaped(t["role"], t["text"])
        return F.struct(
            (F.length(role) + F.length(text) + len(OPEN + BODY + END)).cast("long").alias("size"),
            (F.length(text) + len(END)).cast("long").alias("body"),
            (t["role"] == "assistant").alias("counts"),
        )

    def added(a: Column, b: Column) -> Column:
        return F.struct((a["size"] + b["size"]).alias("size"), b["body"].alias("body"), b["counts"].alias("counts"))

    first = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("body"), F.lit(False).alias("counts"))
    ends = F.filter(running(F.transform(turns, sizes), added, first), lambda x: x["counts"])
    return F.transform(ends, lambda x: F.struct((x["size"] - x["body"]).alias("start"), x["size"].alias("end")))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (chosen and rejected arrays of turns, and more) with n_common, prompt, completions and their loss spans; pairs that have such a column are an error."""
    need_free(pairs, "n_common", "prompt", *(f"{side}_{part}" for side in ("chosen", "rejected") for part in ("completion", "loss")))
    chosen, rejected = (F.coalesce(F.col(c).cast(TURNS), F.array().cast(TURNS)) for c in ("chosen", "rejected"))
    rows = pairs.withColumns({"chosen": chosen, "rejected": rejected}).withColumn("n_common", common_prefix(F.col("chosen"), F.col("rejected")))
    rest = {side: F.slice(side, F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0))) for side in ("chosen", "rejected")}
    made = {"prompt": render(F.slice("chosen", F.lit(1), F.col("n_common")))}
    for side, turns in rest.items():
        made |= {f"{side}_completion": render(turns), f"{side}_loss": loss_spans(turns)}
    return rows.withColumns(made).drop("chosen", "rejected")


def format_table(turns: DataFrame, listed: bool = True) -> DataFrame:
    """Pairs of the conversations 2k (chosen) and 2k + 1 (rejected), formatted: pair_id, ids, n_common, prompt, completions and loss spans, as text if ``listed``."""
    side = F.pmod(F.col("conv_id"), F.lit(2))
    pick = lambda k, c: F.first(F.when(side == k, F.col(c)), ignorenulls=True)
    paired = conversations(turns).groupBy(F.expr("(conv_id - pmod(conv_id, 2)) div 2").alias("pair_id")).agg(
        pick(0, "conv_id").alias("chosen_id"), pick(1, "conv_id").alias("rejected_id"), pick(0, "turns").alias("chosen"), pick(1, "turns").alias("rejected")
    )
    made = format_pairs(paired)
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return made.withColumns({c: written(c) for c in ("chosen_loss", "rejected_loss")}) if listed else made



def token_masks(formatted: DataFrame, make: Callable[[], Callable[[str], bytes]] = public_tokenizer) -> DataFrame:
    """pair_id, side, input_ids, labels of both sides of formatted pairs (``format_pairs`` and a pair_id).

    ``make`` gives a worker its tokenizer: text to little-endian 32-bit ids. The prompt and
    the stretches in and between the loss spans are tokenised apart, so no token lies on an
    edge. The label of a token in a loss span is its id, of any other IGNORED.
    """

    def load() -> Callable[..., Iterator[tuple]]:
        encode = make()

        def of(pair_id: int, prompt: str, *sides: object) -> Iterator[tuple]:
            head = np.frombuffer(encode(prompt), "<u4")
            for side, text, spans in zip(("chosen", "rejected"), sides[::2], sides[1::2], strict=True):
                edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(text)]
                cuts = [np.frombuffer(encode(text[a:b]), "<u4") for a, b in zip(edges, edges[1:], strict=False)]
                labels = [np.full(len(c), IGNORED) if k % 2 == 0 else c for k, c in enumerate(cuts)]
                yield pair_id, side, np.concatenate([head, *cuts]).tolist(), np.concatenate([np.full(len(head), IGNORED), *labels]).tolist()

        return of

    columns = ["pair_id", "prompt", "chosen_completion", "chosen_loss", "rejected_completion", "rejected_loss"]
    return map_rows(formatted.select(*columns), load, "pair_id long, side string, input_ids array<int>, labels array<int>", 500)
