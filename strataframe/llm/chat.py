"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted, neighbours of one role are merged, and the groups are joined to one text:

    <|im_start|>role<|im_sep|>first text<|im_next|>second text of the same role<|im_end|>\\n

Inside roles and texts every control string gets a backslash behind its first character (one more, if it has some), so
that none of them can be taken for a mark; taking one away again restores the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>\n"
CONTROL = r"(\||/?s>|/?INST\]|/?SYS>>)"
LEARNED = "assistant"
RUNS, BLOCK = 256, 4096  # runs and code points that are handled together, so that long conversations take no quadratic time


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", learned: str = LEARNED) -> DataFrame:
    """One row per conversation: `conv_id`, `formatted`, and `loss_mask` as runs of (skip, take) code points.

    Turns are ordered by turn number, null first; rows that tie come by role, then text, and none is dropped. A null
    role or text is an empty one; rows with a null id form one conversation. The mask covers each text of the learned
    role by itself, without marks. Other columns are ignored.
    """
    rows = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.struct(F.col(turn).cast("long").alias("turn"), escape(F.coalesce(F.col(role), F.lit(""))).alias("role"),
                 escape(F.coalesce(F.col(text), F.lit(""))).alias("text")).alias("t"))
    kept = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    t = F.col("t")
    places = F.sequence(F.lit(0), F.size(t) - 1)
    starts = F.filter(places, lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
    kept = kept.select("conv_id", "t", starts.alias("s"))
    s = F.col("s")
    merged = F.transform(s, lambda first, k: F.struct(
        F.get(t, first)["role"].alias("role"),
        F.transform(F.slice(t, first + 1, F.coalesce(F.get(s, k + 1), F.size(t)) - first), lambda x: x["text"]).alias("texts")))
    kept = kept.select("conv_id", merged.alias("g"))
    g = F.col("g")
    whole = F.array_join(F.transform(g, lambda x: F.concat(F.lit(START), x["role"], F.lit(SEP), F.array_join(x["texts"], NEXT), F.lit(END))), "")
    # A run for each text: what comes before it is skipped, and it is taken if its role is learned.
    head = lambda x: F.length(x["role"]) + len(START) + len(SEP)
    pieces = F.flatten(F.transform(g, lambda x, k: F.transform(x["texts"], lambda y, j: F.struct(
        F.when(j > 0, len(NEXT)).otherwise(F.when(k > 0, len(END)).otherwise(0) + head(x)).cast("long").alias("skip"),
        F.length(y).cast("long").alias("size"), (x["role"] == F.lit(learned)).alias("learned")))))
    mask = F.transform(pieces, lambda p: F.struct(
        (p["skip"] + F.when(p["learned"], 0).otherwise(p["size"])).alias("skip"),
        F.when(p["learned"], p["size"]).otherwise(F.lit(0)).cast("long").alias("take")))
    return kept.select("conv_id", whole.alias("formatted"), mask.alias("loss_mask"))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """`conv_id` and `turns` (role, text as they were) from the formatted text alone."""
    groups = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda x: x != "")
    role = lambda x: unescape(F.substring_index(F.substr(x, F.lit(len(START) + 1)), SEP, 1))
    body = lambda x: F.substr(x, F.instr(x, F.lit(SEP)) + len(SEP))
    turns = F.flatten(F.transform(groups, lambda x: F.transform(
        F.split(body(x), r"<\|im_next\|>", -1), lambda y: F.struct(role(x).alias("role"), unescape(y).alias("text")))))
    return formatted.select("conv_id", "formatted", "loss_mask", turns.alias("turns"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once, also where `use` has lambdas of its own."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda x, y: x + y)


def under_mask(formatted: Column, mask: Column) -> Column:
    """The pieces of a text that its runs of (skip, take) code points take, as an array."""
    starts = F.filter(F.sequence(F.lit(0), F.size(mask)), lambda i: (i % RUNS == 0) & (i < F.size(mask)))
    groups = F.transform(starts, lambda i: F.slice(mask, i + 1, F.lit(RUNS)))

    def placed(g: Column, before: Column) -> Column:
        return let(F.transform(g, lambda m: m["skip"] + m["take"]), lambda long: F.transform(g, lambda m, i: F.struct(
            (before + total(F.slice(long, F.lit(1), i)) + m["skip"]).alias("at"), m["take"].alias("take"))))

    def all_placed(gs: Column) -> Column:
        sums = F.transform(gs, lambda g: total(F.transform(g, lambda m: m["skip"] + m["take"])))
        return let(sums, lambda s: F.flatten(F.transform(gs, lambda g, k: let(total(F.slice(s, F.lit(1), k)), lambda n: placed(g, n)))))

    def cut(blocks: Column, r: Column) -> Column:
        first, last = F.floor(r["at"] / BLOCK).cast("int"), F.floor((r["at"] + r["take"] - 1) / BLOCK).cast("int")
        return F.substr(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), (r["at"] % BLOCK + 1).cast("int"), r["take"].cast("int"))

    runs = F.filter(let(groups, all_placed), lambda r: r["take"] > 0)
    blocks = F.regexp_extract_all(formatted, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))
    return let(blocks, lambda b: F.transform(runs, lambda r: cut(b, r)))


def conversation_digests(formatted: DataFrame, learned: str = LEARNED) -> DataFrame:
    """Counts and hashes of what `read_conversations` finds and of the text under the mask; fails if the mask is too short."""
    r = read_conversations(formatted)
    t = F.col("turns")
    told = F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    due = F.aggregate(F.filter(t, lambda x: x["role"] == learned), F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"]))
    loss = F.array_join(F.transform(under_mask(F.col("formatted"), F.col("loss_mask")), unescape), "")
    covered = F.aggregate("loss_mask", F.lit(0).cast("long"), lambda a, m: a + m["take"])
    r = r.select("conv_id", F.size(t).cast("long").alias("n_turns"), told.alias("told"), loss.alias("loss"), due.alias("due"), covered.alias("covered"),
                 F.length("formatted").cast("long").alias("formatted_chars"))
    n = F.length("loss").cast("long")
    return r.select(
        "conv_id", "n_turns", F.sha2(F.col("told").cast("binary"), 256).alias("turns_sha256"),
        F.when(F.col("covered") < F.col("due"), F.raise_error(F.lit("the mask is too short"))).otherwise(n).alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
