"""Chat formatting: the dialogue once for every participant, with that speaker as the assistant.

Others are named users; the mask says which characters the model learns, those of the assistant's turns with their end marks.
A dialogue is rendered in parts of ``turns_per_part`` turn numbers, so that a very long one is many rows instead of one cell;
most have a single part. DataFrame expressions only.

Defined cases: null text is an empty turn; a turn without speaker is shown as user "unknown" and is nobody's perspective; turns
without number come first, in part -1; repeated turns stay, ordered by number, speaker, text; a null conversation is one
conversation; marks inside a text are escaped; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TURNS_PER_PART = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
UNKNOWN = "unknown"


def escaped(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<\\|"))


def perspectives(
    turns: DataFrame, conversation: str = "conv_id", number: str = "turn", speaker: str = "role", text: str = "text", turns_per_part: int = TURNS_PER_PART
) -> DataFrame:
    """conversation, speaker (the assistant), part, n_turns, n_learned (turns), rendered, mask (begin and end of learned spans)."""
    t = turns.select(
        F.col(conversation).alias("conversation"), F.col(speaker).alias("who"),
        F.coalesce(F.floor(F.col(number) / turns_per_part), F.lit(-1)).cast("bigint").alias("part"), F.col(number).alias("number"), F.col(text).alias("body"),
    )
    parts = t.groupBy("conversation", "part").agg(F.sort_array(F.collect_list(F.struct("number", "who", "body"))).alias("turns"))
    people = t.where("who IS NOT NULL").select("conversation", F.col("who").alias("speaker")).distinct()
    pair = parts.alias("p").join(people.alias("q"), F.expr("p.conversation <=> q.conversation"))
    df = pair.select("p.conversation", "q.speaker", "p.part", "p.turns")

    own = lambda x: x["who"].eqNullSafe(F.col("speaker"))
    head = lambda x: F.when(own(x), OPEN + "assistant\n").otherwise(
        F.concat(F.lit(OPEN + "user name="), escaped(F.coalesce(x["who"], F.lit(UNKNOWN))), F.lit("\n"))
    )
    pieces = F.transform("turns", lambda x: F.struct(own(x).alias("own"), head(x).alias("head"), F.concat(escaped(x["body"]), F.lit(CLOSE)).alias("rest")))
    df = df.withColumn("pieces", pieces)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["head"])
        end = begin + F.length(x["rest"])
        span = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(x["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return df.select(
        "conversation", "speaker", "part", F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda x: x["own"])).cast("long").alias("n_learned"),
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["rest"], F.lit("\n"))), "").alias("rendered"),
        F.aggregate("pieces", start, add)["spans"].alias("mask"),
    )
