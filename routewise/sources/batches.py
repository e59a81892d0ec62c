"""Categorization prompt batches and reply parsing.

A5 groups consecutive rows (by position in ``row_idx`` order) into requests
of ``PROMPT_BATCH_SIZE`` rows; each group is bounded by the batch size, so
``collect_list`` never gathers more than that many lines.  Whole rows cross one
exchange, by ranges of the key; only the batches that cross a range's edge are
gathered once more.  A6 turns free
reply text into ``(id, category)`` rows: every outermost ``{...}`` object (nested ones
and braces in strings belong to it) is parsed with an explicit schema, and rows that
fail to parse are kept with ``is_valid = false`` (a rejects output, nothing is dropped).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..operators.rowindex import with_row_number

#: A reply in pieces: escaped pairs, quotes, braces, and what lies between.
PIECE = r'(?s)\\.|["{}]|[^"{}\\]+|\\'
#: A flat object, whose strings may hold braces.
FLAT_OBJECT = r'\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}'


def prompt_batches(rows: DataFrame, key: str = "row_idx", size: int = config.PROMPT_BATCH_SIZE,
                   template: str = config.CATEGORY_PROMPT) -> DataFrame:
    """A5: ``(batch_no, n_rows, prompt)``; prompt = template + newline-joined JSON lines."""
    pos = with_row_number(rows, key, "row_no", tie=["id"], keep_range=True)
    line = F.to_json(F.struct("id", "instruction", "input", "output"))
    # complete within a range of rows, but for the batches that cross its edges
    parts = (pos.withColumn("batch_no", F.floor((F.col("row_no") - 1) / F.lit(size)).cast("bigint"))
                .groupBy("__part", "batch_no")
                .agg(F.count(F.lit(1)).alias("n_rows"),
                     F.array_sort(F.collect_list(F.struct(F.col("row_no"), line.alias("line")))).alias("lines")))
    crossing = (parts.where(F.col("n_rows") < size).groupBy("batch_no")
                .agg(F.sum("n_rows").alias("n_rows"), F.array_sort(F.flatten(F.collect_list("lines"))).alias("lines")))
    batches = parts.where(F.col("n_rows") == size).select("batch_no", "n_rows", "lines").unionByName(crossing)
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return batches.select("batch_no", F.col("n_rows").cast("bigint").alias("n_rows"),
                          F.concat(F.lit(template + "\n"), body).alias("prompt"))


def objects_in(text) -> Column:
    """All outermost ``{...}`` objects of a text, in order: one scan that counts the depth of braces and
    honours quotes and escapes inside objects, so neither nested objects nor braces in strings end one.

    Quotes outside objects are prose.  Where an object is never closed, the flat objects behind
    its first brace are taken instead, so one stray brace does not hide the rest."""
    text = T.nz(text)
    begin = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(1).alias("pos"), F.lit(0).alias("start"),
                     F.array().cast("array<struct<start:int,size:int>>").alias("found"))

    def step(s, piece):
        quoted = (s["quoted"] & (piece != '"')) | (~s["quoted"] & (piece == '"') & (s["depth"] > 0))
        brace = F.when(s["quoted"], 0).when(piece == "{", 1).when((piece == "}") & (s["depth"] > 0), -1).otherwise(0)
        after = s["pos"] + F.length(piece)
        closed = (brace == -1) & (s["depth"] == 1)
        return F.struct((s["depth"] + brace).alias("depth"), quoted.alias("quoted"), after.alias("pos"),
                        F.when((brace == 1) & (s["depth"] == 0), s["pos"]).otherwise(s["start"]).alias("start"),
                        F.when(closed, F.concat(s["found"], F.array(F.struct(s["start"].alias("start"), (after - s["start"]).alias("size")))))
                        .otherwise(s["found"]).alias("found"))

    scan = F.aggregate(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), begin, step)
    whole = F.transform(scan["found"], lambda f: F.substring(text, f["start"], f["size"]))
    rest = F.when(scan["depth"] > 0, F.substring(text, scan["start"] + 1, F.length(text))).otherwise(F.lit(""))
    return F.concat(whole, F.regexp_extract_all(rest, F.lit(FLAT_OBJECT), F.lit(0)))


def parse_category_replies(replies: DataFrame, text: str = "reply", keep=("batch_no",)) -> DataFrame:
    """One row per outermost ``{...}`` object in the reply text."""
    objs = replies.select(*keep, F.posexplode(objects_in(text)).alias("obj_no", "obj"))
    parsed = objs.withColumn("p", F.from_json("obj", "id string, category int"))
    return parsed.select(*keep, "obj_no", "obj", F.col("p.id").alias("id"), F.col("p.category").alias("category"),
                         (F.col("p.id").isNotNull() & F.col("p.category").isNotNull()).alias("is_valid"))
