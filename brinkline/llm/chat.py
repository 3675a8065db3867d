"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A conversation renders as, for every turn, ``<s>[INST]`` role ``[/INST]`` text ``</s>``. The parser splits at these
control strings from left to right. A conversation is first rendered as it is and reparsed; where the turns that
come back differ from the source, control strings inside its roles and texts are escaped, after which they come back
identical. Escaping puts a backslash behind the opening bracket of anything that is, backslashes aside, a control
string; unescaping takes one away, so the two are inverse and one pass is enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256
OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
# Anything that is a control string once backslashes behind its bracket are left out.
_CONFLICT = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONFLICT, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def render(turns: Column) -> Column:
    """One string of an array of (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def parse(formatted: Column) -> Column:
    """Turns (role, text) still escaped, read from left to right; a text runs to the first ``</s>`` behind it."""
    pieces = F.filter(F.split(formatted, r"</s>", -1), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), MIDDLE, 1).alias("role"),
            F.substr(p, F.lit(len(OPEN) + len(MIDDLE) + 1) + F.length(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), MIDDLE, 1))).alias("text"),
        ),
    )


def unescaped(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, escaped, turns (role, text as read back), loss_spans (start, end of each assistant text).

    ``rows`` (conv_id, turn, role, text) are taken by turn; ties go by role, then text. Null roles and texts count
    as empty; a null conv_id is a conversation of its own. Repeated rows are repeated turns. Spans are code points
    of ``formatted``, end exclusive. Extra columns are ignored; an empty table gives an empty result.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    source = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("source"))
    source = source.select("conv_id", F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    plain = source.withColumn("plain", render(F.col("source")))
    tried = plain.withColumn("escaped", ~(unescaped(parse(F.col("plain"))) == F.col("source")))
    safe = F.transform("source", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    done = tried.select("conv_id", "escaped", F.when(F.col("escaped"), render(safe)).otherwise(F.col("plain")).alias("formatted"))
    read = done.withColumn("stored", parse(F.col("formatted")))
    return read.select("conv_id", "formatted", "escaped", unescaped(F.col("stored")).alias("turns"), _loss_spans(F.col("stored")).alias("loss_spans"))


def _chunks(array: Column) -> Column:
    """An array in pieces of ``CHUNK``, so that folds that grow an array copy no more than that a step."""
    n = F.ceil(F.size(array) / CHUNK).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(array, i * CHUNK + 1, CHUNK))).otherwise(F.array_repeat(array, 0))


def _loss_spans(stored: Column) -> Column:
    """(start, end) of each assistant text: chunk lengths are summed first, then places inside each chunk."""
    frame = len(OPEN) + len(MIDDLE) + len(CLOSE)
    lengths = F.transform(_chunks(stored), lambda c: F.aggregate(c, F.lit(0), lambda n, t: n + F.length(t["role"]) + F.length(t["text"]) + frame))
    running = F.aggregate(lengths, F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.lit(len(OPEN) + len(MIDDLE)) + F.length(t["role"])
        end = start + F.length(t["text"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + F.lit(len(CLOSE))).alias("at"), F.when(t["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    def inside(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), none.alias("spans")), step, lambda s: s["spans"])

    chunks = _chunks(stored)
    return F.flatten(F.zip_with(chunks, F.slice(running, 1, F.greatest(F.size(chunks), F.lit(1))), lambda c, at: inside(F.coalesce(c, F.slice(stored, 1, 0)), at)))


def _covered(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the spans. A chunk of spans is cut out of the whole once, then into its own texts."""

    def texts(chunk: Column) -> Column:
        start = F.element_at(chunk, 1)["start"]
        part = F.substr(formatted, start + 1, F.element_at(chunk, -1)["end"] - start)
        return F.array_join(F.element_at(F.transform(F.array(part), lambda p: F.transform(chunk, lambda s: unescape(F.substr(p, s["start"] - start + 1, s["end"] - s["start"])))), 1), "")

    return F.array_join(F.transform(_chunks(spans), texts), "")


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, derived from the formatted string, its spans and the turns read back from it."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.withColumn("loss", _covered(F.col("formatted"), F.col("loss_spans"))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
    )
