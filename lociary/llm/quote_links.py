"""Quotation linking: quoted passages of conversations joined to the messages they come from.

Lines of a message that begin with ``>`` (after blanks, repeated for deeper quotes) are quotes; neighbouring lines of one
level form a passage. A passage is normalised (markers off, ASCII lower case, every run of white space one space) and
hashed. Every message is known by the hashes of its own passages: its whole text without quotes, its paragraphs, its
lines and its sentences, of whatever length. A quoted passage links to the latest message before it, in its conversation,
that has a passage of the same hash; where none has, to the latest that has one of its sentences of ``MIN_CHARS``
characters or more, and else to the latest that has one of its shorter sentences. So a conversation becomes a tree of
replies; messages are ordered by thread and position and stripped of their quotes.

All of it is DataFrame functions. Quotes and the passages they may come from are laid out as one table in the order of
(conversation, hash, turn), and each quote reads off the last source before it: no pair of a quote and a source is ever
formed, however often a passage is repeated. This and all numbering goes over range-sorted blocks with one carried row
per block and key, so neither a passage nor a conversation that holds a third of all rows meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lociary.llm.common import store

QUOTE = r"^[ \t]*>"
LINE = r"\r\n|\r|\n"
#: A last line that only announces a quote (who wrote it), in the languages of the tables; blank lines may follow.
ANNOUNCED = r"(?i)\n[^\n]*\b(wrote|writes|schrieb|schreibt|a écrit|escribió):[ \t]*(?=\s*\z)"
MIN_CHARS = 12  # a shorter sentence of a quote counts only where no longer one is found


def quote_level(line: Column) -> Column:
    """Number of markers a line begins with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, r"^((?:[ \t]*>)*)", 1), r"[ \t]", ""))


def without_markers(line: Column) -> Column:
    return F.regexp_replace(line, r"^(?:[ \t]*>)+[ \t]?", "")


def normalised(text: Column) -> Column:
    """A-Z lower-cased, runs of white space as one space, trimmed."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, r"[ \t\r\n\f\x0B ]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """Every message with ``passages`` (level and text of runs of lines of one level), its own text and its deepest level."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), LINE), lambda l: F.struct(quote_level(l).alias("level"), without_markers(l).alias("line")))
    empty = F.array().cast("array<struct<level:int,text:string>>")

    def add(done: Column, line: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["level"].alias("level"), F.concat(last["text"], F.lit("\n"), line["line"]).alias("text"))
        fresh = F.struct(line["level"].alias("level"), line["line"].alias("text"))
        return F.when(last["level"] == line["level"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(fresh)))

    plain = F.array(F.struct(F.lit(0).cast("int").alias("level"), F.coalesce("text", F.lit("")).alias("text")))
    has_quote = F.coalesce(F.col("text").rlike(f"(?m){QUOTE}"), F.lit(False))
    passages = F.when(has_quote, F.aggregate(lines, empty, add)).otherwise(plain)
    following = F.transform(F.slice(F.col("passages"), 2, F.size("passages")), lambda p: p["level"])

    def own_lines(passage: Column, following: Column) -> Column:
        """The lines of a passage that is no quote, each after a line feed; an announcement stands directly before a quote."""
        text = F.concat(F.lit("\n"), passage["text"])
        return F.when(passage["level"] == 0, F.when(following > 0, F.regexp_replace(text, ANNOUNCED, "")).otherwise(text))

    own = F.substring(F.array_join(F.zip_with("passages", following, own_lines), ""), 2, 2**31 - 1)
    deepest = F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0))
    return messages.withColumn("passages", passages).withColumn("own", F.trim(own)).withColumn("depth", deepest)


def running(df: DataFrame, group: list[str], order: list[str], **totals: tuple[str, str, bool]) -> DataFrame:
    """Add running totals in the order of ``group + order``; each is (function, column, whether the row itself counts).

    The rows are range-sorted and stored; within a sorted block a window does the work, and the totals of the blocks
    before it come from a table with one row per block and group.
    """
    places = df.orderBy(*group, *order).withColumn("__place", F.monotonically_increasing_id())
    rows = store(places, "sorted").withColumn("__block", F.shiftright("__place", 33))
    function = {"max": F.max, "sum": F.sum}
    blocks = rows.groupBy(*group, "__block").agg(*[function[f](c).alias(f"__{name}") for name, (f, c, _) in totals.items()])
    before = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*group, "__block", *[function[f](f"__{name}").over(before).alias(f"__{name}") for name, (f, _, _) in totals.items()])
    names = [f"__g{i}" for i in range(len(group))]
    carried = carried.select(*[F.col(g).alias(n) for g, n in zip(group, names)], F.col("__block").alias("__b"), *[f"__{name}" for name in totals])
    same = F.col("__block") == F.col("__b")
    for g, n in zip(group, names):
        same = same & F.col(g).eqNullSafe(F.col(n))
    out = rows.join(carried, same, "left")
    for name, (f, c, itself) in totals.items():
        inside = function[f](c).over(Window.partitionBy(*group, "__block").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0 if itself else -1))
        both = F.greatest(inside, f"__{name}") if f == "max" else F.coalesce(inside, F.lit(0)) + F.coalesce(f"__{name}", F.lit(0))
        out = out.withColumn(name, both)
    return out.drop("__place", "__block", "__b", *names, *[f"__{name}" for name in totals])


def _sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def _normal_pieces(pieces: Column) -> Column:
    """The distinct normalised pieces that are not empty."""
    return F.array_distinct(F.filter(F.transform(pieces, normalised), lambda p: F.length(p) > 0))


def linked_quotes(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, level, hash, source_turn``: every different quoted passage of a message with the turn it comes from, or null."""
    quoted = messages.filter("depth > 0").select("conv_id", "turn", F.explode("passages").alias("p")).filter("p.level > 0")
    quoted = quoted.select("conv_id", "turn", F.col("p.level").alias("level"), F.col("p.text").alias("text")).filter(F.length(normalised(F.col("text"))) > 0)
    quoted = quoted.withColumn("passage", F.xxhash64(normalised(F.col("text"))))
    whole = quoted.select("conv_id", "turn", "level", "passage", F.col("passage").alias("hash"), F.lit(2).alias("tells"))
    parts = quoted.select("conv_id", "turn", "level", "passage", F.explode(_normal_pieces(_sentences(F.col("text")))).alias("piece"))
    long_enough = (F.length("piece") >= MIN_CHARS).cast("int")
    parts = parts.select("conv_id", "turn", "level", "passage", F.xxhash64("piece").alias("hash"), long_enough.alias("tells"))
    wanted = store(whole.unionAll(parts).distinct(), "quotes")
    own = F.col("own")
    pieces = F.concat(F.array(own), F.split(own, r"\n[ \t]*\n"), F.split(own, r"\n"), _sentences(own))
    sources = messages.select("conv_id", "turn", F.explode(F.transform(_normal_pieces(pieces), lambda p: F.xxhash64(p))).alias("hash"))
    sources = sources.join(wanted.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").distinct()
    # a source stands after the quotes of its own turn, so a quote only sees turns before it
    events = wanted.withColumn("kind", F.lit(0)).withColumn("source", F.lit(None).cast("long")).unionByName(
        sources.withColumn("kind", F.lit(1)).withColumn("source", F.col("turn").cast("long")), allowMissingColumns=True
    )
    seen = running(events, ["conv_id", "hash"], ["turn", "kind"], latest=("max", "source", True)).filter("kind = 0")
    return seen.groupBy("conv_id", "turn", "level", F.col("passage").alias("hash")).agg(
        F.coalesce(*[F.max(F.when(F.col("tells") == tells, F.col("latest"))) for tells in (2, 1, 0)]).alias("source_turn")
    )


def reply_links(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_to, n_quotes, n_linked`` per turn with quotes: it answers the latest source of its least nested linked quotes."""
    quotes = linked_quotes(messages)
    found = F.when(F.col("source_turn").isNotNull(), F.struct((-F.col("level")).alias("level"), "source_turn"))
    return quotes.groupBy("conv_id", "turn").agg(
        F.max(found)["source_turn"].alias("reply_to"), F.count(F.lit(1)).alias("n_quotes"), F.count("source_turn").alias("n_linked")
    )


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """``conv_id, position, turn, role, reply_to, thread, depth, n_quotes, n_linked, content`` per row of ``conversations (conv_id, turn, role, text)``.

    ``reply_to`` is the linked turn, else the largest turn before it in the conversation, else null; ``depth`` is the
    deepest quote level. ``thread`` is the turn that begins the branch: a message that answers an earlier one than its
    predecessor begins one. Positions count from 0 by thread, then turn, role and content, so a branch stays together.
    ``content`` is the message without quotes and without the lines directly before them (but for blank lines) that announce them.

    Null texts are empty messages. A null turn sorts first and answers nothing. Rows with a null conversation are
    numbered one by one, each a conversation of its own. Repeated rows stay as many rows, in a fixed order among equals.
    Extra columns are ignored; an empty table gives an empty table.
    """
    messages = parsed(conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"))
    known = messages.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    replies = reply_links(known)
    turns = known.select("conv_id", "turn").distinct()
    before = running(turns, ["conv_id"], ["turn"], previous=("max", "turn", False))
    placed = before.join(replies, ["conv_id", "turn"], "left").withColumn("reply_to", F.coalesce("reply_to", "previous"))
    begins = F.col("previous").isNull() | (F.col("reply_to") != F.col("previous"))
    placed = placed.withColumn("branch", F.when(begins, F.col("turn"))).select("conv_id", "turn", "reply_to", "n_quotes", "n_linked", "branch")
    placed = running(placed, ["conv_id"], ["turn"], thread=("max", "branch", True)).drop("branch")
    placed = placed.select(*[F.col(c).alias(f"p_{c}") for c in placed.columns])
    joined = messages.join(placed, (F.col("conv_id") == F.col("p_conv_id")) & (F.col("turn") == F.col("p_turn")), "left")
    ordered = running(joined.withColumn("one", F.lit(1)), ["conv_id"], ["p_thread", "turn", "role", "own"], position=("sum", "one", False))
    return ordered.select(
        "conv_id", F.when(F.col("conv_id").isNull(), 0).otherwise(F.col("position")).cast("int").alias("position"), "turn", "role",
        F.col("p_reply_to").alias("reply_to"), F.col("p_thread").alias("thread"), "depth",
        F.coalesce("p_n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("p_n_linked", F.lit(0)).alias("n_linked"), F.col("own").alias("content"),
    )
