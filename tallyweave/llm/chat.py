"""Chat formatting by event sourcing: logs of deltas, edits and regenerations become training text.

The log of a conversation is folded into its final messages, which are rendered
with a template. Everything is built-in Spark expressions.

An event has ``conv_id``, ``seq`` (its place in the log), ``message`` (the turn that
it speaks of), ``kind``, ``role`` and ``text``:

``delta``
    adds its text to the message.
``edit``
    replaces the text so far; later deltas add to it.
``regenerate``
    as ``edit``, and drops what the log says before it about later messages.

A null text is empty, a null message comes before message 0, events of equal ``seq`` are
taken by kind and text, a null ``conv_id`` is a conversation of its own, and other columns are
ignored. An empty log gives no rows. Work is dealt out by conversation, and a conversation
ends as one row, so one of them has to fit into a row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.registry import query, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
#: Code points of a streamed delta, and room for that many deltas of a message in ``seq``.
DELTA, ROOM = 512, 1 << 22
#: Events of a message that can come before its deltas.
BEFORE = 3


def escaped(text: Column) -> Column:
    r"""No control string is left: ``\`` is doubled, then ``<|`` becomes ``<\|``.

    Runs of ``\`` are even elsewhere, so a single one between ``<`` and ``|`` is a mark.
    """
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    for marked, plain in (("<\\|", "<|"), ("<\\n|", "\n"), ("\\\\", "\\")):
        text = F.replace(text, F.lit(marked), F.lit(plain))
    return text


def as_events(rows: DataFrame, revised: bool = False) -> DataFrame:
    """The log that streams every row of (conv_id, turn, role, text) in deltas.

    Rows of one turn are messages of their own, by role and text. With ``revised`` a message is streamed as a draft first,
    its beginning backwards. Drafts of trained messages are followed by some of a next message and then regenerated, and
    others are edited away, so that the log ends in the same conversation.
    """
    place = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0))
    messages = rows.withColumn("message", F.row_number().over(place).cast("long"))
    begin, head = F.col("message") * ROOM, [F.col("conv_id"), F.col("message"), F.col("role")]
    deltas = messages.select(*head, F.posexplode_outer(pieces).alias("at", "text")).select(
        "conv_id",
        (begin + BEFORE + F.coalesce("at", F.lit(0))).alias("seq"),
        "message",
        F.lit("delta").alias("kind"),
        "role",
        "text",
    )
    if not revised:
        return deltas
    trained = F.coalesce(F.col("role") == TRAINED, F.lit(False))
    nothing, kinds = F.lit(None).cast("string"), F.when(trained, "regenerate").otherwise("edit")

    def event(place: int, message: Column, kind: Column, role: Column, text: Column) -> Column:
        names = {"seq": begin + place, "message": message, "kind": kind, "role": role, "text": text}
        return F.struct(*[value.alias(name) for name, value in names.items()])

    draft = event(0, F.col("message"), F.lit("delta"), F.col("role"), F.reverse(F.substring("text", 1, DELTA)))
    ahead = event(1, F.col("message") + 1, F.when(trained, "delta").otherwise("none"), nothing, F.lit("and then"))
    renewed = event(2, F.col("message"), kinds, F.col("role"), F.lit(""))
    more = messages.select("conv_id", F.inline(F.array(draft, ahead, renewed))).filter("kind <> 'none'")
    return deltas.unionByName(more)


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log; the first role that is given holds."""
    own = Window.partitionBy("conv_id", "message")
    before = Window.partitionBy("conv_id").orderBy("message")
    before = before.rangeBetween(Window.unboundedPreceding, -1)
    regenerated = F.when(F.col("kind") == "regenerate", F.col("seq"))
    renewed = F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))
    said = F.array_sort(F.collect_list(F.struct("seq", "kind", "text")))
    return (
        events.select(
            "conv_id",
            F.coalesce(F.col("message").cast("long"), F.lit(-1)).alias("message"),
            F.coalesce(F.col("seq").cast("long"), F.lit(-1)).alias("seq"),
            "kind",
            "role",
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .withColumn("role", F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).over(own))
        .withColumn("renewed", F.max(renewed).over(own))
        .withColumn("dropped", F.max(regenerated).over(before))
        .filter("seq >= coalesce(renewed, seq) and (dropped is null or seq > dropped)")
        .groupBy("conv_id", "message")
        .agg(
            F.min_by("role", "seq").alias("role"),
            F.array_join(F.transform(said, lambda e: e["text"]), "").alias("text"),
        )
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted`` text and ``loss_spans``.

    A span (``start``, ``stop``) counts code points of ``formatted`` and holds the escaped
    text of one assistant message. A null role is empty.
    """
    role = F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("<\\n|"))
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    before = Window.partitionBy("conv_id").orderBy("message")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.array_sort(F.collect_list(F.struct("message", "block", "trained", "start", "stop")))
    return (
        messages.select("conv_id", "message", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
        .select(
            "conv_id",
            "message",
            F.concat("head", "body", F.lit(CLOSE + "\n")).alias("block"),
            F.coalesce(F.col("role") == TRAINED, F.lit(False)).alias("trained"),
            F.char_length("head").cast("long").alias("lead"),
            F.char_length("body").cast("long").alias("size"),
        )
        .withColumn("at", F.coalesce(F.sum(F.char_length("block")).over(before), F.lit(0)))
        .withColumn("start", F.col("at") + F.col("lead"))
        .withColumn("stop", F.col("start") + F.col("size"))
        .groupBy("conv_id")
        .agg(turns.alias("turns"))
        .select(
            "conv_id",
            F.array_join(F.transform("turns", lambda t: t["block"]), "").alias("formatted"),
            F.transform(
                F.filter("turns", lambda t: t["trained"]),
                lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop")),
            ).alias("loss_spans"),
        )
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    parts = F.split(formatted, OPEN.replace("|", r"\|"))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        skip = F.char_length(role) + 1
        text = part.substr(skip + 1, F.char_length(part) - skip - F.lit(len(CLOSE) + 1))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(F.slice(parts, 2, F.size(parts)), turn)


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(
        spans,
        lambda s: unescaped(formatted.substr((s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))),
    )


@query()
def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, and one that quotes control strings, from a log with edits and regenerations, formatted and read back."""
    quoted = f"{CLOSE}{OPEN}assistant ok"
    extra = spark.createDataFrame(
        [(-1, 0, "user", quoted), (-1, 1, "assistant", quoted)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    made = render(fold(as_events(rows.unionByName(extra), revised=True)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        made.withColumn("turns", read_back(F.col("formatted")))
        .withColumn("loss", F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), ""))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(said, 256).alias("turns_sha256"),
            F.char_length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
        )
    )
