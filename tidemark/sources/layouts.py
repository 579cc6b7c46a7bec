"""Tables of apps joined by declaration: which tables and columns, by which keys, over how many hops, in which of several layouts.

A layout is data. Apps rename tables and columns from version to version, so each is given by the names it may have, and what
is there decides. Every hop is a left join on a key that was made one row a key before, so no row of the base is lost or doubled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, text, timex
from ..operators import participants
from ..operators.tables import checkpointed
from .artifacts import content_id, in_schema

Names = tuple[str, ...]


@dataclass(frozen=True)
class Hop:
    """A table that rows so far are looked up in.

    here: a column taken so far; there: the names its partner may have; take: new columns and the names each may have. every: all partners'
    values as a sorted array and not those of one. Of several partners the one of most confidence is taken, then the last by its values.
    """

    tables: Names
    here: str
    there: Names
    take: Mapping[str, Names]
    every: bool = False


@dataclass(frozen=True)
class Layout:
    """tables: names that the base may have; needs: what must be there too for the layout to be this one."""

    name: str
    tables: Names
    take: Mapping[str, Names]
    hops: tuple[Hop, ...] = field(default=())
    needs: tuple[Names, ...] = field(default=())


def _found(tables: Mapping[str, DataFrame], names: Names) -> DataFrame | None:
    known = {n.lower(): df for n, df in tables.items()}
    return next((known[n.lower()] for n in names if n.lower() in known), None)


def _picked(df: DataFrame, names: Names) -> Column:
    """The first of the columns that isn't null or blank, as text where they differ; null if there is none."""
    there = {c.lower(): c for c in df.columns}
    own = [F.col(f"`{there[n.lower()]}`") for n in names if n.lower() in there]
    kinds = {df.schema[there[n.lower()]].dataType.simpleString() for n in names if n.lower() in there}
    if not own:
        return F.lit(None).cast("string")
    own = [c.cast("string") for c in own] if len(kinds) > 1 else own
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in own)) if kinds == {"string"} or len(kinds) > 1 else F.coalesce(*own)


def _sureness(df: DataFrame) -> Column:
    return F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)) if "confidence" in df.columns else F.lit(1.0)


def chosen(layouts: Sequence[Layout], tables: Mapping[str, DataFrame]) -> Layout | None:
    """The first layout whose base, and whatever else it needs, is among the tables."""
    return next((x for x in layouts if _found(tables, x.tables) is not None and all(_found(tables, n) is not None for n in x.needs)), None)


#: Bytes of partners, roughly counted, that are sent to every task; with more the rows are shuffled to their partners.
SENT = 64_000_000


def _same(df: DataFrame, here: str, other: DataFrame, there: str) -> Column:
    """Equal keys, as text where they differ in type."""
    if df.schema[here].dataType == other.schema[there].dataType:
        return F.col(here) == F.col(there)
    return F.col(here).cast("string") == F.col(there).cast("string")


def _asked(rows: DataFrame, here: str, held: DataFrame) -> DataFrame:
    """held (_there ...), or the part of it that rows ask for if that is little, to be sent to every task."""
    row_bytes = 64
    if here not in rows.columns or rows.agg(F.approx_count_distinct(here)).first()[0] > SENT // row_bytes:
        return held
    keys_of = rows.select(F.col(here).alias("_here")).filter("_here is not null").distinct()
    found = checkpointed(held.join(keys_of, _same(keys_of, "_here", held, "_there"), "left_semi"))
    size = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in found.columns), F.lit(row_bytes))
    return F.broadcast(found) if (found.agg(F.sum(size)).first()[0] or 0) <= SENT else found


def _along(rows: DataFrame, sure: str, hops: Sequence[Hop], tables: Mapping[str, DataFrame]) -> DataFrame:
    """rows with all columns that hops take, and sure lowered to the least of what they came from.

    A hop from a column of another hop is made in that one's table, so that rows are shuffled once for both, or not at all.
    """
    made, left = rows, list(hops)
    while left:
        hop = left.pop(0)
        other = _found(tables, hop.tables)
        if other is None:
            made = made.withColumns({c: F.lit(None).cast("array<string>" if hop.every else "string") for c in hop.take})
            continue
        found = other.select(_picked(other, hop.there).alias("_key"), *(_picked(other, n).alias(c) for c, n in hop.take.items()), _sureness(other).alias("_own")).filter("_key is not null")
        key = F.col("_key").alias("_there")
        if hop.every:
            held = found.groupBy(key).agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in hop.take), F.min("_own").alias("_least"))
        else:
            further, known = [], set(hop.take)
            for h in left:  # and those that go on from these
                if h.here in known:
                    further.append(h)
                    known |= set() if h.every else set(h.take)
            left = [h for h in left if h not in further]
            found = _along(found.withColumn("_whole", F.col("_own")), "_whole", further, tables)
            # what further hops take is the same for the same row, and decides nothing
            taken = [*hop.take, *(c for h in further for c in h.take)]
            best = F.max(F.struct("_own", *taken, "_whole")).alias("_b")
            held = found.groupBy(key).agg(best).select("_there", *(F.col(f"_b.{c}").alias(c) for c in taken), F.col("_b._whole").alias("_least"))
        held = _asked(rows, hop.here, held)
        made = made.join(held, _same(made, hop.here, held, "_there"), "left").withColumn(sure, F.least(sure, F.coalesce("_least", F.lit(1.0)))).drop("_there", "_least")
    return made


def joined(layout: Layout, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of the base with all columns taken, recovery, and confidence: the least of all rows that contributed.

    Tables of hops that aren't there give nulls. Tables may have recovery and confidence of their own rows; those without are taken as sure.
    """
    base = _found(tables, layout.tables)
    if base is None:
        raise ValueError(f"no table of {layout.name}: {', '.join(layout.tables)}")
    recovery = F.coalesce("recovery", F.lit("allocated")) if "recovery" in base.columns else F.lit("allocated")
    made = base.select(*(_picked(base, n).alias(c) for c, n in layout.take.items()), recovery.alias("recovery"), _sureness(base).alias("confidence"))
    return _along(made, "confidence", layout.hops, tables).select(*made.columns, *(c for h in layout.hops for c in h.take))


def _first(*columns: str) -> Column:
    return F.coalesce(*(F.nullif(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("")) for c in columns), F.lit(""))


# Tables and columns of a messenger of two generations, of its calls, of text messages and of mail.
MESSENGER = (
    Layout(
        "messenger, new", ("message",),
        {"row": ("_id",), "chat": ("chat_row_id",), "sender": ("sender_jid_row_id",), "mine": ("from_me",), "at": ("timestamp",), "body": ("text_data",)},
        (
            Hop(("chat",), "chat", ("_id",), {"chat_jid": ("jid_row_id",), "subject": ("subject",)}),
            Hop(("jid",), "chat_jid", ("_id",), {"chat_account": ("raw_string",), "chat_user": ("user",)}),
            Hop(("jid",), "sender", ("_id",), {"sender_account": ("raw_string",), "sender_user": ("user",)}),
        ),
        (("chat",), ("jid",)),
    ),
    Layout(
        "messenger, old", ("messages",),
        {"row": ("_id",), "chat_account": ("key_remote_jid",), "sender_account": ("remote_resource",), "mine": ("key_from_me",), "at": ("timestamp",), "body": ("data", "media_caption")},
        (Hop(("chat_list", "chat_view"), "chat_account", ("key_remote_jid",), {"subject": ("subject",)}),),
    ),
)
MESSENGER_CALLS = (
    Layout(
        "messenger calls", ("call_log", "call_logs"),
        {"row": ("_id",), "sender": ("jid_row_id",), "mine": ("from_me",), "at": ("timestamp",), "seconds": ("duration",), "video": ("video_call",)},
        (Hop(("jid",), "sender", ("_id",), {"sender_account": ("raw_string",), "sender_user": ("user",)}),),
    ),
)
SHORT_MESSAGES = (
    Layout(
        "short messages", ("sms", "message_table"),
        {"row": ("_id",), "thread": ("thread_id",), "number": ("address",), "kind": ("type",), "at": ("date",), "sent": ("date_sent",), "body": ("body",)},
        (
            Hop(("threads", "conversations"), "thread", ("_id",), {"recipients": ("recipient_ids",)}),
            Hop(("canonical_addresses",), "recipients", ("_id",), {"thread_number": ("address",)}),
        ),
    ),
)
MAIL = (
    Layout(
        "mail", ("messages", "Message"),
        {"row": ("_id", "id"), "box": ("mailboxKey", "mailbox_id"), "at": ("timeStamp", "date_received"), "subject": ("subject",), "sender": ("fromList", "sender"), "body": ("snippet",)},
        (
            Hop(("Mailbox", "mailboxes"), "box", ("_id", "id"), {"account": ("accountKey", "account_id"), "folder": ("displayName", "name")}),
            Hop(("Account", "accounts"), "account", ("_id", "id"), {"address": ("emailAddress", "address")}),
            Hop(("recipients",), "row", ("message_id", "messageKey"), {"to": ("address",)}, every=True),
        ),
        (("Mailbox", "mailboxes"),),
    ),
)


def _number(c: Column) -> Column:
    return F.coalesce(F.nullif(text.clean_number(c), F.lit("")), c)


def _as_artifacts(rows: DataFrame, layout: str, **given: Column) -> DataFrame:
    own = content_id(F.lit(layout), F.col("row"), F.col("at"), F.coalesce(given["body"], F.lit("")))
    given["participants"] = given["participants"].cast(participants.TYPE)
    return in_schema(rows, artifact_id=own, confidence=F.col("confidence"), recovery=F.col("recovery"), source_row=F.col("row").cast("long"), **given)


def _party_list(mine: Column, other: Column, name: Column) -> Column:
    """The owner, and the other side if it is known."""
    owner = F.struct(F.lit("owner").alias("role"), F.lit("").alias("identifier"), F.lit("").alias("name"), F.lit(True).alias("is_owner"))
    role = F.when(mine, "to").otherwise("from")
    them = F.struct(role.alias("role"), other.alias("identifier"), name.alias("name"), F.lit(False).alias("is_owner"))
    return F.when(other != "", F.array(owner, them)).otherwise(F.array(owner))


def messages(tables: Mapping[str, DataFrame], exhibit: str = "", app: str = "Messenger") -> DataFrame:
    """Chats of a messenger in either layout, with participants: the owner, and the sender if a member of a group wrote, else the chat."""
    layout = chosen(MESSENGER, tables)
    if layout is None:
        raise ValueError("no layout of the messenger fits")
    rows = joined(layout, tables)
    mine = F.coalesce(F.col("mine").cast("int"), F.lit(0)) == 1
    other = F.when(mine, _first("chat_account")).otherwise(_first("sender_account", "chat_account"))
    return _as_artifacts(
        rows, layout.name, exhibit=F.lit(exhibit), category=F.lit("Chats"), subtype=F.lit("Message"), app=F.lit(app), timestamp=timex.guess(F.col("at").cast("long"), "timestamp"),
        direction=F.when(mine, "outgoing").otherwise("incoming"), body=_first("body"), party=_key(other), source_table=F.lit(layout.tables[0]),
        attributes=F.to_json(F.struct(_first("chat_account").alias("chat"), _first("subject").alias("subject"))), participants=_party_list(mine, other, _first("subject")),
    )


def _key(account: Column) -> Column:
    return keys.graph_key(account, F.lit(False))


def calls(tables: Mapping[str, DataFrame], exhibit: str = "", app: str = "Messenger") -> DataFrame:
    """Calls of a messenger with their seconds."""
    layout = chosen(MESSENGER_CALLS, tables)
    if layout is None:
        raise ValueError("no layout of the messenger's calls fits")
    rows = joined(layout, tables)
    mine = F.coalesce(F.col("mine").cast("int"), F.lit(0)) == 1
    other, begun = _first("sender_account"), timex.guess(F.col("at").cast("long"), "timestamp")
    seconds = F.coalesce(F.col("seconds").cast("long"), F.lit(0))
    kind = F.when(F.coalesce(F.col("video").cast("int"), F.lit(0)) == 1, "Video call").otherwise("Voice call")
    return _as_artifacts(
        rows, layout.name, exhibit=F.lit(exhibit), category=F.lit("Calls"), subtype=kind, app=F.lit(app), timestamp=begun, timestamp_end=F.when(seconds > 0, begun + seconds * 1_000_000),
        direction=F.when(mine, "outgoing").otherwise("incoming"), body=F.concat_ws(" ", kind, F.lit("with"), F.coalesce(F.nullif(other, F.lit("")), F.lit("unknown"))), party=_key(other),
        source_table=F.lit(layout.tables[0]), attributes=F.to_json(F.struct(seconds.alias("duration_seconds"))), participants=_party_list(mine, other, F.lit("")),
    )


def short_messages(tables: Mapping[str, DataFrame], exhibit: str = "") -> DataFrame:
    """Text messages; the number is the message's own, else that of its thread, two tables away."""
    rows = joined(SHORT_MESSAGES[0], tables)
    kind = F.col("kind").cast("int")
    way = F.when(kind == 1, "incoming").when(kind.isin(2, 4, 5, 6), "outgoing").when(kind == 3, "draft").otherwise("unknown")
    other = _number(_first("number", "thread_number"))
    return _as_artifacts(
        rows, "short messages", exhibit=F.lit(exhibit), category=F.lit("Messages"), subtype=F.lit("SMS"), app=F.lit("Messages"), timestamp=timex.guess(F.col("at").cast("long"), "date"), direction=way,
        body=_first("body"), party=_key(other), source_table=F.lit("sms"), attributes=F.to_json(F.struct(F.col("thread").cast("string").alias("thread_id"))), participants=_party_list(way == "outgoing", other, F.lit("")),
    )


def mail(tables: Mapping[str, DataFrame], exhibit: str = "") -> DataFrame:
    """Mail with the account of its folder, two tables away, and all its recipients; outgoing if its sender is the account."""
    rows = joined(MAIL[0], tables)
    sender, own = _first("sender"), _first("address")
    mine = (own != "") & F.contains(F.lower(sender), F.lower(own))
    to = F.coalesce("to", F.array().cast("array<string>"))
    struct = lambda role, who: F.struct(F.lit(role).alias("role"), who.alias("identifier"), F.lit("").alias("name"), (F.lower(who) == F.lower(own)).alias("is_owner"))
    parties = F.concat(F.array(struct("from", sender)), F.transform(to, lambda x: struct("to", x)))
    return _as_artifacts(
        rows, "mail", exhibit=F.lit(exhibit), category=F.lit("Messages"), subtype=F.lit("Mail"), app=F.lit("Mail"), timestamp=timex.guess(F.col("at").cast("long"), "timestamp"),
        direction=F.when(mine, "outgoing").otherwise("incoming"), body=_first("subject", "body"), party=_key(F.when(mine, F.coalesce(F.get(to, F.lit(0)), F.lit(""))).otherwise(sender)),
        source_table=F.lit("messages"), attributes=F.to_json(F.struct(_first("folder").alias("folder"), own.alias("account"))), participants=parties,
    )
