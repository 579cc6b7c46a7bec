"""Tables of apps, exported as DataFrames, joined into artifacts. Each join is left and on the app's own keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, text, timex
from .artifacts import content_id, in_schema

#: Kinds of data rows of the contacts provider, by what their mimetype ends in.
KINDS = {"name": "/name", "phone": "/phone_v2", "email": "/email_v2", "organisation": "/organization", "note": "/note", "website": "/website"}


def _first(*columns: str | Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*(F.nullif(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), F.lit("")) for c in columns), F.lit(""))


def android_contacts(raw_contacts: DataFrame, data: DataFrame, mimetypes: DataFrame, exhibit: str = "") -> DataFrame:
    """Contacts of raw_contacts (_id, display_name, account_type), data (raw_contact_id, mimetype_id, data1) and mimetypes (_id, mimetype).

    The data rows of a contact are gathered by kind first, so each contact meets one row. Contacts with neither name, number
    nor address are left out. The party is the key of the first number, else of the first address, else of the name.
    """
    kind = F.lit(None).cast("string")
    for name, end in KINDS.items():
        kind = F.when(F.endswith("mimetype", F.lit(end)), name).otherwise(kind)
    named = data.join(F.broadcast(mimetypes.select(F.col("_id").alias("mimetype_id"), kind.alias("kind"))), "mimetype_id")  # a list of kinds, some tens of rows
    listed = F.array_sort(F.collect_set(F.when(F.trim("data1") != "", F.trim("data1"))))
    held = named.filter("kind is not null").groupBy("raw_contact_id").pivot("kind", list(KINDS)).agg(listed)
    met = raw_contacts.join(held, F.col("_id") == F.col("raw_contact_id"), "left")
    one = lambda c: F.get(c, F.lit(0))
    shown = _first("display_name", one("name"))
    number, address = F.coalesce(one("phone"), F.lit("")), F.coalesce(one("email"), F.lit(""))
    body = _first(shown, number)
    attributes = F.to_json(F.struct(shown.alias("display_name"), F.col("phone").alias("phone_numbers"), F.col("email").alias("emails"), *(F.col(c) for c in ("organisation", "note", "website"))))
    return in_schema(
        met.filter((shown != "") | (number != "") | (address != "")), artifact_id=content_id(F.lit("android.contacts"), F.col("_id"), body), exhibit=F.lit(exhibit),
        category=F.lit("Contacts"), subtype=F.lit("Contact"), app=_first("account_type", F.lit("Android Contacts")), body=body,
        party=keys.party_key(_first(number, address), shown), attributes=attributes, source_table=F.lit("raw_contacts"), source_row=F.col("_id").cast("long"),
    )


def safari_history(history_items: DataFrame, history_visits: DataFrame, exhibit: str = "") -> DataFrame:
    """Visited pages of history_items (id, url, visit_count) with the latest visit of each (history_item, visit_time in Apple seconds, title)."""
    latest = history_visits.groupBy("history_item").agg(F.max(F.struct("visit_time", "title")).alias("v"))
    met = history_items.filter("url <> ''").join(latest, F.col("id") == F.col("history_item"), "left")
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)
    return in_schema(
        met, artifact_id=content_id(F.lit("ios.safari"), F.col("id"), F.col("url")), exhibit=F.lit(exhibit), category=F.lit("Web"), subtype=F.lit("Visited page"), app=F.lit("Safari"),
        timestamp=timex.from_epoch(F.col("v.visit_time"), "apple_s"), body=_first("v.title", "url"), attributes=F.to_json(F.struct("url", host.alias("domain"), F.col("v.title").alias("title"), "visit_count")),
        source_table=F.lit("history_items"), source_row=F.col("id").cast("long"),
    )


def ios_messages(message: DataFrame, handle: DataFrame, chat_message: DataFrame, chat_handle: DataFrame, exhibit: str = "") -> DataFrame:
    """Messages of message (ROWID, text, handle_id, is_from_me, date in Apple nanoseconds) with their party and the members of their chat.

    handle (ROWID, id), chat_message (chat_id, message_id) and chat_handle (chat_id, handle_id) are the app's tables. The party is the
    handle's, else the chat's first member; the members of a chat are gathered once and met by its messages.
    """
    who = handle.select(F.col("ROWID").alias("handle_id"), F.coalesce(F.nullif(text.clean_number(F.col("id")), F.lit("")), F.col("id")).alias("ident"))
    members = chat_handle.join(who, "handle_id").filter("ident <> ''").groupBy("chat_id").agg(F.array_sort(F.collect_set("ident")).alias("members"))
    chat_of = chat_message.groupBy(F.col("message_id").alias("ROWID")).agg(F.max("chat_id").alias("chat_id"))
    met = message.join(who, "handle_id", "left").join(chat_of, "ROWID", "left").join(members, "chat_id", "left")
    party = _first("ident", F.get("members", F.lit(0)))
    return in_schema(
        met, artifact_id=content_id(F.lit("ios.sms"), F.col("ROWID"), F.col("text")), exhibit=F.lit(exhibit), category=F.lit("Messages"), subtype=F.lit("Message"), app=F.lit("iMessage"),
        timestamp=timex.from_epoch(F.col("date"), "apple_ns"), direction=F.when(F.col("is_from_me") == 1, "outgoing").otherwise("incoming"), body=F.coalesce("text", F.lit("")),
        party=keys.party_key(party), attributes=F.to_json(F.struct("chat_id", "members")), source_table=F.lit("message"), source_row=F.col("ROWID").cast("long"),
    )
