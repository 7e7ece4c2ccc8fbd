"""Reading a session page by page."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_ROWS, MOST_CHARS = 100, 200_000


class InvalidPage(ValueError):
    """A page request or cursor that can't be served."""


@dataclass(frozen=True)
class Position:
    """Where to go on: after message ``message_id`` at ``ordinal`` (offset 0), or inside it (offset above 0)."""

    ordinal: int
    message_id: str = ""
    offset: int = 0

    def encode(self) -> str:
        body = json.dumps({"v": 1, "o": self.ordinal, "m": self.message_id, "c": self.offset}, sort_keys=True, separators=(",", ":"))
        return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")

    @staticmethod
    def decode(cursor: str) -> Position:
        try:
            body = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        except (ValueError, UnicodeDecodeError) as e:
            raise InvalidPage("the cursor can't be read") from e
        if not isinstance(body, dict) or set(body) != {"v", "o", "m", "c"} or body["v"] != 1 or not isinstance(body["m"], str):
            raise InvalidPage("the cursor has another shape")
        if any(isinstance(body[k], bool) or not isinstance(body[k], int) or body[k] < 0 for k in "oc"):
            raise InvalidPage("the cursor's numbers are out of range")
        return Position(body["o"], body["m"], body["c"])


def read_page(messages: DataFrame, session_id: str, position: Position | None = None, limit: int = 20, max_chars: int = 4000) -> DataFrame:
    """The next messages of a session within ``limit`` rows and ``max_chars`` characters.

    Columns: ordinal, message_id, role, search_class, text, text_offset,
    text_total_chars, complete_message. A message that doesn't fit is cut when
    it is the first of the page and left to the next page otherwise.
    """
    if not 1 <= limit <= MOST_ROWS or not 1 <= max_chars <= MOST_CHARS:
        raise InvalidPage("the limits are out of range")
    own = messages.where((F.col("session_id") == session_id) & F.col("search_class").isin("dialogue", "evidence", "trace") & (F.col("text") != ""))
    own = own.select("ordinal", F.coalesce("message_id", "local_identity").alias("message_id"), "role", "search_class", "text")
    offset = F.lit(0)
    if position is not None:
        same = (F.col("ordinal") == position.ordinal) & (F.col("message_id") == position.message_id)
        later = (F.col("ordinal") > position.ordinal) | ((F.col("ordinal") == position.ordinal) & (F.col("message_id") > position.message_id))
        own = own.where(later | same if position.offset else later)
        offset = F.when(same, position.offset).otherwise(0)
    own = own.withColumn("text_total_chars", F.length("text").cast("bigint")).withColumn("text_offset", offset.cast("bigint"))
    own = own.withColumn("_left", F.col("text_total_chars") - F.col("text_offset")).orderBy("ordinal", "message_id").limit(limit)
    page = Window.partitionBy(F.lit(0)).orderBy("ordinal", "message_id").rowsBetween(Window.unboundedPreceding, 0)  # at most ``limit`` rows
    own = own.withColumn("_sum", F.sum("_left").over(page)).withColumn("_first", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ordinal", "message_id")) == 1)
    own = own.where((F.col("_sum") <= max_chars) | F.col("_first"))
    text = F.substring(F.col("text"), (F.col("text_offset") + 1).cast("int"), F.least(F.col("_left"), F.lit(max_chars)).cast("int"))
    return own.select("ordinal", "message_id", "role", "search_class", text.alias("text"), "text_offset", "text_total_chars", (F.col("_left") <= max_chars).alias("complete_message"))


def next_position(page: DataFrame) -> Position | None:
    """The position after a page of :func:`read_page`, None if the page was empty."""
    rows = page.orderBy("ordinal", "message_id").collect()  # at most MOST_ROWS
    if not rows:
        return None
    r = rows[-1]
    return Position(r["ordinal"], r["message_id"], 0 if r["complete_message"] else r["text_offset"] + len(r["text"]))


def local_page(messages: DataFrame, stamp: str, session_id: str, limit: int = 20, max_chars: int = 16_000, start_ordinal: int = 0, cursor: str | None = None) -> dict:
    """The next portion of a session by bytes: messages, has_more, next_cursor.

    ``stamp`` names the state of the table (:func:`stratalog.shared.state_of`);
    a cursor made under another stamp is stale and fails. Slices begin at byte
    offsets and end at whole characters; only so many bytes of a text are read
    as the characters left can need.
    """
    if not session_id or len(session_id) > 512 or not 1 <= limit <= MOST_ROWS or not 1 <= max_chars <= 100_000 or start_ordinal < 0:
        raise InvalidPage("the request is out of bounds")
    if cursor is not None and start_ordinal:
        raise InvalidPage("a cursor and a start")
    revision = hashlib.sha256(stamp.encode()).hexdigest()
    ordinal, offset, byte_offset = start_ordinal, 0, 0
    if cursor is not None:
        own = _local_cursor(cursor)
        if own["s"] != session_id:
            raise InvalidPage("the cursor is of another session")
        if own["rev"] != revision:
            raise InvalidPage("the cursor is stale")
        ordinal, offset, byte_offset = own["o"], own["offset"], own["byte_offset"]
    rows = messages.where((F.col("session_id") == session_id) & (F.col("ordinal") >= ordinal))
    blob = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    first = F.when(F.col("ordinal") == ordinal, byte_offset).otherwise(0)
    part = F.substring(blob, (first + 1).cast("int"), F.lit(4 * max_chars))
    few = rows.select("ordinal", F.coalesce("message_id", "local_identity").alias("message_id"), "role", "search_class", F.length(blob).alias("total"), part.alias("part"), "row_id").orderBy("ordinal", "row_id").limit(limit + 1).collect()  # at most 101 rows
    out, left = [], max_chars
    for r in few[:limit]:
        start, start_byte = (offset, byte_offset) if r["ordinal"] == ordinal and not out else (0, 0)
        if start_byte and start_byte >= r["total"]:
            raise InvalidPage("the cursor is past the end of its message")
        text = bytes(r["part"] or b"").decode("utf-8", errors="ignore")[:left]
        used = len(text.encode())
        whole = start_byte + used >= r["total"]
        out.append({"ordinal": r["ordinal"], "message_id": r["message_id"], "role": r["role"], "search_class": r["search_class"], "text": text, "text_offset": start, "text_total_bytes": r["total"], "complete_message": whole})
        left -= len(text)
        nxt = (r["ordinal"] + 1, 0, 0) if whole else (r["ordinal"], start + len(text), start_byte + used)
        if not whole or not left:
            break
    if not out:
        return {"messages": [], "has_more": False, "next_cursor": None}
    more = nxt[1] > 0 or len(few) > len(out)
    token = json.dumps({"v": 2, "s": session_id, "rev": revision, "o": nxt[0], "offset": nxt[1], "byte_offset": nxt[2]}, sort_keys=True, separators=(",", ":"))
    return {"messages": out, "has_more": more, "next_cursor": base64.urlsafe_b64encode(token.encode()).decode().rstrip("=") if more else None}


def _local_cursor(token: str) -> dict:
    try:
        own = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
    except (ValueError, UnicodeDecodeError) as e:
        raise InvalidPage("the cursor can't be read") from e
    numbers = ("o", "offset", "byte_offset")
    if not isinstance(own, dict) or set(own) != {"v", "s", "rev", *numbers} or own["v"] != 2 or any(type(own[k]) is not int or own[k] < 0 for k in numbers) or (own["offset"] == 0) != (own["byte_offset"] == 0):
        raise InvalidPage("the cursor has another shape")
    return own


def page_fault(rows: Sequence[Mapping], position: Position | None, limit: int, max_chars: int, has_more: bool, nxt: Position | None) -> str | None:
    """What is wrong with a page that another service answered, None if nothing is.

    Positions must rise, each message but the first begin at its start, a cut
    message be the last, completeness and lengths agree, and the next position
    follow the last row.
    """
    at = position or Position(-1)
    seen, cut = 0, False
    if len(rows) > limit:
        return "TOO_MANY_ROWS"
    order = lambda p: (p.ordinal, p.message_id.encode(), 0 if p.offset else 1, p.offset)
    for i, r in enumerate(rows):
        here = Position(r["ordinal"], r["message_id"], r["text_offset"])
        n = len(r["text"])
        inside = i == 0 and position is not None and position.offset and (position.ordinal, position.message_id) == (here.ordinal, here.message_id)
        if cut or r["text_offset"] != (position.offset if inside else 0) or r["complete_message"] != (r["text_offset"] + n == r["text_total_chars"]):
            return "PAYLOAD_INVALID"
        end = Position(here.ordinal, here.message_id, 0 if r["complete_message"] else r["text_offset"] + n)
        if order(end) <= order(at):
            return "NOT_ADVANCING"
        at, cut, seen = end, not r["complete_message"], seen + n
    if seen > max_chars or (cut and not has_more):
        return "PAYLOAD_INVALID"
    if has_more:
        return None if rows and nxt is not None and order(nxt) == order(at) else "NOT_ADVANCING"
    return "PAYLOAD_INVALID" if nxt is not None else None


def blocked(session_id: str, cursor: str | None, reason: str) -> dict:
    """The answer where no page can be trusted: nothing is claimed, and the reader may try again from the same place."""
    return {"status": "BLOCKED", "reason": reason, "session_id": session_id, "messages": [], "has_more": None, "next_cursor": cursor, "coverage_complete": False}
