"""Providers' conversation exports as trees of nodes: tree_id, node_id, parent_id, role, create_time, text, title.

Each reader takes files that hold an array of conversations (or a ZIP of
them) and yields the same columns, so that everything after them is one path.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from stratalog.functions.digest import canonical_json
from stratalog.functions.text import text_of_html
from stratalog.sources.strict_json import InvalidJson, loads

NODES = "path string, tree_id string, title string, node_id string, parent_id string, role string, create_time double, text string, error string"
Node = tuple[str | None, ...]
_NUMBERED = re.compile(r"conversations(?:-(\d+))?\.json$")


def epoch(value: Any) -> float | None:
    """Seconds of a number, of an ISO-8601 text with an offset, or of extended JSON milliseconds."""
    if value is None:
        return None
    if isinstance(value, dict) and "$date" in value:
        inner = value["$date"]
        return int(inner["$numberLong"]) / 1000 if isinstance(inner, dict) else epoch(inner)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    when = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    if when.tzinfo is None:
        raise InvalidJson("a time without an offset")
    return when.timestamp()


def _parts(content: dict[str, Any]) -> str:
    if content.get("content_type") == "code":
        return content.get("text") or ""
    return "\n".join(p for p in content.get("parts") or [] if isinstance(p, str))


def mapping_nodes(c: dict[str, Any]) -> Iterator[Node]:
    """Conversations as maps of nodes with one message each."""
    for key, n in c["mapping"].items():
        m = n.get("message") or {}
        yield c.get("conversation_id") or c["id"], c.get("title"), key, n.get("parent"), (m.get("author") or {}).get("role"), epoch(m.get("create_time")), _parts(m.get("content") or {})


def fragment_nodes(c: dict[str, Any]) -> Iterator[Node]:
    """Conversations as maps of nodes whose messages are lists of typed fragments."""
    roles = {"REQUEST": "user", "RESPONSE": "assistant"}
    for key, n in c["mapping"].items():
        m = n.get("message") or {}
        fragments = m.get("fragments") or []
        role = next((roles[f["type"]] for f in fragments if f.get("type") in roles), None)
        text = "\n".join(f.get("content") or "" for f in fragments if f.get("type") in roles)
        yield c["id"], c.get("title"), key, n.get("parent"), role, epoch(m.get("inserted_at")), text


def response_nodes(c: dict[str, Any]) -> Iterator[Node]:
    """Conversations as lists of responses that name their parents."""
    head = c.get("conversation") or {}
    for r in c["responses"]:
        r = r["response"]
        role = "user" if str(r.get("sender", "")).lower() == "human" else "assistant"
        yield head.get("id"), head.get("title"), r["_id"], r.get("parent_response_id") or None, role, epoch(r.get("create_time")), r.get("message") or ""


def line_nodes(c: dict[str, Any]) -> Iterator[Node]:
    """Third-party exports without ids: a conversation is known by the digest of its opening message."""
    first = c["messages"][0]
    tree = hashlib.sha256(canonical_json([first.get("role"), first.get("content"), first.get("timestamp")]).encode()).hexdigest()[:32]
    for i, m in enumerate(c["messages"]):
        yield tree, c.get("title"), str(i), str(i - 1) if i else None, m.get("role"), epoch(m.get("timestamp")), m.get("content") or ""


FORMATS: dict[str, Callable[[dict[str, Any]], Iterator[Node]]] = {"mapping": mapping_nodes, "fragments": fragment_nodes, "responses": response_nodes, "lines": line_nodes}


def _documents(name: str, content: bytes) -> Iterator[Any]:
    if not name.endswith(".zip"):
        yield loads(content)
        return
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        found = sorted((int(m[1] or 0), n) for n in z.namelist() if (m := _NUMBERED.search(n.rpartition("/")[2])))
        if not found:
            found = [(0, n) for n in z.namelist() if n.endswith(".json")]
            if len(found) != 1:
                raise InvalidJson("no single JSON member")
        if len({k for k, _ in found}) != len(found):
            raise InvalidJson("a numbered member occurs twice")
        for _, n in found:
            yield loads(z.read(n))


def read_export(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The nodes of all conversations of an export; a file that can't be read is one row with ``error``.

    A file is read by one task, so large exports should be split by member.
    """
    nodes = FORMATS[kind]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                out: list[tuple[Any, ...]] = []
                try:
                    for document in _documents(p, bytes(content)):
                        several = document if isinstance(document, list) else document.get("conversations", [document])
                        out += [(p, *n, None) for c in several for n in nodes(c)]
                except (InvalidJson, KeyError, TypeError, ValueError, AttributeError, IndexError, zipfile.BadZipFile) as e:
                    out = [(p, *[None] * 7, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(out, columns=["path", "tree_id", "title", "node_id", "parent_id", "role", "create_time", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(parse, NODES)


def html_turns(page: str, markers: tuple[str, ...] = ("User", "Gemini")) -> list[tuple[str, str]]:
    """The turns of a page: text after each line that is a marker; the first marker is the user's."""
    out: list[tuple[str, list[str]]] = []
    for line in text_of_html(page).split("\n"):
        if line.strip() in markers:
            out.append(("user" if line.strip() == markers[0] else "assistant", []))
        elif out:
            out[-1][1].append(line)
    return [(role, "\n".join(x).strip()) for role, x in out]


def read_html(spark: SparkSession, path: str, depth: int = 5, folder: str = "Sources") -> DataFrame:
    """The turns of the pages under ``path`` that lie at least ``depth`` deep in a folder of the given name."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(p, i, role, text) for p, content in zip(b["path"], b["content"]) for i, (role, text) in enumerate(html_turns(bytes(content).decode("utf-8", "replace")))]
            yield pd.DataFrame(out, columns=["path", "ordinal", "role", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").load(path)
    files = files.where(f"array_contains(split(path, '/'), '{folder}') and size(split(path, '/')) >= {int(depth)}")
    return files.select("path", "content").mapInPandas(parse, "path string, ordinal int, role string, text string")
