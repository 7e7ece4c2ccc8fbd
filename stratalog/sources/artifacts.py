"""Portable captures: ZIP files with a manifest and payload pages."""

from __future__ import annotations

import hashlib
import io
import posixpath
import zipfile
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators.corpus import HIDDEN_TYPES
from stratalog.sources.strict_json import InvalidJson, loads

MEMBERS = "path string, sha256 string, size_bytes bigint, member string, body string, error string"
LONGEST_MEMBER = 512 << 20


class InvalidArtifact(ValueError):
    """A capture that can't be trusted."""


def safe_member(name: str) -> bool:
    """Whether a member's name stays inside the archive's folder."""
    return bool(name) and "\\" not in name and "\0" not in name and not name.startswith("/") and posixpath.normpath(name) == name and not name.startswith("..")


def members(content: bytes) -> list[tuple[str, bytes]]:
    """The payload members a manifest lists, with sizes and digests checked."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            if len(set(names)) != len(names) or not all(safe_member(n) for n in names):
                raise InvalidArtifact("unsafe or repeated member names")
            if any(i.file_size > LONGEST_MEMBER for i in z.infolist()):
                raise InvalidArtifact("a member is too large")
            manifest = loads(z.read("manifest.json"))
            out = []
            for f in manifest["files"]:
                body = z.read(f["name"])
                if len(body) != f["bytes"] or hashlib.sha256(body).hexdigest() != f["sha256"]:
                    raise InvalidArtifact(f"{f['name']} differs from the manifest")
                out.append((f["name"], body))
            if {n for n, _ in out} | {"manifest.json"} != set(names):
                raise InvalidArtifact("members that the manifest doesn't list")
            return out
    except (zipfile.BadZipFile, KeyError, TypeError, InvalidJson) as e:
        raise InvalidArtifact(str(e) or type(e).__name__) from e


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """A row a payload member of every ZIP under ``path``; an artifact that fails a check is one row with ``error``."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple[Any, ...]] = []
            for p, content in zip(b["path"], b["content"]):
                sha = hashlib.sha256(content).hexdigest()
                try:
                    out += [(p, sha, len(content), n, body.decode("utf-8"), None) for n, body in members(content)]
                except (InvalidArtifact, UnicodeDecodeError) as e:
                    out.append((p, sha, len(content), None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "sha256", "size_bytes", "member", "body", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(unzip, MEMBERS)


PAGE = """struct<conversation_id: string, title: string, page_info: struct<start_cursor: string, end_cursor: string, has_previous_page: boolean, has_next_page: boolean>,
  messages: array<struct<id: string, author: struct<role: string>, create_time: double, content: struct<content_type: string, parts: array<string>, text: string, result: string>>>>"""


def page_messages(artifact_members: DataFrame) -> DataFrame:
    """The messages of the payload pages: artifact, member, position, id, role, content type, time, extracted text."""
    pages = artifact_members.where("error is null").withColumn("page", F.from_json("body", PAGE))
    each = pages.select("sha256", "member", F.col("page.conversation_id").alias("session_id"), F.col("page.title").alias("title"), F.col("page.page_info.has_previous_page").alias("has_previous_page"), F.posexplode("page.messages").alias("page_position", "m"))
    kind = F.col("m.content.content_type")
    text = (
        F.when(kind == "code", F.col("m.content.text"))
        .when(kind == "tether_browsing_display", F.coalesce(F.nullif(F.col("m.content.text"), F.lit("")), F.col("m.content.result")))
        .when(kind.isin("text", "multimodal_text"), F.array_join(F.filter("m.content.parts", lambda p: p.isNotNull()), "\n"))
    )
    role = F.col("m.author.role")
    cls = F.when((role == "system") | kind.isin(*HIDDEN_TYPES), "hidden").when(role == "tool", "evidence").when(role.isin("user", "assistant") & (kind == "text"), "dialogue").otherwise("trace")
    identity = F.coalesce(F.concat(F.lit("id:"), F.col("m.id")), F.concat_ws(":", F.lit("anon"), "sha256", "member", "page_position"))
    return each.select("sha256", "member", "page_position", "session_id", "title", "has_previous_page", F.col("m.id").alias("message_id"), identity.alias("local_identity"), role.alias("role"), kind.alias("content_type"), cls.alias("search_class"), F.col("m.create_time").alias("create_time"), F.coalesce(text, F.lit("")).alias("text"))


def distinct_occurrences(rows: DataFrame) -> DataFrame:
    """Messages of an artifact once per identity, with ``occurrences`` and how many texts they had (``texts`` above 1 is a conflict)."""
    first = F.min_by(F.struct("role", "content_type", "search_class", "create_time", "text"), F.struct("member", "page_position")).alias("m")
    return rows.groupBy("sha256", "session_id", "local_identity").agg(first, F.count("*").alias("occurrences"), F.countDistinct("text").alias("texts")).select("sha256", "session_id", "local_identity", "m.*", "occurrences", "texts")
