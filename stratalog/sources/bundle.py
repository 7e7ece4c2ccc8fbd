"""Transport bundles: one ZIP of two CSV files and a manifest, the same bytes for the same rows."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.digest import canonical_json

SESSIONS = ("session_id", "title", "coverage_state", "time_min", "time_max")
MESSAGES = ("session_id", "ordinal", "message_id", "role", "search_class", "create_time", "text")
TYPES = {"sessions.csv": "session_id string, title string, coverage_state string, time_min double, time_max double", "messages.csv": "session_id string, ordinal int, message_id string, role string, search_class string, create_time double, text string"}
LONGEST_FIELD = 8 << 20
_WHEN = (1980, 1, 1, 0, 0, 0)


class InvalidBundle(ValueError):
    """A bundle that isn't what its manifest says."""


def _csv(rows, columns: tuple[str, ...]) -> tuple[bytes, int]:
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator="\n")
    w.writerow(columns)
    n = 0
    for r in rows:
        values = ["" if r[c] is None else repr(r[c]) if isinstance(r[c], float) else str(r[c]) for c in columns]
        if any("\0" in v or len(v.encode()) > LONGEST_FIELD for v in values):
            raise InvalidBundle("a field with a NUL or of more than 8 MiB")
        w.writerow(values)
        n += 1
    return out.getvalue().encode(), n


def write_bundle(sessions: DataFrame, messages: DataFrame, path: str) -> str:
    """Writes one shard's bundle; its SHA-256. A shard's size is bounded by its allocation."""
    parts = {}
    for name, df, columns, order in (("sessions.csv", sessions, SESSIONS, ["session_id"]), ("messages.csv", messages, MESSAGES, ["session_id", "ordinal", "message_id"])):
        body, n = _csv(df.select(*columns).orderBy(*order).toLocalIterator(), columns)
        parts[name] = (body, {"name": name, "bytes": len(body), "rows": n, "sha256": hashlib.sha256(body).hexdigest()})
    manifest = canonical_json({"schema": "shard-bundle-v1", "files": [m for _, m in parts.values()]}).encode()
    with zipfile.ZipFile(f"{path}.new", "w", zipfile.ZIP_STORED) as z:
        for name, body in [("manifest.json", manifest), *((n, b) for n, (b, _) in parts.items())]:
            z.writestr(zipfile.ZipInfo(name, _WHEN), body)
    os.replace(f"{path}.new", path)
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def verify_bundle(path: str) -> dict:
    """The manifest, once members, sizes, digests, headers and row counts agree with it."""
    with zipfile.ZipFile(path) as z:
        if z.namelist() != ["manifest.json", "sessions.csv", "messages.csv"]:
            raise InvalidBundle("other members than expected")
        manifest = json.loads(z.read("manifest.json"))
        for f, columns in zip(manifest["files"], (SESSIONS, MESSAGES)):
            body = z.read(f["name"])
            rows = list(csv.reader(io.StringIO(body.decode(), newline="")))
            if len(body) != f["bytes"] or hashlib.sha256(body).hexdigest() != f["sha256"] or tuple(rows[0]) != columns or len(rows) - 1 != f["rows"]:
                raise InvalidBundle(f"{f['name']} differs from the manifest")
    return manifest


def read_bundle(spark: SparkSession, path: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """The two tables of a verified bundle, unpacked to ``folder``. An empty number is null, an empty text is empty."""
    verify_bundle(path)
    with zipfile.ZipFile(path) as z:
        z.extractall(folder, ["sessions.csv", "messages.csv"])
    out = []
    for name, types in TYPES.items():
        df = spark.read.schema(types).csv(f"file://{os.path.join(folder, name)}", header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
        out.append(df.select(*[F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]))
    return out[0], out[1]
