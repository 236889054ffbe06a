"""Byte streams cut into frames (F1-F7) and the framing of files.

A connection's chunks arrive as rows (stream key, order, bytes); a frame may span chunks,
so each stream is a fold over its chunks, which carries the unfinished rest.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.folds import Fold, run

TOO_LONG, BAD_LENGTH, BAD_VARINT = "too_long", "bad_length", "bad_varint"
Frame = tuple[bytes | None, str | None]


class Broken(Exception):
    """Bytes that cannot be a frame; what is buffered of the stream is dropped."""


_ESCAPE = re.compile(r"\\(x.{0,2}|.)?", re.DOTALL)


def unescaped(delimiter: str) -> bytes:
    """A delimiter as configured: ``\\n``, ``\\r``, ``\\t``, ``\\0``, ``\\\\`` and ``\\xHH`` stand for
    their bytes, any other escape for itself."""

    def byte(found: re.Match) -> str:
        said = found[1] or ""
        if re.fullmatch("x[0-9a-fA-F]{2}", said):
            return chr(0xDC00 + int(said[1:], 16))
        return {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "\\": "\\"}.get(said, found[0])

    # Bytes above 0x7F travel as lone surrogates; lower ones as themselves.
    plain = _ESCAPE.sub(byte, delimiter)
    return b"".join(bytes([ord(c) - 0xDC00]) if 0xDC00 <= ord(c) <= 0xDCFF else c.encode() for c in plain)


def _within(size: int, most: int) -> None:
    if size > most:
        raise Broken(TOO_LONG)


def _next(framing: dict[str, Any], data: bytes, at: int) -> tuple[int, int, int] | None:
    """(first byte, end, where to go on) of the next frame from ``at`` on; none yet: None.
    A frame that is to be skipped is empty.  Raises ``Broken``."""
    kind, most = framing["type"], framing.get("max_len", 1 << 20)
    if kind in ("lines", "delimiter"):
        mark = b"\n" if kind == "lines" else framing["_mark"]
        end = data.find(mark, at)
        if end < 0:
            _within(len(data) - at, most)
            return None
        stop = end - (kind == "lines" and end > at and data[end - 1] == 0x0D)
        _within(stop - at, most)
        blank = kind == "lines" and not data[at:stop].strip(b" \t\n\f\r")
        return at, at if blank else stop, end + len(mark)
    if kind == "end_tag":
        start, tag = data.find(b"<", at), framing["tag"].encode()
        if start < 0:
            return len(data), len(data), len(data)
        end = data.find(tag, start)
        if end < 0:
            _within(len(data) - start, most)
            return None if start == at else (start, start, start)
        _within(end + len(tag) - start, most)
        return start, end + len(tag), end + len(tag)
    found = _counted(framing, data[at : at + framing.get("offset", 0) + 10])
    if found is None:
        return None
    head, size = found
    _within(size, most)
    end = at + head + size
    return (at + head, end, end) if end <= len(data) else None


def cut(framing: dict[str, Any], rest: bytes) -> tuple[list[Frame], bytes]:
    """Whole frames in ``rest`` and what is left.  What cannot be a frame, or is too long, is an
    error and drops all that is buffered, so that the stream goes on with what comes next."""
    if framing["type"] == "message":
        return ([(rest, None)] if rest else []), b""
    if framing["type"] == "delimiter":
        framing = {**framing, "_mark": unescaped(framing["delimiter"])}
    if not framing.get("_mark", b"x") or not framing.get("tag", "x"):
        raise ValueError("a delimiter or tag is not empty")
    frames: list[Frame] = []
    at = 0
    try:
        while at < len(rest) and (found := _next(framing, rest, at)) is not None:
            start, end, at = found
            # A length before a frame may be zero; between delimiters and in lines nothing is no frame.
            if end > start or framing["type"] in ("length_prefix", "length_prefixed"):
                frames.append((rest[start:end], None))
    except Broken as error:
        return [*frames, (None, str(error))], b""
    return frames, rest[at:]


def _counted(framing: dict[str, Any], rest: bytes) -> tuple[int, int] | None:
    """(header bytes, further bytes) of the frame that begins ``rest``; None if that is not known yet."""
    order = "little" if framing.get("endian") == "little" else "big"
    width = framing["width"]
    if framing["type"] == "length_field":
        # The length field is part of the frame, whose header is kept.
        at, width = framing["offset"], {"u8": 1, "u16": 2, "u32": 4}.get(width, width)
        if width not in (1, 2, 4):
            raise ValueError("a length field is 1, 2 or 4 bytes wide")
        if len(rest) < at + width:
            return None
        size = int.from_bytes(rest[at : at + width], order) + framing.get("adjust", 0)
        if size < at + width:
            raise Broken(BAD_LENGTH)
        return 0, size
    if width == "varint":
        value = 0
        for i, b in enumerate(rest[:10]):
            value |= (b & 0x7F) << (7 * i)
            if b < 0x80:
                return i + 1, value
        if len(rest) >= 10:
            raise Broken(BAD_VARINT)
        return None
    n = {"u8": 1, "u16": 2, "u32": 4}[width]
    return (n, int.from_bytes(rest[:n], order)) if len(rest) >= n else None


def framed(chunks: DataFrame, framing: dict[str, Any], *, key: str = "stream", order: str = "seq", data: str = "bytes") -> DataFrame:
    """Rows (stream, frame_no, frame, error) of chunks (stream, seq, bytes)."""

    def emit(state: dict, frames: list[Frame]) -> list[dict]:
        out = []
        for frame, error in frames:
            out.append({"stream": state["key"], "frame_no": state["n"], "frame": frame, "error": error})
            state["n"] += 1
        return out

    def step(state: dict, row: dict):
        state["key"] = str(row[key])
        frames, state["rest"] = cut(framing, state["rest"] + bytes(row[data] or b""))
        return state, emit(state, frames)

    def end(state: dict) -> list[dict]:
        # A last line without its mark is still a line.
        return emit(state, [(state["rest"], None)]) if state["rest"].strip() and framing["type"] == "lines" else []

    return run(chunks, Fold(lambda: {"rest": b"", "n": 0, "key": None}, step, "stream string, frame_no long, frame binary, error string", end), [key], [order])


def text_frames(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as frames with their file, read by Spark."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.regexp_replace("value", "\r$", "").alias("frame"), F.col("_metadata.file_path").alias("file"))


def tagged(df: DataFrame, text: str, tag: str) -> DataFrame:
    """Elements ``<tag ...>...</tag>`` in a text column, one row each, in the JVM."""
    return df.withColumn("element", F.explode(F.regexp_extract_all(text, F.lit(rf"(?s)(<{tag}[ >].*?</{tag}>)"))))


def scenario_frames(spark: SparkSession, path: str) -> DataFrame:
    """Scenario lines {t, json | text | hex} as (t, frame binary)."""
    raw = spark.read.schema("t string, json string, text string, hex string").json(path)
    body = F.coalesce(F.unhex("hex"), F.col("json").cast("binary"), F.col("text").cast("binary"))
    return raw.select(F.to_timestamp("t").alias("t"), body.alias("frame"))


# --- the report between sites: 32 bytes ------------------------------------------------

#: Fixed layout: version and flags, site, number, seconds, latitude, longitude, altitude, course, speed, error, domain.
REPORT = struct.Struct(">BB3sIIiihHHHB2x")


def pack_reports(rows: Iterator[dict]) -> Iterator[bytes]:
    """Reports as 32-byte frames: positions in 1e-7 degrees, course in 1/100 degree, speed in 1/10 m/s."""
    domains = ("unknown", "air", "surface", "subsurface", "ground", "space")
    clamp = lambda x, low, high: max(low, min(high, round(x)))
    for r in rows:
        domain = domains.index(r.get("domain")) if r.get("domain") in domains else 0
        yield REPORT.pack(1, 0, r["site"].encode()[:3].ljust(3), r["number"], int(r["t_us"] // 1_000_000), clamp(r["lat"] * 1e7, -(2**31), 2**31 - 1), clamp(r["lon"] * 1e7, -(2**31), 2**31 - 1), clamp(r.get("alt") or 0, -(2**15), 2**15 - 1), clamp((r.get("course") or 0) * 100, 0, 65535), clamp((r.get("speed") or 0) * 10, 0, 65535), clamp(r.get("error_m") or 0, 0, 65535), domain)


def unpack_report(data: bytes) -> dict[str, Any] | None:
    """A report back from its bytes; None for other lengths or versions."""
    if len(data) != REPORT.size or data[0] != 1:
        return None
    _, _, site, number, t, lat, lon, alt, course, speed, error, domain = REPORT.unpack(data)
    domains = ("unknown", "air", "surface", "subsurface", "ground", "space")
    return {"site": site.decode("latin-1").strip(), "number": number, "t_us": t * 1_000_000, "lat": lat / 1e7, "lon": lon / 1e7, "alt": float(alt), "course": course / 100, "speed": speed / 10, "error_m": float(error), "domain": domains[domain] if domain < len(domains) else "unknown"}


def packed(reports: DataFrame) -> DataFrame:
    """Reports (site, number, t_us, lat, lon, ...) as rows (report binary) of 32 bytes."""

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(pack_reports(batch.to_pylist()), pa.binary())], ["report"])

    return reports.mapInArrow(work, "report binary")


def unpacked(frames: DataFrame, report: str = "report") -> DataFrame:
    """The reports in rows of 32 bytes; rows of other lengths or versions are left out."""
    kinds = {"site": pa.string(), "number": pa.int64(), "t_us": pa.int64(), "lat": pa.float64(), "lon": pa.float64(), "alt": pa.float64(), "course": pa.float64(), "speed": pa.float64(), "error_m": pa.float64(), "domain": pa.string()}

    def work(batches):
        for batch in batches:
            rows = [r for b in batch.column(0).to_pylist() if (r := unpack_report(b or b"")) is not None]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(kinds.items())))

    return frames.select(report).mapInArrow(work, "site string, number long, t_us long, lat double, lon double, alt double, course double, speed double, error_m double, domain string")


def as_json(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """Frames decoded as JSON to a VARIANT ``record``; those that are none have an ``error``."""
    text = F.col(frame).cast("string")
    record = F.try_parse_json(text)
    return frames.withColumn("record", record).withColumn("error", F.when(record.isNull(), "not json"))


def records_at(df: DataFrame, path: str | None, context: tuple[str, ...] = ()) -> DataFrame:
    """The elements of the array at ``path`` of each ``record`` as records of their own, with
    ``context`` members of the frame copied beside them (C1, C7)."""
    from trackloom.functions.paths import json_path, parse_path

    at = json_path(parse_path(path)) if path else "$"
    whole = F.try_variant_get("record", at, "variant")
    items = F.from_json(F.to_json(whole), "array<variant>")
    many = F.when(F.schema_of_variant(whole).startswith("ARRAY"), items).otherwise(F.array_compact(F.array(whole)))
    extra = [F.try_variant_get("record", json_path(parse_path(c)), "string").alias(c) for c in context]
    return df.select(*(c for c in df.columns if c not in ("record", *context)), *extra, F.explode(many).alias("record"))


def xml_records(df: DataFrame, text: str, schema: str) -> DataFrame:
    """XML documents by schema; attributes are ``@name``, text is ``#text``."""
    options = {"attributePrefix": "@", "valueTag": "#text", "mode": "PERMISSIVE"}
    return df.withColumn("record", F.from_xml(text, schema, options))


