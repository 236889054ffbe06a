"""Protobuf frames as JSON records, by a descriptor set given at run time."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame


def message_class(descriptors: bytes, name: str):
    """The class of message ``name`` from a serialized file descriptor set."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    pool = descriptor_pool.DescriptorPool()
    for f in descriptor_pb2.FileDescriptorSet.FromString(descriptors).file:
        pool.Add(f)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(name))


def records(frames: DataFrame, descriptors: bytes, name: str, path: str | None = None, frame: str = "frame") -> DataFrame:
    """Rows (json, error): each message, or each element of its repeated field ``path``."""

    def work(batches):
        from google.protobuf import json_format
        from google.protobuf.message import DecodeError

        kind = message_class(descriptors, name)
        for batch in batches:
            out: list[tuple[str | None, str | None]] = []
            for data in batch.column(0).to_pylist():
                try:
                    record = json_format.MessageToDict(kind.FromString(data or b""), preserving_proto_field_name=True)
                except DecodeError:
                    out.append((None, f"not a {name}"))
                    continue
                for key in path.split(".") if path else ():
                    record = record.get(key) if isinstance(record, dict) else None
                out += [(json.dumps(r), None) for r in (record if isinstance(record, list) else [record] if record is not None else [])]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in (0, 1)], ["json", "error"])

    return frames.select(frame).mapInArrow(work, "json string, error string")
