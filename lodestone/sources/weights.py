"""Model files: tensors in the safetensors layout, tokenizer vocabularies, configurations.

A model is a bounded file that every worker needs whole, so it is read on the
driver through Spark's own reader (any store) and broadcast.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession


def read_bytes(spark: SparkSession, path: str) -> bytes:
    row = spark.read.format("binaryFile").load(path).select("content").head()
    if row is None:
        raise FileNotFoundError(path)
    return bytes(row["content"])


def tensors(raw: bytes) -> dict[str, np.ndarray]:
    """Tensors by name: eight bytes of header length, a JSON header, then the data.

    Only 32-bit floats are turned into arrays; others are left out, as are
    entries without type, shape or place.  A header or a tensor that runs past
    the end, or a float tensor out of alignment, is an error.
    """
    if len(raw) < 8:
        raise ValueError("no header")
    n = int.from_bytes(raw[:8], "little")
    if n == 0 or n > len(raw) - 8:
        raise ValueError("corrupt header length")
    try:
        header = json.loads(raw[8 : 8 + n])
    except ValueError as e:
        raise ValueError("header is not JSON") from e
    if not isinstance(header, dict):
        raise ValueError("header is not an object")
    out, named = {}, False
    for name, spec in header.items():
        if name == "__metadata__" or not isinstance(spec, dict) or not {"dtype", "shape", "data_offsets"} <= set(spec):
            continue
        begin, end = spec["data_offsets"]
        if begin < 0 or end < begin:
            continue
        named = True
        at = 8 + n + begin
        if at + (end - begin) > len(raw):
            raise ValueError(f"tensor {name!r} runs past the end")
        if spec["dtype"] == "F32":
            if at % 4:
                raise ValueError(f"tensor {name!r} is not aligned")
            out[name] = np.frombuffer(raw, "<f4", (end - begin) // 4, at).reshape(spec["shape"])
    if not named:
        raise ValueError("no tensors")
    return out


def pack_tensors(values: dict[str, np.ndarray]) -> bytes:
    """The file of some 32-bit float tensors."""
    header, data = {}, b""
    for name, v in values.items():
        body = np.ascontiguousarray(v, "<f4").tobytes()
        header[name] = {"dtype": "F32", "shape": list(v.shape), "data_offsets": [len(data), len(data) + len(body)]}
        data += body
    head = json.dumps(header).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + data


def tensor(values: dict[str, np.ndarray], name: str) -> np.ndarray:
    """A tensor that has to be there, as 32-bit floats."""
    if name not in values:
        raise ValueError(f"no 32-bit float tensor {name!r}")
    return values[name]
