"""Text encoders: a static table of piece vectors, and a BERT-like transformer.

Both have ``dim`` and ``encode(texts) -> matrix``, which is what
:func:`lodestone.operators.vectors.embed` asks of a model; it is broadcast once
and runs in Arrow batches.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.wordpiece import WordPiece
from ..sources.weights import read_bytes, tensor, tensors

MAX_TOKENS = 512
#: Texts whose ids are handed on at once.
ID_BATCH = 500


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row of zeros stays."""
    return v / np.maximum(np.sqrt((v.astype(np.float64) ** 2).sum(-1, keepdims=True)), 1e-12)


class StaticEncoder:
    """The mean of the vectors of a text's pieces."""

    def __init__(self, pieces: WordPiece, matrix: np.ndarray, normalized: bool = True):
        self.pieces, self.matrix, self.normalized = pieces, matrix, normalized
        self.dim = matrix.shape[1]

    def encode(self, texts: list[str]) -> np.ndarray:
        """Texts are cut to as many characters as the most tokens take at the median; unknown pieces do not count."""
        out = np.zeros((len(texts), self.dim), np.float32)
        for k, text in enumerate(texts):
            ids = [i for i in self.pieces.encode((text or "")[: MAX_TOKENS * self.pieces.median_bytes]) if i != self.pieces.unknown][:MAX_TOKENS]
            ids = [i for i in ids if i < len(self.matrix)]
            if ids:
                out[k] = self.matrix[ids].sum(0, dtype=np.float32) / np.float32(len(ids))
        return unit(out).astype(np.float32) if self.normalized else out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def layer_norm(x: np.ndarray, gain: np.ndarray, bias: np.ndarray, eps: float) -> np.ndarray:
    """By the biased variance of each row."""
    mean = x.mean(-1, keepdims=True)
    return (x - mean) / np.sqrt(((x - mean) ** 2).mean(-1, keepdims=True) + eps) * gain + bias


_erf = np.frompyfunc(math.erf, 1, 1)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1.0 + _erf(x / math.sqrt(2.0)).astype(x.dtype))


def linear(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """``weight`` has a row per output."""
    return x @ weight.T + bias


class Bert:
    """A post-norm encoder with absolute positions; a text's vector is its first token's."""

    def __init__(self, pieces: WordPiece, config: dict, values: dict[str, np.ndarray]):
        self.pieces = pieces
        number = lambda key: int(config.get(key) or 0)
        self.dim, self.layers, self.heads, self.places = (number(k) for k in ("hidden_size", "num_hidden_layers", "num_attention_heads", "max_position_embeddings"))
        self.eps = float(config.get("layer_norm_eps") or 1e-12)
        if min(self.dim, self.layers, self.heads, number("intermediate_size"), number("vocab_size")) <= 0 or self.places < 4 or self.dim % self.heads:
            raise ValueError("the configuration does not describe a usable encoder")
        if config.get("position_embedding_type", "absolute") != "absolute":
            raise ValueError("only absolute positions are run")
        for special in ("[CLS]", "[SEP]"):
            if special not in pieces.vocab:
                raise ValueError(f"{special} is not in the vocabulary")
        lead = "" if "embeddings.word_embeddings.weight" in values else "bert."
        get = lambda name: tensor(values, lead + name)
        self.word, self.place, self.kind = (get(f"embeddings.{x}_embeddings.weight") for x in ("word", "position", "token_type"))
        if self.word.shape != (number("vocab_size"), self.dim):
            raise ValueError("the word embeddings do not match the configuration")
        both = lambda name: (get(f"{name}.weight"), get(f"{name}.bias"))
        self.norm = both("embeddings.LayerNorm")
        self.blocks = []
        for i in range(self.layers):
            p = f"encoder.layer.{i}."
            names = ("attention.self.query", "attention.self.key", "attention.self.value", "attention.output.dense", "attention.output.LayerNorm", "intermediate.dense", "output.dense", "output.LayerNorm")
            self.blocks.append([both(p + n) for n in names])

    def _block(self, h: np.ndarray, block: list) -> np.ndarray:
        query, key, value, out, norm1, inner, outer, norm2 = block
        n, width = len(h), self.dim // self.heads
        split = lambda x: x.reshape(n, self.heads, width).transpose(1, 0, 2)
        q, k, v = (split(linear(h, *w)) for w in (query, key, value))
        mixed = softmax(q @ k.transpose(0, 2, 1) / np.float32(math.sqrt(width))) @ v
        h = layer_norm(h + linear(mixed.transpose(1, 0, 2).reshape(n, self.dim), *out), *norm1, self.eps)
        return layer_norm(h + linear(gelu(linear(h, *inner)), *outer), *norm2, self.eps)

    def encode(self, texts: list[str]) -> np.ndarray:
        rows = []
        for text in texts:
            ids = self.pieces.encode((text or "")[: self.places * self.pieces.median_bytes])[: self.places - 2]
            ids = [i if i < len(self.word) else self.pieces.unknown for i in ids]
            ids = [self.pieces.vocab["[CLS]"], *ids, self.pieces.vocab["[SEP]"]]
            h = layer_norm(self.word[ids] + self.place[: len(ids)] + self.kind[0], *self.norm, self.eps)
            for block in self.blocks:
                h = self._block(h, block)
            rows.append(h[0])
        return unit(np.array(rows, np.float32).reshape(len(rows), self.dim)).astype(np.float32)


def load_encoder(spark: SparkSession, path: str, kind: str = "static") -> StaticEncoder | Bert:
    """A model folder: ``tokenizer.json``, ``config.json``, ``model.safetensors``; ``encoder`` has to be asked for."""
    pieces = WordPiece.of_json(read_bytes(spark, f"{path}/tokenizer.json"))
    config = json.loads(read_bytes(spark, f"{path}/config.json"))
    values = tensors(read_bytes(spark, f"{path}/model.safetensors"))
    if kind == "encoder":
        return Bert(pieces, config, values)
    if kind != "static":
        raise ValueError(f"no encoder of the kind {kind!r}")
    matrix = tensor(values, "embeddings")
    if matrix.ndim != 2:
        raise ValueError("the embeddings are not a matrix")
    return StaticEncoder(pieces, matrix, config.get("normalize", True) is not False)


def piece_ids(rows: DataFrame, pieces: WordPiece) -> DataFrame:
    """``rowid, ids`` of ``rowid, text``; each distinct word of a worker is cut once."""
    shared = rows.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ID_BATCH):
                part = batch.slice(lo, ID_BATCH)
                ids = [shared.value.encode_bytes(t or "") for t in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["rowid", "ids"])

    return rows.select("rowid", "text").mapInArrow(run, StructType([rows.schema["rowid"], StructField("ids", ArrayType(IntegerType()))]))
