"""Vectors: products, norms, and the hashing embedder."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievewright.functions.text import plain_terms

DIM = 384


class Embedder(Protocol):
    """Texts to unit vectors; ``column`` is the same as an Arrow column function."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2_normalized(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def _slot(token: str, dim: int) -> tuple[int, float]:
    """The place of a token and its sign: a 64-bit hash modulo ``dim``, and its top bit."""
    value = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
    return value % dim, 1.0 if value >> 63 else -1.0


class HashingEmbedder:
    """Words count 2, character trigrams of ``#word#`` one half; signs by hash; unit length.

    Deterministic and without a model; the default.
    """

    def __init__(self, dim: int = DIM):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for term in plain_terms(text):
                place, sign = _slot("w:" + term, self.dim)
                row[place] += 2.0 * sign
                padded = f"#{term}#"
                for i in range(len(padded) - 2):
                    place, sign = _slot("c:" + padded[i : i + 3], self.dim)
                    row[place] += 0.5 * sign
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0)


def verify_file(path: str, sha256: str | None) -> None:
    """An error if the file does not have the hash; none is asked for without one."""
    if sha256 is not None:
        with open(path, "rb") as f:
            found = hashlib.file_digest(f, "sha256").hexdigest()
        if found != sha256.lower():
            raise ValueError(f"{path} has the hash {found}, not {sha256}")


class SentenceTransformerEmbedder:
    """A sentence-transformers model by name, loaded once a worker; needs the library."""

    def __init__(self, model: str = "all-MiniLM-L6-v2", dim: int = DIM, batch: int = 32):
        self.model, self.dim, self.batch, self._loaded = model, dim, batch, None

    def __getstate__(self):
        return self.__dict__ | {"_loaded": None}

    def embed(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.dim), np.float32)
        if self._loaded is None:
            from sentence_transformers import SentenceTransformer

            self._loaded = SentenceTransformer(self.model)
        return np.asarray(self._loaded.encode(texts, batch_size=self.batch, normalize_embeddings=True, convert_to_numpy=True), np.float32)


class OnnxEmbedder:
    """A sentence encoder in ONNX form: masked mean of the token states, unit length.

    The model and tokenizer files are the user's; they are loaded once a worker.
    With ``sha256``, a model file of another hash is refused.
    """

    def __init__(self, model_path: str, tokenizer_path: str, dim: int = DIM, max_tokens: int = 256, batch: int = 32, sha256: str | None = None):
        self.model_path, self.tokenizer_path, self.dim, self.max_tokens, self.batch = model_path, tokenizer_path, dim, max_tokens, batch
        self.sha256 = sha256
        self._loaded = None

    def __getstate__(self):
        return self.__dict__ | {"_loaded": None}

    def _load(self):
        if self._loaded is None:
            verify_file(self.model_path, self.sha256)
            import onnxruntime
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(self.tokenizer_path)
            tokenizer.enable_truncation(self.max_tokens)
            tokenizer.enable_padding()
            self._loaded = onnxruntime.InferenceSession(self.model_path), tokenizer
        return self._loaded

    def embed(self, texts: list[str]) -> np.ndarray:
        session, tokenizer = self._load()
        names = {i.name for i in session.get_inputs()}
        parts = []
        for at in range(0, len(texts), self.batch):
            coded = tokenizer.encode_batch(texts[at : at + self.batch])
            mask = np.array([c.attention_mask for c in coded], np.int64)
            feed = {"input_ids": np.array([c.ids for c in coded], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
            states = session.run(None, {k: v for k, v in feed.items() if k in names})[0]
            mean = (states * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1e-9)
            size = np.linalg.norm(mean, axis=1, keepdims=True)
            parts.append(np.divide(mean, size, out=np.zeros_like(mean), where=size > 0))
        return np.concatenate(parts) if parts else np.zeros((0, self.dim), np.float32)


def embedded(embedder: Embedder, text: Column) -> Column:
    """The embeddings of a text column."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.embed([t or "" for t in texts])))

    return run(text)




def embedder_by_name(name: str, **options) -> Embedder:
    """``hashing``, ``onnx`` or ``sentence-transformers``, with the options of its class."""
    kinds = {"hashing": HashingEmbedder, "onnx": OnnxEmbedder, "sentence-transformers": SentenceTransformerEmbedder}
    if name not in kinds:
        raise ValueError(f"unknown embedder {name!r}; there are {sorted(kinds)}")
    return kinds[name](**options)
