"""Token ids of whole texts by a byte-level BPE vocabulary file."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

SEPARATOR_ID = 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _printable_bytes() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Encodes as the file's own library does, special strings in texts included."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError(f"{path}: a byte-level BPE file without prefix space is expected")
        alphabet = _printable_bytes()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        ranks = {
            bytes(alphabet[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in self.special
        }
        self._bpe = tiktoken.Encoding(
            "file",
            # The byte-level pre-tokenizer's fixed pattern.
            pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
            mergeable_ranks=ranks,
            special_tokens=self.special,
        )
        self.n_ids = max([*ranks.values(), *self.special.values()]) + 1
        self._allowed = set(self.special)

    @property
    def width(self) -> str:
        """The smallest little-endian type that holds every id."""
        return "<u2" if self.n_ids <= 1 << 16 else "<u4"

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self._allowed):
            return np.asarray(self._bpe.encode(text, allowed_special=self._allowed), np.uint32)
        return np.asarray(self._bpe.encode_ordinary(text), np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def binary_column(parts: Iterable[bytes | np.ndarray]) -> pa.Array:
    return pa.array([p if isinstance(p, bytes) else p.tobytes() for p in parts], pa.binary())


def separated(enc: Encoder, text: str | None, separator: int = SEPARATOR_ID) -> np.ndarray:
    """A document's ids and its closing separator; a null text has the separator alone."""
    ids = enc.encode(text) if text else np.zeros(0, np.uint32)
    return np.append(ids, np.uint32(separator)).astype("<u4")
