"""Encoders of tokenizer files with the ids of the tokenizers library.

A byte-level file whose merges stand in the order of their ids is encoded by tiktoken's
engine, which then does the same several times as fast. Whatever that engine refuses
(its pattern gives up on white space of some hundred thousand characters) and every
other file goes to the library itself.
"""

from __future__ import annotations

import json
import os

import numpy as np

from tidewire.llm.common import keep_cache

_LOADED: dict[str, Encoder] = {}


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts, without added tokens; special strings inside texts as the library has them by default."""

    def __init__(self, path: str):
        self.path, self._library, self.engine = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        special = {t["content"]: t["id"] for t in added}
        byte_level = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        #: whether words start at single spaces and nothing spans them
        self.splittable = byte_level and not any(any(c.isspace() for c in s) for s in special)
        if model["type"] != "BPE" or not byte_level:
            return
        plain = {k: v for k, v in model["vocab"].items() if k not in special}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
        ids = [plain.get(m, -1) for m in merged]
        if ids == sorted(set(ids)) and len(plain) == len(ids) + 256:
            import public_tokenizers
            import tiktoken

            of = _byte_of_char()
            ranks = {bytes(of[c] for c in k): v for k, v in plain.items()}
            self.engine = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @classmethod
    def of(cls, path: str) -> Encoder:
        keep_cache("byte_bpe", _LOADED.clear)
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    @property
    def library(self):
        if self._library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def ids(self, text: str) -> np.ndarray:
        if self.engine is not None:
            try:
                return self.engine.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # the pattern ran out of its stack
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def lengths(self, batch: list[str]) -> list[int]:
        """Numbers of ids of the texts of a batch, encoded in one call."""
        if self.engine is not None:
            try:
                return [len(e) for e in self.engine.encode_batch(batch, num_threads=1, allowed_special="all")]
            except ValueError:  # the pattern ran out of its stack on one of them
                return [len(self.ids(t)) for t in batch]
        return [len(e) for e in self.library.encode_batch_fast(batch, add_special_tokens=False)]
