"""Byte-pair ids of many short strings in one call, with the ranks of a tokenizer's own file.

The general library keeps alignments for every string it encodes, which is most of its time on single words. Here a batch of strings is laid end to end, encoded by a
rank encoder built from the same vocabulary, and cut again. Only strings of plain Latin characters without special tokens go this way (``simple``); callers give all others to
the library itself. ``Ranks.of`` gives None for files whose rules it does not know, so results never depend on it.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Characters whose letter, digit and space classes, case and normal form are the same in every Unicode version; U+0130 grows when lower-cased.
_SIMPLE = re.compile(r"[\t\n\r\x20-\x7E¡-įı-ɏ]*")
_BYTE_LEVEL = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"  # public pattern of byte-level tokenizers
_END = "\0"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the other bytes in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def token_bytes(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level tokenizer file; special tokens are their own text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    chars, special = byte_of(), {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    out = [b""] * (1 + max([*spec["model"]["vocab"].values(), *special]))
    for name, k in spec["model"]["vocab"].items():
        out[k] = special[k] if k in special else bytes([chars[c] for c in name])
    for k, content in special.items():
        out[k] = content
    return out


class Ranks:
    def __init__(self, spec: dict, spaced: bool):
        import regex
        import tiktoken

        model, chars = spec["model"], byte_of()
        self.special = [t["content"] for t in spec["added_tokens"]]
        suffix = model["end_of_word_suffix"] or ""
        known = set(self.special)
        ranks: dict[bytes, int] = {}
        for name, k in model["vocab"].items():
            if name in known:
                continue
            last = bool(suffix) and name.endswith(suffix)
            ranks[bytes([chars[c] for c in (name[: -len(suffix)] if last else name)]) + (b"\0" if last else b"")] = k
        if len(ranks) != len(model["vocab"]) - len(known & set(model["vocab"])):
            raise ValueError("two tokens of equal bytes")
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        first = 512 if suffix else 256
        if merged != list(range(first, first + len(merged))) or len(ranks) != first + len(merged):
            raise ValueError("ids are not in the order of the merges")
        self.spaced = spaced
        self.coder = tiktoken.Encoding("ranks", pat_str=_BYTE_LEVEL if spaced else f"[^{_END}]*{_END}", mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(first + len(merged), np.int64)
        self.last = np.zeros(first + len(merged), bool)
        for b, k in ranks.items():
            self.sizes[k] = len(b)
            self.last[k] = bool(suffix) and b.endswith(b"\0") and len(b) > 1
        if not spaced:
            self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

    @classmethod
    def of(cls, path: str) -> Ranks | None:
        """For byte-level files without normaliser, and for lower-casing files that mark word ends and drop white space."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        m, norm, pre = spec["model"], spec["normalizer"], spec["pre_tokenizer"] or {}
        if m.get("type") != "BPE" or m.get("dropout") or m.get("unk_token") or m.get("ignore_merges") or m.get("byte_fallback") or m.get("continuing_subword_prefix"):
            return None
        level = lambda p, own: p["type"] == "ByteLevel" and not p["add_prefix_space"] and p["use_regex"] is own
        try:
            if pre["type"] == "ByteLevel":
                return cls(spec, True) if norm is None and level(pre, True) and not m.get("end_of_word_suffix") else None
            cut, then = pre["pretokenizers"]
            steps = [(n["type"], n.get("content"), n.get("pattern", {}).get("Regex")) for n in norm["normalizers"]]
            drops = cut["type"] == "Split" and cut["behavior"] == "Removed" and cut["invert"] and level(then, False)
            return cls(spec, False) if drops and m["end_of_word_suffix"] and steps == [("NFC", None, None), ("Replace", " ", "\\s+"), ("Lowercase", None, None)] else None
        except (KeyError, TypeError, ValueError):
            return None

    def simple(self, text: str) -> bool:
        return _SIMPLE.fullmatch(text) is not None and not any(s in text for s in self.special)

    def encode(self, pieces: list[str], dtype: np.dtype) -> list[bytes]:
        """Packed ids of simple pieces that neither start nor end with white space; each with a space before it where the tokenizer keeps spaces."""
        if not pieces:
            return []
        if self.spaced:
            ids = self.coder.encode_to_numpy(" " + " ".join(pieces), disallowed_special=())
            sizes = np.fromiter((len(p) + 1 if p.isascii() else len(p.encode()) + 1 for p in pieces), np.int64, len(pieces))
            cut, wanted = np.cumsum(self.sizes[ids]), np.cumsum(sizes)
            ends = np.searchsorted(cut, wanted) + 1
            if (cut[ends - 1] != wanted).any():
                raise AssertionError("a token reaches over a space")
        else:
            words: list[str] = []
            count = np.empty(len(pieces), np.int64)
            for i, p in enumerate(pieces):
                p = p.lower()
                found = [p] if p.isalpha() else self.word.findall(p)
                count[i] = len(found)
                words += found
            ids = self.coder.encode_to_numpy(_END.join([*words, ""]), disallowed_special=()) if words else np.zeros(0, np.uint32)
            ends = np.concatenate(([0], np.flatnonzero(self.last[ids]) + 1))[np.cumsum(count)]
        packed, at = ids.astype(dtype).tobytes(), (ends * dtype.itemsize).tolist()
        return [packed[a:b] for a, b in zip([0, *at], at, strict=False)]
