"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last ``WINDOW`` bytes cuts every text at places that depend on content alone, so passages that documents share fall into equal chunks,
wherever they stand. Each distinct chunk is encoded once and kept in a table (bounded, by hash of the chunk). A cut usually splits a word,
so chunk joins are repaired: the broken word is encoded again in a window that reaches from a whole word of the left
chunk to a whole word of the right one, and the window must agree with both chunks' own ids at its ends. Where it does not, the window grows to the
whole text, which is then encoded by the library. So results never depend on the cuts or on the table, only its speed does.

The table belongs to a Python worker: documents are not shuffled, a lost executor only loses a cache, memory is bounded.

Defined results: null text counts as empty and has no ids and an empty decoded text; special-token strings inside a text are encoded as the library does; other columns pass
through, columns named like the outputs are replaced. White-space dropping tokenizers with ids by words are chunked; for any other the text is encoded whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import slices, text_bytes
from quantloom.llm.pieces import coder

WINDOW, MEAN_BITS = 16, 10  # bytes of the rolling hash; a chunk is about 2 ** MEAN_BITS bytes
TABLE_BYTES = 32 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}
_TABLES: dict[str, tuple[dict, list[int]]] = {}  # per file the table and the bytes it holds


def _powers(n: int) -> np.ndarray:
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        p = np.ones(size, np.uint64)
        p[1:] = np.uint64(_BASE)
        _POWERS[size] = np.multiply.accumulate(p)
    return _POWERS[size][:n]


def cuts(raw: np.ndarray) -> np.ndarray:
    """Positions before which a chunk ends, ascending: where the hash of the last WINDOW bytes has its leading bits zero and a character starts."""
    n = len(raw)
    if n <= 2 * WINDOW:
        return np.zeros(0, np.int64)
    p = _powers(n + 1)
    s = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[:n][::-1])  # a byte's weight falls with its position
    w = s[WINDOW:] - s[:-WINDOW]  # weight of position i is _BASE ** (n - 1 - i)
    h = w * p[WINDOW:n] * np.uint64(pow(_BASE, -(n - 1), 1 << 64))  # every window to the same powers, wherever it stands
    at = np.flatnonzero((h >> np.uint64(64 - MEAN_BITS)) == 0) + WINDOW + 1
    at = at[at < n]
    return at[(raw[at] & 0xC0) != 0x80]


class ChunkCoder:
    """Encodes texts by chunks; ``table`` maps a chunk's hash to (head, tail, first, last, middle ids)."""

    def __init__(self, path: str):
        self.words = coder(path, spaced=False)
        self.table, self.held = _TABLES.setdefault(path, ({}, [0]))  # both last as long as the worker

    def _entry(self, chunk: str):
        """None for a chunk without a space; else its broken ends and the ids of the whole words between them."""
        p = chunk.split(" ")
        if len(p) == 1:
            return None
        whole = p[1:-1]
        get = self.words.memo
        solid = [w for w in whole if get[w]]
        first, last = (solid[0], solid[-1]) if solid else ("", "")
        return p[0], p[-1], (first, get.get(first) or b""), (last, get.get(last) or b""), b"".join([get[w] for w in whole])

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Packed ids of the texts of one slice."""
        texts, plans, fresh = [], [], {}
        for i in range(len(offsets) - 1):
            part = raw[offsets[i] : offsets[i + 1]]
            data, ends = part.tobytes(), [0, *cuts(part).tolist(), len(part)]
            chunks = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            keys = [xxhash.xxh3_128_digest(c) for c in chunks]
            for k, c in zip(keys, chunks, strict=True):
                if k not in self.table and k not in fresh:
                    fresh[k] = c.decode()
            texts.append(data)
            plans.append((keys, chunks))
        want = set().union(*[c.split(" ")[1:-1] for c in fresh.values()]) if fresh else set()
        self.words.learn(want.difference(self.words.memo))
        for k, c in fresh.items():
            self.table[k] = self._entry(c)
            self.held[0] += 3 * len(c) + 300
        joins: list[tuple] = []
        bodies = []
        for keys, chunks in plans:
            body, carry, left = [], "", ("", b"")
            for k, c in zip(keys, chunks, strict=True):
                e = self.table[k]
                if e is None:
                    carry += c.decode()
                    continue
                head, tail, first, last, middle = e
                joins.append((left, carry + head, first))
                body.append(middle)
                carry, left = tail, last if middle else ("", b"")
            joins.append((left, carry, ("", b"")))
            bodies.append(body)
        repaired = self._repair(joins)
        out, at = [], 0
        for data, body in zip(texts, bodies, strict=True):
            mine = repaired[at : at + len(body) + 1]
            at += len(body) + 1
            if any(m is None for m in mine):  # no agreement: the window is the text
                out.append(self.words.direct([data.decode()])[0])
                continue
            parts = [mine[0]]
            for middle, m in zip(body, mine[1:], strict=True):
                parts += (middle, m)
            out.append(b"".join(parts))
        if self.held[0] > TABLE_BYTES:
            self.table.clear()
            self.held[0] = 0
        self.words.forget()
        return out

    def _repair(self, joins: list[tuple]) -> list[bytes | None]:
        """Ids of the broken words; None where the re-encoded window does not agree with its neighbours."""
        windows = [f"{left[0]} {broken} {right[0]}" for left, broken, right in joins]
        out: list[bytes | None] = []
        for (left, _, right), ids in zip(joins, self.words.direct(windows), strict=True):
            a, b = len(left[1]), len(ids) - len(right[1])
            out.append(ids[a:b] if a <= b and ids[:a] == left[1] and ids[b:] == right[1] else None)
        return out


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (packed little-endian unsigned 32-bit), ``n_tokens`` and ``decoded``."""
    fields = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())]
    names = {f.name for f in fields}
    kept = [f.name for f in docs.schema if f.name not in names]
    schema = T.StructType([f for f in docs.schema if f.name not in names] + fields)

    def run(batches):
        chunks = ChunkCoder(path)
        t = chunks.words.tokenizer
        dtype = chunks.words.dtype
        chunked = _drops_space(t)
        plain = t.decoder is None
        names_of = [t.id_to_token(i) for i in range(t.get_vocab_size())]
        for batch in batches:
            raw, offs = text_bytes(batch.column(text))
            for s, e in slices(offs):
                part, po = raw[offs[s] : offs[e]], offs[s : e + 1] - offs[s]
                packed = chunks.encode(part, po) if chunked else chunks.words.direct([part[a:b].tobytes().decode() for a, b in zip(po, po[1:], strict=False)])
                arrays = [np.frombuffer(x, dtype) for x in packed]
                if plain:
                    decoded = [" ".join([names_of[i] for i in a.tolist()]) for a in arrays]
                else:
                    decoded = [t.decode(a.tolist(), skip_special_tokens=False) for a in arrays]
                new = [pa.array([a.astype("<u4").tobytes() for a in arrays], pa.binary()), pa.array([len(a) for a in arrays], pa.int64()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(s, e - s) for k in kept] + new, names=kept + [f.name for f in fields])

    return docs.mapInArrow(run, schema)


def _drops_space(t) -> bool:
    """Whether a space ends a word whatever stands around it, by trial on the tokenizer itself."""
    a, b = t.encode("ab", add_special_tokens=False).ids, t.encode("cd", add_special_tokens=False).ids
    tries = ("ab cd", "ab  cd", " ab cd ", "ab \n cd")
    return all(t.encode(x, add_special_tokens=False).ids == a + b for x in tries)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.withColumn("ids_sha256", F.sha2("ids", 256)).withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256))
