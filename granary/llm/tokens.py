"""Token ids of a whole corpus by a public tokenizer, with reuse of content-defined chunks.

Texts are cut where a rolling hash over the last bytes says so, so that equal passages give equal chunks wherever they
stand, and each distinct chunk is encoded once by each worker process. A cut may split a token, so what a chunk's own encoding
says near its ends isn't trusted: it is kept between the chunk's first and last *firm* place, if tokens end there, and the
join, from the last firm place of one chunk to the first of the next, is encoded anew; where a chunk has no two firm places
that its tokens agree with, the join takes in all of it and goes on into the next. Joins repeat too and have a dictionary.

At a firm place a blank or line end follows a visible ASCII character. The pre-tokenizer of the byte-level vocabularies always
splits there, whatever stands around, as its pattern looks ahead over white space only and never back, and tokens never span
a split. The result therefore equals the ids of the uncut text. Another pattern gets no chunks. There is no shuffle, and the
dictionaries are bounded.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from granary.functions.process import process_cache

_WINDOW = 16
#: One of so many places is a cut.
_MEAN = 256
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """Where a vocabulary file is: in ``folder``, else where the installed package of public tokenizers keeps it."""
    if folder:
        return str(Path(folder) / name)
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_pattern() -> str:
    """The pre-tokenizer pattern of the byte-level vocabularies, from the installed package."""
    import public_tokenizers

    return public_tokenizers.PATTERN


#: The last firm place is where this match ends, the first one where that one does.
_LAST_FIRM, _FIRST_FIRM = re.compile(rb".*[!-~](?=[ \n])", re.S).match, re.compile(rb"[!-~](?=[ \n])").search


def cut_places(raw: bytes) -> list[int]:
    """Ends of the chunks of UTF-8 ``raw`` but the last."""
    return batch_places(raw, np.array([0, len(raw)]))[0].tolist()


def batch_places(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of many texts that lie side by side in ``raw``, as places in ``raw``, and where each text's begin.

    Text ``i`` is ``raw[offsets[i]:offsets[i + 1]]``. Only whole windows inside one text count, so a place depends on its
    text alone; no place is inside a character.
    """
    if len(raw) <= _WINDOW:
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    b = np.frombuffer(raw, np.uint8)
    h = _GEAR[b]
    for shift in (1, 2, 4, 8):  # the sum of the last 16 bytes' numbers, each shifted by its distance
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    hit = np.flatnonzero((h[_WINDOW - 1 : -1] >> np.uint32(20)) % _MEAN == 0) + _WINDOW
    hit = hit[(b[hit] & 0xC0) != 0x80]
    text = np.searchsorted(offsets, hit, "right") - 1
    hit = hit[hit - offsets[text] >= _WINDOW]
    return hit, np.searchsorted(hit, offsets)


class ChunkEncoder:
    """Encodes UTF-8 texts by ``encode`` (text to ids; ``sizes`` has the bytes of each id) with bounded dictionaries: from
    chunks to their trusted middle, and from joins to ids, packed in 4 bytes each."""

    def __init__(self, encode, sizes: list[int], most: int = 500_000, longest: int = 1024):
        self.encode, self.sizes, self.most, self.longest = encode, sizes, most, longest
        self.middles: dict[bytes, tuple[int, int, bytes]] = {}
        self.joins: dict[bytes, bytes] = {}

    def _keep(self, known: dict, raw: bytes, value):
        if len(raw) <= self.longest:
            if len(known) >= self.most:
                known.clear()
            known[raw] = value
        return value

    def _join(self, raw: bytes) -> bytes:
        return self._keep(self.joins, raw, array("i", self.encode(raw.decode())).tobytes())

    def _middle(self, raw: bytes) -> tuple[int, int, bytes]:
        """First and last firm place of a chunk and the ids between; two zeros if its own tokens don't end at both."""
        found, head = (0, 0, b""), _FIRST_FIRM(raw)
        if head:
            first, last = head.end(), _LAST_FIRM(raw).end()
            if first < last:
                ids, size = self.encode(raw.decode()), self.sizes
                i, at = 0, 0
                while at < first:
                    at += size[ids[i]]
                    i += 1
                j, end = len(ids), len(raw)
                while end > last:
                    j -= 1
                    end -= size[ids[j]]
                if at == first and end == last:
                    found = first, last, array("i", ids[i:j]).tobytes()
        return self._keep(self.middles, raw, found)

    def pack(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and values of the ids of all ``texts``."""
        raw = b"".join(texts)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
        places, firsts = batch_places(raw, offsets)
        places, bounds, ends = places.tolist(), firsts.tolist(), offsets.tolist()
        middles, joins, new_middle, new_join = self.middles.get, self.joins.get, self._middle, self._join
        parts, sizes, total = [], [0], 0
        for i in range(len(texts)):
            open_, start = ends[i], ends[i]  # where the join to be encoded begins, where the chunk does
            for end in (*places[bounds[i] : bounds[i + 1]], ends[i + 1]):
                chunk = raw[start:end]
                first, last, ids = middles(chunk) or new_middle(chunk)
                if last:
                    join = raw[open_ : start + first]
                    packed = joins(join) or new_join(join)
                    parts.append(packed)
                    parts.append(ids)
                    total += len(packed) + len(ids)
                    open_ = start + last
                start = end
            if open_ < start:
                join = raw[open_:start]
                packed = joins(join) or new_join(join)
                parts.append(packed)
                total += len(packed)
            sizes.append(total >> 2)
        return np.array(sizes, np.int32), np.frombuffer(b"".join(parts), np.int32)

    def __call__(self, raw: bytes) -> list[int]:
        return self.pack([raw])[1].tolist()


def _byte_encoder(table: bytes, pattern: str):
    """The byte-level encoder of a rank file's content; built once per worker."""
    cache, key = process_cache(), (len(table), hash(table), pattern)
    if key not in cache:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in table.splitlines() if line)}
        encode = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        sizes = [0] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        cache[key] = ChunkEncoder(encode, sizes)
    return cache[key]


def _other_encoder(name: str, content: bytes):
    """Direct encoders of the other vocabularies, without special tokens."""
    cache, key = process_cache(), (name, len(content), hash(content))
    if key not in cache:
        if name.endswith(".model"):
            import sentencepiece

            one = sentencepiece.SentencePieceProcessor(model_proto=content)
            cache[key] = lambda text: one.encode(text, num_threads=1)
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_str(content.decode())
            tok.encode_special_tokens = True
            cache[key] = lambda text: tok.encode(text, add_special_tokens=False).ids
    return cache[key]


def encode_corpus(docs: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(key, ids array<int>)`` for every row of ``docs``: null and empty texts give an empty list, null keys are kept.

    Strings that look like special tokens are ordinary text. The vocabulary file (under 2 MB) is read on the driver and
    broadcast; other columns aren't read. ``.tiktoken`` files use chunk reuse; others, and those under a ``pattern`` that isn't
    the package's own, so that nothing is known of its firm places, are encoded text by text.
    """
    content = Path(vocabulary_path(vocabulary, folder)).read_bytes()
    if len(content) > 64 << 20:
        raise ValueError("the vocabulary is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(content)
    ranked = vocabulary.endswith(".tiktoken")
    pat = (pattern or byte_pattern()) if ranked else ""
    by_chunks = ranked and pat == byte_pattern()
    source = docs.select(F.col(key), F.col(text).cast("binary").alias("__raw"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _byte_encoder(shared.value, pat) if ranked else _other_encoder(vocabulary, shared.value)
        whole = enc.encode if ranked else enc
        for batch in batches:
            raws = batch.column(1).fill_null(b"").to_pylist()
            if by_chunks:
                sizes, values = enc.pack(raws)
                ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(values))
            else:
                ids = pa.array([whole(raw.decode("utf-8", "replace")) if raw else [] for raw in raws], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return source.mapInArrow(run, f"`{key}` {kind}, ids array<int>")
