"""Best-fit packing of token sequences with a bounded number of open bins.

Each task reads its documents once, tokenizes them and packs as it goes: nothing is shuffled. The
open bins hang in lists keyed by their free space, and a bitset marks the spaces in use, so the
tightest bin that still takes a piece is one shift and one lowest-bit away. When a new bin is needed
and all slots are open, the fullest bin closes.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rows

_TAIL = re.compile(rb"([^\x00-\x20]*[a-z])([!-/:-@\[-`{-~]+)")
CAPACITY, OPEN_BINS, END_ID = 4096, 512, 1
_SCHEMA = "doc_id {id}, text_hash long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """A fixed number of open bins; ``place`` says the bin and the offset of a piece in it."""

    def __init__(self, capacity: int, slots: int, first: int = 0):
        self.capacity, self.slots, self.next = capacity, slots, first
        self.mask, self.count = 0, 0
        self.by_space: dict[int, list[int]] = {}

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        bin_ = bins.pop()
        if not bins:
            del self.by_space[space]
            self.mask &= ~(1 << space)
        self.count -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        fits = self.mask >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(space)
        else:
            space, bin_, self.next = self.capacity, self.next, self.next + 1
        left = space - length
        if left:
            if self.count == self.slots:
                self._take((self.mask & -self.mask).bit_length() - 1)  # closed: the fullest
            self.by_space.setdefault(left, []).append(bin_)
            self.mask |= 1 << left
            self.count += 1
        return bin_, self.capacity - space


class WordIds:
    """Token ids, as little-endian bytes, of white-space-separated chunks.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    chunks in order. Chunks are remembered up to ``limit`` entries per worker, then forgotten.
    """

    def __init__(self, tokenizer: str, limit: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known = Tokenizer.from_str(tokenizer), limit, {}

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """Words of letters alone are one pre-token each, so many are encoded as one text and parted
        by the tokenizer's own word numbers; anything else is encoded by itself."""
        if all(map(str.isalpha, chunks)):
            found = self.tokenizer.encode(" ".join(chunks), add_special_tokens=False)
            ids = np.asarray(found.ids, "<u4")
            ends = np.searchsorted(np.asarray(found.word_ids), np.arange(1, len(chunks) + 1)) * 4
            if len(ids) and found.word_ids[-1] == len(chunks) - 1:
                data = ids.tobytes()
                return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def learn(self, chunks: list[bytes]) -> None:
        """ASCII punctuation behind an ASCII letter, up to the chunk's end, is a token run of its own,
        unless a special token such as <|endoftext|> reaches into it: such chunks stay whole."""
        parts = {c: m.groups() for c in chunks if b"<|" not in c and (m := _TAIL.fullmatch(c))}
        new = {x for ab in parts.values() for x in ab}.union(c for c in chunks if c not in parts).difference(self.known)
        words, others = [], []
        for c in new:
            (words if (text := c.decode("utf-8", "replace")).isalpha() else others).append((c, text))
        for group, step in ((words, 200), (others, 2000)):
            for k in range(0, len(group), step):
                part = group[k:k + step]
                self.known.update(zip([c for c, _ in part], self._ids([t for _, t in part])))
        for c, (stem, tail) in parts.items():
            self.known[c] = self.known[stem] + self.known[tail]

    def of(self, texts: list[bytes]) -> list[bytes]:
        # Lower-casing ASCII letters first is what the tokenizer does anyway, but it could make a
        # special token's name out of capitals, so such texts stay as they are.
        chunks = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if len(self.known) > self.limit:
            self.known = {}
        new = set().union(*chunks).difference(self.known)
        if new:
            new = list(new)
            for k in range(0, len(new), 20_000):
                self.learn(new[k:k + 20_000])
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in chunks]


def _pack(tokenizer, capacity: int, slots: int, step: int, kinds):
    def run(batches):
        from pyspark import TaskContext

        ids = rows.worker_cache(("packing", hash(tokenizer.value)), lambda: WordIds(tokenizer.value))
        bins = OpenBins(capacity, slots, TaskContext.get().partitionId() << 33)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            hashes, texts = batch.column("text_hash").to_pylist(), rows.utf8(batch.column("text"))
            for low in range(0, batch.num_rows, step):
                pieces = []
                for k, data in enumerate(ids.of([t or b"" for t in texts[low:low + step]]), low):
                    data += end
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at:at + 4 * capacity]
                        pieces.append((k, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                # Of the few documents at hand the long pieces go first, which leaves the short ones to fill gaps.
                pieces.sort(key=lambda p: -p[3])
                put = [bins.place(p[3]) for p in pieces]
                at = pa.array([p[0] for p in pieces], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(at), pa.array([hashes[p[0]] for p in pieces], pa.int64()),
                    *[pa.array([p[i] for p in pieces], t) for i, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64()), (4, pa.int64()))],
                    pa.array([b for b, _ in put], pa.int64()), pa.array([o for _, o in put], pa.int64())], names=kinds)
    return run


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer's file as text, read on the driver; ``path`` defaults to the public word BPE."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY,
         open_bins: int = OPEN_BINS, lookahead: int = 500) -> DataFrame:
    """One row per piece: doc_id, text_hash, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and an end id; null and empty texts are the end id alone. Only longer ones
    are cut. ``lookahead`` documents are placed together, longest pieces first. Memory is that of
    ``lookahead`` documents, ``open_bins`` integers and the word cache. ``tokenizer`` is a file's
    text (``tokenizer_json``), broadcast: its size is that of a vocabulary. Bins never span tasks:
    the price is at most the last, half-empty bin of each task. Rows with null or repeated ids are
    packed like any other; other columns are not read; an empty table gives no rows.
    """
    base = rows.keyed(docs, id, text)
    schema = _SCHEMA.format(id=dict(base.dtypes)["doc_id"])
    names = [c.split()[0] for c in schema.split(", ")]
    given = docs.sparkSession.sparkContext.broadcast(tokenizer or tokenizer_json())
    return base.mapInArrow(_pack(given, capacity, open_bins, lookahead, names), schema)


def op8_best_fit(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack(rows.table(spark, sf_dir, "documents")).drop("text_hash")
