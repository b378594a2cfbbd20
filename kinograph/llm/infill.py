"""Fill-in-the-middle over seekable compressed frames.

``frame_store`` keeps a text as independent zstandard frames of at most ``FRAME`` bytes beside
running counts of units, code points and compressed bytes. A cut after k units is found by a search in
the counts; only the frame it falls into is decompressed. ``rearrange`` writes a rearranged text as
frames again: whole frames are copied compressed, cut ones written anew. ``output_texts`` gives the
texts, ``digests`` streams the frames in order.

A unit is a run of ASCII letters or one other code point. A frame may end inside a run: the counts
number the units that start in a frame, so a run of any length takes bounded memory.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rows

#: Bytes of text in a frame.
FRAME = 64 << 10
#: Bytes of frames after which a batch is handed on.
_BATCH = 8 << 20
_READ = 1 << 18


class Marks(NamedTuple):
    """The strings before each part of an output."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class Rates(NamedTuple):
    """Of a hundred texts, how many are rearranged, and of those how many start with the suffix."""

    rearranged: int = 90
    spm: int = 20


_STORE = "doc_id {id}, n long, chars long, marked boolean, frames binary, frame_at array<long>, unit_at array<long>, char_at array<long>"
_OUT = "doc_id {id}, n long, form string, prefix_chars long, middle_chars long, frames binary"


def unit_starts(data: np.ndarray, inside: bool = False) -> np.ndarray:
    """Which bytes of UTF-8 text start a unit; ``inside``: the byte before was a letter."""
    low = data | 0x20
    letter = (low >= 97) & (low <= 122)
    start = (data & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    if inside and len(start):
        start[0] &= not letter[0]
    return start


def _pieces(data: bytes, size: int) -> Iterator[bytes]:
    """Cuts of at most ``size`` bytes between code points."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def _letter(byte: int) -> bool:
    return 97 <= byte | 0x20 <= 122


def _framed(data: bytes, size: int, pack) -> tuple[list, list, list, list]:
    frames, frame_at, unit_at, char_at = [], [0], [0], [0]
    inside = False
    for piece in _pieces(data, size):
        raw = np.frombuffer(piece, np.uint8)
        frames.append(pack(piece))
        frame_at.append(frame_at[-1] + len(frames[-1]))
        unit_at.append(unit_at[-1] + int(np.count_nonzero(unit_starts(raw, inside))))
        char_at.append(char_at[-1] + int(np.count_nonzero((raw & 0xC0) != 0x80)))
        inside = _letter(piece[-1])
    return frames, frame_at, unit_at, char_at


def _stored(size: int, level: int, marks: Marks):
    words = [m.encode() for m in marks]
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), *[pa.list_(pa.int64())] * 3)
    names = ["doc_id", "n", "chars", "marked", "frames", "frame_at", "unit_at", "char_at"]

    def run(batches):
        pack = zstandard.ZstdCompressor(level=level).compress
        for batch in batches:
            ids, texts, held, weight, first = batch.column("doc_id"), batch.column("text").cast(pa.binary()), [], 0, 0
            for k in range(batch.num_rows):
                data = texts[k].as_py() or b""
                frames, frame_at, unit_at, char_at = _framed(data, size, pack)
                held.append((unit_at[-1], char_at[-1], any(m in data for m in words), b"".join(frames), frame_at, unit_at, char_at))
                weight += frame_at[-1]
                if weight >= _BATCH or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(first, len(held)), *(pa.array(c, t) for c, t in zip(zip(*held), kinds))], names=names)
                    held, weight, first = [], 0, k + 1
    return run


def frame_store(docs: DataFrame, id: str = "doc_id", text: str = "text", marks: Marks = Marks(), frame_bytes: int = FRAME, level: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units), chars, marked (the text holds one of ``marks``),
    frames, and where each frame starts in compressed bytes, units and code points, ends included.

    Null texts are empty: no frames, n 0. Null and repeated ids are rows like others; other columns are
    not read; an empty table gives no rows. One pass without a shuffle; a task holds one text at a time
    beside its batch.
    """
    base = rows.keyed(docs, id, text).drop("text_hash")
    return base.mapInArrow(_stored(frame_bytes, level, marks), _STORE.format(id=dict(base.dtypes)["doc_id"]))


class _Reader:
    """The frames of one text."""

    def __init__(self, frames: bytes, frame_at, unit_at, char_at):
        self.blob, self.frame_at, self.unit_at, self.char_at, self.open = memoryview(frames), frame_at, unit_at, char_at, {}

    def frame(self, k: int) -> bytes:
        if k not in self.open:
            self.open[k] = zstandard.ZstdDecompressor().decompress(self.blob[self.frame_at[k]:self.frame_at[k + 1]])
        return self.open[k]

    def seek(self, units: int) -> tuple[int, int, int]:
        """Frame, byte in it and code points before the place after so many units."""
        k = int(np.searchsorted(self.unit_at, units, "right")) - 1
        if k == len(self.unit_at) - 1:
            return k, 0, self.char_at[-1]
        raw = np.frombuffer(self.frame(k), np.uint8)
        starts = np.flatnonzero(unit_starts(raw))
        # One start too many: the first byte goes on with a run of the frame before.
        starts = starts[len(starts) - (self.unit_at[k + 1] - self.unit_at[k]):]
        byte = int(starts[units - self.unit_at[k]])
        return k, byte, self.char_at[k] + int(np.count_nonzero((raw[:byte] & 0xC0) != 0x80))

    def part(self, a: tuple[int, int, int], b: tuple[int, int, int], pack) -> Iterator[bytes]:
        """The frames between two places."""
        k, byte = a[:2]
        if k == b[0]:
            if byte < b[1]:
                yield pack(self.frame(k)[byte:b[1]])
            return
        if byte:
            yield pack(self.frame(k)[byte:])
            k += 1
        yield bytes(self.blob[self.frame_at[k]:self.frame_at[b[0]]])
        if b[1]:
            yield pack(self.frame(b[0])[:b[1]])


def draws(doc_id, seed: int = 1) -> list[int]:
    """Four unsigned 32-bit numbers of an id; a null id counts as empty."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k:k + 4], "big") for k in range(0, 16, 4)]


def _rearranged(marks: Marks, rates: Rates, seed: int, level: int):
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "frames"]

    def run(batches):
        pack = zstandard.ZstdCompressor(level=level).compress
        mark = Marks(*(pack(m.encode()) for m in marks))
        for batch in batches:
            ids, held, weight, first = batch.column("doc_id"), [], 0, 0
            n, marked, frames = (batch.column(c) for c in ("n", "marked", "frames"))
            at = [batch.column(c) for c in ("frame_at", "unit_at", "char_at")]
            for k in range(batch.num_rows):
                units, blob = n[k].as_py(), frames[k].as_py()
                h = draws(ids[k].as_py(), seed)
                if not units or marked[k].as_py() or h[2] % 100 >= rates.rearranged:
                    held.append((units, "plain", None, None, blob))
                else:
                    text = _Reader(blob, *(c[k].as_py() for c in at))
                    start, end = (0, 0, 0), (len(text.frame_at) - 1, 0, text.char_at[-1])
                    a, b = (text.seek(x) for x in sorted((h[0] % (units + 1), h[1] % (units + 1))))
                    prefix, middle, suffix = (b"".join(text.part(x, y, pack)) for x, y in ((start, a), (a, b), (b, end)))
                    spm = h[3] % 100 < rates.spm
                    parts = [mark.suffix, suffix, mark.prefix, prefix] if spm else [mark.prefix, prefix, mark.suffix, suffix]
                    held.append((units, "spm" if spm else "psm", a[2], b[2] - a[2], b"".join([*parts, mark.middle, middle])))
                weight += len(held[-1][-1])
                if weight >= _BATCH or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(first, len(held)), *(pa.array(c, t) for c, t in zip(zip(*held), kinds))], names=names)
                    held, weight, first = [], 0, k + 1
    return run


def rearrange(store: DataFrame, marks: Marks = Marks(), rates: Rates = Rates(), seed: int = 1, level: int = 3) -> DataFrame:
    """One row per row of ``frame_store``: doc_id, n, form (plain, psm, spm), prefix_chars,
    middle_chars (null if plain) and the output as frames.

    The cuts are two draws from 0 to n units, by hash of seed and id; empty parts are allowed. Texts
    that are empty, that hold a mark or that are not drawn stay plain. ``marks`` must be those of the
    store.
    """
    return store.mapInArrow(_rearranged(marks, rates, seed, level), _OUT.format(id=dict(store.dtypes)["doc_id"]))


def _read(frames: bytes) -> Iterator[bytes]:
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(frames), read_across_frames=True) as stream:
        while piece := stream.read(_READ):
            yield piece


def _range(frames: bytes, start: int, end: int | None) -> Iterator[bytes]:
    """Bytes start to end of the frames' text."""
    at = 0
    for piece in _read(frames):
        if end is not None and at >= end:
            return
        if at + len(piece) > start:
            yield piece[max(0, start - at):None if end is None else end - at]
        at += len(piece)


def _find(frames: bytes, marks: list[bytes]) -> list[int]:
    """Where each mark first stands; each stands once, in this order."""
    found, at, before = [], 0, b""
    for piece in _read(frames):
        now = before + piece
        while len(found) < len(marks) and (k := now.find(marks[len(found)])) >= 0:
            found.append(at - len(before) + k)
            now, at, before = now[k:], at + k - len(before), b""
        at, before = at + len(now) - len(before), now[-16:]
    return found


def restored(frames: bytes, form: str, marks: Marks = Marks()) -> Iterator[bytes]:
    """The text, read back from an output and its form."""
    if form == "plain":
        yield from _read(frames)
        return
    p, s, m = (x.encode() for x in marks)
    order = [p, s, m] if form == "psm" else [s, p, m]
    at = dict(zip(order, _find(frames, order)))
    yield from _range(frames, at[p] + len(p), at[s] if form == "psm" else at[m])
    yield from _range(frames, at[m] + len(m), None)
    yield from _range(frames, at[s] + len(s), at[m] if form == "psm" else at[p])


def _digested(marks: Marks):
    def sha(pieces) -> str:
        state = hashlib.sha256()
        for piece in pieces:
            state.update(piece)
        return state.hexdigest()

    def run(batches):
        for batch in batches:
            out, back = [], []
            frames, forms = batch.column("frames"), batch.column("form").to_pylist()
            for k, form in enumerate(forms):
                blob = frames[k].as_py()
                out.append(sha(_read(blob)))
                back.append(sha(restored(blob, form, marks)))
            kept = batch.select(["doc_id", "n", "form", "prefix_chars", "middle_chars"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.string()), pa.array(back, pa.string())],
                                             names=[*kept.schema.names, "output_sha256", "restored_sha256"])
    return run


def digests(out: DataFrame, marks: Marks = Marks()) -> DataFrame:
    """``rearrange``'s rows with digests of the output and of the text read back from it in place of
    the frames, which are streamed in order."""
    kind = _OUT.format(id=dict(out.dtypes)["doc_id"]).replace("frames binary", "output_sha256 string, restored_sha256 string")
    return out.mapInArrow(_digested(marks), kind)


def _text(marks: Marks):
    def run(batches):
        for batch in batches:
            frames, forms, held, weight, first = batch.column("frames"), batch.column("form").to_pylist(), [], 0, 0
            for k, form in enumerate(forms):
                blob = frames[k].as_py()
                held.append((b"".join(_read(blob)).decode(), b"".join(restored(blob, form, marks)).decode()))
                weight += len(held[-1][0])
                if weight >= _BATCH or k + 1 == batch.num_rows:
                    kept = batch.slice(first, len(held)).select(["doc_id", "n", "form", "prefix_chars", "middle_chars"])
                    yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, pa.string()) for c in zip(*held))],
                                                     names=[*kept.schema.names, "output", "restored"])
                    held, weight, first = [], 0, k + 1
    return run


def output_texts(out: DataFrame, marks: Marks = Marks()) -> DataFrame:
    """``rearrange``'s rows with the output and the text read back from it as strings."""
    kind = _OUT.format(id=dict(out.dtypes)["doc_id"]).replace("frames binary", "output string, restored string")
    return out.mapInArrow(_text(marks), kind)


def op13_seekable_frames(spark, sf_dir: str) -> DataFrame:
    """All documents: stored as frames, rearranged by their ids, and both directions digested."""
    store = rows.land(frame_store(rows.table(spark, sf_dir, "documents")), "frames")
    return digests(rearrange(store))


#: Integers that may be null are doubles here, as Spark hands them to a data frame.
OP13_SQL = r"""
WITH given AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM given),
cut AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM drawn),
parts AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS DOUBLE) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS DOUBLE) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
