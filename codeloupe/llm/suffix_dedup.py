"""Exact-substring deduplication with a sparse, distributed suffix array.

Every byte covered by a window of ``WINDOW`` bytes that also starts earlier is removed. Sorting the
suffix at every byte would shuffle each of them, so a lossless sieve first leaves only the places
where an order of suffixes is needed:

1. Each window selects one of its ``ANCHOR``-byte strings, the leftmost of smallest hash. Equal
   windows select it at the same place, so they are found by equal anchors. Consecutive windows
   that select the same anchor are one run, a stretch of some 140 bytes, and one small record:
   hashes of its anchor, of its stretch, and of 60 bytes to either side of the anchor.
2. Records are shuffled by anchor. Runs of equal stretches hold equal windows throughout: all but
   the first are removed whole, without a look at their windows. What is left is one run for each
   distinct stretch. Only those whose anchor and one of the 60-byte sides recur elsewhere can hold a
   window of another one; such are the edges of repeated passages.
3. These runs' stretches are range-partitioned by the suffix at their anchor, with whole anchors of a
   sample as splitters. Each bucket sorts the suffixes at all their windows by a multikey
   quicksort that splits on eight bytes at a time, and removes equal neighbours but the first. Equal
   windows have equal anchors, and splitters cut between different anchors, so no run of equal ones
   crosses a bucket's boundary.

No step needs a group of equal strings in one place: a task sends one record of a stretch at most,
the first it has seen, and removes its others itself. An anchor in very many different stretches (at
the edge of a passage that many documents share) is crowded: a task sends one record for each
different side of it, and in step 3 its windows go to buckets by their own hashes instead, the first
of equal ones only.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloupe.llm.common import columns, partitions, shared_folder, slices

WINDOW = 100
ANCHOR = 20
#: Anchors of a window; a window reaches SIDE bytes beyond its anchor on one side at least.
PLACES = WINDOW - ANCHOR + 1
SIDE = (WINDOW - ANCHOR) // 2
#: Runs of one anchor and different stretches that a task sends as records, and that a bucket sorts together.
CROWD, BUCKET_CROWD = 256, 8192
#: Runs that a task gathers before it sends them, and bytes of windows likewise.
RUNS, WINDOW_BYTES = 300_000, 24 << 20
#: Bytes of text that are worked on at once.
TEXT_BYTES = 1 << 20
#: Hash values of doc_ids by which documents that take part in a step are told from others.
MARKS = 1 << 18
#: Splitters are whole anchors of a sample; its size at least, and for each bucket.
LEAD, SAMPLE, PER_BUCKET = ANCHOR, 20_000, 8
#: Bytes of texts, or of windows to compare, that one bucket holds on average at most.
BUCKET_BYTES = 64 << 20
#: Low bits of an anchor's hash that give way to its place, the same for all slices: equal windows choose equal anchors.
PLACE_BITS = 22
CUT, FINE, LEADS, CROWDED = 0, 1, 2, 3
#: ``more``: windows after the first one, and CROWD_BIT; ``off``: bytes from the stretch's start to its anchor.
RECORD = np.dtype([("h", "<u8"), ("s", "<u8"), ("r", "<u2"), ("l", "<u2"), ("doc", "<i8"), ("a", "<u4"), ("more", "u1"), ("off", "u1")])
CROWD_BIT = 128

BASE = 0x9E3779B97F4A7C15 | 5  # odd, so that it has an inverse


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of ``BASE`` and of its inverse modulo 2^64, as many as were needed so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, TEXT_BYTES + 4096)
            for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, b & ((1 << 64) - 1), np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))
        return cls.up, cls.down


def blocks(texts: list[bytes], docs: np.ndarray) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts, their documents and offsets; of a text over ``TEXT_BYTES`` a block after the other.

    Blocks overlap so that each window is in one of them. A run that a block's end cuts is two runs,
    which are settled like any others.
    """
    short = [i for i, t in enumerate(texts) if len(t) <= TEXT_BYTES]
    if short:
        yield [texts[i] for i in short], docs[short], np.zeros(len(short), np.int64)
    for i, text in enumerate(texts):
        if len(text) > TEXT_BYTES:
            for at in range(0, len(text) - WINDOW + 1, TEXT_BYTES):
                yield [text[at : at + TEXT_BYTES + WINDOW - 1]], docs[i : i + 1], np.array([at])


def runs(texts: list[bytes], docs: np.ndarray, offsets: np.ndarray | None = None) -> tuple[np.ndarray, list[bytes]]:
    """The records of all runs of some texts, and the anchors of a few of them; 2 ^ PLACE_BITS bytes at most."""
    keep = [i for i, t in enumerate(texts) if len(t) >= WINDOW]
    if not keep:
        return np.zeros(0, RECORD), []
    sizes = np.array([len(texts[i]) for i in keep])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    buffer = b"".join(texts[i] for i in keep)
    data = np.frombuffer(buffer + bytes(8), np.uint8)
    n = len(buffer)
    up, down = Powers.of(n + 1)
    eights = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[:n]).view("<u8").ravel()
    e = mixed(eights)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(e * up[:n], out=sums[1:])

    def hashed(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:  # of bytes lo to hi, 8 at least
        return mixed((sums[hi - 7] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))

    m = n - ANCHOR + 1
    h = mixed(e[:m] * np.uint64(0xA0761D6478BD642F) + e[8 : 8 + m] * np.uint64(0xE7037ED1A0B428DB) + e[12 : 12 + m])
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = (h & ~place) | np.arange(m, dtype=np.uint64)
    width = 1
    while width * 2 <= PLACES:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    w = n - WINDOW + 1
    chosen = (np.minimum(least[:w], least[PLACES - width : PLACES - width + w]) & place).astype(np.int64)
    valid = np.zeros(w + 1, bool)
    for lo, hi in zip(begins.tolist(), ends.tolist()):
        valid[lo : hi - WINDOW + 1] = True
    turn = np.empty(w + 1, bool)  # whether a window differs from the one before
    turn[0] = turn[w] = True
    turn[1:w] = (chosen[1:] != chosen[:-1]) | ~valid[: w - 1]
    a = np.flatnonzero(valid[:w] & turn[:w])
    b = np.flatnonzero(valid[:w] & (turn[1:] | ~valid[1:]))
    s = chosen[a]
    out = np.empty(len(a), RECORD)
    out["h"], out["s"] = h[s], hashed(a, b + WINDOW)
    right, left = s + ANCHOR + SIDE <= b + WINDOW, s - SIDE >= a
    out["r"] = np.where(right, hashed(s, np.where(right, s + ANCHOR + SIDE, s + ANCHOR)) % np.uint64(65535) + np.uint64(1), np.uint64(0))
    out["l"] = np.where(left, hashed(np.where(left, s - SIDE, s), s + ANCHOR) % np.uint64(65535) + np.uint64(1), np.uint64(0))
    row = np.searchsorted(ends, a, side="right")
    out["doc"], out["a"], out["more"], out["off"] = docs[keep][row], a - begins[row], b - a, s - a
    if offsets is not None:
        out["a"] += offsets[keep][row].astype(np.uint32)
    some = np.flatnonzero(mixed(out["s"]) % np.uint64(2048) == 0)
    return out, [buffer[i : i + LEAD] for i in s[some].tolist()]


def heads(x: np.ndarray, *names: str) -> np.ndarray:
    """Where a sorted array's rows differ from the one before in the named fields."""
    new = np.ones(len(x), bool)
    if len(x):
        new[1:] = np.logical_or.reduce([x[k][1:] != x[k][:-1] for k in names])
    return new


def firsts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first run of each stretch, sorted by anchor and stretch, and the other runs."""
    x = x[np.lexsort((x["a"], x["doc"], x["s"], x["h"]))]
    new = heads(x, "h", "s")
    return x[new], x[~new]


def shared_sides(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of different stretches: which share a side with another of their anchor; which are the first with one of their sides."""
    shared, leads = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for side in ("r", "l"):
        own = np.flatnonzero(x[side] > 0)
        order = own[np.lexsort((x[side][own], x["h"][own]))]
        new = heads(x[order], "h", side)
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        shared[order] |= np.repeat(size > 1, size)
        leads[order] |= new
    return shared, leads


def rows(kind: int, doc: np.ndarray, a: np.ndarray, e: np.ndarray, off: np.ndarray | None = None) -> dict[str, pa.Array]:
    n = len(doc)
    return {"kind": pa.array(np.full(n, kind, np.int32)), "doc": pa.array(doc.astype(np.int64)), "a": pa.array(a.astype(np.int32)), "e": pa.array(e.astype(np.int32)), "off": pa.nulls(n, pa.int32()) if off is None else pa.array(off.astype(np.int32)), "lead": pa.nulls(n, pa.binary())}


FOUND = "kind int, doc long, a int, e int, off int, lead binary"
FOUND_ARROW = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("a", pa.int32()), ("e", pa.int32()), ("off", pa.int32()), ("lead", pa.binary())])
SENT = "bucket int, doc long, a int, e int, off int, lead binary, kind int, packed binary"
SENT_ARROW = pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("a", pa.int32()), ("e", pa.int32()), ("off", pa.int32()), ("lead", pa.binary()), ("kind", pa.int32()), ("packed", pa.binary())])


def sent(n: int, **given) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if isinstance(given.get(f.name), pa.Array) else pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in SENT_ARROW], schema=SENT_ARROW)


def passed(doc: np.ndarray, a: np.ndarray, e: np.ndarray, kind: int, buckets: int) -> pa.RecordBatch:
    """Spans that need no further look; they only pass through the next step."""
    return sent(len(doc), bucket=(doc % buckets).astype(np.int32), doc=doc, a=a.astype(np.int32), e=e.astype(np.int32), kind=np.full(len(doc), kind, np.int32))


def merged(doc: np.ndarray, a: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents, those that overlap or touch put together."""
    order = np.lexsort((a, doc))
    doc, a, e = doc[order], a[order].astype(np.int64), e[order].astype(np.int64)
    if not len(doc):
        return doc, a, e
    far = np.maximum.accumulate(e + (np.cumsum(np.append(0, doc[1:] != doc[:-1])) << 33)) & ((1 << 33) - 1)
    new = np.append(True, (doc[1:] != doc[:-1]) | (a[1:] > far[:-1]))
    at = np.flatnonzero(new)
    return doc[at], a[at], far[np.append(at[1:], len(doc)) - 1]


def packed(order: np.ndarray, bucket: np.ndarray, pack: Callable[[np.ndarray], bytes]) -> pa.RecordBatch | None:
    """One row for each bucket with what ``pack`` makes of its members; ``order`` sorts them by bucket."""
    if not len(order):
        return None
    b = bucket[order]
    at = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    blobs = [pack(order[lo:hi]) for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(order)])]
    return sent(len(at), bucket=b[at].astype(np.int32), packed=blobs)


def sift(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Step 1: texts to records by bucket of their anchors, and what the task can settle itself."""

    def emit(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        first, other = firsts(np.concatenate(gathered))
        if len(other):
            doc, a, e = merged(other["doc"], other["a"], other["a"].astype(np.int64) + other["more"] + WINDOW)
            yield passed(doc, a, e, CUT, buckets)
        size = np.diff(np.append(np.flatnonzero(heads(first, "h")), len(first)))
        crowded = np.repeat(size > CROWD, size)
        if crowded.any():
            crowd = first[crowded]
            yield passed(crowd["doc"], crowd["a"], crowd["a"].astype(np.int64) + crowd["more"] + WINDOW, CROWDED, buckets)
            _, leads = shared_sides(crowd)
            crowd["more"] |= CROWD_BIT
            first = np.concatenate([first[~crowded], crowd[leads]])
        bucket = (first["h"] % np.uint64(buckets)).astype(np.int64)
        # Column after column: what is small or repeats in a column packs well.
        made = packed(np.argsort(bucket, kind="stable"), bucket, lambda own: b"".join(np.ascontiguousarray(first[k][own]).tobytes() for k in RECORD.names))
        if made:
            yield made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, n, leads = [], 0, []
        for batch in batches:
            for part, texts in slices(batch, "text", TEXT_BYTES):
                for block in blocks(texts, part.column(0).to_numpy(zero_copy_only=False)):
                    found, some = runs(*block)
                    gathered.append(found)
                    leads += some
                    n += len(found)
                    if n >= RUNS:
                        yield from emit(gathered)
                        gathered, n = [], 0
        if n:
            yield from emit(gathered)
        if leads:
            yield sent(len(leads), bucket=[i % buckets for i in range(len(leads))], lead=leads, kind=[LEADS] * len(leads))

    return run


def unpacked(blob: bytes) -> np.ndarray:
    n, at = len(blob) // RECORD.itemsize, 0
    out = np.empty(n, RECORD)
    for k in RECORD.names:
        kind = RECORD.fields[k][0]
        out[k] = np.frombuffer(blob, kind, n, at)
        at += n * kind.itemsize
    return out


def split(batch: pa.RecordBatch) -> tuple[pa.RecordBatch | None, list[bytes]]:
    """The settled rows of a batch as ``FOUND``, and its packed rows."""
    table = pa.Table.from_batches([batch])
    kinds = table.column("kind").to_numpy(zero_copy_only=False)
    done = table.filter(pa.array(~np.isnan(kinds.astype(float)))).select(FOUND_ARROW.names).combine_chunks().to_batches()
    return (done[0].cast(FOUND_ARROW) if done else None), [x for x in table.column("packed").to_pylist() if x is not None]


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2: the runs of a bucket of anchors to spans that go and runs that need their windows compared."""
    gathered = []
    for batch in batches:
        done, blobs = split(batch)
        if done is not None and done.num_rows:
            yield done
        gathered += map(unpacked, blobs)
    if gathered:
        every = np.concatenate(gathered)
        marked = np.unique(every["h"][every["more"] >= CROWD_BIT])
        every["more"] &= CROWD_BIT - 1
        first, other = firsts(every)
        shared, _ = shared_sides(first)
        size = np.diff(np.append(np.flatnonzero(heads(first, "h")), len(first)))
        crowded = np.isin(first["h"], marked) | np.repeat(size > BUCKET_CROWD, size)
        for kind, x in ((CUT, other), (FINE, first[shared & ~crowded]), (CROWDED, first[crowded])):
            doc, a, e, off = x["doc"], x["a"].astype(np.int64), x["a"].astype(np.int64) + x["more"] + WINDOW, x["off"]
            if kind == CUT:
                doc, a, e = merged(doc, a, e)
            for i in range(0, len(doc), 1 << 18):
                c = slice(i, i + (1 << 18))
                yield pa.RecordBatch.from_pydict(rows(kind, doc[c], a[c], e[c], off[c] if kind == FINE else None), schema=FOUND_ARROW)


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: the order of the rows, and where a row differs from the one before.

    ``words`` holds a key's bytes as big-endian numbers, eight bytes a column. A column splits what
    the columns before left equal; rows that are alone are not looked at again.
    """
    n = len(words)
    order, group = np.arange(n), np.zeros(n, np.int64)
    live = np.arange(n)  # places of the order whose group isn't single
    for c in range(words.shape[1]):
        if not len(live):
            break
        value = words[order[live], c]
        by = np.lexsort((value, group[live]))
        order[live], value, own = order[live][by], value[by], group[live][by]
        new = np.append(True, (own[1:] != own[:-1]) | (value[1:] != value[:-1]))
        at = np.flatnonzero(new)
        group[live] = live[at][np.cumsum(new) - 1]  # a group's name: its first place
        size = np.diff(np.append(at, len(live)))
        live = live[np.repeat(size > 1, size)]
    return order, np.append(True, group[1:] != group[:-1]) if n else np.zeros(0, bool)


def sort_windows(text: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows (``WINDOW`` bytes a row): numbers of the first of each kind, and of the others."""
    wide = np.zeros((len(text), -(-WINDOW // 8) * 8), np.uint8)
    wide[:, :WINDOW] = text
    pre = np.lexsort((at, doc))  # the sort is stable, so equal windows stay in order
    order, new = suffix_order(wide.view(">u8").astype(np.uint64)[pre])
    order = pre[order]
    return order[new], order[~new]


def window_bucket(text: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of windows by a hash of all their bytes."""
    wide = np.zeros((len(text), -(-WINDOW // 8) * 8), np.uint8)
    wide[:, :WINDOW] = text
    words = wide.view("<u8")
    h = np.zeros(len(text), np.uint64)
    for k in range(words.shape[1]):
        h = mixed(h + words[:, k])
    return (h % np.uint64(buckets)).astype(np.int64)


def spread(splitters: np.ndarray, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Step 3, first half: documents with runs to their stretches, by bucket of the suffix at the anchor; or to the windows of crowded ones."""

    def emit_runs(runs_: list[tuple[bytes, int, int, int]]) -> Iterator[pa.RecordBatch]:
        lead = np.array([t[off : off + LEAD] for t, _, _, off in runs_], f"S{LEAD}")
        bucket = np.searchsorted(splitters, lead, side="right")

        def pack(own: np.ndarray) -> bytes:
            mine = [runs_[i] for i in own.tolist()]
            fields = ((1, "<i8"), (2, "<i4"), (3, "u1"))
            return b"S" + np.int64(len(mine)).tobytes() + np.array([len(x[0]) for x in mine], "u1").tobytes() + b"".join(np.array([x[k] for x in mine], t).tobytes() for k, t in fields) + b"".join(x[0] for x in mine)

        if made := packed(np.argsort(bucket, kind="stable"), bucket, pack):
            yield made

    def emit_windows(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        text, doc, at = (np.concatenate(x) for x in zip(*parts))
        first, other = sort_windows(text, doc, at)
        if len(other):
            yield passed(*merged(doc[other], at[other], at[other] + WINDOW), CUT, buckets)
        bucket = window_bucket(text[first], buckets)
        pack = lambda own: b"W" + np.int64(len(own)).tobytes() + text[first[own]].tobytes() + doc[first[own]].astype("<i8").tobytes() + at[first[own]].astype("<i4").tobytes()
        if made := packed(np.argsort(bucket, kind="stable"), bucket, pack):
            yield made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_, parts, size = [], [], 0
        for batch in batches:
            for part, texts in slices(batch, "text", TEXT_BYTES):
                for doc, raw, listed in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist()):
                    crowded = []
                    for x in listed or ():
                        if x["kind"] == FINE:
                            runs_.append((raw[x["a"] : x["e"]], doc, x["a"], x["off"]))
                        else:
                            crowded.append(np.arange(x["a"], x["e"] - WINDOW + 1))
                    if len(runs_) >= RUNS:
                        yield from emit_runs(runs_)
                        runs_ = []
                    if not crowded:
                        continue
                    views = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), WINDOW)
                    at = np.unique(np.concatenate(crowded))
                    for i in range(0, len(at), WINDOW_BYTES // WINDOW):
                        own = at[i : i + WINDOW_BYTES // WINDOW]
                        parts.append((views[own], np.full(len(own), doc, np.int64), own))
                        size += len(own) * WINDOW
                        if size >= WINDOW_BYTES:
                            yield from emit_windows(parts)
                            parts, size = [], 0
        if runs_:
            yield from emit_runs(runs_)
        if parts:
            yield from emit_windows(parts)

    return run


def cuts_of(text: np.ndarray, doc: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The spans of all windows but the first of each kind."""
    _, other = sort_windows(text, doc, at)
    doc, a, e = merged(doc[other], at[other], at[other].astype(np.int64) + WINDOW)
    for i in range(0, len(doc), 1 << 18):
        c = slice(i, i + (1 << 18))
        yield pa.RecordBatch.from_pydict(rows(CUT, doc[c], a[c], e[c]), schema=FOUND_ARROW)


def windows_of(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of packed stretches, some at a time: all of one distance to their anchors together.

    Equal windows have their anchors at equal distances, and an anchor in one stretch alone has no
    equal window elsewhere.
    """
    longest = WINDOW + PLACES
    text, size, doc, a, off = [], [], [], [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, "<i8", 1, 1)[0])
        at = 9
        own = []
        for kind in ("u1", "<i8", "<i4", "u1"):
            own.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
        wide = np.zeros((n, longest), np.uint8)
        wide[np.arange(longest) < own[0][:, None]] = np.frombuffer(blob, np.uint8, offset=at)
        for x, y in zip((text, size, doc, a, off), (wide, *own)):
            x.append(y)
    wide, n, doc, a, off = np.concatenate(text), *(np.concatenate(x).astype(np.int64) for x in (size, doc, a, off))
    anchors = np.ascontiguousarray(wide[np.arange(len(wide))[:, None], off[:, None] + np.arange(ANCHOR)]).view(f"V{ANCHOR}").ravel()
    _, back, times = np.unique(anchors, return_inverse=True, return_counts=True)
    own = times[back] > 1
    wide, n, doc, a, off = wide[own], n[own], doc[own], a[own], off[own]
    parts, rows_ = [], 0
    for distance in range(PLACES):
        start = off - distance
        has = np.flatnonzero((start >= 0) & (start + WINDOW <= n))
        if not len(has):
            continue
        parts.append((wide[has[:, None], start[has][:, None] + np.arange(WINDOW)], doc[has], a[has] + start[has]))
        rows_ += len(has)
        if rows_ >= WINDOW_BYTES // WINDOW:
            yield tuple(np.concatenate(x) for x in zip(*parts))
            parts, rows_ = [], 0
    if parts:
        yield tuple(np.concatenate(x) for x in zip(*parts))


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3, second half: sorts a bucket's suffixes; all but the first of equal windows are spans that go."""
    stretches, parts = [], []
    for batch in batches:
        done, blobs = split(batch)
        if done is not None and done.num_rows:
            yield done
        for blob in blobs:
            if blob[:1] == b"S":
                stretches.append(blob)
                continue
            n = int(np.frombuffer(blob, "<i8", 1, 1)[0])
            parts.append((np.frombuffer(blob, np.uint8, n * WINDOW, 9).reshape(n, WINDOW), np.frombuffer(blob, "<i8", n, 9 + n * WINDOW), np.frombuffer(blob, "<i4", n, 9 + n * (WINDOW + 8)).astype(np.int64)))
    if stretches:
        for windows in windows_of(stretches):
            yield from cuts_of(*windows)
    if parts:
        yield from cuts_of(*(np.concatenate(x) for x in zip(*parts)))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which packs better than a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/suffix-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """``rid, doc_id, text``, where ``rid`` is unique and orders documents: the doc_id, if that is; and all texts' bytes.

    With repeated or null doc_ids it numbers the distinct rows sorted by doc_id (null first) and
    text, written to the shared folder once so that it stays the same.
    """
    own = columns(docs, doc_id="long", text="string")
    size, total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).collect()[0]
    if total == own.where("doc_id is not null").select("doc_id").distinct().count():
        return own.select(F.col("doc_id").alias("rid"), "doc_id", "text"), size
    return stored(own.orderBy(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "numbered"), size


def taking_part(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents that spans name, and by chance some others; and the rest. ``MARKS`` rows are broadcast at most."""
    mark = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS)).cast("int")
    marks = F.broadcast(spans.select(mark("doc").alias("mark")).distinct())
    marked = docs.withColumn("mark", mark("rid"))
    return marked.join(marks, "mark", "left_semi").drop("mark"), marked.join(marks, "mark", "left_anti").drop("mark")


def bucket_number(size: int, least: int) -> int:
    """Buckets for so many bytes: ``BUCKET_BYTES`` each on average, and no fewer than ``least``."""
    return max(least, -(-size // BUCKET_BYTES))


def removable(docs: DataFrame, size: int) -> DataFrame:
    """``doc, a, e``: spans of UTF-8 bytes that go, of documents with a unique ``rid`` and ``size`` bytes in all; they may overlap."""
    spark = docs.sparkSession
    buckets = bucket_number(size, partitions(spark))
    sifted = docs.select("rid", "text").mapInArrow(sift(buckets), SENT)
    found = stored(sifted.repartitionById(buckets, F.col("bucket")).mapInArrow(settle, FOUND), "found")
    cuts = found.where(F.col("kind") == CUT).select("doc", "a", "e")
    fine = found.where(F.col("kind").isin(FINE, CROWDED))
    # Stretches are sent as they are, crowded ones as windows.
    wide = F.when(F.col("kind") == FINE, F.col("e") - F.col("a")).otherwise((F.col("e") - F.col("a") - (WINDOW - 1)).cast("long") * WINDOW)
    buckets = bucket_number(fine.agg(F.coalesce(F.sum(wide), F.lit(0))).collect()[0][0], partitions(spark))
    leads = found.where(F.col("kind") == LEADS).select("lead").orderBy(F.xxhash64("lead")).limit(max(SAMPLE, PER_BUCKET * buckets))
    sample = sorted(bytes(x) for (x,) in leads.collect())
    splitters = np.array([sample[len(sample) * i // buckets] for i in range(1, buckets)] if sample else [], f"S{LEAD}")
    listed = fine.groupBy("doc").agg(F.collect_list(F.struct("kind", "a", "e", "off")).alias("spans"))  # of one document each
    own, _ = taking_part(docs, fine)
    with_spans = own.join(listed.hint("shuffle_hash"), own["rid"] == listed["doc"]).select("rid", "text", "spans")
    windows = with_spans.mapInArrow(spread(splitters, buckets), SENT)
    edges = stored(windows.repartitionById(buckets, F.col("bucket")).mapInArrow(compare, FOUND), "edges")
    return cuts.unionByName(edges.select("doc", "a", "e"))


def kept(raw: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """What is left of a text without the spans, and the number of maximal runs removed."""
    if not spans:
        return raw, 0
    _, a, e = merged(np.zeros(len(spans), np.int64), np.array([x["a"] for x in spans]), np.array([x["e"] for x in spans]))
    pieces, at = [], 0
    for lo, hi in zip(a.tolist(), e.tolist()):
        pieces.append(raw[at:lo])
        at = hi
    return b"".join([*pieces, raw[at:]]), len(a)


def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch, "text"):
            made = [kept(raw, spans) for raw, spans in zip(texts, part.column(2).to_pylist())]
            sizes = np.array([len(t) for t in texts])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column(0),
                    "n_bytes": sizes,
                    "n_removed": sizes - np.array([len(k) for k, _ in made]),
                    "n_spans": [n for _, n in made],
                    "kept_sha256": [hashlib.sha256(k).hexdigest() for k, _ in made],
                    "kept": [k for k, _ in made],
                },
                schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]),
            )


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and the ``kept`` bytes.

    Null texts have no bytes. Texts under ``WINDOW`` bytes lose nothing. Repeated doc_ids are
    different documents in the order of their texts, null ones come first; a repeated row's text
    starts earlier in its first row and goes from the others. Cutting is by bytes, so ``kept`` may
    hold parts of a character.
    """
    rows_, size = numbered(docs)
    spans = removable(rows_, size)
    listed = spans.groupBy("doc").agg(F.collect_list(F.struct("a", "e")).alias("spans"))  # of one document each
    own, rest = taking_part(rows_, spans)
    own = own.join(listed.hint("shuffle_hash"), own["rid"] == listed["doc"], "left").select("doc_id", "text", "spans")
    rest = rest.select("doc_id", "text", F.lit(None).cast("array<struct<a: int, e: int>>").alias("spans"))
    return own.unionByName(rest).mapInArrow(report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def summary(docs: DataFrame) -> DataFrame:
    """``without_repeats`` without the bytes."""
    return without_repeats(docs).drop("kept")
