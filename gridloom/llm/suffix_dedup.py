"""Repeated passages by a common-prefix-aware distributed merge sort of suffixes.

Any ``SPAN``-byte string (a window) owns one anchor: the leftmost least hash of its ``GRAM``-byte grams. Equal windows own
equal anchors at equal places, so windows need to be compared only below a common anchor, and only anchors whose gram
occurs in two different texts matter.

Distinct texts are dealt into blocks of some ``BLOCK_BYTES``. A block sends its anchors' gram hashes, sorted and packed, to
buckets; a bucket answers every block with those that another text holds too. A block then cuts the suffix at each of them:
gram hash, the bytes to the right as far as the anchor's windows reach, the bytes to the left from right to left, and the
doc_id, so that equal surroundings stand together with their least doc_id first. Sorted suffixes make a run, which
is cut into ranges; a range of a run travels front-coded, every suffix without the prefix it shares with the one before.
Each range's runs are combined by a loser tree that knows, for all contestants, how much they share with the last winner, and
never compares those bytes again.

No group is held or paired. Of equal surroundings only the first is kept, in the run as in the merge, and the others are
decided at once, as they come in doc_id order. Different surroundings of one gram meet in a list; a gram in more than ``CROWD`` texts
may have any number of them, so each of its windows is a suffix of its own, which has no other surrounding.
Copies of a whole text are one text: all but the least doc_id go.

Defined results: a null text is empty; texts shorter than ``SPAN`` lose nothing; rows with a null doc_id neither lose
anything nor take anything from others; rows of an equal doc_id don't take from each other; every input row gives one
output row, also repeated ones; a text of any length is one row of one block; an empty table gives an empty result; extra columns are ignored.
doc_id is a whole number of 64 bits at most.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPAN = 50
GRAM = 16
CROWD = 20_000  # texts that hold a gram; beyond, its windows are sorted one by one
BLOCK_BYTES = 8 << 20
BUCKET_ROWS = 2_000_000
RUN_ROWS = 200_000
RANGE_ROWS = 100_000
_REACH = SPAN - GRAM + 1  # grams in a window
_BEFORE = SPAN - GRAM  # bytes of a window before its anchor, at most
_P = 0xD6E8FEB86659FD93
_Q = 0x9E3779B97F4A7C15
_CHUNK = 60_000
# A suffix as bytes of one width: gram hash, right side and its length, left side reversed and its length, doc_id.
_RIGHT, _LEFT = 8, 8 + SPAN + 1
_DOC = _LEFT + _BEFORE + 1
WIDTH = _DOC + 8
_HEAD = "<qqq"


def grams(x: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of all ``GRAM``-byte strings of a byte array."""
    h, n = x.astype(np.uint64) + np.uint64(1), 1
    while n < GRAM:
        h = h[:-n] * np.uint64(pow(_P, n, 1 << 64)) + h[n:]
        n *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(_Q)
    return h ^ (h >> np.uint64(29))


def anchors(data: bytes, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, gram hash, first and last start of the windows that own it) of each anchor of texts that lie one behind
    the other; ``sizes`` are their lengths. No window crosses from one text to the next."""
    ends = np.cumsum([len(data)] if sizes is None else sizes)
    whole = np.ones(max(len(data) - SPAN + 1, 0), bool)
    for s, e in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
        whole[max(s, e - SPAN + 1) : e] = False  # windows that would reach beyond the text
    x = np.frombuffer(data, np.uint8)
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(whole), _CHUNK):  # the place within a chunk fits the low 16 bits
        starts = np.flatnonzero(whole[at : at + _CHUNK])
        if not len(starts):
            continue
        h = grams(x[at : at + _CHUNK + SPAN - 1])
        m = (h & np.uint64(0xFFFFFFFFFFFF0000)) | np.arange(len(h), dtype=np.uint64)
        n = 1
        while 2 * n <= _REACH:
            m = np.minimum(m[:-n], m[n:])
            n *= 2
        if n < _REACH:
            m = np.minimum(m[: len(m) - (_REACH - n)], m[_REACH - n :])
        own = (m[starts] & np.uint64(0xFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        found.append((own[new] + at, h[own[new]], starts[new] + at, starts[np.concatenate([new[1:], [len(own)]]) - 1] + at))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none
    pos, h, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
    new = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))  # an anchor may have windows in two chunks
    return pos[new], h[new], first[new], last[np.concatenate([new[1:], [len(pos)]]) - 1]


def _joined(texts) -> tuple[bytes, np.ndarray]:
    """Texts as UTF-8, one behind the other, and their lengths."""
    parts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in texts]
    return b"".join(parts), np.array([len(p) for p in parts], np.int64)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``block``: texts that lie together, some ``BLOCK_BYTES`` of them. The last column is the text's length."""
    from pyspark import TaskContext

    base, at = TaskContext.get().partitionId() << 40, 0
    for b in batches:
        ends = at + np.cumsum(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64))
        at = int(ends[-1]) if len(ends) else at
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base | ends // BLOCK_BYTES)], [*b.schema.names, "block"])


def _keys(h: np.ndarray) -> np.ndarray:
    """Gram hashes spread over all 64 bits: anchors are least hashes, so theirs are low."""
    k = h * np.uint64(_P)
    return k ^ (k >> np.uint64(32))


def _ask(buckets: int):
    """(block, text) to (bucket, block, keys, counts): sorted keys of a block's anchors and in how many texts they are."""

    def of(block: int, texts: list) -> pa.RecordBatch:
        data, sizes = _joined(texts)
        pos, h, _, _ = anchors(data, sizes)
        text = np.searchsorted(np.cumsum(sizes), pos, "right")
        k = _keys(h)
        order = np.argsort(k, kind="stable")
        k, text = k[order], text[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
        other = new | np.concatenate([[True], text[1:] != text[:-1]])[: len(k)]
        first = np.flatnonzero(new)
        k, n = k[first], (np.add.reduceat(other, first) if len(first) else first).astype(np.uint32)
        bucket = ((k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        edges = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [len(k)]])
        cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[edges[:-1]], pa.int64()), pa.array([block] * len(cuts), pa.int64()), pa.array([k[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([n[a:b].tobytes() for a, b in cuts], pa.binary())],
            ["bucket", "block", "keys", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for block, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if block != now and held:
                    yield of(now, held)
                    held = []
                now = block
                held.append(t)
        if held:
            yield of(now, held)

    return run


def _answer(crowd: int):
    """(bucket, block, keys, counts), sorted by bucket, to (block, keys, crowded): those that two texts hold at least."""

    def of(held: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        keys = np.frombuffer(b"".join(k for _, k, _ in held), np.uint64)
        _, which = np.unique(keys, return_inverse=True)
        total = np.bincount(which, np.frombuffer(b"".join(n for _, _, n in held), np.uint32))[which]
        blocks, some, often, at = [], [], [], 0
        for block, k, _ in held:
            mine = slice(at, at + len(k) // 8)
            at = mine.stop
            shared = total[mine] > 1
            if shared.any():
                blocks.append(block)
                some.append(keys[mine][shared].tobytes())
                often.append((total[mine][shared] > crowd).astype(np.uint8).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(some, pa.binary()), pa.array(often, pa.binary())], ["block", "keys", "crowded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for bucket, *row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != now and held:
                    yield of(held)
                    held = []
                now = bucket
                held.append(tuple(row))
        if held:
            yield of(held)

    return run


def _mixed(part: np.ndarray) -> np.ndarray:
    """64-bit hashes of equally long rows of bytes."""
    wide = np.zeros((len(part), -(-part.shape[1] // 8) * 8), np.uint8)
    wide[:, : part.shape[1]] = part
    h = np.full(len(part), _Q, np.uint64)
    for col in wide.view("<u8").T:
        h = (h ^ col) * np.uint64(_P)
        h ^= h >> np.uint64(32)
    return h


def suffixes(padded: np.ndarray, pos: np.ndarray, right: np.ndarray, left: np.ndarray, doc: np.ndarray, gram: int) -> np.ndarray:
    """Rows of ``WIDTH`` bytes for suffixes at ``pos`` with so many bytes to the right and left. ``padded`` holds the texts
    behind ``_BEFORE`` bytes and before ``SPAN``; ``gram``: how many bytes to the right the leading hash covers."""
    out = np.zeros((len(pos), WIDTH), np.uint8)
    after = np.lib.stride_tricks.sliding_window_view(padded, SPAN)[pos + _BEFORE]
    after[np.arange(SPAN) >= right[:, None]] = 0
    before = np.lib.stride_tricks.sliding_window_view(padded, _BEFORE)[pos][:, ::-1]
    before[np.arange(_BEFORE) >= left[:, None]] = 0
    out[:, _RIGHT : _RIGHT + SPAN], out[:, _RIGHT + SPAN] = after, right
    out[:, _LEFT : _LEFT + _BEFORE], out[:, _LEFT + _BEFORE] = before, left
    out[:, :_RIGHT] = _mixed(after[:, :gram]).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, _DOC:] = (doc.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out


def front_code(keys: np.ndarray, shared: np.ndarray, g: np.ndarray, pos: np.ndarray, block: int) -> bytes:
    """Sorted suffixes as bytes: texts, positions, shared prefix lengths and remainders, compressed. The first shares nothing."""
    shared = np.concatenate([[0], shared[1:]]).astype(np.uint8)
    used, index = np.unique(g, return_inverse=True)
    rest = keys[np.arange(WIDTH) >= shared[:, None]]
    parts = (struct.pack(_HEAD, len(keys), len(used), block), used.astype("<i8"), index.astype("<u4"), pos.astype("<i8"), shared, rest)
    plain = b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)
    return struct.pack("<q", len(plain)) + pa.compress(plain, codec="zstd", asbytes=True)


def read_run(blob: bytes) -> Iterator[tuple[int, bytes, tuple[int, int, int]]]:
    """(bytes shared with the entry before, key, (block, g, position)) of a front-coded run, in order."""
    blob = pa.decompress(blob[8:], decompressed_size=struct.unpack_from("<q", blob)[0], codec="zstd", asbytes=True)
    n, used, block = struct.unpack_from(_HEAD, blob)
    at = struct.calcsize(_HEAD)
    table = np.frombuffer(blob, "<i8", used, at)
    g = table[np.frombuffer(blob, "<u4", n, at + 8 * used)].tolist()
    pos = np.frombuffer(blob, "<i8", n, at + 8 * used + 4 * n).tolist()
    at += 8 * used + 12 * n
    shared = blob[at : at + n]
    at += n
    key = b""
    for i in range(n):
        same = shared[i]
        end = at + WIDTH - same
        key = key[:same] + blob[at:end]
        at = end
        yield same, key, (block, g[i], pos[i])


def _shared_from(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, given that ``known`` bytes are common."""
    x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return len(a) - (x.bit_length() + 7) // 8


def merge(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """Runs of keys of one length combined by a loser tree: (bytes shared with the last one put out, key, payload) in order.

    Every contestant carries what it shares with the last winner. Of two, the one that shares more is less; only if both
    share the same are bytes compared, from there on. A winner's successor knows its share from its run's front coding. An
    ended run shares -1 bytes.
    """
    k = 1
    while k < len(runs):
        k *= 2
    ended = (-1, b"", ())
    heads: list = [next(r, ended) for r in runs] + [ended] * (k - len(runs))
    known = [0 if h is not ended else -1 for h in heads]
    keys = [h[1] for h in heads]
    tree = [-1] * k  # losers at inner nodes

    def build(node: int) -> int:
        return node - k if node >= k else play(node, build(2 * node), build(2 * node + 1))

    def play(node: int, i: int, j: int) -> int:
        """The winner of two contestants; the loser stays at the node."""
        if known[i] == known[j] >= 0:
            same = _shared_from(keys[i], keys[j], known[i])
            if same < len(keys[i]) and keys[i][same] > keys[j][same]:
                i, j = j, i
            known[j] = same
        elif known[i] < known[j]:
            i, j = j, i
        tree[node] = j
        return i

    if not runs:
        return
    winner = build(1) if k > 1 else 0
    while known[winner] >= 0:
        yield known[winner], keys[winner], heads[winner][2]
        heads[winner] = following = next(runs[winner], ended)
        known[winner], keys[winner] = following[0], following[1]
        node = (winner + k) // 2
        while node:
            other = tree[node]
            if known[other] >= known[winner]:  # else the winner stays, and the loser where it is
                winner = play(node, winner, other)
            node //= 2


def _sides(key: bytes) -> tuple[int, int]:
    """Lengths of the right and the left side."""
    return key[_LEFT - 1], key[_DOC - 1]


def repeated_in(kinds: list[tuple[bytes, list[tuple[int, int, int]]]]) -> Iterator[tuple[tuple[int, int, int], int, int]]:
    """((block, g, position), start, end) of windows that a smaller doc_id holds too, among different surroundings of one
    gram, each with the members of its least doc_id."""
    if len(kinds) == 2:  # windows of both are those that neither side's first difference touches
        (a, who_a), (b, who_b) = kinds
        (ra, la), (rb, lb) = _sides(a), _sides(b)
        right = min(_shared_from(a[_RIGHT : _RIGHT + SPAN], b[_RIGHT : _RIGHT + SPAN], GRAM if a[_RIGHT : _RIGHT + GRAM] == b[_RIGHT : _RIGHT + GRAM] else 0), ra, rb)
        left = min(_shared_from(a[_LEFT : _DOC - 1], b[_LEFT : _DOC - 1], 0), la, lb)
        if SPAN - right <= left and a[_DOC:] != b[_DOC:]:
            for block, g, at in who_b if a[_DOC:] < b[_DOC:] else who_a:
                yield (block, g, at), at - left, at + right
        return
    least: dict[bytes, bytes] = {}
    lists = []
    for key, who in kinds:
        right, left = _sides(key)
        line, m = key[_LEFT : _LEFT + left][::-1] + key[_RIGHT : _RIGHT + right], key[_DOC:]
        windows = [line[s : s + SPAN] for s in range(len(line) - SPAN + 1)]  # from left to right
        for w in windows:
            if least.get(w, m) >= m:
                least[w] = m
        lists.append((windows, m, left, who))
    for windows, m, left, who in lists:
        spans: list[list[int]] = []
        for s, w in enumerate(windows):
            if least[w] < m:
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + SPAN
                else:
                    spans.append([s, s + SPAN])
        for block, g, at in who:
            for s, e in spans:
                yield (block, g, at), at - left + s, at - left + e


def _runs(ranges: int, run_rows: int):
    """One block's texts and shared keys to rows (range, run, block, spans): front-coded runs, and spans decided at once."""

    def of(key, texts: pa.Table, marks: pa.Table) -> pa.Table:
        block = key[0].as_py()
        out: list[list] = [[], [], [], []]
        if texts.num_rows and marks.num_rows:
            keys = np.frombuffer(b"".join(marks.column("keys").to_pylist()), np.uint64)
            crowded = np.frombuffer(b"".join(marks.column("crowded").to_pylist()), np.uint8).astype(bool)
            order = np.argsort(keys)
            keys, crowded = keys[order], crowded[order]
            data, sizes = _joined(texts.column("text"))
            pos, h, first, last = anchors(data, sizes)
            k = _keys(h)
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            hit = keys[at] == k
            pos, first, last, dense = pos[hit], first[hit], last[hit], crowded[at[hit]]
            ends = np.cumsum(sizes)
            g, doc = (texts.column(c).to_numpy().astype(np.int64) for c in ("g", "m"))
            padded = np.zeros(len(data) + _BEFORE + SPAN, np.uint8)
            padded[_BEFORE : _BEFORE + len(data)] = np.frombuffer(data, np.uint8)
            none = np.zeros(0, np.int64)
            each = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[dense].tolist(), last[dense].tolist(), strict=True)] or [none])
            sparse = ~dense
            jobs = [(pos[sparse], (last + SPAN - pos)[sparse], (pos - first)[sparse], GRAM), (each, np.full(len(each), SPAN), np.zeros(len(each), np.int64), SPAN)]
            for p, right, left, gram in jobs:
                for a in range(0, len(p), run_rows):
                    cut = slice(a, a + run_rows)
                    text = np.searchsorted(ends, p[cut], "right")
                    rows = suffixes(padded, p[cut], right[cut], left[cut], doc[text], gram)
                    _run(rows, g[text], p[cut] - (ends - sizes)[text], right[cut], left[cut], block, out)
        kinds = (pa.int32(), pa.binary(), pa.int64(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["range", "run", "block", "spans"])

    def _run(rows: np.ndarray, g: np.ndarray, pos: np.ndarray, right: np.ndarray, left: np.ndarray, block: int, out: list[list]) -> None:
        order = np.argsort(rows.view(f"S{WIDTH}").ravel(), kind="stable")
        rows, g, pos = rows[order], g[order], pos[order]
        differ = rows[1:] != rows[:-1]
        shared = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)])
        head = np.maximum.accumulate(np.where(shared < _DOC, np.arange(len(rows)), 0))  # the first of the same surrounding
        late = (rows[:, _DOC:] != rows[head, _DOC:]).any(axis=1)
        if late.any():
            s, e = (pos - left[order])[late], (pos + right[order])[late]
            for i, x in enumerate((block % ranges, None, block, np.concatenate([g[late], s, e]).astype("<i8").tobytes())):
                out[i].append(x)
        rows, g, pos, shared = rows[~late], g[~late], pos[~late], shared[~late]
        place = rows[:, :4].copy().view(">u4").ravel().astype(np.int64) * ranges >> 32
        edges = [*np.flatnonzero(np.diff(place, prepend=-1)).tolist(), len(rows)]
        for a, b in zip(edges, edges[1:], strict=False):
            for i, x in enumerate((int(place[a]), front_code(rows[a:b], shared[a:b], g[a:b], pos[a:b], block), block, None)):
                out[i].append(x)

    return of


def _merge_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(range, run, block, spans), sorted by range, to (block, spans): one range's runs are merged as a stream."""

    def out(found: dict[int, list[tuple[int, int, int]]]) -> pa.RecordBatch:
        blobs = [np.array(x, "<i8").T.tobytes() for x in found.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(blobs, pa.binary())], ["block", "spans"])

    def whole(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        kinds: list[tuple[bytes, list[tuple[int, int, int]]]] = []
        found: dict[int, list[tuple[int, int, int]]] = {}
        n = 0

        def lost(block: int, g: int, s: int, e: int) -> None:
            found.setdefault(block, []).append((g, s, e))

        for same, key, who in merge([read_run(b) for b in blobs]):
            if same >= _DOC:  # the surrounding of the one before; its first has the least doc_id
                if key[_DOC:] == kinds[-1][0][_DOC:]:
                    kinds[-1][1].append(who)
                else:
                    right, left = _sides(key)
                    lost(*who[:2], who[2] - left, who[2] + right)
                    n += 1
                continue
            if same < _RIGHT + GRAM:
                if len(kinds) > 1:
                    for (block, g, _), s, e in repeated_in(kinds):
                        lost(block, g, s, e)
                        n += 1
                kinds = []
                if n > 200_000:
                    yield out(found)
                    found, n = {}, 0
            kinds.append((key, [who]))
        if len(kinds) > 1:
            for (block, g, _), s, e in repeated_in(kinds):
                lost(block, g, s, e)
        if found:
            yield out(found)

    now, held = None, []
    for b in batches:
        for r, blob, block, spans in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if r != now and held:
                yield from whole(held)
                held = []
            now = r
            if blob is None:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([spans], pa.binary())], ["block", "spans"])
            else:
                held.append(blob)
    if held:
        yield from whole(held)


def _cut(key, texts: pa.Table, found: pa.Table) -> pa.Table:
    """One block's texts without their repeated spans: (g, m, n_removed, n_spans, kept_sha256), the last null without spans."""
    parts = [np.frombuffer(x, "<i8").reshape(3, -1) for x in found.column("spans").to_pylist()]
    ids, s, e = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
    g = texts.column("g").to_numpy().astype(np.int64)
    order = np.argsort(g)
    row = order[np.searchsorted(g[order], ids)] if len(ids) else np.zeros(0, np.int64)
    sort = np.lexsort((s, row))
    row, s, e = row[sort], s[sort], e[sort]
    edges = np.searchsorted(row, np.arange(len(g) + 1)).tolist()
    removed, n_spans, kept = [], [], []
    for i, t in enumerate(texts.column("text")):
        a, b = edges[i], edges[i + 1]
        if a == b:
            removed.append(0)
            n_spans.append(0)
            kept.append(None)
            continue
        data = (t.as_py() or "").encode("utf-8", "surrogatepass")
        reach = np.maximum.accumulate(e[a:b])
        new = np.flatnonzero(np.concatenate([[True], s[a + 1 : b] > reach[:-1]]))
        begin, end = s[a:b][new], reach[np.concatenate([new[1:], [b - a]]) - 1]
        digest, at = hashlib.sha256(), 0
        for x, y in zip(begin.tolist(), end.tolist(), strict=True):
            digest.update(data[at:x])
            at = y
        digest.update(data[at:])
        removed.append(int((end - begin).sum()))
        n_spans.append(len(new))
        kept.append(digest.hexdigest())
    return pa.Table.from_arrays(
        [texts.column("g"), texts.column("m"), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string())],
        ["g", "m", "n_removed", "n_spans", "kept_sha256"],
    )


def _texts(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, g, other, text): two independent 64-bit hashes of the text."""
    text = common.text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(seed), text).alias("g"), F.xxhash64(F.lit(~seed), text).alias("other"), text.alias("text"))


def distinct_texts(docs: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """((g, m, n, text, block) of every distinct text with its least doc_id, seed): texts are shipped once for this."""
    for seed in range(8):
        once = _texts(docs, seed).groupBy("g").agg(F.min("doc_id").alias("m"), F.min("other").alias("a"), F.max("other").alias("b"), F.first("text").alias("text"))
        once = once.select("g", "m", "a", "b", "text", F.octet_length("text").cast("long").alias("n"))
        once = common.table(once.mapInArrow(_numbered, "g long, m long, a long, b long, text string, n long, block long"), f"{folder}/texts-{seed}")
        if once.where("a <> b").isEmpty():  # no two texts share g; else another seed
            return once.drop("a", "b"), seed
    raise RuntimeError("text hashes collide")


def repeats(once: DataFrame, folder: str, crowd: int = CROWD, run_rows: int = RUN_ROWS) -> DataFrame:
    """(block, spans): packed (g, start, end) of repeated spans of distinct texts, as a table."""
    source = once.where((F.col("n") >= SPAN) & F.col("m").isNotNull())
    spark = once.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = source.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n  # one number
    buckets = max(least, total * 2 // (_REACH * BUCKET_ROWS))
    asked = source.select("block", "text").mapInArrow(_ask(buckets), "bucket long, block long, keys binary, counts binary")
    dealt = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    marks = common.table(dealt.mapInArrow(_answer(crowd), "block long, keys binary, crowded binary"), f"{folder}/shared")
    n = marks.agg(F.coalesce(F.sum(F.octet_length("crowded")), F.lit(0)).alias("n")).first().n  # one number
    ranges = max(least, -(-n // RANGE_ROWS))
    both = source.select("block", "g", "m", "text").groupBy("block").cogroup(marks.groupBy("block"))
    runs = both.applyInArrow(_runs(ranges, run_rows), "range int, run binary, block long, spans binary")
    merged = runs.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(_merge_ranges, "block long, spans binary")
    return common.table(merged, f"{folder}/spans")


def remove_repeats(docs: DataFrame, folder: str, crowd: int = CROWD, run_rows: int = RUN_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    once, seed = distinct_texts(docs, folder)
    found = repeats(once, folder, crowd, run_rows)
    both = once.select("block", "g", "m", "text").groupBy("block").cogroup(found.groupBy("block"))
    cut = common.table(both.applyInArrow(_cut, "g long, m long, n_removed long, n_spans long, kept_sha256 string"), f"{folder}/judged")
    rows = _texts(docs, seed).select("doc_id", F.col("g").alias("_g"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("full"))
    out = rows.join(cut, F.col("_g") == F.col("g"))
    copy = (F.col("doc_id") > F.col("m")) & (F.col("n_bytes") >= SPAN)
    own = F.col("doc_id").eqNullSafe(F.col("m")) & F.col("doc_id").isNotNull() & F.col("kept_sha256").isNotNull()
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).when(own, F.col("n_removed")).otherwise(zero).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).when(own, F.col("n_spans")).otherwise(zero).alias("n_spans"),
        F.when(copy, common.EMPTY_SHA256).when(own, F.col("kept_sha256")).otherwise(F.col("full")).alias("kept_sha256"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, p, substring(x, 2 * p + 1, 100) AS w FROM d, unnest(range(n - 49)) AS t(p)),
f AS (SELECT w, min(doc_id) AS least FROM w GROUP BY w),
h AS (SELECT doc_id, p, CASE WHEN p - 50 <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) THEN 0 ELSE 1 END AS fresh FROM w JOIN f USING (w) WHERE doc_id > least),
r AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM h),
s AS (SELECT doc_id, min(p) AS s, max(p) + 50 AS e FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b FROM (SELECT * FROM s UNION ALL SELECT doc_id, n, n FROM d)),
t AS (SELECT doc_id, string_agg(substring(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
"""
