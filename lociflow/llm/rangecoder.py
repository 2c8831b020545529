"""Adaptive context-mixing range coder for token ids, many blocks in lock step.

Each id is coded in one step of a 48-bit range coder with 16-bit digits. The interval of 2**22 is mixed
from five predictions: the ids that followed the last two occurrences of the previous two ids (order 2),
those that followed the last two of the previous id (order 1), and the chunk's own frequencies (order 0).
The shares are counts of how often each was the first to be right, kept for every state of the others:
how many followers are known, whether they agree, whether the orders agree. Contexts and shares start
anew in each block and adapt inside it, so blocks decode on their own, and one numpy operation serves
one step of all blocks of a chunk.

A chunk is: ``MAGIC``, version, ids of a block, number of blocks, bytes of the packed alphabet; the
alphabet (ids, then frequencies of ``_TOTAL0``, deflated); for each block its ids, digits and the crc32 of
its ids as little-endian unsigned 32-bit integers; then all digits as little-endian 16 bits. Ids beyond
the ``MAX_ALPHABET`` most frequent of a chunk are spelt in ``_RAW_BITS`` bits behind an escape.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"LFID", 3
BLOCK_IDS = 4096
#: Ids must be below this.
MAX_ID = (1 << 19) - 1
MAX_ALPHABET = 32_000
_RAW_BITS = np.uint64(19)
_TOTAL0, _BITS0 = 1 << 16, 16
#: All shares are parts of 2**16, and order 0 has ``_LEAST0`` at least; the coder's interval is finer by
#: ``_FINE`` bits, so that each of order 0's frequencies has room in any share.
_LEAST0, _FINE = 2048, 6
_BITS = np.uint64(16 + _FINE)
_TABLE = 13
_STATES, _SLOTS = 32, 5
#: Numbers kept for a state: its bounds and room up to a length that numpy copies at once.
_WIDE = 8
#: Steps that the encoder prepares together: their numbers should stay in a core's cache.
_RUN = 16
_U = np.uint64
_LOW16, _HALF = np.uint32(0xFFFF), np.uint32(16)
_LOW32, _SHORT, _FULL = _U(0xFFFFFFFF), _U(1 << 32), _U(1 << 16 + _FINE)


def _frequencies(counts: np.ndarray) -> np.ndarray:
    """Parts of ``_TOTAL0``, each at least 1, for counts of at least 1."""
    freq = counts * (_TOTAL0 - len(counts)) // counts.sum() + 1
    freq[np.argmax(freq)] += _TOTAL0 - freq.sum()
    return freq


def _windows(steps: int) -> list[tuple[int, int]]:
    """Runs of steps between which the shares are set anew."""
    cuts = [0, *(t for t in (8, 16, 32, 64) if t < steps), *range(128, steps, 128), steps]
    return list(zip(cuts, cuts[1:], strict=False))


class _Model:
    """State of the blocks, one lane each; the encoder and the decoder drive it alike.

    Symbols are places in the alphabet; 0 is none in a table, and the escape where something is coded. Of
    the tables' two rows the first is order 2, the second order 1; an entry is the last follower of its
    context and, 16 bits higher, the one before.
    """

    def __init__(self, lanes: int, freq: np.ndarray):
        self.edges = np.concatenate([[0], np.cumsum(freq)]).astype(np.uint32)
        symbols = np.arange(len(freq), dtype=np.int64)
        self.hash1 = symbols * 2654435761 >> 7 & (1 << _TABLE) - 1
        self.hash2 = symbols * 2246822519 >> 11 & (1 << _TABLE) - 1
        self.low = symbols & (1 << _TABLE) - 1
        rows = np.arange(lanes)
        self.base = np.stack([rows, lanes + rows]) << _TABLE
        self.mix = rows * _STATES
        self.table = np.zeros(2 * lanes << _TABLE, np.uint32)
        self.counts = np.ones((_SLOTS, lanes * _STATES), np.int32)
        self.bounds = np.zeros((lanes * _STATES, _WIDE), np.uint32)
        self.bounds[:, _SLOTS:] = 1 << 16 + _FINE
        self.flat = self.bounds.reshape(-1)
        self._share()

    def _share(self) -> None:
        """The bounds between the predictions' shares, for each lane and state."""
        total = self.counts.sum(axis=0, dtype=np.int64)
        old = np.flatnonzero(total > 600)
        halves = (self.counts[:, old] + 1) >> 1
        self.counts[:, old] = halves
        total[old] = halves.sum(axis=0)
        scale = (np.float32(_TOTAL0 - _LEAST0 - _SLOTS) / total).astype(np.float32)
        bound = np.zeros(len(total), np.uint32)
        for i in range(_SLOTS - 1):
            part = (self.counts[i] * scale).astype(np.uint32) + np.uint32(1)
            bound += part << np.uint32(_FINE)
            self.bounds[:, i + 1] = bound

    def learn(self, rows: np.ndarray, slots: np.ndarray) -> None:
        """Take in which prediction was right, at which lanes' states, since the last time."""
        at = slots.reshape(-1) * np.int64(self.counts.shape[1])
        at += rows.reshape(-1)
        self.counts += np.bincount(at, minlength=self.counts.size).reshape(self.counts.shape)
        self._share()

    def order0(self, symbols: np.ndarray, edge: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of symbols that order 0 codes, whose share begins at ``edge`` and has 2**_FINE times ``rest``."""
        shift = _U(_BITS0 - _FINE)
        return edge + (self.edges.take(symbols) * rest >> shift), edge + (self.edges.take(symbols + 1) * rest >> shift)


def _rest(edge: np.ndarray) -> np.ndarray:
    return (_FULL - edge) >> _U(_FINE)


def _state(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The state that an order's followers are in, for each order: known ones, and whether they agree."""
    is_known = last != 0
    return is_known.view(np.uint8) + (before != 0).view(np.uint8) + ((last == before) & is_known).view(np.uint8)


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """A chunk holding ``ids`` (may be empty) in blocks of ``block_ids``."""
    ids = np.ascontiguousarray(ids, np.uint32)
    if len(ids) and int(ids.max()) >= MAX_ID:
        raise ValueError(f"ids must be below {MAX_ID}")
    blocks = [ids[at : at + block_ids] for at in range(0, len(ids), block_ids)]
    n = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(n)
    if len(used) > MAX_ALPHABET:
        used = np.sort(np.argsort(-n, kind="stable")[:MAX_ALPHABET])
    escapes = len(ids) - int(n[used].sum())
    freq = _frequencies(np.concatenate([[max(escapes, 1)], n[used]])) if blocks else np.zeros(0, np.int64)
    alphabet = zlib.compress(np.diff(used, prepend=0).astype("<u4").tobytes() + np.minimum(freq, 0xFFFF).astype("<u2").tobytes(), 6)
    head = [MAGIC, struct.pack("<IIII", VERSION, block_ids, len(blocks), len(alphabet)), alphabet]
    digits = []
    if blocks:
        place = np.zeros(len(n), np.int64)
        place[used] = np.arange(1, len(used) + 1)
        digits = _encode_lanes(blocks, place, freq)
    head += [struct.pack("<III", len(b), len(d), zlib.crc32(b.astype("<u4").tobytes())) for b, d in zip(blocks, digits, strict=True)]
    return b"".join(head + [d.astype("<u2").tobytes() for d in digits])


def _encode_lanes(blocks: list[np.ndarray], place: np.ndarray, freq: np.ndarray) -> list[np.ndarray]:
    lanes, steps, last = len(blocks), len(blocks[0]), len(blocks[-1])
    ids = np.zeros((lanes, steps), np.uint32)
    for i, b in enumerate(blocks):
        ids[i, : len(b)] = b
    ids = np.ascontiguousarray(ids.T)
    model = _Model(lanes, freq)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 48, np.uint64)
    room = 3 * steps + 4
    out = np.zeros(lanes * room, np.uint32)
    at = np.arange(lanes) * room
    ahead = np.zeros((2, lanes), np.int64)  # the two symbols before a window

    def settle() -> None:
        """Lanes whose range got short give digits out, a carry as their 17th bit."""
        k = (rng < _SHORT).nonzero()[0]
        while len(k):
            lk, ak = low.take(k), at.take(k)
            out[ak] = lk >> _U(32)
            at[k] = ak + 1
            low[k] = (lk & _LOW32) << _U(16)
            rk = rng.take(k) << _U(16)
            rng[k] = rk
            k = k[rk < _SHORT]

    for begin, stop in _windows(steps):
        all_rows, slots = np.empty((stop - begin, lanes), np.int32), np.empty((stop - begin, lanes), np.uint8)
        for begin_run in range(begin, stop, _RUN):
            stop_run = min(begin_run + _RUN, stop)
            # all but the coder's own numbers is known beforehand, as the shares stay for a window
            raw = ids[begin_run:stop_run]
            now = place.take(raw)
            past = np.concatenate([ahead, now])
            ahead = past[-2:]
            where = np.stack([model.hash1.take(past[1:-1]) ^ model.hash2.take(past[:-2]), model.low.take(past[1:-1])], axis=1) + model.base
            seen = np.empty(where.shape, np.uint32)
            new, table = now.astype(np.uint32), model.table
            for t in range(stop_run - begin_run):
                table.take(where[t], out=seen[t], mode="clip")
                table[where[t]] = (seen[t] << _HALF) | new[t]
            newer, older = seen & _LOW16, seen >> _HALF
            known = _state(newer, older)
            rows = model.mix + ((known[:, 0] << 3) + (known[:, 1] << 1) + (newer[:, 0] == newer[:, 1]).view(np.uint8))
            slot = np.full(now.shape, _SLOTS - 1, np.uint8)
            for i, follower in ((3, older[:, 1]), (2, newer[:, 1]), (1, older[:, 0]), (0, newer[:, 0])):  # the first that is right counts
                np.copyto(slot, i, where=follower == new)
            escapes = now == 0
            slot[escapes] = _SLOTS - 1
            cell = rows * _WIDE + slot
            start, end = model.flat.take(cell).astype(np.uint64), model.flat.take(cell + 1).astype(np.uint64)
            k = (slot == _SLOTS - 1).reshape(-1).nonzero()[0]
            edge = start.take(k)
            start.reshape(-1)[k], end.reshape(-1)[k] = model.order0(now.take(k), edge, _rest(edge))
            end -= start
            if stop_run > last:  # the last lane is at its end and codes nothing more
                gone = slice(max(last - begin_run, 0), None)
                start[gone, -1], end[gone, -1], escapes[gone, -1] = 0, _FULL, False
            spelt = escapes.any(axis=1)
            for t in range(stop_run - begin_run):
                r = rng >> _BITS
                low += start[t] * r
                np.multiply(end[t], r, out=rng)
                settle()
                if spelt[t]:
                    odd = np.flatnonzero(escapes[t])
                    r = rng[odd] >> _RAW_BITS
                    low[odd] += raw[t, odd].astype(np.uint64) * r
                    rng[odd] = r
                    settle()
            all_rows[begin_run - begin : stop_run - begin], slots[begin_run - begin : stop_run - begin] = rows, slot
        model.learn(all_rows, slots)
    for shift in (32, 16, 0):
        out[at] = low >> _U(shift) & _U(0x1FFFF if shift == 32 else 0xFFFF)  # the first with its carry
        at += 1
    while len(k := (out > _LOW16).nonzero()[0]):  # a lane's first digit never has a carry
        over = out[k] >> _HALF
        out[k] &= _LOW16
        out[k - 1] += over
    digits = out.reshape(lanes, -1)
    return [digits[i, : at[i] - i * room] for i in range(lanes)]


def decode(chunk: bytes) -> np.ndarray:
    """The ids of a chunk; ValueError if it isn't one or a block's checksum is wrong."""
    if chunk[:4] != MAGIC:
        raise ValueError("not a chunk of coded ids")
    version, _, n_blocks, packed = struct.unpack_from("<IIII", chunk, 4)
    if version != VERSION:
        raise ValueError(f"chunk version {version} is not known")
    if not n_blocks:
        return np.zeros(0, np.uint32)
    try:
        alphabet = zlib.decompress(chunk[20 : 20 + packed])
    except zlib.error as e:
        raise ValueError("the chunk's alphabet is damaged") from e
    size = (len(alphabet) - 2) // 6
    used = np.cumsum(np.frombuffer(alphabet, "<u4", size).astype(np.int64))
    freq = np.frombuffer(alphabet, "<u2", size + 1, 4 * size).astype(np.int64)
    freq[np.argmax(freq)] += _TOTAL0 - freq.sum()  # one of 2**16 doesn't fit its field
    heads = np.frombuffer(chunk, "<u4", 3 * n_blocks, 20 + packed).reshape(-1, 3)
    digits = np.frombuffer(chunk[20 + packed + 12 * n_blocks :], "<u2")
    ids = _decode_lanes(heads[:, 0].astype(np.int64), heads[:, 1].astype(np.int64), digits, np.concatenate([[0], used]), freq)
    for i, block in enumerate(ids):
        if zlib.crc32(block.astype("<u4").tobytes()) != int(heads[i, 2]):
            raise ValueError(f"block {i}: wrong checksum")
    return np.concatenate(ids)


def _decode_lanes(lens: np.ndarray, n_digits: np.ndarray, digits: np.ndarray, used: np.ndarray, freq: np.ndarray) -> list[np.ndarray]:
    lanes, steps = len(lens), int(lens[0])
    model = _Model(lanes, freq)
    slots0 = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)
    at = np.concatenate([[0], np.cumsum(n_digits)[:-1]])
    digits = np.concatenate([digits, np.zeros(4, digits.dtype)])
    code = np.zeros(lanes, np.uint64)
    for i in range(3):
        code = (code << _U(16)) | digits[at + i]
    at = at + 3
    rng = np.full(lanes, 1 << 48, np.uint64)
    symbols = np.zeros((steps, lanes), np.uint16)
    spelt = []
    most = _FULL - _U(1)
    lane, corner, line = np.arange(lanes), np.arange(lanes) * _WIDE, np.arange(_SLOTS) * lanes
    followers = np.zeros((_SLOTS, lanes), np.uint32)  # none for order 0
    newer, older = followers[0:4:2], followers[1:4:2]
    where = np.empty((2, lanes), np.int64)
    prev = prev2 = np.zeros(lanes, np.int64)

    def settle() -> None:
        k = (rng < _SHORT).nonzero()[0]
        while len(k):
            ak = at.take(k)
            code[k] = (code.take(k) << _U(16)) | digits.take(ak, mode="clip")
            at[k] = ak + 1
            rk = rng.take(k) << _U(16)
            rng[k] = rk
            k = k[rk < _SHORT]

    # a last, shorter lane goes on beyond its end, and what it gives there isn't used
    for begin, stop in _windows(steps):
        rows = np.empty((stop - begin, lanes), np.int64)
        slots = np.empty((stop - begin, lanes), np.uint8)
        for t in range(stop - begin):
            np.bitwise_xor(model.hash1.take(prev), model.hash2.take(prev2), out=where[0])
            model.low.take(prev, out=where[1], mode="clip")
            where += model.base
            seen = model.table.take(where)
            np.bitwise_and(seen, _LOW16, out=newer)
            np.right_shift(seen, _HALF, out=older)
            known = _state(newer, older)
            row = np.add(model.mix, (known[0] << 3) + (known[1] << 1) + (newer[0] == newer[1]).view(np.uint8), out=rows[t])
            bounds = model.bounds.take(row, axis=0)
            r = rng >> _BITS
            v = np.minimum(code // r, most).astype(np.uint32)
            slot = np.less_equal(bounds[:, 1], v, out=slots[t].view(bool)).view(np.uint8)
            for i in range(2, _SLOTS):
                slot += (bounds[:, i] <= v).view(np.uint8)
            cell = corner + slot
            start, end = bounds.take(cell).astype(np.uint64), bounds.take(cell + 1).astype(np.uint64)
            now = followers.take(line.take(slot) + lane).astype(np.int64)
            k = (slot == _SLOTS - 1).nonzero()[0]
            edge = start.take(k)
            rest = _rest(edge)
            u = np.minimum((((v.take(k) - edge + _U(1)) << _U(_BITS0 - _FINE)) - _U(1)) // rest, _U(_TOTAL0 - 1))
            symbol = slots0.take(u.astype(np.int64)).astype(np.int64)
            now[k] = symbol
            start[k], end[k] = model.order0(symbol, edge, rest)
            code -= start * r
            end -= start
            np.multiply(end, r, out=rng)
            settle()
            if not symbol.all():
                odd = k[symbol == 0]
                r = rng[odd] >> _RAW_BITS
                raw = np.minimum(code[odd] // r, _U(MAX_ID))
                code[odd] -= raw * r
                rng[odd] = r
                settle()
                spelt.append((begin + t, odd, raw))
            symbols[begin + t] = now
            model.table[where] = (seen << _HALF) | now.astype(np.uint32)
            prev2, prev = prev, now
        model.learn(rows, slots)
    ids = used.astype(np.uint32)[symbols]
    for t, odd, raw in spelt:
        ids[t, odd] = raw
    return [np.ascontiguousarray(ids[:n, i]) for i, n in enumerate(lens)]
