"""Adaptive context-mixing range coder for token ids, many blocks of a group side by side.

Before each id, two predictions are looked up: what followed the last two ids, and what followed the
last one.  One symbol says which of them holds, or else in which class of ranks the id is (order 0:
ids ranked by how often the group had them so far, classes as wide as a sixteenth of their ranks); the
place inside the class follows as plain bits.  Symbol frequencies are the sum of an order-0 table and a
table of the context (how sure both predictions are), both adapting.  Every group starts from nothing;
its blocks have digits and a checksum of their own and learn from one another.  A step codes one id of
every block of a group with array operations; all of it is integer arithmetic, so every machine decodes
the same.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"IDS2"
# Ids, documents, blocks, ids a block, largest id, bytes of the documents, checksum of the digits.
HEAD = "<QIIIIII"
BLOCKS = 4096  # in a full group
BLOCK_IDS = (512, 1024)  # least and most ids of a block of a group with several
SLOTS1, SLOTS2 = 1 << 16, 1 << 18
SCALE = 14  # bits of all symbol frequencies of a context together
CONTEXTS = 16
LEARN = 32  # steps between renewals of the frequencies, once that many have been coded
RANKED = 1 << 17  # a group with larger ids takes them for their ranks
U = np.uint64
WORD, LEAST = U(32), U(1 << 32)
LOW = U(0xFFFFFFFF)


class IdError(ValueError):
    """The data are not what was written."""


def rank_classes(most: int) -> tuple[np.ndarray, np.ndarray]:
    """First rank and plain bits of every class of ranks up to ``most``."""
    bases, bits = [np.arange(32)], [np.zeros(32, dtype=np.int64)]
    for n in range(1, max(most.bit_length() - 4, 1)):
        bases.append(np.arange(16, 32) << n)
        bits.append(np.full(16, n))
    return np.concatenate(bases), np.concatenate(bits)


class Model:
    """Predictions and frequencies of a group."""

    def __init__(self, blocks: int, most: int) -> None:
        self.bases, bits = rank_classes(most)
        self.symbols = 2 + len(bits)
        # Plain bits and first rank of every symbol.
        self.bits = np.concatenate([[0, 0], bits]).astype(U)
        self.first = np.concatenate([[0, 0], self.bases])
        self.wide = int(bits[-1]) > 12
        ranked = most < RANKED
        self.kind = np.int32 if ranked else np.int64
        # Guess and, in the two lowest bits, how sure it is; the slots of order 1, then those of order 2.
        self.after = np.full(SLOTS1 + SLOTS2, -4, dtype=self.kind)
        self.last = np.zeros(blocks, dtype=self.kind)
        self.before = np.zeros(blocks, dtype=self.kind)
        self.at = np.empty((2, blocks), dtype=np.int64)
        self.counts = np.zeros((CONTEXTS, self.symbols), dtype=np.int64)
        self.order = self.rank = None
        if ranked:
            self.order = self.rank = np.arange(most + 1, dtype=self.kind)
            self.seen = np.zeros(most + 1, dtype=np.int64)
            # Symbol of every rank.
            self.symbol = np.repeat(np.arange(self.symbols), 1 << self.bits.astype(np.int64))[2 : most + 3]
        self.renew()

    def renew(self) -> None:
        base = self.counts.sum(axis=0)
        weights = (self.counts << 12) + (base << 16) // (base.sum() + 1) + 1
        total = 1 << SCALE
        self.widths = 1 + weights * (total - self.symbols) // weights.sum(axis=1, keepdims=True)
        self.widths[np.arange(CONTEXTS), weights.argmax(axis=1)] += total - self.widths.sum(axis=1)
        ends = np.cumsum(self.widths, axis=1)
        self.flat_widths = self.widths.ravel().astype(U)
        self.flat_starts = (ends - self.widths).ravel().astype(U)

    def slots(self) -> np.ndarray:
        """Place in the flat tables of all numbers that may be met in every context."""
        return np.repeat(np.arange(self.widths.size, dtype=np.int32), self.widths.ravel())

    def segment(self, step: int, steps: int) -> int:
        """Step before which the frequencies are renewed next."""
        return min(steps, 2 * step if 0 < step < LEARN else step + (LEARN if step else 1))

    def learn_counts(self, places: np.ndarray, ids: np.ndarray, step: int) -> None:
        """Symbols (with their contexts) and ids of the steps up to ``step``."""
        self.counts -= self.counts >> 1
        self.counts += np.bincount(places.ravel(), minlength=self.counts.size).reshape(self.counts.shape)
        self.renew()
        if self.order is None:
            return
        self.seen += np.bincount(ids.ravel(), minlength=len(self.seen))
        if step & (step - 1) == 0:
            known = np.flatnonzero(self.seen)
            known = known[np.argsort(-self.seen[known], kind="stable")]
            self.order = np.concatenate([known, np.flatnonzero(self.seen == 0)]).astype(self.kind)
            self.rank = np.empty_like(self.order)
            self.rank[self.order] = np.arange(len(self.order))

    def look(self) -> np.ndarray:
        """Contexts of the next step."""
        np.bitwise_and(self.last, SLOTS1 - 1, out=self.at[0])
        mixed = self.before * self.kind(0x2C1B3C6D) + self.last * self.kind(0x297A2D39)
        np.bitwise_and(mixed >> 9, SLOTS2 - 1, out=self.at[1])
        self.at[1] += SLOTS1
        self.entry = self.after.take(self.at)
        self.guess, self.sure = self.entry >> 2, self.entry & 3
        return (self.sure[1] << 2) | self.sure[0]

    def learn(self, ids: np.ndarray) -> np.ndarray:
        """Takes up the ids of a step; says which predictions held."""
        held = self.guess == ids
        fresh = np.where(self.sure > 0, self.entry - 1, ids << 2)
        # The last block wins where several have the same context.
        self.after[self.at.reshape(-1)] = np.where(held, self.entry + (self.sure < 3), fresh).reshape(-1)
        self.before, self.last = self.last, ids
        return held

    def classes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of every id that no prediction gives, and its place in the class."""
        if self.rank is None:
            ranks, symbols = ids, np.searchsorted(self.bases, ids, side="right") + 1
        else:
            ranks = self.rank.take(ids)
            symbols = self.symbol.take(ranks)
        return symbols, ranks - self.first.take(symbols)


def encode(ids: np.ndarray, block_ids: int, most: int) -> list[np.ndarray]:
    """Digits of every block of ``block_ids`` ids; zeros fill the last block up."""
    count = -(-len(ids) // block_ids)
    model = Model(count, most)
    padded = np.zeros(count * block_ids, dtype=model.kind)
    padded[: len(ids)] = ids
    columns = np.ascontiguousarray(padded.reshape(count, block_ids).T)
    low, span = np.zeros(count, dtype=U), np.full(count, U(2**64 - 1))
    room = (SCALE + int(model.bits[-1]) + 2) * block_ids // 32 + 4
    out = np.zeros(count * room, dtype=U)
    at = np.arange(count) * room

    def settle() -> None:
        rows = (span < LEAST).nonzero()[0]
        if len(rows):
            some, to = low[rows], at[rows]
            out[to] = some >> WORD
            at[rows] = to + 1
            low[rows] = some << WORD
            span[rows] <<= WORD

    def add(more: np.ndarray) -> None:
        nonlocal low
        low = low + more
        rows = (low < more).nonzero()[0]
        if len(rows):  # the carry goes to the digit before
            out[at[rows] - 1] += U(1)

    step = 0
    while step < block_ids:
        stop = model.segment(step, block_ids)
        now = columns[step:stop]
        contexts, held = np.empty(now.shape, np.int64), np.empty((len(now), 2, count), bool)
        for k, some in enumerate(now):
            contexts[k] = model.look()
            held[k] = model.learn(some)
        symbols, rest = model.classes(now)
        one, two = held[:, 0], held[:, 1]
        missed = ~(one | two)
        # 0: order 2 holds, 1: only order 1 holds.
        symbols = np.where(missed, symbols, ~two)
        rest *= missed
        places = contexts * model.symbols + symbols
        starts, widths = model.flat_starts.take(places), model.flat_widths.take(places)
        bits, rest = model.bits.take(symbols), rest.astype(U)
        for k in range(stop - step):
            unit = span >> U(SCALE)
            more = starts[k] * unit
            span = unit * widths[k]
            if model.wide:
                add(more)
                settle()
                more = U(0)
            span >>= bits[k]
            add(more + rest[k] * span)
            settle()
        model.learn_counts(places, now, stop)
        step = stop
    # One more digit says a number inside the span, with zeros after it.
    out[at] = (low >> WORD) + ((low & LOW) > 0)
    used = at + 1 - np.arange(count) * room
    out = out.reshape(count, room)
    while (carry := out >> WORD).any():
        out &= LOW
        out[:, :-1] += carry[:, 1:]
    return [row[:n].astype("<u4") for row, n in zip(out, used, strict=True)]


def decode(digits: np.ndarray, sizes: np.ndarray, total: int, block_ids: int, most: int) -> np.ndarray:
    """Ids out of the digits of all blocks, ``sizes`` digits each."""
    count = len(sizes)
    # A zero behind each block; damaged data may ask for more and get those of the next block.
    ends = np.cumsum(sizes)
    words = np.insert(digits.astype(U), ends, U(0))
    words = np.append(words, U(0))
    at = ends - sizes + np.arange(count)
    model = Model(count, most)
    code = (words.take(at, mode="clip") << WORD) | words.take(at + 1, mode="clip")
    at += 2
    span = np.full(count, U(2**64 - 1))
    out = np.zeros((block_ids, count), dtype=model.kind)
    places = np.zeros((LEARN, count), dtype=np.int64)

    def settle() -> None:
        rows = (span < LEAST).nonzero()[0]
        if len(rows):
            of = at[rows]
            code[rows] = (code[rows] << WORD) | words.take(of, mode="clip")
            at[rows] = of + 1
            span[rows] <<= WORD

    top, step = U((1 << SCALE) - 1), 0
    while step < block_ids:
        stop = model.segment(step, block_ids)
        slots = model.slots()
        for k in range(step, stop):
            contexts = model.look()
            span >>= U(SCALE)
            aim = np.minimum(code // span, top).view(np.int64)
            aim += contexts << SCALE
            place = slots.take(aim)
            places[k - step] = place
            code -= model.flat_starts.take(place) * span
            span *= model.flat_widths.take(place)
            if model.wide:
                settle()
            symbols = place - contexts * model.symbols
            now = np.where(symbols == 0, model.guess[1], model.guess[0])
            rows = (symbols > 1).nonzero()[0]
            if len(rows):
                some = symbols.take(rows)
                bits, inside = model.bits.take(some), span.take(rows)
                inside >>= bits
                rest = code.take(rows) // inside
                code[rows] -= rest * inside
                span[rows] = inside
                ranks = model.first.take(some) + rest.view(np.int64)
                now[rows] = ranks if model.order is None else model.order.take(ranks, mode="clip")
            out[k] = now
            model.learn(now)
            settle()
        if model.order is not None:
            np.clip(out[step:stop], 0, most, out=out[step:stop])  # only damaged data leave it
        model.learn_counts(places[: stop - step], out[step:stop], stop)
        step = stop
    return out.T.reshape(-1)[:total]


def write_group(keys: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One self-contained group: header, documents, and blocks with their checksums."""
    least, longest = BLOCK_IDS
    block_ids = min(max(-(-len(ids) // BLOCKS), least), longest, max(len(ids), 1))
    most = int(ids.max()) if len(ids) else 0
    digits = encode(ids.astype(np.int64), block_ids, most) if len(ids) else []
    documents = zlib.compress(
        np.array([k or 0 for k in keys], dtype="<i8").tobytes()
        + np.array([k is None for k in keys], dtype=np.uint8).tobytes()
        + np.array(lengths, dtype="<u4").tobytes()
    )
    raw = ids.astype("<u4").tobytes()
    table = np.array(
        [[len(d), zlib.crc32(raw[4 * k * block_ids : 4 * (k + 1) * block_ids])]
         for k, d in enumerate(digits)], dtype="<u4",
    ).tobytes()
    body = b"".join(d.tobytes() for d in digits)
    head = MAGIC + struct.pack(
        HEAD, len(ids), len(keys), len(digits), block_ids, most, len(documents), zlib.crc32(body)
    )
    head += documents + table
    return head + struct.pack("<I", zlib.crc32(head)) + body


def read_group(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, lengths and ids; raises if anything differs from what was written."""
    if data[:4] != MAGIC:
        raise IdError("not a group of ids")
    start = 4 + struct.calcsize(HEAD)
    if len(data) < start:
        raise IdError("damaged header")
    total, count, blocks, block_ids, most, size, checksum = struct.unpack_from(HEAD, data, 4)
    at = start + size + 8 * blocks
    if at + 4 > len(data) or zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
        raise IdError("damaged header")
    table = np.frombuffer(data, dtype="<u4", count=2 * blocks, offset=start + size).reshape(blocks, 2)
    documents = zlib.decompress(data[start : start + size])
    keys = np.frombuffer(documents, dtype="<i8", count=count).tolist()
    missing = np.frombuffer(documents, dtype=np.uint8, count=count, offset=8 * count)
    lengths = np.frombuffer(documents, dtype="<u4", count=count, offset=9 * count)
    sizes = table[:, 0].astype(np.int64)
    if len(data) != at + 4 + 4 * sizes.sum() or zlib.crc32(data[at + 4 :]) != checksum:
        raise IdError("damaged digits")
    digits = np.frombuffer(data, dtype="<u4", offset=at + 4)
    ids = decode(digits, sizes, total, block_ids, most) if blocks else np.zeros(0, dtype=np.int64)
    ids = ids.astype("<u4")
    raw = ids.tobytes()
    for k, checksum in enumerate(table[:, 1].tolist()):
        if zlib.crc32(raw[4 * k * block_ids : 4 * (k + 1) * block_ids]) != checksum:
            raise IdError(f"damaged block {k}")
    return [None if m else k for k, m in zip(keys, missing, strict=True)], lengths, ids
