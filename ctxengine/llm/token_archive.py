"""Token ids in an archive of compressed blocks: an adaptive context-mixing range coder.

Documents are range-partitioned and sorted by id, tokenised, and written in that order. A row of the
archive is a frame: whole documents (``doc_ids``, ``lengths``) and their ids, cut into blocks of
``BLOCK`` ids. Every block is reset and can be decoded by itself; its checksum is verified. ``part``
and ``frame`` number the frames in ascending order of document ids.

A block starts with its alphabet, the ascending distinct ids as differences, and how often each occurs. Each id is then coded
under a mixture of three predictions: order 2 and order 1 each name one id, the last that followed the
two (the one) before it, and order 0 is the distribution of the block's ids. The weights of the
mixture are learned with each id, apart for each state of confidence of the two named ids, and
drive a range coder of 64 bits that emits 32 bits at a time. Weights and distributions sum to powers of two, so
nothing is divided but a decoder's value. What is coded is worked out in integers, so any machine decodes what another one wrote.

The blocks of a frame are coded in lockstep, up to ``LANES`` of them at once, id by id: a numpy operation
works on one id of each block.

Data of a frame (little-endian): "CMIX", version, number of blocks, crc32 of the table; the table, five
numbers of 32 bits for each block (ids, distinct ids, bytes of the alphabet, words, crc32 of the ids); all alphabets; all
words. An alphabet is twice the difference for each id, one more if the id occurs more than once, then how often each of these occurs,
less two. Its numbers take seven bits a byte, lowest first, the highest bit saying that more follow, and are deflated (zlib).

Defined results: a null or empty text is the single end id; rows without an id come first; rows that repeat an id
follow each other in an order set by their texts; an empty table gives an empty archive; further columns are not read; a
damaged block is an error.
"""

from __future__ import annotations

import codecs
import copy
import functools
import itertools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_batches, new_path, small_or
from .packing import ENDS, WordIds

END_ID = 1
#: Ids in a block, blocks coded at once, ids in a frame (it ends with the document that reaches them).
BLOCK, LANES, FRAME_IDS = 4096, 2048, 1 << 23
#: Bytes of text that are tokenised at once; parts of chunks that a worker remembers, and bytes of the longest of them.
TEXT_BYTES, REMEMBERED_PARTS, LONGEST_PART = 1 << 25, 1_000_000, 64
MAGIC, VERSION = b"CMIX", 3
#: Bits of the number of order-2 contexts; bits of the order-0 distribution's sum, which bounds a block, and of the weights' sum.
SLOT_BITS, ORDER_0, WEIGHTS = 12, 12, 11
SLOTS = 1 << SLOT_BITS
#: The weights of orders 2 and 1 go a part of 2**LEARN of their way to 0, or to NAMED, which leaves something to order 0; they are kept with FINE more bits.
LEARN, NAMED, FINE = 5, (1 << WEIGHTS) - 64, 4
GAIN, LEARN_MASK = NAMED << FINE >> LEARN, (0x7FFF >> LEARN) * 0x10001
#: Factors of the hash of an order-2 context, and what it is shifted by. Arrays, as numpy is slower with numbers of Python.
M1, M2, TO_SLOT, U1, U2, U3 = (np.array(n, np.uint16) for n in (1031, 2531, 16 - SLOT_BITS, 1, 2, 3))
#: A pair of weights at first.
EVEN = (1 << WEIGHTS - 2 + FINE) * 0x10001


# --- range coder, one lane for each block ---------------------------------------------------


class Encoder:
    """Low and range of each lane, of 64 bits, and the words it has emitted, a row for each lane."""

    def __init__(self, lanes: int, steps: int):
        """steps: ids of a lane at most; each emits a word at most."""
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
        self.words = np.zeros((lanes, steps + 2), np.uint32)
        self.flat, self.first = self.words.reshape(-1), np.arange(lanes) * (steps + 2)
        self.at = self.first.copy()

    def narrow(self, lanes: int) -> Encoder:
        """The first lanes alone, which share their state with this one."""
        out = copy.copy(self)
        out.low, out.range, out.at = self.low[:lanes], self.range[:lanes], self.at[:lanes]
        return out

    def code(self, unit: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Narrows each lane to ``size`` units from ``start``."""
        past = unit * start
        self.low += past
        carried = (self.low < past).nonzero()[0]
        if len(carried):
            at = self.at.take(carried)
            while len(at):  # further back only where a word was full of ones
                at = at - 1
                words = self.flat.take(at) + np.uint32(1)
                self.flat[at] = words
                at = at[words == 0]
        np.multiply(unit, size, out=self.range)
        full = (self.range < 1 << 32).nonzero()[0]
        if len(full):
            at, low = self.at.take(full), self.low.take(full)
            self.flat[at] = low >> 32
            self.at[full] = at + 1
            self.low[full] = low << 32
            self.range[full] = self.range.take(full) << 32

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """(words, a row for each lane; how many of them it has)."""
        self.flat[self.at] = self.low >> 32
        self.flat[self.at + 1] = self.low & 0xFFFFFFFF
        return self.words, self.at + 2 - self.first


class Decoder:
    def __init__(self, words: np.ndarray):
        """words: a row for each lane, zeros behind its end."""
        lanes, most = words.shape
        self.words = words.reshape(-1).astype(np.uint64)
        self.range, self.at = np.full(lanes, (1 << 64) - 1, np.uint64), np.arange(lanes) * most + 2
        self.value = (self.words[self.at - 2] << 32) | self.words[self.at - 1]

    def narrow(self, lanes: int) -> Decoder:
        out = copy.copy(self)
        out.value, out.range, out.at = self.value[:lanes], self.range[:lanes], self.at[:lanes]
        return out

    def target(self, unit: np.ndarray, most: int) -> np.ndarray:
        return np.minimum(self.value // unit, most).astype(np.int32)

    def code(self, unit: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.value -= unit * start
        np.multiply(unit, size, out=self.range)
        full = (self.range < 1 << 32).nonzero()[0]
        if len(full):
            at = self.at.take(full)
            self.value[full] = (self.value.take(full) << 32) | self.words.take(at, mode="clip")  # clipped in damaged blocks only
            self.at[full] = at + 1
            self.range[full] = self.range.take(full) << 32


# --- model ----------------------------------------------------------------------------------


def _slots(sizes: np.ndarray, distinct: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first slot, slots) of each distinct id in its lane's order-0 distribution of 2**ORDER_0 slots; counts lane by lane."""
    lane = np.repeat(np.arange(len(distinct)), distinct)
    past = np.cumsum(counts) - (np.cumsum(sizes) - sizes)[lane]
    ends = -(-(past << ORDER_0) // sizes[lane])
    first = np.concatenate(([0], ends[:-1]))
    first[np.cumsum(distinct) - distinct] = 0
    return first, ends - first


class Model:
    """What each lane of a decoder has learned (``_keys`` and ``_code`` work out the same for a coder, which has all ids); ``decode`` decodes one id of each lane.

    An id that a predictor names is kept as 4 * id + sureness; none is id 0 with sureness 0. A pair of weights, of order 2 and 1, is kept
    in halves of a number, with FINE more bits than are used.
    """

    def __init__(self, distinct: np.ndarray):
        lanes, room = len(distinct), int(distinct.max(initial=1))
        self.one, self.two = np.zeros(lanes * room, np.uint16), np.zeros(lanes * SLOTS, np.uint16)
        self.weights = np.full(lanes * 32, EVEN, np.int32)
        self.at_id, self.at_slot, self.at_state, self.at_held = (np.arange(lanes) * n for n in (room, SLOTS, 32, 1 << ORDER_0))
        self.at_one, self.last, self.hash = self.at_id.copy(), np.zeros(lanes, np.uint16), np.zeros(lanes, np.uint16)

    def distribution(self, distinct: np.ndarray, first: np.ndarray, slots: np.ndarray) -> None:
        """For decoding: slots of an id, ids of a slot."""
        lane = np.repeat(np.arange(len(distinct)), distinct)
        no = np.arange(len(lane)) - (np.cumsum(distinct) - distinct)[lane]
        self.slots, self.held = np.zeros(len(self.one), np.int32), np.repeat(no.astype(np.uint16), slots)
        self.slots[self.at_id[lane] + no] = first << 16 | slots

    def narrow(self, lanes: int) -> Model:
        out = copy.copy(self)
        for name in ("at_id", "at_slot", "at_state", "at_held", "at_one", "last", "hash"):
            setattr(out, name, getattr(self, name)[:lanes])
        return out

    def _predicted(self) -> tuple[np.ndarray, ...]:
        """Places and contents of what orders 1 and 2 name, place and pair of the weights, weights as they are used."""
        at_two = self.at_slot + ((self.hash + self.last * M1) >> TO_SLOT)
        one, two = self.one.take(self.at_one, mode="clip"), self.two.take(at_two, mode="clip")
        id1, id2 = one >> U2, two >> U2
        state = self.at_state + (((two & U3) << U3) | ((one & U3) << U1) | (id1 == id2))
        pair = self.weights.take(state, mode="clip")
        w2, w1 = pair >> 16 + FINE, (pair >> FINE) & (1 << WEIGHTS) - 1
        return at_two, one, two, id1, id2, state, pair, w2, w1, w2 + w1

    def _learn(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, same1: np.ndarray, at: np.ndarray, at_two: np.ndarray, one: np.ndarray, two: np.ndarray, state: np.ndarray, pair: np.ndarray) -> None:
        """The mixture, and what the predictors name next. hit1: order 1 names it and order 2 does not, same1: order 1 names it."""
        self.weights[state] = pair - ((pair >> LEARN) & LEARN_MASK) + (hit2 * np.int32(GAIN << 16) + hit1 * np.int32(GAIN))
        base = ids << U2
        new, most = base + U1, base + U3
        self.one[self.at_one] = np.where(same1, np.minimum(one + U1, most), new)
        self.two[at_two] = np.where(hit2, np.minimum(two + U1, most), new)
        np.multiply(self.last, M2, out=self.hash)
        self.last[:] = ids
        self.at_one[:] = at

    def decode(self, coder: Decoder) -> np.ndarray:
        at_two, one, two, id1, id2, state, pair, w2, w1, named = self._predicted()
        w0 = (1 << WEIGHTS) - named
        edge2, edge1 = w2 << ORDER_0, named << ORDER_0
        unit = coder.range >> WEIGHTS + ORDER_0
        target = coder.target(unit, (1 << WEIGHTS + ORDER_0) - 1)
        hit2, miss = target < edge2, target >= edge1
        rest = ((target - edge1) / w0).astype(np.int64) & (1 << ORDER_0) - 1  # exact where it is used: numbers of 23 and 11 bits
        ids = np.where(miss, self.held.take(self.at_held + rest, mode="clip"), np.where(hit2, id2, id1))
        at = self.at_id + ids
        slots = self.slots.take(at, mode="clip")
        hit1 = ~(hit2 | miss)
        start = np.where(miss, edge1 + w0 * (slots >> 16), hit1 * edge2)
        size = np.where(miss, w0 * (slots & 0xFFFF), np.where(hit2, w2, w1) << ORDER_0)
        coder.code(unit, start.astype(np.uint64), size.astype(np.uint64))
        self._learn(ids, hit2, hit1, ids == id1, at, at_two, one, two, state, pair)
        return ids


def _entries(contexts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """What a predictor has for the context of each id when it comes, a row for each lane (see ``Model``)."""
    order = np.argsort(contexts, axis=1, kind="stable")  # by digits
    order += np.arange(len(ids))[:, None] * ids.shape[1]
    c, v = contexts.take(order), ids.take(order) << np.uint16(2)
    met = c[:, 1:] == c[:, :-1]
    again = np.zeros(ids.shape, bool)
    np.logical_and(met, v[:, 1:] == v[:, :-1], out=again[:, 1:])
    v += np.uint16(1)
    v += again
    v[:, 1:] += again[:, 1:] & again[:, :-1]
    out = np.zeros(ids.shape, np.uint16)
    out.reshape(-1)[order[:, 1:]] = v[:, :-1] * met
    return out


def _keys(ids: np.ndarray) -> np.ndarray:
    """For coding: of each id the state of the weights, and how it is predicted: 32 by order 2, 64 by order 1 and not by order 2."""
    out = np.empty(ids.shape, np.uint8)
    for lane in range(0, len(ids), 32):  # little enough for a processor's memory
        some = ids[lane : lane + 32]
        last = np.zeros(some.shape, np.uint16)
        last[:, 1:] = some[:, :-1]
        slot = last * M1
        slot[:, 1:] += last[:, :-1] * M2
        one, two = _entries(last, some), _entries(slot >> TO_SLOT, some)
        id1, id2 = one >> 2, two >> 2
        hit2 = some == id2
        out[lane : lane + 32] = ((two & 3) << 3) | ((one & 3) << 1) | (id1 == id2) | (hit2 * np.uint16(32)) | (((some == id1) > hit2) * np.uint16(64))
    return out


def _code(ids: np.ndarray, slots: np.ndarray, last_size: int) -> Encoder:
    """Codes all ids, a row for each lane, of which the last one may be shorter. slots: of each id the first one, and in the lower 16 bits how many it has."""
    lanes, keys = len(ids), _keys(ids)
    whole = coder = Encoder(lanes, ids.shape[1])
    weights, at_state, gains = np.full(lanes * 32, EVEN, np.int32), np.arange(lanes) * 32, np.array([0, GAIN << 16, GAIN], np.int32)
    for at in range(0, ids.shape[1], 64):
        key, slot = np.ascontiguousarray(keys[:, at : at + 64].T), np.ascontiguousarray(slots[:, at : at + 64].T)
        state, gain, pairs = (key & 31) + at_state, gains.take(key >> 5), np.empty(key.shape, np.int32)
        for pair, state_t, gain_t in zip(pairs, state, gain, strict=True):
            weights.take(state_t, out=pair, mode="clip")
            weights[state_t] = pair - ((pair >> LEARN) & LEARN_MASK) + gain_t
        w2, w1 = pairs >> 16 + FINE, (pairs >> FINE) & (1 << WEIGHTS) - 1
        named, hit2, hit1 = w2 + w1, (key & 32).astype(bool), (key & 64).astype(bool)
        w0 = (1 << WEIGHTS) - named
        start = np.where(hit2 | hit1, hit1 * (w2 << ORDER_0), (named << ORDER_0) + w0 * (slot >> 16)).astype(np.uint64)
        size = np.where(hit2, w2 << ORDER_0, np.where(hit1, w1 << ORDER_0, w0 * (slot & 0xFFFF))).astype(np.uint64)
        for t, start_t, size_t in zip(range(at, at + 64), start, size, strict=False):
            if t == last_size:
                coder = whole.narrow(lanes - 1)
            n = len(coder.at)
            coder.code(coder.range >> WEIGHTS + ORDER_0, start_t[:n], size_t[:n])
    return whole


# --- frames ---------------------------------------------------------------------------------


def _packed(numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers of at most 35 bits, seven bits a byte; where the bytes of each end."""
    sevens = np.ones(len(numbers), np.int64)
    for s in (7, 14, 21, 28):
        sevens += numbers >= 1 << s
    ends = np.cumsum(sevens)
    out, at = np.zeros(int(sevens.sum()), np.uint8), ends - sevens
    out[at] = (numbers & 127) | (sevens > 1) * 128
    for k in range(1, int(sevens.max(initial=0))):
        has = np.flatnonzero(sevens > k)
        out[at[has] + k] = ((numbers[has] >> (7 * k)) & 127) | (sevens[has] > k + 1) * 128
    return out.tobytes(), ends


def _unpacked(b: np.ndarray) -> np.ndarray:
    """The numbers of bytes, the last of which ends one."""
    ends = np.flatnonzero(b < 128)
    first = np.concatenate(([0], ends[:-1] + 1))
    place = np.minimum(np.arange(len(b)) - np.repeat(first, ends - first + 1), 5)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), first)


def _alphabets(ids: np.ndarray, counts: np.ndarray, distinct: np.ndarray) -> list[bytes]:
    """Ids and how often each occurs, block by block, of which each has at least one."""
    starts = np.cumsum(distinct) - distinct
    steps, again = np.diff(ids.astype(np.int64), prepend=0), counts > 1
    steps[starts] = ids[starts]
    more = np.add.reduceat(again.astype(np.int64), starts)
    at = np.arange(len(ids)) + np.repeat(np.cumsum(more) - more, distinct)
    numbers, is_step = np.zeros(len(ids) + int(more.sum()), np.int64), np.zeros(len(ids) + int(more.sum()), bool)
    is_step[at], numbers[at] = True, (steps << 1) + again
    numbers[~is_step] = counts[again] - 2
    data, ends = _packed(numbers)
    cuts = [0, *ends[np.cumsum(distinct + more) - 1].tolist()]
    return [zlib.compress(data[a:z], 1) for a, z in zip(cuts, cuts[1:], strict=False)]


def _read_alphabets(data: list[bytes], sizes: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how often each occurs), block by block."""
    try:
        plain = [zlib.decompress(d) for d in data]
    except zlib.error as e:
        raise ValueError("a block's alphabet is damaged") from e
    if not all(p and p[-1] < 128 for p in plain) or distinct.min() < 1:
        raise ValueError("a block's alphabet is damaged")
    b, lengths = np.frombuffer(b"".join(plain), np.uint8), np.array([len(p) for p in plain])
    numbers, n = _unpacked(b), np.add.reduceat((b < 128).astype(np.int64), np.cumsum(lengths) - lengths)
    if (n < distinct).any():
        raise ValueError("a block's alphabet is damaged")
    starts = np.cumsum(distinct) - distinct
    at = np.arange(int(distinct.sum())) + np.repeat(np.cumsum(n) - n - starts, distinct)
    steps, is_more = numbers[at], np.ones(len(numbers), bool)
    is_more[at], again = False, (steps & 1).astype(bool)
    if (n != distinct + np.add.reduceat(again.astype(np.int64), starts)).any():
        raise ValueError("a block's alphabet is damaged")
    counts = np.ones(len(steps), np.int64)
    counts[again] = numbers[is_more] + 2
    if (np.add.reduceat(counts, starts) != sizes).any():
        raise ValueError("a block's alphabet is damaged")
    ids = np.cumsum(steps >> 1)
    return ids - np.repeat(ids[starts] - (steps[starts] >> 1), distinct), counts


def _alphabet(ids: np.ndarray, counts: np.ndarray) -> bytes:
    return _alphabets(ids, counts, np.array([len(ids)]))[0]


def _read_alphabet(data: bytes, size: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    return _read_alphabets([data], np.array([size]), np.array([distinct]))


def _distinct(part: np.ndarray, no: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending distinct ids, number of each id among them, how often each occurs); no: room for 2**16 numbers."""
    if part.max() >= len(no):
        return np.unique(part, return_inverse=True, return_counts=True)
    ordered = np.sort(part.astype(np.uint16), kind="stable")  # by digits
    first = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
    ids = ordered[first]
    no[ids] = np.arange(len(ids))
    return ids, no[part], np.diff(first, append=len(part))


def encode_frame(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """ids (unsigned 32-bit) as the data of a frame."""
    if not 0 < block <= 1 << ORDER_0:
        raise ValueError(f"a block has at most {1 << ORDER_0} ids")
    ids = np.ascontiguousarray(ids, "<u4")
    cut = [ids[at : at + block] for at in range(0, len(ids), block)]
    table, alphabets, payloads, no = np.zeros((len(cut), 5), "<u4"), [], [], np.zeros(1 << 16, np.uint16)
    for low in range(0, len(cut), LANES):
        some = cut[low : low + LANES]  # only the last block of a frame is shorter
        symbols, alphabet, counts = np.zeros((len(some), len(some[0])), np.uint16), [], []
        for lane, part in enumerate(some):
            held, symbols[lane, : len(part)], often = _distinct(part, no)
            alphabet.append(held)
            counts.append(often)
            table[low + lane, [0, 1, 4]] = len(part), len(held), zlib.crc32(part)
        sizes, distinct = table[low : low + len(some), :2].astype(np.int64).T
        often, ends = np.concatenate(counts), np.cumsum(distinct)
        alphabets += _alphabets(np.concatenate(alphabet), often, distinct)
        table[low : low + len(some), 2] = [len(a) for a in alphabets[low:]]
        first, slots = _slots(sizes, distinct, often)
        held = (first << 16 | slots).astype(np.int32)
        slots = np.stack([held[end - n : end].take(row, mode="clip") for end, n, row in zip(ends, distinct, symbols, strict=True)])
        words, used = _code(symbols, slots, int(sizes[-1])).finish()
        table[low : low + len(some), 3] = used
        payloads += [words[lane, :n].astype("<u4").tobytes() for lane, n in enumerate(used)]
    head = MAGIC + np.array([VERSION, len(cut), zlib.crc32(table.tobytes())], "<u4").tobytes()
    return b"".join([head, table.tobytes(), *alphabets, *payloads])


def decode_frame(data: bytes) -> np.ndarray:
    """The ids of a frame; every checksum is verified."""
    version, n, crc = np.frombuffer(data, "<u4", 3, 4)
    if data[:4] != MAGIC or version != VERSION:
        raise ValueError("not a frame of this format")
    table = np.frombuffer(data, "<u4", 5 * int(n), 16).reshape(-1, 5).astype(np.int64)
    if zlib.crc32(data[16 : 16 + 20 * int(n)]) != crc:
        raise ValueError("a frame's table is damaged")
    alphabet_at = 16 + 20 * int(n) + np.concatenate(([0], np.cumsum(table[:, 2])))
    words_at = alphabet_at[-1] + 4 * np.concatenate(([0], np.cumsum(table[:, 3])))
    out = []
    for low in range(0, int(n), LANES):
        some = table[low : low + LANES]
        words = np.zeros((len(some), max(2, int(some[:, 3].max()))), np.uint32)
        for lane, used in enumerate(some[:, 3].tolist()):
            words[lane, :used] = np.frombuffer(data, "<u4", used, int(words_at[low + lane]))
        cuts = alphabet_at[low : low + len(some) + 1].tolist()
        sizes, distinct = some[:, 0], some[:, 1]
        alphabet, counts = _read_alphabets([data[a:z] for a, z in zip(cuts, cuts[1:], strict=False)], sizes, distinct)
        whole = coder, model = Decoder(words), Model(distinct)
        model.distribution(distinct, *_slots(sizes, distinct, counts))
        symbols = np.zeros((len(some), int(sizes[0])), np.uint16)
        for at in range(0, symbols.shape[1], 64):
            some_ids = np.zeros((min(64, symbols.shape[1] - at), len(some)), np.uint16)
            for t, ids_t in enumerate(some_ids, at):
                if t == sizes[-1]:
                    coder, model = (x.narrow(len(some) - 1) for x in whole)
                ids_t[: len(model.at_id)] = model.decode(coder)
            symbols[:, at : at + 64] = some_ids.T
        alphabet, ends = alphabet.astype("<u4"), np.cumsum(distinct)
        for row, size, n, end, crc in zip(symbols, sizes, distinct, ends, some[:, 4], strict=True):
            part = alphabet[end - n : end].take(row[:size], mode="clip")
            if zlib.crc32(part) != crc:
                raise ValueError("a block of token ids does not match its checksum")
            out.append(part)
    return np.concatenate(out) if out else np.zeros(0, "<u4")


# --- archive --------------------------------------------------------------------------------


def _ranges(ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, of which each ends before one of the ends."""
    after = np.cumsum(sizes)
    return np.arange(after[-1] if len(after) else 0) + np.repeat(ends - after, sizes)


def _gathered(ids: np.ndarray, ends: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of these lists one after the other, where each ends); ends: where each list ends in ids."""
    got = pa.ListArray.from_arrays(pa.array(np.insert(ends, 0, 0).astype(np.int32)), pa.array(ids)).take(pa.array(lists))
    return got.values.to_numpy(), got.offsets.to_numpy()[1:].astype(np.int64)


def _strings(texts: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Where texts start and end, and their bytes."""
    return np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset), texts.buffers()[2] or pa.py_buffer(b"")


def _parts(chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Lower-case word and marks of each chunk in Latin-1 that is a word with marks behind it; any other chunk is a word."""
    latin = pc.invert(pc.match_substring_regex(chunks, r"[^\x{0}-\x{ff}]"))
    chunks = pc.if_else(latin, pc.utf8_lower(chunks), chunks)
    words = pc.utf8_rtrim(chunks, ENDS)
    words = pc.if_else(pc.and_(latin, pc.utf8_is_alpha(words)), words, chunks)
    at, data = _strings(chunks)
    sizes = np.diff(at) - pc.binary_length(words).to_numpy()
    marks = np.frombuffer(data, np.uint8).take(_ranges(at[1:], sizes))
    return words, pa.StringArray.from_buffers(len(chunks), pa.py_buffer(np.cumsum(np.insert(sizes, 0, 0), dtype=np.int32)), pa.py_buffer(marks))


class TextIds:
    """Ids of many texts at once.

    Arrow cuts the texts into chunks at white space, numbers the distinct ones, and cuts these into a word and the marks behind it
    (see ``WordIds``); the tokenizer's model is called only for those parts that are not remembered.
    ``known`` are the remembered parts, ``ids`` theirs, and ``ends`` where the ids of each one end.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_PARTS):
        self.words, self.remembered = WordIds(path), remembered
        self.known, self.ids, self.ends = pa.array([""]), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _call(self, parts: list[str]) -> None:
        """Appends what the tokenizer gives for new parts."""
        flat, sizes, tokenize, alphabet = [], [], self.words.model.tokenize, self.words.alphabet
        for part in parts:
            if part.isalpha() and (part.isascii() or max(part) < "\u0100"):
                ids = tokenize(part if part.isascii() else codecs.charmap_decode(part.encode(), "strict", alphabet)[0])
                flat += [t.id for t in ids]
            else:
                flat += (ids := array("I", self.words._ids(part)))
            sizes.append(len(ids))
        self.ids = np.concatenate((self.ids, np.array(flat, "<u4")))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes, dtype=np.int64)))

    def _remember(self, parts: pa.Array, often: np.ndarray) -> None:
        """Forgets long parts, and all but the most frequent half where there are too many."""
        self.known, short = parts, pc.binary_length(parts).to_numpy() <= LONGEST_PART
        if len(parts) > self.remembered or not short.all():
            kept = np.flatnonzero(short)
            if len(parts) > self.remembered:
                kept = np.union1d(0, kept[np.argsort(-often[kept], kind="stable")[: self.remembered // 2]])
            self.known, (self.ids, self.ends) = parts.take(pa.array(kept)), _gathered(self.ids, self.ends, kept)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; how many each has)."""
        whole, texts = {}, pc.fill_null(texts.cast(pa.string()), "")
        at, data = _strings(texts)
        data = data[int(at[0]) : int(at[-1])].to_pybytes()
        if any(mark.encode() in data for mark in self.words.marks):
            whole = {i: text for i, text in enumerate(texts.to_pylist()) if any(mark in text for mark in self.words.marks)}
            texts = pa.array(["" if i in whole else text for i, text in enumerate(texts.to_pylist())])
        plain = np.frombuffer(data, np.uint8).max(initial=0) <= 0xC3 and (b"\xc2" not in data or b"\xc2\x85" not in data and b"\xc2\xa0" not in data)  # white space in ASCII only
        cut = (pc.ascii_split_whitespace if plain else pc.utf8_split_whitespace)(texts)
        chunks = cut.flatten().dictionary_encode()
        words, marks = _parts(chunks.dictionary)
        _, word, mark = (numbered := pa.chunked_array([self.known, words, marks]).dictionary_encode()).chunks
        fresh = mark.dictionary.slice(len(self.known))
        if len(fresh):
            self._call(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(fresh)], pa.int32()), fresh), "\n")[0].as_py().split("\n"))
        word, mark = word.indices.to_numpy(), mark.indices.to_numpy()
        ids, ends = _gathered(self.ids, self.ends, np.stack((word, mark), 1).reshape(-1))
        text_ends, no = np.cumsum(pc.list_value_length(cut).to_numpy()), chunks.indices.to_numpy()
        often = np.bincount(no, minlength=len(word))
        self._remember(numbered.chunk(2).dictionary, np.bincount(word, often, len(self.ends)) + np.bincount(mark, often, len(self.ends)))
        # the end id is one chunk more, behind each text
        ids, ends = _gathered(np.append(ids, np.uint32(end_id)), np.append(ends[1::2], len(ids) + 1), np.insert(no, text_ends, len(word)))
        sizes = np.diff(ends[text_ends + np.arange(len(text_ends))], prepend=0)
        if whole:
            each = np.split(ids, np.cumsum(sizes)[:-1])
            for i, text in whole.items():
                each[i] = np.append(np.frombuffer(self.words.encode(text), "<u4"), np.uint32(end_id))
            ids, sizes = np.concatenate(each), np.array([len(e) for e in each])
        return ids, sizes


@functools.lru_cache(maxsize=1)
def _texts(path: str) -> TextIds:
    return TextIds(path)


def _by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most that many bytes of the column, or of one row."""
    held, room = [], most
    for b in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy()), 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = int(np.searchsorted(ends, before + room, side="right"))
            if to == at and not held:
                to += 1
            if to > at:
                held.append(b.slice(at, to - at))
                room -= int(ends[to - 1]) - before
            if to < b.num_rows:
                yield pa.concat_batches(held)
                held, room = [], most
            at = to
    if held:
        yield pa.concat_batches(held)


def write_archive(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", frame_ids: int = FRAME_IDS) -> str:
    """Writes the archive into the shared folder and returns its place."""
    spark = docs.sparkSession

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _texts(tokenizer_path)
        names, lengths, held, size, part, frame = [], [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            data = encode_frame(np.concatenate(held))
            columns = [pa.array([part], pa.int32()), pa.array([frame], pa.int32()), pa.array([list(itertools.chain(*names))], pa.list_(pa.int64())), pa.array([np.concatenate(lengths)], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([data], pa.binary())]
            return pa.record_batch(columns, names=["part", "frame", "doc_ids", "lengths", "n_ids", "data"])

        for b in _by_bytes(batches, "text", TEXT_BYTES):
            part, docs = b.column("part")[0].as_py(), b.column("doc_id").to_pylist()
            ids, each = texts.encode(b.column("text"), end_id)
            ends, at, id_at = np.cumsum(each), 0, 0
            while at < len(docs):
                to = min(int(np.searchsorted(ends, id_at + frame_ids - size)) + 1, len(docs))
                names.append(docs[at:to])
                lengths.append(each[at:to])
                held.append(ids[id_at : int(ends[to - 1])])
                size, at, id_at = size + len(held[-1]), to, int(ends[to - 1])
                if size >= frame_ids:
                    yield row()
                    names, lengths, held, size, frame = [], [], [], 0, frame + 1
        if names:
            yield row()

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = base.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select(F.spark_partition_id().alias("part"), "doc_id", "text")
    path = new_path(spark, "token-archive")
    in_batches(dealt, work, "part int, frame int, doc_ids array<long>, lengths array<long>, n_ids long, data binary").write.option("compression", "uncompressed").parquet(path)
    return path


def frame_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, frame, first): the ids before each frame. One number for each partition that was written passes through the driver."""
    frames = spark.read.parquet(path).select("part", "frame", "n_ids")
    first, before = {}, 0
    for part, n in sorted(map(tuple, frames.groupBy("part").agg(F.sum("n_ids")).collect())):
        first[part], before = before, before + n
    parts = spark.createDataFrame(list(first.items()), "part int, before long")
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return frames.join(F.broadcast(parts), "part").select("part", "frame", (F.col("before") + within).alias("first"))


def read_archive(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, and its ids (unsigned 32-bit, little-endian) if they are wanted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids = memoryview(decode_frame(b.column("data")[k].as_py()).tobytes())
                lengths = b.column("lengths")[k].values.to_numpy()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                each = [ids[4 * a : 4 * z] for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array([b.column(c)[k].as_py()] * len(each), pa.int32()) for c in ("part", "frame")]
                columns += [b.column("doc_ids")[k].values, pa.array(starts), pa.array(lengths), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                yield pa.record_batch([*columns, *([pa.array([bytes(x) for x in each], pa.binary())] if with_ids else [])], names=["part", "frame", "doc_id", "within", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    frames = spark.read.parquet(path).select("part", "frame", "doc_ids", "lengths", "data")
    docs = in_batches(frames, work, "part int, frame int, doc_id long, within long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
    return docs.join(small_or(frame_starts(spark, path)), ["part", "frame"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
