"""Lossless WebP (the VP8L bit stream): a full decoder, and an encoder for pixel arrays.

Pixels are uint8 arrays of shape (height, width, 4) in the order green, red,
blue, alpha, which is the order of the bit stream. The decoder reads prefix
codes (simple and normal), several groups of them, back-references, the colour
cache, and inverts the predictor, cross-colour, subtract-green and palette
transforms. Images of one group of codes are decoded with arrays: at every bit
it is found where a pixel that begins there ends, and only the chain of true
beginnings is walked. Images of several groups are read pixel by pixel.

The encoder writes Huffman codes; its ``tools`` switch on the transforms, the
cache and back-references. ``compress`` chooses them by the image.
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from functools import cached_property, lru_cache
from typing import Any

import numpy as np

#: Fixed values of the format.
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LEFT, TOP = 1, 2
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTH_CODES, DISTANCE_CODES = 24, 40
CACHE_FACTOR = 0x1E35A7BD
BLACK = (0, 0, 0, 255)
MAX_SIDE = 1 << 14
#: Bits that are looked at together.
CHUNK = 1 << 16
#: Added to the length of a green symbol that is a cache index or a copy; more than any place in a chunk.
HIT, COPY = 1 << 20, 1 << 21
#: Fewer images than these aren't read together; so many steps are taken between two looks for images that have ended.
TOGETHER, STRIDE = 48, 16
#: Added to copies' symbols there; more than any symbol.
COPIED = 1 << 12
#: The encoder's longest code, and its colour cache.
MOST, CACHE_BITS = 12, 8
MOST_SYMBOLS = 256 + LENGTH_CODES + (1 << CACHE_BITS)
#: The 120 near pixels that short distance codes mean: nearest first, then by column, the left one first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class FormatError(ValueError):
    """The bytes aren't a lossless WebP image."""


class BitReader:
    """Reads numbers from the lowest bit up."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, at: int, n: int) -> int:
        first = at >> 3
        return int.from_bytes(self.data[first : first + (n + 14 >> 3)], "little") >> (at & 7) & (1 << n) - 1

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise FormatError("the image ends too early")
        self.at += n
        return self.peek(self.at - n, n)


@lru_cache(1 << 14)
def _field(value: int, n: int) -> str:
    return format(value, f"0{n}b")[::-1]


class BitWriter:
    """Bits as strings of 0 and 1, the first bit first, and before them numbers of up to 64 bits with their sizes, the lowest bit first."""

    def __init__(self):
        self.bits: list[str] = []
        self.numbers: list[tuple[np.ndarray, np.ndarray]] = []

    def write(self, value: int, n: int) -> None:
        if n:
            self.bits.append(_field(value, n))

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.gather()
        self.numbers.append((values, sizes))

    def gather(self) -> None:
        if text := "".join(self.bits):
            parts = [text[k : k + 64] for k in range(0, len(text), 64)]
            self.numbers.append((np.array([int(x[::-1], 2) for x in parts], np.uint64), np.array([len(x) for x in parts], np.int64)))
            self.bits = []

    def array(self) -> np.ndarray:
        """The bits one by one."""
        stream = self.stream()
        return np.unpackbits(np.frombuffer(stream, np.uint8), count=sum(int(n.sum()) for _, n in self.numbers), bitorder="little")

    def stream(self) -> bytes:
        return streams([self])[0]


def streams(writers: list[BitWriter]) -> list[bytes]:
    """The bytes of each writer; each begins a word of 64 bits, and a number falls into one or two words."""
    for x in writers:
        x.gather()
    values, sizes = (np.concatenate([np.zeros(1, t), *(y[k] for x in writers for y in x.numbers)], dtype=t) for k, t in ((0, np.uint64), (1, np.int64)))
    count = np.cumsum([0, *(sum(len(n) for _, n in x.numbers) for x in writers)])
    ends = np.cumsum(sizes)
    last = ends[count]
    size = np.diff(last)
    words = (size + 63 >> 6) + 1
    begin = np.cumsum(words) - words
    values, at = values[1:], (ends - sizes)[1:] + np.repeat(64 * begin - last[:-1], np.diff(count))
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    out = np.zeros(int(words.sum()) + 1, "<u8")
    if len(word):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        out[word[first] + 1] |= np.bitwise_or.reduceat(values >> np.uint64(1) >> np.uint64(63) - shift, first)
    whole = out.tobytes()
    return [whole[8 * at : 8 * at + n] for at, n in zip(begin.tolist(), (size + 7 >> 3).tolist(), strict=True)]


class PrefixCode:
    """A canonical prefix code by its lengths."""

    def __init__(self, lengths: bytes):
        self.lengths, used = lengths, len(lengths) - lengths.count(0)
        self.only = None if used > 1 else len(lengths) - len(lengths.lstrip(b"\0")) if used else 0
        if self.only is None and sum(lengths.count(n) << 15 - n for n in range(1, 16)) != 1 << 15:
            raise FormatError("a prefix code isn't complete")

    @cached_property
    def ordered(self) -> tuple[np.ndarray, np.ndarray]:
        """The used symbols in the order of their codes, and their lengths."""
        used = np.flatnonzero(np.frombuffer(self.lengths, np.uint8))
        lengths = np.frombuffer(self.lengths, np.uint8)[used].astype(np.int64)
        order = np.argsort(lengths, kind="stable")
        return used[order], lengths[order]

    def read(self, bits: BitReader) -> int:
        if self.only is not None:
            return self.only
        most, symbols, lengths = self.lookup
        number = bits.peek(bits.at, most)
        bits.at += int(lengths[number])
        if bits.at > 8 * len(bits.data):
            raise FormatError("the image ends too early")
        return int(symbols[number])

    @cached_property
    def entries(self) -> tuple[int, np.ndarray]:
        """The longest length; symbol and, 16 bits above it, length by that many bits of the stream."""
        if self.only is not None:
            return 0, np.array([self.only])
        used, lengths = self.ordered
        most = int(lengths[-1])
        return most, np.repeat(used | lengths << 16, 1 << most - lengths).take(_turned(most))

    @cached_property
    def lookup(self) -> tuple[int, np.ndarray, np.ndarray]:
        """The longest length, and symbol and length by that many bits of the stream."""
        most, both = self.entries
        return most, both & 65535, both >> 16

    @cached_property
    def steps(self) -> np.ndarray:
        """Lengths as in ``lookup``, plus HIT or COPY where the symbol is no sample."""
        kinds = lambda symbols: np.where(symbols < 256, 0, np.where(symbols < 256 + LENGTH_CODES, COPY, HIT))
        if self.only is not None:
            return kinds(self.lookup[1])
        used, lengths = self.ordered
        most = int(lengths[-1])
        return np.repeat(lengths + kinds(used), 1 << most - lengths).take(_turned(most))

    @staticmethod
    def fill(codes: list[PrefixCode]) -> None:
        """Makes the entries of many codes at once."""
        codes = [code for code in {id(code): code for code in codes}.values() if code.only is None and "entries" not in code.__dict__]
        if not codes:
            return
        lengths = np.frombuffer(b"".join([code.lengths for code in codes]), np.uint8)
        widths = np.array([len(code.lengths) for code in codes])
        at = np.flatnonzero(lengths)
        row = np.repeat(np.arange(len(codes)), widths)[at]
        symbols, n = at - (np.cumsum(widths) - widths)[row], lengths[at].astype(np.int64)
        order = np.argsort(row << 4 | n, kind="stable")
        row, symbols, n = row[order], symbols[order], n[order]
        most = n[np.flatnonzero(np.diff(row, append=-1))]
        begin = np.cumsum(1 << most) - (1 << most)
        both = np.repeat((symbols | n << 16).astype(np.int32), 1 << most[row] - n)
        for code, first, wide in zip(codes, begin.tolist(), most.tolist(), strict=True):
            code.__dict__["entries"] = wide, both[first : first + (1 << wide)].take(_turned(wide))

    @cached_property
    def pairs(self) -> list[int]:
        """Symbol and, 16 bits above it, length by the longest length's bits of the stream."""
        return self.entries[1].tolist()



@lru_cache
def _turned(n: int) -> np.ndarray:
    """The numbers of n bits with their bits in reverse order."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


@lru_cache
def _places() -> np.ndarray:
    """Every place in a chunk."""
    return np.arange(CHUNK + 128)


@lru_cache(256)
def prefix_code(lengths: bytes) -> PrefixCode:
    """Images often have the codes of others; they are built once."""
    return PrefixCode(lengths)


#: Gives code lengths that are to be read (bits, symbols, their own code, how many) and is sent them.
Opening = Generator[tuple[BitReader, int, PrefixCode, int], bytes, Any]


def _read_code(bits: BitReader, symbols: int) -> Opening:
    lengths = bytearray(symbols)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        found = [bits.read(8 if wide else 1), *(bits.read(8) for _ in range(two))]
        if max(found) >= symbols:
            raise FormatError("a symbol is out of range")
        for s in found:
            lengths[s] = 1
        return prefix_code(bytes(lengths))
    own = bytearray(19)
    n = 4 + bits.read(4)
    found = bits.read(3 * n)
    for i in LENGTH_ORDER[:n]:
        own[i] = found & 7
        found >>= 3
    code = prefix_code(bytes(own))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else symbols
    return prefix_code((yield bits, symbols, code, left))


def _read_lengths(bits: BitReader, symbols: int, code: PrefixCode, left: int) -> bytes:
    lengths, at, last = bytearray(symbols), 0, 8
    by_bits, mask = code.pairs, (1 << code.entries[0]) - 1
    start = bits.at
    ahead = int.from_bytes(bits.data[start >> 3 : (start >> 3) + 2 * symbols + 8], "little") >> (start & 7)
    ahead |= 1 << 8 * (2 * symbols + 9)  # its place tells how much has been read
    whole = ahead.bit_length()
    while at < symbols and left:
        left -= 1
        n = by_bits[ahead & mask]
        ahead >>= n >> 16
        s = n & 65535
        if s < 16:
            if s:
                lengths[at] = last = s
            at += 1
            continue
        least, extra, value = ((3, 2, last), (3, 3, 0), (11, 7, 0))[s - 16]
        n = least + (ahead & (1 << extra) - 1)
        ahead >>= extra
        if at + n > symbols:
            raise FormatError("code lengths run over")
        if value:
            lengths[at : at + n] = bytes((value,)) * n
        at += n
    bits.at += whole - ahead.bit_length()
    if bits.at > 8 * len(bits.data):
        raise FormatError("the image ends too early")
    return bytes(lengths)


def _windows(images: list[BitReader]) -> tuple[np.ndarray, np.ndarray]:
    """64 bits from each byte of all images on, and each image's first bit."""
    stream = b"".join([bits.data for bits in images]) + bytes(16)
    return np.ndarray((len(stream) - 8,), "<i8", stream, strides=(1,)).copy(), 8 * np.cumsum([0, *(len(bits.data) for bits in images)])[:-1]


def _read_lengths_together(asked: list[tuple[BitReader, int, PrefixCode, int]]) -> list[bytes]:
    """Code lengths of many codes, one symbol of each at a step."""
    PrefixCode.fill([code for _, _, code, _ in asked])
    windows, origin = _windows([bits for bits, *_ in asked])
    most = np.array([code.entries[0] for _, _, code, _ in asked])
    table = np.concatenate([code.entries[1] for _, _, code, _ in asked])
    offset, mask = np.cumsum(1 << most) - (1 << most), (1 << most) - 1
    room, left = np.array([x[1] for x in asked]), np.array([x[3] for x in asked])
    p, at, last = origin + [bits.at for bits, *_ in asked], np.zeros(len(asked), np.int64), np.full(len(asked), 8)
    extra_of, least_of = np.array([0] * 16 + [2, 3, 7]), np.array([1] * 16 + [3, 3, 11])
    who, rows, values, times = np.arange(len(asked)), [], [], []
    while len(who):
        q, so_far = p[who], last[who]
        window = windows.take(q >> 3, mode="clip") >> (q & 7)
        entry = table[offset[who] + (window & mask[who])]
        symbol, n = entry & 65535, entry >> 16
        extra = extra_of[symbol]
        run = least_of[symbol] + (window >> n & (1 << extra) - 1)
        value = np.where(symbol < 16, symbol, np.where(symbol == 16, so_far, 0))
        rows.append(who)
        values.append(value)
        times.append(run)
        p[who] = q + n + extra
        last[who] = np.where(value > 0, value, so_far)
        at[who] += run
        left[who] -= 1
        who = who[(at[who] < room[who]) & (left[who] > 0)]
    if (at > room).any():
        raise FormatError("code lengths run over")
    rows, values, times = (np.concatenate([*x, last]) for x, last in ((rows, np.arange(len(asked))), (values, np.zeros(len(asked), np.int64)), (times, room - at)))
    order = np.argsort(rows, kind="stable")
    whole, ends = np.repeat(values[order], times[order]).astype(np.uint8).tobytes(), np.cumsum(room).tolist()
    for (bits, *_), end in zip(asked, (p - origin).tolist(), strict=True):
        bits.at = end
        if end > 8 * len(bits.data):
            raise FormatError("the image ends too early")
    return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _opened_together(openings: list[Opening]) -> list:
    """What each of the openings returns; many that wait for code lengths get them at once."""

    def answers(asked: list) -> list[bytes]:
        return _read_lengths_together(asked) if len(asked) >= TOGETHER else [_read_lengths(*x) for x in asked]

    return _together(openings, answers)


def _together(workers: list[Generator], answers: Callable[[list], list]) -> list:
    """What each of the workers returns; all that ask at a time are answered at once."""
    out, waiting = [None] * len(workers), [(k, None) for k in range(len(workers))]
    while waiting:
        asked = []
        for k, answer in waiting:
            try:
                asked.append((k, workers[k].send(answer)))
            except StopIteration as end:
                out[k] = end.value
        waiting = list(zip([k for k, _ in asked], answers([x for _, x in asked]), strict=True)) if asked else []
    return out


def _read_codes(bits: BitReader, sizes: tuple[int, ...]) -> Generator:
    """The codes of one group; one that is written like the one before it is that one."""
    out, start = [], 0
    for k, n in enumerate(sizes):
        length = bits.at - start
        if k and n == sizes[k - 1] and bits.at + length <= 8 * len(bits.data) and bits.peek(start, length) == bits.peek(bits.at, length):
            start, bits.at = bits.at, bits.at + length
            out.append(out[-1])
        else:
            start = bits.at
            out.append((yield from _read_code(bits, n)))
    return out


def _prefixed(bits: BitReader, symbol: int) -> int:
    """A length or distance by its prefix symbol and extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = symbol - 2 >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


class Reading:
    """An entropy-coded image whose codes are known, and what has been read of its pixels."""

    def __init__(self, bits: BitReader, groups: list[list[PrefixCode]], which: np.ndarray | None, shift: int, width: int, total: int, cache_bits: int):
        self.bits, self.groups, self.which, self.shift = bits, groups, which, shift
        self.width, self.total, self.cache_bits, self.first = width, total, cache_bits, bits.at
        self.at, self.pixels, self.copies, self.hits, self.hit_slots = 0, None, [], [], []


def _read_image(bits: BitReader, width: int, height: int, main: bool) -> Opening:
    """Entropy-coded pixels, flat: (height * width, 4)."""
    return _read_pixels((yield from _opened(bits, width, height, main)))


def _opened(bits: BitReader, width: int, height: int, main: bool) -> Opening:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise FormatError("the colour cache is too large")
    groups, shift, which = 1, 0, None
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = -(-width >> shift)
        which = yield from _read_image(bits, across, -(-height >> shift), False)
        which = (which[:, 0].astype(int) | which[:, 1].astype(int) << 8).reshape(-1, across)
        groups = int(which.max()) + 1
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    codes = []
    for _ in range(groups):
        codes.append((yield from _read_codes(bits, sizes)))
    return Reading(bits, codes, which, shift, width, width * height, cache_bits)


def _read_pixels(image: Reading) -> np.ndarray:
    bits, codes, which, shift, width, total, cache_bits = image.bits, image.groups, image.which, image.shift, image.width, image.total, image.cache_bits
    groups = len(codes)
    if groups == 1 and (found := _read_at_once(image)) is not None:
        return found
    bits.at = image.first
    pixels, cache = np.zeros((total, 4), np.uint8), {}
    at = 0

    def remember(first: int, n: int) -> None:
        if cache_bits:
            for p in pixels[first : first + n].tolist():
                cache[_slot(p, cache_bits)] = p

    while at < total:
        green, red, blue, alpha, distance = codes[which[at // width >> shift, at % width >> shift] if groups > 1 else 0]
        s = green.read(bits)
        if s < 256:
            pixels[at] = s, red.read(bits), blue.read(bits), alpha.read(bits)
            remember(at, 1)
            at += 1
        elif s < 256 + LENGTH_CODES:
            n = _prefixed(bits, s - 256)
            back = _distance(_prefixed(bits, distance.read(bits)), width)
            if back > at or at + n > total:
                raise FormatError("a back-reference leaves the image")
            for k in range(at, at + n):  # source and copy may overlap
                pixels[k] = pixels[k - back]
            remember(at, n)
            at += n
        else:
            pixels[at] = cache.get(s - 256 - LENGTH_CODES, (0, 0, 0, 0))
            at += 1
    return pixels


def _slot(pixel, cache_bits: int) -> int:
    g, r, b, a = (int(x) for x in pixel)
    return (CACHE_FACTOR * (a << 24 | r << 16 | g << 8 | b) & 0xFFFFFFFF) >> 32 - cache_bits


def _slots(pixels: np.ndarray, cache_bits: int) -> np.ndarray:
    colours = np.ascontiguousarray(pixels).view("<u4").reshape(-1)  # alpha, blue, red and green from the highest byte down
    low = colours & np.uint32(0xFFFF)
    ordered = colours & np.uint32(0xFF000000) | low << np.uint32(8) | colours >> np.uint32(16) & np.uint32(0xFF)
    return (np.uint32(CACHE_FACTOR) * ordered >> np.uint32(32 - cache_bits)).astype(np.int64)


def _distance(code: int, width: int) -> int:
    return code - len(NEAR) if code > len(NEAR) else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)


def _before(keys: np.ndarray) -> np.ndarray:
    """For each place the last one before it that has the same key, or -1."""
    order = np.argsort(keys, kind="stable")
    out = np.full(len(keys), -1, np.int64)
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _walk_together(images: list[Reading]) -> None:
    """Reads images of one group of codes, one pixel or copy of each at a step, until few of them go on."""
    PrefixCode.fill([code for image in images for group in image.groups for code in group[:4]])
    bits_of = [sum(c.entries[0] for c in image.groups[0][:4]) if len(image.groups) == 1 else 0 for image in images]
    images = [image for image, n in zip(images, bits_of, strict=True) if 0 < n <= 56]  # a pixel lies in 64 bits from its first byte
    if len(images) < TOGETHER:
        return
    places, tables, size = {}, [], 0
    for image in images:
        for code in image.groups[0][:4]:
            if id(code) not in places:
                places[id(code)] = size
                tables.append(code.entries[1])
                size += len(tables[-1])
    # length and, 6 bits above it, symbol; that of a copy is raised
    table, at = np.empty(size, np.int64), 0
    for each in tables:
        symbol, part = each & 65535, table[at : at + len(each)]
        part[:] = symbol
        part += COPIED * (symbol - 256 < LENGTH_CODES) * (symbol >= 256)
        part <<= 6
        part |= each >> 16
        at += len(each)
    del tables
    offsets = np.array([[places[id(code)] for code in image.groups[0][:4]] for image in images]).T.copy()
    masks = np.array([[(1 << code.entries[0]) - 1 for code in image.groups[0][:4]] for image in images]).T.copy()
    windows, origin = _windows([image.bits for image in images])
    room = np.array([image.total + STRIDE for image in images])  # images that have ended are read on for a few steps
    begins = np.cumsum(room) - room
    colours, symbols = np.zeros(int(room.sum()), np.uint32), np.zeros(int(room.sum()), np.int16)
    all_p, all_at = origin + [image.bits.at for image in images], begins.copy()
    who, end = np.arange(len(images)), begins + room - STRIDE
    ps, ats = np.empty((2, STRIDE + 1, len(who)), np.int64)
    ps[0], ats[0] = all_p, all_at
    while len(who) >= TOGETHER:
        entries = np.empty((4, STRIDE, len(who)), np.int64)
        (offset, *others), (mask, *other_masks) = offsets, masks
        for step in range(STRIDE):
            p, at, entry = ps[step], ats[step], entries[0, step]
            window = windows.take(p >> 3, mode="clip")
            window >>= p & 7
            table.take((window & mask) + offset, out=entry, mode="clip")
            n, rest = entry & 63, 0
            ahead = n
            for k, further, wide in zip((1, 2, 3), others, other_masks, strict=True):
                window >>= ahead
                each = table.take((window & wide) + further, out=entries[k, step], mode="clip")
                ahead = each & 63
                rest = ahead if k == 1 else rest + ahead
            np.add(p, n + rest * (entry < 256 << 6), out=ps[step + 1])
            np.add(at, 1, out=ats[step + 1])
            for j in np.flatnonzero(entry >= COPIED << 6).tolist():
                if at[j] < end[j]:
                    image, first, start = images[who[j]], int(begins[who[j]]), int(origin[who[j]])
                    image.bits.at = int(ps[step + 1, j]) - start
                    here, n = int(at[j]) - first, _prefixed(image.bits, (int(entry[j]) >> 6) - COPIED - 256)
                    back = _distance(_prefixed(image.bits, image.groups[0][4].read(image.bits)), image.width)
                    if back > here or here + n > image.total:
                        raise FormatError("a back-reference leaves the image")
                    image.copies.append((here, n, back))
                    ps[step + 1, j], ats[step + 1, j] = image.bits.at + start, first + here + n
        entries >>= 6
        where = ats[:-1]
        symbols[where] = entries[0]
        entries &= 255
        colours[where] = entries[0] | entries[1] << 8 | entries[2] << 16 | entries[3] << 24
        ended = np.minimum((ats < end).sum(0), STRIDE)  # the step that comes first after an image's end
        all_p[who], all_at[who] = ps[ended, np.arange(len(who))], np.minimum(ats[-1], end)
        left = np.flatnonzero(ats[-1] < end)
        if len(left) < 0.95 * len(who):
            who, end, offsets, masks = who[left], end[left], offsets[:, left], masks[:, left]
            ps, ats = np.empty((2, STRIDE + 1, len(who)), np.int64)
        ps[0], ats[0] = all_p[who], all_at[who]
    for image, first, at, p in zip(images, begins.tolist(), (all_at - begins).tolist(), (all_p - origin).tolist(), strict=True):
        image.at, image.bits.at = at, p
        if p > 8 * len(image.bits.data):
            raise FormatError("the image ends too early")
        image.pixels = colours[first : first + image.total].view(np.uint8).reshape(-1, 4).copy()
        if image.cache_bits:
            symbol = symbols[first : first + at].astype(np.int64)
            image.hits.append(np.flatnonzero((symbol >= 256 + LENGTH_CODES) & (symbol < COPIED)))
            image.hit_slots.append(symbol[image.hits[0]] - 256 - LENGTH_CODES)


def _read_at_once(image: Reading) -> np.ndarray | None:
    """Pixels of one group of codes that haven't been read yet, and all of them; None if a cache index has no pixel before it."""
    bits, codes, width, total, cache_bits = image.bits, image.groups[0], image.width, image.total, image.cache_bits
    pixels, copies, hits, hit_slots, at = image.pixels, image.copies, image.hits, image.hit_slots, image.at
    if pixels is None:
        pixels = np.zeros((total, 4), np.uint8)
    if at < total:
        data, distance = np.frombuffer(bits.data, np.uint8), codes[4]
        (green_most, green_symbol, green_length), *others = (c.lookup for c in codes[:4])
        steps, green_mask = codes[0].steps, (1 << green_most) - 1
        has_hits = any(codes[0].lengths[256:])
    while at < total:
        origin, start = bits.at >> 3, bits.at & 7
        limit = start + 1 + min(CHUNK, 8 * len(data) - bits.at, 60 * (total - at))
        wide = np.zeros((limit + 64 >> 3) + 4, np.int64)
        raw = data[origin : origin + len(wide)]
        wide[: len(raw)] = raw
        wide = wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16
        window = (wide[:, None] >> np.arange(8)).reshape(-1)
        place = _places()[: len(window)]
        after = place[:limit] + steps.take(window[:limit] & green_mask)
        end, ends = place, {}  # no literal is over 60 bits, so it ends in the window
        for code, (most, _, length) in zip(codes[1:4], others, strict=True):
            if code.only is None:
                if id(code) not in ends:
                    ends[id(code)] = place + length.take(window & (1 << most) - 1)
                end = ends[id(code)] if end is place else ends[id(code)].take(end, mode="clip")
        # where a pixel ends by where it begins: a literal after its last sample, a cache index after its green symbol; a copy isn't under COPY
        literals = after if end is place else end.take(after, mode="clip")
        walk = memoryview(literals if not has_hits else np.where(after < HIT, literals, np.where(after < COPY, after - HIT, after)))
        starts, jumps, p, first, copied = [], [], start, at, 0
        note = starts.append
        if end is place and not green_most and walk[p] < COPY:  # pixels without bits
            starts, limit = [p] * (total - at), p
        while p < limit:
            q = walk[p]
            if q < COPY:
                note(p)
                p = q
                continue
            if (at := first + len(starts) + copied) >= total:
                break
            bits.at = 8 * origin + q - COPY
            n = _prefixed(bits, int(green_symbol[window[p] & green_mask]) - 256)
            back = _distance(_prefixed(bits, distance.read(bits)), width)
            if back > at or at + n > total:
                raise FormatError("a back-reference leaves the image")
            copies.append((at, n, back))
            jumps.append((len(starts), n))
            p, copied = bits.at - 8 * origin, copied + n
        if (over := first + len(starts) + copied - total) > 0:  # what follows the image was taken for pixels
            p = starts[-over]
            del starts[-over:]
        at = first + len(starts) + copied
        bits.at = 8 * origin + p
        if bits.at > 8 * len(data):
            raise FormatError("the image ends too early")
        starts = np.array(starts, np.int64)
        where = np.zeros(len(starts) + 1, np.int64)
        for k, n in jumps:
            where[k] += n
        where = first + np.arange(len(starts)) + np.add.accumulate(where)[:-1]
        at_green = window[starts] & green_mask
        symbol = green_symbol[at_green]
        literal = symbol < 256
        begin, where_literal = (starts + green_length[at_green])[literal], where[literal]
        pixels[where_literal, 0] = symbol[literal]
        for k, (most, found, length) in enumerate(others, 1):
            number = window[begin] & (1 << most) - 1
            pixels[where_literal, k] = found[number]
            begin = begin + length[number]
        if cache_bits:
            hits.append(where[~literal])
            hit_slots.append(symbol[~literal] - 256 - LENGTH_CODES)
    hit = np.concatenate(hits) if hits else np.empty(0, np.int64)
    source, slots = np.arange(total), None
    if len(hit):
        slots = _slots(pixels, cache_bits)
        slots[hit] = np.concatenate(hit_slots)
    for k, n, back in copies:
        here = k - back + (np.arange(n) % back if n > back else np.arange(n))
        if len(hit):
            source[k : k + n], slots[k : k + n] = here, slots[here]
        else:
            pixels[k : k + n] = pixels[here]
    if len(hit):
        source[hit] = _before(slots.astype(np.uint16))[hit]
        if source.min() < 0:
            return None
        while ((further := source[source]) != source).any():
            source = further
        pixels = pixels[source]
    return pixels


# --- transforms ---


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int8).astype(np.int32)


def _spread(blocks: np.ndarray, shift: int, height: int, width: int) -> np.ndarray:
    return blocks.repeat(1 << shift, 0).repeat(1 << shift, 1)[:height, :width]


def _cross(image: np.ndarray, blocks: np.ndarray, shift: int, sign: int) -> np.ndarray:
    """The cross-colour transform (sign -1) and its inverse (sign 1)."""
    height, width, _ = image.shape
    t = _spread(blocks, shift, height, width)
    out, green = image.copy(), _signed(image[..., 0])
    out[..., 1] = (image[..., 1] + sign * (_signed(t[..., 2]) * green >> 5)).astype(np.uint8)
    red = _signed((out if sign > 0 else image)[..., 1])
    out[..., 2] = (image[..., 2] + sign * (_signed(t[..., 0]) * green >> 5) + sign * (_signed(t[..., 1]) * red >> 5)).astype(np.uint8)
    return out


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b >> 1


def _predicted(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """A pixel's prediction by its left, top, top-right and top-left neighbours (int arrays of 4)."""
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _average(_average(left, right), top)
        case 6:
            return _average(left, corner)
        case 7:
            return _average(left, top)
        case 8:
            return _average(corner, top)
        case 9:
            return _average(top, right)
        case 10:
            return _average(_average(left, corner), _average(top, right))
        case 11:
            both = left + top - corner
            return left if np.abs(both - left).sum() < np.abs(both - top).sum() else top
        case 12:
            return np.clip(left + top - corner, 0, 255)
        case 13:
            mean = _average(left, top)
            return np.clip(mean + ((mean - corner) / 2).astype(int), 0, 255)
    return np.array(BLACK)  # mode 0, and the two that aren't assigned


def _predict(image: np.ndarray, blocks: np.ndarray, shift: int, inverse: bool) -> np.ndarray:
    """The predictor transform and its inverse; the inverse reads what it has already restored."""
    modes = blocks[..., 0] & 15
    if (modes == modes.flat[0]).all() and modes.flat[0] in (LEFT, TOP):
        return _predict_one(image, int(modes.flat[0]), inverse)
    return _predict_any(image, blocks, shift, inverse)


def _predict_one(image: np.ndarray, mode: int, inverse: bool) -> np.ndarray:
    """The predictor of left or top neighbours alone, in sums and differences of whole rows or columns."""
    out = image.copy()
    edge, rest = (out[0], 0) if mode == TOP else (out[:, 0], 1)  # the edge goes on by itself
    if inverse:
        edge[0] += np.array(BLACK, np.uint8)
        edge[:] = np.add.accumulate(edge, 0, dtype=np.uint8)
        return np.add.accumulate(out, rest, dtype=np.uint8)
    if mode == TOP:
        out[1:] -= image[:-1]
        out[0, 1:] -= image[0, :-1]
    else:
        out[:, 1:] -= image[:, :-1]
        out[1:, 0] -= image[:-1, 0]
    out[0, 0] -= np.array(BLACK, np.uint8)
    return out


def _predict_any(image: np.ndarray, blocks: np.ndarray, shift: int, inverse: bool) -> np.ndarray:
    height, width, _ = image.shape
    out = np.zeros_like(image)
    whole = (out if inverse else image).reshape(-1, 4)
    given = image.reshape(-1, 4).astype(int)
    result, sign = out.reshape(-1, 4), 1 if inverse else -1
    for y in range(height):
        for x in range(width):
            at = y * width + x
            if not y:
                guess = whole[at - 1].astype(int) if x else np.array(BLACK)
            elif not x:
                guess = whole[at - width].astype(int)
            else:  # the pixel after the row above is the first of this row
                left, top, right, corner = (whole[at - k].astype(int) for k in (1, width, width - 1, width + 1))
                guess = _predicted(int(blocks[y >> shift, x >> shift, 0]) & 15, left, top, right, corner)
            result[at] = (given[at] + sign * guess) & 255
    return out


def _bundle_shift(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _from_palette(image: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    """Colours of palette indices; narrow indices share a green value, lowest bits first."""
    shift = _bundle_shift(len(palette))
    n = 8 >> shift
    index = image[..., :1].astype(int) >> np.arange(0, 8, n) & (1 << n) - 1 if shift else image[..., :1].astype(int)
    index = index.reshape(len(image), -1)[:, :width]
    return np.concatenate([palette, np.zeros((256, 4), np.uint8)])[index]


def size_of(data: bytes) -> tuple[int, int]:
    """Width and height as the first bytes of an image have them."""
    found = int.from_bytes(data[21:25], "little")
    return 1 + (found & MAX_SIDE - 1), 1 + (found >> 14 & MAX_SIDE - 1)


def decode(data: bytes) -> np.ndarray:
    """The pixels of one image, (height, width, 4) in the order green, red, blue, alpha."""
    return decode_all([data])[0]


def decode_all(images: list[bytes]) -> list[np.ndarray]:
    """The pixels of each image; many images take the steps of the longest."""
    begun = _opened_together([_begun(x) for x in images])
    _walk_together([reading for reading, *_ in begun])
    return [_ended(*x) for x in begun]


def _begun(data: bytes) -> Opening:
    """An image up to its pixels, its transforms, height and width."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise FormatError("not a lossless WebP image")
    bits = BitReader(data[20 : 20 + int.from_bytes(data[16:20], "little")])
    if bits.read(8) != 0x2F:
        raise FormatError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise FormatError("unknown version")
    transforms, full = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in {t[0] for t in transforms}:
            raise FormatError("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            across = -(-width >> shift)
            blocks = (yield from _read_image(bits, across, -(-height >> shift), False)).reshape(-1, across, 4)
            transforms.append((kind, blocks, shift))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            palette = np.add.accumulate((yield from _read_image(bits, n, 1, False)), 0, dtype=np.uint8)
            transforms.append((kind, palette, width))
            width = -(-width >> _bundle_shift(n))
        else:
            transforms.append((kind, None, 0))
    return (yield from _opened(bits, width, height, True)), transforms, height, full


def _ended(reading: Reading, transforms: list, height: int, full: int) -> np.ndarray:
    image = _read_pixels(reading).reshape(height, -1, 4)
    for kind, extra, n in reversed(transforms):
        if kind == PREDICTOR:
            image = _predict(image, extra, n, True)
        elif kind == CROSS_COLOUR:
            image = _cross(image, extra, n, 1)
        elif kind == SUBTRACT_GREEN:
            image = image.copy()
            image[..., 1:3] += image[..., :1]
        else:
            image = _from_palette(image, extra, n)
    if image.shape[:2] != (height, full):
        raise FormatError("sizes don't agree")
    return image


# --- encoding ---


def _lengths(counts: dict[int, int], symbols: int, most: int) -> bytes:
    """Code lengths by Huffman's rule, no longer than ``most``."""
    flat = np.zeros(symbols, np.int64)
    flat[list(counts)] = list(counts.values())
    return _lengths_all(flat, np.array([symbols]), most).astype(np.uint8).tobytes()


def _lengths_all(counts: np.ndarray, widths: np.ndarray, most: int) -> np.ndarray:
    """Code lengths by Huffman's rule for many codes; their symbols' counts lie one after the other. Each step joins two nodes of every code."""
    out, used = np.zeros(len(counts), np.int64), np.flatnonzero(counts)
    row, count = np.repeat(np.arange(len(widths)), widths)[used], counts[used]
    while len(used):
        # leaves by code, count and symbol
        order = np.lexsort((count, row))
        used, row, count = used[order], row[order], count[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        leaves = np.diff(first, append=len(row))
        out[used[first[leaves == 1]]] = 1
        by_size = np.argsort(-leaves, kind="stable")  # codes that need most steps come first
        leaves = leaves[by_size]
        rank = np.empty(len(first), np.int64)
        rank[by_size] = np.arange(len(first))
        leaf_row = np.repeat(rank, np.diff(first, append=len(row)))
        wide = int(leaves[0])
        never = 2 * int(counts.sum()) + 1
        # a code's nodes: its leaves by count, a place that is never taken, and joined nodes, which come in order of their counts
        height = 2 * wide + 2
        weight = np.full(len(leaves) * height, never, np.int64)
        leaf_at = leaf_row * height + np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row)))
        weight[leaf_at] = count
        parent = np.zeros(len(weight), np.int64)
        begin = np.arange(len(leaves)) * height
        leaf, inner = begin.copy(), begin + wide + 1
        steps = np.searchsorted(-leaves, -np.arange(1, wide), side="left").tolist()  # codes of more leaves than that
        for k, n in enumerate(steps):
            one, other, new, both = leaf[:n], inner[:n], begin[:n] + (wide + 1 + k), 0
            for _ in (0, 1):
                x, y = weight.take(one), weight.take(other)
                is_leaf = x <= y
                parent[np.where(is_leaf, one, other)] = new
                both = both + np.minimum(x, y)
                one += is_leaf
                other += ~is_leaf
            weight[new] = both
        depth = np.zeros(len(weight), np.int64)
        for k in range(len(steps) - 1, -1, -1):
            n = steps[k]
            below = steps[k + 1] if k + 1 < len(steps) else 0  # these codes' node isn't their root
            node = begin[:below] + (wide + 1 + k)
            depth[node] = depth[parent[node]] + 1
        found = depth[parent[leaf_at]] + 1
        several = leaves[leaf_row] > 1
        out[used[several]] = found[several]
        deep = np.zeros(len(leaves), bool)
        deep[leaf_row[several & (found > most)]] = True
        again = np.flatnonzero(deep[leaf_row])
        again = again[np.argsort(used[again])]
        used, row, count = used[again], row[again], count[again] // 2 + 1
    return out


def _written(lengths: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits (the first one lowest) and sizes by symbol of many codes; an only symbol has none."""
    used = np.flatnonzero(lengths)
    row = np.repeat(np.arange(len(widths)), widths)[used]
    used = used[(np.bincount(row, minlength=len(widths)) > 1)[row]]
    row = np.repeat(np.arange(len(widths)), widths)[used]
    values, sizes = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.int64)
    order = used[np.argsort(row << 4 | lengths[used], kind="stable")]
    sizes[order] = n = lengths[order]
    room = 1 << 15 - n
    values[order] = _turned(15)[np.cumsum(room) - room & (1 << 15) - 1]  # a whole code takes all of the room
    return values, sizes


def _codes(counts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Huffman codes of counts: each symbol's bits and size, and the numbers and sizes that the code itself is written as."""
    widths = np.array([len(x) for x in counts])
    begin = np.cumsum(widths) - widths
    lengths = _lengths_all(np.concatenate(counts), widths, MOST)
    values, sizes = _written(lengths, widths)
    row = np.repeat(np.arange(len(widths)), widths)
    used = np.flatnonzero(lengths)
    number = np.bincount(row[used], minlength=len(widths))
    large = np.bincount(row[used], weights=used - begin[row[used]] > 255, minlength=len(widths)) > 0
    simple = (number <= 2) & ~large
    # one or two symbols
    found = np.zeros((2, len(widths)), np.int64)
    of_simple = used[simple[row[used]]]
    place = np.diff(row[of_simple], prepend=-1) == 0
    found[place.astype(np.int64), row[of_simple]] = of_simple - begin[row[of_simple]]
    heads = (5 | (number == 2) << 1 | found[0] << 3 | found[1] << 11).astype(np.uint64)
    head_sizes = np.where(number == 2, 19, 11)
    tokens, token_sizes, upto = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(widths) + 1, np.int64)
    if not simple.all():
        # runs of equal lengths
        normal = np.flatnonzero(~simple)
        inside = ~simple[row]
        each, of = lengths[inside], row[inside]
        ends = np.flatnonzero(np.append((each[1:] != each[:-1]) | (of[1:] != of[:-1]), True))
        value = each[ends]
        run = np.diff(ends, prepend=-1) + (MOST_SYMBOLS + 1) * (value == 0)
        first, several, known = _runs()
        several = several[run]
        after = np.cumsum(several)
        symbols, extra, n = known[:, np.arange(after[-1]) + np.repeat(first[run] - after + several, several)]
        symbols = np.where(symbols == 15, np.repeat(value, several), symbols)
        of = np.repeat(of[ends], several)
        nth = np.zeros(len(widths), np.int64)
        nth[normal] = np.arange(len(normal))
        at = nth[of] * 19 + symbols
        own_widths = np.full(len(normal), 19)
        own = _lengths_all(np.bincount(at, minlength=19 * len(normal)), own_widths, 7)
        bits, size = (x[at] for x in _written(own, own_widths))
        tokens, token_sizes = bits | extra.astype(np.uint64) << size.astype(np.uint64), size + n
        upto[1:] = np.cumsum(np.bincount(of, minlength=len(widths)))
        # 0, 15 (all 19 lengths follow), the lengths, 0
        ordered = own.reshape(-1, 19)[:, LENGTH_ORDER]
        heads[normal], head_sizes[normal] = (30 + (ordered << 5 + 3 * np.arange(19)).sum(1)).astype(np.uint64), 63
    out = []
    for k, (b, w, x, y) in enumerate(zip(begin.tolist(), widths.tolist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True)):
        out.append((values[b : b + w], sizes[b : b + w], np.append(heads[k], tokens[x:y]), np.append(head_sizes[k], token_sizes[x:y])))
    return out


def _run(value: int, n: int) -> list[tuple[int, int, int]]:
    """How ``n`` equal lengths are written: symbols with extra values and their bits."""
    tokens = []
    if value:
        tokens.append((value, 0, 0))
        n -= 1
    while n >= 3:
        k = min(n, 6 if value else 138)
        if value:
            tokens.append((16, k - 3, 2))
        else:
            tokens.append((18, k - 11, 7) if k > 10 else (17, k - 3, 3))
        n -= k
    return tokens + [(value, 0, 0)] * n


@lru_cache
def _runs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first of its symbols and their number by a run's length, then by that of a run of zeros; and all symbols. A length stands as 15."""
    found = [_run(value, n) for value in (15, 0) for n in range(MOST_SYMBOLS + 1)]
    count = np.array([len(x) for x in found])
    return np.cumsum(count) - count, count, np.array([x for each in found for x in each]).T.copy()


def _prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra value and extra bits of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    extra = (value - 1).bit_length() - 2
    high = value - 1 >> extra
    return 2 * extra + high, value - 1 - (high << extra), extra


def _copies(colours: np.ndarray) -> list[tuple[int, int, int]]:
    """Back-references (place, length, distance) to the last place that four pixels were at."""
    if len(colours) < 8:
        return []
    wide, n = colours.astype(np.uint64), len(colours) - 3
    key = np.zeros(n, np.uint64)
    for k in range(4):
        key = (key ^ wide[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    # keys and places are sorted as one number; keys that agree by chance are found out by their pixels
    low = np.uint64((1 << n.bit_length()) - 1)
    key = np.sort(key & ~low | np.arange(n, dtype=np.uint64))
    order, same = (key & low).astype(np.int64), (key[1:] ^ key[:-1]) <= low
    before, out, at = np.full(n, -1, np.int64), [], 0
    before[order[1:][same]] = order[:-1][same]
    for i in np.flatnonzero(before >= 0).tolist():
        if i < at:
            continue
        b = int(before[i])
        most = min(4096, len(colours) - i)
        apart = colours[i : i + most] != colours[b : b + most]
        same = int(apart.argmax()) if apart.any() else most
        if same >= 4:
            out.append((i, same, i - b))
            at = i + same
    return out


@lru_cache(1)
def _hits(pixels: bytes, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pixels' slots, and which pixels are in the cache when they come; asked for twice by images that have a cache."""
    colours = np.frombuffer(pixels, "<u4")
    slots = _slots(colours.view(np.uint8).reshape(-1, 4), cache_bits)
    before = _before(slots.astype(np.uint16))
    return slots, (before >= 0) & (colours[before] == colours)


def _information(counts: np.ndarray) -> list[float]:
    """Bits of all symbols of each row of counts, by the row's own frequencies."""
    rows = counts.sum(1)
    return (rows * np.log2(np.maximum(rows, 1)) - (counts * np.log2(np.maximum(counts, 1))).sum(1)).tolist()


#: Gives counts of symbols and is sent their codes.
Writing = Generator[list[np.ndarray], list[tuple[np.ndarray, ...]], Any]


def _written_together(writings: list[Writing]) -> list[BitWriter]:
    def answers(asked: list[list[np.ndarray]]) -> list[list]:
        found = iter(_codes([x for counts in asked for x in counts]))
        return [[next(found) for _ in counts] for counts in asked]

    return _together(writings, answers)


def _write_image(out: BitWriter, pixels: np.ndarray, main: bool, cache_bits: int = 0, copies: bool = False) -> Writing:
    """Red, blue and alpha share a code if codes of their own save less than they take, as in most texts."""
    out.write(cache_bits > 0, 1)
    out.write(cache_bits, 4 * (cache_bits > 0))
    if main:
        out.write(0, 1)
    pixels = np.ascontiguousarray(pixels)
    colours = pixels.view("<u4").reshape(-1)
    green, token = pixels[:, 0].astype(np.int64), np.ones(len(pixels), bool)
    literal = token.copy()
    if cache_bits:
        slots, hit = _hits(pixels.tobytes(), cache_bits)
        literal, green = ~hit, np.where(hit, 256 + LENGTH_CODES + slots, green)
    found = _copies(colours) if copies else []
    extra = []
    for at, n, back in found:
        token[at + 1 : at + n] = literal[at : at + n] = False
        length, far = _prefix_of(n), _prefix_of(back + len(NEAR))
        green[at] = 256 + length[0]
        extra.append((*length[1:], *far))
    rest = pixels[literal, 1:].astype(np.int64)
    each = np.stack([np.bincount(rest[:, k], minlength=256) for k in range(3)])
    both = each.sum(0, keepdims=True)
    shared, *own = _information(np.concatenate([both, each]))
    if shared - sum(own) <= 4 * (np.count_nonzero(each) - np.count_nonzero(both)):
        each = both
    first = np.bincount(green[token], minlength=256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0))
    first, *one, last = yield [first, *each, np.bincount([x[2] for x in extra], minlength=DISTANCE_CODES)]
    codes = [first, *(one if len(one) == 3 else 3 * one), last]
    for _, _, numbers, sizes in codes:
        out.many(numbers, sizes)
    (green_bits, green_length), *others, (far_bits, far_length) = (x[:2] for x in codes)
    value, size = green_bits[green], green_length[green].astype(np.uint64)
    at_literal = np.flatnonzero(literal)
    v, w = value[at_literal], size[at_literal]
    for k, (rest_bits, rest_length) in enumerate(others):
        v |= rest_bits[rest[:, k]] << w
        w += rest_length[rest[:, k]].astype(np.uint64)
    value[at_literal], size[at_literal] = v, w
    for (at, _, _), (more, n, far, further, m) in zip(found, extra, strict=True):
        v, w = int(value[at]), int(size[at])
        for x, y in ((more, n), (int(far_bits[far]), int(far_length[far])), (further, m)):
            v, w = v | x << w, w + y
        value[at], size[at] = v, w
    out.many(value[token], size[token].astype(np.int64))


def compress(image: np.ndarray) -> bytes:
    """One image as WebP bytes, by the tools that fit it."""
    return encode(image, fitting(image))


def compress_all(images: list[np.ndarray]) -> list[bytes]:
    """The images as ``compress`` gives them, their bits joined at once."""
    return [_wrapped(x) for x in streams(_written_together([_fitted(image) for image in images]))]


def _fitted(image: np.ndarray) -> Writing:
    return (yield from _writing(image, fitting(image)))


def fitting(image: np.ndarray) -> tuple[str, ...]:
    """The tools that fit an image.

    Few colours are a palette. Otherwise that one of the transforms (subtracting green,
    predicting by the left or the top pixel) is taken that leaves the least entropy, if
    it saves more than its parameters take, and the colour cache if its hits save more
    than its symbols take. Back-references are always tried.
    """
    colours = np.sort(np.ascontiguousarray(image).view("<u4").reshape(-1))
    if 1 + np.count_nonzero(colours[1:] != colours[:-1]) <= min(256, image.size // 16):
        return "palette", "copies"
    green = image.copy()
    green[..., 1:3] -= image[..., :1]
    forms = {(): image, ("green",): green, ("left",): _predict_one(image, LEFT, False), ("top",): _predict_one(image, TOP, False)}
    counts = np.stack([np.bincount(x.reshape(-1), minlength=256) for x in forms.values()])
    bits = dict(zip(forms, _information(counts), strict=True))
    best = min(bits, key=lambda tools: bits[tools] + 80 * len(tools))
    slots, hit = _hits(forms[best].tobytes(), CACHE_BITS)
    saved = np.count_nonzero(hit) * (bits[best] / len(hit) - CACHE_BITS) - 6 * np.count_nonzero(np.bincount(slots[hit]))
    return *best, *(("cache",) if saved > 0 else ()), "copies"


def encode(image: np.ndarray, tools: tuple[str, ...] = (), seed: int = 0) -> bytes:
    """One image as WebP bytes; ``tools``: of palette, predictor, left, top, cross, green, cache, copies.

    ``predictor`` and ``cross`` have block parameters drawn by ``seed``; ``left`` and ``top`` are predictors of one mode.
    """
    return _wrapped(_written_together([_writing(image, tools, seed)])[0].stream())


def _writing(image: np.ndarray, tools: tuple[str, ...] = (), seed: int = 0) -> Writing:
    height, width, _ = image.shape
    out = BitWriter()
    out.write(0x2F, 8)
    out.write(width - 1, 14)
    out.write(height - 1, 14)
    out.write(1, 1)
    out.write(0, 3)
    rng = np.random.default_rng(seed) if {"predictor", "cross"} & {*tools} else None
    for tool in (t for t in ("palette", "predictor", "left", "top", "cross", "green") if t in tools):
        shift = 9 if tool in ("left", "top") else 2
        across, down = -(-image.shape[1] >> shift), -(-height >> shift)
        blocks = np.zeros((down, across, 4), np.uint8) if rng is None else rng.integers(0, 256, (down, across, 4), np.uint8)
        out.write(1, 1)
        if tool == "palette":
            palette, index = np.unique(image.reshape(-1, 4), axis=0, return_inverse=True)
            out.write(PALETTE, 2)
            out.write(len(palette) - 1, 8)
            yield from _write_image(out, np.diff(palette, axis=0, prepend=np.zeros((1, 4), np.uint8)), False)
            shared = _bundle_shift(len(palette))
            index = np.pad(index.reshape(height, width), ((0, 0), (0, -width % (1 << shared)))).reshape(height, -1, 1 << shared)
            image = np.zeros((height, index.shape[1], 4), np.uint8)
            image[..., 0] = (index << np.arange(0, 8, 8 >> shared)).sum(-1) if shared else index[..., 0]
            image[..., 3] = 255
        elif tool != "green":
            if tool == "predictor":
                blocks[..., 0] %= 14
            elif tool != "cross":
                blocks[...] = LEFT if tool == "left" else TOP
            out.write(CROSS_COLOUR if tool == "cross" else PREDICTOR, 2)
            out.write(shift - 2, 3)
            yield from _write_image(out, blocks.reshape(-1, 4), False)
            image = _cross(image, blocks, shift, -1) if tool == "cross" else _predict(image, blocks, shift, False)
        else:
            out.write(SUBTRACT_GREEN, 2)
            image = image.copy()
            image[..., 1:3] -= image[..., :1]
    out.write(0, 1)
    yield from _write_image(out, image.reshape(-1, 4), True, CACHE_BITS if "cache" in tools else 0, "copies" in tools)
    return out


def _wrapped(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) % 2)
    return b"RIFF" + len(body).to_bytes(4, "little") + body
