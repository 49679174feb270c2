"""Plain and arithmetic bit coding, both ways."""

from __future__ import annotations


class BitstreamError(ValueError):
    """A frame that can't be decoded; `kind` names the reason."""

    def __init__(self, kind: str):
        super().__init__(kind)
        self.kind = kind


class BitReader:
    """Most significant bit first; past the end zeros are read."""

    def __init__(self, data: bytes):
        self.number, self.size, self.at = int.from_bytes(data[:4096], "big"), 8 * min(len(data), 4096), 0

    def f(self, n: int) -> int:
        self.at += n
        if self.at <= self.size:
            return (self.number >> (self.size - self.at)) & ((1 << n) - 1)
        return (self.number << (self.at - self.size)) & ((1 << n) - 1)

    def s(self, n: int) -> int:
        """Magnitude, then sign."""
        value = self.f(n)
        return -value if self.f(1) else value

    def flag(self) -> bool:
        return bool(self.f(1))

    def bytes_read(self) -> int:
        return (self.at + 7) // 8


class BitWriter:
    def __init__(self):
        self.number, self.size = 0, 0

    def f(self, value: int, n: int) -> BitWriter:
        self.number, self.size = self.number << n | value & ((1 << n) - 1), self.size + n
        return self

    def s(self, value: int, n: int) -> BitWriter:
        return self.f(abs(value), n).f(int(value < 0), 1)

    def done(self) -> bytes:
        pad = -self.size % 8
        return (self.number << pad).to_bytes((self.size + pad) // 8, "big")


#: Places by which a range of up to 8 bits is moved to reach 128.
_MOVE = [8 - r.bit_length() if r else 0 for r in range(256)]


class BoolDecoder:
    """The arithmetic decoder. `value` holds `spare` bits that the range doesn't see yet."""

    def __init__(self, data: bytes):
        if not data:
            raise BitstreamError("EmptyBuffer")
        self.data, self.next = data, 1
        self.value, self.spare, self.range, self.used = data[0], 0, 255, 8
        if self.read(128):
            raise BitstreamError("InvalidMarker")

    def read(self, p: int) -> int:
        split = 1 + (((self.range - 1) * p) >> 8)
        edge = split << self.spare
        if self.value >= edge:
            self.value -= edge
            r, bit = self.range - split, 1
        else:
            r, bit = split, 0
        if r < 128:
            n = _MOVE[r]
            r <<= n
            self.used += n
            self.spare -= n
            if self.spare < 0:
                more = self.data[self.next : self.next + 6]
                self.next += 6
                self.value = (self.value << 48) | int.from_bytes(more.ljust(6, b"\0"), "big")
                self.spare += 48
        self.range = r
        return bit

    def literal(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | self.read(128)
        return value

    def tree(self, tree, probs) -> int:
        at = 0
        while True:
            at = tree[at + self.read(probs[at >> 1])]
            if at <= 0:
                return -at

    def slack(self) -> tuple[int, int]:
        """Bits read past the end, and bits left over."""
        total = 8 * len(self.data)
        return max(0, self.used - total), max(0, total - self.used)


class BoolEncoder:
    """The inverse of BoolDecoder, on exact integers."""

    def __init__(self):
        self.low, self.range, self.moved = 0, 255, 0
        self.write(0, 128)

    def write(self, bit: int, p: int) -> None:
        split = 1 + (((self.range - 1) * p) >> 8)
        if bit:
            self.low += split
            self.range -= split
        else:
            self.range = split
        n = _MOVE[self.range]
        self.range <<= n
        self.low <<= n
        self.moved += n

    def literal(self, value: int, n: int) -> None:
        for i in reversed(range(n)):
            self.write(value >> i & 1, 128)

    def tree(self, tree, probs, leaf: int) -> None:
        def path(at: int) -> list[tuple[int, int]] | None:
            for bit in (0, 1):
                following = tree[at + bit]
                if following <= 0:
                    if -following == leaf:
                        return [(bit, at)]
                elif (rest := path(following)) is not None:
                    return [(bit, at), *rest]
            return None

        for bit, at in path(0):
            self.write(bit, probs[at >> 1])

    def done(self) -> bytes:
        size = 8 + self.moved
        pad = -size % 8
        return (self.low << pad).to_bytes((size + pad) // 8, "big")
