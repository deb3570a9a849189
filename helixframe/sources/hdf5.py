"""The part of the public HDF5 file format that h5ad count matrices use: version 0 and 1 superblocks, groups of symbol tables,
one-dimensional numbers stored compactly, contiguously or in chunks, with the deflate and shuffle filters.

``File`` reads slices of datasets by seeking, wherever pyarrow can open the path. ``encode`` writes files of this form.
Files of the "latest" form (version 2 superblocks and object headers) are refused by name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = 2**64 - 1
#: Message types and filters of the format.
SPACE, TYPE, LAYOUT, FILTERS, MORE, TABLE = 0x1, 0x3, 0x8, 0xB, 0x10, 0x11
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3


def local(path: str) -> str | None:
    """The path on this machine's file system; None if it lies elsewhere."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def opened(path: str):
    if local(path):
        return open(local(path), "rb")
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


class File:
    """Datasets of an open file by path, such as ``X/indptr``."""

    def __init__(self, path: str) -> None:
        self.raw = opened(path)
        head = self.at(0, 96)
        if head[:8] != SIGNATURE:
            raise ValueError(f"{path} is no HDF5 file")
        if head[8] > 1:
            raise NotImplementedError(f"{path} has a superblock of version {head[8]}; rewrite it with the earliest format")
        if head[13:15] != b"\x08\x08":
            raise NotImplementedError("offsets and lengths have 8 bytes")
        self.root = struct.unpack("<Q", self.at(64 + 4 * (head[8] == 1), 8))[0]

    def __enter__(self) -> File:
        return self

    def __exit__(self, *_) -> None:
        self.raw.close()

    def at(self, where: int, size: int) -> bytes:
        self.raw.seek(where)
        return self.raw.read(size)

    def messages(self, header: int) -> dict[int, bytes]:
        """Type and body of an object's messages."""
        version, _, n, _, size = struct.unpack("<BBHII", self.at(header, 12))
        if version != 1:
            raise NotImplementedError("object headers of version 1 only; rewrite the file with the earliest format")
        blocks, out = [(header + 16, size)], {}
        while blocks and n > 0:
            where, size = blocks.pop(0)
            body, i = self.at(where, size), 0
            while i + 8 <= len(body) and n > 0:
                kind, length = struct.unpack("<HH", body[i : i + 4])
                said = body[i + 8 : i + 8 + length]
                if kind == MORE:
                    blocks.append(struct.unpack("<QQ", said[:16]))
                else:
                    out.setdefault(kind, said)
                i += 8 + length
                n -= 1
        return out

    def members(self, header: int) -> dict[str, int]:
        """Names and object headers of a group."""
        said = self.messages(header).get(TABLE)
        if said is None:
            raise KeyError("not a group of the earliest format")
        tree, heap = struct.unpack("<QQ", said[:16])
        data = struct.unpack("<Q", self.at(heap + 24, 8))[0]
        size = struct.unpack("<Q", self.at(heap + 8, 8))[0]
        names, out = self.at(data, size), {}
        for node in self.leaves(tree, 0, 8):
            _, _, n = struct.unpack("<BBH", self.at(node[1] + 4, 4))
            entries = self.at(node[1] + 8, 40 * n)
            for i in range(n):
                offset, where = struct.unpack("<QQ", entries[40 * i : 40 * i + 16])
                out[names[offset : names.index(b"\0", offset)].decode()] = where
        return out

    def leaves(self, node: int, kind: int, key: int) -> Iterator[tuple[bytes, int]]:
        """Key and address of what a tree's lowest nodes point to."""
        if node == NOWHERE:
            return
        head = self.at(node, 24)
        if head[:4] != b"TREE" or head[4] != kind:
            raise ValueError("a broken tree")
        level, n = head[5], struct.unpack("<H", head[6:8])[0]
        body = self.at(node + 24, n * (key + 8))
        for i in range(n):
            own = body[i * (key + 8) : i * (key + 8) + key]
            child = struct.unpack("<Q", body[i * (key + 8) + key : (i + 1) * (key + 8)])[0]
            if level:
                yield from self.leaves(child, kind, key)
            else:
                yield own, child

    def __getitem__(self, path: str) -> Dataset:
        where = self.root
        for name in path.strip("/").split("/"):
            where = self.members(where)[name]
        return Dataset(self, self.messages(where))


class Dataset:
    """One-dimensional numbers; len and slices."""

    def __init__(self, file: File, messages: dict[int, bytes]) -> None:
        self.file = file
        space, kind, layout = messages[SPACE], messages[TYPE], messages[LAYOUT]
        rank, first = space[1], 8 if space[0] == 1 else 4
        if rank != 1:
            raise NotImplementedError("datasets of one dimension only")
        self.size = struct.unpack("<Q", space[first : first + 8])[0]
        size, order = struct.unpack("<I", kind[4:8])[0], "<>"[kind[1] & 1]
        if kind[0] & 15 > 1:
            raise NotImplementedError("numbers only")
        letter = "f" if kind[0] & 15 else "i" if kind[1] & 8 else "u"
        self.dtype = np.dtype(f"{order}{letter}{size}")
        if layout[0] != 3:
            raise NotImplementedError("layouts of version 3 only")
        self.form, self.filters, self.chunks = layout[1], _filters(messages.get(FILTERS)), None
        if self.form == 0:
            self.data = layout[4 : 4 + struct.unpack("<H", layout[2:4])[0]]
        elif self.form == 1:
            self.where = struct.unpack("<Q", layout[2:10])[0]
        else:
            tree, self.chunk = struct.unpack("<QI", layout[3:15])
            found = ((struct.unpack("<IIQ", key[:16]), child) for key, child in file.leaves(tree, 1, 24))
            self.chunks = sorted((offset, where, stored, mask) for (stored, mask, offset), where in found)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> np.ndarray:
        a, b, step = part.indices(self.size)
        b, wide = max(a, b), self.dtype.itemsize
        if step != 1:
            raise ValueError("slices go one by one")
        if self.form == 0:
            return np.frombuffer(self.data[a * wide : b * wide], self.dtype)
        if self.form == 1:
            return np.frombuffer(self.file.at(self.where + a * wide, (b - a) * wide), self.dtype) if b > a and self.where != NOWHERE else np.zeros(b - a, self.dtype)
        out = np.zeros(b - a, self.dtype)
        for offset, where, stored, mask in self.chunks:
            lo, hi = max(a, offset), min(b, offset + self.chunk)
            if lo < hi:
                x = np.frombuffer(self._plain(self.file.at(where, stored), mask), self.dtype)
                out[lo - a : hi - a] = x[lo - offset : hi - offset]
        return out

    def _plain(self, raw: bytes, mask: int) -> bytes:
        for i in range(len(self.filters) - 1, -1, -1):
            if mask >> i & 1:
                continue
            kind = self.filters[i]
            if kind == DEFLATE:
                raw = zlib.decompress(raw)
            elif kind == SHUFFLE:
                raw = np.frombuffer(raw, np.uint8).reshape(self.dtype.itemsize, -1).T.tobytes()
            elif kind == CHECKSUM:
                raw = raw[:-4]
            else:
                raise NotImplementedError(f"filter {kind}")
        return raw


def _filters(said: bytes | None) -> list[int]:
    if said is None:
        return []
    i, out = 8 if said[0] == 1 else 2, []
    for _ in range(said[1]):
        kind = struct.unpack("<H", said[i : i + 2])[0]
        named = said[0] == 1 or kind >= 256
        name = struct.unpack("<H", said[i + 2 : i + 4])[0] if named else 0
        i += 4 if named else 2
        n = struct.unpack("<H", said[i + 2 : i + 4])[0]
        i += 4 + (-(-name // 8) * 8 if said[0] == 1 else name) + 4 * (n + (n % 2 if said[0] == 1 else 0))
        out.append(kind)
    return out


def encode(tree: dict, chunk: int | None = None) -> bytes:
    """A file of nested dicts of one-dimensional numpy arrays; in shuffled, deflated chunks of that many numbers, or contiguous."""
    out = bytearray(96)

    def put(raw: bytes) -> int:
        out.extend(b"\0" * (-len(out) % 8))
        at = len(out)
        out.extend(raw)
        return at

    def header(*messages: tuple[int, bytes]) -> int:
        body = b"".join(struct.pack("<HHBBBB", kind, len(x) + -len(x) % 8, 0, 0, 0, 0) + x + b"\0" * (-len(x) % 8) for kind, x in messages)
        return put(struct.pack("<BBHIII", 1, 0, len(messages), 1, len(body), 0) + body)

    def dataset(x: np.ndarray) -> int:
        x = np.ascontiguousarray(x)
        wide = x.dtype.itemsize
        if x.dtype.kind == "f":
            sign, exponent, bits, bias = (31, 23, 8, 127) if wide == 4 else (63, 52, 11, 1023)
            kind = struct.pack("<BBBBI", 0x11, 0x20, sign, 0, wide) + struct.pack("<HHBBBBI", 0, wide * 8, exponent, bits, 0, exponent, bias)
        else:
            kind = struct.pack("<BBBBIHH", 0x10, 8 * (x.dtype.kind == "i"), 0, 0, wide, 0, wide * 8)
        space = struct.pack("<BBBBIQ", 1, 1, 0, 0, 0, len(x))
        if chunk is None:
            return header((SPACE, space), (TYPE, kind), (LAYOUT, struct.pack("<BBQQ", 3, 1, put(x.tobytes()) if len(x) else NOWHERE, x.nbytes)))
        keys = []
        for a in range(0, len(x), chunk):
            part = np.zeros(chunk, x.dtype)
            part[: len(x[a : a + chunk])] = x[a : a + chunk]
            raw = zlib.compress(part.view(np.uint8).reshape(-1, wide).T.tobytes())
            keys.append((struct.pack("<IIQQ", len(raw), 0, a, 0), put(raw)))
        end, level = struct.pack("<IIQQ", 0, 0, len(x), 0), 0
        while True:  # nodes of at most 64 children, level by level
            up = []
            for i in range(0, max(1, len(keys)), 64):
                some = keys[i : i + 64]
                body = b"".join(k + struct.pack("<Q", child) for k, child in some) + (keys[i + 64][0] if i + 64 < len(keys) else end)
                at = put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(some), NOWHERE, NOWHERE) + body.ljust(24 * 65 + 8 * 64, b"\0"))
                up.append((some[0][0] if some else end, at))
            keys, level = up, level + 1
            if len(keys) == 1:
                break
        pipe = struct.pack("<BBHI", 1, 2, 0, 0) + struct.pack("<HHHHII", SHUFFLE, 0, 1, 1, wide, 0) + struct.pack("<HHHHII", DEFLATE, 0, 1, 1, 6, 0)
        return header((SPACE, space), (TYPE, kind), (LAYOUT, struct.pack("<BBBQII", 3, 2, 2, keys[0][1], chunk, wide)), (FILTERS, pipe))

    def group(members: dict) -> tuple[int, int, int]:
        placed = {name: (group(x)[0] if isinstance(x, dict) else dataset(x)) for name, x in sorted(members.items())}
        if len(placed) > 8:
            raise ValueError("at most 8 members of a group")
        names, offsets = bytearray(8), []
        for name in placed:
            offsets.append(len(names))
            names += name.encode() + b"\0" * (8 - len(name.encode()) % 8)
        heap = put(b"HEAP" + struct.pack("<BBBBQQQ", 0, 0, 0, 0, len(names), NOWHERE, 0))
        data = put(bytes(names))
        out[heap + 24 : heap + 32] = struct.pack("<Q", data)
        entries = b"".join(struct.pack("<QQIIQQ", o, where, 0, 0, 0, 0) for o, where in zip(offsets, placed.values(), strict=True))
        leaf = put(b"SNOD" + struct.pack("<BBH", 1, 0, len(placed)) + entries.ljust(8 * 40, b"\0"))
        node = put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NOWHERE, NOWHERE) + struct.pack("<QQQ", 0, leaf, offsets[-1] if offsets else 0).ljust(33 * 8 + 32 * 8, b"\0"))
        return header((TABLE, struct.pack("<QQ", node, heap))), node, heap

    root, node, heap = group(tree)
    out[:96] = SIGNATURE + struct.pack("<BBBBBBBBHHIQQQQ", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0, 0, NOWHERE, len(out), NOWHERE) + struct.pack("<QQIIQQ", 0, root, 1, 0, node, heap)
    return bytes(out)
