"""Binary forms of keys, clocks, envelopes, collections and vectors, for exchange with other systems.

Inside the engine these are plain columns; the codecs are for reading and writing foreign records.
All raise ``ValueError`` on short, long or unknown input.
"""

from __future__ import annotations

import struct

MAX_SEQ = (1 << 64) - 1


def encode_internal_key(user_key: bytes, seq: int) -> bytes:
    """The user key, then the inverted sequence, so that bytes sort by key and newest first."""
    return user_key + struct.pack(">Q", MAX_SEQ - seq)


def decode_internal_key(key: bytes) -> tuple[bytes, int]:
    if len(key) < 8:
        raise ValueError("internal key too short")
    return key[:-8], MAX_SEQ - struct.unpack(">Q", key[-8:])[0]


def prefix_successor(prefix: bytes) -> bytes | None:
    """The smallest key after all keys with this prefix; None if there is none (no bound)."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def encode_clock(wall: int, logical: int, node: str) -> bytes:
    raw = node.encode()
    return struct.pack(">qIH", wall, logical, len(raw)) + raw


def decode_clock(data: bytes) -> tuple[tuple[int, int, str], int]:
    """The clock and the number of bytes it took."""
    if len(data) < 14:
        raise ValueError("clock too short")
    wall, logical, n = struct.unpack(">qIH", data[:14])
    if len(data) < 14 + n:
        raise ValueError("clock too short")
    return (wall, logical, data[14 : 14 + n].decode()), 14 + n


ENVELOPE_VERSION = 1


def encode_envelope(clock: tuple[int, int, str], deleted: bool, value: bytes) -> bytes:
    return bytes([ENVELOPE_VERSION, int(deleted)]) + encode_clock(*clock) + (b"" if deleted else value)


def decode_envelope(data: bytes) -> tuple[tuple[int, int, str], bool, bytes]:
    if len(data) < 2 or data[0] != ENVELOPE_VERSION:
        raise ValueError("unknown envelope version")
    clock, n = decode_clock(data[2:])
    return clock, bool(data[1]), data[2 + n :]


COLLECTION_VERSION = 1


def encode_collection(dim: int, metric: int, m: int, ef_construct: int, ef_search: int, max_vectors: int) -> bytes:
    """18 bytes: version u8, dim u16, metric u8, three widths u16, limit u64 (little-endian)."""
    return struct.pack("<BHBHHHQ", COLLECTION_VERSION, dim, metric, m, ef_construct, ef_search, max_vectors)


def decode_collection(data: bytes) -> tuple[int, int, int, int, int, int]:
    if len(data) < 18 or data[0] != COLLECTION_VERSION:
        raise ValueError("not a collection record of 18 bytes and a known version")
    return struct.unpack("<BHBHHHQ", data[:18])[1:]


#: First byte of the keys of vectors and collections; kinds of such keys, after the collection's name.
VECTOR_PREFIX, CONFIG_KIND, ENTRY_KIND = 2, 0, 1


def vector_key(collection: str, id: bytes | None = None) -> bytes:
    """The key of a collection's settings, or of one of its vectors (16 bytes of id)."""
    raw = collection.encode()
    if id is not None and len(id) != 16:
        raise ValueError("an id has 16 bytes")
    return struct.pack("<BH", VECTOR_PREFIX, len(raw)) + raw + (bytes([CONFIG_KIND]) if id is None else bytes([ENTRY_KIND]) + id)


def vector_key_bounds(collection: str) -> tuple[bytes, bytes]:
    """First key of a collection's vectors and the first key after them."""
    start = vector_key(collection)[:-1]
    return start + bytes([ENTRY_KIND]), start + bytes([ENTRY_KIND + 1])


def read_vector_key(key: bytes) -> tuple[str, bytes | None]:
    if len(key) < 4 or key[0] != VECTOR_PREFIX:
        raise ValueError("not a vector key")
    n = 3 + struct.unpack("<H", key[1:3])[0]
    if n + 1 > len(key) or key[n] not in (CONFIG_KIND, ENTRY_KIND) or (key[n] == ENTRY_KIND and n + 17 > len(key)):
        raise ValueError("damaged vector key")
    return key[3:n].decode(), key[n + 1 : n + 17] if key[n] == ENTRY_KIND else None


#: First byte of a hint's value where it carries a vector operation; any other value is a plain write.
HINT_KINDS = {0xF1: "vector_write", 0xF2: "vector_delete"}


def read_hint_value(value: bytes) -> tuple[str, bytes]:
    """The kind of a hint (write, vector_write, vector_delete) and what it carries."""
    if value[:1] and value[0] in HINT_KINDS:
        return HINT_KINDS[value[0]], value[1:]
    return "write", value


def hint_key(target: str, wall: int, logical: int, key: bytes) -> bytes:
    """Hints of a target sort by clock: its length u16, the target, wall u64, logical u32 (big-endian), the key."""
    raw = target.encode()
    return struct.pack(">H", len(raw)) + raw + struct.pack(">QI", wall, logical) + key


def read_hint_key(data: bytes) -> tuple[str, int, int, bytes]:
    try:
        n = 2 + struct.unpack_from(">H", data)[0]
        wall, logical = struct.unpack_from(">QI", data, n)
    except struct.error as e:
        raise ValueError("damaged hint key") from e
    return data[2:n].decode(), wall, logical, data[n + 12 :]


VECTOR_VERSION = 2
_TAGS: dict[int, type] = {1: str, 2: int, 3: float, 4: bool, 5: bytes}


def encode_vector(vector: list[float], meta: dict, wall: int = 0, logical: int = 0) -> bytes:
    """Version, clock, components as float32 and the metadata's typed fields in name order."""
    out = [struct.pack(">BqI", VECTOR_VERSION, wall, logical), struct.pack(f"<H{len(vector)}f", len(vector), *vector), struct.pack("<H", len(meta))]
    for name in sorted(meta):
        value = meta[name]
        tag = next((t for t, kind in _TAGS.items() if type(value) is kind), None)
        if tag is None:
            raise ValueError(f"metadata type {type(value).__name__}")
        body = {1: lambda v: v.encode(), 2: lambda v: struct.pack("<q", v), 3: lambda v: struct.pack("<d", v), 4: lambda v: bytes([v]), 5: bytes}[tag](value)
        raw = name.encode()
        if len(body) > 0xFFFF or len(raw) > 0xFFFF:
            raise ValueError("names and values of metadata have 65,535 bytes at most")
        out.append(struct.pack("<H", len(raw)) + raw + struct.pack("<BH", tag, len(body)) + body)
    return b"".join(out)


def decode_vector(data: bytes) -> tuple[list[float], dict, int, int]:
    try:
        wall = logical = 0
        at = 1
        if data[:1] == bytes([VECTOR_VERSION]):
            wall, logical = struct.unpack_from(">qI", data, 1)
            at = 13
        elif data[:1] != b"\x01":  # the first version has no clock
            raise ValueError("unknown vector version")
        (n,) = struct.unpack_from("<H", data, at)
        vector = list(struct.unpack_from(f"<{n}f", data, at + 2))
        at += 2 + 4 * n
        (fields,) = struct.unpack_from("<H", data, at)
        at, meta = at + 2, {}
        for _ in range(fields):
            (k,) = struct.unpack_from("<H", data, at)
            name = data[at + 2 : at + 2 + k].decode()
            tag, size = struct.unpack_from("<BH", data, at + 2 + k)
            at += 5 + k
            body = data[at : at + size]
            if len(body) != size or size != {2: 8, 3: 8, 4: 1}.get(tag, size):
                raise ValueError("vector record too short")
            meta[name] = {1: lambda b: b.decode(), 2: lambda b: struct.unpack("<q", b)[0], 3: lambda b: struct.unpack("<d", b)[0], 4: lambda b: bool(b[0]), 5: bytes}[tag](body)
            at += size
    except (struct.error, KeyError, IndexError) as e:
        raise ValueError("damaged vector record") from e
    return vector, meta, wall, logical
