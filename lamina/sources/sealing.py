"""Encrypted container files: sealing a plain file, and opening one with its session key."""

from __future__ import annotations

import struct
from collections.abc import Callable

from ..functions.keys import recover, seal, unseal
from . import format as X
from .codec import Fault


def seal_file(data: bytes, auth: X.Auth, key: bytes, nonce: Callable[[int], bytes]) -> bytes:
    """The file with an AUTH chunk after META and PROF and all content sealed; previews and extensions stay clear."""
    h = X.parse_header(data)
    chunks = X.parse_directory(data, h)
    place = max(i for i, c in enumerate(chunks) if c.kind in ("META", "PROF", "HEAD")) + 1
    chunks.insert(place, X.plain_chunk("AUTH", auth.to_bytes()))
    for i, c in enumerate(chunks):
        if c.kind == "LTBL":
            layers, entries = X.parse_table(c.payload)
            for e in entries:
                e.first_lrov += e.first_lrov >= place
                e.first_layr += e.first_layr >= place
            c.payload = X.table_bytes(entries, layers)
        if c.kind in X.CONTENT:
            layer = c.kind == "LAYR"
            clear = 4 if layer else 0
            c.payload = c.payload[:clear] + seal(auth.cipher, key, nonce(i), c.payload[clear:], c.kind, i if layer else 0)
            c.compressed, c.flags = len(c.payload), c.flags | X.SEALED
    return X.assemble(chunks, h.flags | X.ENCRYPTED)


def open_chunk(c: X.Chunk, cipher: str, key: bytes) -> bytes:
    """A sealed chunk's payload; a unit that opens only under index 0 is bound to another place."""
    layer = c.kind == "LAYR"
    head, unit = (c.payload[:4], c.payload[4:]) if layer else (b"", c.payload)
    plain = unseal(cipher, key, unit, c.kind, c.index if layer else 0)
    if plain is None:
        moved = layer and unseal(cipher, key, unit, c.kind, 0) is not None
        raise Fault("crypt.unit_index_binding" if moved else "crypt.tag_verify", f"{c.kind} at {c.index}")
    return head + plain


def session_key(data: bytes, label: bytes, password: str | None = None, secret: bytes | None = None) -> tuple[str, bytes]:
    """The cipher and the session key of a file."""
    found = [c for c in X.parse_directory(data, X.parse_header(data)) if c.offset and c.kind == "AUTH"]
    if not found:
        raise Fault("crypt.no_key", "the file has no AUTH chunk")
    auth = X.Auth.parse(found[0].payload)
    key, check = recover((auth.password if auth.mode & 1 else b"", auth.recipients() if auth.mode & 2 else []), label, password, secret)
    if key is None:
        raise Fault(check)
    return auth.cipher, key


def open_file(data: bytes, cipher: str, key: bytes) -> bytes:
    """The file as a plain one: content opened, the AUTH descriptor null, so that all directory indexes stay."""
    h = X.parse_header(data)
    chunks = X.parse_directory(data, h)
    for c in chunks:
        if c.flags & X.SEALED and c.offset:
            c.payload = open_chunk(c, cipher, key)
            c.flags &= ~X.SEALED
            c.compressed = len(c.payload) if c.kind in (*X.COMPRESSED, "LAYR") else 0
    body = X.assemble([c for c in chunks], h.flags & ~X.ENCRYPTED)
    at = X.parse_header(body).dir_offset
    for i, c in enumerate(chunks):
        if c.kind == "AUTH" or not c.offset:
            body = body[: at + 32 * i + 4] + struct.pack("<Q", 0) + body[at + 32 * i + 12 :]
    body = body[:-8]
    return body + X.TRAILER + struct.pack("<I", X.crc32c(body))
