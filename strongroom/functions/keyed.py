"""Keyed functions as column expressions: HMAC, HKDF subkeys, lookup tokens, sealed names and chunks.

Sealing is AES-256-GCM with an initialisation vector from a keyed hash of the associated data and the plain bytes: equal inputs seal
alike, and two different chunks never share a vector under one key.  Lengths are those of the data model
(12 bytes of vector, 16 of tag); the bytes are not those of another implementation.  Keys are driver-side
bytes; they stand as literals in a plan, so turn event logs off or set spark.sql.redaction.string.regex in sessions that hold
real keys.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

from strongroom.model import NONCE, OVERHEAD


def _hmac(key: bytes, message: Column, bits: int, block: int) -> Column:
    name = "sha256" if bits == 256 else "sha512"
    key = (hashlib.new(name, key).digest() if len(key) > block else key).ljust(block, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), bits))), bits))


def hmac256(key: bytes, message: Column) -> Column:
    return _hmac(key, message, 256, 64)


def hmac512(key: bytes, message: Column) -> Column:
    return _hmac(key, message, 512, 128)


def le64(value: Column) -> Column:
    """Eight bytes, the lowest first."""
    h = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*(F.substring(h, i, 2) for i in range(15, 0, -2))))


def utf8(text: Column) -> Column:
    return F.encode(text, "utf-8")


def hkdf(master: bytes, info: bytes, length: int = 32) -> bytes:
    """HKDF-SHA256 without salt, on the driver."""
    prk = hmac.new(bytes(32), master, hashlib.sha256).digest()
    out, block = b"", b""
    for i in range(1, -(-length // 32) + 1):
        block = hmac.new(prk, block + info + bytes([i]), hashlib.sha256).digest()
        out += block
    return out[:length]


def subkey(master: bytes, purpose: str, file_id: Column, idx: Column) -> Column:
    """HKDF for each row: info is purpose, file id and the index as le64."""
    prk = hmac.new(bytes(32), master, hashlib.sha256).digest()
    return hmac256(prk, F.concat(F.lit(purpose.encode()), utf8(file_id), le64(idx), F.lit(b"\x01")))


class NameKey:
    """Keys for names: lookup tokens and deterministic sealing."""

    def __init__(self, master: bytes):
        material = hkdf(master, b"names", 128)
        self.seal_key, self.iv_key, self.aad_key, self.lookup_key = (material[k : k + 32] for k in range(0, 128, 32))

    def lookup(self, name: Column) -> Column:
        """A token that stands for the name: equal names have equal tokens, so lookups are equi-joins and push down."""
        return F.lower(F.hex(hmac256(self.lookup_key, utf8(name))))

    def lookup_value(self, name: str) -> str:
        return hmac.new(self.lookup_key, name.encode(), hashlib.sha256).hexdigest()

    def seal(self, name: Column, context: Column) -> Column:
        aad = hmac256(self.aad_key, utf8(context))
        iv = F.substring(hmac256(self.iv_key, F.concat(aad, utf8(name))), 1, NONCE)
        return F.aes_encrypt(utf8(name), F.lit(self.seal_key), F.lit("GCM"), F.lit("DEFAULT"), iv, aad)

    def open(self, sealed: Column, context: Column) -> Column:
        """The name, or null if the bytes are too short, changed, or sealed for another context."""
        aad = hmac256(self.aad_key, utf8(context))
        return F.when(F.octet_length(sealed) >= OVERHEAD, F.try_validate_utf8(F.decode(F.try_aes_decrypt(sealed, F.lit(self.seal_key), F.lit("GCM"), F.lit("DEFAULT"), aad), "utf-8")))


class ContentKey:
    """Keys for chunks, which are bound to their file, index and version."""

    def __init__(self, master: bytes):
        material = hkdf(master, b"content", 64)
        self.seal_key, self.iv_key = material[:32], material[32:]

    def _aad(self, file_id: Column, idx: Column, version: Column) -> Column:
        return F.concat(utf8(file_id), le64(idx), le64(version))

    def seal(self, plain: Column, file_id: Column, idx: Column, version: Column) -> Column:
        aad = self._aad(file_id, idx, version)
        iv = F.substring(hmac256(self.iv_key, F.concat(aad, plain)), 1, NONCE)
        return F.aes_encrypt(plain, F.lit(self.seal_key), F.lit("GCM"), F.lit("DEFAULT"), iv, aad)

    def open(self, sealed: Column, file_id: Column, idx: Column, version: Column) -> Column:
        """The plain bytes, or null if anything doesn't fit."""
        opened = F.try_aes_decrypt(sealed, F.lit(self.seal_key), F.lit("GCM"), F.lit("DEFAULT"), self._aad(file_id, idx, version))
        return F.when(F.octet_length(sealed) >= OVERHEAD, opened)
