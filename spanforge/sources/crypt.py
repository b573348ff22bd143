"""Decryption of PDF: the standard security handler, revisions 2 to 6, with RC4 and AES."""

from __future__ import annotations

import hashlib

import numpy as np

# Fixed value: the padding string of the standard security handler.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s = list(range(256))
    j = 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, b in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[k] = b ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out & 255


def _sbox() -> tuple[bytes, bytes]:
    """Built from inverses in the field of 256 elements, as the standard defines it."""
    inverse = [0] * 256
    for x in range(1, 256):
        if not inverse[x]:
            y = next(y for y in range(1, 256) if _times(x, y) == 1)
            inverse[x], inverse[y] = y, x
    box, back = bytearray(256), bytearray(256)
    for x in range(256):
        b = inverse[x]
        r = b
        for k in range(1, 5):
            r ^= ((b << k) | (b >> (8 - k))) & 255
        box[x] = r ^ 0x63
        back[box[x]] = x
    return bytes(box), bytes(back)


_BOX, _BACK = _sbox()
_M = {k: bytes(_times(x, k) for x in range(256)) for k in (2, 3, 9, 11, 13, 14)}
_BACK_TABLE = np.frombuffer(bytes(_BACK), np.uint8)
_M_TABLE = {k: np.frombuffer(v, np.uint8) for k, v in _M.items()}
_UNSHIFT = np.array([(i - 4 * (i % 4)) % 16 for i in range(16)])


class Aes:
    """AES on single blocks, and its CBC mode."""

    def __init__(self, key: bytes):
        words = [list(key[i : i + 4]) for i in range(0, len(key), 4)]
        n, rcon = len(words), 1
        self.rounds = n + 6
        for i in range(n, 4 * (self.rounds + 1)):
            w = list(words[i - 1])
            if i % n == 0:
                w = [_BOX[x] for x in w[1:] + w[:1]]
                w[0] ^= rcon
                rcon = _times(rcon, 2)
            elif n > 6 and i % n == 4:
                w = [_BOX[x] for x in w]
            words.append([a ^ b for a, b in zip(words[i - n], w)])
        self.keys = [bytes(sum(words[4 * r : 4 * r + 4], [])) for r in range(self.rounds + 1)]

    def encrypt(self, block: bytes) -> bytes:
        s = [a ^ b for a, b in zip(block, self.keys[0])]
        for r in range(1, self.rounds + 1):
            s = [_BOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
            if r < self.rounds:
                m2, m3, t = _M[2], _M[3], []
                for c in range(0, 16, 4):
                    a, b, d, e = s[c : c + 4]
                    t += [m2[a] ^ m3[b] ^ d ^ e, a ^ m2[b] ^ m3[d] ^ e, a ^ b ^ m2[d] ^ m3[e], m3[a] ^ b ^ d ^ m2[e]]
                s = t
            s = [a ^ b for a, b in zip(s, self.keys[r])]
        return bytes(s)

    def decrypt(self, block: bytes) -> bytes:
        return self.decrypt_blocks(np.frombuffer(block, np.uint8)[None, :]).tobytes()

    def decrypt_blocks(self, blocks: np.ndarray) -> np.ndarray:
        """Any number of blocks at once, one a row."""
        keys = [np.frombuffer(k, np.uint8) for k in self.keys]
        s = blocks ^ keys[self.rounds]
        for r in range(self.rounds - 1, -1, -1):
            s = _BACK_TABLE[s[:, _UNSHIFT]] ^ keys[r]
            if r:
                c = s.reshape(-1, 4, 4)
                a, b, d, e = (c[:, :, i] for i in range(4))
                m9, mb, md, me = _M_TABLE[9], _M_TABLE[11], _M_TABLE[13], _M_TABLE[14]
                s = np.stack([me[a] ^ mb[b] ^ md[d] ^ m9[e], m9[a] ^ me[b] ^ mb[d] ^ md[e], md[a] ^ m9[b] ^ me[d] ^ mb[e], mb[a] ^ md[b] ^ m9[d] ^ me[e]], axis=2).reshape(-1, 16)
        return s

    def cbc_decrypt(self, iv: bytes, data: bytes, unpad: bool = True) -> bytes:
        whole = len(data) - len(data) % 16
        if not whole:
            return b""
        blocks = np.frombuffer(data[:whole], np.uint8).reshape(-1, 16)
        before = np.vstack([np.frombuffer(iv, np.uint8)[None, :], blocks[:-1]])
        out = bytearray((self.decrypt_blocks(blocks) ^ before).tobytes())
        if unpad and 1 <= out[-1] <= 16:
            del out[-out[-1] :]
        return bytes(out)

    def cbc_encrypt(self, iv: bytes, data: bytes) -> bytes:
        out = bytearray()
        for i in range(0, len(data), 16):
            iv = self.encrypt(bytes(a ^ b for a, b in zip(data[i : i + 16], iv)))
            out += iv
        return bytes(out)


def hash_r6(password: bytes, salt: bytes, extra: bytes, revision: int) -> bytes:
    k = hashlib.sha256(password + salt + extra).digest()
    if revision < 6:
        return k
    i = 0
    while True:
        e = Aes(k[:16]).cbc_encrypt(k[16:32], (password + k + extra) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class WrongPassword(ValueError):
    pass


class Decryptor:
    """Keys of an encrypted file, from its Encrypt dictionary, file id and a password."""

    def __init__(self, enc: dict, file_id: bytes, password: str):
        if enc.get("Filter", "Standard") != "Standard":
            raise ValueError(f"unsupported security handler {enc.get('Filter')}")
        self.v, self.r = int(enc.get("V", 0)), int(enc.get("R", 2))
        length = int(enc.get("Length", 40)) // 8
        self.meta = enc.get("EncryptMetadata", True) is not False
        self.stream, self.string = "RC4", "RC4"
        if self.v >= 4:
            filters = enc.get("CF", {})
            kind = lambda name: "None" if name == "Identity" else {"V2": "RC4", "AESV2": "AES", "AESV3": "AES256", "None": "None"}.get(filters.get(name, {}).get("CFM", "None"), "None")
            self.stream, self.string = kind(enc.get("StmF", "Identity")), kind(enc.get("StrF", "Identity"))
            length = 32 if self.v >= 5 else 16
        elif self.v < 2:
            length = 5
        o, u, p = enc["O"], enc["U"], int(enc.get("P", 0)) & 0xFFFFFFFF
        if self.v >= 5:
            self.key = self._key_256(enc, password.encode("utf-8")[:127])
            return
        secret = password.encode("latin-1", "replace")
        for attempt in (secret, self._user_from_owner(secret, o, length)):
            key = self._key(attempt, o, p, file_id, length)
            if self._check(key, u, file_id):
                self.key = key
                return
        raise WrongPassword("wrong password")

    def _key(self, password: bytes, o: bytes, p: int, file_id: bytes, length: int) -> bytes:
        h = hashlib.md5((password + PAD)[:32] + o[:32] + p.to_bytes(4, "little") + file_id + (b"\xff\xff\xff\xff" if self.r >= 4 and not self.meta else b"")).digest()
        if self.r >= 3:
            for _ in range(50):
                h = hashlib.md5(h[:length]).digest()
        return h[:length]

    def _check(self, key: bytes, u: bytes, file_id: bytes) -> bool:
        if self.r < 3:
            return rc4(key, PAD) == u[:32]
        h = hashlib.md5(PAD + file_id).digest()
        for i in range(20):
            h = rc4(bytes(b ^ i for b in key), h)
        return h == u[:16]

    def _user_from_owner(self, password: bytes, o: bytes, length: int) -> bytes:
        h = hashlib.md5((password + PAD)[:32]).digest()
        if self.r >= 3:
            for _ in range(50):
                h = hashlib.md5(h).digest()
        key, out = h[:length], o[:32]
        for i in range(19, -1, -1) if self.r >= 3 else (0,):
            out = rc4(bytes(b ^ i for b in key), out)
        return out

    def _key_256(self, enc: dict, password: bytes) -> bytes:
        o, u = enc["O"][:48], enc["U"][:48]
        if hash_r6(password, u[32:40], b"", self.r) == u[:32]:
            k = hash_r6(password, u[40:48], b"", self.r)
            return Aes(k).cbc_decrypt(bytes(16), enc["UE"][:32], False)
        if hash_r6(password, o[32:40], u, self.r) == o[:32]:
            k = hash_r6(password, o[40:48], u, self.r)
            return Aes(k).cbc_decrypt(bytes(16), enc["OE"][:32], False)
        raise WrongPassword("wrong password")

    def decrypt(self, data: bytes, num: int, gen: int, stream: bool) -> bytes:
        kind = self.stream if stream else self.string
        if kind == "None":
            return data
        if kind == "AES256":
            return Aes(self.key).cbc_decrypt(data[:16], data[16:])
        salt = num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if kind == "AES" else b"")
        key = hashlib.md5(self.key + salt).digest()[: min(len(self.key) + 5, 16)]
        return Aes(key).cbc_decrypt(data[:16], data[16:]) if kind == "AES" else rc4(key, data)
