"""Row decompression of SAS data sets: run lengths (SASYZCRL) and Ross data compression (SASYZCR2)."""

from __future__ import annotations

from .files import SasError


def run_lengths(src: bytes, size: int) -> bytes:
    """Commands are the high half of a byte, lengths the low half, for some commands with a second byte."""
    out, at, end = bytearray(), 0, len(src)
    while at < end and len(out) < size:
        command, n = src[at] >> 4, src[at] & 15
        at += 1
        wide = (n << 8) + src[at] if command < 8 and command not in (2, 3) and at < end else 0
        if command in (0, 1):
            k = wide + 64 + 4096 * command
            out += src[at + 1 : at + 1 + k]
            at += 1 + k
        elif command == 2:
            out += src[at : at + n + 96]
            at += n + 96
        elif command == 4:
            out += src[at + 1 : at + 2] * (wide + 18)
            at += 2
        elif command in (5, 6, 7):
            out += b"@ \0"[command - 5 : command - 4] * (wide + 17)
            at += 1
        elif command in (8, 9, 10, 11):
            k = n + 1 + 16 * (command - 8)
            out += src[at : at + k]
            at += k
        elif command == 12:
            out += src[at : at + 1] * (n + 3)
            at += 1
        elif command in (13, 14, 15):
            out += b"@ \0"[command - 13 : command - 12] * (n + 2)
        else:
            raise SasError(f"unknown run-length command {command}")
    return bytes(out[:size]).ljust(size, b"\0")


def ross(src: bytes, size: int) -> bytes:
    """Sixteen flags at a time: literals, runs, and copies of what was written before."""
    out, at, flags, left = bytearray(), 0, 0, 0
    while at < len(src) and len(out) < size:
        if not left:
            flags, left = int.from_bytes(src[at : at + 2], "big"), 16
            at += 2
        left -= 1
        if not flags >> left & 1:
            out += src[at : at + 1]
            at += 1
            continue
        command, n = src[at] >> 4, src[at] & 15
        at += 1
        if command == 0:
            out += src[at : at + 1] * (n + 3)
            at += 1
            continue
        far = src[at] * 16
        at += 1
        if command == 1:
            out += src[at : at + 1] * (n + far + 19)
            at += 1
            continue
        back = n + 3 + far
        if command == 2:
            k = src[at] + 16
            at += 1
        else:
            k = command
        start = len(out) - back
        if start < 0:
            raise SasError("a copy from before the row's start")
        for j in range(k):
            out.append(out[start + j])
    return bytes(out[:size]).ljust(size, b"\0")
