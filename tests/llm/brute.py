"""Plain versions of the operators' results, written from their definitions and as slow as that makes them."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import xxhash

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op1(docs: list[tuple], span: int = 50) -> dict:
    """docs: (doc_id, text). {doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}"""
    first: dict[bytes, int] = {}
    raws = {k: (t or "").encode() for k, t in docs}
    for k in sorted(raws):
        r = raws[k]
        for i in range(len(r) - span + 1):
            first.setdefault(r[i : i + span], k)
    out = {}
    for k, r in raws.items():
        gone = bytearray(len(r))
        for i in range(len(r) - span + 1):
            if first[r[i : i + span]] < k:
                gone[i : i + span] = b"\1" * span
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[k] = (len(r), sum(gone), runs, sha(bytes(b for b, g in zip(r, gone) if not g)))
    return out


def kept(docs: list[tuple], span: int = 50) -> dict:
    """{doc_id: remaining bytes}, by the rule of op1."""
    first: dict[bytes, int] = {}
    raws = {k: (t or "").encode() for k, t in docs}
    for k in sorted(raws):
        for i in range(len(raws[k]) - span + 1):
            first.setdefault(raws[k][i : i + span], k)
    out = {}
    for k, r in raws.items():
        gone = bytearray(len(r))
        for i in range(len(r) - span + 1):
            if first[r[i : i + span]] < k:
                gone[i : i + span] = b"\1" * span
        out[k] = bytes(b for b, g in zip(r, gone) if not g)
    return out


def fingerprint(text: str | None) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def op6(docs: list[tuple], distance: int = 4) -> dict:
    fps = {k: fingerprint(t) for k, t in docs}
    parent = {f: f for f in fps.values()}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    every = sorted(parent)
    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    least: dict[int, int] = {}
    for k, f in fps.items():
        least[root(f)] = min(k, least.get(root(f), k))
    return {k: (f"{f:016x}", least[root(f)]) for k, f in fps.items()}


def op9(docs: list[tuple], items: list[tuple], window: int = 10) -> dict:
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = WORD.findall(lowered(text))
        for i in range(max(len(w) - window + 1, 1 if w else 0)):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    sizes = sorted({len(w) for w in windows})
    out = {}
    for k, text in docs:
        w = WORD.findall(lowered(text))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                of = windows.get(tuple(w[i : i + n]))
                if of:
                    found |= of
                    hit[i : i + n] = [True] * n
        found.discard(None)
        out[k] = (len(w), sum(hit), len(found), sha(",".join(sorted(map(str, found))).encode()), any(hit))
    return out


def op7(text: str | None) -> tuple:
    raw = (text or "").encode()
    padded = raw + bytes(-len(raw) % 64 if raw else 64)
    return len(raw), len(padded), sha(padded), zlib.crc32(padded[-64:])


def op10(pages: list[tuple], floor: int = 0) -> dict:
    """pages: (page_id, html)."""
    raws = {k: (h or "").encode() for k, h in pages}
    most: dict[bytes, int] = {}
    for k, r in raws.items():
        most[r] = max(k, most.get(r, k))
    out = {}
    for k, r in raws.items():
        again = len(r) >= floor and most[r] != k
        out[k] = (len(r), base64.b32encode(hashlib.sha1(r).digest()).decode(), "revisit" if again else "response", most[r] if again else None)
    return out


def greedy(groups: list[int], capacity: int) -> int:
    shards, room = 0, 0
    for g in groups:
        if g > room:
            shards, room = shards + 1, capacity
        room -= g
    return shards
