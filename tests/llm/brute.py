"""Plain single-process versions of the operators' contracts, for tests."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def sha(s: str | bytes) -> str:
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def secrets(text: str | None) -> tuple:
    text = text or ""
    a = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    base = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(a + b + c))
    return len(a), len(b), len(c), sha(base)


def dedup(texts: dict) -> dict:
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    seen = collections.Counter()
    for w in words.values():
        seen.update(tuple(w[j : j + 35]) for j in range(len(w) - 34))
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - 34):
            if seen[tuple(w[j : j + 35])] > 1:
                gone.update(range(j, j + 35))
        out[i] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def fingerprint(text: str | None) -> int:
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints: dict) -> dict:
    least: dict = {}
    for i, f in prints.items():
        least[f] = min(i, least.get(f, i))
    todo, out = set(least), {}
    while todo:
        front, group = [todo.pop()], []
        while front:
            f = front.pop()
            group.append(f)
            near = {g for g in todo if (f ^ g).bit_count() <= 3}
            todo -= near
            front += near
        root = min(least[f] for f in group)
        out |= dict.fromkeys(group, root)
    return {i: out[f] for i, f in prints.items()}


def base_lm(texts: dict) -> dict:
    tokens = {i: [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None] for i, t in texts.items()}
    c = collections.Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(w)
    n, v = c.total(), len(c)
    return {i: (zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, w in tokens.items()}


def quality(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    lines = [s for s in text.split("\n") if WORD.search(s)]
    seen = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    again = {k for j in range(len(w) - 4) if seen[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)


def pages(rows: dict) -> dict:
    data = {i: (t or "").encode() for i, t in rows.items()}
    first: dict = {}
    for i, b in data.items():
        first[b] = min(i, first.get(b, i))
    return {i: (len(b), sha(b), *(("revisit", first[b]) if len(b) >= 100 and first[b] != i else ("response", None))) for i, b in data.items()}


def entropy(window: str) -> float:
    counts = collections.Counter(window)
    return -sum(c / len(window) * math.log2(c / len(window)) for c in counts.values())


def harmless(part: str) -> bool:
    """Whether a part between slashes is empty, a repetition, a number, a placeholder or like words."""
    if not part or any(len(part) % n == 0 and part.lower() == part[:n].lower() * (len(part) // n) and len(part) > n for n in (1, 2, 3, 4)):
        return True
    if all(c in "0123456789_=+-" for c in part) or any(w in part.lower() for w in ("example", "placeholder", "changeme", "dummy")):
        return True
    letters = [c for c in part if c.isalpha()]
    if not letters or any(not c.isalpha() and c not in "_=+-" for c in part):
        return False
    vowels, upper = sum(c.lower() in "aeiouy" for c in letters) / len(letters), sum(c.isupper() for c in letters) / len(letters)
    return 0.22 <= vowels <= 0.65 and (upper <= 0.3 or upper == 1)


def entropy_spans(text: str | None) -> list[tuple[int, int]]:
    """The added spans, each window's entropy counted anew."""
    out = []
    for m in re.finditer("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text or ""):
        s = m[0]
        if re.fullmatch("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s):
            continue
        runs = set()
        for known, least in (("0123456789abcdef", 3.0), ("0123456789ABCDEF", 3.0), (None, 3.75)):
            open_ = None
            for i in range(len(s) - 19):
                w = s[i : i + 20]
                if (known is None or all(c in known for c in w)) and entropy(w) >= least - 1e-12:
                    if open_ and i <= open_[1]:
                        open_ = (open_[0], i + 20)
                    else:
                        runs |= {open_} if open_ else set()
                        open_ = (i, i + 20)
            runs |= {open_} if open_ else set()
        end = -1
        for a, b in sorted(runs):
            parts = s[a:b].split("/")
            while parts and harmless(parts[0]):
                a += len(parts.pop(0)) + 1
            while parts and harmless(parts[-1]):
                b -= len(parts.pop()) + 1
            if parts and b > end and b - a >= 20:
                out.append((m.start() + a, m.start() + b))
                end = b
    return out


def all_spans(text: str | None) -> str:
    text = text or ""
    a = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    d = [(s, 3, e) for s, e in entropy_spans(text)]
    return ",".join(f"{('assign', 'access', 'hex', 'entropy')[k]}:{s}:{e}" for s, k, e in sorted(a + b + c + d))


def png_bytes(blob: bytes) -> bytes:
    """The samples of an 8-bit RGB image, byte by byte."""
    assert blob[:8] == b"\x89PNG\r\n\x1a\n"
    at, data, width, height = 8, b"", 0, 0
    while at < len(blob):
        size, kind = int.from_bytes(blob[at : at + 4], "big"), blob[at + 4 : at + 8]
        body = blob[at + 8 : at + 8 + size]
        assert zlib.crc32(kind + body) == int.from_bytes(blob[at + 8 + size : at + 12 + size], "big")
        if kind == b"IHDR":
            width, height = int.from_bytes(body[:4], "big") * 3, int.from_bytes(body[4:8], "big")
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    lines, rows = zlib.decompress(data), []
    for y in range(height):
        line = lines[y * (width + 1) : (y + 1) * (width + 1)]
        row = bytearray(line[1:])
        for x in range(width):
            a, b = (row[x - 3] if x >= 3 else 0), (rows[-1][x] if rows else 0)
            row[x] = (row[x] + (0, a, b)[line[0]]) % 256
        rows.append(bytes(row))
    return b"".join(rows)


def picture_hash(data: bytes) -> str:
    """The perceptual hash of 64-pixel rows: areas and cosines summed one by one."""
    height = len(data) // 192
    luma = [[(299 * data[y * 192 + 3 * x] + 587 * data[y * 192 + 3 * x + 1] + 114 * data[y * 192 + 3 * x + 2]) / 1000 for x in range(64)] for y in range(height)]
    down = [[sum(max(0.0, min((i + 1) * height / 32, y + 1) - max(i * height / 32, y)) * luma[y][x] for y in range(math.floor(i * height / 32), math.ceil((i + 1) * height / 32))) * 32 / height for x in range(64)] for i in range(32)]
    small = [[(row[2 * x] + row[2 * x + 1]) / 2 for x in range(32)] for row in down]
    wave = [[math.cos(math.pi * u * (2 * x + 1) / 64) for x in range(32)] for u in range(8)]
    half = [[sum(small[y][x] * wave[v][x] for x in range(32)) for v in range(8)] for y in range(32)]
    low = [round(sum(half[y][v] * wave[u][y] for y in range(32)), 6) for u in range(8) for v in range(8)]
    rest = sorted(low[1:])
    bits = "".join("1" if x > rest[31] else "0" for x in low)
    return f"{int(bits, 2):016x}"
