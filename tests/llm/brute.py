"""Plain versions of what the training-data operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from datetime import date, timedelta

import numpy as np
import regex
import xxhash

from scrivener.llm import pseudonyms as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def id_crc(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


# SimHash


def fingerprint(text: str | None) -> int:
    words = WORD.findall(lowered(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps: list[int], ids: list[int], most_bits: int = 4) -> list[int]:
    """The smallest id of each row's group, by comparing all pairs."""
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= most_bits) + i + 1:
            parent[root(int(j))] = root(i)
    low: dict[int, int] = {}
    for i, d in enumerate(ids):
        low[root(i)] = min(d, low.get(root(i), d))
    return [low[root(i)] for i in range(len(fps))]


# Benchmark decontamination


def benchmark_words(text: str) -> list[str]:
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]


def shingle_set(text: str, n: int = 5) -> set[tuple[str, ...]]:
    w = benchmark_words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def contained(docs: list[tuple], items: list[tuple], least: float = 0.8) -> set[tuple[int, int]]:
    sets = [(i, shingle_set(t or "")) for i, t in items]
    out = set()
    for d, text in docs:
        words = benchmark_words(text or "")
        mine = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        for i, s in sets:
            if not s:
                continue
            n = len(next(iter(s)))
            have = mine if n == 5 else {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
            if len(s & have) >= least * len(s) - 1e-9:
                out.add((d, i))
    return out


# Quality rules


def base_counts(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            hit |= {i, i + 1, i + 2}
    n = len(words)
    failed = n < 50 or 100 * len(hit) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def byte_ngrams(text: str) -> list[int]:
    raw = text.encode()
    return [int.from_bytes(raw[i : i + 4], "little") * 2654435761 % 2**32 >> 16 for i in range(len(raw) - 3)]


def log_ratios(texts: list[str], good: list[bool]) -> list[float]:
    """Mean log-likelihood ratio of every text."""
    raw, target = Counter(), Counter()
    for t, g in zip(texts, good, strict=True):
        raw.update(byte_ngrams(t))
        if g:
            target.update(byte_ngrams(t))
    size = 1 << 16
    total_raw = sum(raw.values()) + size
    total_good = sum(target.values()) + size
    if total_good == size:
        return [0.0] * len(texts)
    out = []
    for t in texts:
        s = 0.0
        for b in byte_ngrams(t):
            p = (raw[b] + 1) / total_raw
            s += math.log((target[b] + size * p) / total_good) - math.log(p)
        out.append(s / max(1, len(t.encode()) - 3))
    return out


# Pseudonyms


IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?!\.?[0-9])"
#: What is looked for, stated here anew, in the order in which kinds are tried at a place.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}@(?:[A-Za-z0-9\-]+\.){1,126}[A-Za-z]{2,}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z][A-Z][0-9][0-9](?:[ ]?[A-Z0-9][A-Z0-9][A-Z0-9][A-Z0-9]){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])[0-9a-f]{26,64}(?![\p{L}\p{N}])",
    "ip": IP,
    "iso": r"(?<![0-9\-])[0-9]{4}-[0-9][0-9]-[0-9][0-9](?![0-9\-])",
    "dotted": r"(?<![0-9.])[0-9][0-9]\.[0-9][0-9]\.[0-9]{4}(?!\.?[0-9])",
    "slashed": r"(?<![0-9/])[0-9][0-9]/[0-9][0-9]/[0-9]{4}(?![0-9/])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9+])(?:\+1[ .\-]?[(]?[0-9]{3}[)]?[ .\-]{0,2}[0-9]{3}[ .\-]?[0-9]{4}|\+(?:[ .()\-]?[ .()\-]?[0-9]){8,13}|(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4})(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5}|[0-9]{13,19})(?![0-9])",
}
LONG_CODES = {2: {20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 51, 52, 53, 54, 55, 56, 57, 58, 60, 61, 62, 63, 64, 65, 66, 81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98}}


def feistel(xs: list[int], radixes: list[int], key: str, tweak: str) -> list[int]:
    x, half = list(xs), len(xs) // 2
    for k in range(P.ROUNDS):
        told = ",".join(map(str, x[half:] if k % 2 == 0 else x[:half]))
        for i in range(len(x)):
            if (i < half) == (k % 2 == 0) and radixes[i] > 1:
                x[i] = (x[i] + int(hashlib.sha256(f"{key}|{tweak}|{k}|{i}|{told}".encode()).hexdigest()[:12], 16)) % radixes[i]
    return x


def _alphabet(c: str) -> tuple[int, int] | None:
    return next(((ord(a), n) for a, n in P.ALPHABETS if ord(a) <= ord(c) < ord(a) + n), None)


def permuted(m: str, key: str, tweak: str, fixed: int = 0) -> str:
    core = [c for c in m if _alphabet(c)]
    a = [_alphabet(c) for c in core]
    xs = feistel([ord(c) - x[0] for c, x in zip(core, a, strict=True)], [1 if i < fixed else x[1] for i, x in enumerate(a)], key, tweak)
    new = iter([chr(v + x[0]) for v, x in zip(xs, a, strict=True)])
    return "".join(next(new) if _alphabet(c) else c for c in m)


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 == 0 else 2)
        total += d - 9 if d > 9 else d
    return total


def mod97(m: str) -> int:
    return int("".join(str(int(c, 36)) for c in m)) % 97


def _date(m: str, key: str, order: str) -> str:
    parts = [int(x) for x in re.split(r"\D", m)]
    styles = {"iso": ["%Y-%m-%d"], "dotted": ["%d.%m.%Y"], "slashed": ["%m/%d/%Y", "%d/%m/%Y"]}[order]
    for style in styles:
        y, mo, d = {"%Y": parts, "%d.": parts[::-1], "%m": [parts[2], parts[0], parts[1]], "%d/": parts[::-1]}[style[:3] if style[1] == "d" else style[:2]]
        try:
            day = (date(y, mo, d) - date(1900, 1, 1)).days
        except ValueError:
            continue
        if not 0 <= day < P.DAYS:
            return m
        x = [day // P.SIDE, day % P.SIDE]
        while True:
            x = feistel(x, [P.SIDE] * 2, key, "date")
            new = date(1900, 1, 1) + timedelta(days=x[0] * P.SIDE + x[1])
            if new.year < 2100 and (style != "%d/%m/%Y" or new.day > 12):
                return new.strftime(style)
    return m


def pseudonym(m: str, key: str) -> str:
    kind = next(k for k, p in KINDS.items() if regex.fullmatch(p, m))
    digits = re.sub(r"\D", "", m)
    if kind == "email":
        name = m.split("@")[0]
        return permuted(name, key, "email") + m[len(name) :]
    if kind == "iban":
        plain = m.replace(" ", "")
        if mod97(plain[4:] + plain[:4]) != 1:
            return m
        body = permuted(m[4:], key, "iban")
        return f"{m[:2]}{98 - mod97(body.replace(' ', '') + m[:2] + '00'):02d}{body}"
    if kind == "secret":
        if not re.search("[0-9]", m) or not re.search("[a-f]", m):
            return m
        first = [48 if c.isdigit() else 97 for c in m]
        new = feistel([ord(c) - f for c, f in zip(m, first, strict=True)], [10 if f == 48 else 6 for f in first], key, "secret")
        return "".join(chr(v + f) for v, f in zip(new, first, strict=True))
    if kind == "ip":
        return ".".join(map(str, feistel([int(x) for x in m.split(".")], [256] * 4, key, "ip")))
    if kind in ("iso", "dotted", "slashed"):
        return _date(m, key, kind)
    if kind == "ssn":
        invalid = re.compile("^(?:000|666|9)|-00-|-0000$")
        if invalid.search(m):
            return m
        while True:
            m = permuted(m, key, "ssn")
            if not invalid.search(m):
                return m
    if kind == "phone":
        if m[0] != "+":
            return permuted(m, key, "phone")
        plain = re.match(r"\+(\d{0,3})", m)[1]
        n = 1 if plain[:1] in ("1", "7") else 2 if plain[:2] and int(plain[:2]) in LONG_CODES[2] else len(plain)
        # A plus with no digit behind it has no code.
        return m[: n + 1] + permuted(m[n + 1 :], key, "phone") if plain else permuted(m, key, "phone")
    if luhn(digits) % 10:
        return m
    body = permuted(m[:-1], key, "card", 1)
    return body + str(-luhn(re.sub(r"\D", "", body) + "0") % 10)


def pseudonymised(text: str | None, key: str) -> tuple[str | None, int]:
    if text is None:
        return None, 0
    n, key = 0, hashlib.sha256(f"pseudonyms|{key}".encode()).hexdigest()
    pattern = "|".join(f"(?:{p})" for p in KINDS.values())

    def swap(m) -> str:
        nonlocal n
        new = pseudonym(m[0], key)
        n += new != m[0]
        return new

    return regex.sub(pattern, swap, text), n
