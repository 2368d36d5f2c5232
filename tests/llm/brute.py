"""Plain versions of the corpus queries, one document after the other, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def secrets(text: str | None) -> tuple:
    text, found, counts = text or "", [], []
    kinds = (
        ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"(AKIA[A-Z0-9]+)", 1, 20), ("hex", r"([0-9a-f]+)", 1, 24))
    for k, (_, pattern, group, least) in enumerate(kinds):
        mine = [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
        counts.append(len(mine))
        found += mine
    shown = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(found))
    return (*counts, sha(shown), shown)


def repeats(docs: list[tuple], length: int = 100) -> dict:
    """docs: (doc_id, text). By position in the list."""
    first: dict[bytes, tuple] = {}
    raw = [(d, (t or "").encode()) for d, t in docs]
    for d, t in raw:
        key = (0,) if d is None else (1, d)
        for s in range(len(t) - length + 1):
            w, at = t[s:s + length], (key, s)
            if w not in first or at < first[w]:
                first[w] = at
    out = []
    for d, t in raw:
        key = (0,) if d is None else (1, d)
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if first[t[s:s + length]] < (key, s):
                gone[s:s + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((d, len(t), sum(gone), spans, sha(kept)))
    return out


def shingles(text: str | None, width: int = 3) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + width]) for k in range(len(words) - width + 1)) or frozenset([tuple(words)])


def components(nodes, edges) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard(docs: list[tuple], width: int = 3, percent: int = 90) -> list[tuple]:
    sets = [(d, shingles(t, width)) for d, t in docs]
    edges = []
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                edges.append((a, b))
    comp = components([d for d, _ in sets], edges)
    return [(d, len(s), comp[d]) for d, s in sets]


def words10(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs: list[tuple], items: list[tuple], window: int = 13) -> list[tuple]:
    known: dict[tuple, set] = {}
    for item, text in items:
        words = words10(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            known.setdefault(tuple(words[k:k + size]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in known}
    out = []
    for d, text in docs:
        words, hit, found = words10(text), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if held := known.get(tuple(words[k:k + size])):
                    hit |= set(range(k, k + size))
                    found |= held
        out.append((d, len(words), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def pieces(docs: list[tuple], tokenizer, sequence: int = 2048) -> list[tuple]:
    out = []
    for d, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), sequence)):
            part = ids[s:s + sequence]
            out.append((d, p, s, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    return out
