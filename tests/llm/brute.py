"""Plain single-machine versions of the text contracts, row by row."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRET = {
    "assign": r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))"
              r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingle_set(text: str | None, size: int) -> frozenset:
    w = WORD.findall(lower(text or ""))
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


def jaccard_components(rows, size: int, num: int, den: int) -> list[tuple]:
    """(doc_id, set size, component's smallest doc_id) per row."""
    sets = [shingle_set(t, size) for _, t in rows]
    holders, up = collections.defaultdict(list), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, s in enumerate(sets):
        shared = collections.Counter(m for g in s for m in holders[g])
        for m, both in shared.items():
            if den * both >= num * (len(s) + len(sets[m]) - both):
                a, b = root(n), root(m)
                up[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(n)
    low: dict = {}
    for n, (i, _) in enumerate(rows):
        r = root(n)
        low[r] = min((x for x in (low.get(r), i) if x is not None), default=None)
    return [(i, len(sets[n]), low[root(n)]) for n, (i, _) in enumerate(rows)]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_spans(text: str | None) -> list[tuple]:
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                  "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def secret_spans(text: str | None) -> list[tuple]:
    out = []
    for rank, (kind, pattern) in enumerate(SECRET.items()):
        for m in re.finditer(pattern, text or ""):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                out.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def span_digest(spans) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def quality_counts(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.defaultdict(list)
    for k in range(len(w) - 7):
        windows[tuple(w[k : k + 8])].append(k)
    covered = {k + j for ks in windows.values() if len(ks) > 1 for k in ks for j in range(8)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def edit_distance_inside(item: list, text: list) -> int:
    """Smallest edit distance of ``item`` to any stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for k, a in enumerate(item, 1):
        new = [k]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)
