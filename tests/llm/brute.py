"""Plain versions of what the operators compute."""

import re
from collections import defaultdict


def brute_repeats(texts, length, words):
    raw = [(t or "").encode() for t in texts]
    split = [b.split() for b in raw]
    count, said = defaultdict(int), defaultdict(int)
    for b, w in zip(raw, split, strict=True):
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] += 1
        for i in range(len(w) - words + 1):
            said[tuple(w[i : i + words])] += 1
    out = []
    for b, w in zip(raw, split, strict=True):
        m, p = bytearray(len(b)), set()
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                m[i : i + length] = b"\1" * length
        for i in range(len(w) - words + 1):
            if said[tuple(w[i : i + words])] > 1:
                p.update(range(i, i + words))
        out.append((len(b), sum(m), len(re.findall(b"\1+", bytes(m))), bytes(x for x, y in zip(b, m, strict=True) if not y), len(p)))
    return out


E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
C = re.compile(r"[0-9]([\x20-]?[0-9])+")
P = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(x - 9 * (x > 9) for x in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(d)))) % 10 == 0


def brute_spans(t):
    return {
        "email": [m.span() for m in E.finditer(t)], "ip": [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in C.finditer(t) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)], "phone": [m.span() for m in P.finditer(t) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15],
    }
