"""What operators should give, by looking everywhere."""

import hashlib
from collections import Counter

from sitelake.llm.decontam import WINDOW, words
from sitelake.llm.repeats import LENGTH


def repeats(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 of texts, by a table of all windows."""
    raws, seen = [(t or "").encode() for t in texts], {}
    for r in raws:
        for i in range(len(r) - LENGTH + 1):
            seen[r[i : i + LENGTH]] = seen.get(r[i : i + LENGTH], 0) + 1
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - LENGTH + 1):
            if seen[r[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return out


def contamination(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[int, int, str]:
    """n_words, n_hit and the items of one document, by looking everywhere."""
    doc, hit, names = words((text or "").encode()), set(), set()
    for item, t in items:
        own = words((t or "").encode())
        for i in range(max(1, len(own) - window + 1) if own else 0):
            x = own[i : i + window]
            for j in range(len(doc) - len(x) + 1):
                if doc[j : j + len(x)] == x:
                    hit |= {*range(j, j + len(x))}
                    names.add(item)
    return len(doc), len(hit), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def near_items(texts: list[str | None], items: list[tuple[str, str | None]], window: int = WINDOW, slop: int = 2) -> list[set[str]]:
    """The items of proximity matches of each text, exact ones among them, by looking at every start."""
    docs = [words((t or "").encode()) for t in texts]
    n = Counter(x for d in docs for x in d)
    out: list[set[str]] = [set() for _ in docs]
    for item, t in items:
        own = words((t or "").encode())
        for i in range(max(1, len(own) - window + 1) if own else 0):
            x = own[i : i + window]
            if len(x) < 3:
                continue
            a, b, c = sorted(range(len(x)), key=lambda k: (n[x[k]], k))[:3]
            for names, d in zip(out, docs, strict=True):
                near = lambda k, s, d=d, x=x: x[k] in d[max(0, s + k - slop) : s + k + slop + 1]
                if any(d[s + a] == x[a] and near(b, s) and near(c, s) for s in range(len(d) - len(x) + 1)):
                    names.add(item)
    return out
