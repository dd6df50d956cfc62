"""Plain Python forms of the operators' contracts, and a fixture of awkward documents."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

BLANK = " \t\n\x0b\x0c\r"
AWKWARD = [None, "", " ", "\n", "\n\n x \n", "a", "one two", "Ünï cödé ß 日本語", "a b c d e f g h i j", "x" * 5000, " ".join(["w"] * 400), " ".join(f"w{i}" for i in range(3000)), "   y", "tab\tsep\x0bvt", "A.b,C;d:e"]


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int, str | None]]:
    """Copies, near copies, shared lines and passages among random texts, and the awkward ones."""
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("a", "e", "io", "un", "IX")]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage, line = text(50), "Shared line here."
    out: list[str | None] = list(AWKWARD)
    for i in range(n):
        t = text(rnd.choice([3, 20, 60, 120]))
        if i % 3 == 0:
            t += f"\n  {line.upper() if i % 2 else line} \n" + text(8)
        if i % 4 == 0:
            t = f"{text(5)} {passage} {text(6)}"
        out.append(t)
    base = text(150).split(" ")
    for i in range(12):
        own = list(base)
        for _ in range(i % 4):
            own[rnd.randrange(len(own))] = "zz"
        out.append(" ".join(own))
    out += out[20:26] + [out[5]]
    return list(enumerate(out))


def words(text: str | None) -> list[str]:
    return [w for w in re.split(f"[{BLANK}]+", text or "") if w]


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(rows, least: int):
    keys = [[lower(x.strip(BLANK)) for x in (t or "").split("\n")] for _, t in rows]
    docs = Counter(k for own in keys for k in set(own) if k)
    for (d, t), own in zip(rows, keys):
        kept = [x for x, k in zip((t or "").split("\n"), own) if docs[k] < least]
        yield d, len(own), len(own) - len(kept), sha("\n".join(kept))


def substrings(rows, window: int):
    each = [words(t) for _, t in rows]
    n = Counter(tuple(w[i : i + window]) for w in each for i in range(len(w) - window + 1))
    for (d, _), w in zip(rows, each):
        gone = {j for i in range(len(w) - window + 1) if n[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        yield d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def shingles(text, size):
    w = words(lower(text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(rows, size: int, share: int):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least[find(i)], links[i]) for i, (d, _) in enumerate(rows)]


def overlaps(rows, items, window: int):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
    wins: dict[tuple, set[str]] = {}
    for name, t in items:
        w = split(t)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(str(name))
    sizes = {len(k) for k in wins}
    for d, t in rows:
        w, hit, names = split(t), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (own := tuple(w[i : i + k])) in wins:
                    hit.update(range(i, i + k))
                    names |= wins[own]
        yield d, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)


def repeat_words(text):
    w = words(text)
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)})
