"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hex256(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def near(texts, k=5, num=4, den=5):
    """(class, links) of each text; class: least position in it."""
    texts = [t or "" for t in texts]
    sets = []
    for t in texts:
        w = WORD.findall(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if texts[a] == texts[b] or both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(find(a), links[a]) for a in range(len(texts))]


def base_quality(text):
    text = text or ""
    words = WORD.findall(text)
    runs = defaultdict(list)
    for i in range(len(words) - 4):
        runs[tuple(words[i : i + 5])].append(i)
    hit = {i + j for at in runs.values() if len(at) > 1 for i in at for j in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


def contaminated(text, items):
    low = lambda t: BENCH_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = low(text), set(), set()
    for item_id, item in items:
        own = low(item)
        for k in range(max(1, len(own) - 12) if own else 0):
            part = own[k : k + 13]
            for i in range(len(words) - len(part) + 1):
                if words[i : i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    found.add(str(item_id))
    return len(words), len(hit), len(found), hex256(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(words)


def substrings(texts, k=35):
    docs = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + k]) for w in docs for i in range(len(w) - k + 1))
    out = []
    for w in docs:
        gone = {i + j for i in range(len(w) - k + 1) if count[tuple(w[i : i + k])] > 1 for j in range(k)}
        out.append((len(w), len(gone), hex256(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def chat(rows):
    """rows of (conv_id, turn, role, text) -> conv_id: (n, turns, loss chars, loss)."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = len(turns), hex256("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), hex256(loss)
    return out
