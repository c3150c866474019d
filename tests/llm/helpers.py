"""Plain Python versions of the operations, for comparison on small tables."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def resemblance(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_components(docs, share=(85, 100)):
    """doc_id -> (size of set, least reachable id), by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            common = len(sets[a] & sets[b])
            if common and share[1] * common >= share[0] * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def line_key(line):
    return line.strip(BLANKS).translate(LOWER)


def dropped_lines(texts, least, min_chars=1):
    """For each text: lines, dropped lines, what is left."""
    lines = [(t or "").split("\n") for t in texts]
    count = {}
    for own in lines:
        for key in {line_key(x) for x in own}:
            count[key] = count.get(key, 0) + 1
    out = []
    for own in lines:
        kept = [x for x in own if not (len(line_key(x)) >= min_chars and count[line_key(x)] >= least)]
        out.append((len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def hit_words(text, items, n=13):
    """Number of words, hit places from 1, items that hit."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, found = set(), set()
    for item, item_text in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item_text or "").translate(LOWER))
        size = min(n, len(own))
        if size:
            windows = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)}
            for i in range(len(words) - size + 1):
                if tuple(words[i:i + size]) in windows:
                    places.update(range(i + 1, i + size + 1))
                    found.add(str(item))
    return len(words), sorted(places), sorted(found)
