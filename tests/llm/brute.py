"""Plain versions of the operators, one document after the other."""

import hashlib
import re
import unicodedata
import zlib

import numpy as np

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def encoded(docs):
    """doc_id, start, n_tokens, ids_crc32."""
    t, at, out = tokenizer("byte_bpe_50k.json"), 0, []
    for doc_id, text in sorted(docs):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def round_trip(docs):
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    t, out = tokenizer("byte_bpe_50k.json"), []
    for doc_id, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out)


def counted(docs):
    """doc_id, n_bytes, n_tokens, over_limit."""
    t, out = tokenizer("word_bpe_49k.json"), []
    for doc_id, text in docs:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        out.append((doc_id, len((text or "").encode()), n, n > 2048))
    return sorted(out)


def without_repeats(docs, width=50):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    seen, out = set(), []
    for doc_id, text in sorted(docs):
        raw = (text or "").encode()
        gone, own = np.zeros(len(raw), bool), set()
        for i in range(len(raw) - width + 1):
            s = raw[i : i + width]
            if s in seen:
                gone[i : i + width] = True
            own.add(s)
        seen |= own
        spans = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]]))) if len(raw) else 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, width=5):
    ws = SPACE.findall((text or "").translate(UPPER))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1)))


class Links:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def near(docs, percent=75):
    """doc_id, n_shingles, component_id, kept."""
    sets, links, holders = {d: shingles(t) for d, t in docs}, Links(), {}
    for d in sorted(sets):
        together = {}
        for s in sets[d]:
            for e in holders.setdefault(s, []):
                together[e] = together.get(e, 0) + 1
            holders[s].append(d)
        for e, both in together.items():
            if 100 * both >= percent * (len(sets[d]) + len(sets[e]) - both):
                links.link(d, e)
    return [(d, len(s), links.find(d), links.find(d) == d) for d, s in sorted(sets.items())]


def alike_lines(a, b, percent, width=10):
    """Exact Jaccard similarity of two lines' shingle sets against the threshold."""
    x, y = ({s[i : i + width] for i in range(len(s) - width + 1)} for s in (a, b))
    both = len(x & y)
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def fewer_lines(docs, width=10, percent=80):
    """doc_id, n_removed, text: first line of each component of similar lines stays."""
    at, links, first = {}, Links(), {}
    for d, text in sorted(docs):
        for k, line in enumerate((text or "").split("\n")):
            if SPACE.search(line):
                at.setdefault(line, (d, k))
    sets = {x: frozenset(x[i : i + width] for i in range(len(x) - width + 1)) for x in at}
    holders = {}
    for x in sorted(at, key=at.get):
        together = {}
        for s in sets[x]:
            for y in holders.setdefault(s, []):
                together[y] = together.get(y, 0) + 1
            holders[s].append(x)
        for y, both in together.items():
            if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                links.link(at[x], at[y])
    out = []
    for d, text in sorted(docs):
        kept, n = [], 0
        for k, line in enumerate((text or "").split("\n")):
            if SPACE.search(line) and links.find(at[line]) != (d, k):
                n += 1
            else:
                kept.append(line)
        out.append((d, n, None if text is None else "\n".join(kept)))
    return out


def base_rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    ws = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    tri = {}
    for i in range(len(ws) - 2):
        tri.setdefault(tuple(ws[i : i + 3]), []).append(i)
    hit = {i + k for v in tri.values() if len(v) > 1 for i in v for k in range(3)}
    return (
        len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
        len(ws) < 50 or 100 * len(hit) > 50 * len(ws),
    )


def passes(text):
    """The verdict of all quality rules."""
    text = text or ""
    words, chars, symbols, dup, _, failed = base_rules(text)
    n_lines = sum(bool(SPACE.search(x)) for x in text.split("\n"))
    up, latin = sum("A" <= c <= "Z" for c in text), sum(c.isascii() and c.isalpha() for c in text)
    letters = sum(unicodedata.category(c)[0] == "L" for c in text)
    grams = [text[i : i + 12] for i in range(len(text) - 11)]
    return not (
        failed or 10 * symbols > words or chars < 2 * words or chars > 12 * words or 10 * dup > 6 * max(n_lines, 1)
        or 10 * up > 6 * max(latin, 1) or 10 * letters < 7 * chars or 10 * len(set(grams)) < 6 * len(grams)
    )


def leaks(docs, items, width=13):
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, whether a full window occurs."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(UPPER))
    windows = {}
    for item, text in items:
        ws = split(text)
        k = min(width, len(ws))
        for i in range(len(ws) - k + 1 if ws else 0):
            windows.setdefault(tuple(ws[i : i + k]), set()).add(str(item))
    sizes, out = {len(w) for w in windows}, []
    for d, text in docs:
        ws, hit, found, full = split(text), set(), set(), False
        for k in sizes:
            for i in range(len(ws) - k + 1):
                w = windows.get(tuple(ws[i : i + k]))
                if w:
                    found |= w
                    full |= k == width
                    hit.update(range(i, i + k))
        out.append((d, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws), full))
    return sorted(out, key=lambda x: (x[0] is not None, x))
