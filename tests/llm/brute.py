"""Plain sequential versions of the operators, written from their definitions and without their code."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import regex
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest


# --- language identification: PPM, method C, over dictionaries
class Ppm:
    def __init__(self, texts: dict[str, list[bytes]], order: int, least: int):
        self.langs, self.order = sorted(texts), order
        whole = {x: b"".join(b"\0" * order + t for t in texts[x]) for x in self.langs}
        self.met = set(b"".join(whole.values())) | {0}
        self.counts = {x: defaultdict(Counter) for x in self.langs}
        for x in self.langs:
            for k in range(order + 1):
                for at in range(k, len(whole[x])):
                    self.counts[x][whole[x][at - k : at]][whole[x][at]] += 1
        self.kept = {c for x in self.langs for c, n in self.counts[x].items() if not c or sum(n.values()) >= least}

    def bits(self, text: bytes) -> list[float]:
        data = [c if c in self.met else -1 for c in b"\0" * self.order + text]
        out = []
        for x in self.langs:
            total = 0.0
            for at in range(self.order, len(data)):
                total -= math.log2(self._p(x, data[at - self.order : at], data[at]))
            out.append(total)
        return out

    def _p(self, lang, context, symbol) -> float:
        name = bytes(context) if -1 not in context else None
        if name is None or name not in self.kept:
            return self._p(lang, context[1:], symbol)
        seen = self.counts[lang].get(name, {})
        total, kinds = sum(seen.values()), len(seen)
        if symbol in seen:
            return seen[symbol] / (total + kinds)
        return (kinds / (total + kinds) if total else 1.0) * (self._p(lang, context[1:], symbol) if name else 1 / 256)


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def has_letter(text) -> bool:
    return regex.search(r"\p{L}", text or "") is not None


# --- line dedup: all windows, or the shortest ones alone
def _blocks(text):
    return [(at, s) for at, line in enumerate((text or "").split("\n")) if (s := line.strip(" \t\r"))]


def line_runs(docs: list[tuple], min_words: int, every: bool = True) -> dict:
    """doc_id: lines to delete, for distinct doc_ids. ``every``: windows of any length with enough words are looked at."""
    first, found = {}, defaultdict(set)
    for doc, text in sorted(docs, key=lambda d: -1 if d[0] is None else d[0]):
        lines = _blocks(text)
        words = [max(1, len(re.findall(r"[^ \t\n\x0b\f\r]+", s))) for _, s in lines]
        upto = np.concatenate([[0], np.cumsum(words)])
        windows = set()
        for s in range(len(lines)):
            z = int(np.searchsorted(upto, upto[s] + min_words))
            windows |= {(s, e) for e in (range(z, len(lines) + 1) if every else (z,)) if e <= len(lines)}
        if not every:
            for e in range(1, len(lines) + 1):
                s = int(np.searchsorted(upto, upto[e] - min_words, side="right")) - 1
                windows |= {(s, e)} if s >= 0 else set()
        for s, e in sorted(windows):
            name = tuple(x for _, x in lines[s:e])
            if first.setdefault(name, (doc, s)) != (doc, s):
                found[doc] |= set(range(lines[s][0], lines[e - 1][0] + 1))
        at = [k for k, _ in lines]  # blank lines between two that go, go too
        for a, b in zip(at, at[1:]):  # noqa: B905
            if {a, b} <= found[doc]:
                found[doc] |= set(range(a, b))
    return found


def without_lines(text, gone):
    return text if not gone else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


# --- SimHash
def fingerprint(text) -> int:
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps: list[int]) -> list[int]:
    comp, f = list(range(len(fps))), np.array(fps, np.uint64)
    for k in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(f[: k + 1] ^ f[k]) <= 3).tolist():
            if comp[j] != comp[k]:
                old, new = comp[k], comp[j]
                comp = [new if c == old else c for c in comp]
    return comp


# --- decontamination: every passage against every item
def tokens_of(text) -> list[str]:
    each = (regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", w).lower() for w in re.split(r"[\x20\x09-\x0d]+", text))
    return [w for w in each if w]


def _shingles(words, n):
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def contaminated(docs: list[tuple], items: list[tuple], split, threshold=0.6, overlap=0.8, k1=1.2, b=0.75) -> dict:
    """(doc_id, item_id): best score."""
    items = [(i, split(t)) for i, t in items if t and t.strip()]
    bags = [(i, tokens_of(q), tokens_of(a)) for i, (q, a) in items]
    df = Counter(w for _, q, a in bags for w in {*q, *a})
    mean = max(1.0, sum(len(q) + len(a) for _, q, a in bags) / max(1, len(bags)))
    weights = []
    for _, q, a in bags:
        tf = Counter(q + a)
        x = {w: math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * n * (k1 + 1) / (n + k1 * (1 - b + b * tf.total() / mean)) for w, n in tf.items()}
        weights.append({w: v / sum(x.values()) for w, v in x.items()})
    step, out = max([1, *(len(q) + len(a) for _, q, a in bags)]), {}
    for doc, text in docs:
        words = tokens_of(text or "")
        for at in range(0, step * max(1, -(-len(words) // step) - 1), step):
            passage = words[at : at + 2 * step]
            own = set(passage)
            for (item, q, a), weight in zip(bags, weights, strict=True):
                score = sum(v for w, v in weight.items() if w in own)
                if score < threshold - 1e-9:
                    continue
                parts = [(s, _shingles(passage, min(5, len(p)))) for p in (q, a) for s in [_shingles(p, min(5, len(p)))]]
                if all(not s or len(s & t) >= overlap * len(s) - 1e-9 for s, t in parts):
                    out[doc, item] = max(out.get((doc, item), 0.0), score)
    return out


# --- secrets
_BASE = (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))


def secrets(text) -> list[tuple]:
    """(start, kind's place, end) of the base findings."""
    return sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(_BASE) for m in re.finditer(p, text or "") if len(m.group(g)) >= least)


# --- packing
def pieces(docs: list[tuple], vocab: str, capacity: int, end: int) -> Counter:
    tok = Tokenizer.from_file(vocab)
    out = Counter()
    for doc, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, end]
        for p in range(-(-len(ids) // capacity)):
            part = ids[p * capacity : (p + 1) * capacity]
            out[doc, p, p * capacity, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out


def first_fit(lengths: list[int], capacity: int) -> int:
    room: list[int] = []
    for n in sorted(lengths, reverse=True):
        at = next((k for k, r in enumerate(room) if r >= n), None)
        if at is None:
            room.append(capacity - n)
        else:
            room[at] -= n
    return len(room)
