"""Plain-loop restatements of the operators that SQL can't express."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = re.compile("[ \t-\r]+")


def near(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter tells two words apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def spellings(docs, slip_every=31, min_letters=7, min_count=2, times=10) -> set:
    counts = Counter()
    for key, text in docs:
        for run in RUN.findall(text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if slip_every and h % slip_every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= min_letters:
                counts[word] += 1
    counts = {w: n for w, n in counts.items() if n >= min_count}
    return grouped(counts, times)


def grouped(counts: dict, times=10) -> set:
    shared = defaultdict(set)  # near words lose one letter, or none, and read alike
    for w in counts:
        for s in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            shared[s].add(w)
    nears = defaultdict(set)
    for some in shared.values():
        for a in some:
            nears[a] |= {b for b in some if near(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(nears[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(nears[w]), counts[form[w]] if form[w] else None))
    return out


def overlaps(a: list, b: list) -> list:
    """(i, j) of the spans that overlap; each list tiles the same range."""
    out = []
    for i, (s, e) in enumerate(a):
        j = bisect_right(b, (s, 1 << 60)) - 1
        while j < len(b) and b[j][0] < e:
            out.append((i, j))
            j += 1
    return out


def shared_out(ids: list, spans: list, ends: list) -> list:
    out = [[] for _ in ends]
    for x, (_, e) in zip(ids, spans, strict=True):
        out[bisect_left(ends, e)].append(x)
    return out


def alignments(docs, byte_bpe: str, piece_model: str) -> list:
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(byte_bpe)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    hidden = [x for x in range(256) if not (33 <= x < 127 or 161 <= x < 173 or 174 <= x)]
    byte_of = {chr(x): x for x in range(256) if x not in hidden} | {chr(256 + i): x for i, x in enumerate(hidden)}

    def bytes_b(i: int) -> bytes:
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    held, counts = [], Counter()
    for key, text in docs:
        whole = f" {text or ''}"
        ids_a, ids_b = a.encode(whole, add_special_tokens=False).ids, b.encode(text or "")
        left, right = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a], [bytes_b(i) for i in ids_b]
        if not text or b"".join(left) != whole.encode() or b"".join(right) != whole.encode():
            held.append((key, [], [], [], []))
            continue
        cuts = []
        for parts in (left, right):
            at, spans = 0, []
            for p in parts:
                spans.append((at, at + len(p)))
                at += len(p)
            cuts.append(spans)
        links = overlaps(*cuts)
        counts.update((ids_a[i], ids_b[j]) for i, j in links)
        common = sorted({e for _, e in cuts[0]} & {e for _, e in cuts[1]})
        groups = list(zip(*(shared_out(ids, spans, common) for ids, spans in ((ids_a, cuts[0]), (ids_b, cuts[1]))), strict=True))
        held.append((key, ids_a, ids_b, links, groups))
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for key, ids_a, ids_b, links, groups in held:
        named = [(ids_a[i], ids_b[j]) for i, j in links]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        n_best, total = sum(counts[p] == top[p[1]] for p in named), sum(counts[p] for p in named)
        out.append((key, len(ids_a), len(ids_b), len(groups), len(links), n_best, total, text))
    return out


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest() if text else ""


def repetition(text, repeat_words=8, covered_percent=20, longest_words=50) -> tuple:
    text = text or ""
    words = [w for w in BLANKS.split(text) if w]
    n = len(words)

    def covered(k: int) -> int:
        seen = Counter(tuple(words[i : i + k]) for i in range(n - k + 1))
        return len({i + j for i in range(n - k + 1) if seen[tuple(words[i : i + k])] > 1 for j in range(k)})

    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if BLANKS.sub("", line):
            dup += line in seen
            seen.add(line)
    longest = 0
    while covered(longest + 1):
        longest += 1
    in_three = covered(3)
    failed = n < 50 or 100 * in_three > 50 * n
    kept = not failed and 100 * covered(repeat_words) <= covered_percent * n and longest <= longest_words
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, in_three, maximal(words, repeat_words), covered(repeat_words), longest, failed, kept


def maximal(words: list, least: int) -> int:
    """Substrings of at least `least` words met twice that no word before or after all of them makes longer."""
    n, out = len(words), 0
    for k in range(least, n):
        places = defaultdict(list)
        for i in range(n - k + 1):
            places[tuple(words[i : i + k])].append(i)
        if not any(len(p) > 1 for p in places.values()):
            break
        for p in places.values():
            before = {words[i - 1] if i else None for i in p}
            after = {words[i + k] if i + k < n else None for i in p}
            out += len(p) > 1 and len(before) > 1 and len(after) > 1
    return out
