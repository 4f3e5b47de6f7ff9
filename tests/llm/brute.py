"""Plain versions of what the operators compute, over small lists of (doc_id, text)."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

WHITE = re.compile(r"[\x20\x09-\x0D]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(WHITE.sub("", t or ""), []).append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        n = WHITE.sub("", t or "")
        out.append((i, min(groups[n])[2], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()))
    return out


def repeats(rows, length):
    """(doc_id, size, removed, runs, hash of the rest)"""
    seen = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, x in data:
        for k in range(len(x) - length + 1):
            seen[x[k:k + length]] = seen.get(x[k:k + length], 0) + 1
    out = []
    for i, x in data:
        gone = [False] * len(x)
        for k in range(len(x) - length + 1):
            if seen[x[k:k + length]] > 1:
                gone[k:k + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(x), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()))
    return out


def contamination(rows, items, window=10):
    wins = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k:k + window]), set()).add(i)
    out = []
    for i, t in rows:
        w = ALNUM.findall(lower(t))
        hit, found = set(), set()
        for phrase, owners in wins.items():
            n = len(phrase)
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) == phrase:
                    hit |= set(range(k, k + n))
                    found |= {str(o) for o in owners if o is not None}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def shingles(text):
    w = SOLID.findall(lower(text))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(rows, percent=75):
    """(doc_id, size of the set, component)"""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if None not in (i, j) and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return [(i, len(s), None if i is None else top(i)) for i, s in sets]


def base_secrets(text):
    a = [("assign", *m.span()) for m in re.finditer(
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "") if len(m[2]) >= 12]
    b = [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    c = [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 16]
    return sorted(a + b + c, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by sharing what exceeds a cap again and again; ``sizes`` by source."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while free and left > 1e-9:
        unit = left / sum(weight[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += unit * weight[s]
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                free.discard(s)
    return target


def single_tokens(rows):
    """(doc_id, held out, tokens, known, training tokens, log10 probability with one added to every count)"""
    words, ends = Counter(), 0
    rests = [None if i is None else zlib.crc32(str(i).encode()) % 7 for i, _ in rows]
    for (_, t), rest in zip(rows, rests):
        if rest not in (None, 2):
            words.update(SOLID.findall(lower(t)))
            ends += 1
    total = sum(words.values()) + ends
    under = total + len(words) + (ends > 0) + 1
    out = []
    for (i, t), rest in zip(rows, rests):
        own = [words[w] for w in SOLID.findall(lower(t))] + [ends]
        out.append((i, rest == 2, len(own), sum(c > 0 for c in own), total, sum(math.log10((c + 1) / under) for c in own)))
    return out


def path_probability(sequence, start, move, emit):
    """P of a sequence: the sum over all paths of states."""
    total = 0.0
    for path in itertools.product(range(len(start)), repeat=len(sequence)):
        p = start[path[0]] * emit[sequence[0]][path[0]]
        for t in range(1, len(sequence)):
            p *= move[path[t - 1]][path[t]] * emit[sequence[t]][path[t]]
        total += p
    return total


def path_counts(sequence, start, move, emit):
    """Expected (starts, moves, emissions) of a sequence: every path weighed by its share of the probability."""
    n, whole = len(start), path_probability(sequence, start, move, emit)
    starts, moves, emissions = [0.0] * n, [[0.0] * n for _ in range(n)], [[0.0] * n for _ in emit]
    for path in itertools.product(range(n), repeat=len(sequence)):
        p = start[path[0]] * emit[sequence[0]][path[0]]
        for t in range(1, len(sequence)):
            p *= move[path[t - 1]][path[t]] * emit[sequence[t]][path[t]]
        starts[path[0]] += p / whole
        for a, b in itertools.pairwise(path):
            moves[a][b] += p / whole
        for s, c in zip(path, sequence):
            emissions[c][s] += p / whole
    return starts, moves, emissions


def alignment(rows, folder):
    """Whole texts through both tokenizers, every token's bytes side by side."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    first = Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
    # the letter of a byte that is a character of its own, else the next one from U+0100 on
    shown = {ord(c) for c in ByteLevel.alphabet() if ord(c) < 256}
    letter = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    found, links = [], Counter()
    for _, text in rows:
        found.append(None)
        if not text:
            continue
        whole = (" " + text).encode()
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        bytes_a = [bytes(letter[c] for c in first.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(second.id_to_piece(x)[3:5], 16)]) if second.is_byte(x) else second.id_to_piece(x).replace("\u2581", " ").encode() for x in b]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            continue
        ends_a = list(itertools.accumulate(map(len, bytes_a)))
        ends_b = list(itertools.accumulate(map(len, bytes_b)))
        token_at = {e: k for k, e in enumerate(ends_a)}
        pairs = [(token_at[e], k) for k, e in enumerate(ends_b) if e in token_at]
        cuts = [(-1, -1), *pairs]
        groups = [",".join(map(str, a[i + 1:k + 1])) + "|" + ",".join(map(str, b[j + 1:m + 1])) for (i, j), (k, m) in itertools.pairwise(cuts)]
        found[-1] = (len(a), len(b), len(groups), [(a[i], b[j]) for i, j in pairs], ";".join(groups))
        links.update(found[-1][3])
    top = Counter()
    for (_, y), n in links.items():
        top[y] = max(top[y], n)
    return [(i, 0, 0, 0, 0, 0, 0, "") if f is None else
            (i, *f[:3], len(f[3]), sum(links[x] == top[x[1]] for x in f[3]), sum(links[x] for x in f[3]), hashlib.sha256(f[4].encode()).hexdigest())
            for (i, _), f in zip(rows, found)]


def negatives(rows, every, keep=5, percent=80):
    """(anchor, positive, rank, negative, its positive's score, its score); rows are (id, vector, label)"""
    fit = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows
           if None not in (i, v, c) and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, v, c in fit:
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, d) for j, w, d in fit if j != i]
        for s, j in sorted({(s, j) for s, j, d in scored if d == c})[:keep]:
            ranked = sorted({(t, k) for t, k, d in scored if d != c and percent * -s <= 100 * -t <= 100 * -s})
            out |= {(i, j, r, k, -s, -t) for r, (t, k) in enumerate(ranked[:keep], 1)}
    return sorted(out)
