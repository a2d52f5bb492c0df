"""Plain Python versions of the query contracts, one row at a time, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def fingerprint(text, size=3):
    from xxhash import xxh64

    words = WORD.findall(low(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs, most=3):
    """docs: (id, text). Returns sorted (id, hex, component)."""
    fps = [(i, fingerprint(t)) for i, t in docs]
    every = sorted({f for _, f in fps})
    root = {f: f for f in every}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(every):
        for b in every[k + 1 :]:
            if (a ^ b).bit_count() <= most:
                root[find(a)] = find(b)
    least = {}
    for i, f in fps:
        r = find(f)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in fps), key=repr)


def url(u, rules):
    host = path = ""
    if u is not None and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = low(host)
    best = None
    for rule, block in rules:
        rh, slash, rp = rule.partition("/")
        if (host == rh or host.endswith("." + rh)) and path.startswith(slash + rp):
            if best is None or len(rule) > len(best[0]):
                best = (rule, block)
    return host, path, best and best[0], "block" if best and best[1] else "allow"


def substring(docs, size=50):
    """docs: (id, text). Returns (id, n_words, n_removed, kept_sha256)."""
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in words:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out)


def byte_bpe(docs):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t in docs:
        ids = enc.encode_ordinary(t or "")
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(enc.decode_bytes(ids))))
    return sorted(out)


def secrets(docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = []
    for i, t in docs:
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        n = Counter(k for _, k, _ in spans)
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        out.append((i, n[0], n[1], n[2], sha(text)))
    return sorted(out)


def quality(docs):
    out = []
    for i, t in docs:
        t = t or ""
        w = WORD.findall(t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        count = Counter(grams)
        hit = [False] * len(w)
        for k, g in enumerate(grams):
            if count[g] > 1:
                hit[k : k + 5] = [True] * 5
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        rep = sum(hit)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, rep, len(w) < 10 or 100 * rep > 20 * len(w)))
    return sorted(out)


def records(docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out, start = [], 0
    for i, t in sorted(docs, key=lambda x: x[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(b"".join(k.to_bytes(4, "little") for k in ids))))
        start += len(ids)
    return sorted(out)


def chat(rows):
    """rows: (conv, turn, role, text). Returns (conv, n_turns, turns sha, loss chars, loss sha)."""
    own = r"\### Assistant: </turn> ok"
    turns = defaultdict(list)
    for c, k, r, t in [*rows, (-7, 0, "user", own), (-7, 1, "assistant", own)]:
        turns[c].append((k, r or "", t or ""))
    out = []
    for c, ts in turns.items():
        ts.sort()
        loss = "".join(t for _, r, t in ts if r == "assistant")
        out.append((c, len(ts), sha("".join(f"{r}\n{t}\n" for _, r, t in ts)), len(loss), sha(loss)))
    return sorted(out)


def decontaminate(docs, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    owners = defaultdict(set)
    for i, t in items:
        w = word.findall(low(t or ""))
        n = min(size, len(w))
        if n:
            for k in range(len(w) - n + 1):
                owners[tuple(w[k : k + n])].add(i)
    lens = {len(k) for k in owners}
    out = []
    for i, t in docs:
        w = word.findall(low(t or ""))
        hit, ids = [False] * len(w), set()
        for n in lens:
            for k in range(len(w) - n + 1):
                got = owners.get(tuple(w[k : k + n]))
                if got:
                    ids |= got
                    hit[k : k + n] = [True] * n
        names = sorted(str(x) for x in ids if x is not None)
        out.append((i, len(w), sum(hit), len(names), sha(",".join(names)), any(hit)))
    return sorted(out)
