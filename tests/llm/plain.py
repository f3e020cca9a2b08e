"""Plain versions of the operators, for small tables."""

import hashlib
import html as entities
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text):
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", lowered(text)) if w]
    if not words:
        return set()
    return {tuple(words[k:k + 5]) for k in range(max(len(words) - 4, 1))}


def groups(names, links):
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


def near_duplicates(rows):
    """rows (doc_id, text) with distinct ids -> {doc_id: (n_shingles, component)}."""
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = groups(sets, links)
    return {i: (len(s), root[i]) for i, s in sets.items()}


def contamination(rows, items):
    """rows (doc_id, text), items (item_id, text) -> {doc_id: (n_words, n_hit, n_items, sha256)}."""
    windows = {}
    for item, text in items:
        ws = WORD.findall(lowered(text))
        for k in range(max(len(ws) - 9, 1) if ws else 0):
            windows.setdefault(tuple(ws[k:k + 10]), set()).add(item)
    out = {}
    for doc, text in rows:
        ws, hit, held = WORD.findall(lowered(text)), set(), set()
        for window, names in windows.items():
            for k in range(len(ws) - len(window) + 1):
                if tuple(ws[k:k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    held |= names
        names = sorted(str(x) for x in held if x is not None)
        out[doc] = (len(ws), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest())
    return out


def lines(rows):
    """rows (doc_id, text) -> list of (doc_id, n_lines, n_dropped, kept)."""
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(lowered(line.strip(" \t\n\x0b\x0c\r")), set()).add(doc)
    out = []
    for doc, text in rows:
        all_lines = (text or "").split("\n")
        kept = []
        for line in all_lines:
            key = lowered(line.strip(" \t\n\x0b\x0c\r"))
            docs = held[key]
            keeper = max((d for d in docs if d is not None), default=None)
            if len(key) < 20 or len(docs) < 3 or (doc is not None and doc == keeper):
                kept.append(line)
        out.append((doc, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def held_out(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def variants(rows):
    """rows (doc_id, text) -> list of (word, form, root, n, n_near, form_n)."""
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    words = {w: c for w, c in n.items() if c > 1}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and v != w and one_edit(v, w)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: v if v and words[v] >= 10 * words[w] else None for w, v in best.items()}
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def token_spans(byte_file, piece_model, text):
    """((id, first byte, end) of A, the same of B) of blank + text, or None where a tokenizer does not give it back."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(byte_file), sentencepiece.SentencePieceProcessor(model_file=piece_model)
    a.encode_special_tokens = True
    back = {}
    for byte in range(256):
        back[chr(byte) if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174 else chr(256 + sum(c >= chr(256) for c in back))] = byte
    first = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    second = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    spans = []
    for tokens in (first, second):
        at, row = 0, []
        for i, x in tokens:
            row.append((i, at, at + len(x)))
            at += len(x)
        spans.append(row)
        if b"".join(x for _, x in tokens) != (" " + text).encode():
            return None
    return spans


def alignments(rows, byte_file, piece_model):
    """rows (doc_id, text) -> list of (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    docs, held = [], Counter()
    for doc, text in rows:
        spans = token_spans(byte_file, piece_model, text) if text else None
        if not spans:
            docs.append((doc, None))
            continue
        a, b = spans
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        held.update(set(links))
        groups, low = [], 0
        for cut in sorted({x[2] for x in a} & {y[2] for y in b}):
            groups.append("|".join(",".join(str(t[0]) for t in row if low < t[2] <= cut) for row in (a, b)))
            low = cut
        docs.append((doc, (len(a), len(b), groups, links)))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return [
        (doc, 0, 0, 0, 0, 0, 0, "") if d is None else
        (doc, d[0], d[1], len(d[2]), len(d[3]), sum(held[x] == top[x[0]] for x in d[3]), sum(held[x] for x in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest())
        for doc, d in docs
    ]


def rule_measures(rows):
    """rows (doc_id, text) -> list of (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    out = []
    for doc, text in rows:
        text = text or ""
        words = re.findall("[^ \t\n\x0b\x0c\r]+", text)
        lines = [x for x in text.split("\n") if re.search("[^ \t\n\x0b\x0c\r]", x)]
        windows = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
        repeat = {k + j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
        out.append((doc, len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), failed))
    return out


# Visible text and links by plain patterns, for pages that close their tags; quadratic on others.
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|template|noscript)\b.*?</\1\s*>|<!--.*|<(?:script|style|template|noscript)\b.*", re.S | re.I)
_BREAKS = re.compile(r"</?(?:address|article|aside|blockquote|br|div|dd|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|title|tr|ul)\b[^>]*>", re.I)
_LINKS = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title\s*>", re.S | re.I)


def page_parts(page):
    """(visible text, title or None, links) of a page."""
    text = re.sub(r"<[a-zA-Z/!?][^>]*>", "", _BREAKS.sub("\n", _HIDDEN.sub(" ", page).replace("\n", " ")))
    lines = (re.sub(r"[ \t\r\f\v]+", " ", line).strip() for line in entities.unescape(text).split("\n"))
    title = _TITLE.search(page)
    return "\n".join(x for x in lines if x), title and title[1], [next(x for x in m.groups() if x is not None) for m in _LINKS.finditer(page)]
