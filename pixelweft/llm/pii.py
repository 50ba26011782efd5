"""Personal data: exact base patterns, and a semi-Markov conditional random field for what they miss.

Base spans (email, ip, card, phone) are found by rule over the whole text, without quadratic scans. The
model looks at islands around cues (an @ or a spelled-out "at", or seven digits and more) that lie outside
base spans; they are searched between base spans, so a number next to one is a cue of its own. It scores
whole candidate segments of up to 16 tokens by features of the span (digits, groups, separators, Luhn, octets, domain shape, neighbours) times weights of a type, plus type transitions; a
bounded-entity dynamic program picks boundaries and types jointly, in time linear in the island, whose tokens
are read as a stream: what is held per token is two positions and two small back pointers. An island is the cues
less than ``context`` characters apart and so many characters around them, so a hint word farther away is not
seen. Base spans stay and bound the islands. It is trained here, on sentences from a seeded generator with look-alikes
(dates, prices, versions, order numbers) as negatives, by exact gradients of the likelihood.

Edge cases: null and empty texts have no spans; repeated rows are scanned each; very long numbers, runs and
texts take linear time; spans of different kinds may overlap in the base; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from array import array
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import trimmed

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_not_digit = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        before = text[last:at]
        start = at - (len(before) - len(before.rstrip(_LOCAL)))
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", last)
    for m in _ip.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _card.finditer(text):
        if m.end() - m.start() >= 14:
            d = _not_digit.sub("", m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _phone.finditer(text):
            if 10 <= len(_not_digit.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the model -------------------------------------------------------------------------------------

LABELS = ("other", *KINDS)
LONGEST = 16
_token = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
_digits_cue = re.compile(r"[0-9](?:[ ().+/-]{0,3}[0-9]){6,}")
_at_cue = re.compile("@")
#: From the spelled-out "at" on; the name before it is found by going back, so no run is scanned twice.
_spelled_cue = re.compile(r"(?:\(at\)|\[at\]| at ) ?[\w-]++ ?(?:\(dot\)|\[dot\]| dot )", re.I)
_name_end = re.compile(r"[\w.-]")
#: Words that tell what a number is (fixed values).
HINTS = {
    "email": {"email", "mail", "e-mail", "contact", "write", "address", "correo", "courriel"},
    "ip": {"ip", "host", "server", "address", "ping", "gateway"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "carte", "karte", "tarjeta"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell", "telefon"},
}
N_FEATURES = 34


class Tokens:
    """Tokens of a stretch of text as two flat arrays of positions, with the digits before each counted up."""

    def __init__(self, text: str, lo: int = 0, hi: int | None = None):
        self.text, self.start, self.end, self.digits = text, array("q"), array("q"), array("q", [0])
        for m in _token.finditer(text, lo, len(text) if hi is None else hi):
            a, b = m.span()
            self.start.append(a)
            self.end.append(b)
            self.digits.append(self.digits[-1] + (b - a if "0" <= text[a] <= "9" else 0))

    def __len__(self) -> int:
        return len(self.start)


def _features(tokens: Tokens, i: int, j: int) -> list[float]:
    """Features of the segment of tokens i..j-1 as a whole."""
    text, starts, ends = tokens.text, tokens.start, tokens.end
    a, b = starts[i], ends[j - 1]
    s = text[a:b]
    digits = _not_digit.sub("", s)
    n = len(digits)
    letters = sum(c.isalpha() for c in s)
    words = [text[starts[k] : ends[k]].lower() for k in range(i, j)]
    left = [text[starts[k] : ends[k]].lower() for k in range(max(0, i - 3), i)]
    parts = s.split(".")
    octets = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    groups = tuple(len(g) for g in re.split(r"[^0-9]+", s) if g)
    at = "@" in s or "at" in words
    dot = "." in s or "dot" in words
    domain = at and dot and words[-1].isalpha() and 2 <= len(words[-1]) <= 6 and not words[0] in "([.-@"
    only = not letters and all(c in "0123456789 ().+-" for c in s)
    f = [0.0] * N_FEATURES
    f[0] = 1
    f[1] = j - i == 1
    f[2] = n == 0
    f[3] = 1 <= n <= 6
    f[4] = 7 <= n <= 9
    f[5] = n in (10, 11)
    f[6] = 12 <= n <= 13
    f[7] = 14 <= n <= 19
    f[8] = n > 19
    f[9] = 13 <= n <= 19 and luhn(digits)
    f[10] = octets
    f[11] = domain
    f[12] = at and not domain
    f[13] = only and n >= 7
    f[14] = only and groups[-2:] == (3, 4) and len(groups) <= 4 and n >= 10
    f[15] = only and groups == (3, 4)
    f[16] = only and len(groups) == 4 and set(groups) == {4}
    f[17] = s[0] in "+(" and s.count("(") == s.count(")")
    f[18] = s[0] in ").,-/:;" or s[-1] in "(+.,-/:;"
    f[19] = letters > 0 and n > 0 and not at
    f[20] = letters > 0 and not n
    f[21] = (j - i) / LONGEST
    f[22] = i > 0 and ends[i - 1] == a and text[a - 1] not in ",;:(\"'"
    f[23] = j < len(tokens) and starts[j] == b and text[b] not in ",;.:)\"'!?"
    f[24] = i > 0 and text[starts[i - 1]].isdigit()
    f[25] = j < len(tokens) and text[starts[j]].isdigit()
    for k, kind in enumerate(KINDS):
        f[26 + k] = any(w in HINTS[kind] for w in left)
    f[30] = only and s.count("(") == 1 and s.count(")") == 1
    f[31] = "/" in s or ":" in s or "$" in s
    f[32] = len(groups) == 3 and groups[0] == 4 and groups[1:] == (2, 2)
    f[33] = only and len(groups) == 1 and n >= 7
    return f


#: What a span of a type must look like at least; segments that don't are no candidates for it.
_at = r"(?:[\w.+-]+ ?@ ?[\w-]+(?: ?\. ?[\w-]+)+|[\w.+-]+ ?(?:\(at\)|\[at\]|\bat\b) ?[\w-]+(?: ?(?:\(dot\)|\[dot\]|\bdot\b) ?[\w-]+)+)"
SHAPES = tuple(re.compile(x, re.I) for x in (_at, r"[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}", r"[0-9]{4}(?:[ .-]?[0-9]){9,15}", r"[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,14}"))


def _shapes(s: str, digits: int) -> list[bool]:
    """Which types a segment with so many digits could be; what its digits rule out is not matched."""
    return [
        ("@" in s or "at" in s.lower()) and SHAPES[0].fullmatch(s) is not None,
        4 <= digits <= 12 and SHAPES[1].fullmatch(s) is not None and all(int(x) <= 255 for x in s.split(".")),
        13 <= digits <= 19 and SHAPES[2].fullmatch(s) is not None and luhn(_not_digit.sub("", s)),
        7 <= digits <= 15 and SHAPES[3].fullmatch(s) is not None,
    ]


def _inside_number(text: str, start: int, end: int) -> bool:
    """Whether digits go on behind a hyphen on either side: a part of a longer number (an ISBN, an account) is no span."""
    before = start >= 2 and text[start - 1] == "-" and text[start - 2].isdigit()
    return before or (end + 1 < len(text) and text[end] == "-" and text[end + 1].isdigit())


def _segments(tokens: Tokens, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(end, length, feature) and the allowed (end, length, label) of the segments that end with tokens first .. last - 1;
    a length that reaches over the start is left at 0."""
    last = len(tokens) if last is None else last
    out, may = np.zeros((last - first, LONGEST, N_FEATURES)), np.zeros((last - first, LONGEST, len(LABELS)), bool)
    may[:, 0, 0] = True
    for e in range(first + 1, last + 1):
        end, digits = tokens.end[e - 1], tokens.digits[e]
        for k in range(1, min(LONGEST, e) + 1):
            found = _shapes(tokens.text[tokens.start[e - k] : end], digits - tokens.digits[e - k])
            if (found[1] or found[3]) and _inside_number(tokens.text, tokens.start[e - k], end):
                found[1] = found[3] = False
            may[e - 1 - first, k - 1, 1:] = found
            if k == 1 or any(found):
                out[e - 1 - first, k - 1] = _features(tokens, e - k, e)
    return out, may


class SemiMarkov:
    def __init__(self):
        self.w = np.zeros((N_FEATURES, len(LABELS)))
        self.t = np.zeros((len(LABELS), len(LABELS)))

    def scores(self, seg: np.ndarray, may: np.ndarray) -> np.ndarray:
        return np.where(may, seg @ self.w, -1e9)  # what is no entity goes token by token

    def _step(self, s: np.ndarray, before: np.ndarray, e: int) -> np.ndarray:
        k = min(LONGEST, e)
        return s[e - 1, :k] + before[e - k : e][::-1]

    def decode(self, tokens: Tokens, chunk: int = 512) -> list[tuple[int, int, int]]:
        """The best segmentation's entities: (first token, end token, label). Segments are scored ``chunk`` ends at a time."""
        n = len(tokens)
        came, best_prev = np.zeros((n + 1, len(LABELS)), np.int8), np.zeros((n + 1, len(LABELS)), np.int8)
        before = np.zeros((LONGEST, len(LABELS)))  # of the last ends, the latest first
        last = None
        for lo in range(0, n, chunk):
            s = self.scores(*_segments(tokens, lo, min(n, lo + chunk)))
            for e in range(lo + 1, min(n, lo + chunk) + 1):
                x = s[e - 1 - lo, : min(LONGEST, e)] + before[: min(LONGEST, e)]
                came[e] = x.argmax(0) + 1
                last = x.max(0)
                to = last[:, None] + self.t
                best_prev[e] = to.argmax(0)
                before[1:] = before[:-1].copy()
                before[0] = to.max(0)
        out, e, y = [], n, int(last.argmax()) if n else 0
        while e > 0:
            k = int(came[e, y])
            if y:
                out.append((e - k, e, y))
            e -= k
            y = int(best_prev[e, y]) if e > 0 else 0
        return out[::-1]

    def gradient(self, seg: np.ndarray, may: np.ndarray, gold: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the log likelihood of a full segmentation (first token, end token, label)."""
        n, s = len(seg), self.scores(seg, may)
        a, before = np.zeros((n + 1, len(LABELS))), np.zeros((n + 1, len(LABELS)))
        for e in range(1, n + 1):
            a[e] = np.logaddexp.reduce(self._step(s, before, e), axis=0)
            before[e] = np.logaddexp.reduce(a[e][:, None] + self.t, axis=0)
        z = np.logaddexp.reduce(a[n])
        after = np.zeros((n + 1, len(LABELS)))  # weight of what follows a segment that ends here
        gw, gt = np.zeros_like(self.w), np.zeros_like(self.t)
        for b in range(n - 1, -1, -1):
            k = min(LONGEST, n - b)
            own = s[np.arange(b, b + k), np.arange(k)] + after[b + 1 : b + k + 1]
            p = np.exp(own + before[b] - z)
            gw -= seg[np.arange(b, b + k), np.arange(k)].T @ p
            start = np.logaddexp.reduce(own, axis=0)
            if b:
                gt -= np.exp(a[b][:, None] + self.t + start[None] - z)
                after[b] = np.logaddexp.reduce(self.t + start[None], axis=1)
        for i, (b, e, y) in enumerate(gold):
            gw[:, y] += seg[e - 1, e - b - 1]
            if i:
                gt[gold[i - 1][2], y] += 1
        return gw, gt


def synthetic(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Sentences with labelled spans (start, end, label) and unlabelled look-alikes."""
    r = random.Random(seed)
    syllables = ("an", "the", "or", "ti", "ing", "mo", "la", "es", "ver", "on", "ble", "re")
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    digits = lambda k: "".join(str(r.randint(0, 9)) for _ in range(k))

    def email():
        at, dot = r.choice((("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", ".")))
        return word() + r.choice(("", "." + word(), digits(2))) + at + word() + dot + r.choice(("com", "org", "net", "de"))

    def card():
        d = "4" + digits(r.choice((12, 14, 14, 14)))
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        return r.choice((d, " ".join(d[i : i + 4] for i in range(0, len(d), 4)), "-".join(d[i : i + 4] for i in range(0, len(d), 4)), ".".join(d[i : i + 4] for i in range(0, len(d), 4))))

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 {a} {b} {c}", f"1-{a}-{b}-{c}", f"{b}-{c}"))

    def other():
        bad = "4" + digits(14)
        bad += next(str(c) for c in range(10) if not luhn(bad + str(c)))
        return r.choice((f"{r.randint(1900, 2030)}-{digits(2)}-{digits(2)}", f"${digits(3)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", digits(r.choice((7, 8, 9, 12, 20, 24))), bad, f"{digits(2)}/{digits(2)}/{digits(4)}", f"@{word()}", f"{word()} at {word()}", f"{word()}. At {word()}", f'token = "{r.getrandbits(160):x}"', f"{digits(3)}.{r.randint(256, 999)}.{digits(3)}.{digits(3)}", f"{digits(4)} {digits(4)}"))

    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(1, 3))), []
        for _ in range(r.randint(1, 2)):
            y = r.choice((0, 0, 0, 1, 2, 3, 4, 4))
            if y and (r.random() < 0.5):
                text += " " + r.choice(sorted(HINTS[KINDS[y - 1]])) + r.choice(("", ":"))
            text += " "
            entity = (other, email, lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), card, phone)[y]()
            if y == 4 and re.fullmatch(r"\d{3}-\d{4}", entity) and not re.search(r"(phone|tel|call|mobile|fax|cell)\w*:? $", text):
                y = 0
            if y:
                spans.append((len(text), len(text) + len(entity), y))
            text += entity + r.choice(("", ".", ",")) + " " + word()
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def trained(examples: int = 260, epochs: int = 6, seed: int = 17, rate: float = 0.4, l2: float = 1e-3) -> SemiMarkov:
    """The model, fitted by Adagrad on generated sentences; the same on every machine."""
    model, data = SemiMarkov(), []
    for text, spans in synthetic(examples, seed):
        tokens = Tokens(text)
        gold, i = [], 0
        while i < len(tokens):
            hit = next((s for s in spans if s[0] == tokens.start[i]), None)
            j = i + 1
            while hit and j < len(tokens) and tokens.end[j] <= hit[1]:
                j += 1
            if hit and j - i > LONGEST:
                hit, j = None, i + 1
            gold.append((i, j, hit[2] if hit else 0))
            i = j
        data.append((*_segments(tokens), gold))
    hw, ht = np.full_like(model.w, 1e-6), np.full_like(model.t, 1e-6)
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for seg, may, gold in data:
            gw, gt = model.gradient(seg, may, gold)
            gw -= l2 * model.w
            hw += gw * gw
            ht += gt * gt
            model.w += rate * gw / np.sqrt(hw)
            model.t += rate * gt / np.sqrt(ht)
    return model


def added_spans(text: str, base: list[tuple[int, int, int]], model: SemiMarkov, context: int = 40) -> list[tuple[int, int, int]]:
    """(start, kind number, end) that the model finds outside base spans."""
    covered: list[tuple[int, int]] = []  # base spans, overlapping ones joined
    for a, _, b in base:
        if covered and a <= covered[-1][1]:
            covered[-1] = (covered[-1][0], max(covered[-1][1], b))
        else:
            covered.append((a, b))
    starts, ends = [a for a, _ in covered], [b for _, b in covered]
    lower = text.lower()
    spelled = "dot" in lower and "at" in lower
    cues = []
    for p, q in zip([0, *ends], [*starts, len(text)], strict=True):  # a cue never reaches into a base span
        cues += [m.span() for m in _digits_cue.finditer(text, p, q)]
        if "@" in text:
            cues += [(m.start(), m.end()) for m in _at_cue.finditer(text, p, q)]
        if spelled:
            here = p
            for m in _spelled_cue.finditer(text, p, q):
                a = m.start() - (m.start() > here and text[m.start() - 1] == " ")
                start = a
                while start > here and _name_end.match(text, start - 1):
                    start -= 1
                if start < a:
                    cues.append((start, m.end()))
                here = m.end()
    cues.sort()
    out: list[tuple[int, int, int]] = []
    at = 0
    while at < len(cues):
        a, b = cues[at]
        at += 1
        while at < len(cues) and cues[at][0] <= b + context:
            b = max(b, cues[at][1])
            at += 1
        before, after = bisect_right(ends, a), bisect_left(starts, b)
        lo = max(0, a - context, *ends[max(0, before - 1) : before])
        hi = min(len(text), b + context, *starts[after : after + 1])
        while lo > 0 and lo < a and not text[lo - 1].isspace() and not (before and lo == ends[before - 1]):
            lo += 1
        while hi < len(text) and hi > b and not text[hi].isspace() and not (after < len(starts) and hi == starts[after]):
            hi -= 1
        pieces, here = [], lo
        for s, e in covered[before:after]:
            pieces.append((here, s))
            here = max(here, e)
        pieces.append((here, hi))
        for p, q in pieces:
            tokens = Tokens(text, p, q)
            out += [(tokens.start[i], y - 1, tokens.end[j - 1]) for i, j, y in model.decode(tokens)]
    return sorted(set(out))


def find(text: str | None, model: SemiMarkov) -> tuple[list, list]:
    """Base spans, and all spans sorted by start and kind."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base, model))


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, .., base_sha256, spans, added_email, ..): n_ counts base spans, added_ the model's."""
    model = trained()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", *(f"added_{k}" for k in KINDS)]

    def run(batches):
        for batch in batches:
            n, added, digest, spans = [[], [], [], []], [[], [], [], []], [], []
            for t in batch.column(1):
                base, every = find(t.as_py(), model)
                for k in range(4):
                    n[k].append(sum(1 for x in base if x[1] == k))
                    added[k].append(sum(1 for x in every if x[1] == k) - n[k][-1])
                digest.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                spans.append(_listed(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in n), pa.array(digest, pa.string()), pa.array(spans, pa.string()), *(pa.array(c, pa.int64()) for c in added)], names)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, " + ", ".join(f"added_{k} long" for k in KINDS))


def redacted(text: str | None, model: SemiMarkov) -> str | None:
    """The text with each span, overlapping ones joined, replaced by its kind in angle brackets."""
    _, spans = find(text, model)
    if not spans:
        return text
    out, here = [], 0
    for a, k, b in spans:
        if a >= here:
            out += [text[here:a], f"<{KINDS[k].upper()}>"]
        here = max(here, b)
    return "".join(out) + text[here:]


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced in text, and n_chars (if there) counted anew."""
    model, schema = trained(), docs.schema

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            old = batch.column(at).to_pylist()
            new = [redacted(t, model) for t in old]
            cols = list(batch.columns)
            cols[at] = pa.array(new, pa.string())
            if (n := batch.schema.get_field_index("n_chars")) >= 0:
                cols[n] = pa.array([c if x == y or y is None else len(y) for c, x, y in zip(cols[n].to_pylist(), old, new, strict=True)], cols[n].type)
            yield pa.RecordBatch.from_arrays(cols, list(batch.schema.names))

    return docs.mapInArrow(trimmed(run), schema)
