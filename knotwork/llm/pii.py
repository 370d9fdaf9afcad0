"""Personal data by fixed patterns and a semi-Markov conditional random field.

The base patterns give email, ip, card and phone spans. The field adds others
(obfuscated addresses, national phone numbers, bank accounts, social security
numbers, access keys): features of a whole span (its shape, check digits, the
word before it) score every candidate segment of up to MOST tokens, and dynamic
programming over segments chooses boundaries and types jointly. A segment holds
a digit, an @ or a spelled-out "at", and lies within NEAR characters of it, so
only the neighbourhoods of those need the search; elsewhere "no entity" is the
sole path. Its weights are trained on the driver, from generated sentences, by
gradient ascent on the conditional likelihood (forward-backward over segments).

Entities are bounded: one of more than NEAR characters or MOST tokens, such as a
signed web token or a key file in lines, can't be a span of the field.

Defined cases: null and empty texts have no spans; repeated rows give equal
rows; a field's span that overlaps a base span is dropped; positions are code
points.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from . import common

#: The base patterns, in the order in which kinds are listed.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
ADDED = ("iban", "ssn", "key")
KINDS = (*BASE, *ADDED)
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
TRIGGER = re.compile(r"[0-9@]|[\[( ](?:at|AT)[\]) ]")
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
NEAR, MOST = 60, 12
TYPES = ("none", "email", "phone", "iban", "ssn", "key")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str):
    """Matches of the email pattern, found from the @ signs: scanning for local parts everywhere is slow."""
    at, begin = text.find("@"), 0
    while at >= 0:
        start = at
        while start > begin and LOCAL.match(text[start - 1]):
            start -= 1
        m = BASE["email"].match(text, start) if start < at else None
        if m:
            yield m.start(), m.end()
            begin = m.end()
            at = text.find("@", begin)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *x) for x in _emails(text)]
    out += [("ip", *m.span()) for m in BASE["ip"].finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))]
    for m in BASE["card"].finditer(text):
        digits = re.sub(r"[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in BASE["phone"].finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def _iban(s: str) -> bool:
    s = re.sub(r"\s", "", s)
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


SHAPES = {
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "phone3": re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
    "phone2": re.compile(r"0[0-9]{1,4}[ /.-][0-9]{2,4}([ .-]?[0-9]{2,4}){1,3}"),
    "at": re.compile(r"[A-Za-z][\w.]* ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z][\w-]*(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?[A-Za-z]{2,}|\.[A-Za-z]{2,}| (?:dot|DOT) [A-Za-z]{2,})+"),
    "at words": re.compile(r"[A-Za-z][\w.]* (?:at|AT) [A-Za-z][\w-]*(?: (?:dot|DOT) [A-Za-z]{2,})+"),
    "access": re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}"),
    "token": re.compile(r"(?:sk|pk|ghp|xoxb|glpat)[-_][A-Za-z0-9_-]{16,}"),
    "random": re.compile(r"(?=[^ ]*[0-9])(?=[^ ]*[A-Za-z])[A-Za-z0-9+/=_-]{20,}"),
}
CUES = {"ssn": "ssn", "social": "ssn", "security": "ssn", "phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "iban": "iban", "account": "iban", "mail": "mail", "email": "mail", "contact": "mail", "key": "key", "token": "key", "secret": "key", "password": "key"}


@lru_cache(20_000)
def features(span: str, tokens: int, before: str) -> tuple[str, ...]:
    """Of a whole span; before is the word in front of it."""
    found = [f"shape:{k}" for k, p in SHAPES.items() if p.fullmatch(span)]
    if _iban(span):
        found.append("shape:iban")
    if not found:
        digits = sum(c.isdigit() for c in span)
        found = ["plain", f"digits:{min(digits, 6)}"]
    return (*found, f"tokens:{min(tokens, 4)}", "cue:" + CUES.get(before.lower(), "-"))


class Field:
    """Weights by (type, feature); segments of type none are single tokens and score 0."""

    def __init__(self, weights: dict[tuple[str, str], float]):
        self.weights = weights

    def segments(self, text: str, tokens: list[tuple[int, int]]):
        """For each end the candidate (begin, span, features)."""
        out: list[list] = [[] for _ in range(len(tokens) + 1)]
        for i in range(len(tokens)):
            before = text[slice(*tokens[i - 1])] if i else ""
            if before == ":" and i > 1:
                before = text[slice(*tokens[i - 2])]
            for j in range(i + 1, min(len(tokens), i + MOST) + 1):
                start, end = tokens[i][0], tokens[j - 1][1]
                if end - start > NEAR:
                    break
                span = text[start:end]
                if TRIGGER.search(span):
                    out[j].append((i, features(span, j - i, before)))
        return out

    def score(self, kind: str, fs) -> float:
        return sum(self.weights.get((kind, f), 0.0) for f in fs) - 2.0

    def best(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        ends = self.segments(text, tokens)
        top: list[tuple[float, str, int]] = [(0.0, "", 0)]
        for j in range(1, len(tokens) + 1):
            best = (top[j - 1][0], "none", j - 1)
            for i, fs in ends[j]:
                for kind in TYPES[1:]:
                    if (s := top[i][0] + self.score(kind, fs)) > best[0]:
                        best = (s, kind, i)
            top.append(best)
        out, j = [], len(tokens)
        while j:
            _, kind, i = top[j]
            if kind != "none":
                out.append((kind, tokens[i][0], tokens[j - 1][1]))
            j = i
        return out[::-1]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        out, end = [], -1
        for m in TRIGGER.finditer(text):
            if m.start() < end:
                continue
            start = max(0, end, m.start() - NEAR)
            end = m.end() + NEAR
            while (n := TRIGGER.search(text, m.end(), end)) is not None:  # one neighbourhood as long as triggers follow
                m, end = n, n.end() + NEAR
            while 0 < start and text[start - 1].isalnum() and text[start].isalnum():
                start -= 1
            while end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
                end += 1
            part = text[start:end]
            out += [(k, a + start, b + start) for k, a, b in self.best(part, [t.span() for t in TOKEN.finditer(part)])]
        return out


def generated(n: int, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences with planted entities, and with numbers that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("etaoinshrdlu", k=r.randint(2, 8)))
    digits = lambda k: "".join(r.choices("0123456789", k=k))

    def iban():
        body = "".join(r.choices("0123456789", k=18))
        return next(s for c in range(98) if _iban(s := f"DE{c:02d}{body}"))

    makers = {
        "email": lambda: r.choice(["{0} at {1} dot com", "{0} [at] {1} [dot] org", "{0} (at) {1}.net", "{0}.{1} at {1} dot de"]).format(word(), word()),
        "phone": lambda: r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}"]),
        "iban": iban,
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "key": lambda: r.choice(["AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16)), "sk-" + "".join(r.choices("abcdefXYZ0123456789", k=24))]),
        "none": lambda: r.choice([digits(r.randint(1, 7)), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}", f"{word()} at {word()}", f"{word()} at {word()}. {word()}", f"{digits(1)},{digits(3)}", f"{digits(3)} {digits(3)}"]),
    }
    cues = {"email": ["contact", "mail:"], "phone": ["call", "tel:"], "iban": ["iban", "account:"], "ssn": ["ssn", "ssn:"], "key": ["key", "token:"]}
    out = []
    for _ in range(n):
        text, marks = word(), []
        for _ in range(r.randint(1, 2)):
            kind = r.choice([*makers, "none", "none"])
            text += " " + " ".join(word() for _ in range(r.randint(0, 2)))
            if kind in cues and r.random() < 0.5:
                text += " " + r.choice(cues[kind])
            value = makers[kind]()
            start = len(text) + 1
            text += " " + value
            if kind != "none":
                marks.append((kind, start, start + len(value)))
        out.append((text + " " + word(), marks))
    return out


def train(sentences=None, rounds: int = 6, rate: float = 0.5) -> Field:
    """Conditional likelihood by stochastic gradient; expected counts from forward and backward sums over segments."""
    field = Field({})
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    for step in range(rounds):
        for text, marks in sentences or generated(250):
            tokens = [t.span() for t in TOKEN.finditer(text)]
            ends, n = field.segments(text, tokens), len(tokens)
            arcs = [(i, j, k, fs, field.score(k, fs)) for j in range(n + 1) for i, fs in ends[j] for k in TYPES[1:]]
            into, outof = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
            for arc in arcs:
                into[arc[1]].append(arc)
                outof[arc[0]].append(arc)
            forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                forward[j] = forward[j - 1]
                for i, _, _, _, s in into[j]:
                    forward[j] = add(forward[j], forward[i] + s)
            for i in range(n - 1, -1, -1):
                backward[i] = backward[i + 1]
                for _, j, _, _, s in outof[i]:
                    backward[i] = add(backward[i], backward[j] + s)
            gold = set(marks)
            eta = rate / (1 + step)
            for i, j, k, fs, s in arcs:
                p = math.exp(min(0.0, forward[i] + s + backward[j] - forward[n]))
                if g := ((k, tokens[i][0], tokens[j - 1][1]) in gold) - p:
                    if abs(g) > 1e-4:
                        for f in fs:
                            field.weights[k, f] = field.weights.get((k, f), 0.0) + eta * g
    return field


def find(text: str, field: Field) -> tuple[list, list]:
    """(base spans, all spans), each sorted by kind as listed, then start."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    more = [s for s in field.spans(text) if not any(a < s[2] and s[1] < b for a, b in taken)] if TRIGGER.search(text) else []
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    return sorted(base, key=order), sorted(base + more, key=order)


SPAN = "array<struct<kind:string,start:int,end:int>>"


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end): one row per document."""
    model = field or train()

    def start():
        def made(texts):
            both = [find(t, model) for t in texts]
            tell = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
            return {"base": [tell(b) for b, _ in both], "spans": [tell(s) for _, s in both]}

        return made

    return common.per_text(docs, f"base {SPAN}, spans {SPAN}", start)


def query(spark, sf_dir):
    from pyspark.sql import functions as F

    out = personal_data(common.documents(spark, sf_dir))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), F.size("spans").cast("long").alias("n_spans"), listed("spans").alias("spans"))
