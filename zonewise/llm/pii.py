"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The field scores whole candidate spans of up to ``MAX_WORDS`` words: shape, digit
count, check sums, character set and the words around it. A Viterbi pass over
segments of bounded length picks boundaries and kinds together, so two numbers
side by side come apart where one greedy pattern would swallow both. Spans of the
fixed patterns always stay; the field's spans are added where they overlap none.

The field is trained here, on sentences made by ``samples`` from a fixed seed:
entities of all kinds between filler words, and numbers that are none. Training
maximises the conditional log-likelihood by forward-backward over segments. Its
weights are kept in ``field.json``, which ``python -m zonewise.llm.pii`` writes; the
driver reads them and sends them to the workers.

Only words near a digit or an at-sign can hold an entity, so the rest of a text
is skipped in linear time; the fixed patterns are linear too, also on long runs
of digits or letters. Offsets are code points, ends exclusive.

Defined cases: a null or empty text has no spans; repeated rows and ids each come
back; an empty table gives an empty result; other columns are left as they are.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import json
import random
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "ssn", "iban")
#: An entity has at most so many words and characters.
MAX_WORDS, MAX_CHARS = 8, 160

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns: leftmost, non-overlapping within a kind, by kind and start."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        # the domain doesn't depend on where the local part starts: one try for each at-sign is enough
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in PHONE.finditer(text):
            if 9 <= len(DIGIT.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# The field. Label 0 is "no entity"; label k is KINDS[k - 1].

WORD = re.compile(r"\S+")
TRIGGER = re.compile(r"[0-9@]")
OPEN, CLOSE = "\"'`<[{(,;:", "\"'`>]}),;:.!?"


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without punctuation around it; brackets that close inside stay."""
    while end > start and text[end - 1] in CLOSE and not (text[end - 1] in ")]" and {")": "(", "]": "["}[text[end - 1]] in text[start : end - 1]):
        end -= 1
    while start < end and text[start] in OPEN and not (text[start] == "(" and ")" in text[start:end]):
        start += 1
    return start, end


def shape(s: str) -> str:
    s = re.sub(r"[0-9]+", "9", s)
    s = re.sub(r"[A-Z]{2,}", "A", re.sub(r"[a-z]+", "a", s))
    return s[:24]


HEX, UPPER = re.compile(r"[0-9a-f]{12,}"), re.compile(r"[A-Z0-9]{14,}")
MIXED = re.compile(r"[A-Za-z0-9_+/-]{16,}")


def features(text: str, start: int, end: int, n_words: int, left: str, right: str) -> list[str]:
    """Whole-span features."""
    s = text[start:end]
    digits = "".join(DIGIT.findall(s))
    n = len(digits)
    letters = sum(c.isalpha() for c in s)
    head = re.match(r"[A-Za-z_-]*", s)[0].lower()[:10]
    tail = re.split(r"[\s=:\"']+", s)[-1]
    out = ["bias", f"shape={shape(s)}", f"digits={min(n, 24)}", f"words={n_words}", f"left={re.sub(r'[0-9]', '9', left.lower())[-8:]}", f"letters={min(letters, 8)}", f"n_shape={n},{shape(s)[:8]}"]
    if 13 <= n <= 19 and not letters:
        out.append(f"luhn={luhn(digits)},{n_words}")
    if "@" in s:
        out.append(f"at={bool(re.fullmatch(r'[^@ ]+@[^@ ]+[.][A-Za-z0-9-]+', s))}")
    if m := re.fullmatch(r"\S+(?: dot \S+)* ?[\[(]?(?:at|AT)[\])]? ?\S+( ?[\[(]?(?:dot|DOT)[\])]? ?\S+)+", s):
        out += ["spelled", f"spelled={right.lower()[:3] if right.lower() in ('dot', 'at') else ''},{tail[:4].lower()}"]
    if s.count(".") == 3 and re.fullmatch(r"[0-9.]+", s):
        out.append(f"quad={all(len(p) <= 3 and int(p or 0) <= 255 for p in s.split('.'))}")
    if re.fullmatch(r"[0-9A-Fa-f:]+", s) and s.count(":") >= 2:
        out.append(f"colons={min(s.count(':'), 7)}")
    if re.fullmatch(r"\+?[0-9() .-]+", s):
        groups = [len(g) for g in re.findall(r"[0-9]+", s)]
        out.append(f"groups={groups[:6]}")
        out.append(f"plus={s[0] == '+'},{8 < n < 16}")
    if re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,38}", s):
        out.append("iban")
    for name, kind in (("hex", HEX), ("upper", UPPER), ("mixed", MIXED)):
        if kind.fullmatch(tail) and DIGIT.search(tail) and (letters or name == "hex"):
            out.append(f"{name}={letters > 0}")
            out.append(f"{name},{head},{n_words}")
    if "=" in s or ":" in s:
        out += [f"key={head}", f"key={head},{len(tail) > 7}"]
    out.append(f"edge={text[end - 1].isalnum()},{s[0] if not s[0].isalnum() else 'x'}")
    return out


def allowed(text: str, start: int, end: int) -> bool:
    """Whether a span of words may be an entity at all."""
    return 4 <= end - start <= MAX_CHARS and bool(TRIGGER.search(text, start, end) or re.search(r"\b(at|AT)\b", text[start:end]))


def lattice(text: str, words: list[tuple[int, int]]) -> list[list[tuple[int, int, int, list[str]]]]:
    """For each end word j: candidate segments (first word, start, end, features), inclusive of j."""
    out: list[list] = [[] for _ in words]
    hot = [bool(TRIGGER.search(text, a, b)) for a, b in words]
    said = [text[a:b].lower().strip("[]()") for a, b in words]
    for i in range(len(words)):
        left = text[slice(*words[i - 1])] if i else "^"
        spelled = i + 1 < len(words) and (said[i + 1] == "at" or (said[i + 1] == "dot" and said[i + 3 : i + 4] in (["at"], ["dot"])))
        for j in range(i, min(len(words), i + MAX_WORDS)):
            if j > i + 1 and not spelled and not hot[j - 1] and said[j - 1] not in ("=", ":"):
                break  # a plain word inside can't be part of an entity
            start, end = trimmed(text, words[i][0], words[j][1])
            if end - start > MAX_CHARS:
                break
            if not (hot[j] or (spelled and j >= i + 4 and said[j - 1] == "dot")) or start >= end or not allowed(text, start, end):
                continue
            if text[end : words[j][1]].strip(CLOSE) or text[words[i][0] : start].strip(OPEN):
                continue
            right = text[slice(*words[j + 1])] if j + 1 < len(words) else "$"
            out[j].append((i, start, end, features(text, start, end, j - i + 1, left, right)))
    return out


class Field:
    """Weights of a semi-Markov conditional random field: (feature, label) and (label before, label)."""

    def __init__(self) -> None:
        self.weights: dict[str, np.ndarray] = {}
        self.moves = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def score(self, names: list[str]) -> np.ndarray:
        total = np.zeros(len(KINDS) + 1)
        for name in names:
            if (w := self.weights.get(name)) is not None:
                total += w
        return total

    def plain(self, text: str, word: tuple[int, int]) -> list[str]:
        s = text[slice(*word)]
        return ["plain", f"plain={shape(s)[:8]}", f"plain_n={min(len(DIGIT.findall(s)), 12)}"]

    def segments(self, text: str, words: list[tuple[int, int]]) -> list[list[tuple[int, int, int, list[str], np.ndarray]]]:
        """Candidates by end word, with label scores; impossible labels have -inf."""
        out = []
        for j, found in enumerate(lattice(text, words)):
            rows = []
            for i, a, b, names in found:
                score = self.score(names)
                score[0] = -np.inf
                rows.append((i, a, b, names, score))
            names = self.plain(text, words[j])
            score = np.full(len(KINDS) + 1, -np.inf)
            score[0] = self.score(names)[0]
            rows.append((j, *words[j], names, score))
            out.append(rows)
        return out

    def best(self, text: str, words: list[tuple[int, int]]) -> list[Span]:
        """Viterbi over segments."""
        n = len(words)
        value = np.full((n + 1, len(KINDS) + 1), -np.inf)
        value[0, 0] = 0.0
        back: list[list] = [[None] * (len(KINDS) + 1) for _ in range(n + 1)]
        for j, rows in enumerate(self.segments(text, words)):
            for i, a, b, _, score in rows:
                total = value[i][:, None] + self.moves + score[None, :]
                came = total.argmax(axis=0)
                got = total[came, np.arange(total.shape[1])]
                for y in np.flatnonzero(got > value[j + 1]):
                    value[j + 1, y] = got[y]
                    back[j + 1][y] = (i, int(came[y]), a, b)
        out: list[Span] = []
        j, y = n, int(value[n].argmax())
        while j:
            i, before, a, b = back[j][y]
            if y:
                out.append((KINDS[y - 1], a, b))
            j, y = i, before
        return out[::-1]

    def train(self, data: list[tuple[str, list[Span]]], epochs: int = 4, rate: float = 0.3, decay: float = 1e-4) -> Field:
        """Adaptive gradient steps on the conditional log-likelihood, by forward-backward over segments."""
        n_labels = len(KINDS) + 1
        squares: dict[str, np.ndarray] = {}
        move_squares = np.full_like(self.moves, 1e-6)
        sum_exp = lambda x, axis=0: (m := np.where(np.isfinite(t := x.max(axis=axis)), t, 0.0)) + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis=axis) + 1e-300)
        ready = []
        for text, spans in data:
            words = [m.span() for m in WORD.finditer(text)]
            ready.append((text, words, lattice(text, words), {(a, b): KINDS.index(k) + 1 for k, a, b in spans}))
        for _ in range(epochs):
            for text, words, found, truth in ready:
                n = len(words)
                rows = []
                for j in range(n):
                    own = [(i, a, b, names, np.concatenate(([-np.inf], self.score(names)[1:]))) for i, a, b, names in found[j]]
                    names = self.plain(text, words[j])
                    score = np.full(n_labels, -np.inf)
                    score[0] = self.score(names)[0]
                    rows.append([*own, (j, *words[j], names, score)])
                ahead = np.full((n + 1, n_labels), -1e30)
                ahead[0, 0] = 0.0
                for j in range(n):
                    parts = [sum_exp(ahead[i][:, None] + self.moves) + score for i, _, _, _, score in rows[j]]
                    ahead[j + 1] = np.maximum(sum_exp(np.array(parts)), -1e30)
                after = np.full((n + 1, n_labels), -1e30)
                after[n] = 0.0
                opens: list[list] = [[] for _ in range(n)]
                for j in range(n):
                    for row in rows[j]:
                        opens[row[0]].append((j, row[4]))
                for i in range(n - 1, -1, -1):
                    parts = [sum_exp(self.moves + (score + after[j + 1])[None, :], 1) for j, score in opens[i]]
                    after[i] = np.maximum(sum_exp(np.array(parts)), -1e30)
                whole = after[0, 0]
                inside = [(a, b) for a, b in truth]
                grads: dict[str, np.ndarray] = {}
                move_grad = np.zeros_like(self.moves)
                gold = {}  # end word -> (first word, label) of the true segmentation
                covered = set()
                for j in range(n):
                    for i, a, b, _, _ in rows[j][:-1]:
                        if (a, b) in truth:
                            gold[j] = (i, truth[a, b])
                            covered.update(range(i, j + 1))
                if len(gold) != len(inside):
                    continue  # no candidate has this boundary
                gold |= {j: (j, 0) for j in range(n) if j not in covered}
                last = 0
                for j in sorted(gold):
                    move_grad[last, gold[j][1]] += 1
                    last = gold[j][1]
                for j in range(n):
                    for k, (i, _, _, names, score) in enumerate(rows[j]):
                        joint = np.exp(np.minimum(ahead[i][:, None] + self.moves + score[None, :] + after[j + 1][None, :] - whole, 0.0))
                        move_grad -= joint
                        g = -joint.sum(axis=0)
                        is_plain = k == len(rows[j]) - 1
                        if j in gold and gold[j][0] == i and (gold[j][1] == 0) == is_plain:
                            g[gold[j][1]] += 1
                        for name in names:
                            grads[name] = grads.get(name, 0) + g
                for name, g in grads.items():
                    w = self.weights.setdefault(name, np.zeros(n_labels))
                    g = g - decay * w
                    q = squares.setdefault(name, np.full(n_labels, 1e-6))
                    q += g * g
                    w += rate * g / np.sqrt(q)
                move_squares += move_grad * move_grad
                self.moves += rate * move_grad / np.sqrt(move_squares)
        return self


def samples(n: int, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Sentences with entities and with numbers that are none; the same for the same seed."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    pick = lambda k, abc: "".join(r.choice(abc) for _ in range(k))
    low = "abcdefghijklmnopqrstuvwxyz"
    hexa, base32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    byte = lambda: str(r.randint(1, 255))
    word = lambda: pick(r.randint(2, 9), low)

    def card() -> str:
        head = r.choice("3456") + digits(r.choice([14, 14, 14, 14, 13, 12]))
        full = next(head + c for c in "0123456789" if luhn(head + c))
        sep = r.choice(["", "", " ", "-"])
        return sep.join(full[i : i + 4] for i in range(0, len(full), 4)) if sep else full

    def email() -> str:
        name = r.choice([f"{word()}.{digits(2)}", word(), f"{word()}_{word()}"])
        host = f"{word()}.{r.choice(['com', 'org', 'example.com', 'net'])}"
        return r.choice([f"{name}@{host}"] * 4 + [f"{word()} at {word()} dot com", f"{word()} [at] {word()} [dot] org", f"{word()} dot {word()} at {word()} dot {r.choice(['com', 'org', 'net'])}"])

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+1 ({a}) {b}-{c}"] * 4 + [f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{r.randint(20, 99)} {digits(2)} {digits(4)} {digits(4)}", f"+1-{a}-{b}-{c}", f"+{r.randint(20, 99)} {digits(3)} {digits(6)}"])

    def secret() -> str:
        return r.choice([f"AKIA{pick(16, base32)}", f"password={pick(18, hexa)}", f'token = "{pick(40, hexa)}"', f"api_key: {pick(32, hexa)}", f"secret={pick(20, low + '0123456789')}", f"{r.choice(['password', 'Password', 'passwd', 'pwd'])}{r.choice([': ', '=', ' = '])}{word()}{digits(r.randint(1, 4))}", f"{r.choice(['password', 'Password'])}: {word()}{digits(r.randint(1, 3))}", f"sk-{pick(32, low + base32)}", f"ghp_{pick(36, low + base32)}"])

    make = {
        "email": email,
        "ip": lambda: r.choice([".".join(byte() for _ in range(4))] * 4 + [":".join(pick(4, hexa) for _ in range(8))]),
        "card": card,
        "phone": phone,
        "secret": secret,
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "iban": lambda: r.choice([(s := pick(2, "DEFRGBIT") + digits(2) + digits(18)), " ".join(s[i : i + 4] for i in range(0, 22, 4))]),
    }
    other = [
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}", lambda: f"{r.randint(0, 23)}:{r.randint(0, 59):02}", lambda: f"${r.randint(1, 999)}.{digits(2)}",
        lambda: f"{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 20)}", lambda: f"{r.randint(0, 9)}.{r.randint(0, 20)}", lambda: str(r.randint(1900, 2030)), lambda: digits(r.randint(1, 8)), lambda: f"#{digits(r.randint(3, 8))}", lambda: f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        lambda: f"{r.randint(1, 999)},{digits(3)},{digits(3)}", lambda: f"{r.randint(1, 99)}%", lambda: f"{word()}{digits(1)}", lambda: f"@{word()}", lambda: f"{digits(3)} {digits(3)}", lambda: f"{digits(2)}-{digits(2)}", lambda: f"x={digits(2)}", lambda: f"{word()} at {word()}", lambda: pick(3, "ABC") + digits(3), lambda: f"{word()}: {word()}{digits(r.randint(1, 4))}", lambda: f"{word()} me at", lambda: f"{r.randint(300, 999)}.{r.randint(256, 999)}.{byte()}.{byte()}",
        lambda: next(s for s in iter(lambda: r.choice("3456") + digits(15), None) if not luhn(s)),
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(2, 5)):
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                text += (" " if text else "") + r.choice([word(), word(), word().capitalize(), word() + r.choice(".,")])
            if r.random() < 0.35:
                text += (" " if text else "") + r.choice(other)()
            else:
                kind = r.choice(KINDS)
                value = make[kind]()
                start = len(text) + bool(text)
                text += (" " if text else "") + value
                spans.append((kind, *trimmed(text, start, len(text))))
                text += r.choice(["", "", "", ".", ","])
        out.append((text, spans))
    return out


@functools.lru_cache(maxsize=2)
def trained(n: int = 700, seed: int = 7) -> Field:
    return Field().train(samples(n, seed))


WEIGHTS = Path(__file__).with_name("field.json")
#: Digits after the point of a stored weight.
DIGITS = 3


def store(field: Field, path: Path = WEIGHTS) -> None:
    """Write the field: the moves, then one line a feature with its weight of each label. Features whose weights round to nothing are left out."""
    rows = {name: [round(float(x), DIGITS) + 0.0 for x in w] for name, w in sorted(field.weights.items())}
    lines = [json.dumps(["", [[round(float(x), DIGITS) + 0.0 for x in row] for row in field.moves]])]
    lines += [json.dumps([name, row], ensure_ascii=False, separators=(",", ":")) for name, row in rows.items() if any(row)]
    path.write_text("[\n" + ",\n".join(lines) + "\n]\n", encoding="utf-8")


@functools.lru_cache(maxsize=2)
def stored(path: Path = WEIGHTS) -> Field:
    """The field as ``store`` wrote it."""
    field = Field()
    (_, moves), *rows = json.loads(path.read_text(encoding="utf-8"))
    field.moves = np.array(moves)
    field.weights = {name: np.array(row) for name, row in rows}
    return field


#: Words read on either side of one that may start an entity.
MARGIN = 3
#: Words decoded at once.
BLOCK = 256
NEAR = re.compile(r"[0-9@]|(?<=[\s\[(])(?:at|AT)(?=[\s\])])(?=.{1,60}?[\s\[(](?:dot|DOT)[\s\])])")


SPELLED = re.compile(r"[\])]?\s+\S{1,60}(?:\s+[\[(]?(?:dot|DOT)[\])]?\s+\S{1,60}){1,4}")


def field_spans(text: str, field: Field) -> list[Span]:
    """The field's spans: only stretches of words around a digit or an at-sign are read."""
    windows: list[list[tuple[int, int]]] = []
    end = -1
    for m in NEAR.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        word = WORD.match(text, start)
        # an address that is spelled out goes on after its "at"
        said = SPELLED.match(text, m.end()) if m[0] in ("at", "AT") else None
        more = [w.span() for w in WORD.finditer(text, word.end(), said.end())] if said else []
        before: list[tuple[int, int]] = []
        at = start
        for _ in range(MARGIN):
            stop = at
            while stop > max(end, 0) and text[stop - 1].isspace():
                stop -= 1
            first = stop
            while first > max(end, 0) and not text[first - 1].isspace():
                first -= 1
            if first == stop:
                break
            before.insert(0, (first, stop))
            at = first
        if windows and (not before or before[0][0] <= windows[-1][-1][1] + 1 or len(before) < MARGIN):
            windows[-1] += [*(w for w in before if w[0] > windows[-1][-1][0]), word.span(), *more]
        else:
            windows.append([*before, word.span(), *more])
        end = windows[-1][-1][1]
    out: list[Span] = []
    for words in windows:
        if m := WORD.search(text, words[-1][1]):
            words.append(m.span())
        # long stretches are decoded in blocks; spans near a block's end are decided by the next one
        i = 0
        while i < len(words):
            block = words[i : i + BLOCK]
            found = field.best(text, block)
            if i + BLOCK >= len(words):
                out += found
                break
            cut = block[-2 * MAX_WORDS][0]
            out += [s for s in found if s[2] <= cut]
            cut = min([cut, *(s[1] for s in found if s[1] < cut < s[2])])
            i = max(i + 1, bisect.bisect_left(words, (cut, 0)))
    return out


def all_spans(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """The fixed patterns' spans, and all spans by kind and start."""
    if not text:
        return [], []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    reach, most = [], 0  # furthest end of the spans up to each
    for _, b in taken:
        most = max(most, b)
        reach.append(most)
    starts = [a for a, _ in taken]
    more = set()
    for kind, a, b in field_spans(text, field):
        k = bisect.bisect_left(starts, b)
        if not (k and reach[k - 1] > a):
            more.add((kind, a, b))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted([*base, *more], key=lambda s: (order[s[0]], s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts and digest of the fixed patterns' spans, and all spans as kind:start:end."""
    field = docs.sparkSession.sparkContext.broadcast(stored())
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(x.as_py(), field.value) for x in batch.column(1)]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in BASE]
            digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([written(s) for _, s in found], pa.string())], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """text with each stretch of spans replaced by the kind of its first one, in brackets."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data replaced by its kind; n_chars, where there is one, follows a changed text."""
    field = docs.sparkSession.sparkContext.broadcast(stored())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            before = cols[text_col].to_pylist()
            texts = [x and redacted(x, all_spans(x, field.value)[1]) for x in before]
            cols[text_col] = pa.array(texts, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([n if a == b else len(b) for n, a, b in zip(cols["n_chars"].to_pylist(), before, texts, strict=True)], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return map_batches(docs, run, docs.schema)


if __name__ == "__main__":
    store(trained())
