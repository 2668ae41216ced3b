"""Personal data by a semi-Markov conditional random field.

Base spans come from fixed patterns. The field adds more: a text's tokens (runs of letters, runs of digits,
single marks) are cut into segments, each either one plain token or an entity of up to MOST_TOKENS tokens with
a type, and a dynamic program over bounded entities finds the best cut, so boundaries and types are chosen
together. Features describe whole spans: digits and their groups, marks, an address sign or one that is spelled
out, check digits, and what stands before and after; a transition weight joins neighbouring segments. Only spans
that could be an entity at all (see `possible`) are candidates, and plain tokens score zero, so a text is read as
a stream of windows around tokens that such a span needs; nothing is cut off, however long a token or a text is.

The field is fitted to maximise the likelihood of the spans in windows of a bounded sample of documents: base
spans as they stand, the same with typing noise that the patterns miss (other separators, a lost '+', a spelled
'@', a wrong digit after a word that announces a card), and numbers that are no personal data.
"""

from __future__ import annotations

import random
import re
from array import array
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts where a run of digits does: the look behind keeps long runs from being tried at each digit.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Tokens of an entity, and its digits where it holds no address sign.
MOST_TOKENS, MOST_DIGITS = 16, 19
TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|[^\x20\x09-\x0D]")
#: A spelled-out address sign: in brackets, or before a name with a (spelled) dot.
SPELLED = re.compile(r"(?i:[(\[][\x20]?at[\x20]?[)\]]|(?<=[\x20])at(?=[\x20][a-z0-9-]+(?:\.[a-z]|[\x20]\(?dot\)?[\x20])))")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """kind (position in KINDS), start, end of the base spans, by kind and start."""
    out = []
    if "@" in text:
        out += [(0, m.start(), m.end()) for m in emails(text)]
    if DIGIT.search(text):
        if "." in text:
            out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int_at_most(p, 255) for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15]
    return out


def int_at_most(digits: str, most: int) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= most


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[re.Match]:
    """What EMAIL.finditer gives, reading only around each '@': a match starts where the run before it does."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m
            done = m.end()
        at = text.find("@", max(at + 1, done))


def tokens(text: str) -> Iterator[tuple[int, int, bool]]:
    """start, end and hot of each token; hot tokens hold a digit or an address sign."""
    signs = {m.start() + m.group().lower().index("at") for m in SPELLED.finditer(text)}
    for m in TOKEN.finditer(text):
        s, e = m.span()
        c = text[s]
        yield s, e, "0" <= c <= "9" or c == "@" or s in signs


def stream(text: str, most: int | None = None) -> Iterator[list[tuple[int, int, bool]]]:
    """Windows: tokens around hot ones, MOST_TOKENS on both sides. Windows of more than `most` tokens are left out (for fitting alone)."""
    before: deque = deque(maxlen=MOST_TOKENS)
    window: list = []
    since = size = 0
    for token in tokens(text):
        if token[2]:
            if not size:
                window, size = list(before), len(before)
            since = 0
        if size:
            size += 1
            since += 1
            if most is None or size <= most:
                window.append(token)
            before.append(token)
            if since > MOST_TOKENS:
                if most is None or size <= most:
                    yield window
                window, size = [], 0
        else:
            before.append(token)
    if size and (most is None or size <= most):
        yield window


def possible(text: str, window: list, i: int, j: int, digits: int, dots: int, sign: bool) -> bool:
    """Whether tokens i to j - 1 could be an entity: they begin and end well, stand in one line, and hold an address sign among letters, seven digits, or four dotted numbers."""
    first, last = text[window[i][0]], text[window[j - 1][0]]
    if not (first.isalnum() or first in "+(") or not (last.isalnum() or last == ")"):
        return False
    return digits >= 7 or (sign and i + 2 < j) or (digits >= 4 and dots >= 3)


#: Fixed values. Words that announce an entity.
CUES = {"mail": "mail", "email": "mail", "contact": "any", "address": "any", "tel": "phone", "phone": "phone", "call": "phone", "fax": "phone", "mobile": "phone", "card": "card", "visa": "card", "mastercard": "card", "ip": "ip", "host": "ip", "server": "ip",
        "order": "number", "id": "number", "no": "number", "ref": "number", "number": "number", "isbn": "number", "invoice": "number", "item": "number", "matrix": "number", "table": "number", "row": "number", "coordinates": "number", "position": "number", "total": "number", "version": "number"}
ADDRESS = re.compile(r"(?i)[a-z0-9._%+-]+[\x20]?(?:@|[(\[]?[\x20]?at[\x20]?[)\]]?)[\x20]?[a-z0-9-]+(?:[\x20]?(?:\.|[(\[]?[\x20]?dot[\x20]?[)\]]?)[\x20]?[a-z0-9-]+)+")


def features(text: str, window: list, i: int, j: int) -> tuple[str, ...]:
    """Features of tokens i to j - 1 as one span, and of its surroundings."""
    s, e = window[i][0], window[j - 1][1]
    return (*shape(text[s:e]), *around(text, window, i, j))


@lru_cache(20_000)
def shape(span: str) -> tuple[str, ...]:
    groups = re.findall(r"[0-9]+", span)
    n = sum(map(len, groups))
    letters = sum(c.isalpha() for c in span)
    kinds = "none" if not letters else "few" if letters <= 4 else "many"
    marks = "".join(sorted(set(re.findall(r"[^\w\s]", span))))[:8]
    # Exact numbers of digits matter where there is nothing else: not beside letters, nor in four short numbers.
    quad = not letters and len(groups) == 4 and max(map(len, groups)) <= 3
    size = ("0" if not n else "1-4" if n <= 4 else "5+") if letters else "quad" if quad else str(min(n, 20))
    lens = "" if letters or quad else ",".join(str(min(len(g), 9)) for g in groups[:6])
    out = ["bias", f"n={size},{kinds}", f"lens={lens},{kinds}", f"marks={marks},{kinds}", f"first={span[0] if not span[0].isalnum() else 'd' if span[0].isdigit() else 'a'}", f"blanks={min(span.count(' '), 5)}"]
    if not letters:
        if 13 <= n <= 19:
            good = luhn("".join(groups))
            out += [f"check={good}", f"check={good},{n == 16},{marks}"]
        if quad and span.count(".") == 3:
            out.append("quad" if all(int_at_most(g, 255) for g in groups) else "bad-quad")
        if re.fullmatch(r"(?:\+?0{0,2}1[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", span):
            out.append("three-three-four")
        if re.fullmatch(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}(?: [0-9:]*)?", span):
            out.append("date")
    else:
        whole = ADDRESS.fullmatch(span)
        out.append(f"address={bool(whole)},{'@' in span}")
    return tuple(out)


def around(text: str, window: list, i: int, j: int) -> tuple[str, ...]:
    """Whether the span is glued to its neighbours, and what announces it: a cue up to three tokens before."""
    s, e = window[i][0], window[j - 1][1]
    left, right = text[s - 1] if s else " ", text[e] if e < len(text) else " "
    more = text[e + 1] if e + 1 < len(text) else " "
    glue = lambda c: "blank" if c.isspace() else "alnum" if c.isalnum() else "mark"
    # A mark that goes on to more letters or digits glues, one that ends a sentence does not.
    joins = right in ".-@_:/+%" and more.isalnum()
    cue = next((CUES[w] for k in range(max(0, i - 3), i) if (w := text[window[k][0] : min(window[k][1], window[k][0] + 12)].lower()) in CUES), "no")
    digits = sum(window[k][1] - window[k][0] for k in range(i, j) if text[window[k][0]].isdigit())
    letters = any(text[window[k][0]].isalpha() for k in range(i, j))
    return (f"left={glue(left)},{left in '.-@_:/+%'}", f"right={glue(right)},{joins}", f"cue={cue},{min(digits, 20)},{letters}", f"tokens={min(j - i, 8)}")


class Field:
    """Weights of each feature for each type, and of each type after each other, plain tokens last."""

    def __init__(self, weights: dict | None = None, cross: list | None = None):
        self.weights = weights or {}
        self.cross = cross or [[0.0] * (len(KINDS) + 1) for _ in range(len(KINDS) + 1)]

    def ending(self, text: str, window, j: int, closed=frozenset()) -> list[tuple[int, tuple[str, ...]]]:
        """Starts and features of every possible entity segment that ends before token j; tokens of `closed` belong to none."""
        out = []
        digits, dots, sign, hot = 0, 0, False, False
        for i in range(j - 1, max(0, j - MOST_TOKENS) - 1, -1):
            s, e, own = window[i]
            if i in closed or (i < j - 1 and (window[i + 1][0] - e > 2 or "\n" in text[e : window[i + 1][0]])):
                break
            c = text[s]
            if "0" <= c <= "9":
                digits += e - s
                if digits > MOST_DIGITS and not sign:
                    break
            elif own:
                sign = True
            dots += c == "."
            hot = hot or own
            if hot and possible(text, window, i, j, digits, dots, sign):
                out.append((i, features(text, window, i, j)))
        return out

    def candidates(self, text: str, window: list) -> dict:
        """Feature tuples of every possible entity segment, by (start, end)."""
        return {(i, j): found for j in range(1, len(window) + 1) for i, found in self.ending(text, window, j)}

    def score(self, found: tuple[str, ...]) -> list[float]:
        none = [0.0] * len(KINDS)
        return [sum(x) for x in zip(*[self.weights.get(f, none) for f in found], strict=True)]

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """kind, start, end of the entities that no base span touches; none from a field that was fitted on nothing.

        Tokens are read one by one: a window keeps its last tokens, the scores of its last MOST_TOKENS positions and
        a few bytes a token to trace the best cut back, however long it is.
        """
        if not self.weights or not (DIGIT.search(text) or "@" in text or SPELLED.search(text)):
            return []
        spans = sorted((a, b) for _, a, b in base)
        out: list = []
        before: deque = deque(maxlen=MOST_TOKENS)
        window, cut, since, at = Tail(), None, 0, 0

        def push(token: tuple[int, int, bool]) -> None:
            nonlocal at
            s, e, _ = token
            while at < len(spans) and spans[at][1] <= s:
                at += 1
            window.add(token, at < len(spans) and spans[at][0] < e)
            cut.push([(i, self.score(f)) for i, f in self.ending(text, window, window.n, window.closed)], s, e)

        for token in tokens(text):
            if token[2]:
                if cut is None:
                    window, cut = Tail(), Cut(self.cross)
                    for earlier in before:
                        at = 0 if at and spans[at - 1][1] > earlier[0] else at
                        push(earlier)
                since = 0
            if cut is not None:
                push(token)
                since += 1
                if since > MOST_TOKENS:
                    out += cut.entities()
                    cut = None
            before.append(token)
        return out + (cut.entities() if cut is not None else [])


class Tail:
    """The last tokens of a window, by their number in it, and which of them belong to base spans."""

    KEPT = 2 * MOST_TOKENS + 4

    def __init__(self):
        self.n, self.last, self.closed = 0, deque(maxlen=self.KEPT), set()

    def add(self, token: tuple[int, int, bool], closed: bool) -> None:
        self.last.append(token)
        if closed:
            self.closed.add(self.n)
        self.closed.discard(self.n - self.KEPT)
        self.n += 1

    def __getitem__(self, k: int) -> tuple[int, int, bool]:
        return self.last[k - self.n + len(self.last)]


class Cut:
    """The best cut of a window into plain tokens and typed entities: dynamic programming over positions and the last segment's type.

    Equal scores go to plain tokens: an entity has to gain something.
    """

    def __init__(self, cross: list):
        self.cross, self.last = cross, len(KINDS)
        never = [-1e18] * self.last
        self.frontier: deque = deque([[*never, 0.0]], maxlen=MOST_TOKENS + 1)
        self.size, self.come, self.starts, self.ends = array("b"), array("b"), array("q"), array("q")

    def push(self, found: list[tuple[int, list[float]]], start: int, end: int) -> None:
        """One more token, and the entities (start token, score by type) that end with it."""
        self.starts.append(start)
        self.ends.append(end)
        last, cross, j = self.last, self.cross, len(self.ends)
        alpha, size, come = [-1e18] * (last + 1), [1] * (last + 1), [last] * (last + 1)
        was = self.frontier[-1]
        p = max(range(last, -1, -1), key=lambda q: was[q] + cross[q][last])
        alpha[last], come[last] = was[p] + cross[p][last], p
        for i, own in found:
            was = self.frontier[i - j]
            for t in range(last):
                p = max(range(last, -1, -1), key=lambda q: was[q] + cross[q][t])  # noqa: B023
                v = was[p] + own[t] + cross[p][t]
                if v > alpha[t]:
                    alpha[t], size[t], come[t] = v, j - i, p
        self.frontier.append(alpha)
        self.size.extend(size)
        self.come.extend(come)

    def best(self) -> list[tuple[int, int, int]]:
        """Entities as (first token, token after the last, type)."""
        last, j, out = self.last, len(self.ends), []
        alpha = self.frontier[-1]
        t = max(range(last, -1, -1), key=lambda q: alpha[q])
        while j:
            at = (j - 1) * (last + 1) + t
            i = j - self.size[at]
            if t < last:
                out.append((i, j, t))
            j, t = i, self.come[at]
        return out[::-1]

    def entities(self) -> list[tuple[int, int, int]]:
        """type, start, end in the text."""
        return [(t, self.starts[i], self.ends[j - 1]) for i, j, t in self.best()]


class Trainer:
    """Fits a Field by ascent on the log-likelihood of windows' cuts, with a rate of its own for each weight."""

    def __init__(self, examples: list[tuple[int, dict, list]]):
        """examples: number of tokens, candidates' features by (start, end), gold segments (start, end, type)."""
        self.index = {f: k for k, f in enumerate(sorted({f for _, found, _ in examples for fs in found.values() for f in fs}))}
        n, types = len(self.index), len(KINDS) + 1
        # The last row stands for no feature and stays zero.
        self.w, self.squares = np.zeros((n + 1, types - 1)), np.full((n + 1, types - 1), 1e-2)
        self.cross, self.cross_squares = np.zeros((types, types)), np.full((types, types), 1e-2)
        self.examples = []
        for size, found, gold in examples:
            at = sorted(found)
            most = max(len(found[x]) for x in at)
            rows = np.full((len(at), most), n)
            for k, x in enumerate(at):
                rows[k, : len(found[x])] = [self.index[f] for f in found[x]]
            starts, ends = np.array(at).T
            self.examples.append((size, rows, starts, ends, [np.flatnonzero(starts == i) for i in range(size)], [np.flatnonzero(ends == j) for j in range(size + 1)], {at.index((i, j)): t for i, j, t in gold}))

    def step(self, example: tuple, rate: float) -> None:
        n, rows, starts, ends, from_, upto, gold = example
        last, cross = len(KINDS), self.cross
        score = self.w[rows].sum(1)
        forward, into, backward = (np.full((n + 1, last + 1), -1e18) for _ in range(3))
        forward[0, last] = 0.0
        into[0] = cross[last]  # what a segment that starts here with a type comes from
        for j in range(1, n + 1):
            forward[j, last] = into[j - 1, last]
            if len(upto[j]):
                forward[j, :last] = np.logaddexp.reduce(score[upto[j]] + into[starts[upto[j]], :last], axis=0)
            into[j] = np.logaddexp.reduce(forward[j][:, None] + cross, axis=0)
        backward[n] = 0.0
        for i in range(n - 1, -1, -1):
            ahead = [cross[:, last] + backward[i + 1, last]]
            if len(from_[i]):
                own = np.logaddexp.reduce(score[from_[i]] + backward[ends[from_[i]], :last], axis=0)
                ahead += list((cross[:, :last] + own).T)
            backward[i] = np.logaddexp.reduce(np.array(ahead), axis=0)
        total = np.logaddexp.reduce(forward[n])
        share = np.exp(np.minimum(0, into[starts, :last] + score + backward[ends, :last] - total))
        grad = -share
        each = -np.exp(np.minimum(0, forward[starts][:, :, None] + cross[None, :, :last] + (score + backward[ends, :last])[:, None] - total)).sum(0)
        plain = -np.exp(np.minimum(0, forward[:n] + cross[None, :, last] + backward[1:, last][:, None] - total)).sum(0)
        step = np.column_stack([each, plain])
        came, j = last, 0
        begins = {int(starts[k]): (k, t) for k, t in gold.items()}
        while j < n:
            k, t = begins.get(j, (None, last))
            if k is not None:
                grad[k, t] += 1
            step[came, t] += 1
            came, j = t, int(ends[k]) if k is not None else j + 1
        change = np.zeros_like(self.w)
        np.add.at(change, rows, grad[:, None, :])
        touched = np.unique(rows)
        touched = touched[touched < len(self.index)]
        own = change[touched]
        self.squares[touched] += own * own
        self.w[touched] += rate * own / np.sqrt(self.squares[touched])
        self.cross_squares += step * step
        self.cross += rate * step / np.sqrt(self.cross_squares)

    def field(self) -> Field:
        return Field({f: self.w[k].tolist() for f, k in self.index.items()}, self.cross.tolist())


def gold_of(window: list, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]] | None:
    """The spans within a window as token segments; nothing if one of them is not a bounded segment."""
    starts, ends = {s: k for k, (s, _, _) in enumerate(window)}, {e: k + 1 for k, (_, e, _) in enumerate(window)}
    out, upto = [], 0
    for t, s, e in sorted(spans, key=lambda x: x[1]):
        if e <= window[0][0] or s >= window[-1][1]:
            continue
        i, j = starts.get(s), ends.get(e)
        if i is None or j is None or not upto <= i < j <= i + MOST_TOKENS:
            return None
        out.append((i, j, t))
        upto = j
    return out


def variants(kind: int, own: str, number: int) -> list[tuple[str, bool]]:
    """Ways of writing a base span that the patterns miss, with a cue before some, and lookalikes (false)."""
    digits = re.sub("[^0-9]", "", own)
    pick = lambda *forms: forms[number % len(forms)]
    if kind == 0:
        user, _, host = own.partition("@")
        if number % 3 == 1:
            user = user.replace(".", pick("_", "", "-"))
        elif number % 3 == 2:
            user, host = re.sub("[0-9]+", "", user).strip(".-_%+") or "a", ".".join(p for x in host.split(".") if (p := re.sub("[0-9]+", "", x).strip("-")))
        return [(f"{user}{pick(' at ', ' (at) ', ' [at] ', ' @ ', '(at)')}{host}", True), (f"{user}{pick(' at ', ' (at) ')}{host.replace('.', pick(' dot ', ' (dot) '))}", True), (f"{user} {pick('at', 'and')} {host.replace('.', ' ')}", False)]
    if kind == 1:
        parts = own.split(".")
        return [(pick("[.]", " . ", "(.)").join(parts), True), (".".join([str(int(parts[0]) + 300), *parts[1:]]), False), (".".join(parts[:3]), False)]
    if kind == 2:
        wrong = digits[:5] + str((int(digits[5]) + 1 + number % 8) % 10) + digits[6:]
        four = lambda x, c: c.join(x[p : p + 4] for p in range(0, len(x), 4))
        cue = pick("card", "visa", "card no.", "Mastercard")
        return [(four(digits, pick(".", "/")), True), (f"{cue} {pick(wrong, four(wrong, ' '), four(wrong, '-'))}", True), (f"{pick('order', 'id', 'no.', 'ref')} {pick(wrong, four(wrong, ' '), four(wrong, '-'))}", False), (pick(wrong, f"{wrong[0]} {wrong[1:8]} {wrong[8:]}", f"{wrong[:6]} {wrong[6:12]} {wrong[12:]}"), False), (four(wrong, pick(" ", "-")), True)]
    short = digits[-10:]
    a, b, c = short[:3], short[3:6], short[6:]
    cue = pick("tel", "phone", "call", "fax")
    return [(f"({a}) {b}{pick('-', ' ', '.')}{c}", True), (pick(f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"001 {a} {b} {c}"), True), (f"{cue} {pick(short, f'({a}) {b}-{c}', f'{a}-{b}-{c}', f'1 {a} {b} {c}')}", True), (f"{pick('order', 'id', 'no.', 'of')} {short}", False)]


#: Fixed values. Numbers that are no personal data, shown in place of spans.
PLAIN = (
    "12.5", "2024", "35", "1,250", "3.0", "17", "0.5", "10:30", "1999-12-31", "600", "2024-01-01 10:30", "1,234,567,890", "12345678", "978-3-16-148410-0", "3.14159265", "31.12.1999", "f33e61083db5dbdf4bd2369d", "1.2.3", "2024010112", "100 000 000",
    "48.8566 2.3522", "40.7128, -74.0060", "-33.8688 151.2093", "lat 52.5200 lon 13.4050", "10 20 30 40 50 60 70 80", "101 202 303 404 505 606", "12 345 678", "2023, 1 400 000", "2021 2022 2023 2024", "3 450 000 and 2 100 000", "7 1234567 1234568 1234569", "1.5 2.5 3.5 4.5", "12,500,000",
    "0.1 0.22 0.333 0.4444", "1990 - 1995", "3 x 4 x 5", "55 1200 78 3400 91", "1000 2000 3000",
)


def figures(number: int) -> str:
    """A row of numbers as tables have them, of any lengths, which is no personal data."""
    rng = random.Random(number)
    most = rng.randrange(2, 8)
    parts = ["".join(rng.choice("0123456789") for _ in range(rng.randrange(1, most))) for _ in range(rng.randrange(3, 14))]
    return rng.choice([" ", " ", ", ", " - ", ". ", "-"]).join(parts)


def shown(text: str, spans: list[tuple[int, int, int]], number: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """A window's text with its spans as they are, then for each kind of variant with other writings in their place, and with plain numbers and rows of them."""
    yield text, spans
    spans = sorted(spans, key=lambda x: x[1])
    for turn in range(8):
        out, moved, at, size = [], [], 0, 0
        for k, (t, s, e) in enumerate(spans):
            if s < at:
                continue
            forms = variants(t, text[s:e], number + k + turn)
            own, real = forms[turn] if turn < len(forms) else (figures(8 * number + k + turn) if turn > 5 else PLAIN[(number + k + turn) % len(PLAIN)], False)
            out += [text[at:s], own]
            size += s - at
            if real:
                cue = re.match(r"(?:card no\.|[A-Za-z]+) (?=[0-9(])", own) if t in (2, 3) else None
                moved.append((t, size + (cue.end() if cue else 0), size + len(own)))
            size += len(own)
            at = e
        yield "".join([*out, text[at:]]), moved


#: What a text with a base span holds for certain (not the other way round), for the JVM to look for.
MAY_HOLD = r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){15}|\+[0-9][ ().0-9-]+[0-9]"


def train(docs: DataFrame, sample: int = 1500, rounds: int = 4, most_windows: int = 160, most_chars: int = 1000) -> Field:
    """Fits on windows of at most `sample` documents with a base span: distinct texts with the smallest hashes.

    Holders of base spans are looked for in all documents, however rare they are; without any the field is empty and
    adds nothing. Of each at most four windows of up to `most_chars` characters with a base span reach the driver,
    and `most_windows` in all: that bounds what it holds. Each is shown as it stands and in eight other ways.
    """
    rows = docs.where(F.col("text").rlike(MAY_HOLD)).select(F.xxhash64("text").alias("h"), "text")

    def holders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": [h for h, text in zip(pdf["h"], pdf["text"], strict=True) if base_spans(text)]}, dtype="int64")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h, text in zip(pdf["h"], pdf["text"]):
                base, n = base_spans(text), 0
                for k, window in enumerate(stream(text, most_chars)) if base else ():
                    lo, hi = window[0][0], window[-1][1]
                    if n < 4 and hi - lo <= most_chars and any(lo <= s and e <= hi for _, s, e in base):
                        out.append((h, k, text[lo:hi]))
                        n += 1
            yield pd.DataFrame(out, columns=["h", "k", "piece"])

    chosen = small_batches(rows).mapInPandas(holders, "h long").distinct().orderBy("h").limit(sample)
    found = rows.join(F.broadcast(chosen), "h").mapInPandas(pieces, "h long, k int, piece string")
    found = found.dropDuplicates(["h", "k"]).orderBy("h", "k").limit(most_windows).collect()
    ready, field = [], Field()
    for number, piece in enumerate(sorted({r["piece"] for r in found})):
        for body, spans in shown(piece, base_spans(piece), number):
            for window in stream(body):
                gold = gold_of(window, spans)
                own = field.candidates(body, window) if gold is not None else {}
                if own and all((i, j) in own for i, j, _ in gold):
                    ready.append((len(window), own, gold))
    if not ready:
        return Field()
    trainer = Trainer(ready)
    for r in range(rounds):
        for example in trainer.examples:
            trainer.step(example, 0.5 / (1 + r))
    return trainer.field()


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_spans, base (spans), spans (base and added) for each row of docs(doc_id, text).

    Spans are kind:start:end in code points, end exclusive, by kind and start, joined by commas. The counts
    by kind are of base spans, n_spans is of all. A null or empty text has none. Rows without doc_id and repeated rows are reported like
    others; an empty table gives an empty result; other columns are ignored.
    """
    weights, cross = field.weights, field.cross
    schema = "doc_id string, n_email long, n_ip long, n_card long, n_phone long, n_spans long, base string, spans string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Field(weights, cross)
        text_of = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                base = base_spans(text)
                every = base + own.added(text, base)
                n = Counter(k for k, _, _ in base)
                rows.append((n[0], n[1], n[2], n[3], len(every), text_of(base), text_of(every)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "n_spans", "base", "spans"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    rows = pick(small_batches(docs), doc_id="doc_id", text="text").select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))  # pandas would round ids beside nulls
    return rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def find_personal_data(docs: DataFrame, **how) -> DataFrame:
    """find() with a field fitted on the same documents."""
    return find(docs, train(docs, **how))

