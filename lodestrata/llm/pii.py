"""Personal data: rule spans, and a linear-chain conditional random field that adds what the rules miss.

The rules (email, ip, card, phone) are matched over whole texts. The field works
on tokens (letter runs, digit runs, single marks) of whole texts, all in numpy,
by the shapes of a token and its neighbours, by whether they touch, and by the
digits of the run of numbers and separators that it stands in. Its weights are
trained from a small labelled table of everyday written forms by gradient ascent
on the regularised conditional likelihood, once a process, on the driver; Viterbi
runs over many chains at a time. Every token that has a signal (a digit, an at
sign, a written-out "at" or "dot") within OPEN tokens is open; the labels of all
others are "outside", as no labelled span lacks a signal. Features always come
from a token's true neighbours in its text.

Defined results: a null or empty text has no spans. Offsets are code points,
ends exclusive. A labelled span that lacks what its kind must have is dropped: an
at sign or word and a dot, four numbers up to 255, 12 to 19 digits that pass
Luhn, 9 to 15 digits. Rules win where both find something: a field's span that
meets a rule span is dropped. Of equally likely labellings the one whose labels
come first counts. Texts of any length are taken whole. Repeated rows each get a
row; further columns, whatever their names, are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.llm import store

# The kinds in the order that settles ties, and the patterns of the rules.
KINDS = ("email", "ip", "card", "phone")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' matches, in order."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _HOST.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            out.append((start, 0, last))
        else:
            last = at + 1 if start == at else max(last, start)
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(p) <= 255 for p in (x.lstrip("0")[:4] or "0" for x in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the field -----------------------------------------------------------------------------------

#: Labels: outside, and begin/inside of each kind.
LABELS = 1 + 2 * len(KINDS)
# Words whose own form is a feature, and marks that are.
_WORDS = "at dot arroba punto phone tel call fax mobile cell text sms whatsapp email mail contact write card visa amex pay ip host server ping addr com org net edu isbn order invoice version page room year ref id no nr flight total".split()
_MARKS = "@.-()[]{}<>+/:,;#$%&*!?='\"_|~€£"
_LENGTHS = (*range(1, 9), 9, 12, 20)
_NAMES = ["edge", "other", "lower", "Upper", "CAPS", "Mixed", *(f"d{n}" for n in _LENGTHS), *_WORDS, *_MARKS]
_SHAPE = {x: k for k, x in enumerate(_NAMES)}
#: Slots of a token: shapes of it and of REACH tokens on each side, whether it touches its neighbours, and how many digits its run of numbers and separators has.
REACH = 3
SLOTS = 2 * REACH + 4
#: Tokens on each side of a signal (a digit, an at sign, a written "at" or "dot") whose labels are open; all others are outside.
OPEN = 10
CHUNK = 1 << 20
_GAP, _LETTER, _NUMBER, _MARK = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """By code point: white space, letter, digit or number, or any other mark; 4 is added to upper-case letters."""
    out = np.full(0x110000, _MARK, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        kind = unicodedata.category(x)
        if x.isspace():
            out[c] = _GAP
        elif kind[0] in "LN":
            out[c] = (_LETTER if kind[0] == "L" else _NUMBER) + 4 * (kind in ("Lu", "Lt"))
    return out


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_names = sorted((int.from_bytes(w.encode().ljust(8, b"\0"), "little"), _SHAPE[w]) for w in _WORDS)
_WORD_KEYS, _WORD_SHAPES = np.array([k for k, _ in _names], np.uint64), np.array([v for _, v in _names], np.int64)
_MARK_SHAPES = np.full(0x110000, _SHAPE["other"], np.int64)
for _c in _MARKS:
    _MARK_SHAPES[ord(_c)] = _SHAPE[_c]


# A name, an at sign or word (in brackets or not), and parts of a host between dots; a dot that is not written out touches both parts, or the sign stands for itself.
_NAME, _OPENING, _CLOSING = r"[\w.+-]*\w", r"\s*[\[({<]?\s*", r"\s*[\])}>]?\s*"
_DOT = rf"(?:\.|{_OPENING}(?:\bdot\b|\bpunto\b|(?<=[\[({{])\.){_CLOSING})"
_ADDRESS = re.compile(rf"{_NAME}(?:{_OPENING}(?:\bat\b|\barroba\b){_CLOSING}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[^\W\d_]{{2,}}|{_OPENING}@{_CLOSING}[\w-]+(?:(?:{_DOT}|\s?\.\s?)[\w-]+)*(?:{_DOT}|\s?\.\s?)[^\W\d_]{{2,}})", re.I)


@dataclass
class Tokens:
    """Runs of letters, runs of digits and single marks of a batch of texts: places by code point in their row, shapes, features."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    shapes: np.ndarray
    features: np.ndarray  # tokens x SLOTS
    open: np.ndarray


def tokens(texts: list[str]) -> Tokens:
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
    kind = _classes()[points]
    upper, kind = kind > 3, kind & 3
    fresh = np.diff(kind, prepend=_GAP) != 0
    starts = np.flatnonzero((kind != _GAP) & (fresh | (kind == _MARK)))
    sizes = np.diff(np.append(np.flatnonzero(fresh | (kind == _MARK) | (kind == _GAP)), len(points)))
    size = np.zeros(len(points), np.int64)
    size[np.flatnonzero(fresh | (kind == _MARK) | (kind == _GAP))] = sizes
    n = size[starts]
    ends = starts + n
    own = kind[starts]
    shapes = np.empty(len(starts), np.int64)
    ups = np.concatenate(([0], np.cumsum(upper)))
    count = ups[ends] - ups[starts]
    letter = np.select([count == 0, (count == n) & (n > 1), (count == 1) & upper[starts]], [_SHAPE["lower"], _SHAPE["CAPS"], _SHAPE["Upper"]], _SHAPE["Mixed"])
    low = np.where(points < 128, points, 0xFF).astype(np.uint8)
    low[(low >= 65) & (low < 91)] += 32
    word = np.ndarray(len(low), "<u8", np.concatenate((low, np.zeros(8, np.uint8))), 0, (1,))
    key = word[starts] & _MASKS[np.minimum(n, 8)]
    at = np.minimum(np.searchsorted(_WORD_KEYS, key), len(_WORD_KEYS) - 1)
    shapes = np.where((_WORD_KEYS[at] == key) & (n <= 8), _WORD_SHAPES[at], letter)
    digits = np.array([_SHAPE[f"d{x}"] for x in _LENGTHS])[np.searchsorted(_LENGTHS, n, "right") - 1]
    shapes = np.where(own == _NUMBER, digits, np.where(own == _MARK, _MARK_SHAPES[points[starts]], shapes))
    row = np.searchsorted(first, starts, "right") - 1
    total = len(starts)
    features = np.zeros((total, SLOTS), np.int64)
    for k, d in enumerate(range(-REACH, REACH + 1)):
        j = np.arange(total) + d
        inside = (j >= 0) & (j < total)
        inside[inside] = row[j[inside]] == row[inside]
        features[inside, k] = shapes[j[inside]]
    joined = np.append((ends[:-1] == starts[1:]) & (row[:-1] == row[1:]), False) if total else np.zeros(0, bool)
    features[:, 2 * REACH + 1] = np.concatenate(([False], joined[:-1])) if total else 0
    features[:, 2 * REACH + 2] = joined
    between = np.isin(points[starts], [ord(c) for c in ".-()+/ "]) & (own == _MARK)
    part = (own == _NUMBER) | between
    cluster = np.cumsum(~part | np.concatenate(([True], row[1:] != row[:-1]))[:total])
    per = np.bincount(cluster, np.where(own == _NUMBER, n, 0), (cluster[-1] if total else 0) + 1)
    features[:, 2 * REACH + 3] = np.where(part, 1 + np.minimum(per[cluster], 20), 0)
    signal = (own == _NUMBER) | np.isin(shapes, [_SHAPE[x] for x in ("@", "at", "dot", "arroba", "punto")])
    near = np.concatenate(([0], np.cumsum(signal)))
    low_, high = np.searchsorted(row, row, "left"), np.searchsorted(row, row, "right")
    at = np.arange(total)
    open_ = near[np.minimum(high, at + OPEN + 1)] > near[np.maximum(low_, at - OPEN)]
    return Tokens(starts - first[row], ends - first[row], row, shapes, features, open_)


# Everyday words of four languages, and given and family names, of which the labelled table is made.
_EVERYDAY = """the of and to in is was for on with as by from this that have had not are but which you one we all would there their what so up out if about who get go me when make can like time no just him know take people into year your good some could them see other than then now look only come its over think also back after use two how our work first well way even new want because any these give day most us
le la les des et est une pour dans que qui sur avec par plus nous vous mais tout bien aussi après maison jour temps rue ville entre sans
der die das und ist nicht ein eine mit für auf dem den von zu wird auch nach haus tag zeit straße stadt zwischen ohne über
el los las una por para con del como más pero todo también después casa día tiempo calle ciudad entre sin""".split()
_PEOPLE = "anna james maria peter lucia thomas sofie pablo claire hans elena david marta jonas julia victor smith garcia müller dubois rossi meyer lopez martin jansen novak".split()


def labelled(seed: int = 5, rows: int = 1000) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The small labelled table: texts with (start, kind, end), from written forms of personal data and of numbers and marks that are none."""
    rng = np.random.default_rng(seed)
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    up = lambda a, b: str(rng.integers(a, b))
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: str(rng.choice(_EVERYDAY))
    person = lambda: str(rng.choice(_PEOPLE)).encode("ascii", "ignore").decode()
    user = lambda: person() + pick("", num(2), ".", "_").replace(".", "." + person()).replace("_", "_" + person())
    host = lambda: pick("example", "mail", "company", "uni-bonn", person())
    top = lambda: pick("com", "org", "net", "de", "fr", "es", "co.uk", "edu")

    def card(gap: str) -> str:
        body = pick("4", "51", "37", "60") + num(14)
        body = body[:15]
        body += next(str(d) for d in range(10) if _luhn(body + str(d)))
        return gap.join(body[k : k + 4] for k in range(0, 16, 4))

    made = {
        0: [lambda: f"{user()} {pick('(at)', '[at]', '{at}', 'AT', 'at', '<at>')} {host()} {pick('(dot)', '[dot]', 'DOT', 'dot')} {pick('com', 'org', 'net')}", lambda: f"{user()}[at]{host()}[dot]{pick('com', 'de')}", lambda: f"{user()} (at) {host()}.{top()}",
            lambda: f"{user()} @ {host()}.{top()}", lambda: f"{user()}@{host()} . {pick('com', 'net')}", lambda: f"{user()}@{host()}.{top()}", lambda: f"{user()} arroba {host()} punto {pick('com', 'es')}"],
        1: [lambda: ".".join(up(0, 256) for _ in range(4)), lambda: " . ".join(up(0, 256) for _ in range(4)), lambda: "[.]".join(up(0, 256) for _ in range(4))],
        2: [lambda: card("-"), lambda: card(" "), lambda: card("."), lambda: card("")],
        3: [lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"{num(3)} {num(3)} {num(4)}", lambda: f"0{num(2)} {num(4)} {num(4)}", lambda: f"0{num(3)} {num(6)}", lambda: f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}",
            lambda: f"0{num(3)}/{num(6)}", lambda: f"1-{num(3)}-{num(3)}-{num(4)}", lambda: f"00{num(2)} {num(3)} {num(7)}", lambda: f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", lambda: f"+{num(2)} {num(3)} {num(7)}", lambda: f"({num(3)}){num(3)}-{num(4)}", lambda: f"0{num(1)}.{num(2)}.{num(2)}.{num(2)}.{num(2)}", lambda: f"6{num(2)} {num(3)} {num(3)}"],
    }
    clean = [
        lambda: f"{up(1900, 2040)}-{up(10, 13)}-{up(10, 32)}", lambda: f"{up(1, 32)}/{up(1, 13)}/{up(1900, 2040)}", lambda: f"{up(1, 32)}.{up(1, 13)}.{up(1900, 2040)}", lambda: f"{up(0, 24)}:{num(2)}", lambda: f"{up(10, 24)}:{num(2)}:{num(2)}", lambda: f"{up(1900, 2040)}-{up(10, 13)}-{up(10, 32)} {up(10, 24)}:{num(2)}:{num(2)}",
        lambda: f"{up(0, 20)}.{up(0, 20)}.{up(0, 20)}", lambda: f"v{up(0, 20)}.{up(0, 200)}", lambda: f"{pick('$', '€', '£')}{up(1, 999)},{num(3)}.{num(2)}", lambda: f"{up(1, 99)}.{num(3)},{num(2)} €", lambda: f"{up(1, 100)}%", lambda: f"{up(0, 100)}.{up(0, 100)}%", lambda: num(int(rng.integers(1, 9))), lambda: num(int(rng.integers(9, 21))), lambda: num(16),
        lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: f"isbn {num(13)}", lambda: f"order no. {num(3)}-{num(7)}", lambda: f"invoice {up(1900, 2040)}/{num(5)}", lambda: f"ref {num(4)} {num(4)}", lambda: f"{up(1900, 2040)}-{up(1900, 2040)}", lambda: f"pages {up(1, 400)}-{up(1, 400)}", lambda: f"{up(0, 9)}-{up(0, 9)}",
        lambda: f"{up(10, 90)}.{num(4)}, {up(1, 90)}.{num(4)}", lambda: f"({up(1900, 2040)})", lambda: f"#{num(5)}", lambda: f"[{num(2)}]", lambda: f"{num(5)}-{num(4)}", lambda: f"{up(1, 99)} x {up(1, 99)} x {up(1, 99)}", lambda: f"{num(3)} {word()} {num(4)}", lambda: f"{num(3)}, {num(3)}, {num(4)}", lambda: f"{up(1, 40)} {word()} {up(1, 40)} {word()} {up(1900, 2040)}",
        lambda: f"{word()} at {word()}", lambda: f"{word()} at {word()}. {word().title()} {word()}", lambda: f"{word()}. At {word()} {word()}. {word().title()}", lambda: f"{word()}, {word()} at {word()}, {word()}.", lambda: f"{word()}.\n{word().title()} at. {word().title()}", lambda: f"at {up(1, 13)}:{num(2)} in {up(1900, 2040)}", lambda: f"the dot {word()} at the {word()}", lambda: f"{word()} at the end dot {word()}", lambda: f"@{person()}", lambda: f"@{person()} {num(2)}", lambda: f"{word()} @ {up(1, 99)} {word()}", lambda: f"{num(8)}-{num(4)}-4{num(3)}-{num(4)}-{num(12)}", lambda: f"{num(3)}af{num(4)}c{num(2)}",
        lambda: f"{up(1, 999)} {up(100, 999)} {up(100, 999)} {word()}", lambda: f"| {up(1, 99)} | {num(16)} | {word()} |", lambda: f"{num(16)}{pick('!', '*', ';', '...', '%', '&')}{pick('!', '*', '', '%')} {word()}", lambda: f"{num(10)}", lambda: f"nr {num(4)} {num(2)}", lambda: f"{num(4)}-{num(4)}", lambda: f"1. {word()} 2. {word()} 3. {word()}",
    ]
    cues = {0: ("email:", "mail", "write to", "contact", "reach me:"), 1: ("host", "ip", "server", "ping", "addr"), 2: ("card", "visa", "pay with", "card no."), 3: ("phone:", "tel.", "call", "fax", "mobile", "text me", "whatsapp")}
    out = []
    for k in range(rows):
        say = [word() for _ in range(rng.integers(0, 6))]
        after = " ".join(word() for _ in range(rng.integers(0, 6)))
        kind = int(rng.choice([0, 0, 0, 1, 1, 2, 3, 3, 3])) if k % 2 else None
        if kind is not None and rng.random() < 0.4:
            say.append(pick(*cues[kind]))
        body = pick(*made[kind])() if kind is not None else pick(*clean)()
        if rng.random() < 0.08:
            say, after = [x.upper() for x in say], after.upper()
        mark = pick("", "", "", ".", ",", "!", ";", ")", "??", "***")
        left = " ".join(say) + " " * bool(say) + pick("", "", "", '"', "(", "- ")
        out.append((left + body + mark + " " * bool(after) + after, [(len(left), kind, len(left) + len(body))] if kind is not None else []))
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


class Field:
    """Weights by slot, shape and label, and by neighbouring labels (row LABELS: at a chain's start)."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray):
        self.emission, self.transition = emission, transition

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sum(self.emission[k][x[..., k]] for k in range(SLOTS))

    def viterbi(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each chain; chains of like length go through together."""
        out: list[np.ndarray] = [None] * len(chains)  # type: ignore[list-item]
        order = sorted(range(len(chains)), key=lambda k: len(chains[k]))
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and (end - start + 1) * len(chains[order[end]]) <= 200_000 and len(chains[order[end]]) <= 2 * len(chains[order[start]]) + 8:
                end += 1
            own = order[start:end]
            n = np.array([len(chains[k]) for k in own])
            longest = int(n.max())
            x = np.zeros((len(own), longest, SLOTS), np.int64)
            for j, k in enumerate(own):
                x[j, : n[j]] = chains[k]
            s = self.scores(x)
            best = s[:, 0] + self.transition[LABELS]
            back = np.zeros((len(own), longest, LABELS), np.int8)
            for t in range(1, longest):
                paths = best[:, :, None] + self.transition[:LABELS]
                back[:, t] = paths.argmax(1)
                best = np.where((t < n)[:, None], paths.max(1) + s[:, t], best)
            label = best.argmax(1)
            labels = np.zeros((len(own), longest), np.int8)
            rows = np.arange(len(own))
            for t in range(longest - 1, -1, -1):
                labels[:, t] = label
                if t:
                    label = np.where(t < n, back[rows, t, label], label)
            for j, k in enumerate(own):
                out[k] = labels[j, : n[j]]
            start = end
        return out


def gold(found: Tokens, own: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """The labels of tokens `own` of one text for labelled spans."""
    y = np.zeros(len(own), np.int64)
    for a, kind, b in spans:
        inside = np.flatnonzero((found.starts[own] >= a) & (found.ends[own] <= b))
        y[inside] = 2 + 2 * kind
        y[inside[:1]] = 1 + 2 * kind
    return y


def train(rows: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 150, rate: float = 0.15, penalty: float = 0.005) -> Field:
    """Adam on the mean conditional log-likelihood less an L2 penalty, by forward and backward sums."""
    found = tokens([t for t, _ in rows])
    chains, goals = [], []
    for k, (_, spans) in enumerate(rows):
        own = np.flatnonzero(found.row == k)
        if len(own):
            chains.append(found.features[own])
            goals.append(gold(found, own, spans))
    n, longest = len(chains), max(map(len, chains))
    x, y, live = np.zeros((n, longest, SLOTS), np.int64), np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for k, (a, b) in enumerate(zip(chains, goals)):
        x[k, : len(a)], y[k, : len(a)], live[k, : len(a)] = a, b, True
    shapes = [np.zeros((SLOTS, len(_NAMES), LABELS)), np.zeros((LABELS + 1, LABELS))]
    first, second = [np.zeros_like(p) for p in shapes], [np.zeros_like(p) for p in shapes]
    goal = np.eye(LABELS)[y] * live[..., None]
    seen = np.zeros((LABELS + 1, LABELS))
    np.add.at(seen, (LABELS, y[:, 0]), 1)
    for t in range(1, longest):
        np.add.at(seen, (y[live[:, t], t - 1], y[live[:, t], t]), 1)
    for step in range(1, steps + 1):
        emission, transition = shapes
        s = sum(emission[k][x[..., k]] for k in range(SLOTS))
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0] + transition[LABELS]
        for t in range(1, longest):
            alpha[:, t] = np.where(live[:, t, None], _logsum(alpha[:, t - 1, :, None] + transition[:LABELS], 1) + s[:, t], alpha[:, t - 1])
        whole = _logsum(alpha[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(live[:, t + 1, None], _logsum(transition[:LABELS] + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        expected = np.exp(alpha + beta - whole[:, None, None]) * live[..., None]
        pairs = np.zeros((LABELS + 1, LABELS))
        pairs[LABELS] = expected[:, 0].sum(0)
        for t in range(1, longest):
            joint = np.exp(alpha[:, t - 1, :, None] + transition[:LABELS] + (s[:, t] + beta[:, t])[:, None, :] - whole[:, None, None])
            pairs[:LABELS] += (joint * live[:, t, None, None]).sum(0)
        slope = [np.zeros_like(emission), seen - pairs]
        for k in range(SLOTS):
            np.add.at(slope[0][k], x[..., k], goal - expected)
        for p, g, a, b in zip(shapes, slope, first, second):
            g = g / n - penalty * p / 10
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return Field(*shapes)


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled())


def find(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(rule spans, all spans) of each text, as (start, kind, end) in order."""
    base = [base_spans(t) for t in texts]
    found = tokens(texts)
    some = np.flatnonzero(found.open)
    # chains are runs of open tokens; on both sides stand labels "outside"
    cut = np.flatnonzero((np.diff(some) > 1) | (np.diff(found.row[some]) > 0)) + 1
    chains = np.split(some, cut) if len(some) else []
    extra: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for own, y in zip(chains, field.viterbi([found.features[c] for c in chains])):
        begins = np.flatnonzero((y > 0) & ((y % 2 == 1) | (np.concatenate(([0], y[:-1])) == 0)))
        for j in begins.tolist():
            kind, last = (int(y[j]) - 1) // 2, j
            while last + 1 < len(y) and y[last + 1] == 2 + 2 * kind:
                last += 1
            k = int(found.row[own[j]])
            a, b = int(found.starts[own[j]]), int(found.ends[own[last]])
            if sound(kind, texts[k][a:b]):
                extra[k].append((a, kind, b))
    out = []
    for own, more in zip(base, extra):
        added, at, reach = [], 0, -1  # rule spans may overlap each other, by kind
        taken = sorted(own)
        for a, kind, b in sorted(more):
            while at < len(taken) and taken[at][0] < b:
                reach = max(reach, taken[at][2])
                at += 1
            if reach <= a:
                added.append((a, kind, b))
        out.append((own, sorted(own + added)))
    return out


def sound(kind: int, body: str) -> bool:
    """Whether a labelled span has what its kind cannot lack."""
    digits = "".join(c for c in body if "0" <= c <= "9")
    if kind == 0:
        return _ADDRESS.fullmatch(body) is not None
    if kind == 1:
        parts = re.findall(r"[0-9]+", body)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    return 12 <= len(digits) <= 19 and _luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def say(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id", field: Field | None = None) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of every row, without a shuffle."""
    field = field or default_field()
    kind = docs.select(key).schema.fields[0].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for k, end in store.chunks(store.utf8(batch.column(1))[1], CHUNK):
                found = find(texts[k:end], field)
                n = np.array([[sum(x == j for _, x, _ in own) for j in range(len(KINDS))] for own, _ in found], np.int64)
                columns = [keys.slice(k, end - k), *(pa.array(n[:, j]) for j in range(len(KINDS)))]
                columns.append(pa.array([hashlib.sha256(say(own).encode()).hexdigest() for own, _ in found]))
                columns.append(pa.array([say(every) for _, every in found]))
                columns.append(pa.array([len(every) for _, every in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=[key, *counts, "base_sha256", "spans", "n_spans"])

    return docs.select(key, text).mapInArrow(store.released(run), f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string, n_spans long")
