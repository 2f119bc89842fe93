"""Personal data: exact base patterns, and a semi-Markov conditional random field for the rest.

The base patterns (``email``, ``ip``, ``card``, ``phone``) are matched leftmost and
non-overlapping for each kind; matches failing their check are dropped without retry. They
always stay. The field then looks at what the patterns cannot decide: clusters of digit groups
(a phone number without its plus sign, cards that stand beside other digits, a card written
with dots) and clusters of words joined by signs or words for *at* and *dot* (``name [at] host [dot] com``). It scores whole
candidate segments - digit counts, group shape, checksum, separators, the form of the joints, cue words before them -
and an exact dynamic program over segment ends jointly chooses boundaries and types. Entities are
bounded (at most ``MAX_GROUPS`` groups or words, 19 digits), so the program is linear in the text. Chosen segments
that overlap no base span are added if their marginal probability is at least ``MIN_MARGINAL``.

The field's weights are fitted here by stochastic gradient on the exact conditional likelihood
over ``TRAIN_LINES`` synthetic lines of a seeded generator; no personal data is needed for it. A segment's features
depend on a small key (its shape and surroundings), and a key is scored once.

Defined results: null and empty texts have no spans; spans count code points, end exclusive;
repeated rows are treated alike; whole texts are scanned in linear time whatever their length.
Names of people, postal addresses and account numbers of other kinds are no candidates.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame

from chronofold.llm.common import arrow_map

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A digit run is entered at its first digit only: a failed run fails from each later digit too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_HAS_DIGIT = re.compile(r"[0-9]")

MAX_GROUPS = 8
MAX_GAP = 3
TRAIN_LINES = 900
MIN_MARGINAL = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _luhn_sums(digits: str) -> tuple[list[int], list[int]]:
    """Running checksums with the digits at odd places doubled, and with those at even places."""
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    values = [ord(c) - 48 for c in digits]
    even = accumulate((twice[v] if k & 1 else v for k, v in enumerate(values)), initial=0)
    odd = accumulate((v if k & 1 else twice[v] for k, v in enumerate(values)), initial=0)
    return list(even), list(odd)


def _emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        start = at
        if m:
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
        if m and start < at:
            found.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """The spans of the base patterns, by kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    if "@" in text:
        out["email"] = _emails(text)
    if not _HAS_DIGIT.search(text):
        return out
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out["phone"].append(m.span())
    return out


# --- the field -------------------------------------------------------------------------------

#: Cue words by the kind they announce; ``ref`` is what looks alike and is no one's data.
CUES = {
    "phone": "phone tel telephone call mobile cell fax contact whatsapp telefon téléphone teléfono móvil handy rufnummer appelez llame sms dial ring".split(),
    "card": "card visa mastercard amex credit debit payment karte carte tarjeta kreditkarte".split(),
    "ip": "ip address host server addr ipv4 adresse dirección".split(),
    "email": "email mail e-mail correo courriel write reach".split(),
    "ref": "isbn issn order invoice ref reference tracking serial id no nr version section chapter room lot page item build sku ticket case bestellung rechnung commande factura pedido seite".split(),
}
_CUE_OF = {w: k for k, ws in CUES.items() for w in ws}
#: Words before *at* that are seldom a mailbox.
NO_LOCAL = frozenset("us me you it him her them look looked visit find see meet arrive arrived live work available online only all and or is are was not available stay be here there out now".split())
_CLUSTER = re.compile(r"[+(]{0,2}[0-9]++(?:[\x20().\-+/ ]{1,3}[0-9]++)*+")
_AT = r"\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?|\x20(?:at|AT|@)\x20"
_DOT = r"\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\x20(?:dot|DOT)\x20|\."
_ADDRESS_WORD = r"[A-Za-z0-9_%+-]++"
_JOINTS = re.compile(rf"(?<![A-Za-z0-9_%+-]){_ADDRESS_WORD}(?:(?:{_AT}|{_DOT}){_ADDRESS_WORD})++")
_JOINT = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})")
_WORD_BEFORE = re.compile(r"([^\W\d_][\w-]*)[\s:=#.]*\Z")


def _cue(text: str, start: int) -> str:
    m = _WORD_BEFORE.search(text[max(0, start - 24) : start])
    return _CUE_OF.get(m.group(1).lower(), "none") if m else "none"


def _clusters(text: str) -> list[list[tuple[int, int]]]:
    """Runs of digit groups with short gaps, each a list of the groups' spans."""
    return [[(m.start() + g.start(), m.start() + g.end()) for g in _DIGITS.finditer(m.group())] for m in _CLUSTER.finditer(text) if m.end() - m.start() >= 7]


def _addresses(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words joined by forms of *at* and *dot* that hold both, each a list of the words' spans."""
    found = []
    for m in _JOINTS.finditer(text):
        joints = list(_JOINT.finditer(text, m.start(), m.end()))
        at = [j["at"] is not None for j in joints]
        if any(at) and not all(at):
            found.append(list(zip([m.start()] + [j.end() for j in joints], [j.start() for j in joints] + [m.end()])))
    return found


#: (cut where it starts, kind or None, start, end, key of its features)
Segment = tuple[int, str | None, int, int, tuple]


def _digit_segments(text: str, groups: list[tuple[int, int]]) -> list[list[Segment]]:
    """For each cut, the segments of digit groups that end there."""
    n = len(groups)
    cuts: list[list[Segment]] = [[] for _ in range(n + 1)]
    sizes = [b - a for a, b in groups]
    digits = [text[a:b] for a, b in groups]
    gaps = [g.strip() or ("_" if g else "") for g in (text[groups[k][1] : groups[k + 1][0]] for k in range(n - 1))]
    upto = list(accumulate(sizes, initial=0))
    even, odd = _luhn_sums("".join(digits))
    alike = [0] * n  # from which gap on all are the same as this one
    for k in range(1, n - 1):
        alike[k] = alike[k - 1] if gaps[k] == gaps[k - 1] else k
    cues: dict[int, str] = {}
    for j in range(1, n + 1):
        cuts[j].append((j - 1, None, *groups[j - 1], ("out",)))
        end = groups[j - 1][1]
        after = text[end : end + 1]
        for i in range(j - 1, max(-1, j - 1 - MAX_GROUPS), -1):
            total = upto[j] - upto[i]
            if total > 19:
                break
            four = j - i == 4
            if total < 7 and not (four and total >= 4):
                continue
            start = groups[i][0]
            left = text[max(0, start - 2) : start]
            if left and left[-1] in "+(":
                body = text[start:end]
                if left[-1] == "+" or body.count(")") > body.count("("):
                    start -= len(left) - len(left.rstrip("+("))
            octets = four and gaps[i : j - 1] == [".", ".", "."] and all(len(g) <= 3 and int(g) <= 255 for g in digits[i:j])
            if start not in cues:
                cues[start] = _cue(text, start)
            before = text[start - 1 : start] if start else ""
            head = text[start : groups[i][0] + 1]
            inner = gaps[i : j - 1]
            key = (
                total,
                tuple(sizes[i:j]),
                "" if not inner else inner[0] if alike[j - 2] <= i else "|".join(sorted(set(inner))),
                total >= 13 and ((even if upto[j] % 2 else odd)[upto[j]] - (even if upto[j] % 2 else odd)[upto[i]]) % 10 == 0,
                octets,
                head[0] == "+",
                "(" in head or any("(" in g for g in inner),
                cues[start],
                before.isalnum() or after.isalnum(),
                before if before in (".", ",", "-", "/") else "",
                after if after in ("-", "/") else "",
            )
            for kind in ("ip", "card", "phone"):
                if kind == "ip" and not four or kind == "card" and total < 12 or kind == "phone" and not 7 <= total <= 15:
                    continue
                cuts[j].append((i, kind, start, end, (kind, *key)))
    return cuts


def _form(joint: str) -> str:
    return joint.strip().lower() if joint.strip() not in ("at", "dot") else "plain"


def _address_segments(text: str, words: list[tuple[int, int]]) -> list[list[Segment]]:
    """For each cut, the segments of joined words that end there: a mailbox of up to three words, one *at*, a host of two or more."""
    n = len(words)
    joints = [text[words[k][1] : words[k + 1][0]] for k in range(n - 1)]
    is_at = [_JOINT.fullmatch(j)["at"] is not None for j in joints]
    cuts: list[list[Segment]] = [[] for _ in range(n + 1)]
    for j in range(1, n + 1):
        cuts[j].append((j - 1, None, *words[j - 1], ("out",)))
        for i in range(j - 3, max(-1, j - 1 - MAX_GROUPS), -1):
            ats = [k for k in range(i, j - 1) if is_at[k]]
            if len(ats) != 1 or j - 1 - ats[0] < 2 or ats[0] - i > 2:
                continue
            (at,) = ats
            start, end = words[i][0], words[j - 1][1]
            last, local = text[slice(*words[j - 1])], text[start : words[at][1]].lower()
            dots = {_form(d) for d in joints[at + 1 : j - 1]}
            key = (
                _form(joints[at]),
                "|".join(sorted(dots)),
                last.isalpha() and 2 <= len(last) <= 6,
                local in NO_LOCAL,
                any(c in "._%+-" or c.isdigit() for c in local),
                min(j - 1 - at, 4),
                at - i,
                _cue(text, start),
                i > 0 and not is_at[i - 1],
                j < n and not is_at[j - 1],
            )
            cuts[j].append((i, "email", start, end, ("email", *key)))
    return cuts


_NAMES = {
    "email": ("at", "dot", "tld", "nolocal", "marked", "labels", "locals", "cue", "cutleft", "cutright"),
    **{k: ("digits", "shape", "gaps", "luhn", "octets", "plus", "paren", "cue", "glued", "left", "right") for k in ("ip", "card", "phone")},
}


def _features(key: tuple) -> list[str]:
    """The names of a segment's features, from its key."""
    if key[0] == "out":
        return ["out"]
    kind, found = key[0], dict(zip(_NAMES[key[0]], key[1:]))
    out = [f"{kind}:bias"] + [f"{kind}:{n}={v}" for n, v in found.items()]
    if kind == "email":
        out.append(f"{kind}:joints={found['at']},{found['dot']},{found['tld']}")
        out.append(f"{kind}:plain={found['at'] == 'plain'},{found['dot']},{found['nolocal']}")
    else:
        sizes = found["shape"]
        out.append(f"{kind}:even={len(set(sizes)) == 1},{min(len(sizes), 5)}")
        out.append(f"{kind}:luhn={found['luhn']},{found['digits']},{found['cue'] == 'ref'}")
    return out


class Field:
    """A semi-Markov field over the groups or words of a cluster; segments are outside or of one kind."""

    def __init__(self) -> None:
        self.w: dict[str, float] = defaultdict(float)
        self.known: dict[tuple, float] = {}  # scores by key, while weights stand

    def _score(self, key: tuple) -> float:
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[key] = sum(self.w.get(f, 0.0) for f in _features(key))
        return got

    def marginals(self, cuts: list[list[Segment]]) -> list[list[float]]:
        n = len(cuts)
        score = [[self._score(s[4]) for s in c] for c in cuts]
        fwd, bwd = [-math.inf] * n, [-math.inf] * n
        fwd[0] = bwd[n - 1] = 0.0
        for j in range(1, n):
            terms = [fwd[s[0]] + x for s, x in zip(cuts[j], score[j])]
            top = max(terms)
            fwd[j] = top + math.log(sum(math.exp(t - top) for t in terms))
        for j in range(n - 1, 0, -1):
            for s, x in zip(cuts[j], score[j]):
                a, b = bwd[s[0]], bwd[j] + x
                bwd[s[0]] = b if a == -math.inf else max(a, b) + math.log1p(math.exp(-abs(a - b)))
        z = fwd[n - 1]
        return [[math.exp(fwd[s[0]] + x + bwd[j] - z) for s, x in zip(cuts[j], score[j])] for j in range(n)]

    def learn(self, cuts: list[list[Segment]], gold: set[tuple[str, int, int]], rate: float) -> None:
        self.known.clear()
        probs = self.marginals(cuts)
        covered = set()
        for j in range(1, len(cuts)):
            for s in cuts[j]:
                if s[1] is not None and (s[1], s[2], s[3]) in gold:
                    covered.update(range(s[0], j))
        for j in range(1, len(cuts)):
            for s, p in zip(cuts[j], probs[j]):
                right = (s[1], s[2], s[3]) in gold if s[1] is not None else j - 1 not in covered
                if abs(g := rate * (float(right) - p)) > 1e-9:
                    for f in _features(s[4]):
                        self.w[f] += g

    def decode(self, cuts: list[list[Segment]]) -> list[tuple[str, int, int, float]]:
        """The best segmentation's entities, with their marginal probabilities."""
        best, back = [0.0] + [-math.inf] * (len(cuts) - 1), [0] * len(cuts)
        for j in range(1, len(cuts)):
            for k, s in enumerate(cuts[j]):
                v = best[s[0]] + self._score(s[4])
                if v > best[j]:
                    best[j], back[j] = v, k
        chosen, j = [], len(cuts) - 1
        while j > 0:
            s = cuts[j][back[j]]
            if s[1] is not None:
                chosen.append((j, back[j]))
            j = s[0]
        if not chosen:
            return []
        probs = self.marginals(cuts)
        return [(cuts[j][k][1], cuts[j][k][2], cuts[j][k][3], probs[j][k]) for j, k in reversed(chosen)]


def _synthetic(rng: random.Random) -> tuple[str, set[tuple[str, int, int]]]:
    """One line of made-up text with labelled digits of all sorts, entities and others."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(["an", "er", "tion", "the", "que", "ung", "ción", "de", "la"]) for _ in range(rng.randint(1, 4)))

    def card() -> str:
        body = rng.choice("3456") + d(rng.choice([13, 14, 14, 14, 14]))
        number = next(body + c for c in "0123456789" if luhn(body + c))
        if len(number) == 16 and rng.random() < 0.4:
            sep = rng.choice([" ", "-", "."])
            return sep.join(number[k : k + 4] for k in range(0, 16, 4))
        return number

    def phone() -> str:
        area, a, b = d(3), d(3), d(4)
        return rng.choice([f"({area}) {a}-{b}", f"({area}) {a} {b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"+1 ({area}) {a}-{b}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}"])

    def national() -> str:  # written as many numbers are: only the word before tells
        return rng.choice([f"0{d(2)} {d(7)}", f"0{d(3)} {d(6)}", f"0{d(3)}/{d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)} {d(3)} {d(3)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(9)}", f"{d(10)}"])

    def mail() -> str:
        name = lambda: rng.choice("anna max john maria lee peter sofia karl lucas info sales press j.doe a.b mary_k tom77 kim2".split())
        tld = rng.choice("com org net de fr es io co.uk edu".split())
        host = rng.choice("mail example web post firma uni acme site my-host".split())
        at, dot = rng.choice([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" [at] ", "."), (" AT ", " DOT "), (" at ", " dot "), ("{at}", "{dot}"), (" @ ", "."), (" <at> ", " <dot> "), (" (@) ", ".")])
        local = name() if rng.random() < 0.7 or dot == "." else name() + dot + name()
        return local + at + dot.join([host, *tld.split(".")])

    def ip() -> str:
        return ".".join(str(rng.randint(1, 255)) for _ in range(4))

    def other() -> str:
        isbn = f"97{rng.choice('89')}-{d(1)}-{d(2)}-{d(6)}-"
        isbn += d(1) if rng.random() < 0.5 else next(c for c in "0123456789" if luhn(re.sub("-", "", isbn) + c))
        refs = [f"{rng.choice(CUES['ref'])} {x}" for x in (isbn, d(16), d(13), d(10), f"{d(3)} {d(3)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}", f"{d(1)}.{d(1)}.{d(1)}.{d(1)}", f"{d(3)}-{d(7)}", f"{d(4)}/{d(6)}")]
        where = [f"{rng.choice(sorted(NO_LOCAL))} at {word()}.{rng.choice(['com', 'org', 'de'])}", f"{word()} at {word()}. {word()}", f"{word()} [at] {word()}", f"{word()}.{word()} at {word()}", f"{word()} at noon.{word()}"]
        return rng.choice([*refs, *where, *where, d(rng.randint(1, 12)), d(16), d(20), f"{d(1)}.{d(1)}", f"{d(1)}.{d(2)}.{d(1)}", f"19{d(2)}-{d(2)}-{d(2)}", f"20{d(2)}-{d(2)}-{d(2)} {d(2)}:{d(2)}", f"{d(4)}/{d(2)}/{d(2)}", f"{d(3)} {d(3)}", f"{d(2)} {d(2)} {d(2)}", f"{d(5)}-{d(4)}", f"{d(3)}-{d(2)}-{d(1)}", f"{d(3)},{d(3)}", f"{d(4)}-{d(4)}", f"{d(4)} {d(4)}"])

    text, gold = word(), set()
    last = None
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["card", "phone", "phone", "ip", "email", None, None, None, None])
        told = kind == "phone" and rng.random() < 0.4
        body = national() if told else {"card": card, "phone": phone, "ip": ip, "email": mail, None: other}[kind]()
        if kind == "card" and last and last[0] == "card" and rng.random() < 0.8:
            text += " "
            if rng.random() < 0.5:
                body = last[1]
        else:
            text += " " + word() + (" " + rng.choice(CUES[kind]) + rng.choice([": ", " "]) if kind and (told or rng.random() < 0.3) else " ")
        start = len(text)
        text += body
        if kind:
            gold.add((kind, start, len(text)))
        last = (kind, body)
        if not (kind == "card" and rng.random() < 0.5):
            text += rng.choice([" ", ". ", ", ", "### ", "!! "]) + word()
            last = None
    return text, gold


@lru_cache(maxsize=1)
def fitted() -> Field:
    """The field, fitted once in each process; the seed makes it the same everywhere."""
    rng, field = random.Random(7), Field()
    lines = []
    for _ in range(TRAIN_LINES):
        text, gold = _synthetic(rng)
        lines += [(_digit_segments(text, groups), gold) for groups in _clusters(text)]
        lines += [(_address_segments(text, words), gold) for words in _addresses(text)]
    for epoch in range(5):
        rng.shuffle(lines)
        for cuts, gold in lines:
            field.learn(cuts, gold, 0.3 / (1 + epoch))
    field.known.clear()
    return field


#: Long clusters are decoded in windows of so many groups; each side's margin is decoded but left to the neighbour.
WINDOW, MARGIN = 512, 32


def _decode_windows(text: str, groups: list[tuple[int, int]], segments=_digit_segments) -> list[tuple[str, int, int, float]]:
    """The entities of a cluster in memory that doesn't grow with it; entities are far shorter than a margin."""
    if len(groups) <= WINDOW:
        return fitted().decode(segments(text, groups))
    found = []
    for lo in range(0, len(groups), WINDOW - 2 * MARGIN):
        hi = min(len(groups), lo + WINDOW)
        first = groups[lo + MARGIN if lo else 0][0] if lo + MARGIN < len(groups) else len(text)
        last = groups[hi - MARGIN][0] if hi < len(groups) else len(text)
        found += [x for x in fitted().decode(segments(text, groups[lo:hi])) if first <= x[2] < last or hi == len(groups) and first <= x[2]]
        if hi == len(groups):
            break
    return list(dict.fromkeys(found))


def find_spans(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans, and the field's spans beside them, by kind."""
    base = base_spans(text)
    added: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return base, added
    taken = sorted(s for spans in base.values() for s in spans)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))

    def free(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return before == 0 or reach[before - 1] <= start

    low = text.lower() if "at" in text or "AT" in text or "@" in text else ""
    if "at" in low or "@" in low:
        for words in _addresses(text):
            added["email"] += [(s, e) for _, s, e, p in _decode_windows(text, words, _address_segments) if p >= MIN_MARGINAL and free(s, e)]
    if _HAS_DIGIT.search(text):
        for groups in _clusters(text):
            k = bisect_left(starts, groups[0][0] + 1)
            if k and reach[k - 1] >= groups[-1][1]:  # inside what a base pattern took
                continue
            for kind, s, e, p in _decode_windows(text, groups):
                if p >= MIN_MARGINAL and free(s, e):
                    added[kind].append((s, e))
    return base, added


def _listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``base`` and ``spans`` (``kind:start:end`` lists) and a count of base spans per kind; a map without shuffle."""
    passing = [c for c in docs.columns if c not in (text_col, "base", "spans", *(f"n_{k}" for k in KINDS))]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passing] + [f"n_{k} bigint" for k in KINDS] + ["base string", "base_sha256 string", "spans string"])

    def run(batch: dict) -> dict:
        out: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base": [], "base_sha256": [], "spans": []}
        for text in batch[text_col].to_pylist():
            base, added = find_spans(text)
            listed = _listed(base)
            for k in KINDS:
                out[f"n_{k}"].append(len(base[k]))
            out["base"].append(listed)
            out["base_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
            out["spans"].append(_listed({k: base[k] + added[k] for k in KINDS}))
        return {c: batch[c] for c in passing} | out

    return arrow_map(docs.select(*passing, text_col), run, schema)


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first stays."""
    if text is None:
        return None
    base, added = find_spans(text)
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k in KINDS for s, e in base[k] + added[k]):
        if s >= at:
            out += [text[at:s], f"[{k}]"]
            at = e
    return "".join(out) + text[at:]
