"""Personal data: exact base rules, and a linear-chain conditional random field over word shapes.

The field is trained on the driver's own small labelled table (`labelled`, some hundred made-up lines from a fixed
seed, independent of the corpus) and finds what the base rules don't: numbers without a country's prefix or written in words' distance, spelled-out
addresses, addresses of six bytes' notation, card numbers with other separators, and what stands so close together that the base rules take it for one.
What a kind can't be (too few digits, a failing check digit) is dropped from its spans, and so is what overlaps a base span; which of the plausible
strings are personal data is the field's decision.

Defined results: null and empty texts have no spans; a text's spans don't depend on other rows; repeated rows are
judged alike; an empty table gives no rows; very long texts are worked through in segments between words that are surely outside; further columns of any name stay as they are.
"""

from __future__ import annotations

import ipaddress
import random
import re
from functools import cache

from pyspark.sql import DataFrame

from clausegrain.llm import spans
from clausegrain.llm.common import Shared
from clausegrain.llm.crf import Crf
from clausegrain.llm.spans import Finder, Span

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: As a run of digits is taken whole or not at all, looking back only spares the tries from within one.
IP = re.compile(rb"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = bytes(48 if 48 <= c <= 57 else c for c in range(256))
NOT_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)


def luhn(digits: bytes) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_card(match: bytes) -> bool:
    digits = match.translate(None, NOT_DIGITS)
    return 12 <= len(digits) <= 19 and luhn(digits)


def is_ip(parts: tuple[bytes, ...]) -> bool:
    return all(len(x := p.lstrip(b"0")) <= 3 and int(x or b"0") <= 255 for p in parts)


def emails(text: bytes) -> list[Span]:
    """Each @ with the run of local characters before it, if a domain follows; the leftmost match begins with the run."""
    out, last = [], 0
    at = text.find(b"@")
    while at >= 0:
        begin = last + len(text[last:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end(), "email"))
        last = m.end() if m else at + 1
        at = text.find(b"@", last)
    return out


def base(text: bytes) -> list[Span]:
    out = emails(text) if b"@" in text else []
    digits = text.translate(DIGITS)
    if b"0" not in digits:
        return out
    if b"0.0" in digits:
        out += [(*m.span(), "ip") for m in IP.finditer(text) if is_ip(m.groups())]
    out += [(*m.span(), "card") for m in CARD.finditer(text) if m.end() - m.start() >= 12 and is_card(m.group())]
    if b"+0" in digits:
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(m.group().translate(None, NOT_DIGITS)) <= 15]
    return out


# ---------------------------------------------------------------- the model

EDGE = b".,;:!?\"'()[]<>{}*#$%&|"
CUES = frozenset(b"phone tel telephone mobile call fax cell email e-mail mail contact card visa mastercard credit ip address host server number no ring dial reach write pay charged billed ping via".split())
BETWEEN = frozenset((b"at", b"dot"))


def describe(word: bytes) -> tuple:
    """Shape and cue features of a word; words of letters alone differ by cue only."""
    core = word.strip(EDGE).lower()
    if core.isalpha() or not core.isascii():
        if core in BETWEEN and word[:1] in b"([{<":
            return ("bracket=" + core.decode(),)
        return ("plain", "cue=" + core.decode()) if core in CUES else ("plain",)
    n = len(core.translate(None, NOT_DIGITS))
    shape = re.sub(rb"[a-z]+", b"a", re.sub(rb"[0-9]+", b"0", core))[:12].decode("latin-1")
    out = ["shape=" + shape, f"digits={n if n < 5 else '5-8' if n < 9 else '9-15' if n < 16 else '16+'}", f"dots={min(3, core.count(b'.'))}"]
    if n and not core.translate(None, b"0123456789-().+/ "):
        out.append("number")
        runs = re.findall(rb"[0-9]+", core)
        out.append("runs=" + "-".join(str(min(5, len(x))) for x in runs[:5]))
        out.append(f"n_runs={min(5, len(runs))}")
        if n >= 7 and len(runs) > 1:
            out.append("long in parts")
    if word[:1] == b"(" and n:
        out.append("paren")
    if word[:1] == b"+":
        out.append("plus")
    if b"@" in core:
        out.append("at")
    if core in CUES:
        out.append("cue=" + core.decode())
    if any(x in word.lower() for x in (b"[at]", b"(at)", b"{at}", b"<at>")):
        out.append("at inside")
    if core.count(b":") > 1 and not core.translate(None, b"0123456789abcdef:"):
        out.append(f"colons={min(4, core.count(b':'))}")
    if is_card(core):
        out.append("luhn")
    if address(core):
        out.append("octets")
    return tuple(out)


def address(core: bytes) -> bool:
    """Whether it reads as an internet address, of four or six bytes' notation, with or without brackets around its dots."""
    if not (core[:1].isalnum() or core[:1] == b":") or core.count(b".") + core.count(b":") < 2:
        return False
    try:
        ipaddress.ip_address(core.replace(b"[.]", b".").replace(b"(.)", b".").decode())
    except ValueError:
        return False
    return True


def labelled(lines: int = 900, seed: int = 7) -> tuple[list[list[bytes]], list[list[int]]]:
    """The labelled table: lines of made-up words, some with personal data, some with numbers that are none."""
    r = random.Random(seed)
    syllables = "ta lo mi rek san du vor pel ing ous tion ét ñar schö".split()
    name = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    plain = lambda: (name() if r.random() < 0.8 else name().title()) + r.choice(["", "", "", ",", ".", "***", "%%%", "|"])
    ascii_name = lambda: "".join(r.choice(syllables[:11]) for _ in range(r.randint(1, 3)))
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = d(r.choice([15, 15, 15, 14, 12]))
        return next(body + c for c in "0123456789" if luhn((body + c).encode()))

    octets = lambda sep=".": sep.join(str(r.randint(0, 255)) for _ in range(4))
    hexes = lambda n: ":".join(f"{r.randint(0, 65535):x}" for _ in range(n))
    groups = lambda c, sep: sep.join(c[i : i + 4] for i in range(0, len(c), 4))
    domain = lambda: f"{ascii_name()}.{r.choice(['com', 'org', 'net', 'co.uk'])}"
    found = [
        ("phone", lambda: f"({d(3)}) {d(3)}-{d(4)}"), ("phone", lambda: f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}"), ("phone", lambda: f"{d(3)}{r.choice('-./')}{d(3)}{r.choice('-.')}{d(4)}"), ("phone", lambda: f"+{d(2)} {d(3)} {d(3)} {d(3)}"),
        ("phone", lambda: f"{d(3)} {d(3)} {d(4)}"), ("phone", lambda: f"0{d(r.randint(2, 4))}{r.choice('/- ')}{d(r.randint(5, 8))}"), ("phone", lambda: f"00{d(2)} {d(2)} {d(4)} {d(4)}"), ("phone", lambda: f"({d(3)}){d(3)}-{d(4)}"), ("phone", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"),
        ("email", lambda: f"{ascii_name()}.{ascii_name()}@{domain()}"), ("email", lambda: f"{ascii_name()}{d(2)}@{domain()}"), ("email", lambda: f"{ascii_name()} {r.choice(['(at)', '[at]', '{at}'])} {domain()}"), ("email", lambda: f"{ascii_name()}{r.choice(['(at)', '[at]'])}{domain()}"),
        ("email", lambda: f"{ascii_name()} {r.choice(['(at)', '[at]'])} {ascii_name()} {r.choice(['(dot)', '[dot]'])} com"), ("email", lambda: f"{ascii_name()}[at]{ascii_name()}[dot]org"),
        ("ip", octets), ("ip", lambda: octets("[.]")), ("ip", lambda: hexes(8)), ("ip", lambda: f"{hexes(r.randint(2, 4))}::{hexes(r.randint(1, 3))}"),
        ("card", card), ("card", card), ("card", lambda: groups(card(), r.choice(" -./_"))), ("card", lambda: groups(card(), " ")),
    ]
    none = [lambda: d(r.randint(1, 4)), lambda: f"{r.randint(1900, 2030)}-{d(2)}-{d(2)}", lambda: f"{d(2)}/{d(2)}/{r.randint(1900, 2030)}", lambda: f"{d(2)}.{d(2)}.{r.randint(1900, 2030)}", lambda: f"{d(1)}.{d(1)}.{d(1)}", lambda: f"{d(2)}:{d(2)}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: d(16), lambda: f"{d(2)}.{d(2)}", lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"http://{ascii_name()}.com/{d(3)}", lambda: f'"{d(6)}{ascii_name()}{d(9)}"', lambda: f"@{ascii_name()}", lambda: f"300.{d(3)}.999.{d(1)}", lambda: f"{d(5)}-{d(4)}", lambda: f"#{d(4)}", lambda: f"{d(10)}", lambda: f"1990-{d(4)}", lambda: f"{d(2)} - {d(2)}", lambda: f"({d(1)})", lambda: "meet at the " + ascii_name() + ".com", lambda: f"{d(3)} {ascii_name()}", lambda: f"{d(2)} {d(3)}", lambda: f"pages {d(2)}-{d(2)}", lambda: f"v{d(1)}.{d(2)}.{d(1)}", lambda: f"({ascii_name()}) {ascii_name()}", lambda: f"{ascii_name()}-{d(5)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{d(3)} {d(3)} euro", lambda: f"{ascii_name()}:{d(2)}"]
    cues = {"phone": ["phone:", "Tel.", "call", "mobile", "fax", "dial"], "email": ["email:", "contact", "mail", "write"], "ip": ["host", "ip", "server", "ping"], "card": ["card", "visa", "credit", "charged", "pay"]}
    texts, tags = [], []
    for _ in range(lines):
        words, mark = [], []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(0, 5)):
                words.append(plain())
                mark.append(0)
            for _ in range(1 if r.random() < 0.85 else 2):  # now and then two side by side
                kind, make = r.choice(found) if r.random() < 0.6 else ("", r.choice(none))
                if kind and r.random() < 0.4:
                    words.append(r.choice(cues[kind]))
                    mark.append(0)
                own = (make() + r.choice(["", "", "", ".", ",", ")", "###", "!!"])).split(" ")
                words += own
                mark += [1 + 2 * KINDS.index(kind) + (k > 0) for k in range(len(own))] if kind else [0] * len(own)
            for _ in range(r.randint(0, 3)):
                words.append(plain())
                mark.append(0)
        texts.append([w.encode() for w in words])
        tags.append(mark)
    return texts, tags


#: What a span of a kind can hold, as a search for its places.
NUMBER = re.compile(rb"\+?\(?[0-9][0-9 ()+./-]*[0-9]")
CARDS = re.compile(rb"[0-9](?:[ ._/-]?[0-9])+")
AROUND_AT = re.compile(rb"[A-Za-z0-9._%+-]+\x20?[\[({<]at[\])}>]\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?[\[({<]dot[\])}>]\x20?)[A-Za-z0-9-]+)+", re.I)
ADDRESS = re.compile(rb"[0-9A-Fa-f:.\[\]()]+")


def accept(text: bytes, begin: int, end: int, kind: str) -> list[tuple[int, int]]:
    """The places within the words from begin to end that can be of the kind."""
    part = text[begin:end]
    if kind == "phone":
        found = [m.span() for m in NUMBER.finditer(part) if 7 <= len(m.group().translate(None, NOT_DIGITS)) <= 15]
    elif kind == "email":
        found = [(a, b) for a, b, _ in emails(part)] or [m.span() for m in AROUND_AT.finditer(part)]
    elif kind == "card":
        whole = list(CARDS.finditer(part))
        found = [m.span() for m in whole if is_card(m.group())]
        if not found:  # several, side by side
            found = [m.span() for m in re.finditer(rb"[0-9]+", part) if is_card(m.group())]
    else:
        found = []
        for m in ADDRESS.finditer(part):
            core = m.group().strip(b".[]()")
            if address(core):
                at = m.start() + m.group().index(core)
                found.append((at, at + len(core)))
    return [(begin + a, begin + b) for a, b in found]


@cache
def trained() -> Finder:
    """The finder, trained once on the driver; its weights travel to the tasks."""
    return Finder(KINDS, base, Crf(TAGS, describe).fit(*labelled(), rounds=100), KINDS, accept)


def table_of(docs: DataFrame) -> DataFrame:
    model = Shared(docs.sparkSession, trained())
    return spans.table_of(docs, "pii", lambda: model.value, KINDS)


def masked(docs: DataFrame) -> DataFrame:
    model = Shared(docs.sparkSession, trained())
    return spans.masked(docs, "pii", lambda: model.value)
