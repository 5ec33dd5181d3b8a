"""Secrets: exact base rules, and a linear-chain conditional random field that tags words as begin, inside or outside.

Its features are a word's shape (length, mix of letters, digits and cases, changes between them, entropy), the two words beside it, and the
file's kind (prose, settings, or code, told by the share of words with = : { } ;). It is trained on the driver from a
small table of made-up lines of a fixed seed, and decoded by Viterbi. Every word of a span that it finds is a secret of its own, without the
name and marks around it, unless it can't be one (fewer than ten characters, digits and marks alone, a URL, a mail address) or overlaps a base span: what looks like a key
is the field's to tell, by how a word's letters follow one another too.

Defined results: null and empty texts have no spans; a text's spans don't depend on other rows; repeated rows are
judged alike; an empty table gives no rows; very long texts are worked through in segments between words that are surely outside; further columns of any name stay as they are.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from functools import cache

from pyspark.sql import DataFrame

from clausegrain.llm import spans
from clausegrain.llm.common import Shared
from clausegrain.llm.crf import Crf
from clausegrain.llm.spans import Finder, Span

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "model")
TAGS = ("O", "B", "I")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Runs of such characters are taken whole, so those of 16 and more are the same matches.
HEX = re.compile(rb"[0-9a-f]{16,}")
HEX_RUN = bytes(104 if 48 <= c <= 57 or 97 <= c <= 102 else 32 for c in range(256))


def base(text: bytes) -> list[Span]:
    out: list[Span] = []
    lower = text.lower()
    if any(n in lower for n in NAMES):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"h" * 16 in text.translate(HEX_RUN):
        out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return out


# ---------------------------------------------------------------- the model

EDGE = b".,;:?\"'()[]<>{}*#$%&|`"
CUES = frozenset(b"password passwd pwd secret token apikey api_key key bearer auth authorization credential credentials private access login pass is =".split()) | {b""}
BODY = re.compile(rb"[A-Za-z0-9+/_.=!@~^-]{10,}")
#: What begins a value: a name and = or :, or a scheme and a user before a password.
NAMED = re.compile(rb"[A-Za-z_][A-Za-z0-9_.-]{0,29}[\"']?[=:][\"'`]?(?=[^/=:])")
MAIL = re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+")


def entropy(word: bytes) -> float:
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values()) if n else 0.0


CLASS = bytes(0 if 48 <= c <= 57 else 1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 else 3 for c in range(256))


#: Forms of identifiers that are made to be seen.
UUID = re.compile(rb"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
FILE = re.compile(rb"(?:.*/)?[^/]*[A-Za-z][^/]*\.[a-z]{1,5}[0-9]?(?:\(\))?")
VERSION = re.compile(rb"v?[0-9]+(?:[.][0-9]+)+(?:[-+.][0-9A-Za-z.]+)?")
VOWELS = bytes(1 if c in b"aeiouyAEIOUY" else 0 if chr(c).isalpha() and c < 128 else 2 for c in range(256))


# Letters that often follow one another in the languages of Western Europe.
PAIRS = frozenset("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur el la ie ei un ge sc au us ss di da so qu do ta na ca hl lt ht ig ke rt ns ut ac sh il et mi wh bl lo no po pe ad ue ai eu oi iq ux ez ja vi ra is us".split())


def spoken(core: bytes) -> tuple:
    """How a word's letters follow one another: the share of frequent pairs, the longest run without a vowel, the share of vowels, and how often capitals stand where words begin."""
    kinds = core.translate(VOWELS)
    letters = len(kinds) - kinds.count(2)
    if letters < 8:
        return ()
    run = max(map(len, re.split(rb"[\x01\x02]+", kinds)), default=0)
    share = 100 * kinds.count(1) // letters
    parts = re.findall(rb"[A-Z]?[a-z]+|[A-Z]+|[0-9]+", core)
    mean = len(core) // max(1, len(parts))
    low = re.sub(rb"[^a-z]+", b" ", core.lower()).decode()
    pairs = [low[k : k + 2] for k in range(len(low) - 1) if " " not in low[k : k + 2]]
    often = 100 * sum(p in PAIRS for p in pairs) // max(1, len(pairs))
    return (f"pairs={'0-14' if often < 15 else '15-24' if often < 25 else '25-34' if often < 35 else '35-49' if often < 50 else '50+'}", f"dry={'0-3' if run < 4 else '4' if run < 5 else '5' if run < 6 else '6-7' if run < 8 else '8+'}", f"vowels={'0-14' if share < 15 else '15-24' if share < 25 else '25-31' if share < 32 else '32+'}", f"pieces={min(mean, 8)}", "talks" if often >= 35 and mean >= 4 else "mumbles")


def describe(word: bytes) -> tuple:
    core = word.strip(EDGE)
    lower = core.lower()
    if core.isalpha() and len(core) < 16 or not core.isascii():
        return ("plain", "cue=" + lower.decode(), "asks" if word[-1:] in b":=" else "says") if lower in CUES and core else ("plain",)
    m = NAMED.match(core)
    if m and len(core) - m.end() >= 8:
        name = re.split(rb"[\"'=:]", m.group(), maxsplit=1)[0].lower()
        out = ["pair", "name=" + (name.decode() if name in CUES else "cue" if any(x in name for x in (b"key", b"token", b"secret", b"pass")) else "other")]
        core = core[m.end() :].strip(EDGE)
    else:
        out = ["cue=" + lower.decode()] if lower in CUES else ["word"]
    n = len(core)
    kinds = core.translate(CLASS)
    digit, upper, small = (kinds.count(k) for k in (0, 1, 2))
    out.append("mix=" + "".join(x for x, on in zip("dUl", (digit, upper, small), strict=True) if on))
    out.append(f"len={'0-5' if n < 6 else '6-9' if n < 10 else '10-15' if n < 16 else '16-23' if n < 24 else '24+'}")
    out.append(f"entropy={min(5, int(entropy(core)))}")
    changes = sum((a == 0) != (b == 0) and 3 not in (a, b) for a, b in zip(kinds, kinds[1:], strict=False))
    out.append(f"changes={changes if changes < 3 else '3-5' if changes < 6 else '6+'}")
    cases = sum({a, b} == {1, 2} for a, b in zip(kinds, kinds[1:], strict=False))
    out.append(f"cases={cases if cases < 2 else '2-4' if cases < 5 else '5+'}")
    out.append(f"marks={min(3, kinds.count(3))}")
    longest = max(map(len, re.split(rb"[^A-Za-z0-9]+", core)), default=0)
    out.append(f"part={'0-9' if longest < 10 else '10-19' if longest < 20 else '20+'}")
    out.append("only" if not core.translate(None, b"0123456789.,:-+()/T Z") else "body" if BODY.fullmatch(core) else "other")
    if digit and changes * 6 >= n - kinds.count(3):
        out.append("mixed up")
    form = "uuid" if UUID.fullmatch(core) else "version" if VERSION.fullmatch(core) else "file" if FILE.fullmatch(core) else "other"
    out.append(f"form={form}")
    out += spoken(core)
    if kinds.count(3) and all(p.isalpha() and p.islower() or p.isdigit() and len(p) < 5 for p in re.split(rb"[^A-Za-z0-9]+", core) if p):
        out.append("words and numbers")
    if word[-1:] in b":=" and word[-1:]:
        out.append("asks")
    if word[:1] in b"\"'`" and word[:1]:
        out.append("quoted")
    if b"://" in word:
        out.append("url")
    if MAIL.search(core):
        out.append("mail")
    return tuple(out)


def describe_file(text: bytes, words: list[bytes]) -> tuple:
    """prose, settings or code, by how many words in a hundred have marks of such files."""
    marks = sum(text.count(c) for c in (b"=", b"{", b"}", b";"))
    share = 100 * marks / max(1, len(words))
    return ("file=prose",) if share < 2 else ("file=settings",) if share < 30 else ("file=code",)


def labelled(lines: int = 1800, seed: int = 11) -> tuple[list[list[bytes]], list[list[int]], list[tuple]]:
    """The labelled table: made-up lines of three kinds of file, some with a secret, some with strings that are none."""
    r = random.Random(seed)
    syllables = "ta lo mi rek san du vor pel ing ous tion ét ñar schö".split()
    name = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    said = lambda: r.choice("is Is pass Pass key Key private access login auth Token password".split())
    plain = lambda: (name() if (x := r.random()) < 0.75 else name().title() if x < 0.92 else said()) + r.choice(["", "", "", ",", ".", "***", "|"])
    of = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    low = "abcdefghijklmnopqrstuvwxyz0123456789"
    keyed = lambda chars, n: next(x for x in iter(lambda: of(chars, n), None) if any(c.isdigit() for c in x) and any(c.isalpha() for c in x))
    letters = mixed[:52]

    def value() -> str:
        kinds = [
            lambda: of(letters, r.randint(16, 44)), lambda: of(mixed[:26], r.randint(16, 40)), lambda: of(low[:26], r.randint(18, 40)), lambda: of(low[:26], r.randint(2, 6)) + r.choice("_-") + of(r.choice([letters, low[:26], mixed]), r.randint(20, 36)), lambda: f"sk_{r.choice(['live', 'test'])}_{of(r.choice([letters, low[:26], mixed, low]), r.randint(18, 32))}",
            lambda: of(r.choice([low[:26], mixed[:26], letters]), r.randint(10, 22)) + of("0123456789", r.randint(2, 10)), lambda: of("0123456789", r.randint(2, 8)) + of(r.choice([low[:26], mixed[:26], letters]), r.randint(12, 24)), lambda: "abcdefghijklmnopqrstuvwxyz"[(k := r.randint(0, 8)) : k + r.randint(10, 18)] + "0123456789"[: r.randint(4, 10)], lambda: r.choice(["qwertyuiopasdfghjklzxcvbnm", "QWERTYUIOPASDFGHJKLZXCVBNM", "AbCdEfGhIjKlMnOpQrStUvWxYz"])[: r.randint(16, 26)] + of("0123456789", r.randint(0, 3)) + of(letters, r.randint(0, 8)),
            lambda: keyed(mixed, r.randint(16, 40)), lambda: keyed(mixed, r.randint(20, 44)), lambda: of(low[:26], r.randint(2, 5)) + r.choice("_-.") + keyed(mixed, r.randint(18, 40)), lambda: keyed(low, r.randint(20, 40)), lambda: keyed(mixed[:26] + "0123456789", r.randint(20, 36)),
            lambda: keyed(mixed + "+/", 40), lambda: keyed(mixed + "-_", r.randint(22, 48)), lambda: keyed(mixed + "!@#~^%", r.randint(12, 20)), lambda: f"eyJ{of(mixed, 20)}.eyJ{of(mixed, 24)}.{of(mixed + '-_', 30)}", lambda: of(mixed[:26], 2) + "." + keyed(mixed, 20) + "." + keyed(mixed, 40),
        ]
        return r.choice(kinds)()

    cue = lambda: r.choice(["password", "secret", "token", "key", "pwd", "credential", "auth"])
    found = [lambda: (["Authorization:", "Bearer"], value()), lambda: ([cue() + ":"], value()), lambda: ([cue(), "="], '"' + value() + '"'), lambda: ([cue(), "is"], value()), lambda: ([], cue() + "=" + value()), lambda: ([], f"{name().upper()}_{cue().upper()}='{value()}'"), lambda: (["private", "key"], value()), lambda: ([], value()), lambda: ([], value()), lambda: ([name()], value())]
    hexed = "0123456789abcdef"
    uuid = lambda: "-".join(of(hexed, k) for k in (8, 4, 4, 4, 12))
    long = lambda: "".join(r.choice(["ver", "schiff", "fahrt", "kapit", "gesell", "schaft", "unter", "nehmen", "inter", "national", "isation", "respons", "abil", "ity", "grund", "stück", "straß", "konstruk", "tion", "al", "recht", "lich", "keit", "comp", "rehens", "ive", "ness", "desarrollo", "mento", "ing", "the", "er", "on", "st", "an", "re", "th", "in", "ble", "ed", "hea", "or", "wh", "at", "sh", "ter", "ich", "ung", "heit", "schlich", "ent", "be", "ge", "ach", "sch", "zu", "der", "ein", "ción", "que", "ment", "eur", "eux", "ai", "ais", "oi", "ou", "elle", "la", "ia", "ll", "tre", "ci", "ja", "ra", "ier", "ance", "le", "un", "os"]) for _ in range(r.randint(3, 8)))
    title = lambda: "".join(r.choice(["get", "set", "Customer", "Billing", "Address", "Controller", "Factory", "Abstract", "Request", "Handler", "Stream", "String", "Buffer", "Index", "Manager", "Config", "Http", "Json", "Message", "Order"]) for _ in range(r.randint(2, 5)))
    none = [
        long, long, long, lambda: long().upper() + r.choice(['!', '!!', '?']), lambda: long().upper() + '!!', lambda: f"{long()[:11].upper()}!! {long()[:9].upper()}!!", lambda: long() + '!!', uuid, uuid, lambda: f"order {uuid()}", lambda: f"id={uuid()}", lambda: uuid().upper(), long, long, lambda: long().title(), lambda: long().upper(), title, title, lambda: title() + r.choice(["()", ".java", ".class", f"V{of(hexed[:10], 1)}", "", "[]"]), lambda: "_".join(title().upper() for _ in range(2)), lambda: f"v{of(hexed[:10], 1)}.{of(hexed[:10], 2)}.{of(hexed[:10], 1)}-{r.choice(['beta', 'rc1', 'alpha.2', 'SNAPSHOT'])}", lambda: f"{name()}-{of(hexed[:10], 1)}.{of(hexed[:10], 2)}.{of(hexed[:10], 1)}.{r.choice(['jar', 'tar', 'whl', 'zip', 'deb'])}", lambda: f"IMG_2024{of(hexed[:10], 4)}_{of(hexed[:10], 6)}.jpg", lambda: f"report_{name()}_2024-0{r.randint(1, 9)}-1{r.randint(0, 9)}.pdf", lambda: f"/usr/{name()}/{name()}{of(hexed[:10], 2)}/{name()}.{r.choice(['so', 'conf', 'log'])}", lambda: f"{name()}::{title()}", lambda: f"{name()}.{title()}.{name()}", lambda: "-".join(name() for _ in range(r.randint(3, 6))), lambda: f"DE{of(hexed[:10], 20)}", lambda: f"{name().upper()[:3]}-2024-{of(hexed[:10], 6)}",
        lambda: of("0123456789", r.randint(1, 16)), lambda: f"http://{name()}.com/{name()}/{of('0123456789', 3)}", lambda: f"https://{name()}.org/{name()}-{name()}/{name()}-{of('0123456789', r.randint(2, 6))}", lambda: f"{name()}-{name()}-{name()}", lambda: f"2024-0{r.randint(1, 9)}-1{r.randint(0, 9)}", lambda: f"2024-0{r.randint(1, 9)}-1{r.randint(0, 9)}T{of('0123456789', 2)}:{of('0123456789', 2)}",
        lambda: f"{of('0123456789', 2)}.{of('0123456789', 2)}.{of('0123456789', 3)}.{of('0123456789', 2)}", lambda: f"{name()}={name()}", lambda: f"{name()}_{name()}.py", lambda: f"{name()}_{name()}_{of('0123456789', 2)}.txt", lambda: f"{name()}@{name()}.org", lambda: f"{name()}.{of('0123456789', 2)}@{name()}.example.com", lambda: f"the {cue()} was {name()}", lambda: f"{name()}/{name()}/{name()}.html", lambda: f"{name()}/{name().title()}{name().title()}{of('0123456789', 1)}.cc",
        lambda: name().upper() + of("0123456789", 2), lambda: f"{name().upper()[:3]}-{of('0123456789', 4)}-{of('0123456789', 4)}", lambda: f"{name()}{name().title()}{name().title()}()", lambda: f"{name()}{name().title()}{of('0123456789', 1)}", lambda: f"+1 ({of('0123456789', 3)}) {of('0123456789', 3)}-{of('0123456789', 4)}", lambda: f"version {of('0123456789', 1)}.{of('0123456789', 1)}", lambda: f"{name()}{name()}{name()}", lambda: f"{name()}-{of('0123456789', 1)}.{of('0123456789', 2)}", lambda: f"{of('0123456789', 1)},{of('0123456789', 3)},{of('0123456789', 3)}",
    ]
    texts, tags, files = [], [], []
    for _ in range(lines):
        words, mark = [], []
        kind = r.choice(["prose", "settings", "code"])
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(0, 5)):
                words.append(plain())
                mark.append(0)
            if r.random() < 0.5:
                before, secret = r.choice(found)()
                words += [*before, secret + r.choice(["", "", ".", "###", ";"])]
                mark += [0] * len(before) + [1]
                if r.random() < 0.1:
                    words.append(of(mixed, 24))
                    mark.append(2)
            else:
                own = r.choice(none)().split(" ")
                words += own
                mark += [0] * len(own)
        words.append(plain())
        texts.append([w.encode() for w in words])
        tags.append([*mark, 0])
        files.append((f"file={kind}",))
    return texts, tags, files


def accept(text: bytes, begin: int, end: int, kind: str) -> list[tuple[int, int]]:
    """Each word from begin to end, without its name and the marks around it, but for what is no secret by its form: too short, digits and marks alone, a URL, a mail address."""
    out = []
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", text[begin:end]):
        a, core = m.start() + len(m.group()) - len(m.group().lstrip(EDGE)), m.group().strip(EDGE)
        named = NAMED.match(core)
        if named and len(core) - named.end() >= 8:
            inner = core[named.end() :]
            a += named.end() + len(inner) - len(inner.lstrip(EDGE))
            core = inner.strip(EDGE)
        if len(core) >= 10 and core.translate(None, b"0123456789.,:-+()/TZ") and b"://" not in core and not MAIL.search(core):
            out.append((begin + a, begin + a + len(core)))
    return out


@cache
def trained() -> Finder:
    """The finder, trained once on the driver; its weights travel to the tasks."""
    return Finder(KINDS, base, Crf(TAGS, describe).fit(*labelled()), ("model",), accept, describe_file)


def table_of(docs: DataFrame) -> DataFrame:
    model = Shared(docs.sparkSession, trained())
    return spans.table_of(docs, "secrets", lambda: model.value, BASE_KINDS)


def masked(docs: DataFrame) -> DataFrame:
    model = Shared(docs.sparkSession, trained())
    return spans.masked(docs, "secrets", lambda: model.value, lambda kind: b"[SECRET]")
