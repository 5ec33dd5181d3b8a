"""Lines with personal data and secrets in surroundings and forms that the labelled tables of the operators don't make: real words, other layouts."""

import random

WORDS = "the of and to please if you need help with your order we will send it again tomorrow because last week was very busy for all teams in Berlin Madrid Paris new office address changed since January thanks regards account invoice meeting agenda notes deploy restart cluster billing customer".split()


def luhn_tail(body: str) -> str:
    for c in "0123456789":
        d = [int(x) * (1 + k % 2) for k, x in enumerate(reversed(body + c))]
        if sum(x - 9 * (x > 9) for x in d) % 10 == 0:
            return body + c
    raise AssertionError


def lines(r: random.Random, n: int, found: list, none: list) -> list[tuple[str, list[str]]]:
    out = []
    for _ in range(n):
        parts, want = [], []
        for _ in range(r.randint(1, 3)):
            parts += [r.choice(WORDS) for _ in range(r.randint(2, 7))]
            if r.random() < 0.6:
                before, it, after = r.choice(found)()
                parts.append(before + it + after)
                want.append(it)
            else:
                parts.append(r.choice(none)())
            parts += [r.choice(WORDS) for _ in range(r.randint(1, 4))]
        out.append((" ".join(parts), want))
    return out


def pii_lines(n: int, seed: int) -> list[tuple[str, list[str]]]:
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    who = lambda: r.choice(["maria", "john.smith", "k_tanaka", "info", "sales-eu", "otto77"])
    where = lambda: r.choice(["acme.io", "mail.example.de", "uni-bonn.edu", "shop24.net"])
    card = lambda: luhn_tail(r.choice(["4", "51", "37", "6011"]) + d(12))[:19]
    octets = lambda sep: sep.join(str(r.randint(1, 254)) for _ in range(4))

    def grouped() -> str:
        c = luhn_tail("4" + d(14))
        return r.choice([".", "/", "_"]).join(c[k : k + 4] for k in range(0, 16, 4))

    found = [
        lambda: ("", f"({d(3)}) {d(3)}-{d(4)}", r.choice(["", ","])), lambda: ("reachable under ", f"{d(3)}.{d(3)}.{d(4)}", "."), lambda: ("phone no. ", f"{d(3)} {d(3)} {d(4)}", ""), lambda: ("Fax ", f"0{d(3)}/{d(7)}", ""), lambda: ("", f"0{d(2)} {d(8)}", ""),
        lambda: ("Reach ", f"{who()} (at) {where()}", ""), lambda: ("<", f"{who()}@{where()}", ">"), lambda: ("", f"{who()}[at]{where()}", "."), lambda: ("", f"{who()} [at] acme [dot] io", ""),
        lambda: ("from ", octets("."), ""), lambda: ("blocked ", octets("[.]"), ","), lambda: ("gateway ", f"2001:db8:{r.randint(1, 65535):x}::{r.randint(1, 255):x}", ""), lambda: ("", f"fe80::{r.randint(4096, 65535):x}:{r.randint(4096, 65535):x}", ""),
        lambda: ("paid by ", luhn_tail("4" + d(14)), "."), lambda: ("card: ", grouped(), ""), lambda: ("", luhn_tail("51" + d(13)), ""),
    ]
    none = [
        lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1950, 2029)}", lambda: f"{r.randint(1950, 2029)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"§ {d(2)}", lambda: f"{d(1)},{d(3)} EUR", lambda: f"{d(2)}:{d(2)} h", lambda: f"room {d(3)}", lambda: f"ISBN 978-3-{d(4)}-{d(4)}-{d(1)}",
        lambda: f"INV-{d(5)}", lambda: f"version {d(1)}.{d(1)}.{d(2)}", lambda: f"{d(5)} Berlin", lambda: f"{r.randint(10, 99)} %", lambda: "look at the example.com page", lambda: "(at least)", lambda: f"{d(2)}-{d(2)}", lambda: f"#{d(5)}", lambda: f"{r.randint(256, 999)}.{d(3)}.{r.randint(256, 999)}.{d(2)}", lambda: f"@{who()}", lambda: f"https://acme.io/{d(4)}", lambda: f"{d(1)}x{d(2)}",
    ]
    return lines(r, n, found, none)


def secret_lines(n: int, seed: int) -> list[tuple[str, list[str]]]:
    r = random.Random(seed)
    of = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    # the forms hold a digit and a letter at least, as generated keys of such lengths do
    sure = lambda chars, k: next(x for x in iter(lambda: of(chars, k), None) if sum(c in digits for c in x) > 1 and sum(c in lower + upper for c in x) > 3)
    found = [
        lambda: ("", "glpat-" + sure(lower + upper + digits, 20), ""), lambda: ("use ", "hf_" + sure(lower + upper + digits, 34), "."), lambda: ("", "npm_" + sure(lower + upper + digits, 36), ""), lambda: ("Bearer ", sure(lower + digits, 32), ""), lambda: ("our key ", sure(lower + digits, 28), " was"),
        lambda: ("export AWS_KEY='", sure(lower + upper + digits + "+/", 40), "'"), lambda: ("the pass phrase ", sure(lower + upper + digits + "!@^~", 18), ""), lambda: ("X-Auth: ", sure(upper + digits, 32), ""), lambda: ("client id and ", sure(lower + upper + digits + "-_", 43), ","), lambda: ("", "SG." + sure(lower + upper + digits, 22) + "." + sure(lower + upper + digits, 43), ""),
    ]
    none = [
        lambda: f"https://acme.io/{r.choice(WORDS)}/{r.choice(WORDS)}-{of(digits, 4)}", lambda: f"{r.choice(WORDS)}.{r.choice(WORDS)}{of(digits, 2)}@example.com", lambda: f"INV-{of(digits, 4)}-{of(digits, 5)}", lambda: f"{r.choice(WORDS)}_{r.choice(WORDS)}_{of(digits, 2)}.csv", lambda: f"{of(digits, 12)}", lambda: f"{of(digits, 4)}-{of(digits, 2)}-{of(digits, 2)}T{of(digits, 2)}:{of(digits, 2)}:00Z",
        lambda: "getCustomerBillingAddress2()", lambda: f"src/main/java/{r.choice(WORDS).title()}Controller{of(digits, 1)}.java", lambda: f"+49 30 {of(digits, 7)}", lambda: f"v{of(digits, 1)}.{of(digits, 2)}.{of(digits, 1)}-beta", lambda: "internationalisation", lambda: "Donaudampfschifffahrtsgesellschaft", lambda: f"{of(digits, 1)},{of(digits, 3)},{of(digits, 3)}.00", lambda: "password reset page", lambda: f"{r.choice(WORDS)}={r.choice(WORDS)}",
    ]
    return lines(r, n, found, none)


def key_lines(n: int, seed: int) -> list[tuple[str, list[str]]]:
    """Keys of any letters, with and without digits, beside identifiers that are none."""
    r = random.Random(seed)
    of = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexed = digits + "abcdef"
    uuid = lambda: "-".join(of(hexed, k) for k in (8, 4, 4, 4, 12))
    found = [
        lambda: ("", of(upper, 24), ""), lambda: ("use ", of(lower + upper, 30), "."), lambda: ("Bearer ", of(lower, 14) + of(digits, 8), ""), lambda: ("", "hf_" + of(lower + upper, 34), ""), lambda: ("", "sk_live_" + of(lower, 24), ","), lambda: ("our key ", of(lower, 28), " was"),
        lambda: ("export KEY=", of(upper, 23) + of(digits, 2), ""), lambda: ("", "ghp_" + of(lower + upper, 36), ""), lambda: ("X-Auth: ", of(lower + upper, 40), ""), lambda: ("credential ", of(upper, 32), ";"), lambda: ("Bearer ", of(lower, 20), ""), lambda: ("the pass is ", of(lower + upper, 16) + of(digits, 1), ""),
    ]
    none = [
        lambda: f"order {uuid()}", uuid, lambda: f"request-id={uuid()}", lambda: f"release {of(digits, 1)}.{of(digits, 2)}.{of(digits, 1)}-rc{of(digits, 1)}", lambda: f"spring-core-{of(digits, 1)}.{of(digits, 1)}.{of(digits, 2)}.RELEASE.jar", lambda: f"DSC_{of(digits, 5)}.JPG", lambda: f"minutes_{r.choice(WORDS)}_{of(digits, 4)}-{of(digits, 2)}.docx", lambda: "Rechtsschutzversicherung",
        lambda: "Geschwindigkeitsbegrenzung", lambda: "incomprehensibilities", lambda: "electroencephalography", lambda: "desproporcionadamente", lambda: "AbstractSingletonProxyFactoryBean", lambda: "handleIncomingConnection()", lambda: "MAX_CONNECTION_POOL_SIZE", lambda: "org.apache.commons.lang3.StringUtils", lambda: "user-agent-parser-service", lambda: "UNCHARACTERISTICALLY", lambda: f"/var/log/nginx/access.log.{of(digits, 1)}", lambda: f"PO-{of(digits, 4)}-{of(digits, 6)}", lambda: f"SKU{of(digits, 8)}",
    ]
    return lines(r, n, found, none)
