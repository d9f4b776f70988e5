"""Planted personal data and noise.

Names, hosts, numbers and surroundings are made apart from what the trees learn from; the marks of the
spellings, and some shapes of the noise, occur among the training forms too.
"""

import random

NAMES = ["maria", "j.smith", "Tom_Baker", "k", "olga-petrova", "li.wei88", "support", "info", "sales.team", "dr.no", "x99", "anne.marie.dubois", "HR", "webmaster", "first.last+tag"]
HOSTS = ["gmail.com", "uni-bonn.de", "cs.stanford.edu", "acme.io", "mail.ru", "post.ac.uk", "example.org", "a1.net", "my-shop.info", "lab.physics.ox.ac.uk", "yahoo.fr", "t.co"]
LEFT, RIGHT = ["Reach me: ", "The river ran on and ", "Kontakt ", "(", "veuillez dire "], [" today", ". Thanks", ", or not", ")", " and the rest of it"]
SPELLINGS = {"(at) (dot)": (" (at) ", " (dot) "), "at dot": (" at ", " dot "), "[at]": ("[at]", "."), " @ ": (" @ ", "."), "(at)": ("(at)", "."), "[at] [dot]": (" [at] ", " [dot] "), "@ dot": ("@", " dot ")}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def number(rnd, n):
    return str(rnd.randrange(2, 10)) + "".join(rnd.choice("0123456789") for _ in range(n - 1))


def card(rnd, good=True):
    d = number(rnd, 15)
    return rnd.choice([d + c for c in "0123456789" if luhn(d + c) == good])


def plants(each=60):
    """(kind, spelling, text before, value, text after)."""
    rnd, out = random.Random(21), []

    def put(kind, spelling, value, right=None):
        out.append((kind, spelling, rnd.choice(LEFT), value, right or rnd.choice(RIGHT)))

    for spelling, (at, dot) in SPELLINGS.items():
        for _ in range(each):
            put("email", spelling, rnd.choice(NAMES) + at + rnd.choice(HOSTS).replace(".", dot))
    for _ in range(each):
        a, b, c = number(rnd, 3), number(rnd, 3), number(rnd, 4)
        put("phone", "(local)", f"({a}) {b}-{c}")
        put("phone", "local-", f"{a}-{b}-{c}")
        put("phone", "before an ip", f"+1 ({a}) {b}-{c}", f" {rnd.randrange(9, 250)}.{rnd.randrange(250)}.{rnd.randrange(250)}.{rnd.randrange(250)} so")
        d = card(rnd)
        put("card", "dotted", ".".join(d[i : i + 4] for i in range(0, 16, 4)))
    return out


def noise(each=60):
    """Texts without personal data beyond the base rules."""
    rnd, out = random.Random(22), []
    for _ in range(each):
        d, w = card(rnd, good=False), rnd.choice(["shop", "river", "market", "they", "office"])
        out += [
            "id " + ".".join(d[i : i + 4] for i in range(0, 16, 4)) + " end", f"we met at {w}. Later it rained", f"look at {rnd.choice(HOSTS)} for more", f"on {rnd.randrange(1950, 2030)}-0{rnd.randrange(1, 10)}-1{rnd.randrange(10)} it was",
            f"dance at {w}. dot the line", f"code {number(rnd, 8)} here", f"{w} (at) home. Then", f"sums of {number(rnd, 3)} {number(rnd, 3)} units", f"I was @ {w}. It rained",
        ]
    return out
