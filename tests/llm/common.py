"""Texts and tables that the tests of several operators share."""

import random
import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, odd spaces, nulls, empty and one-word texts, and a long one."""
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["été", "\U0001f600", "A", "a", "<|end|>", " x", "\x1cy"]
    passage = [r.choice(vocabulary) for _ in range(60)]
    out = []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 40, 120, 300]))]
        kind = i % 6
        if kind == 1 and out:
            w = words(r.choice(out)[1])
        elif kind == 2 and out:
            w = words(r.choice(out)[1])
            for _ in range(1 + len(w) // 60):
                if w:
                    w[r.randrange(len(w))] = "changed%d" % i
        elif kind == 3:
            at = r.randrange(len(w) + 1)
            w[at:at] = passage
        out.append((i, "".join(x + r.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b"]) for x in w)))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "one"), (n + 4, " ".join(r.choice(vocabulary) for _ in range(20000)))]
    return out
