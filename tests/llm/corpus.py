"""Small corpora with copies, shared passages, periodic and odd texts."""

import random


def corpus(seed=0, n=60, vocabulary=300):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéñß") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]
    text = lambda k: "".join(r.choice(words) + r.choice([" ", " ", " ", "\n", "  ", ". "]) for _ in range(k))
    passages = [text(r.randint(30, 120)) for _ in range(6)]
    docs = []
    for _ in range(n):
        kind = r.random()
        if docs and kind < 0.15:
            docs.append(r.choice(docs))
        elif docs and kind < 0.35:
            w = r.choice(docs).split(" ")
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = r.choice(words)
            docs.append(" ".join(w))
        elif kind < 0.6:
            docs.append(text(r.randint(0, 100)) + r.choice(passages) + text(r.randint(0, 100)))
        else:
            docs.append(text(r.randint(1, 250)))
    docs += ["", " ", None, None, "a " * 180, "a " * 130 + "b", "ab " * 140, "x" * 700, "x" * 450 + "y", "xy" * 300, passages[0], passages[0], text(3000), "éé" * 150, "é", "one two", "one two", "One Two"]
    docs += [passages[1] + passages[2], passages[2] + passages[1], (passages[3] + " ") * 3]
    return list(enumerate(docs))
