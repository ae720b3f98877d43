"""An averaged-perceptron character editor for misrecognised words and broken lines.

For each character of a word the editor scores operations: keep, replace by another character, delete, replace and
insert one more; for a line end after a hyphen: join the halves or keep the hyphen. It is trained on pairs made from
the corpus itself: unknown words of scanned pages one edit from a common word, and common words spoilt by the known
confusions of two characters for one.
"""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from collections.abc import Callable, Container
from functools import lru_cache

#: What scanners read (left) for what was printed (right), two characters for one and back.
CONFUSIONS = (("rn", "m"), ("vv", "w"), ("li", "h"), ("cl", "d"), ("ii", "u"), ("in", "m"), ("m", "rn"), ("m", "in"), ("d", "cl"), ("h", "li"), ("w", "vv"), ("ri", "n"), ("n", "ri"), ("лл", "м"), ("ы", "ьі"), ("ьі", "ы"), ("ь1", "ы"))
#: One character for one, used where the sample shows too few.
SINGLE = "0o 1l 1i 5s 9g 8b 6b !i !l |l |i ij lI il li ce ec eo co oc oa ao un nu hb bh ft tf ln rt tr ую ни ин нп пн шщ щш цп лп пл тг гт еc ос со 3з 8в 0о 6б".split()
KEEP, JOIN, HYPHEN = "K", "J", "H"


def operations(read: str, printed: str) -> list[str] | None:
    """One operation per character of ``read`` that makes ``printed``, for words one edit or confusion apart."""
    if read == printed:
        return [KEEP] * len(read)
    a = 0
    while a < min(len(read), len(printed)) and read[a] == printed[a]:
        a += 1
    b = 0
    while b < min(len(read), len(printed)) - a and read[len(read) - 1 - b] == printed[len(printed) - 1 - b]:
        b += 1
    old, new = read[a : len(read) - b], printed[a : len(printed) - b]
    ops = [KEEP] * len(read)
    if len(old) == 1 and len(new) == 1:
        ops[a] = "R" + new
    elif len(old) == 1 and not new:
        ops[a] = "D"
    elif not old and len(new) == 1 and a:
        ops[a - 1] = "R" + read[a - 1] + new
    elif len(old) == 2 and len(new) == 1:
        ops[a], ops[a + 1] = "R" + new, "D"
    elif len(old) == 1 and len(new) == 2:
        ops[a] = "R" + new
    else:
        return None
    return ops


def features(word: str, i: int) -> list[str]:
    p = f"^^{word}$$"
    k = i + 2
    return [
        p[k], p[k - 1 : k + 1] + "<", p[k : k + 2] + ">", p[k - 1 : k + 2], p[k - 2 : k + 1] + "<<", p[k : k + 3] + ">>",
        ("d" if p[k].isdigit() else "s" if not p[k].isalpha() else "l") + ("d" if p[k - 1].isdigit() else "l") + str(i == 0),
    ]


def line_features(first: str, mark: str, second: str, known: Container[str]) -> list[str]:
    """Of a line end: the mark, and which of joined, hyphenated, first and second form are known words."""
    a, b = first.lower(), second.lower()
    table = [(a + b) in known, f"{a}-{b}" in known, a in known, b in known]
    return ["m" + mark, "k" + "".join(str(int(x)) for x in table), "j" + str(int(table[0])), "h" + str(int(table[1])), "c" + str(second[:1].isupper() and not first[-1:].isupper())]


class Perceptron:
    def __init__(self):
        self.w: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        self.sum: dict[tuple[str, str], float] = defaultdict(float)
        self.at: dict[tuple[str, str], int] = defaultdict(int)
        self.step = 0

    def scores(self, feats: list[str]) -> dict[str, float]:
        out: dict[str, float] = defaultdict(float)
        for f in feats:
            for c, x in self.w.get(f, {}).items():
                out[c] += x
        return out

    def learn(self, feats: list[str], truth: str) -> None:
        self.step += 1
        s = self.scores(feats)
        guess = max(s, key=lambda c: (s[c], c)) if s else KEEP
        if guess != truth:
            for f in feats:
                for c, by in ((truth, 1.0), (guess, -1.0)):
                    self.sum[f, c] += (self.step - self.at[f, c]) * self.w[f][c]
                    self.at[f, c] = self.step
                    self.w[f][c] += by

    def average(self) -> dict[str, dict[str, float]]:
        out: dict[str, dict[str, float]] = {}
        for f, row in self.w.items():
            made = {c: round((self.sum[f, c] + (self.step - self.at[f, c]) * x) / max(self.step, 1), 4) for c, x in row.items()}
            made = {c: x for c, x in made.items() if x}
            if made:
                out[f] = made
        return out


def training_pairs(unknown: list[str], known: dict[str, int], seed: int = 7) -> list[tuple[str, str]]:
    """(read, printed) words: unknown words one edit from a known word of the sample, spoilt words, and clean ones."""
    rng = random.Random(seed)
    common = sorted((w for w in known if len(w) > 3), key=lambda w: (-known[w], w))[:20_000]
    near: dict[str, list[str]] = defaultdict(list)
    for w in common:
        for i in range(len(w) + 1):
            near[w[:i] + w[i + 1 :]].append(w)
    pairs = []
    for u in unknown:
        if len(u) < 4:
            continue
        found = {w for i in range(len(u) + 1) for w in near.get(u[:i] + u[i + 1 :], ()) if abs(len(w) - len(u)) <= 1}
        found = [w for w in found if (ops := operations(u, w)) and sum(o != KEEP for o in ops) == 1]
        if found:
            pairs.append((u, max(found, key=lambda w: (known[w], w))))
    # chance neighbours show operations once or twice; what scanners do shows many times
    seen = Counter(o for u, w in pairs for o in zip(u, operations(u, w)) if o[1] != KEEP)
    pairs = [(u, w) for u, w in pairs if all(o == KEEP or seen[c, o] > 2 for c, o in zip(u, operations(u, w)))]
    # a small lexicon is gone through several times, so that every confusion is met
    for w in common[:6000] * max(1, min(40, 3000 // max(len(common), 1))):
        for read, printed in CONFUSIONS:
            if printed in w and rng.random() < 0.5:
                i = w.index(printed)
                pairs.append((w[:i] + read + w[i + len(printed) :], w))
        for x in SINGLE:
            if len(x) == 2 and x[1] in w and rng.random() < 0.1:
                i = rng.choice([k for k, c in enumerate(w) if c == x[1]])
                pairs.append((w[:i] + x[0] + w[i + 1 :], w))
    pairs += [(w, w) for w in common[:4000]]
    rng.shuffle(pairs)
    return pairs[:60_000]


def train(unknown: list[str], known: dict[str, int], rounds: int = 2, seed: int = 7) -> dict[str, dict[str, float]]:
    model = Perceptron()
    pairs = [(u, o) for u, w in training_pairs(unknown, known, seed) if (o := operations(u, w))]
    for _ in range(rounds):
        for u, ops in pairs:
            for i, o in enumerate(ops):
                # all changed places, and their neighbourhood
                if o != KEEP or any(x != KEEP for x in ops[max(0, i - 2) : i + 3]) or i % 4 == 0:
                    model.learn(features(u, i), o)
    _train_lines(model, known, random.Random(seed + 1))
    return model.average()


def _train_lines(model: Perceptron, known: dict[str, int], rng: random.Random) -> None:
    whole = sorted((w for w in known if "-" not in w and len(w) > 4), key=lambda w: (-known[w], w))[:4000]
    hyphened = [w for w in known if w.count("-") == 1 and all(len(x) > 1 for x in w.split("-"))]
    for _ in range(2):
        for w in whole:
            i = rng.randint(2, len(w) - 2)
            model.learn(line_features(w[:i], rng.choice("-\xad¬‐"), w[i:], known), JOIN)
        for w in hyphened[:4000]:
            a, b = w.split("-")
            model.learn(line_features(a, "-", b, known), HYPHEN)
        for w in hyphened[:400]:
            a, b = w.split("-")
            model.learn(["m-", "k0000", "j0", "h0", "cFalse"], JOIN)


class Editor:
    """Edits unknown words into known ones; results are remembered up to a fixed number."""

    def __init__(self, weights: dict[str, dict[str, float]], known: dict[str, int]):
        self.weights, self.known = weights, known
        self.edit = lru_cache(maxsize=200_000)(self._edit)

    def _scores(self, feats: list[str]) -> dict[str, float]:
        out: dict[str, float] = defaultdict(float)
        for f in feats:
            for c, x in self.weights.get(f, {}).items():
                out[c] += x
        return out

    def _edit(self, word: str) -> str | None:
        """The best known word that one or two operations make of an unknown one, or None. All operations above MARGIN are
        tried, the likeliest first; a pair of them is left out only if it can't be better than what was found. Short
        words are near many others by chance and need more (SHORT_MARGIN); words of one letter, or two letters without
        another sign, are never edited."""
        return next((made for made, sure in self.candidates(word) if sure), None)

    def candidates(self, word: str, maybe: Callable[[str], bool] | None = None) -> list[tuple[str, bool]]:
        """What ``_edit`` chooses among, the best first, up to the first that is in the lexicon (true); before it those that
        ``maybe`` takes for words known beyond the lexicon (false)."""
        if len(word) < 2 or len(word) == 2 and word.isalpha():
            return []
        best = SHORT_MARGIN if len(word) < 5 else MARGIN
        out: list[tuple[float, int, str, bool]] = []
        options: list[tuple[float, int, str]] = []
        for i in range(len(word)):
            s = self._scores(features(word, i))
            keep = s.get(KEEP, 0.0)
            options += [(x - keep, i, o) for o, x in s.items() if o not in (KEEP, JOIN, HYPHEN) and x - keep > MARGIN]
        options.sort(key=lambda x: (-x[0], x[1], x[2]))
        for x, i, o in options:
            if x <= best:
                break
            made = _apply(word, {i: o})
            if (sure := made in self.known) or maybe and maybe(made):
                out.append((-x, len(out), made, sure))
                if sure:
                    best = x
                    break
        for k, (x, i, o) in enumerate(options):
            for y, j, q in options[k + 1 :]:
                if x + y <= best:
                    break
                # two deletions make a known word of anything; a deletion goes with the replacement before it
                if j != i and not (o == "D" and q == "D") and ("D" not in (o, q) or j - i == (1 if q == "D" else -1)):
                    made = _apply(word, {i: o, j: q})
                    if (sure := made in self.known) or maybe and maybe(made):
                        out.append((-x - y, len(out), made, sure))
                        best = x + y if sure else best
        out.sort()
        end = next((k for k, c in enumerate(out) if c[3]), len(out))
        return [(made, sure) for _, _, made, sure in out[: end + 1]]

    def joins(self, first: str, mark: str, second: str, known: Container[str] | None = None) -> bool:
        s = self._scores(line_features(first, mark, second, self.known if known is None else known))
        return s.get(JOIN, 0.0) >= s.get(HYPHEN, 0.0)


#: How far an operation, and all of a word's together, may fall behind keeping; and those of words of less than five
#: characters.
MARGIN, SHORT_MARGIN = -6.0, 0.0


def _apply(word: str, ops: dict[int, str]) -> str:
    return "".join(c if (o := ops.get(i)) is None else "" if o == "D" else o[1:] for i, c in enumerate(word))
