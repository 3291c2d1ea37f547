"""The licence of each code file and repository.

Two multinomial logistic regressions on word n-grams read a statement, both with open-set rejection. One is trained on
variants of licence names: it is put to spans of words, and the longest sure span at a place wins. What the grammar
around a name says comes next: names joined by "or" are an offered choice, a refusal grants nothing. The other is trained
on variants of licence texts (cut, reflowed, misspelt, with prose around them, names left out) and is put to the stretches
of words that look like one. A text counts only if the model is sure and its n-grams are known well enough, by a bound
that keeps out licences which were held back from the training. Then the predictions are reconciled along the path file,
row, repository text, repository id; and along the folders of a repository where that is asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.components import canonical_repository
from loomwright.llm.licence_texts import PROSE, RELATED, TEXTS, UNKNOWN
from loomwright.llm.sources import _OPENING

# Usual names of the catalogue's licences, in the words that ``tokens`` makes of them.
NAMES = {
    "AGPL-3.0": ("agpl 3", "agpl v 3", "agpl version 3", "gnu agpl 3", "gnu agpl v 3", "gnu agpl version 3", "affero general public license 3", "affero general public license v 3", "affero general public license version 3", "gnu affero general public license 3", "gnu affero general public license v 3", "gnu affero general public license version 3", "affero gpl v 3", "affero gpl 3"),
    "Apache-2.0": ("apache 2", "apache v 2", "apache license 2", "apache license v 2", "apache license version 2", "apache software license 2", "apache software license v 2", "apache software license version 2", "asl 2", "asl v 2", "al 2", "apache 2 license", "apache software foundation license 2", "apache license"),
    "BSD-2-Clause": ("bsd 2 clause", "bsd two clause", "2 clause bsd", "two clause bsd", "simplified bsd", "freebsd license", "bsd 2", "bsd license 2 clause", "bsd 2 clause simplified"),
    "BSD-3-Clause": ("bsd 3 clause", "bsd three clause", "3 clause bsd", "three clause bsd", "new bsd", "modified bsd", "revised bsd", "bsd 3", "bsd license 3 clause"),
    "BSL-1.0": ("bsl 1", "bsl v 1", "boost 1", "boost software license", "boost software license 1", "boost software license v 1", "boost software license version 1", "boost license 1", "boost license"),
    "GPL-2.0": ("gpl 2", "gpl v 2", "gpl version 2", "gnu gpl 2", "gnu gpl v 2", "gnu gpl version 2", "gnu general public license 2", "gnu general public license v 2", "gnu general public license version 2", "general public license version 2", "general public license v 2"),
    "GPL-3.0": ("gpl 3", "gpl v 3", "gpl version 3", "gnu gpl 3", "gnu gpl v 3", "gnu gpl version 3", "gnu general public license 3", "gnu general public license v 3", "gnu general public license version 3", "general public license version 3", "general public license v 3"),
    "ISC": ("isc", "isc license", "internet systems consortium license"),
    "LGPL-2.1": ("lgpl 2.1", "lgpl v 2.1", "lgpl version 2.1", "gnu lgpl 2.1", "gnu lgpl v 2.1", "gnu lgpl version 2.1", "lesser general public license 2.1", "lesser general public license v 2.1", "lesser general public license version 2.1", "gnu lesser general public license 2.1", "gnu lesser general public license v 2.1", "gnu lesser general public license version 2.1", "lesser gpl v 2.1", "lesser gpl 2.1"),
    "MIT": ("mit", "mit license", "expat", "expat license", "expat mit", "mit expat", "mit x11", "x11 mit", "known as mit"),
    "MPL-2.0": ("mpl 2", "mpl v 2", "mpl version 2", "mozilla public license 2", "mozilla public license v 2", "mozilla public license version 2", "mozilla public license"),
    "Unlicense": ("unlicense", "unlicense license"),
    "Zlib": ("zlib", "zlib license", "zlib libpng", "zlib libpng license"),
}

# Other licences, and parts of names that name none.
OTHERS = ("agpl 1", "agpl v 1", "gnu affero general public license version 1", "apache 1", "apache 1.1", "apache license 1.1", "apache license version 1.1", "apache software license 1.1", "bsd 4 clause", "four clause bsd", "4 clause bsd", "original bsd", "0 bsd", "bsd 0 clause", "bsd 1 clause", "gpl 1", "gpl v 1", "gnu general public license version 1", "lgpl 2", "lgpl v 2", "lgpl 3", "lgpl v 3", "gnu lgpl v 3", "gnu lgpl 3", "gnu lgpl v 2", "gnu lesser general public license version 3", "gnu lesser general public license v 3", "lesser general public license version 3", "gnu library general public license version 2", "library general public license version 2", "mpl 1", "mpl 1.1", "mpl v 1.1", "mozilla public license 1.1", "mozilla public license version 1.1", "mozilla public license v 1.1", "artistic license 2", "artistic license", "eclipse public license", "epl 1", "epl 2", "eclipse public license v 2", "creative commons", "cc 0", "cc by 4", "wtfpl", "public domain", "business source license 1.1", "business source license", "mit 0", "mit 0 license", "python software foundation license 2", "eupl 1.2")
NOTHING = ("license", "software license", "public license", "general public license", "gnu general public license", "lesser general public license", "gnu lesser general public license", "gnu affero general public license", "affero general public license", "gnu", "gpl", "lgpl", "agpl", "mpl", "bsd", "bsd license", "apache", "apache software", "apache software foundation", "boost", "boost software", "mozilla", "mozilla public", "version 2", "version 3", "version", "v 2", "v 3", "2", "3", "2.1", "1", "clause", "two clause", "three clause", "2 clause", "3 clause", "new", "simplified", "modified", "revised", "known as", "as", "library", "two", "three", "gnu gpl", "gnu lgpl", "gnu agpl", "license version 2", "license version 3", "license v 2", "license 2", "public license version 2", "public license v 2", "mit technology", "internet systems consortium", "software", "foundation", "general", "public", "lesser", "affero", "source", "domain", "x11", "libpng", "al", "asl", "v", "cc", "0", "4", "1.1", "1.2")

# Clauses that tell a relative of a licence, whatever else stands, and conditions that some relatives lack.
KIN = {
    "BSD-2-Clause": ("all advertising materials mentioning", "end user documentation included with", "patent", "used to endorse or promote products derived from"),
    "BSD-3-Clause": ("all advertising materials mentioning", "end user documentation included with", "patent"),
    "ISC": ("except as contained in this notice",),
    "MIT": ("used for good not evil", "except as contained in this notice"),
}
CONDITIONS = {"ISC": "provided that the above copyright notice and", "MIT": "permission notice shall be included"}
#: First passages that a variant holds at least, where one doesn't tell the licence.
ESSENTIAL = {"BSD-2-Clause": 3, "BSD-3-Clause": 4}
#: Licences too long for a notice; each of their passages tells them. The text of another one begins with its grant.
LONG = ("AGPL-3.0", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0")
#: Licences that are told apart by whole texts only: one stretch of words never holds two of a family.
FAMILY = {"BSD-2-Clause": "BSD", "BSD-3-Clause": "BSD", "GPL-2.0": "GNU", "GPL-3.0": "GNU", "LGPL-2.1": "GNU", "AGPL-3.0": "GNU"}

#: How sure the classifiers must be.
SURE = 0.8
#: Words of a window that the classifier of texts looks at, and words between two windows.
WINDOW, STEP = 48, 16

_FOLD = ((re.compile(r"licen[cs]e[sd]?\b|lizenz\b"), "license"), (re.compile(r"\bv(?:er)?\.(?=\s*\d)"), "v "), (re.compile(r"\bversion(?=\d)"), "version "))
_TOKEN = re.compile(r"[a-z]+|\d+(?:\.\d+)*|[.;:!?](?=\s|$)|\+|/|\||&")
_LATER = re.compile(r"-?\b(?:or[ -]later|or[ -]newer|only)\b|(?:,? ?\bor,? )?(?:\(?at your option\)?,? )?\bany later version\b|(?<=\d)\+", re.I)
_STOP = {".", ";", "!", "?"}
_LINK = {"or", "/", "|", "the", "a", "an", "under", "license", "licenses", "alternatively", "at", "your", "option", "choice", "terms", "of", "either", "clause", "this", "software", "with", "exception"}
_NOT = {"not", "never", "isn", "aren", "doesn", "neither", "nor", "cannot", "nicht", "kein", "keine", "without"}
_REACH = {"under", "the", "license", "covered", "by", "offered", "available", "distributed", "released", "governed", "shared", "subject", "to", "granted", "grant", "a", "an", "any", "in", "way", "longer", "used", "use", "permitted", "terms", "of", "be", "t", "is", "are", "it", "part", "fall", "conditions", "as", "for", "or", "version"}
_HINT = {"license", "identifier", "under", "governed", "by", "as", "pick", "either", "or", "copyright", "terms", "use", "the", "of", "and", "spdx", "offered", "copying", "is", "are", "it"}
_EDGE = {"or", "the", "as", "v", "version", "of", "by"}
_PLAIN = {"mit", "isc", "zlib", "expat"}


def tokens(text: str) -> list[str]:
    """Words of a statement: lower case, one spelling of licence, versions without ``.0``, names split at digits."""
    x = _LATER.sub(" ", " ".join(text.split())).lower()
    for pattern, by in _FOLD:
        x = pattern.sub(by, x)
    out = []
    for t in _TOKEN.findall(x):
        if t[0].isdigit():
            t = re.sub(r"(?:\.0)+$", "", t)
        for head in ("agplv", "lgplv", "gplv", "mplv"):
            if t == head:
                out.append(t[:-1])
                t = "v"
                break
        out.append(t)
    return out


def _grams(words: tuple[str, ...]) -> list[str]:
    w = ("^", *words, "$")
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def regression(x: np.ndarray, y: np.ndarray, classes: int, rounds: int, rate: float, decay: float) -> np.ndarray:
    """Weights of a multinomial logistic regression (rows of ``x`` of length one), classes weighed by the root of their size."""
    hot = np.eye(classes, dtype=np.float32)[y]
    share = (1.0 / np.sqrt(np.bincount(y, minlength=classes).clip(1)[y])).astype(np.float32)
    share *= len(y) / share.sum()
    w = np.zeros((x.shape[1], classes), np.float32)
    speed = np.zeros_like(w)
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed + rate * (x.T @ ((hot - p) * share[:, None]) / len(y) - decay * w)
        w += speed
    return w


def _slips(word: str) -> set[str]:
    """Usual misspellings of a word: a letter left out, doubled, or two exchanged."""
    at = range(len(word))
    return {word[:i] + word[i + 1 :] for i in at} | {word[:i] + word[i] + word[i:] for i in at} | {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in at[:-1]}


class LicenceModel:
    """Multinomial logistic regression on the word n-grams (1 to 3, with the span's ends) of name variants.

    The training set is made from the fixed names: each as it stands, with "license" and "terms" after it. It has
    under 2,000 samples whatever the corpus is, and holds no row of it. ``texts`` is the model of licence texts.
    """

    def __init__(self, catalogue: list[str], rounds: int = 250, rate: float = 12.0, decay: float = 2e-5) -> None:
        self.classes = [*sorted(set(catalogue) & set(NAMES)), "other", "none"]
        samples: list[tuple[tuple[str, ...], int]] = []
        for c, variants in NAMES.items():
            k = self.classes.index(c if c in self.classes else "other")
            for v in variants:
                base = tuple(v.split())
                samples += [(base, k), ((*base, "terms"), k)]
                if base[-1] != "license":
                    samples.append(((*base, "license"), k))
        samples += [(tuple(v.split()), len(self.classes) - 2) for v in OTHERS] + [((*v.split(), "license"), len(self.classes) - 2) for v in OTHERS if "license" not in v]
        samples += [(tuple(v.split()), len(self.classes) - 1) for v in NOTHING] + [((*v.split(), "terms"), len(self.classes) - 1) for v in NOTHING]
        self.words = {w for s, _ in samples for w in s}
        self.longest = max(len(s) for s, _ in samples)
        self.features: dict[str, int] = {}
        for s, _ in samples:
            for g in _grams(s):
                self.features.setdefault(g, len(self.features))
        x = np.zeros((len(samples), len(self.features)), np.float32)
        for i, (s, _) in enumerate(samples):
            for g in _grams(s):
                x[i, self.features[g]] = 1.0
        x /= np.sqrt(x.sum(axis=1, keepdims=True))
        self.weights = regression(x, np.array([k for _, k in samples]), len(self.classes), rounds, rate, decay)
        self.kept: dict[tuple[str, ...], str | None] = {}
        # words of names that are long enough to be told although misspelt, less slips that are words themselves
        slips = [(x, w) for w in self.words if len(w) >= 6 for x in _slips(w) if x not in self.words]
        self.meant = {x: w for x, w in slips if x not in {"cause", "pubic", "genera", "revise", "modify"}}
        self.texts = TextModel(self)

    def words_of(self, text: str) -> list[str]:
        """``tokens`` with misspelt words of names put right."""
        return [self.meant.get(t, t) for t in tokens(text)]

    def name(self, span: tuple[str, ...]) -> str | None:
        """The licence that a span of words names, ``other``, or None (rejected)."""
        if span not in self.kept:
            found = None
            if span[0] not in _EDGE and span[-1] not in _EDGE:
                z = np.zeros(len(self.classes))
                grams = _grams(span)
                known = [self.features[g] for g in grams if g in self.features]
                if len(known) >= 0.8 * len(grams):
                    z = self.weights[known].sum(axis=0) / np.sqrt(len(known))
                    p = np.exp(z - z.max())
                    p /= p.sum()
                    k = int(p.argmax())
                    # leaving a name out is the safe side, so a likely other licence is taken as one
                    if self.classes[k] != "none" and p[k] >= (0.5 if self.classes[k] == "other" else SURE):
                        found = self.classes[k]
            if len(self.kept) > 200_000:
                self.kept.clear()
            self.kept[span] = found
        return self.kept[span]

    def statements(self, text: str, bare: bool = False) -> list[list[str]]:
        """What a text grants: for each statement the licences it offers a choice of (most often one).

        ``bare`` is for a field that holds a name and nothing else, where no grammar is needed to see a grant.
        """
        flat = self.words_of(text)
        return self._stated(flat, bare)[0] if bare else self._with_texts(flat, *self._stated(flat, bare))

    def _with_texts(self, flat: list[str], out: list[list[str]], names: list[tuple[int, int]]) -> list[list[str]]:
        stated = {FAMILY.get(c, c) for s in out for c in s}
        # wording of a licence that is named too is the text of that statement
        return out + [[c] for c in self.texts.found(masked(flat, names)) if c in self.classes and FAMILY.get(c, c) not in stated]

    def _stated(self, flat: list[str], bare: bool) -> tuple[list[list[str]], list[tuple[int, int]]]:
        """(statements, places of the names): what the names in a text grant."""
        out: list[list[str]] = []
        names: list[tuple[int, int]] = []
        i, end, refused, link = 0, -1, False, False
        since: list[str] = []
        while i < len(flat):
            w = flat[i]
            best = None
            if w in self.words and not (w.isdigit() and not (i + 1 < len(flat) and flat[i + 1] == "clause")):
                for size in range(min(self.longest, len(flat) - i), 0, -1):
                    named = self.name(tuple(flat[i : i + size]))
                    if named:
                        best = (named, size)
                        break
            if best is None:
                if w in _STOP:
                    refused, link, since = False, False, []
                else:
                    since.append(w)
                i += 1
                continue
            named, size = best
            names.append((i, i + size))
            span = flat[i : i + size]
            before = flat[max(0, i - 4) : i]
            loose = not bare and len(span) == 1 and span[0] in _PLAIN and not (set(before) & _HINT) and flat[i + size : i + size + 1] not in (["license"], ["terms"], ["/"], ["|"]) and before[-1:] not in (["/"], ["|"])
            if not loose:
                joined = end >= 0 and ("or" in since or "/" in since or "|" in since) and all(s in _LINK for s in since)
                after = flat[i + size : i + size + 4]
                gone = ("not" in after or "doesn" in after) and bool({"apply", "applies", "granted", "used", "valid"} & set(flat[i + size : i + size + 6]))
                if not joined:
                    # a refusal reaches a name over words that speak of granting, not over other words
                    no = max((k for k, x in enumerate(since) if x in _NOT), default=None)
                    refused = no is not None and all(x in _REACH for x in since[no + 1 :])
                if not refused and not gone and named != "other":
                    if joined and link and out:
                        if named not in out[-1]:
                            out[-1].append(named)
                    else:
                        out.append([named])
                    link = True
                elif not joined:
                    link = False
                since, end = [], i + size
            i += size
        return out, names


def masked(flat: list[str], names: list[tuple[int, int]]) -> list[str]:
    """The words of a text with each name as one sign, so that only wording is left; marks are left out."""
    out, at = [], 0
    for a, b in names:
        out += [t for t in flat[at:a] if t[0].isalnum()] + ["#"]
        at = b
    return out + [t for t in flat[at:] if t[0].isalnum()]


class TextModel:
    """Multinomial logistic regression on the word n-grams (1 to 3) of variants of licence texts.

    The variants come from the fixed templates, by a fixed seed: passages left out where that leaves the licence, ends
    cut, words dropped and misspelt, prose before and after. ``known`` is the least share of a text's n-grams that the
    templates must have; it lies between that of licences held back from the training and that of fresh variants.
    """

    def __init__(self, names: LicenceModel, variants: int = 24, rounds: int = 120, rate: float = 6.0, decay: float = 1e-5) -> None:
        self.classes = [*sorted(TEXTS), "other", "none"]
        rng = np.random.default_rng(20261126)
        read = lambda t: masked(f := names.words_of(t), names._stated(f, False)[1])
        texts = {c: [read(p) for p in passages] for c, passages in TEXTS.items()}
        related = {c: [read(p) for p in passages] for c, passages in RELATED.items()}
        prose = [read(p) for p in PROSE]
        self.features: dict[str, int] = {}
        for p in [*(p for t in (*texts.values(), *related.values()) for p in t), *prose]:
            for g in self._grams(p):
                if g:
                    self.features.setdefault(g, len(self.features))
        self.openings = {tuple(p[:3]) for t in texts.values() for p in t}
        self.begins = {tuple(t[0][:3]) for t in texts.values()}
        #: triples of a short licence's grant, most of which its text holds
        self.grants = {c: {g for g in self._grams(t[0])[2 * len(t[0]) :] if g} for c, t in texts.items() if c not in LONG}
        samples, y = [], []
        for k, c in enumerate(self.classes):
            for _ in range(variants * (6 if c in ("other", "none") else 1)):
                if c == "none":
                    s = [w for i in rng.permutation(len(prose))[: rng.integers(1, 4)] for w in prose[i]]
                elif c == "other":
                    s = sum(related[list(related)[rng.integers(len(related))]], [])
                else:
                    s = self._variant(texts[c], c, rng)
                samples.append(self._worn(s, prose, rng))
                y.append(k)
        x = np.zeros((len(samples), len(self.features)), np.float32)
        for i, s in enumerate(samples):
            at = self._known(s)
            x[i, at[at >= 0]] = 1.0
        x /= np.sqrt(x.sum(axis=1, keepdims=True)).clip(1)
        self.weights = regression(x, np.array(y), len(self.classes), rounds, rate, decay)
        # the bound of the open-set rejection: the middle between strangers that look like a licence and worn variants
        strange = [self._cover(self._known(w)) for t in UNKNOWN.values() for p in t for w in self._windows(read(p))]
        fresh = [self._cover(self._known(self._worn(self._variant(t, c, rng), [], rng)[:WINDOW])) for c, t in texts.items() for _ in range(8)]
        self.known = float((np.quantile(strange, 0.95) + np.quantile(fresh, 0.05)) / 2)

    @staticmethod
    def _variant(passages: list[list[str]], c: str, rng: np.random.Generator) -> list[str]:
        least = ESSENTIAL.get(c)
        if c in LONG:
            # any passage of a long text is its own
            own = [p for p in passages if p[:3] != ["everyone", "is", "permitted"]]
            return own[rng.integers(len(own))]
        n = rng.integers(least or 1, len(passages) + 1)
        out = sum(passages[:n], [])
        return out[: len(out) - int(rng.integers(0, max(1, len(passages[n - 1]) // 3)))] if least is None else out

    @staticmethod
    def _worn(words: list[str], prose: list[list[str]], rng: np.random.Generator) -> list[str]:
        """Words dropped and misspelt, and prose around."""
        bad, out = rng.choice([0.0, 0.0, 0.02, 0.05]), []
        for w in words:
            r = rng.random()
            if r < bad / 2:
                continue
            if r < bad and len(w) > 3:
                i = int(rng.integers(len(w) - 1))
                w = w[:i] + w[i + 1] + w[i] + w[i + 2 :]
            out.append(w)
        if prose and rng.random() < 0.5:
            out = prose[rng.integers(4, len(prose))] + out
        if prose and rng.random() < 0.5:
            out = out + prose[rng.integers(4, len(prose))]
        return out

    @staticmethod
    def _grams(w: list[str]) -> list[str | None]:
        """The n-grams that begin at each word, one list after another; None where one would run over the end."""
        two = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        three = [f"{a} {b}" for a, b in zip(two, w[2:], strict=False)]
        return [*w, *two, *[None] * (len(w) - len(two)), *three, *[None] * (len(w) - len(three))]

    def _known(self, w: list[str]) -> np.ndarray:
        get = self.features.get
        return np.array([get(g, -1) for g in self._grams(w)], np.int64)

    @staticmethod
    def _cover(at: np.ndarray) -> float:
        """The share of pairs and triples of words that are known."""
        n = len(at) // 3
        return float((at[n:] >= 0).sum()) / max(1, 2 * n - 3)

    @staticmethod
    def _windows(w: list[str]) -> list[list[str]]:
        return [w[i : i + WINDOW] for i in range(0, max(1, len(w) - WINDOW + STEP), STEP)]

    def _told(self, at: np.ndarray) -> tuple[str, float]:
        at = np.unique(at[at >= 0])
        z = self.weights[at].sum(axis=0) / np.sqrt(max(1, len(at)))
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.classes[k], float(p[k])

    def found(self, words: list[str]) -> list[str]:
        """The licences whose text stands among ``words``, in the order of their places.

        Each beginning of a grant ends the text before it, so that texts one after another are told apart.
        """
        cuts = [0, *(i for i in range(1, len(words) - 2) if tuple(words[i : i + 3]) in self.begins), len(words)]
        out: list[str] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            # a refusal before a grant is part of it
            out += [c for c in self._within(words[max(0, a - 1) : b]) if c not in out]
        return out

    def _within(self, words: list[str]) -> list[str]:
        n = len(words)
        if n < 8:
            return []
        grams = self._known(words).reshape(3, n)
        # stretches of known wording: where of ten triples in a row most are known
        near = np.convolve((grams[2] >= 0).astype(np.int64), np.ones(10, np.int64))[:n]
        if near.max() < 6:
            return []
        out: list[str] = []
        parts: list[list] = []
        for i in range(0, max(1, n - WINDOW + STEP), STEP):
            at = grams[:, i : i + WINDOW].copy()
            # n-grams that run over the window's end are not its own
            at[1, -1:], at[2, -2:] = -1, -1
            if self._cover(at.reshape(-1)) < self.known and near[i : i + WINDOW].max() < 9:
                continue
            c, p = self._told(at.reshape(-1))
            if c == "none":
                continue
            kin = FAMILY.get(c, c) if p >= SURE and c != "other" else None
            if parts and i <= parts[-1][1] and (kin is None or parts[-1][2] in (None, kin)):
                parts[-1][1], parts[-1][2] = i + WINDOW, parts[-1][2] or kin
            else:
                parts.append([i, i + WINDOW, kin])
        for a, b, _ in parts:
            # the stretch's own ends: words of known triples
            solid = np.flatnonzero(grams[2, a : min(b, n)] >= 0) + a
            if not len(solid):
                continue
            a, b = int(solid[0]), min(int(solid[-1]) + 3, n)
            at = grams[:, a:b].copy()
            at[1, -1:], at[2, -2:] = -1, -1
            c, p = self._told(at.reshape(-1))
            if c in ("other", "none") or p < SURE or self._cover(at.reshape(-1)) < self.known or self._refused(words, a, b):
                continue
            triples = set(self._grams(words[a:b])[2 * (b - a) :])
            if c in self.grants and len(self.grants[c] & triples) < len(self.grants[c]) / 3:
                continue
            flat = " " + " ".join(words[a:b]) + " "
            if any(f" {k} " in flat for k in KIN.get(c, ())):
                continue
            # a text that breaks off within the grant need not come to MIT's condition; one that goes on has it
            asked = CONDITIONS.get(c, "").split() if c != "MIT" or " provided as is " in flat else []
            if asked and sum(g in triples for g in self._grams(asked)[2 * len(asked) : -2]) < len(asked) / 2 - 1:
                continue
            if c not in out:
                out.append(c)
        return out

    def _refused(self, words: list[str], a: int, b: int) -> bool:
        """Whether a refusing word stands right before the beginning of a template's sentence."""
        return any(tuple(words[i : i + 3]) in self.openings and i and words[i - 1] in _NOT | {"no"} for i in range(a, b))


@lru_cache(maxsize=4)
def trained(catalogue: tuple[str, ...]) -> LicenceModel:
    return LicenceModel(list(catalogue))


def _overall(statements: list[list[str]]) -> tuple[list[str], bool]:
    """(licences that agree with all statements, whether there are none although something is granted)."""
    if not statements:
        return [], False
    common = set(statements[0]).intersection(*statements[1:])
    if common:
        return sorted(common), False
    return sorted(set().union(*statements)), True


def opening_comments(text: str) -> str:
    """The words of the comments before the first code, without comment marks."""
    head = text[: _OPENING.match(text).end()]
    if not head.strip():
        return ""
    return re.sub(r"^[ \t]*(?:/\*+!?|\*+/|/{2,}!?|\*+(?!/))|\*+/", " ", head, flags=re.M)


def licences(files: DataFrame, repositories: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(scope, item_key, licences, source, finding) of every file row and repository.

    ``licences`` are the ids that apply (several if a choice is offered), null if none is known; ``source`` is where
    they come from (``file``, ``row``, ``repository``, ``text``, ``id``); rows of one repository's name add up; ``finding`` is ``conflict``, ``unknown`` or null. Null or
    empty contents state nothing. The catalogue is read to the driver: it is the list of class names of the model.
    """
    known = sorted(r["spdx_id"] for r in catalogue.select("spdx_id").distinct().collect() if r["spdx_id"])
    model = trained(tuple(known))

    def read(columns: list[tuple[str, bool]]) -> object:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            memo: dict[str, tuple[list[str], bool]] = {}
            for b in batches:
                out = b[["item_key", "repository"]].copy()
                for name, bare in columns:
                    found = []
                    for t in b[name]:
                        if bare:
                            if t not in memo:
                                if len(memo) > 100_000:
                                    memo.clear()
                                memo[t] = _overall(model.statements(t, bare=True)) if t else ([], False)
                            found.append(memo[t])
                        else:
                            words = opening_comments(t) if name == "contents" else t
                            found.append(_overall(model.statements(words)) if words else ([], False))
                    out[name], out[f"{name}_split"] = zip(*found, strict=True) if found else ([], [])
                yield out

        return run

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    repo_rows = repositories.select(F.col("repository").alias("item_key"), canonical_repository(F.col("repository")).alias("repository"), text("license_text").alias("words"), text("spdx_id").alias("id"))
    repo = repo_rows.mapInPandas(read([("words", False), ("id", True)]), "item_key string, repository string, words array<string>, words_split boolean, id array<string>, id_split boolean")
    has = lambda c: F.size(c) > 0
    repo = repo.withColumn("licences", F.when(has("words"), F.col("words")).when(has("id"), F.col("id"))).withColumn("source", F.when(has("words"), "text").when(has("id"), "id"))
    apart = has("words") & has("id") & ~F.arrays_overlap("words", "id")
    repo_out = repo.select(F.lit("repository").alias("scope"), "item_key", "licences", "source", F.when(F.col("words_split") | apart, "conflict").when(~has("words") & ~has("id"), "unknown").alias("finding"))

    file_rows = files.select(F.col("pair_id").cast("string").alias("item_key"), canonical_repository(F.col("repository")).alias("repository"), text("new_contents").alias("contents"), text("license").alias("row"))
    file = file_rows.mapInPandas(read([("contents", False), ("row", True)]), "item_key string, repository string, contents array<string>, contents_split boolean, row array<string>, row_split boolean")
    by_repo = repo.where("repository is not null").groupBy("repository").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("licences", F.array().cast("array<string>")))))).alias("of_repo"))
    file = file.join(by_repo, "repository", "left").withColumn("of_repo", F.coalesce("of_repo", F.array().cast("array<string>")))
    against = F.when(has("row"), F.col("row")).otherwise(F.col("of_repo"))
    apart = has("contents") & (F.size(against) > 0) & ~F.arrays_overlap("contents", against)
    applies = F.when(has("contents"), F.col("contents")).when(F.size(against) > 0, against)
    file_out = file.select(
        F.lit("file").alias("scope"),
        "item_key",
        applies.alias("licences"),
        F.when(has("contents"), "file").when(has("row"), "row").when(has("of_repo"), "repository").alias("source"),
        F.when(F.col("contents_split") | apart, "conflict").when(applies.isNull(), "unknown").alias("finding"),
    )
    return file_out.unionByName(repo_out)


def along_paths(files: DataFrame, found: DataFrame) -> DataFrame:
    """(item_key, licences, level) of every file: the licence that holds where it lies.

    Reconciles the predictions of ``licences`` along the folders of a repository: a file's own statement or row comes
    first (``file``, ``row``); else the licence of the nearest folder above it in which all files that state one agree
    (``folder``), then the repository's (``repository``); null where none does. A file without path lies in the root. A
    folder's licences are sets of at most the catalogue's size, so no folder or repository is gathered.
    """
    own = found.where("scope = 'file'").select("item_key", "licences", "source")
    path = F.coalesce(F.nullif(F.trim("new_file"), F.lit("")), F.nullif(F.trim("old_file"), F.lit("")), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    placed = files.select(F.col("pair_id").cast("string").alias("item_key"), canonical_repository(F.col("repository")).alias("repository"), parts.alias("parts")).distinct().join(own.distinct(), "item_key")
    above = F.transform(F.sequence(F.lit(0), F.greatest(F.size("parts") - 1, F.lit(0))), lambda i: F.array_join(F.slice("parts", F.lit(1), i), "/"))
    placed = placed.withColumn("folders", above)
    lies = placed.where("repository is not null").select("item_key", "repository", "licences", "source", F.posexplode("folders").alias("depth", "folder"))
    stated = lies.where(F.col("source").isin("file", "row") & (F.size("licences") == 1))
    agreed = stated.groupBy("repository", "folder").agg(F.min(F.col("licences")[0]).alias("one"), F.max(F.col("licences")[0]).alias("another")).where("one = another").select("repository", "folder", "one")
    silent = lies.where(~F.coalesce(F.col("source").isin("file", "row"), F.lit(False))).select("item_key", "repository", "depth", "folder")
    nearest = silent.join(agreed, ["repository", "folder"]).groupBy("item_key").agg(F.max(F.struct("depth", "one"))["one"].alias("one"))
    out = placed.select("item_key", "licences", "source").join(nearest, "item_key", "left")
    level = F.when(F.col("source").isin("file", "row"), F.col("source")).when(F.col("one").isNotNull(), "folder").when(F.col("source") == "repository", "repository")
    return out.select("item_key", F.when(level == "folder", F.array("one")).otherwise(F.col("licences")).alias("licences"), level.alias("level"))
