"""Reading level of articles.

Every sentence of the live prose gets several classic grade estimates from its length, its letters
and its syllables, by the formulas published for its language; their median is the sentence's grade.
Where the bands of ``graded_samples`` part is fitted per language on those samples (a bounded
number); an article has the band of most of its sentences.

Syllables are counted as hyphenation parts words: patterns of letters with levels between them, of
which the highest at a place decides (odd: the word parts there, even: it does not), say where
vowels that meet belong to two syllables. Endings tell which written vowels are silent.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np

from spanwise.llm.langid import LanguageFilter, Numbered, words_of
from spanwise.llm.tex import live_prose, sentences

BANDS = ("basic", "intermediate", "advanced")
#: Graded samples per language and band used for fitting, about; the table has a few dozen.
MAX_SAMPLES = 2_000


def _each(first: str, second: str, form: str) -> Iterable[str]:
    return (form.format(a, b) for a in first for b in second)


class Rules:
    """How a language's words part: its vowels, patterns with levels, and what changes the count.

    ``spelled`` are replacements made first, such as of a u that only shows how a q is spoken;
    ``silent`` finds vowels that are not spoken (the last letter of each match), ``more`` places that
    are a syllable without a vowel. ``base`` is the level between two vowels of which no pattern is.
    """

    def __init__(self, vowels: str, patterns: str | Iterable[str], base: int = 0, spelled: tuple[tuple[str, str], ...] = (), silent: str = "", more: str = "") -> None:
        self.vowels, self.base = frozenset(vowels), base
        self.spelled = [(re.compile(p), r) for p, r in spelled]
        self.silent = re.compile(silent) if silent else None
        self.more = re.compile(more) if more else None
        self.levels: dict[str, list[tuple[int, int]]] = {}
        for pattern in patterns.split() if isinstance(patterns, str) else patterns:
            letters = re.sub("[0-9]", "", pattern)
            at = [(m.start() - i, int(m.group())) for i, m in enumerate(re.finditer("[0-9]", pattern))]
            self.levels.setdefault(letters, []).extend(at)
        self.longest = max(map(len, self.levels), default=0)

    def count(self, word: str) -> int:
        for p, r in self.spelled:
            word = p.sub(r, word)
        meet = [i for i in range(1, len(word)) if word[i] in self.vowels and word[i - 1] in self.vowels]
        n = sum(c in self.vowels for c in word) - len(meet)
        if meet:
            levels = dict.fromkeys(meet, self.base)
            marked = f".{word}."
            for start in range(len(marked)):
                for end in range(start + 2, min(len(marked), start + self.longest) + 1):
                    for at, level in self.levels.get(marked[start:end], ()):
                        place = start + at - 1  # the dot before the word is no letter of it
                        if place in levels:
                            levels[place] = max(levels[place], level)
            n += sum(level % 2 for level in levels.values())
        if self.silent:
            n -= len({m.end() for m in self.silent.finditer(word)})
        if self.more:
            n += len(self.more.findall(word))
        return n


# A vowel letter's neighbours: what follows is silent after a consonant that ends a spoken syllable.
_ENGLISH_SILENT = "|".join(
    (
        r"(?<=[^aeiouyl])(?<![bct]r)e(?=$)",
        r"(?<=[aeiouy]l)e(?=$)",
        r"(?<=[^aeiouylsxzcgh])e(?=s$)",
        r"(?<=[tp]h)e(?=s$)",
        r"(?<=[aeiouy]l)e(?=s$)",
        r"(?<=[^aeiouytdl])e(?=d$)",
        r"(?<=[aeiouylr]l)e(?=d$)",
        r"(?:(?<=[aeiouy][^aeiouyl])|(?<=[aeiouy][^aeiouy][^aeiouyl]))e(?=(?:ments?|ly|ness|less|lessly|fully?|some|thing|where|body)$)",
        r"^(?:some|there|where|here|more|fore(?!st|ig)|home|life|time|like(?!l)|wide|side|fire|name|game|care|use|hope|safe|base(?!m)|made|make|take|note|face|place|store|space|horse|cheese|nine)(?=[bcdfghjklmnpqrstvwxz])",
        r"^ev(?:e)(?=r[y])|^eve(?=ning)|^busi(?=ness)|^wedne(?=s)",
    )
)
_FRENCH_SILENT = "|".join(
    (
        r"(?<=[^aeiouyàâäæéèêëîïôöœùûüÿ])e(?=s?$)",
        r"(?<=[ao]nn)e(?=nt$)|(?<=[ei]nn)e(?=nt$)|(?<=ett)e(?=nt$)|(?<=euv)e(?=nt$)|(?<=rouv)e(?=nt$)|(?<=oiv)e(?=nt$)|(?<=eul)e(?=nt$)|(?<=is)e(?=nt$)|(?<=ntr)e(?=nt$)|(?<=èr)e(?=nt$)|(?<=ss)e(?=nt$)",
        r"(?<=iv)e(?=nt$)|(?<=i[rst]r)e(?=nt$)|(?<=mbl)e(?=nt$)|(?<=xist)e(?=nt$)|(?<=est)e(?=nt$)|(?<=parl)e(?=nt$)|(?<=arch)e(?=nt$)|(?<=herch)e(?=nt$)|(?<=port)e(?=nt$)|(?<=sent)e(?=nt$)",
    )
)
_STRONG, _WEAK = "aeoáéó", "íú"

#: Hyphenation rules of vowels by language.
RULES = {
    "en": Rules(
        "aeiouy",
        "i1a ci2a ti2a si2a gi2a xi2a ci3ate ti3ate ci3atio ti3atio .gi3an di1ev i1o ci2o ti2o si2o gi2o xi2o chi2o shi2o hi2on i1u ci2u ti2u gi2u i1et i1ety quie3t sci3e cli1en i1enc i1ent ci2ent ti2ent ci2enc ti2enc fri2en li1en "
        "ri1er pi1er li1er vi1er ppi1er ti2er fi2er i1est pri2est ci2est i1ou ci2ou ti2ou gi2ou xi2ou ci3ety ni1or di1o mi1i i1i ii1 "
        "cre1a cre2atu cre2am scre2a ide1a re1act re1ality re1aliz re1alis re1as.. are1a ine1ar ucle1ar the1at the1or e1o ge2o .ge3o .ge4or pe2op leo2p e1um e1ing eei1n e1ous ge2ous .more2o ne1ous bea2u nau1s "
        "u1a gu2a qu2a su2ad u1ou u1el gu2el qu2el u1en gu2en qu2en u1et qu2et gu2et u1in gu2in qu2in u1id gu2id qu2id nu1it tu1it gu1ity qu2it u1o qu2o bu2oy u1y gu2y bu2y "
        "o1em o1et ero1ic sto1ic o1ing co1op co1or co1inc zo1ol a1os a1ic na1iv a1o y1i e1yo y1er oy1al oy1ee y1ab oi2ng1 poe2m o1est ",
        silent=_ENGLISH_SILENT,
        more=r"(?<=[^aeiouy])n't$|sms?$|thms?$",
        spelled=(("^y(?=[aeiou])", "j"), ("(?<=[aeo])y(?=o)", "j"), ("que(s?)$", r"k\1"), ("gue(s?)$", r"g\1")),
    ),
    "de": Rules(
        "aeiouyäöü",
        "a2i a2u e2i ei3e e2u ä2u i2e o2o e2e a2a a2y e2y o2y o2u be3en be3ei ge3en ge3ei ge3är e3um lä3um li3en. ri3en. di3en. ni3en. li3e. ni3e. di3e. .di4e. ri3ent li3ent ti3ent di3ent i3enz i3ell i3är i3eu i3ent. zi3ent "
        ".sie4 .wie4 .nie4 .die4 .di4ene ge3i4 ge3u zi3er. bli4e fri4e ni4em ",
        base=1,
        spelled=(("qu", "q"),),
    ),
    "fr": Rules(
        "aeiouyàâäæéèêëîïôöœùûüÿ",
        [*"é1a é1â é1o é1e é1u é1i é1é é2e. é2es. a1ï o1ï u1ï é1ï o1ë a1ë o1é a1é a1o o1o o1a i1i .pa1ys a1ïe cru1el flu1en sci1e ".split(), *_each("aou", "aeoéèu", "{0}1y{1}"), *(f"{c}{x}i1{v}" for c in "bcdfgptv" for x in "lr" for v in "aeoéèêu")],
        spelled=(("qu", "q"), ("gu(?=[eéèêiîy])", "g"), ("ge(?=[aoâô])", "j")),
        silent=_FRENCH_SILENT,
    ),
    "es": Rules(
        "aeiouyáéíóúü",
        [*_each(_STRONG, _STRONG, "{0}1{1}"), *_each(_STRONG + _WEAK, _WEAK, "{0}1{1}"), *_each(_WEAK, _STRONG, "{0}1{1}")],
        spelled=(("qu", "q"), ("gu(?=[eéií])", "g"), ("y(?=[aeiouáéíóú])", "j")),
    ),
}


def syllables(word: str, lang: str) -> int:
    """Syllables of a lower-case word, at least one; parts beside an apostrophe count on their own.

    Languages without rules of their own use the English ones.
    """
    rules = RULES.get(lang, RULES["en"])
    if "'" in word and not word.endswith("n't"):
        return max(1, sum(rules.count(p) if len(p) > 1 else 0 for p in word.split("'")))
    return max(1, rules.count(word))


def _general(w: np.ndarray, syll: np.ndarray, letters: np.ndarray, poly: np.ndarray, long: np.ndarray, mono: np.ndarray) -> list[np.ndarray]:
    """Estimates that do not depend on how long the words of a language are spoken."""
    return [
        4.71 * letters / w + 0.5 * w - 21.43,  # automated readability index
        (w + 100 * long / w) / 4 - 2,  # LIX on the scale of grades
        5.88 * letters / w - 29.6 / w - 15.8,  # Coleman-Liau
    ]


def _ease(score: np.ndarray) -> np.ndarray:
    """A reading ease between 0 and 100 on the scale of grades."""
    return 26.1 - score / 5


Counts = tuple[np.ndarray, ...]
#: The published formulas of each language, of words, syllables, letters, words of three syllables or
#: more, words of more than six letters and words of one syllable in a sentence.
FORMULAS: dict[str, Callable[..., list[np.ndarray]]] = {
    "en": lambda w, s, c, p, x, m: [
        0.39 * w + 11.8 * s / w - 15.59,  # Flesch-Kincaid
        0.4 * (w + 100 * p / w),  # Gunning fog
        1.043 * np.sqrt(30.0 * p) + 3.1291,  # SMOG
        _ease(206.835 - 1.015 * w - 84.6 * s / w),  # Flesch
    ],
    "de": lambda w, s, c, p, x, m: [
        0.1935 * 100 * p / w + 0.1672 * w + 0.1297 * 100 * x / w - 0.0327 * 100 * m / w - 0.875,  # first Vienna formula
        0.2007 * 100 * p / w + 0.1682 * w + 0.1373 * 100 * x / w - 2.779,  # second
        0.2963 * 100 * p / w + 0.1905 * w - 1.1144,  # third
        _ease(180 - w - 58.5 * s / w),  # Amstad
    ],
    "fr": lambda w, s, c, p, x, m: [
        _ease(207 - 1.015 * w - 73.6 * s / w),  # Kandel and Moles
        0.4 * (w + 100 * p / w),  # fog
    ],
    "es": lambda w, s, c, p, x, m: [
        _ease(206.84 - 60 * s / w - 1.02 * w),  # Fernández Huerta
        _ease(206.835 - 62.3 * s / w - w),  # Szigriszt Pazos
        -20.5 / w + 4.9 * s / w - 3.407,  # Crawford, by 100 words
        0.74 * (1.043 * np.sqrt(30.0 * p) + 3.1291) - 2.51,  # SMOG adapted
    ],
}


def grades(lang: str, words: np.ndarray, *counts: np.ndarray) -> np.ndarray:
    """Median grade of sentences of a language with these counts (arrays of one length, words at least 1)."""
    w = words.astype(float)
    return np.median(np.stack(FORMULAS.get(lang, FORMULAS["en"])(w, *counts) + _general(w, *counts)), axis=0)


class Syllabler:
    """Counts of words in one language, each distinct word worked out once.

    Words are those numbered by a language filter, so that a text is cut into words once for both.
    """

    def __init__(self, lang: str, words: Numbered) -> None:
        self.lang = lang
        self.words = words
        self.counts = np.zeros((0, 5), np.int32)

    def grade(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Grades of sentences given as numbered words; nan for those without words."""
        new = [w.decode() for w in self.words.order[len(self.counts) :]]
        if new:
            rows = np.array([(s := syllables(w, self.lang), len(w) - w.count("'"), s >= 3, len(w) > 6, s == 1) for w in new], np.int32)
            self.counts = np.concatenate([self.counts, rows])
        out = np.full(len(sizes), np.nan)
        some = np.flatnonzero(sizes)
        if len(some):
            sums = np.add.reduceat(self.counts[codes], (np.cumsum(sizes) - sizes)[some], axis=0)
            out[some] = grades(self.lang, sizes[some], *sums.T)
        return out


def fit_cuts(grade: np.ndarray, band: np.ndarray) -> tuple[float, float]:
    """The two grades that part three bands (0, 1, 2) with the fewest mistakes, bands weighing alike.

    Between equally good cuts the middle of the widest gap is taken.
    """

    def cut(low: np.ndarray, high: np.ndarray) -> float:
        both = np.unique(np.r_[low, high])
        if len(both) < 2 or not len(low) or not len(high):
            return float(both.mean()) if len(both) else 0.0
        mid = (both[1:] + both[:-1]) / 2
        wrong = np.array([(low > m).mean() + (high <= m).mean() for m in mid])
        best = np.flatnonzero(wrong == wrong.min())
        return float(mid[best[np.argmax((both[1:] - both[:-1])[best])]])

    return cut(grade[band == 0], grade[band == 1]), cut(grade[band == 1], grade[band == 2])


class Grader:
    """Bands of articles. Fitted on graded samples, languages told apart by a language filter."""

    def __init__(self, languages: LanguageFilter, samples: list[tuple[str, str, str]]) -> None:
        self.languages = languages
        self._fresh()
        self.cuts: dict[str, tuple[float, float]] = {}
        for lang in sorted({s[0] for s in samples if s[0]}):
            own = [(BANDS.index(b), t) for s, b, t in samples if s == lang and b in BANDS and t]
            bags = [[words_of(x) for x in sentences(t)] for _, t in own]
            grade = self._grade(lang, *languages.codes([w for bag in bags for w in bag]))
            band = np.repeat([b for b, _ in own], [len(bag) for bag in bags]).astype(np.int64)
            ok = ~np.isnan(grade)
            if ok.any():
                self.cuts[lang] = fit_cuts(grade[ok], band[ok])
        if not self.cuts:
            raise ValueError("no graded samples")

    def _fresh(self) -> None:
        self.by_lang: dict[str, Syllabler] = {}

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "cuts": self.cuts}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._fresh()

    def _grade(self, lang: str, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        own = self.by_lang.get(lang)
        if own is None or own.words is not self.languages.number:
            own = self.by_lang[lang] = Syllabler(lang, self.languages.number)
        return own.grade(codes, sizes)

    def judge(self, texts: list[str | None]) -> list[tuple[str | None, str | None, list[int], float | None]]:
        """(band, language, sentences of each band, median grade) of each article.

        All None for an article without live prose. The language is the article's; one without
        graded samples, or that cannot be told, is graded by the cuts of English, or else of the
        first language that has any. Ties between bands go to the less demanding one.
        """
        parts = [sentences(live_prose(t)) for t in texts]
        bags = [words_of(s) for p in parts for s in p]
        codes, sizes = self.languages.codes(bags)
        per = np.fromiter(map(len, parts), np.int64, len(parts))
        owner = np.repeat(np.arange(len(parts)), per)
        sums = np.zeros((len(parts), len(self.languages.langs)))
        np.add.at(sums, owner, self.languages.sums(codes, sizes))
        words = np.bincount(owner, sizes, len(parts)).astype(np.int64)
        best, _ = self.languages.decide(sums, words)
        grade = np.full(len(bags), np.nan)
        other = "en" if "en" in self.cuts else next(iter(self.cuts))
        lang = [self.languages.langs[b] if b >= 0 else None for b in best]
        used = np.array([x if x in self.cuts else other for x in lang], object)
        ends = np.cumsum(sizes)
        band = np.zeros(len(bags), np.int64)
        for x in dict.fromkeys(used):
            mine = np.flatnonzero(used[owner] == x)
            n = sizes[mine]
            at = np.repeat((ends - sizes)[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            grade[mine] = self._grade(x, codes[at], n)
            band[mine] = np.digitize(grade[mine], self.cuts[x])
        ok = ~np.isnan(grade)
        counts = np.zeros((len(parts), len(BANDS)), np.int64)
        np.add.at(counts, (owner[ok], band[ok]), 1)
        cut = np.cumsum(per)[:-1]
        medians = [float(np.median(g[~np.isnan(g)])) if (~np.isnan(g)).any() else None for g in np.split(grade, cut)] if len(parts) else []
        return [(BANDS[int(c.argmax())], x, c.tolist(), m) if c.sum() else (None, None, [0, 0, 0], None) for c, x, m in zip(counts, lang, medians, strict=True)]
