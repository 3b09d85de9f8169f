"""One form for text that looks the same.

Which letters look alike is read from Unicode's confusables data, as the ICU library that Spark
ships has it. Each token is taken to the scripts its letters can be read in: a letter belongs to its
own script and to every script that has a letter of the same look. Where these sets have scripts in
common the token has a consistent spelling and is rewritten in it; a token that several scripts
could spell whole (a whole-script confusable) follows the other tokens of its text. What remains is
normalized: width forms, ligatures, composition, kinds of blanks, invisible characters.

The form depends on nothing but the look. Letters of different case, different letters of one
script, visible accents, digits, punctuation, styled letters, words, emoji and runs of blanks stay
apart, even where Unicode counts them as confusable.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.session import materialize

#: Hyphens drawn like the plain one.
HYPHENS = "‐‑"
#: Unicode's compatibility tags under which the decomposition looks like the character.
_SAME_LOOK = ("<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>", "<noBreak>")
_LIGATURES = range(0xFB00, 0xFB50)
#: A script without case imitates Latin letters if so many of its letters look like one.
LIKE_LATIN = 8
# joiners and the first variation selectors show in some places
_JOINER, _SELECTORS, _TAGS = "\u200c\u200d", "\ufe00-\ufe0f", "\U000e0020-\U000e007f"
_TOKEN = re.compile(r"[^\W\d_](?:[^\W_]|[\u0300-\u036f'\u2019-])*")
# joiners shape the letters of Indic and Arabic scripts and join emoji; elsewhere they show nothing
_INDIC = "\u0900-\u0dff"
_ARABIC = "\u0600-\u06ff\u0750-\u077f"
_VIRAMA = "".join(chr(c) for c in range(0x900, 0xE00) if "SIGN VIRAMA" in unicodedata.name(chr(c), "") or "SIGN AL-LAKUNA" in unicodedata.name(chr(c), ""))
_EMOJI = "\U0001f000-\U0001faff\u2190-\u2bff"
_JOINERS = re.compile(rf"(?<![{_VIRAMA}])[{_JOINER}](?=[{_INDIC}])|(?<![{_ARABIC}])\u200c(?=[{_ARABIC}])|\u200d(?=[{_ARABIC}])|[{_JOINER}](?![{_INDIC}{_ARABIC}{_EMOJI}])")
_EMOJI_JOIN = re.compile(rf"(?<![{_EMOJI}\ufe0f])\u200d(?=[{_EMOJI}])")
_VARIATION = re.compile(rf"(?<![{_EMOJI}\u00a9\u00ae\u203c\u2049#*0-9])[{_SELECTORS}]")
# a flag is a black flag with tags; tags elsewhere show nothing
_TAGGED = re.compile(f"(\U0001f3f4[{_TAGS}]+)|[{_TAGS}]")


def script_of(ch: str) -> str:
    """Script of a letter as its Unicode name begins; "" for what belongs to every script."""
    return unicodedata.name(ch, "").split(" ", 1)[0] if ch.isalpha() else ""


def _case(ch: str) -> str:
    return "upper" if ch.isupper() or unicodedata.category(ch) == "Lt" else "lower" if ch.islower() or unicodedata.category(ch) == "Lm" else "other"


class Forms:
    """The tables and the rewriting; plain data of some thousand letters, so that it can be sent to workers."""

    def __init__(self, skeletons: dict[str, str], recommended: frozenset[str], invisible: frozenset[str]) -> None:
        """``skeletons`` takes letters to the look Unicode gives them, ``recommended`` are the letters in
        common use, ``invisible`` the characters that show nothing."""
        self.width = {ord(c): "" for c in invisible if c not in _JOINER and not "\ufe00" <= c <= "\ufe0f" and not "\U000e0020" <= c <= "\U000e007f"}
        for cp in [*_LIGATURES, *range(0xFB50, 0xFDFE), *range(0xFE70, 0xFF00), *range(0xFF01, 0xFFEF), *range(0x2160, 0x2180)]:
            d = unicodedata.decomposition(chr(cp))
            if d and cp not in self.width and (d.split()[0] in _SAME_LOOK or (cp in _LIGATURES or cp in range(0x2160, 0x2180)) and d.startswith("<compat>")):
                self.width[cp] = unicodedata.normalize("NFKC", chr(cp))
        blanks = [c for c in map(chr, range(0x3001)) if unicodedata.category(c) in ("Zs", "Zl", "Zp")] + list("\t\n\r\v\f\x85")
        self.width |= {ord(c): " " for c in blanks if c != " "} | {ord(c): "-" for c in HYPHENS} | {0x2026: "...", 0x2024: ".", 0x2025: ".."}
        self.odd = _class_of([*map(chr, self.width), *_JOINER, *map(chr, range(0xFE00, 0xFE10))])
        self._letters(skeletons, recommended)
        self.known: dict[str, tuple[tuple[str, ...], str | None]] = {}

    def _letters(self, skeletons: dict[str, str], recommended: frozenset[str]) -> None:
        groups: dict[tuple[str, str], list[str]] = {}
        for ch in sorted(skeletons):
            # letters with accents are told apart by these, styled ones by their style
            made_of = unicodedata.decomposition(ch)
            if script_of(ch) and (not made_of or made_of.startswith("<compat>")):
                groups.setdefault((skeletons[ch], _case(ch)), []).append(ch)
        latin: dict[str, list[str]] = {}
        for (look, _), own in groups.items():
            latin.setdefault(look, []).extend(x for x in own if x.isascii())
        imitating = Counter(script_of(ch) for (s, case), own in groups.items() if case == "other" and len(s) == 1 and s.isascii() for ch in own)
        self.proto: dict[int, str] = {}
        self.spell: dict[str, dict[int, str]] = {}
        readable: dict[str, set[str]] = {}
        for (look, case), own in groups.items():
            if case == "other":
                ascii_of = latin[look]
                if len(ascii_of) == 1:
                    own = [ch for ch in own if imitating[script_of(ch)] >= LIKE_LATIN]
                    own, common = [*ascii_of, *own], [*ascii_of]
                else:
                    common = [ch for ch in own if ch in recommended]
            else:
                common = [ch for ch in own if ch in recommended]
            # of each script the first letter in common use stands for the look; its others stay themselves
            first: dict[str, str] = {}
            for ch in common or own[:1]:
                first.setdefault(script_of(ch), ch)
            head = next((ch for ch in own if ch.isascii()), None) or min(first.values())
            members = [ch for ch in own if ch not in recommended or ch in first.values()]
            if len(members) < 2:
                continue
            readable.setdefault(head, set()).update(first)
            for script, ch in first.items():
                self.spell.setdefault(script, {})[ord(head)] = ch
            self.proto |= {ord(ch): head for ch in members if ch != head}
        self.spell.pop("LATIN", None)
        self.readable = {ch: frozenset(s) for ch, s in readable.items()}
        # what can be spelled in two ways has a letter that looks like another, beyond ASCII, or one of a
        # script that could have spelled an ASCII letter
        like_ascii = {s for s, m in self.spell.items() if min(m) < 128}
        self.ambiguous = _class_of({ch for ch in skeletons if script_of(ch) in like_ascii} | set(map(chr, self.proto)) | {ch for ch in readable if not ch.isascii()})

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def token_scripts(self, prototypes: str) -> frozenset[str] | None:
        """Scripts in which a token of this look can be spelled whole; None if it has no letters."""
        common: frozenset[str] | None = None
        for ch in prototypes:
            own = self.readable.get(ch)
            if own is None:
                script = script_of(ch)
                if not script:
                    continue
                own = frozenset({script})
            common = own if common is None else common & own
        return common

    def _judged(self, token: str) -> tuple[tuple[str, ...], str | None]:
        """Scripts a token can be spelled in, and its spelling where the text around it does not matter."""
        known = self.known.get(token)
        if known is None:
            scripts = tuple(sorted(self.token_scripts(token) or ()))
            if len(scripts) > 1:
                spelled = None
            else:  # where no script spells it whole: that of most of its unmistakable letters, as far as it goes
                to = self.spell.get(scripts[0] if scripts else _most(Counter(s for c in token if c not in self.readable and (s := script_of(c)))))
                spelled = token.translate(to) if to else token
            if len(self.known) > 200_000:
                self.known.clear()
            known = self.known[token] = scripts, spelled
        return known

    def resolve(self, text: str) -> str:
        """Rewrites every token of a decomposed text in a consistent script."""
        plain = text.translate(self.proto)
        tokens = [(m, *self._judged(m[0])) for m in _TOKEN.finditer(plain)]
        # tokens of one possible script decide for those of several; without any, Latin is taken
        votes = Counter(scripts[0] for _, scripts, _ in tokens if len(scripts) == 1)
        out, at = [], 0
        for m, scripts, spelled in tokens:
            out.append(plain[at : m.start()])
            at = m.end()
            if spelled is None:
                to = self.spell.get(min(scripts, key=lambda s: (-votes[s], s != "LATIN", s)))
                spelled = m[0].translate(to) if to else m[0]
            out.append(spelled)
        out.append(plain[at:])
        return "".join(out)

    def canonical(self, text: str | None) -> str | None:
        """The form of a text. Null stays null; a text that shows nothing becomes the empty text."""
        if text is None:
            return None
        if text.isascii():
            return text.strip() if text.isprintable() else text.translate(self.width).strip()
        beyond = _BEYOND.search(text)
        if beyond or self.odd.search(text):
            text = _TAGGED.sub(lambda m: m[1] or "", text.translate(self.width))
            text = _JOINERS.sub("", _VARIATION.sub("", _EMOJI_JOIN.sub("", text)))
        if beyond or self.ambiguous.search(text):
            text = self.resolve(unicodedata.normalize("NFD", text))
        # the same letters whichever way they were composed
        return unicodedata.normalize("NFC", text).strip()


#: Characters beyond the first plane. The pattern engine looks others up in a table, but only where a class
#: has none of these, so they are looked for on their own and texts with any are always worked out.
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _class_of(letters: Iterable[str]) -> re.Pattern:
    return re.compile("[" + "".join(_ranges("".join(sorted(c for c in letters if c < "\U00010000")))) + "]")


def _ranges(letters: str) -> Iterator[str]:
    """Sorted letters as the ranges of a character class."""
    at = 0
    while at < len(letters):
        end = at
        while end + 1 < len(letters) and ord(letters[end + 1]) == ord(letters[end]) + 1:
            end += 1
        yield re.escape(letters[at]) + (f"-{re.escape(letters[end])}" if end > at else "")
        at = end + 1


def _most(votes: Counter) -> str:
    return min(votes, key=lambda s: (-votes[s], s != "LATIN", s)) if votes else "LATIN"


_FORMS: list[Forms] = []


def forms(spark: SparkSession) -> Forms:
    """The tables, made once from the data of the ICU library of the driver's JVM."""
    if not _FORMS:
        icu = spark.sparkContext._jvm.com.ibm.icu.text

        def members(pattern: str) -> list[str]:
            own = icu.UnicodeSet(pattern)
            return [chr(c) for i in range(own.getRangeCount()) for c in range(own.getRangeStart(i), own.getRangeEnd(i) + 1)]

        check = icu.SpoofChecker
        letters = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha()]
        looks = check.Builder().setChecks(check.CONFUSABLE).build().getSkeleton("\n".join(letters)).split("\n")
        _FORMS.append(Forms(dict(zip(letters, looks, strict=True)), frozenset(members(check.RECOMMENDED.toPattern(False))), frozenset(members("[[:Cf:][:Default_Ignorable_Code_Point:]-[:Prepended_Concatenation_Mark:]]"))))
    return _FORMS[0]


#: A text that is its own form: printable ASCII without a blank at either end.
PLAIN = r"^[!-~](?:[ -~]*[!-~])?$"


def with_form(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """Adds ``out_col``, the form of ``text_col``, in one Arrow-batched pass without a shuffle."""
    own = df.sparkSession.sparkContext.broadcast(forms(df.sparkSession))
    names = [c for c in df.columns if c != out_col]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = own.value.canonical
        at = names.index(text_col)
        for batch in batches:
            texts = batch.column(at).dictionary_encode()
            form = pa.array([canonical(t) for t in texts.dictionary.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, form.take(texts.indices)], names=schema.fieldNames())

    return df.select(*names).mapInArrow(run, schema)


def look_classes(cues: DataFrame, group_col: str, order_col: str, text_col: str) -> DataFrame:
    """(group, order, class_id, spelling, links): the texts of a group that look like another one of it but
    differ from it.

    ``class_id`` names the class of one look within the group, ``spelling`` the text's characters
    within the class; ``links`` is with how many rows of the class it shares the look but not the
    spelling. Null and empty texts are in no class; texts that show nothing (only blanks or
    invisible characters) look the same. Exact repeats of a row count once; a row whose group or
    order is null is left out.

    Only texts that may differ from their form go through Python, once; the result, with forms, is
    kept in the shared folder. A look matters only if one of these has it and differs from it. So
    the looks of those few are what the plain texts, which are forms themselves, are held against:
    an equi-join of which adaptive execution broadcasts the side of the looks only where it is
    measured to be small, and splits a hot key otherwise. Classes are counted by spelling, so no class
    is gathered.
    """
    key = [group_col, "form"]
    rows = cues.select(group_col, order_col, text_col).filter(F.col(group_col).isNotNull() & F.col(order_col).isNotNull() & (F.col(text_col) != ""))
    plain = F.col(text_col).rlike(PLAIN)
    odd = materialize(with_form(rows.filter(~plain), text_col, "form"))
    looks = odd.filter(F.col("form") != F.col(text_col)).select(*key).distinct()
    own = rows.filter(plain).withColumn("form", F.col(text_col)).unionByName(odd).join(looks, key, "left_semi")
    # a spelling of a look with its rows, then the looks with several spellings
    varied = materialize(own.distinct())
    spellings = varied.groupBy(*key, text_col).agg(F.count("*").alias("same"))
    totals = spellings.groupBy(*key).agg(F.sum("same").alias("all"), F.count("*").alias("spellings")).filter("spellings > 1")
    linked = spellings.join(totals, key).select(*key, text_col, (F.col("all") - F.col("same")).alias("links"))
    digest = lambda *c: F.md5(F.to_json(F.struct(*c)))
    return varied.join(linked, [*key, text_col]).select(group_col, order_col, digest(*key).alias("class_id"), digest(text_col).alias("spelling"), "links")


def look_alikes(cues: DataFrame, group_col: str, order_col: str, text_col: str) -> DataFrame:
    """(group, order_a, order_b), a before b: the pairs that :func:`look_classes` stands for.

    Each pair once whatever the number of repeats; a row makes no pair with itself. Classes are
    expanded by an equi-join on the class, which a skewed class may split.
    """
    classes = look_classes(cues, group_col, order_col, text_col).drop("links")
    a, b = classes.alias("a"), classes.alias("b")
    same = (F.col(f"a.{group_col}") == F.col(f"b.{group_col}")) & (F.col("a.class_id") == F.col("b.class_id"))
    pairs = a.join(b, same & (F.col(f"a.{order_col}") < F.col(f"b.{order_col}")) & (F.col("a.spelling") != F.col("b.spelling")))
    return pairs.select(F.col(f"a.{group_col}").alias(group_col), F.col(f"a.{order_col}").alias(f"{order_col}_a"), F.col(f"b.{order_col}").alias(f"{order_col}_b")).distinct()
