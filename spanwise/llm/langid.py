"""Languages of texts by language-bitmask n-gram filters.

All languages share one Bloom filter per n-gram length, laid out bit-sliced: a slot is a bit mask
with one bit per language profile, and an n-gram sets its bit in K slots for every profile it was
seen in. One look-up, the AND of K slots, thus returns all profiles that may contain the n-gram.
A text is judged by the popcount of every profile over its n-grams, corrected for the rate at
which that profile's bits answer by chance. Words are looked up once each and kept with their
corrected counts, so a text costs a look-up and an addition per word.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from spanwise.llm.glyphs import forms
from spanwise.llm.tex import live_prose
from spanwise.session import materialize

#: n-gram lengths and their weight: longer ones tell related languages apart.
WEIGHTS = {1: 0.15, 2: 0.5, 3: 1.0, 4: 1.5, 5: 2.0}
#: Weight of a whole word the samples contain.
WORD_WEIGHT = 1.0
SHARPNESS = 2.0
#: Least sum a word's vote is divided by: words hardly known to any profile hardly vote.
BACKGROUND = 0.5
#: Rate at which a profile's filter may answer for an n-gram it does not hold; it sizes the filters.
FALSE_RATE = 1e-3
K = 3
#: Samples per label the filters are fitted on, about: a sample by hash where a label has more.
MAX_SAMPLES = 5_000
CACHE_WORDS = 300_000
#: A word of at most so many letters has too few n-grams to tell languages apart; it votes only where
#: the samples hold it as a word.
SHORT_WORD = 2
#: A text whose words have less evidence than this has no language.
MIN_EVIDENCE = 0.2

# sound marks and speaker signs
_MARK = re.compile(r"\[[^\]]*\]")
# what is no letter or mark among the other characters; ASCII is dealt with by _BYTES
_SIGN = re.compile("[^\\w\x00-\x7f\u0300-\u036f\u0600-\u06ff\u0900-\u0dff]|[\u06d4\u060c\u061b\u061f\u0964\u0965\u0660-\u0669\u06f0-\u06f9\u0966-\u096f]")
# letters and apostrophes stay, other ASCII parts words; bytes beyond ASCII belong to letters
_BYTES = bytes(c if c >= 0x80 or chr(c).isalpha() or chr(c) == "'" else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words of a text as UTF-8, sound marks in brackets left out."""
    if "[" in text:
        text = _MARK.sub(" ", text)
    if not text.isascii():
        text = _SIGN.sub(" ", text.replace("’", "'").replace("\u200d", "").replace("\u200c", ""))
    return text.lower().encode().translate(_BYTES).split()


class Numbered(dict):
    """Numbers words in the order they are first asked for; ``order`` lists them."""

    def __init__(self) -> None:
        super().__init__()
        self.order: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.order)
        self.order.append(word)
        return number


def _slots(grams: list[str], n_slots: int) -> np.ndarray:
    """K of ``n_slots`` (a power of two) slots of each n-gram, shape (n, K)."""
    h = np.fromiter((zlib.crc32(g.encode()) | (zlib.adler32(g.encode()) << 32) for g in grams), np.uint64, len(grams))
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64(n_slots - 1) for i in range(K)], axis=1).astype(np.int64)


def slots_for(grams: int) -> int:
    """Slots, a power of two, that keep a filter of so many n-grams at FALSE_RATE."""
    fill = FALSE_RATE ** (1 / K)
    return 1 << max(6, int(np.ceil(np.log2(max(1, grams) * K / -np.log(1 - fill)))))


def _grams(word: str, n: int) -> list[str]:
    padded = f"_{word}_"
    if n == 1:
        return list(word)
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _profile(lang: str, text: str) -> str:
    """A language written in several scripts has a profile per script."""
    latin = sum(c < "ɐ" for c in text if c.isalpha())
    other = sum(c >= "ɐ" for c in text if c.isalpha())
    return f"{lang}:{'L' if latin >= other else 'N'}"


class LanguageFilter:
    """The filters, fitted on labelled samples; picklable.

    A slot has as many 32-bit words as the profiles need. Each n-gram length has as many slots as
    its largest profile needs for FALSE_RATE: some hundred kilobytes for samples of a few hundred
    captions, and bounded by MAX_SAMPLES.
    """

    def __init__(self, samples: list[tuple[str, str]]) -> None:
        samples = [(lang, unicodedata.normalize("NFC", t)) for lang, t in samples if lang and t]
        self.profiles = sorted({_profile(lang, t) for lang, t in samples})
        self.langs = sorted({p.split(":")[0] for p in self.profiles})
        self.lang_of = np.array([self.langs.index(p.split(":")[0]) for p in self.profiles], np.int64)
        self.tables: dict[int, np.ndarray] = {}
        self.by_chance: dict[int, np.ndarray] = {}
        bags: dict[str, set[str]] = {p: set() for p in self.profiles}
        for lang, text in samples:
            bags[_profile(lang, text)].update(w.decode() for w in words_of(text))
        for n in [*WEIGHTS, 0]:
            grams = [sorted(bags[p]) if n == 0 else sorted({g for w in bags[p] for g in _grams(w, n)}) for p in self.profiles]
            slots = np.zeros((slots_for(max(map(len, grams), default=0)), -(-len(self.profiles) // 32)), np.uint32)
            for bit, own in enumerate(grams):
                if own:
                    slots[_slots(own, len(slots)).ravel(), bit // 32] |= np.uint32(1 << bit % 32)
            self.tables[n] = slots
            fill = np.array([np.count_nonzero(slots[:, b // 32] & np.uint32(1 << b % 32)) for b in range(len(self.profiles))]) / len(slots)
            self.by_chance[n] = fill**K
        self._fresh()

    def _fresh(self) -> None:
        self.number = Numbered()
        self.evidence = np.zeros((0, len(self.langs)), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("number", "evidence")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._fresh()

    def _popcounts(self, words: list[str], n: int) -> np.ndarray:
        """Corrected popcounts of each word's n-grams for each profile, shape (words, profiles).

        An n-gram counts the less the more profiles contain it.
        """
        grams = [[w] if n == 0 else _grams(w, n) for w in words]
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        flat = [g for gs in grams for g in gs]
        hits = np.zeros((len(words), len(self.profiles)))
        if flat:
            masks = np.bitwise_and.reduce(self.tables[n][_slots(flat, len(self.tables[n]))], axis=1)
            bits = ((masks[:, :, None] >> np.arange(32, dtype=np.uint32)) & 1).reshape(len(flat), -1)[:, : len(self.profiles)].astype(float)
            rarity = np.log2((len(self.profiles) + 1) / np.maximum(1, bits.sum(axis=1)))
            np.add.at(hits, np.repeat(np.arange(len(words)), sizes), bits * rarity[:, None])
        chance = self.by_chance[n]
        expected = sizes[:, None] * chance * np.log2(len(self.profiles) + 1)
        return np.clip((hits - expected) / (1 - chance), 0, None) / np.maximum(1, sizes)[:, None]

    def word_evidence(self, words: list[str]) -> np.ndarray:
        """What words say about each language: shares of one vote per word.

        A word votes by its weighted corrected popcounts; SHARPNESS makes clear words clearer, so
        that no single word outvotes the others.
        """
        known = self._popcounts(words, 0)
        total = WORD_WEIGHT * known
        for n, weight in WEIGHTS.items():
            total += weight * self._popcounts(words, n)
        out = np.zeros((len(words), len(self.langs)))
        for p, lang in enumerate(self.lang_of):
            out[:, lang] = np.maximum(out[:, lang], total[:, p])
        out = out**SHARPNESS
        out[np.array([len(w) <= SHORT_WORD for w in words], bool) & (known.max(axis=1, initial=0) <= 0)] = 0
        return out / np.maximum(out.sum(axis=1, keepdims=True), BACKGROUND)

    def codes(self, bags: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers in ``evidence`` of all words of all bags, words of each bag)."""
        if len(self.number) > CACHE_WORDS:
            self._fresh()
        sizes = np.fromiter(map(len, bags), np.int64, len(bags))
        number = self.number.__getitem__
        codes = np.fromiter((number(w) for b in bags for w in b), np.int64, int(sizes.sum()))
        new = self.number.order[len(self.evidence) :]
        if new:
            self.evidence = np.concatenate([self.evidence, self.word_evidence([w.decode() for w in new]).astype(np.float32)])
        return codes, sizes

    def sums(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Evidence summed over the words of each bag."""
        out = np.zeros((len(sizes), len(self.langs)))
        some = np.flatnonzero(sizes)
        if len(some):
            out[some] = np.add.reduceat(self.evidence[codes], (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.float64)
        return out

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number or -1, confidence, words) of each text."""
        codes, sizes = self.codes([words_of(t) for t in texts])
        return (*self.decide(self.sums(codes, sizes), sizes), sizes)

    def decide(self, sums: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language of summed evidence (ties: first by code), and its confidence between 0 and 1.

        Confidence is the margin over the second, as a share of the best.
        """
        order = np.argsort(-sums, axis=1, kind="stable")
        best = order[:, 0]
        rows = np.arange(len(sums))
        top = sums[rows, best]
        second = sums[rows, order[:, 1]] if sums.shape[1] > 1 else np.zeros(len(sums))
        known = (sizes > 0) & (top >= MIN_EVIDENCE)
        confidence = np.where(known, (top - second) / np.maximum(top, 1e-9), 0.0)
        return np.where(known, best, -1), confidence


#: Second codes and second names that the locale data of a JVM do not have.
MORE_NAMES = {"ger": "de", "fre": "fr", "dut": "nl", "gre": "el", "cze": "cs", "rum": "ro", "chi": "zh", "per": "fa", "may": "ms", "slo": "sk", "castellano": "es", "castilian": "es", "esp": "es"}


def spellings(spark: SparkSession, langs: Sequence[str]) -> dict[str, str]:
    """Lower-case names and codes of ``langs`` (two-letter codes), each with its code.

    They are the codes of two and three letters and the names that the driver's JVM has for each
    language in each of ``langs`` and in the larger languages, with and without accents.
    """
    locale = spark.sparkContext._jvm.java.util.Locale
    out = {}
    for lang in langs:
        own = locale.forLanguageTag(lang)
        names = {lang, own.getISO3Language(), *(own.getDisplayLanguage(locale.forLanguageTag(x)) for x in {*langs, "en", "es", "fr", "de", "pt", "it", "ru", "ja", "zh", "ar", "hi", "tr", "nl", "pl"})}
        names |= {k for k, v in MORE_NAMES.items() if v == lang}
        for name in map(str.lower, names):
            for spelled in (name, "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c))):
                out.setdefault(unicodedata.normalize("NFC", spelled), lang)
    return out


#: Evidence by which a cue's language must exceed that of its document, as a share of its own.
FOREIGN_MARGIN = 0.4
SLICE = 2_000


def label_code(label: Column, names: dict[str, str]) -> Column:
    """Language code a label names; null if it is missing or is none of ``names`` (see :func:`spellings`).

    Case, outer blanks and whatever follows the first part (region, script, variant) do not matter.
    """
    pairs = [F.lit(x) for spelling, code in names.items() for x in (spelling, code)]
    return F.try_element_at(F.create_map(*pairs), F.regexp_extract(F.lower(F.trim(label)), r"^[^\s_\-./(,;]+", 0))


def bounded(samples: DataFrame, keys: list[str], most: int) -> list:
    """Rows (keys, texts) of the distinct texts of each key; of more than ``most``, ``most`` by hash.

    What is too much is dropped before anything is gathered: a text stays if its hash is below the
    share that its key may keep.
    """
    rows = samples.select(*keys, "text").dropna().distinct()
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    share = F.xxhash64("text") / F.lit(2.0**64) + 0.5
    kept = rows.join(sizes, keys).filter(share * F.col("n") < most)
    texts = kept.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list("text")), 1, 2 * most).alias("texts"))
    return sorted(texts.collect(), key=lambda r: tuple(r[k] for k in keys))


def fit(samples: DataFrame) -> LanguageFilter:
    """Fits the filters on labelled samples (lang, text), about MAX_SAMPLES of each label at most."""
    return LanguageFilter([(r["lang"], t) for r in bounded(samples, ["lang"], MAX_SAMPLES) for t in r["texts"]])


def judged(df: DataFrame, ids: list[str], text_col: str, languages: LanguageFilter, markup: bool = False) -> DataFrame:
    """The id columns with ``lang``, ``confidence`` and ``evidence`` (array, one per language) of each text.

    One Arrow-batched pass, no shuffle. ``markup`` texts are judged by their live prose, others in
    one form of look-alike characters. Null, empty and wordless texts have a null language and
    confidence 0. Whole texts are read whatever their length.
    """
    schema = T.StructType([*(df.schema[c] for c in ids), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.FloatType()))])
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((languages, None if markup else forms(spark)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, looks = shared.value
        prepare = live_prose if markup else looks.canonical
        names = pa.array(own.langs)
        width = len(own.langs)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                codes, sizes = own.codes([words_of(prepare(t) or "") for t in part.column(len(ids)).to_pylist()])
                sums = own.sums(codes, sizes)
                best, confidence = own.decide(sums, sizes)
                lang = names.take(pa.array(best, mask=best < 0))
                evidence = pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(best) + 1, width, dtype=np.int32)), pa.array(sums.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(ids)], lang, pa.array(confidence), evidence], names=schema.fieldNames())

    return df.select(*ids, text_col).mapInArrow(run, schema)


def cue_languages(cues: DataFrame, languages: LanguageFilter) -> tuple[DataFrame, DataFrame]:
    """(cues with a language, caption documents).

    The first is (caption_id, cue_idx, lang, confidence, evidence), one row for each cue: if rows of
    one cue differ in text, the first by language, confidence and evidence; the
    second (caption_id, lang, confidence): the language of most of its cues (ties: more evidence,
    then first by code), confidence being the share of cues that have it. Both leave out what has
    no words. Votes are counted per language before the shuffle, so that a document's cues never
    gather in one task. The judged cues, a few bytes each, are kept in the shared folder.
    """
    some = cues.filter("caption_id IS NOT NULL AND cue_idx IS NOT NULL AND text IS NOT NULL AND text != ''")
    one = judged(some, ["caption_id", "cue_idx"], "text", languages).filter("lang IS NOT NULL")
    wide = int(cues.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.row_number().over(W.Window.partitionBy("caption_id", "cue_idx").orderBy("lang", "confidence", "evidence"))
    one = materialize(one.repartition(wide, "caption_id", "cue_idx").withColumn("n", first).filter("n = 1").drop("n"))
    votes = one.groupBy("caption_id", "lang").agg(F.count("*").alias("n"), F.sum("confidence").alias("sure"))
    docs = votes.groupBy("caption_id").agg(F.min(F.struct(F.negative("n").alias("n"), F.negative(F.round("sure", 6)).alias("sure"), F.col("lang").alias("lang"))).alias("best"), F.sum("n").alias("cues"))
    return one, docs.select("caption_id", "best.lang", (F.negative("best.n") / F.col("cues")).alias("confidence"))


def foreign_cues(one: DataFrame, docs: DataFrame, languages: LanguageFilter) -> DataFrame:
    """(caption_id, cue_idx, lang, confidence): cues clearly of another language than their document.

    Confidence is the share of the cue's evidence by which it exceeds that for the document's
    language; cues below FOREIGN_MARGIN, such as those with a borrowed word, are left out.
    """
    at = lambda lang: F.get("evidence", F.array_position(F.array(*map(F.lit, languages.langs)), lang).cast("int") - 1)
    both = one.join(docs.select("caption_id", F.col("lang").alias("main")), "caption_id").filter("lang != main")
    return both.withColumn("margin", 1 - at(F.col("main")) / at(F.col("lang"))).filter(F.col("margin") >= FOREIGN_MARGIN).select("caption_id", "cue_idx", "lang", F.col("margin").cast("double").alias("confidence"))
