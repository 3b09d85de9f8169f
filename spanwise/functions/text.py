"""Script detection, romanisation and recovery of English words. Built-in expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from spanwise.functions.lexicon import LOANWORDS, NO_ENGLISH

DEVA = "ऀ-ॿ"
ARAB = "؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿"

#: Latin letters of Devanagari signs.
CONSONANTS = dict(
    zip(
        "क ख ग घ ङ च छ ज झ ञ ट ठ ड ढ ण त थ द ध न प फ ब भ म य र ल व श ष स ह".split() + [chr(c) for c in range(0x958, 0x960)],
        "k kh g gh ng ch chh j jh ny t th d dh n t th d dh n p ph b bh m y r l v sh sh s h q kh gh z r rh f y".split(),
        strict=True,
    )
)
VOWELS = dict(zip("अ आ इ ई उ ऊ ऋ ए ऐ ओ औ".split(), "a a i i u u ri e ai o au".split(), strict=True))
SIGNS = dict(zip((chr(c) for c in (0x93E, 0x93F, 0x940, 0x941, 0x942, 0x943, 0x945, 0x946, 0x947, 0x948, 0x949, 0x94A, 0x94B, 0x94C)), "a i i u u ri e e e ai o o o au".split(), strict=True))
NUKTA_BASES = "क ख ग ज ड ढ फ य".split()
#: Latin letters of Arabic ones; a letter of none is dropped.
ARABIC = dict(
    zip(
        "آ ب پ ت ٹ ث ج چ ح خ د ڈ ذ ر ڑ ز ژ س ش ص ض ط ظ ع غ ف ق ک ك گ ل م ن ں و ؤ ہ ھ ه ة ی ي ئ ے".split(),
        "aa b p t t s j ch h kh d d z r r z zh s sh s z t z a gh f q k k g l m n n o o h h h h i i i e".split(),
        strict=True,
    )
)


def _letters(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _spell(text: Column, table: dict[str, str]) -> Column:
    """Each character by its spelling in ``table``; others stay."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(_letters(table), c), c)), "")


def detect_script(text: Column) -> Column:
    """1 for mostly Devanagari (ties included), 2 for mostly Arabic, 0 for neither."""
    d, a = F.regexp_count(text, F.lit(f"[{DEVA}]")), F.regexp_count(text, F.lit(f"[{ARAB}]"))
    return F.when((d == 0) & (a == 0), 0).when(d >= a, 1).otherwise(2)


def route(text: Column, lang: Column) -> Column:
    """The script to romanise by the language's code, else by the text itself."""
    lang = F.coalesce(lang, F.lit(""))
    return F.when(lang.startswith("en"), 0).when(lang.rlike("^(hi|mr|ne)"), 1).when(lang.rlike("^(ur|ar|fa)"), 2).otherwise(detect_script(text))


def devanagari_to_latin(text: Column) -> Column:
    """Spelling by sound: a consonant has an "a" unless a vowel sign, virama, danda or the run's end follows."""
    for base, composed in zip(NUKTA_BASES, map(chr, range(0x958, 0x960)), strict=True):
        text = F.replace(text, F.lit(base + "़"), F.lit(composed))
    text = F.replace(text, F.lit("़"), F.lit(""))
    plain, signs = "".join(CONSONANTS), "".join(SIGNS)
    voiced = F.regexp_replace(text, f"([{plain}])(?=[{DEVA}])(?![{signs}्।॥])", "$1a")
    silent = F.regexp_replace(voiced, "्", "")
    table = {**CONSONANTS, **VOWELS, **SIGNS, "ं": "n", "ँ": "n", "ः": "h", "।": ".", "॥": ".", **{chr(0x966 + i): str(i) for i in range(10)}}
    return F.when(text.rlike(f"[{DEVA}]"), _spell(silent, table)).otherwise(text)


def arabic_to_latin(text: Column) -> Column:
    """Spelling by letter: no short vowels; alef is heard only where a word begins."""
    marks = "ً-ٰٟ-ٴ"
    first = F.regexp_replace(text, f"(^|(?<=[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]))([{marks}]*)ا", "$1$2a")
    digits = F.translate(first, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
    return F.when(text.rlike(f"[{ARAB}]"), F.regexp_replace(_spell(digits, ARABIC), f"[{ARAB}]", "")).otherwise(text)


def to_latin(text: Column, lang: Column) -> Column:
    """Romanised by sound; no dictionary (see :func:`romanise`)."""
    script = route(text, lang)
    return F.when(script == 1, devanagari_to_latin(text)).when(script == 2, arabic_to_latin(text)).otherwise(text)


def length_bucket(n: Column) -> Column:
    return F.when(n < 4, 0).otherwise(F.least(F.lit(4), F.floor((n - 4) / 2))).cast("int")


#: Letter groups that mark a word as borrowed although it ends in a vowel.
CLUSTERS = "st sh ch th nt rt rs ct pt kt gh ph wh ns ry ty ly cy ple tion".split()
#: Romanised words that are never taken for English.
NATIVE = frozenset(
    "nahin nahi hain haan kyun kyon koi kuch kuchh matlab asal achha acha theek sahi galat sath phir abhi aage peeche andar bahar upar niche yaha waha kaha jaha kabhi hamesha "
    "bahut kam zyada thoda poora aadha aaya gaya hua hui hue hoga hogi hoge karo karna karta karti karte kiya diya liya raha rahi rahe reha rehta rehti rehte hota hoti hote tha thi the thay "
    "aap apka apki apke aapko meri mera mere meko hume hamko hamare hamari tera teri tere tumko tumhara tumhari iska iski iske isko usko uska uski uske unka unki unke unko hamara "
    "yaad baat baten baaten log logo logon ismen usmen jismen kismen kyunki isliye islie lekin magar bhi hi toh bas chalo arre shukriya namaste salaam khuda".split()
)


def looks_native(word: Column) -> Column:
    return word.rlike("[aeiou]$") & ~word.rlike("|".join(CLUSTERS))


def letter_overlap(a: Column, b: Column) -> Column:
    """Share of the letters of ``a`` that occur in ``b``."""
    return F.size(F.filter(F.split(a, ""), lambda c: F.contains(b, c))) / F.greatest(F.lit(1), F.length(a))


#: Words in an English list at most, and their length.
ENGLISH_WORDS, LEAST_LETTERS, MOST_LETTERS = 3_000, 4, 16


def english_table(words: DataFrame, most: int = ENGLISH_WORDS) -> DataFrame:
    """(english, first, bucket, rank): the ``most`` commonest of ``words`` (word, n), ties by spelling.

    Words are taken in lower case; those of other letters than a to z, of less than 4 or more than 16
    letters, or that are words of another language too (``NO_ENGLISH``) are left out. Ranks count
    from 0. The result is bounded by ``most``; each task ranks no more than that before they meet.
    """
    w = words.select(F.lower("word").alias("english"), "n").filter(F.col("english").rlike(f"^[a-z]{{{LEAST_LETTERS},{MOST_LETTERS}}}$") & ~F.col("english").isin(*NO_ENGLISH))
    top = w.groupBy("english").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "english").limit(most)
    ranked = top.withColumn("rank", (F.row_number().over(W.Window.orderBy(F.desc("n"), "english")) - 1).cast("int"))
    return ranked.select("english", F.substring("english", 1, 1).alias("first"), length_bucket(F.length("english")).alias("bucket"), "rank")


def word_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """(word, n) of the runs of ASCII letters in texts, in lower case."""
    return texts.select(F.explode(F.split(F.lower(column), "[^a-z]+")).alias("word")).filter("word != ''").groupBy("word").agg(F.count("*").alias("n"))


def loanword_table(spark: SparkSession, pairs: tuple[tuple[str, str], ...] = LOANWORDS) -> DataFrame:
    """(deva, eng) of pairs; a larger table is read instead."""
    return spark.createDataFrame(list(pairs), "deva string, eng string")


def recover_english(words: DataFrame, english: DataFrame) -> DataFrame:
    """(word, english): the nearest English word of each distinct word that may be one.

    Words of five letters or more that neither look native nor are known as such. Candidates share
    the first letter (vowels stand for each other) and nearly the length, which is an equi-join on
    both; the distance is at most 2, or 3 from eight letters on, and 65 % of the letters must occur.
    Ties: first letter, length, rank. ``words`` is made distinct first, so that each is resolved once.
    """
    vowels = "aeiou"
    w = words.select("word").distinct().filter((F.length("word") >= 5) & F.col("word").rlike("^[a-z]") & ~looks_native(F.col("word")) & ~F.col("word").isin(*sorted(NATIVE)))
    first, bucket = F.substring("word", 1, 1), length_bucket(F.length("word"))
    firsts = F.when(first.isin(*vowels), F.array(*map(F.lit, vowels))).otherwise(F.array(first))
    keyed = w.select("word", F.explode(firsts).alias("first"), bucket.alias("b")).select("word", "first", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("bucket"))
    most = F.when(F.length("word") >= 8, 3).otherwise(2)
    pairs = keyed.join(english, ["first", "bucket"]).withColumn("d", F.levenshtein("word", "english", 3))
    close = pairs.filter((F.col("d") >= 0) & (F.col("d") <= most) & (letter_overlap(F.col("word"), F.col("english")) >= 0.65))
    return close.groupBy("word").agg(F.min_by("english", F.struct("d", "first", "bucket", "rank")).alias("english"))


def romanise(texts: DataFrame, english: DataFrame, loanwords: DataFrame | None = None) -> DataFrame:
    """(id, latin) of ``texts`` (id, text, lang), with words resolved.

    A Devanagari run is looked up whole among ``loanwords`` (deva, eng; of repeated keys the first by
    spelling), else its sound is matched with English, else the sound stands. Runs are
    resolved once per distinct run and joined back by run, so hot runs cost one row each. Null texts
    stay null.
    """
    # one row per text and run; a text without a run goes straight on
    routed = texts.withColumn("script", F.when(F.col("text").isNotNull(), route(F.col("text"), F.col("lang"))))
    parts = routed.filter("script = 1").select("id", F.posexplode(F.regexp_extract_all("text", F.lit(f"[{DEVA}]+|[^{DEVA}]+"), F.lit(0))).alias("pos", "run"))
    runs = parts.filter(F.col("run").rlike(f"^[{DEVA}]")).select("run").distinct().withColumn("word", devanagari_to_latin(F.col("run")))
    known = runs.join(recover_english(runs, english), "word", "left")
    if loanwords is not None:
        known = known.join(loanwords.groupBy(F.col("deva").alias("run")).agg(F.min("eng").alias("eng")), "run", "left").withColumn("english", F.coalesce("eng", "english"))
    resolved = known.select("run", F.coalesce("english", "word").alias("latin"))
    back = parts.join(resolved, "run", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("latin", "run").alias("t")))).alias("p"))
    deva = back.select("id", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("latin"))
    rest = routed.filter("script != 1 OR text = ''").select("id", F.when(F.col("script") == 2, arabic_to_latin(F.col("text"))).otherwise(F.col("text")).alias("latin"))
    return deva.unionByName(rest).unionByName(routed.filter("script IS NULL").select("id", F.col("text").alias("latin")))
