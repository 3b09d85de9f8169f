"""Text operators: exactness, round trips, held-out accuracy, odd input."""

from __future__ import annotations

import base64
import json
import pickle
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.llm import bpe, glyphs, langid, packing, queries, readability, tex

DATA = Path("/root/testdata/sf0.01")
TOKENIZERS = Path(bpe.TOKENIZER_DIR)
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
needs_tokenizers = pytest.mark.skipif(not TOKENIZERS.exists(), reason="no tokenizers")


def rows_of(name, *columns):
    import duckdb

    return duckdb.connect().execute(f"SELECT {', '.join(columns)} FROM '{DATA}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def languages():
    return langid.LanguageFilter(rows_of("lang_samples", "lang", "text"))


# languages


@needs_data
def test_languages_held_out():
    samples = rows_of("lang_samples", "lang", "text")
    random.Random(0).shuffle(samples)
    half = langid.LanguageFilter(samples[::2])
    best, confidence, _ = half.judge([t for _, t in samples[1::2]])
    right = sum(half.langs[b] == lang for b, (lang, _) in zip(best, samples[1::2], strict=True))
    assert right >= 0.98 * len(best) and confidence.min() >= 0 and confidence.max() <= 1


@needs_data
def test_filters_have_no_false_negatives(languages):
    """Every n-gram of a language's samples answers with that language's bit."""
    for lang, text in rows_of("lang_samples", "lang", "text")[::7]:
        bit = languages.profiles.index(langid._profile(lang, text))
        for n, table in languages.tables.items():
            grams = [g for w in langid.words_of(text) for g in ([w.decode()] if n == 0 else langid._grams(w.decode(), n))]
            if grams:
                masks = np.bitwise_and.reduce(table[langid._slots(grams, len(table))], axis=1)
                assert ((masks[:, bit // 32] >> (bit % 32)) & 1).all()


def test_sixty_languages():
    """More profiles than a word of a slot has bits: made-up languages of their own syllables."""
    rnd = random.Random(4)
    parts = {f"l{i:02}": ["".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(2)) for _ in range(40)] for i in range(60)}
    text = lambda lang: " ".join("".join(rnd.choices(parts[lang], k=2)) for _ in range(8))
    many = langid.LanguageFilter([(lang, text(lang)) for lang in parts for _ in range(30)])
    assert len(many.profiles) == 60 and many.tables[3].shape[1] == 2
    tests = [(lang, text(lang)) for lang in parts for _ in range(3)]
    best, *_ = pickle.loads(pickle.dumps(many)).judge([t for _, t in tests])
    assert sum(many.langs[b] == lang for b, (lang, _) in zip(best, tests, strict=True)) >= 0.97 * len(tests)
    # filters are sized so that what they do not hold seldom answers
    assert all((rate <= 2 * langid.FALSE_RATE).all() for rate in many.by_chance.values())
    assert langid.slots_for(1000) >= 1000 and langid.slots_for(10**6) > 10**6


def test_samples_are_bounded_before_they_are_gathered(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).unionByName(spark.createDataFrame([("c", "one"), ("c", "one"), (None, "x"), ("d", None)], "lang string, text string"))
    got = {r["lang"]: r["texts"] for r in langid.bounded(df, ["lang"], 500)}
    assert set(got) == {"a", "b", "c"} and got["c"] == ["one"]
    assert all(400 <= len(got[k]) <= 600 and len({t[:6] for t in got[k]}) > 8 for k in "ab")


@needs_data
def test_wordless_texts_have_no_language(languages):
    best, confidence, words = languages.judge(["", "...", "[music]", "1, 2, 3", "♪ ♪", "👩‍💻"])
    assert (best == -1).all() and (confidence == 0).all() and words.sum() == 0
    again = pickle.loads(pickle.dumps(languages))
    assert again.judge(["the camera crew carefully measured"])[0] == languages.judge(["the camera crew carefully measured"])[0]


def test_labels(spark):
    cases = {"en-GB": "en", " pt": "pt", "HI": "hi", "Hindi": "hi", "hi_IN": "hi", "es-419": "es", "fra": "fr", "german": "de", "und": None, "??": None, "": None, None: None, "N/A": None, "auto": None, "en-orig": "en", "it": None}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    names = langid.spellings(spark, ["en", "es", "pt", "fr", "de", "ru", "hi", "ur"])
    got = {r["x"]: r["y"] for r in df.select("x", langid.label_code(F.col("x"), names).alias("y")).collect()}
    assert got == cases
    old = "eng english inglés inglese anglais englisch spa spanish español espanol castellano castilian esp por portuguese português portugues fra fre french français francais deu ger german deutsch rus russian русский hin hindi हिन्दी urd urdu اردو"
    assert not [w for w in old.split() if w not in names]
    assert langid.spellings(spark, ["it", "tr"])["italienisch"] == "it"


@needs_data
def test_cue_languages(spark, languages):
    en, de = "the camera crew carefully measured the last table", "der Besitzer vom Laden öffnete endlich das rote Fahrrad"
    rows = [(1, i, en) for i in range(4)] + [(1, 3, en), (1, 4, de), (1, 5, None), (1, 6, ""), (1, 7, "[music]"), (2, 0, de), (3, 0, "..."), (None, 0, en)]
    one, docs = langid.cue_languages(spark.createDataFrame(rows, "caption_id long, cue_idx int, text string").withColumn("lang", F.lit("clash")), languages)
    assert {(r["caption_id"], r["lang"], r["confidence"]) for r in docs.collect()} == {(1, "en", 0.8), (2, "de", 1.0)}
    assert [(r["caption_id"], r["cue_idx"], r["lang"]) for r in langid.foreign_cues(one, docs, languages).collect()] == [(1, 4, "de")]


@needs_data
def test_videos_have_languages(spark, tmp_path):
    """Of two original documents the surer one decides; translations and videos without captions do not count."""
    en, de = "the camera crew carefully measured the last table", "der Besitzer vom Laden öffnete endlich das rote Fahrrad"
    cues = [(1, 0, en), (2, 0, de), (3, 0, de), (3, 1, de), (3, 2, en), (4, 0, en), (5, 0, "...")]
    docs = [(1, "v", "en", "original"), (2, "v", "de", "translated"), (3, "w", "de", "original"), (4, "w", "en", "original"), (5, "x", "en", "original"), (1, "gone", "en", "original")]
    spark.createDataFrame(cues, "caption_id long, cue_idx int, text string").write.parquet(str(tmp_path / "caption_cues.parquet"))
    spark.createDataFrame(docs, "caption_id long, video_id string, lang string, track string").write.parquet(str(tmp_path / "caption_docs.parquet"))
    spark.createDataFrame([("v", "de"), ("v", "de"), ("w", None), ("x", "en"), (None, "en")], "video_id string, language string").write.parquet(str(tmp_path / "videos.parquet"))
    spark.createDataFrame([], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    (tmp_path / "lang_samples.parquet").symlink_to(DATA / "lang_samples.parquet")
    got = sorted(map(tuple, queries.p1_languages(spark, str(tmp_path)).filter("kind = 'video'").collect()))
    assert got == [("video", "v", "en", 1.0), ("video", "w", "en", 1.0)]


# look-alikes


@pytest.fixture(scope="module")
def looks(spark):
    return pickle.loads(pickle.dumps(glyphs.forms(spark)))


@pytest.mark.parametrize(
    "a, b",
    [("ＯＫ ＯＫ", "OK OK"), ("bіggеr сору", "bigger copy"), ("посcреди", "поссреди"), ("cafe\u0301", "café"), ("бои\u0306", "бой"), ("ﬁn", "fin"), ("a\u00a0b", "a b"), ("\u200eab\u200b", "ab"), ("ab\u00a0", "ab"), ("O\u200dK", "OK"), ("mu\u00adsic", "music"), ("ड\u093c", "ड़"), ("．．．", "..."), ("сору мой", "copy мой"), ("ёлка", "ëлка"), ("", "\u200b")]
    + [("ɑ", "a"), ("ⅰ", "i"), ("Ꭺ", "A"), ("ꓮ", "A"), ("ⲟ", "o"), ("a\U000e0061", "a"), ("\ufff9a", "a"), ("Ⅻ", "XII"), ("ΒΕΤΑ", "BETA"), ("օ", "o"), ("ᗅᗷ", "Aᗷ")],
)
def test_same_look(looks, a, b):
    assert looks.canonical(a) == looks.canonical(b)
    assert looks.canonical(looks.canonical(a)) == looks.canonical(a)


@pytest.mark.parametrize("a, b", [("Ok", "OK"), ("resume", "résumé"), ("a  b", "a b"), ("a!", "a !"), ("👩‍💻", "👩💻"), ("क्\u200dष", "क्ष"), ("آخر", "اخر"), ("x²", "x2"), ("мой", "мои"), ("فارسی\u200cها", "فارسیها")] + [("l", "I"), ("1", "l"), ("0", "O"), ("rn", "m"), ("σου", "οου"), ("ı", "i"), ("œ", "oe"), ("ø", "o"), ("𝐀", "A"), ("“a”", '"a"'), ("🏴\U000e0067\U000e0062\U000e007f", "🏴")])
def test_different_look(looks, a, b):
    assert looks.canonical(a) != looks.canonical(b)


def test_scripts_of_tokens(looks):
    assert looks.token_scripts("copy") >= {"LATIN", "CYRILLIC"} and looks.token_scripts("bigger") == {"LATIN"} and looks.token_scripts("жz") == frozenset()
    assert looks.canonical("сору") == "copy" and looks.canonical("мой сору") == "мой сору" and looks.canonical(None) is None
    assert looks.canonical("нет") == "нет" and looks.canonical("Это тест") == "Это тест" and looks.canonical("ہے اور") == "ہے اور"


def test_look_alike_pairs(spark):
    rows = [(1, 0, "music"), (1, 1, "musiс"), (1, 2, "music"), (1, 2, "music"), (1, 3, "Music"), (1, 4, None), (1, 5, ""), (1, 6, "mu\u200bsic"), (2, 0, "musiс"), (None, 0, "music"), (1, 7, "x" * 100_000), (1, 8, "x" * 99_999 + "х")]
    df = spark.createDataFrame(rows, "caption_id long, cue_idx int, text string").withColumn("form", F.lit("clash"))
    got = sorted(map(tuple, glyphs.look_alikes(df, "caption_id", "cue_idx", "text").collect()))
    assert got == [(1, 0, 1), (1, 0, 6), (1, 1, 2), (1, 1, 6), (1, 2, 6), (1, 7, 8)]
    assert glyphs.look_alikes(df.filter("false"), "caption_id", "cue_idx", "text").collect() == []
    classes = {r["cue_idx"]: r for r in glyphs.look_classes(df, "caption_id", "cue_idx", "text").collect()}
    assert {k: r["links"] for k, r in classes.items()} == {0: 2, 1: 3, 2: 2, 6: 3, 7: 1, 8: 1}
    assert len({classes[k]["class_id"] for k in (0, 1, 2, 6)}) == 1 and classes[7]["class_id"] != classes[0]["class_id"]


def test_a_hot_class_is_counted_not_expanded(spark):
    """Half of 20,000 cues of one form spelled otherwise: rows with link counts, no pairs."""
    df = spark.range(20_000).select(F.lit(1).alias("g"), F.col("id").alias("n"), F.when(F.col("id") % 2 == 0, "music").otherwise("musiс").alias("text"))
    assert glyphs.look_classes(df, "g", "n", "text").groupBy("links").count().collect() == [(10_000, 20_000)]


def test_plain_texts_are_forms(looks):
    import re

    for t in ("abc", " abc", "a b", "", "a\tb", "ab ", "é", "a", "~!", "\n", "a\n"):
        if re.search(glyphs.PLAIN.replace("$", "\\Z"), t):
            assert looks.canonical(t) == t


# token ids


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks((TOKENIZERS / "byte_bpe_50k.tiktoken").read_bytes())


def reference(ranks):
    import public_tokenizers
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: enc.encode_ordinary(t) if t else []


def encoded(enc, texts):
    offsets, ids = enc.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]


@needs_tokenizers
def test_ids_equal_plain_bpe(ranks):
    rnd = random.Random(0)
    bits = [" ", "  ", "\n", "\t", "'s", "'ll", "a", "Zoë", "9", "१२", "\xa0", "　", "\x1c", "_", "!!", "文", "👩‍💻", "<|endoftext|>", "\r\n", "\\cite", "\u0301", "ing", "ation", "x\x00"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 25))) for _ in range(5000)] + [None, "", " ", "\n", "a" * 5000, "=" * 3000, " " * 999, "ab" * 20_000]
    enc, plain = bpe.Encoder(ranks), reference(ranks)
    assert encoded(enc, texts) == [plain(t) for t in texts]
    assert enc.lengths(texts).tolist() == [len(plain(t)) for t in texts]


@needs_tokenizers
@needs_data
def test_ids_round_trip_and_cache_reset(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 2000)
    texts = [t for (t,) in rows_of("documents", "text")][:300]
    enc, plain = bpe.Encoder(ranks), reference(ranks)
    for at in range(0, len(texts), 50):
        got = encoded(enc, texts[at : at + 50])
        assert got == [plain(t) for t in texts[at : at + 50]]
        assert [b"".join(enc.bytes_of[i] for i in ids).decode() for ids in got] == [t or "" for t in texts[at : at + 50]]


@needs_tokenizers
def test_ids_query_shape(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (None, "x"), (1, "Hello world")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    rows = bpe.encode_texts(df, "doc_id", "text", bpe.vocabulary(spark)).collect()
    assert sorted((r["doc_id"] or 0, list(r["ids"])) for r in rows) == [(0, [87]), (1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert base64.b64encode(b"x") and bpe.encode_texts(df.filter("false"), "doc_id", "text", bpe.vocabulary(spark)).collect() == []


# packing


def test_local_search_keeps_items_and_improves():
    rnd = np.random.default_rng(3)
    for capacity, high in ((100, 60), (100, 100), (4096, 2500)):
        sizes = rnd.integers(1, high + 1, 800)
        start = packing.best_fit(sizes, capacity)
        bins = packing.LocalSearch(sizes, capacity, start).run()
        assert sorted(i for b in bins for i in b) == list(range(800))
        fill = np.array([sizes[b].sum() for b in bins])
        assert fill.max() <= capacity and len(bins) <= len(start)
        assert (fill.astype(float) ** 2).sum() >= sum(float(sizes[b].sum()) ** 2 for b in start)


def test_local_search_empties_a_bin():
    # three bins of 6 that only exchanges can turn into two of 9
    sizes = np.array([4, 2, 3, 3, 5, 1])
    bins = packing.LocalSearch(sizes, 9, [[0, 1], [2, 3], [4, 5]]).run()
    assert sorted(int(sizes[b].sum()) for b in bins) == [9, 9]


def test_pack(spark):
    rows = [(1, 25), (2, 4), (3, 6), (4, 10), (5, 0), (6, None), (7, 30), (2, 4)]
    items = spark.createDataFrame(rows, "doc_id long, size long").withColumn("tokenizer", F.lit("t"))
    targets = spark.createDataFrame([(1, "t", 10), (2, "t", 100), (3, "other", 10), (4, "t", 0)], "target_id int, tokenizer string, capacity int")
    out = packing.pack(items, targets, "doc_id", 2).collect()
    assert {r["target_id"] for r in out} == {1, 2}
    for target, capacity in ((1, 10), (2, 100)):
        own = [r for r in out if r["target_id"] == target]
        fill, per = {}, {}
        for r in own:
            fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
            per.setdefault(r["doc_id"], []).append(r["size"])
        assert max(fill.values()) <= capacity
        assert {k: sum(v) for k, v in per.items()} == {1: 25, 2: 8, 3: 6, 4: 10, 5: 0, 6: 0, 7: 30}
        assert sorted(per[1]) == ([5, 10, 10] if target == 1 else [25]) and len(per[7]) == (3 if target == 1 else 1)
    assert packing.pack(items.filter("false"), targets, "doc_id", 2).collect() == []
    assert packing.pack(items, targets.filter("false"), "doc_id", 2).collect() == []


def test_packing_invariants(spark):
    """Whole items once, none over capacity, little unused, one task a block, whatever the input's layout."""
    rnd = random.Random(8)
    rows = [(i, rnd.choice([rnd.randrange(1, 900), rnd.randrange(300, 3000), 700])) for i in range(3000)] + [(1, 700)] * 50
    items = spark.createDataFrame(rows, "doc_id long, size long").withColumn("tokenizer", F.lit("t"))
    targets = spark.createDataFrame([(1, "t", 4096), (2, "t", 8192)], "target_id int, tokenizer string, capacity int")
    out = packing.pack(items.repartition(7), targets, "doc_id", 2)
    assert out.rdd.getNumPartitions() == 4
    got = sorted(map(tuple, out.collect()))
    assert got == sorted(map(tuple, packing.pack(items.orderBy("size").coalesce(1), targets, "doc_id", 2).collect()))
    total = sum(s for _, s in rows)
    for target, capacity in ((1, 4096), (2, 8192)):
        own = [r for r in got if r[0] == target]
        fill = {}
        for r in own:
            fill[r[2]] = fill.get(r[2], 0) + r[6]
        assert max(fill.values()) <= capacity and sorted((r[3], r[6]) for r in own) == sorted(rows)
        assert len(fill) <= 1.01 * (-(-total // capacity)) + 2


def test_next_fit_start_reaches_the_lower_bound():
    rnd = np.random.default_rng(5)
    sizes = rnd.integers(20, 1500, 900)
    bins, room = [], 0
    for i, s in enumerate(sizes):
        if s > room:
            bins.append([])
            room = 4096
        bins[-1].append(i)
        room -= s
    assert len(packing.LocalSearch(sizes, 4096, bins).run()) <= -(-int(sizes.sum()) // 4096) + 1


# reading level

PAPER = r"""\documentclass{article}
\newcommand{\sys}{X}
\begin{document}
\maketitle
\begin{abstract}
We saw the cat. % The incommensurability presupposes
It cost 5\% of \emph{the} sum $x$ here.
\end{abstract}
\section{Very Complicated Heading}
Dogs run to \sys{} home~\cite{a}. The sun is up (see Fig.~\ref{f}).
\iffalse
Disabled passage.
\fi
\begin{table}\begin{tabular}{l} cell \\ \end{tabular}\end{table}
\begin{comment}
Commented out.
\end{comment}
\[ a + b \]
\begin{thebibliography}{1}\bibitem{a} Book.\end{thebibliography}
\end{document}
After the end."""


@pytest.mark.parametrize("breaks", ["\n", "\r\n"])
def test_live_prose(breaks):
    prose = tex.live_prose(PAPER.replace("\n", breaks))
    assert [" ".join(s.split()) for s in tex.sentences(prose)] == ["We saw the cat", "It cost 5% of the sum here", "Dogs run to home", "The sun is up (see Fig. )."]
    assert tex.live_prose(None) == tex.live_prose("") == tex.live_prose(" \n") == ""
    assert tex.live_prose("Plain text.") == "Plain text."
    assert not tex.live_prose("\\begin{document}\\input{a}\n\\input{b}\\end{document}").strip()
    assert tex.live_prose("Good. \\begin{equation} never ends").strip() == "Good."
    section = "\n\\section{S} More."
    for opened in ("\\begin{equation} x", "\\begin{table} x \\emph{y}", "\\begin{comment} x", "\\iffalse x"):
        assert tex.live_prose("Good. " + opened + section).split() == ["Good.", "More."]
        assert tex.live_prose("Good. " + opened + section + opened + section).split() == ["Good.", "More.", "More."]
    # a closed draft may hold headings, an unclosed table does not reach to the next one's end
    assert tex.live_prose("A. \\iffalse x" + section + " \\fi B.").split() == ["A.", "B."]
    assert tex.live_prose("A. \\begin{table} x" + section + "\\begin{table} y \\end{table} B.").split() == ["A.", "More.", "B."]


def test_abbreviations_do_not_end_sentences():
    assert tex.sentences("See Fig. A and Dr. Who, e.g. Here. Then z.B. Das. Done!") == ["See Fig. A and Dr. Who, e.g. Here", "Then z.B. Das", "Done!"]


def test_syllables():
    assert [readability.syllables(w, "en") for w in ("cat", "table", "cake", "moved", "wanted", "area", "the", "idea", "reproducibility")] == [1, 2, 1, 1, 2, 3, 1, 3, 7]
    assert [readability.syllables(w, "de") for w in ("haus", "messung", "wahrscheinlichkeit", "rot")] == [1, 2, 4, 1]
    assert [readability.syllables(w, "fr") for w in ("table", "mer", "reproductibilité")] == [1, 1, 7]
    assert [readability.syllables(w, "es") for w in ("mar", "medida", "mayoría", "ciudad")] == [1, 3, 4, 2]


@needs_data
def test_bands_held_out(languages):
    graded = rows_of("graded_samples", "lang", "band", "text")
    random.Random(1).shuffle(graded)
    grader = pickle.loads(pickle.dumps(readability.Grader(languages, graded[::2])))
    got = grader.judge([t for *_, t in graded[1::2]])
    assert sum(g[0] == b for g, (_, b, _) in zip(got, graded[1::2], strict=True)) >= 0.98 * len(got)
    assert sum(g[1] == lang for g, (lang, _, _) in zip(got, graded[1::2], strict=True)) >= 0.98 * len(got)
    odd = grader.judge([None, "", " ", "\\begin{document}\\input{x}\\end{document}", "1 2 3. 4"])
    assert [o[0] for o in odd] == [None] * 5 and grader.judge([]) == []


# queries


@needs_data
@needs_tokenizers
@pytest.mark.parametrize("name, columns", [("p1_found", ["kind", "item_id", "lang"]), ("p2_found", ["caption_id", "cue_idx_a", "cue_idx_b"]), ("p6_ids", ["doc_id", "ids"]), ("p7_found", ["doc_id"]), ("p8_found", ["doc_id", "band"])])
def test_found_queries(spark, name, columns):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    rows = df.collect()
    assert df.columns == columns
    assert len({json.dumps([r[c] for c in columns], default=str) for r in rows}) == len(rows)


def test_search_leaves_no_improving_move():
    """Ties do not hide a partner, nor do many items in a container, and no move of the kinds is left."""
    ties = [90] + [x for _ in range(24) for x in (85, 10)] + [41, 9]
    bins = [[0]] + [[1 + 2 * k, 2 + 2 * k] for k in range(24)] + [[49, 50]]
    out = packing.LocalSearch(np.array(ties), 100, bins).run()
    assert any(sum(ties[i] for i in b) >= 99 for b in out)
    many = [5] * 18 + [14, 30]
    assert sorted(sum(many[i] for i in b) for b in packing.LocalSearch(np.array(many), 94, [list(range(18)), [18, 19]]).run()) == [40, 94]
    rnd = np.random.default_rng(3)
    for _ in range(30):
        sizes, capacity = rnd.integers(5, 60, 40), 100
        out = packing.LocalSearch(sizes, capacity, packing.best_fit(sizes, capacity)).run()
        assert sorted(i for b in out for i in b) == list(range(40))
        fill = [int(sum(sizes[i] for i in b)) for b in out]
        some = lambda b: [0, *(int(sizes[i]) for i in b), *(int(sizes[p] + sizes[q]) for k, p in enumerate(b) for q in b[k + 1 :])]
        count = lambda b: [0, *(1 for _ in b), *(2 for k, _ in enumerate(b) for _ in b[k + 1 :])]
        assert max(fill) <= capacity
        for x, a in enumerate(out):
            for y, b in enumerate(out):
                for g, n in zip(some(b), count(b), strict=True):
                    for r, m in zip(some(a), count(a), strict=True):
                        if x != y and (n, m) in {(1, 0), (1, 1), (2, 1), (1, 2)} and 0 < g - r <= capacity - fill[x]:
                            assert fill[y] >= fill[x] + g - r


@needs_data
def test_p7_found_packs_every_target(spark, monkeypatch):
    seen = []
    items = spark.createDataFrame([("a", 9000, queries.VOCABULARY), ("b", 5000, queries.VOCABULARY)], "doc_id string, size long, tokenizer string")
    pack = packing.pack
    monkeypatch.setattr(packing, "pack", lambda _, targets, id_col, blocks: seen.append(targets) or pack(items, targets, id_col, blocks))
    assert [r[0] for r in queries.p7_found(spark, str(DATA)).collect()] == ["a"]
    assert {2048, 4096, 8192} <= {r["capacity"] for r in seen[0].collect()}
