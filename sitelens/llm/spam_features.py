"""Densities, entropy, repetition and function words of a text, as column expressions.

Nothing here looks at what a line is for: every feature is a share or a count per
word that is defined alike for prose, lists, logs and spam.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of the languages of the corpus.
FUNCTION_WORDS = {
    "en": "the a an and or of to in on for with is are was were be been it that this these which by from at as not we you they he she its our your their after before about than then so but has have had will would can could should only if when there no more each any into over until because nobody who what why how do does did both without between against while above below".split(),
    "de": "der die das und oder von vom zu zum zur in im am an auf für mit ist sind war wird werden wurde ein eine einen einem einer eines des dem den nicht als auch bei nach vor über durch aus wie wenn dass es sie wir ich ihr sich noch nur bis denn damit ohne weil man seit um kein keine hat haben jede jeder mehr davon dies diese dieser".split(),
    "fr": "le la les l un une des de du d et ou à au aux en dans pour par sur avec est sont a ont il elle ils nous vous on ne pas que qu qui ce cette ces se s son sa ses leur plus sans dont y mais car si n c été avant après entre chez nos votre notre".split(),
    "es": "el la los las un una unos de del y o a al en para por con es son fue ha han no que se su sus lo le como más sin sobre este esta entre desde hasta ya pero si cuando muy también hay nos todo según cada tras".split(),
    "pt": "o a os as um uma de do da dos das e ou em no na nos nas para por com é são foi não que se seu sua ao à mais sem sobre este esta entre desde até já mas quando também há como pelo pela cada após".split(),
    "pl": "i w we z ze na do od o po za przed dla bez oraz lub a ale nie jest są był była być się to że który która które jak już jego ich tylko przy nad pod przez także każdy po też ma".split(),
    "ru": "и в во с со на до от о об по за для без из к ко у не ни но а или что как это этот эта его её их был была есть уже только при над под через также каждый мы вы он она они если чтобы где после перед".split(),
    "ja": "の は が を に で と も へ から まで より や です ます した して する には では とは ので など".split(),
}
LANGUAGES = tuple(FUNCTION_WORDS)

#: name of a feature: least standard deviation that counts as a difference.
FEATURES = {
    "function": 0.04,  # function words of the language, per word
    "entropy": 0.05,  # entropy of the words, per its largest value
    "repeat": 0.12,  # word pairs that occur three times or more, per pair
    "top": 0.025,  # further occurrences of the most frequent content word, per word
    "dry": 0.15,  # words in stretches of DRY words or more without a function word, per word
    "stops": 0.015,  # ends of sentences, per word
    "breaks": 0.06,  # separators of lists, per word
    "keyed": 0.03,  # colons and equals signs, per word
    "digits": 0.04,  # digits, per character
    "link": 0.15,  # characters of links, per character
    "tag": 0.05,  # characters of tags, per character
}
#: Fewest words of a stretch without function words; words that a link and a tag count for.
DRY, LINK_WORDS, TAG_WORDS = 6, 4, 2

_HIDDEN = "[\\u00AD\\u200B-\\u200F\\u2060\\uFEFF]++"
_LINK = (
    r"\[[^\[\]\n]*+\]\([^()\n]*+\)|<a\s[^<>]*+>[^<]*+</a>|\[url=[^\[\]]*+\][^\[\]]*+\[/url\]"
    r"|(?:https?://|www\.)[^\s<>\[\]()\"']++"
)
_TAG = r"#[\p{L}\p{N}_]{2,}+"
_MARKUP = r"</?[a-z][^<>]*+>"
_KANA_HAN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
_SCRIPTS = rf"[\p{{IsHan}}々]++|\p{{IsHiragana}}++|[\p{{IsKatakana}}ー]++|(?:(?!{_KANA_HAN})[\p{{L}}\p{{N}}\p{{M}}])++"
_KEY = "[:=]"
_STOP = r"[.!?…]++(?=\s|$)|[。！？]"
_SEPARATOR = r"[,;|·•»>~/、，；｜*\n\t]++"
_DASH = " [-–—]++ "
#: Marks that stand for a link and a tag while words are counted.
_LINK_MARK, _TAG_MARK = "\x01", "\x02"

c = F.col


def _chars(text: Column, pattern: str) -> Column:
    """Characters that the pattern covers."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def _if_any(text: Column, parts: tuple[str, ...], changed: Column) -> Column:
    """``changed`` where one of the parts occurs; a search for them costs less than the pattern."""
    some = F.lit(False)
    for p in parts:
        some = some | F.contains(text, F.lit(p))
    return F.when(some, changed).otherwise(text)


def _per(n: Column, of: Column) -> Column:
    return n.cast("double") / F.greatest(of, F.lit(1))


def _runs(ordered: Column, size: Column) -> Column:
    """Ends of the runs of equal values in an ordered array, counted from 1."""
    return F.when(size < 1, F.array().cast("array<int>")).otherwise(
        F.filter(F.sequence(F.lit(1), size), lambda i: (i == size) | (F.get(ordered, i) != F.get(ordered, i - 1)))
    )


def _lengths(ends: Column) -> Column:
    return F.transform(ends, lambda e, i: e - F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1)))


def _own(language: Column, word: Column) -> Column:
    """Whether the word is a function word of the language; of any language where it is unknown."""
    out = None
    for lg, words in FUNCTION_WORDS.items():
        hit = word.isin(*words)
        out = F.when(language == lg, hit) if out is None else out.when(language == lg, hit)
    return out.otherwise(word.isin(*sorted({w for ws in FUNCTION_WORDS.values() for w in ws})))


def _hits(words: Column, own: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*own)))


def _guess(words: Column) -> Column:
    """The language whose function words the text has most of; ties go to the first listed; ``und`` without any."""
    hits = [_hits(words, own) for own in FUNCTION_WORDS.values()]
    best = F.array_max(F.array(*[F.struct(h.alias("n"), F.lit(-i).alias("i"), F.lit(lg).alias("lg")) for i, (h, lg) in enumerate(zip(hits, LANGUAGES))]))
    return F.when(best["n"] > 0, best["lg"]).otherwise("und")


def measure(documents: DataFrame) -> DataFrame:
    """(doc_id, lg, units, features): the features of every whole text that is not null.

    ``lg`` is the stated language if its form is known, else the guessed one.  ``units``
    is the size in words; a link counts as ``LINK_WORDS``, a tag as ``TAG_WORDS``.
    Words are hashed once; the two lowest bits of a hash tell function words and words
    without content (numbers, single characters).  Every step names an array at least
    twice, so that it is worked out once and not inside the steps that read it.
    """
    t = documents.where(c("text").isNotNull()).select("doc_id", "lang", F.lower("text").alias("t"))
    t = t.withColumn("t", F.when(F.octet_length("t") == F.char_length("t"), c("t")).otherwise(F.regexp_replace("t", _HIDDEN, "")))
    t = t.withColumn("linkless", _if_any(c("t"), ("://", "www.", "](", "<a", "[url="), F.regexp_replace("t", _LINK, f" {_LINK_MARK} ")))
    t = t.withColumn("bare", _if_any(c("linkless"), ("#",), F.regexp_replace("linkless", _TAG, f" {_TAG_MARK} ")))
    n_links, n_tags = (F.char_length("bare") - F.char_length(F.replace("bare", F.lit(m), F.lit(""))) for m in (_LINK_MARK, _TAG_MARK))
    t = t.select(
        "doc_id", "lang", F.char_length("t").alias("all"), F.char_length("linkless").alias("n_linkless"), F.char_length("bare").alias("n_bare"),
        n_links.alias("n_links"), n_tags.alias("n_tags"),
        F.trim(F.regexp_replace("bare", f"[{_LINK_MARK}{_TAG_MARK}]|{_MARKUP}", " ")).alias("t"),
    )
    words = F.when(F.octet_length("t") == F.char_length("t"), F.split("t", "[^a-z0-9]++")).when(
        c("t").rlike(_KANA_HAN), F.regexp_extract_all("t", F.lit(_SCRIPTS), 0)
    ).otherwise(F.split("t", r"[^\p{L}\p{N}\p{M}]++"))
    # What is counted below stands between the letters; it is looked for in what they leave.
    t = t.withColumn("p", F.regexp_replace("t", "[a-z]++", ""))
    t = t.select(
        "doc_id", "lang", (LINK_WORDS * c("n_links") + TAG_WORDS * c("n_tags")).alias("marks"), F.filter(words, lambda w: w != "").alias("w"),
        _per(c("all") - c("n_linkless") + 3 * c("n_links"), c("all")).alias("link"), _per(c("n_linkless") - c("n_bare") + 3 * c("n_tags"), c("all")).alias("tag"),
        _per(_chars(c("p"), "[0-9]++"), c("all")).alias("digits"),
        (_chars(c("p"), _SEPARATOR) + F.regexp_count("p", F.lit(_DASH))).alias("n_breaks"), F.regexp_count("p", F.lit(_STOP)).alias("n_stops"), F.regexp_count("p", F.lit(_KEY)).alias("n_keys"),
    )
    stated = F.split_part(F.replace(F.lower(F.trim("lang")), F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))
    t = t.withColumn("n", F.size("w")).withColumn("units", c("n") + c("marks"))
    t = t.withColumn("lg", F.when(stated.isin(*LANGUAGES), stated).otherwise(_guess(c("w"))))
    marked = lambda w: F.xxhash64(w).bitwiseAND(F.lit(~3)).bitwiseOR(
        F.when(_own(c("lg"), w), F.lit(1)).otherwise(F.lit(0)) + F.when((w < ":") | (F.char_length(w) < 2), F.lit(2)).otherwise(F.lit(0))
    )
    t = t.withColumn("w", F.transform("w", marked))
    is_own = lambda h: h.bitwiseAND(F.lit(1)) == 1
    t = t.withColumn("at", F.when(c("n") == 0, F.array().cast("array<int>")).otherwise(
        F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: is_own(F.get("w", i)))
    ))
    pairs = F.when(c("n") < 2, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.xxhash64(F.get("w", i - 1), F.get("w", i)))
    )
    t = t.withColumns({"sorted": F.sort_array("w"), "pairs": F.sort_array(pairs)})
    t = t.withColumns({"ends": _runs(c("sorted"), F.size("sorted")), "pair_ends": _runs(c("pairs"), F.size("pairs"))})
    t = t.withColumns({"counts": _lengths(c("ends")), "pair_counts": _lengths(c("pair_ends"))})
    n = c("n").cast("double")
    spread = F.aggregate("counts", F.lit(0.0), lambda s, k: s + F.when(k > 1, k * F.ln(k.cast("double"))).otherwise(0.0))
    content = lambda h: h.bitwiseAND(F.lit(3)) == 0
    most = F.array_max(F.zip_with("counts", "ends", lambda k, e: F.when((k > 1) & content(F.get("sorted", e - 1)), k).otherwise(1)))
    gaps = F.zip_with(F.concat(F.array(F.lit(-1)), "at"), F.concat("at", F.array(c("n"))), lambda a, b: b - a - 1)
    dry = F.aggregate(gaps, F.lit(0), lambda s, g: s + F.when(g >= DRY, g).otherwise(0))
    repeated = F.aggregate("pair_counts", F.lit(0), lambda s, k: s + F.when(k >= 3, k).otherwise(0))
    return t.select(
        "doc_id", "lg", "units",
        _per(F.size("at"), c("units")).alias("function"),
        F.when(c("n") > 1, (F.ln(n) - spread / n) / F.ln(n)).otherwise(1.0).alias("entropy"),
        _per(repeated, c("n") - 1).alias("repeat"),
        _per(F.coalesce(most, F.lit(1)) - 1, c("n")).alias("top"),
        _per(dry + c("marks"), c("units")).alias("dry"),
        _per(c("n_stops"), c("units")).alias("stops"),
        _per(c("n_breaks"), c("units")).alias("breaks"),
        _per(c("n_keys"), c("units")).alias("keyed"),
        "digits", "link", "tag",
    )
