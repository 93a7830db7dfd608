"""Text decoded with the wrong character encoding: find the fields, restore the original.

Every distinct word of the corpus that reads as clean text is garbled under all
encoding chains (written in one encoding, read in another, up to three times over).
The garbled forms are joined by hash with the words that occur; a hit says that the
word is the garbled form of a word the corpus knows.  Words whose bytes decode strictly
to plausible text are taken as further originals, so a garbled word whose clean
spelling never occurs takes part in the same join.  Only distinct words are garbled
and joined; the fields meet nothing but the short list of garbled words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.spam_features import FUNCTION_WORDS
from sitelens.operators.skew import salted_join
from sitelens.session import materialize

SINGLE = ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "iso8859_15")
MULTI = ("utf_8", "cp932", "euc_jp")
READ_MULTI = ("utf_8", "gbk", "cp932")
#: Chains of more than one wrong reading.
REPEATED = tuple(
    tuple(("utf_8", r) for r in rs)
    for rs in (("cp1252", "cp1252"), ("latin_1", "latin_1"), ("latin_1", "cp1252"), ("cp1252", "latin_1"), ("cp1252", "cp1252", "cp1252"), ("latin_1", "latin_1", "latin_1"))
)
CHAINS = tuple(((t, r),) for t in (*MULTI, *SINGLE) for r in (*SINGLE, *READ_MULTI) if t != r) + REPEATED
#: What separates words: ASCII that is no letter, and invisible or wide white space.
_SEPARATORS = "[\\u0000-\\u0040\\u005B-\\u0060\\u007B-\\u007F\\u00A0\\u2000-\\u200D\\u202F\\u205F\\u2060\\u3000\\uFEFF]+"
_SPLIT = re.compile(_SEPARATORS.encode().decode("unicode_escape"))
#: Pieces of one character that only a wrong reading of UTF-8 leaves alone between spaces.
_LEAD_MARKS = frozenset("ÃÂ├┬√")
#: Where the letters don't tell which of two words is the garbled one, the clean one must stand in so many times as many distinct texts.
DOMINANCE = 2.0
#: Log-likelihoods: the difference from which letters decide, what a capital after a small letter costs, and what a symbol inside a word.
MARGIN, CAMEL, SYMBOL = 4.0, 4.0, 4.0
#: What the ratio of distinct texts adds to the letters, for each power of e and at the most.
SWAY, SWAY_MOST = 2.0, 6.0
#: Weight of a function word in the letter model, and of single letters against pairs.
_SEED, _BACKOFF = 3.0, 5.0
#: Characters that may stand in a same-length form: the letter model needs no others.
_NARROW = r"^[\u0021-\u25FF]+$"


@lru_cache(maxsize=None)
def _table(enc: str) -> tuple[str, dict[str, int]]:
    """Characters of the 256 bytes; bytes the standard leaves open read as control characters, as browsers do."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(enc))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return "".join(chars), {c: b for b, c in reversed(list(enumerate(chars)))}


def encode(text: str, enc: str) -> bytes | None:
    if enc in SINGLE:
        to = _table(enc)[1]
        try:
            return bytes([to[c] for c in text])
        except KeyError:
            return None
    try:
        return text.encode(enc)
    except UnicodeEncodeError:
        return None


def decode(data: bytes, enc: str) -> str:
    if enc in SINGLE:
        chars = _table(enc)[0]
        return "".join([chars[b] for b in data])
    return data.decode(enc, "replace")


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text after each (written, read) step; null where a step can't write it."""
    for written, read in chain:
        data = encode(text, written)
        if data is None:
            return None
        text = decode(data, read)
    return text


def fold(text: str) -> str:
    return text.upper().lower()


def pieces(text: str) -> list[str]:
    return [p for p in _SPLIT.split(text) if p and not p.isascii()]


def _script(ch: str) -> str:
    if ch.isascii():
        return "latin" if ch.isalpha() else ""
    if not ch.isalpha():
        return ""
    name = unicodedata.name(ch, "")
    if name.startswith("LATIN"):
        return "latin"
    if name.startswith("CYRILLIC"):
        return "cyrillic"
    if name.startswith(("CJK", "HIRAGANA", "KATAKANA")):
        return "japanese"
    return name.split(" ")[0]


def plausible(text: str, alphabet: set[str]) -> bool:
    """Whether a decoded word could stand in the corpus: known characters of one script."""
    odd = [c for c in text if not c.isascii()]
    return bool(odd) and all(c in alphabet for c in odd) and len({_script(c) for c in text} - {""}) <= 1


def undo(word: str, alphabet: set[str]) -> str | None:
    """The plausible original of a word whose bytes decode strictly as a multi-byte encoding."""
    for read in SINGLE:
        now, best = word, None
        for _ in range(3):
            data = encode(now, read)
            if data is None:
                break
            try:
                now = data.decode("utf_8")
            except UnicodeDecodeError:
                break
            if now.isascii():
                break
            if plausible(now, alphabet):
                best = now
        if best:
            return best
    if len(word) >= 4:
        for read in ("latin_1", "cp1252", "mac_roman", "cp437", "cp850"):
            data = encode(word, read)
            for written in ("cp932", "euc_jp"):
                for cut in (0, 1):
                    try:
                        now = data[: len(data) - cut].decode(written) if data else ""
                    except UnicodeDecodeError:
                        continue
                    if sum(_script(c) == "japanese" for c in now) >= 2 and plausible(now, alphabet):
                        return now
    return None


def _is_clean(word: str) -> bool:
    return "\ufffd" not in word and not any("\x80" <= c <= "\x9f" for c in word)


def forms_of(word: str) -> dict[str, tuple[str, int, bool, bool]]:
    """Folded garbled pieces of a word: piece -> (garbled spelling, chain number, multi-byte, whole)."""
    out: dict[str, tuple[str, int, bool, bool]] = {}
    for w in dict.fromkeys((word, word.lower(), word.upper(), word.capitalize())):
        for i, chain in enumerate(CHAINS):
            g = garble(w, chain)
            if g is None or g == w or g.isascii():
                continue
            multi = chain[0][0] in MULTI or chain[-1][1] in READ_MULTI
            parts = pieces(g)
            for p in parts:
                out.setdefault(fold(p), (p, i, multi, len(parts) == 1 and p == g))
    return out


def faults(word: str) -> int:
    """What no well-formed word has: symbols, changes of script, a capital after a small letter."""
    scripts = [x for x in map(_script, word) if x]
    odd = sum(not c.isascii() and not c.isalnum() and unicodedata.category(c) not in ("Mn", "Pd", "Pf", "Pi") for c in word)
    return odd + sum(a != b for a, b in zip(scripts, scripts[1:])) + camels(word)


def camels(word: str) -> int:
    return sum(a.islower() and b.isupper() for a, b in zip(word, word[1:]))


class Letters:
    """Pairs of letters in words: how likely a spelling is.

    Made from distinct words, each counted once, and the function words of the languages, so that copies of a text
    don't move it.
    """

    def __init__(self, pairs: dict[str, float]):
        self.pairs = Counter(pairs)
        for w in (w for ws in FUNCTION_WORDS.values() for w in ws):
            for a, b in zip(" " + w, w + " "):
                self.pairs[a + b] += _SEED
        self.first: Counter[str] = Counter()
        self.second: Counter[str] = Counter()
        for ab, v in self.pairs.items():
            self.first[ab[0]] += v
            self.second[ab[1]] += v
        self.total = sum(self.second.values())

    def score(self, word: str, own: bool = True) -> float:
        """Log-likelihood of a spelling; what the word itself (``own``: one of those counted) adds is left out."""
        w = word.lower()
        ends = list(zip(" " + w, w + " "))
        less = Counter(a + b for a, b in ends) if own else Counter()
        out = -CAMEL * camels(word) - SYMBOL * sum(not c.isascii() and not c.isalpha() for c in word)
        for a, b in ends:
            single = (self.second[b] + 0.1) / (self.total + 100)
            out += math.log((max(0.0, self.pairs[a + b] - less[a + b]) + _BACKOFF * single) / (self.first[a] + _BACKOFF))
        return out


def letters_of(words: DataFrame) -> Letters:
    w = F.concat(F.lit(" "), F.lower("word"), F.lit(" "))
    some = words.where(F.col("word").rlike(_NARROW)).select(w.alias("w"), F.lit(1.0).alias("v"))
    pairs = some.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("ab"), "v")
    # As many rows as the narrow scripts have pairs at the most.
    return Letters({r["ab"]: r["v"] for r in pairs.where(F.length("ab") == 2).groupBy("ab").agg(F.sum("v").alias("v")).collect()})


def _director(letters: Letters):
    """Adds to hits which way they point: positive if the word is the garbled one, negative if the original is (2: clearly), 0 if unknown."""

    def towards(word: str, original: str, chain: int, multi: bool, seen: int, n: int) -> int:
        if not multi:
            often = SWAY * math.log(seen / n) if seen else 0.0
            gain = letters.score(original, seen > 0) - letters.score(word) + max(-SWAY_MOST, min(SWAY_MOST, often))
            return max(-2, min(2, int(gain / MARGIN)))
        written, read = CHAINS[chain][0][0], CHAINS[chain][-1][1]
        if read == "utf_8":
            # Bytes of another encoding are hardly ever well-formed UTF-8: the step was one back.
            return 1 if "\ufffd" in word else -1
        if not seen:
            return 1
        more = faults(word) - faults(original)
        return 1 if more > 0 or (more == 0 and written == "utf_8") else -1 if more < 0 else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield t.assign(way=[towards(*x) for x in zip(t["word"], t["original"], t["chain"], t["multi"], t["n_original"], t["n"])])

    return run


def _former(alphabet: set[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = []
            for word, n in zip(t["word"], t["n"]):
                original = undo(word, alphabet) if _is_clean(word) or "\ufffd" not in word else None
                if original is not None:
                    source, seen = original, 0  # an original that may never occur by itself
                elif _is_clean(word):
                    source, seen = word, int(n)
                else:
                    continue
                for f, (g, chain, multi, whole) in forms_of(source).items():
                    rows.append((f, source, seen, g, chain, multi, whole))
            yield pd.DataFrame(rows, columns=["f", "original", "n_original", "garbled", "chain", "multi", "whole"])

    return run


_FORMS = "f string, original string, n_original bigint, garbled string, chain int, multi boolean, whole boolean"


def _folder(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for t in batches:
        yield pd.DataFrame({"f": [fold(w) for w in t["word"]], "word": t["word"], "n": t["n"], "lost": ["\ufffd" in w for w in t["word"]]})


def fields_of(pages: DataFrame) -> DataFrame:
    """(page_id, field, text) of titles and descriptions with characters outside ASCII."""
    both = pages.where(F.col("id").isNotNull()).select(
        F.col("id").alias("page_id"),
        F.inline(F.array(
            F.struct(F.lit("title").alias("field"), F.col("title").alias("text")),
            F.struct(F.lit("meta_description").alias("field"), F.col("meta_description").alias("text")),
        )),
    )
    return both.where(F.col("text").rlike(r"[^\x00-\x7F]"))


def words_of(text: Column) -> Column:
    """Distinct words with a character outside ASCII."""
    return F.array_distinct(F.filter(F.split(text, _SEPARATORS), lambda w: w.rlike(r"[^\x00-\x7F]")))


def garbled_words(words: DataFrame) -> DataFrame:
    """(word, original, chain) of the distinct words (word, n) that are garbled; original is null where it is lost.

    ``n`` is the number of distinct texts.  Which of two words is the garbled one is told by their letters and their
    shape; only where these don't tell, by the number of texts (``DOMINANCE``).  A form that keeps the number of
    characters (one single-byte encoding for another) counts only if its original has three letters.
    """
    letters = words.select(F.explode(F.split("word", "")).alias("c")).distinct()
    # As many rows as Unicode has characters at the most.
    alphabet = {r["c"] for r in letters.where(F.col("c").rlike(r"[^\x00-\x7F]")).collect()}
    alphabet -= {c for c in alphabet if "\x80" <= c <= "\x9f" or c == "\ufffd"}
    spread = words.repartition(max(8, words.sparkSession.sparkContext.defaultParallelism), "word")
    forms = spread.mapInPandas(_former(alphabet), _FORMS)
    seen = words.mapInPandas(_folder, "f string, word string, n bigint, lost boolean")
    hit = seen.join(forms, "f").where(F.col("word") != F.col("original"))
    odd = F.length(F.regexp_replace("word", r"[\x00-\x7F]", ""))
    hit = hit.where(F.col("multi") | (F.length("original") >= 3) & F.col("whole"))
    columns = "f string, word string, n bigint, lost boolean, " + _FORMS.removeprefix("f string, ") + ", way int"
    hit = materialize(hit.mapInPandas(_director(letters_of(words)), columns), "garbled-hits")
    # A reading whose words mostly point the other way is the way back of another one; a row per chain at the most.
    back = hit.groupBy("chain").agg(F.sum(F.signum("way")).alias("net")).where("net < 0").select("chain", F.lit(True).alias("back"))
    hit = hit.join(F.broadcast(back), "chain", "left").where(F.col("multi") | (F.abs("way") > 1) | F.col("back").isNull())
    often = F.col("n_original") >= DOMINANCE * F.col("n")
    known = (F.col("way") > 0) | (F.col("way") == 0) & (F.col("n_original") >= F.col("n"))
    strong = F.col("multi") & known & ((odd >= 2) | F.col("word").isin("Ã", "Â") | often & F.col("word").isin(*_LEAD_MARKS))
    same = ~F.col("multi") & ((F.col("way") > 0) | (F.col("way") == 0) & often)
    sure = hit.where(strong | same)
    exact = F.col("whole") & (F.col("garbled") == F.col("word"))
    best = sure.groupBy("word").agg(F.max(F.struct(exact.cast("int").alias("e"), "n_original", "original", "chain")).alias("b"))
    found = best.select("word", F.when(F.col("b.e") == 1, F.col("b.original")).alias("original"), F.col("b.chain").alias("chain"))
    lost = seen.where("lost").select("word", F.lit(None).cast("string").alias("original"), F.lit(-1).alias("chain"))
    return found.join(lost.select("word"), "word", "left_anti").unionByName(lost)


def _garbled(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    fields = fields_of(pages)
    tokens = fields.select("text").distinct().select(F.explode(words_of(F.col("text"))).alias("word"))
    words = materialize(tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "distinct-words")
    return fields, materialize(garbled_words(words), "garbled-words")


def garbled_fields(pages: DataFrame) -> DataFrame:
    """(page_id, field), each once: at least one word of the field is garbled.  Null fields are never garbled."""
    fields, bad = _garbled(pages)
    tokens = fields.select("page_id", "field", F.explode(words_of(F.col("text"))).alias("word"))
    return salted_join(tokens, bad.select("word"), ["word"], how="left_semi").select("page_id", "field").distinct()


_RUN = re.compile(r"[\u0080-\U0010ffff]+")


def _read_back(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text before the chain, if the chain leads from it to exactly this text."""
    now = text
    for written, read in reversed(chain):
        data = encode(now, read)
        if data is None:
            return None
        try:
            now = data.decode(written) if written not in SINGLE else decode(data, written)
        except UnicodeDecodeError:
            return None
    return now if garble(now, chain) == text else None


def restore(text: str, known: dict[str, tuple[str | None, int]]) -> str | None:
    """The original of a field, or null where something was lost.

    The whole field is read back through a chain its words name; where only a stretch
    was garbled, its words are replaced and what is left is read back run by run.
    Every replacement garbles back to what stood there, and none may leave a garbled word.
    """
    if "\ufffd" in text:
        return None
    left = lambda t: any(w in known for w in pieces(t))
    sure = [(w, o) for w, (o, _) in known.items() if o is not None]
    chains = [CHAINS[i] for i in sorted({c for _, c in known.values() if c >= 0})]
    # Several encodings give the same form of most words; the reading with the fewest symbols is taken.
    alike = [ch for ch in CHAINS if sure and all(garble(o, ch) == w for w, o in sure)]
    whole = [now for ch in dict.fromkeys(chains + alike) if (now := _read_back(text, ch)) is not None and not left(now)]
    if whole:
        return min(whole, key=lambda t: sum(not c.isascii() and not c.isalnum() for c in t))
    out = text
    for w, (original, _) in sorted(known.items(), key=lambda x: -len(x[0])):
        if original is not None:
            out = out.replace(w, original)
    for chain in chains:
        if left(out):
            out = _RUN.sub(lambda m: _read_back(m.group(), chain) or m.group(), out)
    for w, (original, i) in known.items():
        # White space was tidied after the damage: the no-break space that belonged to the form is a space now.
        spaced = _read_back(w + "\u00a0", CHAINS[i]) if original is None and i >= 0 else None
        if spaced is not None:
            out = re.sub(re.escape(w) + " {1,2}", spaced + " ", out)
    return None if left(out) else out


def _restorer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for t in batches:
        fixed = [restore(x, {w["word"]: (w["original"], w["chain"]) for w in ws}) for x, ws in zip(t["text"], t["found"])]
        yield pd.DataFrame({"page_id": t["page_id"], "field": t["field"], "original": fixed})


def restored_fields(pages: DataFrame) -> DataFrame:
    """(page_id, field, original) of garbled fields, each once; original is null where the text is lost."""
    fields, bad = _garbled(pages)
    tokens = fields.select("page_id", "field", "text", F.explode(words_of(F.col("text"))).alias("word"))
    hits = salted_join(tokens, bad, ["word"])
    one = hits.groupBy("page_id", "field").agg(F.max("text").alias("text"), F.collect_set(F.struct("word", "original", "chain")).alias("found"))
    return one.mapInPandas(_restorer, "page_id string, field string, original string")
