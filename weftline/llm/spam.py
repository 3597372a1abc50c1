"""Pages of repeated keywords, links, menu paths and tags instead of sentences.

A text is taken apart at line ends, sentence ends and separators. Each part is
judged by its share of link text, its separators and tags, its share of
function words against the limit of the text's language, and its share of
keyword phrases, which are the word pairs that the text says again and again. Where
a text says whole parts again far more than is usual in its language, or one part
fills most of it, those parts are keywords however many function words they have.
The page is found where such parts hold more than half of its characters. What
share of function words is usual differs by language, so the limits come from
all documents: first every text is measured cheaply, then the limits follow from
the distribution of each language, and every text that is not blank is taken apart.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spread import spread
from ..plans.storage import Scratch

#: The most frequent function words of the languages (fixed values); text in kana has no such words and is judged by its share of Latin letters.
FUNCTION_WORDS = {
    "en": "the of and to a in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our me even most made after also well before must through where why because here your i you'll it's can't don't didn't how should until unless while both each few many same very just too once during between own every still again off",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum kann wenn alle nur ob war haben sein ihre ihr seine oder vor durch man sehr zur mehr doch wir uns unsere ich mich wer was aber bis diese dieser dieses jede jeder jedes keine kein keinen beide können könnte sollen soll wollen will mag darf dürfen sieht nie immer selbst solche einige viele andere alles lassen lässt müssen muss hatten hatte früher heute wurde weil denn damit sobald bevor gegen ohne unter zwischen wieder schon dort hier beim vom ins warum weniger als",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au avec ne se pas plus ce il sont à ou ont aux d l c n s nos vos leur leurs cette ces son sa ses mais comme tout tous elle ils nous vous je on y si sans être avoir fait dès lors depuis alors chaque toute ainsi aussi très bien même entre sous jusqu où dont quand après avant aucun aucune pourquoi parce votre notre peut doit faut",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o pero sus le ya este sí si porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros nuestros nuestra nuestro es son ha han ser era fue cada aquí lea",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha foram essa num nem suas meu às minha têm numa pelos elas havia seja qual será nós lhe deles essas esses pelas este dele apenas cada agora aqui porque",
    "it": "di e il la che in a per un del è non una i le si con da come più della al nel sono alla anche dei ma gli ha lo se ai delle dal ci su o nella questo dalla degli tra loro era essere questa quando sua suo",
    "nl": "de van het een en in is dat op te voor met zijn die niet aan er om ook als door bij naar uit dan nog maar over wordt heeft of we ze dit deze worden tot kan hun meer zo wel geen moet",
}
_SETS = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
_ALL = frozenset().union(*_SETS.values())
_LANGUAGES = {w: tuple(lang for lang, s in _SETS.items() if w in s) for w in _ALL}
#: A part is no sentence below this share of its language's usual share of function words.
LIMIT_SHARE = 0.33
#: The limit of a language with fewer texts than this.
LEAST_TEXTS, DEFAULT_LIMIT = 50, 0.11
#: A Japanese part is keywords from this share of Latin letters on where too few texts tell; else from half way between what is usual and all.
LATIN_HEAVY = 0.55
#: A part with a higher share of function words and no other word as frequent as this is made of sentences, however often it says their phrases.
SURE_SHARE, TOP_WORD = 0.30, 0.075
#: Share of its words in keyword phrases that makes a sentence a dressed-up keyword: with few function words (under FEW), where it says a phrase twice, and in any case.
PHRASES, FEW, PHRASES_TWICE, PHRASES_ANY = 0.3, 0.3, 0.36, 0.5
#: A text repeats its parts where they leave less than this of what the usual text of its language says for the first time; a part fills a text from this share of the characters and so many times on.
NEW_SHARE, FILLS, LEAST_SAID = 0.2, 0.5, 5
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: The same words of a text in plain lower case.
_PLAIN_WORD = re.compile("[a-z]+(?:'[a-z]+)?")
_LINK = re.compile(r"\[[^\]\n]{0,300}\]\([^)\s]{0,2000}\)|<a\b[^>]{0,2000}>[^<\n]{0,500}(?:</a>)?|(?:https?://|www\.)[^\s<>\"')\]]+", re.I)
_TAG = re.compile(r"</?[a-z][^<>\n]{0,300}>|&(?:nbsp|amp|lt|gt|quot);", re.I)
_CUT = re.compile(r"\n+|:\s|(?<=[.!?…])\s+|(?<=[。！？])|\s[|•·/*–—;-]\s|\s*[|•·]\s*|;\s")
#: The same cuts in a text without Japanese full stops, told by the first character.
_QUICK_CUT = re.compile(r"[\s:;|•·](?:(?<=\n)\n*|(?<=:)\s|(?<=[.!?…]\s)\s*|(?<=\s)[|•·/*–—;-]\s|(?<=\s)\s*[|•·]\s*|(?<=[|•·])\s*|(?<=;)\s)")
_KANA = re.compile(r"[぀-ヿ一-鿿]")
_HASH = re.compile(r"#\w+")
_PRODUCT = re.compile(r"\b[A-Z][A-Za-z]{0,4}\.?-\s?\d{2,}\b")
_CELL = re.compile(r"\|\s*[€$£]?\d[\d.,]*\s*(?:[A-Z]{3}|[%€$£])?\s*\|")
_CODE = re.compile(r"[{}\[\]\"=;\\$<>()_]")
_DIGIT = re.compile("[0-9]")
#: A part without any of these is no code; nothing else is looked at then.
_SIGN = re.compile(r"[{}\[\]\"=;\\$<>()_0-9]")


def language(words: list[str]) -> str:
    """The language with most function words in a text, the first of FUNCTION_WORDS on a tie or without any."""
    sample = Counter(words)
    return max(_SETS, key=lambda lang: sum(n for w, n in sample.items() if w in _SETS[lang]))


def measure(text: str) -> tuple[str, float, float, int]:
    """(language or 'kana', share of function words, share of the most frequent other word, words)."""
    words = text.lower().split()
    if not words:
        return "en", 0.0, 0.0, 0
    counts = Counter(words)
    hits = dict.fromkeys(_SETS, 0)
    total, top = 0, 0
    for w, n in counts.items():
        if w in _LANGUAGES:
            total += n
            for lang in _LANGUAGES[w]:
                hits[lang] += n
        elif n > top:
            top = n
    lang = max(hits, key=hits.__getitem__)
    # Japanese stands without spaces: a few characters tell
    if not text.isascii() and len(_KANA.findall(text)) > 0.1 * len(text):
        lang = "kana"
    return lang, total / len(words), top / len(words), len(words)


def _parts(text: str) -> list[str]:
    cut = _CUT if "。" in text or "！" in text or "？" in text else _QUICK_CUT
    return [p for p in cut.split(text) if p and not p.isspace()]


def repeats(text: str) -> float:
    """Share of a text's characters in parts that it said before."""
    total = first = 0
    for part, n in Counter(_parts(text)).items():
        size = len(part.strip())
        first += size
        total += size * n
    return 1 - first / total if total else 0.0


def _words(part: str) -> tuple[str, ...]:
    return tuple(_PLAIN_WORD.findall(part.lower()) if part.isascii() else [w.lower() for w in _WORD.findall(part)])


def _take_lines(text: str) -> tuple[int, int, list[str]]:
    """(characters seen, characters in lines that are certainly no sentences, the other lines): links, menu paths and tags are told by line, as separators stand in them."""
    total = found = 0
    rest = []
    may_link = "](" in text or "<" in text or "://" in text or "www." in text.lower()
    for line in text.split("\n"):
        size = len(line.strip())
        if not size:
            continue
        links = _LINK.findall(line) if may_link else ()
        if links:
            linked = sum(map(len, links))
            for part in re.split(r"(?<=[.!?])\s+(?=[A-Z])", line) if linked < 0.5 * size else [line]:
                n, inside = len(part.strip()), sum(map(len, _LINK.findall(part)))
                if n and inside >= 0.4 * n:
                    total, found = total + n, found + n
                elif n:
                    rest.append(_LINK.sub(" ", part))
            continue
        tags = _HASH.findall(line) if "#" in line else ()
        if len(tags) > 1 and sum(map(len, tags)) > 0.6 * size:
            total, found = total + size, found + size
        else:
            rest.append(line)
    return total, found, rest


def _is_path(line: str, known: frozenset[str]) -> bool:
    """A menu path: steps of a few words each, and no sentence around them."""
    if " > " not in line and " » " not in line and " › " not in line:
        return False
    words = _WORD.findall(line)
    return sum(w.lower() in known for w in words) <= 0.1 * len(words)


def keyword_share(text: str, lang: str = "en", limit: float = DEFAULT_LIMIT, most_said: float = 1 - NEW_SHARE) -> float:
    """Share of a text's characters that stand in keywords, links, paths and tags instead of sentences; 0 for an empty text. A text repeats its parts from a share of most_said in parts said before."""
    known = _SETS.get(lang, _ALL)
    total, found, lines = _take_lines(text)
    held: list[tuple[int, tuple[str, ...]]] = []
    for line in _TAG.sub(" ", "\n".join(lines)).split("\n"):
        size = len(line.strip())
        if not size:
            continue
        if _is_path(line, known):
            total, found = total + size, found + size
        elif _is_code(line) or (line.count("|") > 1 and _CELL.search(line) and not _PRODUCT.search(line)):
            total += size
        else:
            held += [(len(part.strip()), _words(part)) for part in _parts(line)]
    said: dict[tuple[str, ...], list[int]] = {}
    first = 0
    for size, words in held:
        total += size
        once = said.get(words)
        if once:
            once[0] += 1
            once[1] += size
        else:
            said[words] = [1, size]
            first += size
    # keyword phrases: neighbours that are no function words, said in several different parts or again within one
    several = [w for w in said if len(w) > 1]
    pairs = Counter(chain.from_iterable(map(zip, several, [w[1:] for w in several])))
    own = {p for p, n in pairs.items() if n > 1 and p[0] not in known and p[1] not in known}
    parts: Counter = Counter()
    if own:
        for w in several:
            parts.update(own.intersection(zip(w, w[1:])))
    least = max(2 if len(several) < 4 else 3, 0.15 * len(several))
    often = {p for p in own if parts[p] >= least or pairs[p] > parts[p]}
    repeated = sum(size for _, size in said.values()) - first >= most_said * total
    for words, (n, size) in said.items():
        if not words:
            continue
        if n > 1 and (repeated or (n >= LEAST_SAID and size > FILLS * total)) and any(a not in known and b not in known for a, b in zip(words, words[1:])):
            found += size
        elif _is_keywords(words, known, often, limit):
            found += size
    return found / total if total else 0.0


def _is_keywords(words: tuple[str, ...], known: frozenset[str], often: set[tuple[str, str]], limit: float) -> bool:
    """Whether a part is no sentence, or one that dresses up phrases said often."""
    count = len(words)
    function = sum(map(known.__contains__, words)) / count
    if function < limit:
        return True
    covered = [False] * count
    here = [i for i, p in enumerate(zip(words, words[1:])) if p in often] if often else ()
    if not here or (function >= SURE_SHARE and max(Counter(w for w in words if w not in known).values()) < TOP_WORD * count):
        return False
    for i in here:
        covered[i] = covered[i + 1] = True
    phrases = sum(covered) / count
    twice = len(here) > len({words[i : i + 2] for i in here})
    return phrases >= PHRASES_ANY or (twice and phrases >= PHRASES_TWICE) or (phrases >= PHRASES and phrases > function and function < FEW)


def _is_code(part: str) -> bool:
    """Code, records and numbers: signs and digits are dense, and it is no product tag."""
    ascii_ = part.isascii()
    if ascii_ and not _SIGN.search(part):
        return False
    n = len(part.strip())
    signs = len(_CODE.findall(part))
    if signs >= 3 and signs >= 0.08 * n:
        return True
    digits = len(_DIGIT.findall(part)) if ascii_ else sum(map(str.isdigit, part))
    return digits >= 0.3 * n and not _PRODUCT.search(part)


def latin_share(text: str) -> float:
    """Share of a text's characters in words of Latin letters."""
    return sum(len(w) for w in _WORD.findall(text) if w.isascii()) / max(1, len(text.strip()))


def kana_share(text: str, heavy_from: float = LATIN_HEAVY) -> float:
    """As keyword_share for Japanese: parts that are Latin words from a share of heavy_from on, if these are said again or the parts make a list."""
    total, found, lines = _take_lines(text)
    parts = []
    for line in _TAG.sub(" ", "\n".join(lines)).split("\n"):
        if _is_path(line, _ALL):
            total, found = total + len(line.strip()), found + len(line.strip())
        else:
            parts += [(len(p.strip()), _KANA.findall(p), [w.lower() for w in _WORD.findall(p) if w.isascii()]) for p in _parts(line) if not _is_code(p)]
    pairs = Counter(p for _, _, latin in parts for p in zip(latin, latin[1:]))
    heavy = [sum(map(len, latin)) > heavy_from * n and sum(w in _SETS["en"] for w in latin) < 2 * DEFAULT_LIMIT * len(latin) for n, _, latin in parts]
    listed = sum(h and not kana for h, (_, kana, _) in zip(heavy, parts)) >= 4
    for h, (n, kana, latin) in zip(heavy, parts):
        total += n
        if h and ((listed and not kana) or any(pairs[p] > 1 for p in zip(latin, latin[1:]))):
            found += n
    return found / total if total else 0.0


#: No language's limit is above this (its usual share of function words being at most 1), nor its limit of repeated parts, nor of Latin letters, below these: what is not found under them is never found.
MOST_LIMIT, LEAST_REPEATED, LEAST_HEAVY = LIMIT_SHARE, 1 - NEW_SHARE, 0.5


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each text adds to the limits, and, of texts that may be found under some limits, the text itself."""
    for b in batches:
        keep, langs, shares, sizes, again, texts = [], [], [], [], [], []
        for i, t in enumerate(b.column(1).to_pylist()):
            if not t or t.isspace():
                continue
            lang, share, _, words = measure(t)
            if lang == "kana":
                # no spaces part its words, so characters are counted and Latin letters told
                share, words, most = latin_share(t), len(t), kana_share(t, LEAST_HEAVY)
            else:
                most = keyword_share(t, lang, MOST_LIMIT, LEAST_REPEATED)
            keep.append(i)
            langs.append(lang)
            shares.append(share)
            sizes.append(words)
            again.append(repeats(t))
            texts.append(t if most > 0.5 else None)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(sizes, pa.int64()), pa.array(again, pa.float64()), pa.array(texts, pa.string())], ["key", "lang", "share", "words", "again", "text"])


def keyword_pages(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang, share) of the documents more than half of whose characters are keywords, links, menu paths or tags.

    share is that part of the text. Null, empty and white-space texts are never
    found. A row delivered twice is judged twice. Other columns are not read. An empty table gives no
    rows. Each language's limit is LIMIT_SHARE times the median share of
    function words of its texts of 20 words and more, over all documents, and so is the
    limit of repeated parts from their median share; that of Japanese is half
    way between the median share of Latin letters and all. At most two numbers per
    language of FUNCTION_WORDS is brought to the driver. Every text is judged
    under the widest limits there can be; the ones found then, which are
    written down, are judged again under their language's.
    """
    one = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")), documents)
    numbers = [T.StructField(c, T.DoubleType() if c in ("share", "again") else T.LongType() if c == "words" else T.StringType()) for c in ("lang", "share", "words", "again", "text")]
    measured = Scratch(documents.sparkSession, "spam").keep(one.mapInArrow(_measure, T.StructType([one.schema["key"], *numbers])))
    usual = measured.where(F.col("words") >= 20).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("share", 0.5, 1000).alias("m"), F.percentile_approx("again", 0.5, 1000).alias("again")).collect()
    limits = {r["lang"]: (max(0.08, LIMIT_SHARE * r["m"]), 1 - NEW_SHARE * (1 - r["again"])) for r in usual if r["n"] >= LEAST_TEXTS}
    heavy = next(((1 + r["m"]) / 2 for r in usual if r["lang"] == "kana" and r["n"] >= LEAST_TEXTS), LATIN_HEAVY)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, shares = [], []
            for i, (lang, t) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                share = kana_share(t, heavy) if lang == "kana" else keyword_share(t, lang, *limits.get(lang, (DEFAULT_LIMIT,)))
                if share > 0.5:
                    keep.append(i)
                    shares.append(share)
            rows = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(shares, pa.float64())], ["key", "lang", "share"])

    schema = T.StructType([one.schema["key"], T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])
    may = measured.where(F.col("text").isNotNull()).select("key", "lang", "text")
    return may.mapInArrow(judge, schema).withColumnRenamed("key", key)
