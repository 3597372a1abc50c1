"""Mapping freely entered values to a reference list.

An automaton over all canonical names and aliases of a value's scope finds the
names that stand in the value; of overlapping ones the longest, leftmost first,
wins. Values in which no name stands as typed go on to a token-set similarity:
every word of a name must be found in the value, in any order, allowing for
typing errors, endings and abbreviations, and no word of the list may be left
over. Everything else is reported as meaning no entry.

What a typed word may stand for depends on all words of the list, so it is
found once for every distinct typed word, against blocks of the list's words,
and travels with the values. Names are then matched in blocks too; ranks that
do not depend on the blocks decide between them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.skew import lookup_join
from ..plans.storage import Scratch

#: Entries, and words of the list, that are compiled and sent to the executors at a time; a longer list is matched block by block.
BLOCK, WORDS = 50_000, 100_000
#: Least similarity of a value with a name, and of one of its words with a word of the name.
LEAST, LEAST_WORD = 0.72, 0.6
#: Words less similar than the most similar one by more than this are not considered.
MARGIN = 0.04
#: Words that may link the words of a name in another order.
LINKS = frozenset("of for the a an and in on to".split())
#: Words people put around a name that leave its meaning as it is (fixed values).
DRESSING = frozenset("our the my your a an new easy smart ai automated built in add on module tool beta feature features etc v1 v2 v3 tm see docs app software solution option".split())
#: Letters of other scripts and signs that are typed for Latin ones (fixed values).
LOOKALIKES = str.maketrans("аеорсухіјѕԁһӏոսΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορν@$", "aeopcyxijsdhlnuABEZHIKMNOPTYXaopvas")


def fold(value: str) -> str:
    """Words of a value in lower case and plain letters, one space between them; words run together in mixed case are taken apart."""
    s = unicodedata.normalize("NFKC", value).translate(LOOKALIKES)
    s = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", s)
    s = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))
    return " ".join(re.findall(r"[^\W_]+", s))


def stem(word: str) -> str:
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


def distance(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words; most + 1 stands for more than most."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    # what both begin and end with costs nothing
    k, n = 0, min(len(a), len(b))
    while k < n and a[k] == b[k]:
        k += 1
    a, b, n = a[k:], b[k:], n - k
    k = 0
    while k < n and a[-1 - k] == b[-1 - k]:
        k += 1
    if k:
        a, b = a[:-k], b[:-k]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    if len(a) == 1 == len(b) or (len(a) == 2 == len(b) and a[0] == b[1] and a[1] == b[0]):
        return min(1, most + 1)
    if most < 2:
        return most + 1
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        older, old = old, new
    return min(old[-1], most + 1)


def word_similarity(typed: str, word: str) -> tuple[float, bool]:
    """(similarity, whether by abbreviation): 1 for equal words, less for endings, typing errors, abbreviations and left-out vowels, 0 for different words."""
    if typed == word:
        return 1.0, False
    a, b = stem(typed), stem(word)
    if a == b:
        return 0.98, False
    least = min(len(typed), len(word))
    most = 0 if least < 3 else 1 if least < 5 else 2 if least < 9 else 3
    d = min(distance(a, b, most), distance(typed, word, most)) if most else 1
    near = 1 - d / max(len(typed), len(word)) if 0 < d <= most else 0.0
    if 3 <= len(a) < len(b) and a[0] == b[0]:
        bare = b[0] + re.sub("[aeiou]", "", b[1:])
        # cut short, vowels left out, or some of the letters in order
        if b.startswith(a) or a == bare:
            return max(near, 0.9), True
        if len(a) <= 5 and len(b) >= 6 and not re.search("[aeiou]", a[1:]) and re.fullmatch(".*".join(map(re.escape, a)) + ".*", b):
            return max(near, 0.8), True
    return near, False


def letters(word: str) -> int:
    """The set of a word's letters as bits: words within three edits differ in at most three letters either way."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


class Index:
    """Names or words by their letters: which of them are within some edits of a typed one, in a few operations on arrays.

    An edit changes the counts of letters by two at most (a substitution), and
    by no more than one the length; what passes is measured.
    """

    def __init__(self, words: list[str]):
        self.words = words
        self.length = np.array([len(w) for w in words], dtype=np.int32)
        self.counts = np.array([_counts(w) for w in words], dtype=np.int32).reshape(len(words), 64)
        self.first: dict[str, np.ndarray] = {}
        for c in {w[0] for w in words}:
            self.first[c] = np.array([i for i, w in enumerate(words) if w[0] == c])
        #: by the length of what is typed: the words near that length, their counts, and the edits that may be between
        self.near: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def within(self, typed: str, most: Callable[[np.ndarray], np.ndarray], key: int = 0) -> tuple[list[int], list[int]]:
        """(positions, edits at least) of the words that may be within ``most`` (of their positions) edits of ``typed``; most depends on the length of typed and on key only."""
        known = self.near.get((len(typed), key))
        if known is None:
            allowed = most(np.arange(len(self.words)))
            at = np.flatnonzero(np.abs(self.length - len(typed)) <= allowed)
            known = self.near[len(typed), key] = (at, self.counts[at], allowed[at])
        at, counts, allowed = known
        if not at.size:
            return [], []
        edits = (np.abs(counts - np.array(_counts(typed), dtype=np.int32)).sum(axis=1) + 1) // 2
        fits = edits <= allowed
        return at[fits].tolist(), edits[fits].tolist()

    def abbreviated(self, typed: str) -> list[int]:
        """Positions of the longer words that begin like ``typed`` and have all its letters."""
        at = self.first.get(typed[0])
        if at is None:
            return []
        at = at[self.length[at] > len(typed)]
        return at[((self.counts[at] - np.array(_counts(typed), dtype=np.int32)) >= 0).all(axis=1)].tolist()


def _counts(word: str) -> list[int]:
    out = [0] * 64
    for c in word:
        out[ord(c) & 63] += 1
    return out


class Words:
    """A block of the words of the whole list, whatever the scope: which of them a typed word may stand for."""

    def __init__(self, words: Iterable[str]):
        self.index = Index(sorted(words))
        self.stemmed = Index([stem(w) for w in self.index.words])
        self.stems: dict[str, list[str]] = defaultdict(list)
        for w in self.index.words:
            self.stems[stem(w)].append(w)

    def likely(self, typed: str) -> list[tuple[str, float, int]]:
        """(word, similarity, how): how is 2 for the word itself and its other endings, 1 for one that is near, 0 for one that is abbreviated."""
        same = self.stems.get(stem(typed))
        if same:
            return [(w, 1.0 if w == typed else 0.98, 2) for w in same]
        # as many edits as word_similarity allows for words of these lengths, with their endings or without
        def most(at: np.ndarray) -> np.ndarray:
            shorter = np.minimum(self.index.length[at], len(typed))
            return np.select([shorter < 3, shorter < 5, shorter < 9], [0, 1, 2], 3)

        edits: dict[int, int] = {}
        for near in (self.index.within(typed, most), self.stemmed.within(stem(typed), most, len(typed))):
            for i, e in zip(*near):
                edits[i] = min(e, edits.get(i, e))
        for i in self.stemmed.abbreviated(stem(typed)) if len(stem(typed)) >= 3 else ():
            edits[i] = -1
        # the likeliest first, so that most others cannot come near them and need not be measured
        found, top = [], 0.0
        for i, e in sorted(edits.items(), key=lambda x: x[1]):
            w = self.index.words[i]
            if e >= 0 and 1 - e / max(len(typed), len(w)) < max(LEAST_WORD, top - MARGIN):
                continue
            near, cut = word_similarity(typed, w)
            if near >= LEAST_WORD:
                found.append((w, near, 0 if cut else 1))
                top = top if cut else max(top, near)
        return [(w, s, how) for w, s, how in found if not how or s >= top - MARGIN]


def settled(hits: Iterable[tuple[str, float, int]]) -> list[tuple[str, float]]:
    """Of what all blocks of the list's words give for a typed word: the word itself and its other endings if it is on the list, else the nearest ones and those it abbreviates."""
    hits = sorted(set(hits))
    same = [(w, s) for w, s, how in hits if how == 2]
    if same:
        return same
    top = max((s for _, s, how in hits if how), default=0)
    return [(w, s) for w, s, how in hits if not how or s >= top - MARGIN]


def typed_words(folded: str) -> tuple[list[str], list[str]]:
    """(words, neighbours run together) of a folded value: a word split by a stray space may stand as one."""
    typed = [w for w in folded.split() if w not in LINKS]
    return typed, [a + b for a, b in zip(typed, typed[1:])]


class Names:
    """The names of one scope: an automaton over them, and their words."""

    def __init__(self, names: list[tuple[str, str, bool]]):
        """names: (entry, name, whether it is the canonical one); of equal names the canonical one, then the smaller entry, stands."""
        self.entry: dict[str, tuple[bool, str]] = {}
        self.exact = {name for _, name, canonical in names if canonical}
        for entry, name, canonical in names:
            key = fold(name)
            if key and (key not in self.entry or (not canonical, entry) < self.entry[key]):
                self.entry[key] = (not canonical, entry)
        self.automaton = ahocorasick.Automaton()
        self.by_word: dict[str, list[int]] = defaultdict(list)
        self.words: list[tuple[str, ...]] = []
        self.names = list(self.entry)
        for i, key in enumerate(self.names):
            self.automaton.add_word(f" {key} ", key)
            words = tuple(w for w in key.split() if w not in LINKS) or tuple(key.split())
            self.words.append(words)
            for w in set(words):
                self.by_word[w].append(i)
        long = [(key, plain, {stem(w) for w in words}) for key, words in zip(self.names, self.words) if len(plain := "".join(words)) >= 6]
        self.flat = [(key, stems) for key, _, stems in long]
        self.index = Index([plain for _, plain, _ in long])
        if self.names:
            self.automaton.make_automaton()

    def embedded(self, folded: str, near: dict[str, list[tuple[str, float]]]) -> str | None:
        """The longest of the names that stand in the value without overlap, if no other word of the list is left over."""
        if not self.names:
            return None
        text = f" {folded} "
        # a space ends one name and begins the next, so each match gives its last one back
        found, at = [], 0
        while at < len(text):
            match = next(self.automaton.iter_long(text, at), None)
            if match is None:
                break
            end, key = match
            found.append((len(key), -end, key, end))
            at = end
        if not found:
            return None
        _, _, key, end = max(found)
        start = end - len(key) - 1
        rest = (text[:start] + " " + text[end:]).split()
        return key if not any(w not in DRESSING and listed(w, near) for w in rest) else None

    def similar(self, folded: str, near: dict[str, list[tuple[str, float]]]) -> tuple[str, float, int] | None:
        """(name, score, words) of the name most similar to the value as a set of words."""
        typed, joined = typed_words(folded)
        hits: dict[str, list[tuple[float, frozenset[int]]]] = defaultdict(list)
        for i, t in enumerate(typed):
            for w, s in near.get(t, ()):
                hits[w].append((s, frozenset((i,))))
        for i, t in enumerate(joined):
            for w, s in near.get(t, ()):
                hits[w].append((s - 0.05, frozenset((i, i + 1))))
        best: tuple[float, int, str] | None = None
        for i in {i for w in hits for i in self.by_word.get(w, ())}:
            words = self.words[i]
            if not all(w in hits for w in words):
                continue
            score, taken = 0.0, set()
            for w in sorted(words, key=lambda w: -max(hits[w])[0]):
                open_hits = [(s, -len(at), at) for s, at in hits[w] if not at & taken]
                if not open_hits:
                    break
                s, _, at = max(open_hits, key=lambda h: h[:2])
                score += s
                taken |= at
            else:
                left = [typed[k] for k in range(len(typed)) if k not in taken]
                # a word left over that is surely one of the list's makes it another thing
                if any(w not in DRESSING and any(s >= 0.9 for _, s in near.get(w, ())) for w in left):
                    continue
                score /= len(words)
                if best is None or (score, len(words)) > best[:2] or ((score, len(words)) == best[:2] and self.entry[self.names[i]] < self.entry[best[2]]):
                    best = (score, len(words), self.names[i])
        return (best[2], best[0], best[1]) if best and best[0] >= LEAST else None

    def run_together(self, folded: str, near: dict[str, list[tuple[str, float]]]) -> tuple[str, float] | None:
        """A name typed without or with misplaced spaces; a word that is one of the list's must be one of the name's."""
        typed = typed_words(folded)[0]
        typed = [w for w in typed if w not in DRESSING] or typed
        flat = "".join(typed)
        if len(flat) < 6:
            return None
        kept = {stem(w) for w in typed if len(w) > 3 and listed(w, near)}
        hits = []
        for i in self.index.within(flat, lambda at: np.full(len(at), 3))[0]:
            key, words = self.flat[i]
            plain = self.index.words[i]
            most = max(1, min(3, len(plain) // 7))
            if abs(len(plain) - len(flat)) <= most and kept <= words:
                d = distance(flat, plain, most)
                if d <= most:
                    hits.append((d, key))
        if not hits:
            return None
        d, key = min(hits)
        return key, 1 - d / len(flat)

    def match(self, value: str, folded: str, near: dict[str, list[tuple[str, float]]]) -> tuple[str, int, int, float, int, bool]:
        """(entry or '', rank, way, score, words, whether by another name); way 4 is a canonical name byte for byte, 3 a whole name, 2 a name within the value, 1 a similar one, 0 none; rank orders what blocks give for one value."""
        if folded in self.entry:
            way = 4 if value in self.exact else 3
            return self.entry[folded][1], way + 2, way, 1.0, 0, self.entry[folded][0]
        key = self.embedded(folded, near)
        if key:
            return self.entry[key][1], 4, 2, len(key) / max(1, len(folded)), 0, self.entry[key][0]
        found = self.similar(folded, near)
        if found:
            return self.entry[found[0]][1], 3, 1, found[1], found[2], self.entry[found[0]][0]
        flat = self.run_together(folded, near)
        if flat:
            return self.entry[flat[0]][1], 2, 1, flat[1], 0, self.entry[flat[0]][0]
        return "", 0, 0, 0.0, 0, False


def listed(word: str, near: dict[str, list[tuple[str, float]]]) -> bool:
    """Whether a typed word is itself on the list."""
    return any(w == word for w, _ in near.get(word, ()))


_STRINGS = pa.list_(pa.string())
_TYPED = T.StructType([T.StructField("scope", T.StringType()), T.StructField("value", T.StringType()), T.StructField("folded", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        folded = [fold(v) for v in b.column(1).to_pylist()]
        # a word of a hundred letters is near no name's
        words = [sorted({w for ws in typed_words(f) for w in ws if len(w) <= 100}) for f in folded]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(folded, pa.string()), pa.array(words, _STRINGS)], ["scope", "value", "folded", "words"])


def _list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [[w for w in fold(n).split() if w not in LINKS] for n in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(out, _STRINGS)], ["words"])


_HIT = T.StructType([T.StructField("w", T.StringType()), T.StructField("s", T.DoubleType()), T.StructField("how", T.IntegerType())])
_HITS = T.StructType([T.StructField("word", T.StringType()), T.StructField("hits", T.ArrayType(_HIT))])
_HITS_ARROW = pa.list_(pa.struct([("w", pa.string()), ("s", pa.float64()), ("how", pa.int32())]))


def _near(block):
    """What the words of batches may stand for among a block of the list's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(block.value)
        for b in batches:
            out = [[{"w": w, "s": float(s), "how": how} for w, s, how in known.likely(t)] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, _HITS_ARROW)], ["word", "hits"])

    return run


def _matcher(names):
    """Matches Arrow batches of (scope, value, folded, near); names: broadcast (scope, entry, name, canonical). A null scope asks all scopes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scopes: dict[str | None, list[tuple[str, str, bool]]] = defaultdict(list)
        for scope, entry, name, canonical in names.value:
            scopes[None].append((entry, name, canonical))
            if scope is not None:
                scopes[scope].append((entry, name, canonical))
        built: dict[str | None, Names] = {}
        for batch in batches:
            out = []
            for scope, value, folded, near in zip(*(c.to_pylist() for c in batch.columns)):
                if scope not in built:
                    built[scope] = Names(scopes.get(scope, []))
                known = {n["word"]: settled((h["w"], h["s"], h["how"]) for h in n["hits"]) for n in near or ()}
                out.append(built[scope].match(value, folded, known))
            cols = list(zip(*out)) if out else [()] * 6
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds))], _MATCHED.names)

    return run


_MATCHED = T.StructType([
    T.StructField("scope", T.StringType()), T.StructField("value", T.StringType()), T.StructField("entry", T.StringType()), T.StructField("rank", T.IntegerType()),
    T.StructField("way", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("words", T.IntegerType()), T.StructField("other", T.BooleanType()),
])


def _blocks(rows: DataFrame, key: str, size: int) -> list[DataFrame]:
    """Rows split by the hash of a key into blocks of about ``size`` keys."""
    n = max(1, -(-rows.select(key).distinct().count() // size))
    return [rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def match_values(values: DataFrame, names: DataFrame, block: int = BLOCK, words: int = WORDS) -> DataFrame:
    """(scope, value, entry, way, score) of each distinct (scope, value) of ``values``.

    ``names`` has scope, entry, name, canonical (boolean); a value is held
    against the names of its scope, with a null scope against all. entry is the
    empty string where the value means none. way says how it was found: 4 the
    canonical name byte for byte, 3 whole name, 2 within the value, 1 similar,
    0 not at all. Null and blank values get no row; null and blank names match
    nothing. Of equal names the canonical one, then the one with the smaller
    entry, stands. The list goes out in blocks of about ``block`` entries, its
    words in blocks of about ``words``, which bounds what the driver collects
    and sends; a longer list takes a pass per block and gives the same rows.
    """
    spark = values.sparkSession
    scratch = Scratch(spark, "matches")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = values.select(F.col("scope").cast("string").alias("scope"), F.col("value").cast("string").alias("value")).where(F.trim("value") != "").distinct().repartition(tasks, "scope", "value")
    asked = scratch.keep(asked.mapInArrow(_folded, _TYPED))
    named = names.select(F.col("scope").cast("string").alias("scope"), F.col("entry").cast("string").alias("entry"), F.col("name").cast("string").alias("name"), "canonical").where(F.col("entry").isNotNull() & (F.trim("name") != "")).distinct()

    # what every typed word may stand for, over all words of the list; matching costs far more than its bytes tell, so the number of tasks is set
    known = named.select("name").distinct().mapInArrow(_list_words, "words array<string>").select(F.explode("words").alias("w")).distinct()
    typed = scratch.keep(asked.select(F.explode("words").alias("word")).distinct().repartition(tasks))
    near: DataFrame | None = None
    for part in _blocks(known, "w", words):
        one = typed.mapInArrow(_near(spark.sparkContext.broadcast([r[0] for r in part.collect()])), _HITS).where(F.size("hits") > 0)
        near = one if near is None else near.unionByName(one)
    near = scratch.keep(near.groupBy("word").agg(F.flatten(F.collect_list("hits")).alias("hits")))
    spread = scratch.keep(asked.select("scope", "value", F.explode("words").alias("word")))
    hints = lookup_join(spread, near, ["word"], "inner").groupBy("scope", "value").agg(F.collect_list(F.struct("word", "hits")).alias("near"))
    same = F.coalesce(F.concat(F.lit("="), F.col("scope")), F.lit("")).alias("at")
    ready = asked.select("scope", "value", "folded", same).join(hints.select("value", "near", same), ["at", "value"], "left").select("scope", "value", "folded", "near")
    ready = scratch.keep(ready)

    found: DataFrame | None = None
    for part in _blocks(named, "entry", block):
        sent = spark.sparkContext.broadcast([tuple(r) for r in part.sort("scope", "entry", "name").collect()])
        one = ready.repartition(tasks).mapInArrow(_matcher(sent), _MATCHED)
        found = one if found is None else found.unionByName(one)
    best = F.min_by(F.struct("entry", "way", "score"), F.struct(-F.col("rank"), -F.col("score"), -F.col("words"), "other", "entry"))
    return found.groupBy("scope", "value").agg(best.alias("b")).select("scope", "value", "b.entry", "b.way", "b.score")


def concept_names(concepts: DataFrame) -> DataFrame:
    """(scope, entry, name, canonical) of the labels of all concepts."""
    first = concepts.select(F.col("vertical_id").alias("scope"), F.col("id").alias("entry"), F.col("preflabel").alias("name"), F.lit(True).alias("canonical"))
    return first.unionByName(concepts.select(F.col("vertical_id").alias("scope"), F.col("id").alias("entry"), F.explode("altlabels").alias("name"), F.lit(False).alias("canonical")))


def concepts_of_values(candidates: DataFrame, requests: DataFrame, concepts: DataFrame) -> DataFrame:
    """(origin, record_id, concept_id, way, score) of every freely typed value that is not blank and not exactly a label.

    The values are surface_form and concept of the candidates and
    canonical_concept of the requests; exactly a label is one equal byte for
    byte to the preflabel of a concept of the row's vertical, of any concept
    where that is null. A record delivered twice with equal values counts once.
    concept_id is '' where the value means no concept. Empty tables give no rows.
    """
    scratch = Scratch(candidates.sparkSession, "values")
    of = lambda df, origin, key: df.select(F.lit(origin).alias("origin"), F.col(key).alias("record_id"), F.col("vertical_id").alias("scope"), F.col(origin).alias("value"))
    typed = of(candidates, "surface_form", "candidate_id").unionByName(of(candidates, "concept", "candidate_id")).unionByName(of(requests, "canonical_concept", "request_id"))
    typed = scratch.keep(typed.where(F.trim("value") != "").distinct())
    scoped = F.coalesce(F.concat(F.lit("="), F.col("scope")), F.lit("")).alias("at")
    found = match_values(typed, concept_names(concepts)).select(scoped, "value", "entry", "way", "score")
    # one typed value can stand in a third of all rows
    joined = lookup_join(typed.select("origin", "record_id", scoped, "value"), scratch.keep(found), ["at", "value"], "inner")
    return joined.where(F.col("way") < 4).select("origin", "record_id", F.col("entry").alias("concept_id"), "way", "score")
