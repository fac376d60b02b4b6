"""Text garbled by a wrong character encoding (problem 3): code-page swaps as substitution ciphers.

A text read with the wrong code page shows, for each byte (or group of bytes) of the real text, a fixed other
letter: a substitution cipher. What the languages of the corpus look like, which ciphers occur, how often, and which
letter each of them shows for which is learned together by expectation-maximization:

* *Expectation.* Every distinct word is weighed as it stands against its readings under all ciphers by the bigram model.
* *Maximization.* Bigrams and the weights of ciphers are counted again from these readings, and the letter table of
  each cipher is estimated again: a shown letter stands for the one that fits best between its neighbours.

Pairs of known code pages are where tables start. Words that no cipher explains and that no language would write (signs
or capitals inside, no plain letter at all) are residue; it is parted by the letters it shows, and each part is deciphered
from scratch: an emission table from real to shown letters is learned by EM against the bigrams of each script of the
corpus, from the part's bigram counts alone. What that gives is one more cipher, refined like the others.

Everything learned is counted over all distinct words, into tables of bounded size. A text is a source of its own: one
cipher is chosen for all its words, and applied with translate() where it maps letter to letter.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from termloom.util import cut, parallelism, spread

#: Pages that a text may have been shown in, and pages that it may really be in.
SHOWN = (
    "cp1252 latin-1 mac-roman cp437 cp850 cp1250 cp1251 cp1253 cp1254 cp852 cp866 koi8-r iso8859-2 iso8859-5 iso8859-7 "
    "cp1257 iso8859-15 mac-cyrillic gbk shift-jis big5 euc-jp euc-kr utf-16-le utf-16-be"
).split()
REAL = (
    "utf-8 utf-8*2 cp1252 mac-roman cp437 cp850 cp1250 cp1251 cp1253 cp1254 cp852 cp866 koi8-r iso8859-2 iso8859-5 "
    "iso8859-7 cp1257 iso8859-15 mac-cyrillic gbk shift-jis big5 euc-jp euc-kr utf-16-le utf-16-be"
).split()
#: Pages whose letters may take several bytes, so that no letter-to-letter table holds for them.
WIDE = {"gbk", "shift-jis", "big5", "euc-jp", "euc-kr", *(x for x in (*SHOWN, *REAL) if x.startswith("utf"))}
PAIRS = [(x, y) for x in SHOWN for y in REAL if x != y]
#: Parts of the residue: block of the letters shown, with and without plain letters. Each may give a cipher of its own.
BLOCKS = ("latin", "greek", "cyrillic", "other")
FREE = [(f"{b} letters" + (" and plain ones" if mixed else ""), "unknown page") for b in BLOCKS for mixed in (False, True)]
CIPHERS = [*PAIRS, *FREE]
NARROW = [k for k, (x, y) in enumerate(PAIRS) if x not in WIDE and y not in WIDE]

#: Slots of the bigram and letter tables; fixed, so what is broadcast and collected has a bound.
SLOTS, LETTERS = 1 << 20, 1 << 16
#: Weight of the letter model in a bigram's estimate, and count of a letter never seen.
BACKOFF, UNSEEN = 4.0, 0.02
#: Taken off every bigram's count, so that a rare word does not vouch for itself.
DISCOUNT = 2.0
#: Part of a letter's score that is its own frequency. Garbled text repeats its few odd letters in the
#: same order, which bigrams alone would take for a language of its own.
ALONE = 0.5
#: Log score of two scripts meeting within a word, and cost of each word that a cipher changes in a text.
MIXED, CHANGED = -4.0, 1.0
#: Log probability of U+FFFD in a reading.
LOST = -12.0
#: Start of the weights: the part of words that any cipher touched.
START_DAMAGED = 0.05
#: Least log odds of a cipher before a word is seen: a rare one must not need more than a clear word.
RAREST = -5.5
#: Rounds of expectation-maximization, and the round whose residue is deciphered.
ROUNDS, RESIDUE = 3, 0
#: Expected words from which on a table is estimated again, log likelihood by which another letter must fit better,
#: and occurrences of a letter that may stand for another.
LEARNABLE, BETTER, KNOWN = 3.0, 6.0, 3.0
#: Log score a letter from which on a reading is one that some language of the corpus would write.
WRITTEN = -4.5
#: Accented letters that a word has at least if it is odd for having no others.
BARE = 4
#: Words of a part of the residue from which on it is deciphered, log likelihood a letter that must be gained, rounds, starts.
LEAST_RESIDUE, WORTH_LETTER, DECIPHER_ROUNDS, STARTS = 30.0, 1.0, 60, 150
#: Letters that a page has beside plain ones at most.
PAGE = 128
#: Letters of a script at most that is deciphered into; those of larger ones come in groups of bytes.
LARGEST_SCRIPT = 160
#: Distinct words with gains at most that are broadcast, at some 300 bytes each; with more, tasks find them out again.
MOST_GAINS = 200_000
#: Log odds, per text, from which it counts as garbled.
ODDS = 0.0
#: Word ends, which are no letters of any page.
EDGE = 0xFFFF
#: Words whose readings a task remembers at most; beyond it the memory starts anew.
MEMO = 50_000
#: Readings that lose more than this against the word as it stands are not looked at again.
WORTH = -2.0
BLANK = r"[ \t\n\r]+"
_PARTS = re.compile(f"({BLANK})")
_LEADS = re.compile(rb"[\xc2-\xf4][\x80-\xbf]")


# Pages


def to_bytes(text: str, page: str) -> bytes | None:
    """The bytes that show as ``text`` in a page; undefined positions are control characters."""
    try:
        return text.encode(page)
    except UnicodeEncodeError:
        if not page.startswith("cp125"):
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(page)
        except UnicodeEncodeError:
            if not 0x80 <= ord(c) < 0xA0:
                return None
            out.append(ord(c))
    return bytes(out)


def to_text(raw: bytes, page: str) -> str | None:
    """The text of bytes in a page, or None where they cannot be."""
    try:
        if page == "utf-8*2":
            once = to_bytes(raw.decode("utf-8"), "cp1252")
            return None if once is None else once.decode("utf-8", "replace")
        if page == "utf-8":
            return raw.decode(page, "replace")
        return raw.decode(page)
    except UnicodeDecodeError:
        return None


def reading(word: str, shown: str, real: str) -> str | None:
    """What a word says if it was shown in one page and really is in another; None if it cannot be."""
    raw = to_bytes(word, shown)
    text = None if raw is None else to_text(raw, real)
    return None if text is None or text == word else text


def substitution(cipher: int) -> dict[int, str]:
    """The letter-to-letter table that a pair of single-byte pages starts from."""
    shown, real = PAIRS[cipher]
    table = {}
    for b in range(0x80, 0x100):
        seen, meant = to_text(bytes([b]), shown), to_text(bytes([b]), real)
        if seen is None and shown.startswith("cp125"):
            seen = chr(b)
        if seen and meant:
            table[ord(seen)] = meant
    return table


def wide_readings(word: str) -> list[tuple[str, int]]:
    """Readings of a word under ciphers that are no letter tables, each with a code for the ciphers that give it.

    A reading that is lost for the better half is none.
    """
    raws: dict[bytes, int] = {}
    for s, page in enumerate(SHOWN):
        raw = to_bytes(word, page)
        if raw is not None:
            raws[raw] = raws.get(raw, 0) | 1 << s
    found = []
    for raw, pages in raws.items():
        leads = bool(_LEADS.search(raw))
        for r, real in enumerate(REAL):
            own = pages & _WIDE_PAGES[r]
            if own and (leads or not real.startswith("utf-8")):
                text = to_text(raw, real)
                if text is not None and text != word and 2 * text.count("�") < len(text):
                    found.append((text, r << len(SHOWN) | own))
    return found


@functools.cache
def ciphers_of(code: int) -> list[int]:
    """The ciphers that a code of :func:`wide_readings` stands for."""
    return [_INDEX[s, code >> len(SHOWN)] for s in range(len(SHOWN)) if code >> s & 1]


_INDEX = {(SHOWN.index(x), REAL.index(y)): k for k, (x, y) in enumerate(PAIRS)}
#: For each real page, the shown ones (as bits) with which it makes no letter table.
_WIDE_PAGES = [sum(1 << s for s, page in enumerate(SHOWN) if page != real and (real in WIDE or page in WIDE)) for real in REAL]


# Words as arrays of letters


def split(text: str) -> list[str]:
    """Words between blanks; other spaces may be part of a garbled letter."""
    return [w for w in re.split(BLANK, text) if w]


def script(c: np.ndarray) -> np.ndarray:
    """Rough script of letters: 1 Latin, 2 Greek, 3 Cyrillic, 4 East Asian, more by block, 0 what goes with any."""
    latin = ((c >= 0x61) & (c <= 0x7A)) | ((c >= 0xC0) & (c < 0x250) & (c != 0xD7) & (c != 0xF7))
    east = (c >= 0x3040) & (c < 0xD7B0)
    other = (c >= 0x530) & (c < 0x1100)
    return np.select([latin, (c >= 0x370) & (c < 0x400), (c >= 0x400) & (c < 0x530), east, other], [1, 2, 3, 4, 5 + (c >> 8)], 0)


def codes(words: Sequence[str], fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters before, letters, starts) of the bigrams of all words, each with its ends; ``fold``: in lower case."""
    lower = [w.lower() for w in words] if fold else words
    lengths = np.fromiter(map(len, lower), np.int64, len(lower)) + 1
    x = np.frombuffer(("\n" + "\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) & 0xFFFF
    x[x <= 32] = EDGE
    return x[:-1], x[1:], np.concatenate(([0], np.cumsum(lengths)[:-1]))


def _lower(letter: str) -> int:
    """Code of a letter in lower case, as bigrams have it."""
    code = ord(letter[0])
    return EDGE if code <= 32 or code == EDGE else ord(letter[0].lower()[:1]) & 0xFFFF


def bigram_counts(words: Sequence[str]) -> np.ndarray:
    """Bigrams that each word has with its ends."""
    return np.fromiter(map(len, words), np.float64, len(words)) + 1


def odd_words(words: Sequence[str]) -> np.ndarray:
    """Part of the residue that each word belongs to, if no cipher explains it; -1 for words as languages write them.

    Odd: a sign or control character between two letters, a capital after a small letter, or ``BARE`` letters and more of
    a script that has plain letters, without any of those.
    """
    out = np.full(len(words), -1)
    for n, w in enumerate(words):
        inner = w.strip("\"'()[]{}<>«»“”„‘’.,;:!?…—–-")
        if len(inner) < 2:
            continue
        letters = [c for c in inner if c.isalpha()]
        latin = [c for c in letters if "\x7f" < c < "ɐ"]
        plain = any(c.isascii() for c in letters)
        sign = any(not c.isascii() and not c.isalnum() and c not in "’·‑–­" for c in inner) and len(letters) + sum(c > "\x7f" for c in inner) > 2
        capital = any(b.isupper() and a.islower() for a, b in zip(inner, inner[1:])) and not w.isascii()
        bare = len(latin) >= BARE and len(latin) == len(letters)
        if (sign and any(c > "\x7f" for c in inner[:-1])) or capital or bare:
            high = [ord(c) for c in inner if c > "\x7f"]
            blocks = [0 if c < 0x250 or 0x2000 <= c < 0x2200 else 1 if c < 0x400 else 2 if c < 0x530 else 3 for c in high]
            out[n] = 2 * max(set(blocks), key=blocks.count) + plain
    return out


_SCRIPTS = script(np.arange(LETTERS)).astype(np.int16)


_NONE: dict[int, float] = {}


class Model:
    """Bigrams of letters, weights of ciphers and the letter tables of those that have one."""

    def __init__(self, pairs: np.ndarray, letters: np.ndarray, weights: dict[int, float], tables: dict[int, dict[int, str]]) -> None:
        self.pairs, self.letters, self.weights, self.tables = pairs, letters, weights, tables
        self.total = float(letters.sum()) + 1.0
        self.alone = (letters + UNSEEN) / self.total
        self.log_alone, self.log_letters = ALONE * np.log(self.alone), np.log(letters + BACKOFF)
        self.active = frozenset(weights)
        # what each table makes of every letter that any of them knows: -1 where it has none, and the letter as it is
        self.narrow, known = list(tables), sorted(set().union(*tables.values()))
        self.known = np.array(known, np.int64)
        self.images = np.full((len(tables), len(known)), -1, np.int32)
        self.changes = np.zeros((len(tables), len(known)), bool)
        at = {x: i for i, x in enumerate(known)}
        for n, table in enumerate(tables.values()):
            for x, r in table.items():
                self.images[n, at[x]], self.changes[n, at[x]] = _lower(r), ord(r[0]) != x
        self.memo: dict[str, dict[int, float]] = {}

    def bigram(self, a: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Log scores of letters after others."""
        seen = np.maximum(self.pairs[(a * 1000003 + c) & (SLOTS - 1)] - DISCOUNT, 0.0)
        result = (1 - ALONE) * (np.log(seen + BACKOFF * self.alone[c]) - self.log_letters[a]) + self.log_alone[c]
        x, y = _SCRIPTS[a], _SCRIPTS[c]
        result[(x > 0) & (y > 0) & (x != y)] += MIXED
        result[c == 0xFFFD] = LOST
        return result

    def scores(self, words: Sequence[str]) -> np.ndarray:
        """Log scores of words."""
        if not words:
            return np.zeros(0)
        a, c, starts = codes(words)
        return np.add.reduceat(self.bigram(a, c), starts)

    def weigh(self, words: Sequence[str], wide: Sequence[list[tuple[str, int]]] | None = None) -> list[tuple[np.ndarray, np.ndarray, int | list[tuple[str, int]]]]:
        """Gains of readings over the words as they stand: (indices of words, gains, cipher), for all of a letter table
        at once, and at the end the wide readings one by one with their ciphers. ``wide``: those readings, if known."""
        a, c, starts = codes(words, False)
        bigrams, inverse = np.unique(a << 16 | c, return_inverse=True)
        a, c = bigrams >> 16, bigrams & 0xFFFF
        chars, where = np.unique(np.concatenate((a, c)), return_inverse=True)
        before, after = where[: len(a)], where[len(a) :]
        plain = np.array([_lower(chr(x)) for x in chars.tolist()], np.int64)
        own = np.add.reduceat(self.bigram(plain[before], plain[after])[inverse], starts)
        found = []
        high = (chars >= 0x80) & (chars < EDGE)
        at = np.minimum(np.searchsorted(self.known, chars), max(len(self.known) - 1, 0))
        told = high & (self.known[at] == chars) if len(self.known) else np.zeros(len(chars), bool)
        for n, k in enumerate(self.narrow):
            changes = np.zeros(len(chars), bool)
            changes[told] = self.changes[n, at[told]]
            if not changes.any():
                continue
            image = np.where(high, -1, plain)
            image[told] = self.images[n, at[told]]
            ta, tc = image[before], image[after]
            value = np.where((ta < 0) | (tc < 0), -1e6, self.bigram(np.maximum(ta, 0), np.maximum(tc, 0)))
            gain = np.add.reduceat(value[inverse], starts) - own
            gain[np.add.reduceat(changes[after][inverse].astype(np.int64), starts) == 0] = -1e6
            hit = np.flatnonzero(gain > WORTH)
            if len(hit):
                found.append((hit, gain[hit], k))
        index, texts = [], []
        if wide is None:
            wide = map(wide_readings, words)
        for n, readings in enumerate(wide):
            index += [n] * len(readings)
            texts += readings
        gains = self.scores([t for t, _ in texts]) - own[index] if texts else np.zeros(0)
        keep = np.flatnonzero(gains > WORTH)
        found.append((np.array(index, np.int64)[keep], gains[keep], [texts[i] for i in keep]))
        return found

    def gains(self, words: Sequence[str], wide: dict[str, list[tuple[str, int]]] | None = None) -> None:
        """Remember, of words not seen before, the ciphers whose readings gain; ``wide``: their wide readings, if known."""
        new = [w for w in dict.fromkeys(words) if w not in self.memo]
        if not new:
            return
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(dict.fromkeys(words))
        for w in new:
            self.memo[w] = {}
        for index, gain, what in self.weigh(new, None if wide is None else [wide[w] for w in new]):
            if isinstance(what, int):
                for n, g in zip(index.tolist(), gain.tolist()):
                    if g > 0:
                        self.memo[new[n]][what] = g
            else:
                for n, g, (_, code) in zip(index.tolist(), gain.tolist(), what):
                    if g > 0:
                        own = self.memo[new[n]]
                        for k in self.active.intersection(ciphers_of(code)):
                            own[k] = max(g, own.get(k, 0.0))

    def judge(self, text: str) -> tuple[int, float]:
        """The likeliest cipher of a text and its log odds; (-1, 0) if none is worth trying. Words must be remembered."""
        total: dict[int, float] = {}
        for word in split(text):
            if not word.isascii():
                for k, gain in self.memo.get(word, _NONE).items():
                    if gain > CHANGED and k in self.weights:
                        total[k] = total.get(k, 0.0) + gain - CHANGED
        if not total:
            return -1, 0.0
        odds = {k: g + self.weights[k] for k, g in total.items()}
        best = max(odds, key=lambda k: (odds[k], -k))
        return best, odds[best]

    def restore(self, text: str, cipher: int) -> str:
        """The text with the words changed whose reading under the cipher is likelier."""
        table = self.tables.get(cipher)
        out = []
        for part in _PARTS.split(text):
            if part.isascii() or self.memo.get(part, _NONE).get(cipher, 0.0) <= 0:
                out.append(part)
            else:
                out.append(part.translate(table) if table is not None else reading(part, *PAIRS[cipher]) or part)
        return "".join(out)


# Learning


_STAT = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("x", T.DoubleType())])
_STAT_ARROW = pa.schema([("kind", pa.int32()), ("slot", pa.int64()), ("x", pa.float64())])
#: Kinds of statistics: bigrams, letters, ciphers; from the last on the shown bigrams under each cipher.
_PAIRS, _LETTERS, _CIPHERS, _SHOWN = 0, 1, 2, 3


def distinct_words(texts: DataFrame, column: str) -> DataFrame:
    """(word, n): the distinct words of all texts with their counts."""
    words = texts.where(F.col(column).isNotNull()).select(F.explode(F.split(column, BLANK)).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


_READ = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("texts", T.ArrayType(T.StringType())),
                      T.StructField("ciphers", T.ArrayType(T.LongType()))])
_READ_ARROW = to_arrow_schema(_READ)


def _with_readings(words: DataFrame) -> DataFrame:
    """Distinct words with their wide readings, which are the same in every round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[] if w.isascii() else wide_readings(w) for w in batch.column(0).to_pylist()]
            columns = [*batch.columns, *[pa.array([[x[i] for x in f] for f in found], _READ_ARROW.types[2 + i]) for i in range(2)]]
            yield pa.RecordBatch.from_arrays(columns, schema=_READ_ARROW)

    return words.mapInArrow(run, _READ)


class _Counts:
    """Expected counts of one task; of ciphers, what they explain, the words that stand, and what each might explain alone."""

    def __init__(self) -> None:
        self.pairs, self.letters, self.ciphers = np.zeros(SLOTS), np.zeros(LETTERS), np.zeros(2 * len(CIPHERS) + 1)
        self.shown: dict[int, dict[int, float]] = {}

    def letters_of(self, words: Sequence[str], n: np.ndarray) -> None:
        """Count words as they stand."""
        if words:
            a, c, starts = codes(words)
            self.bigrams(a, c, np.repeat(n, np.diff(np.append(starts, len(a)))))

    def bigrams(self, a: np.ndarray, c: np.ndarray, x: np.ndarray) -> None:
        keep = (c != 0xFFFD) & (a != 0xFFFD)
        a, c, x = a[keep], c[keep], x[keep]
        np.add.at(self.pairs, (a * 1000003 + c) & (SLOTS - 1), x)
        np.add.at(self.letters, a, x)

    def under(self, k: int, words: Sequence[str], x: np.ndarray) -> None:
        """Count the bigrams that words show under a cipher."""
        a, c, starts = codes(words, False)
        slots, inverse = np.unique(a << 16 | c, return_inverse=True)
        sums = np.bincount(inverse, np.repeat(x, np.diff(np.append(starts, len(a)))))
        own = self.shown.setdefault(k, {})
        for slot, s in zip(slots.tolist(), sums.tolist()):
            own[slot] = own.get(slot, 0.0) + s

    def batches(self) -> Iterator[pa.RecordBatch]:
        for kind, table in ((_PAIRS, self.pairs), (_LETTERS, self.letters), (_CIPHERS, self.ciphers)):
            slots = np.flatnonzero(table)
            yield from self._batch(kind, slots, table[slots])
        for k, own in self.shown.items():
            yield from self._batch(_SHOWN + k, np.fromiter(own.keys(), np.int64), np.fromiter(own.values(), np.float64))

    @staticmethod
    def _batch(kind: int, slots: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(slots), 20_000):
            part = slots[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.astype(np.int64)), pa.array(x[at : at + 20_000])], schema=_STAT_ARROW)


def expectation(words: Sequence[str], n: np.ndarray, model: Model | None, counts: _Counts, wide: Sequence[list[tuple[str, int]]] | None = None) -> None:
    """Add the expected counts of distinct words, which are said ``n`` times each; ``wide``: their wide readings."""
    plain = np.array([model is None or w.isascii() for w in words], bool)
    counts.letters_of([w for w, p in zip(words, plain) if p], n[plain])
    if plain.all():
        return
    if model is None:
        return
    if wide is not None:
        wide = [x for x, p in zip(wide, plain) if not p]
    words, n = [w for w, p in zip(words, plain) if not p], n[~plain]
    own, size = model.scores(words), bigram_counts(words)
    index, gain, which, source, length = [], [], [], [], []
    for i, g, what in model.weigh(words, wide):
        if isinstance(what, int):
            index.append(i), gain.append(g), which.append(np.full(len(i), what)), source.append(np.full(len(i), -1)), length.append(size[i])
        else:
            many = [ciphers_of(code) for _, code in what]
            times = np.fromiter(map(len, many), np.int64, len(many))
            which.append(np.fromiter((k for ks in many for k in ks), np.int64, int(times.sum())))
            sizes = np.fromiter((len(text) + 1 for text, _ in what), np.float64, len(what))
            for rows, values in ((index, i), (gain, g), (source, np.arange(len(what))), (length, sizes)):
                rows.append(np.repeat(values, times))
            texts = what
    index, which, source = (np.concatenate(x).astype(int) for x in (index, which, source))
    # readings that no language would write are counted nowhere: they would come to vouch for themselves
    gain = np.concatenate(gain)
    weight = np.full(len(CIPHERS), -np.inf)
    weight[list(model.weights)] = list(model.weights.values())
    prior = weight[which]
    np.add.at(counts.ciphers, len(CIPHERS) + 1 + which, n[index] / (1.0 + np.exp(-np.clip(gain + prior, -50.0, 50.0))))
    written = own[index] + gain >= WRITTEN * np.concatenate(length)
    index, which, source = index[written], which[written], source[written]
    odds = gain[written] + prior[written]
    top = np.zeros(len(words))
    np.maximum.at(top, index, odds)
    part = np.exp(np.minimum(odds - top[index], 0.0))
    stands = np.exp(-top)
    whole = stands + np.bincount(index, part, len(words))
    part, stands = part / whole[index], stands / whole
    odd = odd_words(words)
    unread = (np.bincount(index, minlength=len(words)) == 0) & (own < WRITTEN * size)
    # a word that no language would write does not vouch for itself
    counts.letters_of(words, np.where(odd >= 0, 0.0, n * stands))
    counts.ciphers[len(CIPHERS)] += float((n * stands).sum())
    np.add.at(counts.ciphers, which, part * n[index])
    for k in np.unique(which[part > 1e-2]).tolist():
        mine = np.flatnonzero((which == k) & (part > 1e-2))
        x = part[mine] * n[index[mine]]
        if k in model.tables:
            shown = [words[i] for i in index[mine].tolist()]
            counts.under(k, shown, x)
            counts.letters_of([w.translate(model.tables[k]) for w in shown], x)
        else:
            counts.letters_of([texts[j][0] for j in source[mine].tolist()], x)
    for f in range(len(FREE)):
        left = np.flatnonzero((odd == f) & unread)
        if len(left):
            counts.under(len(PAIRS) + f, [words[i] for i in left.tolist()], n[left])


def _statistics(words: DataFrame, model_of) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, dict[int, float]]]:  # noqa: ANN001
    """One round over the distinct words: expected bigrams, letters, ciphers and what ciphers show, in bounded tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = model_of(), _Counts()
        for batch in batches:
            if batch.num_rows:
                texts, ciphers = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                wide = [list(zip(x, y)) for x, y in zip(texts, ciphers)]
                expectation(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float), model, counts, wide)
        yield from counts.batches()

    sums = words.mapInArrow(run, _STAT).groupBy("kind", "slot").agg(F.sum("x").alias("x"))
    tables = np.zeros(SLOTS), np.zeros(LETTERS), np.zeros(2 * len(CIPHERS) + 1)
    # at most SLOTS + LETTERS + ciphers rows, and for each cipher the pairs of letters of a page
    rows = sums.toArrow()
    kind, slot, x = (rows.column(c).to_numpy() for c in ("kind", "slot", "x"))
    for k, table in enumerate(tables):
        table[slot[kind == k]] = x[kind == k]
    shown = {k - _SHOWN: dict(zip(slot[kind == k].tolist(), x[kind == k].tolist())) for k in np.unique(kind[kind >= _SHOWN]).tolist()}
    return (*tables, shown)


def _matrix(shown: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """Letters shown, and the counts of their bigrams as a matrix."""
    slots = np.fromiter(shown.keys(), np.int64, len(shown))
    letters = np.unique(np.concatenate((slots >> 16, slots & 0xFFFF)))
    at = np.searchsorted(letters, np.stack((slots >> 16, slots & 0xFFFF)))
    counts = np.zeros((len(letters), len(letters)))
    counts[at[0], at[1]] = np.fromiter(shown.values(), np.float64, len(shown))
    return letters, counts


def relearned(model: Model, k: int, shown: dict[int, float]) -> dict[int, str]:
    """The table of a cipher, each shown letter as the one that fits best between its neighbours.

    Another letter than before must fit better by ``BETTER`` and by e at each place; letters not shown keep what they
    started with.
    """
    table = dict(model.tables[k])
    letters, counts = _matrix(shown)
    image = np.array([_lower(table.get(x) or chr(x)) for x in letters.tolist()])
    known = np.flatnonzero(model.letters[0x80:EDGE] >= KNOWN) + 0x80
    if not len(known):
        return table
    for i, c in enumerate(letters.tolist()):
        if not 0x80 <= c < EDGE or counts[i].sum() + counts[:, i].sum() < 1.0:
            continue
        candidates = np.append(known, image[i])
        before, after = np.flatnonzero(counts[:, i]), np.flatnonzero(counts[i])
        fit = sum(counts[j, i] * model.bigram(np.full(len(candidates), image[j]), candidates) for j in before.tolist() if j != i)
        fit = fit + sum(counts[i, j] * model.bigram(candidates, np.full(len(candidates), image[j])) for j in after.tolist() if j != i)
        best = int(np.argmax(fit))
        if fit[best] > fit[-1] + BETTER + counts[:, i].sum():
            table[c] = chr(int(candidates[best]))
            image[i] = candidates[best]
    return table


def decipher(model: Model, shown: dict[int, float], plain: bool, seed: int = 1) -> dict[int, str] | None:
    """A letter table learned from scratch: the shown letters as letters of the script that explains their bigrams best.

    An emission table from real to shown letters is learned by EM against the script's bigrams, from several starts. With
    ``plain``, plain letters stand for themselves and the others are letters of the Latin script. None if no script
    explains the bigrams much better than the letters as they stand.
    """
    letters, counts = _matrix(shown)
    odd = (letters >= 0x80) & (letters < EDGE)
    if not 0 < odd.sum() <= PAGE:  # no page has more letters
        return None
    known = np.flatnonzero(model.letters[:EDGE] >= KNOWN)
    known = known[[chr(x).isalpha() for x in known.tolist()]]
    group = script(known)
    fixed = np.array([_lower(chr(x)) for x in letters[~odd].tolist()])
    rng = np.random.default_rng(seed)

    def value_of(image: np.ndarray) -> float:
        n = len(letters)
        return float((counts * model.bigram(np.repeat(image, n), np.tile(image, n)).reshape(counts.shape)).sum())

    stands = value_of(np.array([_lower(chr(x)) for x in letters.tolist()]))
    best, result = -math.inf, None
    for g in [1] if plain else sorted(set(group.tolist()) - {0, 1, 4}):
        own = known[(group == g) & (known >= 0x80)]
        if not 8 <= len(own) <= LARGEST_SCRIPT:
            continue
        real = np.concatenate((own, fixed))  # plain letters in both cases stand for themselves, each with a row of its own
        pairs = np.maximum(model.pairs[(real[:, None] * 1000003 + real[None, :]) & (SLOTS - 1)] - DISCOUNT / 2, 0.0)
        follow = (pairs + BACKOFF * model.alone[real][None, :]) / (model.letters[real] + BACKOFF)[:, None]
        allowed = np.zeros((len(real), len(letters)))
        allowed[: len(own), odd] = 1.0
        allowed[np.arange(len(own), len(real)), np.flatnonzero(~odd)] = 1.0
        often, rank_real = counts.sum(0)[odd], np.argsort(np.argsort(-model.letters[own]))
        rank_shown = np.argsort(np.argsort(-often))
        for start in range(STARTS):
            emit = allowed.copy()
            near = np.exp(-np.abs(rank_real[:, None] - rank_shown[None, :]) / (2.0 + start % 15))
            emit[: len(own), odd] = near * rng.exponential(1.0, near.shape) if start else near
            emit /= np.maximum(emit.sum(1, keepdims=True), 1e-300)
            start_of = model.letters[real] / model.letters[real].sum()
            joint = start_of[:, None] * follow
            for _ in range(DECIPHER_ROUNDS):
                expect = np.maximum(emit.T @ joint @ emit, 1e-300)
                ratio = counts / expect
                emit = emit * ((joint @ emit @ ratio.T) + (joint.T @ emit @ ratio)) + 1e-9 * allowed
                emit *= allowed
                emit /= np.maximum(emit.sum(1, keepdims=True), 1e-300)
            value = float((counts * np.log(np.maximum(emit.T @ joint @ emit, 1e-300))).sum())
            if value > best:
                image = np.zeros(len(letters), np.int64)
                image[~odd] = fixed
                image[odd] = own[np.argmax((emit * start_of[:, None])[: len(own)][:, odd], 0)]
                best, result = value, image
    if result is None:
        return None
    if value_of(result) - stands < WORTH_LETTER * counts[:, odd].sum():
        return None
    return {int(c): chr(int(r)) for c, r in zip(letters[odd], result[odd])}


def learn(texts: DataFrame, column: str, rounds: int = ROUNDS):  # noqa: ANN201
    """The model of all texts, by expectation-maximization over their distinct words; and these with their readings.

    Every word counts as often as it is said. Empty tables, and no rounds, give a model that finds nothing.
    """
    # few bytes but much work a word: keep the tasks that the session's shuffles are set up for
    words = cut(_with_readings(distinct_words(texts, column).repartition(parallelism(texts.sparkSession))))
    context = texts.sparkSession.sparkContext
    pairs, letters, *_ = _statistics(words, lambda: None)
    if rounds == 0:
        return context.broadcast((pairs, letters, {}, {})), words
    odds = max(math.log(START_DAMAGED / len(PAIRS) / (1 - START_DAMAGED)), RAREST)
    weights = dict.fromkeys(range(len(PAIRS)), odds)
    tables = {k: substitution(k) for k in NARROW}
    for turn in range(rounds):
        state = context.broadcast((pairs, letters, weights, tables))
        pairs, letters, ciphers, shown = _statistics(words, lambda state=state: Model(*state.value))
        known = Model(pairs, letters, weights, tables)
        stands = ciphers[len(CIPHERS)] + 1.0
        # no cipher leaves: a rare one with small gains at first may still be needed
        weights = {k: max(math.log((ciphers[k] + 0.01) / stands), RAREST) for k in weights}
        tables = {k: relearned(known, k, shown[k]) if k in shown and ciphers[k] >= LEARNABLE else t for k, t in tables.items()}
        if RESIDUE <= turn < rounds - 1:
            for f, (name, _) in enumerate(FREE):
                k = len(PAIRS) + f
                rest = shown.get(k, {})
                ends = sum(x for slot, x in rest.items() if slot >> 16 == EDGE)
                if k not in tables and ends >= LEAST_RESIDUE and (table := decipher(known, rest, "plain" in name)):
                    tables[k], weights[k] = table, max(math.log(ends / stands), RAREST)
    return context.broadcast((pairs, letters, weights, tables)), words


_GAINS = T.StructType([T.StructField("word", T.StringType()), T.StructField("ciphers", T.ArrayType(T.IntegerType())), T.StructField("gains", T.ArrayType(T.DoubleType()))])
_GAINS_ARROW = to_arrow_schema(_GAINS)


def known_gains(words: DataFrame, learned) -> dict[str, dict[int, float]] | None:  # noqa: ANN001
    """Gains of all distinct words that have any, if these are at most ``MOST_GAINS``; else None.

    They are what every task would find out for its own words again; so many fit a broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*learned.value)
        for batch in batches:
            own = [(w, list(zip(x, y))) for w, x, y in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)]) if not w.isascii()]
            model.gains([w for w, _ in own], dict(own))
            found = [(w, model.memo[w]) for w, _ in own if model.memo[w]]
            columns = zip(*[(w, list(g), list(g.values())) for w, g in found]) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _GAINS_ARROW)], schema=_GAINS_ARROW)

    found = cut(words.mapInArrow(run, _GAINS))
    if found.count() > MOST_GAINS:
        return None
    rows = found.toArrow()
    return {w: dict(zip(k, g)) for w, k, g in zip(*[rows.column(i).to_pylist() for i in range(3)])}


OUT = T.StructType(
    [
        T.StructField("node_id", T.LongType()),
        T.StructField("garbled", T.BooleanType()),
        T.StructField("shown", T.StringType()),
        T.StructField("real", T.StringType()),
        T.StructField("odds", T.DoubleType()),
        T.StructField("restored", T.StringType()),
    ]
)
_ARROW = pa.schema(
    [("node_id", pa.int64()), ("garbled", pa.bool_()), ("shown", pa.string()), ("real", pa.string()),
     ("odds", pa.float64()), ("restored", pa.string())]
)


def judged(nodes: DataFrame, rounds: int = ROUNDS, odds: float = ODDS) -> DataFrame:
    """(node_id, garbled, shown, real, odds, restored) of every node.

    Garbled: the log odds of the likeliest cipher reach ``odds``, or the text has U+FFFD, the mark
    of bytes that no page could read. ``restored`` is the text meant as far as a cipher gives it
    back, null for nodes that are not garbled or cannot be restored. ``n_bytes`` and ``n_chars`` are
    not used: they may tell of the text before or after the damage, or of neither.

    Defined results: null and empty texts are not garbled; repeated rows are judged each; an empty
    table gives no rows; very long texts are judged whole.
    """
    learned, words = learn(nodes, "buf", rounds)
    gains = known_gains(words, learned)
    told = None if gains is None else nodes.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*learned.value)
        if told is not None:
            model.memo = told.value
        for batch in batches:
            rows, texts = [], batch.column(1).to_pylist()
            if told is None:
                model.gains([w for t in texts if t and not t.isascii() for w in split(t) if not w.isascii()])
            for node_id, text in zip(batch.column(0).to_pylist(), texts):
                if not text or text.isascii():
                    rows.append((node_id, False, None, None, 0.0, None))
                    continue
                cipher, log_odds = model.judge(text)
                hit = cipher >= 0 and log_odds >= odds
                restored = model.restore(text, cipher) if hit else None
                hit = hit and restored != text
                lost = "�" in text
                shown, real = CIPHERS[cipher] if hit else (None, None)
                whole = restored if restored is not None and "�" not in restored else None
                rows.append((node_id, hit or lost, shown, real, log_odds, whole))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return spread(nodes.select(F.col("node_id").cast("bigint"), "buf")).mapInArrow(run, OUT)


def garbled(nodes: DataFrame) -> DataFrame:
    """(node_id) of the nodes whose text is not the one meant."""
    return judged(nodes).where("garbled").select("node_id")
