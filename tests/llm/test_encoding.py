"""Garbled encodings: what is made here must be found and restored, and nothing else."""

from __future__ import annotations

import random

import pytest

from termloom.llm import encoding

SCHEMA = "node_id long, doc string, buf string, garbled boolean"
TEXTS = {
    "de": "Größe Fläche Röhre Behälter Straße Kühlung Prüfstand Gerät Höhe Öl".split(),
    "fr": "données numéro élément façade côté système très réservoir été modèle".split(),
    "ru": "насос клапан давление температура уровень масло расход труба".split(),
    "en": "level valve temperature reading pressure pump workshop café naïve".split(),
    "pl": "łożysko ciśnienie długość żółty wąż główny część źródło".split(),
}
WAYS = [("utf-8", "cp1252"), ("utf-8", "mac-roman"), ("utf-8", "cp437"), ("cp1252", "cp850"), ("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("cp1250", "cp1252")]


def corpus():
    rng = random.Random(9)
    rows, bad = [], {}
    for i in range(4000):
        lang = rng.choice(list(TEXTS))
        text = " ".join(rng.choice(TEXTS[lang]) for _ in range(rng.randint(3, 8)))
        if i % 14 == 0 and not text.isascii():
            real, shown = rng.choice(WAYS)
            try:
                wrong = text.encode(real).decode(shown)
            except UnicodeError:
                wrong = text
            if wrong != text:
                bad[i] = text
                rows.append((i, "d", wrong, None))
                continue
        rows.append((i, "d", rng.choice([text, text, text.upper(), f"{text} ±0,5 °C", f"“{text}”"]), None))
    return rows, bad


def test_found_and_restored(spark):
    rows, bad = corpus()
    rows += [(9001, "d", "Gr��e", None), (9002, None, None, None), (9003, "d", "", None), (9004, "d", "plain ascii", None), (0, "d", rows[0][2], None)]
    got = {r["node_id"]: r for r in encoding.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = {k for k, r in got.items() if r["garbled"]}
    assert 9001 in found and not {9002, 9003, 9004} & found
    found.discard(9001)
    hits = found & set(bad)
    assert len(hits) >= 0.97 * len(bad) and len(found - set(bad)) <= 0.02 * len(bad)
    assert sum(got[k]["restored"] == bad[k] for k in hits) >= 0.95 * len(hits)


#: Letters and words of languages, in pages that are not among the known ones.
HEBREW = "שלום משאבה לחץ טמפרטורה מים צינור שסתום מנוע חיישן בדיקה מפלס זרימה מספר מערכת תחזוקה".split()
RUSSIAN = "насос клапан давление температура уровень масло расход труба двигатель датчик проверка номер линия система цех корпус".split()
FRENCH = "données numéro élément façade côté système très réservoir été modèle débit équipé contrôle pièce âgé fenêtre température".split()


def unknown_swap(words, garble, extra, n=200, clean=500, seed=4):
    """Rows with clean and garbled texts of a language among others; the ids of the garbled ones with their texts."""
    rng = random.Random(seed)
    rows = [(i, "d", t, None) for i, (_, _, t, _) in enumerate(r for r in corpus()[0][:1500])]
    bad = {}
    for k in range(n + clean):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(3, 7)))
        if k < n:
            bad[10_000 + k] = text
            text = garble(text)
        rows.append((10_000 + k, "d", text, None))
    return rows + extra, bad


def permuted(page, seed):
    order = list(range(0x80, 0x100))
    random.Random(seed).shuffle(order)
    return lambda text: bytes(order[b - 0x80] if b >= 0x80 else b for b in text.encode(page)).decode("latin-1")


SWAPS = {
    "hebrew": (HEBREW, lambda t: t.encode("cp1255").decode("latin-1")),
    "permuted russian": (RUSSIAN, permuted("cp1251", 5)),
    "permuted french": (FRENCH, permuted("cp1252", 6)),
}


@pytest.mark.parametrize("name", SWAPS)
def test_unknown_pages_are_deciphered(spark, name):
    words, garble = SWAPS[name]
    rows, bad = unknown_swap(words, garble, [])
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["node_id"]: r for r in encoding.judged(df).collect()}
    clean = {r[0] for r in rows if r[0] >= 10_000 and r[0] not in bad}
    found = sum(got[k]["garbled"] for k in bad)
    right = sum(a == b for k, t in bad.items() if got[k]["restored"] for a, b in zip(t, got[k]["restored"])) / sum(map(len, bad.values()))
    assert found >= 0.9 * len(bad) and right >= 0.8
    assert sum(got[k]["garbled"] for k in clean) <= 0.02 * len(clean)


def test_letter_tables_are_learned():
    """A table that starts with wrong letters is put right by what the language has between its neighbours."""
    counts = encoding._Counts()
    words = TEXTS["de"] * 40 + TEXTS["fr"] * 40
    encoding.expectation(words, encoding.np.ones(len(words)), None, counts)
    k = encoding.PAIRS.index(("cp850", "cp1252"))
    wrong = encoding.substitution(k) | {ord("÷"): "ø", ord("ß"): "å"}  # ö and á in truth
    model = encoding.Model(counts.pairs, counts.letters, {k: -3.0}, {k: wrong})
    shown = [w.encode("cp1252").decode("cp850") for w in TEXTS["de"] for _ in range(5) if not w.isascii()]
    seen = encoding._Counts()
    seen.under(k, shown, encoding.np.ones(len(shown)))
    right = encoding.relearned(model, k, seen.shown[k])
    assert right[ord("÷")] == "ö" and right[ord("³")] == "ü" and right[ord("ß")] == "å"


def test_nothing_is_found_without_learning(spark):
    rows, bad = corpus()
    got = encoding.judged(spark.createDataFrame(rows, SCHEMA), rounds=0).where("garbled").count()
    assert bad and got == 0


def test_nothing(spark):
    assert encoding.judged(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("text", ["Höhe", "насос", "naïve", "Ωμέγα"])
def test_ciphers_invert_what_they_read(text):
    for shown, real in encoding.PAIRS:
        if real in ("utf-8*2",) or shown.startswith("utf"):
            continue
        try:
            raw = text.encode(real)
            wrong = encoding.to_text(raw, shown)
        except UnicodeError:
            continue
        if wrong is None or wrong == text:
            continue
        back = encoding.to_bytes(wrong, shown)
        assert back == raw
        assert encoding.to_text(back, real) == text


def test_substitution_tables_are_letter_to_letter():
    k = encoding.PAIRS.index(("cp850", "cp1252"))
    assert "Gr÷▀e".translate(encoding.substitution(k)) == "Größe"


def test_pages_of_several_bytes_and_rare_pages(spark):
    made, damaged = corpus()
    texts = [r[2] for r in made if r[0] not in damaged]
    rows = [(i, "d", t, None) for i, t in enumerate(texts)]
    ways = [("utf-8", "gbk", "ru"), ("utf-8", "big5", "ru"), ("utf-8", "euc-kr", "ru"), ("utf-8", "mac-cyrillic", "de"), ("utf-8", "cp1257", "de"), ("cp1251", "mac-cyrillic", "ru")]
    bad = {}
    for n, (real, shown, lang) in enumerate(ways):
        for m, word in enumerate(TEXTS[lang]):
            text = f"{word} {TEXTS[lang][m - 1]}"
            try:
                wrong = text.encode(real).decode(shown)
            except UnicodeError:
                continue
            if wrong != text:
                bad[100_000 + 100 * n + m] = text
                rows.append((100_000 + 100 * n + m, "d", wrong, None))
    got = {r["node_id"]: r for r in encoding.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len({k // 100 for k in bad}) >= 4
    assert sum(got[k]["garbled"] for k in bad) >= 0.9 * len(bad)
    assert sum(got[k]["restored"] == t for k, t in bad.items()) >= 0.8 * len(bad)
