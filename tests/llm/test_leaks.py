import random

from paperlode.llm import leaks as L

DOC, ITEM = "doc_id long, text string, chars string", "item_id long, lang string, text string"
WORDS = [a + b for a in ("kel", "mor", "tas", "vin", "dro", "pel", "sun", "bar") for b in ("ta", "ro", "nim", "sek", "lo", "gan")]


def passage(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def brute(docs, items):
    """All runs by comparing every place with every place."""
    out = set()
    shared = [s.strip() for _, _, t in items for s in t.split(". ")]
    for d, text, _ in docs:
        doc = L.plain(text)
        for i, lang, item in items:
            for seg in item.split(". "):
                if shared.count(seg.strip()) > 1:
                    continue
                words = seg.replace(".", "").split()
                units = words if lang == "en" else list(L.plain(seg))
                least = 12 if lang == "en" else 24
                if any(L.plain("".join(units[k : k + least])) in doc for k in range(len(units) - least + 1)):
                    out.add((d, i))
    return out


def found(spark, docs, items, **kw):
    o = L.overlaps(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), **kw)
    return {tuple(r) for r in L.leaked(o).collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    items = [(i, "en", passage(rng, 40)) for i in range(6)] + [(10, "zh", "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(80)))]
    docs = []
    for d in range(40):
        i, lang, text = items[d % 7]
        part = " ".join(text.split()[5 : 5 + 9 + d % 7]) if lang == "en" else text[10 : 10 + 20 + d % 9]
        docs.append((d, f"{passage(rng, 10)} {part.upper().replace(' ', '  ')} {passage(rng, 10)}" if lang == "en" else f"前言，{'，'.join(part[k : k + 5] for k in range(0, len(part), 5))}，后记", "x"))
    want = brute(docs, items)
    assert want and found(spark, docs, items) == want == found(spark, docs, items, sieve_most=0)


def test_shared_sentences_are_set_aside(spark):
    common = "this material is for internal testing only and must not be passed on to any third party at all."
    rng = random.Random(5)
    items = [(1, "en", passage(rng, 20) + ". " + common), (2, "en", passage(rng, 20) + ". " + common)]
    assert found(spark, [(7, common, "x")], items) == set()


def test_substitutions_are_tolerated():
    text = "abcdefghijklmnopqrstuvwxyz0123456789" * 3
    other = text[:40] + "#" + text[41:]
    assert L.compared(other, text, None, 0) == (len(text) - 41, 0, len(text))


def test_recall_of_tolerant_overlaps(spark):
    """Passages of 60 characters and more with every twelfth to twentieth character replaced are found again."""
    rng = random.Random(11)
    items = [(i, "zh", "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(90))) for i in range(60)]
    docs = []
    for i, _, text in items:
        part = list(text[10 : 70 + i % 20])
        at = rng.randrange(12)
        while at < len(part):
            part[at] = "囧"
            at += rng.randrange(12, 21)
        docs.append((i, "前" * 40 + "".join(part) + "后" * 40, "x"))
    got = {(r["doc_id"], r["item_id"]) for r in L.overlaps(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).filter("tolerant_chars >= 48").collect()}
    assert len({(i, i) for i in range(60)} & got) >= 54 and all(a == b for a, b in got)


def test_short_words_of_one_item_change_no_other_masks(spark):
    rng = random.Random(2)
    items = [(1, "en", "a b c d e f g h i j k l m"), (2, "en", passage(rng, 30)), (3, "en", "one two")]
    segments = L.with_span(L.item_segments(spark.createDataFrame(items, ITEM)))
    assert {(r["item_id"], r["span"]) for r in segments.collect()} == {(1, 12), (2, 24), (3, 24)}
    docs = [(1, "so a b c d e f g h i j k l it is", "x"), (2, items[1][2][8:], "x"), (3, "one two", "x")]
    assert found(spark, docs, items) == brute(docs, items) == found(spark, docs, items, sieve_most=0) == {(1, 1), (2, 2)}


def test_texts_hashed_together_do_not_run_into_each_other(spark):
    item = "".join(chr(0x4E00 + 7 * k) for k in range(48))
    docs = [(1, item[:12], "x"), (2, item[12:24], "x"), (3, item[24:48], "x")]
    assert found(spark, docs, [(9, "zh", item)]) == {(3, 9)}


def test_edges(spark):
    item = [(1, None, "一" * 30 + "二三四五六七八九十百千万亿甲乙丙丁戊己庚辛壬癸子丑寅卯"), (1, None, None), (None, "en", "x"), (2, "en", "")]
    docs = [(1, None, "x"), (2, "", "x"), (None, "一" * 30, "x"), (3, "零" * 100_000 + "一" * 30, "x"), (3, "零" * 100_000 + "一" * 30, "x")]
    assert found(spark, docs, item) == {(3, 1)}
    assert found(spark, [], item) == set() and found(spark, docs, []) == set()
