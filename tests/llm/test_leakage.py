import random

import pytest

from speechlytics.llm import leakage as L
from tests.conftest import rows


def best_edits(item, doc):
    """The fewest word edits to find ``item`` anywhere in ``doc``."""
    row = [0] * (len(doc) + 1)
    for i, w in enumerate(item, 1):
        last, row = row, [i] + [0] * len(doc)
        for j, d in enumerate(doc, 1):
            row[j] = min(last[j - 1] + (w != d), last[j] + 1, row[j - 1] + 1)
    return min(row)


def brute(item, doc, least=14, one_in=7):
    n = len(item)
    # A passage begins and ends with words that agree, so shrinking it never hides a case that growing would show.
    return any(
        item[i] in doc and item[j - 1] in doc and best_edits(item[i:j], doc) <= (j - i) // one_in
        for i in range(n) for j in range(i + least, n + 1)
    )


def test_alignment_against_brute_force():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(40)]
    agree = 0
    for _ in range(300):
        item = [rng.choice(vocabulary) for _ in range(rng.randint(12, 26))]
        doc = list(item)
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(doc))
            doc[k : k + rng.choice([0, 1])] = rng.choice([[], ["new"], ["x", "y"]])
        doc = [rng.choice(vocabulary) for _ in range(6)] + doc + ["tail"] * 3
        got, want = L.contains_passage(item, doc, 14, 7), brute(item, doc)
        assert not got or want  # what is found is a case
        agree += got == want
    assert agree >= 297  # cases that only an edit at a passage's very end would make are not counted


def test_an_edit_at_either_end_counts_as_any_other():
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(40)]
    only_open = 0
    for _ in range(300):
        item = [rng.choice(vocabulary) for _ in range(rng.randint(12, 26))]
        doc = item[: rng.randint(11, len(item))] + ["tail"] * 4
        for _ in range(rng.randint(0, 3)):
            doc[rng.randrange(len(doc))] = "new"
        n = len(item)
        want = any(best_edits(item[i:j], doc) <= (j - i) // 7 for i in range(n) for j in range(i + 14, n + 1))
        assert L.contains_passage(item, doc, 14, 7, open_end=True) == want
        only_open += want and not L.contains_passage(item, doc, 14, 7)
    assert only_open


def test_documents_with_an_edit_at_an_end(spark):
    item = [f"word{chr(97 + k)}" for k in range(20)]
    docs = {
        1: item[:13] + ["altered"], 2: ["altered"] + item[1:14], 3: item[:13], 4: item[:13] + ["one", "two"],
        5: item[:11] + ["one", "two", "three"], 6: ["one", "two", "three"] + item[3:14],
    }
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    table = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert rows(L.leaked_items(df, table)) == [(7, 1), (7, 2), (7, 3), (7, 4)]


def test_words_written_apart_or_together():
    item = "the quick brown fox jumps over the lazy dog while nobody looks at it".split()
    assert L.contains_passage(item, "the qu ick brown fox jumpsover the lazy dog while nobody looks at it".split(), 14, 7)
    assert not L.contains_passage(item[:13], item, 14, 7) and not L.contains_passage(item, [], 14, 7)


@pytest.mark.parametrize(
    "text",
    [
        "Mary's CAT — “sat” on <b>the</b>&nbsp;mat", "mary&#39;s cat, sat\non the mat", "Mary’s ca­t sat on the mat",
        "Mary\\u0027s cat\\nsat on the mat", "Mary%27s%20cat sat on the mat", "Ｍary's ｃat sat on the mat",
        "**Mary's** _cat_ `sat` on the mat", "Maryâ€™s cat sat on the mat",
    ],
)
def test_folding(text):
    assert L.words(text) == "marys cat sat on the mat".split()
    assert L.squeezed(text) == b"maryscatsatonthemat"


def test_bounds_hold():
    rng = random.Random(1)
    for _ in range(50):
        lengths = [rng.randint(1, 9) for _ in range(18)]
        bound = L.lemma_bounds([lengths], 14, 3, 5)[0]
        start = rng.randint(0, 4)
        cut = sorted(rng.sample(range(14), 3))
        kept, run = 0, 0
        for k in range(14):
            if k in cut:
                kept, run = kept + max(0, run - 4), 0
            else:
                run += lengths[start + k]
        assert bound <= kept + max(0, run - 4)


def test_documents(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {k: say(rng.choice([10, 14, 20, 30, 45])) for k in range(30)}
    docs, want = {}, set()
    for d in range(120):
        words = say(rng.randint(0, 400))
        if d % 2:
            k = rng.randrange(30)
            piece = items[k][rng.randint(0, 3) :] if len(items[k]) > 20 else list(items[k])
            for _ in range(rng.randint(0, 4)):
                piece[rng.randrange(len(piece))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = piece
        docs[d] = words
    for d, words in docs.items():
        want |= {(k, d) for k, item in items.items() if L.contains_passage(item, words, 14, 7)}
    styled = [(d, rng.choice([str.upper, str.title, str.lower])(rng.choice([" ", "\n", ", "]).join(w)), 1) for d, w in docs.items()]
    df = spark.createDataFrame([*styled, (900, None, 1), (901, "", 1), (902, "ß" * 5000, 1)], "doc_id long, text string, item_id int")
    table = spark.createDataFrame([*((k, " ".join(w), "t") for k, w in items.items()), (99, None, "t"), (98, "", "t")], "item_id long, text string, test_set string")
    assert want and rows(L.leaked_items(df, table)) == sorted(want, key=repr)
    report = {r.item_id: r.n_docs for r in L.leakage_report(df, table).collect()}
    assert report[99] == 0 and sum(report.values()) == len(want)
    assert L.leaked_items(df.limit(0), table).isEmpty() and L.leaked_items(df, table.limit(0)).isEmpty()


def odd_items():
    """Items with long insertions, of short words, and with words written apart, and documents that hold them."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    plain = [f"word{c}" for c in letters[:14]]
    short = [letters[k % 26] for k in range(0, 42, 3)]
    tiny = ["a", "bc"] * 8
    items = {1: plain, 2: short, 3: tiny, 4: plain[::-1] + short}
    docs = {
        1: plain[:5] + ["x" * 130] + plain[5:9] + ["y" * 130] + plain[9:],
        2: plain[:5] + ["x" * 5000] + plain[5:],
        3: ["so"] + short[:7] + ["new"] + short[7:] + ["end"],
        4: tiny[:6] + ["zz"] + tiny[7:],
        5: plain[:4] + ["x", "y", "z"] + plain[4:],
        6: [part for w in plain for part in (w[:2], w[2:])],
        7: ["lead"] * 500 + items[4] + ["tail"] * 500,
    }
    return items, docs


@pytest.mark.parametrize("block", [100, 1])
def test_no_case_is_lost_by_the_filter(spark, block):
    items, docs = odd_items()
    want = {(i, d) for i, item in items.items() for d, doc in docs.items() if L.contains_passage(item, doc, 14, 7, open_end=True)}
    assert {(1, 1), (1, 2), (2, 3), (3, 4), (1, 6), (4, 7)} <= want and (1, 5) not in want
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()] + [(99, None), (98, "")], "doc_id long, text string")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    assert rows(L.leaked_items(df, table, block=block)) == sorted(want, key=repr)


def test_both_ways_give_the_same(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(rng.choice([13, 14, 18, 40])))) for k in range(25)]
    docs = []
    for d in range(60):
        piece = items[rng.randrange(25)][1].split()
        for _ in range(rng.randint(0, 3)):
            piece[rng.randrange(len(piece))] = "new"
        docs.append((d, " ".join(say(rng.randint(0, 90)) + piece + say(20))))
    df, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i, d) for i, a in items for d, b in docs if L.contains_passage(a.split(), b.split(), 14, 7, open_end=True)), key=repr)
    assert want and rows(L.leaked_items(df, table)) == rows(L.leaked_items(df, table, block=3)) == want


def test_markup_of_any_length():
    assert L.words('one<a title="' + "t" * 900 + '">two</a><!--' + "c" * 9000 + "-->three <!-- open") == ["one", "two", "three", "open"]
