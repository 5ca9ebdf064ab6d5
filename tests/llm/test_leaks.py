import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from treeline.llm import leaks as L

DOCS = "doc_id bigint, text string, item_id string, words string"
ITEMS = "item_id bigint, passage string, text string"
r = random.Random(5)
WORDS = ["".join(r.choices("abcdefghijklmnop", k=r.randrange(3, 9))) for _ in range(4000)]


def prose(n, seed):
    return random.Random(seed).choices(WORDS, k=n)


def edit(words, every):
    out = []
    for k, w in enumerate(words):
        if k % every == every - 1:
            out += [["typo" + w], [], [w, "sic"]][k % 3]
        else:
            out.append(w)
    return out


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 60), st.integers(0, 10**6))
def test_simhash_against_brute_force(n, seed):
    v = L.Vocabulary()
    numbers = v.numbers(prose(n, seed))
    got = L.simhashes(v.signs[numbers])
    for k in range(max(0, n - L.WINDOW + 1)):
        total = v.signs[numbers[k : k + L.WINDOW]].astype(int).sum(0)
        assert int(got[k]) == sum(1 << b for b in range(64) if total[b] > 0)
    assert len(got) == max(0, n - L.WINDOW + 1)


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = np.zeros(300, np.uint64)
    for k in range(300):
        for b in rng.choice(64, k % 13, replace=False):
            flips[k] |= np.uint64(1) << np.uint64(b)
    queries = np.concatenate([base ^ flips, rng.integers(0, 2**63, 500, dtype=np.uint64)])
    i, j = L.BlockIndex(base).within(queries)
    brute = {(a, b) for a in range(len(queries)) for b in range(300) if bin(int(queries[a] ^ base[b])).count("1") <= L.RADIUS}
    assert {(int(a), int(b)) for a, b in zip(i, j)} == brute and len(brute) >= 270


def test_recall_by_share_of_altered_words():
    """40-word excerpts with one word in `every` replaced: found through the index, and a smaller radius finds fewer."""
    passages = [prose(80, 700 + i) for i in range(150)]

    def recall(every, radius):
        items, rng, hits = L.Items([(i, " ".join(p), []) for i, p in enumerate(passages)], radius), random.Random(every), 0
        for i, p in enumerate(passages):
            start, shift = rng.randrange(41), rng.randrange(every)
            words = ["x" + w if k % every == shift else w for k, w in enumerate(p[start : start + 40])]
            v = L.Vocabulary()
            numbers = v.numbers(prose(15, i) + words + prose(15, -i))
            prints = L.simhashes(v.signs[numbers])
            hits += items.candidates(prints, np.zeros(len(prints), np.int32), 1)[i]
        return hits / len(passages)

    for every in (6, 8, 10, 12):
        assert recall(every, L.RADIUS) >= 0.95 > 0.4 > recall(every, 3) and recall(every, 0) < 0.05


def test_one_item_in_several_pieces(spark):
    item, body = prose(80, 801), prose(200, 802)
    pieces = body[:40] + item[:17] + body[40:90] + item[30:47] + body[90:140] + item[60:77] + body[140:]
    stock = body[:40] + item[3:9] + body[40:80] + item[20:26] + body[80:120] + item[40:46] + body[120:160] + item[70:76] + body[160:]
    docs = spark.createDataFrame([(1, " ".join(pieces), "", ""), (2, " ".join(stock), "", "")], DOCS)
    assert [x.doc_id for x in L.leaks(docs, spark.createDataFrame([(1, " ".join(item), "")], ITEMS)).collect()] == [1]


def brute_words(doc, item):
    """Item words in shared five-word runs, wherever they are."""
    runs = {tuple(doc[k : k + 5]) for k in range(len(doc) - 4)}
    cov = set()
    for k in range(len(item) - 4):
        if tuple(item[k : k + 5]) in runs:
            cov.update(range(k, k + 5))
    return len(cov)


def test_leaks(spark):
    notice = prose(22, 999)
    items = [(i, " ".join((notice if i % 3 == 0 else []) + prose(80, i))) for i in range(12)]
    passage = {i: t.split() for i, t in items}
    docs, expected = [], set()
    for d in range(400):
        body = prose(150, 10_000 + d)
        if d % 4 == 0:
            body = notice + body
        docs.append([d, body])
    for d, i, a, b, every in ((3, 1, 0, 80, 99), (5, 2, 30, 60, 99), (7, 4, 10, 70, 11), (8, 3, 22, 102, 99), (9, 6, 40, 75, 14), (9, 7, 0, 50, 99)):
        docs[d][1] = docs[d][1][:70] + edit(passage[i][a:b], every) + docs[d][1][70:]
        expected.add((d, i))
    docs[11][1] = docs[11][1] + passage[5][:10]  # a few opening words are no case
    texts = [(d, " ".join(w)) for d, w in docs]
    marked = " ".join(w if k % 3 else f"<b>{w}</b>&nbsp;" for k, w in enumerate(passage[8][5:60]))
    texts += [(900, "x " * 50_000 + marked + " y" * 50_000), (901, ""), (902, None), (None, texts[3][1]), (3, texts[3][1])]
    texts += [(1000 + k, texts[5][1]) for k in range(120)]  # copies of a leaking document leak too
    expected |= {(900, 8)} | {(1000 + k, 2) for k in range(120)}
    df = spark.createDataFrame([(d, t, "a", "b") for d, t in texts], DOCS).repartition(3)
    it = spark.createDataFrame([(i, t, "a") for i, t in items] + [(None, "x y", "a"), (50, None, "a"), (51, "", "a"), (1, items[1][1], "z")], ITEMS)
    got = L.leaks(df, it).collect()
    assert len(got) == len(expected) and {(x.doc_id, x.item_id) for x in got} == expected
    in_blocks = L.leaks(df, it, block_windows=150).collect()
    assert {(x.doc_id, x.item_id) for x in in_blocks} == expected
    words = {d: t.split() for d, t in texts if d is not None and t}
    for x in got:
        if x.doc_id < 900:
            assert x.words <= brute_words(words[x.doc_id], passage[x.item_id]) + 1e-9


def test_many_leaked_documents_and_notices(spark):
    """However many documents carry an item they all leak it; what different items share is a notice, even if few documents carry it."""
    notice = prose(22, 998)
    passage = {i: prose(80, 500 + i) for i in range(3)} | {i: notice + prose(60, 500 + i) for i in (3, 4)}
    passage[5] = edit(passage[0], 15)  # the same passage again
    passage[6] = passage[1][45:] + prose(50, 506)  # a neighbouring cut of the same text
    texts, expected = [], set()
    for d in range(300):
        body = prose(120, 20_000 + d)
        if d % 3 == 0:
            body[60:60] = passage[0]
            expected |= {(d, 0), (d, 5)}
        elif d % 3 == 1:
            body[60:60] = passage[1][45:75] if d % 2 else passage[2][20:46]
            expected |= {(d, 1), (d, 6)} if d % 2 else {(d, 2)}
        elif d < 9:
            body[60:60] = notice
        texts.append((d, " ".join(body), "", ""))
    items = [(i, " ".join(w), "") for i, w in passage.items()]
    got = {(x.doc_id, x.item_id) for x in L.leaks(spark.createDataFrame(texts, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == expected


def test_leaks_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b c", "", "")], DOCS), spark.createDataFrame([(1, "x", "")], ITEMS)
    assert L.leaks(docs.limit(0), items).count() == 0 and L.leaks(docs, items.limit(0)).count() == 0 and L.leaks(docs, items).count() == 0
