import random
from collections import defaultdict

from treeline.llm import packing as P

DOCS = "doc_id bigint, text string, n_tokens string, container_id string"


def brute_add(bins, size, capacity, limit, item):
    """bins: list of [free, name] in any order."""
    fits = [b for b in bins if b[0] >= size]
    if fits:
        b = min(fits, key=lambda b: b[0])
    else:
        if len(bins) == limit:
            bins.remove(min(bins, key=lambda b: b[0]))
        b = [capacity, item]
        bins.append(b)
    b[0] -= size
    return b


def test_packer_free_space_as_brute_force():
    r = random.Random(1)
    packer, bins = P.Packer(100, 7), []
    for i in range(3000):
        size = r.randrange(0, 101)
        packer.add(size, (i, 0, size))
        brute_add(bins, size, 100, 7, i)
        free = sorted(f for f, names in enumerate(packer.by_free) for _ in names)
        assert free == sorted(b[0] for b in bins)


def test_pieces():
    assert P.pieces(0, 10) == [0] and P.pieces(10, 10) == [10] and P.pieces(11, 10) == [10, 1] and P.pieces(20, 10) == [10, 10]


def check(rows, capacity):
    fill = defaultdict(int)
    for r in rows:
        fill[r.container_id] += r.n_tokens
    assert max(fill.values()) <= capacity
    return fill


def test_pack(spark):
    r = random.Random(2)
    words = "tree node gate metric commit path owner".split()
    texts = [" ".join(r.choices(words, k=r.randrange(1, 400))) for _ in range(900)] + ["", None, "tree " * 9000, "é" * 7000] + ["same text"] * 20
    data = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "no id", "x", "y"), (0, texts[0], "x", "y")]
    rows = P.pack_texts(spark.createDataFrame(data, DOCS).repartition(3)).collect()
    fill = check(rows, 2048)
    encode = P.encoder(P.tokenizer_file()).encode_ordinary
    sizes = defaultdict(list)
    for x in rows:
        sizes[x.doc_id].append((x.piece_no, x.n_tokens))
    for i, t in enumerate(texts):
        n = len(encode(t)) if t else 0
        assert sorted(sizes[i])[:: 2 if i == 0 else 1] == list(enumerate(P.pieces(n, 2048)))
    assert len(sizes[0]) == 2
    used = sum(fill.values())
    assert used / (2048 * len(fill)) > 0.98


def test_repeated_ids_never_share_a_name(spark):
    """Two rows of one id that both open a bin: no container above the capacity."""
    text = {n: "tree " * n for n in (1500, 1000, 700)}
    rows = [(1, text[1500]), (2, text[1500]), (1, text[1500]), (1, text[1000]), (1, text[700])] * 40
    df = spark.createDataFrame([(d, t, "", "") for d, t in rows], DOCS).repartition(4)
    out = P.pack_texts(df, open_bins=5).collect()
    assert len(out) == len(rows)
    assert len(check(out, 2048)) >= 120


def test_bins_close_and_are_carried_on(spark):
    r = random.Random(7)
    df = spark.createDataFrame([(i, "tree " * r.randrange(1, 900), "", "") for i in range(2000)], DOCS).repartition(20)
    fills = {}
    for rounds in (False, True):
        out = P.pack_texts(df, open_bins=8, rounds=rounds).collect()
        assert sorted(x.doc_id for x in out) == list(range(2000))
        fills[rounds] = check(out, 2048)
    assert len(fills[True]) < len(fills[False])
    least = sum(fills[True].values()) / 2048
    assert len(fills[True]) < 1.1 * least


def test_many_texts_without_tokens(spark, monkeypatch):
    monkeypatch.setattr(P, "EMPTY_ROWS", 50)
    df = spark.createDataFrame([(i, "" if i % 3 else None, "", "") for i in range(1000)], DOCS)
    out = P.pack_texts(df, open_bins=2).collect()
    assert sorted(x.doc_id for x in out) == list(range(1000))


def test_pack_empty(spark):
    assert P.pack_texts(spark.createDataFrame([], DOCS)).count() == 0
