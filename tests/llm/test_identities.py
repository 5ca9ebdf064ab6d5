import itertools
import math
import random
from collections import Counter

import pytest

from treeline.llm import identities as I

SIG = "sig_id bigint, repo_slug string, sig_name string, sig_email string, entity string"


def groups(spark, rows):
    df = spark.createDataFrame([(i, r[2] if len(r) > 2 else "repo", r[0], r[1], "x") for i, r in enumerate(rows)], SIG)
    by = {}
    for r in I.entities(df).collect():
        by.setdefault(r.entity, set()).add(r.sig_id)
    return sorted(map(sorted, by.values()))


@pytest.mark.parametrize(
    "text,given,family",
    [
        ("Theodore Kakenulten", "theodore", "kakenulten"),
        ("KAKENULTEN Theodore", "theodore", "kakenulten"),
        ("Kakenulten, Theodore", "theodore", "kakenulten"),
        ("Ted J. Kakenulten (Platform)", "ted", "kakenulten"),
        ("  Łukasz  Kömokopar ", "lukasz", "komokopar"),
        ("A. Stevemilus", "", "stevemilus"),
        ("", "", ""),
        (None, "", ""),
        ("x", "", ""),
    ],
)
def test_read_name(text, given, family):
    name = I.read_name(text)
    assert (name.given, name.family) == (given, family)


def test_edits_against_brute_force():
    def brute(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    r = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(r.choices("abc", k=r.randrange(7))) for _ in "xy")
        assert I.edits(a, b, 2) == min(brute(a, b), 3)


def test_entities(spark):
    rows = [
        ("Theodore Kakenulten", "theodore.kakenulten@home.example"),
        ("Ted K.", "theodore.kakenulten@home.example"),
        ("Kakenulten, Theodore", "THEODORE.KAKENULTEN+git@ home.example"),
        ("Theodore Kaknulten", None),
        ("kakenultdev51", "tkakenulten@home.example"),
        (None, "1234+theodorekakenulten@users.noreply.host.example"),
        ("Susanna Kakenulten", "susanna.kakenulten@home.example"),
        ("S. Kakenulten", "dev-team@home.example"),
        ("Groginik Labs", "oss@groginik.example"),
        ("GROGINIK Laboratories (bot)", "bot@groginik.example"),
        ("Amara Vovanopar", "dev-team@home.example"),
        (None, None),
        ("", ""),
        ("z" * 50_000, "q"),
    ]
    assert groups(spark, rows) == [[0, 1, 2, 3, 4, 5], [6, 7], [8, 9], [10], [11], [12], [13]]


def test_organisations_of_several_words(spark):
    """Form words are learned: inc and lab stand beside two cores each that their domains spell."""
    rows = [
        ("Red Hat Inc", "info@redhat.example"),
        ("Red Cross Foundation", "info@redcross.example"),
        ("Hat Red Inc", None),
        ("University of Oslo Lab", None),
        ("University of Bergen Lab", None),
        ("Bergen University of Lab", None),
        ("Blue Sky Inc", "oss@bluesky.example"),
        ("Umbra Lab", "bot@umbra.example"),
        ("LAB Penta", "ci@penta.example"),
        ("Anna Lobipik", "anna@lobipik.example"),
        ("Peter Lobipik", "peter@lobipik.example"),
    ]
    assert groups(spark, rows) == [[0, 2], [1], [3], [4, 5], [6], [7], [8], [9], [10]]


def test_nicknames_and_endings_are_learned(spark):
    rows = [(f"Bill {f}", f"william.{f.lower()}@a.example") for f in ("Kamotar", "Zenilow", "Rudastik")]
    rows += [("kamotaxx7", "william.kamotar@a.example"), ("zenilxx8", "wzenilow@b.example"), ("William Zenilow", "wzenilow@b.example")]
    rows += [("Bill Garuvosen", None), ("William Garuvosen", "william.garuvosen@a.example"), ("Wally Garuvosen", None, "elsewhere"), ("garuvosxx3", "root@a.example")]
    assert groups(spark, rows) == [[0, 3], [1, 4, 5], [2], [6, 7, 9], [8]]


def variants(given, family, r):
    def typo(w):
        k = r.randrange(1, len(w) - 1)
        return r.choice([w[:k] + w[k + 1 :], w[:k] + w[k] + w[k:], w[: k - 1] + w[k] + w[k - 1] + w[k + 1 :], w[:k] + "q" + w[k + 1 :]])

    login = f"{given}.{family}".lower()
    return {
        "order": (f"{family.upper()} {given}", None),
        "comma": (f"{family}, {given}", f"{login}@mail.example"),
        "typo in the given name": (f"{typo(given)} {family}", None),
        "typo in the family name": (f"{given} {typo(family)}", f"{given[0]}{family}@work.example".lower()),
        "initial": (f"{given[0]}. {family}", f"{login}@home.example"),
        "address only": (None, f"{login}@home.example"),
    }


def test_recall_of_variants(spark):
    r = random.Random(8)
    parts = "ka ru mo ti zen dar low mi gus pol".split()
    people = sorted({(g, "".join(r.choices(parts, k=4)).capitalize()) for g in ("Theodore", "Margaret", "Jennifer", "Stephen", "Amara") for _ in range(8)})
    rows, kinds = [], []
    for i, (g, f) in enumerate(people):
        for kind, row in {"plain": (f"{g} {f}", f"{g}.{f}@home.example".lower()), **variants(g, f, r)}.items():
            rows.append(row)
            kinds.append((i, kind))
    lost = Counter()
    for members in groups(spark, rows):
        assert len({kinds[m][0] for m in members}) == 1  # no two people in one
        if not any(kinds[m][1] == "plain" for m in members):
            lost.update(kinds[m][1] for m in members)
    assert sum(lost.values()) <= 0.02 * len(rows), lost


def test_long_beginnings_of_family_names(spark):
    rows = [("Theodore Vandermeulenbroeck", None), ("vandermeulenbr51", None), ("Vandermeulenbroeck", None), ("Susanna Vandermolenaarsen", None), ("Noor " + "z" * 50_000, None)]
    assert groups(spark, rows) == [[0, 1, 2], [3], [4]]


def test_empty_and_repeated(spark):
    assert groups(spark, []) == []
    assert groups(spark, [("Noor Tasaletar", "noor.tasaletar@a.example")] * 5) == [[0, 1, 2, 3, 4]]


def test_cosine_pairs_and_linkage_against_brute_force(spark):
    r = random.Random(2)
    parts = ["ka", "ru", "mo", "ti", "zen", "dar", "low"]
    known = [(i, "", r.choice(["amara", "zoe", "noor"]), "".join(r.choices(parts, k=3))) for i in range(90)]
    df = spark.createDataFrame(known, "pid bigint, p_org string, p_given string, p_family string")
    shares = {"p_given": 0.45, "p_family": 0.55}

    def grams(w):
        return {f"^{w}$"[i : i + n] for n in (3,) for i in range(max(1, len(w) + 2 - n + 1))}

    vec = {}
    for part, col in (("p_given", 2), ("p_family", 3)):
        df_count = Counter(g for k in known for g in grams(k[col]))
        for k in known:
            w = {g: 1 + math.log(len(known) / df_count[g]) / 4 for g in grams(k[col])}
            norm = math.sqrt(sum(x * x for x in w.values()))
            for g, x in w.items():
                vec.setdefault(k[0], {})[part, g] = x / norm * math.sqrt(shares[part])
    sims = {(a, b): sum(x * vec[b].get(g, 0) for g, x in vec[a].items()) for a, b in itertools.combinations(range(90), 2)}
    expected = {p: s for p, s in sims.items() if s >= 0.6}
    got = {(x.a, x.b): x.sim for x in I.cosine_pairs(I.vectors(df, shares), 0.6, shares, hot=7).collect()}
    assert set(got) == set(expected) and all(abs(got[p] - expected[p]) < 1e-9 for p in got)

    clusters = [{i} for i in range(90)]
    while True:
        def avg(x, y):
            return sum(expected.get((min(a, b), max(a, b)), 0) for a in x for b in y) / len(x) / len(y)

        best = max(((round(avg(x, y), 9), -max(min(x), min(y)), -min(min(x), min(y)), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(clusters), 2)), default=None)
        if best is None or best[0] < 0.6:
            break
        i, j = best[3:]
        clusters[i] |= clusters.pop(j)
    pairs = spark.createDataFrame([(a, b, s) for (a, b), s in expected.items()], "a bigint, b bigint, sim double")
    by = {}
    for x in I.average_linkage(df.select("pid"), pairs, 0.6).collect():
        by.setdefault(x.cluster, set()).add(x.pid)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, clusters))


def spellings(name, n, seed):
    """n spellings of a name, each with another letter in one place of the family name or one letter more."""
    r, given, family = random.Random(seed), *name.split(" ")
    found = {family: None}
    while len(found) < n:
        k, c = r.randrange(1, len(family)), r.choice("abcdefghijklmnopqrstuvwxyz")
        found[family[:k] + c + family[k + r.randrange(2) :]] = None
    return [f"{given} {f.capitalize()}" for f in found]


def test_hundreds_of_spellings_of_one_name(spark):
    names = spellings("Theodore Kakenultenovarimus", 450, 3)
    assert groups(spark, [(n, None) for n in names]) == [list(range(450))]


def test_entity_links(spark):
    found = spark.createDataFrame([(1, 9), (2, 9), (3, 9), (4, 8), (2, 9)], "sig_id bigint, entity bigint")
    assert sorted(tuple(x) for x in I.entity_links(found).collect()) == [(1, 9, 1, 2), (2, 9, 1, 2), (3, 9, 1, 2), (4, 8, 4, 0)]


def test_same_pairs(spark):
    found = spark.createDataFrame([(1, 9), (2, 9), (3, 9), (4, 8), (2, 9)], "sig_id bigint, entity bigint")
    assert sorted(tuple(x) for x in I.same_pairs(found).collect()) == [(1, 2), (1, 3), (2, 3)]
