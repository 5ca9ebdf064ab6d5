"""People and organisations under many spellings: which signatures stand for the same one.

Each distinct spelling (a name with an address) becomes a vector of weighted character n-grams in four parts of fixed share:
given name, family name, the name as typed and the login of a personal address. So namesakes by family name stay apart, and a
typo, another order or another login costs little. Distributed sparse joins give all pairs of names with a cosine of at least
one threshold and of their spellings with at least another; no partner is left out, since average linkage, by which the pairs
are grouped, needs them all. What names
have in common beyond letters is learned from the table: nicknames from names whose address spells another given name, an
organisation's form words from names whose other words spell the address's domain, the endings of handles from handles whose
address spells the family name. Spellings that lack a part (initials, handles, a bare address) are then attached to the one
cluster that fits them, if there is just one.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.session import materialise

#: How many different addresses must show a nickname or a handle's ending, or organisations a form word.
ATTESTED = 2
#: Least cosine of two names (given and family part) and, of those names, of two spellings.
NAME_THRESHOLD = 0.6
THRESHOLD = 0.5
NAME_PARTS = {"p_given": 0.45, "p_family": 0.55}
PARTS = {"p_org": 1.0, "p_given": 0.30, "p_family": 0.36, "typed": 0.14, "login": 0.20}
_LETTERS = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "ı": "i", "ð": "d", "þ": "th"})
_HANDLE = re.compile(r"^([a-z]{3,})\d+$")


def fold(text: str) -> str:
    """Lower case without accents."""
    plain = unicodedata.normalize("NFKD", text.translate(_LETTERS))
    return "".join(c for c in plain if not unicodedata.combining(c)).lower()


@dataclass(frozen=True)
class Name:
    """given, family: full words, or "" if unknown; initial: of the given name; start: how the family name begins, maybe with
    a handle's ending; words: all in lower case without accents and remarks in brackets."""

    given: str = ""
    family: str = ""
    initial: str = ""
    start: str = ""
    handle: bool = False
    words: tuple[str, ...] = ()


def read_name(text: str | None) -> Name:
    """A name as typed. Anything that isn't recognised gives an empty Name."""
    if not text:
        return Name()
    bare = re.sub(r"\([^()]*\)|\[[^\[\]]*\]", " ", text).strip()
    words = [w for w in re.split(r"[\s,]+", bare) if w]
    folded = [fold(w).strip(".'\"") for w in words]
    if not any(folded):
        return Name()
    if len(words) == 1:
        m = _HANDLE.match(folded[0])
        start = m.group(1) if m else folded[0]
        return Name(start=start, handle=bool(m), words=tuple(folded)) if len(start) > 2 else Name()
    if "," in bare:
        family, _, given = bare.partition(",")
        words, folded = [*given.split(), *family.split()], [fold(w).strip(".'\"") for w in [*given.split(), *family.split()]]
    elif len(folded[0]) > 1 and words[0].isupper() and not words[-1].isupper():
        words, folded = [*words[1:], words[0]], [*folded[1:], folded[0]]
    kept = [f for f in folded if f]
    if len(kept) < 2:
        return Name()
    first, last = kept[0], kept[-1]
    given = first if len(first) > 1 else ""
    if len(last) == 1:
        return Name(given=given, initial=first[:1], start=last, words=tuple(kept))
    return Name(given=given, family=last, initial=first[:1], start=last, words=tuple(kept))


def organisation(words: tuple[str, ...], login: str, domain: str) -> tuple[str, list[str]]:
    """(core, other words) of a name whose words, one or some in a row, spell a part of the domain; ("", []) otherwise.

    A login that shows one of the other words, or begins as one, is a person's with a domain of their own.
    """
    labels = set(domain.split("."))
    for n in range(len(words) - 1, 0, -1):
        for k in range(len(words) - n + 1):
            if len(core := words[k : k + n]) and "".join(core) in labels and len("".join(core)) > 2:
                rest = [*words[:k], *words[k + n :]]
                if any(len(w) > 1 and w in login for w in rest) or any(login == w[:1] + core[-1] for w in rest):
                    return "", []
                return " ".join(sorted(core)), rest
    return "", []


def read_address(text: str | None) -> tuple[str, str, str]:
    """(address, login, domain): the address without blanks, case and +tag; ("", "", "") if there is none."""
    if not text:
        return "", "", ""
    plain = fold(re.sub(r"\s+", "", text))
    login, at, domain = plain.rpartition("@")
    if not at or not login:
        return "", "", ""
    if "noreply" in domain:
        login = login.rpartition("+")[2]
    else:
        login = login.partition("+")[0]
    return f"{login}@{domain}", login, domain


def edits(a: str, b: str, most: int = 2) -> int:
    """Edit distance of two words, a swap of neighbours counting as one; most + 1 if it is more than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, before, row = before, row, [i + 1]
        for j, y in enumerate(b):
            d = min(before[j] + (x != y), before[j + 1] + 1, row[j] + 1)
            if i and j and x == b[j - 1] and a[i - 1] == y:
                d = min(d, last[j - 1] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _near(a: str, b: str) -> bool:
    """Whether two words can be one word with a typo."""
    return a == b or (min(len(a), len(b)) > 2 and edits(a, b, 1) <= 1)


def _common(a: str, b: str) -> int:
    """How many letters two words begin with in common."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def relation(name: Name, login: str) -> tuple[str, str, str, str]:
    """(kind, given, family, ending) of an address as the address of the name's bearer.

    kind: exact, it spells given and family name; last, it spells initial and family name, the given name is as typed; part,
    it shows some of the family name; none, it has nothing of the name (a shared mailbox) or there is no name. ending: what a
    handle has behind the beginning of the family name that the address spells.
    """
    parts = [p for p in re.split(r"[._-]+", login) if p]
    none = ("none", "", "", "")
    if len(parts) == 2 and min(map(len, parts)) > 1:
        for g, f in (parts, parts[::-1]):
            if name.family and _near(f, name.family):
                return ("exact", g, f, "")
            if not name.family and name.start:
                n = _common(f, name.start)
                if (n == len(name.start) and (not name.initial or g[:1] == name.initial or name.given)) or (name.handle and n > 3):
                    return ("exact", g, f, name.start[n:])
        return none
    joined = "".join(parts)
    if name.family:
        if joined.endswith(name.family) and len(joined) > len(name.family) + 2:
            return ("exact", joined[: -len(name.family)], name.family, "")
        if name.given and joined.startswith(name.given) and _near(joined[len(name.given) :], name.family):
            return ("exact", name.given, joined[len(name.given) :], "")
        if name.given and joined == name.family + name.given:
            return ("exact", name.given, name.family, "")
        if joined[:1] == name.initial and _near(joined[1:], name.family):
            return ("last", name.given, joined[1:], "")
        return ("part", "", "", "") if name.family in joined else none
    if name.start:
        spelled = bool(name.given) and joined.startswith(name.given)
        rest = joined[len(name.given) :] if spelled else joined[1:] if name.initial in ("", joined[:1]) else ""
        n = _common(rest, name.start)
        if len(rest) > 3 and ((n == len(name.start) and (n > 2 or name.given)) or (name.handle and n > 3)):
            return ("exact" if spelled else "last", name.given, rest, name.start[n:])
        if len(name.start) > 2 and name.start in joined:
            return ("part", "", "", "")
    return none


READ = "struct<given: string, family: string, initial: string, start: string, handle: boolean, words: array<string>, core: string, other: array<string>, address: string, login: string, domain: string, rel: string, rel_given: string, rel_family: string, ending: string>"
_READ = [x.split(":")[0] for x in READ[7:-1].split(", ")]


def _read_batch(names: pd.Series, emails: pd.Series) -> pd.DataFrame:
    rows = []
    for n, e in zip(names, emails):
        name = read_name(n)
        address, login, domain = read_address(e)
        core, other = organisation(name.words, login, domain) if address and name.words else ("", [])
        rel = relation(name, login) if address and not core else ("none", "", "", "")
        rows.append((name.given, name.family, name.initial, name.start, name.handle, list(name.words), core, other, address, login, domain, *rel))
    return pd.DataFrame(rows, columns=_READ)


def read_signatures(signatures: DataFrame) -> DataFrame:
    """(spelling, given, family, ...): what each distinct pair of name and e-mail says; spelling: a hash of the two."""
    read = F.pandas_udf(_read_batch, READ)
    distinct = signatures.where("sig_id IS NOT NULL").select("sig_name", "sig_email").distinct()
    return distinct.select(spelling_key(), read("sig_name", "sig_email").alias("r")).select("spelling", "r.*")


def spelling_key() -> Column:
    return F.xxhash64(F.coalesce(F.concat(F.lit("n"), "sig_name"), F.lit("")), F.coalesce(F.concat(F.lit("e"), "sig_email"), F.lit(""))).alias("spelling")


def with_organisations(read: DataFrame) -> DataFrame:
    """read with org: the core of an organisation's name, its words in alphabetical order; "" for all others.

    A form word (labs, inc) is one that stands beside ATTESTED or more different cores which their domains spell. A name is an
    organisation's if its domain spells its core, or if it has a form word that isn't its first; the core is then all else.
    """
    forms = read.where("core <> ''").select("core", F.explode("other").alias("word")).groupBy("word").agg(F.count_distinct("core").alias("n")).where(F.col("n") >= ATTESTED)
    learned = forms.agg(F.collect_list("word").alias("forms"))
    rest = F.filter("words", lambda w: ~F.array_contains("forms", w))
    formal = (F.size(rest) > 0) & F.exists(F.slice("words", 2, 1_000_000), lambda w: F.array_contains("forms", w))
    org = F.when(F.col("core") != "", F.col("core")).when(formal, F.array_join(F.array_sort(rest), " ")).otherwise("")
    rows = read.crossJoin(F.broadcast(learned)).withColumn("org", org).drop("forms", "core", "other")
    name = F.col("org") == ""
    return rows.withColumns({c: F.when(name, F.col(c)).otherwise("") for c in ("given", "family", "initial", "start")}).withColumn("rel", F.when(name, F.col("rel")).otherwise("none"))


def nicknames(read: DataFrame) -> DataFrame:
    """(given, full): given names as typed whose bearers' addresses mostly spell another one, on ATTESTED or more addresses."""
    spelled = read.where("rel = 'exact' AND given <> '' AND length(rel_given) > 1").groupBy("given", "rel_given").agg(F.count_distinct("address").alias("n"))
    per = spelled.groupBy("given").agg(F.sum("n").alias("total"), F.max(F.struct("n", "rel_given")).alias("top"))
    return per.where((F.col("top.rel_given") != F.col("given")) & (F.col("top.n") >= ATTESTED) & (2 * F.col("top.n") > F.col("total"))).select("given", F.col("top.rel_given").alias("full"))


def without_endings(read: DataFrame) -> DataFrame:
    """read with start cut of the longest ending that ATTESTED or more handles have behind a family name's beginning."""
    seen = read.where("handle AND ending <> ''").groupBy("ending").agg(F.count_distinct("address").alias("n")).where(F.col("n") >= ATTESTED)
    learned = seen.agg(F.collect_list("ending").alias("endings"))
    longest = F.array_max(F.transform(F.filter("endings", lambda x: F.endswith("start", x)), lambda x: F.length(x)))
    cut = F.when(F.col("handle") & (F.coalesce(longest, F.lit(0)) > 0), F.expr("substring(start, 1, length(start) - longest)")).otherwise(F.col("start"))
    return read.crossJoin(F.broadcast(learned)).withColumn("longest", longest).withColumn("start", cut).drop("endings", "longest", "ending")


def address_owners(read: DataFrame) -> DataFrame:
    """(address, owner_given, owner_family, owner_kind, bare): whose a personal address is, by all signatures that use it.

    An address is personal if at least half of the names with it have to do with it; a shared mailbox has no owner. The
    owner is the best attested spelling: one that the address confirms letter by letter, else the most frequent.
    Counts of distinct spellings are aggregated, so an address on a third of all rows is no large group.
    """
    used = read.where("address <> '' AND org = ''").groupBy("address", "login", "given", "family", "start", "rel", "rel_given", "rel_family").agg(F.count("*").alias("n"))
    named = (F.col("family") != "") | (F.col("start") != "")
    fits = F.col("rel").isin("exact", "last", "part")

    def owner(q: int, given: str, family: str) -> Column:
        return F.struct(F.lit(q).alias("q"), "n", F.col(given).alias("g"), F.col(family).alias("f"))

    spelled = F.when(F.col("rel") == "exact", owner(3, "rel_given", "rel_family"))
    last = F.when((F.col("rel") == "last") & (F.col("rel_given") != ""), owner(2, "rel_given", "rel_family"))
    typed = F.when((F.col("rel") == "part") & (F.col("given") != "") & (F.col("family") != ""), owner(1, "given", "family"))
    half = F.when(F.col("rel") == "last", owner(0, "rel_given", "rel_family"))
    per = used.groupBy("address", "login").agg(
        F.sum(F.when(named & fits, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(named, F.col("n")).otherwise(0)).alias("named"),
        F.max(F.coalesce(spelled, last, typed, half)).alias("best"),
    )
    return per.where("named = 0 OR 2 * good >= named").select("address", F.col("best.g").alias("owner_given"), F.col("best.f").alias("owner_family"), F.col("best.q").alias("owner_kind"), (F.col("named") == 0).alias("bare"))


def profiles(read: DataFrame) -> DataFrame:
    """read with the profile of each spelling: p_given, p_family (full or ""), p_org, initial, start.

    A personal address tells more than the name typed with it; a name with a shared mailbox or none stands for itself. A
    given name that isn't spelled by the address is replaced by that which it is a nickname of.
    """
    owned = read.join(address_owners(read), "address", "left")
    personal = F.coalesce(F.col("owner_family") != "", F.lit(False)) & ((F.col("rel") != "none") | ((F.col("family") == "") & (F.col("start") == "")) | F.col("bare"))
    by_owner = personal & (F.col("owner_given") != "")
    rows = owned.withColumns(
        {
            "p_given": F.when(by_owner, F.col("owner_given")).when(F.col("family") != "", F.col("given")).otherwise(""),
            "p_family": F.when(personal, F.col("owner_family")).when(F.col("family") != "", F.col("family")).otherwise(""),
            "initial": F.when(personal & ~by_owner, F.substring("login", 1, 1)).otherwise(F.col("initial")),
            "personal": personal | (F.col("rel") != "none"),
            "given_sure": by_owner & (F.col("owner_kind") >= 3),
            "family_sure": by_owner & (F.col("owner_kind") >= 2),
        }
    )
    nicks = nicknames(read)
    full = rows.join(nicks.select(F.col("given").alias("p_given"), F.col("full").alias("full_1")), "p_given", "left").join(nicks.select("given", F.col("full").alias("full_2")), "given", "left")
    return full.select(
        "spelling",
        "address",
        "login",
        "domain",
        F.col("org").alias("p_org"),
        F.when(F.col("given_sure"), F.col("p_given")).otherwise(F.coalesce("full_1", "p_given")).alias("p_given"),
        "p_family",
        F.array_join("words", " ").alias("typed"),
        F.when(F.col("initial") == F.substring("given", 1, 1), F.substring(F.coalesce("full_2", "initial"), 1, 1)).otherwise(F.col("initial")).alias("initial"),
        "start",
        F.coalesce(F.col("bare"), F.lit(False)).alias("bare"),
        (F.col("given") != "").alias("has_given"),
        F.coalesce("full_2", "given").alias("given"),
        "personal",
        "given_sure",
        "family_sure",
    )


def word_grams(text: Column, size: int = 3) -> Column:
    """The character n-grams of the words of a text, each word with its ends marked."""

    def of_word(word: Column) -> Column:
        marked = F.concat(F.lit("^"), word, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - (size - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring(marked, i, F.lit(size)))

    return F.flatten(F.transform(F.filter(F.split(text, r"[ ._-]+"), lambda w: w != ""), of_word))


def vectors(known: DataFrame, parts: dict[str, float]) -> DataFrame:
    """(pid, gram, w): unit vectors; each part is normalised by itself and has its share of the squared length.

    known: pid and one column per part. Within a part a gram weighs by its rarity among all profiles.
    """
    total = known.agg(F.count("*").alias("total"))
    long = None
    for part, share in parts.items():
        g = known.where(F.col(part) != "").select("pid", F.lit(part).alias("part"), F.lit(share).alias("share"), F.explode(F.array_distinct(word_grams(F.col(part)))).alias("gram"))
        long = g if long is None else long.unionByName(g)
    df = long.groupBy("part", "gram").agg(F.count("*").alias("df"))
    weighed = long.join(df, ["part", "gram"]).join(F.broadcast(total)).withColumn("raw", 1 + F.log(F.col("total") / F.col("df")) / 4)
    norm = weighed.groupBy("pid", "part").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    scaled = weighed.join(norm, ["pid", "part"]).select("pid", F.concat_ws(":", "part", "gram").alias("gram"), "df", (F.col("raw") / F.col("norm") * F.sqrt("share")).alias("w"))
    whole = scaled.groupBy("pid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return scaled.join(whole, "pid").select("pid", "gram", "df", (F.col("w") / F.col("len")).alias("w"))


def _prefix(vecs: DataFrame, part: str, share: float, least: float) -> DataFrame:
    """(pid, gram, df): the rarest grams of a part; two vectors whose parts have a cosine >= least share one of them."""
    order = Window.partitionBy("pid").orderBy("df", "gram")
    before = F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = vecs.where(F.startswith("gram", F.lit(f"{part}:"))).withColumn("rest", 1 - F.coalesce(before, F.lit(0.0)) / share)
    return rows.where(F.col("rest") >= least * least - 1e-9).select("pid", "gram", "df")


def cosine_pairs(vecs: DataFrame, threshold: float, parts: dict[str, float], hot: int = 500) -> DataFrame:
    """(a, b, sim), a < b: every pair of vectors (of one part, or of two that all have) with cosine >= threshold.

    Prefix filtering: grams are put in order of rarity; a part whose grams after position k have length < t can reach the
    cosine t only with one that shares one of its first k. Of two parts with shares s and 1 - s each must reach what the other
    at its best leaves open, so both prefixes must meet: they are indexed by pairs of grams, which are far rarer than single
    ones. Candidates are distinct pairs, and the full cosine of each is computed by joining both vectors. No pair at the
    threshold is missed and there is no cap on partners. A key that about `hot` vectors or more have is split over several tasks.
    """
    total = vecs.agg(F.count_distinct("pid").alias("total"))
    one, *other = ((part, share, max(0.0, (threshold - (1 - share)) / share)) for part, share in parts.items())
    keys = _prefix(vecs, *one).select("pid", F.col("gram").alias("g1"), F.col("df").cast("double").alias("n"))
    for part in other:
        second = _prefix(vecs, *part).crossJoin(F.broadcast(total)).select("pid", F.col("gram").alias("g2"), (F.col("df") / F.col("total")).alias("rate"))
        keys = keys.join(second, "pid").select("pid", F.concat_ws(" ", "g1", "g2").alias("g1"), (F.col("n") * F.col("rate")).alias("n"))
    keys = materialise(keys.select("pid", F.xxhash64("g1").alias("key"), F.greatest(F.ceil(F.col("n") / hot), F.lit(1)).cast("int").alias("splits")))
    left = keys.select(F.col("pid").alias("a"), "key", F.pmod(F.xxhash64("pid"), F.col("splits")).cast("int").alias("salt"))
    right = keys.select(F.col("pid").alias("b"), "key", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("salt"))
    candidates = left.join(right, ["key", "salt"]).where("a < b").select("a", "b").distinct()
    return cosines(vecs, candidates).where(F.col("sim") >= threshold)


def cosines(vecs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, sim) of given pairs."""
    packed = vecs.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias("v"))
    both = pairs.select("a", "b").join(packed.select(F.col("pid").alias("a"), F.col("v").alias("va")), "a").join(packed.select(F.col("pid").alias("b"), F.col("v").alias("vb")), "b")
    sim = F.aggregate(F.map_entries("va"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(F.col("vb"), e["key"]), F.lit(0.0)))
    return both.select("a", "b", sim.alias("sim"))


def average_linkage(ids: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(pid, cluster): average-linkage clusters of ids at the threshold; pairs that aren't given count as 0.

    Rounds of merging all clusters that are each other's most similar one. Average linkage is reducible, so this gives the
    same tree as merging one pair at a time. No component is ever collected; each round is joins and sums over the edges.
    Ties go to the smaller ids. A round merges at least the most similar clusters of all, so there are fewer after each and it
    ends; a name of many spellings, most of which are nearest to the same cluster, takes many rounds.
    """
    member = materialise(ids.select("pid", F.col("pid").alias("cluster")))
    size = ids.select(F.col("pid").alias("c"), F.lit(1).cast("bigint").alias("n"))
    edges = pairs.select("a", "b", F.col("sim").alias("total"))
    edges = materialise(edges.union(edges.select(F.col("b"), F.col("a"), F.col("total"))))
    while True:
        sized = edges.join(size.select(F.col("c").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("c").alias("b"), F.col("n").alias("nb")), "b")
        avg = sized.withColumn("avg", F.round(F.col("total") / (F.col("na") * F.col("nb")), 9)).where(F.col("avg") >= threshold)
        best = avg.groupBy("a").agg(F.max_by("b", F.struct("avg", -F.greatest("a", "b"), -F.least("a", "b"))).alias("b"))
        mutual = best.alias("x").join(best.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a"))).where("x.a < x.b").select(F.col("x.b").alias("gone"), F.col("x.a").alias("kept"))
        mutual = materialise(mutual)
        if mutual.isEmpty():
            return member
        move_a, move_b = mutual.select(F.col("gone").alias("a"), F.col("kept").alias("ka")), mutual.select(F.col("gone").alias("b"), F.col("kept").alias("kb"))
        moved = edges.join(move_a, "a", "left").join(move_b, "b", "left").select(F.coalesce("ka", "a").alias("a"), F.coalesce("kb", "b").alias("b"), "total").where("a <> b")
        edges = materialise(moved.groupBy("a", "b").agg(F.sum("total").alias("total")))
        member = materialise(member.join(mutual, member["cluster"] == mutual["gone"], "left").select("pid", F.coalesce("kept", "cluster").alias("cluster")))
        size = member.groupBy(F.col("cluster").alias("c")).agg(F.count("*").alias("n"))


def confirmed(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs that differ by no more than a typo: one edit in a part, where a swap of neighbours is one.

    A part that personal addresses spell for both profiles is no typo: if it differs, they are two people.
    """

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edits(x, y) for x, y in zip(a, b)], dtype="int32")

    columns = ("p_org", "p_given", "p_family", "given_sure", "family_sure")

    def side(x: str) -> DataFrame:
        return known.select(F.col("pid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))

    def same(part: str, sure: str) -> Column:
        return (F.col(f"{part}_a") == F.col(f"{part}_b")) | ~(F.col(f"{sure}_a") & F.col(f"{sure}_b"))

    both = pairs.join(side("a"), "a").join(side("b"), "b").where(same("p_given", "given_sure") & same("p_family", "family_sure"))
    apart = distance("p_given_a", "p_given_b") + distance("p_family_a", "p_family_b") + distance("p_org_a", "p_org_b")
    return both.where(apart <= 2).select("a", "b", "sim")


def similar_names(names: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of names (nid) that can be one name. Organisations and people are never one another."""
    pairs = None
    for which, parts in (("p_org = ''", NAME_PARTS), ("p_org <> ''", {"p_org": 1.0})):
        vecs = materialise(vectors(names.where(which).select(F.col("nid").alias("pid"), *parts), parts))
        found = cosine_pairs(vecs, NAME_THRESHOLD, parts)
        pairs = found if pairs is None else pairs.unionByName(found)
    return confirmed(pairs, names.withColumnRenamed("nid", "pid")).select("a", "b")


def clustered(prof: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(spelling, pid; pid, cluster) of the full profiles: pid stands for spellings with one vector, cluster for one entity.

    Which spellings are compared follows from their names; how alike they are, from their whole vectors.
    """
    full = (F.col("p_org") != "") | ((F.col("p_given") != "") & (F.col("p_family") != ""))
    person = F.col("p_org") == ""

    def of_person(c: Column) -> Column:
        return F.when(person, c).otherwise("")

    parts = {
        "p_org": F.col("p_org"),
        "p_given": of_person(F.col("p_given")),
        "p_family": of_person(F.col("p_family")),
        "typed": of_person(F.col("typed")),
        "login": F.when(person & F.col("personal"), F.regexp_replace("login", "[._-]+", " ")).otherwise(""),
    }
    rows = prof.where(full).select("spelling", "given_sure", "family_sure", *(c.alias(k) for k, c in parts.items()))
    nid, pid = F.xxhash64(F.concat_ws("|", "p_org", "p_given", "p_family")), F.xxhash64(F.concat_ws("|", *parts))
    rows = materialise(rows.withColumn("nid", nid).withColumn("pid", pid))
    names = materialise(rows.groupBy("nid", "p_org", "p_given", "p_family").agg(F.max("given_sure").alias("given_sure"), F.max("family_sure").alias("family_sure")))
    units = materialise(rows.select("pid", "nid", *parts).distinct())
    a, b = units.select(F.col("pid").alias("a"), F.col("nid").alias("na")), units.select(F.col("pid").alias("b"), F.col("nid").alias("nb"))
    across = similar_names(names).select(F.col("a").alias("na"), F.col("b").alias("nb"))
    compared = a.join(b, F.col("na") == F.col("nb")).where("a < b").select("a", "b")
    compared = compared.unionByName(across.join(a, "na").join(b, "nb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    alike = cosines(materialise(vectors(units, PARTS)), compared).where(F.col("sim") >= threshold)
    return rows.select("spelling", "pid"), average_linkage(units.select("pid"), alike, threshold)


def entities(signatures: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(sig_id, entity): signatures of one person or organisation have the same entity.

    signatures: sig_id, repo_slug, sig_name, sig_email. A signature with neither a usable name nor a personal address is an
    entity by itself; so is one that fits several. Repeated rows, NULLs, empty and very long names and extra columns do no
    harm; an empty table gives an empty result.
    """
    prof = materialise(profiles(materialise(without_endings(with_organisations(read_signatures(signatures))))))
    of_spelling, clusters = clustered(prof, threshold)
    found = of_spelling.join(clusters, "pid").select("spelling", F.col("cluster").alias("entity"))
    sigs = signatures.where("sig_id IS NOT NULL").select("sig_id", "repo_slug", spelling_key())
    rows = materialise(sigs.join(prof, "spelling").join(found, "spelling", "left"))
    sure, loose = rows.where("entity IS NOT NULL"), rows.where("entity IS NULL")

    # what an incomplete profile can be recognised by, most telling first; a key that several entities have tells nothing
    people = sure.where("p_family <> ''").select("repo_slug", "entity", "p_given", "p_family").distinct()
    letter, family, given, repo = F.substring("p_given", 1, 1), F.col("p_family"), F.col("p_given"), F.col("repo_slug")
    # the beginnings of family names in the lengths that are asked for: few, and small enough to broadcast
    lengths = loose.where("p_family = '' AND start <> ''").select(F.length("start").alias("len")).distinct()
    starts = people.join(F.broadcast(lengths), F.col("len") <= F.length("p_family"))
    begin = F.substring("p_family", 1, F.col("len"))

    def key(n: int, *parts: Column) -> Column:
        return F.when(F.forall(F.array(*parts), lambda x: x.isNotNull() & (x != "")), F.concat_ws("|", F.lit(n).cast("string"), *parts))

    def told(rows: DataFrame, *keys: Column) -> DataFrame:
        return rows.select(F.explode(F.array_compact(F.array(*keys))).alias("k"), "entity")

    shown = told(sure.where("personal"), key(0, F.col("address")))
    shown = shown.unionByName(told(people, key(1, F.concat(given, family)), key(1, F.concat(family, given)), key(1, F.concat(letter, family)), key(2, letter, family), key(3, repo, letter, family)))
    shown = shown.unionByName(told(starts, key(4, repo, given, begin), key(5, repo, begin)))
    only = shown.groupBy("k").agg(F.min("entity").alias("found"), F.max("entity").alias("other")).where("found = other").drop("other")
    half = F.when(F.col("p_family") == "", F.col("start"))
    asked = [
        key(0, F.col("address")),
        F.when(F.col("bare"), key(1, F.regexp_replace("login", "[._-]", ""))),
        key(2, F.col("initial"), family),
        key(3, repo, F.col("initial"), family),
        F.when(F.col("has_given"), key(4, repo, F.col("given"), half)),
        F.when(~F.col("has_given") & (F.length(half) > 2), key(5, repo, half)),
    ]
    keys = loose.select("sig_id", F.explode(F.array_compact(F.array(*asked))).alias("k")).join(only, "k")
    first = keys.groupBy("sig_id").agg(F.min_by("found", "k").alias("found"))
    # addresses nobody else explains still tie their own signatures together; the order of their words is unknown
    words = F.array_sort(F.regexp_extract_all("login", F.lit(r"[^._-]+"), F.lit(0)))
    spelled = F.when(F.size(words) > 1, F.array_join(words, ".")).otherwise(F.col("address"))
    own = F.when(F.col("bare") & (F.col("address") != ""), F.xxhash64(F.lit("address"), spelled)).otherwise(F.xxhash64(F.lit("alone"), "sig_id"))
    out = loose.join(first, "sig_id", "left").select("sig_id", F.coalesce("found", own).alias("entity"))
    return sure.select("sig_id", "entity").unionByName(out)


def entity_links(found: DataFrame) -> DataFrame:
    """(sig_id, entity, representative, links): membership with the smallest signature of the entity, and how many it links.

    The whole result in as many rows as there are signatures; `same_pairs` writes it out as pairs.
    """
    ids = found.distinct()
    per = ids.groupBy("entity").agg(F.min("sig_id").alias("representative"), (F.count("*") - 1).alias("links"))
    return ids.join(per, "entity").select("sig_id", "entity", "representative", "links")


def same_pairs(found: DataFrame) -> DataFrame:
    """(sig_id_a, sig_id_b), a < b: the pairs of signatures of one entity."""
    ids = found.distinct()
    return ids.select(F.col("sig_id").alias("sig_id_a"), "entity").join(ids.select(F.col("sig_id").alias("sig_id_b"), "entity"), "entity").where("sig_id_a < sig_id_b").select("sig_id_a", "sig_id_b")
